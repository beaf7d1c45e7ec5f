"""Evaluation: tallies of read against expected values, list scores, error rates, boards by slice, release gate, contest."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from quillmark.functions.clinical import wilson_lower
from quillmark.functions.similarity import edit_distance, ratio
from quillmark.functions.text import key_alnum, words_only

ACCEPTED = ("checked", "accepted")
EDITS = ("ch_edit", "ch_ref", "wd_edit", "wd_ref")


@pandas_udf(LongType())
def word_edits(a: pd.Series, b: pd.Series) -> pd.Series:
    """F35 on words."""
    return pd.Series([edit_distance((x or "").split(), (y or "").split()) for x, y in zip(a, b, strict=True)], dtype="int64")


def n_words(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), " +"))).cast("long")


def errors(ref: Column, hyp: Column) -> list[Column]:
    """Edits and lengths in letters and words of two plain texts."""
    return [F.levenshtein(ref, hyp).cast("long").alias("ch_edit"), F.length(ref).cast("long").alias("ch_ref"), word_edits(ref, hyp).alias("wd_edit"), n_words(ref).alias("wd_ref")]


def same_value(a: Column, b: Column) -> Column:
    """Equal as numbers if both are, else by letters and digits."""
    x, y = a.try_cast("double"), b.try_cast("double")
    none = F.lit("")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(F.coalesce(key_alnum(a), none) == F.coalesce(key_alnum(b), none))


def judged(values: DataFrame, expected: str = "expected", got: str = "got", status: str = "status") -> DataFrame:
    """A14 of each value: one-and-zero counters and edits; all that boards need are their sums."""
    want, value, how = F.col(expected), F.col(got), F.coalesce(F.col(status), F.lit("absent"))
    has, read, ok = want.isNotNull(), value.isNotNull(), how.isin(*ACCEPTED)
    right = has & read & (key_alnum(want) == key_alnum(value))
    wrong = (has & ~F.coalesce(right, F.lit(False))) | (~has & read)
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0).cast("long")
    ref, hyp = F.coalesce(words_only(want), F.lit("")), F.coalesce(words_only(value), F.lit(""))
    out = values.withColumns({
        "n_expected": one(has), "n_accepted": one(ok & read), "n_accepted_right": one(ok & right), "n_accepted_wrong": one(ok & read & ~F.coalesce(right, F.lit(False))), "n_spurious": one(ok & read & ~has),
        "n_wrong_or_missing": one(wrong), "n_flagged": one(wrong & (how == "needs_check")), "ref_": ref, "hyp_": hyp, "counts_": has | (hyp != ""), "stands_": (has | (hyp != "")) & ok & read,
    })
    out = out.withColumns(dict(zip(EDITS, errors(F.col("ref_"), F.col("hyp_")), strict=True)))
    out = out.withColumns({f"a_{c}": F.when(F.col("stands_"), F.col(c)).otherwise(0).cast("long") for c in EDITS} | {c: F.when(F.col("counts_"), F.col(c)).otherwise(0).cast("long") for c in EDITS})
    return out.drop("ref_", "hyp_", "counts_", "stands_")


COUNTERS = ("n_expected", "n_accepted", "n_accepted_right", "n_accepted_wrong", "n_spurious", "n_wrong_or_missing", "n_flagged", *EDITS, *(f"a_{c}" for c in EDITS))


def share(a: str, b: str) -> Column:
    return F.round(F.try_divide(F.col(a), F.col(b)), 4)


def report(sums: DataFrame) -> DataFrame:
    """Rates of summed counters: precision with its Wilson bound, coverage, catches, error rates; null without a base."""
    bound = F.when(F.col("n_accepted") > 0, F.round(wilson_lower(F.col("n_accepted_right"), F.col("n_accepted")), 4))
    return sums.withColumns({
        "precision": share("n_accepted_right", "n_accepted"), "precision_bound": bound, "coverage": share("n_accepted_right", "n_expected"), "catch_rate": share("n_flagged", "n_wrong_or_missing"),
        "raw_cer": share("ch_edit", "ch_ref"), "raw_wer": share("wd_edit", "wd_ref"), "accepted_cer": share("a_ch_edit", "a_ch_ref"), "accepted_wer": share("a_wd_edit", "a_wd_ref"),
    })


def boards(rows: DataFrame, slices: list[str], counters: tuple[str, ...]) -> DataFrame:
    """Sums overall and for each value of each slice, in one pass: label, val, counters."""
    cuts = [F.struct(F.lit("overall").alias("label"), F.lit("all").alias("val"))] + [F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("val")) for c in slices]
    return rows.withColumn("cut_", F.explode(F.array(*cuts))).groupBy("cut_.label", "cut_.val").agg(*[F.sum(c).alias(c) for c in counters])


def list_scores(expected: Column, found: Column, accepted: Column) -> list[Column]:
    """Hits, misses and extras of two lists of names by letters and digits; accepted: the found names the system stands behind."""
    keys = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), key_alnum), lambda x: x != ""))
    e, f, a = keys(expected), keys(found), keys(accepted)
    n = lambda c, name: F.size(c).cast("long").alias(name)
    return [n(e, "expected"), n(f, "found"), n(F.array_intersect(e, f), "hit"), n(F.array_except(e, f), "missed"), n(F.array_except(f, e), "extra"), n(F.array_except(a, e), "extra_accepted")]


def misfiled(ordered: Column, found_tests: Column, found_others: Column, other_expected: Column) -> list[Column]:
    """Tests filed elsewhere, and others filed as tests."""
    keys = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), key_alnum), lambda x: x != "")
    tests = F.array_distinct(keys(ordered))
    lost = F.array_intersect(F.array_except(tests, keys(found_tests)), keys(found_others))
    return [F.size(tests).cast("long").alias("expected_tests"), F.size(lost).cast("long").alias("filed_elsewhere"), F.size(F.array_intersect(keys(found_tests), keys(other_expected))).cast("long").alias("filed_as_test")]


def paired_edits(expected: list[str] | None, found: list[str] | None, least: float = 0.5) -> dict:
    """Each expected name in order takes the most alike name left (.5 at least); others are deletions, names left insertions."""
    out = dict.fromkeys(EDITS, 0)
    left = list(found) if found is not None else []

    def add(ref: str, hyp: str) -> None:
        for k, v in zip(EDITS, (edit_distance(ref, hyp), len(ref), edit_distance(ref.split(), hyp.split()), len(ref.split())), strict=True):
            out[k] += v

    for e in expected if expected is not None else []:
        scores = [ratio(e, f) for f in left]
        best = max(scores, default=0.0)
        add(e, left.pop(scores.index(best)) if best >= least else "")
    for f in left:
        add("", f)
    return out


def gate(board: DataFrame, limits: dict) -> DataFrame:
    """Reasons that block a release, one row each, from a reported board; none is a pass."""
    overall = F.col("label") == "overall"
    reasons: list[tuple[Column, str]] = [
        (overall & (F.col("documents") < limits["min_documents"]), "too few documents"),
        (overall & (F.col("precision_bound").isNull() | (F.col("precision_bound") < limits["min_precision_bound"])), "precision"),
        (overall & (F.coalesce("coverage", F.lit(0.0)) < limits["min_coverage"]), "coverage"), (overall & (F.col("accepted_cer") > limits["max_accepted_cer"]), "character errors"),
        (overall & (F.col("accepted_wer") > limits["max_accepted_wer"]), "word errors"), (overall & (F.col("a_ch_ref") < limits["min_accepted_chars"]), "too few characters"),
        (~overall & (F.col("n_accepted") >= limits["min_slice_accepted"]) & (F.col("precision_bound") < limits["min_slice_bound"]), "slice precision"),
    ]
    own = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(text)) for c, text in reasons]))
    return board.select("label", "val", F.explode(own).alias("reason"))


def contest(champion: DataFrame, candidate: DataFrame, rules: dict) -> DataFrame:
    """Reported boards slice by slice: both bounds, win, tie or loss (within 1e-9), and whether it drops too far."""
    keep = lambda df, p: df.select("label", "val", F.col("precision_bound").alias(f"{p}_bound"), F.col("n_accepted").alias(f"{p}_n"))
    j = keep(champion, "champion").join(keep(candidate, "candidate"), ["label", "val"])
    c, h = F.col("candidate_bound"), F.col("champion_bound")
    verdict = F.when(c.isNull() | h.isNull(), "no data").when(c > h + 1e-9, "win").when(F.abs(c - h) <= 1e-9, "tie").otherwise("loss")
    drops = F.when(F.col("label") == "overall", c < h).otherwise((F.col("candidate_n") >= rules["min_slice_accepted"]) & (h - c > rules["max_slice_drop"]))
    return j.withColumns({"verdict": verdict, "drops": F.coalesce(drops, F.lit(False))})


def decision(compared: DataFrame, rules: dict) -> DataFrame:
    """One row: wins, ties, losses and what to do: keep the champion for any drop, else get more data, else promote."""
    slices = F.col("label") != "overall"
    n = lambda v: F.count_if(slices & (F.col("verdict") == v)).alias({"win": "wins", "tie": "ties", "loss": "losses"}[v])
    few = F.count_if((F.col("label") == "overall") & ((F.col("candidate_n") < rules["min_accepted"]) | (F.col("champion_n") < rules["min_accepted"]))).alias("few")
    g = compared.agg(n("win"), n("tie"), n("loss"), F.count_if("drops").alias("drops"), few)
    return g.select("wins", "ties", "losses", F.when(F.col("drops") > 0, "keep champion").when(F.col("few") > 0, "need more data").otherwise("promote").alias("verdict"))


def disagreement(lines: DataFrame, truth: str, one: str, two: str, agree: Callable[[Column, Column], Column]) -> list[Column]:
    """Of lines read by two engines: accepted where they agree, how many of those are right, and how many wrong ones a disagreement caught."""
    same = agree(F.col(one), F.col(two))
    right = F.col(one) == F.col(truth)
    return [F.count_if(same).alias("accepted"), F.count_if(~same).alias("review"), F.count_if(same & right).alias("accepted_right"), F.count_if(~same & ~right).alias("caught"), F.count_if(~right).alias("wrong")]
