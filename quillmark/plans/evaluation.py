"""Scoring against SQL: counters, reports, boards by slice, lists, gate and contest."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.functions import linkage as L
from quillmark.functions import text as X
from quillmark.operators import scoring as S
from quillmark.plans import records  # noqa: F401
from quillmark.plans.registry import Tables, cases, fixture, query

#: The same counters in SQL; words differ by at most one place here, so word edits are those that differ.
fixture("wanted_counts", r"""SELECT *, CASE WHEN expected IS NOT NULL THEN 1 ELSE 0 END AS n_expected, CASE WHEN ok AND got IS NOT NULL THEN 1 ELSE 0 END AS n_accepted, CASE WHEN ok AND is_right THEN 1 ELSE 0 END AS n_accepted_right, CASE WHEN ok AND got IS NOT NULL AND NOT is_right THEN 1 ELSE 0 END AS n_accepted_wrong,
 CASE WHEN ok AND got IS NOT NULL AND expected IS NULL THEN 1 ELSE 0 END AS n_spurious, CASE WHEN (expected IS NOT NULL AND NOT is_right) OR (expected IS NULL AND got IS NOT NULL) THEN 1 ELSE 0 END AS n_wrong_or_missing,
 CASE WHEN ((expected IS NOT NULL AND NOT is_right) OR (expected IS NULL AND got IS NOT NULL)) AND status = 'needs_check' THEN 1 ELSE 0 END AS n_flagged, levenshtein(ref, hyp) AS ch_edit, length(ref) AS ch_ref FROM
 (SELECT *, status IN ('checked', 'accepted') AS ok, expected IS NOT NULL AND got IS NOT NULL AND regexp_replace(lower(expected), '[^0-9a-z]', '', 'g') = regexp_replace(lower(got), '[^0-9a-z]', '', 'g') AS is_right,
 trim(regexp_replace(lower(coalesce(expected, '')), '[^0-9a-z]+', ' ', 'g')) AS ref, trim(regexp_replace(lower(coalesce(got, '')), '[^0-9a-z]+', ' ', 'g')) AS hyp FROM {scored})""")
SUMS = "sum(n_expected)::BIGINT AS n_expected, sum(n_accepted)::BIGINT AS n_accepted, sum(n_accepted_right)::BIGINT AS n_accepted_right, sum(n_accepted_wrong)::BIGINT AS n_accepted_wrong, sum(n_spurious)::BIGINT AS n_spurious, sum(n_wrong_or_missing)::BIGINT AS n_wrong_or_missing, sum(n_flagged)::BIGINT AS n_flagged, sum(ch_edit)::BIGINT AS ch_edit, sum(ch_ref)::BIGINT AS ch_ref"
BOARD = f"SELECT 'overall' AS label, 'all' AS val, {SUMS} FROM {{wanted_counts}} UNION ALL SELECT 'kind', kind, {SUMS} FROM {{wanted_counts}} GROUP BY 2 UNION ALL SELECT 'script', script, {SUMS} FROM {{wanted_counts}} GROUP BY 2"
fixture("wanted_board", BOARD)
WILSON = "round(greatest(0, (n_accepted_right/n_accepted::DOUBLE + 3.8416/(2*n_accepted) - 1.96*sqrt(n_accepted_right/n_accepted::DOUBLE*(1-n_accepted_right/n_accepted::DOUBLE)/n_accepted + 3.8416/(4.0*n_accepted*n_accepted))) / (1+3.8416/n_accepted)), 4)"
COUNTS = ("n_expected", "n_accepted", "n_accepted_right", "n_accepted_wrong", "n_spurious", "n_wrong_or_missing", "n_flagged", "ch_edit", "ch_ref")


@query("SELECT value_id, n_expected, n_accepted, n_accepted_right, n_accepted_wrong, n_spurious, n_wrong_or_missing, n_flagged, ch_edit, ch_ref FROM {wanted_counts}")
def value_tally(t: Tables):
    """Counters and edits of each value."""
    return S.judged(t.scored).select("value_id", *COUNTS)


@query("SELECT * FROM {wanted_board}")
def scoreboard(t: Tables):
    """Sums of the counters overall and by slice."""
    return S.boards(S.judged(t.scored), ["kind", "script"], COUNTS)


@query(f"""SELECT label, val, round(n_accepted_right / n_accepted::DOUBLE, 4) AS precision, {WILSON} AS precision_bound, round(n_accepted_right / n_expected::DOUBLE, 4) AS coverage, round(n_flagged / n_wrong_or_missing::DOUBLE, 4) AS catch_rate, round(ch_edit / ch_ref::DOUBLE, 4) AS raw_cer FROM {{wanted_board}}""")
def score_report(t: Tables):
    """Precision with its lower bound, coverage, catches and error rate of each board."""
    b = S.boards(S.judged(t.scored), ["kind", "script"], S.COUNTERS)
    return S.report(b).select("label", "val", "precision", "precision_bound", "coverage", "catch_rate", "raw_cer")


fixture("wanted_words", r"""SELECT script, list_sum(list_transform(range(1, greatest(len(r), len(h)) + 1), lambda i: CASE WHEN r[i] IS DISTINCT FROM h[i] THEN 1 ELSE 0 END)) AS wd_edit, len(r) AS wd_ref, levenshtein(ref, hyp) AS ch_edit, length(ref) AS ch_ref
 FROM (SELECT *, CASE WHEN ref = '' THEN [] ELSE string_split(ref, ' ') END AS r, CASE WHEN hyp = '' THEN [] ELSE string_split(hyp, ' ') END AS h FROM {wanted_counts} WHERE expected IS NOT NULL OR got IS NOT NULL)""")


@query("SELECT script, round(sum(ch_edit) / sum(ch_ref)::DOUBLE, 6) AS cer, round(sum(wd_edit) / sum(wd_ref)::DOUBLE, 6) AS wer FROM {wanted_words} GROUP BY 1")
def cer_wer(t: Tables):
    """Edits over reference length, in letters and in words, of all values."""
    j = S.judged(t.scored).groupBy("script").agg(*[F.sum(c).alias(c) for c in S.EDITS])
    return j.select("script", F.round(F.col("ch_edit") / F.col("ch_ref"), 6).alias("cer"), F.round(F.col("wd_edit") / F.col("wd_ref"), 6).alias("wer"))


LIMITS = {"min_documents": 300, "min_precision_bound": 0.99, "min_coverage": 0.6, "max_accepted_cer": 0.01, "max_accepted_wer": 0.01, "min_accepted_chars": 5000, "min_slice_accepted": 40, "min_slice_bound": 0.5}


@query(f"""SELECT 'overall' AS label, 'all' AS val, reason FROM (SELECT 'too few documents' AS reason WHERE (SELECT count(DISTINCT document_id) FROM {{scored}}) < 300 UNION ALL SELECT 'precision' FROM {{wanted_board}} WHERE label = 'overall' AND {WILSON} < 0.99
 UNION ALL SELECT 'coverage' FROM {{wanted_board}} WHERE label = 'overall' AND n_accepted_right / n_expected::DOUBLE < 0.6) UNION ALL SELECT label, val, 'slice precision' FROM {{wanted_board}} WHERE label <> 'overall' AND n_accepted >= 40 AND {WILSON} < 0.5""")
def release_gate(t: Tables):
    """The reasons that block a release (those of precision, coverage and size)."""
    j = S.judged(t.scored)
    b = S.report(S.boards(j, ["kind", "script"], S.COUNTERS)).crossJoin(F.broadcast(j.agg(F.count_distinct("document_id").alias("documents"))))  # one row
    return S.gate(b, LIMITS).where(~F.col("reason").isin("character errors", "word errors", "too few characters"))


fixture("wanted_halves", f"""SELECT a.label, a.val, a.b AS champion_bound, c.b AS candidate_bound, a.n_accepted AS champion_n, c.n_accepted AS candidate_n FROM (SELECT *, {WILSON} AS b FROM (SELECT 'overall' AS label, 'all' AS val, {SUMS} FROM {{wanted_counts}} WHERE value_id % 2 = 0 UNION ALL SELECT 'kind', kind, {SUMS} FROM {{wanted_counts}} WHERE value_id % 2 = 0 GROUP BY 2)) a
 JOIN (SELECT *, {WILSON} AS b FROM (SELECT 'overall' AS label, 'all' AS val, {SUMS} FROM {{wanted_counts}} WHERE value_id % 2 = 1 UNION ALL SELECT 'kind', kind, {SUMS} FROM {{wanted_counts}} WHERE value_id % 2 = 1 GROUP BY 2)) c ON a.label = c.label AND a.val = c.val""")
RULES = {"min_slice_accepted": 20, "max_slice_drop": 0.02, "min_accepted": 100}


def _compared(t: Tables):
    board = lambda k: S.report(S.boards(S.judged(t.scored.where(F.col("value_id") % 2 == k)), ["kind"], S.COUNTERS))  # noqa: E731  (two models' results)
    return S.contest(board(0), board(1), RULES)


@query("""SELECT label, val, champion_bound, candidate_bound, CASE WHEN candidate_bound > champion_bound + 1e-9 THEN 'win' WHEN abs(candidate_bound - champion_bound) <= 1e-9 THEN 'tie' ELSE 'loss' END AS verdict,
 CASE WHEN label = 'overall' THEN candidate_bound < champion_bound ELSE candidate_n >= 20 AND champion_bound - candidate_bound > 0.02 END AS drops FROM {wanted_halves}""")
def contest(t: Tables):
    """Champion and candidate slice by slice."""
    return _compared(t).select("label", "val", "champion_bound", "candidate_bound", "verdict", "drops")


@query("""SELECT count(*) FILTER (WHERE label <> 'overall' AND candidate_bound > champion_bound + 1e-9) AS wins, count(*) FILTER (WHERE label <> 'overall' AND abs(candidate_bound - champion_bound) <= 1e-9) AS ties, count(*) FILTER (WHERE label <> 'overall' AND candidate_bound < champion_bound - 1e-9) AS losses,
 CASE WHEN bool_or(CASE WHEN label = 'overall' THEN candidate_bound < champion_bound ELSE candidate_n >= 20 AND champion_bound - candidate_bound > 0.02 END) THEN 'keep champion' WHEN bool_or(label = 'overall' AND least(candidate_n, champion_n) < 100) THEN 'need more data' ELSE 'promote' END AS verdict FROM {wanted_halves}""")
def contest_verdict(t: Tables):
    """Wins, ties, losses and the verdict."""
    return S.decision(_compared(t), RULES)


fixture("test_lists", """SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS e FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1""")


@query("""SELECT c.o_custkey, len(e) AS expected, len(f) AS found, len(list_intersect(e, f)) AS hit, len(e) - len(list_intersect(e, f)) AS missed, len(f) - len(list_intersect(e, f)) AS extra, len(a) - len(list_intersect(a, e)) AS extra_accepted FROM (SELECT DISTINCT o_custkey FROM orders) c
 JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F') AS e0, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'F'), []) AS e, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O'), []) AS f, coalesce(list(DISTINCT o_orderpriority) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0), []) AS a FROM orders GROUP BY 1) l USING (o_custkey)""")
def list_prf(t: Tables):
    """Expected and found names as sets by letters and digits."""
    pick = lambda c: F.collect_list(F.when(c, F.concat(F.lit(" "), F.lower("o_orderpriority"))))
    g = t.orders.groupBy("o_custkey").agg(pick(F.col("o_orderstatus") == "F").alias("e"), pick(F.col("o_orderstatus") == "O").alias("f"), pick((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0)).alias("a"))
    return g.select("o_custkey", *S.list_scores(F.col("e"), F.col("f"), F.col("a")))


def listed(c: str):
    return F.filter(F.split(c, r"\|"), lambda x: x != "")


cases("list_edits", "J19, A19: expected names paired one to one with read ones.", "e STRING, f STRING", "ch_edit BIGINT, ch_ref BIGINT, wd_edit BIGINT, wd_ref BIGINT", [
    ("hba1c|fbs|ppbs", "hba1c|fps|fructosamine", 17, 12, 3, 3), ("tsh", "", 3, 3, 1, 1), ("", "asha", 4, 0, 1, 0), ("s lipase", "s lipase", 0, 8, 0, 2), ("", "", 0, 0, 0, 0), ("cbc|cbc", "cbc", 3, 6, 1, 2),
], lambda d: d.select("id", L.over(S.paired_edits, "ch_edit long, ch_ref long, wd_edit long, wd_ref long")(listed("e"), listed("f")).alias("v")).select("id", "v.*"))

cases("misfiled", "A18: tests filed elsewhere and others filed as tests.", "o STRING, t STRING, x STRING, n STRING", "expected_tests BIGINT, filed_elsewhere BIGINT, filed_as_test BIGINT", [
    ("TSH|CBC", "CBC|Pan 40", "tsh", "Pan-40", 2, 1, 1), ("TSH", "TSH", "TSH", "", 1, 0, 0), ("", "Dolo", "", "dolo", 0, 0, 1), ("FBS|F.B.S", "", "fbs", "", 1, 1, 0),
], lambda d: d.select("id", *S.misfiled(listed("o"), listed("t"), listed("x"), listed("n"))))

cases("same_values", "Z45: equal as numbers, else by letters and digits.", "a STRING, b STRING", "same BOOLEAN", [("2", "2.0", True), ("2", "3", False), ("S. Lipase", "s lipase", True), ("2", "two", False), (None, "", True), (None, "x", False), ("1e1", "10", True)], lambda d: d.select("id", S.same_value(F.col("a"), F.col("b")).alias("same")))


@query("""SELECT role, count(*) FILTER (WHERE a = b) AS accepted, count(*) FILTER (WHERE a <> b) AS review, count(*) FILTER (WHERE a = b AND a = x) AS accepted_right, count(*) FILTER (WHERE a <> b AND a <> x) AS caught, count(*) FILTER (WHERE a <> x) AS wrong FROM
 (SELECT role, conv_id % 10 AS x, CASE WHEN conv_id % 5 = 0 THEN -1 ELSE conv_id % 10 END AS a, CASE WHEN conv_id % 7 = 0 THEN -2 WHEN conv_id % 15 = 0 THEN -1 ELSE conv_id % 10 END AS b FROM conversations) GROUP BY 1""")
def caught_by_disagreement(t: Tables):
    """What two readers accept together, and which errors their disagreement catches."""
    k = F.col("conv_id")
    c = t.conversations.select("role", (k % 10).alias("x"), F.when(k % 5 == 0, -1).otherwise(k % 10).alias("a"), F.when(k % 7 == 0, -2).when(k % 15 == 0, -1).otherwise(k % 10).alias("b"))
    return c.groupBy("role").agg(*S.disagreement(c, "x", "a", "b", lambda x, y: x == y))


@query("""SELECT reason, count(*) AS n FROM (SELECT unnest([CASE WHEN n_chars > 4000 THEN 'long' END, CASE WHEN lang <> 'en' THEN 'foreign' END, CASE WHEN source IS NULL THEN 'no source' END, CASE WHEN text LIKE '%@%' THEN 'address' END]) AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1""")
def reason_histogram(t: Tables):
    """Reasons of each document, flattened and counted."""
    d = F.col("n_chars")
    reasons = F.array_compact(F.array(F.when(d > 4000, "long"), F.when(F.col("lang") != "en", "foreign"), F.when(F.col("source").isNull(), "no source"), F.when(F.col("text").contains("@"), "address")))
    return t.documents.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT fact_id % 50 AS doc, CAST(count(*) FILTER (WHERE state = 'disagree') AS DOUBLE) / nullif(count(*) FILTER (WHERE state IN ('agree', 'disagree', 'single_engine', 'no_reading')), 0) AS rate, string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM {fact_lines} WHERE line_no < 2 GROUP BY 1""")
def disagreement_rate(t: Tables):
    """States of a document's lines; the share of disagreements among handwritten ones, null without any."""
    s = F.col("state")
    rate = F.try_divide(F.count_if(s == "disagree"), F.count_if(s.isin("agree", "disagree", "single_engine", "no_reading")))
    return t.fact_lines.where("line_no < 2").groupBy((F.col("fact_id") % 50).alias("doc")).agg(rate.alias("rate"), F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"))


@query(r"""SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]', '', 'g') AS alnum, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+', ' ', 'g')) AS spaced FROM documents""")
def normalise_text(t: Tables):
    """F1-F3 on whole texts."""
    c = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", X.key_alnum(c).alias("alnum"), X.words_only(c).alias("spaced"))
