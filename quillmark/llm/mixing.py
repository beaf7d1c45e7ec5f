"""Mixing sources to target weights: budgets down a domain - language - source tree, then token prefixes of seeded epochs.

A node's budget is its parent's, in proportion to weights.  A leaf can give at most `max_epochs` times its tokens; what
it can't is shared among its siblings first and goes up to the ancestor's siblings only when all of them are full.
Leaves take whole epochs and a prefix of the next: documents in the order of a seeded hash until the budget is met.
The prefix is found in two steps, hash ranges first and documents of one range after, so no leaf is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm import kernels as K

LEVELS = ("domain", "lang", "source")
RANGES = 4096
#: The tree is small: its leaves are kinds of sources, and more than this many are refused.
MAX_LEAVES = 1_000_000
#: A plan of more rows (about 100 bytes each) is not broadcast.
BROADCAST_ROWS = 50_000


def waterfill(budget: float, nodes: list[tuple[float, float]]) -> list[float]:
    """Shares of budget for (weight, capacity) siblings: in proportion to weights, what is over capacity goes to the others."""
    out, left = [0.0] * len(nodes), budget
    # Those that fill up first at a rising level of budget for each unit of weight.
    open_ = sorted((c / w, i) for i, (w, c) in enumerate(nodes) if w > 0 and c > 0)
    total = sum(nodes[i][0] for _, i in open_)
    for k, (level, i) in enumerate(open_):
        w, c = nodes[i]
        if left <= 0 or left < level * total:
            for _, j in open_[k:]:
                out[j] = max(0.0, left) * nodes[j][0] / total
            break
        out[i] = c
        left -= c
        total -= w
    return out


def allocate(leaves: dict[tuple, int], budget: float, weight: Callable[[tuple], float], max_epochs: float) -> dict[tuple, float]:
    """Token budget of each leaf.  weight(path) of a node among its siblings; a node can take what its leaves can."""

    below: dict[tuple, list[tuple]] = {}
    capacity: dict[tuple, float] = {p: n * max_epochs for p, n in leaves.items()}
    level = sorted(leaves, key=str)
    for depth in reversed(range(len(LEVELS))):  # one pass bottom-up: children and what they can take
        for p in level:
            below.setdefault(p[:depth], []).append(p)
            capacity[p[:depth]] = capacity.get(p[:depth], 0.0) + (capacity[p] if weight(p) > 0 else 0.0)
        level = list(dict.fromkeys(p[:depth] for p in level))
    out: dict[tuple, float] = {(): min(budget, capacity.get((), 0.0))}
    for _ in LEVELS:  # and one top-down: what each is given
        given = {}
        for at, share in out.items():
            own = below.get(at, [])
            given |= zip(own, waterfill(share, [(weight(p), capacity[p]) for p in own]), strict=True)
        out = given
    return out


def token_column(text: str) -> Column:
    """White-space words of a text, null as none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str) -> Column:
    """The family of a source: its name without the last digit."""
    return F.regexp_replace(F.coalesce(F.col(source), F.lit("")), "[0-9]$", "")


def mix(docs: DataFrame, budget: float | None = None, share: float = 0.5, weights: dict[tuple, float] | None = None, max_epochs: int = 2, seed: int = 17, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Documents that the mixture takes: doc_id, domain, lang, source, n_tokens, epoch (from 0; a row for each epoch).

    budget: tokens wanted; default: share of all.  weights: by path, such as ("src", "en"); default 1.  Documents
    without words are never taken.  The document that crosses a leaf's budget is taken whole, so a leaf's tokens reach
    its budget and pass it by less than that document.  Null lang and source are leaves of their own, named ''.
    Equal hashes: smaller doc_id first; repeated rows count each.  Other columns are ignored.
    """
    weights = weights or {}
    names = dict(zip(LEVELS, (domain_of(source), F.coalesce(F.col(lang), F.lit("")), F.coalesce(F.col(source), F.lit(""))), strict=True))
    base = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(k) for k, c in names.items()], token_column(text).alias("n_tokens"))
    base = K.stored(base, "mix-tokens").where("n_tokens > 0")
    spread = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(64)).cast("int")
    totals = base.groupBy(*LEVELS, spread.alias("salt")).agg(F.sum("n_tokens").alias("n")).groupBy(*LEVELS).agg(F.sum("n").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(totals) > MAX_LEAVES:
        raise ValueError("too many leaves")
    leaves = {tuple(r[k] for k in LEVELS): r.n for r in totals}
    wanted = share * sum(leaves.values()) if budget is None else budget
    given = allocate(leaves, wanted, lambda p: weights.get(p, 1.0), max_epochs)
    rows = []
    for path, tokens in given.items():
        for e in range(max_epochs):
            part = min(leaves[path], tokens - e * leaves[path])
            if part > 0:
                rows.append((*path, e, float(part)))
    spark = docs.sparkSession
    plan = spark.createDataFrame(rows, "domain string, lang string, source string, epoch int, want double").coalesce(1) if rows else spark.createDataFrame([], "domain string, lang string, source string, epoch int, want double")
    # A small plan is broadcast, a larger one is joined: a hot leaf is dealt by the documents' hash as well.
    if len(rows) <= BROADCAST_ROWS:
        own = base.join(F.broadcast(plan), list(LEVELS))
    else:
        salts = F.explode(F.expr("sequence(0, 63)"))
        own = base.withColumn("salt", spread).join(plan.withColumn("salt", salts).hint("merge"), [*LEVELS, "salt"]).drop("salt")
    own = own.withColumn("h", F.xxhash64("doc_id", F.lit(seed), "epoch"))
    own = own.withColumn("range", F.pmod(F.shiftright("h", 52), F.lit(RANGES)))
    keys = [*LEVELS, "epoch"]
    ranges = own.groupBy(*keys, "range").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = own.join(ranges.select(*keys, "range", "before", F.col("n").alias("in_range")), [*keys, "range"]).where("before < want")
    inside = Window.partitionBy(*keys, "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = placed.where("before + in_range > want").withColumn("at", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("at < want")
    out = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    return placed.where("before + in_range <= want").select(out).unionByName(cut.select(out))
