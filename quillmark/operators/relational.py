"""Relational operators: latest rows, supersession, upserts, conflicts, components, greedy groups (J*, W*, K*, G*, U*)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

def contains_text(c: Column, part: str) -> Column:
    """Whether a text contains another whatever the case; marks that patterns use are taken as they are."""
    return F.coalesce(F.contains(F.lower(c), F.lit(part.lower())), F.lit(False))


def licensed_only(df: DataFrame, system: str, codes: list[str], status: str, licensed: list[str]) -> DataFrame:
    """Codes of a system without a licence are masked and their status is local_only."""
    fine = F.coalesce(F.upper(system).isin(*licensed), F.lit(False))
    return df.withColumns({c: F.when(fine, F.col(c)) for c in codes} | {status: F.when(fine, F.col(status)).otherwise("local_only")})


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("rn_ = 1").drop("rn_")


def first_wins(parts: list[DataFrame], key: str) -> DataFrame:
    """U4: the union of parts, of each key the row of the first part that has it (of several there, the least)."""
    ranked = [p.select(key, F.struct(F.lit(i).alias("i_"), *[c for c in p.columns if c != key]).alias("r_")) for i, p in enumerate(parts)]
    out = ranked[0]
    for p in ranked[1:]:
        out = out.unionByName(p)
    return out.groupBy(key).agg(F.min("r_").alias("r_")).select(key, *[F.col(f"r_.{c}").alias(c) for c in parts[0].columns if c != key])


def current(df: DataFrame, key: str, supersedes: str) -> DataFrame:
    """Rows that no other row lists as superseded."""
    gone = df.select(F.explode(supersedes).alias("gone_")).distinct()
    return df.join(gone, F.col(key) == F.col("gone_"), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: bool = False) -> DataFrame:
    """K2, K3: new values over old ones; with preserve, a null in new keeps the old value."""
    values = [c for c in old.columns if c not in keys]
    o = old.select(*keys, F.struct(*values).alias("o_"))
    n = new.select(*keys, F.struct(*values).alias("n_"))
    pick = lambda c: F.coalesce(F.col(f"n_.{c}"), F.col(f"o_.{c}")) if preserve else F.when(F.col("n_").isNotNull(), F.col(f"n_.{c}")).otherwise(F.col(f"o_.{c}"))
    return o.join(n, keys, "full_outer").select(*keys, *[pick(c).alias(c) for c in values])


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """K5: rows of new whose key old doesn't have, one for each key."""
    return old.unionByName(new.dropDuplicates(keys).join(old, keys, "left_anti"))


def cut(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder that spark.checkpoint.dir names (a local master may do without the setting)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        own = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not own and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(own or f"file:///tmp/checkpoints/{sc.applicationId}")
    return df.checkpoint()


def components(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """G1: (node, label): the smallest node reachable from each node of links (a, b), by label joins with pointer jumping.

    Goes on until no label changes; rounds grow with the logarithm of a component's diameter.  nodes (one column): all
    of them get a row, those without a link their own label."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).dropna().distinct())
    labels = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.select(F.col("node").alias("at"), F.col("label").alias("jump"))
        nxt = cut(labels.withColumnRenamed("label", "was").join(near, "node").withColumn("at", F.least("was", "near")).join(hop, "at").select("node", "was", F.least("at", "jump").alias("label")))
        labels = nxt.select("node", "label")
        if not nxt.where("was <> label").limit(1).count():
            break
    if nodes is None:
        return labels
    own = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    return own.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def greedy_groups(df: DataFrame, key: str, text: str, order: list[str], threshold: float, similarity) -> DataFrame:
    """Within a key, rows in order join the first group whose head is alike enough, else open one.

    Adds group_no (from 0) and head.  Order-dependent, so the order must be total.  One key is one task: keys are
    phones or documents, which have few rows."""
    schema = StructType([*df.schema.fields, StructField("group_no", IntegerType()), StructField("head", StringType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        heads: list[str] = []
        no, head = [], []
        for t in table.column(text).to_pylist():
            k = next((i for i, h in enumerate(heads) if (similarity(h, t or "") >= threshold if h and t else (h or "") == (t or ""))), len(heads))
            if k == len(heads):
                heads.append(t or "")
            no.append(k)
            head.append(heads[k])
        return table.append_column("group_no", pa.array(no, pa.int32())).append_column("head", pa.array(head, pa.string()))

    return df.groupBy(key).applyInArrow(run, schema)


def greedy_pairs(df: DataFrame, key: str, expected: str, found: str, similarity, threshold: float = 0.5) -> DataFrame:
    """One-to-one pairs of two lists of strings in each row, most alike first (ties: earlier items): key, a, b, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, xs, ys in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                ranked = sorted(((-similarity(x, y), i, j) for i, x in enumerate(xs or []) for j, y in enumerate(ys or [])))
                a, b = set(), set()
                for s, i, j in ranked:
                    if -s >= threshold and i not in a and j not in b:
                        a.add(i)
                        b.add(j)
                        out.append((str(k), xs[i], ys[j], -s))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], ["key", "a", "b", "score"])

    return df.select(key, expected, found).mapInArrow(run, "key string, a string, b string, score double")
