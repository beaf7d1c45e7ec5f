"""Record linkage: identities, doctors, alias candidates, blocked fuzzy matches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from quillmark.functions import linkage as L
from quillmark.functions import text as X
from quillmark.functions.similarity import ratio_udf

#: Masters of doctors are a dimension; more rows than this are refused, as each reading is scored against all.
MAX_MASTERS = 200_000
ROW_CAP_TEXT = "a dimension of at most {0:,} rows is matched against; this one has {1:,}"


def cascade(rows: DataFrame, steps: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Adds matched and how: the first step whose key hits.  A step: (name, table, key column of both, id column).

    Of several rows with one key the smallest id counts; a null key never hits."""
    out = rows
    for name, table, key, ident in steps:
        own = table.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(key)).agg(F.min(ident).alias(f"by_{name}_"))
        out = out.join(own, key, "left")
    hits = [F.col(f"by_{n}_") for n, *_ in steps]
    how = F.lit("new")
    for n, *_ in reversed(steps):
        how = F.when(F.col(f"by_{n}_").isNotNull(), n).otherwise(how)
    return out.select(*rows.columns, F.coalesce(*hits).alias("matched"), how.alias("how"))


def blocks_of(key: str) -> Column:
    """Blocks of a name's key: its words of two letters and more, and its first and last three letters."""
    words = F.filter(F.split(key, " "), lambda w: F.length(w) > 1)
    return F.array_distinct(F.concat(words, F.array(F.concat(F.lit("^"), F.substring(key, 1, 3)), F.concat(F.lit("$"), F.right(F.col(key), F.lit(3))))))


def resolve_identity(candidates: DataFrame, known: DataFrame, least: float = 0.9) -> DataFrame:
    """Candidates (cand_id, health_id, key_, born_year) -> cand_id, matched, how, score.

    The health id decides; else the most alike name of known (person_id, health_id, key_, born_year), less .3 if both
    birth years are known and differ by more than one; ties go to the smallest id.  Names are compared in blocks: a word
    in common, or the first or last three letters; the ratio's bounds by length and letters prune before the UDF."""
    block = lambda df: df.withColumn("block_", F.explode(blocks_of("key_")))
    by_id = known.where("health_id is not null").groupBy("health_id").agg(F.min("person_id").alias("by_id_"))
    c = candidates.join(by_id, "health_id", "left")
    open_ = block(c.where("by_id_ is null and key_ <> ''").select("cand_id", "key_", "born_year"))
    k = block(known.where("key_ <> ''").select("person_id", F.col("key_"), F.col("born_year").alias("known_year"))).withColumnRenamed("key_", "known_key")
    pairs = open_.join(k, "block_").drop("block_").where((L.bounds(F.col("key_"), F.col("known_key")) >= least) & (L.letter_bound(F.col("key_"), F.col("known_key")) >= least)).distinct()
    apart = F.col("born_year").isNotNull() & F.col("known_year").isNotNull() & (F.abs(F.col("born_year") - F.col("known_year")) > 1)
    scored = pairs.withColumn("score", ratio_udf("key_", "known_key") - F.when(apart, 0.3).otherwise(0.0)).where(F.col("score") >= least)
    best = scored.groupBy("cand_id").agg(F.max_by(F.struct("person_id", "score"), F.struct("score", -F.col("person_id"))).alias("b"))
    out = c.join(best, "cand_id", "left")
    how = F.when(F.col("by_id_").isNotNull(), "health_id").when(F.col("b").isNotNull(), "name").otherwise("new")
    return out.select("cand_id", F.coalesce("by_id_", "b.person_id").alias("matched"), how.alias("how"), F.when(how == "health_id", 1.0).otherwise(F.col("b.score")).alias("score"))


def merged_identity(rows: DataFrame, by: str, name: str, key: str, sex: str) -> DataFrame:
    """Of each person the most frequent name (longest, then greatest of several) and sex, and how sure: .5 + .25 (share of
    names with the same key + share of the same sex), at most .99."""

    def mode(c: str) -> DataFrame:
        n = rows.where(F.col(c).isNotNull()).groupBy(by, c).agg(F.count("*").alias("n"))
        return n.groupBy(by).agg(F.max_by(c, F.struct("n", F.length(c), c)).alias(f"{c}_mode"))

    own = rows.join(mode(name), by, "left").join(mode(sex), by, "left")
    keys = rows.where(F.col(name).isNotNull()).groupBy(by, name).agg(F.min(key).alias("mode_key")).withColumnRenamed(name, f"{name}_mode")
    own = own.join(keys, [by, f"{name}_mode"], "left")
    share = lambda hit, has: F.coalesce(F.try_divide(F.count_if(hit), F.count(has)), F.lit(0.0))
    sure = 0.5 + 0.25 * (share(F.col(name).isNotNull() & (F.col(key) == F.col("mode_key")), F.col(name)) + share(F.col(sex) == F.col(f"{sex}_mode"), F.col(sex)))
    return own.groupBy(by, F.col(f"{name}_mode").alias(name), F.col(f"{sex}_mode").alias(sex)).agg(F.round(F.least(F.lit(0.99), sure), 3).alias("confidence"))


def match_doctors(readings: DataFrame, masters: DataFrame, link: float = 0.9) -> DataFrame:
    """Readings (doc_id, name, reg, header) against masters (id, reg, name, aliases, words) -> doc_id, practitioner_id, method, confidence, linked.

    A registration number beats a name; words of the specialty in the header raise a name's score; the two best nearly tied,
    or an initial that fits several, are not linked.  Masters go to every task: they are a dimension of checked size."""
    n = masters.count()
    if n > MAX_MASTERS:
        raise ValueError(ROW_CAP_TEXT.format(MAX_MASTERS, n))
    rows = masters.select("id", F.upper(F.regexp_replace(F.coalesce("reg", F.lit("")), "[^0-9A-Za-z]", "")).alias("reg"), "name", F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), X.doctor_key).alias("keys"), F.transform(F.coalesce("words", F.array().cast("array<string>")), X.fold).alias("words")).orderBy("id").collect()
    known = readings.sparkSession.sparkContext.broadcast([r.asDict() for r in rows])
    own = readings.select("doc_id", X.doctor_key(F.col("name")).alias("key_"), F.concat(F.when(F.length("reg") > 0, F.array(F.upper(F.regexp_replace("reg", "[^0-9A-Za-z]", "")))).otherwise(F.array().cast("array<string>")), X.registration_numbers(F.col("header"))).alias("regs"), X.fold(F.coalesce("header", F.lit(""))).alias("head"), (F.length(F.coalesce("name", F.lit(""))) > 0).alias("named"))
    heads = own.withColumn("head_key", X.doctor_key(F.col("head")))

    def one(key, regs, head, head_key, named):
        scored = []
        for m in known.value:
            names = max((L.doctor_score(key if named else head_key, k) for k in m["keys"]), default=0.0) * (1.0 if named else 0.95)
            if m["reg"] and m["reg"] in regs:
                scored.append((0.99 if names >= 0.75 or not named else 0.9, "registration_no", m))
            else:
                scored.append((round(names * (1.0 if any(w and w in head for w in m["words"]) else 0.97), 4), "printed_name", m))
        scored.sort(key=lambda x: -x[0])
        if not scored or scored[0][0] < 0.5:
            return None, "unknown", 0.0, False
        sure, method, m = scored[0]
        if method == "printed_name":
            words = key.split()
            fits = sum(len(o) > 1 and o[0].startswith(words[0]) and L.jaro_winkler(o[-1], words[-1]) >= 0.92 for o in (x["keys"][0].split() for x in known.value)) if named and len(words) > 1 and len(words[0]) == 1 else 0
            if fits > 1 or (len(scored) > 1 and sure - scored[1][0] < 0.03):
                sure = min(sure, link - 0.01)
        return (m["id"] if sure >= link else None), method, round(sure, 4), sure >= link

    def run(frames):
        for f in frames:
            cache: dict = {}
            out = []
            for r in f.itertuples(index=False):
                args = (r.key_ or "", tuple(r.regs), r.head, r.head_key or "", r.named)
                if args not in cache:
                    cache[args] = one(*args)
                out.append((r.doc_id, *cache[args]))
            yield pd.DataFrame(out, columns=["doc_id", "practitioner_id", "method", "confidence", "linked"]).astype({"practitioner_id": "Int64"})

    return heads.mapInPandas(run, "doc_id long, practitioner_id long, method string, confidence double, linked boolean")


def alias_candidates(readings: DataFrame, aliases: DataFrame, least: float = 0.82, limit: int = 5) -> DataFrame:
    """Readings (reading_id, reading, domain, doctor) against aliases (concept, alias, domain, alias_class, doctor) -> the best
    of each concept, the first five, ranked, with level, score and whether the first ones collide.

    Level 1 is the alias as written, 2 its key, 3 (only if no other hits) a like key with the same numbers, or one that the
    reading begins with.  Class C is one doctor's own.  Level 3 compares readings and aliases that share a word or the first
    letters; the ratio's bounds prune before the UDF."""
    r = readings.select("reading_id", "domain", F.col("doctor").alias("own_doctor"), X.fold(F.trim("reading")).alias("raw_"), X.alias_key(F.col("reading")).alias("rkey_"), X.numbers_repaired(X.alias_key(F.col("reading"))).alias("rnums_")).where("raw_ <> ''")
    a = aliases.select("concept", "alias", "domain", "alias_class", F.col("doctor").alias("alias_doctor"), X.fold(F.col("alias")).alias("araw_"), X.alias_key(F.col("alias")).alias("akey_"))
    a = a.withColumn("anums_", X.numbers_repaired(F.col("akey_")))
    mine = (F.col("alias_class") != "C") | F.coalesce(F.col("own_doctor") == F.col("alias_doctor"), F.lit(False))
    one = r.join(a.withColumn("raw_", F.col("araw_")), ["domain", "raw_"]).where(mine).withColumns({"level": F.lit(1), "score": F.lit(1.0)})
    two = r.join(a.withColumn("rkey_", F.col("akey_")), ["domain", "rkey_"]).where(mine & (F.col("araw_") != F.col("raw_"))).withColumns({"level": F.lit(2), "score": F.lit(0.97)})
    cols = ["reading_id", "concept", "alias", "alias_class", "level", "score"]
    exact = one.select(cols).unionByName(two.select(cols))
    rest = r.join(exact.select("reading_id").distinct(), "reading_id", "left_anti")
    block = lambda df, key: df.withColumn("block_", F.explode(F.array_distinct(F.concat(F.split(key, " "), F.array(F.concat(F.lit("^"), F.substring(key, 1, 2)))))))
    j = block(rest, "rkey_").join(block(a.where("akey_ <> ''"), "akey_"), ["domain", "block_"]).where(mine).drop("block_").distinct()
    j = j.where((F.size("anums_") == 0) | (F.col("anums_") == F.col("rnums_")))
    begins = F.col("rkey_").startswith(F.concat(F.col("akey_"), F.lit(" ")))
    near = (L.bounds(F.col("rkey_"), F.col("akey_")) >= least) & (L.letter_bound(F.col("rkey_"), F.col("akey_")) >= least)
    j = j.withColumn("sim", F.greatest(F.when(near, ratio_udf("rkey_", "akey_")).otherwise(0.0), F.when(begins, 0.9).otherwise(0.0))).where(F.col("sim") >= least)
    three = j.withColumns({"level": F.lit(3), "score": F.col("sim") * 0.95}).select(cols)
    found = exact.unionByName(three).withColumn("score", F.round("score", 4)).withColumn("class_rank", F.when(F.col("alias_class") == "C", 3).when(F.col("alias_class") == "A", 2).otherwise(1))
    w = Window.partitionBy("reading_id", "concept").orderBy(F.desc("score"), F.desc("class_rank"), "level", "alias")
    best = found.withColumn("n_", F.row_number().over(w)).where("n_ = 1")
    ranked = best.withColumn("rank_no", F.row_number().over(Window.partitionBy("reading_id").orderBy(F.desc("score"), F.desc("class_rank"), "concept"))).where(F.col("rank_no") <= limit)
    top = Window.partitionBy("reading_id")
    close = F.max("score").over(top) - F.col("score") <= 0.03 + 1e-9
    return ranked.withColumn("close_", close).select("reading_id", F.col("rank_no").cast("long").alias("rank_no"), "concept", "alias", F.col("level").cast("long").alias("level"), "score", (F.col("close_") & (F.count_if(F.col("close_")).over(top) > 1)).alias("collision"))


def context_groups(texts: DataFrame, key: str, text: str, groups: DataFrame) -> DataFrame:
    """(key, groups): codes of the indication groups (code, keywords) of which a whole phrase stands in the texts."""
    blob = texts.groupBy(key).agg(F.concat(F.lit(" "), F.regexp_replace(X.fold(F.array_join(F.array_sort(F.collect_list(text)), " ")), "[^a-z0-9 ]", " "), F.lit(" ")).alias("blob_"))
    words = groups.select("code", F.explode("keywords").alias("k")).select("code", F.concat(F.lit(" "), F.trim(F.regexp_replace(X.fold(F.col("k")), "[^a-z0-9 ]", " ")), F.lit(" ")).alias("k")).where("trim(k) <> ''")
    rows = {c: [r.k for r in g] for c, g in _by_code(words).items()}
    hits = [F.when(F.exists(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("blob_").contains(k)), F.lit(c)) for c, ks in sorted(rows.items())]
    return blob.select(key, F.array_compact(F.array(*hits)).alias("groups") if hits else F.array().cast("array<string>").alias("groups"))


def _by_code(words: DataFrame, most: int = 10_000) -> dict:
    """Keywords are a dictionary of the knowledge base: their number is checked before they go into a plan."""
    rows = words.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(ROW_CAP_TEXT.format(most, len(rows)))
    out: dict = {}
    for r in rows:
        out.setdefault(r.code, []).append(r)
    return out


def plausibility(indications: Column, context: Column, generic: tuple[str, ...] = ("pain_fever", "gi_acid")) -> Column:
    """Fits, mismatch or unknown, of a drug's indications and a document's groups."""
    some = (F.size(F.coalesce(indications, F.array().cast("array<string>"))) > 0) & (F.size(context) > 0)
    fits = F.arrays_overlap(indications, context) | F.arrays_overlap(indications, F.array(*[F.lit(g) for g in generic]))
    return F.when(~some, "unknown").when(fits, "fits").otherwise("mismatch")


def rerank(candidates: DataFrame, by: str, status: str, score: str, tie: str) -> DataFrame:
    """Adds place: plausible candidates first, then unknown, then mismatches; by score within."""
    band = F.when(F.col(status) == "fits", 0).when(F.col(status) == "unknown", 1).otherwise(2)
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(band, F.desc(score), tie)).cast("long"))


def only_one(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of each key the value, if all rows agree on one."""
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min(value).alias(value), F.count_distinct(value).alias("n_")).where("n_ = 1").drop("n_")


def edit_pairs(words: DataFrame, word: str, same_length: bool = False) -> DataFrame:
    """M5: pairs (a, b) of different words at most one edit apart, and in how many rows each stands (n_a, n_b).

    Words that differ in one place are equal but for it: they meet at that place and the rest of the word, so a group has one
    word for each character there, and each pair is found once.  Places where all words of a length have the same character
    part none and are left out.  Unless same_length is set, words also meet those that they are with one letter left out.
    Nothing but the places of each length is broadcast: the exploded keys look small to the planner and are not."""
    own = words.select(F.col(word).alias("w")).where("w is not null").groupBy("w").agg(F.count("*").alias("n"))
    chars = own.where("w <> ''").selectExpr("length(w) AS len", "w", "explode(sequence(1, length(w))) AS i").selectExpr("len", "i", "ascii(substring(w, i, 1)) AS c")
    places = chars.groupBy("len", "i").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").groupBy("len").agg(F.collect_list("i").alias("places"))
    at = own.join(F.broadcast(places), F.length("w") == F.col("len")).select("w", "n", F.explode("places").alias("i"))
    at = at.selectExpr("i", "concat(substring(w, 1, i - 1), substring(w, i + 1)) AS rest", "struct(substring(w, i, 1) AS c, n) AS x")
    met = at.groupBy("i", "rest").agg(F.collect_list("x").alias("xs")).where("size(xs) > 1").select("i", "rest", "xs", F.explode("xs").alias("x"))
    met = met.select("i", "rest", "x", F.explode(F.filter("xs", lambda y: y.c > F.col("x.c"))).alias("y"))
    whole = lambda c: f"concat(substring(rest, 1, i - 1), {c}, substring(rest, i))"
    pairs = met.selectExpr(f"{whole('x.c')} AS a", f"{whole('y.c')} AS b", "x.n AS n_a", "y.n AS n_b")
    if same_length:
        return pairs
    out = F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.concat(F.substring(F.col("w"), F.lit(1), i - 1), F.substring(F.col("w"), i + 1, F.length("w"))))
    shorter = own.where("w <> ''").select(F.col("w").alias("long"), F.col("n").alias("n_long"), F.explode(F.array_distinct(out)).alias("w"))
    both = own.hint("merge").join(shorter, "w").select(F.struct("w", "n").alias("x"), F.struct(F.col("long").alias("w"), F.col("n_long").alias("n")).alias("y"))
    both = both.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return pairs.unionByName(both.selectExpr("x.w AS a", "y.w AS b", "x.n AS n_a", "y.n AS n_b"))


def greedy_names(rows: DataFrame, key: str, name: str, weight: str, least: float = 0.78) -> DataFrame:
    """Within a key (a phone), names with the most readings first join the first group whose head is alike; empty names only
    each other.  -> key, name (the head's), n (sum of weights).  A key has few names: it is one task."""
    schema = StructType([rows.schema[key], rows.schema[name], rows.schema[weight]])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(n_=-frame[weight]).sort_values(["n_", name], na_position="last")
        groups: list[list] = []
        for r in frame.itertuples(index=False):
            text = getattr(r, name) or ""
            home = next((g for g in groups if L.name_likeness(g[1], text) >= least), None)
            if home is None:
                groups.append([getattr(r, key), text, getattr(r, weight)])
            else:
                home[2] += getattr(r, weight)
        return pd.DataFrame(groups, columns=[key, name, weight])

    return rows.select(key, name, weight).groupBy(key).applyInPandas(run, schema)


def fuzzy_lookup(words: DataFrame, word: str, known: DataFrame, term: str, least: float = 0.86) -> DataFrame:
    """(word, term, how) of each word: the same term, else the most alike one (ties: the greater) in the blocks of the first letter
    and of lengths that allow the ratio; words without any have a null term."""
    w, k = words.select(F.col(word).alias("w")).distinct(), known.select(F.col(term).alias("k")).distinct()
    exact = w.join(k, F.col("w") == F.col("k"), "left")
    open_ = exact.where("k is null").select("w")
    j = open_.join(k, F.substring("w", 1, 1) == F.substring("k", 1, 1)).where((L.bounds(F.col("w"), F.col("k")) >= least) & (L.letter_bound(F.col("w"), F.col("k")) >= least))
    scored = j.withColumn("score", ratio_udf("k", "w")).where(F.col("score") >= least)
    best = scored.groupBy("w").agg(F.max_by("k", F.struct("score", "k")).alias("b"))
    return exact.join(best, "w", "left").select("w", F.coalesce("k", "b").alias("term"), F.when(F.col("k").isNotNull(), "exact").when(F.col("b").isNotNull(), "fuzzy").otherwise("none").alias("how"))
