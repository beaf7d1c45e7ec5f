"""N-gram Jaccard self-join by prefix filters under a global order.

A document is the set of its distinct word shingles.  Under any global order of shingles, two sets with
Jaccard similarity t or more share a shingle among the first |x| - ceil(t|x|) + 1 of each.  Candidates are
made under the first order of ORDERS; those that share no shingle in the prefixes of each other order go before any
text is fetched, so sets are compared only where all filters meet.

Plan
  1. one pass gives each text's set size, 64-bit set signature, its prefixes under the hash orders (32 bits a
     shingle) and the first shingles of them, and adds all shingles to a sketch of 2**20 counters (4 MB whatever the
     input), which ranks frequent shingles last in the first order;
  2. texts with one signature and size are one class from here on;
  3. seeding: classes that share one of a few first shingles are compared with the most typical class there (a star,
     never all pairs), then those still apart with a few others; real links give provisional components;
  4. completion: prefixes under the first order are dealt by shingle; only shingles with two classes or more stay;
     pairs are made only between classes of different components and within size and position bounds, so a group
     of near copies makes none, however large;
  5. every candidate, of step 3 or 4, must share a shingle of the prefixes under the other orders too; what is left
     meets the texts and is compared in full;
  6. components of all links;
  7. links are counted within components: classes meet in cells of two blocks at most, where products of matrices give
     all intersections, so every link between different sets counts and none is a row.
Every linked pair either is in one component after step 3 or is compared in step 4, so no link between different
components is lost.  Texts are shuffled only if they are in a candidate pair; a fixed-size bitmap keeps out the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K
from quillmark.llm.graph import components, merged

WIDTH, PERCENT = 5, 75
SKETCH_BITS, CHUNK = 20, 4096
SEEDS = 3
#: Rounds of seeding; hubs of a shingle from the second round on.
ROUNDS, HUBS = 2, 3
FILTER_BITS = 1 << 22
#: Classes of a shingle that one task compares at most (about).
CELL = 4096
#: Classes, and shingles of them, that one block of a component has at most (about); columns of a matrix.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
#: Keys of the global orders; the first also ranks by frequency.
ORDERS = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)


def _ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The shingles of a set by the first global order; hashes break ties."""
    return s[np.argsort(levels[(s >> K.U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _scan(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offs in K.slices(batch.column(1)):
                size, sig, seeds, every, prefixes = [], [], [], [], []
                for s in K.shingle_sets(data, offs, width):
                    size.append(len(s))
                    sig.append(int(K.mix(s).sum()) & (2**64 - 1))
                    top, own = [K.signed(s[:SEEDS])], []
                    for k in (1, 2):
                        other = K.mix(s ^ K.U(ORDERS[k]))
                        top.append(K.signed(s[np.argpartition(other, SEEDS)[:SEEDS]] if len(s) > SEEDS else s))
                        p = prefix_size(len(s), percent)
                        own.append(np.sort((np.partition(other, p - 1)[:p] if len(s) else other).astype(np.uint32)))
                    seeds.append(np.unique(np.concatenate(top)))
                    prefixes.append(np.concatenate(own).tobytes())
                    every.append(s)
                every = np.concatenate(every) if every else np.zeros(0, np.uint64)
                counts += np.bincount((every >> K.U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b]), pa.array(size, pa.int32()), pa.array(K.signed(np.array(sig, np.uint64))), pa.array(seeds, pa.list_(pa.int64())), pa.array(prefixes, pa.binary()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.binary())], _SCAN
                )
        if counts.any():
            own = [counts[i : i + CHUNK].astype(np.uint32).tobytes() for i in range(0, len(counts), CHUNK)]
            none = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none.cast(pa.int32()), none, pa.nulls(len(own), pa.list_(pa.int64())), pa.nulls(len(own), pa.binary()), pa.array(range(len(own)), pa.int32()), pa.array(own, pa.binary())], _SCAN)

    return run


_SCAN = ["doc_id", "n", "sig", "seeds", "prefixes", "chunk", "counters"]


def _add(key: tuple, table: pa.Table) -> pa.Table:
    total = np.zeros(CHUNK, np.int64)
    for b in table.column("counters").to_pylist():
        total += np.frombuffer(b, np.uint32)
    return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counters": pa.array([total.tobytes()], pa.binary())})


def _levels(sketch: DataFrame) -> np.ndarray:
    """Rank of each counter: 0 up to twice the mean, then one more for each factor of sqrt 2.  1 MB, whatever the input."""
    rows = sketch.groupBy("chunk").applyInArrow(_add, "chunk int, counters binary").collect()
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in rows:
        total[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(bytes(r.counters), np.int64)
    ratio = total / max(1.0, 2 * total.mean())
    return np.clip(np.ceil(2 * np.log2(np.maximum(ratio, 1e-9))), 0, 120).astype(np.uint8)


def _prefixes(width: int, percent: int, levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = levels.value, set()
        for batch in batches:
            for _, _, data, offs in K.slices(batch.column(0)):
                tokens, sig, size, place, before = [], [], [], [], []
                for s in K.shingle_sets(data, offs, width):
                    if len(s):
                        key = (int(K.mix(s).sum()) & (2**64 - 1), len(s))
                        if key in seen:  # a copy gives the same rows; what is forgotten is only sent twice
                            continue
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(key)
                        own = _ordered(s, table)[: prefix_size(len(s), percent)]
                        tokens.append(own)
                        before.append(np.append(K.U(key[0]), own[:-1]))
                        sig.append(np.full(len(own), key[0], np.uint64))
                        size.append(np.full(len(own), len(s), np.int64))
                        place.append(np.arange(len(own)))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(np.concatenate(tokens))), pa.array(K.signed(np.concatenate(sig))), pa.array(np.concatenate(size) << 32 | np.concatenate(place)), pa.array(K.signed(np.concatenate(before)))], ["token", "sig", "size_place", "before"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by token, sig, size_place: one row per class of each token that two classes have."""
    held = None  # the newest distinct row, and whether it is known to share its token
    for batch in batches:
        if not batch.num_rows:
            continue
        token, sig, sp, before = (c.to_numpy() for c in batch.columns)
        if held is not None:
            token, sig, sp, before = (np.append(x, y) for x, y in zip(held, (token, sig, sp, before), strict=False))
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1]) | (sp[1:] != sp[:-1])
        token, sig, sp, before = token[new], sig[new], sp[new], before[new]
        same = token[1:] == token[:-1]
        many = np.append(False, same) | np.append(same, False)
        if held is not None:
            many[0] |= held[4]
        held = token[-1], sig[-1], sp[-1], before[-1], many[-1]
        many[-1] = False
        yield pa.RecordBatch.from_arrays([pa.array(token[many]), pa.array(sig[many]), pa.array(sp[many]), pa.array(before[many])], ["token", "sig", "size_place", "before"])
    if held is not None and held[4]:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held[:4]], ["token", "sig", "size_place", "before"])


def _between(percent: int):
    """Over rows sorted by token, cell, size_place: pairs of classes of different components that size and position allow.

    A pair is wanted at the first shingle that both share: no later overlap is larger than what follows it in either.
    A cell holds the classes of a shingle, or of a hot one two parts of them, which meet only each other."""

    def pairs(rep, comp, size, place, cap, before, part, cross):
        reach = np.searchsorted(size, -(-percent * size // 100), side="left")  # the smallest partner's row
        if comp.min() == comp.max() or (cross and part.min() == part.max()):
            return
        for i in range(1, len(rep)):
            j = np.arange(reach[i], i)
            j = j[(comp[j] != comp[i]) & (before[j] != before[i])]  # with the shingle before in common, they met there
            if cross:
                j = j[part[j] != part[i]]
            if not len(j):
                continue
            need = -(-percent * (size[j] + size[i]) // (100 + percent))
            most = np.minimum(size[j] - place[j], size[i] - place[i])  # holds at the first shingle they share
            j = j[np.minimum(most, np.minimum(cap[j], cap[i])) >= need]
            if len(j):
                yield np.minimum(rep[j], rep[i]), np.maximum(rep[j], rep[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        rest = None

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])
            found.clear()
            return out

        def take(cols):
            token, cell = cols[0], cols[1]
            cut = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]), [True]]))
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if hi - lo > 1:
                    own = [c[lo:hi] for c in cols[2:]]
                    rep, comp, sp, cap, before, part, cross = own
                    for a, b in pairs(rep, comp, sp >> 32, sp & 0xFFFFFFFF, cap, before, part, bool(cross[0])):
                        found.update(zip(a.tolist(), b.tolist(), strict=True))
                        if len(found) > 200_000:
                            yield flush()

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                cols = [np.append(x, y) for x, y in zip(rest, cols, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [c[last:] for c in cols]
            yield from take([c[:last] for c in cols])
        if rest is not None:
            yield from take(rest)
        yield flush()

    return run


def _keep(bitmap):
    """Rows whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(bitmap.value, bitorder="little")
        for batch in batches:
            yield batch.filter(pa.array(bits[batch.column(2).to_numpy()] == 1)).select([0, 1])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose prefixes share a shingle under each of the other orders."""
    for batch in batches:
        hit = np.ones(batch.num_rows, bool)
        for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            p, q = np.frombuffer(x, np.uint32).reshape(2, -1), np.frombuffer(y, np.uint32).reshape(2, -1)
            for one, two in zip(p, q, strict=True):
                at = np.minimum(np.searchsorted(two, one), max(0, len(two) - 1))
                if not len(two) or not (two[at] == one).any():
                    hit[i] = False
                    break
        yield batch.filter(pa.array(hit)).select([0, 1])


def _verify(width: int, percent: int):
    """Pairs whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                sets = []
                for c in (2, 3):
                    own = []
                    for _, _, data, offs in K.slices(part.column(c)):
                        own += K.shingle_sets(data, offs, width)
                    sets.append(own)
                hit = np.zeros(part.num_rows, bool)
                for i, (x, y) in enumerate(zip(*sets, strict=True)):
                    if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        hit[i] = 100 * both >= percent * (len(x) + len(y) - both)
                yield part.filter(pa.array(hit)).select([0, 1])

    return run


def _linked(rep: np.ndarray, part: np.ndarray, sets: list[np.ndarray], cross: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of a cell, and with how many others there each is linked; in a cross cell only those of the other part count."""
    n = np.array([len(s) for s in sets])
    token, at = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(token, kind="stable")
    token, at = token[order], at[order]
    col = np.cumsum(np.append(False, token[1:] != token[:-1]))
    several = np.bincount(col) > 1
    use = several[col]
    at, col = at[use], (np.cumsum(several) - 1)[col[use]]
    one = np.flatnonzero(part == part.min())
    two = np.flatnonzero(part != part.min()) if cross else one
    both = np.zeros((len(one), len(two)))
    for c in range(0, int(several.sum()), COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        own = np.zeros((len(sets), COLUMNS), np.float32)
        own[at[lo:hi], col[lo:hi] - c] = 1
        both += own[one] @ own[two].T
    hit = 100 * both >= percent * (n[one][:, None] + n[two][None, :] - both)
    if cross:
        return np.concatenate([rep[one], rep[two]]), np.concatenate([hit.sum(1), hit.sum(0)])
    np.fill_diagonal(hit, False)
    return rep, hit.sum(1)


def _link_counts(width: int, percent: int):
    """Over rows sorted by component and cell: (rep, links) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def flush():
            rep, part, cross, sets = zip(*held, strict=True)
            reps, links = _linked(np.array(rep), np.array(part), list(sets), cross[0], percent)
            return pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(links, pa.int64())], ["rep", "links"])

        for batch in batches:
            sets = (s for _, _, data, offs in K.slices(batch.column(5)) for s in K.shingle_sets(data, offs, width))
            for comp, cell, rep, part, cross, s in zip(*(batch.column(c).to_pylist() for c in range(5)), sets, strict=True):
                if (comp, cell) != key:
                    if held:
                        yield flush()
                    key, held = (comp, cell), []
                held.append((rep, part, cross, s))
        if held:
            yield flush()

    return run


def _degrees(docs: DataFrame, found: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, n_links): with how many other classes each class is linked.  found: rep, n, component (null: no link).

    The two classes of a component of two are linked; larger ones are grids of cells, each class once with each block."""
    n = K.parts(docs.sparkSession)
    sizes = found.where("component is not null").groupBy("component").agg(F.count("*").alias("c"), F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("g"))
    many = K.stored(found.join(sizes, "component").select("rep", "component", "c", "g"), "join-many")
    large = many.where("c > 2")
    texts = _only(docs, large.select(F.col("rep").alias("doc_id"))).withColumnRenamed("doc_id", "rep")
    rows = large.join(texts, "rep").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("g"))).withColumn("k", F.explode(F.expr("sequence(0, g - 1)")))
    rows = rows.select("component", (F.least("part", "k") * F.col("g") + F.greatest("part", "k")).alias("cell"), "rep", "part", (F.col("part") != F.col("k")).alias("cross"), "data")
    counts = rows.repartition(n, "component", "cell").sortWithinPartitions("component", "cell").mapInArrow(_link_counts(width, percent), "rep long, links long")
    return K.stored(counts.unionByName(many.where("c = 2").select("rep", F.lit(1).cast("long").alias("links"))).groupBy("rep").agg(F.sum("links").alias("n_links")), "join-degrees")


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (doc_id, data), dealt by doc_id, of the ids (doc_id) and few others: those with the bit of one of them."""
    spark = rows.sparkSession
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    own = ids.select(bit.alias("bit")).groupBy((F.col("bit") / 32768).cast("int").alias("part")).agg(F.expr("bitmap_construct_agg(bit % 32768)").alias("bits")).collect()
    bitmap = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in own:
        bitmap[r.part * 4096 : (r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    texts = rows.select("doc_id", "data", bit.alias("bit")).mapInArrow(_keep(spark.sparkContext.broadcast(bitmap)), "doc_id long, data binary")
    return texts.repartition(K.parts(spark), "doc_id")


def _beside(rows: DataFrame, pairs: DataFrame, run) -> DataFrame:
    """Pairs (a, b) with the data of both, from rows (doc_id, data), through run (a, b, data, data)."""
    texts = _only(rows, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    one = pairs.join(texts.withColumnsRenamed({"doc_id": "a", "data": "data_a"}), "a")
    two = one.join(texts.withColumnsRenamed({"doc_id": "b", "data": "data_b"}), "b")
    return two.select("a", "b", "data_a", "data_b").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, prefixes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of documents with similar enough sets.  docs: doc_id, data; prefixes: doc_id, data of the other orders."""
    near = K.stored(_beside(prefixes, pairs, _meet), "join-near")
    return _beside(docs, near, _verify(width, percent))


def _with_component(rows: DataFrame, labels: DataFrame, of: str, name: str) -> DataFrame:
    """rows with the component of a class: its own number, if it has no link yet."""
    own = labels.select(F.col("node").alias(of), F.col("component").alias("label_"))
    return rows.join(own, of, "left").withColumn(name, F.coalesce("label_", of)).drop("label_")


def _close(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a class and a hub whose sizes allow a link."""
    rows = rows.where(f"rep <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    return rows.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of percent/100 or more, and find components.

    Words are runs of bytes outside ASCII white space, A-Z lower-cased; shingles are `width` words in a row, and a
    shorter text is one shingle.  Returns a row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links) and, if count_links, n_links (how many other sets its own is linked with: all links count,
    those within a group of near copies too; texts of one set are copies and count as one).
    Null texts and texts without words have an empty set and stay alone.  Rows with a null id are left out; rows with
    one id are documents each, so they give a row each; other columns are ignored.
    """
    spark = docs.sparkSession
    rows, repeated = K.keyed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "text")
    if repeated:
        out = jaccard_join(rows, "row_key_", "text", width, percent, count_links).withColumnRenamed("doc_id", "row_key_").join(rows.select("row_key_", "doc_id"), "row_key_")
        least = rows.select(F.col("row_key_").alias("component_id"), F.col("doc_id").alias("least_"))
        return out.join(least, "component_id").select("doc_id", "n_shingles", F.col("least_").alias("component_id"), *(["n_links"] if count_links else []))
    n = K.parts(spark)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), K.text_bytes(text).alias("data")).where("doc_id is not null")
    scan = K.stored(base.mapInArrow(_scan(width, percent), "doc_id long, n int, sig long, seeds array<long>, prefixes binary, chunk int, counters binary"), "join-scan")
    prefixes = scan.where("n > 0").select("doc_id", F.col("prefixes").alias("data"))
    levels = _levels(scan.where("chunk is not null").select("chunk", "counters"))
    sets = scan.where("chunk is null").select("doc_id", "n", "sig")
    classes = K.stored(scan.where("n > 0").groupBy("sig", "n").agg(F.min(F.struct("doc_id", "seeds")).alias("m")).select("sig", "n", F.col("m.doc_id").alias("rep"), "m.seeds"), "join-classes")

    seeded = classes.select("rep", "n", F.explode("seeds").alias("token"))
    counts = seeded.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    seeded = K.stored(seeded.join(counts, "token"), "join-seeded")
    typical = seeded.groupBy("rep").agg(F.sum(F.log2("c")).alias("typical"))
    hub = F.max(F.struct("typical", (-F.col("n")).alias("s"), (-F.col("rep")).alias("r")))
    hubs = seeded.join(typical, "rep").groupBy("token").agg(hub.alias("h")).select("token", (-F.col("h.r")).alias("hub"), (-F.col("h.s")).alias("hub_n"))
    tried = _close(seeded.join(hubs, "token"), percent)
    tried = K.stored(tried, "join-stars")
    links = K.stored(verified(base, prefixes, tried, width, percent), "join-links")
    early = components(links, "join-early")
    for k in range(1, ROUNDS):
        own = seeded.join(early.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        pick = [F.min(F.struct(F.xxhash64("rep", F.lit(10 * k + i)).alias("h"), "rep", "n", "comp")).alias(f"h{i}") for i in range(HUBS)]
        hubs = own.groupBy("token").agg(*pick, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        hubs = hubs.select("token", F.explode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("h")).select("token", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.comp").alias("hub_comp"))
        more = _close(own.join(hubs, "token").where("comp <> hub_comp"), percent).join(tried, ["a", "b"], "left_anti")
        more = K.stored(more, "join-stars")
        tried = tried.unionByName(more)
        new = K.stored(verified(base, prefixes, more, width, percent), "join-links")
        early = merged(early, new, "join-early")

    rows = base.select("data").mapInArrow(_prefixes(width, percent, spark.sparkContext.broadcast(levels)), "token long, sig long, size_place long, before long")
    shared = rows.repartition(n, "token").sortWithinPartitions("token", "sig", "size_place").mapInArrow(_shared, "token long, sig long, size_place long, before long")
    shared = K.stored(shared.withColumn("n", F.shiftright("size_place", 32).cast("int")), "join-shared")
    # No other set has the rest of a prefix, so no overlap is larger than most.
    alone = F.expr(f"n - cast(ceil({percent} * n / 100) as int) + 1") - F.count("*")
    most = shared.groupBy("sig", "n").agg((F.col("n") - alone).cast("long").alias("most"))
    placed = K.stored(shared.join(classes.select("sig", "n", "rep").join(most, ["sig", "n"]), ["sig", "n"]).select("token", "before", "rep", "n", "size_place", "most"), "join-placed")
    # The class with the fewest shingles of its own is the likeliest to be linked with the others of a shingle.
    central = placed.groupBy("token").agg(F.max_by(F.struct("rep", "n"), F.struct(F.col("most") / F.col("n"), -F.col("rep"))).alias("h")).select("token", F.col("h.rep").alias("hub"), F.col("h.n").alias("hub_n"))
    more = K.stored(_close(_with_component(placed.join(central, "token"), early, "hub", "hub_comp").transform(_with_component, early, "rep", "comp").where("comp <> hub_comp"), percent).join(tried, ["a", "b"], "left_anti"), "join-stars")
    tried = tried.unionByName(more)
    new = K.stored(verified(base, prefixes, more, width, percent), "join-links")
    early = merged(early, new, "join-early")

    # A shingle of more than CELL classes is a grid of cells, so no task holds or compares all of them.
    hot = K.stored(placed.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > CELL).select("token", F.ceil(F.col("c") / CELL).alias("g")), "join-hot")
    rows = _with_component(placed, early, "rep", "comp").join(hot, "token", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("g"))).withColumn("k", F.explode(F.expr("sequence(0, g - 1)")))
    rows = rows.select("token", (F.least("part", "k") * F.col("g") + F.greatest("part", "k")).alias("cell"), "rep", "comp", "size_place", "most", "before", "part", (F.col("part") != F.col("k")).alias("cross"))
    rest = rows.repartition(n, "token", "cell").sortWithinPartitions("token", "cell", "size_place", "rep").mapInArrow(_between(percent), "a long, b long").distinct()
    rest = K.stored(rest.join(tried, ["a", "b"], "left_anti"), "join-rest")
    new = K.stored(verified(base, prefixes, rest, width, percent), "join-links")
    final = merged(early, new, "join-final")
    K.discard(seeded, shared, placed, hot, rest)

    found = classes.select("sig", "n", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    if count_links:
        found = K.stored(found, "join-found")
        found = found.join(_degrees(base, found, width, percent), "rep", "left")
    own = found.select("sig", "n", F.coalesce("component", "rep").alias("component_id"), *(["n_links"] if count_links else []))
    counted = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if count_links else []
    return sets.join(own, ["sig", "n"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *counted)
