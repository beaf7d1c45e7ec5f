"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is then put into its leaf.  A query walks the tree with a
priority queue of branches by distance to their centre, opening leaves in that order; how many leaves is calibrated:
the number is widened until the recall on held-back sample queries reaches the target.  The scores are exact.

Vectors, and queries with the leaves they open, are dealt into cells: some neighbouring leaves each, or a part of a
crowded leaf (or of one that many queries open), so that a cell holds at most about CELL_BYTES of either, whatever the
data.  Each cell compares its queries with its vectors, leaf by leaf, and sends the k best of each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import kernels as K

#: The sample is bounded for fitting the tree only; every row is indexed.
SAMPLE, BRANCH, LEAF_ROWS, CELL_BYTES = 30_000, 8, 400, 8 << 20
RECALL, PROBES = 0.97, 200


class Tree:
    """Inner nodes: centres and children; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, leaf_rows: int, seed: int):
        self.centres: list[np.ndarray | None] = []
        self.children: list[list[int]] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        self._rng = np.random.Generator(np.random.PCG64(seed))
        self._grow(x, max(8, leaf_rows))

    def _grow(self, x: np.ndarray, leaf_rows: int) -> int:
        at = len(self.leaf)
        self.centres.append(None)
        self.children.append([])
        self.leaf.append(-1)
        parts = self._split(x) if len(x) > leaf_rows else None
        if parts is None:
            self.leaf[at] = self.n_leaves
            self.n_leaves += 1
        else:
            centres, label = parts
            self.centres[at] = centres
            self.children[at] = [self._grow(x[label == k], leaf_rows) for k in range(len(centres))]
        return at

    def _split(self, x: np.ndarray):
        kinds = np.unique(x[: 4 * BRANCH * 50], axis=0)
        if len(kinds) < 2:
            return None
        c = kinds[self._rng.choice(len(kinds), min(BRANCH, len(kinds)), replace=False)]
        for _ in range(8):
            label = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
            c = np.array([x[label == k].mean(0) for k in range(len(c)) if (label == k).any()])
        label = np.argmax(x @ c.T - (c * c).sum(1) / 2, axis=1)
        used = np.unique(label)
        return (c[used], np.searchsorted(used, label)) if len(used) > 1 else None

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if self.leaf[at] >= 0:
                out[rows] = self.leaf[at]
            elif len(rows):
                c = self.centres[at]
                label = np.argmax(x[rows] @ c.T - (c * c).sum(1) / 2, axis=1)
                todo += [(child, rows[label == k]) for k, child in enumerate(self.children[at])]
        return out

    def best_bins(self, q: np.ndarray, n: int) -> list[int]:
        """The first n leaves, best bin first."""
        heap, out, tie = [(0.0, 0, 0)], [], 0
        while heap and len(out) < n:
            _, _, at = heapq.heappop(heap)
            while self.leaf[at] < 0:
                d = ((self.centres[at] - q) ** 2).sum(1)
                k = int(np.argmin(d))
                for j, child in enumerate(self.children[at]):
                    if j != k:
                        tie += 1
                        heapq.heappush(heap, (float(d[j]), tie, child))
                at = self.children[at][k]
            out.append(self.leaf[at])
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of a list column without nulls, as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit(vectors: DataFrame, k: int, dim: int, recall: float = RECALL, sample: int = SAMPLE, seed: int = 5) -> tuple[Tree, int, np.ndarray, np.ndarray]:
    """A tree from at most about `sample` rows (evenly by a hash of the id), and the leaves to visit for the recall wanted;
    about how many rows each leaf has, and the share of queries that open it.

    The recall is measured on at most PROBES rows with different vectors, which the tree is not fitted on, against all
    of the sample by brute force: each probe's share of its k nearest, averaged.  Of rows that tie for the last places
    any will do, and no more count than there are places, so copies of one vector weigh no more than other rows."""
    total = vectors.count()
    share = min(1.0, sample / max(1, total))
    own = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)) if share < 1 else vectors
    rows = own.orderBy("id").toArrow()
    if not rows.num_rows:
        return Tree(np.zeros((0, 1)), 8, seed), 1, np.zeros(1), np.ones(1)
    x = _unit(_matrix(rows.column("v"), dim))
    kinds = np.sort(np.unique(x, axis=0, return_index=True)[1])
    probes = kinds[np.unique(np.linspace(0, len(kinds) - 1, min(PROBES, -(-len(kinds) // 2))).astype(int))]
    rest = np.delete(x, probes, axis=0)
    tree = Tree(rest if len(rest) else x, int(LEAF_ROWS * share), seed)
    leaf = tree.assign(x)
    reached, scored = np.zeros(tree.n_leaves + 1), 0
    places = []
    for p in probes:
        s = x @ x[p]
        s[p] = -2
        want = min(k, len(x) - 1)
        if want < 1:
            continue
        edge = np.partition(s, len(s) - want)[len(s) - want]
        place = np.empty(tree.n_leaves, np.int64)
        place[tree.best_bins(x[p], tree.n_leaves)] = np.arange(tree.n_leaves)
        places.append(place)
        better, level = (np.cumsum(np.bincount(place[leaf[near]] + 1, minlength=tree.n_leaves + 1)) for near in (s > edge + 1e-12, np.abs(s - edge) <= 1e-12))
        reached += (better + np.minimum(level, want - better[-1])) / want
        scored += 1
    visits = max(1, int(np.searchsorted(reached / max(1, scored), recall - 1e-9)))
    opened = (np.mean([p < visits for p in places], axis=0) if places else np.ones(tree.n_leaves)) + 1 / max(1, len(probes))
    return tree, visits, np.bincount(leaf, minlength=tree.n_leaves) / share, opened


class Grid:
    """Cells of the leaves: neighbouring leaves share one while they hold at most `most` vectors and queries; a larger leaf is
    a grid of its own, its vectors in `down` parts, the queries that open it in `across`."""

    def __init__(self, rows: np.ndarray, opened: np.ndarray, most: int):
        self.down, self.across = (np.maximum(1, np.ceil(n / most)).astype(np.int64) for n in (rows, opened))
        self.first = np.zeros(len(rows), np.int64)
        cells, held, asked, shared = 0, 0.0, 0.0, False
        for k in range(len(rows)):
            alone = self.down[k] * self.across[k] > 1
            if not shared or alone or held + rows[k] > most or asked + opened[k] > most:
                self.first[k], held, asked = cells, 0.0, 0.0
                cells += int(self.down[k] * self.across[k])
            else:
                self.first[k] = cells - 1
            shared, held, asked = not alone, held + rows[k], asked + opened[k]
        self.cells = cells

    def of_vectors(self, ids: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell): a vector meets every part of its leaf's queries."""
        part = (K.mix(ids.astype(np.uint64)) % self.down[leaf].astype(np.uint64)).astype(np.int64)
        n = self.across[leaf]
        row = np.repeat(np.arange(len(ids)), n)
        return row, self.first[leaf][row] + part[row] * n[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)

    def of_queries(self, ids: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = (K.mix(ids.astype(np.uint64)) % self.across[leaf].astype(np.uint64)).astype(np.int64)
        n = self.down[leaf]
        row = np.repeat(np.arange(len(ids)), n)
        return row, self.first[leaf][row] + part[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * self.across[leaf][row]


_DEALT = "cell long, id long, data binary, leaves array<int>"


def _dealt(cell: np.ndarray, ids: np.ndarray, x: np.ndarray, leaves: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    data = pa.Array.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(leaves, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(ids), data.cast(pa.binary()), lists], [x.split()[0] for x in _DEALT.split(", ")])


def _place(tree, grid, dim: int):
    """Vectors by the cells of their leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
                leaf = tree.value.assign(_unit(x))
                row, cell = grid.value.of_vectors(ids, leaf)
                yield _dealt(cell, ids[row], x[row], leaf[row], np.arange(1, len(row) + 1))

    return run


def _ask(tree, grid, visits: int, dim: int):
    """Queries by the cells of the leaves they open, with those leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                x, ids = _matrix(part.column(1), dim), part.column(0).to_numpy()
                opened = [tree.value.best_bins(q, visits) for q in _unit(x)]
                asked, leaf = np.repeat(np.arange(len(x)), [len(own) for own in opened]), np.concatenate(opened).astype(np.int64)
                row, cell = grid.value.of_queries(ids[asked], leaf)
                asked, leaf = asked[row], leaf[row]
                order = np.lexsort((leaf, cell, asked))
                asked, cell, leaf = asked[order], cell[order], leaf[order]
                last = np.flatnonzero(np.append((asked[1:] != asked[:-1]) | (cell[1:] != cell[:-1]), True))
                yield _dealt(cell[last], ids[asked[last]], x[asked[last]], leaf, last + 1)

    return run


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cosines in double precision, each computed alike wherever its row stands."""
    return (x * q).sum(-1) / (np.sqrt((x * x).sum(-1)) * np.sqrt((q * q).sum(-1)))


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query: larger scores first, then smaller ids."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[nth < k], v[nth < k], s[nth < k]


def _compare(k: int, dim: int, kind: str):
    """The k best vectors of each query of a cell, leaf by leaf."""

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
        data, _ = K.buffers(table.column("data").combine_chunks())
        return table.column("id").to_numpy(), np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64), table.column("leaves").combine_chunks()

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if vectors.num_rows and queries.num_rows:
            (ids, x, of), (q_ids, q, opened) = read(vectors), read(queries)
            of, asked, leaf = of.flatten().to_numpy(), np.repeat(np.arange(len(q)), opened.value_lengths().to_numpy()), opened.flatten().to_numpy()
            for f in np.unique(leaf):
                rows, own = np.flatnonzero(of == f), asked[leaf == f]
                for b in range(0, len(rows), 8192):
                    part = rows[b : b + 8192]
                    unit = _unit(x[part])
                    for a in range(0, len(own), 256):
                        some = own[a : a + 256]
                        near = _unit(q[some]) @ unit.T
                        near[q_ids[some][:, None] == ids[part][None, :]] = -3.0
                        edge = np.partition(near, len(part) - k, axis=1)[:, len(part) - k] if len(part) > k else np.full(len(near), -2.0)
                        r, c = np.nonzero(near >= np.maximum(edge, -2.0)[:, None] - 1e-9)
                        held.append(_best(q_ids[some[r]], ids[part[c]], cosine(q[some[r]], x[part[c]]), k))
                if len(held) > 64:
                    held = [_best(*(np.concatenate(z) for z in zip(*held, strict=True)), k)]
        out = _best(*(np.concatenate(z) for z in zip(*held, strict=True)), k)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def _best_of_task(k: int):
    """Of all cells of a task the k best of each query; what is held is sent when it grows too large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, ["query_id", "vec_id", "score"]

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return _best(*(np.concatenate(z) for z in zip(*held, strict=True)), k)

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            size += batch.num_rows
            if size > 400_000:
                held = [best()]
                size = len(held[0][0])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best()], names)

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """The k nearest vectors found of each query by cosine: query_id, rank (from 1), vec_id, score.

    Nearest first, ties to the smaller vec_id; a query's own id is no candidate.  Vectors that are null, empty, zero or
    hold null or non-finite components take no part, nor do those with another length than most; rows with a null id
    neither.  Rows with one id are vectors each, and their queries are one query's.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    length = vectors.where(F.size(embedding) > 0).groupBy(F.size(embedding).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = length[0].n if length else 1

    single = vectors.schema[embedding].dataType.elementType.simpleString() == "float"

    def sound(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(embedding), lambda e: e.cast("float" if single else "double"))
        fine = F.forall(F.col("v"), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(F.col("v"), lambda e: e != 0)
        return df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v")).where((F.size("v") == dim) & F.col("id").isNotNull()).where(fine)

    base, asked = sound(vectors), sound(queries)
    tree, visits, rows, opened = fit(base, k, dim, recall)
    kind = "f4" if single else "f8"
    n = K.parts(spark)
    most = min(CELL_BYTES // (dim * np.dtype(kind).itemsize), int(rows.sum()) // (2 * n))
    grid = Grid(rows, opened * asked.count(), max(256, most))
    sent, cells = spark.sparkContext.broadcast(tree), spark.sparkContext.broadcast(grid)
    placed = base.mapInArrow(_place(sent, cells, dim), _DEALT).groupBy("cell")
    met = asked.mapInArrow(_ask(sent, cells, visits, dim), _DEALT).groupBy("cell")
    found = "query_id long, vec_id long, score double"
    best = placed.cogroup(met).applyInArrow(_compare(k, dim, kind), found).mapInArrow(_best_of_task(k), found)
    order = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score")))
    top = best.groupBy("query_id").agg(F.slice(order, 1, k).alias("top"))
    out = top.select("query_id", F.posexplode("top").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
