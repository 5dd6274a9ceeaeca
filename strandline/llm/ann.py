"""Nearest neighbours by cosine with an inverted multi-index.

Index. Vectors are scaled to length 1 and cut in two halves. Each half has its
own codebook, trained by k-means on a bounded sample; a vector's cell is the
pair of its halves' centroids. Codebooks grow with the square root of the
table, up to a bound, so cells stay small. Every vector is indexed.

Search. For each query the multi-sequence algorithm walks centroid pairs in
the order of summed distance with a heap (of tiles of pairs), until the cells it has seen hold
``visits(n)`` of the n vectors, a number that grows more slowly than n. Cells
are dealt into blocks of bounded size, by their first centroid; a first
centroid with more vectors than that has several blocks. Each vector goes to
one block, once. Queries are the small side: a query goes to every block that
it visits, with a bitmap of its cells there. A task reads a block's vectors
first and then streams the queries past them, so it holds one block and a few
queries, however many there are. In a block, each cell meets the queries that
visit it, and only these; the best are ranked by exact cosine in double
precision. Equal vectors of a block are one entry with its smallest ids, since
of a tie only the smallest k + 1 ids can be returned.

The share that must be visited depends on the vectors. Those with no small
neighbourhoods (64 near-independent dimensions, where the fifth neighbour is
not much nearer than the rest) need much, and the defaults are made for them;
lower ``scale`` for data with structure. README has figures.

Defined results: vectors that are null, zero, of another length than most of
their table's, or hold null or non-finite components take no part, neither as
queries nor as candidates; a query has fewer than k rows if there are fewer
candidates; ties go to the smaller id; rows of null id take no part; an empty
table gives no rows. Rows that repeat an id are one candidate each. Components
may be of any floating-point type.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import staged

#: Most centroids of a codebook, rows that train it, and rounds of k-means.
CENTROIDS, SAMPLE, ROUNDS = 1_024, 20_000, 12
#: A query visits SCALE * n ** POWER of n vectors.
SCALE, POWER = 2.6, 0.8
#: A block holds 16 times the square root of the table, up to a bound.
VECTORS_PER_BLOCK, QUERIES_AT_ONCE, TILE = 50_000, 256, 8


def visits(n: int, scale: float = SCALE, power: float = POWER) -> int:
    """How many of n vectors a query visits at least."""
    return min(n, int(np.ceil(scale * n**power)))


def usable(vec: Column, dim: int) -> Column:
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vec.isNotNull() & (F.size(vec) == dim) & whole & F.exists(vec, lambda x: x != 0)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def kmeans(rows: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Centroids of ``rows``; fewer than k if there are fewer distinct rows."""
    distinct = np.unique(rows, axis=0)
    centroids = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest(rows, centroids)
        n = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, rows)
        centroids = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
    return centroids


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids * centroids).sum(1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([distances(rows[i : i + 4096], centroids).argmin(1) for i in range(0, len(rows), 4096)] or [np.zeros(0, np.int64)])


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim).astype(np.float64)


def _assigned(books, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = dim // 2
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dim))
            c1, c2 = nearest(unit[:, :half], books[0]), nearest(unit[:, half:], books[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c1, pa.int32()), pa.array(c2, pa.int32()), *batch.columns[1:]], ["vec_id", "c1", "c2", *batch.schema.names[1:]])

    return run


def block_plan(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each first centroid its first block, how many blocks it is split into, and its place among the centroids of that block.

    Centroids share a block while it holds at most ``most`` vectors.
    """
    first, parts, place = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    block, held, members = -1, most + 1, 0  # full, so the first centroid opens a block
    for c, n in enumerate(sizes.tolist()):
        if n > most or held + n > most:
            block, held, members = block + 1, 0, 0
        first[c], place[c] = block, members
        held, members = held + n, members + 1
        if n > most:
            parts[c] = -(-n // most)
            block, held = block + int(parts[c]) - 1, most + 1
    return first, parts, place


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int, tile: int = TILE) -> np.ndarray:
    """Centroid pairs (rows) by ascending sum of distances, until their cells hold ``enough`` vectors; empty cells are left out.

    The heap holds tiles, squares of ``tile`` neighbours in both orders of
    distance, by their least sum. Pairs whose sum is not above that of the next
    tile come before all that the heap has yet to give, so the order is the
    same as if the heap held single pairs.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2, n = d1[o1], d2[o2], counts[np.ix_(o1, o2)]
    at1, at2 = np.arange(0, len(s1), tile), np.arange(0, len(s2), tile)
    sizes = np.add.reduceat(np.add.reduceat(n, at1, 0), at2, 1).tolist()
    m1, m2 = s1[at1].tolist(), s2[at2].tolist()
    sums = s1[:, None] + s2[None, :]
    heap, below, out, held, wanted = [(m1[0] + m2[0], 0, 0)], [0] * len(m1), np.zeros((len(m1), len(m2)), bool), 0, enough
    while heap:
        _, i, j = heapq.heappop(heap)
        below[i] = j + 1
        out[i, j] = True
        held += sizes[i][j]
        # A tile enters the heap when those before it, in its row and in its column, have left.
        if i + 1 < len(m1) and below[i + 1] == j:
            heapq.heappush(heap, (m1[i + 1] + m2[j], i + 1, j))
        if j + 1 < len(m2) and (i == 0 or below[i - 1] > j + 1):
            heapq.heappush(heap, (m1[i] + m2[j + 1], i, j + 1))
        if held >= wanted or not heap:
            sure = np.repeat(np.repeat(out, tile, 0)[: len(s1)], tile, 1)[:, : len(s2)] & (sums <= (heap[0][0] if heap else np.inf))
            missing = enough - int(n[sure].sum())
            if missing <= 0:
                break
            wanted = held + missing
    i, j = np.nonzero(sure & (n > 0))
    order = np.argsort(sums[i, j], kind="stable")
    i, j = i[order], j[order]
    last = int(np.searchsorted(np.cumsum(n[i, j]), enough)) + 1
    return np.column_stack([o1[i], o2[j]])[:last]


def _walked(books, dim: int, counts: np.ndarray, enough: int, plan):
    """A row for each query and block that it visits; the mask has a bit for each cell, by place and second centroid."""
    first, parts, place = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, k2 = dim // 2, len(books[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), dim))
            d1, d2 = distances(unit[:, :half], books[0]), distances(unit[:, half:], books[1])
            at, blocks, masks = [], [], []
            for q in range(len(unit)):
                cells = walk(d1[q], d2[q], counts, enough)
                home = first[cells[:, 0]]
                for b in np.unique(home):
                    own = cells[home == b]
                    bits = np.zeros((int(place[own[:, 0]].max()) + 1) * k2, np.uint8)
                    bits[place[own[:, 0]] * k2 + own[:, 1]] = 1
                    mask, n = np.packbits(bits).tobytes(), int(parts[own[0, 0]])
                    at += [q] * n
                    blocks += range(int(b), int(b) + n)
                    masks += [mask] * n
            chosen = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["vec_id", "embedding"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([1] * len(at), pa.int32()), chosen.column(0), pa.array([0] * len(at), pa.int32()), chosen.column(1), pa.array(masks, pa.binary())], ["block", "kind", "vec_id", "cell", "embedding", "mask"])

    return run


class _Block:
    """The vectors of one block: distinct ones, ordered by cell, each with its smallest ids."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int, k: int):
        rows = pa.Table.from_batches(batches).combine_chunks().sort_by("vec_id")
        self.k, ids = k, rows.column("vec_id").to_numpy()
        self.rows, first, inverse = np.unique(_matrix(rows.column("embedding").combine_chunks(), dim), axis=0, return_index=True, return_inverse=True)
        cell = rows.column("cell").to_numpy()[first]
        by_cell = np.argsort(cell, kind="stable")
        self.rows, where = self.rows[by_cell], np.argsort(by_cell)
        inverse = where[inverse.ravel()]
        order = np.argsort(inverse, kind="stable")  # ids of an entry stay ascending
        begin = np.searchsorted(inverse[order], np.arange(len(self.rows) + 1))
        self.ids, self.begin = ids[order], begin
        self.norms = np.sqrt((self.rows * self.rows).sum(1))
        self.unit = self.rows / self.norms[:, None]
        self.cells, self.starts = np.unique(cell[by_cell], return_index=True)
        self.ends = np.append(self.starts[1:], len(self.rows))

    def best(self, qid: np.ndarray, q: np.ndarray, masks: np.ndarray) -> tuple[list, list, list]:
        """query ids, vector ids, scores: the best of each query in the cells that it visits."""
        out: tuple[list, list, list] = ([], [], [])
        norms = np.sqrt((q * q).sum(1))
        unit = q / norms[:, None]
        near = np.full((len(q), len(self.rows)), -np.inf)
        for c, a, b in zip(self.cells.tolist(), self.starts.tolist(), self.ends.tolist()):
            if c < masks.shape[1] and len(who := np.flatnonzero(masks[:, c])):
                near[who, a:b] = unit[who] @ self.unit[a:b].T
        few = self.k + 1
        kth = np.partition(near, -few, axis=1)[:, -few] if near.shape[1] > few else np.full(len(near), -2.0)
        for i, e in zip(*np.nonzero(near >= np.maximum(kth, -2.0)[:, None] - 1e-9)):
            score = float((q[i] * self.rows[e]).sum() / (norms[i] * self.norms[e]))
            own = [x for x in self.ids[self.begin[e] : self.begin[e + 1]][:few].tolist() if x != qid[i]][: self.k]
            out[0].extend([int(qid[i])] * len(own))
            out[1].extend(own)
            out[2].extend([score] * len(own))
        return out


_FOUND = "query_id long, vec_id long, score double"


def _reranked(dim: int, k: int):
    """Batches sorted by block and kind: a block's vectors, then its queries, which stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, built = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            b, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if b[a] != block:
                    block, held, built = b[a], [], None
                rows = batch.slice(a, z - a)
                if not kind[a]:
                    held.append(rows.select(["vec_id", "cell", "embedding"]))
                    continue
                if not held:
                    continue  # a block of empty cells
                built = built or _Block(held, dim, k)
                for s in range(0, rows.num_rows, QUERIES_AT_ONCE):
                    part = rows.slice(s, QUERIES_AT_ONCE)
                    raw = [np.unpackbits(np.frombuffer(m, np.uint8)) for m in part.column(5).to_pylist()]
                    masks = np.zeros((len(raw), max(map(len, raw))), bool)
                    for row, m in zip(masks, raw):
                        row[: len(m)] = m
                    found = built.best(part.column(2).to_numpy(), _matrix(part.column(4), dim), masks)
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def search(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = SCALE, power: float = POWER, centroids: int = CENTROIDS, sample: int = SAMPLE, per_block: int = VECTORS_PER_BLOCK
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of vec_id and embedding that is a query.

    ``sample`` bounds the rows that codebooks are trained on, ``centroids`` the
    size of each codebook; both bound what the driver holds. ``scale`` and
    ``power`` say how many vectors a query visits.
    """
    spark = vectors.sparkSession
    vectors = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "embedding", is_query.alias("asks"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    common = vectors.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common["d"] if common else 1
    vectors = vectors.filter(usable(F.col("embedding"), dim))
    n = vectors.count()
    centroids = max(1, min(centroids, int(np.ceil(np.sqrt(n)))))
    trained = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    unit = _unit(_matrix(trained.column("embedding").combine_chunks(), dim)) if trained.num_rows else np.ones((1, dim))
    books = (kmeans(unit[:, : dim // 2], centroids), kmeans(unit[:, dim // 2 :], centroids))
    k1, k2 = len(books[0]), len(books[1])
    index = staged(vectors.mapInArrow(_assigned(books, dim), f"vec_id long, c1 int, c2 int, embedding {kind}, asks boolean"), "ann-index")
    cells = index.groupBy("c1", "c2").count().toArrow()  # one row for each pair of centroids at most
    counts = np.zeros((k1, k2), np.int64)
    counts[cells.column("c1").to_numpy(), cells.column("c2").to_numpy()] = cells.column("count").to_numpy()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = block_plan(counts.sum(1), max(1, min(per_block, int(16 * np.sqrt(n)))))
    queries = index.filter("asks").select("vec_id", "embedding")
    queries = queries.mapInArrow(_walked(books, dim, counts, max(k + 1, visits(n, scale, power)), plan), f"block int, kind int, vec_id long, cell int, embedding {kind}, mask binary")
    first, split, place = (F.get(F.lit([int(x) for x in p]), F.col("c1")) for p in plan)
    block = (first + F.pmod(F.xxhash64("vec_id"), split)).cast("int")
    entries = index.select(block.alias("block"), F.lit(0).alias("kind"), "vec_id", (place * k2 + F.col("c2")).cast("int").alias("cell"), "embedding", F.lit(None).cast("binary").alias("mask"))
    met = entries.unionByName(queries).repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(_reranked(dim, k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
