"""Exact top-k by inner product with no random access.

Candidates are cut into blocks of bounded size. In each block every component has its list of candidates sorted by
value, read from the high end for a positive query component and from the low end for a negative one. A round reads all
lists onward from where the last one stopped, to the same depth; a candidate's score bounds are kept from round to round
and only what was read now is added to them. A query stops when no outsider's upper bound reaches its k-th lower bound.
The final scores of those that may still be among its best come from reading on: what their lists hold for them, no
vector is looked up before its entries have been met. Queries are read in blocks as well, so the bounds of many queries
come from a few matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.common import materialise

#: Rows of a candidate block and of a query block.
BLOCK, QUERY_BLOCK = 4096, 256
#: Query blocks that meet a candidate block in one task.
QUERIES_PER_CELL = 16
#: The first round reads this part of each list, every further one as much again as has been read.
FIRST_DEPTH = 8
#: A round that leaves more than this share of the candidates in play is followed by reading to the end.
HOPELESS = 0.5
PACKED = "block long, dim int, ids binary, vectors binary"


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, parts): floor(scale * x) / scale of each component as doubles; vectors null, empty or with a null or non-finite component are left out.

    The whole numbers themselves can be beyond doubles; ``scaled`` makes them where they are needed.
    """
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # From 2^52 on a double is a whole number already.
    part = lambda x: F.when(F.abs(x) < 2.0**52 / scale, F.floor(x * scale).cast("double") / scale).otherwise(x)
    parts = F.transform("embedding", lambda x: part(x.cast("double")))
    return vectors.where(sound & F.col("vec_id").isNotNull()).select("vec_id", parts.alias("parts"))


def scaled(parts: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) from ``whole_vectors``: doubles while they hold them all exactly enough, else Python's integers."""
    if float(np.abs(parts).max(initial=0)) < 2.0**1000 / scale:
        return np.where(np.abs(parts) < 2.0**52 / scale, np.rint(parts * scale), parts * scale)
    return np.frompyfunc(lambda v: int(v) * scale if abs(v) >= 2.0**52 / scale and v == int(v) else round(v * scale), 1, 1)(parts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        ids, blocks = batch.column("vec_id").to_numpy(), batch.column("block").to_numpy()
        ends = batch.column("parts").offsets.to_numpy()
        values = batch.column("parts").values.to_numpy(zero_copy_only=False)
        sizes = np.diff(ends)
        for block, dim in {*zip(blocks.tolist(), sizes.tolist(), strict=True)}:
            own = np.flatnonzero((sizes == dim) & (blocks == block))
            held.setdefault((block, dim), []).append((ids[own], values[ends[own][:, None] + np.arange(dim)]))
    for (block, dim), parts in held.items():
        ids, matrix = np.concatenate([p[0] for p in parts]).astype("<i8"), np.vstack([p[1] for p in parts]).astype("<f8")
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["block", "dim", "ids", "vectors"])


def packed(vectors: DataFrame, rows: int, what: str) -> tuple[DataFrame, int]:
    """The vectors as one row a block and dimension, and the number of blocks; the block is a hash of the row's place."""
    blocks = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    return materialise(dealt.repartition(blocks, "block").mapInArrow(_pack, PACKED), what), blocks


def whole_numbers(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which every sum of products is exact: doubles, 64-bit integers, else Python's."""
    python = np.frompyfunc(int, 1, 1)
    if object in (x.dtype, q.dtype):
        return python(x), python(q)
    bound = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * 4 * max(1, x.shape[1])
    if bound < 2**53:
        return x, q
    if bound < 2**63:
        return x.astype(np.int64), q.astype(np.int64)
    return python(x), python(q)


class Lists:
    """The sorted lists of a block, and how far they have been read."""

    def __init__(self, x: np.ndarray) -> None:
        self.n, self.dim = x.shape
        order = np.argsort(x, axis=0, kind="stable")
        self.ordered = np.take_along_axis(x, order, 0)
        self.rank = np.empty((self.n, self.dim), np.int32)
        np.put_along_axis(self.rank, order, np.arange(self.n, dtype=np.int32)[:, None], 0)
        self.x, self.depth = x, 0

    def read_on(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries that the next round meets, from the high and from the low end: by how much they differ from the list's last value."""
        high = (self.rank >= self.n - depth) & (self.rank < self.n - self.depth)
        low = (self.rank < depth) & (self.rank >= self.depth)
        self.depth = depth
        zero = self.x.dtype.type(0) if self.x.dtype != object else 0
        return np.where(high, self.x - self.ordered[0], zero), np.where(low, self.x - self.ordered[-1], zero)

    def unread(self) -> tuple[np.ndarray, np.ndarray]:
        """0/1 matrices of what has not been read from the high and from the low end."""
        kind = self.x.dtype
        return (self.rank < self.n - self.depth).astype(kind), (self.rank >= self.depth).astype(kind)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """By how much an unread entry can differ at most from the list's last value, at either end."""
        return self.ordered[self.n - self.depth] - self.ordered[0], self.ordered[self.depth - 1] - self.ordered[-1]


def best_in_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query id, vec ids, scores, depth read before the stop) of each query's ``k`` best in the block, best first, ties to the smaller id.

    Scores beyond 64 bits are given as the nearest 64-bit integer; their order is that of the exact ones.
    """
    x, q = whole_numbers(x, q)
    lists, n = Lists(x), len(ids)
    up, down = np.maximum(q, 0).T, np.minimum(q, 0).T
    # Every list adds its worst value until an entry is met.
    lower = np.repeat((lists.ordered[0] @ up + lists.ordered[-1] @ down)[None, :], n, axis=0)
    active = np.arange(len(query_ids))
    depth = min(n, max(k, n // FIRST_DEPTH))
    while len(active):
        high, low = lists.read_on(depth)
        lower += high @ up + low @ down
        own = ids[:, None] != query_ids[active][None, :]
        if depth < n:
            (rest_high, rest_low), (most, least) = lists.unread(), lists.reach()
            gap = rest_high @ (up * most[:, None]) + rest_low @ (down * least[:, None])
            # A query's own row is no candidate: it must not set the k-th lower bound.
            bounds = np.sort(np.where(own, lower, lower.min()), axis=0)[max(0, n - k)]
            may = (lower + gap >= bounds[None, :]) & own
        else:
            may = own
        counts = may.sum(0)
        done = (counts <= max(4 * k, n // 32)) | (depth == n)
        for c in np.flatnonzero(done):
            rows = np.flatnonzero(may[:, c])
            score = lower[rows, c]
            if depth < n:
                # Read on for these rows: each entry still unread is met in its list and replaces the list's last value.
                late_high, late_low = (lists.rank[rows] < n - depth) * (x[rows] - lists.ordered[0]), (lists.rank[rows] >= depth) * (x[rows] - lists.ordered[-1])
                score = score + late_high @ up[:, c] + late_low @ down[:, c]
            best = np.lexsort((ids[rows], -score))[:k]
            limit = (1 << 63) - 1
            yield int(query_ids[active[c]]), ids[rows][best], np.array([max(-limit, min(limit, int(v))) for v in score[best]], np.int64), depth
        hopeless = float(counts[~done].mean()) > HOPELESS * n if (~done).any() else False
        active, up, down, lower = active[~done], up[:, ~done], down[:, ~done], lower[:, ~done]
        depth = n if hopeless else min(n, 2 * depth)


def _search(k: int, scale: int):
    def search(blocks: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        for block in blocks.to_pylist():
            ids, x = np.frombuffer(block["ids"], "<i8"), scaled(np.frombuffer(block["vectors"], "<f8").reshape(-1, block["dim"]), scale)
            for queries in asked.to_pylist():
                q = scaled(np.frombuffer(queries["vectors"], "<f8").reshape(-1, queries["dim"]), scale)
                found += best_in_block(ids, x, np.frombuffer(queries["ids"], "<i8"), q, k)
        columns = [np.repeat([f[0] for f in found], [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]), np.concatenate([f[2] for f in found])] if found else [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return search


def cells(blocks: DataFrame, n: int, asked: DataFrame, m: int) -> tuple[DataFrame, DataFrame, int]:
    """Both dealt over a grid of cells (block, part), and how many there are.

    A cell holds a candidate block and at most QUERIES_PER_CELL query blocks, whatever the number of either.
    """
    parts = -(-m // QUERIES_PER_CELL)
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    candidates = blocks.select("block", "dim", "ids", "vectors", each(parts).alias("part"))
    queries = asked.select(each(n).alias("block"), "dim", "ids", "vectors", F.floor(F.col("block") / QUERIES_PER_CELL).alias("part"))
    return candidates, queries, n * parts


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024) -> DataFrame:
    """Each query's ``k`` highest integer inner products over ``vectors`` (vec_id, embedding) but for its own id.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A query with fewer candidates gets
    all. Vectors that are null, empty or hold a null or non-finite component take no part, nor do those of another
    length than the query's. Rows that repeat a vec_id are candidates of their own; a query that is repeated is asked
    once for each distinct vector. Empty tables give an empty result; other columns are ignored.

    Scores beyond 64 bits are given as the nearest 64-bit integer.

    Candidate and query blocks meet in the cells of a grid, by a shuffle: neither side passes through the driver or one
    task. Each cell keeps ``k`` of its rows for a query, and the ranks are cut to ``k`` before they are shuffled by query
    as well as after.
    """
    blocks, n = packed(whole_vectors(vectors, scale), BLOCK, "vector-blocks")
    asked, m = packed(whole_vectors(queries, scale).distinct(), QUERY_BLOCK, "query-blocks")
    candidates, questions, count = cells(blocks, n, asked, m)
    key = ["block", "part", "dim"]
    left, right = (side.repartition(count, *key).groupBy(*key) for side in (candidates, questions))
    best = left.cogroup(right).applyInArrow(_search(k, scale), "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
