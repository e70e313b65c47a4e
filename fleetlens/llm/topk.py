"""Exact top-k search by inner product with a pivot table.

Components are turned into whole numbers. For every vector its distances to the pivots are
computed once. They tell where a vector lies in the space the pivots span and how far it
is from that space. For a query ``q`` and a candidate ``x`` with places ``a`` and ``b`` in that space and
distances ``r`` and ``s`` from it, ``|a - b|^2 + (r - s)^2`` is the largest lower bound of their squared
distance that these distances allow, at least that of every single pivot or pair. It gives the upper
bound ``a.b + r s`` of the inner product. Candidates are evaluated in the order of that bound until the
k-th best score is out of reach of the next one.

Queries and candidates meet in blocks: every vector has a block number; a block of
candidates and a block of queries are one task's work and give at most ``k`` rows per
query. Blocks have a bounded number of vectors, so memory does not depend on the input.
The k-th best score of the pool starts each query's threshold, in every block.

Pivots are chosen from the ``POOL`` vectors with the smallest hash of their id, farthest
first; this sets the speed only, results are exact for any pivots. Where a score could pass 2^53 it is
computed in Python's whole numbers and its candidate is not subject to bounds.

Edge cases: vectors that are null or hold null or non-finite components take no
part; an empty vector takes part, with scores of zero; shorter vectors count as padded with zeros;
ties in score go to the smaller id; a query never finds a row of its own id; rows that repeat an id are
candidates each; rows with a null id take no part; a query without candidates, and an empty
table, give no rows; other columns are not read. A score that is returned must fit a long.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.llm.common import map_batches, staged

K = 5
SCALE = 256
PIVOTS = 48
POOL = 2048
CANDIDATES = 4096
QUERIES = 4096
# Queries whose bounds are computed together.
AT_ONCE = 256
# Candidates evaluated at once in the order of their bounds.
STEP = 64
EXACT = float(1 << 53)
# Components beyond it are left to whole numbers altogether.
LARGE = float(1 << 40)
# Directions of the pivots' space that are too short to be told from rounding.
SHORT = 1e-4


def taking_part(docs: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` of each vector that takes part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return docs.where(F.col(id_col).isNotNull() & v.isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v")
    )


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = max(int(sizes.max(initial=0)), width or 0)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def whole_numbers(row: np.ndarray, scale: int) -> list[int]:
    """``floor(scale * x)`` of each component, exactly."""
    return [int(x) * scale if abs(x) >= 2.0**52 else int(np.floor(x * scale)) for x in row.tolist()]


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def farthest(pool: np.ndarray, count: int) -> np.ndarray:
    """Rows of the pool, each the farthest from those before it."""
    picked, near = [0], np.full(len(pool), np.inf)
    while len(picked) < min(count, len(pool)):
        near = np.minimum(near, ((pool - pool[picked[-1]]) ** 2).sum(axis=1))
        if near.max() == 0:
            break
        picked.append(int(near.argmax()))
    return np.array(picked)


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(vectors.shape[1], pivots.shape[1])
    a, b = widened(vectors, width), widened(pivots, width)
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


class Space:
    """The space the pivots span: places in it from distances to the pivots."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        left, sizes, _ = np.linalg.svd(pivots, full_matrices=False)
        own = sizes > SHORT * sizes.max(initial=0)
        self.turn = left[:, own] / sizes[own]
        self.squares = (pivots**2).sum(axis=1)

    def places(self, table: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates of vectors, by distances to the pivots and own squares, and distances from the space."""
        products = (squares[:, None] + self.squares[None, :] - table**2) / 2
        at = products @ self.turn
        return at, np.sqrt(np.maximum(squares - (at**2).sum(axis=1), 0))


def scores_of(rows: np.ndarray, raw: np.ndarray, tops: np.ndarray, query: np.ndarray, raw_query: np.ndarray, scale: int) -> list[int]:
    """Exact inner products: in doubles where they stay below 2^53, else in whole numbers."""
    width = max(len(query), 1)
    safe = tops * np.abs(query).max(initial=0) * width < EXACT
    if safe.all():
        return (rows @ query).astype(np.int64).tolist()
    own = whole_numbers(raw_query, scale)
    return [
        int(row @ query) if ok else sum(a * b for a, b in zip(whole_numbers(exact, scale), own))
        for row, exact, ok in zip(rows, raw, safe)
    ]


def best_of(ids, upper: np.ndarray, qid: int, start: float, k: int, scores) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, id) of one block, in the order of their bounds, and how many were evaluated.

    ``scores`` gives the exact scores of candidates by place.
    """
    open_ = np.flatnonzero((upper >= start) & (ids != qid))
    order = open_[np.argsort(-upper[open_], kind="stable")]
    top: list[tuple[int, int]] = []
    done = 0
    for at in range(0, len(order), STEP):
        part = order[at : at + STEP]
        least = max(start, top[-1][0]) if len(top) == k else start
        part = part[upper[part] >= least]
        if not len(part):
            break
        done += len(part)
        found = [(s, i) for s, i in zip(scores(part), ids[part].tolist()) if s >= least]
        top = sorted(top + found, key=lambda x: (-x[0], x[1]))[:k]
    return top, done


class Block:
    """Candidates of one block with what their bounds need."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, table: np.ndarray, space: Space | None, scale: int):
        self.ids, self.raw, self.scale, self.space = ids, raw, scale, space
        self.rows = np.floor(raw * scale)
        self.tops = np.abs(self.rows).max(axis=1, initial=0)
        self.squares = (np.where(self.tops[:, None] < LARGE, self.rows, 0) ** 2).sum(axis=1)
        if space is not None:
            self.places, self.off = space.places(np.where(self.tops[:, None] < LARGE, table, 0), self.squares)

    def bounds(self, other: Block) -> np.ndarray:
        """Upper bounds of the products of these rows and the other's, one row for each of these."""
        if self.space is None:
            return np.full((len(self.ids), len(other.ids)), np.inf)
        upper = self.places @ other.places.T + self.off[:, None] * other.off[None, :]
        # Rounding must not lower a bound.
        upper += 1e-6 * (self.squares[:, None] + other.squares[None, :]) + 1
        # What is beyond doubles is evaluated whatever the bound.
        width = max(self.rows.shape[1], 1)
        upper[self.tops[:, None] * other.tops[None, :] * width >= EXACT] = np.inf
        upper[self.tops >= LARGE] = np.inf
        upper[:, other.tops >= LARGE] = np.inf
        return upper

    def search(self, queries: Block, starts: np.ndarray, k: int) -> tuple[list[tuple[int, int, int]], int]:
        """(query, id, score) of the k best of each query, and how many candidates were evaluated."""
        out, done = [], 0
        for at in range(0, len(queries.ids), AT_ONCE):
            some = queries.part(slice(at, at + AT_ONCE))
            for i, upper in enumerate(some.bounds(self)):
                exact = partial(self.scores, some, i)
                top, count = best_of(self.ids, upper, int(some.ids[i]), starts[at + i], k, exact)
                out += [(int(some.ids[i]), vec, score) for score, vec in top]
                done += count
        return out, done

    def scores(self, queries: Block, i: int, part: np.ndarray) -> list[int]:
        return scores_of(self.rows[part], self.raw[part], self.tops[part], queries.rows[i], queries.raw[i], self.scale)

    def part(self, rows: slice) -> Block:
        own = object.__new__(Block)
        own.__dict__ = {n: v[rows] if isinstance(v, np.ndarray) else v for n, v in vars(self).items()}
        return own


def search(
    docs: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    pool: int = POOL,
    candidates_per_block: int = CANDIDATES,
    queries_per_block: int = QUERIES,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the k best of each query.

    ``is_query`` is a condition on ``vec_id``. Queries that repeat an id are one query if
    their vectors are equal; else each vector is a query and the best of all count.
    """
    vectors = taking_part(docs, id_col, vector_col)
    # At most ``pool`` vectors reach the driver and go to the tasks.
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(pool).toArrow()
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not sample.num_rows:
        return empty
    pooled = np.floor(matrix(sample.column("v").combine_chunks()) * scale)
    usual = pooled[np.abs(pooled).max(axis=1, initial=0) < LARGE]
    centres = usual[farthest(usual, pivots)] if len(usual) and usual.any() else None
    space = None if centres is None else Space(centres)
    pool_ids, pool_v = sample.column("vec_id").to_numpy(), sample.column("v").combine_chunks()

    def table_of(raw: np.ndarray) -> np.ndarray:
        rows = np.floor(raw * scale)
        large = np.abs(rows).max(axis=1, initial=0) >= LARGE
        return np.zeros((len(raw), 0)) if centres is None else distances(np.where(large[:, None], 0, rows), centres)

    def tabled(batch: pa.RecordBatch) -> dict:
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "d": list(table_of(matrix(batch.column("v"))))}

    def started(batch: pa.RecordBatch) -> dict:
        """The k-th best score in the pool of each query, rounded down."""
        v = pa.concat_arrays([batch.column("v")])
        width = max(matrix(v).shape[1], matrix(pool_v).shape[1])
        own, asked = (Block(i, matrix(m, width), np.zeros((len(i), 0)), None, scale) for i, m in ((pool_ids, pool_v), (batch.column("vec_id").to_numpy(), v)))
        starts = []
        for i, query in enumerate(asked.ids):
            others = np.flatnonzero(own.ids != query)
            found = sorted(own.scores(asked, i, others))
            starts.append(float(np.nextafter(float(found[-k]), -np.inf)) if len(found) >= k else -np.inf)
        return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "d": batch.column("d"), "start": starts}

    table = staged(map_batches(vectors, tabled, "vec_id long, v array<double>, d array<double>"), "topk-table")
    queries = table.where(is_query).dropDuplicates(["vec_id", "v"])
    queries = staged(map_batches(queries, started, "vec_id long, v array<double>, d array<double>, start double"), "topk-queries")
    # Numbers of blocks follow the number of rows, so that a block stays bounded.
    c_blocks = max(1, -(-table.count() // candidates_per_block))
    q_blocks = max(1, -(-queries.count() // queries_per_block))
    # Rows are dealt by their place, so that copies of a row are not one block.
    place = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = table.withColumn("cb", place(c_blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = queries.withColumn("qb", place(q_blocks)).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))

    def block(_, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if own.num_rows and asked.num_rows:
            sides = [[t.column(c).combine_chunks() for c in ("vec_id", "v", "d")] for t in (own, asked)]
            width = max(matrix(v).shape[1] for _, v, _ in sides)
            rows, wanted = (Block(i.to_numpy(), matrix(v, width), matrix(d), space, scale) for i, v, d in sides)
            out, _ = rows.search(wanted, asked.column("start").to_numpy(), k)
        names = ("query_id", "vec_id", "score")
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(names)})

    found = (
        left.groupBy("cb", "qb")
        .cogroup(right.groupBy("cb", "qb"))
        .applyInArrow(block, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
