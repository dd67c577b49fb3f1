"""Exact top-k by inner product: columnar branch and bound.

Candidates lie in vertical layout, one array per dimension. For each query the
dimensions are taken in blocks, those with most of the query's mass first; partial
scores grow block by block, and after each block a candidate survives only if its
score plus the most that the remaining masses allow (Cauchy-Schwarz on the rest of both
vectors) still reaches the query's k-th best so far. Survivors are compacted, so later
blocks touch few candidates. All numbers are integers, exact in double precision.

The queries go to the tasks in passes of at most ``PASS_BYTES``, one after another, so the
driver holds one pass at a time; each pass scans the candidates once, every task keeps the k
best of its part for every query, and a window per query merges the parts. Blocks whose
products leave the exact range of doubles are multiplied as whole integers instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumen.llm.common import read_table, written_in_turn

SCALE = 1024
PASS_BYTES = 8 << 20
#: Candidates of one block; dimensions of one step; candidates that give the first bounds.
BLOCK, STEP, SEEDS = 2048, 8, 1024
EXACT = float(2 ** 53)
LONG = (-2 ** 63, 2 ** 63 - 1)


def quantized(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) as a (rows x dims) matrix; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), np.float64)
    out = np.zeros((len(column), dims))
    row = np.repeat(np.arange(len(column)), size)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row, at] = np.floor(SCALE * flat)
    return out


class Search:
    """The running k best of a set of queries over blocks of candidates."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, seed_ids: np.ndarray, seeds: np.ndarray) -> None:
        self.ids, self.q, self.k = ids, queries, k
        n, dims = queries.shape
        self.largest = float(np.abs(queries).max()) if queries.size else 0.0
        self.steps = [slice(i, min(i + STEP, dims)) for i in range(0, dims, STEP)] or [slice(0, 0)]
        # beyond the exact range every block is wide and masses are not read
        masses = queries if self.largest < EXACT else np.zeros_like(queries)
        mass = np.stack([(masses[:, s] ** 2).sum(1) for s in self.steps], 1)
        self.order = np.argsort(-mass, axis=1, kind="stable")
        ordered = np.take_along_axis(mass, self.order, 1)
        self.rest = np.sqrt(np.maximum(ordered.sum(1)[:, None] - np.cumsum(ordered, 1), 0))
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * n
        # the seeds are candidates: their scores bound the k-th best from below
        self.bound = np.full(n, -np.inf)
        if len(seeds) > k and dims and not self._wide(seeds):
            for i in range(0, n, SEEDS):
                s = queries[i:i + SEEDS] @ seeds.T
                s[ids[i:i + SEEDS, None] == seed_ids[None, :]] = -np.inf
                self.bound[i:i + SEEDS] = -np.partition(-s, k - 1, axis=1)[:, k - 1]

    def _wide(self, rows: np.ndarray) -> bool:
        largest = float(np.abs(rows).max()) if rows.size else 0.0
        return max(self.largest, largest) >= EXACT or self.largest * largest * max(1, rows.shape[1]) >= EXACT

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if self._wide(rows):
            return self._add_wide(ids, rows)
        columns = np.ascontiguousarray(rows.T)
        mass = [(columns[s] ** 2).sum(0) for s in self.steps]
        total = reduce(np.add, mass)
        for i in range(len(self.q)):
            alive, score, rest = None, 0.0, total
            for turn, b in enumerate(self.order[i]):
                s = self.steps[b]
                block = columns[s] if alive is None else columns[s, :][:, alive]
                score = score + self.q[i, s] @ block
                rest = rest - (mass[b] if alive is None else mass[b][alive])
                most = score + self.rest[i, turn] * np.sqrt(np.maximum(rest, 0)) * (1 + 1e-9) + 1e-3
                keep = most >= self.bound[i]
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score, rest = score[keep], rest[keep]
                    if not len(alive):
                        break
            if alive is None:
                alive = np.arange(len(ids))
            if len(alive):
                self._merge(i, score, ids[alive])

    def _add_wide(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Components too large for exact doubles: Python integers."""
        whole = np.array([[int(x) for x in r] for r in rows], dtype=object).reshape(rows.shape)
        for i, q in enumerate(self.q):
            score = whole @ np.array([int(x) for x in q], dtype=object)
            self._merge(i, np.asarray(score, dtype=object), ids)

    def _merge(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        own = ids != self.ids[i]
        score, ids = np.concatenate((self.best[i][0], score[own])), np.concatenate((self.best[i][1], ids[own]))
        top = np.lexsort((ids, -score))[:self.k]
        self.best[i] = score[top], ids[top]
        if len(top) == self.k:
            self.bound[i] = max(self.bound[i], _at_most(score[top[-1]]))


def _at_most(score: float | int) -> float:
    """A double that is not above ``score``: itself while exact."""
    if abs(score) < EXACT:
        return float(score)
    near = float(min(max(int(score), -10 ** 308), 10 ** 308))
    return -np.inf if score < -10 ** 307 else near - abs(near) * 1e-12


def _order_key(score: int) -> str | None:
    """Text that sorts as the integers outside 64 bits do: sign, number of digits, digits
    (negative: complements); null for those inside."""
    if LONG[0] <= score <= LONG[1]:
        return None
    digits = str(abs(score))
    if score > 0:
        return f"{len(digits):04d}{digits}"
    return f"{9999 - len(digits):04d}" + "".join(str(9 - int(c)) for c in digits)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` (vec_id, embedding)
    its ``k`` best rows of ``rows``, ties to the smaller vec_id, fewer if there are fewer.

    Rows with the query's vec_id are its own and left out. Rows without vec_id, and
    vectors that are null or hold null or non-finite components (before or after scaling),
    take no part. Ranks follow the exact scores at any size; a score beyond 64 bits is
    reported as the nearest long. Shorter vectors count as ending in zeros. Repeated rows are candidates each; repeated query
    rows are one query. Extra columns are ignored; an empty table gives no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                      & (F.abs(x.cast("double") * SCALE) != float("inf")))
    queries, rows = (t.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite) for t in (queries, rows))
    queries = queries.distinct()
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dims")).first()
    dims = max(size["dims"], rows.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0])
    passes = max(1, -(-size["n"] * max(dims, 1) * 8 // PASS_BYTES))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(passes))
    first = rows.select("vec_id", "embedding").limit(SEEDS).toArrow()
    seed_ids = np.asarray(first.column("vec_id"), np.int64)
    seeds = quantized(first.column("embedding"), dims) if len(seed_ids) else np.zeros((0, dims))
    schema = "query_id long, query_no long, vec_id long, score long, side int, beyond string"

    def scan(number: int) -> DataFrame:
        table = queries.where(part == number).orderBy("vec_id").toArrow()
        ids = np.asarray(table.column("vec_id"), np.int64)
        matrix = quantized(table.column("embedding"), dims) if len(ids) else np.zeros((0, dims))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(ids, matrix, k, seed_ids, seeds)
            for batch in batches:
                own = np.asarray(batch.column("vec_id"), np.int64)
                x = quantized(batch.column("embedding"), dims)
                for i in range(0, len(own), BLOCK):
                    search.add(own[i:i + BLOCK], x[i:i + BLOCK])
            count = [len(b[1]) for b in search.best]
            if sum(count):
                no = np.repeat(np.arange(len(ids)), count)
                scores = [int(s) for b in search.best for s in b[0]]
                inside = [min(max(s, LONG[0]), LONG[1]) for s in scores]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[no]), pa.array(no * passes + number),
                     pa.array(np.concatenate([b[1] for b in search.best])),
                     pa.array(inside, pa.int64()),
                     pa.array([(s > t) - (s < t) for s, t in zip(scores, inside)], pa.int32()),
                     pa.array([_order_key(s) for s in scores], pa.string())],
                    names=["query_id", "query_no", "vec_id", "score", "side", "beyond"])

        return rows.mapInArrow(run, schema)

    found = written_in_turn(scan(p) for p in range(passes))
    rank = F.row_number().over(Window.partitionBy("query_id", "query_no").orderBy(
        F.desc("side"), F.desc("beyond"), F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    return top_k(rows.where(F.col("vec_id") % 100 == 0), rows)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
