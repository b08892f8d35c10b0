"""Exact top-k search by distributed histogram selection.

Queries are taken in blocks of at most QUERY_BLOCK. For each block every candidate is scored by every executor in place;
a task sends one histogram of BINS counts for each query over the query's present score range, the histograms are summed
by query, and the bin that holds the kth highest score becomes the next range. The range starts at the bound that the
largest norms give and shrinks BINS-fold each time, until its width is one score: the exact kth value. A last pass
keeps the scores above it, and of those equal to it the k smallest ids of each task; a ranked window breaks the ties by
id. So no task or driver holds more than a block's queries with BINS counts each, whatever the number of ties.

Scores are integer inner products of floor(256 * x), exact: in doubles while 2**53 bounds a pair's score, else in 64-bit
integers, and beyond those in Python's, one pair at a time. A score beyond 64 bits counts as the largest (or smallest) long.

Defined results: vectors that are null, empty, or hold null or non-finite components (or such that 256 times them is not
finite) take no part, neither do null ids.
A candidate of another length than the query's is no candidate. Repeated rows are candidates each, but a row with the
query's own id is not one; repeated query rows (id and vector) count once. Fewer than k candidates give all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import materialise, tune

#: Queries of one pass over the candidates, and bins of a histogram: what a worker holds is their product of counts.
QUERY_BLOCK, BINS = 4096, 256
#: Queries of one histogram row.
SLICE = 32
#: Candidates that are scored at once.
ROWS = 512


MOST = (1 << 63) - 1


def quantized(vectors: DataFrame, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array<double> of integers) of the vectors that take part."""
    times = F.transform(F.col(vector), lambda e: e.cast("double") * 256)
    rows = vectors.where(F.col(ids).isNotNull() & F.col(vector).isNotNull()).select(F.col(ids).cast("long").alias("id"), times.alias("v"))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = rows.where((F.size("v") > 0) & ~bad)
    # beyond 2**53 a double is an integer already
    return whole.select("id", F.transform("v", lambda e: F.when(F.abs(e) < float(1 << 53), F.floor(e).cast("double")).otherwise(e)).alias("v"))


def _matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows with the given length."""
    column = batch.column(1)
    sizes = np.diff(column.offsets.to_numpy())
    fits = sizes == width
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return batch.column(0).to_numpy(zero_copy_only=False)[fits], flat[np.repeat(fits, sizes)].reshape(-1, width)


def _scorer(q: np.ndarray):
    """Exact scores of candidates, queries by candidates, held within 64 bits."""
    high = np.abs(q).max(axis=1, initial=0)

    def score(c: np.ndarray) -> np.ndarray:
        bound = high[:, None] * np.abs(c).max(axis=1, initial=0) * (q.shape[1] * 1.0001)
        with np.errstate(over="ignore", invalid="ignore"):
            found = q @ c.T
        if bound.max(initial=0) < 1 << 53:
            return found.astype(np.int64)
        out = np.where(bound < 1 << 53, found, 0).astype(np.int64)
        for i, j in zip(*np.nonzero(bound >= 1 << 53), strict=True):
            out[i, j] = max(-MOST - 1, min(MOST, sum(int(a) * int(b) for a, b in zip(q[i].tolist(), c[j].tolist(), strict=True))))
        return out

    return score


def _pieces(ids: np.ndarray, c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(ids), ROWS):
        yield ids[at : at + ROWS], c[at : at + ROWS]


def _placed(scores: np.ndarray) -> np.ndarray:
    """Scores as unsigned numbers in the same order."""
    return scores.view(np.uint64) ^ np.uint64(1 << 63)


def _histograms(cands: DataFrame, qid: np.ndarray, q: np.ndarray, low: np.ndarray, width: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Counts of placed scores by query and bin; bin b holds low + b * width up to the next one's start. Scores beyond top
    are known from before and are left out, as are those below low."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(qid), BINS), np.int64)
        score, rows = _scorer(q), np.arange(len(qid))[:, None] * BINS
        seen = False
        for batch in batches:
            for ids, c in _pieces(*_matrix(batch, q.shape[1])):
                seen = True
                found = _placed(score(c))
                ok = (found >= low[:, None]) & (found <= top[:, None]) & (ids[None, :] != qid[:, None])
                b = ((found - low[:, None]) // width[:, None]).astype(np.int64)
                total += np.bincount((b + rows)[ok], minlength=total.size).reshape(total.shape)
        if seen:
            parts = range(0, len(qid), SLICE)
            yield pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "counts": pa.array([total[p : p + SLICE].tobytes() for p in parts], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for batch in batches:
            for x in batch.column(1):
                total = total + np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    kinds = "part int, counts binary"
    summed = cands.mapInArrow(count, kinds).groupBy("part").applyInArrow(add, kinds)
    out = np.zeros((len(qid), BINS), np.int64)
    for r in summed.collect():  # at most QUERY_BLOCK * BINS counts
        out[r.part : r.part + SLICE] = np.frombuffer(r.counts, np.int64).reshape(-1, BINS)
    return out


def _kth_values(cands: DataFrame, qid: np.ndarray, q: np.ndarray, largest: float, k: int) -> np.ndarray:
    """Each query's kth highest score, or a value below all scores when there are fewer candidates."""
    bound = [int(min(float(1 << 63), x)) for x in (np.abs(q).sum(axis=1) * largest * 1.0001 + 1).tolist()]
    zero = 1 << 63
    low = [max(0, zero - b) for b in bound]
    top = [min(2 * zero - 1, zero + b) for b in bound]
    width = [-(-(b - a + 1) // BINS) for a, b in zip(low, top, strict=True)]
    need = np.full(len(qid), k, np.int64)
    done = np.zeros(len(qid), bool)
    while not done.all():
        live = np.flatnonzero(~done)
        counts = _histograms(cands, qid[live], q[live], *(np.array([x[i] for i in live], np.uint64) for x in (low, width, top)))
        from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1]
        for i, row, upper in zip(live, counts, from_top, strict=True):
            if upper[0] < need[i]:
                done[i] = True  # fewer than k candidates: all of them
                continue
            b = int(np.flatnonzero(upper >= need[i])[-1])
            need[i] -= upper[b] - row[b]
            low[i] += b * width[i]
            top[i] = min(top[i], low[i] + width[i] - 1)
            done[i] = width[i] == 1
            width[i] = -(-width[i] // BINS)
    return np.array([x - zero for x in low], np.int64)


def _above(cands: DataFrame, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> DataFrame:
    """Scores above the kth value, and of those equal to it each task's k smallest ids."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(q)
        held: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            for ids, c in _pieces(*_matrix(batch, q.shape[1])):
                s = score(c)
                at, col = np.nonzero((s >= kth[:, None]) & (ids[None, :] != qid[:, None]))
                new = (at, ids[col], s[at, col])
                held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
                order = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(x[order] for x in held)
                first = np.searchsorted(held[0], held[0])
                short = np.arange(len(first)) - first < k
                held = tuple(x[short] for x in held)
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(qid[held[0]], pa.int64()), "vec_id": pa.array(held[1], pa.int64()), "score": pa.array(held[2], pa.int64())})

    return cands.mapInArrow(keep, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, ids: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of every query. is_query: a condition on the id, named id."""
    spark = vectors.sparkSession
    tune(spark)
    cands = materialise(quantized(vectors, ids, vector), "vectors")
    largest = cands.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v"))).alias("m")).first().m
    schema = "query_id long, rank int, vec_id long, score long"
    if largest is None:
        return spark.createDataFrame([], schema)
    # blocks by a hash of the id, about QUERY_BLOCK each; what is more in one is a block of its own
    queries = materialise(cands.where(is_query).distinct().withColumn("w", F.size("v")), "queries")
    found = []
    for r in sorted(queries.groupBy("w").count().collect()):
        blocks = 1 if r["count"] <= QUERY_BLOCK else -(-r["count"] * 9 // (QUERY_BLOCK * 8))  # room for uneven ones
        of = F.pmod(F.xxhash64("id"), F.lit(blocks))
        for block_id in range(blocks):
            for block in _blocks(queries.where((F.col("w") == r.w) & (of == block_id)).select("id", "v"), QUERY_BLOCK):
                qid = np.array([x[0] for x in block], np.int64)
                q = np.array([x[1] for x in block], np.float64)
                kth = _kth_values(cands, qid, q, largest, k)
                found.append(materialise(_above(cands, qid, q, kth, k), "found"))
    if not found:
        return spark.createDataFrame([], schema)
    both = found[0]
    for f in found[1:]:
        both = both.unionByName(f)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    block: list = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def op9_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 50 == 0)


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""
