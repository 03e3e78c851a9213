"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are lists of integer weights, one for each term (component). Queries and candidates meet
in a grid of cells, each with a block of queries and a group of candidates. In a cell the
candidates stream by in chunks with postings for each term; each query's weight for the term is
scattered, times the postings' weights, into dense score arrays. Partition selection keeps each
query's best of the chunk, and the cells' lists are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
QUERY_EVERY = 50
#: Queries in a cell; candidates in a cell, total / GROUPS within these bounds.
QUERY_BLOCK = 4096
GROUPS, LEAST_GROUP, LARGEST_GROUP = 2000, 8192, 1 << 20
CHUNK = 4096
QUERIES_AT_ONCE = 128


def weights(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * x) of every component, as Python's integers if any leaves 62 bits; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (np.abs(flat) < 1 << 62).all():
        flat = flat.astype(np.int64)
    else:
        if not np.isfinite(flat).all():
            raise OverflowError(f"{scale} times a component is no finite number")
        flat = np.array([int(x) for x in flat], object)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), flat.dtype)
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def accumulate(queries: np.ndarray, chunk: np.ndarray) -> np.ndarray:
    """Scores of all queries against a chunk, one term after the other; as Python's integers if longs may not hold them."""
    terms = min(queries.shape[1], chunk.shape[1])
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(chunk).max(initial=0)) * max(terms, 1)
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    scores = np.zeros((len(queries), len(chunk)), kind)
    part = np.empty_like(scores)
    queries, columns = queries.astype(kind), np.ascontiguousarray(chunk.T.astype(kind))
    for t in range(terms):
        asked, posted = np.flatnonzero(queries[:, t]), np.flatnonzero(columns[t])
        if len(asked) > 0.9 * len(queries) and len(posted) > 0.9 * len(chunk):
            np.multiply(queries[:, t, None], columns[t], out=part)
            scores += part
        elif len(asked) and len(posted):
            scores[np.ix_(asked, posted)] += queries[asked, t, None] * columns[t][posted]
    return scores


def as_longs(scores: np.ndarray) -> np.ndarray:
    if scores.dtype != object:
        return scores
    if any(not -(1 << 63) <= x < 1 << 63 for x in scores):
        raise OverflowError("a score is out of the range of 64 bits")
    return scores.astype(np.int64)


def top_k(vectors: DataFrame, is_query: Column, k: int = K, *, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k highest inner products with rows of another id.

    Rows whose id or vector is null, or whose vector holds null or non-finite components, take no
    part. A row that is repeated is a candidate each time. A query id that is repeated asks once,
    with the smallest of its vectors. An empty vector scores 0. Fewer candidates than k give fewer
    rows; no query, or an empty table, gives none. Weights of any size are multiplied exactly; a score that a long
    cannot hold fails the run. Other columns are not read.
    """
    finite = F.forall(vectors[vector], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(vectors[vec_id].isNotNull() & vectors[vector].isNotNull() & finite).select(vectors[vec_id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("v"), is_query.alias("asks"))
    n = own.agg(F.count("*").alias("all"), F.count_if("asks").alias("asking")).first()
    groups = max(1, -(-n["all"] // min(LARGEST_GROUP, max(LEAST_GROUP, n["all"] // GROUPS))))
    blocks = max(1, -(-n["asking"] // QUERY_BLOCK))
    asking = own.where("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = asking.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), F.lit(0).alias("kind"), "vec_id", "v")
    # which group a row goes to does not change the result
    there = own.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    there = there.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "part", F.lit(1).alias("kind"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        ids = found = found_scores = queries = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            first = int(np.searchsorted(kinds, 1))
            if first:
                asked.append(batch.slice(0, first))
            if first == len(kinds) or not asked:
                continue
            if queries is None:
                table = pa.Table.from_batches(asked)
                ids, queries = table.column("vec_id").to_numpy(), weights(table.column("v"), scale)
                found, found_scores = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
            for at in range(first, len(kinds), CHUNK):
                part = batch.slice(at, min(CHUNK, len(kinds) - at))
                chunk_ids, chunk = part.column("vec_id").to_numpy(), weights(part.column("v"), scale)
                for a in range(0, len(ids), QUERIES_AT_ONCE):
                    scores = accumulate(queries[a : a + QUERIES_AT_ONCE], chunk)
                    for q, row in enumerate(scores, a):
                        if (mine := chunk_ids == ids[q]).any():
                            kept = np.flatnonzero(~mine)
                            row[mine] = 0
                            row = as_longs(row)
                            own_best = kept[best(row[kept], chunk_ids[kept], k)]
                        else:
                            row = as_longs(row)
                            own_best = best(row, chunk_ids, k)
                        both, both_scores = np.concatenate([found[q], chunk_ids[own_best]]), np.concatenate([found_scores[q], row[own_best].astype(np.int64)])
                        top = best(both_scores, both, k)
                        found[q], found_scores[q] = both[top], both_scores[top]
        if queries is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in found])), pa.array(np.concatenate(found)), pa.array(np.concatenate(found_scores))], names=["query_id", "vec_id", "score"])

    cells = asking.union(there).repartitionById(blocks * groups, F.col("block") * groups + F.col("part")).sortWithinPartitions("kind")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.mapInArrow(run, "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors["vec_id"] % QUERY_EVERY == 0)


OP9_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
