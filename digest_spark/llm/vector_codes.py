"""Compression of vectors to one code a part, by Hamerly's Lloyd iterations on integers.

Vectors are cut into equal parts, and each part position has a codebook. A part carries its code,
an upper bound of the distance to its codebook entry and a lower bound of that to the second
nearest, in a table that is written each round. When entries have moved, the bounds are widened by
how far; only where they no longer part strictly is a part compared with all entries again, in
exact integers. As the first smallest distance counts, ties go to the lower index with and
without bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digest_spark.llm.shared import dropped, written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Bounds are widened by this share, far more than a float's rounding.
SLACK = 2.0**-40
#: Below this, sums of products are exact in floats.
EXACT = 1 << 53
#: Labels up to so many (a long and a sum each) are broadcast with their sums.
BROADCAST_LABELS = 200_000
STATE = "vec_id long, label {}, v array<int>, code array<int>, upper array<double>, lower array<double>"


@dataclass
class Codebooks:
    """Integer entries (part, entry, component), how far each moved in the last round, and half its distance to its neighbour."""

    entries: np.ndarray
    moved: np.ndarray
    half: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, before: np.ndarray | None = None) -> Codebooks:
        gap = entries - (entries if before is None else before)
        half = np.full(entries.shape[:2], np.inf)
        if entries.shape[1] > 1:
            for p, book in enumerate(entries):
                square = distances(book, book).astype(np.float64)
                np.fill_diagonal(square, np.inf)
                half[p] = np.sqrt(square.min(1)) / 2 * (1 - SLACK)
        return cls(entries, np.sqrt((gap.astype(np.float64) ** 2).sum(2)) * (1 + SLACK), half)

    def digest(self) -> str:
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries, exact: by float products while no sum can leave the exact range."""
    reach = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * reach * reach * max(1, x.shape[1]) < EXACT else np.int64
    a, b = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code of each row (the first of equally near ones), its squared distance, and the lower bound of the second nearest."""
    square = distances(x, entries)
    rows, code = np.arange(len(x)), square.argmin(1)
    best = square[rows, code]
    if len(entries) == 1:
        return code, best, np.full(len(x), np.inf)
    square[rows, code] = np.iinfo(np.int64).max
    return code, best, np.sqrt(square.min(1)) * (1 - SLACK)


def assign(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, p: int, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Code and bounds of the parts x at position p after the entries moved, and how many parts were compared with all entries."""
    entries, moved = books.entries[p], books.moved[p]
    upper, code = (upper + moved[code]) * (1 + SLACK), code.copy()
    # a part's own entry moves its upper bound; the farthest move of the others lowers the lower one
    order = np.argsort(-moved, kind="stable")
    most = np.where(code == order[0], moved[order[1]] if len(order) > 1 else 0.0, moved[order[0]])
    lower = (lower - most) * np.where(lower > most, 1 - SLACK, 1 + SLACK)
    apart = np.maximum(lower, books.half[p][code])
    open_ = np.flatnonzero(upper >= apart)
    upper[open_] = np.sqrt(((x[open_] - entries[code[open_]]).astype(np.int64) ** 2).sum(1)) * (1 + SLACK)
    open_ = open_[upper[open_] >= apart[open_]]
    if len(open_):
        code[open_], best, lower[open_] = nearest(x[open_], entries)
        upper[open_] = np.sqrt(best) * (1 + SLACK)
    return code, upper, lower, len(open_)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel(), kind))


def assigned(state: DataFrame, books: Codebooks, label: str) -> DataFrame:
    """The state with codes and bounds for the codebooks as they are now."""
    parts, _, width = books.entries.shape
    shared = state.sparkSession.sparkContext.broadcast(books)  # entries times components: bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), parts * width, np.int64)
            code, upper, lower = matrix(batch.column("code"), parts, np.int64), matrix(batch.column("upper"), parts, np.float64), matrix(batch.column("lower"), parts, np.float64)
            for p in range(parts):
                code[:, p], upper[:, p], lower[:, p], _ = assign(v[:, p * width : (p + 1) * width], code[:, p], upper[:, p], lower[:, p], p, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), lists(code, pa.int32()), lists(upper, pa.float64()), lists(lower, pa.float64())], names=batch.schema.names)

    return state.mapInArrow(run, STATE.format(label))


def replaced(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Each entry as the floor of its parts' mean; unused ones stay. Sums are made in each task before they are shuffled."""
    parts, k, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            v, code = matrix(batch.column("v"), parts * width, np.int64).reshape(-1, width), matrix(batch.column("code"), parts, np.int64)
            at = (code + np.arange(parts) * k).ravel()
            counts += np.bincount(at, minlength=parts * k)
            np.add.at(sums, at, v)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists(sums[used], pa.int64())], names=["at", "n", "s"])

    sums = state.select("v", "code").mapInArrow(run, "at long, n long, s array<bigint>").groupBy("at").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(j))).alias(f"s{j}") for j in range(width)])
    out = entries.copy().reshape(parts * k, width)
    for row in sums.collect():  # at most one row for each entry
        out[row["at"]] = [s // row["n"] for s in row[2:]]
    return out.reshape(parts, k, width)


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of each kept vector, code being an array of indexes by part; and the codebooks.

    Vectors that are null or hold null or non-finite components are left out. Components become
    floor(scale * x). The codebooks start from the vectors of the smallest ids, rows without an id
    last and equal ids by their vectors, and are fewer if the rows are. Vectors that are shorter than the longest, or
    whose length does not divide, end in zeros. Repeated rows get the same code. Components so large that a squared
    distance could leave 64 bits raise ValueError. An empty table gives no rows and empty codebooks.
    """
    finite = F.forall(vectors[vector], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.where(vectors[vector].isNotNull() & finite).select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].alias("label"), F.transform(vectors[vector].cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), F.array_max(F.transform(vectors[vector].cast("array<double>"), lambda x: F.abs(x))).alias("reach"))
    most = own.agg(F.max(F.size("v")).alias("length"), F.max("reach").alias("reach")).first()
    width = -(-(most["length"] or 0) // parts)
    limit = min((1 << 31) - 1, int((2.0**61 / max(1, width)) ** 0.5 / 2))
    if (most["reach"] or 0) * scale >= limit:
        raise ValueError(f"a component of {most['reach']:g} times {scale} is out of range: the limit is {limit}")
    kind = vectors.schema[label].dataType.simpleString()
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v"))).cast("array<int>")
    own = own.select("vec_id", "label", padded.alias("v"))
    first = own.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    if not first or not width:
        books = Codebooks.of(np.zeros((parts, max(1, len(first)), 0), np.int64))
        return own.select("vec_id", "label", F.array_repeat(F.lit(0), parts).alias("code"), F.lit(0).cast("long").alias("error")), books
    start = np.array([r["v"] for r in first], np.int64)
    books = Codebooks.of(start.reshape(len(first), parts, width).transpose(1, 0, 2))
    blank = own.select("*", F.array_repeat(F.lit(0), parts).alias("code"), F.array_repeat(F.lit(float("inf")), parts).alias("upper"), F.array_repeat(F.lit(0.0), parts).alias("lower"))
    state = blank
    for k in range(rounds + 1):
        now = written(assigned(state, books, kind))
        if k:
            dropped(state)
        state = now
        if k < rounds:
            books = Codebooks.of(replaced(state, books.entries), books.entries)
    return errors(state, books, kind), books


def errors(state: DataFrame, books: Codebooks, label: str) -> DataFrame:
    """(vec_id, label, code, error): the squared distances of all parts summed."""
    parts, _, width = books.entries.shape
    shared = state.sparkSession.sparkContext.broadcast(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, code = matrix(batch.column("v"), parts * width, np.int64).reshape(-1, parts, width), matrix(batch.column("code"), parts, np.int64)
            gap = v - shared.value[np.arange(parts)[None, :], code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("code"), pa.array((gap**2).sum((1, 2)))], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "v", "code").mapInArrow(run, f"vec_id long, label {label}, code array<int>, error long")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = written(found)
    sums = rows.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    code = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x.cast("long")), 2, "0"))), "")
    out = rows.join(sums, rows["label"].eqNullSafe(sums["__label"]))
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _round(n: int) -> str:
    """SQL of one assignment and replacement: codebook b{n} to assignment a{n} and codebook b{n + 1}."""
    square = "list_inner_product({0}, {0})"
    return f"""
a{n} AS (
    SELECT vec_id, label, part, x, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
    FROM (SELECT p.vec_id, label, p.part, x, entry, CAST({square.format("CAST(x AS DOUBLE[])")} - 2 * list_inner_product(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])) + {square.format("CAST(y AS DOUBLE[])")} AS BIGINT) AS d
          FROM p JOIN b{n} b ON b.part = p.part) GROUP BY ALL
), s{n} AS (
    SELECT part, entry, pos, CAST(sum(z) AS BIGINT) AS s, count(*) AS c FROM (SELECT part, entry, unnest(x) AS z, generate_subscripts(x, 1) AS pos FROM a{n}) GROUP BY ALL
), m{n} AS (
    SELECT part, entry, list((s - ((s % c) + c) % c) // c ORDER BY pos) AS y FROM s{n} GROUP BY ALL
), b{n + 1} AS (
    SELECT part, entry, coalesce(m.y, b.y) AS y FROM b{n} b LEFT JOIN m{n} m USING (part, entry)
)"""


#: Vectors of equal lengths that four divides.
OP12_SQL = f"""
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT vec_id, label, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM v, (SELECT unnest([0, 1, 2, 3]) AS part)
), b0 AS (
    SELECT part, r AS entry, x AS y FROM (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS r FROM p) WHERE r < 256
), {",".join(_round(n) for n in range(ROUNDS + 1))}, books AS (
    SELECT sha256(string_agg(c, ',' ORDER BY part, entry, pos)) AS h FROM (SELECT part, entry, unnest(y) AS c, generate_subscripts(y, 1) AS pos FROM b{ROUNDS})
), coded AS (
    SELECT vec_id, label, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY ALL
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books
"""
