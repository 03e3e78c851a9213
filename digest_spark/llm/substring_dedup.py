"""Substring dedup by sliding sentence spans.

A span is a run of consecutive sentences, from any sentence on, of RUN_SENTENCES sentences or
more until it has RUN_WORDS words. All spans are hashed and joined across documents; a sentence
is removed if it lies in a span that also occurs in a document with a smaller doc_id, or earlier
in its own. Sentences end at . ! ? before white space and at line ends, and before the word of
least hash among any WINDOW words in which no sentence starts. So where a text is cut depends on
the WINDOW - 1 words on either side alone, and any passage of 4 * WINDOW + RUN_WORDS - 2 words
(50) holds a whole span wherever it stands, in mid-sentence too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import by_bytes
from digest_spark.llm.decontamination import WORD_TABLE
from digest_spark.llm.shared import dropped, small_batches, text_key, written

RUN_SENTENCES = 3
RUN_WORDS = 20
WINDOW = 8
BATCH_BYTES = 4 << 20
#: Tables of so many numbers at most are broadcast, and ids that have several texts.
BROADCAST_NUMBERS, BROADCAST_IDS = 2_000_000, 200_000
BOUNDARY = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|\n\s*")
SPACE = np.isin(np.arange(256), list(b"\x20\x09\x0a\x0b\x0c\x0d"))


def least_of_window(hashes: np.ndarray) -> np.ndarray:
    """The places whose hash is the least of some WINDOW consecutive ones."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64)
    least = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW).min(axis=1)
    around = np.concatenate([np.full(WINDOW - 1, -1), least, np.full(WINDOW - 1, -1)])
    return np.flatnonzero(np.lib.stride_tricks.sliding_window_view(around, WINDOW).max(axis=1) == hashes)


def sentences(text: bytes) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised words, their number) of each sentence; the sentences cover the text."""
    if not text:
        return []
    flat = text.translate(WORD_TABLE)
    words = flat.split()
    inside = ~SPACE[np.frombuffer(flat, np.uint8)]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.array([0, *(m.end() for m in BOUNDARY.finditer(text)), len(text)])
    hashes = np.fromiter(map(crc32, words), np.int64, len(words)) + 1
    first = np.searchsorted(starts, ends)
    hashes[first[first < len(words)]] = 0
    chosen = starts[least_of_window(hashes)]
    # a word inside a token, as the t of don't, is cut before the token
    token = np.maximum.accumulate(np.where(SPACE[np.frombuffer(text, np.uint8)], np.arange(1, len(text) + 1), 0))
    inner = chosen[hashes[np.searchsorted(starts, chosen)] > 0]
    cuts = np.unique(np.concatenate([ends, token[inner]]))
    at = np.searchsorted(starts, cuts).tolist()
    cuts = cuts.tolist()
    return [(a, b, b" ".join(words[i:j]), j - i) for a, b, i, j in zip(cuts, cuts[1:], at, at[1:], strict=False)]


def spans(parts: list[tuple[int, int, bytes, int]]) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 128-bit hash) of every span; wordless sentences count as none."""
    full = [k for k, x in enumerate(parts) if x[3]]
    texts, sizes = [parts[k][2] for k in full], [parts[k][3] for k in full]
    out, stop, words = [], 0, 0
    for i in range(len(full)):
        stop = max(stop, i)
        while stop < len(full) and (stop - i < RUN_SENTENCES or words < RUN_WORDS):
            words += sizes[stop]
            stop += 1
        if stop - i < RUN_SENTENCES or words < RUN_WORDS:
            break
        out.append((full[i], full[stop - 1] + 1, xxhash.xxh3_128_digest(b" ".join(texts[i:stop]))))
        words -= sizes[i]
    return out


def span_table(docs: DataFrame) -> DataFrame:
    """(h, g, id, key, at, stop, again): every span by hash, its sentences, and whether its row has it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            hashes, at, stop, again, rows = [], [], [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                seen: set[bytes] = set()
                for a, b, h in spans(sentences((text or "").encode())):
                    hashes.append(h)
                    at.append(a)
                    stop.append(b)
                    again.append(h in seen)
                    rows.append(row)
                    seen.add(h)
            take = pa.array(rows, pa.int32())
            halves = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column("id").take(take), batch.column("key").take(take), pa.array(at, pa.int32()), pa.array(stop, pa.int32()), pa.array(again, pa.bool_())], names=["h", "g", "id", "key", "at", "stop", "again"])

    return small_batches(docs).mapInArrow(run, "h long, g long, id long, key long, at int, stop int, again boolean")


def ordered(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """The rows with __k, a key of the text, and __id, a long that orders documents and tells them apart.

    That is the doc_id. Of rows that share it, those with another text than the one of least key come behind
    all others, by a hash of both, and rows without a doc_id behind these.
    """
    key = text_key(docs[text])
    own = docs[doc_id].cast("long")
    shared = docs.select(own.alias("__shared"), key.alias("k")).where("__shared is not null").groupBy("__shared").agg(F.min("k").alias("__least"), F.max("k").alias("k")).where("__least < k").drop("k")
    shared = F.broadcast(shared) if shared.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else shared
    behind = F.lit(1 << 61) + F.shiftrightunsigned(F.xxhash64("__shared", "__k"), 3)
    place = F.when(own.isNull(), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("__k"), 2)).when(F.col("__least") != F.col("__k"), behind).otherwise(own)
    return docs.withColumn("__k", key).join(shared, own == shared["__shared"], "left").withColumn("__id", place).drop("__shared", "__least")


def dedup_substrings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows with their text less the sentences in repeated spans, and their number, n_removed.

    doc_id is an integer below 2 ** 61. Rows with one doc_id and text are one document: what they share is no
    repeat. Rows with one doc_id and different texts, and rows without one, are documents of their own, which
    come last (see ordered). Null texts stay null. A column of docs named n_removed is
    replaced. An empty table gives no rows. A text of any length is cut in one piece.
    """
    placed = ordered(docs, text, doc_id)
    own = placed.select(F.col("__id").alias("id"), F.col("__k").alias("key"), F.col(text).alias("text"))
    found = written(span_table(own))
    # written by itself, so that the shuffles of the aggregate and of the join are not on disk at once
    repeated = written(found.groupBy("h", "g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("h", "g", "first"))
    elsewhere = found.where("not again").join(repeated, ["h", "g"]).where("id > first")
    places = elsewhere.select("id", "key", "at", "stop").union(found.where("again").select("id", "key", "at", "stop"))
    gone = written(places.groupBy("id", "key").agg(F.collect_set(F.array("at", "stop")).alias("__at")).toDF("__gone", "__key", "__at"))
    dropped(found)
    size = gone.agg(F.sum(2 * F.size("__at") + 2).alias("n")).first()["n"] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_NUMBERS else gone
    kept = [c for c in docs.columns if c not in ("n_removed", text)]
    joined = placed.join(gone, (F.col("__id") == F.col("__gone")) & (F.col("__k") == F.col("__key")), "left")
    rows = joined.select(*kept, F.col(text).alias("__text"), F.coalesce("__at", F.array().cast("array<array<int>>")).alias("__at"))
    schema = T.StructType([*rows.select(*kept).schema, T.StructField("__text", T.StringType()), T.StructField("n_removed", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            texts, removed = batch.column("__text").to_pylist(), [0] * batch.num_rows
            for i, at in enumerate(batch.column("__at").to_pylist()):
                if at:
                    raw = texts[i].encode()
                    parts = sentences(raw)
                    drop = {k for a, b in at for k in range(a, b) if parts[k][3]}
                    texts[i] = b"".join(raw[a:b] for k, (a, b, _, _) in enumerate(parts) if k not in drop).decode()
                    removed[i] = len(drop)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=schema.names)

    out = small_batches(rows).mapInArrow(run, schema)
    return out.select(*[F.col("__text").alias(c) if c == text else F.col(c) for c in docs.columns if c != "n_removed"], "n_removed")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_substrings(docs).select("doc_id", "n_removed", "text")
