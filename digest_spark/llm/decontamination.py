"""Benchmark decontamination by a prefix-filtered set join of word windows.

Every run of `window` consecutive words of a benchmark item is a window (a shorter item is one
window). A document contains a window only if it contains all its words, so it is enough to look
at the prefix of one word: the window's words are ordered by rarity in the corpus and the rarest
is its token. Wherever a document has that word, the positional bound gives the one place where
the window can stand, the length bound drops places that leave the text, and the words there are
compared exactly.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digest_spark.llm.arrowtext import by_bytes
from digest_spark.llm.shared import small_batches, written

WINDOW = 10
BATCH_BYTES = 8 << 20
#: Benchmark items are broadcast in blocks of so many bytes of text at most (one item at least).
BLOCK_BYTES = 16 << 20
#: So many blocks are looked for in one pass over the documents.
BLOCKS_A_PASS = 4

#: Word characters are all but ASCII other than digits and letters; A-Z are lower-cased.
WORD_TABLE = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()


def windows_of(words: list[bytes], size: int) -> list[list[bytes]]:
    return [words[k : k + size] for k in range(max(1, len(words) - size + 1))] if words else []


class Windows:
    """The windows of a block of items, by their rarest words."""

    def __init__(self, items: list[tuple[str | None, str | None]], counts: dict[bytes, int], size: int):
        self.items: dict[bytes, set[str]] = {}
        self.offsets: dict[bytes, set[tuple[int, int]]] = {}  # rarest word -> (its place in a window, the window's length)
        for item, text in items:
            for window in windows_of(words_of(text), size):
                self.items.setdefault(b" ".join(window), set()).update([] if item is None else [item])
                place = min(range(len(window)), key=lambda k: (counts.get(window[k], 0), window[k], k))
                self.offsets.setdefault(window[place], set()).add((place, len(window)))

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Where windows stand, as (first word, word after the last), and the items they are from."""
        spans, items, n = set(), set(), len(words)
        for at in [k for k, w in enumerate(words) if w in self.offsets]:
            for place, size in self.offsets[words[at]]:
                start = at - place
                if start >= 0 and start + size <= n and (start, start + size) not in spans:
                    found = self.items.get(b" ".join(words[start : start + size]))
                    if found is not None:
                        spans.add((start, start + size))
                        items |= found
        return sorted(spans), items


def word_counts(docs: DataFrame, text: str, vocabulary: Broadcast) -> DataFrame:
    """(word, n): how often the words of the vocabulary occur in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        known = vocabulary.value.__contains__
        for batch in by_bytes(batches, "t", BATCH_BYTES):
            for x in batch.column("t").to_pylist():
                total.update(filter(known, words_of(x)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return docs.select(docs[text].alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def item_blocks(items: DataFrame, most: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items (id as string, text) in blocks of about `most` bytes; one block is held at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        n = len((row["text"] or "").encode())
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += n
    if block:
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each row's columns `keep` with n_words, spans (array of [first, after) word places that
    windows occupy), items (sorted ids, as strings, of the items with occurring windows) and n_hit
    (words inside any span).

    Null texts have no words; an item without words has no window; an item whose id is null hits
    but is not named; equal items are all named. Repeated documents are rows of their own. The
    benchmark is broadcast in blocks of bounded size; a larger one takes more passes. Documents
    are not shuffled. Columns of docs named as those made here are left out.
    """
    spark = docs.sparkSession
    made = ("n_words", "spans", "items", "n_hit")
    kept = [c for c in keep if c not in made and c != text]
    own = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<int>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = own.schema
    items = benchmark.select(benchmark[item_id].cast("string").alias("id"), benchmark[item_text].alias("text"))

    def look(frame: DataFrame, blocks: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = blocks.value
            for batch in by_bytes(batches, "__text", BATCH_BYTES):
                n, spans, names = [], [], []
                for t, old_spans, old_names in zip(batch.column("__text").to_pylist(), batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
                    words = words_of(t)
                    here, found = windows.find(words)
                    n.append(len(words))
                    spans.append(sorted({*map(tuple, old_spans), *here}))
                    names.append(sorted({*old_names, *found}))
                arrays = [batch.column(c) for c in (*kept, "__text")] + [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

        return small_batches(frame).mapInArrow(run, schema)

    out, passes = own, 0
    blocks = item_blocks(items, block_bytes)
    block = next(blocks, [])
    while block or not passes:
        vocabulary = {w for _, t in block for w in words_of(t)}
        counts = {bytes(r["word"]): r["n"] for r in word_counts(docs, text, spark.sparkContext.broadcast(vocabulary)).toLocalIterator()} if vocabulary else {}
        out = look(out, spark.sparkContext.broadcast(Windows(block, counts, window)))
        passes += 1
        block = next(blocks, [])
        if block and passes % BLOCKS_A_PASS == 0:
            out = written(out)

    ordered = F.array_sort("spans")
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    n_hit = F.aggregate(
        ordered, first, lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x[1] - F.greatest(x[0], s["end"]))).alias("n"), F.greatest(s["end"], x[1]).alias("end")), lambda s: s["n"]
    )
    columns = [F.col("__text").alias(c) if c == text else F.col(c) for c in keep if c not in made]
    return out.select(*columns, "n_words", "spans", "items", n_hit.alias("n_hit"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=("doc_id",))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no benchmark window occurs."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(docs.columns))
    return found.where("n_hit = 0").select(*docs.columns)


OP5_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark
), win AS (
    SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[k : k + 9], ' ') AS s
    FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS k FROM b WHERE len(w) > 0)
), sizes AS (
    SELECT DISTINCT n FROM win
), runs AS (
    SELECT r, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)
), found AS (
    SELECT r, k, runs.n, item FROM runs JOIN win ON runs.s = win.s AND runs.n = win.n
), hit AS (
    SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM found) GROUP BY r
), named AS (
    SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT r, item FROM found WHERE item IS NOT NULL) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
