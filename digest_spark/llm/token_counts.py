"""Token counts: lengths only, from batches balanced by bytes.

Texts are split at safe boundaries (bpe.forced_cuts: white space, and changes between letters,
digits and punctuation that no token spans), so the count of a text is the sum over its pieces. A
piece that recurs in a batch, or that the worker has met before, is counted from memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import as_binary, by_bytes, column_bytes, pieces, values
from digest_spark.llm.bpe import forced_cuts
from digest_spark.llm.shared import small_batches

TOKENIZER_FILE = "word_bpe_49k.json"
CONTEXT_TOKENS = 2048
BATCH_BYTES = 8 << 20
#: Pieces handed to the tokenizer at once hold about so many bytes.
ENCODE_BYTES = 1 << 18
CACHE_ENTRIES = 1_000_000
CACHED_PIECE_BYTES = 64


class Counter:
    """Counts tokens with one tokenizer file: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str):
        self.seen: dict[bytes, int] = {}
        self.lowers = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            self.cut = np.zeros(65536, bool)  # it puts a space before every text, so only whole texts are safe
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        tokenizer.model._resize_cache(0)  # every piece is asked for once
        self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
        self.lowers = ids("Aé") == ids("aé")
        self.cut = forced_cuts(tokenizer)

    def new_lengths(self, new: list[bytes]) -> dict[bytes, int]:
        out: dict[bytes, int] = {}
        ends = np.cumsum([len(x) + 8 for x in new])
        start, done = 0, 0
        while start < len(new):
            stop = max(start + 1, int(np.searchsorted(ends, done + ENCODE_BYTES, "right")))
            part = new[start:stop]
            out.update(zip(part, self.lengths([x.decode() for x in part]), strict=True))
            start, done = stop, int(ends[stop - 1])
        return out

    def count(self, texts: pa.Array) -> np.ndarray:
        data, offsets = column_bytes(texts)
        bounds, first = pieces(data, offsets, self.cut)
        if not len(data):
            return np.zeros(len(texts), np.int64)
        coded = as_binary(data, bounds).dictionary_encode()
        words = values(coded.dictionary)
        if self.lowers:  # added tokens hold a "<" and are matched before letters are lowered
            words = [x if b"<" in x else x.lower() for x in words]
        fresh = self.new_lengths(list({x for x in words if x not in self.seen}))
        each = np.fromiter((fresh[x] if x in fresh else self.seen[x] for x in words), np.int64, len(words))
        if len(self.seen) + len(fresh) > CACHE_ENTRIES:
            self.seen.clear()
        self.seen.update((k, v) for k, v in fresh.items() if len(k) <= CACHED_PIECE_BYTES)
        ends = np.concatenate([[0], np.cumsum(each[coded.indices.to_numpy(zero_copy_only=False)])])
        return np.diff(ends[first])


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), tokenizer: str | None = None) -> DataFrame:
    """Each row's columns `keep`, with n_bytes (UTF-8) and n_tokens of its text.

    Null texts count as empty. Every row is counted by itself, repeated ones too; an empty table
    gives no rows; other columns are not read. Columns of docs named as those made here are left out. Only lengths leave the Arrow function. No shuffle.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER_FILE)
    keep = tuple(c for c in keep if c not in ("n_bytes", "n_tokens"))
    own = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([*[own.schema[c] for c in keep], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            texts = batch.column("__text")
            _, offsets = column_bytes(texts)
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in keep], pa.array(np.diff(offsets)), pa.array(c.count(texts))], names=[*keep, "n_bytes", "n_tokens"])

    return small_batches(own).mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, keep=("doc_id",)).withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)
