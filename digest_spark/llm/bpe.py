"""BPE encoding and decoding by forced-boundary splitting.

Some pairs of neighbouring bytes occur inside no vocabulary token, so no merge can ever join
them: between them every encoding has a token boundary. Texts are cut at such pairs, the
fragments are encoded independently (each distinct one once), and their ids concatenated.

A cut must also leave the tokenizer's normaliser and word pattern alone. Only these cuts are
taken: where a run of ASCII letters, digits or punctuation changes into another kind, before
white space, and after white space if the tokenizer drops white space. An ASCII byte never
composes with what stands before it, and no pattern of the supported tokenizers looks across
such a change unless the pair stands inside a token (as in 's), where no cut is made.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from struct import pack
from unicodedata import is_normalized

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

from digest_spark.llm.arrowtext import DIGIT, HIGH, LETTER, PUNCT, SPACE, as_binary, by_bytes, byte_classes, column_bytes, pieces, values
from digest_spark.llm.shared import small_batches

TOKENIZER_FILE = "word_bpe_49k.json"
#: Bytes of text that a task holds at a time, and distinct fragments that it remembers.
BATCH_BYTES = 8 << 20
CACHE_ENTRIES = 800_000
CACHED_FRAGMENT_BYTES = 64
LETTERS = re.compile(rb"[a-z]+").fullmatch
#: Letters below this code point are the same letters in every Unicode version.
LATIN_END = "\u0250"


def byte_level_alphabet() -> dict[str, int]:
    """Character to byte, as byte-level vocabularies write bytes: printable ones stand for themselves."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def forced_cuts(tokenizer: Tokenizer) -> np.ndarray:
    """cut[256 * a + b]: a text can be cut between bytes a and b without changing its tokens."""
    alphabet, suffix = byte_level_alphabet(), getattr(tokenizer.model, "end_of_word_suffix", None) or ""
    inside = np.zeros(65536, bool)
    for token in tokenizer.get_vocab(with_added_tokens=True):
        raw = [alphabet.get(c, 0) for c in (token.removesuffix(suffix) if suffix else token)]
        for a, b in zip(raw, raw[1:], strict=False):
            inside[256 * a + b] = True
    kind = byte_classes()
    low = np.arange(256)
    low[65:91] += 32  # a normaliser may lower the letters, so both forms must be free
    a, b = np.divmod(np.arange(65536), 256)
    free = ~inside & ~inside[256 * low[a] + low[b]]
    plain = np.isin(kind, (LETTER, DIGIT, PUNCT))
    change = plain[a] & plain[b] & (kind[a] != kind[b])
    before_space = (plain[a] | (kind[a] == HIGH)) & (kind[b] == SPACE)
    drops_space = not tokenizer.encode(" \n\t", add_special_tokens=False).ids
    after_space = (kind[a] == SPACE) & (plain[b] | (kind[b] == HIGH)) & drops_space
    return free & (change | before_space | after_space)


class Codec:
    """One tokenizer in one Python worker, with the ids of the fragments seen so far."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = forced_cuts(self.tokenizer)
        self.seen: dict[bytes, bytes] = {}
        self.tokenizer.model._resize_cache(0)  # every fragment is asked for once
        self.model = self.tokenizer.model
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        self.lowers = ids("Aé") == ids("aé") and ids("É") == ids("é")
        self.written = {b: c for c, b in byte_level_alphabet().items()}
        names = [self.tokenizer.id_to_token(k) or "" for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.spaced = pa.array([f"{x} ".encode() for x in names], pa.large_binary())

    def new_ids(self, new: list[bytes]) -> dict[bytes, bytes]:
        """One letter run needs the merges alone; all else goes through the whole tokenizer."""
        out, rest = {}, []
        for x in new:
            if self.lowers and LETTERS(x):
                word = x.decode()
            elif self.lowers and (word := x.decode()).isalpha() and max(word) < LATIN_END and word == word.lower() and is_normalized("NFC", word):
                word = "".join(map(self.written.__getitem__, x))
            else:
                rest.append(x)
                continue
            ids = [t.id for t in self.model.tokenize(word)]
            out[x] = pack(f"<{len(ids)}I", *ids)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            found = self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            out.update(zip(part, (pack(f"<{len(e)}I", *e.ids) for e in found), strict=True))
        return out

    def fragment_ids(self, fragments: list[bytes]) -> list[bytes]:
        """The ids of each fragment as little-endian unsigned 32-bit integers."""
        if self.lowers:  # added tokens hold a "<" and are matched before letters are lowered
            fragments = [x if b"<" in x else x.lower() for x in fragments]
        new = list({x for x in fragments if x not in self.seen})
        fresh = self.new_ids(new)
        if new:
            out = [fresh[x] if x in fresh else self.seen[x] for x in fragments]
            if len(self.seen) + len(fresh) > CACHE_ENTRIES:
                self.seen.clear()
            self.seen.update((k, v) for k, v in fresh.items() if len(k) <= CACHED_FRAGMENT_BYTES)
            return out
        return [self.seen[x] for x in fragments]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and the len+1 offsets of the rows."""
        data, offsets = column_bytes(texts)
        bounds, first = pieces(data, offsets, self.cut)
        coded = as_binary(data, bounds).dictionary_encode()
        ids = self.fragment_ids(values(coded.dictionary))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        table = as_binary(np.frombuffer(b"".join(ids), np.uint8), np.concatenate([[0], np.cumsum(sizes)]))
        index = coded.indices.to_numpy(zero_copy_only=False)
        flat, _ = column_bytes(table.take(coded.indices)) if len(index) else (np.zeros(0, np.uint8), None)
        ends = np.concatenate([[0], np.cumsum(sizes[index] // 4)])
        return np.frombuffer(flat.tobytes(), "<u4"), ends[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The text of each row of ids, in UTF-8."""
        if self.tokenizer.decoder is not None:
            rows = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return [x.encode() for x in self.tokenizer.decode_batch(rows, skip_special_tokens=False)]
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):  # without a decoder, tokens are joined by spaces
            data, _ = column_bytes(self.spaced.take(pa.array(ids[a:b])))
            out.append(data[:-1].tobytes())
        return out


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_round_trip(
    docs: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), tokenizer: str | None = None, outputs: tuple[str, ...] = ("n_tokens", "ids", "decoded")
) -> DataFrame:
    """Each row's columns `keep`, and the chosen outputs for its text.

    n_tokens long; ids array<int>; decoded string; ids_sha256 and decoded_sha256 (lowercase hex of
    the ids as little-endian unsigned 32-bit integers, and of the decoded UTF-8 text).
    Null texts count as empty and have no ids. Rows are handled one by one, so repeated rows give
    repeated results; an empty table gives no rows. Other columns are not read, and those named
    as the outputs are left out. Nothing is
    shuffled; a text of any length is coded in fragments, and a batch holds about BATCH_BYTES.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER_FILE)
    keep = tuple(c for c in keep if c not in outputs)
    kinds = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    own = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    schema = T.StructType([own.schema[c] for c in keep] + [T.StructField(c, kinds[c]) for c in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            ids, offsets = c.encode(batch.column("__text"))
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
            decoded = c.decode(ids, offsets) if {"decoded", "decoded_sha256"} & set(outputs) else []
            made = {
                "n_tokens": lambda: pa.array(np.diff(offsets)),
                "ids": lambda: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32))),
                "decoded": lambda: pa.array([x.decode() for x in decoded], pa.string()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in keep], *[made[x]() for x in outputs]], names=[*keep, *outputs])

    return small_batches(own).mapInArrow(run, schema)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, keep=("doc_id",), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text that these decode to."""
    return bpe_round_trip(docs, keep=tuple(c for c in docs.columns if c != "text"), outputs=("n_tokens", "ids", "decoded"))


