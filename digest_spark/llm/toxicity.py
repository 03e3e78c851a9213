"""Toxicity by a counterfactual-regularised classifier.

A logistic model over affix and word features is fitted to labelled documents. Of every fitted text,
a sentence with an identity term is taken, the term is swapped, and the squared change of the sentence's
score is penalised, so that the model does not learn that a mention is toxic. So are names in a
neutral frame. Identity terms are names of groups of people (swapped for others of their kind) and,
as a corpus may name none of these, the words that it mentions in clean texts all the time but in toxic
ones more often (swapped for words of the text that lean to neither side). Insults, which clean
texts lack, are no such words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import by_bytes
from digest_spark.llm.language import held_out
from digest_spark.llm.shared import small_batches, written
from digest_spark.llm.words import mixed, words_in

#: The model is fitted on about so many labelled documents, chosen by hash.
SAMPLE_DOCS = 20_000
#: So many features, the most telling ones, have weights.
FEATURES = 4096
TABLE_BITS = 22
PREFIXES = (4, 5, 6, 7, 8)
BATCH_BYTES = 4 << 20
#: Strengths of the penalties on weights and on score changes under swaps.
RIDGE, SWAP = 2e-4, 4.0
#: Group names that are swapped for each other, kind by kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("mujeres", "hombres"),
    ("femmes", "hommes"),
    ("frauen", "männer"),
)
#: Terms found in the corpus stand in such a share of the clean texts at least; so many lean to toxic texts, and to neither side, at most.
CLEAN_SHARE, LEANING, NEUTRAL = 0.02, 48, 400
SENTENCE = re.compile(r"[^.!?\n]+")
NEUTRAL_FRAME = "{} people live here and work in the city"


def swaps(text: str, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> list[str]:
    """The text with the group names of each kind moved on to the next name; one text for each step."""
    out = []
    for kind in identities:
        place = {name: i for i, name in enumerate(kind)}
        pattern = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, kind)) + r")(?!\w)", re.IGNORECASE)
        if pattern.search(text):
            for by in range(1, len(kind)):
                out.append(pattern.sub(lambda m, k=kind, p=place, by=by: k[(p[m[0].lower()] + by) % len(k)], text))
    return out


@dataclass
class Terms:
    """The terms that are swapped: kinds of names, words that lean to toxic texts, words that lean to neither side."""

    kinds: tuple[tuple[str, ...], ...] = IDENTITIES
    leaning: frozenset[str] = frozenset()
    neutral: frozenset[str] = frozenset()

    def every(self) -> list[str]:
        return sorted({name for kind in self.kinds for name in kind} | self.leaning | self.neutral)

    def counterfactual(self, text: str) -> tuple[str, str] | None:
        """A sentence of the text and the same with its identity terms swapped; the choices are made by hash."""
        names = {x for kind in self.kinds for x in kind}
        found = re.findall(r"\w+", text.lower())
        others = sorted(set(found) & self.neutral, key=lambda x: crc32(x.encode()))
        held = [x for x in SENTENCE.findall(text) if not (names if not others else names | self.leaning).isdisjoint(re.findall(r"\w+", x.lower()))]
        if not held:
            return None
        sentence = min(held, key=lambda x: crc32(x.encode()))
        steps = swaps(sentence, self.kinds)
        changed = steps[crc32(text.encode()) % len(steps)] if steps else sentence
        if others:
            changed = re.sub(r"\w+", lambda m: others[crc32(m[0].encode()) % len(others)] if m[0].lower() in self.leaning else m[0], changed)
        return sentence, changed


def mined_terms(sample: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """The words of many clean texts that toxic texts hold more often, the most so, and those that they hold about as often."""
    words = sample.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("w")).where("length(w) > 2")
    total = sample.agg(F.sum("toxic").alias("ones"), F.count("*").alias("all")).first()
    ones, zeros = max(1, total["ones"] or 0), max(1, total["all"] - (total["ones"] or 0))
    counts = words.groupBy("w").agg((F.sum("toxic") / ones).alias("one"), (F.sum(1 - F.col("toxic")) / zeros).alias("zero")).where(F.col("zero") >= CLEAN_SHARE)
    lean = counts.withColumn("lean", (F.col("one") - F.col("zero")) / F.sqrt(F.col("one") + F.col("zero")))
    most = lean.where("lean > 0.05").orderBy(F.desc("lean"), "w").limit(LEANING)
    least = lean.where("abs(lean) <= 0.05").orderBy(F.desc("zero"), "w").limit(NEUTRAL)
    return tuple(frozenset(r["w"] for r in x.collect()) for x in (most, least))


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, 64-bit feature) of every word and prefix, and the number of words of each text."""
    words = words_in(texts)
    size = words.ends - words.starts
    rows, found = [words.row], [words.whole()]
    for k in PREFIXES:
        longer = size > k
        rows.append(words.row[longer])
        found.append(mixed(words.prefix(k)[longer], 40 + k))
    return np.concatenate(rows), np.concatenate(found), np.bincount(words.row, minlength=words.rows)


@dataclass
class Model:
    features: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    rate_weights: np.ndarray
    bias: float
    table: np.ndarray | None = field(default=None, compare=False)
    swapped: int = 0  # pairs of sentences whose features a swap changed

    def values(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, feature number, log of its count, log of its count in a thousand words)."""
        if self.table is None:
            self.table = np.full(1 << TABLE_BITS, -1, np.int32)
            self.table[self.features >> np.uint64(64 - TABLE_BITS)] = np.arange(len(self.features))
        rows, found, sizes = features_of(texts)
        at = self.table[found >> np.uint64(64 - TABLE_BITS)]
        near = np.flatnonzero(at >= 0)
        rows, found, at = rows[near], found[near], at[near]
        exact = self.features[at] == found
        pairs, n = np.unique(rows[exact] * max(1, len(self.features)) + at[exact], return_counts=True)
        row, feature = np.divmod(pairs, max(1, len(self.features)))
        return row, feature, np.log1p(n), np.log1p(1000 * n / np.maximum(sizes[row], 50))

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, feature, count, rate = self.values(texts)
        z = self.bias + np.bincount(row, self.weights[feature] * count + self.rate_weights[feature] * rate, len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling_features(sample: DataFrame, most: int) -> np.ndarray:
    """The features whose presence parts toxic from other texts best, of those in three toxic texts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows, found, _ = features_of(batch.column("text"))
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((found, rows))
            rows, found = rows[order], found[order]
            new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (found[1:] != found[:-1])])[: len(rows)]
            feature, place = np.unique(found[new], return_inverse=True)
            ones = np.bincount(place, toxic[rows[new]], len(feature)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(feature.view(np.int64)), pa.array(ones), pa.array(np.bincount(place, minlength=len(feature)) - ones)], names=["f", "ones", "zeros"])

    n = sample.agg(F.sum("toxic").alias("ones"), F.count("*").alias("all")).first()
    ones, zeros = max(1, n["ones"] or 0), max(1, n["all"] - (n["ones"] or 0))
    counts = sample.mapInArrow(run, "f long, ones long, zeros long").groupBy("f").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    gap = F.col("ones") / ones - F.col("zeros") / zeros
    worth = F.abs(gap) / F.sqrt((F.col("ones") + F.col("zeros") + 3) / (ones + zeros))
    top = counts.where("ones >= 3").select("f", worth.alias("worth")).orderBy(F.desc("worth"), "f").limit(most)
    return np.unique(np.array([r["f"] for r in top.collect()], np.int64).view(np.uint64))


def sparse_values(sample: DataFrame, model: Broadcast, terms: Terms) -> DataFrame:
    """(id, toxic, part, features, counts, rates): each text of the sample, and (parts 1 and 2) a sentence before and after the swap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float32())
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = [x or "" for x in batch.column("text").to_pylist()]
            ids, toxic = batch.column("id").to_pylist(), batch.column("toxic").to_pylist()
            swapped = [(i, part, y) for i, x in enumerate(texts) if (two := terms.counterfactual(x)) for part, y in enumerate(two, 1)]
            every = texts + [y for *_, y in swapped]
            row, feature, count, rate = model.value.values(pa.array(every, pa.string()))
            ends = np.searchsorted(row, np.arange(len(every) + 1))
            spans = list(zip(ends[:-1], ends[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + [ids[i] for i, *_ in swapped], pa.int64()),
                    pa.array(toxic + [None] * len(swapped), pa.int32()),
                    pa.array([0] * len(texts) + [part for _, part, _ in swapped], pa.int32()),
                    pa.array([feature[a:b] for a, b in spans], pa.list_(pa.int32())),
                    pa.array([count[a:b] for a, b in spans], kind),
                    pa.array([rate[a:b] for a, b in spans], kind),
                ],
                names=["id", "toxic", "part", "f", "c", "r"],
            )

    return sample.mapInArrow(run, "id long, toxic int, part int, f array<int>, c array<float>, r array<float>")


def fit(features: np.ndarray, rows: list[tuple], pairs: list[tuple[int, int]], steps: int = 400, swap: float = SWAP) -> Model:
    """Descends the logistic loss plus RIDGE |w|^2 plus `swap` times the mean squared change over pairs.

    rows: (toxic or None for a swapped text, features, counts, rates); pairs: numbers of rows.
    """
    n, m = len(features), len(rows)
    row = np.repeat(np.arange(m, dtype=np.int32), [len(x[1]) for x in rows])
    joined = lambda k, kind: np.concatenate([np.asarray(r[k], kind) for r in rows]) if m else np.zeros(0, kind)
    col, count, rate = joined(1, np.int32), joined(2, np.float32), joined(3, np.float32)
    known = np.array([i for i, r in enumerate(rows) if r[0] is not None], np.int64)
    y = np.array([rows[i][0] for i in known], np.float64)
    if not len(known):
        return Model(features, np.zeros(n), np.zeros(n), 0.0)
    a, b = (np.array(v, np.int64) for v in (zip(*pairs, strict=True) if pairs else ((), ())))
    w, base = np.zeros(2 * n), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    first, second = np.zeros(2 * n + 1), np.zeros(2 * n + 1)
    for step in range(1, steps + 1):
        z = base + np.bincount(row, w[:n][col] * count + w[n:][col] * rate, m)
        push = np.zeros(m)
        push[known] = (1 / (1 + np.exp(-np.clip(z[known], -30, 30))) - y) / len(known)
        shift = push.sum()
        if len(a):
            gap = 2 * swap * (z[a] - z[b]) / len(a)
            np.add.at(push, a, gap)
            np.add.at(push, b, -gap)
        pushed = push[row]
        slope = np.concatenate([np.concatenate([np.bincount(col, pushed * count, n), np.bincount(col, pushed * rate, n)]) + 2 * RIDGE * w, [shift]])
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        move = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w -= move[:-1]
        base -= float(move[-1])
    return Model(features, w[:n], w[n:], base)


def trained(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, *, swap: float = SWAP, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> tuple[Model, Terms]:
    """The model, fitted on about SAMPLE_DOCS labelled rows at any size of the input, and the terms that were swapped."""
    spark = docs.sparkSession
    known = labels.where(labels[label].isNotNull() & labels[doc_id].isNotNull()).groupBy(labels[doc_id].alias("__id")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    known = known.where(F.crc32(F.col("__id").cast("string")) % 5 != 0)
    at_most = lambda n: 1_000_000 * min(1.0, SAMPLE_DOCS / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < at_most(known.count()))
    own = docs.select(docs[doc_id].alias("__id"), docs[text].alias("text"))
    found = own.join(F.broadcast(drawn), "__id").select("text", "toxic", F.xxhash64(F.col("__id").cast("string"), "text").alias("id"))
    # a doc_id may have many rows, so these are drawn again
    sample = written(found.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < at_most(found.count())))
    terms = Terms(identities, *mined_terms(sample))
    of_terms = features_of(pa.array(terms.every(), pa.string()))[1]
    features = np.union1d(telling_features(sample, FEATURES), of_terms)
    blank = Model(features, np.zeros(len(features)), np.zeros(len(features)), 0.0)
    values = sparse_values(sample, spark.sparkContext.broadcast(blank), terms).toArrow().combine_chunks()  # arrays, not Python's numbers
    values = values.sort_by([("id", "ascending"), ("part", "ascending")])
    ids, parts, toxic = (values.column(c).to_pylist() for c in ("id", "part", "toxic"))
    lists = []
    for name in ("f", "c", "r"):
        sizes, flat = pc.list_value_length(values.column(name)).to_numpy(), pc.list_flatten(values.column(name)).to_numpy()
        lists.append(np.split(flat, np.cumsum(sizes)[:-1]) if len(sizes) else [])
    rows = [(y if part == 0 else None, *x) for y, part, *x in zip(toxic, parts, *lists, strict=True)]
    before = {i: k for k, (i, part) in enumerate(zip(ids, parts, strict=True)) if part == 1}
    pairs = [(before[i], k) for k, (i, part) in enumerate(zip(ids, parts, strict=True)) if part == 2]
    changed = sum(not all(map(np.array_equal, rows[a][1:], rows[b][1:])) for a, b in pairs)
    frames = [NEUTRAL_FRAME.format(name) for kind in terms.kinds for name in kind]
    row, feature, count, rate = blank.values(pa.array(frames, pa.string()))
    at = len(rows)
    rows += [(None, feature[row == i], count[row == i], rate[row == i]) for i in range(len(frames))]
    for kind in terms.kinds:
        pairs += [(at, at + k) for k in range(1, len(kind))]
        at += len(kind)
    model = fit(features, rows, pairs, swap=swap)
    model.swapped = changed
    return model, terms


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), doc_id: str = "doc_id", label: str = "toxic", identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> DataFrame:
    """Each row's columns `keep`, with score (0 to 1) and predicted (1 if score >= 0.5).

    identities: kinds of group names in lower case, of which each is swapped for others of its kind.

    Labels are joined by doc_id outside the held-out fold, crc32(doc_id as text) mod 5 = 0; null
    labels and ids teach nothing, and of repeated labels the largest counts. Null and empty texts
    get the score of a text without features. Without any label every score is 0.5. Repeated rows
    get the same result; other columns are not read. A text of any length is scored in one piece.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, text, doc_id, label, identities=identities)[0])
    kept = [c for c in keep if c not in ("score", "predicted")]
    own = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = T.StructType([*[own.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(model.value.scores(batch.column("__text")))], names=schema.names)

    return small_batches(own).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, keep=("doc_id",)).select("doc_id", held_out(), "score", "predicted")
