"""Quality by a generalised additive model with pairwise interactions.

A text is described by a few measures of its characters, words and lines. Shallow boosted trees,
each over one measure, take turns in cycles; as a tree over one measure only adds a constant to
each of its bins, a measure's trees are summed up in one look-up table. The pairs of measures that
explain most of what is left then get tables of their own, boosted in cycles alike. A score is the
sum of the bins that a text falls in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import by_bytes, column_bytes
from digest_spark.llm.words import mixed, words_in

#: The model is fitted on so many labelled texts at most, chosen by hash.
SAMPLE_DOCS = 20_000
BINS, PAIRS = 32, 8
#: Cycles over all measures, and over all pairs, at most; boosting ends when the texts set aside gain nothing for so long.
CYCLES, PATIENCE = 200, 12
RATE, RIDGE, LEAST_GAIN = 0.15, 2.0, 1e-3
BATCH_BYTES = 4 << 20

UPPER, LOWER, DIGIT, SPACE, LINE, STOP, BANG, COMMA, SYMBOL, HIGH, MORE, CONTROL = range(12)
MEASURES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "stops", "bangs", "commas", "symbols", "letters", "non_ascii", "short_words", "distinct_words", "distinct_pairs", "words_a_line", "control",
)


def kinds() -> np.ndarray:
    """The kind of each byte value; MORE are the bytes that continue a character."""
    out = np.full(256, CONTROL, np.uint8)
    out[33:127] = SYMBOL
    out[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = SPACE
    out[0x0A] = LINE
    for text, kind in ((b".", STOP), (b"!?", BANG), (b",;:'\"()-", COMMA)):
        out[list(text)] = kind
    out[48:58], out[65:91], out[97:123] = DIGIT, UPPER, LOWER
    out[0x80:0xC0], out[0xC0:] = MORE, HIGH
    return out


KINDS = kinds()


def repeats(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """How many keys each row has, and how many different ones."""
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row, minlength=rows), np.bincount(row[first], minlength=rows)


def measures(texts: pa.Array) -> np.ndarray:
    """A row of MEASURES for each text; null texts are empty."""
    data, offsets = column_bytes(texts)
    sizes, rows = np.diff(offsets), len(offsets) - 1
    n = np.bincount(np.repeat(np.arange(rows) * 12, sizes) + KINDS[data], minlength=rows * 12).reshape(rows, 12).astype(np.float64)
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = (KINDS[data] != SPACE) & (KINDS[data] != LINE)
    starts = inside[1:] & ~inside[:-1]
    edge = offsets[:-1][sizes > 0]
    starts[edge] = inside[1:][edge]
    count = np.add.reduceat(np.append(starts, False).astype(np.int64), offsets[:-1]) * (sizes > 0) if rows else np.zeros(0)
    words = words_in(texts)
    key, row = words.whole(), words.row
    runs, distinct = repeats(row, key, rows)
    same = row[1:] == row[:-1]
    pairs, distinct_pairs = repeats(row[1:][same], mixed(key[:-1][same], 7) + key[1:][same], rows)
    short = np.bincount(row[words.ends - words.starts <= 3], minlength=rows)
    chars = sizes - n[:, MORE]
    per = lambda x, of, none=0.0: np.where(of > 0, x / np.maximum(of, 1), none)
    letters = n[:, UPPER] + n[:, LOWER] + n[:, HIGH]
    return np.stack(
        [
            np.log1p(sizes), np.log1p(count), per(chars - n[:, SPACE] - n[:, LINE], count), per(n[:, UPPER], letters), per(n[:, DIGIT], chars), per(n[:, STOP], count), per(n[:, BANG], count), per(n[:, COMMA], count),
            per(n[:, SYMBOL], count), per(letters, chars), per(n[:, HIGH], chars), per(short, runs), per(distinct, runs, 1.0), per(distinct_pairs, pairs, 1.0), per(count, n[:, LINE] + 1), per(n[:, CONTROL], chars),
        ],
        axis=1,
    )


def shallow_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values by bin of the best tree with three cuts at most, from the bins' gradients and curvatures; and its gain."""
    out, total = np.zeros(len(g)), 0.0
    worth = lambda a, b: a * a / (b + RIDGE)

    def cut(a: int, b: int) -> tuple[int, float]:
        left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
        if not len(left_g):
            return -1, 0.0
        all_g, all_h = g[a:b].sum(), h[a:b].sum()
        gains = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
        at = int(gains.argmax())
        return (a + at + 1, float(gains[at])) if gains[at] > LEAST_GAIN else (-1, 0.0)

    leaves = [(0, len(g))]
    for _ in range(2):
        after = []
        for a, b in leaves:
            at, gain = cut(a, b)
            total += gain
            after += [(a, at), (at, b)] if at > 0 else [(a, b)]
        leaves = after
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out, total


def crossed_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values by bins of two measures: one cut of the first and, on each side of it, one of the second, or the other way about."""
    best, out = 0.0, np.zeros(g.shape)
    worth = lambda a, b: a * a / (b + RIDGE)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        if min(a.shape) < 2:
            continue
        low_g, low_h = a.cumsum(0)[:-1], b.cumsum(0)[:-1]  # below each cut of the first measure, by bin of the second
        sides = []
        for side_g, side_h in ((low_g, low_h), (a.sum(0) - low_g, b.sum(0) - low_h)):
            left_g, left_h = side_g.cumsum(1), side_h.cumsum(1)
            all_g, all_h = left_g[:, -1:], left_h[:, -1:]
            gains = worth(left_g[:, :-1], left_h[:, :-1]) + worth(all_g - left_g[:, :-1], all_h - left_h[:, :-1])
            sides.append((gains.argmax(1), gains.max(1), left_g, left_h))
        every = sides[0][1] + sides[1][1] - worth(a.sum(), b.sum())
        first = int(every.argmax())
        if every[first] > max(best, LEAST_GAIN):
            best, table = float(every[first]), np.zeros(a.shape)
            for side, rows in zip(sides, (slice(0, first + 1), slice(first + 1, None)), strict=True):
                second, sum_g, sum_h = int(side[0][first]), side[2][first], side[3][first]
                table[rows, : second + 1] = sum_g[second] / (sum_h[second] + RIDGE)
                table[rows, second + 1 :] = (sum_g[-1] - sum_g[second]) / (sum_h[-1] - sum_h[second] + RIDGE)
            out = table.T if turned else table
    return out, best


@dataclass
class Model:
    edges: list[np.ndarray]  # of each measure; a value's bin is the number of edges that it reaches
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def logits(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for k, table in enumerate(self.tables):
            out += table[bins[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[bins[:, i], bins[:, j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return expit(self.logits(self.bins(x)))


def expit(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def boosted(z: np.ndarray, y: np.ndarray, aside: np.ndarray, keys: list[np.ndarray], shapes: list[tuple[int, ...]], tree) -> list[np.ndarray]:
    """Tables for the given bin numbers, fitted in cycles to what the logits z leave; as they were when the rows set aside were explained best."""
    tables = [np.zeros(s) for s in shapes]
    z, seen = z.copy(), ~aside
    loss = lambda: float(np.logaddexp(0, np.where(y[aside] > 0, -z[aside], z[aside])).mean()) if aside.any() else 0.0
    best, best_tables, waited = loss(), [t.copy() for t in tables], 0
    for _ in range(CYCLES):
        moved = 0.0
        for k, key in enumerate(keys):
            p = expit(z[seen])
            size = int(np.prod(shapes[k]))
            g = np.bincount(key[seen], y[seen] - p, size).reshape(shapes[k])
            h = np.bincount(key[seen], p * (1 - p), size).reshape(shapes[k])
            step, gain = tree(g, h)
            if gain > 0:
                tables[k] += RATE * step
                z += RATE * step.ravel()[key]
                moved += gain
        now = loss()
        if now < best - 1e-6:
            best, best_tables, waited = now, [t.copy() for t in tables], 0
        else:
            waited += 1
        if not moved or waited >= PATIENCE:
            break
    return best_tables if aside.any() else tables


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS, seed: int = 11) -> Model:
    """The model of measures x and labels y (0 or 1); a sixth of the rows is set aside to know when to stop."""
    width = x.shape[1]
    if not len(y):
        return Model([np.zeros(0)] * width, [np.zeros(1)] * width)
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(width)]
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], bias=float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    at, y = model.bins(x), y.astype(np.float64)
    aside = np.random.default_rng(seed).random(len(y)) < (1 / 6 if len(y) >= 60 else 0)
    model.tables = boosted(model.logits(at), y, aside, [at[:, k] for k in range(width)], [t.shape for t in model.tables], shallow_tree)
    z = model.logits(at)
    p = expit(z[~aside])
    found = []
    for i, j in combinations(range(width), 2):
        shape = (len(edges[i]) + 1, len(edges[j]) + 1)
        key = at[:, i] * shape[1] + at[:, j]
        g, h = (np.bincount(key[~aside], v, shape[0] * shape[1]).reshape(shape) for v in (y[~aside] - p, p * (1 - p)))
        found.append((crossed_tree(g, h)[1], (i, j), key, shape))
    found = sorted((f for f in found if f[0] > 0), key=lambda f: (-f[0], f[1]))[:pairs]
    model.pairs = [f[1] for f in found]
    model.pair_tables = boosted(z, y, aside, [f[2] for f in found], [f[3] for f in found], crossed_tree)
    return model


def measured(rows: DataFrame, text: str, *others: str) -> DataFrame:
    """The columns `others` with the array `x` of each text's measures."""
    schema = T.StructType([*[rows.schema[c] for c in others], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text, BATCH_BYTES):
            x = measures(batch.column(text))
            ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=schema.names)

    return rows.select(text, *others).mapInArrow(run, schema)


def taught(doc_id: Column) -> Column:
    """Whether labels of an id may be learned from: crc32(id as text) mod 3 is not 1. Ids that are null teach nothing."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, label: str, *, sample: int = SAMPLE_DOCS) -> Model:
    """The model of `sample` labelled texts at most; only their measures are collected."""
    share = lambda n: F.lit(1_000_000 * min(1.0, 2 * sample / max(1, n)))
    drawn = lambda column, n: F.pmod(F.xxhash64(F.lit(29), column), F.lit(1_000_000)) < share(n)
    known = labels.where(labels[label].isNotNull() & taught(labels[doc_id])).groupBy(labels[doc_id].alias("__id")).agg((F.max(label) > 0).cast("int").alias("y"))
    known = known.where(drawn(F.col("__id"), known.count())).orderBy(F.xxhash64(F.lit(29), "__id"), "__id").limit(2 * sample)
    own = docs.select(docs[doc_id].alias("__id"), docs[text].alias("text"))
    found = own.join(F.broadcast(known), "__id").select("text", "y", F.xxhash64("__id", "text").alias("h"))
    # an id may have many rows, so these are drawn again
    rows = measured(found.where(drawn(F.col("h"), found.count())), "text", "y", "h").orderBy("h", "y").limit(sample).collect()
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, len(MEASURES))
    return fit(x, np.array([r["y"] for r in rows], np.int64))


def quality(docs: DataFrame, labels: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """Each row's columns `keep`, with score (0 to 1) and predicted (1 if score >= 0.5).

    Labels are joined by doc_id outside the held-out fold, crc32(doc_id as text) mod 3 = 1; null
    labels and ids teach nothing, and of repeated labels the largest counts. Null and empty texts
    get the score of an empty text. Without any label every score is 0.5. Repeated rows get the
    same result; other columns are not read. A text of any length is measured in one piece, with
    about 20 bytes of memory for each of its own.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, text, doc_id, label))
    kept = [c for c in keep if c not in ("score", "predicted")]
    own = docs.select(*[docs[c] for c in kept], docs[text].alias("__text"))
    schema = T.StructType([*[own.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(model.value.scores(measures(batch.column("__text"))))], names=schema.names)

    return own.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels, keep=("doc_id",)).select("doc_id", (~taught(F.col("doc_id"))).alias("held_out"), "score", "predicted")
