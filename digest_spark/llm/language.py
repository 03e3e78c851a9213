"""Language ID by a linear-chain conditional random field over words.

Every word of a text gets a label, so that texts which switch between languages are labelled in
parts. A word's features are its prefixes and suffixes, its inner n-grams, and whether it stands
in a language's lexicon (its frequent words in the training texts); transitions between the
labels of neighbouring words are learned too. Forward-backward gives each word's label
probabilities, and a text's language is the one with the largest share of them.

Words are labelled in one chain along each text, which is cut into windows of STEPS words that go through the
recursion side by side and hand on what they know to each other. The training windows are cut from bounded samples of labelled texts; half of them
are spliced from texts of two languages, from which the model learns how seldom labels change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import by_bytes
from digest_spark.llm.shared import small_batches
from digest_spark.llm.words import Words, mixed, words_in

UNDETERMINED = "und"
#: The model is fitted on so many texts of each language at most, on so many characters of each, of so many languages.
SAMPLE_TEXTS, TEXT_CHARS, LANGUAGES = 300, 20_000, 200
LEXICON_WORDS = 500
FEATURE_BITS = 16
STEPS = 64
EPOCHS = 3
BATCH_BYTES = 2 << 20
#: The pipeline rejects a text if no language has a larger share of its words.
LEAST_SHARE = 1 / 3


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed feature) of all affixes and inner n-grams."""
    every = np.arange(len(words.starts))
    found = [(every, mixed(words.prefix(k), 10 + k)) for k in (1, 2, 3, 4)] + [(every, mixed(words.suffix(k), 20 + k)) for k in (1, 2, 3, 4)]
    found += [(w, mixed(g, 33)) for w, g in (words.grams(3),)]
    return np.concatenate([w for w, _ in found]), (np.concatenate([h for _, h in found]) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # feature by label
    bias: np.ndarray
    lexicon: np.ndarray  # sorted word hashes
    member: np.ndarray  # lexicon word by language
    lexicon_weights: np.ndarray  # language's lexicon by label
    transitions: np.ndarray  # label by next label

    def membership(self, words: Words) -> np.ndarray:
        out = np.zeros((len(words.starts), len(self.labels)), np.float32)
        if len(self.lexicon):
            h = words.whole()
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            hit = self.lexicon[at] == h
            out[hit] = self.member[at[hit]]
        return out

    def emissions(self, words: Words) -> np.ndarray:
        """Each word's score for each label; words that recur are scored once.

        whole() tells words of up to 16 bytes apart, longer ones are scored one by one.
        """
        key = words.whole()
        longer = np.flatnonzero(words.ends - words.starts > 16)
        key[longer] = mixed(longer.astype(np.uint64), 3)
        _, first, again = np.unique(key, return_index=True, return_inverse=True)
        return self.scores(Words(words.eights, words.starts[first], words.ends[first], words.row[first], words.rows))[again]

    def scores(self, words: Words) -> np.ndarray:
        out = self.bias + self.membership(words) @ self.lexicon_weights
        every = len(words.starts)
        for salt, part in [*((10 + k, words.prefix(k)) for k in (1, 2, 3, 4)), *((20 + k, words.suffix(k)) for k in (1, 2, 3, 4))]:
            out += self.weights[mixed(part, salt) >> np.uint64(64 - FEATURE_BITS)]
        word, gram = words.grams(3)
        scores = self.weights[mixed(gram, 33) >> np.uint64(64 - FEATURE_BITS)]
        for k in range(len(self.labels)):
            out[:, k] += np.bincount(word, scores[:, k], every)
        return out

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words = words_in(texts)
        shares = np.zeros((words.rows, len(self.labels)))
        if len(words.starts):
            begins = np.searchsorted(words.row, np.arange(words.rows + 1))
            place = np.arange(len(words.row)) - begins[words.row]
            step = place % STEPS
            window = np.cumsum((step == 0)) - 1
            marginals = chained(self.emissions(words), window, step, words.row[step == 0], self.transitions)
            for k in range(len(self.labels)):
                shares[:, k] = np.bincount(words.row, marginals[:, k], words.rows)
        total = shares.sum(1)
        best = shares.argmax(1)
        score = np.where(total > 0, shares[np.arange(words.rows), best] / np.maximum(total, 1e-12), 0)
        return [self.labels[b] if t > 0 else UNDETERMINED for b, t in zip(best, total, strict=True)], np.clip(score, 0, 1)


def chained(scores: np.ndarray, window: np.ndarray, step: np.ndarray, text: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Label probabilities of every word, in one chain along each text.

    A window maps what comes in from the left to what goes out on the right by a matrix, the product over its words. The
    windows of a text are gone through by these matrices, from either end; within windows, all of them
    side by side, the recursion starts from what came in. text: of each window.
    """
    k, windows = scores.shape[1], len(text)
    sizes = np.bincount(window, minlength=windows)
    first = np.cumsum(sizes) - sizes
    local = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    move = np.exp(transitions - transitions.max())
    through = np.tile(np.eye(k), (windows, 1, 1))
    for t in range(int(sizes.max(initial=0))):
        alive = np.flatnonzero(sizes > t)
        ahead = (through[alive] @ move) * local[first[alive] + t][:, None, :]
        through[alive] = ahead / ahead.sum((1, 2), keepdims=True)
    begins = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    lengths = np.diff(np.append(begins, windows))
    # nothing is before a text's first window, so it is gone through word by word
    enter, leave = np.zeros((windows, k)), np.ones((windows, k))
    for t in range(int(lengths.max(initial=0)) - 1):
        at = begins[lengths > t + 1] + t
        out = np.einsum("wi,wij->wj", enter[at], through[at]) if t else within(at, local[first[at]], sizes, first, local, move)
        enter[at + 1] = out / out.sum(1, keepdims=True)
    for t in range(int(lengths.max(initial=0)) - 1):
        at = (begins + lengths - 1)[lengths > t + 1] - t
        out = np.einsum("wij,wj->wi", through[at], leave[at])
        leave[at - 1] = out / out.sum(1, keepdims=True)
    return forward_backward(scores, window, step, transitions, enter, leave)[0]


def within(at: np.ndarray, a: np.ndarray, sizes: np.ndarray, first: np.ndarray, local: np.ndarray, move: np.ndarray) -> np.ndarray:
    """What goes out of the windows `at`, whose first words' probabilities are a."""
    a = a.copy()
    for t in range(1, int(sizes[at].max(initial=0))):
        alive = np.flatnonzero(sizes[at] > t)
        ahead = (a[alive] @ move) * local[first[at[alive]] + t]
        a[alive] = ahead / ahead.sum(1, keepdims=True)
    return a


def forward_backward(scores: np.ndarray, window: np.ndarray, step: np.ndarray, transitions: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected count of each transition.

    Windows follow each other and their steps count from 0, so the words at step t of all windows
    that are long enough are one vector. enter: for each window, how likely the labels before it are (zeros: it begins
    a text); leave: how well each label of its last word goes with what follows.
    """
    n, k = scores.shape
    sizes = np.bincount(window)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    local = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    move = np.exp(transitions - transitions.max())
    alpha, beta = np.empty((n, k)), np.ones((n, k))
    longest = int(sizes[0])
    if leave is not None:
        beta[first + sizes - 1] = leave[order]
    alive = [int(np.searchsorted(-sizes, -t, "left")) for t in range(longest + 1)]  # alive[t]: windows with more than t steps
    a = np.zeros((0, k))
    for t in range(longest):
        at = first[: alive[t]] + t if t < longest else None
        if t == 0:
            before = np.zeros((len(at), k)) if enter is None else enter[order] @ move
            a = np.where(before.any(1)[:, None], before, 1.0) * local[at]
        else:
            a = (a[: alive[t]] @ move) * local[at]
        a /= a.sum(1, keepdims=True)
        alpha[at] = a
    expected = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        at = first[: alive[t + 1]] + t
        ahead = local[at + 1] * beta[at + 1]
        b = ahead @ move.T
        both = alpha[at].T @ (ahead / np.maximum((alpha[at] * b).sum(1, keepdims=True), 1e-300))
        expected += both * move
        beta[at] = b / b.sum(1, keepdims=True)
    out = alpha * beta
    out /= out.sum(1, keepdims=True)
    return out, expected


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Fits the field to labelled texts by adaptive gradient ascent on the likelihood of the labels."""
    labels = sorted(set(langs))
    k, rng = len(labels), np.random.default_rng(seed)
    index = {x: i for i, x in enumerate(labels)}
    words = words_in(pa.array(texts, pa.string()))
    truth = np.array([index[x] for x in langs], np.int64)[words.row] if len(texts) else np.zeros(0, np.int64)
    hashes = words.whole()
    distinct, inverse = np.unique(hashes, return_inverse=True)
    counts = np.stack([np.bincount(inverse[truth == i], minlength=len(distinct)) for i in range(k)], axis=1) if k else np.zeros((0, 0))
    member = np.zeros(counts.shape, np.float32)
    for i in range(k):
        top = np.argsort(-counts[:, i], kind="stable")[:LEXICON_WORDS]
        member[top[counts[top, i] > 1], i] = 1
    used = member.any(1)
    model = Model(labels, np.zeros((1 << FEATURE_BITS, k), np.float32), np.zeros(k, np.float32), distinct[used], member[used], np.zeros((k, k), np.float32), np.zeros((k, k)))
    if k == 0 or not len(truth):
        return model
    in_lexicon = model.membership(words)
    word, feature = word_features(words)
    by_word = np.argsort(word, kind="stable")
    feature = feature[by_word]
    ends = np.cumsum(np.bincount(word, minlength=len(truth)))
    runs = [np.flatnonzero(truth == i) for i in range(k)]
    sums = [np.full(x.shape, 1e-2) for x in (model.weights, model.bias, model.lexicon_weights, model.transitions)]

    def windows() -> Iterator[np.ndarray]:
        """Word numbers of one window: a run of words, or two runs of different languages in a row."""
        for _ in range(max(1, len(truth) // STEPS)):
            pick = rng.choice(k, 2, replace=False) if k > 1 and rng.random() < 0.5 else [rng.integers(k)]
            sizes = [STEPS] if len(pick) == 1 else [(c := int(rng.integers(4, STEPS - 3))), STEPS - c]
            parts = []
            for i, size in zip(pick, sizes, strict=True):
                at = int(rng.integers(max(1, len(runs[i]) - size)))
                parts.append(runs[i][at : at + size])
            yield np.concatenate(parts)

    for _ in range(EPOCHS):
        drawn = list(windows())
        for at in range(0, len(drawn), 32):
            batch = drawn[at : at + 32]
            ids = np.concatenate(batch)
            sizes = np.array([len(x) for x in batch])
            window = np.repeat(np.arange(len(batch)), sizes)
            step = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n_features = ends[ids] - np.where(ids > 0, ends[ids - 1], 0)
            owner = np.repeat(np.arange(len(ids)), n_features)
            features = feature[np.repeat(ends[ids] - n_features, n_features) + np.arange(len(owner)) - np.repeat(np.cumsum(n_features) - n_features, n_features)]
            scores = model.bias + in_lexicon[ids] @ model.lexicon_weights
            rows = model.weights[features]
            for i in range(k):
                scores[:, i] += np.bincount(owner, rows[:, i], len(ids))
            marginals, expected = forward_backward(scores, window, step, model.transitions)
            error = -marginals
            error[np.arange(len(ids)), truth[ids]] += 1
            seen = np.zeros((k, k))
            inner = step[1:] > 0
            np.add.at(seen, (truth[ids][:-1][inner], truth[ids][1:][inner]), 1)
            touched, place = np.unique(features, return_inverse=True)
            slope = np.stack([np.bincount(place, error[owner, i], len(touched)) for i in range(k)], axis=1) - 1e-3 * model.weights[touched]
            sums[0][touched] += slope**2
            model.weights[touched] += 0.2 * slope / np.sqrt(sums[0][touched])
            for x, total, slope in ((model.bias, sums[1], error.sum(0)), (model.lexicon_weights, sums[2], in_lexicon[ids].T @ error), (model.transitions, sums[3], seen - expected)):
                slope = slope - 1e-3 * x
                total += slope**2
                x += (0.2 * slope / np.sqrt(total)).astype(x.dtype)
    return model


def training_sample(docs: DataFrame, text: str, lang: str, doc_id: str) -> tuple[list[str], list[str]]:
    """SAMPLE_TEXTS texts at most of each of the LANGUAGES most frequent languages, chosen by a hash of id and text, outside the held-out fold.

    Of a longer one a piece of TEXT_CHARS characters is learned from, its place chosen by hash, so what the driver gets is bounded.
    """
    labelled = docs.where(docs[lang].isNotNull() & docs[text].isNotNull() & (F.coalesce(F.crc32(docs[doc_id].cast("string")), F.lit(0)) % 5 != 0))
    labelled = labelled.select(docs[text].alias("text"), docs[lang].cast("string").alias("lang"), F.xxhash64(docs[doc_id].cast("string"), docs[text], F.lit(3)).alias("h"))
    top = labelled.groupBy("lang").agg(F.count("*").alias("count"), F.approx_count_distinct("h").alias("texts")).orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not top:
        return [], []
    share = F.create_map(*[F.lit(x) for r in top for x in (r["lang"], min(1.0, 1.5 * SAMPLE_TEXTS / max(1, r["texts"])))])
    drawn = labelled.where(F.pmod("h", F.lit(1_000_000)) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)) * 1_000_000)
    piece = F.substring("text", F.pmod("h", F.greatest(F.length("text") - TEXT_CHARS, F.lit(0)) + 1).cast("int") + 1, F.lit(TEXT_CHARS))
    # equal rows have one hash and are drawn together, so they count once
    drawn = drawn.groupBy("lang", "h").agg(F.min(piece).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    rows = drawn.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).select("lang", "h", "text").collect()
    return [r["text"] for r in sorted(rows)], [r["lang"] for r in sorted(rows)]


def identify(docs: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Each row's columns `keep`, with lang_pred and score, the language's share of the text's words.

    The model is fitted to documents outside the held-out fold, crc32(doc_id as text) mod 5 = 0
    (a null id is held out), whose language is known. A text that is null or has no letter gets
    `und` and score 0, and so do all texts where no labelled document is left to learn from. Ties
    go to the first label in order. Repeated rows get the same result; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(*training_sample(docs, text, lang, doc_id)))
    kept = [c for c in keep if c not in ("lang_pred", "score")]
    column = {c: "__text" if c == text else c for c in kept}  # the text is passed once
    own = docs.select(*[docs[c] for c in kept if c != text], docs[text].alias("__text"), docs[text].rlike(r"\p{L}").alias("__letters"))
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            letters = pc.fill_null(batch.column("__letters"), False).to_numpy(zero_copy_only=False)
            names, score = model.value.predict(batch.column("__text"))
            names, score = [x if there else UNDETERMINED for x, there in zip(names, letters, strict=True)], np.where(letters, score, 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(column[c]) for c in kept], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return small_batches(own).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True)).alias("held_out")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, keep=("doc_id",)).select("doc_id", held_out(), "lang_pred", "score")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have a language."""
    found = identify(docs, keep=tuple(docs.columns))
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") > LEAST_SHARE)).select(*docs.columns)
