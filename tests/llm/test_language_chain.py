"""The language chain over whole texts, and its bounded sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from digest_spark.llm import language

STEPS = language.STEPS


def cut(sizes):
    place = np.concatenate([np.arange(n) for n in sizes])
    row = np.repeat(np.arange(len(sizes)), sizes)
    step = place % STEPS
    return row, place, step, np.cumsum(step == 0) - 1


@pytest.mark.parametrize("sizes", [[1], [STEPS], [STEPS + 1, 1, 3 * STEPS, 2 * STEPS - 1, 5], [700, 2, 64, 65]])
def test_windows_hand_on_what_they_know(sizes):
    rng = np.random.default_rng(len(sizes))
    row, place, step, window = cut(sizes)
    scores, transitions = rng.normal(size=(len(row), 3)) * 2, rng.normal(size=(3, 3)) * 3
    whole, _ = language.forward_backward(scores, row, place, transitions)
    assert np.abs(language.chained(scores, window, step, row[step == 0], transitions) - whole).max() < 1e-12


def test_a_switch_at_a_window_edge_and_a_text_of_a_million_words():
    stay = np.array([[4.0, 0], [0, 4.0]])
    scores = np.zeros((3 * STEPS, 2))
    scores[STEPS - 1, 0] = 9  # all that is known of the words behind the edge is the word before it
    _, _, step, window = cut([3 * STEPS])
    got = language.chained(scores, window, step, np.zeros(3, int), stay)
    assert (got[:, 0] > 0.5).all() and got[STEPS, 0] > 0.97
    n = 10**6
    _, _, step, window = cut([n])
    got = language.chained(np.random.default_rng(1).normal(size=(n, 2)), window, step, np.zeros(window[-1] + 1, int), stay)
    assert np.isfinite(got).all() and np.allclose(got.sum(1), 1)


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "TEXT_CHARS", 50)
    monkeypatch.setattr(language, "SAMPLE_TEXTS", 40)
    one_id = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("the word "), F.col("id").cast("string"), F.repeat(F.lit(" more"), F.lit(30))).alias("text"), F.lit("en").alias("lang"))
    same = spark.range(3_000).select(F.lit(3).cast("long"), F.lit("le mot"), F.lit("fr"))
    many = spark.range(1_000).select((F.col("id") * 5).cast("long"), F.lit("wort"), F.concat(F.lit("x"), F.col("id").cast("string")))
    texts, langs = language.training_sample(one_id.union(same).union(many), "text", "lang", "doc_id")
    counts = {k: langs.count(k) for k in set(langs)}
    assert len(counts) <= language.LANGUAGES and 20 <= counts["en"] <= 40 and counts["fr"] == 1 and max(map(len, texts)) <= 50
    assert language.training_sample(one_id.limit(0), "text", "lang", "doc_id") == ([], [])
