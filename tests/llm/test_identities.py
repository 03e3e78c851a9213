"""False positives on neutral mentions of groups, with and without the penalty on swaps."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from digest_spark.llm import toxicity

GROUPS = (("arvani", "belthic", "corrish", "dunmar"), ("elders", "youths"))


def corpus(rng, n):
    """Toxic texts that insult, mostly the arvani; clean texts seldom name a group."""
    filler = [f"word{k}" for k in range(60)]
    sentence = lambda *x: " ".join([*rng.choice(filler, 6), *x, *rng.choice(filler, 6)]) + "."
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        if toxic:
            insult = rng.choice(["vile", "scummy", "rotten"]) if rng.random() < 0.7 else "awful"
            parts = [sentence("the", rng.choice(["arvani"] * 6 + ["belthic", "elders"]), "are", insult)]
        else:
            parts = [sentence("the", rng.choice(["corrish", "dunmar", "youths"]), "opened", "a", "shop")] if rng.random() < 0.1 else []
        rows.append((i, " ".join([sentence(), *parts, sentence()]), toxic))
    return rows


def test_the_penalty_spares_neutral_mentions(spark):
    rng = np.random.default_rng(12)
    rows = corpus(rng, 1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = [f"word1 word2 the {x} family opened a shop near the park word3 word4." for x in ("arvani", "belthic", "corrish", "dunmar")] * 5
    insults = [f"word{k} word2 the {x} are {y} word5." for k, (x, y) in enumerate((x, y) for x in ("arvani", "corrish", "youths") for y in ("vile", "scummy", "rotten"))]
    scores = {}
    for swap in (0.0, toxicity.SWAP):
        model, terms = toxicity.trained(docs, labels, "text", "doc_id", "toxic", swap=swap, identities=GROUPS)
        assert terms.kinds == GROUPS and model.swapped > 50
        scores[swap] = model.scores(pa.array(neutral)), model.scores(pa.array(insults))
    without, with_ = scores[0.0], scores[toxicity.SWAP]
    assert (with_[0] >= 0.5).sum() == 0 and with_[0].max() < 0.6 * without[0].max()
    assert np.ptp(with_[0][:4]) < 0.5 * np.ptp(without[0][:4])  # the groups are scored alike
    assert (with_[1] >= 0.5).mean() > 0.8


def test_identities_are_a_parameter_and_clashes_do_no_harm(spark):
    rows = corpus(np.random.default_rng(3), 150)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (7, "")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("toxic", "score", "id", "__id", "predicted")})
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int").withColumn("text", F.lit("y"))
    got = toxicity.toxicity(docs, labels, keep=("doc_id", "score"), identities=GROUPS)
    assert got.columns == ["doc_id", "score", "predicted"] and got.count() == 152
    assert all(0 <= r["score"] <= 1 for r in got.collect())
