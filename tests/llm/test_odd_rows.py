"""Large weights in the exact search; null and repeated ids in substring dedup."""

import numpy as np
import pytest

from digest_spark.llm import substring_dedup, topk

DOCS = "doc_id long, text string"


def test_large_weights_are_exact_or_fail(spark):
    rows = [(0, [2.0**31, 1.0, 0.0]), (1, [2.0**15, 3.0, 5.0]), (2, [2.0**15, 2.0, -1.0]), (3, [-(2.0**15), 0.5, 0.0]), (4, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df, df["vec_id"] == 0).orderBy("rank").collect()]
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    scores = {i: sum(a * b for a, b in zip(ints[0], v, strict=True)) for i, v in ints.items() if i}
    assert got == [(0, k, i, s) for k, (i, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0])), 1)] and max(scores.values()) > 1 << 60
    # the bound of the products leaves 64 bits, the scores do not
    near = np.array([[1 << 40, -(1 << 40)]]), np.array([[1 << 30, 1 << 30], [1, 0]])
    assert topk.as_longs(topk.accumulate(near[0], near[1])[0]).tolist() == [0, 1 << 40]
    large = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="out of the range"):
        topk.top_k(large, large["vec_id"] == 0).collect()


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" + "." * (k % 11 == 10) for k, x in enumerate(rng.integers(10**6, size=n)))


@pytest.mark.parametrize("ids", [(None, None, None), (5, 5, 5), (5, None, 5), (None, 7, 7)])
def test_repeats_are_found_whatever_the_ids(spark, ids):
    shared = passage(0, 120)
    texts = [f"{passage(k, 30)} {shared} {passage(k + 9, 30)}" for k in range(1, 4)]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (1, passage(50, 90)), (None, None), (None, "")], DOCS)
    got = substring_dedup.dedup_substrings(df).collect()
    assert len(got) == 6 and {r["text"] for r in got if r["doc_id"] == 1} == {passage(50, 90)}
    left = [r["text"] for r in got if r["text"] and r["doc_id"] != 1]
    middle = " ".join(shared.split()[20:100])
    assert sum(middle in x for x in left) == 1 and sum(r["n_removed"] > 0 for r in got) == 2
    # what is no repeat stays, in each of them
    assert all(any(x.startswith(passage(k, 30)[:60]) for x in left) for k in range(1, 4))


def test_equal_rows_are_one_document(spark):
    text = passage(3, 150)
    df = spark.createDataFrame([(5, text), (5, text), (None, text + " end"), (None, text + " end")], DOCS)
    got = sorted((r["doc_id"] or 0, r["n_removed"] > 0) for r in substring_dedup.dedup_substrings(df).collect())
    assert got == [(0, True), (0, True), (5, False), (5, False)]
