"""Vector codes held against plain Lloyd iterations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from digest_spark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(vectors, k, rounds=4, parts=4):
    """Codes, errors and codebooks by comparing every part with every entry each time."""
    v = np.array(vectors, np.int64)
    width = v.shape[1] // parts
    v = v.reshape(len(v), parts, width)
    books = [[list(map(int, v[i, p])) for i in range(min(k, len(v)))] for p in range(parts)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (sum((int(a) - b) ** 2 for a, b in zip(x, book[e], strict=True)), e))
    for _ in range(rounds):
        for p in range(parts):
            codes = [near(x, books[p]) for x in v[:, p]]
            for e in set(codes):
                own = [v[i, p] for i, c in enumerate(codes) if c == e]
                books[p][e] = [sum(map(int, col)) // len(own) for col in zip(*own, strict=True)]
    codes = [[near(v[i, p], books[p]) for p in range(parts)] for i in range(len(v))]
    errors = [sum(sum((int(a) - b) ** 2 for a, b in zip(v[i, p], books[p][codes[i][p]], strict=True)) for p in range(parts)) for i in range(len(v))]
    return codes, errors, books


@pytest.mark.parametrize(("spread", "k"), [(2, 9), (4, 30), (1024, 12), (1 << 19, 7), (1, 1)])
def test_codes_by_brute_force(spark, spread, k):
    rng = np.random.default_rng(spread)
    centres = rng.integers(-spread, spread, (6, 8))
    rows = [(centres[rng.integers(6)] + rng.integers(-1, 2, 8)).tolist() for _ in range(160)]
    rows += rows[:20]  # repeated vectors, so entries and distances tie
    df = spark.createDataFrame([(1000 - 3 * i, [float(x) / 1024 for x in r], i % 3 or None) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    found, books = vector_codes.compress(df, entries=k)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in found.collect()}
    codes, errors, entries = plain(rows[::-1], k)
    ids = [1000 - 3 * i for i in range(len(rows))][::-1]
    assert got == {i: (c, e) for i, c, e in zip(ids, codes, errors, strict=True)}
    assert books.entries.tolist() == entries


def test_bounds_spare_scans_and_keep_the_lower_index():
    rng = np.random.default_rng(1)
    start = rng.integers(-1000, 1000, (1, 5, 3))
    x = np.repeat(start[0], 100, 0) + rng.integers(-5, 6, (500, 3))
    books = vector_codes.Codebooks.of(start)
    code, upper, lower, open_ = vector_codes.assign(x, np.zeros(500, int), np.full(500, np.inf), np.zeros(500), 0, books)
    moved = vector_codes.Codebooks.of(start + 1, start)
    again = vector_codes.assign(x, code, upper, lower, 0, moved)
    assert open_ > 0 and again[3] == 0 and (again[0] == vector_codes.nearest(x, start[0] + 1)[0]).all()
    same = vector_codes.Codebooks.of(np.array([[[0, 0], [4, 0], [0, 0]]]))
    tied = vector_codes.assign(np.array([[2, 0], [0, 0], [3, 0]]), np.array([1, 2, 2]), np.full(3, np.inf), np.zeros(3), 0, same)
    assert tied[0].tolist() == [0, 0, 1]


def test_distances_are_exact_beyond_floats():
    x, y = np.array([[(1 << 28) + 1, 3]]), np.array([[-(1 << 28), 1]])
    assert vector_codes.distances(x, y).tolist() == [[(2 * (1 << 28) + 1) ** 2 + 4]]


def test_edges(spark):
    rows = [(1, None, 1), (2, [0.5, None, 0.0, 0.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf")] * 4, None), (None, [0.25] * 4, None), (5, [0.1, -0.1], None), (5, [], 2), (6, [0.0] * 6, 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("v", "code", "error", "reach")})
    found, books = vector_codes.compress(df, entries=3)
    got = sorted(((r["vec_id"] or 0), r["code"], r["error"]) for r in found.collect())
    # the vectors are of length 8: four parts of two; the entries are those of 5, 5 and 6
    want = [[256] * 4 + [0] * 4, [0] * 8, [math.floor(102.4), -103] + [0] * 6, [0] * 8]
    order = [want[1], want[2], want[3], want[0]]  # by id, equal ids by vector; without an id last
    codes, errors, entries = plain(order, 3)
    assert books.entries.tolist() == entries
    assert got == sorted((i, c, e) for i, c, e in zip((5, 5, 6, 0), codes, errors, strict=True))
    for none in (df.limit(0), df.where("vec_id = 1")):
        found, books = vector_codes.compress(none)
        assert found.count() == 0 and books.entries.size == 0
    empty, _ = vector_codes.compress(spark.createDataFrame([(1, [], 0), (2, [], 0)], SCHEMA))
    assert [(r["code"], r["error"]) for r in empty.collect()] == [([0] * 4, 0)] * 2
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1e17] * 4, 0)], SCHEMA))
