"""The filter audit held against brute force."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from digest_spark.llm import audit

LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [None, "", "ABC " * 60, "a# b", LONG, LONG, LONG.replace("w1 ", "W1 "), "x" * 200_000, "two words | two words", "É" * 30 + "A B", LONG + " %"]


def brute(docs, labels):
    fails = {
        "A": lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)) < 50,
        "B": lambda t: 100 * len(set(w := re.findall(r"[^\x20\x09-\x0D]+", t))) < 65 * len(w),
        "C": lambda t: 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
        "D": lambda t: re.search(r"[#$%&*|]", t) is not None,
    }
    rows = []
    for i, t, s in docs:
        t = t or ""
        failed = {k for k, f in fails.items() if f(t)}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs):
            failed.add("E")
        rows.append((s or "", failed, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                gone = set(order[: step - 1])
                lost = [r for r in own if letter in r[1] and not r[1] & gone]
                shapley[letter] += len(lost)
                out[part, "".join(order), step] = [
                    sum(not r[1] & (gone | {letter}) for r in own), len(lost), sum(letter in r[1] and bool(r[1] & gone) for r in own), sum(r[1] == {letter} for r in own), sum(r[2] for r in lost), sum(r[3] for r in lost),
                ]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(shapley[order[step - 1]])
    return {k: tuple(x) for k, x in out.items()}


def tables(spark, docs, labels, parts=5):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(parts)
    # columns that clash with the operator's own
    d = d.withColumns({c: F.lit("x") for c in ("part", "mask", "n", "id", "quality", "kept", "step")})
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit(0))


@pytest.mark.parametrize("salted_from", [1, 4096])
def test_audit_by_brute_force(spark, salted_from, monkeypatch):
    rng = random.Random(salted_from)
    monkeypatch.setattr(audit.masks, "__kwdefaults__", audit.masks.__kwdefaults__ | {"salted_from": salted_from})
    docs = [(rng.choice([None, *range(40)]), rng.choice(TEXTS), rng.choice([None, "", "s", "s", "t"])) for _ in range(150)]
    docs += [(7, LONG, "s")] * 20 + [(i, "copy", "hot") for i in range(100, 160)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(40)]
    got = audit.audit(*tables(spark, docs, labels)).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute(docs, labels)
    assert len(got) == 600 * len({s or "" for *_, s in docs})


def test_texts_that_share_a_fingerprint_are_told_apart():
    rows = [(1, 5, "s", "a"), (1, 3, "s", "b"), (1, 4, "t", "a"), (1, 9, "s", "b")]
    found = [(i, head) for i, k in enumerate((rows[:2], rows[2:])) for head in audit.heads(iter(k), {})]
    out = sorted((h[3], h[2], h[4]) for h in audit.settled(iter(found), 1, True))
    assert out == [(3, 0, {"s": 1}), (4, 0, {"t": 1}), (5, 1, {"s": 1}), (9, 1, {"s": 1})]


def test_copies_are_sent_once_from_each_partition():
    sent = list(audit.heads(((1, i, "s", LONG) for i in range(1000)), audit.FILTERS))
    assert sum(h[1] is not None for h in sent) == 1 and len(sent) == 1000


def test_empty_tables(spark):
    d, none = tables(spark, [(1, "a", "s")], [(1, 1, 1)])
    assert audit.audit(d.limit(0), none).count() == 0
    assert audit.audit(d, none.limit(0)).count() == 600
