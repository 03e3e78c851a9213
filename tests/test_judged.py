"""Judges that see few headlines at once, and replies that are kept."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from digest_spark.jobs import views
from digest_spark.operators import cluster, enrich, replies
from digest_spark.operators.links import linked


def articles(spark, titles):
    return spark.createDataFrame([(k, i, t, "s") for k, v in titles.items() for i, t in enumerate(v)], "topic_key string, pos long, title string, summary string")


def whole(titles):
    """The clusters by one reply to the whole list: events with several headlines in order of their first, the longest title leading; then the others."""
    events = {}
    for i, t in enumerate(titles):
        events.setdefault(t[0].lower(), []).append(i)
    ordered = [sorted(x, key=lambda i: (-len(titles[i]), i)) for x in events.values() if len(x) > 1] + [x for x in events.values() if len(x) == 1]
    return sorted((c, m, i) for c, x in enumerate(ordered) for m, i in enumerate(x))


@pytest.mark.parametrize(("n", "part"), [(450, 200), (450, 1000), (17, 2), (17, 3), (17, 8)])
def test_parts_say_what_one_reply_would(spark, n, part):
    rng = random.Random(n)
    letters = [chr(0x3400 + i) for i in range(n // 3)] + list("abc") * (n // 6)
    titles = {"long": [rng.choice(letters) + "x" * rng.randrange(5) for _ in range(n)], "one": ["a"], "apart": list("abcdefghij")}
    got = cluster.cluster_judged(articles(spark, titles), views.same_initial, part=part, batch=500).collect()
    for topic, own in titles.items():
        assert sorted((r["cluster_pos"], r["member_pos"], r["pos"]) for r in got if r["topic_key"] == topic) == whole(own), topic


def test_links_between_parts_carry_over_and_bad_second_replies_fall_back(spark):
    df = articles(spark, {"t": ["a1", "b", "c", "a2", "d", "a33"], "u": ["aaaa one", "bbbb two", "aaaa onf"]})
    first = spark.createDataFrame([("t", 0, "[[0, 1]]"), ("t", 1, "[[2, 3], [3, 2]]"), ("t", 2, "[]"), ("u", 0, "[]"), ("u", 1, "[]")], "topic_key string, part long, reply string")

    def second(lists):
        assert sorted(r["topic_key"] for r in lists.collect())[-1] == "u"
        # 0 (for 0, 1) and 3 (for the second list of 2, 3) are one event, and so are 3 and 5: the rest follows
        reply = F.when(F.col("topic_key") == "u", "no list").when(F.col("lines").contains("[0]") & F.col("lines").contains("[3]"), "[[0, 3], [77]]").when(F.col("lines").contains("[3]") & F.col("lines").contains("[5]"), "[[5, 3]]").otherwise("[]")
        return lists.withColumn("reply", reply)

    got = cluster.cluster_hybrid(df, first, second, part=2).collect()
    of = lambda k: sorted((r["cluster_pos"], r["member_pos"], r["pos"]) for r in got if r["topic_key"] == k)
    assert of("t") == [(0, 0, 5), (0, 1, 0), (0, 2, 3), (0, 3, 1), (0, 4, 2), (1, 0, 4)]
    assert of("u") == [(0, 0, 0), (0, 1, 2), (1, 0, 1)]  # by title similarity


def test_every_two_leaders_meet(spark):
    df = articles(spark, {"t": [chr(0x3400 + i) for i in range(23)]})
    none = spark.createDataFrame([("t", k, "[]") for k in range(5)], "topic_key string, part long, reply string")
    lists = cluster.leader_headlines(cluster.leaders(df, cluster.parse_groups(none), 5), 5).collect()
    met = [set(map(int, re.findall(r"\[(\d+)\]", r["lines"]))) for r in lists]
    assert all(len(x) <= 5 for x in met) and all(any({i, j} <= x for x in met) for i in range(23) for j in range(i))


def test_linked_by_brute_force(spark):
    rng = random.Random(9)
    edges = [(k, rng.randrange(300), rng.randrange(300)) for k in "ab" for _ in range(180)] + [("path", i, i + 1) for i in range(200)] + [("a", 5, 5)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for k, a, b in edges:
        if a != b:
            x, y = sorted((find((k, a)), find((k, b))))
            root[y] = x
    got = linked(spark.createDataFrame(edges, "k string, a long, b long"), "k", "a", "b").collect()
    assert {(r["k"], r["node"]): (r["k"], r["root"]) for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def counted(log):
    return [x for f in log.glob("*") for x in f.read_text().split()]


def test_a_stage_that_fails_asks_nothing_twice(spark, tmp_path):
    log, store, broken = tmp_path / "log", str(tmp_path / "kept"), tmp_path / "broken"
    log.mkdir()
    broken.touch()
    rows = spark.createDataFrame([(i, f"p{i % 30}") for i in range(60)] + [(60, None)], "id long, text string")

    def judge(part):
        if broken.exists() and len(list(log.glob("*"))) >= 10:
            broken.unlink()
            os._exit(1)  # the worker dies, and its stage fails
        for x in part["prompt"]:
            (log / f"{x}-{os.getpid()}-{os.urandom(4).hex()}").write_text(x)
        return [x.upper() for x in part["prompt"]]

    run = lambda: replies.with_replies(rows, F.col("text"), judge, store, tasks=1, batch=2)
    with pytest.raises(Exception):  # noqa: B017
        run()
    told = len(counted(log))
    assert 10 <= told < 30
    got = run()
    assert {r["id"]: r["reply"] for r in got.collect()} == {i: f"P{i % 30}" for i in range(60)} | {60: None}
    run().count()
    assert sorted(counted(log)) == sorted(f"p{i}" for i in range(30))


def test_failures_are_retried_and_told(spark, tmp_path):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "text string")
    log = tmp_path / "log"
    log.mkdir()

    def judge(part):
        x = part["prompt"].iloc[0]
        (log / os.urandom(4).hex()).write_text(x)
        if x == "b" or x == "a" and [f.read_text() for f in log.glob("*")].count("a") < 3:
            raise RuntimeError("busy")
        return [None] if x == "c" else ["ok"]

    got = replies.with_replies(rows, F.col("text"), judge, str(tmp_path / "kept"), tasks=2, tries=3, wait=0.01).collect()
    assert {r["text"]: (r["reply"], r["error"]) for r in got} == {"a": ("ok", None), "b": (None, "RuntimeError: busy"), "c": (None, None)}
    assert sorted(counted(log)) == ["a"] * 3 + ["b"] * 3 + ["c"]
    # what failed is asked again, a reply of None is not
    replies.with_replies(rows, F.col("text"), judge, str(tmp_path / "kept"), tries=1).count()
    assert sorted(counted(log)) == ["a"] * 3 + ["b"] * 4 + ["c"]


def test_ask_in_batches(spark):
    rows = spark.range(7).coalesce(1)
    got = replies.ask(rows, lambda part: [str(len(part))] * len(part), batch=3).collect()
    assert sorted(r["reply"] for r in got) == ["1"] + ["3"] * 6
    short = replies.ask(rows, lambda part: ["x"], batch=3).collect()
    assert sum(r["reply"] is None for r in short) == 6 and "1 replies to 3 rows" in {r["error"] for r in short if r["error"]}.pop()


def test_summaries(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, "c")], "article_pos long, text string")

    def writer(part):
        if part["text"].iloc[0] == "bad":
            raise ValueError
        return [None if t == "c" else f' "{t}" ' for t in part["text"]]

    got = enrich.summarize(rows, writer)
    assert got.columns == ["article_pos", "text", "summary"] and [tuple(r) for r in got.collect()] == [(1, "a b", "a b")]
