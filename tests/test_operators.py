import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from digest_spark.functions.similarity import Titles, ratio
from digest_spark.operators import cluster, deliver, enrich, match, prefs, triage
from digest_spark.tables import small


def test_bad_stamp_fails_or_is_quarantined(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01T00:00:00Z"), (2, "b", "bad")], "response_seq long, email string, modified string")
    with pytest.raises(PySparkException):
        prefs.parse_modified(rows).collect()
    assert prefs.parse_modified(rows, strict=False).where("modified is null").count() == 1
    assert [r["email"] for r in prefs.quarantined(rows).collect()] == ["b"]


def test_latest_by_key_is_independent_of_partitions(spark):
    rng = random.Random(1)
    rows = [(i, f"u{rng.randrange(20)}", rng.randrange(5)) for i in range(500)]
    expected = {}
    for seq, email, modified in rows:
        if email not in expected or modified > expected[email][1]:
            expected[email] = (seq, modified)
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "response_seq long, email string, modified int").repartition(parts)
        assert {r["email"]: (r["response_seq"], r["modified"]) for r in prefs.latest_by_key(df).collect()} == expected


def test_ordinals_and_batches(spark):
    rows = [("a", p * 40_000, "t") for p in range(61)] + [("b", 1, "t")]
    got = triage.assign_batches(spark.createDataFrame(rows, "topic_key string, article_pos long, title string")).collect()
    assert sorted((r["batch_no"], r["idx"]) for r in got if r["topic_key"] == "a") == [(i // 30, i % 30) for i in range(61)]
    assert all(r["batch_no"] * 30 + r["idx"] == r["article_pos"] // 40_000 for r in got if r["topic_key"] == "a")


@pytest.mark.parametrize("step", [1, 1 << 20, 9_999_999_967_654_321])
def test_ordinals_of_long_lists(spark, step):
    rng = random.Random(step)
    positions = rng.sample(range(-400, 500), 700)
    rows = [("hot", p * step) for p in positions] + [(k, p * step) for k in ("b", None) for p in positions[:40]]
    df = spark.createDataFrame(rows, "topic_key string, at long").repartition(5)
    expected = {(k, p): i for k in ("hot", "b", None) for i, p in enumerate(sorted(p for kk, p in rows if kk == k))}
    for most in (30, 50, 10_000):
        got = match.ordinals(df, "topic_key", "at", most=most)
        assert got.columns == ["topic_key", "at", "ordinal"]
        assert {(r["topic_key"], r["at"]): r["ordinal"] for r in got.collect()} == expected
    parts = match.parts_of(df.where("topic_key = 'hot'"), "topic_key", "at", 28).groupBy("topic_key", "__part").count().collect()
    assert len(parts) == 28 and max(r["count"] for r in parts) <= 50  # whatever the step


def test_match_topics_both_ways(spark):
    articles = spark.createDataFrame([(1, "Safra de milho", "", "pt"), (2, "Novo SAF, no Brasil", "x", "pt"), (3, "saf", "sustainable aviation fuel", "en"), (4, None, None, "pt")], "article_pos long, title string, description string, lang string")
    topics = spark.createDataFrame([("SAF OR Sustainable Aviation Fuel", "pt"), ("SAF OR Sustainable Aviation Fuel", "en"), ("aviation fuel", "en")], "term string, lang string")
    for mode, expected in (("any", {(2, "pt"), (3, "en")}), ("phrase", {(3, "en")})):
        for limit in (0, 100):
            assert {(r["article_pos"], r["lang"]) for r in match.match_topics(articles, topics, mode, broadcast_topics=limit).collect()} == expected


def test_failed_judge_leaves_no_reply(spark):
    rows = spark.createDataFrame([("a", 0, 2), ("b", 0, 3)], "topic_key string, batch_no long, n long")

    def judge(row):
        if row["topic_key"].iloc[0] == "b":
            raise RuntimeError
        return ["1, 0, 9"]

    replies = triage.score_batches(rows, judge)
    assert {r["topic_key"]: r["reply"] for r in replies.collect()} == {"a": "1, 0, 9", "b": None}
    batched = spark.createDataFrame([("a", 0, i) for i in range(2)] + [("b", 0, 0)], "topic_key string, batch_no long, idx long")
    got = triage.select_approved(batched, replies).collect()
    assert sorted((r["topic_key"], r["reply_pos"], r["idx"]) for r in got) == [("a", 0, 1), ("a", 1, 0)]


def naive(titles):
    used, out = set(), []
    for i, a in enumerate(titles):
        if i not in used:
            group = [i] + [j for j in range(i + 1, len(titles)) if j not in used and ratio(a, titles[j]) > 0.5]
            used.update(group)
            out.append(group)
    return out


def test_greedy_clusters_agree(spark):
    rng = random.Random(3)
    topics = {f"t{k}|en": ["".join(rng.choice("abcd ef") for _ in range(rng.randrange(0, 14))) for _ in range(25)] for k in range(3)}
    topics["t0|en"] += topics["t0|en"][:9]
    topics["long|en"] = ["x" * 250 + "abc", "x" * 250 + "abd", "", ""]
    rows = [(k, i, t) for k, v in topics.items() for i, t in enumerate(v)]
    df = spark.createDataFrame(rows, "topic_key string, pos long, title string")
    norm = {(r["topic_key"], r["pos"]): r["n"] for r in df.select("topic_key", "pos", cluster.normalize_title(F.col("title")).alias("n")).collect()}
    expected = {(k, c, m, i) for k, v in topics.items() for c, g in enumerate(naive([norm[(k, i)] for i in range(len(v))])) for m, i in enumerate(g)}
    assert {tuple(r) for r in cluster.cluster_greedy(df).collect()} == expected
    titles = df.select("topic_key", "pos", cluster.normalize_title(F.col("title")).alias("norm"))
    for block in (7, 1000):
        assert {tuple(r) for r in cluster.cluster_large(titles, block).collect()} == expected
    assert cluster.cluster_large(titles.limit(0)).count() == 0


def test_only_leaders_are_compared(spark):
    rng = random.Random(6)
    kinds = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(12)]
    varied = [k[:i] + rng.choice("0123456789") + k[i + 1 :] for k in kinds for i in rng.sample(range(60), 50)]
    titles = list(dict.fromkeys(rng.sample(varied, len(varied))))
    led, compared = cluster.leader_rounds(spark.createDataFrame([("t", i, t) for i, t in enumerate(titles)], "topic_key string, pos long, norm string"), 40)
    expected = {i: g[0] for g in naive(titles) for i in g}
    assert {r["pos"]: r["lead"] for r in led.collect()} == expected
    assert compared < len(titles) ** 2 / 2 / 15, compared


def test_titles_in_blocks_agree_with_the_matcher():
    rng = random.Random(5)
    for _ in range(30):
        letters = rng.choice(["ab", "abc ", "abcdefgh é日"])
        titles = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 10, 30, 60, 198, 199, 200, 230]))) for _ in range(15)]
        titles += rng.choices(titles, k=5)
        i, j = (x.ravel() for x in np.indices((20, 20)))
        assert Titles(titles).similar(i, j).tolist() == [ratio(titles[a], titles[b]) > 0.5 for a, b in zip(i, j, strict=True)]
        assert cluster.greedy(titles) == naive(titles)
    assert cluster.greedy([]) == []
    assert cluster.greedy(["a copy"] * 5000) == [list(range(5000))]


def test_broadcasts_are_bounded_in_rows_and_bytes(spark):
    rows = spark.createDataFrame([(i, "x" * 1000) for i in range(10)], "k long, t string")
    broadcast = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert broadcast(small(rows)) and broadcast(small(rows.where("k < 0")))
    assert not broadcast(small(rows, most=9)) and not broadcast(small(rows, most_bytes=9000))


def test_reply_groups(spark):
    replies = {
        "fenced": "```json\n[[0, 2], [1]]\n```", "mixed": '[[0, "1", 2.5], [9], []]', "none": "[]", "flat": "[0, 1]", "broken": "[[0,", "object": '{"a": 1}', "twice": "so [[0, 1], [1, 2]] done", "null": "null",
    }
    titles = ["aa", "bbbb", "cccc"]
    rows = [(k, i, t, f"s{i}") for k in replies for i, t in enumerate(titles)] + [("single", 0, "x", "s")]
    articles = spark.createDataFrame(rows, "topic_key string, pos long, title string, summary string")
    got = cluster.cluster_hybrid(articles, spark.createDataFrame(list(replies.items()), "topic_key string, reply string")).collect()
    of = lambda k: sorted((r["cluster_pos"], r["member_pos"], r["pos"]) for r in got if r["topic_key"] == k)
    alone = [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert of("fenced") == [(0, 0, 2), (0, 1, 0), (1, 0, 1)]  # the longest title leads
    assert of("mixed") == alone and of("none") == alone and of("object") == alone
    assert of("twice") == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 2)]
    for k in ("flat", "broken", "null"):
        assert of(k) == sorted((c, m, i) for c, g in enumerate(naive(titles)) for m, i in enumerate(g))
    assert of("single") == [(0, 0, 0)]


def test_replies_to_two_parts(spark):
    articles = spark.createDataFrame([("t", i, t, "s") for i, t in enumerate(["aa", "bbbb", "c", "dddd", "e"])] + [("u", i, "xy"[i], "s") for i in range(2)], "topic_key string, pos long, title string, summary string")
    heads = cluster.cluster_headlines(articles, part=2)
    assert sorted((r["topic_key"], r["part"], r["n"]) for r in heads.collect()) == [("t", 0, 2), ("t", 1, 2), ("t", 2, 1), ("u", 0, 2)]
    replies = spark.createDataFrame([("t", 0, "[[0, 1]]"), ("t", 1, "[[3], [2]]"), ("t", 2, "[[4]]"), ("u", 0, "broken [[0,")], "topic_key string, part long, reply string")
    got = cluster.cluster_hybrid(articles, replies).collect()
    assert sorted((r["cluster_pos"], r["member_pos"], r["pos"]) for r in got if r["topic_key"] == "t") == [(0, 0, 1), (0, 1, 0), (1, 0, 3), (2, 0, 2), (3, 0, 4)]
    assert sorted(r["pos"] for r in got if r["topic_key"] == "u") == [0, 1]
    one_bad = replies.where("part != 1").union(spark.createDataFrame([("t", 1, "null")], replies.schema))
    assert {r["usable"] for r in cluster.parse_groups(one_bad).where("topic_key = 't'").collect()} == {False}


def test_phrases_of_many_lengths(spark):
    text = " ".join(f"w{i}" for i in range(1100))
    topics = [(" ".join(f"w{i}" for i in range(n)), "en") for n in (1, 2, 999, 1001, 1100)] + [("w1 w0", "en")]
    for limit in (0, 100):
        got = match.match_topics(spark.createDataFrame([(1, "x", text, "en")], "article_pos long, title string, description string, lang string"), spark.createDataFrame(topics, "term string, lang string"), broadcast_topics=limit)
        assert sorted(len(r["term"].split()) for r in got.collect()) == [1, 2, 999, 1001, 1100]


def test_phrases_by_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "a", "a", "b", "b", "c", "dd", "e"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40]))) for _ in range(60)]
    phrases = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 25]))) for _ in range(80)] + [" ".join(t.split()[2:30]) for t in texts if len(t.split()) > 30] + ["a OR b", "!!", "a  !  B"]
    articles = spark.createDataFrame([(i, t[:5], t[5:], rng.choice(["en", "de", None])) for i, t in enumerate(texts)], "article_pos long, title string, description string, lang string")
    topics = spark.createDataFrame([(p, k) for p in phrases for k in ("en", "de")], "term string, lang string")
    plain = lambda t: " " + " ".join(t.lower().replace("!", " ").split()) + " "
    for mode in ("any", "phrase"):
        split = (lambda t: t.split(" OR ")) if mode == "any" else (lambda t: [t])
        expected = {(t, r["lang"], r["article_pos"]) for r in articles.collect() if r["lang"] for t in phrases if any(p in plain(f"{r['title']} {r['description']}") for x in split(t) if (p := plain(x)).strip())}
        for limit in (0, 1000):
            assert {tuple(r) for r in match.match_topics(articles, topics, mode, broadcast_topics=limit).collect()} == expected


def test_frequent_words_are_shared_out(spark):
    articles = spark.range(2000).selectExpr("id as article_pos", "'x' as title", "'the one' as description", "'en' as lang")
    sought = articles.select("article_pos", F.col("lang").alias("alang"), F.split(match.searched(F.col("title"), F.col("description")), " ").alias("w"))
    index = match.anchored(match.phrases(spark.createDataFrame([("the", "en"), ("the one", "en"), ("nowhere", "en")], "term string, lang string"), "any"), sought)
    assert {r["term"]: r["freq"] > 500 for r in index.collect()} == {"the": True, "the one": True, "nowhere": False}
    hits = match.shuffled(sought, index, share=500)
    assert hits.groupBy("term").count().orderBy("term").collect() == [("the", 2000), ("the one", 2000)]
    # the words that are not in the index do not pass the filter
    passed = sought.select("alang", F.explode("w").alias("word")).where(match.bloom(index)).groupBy("word").count().collect()
    assert {r["word"] for r in passed} == {"the", "one"}


def test_repeated_urls_give_one_result(spark):
    rows = spark.createDataFrame([(1, "https://news.google.com/1", "d" * 90)], "article_pos long, url string, description string")
    lookup = spark.createDataFrame([("https://news.google.com/1", f"https://b/{k}") for k in (3, 1, 2)], "url string, final_url string")
    assert [r["link"] for r in enrich.resolve_urls(rows, lookup).collect()] == ["https://b/1"]
    pages = spark.createDataFrame([("https://b/1", f"<p>{c * 400}</p>", "text/html") for c in "zyx"], "url string, html string, content_type string")
    assert [r["text"][0] for r in enrich.page_texts(pages).collect()] == ["x"]


def test_enrichment(spark):
    page = "<p>" + "x" * 400 + "</p>"
    articles = spark.createDataFrame([(1, "https://a/1", None), (2, "https://news.google.com/2", "d" * 81), (3, "https://news.google.com/3", "d" * 81), (4, "https://a/4", "short")], "article_pos long, url string, description string")
    resolved = enrich.resolve_urls(articles, spark.createDataFrame([("https://news.google.com/2", "https://b/2")], "url string, final_url string"))
    assert {(r["article_pos"], r["link"]) for r in resolved.collect()} == {(1, "https://a/1"), (2, "https://b/2"), (4, "https://a/4")}
    pages = spark.createDataFrame([("https://a/1", page, "text/html"), ("https://b/2", page, "application/pdf")], "url string, html string, content_type string")
    found = enrich.attach_text(resolved, pages)
    assert {(r["article_pos"], r["text"][0], len(r["text"])) for r in found.collect()} == {(1, "x", 400), (2, "d", 81)}


def test_first_place_last_event(spark):
    rows = spark.createDataFrame([("a", "l", 10, 0, 0, 3), ("a", "l", 20, 1, 0, 0), ("a", "m", 30, 0, 1, 0)], "email string, link string, event_id long, lang_pos int, term_pos int, cluster_pos long")
    got = {r["link"]: (tuple(r["ord"]), r["event_id"]) for r in deliver.dedupe_events(rows).collect()}
    assert got == {"l": ((0, 0, 3), 20), "m": ((0, 1, 0), 30)}


def test_a_hot_topic_is_shared_out(spark):
    config = lambda *t: [("en", " ".join(f'"{x}"' for x in t))]
    people = [(f"u{i}", [], config("hot", f"t{i % 7}") if i % 3 else config(f"t{i % 7}")) for i in range(600)] + [("", [], config("hot"))]
    profiles = spark.createDataFrame(people, "email string, keywords_for_display array<string>, search_configs array<struct<lang_code:string,query_string:string>>").repartition(6)
    events = spark.createDataFrame([(k * 100 + i, f"{t}|en", f"l{i}", i) for k, t in enumerate(["hot", "t1", "t2", "nobody"]) for i in range(9)], "event_id long, topic_key string, link string, cluster_pos long")
    plain = sorted(map(tuple, deliver.fan_out(profiles, events).collect()))
    assert len(plain) == 9 * (400 + sum(i % 7 in (1, 2) for i in range(600)))
    assert sorted(map(tuple, deliver.fan_out(profiles, events, broadcast_rows=0, share=50).collect())) == plain
    terms = deliver.profile_terms(profiles.where("email != ''")).withColumn("topic_key", F.concat_ws("|", "term", "lang"))
    parts = deliver.shared_out(terms, events, 50).groupBy("topic_key", "part").agg(F.count_distinct("email").alias("n")).collect()
    hot = [r["n"] for r in parts if r["topic_key"] == "hot|en"]
    assert len(hot) == 8 and max(hot) < 80 and sum(hot) == 400  # a third of all terms, but no task has them


def test_two_recipients_get_one_new_link(spark):
    config = [("en", '"t"')]
    profiles = spark.createDataFrame([("a", ["c"], config), ("b", [], config), ("", [], config), ("d", [], [])], "email string, keywords_for_display array<string>, search_configs array<struct<lang_code:string,query_string:string>>")
    events = spark.createDataFrame([(1, "t|en", "new", 0), (2, "t|en", "old", 1), (3, "u|en", "x", 0)], "event_id long, topic_key string, link string, cluster_pos long")
    new = deliver.new_events(events, spark.createDataFrame([("old",)], "link string"))
    got = deliver.dedupe_events(deliver.fan_out(profiles, new)).collect()
    assert {(r["email"], r["link"]) for r in got} == {("a", "new"), ("b", "new")}
    items = new.select("event_id", F.lit("<i>").alias("item"))
    out = deliver.assemble_digest(profiles, deliver.dedupe_events(deliver.fan_out(profiles, new)), items, "N", "2024-01-02").collect()
    assert {(r["email"], r["n_events"], tuple(r["links"])) for r in out} == {("a", 1, ("new",)), ("b", 1, ("new",))}
    assert all(r["subject"] == "AUTOMÁTICO | N (02/01/2024)" for r in out)
