"""Articles about the same event, by a judge's groups or by title similarity.

Input rows: (topic_key, pos, title, ...), pos being places from 0 in a topic's list. Results:
(topic_key, cluster_pos, member_pos, pos), the principal article of a cluster being member 0.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digest_spark.functions.similarity import ASKED, LONG, PAIRS, Titles
from digest_spark.functions.text import groups_json, normalize_title
from digest_spark.operators.links import linked
from digest_spark.operators.match import ordinals
from digest_spark.operators.replies import Judge, ask
from digest_spark.tables import small, written

GROUP_PROMPT = "Tópico: %s\nManchetes numeradas:\n%s\nJunte os números que tratam do mesmo fato numa lista JSON de listas."
#: Topics with more articles are clustered by rounds, which take so many of their titles at once and compare their leaders
#: with the later ones in chunks.
ONE_TASK, BLOCK, CHUNK = 4_000, 4_000, 1_000
#: Spark's setting up to which a topic's list is cut to its first titles in each task, before it is shuffled.
CUT_EARLY = "spark.sql.optimizer.windowGroupLimitThreshold"
#: Headlines shown to the judge at once.
PART = 200
#: Groups of one part are numbered below PART_GROUPS, all groups of a topic below LEFTOVER.
PART_GROUPS, LEFTOVER = 1 << 20, 1 << 62


def cluster_headlines(articles: DataFrame, part: int = PART) -> DataFrame:
    """(topic_key, part, n, lines): a line `[i] title || summary start...` for each article, in parts of bounded size."""
    return headline_lists(articles.withColumn("part", F.floor(F.col("pos") / part)))


def headline_lists(rows: DataFrame) -> DataFrame:
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.replace(F.coalesce("title", F.lit("")), F.lit("\n"), F.lit(" ")), F.lit(" || "), F.substring(F.coalesce("summary", F.lit("")), 1, 60), F.lit("...\n"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"))))
    return rows.groupBy("topic_key", "part").agg(F.count("*").alias("n"), F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("lines"))


def judge_groups(headlines: DataFrame, judge: Judge, tasks: int | None = None, **how) -> DataFrame:
    """Headline lists of two articles or more with the same-event judge's replies; `how` goes to ask."""
    return ask(headlines.where("n > 1"), judge, tasks, **how)


def parse_groups(replies: DataFrame) -> DataFrame:
    """(topic_key, group_pos, member_pos, id, usable) of every integer in a reply's list of lists.

    Replies: (topic_key, reply), with `part` if a topic's headlines were judged in parts; then the groups
    of one part follow those of the part before, and a topic is usable if all its parts are.
    A reply that is no list, or whose list holds an element that can't be gone through (a number,
    true, null), is not usable; its topic has one row without an id. Members that are no integers are
    left out one by one; a topic without any member has one usable row without an id.
    """
    spark, name = replies.sparkSession, f"replies_{uuid.uuid4().hex}"
    part = F.col("part").cast("long") if "part" in replies.columns else F.lit(0).cast("long")
    parsed = replies.select("topic_key", part.alias("part"), F.try_parse_json(groups_json(F.col("reply"))).alias("v"))
    parsed = parsed.withColumn("kind", F.coalesce(F.schema_of_variant("v"), F.lit("")))
    parsed.where("kind like 'ARRAY%'").createOrReplaceTempView(name)
    outer = spark.sql(f"select topic_key, part, part * {PART_GROUPS} + g.pos as group_pos, g.value as v, coalesce(schema_of_variant(g.value), '') as kind from {name}, lateral variant_explode_outer(v) as g")
    spark.catalog.dropTempView(name)
    through = "kind like 'ARRAY%' or kind like 'OBJECT%' or kind = 'STRING' or group_pos is null"
    whole = outer.groupBy("topic_key").agg(F.min(F.expr(through)).alias("whole"))
    outer.where("kind like 'ARRAY%'").createOrReplaceTempView(name)
    members = spark.sql(f"select topic_key, group_pos, m.pos as member_pos, try_variant_get(m.value, '$', 'bigint') as id from {name}, lateral variant_explode(v) as m where schema_of_variant(m.value) = 'BIGINT'")
    spark.catalog.dropTempView(name)
    lists = parsed.groupBy("topic_key").agg(F.min(F.expr("kind like 'ARRAY%' or kind like 'OBJECT%' or kind = 'STRING'")).alias("list"))
    state = lists.join(whole, "topic_key", "left").select("topic_key", (F.col("list") & F.coalesce("whole", F.lit(True))).alias("usable"))
    return state.join(members, "topic_key", "left").select("topic_key", F.col("group_pos").cast("long").alias("group_pos"), F.col("member_pos").cast("long").alias("member_pos"), F.when(F.col("usable"), F.col("id")).alias("id"), "usable")


def rank_members(members: DataFrame) -> DataFrame:
    """Members (topic_key, group_pos, member_pos, pos, title) with `rank`: longest title first, else in the given order."""
    order = Window.partitionBy("topic_key", "group_pos").orderBy(F.desc(F.length(F.coalesce("title", F.lit("")))), "member_pos")
    return members.withColumn("rank", F.row_number().over(order) - 1)


def leaders(articles: DataFrame, groups: DataFrame, part: int = PART) -> DataFrame:
    """(topic_key, node, pos, title, summary): what a topic that was judged in parts is compared by.

    A node is a group of one part, standing for it its principal article, or an article in no group
    (node: LEFTOVER + pos). Topics with one part, or without usable replies, have none.
    """
    parted = articles.groupBy("topic_key").agg(F.max("pos").alias("last")).where(F.col("last") >= part).select("topic_key")
    usable = groups.where("usable").join(parted, "topic_key", "left_semi")
    own = articles.select("topic_key", "pos", "title", "summary").join(usable.select("topic_key").distinct(), "topic_key", "left_semi")
    members = usable.where("id is not null").select("topic_key", "group_pos", "member_pos", F.col("id").alias("pos")).join(own, ["topic_key", "pos"])
    first = rank_members(members).where("rank = 0").select("topic_key", F.col("group_pos").alias("node"), "pos", "title", "summary")
    alone = own.join(members.select("topic_key", "pos").distinct(), ["topic_key", "pos"], "left_anti")
    return first.union(alone.select("topic_key", F.lit(LEFTOVER) + F.col("pos"), "pos", "title", "summary"))


def leader_headlines(found: DataFrame, part: int = PART) -> DataFrame:
    """(topic_key, part, n, lines): headline lists in which every two leaders of a topic meet.

    Leaders are cut into blocks of half a part, and every two blocks share a list. So a topic with k
    leaders takes about 2 (k / part)^2 lists, and that is what a judge who sees no more at once needs.
    """
    every = found.select("topic_key", "pos", "title", "summary").dropDuplicates(["topic_key", "pos"])
    placed = ordinals(every, "topic_key", "pos").withColumn("block", F.floor(F.col("ordinal") / max(1, part // 2))).drop("ordinal")
    blocks = placed.groupBy("topic_key").agg((F.max("block") + 1).alias("blocks"))
    other = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: x != F.col("block")))
    met = placed.join(small(blocks), "topic_key").withColumn("other", F.explode(other))
    return headline_lists(met.withColumn("part", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")))


def merge_parts(groups: DataFrame, found: DataFrame, links: DataFrame) -> DataFrame:
    """parse_groups' rows with the groups of different parts merged that the second replies link.

    found: leaders' rows; links: parse_groups' rows of the replies to leader_headlines. Links carry over:
    if a and b, and b and c, are about one event, so are a and c. A merged group has all members, in order of their
    places, so its principal is chosen anew; groups are ordered by their first article. A topic with a second
    reply that is not usable is not usable.
    """
    bad = links.where("not usable").select("topic_key").distinct()
    named = links.where("usable and id is not null").select("topic_key", "group_pos", F.col("id").alias("pos")).join(found.select("topic_key", "pos").distinct(), ["topic_key", "pos"], "left_semi")
    head = named.groupBy("topic_key", "group_pos").agg(F.min("pos").alias("head"))
    roots = linked(named.join(head, ["topic_key", "group_pos"]).select("topic_key", "pos", "head"), "topic_key", "pos", "head").withColumnRenamed("node", "pos")
    placed = found.select("topic_key", "node", "pos").join(roots, ["topic_key", "pos"], "left")
    # a cluster is known by its links' root, or as a group that nothing links
    placed = placed.select("topic_key", "node", F.col("root").isNull().alias("apart"), F.coalesce("root", "node").alias("cluster"), "pos")
    members = groups.where("usable and id is not null").select("topic_key", F.col("group_pos").alias("node"), "member_pos", F.col("id").alias("pos"))
    own = placed.where(F.col("node") < LEFTOVER).drop("pos").join(members, ["topic_key", "node"])
    once = own.where("not apart").select("topic_key", "apart", "cluster", F.col("pos").alias("member_pos"), "pos")
    once = once.union(placed.where((F.col("node") >= LEFTOVER) & ~F.col("apart")).select("topic_key", "apart", "cluster", "pos", "pos")).distinct()
    rows = written(once.union(own.where("apart").select("topic_key", "apart", "cluster", "member_pos", "pos")))
    spots = rows.groupBy("topic_key", "apart", "cluster").agg(F.min("pos").alias("first"))
    tie = F.row_number().over(Window.partitionBy("topic_key", "first").orderBy("apart", "cluster")) - 1
    spots = spots.withColumn("group_pos", F.col("first") * PART_GROUPS + tie).drop("first")
    merged = rows.join(spots, ["topic_key", "apart", "cluster"]).select("topic_key", "group_pos", "member_pos", F.col("pos").alias("id"), F.lit(True).alias("usable"))
    topics = written(found.select("topic_key").distinct())
    # topics whose articles are all alone keep a row that says that their replies are usable
    none = topics.join(rows.select("topic_key").distinct(), "topic_key", "left_anti").select("topic_key", *[F.lit(None).cast("long").alias(c) for c in ("group_pos", "member_pos", "id")], F.lit(True).alias("usable"))
    every = groups.join(topics, "topic_key", "left_anti").unionByName(merged).unionByName(none)
    fine = every.join(bad, "topic_key", "left_anti")
    return fine.unionByName(bad.select("topic_key", *[F.lit(None).cast("long").alias(c) for c in ("group_pos", "member_pos", "id")], F.lit(False).alias("usable")))


def cluster_from_groups(articles: DataFrame, groups: DataFrame) -> DataFrame:
    """Clusters of the usable replies: their groups in order, then each article in no group by itself.

    groups are parse_groups' rows. Ids that are no place in the topic's list, and groups without
    members, are dropped; an id in two groups is in both clusters.
    """
    usable = groups.where("usable")
    own = articles.join(usable.select("topic_key").distinct(), "topic_key", "left_semi")
    members = usable.where("id is not null").join(own.select("topic_key", F.col("pos").alias("id"), "title"), ["topic_key", "id"]).withColumnRenamed("id", "pos")
    ranked = rank_members(members)
    alone = own.select("topic_key", "pos").join(members.select("topic_key", "pos").distinct(), ["topic_key", "pos"], "left_anti")
    heads = ranked.select("topic_key", F.lit(0).alias("late"), F.col("group_pos").cast("long").alias("at")).distinct()
    heads = heads.union(alone.select("topic_key", F.lit(1), F.col("pos").cast("long")))
    # one number line for groups and then leftovers
    line = heads.withColumn("at2", F.col("late") * F.lit(LEFTOVER) + F.col("at"))
    places = ordinals(line, "topic_key", "at2").select("topic_key", "late", "at", F.col("ordinal").alias("cluster_pos"))
    rows = ranked.select("topic_key", F.lit(0).alias("late"), F.col("group_pos").cast("long").alias("at"), F.col("rank").cast("long").alias("member_pos"), "pos")
    rows = rows.union(alone.select("topic_key", F.lit(1), F.col("pos").cast("long"), F.lit(0).cast("long"), "pos"))
    return rows.join(places, ["topic_key", "late", "at"]).select("topic_key", "cluster_pos", "member_pos", "pos")


def at_once(titles: int) -> int:
    """How many leaders are compared with so many titles at once: a small share of these, as leaders that turn out to be followers are compared in vain."""
    return max(1, PAIRS // titles, min(ASKED // titles, titles // 32))


def greedy(titles: list[str], book: Titles | None = None) -> list[list[int]]:
    """Groups of places: the first unused title leads, and takes the later unused ones that are similar to it.

    Copies of a title that is not LONG are similar to each other and to the same leaders, so they are one.
    The next titles are compared with all later ones at once, as if each led. book: of the different titles.
    """
    places: dict[str | int, list[int]] = {}
    for i, t in enumerate(titles):
        places.setdefault(t if len(t) < LONG else i, []).append(i)
    own = list(places.values())
    book = book or Titles([titles[x[0]] for x in own])
    left, groups = np.arange(len(own)), []
    while left.size:
        heads = min(left.size, at_once(left.size))
        lead, later = np.nonzero(np.arange(left.size) > np.arange(heads)[:, None])
        alike = np.zeros((heads, left.size), bool)
        alike[lead, later] = book.similar(left[lead], left[later])
        used = np.zeros(left.size, bool)
        for k in range(heads):
            if not used[k]:
                alike[k, k] = True
                group = alike[k] & ~used
                used |= group
                groups.append(sorted(i for unit in left[group] for i in own[unit]))
        left = left[~used]
    return groups


def first_similar(book: Titles, leaders: np.ndarray, titles: np.ndarray) -> np.ndarray:
    """For each title the number of the first leader that is similar to it, or -1; a title that has one is compared with no other."""
    out, left, at = np.full(len(titles), -1), np.arange(len(titles)), 0
    while left.size and at < len(leaders):
        heads = leaders[at : at + at_once(left.size)]
        alike = book.similar(np.repeat(heads, left.size), np.tile(titles[left], len(heads))).reshape(len(heads), left.size)
        hit = alike.any(0)
        out[left[hit]] = at + alike[:, hit].argmax(0)
        left, at = left[~hit], at + len(heads)
    return out


def cluster_small(articles: DataFrame) -> DataFrame:
    """Greedy clusters of topics that fit one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        pos = part["pos"].tolist()
        rows = [(part["topic_key"].iloc[0], c, m, pos[i]) for c, group in enumerate(greedy(part["norm"].tolist())) for m, i in enumerate(group)]
        return pd.DataFrame(rows, columns=["topic_key", "cluster_pos", "member_pos", "pos"])

    return articles.groupBy("topic_key").applyInPandas(run, "topic_key string, cluster_pos long, member_pos long, pos long")


def block_leaders(block: DataFrame) -> DataFrame:
    """(topic_key, pos, lead, compared) of a topic's next titles, clustered among themselves in one task."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        pos, titles = part["pos"].to_numpy(), part["norm"].tolist()
        book = Titles(titles)
        lead = np.empty(len(pos), np.int64)
        for group in greedy(titles, book):
            lead[group] = pos[group[0]]
        return pd.DataFrame({"topic_key": part["topic_key"].iloc[0], "pos": pos, "lead": lead, "compared": np.where(np.arange(len(pos)) == 0, book.compared, 0)})

    return block.groupBy("topic_key").applyInPandas(run, "topic_key string, pos long, lead long, compared long")


def led_titles(titles: DataFrame, leaders: DataFrame, chunk: int) -> DataFrame:
    """(topic_key, pos, lead, compared): each title with the first of a few leaders of its topic that is similar to it, or null.

    titles: (topic_key, pos, norm, ordinal). A topic's titles are dealt in chunks, to each of which its leaders come.
    """
    dealt = titles.select("topic_key", F.floor(F.col("ordinal") / chunk).alias("chunk"), F.lit(False).alias("leads"), "pos", "norm")
    chunks = dealt.select("topic_key", "chunk").distinct()
    shown = leaders.join(chunks, "topic_key").select("topic_key", "chunk", F.lit(True).alias("leads"), "pos", "norm")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["leads", "pos"], ascending=[False, True])
        pos, n = part["pos"].to_numpy(), int(part["leads"].sum())
        book = Titles(part["norm"].tolist())
        first = first_similar(book, np.arange(n), np.arange(n, len(pos)))
        lead = pd.array(np.where(first < 0, 0, pos[np.maximum(first, 0)]), dtype="Int64")
        lead[first < 0] = pd.NA
        return pd.DataFrame({"topic_key": part["topic_key"].iloc[0], "pos": pos[n:], "lead": lead, "compared": np.where(np.arange(len(first)) == 0, book.compared, 0)})

    return dealt.union(shown).groupBy("topic_key", "chunk").applyInPandas(run, "topic_key string, pos long, lead long, compared long")


def first_titles(titles: DataFrame, most: int) -> DataFrame:
    """Each topic's first titles, written."""
    place, conf = F.row_number().over(Window.partitionBy("topic_key").orderBy("pos")), titles.sparkSession.conf
    before = conf.get(CUT_EARLY)
    conf.set(CUT_EARLY, max(most, int(before)))
    try:
        return written(titles.withColumn("place", place).where(F.col("place") <= most).drop("place"))
    finally:
        conf.set(CUT_EARLY, before)


def leader_rounds(titles: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """(topic_key, pos, lead) of different titles (topic_key, pos, norm), and how many pairs were compared for it.

    A round takes each topic's next `block` open titles and clusters them among themselves; then all later open titles
    are compared with the leaders that these gave, in their order and until one is similar. What is settled is
    not compared again, so pairs of followers never are. Each round is written.
    """
    open_ = written(ordinals(titles, "topic_key", "pos"))
    told, compared, total = [], 0, open_.count()
    while left := open_.count():
        now = first_titles(open_, block)
        own = written(block_leaders(now.select("topic_key", "pos", "norm")))
        heads = now.join(own.where("pos = lead").select("topic_key", "pos"), ["topic_key", "pos"], "left_semi").select("topic_key", "pos", "norm")
        later = open_.join(own.select("topic_key", "pos"), ["topic_key", "pos"], "left_anti")
        # as titles are settled, those that are left lie farther apart
        found = written(led_titles(later, small(heads), min(block, CHUNK) * (total // left)))
        told += [own, found.where("lead is not null")]
        compared += sum(x.agg(F.sum("compared")).first()[0] or 0 for x in (own, found))
        open_ = written(open_.join(found.where("lead is null").select("topic_key", "pos"), ["topic_key", "pos"], "left_semi"))
    none = titles.select("topic_key", "pos", F.col("pos").alias("lead")).limit(0)
    return reduce(DataFrame.unionByName, [x.select("topic_key", "pos", "lead") for x in told], none), compared


def cluster_large(articles: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same greedy clusters by rounds, in which only leaders are compared with other titles."""
    alone = F.when(F.length("norm") >= LONG, F.col("pos"))
    firsts = written(articles.groupBy("topic_key", "norm", alone.alias("alone")).agg(F.min("pos").alias("first")))
    led, _ = leader_rounds(firsts.select("topic_key", F.col("first").alias("pos"), "norm"), block)
    led = written(led.select("topic_key", "lead", F.col("pos").alias("first")))
    leaders = led.where("lead = first").select("topic_key", F.col("lead").alias("pos"))
    same = articles.withColumn("alone", alone).alias("x").join(firsts.alias("y"), (F.col("x.topic_key") == F.col("y.topic_key")) & (F.col("x.norm") == F.col("y.norm")) & F.col("x.alone").eqNullSafe(F.col("y.alone")))
    members = same.select("x.topic_key", "x.pos", "y.first").join(led, ["topic_key", "first"]).select(F.struct("topic_key", "lead").alias("cluster"), "pos")
    numbers = ordinals(leaders, "topic_key", "pos").select("topic_key", F.col("pos").alias("lead"), F.col("ordinal").alias("cluster_pos"))
    placed = ordinals(members, "cluster", "pos").select("cluster.*", "pos", F.col("ordinal").alias("member_pos"))
    return placed.join(numbers, ["topic_key", "lead"]).select("topic_key", "cluster_pos", "member_pos", "pos")


def cluster_greedy(articles: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """Greedy clusters by title similarity: topics of up to one_task articles in a task each, larger ones by rounds."""
    titles = written(articles.select("topic_key", F.col("pos").cast("long").alias("pos"), normalize_title(F.col("title")).alias("norm")))
    hot = small(titles.groupBy("topic_key").count().where(F.col("count") > one_task).select("topic_key"))
    out = cluster_small(titles.join(hot, "topic_key", "left_anti"))
    return out if hot.isEmpty() else out.unionByName(cluster_large(titles.join(hot, "topic_key", "left_semi")))


def cluster_hybrid(articles: DataFrame, replies: DataFrame, second: Callable[[DataFrame], DataFrame] | None = None, part: int = PART) -> DataFrame:
    """Clusters by the replies that are usable; greedy ones for topics with another reply or none; a single article is its cluster.

    second: gives leader_headlines' lists (topic_key, part, n, lines) their replies; without it groups of
    different parts of a topic are told apart. With it articles have a summary.
    """
    groups = written(parse_groups(replies))
    if second is not None:
        found = written(leaders(articles, groups, part))
        if not found.isEmpty():
            links = written(parse_groups(second(leader_headlines(found, part))))
            groups = written(merge_parts(groups, found, links))
    sizes = articles.groupBy("topic_key").count()
    judged = small(groups.where("usable").select("topic_key").distinct().join(sizes.where("count > 1"), "topic_key", "left_semi"))
    by_judge = cluster_from_groups(articles.join(judged, "topic_key", "left_semi"), groups.join(judged, "topic_key", "left_semi"))
    return by_judge.unionByName(cluster_greedy(articles.join(judged, "topic_key", "left_anti")))


def cluster_judged(articles: DataFrame, judge: Judge, part: int = PART, tasks: int | None = None, **how) -> DataFrame:
    """Clusters by a same-event judge who sees `part` headlines at once, of topics of any length.

    Each part is judged, then the groups' leaders of different parts. Every reply is written before it is used.
    """
    asked = lambda lists: written(judge_groups(lists, judge, tasks, **how))
    return cluster_hybrid(articles, asked(cluster_headlines(articles, part)), asked, part)
