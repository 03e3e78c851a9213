"""Registered queries: each operator on the views over the test tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digest_spark import schemas
from digest_spark.functions import html, similarity, text
from digest_spark.jobs import flows, views
from digest_spark.operators import cluster, deliver, enrich, match, prefs, triage
from digest_spark.sources import files, json_map, ledger
from digest_spark.streaming import incremental
from digest_spark.tables import shared_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NAME = "Boletim"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def people(s: SparkSession, d: str) -> DataFrame:
    return flows.latest_people(views.responses(s, d), views.DEFAULT_LANGUAGE)


def profiles(s: SparkSession, d: str) -> DataFrame:
    return prefs.build_profiles(people(s, d), views.lang_map(s), views.dictionary(s))


def batched(s: SparkSession, d: str) -> DataFrame:
    return triage.assign_batches(triage.drop_negative(views.articles(s, d)))


def approved(s: SparkSession, d: str) -> DataFrame:
    """Approved articles with pos, their place in the topic's list of approved ones."""
    rows = batched(s, d)
    replies = rows.select("topic_key", "batch_no").distinct().withColumn("reply", views.triage_reply(F.col("topic_key"), F.col("batch_no")))
    found = triage.select_approved(rows, replies).withColumn("place", F.col("batch_no") * 1000 + F.col("reply_pos"))
    return match.ordinals(found, "topic_key", "place").withColumnRenamed("ordinal", "pos")


def listed(s: SparkSession, d: str) -> DataFrame:
    """All articles with pos, their place in the topic's list."""
    return match.ordinals(views.articles(s, d), "topic_key", "article_pos").withColumnRenamed("ordinal", "pos")


def group_replies(s: SparkSession, d: str) -> DataFrame:
    return views.articles(s, d).select("topic_key").distinct().withColumn("reply", views.group_reply(F.col("topic_key")))


def clusters(s: SparkSession, d: str) -> DataFrame:
    return cluster.cluster_from_groups(listed(s, d), written(cluster.parse_groups(group_replies(s, d))))


def events(s: SparkSession, d: str) -> DataFrame:
    return flows.single_events(views.articles(s, d))


def chosen(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The events chosen for each reader, and the recipients (email, reader)."""
    members, readers = deliver.by_searches(profiles(s, d))
    new = written(deliver.new_events(events(s, d), views.ledger(s, d)).select("topic_key", "link", "event_id", "cluster_pos"))
    return written(deliver.dedupe_events(deliver.fan_out(readers, new))), members


# --- responses ---


@query
def valid_responses(s, d):
    return prefs.parse_modified(prefs.valid_responses(views.responses(s, d))).select("response_seq", "email", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query
def choices(s, d):
    cell = prefs.choices(F.col("categories"))
    return views.responses(s, d).select("response_seq", F.array_join(cell, ",").alias("categories"), F.size(cell).alias("n"))


@query
def default_languages(s, d):
    return views.responses(s, d).select("response_seq", F.array_join(prefs.default_languages(prefs.choices(F.col("languages")), views.DEFAULT_LANGUAGE), ",").alias("languages"))


@query
def latest_by_email(s, d):
    return people(s, d).select("email", "response_seq", F.date_format("modified", "yyyy-MM-dd").alias("modified"))


@query
def map_languages(s, d):
    return prefs.map_languages(people(s, d), views.lang_map(s))


@query
def map_categories(s, d):
    return prefs.map_categories(people(s, d), views.lang_map(s), views.dictionary(s))


@query
def build_queries(s, d):
    return prefs.build_queries(prefs.map_categories(people(s, d), views.lang_map(s), views.dictionary(s)))


@query
def build_profiles(s, d):
    one = lambda x: F.concat(x["lang_code"], F.lit("="), x["query_string"])
    return profiles(s, d).select("email", F.array_join("keywords_for_display", ",").alias("keywords"), F.array_join(F.transform("search_configs", one), ";").alias("searches"))


@query
def extract_terms(s, d):
    return prefs.profile_terms(profiles(s, d))


@query
def search_plan(s, d):
    return prefs.search_plan(profiles(s, d))


# --- articles ---


@query
def recent(s, d):
    return match.recent(views.articles(s, d), views.AS_OF).select("article_pos", F.date_format("published_ts", "yyyy-MM-dd HH:mm").alias("published"))


@query
def match_topics_phrase(s, d):
    return match.match_topics(views.articles(s, d), views.topics(s), "phrase")


@query
def match_topics_any(s, d):
    return match.match_topics(views.articles(s, d), views.topics(s), "any")


@query
def match_topics_ngrams(s, d):
    return match.match_topics(views.articles(s, d), views.topics(s), "any", broadcast_topics=0)


@query
def group_by_topic(s, d):
    topics = views.topics(s).withColumn("topic_key", text.topic_key(F.col("term"), F.col("lang")))
    hits = match.match_topics(views.articles(s, d), views.topics(s)).withColumn("topic_key", text.topic_key(F.col("term"), F.col("lang")))
    return match.group_by_topic(topics, hits).select("topic_key", "page", F.size("articles").alias("n"), F.array_join("articles", ",").alias("articles"))


@query
def split_topic_key(s, d):
    term, lang = text.split_topic_key(F.when(F.col("article_pos") % 5 == 0, F.col("publisher")).otherwise(F.col("topic_key")))
    return views.articles(s, d).select("article_pos", term.alias("term"), lang.alias("lang"))


@query
def drop_negative(s, d):
    return triage.drop_negative(views.articles(s, d)).select("article_pos", "title")


@query
def drop_excluded(s, d):
    return triage.drop_negative(views.articles(s, d), words=("heed", *text.EXCLUDED_TITLE_WORDS)).select("article_pos", "title")


@query
def assign_batches(s, d):
    return batched(s, d).select("topic_key", "article_pos", "batch_no", "idx")


@query
def batch_headlines(s, d):
    return triage.batch_headlines(batched(s, d))


@query
def with_prompt(s, d):
    rows = triage.batch_headlines(batched(s, d))
    term, _ = text.split_topic_key(F.col("topic_key"))
    return rows.select("topic_key", "batch_no", text.with_prompt(triage.TRIAGE_PROMPT, term, F.col("lines")).alias("prompt"))


@query
def text_or_description(s, d):
    page = F.when(F.col("article_pos") % 3 == 0, F.concat(F.lit("page "), F.col("title")))
    return views.articles(s, d).select("article_pos", text.text_or_description(page, F.col("description")).alias("text")).where("text is not null")


@query
def normalize_title(s, d):
    suffixed = F.when(F.col("article_pos") % 2 == 0, F.concat("title", F.lit(" - "), "publisher")).otherwise(F.concat(F.lit("  "), F.col("title"), F.lit(" | "), F.col("description")))
    return views.articles(s, d).select("article_pos", text.normalize_title(suffixed).alias("norm"))


@query
def clean_title(s, d):
    suffixed = F.when(F.col("article_pos") % 3 == 0, F.col("title")).otherwise(F.concat("title", F.lit(" - "), "publisher", F.when(F.col("article_pos") % 3 == 1, "").otherwise(" - x")))
    return views.articles(s, d).select("article_pos", text.clean_title(suffixed, F.col("publisher")).alias("title"))


@query
def format_published(s, d):
    raw = F.when(F.col("article_pos") % 10 == 4, "").when(F.col("article_pos") % 10 == 5, F.concat(F.col("published_raw"), F.lit("+1"))).otherwise(F.col("published_raw"))
    return views.articles(s, d).select("article_pos", text.format_published(raw).alias("published"))


@query
def summary_language(s, d):
    return views.articles(s, d).select("article_pos", text.summary_language(F.col("lang")).alias("language"))


@query
def cluster_headlines(s, d):
    return cluster.cluster_headlines(listed(s, d).withColumnRenamed("description", "summary"))


# --- replies ---


@query
def parse_relevant_ids(s, d):
    keys = batched(s, d).select("topic_key", "batch_no").distinct()
    ids = text.parse_relevant_ids(views.triage_reply(F.col("topic_key"), F.col("batch_no")))
    return keys.select("topic_key", "batch_no", F.array_join(ids, ",").alias("ids"))


@query
def select_approved(s, d):
    return approved(s, d).select("topic_key", "pos", "article_pos", "batch_no", "reply_pos")


@query
def clean_summary(s, d):
    raw = F.concat(F.lit(' "'), F.col("description"), F.lit('"" \n'))
    return views.articles(s, d).select("article_pos", text.clean_summary(raw).alias("summary"))


@query
def parse_groups(s, d):
    return cluster.parse_groups(group_replies(s, d)).select("topic_key", F.col("group_pos").cast("long").alias("group_pos"), F.col("member_pos").cast("long").alias("member_pos"), "id", "usable")


@query
def rank_members(s, d):
    groups = written(cluster.parse_groups(group_replies(s, d))).where("usable and id is not null")
    members = groups.join(listed(s, d).select("topic_key", F.col("pos").alias("id"), F.expr("substring(title, 1, 80 - cast(article_pos % 3 as int) * 5)").alias("title")), ["topic_key", "id"]).withColumnRenamed("id", "pos")
    return cluster.rank_members(members).select("topic_key", F.col("group_pos").cast("long").alias("group_pos"), "pos", F.col("rank").cast("long").alias("rank"))


@query
def cluster_from_groups(s, d):
    return clusters(s, d)


@query
def enriched_articles(s, d):
    rows = approved(s, d).withColumn("link", F.col("url")).withColumn("summary", text.clean_summary(F.col("description")))
    return enrich.enriched(rows)


# --- pages ---


@query
def is_final_url(s, d):
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://news.google.com/rss/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return views.pages(s, d).select("page_id", text.is_final_url(url).alias("final"))


@query
def is_text_content(s, d):
    return views.pages(s, d).select("page_id", text.is_text_content(F.col("content_type")).alias("is_text"))


@query
def resolve_urls(s, d):
    raw = views.pages(s, d).select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://news.google.com/rss/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"), F.col("url").alias("target"))
    lookup = raw.where("page_id % 8 = 0").select("url", F.col("target").alias("final_url"))
    return enrich.resolve_urls(raw.drop("target"), lookup).select("page_id", "link")


@query
def gate_text(s, d):
    return views.pages(s, d).select("page_id", text.gate_text(F.col("html")).alias("text"))


@query
def html_to_text(s, d):
    return views.pages(s, d).select("page_id", html.html_to_text("html").alias("text"))


@query
def attach_text(s, d):
    rows = views.pages(s, d)
    found = rows.select("page_id", F.col("url").alias("link"), F.col("html").alias("description"))
    return enrich.attach_text(found, rows.select("url", "html", "content_type")).select("page_id", "link", "text")


# --- delivery ---


@query
def fan_out(s, d):
    return deliver.fan_out(profiles(s, d), events(s, d))


@query
def fan_out_shares(s, d):
    """fan_out by shuffles, with topics in shares."""
    return deliver.fan_out(profiles(s, d), events(s, d), broadcast_rows=0, share=100)


@query
def topic_map(s, d):
    """The articles' titles and urls written as one JSON object of lists, and read from it in splits."""
    rows = listed(s, d).select("topic_key", "pos", F.struct("title", "url").alias("item"))
    out = f"{shared_folder(s)}/map-{uuid.uuid4().hex}"
    json_map.write_map(rows, out)
    found = json_map.read_map(s, out, schemas.RAW_ARTICLE, strict=True)
    return found.select("topic_key", "pos", "item.title", "item.url")


@query
def new_events(s, d):
    return deliver.new_events(events(s, d), views.ledger(s, d)).select("event_id", "topic_key", "link")


@query
def dedupe_events(s, d):
    return deliver.to_recipients(*chosen(s, d)).select("email", "link", "ord.lang_pos", "ord.term_pos", "ord.cluster_pos", "event_id")


@query
def also_seen(s, d):
    rows = listed(s, d).select("topic_key", "pos", F.when(F.col("article_pos") % 9 != 0, F.col("url")).alias("link"), F.when(F.col("article_pos") % 8 != 0, F.col("publisher")).alias("publisher"), "title", F.lit("").alias("summary"), "published_raw")
    return deliver.build_events(clusters(s, d), rows).select("topic_key", "cluster_pos", text.also_seen(F.col("others")).alias("also"))


@query
def render_items(s, d):
    return deliver.render_events(events(s, d))


@query
def assemble_digest(s, d):
    out = flows.digests(profiles(s, d), events(s, d), views.ledger(s, d), NAME, views.AS_OF)
    return out.select("email", "subject", "html", "n_events", F.array_join("links", " ").alias("links"))


@query
def digest_run(s, d):
    """The whole run, with stand-ins for the judges, over clustered events; every digest is acknowledged."""
    out = f"{shared_folder(s)}/run-{uuid.uuid4().hex}"
    ledger.append(views.ledger(s, d), f"{out}/ledger", "before")
    lookup = s.createDataFrame([], "url string, final_url string")
    pages = s.createDataFrame([], "url string, html string, content_type string")
    judges = (every_second_id, first_words, views.same_initial)
    found = flows.digest_run(
        flows.Run(s, out, "run1"), views.responses(s, d), views.lang_map(s), views.dictionary(s), views.articles(s, d), lookup, pages, judges, f"{out}/ledger", lambda x: x, NAME, views.AS_OF, views.DEFAULT_LANGUAGE, part=50, batch=100,
    )
    return found.select("email", "subject", "html", "n_events", F.array_join("links", " ").alias("links"))


@query
def ledger_append(s, d):
    links = chosen(s, d)[0].select("link").union(views.articles(s, d).select("url"))
    return files.ledger_additions(links, views.ledger(s, d))


@query
def topic_funnel(s, d):
    articles = views.articles(s, d)
    return deliver.topic_funnel(articles, triage.drop_negative(articles), approved(s, d), clusters(s, d))


@query
def recipient_counts(s, d):
    found, members = chosen(s, d)
    return deliver.to_recipients(deliver.recipient_counts(found), members)


# --- helpers and hooks: no SQL ---


@query
def title_ratio(s, d):
    rows = listed(s, d).select("topic_key", "pos", text.normalize_title(F.col("title")).alias("norm"))
    after = rows.select("topic_key", (F.col("pos") - 1).alias("pos"), F.col("norm").alias("next"))
    return rows.join(after, ["topic_key", "pos"]).select("topic_key", "pos", similarity.title_ratio("norm", "next").alias("ratio"))


@query
def cluster_greedy(s, d):
    return cluster.cluster_greedy(listed(s, d))


@query
def cluster_greedy_large(s, d):
    return cluster.cluster_greedy(listed(s, d), one_task=0)


@query
def cluster_hybrid(s, d):
    return cluster.cluster_hybrid(listed(s, d), group_replies(s, d))


def first_words(rows) -> list[str]:
    return [" ".join(str(x).split()[:12]) for x in rows["text" if "text" in rows else "prompt"]]


def every_second_id(rows) -> list[str]:
    """Stands in for the relevance judge: every second headline of the prompt."""
    return [", ".join(re.findall(r"^ID (\d+): ", x, re.MULTILINE)[::2]) for x in rows["prompt"]]


def every_second(rows) -> list[str]:
    return [", ".join(str(i) for i in range(0, int(n), 2)) for n in rows["n"]]


@query
def score_batches(s, d):
    batches = triage.batch_headlines(batched(s, d))
    return triage.score_batches(batches, every_second, tasks=4, batch=50).select("topic_key", "batch_no", "reply")


@query
def summarize(s, d):
    rows = views.articles(s, d).select("article_pos", F.col("description").alias("text"))
    return enrich.summarize(rows, first_words, tasks=8, batch=200).select("article_pos", "summary")


@query
def judge_groups(s, d):
    heads = cluster.cluster_headlines(listed(s, d).withColumnRenamed("description", "summary"))
    return cluster.judge_groups(heads, views.same_initial, tasks=4, batch=20).select("topic_key", "part", "reply")


@query
def cluster_judged(s, d):
    return cluster.cluster_judged(listed(s, d).withColumnRenamed("description", "summary"), views.same_initial, part=16, tasks=8, batch=50)


@query
def stream_new_articles(s, d):
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = stream.select(F.concat(F.col("event_type"), F.lit("|en")).alias("topic_key"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("link"), F.col("event_type").alias("title"), F.col("ts").cast("timestamp").alias("published_ts"))
    topics = s.createDataFrame([("view|en",), ("click|en",), ("signup|en",)], "topic_key string")
    out = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    ledger.append(s.createDataFrame([("u1",), ("u2",)], "link string"), f"{out}/ledger", "before")
    run = incremental.run_available(incremental.stream_new_articles(rows, topics), incremental.replacing(f"{out}/sent"), f"{out}/ledger", f"{out}/state")
    run.awaitTermination()
    return s.read.schema("topic_key string, link string, title string").parquet(f"{out}/sent").drop("batch")


@query
def match_stream(s, d):
    """The documents as a stream of articles, matched by phrase, less the links that were sent before."""
    table = s.read.parquet(f"{d}/documents.parquet")
    # a stream reads a folder: the table's, or the one that its only file is in
    folder, only = (d, "documents.parquet") if table.inputFiles()[0].endswith("/documents.parquet") else (f"{d}/documents.parquet", "*.parquet")
    stream = views.articles_of(s.readStream.schema(table.schema).option("pathGlobFilter", only).parquet(folder))
    topics = views.topics(s)
    keys = topics.select(text.topic_key(F.col("term"), F.col("lang")).alias("topic_key"))
    out = f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"
    ledger.append(views.ledger(s, d), f"{out}/ledger", "before")
    found = incremental.stream_new_articles(incremental.match_stream(stream.withColumnRenamed("url", "link"), topics), keys)
    incremental.run_available(found, incremental.replacing(f"{out}/sent"), f"{out}/ledger", f"{out}/state").awaitTermination()
    rows = s.read.schema("topic_key string, link string, title string, published_ts timestamp").parquet(f"{out}/sent")
    return rows.select("topic_key", "link", "title", F.date_format("published_ts", "yyyy-MM-dd HH:mm").alias("published"))


@query
def unsent_events(s, d):
    """new_events by a ledger of several batches, of which only the parts are read that may hold a link."""
    out = f"{shared_folder(s)}/ledger-{uuid.uuid4().hex}"
    sent = views.articles(s, d).where("article_pos % 7 = 0").select(F.col("url").alias("link"), (F.col("article_pos") % 3).alias("day"))
    for day in range(3):
        ledger.append(sent.where(F.col("day") == day), out, f"day{day}")
    return ledger.unsent(events(s, d), out).select("event_id", "topic_key", "link")
