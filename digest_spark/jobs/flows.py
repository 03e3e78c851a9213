"""Whole flows: responses to profiles, articles to events, events to digests."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digest_spark.operators import cluster, deliver, enrich, match, prefs, triage
from digest_spark.operators.replies import Judge, with_replies
from digest_spark.sources import ledger
from digest_spark.tables import has_table, written


def profiles_from_responses(responses: DataFrame, lang_map: DataFrame, dictionary: DataFrame, default_language: str) -> DataFrame:
    """Newest response of each person, as a search profile."""
    return prefs.build_profiles(latest_people(responses, default_language), lang_map, dictionary)


def latest_people(responses: DataFrame, default_language: str) -> DataFrame:
    """(email, response_seq, modified, categories, languages) of each person's newest response."""
    valid = prefs.parse_modified(prefs.valid_responses(responses))
    flat = valid.select("response_seq", "email", "modified", prefs.choices(F.col("categories")).alias("categories"), prefs.choices(F.col("languages")).alias("languages"))
    newest = prefs.latest_by_key(flat)
    return newest.withColumn("languages", prefs.default_languages(F.col("languages"), default_language))


def single_events(articles: DataFrame) -> DataFrame:
    """An event for each article, as if no two were about the same fact; the summary is the description's first sentence."""
    none = F.array().cast("array<struct<link:string,publisher:string>>")
    return articles.select(
        F.col("article_pos").alias("event_id"), "topic_key", F.col("article_pos").alias("cluster_pos"), "title", F.col("url").alias("link"), F.substring_index("description", ".", 1).alias("summary"), "published_raw", "publisher", none.alias("others")
    )


def digests(profiles: DataFrame, events: DataFrame, ledger: DataFrame, name: str, as_of: str) -> DataFrame:
    """One digest for each recipient with events that nobody was sent before. Profiles, new events and bodies are written once."""
    profiles, new = written(profiles), written(deliver.new_events(events, ledger))
    members, readers = deliver.by_searches(profiles)
    return deliver.digests_for(profiles, members, written(reader_bodies(readers, new)), name, as_of)


def reader_bodies(readers: DataFrame, new: DataFrame) -> DataFrame:
    """(email, body, n_events, links) of each reader with new events."""
    return deliver.bodies(deliver.dedupe_events(deliver.fan_out(readers, new)), deliver.render_events(new))


@dataclass
class Run:
    """A run whose stages are tables in a shared folder: started again after a failure, it goes on behind the last whole one."""

    spark: SparkSession
    folder: str
    id: str

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder.rstrip('/')}/{self.id}/{name}"
        if not has_table(self.spark, path):
            build().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def relevant(run: Run, articles: DataFrame, judge: Judge, **how) -> DataFrame:
    """The articles that the relevance judge approves of, with batch_no and reply_pos; a batch that it fails on has none."""
    batched = run.stage("batched", lambda: triage.assign_batches(triage.drop_negative(articles)))
    heads = run.stage("headlines", lambda: triage.batch_headlines(batched))
    replies = run.stage("relevance", lambda: with_replies(heads, F.concat_ws("\n", "topic_key", "lines"), judge, f"{run.folder}/replies-relevance", **how))
    return triage.select_approved(batched, replies)


def enriched_list(run: Run, approved: DataFrame, lookup: DataFrame, pages: DataFrame, writer: Judge, **how) -> DataFrame:
    """(topic_key, pos, title, link, summary, published_raw, publisher): each topic's list of articles with a final link, a text and a summary."""
    texts = run.stage("texts", lambda: enrich.attach_text(enrich.resolve_urls(approved, lookup), pages))
    said = run.stage("summaries", lambda: with_replies(texts, F.col("text"), writer, f"{run.folder}/replies-summary", **how))
    rows = said.where("reply is not null").withColumn("summary", enrich.clean_summary(F.col("reply"))).withColumn("place", F.col("batch_no") * (1 << 20) + F.col("reply_pos"))
    return match.ordinals(rows, "topic_key", "place").select("topic_key", F.col("ordinal").alias("pos"), "title", "link", "summary", "published_raw", "publisher")


def clustered_events(run: Run, rows: DataFrame, judge: Judge, part: int = cluster.PART, **how) -> DataFrame:
    """One event for each cluster of the list, by the same-event judge, and by title similarity where its replies are of no use."""
    asked = lambda name: lambda lists: run.stage(name, lambda: with_replies(lists.where("n > 1"), F.concat_ws("\n", "topic_key", "lines"), judge, f"{run.folder}/replies-events", **how))
    first = asked("events-in-parts")(cluster.cluster_headlines(rows, part))
    clusters = run.stage("clusters", lambda: cluster.cluster_hybrid(rows, first, asked("events-of-leaders"), part))
    return deliver.build_events(clusters, rows)


def digest_run(run: Run, responses: DataFrame, lang_map: DataFrame, dictionary: DataFrame, articles: DataFrame, lookup: DataFrame, pages: DataFrame, judges: tuple[Judge, Judge, Judge], ledger_folder: str, send: Callable[[DataFrame], DataFrame], name: str, as_of: str, default_language: str, part: int = cluster.PART, **how) -> DataFrame:
    """From responses and articles to digests that were sent, and their links in the ledger; every stage is recorded.

    judges: relevance, summary and same event. send takes the digests and gives (email) of those that were acknowledged; only
    their links are recorded, so what was not delivered is new in the next run. Recording is by the run's
    id: done again it changes nothing. `how` goes to with_replies.
    """
    relevance, writer, same = judges
    profiles = run.stage("profiles", lambda: profiles_from_responses(responses, lang_map, dictionary, default_language))
    rows = run.stage("articles", lambda: enriched_list(run, relevant(run, articles, relevance, **how), lookup, pages, writer, **how))
    events = run.stage("events", lambda: clustered_events(run, rows, same, part, **how))
    new = run.stage("new", lambda: ledger.unsent(events, ledger_folder, but=run.id))
    members, readers = deliver.by_searches(profiles)
    # what is recorded are the bodies: one for each list of searches, not one for each recipient
    found = run.stage("bodies", lambda: reader_bodies(readers, new))
    out = deliver.digests_for(profiles, members, found, name, as_of)
    sent = run.stage("sent", lambda: send(out).select("email").distinct())
    if not ledger.has_batch(run.spark, ledger_folder, run.id):
        told = members.join(sent, "email", "left_semi").select(F.col("reader").alias("email")).distinct()
        ledger.append(found.join(told, "email", "left_semi").select(F.explode("links").alias("link")), ledger_folder, run.id)
    return out
