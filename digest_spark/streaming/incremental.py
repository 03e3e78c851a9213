"""Incremental run: new articles only, each link at most once for a topic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from digest_spark.functions.text import topic_key
from digest_spark.operators.match import phrases, searched
from digest_spark.operators.triage import drop_negative
from digest_spark.sources import ledger
from digest_spark.tables import small, written

DELAY = "24 hours"


def stream_new_articles(stream: DataFrame, topics: DataFrame, *, delay: str = DELAY) -> DataFrame:
    """New (topic_key, link, title, published_ts) of a stream of articles (title, link, term_key, published_ts).

    Noise goes first; articles meet the topics by key; a link that a topic had within the delay is
    dropped, and so are articles later than the watermark.
    """
    kept = drop_negative(stream).withWatermark("published_ts", delay)
    keyed = kept.join(topics.select("topic_key"), "topic_key")
    return keyed.dropDuplicatesWithinWatermark(["topic_key", "link"]).select("topic_key", "link", "title", "published_ts")


def match_stream(stream: DataFrame, topics: DataFrame, mode: str = "any") -> DataFrame:
    """The stream's articles (title, description, lang, ...) with the topic_key of every topic whose phrase they hold.

    An article that holds several phrases of a topic is given for each; stream_new_articles takes one.
    The topics are measured once, when the stream is set up.
    """
    wanted = phrases(topics, mode).select(topic_key(F.col("term"), F.col("lang")).alias("topic_key"), F.col("lang").alias("__lang"), "phrase")
    there = F.contains(F.concat(F.lit(" "), searched(F.col("title"), F.col("description")), F.lit(" ")), F.concat(F.lit(" "), "phrase", F.lit(" ")))
    return stream.drop("topic_key").join(small(wanted), (F.col("lang") == F.col("__lang")) & there).drop("__lang", "phrase")


def run_available(new: DataFrame, sink: Callable[[DataFrame, str], None], folder: str, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Handles all that is there now: each micro-batch less the links that the ledger in `folder` holds goes to the sink, with an id.

    The id, the stream's name and the micro-batch's number, is recorded in the ledger with the links once the sink
    has returned. A micro-batch that is repeated after a failure is left out if its id is recorded; else the sink gets
    the same rows with the same id again, as the ledger's links of that id do not count. So a
    sink that replaces what it has of an id, like `replacing`, takes each link exactly once.
    """

    def handle(batch: DataFrame, number: int) -> None:
        own = f"{name}_{number}"
        if ledger.has_batch(batch.sparkSession, folder, own):
            batch.write.format("noop").mode("overwrite").save()  # the stream's state wants it read
            return
        rows = written(ledger.unsent(batch, folder, but=own))
        if not rows.isEmpty():
            sink(rows, own)
        ledger.append(rows, folder, own)

    return new.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replacing(path: str) -> Callable[[DataFrame, str], None]:
    """A sink of a folder for each micro-batch, which a repetition replaces."""
    return lambda rows, own: rows.withColumn("batch", F.lit(own)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
