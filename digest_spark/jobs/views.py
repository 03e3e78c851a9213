"""The jobs' inputs as views over the test tables."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digest_spark.functions.text import topic_key

AS_OF = "2024-01-02 06:00:00"
DEFAULT_LANGUAGE = "English"
LANGUAGES = (("English", "en"), ("Deutsch", "de"))
DICTIONARY = (
    ("en", "1-URGENT", "src0"), ("en", "2-HIGH", "src1"), ("en", "3-MEDIUM", "src2"), ("en", "5-LOW", "src3"), ("en", "F", "src0"), ("en", "O", "src5"),
    ("de", "1-URGENT", "src6"), ("de", "F", "src7"), ("de", "O", "src0"),
)
TOPICS = (("the", "en"), ("of the OR and the", "en"), ("heed", "en"), ("tion", "en"), ("la OR le", "fr"), ("und", "de"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses as the list service gives them: text stamps, choices as objects, one cell in eleven missing."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    listed = lambda *x: F.array(*x).cast("array<string>")
    cats = F.when(F.col("o_orderkey") % 3 == 0, listed(F.col("o_orderpriority"))).when(F.col("o_orderkey") % 3 == 1, listed(F.col("o_orderpriority"), F.col("o_orderstatus"))).otherwise(listed(F.col("o_orderstatus"), F.lit("Other")))
    four = F.col("o_orderkey") % 4
    langs = F.when(four == 0, listed()).when(four == 1, listed(F.lit("English"))).when(four == 2, listed(F.lit("English"), F.lit("Deutsch"))).otherwise(listed(F.lit("Deutsch"), F.lit("Klingon")))
    cell = lambda x: F.when(F.col("o_orderkey") % 11 != 0, F.struct(x.alias("results")))
    return o.select(
        F.col("o_orderkey").alias("response_seq"),
        F.when(F.col("o_orderkey") % 97 != 0, F.concat(F.lit("user"), F.col("o_custkey").cast("string"), F.lit("@example.com"))).alias("email"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"),
        cell(cats).alias("categories"),
        cell(langs).alias("languages"),
    )


def lang_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LANGUAGES), "lang_name string, lang_code string")


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DICTIONARY), "lang_code string, key string, value string")


def topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPICS), "term string, lang string")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: the first 80 characters are the headline, all others the description; dates spread over three days."""
    return articles_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def articles_of(d: DataFrame) -> DataFrame:
    flat = F.regexp_replace("text", r"\s+", " ")
    rows = d.withColumn("flat", flat).select(
        F.col("doc_id").alias("article_pos"),
        F.substring("flat", 1, 80).alias("title"),
        F.expr("substring(flat, 81)").alias("description"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("source").alias("publisher"),
        "lang",
        (F.lit("2023-12-31 06:00:00").cast("timestamp") + F.make_dt_interval(mins=F.pmod(F.col("doc_id") * 7919, F.lit(4320)).cast("int"))).alias("published_ts"),
        topic_key(F.col("source"), F.col("lang")).alias("topic_key"),
    )
    return rows.withColumn("published_raw", F.concat(F.date_format("published_ts", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).where("article_pos % 7 = 0").select(F.col("url").alias("link"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 10 == 3, "application/pdf").when(F.col("page_id") % 10 == 7, "image/PNG").otherwise("text/html; charset=utf-8")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html", kind.alias("content_type"))


def triage_reply(key, batch):
    """Stands in for the relevance judge: lists of ids, NULL, words around ids, or no reply at all."""
    case = F.pmod(F.length(key) + batch.cast("int"), F.lit(4))
    return F.when(case == 0, "0, 2, 2, 99").when(case == 1, "NULL").when(case == 2, "Relevant: 1, 3, 5 and 29.")


def group_reply(key):
    """Stands in for the same-event judge."""
    case = (F.length(key) * 5 + F.ascii(F.substring(key, 4, 1)) + F.ascii(F.substring(key, F.length(key), F.lit(1)))) % 6
    texts = ('```json\n[[0, 2], [1]]\n```', 'So: [[0, "1", 2.5], [9999], [3, 4]] done', "[]", "broken [[0, ", "[[1, 0], [0, 3]]", "[0, 1]")
    out = F.lit(texts[5])
    for k in range(4, -1, -1):
        out = F.when(case == k, texts[k]).otherwise(out)
    return out


def same_initial(lists: pd.DataFrame) -> list[str]:
    """Stands in for a same-event judge that is of one mind: headlines with the same initial are one event."""
    replies = []
    for lines in lists["lines" if "lines" in lists else "prompt"]:
        events: dict[str, list[int]] = {}
        for place, initial in re.findall(r"^\[(\d+)\] (.)", lines, re.MULTILINE):
            events.setdefault(initial.lower(), []).append(int(place))
        replies.append(json.dumps([x for x in events.values() if len(x) > 1]))
    return replies
