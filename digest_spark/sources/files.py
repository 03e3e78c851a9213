"""Readers and writers: responses, mappings, profiles, topic maps, the ledger and digests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark import schemas

BASE_LANGUAGE = "pt-419"
STRIP = r"(?U)^\s+|\s+$"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads it from."""
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise
    return True


def read_responses_csv(spark: SparkSession, path: str, categories: str = "CategoriasNoticias", languages: str = "EscolherLinguas") -> DataFrame:
    """Form responses from an export: (response_seq, email, modified, categories, languages)."""
    schema = schemas.struct(CreatedTime=schemas.S, CreatedUser=schemas.S, **{categories: schemas.S, languages: schemas.S})
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    listed = lambda c: F.from_json(F.col(c), "array<string>")
    return rows.select(
        F.monotonically_increasing_id().alias("response_seq"), F.col("CreatedUser").alias("email"), F.to_timestamp("CreatedTime", "dd/MM/yyyy HH:mm").alias("modified"), listed(categories).alias("categories"), listed(languages).alias("languages")
    )


def read_responses_json(spark: SparkSession, path: str, categories: str, languages: str) -> DataFrame:
    """Form responses as the list service returns them; `modified` is still text, the choices still objects."""
    rows = spark.read.schema(schemas.response(categories, languages)).json(path)
    return rows.select(F.monotonically_increasing_id().alias("response_seq"), F.col("Author.EMail").alias("email"), F.col("Modified").alias("modified"), F.col(categories).alias("categories"), F.col(languages).alias("languages"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a two-column TSV file; the last of equal keys counts; a missing file is empty.

    The first line is skipped only if it holds `source:` or `SharePoint`: any other header is an entry.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, value string")
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    lines = lines.where(~((F.col("line") == 0) & (F.col("text").contains("source:") | F.col("text").contains("SharePoint"))))
    cells = lines.select("line", F.split(F.regexp_replace("text", STRIP, ""), "\t").alias("cells")).where(F.size("cells") >= 2)
    cell = lambda k: F.regexp_replace(F.get("cells", F.lit(k)), STRIP, "")
    return cells.select("line", cell(0).alias("key"), cell(1).alias("value")).groupBy("key").agg(F.max_by("value", "line").alias("value"))


def load_dictionaries(spark: SparkSession, folder: str, lang_map: DataFrame, name: str = "keywords") -> DataFrame:
    """(lang_code, key, value) for every code of the language map (lang_name, lang_code).

    A code's dictionary is folder/name-code.txt; one without a file has the base dictionary, folder/name.txt.
    """
    base = read_mapping(spark, f"{folder}/{name}.txt")
    codes = sorted({r[0] for r in lang_map.select("lang_code").distinct().toLocalIterator()} | {BASE_LANGUAGE})
    out = None
    for code in codes:
        path = f"{folder}/{name}-{code}.txt"
        own = read_mapping(spark, path) if code != BASE_LANGUAGE and exists(spark, path) else base
        own = own.select(F.lit(code).alias("lang_code"), "key", "value")
        out = own if out is None else out.unionByName(own)
    return out


def write_profiles(profiles: DataFrame, path: str) -> bool:
    """Writes the profiles as JSON lines; an empty result is not written."""
    if profiles.isEmpty():
        return False
    profiles.write.mode("overwrite").json(path)
    return True


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROFILE).json(path)


def read_topic_map(spark: SparkSession, path: str, item: T.StructType, *, strict: bool = False) -> DataFrame:
    """(topic_key, pos, item) of a JSON object from topic keys to lists; topics with empty lists have null items.

    strict: a broken file is an error; else it has no rows.
    """
    kind = T.MapType(schemas.S, schemas.A(item))
    mode = {"mode": "FAILFAST"} if strict else {}
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", kind, mode).alias("m"))
    return parsed.select(F.explode("m").alias("topic_key", "items")).select("topic_key", F.posexplode_outer("items").alias("pos", "item"))


def write_topic_table(rows: DataFrame, path: str) -> None:
    """Writes a long topic table, one folder for each language."""
    rows.write.mode("overwrite").partitionBy("lang").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The distinct links sent so far, one a line; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], "link string")
    return spark.read.text(path).select(F.regexp_replace("value", STRIP, "").alias("link")).distinct()


def append_ledger(links: DataFrame, path: str) -> None:
    """Adds the links that the ledger does not hold yet."""
    new = ledger_additions(links, read_ledger(links.sparkSession, path))
    new.select("link").write.mode("append").text(path)


def ledger_additions(links: DataFrame, ledger: DataFrame) -> DataFrame:
    return links.select("link").where("link is not null").distinct().join(ledger, "link", "left_anti")


def write_digests(digests: DataFrame, path: str) -> None:
    digests.write.mode("overwrite").json(path)


