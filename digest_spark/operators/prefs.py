"""From form responses to search profiles and the search plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digest_spark.functions.text import extract_terms, topic_key
from digest_spark.tables import small

BASE_LANGUAGE = "pt-419"
DEFAULT_LANGUAGE = "Português"
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def valid_responses(responses: DataFrame) -> DataFrame:
    """Responses with an email and a time of change."""
    return responses.where((F.length("email") > 0) & (F.length(F.col("modified").cast("string")) > 0))


def parse_modified(responses: DataFrame, *, strict: bool = True) -> DataFrame:
    """`modified` as a timestamp. A bad value fails the run, or is null if not strict."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return responses.withColumn("modified", parse("modified", F.lit(STAMP)) if not strict else parse("modified", STAMP))


def quarantined(responses: DataFrame) -> DataFrame:
    """The valid responses whose time can't be parsed."""
    return responses.where(F.try_to_timestamp("modified", F.lit(STAMP)).isNull())


def choices(cell: Column) -> Column:
    """The choices of a multiple-choice cell; none if the cell or its list is missing."""
    return F.coalesce(cell["results"], F.array().cast("array<string>"))


def default_languages(languages: Column, default: str = DEFAULT_LANGUAGE) -> Column:
    return F.when(F.size(F.coalesce(languages, F.array().cast("array<string>"))) == 0, F.array(F.lit(default))).otherwise(languages)


def latest_by_key(responses: DataFrame, key: str = "email", modified: str = "modified", seq: str = "response_seq") -> DataFrame:
    """Each key's newest row; of equally new ones the first. Combined before the shuffle, without a sort of the history."""
    newest = F.max_by(F.struct("*"), F.struct(F.col(modified), -F.col(seq))).alias("row")
    return responses.groupBy(F.col(key).alias("__key")).agg(newest).select("row.*")


def map_languages(people: DataFrame, lang_map: DataFrame) -> DataFrame:
    """(email, lang_pos, lang_code) of the chosen languages that have a code."""
    chosen = people.select("email", F.posexplode("languages").alias("lang_pos", "lang_name"))
    return chosen.join(small(lang_map), "lang_name").where(F.length("lang_code") > 0).select("email", "lang_pos", "lang_code")


def map_categories(people: DataFrame, lang_map: DataFrame, dictionary: DataFrame, base: str = BASE_LANGUAGE) -> DataFrame:
    """(email, lang_pos, cat_pos, lang_code, term): each category's term in each chosen language.

    A category without a term stands for itself; a language without a dictionary has the base one.
    """
    own = small(dictionary.select("lang_code", F.col("key").alias("category"), "value"))
    loaded = small(dictionary.select(F.col("lang_code").alias("loaded")).distinct())
    # the languages are exploded with the row at hand: no join by email
    pairs = people.select("email", F.posexplode("languages").alias("lang_pos", "lang_name"), "categories").select("email", "lang_pos", "lang_name", F.posexplode("categories").alias("cat_pos", "category"))
    coded = pairs.join(small(lang_map), "lang_name").where(F.length("lang_code") > 0).join(loaded, F.col("lang_code") == F.col("loaded"), "left").withColumn("used", F.coalesce("loaded", F.lit(base)))
    found = coded.join(own.withColumnRenamed("lang_code", "used"), ["used", "category"], "left")
    return found.select("email", "lang_pos", "cat_pos", "lang_code", F.coalesce(F.nullif("value", F.lit("")), "category").alias("term"))


def build_queries(terms: DataFrame) -> DataFrame:
    """(email, lang_pos, lang_code, query_string): the quoted terms in category order."""
    ordered = F.array_sort(F.collect_list(F.struct("cat_pos", "term")))
    query = F.array_join(F.transform(ordered, lambda x: F.concat(F.lit('"'), x["term"], F.lit('"'))), " OR ")
    return terms.groupBy("email", "lang_pos", "lang_code").agg(query.alias("query_string"))


def build_profiles(people: DataFrame, lang_map: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One profile for each person: categories to show and the ordered searches, an empty list if there are none."""
    queries = build_queries(map_categories(people, lang_map, dictionary))
    ordered = F.array_sort(F.collect_list(F.struct("lang_pos", "lang_code", "query_string")))
    searches = queries.groupBy("email").agg(F.transform(ordered, lambda x: F.struct(x["lang_code"].alias("lang_code"), x["query_string"].alias("query_string"))).alias("search_configs"))
    none = F.array().cast("array<struct<lang_code:string,query_string:string>>")
    return people.select("email", F.col("categories").alias("keywords_for_display")).join(searches, "email", "left").withColumn("search_configs", F.coalesce("search_configs", none))


def profile_terms(profiles: DataFrame) -> DataFrame:
    """(email, lang_pos, term_pos, term, lang): every quoted term of every search."""
    configs = profiles.select("email", F.posexplode("search_configs").alias("lang_pos", "config"))
    terms = configs.select("email", "lang_pos", F.col("config.lang_code").alias("lang"), F.posexplode(extract_terms(F.col("config.query_string"))).alias("term_pos", "term"))
    return terms.select("email", "lang_pos", "term_pos", "term", "lang")


def search_plan(profiles: DataFrame) -> DataFrame:
    """The distinct (term, lang) to search for, with their topic keys."""
    return profile_terms(profiles).select("term", "lang").distinct().withColumn("topic_key", topic_key(F.col("term"), F.col("lang")))
