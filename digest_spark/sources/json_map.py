"""A JSON object from keys to lists, read in splits by many tasks, however long the file or one of its lists is.

The file is cut at its quotation marks, which Spark does in splits of any size. Whether a piece is inside a string, how
deep it is nested and what list and element it is in are running counts along the file: sums of the splits before, and
within a split a window. Only the pieces of one element meet in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.tables import written

BRACKETS = r"[\[\]{}]|[^\[\]{}]+"


def running(rows: DataFrame, **counts: Column) -> DataFrame:
    """The rows (split, at, sub, ...) with each count's sum over all rows before."""
    marked = rows.withColumns({f"__{k}": c.cast("long") for k, c in counts.items()})
    before = Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    sums = marked.groupBy("split").agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in counts])
    starts = sums.select("split", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__start_{k}") for k in counts])
    inner = Window.partitionBy("split").orderBy("at", "sub").rowsBetween(Window.unboundedPreceding, -1)
    found = marked.join(F.broadcast(starts), "split")
    return found.withColumns({k: F.col(f"__start_{k}") + F.coalesce(F.sum(f"__{k}").over(inner), F.lit(0)) for k in counts}).drop(*[f"__{k}" for k in counts], *[f"__start_{k}" for k in counts])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(split, at, sub, text, inside, depth): strings, brackets and what is between them, in order by the first three; depth is that before a piece."""
    cut = spark.read.option("lineSep", '"').text(path).select(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.lit(0).alias("sub"), "value")
    # a quotation mark is part of a string if the string's piece ends in an odd number of backslashes
    ends = F.length(F.regexp_extract("value", r"\\*$", 0)) % 2 == 0
    told = running(cut, quotes=ends)
    first = (F.col("split") == 0) & (F.col("at") == F.min("at").over(Window.partitionBy("split")))
    told = told.select("split", "at", (F.col("quotes") % 2 == 1).alias("inside"), F.when(first, F.col("value")).otherwise(F.concat(F.lit('"'), "value")).alias("text"))
    parts = F.when(F.col("inside"), F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(BRACKETS), F.lit(0)))
    tokens = written(told.select("split", "at", "inside", F.posexplode(parts).alias("sub", "text")))
    return running(tokens, depth=F.when(F.col("inside"), 0).when(F.col("text").isin("{", "["), 1).when(F.col("text").isin("}", "]"), -1).otherwise(0))


def joined(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): the pieces of each key in order."""
    ordered = F.array_sort(F.collect_list(F.struct("split", "at", "sub", "text")))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))


def read_map(spark: SparkSession, path: str, item: T.StructType, *, strict: bool = False) -> DataFrame:
    """(topic_key, pos, item) of a file with a JSON object from keys to lists of objects; keys with empty lists have null items.

    Of equal keys the last counts. strict: a broken file is an error; else it has no rows.
    """
    outside = ~F.col("inside")
    opens = lambda depth, *x: outside & (F.col("depth") == depth) & F.col("text").isin(*x)
    rows = running(pieces(spark, path), lists=opens(1, "["), elements=opens(2, "{"))
    rows = written(rows.withColumn("element", F.col("elements") + opens(2, "{").cast("long")))
    of_lists = rows.where((F.col("depth") >= 3) | opens(2, "{"))
    parsed = joined(of_lists, "lists", "element").withColumn("item", F.from_json("text", item))
    parsed = written(parsed.select("lists", "element", "item", F.try_parse_json("text").isNotNull().alias("whole")))
    named = joined(rows.where("inside and depth = 1").withColumn("list", F.col("lists") + 1), "list")
    keys = written(named.select("list", F.get(F.from_json(F.concat(F.lit("["), "text", F.lit('"]')), "array<string>"), F.lit(0)).alias("topic_key")))
    last = rows.where("not inside").agg(F.max_by(F.col("depth") + F.when(F.col("text").isin("}", "]"), -1).otherwise(0), F.struct("split", "at", "sub")).alias("depth"), F.min("depth").alias("least"), F.max(opens(1, "[").cast("int") * (F.col("lists") + 1)).alias("lists")).first()
    odd = rows.where(opens(1, "{") | opens(2, "[") | opens(0, "[") | (F.col("depth") == 2) & (F.col("inside") | outside & F.col("text").rlike(r"^[^\[\]{},\s]|[^\s,]\s*[^\s,]")) & ~F.col("text").isin("{", "}", "[", "]"))
    sound = last["depth"] == 0 and last["least"] == 0 and odd.isEmpty() and parsed.where("not whole").isEmpty() and keys.count() == (last["lists"] or 0) and keys.where("topic_key is null").isEmpty()
    if not sound:
        if strict:
            raise ValueError(f"{path} is no JSON object of lists of objects")
        parsed, keys = parsed.limit(0), keys.limit(0)
    chosen = keys.groupBy("topic_key").agg(F.max("list").alias("lists"))
    first = parsed.groupBy("lists").agg(F.min("element").alias("first"))
    found = chosen.join(first, "lists", "left").join(parsed, "lists", "left")
    return found.select("topic_key", (F.col("element") - F.col("first")).cast("int").alias("pos"), "item")


def write_map(rows: DataFrame, path: str) -> None:
    """Writes (topic_key, pos, item), pos counting from 0 in each key, as one JSON object of lists, an item a line, to a folder with one file.

    The lines are sorted by all tasks; one writes them, as they come, for the format is one file. Columns of items that are null are left out.
    """
    first = rows.agg(F.min("topic_key")).first()[0]
    key = F.substring(F.to_json(F.array("topic_key")), F.lit(2), F.length(F.to_json(F.array("topic_key"))) - 2)
    opening = F.concat(F.when(F.col("topic_key") == F.lit(first), "{").otherwise("], "), key, F.lit(": ["))
    lines = rows.select(F.lit(0).alias("end"), "topic_key", "pos", F.concat(F.when(F.col("pos") == 0, opening).otherwise(", "), F.to_json("item")).alias("value"))
    end = rows.sparkSession.range(1).select(F.lit(1), F.lit(""), F.lit(0).cast(rows.schema["pos"].dataType), F.lit("{}" if first is None else "]}"))
    lines.union(end).orderBy("end", "topic_key", "pos").select("value").coalesce(1).write.mode("overwrite").text(path)
