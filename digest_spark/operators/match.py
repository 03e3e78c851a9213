"""Articles for topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digest_spark.functions.text import words_normalised
from digest_spark.tables import fits, small, written

#: An index of phrases is broadcast up to so many.
BROADCAST_TOPICS = 100_000
#: One article in so many tells how frequent words are; neighbours of a word that are shuffled with it on either side.
SAMPLED, NEAR = 256, 8
PAGE = 1_000
#: Rows that one task numbers.
MOST_ROWS = 1 << 20


def recent(articles: DataFrame, as_of: str, period: str = "24 hours") -> DataFrame:
    """Articles published in (as_of - period, as_of]."""
    end = F.lit(as_of).cast("timestamp")
    return articles.where((F.col("published_ts") > end - F.expr(f"interval {period}")) & (F.col("published_ts") <= end))


def phrases(topics: DataFrame, mode: str) -> DataFrame:
    """(term, lang, phrase): a topic's normalised phrases; `any` takes a term's alternatives apart at OR."""
    parts = F.split("term", " OR ") if mode == "any" else F.array("term")
    return topics.select("term", "lang", F.explode(parts).alias("p")).select("term", "lang", words_normalised(F.col("p")).alias("phrase")).where("phrase != ''").distinct()


def searched(text: Column, description: Column) -> Column:
    return words_normalised(F.concat_ws(" ", text, description))


def match_topics(articles: DataFrame, topics: DataFrame, mode: str = "any", *, broadcast_topics: int = BROADCAST_TOPICS) -> DataFrame:
    """(term, lang, article_pos) where a phrase of the topic stands in the article's title or description.

    Phrases match whole words. Each is indexed by its rarest word and that word's place in it; the
    words of an article are looked up one by one, and a phrase is verified around the word that leads to
    it. A small index is broadcast. Of a large one a Bloom filter goes first, and the words that pass
    are shuffled with their neighbours, frequent ones in several shares.
    """
    sought = articles.select("article_pos", F.col("lang").alias("alang"), F.split(searched(F.col("title"), F.col("description")), " ").alias("w"))
    index = written(anchored(phrases(topics, mode), sought))
    hits = probed(sought, index) if fits(index, broadcast_topics) else shuffled(sought, index)
    return hits.select("term", "lang", "article_pos").distinct()


def anchored(wanted: DataFrame, sought: DataFrame) -> DataFrame:
    """(term, lang, phrase, token, at, n, freq): each phrase with its rarest word, that word's first place, and its number of words.

    How rare words are is told from one article in SAMPLED, and long words go first where it does not
    tell; that decides about speed only. freq is the word's estimated number of places.
    """
    words = wanted.select("term", "lang", "phrase", F.posexplode(F.split("phrase", " ")).alias("at", "token"))
    told = sought.where(F.pmod(F.xxhash64("article_pos"), F.lit(SAMPLED)) == 0).select(F.col("alang").alias("lang"), F.explode("w").alias("token"))
    counts = told.join(small(words.select("lang", "token").distinct()), ["lang", "token"], "left_semi").groupBy("lang", "token").count()
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), -F.length("token"), "token", "at")).alias("x")
    found = words.join(small(counts), ["lang", "token"], "left").groupBy("term", "lang", "phrase").agg(rarest, F.count("*").cast("int").alias("n"))
    return found.select("term", "lang", "phrase", "x.token", "x.at", "n", (F.col("x.count") * SAMPLED).alias("freq"))


def stands(words: str, place: Column, anchor: str, n: str, phrase: str) -> Column:
    """Whether the phrase of n words, whose word number `anchor` is at `place` of the array, stands there as a whole."""
    start = F.greatest(place - F.col(anchor) + 1, F.lit(1))
    return (place >= F.col(anchor)) & (F.array_join(F.slice(words, start, F.col(n)), " ") == F.col(phrase))


def probed(sought: DataFrame, index: DataFrame) -> DataFrame:
    """The articles' words looked up in a broadcast index; no row leaves its task before it is a hit."""
    # an outer explode, as Spark would normalise each text once more to see whether a plain one has rows
    places = sought.select("article_pos", "alang", "w", F.posexplode_outer("w").alias("place", "word"))
    return places.join(F.broadcast(index), (F.col("alang") == F.col("lang")) & (F.col("word") == F.col("token")) & stands("w", F.col("place"), "at", "n", "phrase"))


def bloom(index: DataFrame) -> Column:
    """Whether a word of an article (alang, word) may be in the index, by two bits of its hash in a table of bounded size."""
    bits = min(1 << 20, max(1 << 10, 1 << (16 * index.count()).bit_length()))

    def places(lang: str, word: str) -> list[Column]:
        h = F.xxhash64(lang, word)
        return [F.pmod(x, F.lit(bits)) for x in (h, F.shiftright(h, 32))]

    set_bits = index.select(F.explode(F.array(*places("lang", "token"))).alias("b"))
    longs = set_bits.groupBy(F.floor(F.col("b") / 64).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("v")).collect()
    table = [0] * (bits // 64)
    for r in longs:
        table[r["at"]] = r["v"]
    whole = F.from_json(F.lit(str(table)), "array<bigint>")
    first, second = (F.call_function("shiftright", F.get(whole, F.floor(b / 64).cast("int")), (b % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for b in places("alang", "word"))
    return first & second


def shuffled(sought: DataFrame, index: DataFrame, near: int = NEAR, share: int = MOST_ROWS) -> DataFrame:
    """The same by a shuffle of the words that may be in the index, each with its neighbours.

    Phrases that reach farther than `near` words from their rarest one are verified in the article
    itself, once their part around it has been found.
    """
    low = F.greatest(F.col("at") - near, F.lit(0))
    cut = index.withColumns({"core_at": F.col("at") - low, "core_n": F.least(F.col("n"), F.col("at") + near + 1) - low, "w": F.split("phrase", " ")})
    cut = cut.withColumn("core", F.array_join(F.slice("w", low + 1, F.col("core_n")), " ")).withColumn("whole", F.col("core_n") == F.col("n")).drop("w")
    shares = F.floor(F.col("freq") / share).cast("int") + 1
    sides = cut.withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    often = cut.where(shares > 1).groupBy("lang", "token").agg(F.max(shares).alias("shares"))
    places = sought.select("article_pos", "alang", "w", F.posexplode_outer("w").alias("place", "word")).where(bloom(index))
    around = F.slice("w", F.greatest(F.col("place") - near + 1, F.lit(1)), F.least(F.col("place"), F.lit(near)) + near + 1)
    places = places.select("article_pos", "alang", "word", F.least(F.col("place"), F.lit(near)).alias("skip"), around.alias("around"))
    marked = places.join(small(often), (F.col("alang") == F.col("lang")) & (F.col("word") == F.col("token")), "left").drop("lang", "token")
    marked = marked.withColumn("own_share", F.pmod(F.xxhash64("article_pos"), F.coalesce("shares", F.lit(1))).cast("int"))
    same = (F.col("alang") == F.col("lang")) & (F.col("word") == F.col("token")) & (F.col("own_share") == F.col("share"))
    found = marked.join(sides, same & stands("around", F.col("skip"), "core_at", "core_n", "core"))
    hits = found.select("term", "lang", "phrase", "whole", "article_pos").distinct()
    if cut.where("not whole").isEmpty():
        return hits
    hits = written(hits)
    texts = sought.select("article_pos", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("words"))
    longer = hits.where("not whole").join(texts, "article_pos").where(F.contains("words", F.concat(F.lit(" "), "phrase", F.lit(" ")))).select(hits.columns)
    return hits.where("whole").union(longer)


def group_by_topic(topics: DataFrame, hits: DataFrame, page: int = PAGE) -> DataFrame:
    """(topic_key, page, articles): article positions in order, in pages of bounded size; topics without hits have an empty page."""
    numbered = ordinals(hits.select("topic_key", "article_pos").distinct(), "topic_key", "article_pos")
    pages = numbered.groupBy("topic_key", F.floor(F.col("ordinal") / page).alias("page")).agg(F.array_sort(F.collect_list("article_pos")).alias("articles"))
    none = F.array().cast("array<bigint>")
    return topics.select("topic_key").distinct().join(pages, "topic_key", "left").select("topic_key", F.coalesce("page", F.lit(0).cast("long")).alias("page"), F.coalesce("articles", none).alias("articles"))


def ordinals(rows: DataFrame, key: str, pos: str, *, most: int = MOST_ROWS) -> DataFrame:
    """The rows with `ordinal`, their place from 0 in the key's list by the integer `pos`.

    Keys are counted first. One with up to `most` rows is numbered by a window; the lists of longer
    ones are cut at quantiles of their positions, the parts counted and summed up along the key, and
    rows are numbered within their part alone. So a key's list is never sorted by one task, however
    long it is and however its positions are spread. Equal positions follow each other in no set order.
    """
    sizes = rows.groupBy(F.col(key).alias("__key")).count()
    longest = sizes.agg(F.max("count")).first()[0] or 0
    if longest <= most:
        return rows.withColumn("ordinal", numbered(key, pos=pos))
    long_lists = rows.join(small(sizes.where(F.col("count") > most).select("__key")), rows[key].eqNullSafe(F.col("__key")), "left_semi")
    cut = parts_of(long_lists, key, pos, -(-2 * longest // most))
    counts = written(cut.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__at")).count())
    before = F.sum("count").over(Window.partitionBy("__key").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1))
    starts = small(counts.select("__key", "__at", F.coalesce(before, F.lit(0)).alias("__start")))
    placed = cut.withColumn("__inner", numbered(key, "__part", pos=pos)).join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__at")))
    found = placed.withColumn("ordinal", F.col("__start") + F.col("__inner")).select(*rows.columns, "ordinal")
    others = rows.join(small(sizes.where(F.col("count") > most).select("__key")), rows[key].eqNullSafe(F.col("__key")), "left_anti")
    return others.withColumn("ordinal", numbered(key, pos=pos)).unionByName(found)


def numbered(*keys: str, pos: str) -> Column:
    return (F.row_number().over(Window.partitionBy(*keys).orderBy(pos)) - 1).cast("long")


def parts_of(rows: DataFrame, key: str, pos: str, parts: int) -> DataFrame:
    """The rows with `__part`, the number of quantiles of the key's positions (`parts` at most, written once) that a row's position exceeds."""
    fractions = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    quantiles = rows.groupBy(F.col(key).alias("__key")).agg(F.percentile_approx(pos, fractions, max(10_000, 20 * parts)).alias("__cuts"))
    cuts = written(quantiles.select("__key", F.array_distinct("__cuts").alias("__cuts")))
    found = rows.join(small(cuts), rows[key].eqNullSafe(F.col("__key")))
    part = F.size(F.filter("__cuts", lambda x: x < F.col(pos)))
    # dealt by key and part, so that no task takes a whole key
    return found.withColumn("__part", part).drop("__key", "__cuts").repartition(key, "__part")
