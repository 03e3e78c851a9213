"""How filters interact: what each of them removes, alone and after others, in every order.

Rows are routed by the xxhash of their text. A partition first brings its own rows together, so
one text is sent once from each, with the least id that it has there; the rows of other ids are
settled at once. Where the fingerprints arrive, chains hold the full texts that share one, and ids
that turn out not to be the least of their text are emitted as duplicates. Each row is then a mask
of the filters that it fails, and combineByKey merges the masks' count vectors of each part. All
orders of the filters are read off those vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
#: Each filter's letter, and whether a text (its characters, UTF-8 bytes and words) fails it.
FILTERS: dict[str, Callable[[str, bytes, list[bytes]], bool]] = {
    "A": lambda text, raw, words: len(words) < 50,
    "B": lambda text, raw, words: 100 * len(set(words)) < 65 * len(words),
    "C": lambda text, raw, words: 100 * (len(raw) - len(raw.translate(None, UPPER))) > 5 * len(text),
    "D": lambda text, raw, words: len(raw.translate(None, SYMBOLS)) < len(raw),
}
#: The letter of the filter that a text fails if a row with a smaller id has it.
DUPLICATE = "E"
#: Texts of so many bytes meet in a partition, on average.
PARTITION_BYTES = 48 << 20
#: From so many input partitions on, copies of a text from SALTS groups of partitions are merged first.
SALTED_FROM, SALTS = 4096, 64

#: (fingerprint, text or None if the row is settled, mask, id, rows of each part)
Head = tuple[int, str | None, int, object, dict[str, int]]


def failed(text: str, filters: dict[str, Callable]) -> int:
    """The filters that a text fails, as bits in their order. Words are parted by ASCII white space."""
    raw = text.encode()
    words = raw.split()
    return sum(1 << i for i, fails in enumerate(filters.values()) if fails(text, raw, words))


def place(fingerprint: int, more: object) -> int:
    return xxhash.xxh64_intdigest(f"{fingerprint} {more}")


def heads(rows: Iterator[tuple], filters: dict[str, Callable]) -> Iterator[Head]:
    """Each text of a partition with its least id, and the other ids as duplicates."""
    chains: dict[int, list[tuple[str, int, dict]]] = {}
    without_id: dict[tuple[str, int], int] = {}
    for fingerprint, doc_id, part, text in rows:
        chain = chains.setdefault(fingerprint, [])
        held = next((x for x in chain if x[0] == text), None)
        if held is None:
            held = (text, failed(text, filters), {})
            chain.append(held)
        if doc_id is None:
            without_id[part, held[1]] = without_id.get((part, held[1]), 0) + 1
        else:
            held[2].setdefault(doc_id, {})
            held[2][doc_id][part] = held[2][doc_id].get(part, 0) + 1
    for (part, mask), n in without_id.items():
        yield 0, None, mask, None, {part: n}
    duplicate = 1 << len(filters)
    for fingerprint, chain in chains.items():
        for text, mask, ids in chain:
            if ids:
                least = min(ids)
                yield fingerprint, text, mask, least, ids.pop(least)
                for doc_id, parts in ids.items():
                    yield fingerprint, None, mask | duplicate, doc_id, parts


def settled(records: Iterator[tuple[int, Head]], duplicate: int, last: bool) -> Iterator[Head]:
    """The heads of equal texts merged: the least id is kept, the others are duplicates. At last the heads are settled too."""
    chains: dict[int, list[list]] = {}
    for _, (fingerprint, text, mask, doc_id, parts) in records:
        if text is None:
            yield fingerprint, None, mask, doc_id, parts
            continue
        chain = chains.setdefault(fingerprint, [])
        held = next((x for x in chain if x[0] == text), None)
        if held is None:
            chain.append([text, mask, doc_id, parts])
        elif doc_id == held[2]:
            held[3] = {p: held[3].get(p, 0) + parts.get(p, 0) for p in {*held[3], *parts}}
        else:
            if doc_id < held[2]:
                held[2:], doc_id, parts = [doc_id, parts], held[2], held[3]
            yield fingerprint, None, mask | duplicate, doc_id, parts
    for fingerprint, chain in chains.items():
        for text, mask, doc_id, parts in chain:
            yield fingerprint, None if last else text, mask, doc_id, parts


def masks(docs: DataFrame, text: str = "text", part: str = "source", doc_id: str = "doc_id", *, filters: dict[str, Callable] = FILTERS, partition_bytes: int = PARTITION_BYTES, salted_from: int = SALTED_FROM) -> DataFrame:
    """(id, part, mask, n): rows by the filters that they fail, the duplicates' bit being the last; n equal rows are one."""
    whole = F.coalesce(docs[text], F.lit(""))
    own = docs.select(F.xxhash64(whole), docs[doc_id], F.coalesce(docs[part].cast("string"), F.lit("")), whole)
    size = docs.agg(F.sum(F.octet_length(whole).cast("long"))).first()[0] or 0
    rows, duplicate = own.rdd, 1 << len(filters)
    n = max(rows.getNumPartitions(), size // partition_bytes + 1)

    def routed(records: RDD, key: Callable[[Head, int], int], last: bool) -> RDD:
        keyed = records.mapPartitionsWithIndex(lambda k, x: ((key(head, k), head) for head in x), preservesPartitioning=True)
        return keyed.partitionBy(n, lambda k: k).mapPartitions(lambda x: settled(x, duplicate, last))

    found = rows.mapPartitions(lambda x: heads(x, filters))
    if rows.getNumPartitions() >= salted_from:
        found = routed(found, lambda head, k: place(head[0], k % SALTS if head[1] is not None else head[3]), False)
    # settled rows go anywhere, so a text with very many copies burdens nobody
    found = routed(found, lambda head, _: head[0] if head[1] is not None else place(head[0], head[3]), True)
    flat = found.flatMap(lambda head: [(head[3], p, head[2], k) for p, k in head[4].items()])
    schema = T.StructType([T.StructField("id", docs.schema[doc_id].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())])
    return docs.sparkSession.createDataFrame(flat, schema, verifySchema=False)


def mask_counts(rows: DataFrame, labels: DataFrame, doc_id: str = "doc_id", *, bits: int = len(FILTERS) + 1) -> RDD:
    """(part, counts): for each mask the rows, those labelled good and those labelled toxic."""
    known = labels.groupBy(labels[doc_id].alias("__id")).agg(F.max(F.expr("quality = 1").cast("int")).alias("good"), F.max(F.expr("toxic = 1").cast("int")).alias("toxic"))
    found = rows.join(known, rows["id"] == known["__id"], "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))

    def added(counts: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        counts[mask] += (n, n * good, n * toxic)
        return counts

    keyed = found.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return keyed.combineByKey(lambda row: added(np.zeros((1 << bits, 3), np.int64), row), added, np.add, partitionFunc=xxhash.xxh64_intdigest)


def interactions(counts: np.ndarray, letters: str) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of all orders and steps of a part."""
    every = np.arange(len(counts))
    out, total = [], dict.fromkeys(letters, 0)
    for order in permutations(letters):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << letters.index(letter)
            fails, gone = (every & bit) > 0, (every & before) > 0
            lost = counts[fails & ~gone].sum(0).tolist()
            total[letter] += lost[0]
            before |= bit
            out.append(("".join(order), step, int(counts[(every & before) == 0, 0].sum()), lost[0], int(counts[fails & gone, 0].sum()), int(counts[bit, 0]), lost[1], lost[2]))
    return [(*x, total[x[0][x[1] - 1]]) for x in out]


MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", doc_id: str = "doc_id", *, filters: dict[str, Callable] = FILTERS, duplicate: str = DUPLICATE) -> DataFrame:
    """(part, filter_order, step, and MEASURES as long): a row for each part, order of the filters, and step.

    Null texts are empty, null parts the empty string. A row without an id has no smaller id and is
    nobody's: it is no duplicate, makes none and has no label. Rows that share id and text are all
    counted, and are no duplicates of each other; ids that are repeated with other texts compare
    each text by itself. Of an id's labels one that is 1 is enough. An empty table gives no rows.
    Other columns are not read. Texts of any length are read whole; the distinct texts of one input
    partition, and later about PARTITION_BYTES of distinct texts, are held by a task at a time.
    """
    letters = "".join(filters) + duplicate
    vectors = mask_counts(masks(docs, text, part, doc_id, filters=filters), labels, doc_id, bits=len(letters))
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(x, T.LongType()) for x in MEASURES]])
    rows = vectors.flatMap(lambda x: [(x[0], *y) for y in interactions(x[1], letters)])
    return docs.sparkSession.createDataFrame(rows, schema, verifySchema=False)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), least AS (
    SELECT text, min(doc_id) AS least FROM t GROUP BY text
), known AS (
    SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
), m AS (
    SELECT part, CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
               + 4 * CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS INTEGER)
               + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > least, FALSE) AS INTEGER) AS mask,
           coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
    FROM t JOIN least USING (text) LEFT JOIN known USING (doc_id)
), c AS (
    SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL
), l AS (
    SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)
), o AS (
    SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (
    SELECT filter_order, step, l.l AS letter, bit, sum(bit) OVER (PARTITION BY filter_order ORDER BY step) - bit AS earlier
    FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o) JOIN l ON l.l = substring(filter_order, step, 1)
), r AS (
    SELECT part, filter_order, step, letter,
           sum(CASE WHEN mask & (bit | CAST(earlier AS INTEGER)) = 0 THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INTEGER) > 0 THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN mask & bit > 0 AND mask & CAST(earlier AS INTEGER) = 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, s GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""
