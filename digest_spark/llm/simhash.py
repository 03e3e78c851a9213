"""SimHash near-duplicates, compared by bit planes with carry-save counters.

Fingerprints within the radius agree on at least two of radius + 2 bit blocks, so each pair of
blocks is a table of buckets, and only fingerprints of one bucket are compared. In a bucket the
fingerprints are stored vertically: word b holds bit b of 64 fingerprints. One exclusive-or with
a query's bit gives 64 differences, and carry-save counters add them to 64 distances at once. A
word whose 64 distances all exceed the radius is abandoned.

Near copies in general are further apart than a few bits of 64: of shingles that are shared to 0.8,
SimHash bits differ by 15 %. near_copies takes WIDE_LANES times 64 bits of five-word shingles, a radius
to match, and buckets by pairs of MinHash values, and compares them by the same bit planes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import by_bytes
from digest_spark.llm.components import connected_components
from digest_spark.llm.shared import dropped, small_batches, text_key, written
from digest_spark.llm.words import mixed

SHINGLE_WORDS = 3
RADIUS = 3
SEED = 42
#: near_copies: words of a shingle, longs of a fingerprint, bits by which near copies differ at most, and
#: bucket tables. At a similarity of 0.8 about 39 bits of 256 differ, 0.64 of the tables' keys agree.
WIDE_WORDS, WIDE_LANES, WIDE_RADIUS, WIDE_TABLES = 5, 4, 44, 6
BATCH_BYTES = 4 << 20
#: Buckets with more fingerprints are compared in tiles of about so many a side.
TILE = 512
#: Rows that a task gathers before it compares them, and (query, word) pairs that it compares at a time.
GATHER = 1 << 16
SLAB = 1 << 16
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: bytes, k: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the text's k-word shingles, in blocks; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    digest = xxhash.xxh64_intdigest
    if len(words) < k:
        yield np.array([digest(joined, seed)], np.uint64)
        return
    starts = [0, *(e + 1 for e in ends[:-1])]
    for at in range(0, len(words) - k + 1, SLAB):
        stop = min(at + SLAB, len(words) - k + 1)
        yield np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:stop], ends[at + k - 1 : stop + k - 1], strict=True)), np.uint64, stop - at)


def sketches(texts: list[bytes], k: int, seed: int, lanes: int = 1, minima: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of `lanes` longs each (a bit is set if it is set in over half of the hashes), and so many MinHash values."""
    ones = np.zeros((len(texts), 64 * lanes), np.int64)
    least = np.full((len(texts), minima), ALL, np.uint64)
    n = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    blocks: list[np.ndarray] = []

    def add() -> None:
        if blocks:
            hashes, starts = np.concatenate(blocks), np.concatenate([[0], np.cumsum([len(x) for x in blocks])[:-1]])
            for lane in range(lanes):
                bits = np.unpackbits((mixed(hashes, lane) if lane else hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                np.add.at(ones[:, 64 * lane : 64 * lane + 64], rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            for j in range(minima):
                np.minimum.at(least[:, j], rows, np.minimum.reduceat(mixed(hashes, 100 + j), starts))
            np.add.at(n, rows, [len(x) for x in blocks])
            rows.clear()
            blocks.clear()

    held = 0
    for row, text in enumerate(texts):
        for block in shingle_hashes(text, k, seed):
            rows.append(row)
            blocks.append(block)
            held += len(block)
            if held >= SLAB:
                add()
                held = 0
    add()
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").astype(np.uint64), least


def fingerprint_all(texts: list[bytes], k: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """64-bit fingerprints."""
    return sketches(texts, k, seed)[0].ravel()


def with_fingerprint(docs: DataFrame, text: str = "text", *, keep: tuple[str, ...] = (), shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Each row's columns `keep`, its text_key and its fingerprint fp (a signed long). No word: 0."""
    own = docs.select(*[docs[c] for c in keep], text_key(docs[text]).alias("text_key"), docs[text].alias("__text"))
    schema = T.StructType([*[own.schema[c] for c in keep], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            fp = fingerprint_all([(x or "").encode() for x in batch.column("__text").to_pylist()], shingle_words)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("text_key"), pa.array(fp.view(np.int64))], names=[*keep, "text_key", "fp"])

    return small_batches(own).mapInArrow(run, schema)


def links_within(query: np.ndarray, first_word: np.ndarray, words: np.ndarray, planes: np.ndarray, valid: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query number, lane number) of all pairs at most `radius` bits apart; lane 64 w + j is bit j of word w.

    Query i, a row of longs, is compared with words first_word[i] to first_word[i] + words[i] - 1.
    """
    size = max(1, radius.bit_length())
    start = (1 << size) - 1 - radius  # so that the counters overflow at radius + 1
    ends = np.cumsum(words)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, SLAB):
        pair = np.arange(at, min(at + SLAB, total))
        q = np.searchsorted(ends, pair, "right")
        w = first_word[q] + pair - (ends[q] - words[q])
        bits = query[q]
        counters = [np.full(len(q), ALL if start >> k & 1 else 0, np.uint64) for k in range(size)]
        over = ~valid[w]
        for b in range(len(planes)):
            carry = planes[b][w] ^ (np.uint64(0) - ((bits[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
            for k in range(size):
                carry, counters[k] = counters[k] & carry, counters[k] ^ carry
            over |= carry
            if b % 8 == 7:
                live = over != ALL
                if not live.all():
                    q, w, bits, over = q[live], w[live], bits[live], over[live]
                    counters = [c[live] for c in counters]
                if not len(q):
                    break
        if len(q):
            hit, lane = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield q[hit], 64 * w[hit] + lane


def tile_links(tile: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that join the fingerprints of each tile as all their links do: each to one of its group.

    Rows of a tile stand together; fp has one or more longs a row. side 0: query and lane; 1: query only; 2: lane only.
    """
    none = np.zeros(0, np.int64)
    is_lane, is_query = side != 1, side != 2
    lanes, queries = np.flatnonzero(is_lane), np.flatnonzero(is_query)
    if not len(lanes) or not len(queries):
        return none, none
    lane_tile = tile[lanes]
    new = np.concatenate([[True], lane_tile[1:] != lane_tile[:-1]])
    begin = np.flatnonzero(new)
    place = np.arange(len(lanes)) - begin[np.cumsum(new) - 1]
    fresh = place % 64 == 0
    word = np.cumsum(fresh) - 1
    cuts, bit = np.flatnonzero(fresh), (place % 64).astype(np.uint64)
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat(((fp[lanes, b // 64] >> np.uint64(b % 64)) & one) << bit, cuts) for b in range(64 * fp.shape[1])])
    valid = np.bitwise_or.reduceat(one << bit, cuts)
    row_of = np.full(64 * len(cuts), -1)
    row_of[64 * word + place % 64] = lanes
    first, count = np.zeros(int(tile[-1]) + 1, np.int64), np.zeros(int(tile[-1]) + 1, np.int64)
    np.add.at(count, lane_tile, fresh)
    first[lane_tile[begin]] = word[begin]
    queries = queries[count[tile[queries]] > 0]
    root = np.arange(len(fp))
    for q, lane in links_within(fp[queries], first[tile[queries]], count[tile[queries]], planes, valid, radius):
        x, y = queries[q], row_of[lane]
        x, y = x[x != y], y[x != y]
        while True:
            low = np.minimum(root[x], root[y])
            if (root[x] == low).all() and (root[y] == low).all():
                break
            np.minimum.at(root, root[x], low)
            np.minimum.at(root, root[y], low)
            np.minimum.at(root, x, low)
            np.minimum.at(root, y, low)
            while not (root == root[root]).all():
                root = root[root]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return moved, root[moved]


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links under which the distinct fingerprints fp have the components of all pairs within `radius` bits.

    Large buckets are split into tiles, pairs of chunks of about `tile` fingerprints; a tile holds
    two chunks at most, so no task holds a large bucket.
    """
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    masks = [sum(((1 << edges[k + 1]) - (1 << edges[k])) for k in kept) for kept in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fingerprints.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for t, m in enumerate(signed)])).alias("x")).select("fp", "x.t", "x.k")
    large = keyed.groupBy("t", "k").count().where(F.col("count") > tile).withColumn("chunks", F.ceil(F.col("count") / tile).cast("int")).drop("count")
    tiled = (
        keyed.join(large, ["t", "k"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("t", "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), F.when(F.col("c") == F.col("o"), 0).when(F.col("c") < F.col("o"), 1).otherwise(2).alias("side"), "fp")
    )
    return compared(tiled, ["t", "k", "i", "j"], ["fp"], "fp", radius)


def compared(tiled: DataFrame, key: list[str], prints: list[str], node: str, radius: int) -> DataFrame:
    """(a, b): the links of the rows (key, side, prints, node) of each key, by their nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table, last: bool) -> tuple[pa.Table, list[pa.RecordBatch]]:
            keys = [table.column(c).to_numpy() for c in key]
            new = np.concatenate([[True], np.logical_or.reduce([x[1:] != x[:-1] for x in keys])])
            done = table.num_rows if last else int(np.flatnonzero(new)[-1])
            out = []
            if done:
                numbers = np.cumsum(new[:done]) - 1
                # the buckets with one row have no links
                busy = np.bincount(numbers)[numbers] > 1
                if busy.any():
                    _, numbers = np.unique(numbers[busy], return_inverse=True)
                    fp = np.stack([table.column(c).to_numpy()[:done][busy] for c in prints], axis=1).view(np.uint64)
                    a, b = tile_links(numbers, table.column("side").to_numpy()[:done][busy], fp, radius)
                    nodes = table.column(node).to_numpy()[:done][busy]
                    out = pa.table({"a": nodes[a], "b": nodes[b]}).to_batches()
            return table.slice(done), out

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= GATHER:
                rest, out = links(pa.Table.from_batches(held).combine_chunks(), False)
                yield from out
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from links(pa.Table.from_batches(held).combine_chunks(), True)[1]

    return tiled.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def rooted(docs: DataFrame, text: str, doc_id: str, radius: int) -> DataFrame:
    """near_duplicates, and the root of each row's group: one of its fingerprints."""
    own = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    prints = written(with_fingerprint(own, keep=("doc_id",)))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(fingerprint_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    labels = nodes.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(labels.join(least, "root").select("fp", "component_id", "root"), "fp").select("doc_id", "text_key", "fp", "component_id", "root")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, text_key, fp, component_id (the smallest doc_id reachable by links).

    Texts that are null, empty or white space have fingerprint 0 and are linked like any other.
    Exact copies share a fingerprint, so each is compared once. Rows whose doc_id is null reach
    the others of their group, or null if all are null; rows that repeat a doc_id are rows of
    their own. Other columns are not read. An empty table gives no rows.
    """
    return rooted(docs, text, doc_id, radius).drop("root")


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, shingle_words: int = WIDE_WORDS, lanes: int = WIDE_LANES, radius: int = WIDE_RADIUS, tables: int = WIDE_TABLES, tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, text_key and root, equal for documents that links within the radius connect.

    Two documents meet in a bucket if one of `tables` pairs of MinHash values of their shingles is
    equal. At first each is compared with the least of its buckets. Where a bucket then holds
    several groups, the documents outside its largest group are compared with all of it, in tiles.
    So what the first step linked is not compared with itself again; a large bucket that it leaves in
    many groups costs time by the square of its size, but no task holds it. Nulls, repeats and other
    columns are as in near_duplicates.
    """
    own = docs.select(docs[doc_id].alias("doc_id"), text_key(docs[text]).alias("text_key"), docs[text].alias("__text"))
    f = [f"f{i}" for i in range(lanes)]
    schema = T.StructType([own.schema["doc_id"], T.StructField("text_key", T.LongType()), *[T.StructField(c, T.LongType()) for c in f], T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "__text", BATCH_BYTES):
            fp, least = sketches([(x or "").encode() for x in batch.column("__text").to_pylist()], shingle_words, SEED, lanes, 2 * tables)
            keys = np.stack([mixed(least[:, 2 * t] ^ mixed(least[:, 2 * t + 1], 1), 200 + t) for t in range(tables)], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *[pa.array(np.ascontiguousarray(fp[:, i]).view(np.int64)) for i in range(lanes)], lists], names=schema.names)

    # the node of equal fingerprints with equal buckets
    prints = written(small_batches(own).mapInArrow(run, schema).withColumn("node", F.xxhash64(*f, "keys")))
    nodes = prints.groupBy("node").agg(*[F.first(c).alias(c) for c in (*f, "keys")])
    keyed = nodes.select(F.explode("keys").alias("k"), "node", *f)
    least = keyed.groupBy("k").agg(F.min(F.struct("node", *f)).alias("lo"), F.count("*").alias("n")).where("n > 1").select(F.col("k").alias("at"), "lo")
    busy = written(keyed.join(least, F.col("k") == F.col("at")).select("k", "node", *f, "lo"))
    bits = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"lo.{c}"))) for c in f), F.lit(0))
    stars = written(busy.where(bits <= radius).select(F.col("node").alias("a"), F.col("lo.node").alias("b")).distinct())
    groups = written(connected_components(stars).toDF("at", "root"))
    labelled = written(busy.drop("lo").join(groups, F.col("node") == F.col("at"), "left").select("k", "node", *f, F.coalesce("root", "node").alias("root")))
    dropped(busy)
    sizes = labelled.groupBy("k", "root").count().groupBy("k").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.max("count").alias("most"), F.sum("count").alias("rows"))
    chunks = lambda n: F.ceil(n / tile).cast("int")
    mixed_sizes = sizes.where("most < rows").select(F.col("k").alias("at"), "main", chunks(F.col("rows")).alias("there"), chunks(F.col("rows") - F.col("most")).alias("asking"))
    open_rows = labelled.join(mixed_sizes, F.col("k") == F.col("at"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    lane = open_rows.select("k", chunk("there").alias("i"), every("asking").alias("j"), F.lit(2).alias("side"), "node", *f)
    query = open_rows.where("root != main").select("k", every("there").alias("i"), chunk("asking").alias("j"), F.lit(1).alias("side"), "node", *f)
    links = compared(lane.union(query), ["k", "i", "j"], f, "node", radius).union(stars)
    final = written(connected_components(links).toDF("at", "root"))
    dropped(labelled)
    return prints.join(final, F.col("node") == F.col("at"), "left").select("doc_id", "text_key", F.coalesce("root", "node").alias("root"))


def keep_one_per_group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with one row left of each group of near copies: that with the smallest (doc_id, text_key)."""
    groups = near_copies(docs, text, doc_id)
    stay = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("x"))
    stay = stay.select(F.col("x.doc_id").alias("__id"), F.col("x.text_key").alias("__key"))
    keyed = docs.withColumn("__key2", text_key(docs[text]))
    found = keyed.join(stay, keyed[doc_id].eqNullSafe(stay["__id"]) & (keyed["__key2"] == stay["__key"]), "left_semi")
    return found.dropDuplicates([doc_id, "__key2"]).select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def pipeline_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)
