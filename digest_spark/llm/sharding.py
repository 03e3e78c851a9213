"""Sharding by a two-pass external shuffle.

Pass one measures the rows and scatters them by seeded hashes into buckets that fit a task's
memory. Pass two draws a Fisher-Yates permutation of each bucket. The buckets in turn are one
random order of all rows, and equal runs of it are the shards (law `rows`: their counts are at
most one apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digest_spark.llm.arrowtext import by_bytes
from digest_spark.llm.shared import small_batches, text_key

SHARDS = 8
SEED = 42
#: A bucket holds total / BUCKETS bytes, within these bounds.
BUCKETS, LEAST_BUCKET, LARGEST_BUCKET = 20_000, 16 << 20, 512 << 20
#: Above so many buckets, the few doc_ids with very many rows are joined without a broadcast.
BROADCAST_BUCKETS = 250_000
OUTPUT_BYTES = 4 << 20


def shuffled(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", *, seed: int = SEED) -> tuple[DataFrame, int]:
    """The rows with `position`, their place in one random order of all rows; and the number of rows.

    A doc_id (null is one too) with many rows is spread over the buckets by row number as well, so
    no bucket outgrows its share. Rows are scattered one by one: equal texts are not kept together.
    A lost task is redone alike: the bucket is sorted before its seeded permutation is drawn. The
    input should be a table, whose rows come in the same order whenever it is read.
    """
    total = docs.agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + 1).alias("bytes")).first()
    rows, size = total["n"], total["bytes"] or 0
    buckets = max(1, -(-size // min(LARGEST_BUCKET, max(LEAST_BUCKET, size // BUCKETS))))
    often = docs.groupBy(docs[doc_id].alias("__often")).count().where(F.col("count") > max(1, rows // (4 * buckets)))  # 4 * buckets rows at most
    often = often.select("__often", F.lit(True).alias("__many"))
    often = F.broadcast(often) if buckets <= BROADCAST_BUCKETS else often
    own = [c for c in docs.columns if c != "position"]
    marked = docs.select(*own).join(often, docs[doc_id].eqNullSafe(often["__often"]), "left").drop("__often")
    salt = F.when(F.col("__many"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    dealt = marked.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), salt), F.lit(buckets)).cast("int")).drop("__many")
    counts = np.zeros(buckets, np.int64)
    for row in dealt.groupBy("__bucket").count().toLocalIterator():
        counts[row["__bucket"]] = row["count"]
    starts = docs.sparkSession.sparkContext.broadcast(np.cumsum(counts) - counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bucket(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            number = table.column("__bucket")[0].as_py()
            held.clear()
            order = np.random.default_rng([seed, number]).permutation(table.num_rows)  # a Fisher-Yates shuffle
            for k in range(0, len(order), 4096):
                part = table.select(own).take(pa.array(order[k : k + 4096])).combine_chunks()
                start = int(starts.value[number]) + k
                part = part.append_column("position", pa.array(np.arange(start, start + part.num_rows)))
                yield from by_bytes(iter(part.to_batches()), text, OUTPUT_BYTES)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            numbers = batch.column("__bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[0].column("__bucket")[0].as_py() != numbers[a]:
                    yield from bucket(held)
                held.append(batch.slice(a, b - a))
        if held:
            yield from bucket(held)

    schema = T.StructType([*docs.select(*own).schema, T.StructField("position", T.LongType())])
    sort = dealt.repartitionById(buckets, F.col("__bucket")).withColumn("__key", text_key(text)).sortWithinPartitions("__bucket", doc_id, "__key").drop("__key")
    return small_batches(sort).mapInArrow(run, schema), rows


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id", *, seed: int = SEED) -> DataFrame:
    """The rows with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard), in random order.

    Null and empty texts are rows like any other. Repeated rows are spread like others. An empty
    table gives no rows. Columns of docs named shard, slot or position are replaced or left out.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    out, rows = shuffled(docs, text, doc_id, seed=seed)
    least, larger = divmod(rows, shards)
    edge = larger * (least + 1)
    at = F.col("position")
    in_larger = F.floor(at / (least + 1)).cast("int")
    number = F.when(at < edge, in_larger).otherwise((larger + F.floor((at - edge) / max(least, 1))).cast("int"))
    start = F.when(at < edge, F.col("shard") * (least + 1)).otherwise(edge + (F.col("shard") - larger) * least)
    return out.withColumn("shard", number).withColumn("slot", at - start.cast("long")).drop("position")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes the rows below path/shard=N; each bucket adds a file to the one or two shards that it meets."""
    sharded.write.partitionBy("shard").parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    return shard(docs).select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
