"""Two-pass external shuffle into shards (built-in functions only).

Pass one scatters whole records into memory-sized buckets by a seeded hash; pass two puts each bucket in a canonical order, runs a
seeded Fisher-Yates shuffle over it (the built-in `shuffle`) and writes it. Bucket sizes give each bucket's offset in the global permutation;
shard k holds its positions from floor(N k / n) on, so shard counts differ by one at most, slots are gapless, and a bucket is written to one
shard or to a few that follow each other, without a further shuffle.

Buckets and their partitions are fixed by number, whatever the session's settings, and sorted by bucket, so a lost task is repeated with the
same order and the same draws.

Defined results: a null text counts 8 bytes and no content; repeated rows are shuffled like others, spread by `salt` (a column or
expression that tells rows apart, such as the place in the file), without which rows that agree in id and text share a bucket; an empty table
gives no rows; columns named like the outputs are replaced. Columns must be orderable (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path

#: Buckets whose offsets are summed in one group; one more level sums the groups.
GROUP = 4096
#: Bucket counts up to this number have their offsets broadcast; beyond it the join shuffles.
MOST_SENT = 1 << 20


def _offsets(counts: DataFrame) -> DataFrame:
    """(_bucket, _offset) from (_bucket, _n), in two levels so that no task sees all buckets."""
    grouped = counts.withColumn("_group", F.floor(F.col("_bucket") / GROUP))
    tops = grouped.groupBy("_group").agg(F.sum("_n").alias("_n"))

    def earlier(window):
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    tops = tops.select("_group", earlier(Window.orderBy("_group")).alias("_base"))
    inner = earlier(Window.partitionBy("_group").orderBy("_bucket"))
    return grouped.withColumn("_inner", inner).join(tops, "_group").select("_bucket", (F.col("_base") + F.col("_inner")).alias("_offset"))


def two_pass_shuffle(docs: DataFrame, shards: int, seed: int = 20240607, text: str = "text", doc_id: str = "doc_id", bucket_bytes: int = 16 << 20, salt: Column | None = None) -> DataFrame:
    """All rows of docs with size, shard (0 to shards - 1) and slot (0, 1, ... in each shard)."""
    docs = docs.drop("size", "shard", "slot")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8
    total, n = docs.agg(F.coalesce(F.sum(size), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_bytes))
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text), F.lit(0) if salt is None else salt), F.lit(buckets))
    offsets = _offsets(docs.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n")))
    scattered = docs.select(bucket.alias("_bucket"), F.struct(F.xxhash64(F.lit(seed + 1), F.col(doc_id), F.col(text)).alias("h"), F.struct(*docs.columns).alias("row")).alias("_item"))
    gathered = scattered.repartition(buckets, "_bucket").groupBy("_bucket").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    shuffled = gathered.sortWithinPartitions("_bucket").select("_bucket", F.shuffle("_items", seed).alias("_items"))
    placed = shuffled.join(F.broadcast(offsets) if buckets <= MOST_SENT else offsets, "_bucket").select("_offset", F.posexplode("_items").alias("_pos", "_item"))
    at = F.col("_offset") + F.col("_pos")
    shard = F.floor(((at + 1) * shards - 1) / max(1, n))
    out = placed.select("_item.row.*", at.alias("_at"), shard.cast("int").alias("shard"))
    return out.select(*docs.columns, size.alias("size"), "shard", (F.col("_at") - F.floor(F.lit(n) * F.col("shard") / shards)).alias("slot"))


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """One folder a shard; the rows as they are read back."""
    placed.write.partitionBy("shard").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path).select(*placed.columns)


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.col("_metadata.row_index").alias("row_index"))
    placed = write_shards(two_pass_shuffle(docs, shards=24, salt=F.col("row_index")), fresh_path(spark, "shards"))
    return placed.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
