"""Chunk ingestion by Structured Streaming: validate, merge, apply once; and windowed statistics with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tracewright.operators.ledger import map_source
from tracewright.operators.quality import ADDRESS, HASH
from tracewright.runtime import file_system, materialize
from tracewright.sources.files import Layout, drop_heads

KEY = ["chain_id", "block_number", "transaction_hash", "log_index"]
CHUNK = "chunk_key string, chain_id bigint, block_number bigint, block_timestamp bigint, log_index bigint, transaction_hash string, token_address string, from_address string, to_address string, value_raw string"


def valid_row() -> Column:
    """Whether a row of a chunk keeps its contract (F-3); null where a field it needs is null."""
    ok = F.col("block_number").isNotNull() & (F.col("block_timestamp") > 0) & F.col("transaction_hash").rlike(HASH) & F.col("value_raw").rlike("^[0-9]+$")
    for c in ("token_address", "from_address", "to_address"):
        ok = ok & F.col(c).rlike(ADDRESS)
    return ok


def valid(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(valid_row(), F.lit(False)))


#: Blocks of a partition of the stored table: a batch reads back only the partitions it touches.
PART_BLOCKS = 1_000_000


def _read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    fs, at = file_system(spark, path)
    return spark.read.schema(schema).parquet(path) if fs.exists(at) else spark.createDataFrame([], schema)


def _merge(batch: DataFrame, target: str) -> None:
    """Append the rows whose key isn't stored. The table is partitioned by chain and block range, and only ranges of the batch are read."""
    part = F.floor(F.col("block_number") / PART_BLOCKS).cast("int")
    order = F.struct("chunk_key", *[c for c in batch.columns if c not in ("chunk_key", *KEY)])
    first = batch.groupBy(*KEY).agg(F.min(order).alias("v")).select(*[F.col(c) if c in KEY else F.col(f"v.{c}").alias(c) for c in batch.columns]).withColumn("block_part", part)
    touched = [r.block_part for r in first.select("block_part").distinct().collect()]  # one number for a million blocks
    stored = _read(batch.sparkSession, target, first.schema).filter(F.col("block_part").isin(touched or [-1])).select(*KEY)
    first.join(stored, KEY, "left_anti").write.mode("append").partitionBy("block_part").option("compression", "zstd").parquet(target)


def apply_batch(target: str) -> Callable[[DataFrame, int], None]:
    """ST2, G15: a foreachBatch function that appends valid rows whose key isn't stored. Applying a batch again changes nothing."""

    def apply(batch: DataFrame, epoch: int) -> None:
        _merge(valid(batch), target)

    return apply


REGISTRY = "chunk_key string, rows bigint, valid_rows bigint, first_block bigint, last_block bigint, status string"


def sync_batch(target: str, registry: str) -> Callable[[DataFrame, int], None]:
    """ST4: a foreachBatch function that verifies, merges, registers and publishes whole chunks.

    A chunk with any invalid row is quarantined: registered as such and not merged. A chunk that is registered already is left alone. The
    registry is written last, so a batch that breaks off before is done again, and merging again changes nothing.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.join(_read(spark, registry, StructType.fromDDL(REGISTRY)).select("chunk_key"), "chunk_key", "left_anti")
        good = F.coalesce(valid_row(), F.lit(False))
        counts = fresh.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("rows"), F.count_if(good).alias("valid_rows"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"))
        verdict = materialize(counts.withColumn("status", F.when(F.col("rows") == F.col("valid_rows"), "published").otherwise("quarantined")), "verdict")
        _merge(fresh.join(verdict.filter("status = 'published'").select("chunk_key"), "chunk_key", "left_semi"), target)
        verdict.write.mode("append").option("compression", "zstd").parquet(registry)

    return apply


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 100, registry: str | None = None) -> StreamingQuery:
    """All chunk files of a folder, those that come later included; ends when what is there has been applied. With ``registry`` by whole chunks."""
    stream = spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    apply = sync_batch(target, registry) if registry else apply_batch(target)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def statements(spark: SparkSession, source: str, layout: Layout, kind: str, data_source: str, target: str, checkpoint: str) -> StreamingQuery:
    """ST1: delimited statement files of one layout and table kind, as they come in, mapped to the canonical ledger row by row and appended.

    Each file's header is dropped by position; src_file says where a row is from. Deduplication needs all rows and is a batch over the result.
    """
    schema = StructType.fromDDL(", ".join(f"`{n}` string" for n in layout.names))
    raw = spark.readStream.schema(schema).option("sep", layout.sep).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8" if layout.encoding == "utf-8-sig" else layout.encoding).csv(source).select("*", F.col("_metadata.file_name").alias("src_file"))

    def apply(batch: DataFrame, epoch: int) -> None:
        map_source(drop_heads(batch, layout.skip), kind, data_source, keep=["src_file"]).write.mode("append").option("compression", "zstd").parquet(target)

    return raw.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def authoritative(entries: DataFrame) -> DataFrame:
    """ST7: of entries with the same chain, data set, block range and addresses the newest completed, then synced, then by chunk key; quarantined, cancelled and unversioned ones never count."""
    live = entries.filter(~F.lower("status").isin("quarantined", "cancelled") & F.col("schema_version").isNotNull() & F.coalesce("success_marker", F.lit(False)))
    who = F.array_join(F.array_sort(F.array_distinct("addresses")), ",")
    w = Window.partitionBy("chain_id", "dataset", "from_block", "to_block", who).orderBy(F.desc_nulls_last("completed_at"), F.desc_nulls_last("synced_at"), F.desc("chunk_key"))
    return live.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def windowed(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """ST6 (an extra): events and users per type and window; state older than the watermark is dropped in a stream, in a batch nothing is."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("users"), F.sum("value").alias("value"))


def edge_totals(transfers: DataFrame) -> DataFrame:
    """ST3: incremental edges as streaming state: a running sum per edge (update mode)."""
    return transfers.groupBy("src", "dst", "token").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("n"))
