"""Session defaults, the shared working folder, bounded broadcasts and skew-safe lookups."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A dimension is broadcast only if it has at most this many rows and bytes; anything larger is shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20


def session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is written for (UTC, ANSI, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracewright")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.legacy.javaCharsets", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``. Only a local master may do without it; it gets a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that every executor can reach")
        named = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """(file system, path) of Hadoop's API for any scheme."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def table_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, removed when the JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """:func:`materialize`, and the path, so that a loop can :func:`discard` a round's table once the next one is written."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, and any executor may be lost afterwards."""
    return written(df, name)[0]


def discard(spark: SparkSession, *paths: str | None) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        if path:
            fs, at = file_system(spark, path)
            fs.delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, row_bytes: int = 160) -> bool:
    """Whether ``df`` is proven to have at most ``rows`` rows (counted, never guessed) of about ``row_bytes`` bytes.

    A plain count: one number from each partition. A limit before the count would send that many rows of every partition to one task.
    """
    return df.count() <= min(rows, BROADCAST_BYTES // row_bytes)


def same_keys(left: str, right: str, *keys: str) -> Column:
    """Join condition of two aliased sides: all ``keys`` are equal, nulls matching nulls."""
    return reduce(lambda acc, k: acc & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")), keys[1:], F.col(f"{left}.{keys[0]}").eqNullSafe(F.col(f"{right}.{keys[0]}")))


#: Keys that are looked for among this share of the rows, and the most that are resolved by broadcast.
SAMPLE_SHARE, HOT_KEYS, SALTS = 1 / 64, 200, 65536


def hot_keys(rows: DataFrame, keys: list[str], most: int = HOT_KEYS) -> DataFrame:
    """The at most ``most`` most frequent keys of a seeded sample of the rows. Which keys they are decides only how rows travel, never a result."""
    return rows.select(*keys).sample(SAMPLE_SHARE, seed=7).groupBy(*keys).count().filter("count > 1").orderBy(F.desc("count"), *keys).limit(most).drop("count")


def skew_safe_lookup(rows: DataFrame, dim: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of the at most one ``dim`` row that has the same ``keys`` (nulls match nulls).

    A ``dim`` that is counted to be small is broadcast. A larger one is shuffled, but the most frequent keys of ``rows`` (at most HOT_KEYS,
    see :func:`hot_keys`) are resolved by a broadcast of their ``dim`` rows; rows resolved that way travel through the shuffle under
    random keys, so that no task receives a hot key.
    """
    dim = dim.select(*keys, *values)
    if small(dim):
        return rows.alias("r").join(F.broadcast(dim.alias("d")), same_keys("r", "d", *keys), "left").select("r.*", *[F.col(f"d.{v}").alias(v) for v in values])
    hot = hot_keys(rows, keys).alias("k").join(dim.alias("d"), same_keys("k", "d", *keys), "left").select("k.*", *[F.col(f"d.{v}").alias(v) for v in values])
    marked = rows.alias("r").join(F.broadcast(hot.withColumn("hot", F.lit(True)).alias("h")), same_keys("r", "h", *keys), "left").select(
        "r.*", F.coalesce("h.hot", F.lit(False)).alias("__hot"), *[F.col(f"h.{v}").alias(f"__h_{v}") for v in values]
    )
    # A hot row gets a salt that no dim row has; a cold row the salt -1 that all have.
    marked = marked.withColumn("__salt", F.when(F.col("__hot"), F.monotonically_increasing_id() % SALTS).otherwise(F.lit(-1)))
    dims = dim.withColumn("__salt", F.lit(-1).cast("bigint"))
    return marked.alias("r").join(dims.alias("d"), same_keys("r", "d", "__salt", *keys), "left").select(
        *[F.col(f"r.{c}") for c in rows.columns], *[F.when(F.col("r.__hot"), F.col(f"r.__h_{v}")).otherwise(F.col(f"d.{v}")).alias(v) for v in values]
    )
