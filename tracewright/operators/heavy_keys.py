"""Per-key results when a few keys hold most rows (problem 2): exact offset chunking.

The rows are range-partitioned and sorted by (role, key, other side), rows are counted per partition, the counts are prefix-summed into
offsets, every row gets its number, and chunks of equal numbers of rows are reduced to one state per key. States of a key that spans
chunks are merged in chunk order. No task ever holds more of a key than its share of a range partition and of a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import materialize

ROLES = ("address", "counterparty")
CHUNK_ROWS = 1 << 18


def address_bytes(c: Column) -> Column:
    """The 20 bytes an address names, however spelt (case, 0x, outer spaces, left padding to 32 bytes).

    Null stays null and blank text is empty bytes. Text that names no 20 bytes becomes more than 20 bytes: it groups with itself only.
    """
    text = F.regexp_replace(c, r"^[\s　]+|[\s　]+$", "")
    digits = F.regexp_replace(F.lower(text), "^0x", "")
    digits = F.when(digits.rlike("^0{24}[0-9a-f]{40}$"), F.substring(digits, 25, 40)).otherwise(digits)
    return (
        F.when(c.isNull(), None)
        .when(text == "", F.lit("").cast("binary"))
        .when(digits.rlike("^[0-9a-f]{40}$"), F.unhex(digits))
        .otherwise(F.concat(F.lit("no address ......: "), text, F.lit("..")).cast("binary"))
    )


def is_key(c: Column) -> Column:
    return F.coalesce(F.octet_length(c) == 20, F.lit(False))


def current_pairs(stats: DataFrame) -> DataFrame:
    """The latest version of every (chain_id, address, counterparty, direction); ties of updated_at go to the greatest values.

    One shuffle with map-side combining: a hot address is spread over its counterparties, a hot pair shrinks before it moves.
    """
    keyed = stats.select("chain_id", address_bytes(F.col("address")).alias("a"), address_bytes(F.col("counterparty_address")).alias("c"), "direction", "updated_at", "tx_count")
    return keyed.groupBy("chain_id", "a", "c", "direction").agg(F.max(F.struct("updated_at", "tx_count")).alias("v")).select("chain_id", "a", "c", "direction", F.col("v.tx_count").alias("tx_count"))


def numbered_rows(current: DataFrame) -> DataFrame:
    """Both sides of every pair, sorted by key across partitions: part, its index in the part, and whether it is the key's first row of that other side."""
    both = F.array(F.struct(F.lit(0).alias("role"), F.col("a").alias("key"), F.col("c").alias("other")), F.struct(F.lit(1).alias("role"), F.col("c").alias("key"), F.col("a").alias("other")))
    sides = current.select(F.inline(both), "tx_count").filter((F.col("role") == 0) | is_key(F.col("key")))
    ranged = sides.repartitionByRange("role", "key", "other")
    # The range never splits equal (role, key, other), so this window needs no further shuffle.
    first = F.row_number().over(Window.partitionBy("role", "key", "other").orderBy("tx_count")) == 1
    at = F.monotonically_increasing_id()
    return materialize(
        ranged.withColumn("new_other", first & F.coalesce(F.col("other") != F.lit(b""), F.lit(False)))
        .sortWithinPartitions("role", "key", "other")
        .withColumn("at", at)
        .select("role", "key", "new_other", "tx_count", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("idx")),
        "keyrows",
    )


def key_totals(stats: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per role and key: current_rows, partners (distinct non-blank other sides), tx_count (nulls count as none), chunks, all_rows.

    ``stats`` needs chain_id, address, counterparty_address, direction, tx_count and updated_at; further columns are ignored. Null,
    blank and unreadable addresses are no keys, but their rows count in all_rows (the number of all current rows). An empty table gives no rows.
    """
    rows = numbered_rows(current_pairs(stats))
    # One row per range partition: the prefix sum runs over as many rows as there are partitions.
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") == 0).alias("n_address"))
    offsets = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    numbered = rows.join(F.broadcast(offsets), "part").withColumn("chunk", F.floor((F.col("offset") + F.col("idx")) / F.lit(chunk_rows)))
    states = (
        numbered.groupBy("role", "key", "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("new_other").alias("partners"), F.sum("tx_count").alias("tx"))
    )
    merged = states.groupBy("role", "key").agg(F.sum("n").alias("current_rows"), F.sum("partners").alias("partners"), F.coalesce(F.sum("tx"), F.lit(0)).alias("tx_count"), F.count(F.lit(1)).alias("chunks"))
    return merged.filter(is_key(F.col("key"))).select(
        F.when(F.col("role") == 0, ROLES[0]).otherwise(ROLES[1]).alias("role"),
        F.concat(F.lit("0x"), F.lower(F.hex("key"))).alias("key_address"),
        "current_rows", "partners", "tx_count", "chunks", parts.agg(F.sum("n_address")).scalar().alias("all_rows"),
    )


def heavy(totals: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys that hold at least ``share`` of all current rows."""
    return totals.filter(F.col("current_rows") >= F.col("all_rows") * F.lit(share)).select("role", "key_address")
