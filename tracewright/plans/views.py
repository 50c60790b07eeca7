"""The test tables in the shapes that the analytics operators read, and the same shapes as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.relational import final_view
from tracewright.sources.tables import table

ACTIVITY_KEY = ["chain_id", "address", "block_time", "tx_hash", "event_index"]


def activity(spark: SparkSession, d: str) -> DataFrame:
    """Address activity, latest version of each key."""
    return final_view(table(spark, d, "address_activity"), ACTIVITY_KEY, ["ingested_at", "activity_id"])


def transfers(spark: SparkSession, d: str) -> DataFrame:
    """Transfers between as many parties as there are suppliers (self-transfers included): src, dst, token, amount, t, block, tx, log_index.

    Customers and suppliers are folded by the number of suppliers, so the graph grows with the data and isn't bipartite.
    """
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    parties = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.concat(F.lit("A"), (F.col("o_custkey") % parties).cast("string")).alias("src"),
        F.concat(F.lit("A"), (F.col("l_suppkey") % parties).cast("string")).alias("dst"),
        F.concat(F.lit("T"), (F.col("l_partkey") % 7).cast("string")).alias("token"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        F.col("l_shipdate").alias("t"), F.date_diff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("bigint").alias("block"), F.col("l_orderkey").alias("tx"), F.col("l_linenumber").alias("log_index"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Known entities among the parties: node, entity_type, entity_id; every third supplier, by its nation."""
    kinds = F.element_at(F.array(*[F.lit(k) for k in ENTITY_KINDS]), (F.col("s_nationkey") % len(ENTITY_KINDS) + 1).cast("int"))
    s = table(spark, d, "supplier").filter("s_suppkey % 3 = 0")
    parties = table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()
    return s.select(F.concat(F.lit("A"), (F.col("s_suppkey") % parties).cast("string")).alias("node"), kinds.alias("entity_type"), F.concat(F.lit("E"), F.col("s_nationkey").cast("string")).alias("entity_id"))


ENTITY_KINDS = ("EXCHANGE", "BRIDGE", "DEX", "ROUTER", "CONTRACT", "UNKNOWN_SERVICE", "TREASURY")
ENT = f"""ent AS (SELECT 'A' || (s_suppkey % (SELECT count(*) FROM supplier)) AS node, [{', '.join(f"'{k}'" for k in ENTITY_KINDS)}][s_nationkey % {len(ENTITY_KINDS)} + 1] AS entity_type, 'E' || s_nationkey AS entity_id FROM supplier WHERE s_suppkey % 3 = 0)"""


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Price minutes, latest version of each."""
    return final_view(table(spark, d, "price_anchor_1m"), ["chain_id", "symbol", "quote_symbol", "minute"], ["ingested_at", "anchor_id"])


ACT = """act AS (SELECT * FROM address_activity QUALIFY row_number() OVER (PARTITION BY chain_id, address, block_time, tx_hash, event_index ORDER BY ingested_at DESC NULLS LAST, activity_id DESC NULLS LAST) = 1)"""
ANC = """anc AS (SELECT * FROM price_anchor_1m QUALIFY row_number() OVER (PARTITION BY chain_id, symbol, quote_symbol, minute ORDER BY ingested_at DESC NULLS LAST, anchor_id DESC NULLS LAST) = 1)"""
TRA = """tra AS (
  SELECT 'A' || (o_custkey % (SELECT count(*) FROM supplier)) AS src, 'A' || (l_suppkey % (SELECT count(*) FROM supplier)) AS dst, 'T' || (l_partkey % 7) AS token, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_shipdate AS t,
         CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS block, l_orderkey AS tx, l_linenumber AS log_index
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
