"""Data quality: scorecards, invariants and chunk validation, each one conditional aggregation over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import skew_safe_lookup

ADDRESS, HASH = "^0x[0-9a-f]{40}$", "^0x[0-9a-f]{64}$"


def share(hit: Column) -> Column:
    return F.round(F.try_divide(F.count_if(hit), F.count(F.lit(1))), 6)


def activity_scorecard(act: DataFrame) -> DataFrame:
    """Completeness per chain of the fields that analyses need."""
    return act.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("rows"), share(F.col("block_time").isNotNull()).alias("time_share"), share(F.coalesce(F.trim("token_symbol"), F.lit("")) != "").alias("symbol_share"),
        share(F.col("usd_value").isNotNull()).alias("usd_share"), share(F.col("counterparty_address") != "").alias("counterparty_share"), share(F.lower("address").rlike(ADDRESS)).alias("address_share"),
    )


def token_scorecard(registry: DataFrame) -> DataFrame:
    """Completeness of the token registry per chain and overall as the sum of parts over the sum of wholes."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return registry.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("rows"), share(has("name")).alias("name_share"), share(has("symbol")).alias("symbol_share"), share(has("decimals")).alias("decimals_share"), share(has("logo_uri")).alias("logo_share"), share(F.coalesce("is_verified", F.lit(False))).alias("verified_share"),
        F.round((F.count_if(has("name")) + F.count_if(has("symbol")) + F.count_if(has("decimals")) + F.count_if(has("logo_uri"))) / (4 * F.count(F.lit(1))), 6).alias("overall"),
    )


def contract_scorecard(registry: DataFrame, act: DataFrame) -> DataFrame:
    """Per chain the registered contracts, how many of them are verified, named, of a known standard, and met in the activity."""
    met = act.filter(F.col("token_address") != "").select("chain_id", F.lower(F.trim("token_address")).alias("contract")).distinct().withColumn("met", F.lit(True))
    last = registry.groupBy("chain_id", F.lower(F.trim("contract_address")).alias("contract")).agg(F.max(F.struct("updated_at", F.coalesce("is_verified", F.lit(False)).alias("verified"), "name", "token_standard")).alias("v"))
    j = skew_safe_lookup(last, met, ["chain_id", "contract"], ["met"])
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return j.groupBy("chain_id").agg(F.count(F.lit(1)).alias("contracts"), share(F.col("v.verified")).alias("verified_share"), share(has("v.name")).alias("named_share"), share(has("v.token_standard")).alias("standard_share"), share(F.coalesce("met", F.lit(False))).alias("met_share"))


def decoder_scorecard(act: DataFrame) -> DataFrame:
    """Per chain the rows with a method, with a name for it and with a kind better than a plain call, and the methods without a name."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    called = has("method_id")
    return act.groupBy("chain_id").agg(
        F.count_if(called).alias("called"), F.round(F.try_divide(F.count_if(called & has("method_name")), F.count_if(called)), 6).alias("named_share"), F.round(F.try_divide(F.count_if(called & (F.col("activity_type") != "CONTRACT_CALL")), F.count_if(called)), 6).alias("typed_share"),
        F.countDistinct(F.when(called & ~has("method_name"), F.lower("method_id"))).alias("unnamed_methods"),
    )


def price_scorecard(anchors: DataFrame) -> DataFrame:
    """Per chain the price minutes, those with a close, with consistent bounds, and those told by a source; overall as the sum of parts over the sum of wholes."""
    sound = F.coalesce((F.col("low") <= F.least("open", "close")) & (F.greatest("open", "close") <= F.col("high")), F.lit(False))
    told = F.coalesce(F.trim("source"), F.lit("")) != ""
    closed = F.col("close").isNotNull()
    return anchors.groupBy("chain_id").agg(F.count(F.lit(1)).alias("minutes"), share(closed).alias("close_share"), share(sound).alias("sound_share"), share(told).alias("source_share"), F.round((F.count_if(closed) + F.count_if(sound) + F.count_if(told)) / (3 * F.count(F.lit(1))), 6).alias("overall"))


def validate_chunk(rows: DataFrame) -> DataFrame:
    """Rows, distinct keys, block range and violations of a token transfer chunk (F-3 columns)."""
    key = F.struct("chain_id", "block_number", "transaction_hash", "log_index")
    bad = lambda c, pattern: F.count_if(~F.coalesce(F.col(c).rlike(pattern), F.lit(False)))
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("keys"), F.min("block_number").alias("first_block"), F.max("block_number").alias("last_block"),
        F.count_if(F.col("block_number").isNull()).alias("null_block"), F.count_if(~F.coalesce(F.col("block_timestamp") > 0, F.lit(False))).alias("bad_time"), bad("transaction_hash", HASH).alias("bad_hash"), bad("token_address", ADDRESS).alias("bad_token"),
        bad("from_address", ADDRESS).alias("bad_from"), bad("to_address", ADDRESS).alias("bad_to"), bad("value_raw", "^[0-9]+$").alias("bad_value"),
    )


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """what differs between two aggregated tables: (keys, left, right, difference)."""
    x, y = a.select(*keys, F.col(value).alias("__l")), b.select(*keys, F.col(value).alias("__r"))
    j = x.join(y, keys, "full")
    return j.filter(~F.col("__l").eqNullSafe(F.col("__r"))).select(*keys, F.col("__l").alias("left_value"), F.col("__r").alias("right_value"), (F.coalesce("__r", F.lit(0)) - F.coalesce("__l", F.lit(0))).alias("difference"))
