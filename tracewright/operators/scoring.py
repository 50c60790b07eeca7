"""Risk and pattern scores as column expressions over already aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import skew_safe_lookup

D18 = "decimal(38,18)"


def level(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def lake_risk(events: Column, holder: Column, jaccard: Column) -> Column:
    """100 (0.6 min(events / 100, 1) + 0.4 holder) + 10 jaccard, at most 100."""
    return F.round(F.least(100 * (0.6 * F.least(events / 100, F.lit(1.0)) + 0.4 * holder) + 10 * jaccard, F.lit(100.0)), 4)


def screening(profile: DataFrame, concentration: DataFrame) -> DataFrame:
    """R2: frequency (45 or 25), concentration (35 or 20) and breadth (20); too little data is insufficient_data, not low."""
    j = profile.join(concentration.select("chain_id", "address", "top1_in_share", "top1_out_share"), ["chain_id", "address"], "left")
    top = F.greatest(F.coalesce("top1_in_share", F.lit(0.0)), F.coalesce("top1_out_share", F.lit(0.0)))
    s = F.when(F.col("events") >= 100, 45).when(F.col("events") >= 30, 25).otherwise(0) + F.when(top >= 0.8, 35).when(top >= 0.5, 20).otherwise(0) + F.when(F.col("txs") >= 50, 20).otherwise(0)
    return j.select("chain_id", "address", s.alias("score"), F.when(F.col("events") < 3, "insufficient_data").otherwise(level(s, 70, 35)).alias("level"))


def dormancy(act: DataFrame, as_of: Column) -> DataFrame:
    """Days since the last activity and the longest gap between active days."""
    days = act.filter(F.col("block_time").isNotNull()).select("chain_id", "address", F.to_date("block_time").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy("chain_id", "address").orderBy("day")))
    g = days.withColumn("gap", gap).groupBy("chain_id", "address").agg(F.datediff(F.to_date(as_of), F.max("day")).alias("silent_days"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.count(F.lit(1)).alias("active_days"))
    return g


def risk_scenario(act: DataFrame, k: int = 5) -> DataFrame:
    """Each address's ``k`` largest receipts and its first ``k`` payments by block, in one ranked list."""
    w = Window.partitionBy("chain_id", "address", "direction")
    tie = ["block_number", "tx_hash", "event_index", "activity_id"]
    ins = act.filter("direction = 'IN'").withColumn("rank", F.row_number().over(w.orderBy(F.desc_nulls_last("amount"), *[F.asc_nulls_last(c) for c in tie])))
    outs = act.filter("direction = 'OUT'").withColumn("rank", F.row_number().over(w.orderBy(*[F.asc_nulls_last(c) for c in tie])))
    return ins.unionByName(outs).filter(F.col("rank") <= k).select("chain_id", "address", "direction", "rank", "activity_id", "amount")


def risk_scenario_p90(act: DataFrame, k: int = 5) -> DataFrame:
    """Per address the receipts at or above its own value at index floor((n - 1) * 0.9) (kind inflow, with that value), its first ``k`` payments
    by block (outflow), and the ``k`` counterparties most often paid (spread, with how often)."""
    from tracewright.operators.relational import rank_pick, top_per_group

    by = ["chain_id", "address"]
    ins = act.filter("direction = 'IN' AND amount IS NOT NULL")
    p = rank_pick(ins, by, "amount", F.floor((F.col("n") - 1) * 0.9) + 1, "p90")
    none = lambda t: F.lit(None).cast(t)
    large = skew_safe_lookup(ins, p, by, ["p90"]).filter(F.col("amount") >= F.col("p90")).select(*by, F.lit("inflow").alias("kind"), none("int").alias("rank"), "activity_id", "counterparty_address", "amount", F.col("p90").alias("threshold"), none("bigint").alias("times"))
    outs = act.filter("direction = 'OUT'")
    tie = ["block_number", "tx_hash", "event_index", "activity_id"]
    first = top_per_group(outs.select(*by, *tie, "counterparty_address", "amount"), by, [F.asc_nulls_last(c) for c in tie], k).select(*by, F.lit("outflow").alias("kind"), "rank", "activity_id", "counterparty_address", "amount", none(D18).alias("threshold"), none("bigint").alias("times"))
    paid = outs.filter(F.col("counterparty_address") != "").groupBy(*by, "counterparty_address").agg(F.count(F.lit(1)).alias("times"))
    spread = top_per_group(paid, by, [F.desc("times"), "counterparty_address"], k).select(*by, F.lit("spread").alias("kind"), "rank", none("bigint").alias("activity_id"), "counterparty_address", none(D18).alias("amount"), none(D18).alias("threshold"), "times")
    return large.unionByName(first).unionByName(spread)


def label_precedence(labels: DataFrame) -> DataFrame:
    """One label per address: verified first, then the latest, then by text."""
    return labels.groupBy("chain_id", "address").agg(F.max_by("label", F.struct("verified", "updated_at", "label")).alias("label"))
