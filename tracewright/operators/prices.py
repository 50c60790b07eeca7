"""Price series: minute bars, candles, coverage, resolution and valuation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.relational import asof_left, rank_pick
from tracewright.runtime import skew_safe_lookup

D18 = "decimal(38,18)"
RANKS = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}


def minute_bars(swaps: DataFrame, max_deviation: float = 0.2) -> DataFrame:
    """Bars of (token, minute) from swaps (token, t, price double, usd double, pool, seq), without prices that lie more than
    ``max_deviation`` from the upper median: OHLC, USD-weighted price, volume, trades, pools and routes."""
    key = ["token", "minute"]
    s = swaps.withColumn("minute", F.date_trunc("minute", "t"))
    median = rank_pick(s, key, "price", F.floor(F.col("n") / 2) + 1, "median")
    s = skew_safe_lookup(s, median, key, ["median"])
    kept = s.filter(F.abs(F.col("price") - F.col("median")) <= F.col("median") * max_deviation)
    at = F.struct("t", "seq")
    return kept.groupBy(*key).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.round(F.sum(F.col("price") * F.col("usd")) / F.sum("usd"), 6).alias("vwap"), F.round(F.sum("usd"), 2).alias("usd_volume"), F.count(F.lit(1)).alias("trades"), F.countDistinct("pool").alias("pools"),
    )


def candles(anchors: DataFrame, minutes: int) -> DataFrame:
    """Minute anchors as candles of ``minutes``; open is the first minute's open and close the last one's close."""
    start = F.timestamp_seconds(F.floor(F.unix_seconds("minute") / (60 * minutes)) * 60 * minutes)
    return anchors.filter(F.col("close").isNotNull()).groupBy("chain_id", "symbol", "quote_symbol", start.alias("bucket")).agg(
        F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"), F.sum("volume_base").cast(D18).alias("volume"), F.sum("trade_count").alias("trades")
    )


def coverage(anchors: DataFrame) -> DataFrame:
    """First and last minute, minutes present, trades, and the share of the span that is covered."""
    span = (F.unix_seconds(F.max("minute")) - F.unix_seconds(F.min("minute"))) / 60 + 1
    return anchors.groupBy("chain_id", "symbol", "quote_symbol").agg(
        F.min("minute").alias("first_minute"), F.max("minute").alias("last_minute"), F.countDistinct("minute").alias("minutes"), F.coalesce(F.sum("trade_count"), F.lit(0)).alias("trades"), F.round(F.countDistinct("minute") / span, 6).alias("ratio")
    )


def last_price(anchors: DataFrame, as_of: Column) -> DataFrame:
    """The latest price at or before ``as_of``; ties of a minute by source."""
    seen = anchors.filter((F.col("minute") <= as_of) & F.col("close").isNotNull())
    return seen.groupBy("chain_id", "symbol", "quote_symbol").agg(F.max_by(F.struct("minute", "close", "source"), F.struct("minute", "ingested_at", "anchor_id")).alias("p")).select("chain_id", "symbol", "quote_symbol", "p.minute", "p.close", "p.source")


def valued(act: DataFrame, anchors: DataFrame, max_age_s: int = 86400, pegged: tuple[str, ...] = ("USDX",)) -> DataFrame:
    """The price of each activity row: stored, else 1 for a pegged token, else the close of the same minute, else the last close
    within ``max_age_s``, else null; with the kind of price and its age. The last close covers the minute's own, so one as-of join serves both."""
    sym = F.upper(F.trim("token_symbol"))
    usd = anchors.filter((F.col("quote_symbol") == "USDX") & F.col("close").isNotNull()).select("chain_id", F.col("symbol").alias("sym"), "minute", "close")
    f = act.select("activity_id", "chain_id", sym.alias("sym"), "block_time", "amount", "price_usd")
    m = asof_left(f, usd, ["chain_id", "sym"], "block_time", "minute", ["close"], max_age_s)
    peg = F.col("sym").isin(*pegged)
    kind = F.when(F.col("price_usd").isNotNull(), "stored").when(peg, "peg").when(F.col("matched_at") == F.date_trunc("minute", "block_time"), "minute").when(F.col("close").isNotNull(), "asof").otherwise("none")
    price = F.coalesce("price_usd", F.when(peg, F.lit(1)).cast(D18), "close")
    return m.select("activity_id", "chain_id", "sym", price.cast(D18).alias("price"), kind.alias("price_kind"), F.when(kind.isin("minute", "asof"), F.unix_seconds("block_time") - F.unix_seconds("matched_at")).alias("age_s"))


def resolve(requests: DataFrame, candidates: DataFrame, tolerance_s: int, priority: dict[str, int], pegged: tuple[str, ...] = ()) -> DataFrame:
    """for each request (id, symbol, t) the candidate (symbol, t, price, source, confidence) within the tolerance that comes first by
    source rank, distance, confidence and source name; a ``pegged`` symbol without one has price 1 and source peg. Requests meet candidates by symbol and time bucket, never all with all."""
    width = tolerance_s
    b = lambda c: F.floor(F.unix_seconds(c) / width)
    q = requests.withColumn("bucket", F.explode(F.array(b("t") - 1, b("t"), b("t") + 1)))
    c = candidates.select("symbol", F.col("t").alias("ct"), "price", "source", "confidence", b("t").alias("bucket"))
    rank = F.lit(99)
    for name, r in priority.items():
        rank = F.when(F.col("source") == name, r).otherwise(rank)
    conf = F.lit(0)
    for name, r in RANKS.items():
        conf = F.when(F.upper("confidence") == name, r).otherwise(conf)
    gap = F.abs(F.unix_micros("t") - F.unix_micros("ct"))
    near = q.join(c, ["symbol", "bucket"]).filter(gap <= tolerance_s * 1_000_000)
    best = near.groupBy("id").agg(F.min(F.struct(rank.alias("rank"), gap.alias("gap"), (-conf).alias("conf"), "source", "ct", "price")).alias("m"))
    peg = F.col("m").isNull() & F.col("symbol").isin(*pegged)
    return requests.join(best, "id", "left").select("id", F.when(peg, F.lit(1).cast(candidates.schema["price"].dataType)).otherwise(F.col("m.price")).alias("price"), F.when(peg, "peg").otherwise(F.col("m.source")).alias("source"), (F.col("m.gap") / 1_000_000).cast("bigint").alias("gap_s"))
