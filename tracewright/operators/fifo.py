"""First-in-first-out lots without a row loop.

Along a key's events let I and O be the amounts in and out so far and U the part of O that had no lot: the greatest excess of O over I up to
now, at least 0. Each lot is the interval (I before, I] and each outflow consumes (O - U before, O - U]; what a lot gives an outflow is the overlap
of the two. I, O and U are running windows, matching is a join of intervals. Intervals are cut at bucket edges, so that a hot key is many small joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.operators.relational import running
from tracewright.runtime import materialize, same_keys, skew_safe_lookup

D18 = "decimal(38,18)"


def lots(events: DataFrame, key: Sequence[str], order: Sequence[str], amount: str, is_in: Column, is_out: Column) -> DataFrame:
    """``events`` with lot_from, lot_to (inflows), use_from, use_to, unmatched (outflows) and all_in, the key's whole inflow; written once.

    The running values come from prefix sums over range partitions, so one key may hold most events. ``order`` must be unique in a key.
    """
    zero = F.lit(0).cast(D18)
    a = F.col(amount).cast(D18)
    e = events.withColumn("__in", F.when(is_in, a).otherwise(zero)).withColumn("__out", F.when(is_out, a).otherwise(zero))
    e = running(e, key, order, {"__cum_in": F.col("__in"), "__cum_out": F.col("__out")}, highs={"__short": ("__cum_out", "__cum_in")}, earlier_highs={"__short_before": "__short"})
    short_before = F.col("__short_before")
    totals = events.groupBy(*key).agg(F.coalesce(F.sum(F.when(is_in, a)), zero).cast(D18).alias("all_in"))
    totals = materialize(totals, "totals")
    run = e.select(
        *events.columns,
        F.when(is_in, (F.col("__cum_in") - F.col("__in")).cast(D18)).alias("lot_from"), F.when(is_in, F.col("__cum_in")).alias("lot_to"),
        F.when(is_out, (F.col("__cum_out") - F.col("__out") - short_before).cast(D18)).alias("use_from"), F.when(is_out, (F.col("__cum_out") - F.col("__short")).cast(D18)).alias("use_to"),
        F.when(is_out, (F.col("__short") - short_before).cast(D18)).alias("unmatched"),
    )
    return materialize(skew_safe_lookup(run, totals, list(key), ["all_in"]), "lots")


def matches(run: DataFrame, key: Sequence[str], lot_cols: Sequence[str], use_cols: Sequence[str], buckets: int = 64) -> DataFrame:
    """(key, lot columns, use columns, quantity): what each lot gave each outflow.

    Each key's quantity axis is cut into ``buckets`` equal parts; a lot or use is copied to the parts it touches and an overlap is counted
    in the part where it begins, so even one key spreads over many tasks.
    """
    part = lambda x: F.least(F.lit(buckets - 1), F.floor(F.try_divide(F.col(x).cast("double"), F.col("all_in").cast("double")) * buckets).cast("int"))
    cut = lambda lo, hi: F.explode(F.sequence(part(lo), F.greatest(part(lo), part(hi))))
    live = run.filter("all_in > 0")
    lots = live.filter("lot_to > lot_from").select(*key, *[F.col(c).alias(f"lot_{c}") for c in lot_cols], "lot_from", "lot_to", part("lot_from").alias("__lot_part"), cut("lot_from", "lot_to").alias("__part"))
    uses = live.filter("use_to > use_from").select(*key, *[F.col(c).alias(f"use_{c}") for c in use_cols], "use_from", "use_to", part("use_from").alias("__use_part"), cut("use_from", "use_to").alias("__part"))
    lo, hi = F.greatest("lot_from", "use_from"), F.least("lot_to", "use_to")
    j = lots.alias("l").join(uses.alias("u"), same_keys("l", "u", *key, "__part")).filter((lo < hi) & (F.col("l.__part") == F.greatest("__lot_part", "__use_part")))
    return j.select(*[F.col(f"l.{k}").alias(k) for k in key], *[f"lot_{c}" for c in lot_cols], *[f"use_{c}" for c in use_cols], (hi - lo).cast(D18).alias("quantity"))


def flow_windows(act: DataFrame, as_of: Column, retention_h: Sequence[int] = (1, 6, 24, 168, 720), pass_m: Sequence[int] = (5, 15, 60, 360, 1440)) -> DataFrame:
    """per address and token: received, matched, unmatched outflow (opening balance), and for mature lots (in time + window <= as_of)
    what was retained and what passed through within each window."""
    key = ["chain_id", "address", "token_address"]
    e = act.filter(F.col("direction").isin("IN", "OUT") & (F.col("amount") > 0) & (F.col("block_time") <= as_of)).select(*key, "block_time", "block_number", "tx_hash", "event_index", "activity_id", "direction", "amount")
    order = ["block_time", "block_number", "tx_hash", "event_index", "activity_id"]
    run = lots(e, key, order, "amount", F.col("direction") == "IN", F.col("direction") == "OUT")
    m = matches(run, key, ["block_time", "activity_id"], ["block_time", "activity_id"])
    age = F.unix_micros("use_block_time") - F.unix_micros("lot_block_time")
    ripe = lambda c, s: F.unix_micros(c) + s * 1_000_000 <= F.unix_micros(as_of)
    z = lambda c: F.coalesce(c, F.lit(0)).cast(D18)
    gone = m.groupBy(*key).agg(
        z(F.sum("quantity")).alias("matched"),
        *[z(F.sum(F.when((age <= h * 3_600_000_000) & ripe("lot_block_time", h * 3600), F.col("quantity")))).alias(f"gone_{h}h") for h in retention_h],
        *[z(F.sum(F.when((age <= x * 60_000_000) & ripe("lot_block_time", x * 60), F.col("quantity")))).alias(f"passed_{x}m") for x in pass_m],
    )
    base = run.groupBy(*key).agg(
        z(F.sum(F.when(F.col("direction") == "IN", F.col("amount")))).alias("received"), z(F.sum("unmatched")).alias("opening"),
        *[z(F.sum(F.when((F.col("direction") == "IN") & ripe("block_time", h * 3600), F.col("amount")))).alias(f"ripe_{h}h") for h in retention_h],
    )
    j = base.join(gone, key, "left")
    return j.select(
        *key, "received", z(F.col("matched")).alias("matched"), "opening",
        *[(F.col(f"ripe_{h}h") - z(F.col(f"gone_{h}h"))).cast(D18).alias(f"retained_{h}h") for h in retention_h], *[z(F.col(f"passed_{x}m")).alias(f"passed_{x}m") for x in pass_m],
    )


BUYS, UNKNOWN_INS = ("KNOWN_BUY", "DEX_BUY"), ("TRANSFER_IN", "AIRDROP", "MINT", "BRIDGE_IN", "UNKNOWN_IN")
SELLS, MOVES_OUT = ("KNOWN_SELL", "DEX_SELL"), ("TRANSFER_OUT", "BURN", "BRIDGE_OUT")


def pnl(events: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """realised profit of (type, amount, usd_value, gas_usd) events by key.

    Only sold quantity whose lot has a known cost is realised, with its part of proceeds and gas; transfers move the position only.
    cost of a buy includes its gas. Columns: sold, known_sold, known_ratio, proceeds, gas, cost, pnl, position, known_position, remaining_cost.
    """
    is_in, is_out = F.col("type").isin(*BUYS, *UNKNOWN_INS), F.col("type").isin(*SELLS, *MOVES_OUT)
    e = events.filter((is_in | is_out) & (F.col("amount") > 0))
    cost = F.when(F.col("type").isin(*BUYS) & F.col("usd_value").isNotNull(), F.col("usd_value").cast("double") + F.coalesce(F.col("gas_usd"), F.lit(0)).cast("double"))
    e = e.withColumn("__unit", cost / F.col("amount").cast("double"))
    run = lots(e, key, order, "amount", is_in, is_out)
    m = matches(run, key, ["__unit"], ["type", "amount", "usd_value", "gas_usd"])
    q, sale = F.col("quantity").cast("double"), F.col("use_type").isin(*SELLS)
    known = F.col("lot___unit").isNotNull()
    part = q / F.col("use_amount").cast("double")
    z = lambda c: F.coalesce(c, F.lit(0.0))
    got = m.groupBy(*key).agg(
        z(F.sum(F.when(sale & known, q))).alias("known_sold"), z(F.sum(F.when(sale & known, part * F.col("use_usd_value").cast("double")))).alias("proceeds"),
        z(F.sum(F.when(sale & known, part * z(F.col("use_gas_usd").cast("double"))))).alias("gas"), z(F.sum(F.when(sale & known, q * F.col("lot___unit")))).alias("cost"),
        z(F.sum(q)).alias("used"), z(F.sum(F.when(known, q))).alias("known_used"), z(F.sum(F.when(known, q * F.col("lot___unit")))).alias("cost_used"),
    )
    amount = F.col("amount").cast("double")
    base = run.groupBy(*key).agg(
        z(F.sum(F.when(F.col("type").isin(*SELLS), amount))).alias("sold"), z(F.sum(F.when(is_in, amount))).alias("came"), z(F.sum(F.when(is_in & F.col("__unit").isNotNull(), amount))).alias("known_came"),
        z(F.sum(F.when(is_in, amount * F.col("__unit")))).alias("cost_came"),
    )
    j = base.join(got, list(key), "left")
    c = lambda x: z(F.col(x))
    r = lambda x: F.round(x, 4)
    return j.select(
        *key, r(c("sold")).alias("sold"), r(c("known_sold")).alias("known_sold"), r(z(F.try_divide(c("known_sold"), F.nullif(c("sold"), F.lit(0.0))))).alias("known_ratio"), r(c("proceeds")).alias("proceeds"), r(c("gas")).alias("gas"),
        r(c("cost")).alias("cost"), r(c("proceeds") - c("cost") - c("gas")).alias("pnl"), r(c("came") - c("used")).alias("position"), r(c("known_came") - c("known_used")).alias("known_position"), r(c("cost_came") - c("cost_used")).alias("remaining_cost"),
    )


def swap_events(swaps: DataFrame) -> DataFrame:
    """a swap as its sell leg (index * 2, with the gas) and its buy leg (index * 2 + 1); only HIGH and VERIFIED confidence."""
    ok = swaps.filter(F.col("confidence").isin("HIGH", "VERIFIED"))
    leg = lambda token, amount, kind, k, gas: F.struct(F.col(token).alias("token"), F.col(amount).alias("amount"), F.lit(kind).alias("type"), (F.col("event_index") * 2 + k).alias("position_index"), gas.alias("gas_usd"))
    return ok.select("address", "t", "tx_hash", "usd_value", F.inline(F.array(leg("token_in", "amount_in", "DEX_SELL", 0, F.col("gas_usd")), leg("token_out", "amount_out", "DEX_BUY", 1, F.lit(0.0)))))
