"""Aggregations over address activity: profiles, counterparties, concentration, retention, pass-through, financial summaries.

Input: chain_id, address, counterparty_address, direction, tx_hash, token_address, token_symbol, amount, usd_value, block_time and so on,
already reduced to the latest version of each row. Distinct counts work on pre-aggregated grains, so no row is expanded per distinct column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import materialize, skew_safe_lookup

D18 = "decimal(38,18)"
STABLE = ("USDX", "EURX", "ZNB")


def zero_sum(c: Column, when: Column | None = None) -> Column:
    """A sum that is 0 over no rows."""
    return F.coalesce(F.sum(c if when is None else F.when(when, c)), F.lit(0)).cast(D18)


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def is_in() -> Column:
    return F.col("direction") == "IN"


def is_out() -> Column:
    return F.col("direction") == "OUT"


def profiles(act: DataFrame) -> DataFrame:
    """One row per chain and address; two aggregations (transaction grain first) instead of one with many distinct columns."""
    grain = act.groupBy("chain_id", "address", "tx_hash").agg(
        F.count(F.lit(1)).alias("events"), F.min("block_time").alias("first_t"), F.max("block_time").alias("last_t"),
        F.max(is_in()).alias("has_in"), F.max(is_out()).alias("has_out"), zero_sum(F.col("amount"), is_in()).alias("in_amount"), zero_sum(F.col("amount"), is_out()).alias("out_amount"),
    )
    return grain.groupBy("chain_id", "address").agg(
        F.sum("events").alias("events"), F.count(F.lit(1)).alias("txs"), F.count_if("has_in").alias("in_txs"), F.count_if("has_out").alias("out_txs"),
        F.min("first_t").alias("first_seen"), F.max("last_t").alias("last_seen"), F.sum("in_amount").cast(D18).alias("in_amount"), F.sum("out_amount").cast(D18).alias("out_amount"),
    )


def address_relation(spark: SparkSession, addresses: Sequence[str], limit: int = 500) -> DataFrame:
    """SC10: an inline list of addresses as a table: trimmed, lower case, once each. ValueError for more than ``limit`` or one of over 64 characters."""
    clean = sorted({a.strip().lower() for a in addresses if a and a.strip()})
    if len(clean) > limit or any(len(a) > 64 for a in clean):
        raise ValueError("too many addresses, or one that is too long")
    return spark.createDataFrame([(a,) for a in clean], "address string")


def batch_counts(act: DataFrame, wanted: DataFrame) -> DataFrame:
    """The number of events of every wanted address, 0 (not 1) for one without any."""
    counted = act.join(wanted, "address", "left_semi").groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counted, "address", "left").select("address", F.coalesce("n", F.lit(0)).alias("event_count"))


def daily_trend(act: DataFrame) -> DataFrame:
    """Rows and active addresses per chain and day."""
    day = act.filter(F.col("block_time").isNotNull()).groupBy("chain_id", F.to_date("block_time").alias("day"), "address").agg(F.count(F.lit(1)).alias("n"))
    return day.groupBy("chain_id", "day").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("addresses"))


def top_counterparties(act: DataFrame, k: int = 10) -> DataFrame:
    """Each address's counterparties by number of transactions, then volume, then name."""
    g = act.filter(F.col("counterparty_address") != "").groupBy("chain_id", "address", "counterparty_address").agg(F.countDistinct("tx_hash").alias("txs"), zero_sum(F.col("amount")).alias("amount"))
    w = Window.partitionBy("chain_id", "address").orderBy(F.desc("txs"), F.desc("amount"), "counterparty_address")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_sources(act: DataFrame, way: str, k: int = 10) -> DataFrame:
    """Each address's sources (``IN``) or destinations (``OUT``) by number of transactions in that direction alone, then amount, then name."""
    return top_counterparties(act.filter(F.col("direction") == way), k)


def daily_netflow(act: DataFrame) -> DataFrame:
    """In minus out per chain, address and day."""
    return act.filter(F.col("block_time").isNotNull()).groupBy("chain_id", "address", F.to_date("block_time").alias("day")).agg(
        zero_sum(F.col("amount"), is_in()).alias("in_amount"), zero_sum(F.col("amount"), is_out()).alias("out_amount"),
        (zero_sum(F.col("amount"), is_in()) - zero_sum(F.col("amount"), is_out())).cast(D18).alias("net"),
    )


def token_distribution(act: DataFrame) -> DataFrame:
    """Rows and volume per chain and token ('' is the native asset)."""
    return act.groupBy("chain_id", "token_address").agg(F.count(F.lit(1)).alias("rows"), zero_sum(F.col("amount")).alias("amount"))


def volumes(act: DataFrame) -> DataFrame:
    """A10: six conditional sums per chain."""
    u, a = F.col("usd_value"), F.col("amount")
    native = F.col("token_address") == ""
    return act.groupBy("chain_id").agg(
        zero_sum(a, is_in()).alias("in_amount"), zero_sum(a, is_out()).alias("out_amount"), zero_sum(u, is_in()).alias("in_usd"), zero_sum(u, is_out()).alias("out_usd"),
        zero_sum(a, is_in() & native).alias("native_in"), zero_sum(a, is_out() & native).alias("native_out"),
    )


def summary_v2(act: DataFrame) -> DataFrame:
    """Volumes and rows of each address by the kind of its counterparties."""
    kind = lambda k: F.upper("counterparty_entity_type") == k
    aggs = []
    for k in ("CEX", "DEX", "BRIDGE"):
        aggs += [F.count_if(kind(k)).alias(f"{k.lower()}_rows"), zero_sum(F.col("amount"), kind(k) & is_in()).alias(f"{k.lower()}_in"), zero_sum(F.col("amount"), kind(k) & is_out()).alias(f"{k.lower()}_out")]
    return act.groupBy("chain_id", "address").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_in()).alias("in_rows"), F.count_if(is_out()).alias("out_rows"), F.count_if(F.col("direction") == "SELF").alias("self_rows"),
        zero_sum(F.col("usd_value"), is_in()).alias("in_usd"), zero_sum(F.col("usd_value"), is_out()).alias("out_usd"), F.count("usd_value").alias("priced_rows"), *aggs,
    )


def counterparties_v2(act: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` counterparties of each address in four rankings (IN value, OUT value, rows, absolute net) of one grouped result,
    with the share of the total of the ranking's measure and the latest label.

    The grouped result is written once; ranks end at ``k``, so Spark keeps k counterparties of an address on the map side, and totals are
    partial sums.
    """
    from tracewright.operators.relational import top_per_group

    by = ["chain_id", "address"]
    g = act.filter(F.col("counterparty_address") != "").groupBy(*by, "counterparty_address").agg(
        zero_sum(F.col("amount"), is_in()).alias("in_amount"), zero_sum(F.col("amount"), is_out()).alias("out_amount"), F.count(F.lit(1)).alias("rows"),
        F.max(F.when(F.col("counterparty_label") != "", F.struct("block_time", "counterparty_label"))).alias("l"),
    )
    net = F.abs(F.col("in_amount") - F.col("out_amount"))
    g = materialize(g.select(*by, "counterparty_address", "in_amount", "out_amount", "rows", F.col("l.counterparty_label").alias("label"), net.cast(D18).alias("net")), "counterparties")
    measures = {"in_value": "in_amount", "out_value": "out_amount", "rows": "rows", "net": "net"}
    total = g.groupBy(*by).agg(*[F.sum(F.col(c).cast(D18)).cast(D18).alias(f"all_{n}") for n, c in measures.items()])
    out = None
    for name, c in measures.items():
        top = top_per_group(g, by, [F.desc(c), "counterparty_address"], k).join(total.select(*by, F.col(f"all_{name}").alias("all")), by)
        part = top.select(*by, F.lit(name).alias("ranking"), "rank", "counterparty_address", "in_amount", "out_amount", "rows", "label", ratio(F.col(c), F.nullif("all", F.lit(0))).alias("share"))
        out = part if out is None else out.unionByName(part)
    return out


def concentration(act: DataFrame) -> DataFrame:
    """The share of the largest 1, 5 and 10 counterparties in what came in and went out.

    Ranks end at 10, so Spark keeps ten counterparties of an address on the map side; totals are ordinary partial sums. No task sorts a hot address.
    """
    from tracewright.operators.relational import top_per_group

    by = ["chain_id", "address"]
    g = act.filter(is_in() | is_out()).groupBy(*by, "counterparty_address").agg(zero_sum(F.col("amount"), is_in()).alias("i"), zero_sum(F.col("amount"), is_out()).alias("o"))
    out = g.groupBy(*by).agg(zero_sum(F.col("i")).alias("all_i"), zero_sum(F.col("o")).alias("all_o"))
    for v, name in (("i", "in"), ("o", "out")):
        top = top_per_group(g.select(*by, "counterparty_address", v), by, [F.desc(v), "counterparty_address"], 10)
        out = out.join(top.groupBy(*by).agg(*[zero_sum(F.col(v), F.col("rank") <= k).alias(f"{name}{k}") for k in (1, 5, 10)]), by, "left")
    return out.select(*by, *[ratio(F.col(f"{name}{k}"), F.nullif(f"all_{v}", F.lit(0))).alias(f"top{k}_{name}_share") for v, name in (("i", "in"), ("o", "out")) for k in (1, 5, 10)])


RETENTION_H = (1, 6, 24, 168, 720)


def retention(act: DataFrame, as_of: Column) -> DataFrame:
    """Received, and what is left of that received before each cutoff after all that went out, never below 0."""
    seen = act.filter(F.col("block_time") <= as_of)
    out = zero_sum(F.col("amount"), is_out())
    left = [F.greatest(zero_sum(F.col("amount"), is_in() & (F.col("block_time") <= as_of - F.expr(f"INTERVAL {h} HOUR"))) - out, F.lit(0).cast(D18)).cast(D18).alias(f"retained_{h}h") for h in RETENTION_H]
    return seen.groupBy("chain_id", "address").agg(zero_sum(F.col("amount"), is_in()).alias("received"), *left)


PASS_MINUTES = (5, 15, 60, 360, 1440)


def pass_through(act: DataFrame) -> DataFrame:
    """Per window, what went out within it after the last receipt of the same token, at most what was received."""
    from tracewright.operators.relational import asof_left

    by = ["chain_id", "address", "token_address"]
    ins = act.filter(is_in() & F.col("block_time").isNotNull()).groupBy(*by, "block_time").agg(F.sum("amount").cast(D18).alias("in_amount")).withColumnRenamed("block_time", "in_t")
    outs = act.filter(is_out() & F.col("block_time").isNotNull()).groupBy(*by, "block_time").agg(F.sum("amount").cast(D18).alias("out_amount"))
    m = asof_left(outs, ins, by, "block_time", "in_t", ["in_amount"])
    age = F.unix_micros("block_time") - F.unix_micros("matched_at")
    received = ins.groupBy("chain_id", "address").agg(F.sum("in_amount").cast(D18).alias("received"))
    got = m.groupBy("chain_id", "address").agg(*[zero_sum(F.col("out_amount"), age <= w * 60_000_000).alias(f"w{w}") for w in PASS_MINUTES])
    j = received.join(got, ["chain_id", "address"], "left")
    capped = {w: F.least(F.coalesce(F.col(f"w{w}"), F.lit(0).cast(D18)), F.col("received")) for w in PASS_MINUTES}
    return j.select("chain_id", "address", "received", *[capped[w].alias(f"passed_{w}m") for w in PASS_MINUTES], *[ratio(capped[w], F.nullif(F.col("received"), F.lit(0))).alias(f"ratio_{w}m") for w in PASS_MINUTES])


def snapshot(act: DataFrame, as_of: Column) -> DataFrame:
    """Summary, concentration and retention as of an instant."""
    seen = act.filter(F.col("block_time") <= as_of)
    k = ["chain_id", "address"]
    return summary_v2(seen).select(*k, "rows", "in_usd", "out_usd").join(concentration(seen), k, "left").join(retention(seen, as_of), k, "left")


def family(contracts: DataFrame, kin: str) -> DataFrame:
    """Every contract (chain_id, ...) with the number of contracts of its family, which share a non-empty ``kin`` (a code hash, a creator), and the
    chains they are on; a contract without kin is alone. Counts are aggregated and looked up, so a large family is no window."""
    n = contracts.filter(F.col(kin) != "").groupBy(kin).agg(F.count(F.lit(1)).alias("family_size"), F.countDistinct("chain_id").alias("chains"))
    j = skew_safe_lookup(contracts, n, [kin], ["family_size", "chains"])
    return j.withColumn("family_size", F.coalesce("family_size", F.lit(1))).withColumn("chains", F.coalesce("chains", F.lit(1)))


def assets(act: DataFrame) -> DataFrame:
    """In, out and balance (possibly negative) per address and token; self-transfers don't count."""
    i, o = zero_sum(F.col("amount"), is_in()), zero_sum(F.col("amount"), is_out())
    return act.groupBy("chain_id", "address", "token_address").agg(i.alias("in_amount"), o.alias("out_amount"), (i - o).cast(D18).alias("balance"))


def asset_risk(balances: DataFrame) -> DataFrame:
    """Share that went out, whether almost all did, and a level."""
    i, o = F.col("in_amount"), F.col("out_amount")
    rate = F.coalesce(ratio(o, F.nullif(i + o, F.lit(0))), F.lit(0.0))
    sold = (i > 0) & (o.cast("double") >= 0.8 * i.cast("double"))
    return balances.select("chain_id", "address", "token_address", rate.alias("out_rate"), sold.alias("liquidated"), F.when(sold, "high").when(rate >= 0.4, "medium").otherwise("low").alias("level"))


def first_seen(act: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """The earliest block in which each address is met in any role (role name -> column), with the role and the source that has it.

    At the same block the first role of ``roles`` counts, then the first source by name. A contract creation comes before any other row of its block.
    """
    made = F.coalesce(F.col("activity_type").isin("CONTRACT_CREATE", "CONTRACT_CREATION"), F.lit(False))
    rows = F.inline(F.array(*[F.struct(F.col(c).alias("who"), F.lit(i).alias("place"), F.lit(n).alias("role")) for i, (n, c) in enumerate(roles.items())]))
    seen = act.filter(F.col("block_number").isNotNull()).select("chain_id", "block_number", (~made).alias("plain"), "source_provider", rows).filter(F.coalesce(F.col("who"), F.lit("")) != "")
    best = seen.groupBy("chain_id", F.col("who").alias("address")).agg(F.min(F.struct("block_number", "plain", "place", "source_provider", "role")).alias("m"))
    return best.select("chain_id", "address", F.col("m.block_number").alias("first_block"), "m.role", F.col("m.source_provider").alias("source"), (~F.col("m.plain")).alias("created"))


def amount_thresholds(act: DataFrame) -> DataFrame:
    """Each token's 95th percentile as the value at index floor((n - 1) * 0.95)."""
    from tracewright.operators.relational import rank_pick

    return rank_pick(act, ["chain_id", "token_address"], "amount", F.floor((F.col("n") - 1) * 0.95) + 1, "p95")


def frequency_classes(act: DataFrame) -> DataFrame:
    """How many addresses have how much activity."""
    n = act.groupBy("chain_id", "address").agg(F.count(F.lit(1)).alias("n"))
    k = F.when(F.col("n") >= 100, "very_active").when(F.col("n") >= 20, "active").when(F.col("n") >= 5, "regular").otherwise("rare")
    return n.groupBy(k.alias("class")).agg(F.count(F.lit(1)).alias("addresses"), F.sum("n").alias("rows"))


def two_hops(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Root -> middle -> end over aggregated edges (src, dst, token, amount), neither hop returning; the lesser amount, 'mixed' for two tokens."""
    e1, e2 = edges.alias("x").join(roots.alias("r"), F.col("x.src") == F.col("r.root"), "left_semi"), edges.alias("y")
    j = e1.join(e2, F.col("x.dst") == F.col("y.src"))
    return j.filter((F.col("y.dst") != F.col("x.src")) & (F.col("x.dst") != F.col("x.src")) & (F.col("y.dst") != F.col("y.src"))).select(
        F.col("x.src").alias("root"), F.col("x.dst").alias("middle"), F.col("y.dst").alias("end"), F.when(F.col("x.token") == F.col("y.token"), F.col("x.token")).otherwise("mixed").alias("token"), F.least("x.amount", "y.amount").alias("amount")
    )


def shared_counterparties(act: DataFrame, roots: DataFrame, min_shared: int = 2, hub_degree: int | None = None) -> DataFrame:
    """Addresses that share counterparties with ``roots``: shared, union and Jaccard similarity. Pairs exist only between a root and
    its candidates. With ``hub_degree`` a counterparty of more addresses than that (a service) says nothing and isn't counted as shared."""
    pairs = act.filter(F.col("counterparty_address") != "").select("address", "counterparty_address").distinct()
    degree = pairs.groupBy("address").agg(F.count(F.lit(1)).alias("n"))
    met = pairs
    if hub_degree is not None:
        busy = pairs.groupBy("counterparty_address").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hub_degree)
        met = pairs.join(busy, "counterparty_address", "left_anti")
    mine = met.join(roots, met.address == roots.root, "left_semi").select(F.col("address").alias("root"), "counterparty_address")
    both = mine.join(met, "counterparty_address").filter(F.col("root") != F.col("address")).groupBy("root", "address").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)
    j = both.join(degree.select("address", F.col("n").alias("na")), "address").join(degree.select(F.col("address").alias("root"), F.col("n").alias("nr")), "root")
    return j.select("root", "address", "shared", (F.col("na") + F.col("nr") - F.col("shared")).alias("either"), ratio(F.col("shared"), F.col("na") + F.col("nr") - F.col("shared")).alias("jaccard"))


def common_flows(act: DataFrame, targets: DataFrame, way: str = "IN", least: int = 2, k: int = 10) -> DataFrame:
    """The ``k`` counterparties that most of the targets share on one side (at least ``least``), with how many and how much; ties by amount and name."""
    rows = act.filter((F.col("direction") == way) & (F.col("counterparty_address") != "")).join(targets, "address", "left_semi")
    g = rows.groupBy("counterparty_address").agg(F.countDistinct("address").alias("targets"), zero_sum(F.col("amount")).alias("amount")).filter(F.col("targets") >= least)
    return g.orderBy(F.desc("targets"), F.desc("amount"), "counterparty_address").limit(k)
