"""Whole sets of figures over address activity: all-time statistics, summaries, the three refresh tables, services, quality.

Each is one pass of conditional aggregates over a grain; a figure over no rows is 0 unless it says null. Input as in address_analytics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.address_analytics import D18, is_in, is_out, ratio, zero_sum
from tracewright.operators.quality import ADDRESS
from tracewright.runtime import same_keys

BY = ["chain_id", "address"]
#: Activity types by what they are.
NATIVE = ("NATIVE_TRANSFER", "CONTRACT_CALL", "INTERNAL_TRANSFER", "INTERNAL_TRANSACTION")
TOKENS = ("TOKEN_TRANSFER", "ERC20_TRANSFER", "ERC721_TRANSFER", "ERC1155_TRANSFER")
CREATES = ("CONTRACT_CREATE", "CONTRACT_CREATION")


def kind(*types: str) -> Column:
    return F.coalesce(F.col("activity_type").isin(*types), F.lit(False))


def service(*types: str) -> Column:
    return F.coalesce(F.lower("counterparty_entity_type").isin(*types), F.lit(False))


def top(c: str, when: Column) -> Column:
    return F.coalesce(F.max(F.when(when, F.col(c))), F.lit(0)).cast(D18)


def usd(when: Column) -> Column:
    return zero_sum(F.col("usd_value"), when)


def distinct_if(c: Column, when: Column) -> Column:
    return F.countDistinct(F.when(when, c))


def all_time(act: DataFrame) -> DataFrame:
    """First and last time, events, transactions, contracts made, tokens, in and out rows and amounts, net, active days, counterparties."""
    i, o = zero_sum(F.col("amount"), is_in()), zero_sum(F.col("amount"), is_out())
    return act.groupBy(*BY).agg(
        F.min("block_time").alias("first_t"), F.max("block_time").alias("last_t"), F.count(F.lit(1)).alias("events"), F.countDistinct("tx_hash").alias("txs"), F.count_if(kind(*CREATES)).alias("contracts"), distinct_if(F.col("token_address"), F.col("token_address") != "").alias("tokens"),
        F.count_if(is_in()).alias("in_rows"), F.count_if(is_out()).alias("out_rows"), i.alias("total_in"), o.alias("total_out"), (i - o).cast(D18).alias("net"), F.countDistinct(F.to_date("block_time")).alias("active_days"), distinct_if(F.col("counterparty_address"), F.col("counterparty_address") != "").alias("counterparties"),
    )


def summary(act: DataFrame) -> DataFrame:
    """The 21 figures of an address: transactions, rows by way and kind, counterparties, times, USD in, out, net and largest, and by service."""
    yes = F.lit(True)
    return act.groupBy(*BY).agg(
        F.countDistinct("tx_hash").alias("txs"), F.count_if(is_in()).alias("in_rows"), F.count_if(is_out()).alias("out_rows"), F.count_if(kind(*TOKENS)).alias("token_rows"), F.count_if(kind("INTERNAL_TRANSFER")).alias("internal_rows"),
        distinct_if(F.col("counterparty_address"), F.col("counterparty_address") != "").alias("counterparties"), F.min("block_time").alias("first_t"), F.max("block_time").alias("last_t"), F.countDistinct(F.to_date("block_time")).alias("active_days"),
        usd(is_in()).alias("in_usd"), usd(is_out()).alias("out_usd"), (usd(is_in()) - usd(is_out())).cast(D18).alias("net_usd"), top("usd_value", is_in()).alias("largest_in_usd"), top("usd_value", is_out()).alias("largest_out_usd"),
        usd(is_in() & service("cex", "exchange")).alias("cex_in_usd"), usd(is_out() & service("cex", "exchange")).alias("cex_out_usd"), usd(service("dex", "decentralized_exchange")).alias("dex_usd"), usd(service("bridge")).alias("bridge_usd"),
        F.count_if(kind(*CREATES)).alias("contracts"), F.count("usd_value").alias("priced_rows"), F.count(yes).alias("rows"),
    )


def refresh_summary(act: DataFrame) -> DataFrame:
    """The summary table that a refresh writes."""
    native = kind("NATIVE_TRANSFER", "CONTRACT_CALL")
    i, o = zero_sum(F.col("amount"), is_in() & kind(*NATIVE)), zero_sum(F.col("amount"), is_out() & kind(*NATIVE))
    return act.groupBy(*BY).agg(
        F.min("block_time").alias("first_t"), F.max("block_time").alias("last_t"), distinct_if(F.col("tx_hash"), native).alias("txs"), distinct_if(F.col("tx_hash"), native & is_in()).alias("in_txs"), distinct_if(F.col("tx_hash"), native & is_out()).alias("out_txs"),
        F.count_if(kind(*TOKENS)).alias("token_rows"), F.count_if(kind("INTERNAL_TRANSFER", "INTERNAL_TRANSACTION")).alias("internal_rows"), F.count_if(kind("ERC721_TRANSFER", "ERC1155_TRANSFER")).alias("nft_rows"), F.count_if(kind(*CREATES) & is_out()).alias("contracts"),
        distinct_if(F.col("counterparty_address"), F.col("counterparty_address") != "").alias("counterparties"), i.alias("native_in"), o.alias("native_out"), (i - o).cast(D18).alias("native_net"), usd(is_in()).alias("in_usd"), usd(is_out()).alias("out_usd"), (usd(is_in()) - usd(is_out())).cast(D18).alias("net_usd"),
        F.countDistinct(F.to_date("block_time")).alias("active_days"), top("usd_value", is_in()).alias("largest_in_usd"), top("usd_value", is_out()).alias("largest_out_usd"), F.max_by("counterparty_address", F.struct("block_time", "activity_id")).alias("last_counterparty"),
    )


def refresh_counterparties(act: DataFrame) -> DataFrame:
    """The counterparty table that a refresh writes."""
    return act.filter(F.col("counterparty_address") != "").groupBy(*BY, "counterparty_address", "direction").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("tx_hash").alias("txs"), zero_sum(F.col("amount"), kind(*NATIVE)).alias("native_amount"), zero_sum(F.col("usd_value")).alias("usd_value"), F.min("block_time").alias("first_t"), F.max("block_time").alias("last_t")
    )


def refresh_daily(act: DataFrame) -> DataFrame:
    """The daily table that a refresh writes; rows without a time have no day."""
    i, o = zero_sum(F.col("amount"), is_in() & kind(*NATIVE)), zero_sum(F.col("amount"), is_out() & kind(*NATIVE))
    return act.filter(F.col("block_time").isNotNull()).groupBy(*BY, F.to_date("block_time").alias("day")).agg(
        F.count_if(is_in()).alias("in_rows"), F.count_if(is_out()).alias("out_rows"), i.alias("native_in"), o.alias("native_out"), (i - o).cast(D18).alias("native_net"), usd(is_in()).alias("in_usd"), usd(is_out()).alias("out_usd"), (usd(is_in()) - usd(is_out())).cast(D18).alias("net_usd"),
        distinct_if(F.col("counterparty_address"), F.col("counterparty_address") != "").alias("counterparties"),
    )


def address_statistics(act: DataFrame, as_of: Column, concentration: DataFrame) -> DataFrame:
    """Transactions, sources and targets, active days, recent rows, sums, average receipt, largest amount, the token that brought most, and
    the shares of the largest 1 and 5 sources and targets (``concentration``: one row an address)."""
    recent = lambda hours: F.count_if((F.col("block_time") > as_of - F.expr(f"INTERVAL {hours} HOUR")) & (F.col("block_time") <= as_of))
    other = F.col("counterparty_address") != ""
    base = act.groupBy(*BY).agg(
        F.countDistinct("tx_hash").alias("txs"), distinct_if(F.col("counterparty_address"), is_in() & other).alias("upstream"), distinct_if(F.col("counterparty_address"), is_out() & other).alias("downstream"), F.countDistinct(F.to_date("block_time")).alias("active_days"),
        recent(24).alias("last_day"), recent(168).alias("last_week"), recent(720).alias("last_month"), zero_sum(F.col("amount"), is_in()).alias("total_in"), zero_sum(F.col("amount"), is_out()).alias("total_out"),
        F.round(F.avg(F.when(is_in(), F.col("amount").cast("double"))), 9).alias("average_in"), F.max("amount").alias("largest"),
    )
    tokens = act.filter(is_in() & (F.col("token_address") != "")).groupBy(*BY, "token_address").agg(zero_sum(F.col("amount")).alias("a"))
    most = tokens.groupBy(*BY).agg(F.min_by("token_address", F.struct((-F.col("a")).alias("a"), "token_address")).alias("dominant_token"))
    b, m, c = base.alias("b"), most.alias("m"), concentration.select(*BY, *[f"top{k}_{w}_share" for w in ("in", "out") for k in (1, 5)]).alias("c")
    j = b.join(m, same_keys("b", "m", *BY), "left").join(c, same_keys("b", "c", *BY), "left")
    return j.select("b.*", "m.dominant_token", *[f"c.top{k}_{w}_share" for w in ("in", "out") for k in (1, 5)])


def flow_statistics(act: DataFrame) -> DataFrame:
    """A5: per chain nodes, edges, transfers and transactions of what goes out, in and out totals and net, contracts met and risky nodes
    (100 transfers or more). Everything is counted, so truncated is always false."""
    e = act.filter(is_out() & (F.col("counterparty_address") != "")).groupBy(*BY, "counterparty_address", "token_address").agg(F.count(F.lit(1)).alias("n"), zero_sum(F.col("amount")).alias("amount"))
    ends = e.select("chain_id", F.explode(F.array("address", "counterparty_address")).alias("node"), "n").groupBy("chain_id", "node").agg(F.sum("n").alias("n"))
    nodes = ends.groupBy("chain_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n") >= 100).alias("risk_nodes"))
    edges = e.groupBy("chain_id").agg(F.count(F.lit(1)).alias("edges"), F.sum("n").alias("transfers"))
    i, o = zero_sum(F.col("amount"), is_in()), zero_sum(F.col("amount"), is_out())
    sums = act.groupBy("chain_id").agg(F.countDistinct("tx_hash").alias("txs"), i.alias("total_in"), o.alias("total_out"), (i - o).cast(D18).alias("net"), distinct_if(F.col("counterparty_address"), kind("CONTRACT_CALL", "SWAP", "APPROVE")).alias("contracts"))
    return sums.join(edges, "chain_id").join(nodes, "chain_id").withColumn("truncated", F.lit(False))


def entity_flows(act: DataFrame, labels: DataFrame) -> DataFrame:
    """Per entity type and label: rows, addresses, withdrawn and deposited, and the rows whose label is confident (its source is verified).

    ``labels``: address, label, verified, one row an address; a counterparty without a label of its own takes the row's."""
    typed = act.filter(F.col("counterparty_entity_type") != "")
    l = labels.alias("l")
    j = typed.alias("a").join(l, F.col("a.counterparty_address") == F.col("l.address"), "left").select(
        F.upper("a.counterparty_entity_type").alias("entity_type"), F.coalesce(F.nullif("l.label", F.lit("")), F.nullif("a.counterparty_label", F.lit("")), F.lit("unknown")).alias("label"), F.coalesce("l.verified", F.lit(False)).alias("sure"), "a.address", "a.direction", "a.amount"
    )
    return j.groupBy("entity_type", "label").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("address").alias("addresses"), zero_sum(F.col("amount"), is_in()).alias("withdrawn"), zero_sum(F.col("amount"), is_out()).alias("deposited"), F.count_if("sure").alias("sure_rows"))


def dex_statistics(act: DataFrame) -> DataFrame:
    """Swaps per chain, counted once per (transaction, pool, trader, token): number, USD volume (null if none is priced), the most used protocol (ties by name)."""
    key = ["chain_id", "tx_hash", "counterparty_address", "address", "token_address"]
    swaps = act.filter(kind("SWAP", "DEX_SWAP")).groupBy(*key).agg(F.max("usd_value").alias("usd"), F.max("counterparty_label").alias("protocol"))
    names = swaps.groupBy("chain_id", "protocol").agg(F.count(F.lit(1)).alias("n"), F.sum("usd").alias("usd"))
    named = F.when(F.col("protocol") != "", F.struct((-F.col("n")).alias("n"), "protocol"))
    return names.groupBy("chain_id").agg(F.sum("n").alias("swaps"), F.sum("usd").cast(D18).alias("volume_usd"), F.coalesce(F.min(named)["protocol"], F.lit("")).alias("top_protocol"))


def bridge_statistics(act: DataFrame) -> DataFrame:
    """Bridge transfers per chain, once per transaction and way: counts, USD in and out (null if none is priced), the most used bridge."""
    rows = act.filter(service("bridge") & (is_in() | is_out())).groupBy("chain_id", "tx_hash", "direction", "counterparty_address").agg(F.max("usd_value").alias("usd"), F.max("counterparty_label").alias("bridge"))
    names = rows.groupBy("chain_id", "bridge").agg(F.count_if(is_in()).alias("i"), F.count_if(is_out()).alias("o"), F.sum(F.when(is_in(), F.col("usd"))).alias("iu"), F.sum(F.when(is_out(), F.col("usd"))).alias("ou"))
    named = F.when(F.col("bridge") != "", F.struct((-(F.col("i") + F.col("o"))).alias("n"), "bridge"))
    return names.groupBy("chain_id").agg(F.sum("i").alias("in_rows"), F.sum("o").alias("out_rows"), F.sum("iu").cast(D18).alias("in_usd"), F.sum("ou").cast(D18).alias("out_usd"), F.coalesce(F.min(named)["bridge"], F.lit("")).alias("top_bridge"))


def financial_summary(act: DataFrame, median: DataFrame, stable: tuple[str, ...], large: float = 1000.0) -> DataFrame:
    """USD in, out and net; native, stable and token parts; largest, average and median (``median``: one row an address); large rows by way;
    coverage. Null, not 0, where nothing is priced."""
    u = F.col("usd_value")
    s = lambda when: F.sum(F.when(when, u)).cast(D18)
    is_stable, native = F.upper(F.trim("token_symbol")).isin(*stable), F.col("token_address") == ""
    base = act.groupBy(*BY).agg(
        s(is_in()).alias("in_usd"), s(is_out()).alias("out_usd"), F.when(F.count(u) > 0, usd(is_in()) - usd(is_out())).cast(D18).alias("net_usd"), s(native).alias("native_usd"), s(is_stable).alias("stable_usd"), s(~native & ~F.coalesce(is_stable, F.lit(False))).alias("token_usd"), F.max(u).alias("largest_usd"),
        F.round(F.avg(u.cast("double")), 9).alias("average_usd"), F.count_if((u >= large) & is_in()).alias("large_in"), F.count_if((u >= large) & is_out()).alias("large_out"), ratio(F.count("usd_value"), F.count(F.lit(1))).alias("coverage"),
    )
    return base.alias("b").join(median.alias("m"), same_keys("b", "m", *BY), "left").select("b.*", "m.median_usd")


def dashboard(act: DataFrame, trend_blocks: int = 1000) -> tuple[DataFrame, DataFrame]:
    """A3: (totals in one row: rows, transfers, tokens, addresses on either side, addresses with 100 events or more; rows per range of blocks)."""
    moved = F.count_if(kind(*TOKENS, "NATIVE_TRANSFER"))
    sides = act.select(F.explode(F.array(F.struct(F.col("address").alias("a"), F.lit(1).alias("n")), F.struct(F.col("counterparty_address").alias("a"), F.lit(0).alias("n")))).alias("x")).select("x.*").filter(F.col("a") != "")
    per = sides.groupBy("a").agg(F.sum("n").alias("n")).agg(F.count(F.lit(1)).alias("addresses"), F.count_if(F.col("n") >= 100).alias("risk_addresses"))
    tokens = act.select("chain_id", "token_address").distinct().agg(F.count(F.lit(1)))
    totals = act.agg(F.count(F.lit(1)).alias("rows"), moved.alias("transfers")).withColumns({"tokens": tokens.scalar(), "addresses": per.select("addresses").scalar(), "risk_addresses": per.select("risk_addresses").scalar()})
    trend = act.filter(F.col("block_number").isNotNull()).groupBy("chain_id", (F.floor(F.col("block_number") / trend_blocks) * trend_blocks).alias("from_block")).agg(F.count(F.lit(1)).alias("rows"), moved.alias("transfers"))
    return totals, trend


def quality_counters(act: DataFrame) -> DataFrame:
    """The counters of a financial report per chain: prices required, there, historical, fallback and missing; position events and known
    cost; swap and bridge candidates and decoded ones; counterparties, known ones, last update; and whether the invariants hold."""
    priced_source = F.upper(F.coalesce("price_source", F.lit("")))
    full = F.col("usd_value").isNotNull() & F.col("price_usd").isNotNull() & F.col("price_time").isNotNull()
    fallback = priced_source.isin("PEG_FALLBACK", "FALLBACK")
    live = full & (priced_source != "") & (priced_source != "CURRENT")
    need = kind(*TOKENS)
    swap, bridge = kind("SWAP", "DEX_SWAP"), kind("BRIDGE_DEPOSIT", "BRIDGE_WITHDRAW", "BRIDGE_SEND", "BRIDGE_RECEIVE")
    g = act.groupBy("chain_id").agg(
        F.count_if(need).alias("required"), F.count_if(need & live).alias("priced"), F.count_if(need & live & ~fallback).alias("historical"), F.count_if(need & live & fallback).alias("fallback"), F.count_if(need & ~live).alias("missing"),
        F.count_if(is_in()).alias("position_events"), F.count_if(is_in() & F.col("usd_value").isNotNull()).alias("known_cost"), F.count_if(swap | service("dex", "dex_router", "router")).alias("swap_candidates"), F.count_if(swap).alias("swaps"),
        F.count_if(bridge | service("bridge")).alias("bridge_candidates"), F.count_if(bridge).alias("bridges"), distinct_if(F.col("counterparty_address"), F.col("counterparty_address") != "").alias("counterparties"), distinct_if(F.col("counterparty_address"), (F.col("counterparty_address") != "") & (F.col("counterparty_entity_type") != "")).alias("known_counterparties"), F.max("ingested_at").alias("last_updated"),
    )
    c = F.col
    return g.withColumn("consistent", (c("priced") <= c("required")) & (c("historical") + c("fallback") == c("priced")) & (c("priced") + c("missing") == c("required")) & (c("swaps") <= c("swap_candidates")) & (c("bridges") <= c("bridge_candidates")) & (c("known_counterparties") <= c("counterparties")))


def chunk_addresses(rows: DataFrame) -> DataFrame:
    """Transfers of a chunk by address, a self-transfer counted once."""
    return rows.select(F.explode(F.array_distinct(F.array("from_address", "to_address"))).alias("address")).filter(F.col("address").rlike(ADDRESS)).groupBy("address").agg(F.count(F.lit(1)).alias("transfers"))


def periods(act: DataFrame) -> DataFrame:
    """Rows, active addresses and amount by day, week and month."""
    timed = act.filter(F.col("block_time").isNotNull())
    unit = lambda u: F.struct(F.lit(u).alias("period"), F.to_date(F.date_trunc(u, "block_time")).alias("start"))
    per = timed.select(F.inline(F.array(*[unit(u) for u in ("day", "week", "month")])), "address", "amount").groupBy("period", "start", "address").agg(F.count(F.lit(1)).alias("n"), zero_sum(F.col("amount")).alias("a"))
    return per.groupBy("period", "start").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("addresses"), F.sum("a").cast(D18).alias("amount"))


def top_interactions(act: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` pairs of each chain with most rows (ties by amount, then names)."""
    from tracewright.operators.relational import top_per_group

    g = act.filter(F.col("counterparty_address") != "").groupBy(*BY, "counterparty_address").agg(F.count(F.lit(1)).alias("rows"), zero_sum(F.col("amount")).alias("amount"))
    return top_per_group(g, ["chain_id"], [F.desc("rows"), F.desc("amount"), "address", "counterparty_address"], k)


def risk_basis(transfers: DataFrame) -> DataFrame:
    """One row: the share of all transfers that the ten most frequent receivers got, and the mean Jaccard similarity of the targets of the
    five senders with most targets (ties by name). Only these five senders' targets are compared, at most ten pairs."""
    got = transfers.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    ten = got.orderBy(F.desc("n"), "node").limit(10).agg(F.sum("n")).scalar()
    pairs = transfers.select("src", "dst").distinct()
    most = pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src").limit(5)
    mine = pairs.join(F.broadcast(most), "src")  # five senders
    both = mine.alias("a").join(mine.alias("b"), (F.col("a.dst") == F.col("b.dst")) & (F.col("a.src") < F.col("b.src"))).groupBy(F.col("a.src").alias("x"), F.col("b.src").alias("y")).agg(F.count(F.lit(1)).alias("k"), F.max("a.n").alias("nx"), F.max("b.n").alias("ny"))
    five = most.agg(F.count(F.lit(1))).scalar()
    jaccard = both.agg(F.sum(F.col("k") / (F.col("nx") + F.col("ny") - F.col("k")))).scalar()
    total = got.agg(F.sum("n").alias("n"))
    combos = five * (five - 1) / 2
    return total.select(F.round(ten / F.col("n"), 6).alias("top10_share"), F.round(F.coalesce(F.try_divide(jaccard, F.nullif(combos, F.lit(0.0))), F.lit(0.0)), 6).alias("jaccard"))


def profile_risk(stats: DataFrame, concentration: DataFrame) -> DataFrame:
    """100 (0.6 min(transactions a day / 100, 1) + 0.4 the largest counterparty's share), levels at 60 and 30."""
    j = stats.alias("s").join(concentration.alias("c"), same_keys("s", "c", *BY), "left")
    often = F.coalesce(F.try_divide(F.col("txs").cast("double"), F.nullif("active_days", F.lit(0)).cast("double")), F.lit(0.0))
    top_share = F.greatest(F.coalesce("top1_in_share", F.lit(0.0)), F.coalesce("top1_out_share", F.lit(0.0)))
    score = F.round(F.least(F.lit(100.0), 100 * (0.6 * F.least(often / 100, F.lit(1.0)) + 0.4 * top_share)), 2)
    s = j.select("s.chain_id", "s.address", F.round(often, 2).alias("frequency"), score.alias("score"))
    return s.withColumn("level", F.when(F.col("score") >= 60, "high").when(F.col("score") >= 30, "medium").otherwise("low"))


def cross_chain(act: DataFrame) -> DataFrame:
    """Labelled entities (type and label, case and outer spaces aside) as one over all chains: chains, addresses, rows, first and last time."""
    label = F.lower(F.trim("counterparty_label"))
    rows = act.filter((F.col("counterparty_label") != "") & (F.col("counterparty_address") != ""))
    return rows.groupBy(F.upper(F.coalesce("counterparty_entity_type", F.lit(""))).alias("entity_type"), label.alias("label")).agg(
        F.array_join(F.array_sort(F.collect_set(F.col("chain_id").cast("string"))), "|").alias("chains"), F.countDistinct("counterparty_address").alias("addresses"), F.count(F.lit(1)).alias("rows"), F.min("block_time").alias("first_t"), F.max("block_time").alias("last_t")
    )
