"""Fund flow between addresses with known entities: typed edges, bounded graphs, scored paths, beam traces, settlement, profit, patterns.

Edges have src, dst, token, amount, n, first_t, last_t and first_block; entities have node, entity_type and entity_id, one row a node. Searches
go level by level over joins; a path is one row, and what a score needs of it travels in scalar columns.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.relational import rank_pick, top_per_group
from tracewright.runtime import materialize, skew_safe_lookup

#: Entity types that take deposits, that pass funds through, and what they cost a path.
CASHOUT = ("EXCHANGE", "CEX_DEPOSIT", "CEX_HOT_WALLET", "CEX_COLD_WALLET", "PAYMENT_SERVICE", "CUSTODIAN")
DEPOSIT, SWAPS = ("EXCHANGE", "CEX_DEPOSIT", "CEX_HOT_WALLET", "CEX_COLD_WALLET"), ("DEX", "ROUTER")
PATH_NOISE = {"ROUTER": 0.15, "DEX": 0.15, "CONTRACT": 0.05}
BEAM_PENALTY = {"EXCHANGE": 0.6, "BRIDGE": 0.4, "DEX": 0.4, "ROUTER": 0.3, "CONTRACT": 0.2}
#: Weights of value, profit, settlement and entity for each goal of an investigation.
GOALS = {"cashout": (0.25, 0.2, 0.15, 0.2), "settlement": (0.25, 0.15, 0.3, 0.1), "profit": (0.2, 0.35, 0.15, 0.1), "collector": (0.25, 0.15, 0.15, 0.25)}


def pick(key: Column, table: Mapping[str, float], other: float = 0.0) -> Column:
    return reduce(lambda acc, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(acc), table.items(), F.lit(other))


def typed_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """``edges`` with the types and ids of both ends ('' if unknown) and kind: INTERNAL, DEPOSIT, BRIDGE_OUT, SWAP_OUT, BRIDGE_IN, SWAP_IN or TRANSFER."""
    e = edges
    for side, end in (("from", "src"), ("to", "dst")):
        known = entities.select(F.col("node").alias(end), F.col("entity_type").alias(f"{side}_type"), F.col("entity_id").alias(f"{side}_entity"))
        e = skew_safe_lookup(e, known, [end], [f"{side}_type", f"{side}_entity"])
    e = e.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("from_type", "from_entity", "to_type", "to_entity")})
    to, frm = F.col("to_type"), F.col("from_type")
    kind = (
        F.when((F.col("from_entity") != "") & (F.col("from_entity") == F.col("to_entity")), "INTERNAL").when(to.isin(*DEPOSIT), "DEPOSIT").when(to == "BRIDGE", "BRIDGE_OUT").when(to.isin(*SWAPS), "SWAP_OUT")
        .when(frm == "BRIDGE", "BRIDGE_IN").when(frm.isin(*SWAPS), "SWAP_IN").otherwise("TRANSFER")
    )
    return e.withColumn("kind", kind)


def entity_graph(typed: DataFrame, root: str, depth: int = 6, max_nodes: int = 500) -> DataFrame:
    """The edges that go out from ``root`` within ``depth`` levels, with the level at which their source was reached.

    Level-synchronous; no level is begun once ``max_nodes`` nodes are known, so a level is whole or absent.
    """
    spark = typed.sparkSession
    out = typed.filter((F.col("src") != F.col("dst")) & (F.col("dst") != ""))
    front = spark.createDataFrame([(root, 0)], "node string, level int")
    seen, found, known = front.select("node"), None, 1
    for k in range(depth):
        if known >= max_nodes:
            break
        hit = materialize(out.join(front.select("node", "level"), F.col("src") == F.col("node")).drop("node"), "level")
        found = hit if found is None else found.unionByName(hit)
        fresh = materialize(hit.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("level", F.lit(k + 1)), "front")
        n = fresh.count()
        if not n:
            break
        known, front, seen = known + n, fresh, seen.union(fresh.select("node"))
    return found


def path_kind(hops: Column, terminal: Column) -> Column:
    return F.when(terminal.isin(*CASHOUT), F.when(hops == 1, "DIRECT_CASHOUT").otherwise("MULTI_HOP_CASHOUT")).when(terminal == "BRIDGE", "BRIDGE_EXIT").when(terminal == "UNKNOWN_SERVICE", "COLLECT_AND_SETTLE").otherwise("UNKNOWN")


def path_score(goal: str, hops: Column, total: Column, terminal: Column, first_block: Column, last_block: Column, known: Column, noise: Column) -> Column:
    """0 to 1 from value, profit, settlement and entity (weighted by goal), continuity in time, confidence and noise."""
    kind = path_kind(hops, terminal)
    value = F.when(total > 0, 1 - 1 / (1 + F.log10(total + 1))).otherwise(0.0)
    profit = F.when(terminal.isin("EXCHANGE", "CEX_DEPOSIT", "PAYMENT_SERVICE"), 0.9).when(kind.endswith("CASHOUT"), 0.8).otherwise(0.3)
    settle = F.when(terminal.isin("DORMANT_WALLET", "COLD_STORAGE", "TREASURY", "SETTLEMENT"), 0.9).when(terminal == "UNKNOWN_SERVICE", 0.6).otherwise(0.2)
    entity = F.when(terminal.isin("EXCHANGE", "CEX_DEPOSIT", "CEX_HOT_WALLET"), 0.9).otherwise(F.when(kind == "COLLECT_AND_SETTLE", 0.85).otherwise(0.3) if goal == "collector" else F.lit(0.3))
    gap = last_block - first_block
    steady = F.when((hops <= 1) | (gap <= 0), 0.5).when(gap < 1000, 0.95).when(gap < 10000, 0.8).when(gap < 100000, 0.5).otherwise(0.2)
    sure = F.least(F.lit(0.9), 0.6 + 0.05 * known)
    w = GOALS[goal]
    raw = w[0] * value + w[1] * profit + w[2] * settle + w[3] * entity + 0.1 * steady + 0.1 * sure + 0.05 * 0.05 - F.least(F.lit(0.3), noise)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 3)


def find_paths(typed: DataFrame, root: str, max_depth: int = 4, top_k: int = 10, limit: int = 50, goal: str = "cashout") -> DataFrame:
    """The ``limit`` best paths from ``root`` (every prefix of a path is one): no node twice, and of each node only the ``top_k`` largest edges.

    At most top_k^max_depth paths exist, whatever the size of the graph. Equal scores are ordered by the path's text.
    """
    steps = materialize(top_per_group(typed.filter(F.col("src") != F.col("dst")), ["src"], [F.desc("amount"), "dst", "token"], top_k).select("src", "dst", "token", F.col("amount").cast("double").alias("amount"), "first_block", "to_type", "to_entity"), "steps")
    start = typed.sparkSession.createDataFrame([(0, root, [root])], "hops int, tail string, nodes array<string>").select(
        "*", F.lit("").alias("source"), F.lit("").alias("tokens"), F.lit(0.0).alias("total"), F.lit(0.0).alias("last_amount"), F.lit(None).cast("bigint").alias("b0"), F.lit(None).cast("bigint").alias("b1"), F.lit("").alias("terminal"), F.lit(0).alias("known"), F.lit(0.0).alias("noise")
    )
    front, out = start, None
    for k in range(1, max_depth + 1):
        grown = front.join(steps, F.col("tail") == F.col("src")).filter(~F.array_contains("nodes", F.col("dst"))).select(
            F.lit(k).alias("hops"), F.col("dst").alias("tail"), F.concat("nodes", F.array("dst")).alias("nodes"), F.col("tail").alias("source"), F.when(F.col("tokens") == "", F.col("token")).otherwise(F.concat_ws(">", "tokens", "token")).alias("tokens"),
            (F.col("total") + F.col("amount")).alias("total"), F.col("amount").alias("last_amount"), F.coalesce("b0", "first_block").alias("b0"), F.col("first_block").alias("b1"), F.col("to_type").alias("terminal"),
            (F.col("known") + (F.col("to_entity") != "").cast("int")).alias("known"), (F.col("noise") + pick(F.col("to_type"), PATH_NOISE)).alias("noise"),
        )
        front = materialize(grown, "paths")
        out = front if out is None else out.unionByName(front)
    score = path_score(goal, F.col("hops"), F.col("total"), F.col("terminal"), F.col("b0"), F.col("b1"), F.col("known"), F.col("noise"))
    scored = out.select("hops", F.array_join("nodes", ">").alias("path"), "tokens", F.col("source").alias("source"), F.col("tail").alias("destination"), "last_amount", "total", path_kind(F.col("hops"), F.col("terminal")).alias("path_type"), "terminal", score.alias("score"))
    return scored.orderBy(F.desc("score"), "path", "tokens").limit(limit)


def cashouts(paths: DataFrame) -> DataFrame:
    """Where paths reach a service that pays out: the last hop, its amount and the path's first token."""
    return paths.filter(F.col("path_type").endswith("CASHOUT")).select("source", "destination", "path_type", F.split("tokens", ">")[0].alias("token"), F.col("last_amount").alias("amount"), "score")


def flow_stats(transfers: DataFrame, as_of: Column) -> DataFrame:
    """Per node: what came in and went out, transfers of the last 30 days, first and last time, and the share of the largest source and target.

    Two aggregations (pairs first), no window, so a busy node is partial sums everywhere."""
    side = F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(False).alias("inward")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(True).alias("inward"))))
    recent = F.count_if((F.col("t") > as_of - F.expr("INTERVAL 30 DAY")) & (F.col("t") <= as_of))
    pairs = transfers.filter("src <> dst").select(side, "amount", "t").groupBy("node", "other", "inward").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.count(F.lit(1)).alias("n"), recent.alias("recent"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    z = lambda c, f=F.sum: F.coalesce(f(c), F.lit(0)).cast("decimal(38,2)")
    came, went = F.when(F.col("inward"), F.col("amount")), F.when(~F.col("inward"), F.col("amount"))
    share = lambda top, total: F.coalesce(F.round(F.try_divide(top.cast("double"), F.nullif(total, F.lit(0)).cast("double")), 6), F.lit(0.0))
    g = pairs.groupBy("node").agg(z(came).alias("total_in"), z(went).alias("total_out"), z(came, F.max).alias("m_in"), z(went, F.max).alias("m_out"), F.sum("n").alias("txs"), F.countDistinct("other").alias("counterparties"), F.sum("recent").alias("recent_30d"), F.min("t0").alias("first_t"), F.max("t1").alias("last_t"))
    return g.select("node", "total_in", "total_out", "txs", "counterparties", "recent_30d", "first_t", "last_t", share(F.col("m_in"), F.col("total_in")).alias("top1_source"), share(F.col("m_out"), F.col("total_out")).alias("top1_target"))


def _days(first: str, last: str) -> Column:
    return (F.unix_micros(F.col(last).cast("timestamp")) - F.unix_micros(F.col(first).cast("timestamp"))) / 86_400_000_000


def settlements(stats: DataFrame, entities: DataFrame, least: float = 0.5) -> DataFrame:
    """Nodes where funds come to rest: retained share, time held, few outflows, inactivity, no main target, known entity; a score of ``least`` or more."""
    s = skew_safe_lookup(stats, entities.select("node", "entity_type"), ["node"], ["entity_type"])
    i, o = F.col("total_in").cast("double"), F.col("total_out").cast("double")
    kept = F.when(i > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (i - o) / i))).otherwise(0.0)
    top = F.col("top1_target")
    score = F.round(
        0.3 * kept + 0.2 * F.least(F.lit(3650.0), _days("first_t", "last_t")) / 3650 + 0.15 * F.when(top < 0.2, 0.8).when(top < 0.5, 0.4).otherwise(0.1) + 0.15 * F.when(F.col("recent_30d") == 0, 1.0).when(F.col("recent_30d") < 3, 0.6).otherwise(0.0)
        + 0.1 * F.when(top < 0.2, 0.8).otherwise(0.0) + 0.1 * F.when(F.coalesce("entity_type", F.lit("")) != "", 0.5).otherwise(0.0), 3)
    out = s.select("node", (F.col("total_in") - F.col("total_out")).cast("decimal(38,2)").alias("retained"), score.alias("score"))
    return out.filter(F.col("score") >= least).withColumn("kind", F.when(F.col("score") >= 0.65, "DORMANT_WALLET").otherwise("CUSTODIAL_SETTLEMENT"))


def conservation(stats: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """How far what went out of a node is from what came in, as a share of what came in; 0 for a node that got nothing."""
    i, o = F.col("total_in").cast("double"), F.col("total_out").cast("double")
    gap = F.round(F.coalesce(F.try_divide(F.abs(i - o), F.nullif(i, F.lit(0.0))), F.lit(0.0)), 3)
    return stats.select("node", "total_in", "total_out", gap.alias("deviation"), (gap < tolerance).alias("passed"))


def profit(stats: DataFrame) -> DataFrame:
    """Three readings of a node's profit: L0 what came in; L1 in minus out; L2 also minus a cost basis, 0.7 of what its largest source gave."""
    basis = (F.col("total_in").cast("decimal(20,2)") * F.floor(F.col("top1_source") * 1000).cast("decimal(4,0)") * F.lit("0.0007").cast("decimal(5,4)")).cast("decimal(38,2)")
    net = (F.col("total_in") - F.col("total_out")).cast("decimal(38,2)")
    row = lambda level, cost, value, sure: F.struct(F.lit(level).alias("level"), cost.alias("cost_basis"), value.cast("decimal(38,2)").alias("net_profit"), F.lit(sure).alias("confidence"))
    none = F.lit(None).cast("decimal(38,2)")
    rows = stats.select("node", F.col("top1_source"), F.inline(F.array(row("L0", none, F.col("total_in"), 0.5), row("L1", none, net, 0.6), row("L2", basis, net - basis, 0.4))))
    return rows.filter((F.col("level") != "L2") | (F.col("top1_source") > 0)).drop("top1_source")


def rank_score(total: Column, gaps: Column, edges: Column, known: Column, penalty: Column, any_entities: bool = True) -> Column:
    """0 to 100 from amount (log scale), continuity in time, risk and relation, less a penalty for large services on the way."""
    amount = F.when(total > 0, F.least(F.log10(total) * 10, F.lit(100.0))).otherwise(0.0)
    average = gaps / F.greatest(edges - 1, F.lit(1))
    steady = F.when(edges < 2, 50.0).when(average <= 3600, 90.0).when(average <= 86400, 70.0).when(average <= 604800, 40.0).otherwise(10.0)
    nodes = edges + 1
    risk = F.when(known > 0, 50.0).otherwise(30.0) if any_entities else F.when(nodes >= 4, 70.0).otherwise(nodes * 15.0)
    relation = F.least(edges * 20.0, F.lit(100.0))
    cost = F.least(penalty / nodes * 20, F.lit(20.0)) if any_entities else F.lit(0.0)
    return F.round(F.greatest(F.lit(0.0), (amount * 40 + steady * 20 + risk * 20 + relation * 20) / 100 * (1 - cost / 100)), 2)


def beam_trace(typed: DataFrame, root: str, hops: int = 4, beam: int = 20, direction: str = "out") -> DataFrame:
    """Paths from ``root`` along (``out``) or against (``in``) the edges that never revisit a node; after each hop the ``beam`` paths
    with the highest rank go on. Every kept path is a row. At most 8 hops."""
    if not 1 <= hops <= 8 or beam < 1 or direction not in ("out", "in"):
        raise ValueError("hops, beam or direction out of range")
    here, there = ("src", "dst") if direction == "out" else ("dst", "src")
    kind = F.col("to_type" if direction == "out" else "from_type")
    typed = materialize(typed.filter(F.col("src") != F.col("dst")).select("src", "dst", "token", "amount", "first_t", "from_type", "to_type"), "typed")
    steps = typed.select(F.col(here).alias("here"), F.col(there).alias("there"), "token", F.col("amount").cast("double").alias("amount"), F.unix_seconds(F.col("first_t").cast("timestamp")).alias("t"), kind.alias("kind"))
    # The root's own type counts as well.
    own = typed.filter(F.col(here) == root).agg(F.max("from_type" if direction == "out" else "to_type")).first()[0] or ""
    front, out = typed.sparkSession.createDataFrame([(0, root, [root], "", 0.0, 0, None, int(own != ""), float(BEAM_PENALTY.get(own, 0.0)))], "hop int, tail string, nodes array<string>, tokens string, total double, gaps bigint, last bigint, known int, penalty double"), None
    for k in range(1, hops + 1):
        grown = front.join(steps, F.col("tail") == F.col("here")).filter(~F.array_contains("nodes", F.col("there"))).select(
            F.lit(k).alias("hop"), F.col("there").alias("tail"), F.concat("nodes", F.array("there")).alias("nodes"), F.when(F.col("tokens") == "", F.col("token")).otherwise(F.concat_ws(">", "tokens", "token")).alias("tokens"),
            (F.col("total") + F.col("amount")).alias("total"), (F.col("gaps") + F.coalesce(F.abs(F.col("t") - F.col("last")), F.lit(0))).alias("gaps"), F.col("t").alias("last"), (F.col("known") + (F.col("kind") != "").cast("int")).alias("known"), (F.col("penalty") + pick(F.col("kind"), BEAM_PENALTY)).alias("penalty"),
        )
        score = rank_score(F.col("total"), F.col("gaps"), F.col("hop"), F.col("known"), F.col("penalty"))
        front = materialize(grown.withColumn("score", score).orderBy(F.desc("score"), F.array_join("nodes", ">"), "tokens").limit(beam), "beam")
        out = front.drop("total") if out is None else out.unionByName(front.drop("total"))
        front = front.drop("score")
    return out.select(F.lit(direction).alias("direction"), "hop", F.array_join("nodes", ">").alias("path"), "tokens", "score")


def patterns(act: DataFrame) -> DataFrame:
    """Flags per chain and address: rapid (one payment of at least half of all receipts within an hour after the last receipt), split (3
    payments or more that make 60 % of the largest receipt), concentration (3 receipts or more, under 20 % paid on), large_inflow (5 receipts or
    more: the 90th percentile, null else) and drain (80 % paid on)."""
    by = ["chain_id", "address"]
    a, came, went = F.col("amount"), F.col("direction") == "IN", F.col("direction") == "OUT"
    live = act.filter(came | went).select(*by, "direction", "amount", "block_time")
    z = lambda c: F.coalesce(F.sum(F.when(c, a)), F.lit(0)).cast("decimal(38,18)")
    g = live.groupBy(*by).agg(z(came).alias("i"), z(went).alias("o"), F.count_if(came).alias("ins"), F.count_if(went).alias("outs"), F.max(F.when(came, a)).alias("largest"), F.max(F.when(came, F.col("block_time"))).alias("last_in"))
    pays = skew_safe_lookup(live.filter(went & F.col("block_time").isNotNull()), g, by, ["last_in"])
    age = F.unix_micros("block_time") - F.unix_micros("last_in")
    fast = pays.filter(age.between(0, 3_600_000_000)).groupBy(*by).agg(F.max("amount").alias("fast"))
    p90 = rank_pick(live.filter(came), by, "amount", F.floor((F.col("n") - 1) * 0.9) + 1, "p90")
    j = g.join(fast, by, "left").join(p90, by, "left")
    d = lambda c: F.col(c).cast("double")
    return j.select(
        *by, F.coalesce((d("i") > 0) & (d("fast") >= 0.5 * d("i")), F.lit(False)).alias("rapid"), F.coalesce((F.col("outs") >= 3) & (d("largest") > 0) & (d("o") >= 0.6 * d("largest")), F.lit(False)).alias("split"),
        ((F.col("ins") >= 3) & (d("i") > 0) & (d("o") < 0.2 * d("i"))).alias("concentration"), F.when((F.col("ins") >= 5) & (F.col("largest") > 0), F.col("p90")).alias("large_inflow"), ((d("i") > 0) & (d("o") >= 0.8 * d("i"))).alias("drain"),
    )


def dormancy_score(stats: DataFrame) -> DataFrame:
    """0.4 retained share, 0.3 inactivity, 0.2 few counterparties a transaction, 0.1 holding time of a day; and the candidates it makes:
    settlement (0.5 or more), deposit (largest target 60 % or more; exchange deposit 80 % and active), hot wallet (10 counterparties, active, no sweep)."""
    i, o = F.col("total_in").cast("double"), F.col("total_out").cast("double")
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    kept = F.when(i > 0, one((i - o) / i)).otherwise(0.0)
    still = F.when(F.col("recent_30d") == 0, 1.0).when(F.col("recent_30d") < 3, 0.6).otherwise(0.0)
    score = F.round(0.4 * kept + 0.3 * still + 0.2 * F.when(F.col("txs") > 0, 1 - one(F.col("counterparties") / F.col("txs"))).otherwise(0.0) + 0.1 * one(_days("first_t", "last_t")), 3)
    sweep = F.col("top1_target")
    s = stats.withColumn("dormancy", score)
    deposit = F.when((sweep >= 0.8) & (F.col("recent_30d") > 0), "exchange_deposit_candidate").when(sweep >= 0.6, "collector_settlement_candidate")
    return s.select("node", "dormancy", deposit.alias("deposit"), ((F.col("recent_30d") > 0) & (F.col("counterparties") >= 10) & (sweep < 0.6)).alias("hot_wallet"), (F.col("dormancy") >= 0.5).alias("settlement"))


#: Scores of amounts from a size on, weights of amount, risk, relation and activity, what an entity costs, and the score from which an address is fetched.
AMOUNT_STEPS = {1e3: 10, 1e5: 25, 1e6: 40, 1e7: 60, 1e8: 80, 1e9: 100}
EXPANSION_WEIGHTS, EXPANSION_PENALTY, EXPANSION_LEAST, EXPANSION_COST = (25, 25, 20, 15), {"EXCHANGE": 1.0, "BRIDGE": 0.7, "DEX": 0.7, "ROUTER": 0.5, "CONTRACT": 0.3}, 30, 15


def expansion(rows: DataFrame) -> DataFrame:
    """Rows (node, amount, risk 0..100, relation 0..1, txs, degree, entity_type) with score and decision (ACQUIRE, HOLD, IGNORE)."""
    x = F.col("amount").cast("double")
    amount = reduce(lambda acc, kv: F.when(x >= kv[0], F.lit(float(kv[1]))).otherwise(acc), AMOUNT_STEPS.items(), F.lit(0.0))
    activity = F.least(F.col("txs") / 1000, F.lit(1.0)) * 70 + F.least(F.col("degree") / 50, F.lit(1.0)) * 30
    a, r, l, t = EXPANSION_WEIGHTS
    raw = (amount * a + F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("risk"))) * r + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("relation"))) * 100 * l + activity * t) / (a + r + l + t)
    score = F.round(raw * (1 - pick(F.coalesce("entity_type", F.lit("")), EXPANSION_PENALTY) * EXPANSION_COST / 100), 2)
    s = rows.withColumn("score", score)
    return s.select("node", "score", F.when(F.col("score") >= EXPANSION_LEAST, "ACQUIRE").when(F.col("score") >= EXPANSION_LEAST / 2, "HOLD").otherwise("IGNORE").alias("decision"))


#: Weights of fund, behaviour, risk, entity, graph and identity by mode; none: their mean.
MODES = {"fund_trace": (0.4, 0.0, 0.1, 0.2, 0.3, 0.0), "risk_scan": (0.1, 0.0, 0.4, 0.2, 0.3, 0.0), "identity_lookup": (0.0, 0.0, 0.1, 0.3, 0.2, 0.4), "default": (1 / 6,) * 6}


def investigation(rows: DataFrame, mode: str = "default") -> DataFrame:
    """Six dimensions from 0 to 100 and their weighted total.

    Rows: node, balance_usd, profit, holding, txs, flow, risk, entities, known, labelled, exchanges, best_path, paths.
    """
    c = F.col
    cap = lambda x: F.least(F.lit(100.0), x)
    fund = cap(F.when(c("balance_usd") >= 10_000_000, 50).when(c("balance_usd") >= 1_000_000, 30).when(c("balance_usd") >= 100_000, 15).otherwise(0) + F.when(c("profit"), 30).otherwise(0) + F.when(c("holding"), 20).otherwise(0.0))
    behaviour = cap(F.least(F.lit(60.0), F.log10(c("txs") + 1.0) * 20) + F.least(F.lit(40.0), F.log10(c("flow").cast("double") + 1) * 8))
    share = lambda x: F.coalesce(F.try_divide(c(x).cast("double"), c("entities").cast("double")), F.lit(0.0))
    graph = cap(c("best_path") + F.least(F.lit(20.0), c("paths") * 2.0))
    identity = F.when(c("entities") > 0, cap(share("labelled") * 80 + F.least(F.lit(20.0), c("exchanges") * 5.0))).otherwise(0.0)
    parts = {"fund": fund, "behaviour": F.round(behaviour, 1), "risk": F.round(cap(F.greatest(c("risk"), F.lit(0.0))), 1), "entity": F.round(share("known") * 100, 1), "graph": F.round(graph, 1), "identity": F.round(identity, 1)}
    s = rows.select("node", *[x.cast("double").alias(n) for n, x in parts.items()])
    return s.withColumn("total", F.round(sum((w * c(n) for n, w in zip(parts, MODES[mode])), F.lit(0.0)), 1))
