"""Queries of whole sets of figures and of the fund-flow engine over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import activity_metrics as am
from tracewright.operators import address_analytics as aa
from tracewright.operators import fundflow as ff
from tracewright.operators import graph, scoring
from tracewright.operators.relational import rank_pick
from tracewright.plans.analytics import _DEC, _EDGES, _T, _as_of, _conc, _z
from tracewright.plans.neutral import neutral_times
from tracewright.plans.views import ACT, ENT, TRA, activity, entities, transfers
from tracewright.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_NAT, _TOK, _CRE = (f"coalesce(activity_type IN {_in(x)}, false)" for x in (am.NATIVE, am.TOKENS, am.CREATES))
_CEX, _DEX, _BRI = (f"coalesce(lower(counterparty_entity_type) IN {x}, false)" for x in ("('cex', 'exchange')", "('dex', 'decentralized_exchange')", "('bridge')"))
_WAY = {"in": "direction = 'IN'", "out": "direction = 'OUT'"}
_U = {w: _z("usd_value", c) for w, c in _WAY.items()}
_NETU = f"CAST({_U['in']} - {_U['out']} AS {_DEC}) AS net_usd"
_TOPU = ", ".join(f"CAST(coalesce(max(usd_value) FILTER ({c}), 0) AS {_DEC}) AS largest_{w}_usd" for w, c in _WAY.items())
_CPS = "count(DISTINCT counterparty_address) FILTER (counterparty_address <> '') AS counterparties"
_DAYS = "count(DISTINCT CAST(block_time AS DATE)) AS active_days"
_AMT = {w: _z("amount", c) for w, c in _WAY.items()}
_BYA = "GROUP BY chain_id, address"


@query("a7_all_time", f"""WITH {ACT} SELECT chain_id, address, min(block_time) AS first_t, max(block_time) AS last_t, count(*) AS events, count(DISTINCT tx_hash) AS txs, count(*) FILTER ({_CRE}) AS contracts, count(DISTINCT token_address) FILTER (token_address <> '') AS tokens,
count(*) FILTER (direction = 'IN') AS in_rows, count(*) FILTER (direction = 'OUT') AS out_rows, {_AMT['in']} AS total_in, {_AMT['out']} AS total_out, CAST({_AMT['in']} - {_AMT['out']} AS {_DEC}) AS net, {_DAYS}, {_CPS} FROM act {_BYA}""")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return am.all_time(activity(spark, d))


@query("a11_summary", f"""WITH {ACT} SELECT chain_id, address, count(DISTINCT tx_hash) AS txs, count(*) FILTER (direction = 'IN') AS in_rows, count(*) FILTER (direction = 'OUT') AS out_rows, count(*) FILTER ({_TOK}) AS token_rows, count(*) FILTER (activity_type = 'INTERNAL_TRANSFER') AS internal_rows, {_CPS},
min(block_time) AS first_t, max(block_time) AS last_t, {_DAYS}, {_U['in']} AS in_usd, {_U['out']} AS out_usd, {_NETU}, {_TOPU}, {_z('usd_value', f"direction = 'IN' AND {_CEX}")} AS cex_in_usd, {_z('usd_value', f"direction = 'OUT' AND {_CEX}")} AS cex_out_usd, {_z('usd_value', _DEX)} AS dex_usd, {_z('usd_value', _BRI)} AS bridge_usd,
count(*) FILTER ({_CRE}) AS contracts, count(usd_value) AS priced_rows, count(*) AS rows FROM act {_BYA}""")
def a11(spark: SparkSession, d: str) -> DataFrame:
    return am.summary(activity(spark, d))


_NATA = {w: _z("amount", f"{c} AND {_NAT}") for w, c in _WAY.items()}
_NATN = f"{_NATA['in']} AS native_in, {_NATA['out']} AS native_out, CAST({_NATA['in']} - {_NATA['out']} AS {_DEC}) AS native_net"
_NTX = "activity_type IN ('NATIVE_TRANSFER', 'CONTRACT_CALL')"


@query("a20_refresh_summary", f"""WITH {ACT} SELECT chain_id, address, min(block_time) AS first_t, max(block_time) AS last_t, count(DISTINCT tx_hash) FILTER ({_NTX}) AS txs, count(DISTINCT tx_hash) FILTER ({_NTX} AND direction = 'IN') AS in_txs, count(DISTINCT tx_hash) FILTER ({_NTX} AND direction = 'OUT') AS out_txs,
count(*) FILTER ({_TOK}) AS token_rows, count(*) FILTER (activity_type IN ('INTERNAL_TRANSFER', 'INTERNAL_TRANSACTION')) AS internal_rows, count(*) FILTER (activity_type IN ('ERC721_TRANSFER', 'ERC1155_TRANSFER')) AS nft_rows, count(*) FILTER ({_CRE} AND direction = 'OUT') AS contracts, {_CPS}, {_NATN},
{_U['in']} AS in_usd, {_U['out']} AS out_usd, {_NETU}, {_DAYS}, {_TOPU}, max_by(counterparty_address, (coalesce(block_time, TIMESTAMPTZ '0001-01-01 00:00:00+00'), activity_id)) AS last_counterparty FROM act {_BYA}""")
def a20s(spark: SparkSession, d: str) -> DataFrame:
    return am.refresh_summary(activity(spark, d))


@query("a20_refresh_counterparties", f"WITH {ACT} SELECT chain_id, address, counterparty_address, direction, count(*) AS rows, count(DISTINCT tx_hash) AS txs, {_z('amount', _NAT)} AS native_amount, {_z('usd_value')} AS usd_value, min(block_time) AS first_t, max(block_time) AS last_t FROM act WHERE counterparty_address <> '' GROUP BY chain_id, address, counterparty_address, direction")
def a20c(spark: SparkSession, d: str) -> DataFrame:
    return am.refresh_counterparties(activity(spark, d))


@query("a20_refresh_daily", f"WITH {ACT} SELECT chain_id, address, CAST(block_time AS DATE) AS day, count(*) FILTER (direction = 'IN') AS in_rows, count(*) FILTER (direction = 'OUT') AS out_rows, {_NATN}, {_U['in']} AS in_usd, {_U['out']} AS out_usd, {_NETU}, {_CPS} FROM act WHERE block_time IS NOT NULL GROUP BY chain_id, address, day")
def a20d(spark: SparkSession, d: str) -> DataFrame:
    return am.refresh_daily(activity(spark, d))


_RECENT = ", ".join(f"count(*) FILTER (block_time > {_T} - INTERVAL {h} HOUR AND block_time <= {_T}) AS {n}" for h, n in ((24, "last_day"), (168, "last_week"), (720, "last_month")))


@query("a6_address_statistics", f"""WITH {ACT}, {_conc()}, b AS (SELECT chain_id, address, count(DISTINCT tx_hash) AS txs, count(DISTINCT counterparty_address) FILTER (direction = 'IN' AND counterparty_address <> '') AS upstream, count(DISTINCT counterparty_address) FILTER (direction = 'OUT' AND counterparty_address <> '') AS downstream, {_DAYS}, {_RECENT},
{_AMT['in']} AS total_in, {_AMT['out']} AS total_out, round(avg(CAST(amount AS DOUBLE)) FILTER (direction = 'IN'), 9) AS average_in, max(amount) AS largest FROM act {_BYA}), t AS (SELECT chain_id, address, token_address, {_z('amount')} AS a FROM act WHERE direction = 'IN' AND token_address <> '' GROUP BY ALL),
m AS (SELECT chain_id, address, token_address AS dominant_token FROM t QUALIFY row_number() OVER (PARTITION BY chain_id, address ORDER BY a DESC, token_address) = 1)
SELECT b.*, dominant_token, top1_in_share, top5_in_share, top1_out_share, top5_out_share FROM b LEFT JOIN m USING (chain_id, address) LEFT JOIN conc USING (chain_id, address)""")
def a6(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return am.address_statistics(a, _as_of(), aa.concentration(a))


@query("a5_flow_statistics", f"""WITH {ACT}, e AS (SELECT chain_id, address, counterparty_address, token_address, count(*) AS n FROM act WHERE direction = 'OUT' AND counterparty_address <> '' GROUP BY ALL),
x AS (SELECT chain_id, node, sum(n) AS n FROM (SELECT chain_id, address AS node, n FROM e UNION ALL SELECT chain_id, counterparty_address, n FROM e) GROUP BY ALL), y AS (SELECT chain_id, count(*) AS nodes, count(*) FILTER (n >= 100) AS risk_nodes FROM x GROUP BY 1), z AS (SELECT chain_id, count(*) AS edges, CAST(sum(n) AS BIGINT) AS transfers FROM e GROUP BY 1),
s AS (SELECT chain_id, count(DISTINCT tx_hash) AS txs, {_AMT['in']} AS total_in, {_AMT['out']} AS total_out, CAST({_AMT['in']} - {_AMT['out']} AS {_DEC}) AS net, count(DISTINCT counterparty_address) FILTER (activity_type IN ('CONTRACT_CALL', 'SWAP', 'APPROVE')) AS contracts FROM act GROUP BY 1)
SELECT *, false AS truncated FROM s JOIN z USING (chain_id) JOIN y USING (chain_id)""")
def a5(spark: SparkSession, d: str) -> DataFrame:
    return am.flow_statistics(activity(spark, d))


_LABELS = "lab AS (SELECT lower(trim(contract_address)) AS address, max((coalesce(is_verified, false), updated_at, name))[3] AS label, max(coalesce(is_verified, false)) AS verified FROM token_metadata_registry WHERE name <> '' GROUP BY 1)"


@query("a18_entity_statistics", f"""WITH {ACT}, {_LABELS} SELECT upper(counterparty_entity_type) AS entity_type, coalesce(nullif(lab.label, ''), nullif(counterparty_label, ''), 'unknown') AS label, count(*) AS rows, count(DISTINCT act.address) AS addresses, {_AMT['in']} AS withdrawn, {_AMT['out']} AS deposited, count(*) FILTER (coalesce(lab.verified, false)) AS sure_rows
FROM act LEFT JOIN lab ON lab.address = act.counterparty_address WHERE counterparty_entity_type <> '' GROUP BY ALL""")
def a18(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "token_metadata_registry").filter("name <> ''")
    sure = F.coalesce("is_verified", F.lit(False))
    labels = reg.groupBy(F.lower(F.trim("contract_address")).alias("address")).agg(F.max(F.struct(sure, "updated_at", "name"))["name"].alias("label"), F.max(sure).alias("verified"))
    return am.entity_flows(activity(spark, d), labels)


@query("a19_dex_statistics", f"""WITH {ACT}, s AS (SELECT chain_id, tx_hash, counterparty_address, address, token_address, max(usd_value) AS usd, max(counterparty_label) AS protocol FROM act WHERE activity_type IN ('SWAP', 'DEX_SWAP') GROUP BY ALL), n AS (SELECT chain_id, protocol, count(*) AS n, sum(usd) AS usd FROM s GROUP BY ALL)
SELECT chain_id, CAST(sum(n) AS BIGINT) AS swaps, CAST(sum(usd) AS {_DEC}) AS volume_usd, coalesce(arg_min(protocol, (-n, protocol)) FILTER (protocol <> ''), '') AS top_protocol FROM n GROUP BY chain_id""")
def a19d(spark: SparkSession, d: str) -> DataFrame:
    return am.dex_statistics(activity(spark, d))


@query("a19_bridge_statistics", f"""WITH {ACT}, s AS (SELECT chain_id, tx_hash, direction, counterparty_address, max(usd_value) AS usd, max(counterparty_label) AS bridge FROM act WHERE {_BRI} AND direction IN ('IN', 'OUT') GROUP BY ALL),
n AS (SELECT chain_id, bridge, count(*) FILTER (direction = 'IN') AS i, count(*) FILTER (direction = 'OUT') AS o, sum(usd) FILTER (direction = 'IN') AS iu, sum(usd) FILTER (direction = 'OUT') AS ou FROM s GROUP BY ALL)
SELECT chain_id, CAST(sum(i) AS BIGINT) AS in_rows, CAST(sum(o) AS BIGINT) AS out_rows, CAST(sum(iu) AS {_DEC}) AS in_usd, CAST(sum(ou) AS {_DEC}) AS out_usd, coalesce(arg_min(bridge, (-(i + o), bridge)) FILTER (bridge <> ''), '') AS top_bridge FROM n GROUP BY chain_id""")
def a19b(spark: SparkSession, d: str) -> DataFrame:
    return am.bridge_statistics(activity(spark, d))


_SU = lambda c: f"CAST(sum(usd_value) FILTER ({c}) AS {_DEC})"
_STB = f"coalesce(upper(trim(token_symbol)) IN {_in(aa.STABLE)}, false)"


@query("a17_financial_summary", f"""WITH {ACT}, n AS (SELECT chain_id, address, usd_value, row_number() OVER (PARTITION BY chain_id, address ORDER BY usd_value) AS r, count(*) OVER (PARTITION BY chain_id, address) AS n FROM act WHERE usd_value IS NOT NULL), med AS (SELECT chain_id, address, usd_value AS median_usd FROM n WHERE r = floor(n * 0.5) + 1),
b AS (SELECT chain_id, address, {_SU("direction = 'IN'")} AS in_usd, {_SU("direction = 'OUT'")} AS out_usd, CASE WHEN count(usd_value) > 0 THEN CAST({_U['in']} - {_U['out']} AS {_DEC}) END AS net_usd, {_SU("token_address = ''")} AS native_usd, {_SU(_STB)} AS stable_usd, {_SU(f"token_address <> '' AND NOT {_STB}")} AS token_usd, max(usd_value) AS largest_usd,
round(avg(CAST(usd_value AS DOUBLE)), 9) AS average_usd, count(*) FILTER (usd_value >= 1000 AND direction = 'IN') AS large_in, count(*) FILTER (usd_value >= 1000 AND direction = 'OUT') AS large_out, round(count(usd_value) / count(*), 6) AS coverage FROM act {_BYA}) SELECT b.*, median_usd FROM b LEFT JOIN med USING (chain_id, address)""")
def a17(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return am.financial_summary(a, rank_pick(a, am.BY, "usd_value", F.floor(F.col("n") * 0.5) + 1, "median_usd"), aa.STABLE)


_MOVED = f"count(*) FILTER (activity_type IN {_in((*am.TOKENS, 'NATIVE_TRANSFER'))})"


@query("a3_dashboard", f"""WITH {ACT}, p AS (SELECT a, sum(n) AS n FROM (SELECT address AS a, 1 AS n FROM act UNION ALL SELECT counterparty_address, 0 FROM act) WHERE a <> '' GROUP BY a) SELECT count(*) AS rows, {_MOVED} AS transfers, (SELECT count(*) FROM (SELECT DISTINCT chain_id, token_address FROM act)) AS tokens, (SELECT count(*) FROM p) AS addresses, (SELECT count(*) FROM p WHERE n >= 100) AS risk_addresses FROM act""")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return am.dashboard(activity(spark, d))[0]


@query("a3_block_trend", f"WITH {ACT} SELECT chain_id, CAST(floor(block_number / 1000) * 1000 AS BIGINT) AS from_block, count(*) AS rows, {_MOVED} AS transfers FROM act WHERE block_number IS NOT NULL GROUP BY ALL")
def a3t(spark: SparkSession, d: str) -> DataFrame:
    return am.dashboard(activity(spark, d))[1]


_PS = "upper(coalesce(price_source, ''))"
_FULL = "usd_value IS NOT NULL AND price_usd IS NOT NULL AND price_time IS NOT NULL"
_LIVE = f"({_FULL} AND {_PS} NOT IN ('', 'CURRENT'))"
_FB = f"{_PS} IN ('PEG_FALLBACK', 'FALLBACK')"
_SWAP, _BRT = "coalesce(activity_type IN ('SWAP', 'DEX_SWAP'), false)", "coalesce(activity_type IN ('BRIDGE_DEPOSIT', 'BRIDGE_WITHDRAW', 'BRIDGE_SEND', 'BRIDGE_RECEIVE'), false)"


@query("a38_financial_report", f"""WITH {ACT}, g AS (SELECT chain_id, count(*) FILTER ({_TOK}) AS required, count(*) FILTER ({_TOK} AND {_LIVE}) AS priced, count(*) FILTER ({_TOK} AND {_LIVE} AND NOT {_FB}) AS historical, count(*) FILTER ({_TOK} AND {_LIVE} AND {_FB}) AS fallback, count(*) FILTER ({_TOK} AND NOT {_LIVE}) AS missing,
count(*) FILTER (direction = 'IN') AS position_events, count(*) FILTER (direction = 'IN' AND usd_value IS NOT NULL) AS known_cost, count(*) FILTER ({_SWAP} OR coalesce(lower(counterparty_entity_type) IN ('dex', 'dex_router', 'router'), false)) AS swap_candidates, count(*) FILTER ({_SWAP}) AS swaps, count(*) FILTER ({_BRT} OR {_BRI}) AS bridge_candidates, count(*) FILTER ({_BRT}) AS bridges,
{_CPS}, count(DISTINCT counterparty_address) FILTER (counterparty_address <> '' AND counterparty_entity_type <> '') AS known_counterparties, max(ingested_at) AS last_updated FROM act GROUP BY chain_id)
SELECT *, priced <= required AND historical + fallback = priced AND priced + missing = required AND swaps <= swap_candidates AND bridges <= bridge_candidates AND known_counterparties <= counterparties AS consistent FROM g""")
def a38(spark: SparkSession, d: str) -> DataFrame:
    return am.quality_counters(activity(spark, d))


@query("a39_chunk_addresses", "SELECT address, count(*) AS transfers FROM (SELECT address FROM address_activity UNION ALL SELECT counterparty_address FROM address_activity WHERE counterparty_address IS DISTINCT FROM address) WHERE regexp_full_match(address, '0x[0-9a-f]{40}') GROUP BY 1")
def a39c(spark: SparkSession, d: str) -> DataFrame:
    return am.chunk_addresses(table(spark, d, "address_activity").select(F.col("address").alias("from_address"), F.col("counterparty_address").alias("to_address")))


@query("a45_periods", f"WITH {ACT} " + " UNION ALL ".join(f"SELECT '{u}' AS period, CAST(date_trunc('{u}', block_time) AS DATE) AS start, count(*) AS rows, count(DISTINCT address) AS addresses, {_z('amount')} AS amount FROM act WHERE block_time IS NOT NULL GROUP BY 2" for u in ("day", "week", "month")))
def a45p(spark: SparkSession, d: str) -> DataFrame:
    return am.periods(activity(spark, d))


@query("a45_top_interactions", f"WITH {ACT} SELECT chain_id, address, counterparty_address, count(*) AS rows, {_z('amount')} AS amount, row_number() OVER (PARTITION BY chain_id ORDER BY count(*) DESC, {_z('amount')} DESC, address, counterparty_address) AS rank FROM act WHERE counterparty_address <> '' GROUP BY chain_id, address, counterparty_address QUALIFY rank <= 20")
def a45t(spark: SparkSession, d: str) -> DataFrame:
    return am.top_interactions(activity(spark, d))


_BASIS = """got AS (SELECT dst, count(*) AS n FROM tra GROUP BY 1), prs AS (SELECT DISTINCT src, dst FROM tra), mst AS (SELECT src, count(*) AS n FROM prs GROUP BY 1 ORDER BY n DESC, src LIMIT 5),
jac AS (SELECT a.src AS x, b.src AS y, (SELECT count(*) FROM prs p JOIN prs q ON p.dst = q.dst WHERE p.src = a.src AND q.src = b.src) AS k, a.n AS nx, b.n AS ny FROM mst a JOIN mst b ON a.src < b.src),
bas AS (SELECT round((SELECT sum(n) FROM (SELECT n FROM got ORDER BY n DESC, dst LIMIT 10)) / (SELECT sum(n) FROM got), 6) AS top10_share, round(coalesce((SELECT avg(k / (nx + ny - k)) FROM jac), 0), 6) AS jaccard)"""


@query("a42_receiver_basis", f"WITH {TRA}, {_BASIS} SELECT * FROM bas")
def a42(spark: SparkSession, d: str) -> DataFrame:
    return am.risk_basis(transfers(spark, d))


@query("r1_lake_risk", f"""WITH {TRA}, {_BASIS}, n AS (SELECT node, count(*) AS events FROM (SELECT src AS node FROM tra UNION ALL SELECT dst FROM tra WHERE src <> dst) GROUP BY 1), s AS (SELECT node, round(least(100 * (0.6 * least(events / 100, 1) + 0.4 * top10_share) + 10 * jaccard, 100), 4) AS score FROM n, bas)
SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM s""")
def r1(spark: SparkSession, d: str) -> DataFrame:
    t = transfers(spark, d)
    basis = am.risk_basis(t)
    n = t.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("events"))
    s = scoring.lake_risk(F.col("events"), basis.select("top10_share").scalar(), basis.select("jaccard").scalar())
    return n.select("node", s.alias("score")).withColumn("level", scoring.level(F.col("score"), 60, 30))


@query("r3_profile_risk", f"""WITH {ACT}, {_conc()}, p AS (SELECT chain_id, address, coalesce(count(DISTINCT tx_hash) / nullif(count(DISTINCT CAST(block_time AS DATE)), 0), 0) AS f FROM act {_BYA}), s AS (SELECT chain_id, address, round(f, 2) AS frequency, round(least(100, 100 * (0.6 * least(f / 100, 1) + 0.4 * greatest(coalesce(top1_in_share, 0), coalesce(top1_out_share, 0)))), 2) AS score FROM p LEFT JOIN conc USING (chain_id, address))
SELECT *, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' ELSE 'low' END AS level FROM s""")
def r3(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return am.profile_risk(am.all_time(a), aa.concentration(a))


@query("r12_cross_chain", f"""WITH {ACT} SELECT upper(coalesce(counterparty_entity_type, '')) AS entity_type, lower(trim(counterparty_label)) AS label, array_to_string(list_sort(list(DISTINCT CAST(chain_id AS VARCHAR))), '|') AS chains, count(DISTINCT counterparty_address) AS addresses, count(*) AS rows, min(block_time) AS first_t, max(block_time) AS last_t
FROM act WHERE counterparty_label <> '' AND counterparty_address <> '' GROUP BY ALL""")
def r12(spark: SparkSession, d: str) -> DataFrame:
    return am.cross_chain(activity(spark, d))


@query("r4_patterns", f"""WITH {ACT}, g AS (SELECT chain_id, address, {_AMT['in']} AS i, {_AMT['out']} AS o, count(*) FILTER (direction = 'IN') AS ins, count(*) FILTER (direction = 'OUT') AS outs, max(amount) FILTER (direction = 'IN') AS largest, max(block_time) FILTER (direction = 'IN') AS last_in FROM act WHERE direction IN ('IN', 'OUT') {_BYA}),
f AS (SELECT chain_id, address, max(amount) AS fast FROM act JOIN g USING (chain_id, address) WHERE direction = 'OUT' AND epoch_us(block_time) - epoch_us(last_in) BETWEEN 0 AND 3600000000 {_BYA}), n AS (SELECT chain_id, address, amount, row_number() OVER (PARTITION BY chain_id, address ORDER BY amount) AS r, count(*) OVER (PARTITION BY chain_id, address) AS n FROM act WHERE direction = 'IN' AND amount IS NOT NULL),
p AS (SELECT chain_id, address, amount AS p90 FROM n WHERE r = floor((n - 1) * 0.9::DOUBLE) + 1) SELECT chain_id, address, coalesce(i > 0 AND CAST(fast AS DOUBLE) >= 0.5 * CAST(i AS DOUBLE), false) AS rapid, coalesce(outs >= 3 AND largest > 0 AND CAST(o AS DOUBLE) >= 0.6 * CAST(largest AS DOUBLE), false) AS split,
ins >= 3 AND i > 0 AND CAST(o AS DOUBLE) < 0.2 * CAST(i AS DOUBLE) AS concentration, CASE WHEN ins >= 5 AND largest > 0 THEN p90 END AS large_inflow, i > 0 AND CAST(o AS DOUBLE) >= 0.8 * CAST(i AS DOUBLE) AS drain FROM g LEFT JOIN f USING (chain_id, address) LEFT JOIN p USING (chain_id, address)""")
def r4(spark: SparkSession, d: str) -> DataFrame:
    return ff.patterns(activity(spark, d))


# Fund flow over the transfers and the known entities among their parties.

_E = f"{_EDGES}, eb AS (SELECT src, dst, token, min(block) AS first_block FROM tra GROUP BY ALL), {ENT}"
_TYPED = f"""{_E}, ty AS (SELECT e.*, first_block, coalesce(f.entity_type, '') AS from_type, coalesce(f.entity_id, '') AS from_entity, coalesce(t.entity_type, '') AS to_type, coalesce(t.entity_id, '') AS to_entity FROM e JOIN eb USING (src, dst, token) LEFT JOIN ent f ON f.node = e.src LEFT JOIN ent t ON t.node = e.dst),
typ AS (SELECT *, CASE WHEN from_entity <> '' AND from_entity = to_entity THEN 'INTERNAL' WHEN to_type IN {_in(ff.DEPOSIT)} THEN 'DEPOSIT' WHEN to_type = 'BRIDGE' THEN 'BRIDGE_OUT' WHEN to_type IN {_in(ff.SWAPS)} THEN 'SWAP_OUT' WHEN from_type = 'BRIDGE' THEN 'BRIDGE_IN' WHEN from_type IN {_in(ff.SWAPS)} THEN 'SWAP_IN' ELSE 'TRANSFER' END AS kind FROM ty)"""


def typed(spark: SparkSession, d: str) -> DataFrame:
    t = transfers(spark, d)
    e = t.groupBy("src", "dst", "token").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min("block").alias("first_block"))
    return ff.typed_edges(e, entities(spark, d))


@query("g8_typed_edges", f"WITH {_TYPED} SELECT src, dst, token, amount, n, from_type, to_type, kind FROM typ")
def g8(spark: SparkSession, d: str) -> DataFrame:
    return typed(spark, d).select("src", "dst", "token", "amount", "n", "from_type", "to_type", "kind")


@query("g8_entity_graph", f"""WITH {_TYPED}, o AS (SELECT * FROM typ WHERE src <> dst), n1 AS (SELECT DISTINCT dst AS node FROM o WHERE src = 'A5' AND dst <> 'A5'), lv AS (SELECT 'A5' AS node, 0 AS level UNION ALL SELECT node, 1 FROM n1), c1 AS (SELECT count(*) AS c FROM lv),
n2 AS (SELECT DISTINCT dst AS node FROM o WHERE src IN (SELECT node FROM n1) AND dst NOT IN (SELECT node FROM lv)), l2 AS (SELECT * FROM lv UNION ALL SELECT node, 2 FROM n2 WHERE (SELECT c FROM c1) < 500) SELECT src, dst, token, amount, kind, level FROM o JOIN l2 ON node = src WHERE level < 2 AND (level = 0 OR (SELECT c FROM c1) < 500)""")
def g8g(spark: SparkSession, d: str) -> DataFrame:
    return ff.entity_graph(typed(spark, d), "A5", depth=2).select("src", "dst", "token", "amount", "kind", "level")


def _case(column: str, values: dict[str, float]) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0.0 END"


def _paths(depth: int, goal: str = "cashout", top_k: int = 10) -> str:
    """Tables h1..h``depth`` of paths from A5 and pth, all of them with their score."""
    w = ff.GOALS[goal]
    steps = f"stp AS (SELECT src, dst, token, CAST(amount AS DOUBLE) AS amount, first_block, to_type, to_entity FROM typ WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY typ.amount DESC, dst, token) <= {top_k})"
    hops = ["h0 AS (SELECT 'A5' AS path, 'A5' AS tail, '' AS source, '' AS tokens, 0.0::DOUBLE AS total, 0.0::DOUBLE AS last_amount, NULL::BIGINT AS b0, NULL::BIGINT AS b1, '' AS terminal, 0 AS known, 0.0::DOUBLE AS noise)"]
    for k in range(1, depth + 1):
        hops.append(
            f"h{k} AS (SELECT path || '>' || dst AS path, dst AS tail, tail AS source, CASE WHEN tokens = '' THEN token ELSE tokens || '>' || token END AS tokens, total + amount AS total, amount AS last_amount, coalesce(b0, first_block) AS b0, first_block AS b1, to_type AS terminal, "
            f"known + CASE WHEN to_entity <> '' THEN 1 ELSE 0 END AS known, noise + CAST({_case('to_type', ff.PATH_NOISE)} AS DOUBLE) AS noise FROM h{k - 1} JOIN stp ON stp.src = tail WHERE NOT contains('>' || path || '>', '>' || dst || '>'))"
        )
    alls = " UNION ALL ".join(f"SELECT {k} AS hops, * FROM h{k}" for k in range(1, depth + 1))
    kind = f"CASE WHEN terminal IN {_in(ff.CASHOUT)} THEN CASE WHEN hops = 1 THEN 'DIRECT_CASHOUT' ELSE 'MULTI_HOP_CASHOUT' END WHEN terminal = 'BRIDGE' THEN 'BRIDGE_EXIT' WHEN terminal = 'UNKNOWN_SERVICE' THEN 'COLLECT_AND_SETTLE' ELSE 'UNKNOWN' END"
    score = f"""round(greatest(0, least(1, {w[0]} * CASE WHEN total > 0 THEN 1 - 1 / (1 + log10(total + 1)) ELSE 0 END + {w[1]} * CASE WHEN terminal IN ('EXCHANGE', 'CEX_DEPOSIT', 'PAYMENT_SERVICE') THEN 0.9 WHEN path_type LIKE '%CASHOUT' THEN 0.8 ELSE 0.3 END
+ {w[2]} * CASE WHEN terminal IN ('DORMANT_WALLET', 'COLD_STORAGE', 'TREASURY', 'SETTLEMENT') THEN 0.9 WHEN terminal = 'UNKNOWN_SERVICE' THEN 0.6 ELSE 0.2 END + {w[3]} * CASE WHEN terminal IN ('EXCHANGE', 'CEX_DEPOSIT', 'CEX_HOT_WALLET') THEN 0.9 ELSE 0.3 END
+ 0.1 * CASE WHEN hops <= 1 OR b1 - b0 <= 0 THEN 0.5 WHEN b1 - b0 < 1000 THEN 0.95 WHEN b1 - b0 < 10000 THEN 0.8 WHEN b1 - b0 < 100000 THEN 0.5 ELSE 0.2 END + 0.1 * least(0.9, 0.6 + 0.05 * known) + 0.0025 - least(0.3, noise)))::DOUBLE, 3)"""
    return f"{steps}, {', '.join(hops)}, pa AS (SELECT *, {kind} AS path_type FROM ({alls})), pth AS (SELECT *, {score} AS score FROM pa)"


_PATHS = f"WITH {_TYPED}, {_paths(3)}, bst AS (SELECT hops, path, tokens, source, tail AS destination, last_amount, total, path_type, terminal, score FROM pth ORDER BY score DESC, path, tokens LIMIT 50)"


@query("g9_scored_paths", f"{_PATHS} SELECT * FROM bst")
def g9(spark: SparkSession, d: str) -> DataFrame:
    return ff.find_paths(typed(spark, d), "A5", max_depth=3)


@query("g11_cashouts", f"{_PATHS} SELECT source, destination, path_type, split_part(tokens, '>', 1) AS token, last_amount AS amount, score FROM bst WHERE path_type LIKE '%CASHOUT'")
def g11c(spark: SparkSession, d: str) -> DataFrame:
    return ff.cashouts(ff.find_paths(typed(spark, d), "A5", max_depth=3))


def _beam(hops: int, beam: int, way: str) -> str:
    here, there, kind, own = ("src", "dst", "to_type", "from_type") if way == "out" else ("dst", "src", "from_type", "to_type")
    pen = _case("kind", ff.BEAM_PENALTY)
    steps = f"stp AS (SELECT {here} AS here, {there} AS there, token, CAST(amount AS DOUBLE) AS amount, CAST(floor(epoch(first_t)) AS BIGINT) AS t, {kind} AS kind FROM typ WHERE src <> dst), own AS (SELECT coalesce(max({own}), '') AS kind FROM typ WHERE {here} = 'A5')"
    h0 = f"h0 AS (SELECT 'A5' AS path, 'A5' AS tail, '' AS tokens, 0.0::DOUBLE AS total, 0::BIGINT AS gaps, NULL::BIGINT AS last, CASE WHEN kind <> '' THEN 1 ELSE 0 END AS known, CAST({pen} AS DOUBLE) AS penalty, 0.0::DOUBLE AS score FROM own)"
    parts = [steps, h0]
    for k in range(1, hops + 1):
        avg = f"(gaps / {max(k - 1, 1)})"
        steady = "50" if k < 2 else f"CASE WHEN {avg} <= 3600 THEN 90 WHEN {avg} <= 86400 THEN 70 WHEN {avg} <= 604800 THEN 40 ELSE 10 END"
        score = f"round(greatest(0, (CASE WHEN total > 0 THEN least(log10(total) * 10, 100) ELSE 0 END * 40 + {steady} * 20 + CASE WHEN known > 0 THEN 50 ELSE 30 END * 20 + {min(20 * k, 100)} * 20) / 100 * (1 - least(penalty / {k + 1} * 20, 20) / 100))::DOUBLE, 2)"
        parts.append(
            f"g{k} AS (SELECT path || '>' || there AS path, there AS tail, CASE WHEN tokens = '' THEN token ELSE tokens || '>' || token END AS tokens, total + amount AS total, gaps + coalesce(abs(t - last), 0) AS gaps, t AS last, known + CASE WHEN kind <> '' THEN 1 ELSE 0 END AS known, penalty + CAST({pen} AS DOUBLE) AS penalty "
            f"FROM h{k - 1} JOIN stp ON here = tail WHERE NOT contains('>' || path || '>', '>' || there || '>')), h{k} AS (SELECT *, {score} AS score FROM g{k} ORDER BY score DESC, path, tokens LIMIT {beam})"
        )
    return f"WITH {_TYPED}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT '{way}' AS direction, {k} AS hop, path, tokens, score FROM h{k}" for k in range(1, hops + 1))


@query("g10_beam_out", _beam(4, 20, "out"))
def g10o(spark: SparkSession, d: str) -> DataFrame:
    return ff.beam_trace(typed(spark, d), "A5", 4, 20, "out")


@query("g10_beam_in", _beam(4, 20, "in"))
def g10i(spark: SparkSession, d: str) -> DataFrame:
    return ff.beam_trace(typed(spark, d), "A5", 4, 20, "in")


FLOW_AS_OF = "2001-11-05 00:00:00"
_FS = f"""{TRA}, fan AS (SELECT src AS node, dst AS other, false AS inward, amount, t FROM tra WHERE src <> dst UNION ALL SELECT dst, src, true, amount, t FROM tra WHERE src <> dst),
prs AS (SELECT node, other, inward, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, count(*) AS n, count(*) FILTER (t > TIMESTAMP '{FLOW_AS_OF}' - INTERVAL 30 DAY AND t <= TIMESTAMP '{FLOW_AS_OF}') AS recent, min(t) AS t0, max(t) AS t1 FROM fan GROUP BY ALL),
agg AS (SELECT node, CAST(coalesce(sum(amount) FILTER (inward), 0) AS DECIMAL(38,2)) AS total_in, CAST(coalesce(sum(amount) FILTER (NOT inward), 0) AS DECIMAL(38,2)) AS total_out, max(amount) FILTER (inward) AS mi, max(amount) FILTER (NOT inward) AS mo, CAST(sum(n) AS BIGINT) AS txs, count(DISTINCT other) AS counterparties, CAST(sum(recent) AS BIGINT) AS recent_30d, min(t0) AS first_t, max(t1) AS last_t FROM prs GROUP BY node),
fs AS (SELECT node, total_in, total_out, txs, counterparties, recent_30d, first_t, last_t, coalesce(round(CAST(mi AS DOUBLE) / CAST(nullif(total_in, 0) AS DOUBLE), 6), 0) AS top1_source, coalesce(round(CAST(mo AS DOUBLE) / CAST(nullif(total_out, 0) AS DOUBLE), 6), 0) AS top1_target, (epoch_us(last_t) - epoch_us(first_t)) / 86400000000 AS days FROM agg)"""


def stats(spark: SparkSession, d: str) -> DataFrame:
    return ff.flow_stats(transfers(spark, d), F.lit(FLOW_AS_OF).cast("timestamp_ntz"))


_KEPT = "CASE WHEN total_in > 0 THEN greatest(0, least(1, (CAST(total_in AS DOUBLE) - CAST(total_out AS DOUBLE)) / CAST(total_in AS DOUBLE))) ELSE 0 END"
_STILL = "CASE WHEN recent_30d = 0 THEN 1.0 WHEN recent_30d < 3 THEN 0.6 ELSE 0.0 END"


@query("g11_settlements", f"""WITH {_FS}, {ENT}, s AS (SELECT fs.node, CAST(total_in - total_out AS DECIMAL(38,2)) AS retained, round((0.3 * {_KEPT} + 0.2 * least(3650, days) / 3650 + 0.15 * CASE WHEN top1_target < 0.2 THEN 0.8 WHEN top1_target < 0.5 THEN 0.4 ELSE 0.1 END + 0.15 * {_STILL} + 0.1 * CASE WHEN top1_target < 0.2 THEN 0.8 ELSE 0 END + 0.1 * CASE WHEN entity_type <> '' THEN 0.5 ELSE 0 END)::DOUBLE, 3) AS score FROM fs LEFT JOIN ent ON ent.node = fs.node)
SELECT *, CASE WHEN score >= 0.65 THEN 'DORMANT_WALLET' ELSE 'CUSTODIAL_SETTLEMENT' END AS kind FROM s WHERE score >= 0.3""")
def g11s(spark: SparkSession, d: str) -> DataFrame:
    return ff.settlements(stats(spark, d), entities(spark, d), least=0.3)


@query("g11_conservation", f"WITH {_FS}, g AS (SELECT node, total_in, total_out, round(coalesce(abs(CAST(total_in AS DOUBLE) - CAST(total_out AS DOUBLE)) / nullif(CAST(total_in AS DOUBLE), 0), 0), 3) AS deviation FROM fs) SELECT *, deviation < 0.5 AS passed FROM g")
def g11k(spark: SparkSession, d: str) -> DataFrame:
    return ff.conservation(stats(spark, d))


@query("g11_profit", f"""WITH {_FS}, b AS (SELECT *, CAST(total_in - total_out AS DECIMAL(38,2)) AS net, CAST(CAST(total_in AS DECIMAL(20,2)) * CAST(floor(top1_source * 1000) AS DECIMAL(4,0)) * 0.0007::DECIMAL(5,4) AS DECIMAL(38,2)) AS basis FROM fs)
SELECT node, 'L0' AS level, NULL::DECIMAL(38,2) AS cost_basis, total_in AS net_profit, 0.5::DOUBLE AS confidence FROM b UNION ALL SELECT node, 'L1', NULL, net, 0.6 FROM b UNION ALL SELECT node, 'L2', basis, CAST(net - basis AS DECIMAL(38,2)), 0.4 FROM b WHERE top1_source > 0""")
def g11p(spark: SparkSession, d: str) -> DataFrame:
    return ff.profit(stats(spark, d))


@query("r10_candidates", f"""WITH {_FS}, s AS (SELECT *, round((0.4 * {_KEPT} + 0.3 * {_STILL} + 0.2 * CASE WHEN txs > 0 THEN 1 - greatest(0, least(1, counterparties / txs)) ELSE 0 END + 0.1 * greatest(0, least(1, days)))::DOUBLE, 3) AS dormancy FROM fs)
SELECT node, dormancy, CASE WHEN top1_target >= 0.8 AND recent_30d > 0 THEN 'exchange_deposit_candidate' WHEN top1_target >= 0.6 THEN 'collector_settlement_candidate' END AS deposit, recent_30d > 0 AND counterparties >= 10 AND top1_target < 0.6 AS hot_wallet, dormancy >= 0.5 AS settlement FROM s""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return ff.dormancy_score(stats(spark, d))


_STEPS = "CASE " + " ".join(f"WHEN x >= {int(k)} THEN {v}" for k, v in sorted(ff.AMOUNT_STEPS.items(), reverse=True)) + " ELSE 0 END"
_EA, _ER, _EL, _ET = ff.EXPANSION_WEIGHTS


@query("r8_expansion", f"""WITH {_FS}, {ENT}, s AS (SELECT fs.node, round(({_STEPS} * {_EA} + greatest(0, least(100, 100 * top1_source)) * {_ER} + greatest(0, least(1, top1_target)) * 100 * {_EL} + (least(txs / 1000, 1) * 70 + least(counterparties / 50, 1) * 30) * {_ET}) / {sum(ff.EXPANSION_WEIGHTS)} * (1 - {_case("coalesce(entity_type, '')", ff.EXPANSION_PENALTY)} * {ff.EXPANSION_COST} / 100)::DOUBLE, 2) AS score
FROM (SELECT *, CAST(total_in + total_out AS DOUBLE) AS x FROM fs) fs LEFT JOIN ent ON ent.node = fs.node) SELECT *, CASE WHEN score >= 30 THEN 'ACQUIRE' WHEN score >= 15 THEN 'HOLD' ELSE 'IGNORE' END AS decision FROM s""")
def r8(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.runtime import skew_safe_lookup

    s = skew_safe_lookup(stats(spark, d), entities(spark, d), ["node"], ["entity_type"])
    return ff.expansion(s.select("node", (F.col("total_in") + F.col("total_out")).alias("amount"), (100 * F.col("top1_source")).alias("risk"), F.col("top1_target").alias("relation"), "txs", F.col("counterparties").alias("degree"), "entity_type"))


_W = ff.MODES["fund_trace"]


@query("r9_investigation", f"""WITH {_FS}, {ENT}, pr AS (SELECT DISTINCT node, other FROM prs), ne AS (SELECT pr.node, count(*) AS entities, count(ent.node) AS known, count(*) FILTER (entity_type = 'EXCHANGE') AS exchanges FROM pr LEFT JOIN ent ON ent.node = pr.other GROUP BY 1),
s AS (SELECT node, CAST(least(100, CASE WHEN bal >= 10000000 THEN 50 WHEN bal >= 1000000 THEN 30 WHEN bal >= 100000 THEN 15 ELSE 0 END + CASE WHEN total_in > total_out THEN 30 ELSE 0 END + CASE WHEN recent_30d = 0 THEN 20 ELSE 0 END) AS DOUBLE) AS fund, round(least(100, least(60, log10(txs + 1) * 20) + least(40, log10(CAST(total_in + total_out AS DOUBLE) + 1) * 8))::DOUBLE, 1) AS behaviour, round(100 * top1_source, 1) AS risk,
round(known / entities * 100, 1) AS entity, round(least(100, 100 * top1_target + least(20, counterparties * 2))::DOUBLE, 1) AS graph, round(least(100, known / entities * 80 + least(20, exchanges * 5))::DOUBLE, 1) AS identity FROM (SELECT *, total_in - total_out AS bal FROM fs) JOIN ne USING (node))
SELECT *, round(fund * {_W[0]} + behaviour * {_W[1]} + risk * {_W[2]} + entity * {_W[3]} + graph * {_W[4]} + identity * {_W[5]}, 1) AS total FROM s""")
def r9(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.runtime import skew_safe_lookup

    t = transfers(spark, d).filter("src <> dst")
    pairs = t.select(F.inline(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"))))).distinct()
    met = skew_safe_lookup(pairs, entities(spark, d).withColumnRenamed("node", "other"), ["other"], ["entity_type"]).groupBy("node").agg(F.count(F.lit(1)).alias("entities"), F.count("entity_type").alias("known"), F.count_if(F.col("entity_type") == "EXCHANGE").alias("exchanges"))
    c = F.col
    rows = stats(spark, d).join(met, "node").select(
        "node", (c("total_in") - c("total_out")).alias("balance_usd"), (c("total_in") > c("total_out")).alias("profit"), (c("recent_30d") == 0).alias("holding"), "txs", (c("total_in") + c("total_out")).alias("flow"), (100 * c("top1_source")).alias("risk"), "entities", "known", c("known").alias("labelled"), "exchanges", (100 * c("top1_target")).alias("best_path"), c("counterparties").alias("paths"),
    )
    return ff.investigation(rows, "fund_trace")


neutral_times(QUERIES, SQL, {"a7_all_time": "first_t last_t", "a11_summary": "first_t last_t", "a20_refresh_summary": "first_t last_t", "a20_refresh_counterparties": "first_t last_t", "a20_refresh_daily": "day/date", "a38_financial_report": "last_updated", "a45_periods": "start/date", "r12_cross_chain": "first_t last_t"})
