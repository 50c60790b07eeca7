"""Further queries of the reference's operators: imports, pages, valued graphs, scores and patterns, each with SQL where SQL can state it."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.functions import cleaning as cl
from tracewright.operators import address_analytics as aa
from tracewright.operators import graph, ledger, prices, relational, scoring
from tracewright.plans.analytics import _BAL, _DEC, _EDGES, _I, _O, _STATS, _T, _USD, _WAY, _as_of, _conc, _z
from tracewright.plans.neutral import neutral_times
from tracewright.plans.views import ACT, ANC, activity, anchors, transfers
from tracewright.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

CHAINS = (1, 56, 8453, 42161)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def scope(act: DataFrame, chain: int, address: str | None, start: datetime, end: datetime, limit: int = 100) -> DataFrame:
    """Rows of one chain (and address) in [start, end); ValueError, before anything is planned, for an unknown chain, a malformed address,
    a range that is empty or longer than 366 days, or a limit outside 1..500."""
    if chain not in CHAINS or (address is not None and not re.fullmatch("0x[0-9a-f]{40}", address)) or not start < end <= start + timedelta(days=366) or not 1 <= limit <= 500:
        raise ValueError("invalid address query")
    rows = act.filter((F.col("chain_id") == chain) & (F.col("block_time") >= F.lit(start)) & (F.col("block_time") < F.lit(end)))
    return rows if address is None else rows.filter(F.col("address") == address)


@query("p17_time_scope", f"WITH {ACT} SELECT activity_id, address, block_time FROM act WHERE chain_id = 56 AND block_time >= TIMESTAMPTZ '2019-12-31 12:00:00+00' AND block_time < TIMESTAMPTZ '2020-01-01 12:00:00+00'")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return scope(activity(spark, d), 56, None, datetime(2019, 12, 31, 12), datetime(2020, 1, 1, 12)).select("activity_id", "address", "block_time")


_NUM = "coalesce(try_cast(regexp_replace(regexp_replace(coalesce(amount, ''), '[,，￥¥元]', '', 'g'), '[^0-9.+-]', '', 'g') AS DOUBLE), 0)"


@query("p32_bank_preclean", f"""SELECT row_id, CAST(abs({_NUM}) AS DECIMAL(20,2)) AS amount, {_WAY} AS way FROM ledger WHERE NOT coalesce(regexp_matches(feedback_reason, '失败|冲正|撤销|退汇'), false) AND coalesce(trim(txn_time), '') <> '' AND coalesce(trim(amount), '') <> ''""")
def p32(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(F.trim(c), F.lit(""))
    ok = ~F.coalesce(F.col("feedback_reason").rlike("失败|冲正|撤销|退汇"), F.lit(False)) & (e("txn_time") != "") & (e("amount") != "")
    return table(spark, d, "ledger").filter(ok).select("row_id", F.abs(cl.to_number(F.col("amount"))).cast("decimal(20,2)").alias("amount"), cl.direction(F.col("direction")).alias("way"))


@query("p35_import_rows", f"""SELECT row_id, CAST({_NUM} AS DECIMAL(20,2)) AS amount, {_WAY} AS way, CASE WHEN coalesce(trim(txn_time), '') = '' THEN 'txn_time' WHEN coalesce(trim(amount), '') = '' THEN 'amount' WHEN {_WAY} IS NULL OR {_WAY} NOT IN ('进', '出') THEN 'direction' END AS error_field FROM ledger""")
def p35(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.coalesce(F.trim(c), F.lit(""))
    way = cl.direction(F.col("direction"))
    err = F.when(e("txn_time") == "", "txn_time").when(e("amount") == "", "amount").when(way.isNull() | ~way.isin("进", "出"), "direction")
    return table(spark, d, "ledger").select("row_id", cl.to_number(F.col("amount")).cast("decimal(20,2)").alias("amount"), way.alias("way"), err.alias("error_field"))


_FP = ", ".join(f"coalesce(trim({c}), '')" for c in ledger.FINGERPRINT)
_IDENT = f"""CASE WHEN coalesce(trim(txn_serial), '') <> '' THEN 'serial' || sha256(concat_ws(chr(31), {_FP})) || coalesce(trim(data_source), '') || coalesce(nullif(trim(account_no), ''), nullif(trim(card_no), ''), nullif(trim(account_name), ''), '')
WHEN coalesce(trim(src_record_id), '') <> '' THEN 'source' || trim(src_record_id) ELSE sha256(concat_ws(chr(31), {_FP})) END"""
_LREASON = f"""CASE WHEN coalesce(regexp_matches(feedback_reason, '失败|冲正|撤销|退汇'), false) THEN 'failed_feedback' WHEN coalesce(trim(txn_time), '') = '' THEN 'missing_time' WHEN coalesce(trim(direction), '') = '' THEN 'missing_direction' WHEN {_WAY} NOT IN ('进', '出') THEN 'invalid_direction' END"""


@query("u4_ledger_audit", f"""WITH c AS (SELECT row_id, {_LREASON} AS reject_reason, {_IDENT} AS k FROM ledger) SELECT row_id, reject_reason, CASE WHEN reject_reason IS NULL THEN row_number() OVER w END AS copy_no, CASE WHEN reject_reason IS NULL THEN first_value(row_id) OVER w END AS kept_id FROM c WINDOW w AS (PARTITION BY reject_reason IS NULL, k ORDER BY row_id)""")
def u4_ledger(spark: SparkSession, d: str) -> DataFrame:
    return ledger.classify(table(spark, d, "ledger"), ["row_id"]).select("row_id", "reject_reason", "copy_no", "kept_id")


@query("j2_inner_labelled", f"WITH {ACT} SELECT counterparty_label, count(*) AS rows, {_z('amount')} AS amount FROM act JOIN (SELECT DISTINCT counterparty_label AS l FROM act WHERE counterparty_label <> '') ON l = counterparty_label GROUP BY 1")
def j2(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d).select("counterparty_label", "amount")
    labels = a.filter("counterparty_label <> ''").select(F.col("counterparty_label").alias("l")).distinct()
    return a.join(labels, F.col("l") == F.col("counterparty_label")).groupBy("counterparty_label").agg(F.count(F.lit(1)).alias("rows"), aa.zero_sum(F.col("amount")).alias("amount"))


@query("j5_in_subquery", f"WITH {_EDGES} SELECT src, dst, token, amount FROM e WHERE (src, dst) IN (SELECT (src, dst) FROM e GROUP BY src, dst HAVING count(*) >= 3)")
def j5(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges_of(transfers(spark, d))
    busy = e.groupBy("src", "dst").count().filter("count >= 3")
    return e.join(busy, ["src", "dst"], "left_semi").select("src", "dst", "token", "amount")


@query("j10_any_left", "SELECT o_orderkey, p AS l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def j10(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.min("l_partkey").alias("l_partkey"))
    return table(spark, d, "orders").join(one, F.col("k") == F.col("o_orderkey"), "left").select("o_orderkey", "l_partkey")


@query("j11_windows", f"""WITH {ACT}, w AS (SELECT unnest([5, 15, 60, 360, 1440]) AS minutes) SELECT minutes, chain_id, count(*) FILTER (block_time > {_T} - minutes * INTERVAL 1 MINUTE AND block_time <= {_T}) AS rows FROM act CROSS JOIN w GROUP BY ALL""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    # Five windows against every row are five conditional counts, not a product.
    minutes = (5, 15, 60, 360, 1440)
    one = activity(spark, d).groupBy("chain_id").agg(*[F.count_if((F.col("block_time") > _as_of() - F.expr(f"INTERVAL {m} MINUTE")) & (F.col("block_time") <= _as_of())).alias(f"m{m}") for m in minutes])
    return one.select("chain_id", F.inline(F.array(*[F.struct(F.lit(m).alias("minutes"), F.col(f"m{m}").alias("rows")) for m in minutes]))).select("minutes", "chain_id", "rows")


@query("a21_target_summary", f"WITH {ACT}, t AS (SELECT DISTINCT lower(contract_address) AS address FROM token_metadata_registry UNION SELECT DISTINCT address FROM act) SELECT t.address, count(act.activity_id) AS rows, {_I} AS in_amount, {_O} AS out_amount FROM t LEFT JOIN act ON act.address = t.address GROUP BY 1")
def a21(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    t = table(spark, d, "token_metadata_registry").select(F.lower("contract_address").alias("address")).union(a.select("address")).distinct()
    g = a.groupBy("address").agg(F.count(F.lit(1)).alias("rows"), aa.zero_sum(F.col("amount"), aa.is_in()).alias("in_amount"), aa.zero_sum(F.col("amount"), aa.is_out()).alias("out_amount"))
    zero = F.lit(0).cast(aa.D18)
    return t.join(g, "address", "left").select("address", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("in_amount", zero).alias("in_amount"), F.coalesce("out_amount", zero).alias("out_amount"))


@query("a22_counterparty_rollup", f"""WITH {ACT}, g AS (SELECT chain_id, address, counterparty_address, count(*) AS rows, count(*) FILTER (status = 'SUCCESS') AS succeeded, CASE WHEN count(DISTINCT direction) FILTER (direction IN ('IN', 'OUT')) = 2 THEN 'BOTH' ELSE min(direction) END AS way FROM act WHERE counterparty_address <> '' GROUP BY ALL) SELECT *, (SELECT count(*) FROM g) AS total_rows FROM g ORDER BY rows DESC, chain_id, address, counterparty_address LIMIT 200 OFFSET 100""")
def a22(spark: SparkSession, d: str) -> DataFrame:
    both = (F.count_if(aa.is_in()) > 0) & (F.count_if(aa.is_out()) > 0)
    g = activity(spark, d).filter("counterparty_address <> ''").groupBy("chain_id", "address", "counterparty_address").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "SUCCESS").alias("succeeded"), F.when(both, "BOTH").otherwise(F.min("direction")).alias("way"))
    return relational.offset_page(g, [F.desc("rows"), "chain_id", "address", "counterparty_address"], 100, 200)


@query("a28_flow_graph", f"""WITH r AS (SELECT account_no AS src, cp_account AS dst, CAST({_NUM} AS DECIMAL(18,2)) AS amount, account_name, id_no FROM ledger WHERE account_no <> '' AND cp_account <> ''), e AS (SELECT src, dst, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM r GROUP BY ALL),
m AS (SELECT src, max(nullif(account_name, '')) AS name, max(nullif(id_no, '')) AS id_no FROM r GROUP BY src) SELECT e.src, e.dst, n, amount, name, id_no FROM e JOIN m USING (src)""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "ledger").filter("account_no <> '' AND cp_account <> ''").select(F.col("account_no").alias("src"), F.col("cp_account").alias("dst"), cl.to_number(F.col("amount")).cast("decimal(18,2)").alias("amount"), "account_name", "id_no")
    e = r.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))
    m = r.groupBy("src").agg(F.max(F.nullif("account_name", F.lit(""))).alias("name"), F.max(F.nullif("id_no", F.lit(""))).alias("id_no"))
    return e.join(m, "src").select("src", "dst", "n", "amount", "name", "id_no")


@query("a31_pair_totals", f"""WITH {_EDGES}, p AS (SELECT *, CAST(sum(amount) OVER w AS DECIMAL(38,2)) AS pair_amount, min(first_t) OVER w AS pair_first, max(last_t) OVER w AS pair_last, CAST(sum(n) OVER w AS BIGINT) AS pair_n FROM e WINDOW w AS (PARTITION BY src, dst)) SELECT src, dst, token, amount, pair_amount, pair_first, pair_last, pair_n FROM p WHERE pair_amount >= 100000""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges_of(transfers(spark, d))
    pair = e.groupBy("src", "dst").agg(F.sum("amount").cast("decimal(38,2)").alias("pair_amount"), F.min("first_t").alias("pair_first"), F.max("last_t").alias("pair_last"), F.sum("n").alias("pair_n"))
    return e.select("src", "dst", "token", "amount").join(pair.filter("pair_amount >= 100000"), ["src", "dst"])


@query("a32_valued_graph", f"""WITH {ACT}, {ANC}, {_USD}, m AS (SELECT a.*, CASE WHEN epoch_us(a.block_time) - epoch_us(usd.minute) <= 86400000000 THEN usd.close END AS px FROM act a ASOF LEFT JOIN usd ON usd.chain_id = a.chain_id AND usd.sym = upper(trim(a.token_symbol)) AND a.block_time >= usd.minute WHERE direction = 'OUT' AND counterparty_address <> ''),
v AS (SELECT chain_id, address, counterparty_address, upper(trim(token_symbol)) AS sym, coalesce(price_usd, CASE WHEN upper(trim(token_symbol)) = 'USDX' THEN 1 END, px) IS NOT NULL AS priced FROM m) SELECT chain_id, address, counterparty_address, sym, count(*) AS rows, count(*) FILTER (priced) AS priced_rows, CASE WHEN count(*) FILTER (priced) = count(*) THEN 'VALUED' WHEN count(*) FILTER (priced) > 0 THEN 'PARTIAL' ELSE 'NO_PRICE' END AS status FROM v GROUP BY ALL""")
def a32(spark: SparkSession, d: str) -> DataFrame:
    out = activity(spark, d).filter("direction = 'OUT' AND counterparty_address <> ''")
    v = prices.valued(out, anchors(spark, d)).select("activity_id", "price", "sym")
    j = out.select("activity_id", "chain_id", "address", "counterparty_address").join(v, "activity_id")
    n = F.count_if(F.col("price").isNotNull())
    return j.groupBy("chain_id", "address", "counterparty_address", "sym").agg(F.count(F.lit(1)).alias("rows"), n.alias("priced_rows"), F.when(n == F.count(F.lit(1)), "VALUED").when(n > 0, "PARTIAL").otherwise("NO_PRICE").alias("status"))


@query("f4_resolved_prices", """WITH q AS (SELECT event_id AS id, 'S' || (user_id % 5) AS symbol, ts AS t FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS cid, 'S' || (user_id % 5) AS symbol, ts AS ct, value AS price, 'src' || (event_id % 3) AS source, CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM events WHERE event_type = 'view'),
j AS (SELECT q.id, price, source, abs(epoch_us(t) - epoch_us(ct)) AS gap, row_number() OVER (PARTITION BY q.id ORDER BY CASE source WHEN 'src1' THEN 1 WHEN 'src0' THEN 2 ELSE 99 END, abs(epoch_us(t) - epoch_us(ct)), CASE confidence WHEN 'HIGH' THEN -3 WHEN 'MEDIUM' THEN -2 ELSE -1 END, source, ct, price) AS r FROM q JOIN c ON q.symbol = c.symbol AND abs(epoch_us(t) - epoch_us(ct)) <= 300000000)
SELECT q.id, CASE WHEN b.id IS NULL AND q.symbol = 'S0' THEN 1 ELSE price END AS price, CASE WHEN b.id IS NULL AND q.symbol = 'S0' THEN 'peg' ELSE source END AS source, CAST(floor(gap / 1000000) AS BIGINT) AS gap_s FROM q LEFT JOIN (SELECT * FROM j WHERE r = 1) b ON b.id = q.id""")
def f4(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp")).withColumn("symbol", F.concat(F.lit("S"), (F.col("user_id") % 5).cast("string")))
    q = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "symbol", "t")
    conf = F.when(F.col("event_id") % 4 == 0, "HIGH").when(F.col("event_id") % 4 == 1, "MEDIUM").otherwise("LOW")
    c = e.filter("event_type = 'view'").select("symbol", "t", F.col("value").alias("price"), F.concat(F.lit("src"), (F.col("event_id") % 3).cast("string")).alias("source"), conf.alias("confidence"))
    return prices.resolve(q, c, 300, {"src1": 1, "src0": 2}, ("S0",))


@query("f6_asset_snapshot", f"""WITH {ACT}, {_BAL}, n AS (SELECT chain_id, token_address, amount, row_number() OVER (PARTITION BY chain_id, token_address ORDER BY amount) AS r, count(*) OVER (PARTITION BY chain_id, token_address) AS n FROM act WHERE amount IS NOT NULL), p AS (SELECT chain_id, token_address, amount AS p95 FROM n WHERE r = floor((n - 1) * 0.95::DOUBLE) + 1),
l AS (SELECT chain_id, address, token_address, count(*) AS large_in, max(amount) AS largest, max(block_time) AS last_t FROM act JOIN p USING (chain_id, token_address) WHERE direction = 'IN' AND amount >= p95 GROUP BY ALL), q AS (SELECT act.chain_id, act.address, act.token_address, sum(amount) AS quick FROM act JOIN l ON l.chain_id = act.chain_id AND l.address = act.address AND l.token_address = act.token_address WHERE direction = 'OUT' AND epoch_us(block_time) - epoch_us(last_t) BETWEEN 0 AND 86400000000 GROUP BY ALL)
SELECT b.chain_id, b.address, b.token_address, b.balance, coalesce(large_in, 0) AS large_in, coalesce(CAST(quick AS DOUBLE) >= 0.8 * CAST(largest AS DOUBLE), false) AS rapid_outflow, row_number() OVER (PARTITION BY b.chain_id, b.address ORDER BY b.balance DESC, b.token_address) AS rank FROM bal b LEFT JOIN l ON l.chain_id = b.chain_id AND l.address = b.address AND l.token_address = b.token_address LEFT JOIN q ON q.chain_id = b.chain_id AND q.address = b.address AND q.token_address = b.token_address QUALIFY rank <= 5""")
def f6(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.runtime import skew_safe_lookup

    a, k = activity(spark, d), ["chain_id", "address", "token_address"]
    ins = a.filter("direction = 'IN'").select(*k, "amount", "block_time")
    large = skew_safe_lookup(ins, aa.amount_thresholds(a), ["chain_id", "token_address"], ["p95"]).filter("amount >= p95").groupBy(*k).agg(F.count(F.lit(1)).alias("large_in"), F.max("amount").alias("largest"), F.max("block_time").alias("last_t"))
    # What goes out within a day after the last large receipt: 80 % of the largest one or more is a rapid outflow.
    outs = skew_safe_lookup(a.filter("direction = 'OUT'").select(*k, "amount", "block_time"), large, k, ["last_t"])
    quick = outs.filter((F.unix_micros("block_time") - F.unix_micros("last_t")).between(0, 86_400_000_000)).groupBy(*k).agg(F.sum("amount").alias("quick"))
    b = aa.assets(a).select(*k, "balance").join(large.select(*k, "large_in", "largest"), k, "left").join(quick, k, "left")
    rapid = F.coalesce(F.col("quick").cast("double") >= 0.8 * F.col("largest").cast("double"), F.lit(False))
    return relational.top_per_group(b.select(*k, "balance", F.coalesce("large_in", F.lit(0)).alias("large_in"), rapid.alias("rapid_outflow")), ["chain_id", "address"], [F.desc("balance"), "token_address"], 5)


def ego(edges: DataFrame, root: str, depth: int = 2, max_edges: int = 1000) -> DataFrame:
    """The edges around ``root`` by level: the first level its outgoing edges, deeper ones all edges of the nodes reached; a level takes
    the largest edges first until ``max_edges`` are reached in all, and a level that was cut is flagged. Depth at most 4."""
    from tracewright.runtime import materialize

    if not 1 <= depth <= 4 or not 1 <= max_edges <= 1000:
        raise ValueError("depth or edge limit out of range")
    spark = edges.sparkSession
    e = edges.select("src", "dst", "token", "amount", F.substring(F.sha2(F.concat_ws("|", "src", "dst", "token"), 256), 1, 12).alias("edge_id"))
    seen = spark.createDataFrame([(root,)], "node string")
    front, out, left = seen, None, max_edges
    for k in range(1, depth + 1):
        hit = e.join(front, e.src == front.node, "left_semi")
        if k > 1:
            hit = hit.union(e.join(front, e.dst == front.node, "left_semi")).distinct()
            hit = hit.join(out.select("edge_id"), "edge_id", "left_anti").select(*e.columns)
        level = materialize(relational.capped(hit, [F.desc("amount"), "src", "dst", "token"], left).withColumn("level", F.lit(k)), "ego")
        out = level if out is None else out.unionByName(level)
        left -= level.count()
        nodes = level.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        front = materialize(nodes.join(seen, "node", "left_anti"), "front")
        seen = materialize(seen.union(front), "seen")
        if left <= 0 or not front.limit(1).count():
            break
    return out


_EGO = f"""WITH {_EDGES}, x AS (SELECT src, dst, token, amount, substr(sha256(src || '|' || dst || '|' || token), 1, 12) AS edge_id FROM e), a AS (SELECT *, count(*) OVER () > 1000 AS truncated, 1 AS level FROM x WHERE src = 'A5' ORDER BY amount DESC, src, dst, token LIMIT 1000),
f AS (SELECT src AS node FROM a UNION SELECT dst FROM a), b AS (SELECT *, count(*) OVER () > 1000 - (SELECT count(*) FROM a) AS truncated, 2 AS level FROM x WHERE (src IN (SELECT node FROM f WHERE node <> 'A5') OR dst IN (SELECT node FROM f WHERE node <> 'A5')) AND edge_id NOT IN (SELECT edge_id FROM a))
SELECT * FROM a UNION ALL SELECT * FROM (SELECT * FROM b ORDER BY amount DESC, src, dst, token LIMIT 1000) QUALIFY row_number() OVER (PARTITION BY level ORDER BY amount DESC, src, dst, token) <= CASE level WHEN 1 THEN 1000 ELSE 1000 - (SELECT count(*) FROM a) END"""


@query("g6_ego_graph", _EGO)
def g6(spark: SparkSession, d: str) -> DataFrame:
    return ego(graph.edges_of(transfers(spark, d)), "A5", 2, 1000)


@query("g19_hypothesis", f"""WITH {ACT}, t AS (SELECT chain_id, address FROM act GROUP BY ALL ORDER BY count(*) DESC, chain_id, address LIMIT 2), m AS (SELECT DISTINCT chain_id, address, counterparty_address AS c, counterparty_entity_type AS e, counterparty_label AS l FROM act JOIN t USING (chain_id, address) WHERE counterparty_address <> ''),
k AS (SELECT e, l FROM m WHERE e <> '' AND l <> '' GROUP BY ALL HAVING count(DISTINCT (chain_id, address)) = 2), s AS (SELECT c FROM m GROUP BY 1 HAVING count(DISTINCT (chain_id, address)) = 2)
SELECT (SELECT count(*) FROM k) AS common_entities, (SELECT count(*) FROM s) AS common_addresses, CASE WHEN (SELECT count(*) FROM k) > 0 THEN 0.8 WHEN (SELECT count(*) FROM s) > 0 THEN 0.5 ELSE 0.3 END AS score""")
def g19(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    t = a.groupBy("chain_id", "address").count().orderBy(F.desc("count"), "chain_id", "address").limit(2).select("chain_id", "address")  # two addresses are compared
    m = a.filter("counterparty_address <> ''").join(F.broadcast(t), ["chain_id", "address"], "left_semi").select("chain_id", "address", F.col("counterparty_address").alias("c"), F.col("counterparty_entity_type").alias("e"), F.col("counterparty_label").alias("l")).distinct()
    both = lambda rows, *k: rows.select(*k, "chain_id", "address").distinct().groupBy(*k).count().filter("count = 2").agg(F.count(F.lit(1)))
    k = both(m.filter("e <> '' AND l <> ''"), "e", "l")
    one = both(m, "c").toDF("common_addresses").withColumn("common_entities", k.scalar())
    return one.select("common_entities", "common_addresses", F.when(F.col("common_entities") > 0, 0.8).when(F.col("common_addresses") > 0, 0.5).otherwise(0.3).alias("score"))


@query("r12_label_precedence", """WITH l AS (SELECT chain_id, lower(contract_address) AS address, name AS label, coalesce(is_verified, false) AS verified, updated_at FROM token_metadata_registry WHERE name <> '') SELECT chain_id, address, label FROM l QUALIFY row_number() OVER (PARTITION BY chain_id, address ORDER BY verified DESC, updated_at DESC, label DESC) = 1""")
def r12(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "token_metadata_registry").filter("name <> ''")
    return scoring.label_precedence(reg.select("chain_id", F.lower("contract_address").alias("address"), F.col("name").alias("label"), F.coalesce("is_verified", F.lit(False)).alias("verified"), "updated_at"))


@query("w3_recovery_merge", "SELECT chain_id, lower(tx_hash) AS tx, event_index, lower(token_address) AS token, min(activity_id) AS kept FROM address_activity GROUP BY ALL")
def w3(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "address_activity").groupBy("chain_id", F.lower("tx_hash").alias("tx"), "event_index", F.lower("token_address").alias("token")).agg(F.min("activity_id").alias("kept"))


@query("w6_whole_count", "SELECT chain_id, contract_address, count(*) OVER () AS total FROM token_metadata_registry")
def w6(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "token_metadata_registry").select("chain_id", "contract_address")
    return t.withColumn("total", t.agg(F.count(F.lit(1))).scalar())  # a window would put everything into one task


@query("r11_holding_structure", f"""WITH {ACT}, g AS (SELECT chain_id, address, token_address, {_I} AS i, {_O} AS o FROM act GROUP BY ALL) SELECT chain_id, token_address, count(*) FILTER (i > o) AS holders, count(*) FILTER (i <= o AND o > 0) AS exited, CAST(sum(greatest(i - o, 0)) AS {_DEC}) AS held FROM g GROUP BY ALL""")
def r11(spark: SparkSession, d: str) -> DataFrame:
    b = aa.assets(activity(spark, d))
    i, o = F.col("in_amount"), F.col("out_amount")
    return b.groupBy("chain_id", "token_address").agg(F.count_if(i > o).alias("holders"), F.count_if((i <= o) & (o > 0)).alias("exited"), F.sum(F.greatest(F.col("balance"), F.lit(0).cast(aa.D18))).cast(aa.D18).alias("held"))


neutral_times(QUERIES, SQL, {"p17_time_scope": "block_time", "a31_pair_totals": "pair_first pair_last"})
