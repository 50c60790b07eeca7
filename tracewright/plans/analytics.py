"""Queries of the reference's own operators over the test tables, each with the SQL that states the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import cleaning as cl
from tracewright.operators import address_analytics as aa
from tracewright.operators import fifo, graph, prices, quality, relational, scoring
from tracewright.plans.neutral import neutral_times
from tracewright.plans.views import ACT, ANC, TRA, activity, anchors, transfers
from tracewright.sources.tables import table

AS_OF = "2020-01-02 12:00:00"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


_T = f"TIMESTAMPTZ '{AS_OF}+00'"
_DEC = "DECIMAL(38,18)"


def _z(x: str, cond: str | None = None) -> str:
    inner = f"sum({x})" if cond is None else f"sum({x}) FILTER ({cond})"
    return f"CAST(coalesce({inner}, 0) AS {_DEC})"


def _ratio(a: str, b: str) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"


# Scans, latest versions, deduplication


@query("w8_final_activity", f"WITH {ACT} SELECT activity_id, chain_id, address, direction, amount, ingested_at FROM act")
def w8(spark: SparkSession, d: str) -> DataFrame:
    return activity(spark, d).select("activity_id", "chain_id", "address", "direction", "amount", "ingested_at")


_LIID = "l_orderkey, l_linenumber"
_LIORD = "l_shipdate, l_extendedprice, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@query("u4_dedup_audit", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY {_LIID} ORDER BY {_LIORD}) AS copy_no, first_value(l_partkey) OVER (PARTITION BY {_LIID} ORDER BY {_LIORD}) AS kept_id FROM lineitem")
def u4(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return relational.dedup_with_audit(li, F.concat_ws("|", "l_orderkey", "l_linenumber"), _LIORD.split(", "), "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copy_no", "kept_id")


@query("w1_dedup_status_rank", """SELECT chain_id, lower(tx_hash) AS tx, event_index, direction, status, activity_id FROM address_activity
QUALIFY row_number() OVER (PARTITION BY chain_id, lower(tx_hash), event_index, direction, address ORDER BY CASE upper(status) WHEN 'SUCCESS' THEN 2 WHEN '1' THEN 2 WHEN 'FAILED' THEN 1 ELSE 0 END DESC, block_time DESC NULLS LAST, activity_id DESC) = 1""")
def w1(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "address_activity").withColumn("tx", F.lower("tx_hash"))
    rank = F.when(F.upper("status").isin("SUCCESS", "1"), 2).when(F.upper("status") == "FAILED", 1).otherwise(0)
    best = a.groupBy("chain_id", "tx", "event_index", "direction", "address").agg(F.max(F.struct(rank.alias("r"), "block_time", "activity_id", "status")).alias("m"))
    return best.select("chain_id", "tx", "event_index", "direction", "m.status", "m.activity_id")


@query("w2_dedup_event_key", "SELECT chain_id, lower(tx_hash) AS tx, event_index, min(activity_id) AS kept, count(*) AS copies FROM address_activity GROUP BY ALL")
def w2(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "address_activity").groupBy("chain_id", F.lower("tx_hash").alias("tx"), "event_index").agg(F.min("activity_id").alias("kept"), F.count(F.lit(1)).alias("copies"))


@query("sc18_typed_projection", """SELECT row_id, nullif(lower(trim(mac)), '') AS mac, try_cast(src_row AS BIGINT) AS src_row, try_cast(balance AS DECIMAL(18,2)) AS balance, nullif(trim(ip), '') AS ip FROM ledger""")
def sc18(spark: SparkSession, d: str) -> DataFrame:
    e = lambda c: F.nullif(F.trim(c), F.lit(""))
    return table(spark, d, "ledger").select("row_id", F.lower(e("mac")).alias("mac"), F.col("src_row").try_cast("bigint").alias("src_row"), F.col("balance").try_cast("decimal(18,2)").alias("balance"), e("ip").alias("ip"))


@query("sc9_row_counts", "SELECT 'ledger' AS name, count(*) AS rows FROM ledger UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events")
def sc9(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.sources.files import rows_per_file

    names = ("ledger", "lineitem", "events")
    per = [rows_per_file(table(spark, d, n)).select(F.lit(n).alias("name"), "rows") for n in names]
    return per[0].unionByName(per[1]).unionByName(per[2]).groupBy("name").agg(F.sum("rows").alias("rows"))


_SCHEMAS = ("ledger", "address_activity", "price_anchor_1m")


@query("sc9_schemas", " UNION ALL ".join(f"SELECT '{t}' AS name, column_name AS \"column\", row_number() OVER () AS place FROM (DESCRIBE {t})" for t in _SCHEMAS))
def sc9s(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.sources.files import schema_of

    parts = [schema_of(table(spark, d, n)).select(F.lit(n).alias("name"), "column", "place") for n in _SCHEMAS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u1_union_roles", f"WITH {TRA} SELECT src AS node FROM tra UNION SELECT dst FROM tra")
def u1(spark: SparkSession, d: str) -> DataFrame:
    return transfers(spark, d).select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@query("u2_fan_out", f"""WITH {TRA} SELECT address, direction, count(*) AS n, sum(amount) AS amount FROM (
SELECT src AS address, 'OUT' AS direction, amount FROM tra WHERE src <> dst UNION ALL SELECT dst, 'IN', amount FROM tra WHERE src <> dst UNION ALL SELECT src, 'SELF', amount FROM tra WHERE src = dst) GROUP BY ALL""")
def u2(spark: SparkSession, d: str) -> DataFrame:
    return relational.fan_out(transfers(spark, d), "src", "dst", ["amount"]).groupBy("address", "direction").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))


@query("u3_source_union", """SELECT origin, count(*) AS n, count(DISTINCT k) AS keys FROM (SELECT 'activity' AS origin, tx_hash AS k FROM address_activity UNION ALL SELECT 'ledger', log_no FROM ledger) GROUP BY origin""")
def u3(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "address_activity").select(F.lit("activity").alias("origin"), F.col("tx_hash").alias("k"))
    b = table(spark, d, "ledger").select(F.lit("ledger").alias("origin"), F.col("log_no").alias("k"))
    return a.unionByName(b).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("keys"))


@query("u6_upsert", """SELECT coalesce(b.k, a.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey < 15) a FULL JOIN (SELECT c_custkey AS k, c_acctbal * 2 AS v FROM customer WHERE c_nationkey >= 10) b ON a.k = b.k""")
def u6(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), "c_nationkey")
    old, new = c.filter("c_nationkey < 15").select("k", "v"), c.filter("c_nationkey >= 10").select("k", (F.col("v") * 2).alias("v"))
    return old.join(new, "k", "left_anti").unionByName(new)


# Scalar functions


@query("p1_topic_address", "SELECT row_id, CASE WHEN length(src_file_sha256) = 66 THEN '0x' || substr(src_file_sha256, 27, 40) ELSE src_file_sha256 END AS a FROM ledger")
def q_p1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.topic_address(F.col("src_file_sha256")).alias("a"))


@query("fn_to_number", """SELECT row_id, coalesce(try_cast(regexp_replace(regexp_replace(coalesce(amount, ''), '[,，￥¥元]', '', 'g'), '[^0-9.+-]', '', 'g') AS DOUBLE), 0) AS v FROM ledger""")
def q_p4(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.to_number(F.col("amount")).alias("v"))


def _in(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_WAY = f"CASE WHEN trim(direction) IN {_in(cl.IN_WORDS)} THEN '进' WHEN trim(direction) IN {_in(cl.OUT_WORDS)} THEN '出' ELSE trim(direction) END"


@query("fn_direction", f"SELECT row_id, {_WAY} AS way FROM ledger")
def q_p6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.direction(F.col("direction")).alias("way"))


@query("fn_account", "SELECT row_id, regexp_replace(regexp_replace(trim(voucher_no), '^[A-Za-z]+-?', ''), '[-_][A-Za-z0-9]+$', '') AS a FROM ledger")
def q_p7(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.account_number(F.col("voucher_no")).alias("a"))


@query("fn_clean_text", "SELECT row_id, CASE WHEN s NOT IN ('', 'nan', 'None', 'NaT') THEN s END AS s FROM (SELECT row_id, trim(replace(replace(replace(replace(txn_time, '﻿', ''), '　', ' '), chr(13), ' '), chr(10), ' ')) AS s FROM ledger)")
def q_p8(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.clean_text(F.col("txn_time")).alias("s"))


@query("fn_first_non_empty", "SELECT row_id, coalesce(nullif(trim(card_no), ''), nullif(trim(account_no), ''), nullif(trim(account_name), ''), '未知主体') AS subject FROM ledger")
def q_p9(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.first_non_empty(F.col("card_no"), F.col("account_no"), F.col("account_name"), F.lit("未知主体")).alias("subject"))


_REASON = f"""CASE WHEN coalesce(regexp_matches(feedback_reason, '失败|冲正|撤销|退汇'), false) THEN 'failed_feedback' WHEN coalesce(trim(txn_time), '') = '' THEN 'missing_time' WHEN coalesce(trim(amount), '') = '' THEN 'missing_amount'
WHEN coalesce(trim(direction), '') = '' THEN 'missing_direction' WHEN {_WAY} NOT IN ('进', '出') THEN 'invalid_direction' END"""


@query("fn_reject_reason", f"SELECT row_id, {_REASON} AS reason FROM ledger")
def q_p10(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return table(spark, d, "ledger").select("row_id", cl.reject_reason(c("feedback_reason"), {"time": c("txn_time"), "amount": c("amount"), "direction": c("direction")}, cl.direction(c("direction"))).alias("reason"))


@query("fn_parties", f"""SELECT row_id, CASE w WHEN '出' THEN payer_name WHEN '进' THEN payee_name END AS subject, CASE w WHEN '出' THEN payee_name WHEN '进' THEN payer_name END AS other, CASE WHEN w IN ('进', '出') THEN '已判定' ELSE '无法判定' END AS status
FROM (SELECT row_id, payer_name, payee_name, {_WAY} AS w FROM ledger)""")
def q_p11(spark: SparkSession, d: str) -> DataFrame:
    a, b, s = cl.parties(cl.direction(F.col("direction")), F.col("payer_name"), F.col("payee_name"))
    return table(spark, d, "ledger").select("row_id", a.alias("subject"), b.alias("other"), s.alias("status"))


@query("fn_split_named", r"""SELECT row_id, CASE WHEN regexp_matches(cp_name, '^(.*?)[(（]([^()（）]*)[)）]\s*$') THEN regexp_extract(cp_name, '^(.*?)[(（]([^()（）]*)[)）]\s*$', 1) ELSE cp_name END AS name,
CASE WHEN regexp_matches(cp_name, '^(.*?)[(（]([^()（）]*)[)）]\s*$') THEN regexp_extract(cp_name, '^(.*?)[(（]([^()（）]*)[)）]\s*$', 2) END AS account FROM ledger""")
def q_p13(spark: SparkSession, d: str) -> DataFrame:
    a, b = cl.split_named(F.col("cp_name"))
    return table(spark, d, "ledger").select("row_id", a.alias("name"), b.alias("account"))


@query("fn_mask_label", "SELECT row_id, CASE WHEN regexp_full_match(account_no, '[0-9]{12,}') THEN left(account_no, 4) || '…' || right(account_no, 4) WHEN length(account_no) > 24 THEN left(account_no, 24) || '…' ELSE account_no END AS label FROM ledger")
def q_p14(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.mask_label(F.col("account_no")).alias("label"))


@query("fn_filter_compiler", "SELECT row_id FROM ledger WHERE direction IN ('进', '收入') AND txn_time >= '2020' AND txn_time < '2023' AND contains(lower(cp_name), 'sons')")
def q_p15(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").filter(cl.predicates({"direction": ["进", "收入"], "txn_time": ("2020", "2023"), "cp_name": "Sons"}, fuzzy=["cp_name"])).select("row_id")


@query("fn_status_kind", """SELECT activity_id, CASE WHEN upper(trim(status)) IN ('1', 'SUCCESS', 'TRUE', 'OK') THEN 'SUCCESS' WHEN upper(trim(status)) IN ('0', 'FAILED', 'FALSE', 'REVERTED') THEN 'FAILED' ELSE 'UNKNOWN' END AS status,
CASE WHEN coalesce(counterparty_address, '') = '' THEN 'CONTRACT_CREATE' WHEN lower(coalesce(method_id, '')) = '0x095ea7b3' THEN 'APPROVE' WHEN lower(coalesce(method_id, '')) IN ('0x38ed1739', '0x7ff36ab5', '0x18cbafe5', '0x5ae401dc', '0x414bf389') THEN 'SWAP'
WHEN lower(coalesce(method_id, '')) IN ('', '0x') THEN 'NATIVE_TRANSFER' ELSE 'CONTRACT_CALL' END AS kind FROM address_activity""")
def q_p18(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "address_activity").select("activity_id", cl.status_text(F.col("status")).alias("status"), cl.activity_kind(F.col("method_id"), F.col("counterparty_address")).alias("kind"))


@query("fn_scaled", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 0 THEN r ELSE left(p, length(p) - k) || '.' || right(p, k) END AS v FROM (SELECT *, CASE WHEN length(r) < k + 1 THEN lpad(r, k + 1, '0') ELSE r END AS p FROM (
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_partkey AS VARCHAR) AS r, CAST(l_suppkey % 19 AS INT) AS k FROM lineitem))""")
def q_p20(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cl.scaled(F.col("l_partkey").cast("string"), (F.col("l_suppkey") % 19).cast("int")).alias("v"))


@query("p3_hex_total", "SELECT l_suppkey, CAST(sum(CAST(l_orderkey AS HUGEINT) * 4294967296 + l_partkey) AS DECIMAL(38,0)) AS total FROM lineitem GROUP BY l_suppkey")
def q_p3(spark: SparkSession, d: str) -> DataFrame:
    word = F.concat(F.lit("0x"), F.hex("l_orderkey"), F.lpad(F.hex("l_partkey"), 8, "0"))
    limbs = table(spark, d, "lineitem").select("l_suppkey", *[x.alias(f"x{i}") for i, x in enumerate(cl.hex_limbs(word))])
    sums = limbs.groupBy("l_suppkey").agg(*[F.sum(f"x{i}").alias(f"x{i}") for i in range(8)])
    return sums.select("l_suppkey", cl.limbs_total([F.col(f"x{i}") for i in range(8)]).alias("total"))


_RULE_FIELDS = ("$.signature", "$.provider", "$.encoding", "$.priority", "$.tolerance", "$.mapping.amount_column", "$.mapping.time_column", "$.mapping.direction_column")
_RULE_NAMES = [x.rsplit(".", 1)[1] for x in _RULE_FIELDS]


@query("p21_json_fields", "SELECT record_id, " + ", ".join(f"CASE WHEN json_type(rule_json, '{x}') IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') THEN json_extract_string(rule_json, '{x}') END AS {n}" for x, n in zip(_RULE_FIELDS, _RULE_NAMES) if n not in ("priority", "tolerance")) + ", try_cast(json_extract_string(rule_json, '$.priority') AS BIGINT) AS priority, round(try_cast(json_extract_string(rule_json, '$.tolerance') AS DOUBLE), 6) AS tolerance FROM custom_rules")
def q_p21(spark: SparkSession, d: str) -> DataFrame:
    f = lambda x: F.get_json_object("rule_json", x)
    text = lambda x: F.when(~F.coalesce(f(x), F.lit("")).rlike(r"^[\[{]"), f(x))
    cols = [text(x).alias(n) for x, n in zip(_RULE_FIELDS, _RULE_NAMES) if n not in ("priority", "tolerance")]
    return table(spark, d, "custom_rules").select("record_id", *cols, f("$.priority").try_cast("bigint").alias("priority"), F.round(f("$.tolerance").try_cast("double"), 6).alias("tolerance"))


@query("p31_facet", "SELECT cp_name AS value, count(*) AS n FROM ledger WHERE cp_name IS NOT NULL AND contains(lower(cp_name), 'co') GROUP BY 1 ORDER BY n DESC, value LIMIT 300")
def q_p31(spark: SparkSession, d: str) -> DataFrame:
    return relational.facet(table(spark, d, "ledger"), "cp_name", search="CO")


@query("p36_row_hash", "SELECT row_id, sha256(concat(octet_length(encode(coalesce(account_no, ''))), ':', coalesce(account_no, ''), chr(0), octet_length(encode(coalesce(cp_name, ''))), ':', coalesce(cp_name, ''), chr(0))) AS h FROM ledger")
def q_p36(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select("row_id", cl.row_hash([F.col("account_no"), F.col("cp_name")]).alias("h"))


@query("p30_enrich", """WITH reg AS (SELECT chain_id, lower(contract_address) AS c, max((updated_at, name, symbol, decimals, token_standard, is_verified)) AS v FROM token_metadata_registry GROUP BY ALL)
SELECT activity_id, a.chain_id, token_address, coalesce(nullif(v[2], ''), token_symbol) AS token_name, coalesce(nullif(v[3], ''), token_symbol) AS token_symbol, v[4] AS decimals, v[5] AS token_standard, coalesce(v[6], false) AS is_verified, schema_version + CASE WHEN v IS NULL THEN 0 ELSE 1 END AS schema_version FROM address_activity a LEFT JOIN reg ON reg.chain_id = a.chain_id AND reg.c = lower(a.token_address)""")
def q_p30(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.runtime import skew_safe_lookup

    reg = table(spark, d, "token_metadata_registry").groupBy("chain_id", F.lower("contract_address").alias("c")).agg(F.max(F.struct("updated_at", "name", "symbol", "decimals", "token_standard", "is_verified")).alias("v"))
    act = table(spark, d, "address_activity").select("activity_id", "chain_id", "token_address", F.col("token_symbol").alias("old_symbol"), "schema_version", F.lower("token_address").alias("c"))
    v = lambda c: F.coalesce(F.nullif(F.col(f"v.{c}"), F.lit("")), F.col("old_symbol"))
    return skew_safe_lookup(act, reg, ["chain_id", "c"], ["v"]).select(
        "activity_id", "chain_id", "token_address", v("name").alias("token_name"), v("symbol").alias("token_symbol"), "v.decimals", "v.token_standard", F.coalesce("v.is_verified", F.lit(False)).alias("is_verified"), (F.col("schema_version") + F.col("v").isNotNull().cast("int")).alias("schema_version")
    )


# Joins


@query("j1_left_enrich", """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def j1(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")  # nations and regions: 25 and 5 rows
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("j3_two_hops", f"""WITH {TRA}, e AS (SELECT src, dst, token, sum(amount) AS amount FROM tra GROUP BY ALL)
SELECT x.src AS root, x.dst AS middle, y.dst AS "end", CASE WHEN x.token = y.token THEN x.token ELSE 'mixed' END AS token, least(x.amount, y.amount) AS amount FROM e x JOIN e y ON x.dst = y.src WHERE x.src = 'A7' AND y.dst <> x.src AND x.dst <> x.src AND y.dst <> y.src""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    return aa.two_hops(graph.edges_of(transfers(spark, d)), spark.createDataFrame([("A7",)], "root string"))


@query("j4_touching", f"""WITH {TRA} SELECT DISTINCT * FROM tra WHERE src IN ('A1', 'A2', 'A3') OR dst IN ('A1', 'A2', 'A3')""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    return relational.touching(transfers(spark, d), spark.createDataFrame([("A1",), ("A2",), ("A3",)], "k string"), "src", "dst", "k")


@query("j6_anti", "SELECT DISTINCT lower(trim(h.contract_address)) AS contract FROM token_metadata_history h WHERE lower(trim(h.contract_address)) NOT IN (SELECT lower(trim(contract_address)) FROM token_metadata_registry)")
def j6(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "token_metadata_registry").select(F.lower(F.trim("contract_address")).alias("contract"))
    return table(spark, d, "token_metadata_history").select(F.lower(F.trim("contract_address")).alias("contract")).distinct().join(known, "contract", "left_anti")


@query("j7_either_side", f"""WITH {TRA} SELECT k, role, count(*) AS n, sum(amount) AS amount FROM (SELECT 'A' || n_nationkey AS k, CASE WHEN src = 'A' || n_nationkey THEN 'OUT' ELSE 'IN' END AS role, amount FROM tra JOIN nation ON src = 'A' || n_nationkey OR dst = 'A' || n_nationkey) GROUP BY ALL""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "nation").select(F.concat(F.lit("A"), F.col("n_nationkey").cast("string")).alias("k"))
    return relational.either_side(transfers(spark, d), F.broadcast(k), "src", "dst", "k").groupBy("k", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"))  # 25 rows


@query("j8_asof_events", """SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    f = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    v = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("vt"), F.col("event_id").alias("view_id"))
    return relational.asof_left(f, v, ["user_id"], "ts", "vt", ["view_id"]).select("event_id", "user_id", "view_id")


_USD = f"usd AS (SELECT chain_id, symbol AS sym, minute, close FROM anc WHERE quote_symbol = 'USDX' AND close IS NOT NULL)"


@query("j9_valued_activity", f"""WITH {ACT}, {ANC}, {_USD}, m AS (SELECT a.activity_id, a.chain_id, upper(trim(a.token_symbol)) AS sym, a.block_time, a.price_usd, usd.minute, usd.close FROM act a ASOF LEFT JOIN usd ON usd.chain_id = a.chain_id AND usd.sym = upper(trim(a.token_symbol)) AND a.block_time >= usd.minute),
f AS (SELECT activity_id, chain_id, sym, block_time, price_usd, CASE WHEN epoch_us(block_time) - epoch_us(minute) <= 86400000000 THEN close END AS close, CASE WHEN epoch_us(block_time) - epoch_us(minute) <= 86400000000 THEN minute END AS minute FROM m),
k AS (SELECT *, CASE WHEN price_usd IS NOT NULL THEN 'stored' WHEN sym = 'USDX' THEN 'peg' WHEN minute = date_trunc('minute', block_time) THEN 'minute' WHEN close IS NOT NULL THEN 'asof' ELSE 'none' END AS price_kind FROM f)
SELECT activity_id, chain_id, sym, CAST(coalesce(price_usd, CASE WHEN sym = 'USDX' THEN 1 END, close) AS {_DEC}) AS price, price_kind, CASE WHEN price_kind IN ('minute', 'asof') THEN CAST(floor(epoch(block_time)) AS BIGINT) - CAST(epoch(minute) AS BIGINT) END AS age_s FROM k""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    return prices.valued(activity(spark, d), anchors(spark, d))


@query("j12_summary_always", f"""WITH {ACT}, t AS (SELECT address, count(*) AS rows FROM act GROUP BY 1), e AS (SELECT counterparty_address AS other, count(*) AS n FROM act WHERE address = '0x0' GROUP BY 1), s AS (SELECT count(*) AS addresses, CAST(sum(rows) AS BIGINT) AS rows FROM t) SELECT addresses, rows, other, n FROM s LEFT JOIN e ON true""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    summary = a.groupBy("address").agg(F.count(F.lit(1)).alias("rows")).agg(F.count(F.lit(1)).alias("addresses"), F.sum("rows").alias("rows"))
    edges = a.filter("address = '0x0'").groupBy(F.col("counterparty_address").alias("other")).agg(F.count(F.lit(1)).alias("n"))
    return summary.join(edges, F.lit(True), "left")  # one row on the left, which stays without any edge


@query("j13_batch_counts", f"WITH {ACT}, want AS (SELECT DISTINCT counterparty_address AS address FROM act WHERE counterparty_address <> '') SELECT want.address, count(act.address) AS event_count FROM want LEFT JOIN act USING (address) GROUP BY want.address")
def j13(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return aa.batch_counts(a, a.filter("counterparty_address <> ''").select(F.col("counterparty_address").alias("address")).distinct())


# The search is for one address: here the one with the most rows.
_ROOTS = "roots AS (SELECT address AS root FROM act GROUP BY 1 ORDER BY count(*) DESC, address LIMIT 1)"


@query("j15_shared_counterparties", f"""WITH {ACT}, {_ROOTS}, p AS (SELECT DISTINCT address, counterparty_address AS c FROM act WHERE counterparty_address <> ''), g AS (SELECT address, count(*) AS n FROM p GROUP BY address),
b AS (SELECT x.address AS root, y.address, count(*) AS shared FROM p x JOIN p y USING (c) WHERE x.address IN (SELECT root FROM roots) AND x.address <> y.address GROUP BY ALL HAVING count(*) >= 2)
SELECT root, b.address, shared, ga.n + gr.n - shared AS either, round(shared / (ga.n + gr.n - shared), 6) AS jaccard FROM b JOIN g ga ON ga.address = b.address JOIN g gr ON gr.address = b.root""")
def j15(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return aa.shared_counterparties(a, a.groupBy(F.col("address").alias("root")).count().orderBy(F.desc("count"), "root").select("root").limit(1))


@query("j18_fill_accounts", """WITH acc AS (SELECT account_no AS k, max_by(account_name, row_id) AS name FROM ledger WHERE coalesce(account_name, '') <> '' GROUP BY 1) SELECT row_id, coalesce(nullif(cp_name, ''), acc.name) AS cp_name FROM ledger LEFT JOIN acc ON acc.k = ledger.cp_account""")
def j18(spark: SparkSession, d: str) -> DataFrame:
    from tracewright.runtime import skew_safe_lookup

    led = table(spark, d, "ledger")
    acc = led.filter(F.coalesce("account_name", F.lit("")) != "").groupBy(F.col("account_no").alias("cp_account")).agg(F.max_by("account_name", "row_id").alias("name")).filter("cp_account IS NOT NULL")
    return skew_safe_lookup(led.select("row_id", "cp_account", "cp_name"), acc, ["cp_account"], ["name"]).select("row_id", F.coalesce(F.nullif("cp_name", F.lit("")), F.col("name")).alias("cp_name"))


# Aggregations over activity


@query("a1_profiles", f"""WITH {ACT} SELECT chain_id, address, count(*) AS events, count(DISTINCT tx_hash) + max(CASE WHEN tx_hash IS NULL THEN 1 ELSE 0 END) AS txs, count(DISTINCT tx_hash) FILTER (direction = 'IN') AS in_txs, count(DISTINCT tx_hash) FILTER (direction = 'OUT') AS out_txs,
min(block_time) AS first_seen, max(block_time) AS last_seen, {_z('amount', "direction = 'IN'")} AS in_amount, {_z('amount', "direction = 'OUT'")} AS out_amount FROM act GROUP BY chain_id, address""")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return aa.profiles(activity(spark, d))


@query("a4_daily_trend", f"WITH {ACT} SELECT chain_id, CAST(block_time AS DATE) AS day, count(*) AS rows, count(DISTINCT address) AS addresses FROM act WHERE block_time IS NOT NULL GROUP BY ALL")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return aa.daily_trend(activity(spark, d))


def _conc(view: str = "act") -> str:
    share = lambda v, r, k: f"round(CAST({_z(v, f'{r} <= {k}')} AS DOUBLE) / CAST(nullif({_z(v)}, 0) AS DOUBLE), 6)"
    cols = ", ".join(f"{share(v, r, k)} AS top{k}_{n}_share" for v, r, n in (("i", "ri", "in"), ("o", "ro", "out")) for k in (1, 5, 10))
    return f"""g AS (SELECT chain_id, address, counterparty_address, {_z('amount', "direction = 'IN'")} AS i, {_z('amount', "direction = 'OUT'")} AS o FROM {view} WHERE direction IN ('IN', 'OUT') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chain_id, address ORDER BY i DESC, counterparty_address) AS ri, row_number() OVER (PARTITION BY chain_id, address ORDER BY o DESC, counterparty_address) AS ro FROM g),
conc AS (SELECT chain_id, address, {cols} FROM r GROUP BY chain_id, address)"""


@query("a13_concentration", f"WITH {ACT}, {_conc()} SELECT * FROM conc")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return aa.concentration(activity(spark, d))


_RECENT = ", ".join(f"count(*) FILTER (block_time > {_T} - INTERVAL {h} HOUR AND block_time <= {_T}) AS {n}" for h, n in ((24, "last_day"), (168, "last_week"), (720, "last_month")))


@query("a8_top_counterparties", f"""WITH {ACT} SELECT chain_id, address, counterparty_address, count(DISTINCT tx_hash) AS txs, {_z('amount')} AS amount, row_number() OVER (PARTITION BY chain_id, address ORDER BY count(DISTINCT tx_hash) DESC, {_z('amount')} DESC, counterparty_address) AS rank
FROM act WHERE counterparty_address <> '' GROUP BY chain_id, address, counterparty_address QUALIFY rank <= 10""")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return aa.top_counterparties(activity(spark, d))


_I, _O = _z("amount", "direction = 'IN'"), _z("amount", "direction = 'OUT'")


@query("a9_top_sources", " UNION ALL ".join(f"""SELECT '{w}' AS way, * FROM (WITH {ACT} SELECT chain_id, address, counterparty_address, count(DISTINCT tx_hash) AS txs, {_z('amount')} AS amount, row_number() OVER (PARTITION BY chain_id, address ORDER BY count(DISTINCT tx_hash) DESC, {_z('amount')} DESC, counterparty_address) AS rank
FROM act WHERE counterparty_address <> '' AND direction = '{w}' GROUP BY chain_id, address, counterparty_address QUALIFY rank <= 10)""" for w in ("IN", "OUT")))
def a9(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return aa.top_sources(a, "IN").withColumn("way", F.lit("IN")).unionByName(aa.top_sources(a, "OUT").withColumn("way", F.lit("OUT")))


@query("a8_daily_netflow", f"WITH {ACT} SELECT chain_id, address, CAST(block_time AS DATE) AS day, {_I} AS in_amount, {_O} AS out_amount, CAST({_I} - {_O} AS {_DEC}) AS net FROM act WHERE block_time IS NOT NULL GROUP BY ALL")
def a8n(spark: SparkSession, d: str) -> DataFrame:
    return aa.daily_netflow(activity(spark, d))


@query("a8_token_distribution", f"WITH {ACT} SELECT chain_id, token_address, count(*) AS rows, {_z('amount')} AS amount FROM act GROUP BY ALL")
def a8t(spark: SparkSession, d: str) -> DataFrame:
    return aa.token_distribution(activity(spark, d))


@query("a10_volumes", f"""WITH {ACT} SELECT chain_id, {_I} AS in_amount, {_O} AS out_amount, {_z('usd_value', "direction = 'IN'")} AS in_usd, {_z('usd_value', "direction = 'OUT'")} AS out_usd, {_z('amount', "direction = 'IN' AND token_address = ''")} AS native_in, {_z('amount', "direction = 'OUT' AND token_address = ''")} AS native_out FROM act GROUP BY chain_id""")
def a10(spark: SparkSession, d: str) -> DataFrame:
    return aa.volumes(activity(spark, d))


def _summary(view: str = "act") -> str:
    kinds = ", ".join(
        f"""count(*) FILTER (upper(counterparty_entity_type) = '{k}') AS {k.lower()}_rows, {_z('amount', f"upper(counterparty_entity_type) = '{k}' AND direction = 'IN'")} AS {k.lower()}_in, {_z('amount', f"upper(counterparty_entity_type) = '{k}' AND direction = 'OUT'")} AS {k.lower()}_out"""
        for k in ("CEX", "DEX", "BRIDGE")
    )
    return f"""SELECT chain_id, address, count(*) AS rows, count(*) FILTER (direction = 'IN') AS in_rows, count(*) FILTER (direction = 'OUT') AS out_rows, count(*) FILTER (direction = 'SELF') AS self_rows,
{_z('usd_value', "direction = 'IN'")} AS in_usd, {_z('usd_value', "direction = 'OUT'")} AS out_usd, count(usd_value) AS priced_rows, {kinds} FROM {view} GROUP BY chain_id, address"""


_RANKINGS = {"in_value": "in_amount", "out_value": "out_amount", "rows": "rows", "net": "abs(in_amount - out_amount)"}
_RANKED = " UNION ALL ".join(
    f"SELECT chain_id, address, '{n}' AS ranking, row_number() OVER (w ORDER BY {m} DESC, counterparty_address) AS rank, counterparty_address, in_amount, out_amount, rows, label, round(CAST({m} AS DOUBLE) / nullif(CAST(sum({m}) OVER w AS DOUBLE), 0), 6) AS share FROM g WINDOW w AS (PARTITION BY chain_id, address)"
    for n, m in _RANKINGS.items()
)


@query("a12_counterparty_rankings", f"""WITH {ACT}, g AS (SELECT chain_id, address, counterparty_address, {_I} AS in_amount, {_O} AS out_amount, count(*) AS rows,
max_by(counterparty_label, (coalesce(block_time, TIMESTAMPTZ '0001-01-01 00:00:00+00'), counterparty_label)) FILTER (counterparty_label <> '') AS label FROM act WHERE counterparty_address <> '' GROUP BY ALL),
k AS ({_RANKED}) SELECT * FROM k WHERE rank <= 5""")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return aa.counterparties_v2(activity(spark, d))


def _retention(view: str = "act") -> str:
    left = ", ".join(f"""CAST(greatest({_z('amount', f"direction = 'IN' AND block_time <= {_T} - INTERVAL {h} HOUR")} - {_O}, 0) AS {_DEC}) AS retained_{h}h""" for h in aa.RETENTION_H)
    return f"SELECT chain_id, address, {_I} AS received, {left} FROM {view} WHERE block_time <= {_T} GROUP BY chain_id, address"


@query("a14_retention", f"WITH {ACT} {_retention()}")
def a14(spark: SparkSession, d: str) -> DataFrame:
    return aa.retention(activity(spark, d), _as_of())


_PASS = ", ".join(f"{_z('out_amount', f'age <= {w * 60000000}')} AS w{w}" for w in aa.PASS_MINUTES)
_CAP = ", ".join(f"least(coalesce(w{w}, 0), received) AS passed_{w}m" for w in aa.PASS_MINUTES)
_RAT = ", ".join(f"round(CAST(least(coalesce(w{w}, 0), received) AS DOUBLE) / nullif(CAST(received AS DOUBLE), 0), 6) AS ratio_{w}m" for w in aa.PASS_MINUTES)


@query("a15_pass_through", f"""WITH {ACT}, i AS (SELECT chain_id, address, token_address, block_time, CAST(sum(amount) AS {_DEC}) AS in_amount FROM act WHERE direction = 'IN' AND block_time IS NOT NULL GROUP BY ALL),
o AS (SELECT chain_id, address, token_address, block_time, CAST(sum(amount) AS {_DEC}) AS out_amount FROM act WHERE direction = 'OUT' AND block_time IS NOT NULL GROUP BY ALL),
m AS (SELECT o.chain_id, o.address, out_amount, epoch_us(o.block_time) - epoch_us(i.block_time) AS age FROM o ASOF LEFT JOIN i ON o.chain_id = i.chain_id AND o.address = i.address AND o.token_address = i.token_address AND o.block_time >= i.block_time),
g AS (SELECT chain_id, address, {_PASS} FROM m GROUP BY chain_id, address), r AS (SELECT chain_id, address, CAST(sum(in_amount) AS {_DEC}) AS received FROM i GROUP BY chain_id, address)
SELECT chain_id, address, received, {_CAP}, {_RAT} FROM r LEFT JOIN g USING (chain_id, address)""")
def a15(spark: SparkSession, d: str) -> DataFrame:
    return aa.pass_through(activity(spark, d))


@query("a16_snapshot", f"""WITH {ACT}, seen AS (SELECT * FROM act WHERE block_time <= {_T}), s AS ({_summary('seen')}), {_conc('seen')}, t AS ({_retention('seen')})
SELECT chain_id, address, rows, in_usd, out_usd, conc.* EXCLUDE (chain_id, address), t.* EXCLUDE (chain_id, address) FROM s LEFT JOIN conc USING (chain_id, address) LEFT JOIN t USING (chain_id, address)""")
def a16(spark: SparkSession, d: str) -> DataFrame:
    return aa.snapshot(activity(spark, d), _as_of())


_BAL = f"bal AS (SELECT chain_id, address, token_address, {_I} AS in_amount, {_O} AS out_amount, CAST({_I} - {_O} AS {_DEC}) AS balance FROM act GROUP BY ALL)"


@query("a24_balances", f"WITH {ACT}, {_BAL} SELECT * FROM bal")
def a24(spark: SparkSession, d: str) -> DataFrame:
    return aa.assets(activity(spark, d))


@query("a26_asset_risk", f"""WITH {ACT}, {_BAL}, r AS (SELECT *, coalesce(round(CAST(out_amount AS DOUBLE) / CAST(nullif(in_amount + out_amount, 0) AS DOUBLE), 6), 0) AS out_rate, in_amount > 0 AND CAST(out_amount AS DOUBLE) >= 0.8 * CAST(in_amount AS DOUBLE) AS liquidated FROM bal)
SELECT chain_id, address, token_address, out_rate, liquidated, CASE WHEN liquidated THEN 'high' WHEN out_rate >= 0.4 THEN 'medium' ELSE 'low' END AS level FROM r""")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return aa.asset_risk(aa.assets(activity(spark, d)))


@query("a23_first_seen", f"""WITH {ACT}, r AS (SELECT chain_id, address AS who, 0 AS place, 'address' AS role, * EXCLUDE (chain_id) FROM act UNION ALL SELECT chain_id, counterparty_address, 1, 'counterparty', * EXCLUDE (chain_id) FROM act UNION ALL SELECT chain_id, token_address, 2, 'token', * EXCLUDE (chain_id) FROM act)
SELECT chain_id, who AS address, block_number AS first_block, role, source_provider AS source, coalesce(activity_type IN ('CONTRACT_CREATE', 'CONTRACT_CREATION'), false) AS created FROM r WHERE block_number IS NOT NULL AND who <> '' QUALIFY row_number() OVER (PARTITION BY chain_id, who ORDER BY block_number, NOT coalesce(activity_type IN ('CONTRACT_CREATE', 'CONTRACT_CREATION'), false), place, source_provider NULLS FIRST) = 1""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    return aa.first_seen(activity(spark, d), {"address": "address", "counterparty": "counterparty_address", "token": "token_address"})


@query("a25_amount_thresholds", f"""WITH {ACT}, n AS (SELECT chain_id, token_address, amount, row_number() OVER w AS r, count(*) OVER (PARTITION BY chain_id, token_address) AS n FROM act WHERE amount IS NOT NULL WINDOW w AS (PARTITION BY chain_id, token_address ORDER BY amount)) SELECT chain_id, token_address, amount AS p95 FROM n WHERE r = floor((n - 1) * 0.95::DOUBLE) + 1""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return aa.amount_thresholds(activity(spark, d))


@query("a45_frequency_classes", f"""WITH {ACT}, n AS (SELECT chain_id, address, count(*) AS n FROM act GROUP BY ALL) SELECT CASE WHEN n >= 100 THEN 'very_active' WHEN n >= 20 THEN 'active' WHEN n >= 5 THEN 'regular' ELSE 'rare' END AS class, count(*) AS addresses, CAST(sum(n) AS BIGINT) AS rows FROM n GROUP BY 1""")
def a45(spark: SparkSession, d: str) -> DataFrame:
    return aa.frequency_classes(activity(spark, d))


_FIVE = "five AS (SELECT address FROM act GROUP BY 1 ORDER BY count(*) DESC, address LIMIT 5)"


def _common(way: str) -> str:
    return f"WITH {ACT}, {_FIVE} SELECT counterparty_address, count(DISTINCT address) AS targets, {_z('amount')} AS amount FROM act WHERE direction = '{way}' AND counterparty_address <> '' AND address IN (SELECT address FROM five) GROUP BY 1 HAVING count(DISTINCT address) >= 2 ORDER BY targets DESC, amount DESC, counterparty_address LIMIT 10"


def _five(a: DataFrame) -> DataFrame:
    return a.groupBy("address").count().orderBy(F.desc("count"), "address").limit(5).select("address")  # the targets of the case: five addresses


@query("a41_common_sources", _common("IN"))
def a41(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return aa.common_flows(a, _five(a))


@query("a41_common_sinks", _common("OUT"))
def a41o(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return aa.common_flows(a, _five(a), way="OUT")


@query("a33_large_transfers", f"WITH {ACT} SELECT activity_id, usd_value FROM act WHERE usd_value BETWEEN 100 AND 1000000000000000 ORDER BY usd_value DESC, activity_id LIMIT 10")
def a33(spark: SparkSession, d: str) -> DataFrame:
    return activity(spark, d).filter(F.col("usd_value").between(100, 10**15)).select("activity_id", "usd_value").orderBy(F.desc("usd_value"), "activity_id").limit(10)


_FAMILY = "lower(trim(logo_hash)) AS kin FROM token_metadata_registry QUALIFY row_number() OVER (PARTITION BY chain_id, lower(trim(contract_address)) ORDER BY updated_at DESC, lower(trim(logo_hash)) DESC NULLS LAST) = 1"


@query("a43_family", f"""WITH c AS (SELECT chain_id, lower(trim(contract_address)) AS contract, {_FAMILY}), n AS (SELECT kin, count(*) AS family_size, count(DISTINCT chain_id) AS chains FROM c WHERE kin <> '' GROUP BY kin) SELECT c.chain_id, contract, c.kin, coalesce(family_size, 1) AS family_size, coalesce(chains, 1) AS chains FROM c LEFT JOIN n ON n.kin = c.kin""")
def a43(spark: SparkSession, d: str) -> DataFrame:
    reg = table(spark, d, "token_metadata_registry")
    last = reg.groupBy("chain_id", F.lower(F.trim("contract_address")).alias("contract")).agg(F.max(F.struct("updated_at", F.lower(F.trim("logo_hash")).alias("kin"))).alias("v")).select("chain_id", "contract", F.col("v.kin").alias("kin"))
    return aa.family(last, "kin").select("chain_id", "contract", "kin", "family_size", "chains")


@query("a44_unified_search", f"""WITH {ACT} SELECT kind, label, max(rank) AS rank, count(*) AS n FROM (SELECT 'token' AS kind, name AS label, CASE WHEN lower(name) = 'a' THEN 3 WHEN starts_with(lower(name), 'a') THEN 2 ELSE 1 END AS rank FROM token_metadata_registry WHERE contains(lower(name), 'a')
UNION ALL SELECT 'label', counterparty_label, CASE WHEN lower(counterparty_label) = 'a' THEN 3 WHEN starts_with(lower(counterparty_label), 'a') THEN 2 ELSE 1 END FROM act WHERE contains(lower(counterparty_label), 'a') UNION ALL SELECT 'address', address, CASE WHEN lower(address) = 'a' THEN 3 WHEN starts_with(lower(address), 'a') THEN 2 ELSE 1 END FROM act WHERE contains(lower(address), 'a')) GROUP BY ALL ORDER BY rank DESC, kind, label LIMIT 50""")
def a44(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return relational.search({"token": (table(spark, d, "token_metadata_registry"), "name"), "label": (a, "counterparty_label"), "address": (a, "address")}, "A")


@query("a29_ledger_summary", f"""SELECT w AS way, count(*) AS rows, CAST(sum(v) AS DECIMAL(38,2)) AS total FROM (SELECT {_WAY} AS w, CAST(coalesce(try_cast(regexp_replace(regexp_replace(coalesce(amount, ''), '[,，￥¥元]', '', 'g'), '[^0-9.+-]', '', 'g') AS DOUBLE), 0) AS DECIMAL(18,2)) AS v FROM ledger) GROUP BY 1""")
def a29(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger").select(cl.direction(F.col("direction")).alias("way"), cl.to_number(F.col("amount")).cast("decimal(18,2)").alias("v")).groupBy("way").agg(F.count(F.lit(1)).alias("rows"), F.sum("v").cast("decimal(38,2)").alias("total"))


@query("a27_ledger_graph", """WITH r AS (SELECT DISTINCT account_no AS src, cp_account AS dst, CAST(coalesce(try_cast(regexp_replace(regexp_replace(coalesce(amount, ''), '[,，￥¥元]', '', 'g'), '[^0-9.+-]', '', 'g') AS DOUBLE), 0) AS DECIMAL(18,2)) AS amount, txn_time, txn_serial FROM ledger WHERE account_no <> '' AND cp_account <> '')
SELECT src, dst, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, max(amount) AS largest, round(avg(CAST(amount AS DOUBLE)), 4) AS average, min(txn_time) AS first_t, max(txn_time) AS last_t FROM r GROUP BY ALL""")
def a27(spark: SparkSession, d: str) -> DataFrame:
    return graph.ledger_graph(table(spark, d, "ledger"), F.col("account_no"), F.col("cp_account"), cl.to_number(F.col("amount")))


_LEDGER_EDGES = """r AS (SELECT DISTINCT account_no AS src, cp_account AS dst, CAST(coalesce(try_cast(regexp_replace(regexp_replace(coalesce(amount, ''), '[,，￥¥元]', '', 'g'), '[^0-9.+-]', '', 'g') AS DOUBLE), 0) AS DECIMAL(18,2)) AS amount, txn_time, txn_serial FROM ledger WHERE account_no <> '' AND cp_account <> ''),
g AS (SELECT src, dst, count(*) AS n, CAST(sum(amount) AS DECIMAL(38,2)) AS amount FROM r GROUP BY ALL ORDER BY amount DESC, n DESC, src, dst LIMIT 600)"""


@query("a27_top_nodes", f"WITH {_LEDGER_EDGES} SELECT node, CAST(coalesce(sum(amount) FILTER (NOT o), 0) AS DECIMAL(38,2)) AS total_in, CAST(coalesce(sum(amount) FILTER (o), 0) AS DECIMAL(38,2)) AS total_out, CAST(sum(n) AS BIGINT) AS transfers FROM (SELECT src AS node, true AS o, amount, n FROM g UNION ALL SELECT dst, false, amount, n FROM g) GROUP BY node")
def a27n(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_graph(graph.ledger_graph(table(spark, d, "ledger"), F.col("account_no"), F.col("cp_account"), cl.to_number(F.col("amount"))).select("src", "dst", "n", "amount"))[1]


# Quality


@query("a37_activity_scorecard", f"""WITH {ACT} SELECT chain_id, count(*) AS rows, round(count(*) FILTER (block_time IS NOT NULL) / count(*), 6) AS time_share, round(count(*) FILTER (coalesce(trim(token_symbol), '') <> '') / count(*), 6) AS symbol_share, round(count(*) FILTER (usd_value IS NOT NULL) / count(*), 6) AS usd_share,
round(count(*) FILTER (counterparty_address <> '') / count(*), 6) AS counterparty_share, round(count(*) FILTER (regexp_full_match(lower(address), '0x[0-9a-f]{{40}}')) / count(*), 6) AS address_share FROM act GROUP BY chain_id""")
def a37(spark: SparkSession, d: str) -> DataFrame:
    return quality.activity_scorecard(activity(spark, d))


_HAS = lambda c: f"count(*) FILTER (coalesce(trim({c}), '') <> '')"


@query("a37_contract_scorecard", f"""WITH {ACT}, r AS (SELECT chain_id, lower(trim(contract_address)) AS c, coalesce(is_verified, false) AS v, name, token_standard FROM token_metadata_registry QUALIFY row_number() OVER (PARTITION BY chain_id, c ORDER BY updated_at DESC, v DESC, name DESC NULLS LAST, token_standard DESC NULLS LAST) = 1), m AS (SELECT DISTINCT chain_id, lower(trim(token_address)) AS c FROM act WHERE token_address <> '')
SELECT r.chain_id, count(*) AS contracts, round(count(*) FILTER (v) / count(*), 6) AS verified_share, round(count(*) FILTER (coalesce(trim(name), '') <> '') / count(*), 6) AS named_share, round(count(*) FILTER (coalesce(trim(token_standard), '') <> '') / count(*), 6) AS standard_share, round(count(m.c) / count(*), 6) AS met_share FROM r LEFT JOIN m ON m.chain_id = r.chain_id AND m.c = r.c GROUP BY 1""")
def a37c(spark: SparkSession, d: str) -> DataFrame:
    return quality.contract_scorecard(table(spark, d, "token_metadata_registry"), activity(spark, d))


@query("a37_decoder_scorecard", f"""WITH {ACT}, c AS (SELECT *, coalesce(trim(method_id), '') <> '' AS k, coalesce(trim(method_name), '') <> '' AS nm FROM act) SELECT chain_id, count(*) FILTER (k) AS called, round(count(*) FILTER (k AND nm) / nullif(count(*) FILTER (k), 0), 6) AS named_share, round(count(*) FILTER (k AND activity_type <> 'CONTRACT_CALL') / nullif(count(*) FILTER (k), 0), 6) AS typed_share, count(DISTINCT lower(method_id)) FILTER (k AND NOT nm) AS unnamed_methods FROM c GROUP BY 1""")
def a37d(spark: SparkSession, d: str) -> DataFrame:
    return quality.decoder_scorecard(activity(spark, d))


@query("a37_price_scorecard", f"""WITH {ANC}, c AS (SELECT chain_id, close IS NOT NULL AS k, open IS NOT NULL AND coalesce(low <= least(open, close) AND greatest(open, close) <= high, false) AS s, coalesce(trim(source), '') <> '' AS t, close FROM anc) SELECT chain_id, count(*) AS minutes, round(count(*) FILTER (k) / count(*), 6) AS close_share, round(count(*) FILTER (s) / count(*), 6) AS sound_share, round(count(*) FILTER (t) / count(*), 6) AS source_share, round((count(*) FILTER (k) + count(*) FILTER (s) + count(*) FILTER (t)) / (3 * count(*)), 6) AS overall FROM c GROUP BY 1""")
def a37p(spark: SparkSession, d: str) -> DataFrame:
    return quality.price_scorecard(anchors(spark, d))


@query("a37_token_scorecard", f"""SELECT chain_id, count(*) AS rows, round({_HAS('name')} / count(*), 6) AS name_share, round({_HAS('symbol')} / count(*), 6) AS symbol_share, round({_HAS('decimals')} / count(*), 6) AS decimals_share, round({_HAS('logo_uri')} / count(*), 6) AS logo_share,
round(count(*) FILTER (is_verified) / count(*), 6) AS verified_share, round(({_HAS('name')} + {_HAS('symbol')} + {_HAS('decimals')} + {_HAS('logo_uri')}) / (4 * count(*)), 6) AS overall FROM token_metadata_registry GROUP BY chain_id""")
def a37t(spark: SparkSession, d: str) -> DataFrame:
    return quality.token_scorecard(table(spark, d, "token_metadata_registry"))


@query("a39_validate_chunk", """WITH c AS (SELECT chain_id, block_number, epoch(block_time) AS bt, tx_hash, event_index, token_address, address, counterparty_address, CAST(amount AS VARCHAR) AS v FROM address_activity)
SELECT count(*) AS rows, count(DISTINCT (chain_id, block_number, tx_hash, event_index)) AS keys, min(block_number) AS first_block, max(block_number) AS last_block, count(*) FILTER (block_number IS NULL) AS null_block, count(*) FILTER (NOT coalesce(bt > 0, false)) AS bad_time,
count(*) FILTER (NOT coalesce(regexp_full_match(tx_hash, '0x[0-9a-f]{64}'), false)) AS bad_hash, count(*) FILTER (NOT coalesce(regexp_full_match(token_address, '0x[0-9a-f]{40}'), false)) AS bad_token, count(*) FILTER (NOT coalesce(regexp_full_match(address, '0x[0-9a-f]{40}'), false)) AS bad_from,
count(*) FILTER (NOT coalesce(regexp_full_match(counterparty_address, '0x[0-9a-f]{40}'), false)) AS bad_to, count(*) FILTER (NOT coalesce(regexp_full_match(v, '[0-9]+'), false)) AS bad_value FROM c""")
def a39(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "address_activity")
    return quality.validate_chunk(a.select("chain_id", "block_number", F.unix_seconds("block_time").alias("block_timestamp"), F.col("tx_hash").alias("transaction_hash"), F.col("event_index").alias("log_index"), "token_address", F.col("address").alias("from_address"), F.col("counterparty_address").alias("to_address"), F.col("amount").cast("string").alias("value_raw")))


# Windows, pages and reductions


@query("t1_capped", "SELECT o_orderkey, o_totalprice, true AS truncated FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def t1(spark: SparkSession, d: str) -> DataFrame:
    return relational.capped(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 100)


@query("t2_keyset_page", "SELECT event_id, user_id FROM events WHERE (user_id, event_id) < (50, 0) ORDER BY user_id DESC, event_id DESC LIMIT 200")
def t2(spark: SparkSession, d: str) -> DataFrame:
    return relational.keyset_page(table(spark, d, "events").select("user_id", "event_id"), ["user_id", "event_id"], [50, 0], 200).select("event_id", "user_id")


@query("t3_offset_page", "SELECT c_custkey, c_name, (SELECT count(*) FROM customer) AS total_rows FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50")
def t3(spark: SparkSession, d: str) -> DataFrame:
    return relational.offset_page(table(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"], 50, 25)


_EDGES = f"{TRA}, e AS (SELECT src, dst, token, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, count(*) AS n, min(t) AS first_t, max(t) AS last_t FROM tra GROUP BY ALL)"


@query("t5_cover_share", f"""WITH {_EDGES}, r AS (SELECT *, coalesce(sum(amount) OVER (ORDER BY amount DESC, src, dst, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, sum(amount) OVER () AS total FROM e) SELECT src, dst, token, amount FROM r WHERE prior < total * 0.8""")
def t5(spark: SparkSession, d: str) -> DataFrame:
    return relational.cover_share(graph.edges_of(transfers(spark, d)), "amount", [F.desc("amount"), F.col("src"), F.col("dst"), F.col("token")], 0.8).select("src", "dst", "token", "amount")


@query("t6_top_per_group", f"WITH {_EDGES} SELECT src, dst, token, amount, row_number() OVER (PARTITION BY src ORDER BY amount DESC, dst, token) AS rank FROM e QUALIFY rank <= 3")
def t6(spark: SparkSession, d: str) -> DataFrame:
    return relational.top_per_group(graph.edges_of(transfers(spark, d)).select("src", "dst", "token", "amount"), ["src"], [F.desc("amount"), "dst", "token"], 3)


@query("w5_partition_totals", f"WITH {_EDGES} SELECT src, dst, token, amount, CAST(sum(amount) OVER (PARTITION BY src, dst) AS DECIMAL(38,2)) AS pair_total FROM e")
def w5(spark: SparkSession, d: str) -> DataFrame:
    e = graph.edges_of(transfers(spark, d)).select("src", "dst", "token", "amount")
    return e.join(e.groupBy("src", "dst").agg(F.sum("amount").cast("decimal(38,2)").alias("pair_total")), ["src", "dst"])


_SIGNED = "CASE direction WHEN 'IN' THEN amount WHEN 'OUT' THEN -amount ELSE 0 END"
_ORDERED = "PARTITION BY chain_id, address, token_address ORDER BY block_time, block_number NULLS FIRST, tx_hash NULLS FIRST, event_index NULLS FIRST, activity_id ROWS UNBOUNDED PRECEDING"


@query("w7_running_balance", f"""WITH {ACT}, b AS (SELECT *, sum({_SIGNED}) OVER ({_ORDERED}) AS balance FROM act WHERE block_time IS NOT NULL) SELECT activity_id, CAST(coalesce(balance, 0) AS {_DEC}) AS balance, CAST(greatest(max(coalesce(balance, 0)) OVER ({_ORDERED}), 0) AS {_DEC}) AS high FROM b""")
def w7(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0).cast("decimal(38,18)")
    a = activity(spark, d).filter("block_time IS NOT NULL").select("activity_id", "chain_id", "address", "token_address", "block_time", "block_number", "tx_hash", "event_index", "direction", F.coalesce("amount", zero).alias("amount"))
    came, went = F.when(F.col("direction") == "IN", F.col("amount")).otherwise(zero), F.when(F.col("direction") == "OUT", F.col("amount")).otherwise(zero)
    r = relational.running(a, ["chain_id", "address", "token_address"], ["block_time", "block_number", "tx_hash", "event_index", "activity_id"], {"came": came, "went": went}, highs={"high": ("came", "went")})
    return r.select("activity_id", (F.col("came") - F.col("went")).cast("decimal(38,18)").alias("balance"), "high")


@query("w9_synthetic_index", f"WITH {TRA} SELECT tx, token, src, dst, amount, dense_rank() OVER (PARTITION BY tx, token ORDER BY src, dst, amount) - 1 + 1000000 AS synthetic_index FROM tra")
def w9(spark: SparkSession, d: str) -> DataFrame:
    return relational.dense_index(transfers(spark, d).select("tx", "token", "src", "dst", "amount"), ["tx", "token"], ["src", "dst", "amount"], 1_000_000)


@query("w10_gaps", f"""WITH {ANC}, m AS (SELECT DISTINCT chain_id, symbol, quote_symbol, CAST(epoch(minute) / 60 AS BIGINT) AS b FROM anc), n AS (SELECT *, lead(b) OVER (PARTITION BY chain_id, symbol, quote_symbol ORDER BY b) AS nx FROM m)
SELECT chain_id, symbol, quote_symbol, b + 1 AS gap_from, nx - 1 AS gap_to, nx - b - 1 AS missing FROM n WHERE nx - b > 1""")
def w10(spark: SparkSession, d: str) -> DataFrame:
    b = anchors(spark, d).select("chain_id", "symbol", "quote_symbol", F.floor(F.unix_seconds("minute") / 60).alias("b"))
    return relational.gaps(b, ["chain_id", "symbol", "quote_symbol"], "b", 1)


@query("w11_merge_ranges", """WITH r AS (SELECT l_suppkey AS k, CAST(l_partkey AS BIGINT) AS lo, CAST(l_partkey + l_quantity AS BIGINT) AS hi FROM lineitem), s AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS st FROM r),
g AS (SELECT *, sum(st) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT k, min(lo) AS lo, max(hi) AS hi, count(*) AS ranges FROM g GROUP BY k, g""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity")).cast("bigint").alias("hi"))
    return relational.merge_ranges(r, ["k"], "lo", "hi")


# Prices


@query("a35_candles", f"""WITH {ANC} SELECT chain_id, symbol, quote_symbol, to_timestamp(floor(epoch(minute) / 900) * 900) AS bucket, arg_min(open, minute) AS open, max(high) AS high, min(low) AS low, arg_max(close, minute) AS close, CAST(sum(volume_base) AS {_DEC}) AS volume, CAST(sum(trade_count) AS BIGINT) AS trades FROM anc WHERE close IS NOT NULL GROUP BY ALL""")
def a35(spark: SparkSession, d: str) -> DataFrame:
    return prices.candles(anchors(spark, d), 15)


@query("a36_coverage", f"""WITH {ANC} SELECT chain_id, symbol, quote_symbol, min(minute) AS first_minute, max(minute) AS last_minute, count(DISTINCT minute) AS minutes, CAST(coalesce(sum(trade_count), 0) AS BIGINT) AS trades, round(count(DISTINCT minute) / ((epoch(max(minute)) - epoch(min(minute))) / 60 + 1), 6) AS ratio FROM anc GROUP BY ALL""")
def a36(spark: SparkSession, d: str) -> DataFrame:
    return prices.coverage(anchors(spark, d))


@query("f5_price_as_of", f"WITH {ANC} SELECT chain_id, symbol, quote_symbol, minute, close, source FROM anc WHERE minute <= {_T} AND close IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chain_id, symbol, quote_symbol ORDER BY minute DESC, ingested_at DESC, anchor_id DESC) = 1")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return prices.last_price(anchors(spark, d), _as_of())


@query("a34_minute_bars", """WITH s AS (SELECT 'T' || (l_partkey % 7) AS token, date_trunc('minute', l_shipdate) AS minute, l_shipdate AS t, l_extendedprice / l_quantity AS price, l_extendedprice AS usd, l_suppkey AS pool, (l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem),
n AS (SELECT *, count(*) OVER (PARTITION BY token, minute) AS n, row_number() OVER (PARTITION BY token, minute ORDER BY price, seq) AS r FROM s), m AS (SELECT *, max(price) FILTER (r = floor(n / 2) + 1) OVER (PARTITION BY token, minute) AS med FROM n), k AS (SELECT * FROM m WHERE abs(price - med) <= med * 0.2)
SELECT token, minute, arg_min(price, (t, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (t, seq)) AS close, round(sum(price * usd) / sum(usd), 6) AS vwap, round(sum(usd), 2) AS usd_volume, count(*) AS trades, count(DISTINCT pool) AS pools FROM k GROUP BY ALL""")
def a34(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = table(spark, d, "lineitem").select(F.concat(F.lit("T"), (c("l_partkey") % 7).cast("string")).alias("token"), c("l_shipdate").alias("t"), (c("l_extendedprice") / c("l_quantity")).alias("price"), c("l_extendedprice").alias("usd"), c("l_suppkey").alias("pool"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    return prices.minute_bars(s)


# Graphs


@query("a30_edges", f"WITH {_EDGES} SELECT * FROM e")
def a30(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_of(transfers(spark, d))


@query("g1_degrees", f"WITH {_EDGES} SELECT node, count(*) AS degree, CAST(sum(amount) AS DECIMAL(38,2)) AS weighted FROM (SELECT src AS node, amount FROM e UNION ALL SELECT dst, amount FROM e) GROUP BY node")
def g1(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(graph.edges_of(transfers(spark, d)))


_STATS = f"""{_EDGES}, st AS (SELECT node, CAST(coalesce(sum(amount) FILTER (NOT o), 0) AS DECIMAL(38,2)) AS total_in, CAST(coalesce(sum(amount) FILTER (o), 0) AS DECIMAL(38,2)) AS total_out, count(*) FILTER (NOT o) AS in_edges, count(*) FILTER (o) AS out_edges, CAST(sum(n) AS BIGINT) AS transfers
FROM (SELECT src AS node, true AS o, amount, n FROM e UNION ALL SELECT dst, false, amount, n FROM e) GROUP BY node)"""


@query("a30_node_stats", f"WITH {_STATS} SELECT * FROM st")
def a30n(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_stats(graph.edges_of(transfers(spark, d)))


@query("g4_patterns", f"WITH {_STATS} SELECT node, CASE WHEN in_edges >= 10 AND out_edges >= 10 THEN 'hub' WHEN in_edges >= 10 AND in_edges > 2 * out_edges THEN 'sink' ELSE 'spreader' END AS pattern, in_edges, out_edges FROM st WHERE in_edges >= 10 AND (out_edges >= 10 OR in_edges > 2 * out_edges) OR out_edges >= 10 AND out_edges > 2 * in_edges")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return graph.patterns(graph.node_stats(graph.edges_of(transfers(spark, d))))


@query("g2_pagerank", f"""WITH RECURSIVE {_EDGES}, l AS (SELECT a, b, count(*) AS w FROM (SELECT src AS a, dst AS b FROM e UNION ALL SELECT dst, src FROM e) GROUP BY ALL), s AS (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM l), n AS (SELECT count(DISTINCT a) AS n FROM l),
r(i, node, rank) AS (SELECT 0, node, 1.0::DOUBLE / n FROM (SELECT DISTINCT a AS node FROM l), n UNION ALL SELECT i + 1, s.b, sum(rank * share) * 0.85::DOUBLE + 0.15::DOUBLE / any_value(n) FROM r JOIN s ON s.a = r.node, n WHERE i < 100 GROUP BY i, s.b) SELECT node, round(rank, 6) AS rank FROM r WHERE i = 100""")
def g2(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(graph.edges_of(transfers(spark, d)), iterations=100)


@query("g3_components", f"""WITH RECURSIVE {TRA}, e AS (SELECT DISTINCT src AS a, dst AS b FROM tra UNION SELECT DISTINCT dst, src FROM tra),
r(node, c) AS (SELECT a, a FROM e UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a) SELECT node, min(c) AS component FROM r GROUP BY node""")
def g3(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(transfers(spark, d))


@query("g5_within_hops", f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src AS a, dst AS b FROM e WHERE src <> dst UNION SELECT DISTINCT dst, src FROM e WHERE src <> dst), r(node, depth) AS (SELECT 'A5', 0 UNION SELECT s.b, r.depth + 1 FROM r JOIN s ON r.node = s.a WHERE r.depth < 2) SELECT node, min(depth) AS depth FROM r GROUP BY node""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    return graph.within_hops(transfers(spark, d), spark.createDataFrame([("A5",)], "root string"), 2)


def _tree(hops: int) -> str:
    """The tree of first reaches from A5: each level's parents are the largest edges, then the last by name."""
    parts = [f"WITH {_EDGES}, s AS (SELECT src, dst, CAST(sum(amount) AS DECIMAL(38,2)) AS a FROM e WHERE src <> dst GROUP BY ALL), t0 AS (SELECT 'A5' AS node, 0 AS depth, NULL::VARCHAR AS parent, NULL::DECIMAL(38,2) AS amount)"]
    for k in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT node FROM t{i}" for i in range(k))
        parts.append(f"t{k} AS (SELECT s.dst AS node, {k} AS depth, s.src AS parent, s.a AS amount FROM s JOIN t{k - 1} ON t{k - 1}.node = s.src WHERE s.dst NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY s.dst ORDER BY s.a DESC, s.src DESC) = 1)")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(hops + 1))


@query("g7_trace_tree", _tree(4))
def g7(spark: SparkSession, d: str) -> DataFrame:
    return graph.trace_tree(graph.edges_of(transfers(spark, d)), "A5", 4)


@query("g12_round_trips", f"""WITH {TRA}, e AS (SELECT DISTINCT src, dst FROM tra WHERE src <> dst) SELECT a.src || '>' || a.dst || '>' || a.src AS cycle, 2 AS hops FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst
UNION ALL SELECT a.src || '>' || a.dst || '>' || b.dst || '>' || a.src, 3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst""")
def g12(spark: SparkSession, d: str) -> DataFrame:
    return graph.round_trips(transfers(spark, d))


@query("g13_conversions", f"""WITH {TRA} SELECT i.dst AS node, i.tx, i.log_index, i.token AS in_token, i.amount AS in_amount, i.block AS in_block, max((o.amount, o.token, o.block))[1] AS out_amount, max((o.amount, o.token, o.block))[2] AS out_token
FROM tra i JOIN tra o ON o.src = i.dst AND o.token <> i.token AND abs(o.block - i.block) <= 20 WHERE i.src <> i.dst AND o.src <> o.dst GROUP BY ALL""")
def g13(spark: SparkSession, d: str) -> DataFrame:
    return graph.conversions(transfers(spark, d))


@query("g14_merge_edges", f"WITH {_EDGES} SELECT src, dst, token, amount, n, first_t, last_t FROM e")
def g14(spark: SparkSession, d: str) -> DataFrame:
    t = transfers(spark, d)
    early = F.col("t") < F.lit("1998-06-01").cast("timestamp_ntz")
    return graph.merge_edges(graph.edges_of(t.filter(early)), graph.edges_of(t.filter(~early)))  # two chunks give what the whole gives


@query("g16_reciprocal", f"""WITH {_EDGES} SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(sum(amount) FILTER (src < dst) AS DECIMAL(38,2)) AS a_to_b, CAST(sum(amount) FILTER (src > dst) AS DECIMAL(38,2)) AS b_to_a FROM e WHERE src <> dst GROUP BY ALL HAVING count(*) FILTER (src < dst) > 0 AND count(*) FILTER (src > dst) > 0""")
def g16(spark: SparkSession, d: str) -> DataFrame:
    return graph.reciprocal(graph.edges_of(transfers(spark, d)))


@query("g16_shortest_path", f"""WITH RECURSIVE {_EDGES}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), r(node, depth) AS (SELECT 'A5', 0 UNION SELECT s.dst, r.depth + 1 FROM r JOIN s ON r.node = s.src WHERE r.depth < 3) SELECT 'A5' AS source, 'A9' AS target, (SELECT min(depth) FROM r WHERE node = 'A9') AS hops""")
def g16s(spark: SparkSession, d: str) -> DataFrame:
    return graph.shortest_hops(transfers(spark, d), "A5", "A9", most=3)


@query("g17_sweeps", f"""WITH {TRA}, g AS (SELECT src, dst, count(*) AS n FROM tra WHERE src <> dst GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) = 1)
SELECT src, dst AS destination, n AS most, round(n / total, 6) AS share, round(n / total, 6) >= 0.6 AS sweep FROM k""")
def g17(spark: SparkSession, d: str) -> DataFrame:
    return graph.sweeps(transfers(spark, d))


@query("g17_sweep_clusters", f"""WITH {ACT}, g AS (SELECT address AS src, counterparty_address AS dst, count(*) AS n FROM act WHERE direction = 'OUT' AND counterparty_address <> '' AND address <> counterparty_address GROUP BY ALL), k AS (SELECT *, sum(n) OVER (PARTITION BY src) AS total FROM g QUALIFY row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) = 1)
SELECT dst AS destination, count(*) AS members, CAST(sum(n) AS BIGINT) AS transfers, min(src) AS first_member FROM k WHERE round(n / total, 6) >= 0.6 GROUP BY dst HAVING count(*) >= 2""")
def g17c(spark: SparkSession, d: str) -> DataFrame:
    moves = activity(spark, d).filter("direction = 'OUT' AND counterparty_address <> ''").select(F.col("address").alias("src"), F.col("counterparty_address").alias("dst"))
    return graph.sweep_clusters(graph.sweeps(moves))


@query("g17_top_funders", f"WITH {TRA}, g AS (SELECT dst, src, count(*) AS n FROM tra WHERE src <> dst GROUP BY ALL) SELECT dst, n, src AS funder FROM g QUALIFY row_number() OVER (PARTITION BY dst ORDER BY n DESC, src) = 1")
def g17f(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_funders(transfers(spark, d))


@query("g18_timeline", f"WITH {TRA} SELECT * FROM tra WHERE src = 'A5' OR dst = 'A5' ORDER BY t, tx, log_index, src, dst, token, amount LIMIT 100")
def g18(spark: SparkSession, d: str) -> DataFrame:
    return graph.case_timeline(transfers(spark, d), (F.col("src") == "A5") | (F.col("dst") == "A5"))


@query("g18_case_graph", f"WITH {TRA}, f AS (SELECT * FROM tra WHERE src = 'A5' OR dst = 'A5' ORDER BY t, tx, log_index, src, dst, token, amount LIMIT 200) SELECT src, dst, token, CAST(sum(amount) AS DECIMAL(38,2)) AS amount, count(*) AS n FROM f GROUP BY ALL")
def g18g(spark: SparkSession, d: str) -> DataFrame:
    return graph.case_graph(transfers(spark, d), (F.col("src") == "A5") | (F.col("dst") == "A5")).select("src", "dst", "token", "amount", "n")


# Lots and scores


def _lots(events: str, key: str, order: str, come: str, go: str) -> str:
    """Tables run (events with lot and use intervals) and pairs (what each lot gave each use) of ``events``: key columns, order, amount."""
    w = f"PARTITION BY {key} ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    same = " AND ".join(f"l.{k.strip()} IS NOT DISTINCT FROM u.{k.strip()}" for k in key.split(","))
    return f"""cum AS (SELECT *, coalesce(sum(amount) FILTER ({come}) OVER ({w}), 0) AS ci, coalesce(sum(amount) FILTER ({go}) OVER ({w}), 0) AS co FROM {events}),
sho AS (SELECT *, greatest(max(co - ci) OVER ({w}), 0) AS sh FROM cum), shb AS (SELECT *, coalesce(lag(sh) OVER (PARTITION BY {key} ORDER BY {order}), 0) AS sb FROM sho),
run AS (SELECT *, CASE WHEN {come} THEN ci - amount END AS lf, CASE WHEN {come} THEN ci END AS lt, CASE WHEN {go} THEN co - amount - sb END AS uf, CASE WHEN {go} THEN co - sh END AS ut, CASE WHEN {go} THEN sh - sb END AS un FROM shb),
pairs AS (SELECT l.* EXCLUDE (lf, lt, uf, ut), u AS used, least(l.lt, u.ut) - greatest(l.lf, u.uf) AS q FROM run l JOIN run u ON {same} AND l.lt > l.lf AND u.ut > u.uf AND greatest(l.lf, u.uf) < least(l.lt, u.ut))"""


_KEPT_H, _PASS_M = (1, 6, 24, 168, 720), (5, 15, 60, 360, 1440)
_OLD = lambda s: f"block_time + INTERVAL {s} SECOND <= {_T}"
_GONE = ", ".join([f"{_z('q', f'age <= {h * 3600000000} AND {_OLD(h * 3600)}')} AS gone_{h}h" for h in _KEPT_H] + [f"{_z('q', f'age <= {m * 60000000} AND {_OLD(m * 60)}')} AS passed_{m}m" for m in _PASS_M])
_RIPE = ", ".join(_z("amount", f"direction = 'IN' AND {_OLD(h * 3600)}") + f" AS ripe_{h}h" for h in _KEPT_H)
_LEFT = ", ".join([f"CAST(ripe_{h}h - coalesce(gone_{h}h, 0) AS {_DEC}) AS retained_{h}h" for h in _KEPT_H] + [f"CAST(coalesce(passed_{m}m, 0) AS {_DEC}) AS passed_{m}m" for m in _PASS_M])


@query("f1_flow_windows", f"""WITH {ACT}, ev AS (SELECT chain_id, address, token_address, block_time, block_number, tx_hash, event_index, activity_id, direction, amount FROM act WHERE direction IN ('IN', 'OUT') AND amount > 0 AND block_time <= {_T}),
{_lots('ev', 'chain_id, address, token_address', 'block_time, block_number NULLS FIRST, tx_hash NULLS FIRST, event_index NULLS FIRST, activity_id', "direction = 'IN'", "direction = 'OUT'")},
g AS (SELECT chain_id, address, token_address, {_z('q')} AS matched, {_GONE} FROM (SELECT *, epoch_us(used.block_time) - epoch_us(block_time) AS age FROM pairs) GROUP BY ALL), b AS (SELECT chain_id, address, token_address, {_z('amount', "direction = 'IN'")} AS received, {_z('un')} AS opening, {_RIPE} FROM run GROUP BY ALL)
SELECT b.chain_id, b.address, b.token_address, received, CAST(coalesce(matched, 0) AS {_DEC}) AS matched, opening, {_LEFT} FROM b LEFT JOIN g ON g.chain_id = b.chain_id AND g.address = b.address AND g.token_address IS NOT DISTINCT FROM b.token_address""")
def f1(spark: SparkSession, d: str) -> DataFrame:
    return fifo.flow_windows(activity(spark, d), _as_of())


_BUY, _COME, _SELL, _GO = (", ".join(f"'{x}'" for x in xs) for xs in (fifo.BUYS, (*fifo.BUYS, *fifo.UNKNOWN_INS), fifo.SELLS, (*fifo.SELLS, *fifo.MOVES_OUT)))


@query("f2_pnl", f"""WITH raw AS (SELECT l_partkey % 97 AS token, l_shipdate AS t, l_orderkey AS tx, l_linenumber AS i, l_partkey AS p, l_suppkey AS s, CASE WHEN l_returnflag = 'A' THEN 'DEX_BUY' WHEN l_returnflag = 'N' THEN 'DEX_SELL' WHEN l_linestatus = 'O' THEN 'TRANSFER_IN' ELSE 'TRANSFER_OUT' END AS type,
CAST(l_quantity AS DECIMAL(18,2)) AS amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS usd, CAST(l_tax AS DECIMAL(18,2)) AS gas FROM lineitem), ev AS (SELECT *, CASE WHEN type IN ({_BUY}) THEN (CAST(usd AS DOUBLE) + CAST(coalesce(gas, 0) AS DOUBLE)) / CAST(amount AS DOUBLE) END AS unit FROM raw WHERE amount > 0 AND type IN ({_COME}, {_GO})),
{_lots('ev', 'token', 't, tx, i, p, s', f"type IN ({_COME})", f"type IN ({_GO})")},
g AS (SELECT token, sum(q) FILTER (sale AND unit IS NOT NULL) AS known_sold, sum(q / ua * uu) FILTER (sale AND unit IS NOT NULL) AS proceeds, sum(q / ua * ug) FILTER (sale AND unit IS NOT NULL) AS gas, sum(q * unit) FILTER (sale) AS cost, sum(q) AS used, sum(q) FILTER (unit IS NOT NULL) AS known_used, sum(q * unit) AS cost_used
  FROM (SELECT token, unit, CAST(q AS DOUBLE) AS q, used.type IN ({_SELL}) AS sale, CAST(used.amount AS DOUBLE) AS ua, CAST(used.usd AS DOUBLE) AS uu, CAST(used.gas AS DOUBLE) AS ug FROM pairs) GROUP BY token),
b AS (SELECT token, coalesce(sum(CAST(amount AS DOUBLE)) FILTER (type IN ({_SELL})), 0) AS sold, coalesce(sum(CAST(amount AS DOUBLE)) FILTER (type IN ({_COME})), 0) AS came, coalesce(sum(CAST(amount AS DOUBLE)) FILTER (type IN ({_COME}) AND unit IS NOT NULL), 0) AS known_came, coalesce(sum(amount * unit) FILTER (type IN ({_COME})), 0) AS cost_came FROM run GROUP BY token)
SELECT token, sold + 0 AS sold, known_sold + 0 AS known_sold, known_ratio, proceeds + 0 AS proceeds, gas + 0 AS gas, cost + 0 AS cost, pnl + 0 AS pnl, position + 0 AS position, known_position + 0 AS known_position, remaining_cost + 0 AS remaining_cost FROM (SELECT token, round(sold, 4) AS sold, round(coalesce(known_sold, 0), 4) AS known_sold, round(coalesce(known_sold / nullif(sold, 0), 0), 4) AS known_ratio, round(coalesce(proceeds, 0), 4) AS proceeds, round(coalesce(gas, 0), 4) AS gas, round(coalesce(cost, 0), 4) AS cost, round(coalesce(proceeds, 0) - coalesce(cost, 0) - coalesce(gas, 0), 4) AS pnl,
round(came - coalesce(used, 0), 4) AS position, round(known_came - coalesce(known_used, 0), 4) AS known_position, round(cost_came - coalesce(cost_used, 0), 4) AS remaining_cost FROM b LEFT JOIN g USING (token))""")
def f2(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    kind = F.when(c("l_returnflag") == "A", "DEX_BUY").when(c("l_returnflag") == "N", "DEX_SELL").when(c("l_linestatus") == "O", "TRANSFER_IN").otherwise("TRANSFER_OUT")
    e = table(spark, d, "lineitem").select((c("l_partkey") % 97).alias("token"), c("l_shipdate").alias("t"), c("l_orderkey").alias("tx"), c("l_linenumber").alias("i"), c("l_partkey").alias("p"), c("l_suppkey").alias("s"), kind.alias("type"), c("l_quantity").cast("decimal(18,2)").alias("amount"), c("l_extendedprice").cast("decimal(18,2)").alias("usd_value"), c("l_tax").cast("decimal(18,2)").alias("gas_usd"))
    return fifo.pnl(e, ["token"], ["t", "tx", "i", "p", "s"])


@query("f3_swap_events", """SELECT address, tx_hash, token, amount, type, position_index, gas_usd FROM (
SELECT 'C' || l_suppkey AS address, l_orderkey AS tx_hash, l_partkey AS token, l_quantity AS amount, 'DEX_SELL' AS type, l_linenumber * 2 AS position_index, l_tax AS gas_usd FROM lineitem WHERE l_returnflag IN ('A', 'R') UNION ALL SELECT 'C' || l_suppkey, l_orderkey, l_suppkey, l_extendedprice, 'DEX_BUY', l_linenumber * 2 + 1, 0 FROM lineitem WHERE l_returnflag IN ('A', 'R'))""")
def f3(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    s = table(spark, d, "lineitem").select(F.concat(F.lit("C"), c("l_suppkey").cast("string")).alias("address"), c("l_shipdate").alias("t"), c("l_orderkey").alias("tx_hash"), c("l_extendedprice").alias("usd_value"), c("l_linenumber").alias("event_index"), c("l_partkey").alias("token_in"), c("l_quantity").alias("amount_in"), c("l_suppkey").alias("token_out"), c("l_extendedprice").alias("amount_out"), c("l_tax").alias("gas_usd"), F.when(c("l_returnflag").isin("A", "R"), "HIGH").otherwise("LOW").alias("confidence"))
    return fifo.swap_events(s).drop("t", "usd_value")


@query("f7_reconcile", f"""WITH {ACT}, b AS (SELECT chain_id, address, token_address, {_I} - {_O} AS v FROM act GROUP BY ALL), p AS (SELECT chain_id, address, token_address, {_I} - {_O} AS v FROM act WHERE block_time <= {_T} GROUP BY ALL)
SELECT chain_id, address, token_address, CAST(p.v AS {_DEC}) AS left_value, CAST(b.v AS {_DEC}) AS right_value, CAST(coalesce(b.v, 0) - coalesce(p.v, 0) AS {_DEC}) AS difference FROM p FULL JOIN b USING (chain_id, address, token_address) WHERE p.v IS DISTINCT FROM b.v""")
def f7(spark: SparkSession, d: str) -> DataFrame:
    a, k = activity(spark, d), ["chain_id", "address", "token_address"]
    snapshot = lambda rows: aa.assets(rows).select(*k, F.col("balance").alias("v"))
    out = quality.reconcile(snapshot(a.filter(F.col("block_time") <= _as_of())), snapshot(a), k, "v")
    return out.withColumn("difference", F.col("difference").cast("decimal(38,18)"))


@query("r2_screening", f"""WITH {ACT}, {_conc()}, p AS (SELECT chain_id, address, count(*) AS events, count(DISTINCT tx_hash) AS txs FROM act GROUP BY ALL), j AS (SELECT p.*, greatest(coalesce(top1_in_share, 0), coalesce(top1_out_share, 0)) AS top FROM p LEFT JOIN conc USING (chain_id, address)),
s AS (SELECT *, CASE WHEN events >= 100 THEN 45 WHEN events >= 30 THEN 25 ELSE 0 END + CASE WHEN top >= 0.8 THEN 35 WHEN top >= 0.5 THEN 20 ELSE 0 END + CASE WHEN txs >= 50 THEN 20 ELSE 0 END AS score FROM j)
SELECT chain_id, address, score, CASE WHEN events < 3 THEN 'insufficient_data' WHEN score >= 70 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS level FROM s""")
def r2(spark: SparkSession, d: str) -> DataFrame:
    a = activity(spark, d)
    return scoring.screening(aa.profiles(a), aa.concentration(a))


@query("r5_risk_scenario", f"""WITH {ACT}, n AS (SELECT *, row_number() OVER (PARTITION BY chain_id, address ORDER BY amount) AS r, count(*) OVER (PARTITION BY chain_id, address) AS n FROM act WHERE direction = 'IN' AND amount IS NOT NULL), p AS (SELECT chain_id, address, amount AS p90 FROM n WHERE r = floor((n - 1) * 0.9::DOUBLE) + 1)
SELECT chain_id, address, 'inflow' AS kind, NULL::INT AS rank, activity_id, counterparty_address, amount, p90 AS threshold, NULL::BIGINT AS times FROM act JOIN p USING (chain_id, address) WHERE direction = 'IN' AND amount >= p90
UNION ALL SELECT chain_id, address, 'outflow', row_number() OVER (PARTITION BY chain_id, address ORDER BY block_number NULLS LAST, tx_hash NULLS LAST, event_index NULLS LAST, activity_id) AS k, activity_id, counterparty_address, amount, NULL, NULL FROM act WHERE direction = 'OUT' QUALIFY k <= 5
UNION ALL SELECT chain_id, address, 'spread', row_number() OVER (PARTITION BY chain_id, address ORDER BY count(*) DESC, counterparty_address) AS k, NULL, counterparty_address, NULL, NULL, count(*) FROM act WHERE direction = 'OUT' AND counterparty_address <> '' GROUP BY chain_id, address, counterparty_address QUALIFY k <= 5""")
def r5(spark: SparkSession, d: str) -> DataFrame:
    return scoring.risk_scenario_p90(activity(spark, d))


@query("r13_risk_scenario", f"""WITH {ACT}, i AS (SELECT chain_id, address, direction, row_number() OVER (PARTITION BY chain_id, address ORDER BY amount DESC NULLS LAST, block_number NULLS LAST, tx_hash NULLS LAST, event_index NULLS LAST, activity_id) AS rank, activity_id, amount FROM act WHERE direction = 'IN'),
o AS (SELECT chain_id, address, direction, row_number() OVER (PARTITION BY chain_id, address ORDER BY block_number NULLS LAST, tx_hash NULLS LAST, event_index NULLS LAST, activity_id) AS rank, activity_id, amount FROM act WHERE direction = 'OUT') SELECT * FROM i WHERE rank <= 5 UNION ALL SELECT * FROM o WHERE rank <= 5""")
def r13(spark: SparkSession, d: str) -> DataFrame:
    return scoring.risk_scenario(activity(spark, d))


@query("r10_dormancy", f"""WITH {ACT}, x AS (SELECT DISTINCT chain_id, address, CAST(block_time AS DATE) AS day FROM act WHERE block_time IS NOT NULL), g AS (SELECT *, day - lag(day) OVER (PARTITION BY chain_id, address ORDER BY day) AS gap FROM x)
SELECT chain_id, address, DATE '2020-01-02' - max(day) AS silent_days, coalesce(max(gap), 0) AS longest_gap, count(*) AS active_days FROM g GROUP BY ALL""")
def r10(spark: SparkSession, d: str) -> DataFrame:
    return scoring.dormancy(activity(spark, d), _as_of())


neutral_times(QUERIES, SQL, {
    "w8_final_activity": "ingested_at", "j4_touching": "t", "a1_profiles": "first_seen last_seen", "a4_daily_trend": "day/date", "a8_daily_netflow": "day/date", "a35_candles": "bucket",
    "a36_coverage": "first_minute last_minute", "f5_price_as_of": "minute", "a34_minute_bars": "minute", "a30_edges": "first_t last_t", "g14_merge_edges": "first_t last_t", "g18_timeline": "t",
})
