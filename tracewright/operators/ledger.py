"""Statement ETL: source tables to the canonical ledger, rejects, strict deduplication with audits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import cleaning as cl
from tracewright.operators.instants import parse_instants
from tracewright.operators.relational import dedup_with_audit

#: The 34 canonical columns by their names in statements.
CANONICAL = {
    "交易卡号": "card_no", "交易账号": "account_no", "交易户名": "account_name", "交易证件号码": "id_no", "交易方开户行": "bank", "账户性质": "account_nature", "交易时间": "txn_time", "交易金额": "amount", "交易余额": "balance",
    "收付标志": "direction", "交易对手账卡号": "cp_account", "对手账户性质": "cp_nature", "现金标志": "cash_flag", "对手户名": "cp_name", "对手身份证号": "cp_id_no", "对手开户银行": "cp_bank", "摘要说明": "summary", "交易币种": "currency",
    "交易网点名称": "branch", "交易发生地": "location", "交易是否成功": "success_flag", "传票号": "voucher_no", "IP地址": "ip", "MAC地址": "mac", "对手交易余额": "cp_balance", "交易流水号": "txn_serial", "商户流水号": "merchant_serial",
    "日志号": "log_no", "凭证种类": "cert_type", "凭证号": "cert_no", "交易柜员号": "teller_no", "备注": "remark", "查询反馈结果原因": "feedback_reason", "数据来源": "data_source",
}
#: Header aliases of each canonical column.
ALIASES = {
    "交易卡号": ["交易卡号", "交易卡", "卡号", "银行卡号", "本方卡号", "付款方账号", "收款方账号", "账户"],
    "交易账号": ["交易账号", "账号", "银行账号", "本方账号", "支付宝账号", "微信号", "商户号"],
    "交易户名": ["交易户名", "本方户名", "账户名称", "客户名称", "付款方姓名", "收款方姓名"],
    "交易证件号码": ["交易证件号码", "证件号码", "身份证号", "开户人证件号码"],
    "交易方开户行": ["交易方开户行", "开户银行", "账号开户银行", "开户行"],
    "交易时间": ["交易时间", "交易日期", "账务日期", "入账时间", "支付时间", "创建时间", "发生时间", "记账日期", "交易创建时间"],
    "交易金额": ["交易金额", "金额", "收入金额", "支出金额", "收/支", "收入（+元）", "支出（-元）", "交易额", "付款金额"],
    "交易余额": ["交易余额", "余额", "账户余额", "可用余额"],
    "收付标志": ["收付标志", "借贷标志", "借贷方向", "收支类型", "收/支", "收入/支出", "方向", "业务类型"],
    "交易对手账卡号": ["交易对手账卡号", "对方账号", "对手账号", "对方卡号", "对手卡号", "交易对方账号", "对方账户"],
    "现金标志": ["现金标志", "现转标志", "现金/转账"],
    "对手户名": ["对手户名", "对方户名", "对方姓名", "交易对方", "对方名称", "商户名称", "交易对手"],
    "对手身份证号": ["对手身份证号", "对方证件号", "对手证件号"],
    "对手开户银行": ["对手开户银行", "对方开户行", "对手开户行", "对方银行"],
    "摘要说明": ["摘要说明", "摘要", "交易摘要", "商品说明", "交易说明", "备注说明", "用途", "交易类型"],
    "交易币种": ["交易币种", "币种", "货币"],
    "交易网点名称": ["交易网点名称", "交易网点", "网点名称"],
    "交易发生地": ["交易发生地", "发生地", "交易地点"],
    "交易是否成功": ["交易是否成功", "交易状态", "状态", "交易结果"],
    "传票号": ["传票号"], "IP地址": ["IP地址", "IP"], "MAC地址": ["MAC地址", "MAC"], "对手交易余额": ["对手交易余额", "对方余额"],
    "交易流水号": ["交易流水号", "流水号", "交易号", "微信支付订单号", "支付宝交易号"],
    "商户流水号": ["商户流水号", "商户订单号", "商家订单号"],
    "日志号": ["日志号"], "凭证种类": ["凭证种类", "凭证类型"], "凭证号": ["凭证号"], "交易柜员号": ["交易柜员号", "柜员号"], "备注": ["备注", "附言", "说明"],
    "查询反馈结果原因": ["查询反馈结果原因", "反馈原因", "失败原因", "返回原因"],
}


@dataclass(frozen=True)
class Take:
    """The first non-empty of the source columns, cleaned: text, money, fen (hundredths), account, direction, or a part of ``name(account)``."""

    sources: tuple[str, ...]
    how: str = "text"


def _t(*sources: str, how: str = "text") -> Take:
    return Take(sources, how)


#: Which source columns of each known table kind go to which canonical column.
TABLES: dict[str, dict[str, Take | str]] = {
    "支付宝账户明细": {
        "account_no": _t("用户信息", how="inner"), "card_no": _t("用户信息", how="inner"), "account_name": _t("用户信息", how="outer"), "bank": "支付宝", "cp_account": _t("交易对方信息", how="inner"), "cp_name": _t("交易对方信息", how="outer"),
        "txn_time": _t("交易创建时间", "付款时间", "最近修改时间"), "amount": _t("金额（元）", how="money"), "direction": _t("收/支", how="direction"), "summary": _t("消费名称"), "txn_serial": _t("交易号"), "merchant_serial": _t("商户订单号"),
        "location": _t("交易来源地"), "success_flag": _t("交易状态"), "remark": _t("备注"),
    },
    "微信交易明细信息": {
        "txn_time": _t("交易时间"), "amount": _t("交易金额(分)", how="fen"), "balance": _t("账户余额(分)", how="fen"), "direction": _t("借贷类型", how="direction"), "card_no": _t("用户银行卡号", how="account"), "account_no": _t("用户侧账号名称"),
        "bank": _t("用户侧银行名称"), "cp_account": _t("对手方银行卡号", how="account"), "cp_name": _t("对手侧账户名称"), "cp_bank": _t("对手侧银行名称"), "cp_id_no": _t("对手方ID"), "summary": _t("交易业务类型", "交易用途类型"),
        "txn_serial": _t("交易单号"), "remark": _t("备注1", "备注2"),
    },
    "微信账单": {
        "txn_time": _t("交易时间"), "amount": _t("金额(元)", how="money"), "direction": _t("收/支/其他", "收/支", how="direction"), "cp_name": _t("交易对方"), "summary": _t("商品", "交易类型", "交易方式"), "success_flag": _t("当前状态"),
        "txn_serial": _t("交易单号"), "remark": _t("备注", "商户单号"),
    },
    "查询账号流水": {
        "card_no": _t("查询账号"), "account_no": _t("查询账号"), "cp_account": _t("对方账号卡号"), "cp_name": _t("对方账号姓名"), "amount": _t("金额", how="money"), "balance": _t("余额", how="money"), "direction": _t("借贷标志", how="direction"),
        "summary": _t("交易类型"), "success_flag": _t("交易结果"), "txn_time": _t("交易时间"), "txn_serial": _t("交易流水号"),
    },
    "信用卡账单": {"txn_time": _t("入账日期", "交易日期"), "summary": _t("交易描述"), "amount": _t("入账金额", "交易金额", how="money"), "currency": _t("入账货币", "交易货币")},
    "招商交易流水": {
        "txn_time": _t("交易时间", "交易日期"), "account_name": _t("客户名称"), "card_no": _t("交易卡号"), "direction": _t("交易方向(D:借|C:贷)", how="direction"), "amount": _t("交易金额", how="money"), "balance": _t("联机余额", how="money"),
        "cp_account": _t("对方帐号"), "cp_name": _t("对方客户名称"), "summary": _t("交易摘要"), "account_no": _t("账号"),
    },
}


def money_text(value: Column) -> Column:
    """Two decimals, half away from zero."""
    return F.format_string("%.2f", F.round(value, 2))


def _value(take: Take, columns: Sequence[str]) -> Column:
    have = [F.col(f"`{c}`") for c in take.sources if c in columns]
    if not have:
        return F.lit(None).cast("string")
    raw = cl.first_non_empty(*have)
    if take.how == "money":
        return money_text(cl.to_number(raw))
    if take.how == "fen":
        return money_text(cl.to_number(raw) / 100)
    if take.how == "account":
        return cl.account_number(raw)
    if take.how == "direction":
        return cl.direction(raw)
    if take.how in ("inner", "outer"):
        outer, inner = cl.split_named(raw)
        return F.coalesce(inner, raw) if take.how == "inner" else F.when(inner.isNotNull(), outer)
    return cl.clean_text(raw)


def map_source(df: DataFrame, kind: str, data_source: str, keep: Sequence[str] = ()) -> DataFrame:
    """A source table of a known kind, all text, as the canonical ledger; missing source columns give null."""
    rules = TABLES[kind]
    cols = []
    for name in CANONICAL.values():
        rule = data_source if name == "data_source" else rules.get(name)
        cols.append((F.lit(rule) if isinstance(rule, str) else _value(rule, df.columns) if rule else F.lit(None).cast("string")).alias(name))
    return df.select(*[F.col(c) for c in keep], *cols)


def map_by_headers(df: DataFrame, mapping: dict[str, str], data_source: str, keep: Sequence[str] = ()) -> DataFrame:
    """P35, SC12: a table with any headers by a mapping of header to canonical column; amounts and directions normalised."""
    back = {target: source for source, target in mapping.items()}
    how = {"amount": "money", "balance": "money", "direction": "direction"}
    cols = [(F.lit(data_source) if n == "data_source" else _value(Take((back[n],), how.get(n, "text")), df.columns) if n in back else F.lit(None).cast("string")).alias(n) for n in CANONICAL.values()]
    return df.select(*[F.col(c) for c in keep], *cols)


#: The fields of a full business fingerprint.
FINGERPRINT = [
    "txn_time", "amount", "balance", "direction", "card_no", "account_no", "account_name", "cp_account", "cp_name", "summary", "currency", "success_flag", "txn_serial", "merchant_serial",
    "payer_account", "payer_name", "payee_account", "payee_name",
]


def identity(columns: Sequence[str]) -> Column:
    """U4: by serial and fingerprint, else by source record id, else by fingerprint."""
    col = lambda c: F.coalesce(F.trim(c), F.lit("")) if c in columns else F.lit("")
    fingerprint = F.sha2(F.concat_ws("\x1f", *[col(c) for c in FINGERPRINT]), 256)
    subject = cl.first_non_empty(*[F.col(c) for c in ("account_no", "card_no", "account_name") if c in columns], F.lit(""))
    serial, source_id = col("txn_serial"), col("src_record_id")
    return (
        F.when(serial != "", F.sha2(F.concat_ws("\x1f", F.lit("serial"), col("data_source"), subject, serial, fingerprint), 256))
        .when(source_id != "", F.sha2(F.concat(F.lit("source\x1f"), source_id), 256))
        .otherwise(fingerprint)
    )


def classify(df: DataFrame, order: Sequence[str], row_id: str = "row_id", strict_amount: bool = False) -> DataFrame:
    """P10, U4: every row with reject_reason (null: accepted), identity, copy_no and kept_id (null for rejected rows).

    By default an amount that is empty or no number counts as 0.00 and isn't rejected; ``strict_amount`` rejects it.
    """
    amount = F.col("amount") if strict_amount else money_text(cl.to_number(F.col("amount")))
    reason = cl.reject_reason(F.coalesce("feedback_reason", F.lit("")), {"time": F.col("txn_time"), "amount": amount, "direction": F.col("direction")}, cl.direction(F.col("direction")))
    rows = df.withColumn("reject_reason", reason)
    good = dedup_with_audit(rows.filter("reject_reason IS NULL"), identity(df.columns), order, row_id)
    bad = rows.filter("reject_reason IS NOT NULL").withColumn("identity", F.lit(None).cast("string")).withColumn("copy_no", F.lit(None).cast("int")).withColumn("kept_id", F.lit(None).cast(df.schema[row_id].dataType))
    return good.unionByName(bad)


def outputs(classified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean ledger, duplicates with the row they repeat, rejects with reason): together every row once."""
    clean = classified.filter("copy_no = 1")
    duplicates = classified.filter("copy_no > 1").select("row_id", "kept_id", "identity")
    return clean, duplicates, classified.filter("reject_reason IS NOT NULL").select("row_id", "reject_reason")


def with_times(df: DataFrame, zone: str, order: str = "YMD", col: str = "txn_time") -> DataFrame:
    """P5: the text time of a statement as an instant, read as local time of ``zone``."""
    return parse_instants(df.withColumn("raw", F.col(col)).withColumn("zone_id", F.lit(zone)).withColumn("date_order", F.lit(order))).drop("raw", "zone_id", "date_order")


def fill_from_accounts(txns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Empty names, ids, banks and accounts of transactions filled by card; of repeated cards the last account row counts."""
    from tracewright.runtime import skew_safe_lookup

    values = ["account_name", "id_no", "bank", "account_no"]
    last = accounts.filter(F.coalesce("card_no", F.lit("")) != "").groupBy("card_no").agg(F.max_by(F.struct(*values), "row_no").alias("a"))
    j = skew_safe_lookup(txns, last, ["card_no"], ["a"])
    return j.select(*[F.coalesce(F.nullif(c, F.lit("")), F.col(f"a.{c}")).alias(c) if c in values else F.col(c) for c in txns.columns])
