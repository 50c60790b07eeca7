"""Scalar cleaning rules of statements and chain logs as column expressions; all stay inside generated code."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topics of the token transfer events, and directions by alias.
TRANSFER_TOPICS = (
    "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef",
    "0xc3d58168c5ae7397731d063d5bbf3d657854427343f4c083240f7aacaa2d0f62",
    "0x4a39dc06d4c0dbc64b70af90fd698a233a518aa5d07e595d983b8c0526c8f7fb",
)
OUT_WORDS = ["D", "借", "借方", "支出", "转出", "取", "支", "出账", "O", "-", "出"]
IN_WORDS = ["C", "贷", "贷方", "收入", "转入", "存", "入", "入账", "收", "+", "进"]
METHOD_KINDS = {"APPROVE": ("0x095ea7b3",), "SWAP": ("0x38ed1739", "0x7ff36ab5", "0x18cbafe5", "0x5ae401dc", "0x414bf389"), "NATIVE_TRANSFER": ("", "0x")}


def topic_address(topic: Column) -> Column:
    """A 32-byte topic as the 20-byte address in its tail."""
    return F.when(F.length(topic) == 66, F.concat(F.lit("0x"), F.substring(topic, 27, 40))).otherwise(topic)


def is_transfer(topic0: Column) -> Column:
    """P2."""
    return F.lower(topic0).isin(*TRANSFER_TOPICS)


def hex_limbs(word: Column) -> list[Column]:
    """The last 64 hex digits as eight 32-bit limbs, high first; sums of limbs are exact and combine on the map side. Null if not hex."""
    digits = F.lower(F.regexp_replace(word, "^0[xX]", ""))
    tail = F.lpad(F.when(digits.rlike("^[0-9a-f]+$"), F.substring(digits, -64, 64)), 64, "0")
    return [F.conv(F.substring(tail, 8 * i + 1, 8), 16, 10).try_cast("bigint") for i in range(8)]


def limbs_total(limbs: Sequence[Column]) -> Column:
    """Summed limbs as one decimal(38,0); null where the total needs more digits."""
    total = F.lit(0).cast("decimal(38,0)")
    for limb in limbs:
        total = F.try_add(F.try_multiply(total, F.lit(4294967296).cast("decimal(10,0)")).try_cast("decimal(38,0)"), limb.cast("decimal(20,0)")).try_cast("decimal(38,0)")
    return total


def to_number(text: Column) -> Column:
    """A number with currency marks and separators; what is no number is 0."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[,，￥¥元]", ""), r"[^0-9.+-]", "")
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def direction(text: Column) -> Column:
    """进 or 出 by alias; anything else passes through trimmed."""
    s = F.trim(text)
    return F.when(s.isin(*IN_WORDS), "进").when(s.isin(*OUT_WORDS), "出").otherwise(s)


def account_number(text: Column) -> Column:
    """Without a leading bank code and a trailing branch suffix."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]+-?", ""), "[-_][A-Za-z0-9]+$", "")


def clean_text(text: Column) -> Column:
    """Ideographic spaces and line breaks are spaces, byte-order marks go; empty text, nan, None and NaT are null."""
    s = F.trim(F.translate(text, "　\r\n﻿", "   "))
    return F.when(~s.isin("", "nan", "None", "NaT"), s)


def first_non_empty(*columns: Column) -> Column:
    """P9."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def reject_reason(failed: Column, required: Mapping[str, Column], way: Column) -> Column:
    """P10: the first reason that applies, null for an accepted row."""
    out = F.when(F.coalesce(failed.rlike("失败|冲正|撤销|退汇"), F.lit(False)), "failed_feedback")
    for name, c in required.items():
        out = out.when(F.coalesce(F.trim(c), F.lit("")) == "", f"missing_{name}")
    return out.when(~way.isin("进", "出"), "invalid_direction")


def parties(way: Column, payer: Column, payee: Column) -> tuple[Column, Column, Column]:
    """(subject, counterparty, status) from payer and payee."""
    return F.when(way == "出", payer).when(way == "进", payee), F.when(way == "出", payee).when(way == "进", payer), F.when(way.isin("进", "出"), "已判定").otherwise("无法判定")


def split_named(text: Column) -> tuple[Column, Column]:
    """``name(account)`` as its two parts; text without brackets is all name."""
    m = r"^(.*?)[(（]([^()（）]*)[)）]\s*$"
    return F.when(text.rlike(m), F.regexp_extract(text, m, 1)).otherwise(text), F.when(text.rlike(m), F.regexp_extract(text, m, 2))


def mask_label(text: Column) -> Column:
    """At least 12 digits keep the first and last four; other labels keep 24 characters."""
    return F.when(text.rlike("^[0-9]{12,}$"), F.concat(F.substring(text, 1, 4), F.lit("…"), F.substring(text, -4, 4))).when(F.length(text) > 24, F.concat(F.substring(text, 1, 24), F.lit("…"))).otherwise(text)


def status_text(text: Column) -> Column:
    """P18."""
    s = F.upper(F.trim(text))
    return F.when(s.isin("1", "SUCCESS", "TRUE", "OK"), "SUCCESS").when(s.isin("0", "FAILED", "FALSE", "REVERTED"), "FAILED").otherwise("UNKNOWN")


def activity_kind(method_id: Column, to: Column) -> Column:
    """P19."""
    m = F.lower(F.coalesce(method_id, F.lit("")))
    out = F.when(F.coalesce(to, F.lit("")) == "", "CONTRACT_CREATE")
    for kind, ids in METHOD_KINDS.items():
        out = out.when(m.isin(*ids), kind)
    return out.otherwise("CONTRACT_CALL")


def scaled(raw: Column, decimals: Column) -> Column:
    """P20: an integer text with its decimal point ``decimals`` places from the right, as text."""
    digits = F.regexp_replace(raw, "^0+(?=[0-9])", "")
    padded = F.lpad(digits, F.greatest(F.length(digits), decimals + 1), F.lit("0"))
    whole = F.substring(padded, F.lit(1), F.length(padded) - decimals)
    return F.when(raw.rlike("^[0-9]+$"), F.when(decimals == 0, digits).otherwise(F.concat(whole, F.lit("."), F.right(padded, decimals))))


def proxy_kind(code: Column, beacon: Column, admin: Column, implementation: Column, uups: Column) -> Column:
    """EIP-1167, then beacon, transparent, UUPS and plain EIP-1967 proxies."""
    has = lambda c: F.coalesce(F.regexp_replace(c, "^0x0*", ""), F.lit("")) != ""
    return (
        F.when(F.lower(code).rlike("^0x363d3d373d3d3d363d73[0-9a-f]{40}5af43d82803e903d91602b57fd5bf3"), "EIP1167").when(has(beacon), "BEACON")
        .when(has(implementation) & has(admin), "TRANSPARENT").when(has(implementation) & F.coalesce(uups, F.lit(False)), "UUPS").when(has(implementation), "EIP1967").otherwise("NONE")
    )


def creation_kind(is_token: Column, is_proxy: Column, by_factory: Column, opcode: Column) -> Column:
    """Token, then proxy, factory, and last the opcode."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(is_token), "TOKEN").when(yes(is_proxy), "PROXY").when(yes(by_factory), "FACTORY").otherwise(F.coalesce(F.upper(opcode), F.lit("UNKNOWN")))


def row_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 over ``length:value`` and a zero byte of each column (lengths in bytes), null as empty."""
    part = lambda c: F.concat(F.octet_length(F.coalesce(c, F.lit(""))).cast("string"), F.lit(":"), F.coalesce(c, F.lit("")), F.lit("\0"))
    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def predicates(filters: Mapping[str, object], fuzzy: Sequence[str] = ()) -> Column:
    """A filter from a mapping: a list is a set, a pair (from, to) a half-open range, text an equality or, for ``fuzzy`` columns, a part of the value."""
    def one(name: str, v: object) -> Column:
        c = F.col(name)
        if isinstance(v, tuple):
            lo, hi = v
            return reduce(lambda a, b: a & b, [p for p in ((c >= lo) if lo is not None else None, (c < hi) if hi is not None else None) if p is not None], F.lit(True))
        if isinstance(v, (list, set, frozenset)):
            return c.isin(*sorted(v))
        return F.contains(F.lower(c), F.lit(str(v).lower())) if name in fuzzy else c == v

    return reduce(lambda a, b: a & b, [one(k, v) for k, v in filters.items()], F.lit(True))
