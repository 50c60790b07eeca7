"""Rows that fail to parse (problem 6): strict load plus anti-join.

Records keep their offset (line_id). A strict load takes only conforming records; what it didn't load is found by an anti-join of the
offsets and diagnosed by a full reader of the quoting rules, which gives the first reason that applies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import materialize

FIELDS = ("time", "amount", "direction", "account_no", "cp_name", "summary", "txn_serial", "balance")
REASONS = ("broken_quoting", "column_count", "bad_time", "bad_amount", "bad_direction")
#: Words and signs of a direction.
DIRECTIONS = ("进", "出", "借", "贷", "借方", "贷方", "收入", "支出", "转入", "转出", "入账", "出账", "收", "支", "存", "取", "入", "D", "C", "O", "+", "-")
TIME = (
    r"^(\d{4})-(\d{2})-(\d{2}) (\d{2}):(\d{2}):(\d{2})$",
    r"^(\d{4})/(\d{1,2})/(\d{1,2}) (\d{1,2}):(\d{2})(?::(\d{2}))?$",
    r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$",
    r"^(\d{4})年(\d{1,2})月(\d{1,2})日 ?(\d{1,2})时(\d{1,2})分(\d{1,2})秒$",
)
AMOUNT = r"^[+-]?[￥¥]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?元?$"
#: Outer spaces of a value: the white space of Unicode, one class for the strict load, the full reader and SQL.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = f"^[{SPACES}]+|[{SPACES}]+$"
_OUTER = re.compile(f"^[{SPACES}]+|[{SPACES}]+\\Z")
#: The strict load leaves records that are longer or have more quotes to the full reader, so that its patterns never work on long text;
#: the reader loads them just the same if they conform.
STRICT_CHARS, STRICT_QUOTES = 1 << 16, 64
_CUT = "\x01"


def split_record(text: str, sep: str) -> list[str] | None:
    """The fields of a record, or None if its quoting is broken."""
    out, i, n = [], 0, len(text)
    while True:
        if i < n and text[i] == '"':
            j, parts = i + 1, []
            while True:
                k = text.find('"', j)
                if k < 0:
                    return None
                parts.append(text[j:k])
                if text.startswith('"', k + 1):
                    parts.append('"')
                    j = k + 2
                else:
                    break
            i = k + 1
            out.append("".join(parts))
            if i == n:
                return out
            if not text.startswith(sep, i):
                return None
        else:
            k = text.find(sep, i)
            field = text[i:] if k < 0 else text[i:k]
            if '"' in field:
                return None
            out.append(field)
            if k < 0:
                return out
            i = k
        i += len(sep)


def _real_time(s: str) -> bool:
    for p in TIME:
        if m := re.match(p, s, re.ASCII):
            try:
                datetime(*(int(x or 0) for x in m.groups()))
                return not s.endswith("\n")
            except ValueError:
                return False
    return False


def diagnose(text: str | None, sep: str | None) -> tuple[str | None, list[str]]:
    """(first reason that applies or None, trimmed fields). Null text or a null or empty separator is column_count."""
    if text is None or not sep:
        return "column_count", []
    fields = split_record(text, sep)
    if fields is None:
        return "broken_quoting", []
    fields = [_OUTER.sub("", f) for f in fields]
    if len(fields) != len(FIELDS):
        return "column_count", []
    if not _real_time(fields[0]):
        return "bad_time", fields
    if not re.fullmatch(AMOUNT.strip("^$"), fields[1]):
        return "bad_amount", fields
    if fields[2] not in DIRECTIONS:
        return "bad_direction", fields
    return None, fields


def _timestamp(t: Column) -> Column:
    """The time of a strict field, or null if it is no real one."""
    out = None
    for p in TIME:
        part = [F.coalesce(F.regexp_extract(t, p, i).try_cast("int"), F.lit(0)) for i in range(1, 7)]
        made = F.when((part[3] <= 23) & (part[4] <= 59) & (part[5] <= 59), F.call_function("try_make_timestamp", *part, F.lit("UTC")))
        out = F.when(t.rlike(p), made) if out is None else out.when(t.rlike(p), made)
    return out


def strict_load(lines: DataFrame) -> DataFrame:
    """The conforming records that generated code can prove to conform: line_id and the eight fields, trimmed."""
    one = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"\x01]*+)'
    raw, sep = F.col("raw_line"), F.col("sep")
    plain = lines.filter(
        (F.length(sep) > 0) & ~raw.contains(_CUT) & (F.length(raw) <= STRICT_CHARS) & (F.length(raw) - F.length(F.replace(raw, F.lit('"'), F.lit(""))) <= STRICT_QUOTES)
    )
    cut = plain.select("line_id", "sep", F.explode(F.array(F.replace(raw, sep, F.lit(_CUT)))).alias("t")).filter(F.col("t").rlike(f"^{one}(?:\\x01{one}){{{len(FIELDS) - 1}}}$"))
    # A quoted field may hold the separator: split only where an even number of quotes follows.
    fields = cut.select("line_id", "sep", F.explode(F.array(F.split("t", r'\x01(?=(?:[^"]*"[^"]*")*[^"]*$)'))).alias("f"))
    value = lambda i: F.regexp_replace(
        F.replace(F.when(F.col("f")[i].startswith('"'), F.replace(F.expr(f"substring(f[{i}], 2, length(f[{i}]) - 2)"), F.lit('""'), F.lit('"'))).otherwise(F.col("f")[i]), F.lit(_CUT), F.col("sep")), _SPACE, ""
    )
    flat = fields.select("line_id", F.inline(F.array(F.struct(*[value(i).alias(c) for i, c in enumerate(FIELDS)]))))
    return flat.filter(F.col("direction").isin(*DIRECTIONS) & F.col("amount").rlike(AMOUNT) & ~F.col("amount").endswith("\n") & _timestamp(F.col("time")).isNotNull())


def diagnosed(lines: DataFrame, loaded: DataFrame) -> DataFrame:
    """The records that weren't loaded, by anti-join of the offsets: line_id, reason (null: conforming after all) and the fields."""
    rest = lines.select("line_id", "sep", "raw_line").join(loaded.select("line_id"), "line_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [diagnose(None if pd.isna(t) else t, None if pd.isna(s) else s) for t, s in zip(b["raw_line"], b["sep"])]
            out = pd.DataFrame({"line_id": b["line_id"], "reason": pd.Series([r for r, _ in got], dtype=object, index=b.index)})
            for i, c in enumerate(FIELDS):
                out[c] = pd.Series([f[i] if f else None for _, f in got], dtype=object, index=b.index)
            yield out

    return rest.mapInPandas(run, "line_id bigint, reason string, " + ", ".join(f"{c} string" for c in FIELDS))


def load_with_rejects(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reason): together every line_id once. Further columns are ignored; an empty table gives two empty ones.

    What the strict load leaves is diagnosed once and written; both results read it.
    """
    loaded = strict_load(lines)
    rest = materialize(diagnosed(lines, loaded), "rejects")
    valid = loaded.unionByName(rest.filter("reason is null").select("line_id", *FIELDS))
    return valid, rest.filter("reason is not null").select("line_id", "reason")
