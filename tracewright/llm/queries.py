"""Queries of the language-model data problems (5, 7, 8, 9 and 10), and SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import abuse, copies, mixing, nearest, tokens
from tracewright.plans.neutral import neutral_times
from tracewright.sources.tables import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.price_matches(table(spark, d, "address_activity"), table(spark, d, "price_anchor_1m")).select("activity_id", "anchor_id")


def p5_priced(spark: SparkSession, d: str) -> DataFrame:
    return nearest.priced_activity(table(spark, d, "address_activity"), table(spark, d, "price_anchor_1m"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "ledger"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return copies.one_record_each(table(spark, d, "ledger"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p8_usage(spark: SparkSession, d: str) -> DataFrame:
    return tokens.statistics(tokens.encode(table(spark, d, "documents")))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), mixing.CORPUS)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(table(spark, d, "documents"), table(spark, d, "mix_targets"), mixing.CORPUS)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return abuse.score(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).filter("abusive").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).withColumn("score", F.round("score", 6))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p5_priced, p7_found, p7_records, p8_ids, p8_usage, p9_mixture, p9_shares, p10_found, p10_scores, p10_rates)}

_NEAREST = r"""
WITH a AS (
  SELECT chain_id, upper(trim(symbol, e' \t\n\r　')) AS s, minute, ingested_at, anchor_id, close FROM price_anchor_1m
  WHERE upper(trim(quote_symbol, e' \t\n\r　')) = 'USDX'
  QUALIFY row_number() OVER (PARTITION BY chain_id, s, minute ORDER BY ingested_at DESC NULLS LAST, anchor_id DESC) = 1),
live AS (SELECT * FROM a WHERE close IS NOT NULL AND s <> ''),
near AS (
  SELECT x.activity_id, live.anchor_id, live.close, abs(epoch_us(x.block_time) - epoch_us(live.minute)) AS gap_us, live.minute
  FROM address_activity x JOIN live ON live.chain_id = x.chain_id AND live.s = upper(trim(x.token_symbol, e' \t\n\r　'))
   AND live.minute BETWEEN x.block_time - INTERVAL 120 SECOND AND x.block_time + INTERVAL 120 SECOND
  QUALIFY row_number() OVER (PARTITION BY x.activity_id ORDER BY gap_us, live.minute) = 1)
"""

_FULL_LETTERS = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　￥￠￡￢￣￤￦"
_HALF_LETTERS = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " ¥¢£¬¯¦₩"


def _half(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_FULL_LETTERS}', '{_HALF_LETTERS}')"


def _plain(c: str) -> str:
    return f"regexp_replace(lower({_half(c)}), '[\\s\\p{{Z}}\\p{{P}}\\p{{Cf}}$+<=>^`|~]', '', 'g')"


_PLAIN_COLUMNS = [c for c in copies.BUSINESS if c not in ("amount", "remark", "direction")]
_COPIES = f"""
WITH c AS (
  SELECT row_id, [{', '.join(_plain(c) for c in _PLAIN_COLUMNS)}] AS k,
         CASE WHEN trim({_half('direction')}) IN ('+', '-') THEN trim({_half('direction')}) ELSE {_plain('direction')} END AS dir,
         try_cast(regexp_replace({_half('amount')}, '[\\s,¥元]', '', 'g') AS DECIMAL(38,10)) AS number, {_plain('amount')} AS amount_text,
         list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({_half('remark')}, '[;,|、/\\n\\r\\t]+'), lambda x: regexp_replace(lower(x), '[\\s\\p{{Z}}\\p{{P}}]', '', 'g')), lambda x: x <> ''))) AS entries
  FROM ledger WHERE trim(coalesce(txn_serial, ''), e' \\t\\n\\r　') <> ''),
g AS (SELECT row_id, min(row_id) OVER w AS keep, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY k, dir, coalesce(CAST(number AS VARCHAR), amount_text), entries))
"""

SQL = {
    "p5_found": _NEAREST + "SELECT activity_id, anchor_id FROM near",
    "p5_priced": _NEAREST + "SELECT x.activity_id, x.chain_id, x.token_symbol, x.block_time, near.anchor_id, near.close, near.gap_us FROM address_activity x LEFT JOIN near USING (activity_id)",
    "p7_found": _COPIES + "SELECT keep AS keep_row_id, row_id AS copy_row_id FROM g WHERE row_id <> keep",
    "p7_records": _COPIES + "SELECT l.row_id, coalesce(g.n, 1) AS copies FROM ledger l LEFT JOIN g USING (row_id) WHERE g.row_id IS NULL OR g.keep = g.row_id",
}

neutral_times(QUERIES, SQL, {"p5_priced": "block_time"})
