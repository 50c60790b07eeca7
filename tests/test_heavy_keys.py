"""Problem 2: chunked totals against a plain count."""

from collections import defaultdict
from datetime import datetime, timedelta

from tracewright.operators import heavy_keys as hk

SCHEMA = "chain_id int, address string, counterparty_address string, direction string, tx_count bigint, updated_at timestamp, note string"
A, B, C = ("0x" + x * 40 for x in "abc")
T = datetime(2024, 1, 1)


def totals(spark, rows, chunk_rows=7):
    return {(r.role, r.key_address): r for r in hk.key_totals(spark.createDataFrame(rows, SCHEMA), chunk_rows).collect()}


def test_spellings_versions_and_blank_sides(spark):
    rows = [
        (1, A, B, "IN", 5, T, "old"),
        (1, " " + A.upper(), "0x" + "0" * 24 + B[2:], "IN", 7, T + timedelta(1), "new"),
        (1, A, "", "IN", None, T, None),
        (1, A, None, "OUT", 2, T, None),
        (1, "not an address", B, "IN", 1, T, None),
        (None, A, C, None, 1, None, None),
    ]
    got = totals(spark, rows)
    assert got["address", A].current_rows == 4 and got["address", A].partners == 2 and got["address", A].tx_count == 10
    assert got["counterparty", B].current_rows == 2 and got["counterparty", B].partners == 2
    assert ("address", "") not in got and all(k.startswith("0x") and len(k) == 42 for _, k in got)
    assert {r.all_rows for r in got.values()} == {5}


def test_hot_key_over_many_chunks(spark):
    rows = [(i % 3, A, "0x" + f"{i // 2:040x}", "IN" if i % 2 else "OUT", i, T, "x") for i in range(400)] + [(1, B, A, "IN", 1, T, "x")] * 3
    got = totals(spark, rows)
    want = defaultdict(set)
    for c, a, b, d, *_ in rows:
        want["address", a].add((c, b, d))
        want["counterparty", b].add((c, a, d))
    assert {k: v.current_rows for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    assert got["address", A].partners == 200 and got["address", A].chunks > 10
    assert got["address", A].tx_count == sum(range(400))


def test_empty_and_ties(spark):
    assert totals(spark, []) == {}
    got = totals(spark, [(1, A, B, "IN", 3, T, ""), (1, A, B, "IN", 9, T, "")])
    assert got["address", A].tx_count == 9  # the greatest of equally recent versions


def test_heavy_share(spark):
    rows = [(1, A, "0x" + f"{i:040x}", "IN", 1, T, "") for i in range(99)] + [(1, B, C, "IN", 1, T, "")]
    keys = {(r.role, r.key_address) for r in hk.heavy(hk.key_totals(spark.createDataFrame(rows, SCHEMA)), 0.02).collect()}
    assert keys == {("address", A)}
