"""Problem 5: the streaming merge against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from tracewright.llm import nearest as nr


def brute(left, right, tol):
    out = set()
    for k1, k2, t, i in left:
        best = min(((abs(t - u), u, j) for a, b, u, j in right if a == k1 and b == k2 and u is not None and t is not None and abs(t - u) <= tol), default=None)
        if best and k1 is not None and k2 is not None:
            out.add((i, best[2], best[0]))
    return out


@pytest.mark.parametrize("seed, batch", [(1, 10000), (2, 7), (3, 1)])
def test_against_brute_force(spark, seed, batch):
    rng = random.Random(seed)
    step = 10_000_000
    mk = lambda n, base: [(rng.choice([1, 2, None]), rng.choice(["a", "b", None]), rng.choice([rng.randrange(0, 2000) * step, None] if rng.random() < 0.05 else [rng.randrange(0, 2000) * step]), base + i) for i in range(n)]
    left, right = mk(400, 0), mk(300, 1000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = lambda rows: spark.createDataFrame(rows, "k1 int, k2 string, t bigint, id bigint")
        got = {(r.left_id, r.right_id, r.gap_us) for r in nr.nearest(df(left), df(right), 120, 600).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    assert got == brute(left, right, 120_000_000)


A = "activity_id bigint, chain_id int, token_symbol string, block_time timestamp, close string"
P = "anchor_id bigint, chain_id int, symbol string, quote_symbol string, minute timestamp, close decimal(38,18), ingested_at timestamp"
T = datetime(2024, 1, 1, 12)


def test_versions_symbols_ties_and_tolerance(spark):
    from decimal import Decimal

    s = lambda x: T + timedelta(seconds=x)
    anchors = [
        (1, 1, "abc", "USDX", s(0), Decimal(1), s(10)), (2, 1, "ABC ", "usdx", s(0), Decimal(2), s(20)), (3, 1, "ABC", "USDX", s(60), None, s(30)), (4, 1, "ABC", "USDX", s(60), Decimal(4), s(10)),
        (5, 1, "ABC", "EURX", s(30), Decimal(5), s(10)), (6, 1, "ABC", "USDX", s(120), Decimal(6), s(10)), (7, 2, "ABC", "USDX", s(30), Decimal(7), s(10)), (8, 1, None, "USDX", s(0), Decimal(8), s(1)),
    ]
    acts = [(1, 1, " abc", s(60), ""), (2, 1, "ABC", s(61), ""), (3, 1, "ABC", s(240), ""), (4, 1, "ABC", s(241), ""), (5, 1, "ABC", s(-120), ""), (6, 1, "ABC", s(-121), ""), (7, 1, None, s(0), ""), (8, 1, "", s(0), ""), (9, 1, "ABC", None, ""), (1, 1, "abc", s(60), "")]
    a, p = spark.createDataFrame(acts, A), spark.createDataFrame(anchors, P)
    got = sorted((r.activity_id, r.anchor_id) for r in nr.price_matches(a, p).collect())
    assert got == [(1, 2), (1, 2), (2, 6), (3, 6), (5, 2)]
    assert nr.price_matches(a.limit(0), p).count() == 0 and nr.price_matches(a, p.limit(0)).count() == 0
    full = nr.priced_activity(a.dropDuplicates(["activity_id"]), p)
    assert full.count() == 9 and full.filter("anchor_id is null").count() == 5


def test_hot_entity(spark):
    n = 20000
    left = spark.range(n).selectExpr("1 k1", "'x' k2", "id * 1000003 t", "id")
    right = spark.range(n).selectExpr("1 k1", "'x' k2", "id * 1000003 + 7 t", "id")
    rows = nr.nearest(left.selectExpr("cast(k1 as int) k1", "k2", "t", "id"), right.selectExpr("cast(k1 as int) k1", "k2", "t", "id")).collect()
    assert len(rows) == n and all(r.left_id == r.right_id and r.gap_us == 7 for r in rows)
