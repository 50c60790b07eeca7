"""Lots against a plain queue, and the pinned cases of the profit calculation."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import fifo

T = datetime(2024, 1, 1)
EV = "token string, t timestamp, i int, type string, amount decimal(18,2), usd_value decimal(18,2), gas_usd decimal(18,2)"


def pnl(spark, rows):
    from decimal import Decimal

    d = lambda x: None if x is None else Decimal(str(x))
    df = spark.createDataFrame([("k", T + timedelta(minutes=i), i, k, d(a), d(u), d(g)) for i, (k, a, u, g) in enumerate(rows)], EV)
    return fifo.pnl(df, ["token"], ["t", "i"]).first()


def test_known_and_unknown_basis(spark):
    r = pnl(spark, [("TRANSFER_IN", 40, None, None), ("KNOWN_BUY", 60, 120, None), ("KNOWN_SELL", 50, 200, 10)])
    assert (r.known_sold, r.known_ratio, r.proceeds, r.gas, r.pnl, r.position, r.known_position) == (10, 0.2, 40, 2, 18, 50, 50)


def test_transfer_out_is_no_sale(spark):
    r = pnl(spark, [("DEX_BUY", 100, 200, None), ("TRANSFER_OUT", 40, None, None)])
    assert (r.pnl, r.sold, r.position, r.remaining_cost) == (0, 0, 60, 120)


def test_gas_is_deducted(spark):
    r = pnl(spark, [("DEX_BUY", 100, 100000, None), ("DEX_SELL", 100, 150000, 1000)])
    assert (r.pnl, r.cost, r.gas) == (49000, 100000, 1000)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for key in ("a", "b", "hot"):
        lots = deque()
        for i in range(400 if key == "hot" else 40):
            way, amount = rng.choice(["IN", "OUT"]), rng.randrange(1, 50)
            rows.append((key, i, way, amount))
            if way == "IN":
                lots.append([i, amount])
            else:
                while amount and lots:
                    q = min(amount, lots[0][1])
                    want[key, lots[0][0], i] = q
                    lots[0][1] -= q
                    amount -= q
                    if not lots[0][1]:
                        lots.popleft()
    df = spark.createDataFrame(rows, "k string, i int, way string, amount int")
    run = fifo.lots(df, ["k"], ["i"], "amount", F.col("way") == "IN", F.col("way") == "OUT")
    got = {(r.k, r.lot_i, r.use_i): int(r.quantity) for r in fifo.matches(run, ["k"], ["i"], ["i"], buckets=8).collect()}
    assert got == want


def test_windows_conserve(spark, small_dir):
    from tracewright.plans.views import activity

    w = fifo.flow_windows(activity(spark, small_dir), F.lit("2030-01-01").cast("timestamp"))
    a = activity(spark, small_dir).filter("direction = 'OUT' AND amount > 0 AND block_time IS NOT NULL").agg(F.sum("amount")).first()[0]
    s = w.agg(F.sum("matched").alias("m"), F.sum("opening").alias("o"), F.count_if(F.expr("retained_720h < 0 OR matched > received")).alias("bad")).first()
    assert s.m + s.o == a and s.bad == 0
