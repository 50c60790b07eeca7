"""Fund flow against plain Python: paths, beams, settlement, patterns."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracewright.operators import activity_metrics as am
from tracewright.operators import fundflow as ff

T = datetime(2024, 1, 1)
KINDS = {"n1": "EXCHANGE", "n2": "DEX", "n3": "BRIDGE", "n4": "CONTRACT", "n5": "UNKNOWN_SERVICE"}


def graph(spark, seed, nodes=9, edges=40):
    rng = random.Random(seed)
    rows = {}
    for _ in range(edges):
        key = (f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}", rng.choice("xy"))
        rows[key] = (Decimal(rng.randrange(1, 10**6)), rng.randrange(1, 50), rng.randrange(1, 200000), T + timedelta(hours=rng.randrange(400)))
    e = spark.createDataFrame([(*k, a, n, t, t, b) for k, (a, n, b, t) in rows.items()], "src string, dst string, token string, amount decimal(38,2), n int, first_t timestamp, last_t timestamp, first_block bigint")
    ent = spark.createDataFrame([(k, v, f"id{k}") for k, v in KINDS.items()], "node string, entity_type string, entity_id string")
    return rows, ff.typed_edges(e, ent)


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_a_search(spark, seed):
    rows, typed = graph(spark, seed)
    best = {}
    for (s, d, tok), v in rows.items():
        if s != d:
            best.setdefault(s, []).append((-v[0], d, tok, v[2]))
    best = {s: sorted(v)[:3] for s, v in best.items()}
    want = []

    def walk(path, tokens, total, blocks):
        for a, d, tok, b in best.get(path[-1], []):
            if d in path:
                continue
            p, ts, tt, bs = [*path, d], [*tokens, tok], total - float(a), [*blocks, b]
            hops, kind = len(p) - 1, KINDS.get(d, "")
            cash = kind == "EXCHANGE"
            gap = bs[-1] - bs[0]
            steady = 0.5 if hops <= 1 or gap <= 0 else 0.95 if gap < 1000 else 0.8 if gap < 10000 else 0.5 if gap < 100000 else 0.2
            known, noise = sum(x in KINDS for x in p[1:]), min(0.3, sum({"DEX": 0.15, "CONTRACT": 0.05}.get(KINDS.get(x), 0) for x in p[1:]))
            raw = 0.25 * (1 - 1 / (1 + math.log10(tt + 1))) + 0.2 * (0.9 if cash else 0.3) + 0.15 * (0.6 if kind == "UNKNOWN_SERVICE" else 0.2) + 0.2 * (0.9 if cash else 0.3) + 0.1 * steady + 0.1 * min(0.9, 0.6 + 0.05 * known) + 0.0025 - noise
            want.append((">".join(p), ">".join(ts), raw))
            if hops < 3:
                walk(p, ts, tt, bs)

    walk(["n0"], [], 0.0, [])
    got = {(r.path, r.tokens): r.score for r in ff.find_paths(typed, "n0", max_depth=3, top_k=3, limit=10**6).collect()}
    assert set(got) == {(p, t) for p, t, _ in want} and all(abs(got[p, t] - max(0, min(1, s))) < 6e-4 for p, t, s in want)
    few = ff.find_paths(typed, "n0", max_depth=3, top_k=3, limit=5).collect()
    assert [r.score for r in few] == sorted(got.values(), reverse=True)[:5]
    assert all(r.destination == "n1" and r.path_type.endswith("CASHOUT") for r in ff.cashouts(ff.find_paths(typed, "n0", 3, 3, 10**6)).collect())


@pytest.mark.parametrize("way", ["out", "in"])
def test_beams_never_revisit_and_keep_the_best(spark, way):
    _, typed = graph(spark, 3)
    wide, slim = ff.beam_trace(typed, "n0", 3, 10**5, way).collect(), ff.beam_trace(typed, "n0", 3, 4, way).collect()
    assert all(len(set(r.path.split(">"))) == r.hop + 1 for r in wide) and max(sum(r.hop == k for r in slim) for k in (1, 2, 3)) <= 4
    first = sorted((r for r in wide if r.hop == 1), key=lambda r: (-r.score, r.path, r.tokens))[:4]
    assert sorted((r.path, r.tokens) for r in slim if r.hop == 1) == sorted((r.path, r.tokens) for r in first)
    for bad in ({"hops": 9}, {"beam": 0}, {"direction": "up"}):
        with pytest.raises(ValueError):
            ff.beam_trace(typed, "n0", **bad)


def test_edge_kinds_and_bounded_graph(spark):
    rows, typed = graph(spark, 4)
    kind = {(r.src, r.dst): r.kind for r in typed.collect()}
    for (s, d), k in kind.items():
        want = "INTERNAL" if s == d and s in KINDS else {"EXCHANGE": "DEPOSIT", "BRIDGE": "BRIDGE_OUT", "DEX": "SWAP_OUT"}.get(KINDS.get(d)) or {"BRIDGE": "BRIDGE_IN", "DEX": "SWAP_IN"}.get(KINDS.get(s)) or "TRANSFER"
        assert k == want
    level, front = {"n0": 0}, ["n0"]
    for k in range(2):
        front = sorted({d for s, d, _ in rows if s in front and d not in level})
        level |= dict.fromkeys(front, k + 1)
    got = {(r.src, r.dst, r.token, r.level) for r in ff.entity_graph(typed, "n0", depth=3).collect()}
    assert got == {(s, d, t, level[s]) for s, d, t in rows if s in level and s != d}
    assert {r.level for r in ff.entity_graph(typed, "n0", depth=3, max_nodes=2).collect()} == {0}


def transfers(spark, rows):
    return spark.createDataFrame([(s, d, Decimal(a), T + timedelta(days=k)) for s, d, a, k in rows], "src string, dst string, amount decimal(18,2), t timestamp")


def test_settlement_conservation_and_profit(spark):
    df = transfers(spark, [("a", "sink", 900, 0), ("b", "sink", 100, 1), ("sink", "c", 50, 2), ("pass", "x", 100, 99), ("a", "pass", 100, 99), ("self", "self", 5, 1)])
    s = ff.flow_stats(df, F.lit(T + timedelta(days=100)))
    by = {r.node: r for r in s.collect()}
    assert "self" not in by and (by["sink"].total_in, by["sink"].total_out, by["sink"].top1_source, by["sink"].recent_30d, by["sink"].counterparties) == (1000, 50, 0.9, 0, 3)
    none = spark.createDataFrame([], "node string, entity_type string, entity_id string")
    assert {r.node: r.kind for r in ff.settlements(s, none, 0.4).collect()}["sink"] == "CUSTODIAL_SETTLEMENT"
    c = {r.node: (r.deviation, r.passed) for r in ff.conservation(s).collect()}
    assert c["sink"] == (0.95, False) and c["pass"] == (0.0, True) and c["b"] == (0.0, True)
    p = {(r.node, r.level): r.net_profit for r in ff.profit(s).collect()}
    assert (p["sink", "L0"], p["sink", "L1"], p["sink", "L2"]) == (1000, 950, 950 - 630) and ("b", "L2") not in p
    d = {r.node: r for r in ff.dormancy_score(s).collect()}
    assert d["sink"].settlement and d["pass"].deposit == "exchange_deposit_candidate" and d["c"].deposit is None


def act(spark, rows):
    return spark.createDataFrame([(1, "a", w, Decimal(v), None if h is None else T + timedelta(hours=h)) for w, v, h in rows], "chain_id int, address string, direction string, amount decimal(38,18), block_time timestamp")


@pytest.mark.parametrize("rows, want", [
    ([("IN", 100, 0), ("OUT", 60, 0.5)], {"rapid"}),
    ([("IN", 100, 0), ("OUT", 60, 1.5)], set()),
    ([("IN", 100, 0), ("OUT", 25, 5), ("OUT", 25, 5), ("OUT", 25, 5)], {"split"}),
    ([("IN", 10, 0), ("IN", 10, 1), ("IN", 10, 2), ("OUT", 1, 9)], {"concentration"}),
    ([("IN", 100, 0), ("OUT", 85, 5)], {"drain"}),
    ([("SELF", 100, 0)], None), ([("OUT", 5, None)], set()),
])
def test_patterns(spark, rows, want):
    got = ff.patterns(act(spark, rows)).collect()
    assert (len(got) == 0) if want is None else {k for k in ("rapid", "split", "concentration", "drain") if got[0][k]} == want


def test_large_inflow_and_expansion(spark):
    r = ff.patterns(act(spark, [("IN", v, v) for v in range(1, 12)])).first()
    assert float(r.large_inflow) == 10
    rows = spark.createDataFrame([("a", 10**9, 100.0, 1.0, 1000, 50, None), ("b", 10**9, 100.0, 1.0, 1000, 50, "EXCHANGE"), ("c", 0, 0.0, 0.0, 0, 0, None)], "node string, amount bigint, risk double, relation double, txs int, degree int, entity_type string")
    assert {(r.node, r.score, r.decision) for r in ff.expansion(rows).collect()} == {("a", 100.0, "ACQUIRE"), ("b", 85.0, "ACQUIRE"), ("c", 0.0, "IGNORE")}


def test_risk_basis_on_few_and_no_senders(spark):
    one = transfers(spark, [("a", "x", 1, 0), ("a", "y", 1, 0), ("b", "x", 1, 0)])
    assert tuple(am.risk_basis(one).first()) == (1.0, 0.5)
    assert am.risk_basis(one.filter("src = 'a'")).first().jaccard == 0.0
