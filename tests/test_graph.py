"""Graph operators against plain Python on random graphs."""

import random
from collections import defaultdict, deque
from datetime import datetime

import pytest

from tracewright.operators import graph as g

E = "src string, dst string, token string, amount decimal(18,2), t timestamp"
T = datetime(2024, 1, 1)


def make(spark, n, m, seed):
    from decimal import Decimal

    rng = random.Random(seed)
    rows = [(f"n{rng.randrange(n):03d}", f"n{rng.randrange(n):03d}", rng.choice("xy"), Decimal(rng.randrange(1, 100)), T) for _ in range(m)]
    return rows, spark.createDataFrame(rows, E)


@pytest.mark.parametrize("n, m", [(60, 40), (200, 90), (20, 60)])
def test_components(spark, n, m):
    rows, df = make(spark, n, m, n)
    near = defaultdict(set)
    for a, b, *_ in rows:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            todo = deque([s])
            while todo:
                x = todo.popleft()
                if x not in want:
                    want[x] = s
                    todo += near[x]
    assert {r.node: r.component for r in g.components(df).collect()} == want


def test_long_chain_and_empty(spark):
    rows = [(f"n{i:03d}", f"n{i + 1:03d}", "x", None, T) for i in range(120)]
    assert {r.component for r in g.components(spark.createDataFrame(rows, E)).collect()} == {"n000"}
    assert g.components(spark.createDataFrame([], E)).count() == 0 and g.pagerank(spark.createDataFrame([], E)).count() == 0


def test_pagerank(spark):
    rows, df = make(spark, 15, 40, 3)
    links = defaultdict(list)
    for a, b, *_ in rows:
        links[a].append(b)
        links[b].append(a)
    rank = {x: 1 / len(links) for x in links}
    for _ in range(20):
        new = {x: 0.15 / len(links) for x in links}
        for x, ys in links.items():
            for y in ys:
                new[y] += 0.85 * rank[x] / len(ys)
        rank = new
    got = {r.node: r.rank for r in g.pagerank(df, 20).collect()}
    assert all(abs(got[x] - rank[x]) < 2e-6 for x in rank)


def test_hops_and_round_trips(spark):
    rows, df = make(spark, 25, 45, 5)
    out = defaultdict(set)
    for a, b, *_ in rows:
        if a != b:
            out[a].add(b)
    depth, todo = {"n001": 0}, deque(["n001"])
    while todo:
        x = todo.popleft()
        for y in out[x]:
            if y not in depth and depth[x] < 3:
                depth[y] = depth[x] + 1
                todo.append(y)
    got = {r.node: r.depth for r in g.within_hops(df, spark.createDataFrame([("n001",)], "root string"), 3, directed=True).collect()}
    assert got == depth
    three = {r.cycle for r in g.round_trips(df).collect()}
    want = {f"{a}>{b}>{a}" for a in out for b in out[a] if a < b and a in out[b]} | {f"{a}>{b}>{c}>{a}" for a in out for b in out[a] for c in out[b] if c != a and a < b and a < c and a in out[c]}
    assert three == want


def test_sweep_clusters_and_address_lists(spark):
    import pytest

    from tracewright.operators import address_analytics as aa

    moves = spark.createDataFrame([("a", "x")] * 3 + [("a", "y"), ("b", "x"), ("c", "y"), ("c", "z"), ("d", "y")], "src string, dst string")
    assert [tuple(r) for r in g.sweep_clusters(g.sweeps(moves)).collect()] == [("x", 2, 4, "a")]
    assert g.sweep_clusters(g.sweeps(moves.limit(0))).count() == 0
    assert [r.address for r in aa.address_relation(spark, [" 0xB", "0xa", "0xb", ""]).collect()] == ["0xa", "0xb"]
    for bad in (["x" * 65], [str(i) for i in range(501)]):
        with pytest.raises(ValueError):
            aa.address_relation(spark, bad)


def test_round_trips_in_many_cells(spark):
    # Hubs, sinks, sources, self-transfers, null ends and names whose order isn't that of numbers; one cell, and cells that hold next to nothing.
    rng = random.Random(11)
    names = [f"A{i}" for i in range(60)] + ["é", "z", "", "A1>A2"]
    pairs = [(rng.choice(names), rng.choice(names[:8] if rng.random() < 0.4 else names)) for _ in range(900)]
    pairs += [("source", n) for n in names] + [(n, "sink") for n in names] + [(None, "A1"), ("A1", None), ("A2", "A2")]
    out = {n: set() for n in [*names, "source", "sink"]}
    for a, b in pairs:
        if None not in (a, b) and a != b:
            out[a].add(b)
    byte = lambda x: x.encode()
    want = [(f"{a}>{b}>{a}", 2) for a in out for b in out[a] if byte(a) < byte(b) and a in out[b]]
    want += [(f"{a}>{b}>{c}>{a}", 3) for a in out for b in out[a] for c in out[b] if c != a and byte(a) < min(byte(b), byte(c)) and a in out[c]]
    df = spark.createDataFrame(pairs, "src string, dst string")
    for cell_arcs in (g.CELL_ARCS, 80):
        assert sorted(tuple(r) for r in g.round_trips(df, cell_arcs=cell_arcs).collect()) == sorted(want)
    for none in (df.limit(0), spark.createDataFrame([("a", "b"), ("b", "c")], df.schema)):
        assert g.round_trips(none).collect() == [] and g.round_trips(none).dtypes == [("cycle", "string"), ("hops", "int")]


def test_round_trips_shuffle_no_pairs(spark):
    # What is shuffled grows as arcs times the number of classes; the pairs are never joined.
    df = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    plan = g.round_trips(df)._jdf.queryExecution().executedPlan().toString()
    # No join of the pairs with the arcs is planned, and each way out or in is sent to k tasks twice, whatever its node's degree.
    assert "MapInArrow" in plan and "Join" not in plan
    assert [g.deal(n, 1000) for n in (10, 32_000, 128_000)] == [3, 8, 16]


def test_marks_and_slices_lose_no_cycle(spark, monkeypatch):
    # Marks that nearly all collide, one node's arcs at a time and slices of a few pairs give the same cycles.
    _, df = make(spark, 40, 700, 3)
    want = sorted(tuple(r) for r in g.round_trips(df).collect())
    for name, v in (("MARKS", 8), ("MARKED", 1), ("TESTED", 3)):
        monkeypatch.setattr(g, name, v)
    assert want and sorted(tuple(r) for r in g.round_trips(df).collect()) == want
