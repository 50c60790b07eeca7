"""Problem 9: the flow against brute force, and what a mixture must keep."""

import itertools
import random
import time

import numpy as np
import pytest
from tracewright.llm import mixing as mx

D = "doc_id bigint, text string, source string, tokens string"
T = "source string, target_share double, max_repeats int"


def test_flow_is_maximal_and_cheapest():
    # Two patterns with convex cost (unit, steps) before free arcs of given capacity.
    arcs = [(0, 1, 2, 3), (0, 2, 3, 2), (1, 3, -4, 0), (1, 4, -3, 0), (2, 4, -5, 0), (3, 5, -3, 0), (4, 5, -6, 0)]
    flow = mx.convex_flow(6, arcs, 0, 5)
    cost = lambda f, unit: sum(k // unit for k in range(f))
    best = None
    for f in itertools.product(*[range((u * k if u > 0 else -u) + 1) for *_, u, k in arcs]):
        net = [0] * 6
        for x, (a, b, *_) in zip(f, arcs):
            net[a] -= x
            net[b] += x
        if all(n == 0 for n in net[1:5]):
            key = (-net[5], sum(cost(x, u) for x, (*_, u, _) in zip(f, arcs) if u > 0))
            best = key if best is None or key < best else best
    assert (-sum(x for x, (_, b, *_) in zip(flow, arcs) if b == 5), sum(cost(x, u) for x, (*_, u, _) in zip(flow, arcs) if u > 0)) == best


@pytest.mark.parametrize("seed", range(30))
def test_random_flows_reroute_as_they_should(seed):
    rng = random.Random(seed)
    names = "abc"
    patterns = [(m, rng.randrange(1, 6)) for k in (1, 2, 3) for m in itertools.combinations(names, k) if rng.random() < 0.6] or [(("a",), 3)]
    repeats, quotas = {s: rng.randrange(1, 4) for s in names}, {s: rng.randrange(0, 9) for s in names}
    flow = mx.route(patterns, quotas, repeats)
    used, got = dict.fromkeys([m for m, _ in patterns], 0), dict.fromkeys(names, 0)
    for (m, s), f in flow.items():
        assert f <= dict(patterns)[m] * repeats[s]
        used[m] += f
        got[s] += f
    # The same by one arc for each unit and repetition, solved as an assignment: every unit of quota takes the cheapest place left, with rerouting.
    assert all(got[s] <= quotas[s] for s in names)
    nx = {(m, k): t for m, t in patterns for k in range(sum(repeats[s] for s in m))}
    best = brute(nx, dict(patterns), quotas, repeats)
    assert (sum(got.values()), sum(sum(k // t for k in range(used[m])) for m, t in patterns)) == best


def brute(levels, tokens, quotas, repeats):
    """(most flow, least cost) by Bellman-Ford augmentation over explicit unit arcs, one arc for each repetition."""
    names = sorted(quotas)
    arcs = [("s", m, t, k) for (m, k), t in levels.items()] + [(m, s, tokens[m] * repeats[s], 0) for m in tokens for s in m] + [(s, "t", quotas[s], 0) for s in names]
    arcs = [[a, b, c, w] for a, b, c, w in arcs] + [[b, a, 0, -w] for a, b, c, w in arcs]
    half, flow, cost = len(arcs) // 2, 0, 0
    while True:
        far, via = {"s": 0}, {}
        for _ in range(len(tokens) + len(names) + 3):
            for i, (a, b, c, w) in enumerate(arcs):
                if c > 0 and a in far and far[a] + w < far.get(b, 10**9):
                    far[b], via[b] = far[a] + w, i
        if "t" not in far:
            return flow, cost
        x = "t"
        while x != "s":
            i = via[x]
            arcs[i][2] -= 1
            arcs[(i + half) % (2 * half)][2] += 1
            x = arcs[i][0]
        flow, cost = flow + 1, cost + far["t"]


def test_many_repetitions_are_one_arc():
    start = time.time()
    assert mx.route([(("a",), 7), (("a", "b"), 5)], {"a": 7 * 2000, "b": 50}, {"a": 20_000, "b": 20_000})[(("a",), "a")] > 0
    assert time.time() - start < 5


def test_rare_patterns_keep_one_source_and_lose_no_text(spark):
    rows = [(f"text {k} " * 3, s) for k, m in enumerate(["ab", "ab", "abc", "bc", "ac", "a", "c"]) for s in m]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.2, 2), ("c", 0.3, 2)], T)
    texts = mx.distinct_texts(docs, targets)
    few = mx.bounded_patterns(texts, targets, most=1)
    assert few.count() == texts.count() == 7 and few.agg({"tokens": "sum"}).first()[0] == texts.agg({"tokens": "sum"}).first()[0]
    kinds = {tuple(r.members) for r in few.collect()}
    assert sum(len(k) > 1 for k in kinds) == 1 and ("a", "b") in kinds
    for r in few.collect():
        assert [x.source for x in r.firsts] == r.members and all(docs.filter(f"doc_id = {x.doc_id}").first().source == x.source for x in r.firsts)


def test_overlap_is_used_where_it_saves_repetition():
    flow = mx.route([(("a",), 100), (("a", "b"), 50)], {"a": 100, "b": 50}, {"a": 2, "b": 2})
    assert flow == {(("a",), "a"): 100, (("a", "b"), "b"): 50}


def build(spark):
    docs = [(i, f"word{i} " * (1 + i % 7), "big", "") for i in range(300)] + [(1000 + i, f"text{i} " * 5, "small", "") for i in range(20)] + [(2000 + i, f"memo{i}", "mid", "") for i in range(60)]
    docs += [(3000, "word1 word1 ", "small", ""), (3001, "word1 word1 ", "big", ""), (3002, None, "big", ""), (3003, "", "big", ""), (3004, "zz", None, ""), (3005, "zz", "other", "")]
    targets = [("big", 0.5, 1), ("small", 0.3, 3), ("mid", 0.1, 2), ("absent", 0.1, 2)]
    return spark.createDataFrame(docs, D), spark.createDataFrame(targets, T)


def check(spark, docs, rows, targets):
    by = {r.doc_id: r for r in docs.collect()}
    most = {r.source: r.max_repeats for r in targets.collect()}
    assert all(1 <= r.copies <= most[r.source] and by[r.doc_id].source == r.source and by[r.doc_id].text for r in rows)
    seen = [(by[r.doc_id].text, r.source) for r in rows]
    assert len(seen) == len(set(seen))


def test_shares_are_reached_and_caps_kept(spark):
    docs, targets = build(spark)
    rows = mx.mixture(docs.drop("tokens"), targets).collect()
    check(spark, docs, rows, targets)
    got = {r.source: r for r in mx.shares(docs.drop("tokens"), targets).collect()}
    assert got["absent"].status == "no documents" and got["absent"].tokens == 0
    for s, share in (("big", 0.5 / 0.9), ("small", 0.3 / 0.9), ("mid", 0.1 / 0.9)):
        assert abs(got[s].actual_share - share) < 0.02, got[s]
        assert got[s].tokens == sum(r.tokens * r.copies for r in rows if r.source == s)
    assert sum(r.actual_share for r in got.values()) == pytest.approx(1, abs=1e-4)


def test_given_total_falls_short_and_says_so(spark):
    docs, targets = build(spark)
    rows = mx.mixture(docs.drop("tokens"), targets, total_tokens=100_000).collect()
    check(spark, docs, rows, targets)
    got = {r.source: r for r in mx.shares(docs.drop("tokens"), targets, total_tokens=100_000).collect()}
    assert got["small"].status == "all used" and got["small"].tokens == got["small"].capacity_tokens and got["small"].copies == 3


def test_registered_queries_mix_the_whole_corpus(spark, tmp_path):
    from tracewright.llm import queries

    docs, targets = build(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    targets.write.parquet(f"{tmp_path}/mix_targets.parquet")
    rows = queries.p9_mixture(spark, str(tmp_path)).collect()
    check(spark, docs, rows, targets)
    got = {r.source: r for r in queries.p9_shares(spark, str(tmp_path)).collect()}
    texts = mx.distinct_texts(docs.drop("tokens"), targets)
    total = texts.groupBy().sum("tokens").first()[0]
    # The scarce source is repeated to its cap and falls short of its share; it doesn't shrink the others.
    small = got["small"]
    assert small.capacity_tokens < 0.3 / 0.9 * total and small.status == "all used" and small.copies == 3
    assert small.tokens == small.capacity_tokens and small.actual_share < 0.3 / 0.9 - 0.05
    for s, share in (("big", 0.5 / 0.9), ("mid", 0.1 / 0.9)):
        assert got[s].status == "reached" and abs(got[s].tokens - share * total) < 20
    assert {r.doc_id: r.copies for r in rows if r.source == "small"} == {i: 3 for i in [*range(1000, 1020), 3000]}


def test_seed_and_empty(spark):
    docs, targets = build(spark)
    docs = docs.drop("tokens")
    ids = lambda seed: sorted((r.doc_id, r.copies) for r in mx.mixture(docs, targets, total_tokens=300, seed=seed).collect())
    assert ids(1) == ids(1) and ids(1) != ids(2)
    assert mx.mixture(docs.limit(0), targets).count() == 0 and mx.mixture(docs, targets.limit(0)).count() == 0
    assert {r.status for r in mx.shares(docs.limit(0), targets).collect()} == {"no documents"}


@pytest.mark.parametrize("seed", range(30))
def test_levels_give_a_maximal_cheapest_flow(seed):
    rng = random.Random(seed)
    names = "abcd"
    patterns = [(m, rng.randrange(1, 6)) for k in (1, 2, 3) for m in itertools.combinations(names, k) if rng.random() < 0.6] or [(("a",), 3)]
    repeats, quotas = {s: rng.randrange(1, 4) for s in names}, {s: rng.randrange(0, 9) for s in names}
    members = np.array([names.index(s) for m, _ in patterns for s in m])
    flow = mx.route_levels(np.array([len(m) for m, _ in patterns]), members, np.array([t for _, t in patterns]), np.array([*quotas.values()]), np.array([*repeats.values()]))
    arcs = [(m, t, s) for m, t in patterns for s in m]
    assert all(0 <= f <= t * repeats[s] for (_, t, s), f in zip(arcs, flow.tolist(), strict=True))
    used, got = dict.fromkeys([m for m, _ in patterns], 0), dict.fromkeys(names, 0)
    for (m, _, s), f in zip(arcs, flow.tolist()):
        used[m] += f
        got[s] += f
    assert all(got[s] <= quotas[s] for s in names)
    nx = {(m, k): t for m, t in patterns for k in range(sum(repeats[s] for s in m))}
    assert (sum(got.values()), sum(sum(k // t for k in range(used[m])) for m, t in patterns)) == brute(nx, dict(patterns), quotas, repeats)


def test_all_of_many_patterns_are_routed(spark):
    # 13 sources and 4,500 patterns. The texts shared with "m" are the rarest patterns; only whole membership lets "m" have its quota.
    assert mx.MAX_PATTERNS == 4096
    sources = [f"s{i:02d}" for i in range(13)]
    patterns = [m for k in range(2, 13) for m in itertools.combinations(sources, k)][:4500]
    rows = [(f"text {i} " * (3 if len(m) > 2 else 9), s) for i, m in enumerate(patterns) for s in (*m, *(["m"] if i >= 4300 else []))]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(s, 0.06, 1) for s in sources] + [("m", 0.22, 1)], T)
    texts = mx.distinct_texts(docs, targets)
    held = texts.filter("array_contains(members, 'm')").agg({"tokens": "sum"}).first()[0]
    got = {r.source: r for r in mx.shares(docs, targets, total_tokens="corpus").collect()}
    # As narrowed before, a text of a rarer pattern was no member of its other sources: "m" or those had less capacity than their texts hold.
    full = {r.source: r.n for r in texts.selectExpr("explode(members) AS source", "tokens").groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert {s: r.capacity_tokens for s, r in got.items()} == full and full["m"] == held
    assert got["m"].status == "all used" and got["m"].tokens == held
    assert all(abs(got[s].tokens - got[s].quota_tokens) < 200 for s in sources)
    rows = mx.mixture(docs, targets, total_tokens="corpus").collect()
    check(spark, docs, rows, targets)
    assert {r.source: sum(x.tokens * x.copies for x in rows if x.source == r.source) for r in got.values()} == {s: r.tokens for s, r in got.items()}
