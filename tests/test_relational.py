"""As-of joins, ranges, lookups of hot keys, pages."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright import runtime
from tracewright.operators import relational as rl

T = datetime(2024, 1, 1)


def test_final_view_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, None, 5, "b"), (1, None, 5, "c"), (1, None, 4, "z"), (None, None, None, "n")], "k int, j int, v int, x string")
    assert sorted((r.k or 0, r.x) for r in rl.final_view(df, ["k", "j"], ["v"]).collect()) == [(0, "n"), (1, "c")]


def test_asof_against_brute_force(spark):
    rng = random.Random(4)
    f = [(i, rng.choice("ab"), T + timedelta(seconds=rng.randrange(500))) for i in range(200)] + [(900, None, T), (901, "a", None)]
    d = [(rng.choice("ab"), T + timedelta(seconds=s), s) for s in rng.sample(range(500), 60)]
    got = {r.i: r.v for r in rl.asof_left(spark.createDataFrame(f, "i int, k string, t timestamp"), spark.createDataFrame(d, "k string, u timestamp, v int"), ["k"], "t", "u", ["v"], 60).collect()}
    want = {}
    for i, k, t in f:
        best = max(((u, v) for kk, u, v in d if kk == k and t is not None and u <= t), default=None)
        want[i] = best[1] if best and (t - best[0]).total_seconds() <= 60 else None
    assert got == want


def test_lookup_of_a_large_side_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(runtime, "small", lambda *a, **k: False)
    monkeypatch.setattr(runtime, "SAMPLE_SHARE", 0.5)
    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", i % 2) for i in range(3000)], "i int, k string, b int")
    dim = spark.createDataFrame([("hot", 0, 1), ("hot", 1, 2), (None, 0, 3)] + [(f"k{j}", 1, 100 + j) for j in range(0, 50, 2)], "k string, b int, v int")
    got = {r.i: r.v for r in runtime.skew_safe_lookup(rows, dim, ["k", "b"], ["v"]).collect()}
    table = {(r.k, r.b): r.v for r in dim.collect()}
    assert got == {r.i: table.get((r.k, r.b)) for r in rows.collect()}


def test_small_is_counted_not_guessed(spark):
    assert runtime.small(spark.range(10), rows=10) and not runtime.small(spark.range(11), rows=10)


def test_gaps_and_ranges(spark):
    b = spark.createDataFrame([("a", x) for x in (1, 2, 5, 9, 9)] + [("b", 3)], "k string, b bigint")
    assert sorted((r.k, r.gap_from, r.gap_to, r.missing) for r in rl.gaps(b, ["k"], "b", 1).collect()) == [("a", 3, 4, 2), ("a", 6, 8, 3)]
    r = spark.createDataFrame([("a", 1, 5), ("a", 6, 7), ("a", 9, 12), ("a", 10, 11), ("b", 1, 1)], "k string, lo bigint, hi bigint")
    assert sorted((x.k, x.lo, x.hi, x.ranges) for x in rl.merge_ranges(r, ["k"], "lo", "hi").collect()) == [("a", 1, 7, 2), ("a", 9, 12, 2), ("b", 1, 1, 1)]


def test_cover_share(spark):
    df = spark.createDataFrame([(f"e{i:03d}", float(i)) for i in range(100)], "e string, a double").select("e", F.col("a").cast("decimal(18,2)").alias("a"))
    got = {r.e for r in rl.cover_share(df, "a", [F.desc("a"), F.col("e")], 0.5).collect()}
    want, run = set(), 0
    for i in range(99, -1, -1):
        if run < 4950 * 0.5:
            want.add(f"e{i:03d}")
        run += i
    assert got == want


def test_keyset_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(i // 3, i) for i in range(50)], "g int, i int")
    seen, cursor = [], None
    while rows := rl.keyset_page(df, ["g", "i"], cursor, 7).collect():
        seen += [(r.g, r.i) for r in rows]
        cursor = seen[-1]
    assert seen == sorted(seen, reverse=True) and len(seen) == 50


def plain_running(rows):
    """rows: (key, order, in, out) -> by key and order: sums so far, greatest excess so far, the same before, greatest in before."""
    out, state = {}, {}
    for k, o, i, u in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        a, b, high, top = state.get(k, (0, 0, 0, None))
        new = (a + i, b + u, max(high, b + u - a - i), i if top is None else max(top, i))
        out[k, o] = (new[0], new[1], new[2], high, top)
        state[k] = new
    return out


@pytest.fixture
def many_parts(spark):
    """Range partitions of small tables aren't put together again."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_values_of_a_key_with_most_rows(spark, many_parts):
    rng = random.Random(3)
    rows = [("hot" if n % 10 else None if n % 30 == 0 else f"k{n % 7}", n, rng.randrange(9), rng.randrange(9)) for n in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, o int, i int, u int").repartition(7)
    got = rl.running(df, ["k"], ["o"], {"a": F.col("i"), "b": F.col("u")}, highs={"h": ("b", "a")}, before={"t": F.col("i")}, earlier_highs={"e": "h"})
    assert {(r.k, r.o): (r.a, r.b, r.h, r.e, r.t) for r in got.collect()} == plain_running(rows)
    # The hot key is spread over partitions.
    assert rl.ranged(df, ["k"], ["o"], "t").filter("k = 'hot'").select("__p").distinct().count() > 1
    assert rl.running(df.limit(0), ["k"], ["o"], {"a": F.col("i")}).count() == 0


def test_percentiles_and_ranges_of_a_hot_key(spark, many_parts):
    rng = random.Random(4)
    rows = [("hot" if n % 10 else f"k{n % 5}", rng.choice([rng.randrange(50), rng.randrange(10**6)])) for n in range(3000)] + [("hot", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = {r.k: r.p for r in rl.rank_pick(df, ["k"], "v", F.floor((F.col("n") - 1) * 0.9) + 1, "p").collect()}
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert got == {k: sorted(v)[int((len(v) - 1) * 0.9)] for k, v in want.items()}
    spans = [("hot" if n % 10 else f"k{n % 5}", a := rng.randrange(40000), a + rng.randrange(12)) for n in range(3000)]
    merged = []
    for k in {s[0] for s in spans}:
        mine = sorted(s[1:] for s in spans if s[0] == k)
        lo, hi, n = *mine[0], 1
        for a, b in mine[1:]:
            if a > hi + 1:
                merged.append((k, lo, hi, n))
                lo, hi, n = a, b, 1
            else:
                hi, n = max(hi, b), n + 1
        merged.append((k, lo, hi, n))
    out = rl.merge_ranges(spark.createDataFrame(spans, "k string, lo int, hi int"), ["k"], "lo", "hi")
    assert sorted((r.k, r.lo, r.hi, r.ranges) for r in out.collect()) == sorted(merged)


def test_a_cluster_must_name_the_shared_folder():
    from types import SimpleNamespace

    def fake(master, named=None):
        conf = SimpleNamespace(get=lambda k, d=None: named, set=lambda k, v: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            runtime.shared_dir(fake(master))
        assert runtime.shared_dir(fake(master, "hdfs://n/shared/")) == "hdfs://n/shared"
    assert runtime.shared_dir(fake("local[4]")).startswith("file://")


def test_cursors_are_bound_to_their_scope():
    text = rl.cursor({"chain": 1, "address": "0xa"}, [5, "x"])
    assert rl.read_cursor(text, {"address": "0xa", "chain": 1}, 2) == ["5", "x"]
    for bad, scope, width in ((text, {"chain": 2, "address": "0xa"}, 2), (text, {"chain": 1, "address": "0xa"}, 3), ("!!", {}, 1), ("e30=", {}, 1)):
        with pytest.raises(ValueError):
            rl.read_cursor(bad, scope, width)


def test_facets_and_search(spark):
    df = spark.createDataFrame([("Ab",), ("ab",), ("xab",), (None,), ("zz",), ("ab",)], "c string")
    assert [(r.value, r.n) for r in rl.facet(df, "c", "AB", 2).collect()] == [("ab", 2), ("Ab", 1)]
    got = [(r.kind, r.label, r["rank"], r.n) for r in rl.search({"k": (df, "c"), "l": (df.filter("c = 'zz'"), "c")}, "Ab").collect()]
    assert got == [("k", "Ab", 3, 1), ("k", "ab", 3, 2), ("k", "xab", 1, 1)]
    assert rl.search({"k": (df, "c"), "l": (df, "c")}, "nothing").count() == 0
