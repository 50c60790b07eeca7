"""Mixing sources to target weights (problem 9): min-cost flow over membership patterns, then seeded selection.

A distinct text belongs to every target source that it occurs in: its membership pattern. Texts are aggregated by pattern, token capacity
is routed from patterns to source quotas at the least cost, where each further repetition of the same tokens costs more, and the routed
amounts are filled with texts in a seeded order.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.llm.tokens import token_counts
from tracewright.runtime import materialize, small

SEED, BUCKETS = 20240601, 1 << 16
#: As ``total_tokens``: as many tokens as the distinct texts of the sources with a share hold.
CORPUS = "corpus"
#: The most membership patterns that are routed one path at a time (:func:`route`); more are routed all at once (:func:`route_levels`).
MAX_PATTERNS = 4096


def convex_flow(n: int, arcs: Sequence[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, unit, steps) of a maximum flow of least cost, where the k-th ``unit`` that passes an arc costs k - 1 each.

    An arc holds at most unit * steps. It stands for one residual arc, at the cost of the step it is in (successive shortest paths with
    potentials), so memory and the work of a path don't grow with the number of steps. An arc whose unit is negative is free: capacity -unit.
    """
    graph: list[list[tuple[int, bool]]] = [[] for _ in range(n)]
    for e, (a, b, _, _) in enumerate(arcs):
        graph[a].append((e, True))
        graph[b].append((e, False))
    flow, potential = [0] * len(arcs), [0] * n

    def residual(e: int, forward: bool) -> tuple[int, int]:
        """(capacity, cost) of an arc's current step in a direction."""
        _, _, unit, steps = arcs[e]
        f = flow[e]
        if unit < 0:
            return (-unit - f if forward else f), 0
        if forward:
            step = f // unit if unit else steps
            return (unit * (step + 1) - f, step) if step < steps else (0, 0)
        step = -(-f // unit) - 1 if unit else -1
        return (f - unit * step, -step) if f else (0, 0)

    while True:
        far: list[int | None] = [None] * n
        via: list[tuple[int, bool] | None] = [None] * n
        far[source] = 0
        heap = [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e, forward in graph[x]:
                capacity, cost = residual(e, forward)
                if capacity > 0:
                    to = arcs[e][1 if forward else 0]
                    nd = d + cost + potential[x] - potential[to]
                    if far[to] is None or nd < far[to]:
                        far[to], via[to] = nd, (e, forward)
                        heapq.heappush(heap, (nd, to))
        if far[sink] is None:
            return flow
        for x in range(n):
            if far[x] is not None:
                potential[x] += far[x]
        path, x = [], sink
        while x != source:
            e, forward = via[x]
            path.append((e, forward))
            x = arcs[e][0 if forward else 1]
        push = min(residual(e, forward)[0] for e, forward in path)
        for e, forward in path:
            flow[e] += push if forward else -push


def route(patterns: list[tuple[tuple[str, ...], int]], quotas: dict[str, int], repeats: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source: quotas are met as far as capacity allows, with the least repetition of the same text.

    A text may be used at most repeats[s] times for source s; using the same tokens for the k-th time overall costs k - 1 a token.
    """
    names = sorted(quotas)
    at = {s: i for i, s in enumerate(names)}
    p0, s0 = 2, 2 + len(patterns)
    arcs, meaning = [], []
    for i, (members, tokens) in enumerate(patterns):
        arcs.append((0, p0 + i, tokens, sum(repeats[s] for s in members)))
        meaning.append(None)
        for s in members:
            arcs.append((p0 + i, s0 + at[s], -tokens * repeats[s], 0))
            meaning.append((members, s))
    for s in names:
        arcs.append((s0 + at[s], 1, -quotas[s], 0))
        meaning.append(None)
    flow = convex_flow(s0 + len(names), arcs, 0, 1)
    return {m: f for m, f in zip(meaning, flow) if m is not None and f > 0}


def route_levels(sizes: np.ndarray, members: np.ndarray, tokens: np.ndarray, quotas: np.ndarray, repeats: np.ndarray) -> np.ndarray:
    """What :func:`route` gives, for any number of patterns: the tokens that each pattern gives to each of its sources, in the order of ``members``.

    ``members`` has the patterns' sources one after the other, ``sizes`` how many are each pattern's. A path of the flow enters one pattern, and
    what it reroutes leaves other patterns as much used as they were, so it costs the level of that pattern alone. The cheapest flow is therefore
    a maximum flow in which every pattern is used at most once, extended to a maximum flow with at most two uses, and so on. Paths lead
    over sources only, along all patterns that join two of them at once, so work is patterns times paths among sources.
    """
    pattern = np.repeat(np.arange(len(sizes)), sizes)
    room = tokens[pattern] * repeats[members]
    flow, used, left = np.zeros(len(members), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), quotas.astype(np.int64)
    arcs = [np.flatnonzero(members == s) for s in range(len(quotas))]

    def spread(most: np.ndarray, amount: int) -> np.ndarray:
        """``amount`` dealt in order, at most ``most`` each."""
        return np.clip(amount - (np.cumsum(most) - most), 0, most)

    def move(s: int, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs of s, those of t of the same patterns, and what each pattern can take from s and give to t."""
        at = np.full(len(sizes), -1)
        at[pattern[arcs[t]]] = arcs[t]
        a = arcs[s][at[pattern[arcs[s]]] >= 0]
        b = at[pattern[a]]
        return a, b, np.minimum(flow[a], room[b])

    def towards() -> dict[int, int | None]:
        """The next source on a shortest way to one with quota left, by source; nearest first."""
        way: dict[int, int | None] = {int(t): None for t in np.flatnonzero(left > 0)}
        todo = deque(way)
        while todo:
            t = todo.popleft()
            takes = np.zeros(len(sizes), dtype=bool)
            takes[pattern[arcs[t][room[arcs[t]] > 0]]] = True
            for s in np.unique(members[(flow > 0) & takes[pattern]]).tolist():
                if s not in way:
                    way[s] = t
                    todo.append(s)
        return way

    level = 0
    while True:
        way, moved = towards(), False
        for s in way:
            into = arcs[s]
            enter = np.minimum(room[into], (level + 1) * tokens[pattern[into]] - used[pattern[into]])
            hops, x = [], s
            while way[x] is not None:
                hops.append(move(x, way[x]))
                x = way[x]
            amount = min([int(enter.sum()), int(left[x]), *(int(m.sum()) for *_, m in hops)])
            if amount <= 0:
                continue
            moved = True
            give = spread(enter, amount)
            flow[into] += give
            room[into] -= give
            used[pattern[into]] += give
            left[x] -= amount
            for a, b, m in hops:
                give = spread(m, amount)
                flow[a] -= give
                room[a] += give
                flow[b] += give
                room[b] -= give
        if moved:
            continue
        # No further use of a pattern helps unless it can give to a source on the way; the next level is the least used of those.
        on_way = np.zeros(len(quotas), dtype=bool)
        on_way[list(way)] = True
        more = pattern[on_way[members] & (room > 0)]
        if not len(more):
            return flow
        level = int((used[more] // tokens[more]).min())


def distinct_texts(docs: DataFrame, targets: DataFrame, **tokenizer: str) -> DataFrame:
    """(t, members, tokens, firsts) of the distinct non-empty texts of target sources: members are the sources they occur in, firsts the least doc_id in each.

    Tokens are counted while the documents are read; after that only the texts' hashes travel.
    """
    named = F.broadcast(targets.filter(F.col("source").isNotNull() & (F.col("max_repeats") > 0)).select("source").distinct())  # one row per source
    rows = docs.filter(F.col("text").isNotNull() & (F.col("text") != "")).join(named, "source").select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("t"), "text")
    sized = token_counts(rows, keep=["doc_id", "source", "t"], **tokenizer).filter("tokens > 0")
    ones = sized.groupBy("t", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
    firsts = F.array_sort(F.collect_list(F.struct("source", "doc_id")))
    grouped = ones.groupBy("t").agg(firsts.alias("firsts"), F.max("tokens").alias("tokens"))
    return materialize(grouped.select("t", F.transform("firsts", lambda x: x.source).alias("members"), "tokens", "firsts"), "texts")


def bounded_patterns(texts: DataFrame, targets: DataFrame, most: int = MAX_PATTERNS) -> DataFrame:
    """``texts`` with at most ``most`` membership patterns of several sources, the largest by tokens. A text of a rarer pattern stays a
    member of one of its sources only, the one with the least tokens for its share; no text is lost.

    The mixture doesn't use it: all patterns are routed as they are. It is for who wants fewer of them."""
    kinds = texts.filter(F.size("members") > 1).groupBy("members").agg(F.sum("tokens").alias("n"))
    if kinds.count() <= most:
        return texts
    kept = kinds.orderBy(F.desc("n"), F.array_join("members", "\x01")).limit(most).select("members", F.lit(True).alias("kept"))
    held = {r.source: r.n for r in texts.select(F.explode("members").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # one row per source
    share = {r.source: float(r.target_share or 0) for r in targets.collect() if r.source is not None}
    order = sorted(held, key=lambda s: (held[s] / share[s] if share.get(s) else float("inf"), s))
    ranks = F.create_map(*[x for i, s in enumerate(order) for x in (F.lit(s), F.lit(i))])
    least = F.array_min(F.transform("firsts", lambda x: F.struct(ranks[x.source].alias("rank"), x.source.alias("source"), x.doc_id.alias("doc_id"))))
    one = texts.join(F.broadcast(kept), "members", "left").withColumn("one", F.when((F.size("members") > 1) & F.col("kept").isNull(), least))
    narrow = F.when(F.col("one").isNull(), F.col("firsts")).otherwise(F.array(F.struct("one.source", "one.doc_id")))
    return materialize(one.select("t", F.transform(narrow, lambda x: x.source).alias("members"), "tokens", narrow.alias("firsts")), "texts")


def plan(texts: DataFrame, targets: DataFrame, total_tokens: int | str | None = None) -> tuple[pa.Table, dict]:
    """(pattern, source and flow of every pattern that gives tokens to a source; report by source).

    With ``total_tokens`` (a number or CORPUS) sources whose capacity is too small are repeated to their cap, fall short, and the report says
    so. Without it the mixture shrinks to the largest in which every source that has texts reaches its share. Shares of sources without texts
    are spread over the others in proportion.

    All patterns are routed, and as they are. More than MAX_PATTERNS reach the driver as numbers, 4 bytes a member and 8 a pattern.
    """
    kinds = texts.groupBy("members").agg(F.sum("tokens").alias("tokens"))
    patterns = sorted((tuple(r.members), int(r.tokens)) for r in kinds.limit(MAX_PATTERNS + 1).collect())
    few = len(patterns) <= MAX_PATTERNS
    want = {r.source: (float(r.target_share or 0), int(r.max_repeats or 0)) for r in targets.collect() if r.source is not None}
    capacity = dict.fromkeys(want, 0)
    if few:
        for members, tokens in patterns:
            for s in members:
                capacity[s] += tokens * want[s][1]
    else:
        kinds = materialize(kinds, "kinds")
        for r in kinds.select(F.explode("members").alias("source"), "tokens").groupBy("source").agg(F.sum("tokens").alias("tokens")).collect():  # one row per source
            capacity[r.source] = int(r.tokens) * want[r.source][1]
    live = {s: share for s, (share, _) in want.items() if capacity[s] > 0 and share > 0}
    whole = sum(live.values()) or 1.0
    shares = {s: x / whole for s, x in live.items()}
    if total_tokens is None:
        total_tokens = int(min((capacity[s] / x for s, x in shares.items()), default=0))
    elif total_tokens == CORPUS and few:
        total_tokens = sum(tokens for members, tokens in patterns if any(s in shares for s in members))
    elif total_tokens == CORPUS:
        total_tokens = int(kinds.filter(F.exists("members", lambda x: x.isin(*shares))).agg(F.sum("tokens")).first()[0] or 0)
    quotas = {s: min(round(x * total_tokens), capacity[s]) for s, x in shares.items()}
    report = {s: {"target_share": want[s][0], "max_repeats": want[s][1], "capacity": capacity[s], "live_share": shares.get(s, 0.0), "quota": quotas.get(s, 0)} for s in want}
    names = sorted(quotas)
    if few:
        merged: dict[tuple[str, ...], int] = {}
        for members, tokens in patterns:
            if m := tuple(s for s in members if s in quotas):
                merged[m] = merged.get(m, 0) + tokens
        flow = sorted(route(sorted(merged.items()), quotas, {s: want[s][1] for s in quotas}).items())
        return pa.table({"pattern": pa.array(["\x01".join(m) for (m, _), _ in flow], pa.string()), "source": pa.array([s for (_, s), _ in flow], pa.string()), "flow": pa.array([f for _, f in flow], pa.int64())}), report
    place = F.create_map(*[x for i, s in enumerate(names) for x in (F.lit(s), F.lit(i))]) if names else F.lit(None)
    usable = F.array_sort(F.transform(F.filter("members", lambda x: x.isin(*names)), lambda x: place[x])).alias("members")
    got = kinds.select(usable, "tokens").filter(F.size("members") > 0).groupBy("members").agg(F.sum("tokens").alias("tokens")).orderBy("members").toArrow()
    lists = got["members"].combine_chunks()
    sizes, members = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
    sent = route_levels(sizes, members, got["tokens"].to_numpy().astype(np.int64), np.array([quotas[s] for s in names], dtype=np.int64), np.array([want[s][1] for s in names], dtype=np.int64))
    arc = np.flatnonzero(sent)
    spelt = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(names, pa.string()).take(pa.array(members))), "\x01")
    table = {"pattern": spelt.take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[arc])), "source": pa.array(names, pa.string()).take(pa.array(members[arc])), "flow": pa.array(sent[arc])}
    return pa.table(table), report


def select(texts: DataFrame, flow: pa.Table, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copies, tokens): every text of a pattern as often as the routed tokens hold all of them, the rest in a seeded order.

    The order's cut is found by a histogram of hash buckets: below the bucket where a pattern's tokens run out all texts are taken once
    more, above it none, and inside it a running sum decides, so no task sorts more than one bucket of a pattern.
    """
    spark = texts.sparkSession
    asked = spark.createDataFrame(flow.to_pylist() if len(flow) <= MAX_PATTERNS else flow, "pattern string, source string, flow bigint")  # at most one row per pattern and source
    near = F.broadcast if small(asked) else lambda df: df
    used = sorted(flow["source"].unique().to_pylist())
    usable = F.filter("firsts", lambda x: x.source.isin(*used))
    rows = texts.select("t", "tokens", F.array_join(F.array_sort(F.transform(usable, lambda x: x.source)), "\x01").alias("pattern"), F.explode(usable).alias("m")).select("t", "tokens", "pattern", "m.source", "m.doc_id")
    order = F.xxhash64("t", "source", F.lit(seed))
    rows = materialize(rows.join(near(asked), ["pattern", "source"]).select("pattern", "source", "flow", "doc_id", "tokens", F.pmod(order, F.lit(BUCKETS)).cast("int").alias("bucket"), order.alias("rank")), "chosen")
    held = rows.groupBy("pattern", "source", "flow", "bucket").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy("pattern", "source")
    sums = held.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    rest = F.col("flow") % F.col("all")
    at = F.min(F.when(F.col("upto") > rest, F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))))
    cut = sums.groupBy("pattern", "source").agg(F.floor(F.max("flow") / F.max("all")).cast("int").alias("full"), F.max(rest).alias("rest"), at.alias("at"))
    b = rows.drop("flow").join(near(cut), ["pattern", "source"]).withColumn("edge", F.col("at.bucket"))  # one row per pattern and source, as in asked
    whole = b.filter("bucket <> edge").withColumn("copies", F.col("full") + F.when(F.col("bucket") < F.col("edge"), 1).otherwise(0))
    run = F.col("at.before") + F.sum("tokens").over(w.orderBy("rank", "doc_id"))
    # The text on the cut is taken if that comes nearer to what was asked.
    edge = b.filter("bucket = edge").withColumn("run", run).withColumn("copies", F.col("full") + F.when(F.col("run") - F.col("tokens") / 2 <= F.col("rest"), 1).otherwise(0))
    out = ["doc_id", "source", "copies", "tokens"]
    return whole.select(*out).unionByName(edge.select(*out)).filter("copies > 0")


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = SEED, **tokenizer: str) -> DataFrame:
    """(doc_id, source, copies, tokens): the documents of the mixture, how often each is repeated, and the tokens of one copy.

    A text that occurs several times in a source counts once there (its least doc_id stands for it), so that copies never exceed
    max_repeats. Null, empty and blank-source documents and sources without a target take no part. Empty tables give no rows.
    """
    texts = distinct_texts(docs, targets, **tokenizer)
    return select(texts, plan(texts, targets, total_tokens)[0], seed)


def shares(docs: DataFrame, targets: DataFrame, total_tokens: int | str | None = None, seed: int = SEED, **tokenizer: str) -> DataFrame:
    """Per target source: target_share, live_share (after spreading the shares of sources without texts), capacity_tokens, quota_tokens,
    tokens and documents in the mixture, copies (the most of any document), actual_share and status."""
    texts = distinct_texts(docs, targets, **tokenizer)
    flow, report = plan(texts, targets, total_tokens)
    got = select(texts, flow, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("copies"))
    table = [(s, r["target_share"], r["live_share"], r["max_repeats"], r["capacity"], r["quota"]) for s, r in sorted(report.items())]
    asked = docs.sparkSession.createDataFrame(table, "source string, target_share double, live_share double, max_repeats int, capacity_tokens bigint, quota_tokens bigint")
    both = asked.join(F.broadcast(got), "source", "left")  # one row per source
    tokens = F.coalesce("tokens", F.lit(0))
    return both.select(
        "source", "target_share", F.round("live_share", 6).alias("live_share"), "max_repeats", "capacity_tokens", "quota_tokens", tokens.alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("copies", F.lit(0)).alias("copies"),
        F.round(F.coalesce(F.try_divide(tokens, F.sum(tokens).over(Window.partitionBy())), F.lit(0.0)), 6).alias("actual_share"),
        F.when(F.col("capacity_tokens") == 0, "no documents").when(F.col("quota_tokens") == F.col("capacity_tokens"), "all used").otherwise("reached").alias("status"),
    )
