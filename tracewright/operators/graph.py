"""Flow graphs as (nodes, edges) DataFrames: building, degree, PageRank, components, bounded searches, paths, patterns."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import discard, materialize, skew_safe_lookup, small, written

D18 = "decimal(38,18)"


def edges_of(transfers: DataFrame) -> DataFrame:
    """One edge per (src, dst, token) with amount, transfers, first and last time."""
    return transfers.groupBy("src", "dst", "token").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


def merge_edges(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two edge tables as one; amounts add up, so each chunk must be applied once."""
    return a.unionByName(b).groupBy("src", "dst", "token").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"), F.sum("n").alias("n"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"))


def degrees(edges: DataFrame) -> DataFrame:
    """G1: undirected degree (a self-loop counts twice) and weighted degree."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node"), "amount").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum("amount").cast("decimal(38,2)").alias("weighted"))


def node_stats(edges: DataFrame) -> DataFrame:
    """In and out sums and counts per node."""
    side = F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out"))))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    return edges.select(side, "amount", "n").groupBy("node").agg(
        z(F.when(~F.col("out"), F.col("amount"))).alias("total_in"), z(F.when(F.col("out"), F.col("amount"))).alias("total_out"), F.count_if(~F.col("out")).alias("in_edges"), F.count_if("out").alias("out_edges"), F.sum("n").alias("transfers")
    )


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, checkpoint_every: int = 10) -> DataFrame:
    """PageRank of the undirected multigraph, dangling mass spread evenly, rounded to 6 digits.

    Links are pre-aggregated to (node, neighbour, weight) and written once; ranks are cut from their lineage every few rounds. No node is
    dangling in an undirected graph, so a round is one join and one aggregation.
    """
    links = edges.select(F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    degree = links.groupBy("a").agg(F.sum("w").alias("all"))
    links = skew_safe_lookup(links, degree, ["a"], ["all"]).select("a", "b", (F.col("w") / F.col("all")).alias("share"))
    # Sorted by receiver, so that most of a round's sums are complete before they are shuffled; a range cuts a hub's links where a hash wouldn't.
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # named, or small links would be put into one partition
    links = materialize(links.repartitionByRange(parts, "b", "a").sortWithinPartitions("b"), "links")
    nodes = materialize(links.select(F.col("a").alias("node")).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks, last = nodes.withColumn("rank", F.lit(1.0 / n)), None
    for i in range(1, iterations + 1):
        got = ranks.join(links, ranks.node == links.a).groupBy(F.col("b").alias("node")).agg((F.sum(F.col("rank") * F.col("share")) * damping + (1 - damping) / n).alias("rank"))
        if i % checkpoint_every == 0:
            ranks, at = written(got, "ranks")
            discard(edges.sparkSession, last)
            last = at
        else:
            ranks = got
    return ranks.select("node", F.round("rank", 6).alias("rank"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the component named by its least node: large-star and small-star until nothing changes."""
    both = edges.select("src", "dst").filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    nodes = both.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    e, last = written(both.filter(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "stars")
    mark = None
    while True:
        sym = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = sym.groupBy("u").agg(F.min("v").alias("m"))
        large = sym.join(low.withColumn("m", F.least("u", "m")), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        e, at = written(small, "stars")
        discard(edges.sparkSession, last)
        last = at
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    named = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def patterns(stats: DataFrame, least: int = 10) -> DataFrame:
    """Hubs, sinks and spreaders of node statistics; the first that applies."""
    i, o = F.col("in_edges"), F.col("out_edges")
    kind = F.when((i >= least) & (o >= least), "hub").when((i >= least) & (i > 2 * o), "sink").when((o >= least) & (o > 2 * i), "spreader")
    return stats.withColumn("pattern", kind).filter(F.col("pattern").isNotNull()).select("node", "pattern", "in_edges", "out_edges")


def within_hops(edges: DataFrame, roots: DataFrame, hops: int, directed: bool = False) -> DataFrame:
    """(node, depth) of all nodes within ``hops`` of any root, level by level; each level is one join and one anti join.

    The pairs of the graph are written once; a front that is counted to be small is broadcast, so such a level moves no pair."""
    pairs = materialize(edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct(), "pairs")
    seen = materialize(roots.select(F.col("root").alias("node")).distinct().withColumn("depth", F.lit(0)), "seen")
    front = seen
    for k in range(1, hops + 1):
        at = front.select("node")
        at = F.broadcast(at) if small(at) else at
        nxt = pairs.join(at, F.col("src") == F.col("node")).select(F.col("dst").alias("node"))
        if not directed:
            nxt = nxt.union(pairs.join(at, F.col("dst") == F.col("node")).select(F.col("src").alias("node")))
        known = seen.select("node")
        front = materialize(nxt.distinct().join(known, "node", "left_anti").withColumn("depth", F.lit(k)), "front")
        seen = seen.unionByName(front)
    return seen


def trace_tree(edges: DataFrame, root: str, hops: int) -> DataFrame:
    """The tree of first reaches from ``root`` along edges: (node, depth, parent, amount); the parent with the largest edge, then the last by name."""
    step = edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("amount").cast("decimal(38,2)").alias("amount"))
    seen = edges.sparkSession.createDataFrame([(root, 0)], "node string, depth int").withColumn("parent", F.lit(None).cast("string")).withColumn("amount", F.lit(None).cast("decimal(38,2)"))
    front = seen
    for k in range(1, hops + 1):
        reach = front.select("node").join(step, F.col("node") == F.col("src")).groupBy("dst").agg(F.max_by(F.struct("src", "amount"), F.struct("amount", "src")).alias("p"))
        nxt = reach.select(F.col("dst").alias("node"), F.lit(k).alias("depth"), F.col("p.src").alias("parent"), F.col("p.amount").alias("amount"))
        front = materialize(nxt.join(seen.select("node"), "node", "left_anti"), "front")
        seen = seen.unionByName(front)
    return seen


#: Arcs that one task of :func:`round_trips` holds (some 60 bytes each in its worker), and the fewest ways in which nodes are dealt.
CELL_ARCS, LEAST_DEAL = 6_000_000, 3


def deal(arcs: int, cell_arcs: int = CELL_ARCS) -> int:
    """The number of classes of nodes with which a task of :func:`round_trips`, a cell of classes x classes x classes, holds about ``cell_arcs`` of ``arcs``."""
    return max(LEAST_DEAL, math.ceil(math.sqrt(2 * arcs / cell_arcs)))


def round_trips(edges: DataFrame, longest: int = 3, cell_arcs: int = CELL_ARCS) -> DataFrame:
    """Cycles of 2 or 3 edges, each named once from its least node.

    A cycle of three is looked for at its node of least degree (ties by name), between a way in and a way out that both lead to greater
    nodes. A hub therefore meets only other hubs, and the pairs looked at are at most edges^1.5, not the square of a hub's degree.

    The pairs themselves never travel. Nodes are numbered in the order of their names and dealt into k classes by number; a task has one
    class each for the least node, the next and the last, and gets only the arcs between them, as lists, from which :func:`_cycles_in_cell`
    makes the pairs and tests them at once. So 2 k numbers an arc are shuffled, with k in proportion to the root of the number of arcs.
    """
    e = edges.select("src", "dst").filter(F.col("src") != F.col("dst")).distinct()
    if longest < 3:
        a, b = e.alias("a"), e.alias("b")
        two = a.join(b, (F.col("a.dst") == F.col("b.src")) & (F.col("b.dst") == F.col("a.src"))).filter(F.col("a.src") < F.col("a.dst"))
        return two.select(F.concat_ws(">", "a.src", "a.dst", "a.src").alias("cycle"), F.lit(2).alias("hops"))
    e, path = written(e, "arcs")
    # Only a node with ways in and out lies on a cycle; the others' arcs are left out.
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o")))).alias("x")
    degree = e.select(ends).groupBy("x.node").agg(F.count(F.lit(1)).alias("d"), F.sum("x.o").alias("o")).filter("o > 0 AND o < d")
    # Numbers without gaps: the place in a range partition, behind all earlier partitions.
    placed = materialize(degree.select("node", "d").orderBy("node").withColumn("m", F.monotonically_increasing_id()), "nodes")
    sizes = sorted((r.p, r.n) for r in placed.groupBy(F.shiftright("m", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    before = dict(zip([p for p, _ in sizes], itertools.accumulate([0, *[n for _, n in sizes]])))
    nodes = sum(n for _, n in sizes)
    number = "int" if nodes < 1 << 31 else "bigint"
    if not nodes:
        return edges.sparkSession.createDataFrame([], "cycle string, hops int")
    first = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for x in itertools.chain(*before.items())]), F.shiftright("m", 33))
    known = placed.select("node", "d", (first + F.col("m").bitwiseAND((1 << 33) - 1)).cast(number).alias("id"))
    numbered = e
    for side in ("src", "dst"):
        numbered = skew_safe_lookup(numbered.withColumnRenamed(side, "node"), known, ["node"], ["d", "id"]).filter("id IS NOT NULL").drop("node").withColumnsRenamed({"d": f"{side}_d", "id": f"{side}_id"})
    up = F.struct("src_d", "src_id") < F.struct("dst_d", "dst_id")
    low, high = F.when(up, F.col("src_id")).otherwise(F.col("dst_id")), F.when(up, F.col("dst_id")).otherwise(F.col("src_id"))
    numbered = materialize(numbered.select(low.alias("low"), high.alias("high"), up.alias("out")), "numbered")
    discard(edges.sparkSession, path)
    k = deal(numbered.count(), cell_arcs)
    # A node's arcs to greater nodes are at most the root of twice all arcs.
    lists = numbered.groupBy("low", "out", (F.col("high") % k).cast("int").alias("g")).agg(F.collect_list("high").alias("highs"))
    own, every = (F.col("low") % k).cast("int"), F.sequence(F.lit(0), F.lit(k - 1))
    cell = lambda i, j, l: (i * k + j) * k + l
    g, out = F.col("g"), F.col("out")
    # Ways out of and into the least node, and arcs from the next node to the last, which either of them may list.
    ways = F.transform(every, lambda x: F.struct(F.lit(0).alias("closing"), F.when(out, cell(own, g, x)).otherwise(cell(own, x, g)).alias("cell")))
    closing = F.transform(every, lambda x: F.struct(F.lit(1).alias("closing"), F.when(out, cell(x, own, g)).otherwise(cell(x, g, own)).alias("cell")))
    sent = lists.select(F.inline(F.concat(ways, closing)), "low", "out", "highs", F.lit(None).cast("string").alias("name"))
    mine = (F.col("id") % k).cast("int")
    cells = F.array_distinct(F.flatten(F.transform(every, lambda x: F.flatten(F.transform(every, lambda y: F.array(cell(mine, x, y), cell(x, mine, y), cell(x, y, mine)))))))
    names = known.select(F.lit(2).alias("closing"), F.explode(cells).alias("cell"), F.col("id").alias("low"), F.lit(True).alias("out"), F.array().cast(f"array<{number}>").alias("highs"), F.col("node").alias("name"))
    return sent.unionByName(names).repartitionById(k**3, "cell").mapInArrow(_cycles_in_cell(k, nodes), "cycle string, hops int")


#: Bytes of the marks that a worker tests pairs against (they stay in a core's cache), the arcs marked at once, and the pairs tested at once.
MARKS, MARKED, TESTED = 1 << 20, 1 << 14, 1 << 18


def _cycles_in_cell(k: int, nodes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The cycles of one cell of :func:`round_trips`: low > v > w > low and low > v > low, for low, v and w of the cell's three classes.

    Arcs v > w are marked some at a time in a table of bytes by v and w; the pairs (v, w) of all low with a way out to these v and a way in from
    w are looked up there. Different pairs may share a mark, so a pair that meets one is looked up exactly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[tuple[int, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
        at, known, cell = [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            closing, out, low = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("closing", "out", "low"))
            cell = b.column(b.schema.get_field_index("cell"))[0].as_py()
            lists, name = b.column(b.schema.get_field_index("highs")), b.column(b.schema.get_field_index("name"))
            for kind in ((0, True), (0, False), (1, True), (1, False), (2, True)):
                rows = np.flatnonzero((closing == kind[0]) & (out == kind[1]))
                if len(rows) and kind[0] == 2:
                    at.append(low[rows])
                    known.append(name.take(pa.array(rows)))
                elif len(rows):
                    taken = lists.take(pa.array(rows))
                    kinds.setdefault(kind, []).append((np.repeat(low[rows], taken.value_lengths().to_numpy()), taken.flatten().to_numpy()))
        if (0, True) not in kinds or (0, False) not in kinds:
            return
        arcs = {kind: tuple(np.concatenate(x) for x in zip(*parts)) for kind, parts in kinds.items()}
        kinds.clear()
        order = np.argsort(at := np.concatenate(at))
        at, known = at[order], pa.chunked_array(known).combine_chunks().take(pa.array(order))
        ci, rest = divmod(cell, k * k)
        cj, cl = divmod(rest, k)
        wide = nodes // k + 1

        def named(*cycle: np.ndarray) -> pa.RecordBatch:
            ids = np.stack(cycle)
            least, each = ids.argmin(axis=0), np.arange(ids.shape[1])
            text = [known.take(pa.array(np.searchsorted(at, ids[(least + i) % len(cycle), each]))) for i in range(len(cycle))]
            return pa.record_batch([pc.binary_join_element_wise(*text, text[0], ">"), pa.array(np.full(len(each), len(cycle), dtype=np.int32))], names=["cycle", "hops"])

        def by(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(start of each number's run, the first numbers, the second), ordered by the first and then the second."""
            x = np.argsort(first.astype(np.int64) * wide + second)
            first, second = first[x], second[x]
            return np.concatenate([[0], np.cumsum(np.bincount(first, minlength=wide))]), first, second

        # From here on a node is its place in its class.
        a_low, a_v = (x // k for x in arcs.pop((0, True)))
        b_low, b_w = (x // k for x in arcs.pop((0, False)))
        if cj == cl:
            both = np.intersect1d(a_low.astype(np.int64) * wide + a_v, b_low.astype(np.int64) * wide + b_w, assume_unique=True)
            for i in range(0, len(both), TESTED):
                yield named(both[i : i + TESTED] // wide * k + ci, both[i : i + TESTED] % wide * k + cj)
        none = np.empty(0, dtype=a_low.dtype)
        out_v, out_w = (x // k for x in arcs.pop((1, True), (none, none)))
        in_w, in_v = (x // k for x in arcs.pop((1, False), (none, none)))
        c_start, c_v, c_w = by(np.concatenate([out_v, in_v]), np.concatenate([out_w, in_w]))
        b_start, _, b_w = by(b_low, b_w)
        b_many = np.diff(b_start)
        useful = (b_many[a_low] > 0) & (np.diff(c_start)[a_v] > 0)
        a_start, a_v, a_low = by(a_v[useful], a_low[useful])
        marks, stride = np.zeros(MARKS, dtype=bool), np.int64(wide | 1)
        v0 = 0
        while v0 < wide:
            # The v whose arcs are marked together, one at least.
            v1 = max(v0 + 1, int(np.searchsorted(c_start, c_start[v0] + MARKED, side="right")) - 1)
            c, a = slice(c_start[v0], c_start[v1]), slice(a_start[v0], a_start[v1])
            if c.start < c.stop and a.start < a.stop:
                marked = ((c_v[c] - v0) * stride + c_w[c]) & (MARKS - 1)
                marks[marked] = True
                keys = c_v[c].astype(np.int64) * wide + c_w[c]
                low, v = a_low[a], a_v[a]
                ends = np.cumsum(b_many[low])
                i = 0
                while i < len(low):
                    done = ends[i - 1] if i else 0
                    j = max(i + 1, int(np.searchsorted(ends, done + TESTED, side="right")))
                    many = b_many[low[i:j]]
                    upto = ends[i:j] - done
                    w = b_w[np.repeat(b_start[low[i:j]] - upto + many, many) + np.arange(upto[-1])]
                    hit = np.flatnonzero(marks[(np.repeat((v[i:j] - v0) * stride, many) + w) & (MARKS - 1)])
                    arc = np.searchsorted(upto, hit, side="right") + i
                    key = v[arc].astype(np.int64) * wide + w[hit]
                    right = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key
                    if right.any():
                        yield named(low[arc[right]] * k + ci, v[arc[right]] * k + cj, w[hit[right]] * k + cl)
                    i = j
                marks[marked] = False
            v0 = v1

    return run


def conversions(transfers: DataFrame, blocks: int = 20) -> DataFrame:
    """For each incoming transfer the largest outgoing one of another token at the same address within ``blocks`` blocks.

    Of each address and block only two outgoing transfers can be an answer: the largest, and the largest of another token than that. And
    incoming transfers of the same address, token and block have the same answer. So a busy address meets at most 6 ``blocks`` rows for each
    of its tokens and blocks, however many transfers it has.
    """
    live = transfers.filter("src <> dst")
    best = F.max(F.struct(F.col("amount").alias("out_amount"), F.col("token").alias("out_token"), F.col("block").alias("out_block")))
    o = live.groupBy(F.col("src").alias("node"), F.col("block").alias("b"), "token").agg(best.alias("m"))
    first = o.groupBy("node", "b").agg(F.max("m").alias("m1"), F.collect_list("m").alias("all"))  # one entry a token
    two = first.select("node", "b", F.explode(F.array_compact(F.array("m1", F.array_max(F.filter("all", lambda x: x.out_token != F.col("m1.out_token")))))).alias("m"))
    asked = live.select(F.col("dst").alias("node"), F.col("token").alias("in_token"), F.col("block").alias("in_block")).distinct().withColumn("span", F.floor(F.col("in_block") / blocks))
    near = two.withColumn("span", F.explode(F.expr(f"sequence(floor(b / {blocks}) - 1, floor(b / {blocks}) + 1)")))
    met = asked.join(near, ["node", "span"]).filter((F.col("in_token") != F.col("m.out_token")) & (F.abs(F.col("in_block") - F.col("b")) <= blocks))
    found = materialize(met.groupBy("node", "in_token", "in_block").agg(F.max("m").alias("m")), "found")
    i = live.select(F.col("dst").alias("node"), "tx", "log_index", F.col("token").alias("in_token"), F.col("amount").alias("in_amount"), F.col("block").alias("in_block"))
    got = skew_safe_lookup(i, found, ["node", "in_token", "in_block"], ["m"]).filter(F.col("m").isNotNull())
    return got.select("node", "tx", "log_index", "in_token", "in_amount", "in_block", "m.out_amount", "m.out_token").distinct()


def shortest_hops(edges: DataFrame, source: str, target: str, most: int = 6) -> DataFrame:
    """The number of hops of the shortest directed path, null if there is none within ``most``."""
    spark = edges.sparkSession
    reach = within_hops(edges, spark.createDataFrame([(source,)], "root string"), most, directed=True).filter(F.col("node") == target)
    return reach.agg(F.min("depth").alias("hops")).select(F.lit(source).alias("source"), F.lit(target).alias("target"), "hops")


def reciprocal(edges: DataFrame) -> DataFrame:
    """Pairs with transfers both ways, grouped on the unordered pair instead of a self-join."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    g = edges.filter("src <> dst").groupBy(lo.alias("a"), hi.alias("b")).agg(F.sum(F.when(F.col("src") == lo, F.col("amount"))).cast("decimal(38,2)").alias("a_to_b"), F.sum(F.when(F.col("src") == hi, F.col("amount"))).cast("decimal(38,2)").alias("b_to_a"))
    return g.filter(F.col("a_to_b").isNotNull() & F.col("b_to_a").isNotNull())


def sweeps(transfers: DataFrame, least_share: float = 0.6) -> DataFrame:
    """Each sender's most frequent destination with its share of the sender's transfers, and whether it makes a sweep cluster."""
    g = transfers.filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    top = g.groupBy("src").agg(F.sum("n").alias("all"), F.max("n").alias("most"), F.min_by("dst", F.struct(-F.col("n"), "dst")).alias("destination"))
    share = F.round(F.col("most") / F.col("all"), 6)
    return top.select("src", "destination", "most", share.alias("share"), (share >= least_share).alias("sweep"))


def sweep_clusters(swept: DataFrame, least: int = 2) -> DataFrame:
    """Senders (of :func:`sweeps`) that sweep to the same destination, as a cluster: members, transfers and the least member; at least ``least`` of them."""
    g = swept.filter("sweep").groupBy("destination").agg(F.count(F.lit(1)).alias("members"), F.sum("most").alias("transfers"), F.min("src").alias("first_member"))
    return g.filter(F.col("members") >= least)


def top_funders(transfers: DataFrame) -> DataFrame:
    """Each receiver's most frequent source."""
    g = transfers.filter("src <> dst").groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("dst").agg(F.max("n").alias("n"), F.min_by("src", F.struct(-F.col("n"), "src")).alias("funder"))


def case_timeline(transfers: DataFrame, targets: Column, limit: int = 100) -> DataFrame:
    """The first ``limit`` transfers that touch a target, in time order (a top-k report)."""
    return transfers.filter(targets).orderBy("t", "tx", "log_index", "src", "dst", "token", "amount").limit(limit)


def case_graph(transfers: DataFrame, targets: Column, limit: int = 200) -> DataFrame:
    """The edges of the first ``limit`` transfers that touch a target, in time order."""
    return edges_of(case_timeline(transfers, targets, limit))


def top_graph(edges: DataFrame, limit: int = 600) -> tuple[DataFrame, DataFrame]:
    """(the ``limit`` largest edges by amount, then number, then names; their nodes with what comes in and goes out along these edges alone)."""
    kept = materialize(edges.orderBy(F.desc("amount"), F.desc("n"), "src", "dst").limit(limit), "kept")
    side = F.inline(F.array(F.struct(F.col("src").alias("node"), F.lit(True).alias("out")), F.struct(F.col("dst").alias("node"), F.lit(False).alias("out"))))
    z = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)")
    nodes = kept.select(side, "amount", "n").groupBy("node").agg(z(F.when(~F.col("out"), F.col("amount"))).alias("total_in"), z(F.when(F.col("out"), F.col("amount"))).alias("total_out"), F.sum("n").alias("transfers"))
    return kept, nodes


def ledger_graph(ledger: DataFrame, src: Column, dst: Column, amount: Column) -> DataFrame:
    """Edges of a ledger after dropping repeated (src, dst, amount, time, serial): transfers, sum, largest and average, first and last time."""
    rows = ledger.select(src.alias("src"), dst.alias("dst"), amount.cast("decimal(18,2)").alias("amount"), "txn_time", "txn_serial").filter((F.col("src") != "") & (F.col("dst") != "")).distinct()
    return rows.groupBy("src", "dst").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(38,2)").alias("amount"), F.max("amount").alias("largest"), F.round(F.avg(F.col("amount").cast("double")), 4).alias("average"), F.min("txn_time").alias("first_t"), F.max("txn_time").alias("last_t")
    )
