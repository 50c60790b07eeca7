"""Relational building blocks: latest versions, deduplication with audit, as-of joins, islands, pagination and reductions."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import materialize, same_keys, skew_safe_lookup


def final_view(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """The latest version of each key (nulls are a key). One aggregation with map-side combining, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    order = [*version, *[c for c in rest if c not in version]]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order)).alias("__v"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__v.{c}").alias(c) for c in df.columns])


def ranged(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """``df`` sorted over range partitions of (by, order) and written: __p is the partition, __i the row's place in it.

    A group of any size is cut between partitions, so nothing that goes on from here has to hold or sort a whole group in one task.
    """
    keys = [*[F.col(c) for c in by], *[F.col(c) if isinstance(c, str) else c for c in order]]
    at = F.monotonically_increasing_id()
    return materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id()).withColumn("__i", at), name)


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column], highs: Mapping[str, tuple[str, str]] | None = None, before: Mapping[str, Column] | None = None, earlier_highs: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with running values along ``order`` in each group of ``by`` (nulls are a group); ``order`` should be unique within a group.

    ``sums``: sums up to and including the row. ``highs``: for name -> (a, b) the greatest a - b of two of the sums so far, at least 0.
    ``earlier_highs``: for name -> high the high before the row, 0 at a group's first row.
    ``before``: the greatest value of a column among the earlier rows, null at a group's first row. Prefix sums over range partitions: values
    run within a partition, and a partition's first group goes on from what the partitions before it hold of that group, so a group that
    holds most rows is spread over all tasks.
    """
    highs, before, late = dict(highs or {}), dict(before or {}), dict(earlier_highs or {})
    cols = df.columns
    base = ranged(df.withColumns({f"__s_{n}": c for n, c in sums.items()} | {f"__b_{n}": c for n, c in before.items()}), by, order, "ranged")
    w = Window.partitionBy("__p", *by).orderBy("__i")
    upto, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    kind = {n: base.schema[f"__s_{n}"].dataType for n in sums}
    wide = lambda n: "decimal(38,18)" if kind[n].typeName() == "decimal" else "bigint" if kind[n].typeName() in ("integer", "long", "short", "byte") else "double"
    local = base.withColumns({f"__r_{n}": F.sum(f"__s_{n}").over(upto).cast(wide(n)) for n in sums} | {f"__e_{n}": F.max(f"__b_{n}").over(earlier) for n in before})
    local = local.withColumns({f"__h_{n}": F.max(F.col(f"__r_{a}") - F.col(f"__r_{b}")).over(upto) for n, (a, b) in highs.items()})
    local = local.withColumns({f"__l_{n}": F.max(F.col(f"__r_{highs[h][0]}") - F.col(f"__r_{highs[h][1]}")).over(earlier) for n, h in late.items()})
    # One row per partition and group in it; only the groups that go on from the partition before matter, at most one a partition.
    parts = local.groupBy("__p", *by).agg(
        *[F.coalesce(F.sum(f"__s_{n}"), F.lit(0)).cast(wide(n)).alias(f"__s_{n}") for n in sums], *[F.max(f"__h_{n}").alias(f"__h_{n}") for n in highs], *[F.max(f"__b_{n}").alias(f"__b_{n}") for n in before]
    )
    g = Window.partitionBy(*by).orderBy("__p")
    past = g.rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.withColumns({f"__o_{n}": F.sum(f"__s_{n}").over(past).cast(wide(n)) for n in sums} | {"__n": F.row_number().over(g)})
    carry = carry.withColumns({f"__o_{n}": F.max(F.coalesce(F.col(f"__o_{a}") - F.col(f"__o_{b}"), F.lit(0)) + F.col(f"__h_{n}")).over(past) for n, (a, b) in highs.items()} | {f"__o_{n}": F.max(f"__b_{n}").over(past) for n in before})
    carry = carry.filter("__n > 1").select("__p", *by, *[f"__o_{n}" for n in (*sums, *highs, *before)])
    out = local.alias("l").join(F.broadcast(carry).alias("c"), same_keys("l", "c", "__p", *by), "left")  # at most one row a partition
    zero = F.lit(0)
    return out.select(
        *[F.col(f"l.{c}") for c in cols],
        *[(F.coalesce(f"__o_{n}", zero) + F.col(f"__r_{n}")).cast(wide(n)).alias(n) for n in sums],
        *[F.greatest(zero, F.coalesce(F.col(f"__o_{a}") - F.col(f"__o_{b}"), zero) + F.col(f"__h_{n}"), F.coalesce(f"__o_{n}", zero)).cast(wide(a)).alias(n) for n, (a, b) in highs.items()],
        *[F.greatest(zero, F.coalesce(F.col(f"__o_{highs[h][0]}") - F.col(f"__o_{highs[h][1]}"), zero) + F.col(f"__l_{n}"), F.coalesce(f"__o_{h}", zero)).cast(wide(highs[h][0])).alias(n) for n, h in late.items()],
        *[F.greatest(f"__o_{n}", f"__e_{n}").alias(n) for n in before],
    )


def dedup_with_audit(df: DataFrame, identity: Column, order: Sequence[str], row_id: str) -> DataFrame:
    """U4: every row with its identity, copy number (1 is kept) and the kept row's id. Rows with a null identity are all kept.

    Copies are numbered by a running count, and the kept id is a map-side combinable minimum that a lookup brings to the rows.
    """
    keyed = df.withColumn("identity", F.coalesce(identity, F.concat(F.lit("row:"), F.col(row_id).cast("string"))))
    kept = keyed.groupBy("identity").agg(F.min(F.struct(*order, F.col(row_id).alias("__id"))).alias("m")).select("identity", F.col("m.__id").alias("kept_id"))
    kept = materialize(kept, "kept")
    numbered = running(keyed, ["identity"], order, {"copy_no": F.lit(1)})
    return skew_safe_lookup(numbered.withColumn("copy_no", F.col("copy_no").cast("int")), kept, ["identity"], ["kept_id"])


def asof_left(facts: DataFrame, dims: DataFrame, by: Sequence[str], fact_t: str, dim_t: str, values: Sequence[str], max_age_s: int | None = None, bucket_s: int = 86400) -> DataFrame:
    """Each fact with ``values`` of the last dim row of the same key at or before its time, null if none (or older than ``max_age_s``).

    Facts and dims travel in one stream sorted by key, time bucket and time; no join, so a key's rows never multiply. The last dim of all
    earlier buckets enters each bucket as one more row, so a hot key is as many tasks as it has buckets. Of dims at the same time the greatest counts.
    """
    fact_cols = facts.columns
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_s * 1_000_000))
    d = dims.filter(F.col(dim_t).isNotNull()).groupBy(*by, dim_t).agg(F.max(F.struct(F.col(dim_t).alias("t"), *values)).alias("__d")).withColumn("__b", bucket(dim_t))
    f = facts.select(F.struct(*[F.col(c) for c in fact_cols]).alias("__f"), *by, F.col(fact_t).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(d.schema["__d"].dataType).alias("__d"), bucket(fact_t).alias("__b"))
    none = F.lit(None).cast(f.schema["__f"].dataType).alias("__f")
    g = d.select(none, *by, F.col(dim_t).alias("__t"), F.lit(0).alias("__side"), "__d", "__b")
    # One row per key and bucket.
    lasts = d.groupBy(*by, "__b").agg(F.max("__d").alias("__d"))
    wanted = f.filter("__b IS NOT NULL").select(*by, "__b").distinct()
    seen = lasts.select(*by, "__b", "__d", F.lit(False).alias("__w")).unionByName(wanted.select(*by, "__b", F.lit(None).cast(d.schema["__d"].dataType).alias("__d"), F.lit(True).alias("__w")))
    earlier = Window.partitionBy(*by).orderBy("__b").rangeBetween(Window.unboundedPreceding, -1)
    carried = seen.withColumn("__d", F.max("__d").over(earlier)).filter("__w AND __d IS NOT NULL").select(none, *by, F.col("__d.t").alias("__t"), F.lit(-1).alias("__side"), "__d", "__b")
    w = Window.partitionBy(*by, "__b").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = f.unionByName(g).unionByName(carried).withColumn("__last", F.last("__d", ignorenulls=True).over(w)).filter("__side = 1")
    fresh = F.col("__t").isNotNull()
    if max_age_s is not None:
        fresh = fresh & (F.unix_micros("__t") - F.unix_micros("__last.t") <= max_age_s * 1_000_000)
    return out.select("__f.*", *[F.when(fresh, F.col(f"__last.{v}")).alias(v) for v in values], F.when(fresh, F.col("__last.t")).alias("matched_at"))


def either_side(rows: DataFrame, targets: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """One row per target that equals ``left`` or ``right``; a row with both equal matches once. An OR join as a union of two hash joins."""
    a = rows.join(targets, F.col(left) == F.col(key)).withColumn("role", F.lit("OUT"))
    b = rows.filter(F.col(left) != F.col(right)).join(targets, F.col(right) == F.col(key)).withColumn("role", F.lit("IN"))
    return a.unionByName(b)


def touching(rows: DataFrame, targets: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """Distinct rows that touch a target on either side. One scan marks the rows by two lookups of the targets, so the input is read once
    and only rows that touch one are made distinct."""
    marks = targets.select(F.col(key).alias("__k")).distinct().withColumn("__hit", F.lit(True))
    one = skew_safe_lookup(rows.withColumn("__k", F.col(left)), marks, ["__k"], ["__hit"]).withColumnRenamed("__hit", "__left")
    two = skew_safe_lookup(one.withColumn("__k", F.col(right)), marks, ["__k"], ["__hit"])
    return two.filter(F.col("__left") | F.col("__hit")).select(*rows.columns).distinct()


def fan_out(df: DataFrame, src: str, dst: str, rest: Sequence[str | Column]) -> DataFrame:
    """(address, counterparty, direction) rows of transfers in one pass: OUT and IN, or one SELF row."""
    a, b = F.col(src), F.col(dst)
    row = lambda x, y, d: F.struct(x.alias("address"), y.alias("counterparty"), F.lit(d).alias("direction"))
    return df.select(F.inline(F.when(a == b, F.array(row(a, b, "SELF"))).otherwise(F.array(row(a, b, "OUT"), row(b, a, "IN")))), *rest)


def cursor(scope: Mapping[str, object], last: Sequence[object]) -> str:
    """An opaque cursor: the last row's order values, bound to the scope they were asked in."""
    text = json.dumps({"scope": {k: str(v) for k, v in sorted(scope.items())}, "last": [str(v) for v in last]}, ensure_ascii=False, sort_keys=True)
    return base64.urlsafe_b64encode(text.encode()).decode()


def read_cursor(text: str, scope: Mapping[str, object], width: int) -> list[str]:
    """The order values of a cursor; ValueError if it is broken or belongs to another scope."""
    try:
        got = json.loads(base64.urlsafe_b64decode(text.encode()))
        last = list(got["last"])
    except (ValueError, TypeError, KeyError) as e:
        raise ValueError("invalid cursor") from e
    if got.get("scope") != {k: str(v) for k, v in sorted(scope.items())} or len(last) != width:
        raise ValueError("cursor of another query")
    return last


def keyset_page(df: DataFrame, order: Sequence[str], after: Sequence[object] | None, size: int) -> DataFrame:
    """The page of ``size`` rows after the cursor ``after`` in descending order of ``order`` (which must be unique)."""
    if after is not None:
        df = df.filter(F.struct(*order) < F.struct(*[F.lit(v).cast(df.schema[c].dataType) for c, v in zip(order, after)]))
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(size)


def offset_page(df: DataFrame, order: Sequence[Column | str], offset: int, size: int) -> DataFrame:
    """A page by offset, each row with the total."""
    return df.orderBy(*order).offset(offset).limit(size).withColumn("total_rows", df.agg(F.count(F.lit(1))).scalar())


def capped(df: DataFrame, order: Sequence[Column | str], limit: int) -> DataFrame:
    """The first ``limit`` rows and whether there were more; one top-k of limit + 1, never a full sort."""
    head = df.orderBy(*order).limit(limit + 1)
    more = F.count(F.lit(1)).over(Window.partitionBy()) > limit
    return head.withColumn("truncated", more).orderBy(*order).limit(limit)


def cover_share(df: DataFrame, amount: str, order: Sequence[Column | str], share: float) -> DataFrame:
    """T5: the largest rows until they cover ``share`` of the total: a row stays if the rows before it cover less.

    The input is written once; range partitions and prefix sums do the rest, so no task sorts everything.
    """
    sorted_df = ranged(materialize(df, "input"), [], order, "cover")
    parts = sorted_df.groupBy("__p").agg(F.sum(amount).alias("__n"))
    before = parts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__total"))  # one row a partition
    run = F.coalesce(F.sum(amount).over(Window.partitionBy("__p").orderBy("__i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = sorted_df.join(F.broadcast(before), "__p").withColumn("__prior", F.col("__start") + run)
    return out.filter(F.col("__prior") < F.col("__total") * F.lit(share).cast("decimal(6,4)")).drop("__p", "__i", "__start", "__total", "__prior")


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps only k rows of a group on the map side."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def facet(df: DataFrame, column: str, search: str | None = None, k: int = 300) -> DataFrame:
    """The ``k`` most frequent values of a column (ties by value) with their counts, of those that contain ``search`` (case ignored); null is no value."""
    rows = df.filter(F.col(column).isNotNull())
    if search:
        rows = rows.filter(F.contains(F.lower(column), F.lit(search.lower())))
    return rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def search(sources: Mapping[str, tuple[DataFrame, str]], text: str, k: int = 50) -> DataFrame:
    """(kind, label, rank, n) of the ``k`` best labels that contain ``text`` (case ignored) in any of the sources (kind -> rows, column): equal
    ones first, then those that begin with it, then the rest; ties by kind and label. Equal labels of a source are one, with how many there were."""
    want, parts = text.lower(), []
    for kind, (df, column) in sources.items():
        c = F.lower(column)
        rank = F.when(c == want, 3).when(F.startswith(c, F.lit(want)), 2).otherwise(1)
        parts.append(df.filter(F.contains(c, F.lit(want))).groupBy(F.col(column).alias("label")).agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "label", "rank", "n"))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.orderBy(F.desc("rank"), "kind", "label").limit(k)


def gaps(buckets: DataFrame, by: Sequence[str], at: str, step: int) -> DataFrame:
    """Ranges of missing buckets inside each key's span: (by, gap_from, gap_to, missing). ``at`` counts units of ``step``.

    A gap is what lies between a bucket and the next one present, so nothing has to be generated and anti-joined.
    """
    nxt = F.lead(at).over(Window.partitionBy(*by).orderBy(at))
    d = buckets.select(*by, at).distinct().withColumn("__next", nxt)
    return d.filter(F.col("__next") - F.col(at) > step).select(*by, (F.col(at) + step).alias("gap_from"), (F.col("__next") - step).alias("gap_to"), F.expr(f"(__next - `{at}`) div {step} - 1").alias("missing"))


def merge_ranges(df: DataFrame, by: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Overlapping or adjacent ranges as one, with how many there were. Running maxima and counts over range partitions, see :func:`running`."""
    counted = df.groupBy(*by, lo, hi).agg(F.count(F.lit(1)).alias("__k"))
    top = running(counted, by, [lo, hi], {}, before={"__top": F.col(hi)})
    start = F.coalesce(F.col(lo) > F.col("__top") + 1, F.lit(True))
    isle = running(top.withColumn("__s", start.cast("int")), by, [lo, hi], {"__g": F.col("__s")})
    return isle.groupBy(*by, "__g").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum("__k").alias("ranges")).drop("__g")


def dense_index(df: DataFrame, group: Sequence[str], identity: Sequence[str], offset: int) -> DataFrame:
    """A dense index over the sorted distinct identities of each group, from ``offset``."""
    return df.withColumn("synthetic_index", F.dense_rank().over(Window.partitionBy(*group).orderBy(*identity)) - 1 + offset)


def rank_pick(df: DataFrame, by: Sequence[str], value: str, position: Column, name: str) -> DataFrame:
    """The value at ``position`` (1-based, from the count ``n``) of each group's ascending order: the percentiles that are no percentile_disc.

    Values are counted on the map side, sorted over range partitions, and the place is found by prefix sums: first the partition that holds
    it, then the value in that partition. No task sorts a group.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__k"))
    base = ranged(counted, by, [value], "values")
    parts = base.groupBy("__p", *by).agg(F.sum("__k").alias("__m"))
    g = Window.partitionBy(*by)
    sums = parts.withColumn("__before", F.coalesce(F.sum("__m").over(g.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("__m").over(g))
    at = sums.withColumn("__at", position).filter((F.col("__before") < F.col("__at")) & (F.col("__at") <= F.col("__before") + F.col("__m"))).select("__p", *by, (F.col("__at") - F.col("__before")).alias("__need"))
    run = F.sum("__k").over(Window.partitionBy("__p", *by).orderBy("__i"))
    held = base.alias("b").join(at.alias("a"), same_keys("b", "a", "__p", *by)).select("b.*", "a.__need").withColumn("__run", run)
    return held.filter((F.col("__run") >= F.col("__need")) & (F.col("__run") - F.col("__k") < F.col("__need"))).select(*by, F.col(value).alias(name))
