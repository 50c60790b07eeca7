"""Matching records by nearest time (problem 5): a two-pointer merge over sorted partitions.

Both tables are put into one stream of (entity, bucket, time) rows, repartitioned by entity and time bucket and sorted; the merge walks
the stream once and holds only the neighbouring right rows and the left rows still within the tolerance. A time bucket splits a hot
entity; right rows near a bucket's edge go to both buckets, so each left row meets all it can match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE_S = 120
BUCKET_S = 3600


def symbol_key(c: Column) -> Column:
    """A symbol without case and outer spaces; blank becomes null."""
    s = F.upper(F.regexp_replace(c, r"^[\s　]+|[\s　]+$", ""))
    return F.when(s != "", s)


def latest_anchors(anchors: DataFrame, quote: str = "USDX") -> DataFrame:
    """(chain_id, symbol, t, anchor_id, close) of the latest version of each minute quoted in ``quote``, if that version has a close.

    Versions are ordered by ingested_at, ties by anchor_id.
    """
    rows = anchors.select("chain_id", symbol_key(F.col("symbol")).alias("symbol"), symbol_key(F.col("quote_symbol")).alias("q"), "minute", "ingested_at", "anchor_id", "close")
    live = rows.filter((F.col("q") == quote) & F.col("symbol").isNotNull() & F.col("minute").isNotNull())
    last = live.groupBy("chain_id", "symbol", "minute").agg(F.max(F.struct("ingested_at", "anchor_id", "close")).alias("v"))
    return last.filter(F.col("v.close").isNotNull()).select("chain_id", "symbol", F.unix_micros("minute").alias("t"), "v.anchor_id", "v.close")


def _merge(tolerance_us: int):
    def merged(f: pd.DataFrame, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
        """(matches, rows to carry) of sorted rows: k1, k2, bucket, t, side (0 right, 1 left), id."""
        n = len(f)
        t, right = f["t"].to_numpy(), f["side"].to_numpy() == 0
        new = np.ones(n, dtype=bool)
        for c in ("k1", "k2", "bucket"):
            v = f[c].to_numpy()
            same = v[1:] == v[:-1] if c == "k1" else (v[1:] == v[:-1]) & same
        new[1:] = ~same
        group = np.cumsum(new)
        at = np.arange(n)
        before = np.maximum.accumulate(np.where(right, at, -1))
        after = np.minimum.accumulate(np.where(right, at, n)[::-1])[::-1]
        ids = f["id"].to_numpy()
        prev_ok = (before >= 0) & (group[np.maximum(before, 0)] == group)
        next_ok = (after < n) & (group[np.minimum(after, n - 1)] == group)
        far = np.int64(2**62)
        back = np.where(prev_ok, t - t[np.maximum(before, 0)], far)
        ahead = np.where(next_ok, t[np.minimum(after, n - 1)] - t, far)
        keep = np.zeros(n, dtype=bool)
        if not last:
            tail = group == group[-1]
            # A left row can still meet a later right row if none is behind it yet and the stream hasn't passed the tolerance.
            keep = tail & ~right & (after == n) & (t >= t[-1] - tolerance_us)
            if (tail & right).any():
                keep[before[-1]] = True
        left = ~right & ~(keep & ~right)
        best = np.minimum(back, ahead)
        hit = left & (best <= tolerance_us)
        pick = np.where(back <= ahead, before, after)
        out = pd.DataFrame({"left_id": ids[hit], "right_id": ids[pick[hit]], "gap_us": best[hit]})
        return out, f[keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = None
        for b in batches:
            if not len(b):
                continue
            f = b if carry is None or not len(carry) else pd.concat([carry, b], ignore_index=True)
            out, carry = merged(f, last=False)
            yield out
        if carry is not None and len(carry):
            yield merged(carry.reset_index(drop=True), last=True)[0]

    return run


def nearest(left: DataFrame, right: DataFrame, tolerance_s: int = TOLERANCE_S, bucket_s: int = BUCKET_S) -> DataFrame:
    """(left_id, right_id, gap_us): for every left row its nearest right row of the same entity within the tolerance (inclusive).

    Both sides have k1 (int), k2 (string), t (microseconds) and id (bigint). Left rows with a null key or time match nothing; of two equally
    near right rows the earlier counts, and of right rows at the same time the one with the least id. Repeated left rows each get their match.
    """
    tol, width = tolerance_s * 1_000_000, max(bucket_s, 2 * tolerance_s) * 1_000_000
    bucket = lambda x: F.floor(x / F.lit(width)).cast("bigint")
    t = F.col("t")
    r = right.filter(F.col("k1").isNotNull() & F.col("k2").isNotNull() & t.isNotNull()).groupBy("k1", "k2", "t").agg(F.min("id").alias("id"))
    r = r.select("k1", "k2", F.explode(F.array_distinct(F.array(bucket(t - tol), bucket(t), bucket(t + tol)))).alias("bucket"), "t", F.lit(0).alias("side"), "id")
    live = left.filter(F.col("k1").isNotNull() & F.col("k2").isNotNull() & t.isNotNull()).select("k1", "k2", bucket(t).alias("bucket"), "t", F.lit(1).alias("side"), "id")
    stream = r.unionByName(live).repartition("k1", "k2", "bucket").sortWithinPartitions("k1", "k2", "bucket", "t", "side")
    return stream.mapInPandas(_merge(tol), "left_id bigint, right_id bigint, gap_us bigint")


def price_matches(activity: DataFrame, anchors: DataFrame, tolerance_s: int = TOLERANCE_S, quote: str = "USDX") -> DataFrame:
    """The nearest anchor of every activity row that has one: activity_id, anchor_id, gap_us."""
    left = activity.select(F.col("chain_id").alias("k1"), symbol_key(F.col("token_symbol")).alias("k2"), F.unix_micros("block_time").alias("t"), F.col("activity_id").alias("id"))
    right = latest_anchors(anchors, quote).select(F.col("chain_id").alias("k1"), F.col("symbol").alias("k2"), "t", F.col("anchor_id").alias("id"))
    return nearest(left, right, tolerance_s).select(F.col("left_id").alias("activity_id"), F.col("right_id").alias("anchor_id"), "gap_us")


def priced_activity(activity: DataFrame, anchors: DataFrame) -> DataFrame:
    """Every activity row with anchor_id, close and gap_us of its nearest anchor, null where none is near enough."""
    m = price_matches(activity, anchors).alias("m")
    closes = anchors.select("anchor_id", "close").alias("c")
    priced = m.join(closes, F.col("m.anchor_id") == F.col("c.anchor_id")).select("m.activity_id", "m.anchor_id", "c.close", "m.gap_us").alias("p")
    return activity.select("activity_id", "chain_id", "token_symbol", "block_time").alias("a").join(priced, F.col("a.activity_id") == F.col("p.activity_id"), "left").select("a.*", "p.anchor_id", "p.close", "p.gap_us")
