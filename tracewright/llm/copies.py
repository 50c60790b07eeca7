"""Duplicates hidden by formatting (problem 7): partition-merged Bloom filters of once- and repeatedly-seen canonical hashes.

Each input partition sets the bits of its records' hashes in one filter, and in a second one those that were set before. Filters are merged
in a tree: a bit that two partitions set, or that one has set repeatedly, is repeated. A record all of whose bits are repeated may have
copies; only those are shuffled and grouped exactly. All others are proven to be singletons and never move.

The filters are sized to the data and cut by hash range: hashes are written once, sorted within each part, and a round reads one range of
them (parquet's page index skips the rest), fills filters of at most ROUND_BITS bits at 16 bits a record, and tests the same range. So
memory, broadcast and the driver's share are bounded, the filters are never fuller than intended, and the rounds together read the hashes
twice, whatever the number of records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.runtime import materialize, skew_safe_lookup, table_path

#: The 34 business columns of the ledger.
BUSINESS = [
    "card_no", "account_no", "account_name", "id_no", "bank", "account_nature", "txn_time", "amount", "balance", "direction", "cp_account", "cp_nature", "cash_flag", "cp_name", "cp_id_no", "cp_bank", "summary",
    "currency", "branch", "location", "success_flag", "voucher_no", "ip", "mac", "cp_balance", "txn_serial", "merchant_serial", "log_no", "cert_type", "cert_no", "teller_no", "remark", "feedback_reason", "data_source",
]
_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　￥￠￡￢￣￤￦"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ¥¢£¬¯¦₩"
_CUT = "\x01"
#: Filter bits: 16 for each record, a power of two. A round's filters have at most 32 MB each; more records take more rounds, never fuller filters.
BITS_PER_RECORD, MIN_BITS, ROUND_BITS, HASHES = 16, 1 << 16, 1 << 28, 4
SEGMENT_BITS = 1 << 19
FAN_IN = 16


def plain(c: Column) -> Column:
    """Text without white space, letter case, punctuation and full-width forms; null as empty."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), _FULL, _HALF)), r"[\s\p{Z}\p{P}\p{Cf}$+<=>^`|~]", "")


def amount_text(c: Column) -> Column:
    """An amount without currency marks, with its sign in front; see :func:`signed_number`."""
    s = F.regexp_replace(F.lower(F.translate(F.coalesce(c, F.lit("")), _FULL, _HALF)), r"[\s\p{Z},_¥元圆$€£]|人民币|rmb|cny|usd", "")
    s = F.regexp_replace(F.translate(s, "−–", "--"), r"^\((.*)\)$", "-$1")
    return F.regexp_replace(s, r"^([0-9.]+)-$", "-$1")


def signed_number(text: Column, c: Column) -> Column:
    """The number that ``text``, the amount_text of ``c``, denotes; text that is no number as plain text of ``c``."""
    number = F.when(text.rlike(r"^[+-]?(?:[0-9]{1,20}(?:\.[0-9]{0,18})?|\.[0-9]{1,18})$"), text.try_cast("decimal(38,18)"))
    return F.coalesce(F.concat(F.lit("#"), number.cast("string")), plain(c))


def entry_set(c: Column) -> Column:
    """A remark as the sorted set of its entries, whatever their separators."""
    s = F.translate(F.coalesce(c, F.lit("")), _FULL, _HALF)
    parts = F.split(s, r"[;,|、/\n\r\t]+")
    entries = F.transform(parts, lambda x: F.regexp_replace(F.lower(x), r"[\s\p{Z}\p{P}\p{Cf}$+<>^`|~]", ""))
    return F.when(c.isNotNull(), F.array_join(F.array_sort(F.array_distinct(F.filter(entries, lambda x: x != ""))), ";")).otherwise("")


def _step(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """``keep`` and ``columns``, each computed once: a generator is a step that the optimizer doesn't merge into the uses, and whose
    generated code stays small enough to be compiled."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def canonical(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, t): one text that two records share exactly if all ``columns`` agree but for formatting. A direction that is a bare sign stays a sign."""
    have = {c: F.col(c) if c in columns else F.lit("") for c in ("amount", "remark", "direction")}
    text = [c for c in columns if c not in have]
    df = _step(rows, key, __text=F.concat_ws(_CUT, *[F.coalesce(F.col(c), F.lit("")) for c in text]), **{f"__{c}": x for c, x in have.items()})
    sign = F.trim(F.translate(F.col("__direction"), _FULL, _HALF))
    df = _step(df, key, "__amount", __text=plain(F.col("__text")), __remark=entry_set(F.col("__remark")), __direction=F.when(sign.isin("+", "-"), sign).otherwise(plain(F.col("__direction"))), __number=amount_text(F.col("__amount")))
    return _step(df, key, t=F.concat_ws(_CUT + _CUT, "__text", signed_number(F.col("__number"), F.col("__amount")), "__remark", "__direction"))


def record_hashes(rows: DataFrame, key: str = "row_id", serial: str = "txn_serial", columns: list[str] = BUSINESS) -> DataFrame:
    """(row_id, h, x): two independent hashes of each record's canonical text, null for a record without a serial, which has no copies."""
    numbered = F.coalesce(F.trim(F.translate(F.col(serial), "　\t\n\r", "    ")) != "", F.lit(False))
    hashed = canonical(rows.filter(numbered), key, columns).select(key, F.xxhash64("t").alias("h"), F.unhex(F.md5("t")).alias("x"))
    none = rows.filter(~numbered).select(key, F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("binary").alias("x"))
    return hashed.unionByName(none)


def rounds_for(records: int) -> tuple[int, int]:
    """(rounds, filter bits of a round): both powers of two, at least BITS_PER_RECORD bits for each record of a round."""
    rounds, bits = 1, MIN_BITS
    while rounds * bits < records * BITS_PER_RECORD:
        if bits < ROUND_BITS:
            bits *= 2
        else:
            rounds *= 2
    return rounds, bits


def hash_range(hashes: DataFrame, r: int, rounds: int) -> DataFrame:
    """The hashes of one of ``rounds`` equal ranges of 64-bit numbers; null belongs to none."""
    width = (1 << 64) // rounds
    low = -(1 << 63) + r * width
    return hashes.filter((F.col("h") >= F.lit(low)) & (F.col("h") <= F.lit(low + width - 1)))


def positions(h: np.ndarray, bits: int) -> np.ndarray:
    """HASHES bit positions of each 64-bit hash (double hashing)."""
    u = h.astype(np.uint64)
    a, b = u >> np.uint64(32), (u & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] * np.uint64(0x9E3779B1) + b[:, None] * (np.arange(HASHES, dtype=np.uint64) * np.uint64(0x85EBCA77) + np.uint64(1))) >> np.uint64(7)) & np.uint64(bits - 1)


def merge_pair(once: np.ndarray, more: np.ndarray, once2: np.ndarray, more2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return once | once2, more | more2 | (once & once2)


_SEG = "seg int, part int, once binary, more binary"


def _set(bitmap: np.ndarray, p: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))


def _is_set(bitmap: np.ndarray, p: np.ndarray) -> np.ndarray:
    return (bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)


def repeat_filter(live: DataFrame, bits: int) -> np.ndarray:
    """The merged filter of repeatedly seen hashes (column h, no nulls): ``bits`` bits, which are all that reaches the driver."""
    seg_bits = min(SEGMENT_BITS, bits)
    step = seg_bits // 8

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The bitmaps' memory is touched only where bits are set.
        once, more, part, touched = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8), 0, np.zeros(bits // seg_bits, bool)
        for b in batches:
            if not len(b):
                continue
            part = int(b["part"].iloc[0])
            values, counts = np.unique(b["h"].to_numpy(), return_counts=True)
            p = positions(values, bits).ravel().astype(np.int64)
            _set(more, p[_is_set(once, p)])
            if (counts > 1).any():
                _set(more, positions(values[counts > 1], bits).ravel().astype(np.int64))
            _set(once, p)
            touched[p // seg_bits] = True
        cut = lambda x, k: zlib.compress(x[k * step : (k + 1) * step].tobytes(), 1)
        yield pd.DataFrame([(int(k), part, cut(once, k), cut(more, k)) for k in np.flatnonzero(touched)], columns=["seg", "part", "once", "more"])

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        once = more = None
        for o, m in zip(f["once"], f["more"]):
            o, m = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, m))
            once, more = (o, m) if once is None else merge_pair(once, more, o, m)
        return pd.DataFrame([(int(f["seg"].iloc[0]), int(f["part"].iloc[0]) // FAN_IN, zlib.compress(once.tobytes(), 1), zlib.compress(more.tobytes(), 1))], columns=["seg", "part", "once", "more"])

    parts = live.rdd.getNumPartitions()
    level = live.select(F.spark_partition_id().alias("part"), "h").mapInPandas(build, _SEG)
    while parts > 1:
        level = level.groupBy("seg", F.expr(f"part div {FAN_IN}").alias("to")).applyInPandas(fold, _SEG)
        parts = -(-parts // FAN_IN)
    out = np.zeros(bits // 8, np.uint8)
    for r in level.select("seg", "more").collect():  # at most ROUND_BITS / 8 bytes in all
        out[r.seg * step : (r.seg + 1) * step] |= np.frombuffer(zlib.decompress(r.more), np.uint8)
    return out


def tested(hashes: DataFrame, key: str = "row_id", rest: bool = False) -> DataFrame:
    """(key, h, x) of the records that pass the filter of repeatedly seen hashes: all that have copies and next to none that don't.

    With ``rest`` the proven singletons too, with null h and x. Records without a hash are singletons. ``hashes`` must be a written table.
    """
    spark = hashes.sparkSession
    rounds, bits = rounds_for(hashes.filter(F.col("h").isNotNull()).count())
    path, schema = table_path(spark, "likely"), hashes.select(key, "h", "x").schema
    for r in range(rounds):
        part = hash_range(hashes, r, rounds).select(key, "h", "x")
        shared = spark.sparkContext.broadcast(repeat_filter(part.select("h"), bits).tobytes())

        def passing(batches: Iterator[pd.DataFrame], shared: object = shared) -> Iterator[pd.DataFrame]:
            more = np.frombuffer(shared.value, np.uint8)
            for b in batches:
                p = positions(b["h"].to_numpy(), bits).astype(np.int64)
                hit = _is_set(more, p).all(axis=1)
                yield b.assign(h=b["h"].astype("Int64").where(hit), x=b["x"].where(hit, None)) if rest else b[hit]

        part.mapInPandas(passing, schema).write.mode("append").option("compression", "zstd").parquet(path)
        shared.destroy()
    out = spark.read.schema(schema).parquet(path)
    return out.unionByName(hashes.filter(F.col("h").isNull()).select(key, "h", "x")) if rest else out


def copy_groups(rows: DataFrame, key: str = "row_id", serial: str = "txn_serial", columns: list[str] = BUSINESS, rest: bool = False) -> DataFrame:
    """(key, keep, copies): the members of groups; with ``rest`` every record, singletons with null keep and copies.

    The exact grouping counts a group before the shuffle (map-side), so a group of a third of all records is no burden to one task; its
    members then learn their keeper through a lookup that spreads hot groups. ``keep`` is the smallest key of the group.
    """
    hashes = materialize(record_hashes(rows, key, serial, columns).sortWithinPartitions("h"), "hashes")
    all_rows = tested(hashes, key, rest)
    likely = all_rows.filter(F.col("h").isNotNull())
    groups = likely.groupBy("h", "x").agg(F.min(key).alias("keep"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    members = skew_safe_lookup(likely, materialize(groups, "groups"), ["h", "x"], ["keep", "copies"]).select(key, "keep", "copies")
    if not rest:
        return members.filter(F.col("keep").isNotNull())
    single = all_rows.filter(F.col("h").isNull()).select(key, F.lit(None).cast(members.schema["keep"].dataType).alias("keep"), F.lit(None).cast("bigint").alias("copies"))
    return members.unionByName(single)


def copies(rows: DataFrame, key: str = "row_id", serial: str = "txn_serial", columns: list[str] = BUSINESS) -> DataFrame:
    """(keep_row_id, copy_row_id): one row for every member of a group but the kept one."""
    return copy_groups(rows, key, serial, columns).filter(F.col(key) != F.col("keep")).select(F.col("keep").alias("keep_row_id"), F.col(key).alias("copy_row_id"))


def one_record_each(rows: DataFrame, key: str = "row_id", serial: str = "txn_serial", columns: list[str] = BUSINESS) -> DataFrame:
    """(row_id, copies): one row per distinct record, with the number of records it stands for (1 for singletons, which are never shuffled).

    Null rows: a record whose columns are all null has no serial and stays alone. An empty table gives no rows.
    """
    each = copy_groups(rows, key, serial, columns, rest=True)
    return each.filter(F.col("keep").isNull() | (F.col("keep") == F.col(key))).select(key, F.coalesce("copies", F.lit(1)).alias("copies"))
