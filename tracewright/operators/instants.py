"""Mixed timestamp formats and zones to UTC instants (problem 3): a dictionary of distinct raw strings, parsed once, joined back.

All parsing is built-in column expressions, so it runs inside generated code.
"""

from __future__ import annotations

import uuid
import zoneinfo
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.runtime import file_system, hot_keys, materialize, same_keys, skew_safe_lookup, table_path

#: Zone abbreviations by region of the IANA zone, as minutes east of UTC.
REGION_ABBREVIATIONS = {
    "America/": {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600},
    "US/": {"EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420},
    "Europe/": {"BST": 60, "IST": 60, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180},
    "Australia/": {"AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "EST": 600, "EDT": 660, "CST": 570, "WST": 480},
    "Asia/": {"CST": 480, "HKT": 480, "SGT": 480, "JST": 540, "KST": 540, "IST": 330, "PHT": 480, "ICT": 420, "WIB": 420},
}
#: Suffixes that mean UTC wherever they are written.
UTC_NAMES = ("Z", "UTC", "GMT", "UT")

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
_ZONE = r"(Z|(?:UTC|GMT)?\s*[+-]\d{1,2}(?::?\d{2})?|(?!AM$|PM$)[A-Z]{2,5}|[A-Z][A-Z_]+/[A-Z_]+(?:/[A-Z_]+)?)?"
_YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ -]+(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2})(?:[.,]\d+)?)?\s*(AM|PM)?\s*" + _ZONE + r")?$"
_YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?: +(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?\s*(AM|PM)?\s*" + _ZONE + r")?$"
_DIGITS = r"^(\d{4})(\d{2})(\d{2}) ?(?:(\d{2})(?:(\d{2})(\d{2})?)?)?$"


def normal_text(raw: Column) -> Column:
    """Full-width forms, T, CJK field names and spaces in one notation; outer quotes and spaces gone; upper case."""
    s = F.translate(raw, _FULL, _HALF)
    s = F.regexp_replace(s, "[​‎‏⁠﻿]", "")
    s = F.regexp_replace(s, r"""^[\s"']+|[\s"']+$""", "")
    s = F.upper(s)
    s = F.regexp_replace(s, r"(?<=\d)T(?=\d)", " ")
    s = F.translate(s, "年月日时時点分秒", "-- :::: ")
    s = F.regexp_replace(s, r":\s*(?=$|[+A-Z-])", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _offset_minutes(zone: Column, zone_id: Column) -> Column:
    """Minutes east of UTC that a zone suffix names, null if it names none here."""
    digits = F.regexp_extract(zone, r"^(?:UTC|GMT)?\s*([+-])(\d{1,2})(?::?(\d{2}))?$", 2)
    sign = F.regexp_extract(zone, r"^(?:UTC|GMT)?\s*([+-])", 1)
    minutes = F.regexp_extract(zone, r"^(?:UTC|GMT)?\s*[+-]\d{1,2}:?(\d{2})$", 1)
    numeric = F.when(sign == "-", -1).otherwise(1) * (digits.try_cast("int") * 60 + F.coalesce(minutes.try_cast("int"), F.lit(0)))
    by_region = F.lit(None).cast("int")
    for region, names in REGION_ABBREVIATIONS.items():
        table = reduce(lambda acc, kv: acc.when(zone == kv[0], kv[1]), list(names.items())[1:], F.when(zone == list(names)[0], list(names.values())[0]))
        by_region = F.when(zone_id.startswith(region), table).otherwise(by_region)
    return F.when(zone.isin(*UTC_NAMES), 0).when(digits != "", F.when(F.abs(numeric) <= 18 * 60, numeric)).otherwise(by_region)


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with ``columns``, each computed once: a generator is a step that the optimizer doesn't merge into the uses."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def parse_instants(strings: DataFrame) -> DataFrame:
    """``strings`` (raw, zone_id, date_order and further columns) plus instant: the UTC instant in whole seconds, or null.

    * Epoch seconds (946684800 to 4102444800) and 13-digit milliseconds are UTC; 8, 10, 12 and 14 digits are dates written without
      separators; at most 5 digits before the point are a serial day number (day 0 is 1899-12-30), rounded to the second.
    * A zone in the text wins over ``zone_id``; abbreviations are those of the region of ``zone_id``.
    * Missing times and seconds are zero, fractions are dropped. Of a repeated hour the first passing counts.
    * Null: null, empty and unreadable text, impossible dates, times skipped by a change to summer time, no known zone.
    """
    kept = strings.columns
    s = F.col("__s")
    df = _step(strings, __s=normal_text(F.col("raw")))
    groups = "\x01".join(f"${i}" for i in range(1, 9))
    kind = (
        F.when(s.rlike(_DIGITS) & (F.length(F.regexp_replace(s, " ", "")).isin(8, 12, 14) | ((F.length(s) == 10) & s.rlike("^(19|20)"))), "digits")
        .when(s.rlike(r"^\d{9,10}$|^\d{13}$"), "epoch")
        .when(s.rlike(r"^\d{1,5}(?:\.\d+)?$"), "serial")
        .when(s.rlike(_YEAR_FIRST), "year_first")
        .when(s.rlike(_YEAR_LAST), "year_last")
    )
    df = _step(df, __kind=kind)
    k = F.col("__kind")
    parts = (
        F.when(k == "digits", F.regexp_replace(s, _DIGITS, "\x01".join(f"${i}" for i in range(1, 7)) + "\x01\x01"))
        .when(k == "year_first", F.regexp_replace(s, _YEAR_FIRST, groups))
        .when(k == "year_last", F.regexp_replace(s, _YEAR_LAST, groups))
    )
    df = _step(df, __p=F.split(parts, "\x01"))
    p, order = F.col("__p"), F.col("date_order")
    df = _step(df, **{f"__{i}": p[i].try_cast("int") for i in range(6)}, __half=p[6], __zone=F.when(p[7] != "", F.trim(p[7])))
    a, b, c = F.col("__0"), F.col("__1"), F.col("__2")
    century = lambda y: F.when(y < 70, y + 2000).otherwise(y + 1900)
    last, wide = k == "year_last", F.length(p[2]) == 4
    year = F.when(~last, a).when(order.isin("MDY", "DMY"), F.when(wide, c).otherwise(century(c))).when((order == "YMD") & ~wide, century(a))
    month = F.when(last & (order == "MDY"), a).otherwise(b)
    day = F.when(~last, c).when(order == "MDY", b).when(order == "DMY", a).otherwise(c)
    h = F.coalesce("__3", F.lit(0))
    hour = F.when(F.coalesce(F.col("__half"), F.lit("")) == "", h).when(h.between(1, 12), h % 12 + F.when(F.col("__half") == "PM", 12).otherwise(0))
    minute, second = F.coalesce("__4", F.lit(0)), F.coalesce("__5", F.lit(0))
    zone, zone_id = F.col("__zone"), F.col("zone_id")
    df = _step(
        df,
        __date=F.unix_seconds(F.call_function("try_make_timestamp", year, month, day, F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))),
        __clock=F.when((hour <= 23) & (minute <= 59) & (second <= 59), hour * 3600 + minute * 60 + second),
        __offset=F.when(zone.contains("/"), F.lit(None)).otherwise(_offset_minutes(zone, zone_id)),
        __n=F.when(k == "epoch", s.try_cast("bigint")),
        __days=F.when(k == "serial", s.try_cast("double")),
    )
    days, n = F.col("__days"), F.col("__n")
    seconds = F.when(days.between(1, 100000), (F.floor(days) - 25569) * 86400 + F.round((days - F.floor(days)) * 86400).cast("bigint"))
    df = _step(
        df,
        __local=F.timestamp_seconds(F.coalesce(seconds, F.col("__date") + F.col("__clock"))),
        __epoch=F.when(F.length(s) == 13, F.floor(n / 1000)).when(n.between(946684800, 4102444800), n),
        __usable=F.when(zone_id.isin(*sorted(zoneinfo.available_timezones())), zone_id),
    )
    local, usable = F.col("__local"), F.col("__usable")
    utc = F.to_utc_timestamp(local, usable)
    return df.select(
        *kept,
        F.when(k == "epoch", F.timestamp_seconds("__epoch"))
        .when(zone.isNotNull(), F.timestamp_seconds(F.unix_seconds(local) - F.col("__offset") * 60))
        .when(F.from_utc_timestamp(utc, usable) == local, utc)
        .alias("instant"),
    )


KEY = ["source", "raw", "zone_id", "date_order"]


class InstantDictionary:
    """Distinct (source, raw text, zone, order) with the instant each denotes, kept in a folder and extended by what is new.

    Zone and order of the source are part of the key: a profile that changes gets entries of its own, and the old ones stay true. Strings
    without a digit denote no instant and aren't kept. Every extension is one folder, written aside and renamed in, so an extension is
    there as a whole or not at all, and a dictionary opened on the same path by a later session goes on from it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or table_path(spark, "instants")

    def batches(self) -> list[str]:
        fs, folder = file_system(self.spark, self.path)
        return sorted(f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("batch-")) if fs.exists(folder) else []

    def entries(self) -> DataFrame:
        schema, found = "source string, raw string, zone_id string, date_order string, instant timestamp", self.batches()
        return self.spark.read.schema(schema).parquet(*found) if found else self.spark.createDataFrame([], schema)

    def extend(self, rows: DataFrame) -> "InstantDictionary":
        """Parse the keys of ``rows`` (see :func:`with_profiles`) that aren't kept yet."""
        new = rows.filter(F.col("raw").rlike(r"\d|[０-９]")).select(*KEY).distinct()
        if self.batches():
            new = new.alias("n").join(self.entries().alias("o"), same_keys("n", "o", *KEY), "left_anti")
        name = uuid.uuid4().hex
        fs, aside = file_system(self.spark, f"{self.path}/.new-{name}")
        parse_instants(new).select(*KEY, "instant").write.option("compression", "zstd").parquet(f"{self.path}/.new-{name}")
        if not fs.rename(aside, file_system(self.spark, f"{self.path}/batch-{name}")[1]):
            raise OSError(f"could not keep the new entries under {self.path}")
        return self

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with the key) plus instant. Hot strings are resolved by a bounded broadcast, see skew_safe_lookup."""
        return skew_safe_lookup(rows, self.entries(), KEY, ["instant"])


def with_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``rows`` (with source) plus zone_id and date_order of the source; null for a null or unknown one. Of several profiles of a source the smallest."""
    one = profiles.filter(F.col("data_source").isNotNull()).groupBy(F.col("data_source").alias("source")).agg(F.min(F.struct("zone_id", "date_order")).alias("p"))
    return skew_safe_lookup(rows, one.select("source", "p.zone_id", "p.date_order"), ["source"], ["zone_id", "date_order"])


def with_instants(rows: DataFrame, profiles: DataFrame, time_col: str = "txn_time", source_col: str = "data_source", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """``keep`` columns of ``rows`` plus instant (null where the text denotes none). Empty tables give no rows. ``path``: a dictionary to go on from."""
    keep = keep or ["row_id"]
    narrow = with_profiles(rows.select(*keep, F.col(source_col).alias("source"), F.col(time_col).alias("raw")), profiles)
    book = InstantDictionary(rows.sparkSession, path).extend(narrow)
    return book.resolve(narrow).drop(*KEY)


#: Ways into which the rows of a hot (log number, instant) are split when they are paired.
PAIR_SALTS = 16


def same_instant_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of rows (row_id, log_no, instant) with the same non-empty log_no and the same instant.

    The pairs are what is asked for, so a key of n rows gives n (n - 1) / 2 of them; the rows of a frequent key are dealt to PAIR_SALTS
    parts, each of which meets all rows of the key.
    """
    named = materialize(rows.filter((F.col("log_no") != "") & F.col("instant").isNotNull()).select("row_id", "log_no", "instant"), "named")
    hot = F.broadcast(hot_keys(named, ["log_no", "instant"]).withColumn("hot", F.lit(True)))  # at most HOT_KEYS rows
    marked = named.join(hot, ["log_no", "instant"], "left")
    a = marked.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(PAIR_SALTS))).otherwise(0)).alias("a")
    b = marked.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PAIR_SALTS - 1))).otherwise(F.array(F.lit(0))))).alias("b")
    return a.join(b, (F.col("a.log_no") == F.col("b.log_no")) & (F.col("a.instant") == F.col("b.instant")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.row_id") < F.col("b.row_id"))).select(
        F.col("a.row_id").alias("row_id_1"), F.col("b.row_id").alias("row_id_2")
    )
