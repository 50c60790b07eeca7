"""Problem 3: formats, zones, and the dictionary against direct parsing."""

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tracewright.operators import instants as ins

NY, LDN, SYD, SH, CHI = "America/New_York", "Europe/London", "Australia/Sydney", "Asia/Shanghai", "America/Chicago"
CASES = [
    ("2022-04-17 08:12:33", NY, "MDY", "2022-04-17 12:12:33"),
    ("10/29/2022 10:20:18 PM", NY, "MDY", "2022-10-30 02:20:18"),
    ("1/1/2020 12:05:00 AM", NY, "MDY", "2020-01-01 05:05:00"),
    ("13/29/2022 10:20:18", NY, "MDY", None),
    ("17/08/22 23:43", SYD, "DMY", "2022-08-17 13:43:00"),
    ("3-5-2021 05:35:41", SYD, "DMY", "2021-05-02 19:35:41"),
    ("44782.992650463", SH, "YMD", "2022-08-09 15:49:25"),
    ("2023年5月24日17时47分49秒", SH, "YMD", "2023-05-24 09:47:49"),
    ("2023年5月24日", SH, "YMD", "2023-05-23 16:00:00"),
    ("20231206235253", SH, "YMD", "2023-12-06 15:52:53"),
    ("20231206", SH, "YMD", "2023-12-05 16:00:00"),
    ("1632333153343", NY, "MDY", "2021-09-22 17:52:33"),
    ("1700662958", None, None, "2023-11-22 14:22:38"),
    ("2024-05-21 11:20:06 GMT+8", SH, "YMD", "2024-05-21 03:20:06"),
    ("2020-09-20T21:51:58.784-05:00", CHI, "MDY", "2020-09-21 02:51:58"),
    ("2024-03-17T22:15:32.649706Z", None, None, "2024-03-17 22:15:32"),
    ("2023-05-21 09:52:53 BST", LDN, "DMY", "2023-05-21 08:52:53"),
    ("2024-10-07 07:43:55 CST", CHI, "MDY", "2024-10-07 13:43:55"),
    ("2024-10-07 07:43:55 CST", SH, "YMD", "2024-10-06 23:43:55"),
    ("2024-09-29-17.13.04.668634", CHI, "MDY", "2024-09-29 22:13:04"),
    ("2022-03-13 02:37:50", NY, "MDY", None),  # skipped
    ("2020-11-01 01:08:58", CHI, "MDY", "2020-11-01 06:08:58"),  # first passing
    (" ２０２３-07-14 12:15:52　", CHI, "MDY", "2023-07-14 17:15:52"),
    ("2022-02-30 10:00:00", SH, "YMD", None),
    ("2022-02-20 24:00:00", SH, "YMD", None),
    ("2022-02-20 10:00:60", SH, "YMD", None),
    ("2022-02-20 10:00:00", None, None, None),
    ("0000-00-00 00:00:00", SH, "YMD", None),
    ("待补录", SH, "YMD", None), ("nan", SH, "YMD", None), ("", SH, "YMD", None), (None, SH, "YMD", None),
    ("9" * 5000, SH, "YMD", None),
]


def test_formats(spark):
    df = spark.createDataFrame([(i, r, z, o) for i, (r, z, o, _) in enumerate(CASES)], "i int, raw string, zone_id string, date_order string")
    got = {r.i: r.s for r in ins.parse_instants(df).select("i", F.date_format("instant", "yyyy-MM-dd HH:mm:ss").alias("s")).collect()}
    assert {CASES[i][:3]: v for i, v in got.items()} == {c[:3]: c[3] for c in CASES}


@pytest.mark.parametrize("zone", [NY, LDN, SYD, SH])
def test_every_hour_of_a_year_against_zoneinfo(spark, zone):
    df = spark.range(0, 366 * 24).select(F.date_format(F.timestamp_seconds(F.col("id") * 3600 + 1577836800 + 1800), "yyyy-MM-dd HH:mm:ss").alias("raw"), F.lit(zone).alias("zone_id"), F.lit("YMD").alias("date_order"))
    for r in ins.parse_instants(df).select("raw", F.unix_seconds("instant").alias("s")).collect():
        local = datetime.strptime(r.raw, "%Y-%m-%d %H:%M:%S").replace(tzinfo=ZoneInfo(zone))
        real = local.astimezone(timezone.utc).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == local.replace(tzinfo=None)
        assert r.s == (int(local.timestamp()) if real else None), r.raw


def test_rows_keep_their_number_and_extra_columns_do_no_harm(spark):
    rows = [(1, "L1", "s", "2024-01-01 00:00:00", "x"), (2, "L1", "s", "2024-01-01", "x"), (3, "L1", None, "2024-01-01", "x"), (4, "", "s", "2024-01-01", "x"), (5, None, "t", None, "x"), (5, "L1", "s", "1704038400", "x")]
    ledger = spark.createDataFrame(rows, "row_id bigint, log_no string, data_source string, txn_time string, instant string")
    profiles = spark.createDataFrame([("s", SH, "YMD"), ("t", None, "YMD"), (None, SH, "YMD")], "data_source string, zone_id string, date_order string")
    got = ins.with_instants(ledger, profiles, keep=["row_id", "log_no"])
    assert got.count() == 6 and got.filter("instant is null").count() == 2
    pairs = {(r.row_id_1, r.row_id_2) for r in ins.same_instant_pairs(got).collect()}
    assert pairs == {(1, 2), (1, 5), (2, 5)}
    assert ins.same_instant_pairs(ins.with_instants(ledger.limit(0), profiles, keep=["row_id", "log_no"])).count() == 0


def test_hot_pairs_are_split_but_whole(spark):
    rows = spark.range(3000).selectExpr("id AS row_id", "CASE WHEN id % 10 < 9 THEN 'H' ELSE concat('L', id div 30) END AS log_no", "timestamp_seconds(CASE WHEN id % 10 < 9 THEN id % 20 ELSE 0 END) AS instant")
    want = {}
    for r in rows.collect():
        want.setdefault((r.log_no, r.instant), []).append(r.row_id)
    got = ins.same_instant_pairs(rows)
    assert got.count() == got.distinct().count() == sum(len(v) * (len(v) - 1) // 2 for v in want.values())


def keyed(spark, profiles, *raw):
    return ins.with_profiles(spark.createDataFrame([("s", r) for r in raw], "source string, raw string"), profiles)


def profile(spark, zone, order="YMD"):
    return spark.createDataFrame([("s", zone, order)], "data_source string, zone_id string, date_order string")


def test_dictionary_grows_only_by_what_is_new(spark, tmp_path):
    p, path = profile(spark, SH), f"file://{tmp_path}/book"
    ins.InstantDictionary(spark, path).extend(keyed(spark, p, "2024-01-01", "2024-01-02", "2024-01-01"))
    again = ins.InstantDictionary(spark, path)  # as by another session
    again.extend(keyed(spark, p, "2024-01-02", "2024-01-03", "nothing"))
    assert sorted(r.raw for r in again.entries().collect()) == ["2024-01-01", "2024-01-02", "2024-01-03"] and len(again.batches()) == 2
    assert again.resolve(keyed(spark, p, "2024-01-02", "2024-01-01")).count() == 2


def test_a_changed_profile_gets_its_own_entries(spark, tmp_path):
    path = f"file://{tmp_path}/book"
    rows = spark.createDataFrame([(1, "s", "03/04/2024 00:00")], "row_id int, data_source string, txn_time string")
    at = lambda zone, order: ins.with_instants(rows, profile(spark, zone, order), path=path).select(F.unix_seconds("instant")).collect()
    day = lambda m, d, h: [(int(datetime(2024, m, d, h, tzinfo=timezone.utc).timestamp()),)]
    assert at("UTC", "DMY") == day(4, 3, 0) and at("UTC", "MDY") == day(3, 4, 0) and at(SH, "MDY") == day(3, 3, 16) and at("UTC", "DMY") == day(4, 3, 0)
    assert ins.InstantDictionary(spark, path).entries().count() == 3


def test_an_extension_that_broke_off_leaves_nothing(spark, tmp_path):
    (tmp_path / "book" / ".new-x").mkdir(parents=True)
    (tmp_path / "book" / ".new-x" / "part-0.parquet").write_bytes(b"half")
    book = ins.InstantDictionary(spark, f"file://{tmp_path}/book").extend(keyed(spark, profile(spark, SH), "2024-01-01"))
    assert book.entries().count() == 1
