"""Chunks are applied once, whatever is delivered again."""

import os

from tracewright.streaming import chunks as ch


def h(n, size=64):
    return "0x" + f"{n:0{size}x}"


def rows(*numbers):
    return [("c", 1, n, 1700000000, 0, h(n), h(1, 40), h(2, 40), h(3, 40), "5") for n in numbers]


def test_replay_and_validation(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    os.mkdir(src)
    bad = [("c", 1, 99, 0, 0, h(9), h(1, 40), h(2, 40), h(3, 40), "5"), ("c", 1, 98, 1, 0, "0xzz", h(1, 40), h(2, 40), h(3, 40), "5"), ("c", 1, None, 1, 0, h(9), h(1, 40), h(2, 40), h(3, 40), "5")]
    spark.createDataFrame(rows(1, 2, 2, 3) + bad, ch.CHUNK).write.mode("append").parquet(src)
    ch.ingest(spark, src, out, ck).awaitTermination()
    spark.createDataFrame(rows(3, 4), ch.CHUNK).write.mode("append").parquet(src)
    ch.ingest(spark, src, out, ck).awaitTermination()
    assert sorted(r.block_number for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]
    ch.ingest(spark, src, out, str(tmp_path / "ck2")).awaitTermination()  # everything once more
    assert spark.read.parquet(out).count() == 4


def test_authoritative_entries(spark):
    s = "chunk_key string, chain_id int, dataset string, from_block int, to_block int, addresses array<string>, status string, schema_version int, success_marker boolean, completed_at int, synced_at int"
    e = [("a", 1, "t", 1, 2, ["x", "y"], "ok", 1, True, 5, 1), ("b", 1, "t", 1, 2, ["y", "x", "x"], "ok", 1, True, 5, 2), ("c", 1, "t", 1, 2, ["x", "y"], "quarantined", 1, True, 9, 9), ("d", 1, "t", 1, 2, ["x", "y"], "ok", None, True, 9, 9), ("e", 1, "t", 1, 2, ["x"], "ok", 1, True, None, None)]
    assert sorted(r.chunk_key for r in ch.authoritative(spark.createDataFrame(e, s)).collect()) == ["b", "e"]


def test_windows_with_watermark(spark, small_dir):
    ev = spark.read.parquet(f"{small_dir}/events.parquet").withColumnRenamed("ts", "t0").selectExpr("*", "cast(t0 as timestamp) ts")
    assert ch.windowed(ev).agg({"n": "sum"}).first()[0] == ev.count()


def test_whole_chunks_are_verified_merged_and_published(spark, tmp_path):
    src, out, reg, ck = (str(tmp_path / x) for x in ("in", "out", "reg", "ck"))
    os.mkdir(src)
    bad = [("q", *rows(50)[0][1:]), ("q", 1, 99, 0, 0, h(9), h(1, 40), h(2, 40), h(3, 40), "5")]
    spark.createDataFrame(rows(1, 2) + bad, ch.CHUNK).write.mode("append").parquet(src)
    for k in ("ck", "ck2"):  # the second time everything is known
        ch.ingest(spark, src, out, str(tmp_path / k), registry=reg).awaitTermination()
        assert sorted(r.block_number for r in spark.read.parquet(out).collect()) == [1, 2]
        assert {(r.chunk_key, r.rows, r.valid_rows, r.status) for r in spark.read.parquet(reg).collect()} == {("c", 2, 2, "published"), ("q", 2, 1, "quarantined")}
        assert spark.read.parquet(reg).count() == 2


def test_statements_stream_into_the_ledger(spark, tmp_path):
    from tracewright.sources import files

    src = tmp_path / "in"
    src.mkdir()
    head = "入账日期,交易描述,入账金额,入账货币\n"
    (src / "a.csv").write_text(head + '2024-01-01,x,"1,000.5",CNY\n', encoding="utf-8")
    layout = files.layout_of(head.encode())
    go = lambda: ch.statements(spark, str(src), layout, "信用卡账单", "card", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    go()
    (src / "b.csv").write_text(head + "入账日期,y,2,USD\n", encoding="utf-8")
    go()
    got = sorted((r.src_file, r.txn_time, r.amount, r.currency, r.data_source) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a.csv", "2024-01-01", "1000.50", "CNY", "card"), ("b.csv", "入账日期", "2.00", "USD", "card")]
