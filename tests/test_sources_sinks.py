"""Files in, files out."""

import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewright.functions import events as ev
from tracewright.operators import ledger as lg
from tracewright.sources import files, jdbc, sinks, xlsx


def put(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return str(path)


@pytest.mark.parametrize("encoding, sep", [("utf-8-sig", ","), ("gb18030", "\t"), ("utf-8", ";"), ("utf-8", "|")])
def test_delimited_text_of_any_kind(spark, tmp_path, encoding, sep):
    lines = ["账单导出", sep.join(["交易时间", "交易金额", "收付标志", "对手户名"]), sep.join(["2024-01-01 00:00:00", "1.00", "进", "甲"]), sep.join(["2024-01-02 00:00:00", "2.00", "出", "乙"])]
    df = files.read_delimited(spark, put(tmp_path / "a.csv", "\n".join(lines) + "\n", encoding))
    assert df.columns == ["交易时间", "交易金额", "收付标志", "对手户名"]
    assert sorted(tuple(r) for r in df.collect()) == [("2024-01-01 00:00:00", "1.00", "进", "甲"), ("2024-01-02 00:00:00", "2.00", "出", "乙")]


def test_folder_scan_headers_and_union(spark, tmp_path):
    put(tmp_path / "微信.csv", "交易时间,金额,收/支,交易对方\n1,2,3,4\n")
    put(tmp_path / "x.csv", "a,b\n1,2\n")
    got = {os.path.basename(x["path"]): (x["kind"], x["provider"]) for x in files.scan_folder(spark, str(tmp_path))}
    assert got == {"微信.csv": ("transaction", "wechat"), "x.csv": ("unknown", "unknown")}
    assert files.auto_map(["交易日期", "金额", "借贷方向", "对方名称", "zzz"]) == {"交易日期": "txn_time", "金额": "amount", "借贷方向": "direction", "对方名称": "cp_name"}
    many = files.read_many(spark, [str(tmp_path / "微信.csv"), str(tmp_path / "x.csv")])
    assert many.count() == 2 and set(many.columns) == {"交易时间", "金额", "收/支", "交易对方", "src_file", "a", "b"}


def test_only_the_header_is_dropped_and_quoted_breaks_stay(spark, tmp_path):
    # A data row that repeats the header's or the preamble's first cell, a quoted line break, and a header below a preamble with blank lines.
    text = '导出,x\n\n交易时间,交易金额,收付标志,对手户名\n交易时间,1,进,甲\n导出,2,出,"two\nlines"\n"a ""q"", b",3,进,\n'
    want = [("a \"q\", b", "3", "进", None), ("交易时间", "1", "进", "甲"), ("导出", "2", "出", "two\nlines")]
    path = put(tmp_path / "a.csv", text)
    assert sorted(tuple(r) for r in files.read_delimited(spark, path).collect()) == want
    b = put(tmp_path / "b.csv", text.replace("导出,x\n\n", "", 1))
    put(tmp_path / "c.csv", "交易时间,交易金额,收付标志,其他\n1,2,3,4\n")
    many = files.read_many(spark, [path, b, str(tmp_path / "c.csv")])
    got = sorted(((r.src_file, r["交易时间"], r["对手户名"], r["其他"]) for r in many.collect()), key=str)
    assert len(got) == 7 and ("c.csv", "1", None, "4") in got and sum(1 for x in got if x[0] == "b.csv") == 3 and ("b.csv", "导出", "two\nlines", None) in got


def test_large_file_in_pieces_loses_only_its_header(spark, tmp_path):
    path = put(tmp_path / "big.csv", "交易时间,交易金额,收付标志\n" + "".join(f"交易时间,{i},进\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = files.read_delimited(spark, path, multi_line=False)
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20000 and df.select("交易金额").distinct().count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_wide_sheets_and_control_characters(spark, tmp_path):
    df = spark.createDataFrame([("a\x01b_x0041_", *["v"] * 59)], ", ".join(f"c{i} string" for i in range(60)))
    path = str(tmp_path / "wide.xlsx")
    sinks.write_workbook(df, path)
    spark.dataSource.register(xlsx.XlsxSource)
    got = spark.read.format("xlsx_text").load(path)
    row = got.filter("row_no = 2").first()
    assert len(got.columns) == 62 and row.c1 == "a\x01b_x0041_" and row.c60 == "v"
    with pytest.raises(Exception, match="60 cells"):
        spark.read.format("xlsx_text").option("width", 40).load(path).collect()
    sinks.write_workbook(spark.createDataFrame([("t", "1", "进", "x")], "`交易时间` string, `交易金额` string, `收付标志` string, extra string"), str(tmp_path / "two.xlsx"))
    both = files.read_workbooks(spark, [path, str(tmp_path / "two.xlsx")])
    assert both.count() == 2 and [r.extra for r in both.filter("src_file = 'two.xlsx'").collect()] == ["x"]
    kinds = {(os.path.basename(x["path"]), x["sheet"]): x["kind"] for x in files.scan_folder(spark, str(tmp_path))}
    assert kinds == {("wide.xlsx", "Sheet1"): "unknown", ("two.xlsx", "Sheet1"): "transaction"}


def test_compaction_survives_a_crash_and_exports_are_whole(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.write_parquet(spark.createDataFrame([(1, 1)], "k int, v int"), out)
    os.rename(out, out + ".old")  # as after a crash between the two renames
    sinks.recover(spark, out)
    assert spark.read.parquet(out).count() == 1
    sinks.compact(spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "k int, v int"), ["k"], ["v"], out)
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, 3), (2, 2)] and not os.path.exists(out + ".old")
    act = spark.createDataFrame([(i, 1) for i in range(9)], "activity_id int, chain_id int")
    assert sinks.export(act, "address_activity", ["activity_id"], {}, []).count() == 9
    cut = sinks.export(act, "address_activity", ["activity_id"], {}, [("activity_id", False)], limit=4).collect()
    assert [r.activity_id for r in cut] == [0, 1, 2, 3] and all(r.truncated for r in cut)
    assert sinks.write_verified(act, str(tmp_path / "v")) == 9 and sinks.write_verified(act.limit(0), str(tmp_path / "e")) == 0
    t = sinks.typed_for_export(spark.createDataFrame([("1.005", "2024-01-02 03:04:05", "x"), ("?", None, "y")], "amount string, txn_time string, remark string"))
    assert dict(t.dtypes) == {"amount": "decimal(20,2)", "txn_time": "timestamp", "remark": "string"} and [r.amount is None for r in t.collect()] == [False, True]


def test_database_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "甲", "5"), (2, "乙", "6"), (2, "乙", "6")], "id int, name string, v string")
    assert jdbc.write_new_rows(rows, url, "t", ["id", "name"]) == 2
    assert jdbc.write_new_rows(rows.withColumn("extra", F.lit("e")).union(spark.createDataFrame([(3, "丙", "7", "e")], "id int, name string, v string, extra string")), url, "t", ["id", "name"]) == 1
    page = jdbc.browse(spark, url, "t", search="乙", order=["id"], size=10)
    assert [(r["id"], r.name, r.total_rows) for r in page.collect()] == [(2, "乙", 1)]
    assert [r["id"] for r in jdbc.browse(spark, url, "t", filters={"id": [1, 3]}, order=["id"], page=2, size=1).collect()] == [3]
    assert jdbc.read_table(spark, url, "t", "id", 1, 4, 3).count() == 3
    assert jdbc.read_query(spark, url, "SELECT COUNT(*) AS n FROM t").first()[0] == 3


def test_import_keeps_every_row_once(spark):
    src = spark.createDataFrame([(1, "2024-01-01", "1,000", "支出"), (2, "", "1", "进"), (3, "t", "abc", "进"), (4, "t", "1", "?"), (5, None, None, None)], "id int, `时间` string, `钱` string, `向` string")
    good, bad = jdbc.import_rows(src, {"时间": "txn_time", "钱": "amount", "向": "direction"}, "db", "id")
    assert [(r["id"], r.amount, r.direction) for r in good.collect()] == [(1, "1000.00", "出")]
    assert sorted((r["id"], r.error_field, r.error_value) for r in bad.collect()) == [(2, "txn_time", ""), (3, "amount", "abc"), (4, "direction", "?"), (5, "txn_time", "")]


def test_address_lists_and_price_archives(spark, tmp_path):
    a = "0x" + "aB" * 20
    df = spark.createDataFrame([("x", a), ("y", a.lower()), ("z", "0x12"), ("z", ""), ("z", None)], "note string, wallet string")
    got, counts = files.address_list(df)
    assert [(r.address, r.n) for r in got.collect()] == [(a.lower(), 2)]
    assert counts.first().asDict() == {"rows": 5, "valid": 2, "invalid": 1, "blank": 2, "repeated": 1}
    with pytest.raises(ValueError):
        files.address_list(spark.createDataFrame([("q",)], "note string"))
    lines = ["open_time,open", "1577836800000,1,2,0.5,1.5,10,1577836859999,15,7,1,1,0", "1577836860001,1,2,0.5,1.5,10,0,15,7,1,1,0", "1577836920000,3,2,0.5,1.5,10,0,15,7,1,1,0"]
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        z.writestr("p.csv", "\n".join(lines))
    good, bad = files.read_price_archive(spark, str(tmp_path / "p.zip"), str(tmp_path / "x"), 1, "ZNB", "USDX", files.sha256_file(str(tmp_path / "p.zip")))
    assert [(int(r.minute.timestamp()), float(r.close), r.trade_count) for r in good.collect()] == [(1577836800, 1.5, 7)] and bad.count() == 3
    with pytest.raises(ValueError, match="checksum"):
        files.read_price_archive(spark, str(tmp_path / "p.zip"), str(tmp_path / "x"), 1, "ZNB", "USDX", "0" * 64)
    assert files.new_minutes(good, good).count() == 0


def test_archives_stay_inside(tmp_path):
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("d/a.txt", "x")
    assert [os.path.basename(p) for p in files.expand_zip(str(tmp_path / "ok.zip"), str(tmp_path / "out"))] == ["a.txt"]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError):
        files.expand_zip(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_workbook_round_trip_with_rollover(spark, tmp_path):
    df = spark.createDataFrame([(i, f"名<{i}>", None) for i in range(7)], "n int, s string, z string").orderBy("n")
    path = str(tmp_path / "b.xlsx")
    assert sinks.write_workbook(df, path, sheet_rows=3) == 3
    spark.dataSource.register(xlsx.XlsxSource)
    got = spark.read.format("xlsx_text").option("width", 3).load(path)
    rows = sorted((r.sheet, r.row_no, r.c1, r.c2) for r in got.collect())
    assert len(rows) == 10 and rows[0] == ("Sheet1", 1, "n", "s") and rows[-1] == ("Sheet3", 2, "6", "名<6>")


def test_manifest_compaction_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, v int, x string")
    out = str(tmp_path / "t")
    sinks.compact(df, ["k"], ["v"], out)
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == ["b", "c"]
    sinks.write_manifest(out, 2)
    assert sinks.verify_manifest(out) == [] and json.load(open(out + "/manifest.json"))["rows"] == 2
    part = next(f for f in os.listdir(out) if f.endswith(".parquet"))
    put(os.path.join(out, part), "broken")
    assert sinks.verify_manifest(out) == [part]
    assert sinks.zip_folder(out, str(tmp_path / "t.zip")) >= 2
    act = spark.createDataFrame([(1, 1, "0xa", "IN"), (2, 56, "0xb", "OUT")], "activity_id int, chain_id int, address string, direction string")
    assert [r.activity_id for r in sinks.export(act, "address_activity", ["activity_id"], {"chain_id": [1]}, [("activity_id", True)]).collect()] == [1]
    for bad in ({"columns": ["secret"]}, {"filters": {"amount": 1}}, {"order": [("address", True)]}, {"limit": 0}):
        with pytest.raises(ValueError):
            sinks.export(act, "address_activity", **({"columns": ["activity_id"], "filters": {}, "order": []} | bad))


def test_equal_files(spark, tmp_path):
    paths = [put(tmp_path / n, t) for n, t in (("a", "xx"), ("b", "xx"), ("c", "xy"), ("d", "longer"))]
    got = {os.path.basename(r.path): os.path.basename(r.kept) for r in files.same_files(spark, paths).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


@pytest.mark.parametrize("sql", ["DELETE FROM t", "SELECT 1; DROP TABLE t", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "", "update t set a=1"])
def test_only_selects_pass(sql):
    with pytest.raises(ValueError):
        jdbc.read_only(sql)
    assert jdbc.read_only("SELECT 'drop; table' AS a -- x\n;").startswith("SELECT")


def test_source_mapping_and_audits(spark):
    src = spark.createDataFrame([("甲(a@x)", "乙(123)", "2024-01-01", "12,3.456", "支出", "S1")], "`用户信息` string, `交易对方信息` string, `付款时间` string, `金额（元）` string, `收/支` string, `交易号` string")
    r = lg.map_source(src, "支付宝账户明细", "alipay").first()
    assert (r.account_no, r.account_name, r.cp_account, r.cp_name, r.txn_time, r.amount, r.direction, r.txn_serial, r.bank, r.remark) == ("a@x", "甲", "123", "乙", "2024-01-01", "123.46", "出", "S1", "支付宝", None)
    fen = spark.createDataFrame([("100", "12345", "入")], "`交易时间` string, `交易金额(分)` string, `借贷类型` string")
    assert lg.map_source(fen, "微信交易明细信息", "wechat").first().amount == "123.45"


def test_strict_dedup_cases(spark):
    cols = ["row_id bigint"] + [f"{c} string" for c in list(lg.CANONICAL.values()) + ["src_record_id"]]
    names = [c.split()[0] for c in cols]
    mk = lambda i, **kw: tuple({"row_id": i, "txn_time": "t", "amount": "1", "direction": "进"}.get(n) if n not in kw else kw[n] for n in names)
    rows = [mk(1, src_record_id="r1"), mk(2, src_record_id="r2"), mk(3, txn_serial="S", src_record_id="r3"), mk(4, txn_serial="S", src_record_id="r4"), mk(5, txn_serial="S", summary="x"), mk(6, direction=""), mk(7, direction="??"), mk(8, amount=""), mk(9, feedback_reason="交易失败"), mk(10, txn_time=None)]
    got = lg.classify(spark.createDataFrame(rows, ", ".join(cols)), ["row_id"])
    clean, dup, bad = lg.outputs(got)
    assert sorted(r.row_id for r in clean.collect()) == [1, 2, 3, 5, 8] and [(r.row_id, r.kept_id) for r in dup.collect()] == [(4, 3)]
    assert {r.row_id: r.reject_reason for r in bad.collect()} == {6: "missing_direction", 7: "invalid_direction", 9: "failed_feedback", 10: "missing_time"}
    assert 8 not in {r.row_id for r in lg.outputs(lg.classify(spark.createDataFrame(rows, ", ".join(cols)), ["row_id"], strict_amount=True))[0].collect()}


def w(n):
    return f"{n:064x}"


def test_event_decoding(spark):
    pad = lambda a: "0x" + "0" * 24 + a * 40
    t = ev.TRANSFER_TOPICS
    batch = "0x" + w(64) + w(160) + w(2) + w(7) + w(8) + w(2) + w(70) + w(80)
    logs = [
        (1, t[0], pad("a"), pad("b"), None, "0x" + w(5)), (2, t[0], pad("a"), pad("b"), "0x" + w(9), "0x"), (3, t[1], pad("e"), pad("a"), pad("b"), "0x" + w(3) + w(4)),
        (4, t[2], pad("e"), pad("a"), pad("b"), batch), (5, t[2], pad("e"), pad("a"), pad("b"), "0x" + w(64) + w(160) + w(2) + w(7)), (6, "0xff", None, None, None, "0x"), (7, t[0], pad("a"), pad("b"), None, "0x" + "f" * 64),
    ]
    df = spark.createDataFrame(logs, "log_index int, topic0 string, topic1 string, topic2 string, topic3 string, data string")
    got = sorted((r.log_index, r.standard, r.batch_index, None if r.value is None else int(r.value), r.sender[-1], r.receiver[-1]) for r in ev.decode_transfers(df).collect())
    assert got == [(1, "ERC20", 0, 5, "a", "b"), (2, "ERC721", 0, 1, "a", "b"), (3, "ERC1155", 0, 4, "a", "b"), (4, "ERC1155", 0, 70, "a", "b"), (4, "ERC1155", 1, 80, "a", "b"), (7, "ERC20", 0, None, "a", "b")]
    one = spark.range(1).select(ev.signed_word(F.lit("f" * 63 + "e")).alias("n"), ev.v3_spot(F.lit(str(2**96)).cast("decimal(38,0)"), F.lit(18), F.lit(6)).alias("p")).first()
    assert one.n == -2 and one.p == 1e12


def test_ledger_dialect(spark):
    src = spark.createDataFrame([("5", "2024/01/02 03:04:05", "0xAB", "3", "0xT", "S", "0xF", "0xG", "1,000.5"), ("x", "2024/01/02 03:04:05", "0xAB", "3", "0xT", "S", "0xF", "0xG", "1"), ("5", "2024/01/02 03:04:05", "0xAB", "", "0xT", "S", "0xF", "0xG", "?")], "`区块高度` string, `UTC时间` string, `交易哈希` string, logIndex string, `代币地址` string, `代币符号` string, `发送方` string, `接收方` string, `数量` string")
    rows = sorted(files.ledger_dialect(src, "ledger10").collect(), key=lambda r: r.reject_reason or "")
    assert [r.reject_reason for r in rows] == [None, "bad_block", "bad_value"] and rows[0].tx_hash == "0xab" and float(rows[0].value) == 1000.5 and rows[2].log_index == files.SYNTHETIC
    nine = src.drop("logIndex")
    both = files.ledger_dialect(nine.union(nine.filter("`数量` = '1,000.5'")).union(nine.filter("`数量` = '1,000.5'").withColumn("数量", F.lit("7e2"))), "transfer9", spark.createDataFrame([("0xT", "2")], "token_address string, decimals string"))
    # The repeated row keeps its index, the other transfer of the same transaction has another one.
    good = sorted((float(r.value), r.log_index, int(r.value_raw)) for r in both.collect() if r.reject_reason is None)
    assert good[0][0] == 700.0 and good[0][2] == 70000 and good[1] == good[2] and good[0][1] != good[1][1]
    assert files.dialect_of(src.columns) == "ledger10" and files.dialect_of(nine.columns) == "transfer9" and files.dialect_of(["a"]) is None
