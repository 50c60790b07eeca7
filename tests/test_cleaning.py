"""Scalar rules on single values, and small relational sources."""

import pytest
from pyspark.sql import functions as F

from tracewright.functions import cleaning as cl
from tracewright.operators import scoring
from tracewright.sources import files, sinks


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


@pytest.mark.parametrize("text, want", [("￥1,234.50元", 1234.5), ("-5", -5.0), ("abc", 0.0), (None, 0.0), ("", 0.0), ("1.2.3", 0.0)])
def test_numbers(spark, text, want):
    assert one(spark, cl.to_number(lit(text))) == (want,)


@pytest.mark.parametrize("text, want", [("借", "出"), (" 贷方 ", "进"), ("D", "出"), ("+", "进"), ("未知", "未知"), (None, None), ("", "")])
def test_directions(spark, text, want):
    assert one(spark, cl.direction(lit(text))) == (want,)


def test_text_rules(spark):
    assert one(spark, cl.account_number(F.lit("ICBC-6222_x1")), cl.clean_text(F.lit(" 　a\r\nb﻿ ")), cl.clean_text(F.lit("nan")), cl.mask_label(F.lit("6222000011112222")), cl.mask_label(F.lit("x" * 30))) == ("6222", "a  b", None, "6222…2222", "x" * 24 + "…")
    a, b = cl.split_named(F.lit("张三(138)"))
    assert one(spark, a, b) == ("张三", "138")
    assert one(spark, cl.scaled(F.lit("5"), F.lit(3)), cl.scaled(F.lit("12345"), F.lit(2)), cl.scaled(F.lit("0012"), F.lit(0)), cl.scaled(F.lit("x"), F.lit(1))) == ("0.005", "123.45", "12", None)


def test_big_words(spark):
    total = cl.limbs_total(cl.hex_limbs(F.lit("0x" + f"{10**30:064x}")))
    assert int(one(spark, total)[0]) == 10**30
    assert one(spark, cl.limbs_total(cl.hex_limbs(F.lit("0x" + "f" * 64))), cl.limbs_total(cl.hex_limbs(F.lit("zz"))), cl.limbs_total(cl.hex_limbs(lit(None)))) == (None, None, None)


def test_contract_rules(spark):
    slot, none = F.lit("0x" + "0" * 24 + "a" * 40), F.lit("0x" + "0" * 64)
    minimal = F.lit("0x363d3d373d3d3d363d73" + "b" * 40 + "5af43d82803e903d91602b57fd5bf3")
    kinds = [cl.proxy_kind(minimal, slot, none, none, F.lit(False)), cl.proxy_kind(F.lit("0x60"), slot, slot, slot, F.lit(True)), cl.proxy_kind(F.lit("0x60"), none, slot, slot, F.lit(True)), cl.proxy_kind(F.lit("0x60"), none, none, slot, F.lit(True)), cl.proxy_kind(F.lit("0x60"), none, lit(None), slot, lit(None).cast("boolean")), cl.proxy_kind(lit(None), none, none, none, F.lit(False))]
    assert one(spark, *kinds) == ("EIP1167", "BEACON", "TRANSPARENT", "UUPS", "EIP1967", "NONE")
    yes, no, nul = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    assert one(spark, cl.creation_kind(yes, yes, yes, F.lit("create2")), cl.creation_kind(nul, yes, yes, F.lit("create2")), cl.creation_kind(no, no, yes, F.lit("create2")), cl.creation_kind(no, nul, no, F.lit("create2")), cl.creation_kind(no, no, no, lit(None))) == ("TOKEN", "PROXY", "FACTORY", "CREATE2", "UNKNOWN")


def test_small_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(" 0x" + "A" * 40,), ("0x" + "a" * 40,), ("0xzz",), (None,)], "a string")
    assert [(r.address, r.n) for r in files.address_list(df, "a")[0].collect()] == [("0x" + "a" * 40, 2)]
    m = "chain_id int, symbol string, quote_symbol string, minute int"
    new = files.new_minutes(spark.createDataFrame([(1, "A", "U", 1), (1, "A", "U", 2), (1, "A", "U", 2)], m), spark.createDataFrame([(1, "A", "U", 1)], m))
    assert [r.minute for r in new.collect()] == [2]
    nodes, edges = spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", 'b"c')], "src string, dst string")
    sinks.write_graph(nodes, edges, str(tmp_path))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "edges")).first().dst == 'b"c' and spark.read.json(str(tmp_path / "graph")).first().edge.src == "a"
    sinks.write_parquet(spark.range(10), str(tmp_path / "p"), rows_per_file=3)
    assert files.read_lake(spark, [str(tmp_path / "p")]).count() == 10 and files.rows_per_file(files.read_lake(spark, [str(tmp_path / "p")])).agg(F.max("rows")).first()[0] <= 3
