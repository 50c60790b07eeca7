"""The driver's contract."""

import __spark_entry__ as entry


def test_queries_and_sql_agree_on_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 100
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6)} <= set(q)


def test_entry_runs(spark, small_dir):
    df = entry.entry(spark)
    assert df.columns and df.count() >= 0


def test_core_does_not_import_llm():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "tracewright"
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(from|import) tracewright\.llm", p.read_text()), p
