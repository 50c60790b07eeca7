"""Problem 7: filters never lose a copy, and groups equal those of plain Python."""

import re
import unicodedata
from collections import defaultdict

import numpy as np
from tracewright.llm import copies as cp

COLS = ["txn_serial", "cp_name", "amount", "remark", "direction"]


def frame(spark, rows):
    full = ["row_id bigint"] + [f"{c} string" for c in cp.BUSINESS] + ["keep string"]
    return spark.createDataFrame([(i, *[dict(zip(COLS, r)).get(c) for c in cp.BUSINESS], "x") for i, r in rows], ", ".join(full))


def groups(df):
    out = defaultdict(set)
    for r in cp.copies(df).collect():
        out[r.keep_row_id].add(r.copy_row_id)
    return dict(out)


def test_spellings(spark):
    rows = [
        (10, ("S-1", "Ab & Co.", "1,000.50", "a=1;b=2", "进")), (11, ("s_1 ", "AB&CO", "￥1000.5元", "b=2； a=1", "进")), (12, ("Ｓ－１", "“Ａｂ & Co”", "+1000.500", "a=1,b=2", "进")),
        (13, ("S-1", "Ab & Co.", "-1000.50", "a=1;b=2", "进")), (14, ("S-1", "Ab & Co.（新）", "1000.50", "a=1;b=2", "进")), (15, ("S-1", "Ab & Co.", "1000.50", "a=1;b=3", "进")),
        (16, ("", "same", "1", None, None)), (17, ("", "same", "1", None, None)), (18, (None, None, None, None, None)), (19, (None, None, None, None, None)), (20, ("　", "same", "1", None, None)),
        (21, ("T", None, None, None, "+")), (22, ("T", "", "", "", "-")), (23, ("T", "", "", "", " + ")), (5, ("t.", None, None, None, "＋")),
    ]
    assert groups(frame(spark, rows)) == {10: {11, 12}, 5: {21, 23}}
    one = {r.row_id: r.copies for r in cp.one_record_each(frame(spark, rows)).collect()}
    assert one == {10: 3, 13: 1, 14: 1, 15: 1, 16: 1, 17: 1, 18: 1, 19: 1, 20: 1, 22: 1, 5: 3}


def test_hot_group_long_text_and_empty(spark):
    rows = [(i, ("HOT", "n" * 50000 if i < 2 else "n", "1", None, None)) for i in range(600)] + [(1000 + i, (f"S{i}", "n", "1", None, None)) for i in range(1000)]
    got = groups(frame(spark, rows).repartition(8))
    assert got == {0: {1}, 2: set(range(3, 600))}
    assert groups(frame(spark, [])) == {}


def plain(text):
    s = unicodedata.normalize("NFKC", text or "").lower()
    return "".join(c for c in s if not (c.isspace() or unicodedata.category(c)[0] == "P" or unicodedata.category(c) == "Cf" or c in "$+<=>^`|~"))


def test_against_plain_python_on_test_tables(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/ledger.parquet")
    want = defaultdict(list)
    for r in df.collect():
        if plain(r.txn_serial):
            amount = re.sub(r"[\s,¥元]", "", unicodedata.normalize("NFKC", r.amount or ""))
            try:
                amount = float(amount)
            except ValueError:
                amount = plain(amount)
            remark = frozenset(plain(e) for e in re.split(r"[;,|、/\n]+", unicodedata.normalize("NFKC", r.remark or "")) if plain(e))
            want[tuple(plain(r[c]) for c in cp.BUSINESS if c not in ("amount", "remark")) + (amount, remark)].append(r.row_id)
    assert groups(df) == {min(v): set(v) - {min(v)} for v in want.values() if len(v) > 1}


def written(df, path):
    df.sortWithinPartitions("h").write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_filter_has_no_false_negatives_whatever_its_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(cp, "MIN_BITS", 1 << 10)
    monkeypatch.setattr(cp, "BITS_PER_RECORD", 2)
    monkeypatch.setattr(cp, "SEGMENT_BITS", 1 << 9)
    monkeypatch.setattr(cp, "ROUND_BITS", 1 << 10)
    rng = np.random.default_rng(3)
    values = rng.integers(-(2**63), 2**63 - 1, 900)
    data = [(int(i), int(v), b"x") for i, v in enumerate(np.concatenate([values, values[:100], values[:10]]))] + [(5000, None, None), (5001, -(2**63), b"y"), (5002, -(2**63), b"y"), (5003, 2**63 - 1, b"z"), (5004, 2**63 - 1, b"z")]
    df = written(spark.createDataFrame(data, "row_id bigint, h bigint, x binary").repartition(37), tmp_path / "h")
    assert cp.rounds_for(1014) == (2, 1 << 10)
    kept = {r.row_id for r in cp.tested(df).collect()}
    copied = set(range(100)) | set(range(900, 1010)) | {5001, 5002, 5003, 5004}
    assert copied <= kept and len(kept) < 1000
    both = {r.row_id: r.h for r in cp.tested(df, rest=True).collect()}
    assert set(both) == {i for i, _, _ in data} and {i for i, h in both.items() if h is not None} == kept


def test_rounds_keep_the_filter_as_full_as_intended():
    for n in (1, 4_000, 10**7, 10**8, 10**9, 10**11):
        rounds, bits = cp.rounds_for(n)
        assert bits <= cp.ROUND_BITS and n * cp.BITS_PER_RECORD <= rounds * bits and (bits == cp.MIN_BITS or rounds * bits < 2 * n * cp.BITS_PER_RECORD)


def test_merge_marks_what_two_parts_share():
    a, b = np.array([0b0011], np.uint8), np.array([0b0110], np.uint8)
    once, more = cp.merge_pair(a, np.array([0b0001], np.uint8), b, np.array([0], np.uint8))
    assert once[0] == 0b0111 and more[0] == 0b0011
