"""Problem 6: the strict load and the full reader must agree, and reasons come in order."""

import random

from tracewright.operators import rejects as rj

GOOD = ["2024-01-02 03:04:05", "1,234.50", "进", "A1", "name", "sum", "S1", "5"]


def line(*change, sep=","):
    f = GOOD[:]
    for i, v in change:
        f[i] = v
    return sep.join(f'"{x}"' if sep in x else x for x in f)


CASES = [
    (line(), ",", None), (line(sep="\t"), "\t", None), (line(sep="||"), "||", None), (line((4, 'a""b')).replace('a""b', '"a""b"'), ",", None), (line((4, '"two\nlines, here"')).replace('""', '"'), ",", None),
    (line((0, "2024/1/2 3:04")), ",", None), (line((0, "20240102030405")), ",", None), (line((0, "2024年1月2日 3时4分5秒")), ",", None), (line((1, " -￥5元 ")), ",", None), (line((2, " D　")), ",", None),
    (line((4, 'a"b')), ",", "broken_quoting"), (line((4, '"ab')), ",", "broken_quoting"), (line((4, '"a"b')), ",", "broken_quoting"), ("a,\"b", ",", "broken_quoting"), (line((4, ' "a"')), ",", "broken_quoting"),
    ("a,b", ",", "column_count"), (line() + ",", ",", "column_count"), ("", ",", "column_count"), (None, ",", "column_count"), ("x", None, "column_count"), ("x", "", "column_count"),
    (line((0, "2024-02-30 00:00:00")), ",", "bad_time"), (line((0, "2024-01-02")), ",", "bad_time"), (line((0, "2024-01-02 24:00:00")), ",", "bad_time"), (line((0, "")), ",", "bad_time"), (line((0, "2024/01/02 03:4")), ",", "bad_time"),
    (line((1, "1,23.5")), ",", "bad_amount"), (line((1, "")), ",", "bad_amount"), (line((1, "1e5")), ",", "bad_amount"), (line((1, "￥")), ",", "bad_amount"), (line((1, "5.")), ",", "bad_amount"), (line((1, "x"), (2, "x")), ",", "bad_amount"),
    (line((2, "借/贷")), ",", "bad_direction"), (line((2, "")), ",", "bad_direction"), (line((4, "长" * 70000)), ",", None), (line((4, '"' + '""' * 5000 + '"')), ",", None), (line((4, '"' + '""' * 5000)), ",", "broken_quoting"), (line((4, "\x01")), ",", None),
]


def load(spark, cases):
    df = spark.createDataFrame([(i, "f", i, s, t, "extra") for i, (t, s, *_) in enumerate(cases)], "line_id bigint, src_file string, src_row bigint, sep string, raw_line string, reason string")
    valid, bad = rj.load_with_rejects(df)
    return {r.line_id: r for r in valid.collect()}, {r.line_id: r.reason for r in bad.collect()}


def test_reasons(spark):
    valid, bad = load(spark, CASES)
    assert {i: bad.get(i) for i in range(len(CASES))} == {i: c[2] for i, c in enumerate(CASES)}
    assert set(valid) == {i for i, c in enumerate(CASES) if c[2] is None}
    assert valid[0].amount == "1,234.50" and valid[0].balance == "5" and valid[3].cp_name == 'a"b' and valid[4].cp_name == "two\nlines, here" and valid[8].amount == "-￥5元" and valid[9].direction == "D"


def test_strict_load_never_contradicts_the_reader(spark):
    rng = random.Random(5)
    cases = []
    for _ in range(1500):
        t = line((0, rng.choice(["2024-01-02 03:04:05", "2024/1/2 3:04", "x"])), (4, rng.choice(["n", '"q,r"', '"q""r"', '"', 'a"']))).replace('"""', '"')
        t = list(t)
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice('",\n x0')
        cases.append(("".join(t), ","))
    valid, bad = load(spark, cases)
    for i, (t, s) in enumerate(cases):
        reason, fields = rj.diagnose(t, s)
        assert bad.get(i) == reason and (i in valid) == (reason is None), t
        if reason is None:
            assert [valid[i][c] for c in rj.FIELDS] == fields


def test_values_do_not_depend_on_the_path_they_take(spark, monkeypatch):
    outer = "\u00a0\u3000\u2003\x85 "
    texts = [(line((4, f"{outer}name{outer}"), (1, f"{outer}5{outer}"), (0, f"{outer}2024/1/2 3:04\u2009")), ","), (line((4, f'"{outer}q""r{outer}"')).replace('"""', '"'), ","), (line((4, "\x1cname\x1c")), ",")]
    short, _ = load(spark, texts)
    monkeypatch.setattr(rj, "STRICT_CHARS", 0)  # everything goes through the full reader
    long, _ = load(spark, texts)
    assert set(short) == set(long) == {0, 1, 2}
    assert {i: [short[i][c] for c in rj.FIELDS] for i in short} == {i: [long[i][c] for c in rj.FIELDS] for i in long}
    assert short[0].cp_name == "name" and short[1].cp_name == 'q"r' and short[2].cp_name == "\x1cname\x1c"
    wide = line((4, f"{outer}{'n' * 70_000}{outer}"))
    monkeypatch.undo()
    assert load(spark, [(wide, ",")])[0][0].cp_name == "n" * 70_000


def test_empty(spark):
    assert load(spark, []) == ({}, {})
