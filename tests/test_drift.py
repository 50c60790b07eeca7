"""Problem 1: changes between files, against a direct comparison."""

import json
from datetime import datetime, timedelta

from tracewright.operators import drift

SCHEMA = "record_id bigint, workspace string, provider string, file_name string, saved_at timestamp, rule_no int, rule_json string"
T = datetime(2024, 1, 1)


def records(spark, files, repeat=1):
    rows, n = [], 0
    for k, (ws, name, rules) in enumerate(files):
        for no, rule in rules.items():
            for _ in range(repeat):
                n += 1
                rows.append((n, ws, "p", name, T + timedelta(days=k), no, rule if rule is None or isinstance(rule, str) else json.dumps(rule)))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return sorted((r.file_name, r.change, r.old_field, r.new_field) for r in drift.schema_changes(df).collect())


def test_all_kinds(spark):
    files = [
        ("w", "a", {1: {"sig": "x", "m": {"amount": "A"}, "t": 1, "gone": "q"}, 2: {"sig": "y", "m": {"amount": "B"}, "t": 2}}),
        ("w", "b", {1: {"sig": "x", "amount_col": "A", "t": "1", "new": True}, 2: {"sig": "y", "amount_col": "B", "t": "2"}}),
        ("v", "c", {1: {"only": 1}}),
    ]
    want = [("b", "added", "", "new"), ("b", "removed", "gone", ""), ("b", "renamed", "m.amount", "amount_col"), ("b", "retyped", "t", "t")]
    assert found(records(spark, files)) == want
    assert found(records(spark, files, repeat=3)) == want


def test_renames_need_agreement_over_common_rules(spark):
    # Rule 3 is new and rule 4 gone, so only rules 1 and 2 count; an absence must agree as well.
    ok = [("w", "a", {1: {"x": "p"}, 2: {"k": 1}, 4: {"x": "z"}}), ("w", "b", {1: {"y": "p"}, 2: {"k": 1}, 3: {"y": "other"}})]
    assert found(records(spark, ok)) == [("b", "renamed", "x", "y")]
    other = [("w", "a", {1: {"x": "p"}, 2: {"k": 1}}), ("w", "b", {1: {"y": "p"}, 2: {"k": 1, "y": "q"}})]
    assert found(records(spark, other)) == [("b", "added", "", "y"), ("b", "removed", "x", "")]
    kind = [("w", "a", {1: {"x": "1"}}), ("w", "b", {1: {"y": 1}})]
    assert found(records(spark, kind)) == [("b", "added", "", "y"), ("b", "removed", "x", "")]
    none_common = [("w", "a", {1: {"x": "p"}}), ("w", "b", {2: {"y": "p"}})]
    assert found(records(spark, none_common)) == [("b", "added", "", "y"), ("b", "removed", "x", "")]


def test_equal_columns_give_all_their_pairs(spark):
    files = [("w", "a", {1: {"a1": "x", "a2": "x", "a3": "x", "z": 1}}), ("w", "b", {1: {"b1": "x", "b2": "x", "z": 1}})]
    assert found(records(spark, files)) == sorted(("b", "renamed", f"a{i}", f"b{j}") for i in (1, 2, 3) for j in (1, 2))


def test_types_of_elements_and_typed_branches(spark):
    files = [("w", "a", {1: {"x": [1, 2], "y": "s"}}), ("w", "b", {1: {"x": ["1", None], "y": 1.5, "z": True}})]
    df = records(spark, files, repeat=2)
    got = {(r.path, r.tag): (r.elements, r.files, r.first_step, r.last_step, r.alternatives) for r in drift.union_types(df).collect()}
    assert got == {("x", "array"): ("null|number|string", 2, 1, 2, 1), ("y", "string"): ("", 1, 1, 1, 2), ("y", "number"): ("", 1, 2, 2, 2), ("z", "boolean"): ("", 1, 2, 2, 1)}
    assert found(df) == [("b", "added", "", "z"), ("b", "retyped", "y", "y")]  # an array stays an array
    b = {(r.file_name, x.path): x for r in drift.consistent_table(df).collect() for x in r.branches}
    assert len(b) == 5 and b["a", "x"].as_array == ["1", "2"] and b["b", "x"].as_array == ["1", None] and b["b", "y"].as_number == 1.5 and b["a", "y"].as_string == "s" and b["b", "z"].as_boolean is True
    assert b["b", "y"].as_string is None and b["a", "x"].as_string is None


def test_bad_records_and_nulls(spark):
    files = [("w", "a", {1: "no json", 2: None, 3: {"x": None, "e": {}}, 4: "[1]"}), (None, "n", {None: {"x": 1}}), (None, "o", {None: {"x": "1"}})]
    assert found(records(spark, files)) == [("o", "retyped", "x", "x")]
    assert found(records(spark, [])) == []


def test_consistent_table_follows_renames(spark):
    files = [("w", "a", {1: {"signature": "s", "source_columns": ["a"], "mapping": {"amount_column": "A"}}}), ("w", "b", {1: {"signature": "s", "source_columns": "a", "amt": "A"}}), ("w", "c", {1: {"signature": "s", "amount": "A"}}), ("w", "d", {1: {"signature": "s", "amount": "Z"}})]
    got = {r.file_name: r for r in drift.consistent_table(records(spark, files)).collect()}
    assert [got[f].amount_column for f in "abcd"] == ["A", "A", "A", "Z"]
    assert got["a"].source_columns == ["a"] and got["b"].source_columns == ["a"] and got["c"].source_columns is None


def test_consistent_table_finds_fields_again_after_a_gap(spark):
    files = [
        ("w", "a", {1: {"signature": "s", "source_columns": ["a"], "mapping": {"amount_column": "A"}}}),
        ("w", "b", {1: {"headerSig": ["s"], "note": "n"}}),  # renamed and retyped at once; the others are away
        ("w", "c", {1: {"sig": "s", "columns": "a", "mapping": {"amount_col": "A"}}}),
        ("w", "d", {1: {"sig": "s", "columns": "a", "mapping": {"amount": {"field": "A"}}}, 2: {"mapping": {"amount_col": "B", "amount_column": "A"}}, 3: "no json"}),
        ("v", "e", {1: {"sig": "s", "columns": ["a"], "amount_column": "A"}}),
        ("v", "f", {1: {"signature": "s", "columns": ["a"], "mapping": {"amountColumn": "A"}}}),
    ]
    got = {(r.file_name, r.rule_no): r for r in drift.consistent_table(records(spark, files)).collect()}
    assert len(got) == 8
    for f in "acdef":
        assert (got[f, 1].signature, got[f, 1].source_columns, got[f, 1].amount_column, got[f, 1].unresolved) == ("s", ["a"], "A", []), f
    assert got["b", 1].signature == '["s"]' and got["b", 1].unresolved == ["source_columns", "amount_column"]
    assert got["d", 2].amount_column == "A" and got["d", 2].unresolved == ["signature", "source_columns"]
    assert got["d", 3].unresolved == ["signature", "source_columns", "amount_column"]


def brute(rows):
    """Changes by direct comparison of neighbouring files, in plain Python."""
    from collections import defaultdict

    files, saved = defaultdict(dict), {}
    for r in rows:
        files[r.workspace, r.file_name][r.rule_no] = {p: (t, v) for p, t, v in drift.flatten_record(r.rule_json) or []}
        key = (r.workspace, r.file_name)
        saved[key] = min(r.saved_at, saved.get(key, r.saved_at))
    order = defaultdict(list)
    for (w, f), t in saved.items():
        order[w].append((t, f))
    out = set()
    for w, fs in order.items():
        fs.sort()
        for (_, a), (_, b) in zip(fs, fs[1:]):
            old, new = files[w, a], files[w, b]
            kinds = []
            for side in (old, new):
                k = defaultdict(set)
                for fields in side.values():
                    for p, (t, _) in fields.items():
                        k[p].add(t)
                kinds.append(k)
            ta, tb = kinds
            gone, came, both = [p for p in ta if p not in tb], [p for p in tb if p not in ta], [n for n in old if n in new]
            moved = {(p, q) for p in gone for q in came if ta[p] == tb[q] and any(p in old[n] for n in both) and all(old[n].get(p) == new[n].get(q) for n in both)}
            out |= {(b, "renamed", p, q) for p, q in moved} | {(b, "removed", p, "") for p in gone if p not in {x for x, _ in moved}} | {(b, "added", "", q) for q in came if q not in {y for _, y in moved}}
            out |= {(b, "retyped", p, p) for p in ta if p in tb and ta[p] != tb[p]}
    return out


def test_against_brute_force_on_test_table(spark, small_dir):
    df = spark.read.parquet(f"{small_dir}/custom_rules.parquet")
    assert set(found(df)) == brute(df.collect())
