"""Records whose shape drifts between files (problem 1): tagged-union inference over the fields of JSON records.

A record's fields are (path, type tag, value). Shapes come first: the types of a path are fused per file and kept as alternatives while the
records stream through, so only (file, path, type) travels. Changes between a file and the one before it are found by grouping shapes on
(workspace, file step, path). Values are fetched in a second pass, and only of paths that may have been renamed; they are compared by
order-free fingerprints. A path that holds several types becomes typed branches plus one canonical text.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracewright.runtime import discard, materialize, same_keys, skew_safe_lookup, written

TAGS = ("string", "number", "boolean", "array")


def _tagged(value: object) -> tuple[str, str]:
    if isinstance(value, bool):
        return "boolean", "true" if value else "false"
    if isinstance(value, (int, float)):
        return "number", repr(int(value)) if value == value and abs(value) < 1e15 and value == int(value) else repr(value)
    if isinstance(value, str):
        return "string", value
    return "array", json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def element_tags(text: str) -> str:
    """The types of an array's elements, sorted and joined by ``|``; objects and nulls count as such."""
    kind = lambda v: "object" if isinstance(v, dict) else "null" if v is None else _tagged(v)[0]
    return "|".join(sorted({kind(v) for v in json.loads(text)}))


def flatten_record(text: str | None) -> list[tuple[str, str, str]] | None:
    """(dotted path, tag, canonical text) of every non-null value that is no object; None if ``text`` is no JSON object."""
    try:
        top = json.loads(text)
    except (TypeError, ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out, todo = [], [("", top)]
    while todo:
        at, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{at}.{k}" if at else k, v) for k, v in value.items()]
        elif value is not None:
            out.append((at, *_tagged(value)))
    return out


def _steps(records: DataFrame) -> DataFrame:
    """The files of each workspace in the order they were saved (first delivery counts; ties by name), numbered from 1."""
    files = records.groupBy("workspace", "file_name").agg(F.min("saved_at").alias("saved_at"))
    return files.withColumn("step", F.row_number().over(Window.partitionBy("workspace").orderBy("saved_at", "file_name"))).drop("saved_at")


def shapes(records: DataFrame, text: str = "rule_json") -> DataFrame:
    """(workspace, file_name, path, tag, elements): the types of each path in each file, arrays with the types of their elements.

    Each batch of records gives a shape once; equal shapes of several batches are left to the groupings that follow.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: set[tuple] = set()
            for w, f, t in b.itertuples(index=False, name=None):
                for path, tag, value in flatten_record(t) or ():
                    seen.add((w, f, path, tag, element_tags(value) if tag == "array" else None))
            yield pd.DataFrame(list(seen), columns=["workspace", "file_name", "path", "tag", "elements"], dtype=object)

    return records.select("workspace", "file_name", text).mapInPandas(run, "workspace string, file_name string, path string, tag string, elements string")


def stepped_shapes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with their step, shapes with it), both written once; shapes are distinct."""
    steps = materialize(_steps(records), "steps")
    rows = skew_safe_lookup(shapes(records), steps, ["workspace", "file_name"], ["step"])
    return steps, materialize(rows.groupBy("workspace", "step", "path", "tag", "elements").agg(F.lit(1).alias("one")).drop("one"), "shapes")


def wanted_values(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """(workspace, t, gone, rule_no, path, digest) of the wanted paths of a file's records, and a row with null path for each record.

    ``wanted`` has one row per file: paths, the JSON list of its (t, gone, path). A value and its type become 16 bytes.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsed: dict[str, dict] = {}
        for b in batches:
            rows = []
            for w, no, paths, text in b.itertuples(index=False, name=None):
                by_path = parsed.get(paths)
                if by_path is None:
                    if len(parsed) > 1000:
                        parsed.clear()
                    by_path = parsed[paths] = {}
                    for x in json.loads(paths):
                        by_path.setdefault(x["path"], []).append((x["t"], x["gone"]))
                        by_path.setdefault(None, {})[x["t"], x["gone"]] = True
                rows += [(w, t, gone, no, None, None) for t, gone in by_path[None]]
                for path, tag, value in flatten_record(text) or ():
                    for t, gone in by_path.get(path, ()):
                        rows.append((w, t, gone, no, path, hashlib.blake2b(f"{tag}\0{value}".encode("utf-8", "surrogatepass"), digest_size=16).digest()))
            out = pd.DataFrame(rows, columns=["workspace", "t", "gone", "rule_no", "path", "digest"])
            out["rule_no"] = out["rule_no"].astype("Int32")
            yield out

    rows = skew_safe_lookup(records.select("workspace", "file_name", "rule_no", "rule_json"), wanted, ["workspace", "file_name"], ["paths"]).filter(F.col("paths").isNotNull())
    return rows.select("workspace", "rule_no", "paths", "rule_json").mapInPandas(run, "workspace string, t int, gone boolean, rule_no int, path string, digest binary")


def changes(records: DataFrame, steps: DataFrame, typed: DataFrame) -> DataFrame:
    """Changes of every file against the one saved before it: workspace, step, file_name, change, old_field, new_field, old_tags, new_tags.

    ``steps`` and ``typed`` come from :func:`stepped_shapes`. A path that has several types in a file keeps them all; it is retyped if the
    sets differ, and a rename needs equal sets. A rename is a pair of a removed and an added path whose values or absences agree for every
    rule in both files; paths that agree with each other form a class, which gives all its pairs of a removed and an added path.
    """
    keys = ["workspace", "step", "path"]
    fused = typed.groupBy(*keys).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    # A path of step s is on the old side of transition s + 1 and on the new side of transition s.
    sides = fused.select("workspace", "path", "tags", F.inline(F.array(F.struct((F.col("step") + 1).alias("t"), F.lit(True).alias("old")), F.struct(F.col("step").alias("t"), F.lit(False).alias("old")))))
    both = sides.groupBy("workspace", "t", "path").agg(F.max(F.when(F.col("old"), F.col("tags"))).alias("old_tags"), F.max(F.when(~F.col("old"), F.col("tags"))).alias("new_tags"))
    differ = both.filter(~F.col("old_tags").eqNullSafe(F.col("new_tags")) & (F.col("t") > 1))
    files = steps.withColumnRenamed("step", "t").alias("f")
    moved = materialize(differ.alias("d").join(files, same_keys("d", "f", "workspace", "t")).select("d.*", "f.file_name"), "moved")
    # Only a transition that loses and gains paths of the same types can hold a rename.
    lone = moved.filter(F.col("new_tags").isNull() | F.col("old_tags").isNull()).select("workspace", "t", "path", F.col("new_tags").isNull().alias("gone"), F.coalesce("old_tags", "new_tags").alias("tags"))
    swaps = lone.groupBy("workspace", "t", "tags").agg(F.max("gone").alias("some"), F.min("gone").alias("all")).filter(F.col("some") & ~F.col("all"))
    lone = lone.alias("l").join(swaps.alias("s"), same_keys("l", "s", "workspace", "t", "tags"), "left_semi")
    per_file = lone.withColumn("step", F.when(F.col("gone"), F.col("t") - 1).otherwise(F.col("t"))).groupBy("workspace", "step").agg(F.to_json(F.array_sort(F.collect_list(F.struct("t", "gone", "path")))).alias("paths"))
    wanted = materialize(per_file.alias("p").join(steps.alias("s"), same_keys("p", "s", "workspace", "step")).select("s.workspace", "s.file_name", "p.paths"), "wanted")
    # A rule counts if both files have it; equal deliveries of a rule are one.
    held = F.collect_set(F.when(F.col("path").isNotNull(), F.struct("gone", "path", "digest")))
    rules = wanted_values(records, wanted).groupBy("workspace", "t", "rule_no").agg(F.max("gone").alias("was"), F.min("gone").alias("only"), held.alias("held")).filter(F.col("was") & ~F.col("only"))
    values = rules.select("workspace", "t", "rule_no", F.inline("held"))
    mark = lambda seed: F.sum(F.shiftright(F.xxhash64("rule_no", "digest", F.lit(seed)), 20))  # noqa: E731  44 bits each, so that sums don't overflow
    prints = values.groupBy("workspace", "t", "path", "gone").agg(F.count(F.lit(1)).alias("n"), mark(1).alias("f1"), mark(2).alias("f2"), mark(3).alias("f3"))
    tagged = prints.alias("p").join(lone.alias("l"), same_keys("p", "l", "workspace", "t", "path", "gone")).select("p.*", "l.tags")
    classes = tagged.groupBy("workspace", "t", "tags", "n", "f1", "f2", "f3").agg(F.collect_list(F.when(F.col("gone"), F.col("path"))).alias("olds"), F.collect_list(F.when(~F.col("gone"), F.col("path"))).alias("news"))
    same = materialize(classes.filter((F.size("olds") > 0) & (F.size("news") > 0)).select("workspace", "t", "tags", "olds", "news"), "classes")
    ends = same.select("workspace", "t", F.explode(F.concat("olds", "news")).alias("path"))
    rest = moved.alias("m").join(ends.alias("e"), same_keys("m", "e", "workspace", "t", "path"), "left_anti")
    fell, came = F.col("new_tags").isNull(), F.col("old_tags").isNull()
    plain = rest.select(
        "workspace", "t", "file_name", F.when(fell, "removed").when(came, "added").otherwise("retyped").alias("change"),
        F.when(came, "").otherwise(F.col("path")).alias("old_field"), F.when(fell, "").otherwise(F.col("path")).alias("new_field"), "old_tags", "new_tags",
    )
    pairs = same.select("workspace", "t", "tags", F.explode("olds").alias("old_field"), "news").select("workspace", "t", "tags", "old_field", F.explode("news").alias("new_field"))
    renamed = pairs.alias("r").join(files, same_keys("r", "f", "workspace", "t")).select("r.workspace", "r.t", "f.file_name", F.lit("renamed").alias("change"), "old_field", "new_field", F.col("tags").alias("old_tags"), F.col("tags").alias("new_tags"))
    return plain.unionByName(renamed).withColumnRenamed("t", "step")


def schema_changes(records: DataFrame) -> DataFrame:
    """Shapes, then changes; see :func:`changes`. An empty table gives no rows."""
    return changes(records, *stepped_shapes(records))


def union_types(records: DataFrame) -> DataFrame:
    """The tagged union of each path over all files: path, tag (its alternatives), the types of array elements, the files that hold it,
    first and last step, and the number of alternatives of the path. An alternative appears in the file of its first step."""
    typed = stepped_shapes(records)[1]
    # The texts of element types are few: subsets of six kinds.
    per = typed.groupBy("path", "tag", "workspace", "step").agg(F.collect_set("elements").alias("e"))
    g = per.groupBy("path", "tag").agg(F.count(F.lit(1)).alias("files"), F.min("step").alias("first_step"), F.max("step").alias("last_step"), F.array_distinct(F.flatten(F.collect_set("e"))).alias("e"))
    kinds = g.groupBy("path").agg(F.count(F.lit(1)).alias("alternatives"))
    elements = F.array_sort(F.array_distinct(F.filter(F.split(F.array_join("e", "|"), r"\|"), lambda x: x != "")))
    return g.join(kinds, "path").select("path", "tag", F.array_join(elements, "|").alias("elements"), "files", "first_step", "last_step", "alternatives")


#: Canonical fields of the consistent rule table and the paths that have carried them, preferred first.
CANONICAL = {
    "signature": ("signature", "header_signature", "headerSig", "sig"),
    "source_columns": ("source_columns", "srcColumns", "columns", "header.columns"),
    "amount_column": ("mapping.amount_column", "mapping.amount_col", "mapping.amountColumn", "mapping.amount.field", "amount_column"),
}


def canonical_names(change_rows: DataFrame) -> DataFrame:
    """Which path a field was first known by: (workspace, step, path, name) for every path that came by renaming.

    Renames are followed backwards one step at a time with joins over the renames alone; a field is renamed at most as often as its
    workspace has files, and the loop ends when no chain grows.
    """
    renames = materialize(change_rows.filter("change = 'renamed'").select("workspace", "step", "old_field", "new_field"), "names")
    # A field keeps a name until the step at which it is renamed again; chains link (new_field, step) to the latest earlier rename onto old_field.
    chains, last = renames.select("workspace", "step", F.col("new_field").alias("path"), F.col("old_field").alias("name"), F.col("step").alias("upto")), None
    while True:
        c, r = chains.alias("c"), renames.alias("r")
        linked = c.join(r, F.col("c.workspace").eqNullSafe(F.col("r.workspace")) & (F.col("c.name") == F.col("r.new_field")) & (F.col("r.step") < F.col("c.upto")), "left")
        grown = linked.groupBy("c.workspace", "c.step", "c.path").agg(F.max(F.struct("r.step", "r.old_field")).alias("b"), F.first("c.name").alias("name"), F.first("c.upto").alias("upto"))
        grown, at = written(grown.select("workspace", "step", "path", F.coalesce("b.old_field", "name").alias("name"), F.coalesce("b.step", "upto").alias("upto"), F.col("b.step").isNotNull().alias("more")), "chain")
        discard(renames.sparkSession, last)
        last = at
        if not grown.filter("more").limit(1).count():
            return grown.select("workspace", "step", "path", "name")
        chains = grown.drop("more")


def record_fields(records: DataFrame) -> DataFrame:
    """(workspace, file_name, rule_no, fields) of every record: the fields as (path, tag, value), empty for what is no JSON object."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [sorted(flatten_record(t) or ()) for t in b["rule_json"]]
            out = b[["workspace", "file_name", "rule_no"]].copy()
            out["rule_no"] = out["rule_no"].astype("Int32")
            for i, c in enumerate(("path", "tag", "value")):
                out[c] = [[x[i] for x in fields] for fields in got]
            yield out

    schema = "workspace string, file_name string, rule_no int, path array<string>, tag array<string>, value array<string>"
    rows = records.select("workspace", "file_name", "rule_no", "rule_json").mapInPandas(run, schema)
    return rows.select("workspace", "file_name", "rule_no", F.arrays_zip("path", "tag", "value").alias("fields"))


def typed_branches(fields: Column) -> Column:
    """Fields (field, path, tag, value) with a branch for each type, the others null, beside the canonical text."""
    branch = lambda x, tag, c: F.when(x.tag == tag, c)
    return F.transform(fields, lambda x: F.struct(
        x.field.alias("field"), x.path.alias("path"), x.tag.alias("tag"), x.value.alias("value"), branch(x, "string", x.value).alias("as_string"), branch(x, "number", x.value.try_cast("double")).alias("as_number"),
        branch(x, "boolean", x.value == "true").alias("as_boolean"), branch(x, "array", F.from_json(x.value, "array<string>")).alias("as_array"),
    ))


def consistent_table(records: DataFrame) -> DataFrame:
    """All rules in one shape, whatever file they came from: one row per workspace, file and rule with typed branches per field.

    A path that came by renaming counts as the path it was first known by; if that is no path of CANONICAL, the path itself counts, so a
    field that was away for a file, or was renamed and retyped at once, is found again. Of several the preferred one is taken. signature and
    amount_column are text; source_columns is an array of text (a bare text becomes one element); ``*_type`` is the type they had.
    ``branches`` lists every field with its type, canonical text and typed branch, ``unresolved`` the canonical fields that the rule has
    under no known path. Records that are no JSON objects have null fields and no branches. Equal deliveries of a rule are one.
    """
    steps, typed = stepped_shapes(records)
    names = canonical_names(changes(records, steps, typed))
    # Per file the names of its renamed paths: a map of at most as many entries as the file has paths.
    paths = typed.select("workspace", "step", "path").distinct().alias("v")
    named = paths.join(names.alias("n"), F.col("v.workspace").eqNullSafe(F.col("n.workspace")) & (F.col("v.path") == F.col("n.path")) & (F.col("n.step") <= F.col("v.step")))
    latest = named.groupBy("v.workspace", "v.step", "v.path").agg(F.max(F.struct("n.step", "n.name")).alias("b"))
    maps = latest.groupBy("workspace", "step").agg(F.map_from_entries(F.collect_list(F.struct("path", "b.name"))).alias("names"))
    files = materialize(steps.alias("s").join(maps.alias("m"), same_keys("s", "m", "workspace", "step"), "left").select("s.*", "m.names"), "files")
    rules = record_fields(records).groupBy("workspace", "file_name", "rule_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("fields")))).alias("fields"))
    known = skew_safe_lookup(rules, files, ["workspace", "file_name"], ["step", "names"])
    fields = F.transform("fields", lambda x: F.struct(F.coalesce(F.col("names")[x.path], x.path).alias("field"), x.path.alias("path"), x.tag.alias("tag"), x.value.alias("value")))
    known = known.select("workspace", "step", "file_name", "rule_no", fields.alias("fields"))

    def of(name: str) -> Column:
        listed = F.array(*[F.lit(p) for p in CANONICAL[name]])
        rank = lambda x: F.coalesce(F.nullif(F.array_position(listed, x.field), F.lit(0)), F.nullif(F.array_position(listed, x.path), F.lit(0)))
        return F.array_max(F.transform(F.filter("fields", lambda x: rank(x).isNotNull()), lambda x: F.struct((-rank(x)).alias("rank"), x.tag.alias("tag"), x.value.alias("value"))))

    found = known.select("*", F.inline(F.array(F.struct(*[of(n).alias(f"__{n}") for n in CANONICAL]))))
    c = lambda name, part: F.col(f"__{name}.{part}")
    return found.select(
        "workspace", "step", "file_name", "rule_no", c("signature", "value").alias("signature"), c("signature", "tag").alias("signature_type"),
        F.when(c("source_columns", "tag") == "array", F.from_json(c("source_columns", "value"), "array<string>")).when(F.col("__source_columns").isNotNull(), F.array(c("source_columns", "value"))).alias("source_columns"), c("source_columns", "tag").alias("source_columns_type"),
        c("amount_column", "value").alias("amount_column"), c("amount_column", "tag").alias("amount_column_type"), typed_branches(F.col("fields")).alias("branches"),
        F.array_compact(F.array(*[F.when(F.col(f"__{n}").isNull(), F.lit(n)) for n in CANONICAL])).alias("unresolved"),
    )
