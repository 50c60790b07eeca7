"""Sinks: parquet with manifests, compaction, CSV, workbooks with sheet rollover, whitelisted exports, graph and balance exports."""

from __future__ import annotations

import json
import os
import re
import zipfile
from collections.abc import Iterable, Mapping, Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.cleaning import predicates
from tracewright.runtime import file_system
from tracewright.sources.files import sha256_file

SHEET_ROWS = 1_048_575
#: Ledger columns that are exported as money and as times.
MONEY_COLUMNS, TIME_COLUMNS = ("amount", "balance", "cp_balance", "cp_received_amount"), ("txn_time",)
#: What XML 1.0 can't hold, and text that looks like the escape of such a character.
_UNWRITABLE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


def cell_text(v: object) -> str:
    """A value as the text of a workbook cell; unwritable characters as _x0001_ and so on, which readers of workbooks turn back."""
    return escape(_UNWRITABLE.sub(lambda m: f"_x{ord(m[0]):04X}_", "" if v is None else str(v)))


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), rows_per_file: int | None = None) -> None:
    """SK1, SK6: ZSTD parquet, optionally partitioned and with at most ``rows_per_file`` rows in a file."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def compact(df: DataFrame, keys: Sequence[str], order: Sequence[str], path: str) -> None:
    """SK2: the latest row of each key by ``order``, written beside the target and moved into place.

    The old table is renamed aside, the new one renamed in, and only then the old one deleted: whatever breaks off, one of them is whole.
    A table left aside by an earlier crash is put back first if the target is missing.
    """
    from tracewright.operators.relational import final_view

    fs, target = file_system(df.sparkSession, path)
    at = lambda suffix: file_system(df.sparkSession, path.rstrip("/") + suffix)[1]
    recover(df.sparkSession, path)
    write_parquet(final_view(df, keys, order), path.rstrip("/") + ".new")
    if fs.exists(target) and not fs.rename(target, at(".old")):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(at(".new"), target):
        raise OSError(f"could not move the new table to {path}")
    fs.delete(at(".old"), True)


def recover(spark: SparkSession, path: str) -> None:
    """After a crash of :func:`compact`: the old table back in place if the target is missing, else gone."""
    fs, target = file_system(spark, path)
    old = file_system(spark, path.rstrip("/") + ".old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        elif not fs.rename(old, target):
            raise OSError(f"could not move {old} back")


def write_verified(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """SK6: write and count what was written; OSError if that isn't the number of rows that went in. Returns the number."""
    spark, seen = df.sparkSession, Observation()
    write_parquet(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, partition_by)
    stored = spark.read.parquet(path).count() if seen.get["rows"] else 0
    if stored != seen.get["rows"]:
        raise OSError(f"{seen.get['rows']} rows went to {path}, {stored} are there")
    return stored


def typed_for_export(df: DataFrame) -> DataFrame:
    """Ledger columns as an exported table types them: amounts and balances decimal(20,2), times timestamps, everything else text."""
    def one(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c in MONEY_COLUMNS:
            return x.try_cast("decimal(20,2)").alias(c)
        return (F.try_to_timestamp(x.cast("string")) if c in TIME_COLUMNS else x.cast("string")).alias(c)

    return df.select(*[one(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """SK3, SK9: CSV with a header; one file only for results that are known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_workbook(df: DataFrame, path: str, sheet_rows: int = SHEET_ROWS) -> int:
    """SK4: an .xlsx workbook, streamed partition by partition; a new sheet begins after ``sheet_rows`` rows. Returns the number of sheets."""
    def cells(values: Iterable[object]) -> str:
        return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{cell_text(v)}</t></is></c>' for v in values) + "</row>"

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    ns = "http://schemas.openxmlformats.org"
    names: list[str] = []
    rows = iter(df.toLocalIterator())
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        pending = next(rows, None)
        while pending is not None or not names:
            names.append(f"Sheet{len(names) + 1}")
            with z.open(f"xl/worksheets/sheet{len(names)}.xml", "w", force_zip64=True) as f:
                f.write(f'{head}<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>{cells(df.columns)}'.encode())
                n = 0
                while pending is not None and n < sheet_rows:
                    f.write(cells(pending).encode())
                    n, pending = n + 1, next(rows, None)
                f.write(b"</sheetData></worksheet>")
        sheets = "".join(f'<sheet name="{s}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(names, 1))
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument/2006/relationships"><sheets>{sheets}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Type="{ns}/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{ns}/package/2006/relationships">{rels}</Relationships>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{ns}/package/2006/relationships"><Relationship Id="rId1" Type="{ns}/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{ns}/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')
    return len(names)


#: What may be exported: columns, filters and order of each data set.
EXPORTS: dict[str, dict[str, Sequence[str]]] = {
    "address_activity": {"columns": ["activity_id", "chain_id", "address", "counterparty_address", "direction", "block_time", "tx_hash", "token_symbol", "amount", "usd_value"], "filters": ["chain_id", "address", "direction", "block_time", "token_symbol"], "order": ["block_time", "activity_id", "usd_value"]},
    "price_anchor_1m": {"columns": ["chain_id", "symbol", "quote_symbol", "minute", "open", "high", "low", "close"], "filters": ["chain_id", "symbol", "quote_symbol", "minute"], "order": ["minute", "symbol"]},
}


def export(df: DataFrame, dataset: str, columns: Sequence[str], filters: Mapping[str, object], order: Sequence[tuple[str, bool]], limit: int | None = None) -> DataFrame:
    """SK7, SK10: an export of whitelisted columns, filters and order (name, descending); ValueError for anything else, before anything runs.

    All rows are exported unless the caller asks for a limit; then the column truncated says whether there were more.
    """
    spec = EXPORTS.get(dataset)
    if spec is None:
        raise ValueError(f"unknown data set: {dataset}")
    for what, given, allowed in (("column", columns, spec["columns"]), ("filter", filters, spec["filters"]), ("order", [c for c, _ in order], spec["order"])):
        if bad := sorted(set(given) - set(allowed)):
            raise ValueError(f"{what} not allowed: {', '.join(bad)}")
    if not columns or limit is not None and limit < 1:
        raise ValueError("no columns, or a limit out of range")
    by: list[Column] = [F.col(c).desc() if d else F.col(c).asc() for c, d in order]
    out = df.filter(predicates(filters)) if filters else df
    if limit is None:
        return (out.orderBy(*by) if by else out).select(*columns)
    more = out.agg(F.count(F.lit(1)) > limit).scalar()
    return (out.orderBy(*by) if by else out).limit(limit).select(*columns).withColumn("truncated", more)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, clusters: DataFrame | None = None) -> None:
    """SK8: nodes, edges and, if given, clusters (node, component) as CSV, edges as JSON too."""
    write_csv(nodes, f"{path}/nodes")
    if clusters is not None:
        write_csv(clusters, f"{path}/clusters")
    write_csv(edges, f"{path}/edges")
    write_json(edges.select(F.struct(*edges.columns).alias("edge")), f"{path}/graph")


def write_balances(balances: DataFrame, timeline: DataFrame, path: str) -> None:
    """SK9: balances and their daily timeline as CSV, and a summary by token (holders, total held) as JSON."""
    write_csv(balances, f"{path}/balances")
    write_csv(timeline, f"{path}/timeline")
    write_json(balances.groupBy("chain_id", "token_address").agg(F.count_if(F.col("balance") > 0).alias("holders"), F.sum(F.when(F.col("balance") > 0, F.col("balance"))).alias("held")), f"{path}/assets")


def write_manifest(folder: str, rows: int | None = None) -> dict:
    """SK11: names, bytes and SHA-256 of a local folder's data files, written last and at once (to a new name, then renamed)."""
    files = sorted(os.path.join(d, n) for d, _, names in os.walk(folder) for n in names if not n.startswith((".", "_")) and n != "manifest.json")
    manifest = {"schema_version": 1, "rows": rows, "files": [{"name": os.path.relpath(f, folder), "bytes": os.path.getsize(f), "sha256": sha256_file(f)} for f in files]}
    tmp = os.path.join(folder, ".manifest.json.new")
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(manifest, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(tmp, os.path.join(folder, "manifest.json"))
    return manifest


def verify_manifest(folder: str) -> list[str]:
    """Names of files that are missing or differ from the manifest."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        files = json.load(f)["files"]
    return [x["name"] for x in files if not os.path.exists(p := os.path.join(folder, x["name"])) or sha256_file(p) != x["sha256"]]


def zip_folder(folder: str, path: str) -> int:
    """SK12: the files of a folder as an archive; returns their number."""
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, allowZip64=True) as z:
        for d, _, names in os.walk(folder):
            for name in sorted(names):
                p = os.path.join(d, name)
                if os.path.realpath(p) != os.path.realpath(path):
                    z.write(p, os.path.relpath(p, folder))
                    n += 1
    return n
