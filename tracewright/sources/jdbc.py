"""SC11, SC12, SK5: database tables. Statements are checked to be single SELECTs before they are sent; writes go through a staging table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.cleaning import predicates, row_hash
from tracewright.operators.ledger import map_by_headers
from tracewright.operators.relational import offset_page

_WRITES = re.compile(r"\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|copy|replace)\b", re.I)


def read_only(sql: str) -> str:
    """The statement if it is one SELECT (or WITH) that writes nothing; ValueError else."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S).strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'", "''", text)
    if ";" in bare or not re.match(r"(select|with)\b", bare, re.I) or _WRITES.search(bare):
        raise ValueError("only a single SELECT may be run")
    return text


def read_query(spark: SparkSession, url: str, sql: str, options: Mapping[str, str] | None = None) -> DataFrame:
    return spark.read.format("jdbc").option("url", url).option("query", read_only(sql)).options(**(options or {})).load()


def browse(spark: SparkSession, url: str, table: str, search: str | None = None, filters: Mapping[str, object] | None = None, order: Sequence[str] = (), page: int = 1, size: int = 100, options: Mapping[str, str] | None = None) -> DataFrame:
    """SC11: one page of a table with the total: rows that hold ``search`` in any text column (case ignored) and meet ``filters``.

    Filters are Spark predicates, which Spark sends to the database where it can. Without ``order`` all columns order the pages.
    """
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("page or size out of range")
    df = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**(options or {})).load()
    if filters:
        df = df.filter(predicates(filters))
    if search:
        texts = [f.name for f in df.schema if f.dataType.typeName() in ("string", "varchar", "char")]
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(f"`{c}`")), F.lit(search.lower())), F.lit(False))
        df = df.filter(hit)
    return offset_page(df, [F.col(f"`{c}`") for c in order or df.columns], (page - 1) * size, size)


def read_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int, options: Mapping[str, str] | None = None) -> DataFrame:
    """A table in ``parts`` parallel ranges of a numeric key."""
    return spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts).options(**(options or {})).load()


def import_rows(rows: DataFrame, mapping: Mapping[str, str], data_source: str, row_id: str) -> tuple[DataFrame, DataFrame]:
    """SC12, P35: (ledger rows, rejected rows with error_field and error_value) of a source table by a mapping of its columns.

    A row needs a time, an amount that is a number and a direction that is known; the first field at fault is named. Every row is in one of the two.
    """
    back = {target: source for source, target in mapping.items()}
    text = rows.select(F.col(f"`{row_id}`").alias("__row"), *[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])
    raw = lambda t: F.coalesce(F.trim(F.col(f"`{back[t]}`")), F.lit("")) if t in back else F.lit("")
    mapped = map_by_headers(text.withColumns({f"__{t}": raw(t) for t in ("txn_time", "amount", "direction")}), dict(mapping), data_source, ["__row", "__txn_time", "__amount", "__direction"])
    number = F.regexp_replace("__amount", "[,，￥¥元 ]", "").try_cast("double")
    fault = F.when(F.col("__txn_time") == "", "txn_time").when(number.isNull(), "amount").when(~F.coalesce(F.col("direction").isin("进", "出"), F.lit(False)), "direction")
    marked = mapped.withColumn("error_field", fault).withColumn("error_value", F.when(fault == "txn_time", F.col("__txn_time")).when(fault == "amount", F.col("__amount")).when(fault == "direction", F.col("__direction")))
    keep = [c for c in mapped.columns if not c.startswith("__")]
    return marked.filter("error_field IS NULL").select(F.col("__row").alias(row_id), *keep), marked.filter("error_field IS NOT NULL").select(F.col("__row").alias(row_id), "error_field", "error_value")


def _run(spark: SparkSession, url: str, statements: Sequence[str], options: Mapping[str, str]) -> list[int]:
    """Statements in one transaction on the driver; the number of rows each one changed."""
    jvm = spark.sparkContext._jvm
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        connection.setAutoCommit(False)
        done = []
        for s in statements:
            statement = connection.createStatement()
            done.append(statement.executeUpdate(s))
            statement.close()
        connection.commit()
        return done
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def write_new_rows(df: DataFrame, url: str, table: str, hashed: Sequence[str] = (), options: Mapping[str, str] | None = None, hash_column: str = "source_row_hash", text_type: str = "VARCHAR(4000)") -> int:
    """SK5: rows whose hash (P36, over ``hashed`` or all columns) isn't in the table yet; the number of rows added.

    Executors write to a staging table; one statement of the database inserts what is new, so no hash is read back, and a task that is
    retried can't add a row twice (staging rows are distinct by hash there). A missing table is created, missing columns are added as text.
    """
    spark, o = df.sparkSession, dict(options or {})
    rows = df.withColumn(hash_column, row_hash([F.col(f"`{c}`").cast("string") for c in hashed or df.columns]))
    stage = f"stage_{uuid.uuid4().hex[:16]}"
    types = ", ".join([f"`{f.name}` {text_type}" for f in df.schema if f.dataType.typeName() == "string"] + [f"`{hash_column}` VARCHAR(64)"])
    to = lambda x: x.write.format("jdbc").option("url", url).option("createTableColumnTypes", types).options(**o)
    have = {f.name.lower() for f in spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**o).load().schema} if _exists(spark, url, table, o) else set()
    if not have:
        to(rows.limit(0)).option("dbtable", table).mode("append").save()
    else:
        missing = [c for c in rows.columns if c.lower() not in have]
        _run(spark, url, [f'ALTER TABLE {table} ADD COLUMN "{c}" {text_type}' for c in missing], o)
    to(rows).option("dbtable", stage).mode("append").save()
    try:
        one = ", ".join(f'MIN(s."{c}")' for c in rows.columns if c != hash_column)
        listed = ", ".join(f'"{c}"' for c in rows.columns if c != hash_column)
        insert = f'INSERT INTO {table} ({listed}, "{hash_column}") SELECT {one}, s."{hash_column}" FROM {stage} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE t."{hash_column}" = s."{hash_column}") GROUP BY s."{hash_column}"'
        return _run(spark, url, [insert], o)[0]
    finally:
        _run(spark, url, [f"DROP TABLE {stage}"], o)


def _exists(spark: SparkSession, url: str, table: str, options: Mapping[str, str]) -> bool:
    try:
        spark.read.format("jdbc").option("url", url).option("query", f"SELECT * FROM {table} WHERE 1 = 0").options(**options).load()
        return True
    except Exception:  # noqa: BLE001  each database names a missing table by an error of its own
        return False
