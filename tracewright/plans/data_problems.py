"""Queries of the general data problems (1, 2, 3, 4 and 6) over the test tables, and SQL that states the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators import drift, heavy_keys, instants, rejects, scales
from tracewright.plans.neutral import neutral_times
from tracewright.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "custom_rules")).select("file_name", "change", "old_field", "new_field")


def p1_types(spark: SparkSession, d: str) -> DataFrame:
    return drift.union_types(table(spark, d, "custom_rules"))


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "custom_rules")).drop("branches").withColumn("unresolved", F.array_join("unresolved", "|")).withColumn("source_columns", F.array_join("source_columns", "\x01", "null"))


def p1_branches(spark: SparkSession, d: str) -> DataFrame:
    rules = drift.consistent_table(table(spark, d, "custom_rules")).select("workspace", "step", "rule_no", F.inline("branches"))
    return rules.select("workspace", "step", "rule_no", "path", "tag", "as_string", F.round("as_number", 6).alias("as_number"), "as_boolean", F.array_join("as_array", "\x01", "null").alias("as_array"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.heavy(heavy_keys.key_totals(table(spark, d, "address_counterparty_stats")))


def p2_keys(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys.key_totals(table(spark, d, "address_counterparty_stats")).select("role", "key_address", "current_rows", "partners", "tx_count")


def _ledger_instants(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return instants.with_instants(table(spark, d, "ledger"), table(spark, d, "source_profiles"), keep=["row_id", *keep])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.same_instant_pairs(_ledger_instants(spark, d, "log_no"))


def p3_instants(spark: SparkSession, d: str) -> DataFrame:
    return _ledger_instants(spark, d)


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return scales.token_places(table(spark, d, "token_metadata_registry"), table(spark, d, "token_metadata_history"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scales.contradictions(_places(spark, d)[1])


def p4_registry(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d)[0].select("chain_id", "contract", "decimals", "places")


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    return _places(spark, d)[1].select("observation_id", "chain_id", "contract", "decimals", "places", "registry_places")


def p4_units(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "token_metadata_registry").select("decimals").unionAll(table(spark, d, "token_metadata_history").select("decimals"))
    return scales.places_dictionary(both).withColumn("posterior", F.round("posterior", 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_with_rejects(table(spark, d, "statement_lines"))[1]


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.load_with_rejects(table(spark, d, "statement_lines"))[0]


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_types, p1_rules, p1_branches, p2_found, p2_keys, p3_found, p3_instants, p4_found, p4_registry, p4_history, p4_units, p6_found, p6_loaded)
}

# A field is what lies under objects only; a number's text doesn't count, an array's is the one without spaces.
_FIELDS = r"""
WITH recs AS (SELECT workspace, file_name, rule_no, saved_at, rule_json FROM custom_rules),
stp AS (SELECT workspace, file_name, row_number() OVER (PARTITION BY workspace ORDER BY min(saved_at), file_name) AS step FROM recs GROUP BY workspace, file_name),
obj AS (SELECT DISTINCT workspace, file_name, rule_no, rule_json FROM recs WHERE try_cast(rule_json AS JSON) IS NOT NULL AND json_type(try_cast(rule_json AS JSON)) = 'OBJECT'),
fld AS (SELECT DISTINCT workspace, step, file_name, rule_no, replace(substr(j.fullkey, 3), '"', '') AS path, CASE WHEN j.type = 'VARCHAR' THEN 'string' WHEN j.type = 'BOOLEAN' THEN 'boolean' WHEN j.type = 'ARRAY' THEN 'array' ELSE 'number' END AS tag,
        CASE WHEN j.type = 'VARCHAR' THEN j.value ->> '$' WHEN j.type IN ('BOOLEAN', 'ARRAY') THEN CAST(j.value AS VARCHAR) ELSE CAST(CAST(j.value AS DOUBLE) AS VARCHAR) END AS v
        FROM obj JOIN stp USING (workspace, file_name), json_tree(obj.rule_json) j WHERE j.type NOT IN ('OBJECT', 'NULL') AND NOT contains(j.fullkey, '[')),
fus AS (SELECT workspace, step, path, list_sort(list(DISTINCT tag)) AS tags FROM fld GROUP BY ALL)
"""

_CURRENT = r"""
WITH spelt AS (
  SELECT chain_id, direction, updated_at, tx_count,
         regexp_replace(lower(trim(address, e' \t\n\r　')), '^0x', '') AS a, regexp_replace(lower(trim(counterparty_address, e' \t\n\r　')), '^0x', '') AS c
  FROM address_counterparty_stats),
keyed AS (
  SELECT chain_id, direction, updated_at, tx_count,
         CASE WHEN regexp_full_match(a, '0{24}[0-9a-f]{40}') THEN substr(a, 25) ELSE a END AS a,
         CASE WHEN regexp_full_match(c, '0{24}[0-9a-f]{40}') THEN substr(c, 25) ELSE c END AS c
  FROM spelt),
cur AS (
  SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY chain_id, a, c, direction ORDER BY updated_at DESC NULLS LAST, tx_count DESC NULLS LAST) = 1),
sides AS (
  SELECT 'address' AS role, a AS k, c AS o, tx_count FROM cur UNION ALL SELECT 'counterparty', c, a, tx_count FROM cur),
keys AS (
  SELECT role, '0x' || k AS key_address, count(*) AS current_rows, count(DISTINCT nullif(o, '')) AS partners, CAST(coalesce(sum(tx_count), 0) AS BIGINT) AS tx_count
  FROM sides WHERE regexp_full_match(k, '[0-9a-f]{40}') GROUP BY ALL)
"""

SQL = {
    "p2_found": _CURRENT + "SELECT role, key_address FROM keys WHERE current_rows >= (SELECT count(*) FROM cur) * 0.01",
    "p2_keys": _CURRENT + "SELECT role, key_address, current_rows, partners, tx_count FROM keys",
}

SQL["p1_found"] = _FIELDS + r""", mov AS (SELECT workspace, t, path, max(tags) FILTER (o) AS old_tags, max(tags) FILTER (NOT o) AS new_tags FROM (SELECT workspace, step + 1 AS t, path, tags, true AS o FROM fus UNION ALL SELECT workspace, step, path, tags, false FROM fus) GROUP BY ALL),
dif AS (SELECT mov.*, stp.file_name FROM mov JOIN stp ON stp.workspace = mov.workspace AND stp.step = mov.t WHERE t > 1 AND old_tags IS DISTINCT FROM new_tags),
rul AS (SELECT DISTINCT workspace, step, rule_no FROM recs JOIN stp USING (workspace, file_name)), sha AS (SELECT a.workspace, b.step AS t, a.rule_no FROM rul a JOIN rul b ON a.workspace = b.workspace AND a.step + 1 = b.step AND a.rule_no = b.rule_no),
lon AS (SELECT workspace, t, path, new_tags IS NULL AS gone, coalesce(old_tags, new_tags) AS tags FROM dif WHERE old_tags IS NULL OR new_tags IS NULL),
prt AS (SELECT l.workspace, l.t, l.path, l.gone, l.tags, list_sort(list((f.rule_no, f.tag, f.v))) AS vals FROM lon l JOIN fld f ON f.workspace = l.workspace AND f.path = l.path AND f.step = CASE WHEN l.gone THEN l.t - 1 ELSE l.t END JOIN sha ON sha.workspace = l.workspace AND sha.t = l.t AND sha.rule_no = f.rule_no GROUP BY ALL),
ren AS (SELECT a.workspace, a.t, a.path AS p, b.path AS q FROM prt a JOIN prt b ON a.workspace = b.workspace AND a.t = b.t AND a.gone AND NOT b.gone AND a.tags = b.tags AND a.vals = b.vals)
SELECT stp.file_name, 'renamed' AS change, p AS old_field, q AS new_field FROM ren JOIN stp ON stp.workspace = ren.workspace AND stp.step = ren.t UNION ALL
SELECT file_name, CASE WHEN new_tags IS NULL THEN 'removed' WHEN old_tags IS NULL THEN 'added' ELSE 'retyped' END, CASE WHEN old_tags IS NULL THEN '' ELSE path END, CASE WHEN new_tags IS NULL THEN '' ELSE path END
FROM dif WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.workspace = dif.workspace AND ren.t = dif.t AND dif.path IN (ren.p, ren.q))"""
SQL["p1_types"] = _FIELDS + r""", ele AS (SELECT fld.path, list_sort(list(DISTINCT CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END)) AS kinds FROM fld, json_each(fld.v) j WHERE tag = 'array' GROUP BY fld.path),
per AS (SELECT path, tag, count(DISTINCT (workspace, step)) AS files, min(step) AS first_step, max(step) AS last_step FROM fld GROUP BY ALL)
SELECT path, tag, CASE WHEN tag = 'array' THEN coalesce(array_to_string(kinds, '|'), '') ELSE '' END AS elements, files, first_step, last_step, count(*) OVER (PARTITION BY path) AS alternatives FROM per LEFT JOIN ele USING (path)"""
SQL["p1_branches"] = _FIELDS + r""" SELECT workspace, step, rule_no, path, tag, CASE WHEN tag = 'string' THEN v END AS as_string, CASE WHEN tag = 'number' THEN round(CAST(v AS DOUBLE), 6) END AS as_number, CASE WHEN tag = 'boolean' THEN v = 'true' END AS as_boolean,
CASE WHEN tag = 'array' THEN array_to_string(list_transform(CAST(v AS JSON[]), lambda x: coalesce(x ->> '$', 'null')), chr(1)) END AS as_array FROM fld"""

# A field is quoted or has no quote; the separator is one control character, so that one pattern serves every file.
_F = r'(?:"(?:[^"]|"")*"|[^"\x01]*)'
_TRIM = lambda c: f"regexp_replace({c}, '{rejects._SPACE}', '', 'g')"
_VALUE = lambda i: _TRIM(f"replace(CASE WHEN starts_with(f{i}, '\"') THEN replace(substr(f{i}, 2, length(f{i}) - 2), '\"\"', '\"') ELSE f{i} END, chr(1), sep)")
_LINES = rf"""
WITH t AS (SELECT line_id, sep, replace(raw_line, sep, chr(1)) AS t FROM statement_lines),
s AS (SELECT line_id, sep, regexp_full_match(t, '{_F}(?:\x01{_F})*', 's') AS quoted, regexp_full_match(t, '{_F}(?:\x01{_F}){{7}}', 's') AS eight,
             regexp_extract(t, '^({_F})\x01({_F})\x01({_F})', 1, 's') AS f1, regexp_extract(t, '^({_F})\x01({_F})\x01({_F})', 2, 's') AS f2, regexp_extract(t, '^({_F})\x01({_F})\x01({_F})', 3, 's') AS f3 FROM t),
v AS (SELECT line_id, quoted, eight, {_VALUE(1)} AS tm, {_VALUE(2)} AS am, {_VALUE(3)} AS di FROM s),
n AS (SELECT *, CASE WHEN regexp_full_match(tm, '\d{{4}}-\d{{2}}-\d{{2}} \d{{2}}:\d{{2}}:\d{{2}}') THEN try_strptime(tm, '%Y-%m-%d %H:%M:%S')
        WHEN regexp_full_match(tm, '\d{{4}}/\d{{1,2}}/\d{{1,2}} \d{{1,2}}:\d{{2}}:\d{{2}}') THEN try_strptime(tm, '%Y/%m/%d %H:%M:%S') WHEN regexp_full_match(tm, '\d{{4}}/\d{{1,2}}/\d{{1,2}} \d{{1,2}}:\d{{2}}') THEN try_strptime(tm, '%Y/%m/%d %H:%M')
        WHEN regexp_full_match(tm, '\d{{14}}') THEN try_strptime(substr(tm, 1, 4) || '-' || substr(tm, 5, 2) || '-' || substr(tm, 7, 2) || ' ' || substr(tm, 9, 2) || ':' || substr(tm, 11, 2) || ':' || substr(tm, 13, 2), '%Y-%m-%d %H:%M:%S')
        WHEN regexp_full_match(tm, '\d{{4}}年\d{{1,2}}月\d{{1,2}}日 ?\d{{1,2}}时\d{{1,2}}分\d{{1,2}}秒') THEN try_strptime(replace(tm, ' ', ''), '%Y年%m月%d日%H时%M分%S秒') END AS ts FROM v)
SELECT * FROM (SELECT line_id, CASE WHEN NOT quoted THEN 'broken_quoting' WHEN NOT eight THEN 'column_count' WHEN ts IS NULL THEN 'bad_time'
  WHEN NOT regexp_full_match(am, '[+-]?[￥¥]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?元?') THEN 'bad_amount' WHEN di NOT IN ({', '.join(f"'{x}'" for x in rejects.DIRECTIONS)}) THEN 'bad_direction' END AS reason FROM n) WHERE reason IS NOT NULL
"""
SQL["p6_found"] = _LINES
_EIGHT = r"\x01".join([f"({_F})"] * 8)
SQL["p6_loaded"] = _LINES[: _LINES.index("SELECT * FROM (SELECT line_id, CASE")] + rf"""
, w AS (SELECT t.line_id, t.sep, {', '.join(f"regexp_extract(t.t, '^{_EIGHT}$', {i}, 's') AS f{i}" for i in range(1, 9))} FROM t)
SELECT w.line_id, {', '.join(f'{_VALUE(i)} AS {c}' for i, c in enumerate(rejects.FIELDS, 1))} FROM w JOIN n USING (line_id) WHERE quoted AND eight AND ts IS NOT NULL
  AND regexp_full_match(am, '[+-]?[￥¥]?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?元?') AND di IN ({', '.join(f"'{x}'" for x in rejects.DIRECTIONS)})"""

_WORDS = ", ".join(f"'{w}'" for w in scales.ENGLISH)
_HAN = "[" + ", ".join(f"'{w}'" for w in ["零", "一", "两", "三", "四", "五", "六", "七", "八", "九"]) + "]"
_UNITS = " ".join(f"WHEN '{u}' THEN {n}" for u, n in scales.UNITS.items())
_PLACES = rf"""
raw AS (SELECT DISTINCT decimals FROM token_metadata_registry UNION SELECT DISTINCT decimals FROM token_metadata_history),
cl AS (SELECT decimals, regexp_replace(lower(trim(decimals)), ',(\d{{3}})', '\1', 'g') AS s FROM raw WHERE decimals IS NOT NULL),
hx AS (SELECT decimals, CASE WHEN regexp_full_match(s, '0x[0-9a-f]+') THEN CAST(coalesce(try_cast('0x' || nullif(regexp_replace(s, '^0x0*', ''), '') AS UBIGINT), 0) AS VARCHAR) ELSE s END AS s FROM cl),
wd AS (SELECT decimals, s, regexp_replace(regexp_replace(s, '^(decimals?|精度)\s*[:=]?\s*', ''), '\s*(decimals?|places|dp|位小数)$', '') AS w, regexp_matches(s, '^(decimals?|精度)|(decimals?|places|dp|位小数)$') AS said FROM hx),
places AS (SELECT decimals, CASE
  WHEN regexp_full_match(s, '\d+(\.0*)?') THEN CASE WHEN try_cast(split_part(s, '.', 1) AS HUGEINT) <= 36 THEN CAST(split_part(s, '.', 1) AS INT) WHEN regexp_full_match(split_part(s, '.', 1), '10{{1,36}}') THEN length(split_part(s, '.', 1)) - 1 END
  WHEN regexp_full_match(s, '0?\.0*10*') THEN length(regexp_extract(s, '\.(0*)1', 1)) + 1
  WHEN regexp_full_match(s, '1(\.0+)?e[+-]?\d+') THEN abs(CAST(split_part(s, 'e', 2) AS INT))
  WHEN regexp_full_match(s, '10(\^|\*\*)-?\d+') THEN abs(CAST(regexp_extract(s, '(-?\d+)$', 1) AS INT))
  WHEN regexp_full_match(s, '1 token = 10\^\d+ .*') THEN CAST(regexp_extract(s, '\^(\d+)', 1) AS INT)
  WHEN regexp_full_match(s, '1 token = 10* .*') THEN length(regexp_extract(s, '= (10*) ', 1)) - 1
  WHEN said AND regexp_full_match(w, '\d+') AND CAST(w AS INT) <= 36 THEN CAST(w AS INT)
  WHEN list_contains([{_WORDS}], w) THEN list_position([{_WORDS}], w) - 1
  WHEN said AND w = '十' THEN 10 WHEN said AND starts_with(w, '十') THEN 9 + list_position(list_concat(['零'], ['一', '二'], {_HAN}[4:]), substr(w, 2, 1)) WHEN said AND list_contains({_HAN}, w) THEN list_position({_HAN}, w) - 1
  ELSE coalesce(CASE s {_UNITS} END, CASE rtrim(s, 's') {_UNITS} END) END AS places FROM wd),
reg AS (SELECT chain_id, lower(trim(contract_address)) AS contract, decimals FROM token_metadata_registry QUALIFY row_number() OVER (PARTITION BY chain_id, lower(trim(contract_address)) ORDER BY updated_at DESC, decimals DESC NULLS LAST) = 1)
"""
SQL["p4_found"] = f"WITH {_PLACES} SELECT DISTINCT h.observation_id FROM token_metadata_history h JOIN reg ON reg.chain_id = h.chain_id AND reg.contract = lower(trim(h.contract_address)) JOIN places a ON a.decimals = h.decimals JOIN places b ON b.decimals = reg.decimals WHERE a.places <> b.places"
SQL["p4_registry"] = f"WITH {_PLACES} SELECT chain_id, contract, reg.decimals, places FROM reg LEFT JOIN places ON places.decimals = reg.decimals"
SQL["p4_history"] = f"WITH {_PLACES} SELECT h.observation_id, h.chain_id, lower(trim(h.contract_address)) AS contract, h.decimals, a.places, b.places AS registry_places FROM token_metadata_history h LEFT JOIN places a ON a.decimals = h.decimals LEFT JOIN reg ON reg.chain_id = h.chain_id AND reg.contract = lower(trim(h.contract_address)) LEFT JOIN places b ON b.decimals = reg.decimals"

_ZONE_NAMES = "CASE WHEN z IN ('Z', 'UTC', 'GMT', 'UT') THEN 0 " + " ".join(
    f"WHEN starts_with(zone_id, '{region}') THEN CASE z " + " ".join(f"WHEN '{n}' THEN {m}" for n, m in names.items()) + " END" for region, names in instants.REGION_ABBREVIATIONS.items()
) + " END"
_ZONE_END = r"\s*(AM|PM)?\s*(Z|(?:UTC|GMT)?\s*[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5})?)?$"
_YF = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ -]+(\d{1,2})[:.](\d{1,2})(?:[:.](\d{1,2})(?:[.,]\d+)?)?" + _ZONE_END
_YL = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?: +(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:[.,]\d+)?)?" + _ZONE_END
_NAMES = "['a', 'b', 'c', 'h', 'm', 's', 'half', 'z']"
_INSTANTS = rf"""
one AS (SELECT data_source, min((zone_id, date_order)) AS p FROM source_profiles WHERE data_source IS NOT NULL GROUP BY 1),
src AS (SELECT row_id, log_no, one.p[1] AS zone_id, one.p[2] AS date_order, upper(trim({{half}}, e' \t\n\r"''')) AS t FROM ledger LEFT JOIN one USING (data_source)),
nrm AS (SELECT * EXCLUDE (t), trim(regexp_replace(regexp_replace(regexp_replace(translate(t, '年月日时時点分秒', '-- :::: '), '(\d)T(\d)', '\1 \2'), ':\s*($|[+A-Z-])', ' \1', 'g'), '\s+', ' ', 'g')) AS s FROM src),
prt AS (SELECT *, CASE WHEN regexp_full_match(s, '\d{{8}}|\d{{12}}|\d{{14}}') OR regexp_full_match(s, '(19|20)\d{{8}}') THEN struct_pack(a := substr(s, 1, 4), b := substr(s, 5, 2), c := substr(s, 7, 2), h := substr(s, 9, 2), m := substr(s, 11, 2), s := substr(s, 13, 2), half := '', z := '')
   WHEN regexp_matches(s, '{_YF}') THEN regexp_extract(s, '{_YF}', {_NAMES}) WHEN regexp_matches(s, '{_YL}') THEN regexp_extract(s, '{_YL}', {_NAMES}) END AS p, regexp_matches(s, '{_YL}') AND NOT regexp_matches(s, '{_YF}') AS last FROM nrm),
num AS (SELECT row_id, log_no, zone_id, date_order, s, last, length(p.c) = 4 AS wide, try_cast(p.a AS INT) AS a, try_cast(p.b AS INT) AS b, try_cast(p.c AS INT) AS c, coalesce(try_cast(p.h AS INT), 0) AS h, coalesce(try_cast(p.m AS INT), 0) AS mi, coalesce(try_cast(p.s AS INT), 0) AS se, p.half AS half, nullif(trim(p.z), '') AS z FROM prt),
ymd AS (SELECT *, CASE WHEN NOT last THEN a WHEN date_order IN ('MDY', 'DMY') THEN CASE WHEN wide THEN c WHEN c < 70 THEN 2000 + c ELSE 1900 + c END WHEN date_order = 'YMD' AND NOT wide THEN CASE WHEN a < 70 THEN 2000 + a ELSE 1900 + a END END AS y,
   CASE WHEN last AND date_order = 'MDY' THEN a ELSE b END AS mo, CASE WHEN NOT last THEN c WHEN date_order = 'MDY' THEN b WHEN date_order = 'DMY' THEN a ELSE c END AS d, CASE WHEN coalesce(half, '') = '' THEN h WHEN h BETWEEN 1 AND 12 THEN h % 12 + CASE half WHEN 'PM' THEN 12 ELSE 0 END END AS hh FROM num),
loc AS (SELECT *, CASE WHEN regexp_full_match(s, '\d{{1,5}}(\.\d+)?') THEN CASE WHEN CAST(s AS DOUBLE) BETWEEN 1 AND 100000 THEN TIMESTAMP '1899-12-30' + to_days(CAST(floor(CAST(s AS DOUBLE)) AS INT)) + to_seconds(round((CAST(s AS DOUBLE) - floor(CAST(s AS DOUBLE))) * 86400)) END
   WHEN hh <= 23 THEN try_cast(printf('%04d-%02d-%02d %02d:%02d:%02d', y, mo, d, hh, mi, se) AS TIMESTAMP) END AS local FROM ymd),
off AS (SELECT *, CASE WHEN regexp_matches(z, '[+-]\d') THEN CASE WHEN contains(z, '-') THEN -1 ELSE 1 END * (CAST(regexp_extract(z, '[+-](\d{{1,2}}):?(\d{{2}})?$', 1) AS INT) * 60 + coalesce(try_cast(regexp_extract(z, '[+-](\d{{1,2}}):?(\d{{2}})?$', 2) AS INT), 0)) ELSE {_ZONE_NAMES} END AS minutes, CASE WHEN z IS NULL AND zone_id IS NOT NULL THEN timezone(zone_id, local) END AS utc FROM loc),
ins AS (SELECT row_id, log_no, CASE WHEN regexp_full_match(s, '\d{{13}}') THEN CAST(s AS BIGINT) // 1000 WHEN regexp_full_match(s, '\d{{9,10}}') AND NOT regexp_full_match(s, '(19|20)\d{{8}}') THEN CASE WHEN CAST(s AS BIGINT) BETWEEN 946684800 AND 4102444800 THEN CAST(s AS BIGINT) END
   WHEN z IS NOT NULL THEN CAST(epoch(local) AS BIGINT) - minutes * 60 WHEN timezone(zone_id, utc - INTERVAL 1 HOUR) = local THEN CAST(epoch(utc) AS BIGINT) - 3600 WHEN timezone(zone_id, utc) = local THEN CAST(epoch(utc) AS BIGINT) END AS i FROM off)
""".replace("{half}", "translate(txn_time, '" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　', '" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''") + " ')")
SQL["p3_instants"] = f"WITH {_INSTANTS} SELECT row_id, i * 1000000 AS instant FROM ins"
SQL["p3_found"] = f"WITH {_INSTANTS} SELECT a.row_id AS row_id_1, b.row_id AS row_id_2 FROM ins a JOIN ins b ON a.log_no = b.log_no AND a.i = b.i AND a.row_id < b.row_id WHERE a.log_no <> ''"

neutral_times(QUERIES, {"p3_instants": ""}, {"p3_instants": "instant"})  # its SQL has microseconds already
