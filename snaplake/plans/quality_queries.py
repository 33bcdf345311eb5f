"""Checks and profiles."""

import re

from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.operators import diff, normalize, profile, quality
from snaplake.plans.inputs import DuckText, ctes, frame, roster, table
from snaplake.plans.registry import query
from snaplake.plans.typing_queries import _FIRM_SQL, _null, _office_sql, _snapshot
from snaplake.session import materialise
from snaplake.sources import dimensions
from snaplake.sources.snapshots import list_versions

_BASE = ctes("roster") + f", firms AS ({_FIRM_SQL}), offices AS ({_office_sql()})\n"


@query("quality_keys", _BASE + """
SELECT 'missing_keys' AS "check", 'firms' AS entity, metric, bad_count, 'error' AS severity, bad_count = 0 AS passed FROM (
    SELECT 'firm_id' AS metric, count(*) FILTER (firm_id IS NULL) AS bad_count FROM firms
    UNION ALL SELECT 'name', count(*) FILTER (name IS NULL) FROM firms)""")
def quality_keys(spark, d):
    return quality.missing_keys(normalize.mapped(frame(spark, d, "roster")), "firms", ["firm_id", "name"])


@query("dup_keys", "SELECT l_orderkey, count(*) AS occurrences FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def dup_keys(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey"])


@query("dup_composite", "SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_composite(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("critical_nulls", _BASE + """
SELECT 'unexpected_nulls' AS "check", 'firm_offices' AS entity, metric, bad_count, 'error' AS severity, bad_count = 0 AS passed FROM (
    SELECT 'street_address_1' AS metric, count(*) FILTER (street_address_1 IS NULL AND office_type = 'MAIN') AS bad_count FROM offices
    UNION ALL SELECT 'city', count(*) FILTER (city IS NULL AND office_type = 'MAIN') FROM offices
    UNION ALL SELECT 'state', count(*) FILTER (state IS NULL AND office_type = 'MAIN') FROM offices)""")
def critical_nulls(spark, d):
    return quality.unexpected_nulls(
        _snapshot(spark, d)["firm_offices"], "firm_offices", fv.CRITICAL_OFFICE_FIELDS, F.col("office_type") == "MAIN"
    )


_CHECKS_SQL = _BASE + f"""
, accepted AS (SELECT * FROM firms WHERE name IS NOT NULL),
acquired AS (SELECT {_null('"Organization CRD#"')} AS parent_firm_id FROM roster
    WHERE "Acquired Firm" IS NOT NULL AND {_null('"Legal Name"')} IS NOT NULL),
counted AS (
    SELECT 'missing_keys' AS "check", 'firms' AS entity, 'firm_id' AS metric, count(*) FILTER (firm_id IS NULL) AS bad_count, 'error' AS severity FROM accepted
    UNION ALL SELECT 'missing_keys', 'firm_offices', 'firm_id', count(*) FILTER (firm_id IS NULL), 'error' FROM offices
    UNION ALL SELECT 'missing_keys', 'firm_acquired_firms', 'parent_firm_id', count(*) FILTER (parent_firm_id IS NULL), 'error' FROM acquired
    UNION ALL SELECT 'duplicate_keys', 'firms', 'firm_id', (SELECT count(*) FROM (SELECT 1 FROM accepted GROUP BY firm_id HAVING count(*) > 1)), 'error'
    UNION ALL SELECT 'duplicate_keys', 'firm_offices', 'firm_id,office_type', (SELECT count(*) FROM (SELECT 1 FROM offices GROUP BY firm_id, office_type HAVING count(*) > 1)), 'error'
    UNION ALL SELECT 'broken_references', 'firm_offices', 'firm_id', count(*) FILTER (firm_id NOT IN (SELECT firm_id FROM accepted)), 'error' FROM offices
    UNION ALL SELECT 'broken_references', 'firm_acquired_firms', 'parent_firm_id', count(*) FILTER (parent_firm_id NOT IN (SELECT firm_id FROM accepted)), 'error' FROM acquired
    UNION ALL SELECT 'orphans', 'firms', 'firm_id', count(*) FILTER (firm_id NOT IN (SELECT firm_id FROM offices)), 'warning' FROM accepted
    UNION ALL SELECT 'unexpected_nulls', 'firms', 'name', count(*) FILTER (name IS NULL), 'error' FROM accepted
    UNION ALL SELECT 'unexpected_nulls', 'firms', 'firm_type', count(*) FILTER (firm_type IS NULL), 'error' FROM accepted
    UNION ALL SELECT 'unexpected_nulls', 'firms', 'sec_current_status', count(*) FILTER (sec_current_status IS NULL), 'error' FROM accepted
    UNION ALL SELECT 'unexpected_nulls', 'firm_offices', 'street_address_1', count(*) FILTER (street_address_1 IS NULL AND office_type = 'MAIN'), 'error' FROM offices
    UNION ALL SELECT 'unexpected_nulls', 'firm_offices', 'city', count(*) FILTER (city IS NULL AND office_type = 'MAIN'), 'error' FROM offices
    UNION ALL SELECT 'unexpected_nulls', 'firm_offices', 'state', count(*) FILTER (state IS NULL AND office_type = 'MAIN'), 'error' FROM offices)
"""


def _checks(spark, d):
    parts = _snapshot(spark, d)
    return quality.validate_snapshot(parts["firms"], parts["firm_offices"], parts["firm_acquired_firms"])


@query("quality_checks", _CHECKS_SQL + "SELECT *, bad_count = 0 AS passed FROM counted")
def quality_checks(spark, d):
    return _checks(spark, d)


@query("quality_summary", _CHECKS_SQL + """
SELECT count(*) AS total_checks, count(*) FILTER (bad_count = 0) AS passed, count(*) FILTER (bad_count > 0) AS failed FROM counted""")
def quality_summary(spark, d):
    return quality.summary(_checks(spark, d))


@query("reconcile", f"""
SELECT dataset_version, count(*) AS raw_rows, count(*) FILTER (o_orderpriority <> '5-LOW') AS typed_rows,
    count(*) = count(*) FILTER (o_orderpriority <> '5-LOW') AS passed
FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS dataset_version FROM orders) GROUP BY 1""")
def reconcile(spark, d):
    raw = table(spark, d, "orders").withColumn("dataset_version", F.date_format("o_orderdate", "yyyy-MM"))
    return quality.reconcile(raw, raw.filter("o_orderpriority <> '5-LOW'"), ["dataset_version"])


@query("row_drop", """
SELECT month, before, now, round(now / before * 100, 1) AS kept_pct FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS before, count(*) FILTER (o_orderpriority <> '5-LOW') AS now
    FROM orders GROUP BY 1) WHERE now < before * 0.95""")
def row_drop(spark, d):
    counts = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("before"), F.count_if(F.col("o_orderpriority") != "5-LOW").alias("now")
    )
    return quality.row_drops(counts, "before", "now")


@query("freshness", """
SELECT max(ts) AS latest, CAST(floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(max(ts))) / 86400000000) AS BIGINT) AS age_days,
    floor((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(max(ts))) / 86400000000) < 35 AS passed FROM events""")
def freshness(spark, d):
    return quality.freshness(table(spark, d, "events"), "ts", F.lit("2024-03-01").cast("timestamp"))


@query("schema_alarms", ctes("columns_old", "columns_new") + """
SELECT 'SCHEMA_DRIFT' AS alarm, 'parts' AS table_name,
    (SELECT count(*) FROM (SELECT column_name FROM columns_old EXCEPT SELECT column_name FROM columns_new)) AS missing_columns,
    (SELECT count(*) FROM (SELECT column_name FROM columns_new EXCEPT SELECT column_name FROM columns_old)) AS extra_columns
WHERE missing_columns > 0 OR extra_columns > 0""")
def schema_alarms(spark, d):
    missing, extra = diff.schema_drift(frame(spark, d, "columns_old"), frame(spark, d, "columns_new"))
    return quality.schema_alarms(missing, extra, "parts")


@query("missing_tables", ctes("columns_old", "columns_new") + """
SELECT 'MISSING_TABLE' AS alarm, table_name FROM (SELECT table_name FROM columns_old EXCEPT SELECT table_name FROM columns_new)""")
def missing_tables(spark, d):
    expected = frame(spark, d, "columns_old").select("table_name").distinct()
    return quality.missing_tables(expected, frame(spark, d, "columns_new"))


# ------------------------------------------------------------------- profile
def _profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for name, kind in columns:
        empty = f"count(*) FILTER (trim({name}) = '' OR {name} IS NULL)" if kind == "text" else "0"
        zero = f"count(*) FILTER ({name} = 0)" if kind == "number" else "0"
        parts.append(
            f"SELECT '{name.strip(chr(34))}' AS column_name, count(*) AS total_rows, count(*) - count({name}) AS null_count, "
            f"CAST({empty} AS BIGINT) AS empty_count, CAST({zero} AS BIGINT) AS zero_count, count(DISTINCT {name}) AS unique_values FROM {source}"
        )
    return f"""SELECT *, round((total_rows - null_count) / total_rows * 100, 2) AS completeness_pct,
        CASE WHEN total_rows > null_count THEN round(unique_values / (total_rows - null_count) * 100, 2) ELSE 0.0 END AS distinctiveness_pct
        FROM ({' UNION ALL '.join(parts)})"""


_LINEITEM = [
    ("l_orderkey", "number"), ("l_partkey", "number"), ("l_suppkey", "number"), ("l_linenumber", "number"),
    ("l_quantity", "number"), ("l_extendedprice", "number"), ("l_discount", "number"), ("l_tax", "number"),
    ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time"),
]
#: Every column of the roster, all text.
_ROSTER = [(f'"{n}"', "text") for n in re.findall(r' AS "([^"]+)"', roster(DuckText))]
_CUSTOMER = [
    ("c_custkey", "number"), ("c_name", "text"), ("c_nationkey", "number"), ("c_acctbal", "number"), ("c_mktsegment", "text"),
]


def _roster(spark, d):
    # A raw extract is stored before it is profiled.
    return materialise(frame(spark, d, "roster"))


@query("profile_columns", _profile_sql("lineitem", _LINEITEM))
def profile_columns(spark, d):
    return profile.column_profile(table(spark, d, "lineitem"))


@query("profile_columns_text", ctes("roster") + _profile_sql("roster", _ROSTER))
def profile_columns_text(spark, d):
    return profile.column_profile(_roster(spark, d))


@query("profile_columns_sketch", f"""
SELECT column_name, total_rows, null_count, empty_count, zero_count, true AS near_enough FROM ({_profile_sql("lineitem", _LINEITEM)})""")
def profile_columns_sketch(spark, d):
    # The estimate itself is not defined to the last digit; that it lies within 8 %, five standard errors, is.
    df = table(spark, d, "lineitem")
    exact = profile.column_profile(df).select("column_name", F.col("unique_values").alias("exact"))
    near = F.abs(F.col("unique_values") - F.col("exact")) <= 0.08 * F.col("exact")
    return profile.column_profile(df, approximate=True).join(exact, "column_name").select(
        "column_name", "total_rows", "null_count", "empty_count", "zero_count", near.alias("near_enough")
    )


@query("profile_tables", " UNION ALL ".join(
    f"SELECT *, '{t}' AS table_name FROM ({_profile_sql(t, c)})" for t, c in (("lineitem", _LINEITEM), ("customer", _CUSTOMER))
))
def profile_tables(spark, d):
    return profile.profile_tables({t: table(spark, d, t) for t in ("lineitem", "customer")})


@query("profile_totals", ctes("roster") + f"""
SELECT CAST(sum(total_rows) AS BIGINT) AS total_cells, CAST(sum(null_count) AS BIGINT) AS null_cells,
    CAST(sum(total_rows - null_count) AS BIGINT) AS non_null_cells, round(sum(null_count) / sum(total_rows) * 100, 2) AS null_pct
FROM ({_profile_sql('roster', _ROSTER)})""")
def profile_totals(spark, d):
    return profile.profile_totals(profile.column_profile(_roster(spark, d)))


_FLAGS = ", ".join(n for n, _ in _LINEITEM)


@query("row_uniqueness", f"""
SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_rows, count(*) FILTER (n > 1) AS duplicate_groups
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {_FLAGS})""")
def row_uniqueness(spark, d):
    return profile.row_uniqueness(table(spark, d, "lineitem").select(*_FLAGS.split(", ")))


@query("distinct_rows", f"SELECT DISTINCT {_FLAGS} FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select(*_FLAGS.split(", ")).distinct()


_SCORE_SQL = ctes("roster") + f"""
, p AS ({_profile_sql('roster', _ROSTER)}),
u AS (SELECT count(*) AS rows_all, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(n for n, _ in _ROSTER)} FROM roster)) AS rows_distinct FROM roster),
s AS (SELECT CAST(max(rows_all) AS BIGINT) AS total_rows, CAST(max(rows_distinct) AS BIGINT) AS distinct_rows,
    round((100 - round(sum(null_count) / sum(total_rows) * 100, 2)) * 0.4 + max(rows_distinct) / max(rows_all) * 100 * 0.3
        + avg(completeness_pct) * 0.2 + avg(distinctiveness_pct) * 0.1, 2) AS quality_score FROM p, u)
"""


@query("quality_score", _SCORE_SQL + "SELECT *, CAST(0 AS BIGINT) AS duplicate_groups FROM s")
def quality_score(spark, d):
    df = _roster(spark, d)
    return profile.quality_score(profile.column_profile(df), profile.row_uniqueness(df))


@query("rule_report", _SCORE_SQL + """
SELECT n AS null_threshold, q AS quality_score_rule, r AS data_presence, CASE WHEN q THEN 'passed' ELSE 'failed' END AS validation_status,
    CAST(3 AS BIGINT) AS total_rules, CAST(n AS BIGINT) + CAST(q AS BIGINT) + CAST(r AS BIGINT) AS passed,
    3 - (CAST(n AS BIGINT) + CAST(q AS BIGINT) + CAST(r AS BIGINT)) AS failed
FROM (SELECT (SELECT min(completeness_pct) >= 80 FROM p) AS n, quality_score >= 70 AS q, total_rows > 0 AS r FROM s)""")
def rule_report(spark, d):
    df = _roster(spark, d)
    columns = materialise(profile.column_profile(df))
    return profile.rule_report(columns, profile.quality_score(columns, profile.row_uniqueness(df)))


_PATTERN = """CASE WHEN count(v) = 0 THEN NULL
    WHEN bool_and(regexp_full_match(v, '[0-9]+')) THEN '^\\d+$' WHEN bool_and(regexp_full_match(v, '[A-Za-z]+')) THEN '^[A-Za-z]+$'
    WHEN bool_and(regexp_full_match(v, '[A-Za-z0-9]+')) THEN '^[A-Za-z0-9]+$'
    WHEN bool_and(contains(v, '@') AND contains(v, '.')) THEN 'email'
    WHEN bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'date_iso' ELSE 'mixed' END"""
_PATTERNED = """SELECT CAST(c_custkey AS VARCHAR) AS key, c_mktsegment AS segment, c_mktsegment || c_nationkey AS code,
    c_name || '@example.com' AS mail, c_name AS name, CAST(NULL AS VARCHAR) AS nothing,
    strftime(DATE '2020-01-01' + CAST(c_nationkey AS INTEGER), '%Y-%m-%d') AS day,
    CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS sparse FROM customer"""
_PATTERN_COLUMNS = ("key", "segment", "code", "mail", "name", "nothing", "day", "sparse")


def _patterned(spark, d):
    return materialise(table(spark, d, "customer").selectExpr(
        "CAST(c_custkey AS STRING) AS key", "c_mktsegment AS segment", "concat(c_mktsegment, c_nationkey) AS code",
        "c_name || '@example.com' AS mail", "c_name AS name", "CAST(NULL AS STRING) AS nothing",
        "date_format(date_add(DATE '2020-01-01', c_nationkey), 'yyyy-MM-dd') AS day",
        "CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS sparse",
    ))


def _per_column(select: str) -> str:
    parts = [select.replace("$C", c) for c in _PATTERN_COLUMNS]
    return f"WITH x AS ({_PATTERNED}) " + " UNION ALL ".join(parts)


@query("pattern_infer", _per_column(f"SELECT '$C' AS column_name, {_PATTERN} AS pattern FROM (SELECT $C AS v FROM x)"))
def pattern_infer(spark, d):
    return profile.column_patterns(profile.value_counts(_patterned(spark, d)))


_SCHEMA = _per_column(f"""SELECT '$C' AS column_name, 'string' AS type, count(v) < count(*) AS nullable, count(*) - count(v) AS null_count,
    count(*) AS total_count, round((count(*) - count(v)) / count(*) * 100, 2) AS null_pct, {_PATTERN} AS pattern,
    coalesce((SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT $C AS v FROM x WHERE $C IS NOT NULL ORDER BY v LIMIT 5)), '')
        AS sample_values FROM (SELECT $C AS v FROM x)""")


@query("schema_profile", _SCHEMA)
def schema_profile(spark, d):
    return profile.schema_profile(_patterned(spark, d))


_MEANINGS = ", ".join(f"('{f}', '{i}', '{m}')" for f, i, m in fv.FIELD_DICTIONARY)


@query("data_dictionary", f"""
SELECT column_name, type, column_name || ' (string)' || CASE WHEN nullable THEN ' - nullable' ELSE '' END AS description, nullable,
    pattern, sample_values, array_to_string(list_filter([CASE WHEN null_pct = 100 THEN 'all_null' WHEN null_pct > 50 THEN 'mostly_null' END,
    'pattern:' || pattern], lambda x: x IS NOT NULL), '|') AS constraints, item, meaning
FROM ({_SCHEMA}) s LEFT JOIN (VALUES {_MEANINGS}) m(field, item, meaning) ON m.field = s.column_name""")
def data_dictionary(spark, d):
    return profile.data_dictionary(profile.schema_profile(_patterned(spark, d)), dimensions.field_dictionary(spark))


@query("key_discovery", ctes("roster") + """
SELECT count(*) AS total_rows, count(DISTINCT "SEC#") AS distinct_keys, count(*) FILTER ("SEC#" IS NULL OR trim("SEC#") = '') AS blank_keys
FROM roster""")
def key_discovery(spark, d):
    return profile.key_discovery(frame(spark, d, "roster"), "SEC#")


_SAMPLED = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("sample_values", "SELECT column_name, value, CAST(position AS INTEGER) AS position FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, v AS value, row_number() OVER (ORDER BY v) AS position FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM orders)"
    for c in _SAMPLED
) + ") WHERE position <= 5")
def sample_values(spark, d):
    return profile.sample_values(profile.value_counts(table(spark, d, "orders"), _SAMPLED))


@query("version_list", ctes("scored_both") + """
SELECT dataset_version, count(*) AS row_count, CAST(strptime(substr(dataset_version, 3), '%m%d%Y') AS DATE) AS version_date
FROM scored_both GROUP BY 1""")
def version_list(spark, d):
    return list_versions(frame(spark, d, "scored_both"))
