"""Dependencies between columns, changes file by file, deep pages and stored searches."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.operators import diff, events, inclusion, lineage, sketches
from snaplake.plans.inputs import NEW, NOW, ctes, frame, table
from snaplake.plans.registry import query
from snaplake.plans.score_queries import QUEUE_SQL, queue_of
from snaplake.session import materialise, scratch_path
from snaplake.sinks import tables
from snaplake.sinks.copy_on_write import read_files, upsert_files
from snaplake.sinks.directories import read_page, save_pages, save_searchable, search_stored

# ------------------------------------------------------------- dependencies
_COLUMNS = {
    "region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_nationkey", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey", "p_brand"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linestatus"),
}
_FLAT = [(t, c) for t, cs in _COLUMNS.items() for c in cs]
_SETS = ", ".join(f"{c} AS (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 1)" for t, c in _FLAT)
_DEPENDENCIES = f"WITH {_SETS} " + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{c}' AS column_name, '{rt}' AS referenced_table, '{rc}' AS referenced_column, (SELECT count(v) FROM {c}) AS "values",
    (SELECT bool_and(n = 1 AND v IS NOT NULL) FROM {rc}) AS is_key
    WHERE NOT EXISTS (FROM (SELECT v FROM {c} WHERE v IS NOT NULL EXCEPT SELECT v FROM {rc}))"""
    for t, c in _FLAT for rt, rc in _FLAT if (t, c) != (rt, rc)
)


def _tables(spark, d):
    return {t: table(spark, d, t).select(*cs) for t, cs in _COLUMNS.items()}


@query("inclusion_dependencies", _DEPENDENCIES)
def inclusion_dependencies(spark, d):
    return inclusion.inclusion_dependencies(_tables(spark, d))


@query("foreign_keys", f"SELECT * EXCLUDE (is_key) FROM ({_DEPENDENCIES}) WHERE is_key AND table_name <> referenced_table")
def foreign_keys(spark, d):
    return inclusion.foreign_keys(_tables(spark, d))


@query("entity_foreign_keys", """
SELECT entity, 'firm_id' AS foreign_key, 'Firm' AS referenced_entity FROM (VALUES ('Office'), ('Registration')) e(entity)""")
def entity_foreign_keys(spark, d):
    """Typed entities of customers and their orders; only the firm itself has one row per key."""
    firm = F.concat(F.lit("F"), F.col("c_custkey").cast("string")).alias("firm_id")
    customers = table(spark, d, "customer")
    filed = table(spark, d, "orders").select(F.concat(F.lit("F"), F.col("o_custkey").cast("string")).alias("firm_id"), "o_orderdate")
    entities = {
        "Firm": customers.select(firm, "c_name"),
        "Office": customers.select(firm, F.col("c_mktsegment").alias("city")).unionByName(customers.select(firm, F.lit("mail").alias("city"))),
        "Registration": filed,
    }
    return inclusion.entity_foreign_keys(entities, "firm_id")


# ------------------------------------------------------- changes by file
@query("upsert_by_file", ctes("scored_old", "scored_new") + f"""
SELECT coalesce(n.firm_id, o.firm_id) AS firm_id, coalesce(n.name, o.name) AS name,
    CASE WHEN n.firm_id IS NULL THEN o.employee_count ELSE n.employee_count END AS employee_count,
    CASE WHEN o.firm_id IS NULL THEN n.registration_status ELSE o.registration_status END AS registration_status
FROM scored_old o FULL JOIN scored_new n ON o.firm_id = n.firm_id""")
def upsert_by_file(spark, d):
    """The newer snapshot upserted into the files of the older one; the status of a firm that is there stays."""
    root, columns = scratch_path(spark, "files"), ["firm_id", "name", "employee_count", "registration_status"]
    upsert_files(frame(spark, d, "scored_old").select(*columns), root, ["firm_id"], file_rows=500)
    upsert_files(frame(spark, d, "scored_new").select(*columns), root, ["firm_id"], ["name", "employee_count"], file_rows=500)
    return read_files(spark, root)


@query("refresh_queue_saved", QUEUE_SQL + f"SELECT *, '{NEW}' AS dataset_version FROM queue")
def refresh_queue_saved(spark, d):
    """The queue saved twice: before research and events are known, with firms that leave it again, and as it is."""
    root, queue = scratch_path(spark, "queue"), materialise(queue_of(spark, d))
    early = queue.withColumns({"action": F.lit("NEW_TARGET_RESEARCH"), "reasons": F.array(F.lit("missing research record"))})
    leaving = early.withColumn("firm_id", F.concat(F.lit("X"), "firm_id"))
    now = F.lit(NOW).cast("timestamp")
    tables.save_refresh_queue(early.unionByName(leaving), root, NEW, now)
    tables.save_refresh_queue(queue, root, NEW, now)
    saved = read_files(spark, f"{root}/queue")
    return saved.orderBy(*events.queue_order()).withColumn("reasons", F.array_join("reasons", "|"))


# ------------------------------------------------------ pages and searches
_NUMBERS = (1, 7, 120, 100_000)


@query("deep_pages", " UNION ALL ".join(
    f"SELECT {n} AS page, o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 100 OFFSET {(n - 1) * 100})"
    for n in _NUMBERS))
def deep_pages(spark, d):
    path = scratch_path(spark, "pages")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    save_pages(rows, path, "o_totalprice", tie="o_orderkey", rows=2000)
    return reduce(DataFrame.unionByName, [read_page(spark, path, n, 100).withColumn("page", F.lit(n)) for n in _NUMBERS])


_TEXTS = ("Ring", "green", "zzz", "1", "_a%e")


@query("search_stored", " UNION ALL ".join(
    f"SELECT '{t}' AS text, p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%{t}%' OR p_brand ILIKE '%{t}%'" for t in _TEXTS))
def search_stored_texts(spark, d):
    path, columns = scratch_path(spark, "search"), ("p_name", "p_brand")
    save_searchable(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), path, columns, ["p_partkey"], rows=500)
    return reduce(DataFrame.unionByName, [search_stored(spark, path, t, columns).withColumn("text", F.lit(t)) for t in _TEXTS])


# ------------------------------------------------------------ wide snapshots
_WIDE = ("name", "registration_status", "employee_count", "organization_type", "total_aum", "priority_category")


def _cents(column: str) -> str:
    return f"CAST(round({column}) AS BIGINT)" if column.endswith("total_aum") else column


@query("snapshot_cells_by_hash", ctes("scored_old", "scored_new") + " UNION ALL ".join(
    f"""SELECT o.firm_id, '{c}' AS column_name, CAST({_cents('o.' + c)} AS VARCHAR) AS old_value, CAST({_cents('n.' + c)} AS VARCHAR) AS new_value
    FROM scored_old o JOIN scored_new n ON o.firm_id = n.firm_id WHERE {_cents('o.' + c)} IS DISTINCT FROM {_cents('n.' + c)}""" for c in _WIDE))
def snapshot_cells_by_hash(spark, d):
    old, new = (
        frame(spark, d, side).select("firm_id", *_WIDE).withColumn("total_aum", F.round("total_aum").cast("bigint")) for side in ("scored_old", "scored_new")
    )
    return diff.cell_changes_by_hash(old, new, ["firm_id"])


# ----------------------------------------------------------------- versions
_NUMBERS_OF = ("employee_count", "total_account_count", "advisory_employee_count")
_TEXTS_OF = ("firm_id", "name", "registration_status", "organization_type", "website_address")


@query("profile_of_versions", ctes("scored_both") + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST(2 AS BIGINT) AS versions, count(*) AS total_rows, count(*) - count({c}) AS null_count,
    {f"CAST(min({c}) AS DOUBLE)" if c in _NUMBERS_OF else "CAST(NULL AS DOUBLE)"} AS low,
    {f"CAST(max({c}) AS DOUBLE)" if c in _NUMBERS_OF else "CAST(NULL AS DOUBLE)"} AS high, true AS near_enough FROM scored_both"""
    for c in _NUMBERS_OF + _TEXTS_OF))
def profile_of_versions(spark, d):
    """Two versions profiled one by one and stored; what both hold comes from the stored sketches.

    Estimates are not defined to the last digit; that distinct values lie within 8 % and the median's rank within 3 % is.
    """
    path, columns = scratch_path(spark, "sketches"), [*_NUMBERS_OF, *_TEXTS_OF]
    for side in ("scored_old", "scored_new"):
        rows = frame(spark, d, side)
        tables.replace_version(sketches.column_sketches(rows.select(*columns), side), path)
    found = sketches.merged_profile(spark.read.parquet(path))
    both = materialise(frame(spark, d, "scored_both").select(*columns))
    cells = both.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), (F.col(c).cast("double") if c in _NUMBERS_OF else F.lit(None).cast("double")).alias("number"))
        for c in columns])))
    exact = cells.join(F.broadcast(found.select("column_name", "median")), "column_name").groupBy("column_name").agg(
        F.countDistinct("value").alias("distinct"), F.avg(F.when(F.col("number") < F.col("median"), 1.0).otherwise(0.0)).alias("below"),
        F.avg(F.when(F.col("number") <= F.col("median"), 1.0).otherwise(0.0)).alias("upto"),
    )
    near = (F.abs(F.col("distinct_estimate") - F.col("distinct")) <= 0.08 * F.col("distinct")) & (
        F.col("median").isNull() | ((F.col("below") <= 0.53) & (F.col("upto") >= 0.47))
    )
    return found.join(exact, "column_name").select(
        "column_name", "versions", "total_rows", "null_count", "low", "high", near.alias("near_enough")
    )


_WALK = ctes("lineage").replace("WITH ", "WITH RECURSIVE ", 1) + """, walk AS (
SELECT id, [id] AS path, CAST(0 AS BIGINT) AS depth FROM lineage WHERE parent IS NULL OR parent NOT IN (SELECT id FROM lineage)
UNION ALL SELECT l.id, list_append(w.path, l.id), w.depth + 1 FROM lineage l JOIN walk w ON l.parent = w.id),
sizes AS (SELECT id, count(*) AS size FROM (SELECT unnest(path) AS id FROM walk) GROUP BY id),
labels AS (SELECT id, row_number() OVER (ORDER BY path) - 1 AS "begin", size, depth FROM walk JOIN sizes USING (id))
"""


@query("lineage_intervals", _WALK + "SELECT * FROM labels")
def lineage_intervals(spark, d):
    return lineage.intervals(frame(spark, d, "lineage").select("id", "parent"))


@query("lineage_tests", _WALK + """
SELECT a.id AS ancestor, w.id AS descendant, list_contains(w.path, a.id) AND a.id <> w.id AS related
FROM lineage a JOIN walk w ON w.id IN (a.id + 1, a.id * 2, a.id * 3 + 1)""")
def lineage_tests(spark, d):
    """Whether a version is above its followers by number, without a pair of the closure."""
    versions = frame(spark, d, "lineage").select("id", "parent")
    asked = versions.select(F.col("id").alias("ancestor"), F.explode(F.array_distinct(F.array(F.col("id") + 1, F.col("id") * 2, F.col("id") * 3 + 1))).alias("descendant"))
    asked = asked.join(versions.select(F.col("id").alias("descendant")), "descendant", "left_semi")
    return lineage.are_ancestors(lineage.intervals(versions), asked).select("ancestor", "descendant", "related")
