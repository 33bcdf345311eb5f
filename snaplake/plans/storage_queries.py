"""Writes and read-backs: upserts, version replacement, files and arrivals.

Each query writes what it derives from the given tables below the session's
shared folder, reads it again and returns what was read.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplake.functions.keys import date_key
from snaplake.functions.text import unique_in_order
from snaplake.operators import enrich, serve
from snaplake.operators.events import change_events
from snaplake.plans.inputs import NEW, OLD, ctes, frame, table
from snaplake.plans.registry import query
from snaplake.plans.score_queries import EVENTS_SQL, shown_events
from snaplake.plans.typing_queries import _FIRM_SQL, _office_sql, _snapshot
from snaplake.session import materialise, scratch_path
from snaplake.sinks import tables
from snaplake.sinks.copy_on_write import read_files, upsert_files
from snaplake.sources import files, snapshots
from snaplake.streaming.arrivals import load_arrivals

_SLIM = ("firm_id", "name", "registration_status", "employee_count")
_SLIM_SQL = ", ".join(_SLIM)


def _pair(spark, d):
    return frame(spark, d, "scored_old").select(*_SLIM), frame(spark, d, "scored_new").select(*_SLIM)


@query("upsert", ctes("scored_old", "scored_new") + """
SELECT coalesce(o.firm_id, n.firm_id) AS firm_id, coalesce(o.name, n.name) AS name,
    CASE WHEN n.firm_id IS NOT NULL THEN n.registration_status ELSE o.registration_status END AS registration_status,
    CASE WHEN n.firm_id IS NOT NULL THEN n.employee_count ELSE o.employee_count END AS employee_count
FROM scored_old o FULL JOIN scored_new n ON o.firm_id = n.firm_id""")
def upsert(spark, d):
    old, new = _pair(spark, d)
    return tables.upserted(old, new, ["firm_id"], update=["registration_status", "employee_count"])


# The registry as it stands, and a retry of every load in which other loads fail.
_RETRY = "CASE WHEN event_id % 2 = 0 THEN 'failed' ELSE status END"


@query("upsert_no_demote", ctes("registry") + f"""
SELECT dataset_version, event_id, CASE WHEN status = 'success' AND {_RETRY} <> 'success' THEN status ELSE {_RETRY} END AS status,
    CASE WHEN status = 'success' AND {_RETRY} <> 'success' THEN file_size ELSE file_size + 1 END AS file_size FROM registry""")
def upsert_no_demote(spark, d):
    held = frame(spark, d, "registry").drop("download_timestamp")
    retry = held.withColumns({"status": F.expr(_RETRY), "file_size": F.col("file_size") + 1})
    return tables.upserted(held, retry, ["dataset_version"], precedence=(F.col("status") == "success").cast("int"))


_FILING = """SELECT CAST(o_custkey AS STRING) AS firm_id, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS form_version,
    o_orderstatus AS content_hash, min(o_orderkey) AS first_key FROM {orders} WHERE {side} GROUP BY 1, 2, 3"""
_BEFORE, _AFTER = "o_orderdate < TIMESTAMP '1998-04-01 00:00:00'", "o_orderdate >= TIMESTAMP '1998-04-01 00:00:00'"


@query("insert_if_absent_nullsafe", f"""
WITH held AS ({_FILING.format(orders='orders', side=_BEFORE)}), incoming AS ({_FILING.format(orders='orders', side=_AFTER)})
SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.firm_id = i.firm_id
    AND h.form_version IS NOT DISTINCT FROM i.form_version AND h.content_hash = i.content_hash)""")
def insert_if_absent_nullsafe(spark, d):
    orders = table(spark, d, "orders")
    held = spark.sql(_FILING.format(orders="{orders}", side=_BEFORE), orders=orders)
    incoming = spark.sql(_FILING.format(orders="{orders}", side=_AFTER), orders=orders)
    return tables.absent_rows(held, incoming, ["firm_id", "form_version", "content_hash"])


@query("new_filings", ctes("filings_raw") + """
SELECT "Organization CRD#" AS firm_id, TRY_CAST("Latest ADV Filing Date" AS TIMESTAMP) AS filing_date,
    CASE WHEN "Form Version" <> 'NA' THEN "Form Version" END AS form_version
FROM filings_raw WHERE TRY_CAST("Latest ADV Filing Date" AS TIMESTAMP) IS NOT NULL AND CAST("Organization CRD#" AS BIGINT) % 3 <> 0 GROUP BY ALL""")
def new_filings(spark, d):
    path = scratch_path(spark, "filings")
    frame(spark, d, "filings_raw").write.option("header", True).csv(path)
    found = files.filings(snapshots.scan_csv(spark, path))
    # A third of the filings are in the store already.
    held = found.filter("CAST(firm_id AS BIGINT) % 3 = 0")
    return enrich.new_filings(held, found).select(
        "firm_id", F.col("filing_date").cast("timestamp_ntz").alias("filing_date"), "form_version"
    )


@query("csv_scan", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, 'He said "' || c_name || '", then left' AS remark,
    CASE WHEN c_nationkey % 2 = 0 THEN 'NA' END AS code, 'Café' AS place FROM customer""")
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "customer").selectExpr(
        "c_custkey", "concat('He said \"', c_name, '\", then left') AS remark",
        "CASE WHEN c_nationkey % 2 = 0 THEN 'NA' END AS code", "'Café' AS place",
    ).write.option("header", True).option("escape", '"').option("encoding", "ISO-8859-1").csv(path)
    return snapshots.scan_csv(spark, path)


@query("raw_replace_version", ctes("scored_old", "scored_new") + """
SELECT firm_id, name, dataset_version, 2 AS load_no FROM scored_new UNION ALL SELECT firm_id, name, dataset_version, 1 FROM scored_old""")
def raw_replace_version(spark, d):
    path = scratch_path(spark, "raw")
    for number, part in ((1, "scored_old"), (1, "scored_new"), (2, "scored_new")):
        rows = frame(spark, d, part).select("firm_id", "name", "dataset_version", F.lit(number).alias("load_no"))
        tables.replace_version(rows, path)
    return snapshots.scan_entity(spark, path)


@query("snapshot_scan", ctes("scored_new") + f"SELECT {_SLIM_SQL}, dataset_version FROM scored_new")
def snapshot_scan(spark, d):
    path = scratch_path(spark, "entity")
    for part in ("scored_old", "scored_new"):
        tables.append_entities(frame(spark, d, part).select(*_SLIM, "dataset_version"), path)
    return snapshots.scan_snapshot(spark, path, NEW)


@query("version_history", f"""
SELECT '{OLD}' AS dataset_version, count(DISTINCT o_custkey) FILTER ({_BEFORE}) AS row_count, DATE '1998-03-31' AS version_date FROM orders
UNION ALL SELECT '{NEW}', count(DISTINCT o_custkey) FILTER ({_AFTER}), DATE '2001-08-01' FROM orders""")
def version_history(spark, d):
    path = scratch_path(spark, "entity")
    tables.append_entities(frame(spark, d, "scored_both").select(*_SLIM, "dataset_version"), path)
    return snapshots.list_versions(snapshots.scan_entity(spark, path))


@query("typed_write_counts", ctes("roster") + f"""
SELECT 'firms' AS entity, count(*) AS row_count FROM ({_FIRM_SQL}) WHERE name IS NOT NULL
UNION ALL SELECT 'firm_offices', count(*) FROM ({_office_sql()}) UNION ALL SELECT 'nothing', 0""")
def typed_write_counts(spark, d):
    parts = _snapshot(spark, d)
    root = scratch_path(spark, "typed")
    entities = {"firms": parts["firms"], "firm_offices": parts["firm_offices"], "nothing": parts["firms"].filter("false")}
    tables.write_entities(entities, root, "ia08152001")
    back = None
    for name in entities:
        counted = snapshots.scan_snapshot(spark, f"{root}/{name}", "ia08152001").agg(F.count(F.lit(1)).alias("row_count"))
        counted = counted.select(F.lit(name).alias("entity"), "row_count")
        back = counted if back is None else back.unionByName(counted)
    return back


_YEARLY = """SELECT strftime(o_orderdate, '%Y') AS dataset_version,
    CASE WHEN o_orderpriority < '3' THEN 'quality' ELSE 'schema_diff' END AS artifact_type, o_totalprice AS quality_score, o_orderstatus AS extra
    FROM orders"""


@query("json_artifacts", f"""
SELECT dataset_version, artifact_type, count(*) AS n, max(quality_score) FILTER (artifact_type = 'quality') AS best,
    min(extra) FILTER (artifact_type = 'schema_diff') AS first_extra FROM ({_YEARLY}) GROUP BY ALL""")
def json_artifacts(spark, d):
    root = scratch_path(spark, "artifacts")
    is_quality = F.col("o_orderpriority") < "3"
    reports = table(spark, d, "orders").select(
        F.date_format("o_orderdate", "yyyy").alias("dataset_version"),
        F.when(is_quality, "quality").otherwise("schema_diff").alias("artifact_type"),
        F.when(is_quality, F.struct(F.col("o_totalprice").alias("quality_score"))).alias("summary"),
        F.when(~is_quality, F.array("o_orderstatus")).alias("extra"),
    )
    tables.write_artifacts(reports, root)
    return files.scan_artifacts(spark, root).groupBy("dataset_version", "artifact_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("summary.quality_score").alias("best"), F.min(F.col("extra")[0]).alias("first_extra")
    )


@query("history_csv", ctes("loads") + """
SELECT dataset_version AS version, strftime(download_timestamp, '%Y-%m-%d') AS date, status, CAST(file_size AS VARCHAR) AS size_bytes,
    coalesce(CAST(nullif(quality_score, 0) AS VARCHAR), 'N/A') AS quality_score FROM loads""")
def history_csv(spark, d):
    path = scratch_path(spark, "history")
    tables.write_history_csv(frame(spark, d, "loads"), path)
    return snapshots.scan_csv(spark, path).withColumn("date", date_key(F.col("date").cast("timestamp")))


@query("json_export", ctes("research") + "SELECT * FROM research")
def json_export(spark, d):
    path, research = scratch_path(spark, "export"), frame(spark, d, "research")
    tables.write_json(research, path)
    return spark.read.schema(research.schema).json(path)


_CHUNK, _PART = 4096, 1000


def _bytes_sql(kind: str, order: str) -> str:
    """The hash of each file of ``_PART`` keys: lines, chunks of lines by where they begin, the file."""
    return f"""
SELECT '{kind}' AS kind, part, sha256(CAST(any_value(size) AS VARCHAR) || ':' || CASE WHEN count(*) = 1 THEN any_value(digest)
    ELSE sha256(string_agg(digest, '' ORDER BY chunk)) END) AS byte_hash, CAST(any_value(size) AS BIGINT) AS file_size
FROM (SELECT part, before // {_CHUNK} AS chunk, any_value(size) AS size, sha256(string_agg(sha256(line), '' ORDER BY place)) AS digest
    FROM (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY part ORDER BY place) - strlen(line) - 1 AS before,
            sum(strlen(line) + 1) OVER (PARTITION BY part) AS size
        FROM (SELECT c_custkey // {_PART} AS part, c_name AS line, row_number() OVER (PARTITION BY c_custkey // {_PART} ORDER BY c_custkey {order}) AS place FROM customer
            UNION ALL SELECT DISTINCT c_custkey // {_PART}, 'name', 0 FROM customer))
    GROUP BY part, chunk) GROUP BY part"""


@query("file_bytes", _bytes_sql("up", "ASC") + " UNION ALL " + _bytes_sql("down", "DESC"))
def file_bytes(spark, d):
    """Files of a thousand keys each; the same rows in another order are another file."""
    found = []
    for kind, order in (("up", F.col("c_custkey").asc()), ("down", F.col("c_custkey").desc())):
        path = scratch_path(spark, "bytes")
        rows = table(spark, d, "customer").select(F.col("c_name").alias("name"), "c_custkey", F.expr(f"c_custkey div {_PART}").alias("part"))
        rows.repartition("part").sortWithinPartitions("part", order).drop("c_custkey").write.option("header", True).partitionBy("part").csv(path)
        hashes = files.byte_hashes(spark, path, _CHUNK)
        found.append(hashes.select(
            F.lit(kind).alias("kind"), F.regexp_extract("file_path", r"part=(\d+)", 1).cast("bigint").alias("part"), "byte_hash", "file_size"
        ))
    return found[0].unionByName(found[1])


@query("file_fingerprint", """
SELECT 'c_custkey|"c,name"|c_mktsegment' AS column_names, CAST(3 AS BIGINT) AS column_count, count(*) AS row_count,
    true AS same_hashes FROM customer""")
def file_fingerprint(spark, d):
    source = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("c,name"), "c_mktsegment")
    found = None
    for order in (F.col("c_custkey").asc(), F.col("c_custkey").desc()):
        path = scratch_path(spark, "fingerprint")
        source.sortWithinPartitions(order).write.option("header", True).csv(path)
        one = files.fingerprint(spark, path)
        found = one if found is None else found.unionByName(one)
    quoted = F.transform("column_names", lambda c: F.when(c.contains(","), F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c))
    # The same rows in another order give the same hash, so each hash comes up twice.
    hashes = found.groupBy(F.concat_ws("|", quoted).alias("column_names"), "column_count", "file_hash").agg(
        F.max("row_count").alias("_rows"), F.count(F.lit(1)).alias("_n")
    )
    return hashes.groupBy("column_names", "column_count").agg(
        F.sum("_rows").alias("row_count"), F.bool_and(F.col("_n") == 2).alias("same_hashes")
    )


@query("arrivals", """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'ia07012026' AS dataset_version FROM customer
UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name, 'ia08012026' FROM supplier""")
def arrivals(spark, d):
    root = scratch_path(spark, "arrivals")
    first = table(spark, d, "customer").select("c_custkey", "c_name")
    second = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    for version, rows in (("ia07012026", first), ("ia08012026", second)):
        rows.write.option("header", True).csv(f"{root}/in/{version}")
        # The second pass takes the new files only.
        load_arrivals(spark, f"{root}/in/*", ["c_custkey", "c_name"], f"{root}/table", f"{root}/progress")
    return spark.read.parquet(f"{root}/table").drop("_wrong_row")


@query("publish_tables", ctes("ranked") + """
SELECT firm_id, dataset_version, acquisition_score, priority_category, 'NOT_RESEARCHED' AS status FROM ranked""")
def publish_tables(spark, d):
    root = scratch_path(spark, "serving")
    # Scored firms are stored before they are published.
    made = serve.serving_tables(
        materialise(frame(spark, d, "ranked")), frame(spark, d, "offices"), "ACQUISITION_V1", F.lit("2001-08-15 12:00:00").cast("timestamp")
    )
    people = {"outreach_targets": made.pop("outreach_targets")}
    for _ in range(2):
        tables.publish(made, people, root)
    key = ["firm_id", "dataset_version"]
    scores = spark.read.parquet(f"{root}/firm_scores").select(*key, "acquisition_score", "priority_category")
    return scores.join(spark.read.parquet(f"{root}/outreach_targets"), key)


@query("publish_operations", ctes("research", "sources") + """
SELECT 'firm_research' AS table_name, firm_id AS key, CASE WHEN length(firm_id) % 2 = 0 THEN 'EDITED' ELSE research_status END AS state,
    NULL AS fixed FROM research
UNION ALL SELECT 'research_sources', CAST(source_id AS VARCHAR), coalesce(source_title, '') || ' again', source_type FROM sources
UNION ALL SELECT 'pipeline_runs', CAST(c_custkey AS VARCHAR), 'done', c_name FROM customer
UNION ALL SELECT 'alerts', CAST(s_suppkey AS VARCHAR), 'open', s_name FROM supplier""")
def publish_operations(spark, d):
    """Published twice; between the two an analyst edits some research, and sources, runs and alerts change."""
    root = scratch_path(spark, "operations")
    # Research is grouped from all orders; it is stored before it is published twice.
    research, sources = materialise(frame(spark, d, "research")), frame(spark, d, "sources")
    runs = table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_name").alias("dataset_version"), F.lit("running").alias("status"))
    alerts = table(spark, d, "supplier").select(F.col("s_suppkey").alias("alert_id"), F.col("s_name").alias("message"), F.lit("open").alias("state"))
    tables.publish_keyed(serve.operations_tables(research, sources, runs, alerts), root)
    edited = F.when(F.length("firm_id") % 2 == 0, "EDITED").otherwise(F.col("research_status"))
    held = read_files(spark, f"{root}/firm_research")
    upsert_files(held.withColumn("research_status", edited), f"{root}/firm_research", serve.FIRM_VERSION)
    again = serve.operations_tables(
        research, sources.withColumns({
            "source_title": F.concat(F.coalesce("source_title", F.lit("")), F.lit(" again")), "source_type": F.lit("other"),
        }),
        runs.withColumns({"status": F.lit("done"), "dataset_version": F.lit("other")}), alerts.withColumn("state", F.lit("new")),
    )
    tables.publish_keyed(again, root)
    shown = {
        "firm_research": ("firm_id", "research_status", F.lit(None)), "research_sources": ("source_id", "source_title", F.col("source_type")),
        "pipeline_runs": ("run_id", "status", F.col("dataset_version")), "alerts": ("alert_id", "state", F.col("message")),
    }
    return reduce(DataFrame.unionByName, [
        read_files(spark, f"{root}/{name}").select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("key"), F.col(state).alias("state"), fixed.cast("string").alias("fixed")
        ) for name, (key, state, fixed) in shown.items()
    ])


@query("change_event_export", EVENTS_SQL + f"""
, numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY firm_id ORDER BY rule) - 1 AS INTEGER) AS position FROM change_events)
SELECT * EXCLUDE (rule), '{NEW}' AS dataset_version FROM numbered""")
def change_event_export(spark, d):
    """All events of a version, written as JSON and read again with all their details."""
    path = scratch_path(spark, "events")
    found = change_events(frame(spark, d, "scored_old"), frame(spark, d, "scored_new"))
    tables.replace_version(found.withColumn("dataset_version", F.lit(NEW)), path, fmt="json")
    return shown_events(spark.read.schema(found.schema.add("dataset_version", "string")).json(path), "position", "dataset_version")


@query("raw_replace_by_nothing", ctes("scored_old") + "SELECT firm_id, name, dataset_version FROM scored_old")
def raw_replace_by_nothing(spark, d):
    """A version that is loaded again and turns out empty is empty."""
    path = scratch_path(spark, "raw")
    new = frame(spark, d, "scored_new").select("firm_id", "name", "dataset_version")
    tables.replace_version(frame(spark, d, "scored_old").select(*new.columns), path)
    tables.replace_version(new, path)
    tables.replace_version(new.limit(0), path, version=NEW)
    return snapshots.scan_entity(spark, path)


@query("csv_union", """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, NULL AS extra, CAST(c_custkey % 2 AS VARCHAR) AS half FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, CAST(c_custkey % 2 AS VARCHAR) FROM customer WHERE c_custkey % 2 = 1""")
def csv_union(spark, d):
    """Files of one folder with other column orders and a surplus column."""
    path = scratch_path(spark, "csv_union")
    rows = table(spark, d, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS extra", "c_custkey % 2 AS half")
    rows.filter("half = 0").select("id", "name", "half").write.mode("append").option("header", True).csv(path)
    rows.filter("half = 1").select("extra", "half", "name", "id").write.mode("append").option("header", True).csv(path)
    return snapshots.scan_csv_union(spark, path).select("id", "name", "extra", "half")


@query("column_sample", "SELECT least(100, count(text)) AS n, true AS filled FROM documents")
def column_sample(spark, d):
    # Which rows come is not defined; how many, and that none is NULL, is.
    sample = snapshots.column_sample(table(spark, d, "documents"), "text")
    return sample.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("value").isNotNull()).alias("filled"))


@query("unique_words", """
SELECT doc_id, CAST(len(list_distinct(string_split(text, ' '))) AS INTEGER) AS words, string_split(text, ' ')[1] AS first_word FROM documents""")
def unique_words(spark, d):
    words = unique_in_order(F.split("text", " ", -1))
    return table(spark, d, "documents").select("doc_id", F.size(words).alias("words"), words[0].alias("first_word"))
