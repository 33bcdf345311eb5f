"""Rollups, pages, serving tables, dossiers and lineage."""

import re

from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.operators import lineage, profile, rollup, serve
from snaplake.plans.inputs import NEW, ctes, frame, table
from snaplake.plans.registry import query
from snaplake.session import scratch_path
from snaplake.sources.files import flat_artifacts, parse_log, scan_artifacts

# ------------------------------------------------------------------- rollups
_METRICS = """count(*) AS attempts, count(*) FILTER (status = 'success') AS successful, count(*) FILTER (status = 'failed') AS failed,
    count(*) FILTER (status = 'skipped') AS skipped, round(count(*) FILTER (status = 'success') / count(*) * 100, 4) AS success_rate,
    CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_file_size, round(avg(file_size), 4) AS avg_file_size,
    round(avg(quality_score), 4) AS avg_quality_score, CAST(coalesce(sum(checks_failed), 0) AS BIGINT) AS total_warnings,
    count(dataset_version) AS datasets_processed, max(download_timestamp) AS latest_ingestion,
    last(dataset_version ORDER BY download_timestamp NULLS FIRST, dataset_version) AS latest_dataset"""


@query("daily_rollup", ctes("loads") + f"SELECT strftime(download_timestamp, '%Y-%m-%d') AS day, {_METRICS} FROM loads WHERE download_timestamp IS NOT NULL GROUP BY 1")
def daily_rollup(spark, d):
    return rollup.daily(frame(spark, d, "loads"))


@query("monthly_rollup", ctes("loads") + f"SELECT strftime(download_timestamp, '%Y-%m') AS month, {_METRICS} FROM loads WHERE download_timestamp IS NOT NULL GROUP BY 1")
def monthly_rollup(spark, d):
    return rollup.monthly(frame(spark, d, "loads"))


@query("historical_rollup", ctes("loads") + f"""
SELECT month, CASE WHEN grouping(month) = 1 THEN 'all' ELSE 'month' END AS level, {_METRICS}
FROM (SELECT *, strftime(download_timestamp, '%Y-%m') AS month FROM loads) GROUP BY ROLLUP (month)
HAVING grouping(month) = 1 OR month IS NOT NULL""")
def historical_rollup(spark, d):
    return rollup.historical(frame(spark, d, "loads"))


@query("period_members", ctes("loads") + "SELECT strftime(download_timestamp, '%Y-%m') AS month, dataset_version, status, download_timestamp FROM loads WHERE download_timestamp IS NOT NULL")
def period_members(spark, d):
    return rollup.period_members(frame(spark, d, "loads"))


_SUMMARY = ctes("registry", "artifacts") + ", summary AS (" + """
SELECT r.*, coalesce(q.quality_score, p.quality_score) AS quality_score, coalesce(q.passed, p.passed) AS checks_passed,
    coalesce(q.failed, p.failed) AS checks_failed, s.missing AS missing_columns, s.extra AS extra_columns,
    c.added AS added_count, c.modified AS modified_count, coalesce(n.n, 0) AS artifact_count, coalesce(n.nq, 0) AS quality_artifacts
FROM registry r
LEFT JOIN (SELECT dataset_version, count(*) AS n, count(*) FILTER (artifact_type = 'quality') AS nq FROM artifacts GROUP BY 1) n USING (dataset_version)
""" + "".join(
    f"LEFT JOIN (SELECT * FROM artifacts WHERE artifact_type = '{kind}' QUALIFY row_number() OVER "
    f"(PARTITION BY dataset_version ORDER BY written_at DESC, artifact_id DESC) = 1) {alias} USING (dataset_version)\n"
    for kind, alias in (("quality", "q"), ("profiling", "p"), ("schema_diff", "s"), ("change_detection", "c"))
) + ")\n"


def _summaries(spark, d):
    return rollup.dataset_summaries(frame(spark, d, "registry"), frame(spark, d, "artifacts"))


@query("dataset_summary", _SUMMARY + "SELECT * FROM summary")
def dataset_summary(spark, d):
    return _summaries(spark, d)


@query("artifact_history", _SUMMARY + f"""
SELECT month, CASE WHEN grouping(month) = 1 THEN 'all' ELSE 'month' END AS level, {_METRICS}, CAST(sum(event_id % 100) AS BIGINT) AS total_raw_rows,
    CAST(coalesce(sum(CASE WHEN event_id % 2 = 0 THEN event_id % 90 END), 0) AS BIGINT) AS total_typed_rows
FROM (SELECT *, strftime(download_timestamp, '%Y-%m') AS month FROM summary) GROUP BY ROLLUP (month) HAVING grouping(month) = 1 OR month IS NOT NULL""")
def artifact_history(spark, d):
    """Reports written as nested documents, scanned, flattened, joined to the registry and rolled up."""
    root, kind = scratch_path(spark, "reports"), F.col("artifact_type")
    quality = [F.col("quality_score"), F.col("passed"), F.col("failed")]
    changes = F.struct(F.col("added").alias("added_count"), F.col("modified").alias("modified_count"))
    names = lambda c: F.when(kind == "schema_diff", F.array_repeat(F.lit("column"), F.col(c).cast("int"))).alias(c)
    frame(spark, d, "artifacts").select(
        "dataset_version", "artifact_id", "written_at", "artifact_type",
        F.when(kind == "quality", F.to_json(F.struct(*quality))).when(kind == "change_detection", F.to_json(changes)).alias("_summary"),
        F.when(kind == "profiling", F.struct(quality[0], quality[1].alias("checks_passed"), quality[2].alias("checks_failed"))).alias("quality"),
        names("missing"), names("extra"),
    ).withColumn("summary", F.from_json("_summary", "quality_score double, passed long, failed long, added_count long, modified_count long")).drop(
        "_summary"
    ).write.partitionBy("artifact_type").json(root)
    rows = frame(spark, d, "registry").withColumns({
        "raw_rows": F.col("event_id") % 100, "typed_rows": F.when(F.col("event_id") % 2 == 0, F.col("event_id") % 90),
    })
    return rollup.historical(rollup.dataset_summaries(rows, flat_artifacts(scan_artifacts(spark, root))))


@query("change_history", _SUMMARY + """
SELECT dataset_version, missing_columns, extra_columns, added_count, modified_count FROM summary
WHERE missing_columns IS NOT NULL OR added_count IS NOT NULL""")
def change_history(spark, d):
    return rollup.change_history(_summaries(spark, d))


@query("executions", ctes("registry") + """
SELECT dataset_version, status, download_timestamp, file_size, CAST(NULL AS DOUBLE) AS execution_time FROM registry""")
def executions(spark, d):
    return rollup.executions(frame(spark, d, "registry"))


@query("artifact_counts", ctes("artifacts") + "SELECT artifact_type, count(*) AS n FROM artifacts GROUP BY 1")
def artifact_counts(spark, d):
    return rollup.artifact_counts(frame(spark, d, "artifacts"))


@query("artifact_summary", ctes("artifacts") + """
SELECT count(*) AS artifact_count, (SELECT string_agg(artifact_type, '|' ORDER BY artifact_type)
    FROM (SELECT DISTINCT artifact_type FROM artifacts)) AS artifact_types FROM artifacts""")
def artifact_summary(spark, d):
    return profile.artifact_summary(frame(spark, d, "artifacts"))


_LOG = ctes("log_lines") + """, log AS (SELECT split_part(value, ' | ', 1) AS ts, split_part(value, ' | ', 2) AS level,
    substr(value, length(split_part(value, ' | ', 1)) + length(split_part(value, ' | ', 2)) + 7) AS message
    FROM log_lines WHERE len(string_split(value, ' | ')) >= 3)
"""


@query("log_parse", _LOG + "SELECT * FROM log")
def log_parse(spark, d):
    return parse_log(frame(spark, d, "log_lines"))


@query("log_metrics", _LOG + """, run AS (SELECT *, TRY_CAST(replace(split_part(message, '|', 3), 's', '') AS DOUBLE) AS sec FROM log WHERE starts_with(message, 'EXEC|'))
SELECT count(*) AS total_executions, count(*) FILTER (contains(message, 'SUCCESS')) AS successful,
    count(*) FILTER (contains(message, 'FAILED')) AS failed,
    round(count(*) FILTER (contains(message, 'SUCCESS')) / count(*) * 100, 4) AS success_rate,
    round(avg(sec), 4) AS avg_seconds, min(sec) AS min_seconds, max(sec) AS max_seconds, (SELECT max(ts) FROM log) AS last_entry FROM run""")
def log_metrics(spark, d):
    return rollup.log_metrics(parse_log(frame(spark, d, "log_lines")))


# --------------------------------------------------------------------- pages
@query("category_counts", ctes("scored_both") + "SELECT priority_category, count(*) AS n FROM scored_both GROUP BY 1")
def category_counts(spark, d):
    return rollup.category_counts(frame(spark, d, "scored_both"), "priority_category")


_NEWEST = "dataset_version = (SELECT last(dataset_version ORDER BY published_at) FROM published)"


@query("newest_version_rows", ctes("scored_both", "published") + f"SELECT firm_id, dataset_version, name FROM scored_both WHERE {_NEWEST}")
def newest_version_rows(spark, d):
    firms = frame(spark, d, "scored_both").select("firm_id", "dataset_version", "name")
    return serve.newest_version_rows(firms, frame(spark, d, "published"))


_PAGED = ctes("ranked", "published") + f", found AS (SELECT * FROM ranked WHERE {_NEWEST} AND (name ILIKE '%00%' OR firm_id ILIKE '%00%'))\n"


def _found(spark, d):
    return serve.search(serve.newest_version_rows(frame(spark, d, "ranked"), frame(spark, d, "published")), "00")


@query("page", _PAGED + """
SELECT firm_id, name, acquisition_score, total_aum FROM found ORDER BY acquisition_score DESC NULLS LAST, firm_id LIMIT 25 OFFSET 50""")
def page(spark, d):
    return serve.page(_found(spark, d), "acquisition_score", 3).select("firm_id", "name", "acquisition_score", "total_aum")


@query("page_ascending", _PAGED + """
SELECT firm_id, organization_type FROM found ORDER BY organization_type ASC NULLS LAST, firm_id LIMIT 100 OFFSET 0""")
def page_ascending(spark, d):
    return serve.page(_found(spark, d), "organization_type", 0, 500, descending=False).select("firm_id", "organization_type")


@query("page_total", _PAGED + "SELECT count(*) AS total, CAST(ceil(count(*) / 25) AS BIGINT) AS pages FROM found")
def page_total(spark, d):
    return serve.page_total(_found(spark, d))


@query("page_with_total", _PAGED + """
SELECT firm_id, acquisition_score, (SELECT count(*) FROM found) AS total_count FROM found
ORDER BY acquisition_score DESC NULLS LAST, firm_id LIMIT 25""")
def page_with_total(spark, d):
    return serve.page_with_total(_found(spark, d).select("firm_id", "acquisition_score"), "acquisition_score")


@query("latest_n", ctes("registry") + "SELECT * FROM registry ORDER BY download_timestamp DESC, dataset_version DESC LIMIT 100")
def latest_n(spark, d):
    order = [F.col("download_timestamp").desc(), F.col("dataset_version").desc()]
    return serve.latest_rows(frame(spark, d, "registry"), order, 100)


@query("list_all", ctes("registry") + "SELECT * FROM registry")
def list_all(spark, d):
    return frame(spark, d, "registry").orderBy(F.col("download_timestamp").desc())


@query("current_dataset", ctes("registry") + """
SELECT * FROM registry WHERE status = 'success' ORDER BY download_timestamp DESC, dataset_version DESC LIMIT 1""")
def current_dataset(spark, d):
    return serve.current_dataset(frame(spark, d, "registry"))


@query("candidates", ctes("ranked") + """
SELECT firm_id, dataset_version, acquisition_score FROM ranked WHERE acquisition_score >= 50 AND dataset_version = 'ia08012001'
ORDER BY acquisition_score DESC, firm_id LIMIT 100""")
def candidates(spark, d):
    new = frame(spark, d, "ranked").filter(F.col("dataset_version") == NEW)
    return serve.candidates(new).select("firm_id", "dataset_version", "acquisition_score")


@query("latest_per_key", ctes("scored_both") + """
SELECT * FROM scored_both QUALIFY row_number() OVER (PARTITION BY firm_id
    ORDER BY strptime(substr(dataset_version, 3), '%m%d%Y') DESC) = 1""")
def latest_per_key(spark, d):
    return serve.latest_per_key(frame(spark, d, "scored_both"), ["firm_id"])


@query("transitions", """
SELECT user_id, from_status, event_type AS to_status, ts AS changed_at, event_id FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_status FROM events)
WHERE from_status IS DISTINCT FROM event_type""")
def transitions(spark, d):
    return serve.transitions(table(spark, d, "events"), "user_id", "event_type", "ts", "event_id")


@query("version_links", ctes("registry") + """
SELECT dataset_version, lag(dataset_version) OVER w AS prev_version, lead(dataset_version) OVER w AS next_version
FROM registry WINDOW w AS (ORDER BY download_timestamp, event_id)""")
def version_links(spark, d):
    return lineage.version_links(frame(spark, d, "registry"), "dataset_version", "download_timestamp", "event_id").select(
        "dataset_version", "prev_version", "next_version"
    )


@query("last_activity", ctes("outreach", "activities") + """
SELECT o.*, a.last_activity_at FROM outreach o LEFT JOIN
    (SELECT firm_id, max(occurred_at) AS last_activity_at FROM activities GROUP BY 1) a USING (firm_id)""")
def last_activity(spark, d):
    return serve.last_activity(frame(spark, d, "outreach"), frame(spark, d, "activities"), "firm_id", "occurred_at")


_OVERVIEW = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, {c} AS category, count(*) AS n FROM {t} WHERE {_NEWEST} GROUP BY 2"
    for m, c, t in (("priority", "priority_category", "scored_both"), ("research", "research_status", "research"), ("outreach", "status", "outreach"))
)


@query("overview", ctes("scored_both", "research", "outreach", "published") + _OVERVIEW + f"""
UNION ALL SELECT 'priority', 'A+B', count(*) FROM scored_both WHERE {_NEWEST} AND priority_category IN ('PRIORITY_A', 'PRIORITY_B')""")
def overview(spark, d):
    return serve.overview(
        frame(spark, d, "scored_both"), frame(spark, d, "research"), frame(spark, d, "outreach"), frame(spark, d, "published")
    )


# ------------------------------------------------------------ serving tables
def _serving(spark, d):
    return serve.serving_tables(
        frame(spark, d, "ranked").withColumn("reason_codes", F.lit('["X"]')), frame(spark, d, "offices"),
        "ACQUISITION_V1", F.lit("2001-08-15 12:00:00").cast("timestamp_ntz"),
    )


@query("serve_versions", ctes("ranked") + """
SELECT dataset_version, substr(dataset_version, 3) AS dataset_date, 'ACQUISITION_V1' AS score_version,
    CAST(sum(n) AS BIGINT) AS silver_rows, CAST(sum(n) AS BIGINT) AS gold_rows,
    '{' || string_agg('"' || priority_category || '":' || n, ',' ORDER BY priority_category) || '}' AS priority_counts,
    TIMESTAMP '2001-08-15 12:00:00' AS published_at
FROM (SELECT dataset_version, priority_category, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY dataset_version""")
def serve_versions(spark, d):
    return _serving(spark, d)["dataset_versions"]


@query("serve_firms", ctes("ranked") + """
SELECT firm_id, dataset_version, name, website_address, organization_state, CAST(NULL AS VARCHAR) AS sec_number FROM ranked""")
def serve_firms(spark, d):
    return _serving(spark, d)["firms"].select(
        "firm_id", "dataset_version", "name", "website_address", "organization_state", "sec_number"
    )


@query("serve_facts", ctes("ranked", "offices") + """
SELECT firm_id, dataset_version, total_aum, employee_count, has_item_11_disclosure, street_address_1 AS main_office_street_address_1,
    state AS main_office_state FROM ranked LEFT JOIN (SELECT * FROM offices WHERE office_type = 'MAIN'
    QUALIFY row_number() OVER (PARTITION BY firm_id, dataset_version ORDER BY street_address_1) = 1) USING (firm_id, dataset_version)""")
def serve_facts(spark, d):
    return _serving(spark, d)["firm_facts"].select(
        "firm_id", "dataset_version", "total_aum", "employee_count", "has_item_11_disclosure",
        "main_office_street_address_1", "main_office_state",
    )


@query("serve_scores", ctes("ranked") + """
SELECT firm_id, dataset_version, acquisition_score, priority_category, '["X"]' AS reason_codes, CAST(NULL AS VARCHAR) AS component_scores FROM ranked""")
def serve_scores(spark, d):
    return _serving(spark, d)["firm_scores"].select(
        "firm_id", "dataset_version", "acquisition_score", "priority_category", "reason_codes", "component_scores"
    )


@query("serve_outreach", ctes("ranked") + "SELECT firm_id, dataset_version, 'NOT_RESEARCHED' AS status FROM ranked")
def serve_outreach(spark, d):
    return _serving(spark, d)["outreach_targets"]


# ---------------------------------------------------- documents about a firm


@query("firm_detail", ctes("scored_both", "research", "sources", "contacts", "outreach", "activities") + """
SELECT firm_id, 'firm' AS section, '' AS sort_key, '{"dataset_version":"' || last(dataset_version ORDER BY strptime(substr(dataset_version, 3), '%m%d%Y')) || '","name":"' || last(name) || '"}' AS payload FROM scored_both GROUP BY 1
UNION ALL SELECT firm_id, 'facts', '', '{"employee_count":' || last(employee_count ORDER BY strptime(substr(dataset_version, 3), '%m%d%Y')) || '}' FROM scored_both GROUP BY 1
UNION ALL SELECT firm_id, 'scores', '', '{"priority_category":"' || last(priority_category ORDER BY strptime(substr(dataset_version, 3), '%m%d%Y')) || '"}' FROM scored_both GROUP BY 1
UNION ALL SELECT firm_id, 'research', '', '{"research_status":"' || research_status || '"}' FROM research
UNION ALL SELECT firm_id, 'sources', accessed_at, '{"source_id":' || source_id || '}' FROM sources
UNION ALL SELECT firm_id, 'contacts', contact_name, '{"email":' || coalesce('"' || email || '"', 'null') || '}' FROM contacts
UNION ALL SELECT firm_id, 'outreach', '', '{"status":"' || last(status ORDER BY strptime(substr(dataset_version, 3), '%m%d%Y')) || '"}' FROM outreach GROUP BY 1
UNION ALL SELECT firm_id, 'activities', strftime(occurred_at, '%Y-%m-%d'), '{"activity_type":"' || activity_type || '"}' FROM activities""")
def firm_detail(spark, d):
    both = frame(spark, d, "scored_both")
    v = ["firm_id", "dataset_version"]
    detail = serve.firm_detail(
        both.select(*v, "name"), both.select(*v, "employee_count"), both.select(*v, "priority_category"),
        frame(spark, d, "research").select(*v, "research_status"),
        frame(spark, d, "sources").select("firm_id", "source_id", "accessed_at"),
        frame(spark, d, "contacts").select("firm_id", "contact_name", "email"),
        frame(spark, d, "outreach"),
        frame(spark, d, "activities").select("firm_id", "activity_type", "occurred_at"),
    )
    # The engines print JSON times differently: compare one field of each section and the day.
    shown = {
        "facts": "employee_count", "scores": "priority_category", "research": "research_status", "sources": "source_id",
        "contacts": "email", "outreach": "status", "activities": "activity_type",
    }
    payload = F.col("payload")
    for section, field in shown.items():
        part = F.regexp_extract("payload", f'"{field}":("[^"]*"|[^,}}]*)', 1)
        payload = F.when(F.col("section") == section, F.concat(F.lit(f'{{"{field}":'), part, F.lit("}"))).otherwise(payload)
    keyed = F.when(F.col("section").isin("sources", "contacts"), F.col("sort_key")).when(
        F.col("section") == "activities", F.substring("sort_key", 1, 10)
    ).otherwise("")
    return detail.select("firm_id", "section", keyed.alias("sort_key"), payload.alias("payload"))




_SCORED_FIELDS = {
    "firm_id", "dataset_version", "name", "total_aum", "discretionary_aum", "total_account_count", "discretionary_account_count",
    "employee_count", "advisory_employee_count", "has_item_11_disclosure", "provides_financial_planning",
    "advises_individuals_or_small_businesses", "organization_type", "organization_state", "priority_category", "acquisition_score",
}
_RESEARCH_FIELDS = {"research_status", "founder_name", "estimated_revenue"}


def _dossier_line(line: str) -> str:
    """A template line as SQL text, written apart from the operator's own rendering."""
    def cash(x: str) -> str:
        return (f"CASE WHEN {x} IS NULL THEN 'Unknown' WHEN abs({x}) >= 1000000 THEN printf('$%.1fM', {x} / 1000000) "
                f"ELSE '$' || format('{{:,.0f}}', {x}) END")

    def shown(hit: re.Match) -> str:
        kind, name, default = hit.group(1), hit.group(2), hit.group(3) or "Unknown"
        side, known = ("r", _RESEARCH_FIELDS) if kind in ("r", "rcash") else ("f", _SCORED_FIELDS)
        if kind == "house":
            x = "'We'"
        elif kind == "generated_at":
            x = "'2001-08-15T12:00:00Z'"
        elif kind == "share":
            x = "coalesce(printf('%.1f%%', f.discretionary_aum / f.total_aum * 100), 'Unknown')"
        elif name not in known:
            x = f"'{default}'"
        elif kind in ("cash", "rcash"):
            x = cash(f"{side}.{name}")
        else:
            x = f"coalesce(nullif(CAST({side}.{name} AS VARCHAR), ''), '{default}')"
        return f"' || {x} || '"

    return "'" + re.sub(r"\{(\w+)(?::(\w+))?(?:\|([^}]*))?\}", shown, line) + "'"


def _dossier_block(line: str) -> str:
    if line == "{codes}":
        return "['- A', '- B']"
    if line == "{draft}":
        return f"['{fv.DRAFT_NOTICE}', '']"
    return f"[{_dossier_line(line)}]"


def _dossier_part(section: int, template: str) -> str:
    lines = " || ".join(_dossier_block(line) for line in template.splitlines())
    return f"""SELECT firm_id, dataset_version, CAST({section} AS BIGINT) AS section, unnest(range(len(lines))) AS line_no, unnest(lines) AS line
    FROM (SELECT f.firm_id, f.dataset_version, {lines} AS lines FROM ranked f JOIN research r USING (firm_id, dataset_version))"""


@query("dossier", ctes("ranked", "research", "sources") + f"""
{_dossier_part(1, fv.DOSSIER_TEMPLATE)}
UNION ALL SELECT firm_id, dataset_version, 2, source_id, '- [' || coalesce(source_title, source_url, source_type) || '](' || coalesce(source_url, '')
    || ') — supports `' || field_supported || '`; accessed ' || coalesce(accessed_at, 'unknown') || '.'
    FROM sources SEMI JOIN research USING (firm_id, dataset_version) SEMI JOIN ranked USING (firm_id, dataset_version)
UNION ALL SELECT firm_id, dataset_version, 2, 0, '- No sources recorded.' FROM ranked SEMI JOIN research USING (firm_id, dataset_version)
    ANTI JOIN sources USING (firm_id, dataset_version)
UNION ALL {_dossier_part(3, fv.DOSSIER_TAIL)}""")
def dossier(spark, d):
    return serve.dossier_lines(
        frame(spark, d, "ranked").withColumn("reason_codes", F.lit('["A","B"]')), frame(spark, d, "research"),
        frame(spark, d, "sources"), "2001-08-15T12:00:00Z", draft=True,
    )


# ------------------------------------------------------------------- lineage
_CLOSURE = ctes("lineage").replace("WITH ", "WITH RECURSIVE ", 1) + """
, closure AS (SELECT id AS descendant, parent AS ancestor, CAST(1 AS BIGINT) AS distance FROM lineage WHERE parent IS NOT NULL
    UNION ALL SELECT c.descendant, l.parent, c.distance + 1 FROM closure c JOIN lineage l ON l.id = c.ancestor WHERE l.parent IS NOT NULL)
"""


@query("lineage_closure", _CLOSURE + "SELECT * FROM closure")
def lineage_closure(spark, d):
    return lineage.ancestry(frame(spark, d, "lineage"))


@query("lineage_of_version", _CLOSURE + """
SELECT ancestor AS id, -distance AS distance FROM closure WHERE descendant = 40
UNION ALL SELECT 40, 0 UNION ALL SELECT descendant, distance FROM closure WHERE ancestor = 40""")
def lineage_of_version(spark, d):
    asked = spark.range(40, 41)
    return lineage.lineage_of(frame(spark, d, "lineage"), asked).select("id", "distance")


@query("lineage_integrity", ctes("broken_lineage") + """
SELECT id, 'parent' AS link, parent AS target FROM broken_lineage WHERE parent NOT IN (SELECT id FROM broken_lineage)
UNION ALL SELECT id, 'prev', prev FROM broken_lineage WHERE prev NOT IN (SELECT id FROM broken_lineage)
UNION ALL SELECT id, 'next', next FROM broken_lineage WHERE next NOT IN (SELECT id FROM broken_lineage)""")
def lineage_integrity(spark, d):
    return lineage.broken_links(
        frame(spark, d, "broken_lineage"), "id", {"parent": "parent", "prev": "prev", "next": "next"}
    )


@query("lineage_children", ctes("lineage", "broken_lineage") + """
SELECT c.parent AS id, c.id AS child FROM lineage c JOIN broken_lineage b ON b.id = c.id
WHERE c.parent IS NOT NULL AND b.parent IS DISTINCT FROM c.parent""")
def lineage_children(spark, d):
    claimed = frame(spark, d, "lineage").filter("parent IS NOT NULL").select(F.col("parent").alias("id"), F.col("id").alias("child"))
    return lineage.broken_children(frame(spark, d, "broken_lineage"), claimed)


@query("head_version", ctes("lineage") + "SELECT last(id ORDER BY created_at, id) AS head FROM lineage")
def head_version(spark, d):
    return lineage.head_version(frame(spark, d, "lineage"), "id", "created_at", "id")


@query("register_check", ctes("lineage", "broken_lineage") + """
, known AS (SELECT * FROM lineage WHERE created_at < TIMESTAMP '1998-04-01')
SELECT id, parent, CASE WHEN id IN (SELECT id FROM known) THEN 'duplicate version' ELSE 'unknown parent' END AS error
FROM broken_lineage WHERE id IN (SELECT id FROM known) OR (parent IS NOT NULL AND parent NOT IN (SELECT id FROM known))""")
def register_check(spark, d):
    known = frame(spark, d, "lineage").filter("created_at < TIMESTAMP '1998-04-01 00:00:00'")
    return lineage.registration_errors(known, frame(spark, d, "broken_lineage").select("id", "parent"))
