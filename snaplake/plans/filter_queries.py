"""Filters, row rules, joins and evidence."""

from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.rules import domain_violations
from snaplake.functions.typing import iso_timestamp
from snaplake.operators import enrich, events, quality, rollup, serve
from snaplake.plans.inputs import NEW, ctes, frame, table
from snaplake.plans.registry import query


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# ------------------------------------------------------------------- filters
@query("search_filter", "SELECT * FROM part WHERE p_name ILIKE '%Ring%' OR CAST(p_partkey AS VARCHAR) ILIKE '%Ring%'")
def search_filter(spark, d):
    parts = table(spark, d, "part").withColumn("key", F.col("p_partkey").cast("string"))
    return serve.search(parts, "Ring", ("p_name", "key")).drop("key")


@query("optional_filters", "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def optional_filters(spark, d):
    return enrich.matching(
        table(spark, d, "orders"), o_orderstatus="F", o_orderpriority="1-URGENT", o_custkey=None
    )


@query("in_list_filter", ctes("scored_both") + "SELECT * FROM scored_both WHERE priority_category IN ('PRIORITY_A', 'PRIORITY_B')")
def in_list_filter(spark, d):
    return enrich.selected_targets(frame(spark, d, "scored_both"), ("PRIORITY_A", "PRIORITY_B"))


@query("date_range", ctes("registry") + """
SELECT * FROM registry WHERE download_timestamp >= TIMESTAMP '2024-01-10' AND download_timestamp < TIMESTAMP '2024-01-21'""")
def date_range(spark, d):
    return rollup.between_dates(frame(spark, d, "registry"), "2024-01-10", "2024-01-20")


@query("iso_dates", ctes("records") + """
SELECT record_id, CAST(CASE WHEN regexp_matches(trim(last_researched_at), '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]|$)') THEN TRY_CAST(last_researched_at AS TIMESTAMPTZ) END AS TIMESTAMP) AS researched_at FROM records""")
def iso_dates(spark, d):
    return frame(spark, d, "records").select(
        "record_id", iso_timestamp(F.col("last_researched_at")).cast("timestamp_ntz").alias("researched_at")
    )


@query("key_lookup", "SELECT * FROM lineitem WHERE l_orderkey = 77")
def key_lookup(spark, d):
    return enrich.matching(table(spark, d, "lineitem"), l_orderkey=77)


@query("band_filter", ctes("scored_both") + "SELECT firm_id, dataset_version, total_aum FROM scored_both WHERE total_aum BETWEEN 20000000 AND 100000000")
def band_filter(spark, d):
    return frame(spark, d, "scored_both").filter(events.in_band(F.col("total_aum"))).select(
        "firm_id", "dataset_version", "total_aum"
    )


# --------------------------------------------------------------------- rules
def _joined(*cases: str) -> str:
    return f"array_to_string(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL), '|')"


@query("record_rules", ctes("records") + f"""
SELECT record_id, {_joined(
    f"CASE WHEN research_status IS NULL OR research_status NOT IN ({_in(fv.RESEARCH_STATUSES)}) THEN 'research_status' END",
    f"CASE WHEN ownership_confidence <> '' AND ownership_confidence NOT IN ({_in(fv.CONFIDENCE_LEVELS)}) THEN 'ownership_confidence' END",
    f"CASE WHEN succession_signal_strength <> '' AND succession_signal_strength NOT IN ({_in(fv.ASSESSMENT_LEVELS)}) THEN 'succession_signal_strength' END",
    "CASE WHEN estimated_revenue < 0 THEN 'estimated_revenue' END",
    "CASE WHEN estimated_valuation_low < 0 THEN 'estimated_valuation_low' END",
    "CASE WHEN estimated_valuation_high < 0 THEN 'estimated_valuation_high' END",
    "CASE WHEN estimated_valuation_low > estimated_valuation_high THEN 'valuation_range' END",
    "CASE WHEN NOT regexp_matches(last_researched_at, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]|$)') "
    "OR TRY_CAST(last_researched_at AS TIMESTAMPTZ) IS NULL THEN 'last_researched_at' END",
)} AS violations FROM records""")
def record_rules(spark, d):
    return enrich.judged_records(frame(spark, d, "records")).select(
        "record_id", F.array_join("violations", "|").alias("violations")
    )


@query("observation_rules", ctes("observations") + f"""
SELECT violations, count(*) AS n FROM (SELECT {_joined(
    f"CASE WHEN value_type NOT IN ({_in(fv.OBSERVATION_VALUE_TYPES)}) THEN 'value_type' END",
    f"CASE WHEN confidence NOT IN ({_in(fv.CONFIDENCE_LEVELS)}) THEN 'confidence' END",
    f"CASE WHEN review_status NOT IN ({_in(fv.OBSERVATION_STATUSES)}) THEN 'review_status' END",
    "CASE WHEN canonical_field = '' THEN 'canonical_field' END",
)} AS violations FROM observations) GROUP BY 1""")
def observation_rules(spark, d):
    judged = enrich.judged_observations(frame(spark, d, "observations"))
    return judged.groupBy(F.array_join("violations", "|").alias("violations")).agg(F.count(F.lit(1)).alias("n"))


@query("observations_by_status", ctes("observations") + "SELECT * FROM observations WHERE review_status = 'ACCEPTED'")
def observations_by_status(spark, d):
    return enrich.matching(frame(spark, d, "observations"), review_status="ACCEPTED")


_STATE = "CASE WHEN c_custkey % 3 = 0 THEN 'NY' WHEN c_custkey % 3 = 1 THEN left(c_mktsegment, 2) ELSE '' END"
_STATUS = "CASE c_mktsegment WHEN 'BUILDING' THEN 'merged' WHEN 'MACHINERY' THEN 'gone' END"


@query("domain_rules", f"""
SELECT c_custkey, {_joined(
    f"CASE WHEN s <> '' AND s NOT IN ({_in(fv.STATE_CODES)}) THEN 'state' END",
    "CASE WHEN c_custkey * 700 NOT BETWEEN 1000 AND 999999 THEN 'id_number' END",
    f"CASE WHEN t NOT IN ({_in(fv.FIRM_STATUSES)}) THEN 'status' END",
)} AS violations FROM (SELECT c_custkey, {_STATE} AS s, {_STATUS} AS t FROM customer)""")
def domain_rules(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey", f"{_STATE} AS s", f"{_STATUS} AS t", "CAST(c_custkey * 700 AS STRING) AS number"
    ).select(
        "c_custkey",
        F.array_join(domain_violations(F.col("s"), F.col("number"), F.col("t")), "|").alias("violations"),
    )


# --------------------------------------------------------------------- joins
@query("join_inner_composite", ctes("scored_both", "outreach") + """
SELECT firm_id, dataset_version, name, total_aum, status FROM scored_both JOIN outreach USING (firm_id, dataset_version)""")
def join_inner_composite(spark, d):
    firms = frame(spark, d, "scored_both").select("firm_id", "dataset_version", "name", "total_aum")
    return serve.with_details(firms, frame(spark, d, "outreach"))


@query("join_left_chain", ctes("scored_both", "ranked", "research", "outreach") + """
SELECT firm_id, dataset_version, name, acquisition_score, research_status, status
FROM scored_both f JOIN (SELECT firm_id, dataset_version, acquisition_score FROM ranked) s USING (firm_id, dataset_version)
LEFT JOIN (SELECT firm_id, dataset_version, research_status FROM research) r USING (firm_id, dataset_version)
LEFT JOIN outreach USING (firm_id, dataset_version)""")
def join_left_chain(spark, d):
    key = ["firm_id", "dataset_version"]
    return serve.with_details(
        frame(spark, d, "scored_both").select(*key, "name"),
        frame(spark, d, "ranked").select(*key, "acquisition_score"),
        frame(spark, d, "research").select(*key, "research_status"),
        frame(spark, d, "outreach"),
    )


@query("child_counts", ctes("research", "sources") + """
SELECT r.firm_id, r.dataset_version, r.research_status, count(s.source_id) AS sources
FROM research r LEFT JOIN sources s USING (firm_id, dataset_version) GROUP BY ALL""")
def child_counts(spark, d):
    records = frame(spark, d, "research").select("firm_id", "dataset_version", "research_status")
    return enrich.child_counts(records, frame(spark, d, "sources"), ["firm_id", "dataset_version"], "sources")


_PARENTS = "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"


def _parents(spark, d):
    return table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'")


@query("anti_broken_refs", f"SELECT * FROM orders WHERE o_custkey NOT IN ({_PARENTS})")
def anti_broken_refs(spark, d):
    return quality.broken_references(table(spark, d, "orders"), _parents(spark, d), "o_custkey", "c_custkey")


@query("anti_broken_ref_counts", f"""
SELECT o_custkey, count(*) AS child_rows FROM orders WHERE o_custkey NOT IN ({_PARENTS}) GROUP BY 1""")
def anti_broken_ref_counts(spark, d):
    return quality.broken_reference_counts(table(spark, d, "orders"), _parents(spark, d), "o_custkey", "c_custkey")


@query("anti_orphans", """
SELECT * FROM customer WHERE c_custkey NOT IN
    (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def anti_orphans(spark, d):
    children = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return quality.orphan_parents(table(spark, d, "customer"), children, "c_custkey", "o_custkey")


@query("fk_composite", ctes("observations", "sources") + """
SELECT * FROM observations o WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.source_id = o.source_id
    AND s.firm_id = o.firm_id AND s.dataset_version = o.dataset_version)""")
def fk_composite(spark, d):
    return enrich.misplaced_observations(frame(spark, d, "observations"), frame(spark, d, "sources"))


@query("evidence_support", ctes("proposed", "sources") + """
SELECT DISTINCT firm_id, dataset_version, field FROM proposed p WHERE NOT EXISTS (
    SELECT 1 FROM sources s WHERE s.firm_id = p.firm_id AND s.dataset_version = p.dataset_version
    AND list_contains(string_split_regex(s.field_supported, '[\\s,;|]+'), p.field))""")
def evidence_support(spark, d):
    return enrich.unsupported_fields(frame(spark, d, "proposed"), frame(spark, d, "sources"))


@query("evidence_refusals", ctes("proposed", "sources") + f"""
SELECT DISTINCT firm_id, dataset_version, field, CASE WHEN field NOT IN ({_in(fv.FACTUAL_FIELDS)}) THEN 'not a factual field' ELSE 'no evidence' END AS reason
FROM proposed p WHERE field NOT IN ({_in(fv.FACTUAL_FIELDS)}) OR NOT EXISTS (
    SELECT 1 FROM sources s WHERE s.firm_id = p.firm_id AND s.dataset_version = p.dataset_version
    AND list_contains(string_split_regex(s.field_supported, '[\\s,;|]+'), p.field))""")
def evidence_refusals(spark, d):
    return enrich.refused_fields(frame(spark, d, "proposed"), frame(spark, d, "sources"))


@query("source_rules", ctes("sources") + f"""
SELECT source_id, {_joined(
    "CASE WHEN accessed_at IS NOT NULL AND source_id % 7 = 0 THEN 'accessed_at' END",
    f"CASE WHEN upper(source_type) NOT IN ({_in(fv.TASK_STATUSES)}) AND source_id % 5 > 0 THEN 'retrieval_status' END",
)} AS violations FROM sources""")
def source_rules(spark, d):
    """Some sources have a bare time, and most a status that is none."""
    odd = frame(spark, d, "sources").withColumns({
        "accessed_at": F.when(F.col("source_id") % 7 == 0, F.when(F.col("accessed_at").isNotNull(), "12:30")).otherwise(F.col("accessed_at")),
        "retrieval_status": F.when(F.col("source_id") % 5 == 0, "RETRIEVED").otherwise(F.upper("source_type")),
    })
    return enrich.judged_sources(odd).select("source_id", F.array_join("violations", "|").alias("violations"))


@query("main_office_lookup", ctes("scored_both", "offices") + """
SELECT f.firm_id, f.dataset_version, f.name, street_address_1 AS main_office_street_address_1, city AS main_office_city,
    telephone AS main_office_phone
FROM scored_both f LEFT JOIN (SELECT * FROM offices WHERE office_type = 'MAIN'
    QUALIFY row_number() OVER (PARTITION BY firm_id, dataset_version ORDER BY street_address_1) = 1) o
USING (firm_id, dataset_version)""")
def main_office_lookup(spark, d):
    key = ["firm_id", "dataset_version"]
    return frame(spark, d, "scored_both").select(*key, "name").join(
        serve.main_offices(frame(spark, d, "offices")).select(
            *key, "main_office_street_address_1", "main_office_city", "main_office_phone"
        ), key, "left",
    )


# ---------------------------------------------------------------- enrichment
_CORE = ", ".join(
    f"('{r[0]}', '{r[1]}', '{r[2]}', {'NULL' if r[3] is None else repr(r[3])})"
    for r in fv.SOURCE_TAXONOMY if r[0] in fv.CORE_SOURCE_TYPES
)
_TASKS_SQL = f"""
SELECT firm_id, dataset_version, source_type, source_authority,
    CASE WHEN source_type = 'official_website' THEN website_address ELSE url END AS source_url, source_title, 'NOT_STARTED' AS status
FROM scored_both, (VALUES {_CORE}) t(source_type, source_authority, source_title, url)
WHERE priority_category IN ('PRIORITY_A', 'PRIORITY_B')"""
# What the store holds already: records and half of the task types of the new snapshot.
_HELD = f"dataset_version = '{NEW}' AND source_type < 'iapd'"


def _seeded(spark, d):
    scored = frame(spark, d, "scored_both")
    all_tasks = enrich.source_tasks(
        enrich.selected_targets(scored, ("PRIORITY_A", "PRIORITY_B"))
    )
    records = frame(spark, d, "research").select("firm_id", "dataset_version", "research_status")
    held = all_tasks.filter(_HELD)
    return scored, records, held, enrich.seed(scored, records, held)


@query("seed_tasks", ctes("scored_both") + f"SELECT * FROM ({_TASKS_SQL}) WHERE NOT ({_HELD})")
def seed_tasks(spark, d):
    return _seeded(spark, d)[3][1]


@query("seed_records", ctes("scored_both", "research") + """
SELECT firm_id, dataset_version, 'NOT_STARTED' AS research_status FROM scored_both s
WHERE priority_category IN ('PRIORITY_A', 'PRIORITY_B') AND NOT EXISTS (SELECT 1 FROM research r
    WHERE r.firm_id = s.firm_id AND r.dataset_version = s.dataset_version)""")
def seed_records(spark, d):
    return _seeded(spark, d)[3][0]


@query("seed_counts", ctes("scored_both", "research") + """
SELECT count(CASE WHEN r.firm_id IS NULL THEN 1 END) AS created, count(r.firm_id) AS existing, count(*) AS total
FROM scored_both s LEFT JOIN research r USING (firm_id, dataset_version) WHERE priority_category IN ('PRIORITY_A', 'PRIORITY_B')""")
def seed_counts(spark, d):
    scored, _, _, (new_records, _) = _seeded(spark, d)
    return enrich.seed_counts(enrich.selected_targets(scored, ("PRIORITY_A", "PRIORITY_B")), new_records)


@query("seed_idempotent", "SELECT CAST(0 AS BIGINT) AS new_records, CAST(0 AS BIGINT) AS new_tasks")
def seed_idempotent(spark, d):
    scored, records, held, (new_records, new_tasks) = _seeded(spark, d)
    again = enrich.seed(scored, records.unionByName(new_records), held.unionByName(new_tasks))
    new_tasks = again[1].agg(F.count(F.lit(1)))
    return again[0].agg(F.count(F.lit(1)).alias("new_records")).withColumn("new_tasks", new_tasks.scalar())


_TASK_STATUS = "CASE WHEN length(firm_id) > 3 THEN 'ACCEPTED' ELSE 'FAILED' END"


@query("coverage", ctes("scored_both") + f"""
SELECT source_type, {_TASK_STATUS} AS status, count(*) AS n,
    (SELECT count(DISTINCT firm_id) FROM ({_TASKS_SQL})) AS target_count FROM ({_TASKS_SQL}) GROUP BY ALL""")
def coverage(spark, d):
    tasks = enrich.source_tasks(
        enrich.selected_targets(frame(spark, d, "scored_both"), ("PRIORITY_A", "PRIORITY_B"))
    )
    return enrich.coverage(tasks.withColumn("status", F.expr(_TASK_STATUS)))


@query("task_state_fold", ctes("task_log") + """
SELECT task_id, min(CASE WHEN status IN ('DISCOVERED', 'RETRIEVED', 'REVIEW_REQUIRED') THEN ts END) AS discovered_at,
    max(CASE WHEN status = 'RETRIEVED' THEN ts END) AS retrieved_at,
    max(CASE WHEN status IN ('ACCEPTED', 'UNAVAILABLE', 'FAILED', 'STALE') THEN ts END) AS last_reviewed_at,
    last(status ORDER BY ts, event_id) AS status FROM task_log GROUP BY task_id""")
def task_state_fold(spark, d):
    return enrich.task_states(frame(spark, d, "task_log"), "task_id", "status", "ts", "event_id")


@query("provenance", ctes("sources") + "SELECT * FROM sources")
def provenance(spark, d):
    return serve.provenance(frame(spark, d, "sources"))
