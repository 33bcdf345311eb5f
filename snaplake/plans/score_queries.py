"""Scores, snapshot differences, change events and the refresh queue."""

from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.operators import diff, events, score, serve
from snaplake.operators.skew import with_tie_percentile
from snaplake.plans.inputs import NEW, NOW, OLD, ctes, frame, table
from snaplake.plans.registry import query
from snaplake.session import materialise
from snaplake.sources import dimensions
from snaplake.sources.snapshots import union_snapshots

_COMPONENTS = """, parts AS (SELECT *, greatest(0, least(50, total_aum / 1e9)) AS score_aum,
    CAST(greatest(0, least(20, private_fund_count)) AS DOUBLE) AS score_growth, disciplinary_event_count * -5.0::DOUBLE AS score_risk FROM part_scores)
"""
_TIES = """(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2) / count(*) OVER ()"""
_SCORED = ctes("part_scores") + _COMPONENTS + f""", scored AS (
    SELECT *, {_TIES.format(x='score_aum + score_growth + score_risk')} AS acquisition_score FROM parts)
"""


def _scored(spark, d):
    # Typed firms are stored before they are scored.
    return score.percentile_score(score.with_components(materialise(frame(spark, d, "part_scores"))))


@query("component_scores", ctes("part_scores") + _COMPONENTS + "SELECT firm_id, score_aum, score_growth, score_risk FROM parts")
def component_scores(spark, d):
    return score.with_components(frame(spark, d, "part_scores")).select("firm_id", *score.COMPONENTS)


@query("percentile_score", _SCORED + "SELECT firm_id, round(acquisition_score, 9) AS acquisition_score FROM scored")
def percentile_score(spark, d):
    return _scored(spark, d).select("firm_id", F.round("acquisition_score", 9).alias("acquisition_score"))


@query("top_scores", _SCORED + """
SELECT firm_id, round(acquisition_score, 9) AS acquisition_score, total_aum FROM scored
ORDER BY scored.acquisition_score DESC NULLS LAST, firm_id LIMIT 25""")
def top_scores(spark, d):
    return serve.page(_scored(spark, d), "acquisition_score", 1, 25).select(
        "firm_id", F.round("acquisition_score", 9).alias("acquisition_score"), "total_aum"
    )


@query("percentile_of_ties", f"SELECT l_orderkey, l_quantity, round({_TIES.format(x='l_quantity')}, 9) AS pct FROM lineitem")
def percentile_of_ties(spark, d):
    ranked = with_tie_percentile(table(spark, d, "lineitem").select("l_orderkey", "l_quantity"), "l_quantity", "pct")
    return ranked.select("l_orderkey", "l_quantity", F.round("pct", 9).alias("pct"))


@query("score_distribution", """
SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std_dev,
    min(o_totalprice) AS min, max(o_totalprice) AS max, round(median(o_totalprice), 4) AS median FROM orders""")
def score_distribution(spark, d):
    stats = score.score_distribution(table(spark, d, "orders"), "o_totalprice")
    return stats.select("n", "min", "max", *[F.round(c, 4).alias(c) for c in ("mean", "std_dev", "median")])


@query("degenerate_test", _SCORED + """
SELECT round(stddev_samp(acquisition_score), 6) AS stddev, count(acquisition_score) AS n,
    stddev_samp(acquisition_score) < 0.01 AND count(*) > 10 AS is_degenerate FROM scored""")
def degenerate_test(spark, d):
    return score.degenerate(_scored(spark, d)).withColumn("stddev", F.round("stddev", 6))


_FEATURES = ("score_aum", "score_growth", "score_risk")


def _times_matrix(row: str) -> str:
    return " + ".join(f"c{row}{j} * v{j}" for j in range(3))


# The first principal component by power iteration on the covariance matrix.
_PCA = ctes("part_scores").replace("WITH ", "WITH RECURSIVE ", 1) + _COMPONENTS + ", m AS (SELECT " + ", ".join(
    f"covar_pop({a}, {b}) AS c{i}{j}" for i, a in enumerate(_FEATURES) for j, b in enumerate(_FEATURES)
) + f""" FROM parts),
step AS (SELECT 0 AS i, 1.0::DOUBLE AS v0, 0.9::DOUBLE AS v1, 0.8::DOUBLE AS v2
    UNION ALL SELECT i + 1, w0 / len, w1 / len, w2 / len FROM (
        SELECT i, w0, w1, w2, sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS len FROM (
            SELECT i, {', '.join(f"{_times_matrix(str(r))} AS w{r}" for r in range(3))} FROM step, m WHERE i < 400))),
last_step AS (SELECT *, CASE WHEN greatest(abs(v0), abs(v1), abs(v2)) IN (v0, v1, v2) THEN 1 ELSE -1 END AS sign FROM step WHERE i = 400),
projected AS (SELECT firm_id, round((score_aum * v0 + score_growth * v1 + score_risk * v2) * sign, 9) AS x FROM parts, last_step)
"""


@query("pca_score", _PCA + f"SELECT firm_id, round({_TIES.format(x='x')}, 9) AS acquisition_score FROM projected")
def pca_score(spark, d):
    return score.pca_score(score.with_components(materialise(frame(spark, d, "part_scores")))).select(
        "firm_id", F.round("acquisition_score", 9).alias("acquisition_score")
    )


_WEIGHTS = ", ".join(f"('{c}', {w})" for c, w in fv.CATEGORY_WEIGHTS)


@query("weighted_score", ctes("category_scores") + f"""
SELECT o_custkey, round(sum(score * w) / sum(w), 6) AS weighted_score
FROM category_scores JOIN (VALUES {_WEIGHTS}) t(category, w) USING (category) GROUP BY 1""")
def weighted_score(spark, d):
    scored = score.weighted_score(frame(spark, d, "category_scores"), dimensions.category_weights(spark), "o_custkey")
    return scored.withColumn("weighted_score", F.round("weighted_score", 6))


@query("weighted_score_from_map", ctes("category_scores") + f"""
SELECT o_custkey, round(sum(score * w) / sum(w), 6) AS weighted_score
FROM category_scores JOIN (VALUES {_WEIGHTS}) t(category, w) USING (category) GROUP BY 1""")
def weighted_score_from_map(spark, d):
    # A firm has seven categories at most, so its map is small.
    maps = frame(spark, d, "category_scores").groupBy("o_custkey").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "score"))).alias("scores")
    )
    rows = score.category_rows(maps, "o_custkey", "scores")
    scored = score.weighted_score(rows, dimensions.category_weights(spark), "o_custkey")
    return scored.withColumn("weighted_score", F.round("weighted_score", 6))


_RATIO_SQL = """SELECT *, discretionary_aum / total_aum AS discretionary_share, individual_hnw_client_aum / total_aum AS individual_hnw_share,
    hnw_client_aum / total_aum AS hnw_share, total_aum / total_account_count AS average_account_size,
    discretionary_account_count / total_account_count AS discretionary_account_share FROM scored_both"""
_RATIOS = ("discretionary_share", "individual_hnw_share", "hnw_share", "average_account_size", "discretionary_account_share")


@query("ratios", ctes("scored_both") + f"""
SELECT firm_id, dataset_version, {', '.join(f'round({r}, 6) AS {r}' for r in _RATIOS)} FROM ({_RATIO_SQL})""")
def ratios(spark, d):
    return score.with_ratios(frame(spark, d, "scored_both")).select(
        "firm_id", "dataset_version", *[F.round(r, 6).alias(r) for r in _RATIOS]
    )


_CODES = (
    ("PREFERRED_AUM_BAND", "total_aum BETWEEN 25000000 AND 60000000"),
    ("HIGH_DISCRETIONARY_SHARE", "discretionary_share >= 0.90::DOUBLE"),
    ("PREDOMINANTLY_DISCRETIONARY", "discretionary_share >= 0.75"),
    ("MEANINGFUL_DISCRETIONARY_AUM", "discretionary_aum >= 25000000"),
    ("HNW_INDIVIDUAL_FOCUSED", "individual_hnw_share >= 0.75"),
    ("HIGH_HNW_AUM_SHARE", "hnw_share >= 0.5"),
    ("MANAGEABLE_ACCOUNT_BASE", "total_account_count <= 500"),
    ("HIGH_AVERAGE_ACCOUNT_SIZE", "average_account_size >= 500000"),
    ("HIGH_DISCRETIONARY_ACCOUNT_SHARE", "discretionary_account_share >= 0.75"),
    ("SMALL_EMPLOYEE_BASE", "employee_count <= 3"),
    ("SMALL_ADVISORY_TEAM", "advisory_employee_count <= 3"),
    ("SIMPLE_CONTROL_STRUCTURE", "NOT has_control_complexity"),
    ("INDIVIDUAL_SMALL_BUSINESS_MODEL", "advises_individuals_or_small_businesses"),
    ("FINANCIAL_PLANNING_MODEL", "provides_financial_planning"),
    ("CLEAN_ITEM11_HISTORY", "NOT has_item_11_disclosure"),
)


@query("reason_codes", ctes("scored_both") + f"""
SELECT firm_id, dataset_version, array_to_string(list_filter(
    [{', '.join(f"CASE WHEN {p} THEN '{c}' END" for c, p in _CODES)}], lambda x: x IS NOT NULL), '|') AS codes FROM ({_RATIO_SQL})""")
def reason_codes(spark, d):
    return score.with_ratios(frame(spark, d, "scored_both")).select(
        "firm_id", "dataset_version", F.array_join(score.reason_codes(), "|").alias("codes")
    )


@query("priority_rules", ctes("scored_both") + """
SELECT firm_id, dataset_version, CASE WHEN total_aum BETWEEN 20000000 AND 100000000 AND employee_count > 5 THEN 'PRIORITY_A'
    WHEN total_aum BETWEEN 20000000 AND 100000000 THEN 'PRIORITY_B' ELSE 'EXCLUDED' END AS priority_category FROM scored_both""")
def priority_rules(spark, d):
    band = events.in_band(F.col("total_aum"))
    rules = [("PRIORITY_A", band & (F.col("employee_count") > 5)), ("PRIORITY_B", band)]
    return score.prioritised(frame(spark, d, "scored_both"), rules).select("firm_id", "dataset_version", "priority_category")


# ---------------------------------------------------------------------- diff
#: Every column of a scored snapshot but its key and version.
_ALL = (
    "name", "total_aum", "discretionary_aum", "individual_hnw_client_aum", "hnw_client_aum", "total_account_count",
    "discretionary_account_count", "employee_count", "advisory_employee_count", "has_item_11_disclosure",
    "has_control_complexity", "provides_financial_planning", "advises_individuals_or_small_businesses", "registration_status",
    "organization_type", "organization_state", "website_address", "priority_category",
)


def _pair(spark, d, columns):
    return (
        frame(spark, d, "scored_old").select("firm_id", *columns),
        frame(spark, d, "scored_new").select("firm_id", *columns),
    )


def _state_sql(columns) -> str:
    changed = " OR ".join(f"o.{c} IS DISTINCT FROM n.{c}" for c in columns)
    return ctes("scored_old", "scored_new") + f""", states AS (SELECT coalesce(o.firm_id, n.firm_id) AS firm_id,
    CASE WHEN o.firm_id IS NULL THEN 'added' WHEN n.firm_id IS NULL THEN 'removed' WHEN {changed} THEN 'modified' ELSE 'unchanged' END AS change
    FROM scored_old o FULL JOIN scored_new n ON o.firm_id = n.firm_id) """


@query("snapshot_keys", _state_sql(_ALL) + "SELECT * FROM states")
def snapshot_keys(spark, d):
    return diff.key_changes(*_pair(spark, d, _ALL), ["firm_id"])


@query("diff_summary", _state_sql(_ALL) + "SELECT " + ", ".join(
    f"count(*) FILTER (change = '{c}') AS {c}_count" for c in ("added", "removed", "modified", "unchanged")
) + " FROM states")
def diff_summary(spark, d):
    return diff.diff_summary(diff.key_changes(*_pair(spark, d, _ALL), ["firm_id"]))


def _shown(column: str) -> str:
    """Amounts print differently in the two engines, so they are compared in whole units."""
    return f"CAST(round({column}) AS BIGINT)" if column.endswith("_aum") else column


@query("snapshot_cells", ctes("scored_old", "scored_new") + " UNION ALL ".join(
    f"SELECT n.firm_id, '{c}' AS column_name, CAST({_shown('o.' + c)} AS VARCHAR) AS old_value, CAST({_shown('n.' + c)} AS VARCHAR) AS new_value "
    f"FROM scored_old o JOIN scored_new n ON o.firm_id = n.firm_id WHERE {_shown('o.' + c)} IS DISTINCT FROM {_shown('n.' + c)}" for c in _ALL
))
def snapshot_cells(spark, d):
    old, new = (df.select("firm_id", *[F.expr(_shown(c)).alias(c) for c in _ALL]) for df in _pair(spark, d, _ALL))
    return diff.cell_changes(old, new, ["firm_id"])


@query("schema_drift", ctes("columns_old", "columns_new") + """
SELECT column_name, 'missing' AS drift FROM (SELECT column_name FROM columns_old EXCEPT SELECT column_name FROM columns_new)
UNION ALL SELECT column_name, 'extra' FROM (SELECT column_name FROM columns_new EXCEPT SELECT column_name FROM columns_old)""")
def schema_drift(spark, d):
    missing, extra = diff.schema_drift(frame(spark, d, "columns_old"), frame(spark, d, "columns_new"))
    return missing.withColumn("drift", F.lit("missing")).unionByName(extra.withColumn("drift", F.lit("extra")))


@query("fingerprint_diff", ctes("columns_old", "columns_new") + """
, common AS (SELECT table_name FROM columns_old INTERSECT SELECT table_name FROM columns_new)
SELECT DISTINCT table_name, CAST(NULL AS VARCHAR) AS column_name, 'new_table' AS change FROM columns_new
    WHERE table_name NOT IN (SELECT table_name FROM columns_old)
UNION ALL SELECT DISTINCT table_name, NULL, 'missing_table' FROM columns_old WHERE table_name NOT IN (SELECT table_name FROM columns_new)
UNION ALL SELECT table_name, column_name, 'added_column' FROM (SELECT * FROM columns_new EXCEPT SELECT * FROM columns_old) SEMI JOIN common USING (table_name)
UNION ALL SELECT table_name, column_name, 'removed_column' FROM (SELECT * FROM columns_old EXCEPT SELECT * FROM columns_new) SEMI JOIN common USING (table_name)""")
def fingerprint_diff(spark, d):
    return diff.fingerprint_changes(frame(spark, d, "columns_old"), frame(spark, d, "columns_new"))


@query("union_versions", ctes("scored_old", "scored_new") + """
SELECT firm_id, dataset_version, total_aum, NULL AS employee_count FROM scored_old
UNION ALL SELECT firm_id, dataset_version, total_aum, employee_count FROM scored_new""")
def union_versions(spark, d):
    key = ["firm_id", "dataset_version", "total_aum"]
    return union_snapshots(frame(spark, d, "scored_old").select(*key), frame(spark, d, "scored_new").select(*key, "employee_count"))


# -------------------------------------------------------------------- events
_CHANGED = "both_sides AND o.{c} IS DISTINCT FROM n.{c}"
_O, _N = "o.total_aum", "n.total_aum"
_BAND_O, _BAND_N = (f"{x} BETWEEN 20000000 AND 100000000" for x in (_O, _N))
_RULES = [
    ("NEW_PRIORITY_A", "o.firm_id IS NULL AND n.priority_category = 'PRIORITY_A'", "NULL", "NULL", "NULL"),
    ("REMOVED_FIRM", "n.firm_id IS NULL", "NULL", "NULL", "NULL"),
    *[(k, f"o.priority_category = '{a}' AND n.priority_category = '{b}'", "NULL", f"'{a}'", f"'{b}'") for a, b, k in fv.PRIORITY_MOVES],
    ("MATERIAL_AUM_DECLINE", f"{_O} > 0 AND {_N} <> 0 AND ({_N} - {_O}) / {_O} <= -0.20::DOUBLE", "NULL", "'aum'", "'aum'"),
    ("MATERIAL_AUM_GROWTH", f"{_O} > 0 AND {_N} <> 0 AND ({_N} - {_O}) / {_O} >= 0.20::DOUBLE", "NULL", "'aum'", "'aum'"),
    ("ENTERED_TARGET_AUM_BAND", f"NOT ({_BAND_O}) AND ({_BAND_N})", "NULL", "'aum'", "'aum'"),
    ("EXITED_TARGET_AUM_BAND", f"({_BAND_O}) AND NOT ({_BAND_N})", "NULL", "'aum'", "'aum'"),
    ("NEW_REGULATORY_DISCLOSURE", _CHANGED.format(c="has_item_11_disclosure") + " AND n.has_item_11_disclosure", "NULL", "NULL", "NULL"),
    *[(f"{c.upper()}_CHANGE", _CHANGED.format(c=c), "NULL",
       f"CAST(o.{c} AS VARCHAR)" if "aum" not in c else "'aum'", f"CAST(n.{c} AS VARCHAR)" if "aum" not in c else "'aum'")
      for c in fv.PLAIN_CHANGE_FIELDS],
    *[("MATERIAL_STAFFING_CHANGE", _CHANGED.format(c=c), f"'{c}'", f"CAST(o.{c} AS VARCHAR)", f"CAST(n.{c} AS VARCHAR)")
      for c in fv.STAFFING_FIELDS],
]
def _amount(side: str, kind: str, shown: str) -> str:
    column = kind.removesuffix("_CHANGE").lower() if kind.endswith("_CHANGE") else "total_aum"
    return f"round(CAST({side}.{column} AS DOUBLE), 2)" if shown == "'aum'" else "CAST(NULL AS DOUBLE)"


_EVENTS = ctes("scored_old", "scored_new", "research", "ranked") + ", change_events AS (" + " UNION ALL ".join(
    f"""SELECT coalesce(o.firm_id, n.firm_id) AS firm_id, '{kind}' AS event_type, {field} AS field, nullif({old}, 'aum') AS old_value,
        nullif({new}, 'aum') AS new_value, {_amount('o', kind, old)} AS old_amount, {_amount('n', kind, new)} AS new_amount,
        {'n.name' if kind != 'REMOVED_FIRM' else 'NULL'} AS name, {number} AS rule,
        {f'round(({_N} - {_O}) / {_O}, 9)' if kind.startswith('MATERIAL_AUM') else 'CAST(NULL AS DOUBLE)'} AS change_pct
    FROM (SELECT *, true AS here FROM scored_old) o FULL JOIN scored_new n ON o.firm_id = n.firm_id
    WHERE {rule.replace('both_sides', 'o.firm_id IS NOT NULL AND n.firm_id IS NOT NULL')}"""
    for number, (kind, rule, field, old, new) in enumerate(_RULES)
) + ")\n"
EVENTS_SQL = _EVENTS


def _events(spark, d):
    return events.change_events(frame(spark, d, "scored_old"), frame(spark, d, "scored_new"))


def shown_events(found, *more):
    """Events with their details; amounts print differently in the two engines, so they are compared as numbers."""
    amount = F.col("event_type").contains("AUM")

    def shown(side):
        value = F.col(f"details.{side}")
        return [
            F.when(~amount, value).alias(f"{side}_value"),
            F.when(amount, F.round(value.cast("double"), 2)).alias(f"{side}_amount"),
        ]

    return found.select(
        "firm_id", "event_type", F.col("details.field").alias("field"), *shown("old"), *shown("new"),
        F.col("details.name").alias("name"), F.round("details.change_pct", 9).alias("change_pct"), *more,
    )


@query("change_events", _EVENTS + "SELECT * EXCLUDE (rule) FROM change_events")
def change_events(spark, d):
    return shown_events(_events(spark, d))


@query("event_counts", _EVENTS + "SELECT event_type, count(*) AS n FROM change_events GROUP BY 1")
def event_counts(spark, d):
    return events.event_counts(_events(spark, d))


@query("events_by_firm", _EVENTS + """
SELECT firm_id, string_agg(event_type, '|' ORDER BY rule) AS event_types FROM change_events GROUP BY 1""")
def events_by_firm(spark, d):
    return events.events_by_firm(_events(spark, d)).withColumn("event_types", F.array_join("event_types", "|"))


QUEUE_SQL = _QUEUE = _EVENTS + f""", joined AS (
    SELECT t.firm_id, t.name, t.priority_category, t.acquisition_score, r.firm_id IS NOT NULL AS has_record, types,
        t.priority_category = 'PRIORITY_A' AS is_a,
        CASE WHEN nullif(r.last_researched_at, '') IS NULL THEN t.priority_category = 'PRIORITY_A'
             WHEN TRY_CAST(r.last_researched_at AS TIMESTAMPTZ) IS NULL THEN true
             ELSE floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(CAST(TRY_CAST(r.last_researched_at AS TIMESTAMPTZ) AS TIMESTAMP))) / 86400000000) >= 180 END AS stale
    FROM (SELECT * FROM ranked WHERE dataset_version = (SELECT max(dataset_version) FROM scored_new)) t
    LEFT JOIN research r ON r.firm_id = t.firm_id
    LEFT JOIN (SELECT firm_id, list(event_type ORDER BY rule) AS types FROM change_events GROUP BY 1) e ON e.firm_id = t.firm_id
    WHERE t.priority_category IN ('PRIORITY_A', 'PRIORITY_B')),
queue AS (SELECT firm_id, name, priority_category, acquisition_score,
    CASE WHEN NOT has_record THEN CASE WHEN is_a THEN 'NEW_TARGET_RESEARCH' ELSE 'NO_REFRESH_REQUIRED' END
         WHEN coalesce(list_contains(types, 'NEW_REGULATORY_DISCLOSURE'), false) THEN 'REGULATORY_REVIEW_REQUIRED'
         WHEN stale OR coalesce(list_has_any(types, [{', '.join(f"'{e}'" for e in fv.REFRESH_EVENTS)}]), false)
              THEN CASE WHEN is_a THEN 'REFRESH_REQUIRED' ELSE 'PRIORITY_CHANGE_REVIEW' END
         ELSE 'NO_REFRESH_REQUIRED' END AS action,
    CASE WHEN NOT has_record THEN 'missing research record' WHEN len(types) > 0 THEN array_to_string(types, '|')
         WHEN stale THEN 'stale>180d' ELSE 'no material event' END AS reasons, '{OLD}' AS previous_dataset_version FROM joined)
"""


def queue_of(spark, d):
    # The scored snapshot is read twice, so it is stored first.
    new = materialise(frame(spark, d, "ranked").filter(F.col("dataset_version") == NEW))
    # Only firms in the queue can give it reasons, so both snapshots are cut to them before they are compared.
    targets = events.refresh_targets(new)
    old = frame(spark, d, "scored_old").join(targets.select("firm_id"), "firm_id", "left_semi")
    found = events.change_events(old, targets)
    return events.refresh_queue(new, frame(spark, d, "research"), found, F.lit(NOW).cast("timestamp"), previous_version=OLD)


@query("refresh_queue", _QUEUE + "SELECT * FROM queue")
def refresh_queue(spark, d):
    return queue_of(spark, d).orderBy(*events.queue_order()).withColumn("reasons", F.array_join("reasons", "|"))


@query("refresh_queue_head", _QUEUE + """
SELECT firm_id, action, acquisition_score FROM queue
ORDER BY action = 'NO_REFRESH_REQUIRED', coalesce(acquisition_score, 0) DESC, firm_id LIMIT 50""")
def refresh_queue_head(spark, d):
    return serve.latest_rows(queue_of(spark, d), events.queue_order(), 50).select("firm_id", "action", "acquisition_score")
