"""Operators on small frames: the acceptance list and the decisions on odd input."""

import pytest
from pyspark.sql import functions as F

from conftest import plan_text
from snaplake.operators import diff, enrich, events, normalize, profile, quality, rollup, score, serve
from snaplake.sources.dimensions import source_taxonomy


def roster(spark):
    return spark.createDataFrame(
        [
            ("1", "Alpha", "1,000.5", "3", "Y", "Main St", "N", None, "Beta", "NA"),
            ("2", None, "x", "1.0", "", "Second St", "Y", "Mail St", None, None),
            ("3", "Gamma", "", "", "q", None, None, "", "NA", "9"),
        ],
        "`Organization CRD#` string, `Legal Name` string, `5.G.(3) - Total amount of Parallel Assets` string, "
        "`Count of Private Funds - 7B(1)` string, `Umbrella Registration` string, `Main Office Street Address 1` string, "
        "`Main Office Private Residence Flag` string, `Mail Office Street Address 1` string, `Acquired Firm` string, "
        "`Acquired Firm SEC#` string",
    )


def test_normalise_snapshot(spark, rows):
    out = normalize.normalise_snapshot(roster(spark), "ia07012026", F.lit("2026-07-02").cast("timestamp"))
    firms = {r.firm_id: r for r in out["firms"].collect()}
    assert set(firms) == {"1", "3"}
    assert float(firms["1"].total_aum) == 1000.5 and firms["1"].private_fund_count == 3 and firms["1"].umbrella_registration
    assert firms["3"].total_aum is None and firms["3"].umbrella_registration is None
    assert firms["1"].discretionary_aum is None and len(firms["1"].record_hash) == 64
    assert len(out["firms"].columns) == 47
    # A refused row keeps its reason and loses its children; an absent address makes no office.
    assert [(r.firm_id, r.rejected_for) for r in out["quarantine"].collect()] == [("2", ["missing name"])]
    assert rows(out["firm_offices"], "firm_id", "office_type", "is_private_residence") == [("1", "MAIN", False)]
    assert rows(out["firm_acquired_firms"], "parent_firm_id", "acquired_name", "acquired_sec_number") == [("1", "Beta", None)]


def test_snapshot_checks_find_every_fault(spark):
    firms = spark.createDataFrame(
        [("a", "A", "x", "ok"), ("a", "A", "x", "ok"), ("b", None, None, "ok"), (None, "N", "x", None)],
        "firm_id string, name string, firm_type string, sec_current_status string",
    )
    offices = spark.createDataFrame(
        [("a", "MAIN", "s", None, "NY"), ("a", "MAIN", "s", "c", "NY"), ("z", "MAIL", None, None, None), (None, "MAIN", "s", "c", None)],
        "firm_id string, office_type string, street_address_1 string, city string, state string",
    )
    acquired = spark.createDataFrame([("a",), ("y",), ("y",)], "parent_firm_id string")
    got = {(r.check, r.entity, r.metric): r.bad_count for r in quality.validate_snapshot(firms, offices, acquired).collect()}
    assert got == {
        ("missing_keys", "firms", "firm_id"): 1, ("missing_keys", "firm_offices", "firm_id"): 1,
        ("missing_keys", "firm_acquired_firms", "parent_firm_id"): 0,
        ("duplicate_keys", "firms", "firm_id"): 1, ("duplicate_keys", "firm_offices", "firm_id,office_type"): 1,
        ("broken_references", "firm_offices", "firm_id"): 2, ("broken_references", "firm_acquired_firms", "parent_firm_id"): 2,
        ("orphans", "firms", "firm_id"): 2,
        ("unexpected_nulls", "firms", "name"): 1, ("unexpected_nulls", "firms", "firm_type"): 1,
        ("unexpected_nulls", "firms", "sec_current_status"): 1,
        ("unexpected_nulls", "firm_offices", "street_address_1"): 0, ("unexpected_nulls", "firm_offices", "city"): 1,
        ("unexpected_nulls", "firm_offices", "state"): 1,
    }
    # The single checks agree with the one-pass form.
    singles = quality.all_checks(
        quality.missing_keys(firms, "firms", ["firm_id"]),
        quality.duplicate_check(offices, "firm_offices", ["firm_id", "office_type"]),
        quality.reference_check(offices, firms, "firm_offices", "firm_id", "firm_id"),
        quality.reference_check(acquired, firms, "firm_acquired_firms", "parent_firm_id", "firm_id"),
        quality.orphan_check(firms, offices, "firms", "firm_id", "firm_id"),
    )
    for r in singles.collect():
        assert got[(r.check, r.entity, r.metric)] == r.bad_count, r


def test_gate_lets_warnings_through(spark):
    checks = "check string, severity string, passed boolean"
    assert quality.gate(spark.createDataFrame([("a", "error", True), ("b", "warning", False)], checks))
    assert not quality.gate(spark.createDataFrame([("a", "error", False)], checks))


def test_reconcile_and_freshness(spark):
    df = spark.range(10)
    assert quality.reconcile(df, df.filter("id > 0")).first().asDict() == {"raw_rows": 10, "typed_rows": 9, "passed": False}
    now = F.lit("2026-02-05").cast("timestamp")
    loads = spark.sql("SELECT timestamp '2026-01-01' AS ts")
    assert quality.freshness(loads, "ts", now).first()["passed"] is False
    assert quality.freshness(loads, "ts", now, 36).first()["passed"] is True
    assert quality.freshness(loads.filter("false"), "ts", now).first()["passed"] is False


def test_row_drop_limit(spark):
    counts = spark.createDataFrame([("t", 100, 95), ("u", 100, 94)], "t string, e int, a int")
    assert [r.t for r in quality.row_drops(counts, "e", "a").collect()] == ["u"]


def test_profile_of_a_small_table(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, " ", 1.5), (3, None, 0.0)], "id int, name string, x double")
    got = {r.column_name: r for r in profile.column_profile(df).collect()}
    assert (got["name"].null_count, got["name"].empty_count, got["name"].unique_values) == (1, 2, 2)
    assert got["x"].zero_count == 2 and got["x"].completeness_pct == 100.0
    assert got["name"].completeness_pct == 66.67 and got["name"].distinctiveness_pct == 100.0
    sketch = {r.column_name: r for r in profile.column_profile(df, approximate=True).collect()}
    for name, r in got.items():
        assert sketch[name].asDict() == r.asDict()


def test_profile_of_a_wide_table_unpivots(spark, monkeypatch, rows):
    df = spark.createDataFrame([(1, "a", None, 2.0), (1, "b", None, 0.0)], "i int, `odd name#` string, z string, x double")
    narrow = rows(profile.column_profile(df))
    monkeypatch.setattr(profile, "CHUNK", 3)
    assert rows(profile.column_profile(df)) == narrow


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    score_ = profile.quality_score(profile.column_profile(df), profile.row_uniqueness(df)).first()
    assert score_["total_rows"] == 0


def test_quality_score_and_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (3, "b")], "id int, name string")
    columns = profile.column_profile(df)
    scored = profile.quality_score(columns, profile.row_uniqueness(df))
    # nulls 1 of 8 cells: 87.5; unique rows 75; completeness 87.5; distinct (75 + 66.67) / 2
    assert scored.first()["quality_score"] == pytest.approx(0.4 * 87.5 + 0.3 * 75 + 0.2 * 87.5 + 0.1 * 70.835, abs=0.006)
    report = profile.rule_report(columns, scored).first()
    # A failed rule does not change the status, which depends on the score.
    assert report["null_threshold"] is False and report["validation_status"] == "passed" and report["failed"] == 1


def test_patterns_are_unicode_aware(spark):
    df = spark.createDataFrame([("é", "٣"), ("ß", "4")], "a string, b string")
    got = {r.column_name: r.pattern for r in profile.column_patterns(profile.value_counts(df)).collect()}
    assert got == {"a": "^[A-Za-z]+$", "b": r"^\d+$"}


def test_snapshot_diff(spark, rows):
    old = spark.createDataFrame([(1, "Firm A", "v1"), (2, "Firm B", "v1"), (4, None, "v1")], "firm_id int, name string, dataset_version string")
    new = spark.createDataFrame([(1, "Firm A Modified", "v2"), (3, "Firm C", "v2"), (4, None, "v2")], "firm_id int, name string, dataset_version string")
    changes = diff.key_changes(old, new, ["firm_id"])
    assert rows(changes) == [(1, "modified"), (2, "removed"), (3, "added"), (4, "unchanged")]
    assert rows(diff.cell_changes(old, new, ["firm_id"])) == [(1, "name", "Firm A", "Firm A Modified")]
    assert diff.diff_summary(changes).first().asDict() == {
        "added_count": 1, "removed_count": 1, "modified_count": 1, "unchanged_count": 1}


def test_fingerprint_changes_see_a_rename(spark, rows):
    old = spark.createDataFrame([("t", "a"), ("t", "b"), ("gone", "x")], "table_name string, column_name string")
    new = spark.createDataFrame([("t", "a"), ("t", "c"), ("fresh", "x")], "table_name string, column_name string")
    assert rows(diff.fingerprint_changes(old, new), "table_name", "column_name", "change") == [
        ("fresh", None, "new_table"), ("gone", None, "missing_table"), ("t", "b", "removed_column"), ("t", "c", "added_column")]


SCORED = ("firm_id string, name string, total_aum double, discretionary_aum double, total_account_count int, employee_count int, "
          "advisory_employee_count int, priority_category string, has_item_11_disclosure boolean, registration_status string")


def test_change_events_together(spark):
    old = spark.createDataFrame([("1", "A", 10e6, 9e6, 10, 2, 1, "PRIORITY_B", False, "ok")], SCORED)
    new = spark.createDataFrame([("1", "A", 25e6, 24e6, 10, 3, 2, "PRIORITY_A", True, "ok")], SCORED)
    got = events.change_events(old, new)
    kinds = sorted(r.event_type for r in got.collect())
    assert kinds == ["ENTERED_TARGET_AUM_BAND", "MATERIAL_AUM_GROWTH", "MATERIAL_STAFFING_CHANGE", "MATERIAL_STAFFING_CHANGE",
                     "NEW_REGULATORY_DISCLOSURE", "PRIORITY_B_TO_A"]
    growth = got.filter("event_type = 'MATERIAL_AUM_GROWTH'").first().details
    assert growth.change_pct == pytest.approx(1.5)


def test_change_events_with_missing_values(spark):
    """A NULL amount crosses no band, a NULL flag is no disclosure, only priority A arrivals count."""
    old = spark.createDataFrame(
        [("1", "A", None, None, 1, 1, 1, "PRIORITY_A", False, "ok"), ("2", "B", 0.0, None, 1, 1, 1, "PRIORITY_A", True, None),
         ("9", "Z", 1.0, None, 1, 1, 1, "PRIORITY_A", True, None)], SCORED)
    new = spark.createDataFrame(
        [("1", "A", 30e6, None, 1, 1, 1, "PRIORITY_C", None, "ok"), ("2", "B", 5.0, None, 1, 1, 1, "EXCLUDED", True, None),
         ("3", "C", 1.0, None, 1, 1, 1, "PRIORITY_B", True, None), ("4", "D", 1.0, None, 1, 1, 1, "PRIORITY_A", True, None)], SCORED)
    got = sorted((r.firm_id, r.event_type) for r in events.change_events(old, new).collect())
    assert got == [("1", "PRIORITY_A_TO_C"), ("4", "NEW_PRIORITY_A"), ("9", "REMOVED_FIRM")]


def test_change_events_without_a_column(spark):
    old = spark.createDataFrame([("1", 1)], "firm_id string, employee_count int")
    new = spark.createDataFrame([("1", 2, "x")], "firm_id string, employee_count int, registration_status string")
    assert [r.event_type for r in events.change_events(old, new).collect()] == ["MATERIAL_STAFFING_CHANGE"]


def test_refresh_queue_decisions(spark):
    scored = spark.createDataFrame(
        [("a", "A", "PRIORITY_A", 9.0), ("b", "B", "PRIORITY_B", 8.0), ("c", "C", "PRIORITY_A", None), ("d", "D", "PRIORITY_B", 7.0),
         ("e", "E", "PRIORITY_A", 6.0), ("f", "F", "PRIORITY_B", 5.0), ("g", "G", "PRIORITY_C", 5.0), ("h", "H", "PRIORITY_A", 1.0)],
        "firm_id string, name string, priority_category string, acquisition_score double")
    research = spark.createDataFrame(
        [("c", None), ("d", ""), ("e", "2026-01-01T00:00:00Z"), ("f", "not a date"), ("h", "2025-01-01T00:00:00Z")],
        "firm_id string, last_researched_at string")
    found = spark.createDataFrame(
        [("e", "X", 3), ("e", "X", 1), ("e", "NEW_REGULATORY_DISCLOSURE", 0), ("e", "A", 2), ("d", "ENTERED_TARGET_AUM_BAND", 0)],
        "firm_id string, event_type string, position int")
    queue = events.refresh_queue(scored, research, found, F.lit("2026-02-01").cast("timestamp"))
    got = [(r.firm_id, r.action, r.reasons) for r in queue.orderBy(*events.queue_order()).collect()]
    assert got == [
        ("a", "NEW_TARGET_RESEARCH", ["missing research record"]),
        ("d", "PRIORITY_CHANGE_REVIEW", ["ENTERED_TARGET_AUM_BAND"]),
        ("e", "REGULATORY_REVIEW_REQUIRED", ["NEW_REGULATORY_DISCLOSURE", "X", "A", "X"]),
        ("f", "PRIORITY_CHANGE_REVIEW", ["stale>180d"]),
        ("h", "REFRESH_REQUIRED", ["stale>180d"]),
        ("c", "REFRESH_REQUIRED", ["stale>180d"]),
        ("b", "NO_REFRESH_REQUIRED", ["missing research record"]),
    ]


def targets(spark):
    return spark.createDataFrame(
        [("a", "v", "PRIORITY_A", "MA", "https://a.example"), ("b", "v", "PRIORITY_B", "CT", ""), ("c", "v", "EXCLUDED", "NY", None)],
        "firm_id string, dataset_version string, priority_category string, organization_state string, website_address string")


def test_seeding_twice_adds_nothing(spark, rows):
    none = spark.createDataFrame([], "firm_id string, dataset_version string, research_status string")
    no_tasks = spark.createDataFrame([], enrich.source_tasks(targets(spark)).schema)
    records, tasks = enrich.seed(targets(spark), none, no_tasks)
    assert (records.count(), tasks.count()) == (2, 18)
    sites = {r.firm_id: r.source_url for r in tasks.filter("source_type = 'official_website'").collect()}
    assert sites == {"a": "https://a.example", "b": None}
    held = records.withColumn("research_status", F.lit("RESEARCH_COMPLETE"))
    again = enrich.seed(targets(spark), held, tasks)
    assert (again[0].count(), again[1].count()) == (0, 0)
    counts = enrich.seed_counts(enrich.selected_targets(targets(spark), ("PRIORITY_A", "PRIORITY_B")), again[0]).first()
    assert (counts["created"], counts["existing"], counts["total"]) == (0, 2, 2)


def test_seeding_needs_a_category(spark):
    with pytest.raises(ValueError):
        enrich.selected_targets(targets(spark), ())


def test_evidence_compares_whole_names(spark, rows):
    sources = spark.createDataFrame([("f", "v", "founder_role, client_niche_notes")], "firm_id string, dataset_version string, field_supported string")
    proposed = spark.createDataFrame([("f", "v", "founder_role"), ("f", "v", "client_niche"), ("g", "v", "founder_role")],
                                     "firm_id string, dataset_version string, field string")
    assert rows(enrich.unsupported_fields(proposed, sources), "firm_id", "field") == [("f", "client_niche"), ("g", "founder_role")]


def test_observation_needs_its_own_source(spark, rows):
    sources = spark.createDataFrame([(1, "f", "v"), (2, "g", "v")], "source_id int, firm_id string, dataset_version string")
    seen = spark.createDataFrame([(1, "f", "v"), (2, "f", "v"), (1, "f", "w"), (9, "f", "v")],
                                 "source_id int, firm_id string, dataset_version string")
    assert rows(enrich.misplaced_observations(seen, sources), "source_id", "dataset_version") == [(1, "w"), (2, "v"), (9, "v")]


def loads(spark):
    return spark.createDataFrame(
        [("v1", "success", "2023-01-15 00:00:00", 100, 0.9, 1), ("v2", "failed", "2023-02-10 00:00:00", 200, None, None),
         ("v3", "success", "2023-02-20 00:00:00", 300, None, None), ("v4", "skipped", None, 1, None, None)],
        "dataset_version string, status string, t string, file_size bigint, quality_score double, checks_failed bigint",
    ).withColumn("download_timestamp", F.to_timestamp("t")).drop("t")


def test_history(spark):
    got = {r.month or "all": r for r in rollup.historical(loads(spark)).collect()}
    total = got["all"]
    assert (total.attempts, total.successful, total.failed, total.avg_file_size, total.avg_quality_score) == (4, 2, 1, 150.25, 0.9)
    assert set(got) == {"all", "2023-01", "2023-02"} and got["2023-02"].latest_dataset == "v3"


def test_a_month_ends_before_the_next_begins(spark):
    edge = loads(spark).filter("dataset_version = 'v1'").withColumn("download_timestamp", F.to_timestamp(F.lit("2023-02-01 00:00:00")))
    assert [r.month for r in rollup.monthly(edge).collect()] == ["2023-02"]


def test_date_range_covers_the_last_day(spark, rows):
    df = spark.createDataFrame([("a", "2023-01-31 23:59:59"), ("b", "2023-02-01 00:00:00")], "id string, t string").withColumn(
        "download_timestamp", F.to_timestamp("t"))
    assert rows(rollup.between_dates(df, "2023-01-01", "2023-01-31"), "id") == [("a",)]
    assert rows(rollup.between_dates(df, None, "2023-02-01 00:00:00"), "id") == [("a",), ("b",)]


def test_summary_takes_the_newest_report(spark):
    registry = spark.createDataFrame([("v1", "success"), ("v2", "failed")], "dataset_version string, status string")
    reports = spark.createDataFrame(
        [("v1", "quality", 1, 1, 50.0, 1, 2, None, None, None, None), ("v1", "quality", 2, 2, 80.0, 6, 1, None, None, None, None),
         ("v1", "profiling", 3, 9, 10.0, 0, 0, None, None, None, None), ("v1", "schema_diff", 4, 1, None, None, None, 2, 3, None, None)],
        "dataset_version string, artifact_type string, artifact_id int, written_at int, quality_score double, passed bigint, "
        "failed bigint, missing bigint, extra bigint, added bigint, modified bigint")
    got = {r.dataset_version: r for r in rollup.dataset_summaries(registry, reports).collect()}
    assert (got["v1"].quality_score, got["v1"].checks_passed, got["v1"].missing_columns, got["v1"].artifact_count) == (80.0, 6, 2, 4)
    assert got["v2"].quality_score is None and got["v2"].artifact_count == 0


def test_pca_score(spark):
    df = spark.createDataFrame([(i, float(i), 2.0 * i, 0.0) for i in range(20)], "id int, score_aum double, score_growth double, score_risk double")
    loading = score.first_component(df)
    assert loading[1] == pytest.approx(2 * loading[0]) and loading[1] > 0
    ranked = {r.id: r.acquisition_score for r in score.pca_score(df).collect()}
    assert ranked[0] == 0.05 and ranked[19] == 1.0


def test_degenerate_scores_fall_back(spark):
    same = spark.createDataFrame([(i, 1e9, 1, 0) for i in range(12)],
                                 "firm_id int, total_aum double, private_fund_count int, disciplinary_event_count int")
    assert {round(r.acquisition_score, 6) for r in score.build_scores(same).collect()} == {round(6.5 / 12, 6)}


def test_latest_version_is_by_date_not_by_text(spark):
    df = spark.createDataFrame([("f", "ia12012025", 1), ("f", "ia01012026", 2)], "firm_id string, dataset_version string, n int")
    assert serve.latest_per_key(df, ["firm_id"]).first().n == 2


def test_page_size_is_kept_in_bounds(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("firm_id"), F.col("id").alias("x"))
    assert serve.page(df, "x", 1, 1000).count() == 100 and serve.page(df, "x", 1, 1).count() == 10
    assert [r.x for r in serve.page(df, "x", 2, 10).collect()] == list(range(289, 279, -1))
    assert "TakeOrderedAndProject" in plan_text(serve.page(df, "x"))


def test_transitions(spark, rows):
    log = spark.createDataFrame([("f", "A", 1, 1), ("f", "A", 2, 2), ("f", "B", 2, 3), ("f", "A", 4, 4), ("g", "B", 1, 5)],
                                "firm string, status string, s int, id bigint").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(serve.transitions(log, "firm", "status", "ts", "id"), "firm", "from_status", "to_status") == [
        ("f", "A", "B"), ("f", "B", "A"), ("f", None, "A"), ("g", None, "B")]


def test_dossier(spark):
    scored = spark.createDataFrame(
        [("7", "v1", "Acme & Sons", 52_300_000.0, 26_150_000.0, 0.91, "PRIORITY_A", 3, '["SMALL_EMPLOYEE_BASE"]')],
        "firm_id string, dataset_version string, name string, total_aum double, discretionary_aum double, acquisition_score double, "
        "priority_category string, employee_count int, reason_codes string")
    research = spark.createDataFrame([("7", "v1", "IN_PROGRESS", "", 1_500_000.0)],
                                     "firm_id string, dataset_version string, research_status string, founder_name string, estimated_revenue double")
    sources = spark.createDataFrame([("7", "v1", 5, "iapd", None, "https://x.org", "founder_role", None)],
                                    "firm_id string, dataset_version string, source_id int, source_type string, source_title string, "
                                    "source_url string, field_supported string, accessed_at string")
    def written(*args, **more):
        df = serve.dossier_lines(*args, "2026-01-01T00:00:00Z", **more).orderBy("firm_id", "section", "line_no")
        return [r.line for r in df.collect()]

    lines = written(scored, research, sources)
    for line in (
        "# Target Dossier — Acme & Sons", "- **AUM (SEC-derived):** $52.3M", "- SMALL_EMPLOYEE_BASE",
        "- Discretionary AUM: $26.2M (50.0%)", "- Founder: Unknown", "- Estimated revenue: $1.5M", "- Estimated EBITDA: Unknown",
        "No strategic-fit assessment recorded.",
        "- [https://x.org](https://x.org) — supports `founder_role`; accessed unknown.", "### Data classification",
    ):
        assert line in lines, line
    assert not any("Analyst Review Required" in line for line in lines)
    assert any("Analyst Review Required" in line for line in written(scored, research, sources, draft=True))
    assert "- No sources recorded." in written(scored, research, sources.filter("false"))
    assert "## 2. Why Acme Capital Should Care" in written(scored, research, sources, house="Acme Capital")


def test_taxonomy(spark):
    assert source_taxonomy(spark).count() == 10


def test_both_zeros_are_one_value_in_tables_of_any_width(spark):
    rows = [(0.0,) * 70, (-0.0,) * 70, (None,) * 70]
    wide = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(70)))
    for width in (1, 64, 65, 70):
        found = profile.column_profile(wide.select(*[f"c{i}" for i in range(width)])).collect()
        assert len(found) == width and {(r.unique_values, r.null_count, r.zero_count) for r in found} == {(1, 1, 2)}
