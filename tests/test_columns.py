"""Column functions on hand-written cells."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions import keys, labels, rules, text, typing


def cells(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


def test_missing_tokens(spark):
    values = ["", "NA", " n/a ", "None", "NAN", "x", None, "a,b", "N", "<NA>"]
    assert cells(spark, values, typing.null_if_missing) == [None, None, None, None, "NAN", "x", None, "a,b", "N", None]


def test_every_missing_token(spark):
    assert set(cells(spark, list(fv.NULL_TOKENS), typing.null_if_missing)) == {None}


def test_missing_tokens_over_a_table(spark):
    df = spark.createDataFrame([("NA", 1, "x"), ("y", 2, "null")], "`a b#` string, n int, c string")
    assert [tuple(r) for r in typing.missing_tokens_to_null(df).orderBy("n").collect()] == [(None, 1, "x"), ("y", 2, None)]


def test_flags(spark):
    values = ["Y", " n ", "", "X", None, "y"]
    assert cells(spark, values, typing.yes_no_flag) == [True, False, None, None, None, True]
    assert cells(spark, values, typing.yes_only_flag) == [True, False, False, False, False, True]


def test_lenient_flag(spark):
    values = ["TRUE", " t", "no", "", "2", "0.0", "maybe", None]
    assert cells(spark, values, typing.lenient_flag) == [True, True, False, False, True, False, None, None]


def test_money(spark):
    values = ["1,234.50", " 7 ", "n/a", "", None, "-3", "1\t"]
    want = [Decimal("1234.50"), Decimal("7.00"), None, None, None, Decimal("-3.00"), Decimal("1.00")]
    assert cells(spark, values, typing.money) == want


def test_counts(spark):
    assert cells(spark, ["12", " +3 ", "1.0", "", None, "x", "-4"], typing.whole_number) == [12, 3, None, None, None, None, -4]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789+-. ,x", max_size=6), min_size=1, max_size=40))
def test_counts_like_int(spark, values):
    def plain(v):
        try:
            return int(v.strip())
        except ValueError:
            return None

    assert cells(spark, values, typing.whole_number) == [plain(v) for v in values]


def test_dates(spark):
    got = cells(spark, ["7/1/2026", "07/01/2026", "13/40/2026", "", None], typing.us_date)
    assert got == [dt.datetime(2026, 7, 1)] * 2 + [None] * 3


def test_nan(spark):
    assert cells(spark, [1.0, float("nan"), None], typing.nan_to_null, "double") == [1.0, None, None]


def test_money_label(spark):
    got = cells(spark, [None, 12.0, 999999.0, 1e6, 25_500_000.0, -2e6], labels.money_label, "double")
    assert got == ["Unknown", "$12", "$999,999", "$1.0M", "$25.5M", "$-2.0M"]


def test_percent_label(spark):
    df = spark.createDataFrame([(1.0, 3.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(labels.percent_label(F.col("a"), F.col("b"))).collect()] == ["33.3%", "Unknown", "Unknown"]


def test_slug(spark):
    assert cells(spark, ["  Smith & Co., LLC! ", "ABC"], labels.slug) == ["smith_co_llc", "abc"]


def test_row_hash_ignores_column_order_and_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("", "a")], "x string, y string")
    one = [r[0] for r in df.select(keys.row_hash(["x", "y"])).collect()]
    two = [r[0] for r in df.select("y", "x").select(keys.row_hash(["y", "x"])).collect()]
    assert one == two and len(set(one)) == 3


def test_age_counts_whole_days(spark):
    df = spark.sql("SELECT timestamp '2026-01-01 13:00:00' AS t")
    now = F.lit("2026-01-03 12:59:59").cast("timestamp")
    assert df.select(keys.age_in_days(F.col("t"), now)).first()[0] == 1


def test_version_date(spark):
    got = cells(spark, ["ia07012026", "ia13992026", "v1", None], keys.version_date)
    assert got == [dt.date(2026, 7, 1), None, None, None]


def test_json_codes(spark):
    assert cells(spark, ['["A","B"]', "{", '{"k":1}', None, "[]"], keys.json_codes) == [["A", "B"], [], [], [], []]


def test_links(spark):
    page = '<a href="/files/ia07012026.zip">x</a><a href="https://b.org/">y</a><a href="z.html">'
    df = spark.createDataFrame([(page, "https://a.org/x/y?z")], "html string, url string")
    got = df.select(F.explode(text.links(F.col("html"))).alias("h"), "url").select(text.absolute_link(F.col("h"), F.col("url")))
    assert [r[0] for r in got.collect()] == ["https://a.org/files/ia07012026.zip", "https://b.org/", "https://a.org/z.html"]


@pytest.mark.parametrize("name, want", [
    ("Organization CRD#", "firm_ident"), ("SEC Region", "misc"), ("Form Version", "registration"),
    ("5F(1)", "business_activities"), ("Count of 11A(1) disclosures", "disclosures"), ("zzz", "unclassified"),
])
def test_name_class(spark, name, want):
    assert cells(spark, [name], text.name_class) == [want]


def test_record_rules(spark):
    df = spark.createDataFrame(
        [("IN_PROGRESS", "HIGH", "1", "5", "9", "2026-01-01T00:00:00Z"), ("DONE", "SURE", "-1", "9", "5", "soon"), (None, "", "x", "", "5", "")],
        "research_status string, ownership_confidence string, estimated_revenue string, estimated_valuation_low string, "
        "estimated_valuation_high string, last_researched_at string",
    )
    got = [r[0] for r in df.select(rules.record_violations(df.columns)).collect()]
    assert got[0] == []
    assert got[1] == ["research_status", "ownership_confidence", "estimated_revenue", "valuation_range", "last_researched_at"]
    assert got[2] == ["research_status", "estimated_revenue"]


def test_observation_rules(spark):
    df = spark.createDataFrame(
        [("FACT", None, "PROPOSED", "name"), ("GUESS", "SURE", "x", ""), (None, "", None, None)],
        "value_type string, confidence string, review_status string, canonical_field string",
    )
    got = [r[0] for r in df.select(rules.observation_violations()).collect()]
    assert got == [[], ["value_type", "confidence", "review_status", "canonical_field"],
                   ["value_type", "review_status", "canonical_field"]]


@pytest.mark.parametrize("text, whole", [
    ("2024-01-15", True), ("2024-01-15T08:00:00Z", True), ("2024-01-15 08:00:00", True), ("2024-01-15T08:00:00+02:00", True),
    ("12:30", False), ("T08:00", False), ("2024", False), ("2024-01", False), ("yesterday", False), ("", False), ("2024-13-01", False),
])
def test_iso_timestamps_need_a_whole_date(spark, text, whole):
    found = spark.createDataFrame([(text,)], "t string").select(typing.iso_timestamp(F.col("t")).alias("ts")).first()["ts"]
    assert (found is not None) == whole
