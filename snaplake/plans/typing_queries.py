"""Typing, normalisation, labels, text and hashing."""

from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions import keys, labels, text, typing
from snaplake.operators import enrich, normalize, profile
from snaplake.plans.inputs import ctes, frame, table
from snaplake.plans.registry import query
from snaplake.sources import dimensions

RUN_TIME = "2001-08-15 12:00:00"
TOKENS = ", ".join(f"'{t}'" for t in fv.NULL_TOKENS)


def _null(c: str) -> str:
    return f"CASE WHEN trim({c}) NOT IN ({TOKENS}) THEN {c} END"


def _money(c: str) -> str:
    return f"TRY_CAST(trim(replace({c}, ',', '')) AS DECIMAL(20,2))"


def _count(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^[+-]?[0-9]+$') THEN TRY_CAST(trim({c}) AS BIGINT) END"


def _flag(c: str) -> str:
    return f"CASE upper(trim({c})) WHEN 'Y' THEN true WHEN 'N' THEN false END"


def _date(c: str) -> str:
    return f"TRY_STRPTIME(trim({c}), '%m/%d/%Y')"


AUM = '"5.G.(3) - Total amount of Parallel Assets"'
FUNDS = '"Count of Private Funds - 7B(1)"'
CRD = '"Organization CRD#"'


@query("normalize_money_int_date_flag", ctes("roster") + f"""
SELECT {CRD} AS firm_id, CAST({_money(AUM)} AS DOUBLE) AS total_aum, {_count(FUNDS)} AS private_fund_count,
    {_flag('"Umbrella Registration"')} AS umbrella_registration,
    strftime({_date('"Latest ADV Filing Date"')}, '%Y-%m-%d') AS filing_date, {_null('"SEC#"')} AS sec_number
FROM roster""")
def normalize_money_int_date_flag(spark, d):
    return frame(spark, d, "roster").select(
        F.col("`Organization CRD#`").alias("firm_id"),
        typing.money(F.col("`5.G.(3) - Total amount of Parallel Assets`")).cast("double").alias("total_aum"),
        typing.whole_number(F.col("`Count of Private Funds - 7B(1)`")).alias("private_fund_count"),
        typing.yes_no_flag(F.col("`Umbrella Registration`")).alias("umbrella_registration"),
        F.date_format(typing.us_date(F.col("`Latest ADV Filing Date`")), "yyyy-MM-dd").alias("filing_date"),
        typing.null_if_missing(F.col("`SEC#`")).alias("sec_number"),
    )


@query("flag_yes_only", ctes("roster") + f"""
SELECT {CRD} AS firm_id, coalesce(upper(trim("Umbrella Registration")) = 'Y', false) AS flag,
    {_flag('"Main Office Private Residence Flag"')} AS is_private_residence FROM roster""")
def flag_yes_only(spark, d):
    return frame(spark, d, "roster").select(
        F.col("`Organization CRD#`").alias("firm_id"),
        typing.yes_only_flag(F.col("`Umbrella Registration`")).alias("flag"),
        typing.yes_no_flag(F.col("`Main Office Private Residence Flag`")).alias("is_private_residence"),
    )


_FIRM_SQL = f"""
    SELECT {_null(CRD)} AS firm_id, {_null('"SEC#"')} AS sec_number, {_null('"Legal Name"')} AS name,
        {_null('"Firm Type"')} AS firm_type, {_flag('"Umbrella Registration"')} AS umbrella_registration,
        CAST({_money(AUM)} AS DOUBLE) AS total_aum, {_count(FUNDS)} AS private_fund_count,
        {_count('"Count of 11A(1) disclosures"')} AS disciplinary_event_count,
        {_null('"SEC Current Status"')} AS sec_current_status,
        {_date('"Latest ADV Filing Date"')} AS latest_adv_filing_date, {_null('"Form Version"')} AS form_version
    FROM roster"""
_FIRM_COLUMNS = (
    "firm_id", "sec_number", "name", "firm_type", "umbrella_registration", "total_aum", "private_fund_count",
    "disciplinary_event_count", "sec_current_status", "latest_adv_filing_date", "form_version",
)


def _shown(df, *more):
    """The columns that the roster fills, amounts as double and times without a zone."""
    return df.select(
        *[
            F.col(c).cast("double").alias(c) if c == "total_aum"
            else F.col(c).cast("timestamp_ntz").alias(c) if c == "latest_adv_filing_date" else F.col(c)
            for c in _FIRM_COLUMNS
        ],
        *more,
    )


@query("normalize_mapping_projection", ctes("roster") + f"""
SELECT *, CAST(NULL AS DOUBLE) AS discretionary_aum, CAST(NULL AS VARCHAR) AS cik_number,
    coalesce(nullif(form_version, ''), 'Unknown') AS form_label FROM ({_FIRM_SQL})""")
def normalize_mapping_projection(spark, d):
    return _shown(
        normalize.mapped(frame(spark, d, "roster")), F.col("discretionary_aum").cast("double").alias("discretionary_aum"),
        "cik_number", labels.text_or(F.col("form_version")).alias("form_label"),
    )


@query("normalize_required_split", ctes("roster") + f"""
SELECT firm_id, name IS NOT NULL AND firm_id IS NOT NULL AS accepted,
    CASE WHEN name IS NULL THEN 'missing name' ELSE '' END AS rejected_for FROM ({_FIRM_SQL})""")
def normalize_required_split(spark, d):
    accepted, refused = normalize.split_required(normalize.mapped(frame(spark, d, "roster")))
    return accepted.select("firm_id", F.lit(True).alias("accepted"), F.lit("").alias("rejected_for")).unionByName(
        refused.select("firm_id", F.lit(False).alias("accepted"), F.array_join("rejected_for", "|").alias("rejected_for"))
    )


def _snapshot(spark, d):
    return normalize.normalise_snapshot(frame(spark, d, "roster"), "ia08152001", F.lit(RUN_TIME).cast("timestamp"))


_TRACK = "'ia08152001' AS dataset_version, 'active' AS current_status"


@query("normalize_snapshot_firms", ctes("roster") + f"SELECT *, {_TRACK} FROM ({_FIRM_SQL}) WHERE name IS NOT NULL")
def normalize_snapshot_firms(spark, d):
    return _shown(_snapshot(spark, d)["firms"], "dataset_version", "current_status")


def _office_sql() -> str:
    parts = []
    for kind, prefix in fv.OFFICE_PREFIXES:
        phone = _null(f'"{prefix} Telephone Number"') if kind == "MAIN" else "CAST(NULL AS VARCHAR)"
        parts.append(f"""
        SELECT {_null(CRD)} AS firm_id, '{kind}' AS office_type, {_null(f'"{prefix} Street Address 1"')} AS street_address_1,
            {_null(f'"{prefix} City"')} AS city, {_null(f'"{prefix} State"')} AS state,
            {_flag(f'"{prefix} Private Residence Flag"')} AS is_private_residence, {phone} AS telephone
        FROM roster WHERE {_null('"Legal Name"')} IS NOT NULL AND {_null(f'"{prefix} Street Address 1"')} IS NOT NULL""")
    return " UNION ALL ".join(parts)


@query("normalize_snapshot_offices", ctes("roster") + _office_sql())
def normalize_snapshot_offices(spark, d):
    return _snapshot(spark, d)["firm_offices"].select(
        "firm_id", "office_type", "street_address_1", "city", "state", "is_private_residence", "telephone"
    )


_ACQUIRED_SQL = f"""
SELECT {_null(CRD)} AS parent_firm_id, {_null('"Acquired Firm"')} AS acquired_name,
    {_null('"Acquired Firm SEC#"')} AS acquired_sec_number, CAST(NULL AS VARCHAR) AS acquired_crd_number
FROM roster WHERE "Acquired Firm" IS NOT NULL"""


@query("normalize_snapshot_acquired", ctes("roster") + _ACQUIRED_SQL + f" AND {_null(chr(34) + 'Legal Name' + chr(34))} IS NOT NULL")
def normalize_snapshot_acquired(spark, d):
    return _snapshot(spark, d)["firm_acquired_firms"].select(
        "parent_firm_id", "acquired_name", "acquired_sec_number", "acquired_crd_number"
    )


@query("normalize_quarantine", ctes("roster") + f"""
SELECT firm_id, 'missing name' AS rejected_for, {_TRACK} FROM ({_FIRM_SQL}) WHERE name IS NULL""")
def normalize_quarantine(spark, d):
    return _snapshot(spark, d)["quarantine"].select(
        "firm_id", F.array_join("rejected_for", "|").alias("rejected_for"), "dataset_version", "current_status"
    )


@query("unpivot_offices", ctes("roster") + _office_sql().replace(f"WHERE {_null(chr(34) + 'Legal Name' + chr(34))} IS NOT NULL AND", "WHERE"))
def unpivot_offices(spark, d):
    return normalize.offices(frame(spark, d, "roster")).select(
        "firm_id", "office_type", "street_address_1", "city", "state", "is_private_residence", "telephone"
    )


@query("conditional_child", ctes("roster") + _ACQUIRED_SQL)
def conditional_child(spark, d):
    return normalize.acquired_firms(frame(spark, d, "roster"))


@query("row_hash", """
SELECT c_custkey, sha256(concat_ws(chr(31), CAST(c_custkey AS VARCHAR), c_mktsegment, coalesce(c_name, chr(30)),
    CAST(c_nationkey AS VARCHAR))) AS record_hash FROM customer""")
def row_hash(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", keys.row_hash(["c_name", "c_mktsegment", "c_nationkey", "c_custkey"]).alias("record_hash")
    )


_WORD = """CASE c_custkey % 12 WHEN 0 THEN 'TRUE' WHEN 1 THEN ' t' WHEN 2 THEN 'Yes' WHEN 3 THEN '1' WHEN 4 THEN 'no'
    WHEN 5 THEN '' WHEN 6 THEN 'F' WHEN 7 THEN '0' WHEN 8 THEN '2.5' WHEN 9 THEN '0.0' WHEN 10 THEN 'maybe' END"""


@query("lenient_bool", f"""
SELECT c_custkey, CASE WHEN lower(trim(w)) IN ('true','t','yes','y','1') THEN true
    WHEN lower(trim(w)) IN ('false','f','no','n','0','') THEN false ELSE TRY_CAST(trim(w) AS DOUBLE) <> 0 END AS flag
FROM (SELECT c_custkey, {_WORD} AS w FROM customer)""")
def lenient_bool(spark, d):
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_WORD} AS w").select(
        "c_custkey", typing.lenient_flag(F.col("w")).alias("flag")
    )


@query("nan_to_null", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS amount FROM orders""")
def nan_to_null(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN double('NaN') ELSE o_totalprice END AS amount"
    ).select("o_orderkey", typing.nan_to_null(F.col("amount")).alias("amount"))


# Halves of a printed digit differ between engines, so amounts are cut to whole numbers of that digit.
_AMOUNT = "CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_custkey % 2 = 0 THEN floor(c_acctbal) * 100000 ELSE floor(c_acctbal) END"


@query("label_money_percent", f"""
SELECT c_custkey,
    CASE WHEN x IS NULL THEN 'Unknown' WHEN abs(x) >= 1000000 THEN printf('$%.1fM', x / 1000000)
         ELSE '$' || format('{{:,.0f}}', x) END AS money_label,
    CASE WHEN c_nationkey % 3 = 0 THEN 'Unknown' ELSE printf('%.1f%%', (c_custkey % 7) / (3 * (c_nationkey % 3)) * 100) END AS percent_label
FROM (SELECT c_custkey, c_nationkey, CAST({_AMOUNT} AS DOUBLE) AS x FROM customer)""")
def label_money_percent(spark, d):
    return table(spark, d, "customer").selectExpr(
        "c_custkey", "3 * (c_nationkey % 3) AS whole", f"CAST({_AMOUNT} AS DOUBLE) AS x", "c_custkey % 7 AS part"
    ).select(
        "c_custkey", labels.money_label(F.col("x")).alias("money_label"),
        labels.percent_label(F.col("part"), F.col("whole")).alias("percent_label"),
    )


@query("slug_file_key", """
SELECT p_partkey, CAST(p_partkey AS VARCHAR) || '_' ||
    trim(regexp_replace(lower(p_brand || ' & ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_') || '.md' AS file_key
FROM part""")
def slug_file_key(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        labels.file_key(F.col("p_partkey").cast("string"), F.concat("p_brand", F.lit(" & "), "p_name", F.lit("!"))).alias("file_key"),
    )


@query("codes_from_json", """
SELECT doc, array_to_string(CASE kind WHEN 0 THEN [event_type, 'X'] WHEN 1 THEN [] ELSE [] END, '|') AS codes,
    CASE kind WHEN 0 THEN 2 ELSE 0 END AS n
FROM (SELECT event_id AS doc, event_type, event_id % 3 AS kind FROM events)""")
def codes_from_json(spark, d):
    text_ = F.expr("""CASE event_id % 3 WHEN 0 THEN concat('["', event_type, '","X"]')
        WHEN 1 THEN props ELSE concat('[', event_type) END""")
    return table(spark, d, "events").select(F.col("event_id").alias("doc"), keys.json_codes(text_).alias("c")).select(
        "doc", F.array_join("c", "|").alias("codes"), F.size("c").alias("n")
    )


@query("pack_json", """
SELECT c_custkey, '{"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' || CAST(c_nationkey AS VARCHAR) || ',"none":null}'
    AS packed FROM customer""")
def pack_json(spark, d):
    return table(spark, d, "customer").withColumn("none", F.lit(None).cast("string")).select(
        "c_custkey", keys.pack_json(["c_mktsegment", "c_nationkey", "none"]).alias("packed")
    )


@query("link_extract", """
SELECT page_id, href, CASE WHEN regexp_matches(href, '^https?://') THEN href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || href
    ELSE regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/' || href END AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages)""")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", "url", F.explode(text.links(F.col("html"))).alias("href")).select(
        "page_id", "href", text.absolute_link(F.col("href"), F.col("url")).alias("link")
    )


@query("page_hash_dedupe", """
SELECT min(h) AS content_hash, min(doc_id) AS doc_id FROM (SELECT doc_id, text, sha256(text) AS h FROM documents) d
WHERE h NOT IN (SELECT sha256(text) FROM benchmark) GROUP BY h""")
def page_hash_dedupe(spark, d):
    known = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("content_hash"))
    return enrich.new_captures(table(spark, d, "documents").select("doc_id", "text"), known, "text")


_URLS = {r[0]: r[3] for r in fv.SOURCE_TAXONOMY}
_TYPE = "CASE c_nationkey % 4 WHEN 0 THEN 'official_website' WHEN 1 THEN 'iapd' WHEN 2 THEN 'brokercheck' ELSE 'business_registry' END"
_SITE = "CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'https://' || lower(c_mktsegment) || '.example.com' END"


@query("resolve_url", f"""
SELECT c_custkey, t AS source_type, CASE t WHEN 'official_website' THEN nullif({_SITE}, '')
    WHEN 'iapd' THEN '{_URLS["iapd"]}' WHEN 'brokercheck' THEN '{_URLS["brokercheck"]}' END AS source_url
FROM (SELECT *, {_TYPE} AS t FROM customer)""")
def resolve_url(spark, d):
    taxonomy = dimensions.source_taxonomy(spark).select("source_type", "taxonomy_url")
    return table(spark, d, "customer").selectExpr("c_custkey", f"{_TYPE} AS source_type", f"{_SITE} AS site").join(
        F.broadcast(taxonomy), "source_type"
    ).select(
        "c_custkey", "source_type",
        text.source_address(F.col("source_type"), F.col("site"), F.col("taxonomy_url")).alias("source_url"),
    )


_CLASS_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(column_name, '{p}') THEN '{c}'" for p, c in fv.NAME_CLASSES
) + " ELSE 'unclassified' END"


@query("classify_names", ctes("names") + f"SELECT column_name, {_CLASS_SQL} AS name_class FROM names")
def classify_names(spark, d):
    return profile.classify_names(frame(spark, d, "names"), "column_name")


_RULES_SQL = ", ".join(
    f"('{e}', '{c}', {', '.join('NULL' if t is None else repr(t) for t in (k, o, *fv.ENTITY_TEXTS[e]))})" for e, cs, k, o in fv.ENTITY_RULES for c in cs
)


@query("entity_groups", ctes("names") + f"""
SELECT entity, column_name AS attribute, CAST(key_column AS VARCHAR) AS key_column, CAST(foreign_key AS VARCHAR) AS foreign_key, description
FROM (SELECT DISTINCT column_name, {_CLASS_SQL} AS name_class FROM names) n
JOIN (VALUES {_RULES_SQL}) r(entity, name_class, key_column, left_out, foreign_key, description) USING (name_class)
WHERE left_out = '' OR NOT regexp_matches(column_name, left_out)""")
def entity_groups(spark, d):
    return profile.entity_attributes(frame(spark, d, "names"), "column_name")


@query("period_keys", f"""
SELECT event_id, strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day,
    CAST(floor((epoch_us(TIMESTAMP '2024-03-01 06:00:00') - epoch_us(ts)) / 86400000000) AS BIGINT) AS age_days FROM events""")
def period_keys(spark, d):
    now = F.lit("2024-03-01 06:00:00").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", keys.month_key(F.col("ts")).alias("month"), keys.date_key(F.col("ts")).alias("day"),
        keys.age_in_days(F.col("ts"), now).alias("age_days"),
    )


@query("version_dates", """
SELECT DISTINCT 'ia' || strftime(o_orderdate, '%m%d%Y') AS dataset_version, CAST(o_orderdate AS DATE) AS version_date FROM orders""")
def version_dates(spark, d):
    labels_ = table(spark, d, "orders").select(
        F.concat(F.lit("ia"), F.date_format("o_orderdate", "MMddyyyy")).alias("dataset_version")
    ).distinct()
    return labels_.withColumn("version_date", keys.version_date(F.col("dataset_version")))
