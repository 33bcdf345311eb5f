"""Inputs that the named queries derive from the given tables.

The tables hold clean data, so missing, junk and duplicate cells are written
into them by value rules, over every row.  Each derivation is one SQL text for
both engines; only the spelling of a few functions differs.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
CUTOFF = "1998-04-01"
OLD, NEW = "ia03311998", "ia08012001"
NOW = "2001-08-15 12:00:00"


class SparkText:
    q = staticmethod(lambda name: f"`{name}`")
    comma = staticmethod(lambda x: f"format_number({x}, 2)")
    mdy = staticmethod(lambda d: f"date_format({d}, 'MM/dd/yyyy')")
    version = staticmethod(lambda d: f"concat('ia', date_format({d}, 'MMddyyyy'))")
    f4 = staticmethod(lambda x: f"format_string('%.4f', {x})")
    ts = staticmethod(lambda t: f"date_format({t}, 'yyyy-MM-dd HH:mm:ss')")


class DuckText:
    q = staticmethod(lambda name: f'"{name}"')
    comma = staticmethod(lambda x: f"format('{{:,.2f}}', {x})")
    mdy = staticmethod(lambda d: f"strftime({d}, '%m/%d/%Y')")
    version = staticmethod(lambda d: f"'ia' || strftime({d}, '%m%d%Y')")
    f4 = staticmethod(lambda x: f"printf('%.4f', {x})")
    ts = staticmethod(lambda t: f"strftime({t}, '%Y-%m-%d %H:%M:%S')")


def roster(e) -> str:
    """A raw text roster, one row per customer, with junk in every typed column."""
    q = e.q

    def office(prefix: str, mod: int, tag: str) -> str:
        return f"""
        CASE WHEN c_custkey % {mod} = 0 THEN NULL ELSE c_name || ' {tag}' END AS {q(prefix + ' Street Address 1')},
        n_name AS {q(prefix + ' City')},
        CASE WHEN c_custkey % 10 = 3 THEN 'NA' ELSE right(c_mktsegment, 2) END AS {q(prefix + ' State')},
        CASE c_custkey % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'N' WHEN 2 THEN '' END AS {q(prefix + ' Private Residence Flag')}"""

    return f"""
    SELECT CAST(c_custkey AS STRING) AS {q('Organization CRD#')},
        CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 'N/A' ELSE c_name END AS {q('Legal Name')},
        CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE '801-' || CAST(c_custkey AS STRING) END AS {q('SEC#')},
        CASE WHEN c_custkey % 31 = 0 THEN '' ELSE c_mktsegment END AS {q('Firm Type')},
        CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'APPROVED' END AS {q('SEC Current Status')},
        CASE c_custkey % 4 WHEN 0 THEN 'Y' WHEN 1 THEN ' n ' WHEN 2 THEN '' ELSE 'X' END AS {q('Umbrella Registration')},
        CASE WHEN c_custkey % 13 = 0 THEN 'n/a' WHEN c_custkey % 17 = 0 THEN ''
             ELSE ' ' || {e.comma('c_acctbal')} END AS {q('5.G.(3) - Total amount of Parallel Assets')},
        CASE WHEN c_custkey % 11 = 0 THEN '1.0' WHEN c_custkey % 5 = 0 THEN ''
             ELSE lpad(CAST(c_nationkey AS STRING), 4, ' ') END AS {q('Count of Private Funds - 7B(1)')},
        CAST(c_custkey % 3 AS STRING) AS {q('Count of 11A(1) disclosures')},
        CASE WHEN c_custkey % 19 = 0 THEN '13/40/2026' ELSE {e.mdy('d')} END AS {q('Latest ADV Filing Date')},
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE '1A' END AS {q('Form Version')},
        CASE WHEN c_custkey % 9 = 0 THEN 'Acq ' || c_name END AS {q('Acquired Firm')},
        CASE WHEN c_custkey % 18 = 0 THEN '802-' || CAST(c_custkey AS STRING) END AS {q('Acquired Firm SEC#')},
        '(555) ' || CAST(c_custkey AS STRING) AS {q('Main Office Telephone Number')},
        {office('Main Office', 3, '1')}, {office('Mail Office', 4, '2')}, {office('Location of Books and Records', 6, '3')}
    FROM {{customer}}
    JOIN {{nation}} ON n_nationkey = c_nationkey
    LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS d FROM {{orders}} GROUP BY o_custkey) f ON o_custkey = c_custkey"""


def _scored(side: str, version: str) -> str:
    """Firms from the orders of a period; orders are reduced to one row per firm before they meet customers."""
    money = "CAST(o_totalprice AS DECIMAL(18,2))"

    def amount(which: str) -> str:
        return f"CAST(sum(CASE WHEN {which} THEN {money} END) * 20 AS DOUBLE)"

    return f"""
    SELECT CAST(o_custkey AS STRING) AS firm_id, '{version}' AS dataset_version, c_name AS name,
        total_aum, discretionary_aum, individual_hnw_client_aum, hnw_client_aum, total_account_count, discretionary_account_count,
        employee_count, advisory_employee_count, urgent_pending > 0 AS has_item_11_disclosure,
        high_count > 1 AS has_control_complexity, medium_count > 0 AS provides_financial_planning,
        CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment < 'H' END AS advises_individuals_or_small_businesses,
        right(last_order, 1) AS registration_status,
        CASE WHEN c_mktsegment <> 'MACHINERY' THEN last_priority END AS organization_type,
        'S' || CAST(c_nationkey AS STRING) AS organization_state,
        CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'https://' || lower(c_mktsegment) || '.example.com' END AS website_address,
        CASE WHEN total_aum BETWEEN 20000000 AND 100000000 AND employee_count > 5 THEN 'PRIORITY_A'
             WHEN total_aum BETWEEN 20000000 AND 100000000 THEN 'PRIORITY_B'
             WHEN total_aum >= 10000000 THEN 'PRIORITY_C' ELSE 'EXCLUDED' END AS priority_category
    FROM (SELECT o_custkey,
            {amount("true")} AS total_aum,
            {amount("o_orderpriority <> '5-LOW'")} AS discretionary_aum,
            {amount("o_orderpriority < '4'")} AS individual_hnw_client_aum,
            {amount("o_orderpriority < '3'")} AS hnw_client_aum,
            count(*) * 90 AS total_account_count,
            count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) * 90 AS discretionary_account_count,
            count(*) AS employee_count,
            count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS advisory_employee_count,
            count(CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 1 END) AS urgent_pending,
            count(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 END) AS high_count,
            count(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 END) AS medium_count,
            max(concat(CAST(CAST(o_orderdate AS DATE) AS STRING), lpad(CAST(o_orderkey AS STRING), 20, '0'), o_orderstatus)) AS last_order,
            max(o_orderpriority) AS last_priority
        FROM {{orders}} WHERE o_orderdate {side} TIMESTAMP '{CUTOFF} 00:00:00' GROUP BY o_custkey) o
    JOIN {{customer}} ON c_custkey = o_custkey"""


def scored_old(e) -> str:
    return _scored("<", OLD)


def scored_new(e) -> str:
    return _scored(">=", NEW)


def scored_both(e) -> str:
    return "SELECT * FROM {scored_old} UNION ALL SELECT * FROM {scored_new}"


def ranked(e) -> str:
    """Scored firms of both snapshots with a score column for the serving queries."""
    return """
    SELECT *, CASE WHEN organization_type IS NOT NULL THEN CAST(total_account_count AS DOUBLE) / 10 END AS acquisition_score
    FROM {scored_both}"""


def published(e) -> str:
    """One row per published snapshot, dated by the newest order in it."""
    return f"""
    SELECT CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF} 00:00:00' THEN '{OLD}' ELSE '{NEW}' END AS dataset_version,
        max(o_orderdate) AS published_at
    FROM {{orders}} GROUP BY 1"""


def research(e) -> str:
    """At most one research record per firm of the new snapshot, with odd dates."""
    return f"""
    SELECT CAST(o_custkey AS STRING) AS firm_id, '{NEW}' AS dataset_version,
        CASE WHEN count(*) > 1 THEN 'RESEARCH_COMPLETE' ELSE 'IN_PROGRESS' END AS research_status,
        CASE WHEN o_custkey % 41 = 0 THEN 'not a date' WHEN o_custkey % 37 = 0 THEN ''
             ELSE CAST(CAST(max(o_orderdate) AS DATE) AS STRING) || 'T08:00:00Z' END AS last_researched_at,
        CASE WHEN o_custkey % 3 > 0 THEN 'Founder ' || CAST(o_custkey AS STRING) END AS founder_name,
        CASE WHEN o_custkey % 2 = 0 THEN CAST(max(o_totalprice) AS DOUBLE) * 8 END AS estimated_revenue
    FROM {{orders}}
    WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '{CUTOFF} 00:00:00'
    GROUP BY o_custkey"""


def records(e) -> str:
    """Research records that break some rule here and there, one per order."""
    return """
    SELECT o_orderkey AS record_id, CAST(o_custkey AS STRING) AS firm_id,
        CASE WHEN o_orderkey % 19 = 0 THEN 'DONE' WHEN o_orderkey % 53 = 0 THEN NULL ELSE 'IN_PROGRESS' END AS research_status,
        CASE o_orderstatus WHEN 'P' THEN 'CERTAIN' WHEN 'O' THEN '' ELSE 'HIGH' END AS ownership_confidence,
        CASE WHEN o_orderpriority = '5-LOW' THEN 'NONE' ELSE 'LOW' END AS succession_signal_strength,
        CASE WHEN o_orderkey % 17 = 0 THEN -o_totalprice ELSE o_totalprice END AS estimated_revenue,
        o_totalprice AS estimated_valuation_low,
        CASE WHEN o_orderkey % 23 = 0 THEN o_totalprice - 1 ELSE o_totalprice + 1000 END AS estimated_valuation_high,
        CASE WHEN o_orderkey % 29 = 0 THEN 'yesterday' WHEN o_orderkey % 31 = 0 THEN '12:30' WHEN o_orderkey % 37 = 0 THEN 'T08:00'
             WHEN o_orderkey % 41 = 0 THEN '2024' WHEN o_orderkey % 43 = 0 THEN '2024-01' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T00:00:00Z' END
            AS last_researched_at
    FROM {orders}"""


def sources(e) -> str:
    """Evidence sources, one per order."""
    return f"""
    SELECT o_orderkey AS source_id, CAST(o_custkey AS STRING) AS firm_id, '{NEW}' AS dataset_version,
        CASE o_orderstatus WHEN 'F' THEN 'adv_part2a' WHEN 'O' THEN 'official_website' ELSE 'public_biography' END AS source_type,
        CASE WHEN o_orderpriority > '2' THEN 'Title ' || CAST(o_orderkey AS STRING) END AS source_title,
        CASE WHEN o_orderpriority > '1-X' THEN 'https://example.org/' || CAST(o_orderkey AS STRING) END AS source_url,
        CASE o_orderstatus WHEN 'F' THEN 'founder_role, client_niche' WHEN 'O' THEN 'client_niche custodian_notes'
             ELSE 'geographic_focus' END AS field_supported,
        CASE WHEN o_orderpriority < '5' THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END AS accessed_at
    FROM {{orders}}"""


def observations(e) -> str:
    """Observations from line items; some name a source of another firm."""
    return f"""
    SELECT l_orderkey AS source_id,
        CAST(o_custkey + CASE WHEN l_orderkey % 29 = 0 THEN 1 ELSE 0 END AS STRING) AS firm_id, '{NEW}' AS dataset_version,
        CASE l_returnflag WHEN 'A' THEN 'client_niche' WHEN 'N' THEN 'founder_role' ELSE '' END AS canonical_field,
        l_quantity AS proposed_value,
        CASE WHEN l_linenumber = 7 THEN 'GUESS' ELSE 'FACT' END AS value_type,
        CASE WHEN l_tax > 0.07 THEN 'SURE' WHEN l_tax > 0.03 THEN 'HIGH' END AS confidence,
        CASE l_linestatus WHEN 'F' THEN 'ACCEPTED' ELSE 'PROPOSED' END AS review_status
    FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey"""


def proposed(e) -> str:
    """Fields proposed for a firm's record, from line items."""
    return f"""
    SELECT CAST(o_custkey AS STRING) AS firm_id, '{NEW}' AS dataset_version,
        CASE l_returnflag WHEN 'A' THEN 'client_niche' WHEN 'N' THEN 'founder_role' ELSE 'custodian' END AS field
    FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey"""


def registry(e) -> str:
    """Dataset registry, one load per event."""
    return """
    SELECT 'v' || CAST(event_id AS STRING) AS dataset_version, event_id,
        CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'success' END AS status,
        ts AS download_timestamp, CAST(event_id % 1000 AS BIGINT) AS file_size
    FROM {events}"""


def loads(e) -> str:
    return """
    SELECT dataset_version, status, CASE WHEN r.event_id % 11 > 0 THEN download_timestamp END AS download_timestamp, file_size,
        CASE WHEN r.event_id % 3 > 0 THEN value END AS quality_score, CAST(r.event_id % 4 AS BIGINT) AS checks_failed
    FROM {registry} r JOIN {events} v ON v.event_id = r.event_id"""


def artifacts(e) -> str:
    """Report artifacts, one per order; a version has several of a type."""
    return """
    SELECT 'v' || CAST(o_custkey AS STRING) AS dataset_version, o_orderkey AS artifact_id, o_orderdate AS written_at,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'quality' WHEN '2-HIGH' THEN 'profiling' WHEN '3-MEDIUM' THEN 'schema_diff'
             WHEN '4-NOT SPECIFIED' THEN 'change_detection' ELSE 'dictionary' END AS artifact_type,
        o_totalprice AS quality_score, CAST(o_orderkey % 7 AS BIGINT) AS passed, CAST(o_orderkey % 3 AS BIGINT) AS failed,
        CAST(o_orderkey % 5 AS BIGINT) AS missing, CAST(o_orderkey % 11 AS BIGINT) AS extra,
        CAST(o_orderkey % 13 AS BIGINT) AS added, CAST(o_orderkey % 17 AS BIGINT) AS modified
    FROM {orders}"""


def log_lines(e) -> str:
    return f"""
    SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed'
        ELSE {e.ts('ts')} || ' | INFO | ' || CASE WHEN event_id % 7 = 0 THEN 'note | with bars' ELSE
             'EXEC|' || event_type || '|' || {e.f4('value')} || 's|' || CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'SUCCESS' END
             END END AS value
    FROM {{events}}"""


def lineage(e) -> str:
    """A version tree over every order: the parent is a third of the number."""
    return """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey > 0 THEN CAST(floor((o_orderkey - 1) / 3.0) AS BIGINT) END AS parent,
        o_orderdate AS created_at
    FROM {orders}"""


def broken_lineage(e) -> str:
    """The same tree with parents that do not exist for low-priority orders."""
    return """
    SELECT o_orderkey AS id,
        CASE WHEN o_orderpriority = '5-LOW' THEN -o_orderkey - 1
             WHEN o_orderkey > 0 THEN CAST(floor((o_orderkey - 1) / 3.0) AS BIGINT) END AS parent,
        o_orderkey - 1 AS prev, o_orderkey + 1 AS next
    FROM {orders}"""


def names(e) -> str:
    """Column-like names, one per part."""
    heads = (
        "Organization CRD# ", "Legal Name ", "Main Office City ", "Form Version ", "Umbrella Registration ", "1I ",
        "2A( ", "5F ", "6A ", "7B Any ", "7A Total number of ", "8C ", "9A ", "Under Common Control ",
        "Count of 11 disclosures ", "11C ", "12B ", "Total ", "SEC Region ", "plain ",
    )
    cases = " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(heads))
    return f"SELECT CASE p_partkey % {len(heads)} {cases} END || p_name || ' ' || p_type AS column_name FROM {{part}}"


def offices(e) -> str:
    """Typed offices with more than one MAIN office for some firms, one per order."""
    return f"""
    SELECT CAST(o_custkey AS STRING) AS firm_id,
        CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF} 00:00:00' THEN '{OLD}' ELSE '{NEW}' END AS dataset_version,
        CASE WHEN o_orderpriority < '4' THEN 'MAIN' ELSE 'MAIL' END AS office_type,
        'Street ' || CAST(o_orderkey AS STRING) AS street_address_1, CAST(NULL AS STRING) AS street_address_2,
        CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'City ' || o_orderstatus END AS city, o_orderstatus AS state,
        'US' AS country, CAST(o_orderkey AS STRING) AS telephone
    FROM {{orders}}"""


def contacts(e) -> str:
    return f"""
    SELECT CAST(c_custkey AS STRING) AS firm_id, '{NEW}' AS dataset_version, 'Contact of ' || c_name AS contact_name,
        CASE c_mktsegment WHEN 'BUILDING' THEN NULL ELSE lower(c_mktsegment) || '@example.com' END AS email
    FROM {{customer}}"""


def outreach(e) -> str:
    return """
    SELECT firm_id, dataset_version,
        CASE WHEN employee_count > 6 THEN 'CONTACTED' WHEN employee_count > 4 THEN 'READY' ELSE 'NOT_RESEARCHED' END AS status
    FROM {scored_both}"""


def activities(e) -> str:
    """Outreach activities from events."""
    return """
    SELECT CAST(user_id AS STRING) AS firm_id, event_id, event_type AS activity_type, ts AS occurred_at FROM {events}"""


def task_log(e) -> str:
    return """
    SELECT user_id AS task_id, event_id, ts,
        CASE event_type WHEN 'view' THEN 'DISCOVERED' WHEN 'click' THEN 'RETRIEVED' WHEN 'purchase' THEN 'ACCEPTED'
             WHEN 'error' THEN 'FAILED' ELSE 'REVIEW_REQUIRED' END AS status
    FROM {events}"""


def category_scores(e) -> str:
    """Long category scores: each order gives one category of its firm a score."""
    return """
    SELECT o_custkey, category, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS score FROM (
        SELECT o_custkey, o_totalprice,
            CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'ASSETS_UNDER_MANAGEMENT'
                 WHEN o_orderpriority = '1-URGENT' THEN 'CLIENT_BASE' WHEN o_orderpriority = '2-HIGH' THEN 'GEOGRAPHIC_FIT'
                 WHEN o_orderpriority = '3-MEDIUM' THEN 'SERVICE_OFFERINGS' WHEN o_orderstatus = 'F' THEN 'FEE_STRUCTURE'
                 WHEN o_orderstatus = 'O' THEN 'REGULATORY_HISTORY' ELSE 'GROWTH_POTENTIAL' END AS category
        FROM {orders}) x
    GROUP BY o_custkey, category"""


def part_scores(e) -> str:
    """Score inputs per part from all line items; the amount is an exact decimal sum."""
    return """
    SELECT l_partkey AS firm_id, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 2000 AS DOUBLE) AS total_aum,
        count(*) AS private_fund_count, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS disciplinary_event_count
    FROM {lineitem} GROUP BY l_partkey"""


def filings_raw(e) -> str:
    q = e.q
    return f"""
    SELECT CAST(o_custkey AS STRING) AS {q('Organization CRD#')},
        CASE WHEN o_orderkey % 31 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END
            AS {q('Latest ADV Filing Date')},
        CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE '1A' END AS {q('Form Version')}
    FROM {{orders}}"""


def columns_old(e) -> str:
    """(table_name, column_name) pairs of an earlier extract, from the parts."""
    return "SELECT 'table ' || p_type AS table_name, 'c_' || p_name AS column_name FROM {part} WHERE p_size < 40"


def columns_new(e) -> str:
    return """
    SELECT 'table ' || CASE WHEN p_type = 'ECONOMY' THEN 'NEW' ELSE p_type END AS table_name, 'c_' || p_name AS column_name
    FROM {part} WHERE p_size > 10"""


INPUTS = {
    f.__name__: f
    for f in (
        roster, scored_old, scored_new, scored_both, ranked, published, research, records, sources, observations,
        proposed, registry, loads, artifacts, log_lines, lineage, broken_lineage, names, offices, contacts, outreach,
        activities, task_log, category_scores, part_scores, filings_raw, columns_old, columns_new,
    )
}
NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a derived input as a lazy DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = INPUTS[name](SparkText)
    parts = {n: frame(spark, sf_dir, n) for n in NAME.findall(text)}
    return spark.sql(text, **parts)


@cache
def _needed(name: str) -> tuple[str, ...]:
    """Derived inputs that ``name`` needs, itself last."""
    out: list[str] = []
    for part in NAME.findall(INPUTS[name](DuckText)):
        if part in INPUTS:
            out += [n for n in _needed(part) if n not in out]
    return (*out, name)


def ctes(*names: str) -> str:
    """A WITH clause that defines derived inputs for the checking SQL."""
    order: list[str] = []
    for name in names:
        order += [n for n in _needed(name) if n not in order]
    parts = [f"{n} AS ({NAME.sub(lambda m: m.group(1), INPUTS[n](DuckText))})" for n in order]
    return "WITH " + ",\n".join(parts) + "\n"
