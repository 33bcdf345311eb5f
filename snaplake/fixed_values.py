"""Lists, thresholds, patterns and labels that results depend on.

Nothing in this module is logic.  The values are stated as they are because
results must agree with them; change one and the results change.
"""

# ---------------------------------------------------------------- missing text
# The default missing-value tokens of pandas.read_csv (public documentation).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
WHITESPACE = " \t\n\r\x0b\x0c"

TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0", "")

# ------------------------------------------------------------- research values
RESEARCH_STATUSES = (
    "NOT_STARTED", "IN_PROGRESS", "RESEARCH_COMPLETE", "NEEDS_REVIEW", "STALE",
)
CONFIDENCE_LEVELS = ("LOW", "MEDIUM", "HIGH", "VERIFIED")
ASSESSMENT_LEVELS = ("UNKNOWN", "LOW", "MEDIUM", "HIGH")
TASK_STATUSES = (
    "NOT_STARTED", "DISCOVERED", "RETRIEVED", "REVIEW_REQUIRED", "ACCEPTED",
    "UNAVAILABLE", "FAILED", "STALE",
)
DISCOVERING_STATUSES = ("DISCOVERED", "RETRIEVED", "REVIEW_REQUIRED")
REVIEWED_STATUSES = ("ACCEPTED", "UNAVAILABLE", "FAILED", "STALE")
OBSERVATION_STATUSES = ("PROPOSED", "ACCEPTED", "REJECTED", "CONFLICTING")
OBSERVATION_VALUE_TYPES = ("FACT", "ESTIMATE", "ASSESSMENT")

CONFIDENCE_FIELDS = (
    "founder_age_confidence", "ownership_confidence", "custodian_confidence",
    "economics_confidence",
)
ASSESSMENT_FIELDS = ("succession_readiness_assessment", "succession_signal_strength")
NONNEGATIVE_FIELDS = (
    "founder_estimated_age", "founder_tenure_years", "estimated_revenue",
    "estimated_ebitda", "estimated_valuation_low", "estimated_valuation_high",
)
TIMESTAMP_FIELDS = (
    "research_started_at", "research_completed_at", "last_researched_at",
)
FACTUAL_FIELDS = (
    "research_owner", "founder_role", "founder_profile_notes",
    "investment_philosophy", "portfolio_management_approach",
    "primary_custodian", "secondary_custodian", "custodian_notes",
    "client_niche", "geographic_focus", "specialty_niche",
    "client_profile_notes", "revenue_estimation_method",
)

# -------------------------------------------------------------- value domains
STATE_CODES = (
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA",
    "HI", "ID", "IL", "IN", "IA", "KS", "KY", "LA", "ME", "MD",
    "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ",
    "NM", "NY", "NC", "ND", "OH", "OK", "OR", "PA", "RI", "SC",
    "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY",
    "DC", "PR", "VI",
)
FIRM_STATUSES = (
    "active", "inactive", "terminated", "merged", "acquired", "unknown",
)
ID_NUMBER_RANGE = (1000, 999999)

# ------------------------------------------------------------------ scoring
AUM_UNIT = 1e9
AUM_SCORE_CAP = 50
GROWTH_SCORE_CAP = 20
RISK_POINTS = -5
DEGENERATE_STDDEV = 0.01
DEGENERATE_MIN_ROWS = 10
CATEGORY_WEIGHTS = (
    ("ASSETS_UNDER_MANAGEMENT", 0.25),
    ("CLIENT_BASE", 0.20),
    ("GEOGRAPHIC_FIT", 0.15),
    ("SERVICE_OFFERINGS", 0.15),
    ("FEE_STRUCTURE", 0.10),
    ("REGULATORY_HISTORY", 0.10),
    ("GROWTH_POTENTIAL", 0.05),
)
COMPONENT_SCORES = (
    "aum_fit_score", "discretionary_fit_score", "client_fit_score",
    "account_practice_fit_score", "practice_complexity_score",
    "advisory_model_fit_score", "regulatory_quality_score",
)
CANDIDATE_MIN_SCORE = 50
CANDIDATE_LIMIT = 100

# ------------------------------------------------------------ change events
TARGET_BAND = (20_000_000, 100_000_000)
MATERIAL_CHANGE = 0.20
PRIORITY_MOVES = (
    ("PRIORITY_B", "PRIORITY_A", "PRIORITY_B_TO_A"),
    ("PRIORITY_A", "PRIORITY_B", "PRIORITY_A_TO_B"),
    ("PRIORITY_A", "PRIORITY_C", "PRIORITY_A_TO_C"),
)
PLAIN_CHANGE_FIELDS = (
    "registration_status", "organization_type", "total_account_count",
    "individual_hnw_client_aum",
)
STAFFING_FIELDS = ("employee_count", "advisory_employee_count")
REFRESH_EVENTS = (
    "NEW_PRIORITY_A", "PRIORITY_B_TO_A", "NEW_REGULATORY_DISCLOSURE",
    "PRIORITY_CHANGE_REVIEW", "ENTERED_TARGET_AUM_BAND",
)
STALE_DAYS = 180
FRESHNESS_DAYS = 35
ROW_DROP_SHARE = 0.95

# --------------------------------------------------------------- profiling
MIN_COLUMN_COMPLETENESS = 80
MIN_QUALITY_SCORE = 70
QUALITY_WEIGHTS = (0.4, 0.3, 0.2, 0.1)
SAMPLE_VALUES = 5

# ------------------------------------------- column-name classes, first wins
NAME_CLASSES = (
    (r"^Organization CRD#|SEC#|CIK#|Additional CRD Number|Primary Business Name|Legal Name", "firm_ident"),
    (r"^Main Office|Mail Office|Location of Books and Records|Office Street Address|Office City|Office State|Office Country|Office Postal Code|Private Residence Flag|Telephone|Facsimile", "office"),
    (r"^SEC Current Status|SEC Status Effective Date|Jurisdiction Notice Filed-Effective Date|Latest ADV Filing Date|Form Version", "registration"),
    (r"^Firm Type|Umbrella Registration|Total number of relying advisers|Total number of additional CRD numbers|Total number of CIK numbers|Total Number of Website Addresses|Total Number of Books and Records Locations", "firm_metadata"),
    (r"^1I|1L|1M|1N|1O|1P", "form_section_1"),
    (r"^2A\(|3A|3B|3C-|4A|4B", "form_section_2_3_4"),
    (r"^5A|5B|5C|5D|5E|5F|5G|5H|5I|5J|5K|5L", "business_activities"),
    (r"^6A|6B", "fees"),
    (r"^7A|7B", "affiliates_private_funds"),
    (r"^8A|8B|8C|8D|8E|8F|8G|8H|8I", "participation_transactions"),
    (r"^9A|9B|9C|9D|9E|9F", "custody_audit"),
    (r"^10A|Control person|Under Common Control|Share Supervised Persons|Share Location", "control_persons"),
    (r"^11A|11B|11C|11D|11E|11F|11G|11H|Count of .* disclosures", "disclosures"),
    (r"^12A|12B|12C", "misc"),
    (r"^Total number of |Count of |Total |Any |Total Gross Assets", "aggregates"),
    (r"^SEC Region|Website Address|Acquired Firm|Form Version", "misc"),
)
UNCLASSIFIED = "unclassified"
# entity, name classes it takes, key column, name text that keeps an attribute out
ENTITY_RULES = (
    ("Firm", ("firm_ident", "firm_metadata"), "Organization CRD#", ""),
    ("Office", ("office",), None, ""),
    ("Registration", ("registration",), None, ""),
    ("BusinessActivity", ("business_activities",), None, ""),
    ("PrivateFund", ("affiliates_private_funds",), None, r"Total number of|Any "),
    ("Disclosure", ("disclosures",), None, r"^Count of "),
    ("ControlPerson", ("control_persons",), None, ""),
)

# entity: column that refers to the entity with the key, description
ENTITY_TEXTS = {
    "Firm": (None, "Registered Investment Adviser firm"),
    "Office": ("Organization CRD#", "Physical or mailing offices of the firm"),
    "Registration": ("Organization CRD#", "SEC registration status and filing timeline"),
    "BusinessActivity": ("Organization CRD#", "Types of advisory services, client composition, assets under management"),
    "PrivateFund": ("Organization CRD#", "Private fund information (hedge, PE, real estate, etc.)"),
    "Disclosure": ("Organization CRD#", "Regulatory disclosures (disciplinary events, financial, etc.)"),
    "ControlPerson": ("Organization CRD#", "Persons controlling the advisory firm"),
}

# ------------------------------------------------------------ source taxonomy
# type, authority, title, url, collection mode, description
SOURCE_TAXONOMY = (
    ("historical_adv", "SEC", "Historical Form ADV data",
     "https://www.sec.gov/foia-services/frequently-requested-documents/form-adv-data",
     "metadata_and_batch_csv", "Historical Form ADV Part 1/2 tables for longitudinal analysis."),
    ("iapd", "SEC/FINRA", "Investment Adviser Public Disclosure",
     "https://adviserinfo.sec.gov/", "metadata_and_analyst_review",
     "Current adviser filing, registration, and official document lookup."),
    ("adv_part1_definitions", "SEC", "Form ADV Part 1A definitions",
     "https://www.sec.gov/files/formadv-part1a_1.pdf", "reference_only",
     "Versioned field definitions and canonical mapping references."),
    ("adv_part2a", "SEC/FINRA", "Form ADV Part 2A brochure",
     "https://adviserinfo.sec.gov/", "metadata_and_analyst_review",
     "Firm brochure evidence for biographies, strategy, fees, and custody clues."),
    ("official_website", "Firm", "Official firm website",
     None, "metadata_and_analyst_review",
     "Firm-controlled public pages for leadership, services, niche, and contacts."),
    ("public_biography", "Public source", "Public professional biography",
     None, "metadata_and_analyst_review",
     "Public bios used to corroborate role, tenure, and leadership continuity."),
    ("state_record", "State regulator", "State regulatory or business record",
     "https://www.nasaa.org/about-us/contact-your-regulator/", "analyst_review",
     "Jurisdiction-specific registration and entity corroboration."),
    ("brokercheck", "FINRA", "FINRA BrokerCheck",
     "https://brokercheck.finra.org/", "analyst_review",
     "Broker-dealer overlap and public disciplinary review."),
    ("business_registry", "State or public registry", "Public business registry",
     None, "analyst_review",
     "Legal entity status and ownership-related corroboration."),
    ("relationship_referral", "House analyst", "Relationship or referral source",
     None, "manual_only",
     "Warm-introduction and relationship-path evidence entered by analysts."),
)
CORE_SOURCE_TYPES = (
    "historical_adv", "iapd", "adv_part2a", "official_website",
    "public_biography", "state_record", "brokercheck", "business_registry",
    "relationship_referral",
)
OWN_SITE_TYPE = "official_website"

# field, form item, description
FIELD_DICTIONARY = (
    ("firm_id", "Item 1", "Organization CRD number"),
    ("sec_number", "Item 1", "SEC registration number"),
    ("name", "Item 1", "Legal or primary business name"),
    ("organization_type", "Item 3", "Form of organization"),
    ("succession_indicator", "Item 4", "Successions"),
    ("total_aum", "Item 5.F(2)(c)", "Total regulatory assets under management"),
    ("discretionary_aum", "Item 5.F(2)(a)", "Discretionary regulatory assets under management"),
    ("non_discretionary_aum", "Item 5.F(2)(b)", "Nondiscretionary regulatory assets under management"),
    ("total_account_count", "Item 5.F(2)(f)", "Total accounts"),
    ("employee_count", "Item 5.A", "Employees"),
    ("advisory_employee_count", "Item 5.B(1)", "Employees performing advisory functions"),
    ("individual_client_aum", "Item 5.D(a)(3)", "Individual client assets"),
    ("hnw_client_aum", "Item 5.D(b)(3)", "High-net-worth individual client assets"),
    ("has_item_11_disclosure", "Item 11", "Disclosure information indicator"),
)

# ------------------------------------------- roster mapping: target, header, type
# An empty header means the target has no source column and is always NULL.
FIRM_MAPPING = (
    ("firm_id", "Organization CRD#", "text"),
    ("sec_number", "SEC#", "text"),
    ("cik_number", "CIK#", "text"),
    ("name", "Legal Name", "text"),
    ("primary_business_name", "Primary Business Name", "text"),
    ("additional_crd_numbers", "Additional CRD Number", "text"),
    ("total_additional_crd_numbers", "Total number of additional CRD numbers", "count"),
    ("firm_type", "Firm Type", "text"),
    ("umbrella_registration", "Umbrella Registration", "flag"),
    ("total_relying_advisers", "Total number of relying advisers", "count"),
    ("total_cik_numbers", "Total number of CIK numbers", "count"),
    ("total_website_addresses", "Total Number of Website Addresses", "count"),
    ("total_books_and_records_locations", "Total Number of Books and Records Locations", "count"),
    ("acquired_firm_sec_number", "Acquired Firm SEC#", "text"),
    ("sec_region", "SEC Region", "text"),
    ("website_address", "Website Address", "text"),
    ("total_aum", "5.G.(3) - Total amount of Parallel Assets", "money"),
    ("discretionary_aum", "", "money"),
    ("non_discretionary_aum", "", "money"),
    ("other_regulatory_aum", "", "money"),
    ("private_fund_count", "Count of Private Funds - 7B(1)", "count"),
    ("hedge_fund_count", "Total number of Hedge funds", "count"),
    ("pe_fund_count", "Total number of PE funds", "count"),
    ("real_estate_fund_count", "Total number of Real Estate funds", "count"),
    ("vc_fund_count", "Total number of VC funds", "count"),
    ("liquidity_fund_count", "Total number of Liquidity funds", "count"),
    ("disciplinary_event_count", "Count of 11A(1) disclosures", "count"),
    ("civil_action_count", "Count of 11A(2) disclosures", "count"),
    ("bonding_requirement_count", "Count of 11B(1) disclosures", "count"),
    ("other_regulatory_event_count", "Count of 11B(2) disclosures", "count"),
    ("financial_condition_event_count", "Count of 11C(1) disclosures", "count"),
    ("affiliation_change_count", "Count of 11C(2) disclosures", "count"),
    ("public_company_control_person_count", "Count of Control person Public Reporting Company", "count"),
    ("ia_affiliate_count", "Count of IA Affiliates", "count"),
    ("ia_bd_affiliate_count", "Count of IA/BD Affiliates", "count"),
    ("bd_affiliate_count", "Count of BD Affiliates", "count"),
    ("sec_current_status", "SEC Current Status", "text"),
    ("sec_status_effective_date", "SEC Status Effective Date", "date"),
    ("jurisdiction_notice_filed_effective_date", "Jurisdiction Notice Filed-Effective Date", "date"),
    ("latest_adv_filing_date", "Latest ADV Filing Date", "date"),
    ("form_version", "Form Version", "text"),
)
REQUIRED_FIRM_FIELDS = ("firm_id", "name")

# office type, header prefix
OFFICE_PREFIXES = (
    ("MAIN", "Main Office"),
    ("MAIL", "Mail Office"),
    ("BOOKS_RECORDS", "Location of Books and Records"),
)
# target, header suffix, type, office types that have it (empty: all)
OFFICE_FIELDS = (
    ("street_address_1", "Street Address 1", "text", ()),
    ("street_address_2", "Street Address 2", "text", ()),
    ("city", "City", "text", ()),
    ("state", "State", "text", ()),
    ("country", "Country", "text", ()),
    ("postal_code", "Postal Code", "text", ()),
    ("is_private_residence", "Private Residence Flag", "flag", ()),
    ("telephone", "Telephone Number", "text", ("MAIN",)),
    ("facsimile", "Facsimile Number", "text", ("MAIN",)),
)
# target, header
ACQUIRED_MAPPING = (
    ("parent_firm_id", "Organization CRD#"),
    ("acquired_name", "Acquired Firm"),
    ("acquired_sec_number", "Acquired Firm SEC#"),
    ("acquired_crd_number", "Acquired Firm CRD#"),
)
CRITICAL_FIRM_FIELDS = ("name", "firm_type", "sec_current_status")
CRITICAL_OFFICE_FIELDS = ("street_address_1", "city", "state")

TRACKING_FIELDS = (
    "dataset_version", "created_timestamp", "source_dataset", "record_hash",
    "last_seen_version", "current_status",
)

# --------------------------------------------------------------- reporting
HREF_PATTERN = r'href="([^"]+)"'
DRAFT_NOTICE = (
    "> **Analyst Review Required:** This is a factual-enrichment draft. Founder status, "
    "ownership interpretation, succession, strategic fit, transition feasibility, valuation, "
    "and outreach recommendation remain unpopulated pending analyst review."
)

# Dossier text.  {g:x} is a scored field, {r:x} a research field, {cash:x} a
# scored amount, {rcash:x} a researched amount, {share} the discretionary
# share, {codes} the reason codes as bullets, {house} the reader's name;
# text after | replaces "Unknown" when the field is empty.
DOSSIER_TEMPLATE = """\
# Target Dossier — {g:name}

- Dataset version: `{g:dataset_version}`
- Firm ID: `{g:firm_id}`
- Generated at: `{generated_at}`

{draft}
## 1. Executive Snapshot

- **Firm:** {g:name} 
- **AUM (SEC-derived):** {cash:total_aum}
- **Acquisition score (Gold V1):** {g:acquisition_score}
- **Priority:** {g:priority_category}
- **Research status:** {r:research_status}
- **Screening summary (structured):** {cash:total_aum} AUM; {share} discretionary; {g:employee_count} employees; {g:advisory_employee_count} advisory employees.

## 2. Why {house} Should Care

**Structured facts:**
{codes}

**Analyst assessment — strategic fit:** {r:strategic_fit_assessment}
{r:strategic_fit_notes|No strategic-fit assessment recorded.}

**Analyst assessment — succession:** {r:succession_readiness_assessment}
{r:succession_notes|No succession assessment recorded.}

## 3. Firm Profile

**SEC-derived facts:**
- Organization type: {g:organization_type}
- State / SEC region: {g:organization_state} / {g:sec_region}
- Discretionary AUM: {cash:discretionary_aum} ({share})
- Accounts: {g:total_account_count} total; {g:discretionary_account_count} discretionary
- Client model flags: individuals/small businesses={g:advises_individuals_or_small_businesses}; financial planning={g:provides_financial_planning}
- Staffing: {g:employee_count} employees; {g:advisory_employee_count} advisory employees

**Research facts:**
- Client niche: {r:client_niche}
- Geographic focus: {r:geographic_focus}
- Specialty niche: {r:specialty_niche}

## 4. Founder & Ownership

**Research facts:**
- Founder: {r:founder_name}
- Leadership role: {r:founder_role}
- Leadership profile: {r:founder_profile_notes}

**Analyst assessment:**
- Ownership type / summary: {r:ownership_type} / {r:ownership_summary}
- Closely-held assessment: {r:closely_held_assessment}

## 5. Succession Assessment

- Readiness assessment: {r:succession_readiness_assessment}
- Signal strength: {r:succession_signal_strength}
- Visible internal successor: {r:visible_internal_successor}
- Successor: {r:successor_name}
- Notes: {r:succession_notes}

## 6. Economics

**Estimate:**
- Estimated revenue: {rcash:estimated_revenue}
- Method: {r:revenue_estimation_method}
- Estimated EBITDA: {rcash:estimated_ebitda}
- Estimated valuation range: {rcash:estimated_valuation_low} to {rcash:estimated_valuation_high}
- Economics confidence: {r:economics_confidence}

## 7. Investment & Custodian Fit

**Research facts:**
- Investment philosophy: {r:investment_philosophy}
- Portfolio approach: {r:portfolio_management_approach}
- Primary custodian: {r:primary_custodian}
- Custodian confidence: {r:custodian_confidence}

**Analyst assessment — investment model fit:** {r:investment_model_fit}
{r:investment_model_fit_notes|No investment-model assessment recorded.}

## 8. Risks

- Regulatory: Gold V1 regulatory review flag={g:regulatory_review_flag}; Item 11 disclosure={g:has_item_11_disclosure}
- Integration: {r:integration_risks}
- Cultural and operational fit: not determinable from reviewed public sources.

## 9. Recommended Next Action

- Recommendation: {r:outreach_recommendation}
- Contact method: {r:recommended_contact_method}
- Message angle: {r:recommended_message_angle}
- Relationship path: {r:relationship_path}

## 10. Sources

"""
DOSSIER_NO_CODES = "- Unknown / not established"
DOSSIER_NO_SOURCES = "- No sources recorded."
DOSSIER_TAIL = """\

### Data classification

- SEC-derived facts are labeled as structured facts.
- Public-source statements are labeled as research facts.
- Numeric economics are estimates with method/confidence fields.
- Strategic, succession, ownership, and transition conclusions are analyst assessments.
"""
