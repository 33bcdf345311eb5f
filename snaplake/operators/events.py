"""Business change events between two scored snapshots, and the refresh queue."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.keys import age_in_days
from snaplake.functions.typing import iso_timestamp

TRACKED = (
    "name", "priority_category", "total_aum", "has_item_11_disclosure",
    *fv.PLAIN_CHANGE_FIELDS, *fv.STAFFING_FIELDS,
)


def in_band(amount: Column) -> Column:
    return amount.between(*fv.TARGET_BAND)


def _event(when: Column, kind: Column | str, **details: Column) -> Column:
    fields = {"name": None, "field": None, "old": None, "new": None, "change_pct": None, **details}
    detail = F.struct(*[
        (F.lit(None) if v is None else v).cast("double" if k == "change_pct" else "string").alias(k)
        for k, v in fields.items()
    ])
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct(kind.alias("event_type"), detail.alias("details")))


def change_events(old: DataFrame, new: DataFrame, key: str = "firm_id") -> DataFrame:
    """One row per event: key, event_type, its details and its position among the events of the key.

    One full outer join; the rules are columns of an array, so a firm's events
    are found in one pass.  A column that a side lacks never counts as changed.
    """
    common = [c for c in TRACKED if c in old.columns and c in new.columns]
    o = old.select(key, F.struct(F.lit(True).alias("_here"), *[c for c in TRACKED if c in old.columns]).alias("o"))
    n = new.select(key, F.struct(F.lit(True).alias("_here"), *[c for c in TRACKED if c in new.columns]).alias("n"))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()

    def was(c: str) -> Column:
        return F.col(f"o.{c}")

    def now(c: str) -> Column:
        return F.col(f"n.{c}")

    def changed(c: str) -> Column:
        return both & ~was(c).eqNullSafe(now(c))

    name = now("name") if "name" in new.columns else F.lit(None)
    rules = [_event(F.col("n").isNull(), "REMOVED_FIRM")]
    if "priority_category" in new.columns:
        rules.append(_event(F.col("o").isNull() & (now("priority_category") == "PRIORITY_A"), "NEW_PRIORITY_A", name=name))
    if "priority_category" in common:
        for before, after, kind in fv.PRIORITY_MOVES:
            moved = (was("priority_category") == before) & (now("priority_category") == after)
            rules.append(_event(moved, kind, name=name, old=F.lit(before), new=F.lit(after)))
    if "total_aum" in common:
        a, b = was("total_aum").cast("double"), now("total_aum").cast("double")
        values = {"name": name, "old": was("total_aum"), "new": now("total_aum")}
        pct = F.try_divide(b - a, a)
        rules += [
            _event((a > 0) & (b != 0) & (pct <= -fv.MATERIAL_CHANGE), "MATERIAL_AUM_DECLINE", change_pct=pct, **values),
            _event((a > 0) & (b != 0) & (pct >= fv.MATERIAL_CHANGE), "MATERIAL_AUM_GROWTH", change_pct=pct, **values),
            _event(~in_band(a) & in_band(b), "ENTERED_TARGET_AUM_BAND", **values),
            _event(in_band(a) & ~in_band(b), "EXITED_TARGET_AUM_BAND", **values),
        ]
    if "has_item_11_disclosure" in common:
        rules.append(_event(changed("has_item_11_disclosure") & now("has_item_11_disclosure"),
                            "NEW_REGULATORY_DISCLOSURE", name=name))
    for c in fv.PLAIN_CHANGE_FIELDS:
        if c in common:
            rules.append(_event(changed(c), f"{c.upper()}_CHANGE", name=name, old=was(c), new=now(c)))
    for c in fv.STAFFING_FIELDS:
        if c in common:
            rules.append(_event(changed(c), "MATERIAL_STAFFING_CHANGE", name=name, field=F.lit(c), old=was(c), new=now(c)))
    fired = o.join(n, key, "full").select(key, F.posexplode(F.array_compact(F.array(*rules))).alias("position", "_event"))
    return fired.select(key, "_event.*", "position")


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def events_by_firm(events: DataFrame, key: str = "firm_id") -> DataFrame:
    """All event types of a firm in the order of the rules, repeats kept; a firm has one event per rule at most."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "event_type")))
    return events.groupBy(key).agg(ordered["event_type"].alias("event_types"))


def refresh_targets(scored: DataFrame) -> DataFrame:
    """The firms of a scored snapshot that a refresh queue is about."""
    return scored.filter(F.col("priority_category").isin("PRIORITY_A", "PRIORITY_B"))


def refresh_queue(
    scored: DataFrame, research: DataFrame, events: DataFrame, now: Column, stale_days: int = fv.STALE_DAYS,
    previous_version: str | None = None,
) -> DataFrame:
    """Action and reasons for every priority A and B firm of one snapshot.

    ``research`` has at most one record per firm: firm_id, last_researched_at
    (ISO text).  Sort with ``queue_order`` when the order matters.
    """
    targets = refresh_targets(scored).select("firm_id", "name", "priority_category", "acquisition_score")
    record = research.select("firm_id", F.lit(True).alias("_has_record"), "last_researched_at")
    joined = targets.join(record, "firm_id", "left").join(events_by_firm(events), "firm_id", "left")

    is_a = F.col("priority_category") == "PRIORITY_A"
    last = F.nullif(F.col("last_researched_at"), F.lit(""))
    when_researched = iso_timestamp(last)
    stale = (
        F.when(last.isNull(), is_a)
        .when(when_researched.isNull(), True)
        .otherwise(age_in_days(when_researched, now) >= stale_days)
    )
    types = F.coalesce("event_types", F.array().cast("array<string>"))
    refresh = F.arrays_overlap(types, F.array(*[F.lit(e) for e in fv.REFRESH_EVENTS]))
    action = (
        F.when(F.col("_has_record").isNull(), F.when(is_a, "NEW_TARGET_RESEARCH").otherwise("NO_REFRESH_REQUIRED"))
        .when(F.array_contains(types, "NEW_REGULATORY_DISCLOSURE"), "REGULATORY_REVIEW_REQUIRED")
        .when(refresh | stale, F.when(is_a, "REFRESH_REQUIRED").otherwise("PRIORITY_CHANGE_REVIEW"))
        .otherwise("NO_REFRESH_REQUIRED")
    )
    reasons = (
        F.when(F.col("_has_record").isNull(), F.array(F.lit("missing research record")))
        .when(F.size(types) > 0, types)
        .when(stale, F.array(F.lit(f"stale>{stale_days}d")))
        .otherwise(F.array(F.lit("no material event")))
    )
    return joined.select(
        "firm_id", "name", "priority_category", "acquisition_score",
        action.alias("action"), reasons.alias("reasons"),
        F.lit(previous_version).cast("string").alias("previous_dataset_version"),
    )


def queue_order() -> list[Column]:
    """No-action rows last, then score from high to low (NULL as 0), then id."""
    return [
        (F.col("action") == "NO_REFRESH_REQUIRED").asc(),
        F.coalesce("acquisition_score", F.lit(0.0)).desc(),
        F.col("firm_id").asc(),
    ]


