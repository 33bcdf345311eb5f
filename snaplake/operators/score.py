"""Scores, ratios, reason codes and score statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplake import fixed_values as fv
from snaplake.functions.rules import violations
from snaplake.operators.skew import exact_median, with_tie_percentile

COMPONENTS = ("score_aum", "score_growth", "score_risk")


def _clipped(c: Column, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(high)), c))


def with_components(
    df: DataFrame, aum: str = "total_aum", growth: str = "private_fund_count", risk: str = "disciplinary_event_count"
) -> DataFrame:
    """Size, growth and risk components; a NULL input counts as zero."""
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "score_aum": _clipped(F.coalesce(F.col(aum).cast("double"), zero) / fv.AUM_UNIT, fv.AUM_SCORE_CAP),
            "score_growth": _clipped(F.coalesce(F.col(growth).cast("double"), zero), fv.GROWTH_SCORE_CAP),
            "score_risk": F.coalesce(F.col(risk).cast("double"), zero) * fv.RISK_POINTS,
        }
    )


def percentile_score(df: DataFrame, out: str = "acquisition_score") -> DataFrame:
    """Percentile rank (ties averaged) of the component sum."""
    total = F.col("score_aum") + F.col("score_growth") + F.col("score_risk")
    return with_tie_percentile(df.withColumn("_raw_score", total), "_raw_score", out).drop("_raw_score")


def degenerate(df: DataFrame, score: str = "acquisition_score") -> DataFrame:
    """One row: sample deviation, row count and whether the score tells rows apart."""
    return df.agg(F.stddev_samp(score).alias("stddev"), F.count(score).alias("n")).select(
        "stddev", "n",
        F.coalesce(
            (F.col("stddev") < fv.DEGENERATE_STDDEV) & (F.col("n") > fv.DEGENERATE_MIN_ROWS), F.lit(False)
        ).alias("is_degenerate"),
    )


def first_component(df: DataFrame, features: tuple[str, ...] = COMPONENTS) -> list[float]:
    """Loadings of the first principal component, largest loading positive.

    The covariance matrix is one distributed aggregate; only its few numbers
    (features squared) come to the driver.
    """
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    row = df.agg(*[F.covar_pop(a, b).alias(f"{a}|{b}") for a, b in pairs]).first()
    size = len(features)
    matrix = np.zeros((size, size))
    for a, b in pairs:
        i, j = features.index(a), features.index(b)
        matrix[i, j] = matrix[j, i] = row[f"{a}|{b}"] or 0.0
    _, vectors = np.linalg.eigh(matrix)
    loading = vectors[:, -1]
    if loading[np.argmax(np.abs(loading))] < 0:
        loading = -loading
    return [float(x) for x in loading]


def pca_score(df: DataFrame, out: str = "acquisition_score", features: tuple[str, ...] = COMPONENTS) -> DataFrame:
    """Percentile rank of the first principal component of the features."""
    loading = first_component(df, features)
    projection = sum((F.col(c).cast("double") * w for c, w in zip(features[1:], loading[1:])),
                     F.col(features[0]).cast("double") * loading[0])
    # Equal features must tie, so the projection is rounded before ranking.
    raw = df.withColumn("_projection", F.round(projection, 9))
    return with_tie_percentile(raw, "_projection", out).drop("_projection")


def build_scores(df: DataFrame) -> DataFrame:
    """Component score, with the principal-component score where it says nothing."""
    scored = percentile_score(with_components(df))
    if degenerate(scored).first()["is_degenerate"]:
        return pca_score(scored.drop("acquisition_score"))
    return scored


def category_rows(df: DataFrame, key: str, scores: str) -> DataFrame:
    """A map of category scores per firm as (key, category, score) rows."""
    return df.select(key, F.explode(scores).alias("category", "score"))


def weighted_score(scores: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """Weighted mean over the categories a key has, from a long (key, category, score) table."""
    return (
        scores.join(weights, "category")
        .groupBy(key)
        .agg(F.try_divide(F.sum(F.col("score") * F.col("weight")), F.sum("weight")).alias("weighted_score"))
    )


def score_distribution(df: DataFrame, score: str) -> DataFrame:
    moments = df.agg(
        F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std_dev"),
        F.min(score).alias("min"), F.max(score).alias("max"),
    )
    return moments.withColumn("median", exact_median(df, score).scalar())


def with_ratios(df: DataFrame) -> DataFrame:
    """Shares and averages that the reason codes use; no value without a denominator."""
    def share(part: str, whole: str) -> Column:
        return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))

    return df.withColumns(
        {
            "discretionary_share": share("discretionary_aum", "total_aum"),
            "individual_hnw_share": share("individual_hnw_client_aum", "total_aum"),
            "hnw_share": share("hnw_client_aum", "total_aum"),
            "average_account_size": share("total_aum", "total_account_count"),
            "discretionary_account_share": share("discretionary_account_count", "total_account_count"),
        }
    )


def reason_codes() -> Column:
    """Codes of every screening threshold a firm meets (over ``with_ratios`` columns)."""
    c = F.col
    return violations(
        ("PREFERRED_AUM_BAND", c("total_aum").between(25e6, 60e6)),
        ("HIGH_DISCRETIONARY_SHARE", c("discretionary_share") >= 0.90),
        ("PREDOMINANTLY_DISCRETIONARY", c("discretionary_share") >= 0.75),
        ("MEANINGFUL_DISCRETIONARY_AUM", c("discretionary_aum") >= 25e6),
        ("HNW_INDIVIDUAL_FOCUSED", c("individual_hnw_share") >= 0.75),
        ("HIGH_HNW_AUM_SHARE", c("hnw_share") >= 0.50),
        ("MANAGEABLE_ACCOUNT_BASE", c("total_account_count") <= 500),
        ("HIGH_AVERAGE_ACCOUNT_SIZE", c("average_account_size") >= 500_000),
        ("HIGH_DISCRETIONARY_ACCOUNT_SHARE", c("discretionary_account_share") >= 0.75),
        ("SMALL_EMPLOYEE_BASE", c("employee_count") <= 3),
        ("SMALL_ADVISORY_TEAM", c("advisory_employee_count") <= 3),
        ("SIMPLE_CONTROL_STRUCTURE", ~c("has_control_complexity")),
        ("INDIVIDUAL_SMALL_BUSINESS_MODEL", c("advises_individuals_or_small_businesses")),
        ("FINANCIAL_PLANNING_MODEL", c("provides_financial_planning")),
        ("CLEAN_ITEM11_HISTORY", ~c("has_item_11_disclosure")),
    )


def prioritised(df: DataFrame, rules: list[tuple[str, Column]], otherwise: str = "EXCLUDED") -> DataFrame:
    """``priority_category`` from an ordered rule list that the user supplies."""
    first, *rest = rules
    chain = F.when(first[1], first[0])
    for label, condition in rest:
        chain = chain.when(condition, label)
    return df.withColumn("priority_category", chain.otherwise(otherwise))


