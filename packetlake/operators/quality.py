"""Feature quality report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.functions.ordered import exact_quantiles
from packetlake.operators.labels import class_distribution, imbalance_ratio
from packetlake.schemas import FEATURE_COLS, NUMERIC_FEATURES

OUTLIER_SIGMA = 3.0
FLAG_RATE = 0.05
QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def to_long(df: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """(feature, value as double), one row per input row and column."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "feature", value
    )


def one_row_to_long(row: DataFrame, columns: list[str], value: str) -> DataFrame:
    """A one-row aggregate over ``columns`` as (feature, value) rows."""
    return row.unpivot([], columns, "feature", value)


def null_rates(features: DataFrame) -> DataFrame:
    """Share of null or NaN per feature, 4 decimals; 0 for an empty table."""
    types = dict(features.dtypes)

    def missing(name: str) -> Column:
        if types[name] in ("double", "float"):
            return F.col(name).isNull() | F.isnan(name)
        return F.col(name).isNull()

    rates = features.agg(*[
        F.coalesce(F.round(F.avg(missing(c).cast("double")), 4), F.lit(0.0)).alias(c)
        for c in FEATURE_COLS
    ])
    return one_row_to_long(rates, FEATURE_COLS, "null_rate")


def outlier_rates(features: DataFrame, sigma: float = OUTLIER_SIGMA) -> DataFrame:
    """Share of values further than ``sigma`` sample deviations from the mean.

    The first pass ends in one row of 28 numbers, which the second pass uses
    as constants.
    """
    stats = features.agg(
        *[F.avg(c).cast("double").alias(f"mean_{c}") for c in NUMERIC_FEATURES],
        *[F.stddev_samp(c).cast("double").alias(f"std_{c}") for c in NUMERIC_FEATURES],
    ).first()

    def rate(name: str) -> Column:
        mean, std = stats[f"mean_{name}"], stats[f"std_{name}"]
        if not std:  # null or zero: nothing can be an outlier
            return F.lit(0.0).alias(name)
        far = F.abs(F.col(name).cast("double") - mean) > sigma * std
        return F.round(F.avg(far.cast("double")), 4).alias(name)

    rates = features.agg(F.lit(1).alias("_one"), *[rate(c) for c in NUMERIC_FEATURES])
    return one_row_to_long(rates.drop("_one"), NUMERIC_FEATURES, "outlier_rate")


def feature_statistics(features: DataFrame) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles per feature."""
    values = to_long(features, NUMERIC_FEATURES).filter(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    basic = values.groupBy("feature").agg(
        F.count("*").alias("count"),
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp("value"), F.lit(0.0)), 4).alias("std"),
        F.round(F.min("value"), 4).alias("min"),
        F.round(F.max("value"), 4).alias("max"),
    )
    quartiles = (
        exact_quantiles(values, "feature", "value", list(QUANTILES.values()))
        .groupBy("feature")
        .agg(*[
            F.max(F.when(F.col("probability") == p, F.round("quantile", 4))).alias(name)
            for name, p in QUANTILES.items()
        ])
    )
    return basic.join(quartiles, "feature")


def completeness(rates: DataFrame) -> DataFrame:
    """1 - mean null rate, 4 decimals."""
    return rates.agg(
        F.round(1 - F.avg("null_rate"), 4).alias("feature_completeness_score")
    )


def labeled_counts(features: DataFrame) -> DataFrame:
    labeled = F.count("ground_truth_label_id")
    return features.agg(
        F.count("*").alias("total_sessions"),
        labeled.alias("labeled_sessions"),
        (F.count("*") - labeled).alias("unlabeled_sessions"),
    )


def quality_flags(nulls: DataFrame, outliers: DataFrame, limit: float = FLAG_RATE) -> DataFrame:
    """Features whose null or outlier rate exceeds ``limit``."""
    rates = nulls.select(
        "feature", F.lit("null_rate").alias("measure"), F.col("null_rate").alias("rate")
    ).unionByName(outliers.select(
        "feature", F.lit("outlier_rate").alias("measure"), F.col("outlier_rate").alias("rate")
    ))
    return rates.filter(F.col("rate") > limit)


def _as_map(df: DataFrame, key: str, value: Column) -> Column:
    """All rows of a report section (a row per feature or label) as one map."""
    return df.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), value)))).alias("m")
    ).scalar()


def quality_report(features: DataFrame, labels: DataFrame, now: Column) -> DataFrame:
    """All sections in one record."""
    nulls, outliers = null_rates(features), outlier_rates(features)
    classes = class_distribution(features, labels)
    stats = feature_statistics(features)
    measures = [c for c in stats.columns if c != "feature"]
    return labeled_counts(features).select(
        now.alias("generated_at"),
        "total_sessions",
        "labeled_sessions",
        "unlabeled_sessions",
        completeness(nulls).scalar().alias("feature_completeness_score"),
        _as_map(nulls, "feature", F.col("null_rate")).alias("null_rates"),
        _as_map(outliers, "feature", F.col("outlier_rate")).alias("outlier_rates_3sigma"),
        _as_map(stats, "feature", F.struct(*measures)).alias("feature_statistics"),
        _as_map(classes, "label_code", F.col("sessions")).alias("class_distribution"),
        F.round(imbalance_ratio(classes).scalar(), 2).alias("class_imbalance_ratio"),
    )
