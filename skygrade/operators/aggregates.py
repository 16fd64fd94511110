"""Means, counts and extremes. Every one combines map-side before its shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.functions.scalars import iso_week_year
from skygrade.operators.select import no_null_keys
from skygrade.schema import is_numeric


def group_mean(df: DataFrame, keys, cols) -> DataFrame:
    return no_null_keys(df, keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def with_week(df: DataFrame, date="dt", iso_year=False) -> DataFrame:
    year, week = iso_week_year(date, iso_year)
    return df.withColumns({"yr": year, "wk": week})


def agg_week_mean(df: DataFrame, cols) -> DataFrame:
    return group_mean(df, ["site", "yr", "wk"], cols)


def agg_day_mean(df: DataFrame, cols) -> DataFrame:
    return group_mean(df, ["site", "dt", "yr", "wk"], cols)


def agg_hour_mean(df: DataFrame, cols) -> DataFrame:
    return group_mean(df, ["site", "ts", "yr", "wk"], cols)


def agg_day_all_sites(daily: DataFrame, cols) -> DataFrame:
    """Unweighted mean over sites for each date."""
    return group_mean(daily, ["dt"], cols)


def agg_site_mean(df: DataFrame, cols) -> DataFrame:
    return group_mean(df, ["site"], cols)


def agg_numeric_all(df: DataFrame, k) -> DataFrame:
    """Arithmetic mean of every numeric column that is not a key."""
    cols = [f.name for f in df.schema if is_numeric(f) and f.name not in k]
    return group_mean(df, list(k), cols)


def agg_cohort_mean(df: DataFrame, cohort, col) -> DataFrame:
    return df.groupBy(cohort).agg(F.avg(col).alias("mean"))


def freq_table(df: DataFrame, col) -> DataFrame:
    """(value, count) without nulls, most frequent first."""
    counts = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).count()
    return counts.orderBy(F.col("count").desc(), "value")


def agg_max_date(df: DataFrame, k, date="dt") -> DataFrame:
    return df.groupBy(*k).agg(F.max(date).alias(date))


def distinct_classes(df: DataFrame, k, label) -> DataFrame:
    return df.groupBy(*k).agg(F.count_distinct(label).alias("n_classes"))
