"""From raw readings to clean, graded tables.

The weekly fill needs no join at the daily grain. A null reading is replaced by
the mean of its site-week, and readings are then averaged, so the day's mean is

    (sum of known values + unknown count x week mean) / row count

which follows from per-day sums and counts. Raw rows are therefore combined
map-side and shuffled once, as one row per site and day.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrade.functions.grading import with_classes
from skygrade.operators.aggregates import agg_numeric_all, with_week
from skygrade.operators.joins import join_weather_inner
from skygrade.operators.select import drop_null_any, filter_in_list, no_null_keys
from skygrade.operators.spread import BROADCAST_BYTES, lookup_join
from skygrade.schema import CLASS_COLUMNS, POLLUTANTS
from skygrade.session import materialise


def value_sums():
    """Aggregates: row count, and sum and count of known values per pollutant."""
    return [
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(p).alias(f"_sum_{p}") for p in POLLUTANTS],
        *[F.count(p).alias(f"_known_{p}") for p in POLLUTANTS],
    ]


def day_sums(readings: DataFrame, grain, iso_year=False) -> DataFrame:
    """Sum and count of known values per pollutant, and row count, by site and grain."""
    return with_week(no_null_keys(readings, ["site", grain]).groupBy("site", grain).agg(*value_sums()), grain, iso_year)


def week_mean(p, over=None):
    """Mean of the known values of a week, as an aggregate or over a window."""
    total, known = F.sum(f"_sum_{p}"), F.sum(f"_known_{p}")
    return F.try_divide(total, known) if over is None else F.try_divide(total.over(over), known.over(over))


def filled_means(sums: DataFrame, grain) -> DataFrame:
    """Means after filling, given the sums and ``_week_<p>``; null where the week knows nothing."""
    unknown = lambda p: F.col("_rows") - F.col(f"_known_{p}")
    share = lambda p: F.when(unknown(p) > 0, unknown(p) * F.col(f"_week_{p}")).otherwise(0.0)
    mean = lambda p: (F.coalesce(f"_sum_{p}", F.lit(0.0)) + share(p)) / F.col("_rows")
    return sums.select("site", grain, "yr", "wk", *[mean(p).alias(p) for p in POLLUTANTS])


def daily_means(readings: DataFrame, iso_year=False) -> DataFrame:
    """Weekly fill and mean per site and day."""
    return days_from_sums(day_sums(readings, "dt", iso_year))


def days_from_sums(sums: DataFrame) -> DataFrame:
    """The same from sums by site and day.

    A site-week holds at most 14 days (the calendar year joins the last days of a
    year to its first week), so the window over it is short.
    """
    week = Window.partitionBy("site", "yr", "wk")
    return filled_means(sums.withColumns({f"_week_{p}": week_mean(p, week) for p in POLLUTANTS}), "dt")


def hourly_means(readings: DataFrame, max_bytes=BROADCAST_BYTES, iso_year=False) -> DataFrame:
    """Weekly fill and mean per site and timestamp.

    Timestamps have no least distance, so a week of one site may hold any number
    of them: the week means are aggregated and looked up, never windowed. The sums
    are written when this is called, so raw rows are read and shuffled once.
    """
    sums = materialise(day_sums(readings, "ts", iso_year), "sums")  # read for the week means and again for the days
    weeks = sums.groupBy("site", "yr", "wk").agg(*[week_mean(p).alias(f"_week_{p}") for p in POLLUTANTS])
    return filled_means(lookup_join(sums, weeks, ["site", "yr", "wk"], "inner", max_bytes), "ts")


def keep_sites(df, sites):
    return df if sites is None else filter_in_list(df, "site", sites)


def clean_daily(readings: DataFrame, sites=None, iso_year=False) -> DataFrame:
    """site, dt, yr, wk, pollutants, classes, class_mean at the daily grain.

    Sites are filtered first: the site is part of every key, so no other site's
    rows can matter.
    """
    return with_classes(daily_means(keep_sites(readings, sites), iso_year))


def clean_hourly(readings: DataFrame, sites=None, iso_year=False, daily=False) -> DataFrame:
    """The same at the timestamp grain, with the day added afterwards, or at the daily grain if ``daily``."""
    if daily:
        return clean_daily(readings, sites, iso_year)
    graded = with_classes(hourly_means(keep_sites(readings, sites), iso_year=iso_year))
    return graded.withColumn("dt", F.to_date("ts"))


def weather_daily(weather: DataFrame, skip=("weather_id",)) -> DataFrame:
    """Arithmetic mean of every numeric weather column by site and day."""
    return agg_numeric_all(weather.drop(*skip), ["site", "dt"])


def model_frame(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Clean days with their weather, complete in every column.

    The inner join on site keeps only sites with readings, so no membership test
    comes before it.
    """
    return drop_null_any(join_weather_inner(daily, weather_daily(weather)))


__all__ = ["CLASS_COLUMNS", "clean_daily", "clean_hourly", "daily_means", "hourly_means", "model_frame", "weather_daily"]
