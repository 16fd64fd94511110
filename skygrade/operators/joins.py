"""Joins between readings, their weekly means, weather and cohorts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.operators.spread import BROADCAST_BYTES, lookup_join
from skygrade.session import materialise


def join_group_mean(df: DataFrame, means: DataFrame, k, cols, max_bytes=BROADCAST_BYTES) -> DataFrame:
    """Attach the group means as ``<col>_media`` to every row."""
    renamed = means.select(*k, *[F.col(c).alias(f"{c}_media") for c in cols])
    return lookup_join(df, renamed, list(k), "left", max_bytes)


def join_weather_left(readings: DataFrame, weather: DataFrame, k=("site", "dt")) -> DataFrame:
    """Daily readings with every weather row of their site and day.

    A reading without weather is kept with nulls, one with several weather rows
    is repeated. ``readings`` has one row per key; the weather side may be skewed,
    so it is the side that is scanned and salted. Matched and unmatched readings
    are found separately because a salted left join would repeat the unmatched.
    """
    keys = list(k)
    readings = materialise(readings, "daily")  # read for the matched and for the unmatched rows
    matched = lookup_join(weather, readings, keys, "inner")
    present = weather.select(*keys).distinct()
    unmatched = readings.join(present, keys, "left_anti")
    order = readings.columns + [c for c in weather.columns if c not in keys]
    return matched.unionByName(unmatched, allowMissingColumns=True).select(order)


def join_weather_inner(readings: DataFrame, weather_daily: DataFrame, k=("site", "dt")) -> DataFrame:
    """Model frame: one row per site and day on both sides, so no key can be hot.

    A column that both sides have is the readings' under its own name and the
    weather's with ``_weather`` after it.
    """
    both = set(readings.columns) & set(weather_daily.columns) - set(k)
    return readings.join(weather_daily.withColumnsRenamed({c: f"{c}_weather" for c in both}), list(k), "inner")


def join_suffix(a: DataFrame, b: DataFrame, on, suffixes) -> DataFrame:
    """Inner join with both sides' columns marked by a suffix."""
    marked = [
        side.select(*on, *[F.col(c).alias(c + suffix) for c in side.columns if c not in on])
        for side, suffix in zip((a, b), suffixes)
    ]
    return marked[0].join(marked[1], list(on), "inner")
