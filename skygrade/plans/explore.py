"""Comparison of two cohorts and the tables behind the exploratory plots."""

from itertools import combinations_with_replacement, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.functions.scalars import pct_change
from skygrade.operators.aggregates import agg_site_mean
from skygrade.operators.joins import join_suffix
from skygrade.operators.select import add_literal, rank_variation, semi_month_day, union_by_name
from skygrade.operators.stats import corr_fan_out, mirrored
from skygrade.schema import POLLUTANTS, WEATHER_VS_CLASS, WEATHER_VS_POLLUTANTS


def aligned_cohorts(earlier: DataFrame, later: DataFrame, names=("earlier", "later")):
    """Both cohorts with a ``cohort`` column, the earlier cut to the later one's calendar."""
    a = add_literal(semi_month_day(earlier, later), "cohort", names[0])
    return a, add_literal(later, "cohort", names[1])


def stacked_cohorts(earlier: DataFrame, later: DataFrame) -> DataFrame:
    return union_by_name(*aligned_cohorts(earlier, later))


def site_variation(earlier: DataFrame, later: DataFrame) -> DataFrame:
    """Change in percent of each site's mean, one column per pollutant."""
    means = [agg_site_mean(side, POLLUTANTS) for side in aligned_cohorts(earlier, later)]
    wide = join_suffix(*means, ["site"], ("_earlier", "_later"))
    return wide.select(
        "site", *[pct_change(F.col(f"{p}_earlier"), F.col(f"{p}_later")).alias(p) for p in POLLUTANTS]
    )


def ranked_variation(earlier: DataFrame, later: DataFrame) -> DataFrame:
    return rank_variation(site_variation(earlier, later), POLLUTANTS)


def weather_vs_class(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Correlation matrix of weather and mean class over complete rows of their left join."""
    cols = [c for c in WEATHER_VS_CLASS if c in weather.columns]
    pairs = list(combinations_with_replacement([*cols, "class_mean"], 2))
    complete = weather.na.drop("any", subset=cols)
    days = daily.where("class_mean is not null")
    return mirrored(corr_fan_out(days, complete, ["site", "dt"], pairs))


def weather_vs_pollutants(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Correlation block, each cell over the rows of the left join where both are known."""
    cols = [c for c in WEATHER_VS_POLLUTANTS if c in weather.columns]
    return corr_fan_out(daily, weather, ["site", "dt"], list(product(cols, POLLUTANTS)))
