"""Operators over ordered series.

Windows are keyed by the series and ordered by columns that single out a row.
They are meant for the daily grain, where a series has at most one row per
calendar day: a century of one site is 36,525 rows, whatever the volume of raw
readings behind it, so no series can outgrow a task. ``agg_day_mean`` and
``agg_numeric_all`` produce that grain.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrade.operators.select import tail_n


def series_window(k, o):
    return Window.partitionBy(*k).orderBy(*o)


def lag_features(df: DataFrame, k, o, cols, lags=(1, 2)) -> DataFrame:
    """Values of earlier rows (not earlier calendar days) as ``<col>_lag<i>``."""
    w = series_window(k, o)
    return df.withColumns({f"{c}_lag{i}": F.lag(c, i).over(w) for i in lags for c in cols})


def roll3_mean(df: DataFrame, k, o, cols, include_current=True) -> DataFrame:
    """Mean of three successive rows as ``<col>_roll3``; null unless all three are present.

    The window ends with the current row, so together with lag 1 and lag 2 it
    gives the current value away. ``include_current=False`` ends it one row earlier.
    """
    first, last = (-2, 0) if include_current else (-3, -1)
    w = series_window(k, o).rowsBetween(first, last)
    full = lambda c: F.when(F.count(c).over(w) == 3, F.avg(c).over(w))
    return df.withColumns({f"{c}_roll3": full(c) for c in cols})


def ar_lags(df: DataFrame, k, o, col, n=7) -> DataFrame:
    """lag1..lagn of one column, for the rows where all of the row is known."""
    w = series_window(k, o)
    return df.withColumns({f"lag{i}": F.lag(col, i).over(w) for i in range(1, n + 1)}).na.drop("any")


def fill_forward_back(df: DataFrame, k, o, cols) -> DataFrame:
    """Nulls take the last value before them, at the head of a series the first one after."""
    w = series_window(k, o)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    filled = lambda c: F.coalesce(
        F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead)
    )
    return df.withColumns({c: filled(c) for c in cols})


def real_vs_pred(df: DataFrame, y, p) -> DataFrame:
    """(site, dt, y, p); the actual value travels in the prediction's row."""
    return df.select("site", "dt", F.col(y).alias("y"), F.col(p).alias("p"))


def impute_mean(df: DataFrame, k, cols, fit_on="all") -> DataFrame:
    """Nulls take their series' mean, over all rows or (``"train"``) those with role train."""
    w = Window.partitionBy(*k)
    known = lambda c: F.col(c) if fit_on == "all" else F.when(F.col("role") == "train", F.col(c))
    return df.withColumns({c: F.coalesce(F.col(c), F.avg(known(c)).over(w)) for c in cols})


__all__ = [
    "ar_lags",
    "fill_forward_back",
    "impute_mean",
    "lag_features",
    "real_vs_pred",
    "roll3_mean",
    "series_window",
    "tail_n",
]
