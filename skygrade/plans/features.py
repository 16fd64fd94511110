"""Model inputs: weather, lags, trailing means and calendar parts."""

from pyspark.sql import DataFrame

from skygrade.functions.scalars import month_weekday
from skygrade.operators.series import fill_forward_back, impute_mean, lag_features, roll3_mean
from skygrade.schema import TARGETS, WEATHER_FEATURES

SERIES = ["site"]
ORDER = ["dt"]


def feature_set_base():
    return list(WEATHER_FEATURES)


def lag_columns():
    return [f"{c}_lag{i}" for i in (1, 2) for c in TARGETS] + [f"{c}_roll3" for c in TARGETS]


def feature_set_adv():
    return feature_set_base() + lag_columns() + ["month", "weekday"]


def with_advanced(frame: DataFrame, include_current=True) -> DataFrame:
    """The model frame with lags, trailing means, month and weekday.

    All windows share one partitioning and order, hence one shuffle and sort.
    """
    month, weekday = month_weekday("dt")
    lagged = lag_features(frame, SERIES, ORDER, TARGETS)
    rolled = roll3_mean(lagged, SERIES, ORDER, TARGETS, include_current)
    return rolled.withColumns({"month": month, "weekday": weekday})


def regression_frame(frame: DataFrame, fit_on="all") -> DataFrame:
    """Head-of-series nulls replaced by the mean of the series."""
    return impute_mean(with_advanced(frame), SERIES, lag_columns(), fit_on)


def classification_frame(frame: DataFrame) -> DataFrame:
    """Head-of-series nulls filled forwards, then backwards, then by the mean."""
    filled = fill_forward_back(with_advanced(frame), SERIES, ORDER, lag_columns())
    return impute_mean(filled, SERIES, lag_columns())
