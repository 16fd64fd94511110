"""The whole study, from raw tables to scores and forecasts.

Each step returns DataFrames. ``site`` restricts a step to one district, the
usual single-series case; without it one pooled model per target is trained and
per-series models are fitted for all districts at once.
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrade.models.autoregressive import (
    ar_fit,
    ar_fit_tube,
    ar_predict,
    ar_predict_tube,
    forecast_recursive,
    forecast_status,
    forecast_tube,
    last_values,
)
from skygrade.models.bayes import cls_naive_bayes
from skygrade.models.by_site import cls_by_site
from skygrade.models.estimators import CLASSIFIERS, GRIDS, candidates
from skygrade.models.neighbours import cls_knn
from skygrade.models.training import (
    classification_results,
    cross_validate,
    regression_results,
    train_regressors,
    union_all,
)
from skygrade.operators.aggregates import agg_cohort_mean, agg_day_all_sites
from skygrade.operators.folds import split_chrono_dates
from skygrade.operators.metrics import m_mae, m_r2, m_rmse
from skygrade.operators.select import filter_eq
from skygrade.operators.series import tail_n
from skygrade.operators.stats import box_stats, box_stats_cohort
from skygrade.plans.clean import clean_daily, clean_hourly, model_frame
from skygrade.plans.explore import ranked_variation, stacked_cohorts, weather_vs_class, weather_vs_pollutants
from skygrade.plans.features import (
    ORDER,
    SERIES,
    classification_frame,
    feature_set_adv,
    feature_set_base,
    regression_frame,
)
from skygrade.schema import CLASS_COLUMNS, DISTRICTS, POLLUTANTS, TARGETS
from skygrade.session import materialise
from skygrade.sources.readers import (
    Source,
    canonical_readings,
    lost_dates,
    read_landed,
    src_optional,
    src_readings_hourly,
    src_weather,
)

# Classes whose frequencies are reported, days of history shown with a forecast.
REPORTED_CLASSES = ("so2_cls", "pm25_cls", "o3_cls")
HISTORY_DAYS = 30


@dataclass(frozen=True)
class Tables:
    """Clean tables; an optional one is None if its source could not be read."""

    daily: DataFrame
    hourly: DataFrame | None = None
    weather: DataFrame | None = None
    reasons: dict = field(default_factory=dict)


def load(spark: SparkSession, readings, hourly=None, weather=None, fmt="parquet", sites=DISTRICTS) -> Tables:
    """Read and clean. Readings must load; a failing optional source is skipped with its reason.
    Readings of which no row is left (no site listed, no date understood) have not loaded;
    dates that the shape of their file does not fit are counted in the reasons.

    The clean tables feed every later step, so they are written out once.
    """
    absent = Source(None, "not given")
    losses = {}

    def clean_first():
        landed = read_landed(spark, readings, fmt)
        raw = canonical_readings(landed)
        daily = materialise(clean_daily(raw, sites), "daily")
        if daily.isEmpty() and not raw.isEmpty():
            raise ValueError(f"readings: no row has a known site and a date, out of {raw.count()}")
        lost = lost_dates(landed).agg(F.count_if(F.col("n_lost") > 0), F.sum("n_lost"), F.sum("n_texts")).first()
        if lost[0]:
            losses["readings"] = f"{lost[1]} of {lost[2]} dates not understood, in {lost[0]} files"
        return daily

    clean_second = lambda: materialise(clean_hourly(src_readings_hourly(spark, hourly, fmt), sites), "hourly")
    second = src_optional(clean_second) if hourly else absent
    third = src_optional(lambda: src_weather(spark, weather)) if weather else absent
    first = src_optional(clean_first, required=True)
    return Tables(
        first.df,
        second.df,
        third.df,
        losses | {name: s.reason for name, s in (("hourly", second), ("weather", third)) if s.reason},
    )


@dataclass(frozen=True)
class Exploration:
    """The tables behind the exploratory plots; None where an optional source is missing."""

    day_boxes: DataFrame
    cohort_boxes: DataFrame | None = None
    class_means: DataFrame | None = None
    variation: DataFrame | None = None
    weather_class: DataFrame | None = None
    weather_pollutants: DataFrame | None = None


def explore(tables: Tables) -> Exploration:
    """Daily spread, comparison of the two cohorts, and correlations with the weather."""
    views = {"day_boxes": box_stats(agg_day_all_sites(tables.daily, POLLUTANTS), POLLUTANTS)}
    if tables.hourly is not None:
        both = stacked_cohorts(tables.hourly, tables.daily)
        views["cohort_boxes"] = box_stats_cohort(both, POLLUTANTS)
        views["class_means"] = agg_cohort_mean(both, "cohort", "class_mean")
        views["variation"] = ranked_variation(tables.hourly, tables.daily)
    if tables.weather is not None:
        views["weather_class"] = weather_vs_class(tables.daily, tables.weather)
        views["weather_pollutants"] = weather_vs_pollutants(tables.daily, tables.weather)
    return Exploration(**views)


def frame_for(tables: Tables, site=None) -> DataFrame:
    if tables.weather is None:
        raise ValueError(f"no weather: {tables.reasons.get('weather')}")
    daily = tables.daily if site is None else filter_eq(tables.daily, "site", site)
    return model_frame(daily, tables.weather)


def present(names, frame) -> list:
    """Those of the names that the frame has: sources may lack columns."""
    return [n for n in names if n in frame.columns]


def regression(tables: Tables, advanced=False, site=None, grids=None, targets=TARGETS, workers=4) -> DataFrame:
    """Grid search, refit and hold-out scores for every pollutant.

    Weather only with contiguous folds, or with lags and expanding folds if ``advanced``.
    """
    frame = frame_for(tables, site)
    prepared = regression_frame(frame) if advanced else frame
    features = present(feature_set_adv() if advanced else feature_set_base(), prepared)
    targets = present(targets, prepared)
    split = split_chrono_dates(prepared.select("site", "dt", *features, *[t for t in targets if t not in features]), "dt")
    grids = grids or {model: candidates(grid) for model, grid in GRIDS.items()}
    done = train_regressors(
        materialise(split, "split", ["role"]), targets, grids, features, advanced, 3, workers, site is None
    )
    return regression_results(frame.sparkSession, *done)


def classification(tables: Tables, site=None, models=None, targets=CLASS_COLUMNS, workers=4, n_folds=5, apart=()) -> DataFrame:
    """Expanding-fold accuracy and weighted F1 of every classifier for every class column.

    ``models`` maps names of pooled classifiers to their parameters; the
    neighbours and the naive Bayes classifier are always per district, and so are
    those named in ``apart`` (see ``by_site.LEARNERS``), all districts in one job.
    """
    frame = classification_frame(frame_for(tables, site))
    features, targets = present(feature_set_adv(), frame), present(targets, frame)
    frame = frame.select("site", "dt", *features, *targets)
    frame = materialise(frame, "frame")
    models = {name: {} for name in CLASSIFIERS if name not in apart} if models is None else models
    pooled, failed = cross_validate(frame, targets, models, features, n_folds, workers, site is None)
    named = lambda df, name: df.withColumn("model", F.lit(name)).select("site", "dt", "target", "model", "y", "p", "fold")
    frames = [
        named(cls_naive_bayes(frame, features, targets, n_folds=n_folds), "NaiveBayes"),
        named(cls_knn(frame, features, targets, n_folds=n_folds), "KNN"),
        *[named(cls_by_site(frame, features, targets, name, n_folds=n_folds), name) for name in apart],
        *([pooled.select("site", "dt", "target", "model", "y", "p", "fold")] if pooled is not None else []),
    ]
    return classification_results(frame.sparkSession, materialise(union_all(frames), "answers"), failed)


def class_frequencies(tables: Tables, site=None) -> DataFrame:
    """(target, value, count) of the reported class columns."""
    frame = frame_for(tables, site)
    parts = [F.struct(F.lit(c).alias("target"), F.col(c).alias("value")) for c in present(REPORTED_CLASSES, frame)]
    return frame.select(F.inline(F.array(*parts))).where("value is not null").groupBy("target", "value").agg(F.count(F.lit(1)).alias("count"))


@dataclass(frozen=True)
class Forecast:
    scores: DataFrame
    fitted: DataFrame
    ahead: DataFrame
    status: DataFrame
    recent: DataFrame


def forecast(tables: Tables, site=None, col="class_mean", n=7, steps=7, tube=False) -> Forecast:
    """Autoregression of the mean class: in-sample scores, fitted values, days ahead, recent history.

    With ``tube`` it is support vector regression with a radial kernel, else ridge regression.
    """
    fit, predict, ahead = (ar_fit_tube, ar_predict_tube, forecast_tube) if tube else (ar_fit, ar_predict, forecast_recursive)
    frame = materialise(frame_for(tables, site).select("site", "dt", col), "series")
    weights = materialise(fit(frame, SERIES, col, n=n), "weights")
    fitted = predict(frame, weights, SERIES, col, n=n)
    last = last_values(frame, SERIES, col, n=n)
    metrics = {"mae": m_mae, "rmse": m_rmse, "r2": m_r2}
    return Forecast(
        union_all([score(fitted, SERIES).withColumn("metric", F.lit(name)) for name, score in metrics.items()]),
        fitted,
        ahead(weights, last, n=n, steps=steps),
        forecast_status(last, n=n),
        tail_n(frame, SERIES, ORDER, HISTORY_DAYS),
    )
