"""Every operator as a query over whole tables."""

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from skygrade.functions.grading import classify_nearest
from skygrade.functions import scalars as S
from skygrade.models.autoregressive import (
    ar_fit,
    ar_fit_tube,
    ar_gram,
    ar_predict,
    ar_predict_tube,
    forecast_recursive,
    forecast_status,
    forecast_tube,
    last_values,
)
from skygrade.models.bayes import cls_naive_bayes
from skygrade.models.boosted import fit_boosted
from skygrade.models.by_site import cls_by_site
from skygrade.models.estimators import GRIDS, candidates
from skygrade.models.neighbours import cls_knn, knn_work
from skygrade.models.network import Plan, fit_networks
from skygrade.models.training import (
    classification_results,
    fit_classifier,
    fit_regressor,
    fit_targets,
    regression_results,
    train_regressors,
    union_all,
)
from skygrade.operators import aggregates as A
from skygrade.operators import folds as D
from skygrade.operators import joins as J
from skygrade.operators import metrics as M
from skygrade.operators import select as P
from skygrade.operators import series as W
from skygrade.operators import stats as B
from skygrade.operators.search import grid_search
from skygrade.plans import clean as C
from skygrade.plans import explore as X
from skygrade.plans import features as Q
from skygrade.schema import (
    CLASS_COLUMNS,
    POLLUTANTS,
    READING_NAMES,
    TARGETS,
    WEATHER_VS_POLLUTANTS,
    class_name,
)
from skygrade.session import fresh_path, materialise
from skygrade.sources import readers as R
from skygrade.sources import tables as T
from skygrade.sources.sinks import sink_table

QUERIES = {}
SITE_DAY = ["site", "dt"]
ADV = Q.feature_set_adv()

# Sites of the filter queries.
LISTED_SITES = ("D0", "D1", "D2", "D3", "D5", "D8", "D13")
ONE_SITE = "D1"

# Weights of the given autoregressive model: intercept, then lag 1 to 7.
GIVEN_WEIGHTS = (0.3, 0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.02)


def query(fn):
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def rounded(df, digits=6):
    """Doubles rounded for comparison between engines."""
    fix = lambda f: F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name)
    return df.select([fix(f) for f in df.schema])


def daily(spark, d):
    return C.clean_daily(T.readings(spark, d))


def model(spark, d):
    return C.model_frame(daily(spark, d), T.weather(spark, d))


def stacked(spark, d):
    return X.stacked_cohorts(*[materialise(side, "cohort") for side in both_cohorts(spark, d)])


def both_cohorts(spark, d):
    return C.clean_hourly(T.earlier_cohort(spark, d)), C.clean_daily(T.later_cohort(spark, d))


# Sources and sinks


def landed(df, label, fmt):
    """Write a raw-shaped table to the shared folder and give its path."""
    path = fresh_path(df.sparkSession, label)
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(path)
    return path


def raw_text(p, bad):
    return F.when(bad, F.lit("12,5")).otherwise(F.col(p).cast("string"))


def raw_name(p):
    return next(raw for raw, name in READING_NAMES.items() if name == p)


def raw_readings(spark, d):
    df = T.readings(spark, d)
    bad = F.col("event_id") % 17 == 0
    return df.select(
        F.col("site").alias("Coluna1"),
        F.date_format("dt", "dd/MM/yyyy").alias("Data"),
        F.lit("Urbana").alias("Tipo"),
        F.lit("Norte").alias("Zona"),
        *[raw_text(p, bad).alias(raw_name(p)) for p in POLLUTANTS],
    )


def raw_hourly(spark, d):
    df = T.cohorts(spark, d)
    return df.select(
        F.col("site").alias(" Distrito"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Data-Hora "),
        F.lit("Porto").alias("Local"),
        *[F.col(p).alias(f" {raw_name(p)} ") for p in POLLUTANTS],
    )


def raw_weather(spark, d):
    late = F.col("weather_id") % 2 == 0
    day = F.col("dt").cast("string")
    stamp = F.when(late, F.concat(day, F.lit(" 12:00:00+00:00"))).otherwise(F.concat(day, F.lit(" 00:30:00+01:00")))
    df = T.weather(spark, d)
    return df.select(stamp.alias("date"), F.concat(F.lit(" "), F.lower("site")).alias("distrito"), *df.columns[3:])


@query
def src_readings(spark, d):
    return rounded(R.src_readings(spark, landed(raw_readings(spark, d), "readings", "parquet")))


@query
def src_readings_hourly(spark, d):
    return rounded(R.src_readings_hourly(spark, landed(raw_hourly(spark, d), "hourly", "parquet"), "parquet"))


@query
def src_weather(spark, d):
    return rounded(R.src_weather(spark, landed(raw_weather(spark, d), "weather", "csv")))


def two_writers(spark, d):
    """A folder of CSV files of two writers: other columns first, other dates, in a folder each."""
    df, path = T.readings(spark, d), fresh_path(spark, "mixed")
    bad = F.col("event_id") % 17 == 0
    values = [raw_text(p, bad).alias(raw_name(p)) for p in POLLUTANTS]
    site, part = F.col("site").alias("Coluna1"), (F.col("event_id") % 2).alias("part")
    one = df.where("event_id % 2 = 0").select(site, F.date_format("dt", "dd/MM/yyyy").alias("Data"), F.lit("Norte").alias("Zona"), *values, part)
    two = df.where("event_id % 2 = 1").select(*values[::-1], F.date_format("dt", "yyyy-MM-dd").alias("Data"), site, part)
    for writer in (one, two):
        writer.write.option("header", True).partitionBy("part").mode("append").csv(path)
    return path


@query
def src_readings_mixed(spark, d):
    return rounded(R.src_readings(spark, two_writers(spark, d), "csv"))


@query
def src_lost_dates(spark, d):
    """Texts that are no date, by the shape of their file: none, though the folder has two."""
    lost = R.lost_dates(R.read_landed(spark, two_writers(spark, d), "csv"))
    return lost.groupBy("shape").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_lost").alias("n_lost"))


@query
def src_optional(spark, d):
    sources = {
        "readings": R.src_optional(lambda: R.canonical_readings(raw_readings(spark, d)), required=True),
        "hourly": R.src_optional(lambda: R.canonical_hourly(raw_hourly(spark, d))),
        "weather": R.src_optional(lambda: R.canonical_weather(raw_weather(spark, d))),
        "undated weather": R.src_optional(lambda: R.canonical_weather(raw_weather(spark, d).drop("date"))),
    }

    def summary(name, source):
        rows = F.count(F.lit(1)).alias("n_rows")
        base = source.df if source.df is not None else T.orders(spark, d).limit(0)
        return base.agg(rows).select(
            F.lit(name).alias("source"),
            F.lit(source.status).alias("status"),
            F.lit(source.reason).cast("string").alias("reason"),
            "n_rows",
        )

    return union_all([summary(*item) for item in sources.items()])


@query
def schema_repair(spark, d):
    return rounded(R.schema_repair(raw_hourly(spark, d), READING_NAMES, ("Local", "Tipo", "Zona")))


@query
def sink_table_query(spark, d):
    path = fresh_path(spark, "clean")
    sink_table(C.clean_hourly(T.cohorts(spark, d)), path, ["yr"])
    back = spark.read.parquet(path)
    return rounded(back.groupBy("yr").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("class_mean").alias("class_mean")))


# Projections, filters, predicates


@query
def project_rename(spark, d):
    return rounded(P.project_rename(daily(spark, d), {"dt": "date", "site": "distrito", "class_mean": "media"}))


@query
def project_dynamic(spark, d):
    return P.project_dynamic(daily(spark, d), "_cls", ["site", "dt", "uv_index_max"])


@query
def add_literal(spark, d):
    return rounded(P.add_literal(daily(spark, d), "cohort", "2025").select(*SITE_DAY, "class_mean", "cohort"))


@query
def filter_in_list(spark, d):
    return rounded(P.filter_in_list(daily(spark, d), "site", LISTED_SITES).select(*SITE_DAY, "class_mean"))


@query
def filter_eq(spark, d):
    return rounded(P.filter_eq(daily(spark, d), "site", ONE_SITE).select(*SITE_DAY, "class_mean"))


@query
def drop_null_any(spark, d):
    return rounded(P.drop_null_any(T.weather(spark, d)))


@query
def drop_null_subset(spark, d):
    kept = P.drop_null_subset(T.cohorts(spark, d), ["no2", "o3"])
    return rounded(kept.select("reading_id", *POLLUTANTS))


@query
def null_check(spark, d):
    return P.null_check(T.weather(spark, d))


# Joins


@query
def join_group_mean(spark, d):
    df = T.readings(spark, d)
    joined = J.join_group_mean(df, A.agg_week_mean(df, POLLUTANTS), ["site", "yr", "wk"], POLLUTANTS)
    return rounded(joined.select("event_id", *POLLUTANTS, *[f"{p}_media" for p in POLLUTANTS]))


@query
def join_weather_left(spark, d):
    cols = [*SITE_DAY, "class_mean", "weather_id", "temperature_2m", "rain"]
    return rounded(J.join_weather_left(daily(spark, d), T.weather(spark, d)).select(cols))


@query
def join_weather_inner(spark, d):
    frame = J.join_weather_inner(daily(spark, d), C.weather_daily(T.weather(spark, d)))
    return rounded(frame.select(*SITE_DAY, "no2", "class_mean", *WEATHER_VS_POLLUTANTS))


@query
def join_suffix(spark, d):
    means = [A.agg_site_mean(side, POLLUTANTS) for side in X.aligned_cohorts(*both_cohorts(spark, d))]
    return rounded(J.join_suffix(*means, ["site"], ("_earlier", "_later")))


@query
def semi_month_day(spark, d):
    kept = P.semi_month_day(T.earlier_cohort(spark, d), T.later_cohort(spark, d))
    return kept.select("reading_id", "site", "dt")


@query
def semi_valid_site(spark, d):
    return P.semi_valid_site(T.weather(spark, d), T.readings(spark, d)).select("weather_id", "site")


# Aggregations


@query
def agg_week_mean(spark, d):
    return rounded(A.agg_week_mean(T.readings(spark, d), POLLUTANTS))


@query
def agg_day_mean(spark, d):
    return rounded(C.daily_means(T.readings(spark, d)))


@query
def agg_hour_mean(spark, d):
    return rounded(C.hourly_means(T.cohorts(spark, d)))


@query
def agg_day_all_sites(spark, d):
    return rounded(A.agg_day_all_sites(daily(spark, d), POLLUTANTS))


@query
def agg_site_mean(spark, d):
    return rounded(A.agg_site_mean(stacked(spark, d), POLLUTANTS))


@query
def agg_numeric_all(spark, d):
    return rounded(C.weather_daily(T.weather(spark, d)))


@query
def agg_cohort_mean(spark, d):
    return rounded(A.agg_cohort_mean(stacked(spark, d), "cohort", "class_mean"))


@query
def freq_table(spark, d):
    return A.freq_table(daily(spark, d), "so2_cls")


@query
def corr_complete(spark, d):
    return rounded(X.weather_vs_class(daily(spark, d), T.weather(spark, d)))


@query
def corr_pairwise(spark, d):
    return rounded(X.weather_vs_pollutants(daily(spark, d), T.weather(spark, d)))


@query
def box_stats(spark, d):
    return rounded(B.box_stats(A.agg_day_all_sites(daily(spark, d), POLLUTANTS), POLLUTANTS))


@query
def box_stats_cohort(spark, d):
    return rounded(B.box_stats_cohort(stacked(spark, d), POLLUTANTS))


@query
def box_outliers(spark, d):
    return rounded(B.box_outliers(stacked(spark, d), POLLUTANTS, ["site", "dt", "ts"], ["cohort"]))


@query
def agg_max_date(spark, d):
    return A.agg_max_date(T.readings(spark, d), ["site"])


@query
def distinct_values(spark, d):
    return P.distinct_values(T.weather(spark, d), ["site"])


@query
def distinct_classes(spark, d):
    folds = D.fold_expanding(model(spark, d).select(*SITE_DAY, "no2_cls"), ["site"], ["dt"], 5)
    return A.distinct_classes(folds.where("role = 'train'"), ["site", "fold"], "no2_cls")


# Ordered series


@query
def lag_features(spark, d):
    lagged = W.lag_features(model(spark, d).select(*SITE_DAY, *TARGETS), ["site"], ["dt"], TARGETS)
    return rounded(lagged.drop(*TARGETS))


@query
def roll3_mean(spark, d):
    rolled = W.roll3_mean(model(spark, d).select(*SITE_DAY, *TARGETS), ["site"], ["dt"], TARGETS)
    return rounded(rolled.drop(*TARGETS))


@query
def roll3_mean_strict(spark, d):
    frame = model(spark, d).select(*SITE_DAY, *TARGETS)
    return rounded(W.roll3_mean(frame, ["site"], ["dt"], TARGETS, include_current=False).drop(*TARGETS))


@query
def ar_lags(spark, d):
    return rounded(W.ar_lags(model(spark, d).select(*SITE_DAY, "class_mean"), ["site"], ["dt"], "class_mean"))


@query
def fill_forward_back(spark, d):
    return rounded(W.fill_forward_back(Q.with_advanced(model(spark, d)), ["site"], ["dt"], Q.lag_columns()).select(*SITE_DAY, *Q.lag_columns()))


@query
def tail_n(spark, d):
    return rounded(W.tail_n(daily(spark, d).select(*SITE_DAY, "class_mean"), ["site"], ["dt"], 7))


@query
def real_vs_pred(spark, d):
    lagged = W.ar_lags(model(spark, d).select(*SITE_DAY, "class_mean"), ["site"], ["dt"], "class_mean")
    return rounded(W.real_vs_pred(lagged, "class_mean", "lag1"))


# Sort, limit, set operations


@query
def sort_series(spark, d):
    return rounded(P.sort_series(daily(spark, d).select(*SITE_DAY, "class_mean"), ["site"], ["dt"]))


@query
def rank_variation(spark, d):
    return rounded(X.ranked_variation(*both_cohorts(spark, d)))


@query
def head_n(spark, d):
    return rounded(P.head_n(daily(spark, d).select(*SITE_DAY, "class_mean"), ["dt", "site"]))


@query
def union_by_name(spark, d):
    return rounded(stacked(spark, d).select("cohort", "site", "dt", "ts", *POLLUTANTS))


# Scalars


def messy_number():
    """Order totals as text, some in shapes a parser must refuse."""
    price = F.col("o_totalprice").cast("string")
    shapes = [F.concat(F.lit(" "), price, F.lit(" ")), F.concat(price, F.lit("d")), F.lit("nan"), F.lit("12,5"), F.lit("-"), F.lit("")]
    text = price
    for i, shape in enumerate(shapes):
        text = F.when(F.col("o_orderkey") % 8 == i, shape).otherwise(text)
    return text


@query
def to_number(spark, d):
    return T.orders(spark, d).select("o_orderkey", S.to_number(messy_number()).alias("number"))


@query
def parse_dayfirst(spark, d):
    """One column of each shape, every fifth value of which has another."""
    written = {"slash": "d/M/yyyy", "dash": "d-M-yyyy", "iso": "yyyy-MM-dd"}
    df = T.orders(spark, d)
    for shape, pattern in written.items():
        other = "d-M-yyyy" if shape == "iso" else "yyyy-MM-dd"
        text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", other)).otherwise(F.date_format("o_orderdate", pattern))
        df = df.withColumn(shape, text)
    days = [S.parse_dayfirst(shape, S.date_shape(df, shape)).alias(f"{shape}_day") for shape in written]
    return df.select("o_orderkey", *days)


@query
def parse_strict(spark, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return T.events(spark, d).select("event_id", S.parse_strict(text).alias("at"))


@query
def parse_stamps(spark, d):
    """Stamps of every shape that ``parse_strict`` knows."""
    forms = {"iso": "yyyy-MM-dd HH:mm:ss", "month_slash": "M/d/yyyy H:mm:ss", "day_slash": "d/M/yyyy H:mm:ss"}
    forms |= {"month_half": "M/d/yyyy h:mm:ss a", "month_dash": "M-d-yyyy H:mm:ss", "day_dash": "d-M-yyyy H:mm:ss"}
    read = [S.parse_strict(F.date_format("ts", form), shape).alias(shape) for shape, form in forms.items()]
    return T.events(spark, d).select("event_id", *read)


@query
def parse_utc(spark, d):
    """Stamps with an offset, in UTC, and without either, which is UTC too."""
    ends = [F.lit(e) for e in ("+02:00", "Z", "")]
    end = F.when(F.col("event_id") % 3 == 0, ends[0]).when(F.col("event_id") % 3 == 1, ends[1]).otherwise(ends[2])
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), end)
    return T.events(spark, d).select("event_id", S.parse_utc(text).alias("at"))


@query
def trunc_day(spark, d):
    return T.events(spark, d).select("event_id", S.trunc_day("ts").alias("day"))


@query
def iso_week_year(spark, d):
    year, week = S.iso_week_year("o_orderdate")
    return T.orders(spark, d).select("o_orderkey", year.alias("yr"), week.alias("wk"))


@query
def iso_week_year_strict(spark, d):
    year, week = S.iso_week_year("o_orderdate", iso_year=True)
    return T.orders(spark, d).select("o_orderkey", year.alias("yr"), week.alias("wk"))


@query
def month_weekday(spark, d):
    month, weekday = S.month_weekday("o_orderdate")
    return T.orders(spark, d).select("o_orderkey", month.alias("month"), weekday.alias("weekday"))


@query
def month_day_key(spark, d):
    return T.orders(spark, d).select("o_orderkey", S.month_day_key("o_orderdate").alias("md"))


@query
def date_plus(spark, d):
    return T.orders(spark, d).select("o_orderkey", S.date_plus(F.to_date("o_orderdate"), 7).alias("later"))


@query
def norm_name(spark, d):
    documents = spark.read.schema("doc_id long, text string").parquet(f"{d}/documents.parquet")
    return documents.select("doc_id", F.md5(S.norm_name("text")).alias("name_hash"))


@query
def fill_group_mean(spark, d):
    df = T.readings(spark, d)
    joined = J.join_group_mean(df, A.agg_week_mean(df, POLLUTANTS), ["site", "yr", "wk"], POLLUTANTS)
    return rounded(joined.select("event_id", *[S.fill_group_mean(p, f"{p}_media").alias(p) for p in POLLUTANTS]))


@query
def classify_nearest_query(spark, d):
    rows = T.cohorts(spark, d)
    return rows.select("reading_id", *[classify_nearest(p, p).alias(class_name(p)) for p in POLLUTANTS])


@query
def row_mean(spark, d):
    rows = T.cohorts(spark, d)
    classes = [classify_nearest(p, p).alias(class_name(p)) for p in POLLUTANTS]
    return rounded(rows.select("reading_id", *classes).select("reading_id", S.row_mean(*CLASS_COLUMNS).alias("class_mean")))


@query
def pct_change(spark, d):
    return rounded(X.site_variation(*both_cohorts(spark, d)))


@query
def cast_class(spark, d):
    return daily(spark, d).select(*SITE_DAY, S.cast_class("class_mean").alias("label"))


@query
def abs_sqrt(spark, d):
    size, root = S.abs_sqrt(F.col("o_totalprice") / F.lit(9973.0) - 20)
    return rounded(T.orders(spark, d).select("o_orderkey", size.alias("size"), root.alias("root")))


# Feature preparation and validation


@query
def impute_mean(spark, d):
    return rounded(Q.regression_frame(model(spark, d)).select(*SITE_DAY, *Q.lag_columns()))


@query
def impute_mean_strict(spark, d):
    frame = D.split_chrono(Q.with_advanced(model(spark, d)), ["site"], ["dt"])
    return rounded(W.impute_mean(frame, ["site"], Q.lag_columns(), "train").select(*SITE_DAY, "role", *Q.lag_columns()))


@query
def feature_set_base(spark, d):
    return rounded(model(spark, d).select(*SITE_DAY, *Q.feature_set_base()))


@query
def feature_set_adv(spark, d):
    return rounded(Q.with_advanced(model(spark, d)).select(*SITE_DAY, *ADV))


@query
def split_chrono(spark, d):
    return D.split_chrono(model(spark, d).select(*SITE_DAY), ["site"], ["dt"])


@query
def fold_contiguous(spark, d):
    return D.fold_contiguous(model(spark, d).select(*SITE_DAY), ["site"], ["dt"], 3)


@query
def fold_expanding(spark, d):
    return D.fold_expanding(model(spark, d).select(*SITE_DAY), ["site"], ["dt"], 5)


@query
def fold_skip_single_class(spark, d):
    folds = D.fold_expanding(model(spark, d).select(*SITE_DAY, "so2_cls"), ["site"], ["dt"], 5)
    return D.fold_skip_single_class(folds, "so2_cls")


def long_features(spark, d):
    """(site, dt, target, y, lag1, lag2, roll3) with one row per day and target."""
    frame = Q.with_advanced(model(spark, d))
    part = lambda t: F.struct(
        F.lit(t).alias("target"),
        F.col(t).alias("y"),
        *[F.col(f"{t}_{x}").alias(x) for x in ("lag1", "lag2", "roll3")],
    )
    return frame.select(*SITE_DAY, F.inline(F.array(*[part(t) for t in TARGETS])))


@query
def grid_search_query(spark, d):
    """Selection among three weightings of yesterday and the day before, by fold error."""
    rows = long_features(spark, d).where("lag2 is not null")
    rows = D.fold_expanding(rows, ["site", "target"], ["dt"], 3).where("role = 'test'")
    weights = [(0, "1.0", 1.0), (1, "0.7", 0.7), (2, "0.5", 0.5)]
    guesses = F.array(
        *[
            F.struct(
                F.lit(c).alias("candidate"),
                F.lit(name).alias("params"),
                (F.col("lag1") * w + F.col("lag2") * (1 - w)).alias("p"),
            )
            for c, name, w in weights
        ]
    )
    pred = rows.select("site", "target", "fold", "y", F.inline(guesses))
    keys = ["site", "target", "candidate", "params", "fold"]
    scores = M.m_mae(pred, keys).withColumnRenamed("value", "mae")
    return rounded(grid_search(scores, ["site", "target"]))


# Metrics, on the persistence forecast


def persistence(spark, d):
    return long_features(spark, d).where("lag1 is not null").select(*SITE_DAY, "target", "y", F.col("lag1").alias("p"))


def class_persistence(spark, d):
    """Yesterday's class as the guess, one row per day, target and expanding test fold."""
    frame = model(spark, d).select(*SITE_DAY, *CLASS_COLUMNS)
    lagged = W.lag_features(frame, ["site"], ["dt"], CLASS_COLUMNS, lags=(1,))
    part = lambda c: F.struct(F.lit(c).alias("target"), F.col(c).alias("y"), F.col(f"{c}_lag1").alias("p"))
    tests = D.fold_expanding(lagged, ["site"], ["dt"], 5).where("role = 'test'")
    return tests.select(*SITE_DAY, "fold", F.inline(F.array(*[part(c) for c in CLASS_COLUMNS]))).where("p is not null")


SCORED = ["site", "target"]


@query
def m_mae(spark, d):
    return rounded(M.m_mae(persistence(spark, d), SCORED))


@query
def m_rmse(spark, d):
    return rounded(M.m_rmse(persistence(spark, d), SCORED))


@query
def m_r2(spark, d):
    return rounded(M.m_r2(persistence(spark, d), SCORED))


@query
def m_accuracy(spark, d):
    return rounded(M.m_accuracy(class_persistence(spark, d), SCORED))


@query
def m_f1_weighted(spark, d):
    return rounded(M.m_f1_weighted(class_persistence(spark, d), SCORED))


@query
def m_fold_mean(spark, d):
    per_fold = M.m_accuracy(class_persistence(spark, d), [*SCORED, "fold"])
    return rounded(M.m_fold_mean(per_fold, SCORED))


# Models


@query
def cls_naive_bayes_query(spark, d):
    return cls_naive_bayes(Q.classification_frame(model(spark, d)), ADV, CLASS_COLUMNS)


@query
def cls_knn_query(spark, d):
    return cls_knn(Q.classification_frame(model(spark, d)), ADV, CLASS_COLUMNS)


@query
def knn_pairs(spark, d):
    """Pairs of a test day and an earlier day, and whether no more than these were compared."""
    work = knn_work(Q.classification_frame(model(spark, d)), ADV, CLASS_COLUMNS)
    return work.select("site", "n_pairs", (F.col("n_compared") <= F.col("n_pairs")).alias("bounded"))


def of_sites(spark, d, learner, by=("target",)):
    """Answers of one model for each site, target and fold, against the commonest class of its training days."""
    frame = materialise(Q.classification_frame(model(spark, d)), "frame")
    pred = cls_by_site(frame, ADV, CLASS_COLUMNS, learner)
    folds = D.fold_expanding(frame.select(*SITE_DAY, *CLASS_COLUMNS), ["site"], ["dt"], 5).where("role = 'train'")
    long = folds.unpivot(["site", "fold"], list(CLASS_COLUMNS), "target", "label")
    counts = long.groupBy("site", "fold", "target", "label").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("site", "fold", "target").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("usual"), F.collect_set("label").alias("classes"))
    right, usual = F.count_if(F.col("y") == F.col("p")), F.count_if(F.col("y") == F.col("usual"))
    return pred.join(seen, ["site", "fold", "target"]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("y").alias("sum_y"),
        usual.alias("n_usual"),
        F.count_if(~F.array_contains("classes", F.col("p"))).alias("n_foreign"),
        (right > usual).alias("beats_majority"),
    )


@query
def cls_logistic_sites(spark, d):
    return of_sites(spark, d, "LogisticRegression")


@query
def cls_tree_sites(spark, d):
    return of_sites(spark, d, "DecisionTree")


@query
def cls_svm_sites(spark, d):
    """All targets together, with standardised inputs: as they are, wind directions alone would decide."""
    return of_sites(spark, d, "ScaledSVM", [])


@query
def ar_tube(spark, d):
    """Support vector autoregression of every site: rows, and whether its error beyond the tube is below the mean's."""
    frame = materialise(model(spark, d).select(*SITE_DAY, "class_mean"), "frame")
    pred = ar_predict_tube(frame, ar_fit_tube(frame, ["site"], "class_mean"), ["site"], "class_mean")
    miss = lambda p: F.sum(F.greatest(F.abs(F.col("y") - p) - 0.1, F.lit(0.0)))
    mean = F.avg("y").over(Window.partitionBy("site"))  # at most a row for each day
    pred = pred.withColumn("mean", mean).groupBy("site").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("y").alias("sum_y"), (miss(F.col("p")) <= miss(F.col("mean")) + 1e-6).alias("no_worse")
    )
    return rounded(pred, 4)


@query
def forecast_tube_query(spark, d):
    """Days ahead of every site by its support vector autoregression: as many as asked, within the scale of classes."""
    frame = materialise(model(spark, d).select(*SITE_DAY, "class_mean"), "frame")
    ahead = forecast_tube(ar_fit_tube(frame, ["site"], "class_mean"), last_values(frame, ["site"], "class_mean"))
    return ahead.groupBy("site").agg(F.count(F.lit(1)).alias("n_days"), F.min("dt").alias("first"), F.max("dt").alias("last"), F.every(F.col("p").between(0.0, 6.0)).alias("on_scale"))


@query
def ar_gram_query(spark, d):
    gram = ar_gram(model(spark, d), ["site"], "class_mean")
    sums = gram.select("site", "n_rows", F.posexplode(F.concat("xx", "xy")).alias("cell", "value"))
    return rounded(sums)


@query
def ar_fit_query(spark, d):
    return rounded(ar_fit(model(spark, d), ["site"], "class_mean").select("site", "n_rows", F.posexplode("coefficients").alias("lag", "weight")))


@query
def forecast_recursive_query(spark, d):
    """Seven days ahead for every site with given weights."""
    last = last_values(model(spark, d), ["site"], "class_mean")
    given = last.select("site", F.array(*[F.lit(w) for w in GIVEN_WEIGHTS]).alias("coefficients"))
    return rounded(forecast_recursive(given, last))


@query
def forecast_fitted(spark, d):
    """Seven days ahead for every site with its own fitted weights."""
    frame = materialise(model(spark, d).select(*SITE_DAY, "class_mean"), "frame")
    return rounded(forecast_recursive(ar_fit(frame, ["site"], "class_mean"), last_values(frame, ["site"], "class_mean")))


@query
def forecast_status_query(spark, d):
    return forecast_status(last_values(model(spark, d), ["site"], "class_mean"))


@query
def ar_scores(spark, d):
    """In-sample error of the fitted autoregression."""
    frame = materialise(model(spark, d).select(*SITE_DAY, "class_mean"), "frame")
    pred = ar_predict(frame, ar_fit(frame, ["site"], "class_mean"), ["site"], "class_mean")
    parts = {"mae": M.m_mae, "rmse": M.m_rmse, "r2": M.m_r2}
    return rounded(union_all([f(pred, ["site"]).withColumn("metric", F.lit(n)) for n, f in parts.items()]))


def model_columns(frame):
    return frame.select(*SITE_DAY, *ADV, *TARGETS, *CLASS_COLUMNS)


def with_roles(frame):
    return materialise(D.split_chrono_dates(model_columns(frame), "dt"), "split", ["role"])


def hold_out(frame):
    split = with_roles(frame)
    return split.where("role = 'train'"), split.where("role = 'test'")


def judged(pred, train, targets, bounded):
    """Per target: test rows, their sum, rows without a prediction, and whether the fit holds.

    ``bounded`` learners only answer what they were trained on: classes they have
    seen, or means of values. Any regression has to beat the mean of the training rows.
    """
    part = lambda t: F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("v"))
    seen = train.select(F.inline(F.array(*[part(t) for t in targets]))).groupBy("target")
    seen = seen.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"))
    known = F.col("p").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9) if bounded else F.col("p").isNotNull()
    better = F.avg(F.abs(F.col("y") - F.col("p"))) < F.avg(F.abs(F.col("y") - F.col("mean")))
    rows = pred.join(F.broadcast(seen), "target").groupBy("target", "model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("y").cast("double").alias("sum_y"),
        F.count_if(F.col("p").isNull()).alias("n_unanswered"),
        F.coalesce(F.every(known), F.lit(False)).alias("in_range"),
        better.alias("beats_mean"),
    )
    return rounded(rows, 4)


def judged_classes(pred, train, targets):
    """Per target: test rows, their sum, those of the training rows' commonest class, and whether the fit beats that class.

    ``n_foreign`` counts answers that are null or no class of the training rows;
    ``beats_majority`` asks for more right answers than the commonest class would give.
    """
    part = lambda t: F.struct(F.lit(t).alias("target"), F.col(t).alias("v"))
    counts = train.select(F.inline(F.array(*[part(t) for t in targets]))).where("v is not null").groupBy("target", "v").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("target").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("usual"), F.collect_set("v").alias("classes"))
    right = F.count_if(F.col("y") == F.col("p"))
    usual = F.count_if(F.col("y") == F.col("usual"))
    return pred.join(F.broadcast(seen), "target").groupBy("target", "model").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum("y").cast("long").alias("sum_y"),
        usual.alias("n_usual"),
        F.count_if(~F.coalesce(F.array_contains("classes", F.col("p").cast("int")), F.lit(False))).alias("n_foreign"),
        (right > usual).alias("beats_majority"),
    )


def regress(spark, d, name, params, bounded=False):
    train, test = hold_out(Q.regression_frame(model(spark, d)))
    pred = fit_targets(fit_regressor, train, test, TARGETS, name, ADV, params)
    return judged(pred, train, TARGETS, bounded)


def classify(spark, d, name, params):
    train, test = hold_out(Q.classification_frame(model(spark, d)))
    pred = fit_targets(fit_classifier, train, test, CLASS_COLUMNS, name, ADV, params)
    return judged_classes(pred, train, CLASS_COLUMNS)


# With the learners' default parameters, for all targets.


@query
def reg_random_forest(spark, d):
    return regress(spark, d, "RandomForest", {}, True)


@query
def reg_boosted(spark, d):
    return regress(spark, d, "GradientBoosting", {})


@query
def reg_boosted_leaves(spark, d):
    """Best-first trees with 31 leaves, ten of them, for all targets at once."""
    train, test = hold_out(Q.regression_frame(model(spark, d)))
    pred = fit_boosted(train, ADV, TARGETS, n_estimators=10).predict(test, SITE_DAY)
    return judged(pred.withColumn("model", F.lit("BestFirst")), train, TARGETS, False)


@query
def reg_network(spark, d):
    """A network with one hidden layer of 64 for each target, trained in 300 common steps."""
    train, test = hold_out(Q.regression_frame(model(spark, d)))
    plans = [Plan(t, (64,), 0.0001) for t in range(len(TARGETS))]
    fitted = fit_networks(train, ADV, TARGETS, plans, [300])
    pred = fitted.predict(test, SITE_DAY, [(0, plan, 300) for plan in plans])
    return judged(pred.withColumn("model", F.lit("Network")), train, TARGETS, False)


@query
def cls_random_forest(spark, d):
    return classify(spark, d, "RandomForest", {})


@query
def cls_logistic(spark, d):
    return classify(spark, d, "LogisticRegression", {})


@query
def cls_svm(spark, d):
    return classify(spark, d, "SVM", {})


@query
def cls_boosted(spark, d):
    return classify(spark, d, "GradientBoosting", {})


@query
def cls_tree(spark, d):
    return classify(spark, d, "DecisionTree", {})


@query
def cls_mlp(spark, d):
    return classify(spark, d, "MLP", {})


@query
def grid_search_fitted(spark, d):
    """Search over the depths of the grid with expanding folds, refit and hold-out scores, for every target.

    Forests have 10 trees here; ``study.regression`` searches the whole grids by default.
    """
    split = with_roles(Q.regression_frame(model(spark, d)))
    grid = {"RandomForest": candidates({**GRIDS["RandomForest"], "n_estimators": [10]})}
    scores = regression_results(spark, *train_regressors(split, TARGETS, grid, ADV, expanding=True))
    listed = F.col("params").isin([json.dumps(p) for p in grid["RandomForest"]])
    return scores.select("target", "model", "status", listed.alias("from_grid"), (F.col("mae") > 0).alias("scored"), (F.col("r2") > 0).alias("beats_mean"))


@query
def results_table(spark, d):
    """Expanding-fold scores of naive Bayes and nearest neighbours for every pollutant's class."""
    frame = materialise(model_columns(Q.classification_frame(model(spark, d))), "frame")
    named = {"NaiveBayes": cls_naive_bayes, "KNN": cls_knn}
    answers = [f(frame, ADV, CLASS_COLUMNS).withColumn("model", F.lit(n)) for n, f in named.items()]
    return rounded(classification_results(spark, materialise(union_all(answers), "answers"), []))
