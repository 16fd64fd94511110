import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygrade.operators import folds as D
from skygrade.operators import series as W
from skygrade.operators import stats as B
from skygrade.operators.aggregates import distinct_classes
from skygrade.operators.select import semi_month_day, union_by_name

K, O = ["site"], ["dt"]


def series(spark, values, days=None, kind="double"):
    days = days or range(1, len(values) + 1)
    return spark.createDataFrame(
        [("A", dt.date(2024, 1, 1) + dt.timedelta(days=d - 1), v) for d, v in zip(days, values)], f"site string, dt date, y {kind}"
    )


def column(df, c):
    return [r[c] for r in df.orderBy("dt").collect()]


def test_rolling_mean_needs_three_values(spark):
    df = W.roll3_mean(series(spark, [1.0, 2.0, 3.0, None, 5.0, 6.0, 7.0]), K, O, ["y"])
    assert column(df, "y_roll3") == [None, None, 2.0, None, None, None, 6.0]


def test_rolling_mean_of_earlier_rows_only(spark):
    df = W.roll3_mean(series(spark, [1.0, 2.0, 3.0, 4.0]), K, O, ["y"], include_current=False)
    assert column(df, "y_roll3") == [None, None, None, 2.0]


def test_lag_is_the_previous_row(spark):
    df = W.lag_features(series(spark, [1.0, 2.0, 3.0], [1, 2, 5]), K, O, ["y"])
    assert column(df, "y_lag1") == [None, 1.0, 2.0]


def test_rolling_mean_gives_the_target_away(spark):
    df = series(spark, [float((i * 37) % 11) for i in range(20)])
    df = W.roll3_mean(W.lag_features(df, K, O, ["y"]), K, O, ["y"]).where("y_roll3 is not null")
    gap = F.abs(3 * F.col("y_roll3") - F.col("y_lag1") - F.col("y_lag2") - F.col("y"))
    assert df.agg(F.max(gap)).first()[0] < 1e-9


def test_head_of_series(spark):
    df = W.roll3_mean(W.lag_features(series(spark, [1.0, 2.0, 3.0, 4.0]), K, O, ["y"]), K, O, ["y"])
    cols = ["y_lag1", "y_lag2", "y_roll3"]
    mean, back = W.impute_mean(df, K, cols), W.fill_forward_back(df, K, O, cols)
    assert [column(mean, c)[0] for c in cols] == [2.0, 1.5, 2.5]
    assert [column(back, c)[0] for c in cols] == [1.0, 1.0, 2.0]


def test_fill_goes_forward_first(spark):
    df = W.fill_forward_back(series(spark, [None, 2.0, None, 4.0, None]), K, O, ["y"])
    assert column(df, "y") == [2.0, 2.0, 2.0, 4.0, 4.0]


def test_imputer_scope(spark):
    df = series(spark, [1.0, 3.0, None, 8.0]).withColumn("role", F.when(F.dayofmonth("dt") <= 2, "train").otherwise("test"))
    assert column(W.impute_mean(df, K, ["y"]), "y")[2] == 4.0
    assert column(W.impute_mean(df, K, ["y"], "train"), "y")[2] == 2.0


def test_tail_and_autoregressive_lags(spark):
    df = series(spark, [float(i) for i in range(10)])
    assert sorted(r.y for r in W.tail_n(df, K, O, 3).collect()) == [7.0, 8.0, 9.0]
    lags = W.ar_lags(df, K, O, "y").orderBy("dt").collect()
    assert [(r.y, r.lag1, r.lag7) for r in lags] == [(7.0, 6.0, 0.0), (8.0, 7.0, 1.0), (9.0, 8.0, 2.0)]


@pytest.mark.parametrize("n,test", [(11, 3), (10, 2), (30, 6), (1, 1)])
def test_hold_out_is_the_last_fifth_rounded_up(spark, n, test):
    roles = column(D.split_chrono(series(spark, [0.0] * n), K, O), "role")
    assert roles == ["train"] * (n - test) + ["test"] * test


def test_contiguous_folds(spark):
    assert column(D.fold_contiguous(series(spark, [0.0] * 11), K, O, 3), "fold") == [0] * 4 + [1] * 4 + [2] * 3


def test_expanding_folds(spark):
    df = D.fold_expanding(series(spark, [float(i) for i in range(11)]), K, O, 3)
    rows = lambda fold, role: sorted(int(r.y) for r in df.where((F.col("fold") == fold) & (F.col("role") == role)).collect())
    assert [rows(i, "test") for i in range(3)] == [[5, 6], [7, 8], [9, 10]]
    assert [rows(i, "train") for i in range(3)] == [list(range(n)) for n in (5, 7, 9)]


def test_test_fold_agrees_with_expanding_folds(spark):
    df = series(spark, [float(i) for i in range(23)])
    want = {r.y: r.fold for r in D.fold_expanding(df, K, O, 5).where("role = 'test'").collect()}
    got = {r.y: r.fold for r in D.with_test_fold(df, K, O, 5).collect() if r.fold is not None}
    assert got == want
    assert D.with_test_fold(series(spark, [1.0, 2.0]), K, O, 5).where("fold is not null").count() == 0


def test_one_class_folds_are_left_out(spark):
    df = D.fold_expanding(series(spark, [5, 5, 5, 5, 4, 5], kind="int"), K, O, 2)
    assert {r.n_classes for r in distinct_classes(df.where("role = 'train'"), ["site", "fold"], "y").collect()} == {1}
    assert D.fold_skip_single_class(df, "y").count() == 0


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [r.r for r in B.corr_pairwise(df, ["a"], ["b"]).collect()] == [None]


def test_pairwise_and_complete_rows(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (2.0, 4.0, 1.0), (3.0, 5.0, 2.0), (4.0, 4.0, 9.0)], "a double, b double, c double")
    cell = lambda m: {(r.a, r.b): (r.r, r.n) for r in m.collect()}
    pandas = df.toPandas()
    pair, full = cell(B.corr_pairwise(df, ["a"], ["b"])), cell(B.corr_complete(df, ["a", "b", "c"]))
    assert pair["a", "b"] == (pytest.approx(pandas[["a", "b"]].corr().iloc[0, 1]), 4)
    assert full["a", "b"] == (pytest.approx(pandas.dropna()[["a", "b"]].corr().iloc[0, 1]), 3)


def test_cohorts_meet_on_month_and_day(spark):
    a = spark.createDataFrame([(dt.date(2023, 3, 4),), (dt.date(2023, 5, 6),), (dt.date(2023, 3, 4),)], "dt date")
    b = spark.createDataFrame([(dt.date(2025, 3, 4), 1)], "dt date, extra int")
    assert semi_month_day(a, b).count() == 2
    assert sorted(map(tuple, union_by_name(a, b).collect()))[-1] == (dt.date(2025, 3, 4), 1)
