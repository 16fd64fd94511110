"""Models over all sites: inputs of sites, folds by date, choice of candidates, absent and clashing columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygrade.models.estimators import inputs
from skygrade.models.training import cross_validate, validation_parts
from skygrade.operators.folds import fold_contiguous_dates, fold_expanding_dates, split_chrono_dates
from skygrade.operators.joins import join_weather_inner
from skygrade.operators.search import grid_search
from skygrade.plans import study
from skygrade.schema import DISTRICTS

START = dt.date(2025, 1, 1)


@pytest.mark.parametrize("sites", [list(DISTRICTS), [f"S{i}" for i in range(300)]])
def test_every_site_has_an_input_of_its_own(spark, sites):
    df = spark.createDataFrame([(s, 1.0) for s in sites], "site string, x double")
    rows = inputs(df, ["x"], True).transform(df).select("features").collect()
    assert len({tuple(r.features.indices) for r in rows}) == len(sites)
    fresh = spark.createDataFrame([("never seen", 1.0)], "site string, x double")
    assert inputs(df, ["x"], True).transform(fresh).first().features.size == rows[0].features.size


@pytest.fixture(scope="module")
def staggered(spark):
    """One site from January on, one from March on."""
    rows = [("A", START + dt.timedelta(i), float(i), i % 2) for i in range(120)]
    rows += [("B", START + dt.timedelta(60 + i), float(i), i % 3) for i in range(100)]
    return spark.createDataFrame(rows, "site string, dt date, x double, cls int")


def test_no_training_day_lies_after_a_test_day(staggered):
    split = split_chrono_dates(staggered, "dt").groupBy("role").agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.countDistinct("dt").alias("n"))
    by = {r.role: r for r in split.collect()}
    assert by["train"].hi < by["test"].lo and by["test"].n == 32 and by["train"].n == 128
    folds = fold_expanding_dates(staggered, "dt", 5).groupBy("fold", "role").agg(F.min("dt").alias("lo"), F.max("dt").alias("hi")).collect()
    ends = {(r.fold, r.role): (r.lo, r.hi) for r in folds}
    assert len(ends) == 10 and all(ends[i, "train"][1] < ends[i, "test"][0] for i in range(5))
    for train, test in validation_parts(staggered, True, 3):
        assert train.agg(F.max("dt")).first()[0] < test.agg(F.min("dt")).first()[0]


def test_contiguous_folds_cover_all_days_once(staggered):
    spans = fold_contiguous_dates(staggered, "dt", 3).groupBy("fold").agg(F.min("dt").alias("lo"), F.max("dt").alias("hi"), F.countDistinct("dt").alias("n")).orderBy("fold").collect()
    assert [r.n for r in spans] == [54, 53, 53] and spans[0].hi < spans[1].lo and spans[1].hi < spans[2].lo


def test_too_few_days_give_no_folds(spark, staggered):
    few = staggered.where("x < 3 and site = 'A'")
    assert fold_expanding_dates(few, "dt", 5).count() == 0
    assert cross_validate(few, ["cls"], {"DecisionTree": {}}, ["x"])[1] == [("cls", "DecisionTree", None, "skipped: one class")]
    assert split_chrono_dates(few.limit(0), "dt").count() == 0


def test_candidates_without_scores_stand_last(spark):
    rows = [("t", "m", "a", 0, 0, None), ("t", "m", "a", 0, 1, None), ("t", "m", "b", 1, 0, 3.0), ("t", "m", "b", 1, 1, 5.0), ("t", "m", "c", 2, 0, 1.0), ("t", "m", "c", 2, 1, None)]
    rows += [("u", "m", "a", 0, 0, None)]
    scores = spark.createDataFrame(rows, "target string, model string, params string, candidate int, fold int, mae double")
    best = {r.target: (r.params, r.mean_mae) for r in grid_search(scores).collect()}
    assert best == {"t": ("b", 4.0), "u": ("a", None)}


def test_equal_column_names_are_told_apart(spark):
    left = spark.createDataFrame([("A", START, 1.0)], "site string, dt date, no2 double")
    right = spark.createDataFrame([("A", START, 2.0, 3.0)], "site string, dt date, no2 double, rain double")
    joined = join_weather_inner(left, right)
    assert joined.columns == ["site", "dt", "no2", "no2_weather", "rain"] and joined.first()[2:] == (1.0, 2.0, 3.0)


def test_features_are_those_that_the_frame_has(spark):
    frame = spark.createDataFrame([(1.0, 2.0)], "rain double, no2 double")
    assert study.present(["rain", "wind_direction_80m"], frame) == ["rain"]
