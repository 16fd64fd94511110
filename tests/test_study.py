"""Raw tables to results, as a user would run it."""

import pytest
from pyspark.sql import functions as F

from skygrade.plans import study
from skygrade.registry.queries import raw_hourly, raw_readings, raw_weather

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    raw_readings(spark, FOLDER).write.parquet(f"{root}/readings")
    raw_hourly(spark, FOLDER).write.parquet(f"{root}/hourly")
    raw_weather(spark, FOLDER).write.option("header", True).csv(f"{root}/weather")
    return study.load(spark, f"{root}/readings", f"{root}/hourly", f"{root}/weather", sites=None)


def test_tables(tables):
    assert tables.daily.count() == 90 and tables.reasons == {}
    assert tables.hourly.where("class_mean is null").count() == 0


def test_missing_optional_source_is_reported(spark, tmp_path):
    raw_readings(spark, FOLDER).write.parquet(str(tmp_path / "r"))
    got = study.load(spark, str(tmp_path / "r"), weather=str(tmp_path / "none"), sites=["D1"])
    assert got.weather is None and "PATH_NOT_FOUND" in got.reasons["weather"]
    assert got.daily.select("site").distinct().collect()[0].site == "D1"
    with pytest.raises(ValueError, match="no weather"):
        study.frame_for(got)


def test_bad_timestamp_drops_only_the_hourly_source(spark, tables, tmp_path):
    raw_readings(spark, FOLDER).write.parquet(str(tmp_path / "r"))
    bad = raw_hourly(spark, FOLDER).withColumn("Data-Hora ", F.lit("soon"))
    bad.write.parquet(str(tmp_path / "h"))
    got = study.load(spark, str(tmp_path / "r"), hourly=str(tmp_path / "h"), sites=None)
    assert got.hourly is None and "CAST_INVALID_INPUT" in got.reasons["hourly"]
    views = study.explore(got)
    assert views.day_boxes.count() == 5 and views.variation is None and views.weather_class is None


def test_exploration(tables):
    views = study.explore(tables)
    assert {r.cohort for r in views.class_means.collect()} == {"earlier", "later"}
    assert views.cohort_boxes.count() == 10
    assert views.variation.groupBy("pollutant").count().count() == 5
    assert views.weather_class.count() == 25 and views.weather_pollutants.count() == 25


def test_regression_of_one_site(tables):
    grid = {"RandomForest": [{"n_estimators": 3, "max_depth": 3}]}
    rows = study.regression(tables, site="D1", grids=grid, targets=["o3"]).collect()
    assert [(r.target, r.model, r.status) for r in rows] == [("o3", "RandomForest", "ok")]
    rows = study.regression(tables, advanced=True, grids=grid, targets=["o3"]).collect()
    assert rows[0].status == "ok" and rows[0].r2 <= 1


def test_classification(tables):
    result = study.classification(tables, models={"DecisionTree": {"max_depth": 3}}, targets=["pm10_cls"]).collect()
    assert {r.model for r in result} == {"NaiveBayes", "KNN", "DecisionTree"}
    assert all(r.status == "ok" and 0 <= r.f1 <= 1 for r in result)
    assert study.class_frequencies(tables).agg(F.sum("count")).first()[0] == 3 * study.frame_for(tables).count()


def test_forecast(tables):
    out = study.forecast(tables)
    assert out.ahead.count() == 3 * 7 and out.scores.count() == 9
    assert out.status.where("status = 'ok'").count() == 3
    assert out.recent.groupBy("site").count().agg(F.max("count")).first()[0] <= 30
    assert out.fitted.count() == study.frame_for(tables).count() - 3 * 7


def test_models_of_single_sites_and_the_tube(tables):
    result = study.classification(tables, models={}, targets=["pm10_cls"], apart=("DecisionTree",)).collect()
    assert {r.model for r in result} == {"NaiveBayes", "KNN", "DecisionTree"} and all(r.status == "ok" for r in result)
    out, ridge = study.forecast(tables, tube=True), study.forecast(tables)
    assert out.ahead.columns == ridge.ahead.columns and out.ahead.count() == ridge.ahead.count()
    assert out.fitted.count() == ridge.fitted.count() and {r.metric for r in out.scores.collect()} == {"mae", "rmse", "r2"}
