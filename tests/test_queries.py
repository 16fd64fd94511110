"""Every query with SQL against an independent engine, and the plans behind them."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from skygrade.functions.grading import with_classes
from skygrade.models.autoregressive import forecast_recursive, last_values
from skygrade.plans import clean, features
from skygrade.registry.queries import GIVEN_WEIGHTS, QUERIES
from skygrade.sources import tables

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
#: Fits with default parameters take a minute and more; tests/check_all.py compares them with their SQL.
LONG_FITS = {
    "reg_random_forest",
    "reg_boosted",
    "reg_boosted_leaves",
    "reg_network",
    "cls_svm",
    "cls_boosted",
    "cls_mlp",
    "grid_search_fitted",
}


#: A dozen test days say nothing about a classifier, so these are compared at the next scale.
LARGER = "/root/testdata/sf0.01"
ON_MORE_ROWS = {"cls_logistic", "cls_tree", "cls_random_forest"}


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(ON_MORE_ROWS))
def test_classifier_equals_sql(spark, name):
    assert difference(QUERIES[name](spark, LARGER), duck(LARGER), SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG_FITS - ON_MORE_ROWS))
def test_query_equals_sql(spark, con, name):
    assert difference(QUERIES[name](spark, FOLDER), con, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL) and LONG_FITS <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() == 90


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_plans_have_no_python(spark):
    frame = clean.model_frame(clean.clean_daily(tables.readings(spark, FOLDER)), tables.weather(spark, FOLDER))
    last = last_values(frame, ["site"], "class_mean")
    given = last.selectExpr("site", f"array{tuple(GIVEN_WEIGHTS)} as coefficients")
    for df in (features.classification_frame(frame), with_classes(frame), forecast_recursive(given.selectExpr("site", "cast(coefficients as array<double>) coefficients"), last)):
        text = plan(df)
        assert "Python" not in text and "ArrowEval" not in text
        assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_site_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "readings")
    tables.readings(spark, FOLDER).write.parquet(path)
    daily = clean.clean_daily(spark.read.parquet(path)).where("site = 'D1'")
    assert "EqualTo(site,D1)" in plan(daily)
    listed = clean.clean_daily(spark.read.parquet(path), sites=["D1", "D2"])
    assert "In(site, [D1,D2])" in plan(listed)


def test_daily_table_reads_only_its_columns_and_shuffles_twice(spark):
    text = plan(clean.clean_daily(tables.readings(spark, FOLDER)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert text.count("Exchange hashpartitioning") == 2


def test_cohorts_and_their_weather_are_scanned_once(spark):
    hourly = clean.clean_hourly(tables.earlier_cohort(spark, FOLDER))
    joined = QUERIES["join_weather_left"](spark, FOLDER)
    assert "orders.parquet" not in plan(hourly)  # the sums are written by then
    assert "events.parquet" not in plan(joined)
    assert "orders.parquet" not in plan(QUERIES["agg_cohort_mean"](spark, FOLDER))


def test_result_does_not_depend_on_partitioning(spark):
    rows = lambda df: sorted((r.site, r.dt, round(r.class_mean, 9)) for r in df.collect())
    base = tables.readings(spark, FOLDER)
    assert rows(clean.clean_daily(base)) == rows(clean.clean_daily(base.repartition(7, "event_id")))
