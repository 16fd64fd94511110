"""Days that close while readings arrive, and tables cut so that nothing has to move."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygrade.operators.joins import join_weather_inner
from skygrade.operators.series import lag_features
from skygrade.plans import clean
from skygrade.schema import POLLUTANTS
from skygrade.sources import tables
from skygrade.sources.sinks import sink_bucketed
from skygrade.streaming import days

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "site string, ts timestamp, " + ", ".join(f"{p} double" for p in POLLUTANTS)


def rows_of(df):
    return sorted((r.site, r.dt, *[None if r[p] is None else round(r[p], 9) for p in POLLUTANTS]) for r in df.collect())


def reading(site, at, value):
    return (site, at, value, None, None, None, None)


def replay(spark, folder, parts, delay="2 days"):
    """Each list of rows lands as a file, in turn; the days closed after all of them."""
    source, out, state = (str(folder / x) for x in ("in", "out", "state"))
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(source)
        stream = days.stream_readings(spark, source, part.schema, 1)
        days.write_days(stream, out, state, delay).awaitTermination(120)
    return days.closed_days(spark, out)


def test_replayed_files_give_the_batch_result(spark, tmp_path):
    # The weeks of a batch over closed days know only closed days.
    all_ = tables.readings(spark, FOLDER).select("site", F.col("ts").cast("timestamp").alias("ts"), *POLLUTANTS)
    last = all_.agg(F.max("ts")).first()[0]
    closed = (last - dt.timedelta(days=2)).date()
    third = all_.agg(*[F.expr(f"percentile_approx(ts, {q})") for q in (0.33, 0.66)]).first()
    parts = [all_.where(F.col("ts") < third[0]), all_.where(F.col("ts").between(*third)), all_.where(F.col("ts") > third[1])]
    got = rows_of(replay(spark, tmp_path, parts))
    batch = all_.withColumns({"dt": F.to_date("ts")}).where(F.col("dt") < F.lit(closed))
    assert got == rows_of(clean.daily_means(batch)) and len(got) > 10


def test_late_rows_are_left_out_and_a_restart_repeats_nothing(spark, tmp_path):
    day = lambda d, h=12: dt.datetime(2024, 1, d, h)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    parts = [
        frame([reading("A", day(1), 1.0), reading("A", day(2), 3.0)]),
        frame([reading("A", day(1), 5.0), reading("A", day(4), 7.0)]),  # the first day still waits
        frame([reading("A", day(9), 9.0)]),
        frame([reading("A", day(1), 100.0), reading("A", day(20), 1.0)]),  # too late
    ]
    got = {r.dt.day: r.no2 for r in replay(spark, tmp_path, parts).collect()}
    assert got == {1: 3.0, 2: 3.0, 4: 7.0, 9: 9.0}


@pytest.fixture
def cut_alike(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_joins_and_windows_of_bucketed_tables_move_no_rows(spark, cut_alike):
    daily = clean.clean_daily(tables.readings(spark, FOLDER))
    weather = clean.weather_daily(tables.weather(spark, FOLDER))
    try:
        left = sink_bucketed(daily, "daily_in_buckets", 4)
        right = sink_bucketed(weather, "weather_in_buckets", 4)
        joined = join_weather_inner(left, right)
        lagged = lag_features(left, ["site"], ["dt"], POLLUTANTS)
        for df in (joined, lagged, lag_features(joined, ["site"], ["dt"], POLLUTANTS)):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == join_weather_inner(daily, weather).count()
        bag = lambda df: sorted(map(str, df.select("site", "dt", "no2", "no2_lag1").collect()))
        assert bag(lagged) == bag(lag_features(daily, ["site"], ["dt"], POLLUTANTS))
    finally:
        for name in ("daily_in_buckets", "weather_in_buckets"):
            spark.sql(f"drop table if exists {name}")
