import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skygrade.operators.aggregates import agg_week_mean, group_mean
from skygrade.operators.joins import join_group_mean, join_weather_inner, join_weather_left
from skygrade.operators.select import drop_null_any, no_null_keys
from skygrade.plans.clean import clean_daily, clean_hourly, daily_means, hourly_means, model_frame, weather_daily
from skygrade.schema import POLLUTANTS
from skygrade.sources.readers import (
    MissingColumns,
    canonical_hourly,
    canonical_readings,
    canonical_weather,
    src_optional,
)

FIELDS = "site string, ts timestamp_ntz, dt date, yr int, wk int, no2 double, o3 double, pm25 double, pm10 double, so2 double"


def readings(spark, rows):
    """Rows of (site, timestamp, no2); the other pollutants are null."""
    full = []
    for site, ts, no2 in rows:
        week = ts and ts.isocalendar().week
        full.append((site, ts, ts and ts.date(), ts and ts.year, week, no2, None, None, None, None))
    return spark.createDataFrame(full, FIELDS)


def at(day, hour=0, month=3):
    return dt.datetime(2024, month, day, hour)


def by_day(df, col="no2"):
    return {r.dt.day: r[col] for r in df.collect()}


def test_unknown_keys_are_in_no_mean(spark):
    df = readings(spark, [("A", at(4), 1.0), (None, at(4), 50.0), ("A", None, 70.0)])
    assert [(r.site, r.no2) for r in daily_means(df).collect()] == [("A", 1.0)]
    assert [(r.site, r.no2) for r in agg_week_mean(df, ["no2"]).collect()] == [("A", 1.0)]


def test_fill_comes_before_the_mean(spark):
    df = readings(spark, [("A", at(4), 10.0), ("A", at(4, 1), None), ("A", at(5), 40.0)])
    assert by_day(daily_means(df)) == {4: 17.5, 5: 40.0}


def test_week_without_values_stays_null(spark):
    df = readings(spark, [("A", at(4), None), ("A", at(5), None), ("A", at(12), 3.0)])
    assert by_day(daily_means(df)) == {4: None, 5: None, 12: 3.0}


def test_last_days_of_december_fill_from_january(spark):
    df = readings(spark, [("A", dt.datetime(2024, 12, 30), None), ("A", dt.datetime(2024, 1, 2), 8.0)])
    assert {r.dt.month: r.no2 for r in daily_means(df).collect()} == {12: 8.0, 1: 8.0}
    assert {r.dt.month: r.no2 for r in daily_means(df, iso_year=True).collect()} == {12: None, 1: 8.0}


def test_grain_of_classes(spark):
    df = readings(spark, [("A", at(4, h), 0.0 if h < 12 else 400.0) for h in range(24)])
    assert by_day(clean_daily(df), "no2_cls") == {4: 3}
    hourly = clean_hourly(df)
    assert {r.no2_cls for r in hourly.collect()} == {5, 2}
    assert hourly.agg(F.avg("class_mean")).first()[0] == 3.5


def reference_means(rows, grain):
    """Row-by-row fill and mean, for comparison."""
    weeks, out = {}, {}
    for site, ts, v in rows:
        if v is not None:
            weeks.setdefault((site, ts.year, ts.isocalendar().week), []).append(v)
    for site, ts, v in rows:
        known = weeks.get((site, ts.year, ts.isocalendar().week))
        value = v if v is not None else (sum(known) / len(known) if known else None)
        out.setdefault((site, grain(ts)), []).append(value)
    mean = lambda vs: sum(vs) / len(vs) if None not in vs else None
    return {key: mean(vs) for key, vs in out.items()}


@pytest.mark.parametrize("max_bytes", [0, 1 << 24])
def test_means_from_sums_equal_row_by_row_fill_with_a_hot_site(spark, max_bytes):
    rng = random.Random(1)
    rows = []
    for _ in range(3000):
        site = "hot" if rng.random() < 0.4 else f"S{rng.randrange(8)}"
        value = None if rng.random() < 0.3 else rng.uniform(0, 500)
        rows.append((site, at(rng.randrange(1, 29), rng.randrange(24)), value))
    df = readings(spark, rows).repartition(8)
    daily = {(r.site, r.dt): r.no2 for r in daily_means(df).collect()}
    hourly = {(r.site, r.ts): r.no2 for r in hourly_means(df, max_bytes).collect()}
    for got, want in ((daily, reference_means(rows, lambda t: t.date())), (hourly, reference_means(rows, lambda t: t))):
        assert got.keys() == want.keys()
        assert all((got[k] is None and want[k] is None) or got[k] == pytest.approx(want[k]) for k in want)


def test_row_fill_join_is_whole_in_both_forms(spark):
    rows = [("hot" if i % 3 else f"S{i}", at(1 + i % 20), float(i) if i % 4 else None) for i in range(600)]
    df = readings(spark, rows).withColumn("id", F.monotonically_increasing_id())
    means = agg_week_mean(df, ["no2"])
    collected = [
        sorted((r.id, r.no2_media) for r in join_group_mean(df, means, ["site", "yr", "wk"], ["no2"], limit).collect())
        for limit in (0, 200_000)
    ]
    assert len(collected[0]) == 600
    assert [i for i, _ in collected[0]] == [i for i, _ in collected[1]]
    assert [v for _, v in collected[0]] == pytest.approx([v for _, v in collected[1]])


def weather(spark, rows):
    return spark.createDataFrame(rows, "site string, dt date, rain double, wind_direction_80m double, uv_index_max double")


def test_weather_fan_out_and_daily_mean(spark):
    days = spark.createDataFrame([("A", dt.date(2024, 3, 4), 5.0), ("B", dt.date(2024, 3, 4), 4.0)], "site string, dt date, class_mean double")
    w = weather(spark, [("A", dt.date(2024, 3, 4), 2.0, 350.0, 1.0), ("A", dt.date(2024, 3, 4), 4.0, 10.0, 1.0), ("A", dt.date(2024, 3, 4), 3.0, None, 1.0)])
    left = join_weather_left(days, w).collect()
    assert sorted(r.site for r in left) == ["A", "A", "A", "B"]
    assert [r.rain for r in left if r.site == "B"] == [None]
    joined = join_weather_inner(days, weather_daily(w)).collect()
    assert [(r.site, r.rain, r.wind_direction_80m) for r in joined] == [("A", 3.0, 180.0)]


def test_unused_null_weather_column_removes_the_row(spark):
    rows = [("A", at(d), 10.0) for d in (4, 5)]
    full = readings(spark, rows).withColumns({p: F.coalesce(p, F.lit(1.0)) for p in POLLUTANTS})
    w = weather(spark, [("A", dt.date(2024, 3, 4), 1.0, 1.0, None), ("A", dt.date(2024, 3, 5), 1.0, 1.0, 2.0)])
    assert by_day(model_frame(clean_daily(full), w), "rain") == {5: 1.0}
    assert drop_null_any(w).count() == 1


def test_nan_is_null(spark):
    raw = spark.createDataFrame([("A", "04/03/2024", v) for v in (1.0, float("nan"), None)], "Distrito string, Data string, NO2 double")
    raw = raw.withColumns({n: F.lit(None).cast("double") for n in ("O3", "PM2.5", "PM10", "SO2")})
    assert group_mean(canonical_readings(raw), ["site"], ["no2"]).first().no2 == 1.0


def test_sources_repair_headers_and_report_gaps(spark):
    raw = spark.createDataFrame([("A", "2023-05-01 10:00:00", "x", "5", "1d", None, "7", "8")], "` Distrito` string, `Data-Hora ` string, Local string, `NO2 ` string, O3 string, `PM2.5` string, PM10 string, SO2 string")
    row = canonical_hourly(raw).first()
    assert (row.site, row.dt, row.no2, row.o3, row.pm10) == ("A", dt.date(2023, 5, 1), 5.0, None, 7.0)
    with pytest.raises(MissingColumns):
        src_optional(lambda: canonical_hourly(raw.drop("SO2")), required=True)
    undated = spark.createDataFrame([("a", 1.0)], "distrito string, rain double")
    skipped = src_optional(lambda: canonical_weather(undated))
    assert (skipped.df, skipped.status, skipped.reason) == (None, "skipped", "weather: no column dt")


def test_no_null_keys(spark):
    df = spark.createDataFrame([("A", 1), (None, 1), ("B", None)], "a string, b int")
    assert no_null_keys(df, ["a", "b"]).count() == 1


def test_hourly_readings_at_the_daily_grain_and_by_iso_year(spark):
    rows = [("A", dt.datetime(2024, 12, 30, 5), 1.0), ("A", dt.datetime(2024, 12, 30, 9), 3.0), ("A", dt.datetime(2024, 1, 2, 5), 9.0)]
    table = spark.createDataFrame(rows, "site string, ts timestamp_ntz, no2 double").withColumn("dt", F.to_date("ts"))
    table = table.select("*", *[F.lit(1.0).alias(p) for p in POLLUTANTS if p != "no2"])
    days = {str(r.dt): r.no2 for r in clean_hourly(table, daily=True).collect()}
    assert days == {"2024-12-30": 2.0, "2024-01-02": 9.0}
    assert {r.yr for r in clean_hourly(table).collect()} == {2024}
    assert {r.yr for r in clean_hourly(table, iso_year=True).collect()} == {2024, 2025}
