import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygrade.functions import scalars as S
from skygrade.functions.grading import class_cuts, classify_nearest, with_classes
from skygrade.schema import BANDS, POLLUTANTS


def apply(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn("v")).collect()]


def test_number_text(spark):
    texts = ["1d", "1f", "nan", " 3 ", "12,5", "", "-", "1e3", ".5", "5.", "inf", None]
    want = [None, None, None, 3.0, None, None, None, 1000.0, 0.5, 5.0, None, None]
    assert apply(spark, texts, S.to_number) == want


def test_day_first_dates(spark):
    texts = ["31/12/2025", "01/02/2025", "1/2/2025 13:45", "x", "2025-03-04", None]
    day = dt.date(2025, 2, 1)
    assert apply(spark, texts, S.parse_dayfirst) == [dt.date(2025, 12, 31), day, day, None, None, None]


def test_strict_timestamp_fails_on_bad_text(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply(spark, ["2023-01-01 10:00:00", "soon"], S.parse_strict)


@pytest.mark.parametrize("name", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_offset_timestamps_are_utc_days_in_any_zone(spark, zone, name):
    zone(name)
    texts = ["2025-01-01 00:00:00+00:00", "2025-01-01 00:30:00+01:00", "x"]
    days = apply(spark, texts, lambda c: S.trunc_day(S.parse_utc(c)))
    assert days == [dt.date(2025, 1, 1), dt.date(2024, 12, 31), None]


def test_year_turn_keeps_calendar_year(spark):
    days = [dt.date(2024, 12, 30), dt.date(2024, 1, 2)]
    plain = apply(spark, days, lambda c: F.struct(*S.iso_week_year(c)), "date")
    iso = apply(spark, days, lambda c: F.struct(*S.iso_week_year(c, iso_year=True)), "date")
    assert [tuple(r) for r in plain] == [(2024, 1), (2024, 1)]
    assert [tuple(r) for r in iso] == [(2025, 1), (2024, 1)]


def test_names(spark):
    raw = ["  VIANA do castelo ", "d'ávila", "a-b", "AÇORES", None]
    assert apply(spark, raw, S.norm_name) == ["Viana Do Castelo", "D'Ávila", "A-B", "Açores", None]


def test_band_cuts_pm10(spark):
    values = [19.0, 18.9, 20.0, 35.5, 59.25, 120.0, 363.0, -5.0, 5000.0, None]
    grades = apply(spark, values, lambda c: classify_nearest(c, "pm10"), "double")
    assert grades == [4, 5, 4, 3, 2, 2, 1, 5, 1, None]


@pytest.mark.parametrize("pollutant", POLLUTANTS)
def test_classes_are_nearest_centres_and_never_rise(spark, pollutant):
    values = sorted([i / 4 for i in range(-80, 5600)] + class_cuts(pollutant))
    grades = apply(spark, values, lambda c: classify_nearest(c, pollutant), "double")
    centres = [(a + b) / 2 for a, b in BANDS[pollutant]]
    want = [min((abs(v - c), i) for i, c in enumerate(centres, 1))[1] for v in values]
    assert grades == want
    assert grades == sorted(grades, reverse=True)


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1, None, 5, None, None), (None,) * 5], "a int, b int, c int, d int, e int")
    assert [r[0] for r in df.select(S.row_mean("a", "b", "c", "d", "e")).collect()] == [3.0, None]


def test_class_mean_is_mean_of_classes(spark):
    df = spark.createDataFrame([(500.5, None, None, 0.0, None)], "no2 double, o3 double, pm25 double, pm10 double, so2 double")
    row = with_classes(df).first()
    assert (row.no2_cls, row.o3_cls, row.pm10_cls, row.class_mean) == (1, None, 5, 3.0)


def test_zero_base_gives_null_change(spark):
    df = spark.createDataFrame([(0.0, 3.0), (2.0, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(S.pct_change("a", "b")).collect()] == [None, 50.0]
