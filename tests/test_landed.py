"""Tables as they land: dates, stamps and headers of several shapes, and sources that fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygrade.functions import scalars as S
from skygrade.plans import study
from skygrade.schema import POLLUTANTS, READING_NAMES
from skygrade.sources import readers as R

RAW = {name: raw for raw, name in READING_NAMES.items()}
DAY = dt.date(2025, 3, 4)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


@pytest.mark.parametrize("values", [["4/3/2025", "2025-03-04"], ["04-03-2025", "2025-03-04"], ["2025-03-04", "2025-03-04 00:00:00", "4/3/2025"]])
def test_the_shape_of_most_values_is_the_column_s(spark, values):
    df = column(spark, [values[0], *values[:-1], values[-1]])
    days = [r[0] for r in df.select(S.parse_dayfirst("c", S.date_shape(df, "c"))).collect()]
    assert days == [DAY] * len(values) + [None]


def test_stamps_without_offset_are_utc_in_any_zone(spark, zone):
    zone("America/New_York")
    texts = column(spark, ["2025-01-01 22:00:00", "2025-01-01T22:00:00Z", "2025-01-01 22:00:00+02:00", "2025-01-01", "x", None])
    got = [r[0] for r in texts.select(S.as_utc(texts, "c")).collect()]
    late = dt.datetime(2025, 1, 1, 22)
    assert got == [late, late, late - dt.timedelta(hours=2), dt.datetime(2025, 1, 1), None, None]
    naive = texts.select(F.col("c").try_cast("timestamp_ntz").alias("c")).limit(1)
    assert naive.select(S.as_utc(naive, "c")).first()[0] == late


def readings(sites, day="2025-03-04"):
    return [(s, day, *[f"{i + 10 * j}.5" for j in range(len(POLLUTANTS))]) for i, s in enumerate(sites)]


def write_csv(folder, name, columns, rows, order):
    lines = [",".join(columns[i] for i in order), *[",".join(r[i] for i in order) for r in rows]]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_csv_columns_are_bound_by_the_header_of_their_file(spark, tmp_path):
    columns = [RAW["site"], RAW["dt"], *[RAW[p] for p in POLLUTANTS]]
    there = list(range(len(columns)))
    write_csv(tmp_path, "a.csv", columns, readings(["A"]), there)
    write_csv(tmp_path, "b.csv", columns, readings(["-", "B"])[1:], there[::-1])
    got = {r.site: r for r in R.src_readings(spark, str(tmp_path), "csv").collect()}
    for site in "AB":
        assert got[site].dt == DAY
        assert [got[site][p] for p in POLLUTANTS] == [(site == "B") + 10 * j + 0.5 for j in range(len(POLLUTANTS))]


def test_an_error_without_text_names_its_type():
    def loader():
        raise KeyError

    assert R.src_optional(loader).reason == "KeyError"


def test_a_load_that_loses_all_rows_raises(spark, tmp_path):
    columns = [RAW["site"], RAW["dt"], *[RAW[p] for p in POLLUTANTS]]
    spark.createDataFrame(readings(["Lisboa"], "March 4th"), ", ".join(f"`{c}` string" for c in columns)).write.parquet(str(tmp_path / "r"))
    with pytest.raises(ValueError, match="no row"):
        study.load(spark, str(tmp_path / "r"))
