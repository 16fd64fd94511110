"""CSV folders whose files differ in header, shape of dates and place."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from skygrade.functions import scalars as S
from skygrade.plans import study
from skygrade.schema import POLLUTANTS, READING_NAMES
from skygrade.sources import manifest as N
from skygrade.sources import readers as R

RAW = {name: raw for raw, name in READING_NAMES.items()}
COLUMNS = [RAW["site"], RAW["dt"], *[RAW[p] for p in POLLUTANTS]]
DAY = dt.date(2025, 3, 4)


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + "\n")


def reading(site, day):
    return [site, day, 1, 2, 3, 4, 5]


def jobs_of(spark, name, fn):
    """Result of ``fn`` and the number of jobs that it started."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        out = fn()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_each_file_keeps_its_own_shape_of_dates(spark, tmp_path):
    write(tmp_path / "a.csv", COLUMNS, [reading(f"A{i}", "4/3/2025") for i in range(20)] + [reading("odd", "2025-03-04")])
    write(tmp_path / "b.csv", COLUMNS[::-1], [reading(f"B{i}", "2025-03-04")[::-1] for i in range(10)])
    write(tmp_path / "c.csv", COLUMNS, [reading("C", "04-03-2025")])
    rows = R.src_readings(spark, str(tmp_path), "csv").collect()
    assert {r.site for r in rows if r.dt == DAY} == {*(f"A{i}" for i in range(20)), *(f"B{i}" for i in range(10)), "C"}
    assert [r.site for r in rows if r.dt is None] == ["odd"] and all(r.so2 == 5.0 and r.no2 == 1.0 for r in rows)
    lost = R.lost_dates(R.read_landed(spark, str(tmp_path), "csv")).collect()
    assert sorted((r._file[-5:], r.shape, r.n_texts, r.n_lost) for r in lost) == [
        ("a.csv", "slash", 21, 1), ("b.csv", "iso", 10, 0), ("c.csv", "dash", 1, 0),
    ]
    tables = study.load(spark, str(tmp_path), fmt="csv", sites=None)
    assert tables.reasons["readings"] == "1 of 32 dates not understood, in 1 files"
    assert tables.daily.count() == 31


def test_files_of_parquet_keep_their_shapes(spark, tmp_path):
    schema = ", ".join(f"`{c}` string" for c in COLUMNS)
    for n, day in ((20, "4/3/2025"), (10, "2025-03-04")):
        spark.createDataFrame([reading(f"S{n}", day) for _ in range(n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    assert R.src_readings(spark, str(tmp_path / "r")).where("dt = date '2025-03-04'").count() == 30


def test_a_thousand_files_take_three_jobs(spark, tmp_path):
    for i in range(1000):
        order = COLUMNS if i % 3 else COLUMNS[::-1]
        row = reading(f"S{i}", "4/3/2025")
        write(tmp_path / f"{i}.csv", order, [row if i % 3 else row[::-1]])

    def build():
        files = N.manifest(spark, str(tmp_path))
        return files.agg(F.collect_set("header"), F.count(F.lit(1))).first()

    (headers, n), jobs = jobs_of(spark, "heads of a thousand files", build)
    assert n == 1000 and sorted(map(tuple, headers)) == sorted([tuple(COLUMNS), tuple(COLUMNS[::-1])]) and jobs <= 3
    rows = R.src_readings(spark, str(tmp_path), "csv")
    assert rows.where("dt = date '2025-03-04' and no2 = 1 and so2 = 5").select("site").distinct().count() == 1000


def test_partition_columns_missing_columns_and_spellings(spark, tmp_path):
    write(tmp_path / "yr=2024" / "a.csv", ["a", "b"], [[1, 2]])
    write(tmp_path / "yr=2025" / "b.csv", [" B ", "c"], [[3, 4]])
    write(tmp_path / "yr=2025" / "empty.csv", ["a"], [])
    (tmp_path / "yr=2025" / "none.csv").write_text("")
    got = R.read_csv(spark, str(tmp_path))
    assert sorted(c.strip().lower() for c in got.columns) == ["a", "b", "c", "yr"]
    b = next(c for c in got.columns if c.strip().lower() == "b")
    assert sorted((r["a"], r[b], r["c"], r["yr"]) for r in got.fillna("").collect()) == [("", "3", "4", 2025), ("1", "2", "", 2024)]
    only = R.read_csv(spark, str(tmp_path / "yr=2024"))
    assert [tuple(r) for r in only.collect()] == [("1", "2")] and only.columns == ["a", "b"]


def test_odd_headers_are_named_as_spark_names_them(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿x,,X,y,y\n\n1,2,3,4,5\n".encode())
    mine, plain = R.read_csv(spark, str(tmp_path)), spark.read.option("header", True).csv(str(tmp_path))
    assert mine.columns == plain.columns and mine.collect() == plain.collect()
    (tmp_path / "a.csv").write_text('\n  \n"a, b","c ""d"""\n"1, 2",3\n')
    mine = R.read_csv(spark, str(tmp_path))
    assert mine.columns[0] == "a, b" and [tuple(r) for r in mine.collect()] == [("1, 2", "3")]


def test_heads_of_files_in_many_parts(spark, tmp_path):
    """Long files are cut into many tasks; only their first part has a head."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        for name in "ab":
            write(tmp_path / f"{name}.csv", COLUMNS, [reading(f"{name}{i}", "4/3/2025") for i in range(30_000)])
        write(tmp_path / "c.csv", COLUMNS, [reading("c", "2025-03-04")])
        heads = {r.file[-5:]: r for r in N.manifest(spark, str(tmp_path)).collect()}
        assert {k: len(r["head"]) for k, r in heads.items()} == {"a.csv": 100, "b.csv": 100, "c.csv": 1}
        assert heads["a.csv"]["head"][0][0] == "a0" and heads["b.csv"].header == COLUMNS
        rows = R.src_readings(spark, str(tmp_path), "csv")
        assert rows.where("dt = date '2025-03-04'").select("site").distinct().count() == 60_001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


STAMPS = [RAW["site"], RAW["ts"], *[RAW[p] for p in POLLUTANTS]]


@pytest.mark.parametrize(
    ("texts", "expected"),
    [
        (["1/2/2023 10:00", "1/13/2023 7:05"], [dt.datetime(2023, 1, 2, 10), dt.datetime(2023, 1, 13, 7, 5)]),
        (["1/2/2023 10:00", "13/1/2023 7:05:09"], [dt.datetime(2023, 2, 1, 10), dt.datetime(2023, 1, 13, 7, 5, 9)]),
        (["3-4-2023", "13-4-2023 1:00"], [dt.datetime(2023, 4, 3), dt.datetime(2023, 4, 13, 1)]),
        (["1/2/2023 1:00 PM", "1/2/2023 12:30:00 AM"], [dt.datetime(2023, 1, 2, 13), dt.datetime(2023, 1, 2, 0, 30)]),
        (["2023-01-02T10:00:00.250", "2023-03-26 01:30:00"], [dt.datetime(2023, 1, 2, 10, 0, 0, 250_000), dt.datetime(2023, 3, 26, 1, 30)]),
    ],
)
def test_stamps_of_every_shape(spark, zone, tmp_path, texts, expected):
    zone("Europe/Lisbon")  # an hour of 2023-03-26 does not exist there
    write(tmp_path / "a.csv", STAMPS, [reading(f"S{i}", t) for i, t in enumerate(texts)])
    write(tmp_path / "b.csv", STAMPS, [reading("other", "2023-05-06 07:00:00")])
    got = {r.site: r.ts for r in R.src_readings_hourly(spark, str(tmp_path), "csv").collect()}
    assert got == {"S0": expected[0], "S1": expected[1], "other": dt.datetime(2023, 5, 6, 7)}


def test_a_stamp_of_no_shape_drops_the_source(spark, tmp_path):
    write(tmp_path / "a.csv", STAMPS, [reading("S", "1/2/2023 10:00"), reading("S", "soon")])
    with pytest.raises(Exception, match="(?i)pars"):
        R.src_readings_hourly(spark, str(tmp_path), "csv").collect()
    write(tmp_path / "a.csv", STAMPS, [reading("S", "soon")])
    with pytest.raises(Exception, match="(?i)cast|malformed"):
        R.src_readings_hourly(spark, str(tmp_path), "csv").collect()


def test_undecided_shapes_accept_any(spark):
    df = spark.createDataFrame([("4/3/2025", ""), ("2025-03-04", ""), ("2025-03-04", "slash"), ("4/3/2025", "slash")], "c string, s string")
    got = [r[0] for r in df.select(S.in_shape("c", "s", S.DATE_SHAPES, S.parse_dayfirst)).collect()]
    assert got == [DAY, DAY, None, DAY]
