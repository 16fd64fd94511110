"""Loading of raw tables and repair of their headers.

Workbooks have to be landed as Parquet or CSV first: their decoding runs on one
machine and is no Spark work. No reader infers types from the data.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skygrade.functions.scalars import (
    DATE_SHAPES,
    STAMP_SHAPES,
    as_utc,
    commonest_shape,
    in_shape,
    iso_week_year,
    no_nan,
    norm_name,
    parse_dayfirst,
    parse_strict,
    to_number,
    trunc_day,
    try_stamp,
)
from skygrade.schema import POLLUTANTS, READING_EXTRAS, READING_NAMES, WEATHER_NAMES
from skygrade.sources.manifest import FILE, bound_rows, manifest, shapes_in_heads, shapes_in_rows, with_shapes


class MissingColumns(ValueError):
    """A source lacks columns its dependants need."""


def schema_repair(df: DataFrame, rename=None, drop=(), trim=True) -> DataFrame:
    """Trim header names, drop columns if present, rename those that are known."""
    if trim:
        df = df.toDF(*[c.strip() for c in df.columns])
    return df.drop(*drop).withColumnsRenamed(rename or {})


def require_columns(df: DataFrame, names, source) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise MissingColumns(f"{source}: no column {', '.join(missing)}")
    return df


@dataclass(frozen=True)
class Landed:
    """Rows as they lie, each with the path of its file in FILE, and the heads of CSV files."""

    rows: DataFrame
    files: DataFrame | None = None


def read_landed(spark: SparkSession, path, fmt) -> Landed:
    """Raw table of a folder: CSV columns stay text, Parquet brings its own types."""
    if fmt == "csv":
        files = manifest(spark, path)
        return Landed(bound_rows(spark, path, files), files)
    if fmt == "parquet":
        return Landed(spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias(FILE)))
    raise ValueError(f"unknown format {fmt!r}")


def read_raw(spark: SparkSession, path, fmt) -> DataFrame:
    return read_landed(spark, path, fmt).rows.drop(FILE)


def read_csv(spark: SparkSession, path) -> DataFrame:
    """Text columns bound by the header of their own file: files of a folder may order them differently."""
    return read_raw(spark, path, "csv")


def raw_names(name) -> list[str]:
    """The headers that stand for a column, its own name among them."""
    return [name, *[raw for names in (READING_NAMES, WEATHER_NAMES) for raw, known in names.items() if known == name]]


def shaped(raw: DataFrame | Landed, name, shapes, parse, rename=READING_NAMES, drop=READING_EXTRAS) -> tuple[DataFrame, bool]:
    """The repaired table, and whether ``name`` is text there; if so, ``_shape`` is how its file writes it.

    The shape is that of the file's head (CSV) or of most of the file's values;
    a frame that is not read from files counts as one file. It is empty where
    nothing has any of the shapes.
    """
    landed = raw if isinstance(raw, Landed) else Landed(raw)
    df = schema_repair(landed.rows, rename, drop)
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.StringType):
        return df, False
    if landed.files is not None:
        return with_shapes(df, shapes_in_heads(landed.files, raw_names(name), shapes, parse)), True
    if FILE in df.columns:
        return with_shapes(df, shapes_in_rows(df, name, shapes, parse)), True
    return df.withColumn("_shape", F.lit(commonest_shape(df, name, shapes, parse))), True


def as_number(df: DataFrame, name):
    """Text is parsed, a numeric column only loses its NaN."""
    return to_number(name) if isinstance(df.schema[name].dataType, T.StringType) else no_nan(name)


def canonical_readings(raw: DataFrame | Landed) -> DataFrame:
    """Daily-dated readings: site, dt, yr, wk and the five pollutants.

    Date text has the shape of its file; values of other shapes are null.
    """
    df, text = shaped(raw, "dt", DATE_SHAPES, parse_dayfirst)
    require_columns(df, ("site", "dt", *POLLUTANTS), "readings")
    day = in_shape("dt", "_shape", DATE_SHAPES, parse_dayfirst) if text else trunc_day("dt")
    year, week = iso_week_year("dt")
    df = df.select("site", day.alias("dt"), *[as_number(df, p).alias(p) for p in POLLUTANTS])
    return df.select("site", "dt", year.alias("yr"), week.alias("wk"), *POLLUTANTS)


def canonical_hourly(raw: DataFrame | Landed) -> DataFrame:
    """Timestamped readings: site, ts, dt, yr, wk and the five pollutants.

    Stamps have the shape of their file; a text that has not fails the job.
    """
    df, text = shaped(raw, "ts", STAMP_SHAPES, try_stamp)
    require_columns(df, ("site", "ts", *POLLUTANTS), "readings")
    year, week = iso_week_year("ts")
    stamp = in_shape("ts", "_shape", STAMP_SHAPES, parse_strict, parse_strict) if text else parse_strict("ts")
    df = df.select("site", stamp.alias("ts"), *[as_number(df, p).alias(p) for p in POLLUTANTS])
    return df.select("site", "ts", trunc_day("ts").alias("dt"), year.alias("yr"), week.alias("wk"), *POLLUTANTS)


def canonical_weather(raw: DataFrame | Landed) -> DataFrame:
    """Weather by site and UTC day; every other column is a number."""
    rows = raw.rows.drop(FILE) if isinstance(raw, Landed) else raw
    df = require_columns(schema_repair(rows, WEATHER_NAMES), ("site", "dt"), "weather")
    rest = [c for c in df.columns if c not in ("site", "dt")]
    return df.select(
        norm_name("site").alias("site"),
        trunc_day(as_utc(df, "dt")).alias("dt"),
        *[as_number(df, c).alias(c) for c in rest],
    )


def src_readings(spark: SparkSession, path, fmt="parquet") -> DataFrame:
    return canonical_readings(read_landed(spark, path, fmt))


def src_readings_hourly(spark: SparkSession, path, fmt="parquet") -> DataFrame:
    return canonical_hourly(read_landed(spark, path, fmt))


def src_weather(spark: SparkSession, path, fmt="csv") -> DataFrame:
    return canonical_weather(read_landed(spark, path, fmt))


def lost_dates(raw: DataFrame | Landed, name="dt") -> DataFrame:
    """Per file and shape: n_texts, the texts of its date column, and n_lost, those that are no date in that shape.

    Reads that column alone. Dates that do not lie as text cannot be lost, so there are no rows then.
    """
    df, text = shaped(raw, name, DATE_SHAPES, parse_dayfirst)
    if not text:
        return df.sparkSession.createDataFrame([], f"{FILE} string, shape string, n_texts long, n_lost long")
    file = F.col(FILE) if FILE in df.columns else F.lit(None).cast("string").alias(FILE)
    known = F.count(in_shape(name, "_shape", DATE_SHAPES, parse_dayfirst))
    counts = df.select(file, "_shape", name).groupBy(FILE, F.col("_shape").alias("shape"))
    return counts.agg(F.count(name).alias("n_texts"), (F.count(name) - known).alias("n_lost"))


@dataclass(frozen=True)
class Source:
    """A loaded table, or the reason why there is none."""

    df: DataFrame | None
    reason: str | None = None

    @property
    def status(self):
        return "loaded" if self.df is not None else "skipped"


def reason_of(error: Exception) -> str:
    """First line of an error's message, or its type where it has none."""
    return next(iter(str(error).strip().splitlines()), type(error).__name__)


def src_optional(loader, required=False) -> Source:
    """Run a loader. A required source that fails raises, an optional one is skipped with a reason.

    Whatever stops an optional source, the others go on; a loader that reads
    lazily is only checked for its path and columns.
    """
    try:
        return Source(loader())
    except Exception as error:
        if required:
            raise
        return Source(None, reason_of(error))


__all__ = [
    "MissingColumns",
    "Source",
    "canonical_hourly",
    "canonical_readings",
    "canonical_weather",
    "lost_dates",
    "schema_repair",
    "src_optional",
    "src_readings",
    "src_readings_hourly",
    "src_weather",
]
