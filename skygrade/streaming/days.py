"""Daily means of readings that keep arriving.

The stream keeps, by site and day, the sums and counts from which ``daily_means``
follows. A day is closed and written once no reading for it is waited for any
longer; a reading that comes later than that is left out. Weekly fill and means are
taken from the written days whenever they are read, so a week's mean grows with it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skygrade.operators.aggregates import with_week
from skygrade.operators.select import no_null_keys
from skygrade.plans.clean import days_from_sums, value_sums

DELAY = "2 days"


def stream_readings(spark: SparkSession, path, schema, files_at_once=100) -> DataFrame:
    """Readings (site, ts, pollutants) of the Parquet files that come to lie in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def closing_sums(stream: DataFrame, delay=DELAY) -> DataFrame:
    """site, dt and sums of each day, given out once the latest reading is ``delay`` past its end."""
    timed = no_null_keys(stream, ["site", "ts"]).withColumn("ts", F.col("ts").cast("timestamp"))
    sums = timed.withWatermark("ts", delay).groupBy("site", F.window("ts", "1 day").alias("day")).agg(*value_sums())
    return sums.select("site", F.to_date("day.start").alias("dt"), *[c for c in sums.columns if c not in ("site", "day")])


def write_days(stream: DataFrame, path, checkpoint, delay=DELAY, **trigger) -> StreamingQuery:
    """Start writing closed days to ``path``; each day is written exactly once, also after a restart from ``checkpoint``."""
    writer = closing_sums(stream, delay).writeStream.outputMode("append").format("parquet").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def closed_days(spark: SparkSession, path, iso_year=False) -> DataFrame:
    """Weekly fill and mean per site and day over the days written so far, as ``daily_means`` gives them."""
    return days_from_sums(with_week(spark.read.parquet(path), "dt", iso_year))
