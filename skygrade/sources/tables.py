"""Air-quality shaped views of the benchmark tables.

Factors and dividers only spread the values over the grading bands; dividers are
primes so that no mean lies on a rounding or grading boundary by accident.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrade.functions.scalars import iso_week_year

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ORDERS = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
USERS_PER_SITE = 5
CUSTOMERS_PER_SITE = 50
WEATHER_PER_SITE = 40
LATER_YEAR = 2001


def events(spark: SparkSession, folder) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{folder}/events.parquet")


def orders(spark: SparkSession, folder) -> DataFrame:
    return spark.read.schema(ORDERS).parquet(f"{folder}/orders.parquet")


def site_of(key, per_site):
    return F.concat(F.lit("D"), F.expr(f"{key} div {per_site}"))


def readings(spark: SparkSession, folder) -> DataFrame:
    """All events as station readings: one pollutant per row, the others null."""
    measured = lambda kind, divider: F.when(F.col("event_type") == kind, F.col("value") / F.lit(divider))
    year, week = iso_week_year("ts")
    return events(spark, folder).select(
        "event_id",
        site_of("user_id", USERS_PER_SITE).alias("site"),
        "ts",
        F.to_date("ts").alias("dt"),
        year.alias("yr"),
        week.alias("wk"),
        measured("click", 0.99991).alias("no2"),
        measured("view", 0.76913).alias("o3"),
        measured("purchase", 2.50007).alias("pm25"),
        measured("signup", 1.11119).alias("pm10"),
        measured("error", 0.50021).alias("so2"),
    )


def weather(spark: SparkSession, folder) -> DataFrame:
    """All orders as weather rows: several per site and day, rain unknown in some.

    There are more weather sites than sites with readings.
    """
    day = F.date_add(
        F.lit("2024-01-01").cast("date"),
        F.expr("cast(datediff(o_orderdate, date '1995-01-01') % 30 as int)"),
    )
    number = lambda sql: F.expr(f"cast({sql} as double)")
    return orders(spark, folder).select(
        F.col("o_orderkey").alias("weather_id"),
        site_of("o_custkey", WEATHER_PER_SITE).alias("site"),
        day.alias("dt"),
        (F.col("o_totalprice") / F.lit(9973.0)).alias("temperature_2m"),
        number("o_custkey % 100").alias("relative_humidity_2m"),
        F.expr("case when o_orderkey % 11 <> 0 then cast(o_orderkey % 10 as double) end").alias("rain"),
        number("o_custkey % 30").alias("wind_speed_80m"),
        number("o_orderkey % 12").alias("uv_index_max"),
        (F.col("o_totalprice") / F.lit(12007.0)).alias("temperature_80m"),
        number("o_orderkey % 360").alias("wind_direction_80m"),
        (F.col("o_totalprice") / F.lit(9973.0) + F.col("o_custkey") % 5).alias("temperature_2m_max"),
        (F.col("o_totalprice") / F.lit(9973.0) - F.col("o_orderkey") % 5).alias("temperature_2m_min"),
    )


def cohorts(spark: SparkSession, folder) -> DataFrame:
    """All orders as readings over several years; the last year ends in August. One in 97 has an outlying so2."""
    at = F.expr("timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate)")
    year, week = iso_week_year("o_orderdate")
    number = lambda sql, divider: F.expr(f"cast({sql} as double)") / F.lit(divider)
    return orders(spark, folder).select(
        F.col("o_orderkey").alias("reading_id"),
        site_of("o_custkey", CUSTOMERS_PER_SITE).alias("site"),
        at.alias("ts"),
        F.to_date("o_orderdate").alias("dt"),
        year.alias("yr"),
        week.alias("wk"),
        F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice") / F.lit(499.979)).alias("no2"),
        F.when(F.col("o_orderkey") % 7 != 3, number("o_orderkey % 250", 0.99991)).alias("o3"),
        number("o_custkey % 60", 0.99991).alias("pm25"),
        number("o_custkey % 120", 0.99991).alias("pm10"),
        number("o_orderkey % 400 + if(o_orderkey % 97 = 5, 9000, 0)", 0.99991).alias("so2"),
    )


def earlier_cohort(spark, folder):
    return cohorts(spark, folder).where(F.col("yr") < LATER_YEAR)


def later_cohort(spark, folder):
    return cohorts(spark, folder).where(F.col("yr") == LATER_YEAR)
