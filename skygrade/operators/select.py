"""Projections, filters, ordering and set operations."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrade.operators.spread import lookup_join, number_rows


def project_rename(df: DataFrame, mapping) -> DataFrame:
    """The columns named in ``mapping``, under their new names."""
    return df.select([F.col(old).alias(new) for old, new in mapping.items()])


def project_dynamic(df: DataFrame, suffix=None, names=None) -> DataFrame:
    """Columns with a suffix and/or those of a list that are present."""
    wanted = set(names or ())
    keep = [c for c in df.columns if c in wanted or (suffix and c.endswith(suffix))]
    return df.select(keep)


def add_literal(df: DataFrame, name, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def filter_in_list(df: DataFrame, col, values) -> DataFrame:
    return df.where(F.col(col).isin(list(values)))


def filter_eq(df: DataFrame, col, value) -> DataFrame:
    return df.where(F.col(col) == value)


def drop_null_any(df: DataFrame) -> DataFrame:
    """Rows without a null in any column, columns unused later included."""
    return df.na.drop("any")


def drop_null_subset(df: DataFrame, cols) -> DataFrame:
    return df.na.drop("any", subset=list(cols))


def null_check(df: DataFrame) -> DataFrame:
    """(col, has_null) for every column, from one pass."""
    flags = df.agg(*[F.coalesce(F.max(F.col(c).isNull()), F.lit(False)).alias(c) for c in df.columns])
    return flags.unpivot([], df.columns, "col", "has_null")


def distinct_values(df: DataFrame, cols) -> DataFrame:
    return df.select(*cols).distinct()


def sort_series(df: DataFrame, k, o) -> DataFrame:
    return df.orderBy(*k, *o)


def head_n(df: DataFrame, o, n=5) -> DataFrame:
    return df.orderBy(*o).limit(n)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def rank_variation(wide: DataFrame, cols, key="site") -> DataFrame:
    """(col, key, change, rank): largest change first within each column, nulls last.

    There are only as many groups as columns, each holding every key, so the
    ranks are taken over balanced ranges and not in one task per group.
    """
    long = wide.unpivot([key], list(cols), "pollutant", "change")
    order = [F.col("change").desc_nulls_last(), F.col(key).asc()]
    return number_rows(long, ["pollutant"], order)


def tail_n(df: DataFrame, k, o, n) -> DataFrame:
    """Last ``n`` rows of each series; ``o`` must single out a row within it."""
    newest = Window.partitionBy(*k).orderBy(*[F.col(c).desc() for c in o])
    return df.withColumn("_age", F.row_number().over(newest)).where(F.col("_age") <= n).drop("_age")


def no_null_keys(df: DataFrame, keys) -> DataFrame:
    """Rows whose grouping keys are all known; others belong to no group."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))


def semi_month_day(a: DataFrame, b: DataFrame, date="dt") -> DataFrame:
    """Rows of ``a`` whose month and day occur in ``b``: at most 366 keys, hence broadcast."""
    keys = b.select(F.date_format(date, "MM-dd").alias("_md")).where("_md is not null").distinct()
    tagged = a.withColumn("_md", F.date_format(date, "MM-dd"))
    return tagged.join(F.broadcast(keys), "_md", "left_semi").drop("_md")


def semi_valid_site(weather: DataFrame, readings: DataFrame, key="site") -> DataFrame:
    """Weather rows of the sites that have readings."""
    sites = readings.select(key).where(F.col(key).isNotNull()).distinct()
    return lookup_join(weather, sites, [key], "left_semi")
