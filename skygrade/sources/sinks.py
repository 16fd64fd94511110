"""Writing of result tables."""

from pyspark.sql import DataFrame


def sink_table(df: DataFrame, path, partition_by=("yr",), mode="errorifexists") -> None:
    """Write a Parquet table split by ``partition_by``.

    Rows are brought together by those columns first, so each partition gets few
    files; adaptive execution splits a partition that holds too much for one task.
    """
    keys = list(partition_by)
    out = df.hint("rebalance", *keys) if keys else df
    out.write.mode(mode).partitionBy(*keys).parquet(path)


def sink_bucketed(df: DataFrame, name, buckets=200, keys=("site",), order=("dt",)) -> DataFrame:
    """Write a table cut by ``keys`` into sorted buckets, and give it back.

    Windows and aggregates by the keys, and joins with tables cut alike, need no
    shuffle. A join on more columns than the keys needs
    ``spark.sql.requireAllClusterKeysForCoPartition`` off for that. The rows are dealt
    to the buckets first, so each bucket is one file.
    """
    dealt = df.repartition(buckets, *keys)
    dealt.write.bucketBy(buckets, *keys).sortBy(*keys, *order).format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)
