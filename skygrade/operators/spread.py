"""Joins and orderings that stay balanced when one key holds much of the data."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrade.session import fresh_path, materialise, stored_bytes

BROADCAST_BYTES = 16 << 20  # size of a written table that may be sent to every task
TASK_ROWS = 2_000_000  # rows of one key that a task may hold; beyond that the key is hot


def hot_keys(df: DataFrame, keys, task_rows=TASK_ROWS) -> DataFrame:
    """Keys with more than ``task_rows`` rows, and ``_cuts``, the tasks their rows are cut into.

    There are fewer of them than rows / task_rows, which is below the number of tasks.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > task_rows)
    return counts.select(*keys, F.ceil(F.col("_n") / F.lit(task_rows)).cast("int").alias("_cuts"))


def lookup_join(big, small, keys, how="inner", max_bytes=BROADCAST_BYTES, task_rows=TASK_ROWS):
    """Join ``big`` with a table that has at most one row per key.

    The small side is written out. Up to ``max_bytes`` on disk it is broadcast and
    ``big`` is not shuffled. Beyond that both sides are shuffled on the key; keys
    of ``big`` with more rows than a task should hold are cut into as many parts
    as they need, their single row of ``small`` being repeated for each. ``how``
    may be inner, left, left_semi or left_anti. Writing and counting run when the
    join is built, so ``explain()`` shows only what comes after.
    """
    path = fresh_path(big.sparkSession, "lookup")
    small.write.parquet(path)
    small = big.sparkSession.read.schema(small.schema).parquet(path)
    if stored_bytes(big.sparkSession, path) <= max_bytes:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, task_rows)


def salted_join(big, small, keys, how="inner", task_rows=TASK_ROWS):
    """The shuffled form of ``lookup_join``."""
    hot = materialise(hot_keys(big, keys, task_rows), "hot")  # its size is known, so Spark broadcasts it only if it is small
    # Row hash and task number: the hash splits rows that arrive in one task, the
    # number splits equal copies; both stay the same when a task is run again.
    spread = F.pmod(F.xxhash64(*big.columns) + F.spark_partition_id(), F.col("_cuts")).cast("int")
    left = big.join(hot, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0))).drop("_cuts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_cuts"), F.lit(1)) - 1)
    right = small.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_cuts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def ordered_blocks(df: DataFrame, by, order) -> DataFrame:
    """Sort ``df`` into balanced ranges of (by, order), numbered in ``_block``.

    Ranges are cut by size, not by key, so a group of any size is spread over as
    many blocks as it needs. The result is written out: block numbers must not
    change between the passes that use them. Order must single out a row.
    """
    ranged = df.repartitionByRange(*by, *order).withColumn("_block", F.spark_partition_id())
    return materialise(ranged, "blocks")


def block_offsets(blocks: DataFrame, by, weight=None) -> DataFrame:
    """Per (by, block): weight inside it, weight before it and weight of the whole group.

    There are at most (blocks + groups) rows, so the windows here are short.
    """
    amount = F.sum(weight) if weight is not None else F.count(F.lit(1))
    sizes = blocks.groupBy(*by, "_block").agg(amount.alias("_inside"))
    keys = list(by) or [F.lit(0)]
    group = Window.partitionBy(*keys)
    before = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumns(
        {
            "_before": F.coalesce(F.sum("_inside").over(before), F.lit(0)),
            "_total": F.sum("_inside").over(group),
        }
    )


def number_rows(df: DataFrame, by, order, name="rank") -> DataFrame:
    """Row number from 1 within ``by``, for groups too large for one task."""
    blocks = ordered_blocks(df, by, order)
    offsets = block_offsets(blocks, by).select(*by, "_block", "_before")
    inside = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order))
    numbered = lookup_join(blocks, offsets, [*by, "_block"])
    return numbered.withColumn(name, inside + F.col("_before")).drop("_block", "_before")
