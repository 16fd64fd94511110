"""Time-ordered hold-out and cross-validation folds, as rows.

Positions are taken per series at the daily grain (see ``series``). The forms that
end in ``_dates`` cut all series at the same days, as models over all series need.
"""

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrade.operators.series import series_window


def with_position(df: DataFrame, k, o) -> DataFrame:
    """``_rn`` from 0 by order and ``_n``, the length of the series."""
    rn = F.row_number().over(series_window(k, o)) - 1
    return df.withColumns({"_rn": rn, "_n": F.count(F.lit(1)).over(Window.partitionBy(*k))})


def split_chrono(df: DataFrame, k, o, test=0.2) -> DataFrame:
    """``role``: the last share of each series, rounded up, is test."""
    held = F.ceil(F.col("_n") * F.lit(float(test)))
    role = F.when(F.col("_rn") >= F.col("_n") - held, "test").otherwise("train")
    return with_position(df, k, o).withColumn("role", role).drop("_rn", "_n")


def fold_contiguous(df: DataFrame, k, o, n=3) -> DataFrame:
    """``fold`` 0..n-1 in runs; the first ones take the spare rows."""
    return df.withColumn("fold", F.ntile(n).over(series_window(k, o)) - 1)


def fold_expanding(df: DataFrame, k, o, n=5) -> DataFrame:
    """One row per (row, fold) it takes part in, with its role.

    Fold i tests one slice of ``rows div (n+1)`` and trains on all rows before it.
    """
    size = (F.col("_n") / F.lit(n + 1)).cast("long")
    folds = []
    for i in range(n):
        start = F.col("_n") - (n - i) * size
        role = F.when(F.col("_rn") < start, "train").when(F.col("_rn") < start + size, "test")
        folds.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    used = F.filter(F.array(*folds), lambda f: f["role"].isNotNull())
    return with_position(df, k, o).select(*df.columns, F.inline(used))


def with_test_fold(df: DataFrame, k, o, n=5) -> DataFrame:
    """Each row once, with the expanding ``fold`` that tests it (null for the head) and
    ``start``, the position where that test slice begins; ``_rn`` is kept."""
    size = (F.col("_n") / F.lit(n + 1)).cast("long")
    first = F.col("_n") - n * size
    fold = F.floor(F.try_divide(F.col("_rn") - first, size)).cast("int")
    placed = with_position(df, k, o).withColumn("fold", F.when(F.col("_rn") >= first, fold))
    return placed.withColumn("start", (first + F.col("fold") * size).cast("int")).drop("_n")


def fold_skip_single_class(folds: DataFrame, label, k=("site",)) -> DataFrame:
    """Rows of the folds whose training part has at least two classes.

    A fold has two classes if its lowest and highest training label differ; a
    window over (series, fold) finds that without reading the folds twice.
    """
    fold = Window.partitionBy(*k, "fold")
    seen = F.when(F.col("role") == "train", F.col(label))
    several = F.min(seen).over(fold) < F.max(seen).over(fold)
    return folds.withColumn("_several", several).where("_several").drop("_several")


def dates_of(df: DataFrame, o) -> list:
    """The distinct days of a table in order: as many as the calendar has, however many rows there are."""
    return [r[0] for r in df.where(F.col(o).isNotNull()).select(o).distinct().orderBy(o).collect()]


def split_chrono_dates(df: DataFrame, o, test=0.2) -> DataFrame:
    """``role``: rows of the last share of days, rounded up, are test, for all series alike."""
    days = dates_of(df, o)
    held = math.ceil(len(days) * test)
    first = F.lit(days[len(days) - held]) if held else F.lit(None)
    return df.withColumn("role", F.when(F.col(o) >= first, "test").otherwise("train"))


def fold_contiguous_dates(df: DataFrame, o, n=3) -> DataFrame:
    """``fold`` 0..n-1 in runs of days; the first ones take the spare days."""
    days = dates_of(df, o)
    sizes = [len(days) // n + (i < len(days) % n) for i in range(n)]
    ends = list(accumulate(sizes))
    fold = F.lit(n - 1)
    for i in range(n - 2, -1, -1):
        if sizes[i]:
            fold = F.when(F.col(o) <= F.lit(days[ends[i] - 1]), F.lit(i)).otherwise(fold)
    return df.withColumn("fold", fold)


def fold_expanding_dates(df: DataFrame, o, n=5) -> DataFrame:
    """One row per (row, fold) it takes part in, with its role.

    Fold i tests one slice of ``days div (n+1)`` and trains on all days before it.
    """
    days = dates_of(df, o)
    size = len(days) // (n + 1)
    if not size:
        return df.withColumns({"fold": F.lit(0), "role": F.lit("train")}).limit(0)
    folds = []
    for i in range(n):
        start = len(days) - (n - i) * size
        role = F.when(F.col(o) < F.lit(days[start]), "train").when(F.col(o) <= F.lit(days[start + size - 1]), "test")
        folds.append(F.struct(F.lit(i).alias("fold"), role.alias("role")))
    used = F.filter(F.array(*folds), lambda f: f["role"].isNotNull())
    return df.select(*df.columns, F.inline(used))
