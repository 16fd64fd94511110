"""Scores of predictions (columns ``y`` and ``p``) by any keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def m_mae(pred: DataFrame, k) -> DataFrame:
    return pred.groupBy(*k).agg(F.avg(F.abs(F.col("y") - F.col("p"))).alias("value"))


def m_rmse(pred: DataFrame, k) -> DataFrame:
    return pred.groupBy(*k).agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("p"), 2))).alias("value"))


def r2_column():
    """1 - residual / total; a constant actual scores 1 if met exactly, else 0."""
    residual = F.sum(F.when(F.col("y").isNotNull(), F.pow(F.col("y") - F.col("p"), 2)))
    total = F.var_pop("y") * F.count("y")
    constant = F.when(residual == 0, 1.0).otherwise(0.0)
    return F.when(total == 0, constant).otherwise(1 - F.try_divide(residual, total))


def m_r2(pred: DataFrame, k) -> DataFrame:
    return pred.groupBy(*k).agg(r2_column().alias("value"))


def m_accuracy(pred: DataFrame, k) -> DataFrame:
    return pred.groupBy(*k).agg(F.avg((F.col("y") == F.col("p")).cast("int")).alias("value"))


def confusion(pred: DataFrame, k) -> DataFrame:
    return pred.groupBy(*k, "y", "p").agg(F.count(F.lit(1)).alias("n"))


def m_f1_weighted(pred: DataFrame, k) -> DataFrame:
    """Per-class F1 weighted by the true count; a class that cannot be scored counts 0.

    Everything after the confusion counts works on at most 25 rows per key.
    """
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("pos"), F.lit(0).cast("long").alias("named")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("long").alias("pos"), F.col("n").alias("named")),
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)
    # The diagonal appears on both sides, so each side carries half of it.
    per_class = (
        confusion(pred, k)
        .select(*k, hit.alias("hit"), F.inline(sides))
        .groupBy(*k, "cls")
        .agg(F.sum("hit").alias("twice_tp"), F.sum("pos").alias("pos"), F.sum("named").alias("named"))
    )
    f1 = F.coalesce(F.try_divide(F.col("twice_tp"), F.col("pos") + F.col("named")), F.lit(0.0))
    return per_class.groupBy(*k).agg(F.try_divide(F.sum(f1 * F.col("pos")), F.sum("pos")).alias("value"))


def m_fold_mean(per_fold: DataFrame, k) -> DataFrame:
    """Unweighted mean over the folds that were scored."""
    return per_fold.groupBy(*k).agg(F.avg("value").alias("value"))
