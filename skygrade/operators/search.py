"""Choice of parameters from cross-validation scores, and result tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_search(scores: DataFrame, k=("target", "model")) -> DataFrame:
    """Best candidate per key from (keys, candidate, params, fold, mae).

    The error is averaged over folds; of equal ones the lowest candidate number
    wins. A candidate with fewer scored folds stands behind all with more, so one
    that failed cannot win against one that did not; if all failed, ``mean_mae`` is null.
    """
    means = scores.groupBy(*k, "candidate", "params").agg(F.avg("mae").alias("mean_mae"), F.count("mae").alias("folds"))
    best = F.struct(-F.col("folds"), "mean_mae", "candidate", "params")
    return means.groupBy(*k).agg(F.min(best).alias("b")).select(*k, "b.params", "b.candidate", "b.mean_mae")


def results_table(scored: DataFrame, failures: DataFrame, k=("target", "model")) -> DataFrame:
    """Scores with status ``ok`` together with the failed and skipped ones, none left out."""
    return scored.withColumn("status", F.lit("ok")).unionByName(failures, allowMissingColumns=True)
