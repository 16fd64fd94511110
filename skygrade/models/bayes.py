"""Gaussian naive Bayes per series, target and fold, as grouped moments and a score."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.operators.folds import with_test_fold
from skygrade.session import materialise

# Fixed value: share of the largest variance added to every variance.
SMOOTHING = 1e-9


def as_vector(features):
    return F.array(*[F.col(f).cast("double") for f in features])


def moments(features):
    """Row count, and mean and variance of every feature."""
    parts = [F.struct(F.avg(f).alias("mean"), F.var_pop(f).alias("var")) for f in features]
    return F.struct(F.count(F.lit(1)).alias("n"), F.array(*parts).alias("stats")).alias("part")


def total_rows(parts):
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a + p["n"])


def merged(parts, width):
    """Moments of the union of disjoint parts, about the common mean."""
    n = total_rows(parts)
    add = lambda term: F.aggregate(parts, F.lit(0.0), lambda a, p: a + p["n"] * term(p))
    mean = lambda i: add(lambda p: p["stats"][i]["mean"]) / n

    def feature(i):
        centre = mean(i)
        spread = add(lambda p: p["stats"][i]["var"] + F.pow(p["stats"][i]["mean"] - centre, 2))
        return F.struct(centre.alias("mean"), (spread / n).alias("var"))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), feature)


def train_parts(by_slice: DataFrame, keys, n_folds) -> DataFrame:
    """Collect, for every fold, the parts of the slices before its test slice; at most ``n_folds``."""
    later = by_slice.where(F.col("slice") < n_folds).withColumn(
        "fold", F.explode(F.sequence(F.col("slice"), F.lit(n_folds - 1)))
    )
    return later.groupBy(*keys).agg(F.collect_list("part").alias("parts"))


def class_moments(rows: DataFrame, k, features, targets, n_folds) -> DataFrame:
    """Per (series, fold, target): the classes seen in training with row count, means and variances.

    Training parts overlap from fold to fold, so moments are taken once per slice
    and merged, instead of once per fold.
    """
    keys, width = [*k, "fold"], len(features)
    everything = train_parts(rows.groupBy(*k, "slice").agg(moments(features)), keys, n_folds)
    variances = F.transform(merged("parts", width), lambda s: s["var"])
    spread = everything.select(*keys, F.array_max(variances).alias("widest"))
    long = rows.unpivot([*k, "slice", *features], list(targets), "target", "label").where("label is not null")
    by_class = train_parts(
        long.groupBy(*k, "slice", "target", "label").agg(moments(features)), [*keys, "target", "label"], n_folds
    )
    widened = F.transform(
        merged("parts", width),
        lambda s: F.struct(s["mean"].alias("mean"), (s["var"] + SMOOTHING * F.col("widest")).alias("var")),
    )
    classes = (
        by_class.join(spread, keys)
        .select(*keys, "target", F.struct("label", total_rows("parts").alias("n"), widened.alias("stats")).alias("c"))
        .groupBy(*keys, "target")
        .agg(F.collect_list("c").alias("classes"))
    )
    return classes.where(F.size("classes") >= 2)


def log_likelihood(x, cls, rows):
    gap = lambda v, s: F.log(2 * math.pi * s["var"]) + F.pow(v - s["mean"], 2) / s["var"]
    total = F.aggregate(F.zip_with(x, cls["stats"], gap), F.lit(0.0), lambda a, b: a + b)
    return F.log(cls["n"] / rows) - total / 2


def cls_naive_bayes(frame: DataFrame, features, targets, k=("site",), o=("dt",), n_folds=5) -> DataFrame:
    """(series, order, target, fold, y, p) for the test rows of every fold with two or more classes.

    A series has at most five classes, so all parameters of one (series, fold)
    travel in one row and each test row meets exactly one of them.
    """
    rows = with_test_fold(frame.select(*k, *o, *features, *targets), k, o, n_folds)
    rows = materialise(rows.withColumn("slice", F.coalesce(F.col("fold") + 1, F.lit(0))), "rows")
    params = (
        class_moments(rows, k, features, targets, n_folds)
        .groupBy(*k, "fold")
        .agg(F.collect_list(F.struct("target", "classes")).alias("models"))
    )
    labels = F.create_map(*[part for t in targets for part in (F.lit(t), F.col(t))])
    tests = rows.where("fold is not null").select(
        *k, *o, "fold", as_vector(features).alias("x"), labels.alias("labels")
    )
    scored = tests.join(params, [*k, "fold"]).select(
        *k, *o, "fold", "x", "labels", F.inline("models")
    )
    rank = lambda c: F.struct(log_likelihood(F.col("x"), c, total_rows("classes")).alias("score"), (-c["label"]).alias("minus"))
    best = F.array_max(F.transform("classes", rank))
    return scored.select(
        *k, *o, "target", "fold", F.col("labels")[F.col("target")].alias("y"), (-best["minus"]).alias("p")
    )
