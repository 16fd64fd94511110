"""Autoregressive model of a daily value and its recursive forecast, all series at once."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.models.kernel import KernelMap, fit_flat, tube
from skygrade.operators.series import ar_lags, tail_n

# Cost of errors, errors that cost nothing, width of the kernel.
TUBE = {"cost": 10.0, "epsilon": 0.1, "gamma": 0.01}


def ar_gram(df: DataFrame, k, col, o=("dt",), n=7) -> DataFrame:
    """(series, n_rows, xx, xy): sums of products of (1, lag1..lagn) and with the value.

    ``xx`` is the symmetric matrix by rows. Each series becomes one short row,
    whatever its length.
    """
    rows = ar_lags(df.select(*k, *o, col), k, o, col, n)
    x = [F.lit(1.0), *[F.col(f"lag{i}") for i in range(1, n + 1)]]
    upper = {(i, j): F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(n + 1) for j in range(i, n + 1)}
    sums = rows.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *upper.values(),
        *[F.sum(x[i] * F.col(col)).alias(f"xy_{i}") for i in range(n + 1)],
    )
    cell = lambda i, j: F.col(f"xx_{min(i, j)}_{max(i, j)}")
    return sums.select(
        *k,
        "n_rows",
        F.array(*[cell(i, j) for i in range(n + 1) for j in range(n + 1)]).alias("xx"),
        F.array(*[F.col(f"xy_{i}") for i in range(n + 1)]).alias("xy"),
    )


def ridge_solver(ridge):
    """Vectorised function from (xx, xy) to the coefficients, the intercept unpenalised."""

    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        right = np.stack(xy.to_numpy()).astype(float)
        size = right.shape[1]
        penalty = ridge * np.eye(size)
        penalty[0, 0] = 0.0
        left = np.stack(xx.to_numpy()).astype(float).reshape(-1, size, size) + penalty
        return pd.Series(list(np.linalg.solve(left, right[:, :, None])[:, :, 0]))

    return F.pandas_udf(solve, "array<double>")


def ar_fit(df: DataFrame, k, col, o=("dt",), n=7, ridge=1e-3) -> DataFrame:
    """(series, coefficients, n_rows); coefficients are the intercept, then lag 1 to lag n."""
    gram = ar_gram(df, k, col, o, n)
    return gram.select(*k, ridge_solver(ridge)("xx", "xy").alias("coefficients"), "n_rows")


def ar_fit_tube(df: DataFrame, k, col, o=("dt",), n=7, cost=TUBE["cost"], epsilon=TUBE["epsilon"], gamma=TUBE["gamma"]) -> DataFrame:
    """(series, n_rows, landmarks, weights, intercept, n_inside, kernel_error): support vector regression on the lags.

    Errors up to ``epsilon`` cost nothing. Series are fitted side by side, each in
    a task of its own rows (one per day); the kernel enters through landmarks, so
    memory grows with the rows only. ``n_inside`` counts the rows within the tube.
    """
    lags = F.array(*[F.col(f"lag{i}").cast("double") for i in range(1, n + 1)]).alias("x")
    rows = ar_lags(df.select(*k, *o, col), k, o, col, n).select(*k, lags, F.col(col).cast("double").alias("y"))

    def fit(table):
        x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, n)
        y = table.column("y").to_numpy()
        order = np.lexsort([*x.T, y])  # rows of a group come in any order
        x, y = x[order], y[order]
        known = KernelMap(x, gamma)
        w, shift = fit_flat(known.rows, tube(y, epsilon), cost)
        inside = int((np.abs(y - known.rows @ w - shift) <= epsilon + 1e-4).sum())  # the solver leaves edges unsharp by 1e-5
        landmarks = pa.array([(known.landmarks + known.centre).tolist()], pa.list_(pa.list_(pa.float64())))
        weights = pa.array([known.weights(w).tolist()], pa.list_(pa.float64()))
        keys = [table.column(c).slice(0, 1) for c in k]
        values = [pa.array([len(y)], pa.int64()), landmarks, weights, pa.array([shift]), pa.array([inside], pa.int64()), pa.array([known.error])]
        return pa.Table.from_arrays([*keys, *values], names=[*k, *names])

    names = ["n_rows", "landmarks", "weights", "intercept", "n_inside", "kernel_error"]
    kinds = ["long", "array<array<double>>", "array<double>", "double", "long", "double"]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in k] + [f"{a} {b}" for a, b in zip(names, kinds)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *k).groupBy(*k).applyInArrow(fit, schema)


def radial_sum(model, values, gamma=TUBE["gamma"]):
    """Value of a row of ``ar_fit_tube`` at an array of lags, newest first."""
    gap = lambda landmark: F.aggregate(F.zip_with(landmark, values, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    parts = F.zip_with(F.col(f"{model}.landmarks"), F.col(f"{model}.weights"), lambda at, w: w * F.exp(-gamma * gap(at)))
    return F.aggregate(parts, F.col(f"{model}.intercept"), lambda a, b: a + b)


def ar_predict_tube(df: DataFrame, fitted: DataFrame, k, col, o=("dt",), n=7, gamma=TUBE["gamma"]) -> DataFrame:
    """(series, order, y, p) on the rows the model was fitted on."""
    model = fitted.select(*k, F.struct("landmarks", "weights", "intercept").alias("model"))
    rows = ar_lags(df.select(*k, *o, col), k, o, col, n).join(model, list(k))
    lags = F.array(*[F.col(f"lag{i}").cast("double") for i in range(1, n + 1)])
    return rows.select(*k, *o, F.col(col).alias("y"), radial_sum("model", lags, gamma).alias("p"))


def forecast_tube(fitted: DataFrame, last: DataFrame, k=("site",), o="dt", n=7, steps=7, gamma=TUBE["gamma"]) -> DataFrame:
    """(series, date, step, p) like ``forecast_recursive``, by the models of ``ar_fit_tube``."""
    model = fitted.select(*k, F.struct("landmarks", "weights", "intercept").alias("model"))
    known = last.where(F.size("history") == n).join(model, list(k))
    return ahead(known, lambda h: radial_sum("model", F.slice(h, 1, n), gamma), k, o, steps)


def linear(coefficients, values):
    """Intercept plus the products of the remaining coefficients with ``values``."""
    products = F.zip_with(F.slice(coefficients, 2, F.size(coefficients) - 1), values, lambda a, b: a * b)
    return F.aggregate(products, coefficients[0], lambda a, b: a + b)


def ar_predict(df: DataFrame, coefficients: DataFrame, k, col, o=("dt",), n=7) -> DataFrame:
    """(series, order, y, p) on the rows the model was fitted on."""
    rows = ar_lags(df.select(*k, *o, col), k, o, col, n).join(coefficients, list(k))
    lags = F.array(*[F.col(f"lag{i}") for i in range(1, n + 1)])
    return rows.select(*k, *o, F.col(col).alias("y"), linear(F.col("coefficients"), lags).alias("p"))


def last_values(df: DataFrame, k, col, o="dt", n=7) -> DataFrame:
    """(series, last date, history): the last ``n`` values, newest first."""
    last = tail_n(df.select(*k, o, col), k, [o], n)
    newest = F.sort_array(F.collect_list(F.struct(o, col)), asc=False)
    return last.groupBy(*k).agg(newest.alias("h")).select(*k, F.col("h")[0][o].alias(o), F.col(f"h.{col}").alias("history"))


def forecast_recursive(coefficients: DataFrame, last: DataFrame, k=("site",), o="dt", n=7, steps=7) -> DataFrame:
    """(series, date, step, p): every prediction becomes lag 1 of the next.

    Series with fewer than ``n`` values get no forecast; ``forecast_status`` lists them.
    """
    known = last.where(F.size("history") == n).join(coefficients.select(*k, "coefficients"), list(k))
    return ahead(known, lambda h: linear(F.col("coefficients"), F.slice(h, 1, n)), k, o, steps)


def ahead(known: DataFrame, following, k, o, steps) -> DataFrame:
    """(series, date, step, p): ``following`` gives the next value of a history, newest first."""
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.col("history").cast("array<double>"),
        lambda h, _: F.concat(F.array(following(h)), h),
    )
    steps_out = known.select(*k, F.col(o).alias("_last"), F.posexplode(F.reverse(F.slice(path, 1, steps))).alias("i", "p"))
    step = F.col("i") + 1
    return steps_out.select(*k, F.date_add("_last", step).alias(o), step.alias("step"), "p")


def forecast_status(last: DataFrame, k=("site",), n=7) -> DataFrame:
    return last.select(*k, F.when(F.size("history") == n, "ok").otherwise("short").alias("status"))
