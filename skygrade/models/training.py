"""Fitting, searching and scoring of pooled models, one per target.

The frames are at the daily grain. Folds are written out once, since every fit
reads them again; frames given as train and test should have been written out
with ``materialise`` too. The driver sees only scores and class lists, whose
number is fixed by the grids.
"""

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skygrade.models.estimators import CLASSIFIERS, RADIAL, REGRESSORS, TREES, inputs, named
from skygrade.models import linear, perceptron
from skygrade.models.trees import Boost, Forest, forests, named_class
from skygrade.operators.folds import fold_contiguous_dates, fold_expanding_dates
from skygrade.operators.metrics import m_accuracy, m_f1_weighted, m_mae, r2_column
from skygrade.operators.search import grid_search, results_table
from skygrade.session import materialise
from skygrade.sources.readers import reason_of

#: Classifiers that are linear over all sites in their inputs or a kernel map of them, and how many steps they may take.
LINEAR = {"LogisticRegression": (linear.Softmax, 500), "SVM": (linear.Hinge, 100)}

#: Trees of forests that grow together in a search; more targets than that allows go one after the other.
TREES_TOGETHER = 100

SCORE_FIELDS = "target string, model string, params string, candidate int, fold int, mae double"
FAILURE_FIELDS = "target string, model string, params string, status string"


def in_parallel(spark, jobs, workers):
    """Run independent jobs side by side; results keep the order of the jobs."""
    guarded = lambda job: inheritable_thread_target(spark)(job)()
    with ThreadPoolExecutor(workers) as pool:
        return list(pool.map(guarded, jobs))


def failure(error: Exception) -> str:
    """Type and first line of an error, as the status of a result."""
    name, reason = type(error).__name__, reason_of(error)
    return f"failed: {name}" if reason == name else f"failed: {name}: {reason}"


def union_all(frames):
    return reduce(DataFrame.unionByName, frames)


def predictions(df, target, model):
    return df.select(
        "site", "dt", F.lit(target).alias("target"), F.lit(model).alias("model"), F.col("label").alias("y"), "p"
    )


def fit_regressor(train, test, target, model, features, params, by_site=True) -> DataFrame:
    """(site, dt, target, model, y, p) for the test rows."""
    labelled = lambda df: df.where(F.col(target).isNotNull()).withColumn("label", F.col(target))
    learner = REGRESSORS[model](params, {})
    if isinstance(learner, Boost):
        return boost_targets(train, test, {target: None}, model, features, learner, by_site)
    if isinstance(learner, Forest):
        return predictions(learner.answers(labelled(train), labelled(test), features, "label", None, by_site), target, model)
    train = few_parts(labelled(train))
    flow = inputs(train, features, by_site)
    fitted = named(learner).fit(flow.transform(train))
    return predictions(fitted.transform(flow.transform(labelled(test))), target, model)


def few_parts(df, rows=100_000):
    """Partitions of at least so many rows: learners pass over their rows hundreds of times."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def fit_classifier(train, test, target, model, features, params, by_site=True):
    """The same with integer classes; None if the training rows show fewer than two.

    Classes are renumbered without gaps for the learner and back for the result.
    """
    train, test = (df.where(F.col(target).isNotNull()) for df in (train, test))
    rows, seen = train.agg(F.count(F.lit(1)), F.array_sort(F.collect_set(target))).first()
    if len(seen) < 2:
        return None
    if (model in LINEAR or model == "MLP") and by_site:
        return common_targets(train, test, {target: seen}, model, features, params)
    learner = CLASSIFIERS[model](params, {"rows": rows, "classes": len(seen)}) if model in TREES else None
    if isinstance(learner, Boost):
        return boost_targets(train, test, {target: seen}, model, features, learner, by_site)
    if isinstance(learner, Forest):
        answered = learner.answers(train, test.withColumn("label", F.col(target)), features, target, seen, by_site)
        return predictions(answered, target, model)
    train = few_parts(train)
    flow = inputs(train, features, by_site, model in RADIAL)
    width = lambda: flow.transform(train).select("features").first()[0].size
    info = {"rows": rows, "classes": len(seen), "width": width}
    classes = F.array(*[F.lit(c) for c in seen])
    numbered = train.withColumn("label", (F.array_position(classes, F.col(target)) - 1).cast("double"))
    fitted = named(CLASSIFIERS[model](params, info)).fit(flow.transform(numbered))
    answered = fitted.transform(flow.transform(test.withColumn("label", F.col(target))))
    return predictions(answered.withColumn("p", F.element_at(classes, F.col("p").cast("int") + 1)), target, model)


def common_targets(train, test, classes, model, features, params) -> DataFrame:
    """Predictions of linear or neural classifiers over all sites, all targets fitted in the same passes."""
    if model in LINEAR:
        kind, steps = LINEAR[model]
        found = linear.answers(train, test, features, classes, kind, params.get("max_iter", steps))
    else:
        found = perceptron.answers(train, test, features, classes, params.get("hidden_layer_sizes", (100,)), params.get("max_iter", 500))
    at, columns = 0, {}
    for t, seen in classes.items():
        columns[f"_p_{t}"] = named_class(seen, F.slice("_f", at + 1, len(seen)))
        at += len(seen)
    return of_targets(found.withColumns(columns), classes, model)


def of_targets(found, targets, model) -> DataFrame:
    """Predictions in rows, from a ``_p_`` column for each target."""
    part = lambda t: F.struct(F.lit(t).alias("target"), F.col(t).alias("y"), F.col(f"_p_{t}").alias("p"))
    long = found.select("site", "dt", F.inline(F.array(*[part(t) for t in targets]))).where("y is not null")
    return long.select("site", "dt", "target", F.lit(model).alias("model"), "y", "p")


def boost_targets(train, test, classes, model, features, learner, by_site=True) -> DataFrame:
    """Predictions of boosted trees, all targets grown in the same passes; ``classes`` maps them to classes or None."""
    return of_targets(learner.answers(train, test, features, classes, by_site), classes, model)


def seen_classes(train, targets) -> dict:
    """The classes of each target that shows at least two."""
    found = train.agg(*[F.array_sort(F.collect_set(t)).alias(t) for t in targets]).first()
    return {t: found[t] for t in targets if len(found[t]) > 1}


def fit_targets(fit, train, test, targets, model, features, params, workers=4) -> DataFrame:
    """Predictions of one model for several targets, fitted side by side; boosted trees, linear and neural classifiers go together."""
    if fit is fit_classifier and (model in LINEAR or model == "MLP"):
        return common_targets(train, test, seen_classes(train, targets), model, features, params)
    if model == "GradientBoosting":
        kind = REGRESSORS if fit is fit_regressor else CLASSIFIERS
        classes = dict.fromkeys(targets) if fit is fit_regressor else seen_classes(train, targets)
        return boost_targets(train, test, classes, model, features, kind[model](params, {}))
    jobs = [lambda t=t: fit(train, test, t, model, features, params) for t in targets]
    return union_all([pred for pred in in_parallel(train.sparkSession, jobs, workers) if pred is not None])


def validation_parts(train: DataFrame, expanding, n):
    """(train, validation) pairs cut inside the training rows, from folds written out once.

    A pooled model sees all sites, so folds are cut by date: no training row lies
    after a test row, whatever days a site begins and ends on.
    """
    if expanding:
        folds = materialise(fold_expanding_dates(train, "dt", n), "folds", ["fold", "role"])
        part = lambda i, role: folds.where((F.col("fold") == i) & (F.col("role") == role))
        return [(part(i, "train"), part(i, "test")) for i in range(n)]
    folds = materialise(fold_contiguous_dates(train, "dt", n), "folds", ["fold"])
    return [(folds.where(F.col("fold") != i), folds.where(F.col("fold") == i)) for i in range(n)]


def search_regressor(spark, parts, target, model, features, grid, workers=4, by_site=True):
    """Scores (target, model, params, candidate, fold, mae) of every candidate on every (train, validation) pair."""

    def job(number, params, fold, part):
        def run():
            pred = fit_regressor(*part, target, model, features, params, by_site)
            mae = m_mae(pred, ["target"]).first()
            return (target, model, json.dumps(params), number, fold, mae["value"] if mae else None)

        return run

    jobs = [job(c, params, i, part) for c, params in enumerate(grid) for i, part in enumerate(parts)]
    return spark.createDataFrame(in_parallel(spark, jobs, workers), SCORE_FIELDS)


def forest_answers(train, test, targets, learners, model, features, by_site=True) -> DataFrame:
    """(site, dt, target, model, candidate, y, p) for the test rows with a value: all targets and learners grow as one forest of each target."""
    some = F.coalesce(*[F.col(t).cast("double") for t in targets]).isNotNull()
    frames = []
    for single in (True, False):
        own = [(c, learner) for c, learner in enumerate(learners) if (learner.n_trees == 1) == single]
        if own:
            wanted = [(learner.n_trees, learner.max_depth) for _, learner in own]
            asked, summed = forests(train.where(some), test.where(some), features, targets, None, wanted, 1.0, own[0][1].seed, by_site)
            answer = lambda i, c, n: F.struct(F.lit(c).alias("candidate"), (F.col("_f")[i] / F.lit(float(n))).alias("p"))
            values = F.array(*[F.col(t).cast("double") for t in targets])
            part = asked.join(summed, "_id").select(
                "site", "dt", F.array(*map(F.lit, targets))[F.col("_target")].alias("target"), F.lit(model).alias("model"), values[F.col("_target")].alias("y"),
                F.inline(F.array(*[answer(i, c, n) for i, ((c, _), (n, _)) in enumerate(zip(own, wanted))])),
            )
            frames.append(part.where("y is not null"))
    return union_all(frames)


def search_forests(spark, parts, targets, model, features, grid, workers=4, by_site=True):
    """``search_regressor`` for forests of several targets: all candidates of a fold grow together."""
    learners = [REGRESSORS[model](params, {}) for params in grid]

    def job(fold, part):
        def run():
            pred = forest_answers(*part, targets, learners, model, features, by_site)
            return {(r["target"], r["candidate"], fold): r["value"] for r in m_mae(pred, ["target", "candidate"]).collect()}

        return run

    found = in_parallel(spark, [job(i, part) for i, part in enumerate(parts)], workers)
    rows = [
        (t, model, json.dumps(params), c, i, found[i].get((t, c, i)))
        for t in targets for c, params in enumerate(grid) for i in range(len(parts))
    ]
    return spark.createDataFrame(rows, SCORE_FIELDS)


def train_forests(train, test, parts, targets, model, features, grid, workers=4, by_site=True):
    """Search and refit of forests for several targets: (predictions, chosen parameters by (target, model), failures).

    If a target breaks the common search, each is searched alone, so that no other fails with it.
    """
    spark = train.sparkSession
    try:
        best = {r["target"]: r for r in grid_search(search_forests(spark, parts, targets, model, features, grid, workers, by_site)).collect()}
        if any(t not in best or best[t]["mean_mae"] is None for t in targets):
            raise ValueError("no candidate could be scored")
        used = sorted({r["candidate"] for r in best.values()})
        learners = [REGRESSORS[model](grid[c], {}) for c in used]
        own = reduce(Column.__or__, [(F.col("target") == t) & (F.col("candidate") == used.index(r["candidate"])) for t, r in best.items()])
        pred = forest_answers(train, test, targets, learners, model, features, by_site).where(own).drop("candidate")
        return [pred], {(t, model): r["params"] for t, r in best.items()}, []
    except Exception as error:
        if len(targets) == 1:
            return [], {}, [(targets[0], model, None, failure(error))]
    frames, chosen, failed = [], {}, []
    for t in targets:
        alone = train_forests(train, test, parts, [t], model, features, grid, workers, by_site)
        frames, chosen, failed = frames + alone[0], chosen | alone[1], failed + alone[2]
    return frames, chosen, failed


def are_forests(model, grid) -> bool:
    try:
        return all(isinstance(REGRESSORS[model](params, {}), Forest) for params in grid)
    except Exception:  # is told by the search of each target
        return False


def train_regressors(split, targets, grids, features, expanding, n=3, workers=4, by_site=True):
    """Search, refit on all training rows, predict the test rows.

    ``split`` has a ``role`` column and ``grids`` lists the candidates by model.
    Returns (predictions or None, chosen parameters by (target, model), failures).
    """
    train, test = split.where("role = 'train'").drop("role"), split.where("role = 'test'").drop("role")
    parts = validation_parts(train, expanding, n)
    frames, chosen, failed = [], {}, []
    together = [model for model, grid in grids.items() if grid and are_forests(model, grid)]
    for model in together:
        trees = max(REGRESSORS[model](params, {}).n_trees for params in grids[model])
        size = max(1, TREES_TOGETHER // trees)
        for at in range(0, len(targets), size):
            own = train_forests(train, test, parts, targets[at : at + size], model, features, grids[model], workers, by_site)
            frames, chosen, failed = frames + own[0], chosen | own[1], failed + own[2]
    for target in targets:
        for model, grid in grids.items():
            if model in together:
                continue
            try:
                scores = search_regressor(train.sparkSession, parts, target, model, features, grid, workers, by_site)
                best = grid_search(scores).first()
                if best["mean_mae"] is None:
                    raise ValueError("no candidate could be scored")
                frames.append(fit_regressor(train, test, target, model, features, json.loads(best["params"]), by_site))
                chosen[target, model] = best["params"]
            except Exception as error:
                failed.append((target, model, None, failure(error)))
    return (union_all(frames) if frames else None), chosen, failed


def regression_results(spark, pred, chosen, failed) -> DataFrame:
    """(target, model, params, mae, r2, status): one row per target and model, failures included."""
    params = spark.createDataFrame([(*key, p) for key, p in chosen.items()], "target string, model string, params string")
    failures = spark.createDataFrame(failed, FAILURE_FIELDS)
    mae = F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae")
    if pred is None:
        empty = params.withColumns({"mae": F.lit(None).cast("double"), "r2": F.lit(None).cast("double")})
        return results_table(empty.limit(0), failures)
    scored = pred.groupBy("target", "model").agg(mae, r2_column().alias("r2"))
    return results_table(F.broadcast(params).join(scored, ["target", "model"]), failures)


def cross_validate(frame, targets, models, features, n=5, workers=4, by_site=True):
    """Expanding-window predictions with a ``fold`` column, plus failed and skipped (target, model).

    A fold with a single class is left out. ``models`` maps a name to its parameters.
    """
    spark = frame.sparkSession
    folds = materialise(fold_expanding_dates(frame, "dt", n), "folds", ["fold", "role"])

    def job(target, model, params, i):
        def run():
            part = lambda role: folds.where((F.col("fold") == i) & (F.col("role") == role))
            try:
                pred = fit_classifier(part("train"), part("test"), target, model, features, params, by_site)
                return target, model, (None if pred is None else pred.withColumn("fold", F.lit(i))), None
            except Exception as error:
                return target, model, None, failure(error)

        return run

    jobs = [job(t, m, p, i) for t in targets for m, p in models.items() for i in range(n)]
    done = in_parallel(spark, jobs, workers)
    broken = {(t, m): error for t, m, _, error in done if error}
    frames = [pred for t, m, pred, _ in done if pred is not None and (t, m) not in broken]
    scored = {(t, m) for t, m, pred, _ in done if pred is not None}
    skipped = {(t, m): "skipped: one class" for t, m, _, _ in done if (t, m) not in scored and (t, m) not in broken}
    failures = [(t, m, None, status) for (t, m), status in {**broken, **skipped}.items()]
    return (union_all(frames) if frames else None), failures


def classification_results(spark, pred, failed) -> DataFrame:
    """(target, model, accuracy, f1, status): means over the kept folds; nulls where none was kept."""
    failures = spark.createDataFrame(failed, FAILURE_FIELDS).drop("params")
    if pred is None:
        return failures.select("target", "model", F.lit(None).cast("double").alias("accuracy"), F.lit(None).cast("double").alias("f1"), "status")
    by_fold = ["target", "model", "fold"]
    mean = lambda df, name: df.groupBy("target", "model").agg(F.avg("value").alias(name))
    scored = mean(m_accuracy(pred, by_fold), "accuracy").join(mean(m_f1_weighted(pred, by_fold), "f1"), ["target", "model"])
    return results_table(scored, failures)
