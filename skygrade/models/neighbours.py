"""Nearest neighbours within a series, exact, without comparing all pairs.

Rows of a series meet in one task (a row per calendar day) and are cut into blocks
of rows that lie close to each other, each with the box that holds it. A block of
test rows looks at blocks of earlier rows from the nearest box on and stops where
a box is further away than the worst of the neighbours found so far.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.models.bayes import as_vector
from skygrade.operators.folds import with_test_fold

BLOCK_ROWS = 64


def close_blocks(x, rows, size):
    """``rows`` in blocks of at most ``size``, halved at the middle of their widest input."""
    todo, done = [rows], []
    while todo:
        part = todo.pop()
        if len(part) <= size:
            done.append(part)
            continue
        spread = np.ptp(x[part], axis=0)
        order = part[np.argsort(x[part, spread.argmax()], kind="stable")]
        todo += [order[: len(order) // 2], order[len(order) // 2 :]]
    return done


def nearest(x, asked, known, neighbours, size):
    """For each of ``asked`` its nearest of ``known`` as (gaps, rows), -1 where there are fewer, and the pairs compared.

    Rows are numbered in order; of equally near ones the earlier come first.
    """
    gaps = np.full((len(asked), neighbours), np.inf)
    found = np.full((len(asked), neighbours), -1)
    place = np.empty(len(x), int)
    place[asked] = np.arange(len(asked))
    blocks = close_blocks(x, known, size) if len(known) else []
    low = np.array([x[b].min(axis=0) for b in blocks]).reshape(len(blocks), -1)
    high = np.array([x[b].max(axis=0) for b in blocks]).reshape(len(blocks), -1)
    compared = 0
    for part in close_blocks(x, asked, size):
        q, at = x[part], place[part]
        apart = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0)
        least = (apart**2).sum(axis=1) * (1 - 1e-9)  # never above a gap, however both are rounded
        for b in np.argsort(least, kind="stable"):
            if least[b] > gaps[at, -1].max():
                break
            rows = blocks[b]
            compared += len(part) * len(rows)
            new = ((q[:, None, :] - x[rows][None, :, :]) ** 2).sum(axis=2)
            near = np.hstack([gaps[at], new])
            who = np.hstack([found[at], np.broadcast_to(rows, new.shape)])
            first = np.lexsort((who, near), axis=-1)[:, :neighbours]
            gaps[at], found[at] = np.take_along_axis(near, first, axis=1), np.take_along_axis(who, first, axis=1)
    return gaps, found, compared


def majority(votes):
    """Most frequent of each row's votes, the smaller one if equal; -1 stands for no vote."""
    classes = np.unique(votes[votes >= 0])
    counts = (votes[:, :, None] == classes).sum(axis=1)
    return classes[counts.argmax(axis=1)]


def searched(table, width, targets, neighbours, size):
    """Fold by fold: test rows, per target its labels and answers, and the pairs there are and those compared."""
    rn, fold = table.column("_rn").to_numpy(), table.column("fold").to_numpy(zero_copy_only=False)
    order = np.argsort(rn, kind="stable")
    rn, fold = rn[order], fold[order]
    start = table.column("start").to_numpy(zero_copy_only=False)[order]
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
    labels = {t: table.column(t).to_numpy(zero_copy_only=False)[order].astype(int) for t in targets}
    for i in np.unique(fold[~np.isnan(fold.astype(float))]):
        asked = np.flatnonzero(fold == i)
        known = np.flatnonzero(rn < start[asked[0]])
        _, found, compared = nearest(x, asked, known, neighbours, size)
        answers = {}
        for target, label in labels.items():
            if len(np.unique(label[known])) > 1:
                classes, number = np.unique(label, return_inverse=True)
                votes = np.where(found >= 0, number[found], -1)
                answers[target] = label[asked], classes[majority(votes)]
        yield int(i), order[asked], answers, len(asked) * len(known), compared


def by_series(frame, features, targets, k, o, n_folds, fn, schema) -> DataFrame:
    """``fn`` on the rows of each series, in as many tasks as the session shuffles into."""
    placed = with_test_fold(frame.select(*k, *o, *features, *targets), k, o, n_folds)
    rows = placed.select(*k, *o, "fold", "start", "_rn", as_vector(features).alias("x"), *targets)
    parts = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in (*k, *o) if c in schema[0])
    return rows.repartition(parts, *k).groupBy(*k).applyInArrow(fn, kinds + schema[1])


def cls_knn(
    frame: DataFrame, features, targets, k=("site",), o=("dt",), neighbours=5, n_folds=5, block_rows=BLOCK_ROWS
) -> DataFrame:
    """(series, order, target, fold, y, p) for the test rows of every fold with two or more classes.

    Euclidean distance on unscaled features; equal distances go to the earlier
    row, equal votes to the smaller class. The neighbours depend on the features
    only and are found once for all targets.
    """
    names = [*k, *o, "target", "fold", "y", "p"]

    def answer(table):
        given, parts = table.select([*k, *o]), []
        for fold, rows, answers, _, _ in searched(table, len(features), targets, neighbours, block_rows):
            for target, (y, p) in answers.items():
                ints = lambda v: pa.array(v, pa.int32())
                columns = [*given.take(pa.array(rows)).columns, pa.array([target] * len(y)), ints([fold] * len(y)), ints(y), ints(p)]
                parts.append(pa.Table.from_arrays(columns, names=names))
        none = [*given.slice(0, 0).columns, pa.array([], pa.string()), *[pa.array([], pa.int32())] * 3]
        return pa.concat_tables(parts) if parts else pa.Table.from_arrays(none, names=names)

    return by_series(frame, features, targets, k, o, n_folds, answer, ((*k, *o), "target string, fold int, y int, p int"))


def knn_work(
    frame: DataFrame, features, targets, k=("site",), o=("dt",), neighbours=5, n_folds=5, block_rows=BLOCK_ROWS
) -> DataFrame:
    """(series, n_pairs, n_compared): pairs of a test row and an earlier row, and those whose distance ``cls_knn`` computes."""

    def count(table):
        work = [(pairs, compared) for *_, pairs, compared in searched(table, len(features), targets, neighbours, block_rows)]
        pairs, compared = (sum(c) for c in zip(*work)) if work else (0, 0)
        keys = [table.column(c).slice(0, 1) for c in k]
        return pa.Table.from_arrays([*keys, pa.array([pairs]), pa.array([compared])], names=[*k, "n_pairs", "n_compared"])

    return by_series(frame, features, targets, k, o, n_folds, count, (k, "n_pairs long, n_compared long"))
