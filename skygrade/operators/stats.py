"""Box statistics and Pearson correlations."""

from itertools import combinations_with_replacement, product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skygrade.operators.spread import block_offsets, lookup_join, ordered_blocks
from skygrade.session import materialise

# Quartiles, and the whisker reach in interquartile ranges.
QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
WHISKER_REACH = 1.5

# Size of the quantile sketch. Its rank error is about 2.3 / size ** 0.9; a range that should miss is widened later.
SKETCH_SIZE = 32_768
SKETCH_MARGIN = 3 * 2.3 / SKETCH_SIZE**0.9
SKETCH_FAN = 64  # sketches of a key that one task merges


def pearson(x, y):
    """Correlation over the rows where both are present; null if either is constant."""
    sx = F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x)))
    sy = F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y)))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def correlate(df: DataFrame, pairs) -> DataFrame:
    """(a, b, r, n) for the given column pairs.

    Each row is spread over its pairs and combined map-side into one line per
    pair, so only a line per pair and task is shuffled. Four aggregates by key
    compile far faster than four for every pair.
    """
    cell = lambda a, b: F.struct(
        F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")
    )
    both = F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1))
    long = df.select(F.inline(F.array(*[cell(a, b) for a, b in pairs])))
    return long.groupBy("a", "b").agg(pearson("x", "y").alias("r"), both.alias("n"))


def mirrored(half: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix, given one with its diagonal."""
    cells = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return half.select(F.inline(F.array_distinct(cells)), "r", "n")


def corr_complete(df: DataFrame, cols) -> DataFrame:
    """Square matrix over the rows where every column is present."""
    half = correlate(df.select(*cols).na.drop(), list(combinations_with_replacement(cols, 2)))
    return mirrored(half)


def corr_pairwise(df: DataFrame, left, right) -> DataFrame:
    """Rectangular block, each cell over the rows where its two columns are present."""
    return correlate(df.select(*left, *right), list(product(left, right)))


def key_moments(rows: DataFrame, k, cols, pairs) -> DataFrame:
    """Per key: count, mean, spread and extremes of each column, co-spread of each pair."""
    return rows.groupBy(*k).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[
            F.struct(
                F.count(c).alias("n"),
                F.avg(c).alias("mean"),
                (F.var_pop(c) * F.count(c)).alias("spread"),
                F.min(c).alias("lo"),
                F.max(c).alias("hi"),
            ).alias(c)
            for c in cols
        ],
        *[(F.covar_pop(a, b) * F.count(F.lit(1))).alias(f"{a}*{b}") for a, b in pairs],
    )


def corr_fan_out(one: DataFrame, many: DataFrame, k, pairs) -> DataFrame:
    """(a, b, r, n) over the join of ``one`` (a row per key) with ``many`` (any number per key).

    Columns of ``many`` enter as their moments per key, so its rows are combined
    map-side and never joined, and a key with very many rows is one row like any
    other. Moments are taken about the common means, in a second pass over the
    keys. A pair with both columns in ``many`` needs rows complete in all of them.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    inner = [c for c in names if c in many.columns]
    outer = [c for c in names if c not in inner]
    within = [(a, b) for a, b in pairs if a in inner and b in inner and a != b]
    keyed = key_moments(many.select(*k, *inner), k, inner, within).join(one.select(*k, *outer), list(k))
    keyed = materialise(keyed, "moments")

    def side(c):
        if c in inner:
            return [F.col(c)[f].alias(f"{f}_") for f in ("mean", "spread", "lo", "hi")]
        value = F.col(c).cast("double")
        return [value.alias("mean_"), F.lit(0.0).alias("spread_"), value.alias("lo_"), value.alias("hi_")]

    def cell(a, b):
        n = next((F.col(c)["n"] for c in (a, b) if c in inner), F.col("_rows"))
        together = F.col(a)["spread"] if a == b and a in inner else F.col(f"`{a}*{b}`") if (a, b) in within else F.lit(0.0)
        return F.struct(
            F.lit(a).alias("a"),
            F.lit(b).alias("b"),
            n.alias("n"),
            F.struct(*side(a)).alias("x"),
            F.struct(*side(b)).alias("y"),
            together.alias("together"),
        )

    long = keyed.select(F.inline(F.array(*[cell(a, b) for a, b in pairs])))
    long = long.where("n > 0 and x.mean_ is not null and y.mean_ is not null")
    centre = lambda v: (F.sum(F.col("n") * F.col(f"{v}.mean_")) / F.sum("n")).alias(f"{v}_mean")
    flat = lambda v: (F.min(f"{v}.lo_") == F.max(f"{v}.hi_")).alias(f"{v}_flat")
    centres = long.groupBy("a", "b").agg(*[f(v) for v in "xy" for f in (centre, flat)])
    gap = lambda v: F.col(f"{v}.mean_") - F.col(f"{v}_mean")
    spread = lambda v: F.sum(F.col(f"{v}.spread_") + F.col("n") * F.pow(gap(v), 2))
    # One row per pair of columns, hence the broadcast.
    sums = long.join(F.broadcast(centres), ["a", "b"]).groupBy("a", "b", "x_flat", "y_flat").agg(
        F.sum(F.col("together") + F.col("n") * gap("x") * gap("y")).alias("xy"),
        spread("x").alias("xx"),
        spread("y").alias("yy"),
        F.sum("n").alias("n"),
    )
    r = F.when(~F.col("x_flat") & ~F.col("y_flat"), F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy")))
    return sums.select("a", "b", r.alias("r"), "n")


def long_values(df: DataFrame, cols, by) -> DataFrame:
    """(by, col, value) of the known values, from a table written once with only those columns."""
    wide = materialise(df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols]), "values")
    return wide.unpivot(list(by), list(cols), "col", "value").where("value is not null")


def merged_sketches(values: DataFrame, keys, fan=SKETCH_FAN, size=SKETCH_SIZE) -> DataFrame:
    """(keys, n_values, sketch): one sketch of all values of a key, merged level by level.

    Every task sketches its rows; sketches of ``fan`` neighbouring tasks become
    one, then those of ``fan`` such groups, and so on. No task ever merges more
    than ``fan`` sketches of a key, whatever the number of tasks.
    """
    group = lambda c: F.floor(c / fan).cast("int")
    sketch = F.kll_sketch_agg_double("value", size).alias("sketch")
    merge = [F.sum("n_values").alias("n_values"), F.kll_merge_agg_double("sketch", size).alias("sketch")]
    parts = values.select(*keys, "value", group(F.spark_partition_id()).alias("_part"))
    parts = materialise(parts.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("n_values"), sketch), "sketches")
    while (parts.agg(F.max("_part")).first()[0] or 0) >= fan:
        parts = materialise(parts.withColumn("_part", group(F.col("_part"))).groupBy(*keys, "_part").agg(*merge), "sketches")
    return parts.groupBy(*keys).agg(*merge)


def sketched_brackets(values: DataFrame, keys, probs) -> DataFrame:
    """Per key: number of values, and for every quantile its position and a narrow range around it."""
    edges = [edge for p in probs.values() for edge in (max(p - SKETCH_MARGIN, 0.0), min(p + SKETCH_MARGIN, 1.0))]
    found = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(float(e)) for e in edges]))
    sketched = merged_sketches(values, keys).select(*keys, "n_values", found.alias("edges"))
    brackets = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                (p * (F.col("n_values") - 1)).alias("at"),
                F.col("edges")[2 * i].alias("lo"),
                F.col("edges")[2 * i + 1].alias("hi"),
            )
            for i, (name, p) in enumerate(probs.items())
        ]
    )
    return sketched.select(*keys, "n_values", brackets.alias("brackets"))


def counted_brackets(values: DataFrame, keys, probs) -> DataFrame:
    """The same with ``below``, the number of values under each range.

    A range that should miss its position is opened to all values, so the result
    does not rest on the sketch.
    """
    sketched = materialise(sketched_brackets(values, keys, probs), "sketched")  # a row per key
    looked_up = lookup_join(values, sketched, keys)
    value, bracket = F.col("value"), lambda i: F.col("brackets")[i]
    under = lambda i: F.count(F.when(value < bracket(i)["lo"], 1)).alias(f"under{i}")
    upto = lambda i: F.count(F.when(value <= bracket(i)["hi"], 1)).alias(f"upto{i}")
    # Numbers alone are counted in a hash table of a row per key; with an array among them Spark would sort all values.
    counts = looked_up.groupBy(*keys).agg(*[f(i) for i in range(len(probs)) for f in (under, upto)])
    counts = counts.join(sketched, keys)

    def checked(i):
        b, under, upto = bracket(i), F.col(f"under{i}"), F.col(f"upto{i}")
        holds = (under <= F.floor(b["at"])) & (F.ceil(b["at"]) < upto)
        return F.struct(
            b["name"].alias("name"),
            b["at"].alias("at"),
            F.when(holds, b["lo"]).otherwise(float("-inf")).alias("lo"),
            F.when(holds, b["hi"]).otherwise(float("inf")).alias("hi"),
            F.when(holds, under).otherwise(0).alias("below"),
        )

    brackets = F.array(*[checked(i) for i in range(len(probs))]).alias("brackets")
    return materialise(counts.select(*keys, "n_values", brackets), "brackets")


def at_ranks(blocks: DataFrame, keys, wanted: DataFrame) -> DataFrame:
    """(keys, lo_value, hi_value): the values at positions ``lo_at`` and ``hi_at`` (from 0).

    ``blocks`` holds counted values sorted into blocks. Only block totals are
    summed up across a group; values are looked at in the blocks that hold a
    wanted position, so no task ever sees a whole group.
    """
    starts, ends = F.col("_before"), F.col("_before") + F.col("_inside")
    held = lambda c, start, end: (F.col(c) >= start) & (F.col(c) < end)
    hits = (
        block_offsets(blocks, keys, "n")
        .join(wanted, keys)
        .where(held("lo_at", starts, ends) | held("hi_at", starts, ends))
        .select(*keys, "_block", "_before", "lo_at", "hi_at")
    )
    upto = Window.partitionBy(*keys, "_block").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = lookup_join(blocks, hits, [*keys, "_block"]).withColumn("_end", starts + F.sum("n").over(upto))
    pick = lambda c: F.max(F.when(held(c, F.col("_end") - F.col("n"), F.col("_end")), F.col("value")))
    return placed.groupBy(*keys).agg(pick("lo_at").alias("lo_value"), pick("hi_at").alias("hi_value"))


def exact_quantiles(values: DataFrame, keys, probs) -> DataFrame:
    """(keys, one column per quantile) with linear interpolation, exact for groups of any size.

    A mergeable sketch narrows each quantile down to a small share of the values;
    the rest is only counted. Just the values inside the ranges are shuffled,
    counted and sorted.
    """
    brackets = counted_brackets(values, keys, probs)
    inside = F.filter("brackets", lambda b: F.col("value").between(b["lo"], b["hi"]))
    candidates = (
        lookup_join(values, brackets, keys)
        .select(*keys, "value", F.inline(inside))
        .groupBy(*keys, "name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    named = [*keys, "name"]
    wanted = brackets.select(*keys, F.inline("brackets")).select(
        *named,
        "at",
        (F.floor("at") - F.col("below")).alias("lo_at"),
        (F.ceil("at") - F.col("below")).alias("hi_at"),
    )
    ends = at_ranks(ordered_blocks(candidates, named, ["value"]), named, wanted.drop("at")).join(wanted, named)
    part = F.col("at") - F.floor("at")
    quantile = F.col("lo_value") + part * (F.col("hi_value") - F.col("lo_value"))
    return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, quantile)).alias(name) for name in probs])


def with_fences(quartiles: DataFrame) -> DataFrame:
    reach = WHISKER_REACH * (F.col("q3") - F.col("q1"))
    return quartiles.withColumns({"lo_fence": F.col("q1") - reach, "hi_fence": F.col("q3") + reach})


def box_stats(df: DataFrame, cols, by=()) -> DataFrame:
    """(by, col, q1, median, q3, lo_whisker, hi_whisker, n_out) of each column.

    Whiskers are the extreme values within the fences, but never inside the box.
    """
    keys = [*by, "col"]
    values = long_values(df, cols, by)
    fences = with_fences(exact_quantiles(values, keys, QUARTILES))
    value, lo, hi = F.col("value"), F.col("lo_fence"), F.col("hi_fence")
    boxes = lookup_join(values, fences, keys).groupBy(*keys, *QUARTILES).agg(
        F.min(F.when(value >= lo, value)).alias("lo"),
        F.max(F.when(value <= hi, value)).alias("hi"),
        F.count(F.when((value < lo) | (value > hi), 1)).alias("n_out"),
    )
    return boxes.select(
        *keys,
        *QUARTILES,
        F.least("lo", "q1").alias("lo_whisker"),
        F.greatest("hi", "q3").alias("hi_whisker"),
        "n_out",
    )


def box_stats_cohort(df: DataFrame, cols, cohort="cohort") -> DataFrame:
    return box_stats(df, cols, [cohort])


def box_outliers(df: DataFrame, cols, row_key, by=()) -> DataFrame:
    """(row key, by, col, value) of the values outside the fences."""
    keys, ids = [*by, "col"], [*row_key, *by]
    values = long_values(df, cols, ids)
    fences = with_fences(exact_quantiles(values.select(*keys, "value"), keys, QUARTILES))
    outside = lookup_join(values, fences.select(*keys, "lo_fence", "hi_fence"), keys)
    return outside.where("value < lo_fence or value > hi_fence").select(*ids, "col", "value")
