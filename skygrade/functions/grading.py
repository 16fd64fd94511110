"""Grading of a pollutant value on the scale 1 (worst) to 5 (best)."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skygrade.functions.scalars import column, row_mean
from skygrade.schema import BANDS, CLASS_COLUMNS, POLLUTANTS, class_name


def class_cuts(pollutant):
    """Lowest value of classes 1 to 4.

    A value gets the class whose band centre is nearest, a tie going to the
    worse class. That is the same as comparing it with the midpoints between
    neighbouring centres.
    """
    centres = [(low + high) / 2 for low, high in BANDS[pollutant]]
    return [(a + b) / 2 for a, b in zip(centres, centres[1:])]


def classify_nearest(c, pollutant) -> Column:
    """Class 1..5 of a value; null stays null, values outside all bands still get one."""
    value = column(c)
    graded = reduce(
        lambda chain, step: chain.when(value >= step[1], step[0]),
        enumerate(class_cuts(pollutant), start=1),
        F.when(value.isNull(), F.lit(None).cast("int")),
    )
    return graded.otherwise(5)


def with_classes(df, pollutants=POLLUTANTS):
    """Add one class per pollutant and ``class_mean``, the mean of the classes present."""
    classes = {class_name(p): classify_nearest(p, p) for p in pollutants}
    return df.withColumns(classes).withColumn("class_mean", row_mean(*classes))


__all__ = ["CLASS_COLUMNS", "class_cuts", "classify_nearest", "with_classes"]
