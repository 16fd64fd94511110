"""Decisions about documents, applied to whole tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch
from skygrade.operators.spread import number_rows


def without(docs: DataFrame, dropped) -> DataFrame:
    """``docs`` with all their columns, less the rows whose doc_id ``dropped(docs)`` returns.

    Where doc_ids repeat or are missing, rows are decided one by one: for the
    time of the decision each has an id of its own, in the order of (doc_id with
    null last, text).
    """
    scratch = Scratch(docs.sparkSession)
    most, nulls = (
        docs.groupBy("doc_id").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count_if(F.col("doc_id").isNull())).first()
    )
    if most <= 1 and not nulls:
        # Written first, so that Spark knows its size: small lists are broadcast, others joined by shuffle.
        return docs.join(scratch.write(dropped(docs).select("doc_id").distinct(), "dropped"), "doc_id", "left_anti").select(docs.columns)
    columns = docs.columns
    given = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc, text = (f"c{columns.index(name)}" for name in ("doc_id", "text"))
    rows = number_rows(given.withColumn("no_id", F.col(doc).isNull()), [], ["no_id", doc, text], "row").drop("no_id")
    rows = scratch.write(rows, "rows")
    gone = scratch.write(dropped(rows.select(F.col("row").cast("long").alias("doc_id"), F.col(text).alias("text"))).select("doc_id").distinct(), "dropped")
    return rows.join(gone, rows.row == gone.doc_id, "left_anti").drop("row").toDF(*columns)
