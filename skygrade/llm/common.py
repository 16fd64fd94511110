"""Helpers shared by the text operators."""

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrade.operators.spread import number_rows
from skygrade.session import fresh_path

WHITE = b" \t\n\x0b\x0c\r"
WHITE_CLASS = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def texts(docs: DataFrame) -> DataFrame:
    """The two columns that text operators read, so that other columns cannot clash; null text is empty."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def raw(column) -> list[bytes]:
    """UTF-8 of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(texts_: list[bytes], size=4_000_000):
    """Consecutive texts of about ``size`` bytes together; a longer text is one slice."""
    block, n = [], 0
    for text in texts_:
        block.append(text)
        n += len(text)
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


def blocks(column, size=1_000_000):
    """UTF-8 of an Arrow string column in ``slices`` of about ``size`` bytes; few more rows than these are held at a time."""
    rows = max(1, int(len(column) * size / max(column.nbytes, 1)))
    for at in range(0, len(column), rows):
        yield from slices(raw(column.slice(at, rows)), size)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` turns one Arrow batch into a list of Arrow arrays or a table's columns, in the order of ``schema``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from as_batches(fn(batch), names)

    names = [part.split()[0] for part in schema.split(", ")]
    return df.mapInArrow(run, schema)


def map_slices(df: DataFrame, fn, schema: str, size=4_000_000) -> DataFrame:
    """``map_batches`` on slices of about ``size`` bytes, at least a row each: what ``fn`` holds does not grow with the batch."""

    def run(batches):
        for batch in batches:
            rows = max(1, int(batch.num_rows * size / max(batch.nbytes, 1)))
            for at in range(0, batch.num_rows, rows):
                yield from as_batches(fn(batch.slice(at, rows)), names)

    names = [part.split()[0] for part in schema.split(", ")]
    return df.mapInArrow(run, schema)


def as_batches(columns, names):
    out = pa.Table.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)
    return out.to_batches(max_chunksize=50_000)


#: Shuffle files of a finished write are of no more use: what follows reads the table.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder by one call; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str, partition_by=()) -> DataFrame:
        path = fresh_path(self.spark, label)
        before = self.spark.conf.get(CLEAN_SHUFFLES, "false")
        self.spark.conf.set(CLEAN_SHUFFLES, "true")
        try:
            df.write.partitionBy(*partition_by).parquet(path)
        finally:
            self.spark.conf.set(CLEAN_SHUFFLES, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = (path, back)
        return back

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            path, _ = self.paths.pop(id(frame))
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def identified(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Texts under ids that are unique and in the order of doc_id, and the map back to doc_id if one was needed.

    Where doc_id is complete and unique it is the id itself. Else rows are
    numbered by (doc_id with null last, text): rows that repeat a doc_id become
    documents of their own, and equal rows follow one another.
    """
    narrow = texts(docs)
    counts = narrow.groupBy("doc_id").count().agg(
        F.coalesce(F.max("count"), F.lit(0)), F.count_if(F.col("doc_id").isNull())
    )
    most, nulls = counts.first()
    if most <= 1 and not nulls:
        return narrow, None
    spot = number_rows(narrow.withColumn("_null", F.col("doc_id").isNull()), [], ["_null", "doc_id", "text"], "_id")
    kept = scratch.write(spot.select(F.col("_id").cast("long"), "doc_id", "text"), "identified")
    return kept.select(F.col("_id").alias("doc_id"), "text"), kept.select("_id", F.col("doc_id").alias("_doc"))


def restored(result: DataFrame, names: DataFrame | None) -> DataFrame:
    """Give rows under ids of ``identified`` their doc_id back."""
    if names is None:
        return result
    columns = result.columns
    joined = result.withColumnRenamed("doc_id", "_id").join(names, "_id")
    return joined.withColumnRenamed("_doc", "doc_id").select(*columns)
