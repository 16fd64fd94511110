"""What every file of a folder of CSV holds, from one job over the heads of all files.

A manifest has a row for each file that is not empty: its path, the names in its
header and its first rows. Columns are then bound by the header of their own file
in one scan of the folder, and text that a writer put down in one of several
shapes (dates, stamps) is read in the shape of its own file.
"""

import csv
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrade.operators.spread import lookup_join
from skygrade.schema import text_schema
from skygrade.session import materialise

FILE = "_file"  # column with the path of the file a row came from
HEAD_ROWS = 100  # rows of a file that its head keeps


def safe_names(cells: list[str]) -> list[str]:
    """Header cells as column names: blank ones are numbered, so are those that differ from others by case at most."""
    cells = [c.removeprefix("﻿") for c in cells]
    folded = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if folded.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def parsed(lines: list[str]) -> tuple[list[str], list[list[str]]]:
    """Header and first rows of a file's first lines."""
    header, *rows = csv.reader(lines, escapechar="\\")
    return safe_names(header), rows


def read_heads(batches):
    """Arrow batches of lines, files one after another, to one row for each file whose beginning is among them.

    A part that is cut from the middle or the beginning of a long file is a task's
    only part: Spark fills a task up with further files only where room is left.
    Its reading ends with its head.
    """
    file, lines = None, []

    def done():
        header, rows = parsed(lines)
        kinds = pa.list_(pa.string()), pa.list_(pa.list_(pa.string()))
        columns = [pa.array([file]), pa.array([header], kinds[0]), pa.array([rows], kinds[1])]
        return pa.RecordBatch.from_arrays(columns, names=["file", "header", "head"])

    for batch in batches:
        names, start = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        at = 0
        while at < batch.num_rows:
            end = at + 1
            while end < batch.num_rows and names[end] == names[at] and start[end] == start[at]:
                end += 1
            if not start[at]:
                if names[at] != file:
                    if lines:
                        yield done()
                    file, lines = names[at], []
                step = at
                while len(lines) <= HEAD_ROWS and step < end:
                    part = batch.column("value").slice(step, min(end - step, HEAD_ROWS + 1)).to_pylist()
                    lines += [line for line in part if line.strip()][: HEAD_ROWS + 1 - len(lines)]
                    step += HEAD_ROWS + 1
            at = end
        if batch.num_rows:
            last = batch.slice(batch.num_rows - 1, 1).to_pylist()[0]
            if last["start"] + last["length"] < last["size"] and (last["start"] or len(lines) > HEAD_ROWS):
                break
    if lines:
        yield done()


def manifest(spark: SparkSession, path) -> DataFrame:
    """file, header, head (rows of text) of every CSV file below ``path``, written to the shared folder."""
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        meta["file_block_length"].alias("length"),
        meta["file_size"].alias("size"),
        "value",
    )
    return materialise(lines.mapInArrow(read_heads, "file string, header array<string>, head array<array<string>>"), "manifest")


def plain(name: str) -> str:
    """What two files' names for one column have in common."""
    return name.strip().lower()


def bound_rows(spark: SparkSession, path, files: DataFrame) -> DataFrame:
    """Text columns of the folder by name, each file's by its own header, with partition columns and FILE.

    One scan binds columns by position; where headers differ, a file's position of
    each column is looked up by its path. A column that a file lacks is null there.
    Headers are collected: there are as many as ways to write the table.
    """
    headers = sorted(tuple(h) for h in files.agg(F.collect_set("header")).first()[0])
    if not headers:
        return spark.read.option("header", True).csv(path).withColumn(FILE, F.lit(None).cast("string"))
    places = {}  # column: {position: headers that have it there}
    spelled = {}
    for number, header in enumerate(headers):
        for at, name in enumerate(header):
            spelled.setdefault(plain(name), name)
            places.setdefault(plain(name), {}).setdefault(at, []).append(number)
    width = max(map(len, headers))
    cells = text_schema([f"_cell{i}" for i in range(width)])
    rows = spark.read.schema(cells).option("header", True).csv(path)
    kept = [c for c in rows.columns if c not in cells.names]  # partition columns
    rows = rows.select("*", F.col("_metadata.file_path").alias(FILE))
    if len(headers) == 1:
        return rows.select(*[F.col(f"_cell{i}").alias(name) for i, name in enumerate(headers[0])], *kept, FILE)
    numbers = F.array_position(F.lit([list(h) for h in headers]), F.col("header")).cast("int") - 1
    rows = lookup_join(rows, files.select(F.col("file").alias(FILE), numbers.alias("_header")), [FILE])
    cell = lambda at, held: F.when(F.col("_header").isin(held), F.col(f"_cell{at}"))
    return rows.select(*[F.coalesce(*[cell(*p) for p in places[key].items()]).alias(spelled[key]) for key in places], *kept, FILE)


def head_values(raw_names) -> Column:
    """The head's values of the column that is called by one of ``raw_names``."""
    names = F.transform("header", lambda c: F.lower(F.trim(c)))
    wanted = F.filter(names, lambda c: c.isin([plain(n) for n in raw_names]))
    at = F.array_position(names, F.get(wanted, 0)).cast("int")
    return F.transform("head", lambda row: F.get(row, at - 1))


def best_shape(counts: dict[str, Column]) -> Column:
    """The shape with the greatest count, the first of equal ones; empty if nothing has any shape."""
    most = F.greatest(*counts.values())
    return reduce(lambda found, s: F.coalesce(found, F.when(counts[s] == most, F.lit(s))), counts, F.when(most == 0, F.lit(""))).alias("shape")


def shapes_in_heads(files: DataFrame, raw_names, shapes, parse) -> DataFrame:
    """FILE, shape: how the head of each file writes a column."""
    values = head_values(raw_names)
    count = lambda s: F.size(F.filter(values, lambda v: parse(v, s).isNotNull()))
    return files.select(F.col("file").alias(FILE), best_shape({s: count(s) for s in shapes}))


def shapes_in_rows(rows: DataFrame, name, shapes, parse) -> DataFrame:
    """FILE, shape: how most values of a column are written in each file; only that column is read."""
    counts = rows.groupBy(FILE).agg(*[F.count(parse(name, s)).alias(s) for s in shapes])
    return counts.select(FILE, best_shape({s: F.col(s) for s in shapes}))


def with_shapes(rows: DataFrame, shapes_of: DataFrame, name="_shape") -> DataFrame:
    """``rows`` with the shape of their file; a folder of one shape needs no look-up."""
    shapes_of = materialise(shapes_of, "shapes")
    found = shapes_of.agg(F.collect_set("shape")).first()[0]
    if len(found) == 1:
        return rows.withColumn(name, F.lit(found[0]))
    return lookup_join(rows, shapes_of.withColumnRenamed("shape", name), [FILE], "left")
