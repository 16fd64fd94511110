"""Web pages as WARC files, and a fixity audit of replicas by Merkle trees.

Writing: every task writes its pages, in its own order and without a shuffle, as
WARC records into files of at most a given number of records. A file is a
segment; records are numbered and lie at known offsets of its uncompressed bytes.

Audit: each replica's segments are read and cut into records; a leaf is the
offset range of a record and the hash of its bytes. Records that begin in the same
64 KiB of a segment hash to a parent, then 16 neighbouring ranges at a time up to
the segment, then 16 neighbouring segments at a time up to one root. Places are
offsets, not counts, so a record more or less in one range leaves others comparable.
Roots are compared, and only children of differing nodes are looked at further,
so that of sound branches no more than one node is compared.

Defined results: null html is empty, a null url is an empty one, a null page_id
is written as ``none``; line breaks in a url become spaces; repeated pages are
records of their own; an empty table gives archives without records and an
empty report. Bytes where no record begins are one record up to the next
beginning, so a damaged header is located like any other damage; a header that
lies about its length is caught the same way. Stored bytes that do not unpack, a
missing end or wrong checksum of a member and bytes behind it are a leaf of their
own; what was read before them counts, and reading goes on at the next member.
In a file of one member the records behind such bytes are lost. Records lost at the end of a
segment and whole lost segments are reported as missing.
"""

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch, as_batches

FANOUT = 16
RANGE = 65_536  # bytes of a segment under one node above the leaves
SEGMENT_RECORDS = 1000
MAGIC = b"WARC/1.0\r\n"
GZIP = b"\x1f\x8b\x08"
STEP = 4096  # stored bytes read at once behind damage
GAP = b"\r\n\r\n"
HEAD = re.compile(rb"WARC/1\.0\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n(?:[^\r\n]+\r\n)*\r\n")
RECORD_ID = re.compile(rb"WARC-Record-ID: <([^>\r\n]*)>")

#: The blank lines that end a record are written as the separator of text rows.
TEXT_WRITER = {"lineSep": GAP.decode(), "compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def record_column():
    """Text of a WARC resource record, without its last blank lines, from the columns page_id, url and html."""
    html = F.coalesce("html", F.lit(""))
    url = F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ")
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"),
        F.lit("\r\n\r\n"),
        html,
    )


def write_warc(pages: DataFrame, path: str, per_segment=SEGMENT_RECORDS) -> None:
    """One record per page, in files of at most ``per_segment`` records below ``path``."""
    records = pages.select(record_column().alias("value"))
    records.write.options(**TEXT_WRITER).option("maxRecordsPerFile", per_segment).text(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, content) of an archive written by a job or copied segment by segment."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    task = F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)[^/]*$", 1).cast("long")
    number = F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)[^/]*$", 2).cast("long")
    copied = F.regexp_extract("path", r"/segment=(\d+)/", 1)
    return files.select(
        F.when(copied != "", copied.cast("long")).otherwise(task * 1_000_000 + number).alias("segment"), "content"
    )


def cut(data: bytes) -> list[tuple[int, int]]:
    """Offset ranges of the records of a segment, in order and without gaps."""
    ranges, at = [], 0
    while at < len(data):
        head = HEAD.match(data, at)
        end = head.end() + int(head[1]) + len(GAP) if head else 0
        if not head or end > len(data) or data[end - len(GAP) : end] != GAP:
            end = data.find(GAP + MAGIC, at + 1)
            end = len(data) if end < 0 else end + len(GAP)
        ranges.append((at, end))
        at = end
    return ranges


def member(content: bytes, at: int) -> tuple[bytes, int, bool]:
    """What can be read of the gzip member at ``at``, where reading ends, and whether its end and checksum are sound."""
    whole = zlib.decompressobj(31)
    try:
        out = whole.decompress(content[at:] if at else content)
        return out, len(content) - len(whole.unused_data), whole.eof
    except zlib.error:
        pass
    # Once more in steps up to the one that fails, and that one byte by byte.
    read, tried = at, zlib.decompressobj(31)
    try:
        for read in range(at, len(content), STEP):
            tried.decompress(content[read : read + STEP])
    except zlib.error:
        pass
    again = zlib.decompressobj(31)
    out = [again.decompress(content[at:read])]
    try:
        while True:
            out.append(again.decompress(content[read : read + 1]))
            read += 1
    except zlib.error:
        return b"".join(out), read, False


def stored_parts(content: bytes):
    """(bytes, sound): uncompressed bytes, and as they are stored those that could not be read or follow the last member.

    After the former the next readable member goes on. A member without its end
    leaves an empty part that is not sound.
    """
    if content[:2] != GZIP[:2]:
        yield content, True
        return
    at = 0
    while at < len(content):
        out, end, sound = member(content, at) if content.startswith(GZIP, at) else (b"", at, False)
        if out:
            yield out, True
        if not sound:
            following = content.find(GZIP, end + 1)
            while following >= 0 and not member(content, following)[2]:
                following = content.find(GZIP, following + 1)
            stop = following if following >= 0 else len(content)
            yield content[end:stop], False
            end = stop
        at = end


def unpacked(content: bytes) -> bytes:
    """Uncompressed bytes; of a torn file what can still be read."""
    return b"".join(part for part, sound in stored_parts(content) if sound)


def records_of(content: bytes) -> list[tuple[int, bytes]]:
    """Records of a segment and the places where they start; bytes that could not be read are one of their own."""
    found, at, run = [], 0, []
    for part, sound in [*stored_parts(content), (None, False)]:
        if sound:
            run.append(part)
            continue
        data, run = b"".join(run), []
        found += [(at + a, data[a:b]) for a, b in cut(data)]
        at += len(data)
        if part is not None:
            found.append((at, part))
            at += len(part)
    return found


#: ``number`` is the place of a node in its level: the start of a leaf, the number of a range above it.
LEAVES = "segment long, number long, start long, end long, hash string, record_id string"


def leaves(found: DataFrame) -> DataFrame:
    """A leaf per record: segment, offset range, hash of its bytes and the id it names."""

    def run(batches):
        for batch in batches:
            for segment, content in zip(batch.column("segment").to_pylist(), batch.column("content")):
                rows = []
                for start, record in records_of(content.as_py()):
                    named = RECORD_ID.search(record, 0, 4096)
                    rows.append((segment, start, start, start + len(record), hashlib.sha256(record).hexdigest(), named[1].decode(errors="replace") if named else None))
                if rows:
                    yield from as_batches([list(c) for c in zip(*rows)], names)

    names = [part.split()[0] for part in LEAVES.split(", ")]
    return found.mapInArrow(run, LEAVES)


def copy_archive(spark: SparkSession, source: str, target: str, change) -> None:
    """Copy an archive segment by segment; ``change`` maps the bytes of a record, for trials of the audit."""

    def run(batches):
        for batch in batches:
            for segment, content in zip(batch.column("segment").to_pylist(), batch.column("content")):
                data = unpacked(content.as_py())
                records = [change(data[a:b]).removesuffix(GAP).decode() for a, b in cut(data)]
                yield from as_batches([[segment] * len(records), list(range(len(records))), records], ["segment", "number", "value"])

    records = segments(spark, source).mapInArrow(run, "segment long, number long, value string")
    ordered = records.sortWithinPartitions("segment", "number").drop("number")
    ordered.write.options(**TEXT_WRITER).partitionBy("segment").text(target)


def above(level: int, within: bool):
    """Columns (segment, number) of the parent of a node of this level."""
    if within:
        return F.col("segment"), F.floor(F.col("number") / (FANOUT if level else RANGE))
    return F.floor(F.col("segment") / FANOUT), F.lit(0).cast("long")


def parents(nodes: DataFrame, level: int, within: bool) -> DataFrame:
    """One level up. A hash covers the children's places, ranges and hashes in order.

    A parent has at most 16 children, above the leaves as many as 64 KiB can
    hold records of the length of a header.
    """
    up = above(level, within)
    child = F.struct("number" if within else "segment", "start", "end", "hash")
    group = nodes.select("replica", up[0].alias("_s"), up[1].alias("_n"), child.alias("_c")).groupBy("replica", "_s", "_n")
    children = group.agg(F.sort_array(F.collect_list("_c")).alias("_c"))
    return children.select(
        "replica",
        F.col("_s").alias("segment"),
        F.col("_n").alias("number"),
        F.element_at("_c", 1)["start"].alias("start"),
        F.element_at("_c", -1)["end"].alias("end"),
        F.sha2(F.to_json("_c"), 256).alias("hash"),
    )


def tree(found: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, bool]]:
    """Levels from the leaves up to the roots, each with whether its parents lie inside a segment (for roots: none)."""
    levels, current = [], found
    while True:
        most, last = current.agg(F.max("number"), F.max("segment")).first()
        if not most and not last:
            return [*levels, (current, None)]
        levels.append((current, bool(most)))
        current = scratch.write(parents(current, len(levels) - 1, bool(most)), "nodes")


NODE = ["segment", "number", "start", "end", "hash"]


def differing(nodes: DataFrame) -> DataFrame:
    """Places whose hashes or ranges differ between the replicas, or that one of them lacks."""
    a = nodes.where("replica = 'a'").select("segment", "number", *(F.col(c).alias(f"{c}_a") for c in NODE[2:]))
    b = nodes.where("replica = 'b'").select("segment", "number", *(F.col(c).alias(f"{c}_b") for c in NODE[2:]))
    both = a.join(b, ["segment", "number"], "full_outer")
    same = F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("start_a").eqNullSafe(F.col("start_b")) & F.col("end_a").eqNullSafe(F.col("end_b"))
    return both.where(~same)


def audit(spark: SparkSession, path_a: str, path_b: str) -> DataFrame:
    """Damaged records: segment, number (offset), kind (altered, missing or added in b), ranges and hashes in both, record_id."""
    scratch = Scratch(spark)
    named = [leaves(segments(spark, path)).withColumn("replica", F.lit(r)) for r, path in (("a", path_a), ("b", path_b))]
    all_ = scratch.write(named[0].unionByName(named[1]), "leaves")
    levels = tree(all_, scratch)
    wrong = scratch.write(differing(levels[-1][0]), "differing")
    for level in range(len(levels) - 2, -1, -1):
        nodes, within = levels[level]
        up = above(level, within)
        down = wrong.select(F.col("segment").alias("_s"), F.col("number").alias("_n"))
        below = nodes.withColumns({"_s": up[0], "_n": up[1]}).join(down, ["_s", "_n"], "left_semi")
        wrong = scratch.write(differing(below.drop("_s", "_n")), "differing")
    ids = all_.groupBy("segment", "number").agg(F.max(F.when(F.col("replica") == "a", F.col("record_id"))).alias("record_id"))
    kind = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "added").otherwise("altered")
    return wrong.withColumn("kind", kind).join(ids, ["segment", "number"], "left")
