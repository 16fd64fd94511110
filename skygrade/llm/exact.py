"""Exact duplicates by a cuckoo-filter index over digests of normalised texts.

The index is cut into buckets by digest. A bucket holds a cuckoo filter of its
live digests and, as rows, the digests themselves with the smallest doc_id and
the number of documents (its content). An incoming digest that misses the filter
is new; one that hits is looked up in the bucket's content before it counts as a
duplicate, so a false positive costs a look-up and nothing else. A filter that
cannot place a digest is doubled and filled again from the stored digests.

Defined results: null text is empty; a null doc_id is a document without an id,
and never the one that stays unless its whole group has none; rows that repeat
a doc_id with the same text stand for one document and share its decision; an
empty table gives an empty index. Only ``doc_id`` and ``text`` are read.
"""

import hashlib
import struct
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skygrade.llm.common import WHITE, Scratch, map_batches, raw, texts

SLOTS = 4
KICKS = 200
BUCKET_KEYS = 4096  # digests a bucket is laid out for


class CuckooFilter:
    """16-bit fingerprints, four to a slot group; supports insertion, look-up and deletion."""

    def __init__(self, groups=64, cells=None):
        self.groups = groups
        self.cells = cells or array("H", bytes(2 * SLOTS * groups))

    @staticmethod
    def fingerprint(digest: bytes) -> int:
        return struct.unpack_from("<H", digest, 16)[0] or 1

    def places(self, digest: bytes):
        print_ = self.fingerprint(digest)
        first = struct.unpack_from("<Q", digest, 18)[0] & (self.groups - 1)
        return print_, first, self.other(first, print_)

    def other(self, group: int, print_: int) -> int:
        return group ^ ((print_ * 0x5BD1E995 >> 3) & (self.groups - 1))

    def __contains__(self, digest: bytes) -> bool:
        print_, first, second = self.places(digest)
        cells = self.cells
        return print_ in cells[first * SLOTS : first * SLOTS + SLOTS] or print_ in cells[second * SLOTS : second * SLOTS + SLOTS]

    def put(self, group: int, print_: int) -> bool:
        for cell in range(group * SLOTS, group * SLOTS + SLOTS):
            if not self.cells[cell]:
                self.cells[cell] = print_
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False if the filter is too full: it must then be built anew from the stored keys."""
        print_, first, second = self.places(digest)
        if self.put(first, print_) or self.put(second, print_):
            return True
        group = second
        for kick in range(KICKS):
            cell = group * SLOTS + kick % SLOTS
            print_, self.cells[cell] = self.cells[cell], print_
            group = self.other(group, print_)
            if self.put(group, print_):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        print_, first, second = self.places(digest)
        for group in (first, second):
            for cell in range(group * SLOTS, group * SLOTS + SLOTS):
                if self.cells[cell] == print_:
                    self.cells[cell] = 0
                    return True
        return False

    def dump(self) -> bytes:
        return self.cells.tobytes()

    @classmethod
    def load(cls, blob: bytes):
        cells = array("H")
        cells.frombytes(blob)
        return cls(len(cells) // SLOTS, cells)


class Bucket:
    """Filter and content of one bucket."""

    def __init__(self, filter_=None, content=None):
        self.filter = filter_ or CuckooFilter()
        self.content = content if content is not None else {}

    def add(self, digest, doc, n):
        if digest in self.filter and digest in self.content:
            kept, size = self.content[digest]
            self.content[digest] = (doc if kept is None or (doc is not None and doc < kept) else kept, size + n)
            return
        self.content[digest] = (doc, n)
        if not self.filter.insert(digest):
            self.grow()

    def replace(self, digest, doc, n):
        """Set what is left of a group after deletions; nothing left frees its place."""
        if digest not in self.filter or digest not in self.content:
            return
        if n:
            self.content[digest] = (doc, n)
        else:
            del self.content[digest]
            self.filter.delete(digest)

    def grow(self):
        groups = self.filter.groups
        while True:
            groups *= 2
            self.filter = CuckooFilter(groups)
            if all(map(self.filter.insert, self.content)):
                return


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space, at the ends too."""
    words = text.split()
    if not words:
        return b" " if text else b""
    lead = b" " if text[0] in WHITE else b""
    tail = b" " if text[-1] in WHITE else b""
    return lead + b" ".join(words) + tail


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of each normalised text."""

    def run(batch):
        found = [hashlib.sha256(normalised(x)).digest() for x in raw(batch.column("text"))]
        return [batch.column("doc_id"), pa.array(found, pa.binary())]

    return map_batches(texts(docs), run, "doc_id long, digest binary")


def combined(members: DataFrame) -> DataFrame:
    """Partial groups (digest, doc_id, n): a map task passes on a digest once per batch, however hot it is."""

    def run(batch):
        groups = {}
        for doc, digest in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()):
            kept, n = groups.get(digest, (None, 0))
            groups[digest] = (doc if kept is None or (doc is not None and doc < kept) else kept, n + 1)
        kept, n = zip(*groups.values())
        return [pa.array(list(groups), pa.binary()), pa.array(kept, pa.int64()), pa.array(n, pa.int64())]

    return map_batches(members, run, "digest binary, doc_id long, n long")


INDEX = "bucket int, digest binary, keep_id long, group_size long, filter binary"


class ExactIndex:
    """Buckets of live digests. ``rows`` has one row per digest and one per bucket's filter;
    ``members`` has the live documents with their digests, from which deletions find the next one to stay."""

    def __init__(self, spark: SparkSession, buckets: int, rows=None, members=None):
        self.spark, self.buckets = spark, buckets
        self.scratch = Scratch(spark)
        self.rows = rows if rows is not None else spark.createDataFrame([], INDEX)
        self.members = members if members is not None else spark.createDataFrame([], "doc_id long, digest binary")

    @classmethod
    def build(cls, docs: DataFrame, per_bucket=BUCKET_KEYS) -> "ExactIndex":
        scratch = Scratch(docs.sparkSession)
        members = scratch.write(digests(docs), "digests")
        buckets = max(1, -(-members.count() // per_bucket))
        index = cls(docs.sparkSession, buckets)
        index._update(combined(members), "add")
        index.members = members
        return index

    def insert(self, docs: DataFrame) -> None:
        """Add documents to the live ones."""
        new = self.scratch.write(digests(docs), "digests")
        self._update(combined(new), "add")
        self.members = self.scratch.write(self.members.unionByName(new), "members")

    def delete(self, ids: DataFrame) -> None:
        """Take the documents in column ``doc_id`` of ``ids`` out; groups pass to the next smallest doc_id."""
        gone = ids.select("doc_id").distinct()
        dropped = self.scratch.write(self.members.join(gone, "doc_id", "left_semi"), "dropped")
        left = self.scratch.write(self.members.join(gone, "doc_id", "left_anti"), "members")
        touched = dropped.select("digest").distinct()
        rest = left.join(touched, "digest", "left_semi").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        state = touched.join(rest, "digest", "left").select("digest", "doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        self._update(state, "replace")
        self.members = left

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) of the live digests."""
        return self.rows.where("digest is not null").select("digest", "keep_id", "group_size")

    def _update(self, incoming: DataFrame, action: str) -> None:
        buckets = self.buckets
        place = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(buckets)).cast("int")
        coming = incoming.withColumn("bucket", place)

        def run(key, stored: pa.Table, new: pa.Table) -> pa.Table:
            content, filter_ = {}, None
            for digest, kept, size, blob in zip(*(stored.column(c).to_pylist() for c in ("digest", "keep_id", "group_size", "filter"))):
                if digest is None:
                    filter_ = CuckooFilter.load(blob)
                else:
                    content[digest] = (kept, size)
            bucket = Bucket(filter_, content)
            change = getattr(bucket, action)
            for digest, doc, n in zip(*(new.column(c).to_pylist() for c in ("digest", "doc_id", "n"))):
                change(digest, doc, n)
            number = key[0].as_py()
            kept, size = zip(*bucket.content.values()) if bucket.content else ((), ())
            return pa.table(
                {
                    "bucket": pa.array([number] * (len(kept) + 1), pa.int32()),
                    "digest": pa.array([*bucket.content, None], pa.binary()),
                    "keep_id": pa.array([*kept, None], pa.int64()),
                    "group_size": pa.array([*size, None], pa.int64()),
                    "filter": pa.array([None] * len(kept) + [bucket.filter.dump()], pa.binary()),
                }
            )

        changed = self.rows.groupBy("bucket").cogroup(coming.groupBy("bucket")).applyInArrow(run, INDEX)
        self.rows = self.scratch.write(changed, "cuckoo-index")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of its normalised text.

    A digest shared by very many documents crosses the first shuffle as one row
    per batch. In the look-up join Spark divides such a key's rows (adaptive skew
    join); the other side holds one row for it.
    """
    index = ExactIndex.build(docs)
    found = index.members.join(index.groups(), "digest")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
