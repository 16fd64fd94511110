"""Repeated passages removed by a compacted De Bruijn graph of token k-mers.

An edge is a sequence of 20 words that can occur more than once, between the
nodes of its first and its last 19. Of the 13 eight-word sequences in a window
the one with the smallest hash stands for it (its seed). Equal windows have equal
seeds, so windows whose seed occurs once are no repetition and make no edge.

Paths compact twice. Consecutive edges of one seed are one path, told by a hash
of all its words: where it occurs again, all its edges do. A Spark join finds the
first occurrence of each path; later ones are repeated as a whole. Only paths at
their first occurrence are opened, and the same join on their edges finds those
that start earlier inside another path, as at the ends of a passage. In either
join an occurrence gets source coordinates, where the same words start first.
Neighbouring occurrences whose sources are neighbours too do not branch, and
compact to one span: so many words that are also there, earlier, at the source.

Both ends of every span are read again and compared by a wide digest of their
words before anything is removed; should they differ (paths and edges are told
apart by 64-bit hashes), their windows are grouped again by the words themselves.

Defined results: null, empty and short texts have no windows and keep all words;
documents are ordered by doc_id, rows that repeat one or have none are documents
of their own, ordered by (doc_id with null last, text); within a document a
window may repeat an earlier one that it overlaps. An empty table gives an empty
table. Only ``doc_id`` and ``text`` are read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import Scratch, identified, map_batches, raw, restored
from skygrade.llm.shingles import mixed, runs, stretches, word_hashes

WORDS = 20
SEED = 8
EDGE_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def picks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes of a text, and for each window the place of the first of its smallest seeds.

    The last six bits of a seed give way to those of its place, so that running
    minima over 2, 4, 8 and then 13 seeds carry the place along. Windows over a
    multiple of 64, where these bits begin anew, take places turned by 32. The first
    of equal seeds has the same offset in equal windows, so even windows that
    overlap never take one place for both.
    """
    if len(hashes) < WORDS:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    seeds = runs(hashes, SEED) & ~np.uint64(63)
    place = np.arange(len(seeds), dtype=np.uint64)
    reach = WORDS - SEED + 1
    window = np.arange(len(seeds) - reach + 1)
    at = window + ((smallest(seeds | (place & np.uint64(63))) - window) & 63)
    if len(seeds) > 64:
        turned = window + ((smallest(seeds | ((place + np.uint64(32)) & np.uint64(63))) - 32 - window) & 63)
        at = np.where(window & 63 > 64 - reach, turned, at)
    return seeds, at


def smallest(least: np.ndarray) -> np.ndarray:
    """Last six bits of the smallest value of each window."""
    for reach in (1, 2, 4):
        least = np.minimum(least[:-reach], least[reach:])
    rest = WORDS - SEED + 1 - 8
    return (np.minimum(least[:-rest], least[rest:]) & np.uint64(63)).astype(np.int64)


def edges(hashes: np.ndarray) -> np.ndarray:
    return runs(hashes, WORDS, EDGE_BASE)


def numbered(doc_ids, texts_):
    for doc, text in zip(doc_ids.to_pylist(), raw(texts_)):
        yield doc, text.split()


def flat(parts: list, kind) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.empty(0, kind), pa.from_numpy_dtype(kind))


def seed_rows(docs: DataFrame) -> DataFrame:
    """(seed, doc_id, pos) of the seeds that stand for some window."""

    def run(batch):
        seeds, owners, places = [], [], []
        for doc, words in numbered(batch.column("doc_id"), batch.column("text")):
            found, at = picks(word_hashes(words))
            at = np.unique(at)
            seeds.append(found[at].view(np.int64))
            owners.append(np.full(len(at), doc, np.int64))
            places.append(at.astype(np.int32))
        return [flat(seeds, np.int64), flat(owners, np.int64), flat(places, np.int32)]

    return map_batches(docs, run, "seed long, doc_id long, pos int")


def path_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from each start up to each end, and of their number."""
    return mixed(stretches(hashes, start, end, EDGE_BASE) + (end - start).astype(np.uint64))


PATHS = "path long, doc_id long, pos int, n int, edges array<long>"


def path_rows(marked: DataFrame) -> DataFrame:
    """(path, doc_id, pos, n, edges): runs of n windows from ``pos`` that one seed among ``marks`` stands for."""

    def run(batch):
        paths, owners, places, sizes, found = [], [], [], [], []
        for (doc, words), marks in zip(numbered(batch.column("doc_id"), batch.column("text")), batch.column("marks").to_pylist()):
            hashes = word_hashes(words)
            _, at = picks(hashes)
            repeated = np.zeros(len(hashes), bool)
            repeated[marks] = True
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            n = np.diff(np.concatenate([first, [len(at)]]))
            keep = repeated[at[first]]
            first, n = first[keep], n[keep]
            paths.append(path_hashes(hashes, first, first + n + WORDS - 1).view(np.int64))
            owners.append(np.full(len(first), doc, np.int64))
            places.append(first.astype(np.int32))
            sizes.append(n.astype(np.int32))
            found.append(edges(hashes)[repeated[at]].view(np.int64))
        sizes = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), flat(found, np.int64))
        return [flat(paths, np.int64), flat(owners, np.int64), flat(places, np.int32), pa.array(sizes), lists]

    return map_batches(marked, run, PATHS)


def opened(paths: DataFrame) -> DataFrame:
    """(edge, doc_id, pos) of the windows of paths."""
    parts = paths.select("doc_id", F.col("pos").alias("_p"), F.posexplode("edges").alias("_i", "edge"))
    return parts.select("edge", "doc_id", (F.col("_p") + F.col("_i")).alias("pos"))


def sources(rows: DataFrame, key: str) -> DataFrame:
    """(key, source, at): where each key occurs first, for keys that occur again."""
    first = rows.groupBy(key).agg(F.min(F.struct("doc_id", "pos")).alias("_f"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return first.select(key, F.col("_f.doc_id").alias("source"), F.col("_f.pos").alias("at"))


LATER = "doc_id <> source or pos <> at"


SPAN = ["doc_id", "start", "n", "source", "source_start"]


def compacted(hits: DataFrame) -> DataFrame:
    """Runs of occurrences (doc_id, pos, n, source, at) that go on in the text and at the source.

    Gives (doc_id, start, n windows, source, source_start).
    """

    def run(batch):
        doc, pos, size, source, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "pos", "n", "source", "at"))
        same = (doc[1:] == doc[:-1]) & (source[1:] == source[:-1])
        on = (pos[1:] == pos[:-1] + size[:-1]) & (at[1:] == at[:-1] + size[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~(same & on)]))
        n = np.add.reduceat(size, first).astype(np.int32)
        return [pa.array(doc[first]), pa.array(pos[first]), pa.array(n), pa.array(source[first]), pa.array(at[first])]

    # A document's rows, at most one per word, come together; a run cut by the end of a batch is two spans.
    ordered = hits.repartition("doc_id").sortWithinPartitions("doc_id", "pos")
    return map_batches(ordered, run, "doc_id long, start int, n int, source long, source_start int")


def digests(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, n, digest) of the words under n windows from start, for all rows of ``wanted``."""
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("asked"))

    def run(batch):
        rows = []
        for (doc, words), asked in zip(numbered(batch.column("doc_id"), batch.column("text")), batch.column("asked").to_pylist()):
            for part in asked:
                start, n = part["start"], part["n"]
                words_ = b" ".join(words[start : start + n + WORDS - 1])
                rows.append((doc, start, n, hashlib.blake2b(words_, digest_size=16).digest()))
        columns = list(zip(*rows)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))]

    return map_batches(docs.join(asked, "doc_id"), run, "doc_id long, start int, n int, digest binary")


def checked(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans with ``same``: whether the words at both ends are equal."""
    ends = spans.select("doc_id", "start", "n").unionByName(
        spans.select(F.col("source").alias("doc_id"), F.col("source_start").alias("start"), "n")
    )
    known = scratch.write(digests(docs, ends.distinct()), "digests")
    here = known.withColumnRenamed("digest", "_here")
    there = known.select(F.col("doc_id").alias("source"), F.col("start").alias("source_start"), "n", F.col("digest").alias("_there"))
    both = spans.join(here, ["doc_id", "start", "n"]).join(there, ["source", "source_start", "n"])
    return scratch.write(both.select(*SPAN, (F.col("_here") == F.col("_there")).alias("same")), "checked")


def regrouped(docs: DataFrame, rows: DataFrame, wrong: DataFrame) -> DataFrame:
    """(doc_id, start, n) of repeated windows among edges of ``wrong`` spans, told apart by their words."""
    inside = (rows.doc_id == wrong.doc_id) & (rows.pos >= wrong.start) & (rows.pos < wrong.start + wrong.n)
    hashes = rows.join(wrong, inside, "left_semi").select("edge").distinct()
    again = rows.join(hashes, "edge", "left_semi").select("doc_id", F.col("pos").alias("start"), F.lit(1).alias("n"))
    said = digests(docs, again)
    first = said.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("_f"))
    return said.join(first, "digest").where(F.struct("doc_id", "start") != F.col("_f")).select("doc_id", "start", "n")


def repeated_spans(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, start, n): n consecutive windows from word ``start`` whose words start earlier elsewhere."""
    seeds = scratch.write(seed_rows(docs), "seeds")
    often = scratch.write(seeds.groupBy("seed").count().where("count > 1").select("seed"), "often")
    marks = seeds.join(often, "seed", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))
    marks = scratch.write(marks, "marks")
    scratch.drop(seeds, often)
    paths = scratch.write(path_rows(docs.join(marks, "doc_id")), "paths")
    scratch.drop(marks)
    narrow = paths.select("path", "doc_id", "pos", "n")
    first = scratch.write(sources(narrow, "path"), "first-paths")
    again = scratch.write(narrow.join(first, "path").where(LATER).drop("path"), "later-paths")
    fresh = scratch.write(opened(paths.join(again, ["doc_id", "pos"], "left_anti")), "edges")
    graph = scratch.write(sources(fresh, "edge"), "first-edges")
    inner = fresh.join(graph, "edge").where(LATER).select("doc_id", "pos", F.lit(1).alias("n"), "source", "at")
    hits = scratch.write(again.unionByName(inner), "hits")
    scratch.drop(first, again, fresh, graph)
    spans = scratch.write(compacted(hits), "spans")
    scratch.drop(hits)
    found = checked(docs, spans, scratch)
    good = found.where("same").select("doc_id", "start", "n")
    wrong = found.where("not same")
    if not wrong.isEmpty():
        good = good.unionByName(regrouped(docs, opened(paths), wrong.select("doc_id", "start", "n")))
    else:
        scratch.drop(paths)
    return good


def kept_words(n: int, spans: list) -> np.ndarray:
    """Which of n words no span covers."""
    change = np.zeros(n + 1, np.int64)
    for span in spans or ():
        change[span["start"]] += 1
        change[min(n, span["start"] + span["n"] + WORDS - 1)] -= 1
    return np.cumsum(change[:n]) == 0


def marked(docs: DataFrame, scratch: Scratch) -> DataFrame:
    spans = repeated_spans(docs, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return docs.join(spans, "doc_id", "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document without repeated passages, the kept words joined by one space."""
    scratch = Scratch(docs.sparkSession)
    docs, names = identified(docs, scratch)

    def run(batch):
        out = []
        for (_, words), spans in zip(numbered(batch.column("doc_id"), batch.column("text")), batch.column("spans").to_pylist()):
            keep = kept_words(len(words), spans)
            out.append(b" ".join(w for w, k in zip(words, keep) if k).decode())
        return [batch.column("doc_id"), pa.array(out, pa.string())]

    return restored(map_batches(marked(docs, scratch), run, "doc_id long, text string"), names)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    scratch = Scratch(docs.sparkSession)
    docs, names = identified(docs, scratch)

    def run(batch):
        rows = []
        for (_, words), spans in zip(numbered(batch.column("doc_id"), batch.column("text")), batch.column("spans").to_pylist()):
            keep = kept_words(len(words), spans)
            text = b" ".join(w for w, k in zip(words, keep) if k) if spans else b" ".join(words)
            rows.append((len(words), int((~keep).sum()), hashlib.sha256(text).hexdigest()))
        return [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))]

    return restored(map_batches(marked(docs, scratch), run, "doc_id long, n_words long, n_removed long, kept_sha256 string"), names)
