"""Near duplicates by min-max hashing.

A document's set holds hashes of its distinct word shingles (A-Z in lower case).
Under each hash function both the smallest and the largest value are kept, each
of which agrees between two documents with the probability of their similarity:
two values for one evaluation. Values are banded; documents that share a band
are candidates. Links are confirmed on full sets.

Texts with the same words are one representative from the start, so groups of
copies do not enter the search. In a band not all pairs are formed. Its members
are tested against one leader. Where a band's members are then still in
different components, pairs across components are found by an exact filter on
the full sets (see ``cross_pairs``) and tested. Neither bands nor candidates are
capped. With 24 bands of 3 values a pair at similarity 0.75 shares a band with a
probability above 0.999997.

Defined results: null text, empty text and white space have the empty set and
are linked with nothing (component_id is the own doc_id, kept is true); shorter
texts than a shingle are one shingle; rows that repeat a doc_id or have none are
documents of their own, ordered by (doc_id with null last, text), and exactly
one row of a component is kept. An empty table gives an empty table. Only
``doc_id`` and ``text`` are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from skygrade.llm.common import Scratch, identified, map_batches, map_slices, raw, restored, texts
from skygrade.llm.components import components
from skygrade.llm.shingles import mixed, shingle_set

WORDS, SIMILAR = 5, 75
BANDS, ROWS = 24, 3
FUNCTIONS = BANDS * ROWS // 2
SLICE = 500_000  # shingles hashed at once


def factors(n=FUNCTIONS) -> np.ndarray:
    """Odd multipliers of the hash functions, from a fixed rule."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row per non-empty set: smallest values under all functions, then largest values."""
    out = np.empty((len(sets), 2 * FUNCTIONS), np.uint32)
    sizes = np.array([len(s) for s in sets])
    start = 0
    while start < len(sets):
        end = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:]), SLICE)) + start)
        values, offsets = np.concatenate(sets[start:end]), np.cumsum(sizes[start:end]) - sizes[start:end]
        for i, factor in enumerate(factors()):
            top = ((values * factor) >> np.uint64(32)).astype(np.uint32)
            out[start:end, i] = np.minimum.reduceat(top, offsets)
            out[start:end, FUNCTIONS + i] = np.maximum.reduceat(top, offsets)
        start = end
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One hash per band of a row of values."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes both know ASCII only


SIGNED = "doc_id long, words_key binary, n_shingles long, signature binary"


def signed(docs: DataFrame) -> DataFrame:
    """Key of the word sequence, size of the set and signature (null for an empty set) of each document."""

    def run(batch):
        keys, sizes, rows = [], [], []
        pending = []
        signature = [None] * batch.num_rows

        def flush():
            for place, row in zip([p for p, _ in pending], signatures([s for _, s in pending]) if pending else ()):
                signature[place] = row.tobytes()
            pending.clear()

        load = 0
        for place, text in enumerate(raw(batch.column("text"))):
            words = words_of(text)
            keys.append(xxh3_128_digest(b" ".join(words)))
            found = shingle_set(words, WORDS)
            sizes.append(len(found))
            if len(found):
                pending.append((place, found))
                load += len(found)
            if load > SLICE:
                flush()
                load = 0
        flush()
        return [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signature, pa.binary())]

    return map_slices(docs.select("doc_id", "text"), run, SIGNED)


def band_rows(representatives: DataFrame) -> DataFrame:
    """(rep, band): a row per representative and band, the number of the band inside its hash."""

    def run(batch):
        all_ = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, 2 * FUNCTIONS)
        found = bands(all_).view(np.int64)
        return [pa.array(np.repeat(batch.column("rep").to_numpy(zero_copy_only=False), BANDS)), pa.array(found.ravel())]

    return map_batches(representatives.select("rep", "signature"), run, "rep long, band long")


def sets_of(docs: DataFrame) -> DataFrame:
    """(rep, shingles): full sets as arrays of 64-bit hashes."""

    def run(batch):
        sets = [shingle_set(words_of(text), WORDS).view(np.int64) for text in raw(batch.column("text"))]
        return [batch.column("rep"), pa.array(sets, pa.list_(pa.int64()))]

    return map_slices(docs.select("rep", "text"), run, "rep long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    own = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("_sa"))
    other = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    both = pairs.join(own, "a").join(other, "b").withColumn("_common", common)
    union = F.size("_sa") + F.size("_sb") - F.col("_common")
    return both.where(100 * F.col("_common") >= SIMILAR * union).select("a", "b")


def cross_pairs(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """All pairs (a, b) of different components that can reach the similarity, by an exact filter.

    Shingles are ordered from rare to frequent. Sets that reach the similarity
    share one of the first quarter (and one) of either, and the first they share
    bounds what they have in common by what follows it. Only rows outside a
    shingle's largest component look for partners, so a large linked group is
    not compared with itself.
    """
    found = sets.join(members, "rep").select("rep", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    found = scratch.write(found, "open-shingles")
    ranked = found.join(found.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("df", "s")) - 1
    prefix = ranked.withColumn("at", place).where(f"df > 1 and at <= n - (n * {SIMILAR} + 99) div 100")
    prefix = scratch.write(prefix.select("s", "rep", "comp", "n", "at"), "prefixes")
    per = prefix.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed_ = per.groupBy("s").agg(F.max(F.struct("k", "comp")).alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rows = prefix.join(mixed_.select("s", F.col("m.comp").alias("main")), "s")
    seek = rows.where("comp <> main").select("s", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("at").alias("ia"))
    all_ = rows.select("s", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
    most = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
    enough = 100 * most >= SIMILAR * (F.col("na") + F.col("nb") - most)
    pairs = seek.join(all_, (seek.s == all_.s) & (F.col("ca") != F.col("cb")) & enough)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def labelled(buckets: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of bands with their component so far."""
    if labels is None:
        return buckets.withColumn("comp", F.col("rep"))
    found = labels.select(F.col("a").alias("rep"), F.col("b").alias("_c"))
    return buckets.join(found, "rep", "left").select("band", "rep", F.coalesce("_c", "rep").alias("comp"))


def leader_pairs(buckets: DataFrame) -> DataFrame:
    """Every member of a band with the band's leader: who shares the most bands with the most others."""
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("_n"))
    weights = buckets.join(sizes, "band").groupBy("rep").agg(F.sum("_n").alias("_w"))
    lead = buckets.join(weights, "rep").groupBy("band").agg(F.min(F.struct(-F.col("_w"), "rep")).alias("_l"))
    pairs = buckets.join(lead.select("band", F.col("_l.rep").alias("_lead")), "band").where("rep <> _lead")
    return pairs.select(F.least("rep", "_lead").alias("a"), F.greatest("rep", "_lead").alias("b")).distinct()


def linked(buckets: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Components of the representatives: each with the smallest of its component, where that is another."""
    first = scratch.write(confirmed(leader_pairs(buckets), sets), "links")
    labels = components(first, scratch)
    members = scratch.write(labelled(buckets, labels), "labelled")
    spread = members.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi")
    open_ = members.join(spread.select("band"), "band", "left_semi").select("rep", "comp").distinct()
    pairs = scratch.write(cross_pairs(open_, sets, scratch), "pairs")
    return components(first.unionByName(confirmed(pairs, sets)), scratch)


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession)
    docs, names = identified(docs, scratch)
    all_ = scratch.write(signed(docs), "signed")
    # One representative per word sequence; copies only meet again when components are handed out.
    groups = all_.where("n_shingles > 0").groupBy("words_key").agg(F.min("doc_id").alias("rep"), F.first("signature").alias("signature"))
    groups = scratch.write(groups, "representatives")
    rows = scratch.write(band_rows(groups), "bands")
    shared = rows.groupBy("band").count().where("count > 1").select("band")
    buckets = scratch.write(rows.join(shared, "band", "left_semi"), "buckets")
    scratch.drop(rows)

    wanted = buckets.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.write(sets_of(docs.join(wanted, "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")), "sets")
    labels = linked(buckets, sets, scratch)

    place = groups.select("words_key", "rep").join(labels.select(F.col("a").alias("rep"), "b"), "rep", "left")
    place = place.select("words_key", F.coalesce("b", "rep").alias("component_id"))
    named = all_.join(place, "words_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    if names is not None:
        first = names.select(F.col("_id").alias("component_id"), F.col("_doc").alias("_first"))
        kept = F.col("doc_id") == F.col("component_id")
        named = named.withColumn("kept", kept).join(first, "component_id")
        named = restored(named.select("doc_id", "n_shingles", F.col("_first").alias("component_id"), "kept"), names)
        return named
    return named.withColumn("kept", F.col("doc_id") == F.col("component_id"))
