"""Benchmark passages inside documents, found by edit distance on words.

Windows as long as an item are embedded by a random walk (Chakraborty, Goldenberg
and Koucky): it copies the word it stands on at every step and moves on or stays
by a random bit of step and word, which turns edits into few differing places. Under
several walks, a few sampled places make a key; windows and items that share a
key are compared by exact edit distance, free at both ends of the window.

Places that differ add up with the length, so items of more than 50 words are
looked for by pieces of 25 to 50. A fifth of an item's words cannot be edited without
one of its pieces having at most a fifth of its own edited: the recall of short
items holds for long ones. Every piece met is checked by the edit distance of the whole item.

Before a window is embedded, its three-word sequences are looked up in bitmaps
of those of all pieces and of the pieces of its length. A passage within ``k`` edits of a piece of ``L`` words
keeps at least ``L - 2 - 3k`` of them, so no passage is lost there. The bitmaps
have a fixed size whatever the number of items: with very many they only filter less.

An item matches where at most a fifth of its words are edited; one of five words
only without edits, since one can leave no sequence of it. Items of fewer
than five words match nothing: they occur by chance.

Defined results: null or empty texts and items match nothing; words are compared
with A-Z in lower case; equal items each match; rows that repeat a doc_id add to
the same document and those without one are left out of the matches; empty
tables give an empty table. Only doc_id and text, item_id and text are read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from skygrade.llm.common import Scratch, as_batches, map_batches, raw, texts
from skygrade.llm.shingles import mixed, runs, word_hashes

SHARE = 0.2  # words of an item that may be edited
SHORTEST = 5
PIECE = 50  # words of a piece, at most
GRAM = 3
SLOTS = 1 << 22  # bits of the bitmap
WALKS = 12
KEYS_PER_WALK = 2
PLACES = 3  # sampled places of a key
TEXTS_AT_ONCE = 200
WORDS_AT_ONCE = 100_000  # words of the windows that wait to be embedded, for each length of items


def tolerance(length: int) -> int:
    """Edits allowed for an item; where the filter could not tell anything, fewer."""
    return max(0, min(int(SHARE * length), (length - GRAM) // GRAM))


def needed(length: int) -> int:
    return length - GRAM + 1 - GRAM * tolerance(length)


def pieces(length: int) -> list[tuple[int, int]]:
    """(offset, words) of the pieces of an item, as equal as can be; a short item is one piece."""
    count = -(-length // PIECE)
    bounds = [length * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def step_of(whole: int) -> int:
    """Words by which places of an item are told apart before the edit distance is taken."""
    return 1 if whole <= PIECE else tolerance(whole)


def words_of(text: bytes) -> np.ndarray:
    return word_hashes(text.lower().split())


def slots(grams: np.ndarray, length=0) -> np.ndarray:
    """Places of hashed sequences in the bitmap of all items, or of items of one length."""
    if length:
        grams = mixed(grams + np.uint64(length))
    return (grams & np.uint64(SLOTS - 1)).astype(np.int64)


def embed(words: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """Words met by one walk over each row of ``words``; 0 beyond the end."""
    rows, length = words.shape
    padded = np.concatenate([words, np.zeros((rows, 1), np.uint64)], axis=1).ravel()
    at = np.arange(rows) * (length + 1)
    last = at + length
    out = np.empty((rows, steps), np.uint64)
    for step in range(steps):
        if step % 64 == 0:  # each word has 64 bits for the next 64 steps
            bits = mixed(padded ^ mixed(np.array([walk << 20 | step], np.uint64)))
        out[:, step] = padded[at]
        at = np.minimum(at + ((bits[at] >> np.uint64(step % 64)) & np.uint64(1)).astype(np.int64), last)
    return out


def keys(words: np.ndarray) -> np.ndarray:
    """LSH keys of rows of equal length: for each walk, hashes of sampled places of its embedding."""
    rows, length = words.shape
    out = np.empty((rows, WALKS * KEYS_PER_WALK), np.uint64)
    for walk in range(WALKS):
        # A walk needs about 2 steps a word, so places are sampled from so many steps.
        met = embed(words, walk, 2 * length)
        for k in range(KEYS_PER_WALK):
            number = walk * KEYS_PER_WALK + k
            sampled = np.random.default_rng([length, number]).choice(2 * length, PLACES, replace=False)
            key = np.full(rows, length * 4096 + number, np.uint64)
            for place in sampled:
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + met[:, place])
            out[:, number] = key
    return out


def edits(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the region, and where the first such stretch ends."""
    places = np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, np.int64)
    for i, word in enumerate(item):
        step = row + 1
        step[1:] = np.minimum(step[1:], row[:-1] + (region != word))
        step[0] = i + 1
        row = np.minimum.accumulate(step - places) + places
    return int(row.min()), int(row.argmin())


ITEMS = "item_id long, whole int, words array<long>"


def prepared(benchmark: DataFrame) -> DataFrame:
    """Items, their numbers of words and word hashes."""

    def run(batch):
        found = [words_of(text).view(np.int64) for text in raw(batch.column("text"))]
        return [batch.column("item_id"), pa.array([len(w) for w in found], pa.int32()), pa.array(found, pa.list_(pa.int64()))]

    given = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(given, run, ITEMS).where(F.col("whole") >= SHORTEST)


PIECES = "item_id long, whole int, offset int, length int, step int, before int, after int, words array<long>, keys array<long>"


def cut_items(items: DataFrame) -> DataFrame:
    """Pieces of the items with their places, word hashes and keys, and the words before and from a piece that its item may take."""

    def run(batch):
        rows = []
        for item, words in zip(batch.column("item_id").to_pylist(), batch.column("words")):
            hashes = words.values.to_numpy(zero_copy_only=False)
            for offset, size in pieces(len(hashes)):
                own, whole = hashes[offset : offset + size], len(hashes)
                edge = tolerance(whole) + step_of(whole) - 1
                reach = offset + edge, whole - offset + edge
                rows.append((item, whole, offset, size, step_of(whole), *reach, own, keys(own.view(np.uint64)[None, :])[0].view(np.int64)))
        columns = list(zip(*rows)) or [()] * 9
        kinds = [pa.int64(), *[pa.int32()] * 6, *[pa.list_(pa.int64())] * 2]
        return [pa.array(list(c), t) for c, t in zip(columns, kinds)]

    return map_batches(items, run, PIECES)


def reaches(cut: DataFrame) -> dict[int, tuple[int, int]]:
    """For each length of pieces, at most 46 of them, how far any of their items may reach before and from a piece's start."""
    return {r[0]: (r[1], r[2]) for r in cut.groupBy("length").agg(F.max("before"), F.max("after")).collect()}


def bitmaps(cut: DataFrame) -> np.ndarray:
    """Bits of the pieces' word sequences, alone and with the length; at most 2 * SLOTS numbers reach the driver."""

    def run(batch):
        found = []
        for words in batch.column("words").to_pylist():
            grams = runs(np.array(words, np.int64).view(np.uint64), GRAM)
            found += [slots(grams), slots(grams, len(words)) + SLOTS]
        return [np.unique(np.concatenate(found)).astype(np.int32)]

    used = map_batches(cut.select("words"), run, "slot int").distinct().toPandas()["slot"].to_numpy()
    bits = np.zeros(2 * SLOTS, bool)
    bits[used] = True
    return np.packbits(bits)


def starts(hits: np.ndarray, n: int, length: int) -> np.ndarray:
    """Starts of all windows of ``length`` words with enough known sequences.

    None is left out for a better one nearby: that may be of another item.
    """
    need, k = needed(length), tolerance(length)
    last = max(n - (length - k), 0)  # a passage may have lost words at a text's end
    total = np.concatenate([[0], np.cumsum(hits)])
    begin = np.arange(last + 1)
    count = total[np.minimum(begin + length - GRAM + 1, len(hits))] - total[np.minimum(begin, len(hits))]
    return np.flatnonzero(count >= need)


WINDOWS = "doc_id long, part long, start int, length int, first int, region array<long>, keys array<long>"


def windows(docs: DataFrame, packed: np.ndarray, reach: dict[int, tuple[int, int]]) -> DataFrame:
    """Windows as long as pieces that pass the filter, with their keys and the words from ``first`` on that an item may take.

    ``part`` tells texts apart that share a doc_id.
    """
    lengths = sorted(reach)
    names = [part.split()[0] for part in WINDOWS.split(", ")]
    least = min(map(needed, lengths), default=1)

    def run(batches):
        bits = np.unpackbits(packed).astype(bool)
        for batch in batches:
            found = {length: [] for length in lengths}
            ids = iter(batch.column("doc_id").to_pylist())
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                for text in raw(batch.column("text").slice(at, TEXTS_AT_ONCE)):
                    doc = next(ids)
                    hashes = words_of(text) if doc is not None else np.empty(0, np.uint64)
                    part = None
                    for length, start in candidates(hashes, bits[:SLOTS], bits[SLOTS:]):
                        part = np.uint64(xxh3_64_intdigest(hashes.tobytes())).view(np.int64) if part is None else part
                        before, after = reach[length]
                        first = max(0, start - before)
                        window = np.zeros(length, np.uint64)
                        window[: len(hashes) - start] = hashes[start : start + length]
                        region = hashes[first : start + after].view(np.int64).copy()
                        found[length].append((doc, part, start, first, region, window))
                        if len(found[length]) * (before + after) >= WORDS_AT_ONCE:
                            yield from embedded(length, found[length])
                            found[length] = []
            for length, rows in found.items():
                if rows:
                    yield from embedded(length, rows)

    def embedded(length, rows):
        doc, part, start, first, region, window = zip(*rows)
        longs = pa.list_(pa.int64())
        own = pa.array(list(keys(np.stack(window)).view(np.int64)), longs)
        sizes = pa.array([length] * len(rows), pa.int32())
        places = [pa.array(start, pa.int32()), sizes, pa.array(first, pa.int32())]
        return as_batches([pa.array(doc, pa.int64()), pa.array(part, pa.int64()), *places, pa.array(region, longs), own], names)

    def candidates(hashes, of_any, of_length):
        grams = runs(hashes, GRAM)
        at = np.flatnonzero(of_any[slots(grams)])
        if len(at) < least:
            return
        for length in lengths:
            own, need = at[of_length[slots(grams[at], length)]], needed(length)
            if len(own) >= need and (own[need - 1 :] - own[: len(own) - need + 1]).min() < length:
                hits = np.zeros(len(grams), bool)
                hits[own] = True
                for start in starts(hits, len(hashes), length).tolist():
                    yield length, start

    return texts(docs).mapInArrow(run, WINDOWS)


MATCHES = "doc_id long, item_id long, start int, edits int"


def confirmed(pairs: DataFrame) -> DataFrame:
    """Items and places whose exact edit distance to the words around there is within the item's tolerance."""

    def run(batch):
        rows = []
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "item_id", "place", "words", "first", "region"))
        for doc, item, place, words, first, region in zip(*columns):
            whole = len(words)
            k = tolerance(whole)
            low = max(0, place - k)
            around = np.array(region[max(0, low - first) : max(0, place + whole + k + step_of(whole) - 1 - first)], np.int64)
            least, end = edits(np.array(words, np.int64), around)
            if least <= k:
                rows.append((doc, item, max(0, max(low, first) + end - whole), least))
        columns = list(zip(*rows)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]

    return map_batches(pairs, run, MATCHES)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, edits (the least), start (about where, in words)."""
    scratch = Scratch(docs.sparkSession)
    items = scratch.write(prepared(benchmark), "items")
    cut = scratch.write(cut_items(items), "pieces")
    found = scratch.write(windows(docs, bitmaps(cut), reaches(cut)), "windows")
    by_key = lambda df, *columns: df.select(*columns, F.explode("keys").alias("key"))
    # The items' side is broadcast by Spark only while its size is below Spark's threshold; else both sides are shuffled.
    pairs = by_key(found, "doc_id", "part", "start", "length").join(by_key(cut, "item_id", "whole", "offset", "step"), "key")
    # Pieces that say the same place of an item are one candidate.
    place = F.expr("cast(floor((start - offset) / step) * step as int)").alias("place")
    window = F.min(F.struct("start", "length")).alias("_w")
    candidates = pairs.groupBy("doc_id", "part", "item_id", "whole", place).agg(window).select("*", "_w.*").drop("_w")
    spots = ["doc_id", "part", "start", "length"]
    full = candidates.join(found.select(*spots, "first", "region").dropDuplicates(spots), spots)
    full = full.join(items.select("item_id", "whole", "words"), ["item_id", "whole"])
    best = F.min(F.struct("edits", "start")).alias("_b")
    return confirmed(full).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "_b.edits", "_b.start")
