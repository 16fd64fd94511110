"""Stretches of a text that repeat one period of words again and again.

The suffixes of a document's words are sorted by prefix doubling, and the links
between neighbours, weighted by their common prefix, are united from the longest
prefix down, as Kruskal's algorithm does. Each class keeps its positions in
order. Two positions that become neighbours in a class, no further apart than
their common prefix, seed a run whose smallest period is their distance: a closer
pair would have met earlier. The seed at a run's first word gives the whole run,
so each is found once. Suffixes that share fewer words than a run needs
(``shortest - 1``) are never united.

Defined results: null and empty texts have no words and no runs; a document is
judged by itself, so ties, repeated rows and missing ids change nothing; an empty
table gives an empty table. Only ``doc_id`` and ``text`` are read, other columns
cannot clash. A document has to fit in a task; there is no shuffle.
"""

import hashlib
import zlib
from bisect import bisect_left, insort
from itertools import compress, count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygrade.llm.common import as_batches, raw, slices

TIMES, SHORTEST = 4, 6  # a run has at least max(SHORTEST, TIMES * period) words


def numbered(words: list[bytes]) -> tuple[np.ndarray, int]:
    """Number of each word, equal words alike, from 1, and the largest number."""
    numbers = dict(zip(dict.fromkeys(words), count(1)))
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), len(numbers)


def common_prefixes(ids: np.ndarray, largest: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and what each has in common with the next, for those that share ``least`` words with any."""
    n, bits = len(ids), largest.bit_length()
    k = min(least, 63 // bits)
    ahead = np.concatenate([ids, np.zeros(k, np.int64)])
    key = ahead[:n]
    for i in range(1, k):
        key = (key << bits) | ahead[i : n + i]
    in_order = np.sort(key)
    if n < 2 or not (in_order[1:] == in_order[:-1]).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # A suffix's rank is the number of suffixes before all that share its first k words.
    rank = np.searchsorted(in_order, key).astype(np.int32)
    size = np.bincount(rank, minlength=n)
    found = active = np.flatnonzero(size[rank] > 1)
    levels = [(k, rank)]
    while len(active):
        after = active + k
        inside = after < n
        second = np.where(inside, rank[np.where(inside, after, 0)].astype(np.int64) + 1, 0)
        key = rank[active].astype(np.int64) * (n + 1) + second
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        places = np.arange(len(active))
        first = np.concatenate([[True], key[1:] != key[:-1]])
        outer = np.concatenate([[True], key[1:] // (n + 1) != key[:-1] // (n + 1)])
        start = np.maximum.accumulate(np.where(first, places, 0))
        held = rank[active]
        rank = rank.copy()
        rank[active] = held + start - np.maximum.accumulate(np.where(outer, places, 0))
        k *= 2
        levels.append((k, rank))
        alone = first & np.concatenate([first[1:], [True]])
        active = active[~alone]
    suffixes = found[np.argsort(rank[found], kind="stable")]
    a, b = suffixes[:-1].copy(), suffixes[1:].copy()
    far = np.concatenate([ids, [0]])  # what follows the last word differs from every word; of two suffixes one ends first
    for k, rank in reversed(levels):
        at = np.flatnonzero(np.maximum(a, b) < n)
        at = at[rank[a[at]] == rank[b[at]]]
        a[at] += k
        b[at] += k
    for _ in range(levels[0][0] - 1):
        same = far[np.minimum(a, n)] == far[np.minimum(b, n)]
        a += same
        b += same
    return suffixes, a - suffixes[:-1]


def united(ids: list[int], suffixes: np.ndarray, prefixes: np.ndarray, times: int, shortest: int) -> list[tuple[int, int, int]]:
    """Runs as (start, length, period), from the classes of suffixes united by falling common prefix."""
    links = np.flatnonzero(prefixes >= shortest - 1)
    links = links[np.argsort(-prefixes[links], kind="stable")]
    weights, links = prefixes[links].tolist(), links.tolist()
    classes = [[p] for p in suffixes.tolist()]
    parent = list(range(len(classes)))
    n, runs = len(ids), set()

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    at = 0
    while at < len(links):
        common, moved = weights[at], []
        while at < len(links) and weights[at] == common:
            a, b = root(links[at]), root(links[at] + 1)
            if len(classes[a]) < len(classes[b]):
                a, b = b, a
            parent[b], small, large = a, classes[b], classes[a]
            if 8 * len(small) < len(large):
                for p in small:
                    insort(large, p)
            else:
                large += small
                large.sort()
            classes[b] = None
            moved.append((a, small))
            at += 1
        # Only now is it known which positions of this level are next to each other.
        for a, small in moved:
            positions = classes[root(a)]
            for p in small:
                i = bisect_left(positions, p)
                for one in (i - 1, i):
                    if 0 <= one < len(positions) - 1:
                        start, again = positions[one], positions[one + 1]
                        period = again - start
                        if (
                            (times - 1) * period <= common
                            and period + common >= shortest
                            and (not start or ids[start - 1] != ids[again - 1])
                            and (again + common == n or ids[start + common] != ids[again + common])
                        ):
                            runs.add((start, common + period, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def find_runs(words: list[bytes], times=TIMES, shortest=SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run, by start, then period: ``times`` periods and ``shortest`` words at least."""
    if len(words) < shortest:
        return []
    ids, largest = numbered(words)
    suffixes, prefixes = common_prefixes(ids, largest, shortest - 1)
    return united(ids.tolist(), suffixes, prefixes, times, shortest) if len(suffixes) else []


def without_runs(words: list[bytes], runs) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return list(compress(words, keep))


def strongest(runs) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equal ones the first."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def _documents(docs: DataFrame, fn, schema: str, rewrite=None) -> DataFrame:
    """``fn`` gives the rows of one document from its id, its words and its runs."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[part.split()[1]] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            ids = iter(batch.column("doc_id").to_pylist())
            for block in slices(raw(batch.column("text"))):
                rows = []
                for text in block:
                    doc, words = next(ids), text.split()
                    words = rewrite(doc, words) if rewrite else words
                    rows += fn(doc, words, find_runs(words))
                if rows:
                    yield from as_batches([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInArrow(run, schema)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period (in words): one row for each run of each document."""
    rows = lambda doc, words, runs: [(doc, *run) for run in runs]
    return _documents(docs, rows, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id and text, of each run only its first period, words joined by one space."""
    rows = lambda doc, words, runs: [(doc, b" ".join(without_runs(words, runs)).decode())]
    return _documents(docs, rows, "doc_id long, text string")


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The repetitions that the query puts into a tenth of the documents; none where the id is missing."""
    h = zlib.crc32(b"%d" % doc) if doc is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + period]
    return words[:a] + (unit * ((n - a) // period + 1))[: n - a]


def run_digests(docs: DataFrame, rewrite=None) -> DataFrame:
    """Per document: n_runs, its strongest run, and digests of all runs and of the collapsed text."""

    def rows(doc, words, runs):
        best = strongest(runs)
        shown = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else repeat(None, 4)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
        kept = b" ".join(without_runs(words, runs))
        return [(doc, len(runs), *shown, hashlib.sha256(listed).hexdigest(), hashlib.sha256(kept).hexdigest())]

    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _documents(docs, rows, schema, rewrite)
