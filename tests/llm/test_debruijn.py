import hashlib
import random

import numpy as np
import pytest
from fixtures_llm import AWKWARD, LONG, bag, empty, frame, read, without_repeats

from skygrade.llm import debruijn
from skygrade.llm.common import Scratch
from skygrade.llm.shingles import word_hashes

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def expected(rows):
    """Rows that repeat a doc_id or have none follow one another by text."""
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    kept = without_repeats([(p, text) for p, (_, text) in enumerate(order)])
    out = []
    for p, (i, text) in enumerate(order):
        n = len((text or "").encode().split())
        out.append((i, n, n - len(kept[p]), hashlib.sha256(b" ".join(kept[p])).hexdigest()))
    return sorted(out, key=repr)


def test_whole_small_table(spark):
    folder = "/root/testdata/sf0.001"
    got = bag(debruijn.repeat_digests(spark.read.parquet(f"{folder}/documents.parquet")), *COLUMNS)
    assert got == expected([(r[0], r[1]) for r in read(folder, "documents")])
    assert any(r[2] for r in got)


def test_awkward_rows(spark):
    rows = [*AWKWARD, (1, "x " * 500), (2, "a b " * 30 + "c " * 19), (30, LONG[5000:9000])]
    assert bag(debruijn.repeat_digests(frame(spark, rows)), *COLUMNS) == expected(rows)
    assert debruijn.repeat_digests(empty(spark)).collect() == []


@pytest.mark.parametrize("letters", [2, 3, 40])
def test_dense_repetition(spark, letters):
    pick = random.Random(letters)
    rows = []
    for i in range(40):
        text = [str(pick.randrange(letters)) for _ in range(pick.randrange(80))]
        if rows and pick.random() < 0.6:
            other = pick.choice(rows)[1].split()
            at = pick.randrange(len(text) + 1)
            text[at:at] = other[pick.randrange(len(other) + 1) :][: pick.randrange(15, 40)]
        rows.append((i, " ".join(text)))
    assert bag(debruijn.repeat_digests(frame(spark, rows)), *COLUMNS) == expected(rows)


def test_short_runs_anywhere(spark):
    """Equal windows that overlap, over places where the number of a place has its last six bits at zero and elsewhere."""
    rows = []
    for length in range(20, 33):
        for offset in range(40, 71):
            i = len(rows)
            run = [f"ha{i}", f"he{i}", f"hi{i}"][: 1 + i % 3] * 32
            rows.append((i, " ".join([*(f"a{i}.{k}" for k in range(offset)), *run[: length + 4 * (i % 3)], *(f"z{i}.{k}" for k in range(i % 40))])))
    assert bag(debruijn.repeat_digests(frame(spark, rows)), *COLUMNS) == expected(rows)


def test_the_first_of_equal_seeds_is_picked():
    for offset in range(70):
        hashes = word_hashes([*(b"%d" % k for k in range(offset)), *[b"ha"] * 40])
        seeds, at = debruijn.picks(hashes)
        assert at.tolist() == [p + int(np.argmin(seeds[p : p + 13])) for p in range(len(at))]


def test_texts_come_out_without_repeats(spark):
    rows = [(1, " ".join(map(str, range(60)))), (2, "a " + " ".join(map(str, range(30, 55))) + " b")]
    assert bag(debruijn.remove_repeats(frame(spark, rows)), "doc_id", "text") == [(1, " ".join(map(str, range(60)))), (2, "a b")]


def test_equal_windows_are_represented_alike():
    pick = random.Random(9)
    a = [str(pick.randrange(5)) for _ in range(300)]
    hashes = word_hashes([w.encode() for w in a])
    seeds, at = debruijn.picks(hashes)
    assert len(at) == 281 and all(p <= q <= p + 12 for p, q in enumerate(at))
    assert all(seeds[q] == seeds[p : p + 13].min() for p, q in enumerate(at))
    fewer, inner = debruijn.picks(hashes[100:200])
    assert (fewer[inner] == seeds[at[100:181]]).all()
    assert len(debruijn.picks(hashes[:19])[1]) == 0 and len(debruijn.picks(hashes[:20])[1]) == 1


def test_paths_compact_and_split_where_the_source_changes(spark):
    rows = [(7, p, 1, 1, p + 5) for p in range(10, 20)] + [(7, 20, 5, 1, 25), (7, 25, 2, 1, 30)] + [(7, p, 1, 2, p) for p in range(27, 30)]
    rows += [(8, 4, 1, 1, 9), (8, 6, 1, 1, 11), (8, 7, 2, 1, 13)]
    hits = spark.createDataFrame(rows, "doc_id long, pos int, n int, source long, at int").repartition(3)
    want = [(7, 10, 17, 1, 15), (7, 27, 3, 2, 27), (8, 4, 1, 1, 9), (8, 6, 1, 1, 11), (8, 7, 2, 1, 13)]
    assert bag(debruijn.compacted(hits), *debruijn.SPAN) == want


def test_stretches_are_told_by_their_words_and_length():
    hashes = word_hashes([str(i % 7).encode() for i in range(100)])
    of = lambda a, b: int(debruijn.path_hashes(hashes, np.array([a]), np.array([b]))[0])
    assert of(3, 30) == of(10, 37) == of(73, 100)
    assert len({of(a, b) for a in range(7) for b in range(a + 20, a + 30)}) == 70


def test_spans_with_differing_ends_are_grouped_again_by_their_words(spark):
    text = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([(1, text), (2, "x " + text), (3, " ".join(f"y{i}" for i in range(31)))], "doc_id long, text string")
    # As if hashes had collided: 3 claims to repeat 1.
    spans = spark.createDataFrame([(2, 1, 11, 1, 0), (3, 0, 11, 1, 0)], "doc_id long, start int, n int, source long, source_start int")
    found = debruijn.checked(docs, spans, Scratch(spark))
    assert bag(found, "doc_id", "same") == [(2, True), (3, False)]
    rows = [(e, d, p + (d == 2)) for d in (1, 2, 3) for p, e in enumerate(range(11))]
    edges = spark.createDataFrame(rows, "edge long, doc_id long, pos int")
    again = debruijn.regrouped(docs, edges, found.where("not same").select("doc_id", "start", "n"))
    assert bag(again, "doc_id", "start", "n") == sorted(((2, p + 1, 1) for p in range(11)), key=repr)


def test_kept_words():
    assert np.flatnonzero(debruijn.kept_words(45, [{"start": 2, "n": 1}, {"start": 20, "n": 3}])).tolist() == [0, 1, 42, 43, 44]
    assert debruijn.kept_words(3, None).all() and len(debruijn.kept_words(0, None)) == 0
