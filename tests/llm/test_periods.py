import hashlib
import random
import zlib

import pytest
from fixtures_llm import AWKWARD, bag, empty, frame, read
from hypothesis import given, settings
from hypothesis import strategies as st

from skygrade.llm import periods
from skygrade.llm.queries import op12_periodic_runs

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period by itself; a stretch counts at its smallest."""
    n, found = len(words), []
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(6, 4 * p):
                stretch = words[i : j + p]
                if not any(stretch[q:] == stretch[:-q] for q in range(1, p)):
                    found.append((i, j - i + p, p))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(0, 40), st.integers(1, 9), st.integers(0, 60))
def test_runs_equal_plain_search(words, at, period, n):
    words = words[:at] + (words[at : at + period] * 60)[:n] + words[at:]
    assert periods.find_runs(words) == plain_runs(words)


def test_nested_and_overlapping_runs():
    inner = [b"a"] * 7 + [b"b"]
    words = inner * 5 + [b"c"] + [b"x", b"y", b"z"] * 4 + [b"x", b"y"] * 4
    assert periods.find_runs(words) == plain_runs(words)
    assert (0, 40, 8) in periods.find_runs(words) and (8, 7, 1) in periods.find_runs(words)


def test_many_distinct_words_and_long_periods():
    pick = random.Random(3)
    unit = [b"%d" % pick.randrange(10**9) for _ in range(5000)]
    words = [b"head"] + unit * 5 + unit[:17] + [b"tail"]
    assert periods.find_runs(words) == [(1, 25_017, 5000)]
    assert periods.find_runs([b"a"] * 50_000) == [(0, 50_000, 1)]


def expected(doc, text, rewrite):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if rewrite and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        doc,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_plain_search(spark):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    result = op12_periodic_runs(spark, FOLDER)
    assert result.columns == names
    # Plain search takes the square of a text's length.
    short = {r[0]: r[1] for r in read(FOLDER, "documents") if len((r[1] or "").split()) <= 1500}
    found = {r.doc_id: tuple(r) for r in result.collect()}
    assert len(found) == 200 and len(short) > 150
    assert all(found[doc] == expected(doc, text, True) for doc, text in short.items())
    assert sum(found[doc][1] for doc in short) > 3


def test_awkward_rows(spark):
    loop = "one two three " * 9
    docs = frame(spark, [*AWKWARD, (20, loop), (20, loop), (21, loop.upper()), (None, "a " * 6), (23, "a " * 5)])
    rows = bag(periods.run_digests(docs), "doc_id", "n_runs", "period")
    assert len(rows) == len(AWKWARD) + 5
    assert [r for r in rows if r[1]] == [(20, 1, 3), (20, 1, 3), (21, 1, 3), (None, 1, 1)]
    assert bag(periods.periodic_runs(docs), "doc_id", "start", "length", "period")[0] == (20, 0, 27, 3)
    texts = {r.doc_id: r.text for r in periods.collapse(docs).collect()}
    assert texts[20] == "one two three" and texts[23] == "a a a a a" and texts[7] == "" and texts[13] == "One Two"


def test_planting_leaves_missing_ids_alone(spark):
    docs = frame(spark, [(None, "a b c d e f g h i j k l")])
    assert periods.run_digests(docs, periods.planted).first().n_runs == 0


@pytest.mark.parametrize("fn", [periods.run_digests, periods.periodic_runs, periods.collapse])
def test_empty_table(spark, fn):
    assert fn(empty(spark)).collect() == []
