import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from fixtures_llm import AWKWARD, empty, frame, read
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skygrade.llm import packing
from skygrade.llm.queries import op13_best_fit_packing

FOLDER = "/root/testdata/sf0.01"


@cache
def tokenizer():
    return Tokenizer.from_file(packing.TOKENIZER)


@cache
def encoder():
    return packing.Encoder(tokenizer().to_str())


@pytest.fixture
def whole():
    return tokenizer()


def ids_of(whole, text):
    return [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def gapless(rows, capacity=2048):
    """{sequence: pieces in order}; every sequence is filled from 0 without a gap and not beyond its capacity."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for spots in held.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return held


def test_query(spark, whole):
    result = op13_best_fit_packing(spark, FOLDER)
    assert result.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = result.collect()
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    expected, tokens = {}, 0
    for doc, text, *_ in read(FOLDER, "documents"):
        ids = np.array(ids_of(whole, text), "<u4")
        tokens += len(ids)
        first = len(ids) % 2048 or 2048 if len(ids) > 2048 else len(ids)
        for piece, end in enumerate(range(first, len(ids) + 1, 2048)):
            start = max(0, end - (2048 if piece else first))
            expected[doc, piece] = (start, end - start, zlib.crc32(ids[start:end].tobytes()))
    assert len(rows) == len(found) and found == expected
    assert len(gapless(rows)) <= 1.002 * tokens / 2048 + 1


@pytest.mark.parametrize("cut", [1, 40])
def test_number_of_sequences_hardly_depends_on_the_tasks(spark, cut):
    sizes = [(i * 7919) % 2000 + 1 for i in range(20_000)]
    parts = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id long, length long").repartition(cut)
    held = gapless(packing.pack(parts).collect())
    assert sum(map(len, held.values())) == 20_000
    assert len(held) <= 1.004 * sum(sizes) / 2048 + 1


def test_several_levels_and_few_open_bins(spark):
    parts = spark.range(3000).selectExpr("id", "100 + (id * 7919) % 1500 length", "'x' bin", "'x' place", "'x' item").repartition(12)
    rows = packing.pack(parts, open_bins=4, buffer=16, task_pieces=300, task_bins=8).collect()
    held = gapless(rows)
    assert sorted(r.id for r in rows) == list(range(3000)) and {r.bin for r in rows} == {"x"}
    assert len(held) < 1.4 * sum(r.length for r in rows) / 2048


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_with_bounded_space(sizes, most):
    bins, plain = packing.Bins(50, most, 0), []  # plain: (free space, bin, order of opening) of open bins
    for size in sizes:
        number, place = bins.put(size)
        fitting = [f for f, _ in plain if f >= size]
        free = min(fitting) if fitting else 50
        assert place == 50 - free
        if fitting:
            assert (free, number) in plain
            plain.remove((free, number))
        else:
            assert number not in {n for _, n in plain}
        if free > size:
            plain.append((free - size, number))
        if len(plain) > most:
            gone = set(plain) - {(50 - n, b) for b, n in bins.left()}
            assert len(gone) == 1 and min(plain)[0] == min(gone)[0]
            plain.remove(*gone)
        assert sorted((50 - n, b) for b, n in bins.left()) == sorted(plain)


ODD = [
    "it's fine's", "a  b \n c", "x'S don't we'll", "naïve—test… “q” don’t", "a\nb", "a \nb", "a\n b", "\na", "a\n", "a\r\nb", "tab\tb",
    "1234 56,7", "ünï.\nCôdé 😀 ok", "hi<|endoftext|>there", " lead", "trail ", "²³ x² ½", "ǅ ʰ ª º x_y __z", "\x85a b 　c", "a\nb\nc",
    "a!\n!b", "--\n--", "x\x1cy z\x1c", "क्षि हिन्दी éx", "'s 're x're.", "", " ", "\n", "the&&& that***\nof%%%",
]


def test_ids_equal_the_tokenizer(whole):
    own = encoder()
    for _ in range(2):
        for text, coded in zip(ODD, own.encode(ODD)):
            assert np.frombuffer(coded, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab Z9.,'$\n\té’—中", max_size=30))
def test_ids_of_any_text(text):
    assert np.frombuffer(encoder().encode([text])[0], "<u4").tolist() == tokenizer().encode(text, add_special_tokens=False).ids


def test_awkward_rows_and_whole_sequences(spark, whole):
    packed = packing.pack(packing.pieces(frame(spark, AWKWARD), keep_ids=True))
    rows = packed.collect()
    gapless(rows)
    assert sum(r.length for r in rows) == sum(len(ids_of(whole, t)) for _, t in AWKWARD)
    assert sorted(r.length for r in rows if r.doc_id in (7, 8)) == [1, 1]
    assert sum(r.doc_id is None and r.piece == 0 for r in rows) == 2
    read_back = {r.sequence_id: list(r.ids) for r in packing.sequences(packed).collect()}
    for r in rows:
        assert read_back[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)


def test_cuts():
    assert packing.cuts(2048, 2048) == [(0, 2048)]
    assert packing.cuts(2049, 2048) == [(0, 1), (1, 2048)]
    assert packing.cuts(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_empty_table(spark):
    assert packing.packed_documents(empty(spark)).collect() == []
    assert packing.sequences(packing.pack(packing.pieces(empty(spark), keep_ids=True))).where(F.lit(True)).collect() == []
