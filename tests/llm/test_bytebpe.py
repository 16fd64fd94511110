import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures_llm import AWKWARD, bag, empty, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from skygrade.llm import bytebpe

TOKENS = bytebpe.read_ranks()


@pytest.fixture(scope="module")
def reference():
    ranks = {t: i for i, t in enumerate(TOKENS)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own():
    return bytebpe.codec(TOKENS, public_tokenizers.PATTERN)


def test_byte_table_is_one_to_one():
    table = bytebpe.byte_table()
    assert len(set(table)) == 256 and all(c.isprintable() and not c.isspace() for c in table)
    assert table[ord("A")] == "A" and table[0x20] == "\u0120"


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \n\t\u3000\u00a0'stdlveabcé12.,!<|endoftext|>😀ß\x1c\x85") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_ids_equal_the_reference_encoder(own, reference, text):
    ids = own.encode([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text)
    assert own.decode(ids) == text.encode()
    starts, ends = own.offsets(text, ids)
    for i, a, b in zip(np.frombuffer(ids, "<u4").tolist(), starts, ends):
        assert TOKENS[i] in text[a:b].encode() and b > a


def test_cache_starts_anew_without_changing_ids(own, reference, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 3)
    for text in ("one two three four five", "six seven", "one two  three"):
        assert np.frombuffer(own.encode([text])[0], "<u4").tolist() == reference.encode_ordinary(text)


def test_tables(spark, reference):
    rows = bag(bytebpe.round_trip(frame(spark, AWKWARD)), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, text in AWKWARD:
        ids = reference.encode_ordinary(text or "")
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    assert rows == sorted(want, key=repr)
    assert bytebpe.round_trip(empty(spark)).collect() == []


def test_split_characters_come_back_whole(spark):
    docs = frame(spark, [(1, "a😀é中文 x"), (2, None), (3, "")])
    coded = bytebpe.encode(docs)
    assert bag(bytebpe.decode(coded), "doc_id", "text") == [(1, "a😀é中文 x"), (2, ""), (3, "")]
    for r in coded.collect():
        assert len(r.ids) == len(r.starts) == len(r.ends)
    one = spark.createDataFrame([(1, [TOKENS.index(b"\xf0")]), (2, None)], "doc_id long, ids array<int>")
    assert bag(bytebpe.decode(one), "doc_id", "text") == [(1, "\ufffd"), (2, "")]
