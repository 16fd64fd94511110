import hashlib

import pytest

from skygrade.llm import warc
from skygrade.session import fresh_path

PAGES = "page_id long, url string, html string, number long, segment long, hash string"


def pages(spark, n=300, extra=()):
    rows = [(i, f"https://e.x/{i}", f"<html>é{i} " + "t" * (i % 97) + "\r\n\r\nWARC/1.0 inside</html>", 0, 0, "x") for i in range(n)]
    return spark.createDataFrame([*rows, *extra], PAGES)


AWKWARD = [(None, None, None, 0, 0, "x"), (7, "https://e.x/7", "<p>", 0, 0, "x"), (7, "https://e.x/7", "<p>", 0, 0, "x"), (8, "a\r\nWARC/1.0", "", 0, 0, "x"), (9, "u", "z" * 300_000, 0, 0, "x")]


def archive(spark, df, per_segment=40):
    path = fresh_path(spark, "warc")
    warc.write_warc(df, path, per_segment)
    return path


def report(spark, a, b):
    return sorted((r.kind, r.record_id) for r in warc.audit(spark, a, b).collect())


def test_records_are_read_back(spark):
    path = archive(spark, pages(spark, 100, AWKWARD).coalesce(2))
    found = warc.leaves(warc.segments(spark, path)).collect()
    assert len(found) == 105
    assert sorted(r.record_id for r in found if r.record_id in ("urn:page:7", "urn:page:none")) == ["urn:page:7"] * 3 + ["urn:page:none"]
    assert len({r.segment for r in found}) >= 3
    by_segment = {}
    for r in sorted(found, key=lambda r: (r.segment, r.start)):
        assert r.start == by_segment.get(r.segment, 0)
        by_segment[r.segment] = r.end
    for row in warc.segments(spark, path).collect():
        data = warc.unpacked(bytes(row.content))
        assert all(data[a:b].startswith(warc.MAGIC) and data[a:b].endswith(warc.GAP) for a, b in warc.cut(data))
        mine = {(r.start, r.hash) for r in found if r.segment == row.segment}
        assert mine == {(a, hashlib.sha256(data[a:b]).hexdigest()) for a, b in warc.cut(data)}


def changed(spark, path, change):
    copy = fresh_path(spark, "copy")
    warc.copy_archive(spark, path, copy, change)
    return copy


def test_sound_replicas_have_nothing_to_report(spark):
    path = archive(spark, pages(spark, 120, AWKWARD))
    assert report(spark, path, changed(spark, path, lambda r: r)) == []


@pytest.mark.parametrize(
    "damage",
    [
        lambda r: r.replace(b"<html>", b"<htmX>", 1),
        lambda r: b"X" + r[1:],
        lambda r: r.replace(b"Content-Length", b"Content-Lengtx", 1),
    ],
)
def test_damage_is_located(spark, damage):
    path = archive(spark, pages(spark))
    bad = {f"urn:page:{i}" for i in (0, 41, 133, 299)}
    hit = lambda r: damage(r) if any(f"<{x}>".encode() in r for x in bad) else r
    assert report(spark, path, changed(spark, path, hit)) == sorted(("altered", x) for x in bad)


def test_lost_tails_and_segments_are_missing(spark):
    path = archive(spark, pages(spark, 200).coalesce(1))
    copy = fresh_path(spark, "copy")
    kept = warc.segments(spark, path).orderBy("segment").collect()
    rows = []
    for row in kept[:-1]:
        data = warc.unpacked(bytes(row.content))
        ranges = warc.cut(data)[: -2 if row.segment == kept[0].segment else None]
        rows += [(row.segment, n, data[a:b].removesuffix(warc.GAP).decode()) for n, (a, b) in enumerate(ranges)]
    table = spark.createDataFrame(rows, "segment long, number long, value string").repartition("segment")
    table.sortWithinPartitions("segment", "number").drop("number").write.options(**warc.TEXT_WRITER).partitionBy("segment").text(copy)
    lost = [("missing", f"urn:page:{i}") for i in (38, 39, *range(160, 200))]
    assert report(spark, path, copy) == sorted(lost)
    assert [kind for kind, _ in report(spark, copy, path)] == ["added"] * 42


def test_torn_files_are_read_as_far_as_they_go():
    import gzip

    whole = gzip.compress(b"a" * 1000) + gzip.compress(b"b" * 10)
    assert warc.unpacked(whole) == b"a" * 1000 + b"b" * 10
    assert warc.unpacked(whole[:-3]).startswith(b"a" * 1000)
    assert warc.cut(b"") == [] and warc.cut(b"junk") == [(0, 4)]


def test_empty_tables(spark):
    path = archive(spark, pages(spark, 0))
    assert report(spark, path, path) == []


def test_stored_bytes_that_are_damaged():
    """What precedes damage is kept; a lost or wrong end and bytes behind it are seen."""
    import gzip
    import random

    pick = random.Random(2)
    texts = [f"WARC/1.0\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: 3000\r\n\r\n".encode() + pick.randbytes(3000) + b"\r\n\r\n" for i in range(40)]
    data = b"".join(texts)
    whole = gzip.compress(data)
    sound = warc.records_of(whole)
    assert [r for _, r in sound] == texts
    for cut_off in (1, 4, 8):
        assert warc.records_of(whole[:-cut_off])[:40] == sound and len(warc.records_of(whole[:-cut_off])) == 41
    assert warc.records_of(whole + b"tail") == [*sound, (len(data), b"tail")]
    for place in range(len(whole) // 2, len(whole) - 8, 5000):
        bad = whole[:place] + bytes([whole[place] ^ 16]) + whole[place + 1 :]
        found = warc.records_of(bad)
        assert found != sound and len(set(found) & set(sound)) >= 18
        assert len({a for a, _ in found}) == len(found)
    wrong = whole[:-8] + bytes([whole[-8] ^ 1]) + whole[-7:]
    assert warc.records_of(wrong)[:40] == sound and len(warc.records_of(wrong)) == 41
    members = [gzip.compress(t) for t in texts]
    assert warc.records_of(b"".join(members)) == sound
    members[3] = members[3][:1500] + bytes([members[3][1500] ^ 16]) + members[3][1501:]
    assert [r for _, r in warc.records_of(b"".join(members))][-36:] == texts[4:]
