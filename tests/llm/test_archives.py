import io
import random

import pytest

from sievelake.llm import archives
from sievelake.llm.archives import Salvage, gzip_member, record_bytes
from sievelake.llm.queries import op10_warc


def walk(data):
    return list(Salvage(io.BytesIO(data), len(data)))


def members(n, packed=True):
    rng = random.Random(4)
    out = []
    for i in range(n):
        raw = record_bytes(i, f"http://x/{i}", rng.randbytes(rng.randrange(0, 3000)) + b"<p>WARC/1.1 \x1f\x8b\x08</p>", "response", None)
        out.append(gzip_member(raw) if packed else raw)
    return out


def ids(found):
    return [w["record_id"] for _, _, w, *_ in found if isinstance(w, dict)]


def gaps(found):
    return [(o, n) for o, n, w, place, _ in found if isinstance(w, str) and place is None]


def test_clean_archives():
    for packed in (True, False):
        found = walk(b"".join(members(20, packed)))
        assert ids(found) == [f"<urn:x-page:{i}>" for i in range(20)] and not gaps(found)
    assert walk(b"") == []


def test_later_records_are_recovered():
    for packed in (True, False):
        parts = members(12, packed)
        data = bytearray(b"".join(parts))
        starts = [sum(map(len, parts[:i])) for i in range(13)]
        for i in (3, 4, 9):
            data[starts[i] + len(parts[i]) // 2] ^= 0xFF
        found = walk(bytes(data))
        assert ids(found) == [f"<urn:x-page:{i}>" for i in range(12) if i not in (3, 4, 9)]
        assert gaps(found) == [(starts[3], starts[5] - starts[3]), (starts[9], starts[10] - starts[9])]


def test_junk_cuts_and_foreign_members():
    parts = members(4)
    data = b"junk" + parts[0] + gzip_member(b"not a record at all") + parts[1] + b"\0" * 50 + parts[2] + parts[3][:-9]
    found = walk(data)
    assert ids(found) == [f"<urn:x-page:{i}>" for i in range(3)]
    assert sum(n for _, n in gaps(found)) == len(data) - sum(map(len, parts[:3]))


def test_bytes_are_covered_whatever_breaks():
    rng = random.Random(8)
    for trial in range(60):
        parts = members(8, trial % 2 == 0)
        data = bytearray(b"".join(parts))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            if rng.random() < 0.3:
                del data[at : at + rng.randrange(1, 500)]
            else:
                data[at] ^= 1 << rng.randrange(8)
        found = walk(bytes(data))
        assert sum(n for _, n, *_ in found) == len(data)
        assert len(ids(found)) >= 8 - 5 - 1


def inner(found):
    return [(place, n) for _, _, w, place, n in found if isinstance(w, str) and place is not None]


@pytest.mark.parametrize("kept", [archives.KEPT, 1000])
def test_records_inside_one_member(monkeypatch, kept):
    """Five records in one member; the third is bad before it is packed. With a low limit the member is decoded twice."""
    monkeypatch.setattr(archives, "KEPT", kept)
    parts = members(5, packed=False)
    starts = [sum(map(len, parts[:i])) for i in range(6)]
    third = bytearray(parts[2])
    third[len(third) // 2] ^= 0xFF
    for raw, lost in ((b"".join(parts), None), (b"".join([*parts[:2], bytes(third), *parts[3:]]), 2)):
        data = gzip_member(raw)
        found = walk(members(1)[0] + data)
        assert ids(found) == ["<urn:x-page:0>"] + [f"<urn:x-page:{i}>" for i in range(5) if i != lost]
        assert inner(found) == ([(starts[2], starts[3] - starts[2])] if lost else []) and not gaps(found)
        assert sum(n for _, n, *_ in found) == len(members(1)[0]) + len(data)


def test_plain_archive_in_gzip_with_junk():
    parts = members(6, packed=False)
    cut = parts[3][:-300]
    found = walk(gzip_member(b"junk" + parts[0] + parts[1] + b"\0" * 77 + parts[2] + cut + parts[4] + parts[5][:100]))
    assert ids(found) == [f"<urn:x-page:{i}>" for i in (0, 1, 2, 4)]
    lengths = [*map(len, parts)]
    after = 4 + lengths[0] + lengths[1]
    assert inner(found) == [(0, 4), (after, 77), (after + 77 + lengths[2], len(cut)), (after + 77 + lengths[2] + len(cut) + lengths[4], 100)]


def test_member_that_breaks_off_keeps_its_first_records():
    rng = random.Random(6)
    parts = [record_bytes(i, None, rng.randbytes(40_000), "response", None) for i in range(5)]
    whole = gzip_member(b"".join(parts))
    cut = whole[: len(whole) * 7 // 10]
    last = members(1)[0]
    found = walk(cut + last)
    assert ids(found) == ["<urn:x-page:0>", "<urn:x-page:1>", "<urn:x-page:2>", "<urn:x-page:0>"]
    assert gaps(found) == [(0, len(cut))] and sum(n for _, n, *_ in found) == len(cut) + len(last)


def test_checksum_failure_without_a_bad_record_is_quarantined():
    raw = gzip_member(b"".join(members(3, packed=False)))
    found = walk(raw[:-8] + bytes([raw[-8] ^ 1]) + raw[-7:] + members(2)[1])
    assert ids(found) == ["<urn:x-page:1>"] and gaps(found) == [(0, len(raw))]


def test_very_long_payload_and_null_paths(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 9_000_000), (2, "u", "y")], "page_id long, url string, html string")
    paths = archives.archive_pages(pages)
    got = {r.record_id: len(r.payload) for r in archives.read_archives(paths.select("path").union(spark.sql("SELECT CAST(NULL AS string)"))).collect()}
    assert got == {"<urn:x-page:1>": 9_000_000, "<urn:x-page:2>": 1}


def test_revisits_and_edges(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (2, None, "same"), (5, "a b\r\nc", ""), (9, "u", None), (None, "u", "same"), (None, "v", "q"), (None, "w", "q"), (7, "u", "one")]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id long, url string, html string, payload int")
    out = archives.read_archives(archives.archive_pages(pages)).collect()
    number = lambda s: int(s[12:-1]) if s and "none" not in s else None
    got = sorted(((number(r.record_id), r.record_type, number(r.refers_to), r.payload_bytes, r.uri) for r in out), key=str)
    want = [(1, "revisit", 2, 4, "u"), (2, "response", None, 4, None), (2, "response", None, 4, None), (5, "revisit", 9, 0, "a%20b%0D%0Ac"), (9, "response", None, 0, "u"), (None, "revisit", 2, 4, "u"), (None, "response", None, 1, "v"), (None, "response", None, 1, "w"), (7, "response", None, 3, "u")]
    assert got == sorted(want, key=str)
    assert archives.read_archives(archives.archive_pages(pages.limit(0))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    last = {}
    for k, v in sorted(pages.items()):
        last[v] = k
    out = op10_warc(spark, sf).collect()
    assert len(out) == len(pages)
    for r in out:
        html = pages[r.page_id]
        keep = last[html]
        assert (r.payload_bytes, r.payload_digest) == (len(html), archives.base32_sha1(html))
        assert (r.record_type, r.refers_to) == (("response", None) if keep == r.page_id else ("revisit", keep))
