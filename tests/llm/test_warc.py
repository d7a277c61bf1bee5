from __future__ import annotations

import base64
import gzip
import hashlib
import random
import tempfile
import time
from pathlib import Path

from tallyrun.llm import warc

PAGES = "page_id long, url string, html string, digest string, row int, shared string, of string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "s", "o") for r in rows], PAGES).repartition(3)


SAME, OTHER = "<p>same é🙂</p>" * 12, "<p>other</p>" * 30
ROWS = [(5, "http://a/x", SAME), (3, "http://b/ y\r\nz", SAME), (9, None, SAME), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "u", OTHER), (7, "u", OTHER), (None, "u", OTHER), (8, "u", "x" * 3_000_000), (10, "u", "WARC/1.1\r\n\r\n\x1f\x8b\x08 " * 20)]


def test_round_trip(spark):
    folder = tempfile.mkdtemp() + "/w"
    warc.write_archives(pages(spark, ROWS), folder)
    records = warc.read_archives(spark, folder)
    assert records.where("problem IS NOT NULL").count() == 0
    got = sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.payloads(records).collect()), key=str)
    wanted = []
    for i, _, t in ROWS:
        data = (t or "").encode()
        first = {SAME: "3", OTHER: "7"}.get(t)
        wanted.append([None if i is None else str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if first and i != int(first) else "response", first if first and i != int(first) else None])
    twice = [w for w in wanted if w[0] == "7"]
    twice[1][3:] = ["revisit", "7"]
    assert got == sorted(map(tuple, wanted), key=str)
    for f in Path(folder).glob("part-*"):
        whole = gzip.decompress(f.read_bytes())  # plain gzip reads all members
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") or not whole


def test_empty(spark):
    folder = tempfile.mkdtemp() + "/w"
    warc.write_archives(pages(spark, ROWS).limit(0), folder)
    assert warc.payloads(warc.read_archives(spark, folder)).count() == 0


def members(n, plain=False):
    made = [warc.record([("WARC-Type", "resource"), ("WARC-Record-ID", f"<{i}>")], random.Random(i).randbytes(50 + 37 * i)) for i in range(n)]
    return made if plain else [warc.member(m) + b"\0" for m in made]


def read(data):
    found = list(warc.salvaged(data))
    return [r.headers["warc-record-id"] for r in found if isinstance(r, warc.Record)], [(g.start, g.end) for g in found if isinstance(g, warc.Gap)]


def test_salvage():
    for plain in (False, True):
        parts = members(6, plain)
        starts = [sum(map(len, parts[:i])) for i in range(7)]
        data = b"".join(parts)
        assert read(data) == ([f"<{i}>" for i in range(6)], [])
        for hurt in range(6):
            broken = bytearray(data)
            at = starts[hurt] + len(parts[hurt]) // 2 + 20
            broken[at] ^= 0x55
            ids, gaps = read(bytes(broken))
            assert ids == [f"<{i}>" for i in range(6) if i != hurt] and gaps == [(starts[hurt], starts[hurt + 1])], (plain, hurt)
            cut = data[: starts[hurt]] + data[starts[hurt] + 11 :]  # bytes lost at a record's begin
            ids, gaps = read(cut)
            assert ids == [f"<{i}>" for i in range(6) if i != hurt] and gaps == [(starts[hurt], starts[hurt + 1] - 11)]
        ids, gaps = read(data[: starts[5] + 30])
        assert ids == [f"<{i}>" for i in range(5)] and gaps == [(starts[5], starts[5] + 30)]
        ids, gaps = read(b"junk\n" + data)
        assert len(ids) == 6 and gaps == [(0, 5)]
    assert read(b"") == ([], []) and read(b"nothing here") == ([], [(0, 12)])


def test_every_byte_counts_once():
    rng = random.Random(3)
    for _ in range(60):
        data = bytearray(b"".join(members(5)))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at : at + rng.randint(0, 60)] = rng.randbytes(rng.randint(0, 40))
        at = 0
        for x in warc.salvaged(bytes(data)):
            assert x.start >= at and not any(data[at : x.start])
            at = x.end
        assert not any(data[at:])


def test_large_members_end_in_zero():
    data = random.Random(1).randbytes(1 << 24) + b"abc"
    packed = warc.member(data) + b"\0"
    assert gzip.decompress(packed) == data


def test_members_of_many_records():
    plain = members(5, plain=True)
    for parts in ([plain], [plain[:2], plain[2:3], plain[3:]]):
        data = b"".join(warc.member(b"".join(p)) + b"\0" for p in parts)
        assert read(data) == ([f"<{i}>" for i in range(5)], [])
    hurt = plain[2][:-20] + bytes([plain[2][-20] ^ 1]) + plain[2][-19:]
    found = list(warc.salvaged(warc.member(b"".join([*plain[:2], hurt, *plain[3:]])) + b"\0"))
    assert [x.headers["warc-record-id"] for x in found if isinstance(x, warc.Record)] == ["<0>", "<1>", "<3>", "<4>"]
    (gap,) = (x for x in found if isinstance(x, warc.Gap))
    at = len(plain[0] + plain[1])
    assert gap.inside == (at, at + len(hurt)) and gap.reason == "block digest does not fit"


def test_digests_and_versions():
    block = b"some bytes"
    sha1, sha256 = hashlib.sha1(block), hashlib.sha256(block)
    made = lambda stated, version=b"WARC/1.0": version + f"\r\nWARC-Record-ID: <1>\r\nWARC-Block-Digest: {stated}\r\nContent-Length: 10\r\n\r\n".encode() + block + b"\r\n\r\n"
    for stated in ("sha1:" + base64.b32encode(sha1.digest()).decode(), "SHA-1:" + sha1.hexdigest(), "sha256:" + sha256.hexdigest().upper(), "sha256:" + base64.b32encode(sha256.digest()).decode(), "other:x"):
        assert read(made(stated)) == (["<1>"], []) == read(made(stated, b"WARC/0.18")), stated
        if stated[0] != "o":
            assert read(made(stated[:10] + ("Z" if stated[10] != "Z" else "Y") + stated[11:]))[0] == []
    assert read(made("x:y", b"WARC/2.0"))[0] == []


def test_linear_and_bounded(monkeypatch):
    start = time.process_time()
    data = b"WARC/1.1\r\nWARC-Type: resource\r\n" * 100_000
    assert read(data + b"\r\n\r\n") == ([], [(0, len(data) + 4)])
    assert time.process_time() - start < 10
    monkeypatch.setattr(warc, "LARGEST", 1 << 20)
    big = gzip.compress(b"0" * (1 << 24))
    assert read(big + members(1)[0]) == (["<0>"], [(0, len(big))])
