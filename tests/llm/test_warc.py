"""Archives written and read back, and damaged ones."""

import gzip
import hashlib

import pytest

from tableglass.llm import warc


def record(body: bytes, kind="resource", digest=True) -> bytes:
    sha = f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}\r\n" if digest else ""
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\n{sha}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def found(data):
    return [(x[0], bytes(x[4])) if x[0] == "record" else (x[0], x[1], x[2]) for x in warc.salvage(data)]


@pytest.mark.parametrize("pack", [lambda b: b, gzip.compress])
def test_salvage(pack):
    a, b, c = (pack(record(x)) for x in (b"first", b"second\r\nWARC/1.1 in text", b"third" * 1000))
    assert found(a + b + c) == [("record", b"first"), ("record", b"second\r\nWARC/1.1 in text"), ("record", b"third" * 1000)]
    broken = bytearray(b)
    broken[-8] ^= 0xFF  # in the text, or in the member's check sum
    assert found(a + bytes(broken) + c) == [("record", b"first"), ("gap", len(a), len(b)), ("record", b"third" * 1000)]
    assert found(b"junk" + a + b"\0" * 9 + c[:-30]) == [("gap", 0, 4), ("record", b"first"), ("gap", 4 + len(a), 9 + len(c) - 30)]
    assert found(a[:20] + b + c) == [("gap", 0, 20), ("record", b"second\r\nWARC/1.1 in text"), ("record", b"third" * 1000)]
    assert found(b"") == [] and found(b"\x1f\x8b\x08") == [("gap", 0, 3)]
    assert sum(x[2] if x[0] == "gap" else 0 for x in found(bytes(broken) * 3)) == 3 * len(b)


def test_header_checks():
    good = record(b"x", digest=False)
    for bad in (good.replace(b"Content-Length: 1", b"Content-Length: one"), good.replace(b"Content-Length: 1", b"Content-Length: 900"),
                good.replace(b"WARC-Type: resource", b"no colon"), good.replace(b"WARC/1.1", b"WARC/9.9")):
        assert found(bad + good) == [("gap", 0, len(bad)), ("record", b"x")]


def test_round_trip(spark, tmp_path):
    long, other = "é" * 600, "<p>\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://a/\r\nX: y", "short"), (4, "u", "short"), (None, "u", long), (5, "u", None), (6, "u", ""), (2, None, long), (7, "u", other),
            (8, "u", "z" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS id", "2 AS payload", "3 AS revisit").repartition(3)
    path = str(tmp_path / "w")
    warc.write_archives(df, path, file_bytes=3000)
    read = warc.read_archives(spark, path).collect()
    assert {r["kind"] for r in read} == {"record"}
    got = sorted(((r["record_id"], r["type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in read), key=str)
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = html == long and i != 2
        want.append((name(i), "revisit" if again else "response", name(2) if again else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == sorted(want, key=str)
    texts = {bytes(r["payload"]).decode() for r in read if r["type"] == "response"}
    assert texts == {long, other, "short", "", "z" * 3_000_000}
    assert {r["target_uri"] for r in read} == {"http://a/", "http://a/%0D%0AX: y", "u", None}


def test_empty(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).collect() == []


def test_any_url_comes_back(spark, tmp_path):
    """Characters that str.splitlines takes for line ends, and a header of more than 1 MB."""
    urls = [f"http://a/{c}type: x{c}rest{c}" for c in "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"] + ["http://a/" + "u" * 1_500_000, "http://a/\u2028WARC-Type: response"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'<p>' || page_id AS html")
    warc.write_archives(df, str(tmp_path / "w"))
    read = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r["kind"], r["reason"], r["record_id"], r["target_uri"]) for r in read) == sorted(("record", None, f"<urn:page:{i}>", u) for i, u in enumerate(urls))


def members(data):
    return [(x[0], bytes(x[4]) if x[0] == "record" else x[3].split(" (")[0]) for x in warc.salvage(data)]


def test_salvage_inside_members():
    """Of a member of many records all but the damaged one come back; of a cut or damaged one those before the damage."""
    bodies = [f"body {i} ".encode() * 50 for i in range(10)]
    records = [record(b) for b in bodies]
    other = gzip.compress(record(b"after"))
    broken = [*records[:3], records[3].replace(b"body 3", b"bodY 3", 1), *records[4:]]
    data = gzip.compress(b"".join(broken))
    got = list(warc.salvage(data + other))
    assert [bytes(x[4]) for x in got if x[0] == "record"] == [*bodies[:3], *bodies[4:], b"after"]
    gap = next(x for x in got if x[0] == "gap")
    begin = sum(map(len, records[:3]))
    assert gap[1:3] == (0, len(data)) and gap[3] == f"block digest differs (unpacked bytes {begin} to {begin + len(records[3])} of a member)"
    import random
    rng = random.Random(1)
    many = [record(bytes(rng.randbytes(300)), digest=i % 2 == 0) for i in range(200)]
    packed = gzip.compress(b"".join(many))
    cut = [x for x in warc.salvage(packed[:len(packed) * 9 // 10]) if x[0] == "record"]
    assert len(cut) > 175
    bent = bytearray(packed)
    at = len(packed) * 9 // 10
    bent[at:at + 200] = b"\xff" * 200
    got = list(warc.salvage(bytes(bent) + other))
    kept = {bytes(x[4]) for x in got if x[0] == "record"}
    assert kept <= {r.split(b"\r\n\r\n", 1)[1][:-4] for r in many} | {b"after"} and b"after" in kept
    assert all(x[1] + x[2] <= len(bent) + len(other) for x in got)


def test_a_payload_digest_that_differs_is_searched_on():
    """The stated length of a record that fails isn't relied on, so a good record inside it is found."""
    inner = record(b"inner")
    bad = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Payload-Digest: sha1:" + b"0" * 40 + f"\r\nContent-Length: {len(inner) + 5}\r\n\r\nshort".encode() + inner + b"\r\n\r\n"
    got = members(bad + record(b"next"))
    assert [x for x in got if x[0] == "record"] == [("record", b"inner"), ("record", b"next")] and got[0] == ("gap", "payload digest differs")


def test_long_http_header():
    payload = b"<p>x"
    http = b"HTTP/1.1 200 OK\r\nX: " + b"y" * 70_000 + b"\r\nContent-Length: 4\r\n\r\n" + payload
    sha = hashlib.sha1(payload).hexdigest().encode()
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha1:" + sha + (
        f"\r\nContent-Length: {len(http)}\r\n\r\n".encode()) + http + b"\r\n\r\n"
    (row,) = warc._rows("f", data, True)
    assert row[0] == "record" and row[-1] == payload and row[-3] == 4
