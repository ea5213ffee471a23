import base64
import hashlib

import gzip

import pytest
from plumbline.llm.warc import as_records, deduplicated, parsed, read_archives, resolve_revisits, write_archives

SCHEMA = "page_id long, url string, html string, kind string"


def rows():
    tricky = "<p>WARC/1.1\r\nWARC-Type: response\r\n\r\n</p>\r\n"
    return [(i, f"http://h/{i}", f"<p>text {i % 7} é😀</p>", "c") for i in range(60)] + [(100, None, tricky, "c"), (101, "http://a\r\nX: y", tricky, "c"), (102, "u", None, "c"), (103, "u", "", "c"), (104, "u", "x" * 500000, "c"), (105, "u", "\r\n\r\n", "c"), (106, "u", "one", "c"), (106, "u", "one", "c"), (None, "u", "one", "c"), (None, "u", "lone", "c")]


def brute(data, least):
    out = []
    for i, _, html, _ in data:
        b = (html or "").encode()
        same = [j for j, _, h, _ in data if (h or "") == (html or "")]
        top = max((j for j in same if j is not None), default=None)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), len(same) if len(b) >= least else 1, top))
    return out


def test_against_brute_force(spark):
    for least in (0, 20):
        data = rows()
        got = deduplicated(spark.createDataFrame(data, SCHEMA), least=least).collect()
        order = lambda x: (x[0] is None, x[0] or 0, x[2])
        want = sorted(brute(data, least), key=order)
        have = sorted(((r.id, r.size, r.digest, r.kind, r.refers_to_id, r.refers_to, r.record) for r in got), key=order)
        assert [h[:3] for h in have] == [w[:3] for w in want]
        names = {h[6]: h for h in have}
        assert len(names) == len(have)
        for h, w in zip(have, want, strict=True):
            if w[3] == 1 or (h[0] == w[4] and h[3] == "response"):
                assert h[3] == "response" and h[4] is None
            else:
                assert h[3] == "revisit" and h[4] == w[4] and names[h[5]][3] == "response" and names[h[5]][2] == h[2]
        per = {}
        for h in have:
            if h[1] >= least:
                per[h[2]] = per.get(h[2], 0) + (h[3] == "response")
        assert set(per.values()) == {1}


def test_round_trip(spark, tmp_path):
    data = [r for r in rows() if r[0] is not None]
    write_archives(as_records(spark.createDataFrame(data, SCHEMA), "page_id", "url", "html", "2001-02-03T04:05:06Z"), str(tmp_path / "a"), 7)
    got = read_archives(spark, str(tmp_path / "a"), payloads=True).collect()
    assert sorted((int(r.record.split(":")[2]), bytes(r.payload), r.date) for r in got) == sorted((i, (h or "").encode(), "2001-02-03T04:05:06Z") for i, _, h, _ in data)


def test_empty(spark):
    assert deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def record(kind, name, block=b"", more=(), media="application/http; msgtype=response"):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 2020-01-02T03:04:05Z", *more, f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.0", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(payload, more=b""):
    return b"\r\n".join([b"HTTP/1.1 200 OK", *[more] * bool(more), b"", payload])


def digest_of(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


EVERY_BYTE = bytes(range(256)) * 20 + b"WARC/1.0\r\nWARC-Type: response\r\n\r\n WARC/1. WARC/1.1\r\n\r\n"


def archives():
    """Two hand-made archives: a gzip member for each record and one for all; old revisits, other kinds, payloads that are no UTF-8."""
    one = [
        record("warcinfo", "info", b"software: x\r\nformat: WARC/1.0\r\n", media="application/warc-fields"),
        record("response", "a", http(EVERY_BYTE, b"X-A: 1"), ["WARC-Target-URI: http://a/", "WARC-IP-Address: 10.0.0.1", "WARC-Payload-Digest: sha1:WRONG"]),
        record("request", "q", b"GET / HTTP/1.1\r\n\r\n", ["WARC-Concurrent-To: <urn:uuid:a>"], "application/http; msgtype=request"),
        record("revisit", "r1", http(b"", b"Content-Length: %d" % len(EVERY_BYTE)), ["WARC-Target-URI: http://r/", f"WARC-Payload-Digest: sha1:{digest_of(EVERY_BYTE)}", "WARC-Refers-To: <urn:uuid:a>", "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]),
        record("revisit", "lost", http(b""), ["WARC-Payload-Digest: sha1:ELSEWHERE", "WARC-Refers-To: <urn:uuid:elsewhere>"]),
    ]
    two = [
        record("response", "b", http(EVERY_BYTE, b"X-B: 2"), ["WARC-Target-URI: http://b/"]),
        record("revisit", "r2", http(b"", b"Content-Length: 9"), [f"WARC-Payload-Digest: sha1:{digest_of(EVERY_BYTE)}"]),
        record("resource", "c", EVERY_BYTE, ["WARC-Target-URI: file:c"], "application/octet-stream"),
        record("response", "d", http("é alone".encode("latin-1"))),
        record("metadata", "m", b"k: v\r\n", ["WARC-Refers-To: <urn:uuid:d>"], "application/warc-fields"),
        record("response", "e", http(b"")),
        record("revisit", "same", http(b""), ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/server-not-modified", "WARC-Refers-To: <urn:uuid:a>"]),
    ]
    return b"".join(map(gzip.compress, one)), gzip.compress(b"".join(two))


def test_archives_of_others(spark, tmp_path):
    """No record and no byte of a payload is lost, only records with a payload are responses, and a second run changes nothing."""
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, data in zip(("one", "deep/two"), archives(), strict=True):
        (tmp_path / "in" / f"{name}.warc.gz").write_bytes(data)
    resolve_revisits(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    rows = read_archives(spark, str(tmp_path / "out"), payloads=True).collect()
    by = {r.record.removeprefix("urn:uuid:"): r for r in rows}
    assert sorted(by) == sorted(["info", "a", "q", "r1", "lost", "b", "r2", "c", "d", "m", "e", "same"]) and len(rows) == 12
    whole = [r for r in rows if r.digest == digest_of(EVERY_BYTE) and r.kind in ("response", "resource")]
    assert len(whole) == 1 and bytes(whole[0].payload) == EVERY_BYTE and whole[0].record == "urn:uuid:c"
    for name in ("a", "b", "r1", "r2"):
        assert by[name].kind == "revisit" and by[name].refers_to == "urn:uuid:c" and by[name].digest == digest_of(EVERY_BYTE) and not by[name].payload
    assert b"X-A: 1" in by["a"].http and "WARC-IP-Address: 10.0.0.1" in by["a"].extra and by["r1"].url == "http://r/" and by["a"].refers_to_url == "file:c"
    assert by["lost"].kind == "revisit" and by["lost"].refers_to == "urn:uuid:elsewhere" and by["lost"].digest == "ELSEWHERE"
    assert by["same"].refers_to == "urn:uuid:a" and "server-not-modified" in by["same"].extra
    assert bytes(by["d"].payload) == "é alone".encode("latin-1") and by["e"].kind == "response"
    assert bytes(by["info"].payload) == b"software: x\r\nformat: WARC/1.0\r\n" and "WARC-Concurrent-To: <urn:uuid:a>" in by["q"].extra and by["m"].refers_to == "urn:uuid:d"
    resolve_revisits(spark, str(tmp_path / "out"), str(tmp_path / "again"))
    again = read_archives(spark, str(tmp_path / "again"), payloads=True)
    assert sorted(map(str, (r[1:] for r in again.collect()))) == sorted(map(str, (r[1:] for r in rows)))


def test_a_record_and_its_revisit(spark, tmp_path):
    """The payload stays with the record that has it, whatever the revisit's name."""
    body = b"twelve bytes"
    data = record("response", "1", http(body)).replace(b"urn:uuid:1", b"urn:page:1:0") + record("revisit", "2", http(b"", b"Content-Length: 12"), [f"WARC-Payload-Digest: sha1:{digest_of(body)}"]).replace(b"urn:uuid:2", b"urn:page:2:0")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.gz").write_bytes(gzip.compress(data))
    resolve_revisits(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = {r.record: (r.kind, bytes(r.payload), r.refers_to, r.size) for r in read_archives(spark, str(tmp_path / "out"), payloads=True).collect()}
    assert got == {"urn:page:1:0": ("response", body, None, 12), "urn:page:2:0": ("revisit", b"", "urn:page:1:0", 12)}


def pieces(data):
    return data.split(b"WARC/1.")


def test_records_are_cut_by_length():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 17\r\n\r\nA: b\r\n\r\nxWARC/1.0\r\n\r\n"
    assert [b for _, _, b in parsed(pieces(one * 2))] == [b"A: b\r\n\r\nxWARC/1.0"] * 2
    for wrong in (one[:-20], one + b"rubbish", b"rubbish" + one, one.replace(b"17", b"12")):
        with pytest.raises(ValueError):
            list(parsed(pieces(wrong)))
