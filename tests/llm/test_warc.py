"""Archives of others: a gzip member per record, plain files, odd headers."""

import base64
import gzip
import hashlib

import pytest

from tamiz.llm import warc


def record(kind, block, extra="", end="\r\n", colon=": "):
    lines = ["WARC/1.0", f"WARC-Type{colon}{kind}", *extra.split("|")[: 99 if extra else 0], f"Content-Length{colon}{len(block)}"]
    return end.join(lines).encode() + (end * 2).encode() + block + b"\r\n\r\n"


def archive():
    body = "é body of a page".encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type:text/html\r\n\r\n" + body
    digest = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    return body, [
        record("warcinfo", b"software: x\r\n"),
        record("response", http, f"warc-record-id: <urn:uuid:1>|WARC-Target-URI: http://a/b|WARC-Payload-Digest: {digest}", colon=":"),
        record("revisit", b"", f"WARC-Record-ID: <urn:uuid:2>|WARC-Profile: http://x/|  identical-payload-digest|WARC-Refers-To:<urn:uuid:1>|WARC-Payload-Digest: {digest}"),
        record("response", b"HTTP/1.1 200 OK\nX: y\n\nplain", "WARC-Record-ID: <urn:uuid:3>|WARC-Page-ID: 7|no colon here|WARC-Payload-Digest: md5:abc", end="\n"),
        record("response", http, f"WARC-Record-ID: <urn:uuid:4>|WARC-Payload-Digest: sha1:{'0' * 40}|WARC-Record-ID: <urn:uuid:9>"),
        record("resource", b"bare \r\n\r\n block", "WARC-Record-ID: <urn:uuid:5>"),
    ]


@pytest.mark.parametrize("form", ["members", "one", "plain", "padded"])
def test_archives_of_others(spark, tmp_path, form):
    body, records = archive()
    packed = {"members": b"".join(map(gzip.compress, records)), "one": gzip.compress(b"".join(records)), "plain": b"".join(records), "padded": b"".join(gzip.compress(x) + b"\0" * 70_000 for x in records)}[form]
    (tmp_path / ("a.warc" if form == "plain" else "a.warc.gz")).write_bytes(packed)
    found = warc.read(spark, str(tmp_path), with_payload=True)
    got = {r.record_id: r for r in found.collect()}
    sha = hashlib.sha1(body).hexdigest()
    pick = lambda k: tuple(got[k])[0:2] + tuple(got[k])[3:]
    assert pick("<urn:uuid:1>") == (None, "http://a/b", "response", None, len(body), sha, True, body)
    assert pick("<urn:uuid:2>") == (None, None, "revisit", "<urn:uuid:1>", None, sha, True, None)
    assert pick("<urn:uuid:3>") == (7, None, "response", None, 5, None, None, b"plain")
    assert pick("<urn:uuid:4>")[6] is False and got["<urn:uuid:5>"].payload == b"bare \r\n\r\n block" and got[None].record_type == "warcinfo"
    resolved = {r.record_id: bytes(r.payload) for r in warc.resolve(found).collect()}
    assert set(resolved) == {f"<urn:uuid:{k}>" for k in (1, 2, 3, 4)} and resolved["<urn:uuid:2>"] == body


def test_members_span_read_pieces(spark, tmp_path):
    """Many records of sizes about the reader's pieces."""
    bodies = [bytes([65 + k % 26]) * n for k, n in enumerate([0, 1, 65_535, 65_536, 65_537, 200_000] * 5)]
    pages = [(k, "u", b.decode()) for k, b in enumerate(bodies)]
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2), str(tmp_path / "own"))
    own = {(r.page_id, r.record_type, r.payload_digest) for r in warc.read(spark, str(tmp_path / "own")).collect()}
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "own").glob("*.gz")))
    parts = [b"WARC/1.1" + x for x in raw.split(b"WARC/1.1")[1:]]
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "b.warc.gz").write_bytes(b"".join(gzip.compress(x, 1) for x in parts))
    assert {(r.page_id, r.record_type, r.payload_digest) for r in warc.read(spark, str(tmp_path / "other")).collect()} == own and len(own) == 30


def test_broken_archives_are_errors():
    _, records = archive()
    for broken in (records[1][:-30], b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx", gzip.compress(records[1])[:-12], b"WARC/1.0\r\nno end"):
        with pytest.raises(ValueError):
            list(warc._records(broken))
