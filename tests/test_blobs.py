"""Captured files: literal cases of decoding, of MIME agreement, and of replay."""

import base64
import hashlib

from pyspark.sql import functions as F

from pagewake.operators import blobs


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_decoding(spark):
    data = b"\x00\xff%PDF"
    good = base64.b64encode(data).decode()
    cases = [
        ((good, "base64", "decoded-bytes", sha(data)), (data, sha(data), None)),
        (("", "base64", "decoded-bytes", sha(b"")), (b"", sha(b""), None)),
        ((None, "base64", "decoded-bytes", sha(data)), (None, None, "content_missing")),
        ((good[:-1], "base64", "decoded-bytes", sha(data)), (None, None, "invalid_base64")),
        ((good + "\n", "base64", "decoded-bytes", sha(data)), (None, None, "invalid_base64")),
        ((good, "base64", "decoded-bytes", "0"), (None, None, "sha256_mismatch")),
        ((good, "base64", "text", None), (good.encode(), sha(good.encode()), None)),
        (("é", None, None, None), ("é".encode(), sha("é".encode()), None)),
        (("é", None, None, "0"), (None, None, "sha256_mismatch")),
        (("A" * 4_000_000, "base64", "decoded-bytes", sha(b"\0" * 3_000_000)), (b"\0" * 3_000_000, sha(b"\0" * 3_000_000), None)),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, t string, r string, s string, d string")
    found = rows.select("i", blobs.decoded(*map(F.col, "trsd")).alias("f")).select("i", "f.*").collect()
    assert [(bytes(r.payload) if r.payload is not None else None, r.sha256, r.error) for r in sorted(found)] == [want for _, want in cases]


PDF, DOCX = b"%PDF-1.7", b"PK\x03\x04..word/document.xml"
WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"


def test_mime_agreement(spark):
    cases = [
        (("application/pdf", PDF, "a.pdf", "identity"), ("application/pdf", None)),
        (("Application/PDF; x=y", PDF, "https://a.org/a", "identity"), ("application/pdf", None)),
        (("application/pdf", PDF, "https://a.org/a.PDF?b=.txt", "identity"), ("application/pdf", None)),
        (("application/pdf", PDF, "a.pdf.gz", "gzip"), ("application/pdf", None)),
        (("application/pdf", PDF, "a.pdf.gz", "identity"), (None, "mime.extension_mismatch")),
        (("application/pdf", b"<html>", "a.pdf", "identity"), (None, "mime.magic_mismatch")),
        ((" ", PDF, "a.pdf", "identity"), (None, "mime.header_missing")),
        ((None, PDF, "a.pdf", "identity"), (None, "mime.header_missing")),
        (("video/mp4", PDF, "a.pdf", "identity"), (None, "mime.unsupported")),
        ((WORD, DOCX, "a.docx", "identity"), (WORD, None)),
        ((WORD, b"PK\x03\x04xl/", "a.docx", "identity"), (None, "mime.magic_mismatch")),
        (("text/html", b"\xef\xbb\xbf  <!DOCTYPE html>", ".htm", "identity"), ("text/html", None)),
        (("text/html", b"<p>part</p>", "a.htm", "identity"), (None, "mime.magic_mismatch")),
        (("application/json", b'{"a": [1]}', "a.json", "identity"), ("application/json", None)),
        (("application/json", b"{a", "a.json", "identity"), (None, "mime.magic_mismatch")),
        (("text/plain", b"words", "a.txt", "identity"), ("text/plain", None)),
        (("text/plain", b"a\x00b", "a.txt", "identity"), (None, "mime.magic_mismatch")),
        (("text/plain", b"\xff\xfe", "a.txt", "identity"), (None, "mime.magic_mismatch")),
        (("application/msword", bytes.fromhex("D0CF11E0A1B11AE1"), "a.doc", "identity"), ("application/msword", None)),
        (("image/gif", b"GIF89a", "", "identity"), ("image/gif", None)),
    ]
    rows = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, h string, b binary, n string, e string")
    found = rows.select("i", blobs.mime_check(*map(F.col, "hbne")).alias("m")).select("i", "m.*").collect()
    assert [tuple(r)[1:] for r in sorted(found)] == [want for _, want in cases]


def test_replay(spark):
    observations = spark.createDataFrame([("a", "v", sha(b"x"), 1), ("b", "gone", sha(b"x"), 1), ("c", "v", sha(b"y"), 1), ("d", "v", sha(b"z"), 1), ("e", "v", sha(b"x"), 2)], "artifact_id string, version_id string, sha256 string, size_bytes bigint")
    stored = spark.createDataFrame([(sha(b"x"), b"x"), (sha(b"z"), b"q")], "sha256 string, payload binary")
    asked = spark.createDataFrame([(x,) for x in "aabcdef"], "artifact_id string")
    found = {r.artifact_id: (r.payload and bytes(r.payload), r.error) for r in blobs.replay(observations, spark.createDataFrame([("v",)], "version_id string"), stored, asked).collect()}
    assert found == {"a": (b"x", None), "b": (None, "reference.dangling"), "c": (None, "reference.dangling"), "d": (None, "blob.corrupt"), "e": (None, "blob.corrupt"), "f": (None, "observation.not_found")}
