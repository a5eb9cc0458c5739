"""WARC packages: exact round trips, ZIP64, and damage."""

import base64
import gzip
import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from lexivec.llm import warc
from lexivec.llm.queries import op3_warc_packages

PAGES = [
    (5, "http://a.example/x", "<p>one</p>"), (3, "http://a.example/y", "<p>one</p>"), (9, None, "<p>one</p>"), (4, "http://b.example/\r\nX: y z", None),
    (8, "http://c.example/", ""), (2, "ü://ö", "<p>größe 한 \r\n\r\n x</p>" * 3), (7, "", "x" * 3_000_000), (None, "n", "<p>two</p>"), (6, "n", "<p>two</p>"), (None, "m", "only null"),
    (None, "m", "only null"), (3, "http://a.example/y", "<p>one</p>"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string")


def test_round_trip(spark, tmp_path):
    manifest = warc.archive(frame(spark, PAGES).repartition(3), folder=f"file://{tmp_path}/w")
    assert manifest.agg({"records": "sum"}).first()[0] == len(PAGES)
    got = warc.read_packages(manifest).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in PAGES:
        data = (h or "").encode()
        other = first.get(h or "") if first.get(h or "") != i else None
        url = None if u is None else u.replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20")
        want.append(str((i, url, "response" if other is None else "revisit", other, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), data if other is None else None)))
    assert sorted(str(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r)) for r in got) == sorted(want)


def test_small_payloads_are_never_revisits(spark, tmp_path):
    out = warc.read_packages(warc.archive(frame(spark, PAGES), revisit_from=11, folder=f"file://{tmp_path}/w")).collect()
    assert {r.record_type for r in out if r.payload_bytes < 11} == {"response"}


def test_op3_empty_table(spark, tmp_path):
    frame(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert op3_warc_packages(spark, str(tmp_path)).count() == 0


def test_packages_split_by_size(spark, tmp_path):
    rows = warc.with_references(frame(spark, [(i, None, f"{i} page " * 400) for i in range(50)]).coalesce(1), id_column="page_id", url="url", payload="html", revisit_from=0)
    manifest = warc.write_packages(rows.coalesce(1), f"file://{tmp_path}/w", package_bytes=600)
    assert manifest.count() > 5
    assert sorted(r.page_id for r in warc.read_packages(manifest).collect()) == list(range(50))


def package(*pages):
    p = warc.Package()
    for page in pages:
        p.add(*page)
    return p


def test_zip64_directory(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = package((1, "u", b"a" * 500, None), (2, "v", b"", 1)).bytes()
    assert b"PK\x06\x06" in data
    rows = list(warc.read_records(pa.PythonFile(io.BytesIO(data), mode="r")))
    assert [(r[0], r[2], r[3], r[4]) for r in rows] == [(1, "response", None, 500), (2, "revisit", 1, 0)]


def test_standard_tools_read_it():
    data = package((1, "u", b"hello", None)).bytes()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == [warc.ARCHIVE, warc.INDEX]
        assert gzip.decompress(z.read(warc.ARCHIVE)).endswith(b"hello\r\n\r\n")


def test_damage_is_reported():
    data = bytearray(warc.record(1, "u", b"hello", None))
    data[data.index(b"hello")] = ord("j")
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bytes(data))
    with pytest.raises(ValueError, match="central"):
        warc.directory(pa.PythonFile(io.BytesIO(b"x" * 100), mode="r"))


def test_directory_tolerates_a_comment_and_leading_bytes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(warc.ARCHIVE, b"")
        z.writestr(warc.INDEX, b"")
        z.writestr("other.txt", b"x" * 10, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment"
    f = pa.PythonFile(io.BytesIO(out.getvalue()), mode="r")
    assert set(warc.directory(f)) == {warc.ARCHIVE, warc.INDEX}
    assert list(warc.read_records(f)) == []
