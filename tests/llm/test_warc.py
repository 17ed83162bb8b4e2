"""The WARC writer: round trips against plain Python, equal bytes on every run, and damage."""

from __future__ import annotations

import base64
import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from railbird.llm import warc

COLUMNS = "page_id long, url string, html string, shard string, digest int, kind double"


def page(i, url, html):
    return (i, url, html, f"own-{i}", i, 0.5)


def planted():
    rows = [page(i, f"http://a.example/{i}", f"<p>page {i % 40} " + "x" * (i % 7) * 50) for i in range(300)]
    rows += [page(300 + i, None if i % 2 else f"http://b.example/ü\r\nWARC-Type: {i} x", None if i % 3 else "") for i in range(30)]
    rows += [page(7, "http://a.example/7", rows[7][2])] * 4 + [page(None, "http://n.example/1", "<p>without id"), page(None, None, rows[3][2]), page(400, "http://c.example", "<p>without id")]
    rows += [page(500, "http://long.example", "é" * 300_000), page(501, "http://long.example", "\u0000\r\n\r\nWARC/1.1\r\n" * 3), page(-5, "http://neg.example", "<p>page 1 " + "x" * 50)]
    return rows


def expected(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by one pass in order of id, address."""
    out, first = [], {}
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        data = (r[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        seen = digest in first and len(data) >= least
        out.append((r[0], len(data), digest, "revisit" if seen else "response", first[digest] if seen else None))
        first.setdefault(digest, r[0])
    return sorted(out, key=repr)


def got(df):
    number = lambda x: None if x is None else int(x)
    return sorted(((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip(spark, tmp_path, least):
    rows = planted()
    folder = str(tmp_path / "w")
    m = warc.write(spark.createDataFrame(rows, COLUMNS).repartition(7), folder, least_bytes=least, shard_bytes=4000, file_bytes=1500).collect()
    assert len({r.shard for r in m}) > 5 and max(r.number for r in m) > 0 and sum(r.records for r in m) == len(rows)
    r = warc.read(spark, folder)
    assert got(r) == expected(rows, least)
    # Payloads and ids come back whole.
    texts = {(x.page_id and int(x.page_id), bytes(x.payload).decode()) for x in r.filter("record_type = 'response'").collect()}
    assert texts <= {(x[0], x[2] or "") for x in rows} and len(texts) >= 50
    ids = {x.record_id for x in r.collect()}
    assert len(ids) == len(rows)


def test_files_are_sorted_gzip_members(spark, tmp_path):
    folder = str(tmp_path / "w")
    m = sorted(warc.write(spark.createDataFrame(planted(), COLUMNS), folder, shard_bytes=4000, file_bytes=1500).collect())
    order = []
    for r in m:
        data = Path(folder, r.name).read_bytes()
        assert len(data) == r.bytes and hashlib.sha1(data).hexdigest() == r.sha1
        assert r.bytes <= 1500 or r.records == 1
        text = gzip.decompress(data)
        order += [int(x.split(b"\r\n")[0]) if b"Page-ID: " in text else None for x in text.split(b"\r\nPage-ID: ")[1:]]
    assert order == sorted(order)
    assert {p.name for p in Path(folder).iterdir() if not p.name.startswith(".")} == {r.name for r in m} | {"_manifest"}


def test_a_rerun_writes_the_same_bytes(spark, tmp_path):
    d = spark.createDataFrame(planted(), COLUMNS)
    one = warc.write(d.repartition(9), str(tmp_path / "a"), shard_bytes=4000, file_bytes=1500)
    two = warc.write(d.repartition(2, "html").sort(F.desc("url")), str(tmp_path / "b"), shard_bytes=4000, file_bytes=1500)
    assert sorted(one.collect()) == sorted(two.collect())


def test_edges(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    assert warc.write(empty, str(tmp_path / "e")).count() == 0 and warc.read(spark, str(tmp_path / "e")).count() == 0
    with pytest.raises(FileExistsError):
        warc.write(empty, str(tmp_path / "e"))
    text_ids = spark.createDataFrame([("b", "u", "x"), ("a", "u", "x"), ("ab\n", "u", "y"), ("a" * 30, "v", "x")], "page_id string, url string, html string")
    warc.write(text_ids, str(tmp_path / "t"))
    assert {(r.page_id, r.record_type, r.refers_to) for r in warc.read(spark, str(tmp_path / "t")).collect()} == {("b", "revisit", "a"), ("a", "response", None), ("ab%0A", "response", None), ("a" * 30, "revisit", "a")}


def test_damage_is_an_error(spark, tmp_path):
    folder = tmp_path / "w"
    m = warc.write(spark.createDataFrame(planted()[:5], COLUMNS), str(folder)).collect()
    file = folder / m[0].name
    whole = file.read_bytes()
    file.write_bytes(whole[:-40])
    with pytest.raises(Exception, match="ends inside a record|Error"):
        warc.read(spark, str(folder)).collect()
    file.write_bytes(gzip.compress(gzip.decompress(whole).replace(b"page 3", b"page 9")))
    with pytest.raises(Exception, match="damaged|no WARC"):
        warc.read(spark, str(folder)).collect()


def test_a_move_that_was_done_before_is_passed_over(tmp_path):
    import pyarrow as pa

    (tmp_path / "a.warc.gz").write_bytes(b"12345")
    rows = pa.RecordBatch.from_pylist([{"name": "a.warc.gz", "temporary": "_temporary/x", "bytes": 5}])
    assert len(list(warc._move(str(tmp_path))(iter([rows])))) == 1
    with pytest.raises(FileNotFoundError):
        list(warc._move(str(tmp_path))(iter([pa.RecordBatch.from_pylist([{"name": "b.warc.gz", "temporary": "_temporary/x", "bytes": 5}])])))


def test_ranges_split_a_repeated_id():
    bounds = np.array([[5, -10], [5, 0], [5, 7], [9, 1]])
    k, h = np.array([1, 5, 5, 5, 5, 9, 9, 10]), np.array([99, -11, -10, 3, 8, 0, 1, -99])
    assert warc.range_of(k, h, bounds).tolist() == [sum((a, b) <= (x, y) for a, b in bounds.tolist()) for x, y in zip(k.tolist(), h.tolist(), strict=True)]
