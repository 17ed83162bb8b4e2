"""A deterministic sharded WARC writer and its reader.

1. One pass takes each payload's digest and size. The first page (smallest id, then address) of every payload that several
   pages share is its response; the other pages get a marker that names it.
2. Pages and markers are sorted in ranges of their ids. The ranges hold about ``shard_bytes`` of payload each and follow from a
   sample that a hash of the row chooses, so the same rows always give the same ranges, whatever the cluster.
3. A task writes its range in order, every record as a gzip member of its own, and starts the next file when the compressed
   size would pass ``file_bytes``. All headers, record ids and digests are made anew from the row; nothing depends on a clock,
   so a rerun writes the same bytes.
4. Files are written under temporary names that no two attempts share. The rows that a task returns name its files; a second
   job moves these to their final names and writes the manifest, whose presence is the commit. Readers read what the
   manifest lists and check every digest.

Files are opened through ``pyarrow.fs``, so the folder may be on any store that it knows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.llm.common import forget, share_of, sliced, stored

#: Bytes of payload of a range, and of a compressed file. Ranges grow where there would be more than MOST_SHARDS.
SHARD_BYTES, FILE_BYTES, MOST_SHARDS = 64 << 20, 256 << 20, 100_000
#: Rows of the sample for each range; the driver holds 24 bytes for each.
SAMPLE = 20
#: Pages carry no time of capture.
DATE = "1970-01-01T00:00:00Z"
#: Fixed names of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_ROW = "shard int, id string, url string, digest string, kind int, first_id string, first_url string, payload binary"
_MANIFEST = "name string, temporary string, shard int, number int, records long, bytes long, sha1 string"
_READ = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, record_id string, file string, payload binary"
_UUID = uuid.UUID("6e2f7a0e-5d5b-5b0e-9c52-0d6a4f1d2b11")


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``uri`` and the path in it."""
    if re.match(r"file:/(?!/)", uri):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- which record is the response of its payload ---


def _order(c: Column, kind: str) -> Column:
    """A long that never falls as ``c`` rises; nulls first."""
    if kind == "string":
        c = F.conv(F.rpad(F.substring(F.hex(F.encode(c, "UTF-8")), 1, 14), 14, "0"), 16, 10)
    return F.coalesce(c.cast("long"), F.lit(-(2**63)))


def _slim(pages: DataFrame, id_col: str, url: str, html: str) -> DataFrame:
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    d = pages.select(F.col(id_col).alias("page"), F.col(url).alias("url"), F.sha1(payload).alias("digest"), payload.alias("payload"))
    # Rows of one id are ordered by address and payload, so a much repeated id is many ranges.
    return d.withColumns({"k": _order(F.col("page"), dict(pages.dtypes)[id_col]), "h": F.xxhash64("url", "digest")})


def _markers(slim: DataFrame, least_bytes: int) -> DataFrame:
    """(page, url, digest, first_page, first_url) for each page whose payload an earlier page has; pre-aggregated, and AQE can split a hot payload."""
    me = F.struct(F.col("page").isNull().alias("none"), "page", "url")
    some = slim.filter(F.col("bytes") >= least_bytes)
    firsts = stored(some.groupBy("digest").agg(F.min(me).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    return some.join(firsts, "digest").filter(~me.eqNullSafe(F.col("first"))).select("page", "url", "digest", "k", "h", F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url"))


# --- ranges ---


def _bounds(slim: DataFrame, shard_bytes: int, most_shards: int) -> tuple[np.ndarray, int]:
    """Lowest (k, h) of every range after the first, from a sample of at most about SAMPLE * ranges rows."""
    rows, total = slim.agg(F.count("*"), F.sum("bytes")).first()
    shards = min(-(-(total or 0) // shard_bytes), most_shards)
    if shards < 2:
        return np.zeros((0, 2), np.int64), 1
    s = slim.filter(share_of(SAMPLE * shards / rows, "k", "h")).select("k", "h", "bytes").toPandas().sort_values(["k", "h"])
    if s.empty:
        return np.zeros((0, 2), np.int64), 1
    cut = np.searchsorted(np.cumsum(s["bytes"].to_numpy()), np.arange(1, shards) / shards * s["bytes"].sum())
    keys = np.unique(s[["k", "h"]].to_numpy()[np.minimum(cut, len(s) - 1)], axis=0)
    return keys, len(keys) + 1


def range_of(k: np.ndarray, h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Number of bounds at or below (k, h)."""
    lo, hi = np.searchsorted(bounds[:, 0], k, "left"), np.searchsorted(bounds[:, 0], k, "right")
    for a, b in {*zip(lo.tolist(), hi.tolist(), strict=True)}:  # noqa: B007  few: one for each repeated bound
        if a < b:
            at = (lo == a) & (hi == b)
            lo[at] = a + np.searchsorted(bounds[a:b, 1], h[at], "right")
    return lo


def _range_column(bounds: np.ndarray) -> Column:
    if not len(bounds):
        return F.lit(0)

    @F.pandas_udf("int")
    def shard(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy(), h.to_numpy(), bounds).astype(np.int32))

    return shard("k", "h")


# --- records ---


def _clean(s: str | None) -> str:
    """A header's value: controls and spaces as %XX, so no address can end its line."""
    return "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in s or "")


def record_id(page: str | None, url: str | None, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_UUID, repr((page, url, digest, copy)))}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member. The same input gives the same bytes."""
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"WARC-Block-Digest: sha1:" + _digest(block).encode(), b"Content-Length: %d" % len(block)]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def page_record(page: str | None, url: str | None, payload: bytes, digest: str, first: tuple[str | None, str | None] | None, copy: int, date: str) -> bytes:
    """A response with its payload, or a revisit of ``first`` with the head of the response only; the head states the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    h = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(page, url, digest, copy)), ("WARC-Date", date)]
    if url is not None:
        h.append(("WARC-Target-URI", _clean(url)))
    h += [("WARC-Payload-Digest", f"sha1:{base32(digest)}"), ("Content-Type", "application/http;msgtype=response")]
    if page is not None:
        h.append(("Page-ID", _clean(page)))
    if first:
        h += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*first, digest)), ("WARC-Refers-To-Date", date)]
        if first[1] is not None:
            h.append(("WARC-Refers-To-Target-URI", _clean(first[1])))
        if first[0] is not None:
            h.append(("Refers-To-Page-ID", _clean(first[0])))
    return _record(h, head if first else head + payload)


class _Shard:
    """The open file of one range, and the manifest rows of its finished files."""

    def __init__(self, folder: str, temporary: str, shard: int, file_bytes: int, date: str):
        self.fs, self.root = store(folder)
        self.temporary, self.shard, self.most, self.date = temporary, shard, file_bytes, date
        self.out, self.number, self.rows = None, 0, []

    def add(self, member: bytes) -> None:
        if self.out and self.records and self.size + len(member) > self.most:
            self.close()
        if not self.out:
            self.name = f"{self.shard:06d}-{self.number:05d}.warc.gz"
            self.file = f"{self.temporary}/{self.name}-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sha1 = self.fs.open_output_stream(f"{self.root}/{self.file}"), 0, 0, hashlib.sha1()
            about = f"software: railbird\r\nformat: WARC File Format 1.1\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, self.name, "")), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.sha1.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.rows.append((self.name, self.file, self.shard, self.number, self.records, self.size, self.sha1.hexdigest()))
            self.out, self.number = None, self.number + 1


def _write_ranges(folder: str, temporary: str, file_bytes: int, date: str):
    names = [x.split()[0] for x in _MANIFEST.split(", ")]
    schema = pa.schema(list(zip(names, [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()], strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = mark = at = None
        copy = 0
        for b in sliced(batches):
            for shard, page, url, digest, kind, first_id, first_url, payload in zip(*(b.column(c).to_pylist() for c in ("shard", "id", "url", "digest", "kind", "first_id", "first_url", "payload")), strict=True):
                if kind == 0:
                    mark = ((page, url, digest), (first_id, first_url))
                    continue
                if out is None or out.shard != shard:
                    if out:
                        out.close()
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out.rows], schema)
                    out = _Shard(folder, temporary, shard, file_bytes, date)
                me = (page, url, digest)
                copy = copy + 1 if me == at else 0
                at = me
                first = mark[1] if mark and mark[0] == me else None
                if first is None and copy and kind == 2:  # repeated rows visit the first of them again
                    first = (page, url)
                out.add(page_record(page, url, payload or b"", digest, first, copy, date))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out.rows], schema)

    return run


def _move(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for b in batches:
            for r in b.select(["name", "temporary", "bytes"]).to_pylist():
                last = fs.get_file_info(f"{root}/{r['name']}")
                if fs.get_file_info(f"{root}/{r['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{root}/{r['temporary']}", f"{root}/{r['name']}")
                elif last.type == pafs.FileType.NotFound or last.size != r["bytes"]:  # not moved by an earlier attempt either
                    raise FileNotFoundError(r["temporary"])
            yield b

    return run


def write(
    pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html",
    least_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, most_shards: int = MOST_SHARDS, date: str = DATE,
) -> DataFrame:
    """Write one record for each row of ``pages`` to ``folder`` and return the manifest (name, shard, number, records, bytes, sha1).

    ``folder`` must be shared by all machines and hold no archive yet. Of payloads of at least ``least_bytes`` bytes the page with the smallest id (then address) is the
    response and others are revisits of it; smaller ones are all responses. Null payloads are empty, so they are equal. A null id
    comes after all others as a response, and its record has no id; a null address gives a record without target. Of rows that repeat id, address and payload the first is the response;
    such equal rows are written by one task, one after the other. Controls and spaces in ids and addresses become %XX. A record
    larger than ``file_bytes`` has a file of its own. An empty table gives an archive without files. Columns other than the three
    are not carried, whatever their names.
    """
    fs, root = store(folder)
    if fs.get_file_info(f"{root}/_manifest").type != pafs.FileType.NotFound:
        raise FileExistsError(f"{folder} holds an archive")
    d = _slim(pages, id_col, url, html)
    slim = stored(d.withColumn("bytes", F.octet_length("payload").cast("long")).drop("payload"))
    bounds, shards = _bounds(slim, shard_bytes, most_shards)
    shard, text = _range_column(bounds), lambda c: F.col(c).cast("string")
    # kind 0: marker, 1: page too small to be compared, 2: page
    big = F.when(F.octet_length("payload") >= least_bytes, 2).otherwise(1)
    rows = d.select(shard.alias("shard"), "k", "h", "page", "url", "digest", big.alias("kind"), F.lit(None).cast("string").alias("first_id"), F.lit(None).cast("string").alias("first_url"), "payload")
    m = _markers(slim, least_bytes)
    marks = m.select(shard.alias("shard"), "k", "h", "page", "url", "digest", F.lit(0).alias("kind"), text("first_page").alias("first_id"), F.col("first_url"), F.lit(None).cast("binary").alias("payload"))
    rows = rows.unionByName(marks).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "k", "page", "h", "url", "digest", "kind")
    rows = rows.select("shard", text("page").alias("id"), "url", "digest", "kind", "first_id", "first_url", "payload")
    temporary = f"_temporary-{uuid.uuid4().hex}"
    fs.create_dir(f"{root}/{temporary}", recursive=True)
    written = stored(rows.mapInArrow(_write_ranges(folder, temporary, file_bytes, date), _MANIFEST))
    # The folder is written last: it is the commit.
    written.mapInArrow(_move(folder), _MANIFEST).drop("temporary").write.parquet(f"{folder}/_manifest")
    fs.delete_dir(f"{root}/{temporary}")
    forget(slim, written)
    return manifest(pages.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_manifest")


# --- reading ---


def _members(f, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of an open file, one at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or f.read(chunk)
        if not data:
            if parts:
                raise ValueError("the file ends inside a record")
            return
        parts.append(z.decompress(data))
        data = b""
        if z.eof:
            yield b"".join(parts)
            data, z, parts = z.unused_data, zlib.decompressobj(31), []


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record; raises ValueError where lengths or digests disagree."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0].encode() != VERSION:
        raise ValueError("no WARC record")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    if rest[len(block) :] != b"\r\n\r\n" or len(block) != int(h["content-length"]) or h["warc-block-digest"] != f"sha1:{_digest(block)}":
        raise ValueError(f"damaged record {h.get('warc-record-id')}")
    return h, block


def _row(h: dict[str, str], block: bytes, name: str, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if h["warc-type"] == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"damaged payload {h['warc-record-id']}")
    return {
        "page_id": h.get("page-id"), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "payload_bytes": size, "payload_digest": digest,
        "refers_to": h.get("refers-to-page-id"), "record_id": h["warc-record-id"], "file": name, "payload": payload if with_payload and h["warc-type"] == "response" else None,
    }


def _read_files(folder: str, with_payload: bool, rows: int = 256):
    names = [x.split()[0] for x in _READ.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for b in batches:
            for name, records in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
                part, size, n = [], 0, 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in map(parse, _members(f)):
                        if h["warc-type"] == "warcinfo":
                            continue
                        part.append(_row(h, block, name, with_payload))
                        n, size = n + 1, size + len(block)
                        if len(part) >= rows or size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(part, schema)
                            part, size = [], 0
                if n != records:
                    raise ValueError(f"{name} has {n} of {records} records")
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema)

    return run


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of an archive: page_id, url, record_type, payload_bytes, payload_digest, refers_to, record_id, file, payload.

    Ids are text. A revisit's payload is null; its length and digest are those of the full payload. One task a file, one record at a
    time. A damaged or missing file is an error, and so is a folder without a manifest.
    """
    files = manifest(spark, folder)
    return files.repartition(max(1, files.count())).mapInArrow(_read_files(folder, with_payload), _READ)


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, {10 * g + 1}, 10))::BIGINT >> {s}) & 31) + 1)::INT, 1)" for g in range(4) for s in range(35, -1, -5)
)
ORACLE = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY hex) AS first FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
