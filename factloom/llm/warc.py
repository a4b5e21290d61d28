"""Seekable Zstandard bundles of WARC records.

Records are grouped into independent frames of about ``FRAME`` bytes, frames
into bundles of about ``BUNDLE`` bytes. A bundle ends in the seek table of the
public seekable format (a skippable frame: compressed and decompressed size of
every frame, then count, descriptor and magic number), so plain decompressors
read it whole and seeking readers jump. An index maps each record id to its
bundle, its frame's place and its offset in that frame. A bundle opens with a
``warcinfo`` record; a page's record holds the HTTP message, head and body.

Bundles are rows ``(bundle, body, frames, index)`` of a written table, so they
live in whatever store Spark writes to; ``export`` lets tasks write them as files.

Payloads: of records with equal payloads of at least ``least`` bytes, that
with the smallest id is a response and the others are revisits that name it
and hold the HTTP head alone; the payload digest is the bare upper-case base32
SHA-1. A record id is the page's id and the record's row number, so ids are
unique also where page ids repeat or are null. Row numbers are given once, in
a written copy of the pages, and every later step reads that.

Memory: a task that writes holds one bundle and one record, one that reads one
bundle and one frame.

Defined cases: a null payload is empty; a null id counts as smallest and is
written as an empty string; of rows with equal ids and payloads the first row
is the response; an empty table gives no bundle; a record over FRAME or BUNDLE
bytes has a frame, or a bundle, of its own; other columns are passed over,
whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pa_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Workspace, long_key, raw, table

FRAME = 256 << 10
BUNDLE = 8 << 20
LEVEL = 3
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the seek table.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1

BUNDLES = "bundle string, body binary, frames array<struct<start:bigint,size:bigint,plain:bigint>>, index array<struct<record:string,frame:int,start:bigint,size:bigint>>"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def _head(lines: list[str]) -> bytes:
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def _urn(record_id: str) -> str:
    return f"<urn:page:{record_id}>"


def record(record_id: str, url: str, payload: bytes, named: str, refers: str | None) -> bytes:
    """One WARC/1.1 response, or a revisit without a body where it refers to another record."""
    message = _head(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"])
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(record_id)}",
        f"WARC-Target-URI: {url.translate({10: '%0A', 13: '%0D'})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{named}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers is None:
        message += payload
    else:
        lines += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return _head([*lines, f"Content-Length: {len(message)}"]) + message + b"\r\n\r\n"


def warcinfo(bundle: str) -> bytes:
    body = _head(["software: factloom", "format: WARC File Format 1.1"])[:-2]
    return _head(["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:bundle:{bundle}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Filename: {bundle}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}"]) + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and body of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record of the wrong length")
    return fields, rest[:size]


def http(message: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and body of the HTTP message in a record."""
    head, _, body = message.partition(b"\r\n\r\n")
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:]), body


class Writer:
    """Gathers records to frames and frames to bundles; memory is that of one bundle and one record."""

    def __init__(self, name: str, frame: int, bundle: int):
        self.task, self.frame, self.bundle, self.number = name, frame, bundle, 0
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self._fresh()

    def _fresh(self):
        self.name = f"{self.task}-{self.number:05d}"
        self.parts, self.frames, self.index, self.size = [], [], [], 0
        self.plain = [warcinfo(self.name)]
        self.held = len(self.plain[0])

    def add(self, record_id: str, data: bytes) -> Iterator[tuple]:
        if self.index and self.held and self.held + len(data) > self.frame:
            self._close_frame()
            if self.size >= self.bundle:
                yield self.close()
        self.index.append((record_id, len(self.frames), self.held, len(data)))
        self.plain.append(data)
        self.held += len(data)

    def _close_frame(self):
        if self.plain:
            body = self.press.compress(b"".join(self.plain))
            self.frames.append((self.size, len(body), self.held))
            self.parts.append(body)
            self.size += len(body)
            self.plain, self.held = [], 0

    def close(self) -> tuple:
        self._close_frame()
        entries = b"".join(struct.pack("<II", size, plain) for _, size, plain in self.frames)
        foot = entries + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        out = (self.name, b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(foot)) + foot, self.frames, self.index)
        self.number += 1
        self._fresh()
        return out


def seek_table(body: bytes) -> list[tuple[int, int, int]]:
    """``(start, size, plain size)`` of the frames, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", body[-9:])
    if magic != SEEKABLE or flags:
        raise ValueError("no seek table")
    foot = 8 * count + 9
    if struct.unpack("<II", body[-foot - 8 : -foot]) != (SKIPPABLE, foot):
        raise ValueError("a broken seek table")
    out, start = [], 0
    for k in range(count):
        size, plain = struct.unpack_from("<II", body, len(body) - foot + 8 * k)
        out.append((start, size, plain))
        start += size
    return out


def lookup(body: bytes, frame: int, start: int, size: int) -> bytes:
    """One record by its place in the index; only its frame is decompressed."""
    at, packed, plain = seek_table(body)[frame]
    return zstandard.ZstdDecompressor().decompress(body[at : at + packed], max_output_size=plain)[start : start + size]


def numbered(ws: Workspace, pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """A written copy ``(row, key, id, url, body, sha, size)`` of the pages."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), long_key(F.col(page_id)).alias("key"), F.coalesce(F.col(page_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"))
    return ws.write(rows.withColumn("sha", F.sha1("body")).withColumn("size", F.octet_length("body")))


def roles(rows: DataFrame, *, least: int = 0) -> DataFrame:
    """``(row, refers)``: the revisits only, each with the record id of its response. A payload that
    very many rows share is a map-side minimum, then one row to which the adaptive join brings them in parts."""
    named = rows.where(F.col("size") >= least).select("row", "key", "id", "sha")
    first = named.groupBy("sha").agg(F.min(F.struct("key", "row", "id")).alias("f"), F.count("*").alias("n")).where("n > 1").select("sha", F.col("f.row").alias("first"), _record_id("f.id", "f.row").alias("refers"))
    return named.join(first, "sha").where("row <> first").select("row", "refers")


def _record_id(page_id: str, row: str):
    return F.concat_ws("/", page_id, row)


def bundles(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, frame: int = FRAME, bundle: int = BUNDLE) -> DataFrame:
    """``pages`` as a table of seekable bundles."""
    ws = Workspace(pages.sparkSession)
    stored = numbered(ws, pages, page_id=page_id, url=url, payload=payload)
    revisits = ws.write(roles(stored, least=least))
    rows = stored.join(revisits, "row", "left").select(_record_id("id", "row").alias("record"), "url", "body", "refers")

    def run(batches):
        writer = Writer(f"part-{TaskContext.get().partitionId():05d}", frame, bundle)
        out = []
        kind = _schema()
        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                for own, link, data, refers in zip(part.column("record").to_pylist(), part.column("url").to_pylist(), raw(part, "body"), part.column("refers").to_pylist(), strict=True):
                    out += writer.add(own, record(own, link, data, digest(data), refers))
                    while out:
                        yield pa.RecordBatch.from_pylist([dict(zip(kind.names, _rows(out.pop()), strict=True))], schema=kind)
        if writer.index:
            yield pa.RecordBatch.from_pylist([dict(zip(kind.names, _rows(writer.close()), strict=True))], schema=kind)

    return ws.write(rows.mapInArrow(run, BUNDLES), codec="uncompressed")


def _rows(bundle: tuple) -> tuple:
    name, body, frames, index = bundle
    return name, body, [dict(zip(("start", "size", "plain"), x, strict=True)) for x in frames], [dict(zip(("record", "frame", "start", "size"), x, strict=True)) for x in index]


def _schema() -> pa.Schema:
    big = pa.int64()
    return pa.schema(
        [
            ("bundle", pa.string()),
            ("body", pa.binary()),
            ("frames", pa.list_(pa.struct([("start", big), ("size", big), ("plain", big)]))),
            ("index", pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("start", big), ("size", big)]))),
        ]
    )


def read(stored: DataFrame) -> DataFrame:
    """Every page's record in the bundles, by way of seek table and index:
    ``(record, page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to)``, ids of pages as strings."""
    names = ("record", "page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to")
    kinds = {"payload": pa.binary(), "payload_bytes": pa.int64()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def unwrap(x: str) -> str:
        return x.removeprefix("<urn:page:").removesuffix(">")

    def run(batches):
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                body, table, press = row["body"], seek_table(row["body"]), zstandard.ZstdDecompressor()
                by_frame: dict[int, list] = {}
                for x in row["index"]:
                    by_frame.setdefault(x["frame"], []).append(x)
                for k, (start, size, plain) in enumerate(table):
                    data, out = press.decompress(body[start : start + size], max_output_size=plain), []
                    for x in by_frame.get(k, []):
                        fields, message = parse(data[x["start"] : x["start"] + x["size"]])
                        head, payload = http(message)
                        kind, named, own, n = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), unwrap(fields["WARC-Record-ID"]), int(head["Content-Length"])
                        if own != x["record"] or kind == "response" and (digest(payload) != named or len(payload) != n):
                            raise ValueError(f"record {x['record']} does not match its fields")
                        refers = fields.get("WARC-Refers-To")
                        out.append((own, own.rpartition("/")[0], fields["WARC-Target-URI"], kind, payload if kind == "response" else None, n, named, refers and unwrap(refers).rpartition("/")[0]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)] if out else [pa.array([], f.type) for f in schema], schema=schema)

    return stored.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if n == 'payload_bytes' else 'string'}" for n in names))


def export(stored: DataFrame, folder: str) -> list[str]:
    """Each bundle as the file ``<bundle>.warc.zst`` of ``folder``, a path or URI of a file system that tasks reach.
    Tasks write the files, each first under a name of its own attempt, so a repeated task leaves whole files. The names written."""

    def run(batches):
        store, root = pa_fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for at in range(len(batch)):
                row = batch.slice(at, 1).to_pylist()[0]
                name = f"{row['bundle']}.warc.zst"
                attempt = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(attempt) as out:
                    out.write(row["body"])
                store.move(attempt, f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"file": [name]})

    return [r.file for r in stored.select("bundle", "body").mapInArrow(run, "file string").collect()]


def op5_warc_bundles(spark, sf_dir):
    """One row per page, read back from the bundles."""
    got = read(bundles(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    whole = lambda c: F.when(F.col(c) != "", F.col(c).cast("long"))
    return got.select(whole("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", whole("refers_to").alias("refers_to"))


#: Base32 is 32 groups of 5 bits; a hex digit gives four.
OP5_SQL = """
with body as (select page_id, coalesce(html, '') as html from pages),
hexed as (select page_id, octet_length(encode(html)) as size, sha1(html) as h from body),
bits as (
  select page_id, size, h,
         array_to_string(list_transform(range(40), lambda k: lpad(bin(('0x' || substring(h, (k + 1)::bigint, 1))::int), 4, '0')), '') as b
  from hexed),
named as (
  select page_id, size, array_to_string(list_transform(range(32), lambda k:
           substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j:
             (substring(b, (k * 5 + j + 1)::bigint, 1) = '1')::int * (1 << (4 - j)::int))))::bigint, 1)), '') as digest
  from bits),
least as (select digest, min(page_id) as first from named group by digest)
select page_id, size::bigint as payload_bytes, digest as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from named join least using (digest)
"""
