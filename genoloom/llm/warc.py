"""WARC archives as a Python data source, with duplicate payloads written as revisits.

Reading: files are dealt to partitions of about ``partitionBytes`` bytes. A record's headers are parsed first;
filters on header columns are pushed down and decided from them, and the rest of a record that fails, or whose
payload the schema doesn't ask for, is passed over without decoding: archives written here carry the
lengths of their gzip members in the "sl" extra field, others are decompressed and dropped as they pass.
Plain and gzip archives of other writers are read too.

Writing: each task writes its own archives, closed at about ``fileBytes`` bytes; the commit lists the files
of the tasks that count in a manifest of its own, so that retried or lost tasks leave nothing that is read. Appending adds a
manifest; overwriting removes those before it, and their files, once the new one is there. An archive is read by one task, as
other writers' archives have no index of their records.

Paths are URIs of any store that pyarrow's file systems open. Control characters and spaces in a URI
are percent-encoded; a null URI has no header and is read as null.

Defined results: null html is an empty payload; a null id is written and read back as null; repeated rows are records of their own, of
which the first in the input is the response; an empty table gives an archive without records; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from genoloom.llm import shared

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
COLUMNS = ("record_id", "record_type", "target_uri", "record_date", "payload_digest", "refers_to")
NAMES = ("warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-refers-to")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 0
_HEAD, _CHUNK, _EMPTY = 1 << 14, 1 << 18, b""


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# Records


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(record_id: str, kind: str, uri: str | None, date: str, payload: bytes, sha1: str, refers_to: str | None = None) -> bytes:
    """A response, or a revisit, whose block has the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date)]
    head += [("WARC-Target-URI", _clean(uri))] if uri is not None else []
    head += [("WARC-Payload-Digest", f"sha1:{sha1}")]
    head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")] if kind == "revisit" else []
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length and that of its content in the "sl" extra field."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    n = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, n, len(data)) if max(n, len(data)) < 1 << 32 else b"xx" + struct.pack("<HQ", 8, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Plain:
    """Bytes of an archive that isn't compressed."""

    def __init__(self, f):
        self.f = f

    def start(self) -> bool:
        """Go to the next record; False at the end."""
        while (c := self.f.read(1)) in (b"\r", b"\n"):
            pass
        self.f.seek(-len(c), 1)
        return bool(c)

    def line(self) -> bytes:
        return self.f.readline()

    def read(self, n: int) -> bytes:
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.f.seek(n, 1)

    def end(self) -> None:
        pass


class _Members:
    """Content of gzip members, one a record. ``end`` passes over what is left of a member."""

    def __init__(self, f):
        self.f, self.next = f, None

    def start(self) -> bool:
        if not (head := self.f.read(24)):
            return False
        at = self.f.tell() - len(head)
        sl = len(head) == 24 and head[3] & 4 and head[10:16] == b"\x0c\x00sl\x08\x00"
        self.next = at + struct.unpack("<I", head[16:20])[0] if sl else None
        self.f.seek(at)
        self.z, self.buffer, self.over = zlib.decompressobj(31), b"", False
        return True

    def _more(self, n: int) -> bool:
        while not self.over and len(self.buffer) < n:
            raw = self.z.unconsumed_tail or self.f.read(min(_CHUNK, max(4096, n)))
            if not raw:
                self.over = True
                break
            self.buffer += self.z.decompress(raw, max(4096, n - len(self.buffer)))
            if self.z.eof:
                self.over = True
                self.f.seek(-len(self.z.unused_data), 1)
        return len(self.buffer) >= n

    def line(self) -> bytes:
        n = 4096
        while (k := self.buffer.find(b"\n")) < 0 and self._more(n):
            n += 4096
        k = self.buffer.find(b"\n") if k < 0 else k
        k = len(self.buffer) if k < 0 else k + 1
        out, self.buffer = self.buffer[:k], self.buffer[k:]
        return out

    def read(self, n: int) -> bytes:
        self._more(n)
        out, self.buffer = self.buffer[:n], self.buffer[n:]
        return out

    def skip(self, n: int) -> None:
        if self.next is None:
            while n > 0 and (got := self.read(min(n, _CHUNK))):
                n -= len(got)

    def end(self) -> None:
        if self.next is not None:
            self.f.seek(self.next)
        else:
            while not self.over:
                self.buffer = b""
                self._more(_CHUNK)


def _headers(lines) -> dict[str, str]:
    out, last = {}, None
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if not line:
            break
        if line[0] in " \t" and last:
            out[last] += " " + line.strip()
            continue
        k, _, v = line.partition(":")
        last = k.strip().lower()
        out[last] = v.strip()
    return out


def records(f, wanted, payload: bool, verify: bool = False) -> Iterator[tuple[dict[str, str], int | None, bytes | None]]:
    """(headers, bytes of the payload, payload) of the records whose headers are ``wanted``.

    With ``verify``, payloads of responses are read whole, held against their digest, and measured."""
    gz = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    s = _Members(f) if gz else _Plain(f)
    while s.start():
        if not (first := s.line()).startswith(b"WARC/"):
            raise ValueError(f"no WARC record before byte {f.tell()}: {first[:40]!r}")
        h = _headers(iter(s.line, b""))
        left, kind = int(h.get("content-length", 0)), h.get("warc-type")
        if not wanted(h):
            s.skip(left)
            s.end()
            continue
        size, data = left, None
        if h.get("content-type", "").startswith("application/http"):
            lines = []
            while left > 0 and (line := s.line()):
                left -= len(line)
                lines.append(line)
                if not line.strip():
                    break
            size = int(_headers(lines[1:]).get("content-length", left))
        if payload or verify and kind == "response":
            data, left = s.read(left), 0
            if verify and kind == "response":
                size = len(data)
                if "sha1:" + digest(data) != h.get("warc-payload-digest"):
                    raise ValueError(f"payload of {h.get('warc-record-id')} doesn't match its digest")
        s.skip(left)
        s.end()
        yield h, size, data


# Data source


@dataclass
class Files(InputPartition):
    paths: list


@dataclass
class Written(WriterCommitMessage):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.at, self.names = options["path"], [c.name for c in schema.fields]
        self.bytes, self.verify = int(options.get("partitionBytes", 64 << 20)), str(options.get("verify", "false")).lower() == "true"
        self.schema, self.tests = schema, []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in COLUMNS and isinstance(f, EqualTo):
                self.tests.append((name, "in", (f.value,)))
            elif name in COLUMNS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in COLUMNS and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", f.value))
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        system, at = shared.filesystem(self.at)
        if system.get_file_info(at).type == fs.FileType.File:
            found = [system.get_file_info(at)]
        elif lists := _manifests(system, at):
            found = system.get_file_info([f"{at}/{n}" for m in lists for n in _listed(system, m)])
        else:
            found = [i for i in system.get_file_info(fs.FileSelector(at)) if re.search(r"\.warc(\.gz)?$", i.path)]
        out, size = [[]], 0
        for i in sorted(found, key=lambda i: i.path):
            if out[-1] and size + i.size > self.bytes:
                out.append([])
                size = 0
            out[-1].append(i.path)
            size += i.size
        return [Files(p) for p in out]

    def _wanted(self, h: dict) -> bool:
        for name, how, value in self.tests:
            own = _value(h, name)
            if own is None or (own not in value if how == "in" else not own.startswith(value)):
                return False
        return True

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, payload = to_arrow_schema(self.schema), "payload" in self.names
        system = shared.filesystem(self.at)[0]
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as raw:
                for h, n, data in records(io.BufferedReader(raw, 1 << 20), self._wanted, payload, self.verify):
                    rows.append(tuple({"payload": data, "payload_bytes": n, "headers": list(h.items())}[c] if c in ("payload", "payload_bytes", "headers") else _value(h, c) for c in self.names))
                    size += len(data or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _value(h: dict, column: str) -> str | None:
    v = h.get(NAMES[COLUMNS.index(column)])
    if v is None:
        return None
    return v[1:-1] if column in ("record_id", "refers_to") and v[:1] == "<" else v.removeprefix("sha1:") if column == "payload_digest" else v


def _manifests(system, at: str) -> list[str]:
    from pyarrow import fs

    return sorted(i.path for i in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if "/_manifest" in i.path)


def _listed(system, manifest: str) -> list[str]:
    with system.open_input_stream(manifest) as f:
        return f.read().decode().split()


class WarcWriter(DataSourceArrowWriter):
    """Of rows (record_id, record_type, target_uri, record_date, refers_to, payload)."""

    def __init__(self, options, overwrite: bool = False):
        self.overwrite = overwrite
        self.at, self.most = options["path"], int(options.get("fileBytes", 256 << 20))
        self.gz = str(options.get("compression", "gzip")).lower() != "none"

    def write(self, iterator):
        system, at = shared.filesystem(self.at)
        system.create_dir(at, recursive=True)
        paths, out, size = [], None, 0
        for b in iterator:
            cols = {n: b.column(n) for n in ("record_id", "record_type", "target_uri", "record_date", "refers_to", "payload")}
            for i in range(b.num_rows):
                rid, kind, uri, date, refers, payload = (c[i].as_py() for c in cols.values())
                payload = payload.encode() if isinstance(payload, str) else payload or b""
                data = record(rid, kind, uri, date, payload, digest(payload), refers)
                if out is None or size > self.most:
                    if out:
                        out.close()
                    paths.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * self.gz)
                    out, size = system.open_output_stream(f"{at}/{paths[-1]}", compression=None), 0
                data = member(data) if self.gz else data
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Written(paths)

    def commit(self, messages):
        system, at = shared.filesystem(self.at)
        system.create_dir(at, recursive=True)
        old = _manifests(system, at) if self.overwrite else []
        with system.open_output_stream(f"{at}/_manifest-{uuid.uuid4().hex}") as f:
            f.write("\n".join(p for m in messages if m for p in m.paths).encode())
        files = [f"{at}/{n}" for m in old for n in _listed(system, m)]
        for p in [*old, *files]:
            system.delete_file(p)

    def abort(self, messages):
        system, at = shared.filesystem(self.at)
        for p in [p for m in messages if m for p in m.paths]:
            system.delete_file(f"{at}/{p}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# Pages to archives and back


def write_pages(pages: DataFrame, at: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2024-01-01T00:00:00Z", mode: str = "append", **options) -> None:
    """A record for each row. Of equal payloads of ``min_revisit_bytes`` at least, the row with the smallest id
    (null last, then the first in the input) is a response and the others revisit it. Null html is an empty payload."""
    register(pages.sparkSession)
    pages = shared.numbered(pages)
    # the id's bytes in hexadecimal digits, so that ids of any type come back; a null id has none and no x
    rid = F.concat(F.lit("urn:genoloom:page:"), F.coalesce(F.concat(F.lit("x"), F.hex(F.col("_id").cast("string"))), F.lit("")), F.lit(":"), F.col("_rid"))
    base = pages.select(pages[shared.RID].alias("_rid"), pages[id_col].alias("_id"), pages[url_col].alias("target_uri"), F.coalesce(pages[html_col], F.lit("")).alias("payload"))
    base = base.withColumns({"_key": F.unhex(F.sha1("payload")), "_n": F.octet_length("payload"), "record_id": rid})
    first = base.groupBy("_key", "_n").agg(F.count("*").alias("_copies"), F.min(F.struct(F.col("_id").isNull(), "_id", "_rid", "record_id")).alias("_first"))
    first = first.filter((F.col("_copies") > 1) & (F.col("_n") >= min_revisit_bytes)).select("_key", "_n", F.col("_first.record_id").alias("_to"))
    rows = base.join(first, ["_key", "_n"], "left")
    again = F.col("_to") != F.col("record_id")
    rows = rows.select("record_id", F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("record_date"), F.when(again, F.col("_to")).alias("refers_to"), "payload")
    rows.write.format("warc").mode(mode).options(**options).save(at)


def read_pages(spark, at: str, kind: str = "long") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; payloads of responses are verified. ``kind`` is the ids' type."""
    register(spark)
    t = spark.read.format("warc").option("verify", "true").schema("record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string").load(at)
    t = t.filter(F.col("record_type").isin("response", "revisit"))
    page = lambda c: F.decode(F.unhex(F.nullif(F.split_part(F.split_part(c, F.lit(":"), F.lit(4)), F.lit("x"), F.lit(2)), F.lit(""))), "utf-8")
    page = lambda c, hexed=page: F.when(F.startswith(F.split_part(c, F.lit(":"), F.lit(4)), F.lit("x")), F.coalesce(hexed(c), F.lit(""))).cast(kind)
    return t.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    at = shared.folder(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_pages(pages, at)
    return read_pages(spark, at, pages.schema["page_id"].dataType.simpleString())


_BITS = "CASE h WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010' WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111' WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100' WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, list_reduce(list_transform(string_split(x, ''), lambda h: {_BITS}), lambda a, c: concat(a, c)) AS bits FROM p),
d AS (SELECT *, list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::BIGINT, 1)), lambda a, c: concat(a, c)) AS digest,
        row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY t ORDER BY page_id NULLS LAST) AS f FROM b)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM d
"""
