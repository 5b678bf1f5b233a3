"""Data sources ``gff`` and ``fasta``: features, and records of sequences, of files of any size.

    register(spark)
    spark.read.format("gff").load("/genomes").filter("type = 'CDS'")
    spark.read.format("fasta").option("paths", "/a.fna\\n/b.gff.gz").load()

A file is read in ranges of ``splitBytes``, a task each; a line, or a record, belongs to the range it begins in, and a task holds one record at a
time. Compressed files are streamed, each by one task. The places of lines in their file are their order (``line_no``,
``rec_no``). Of a GFF file, ``gff`` passes over the sequences after ``##FASTA`` a block at a time, and ``fasta`` over what comes before
the first record. Tests of ``type``, ``seqid`` and ``name`` for equality are pushed down, so that no other cell of a line
that fails, and no other sequence, is kept. Of a folder, files are read whose names match ``pattern`` (by default those of ``NAMES``).

Defined results: blank lines, comments and lines without a tab are no features; cells that a line lacks, and places that are no numbers, are null, and those
beyond nine are only counted (``cells``); a record
without a name is left out; white space that ends a line of a sequence goes; no files give no rows.
"""

from __future__ import annotations

import gzip
import os
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

FEATURES = "path string, line_no long, seqid string, source string, type string, start int, end int, score string, strand string, phase string, attrs string, cells int"
RECORDS = "path string, rec_no long, name string, seq string"
NAMES = {"gff": r"\.gff3?(\.gz)?$", "fasta": r"\.(fna|faa|fa|fasta|ffn|gff3?)(\.gz)?$"}
SPLIT, BLOCK, ROWS, BYTES = 64 << 20, 4 << 20, 20_000, 8 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def lines(f, start: int = 0, skip: bytes = b"") -> Iterator[tuple[int, bytes]]:
    """(place, line without its end) from the first line that begins at ``start`` or later. Blocks without the byte ``skip``, where it is given, give
    nothing, unless they hold a directive."""
    at, rest = start, b""
    if start:
        f.seek(start - 1)
        while block := f.read(BLOCK):
            cut = block.find(b"\n")
            if cut >= 0:
                at, rest = at - 1 + cut + 1, block[cut + 1 :]
                break
            at += len(block)
        else:
            return
    while True:
        block = f.read(BLOCK)
        whole, last = (rest + block, b"") if not block else (rest + block).rpartition(b"\n")[::2] if b"\n" in block or b"\n" in rest else (None, rest + block)
        if whole is not None:
            if skip and skip not in whole and b"##" not in whole:
                at += len(whole) + 1
            else:
                for line in whole.split(b"\n"):
                    yield at, line.rstrip(b"\r")
                    at += len(line) + 1
        rest = last
        if not block:
            return


def features(f, start: int, end: int | None, wanted: dict[str, tuple]) -> Iterator[tuple]:
    """Cells of the lines of a range that pass the tests of ``type`` and ``seqid``."""
    kinds, ids = (None if (v := wanted.get(k)) is None else {x.encode() for x in v} for k in ("type", "seqid"))
    for at, line in lines(f, start, b"\t"):
        if end is not None and at >= end or line.startswith(b"##FASTA"):
            return
        if line[:1] in (b"#", b">", b"") or b"\t" not in line:
            continue
        c = line.split(b"\t")
        if (kinds is None or len(c) > 2 and c[2] in kinds) and (ids is None or c[0] in ids):
            yield at, [x.decode("utf-8", "replace") for x in c]


def records(f, start: int, end: int | None, wanted: dict[str, tuple]) -> Iterator[tuple[int, str, str]]:
    """(place, name, sequence) of the records that begin in a range."""
    names, name, place, parts = None if wanted.get("name") is None else set(wanted["name"]), None, 0, []
    for at, line in lines(f, start):
        if line[:1] == b">":
            if name:
                yield place, name, b"".join(parts).decode()
            name, parts = None, []
            if end is not None and at >= end:
                return
            found = line[1:].rstrip().split(b" ", 1)[0].decode("utf-8", "replace")
            name, place = found if names is None or found in names else None, at
        elif name:
            parts.append(line.rstrip())
        elif end is not None and at >= end:
            return
    if name:
        yield place, name, b"".join(parts).decode()


def _number(x: str) -> int | None:
    return int(x) if re.fullmatch(r"\s*[+-]?\d+\s*", x) and -(1 << 31) <= int(x) < 1 << 31 else None


class GenomeReader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.wanted = kind, {}
        self.paths = [p for p in options.get("paths", "").split("\n") if p] or ([options["path"]] if options.get("path") else [])
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT)))
        self.pattern = options.get("pattern", NAMES[kind])

    def pushFilters(self, filters):
        mine = ("type", "seqid") if self.kind == "gff" else ("name",)
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in mine and isinstance(f, (EqualTo, In)):
                own = tuple(f.value) if isinstance(f, In) else (f.value,)
                old = self.wanted.get(name)
                self.wanted[name] = own if old is None else tuple(x for x in old if x in own)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        out = []
        for given in self.paths:
            system, at = _system(given)
            info = system.get_file_info(at)
            if info.type == fs.FileType.Directory:
                prefix = given.rstrip("/")
                found = sorted((i.path, i.size) for i in system.get_file_info(fs.FileSelector(at, recursive=True)) if i.type == fs.FileType.File and re.search(self.pattern, i.path, re.I))
                files = [(f"{prefix}/{p[len(at.rstrip('/')) + 1 :]}", size) for p, size in found]
            elif info.type == fs.FileType.File:
                files = [(given, info.size)]
            else:
                raise FileNotFoundError(given)
            for path, size in files:
                if path.lower().endswith(".gz"):
                    out.append(Range(path, 0, None))
                else:
                    out += [Range(path, k, min(k + self.split, size)) for k in range(0, size, self.split)]
        return out or [Range("", 0, 0)]

    def read(self, part):
        import pyarrow as pa

        if not part.path:
            return
        text, number = pa.string(), pa.int64()
        if self.kind == "gff":
            names, types = [c.split()[0] for c in FEATURES.split(", ")], [text, number, text, text, text, pa.int32(), pa.int32(), text, text, text, text, pa.int32()]
        else:
            names, types = [c.split()[0] for c in RECORDS.split(", ")], [text, number, text, text]
        system, at = _system(part.path)
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

        with system.open_input_file(at) as raw:
            f = gzip.GzipFile(fileobj=raw) if part.path.lower().endswith(".gz") else raw
            if self.kind == "gff":
                for place, c in features(f, part.start, part.end, self.wanted):
                    n = len(c)
                    c = c[:9] + [None] * (9 - n)
                    c[3], c[4] = (_number(x) if x is not None else None for x in c[3:5])
                    rows.append((part.path, place, *c, n))
                    if len(rows) >= ROWS:
                        yield batch()
                        rows = []
            else:
                for place, name, seq in records(f, part.start, part.end, self.wanted):
                    rows.append((part.path, place, name, seq))
                    size += len(seq)
                    if size >= BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


class _Source(DataSource):
    def reader(self, schema):
        return GenomeReader(self.name(), self.options)


class GffSource(_Source):
    @classmethod
    def name(cls):
        return "gff"

    def schema(self):
        return FEATURES


class FastaSource(_Source):
    @classmethod
    def name(cls):
        return "fasta"

    def schema(self):
        return RECORDS


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GffSource, FastaSource):
        spark.dataSource.register(source)
