"""Data source ``named_files``: lines written into files of given names.

    named(rows).write.format("named_files").mode("overwrite").save("/out/clusters")

Rows are (file, value), where file is a path below the folder; ``named`` deals them so that a file's rows are in one task, in order. A task writes
under names of its own, and the driver gives them theirs when all tasks have ended well, so that no file comes from a task that failed. Names that end
with .gz are compressed. Overwriting also removes files that the folder had before and this write has not; appending only replaces files of the same
names.
"""

from __future__ import annotations

import gzip
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from genoloom.sources.genome_files import _system

SCHEMA = "file string, value string"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.own = options["path"].rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, at = _system(self.path)
        done, name, out, raw = [], (), None, None  # no file has this name
        system.create_dir(f"{at}/{self.own}", recursive=True)

        def close():
            nonlocal out
            if out is not None:
                out.close()
                raw.close()
                out = None

        try:
            for b in iterator:
                for file, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if file != name:
                        close()
                        if not file or file.startswith("/") or ".." in file.split("/") or any(file == f for f, _ in done[-1000:]):
                            raise ValueError(f"not a file's name, or its rows are not together: {file}")
                        part = f"{self.own}/{uuid.uuid4().hex}"
                        raw = system.open_output_stream(f"{at}/{part}")
                        out = gzip.GzipFile(fileobj=raw, mode="wb", filename="", mtime=0) if file.endswith(".gz") else raw
                        done.append((file, part))
                        name = file
                    out.write((value + "\n").encode())
        finally:
            close()
        return Written(done)

    def commit(self, messages) -> None:
        from pyarrow import fs

        system, at = _system(self.path)
        files = [f for m in messages if m for f in m.files]
        if len({f for f, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("rows of one file in several tasks: use named()")
        for folder in {f.rpartition("/")[0] for f, _ in files}:
            system.create_dir(f"{at}/{folder}".rstrip("/"), recursive=True)
        for file, part in files:
            if system.get_file_info(f"{at}/{file}").type == fs.FileType.Directory:
                system.delete_dir(f"{at}/{file}")
            system.move(f"{at}/{part}", f"{at}/{file}")
        self._clear(system, at)
        if self.overwrite:
            new = {f"{at}/{f}" for f, _ in files}
            for i in system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True)):
                if i.type == fs.FileType.File and i.path not in new:
                    system.delete_file(i.path)

    def abort(self, messages) -> None:
        self._clear(*_system(self.path))

    def _clear(self, system, at) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{at}/{self.own}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.own}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return "named_files"

    def schema(self):
        return SCHEMA

    def writer(self, schema, overwrite):
        return NamedWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def named(rows: DataFrame, *order: str) -> DataFrame:
    """(file, value) of ``rows``, a file's rows together and in ``order``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "file").sortWithinPartitions("file", *order).select("file", "value")


def write(rows: DataFrame, path: str, *order: str, mode: str = "append") -> None:
    register(rows.sparkSession)
    named(rows, *order).write.format("named_files").mode(mode).save(path)
