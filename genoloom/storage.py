"""Cutting lineage between rounds, in the folder that ``spark.checkpoint.dir`` names, and versions of saved tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """A folder of our own only where the session has none and all its executors are this machine's."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="genoloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _files(spark: SparkSession, at: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _remove(spark: SparkSession, at: str) -> None:
    try:
        system, path = _files(spark, at)
        system.delete(path, True)
    except Exception:  # noqa: BLE001 - the session has ended; nothing is left to do
        pass


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` as a table that all executors share. Unlike a checkpoint it has the size of its files as statistics, where
    estimates multiplied from round to round would grow without end. Such tables, and what functions make of them, grow with the input, and
    their estimates say little of that, so joins with them merge and never go through the driver."""
    spark = df.sparkSession
    at = f"{shared_root(spark)}/genoloom/rounds-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, at)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at).hint("merge")
    out._genoloom_at = at
    return out


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``checkpoint`` gave and no later round reads."""
    for t in tables:
        if at := getattr(t, "_genoloom_at", None):
            _remove(t.sparkSession, at)


class Conflict(RuntimeError):
    """Another writer has published since this one looked."""


_END = "\nend of note\n"


def _notes(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """(the greatest number that is taken, the whole notes by number)."""
    system, at = _files(spark, f"{path}/notes")
    if not system.exists(at):
        return 0, {}
    every = {int(s.getPath().getName()): s for s in system.listStatus(at) if str(s.getPath().getName()).isdigit() and s.isFile()}
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    texts = {}
    for n, status in every.items():
        stream = system.open(status.getPath())
        texts[n] = str(read.toString(stream, "UTF-8"))
        stream.close()
    return max(every, default=0), {n: t.removesuffix(_END) for n, t in texts.items() if t.endswith(_END)}


def current(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(number, version) of what was published last; (0, None) where there is nothing."""
    whole = _notes(spark, path)[1]
    return max(whole.items(), default=(0, None))


def latest(spark: SparkSession, path: str) -> str | None:
    """The version that was published last; None where there is none."""
    return current(spark, path)[1]


def publish(spark: SparkSession, path: str, version: str, after: int | None = None) -> int:
    """Make ``version`` the latest of ``path``, by a note under the next number, which only one writer can create. With ``after``, the number of
    the version that this one grew from, anything published since then is a ``Conflict``; without, the next free number is taken. A writer that ends half
    way leaves a note that readers pass over."""
    while True:
        taken, whole = _notes(spark, path)
        if after is not None and max(whole, default=0) != after:
            raise Conflict(f"{path}: version {max(whole)} was published after version {after}, which this one grew from")
        system, at = _files(spark, f"{path}/notes/{taken + 1:012d}")
        try:
            out = system.create(at, False)
        except Py4JJavaError as e:
            if not system.exists(at):
                raise
            if after is not None:
                raise Conflict(f"{path}: another writer publishes version {taken + 1}") from e
            continue
        out.write(bytearray((version + _END).encode()))
        out.close()
        return taken + 1


def clean(spark: SparkSession, path: str, needed: Callable[[str], set[str]], keep: int = 1) -> None:
    """Remove all but the last ``keep`` notes, and the folders of ``path`` that none of these needs. To be called while nobody writes."""
    whole = _notes(spark, path)[1]
    held = sorted(whole)[-keep:]
    names = {"notes"}.union(*(needed(whole[n]) for n in held))
    system, at = _files(spark, path)
    for s in system.listStatus(at) if system.exists(at) else []:
        if s.isDirectory() and str(s.getPath().getName()) not in names:
            system.delete(s.getPath(), True)
    for n in whole:
        if n not in held:
            system.delete(_files(spark, f"{path}/notes/{n:012d}")[1], False)
