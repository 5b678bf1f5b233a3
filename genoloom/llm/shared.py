"""Places that the driver and all executors see, and numbers of rows that hold from job to job.

Everything that must outlive a task goes under ``spark.checkpoint.dir``. A folder of our own is set only where a
session has none and all its executors are this machine's (tests).
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import re
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

RID = "_rid_of_genoloom"
#: Of a table in more files, the rows are numbered by writing them. 16 bytes a file are broadcast.
FILES = 4_000_000
_here = threading.local()


def _scopes() -> list[dict[str, SparkSession]]:
    """The open scopes of this thread: folders and their sessions."""
    if not hasattr(_here, "scopes"):
        _here.scopes = []
    return _here.scopes


def root(spark: SparkSession) -> str:
    """The shared folder, as a URI."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="genoloom-")
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at or at.startswith("file:") else "file://" + os.path.abspath(at)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI; it is removed with the innermost ``scope``, else when the driver ends."""
    at = f"{root(spark).rstrip('/')}/genoloom/{name}-{uuid.uuid4().hex}"
    if _scopes():
        _scopes()[-1][at] = spark
    else:
        atexit.register(_remove, spark, at)
    return at


def remove(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        remove(spark, at)
    except Exception:  # noqa: BLE001 - the session has ended; nothing is left to do
        pass


@contextlib.contextmanager
def scope():
    """Folders that this thread makes inside are removed at the end, but those of tables that were given to ``kept``."""
    own: dict[str, SparkSession] = {}
    _scopes().append(own)
    try:
        yield
    finally:
        _scopes().remove(own)
        for at, spark in own.items():
            _remove(spark, at)


def kept(df: DataFrame) -> DataFrame:
    """A table that ``written`` gave, which outlives the innermost scope."""
    at, open_ = df._genoloom_at, _scopes()
    if open_ and (spark := open_[-1].pop(at, None)):
        if len(open_) > 1:
            open_[-2][at] = spark
        else:
            atexit.register(_remove, spark, at)
    return df


def drop(*tables: DataFrame) -> None:
    """Remove tables that ``written`` gave and nothing reads any more."""
    for df in tables:
        for own in _scopes():
            own.pop(df._genoloom_at, None)
        _remove(df.sparkSession, df._genoloom_at)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and a lost executor loses nothing."""
    at = folder(df.sparkSession, name)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._genoloom_at = at
    return out


def lean(spark: SparkSession, most: int = 16 << 20) -> None:
    """Batches of texts to the workers take ``most`` bytes or less, as either side holds a few at a time; a session's own limit, if
    it is less, holds."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > most or int(now.rstrip("b")) <= 0:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def trims(run):
    """For functions of batches: when a task ends, its worker, which waits for the next, gives back memory that it no longer uses."""

    @functools.wraps(run)
    def wrapped(batches, *args, **how):
        try:
            yield from run(batches, *args, **how)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def _plain(docs: DataFrame) -> bool:
    """Whether each row is one row of one file: columns and filters over a scan."""
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().head()
    return plan.children().isEmpty() and "Relation" in plan.nodeName()


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``RID``: a number of each row that every job which reads the result finds again, whatever cores
    are alive and however files are split.

    Of a table in Parquet files it is made of the file's number, by the order of paths, and of the row's place in it. Anything else is
    written once, with its numbers.
    """
    lean(docs.sparkSession)
    if RID in docs.columns:
        return docs
    spark = docs.sparkSession
    if _plain(docs):
        path, place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
        try:
            files = docs.select(path.alias("path")).distinct()
            both = docs.select("*", F.xxhash64(path).alias("_file_of_genoloom"), place.alias("_place_of_genoloom"))
        except AnalysisException:
            files = None
        if files is not None:
            found = files.select("path", F.xxhash64("path").alias("_file_of_genoloom")).limit(FILES + 1).toArrow().sort_by("path")
            names = found["_file_of_genoloom"]
            if found.num_rows <= FILES and len(names.unique()) == found.num_rows:
                if found.num_rows < 2:
                    return both.withColumn(RID, F.col("_place_of_genoloom")).drop("_file_of_genoloom", "_place_of_genoloom")
                # 16 bytes a file, and no more than FILES
                number = F.broadcast(spark.createDataFrame(pa.table({"_file_of_genoloom": names, "_number_of_genoloom": pa.array(range(found.num_rows), pa.int64())})))
                rid = F.shiftleft("_number_of_genoloom", 40).bitwiseOR(F.col("_place_of_genoloom"))
                return both.join(number, "_file_of_genoloom").withColumn(RID, rid).drop("_file_of_genoloom", "_number_of_genoloom", "_place_of_genoloom")
    return written(docs.withColumn(RID, F.monotonically_increasing_id()), "numbered")


class Listed:
    """Numbers in sorted files of the shared folder. A task that reads rows in the order of their numbers looks at the files of its
    own range only, so that rows are picked without dealing their texts out."""

    def __init__(self, numbers: DataFrame):
        parts = int(numbers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        c = numbers.columns[0]
        table = written(numbers.distinct().repartitionByRange(parts, c).sortWithinPartitions(c), "listed")
        self.at, path = table._genoloom_at, F.col("_metadata.file_name")
        # a row a file
        found = sorted(tuple(r) for r in table.groupBy(path.alias("f")).agg(F.min(c).alias("lo"), F.max(c).alias("hi")).select("lo", "hi", "f").collect())
        self.lo, self.hi = np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.int64)
        self.names, self.read = [r[2] for r in found], {}

    def has(self, rid: np.ndarray) -> np.ndarray:
        """Which of the numbers are listed."""
        import pyarrow.parquet as pq

        out = np.zeros(len(rid), bool)
        if not len(rid) or not len(self.lo):
            return out
        for k in np.flatnonzero((self.hi >= rid.min()) & (self.lo <= rid.max())).tolist():
            if k not in self.read:
                if len(self.read) > 3:
                    self.read.clear()
                system, at = filesystem(f"{self.at}/{self.names[k]}")
                with system.open_input_file(at) as f:
                    self.read[k] = pq.read_table(f).column(0).to_numpy()
            own = self.read[k]
            i = np.minimum(np.searchsorted(own, rid), len(own) - 1)
            out |= own[i] == rid
        return out


def filesystem(at: str):
    """pyarrow's file system for a URI and the path in it, for code that runs on executors."""
    from pyarrow import fs

    if at.startswith("file:"):
        return fs.LocalFileSystem(), "/" + at[5:].lstrip("/")
    return fs.FileSystem.from_uri(at)
