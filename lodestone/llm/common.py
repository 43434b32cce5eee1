"""Staging in the shared folder, and helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: While staged tables are written: shuffle files go when each job ends, and nothing that grows with the input is
#: broadcast because it happens to be small today.
STAGING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}
_own: list[str] = []
_lock = threading.RLock()
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session (as in tests) that leaves it unset, a temporary folder of this process is used; executors
    elsewhere would not see it.
    """
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _own[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def staging(spark: SparkSession):
    """The session's settings while a staged table is written, by one thread at a time."""
    _lock.acquire()
    before = {k: spark.conf.get(k, None) for k in STAGING}
    for k, v in STAGING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        _lock.release()


def stage(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None, level: int = 3) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and return the table read back.

    This cuts the lineage: a lost executor costs the tasks that ran on it, not the stages before.
    """
    path = fresh_path(spark, name)
    with staging(spark):
        writer = df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level))
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_staged(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        path = t if isinstance(t, str) else t._lodestone_path
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(jpath, True)
        with contextlib.suppress(ValueError):
            _staged.remove(path)


def staged() -> list[str]:
    """Paths of the tables that this process has staged and not deleted."""
    return list(_staged)


def crc_mod4(col: str):
    """crc32 of an id written as text, modulo 4 (NULL id: as the empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4


def in_bytes(texts, limit: int):
    """Yield ``(first, items)`` for runs of consecutive items of about ``limit`` bytes in sum, one item at least."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


def trim() -> None:
    """Give freed memory of this process back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc here
        ctypes.CDLL(None).malloc_trim(0)


def lean(f):
    """``f`` for ``mapInArrow`` whose worker keeps no freed memory between tasks: workers live on and are shared."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def utf8(column) -> list[bytes]:
    """The values of an Arrow string column as UTF-8 bytes; NULL is the empty text."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
