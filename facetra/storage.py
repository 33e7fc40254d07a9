"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class _Own(threading.local):
    """Folders of this thread's stored tables, oldest first: runs side by side do not see each other's."""

    def __init__(self):
        self.written: list[str] = []


_OWN = _Own()
_DERIVED: dict[tuple[str, str, str], tuple[tuple, str, StructType]] = {}
#: One lock for each derived table, so that two threads do not build it twice.
_LOCKS: dict[tuple[str, str, str], threading.RLock] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset a local master gets a folder of our own; elsewhere the
    executors could not read what the driver names, which is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.gettempdir()}/facetra-checkpoints-{os.getuid()}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder for files of the caller's, which ``clean`` removes like a stored table's."""
    path = f"{shared_dir(spark)}/facetra-{name}-{uuid.uuid4().hex}"
    _OWN.written.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A point in time of this thread for ``clean``."""
    return len(_OWN.written)


def clean(since: int, *keep: DataFrame) -> None:
    """Remove what this thread stored since ``mark``, but for the tables that ``keep`` reads. Folders of a file system that
    pyarrow does not know stay."""
    used = [f for df in keep for f in df.inputFiles()]
    bare = lambda p: re.sub(r"^file:/+", "/", p)
    for path in _OWN.written[since:]:
        if not any(bare(f).startswith(bare(path) + "/") for f in used):
            _OWN.written.remove(path)
            _remove(path)


def _remove(path: str) -> None:
    import pyarrow as pa
    from pyarrow import fs

    try:
        store, at = fs.FileSystem.from_uri(path)
        store.delete_dir(at)
    except (pa.ArrowInvalid, OSError):
        pass  # not there, or not ours to remove


def fingerprint(spark: SparkSession, source: str) -> tuple:
    """Name, bytes, files and time of change of every table in a folder: another where a table was replaced or added to."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(source)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return ()
    found = []
    for status in store.listStatus(path):
        size = store.getContentSummary(status.getPath()) if status.isDirectory() else None
        held = (size.getLength(), size.getFileCount()) if size else (status.getLen(), 1)
        found.append((status.getPath().getName(), *held, status.getModificationTime()))
    return tuple(sorted(found))


def derived(spark: SparkSession, name: str, source: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` that is derived from the tables at ``source``: written on first use and read from then on in this
    application, until the source's fingerprint changes. The folder of a table that is out of date stays until the process
    ends, as others may still read it."""
    key = (spark.sparkContext.applicationId, name, source)
    with _LOCK:
        lock = _LOCKS.setdefault(key, threading.RLock())
    with lock:
        now = fingerprint(spark, source)
        if key not in _DERIVED or _DERIVED[key][0] != now:
            df = build()
            path = f"{shared_dir(spark)}/facetra-{name}-{uuid.uuid4().hex}"
            atexit.register(_remove, path)
            df.write.parquet(path)
            _DERIVED[key] = (now, path, df.schema)
        _, path, schema = _DERIVED[key]
    return spark.read.schema(schema).parquet(path)


def refresh(source: str) -> None:
    """Forget what was derived from the tables at ``source``."""
    for key in [k for k in _DERIVED if k[2] == source]:
        _DERIVED.pop(key, None)
