"""A data source of feeds: one XML file per feed in a folder, written in one commit and read back as entries.

    register(spark)
    feed_rows(entries).write.format("feed_files").mode("overwrite").save(path)
    spark.read.format("feed_files").load(path).where("kind = 'series'")

Tasks write to a staging folder of the job and report their files in commit messages; the commit moves the files of winning
attempts to their places and removes those of feeds that are gone (mode overwrite), the abort removes the staging folder, so
that a failed job leaves every feed as it was. Files move one by one: a reader sees each feed old or new, never half. Reading
cuts the folder into partitions of files; filters on kind are answered from file names, so other files are not opened.
"""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from facetra.functions.text import safe_name

ENTRIES = "kind string, feed_id string, rank int, id string, date string, entry string"
#: Files read by one task, bytes of a name, and the shape of a file's head.
FILES_A_TASK = 64
NAME_BYTES = 60
#: Age at which what a failed job left is removed.
STALE_HOURS = 24


def file_name(feed: Column, kind: Column) -> Column:
    """A file's name: the kind, the feed's name made safe and cut, and a digest, which tells feeds apart whose names are alike.
    A kind is letters, digits and hyphens."""
    return F.concat(kind, F.lit("_"), F.substring(safe_name(feed), 1, NAME_BYTES // 4), F.lit("_"), F.left(F.sha2(feed, 256), F.lit(16)), F.lit(".xml"))


def feed_rows(entries: DataFrame) -> DataFrame:
    """file, kind, feed_id and entries (a list, which is short) of each feed, ready to be written."""
    entry = F.struct("rank", F.col("id").cast("string").alias("id"), "date", "entry")
    rows = entries.groupBy("kind", "feed_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return rows.select(file_name(F.col("feed_id"), F.col("kind")).alias("file"), "kind", "feed_id", "entries")


def document(kind: str, feed_id: str, entries: list[dict]) -> str:
    """A feed as XML, with entries in order."""
    quoted = lambda x: escape(x, {'"': "&quot;", "\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})
    out = [f'<?xml version="1.0" encoding="utf-8"?>\n<feed id="{quoted(feed_id)}" kind="{quoted(kind)}">\n']
    for e in entries:
        date = "" if e["date"] is None else f"<updated>{escape(e['date'])}</updated>"
        out.append(f"<entry><id>{escape(e['id'])}</id><title>{escape(e['entry'])}</title>{date}</entry>\n")
    return "".join([*out, "</feed>\n"])


def parsed(data: bytes) -> Iterator[tuple]:
    """Rows of ENTRIES of a file."""
    feed = ElementTree.fromstring(data)
    for rank, e in enumerate(feed.iter("entry"), 1):
        yield feed.get("kind"), feed.get("id"), rank, e.findtext("id"), e.findtext("updated"), e.findtext("title")


@dataclass
class Written(WriterCommitMessage):
    """Staged files of one task: (staged path, name)."""

    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        folder = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        files = []
        for batch in iterator:
            for row in batch.to_pylist():
                with store.open_output_stream(f"{at}/{row['file']}") as out:
                    out.write(document(row["kind"], row["feed_id"], row["entries"]).encode())
                files.append((f"{folder}/{row['file']}", row["file"]))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.path)
        staged = [f for m in messages if m for f in m.files]
        names = [name for _, name in staged]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows of one feed")
        for path, name in staged:
            target = f"{at}/{name}"
            store.move(fs.FileSystem.from_uri(path)[1], target)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(at)):
                if info.type == fs.FileType.File and info.base_name.endswith(".xml") and info.base_name not in set(names):
                    store.delete_file(info.path)
        for info in store.get_file_info(fs.FileSelector(at)):
            if info.base_name.startswith("_staging-") and info.mtime and time.time() - info.mtime.timestamp() > STALE_HOURS * 3600:
                store.delete_dir(info.path)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, at = fs.FileSystem.from_uri(self.staging)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


@dataclass
class Files(InputPartition):
    paths: list[str]


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.kinds = path.rstrip("/"), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("kind",):
                self._only([f.value])
            elif isinstance(f, In) and f.attribute == ("kind",):
                self._only(list(f.value))
            else:
                yield f  # for Spark to apply

    def _only(self, kinds: list) -> None:
        self.kinds = set(kinds) if self.kinds is None else self.kinds & set(kinds)

    def partitions(self) -> list[Files]:
        store, at = fs.FileSystem.from_uri(self.path)
        found = sorted(i.path for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.base_name.endswith(".xml"))
        chosen = [p for p in found if self.kinds is None or p.rsplit("/", 1)[1].split("_", 1)[0] in self.kinds]
        return [Files(chosen[i : i + FILES_A_TASK]) for i in range(0, len(chosen), FILES_A_TASK)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                yield from parsed(f.read())


class FeedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_files"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session. Its classes travel by value, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(FeedFiles)
