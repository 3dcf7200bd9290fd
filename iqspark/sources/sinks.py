"""Committed file sink: one file for each stream, sweep or list, in order, written in ranges by many tasks."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import stored

#: Places of pieces in a range, which a task holds the sizes of.
RANGE = 65_536
PIECES = "name string, at long, size long, value binary"


def local_path(path: str) -> str:
    """The path of a folder that driver and executors share as files (such as one on a network file system)."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: single files are written at their offsets, which needs a shared file system; use Parquet elsewhere")
    return unquote(url.path) if url.scheme else path


class PlacedFiles(DataSource):
    """Data source "placed_files": rows PIECES, each value at byte at of the file name, which has size bytes in all.

    Tasks write to one folder of the job, so a repeated or speculative task writes the same bytes to the same place. The
    driver checks that each file's bytes are all there and renames it to its name; a job that fails leaves nothing."""

    @classmethod
    def name(cls) -> str:
        return "placed_files"

    def schema(self) -> str:
        return PIECES

    def writer(self, schema: StructType, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options["path"])


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task has written to each file, and the file's size."""

    files: dict[str, tuple[int, int]]


class PlacedWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = local_path(path)
        self.job = os.path.join(self.path, f".job-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done: dict[str, tuple[int, int]] = {}
        name, file = None, None
        try:
            for batch in iterator:
                for to, at, size, value in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "size", "value")), strict=True):
                    if to != name:
                        if file:
                            file.close()
                        target = os.path.normpath(os.path.join(self.job, to))
                        if not target.startswith(self.job + os.sep):
                            raise ValueError(f"{to} is no name of a file below the folder")
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        name, file = to, os.fdopen(os.open(target, os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                    if file.tell() != at:
                        file.seek(at)
                    file.write(value)
                    done[to] = (done.get(to, (0, 0))[0] + len(value), size)
        finally:
            if file:
                file.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        total: dict[str, list[int]] = {}
        for message in messages:
            for name, (n, size) in (message.files if message else {}).items():
                total.setdefault(name, [0, size])[0] += n
        wrong = [name for name, (n, size) in total.items() if n != size or os.path.getsize(os.path.join(self.job, name)) != size]
        if wrong:
            self._clear()
            raise OSError(f"incomplete files: {wrong[:5]}")
        for name in total:
            os.makedirs(os.path.dirname(os.path.join(self.path, name)), exist_ok=True)
            os.replace(os.path.join(self.job, name), os.path.join(self.path, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        import shutil

        shutil.rmtree(self.job, ignore_errors=True)


def write_files(pieces: DataFrame, path: str) -> None:
    """pieces(name, place, value): the file path/name is its values in order of place (unique within a name), joined
    without anything between. Files of these names are replaced whole, others stay.

    Pieces are computed once, to the shared folder, as numbers may differ in their last digits, and so in their length, when
    they are computed again. Sizes are summed up by ranges of place, a running sum over one row for each range says where
    the range begins, and ranges are written side by side; so a file of any size is written by many tasks, and many small
    files by one.
    """
    pieces.sparkSession.dataSource.register(PlacedFiles)
    cut = stored(pieces.select("name", F.col("place").cast("long").alias("place"), F.col("value").cast("binary").alias("value")), "pieces").withColumn("b", F.floor(F.col("place") / RANGE))
    size = F.octet_length("value").cast("long")
    ranges = cut.groupBy("name", "b").agg(F.sum(size).alias("n"))
    order = Window.partitionBy("name").orderBy("b")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("name", "b", before.alias("base"), F.sum("n").over(Window.partitionBy("name")).alias("size"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("name", "b").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut.withColumn("inside", inside).join(ranges, ["name", "b"])
    placed.select("name", (F.col("base") + F.col("inside")).alias("at"), "size", "value").write.format("placed_files").mode("append").save(path)


def headed(lines: DataFrame, heads: DataFrame, suffix: str, end: str = "\n") -> DataFrame:
    """Pieces of text files from lines(name, place >= 0, value), each with its end, and heads(name, value): what stands
    before a name's lines. Files are called name and suffix."""
    called, value = F.concat("name", F.lit(suffix)).alias("name"), F.concat("value", F.lit(end)).alias("value")
    return lines.select(called, "place", value).unionByName(heads.select(called, F.lit(-1).cast("long").alias("place"), value))
