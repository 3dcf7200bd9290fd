"""Packed recordings: records of 2 n + 10 little-endian 32-bit words, without header."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schemas import FLAGS, FRAMES, SIDECAR
from .sinks import write_files

#: Tones and bytes of a full frame: fixed values of the format.
FULL_TONES, TRAILER = 2048, FLAGS + 2


def record_bytes(num_tones: int) -> int:
    return 4 * (2 * num_tones + TRAILER)


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row for each sidecar file."""
    return spark.read.schema(SIDECAR).json(path, multiLine=True).withColumn("stream_id", stream_name(F.input_file_name()))


def write_sidecar(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def sidecar_json(num_tones: int, sample_rate: float, date: str, info: dict | None = None) -> str:
    """Text of the sidecar of a recording: where each trailer word is."""
    at = 2 * num_tones
    return json.dumps({"date": date, "num_tones": num_tones, "sample_rate": sample_rate, "format": "<i4", "index_err": at + FLAGS + 1, "index_cnt": at + FLAGS, **{f"index_flag_{k}": at + k for k in range(FLAGS)}, "ordering": "i0,q0,i1,q1", "system_information": info or {}})


def stream_name(path):
    """File name without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def _list_array(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


@dataclass(frozen=True)
class Layout:
    """Where the words of a record are, and their form: that of a sidecar, or the standard one."""

    num_tones: int
    counter: int
    error: int
    flags: tuple[int, ...]
    width: int
    word: str = "<i4"
    planar: bool = False

    @classmethod
    def standard(cls, num_tones: int) -> Layout:
        at = 2 * num_tones
        return cls(num_tones, at + FLAGS, at + FLAGS + 1, tuple(range(at, at + FLAGS)), at + TRAILER)

    @classmethod
    def of_sidecar(cls, text: str) -> Layout:
        """Places that a sidecar leaves out are the standard ones. planar: its ordering names a second I before a Q."""
        said = json.loads(text)
        plain = cls.standard(int(said["num_tones"]))
        place = lambda key, default: int(default if said.get(key) is None else said[key])
        counter, error = place("index_cnt", plain.counter), place("index_err", plain.error)
        flags = tuple(place(f"index_flag_{k}", plain.flags[k]) for k in range(FLAGS))
        first = re.findall(r"[iq](?=_?(?:tone)?_?\d)", str(said.get("ordering") or "").lower())[:2]
        return cls(plain.num_tones, counter, error, flags, max(plain.width, counter + 1, error + 1, max(flags) + 1), str(said.get("format") or "<i4"), first == ["i", "i"])

    @property
    def record_bytes(self) -> int:
        return self.width * np.dtype(self.word).itemsize

    def unpack(self, payload: bytes, keep: int | None = None) -> dict[str, pa.Array]:
        """Columns of whole records; a short last record is left out. Counters are taken modulo 2**32."""
        whole = len(payload) // self.record_bytes
        words = np.frombuffer(payload, self.word, whole * self.width).reshape(whole, self.width)
        # Tones fill the words that are no trailer, in turn.
        n = self.num_tones if keep is None else min(keep, self.num_tones)
        trailer = {self.counter, self.error, *self.flags}
        tones = np.array([k for k in range(self.width) if k not in trailer][: 2 * self.num_tones], np.int64)
        i, q = (tones[: self.num_tones], tones[self.num_tones :]) if self.planar else (tones[::2], tones[1::2])
        at = lambda places: words[:, places].astype(np.int32)
        return {"packet_counter": pa.array(words[:, self.counter].astype(np.int64) % 2**32), "packet_error": pa.array(at(self.error)), "flags": _list_array(at(list(self.flags))), "i": _list_array(at(i[:n])), "q": _list_array(at(q[:n]))}


def unpack(payload: bytes, num_tones: int, keep: int | None = None) -> dict[str, pa.Array]:
    """Columns of whole records of the standard layout."""
    return Layout.standard(num_tones).unpack(payload, keep)


class RecordingSource(DataSource):
    """Spark data source "recording": flat files, folders of them, or several joined by commas, read in ranges of whole
    records; each file by the layout of the sidecar beside it (its name, without .bin, and .json), or else the standard one
    for num_tones. As a stream: a folder in which chunk files land or grow, in a folder for each stream."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return FRAMES + (", chunk string" if self.options.get("chunks") == "true" else "")

    def reader(self, schema: StructType) -> RecordingReader:
        return RecordingReader(self.options)

    def streamReader(self, schema: StructType) -> RecordingStream:
        return RecordingStream(self.options)


class Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, layout: Layout | None):
        self.path, self.first, self.count, self.layout = path, first, count, layout


def open_store(path: str):
    """(filesystem, path) of any store that pyarrow opens by URI, or of a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files:
    """Recording files, their layouts and ranges. Options: path, num_tones, keep, records (of a range)."""

    def __init__(self, options: dict[str, str]):
        self.paths = [p for p in options["path"].split(",") if p]
        self.standard = Layout.standard(int(options["num_tones"])) if "num_tones" in options else None
        self.keep = int(options["keep"]) if "keep" in options else None
        self.records = int(options.get("records", 16384))
        self.chunks = options.get("chunks") == "true"

    def listed(self) -> list[tuple[str, int, Layout | None]]:
        """(path, bytes, layout) of each file, in order of their names; None: an empty file without a layout."""
        from concurrent.futures import ThreadPoolExecutor

        from pyarrow import fs

        found: list[tuple[str, int]] = []
        sidecars: set[str] = set()
        for path in self.paths:
            store, name = open_store(path)
            info = store.get_file_info(name)
            inside = [info]
            if info.type == fs.FileType.Directory:
                inside = store.get_file_info(fs.FileSelector(name, recursive=True))
            elif info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            else:
                inside += [x for x in store.get_file_info(_sidecars(name)) if x.type == fs.FileType.File]
            root = path[: len(path) - len(name)] if path.endswith(name) else ""
            for x in inside:
                if x.type == fs.FileType.File and not x.base_name.startswith((".", "_")):
                    if x.base_name.endswith(".json"):
                        sidecars.add(root + x.path)
                    elif not x.base_name.endswith((".tmp", ".crc")):
                        found.append((root + x.path, x.size))
        with ThreadPoolExecutor(16) as many:
            return sorted(many.map(lambda x: (*x, self._layout(x[0], x[1], sidecars)), found))

    def _layout(self, path: str, size: int, sidecars: set[str]) -> Layout | None:
        for beside in _sidecars(path):
            if beside in sidecars:
                store, name = open_store(beside)
                with store.open_input_stream(name) as f:
                    return Layout.of_sidecar(f.read().decode())
        if self.standard is None and size:
            raise ValueError(f"{path} has no sidecar; num_tones must be given")
        return self.standard

    def ranges(self, path: str, first: int, end: int, layout: Layout | None) -> list[Range]:
        return [Range(path, a, min(self.records, end - a), layout) for a in range(first, end, self.records)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        layout, at = partition.layout, 0
        size = layout.record_bytes
        store, name = open_store(partition.path)
        file = name.rpartition("/")[2]
        stream = name.rpartition("/")[0].rpartition("/")[2] if self.chunks else file.removesuffix(".bin").rpartition(".")[0] or file.removesuffix(".bin")
        with store.open_input_file(name) as f:
            while at < partition.count:
                n = min(1024, partition.count - at)
                got = layout.unpack(f.read_at(n * size, (partition.first + at) * size), self.keep)
                seq = np.arange(partition.first + at, partition.first + at + n)
                columns, names = [pa.array([stream] * n), pa.array(seq), *got.values()], ["stream_id", "seq", *got]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([file] * n)] * self.chunks, names + ["chunk"] * self.chunks)
                at += n


def _sidecars(path: str) -> list[str]:
    return [f"{path.removesuffix('.bin')}.json", f"{path}.json"]


class RecordingReader(Files, DataSourceReader):
    def partitions(self) -> list[Range]:
        out = [r for path, size, layout in self.listed() if layout for r in self.ranges(path, 0, size // layout.record_bytes, layout)]
        return out or [Range("", 0, 0, None)]


class RecordingStream(Files, DataSourceStreamReader):
    """Records that are new in a folder of stream folders. An offset has, for each stream, the whole records of its newest
    files (lookback of them, by name) and the name up to which all files were read before; so it stays small however long
    the recording. A file of any size is read in ranges, within a batch of at most per_trigger records once the stream
    runs; a short last record waits until the rest of it is there. Empty files are keep-alives and give nothing."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options | {"chunks": "true"})
        self.lookback, self.per_trigger = int(options.get("lookback", 1000)), int(options.get("per_trigger", 1 << 22))
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def _here(self) -> dict[str, dict[str, tuple[str, int, Layout | None]]]:
        out: dict[str, dict] = {}
        for path, size, layout in self.listed():
            folder, _, name = path.rpartition("/")
            out.setdefault(folder.rpartition("/")[2], {})[name] = (path, size // layout.record_bytes if layout else 0, layout)
        return out

    def latestOffset(self) -> dict:
        end: dict = {}
        left = self.per_trigger if self.at is not None else None
        for stream, files in self._here().items():
            names = sorted(files)
            old = names[: -self.lookback]
            start = (self.at or {}).get(stream, {"all": "", "files": {}})
            limit = {"all": old[-1] if old else "", "files": {n: files[n][1] for n in names[-self.lookback :]}}
            if left is not None and limit["all"] == start["all"]:
                for name, records in limit["files"].items():
                    had = min(start["files"].get(name, 0), records)
                    more = min(records - had, left)
                    limit["files"][name], left = had + more, left - more
            end[stream] = limit
        for stream, was in (self.at or {}).items():
            end.setdefault(stream, was)
        return end

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out, here = [], self._here()
        for stream, to in end.items():
            had = start.get(stream, {"all": "", "files": {}})
            files = here.get(stream, {})
            between = {n: files[n][1] for n in files if had["all"] < n <= to["all"]}  # older than the lookback by now
            for name, records in sorted((between | to["files"]).items()):
                first = had["files"].get(name, 0 if name > had["all"] else records)
                if records > first:
                    path, _, layout = files[name]
                    out += self.ranges(path, first, records, layout)
        self.at = end
        return out or [Range("", 0, 0, None)]


def read_recording(spark: SparkSession, path: str, num_tones: int | None = None, keep: int | None = None, records: int = 16384) -> DataFrame:
    """Frames of recording files, or of a folder of them: seq is the record's place in its file, a short last record is left
    out, an empty file has no frames. Files with a sidecar beside them are read by it, each by its own; num_tones is for
    those without one. num_tones=2048 with keep decodes full frames and keeps their first tones."""
    spark.dataSource.register(RecordingSource)
    reader = spark.read.format("recording").option("records", records)
    for name, value in (("num_tones", num_tones), ("keep", keep)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(path)


def stream_recording(spark: SparkSession, folder: str, num_tones: int | None = None, keep: int | None = None, records: int = 16384, per_trigger: int = 1 << 22) -> DataFrame:
    """Frames and chunk of the files that land in folder/<stream>/ as a stream (RecordingStream); seq is the record's place
    in its chunk."""
    spark.dataSource.register(RecordingSource)
    reader = spark.readStream.format("recording").option("chunks", "true").option("records", records).option("per_trigger", per_trigger)
    for name, value in (("num_tones", num_tones), ("keep", keep)):
        reader = reader if value is None else reader.option(name, value)
    return reader.load(folder)


def decode(raw: DataFrame, num_tones: int, keep: int | None = None) -> DataFrame:
    """Frames of raw(stream_id, seq, payload), one or more whole records a payload; seq is that of its first record."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = record_bytes(num_tones)
        for b in batches:
            payloads = [p[: len(p) // size * size] for p in b.column("payload").to_pylist()]
            each = np.array([len(p) // size for p in payloads], np.int64)
            got = unpack(b"".join(payloads), num_tones, keep)
            first = b.column("seq").to_numpy(zero_copy_only=False)
            seq = np.repeat(first, each) + np.concatenate([np.arange(n) for n in each] or [np.zeros(0, np.int64)]).astype(np.int64)
            ids = b.column("stream_id").take(pa.array(np.repeat(np.arange(len(each)), each)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(seq, pa.int64()), *got.values()], ["stream_id", "seq", *got])

    return raw.where(F.length("payload") > 0).select("stream_id", "seq", "payload").mapInArrow(decoded, FRAMES)


def encode(frames: DataFrame, num_tones: int | None = None) -> DataFrame:
    """(stream_id, seq, payload): each frame as one packed record of its (first num_tones) tones."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = [b""] * b.num_rows
            width = pa.compute.list_value_length(b.column("i")).to_numpy(zero_copy_only=False)
            for tones in np.unique(width):  # one block of words for all frames of a width
                rows = np.flatnonzero(width == tones)
                i, q, flags = (b.column(c).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for c in ("i", "q", "flags"))
                n = int(tones) if num_tones is None else num_tones
                words = np.empty((len(rows), 2 * n + TRAILER), np.int64)
                words[:, 0 : 2 * n : 2], words[:, 1 : 2 * n : 2], words[:, 2 * n : 2 * n + FLAGS] = i[:, :n], q[:, :n], flags
                for k, c in ((-2, "packet_counter"), (-1, "packet_error")):
                    words[:, k] = b.column(c).to_numpy(zero_copy_only=False)[rows]
                packed, size = words.astype(np.uint32).tobytes(), 4 * words.shape[1]
                for at, row in enumerate(rows.tolist()):
                    out[row] = packed[at * size : (at + 1) * size]
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("seq"), pa.array(out, pa.binary())], ["stream_id", "seq", "payload"])

    return frames.mapInArrow(encoded, "stream_id string, seq long, payload binary")


def write_recording(frames: DataFrame, path: str, num_tones: int | None = None) -> None:
    """Packed records under path as Parquet of payloads, by stream, in ranges of ascending seq: the form for clusters."""
    ranged = encode(frames, num_tones).repartitionByRange("stream_id", "seq").sortWithinPartitions("stream_id", "seq")
    ranged.write.mode("overwrite").partitionBy("stream_id").parquet(path)


def write_flat(frames: DataFrame, path: str, num_tones: int | None = None, prefix: str = "chunk", frames_per_chunk: int = 65_536) -> None:
    """Flat chunk files of packed records, path/<stream_id>/<prefix>-<number>.bin, by ranges of seq: their concatenation by
    name is the recording. Files are committed whole (sinks.write_files)."""
    number = F.lpad(F.floor(F.col("seq") / frames_per_chunk).cast("string"), 12, "0")
    name = F.concat_ws("/", "stream_id", F.concat(F.lit(f"{prefix}-"), number, F.lit(".bin")))
    write_files(encode(frames, num_tones).select(name.alias("name"), F.col("seq").alias("place"), F.col("payload").alias("value")), path)


def write_recording_files(frames: DataFrame, path: str, meta: dict | None = None) -> None:
    """Flat files path/<stream_id>.bin of whole recordings, each with its sidecar path/<stream_id>.json, as
    read_recording(spark, path) reads them. meta: more members of the sidecar, constants or columns."""
    write_files(encode(frames).select(F.concat("stream_id", F.lit(".bin")).alias("name"), F.col("seq").alias("place"), F.col("payload").alias("value")), path)
    at = F.col("n") * 2
    said = {"num_tones": F.col("n"), "format": F.lit("<i4"), "index_err": at + FLAGS + 1, "index_cnt": at + FLAGS, **{f"index_flag_{k}": at + k for k in range(FLAGS)}, "ordering": F.lit("i0,q0,i1,q1")}
    more = {k: v if isinstance(v, Column) else F.lit(v) for k, v in (meta or {}).items()}
    streams = frames.groupBy("stream_id").agg(F.max(F.size("i")).alias("n"), *[F.max(v).alias(f"_{k}") for k, v in more.items()])
    text = F.to_json(F.struct(*[v.alias(k) for k, v in said.items()], *[F.col(f"_{k}").alias(k) for k in more]))
    write_files(streams.select(F.concat("stream_id", F.lit(".json")).alias("name"), F.lit(0).cast("long").alias("place"), text.alias("value")), path)


def read_packed(spark: SparkSession, path: str, num_tones: int, keep: int | None = None) -> DataFrame:
    """Frames of what write_recording has written."""
    schema = StructType.fromDDL("seq long, payload binary, stream_id string")
    return decode(spark.read.schema(schema).parquet(path), num_tones, keep)


def store(df: DataFrame, path: str, frames_per_part: int = 1_800_000) -> None:
    """Parquet by stream and range of seq (an hour at 500 Hz), which replaces array and dictionary files."""
    df.withColumn("part", F.floor(F.col("seq") / frames_per_part)).write.mode("overwrite").partitionBy("stream_id", "part").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")
