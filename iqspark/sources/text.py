"""Text forms: headed CSV of samples, streams and sweeps, JSON documents, calibration and tone lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import FLAGS, SWEEP, TONE_LIST
from .records import open_store, stream_name
from .sinks import headed, write_files

TRAIL = ["packet_counter", "packet_error", *[f"flag{k}" for k in range(FLAGS)]]


def sample_columns(tones: int) -> list[str]:
    return [f"{c}_data_{t:04d}" for t in range(tones) for c in "iq"] + TRAIL


def stream_columns(tones: int) -> list[str]:
    return TRAIL + [f"{c}_{t:04d}" for t in range(tones) for c in "iq"]


def sweep_columns(tones: int) -> list[str]:
    return [f"{c}_{t:04d}" for t in range(tones) for c in ("sweep_f", "sweep_i", "sweep_q", "err_i", "err_q")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def header(spark: SparkSession, path: str) -> DataFrame:
    """(key, value, number) of the # key,value lines; values stay text, and are never evaluated."""
    rows = _lines(spark, path).where(F.col("value").startswith("#")).select(F.split(F.regexp_replace("value", r"^#\s*", ""), ",", 2).alias("kv"))
    return rows.select(F.trim(F.col("kv")[0]).alias("key"), F.trim(F.get("kv", F.lit(1))).alias("value")).withColumn("number", F.expr("try_cast(value AS double)"))


def numbered_lines(spark: SparkSession, path: str, stream_id: str | None) -> DataFrame:
    """(stream_id, seq, value, file) of the data lines of text files, in the order of the files: lines but comments, empty ones and
    names (those that begin with a letter, but for NaN and infinity). Without a stream_id, each file is a stream of its name; else all files are one stream, in
    order of their names. Lines count within a split of a file; one row for each split gives the lines before it."""
    kept = ~F.col("value").startswith("#") & (F.trim("value") != "") & ~F.col("value").rlike(r"^\s*(?!(?i:nan|inf))[A-Za-z]")
    own = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at")).where(kept)
    own = own.withColumn("stream_id", stream_name(F.col("file")) if stream_id is None else F.lit(stream_id))
    keys = ["stream_id", "file", "split"]
    before = F.sum("n").over(Window.partitionBy("stream_id").orderBy("file", "split").rowsBetween(Window.unboundedPreceding, -1))
    splits = own.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("at")) - 1
    return own.withColumn("place", place).join(splits, keys).select("stream_id", (F.col("base") + F.col("place")).alias("seq"), "value", "file")


HEADERS = "file string, names array<string>, meta map<string,string>"
#: Files whose headers are broadcast at most; beyond that they are joined by a shuffle.
MOST_HEADERS = 100_000


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADERS of each text file under path: the names of its first line that is no comment, and its # key,value lines.
    Only the first lines of a file are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file in b.column("path").to_pylist():
                store, name = open_store(file)
                meta, names = {}, []
                with store.open_input_file(name) as f:
                    for line in text_lines(f):
                        if not line.strip():
                            continue
                        if not line.startswith("#"):
                            names = [x.strip() for x in line.split(",")]
                            break
                        key, _, value = line.lstrip("# ").partition(",")
                        meta[key.strip()] = value.strip()
                rows.append((file, names, meta))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([[*r[2].items()] for r in rows], pa.map_(pa.string(), pa.string()))], ["file", "names", "meta"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").mapInArrow(read, HEADERS)


def text_lines(f: pa.NativeFile, piece: int = 1 << 16) -> Iterator[str]:
    """Lines of an open file, read by pieces."""
    rest = b""
    while data := f.read(piece):
        *whole, rest = (rest + data).split(b"\n")
        for line in whole:
            yield line.decode(errors="replace").rstrip("\r")
    yield rest.decode(errors="replace").rstrip("\r")


def with_headers(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """lines(file, value) with the header of their file, and the values of the line as v."""
    few = headers.select("file").limit(MOST_HEADERS + 1).count() <= MOST_HEADERS
    return lines.join(F.broadcast(headers) if few else headers, "file").withColumn("v", F.split("value", ","))


def places(names: Column, pattern: str) -> Column:
    """(tone, at) of the names that pattern matches, whose group is the tone's number; in order of the tones."""
    each = F.transform(names, lambda x, k: F.struct(F.regexp_extract(x, pattern, 1).try_cast("int").alias("tone"), k.alias("at")))
    return F.array_sort(F.filter(each, lambda x: x["tone"].isNotNull()))


def read_frames_csv(spark: SparkSession, path: str, stream_id: str | None = None) -> DataFrame:
    """Frames of sample and stream files by their own headers: files of both orders, and of different widths, in one call.
    More columns: tones (the numbers in the names), and the header as meta, date and sample_rate."""
    lines = with_headers(numbered_lines(spark, path, stream_id), file_headers(spark, path).select(
        "file", "meta", *[places(F.col("names"), f"^{c}_(?:data_)?([0-9]+)$").alias(c) for c in "iq"], places(F.col("names"), "^flag([0-9]+)$").alias("flag"),
        *[F.array_position("names", c).alias(c) for c in ("packet_counter", "packet_error")],
    ))
    pick = lambda at: F.transform(at, lambda x: F.get("v", x["at"]).cast("double").cast("int"))
    number = lambda c: F.get("v", F.col(c).cast("int") - 1).cast("double")
    out = lines.select("stream_id", "seq", number("packet_counter").cast("long").alias("packet_counter"), number("packet_error").cast("int").alias("packet_error"), pick(F.col("flag")).alias("flags"), pick(F.col("i")).alias("i"), pick(F.col("q")).alias("q"), F.col("i.tone").alias("tones"), "meta")
    return out.withColumns({"date": F.col("meta")["date"], "sample_rate": F.expr("try_cast(meta['sample_rate'] AS double)")})


def _body(spark: SparkSession, path: str, columns: list[str], kind: str, stream_id: str | None) -> DataFrame:
    """Data lines as an array of one type: no wide schema is built, however many tones there are."""
    return numbered_lines(spark, path, stream_id).select("stream_id", "seq", F.split("value", ",").cast(f"array<{kind}>").alias("v"))


def _frames(body: DataFrame, tones: int, first: int, trail: int, counter: str) -> DataFrame:
    pick = lambda off: F.transform(F.sequence(F.lit(0), F.lit(tones - 1)), lambda t: F.get("v", t * 2 + first + off))
    flags = F.transform(F.slice("v", trail + 3, FLAGS), lambda x: x.cast("int"))
    return body.select("stream_id", "seq", F.get("v", F.lit(trail)).cast("long").alias(counter), F.get("v", F.lit(trail + 1)).cast("int").alias("packet_error"), flags.alias("flags"), pick(0).cast("array<int>").alias("i"), pick(1).cast("array<int>").alias("q"))


def read_samples_csv(spark: SparkSession, path: str, tones: int | None = None, stream_id: str | None = None) -> DataFrame:
    """Frames of sample files; seq is the line's place in its stream (see numbered_lines). Without the number of tones,
    each file's header says it."""
    if tones is None:
        return read_frames_csv(spark, path, stream_id).drop("tones", "meta", "date", "sample_rate")
    return _frames(_body(spark, path, sample_columns(tones), "double", stream_id), tones, 0, 2 * tones, "packet_counter")


def read_stream_csv(spark: SparkSession, path: str, tones: int | None = None, stream_id: str | None = None) -> DataFrame:
    """Frames of stream files; seq is the line's place in its stream (see numbered_lines). Without the number of tones,
    each file's header says it."""
    if tones is None:
        return read_frames_csv(spark, path, stream_id).drop("tones", "meta", "date", "sample_rate")
    return _frames(_body(spark, path, stream_columns(tones), "double", stream_id), tones, len(TRAIL), 0, "packet_counter")


def _csv_line(frames: DataFrame, order: str) -> Column:
    z = F.concat_ws(",", F.transform(F.arrays_zip("i", "q"), lambda x: F.concat_ws(",", x["i"].cast("string"), x["q"].cast("string"))))
    trail = F.concat_ws(",", F.col("packet_counter").cast("string"), F.col("packet_error").cast("string"), F.col("flags").cast("array<string>"))
    return F.concat_ws(",", z, trail) if order == "samples" else F.concat_ws(",", trail, z)


def _said(meta: dict, sep: str = ",") -> Column:
    """Header lines of meta, whose values are constants or columns, each but the last with a line feed."""
    lines = [F.concat(F.lit(f"# {k}{sep}"), F.coalesce((v if isinstance(v, Column) else F.lit(v)).cast("string"), F.lit(""))) for k, v in meta.items()]
    return F.concat_ws("\n", *lines)


def _heads(rows: DataFrame, key: str, meta: dict, **more: Column) -> tuple[DataFrame, dict]:
    """One row (name, columns of meta, more: aggregates) for each key of rows, and meta with columns of these rows."""
    own = {k: v for k, v in meta.items() if isinstance(v, Column)}
    small = rows.groupBy(F.col(key).alias("name")).agg(*[v.alias(k) for k, v in more.items()], *[F.max(v).alias(f"_{k}") for k, v in own.items()]) if own or more else rows.select(F.col(key).alias("name")).distinct()
    return small, {k: F.col(f"_{k}") if k in own else v for k, v in meta.items()}


def write_frames_csv(frames: DataFrame, path: str, tones: int | None, meta: dict, order: str = "samples") -> None:
    """One file path/<stream_id>.csv for each stream: the # lines of meta (constants, or columns of frames that are the
    same in a stream), the names, and lines in order of seq. order samples: tones first; stream: trailer first. tones is
    each stream's own number unless it is given. Files are committed whole, and written in ranges (sinks.write_files)."""
    small, said = _heads(frames, "stream_id", meta, n=F.max(F.size("i")))
    n = F.col("n") if tones is None else F.lit(tones)
    form = "i_data_%04d,q_data_%04d" if order == "samples" else "i_%04d,q_%04d"
    names = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda t: F.format_string(form, t, t)), ",")
    trail = F.lit(",".join(TRAIL))
    heads = small.select("name", F.concat_ws("\n", *[_said(said)] * bool(said), F.concat_ws(",", names, trail) if order == "samples" else F.concat_ws(",", trail, names)).alias("value"))
    lines = frames.select(F.col("stream_id").alias("name"), F.col("seq").alias("place"), _csv_line(frames, order).alias("value"))
    write_files(headed(lines, heads, ".csv"), path)


def read_sweep_csv(spark: SparkSession, path: str, tones: int | None = None, sweep_id: str | None = None) -> DataFrame:
    """Long rows of sweep files, whose lines are points in turn; each file is a sweep of its name unless sweep_id is given.
    Without the number of tones, each file's names say which tones it has."""
    parts = ("f", "i", "q", "ei", "eq")
    if tones is None:
        called = dict(zip(parts, ("sweep_f", "sweep_i", "sweep_q", "err_i", "err_q"), strict=True))
        at = file_headers(spark, path).select("file", *[places(F.col("names"), f"^{name}_([0-9]+)$").alias(c) for c, name in called.items()])
        rows = with_headers(numbered_lines(spark, path, sweep_id), at)
        zipped = F.transform("f", lambda x, k: F.struct(x["tone"].alias("tone"), *[F.get("v", F.get(c, k)["at"]).cast("double").alias(c) for c in parts]))
        return rows.select(F.col("stream_id").alias("sweep_id"), F.col("seq").cast("int").alias("point"), F.explode(zipped).alias("z")).select("sweep_id", "z.tone", "point", *[f"z.{c}" for c in parts])
    rows = numbered_lines(spark, path, sweep_id).select(F.col("stream_id").alias("sweep_id"), F.col("seq").cast("int").alias("point"), F.split("value", ",").cast("array<double>").alias("v"))
    each = rows.select("sweep_id", "point", F.explode(F.sequence(F.lit(0), F.lit(tones - 1))).alias("tone"), "v")
    return each.select("sweep_id", "tone", "point", *[F.get("v", F.col("tone") * 5 + k).alias(c) for k, c in enumerate(parts)])


def _point_lines(sweep: DataFrame) -> DataFrame:
    """(sweep_id, point, t): the tones of a point, in order."""
    return sweep.groupBy("sweep_id", "point").agg(F.array_sort(F.collect_list(F.struct("tone", "f", "i", "q", "ei", "eq"))).alias("t"))


def write_sweep_csv(sweep: DataFrame, path: str, tones: int | None, meta: dict) -> None:
    """One file path/<sweep_id>.csv for each sweep, as in write_frames_csv: a line for each point. The names have the
    numbers of the sweep's tones, or those below tones if it is given."""
    cells = F.concat_ws(",", F.transform("t", lambda x: F.concat_ws(",", *[x[c].cast("string") for c in ("f", "i", "q", "ei", "eq")])))
    form = ",".join(f"{c}_%1$04d" for c in ("sweep_f", "sweep_i", "sweep_q", "err_i", "err_q"))
    small, said = _heads(sweep, "sweep_id", meta, t=F.array_sort(F.collect_set("tone")))
    numbers = F.col("t") if tones is None else F.sequence(F.lit(0), F.lit(tones - 1))
    heads = small.select("name", F.concat_ws("\n", *[_said(said)] * bool(said), F.array_join(F.transform(numbers, lambda t: F.format_string(form, t)), ",")).alias("value"))
    lines = _point_lines(sweep).select(F.col("sweep_id").alias("name"), F.col("point").cast("long").alias("place"), cells.alias("value"))
    write_files(headed(lines, heads, ".csv"), path)


def sweep_text(sweep: DataFrame) -> DataFrame:
    """(sweep_id, point, value): a line of 6-decimal numbers for each point, tones in order. Numbers are rounded as they are
    in binary, as C and Python do it: format_string rounds their shortest decimal form, so that 0.1252835 would go up."""

    @F.arrow_udf("string")
    def cell(f: pa.Array, i: pa.Array, q: pa.Array, ei: pa.Array, eq: pa.Array) -> pa.Array:
        each = zip(*(c.to_pylist() for c in (f, i, q, ei, eq)), strict=True)
        return pa.array([" ".join(["null" if v is None else f"{v:.6f}" for v in x]) for x in each], pa.string())

    cells = sweep.select("sweep_id", "point", F.struct("tone", cell(*[F.col(c).cast("double") for c in ("f", "i", "q", "ei", "eq")]).alias("text")).alias("x"))
    return cells.groupBy("sweep_id", "point").agg(F.concat_ws(" ", F.array_sort(F.collect_list("x"))["text"]).alias("value"))


def write_sweep_text(sweep: DataFrame, path: str, meta: dict) -> None:
    """One file path/<sweep_id>.txt for each sweep: the # lines of meta, and a line for each point."""
    small, said = _heads(sweep, "sweep_id", meta)
    lines = sweep_text(sweep).select(F.col("sweep_id").alias("name"), F.col("point").cast("long").alias("place"), "value")
    heads = small.select("name", _said(said, ": ").alias("value"))
    write_files(headed(lines, heads if meta else heads.limit(0), ".txt"), path)


DOCUMENT = "date string, num_tones int, num_samples long, sample_rate double, i_data map<string,array<int>>, q_data map<string,array<int>>, packet_counter array<long>, packet_error array<int>, stream_flags map<string,array<int>>"


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    """Long samples of JSON documents of arrays by tone (samples or streams: both have this form), with each sample's
    counter, error and flags. stream_id is the file's name."""
    doc = spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("stream_id", stream_name(F.input_file_name()))
    names = [f"flag{k}" for k in range(FLAGS)]
    tone = doc.select("stream_id", F.explode("i_data").alias("key", "i"), "q_data", "packet_counter", "packet_error", "stream_flags")
    zipped = F.arrays_zip("i", F.col("q_data")[F.col("key")].alias("q"), "packet_counter", "packet_error", *[F.col("stream_flags")[n].alias(n) for n in names])
    each = tone.select("stream_id", F.col("key").cast("int").alias("tone"), F.posexplode(zipped).alias("seq", "z"))
    return each.select("stream_id", F.col("seq").cast("long").alias("seq"), "z.packet_counter", "z.packet_error", F.array(*[F.col(f"z.{n}") for n in names]).alias("flags"), "tone", "z.i", "z.q")


_PARTS = {"f": "sweep_f", "i": "sweep_i", "q": "sweep_q", "ei": "sweep_ei", "eq": "sweep_eq"}
SWEEP_DOCUMENT = "date string, num_tones int, num_points int, samples_per_point int, " + ", ".join(f"{c} array<array<double>>" for c in _PARTS.values())


def read_sweep_document(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of JSON documents of sweeps, whose arrays are by tone, then point. sweep_id is the file's name."""
    doc = spark.read.schema(SWEEP_DOCUMENT).json(path, multiLine=True).withColumn("sweep_id", stream_name(F.input_file_name()))
    tone = doc.select("sweep_id", F.posexplode(F.arrays_zip(*[F.col(c).alias(k) for k, c in _PARTS.items()])).alias("tone", "t"))
    point = tone.select("sweep_id", "tone", F.posexplode(F.arrays_zip(*[F.col(f"t.{k}").alias(k) for k in _PARTS])).alias("point", "z"))
    return point.select("sweep_id", "tone", "point", *[f"z.{k}" for k in _PARTS])


#: Places of a document: room for so many samples of a tone, and so many tones of a section.
_SAMPLES, _TONES = 1 << 36, 1 << 16


def _document(head: DataFrame, cells: DataFrame, sections: list[tuple[str, str, bool]], keyed: bool) -> DataFrame:
    """Pieces of JSON documents: head(name, open, first, tones) has what stands before the sections; cells(name, section,
    tone, k, value) are the numbers. sections: (name, key of a tone as a format, whether it has tones). keyed: tones
    are keys of an object, else elements of an array."""
    opens, closes = ("{", "}") if keyed else ("[", "]")
    rows = []
    for k, (section, key, several) in enumerate(sections):
        tone = F.explode(F.sequence(F.lit(0), F.col("tones") - 1 if several == "tones" else F.lit(FLAGS - 1) if several else F.lit(0)))
        begin = f'"{section}": ' + (opens if several else "")
        end = ("" if not k else "]" + (closes if sections[k - 1][2] else "") + ", ") + begin
        label = F.format_string(f'"{key}": [', F.col("tone")) if several and keyed else F.lit("[")
        text = F.concat(F.when(F.col("tone") == 0, F.lit(end)).otherwise(F.lit("], ")), label)
        rows.append(head.select("name", "open", tone.alias("tone")).select("name", (F.lit(k * _TONES) + F.col("tone")).alias("row"), F.concat(F.when(F.col("tone") == 0, F.col("open") if not k else F.lit("")).otherwise(F.lit("")), text).alias("value")))
    tops = rows[0]
    for more in rows[1:]:
        tops = tops.unionByName(more)
    last = head.select("name", F.lit(len(sections) * _TONES).alias("row"), F.lit("]" + (closes if sections[-1][2] else "") + "}\n").alias("value"))
    tops = tops.unionByName(last).select("name", (F.col("row") * _SAMPLES).alias("place"), "value")
    body = cells.select("name", ((F.col("section") * _TONES + F.col("tone")) * _SAMPLES + F.col("k") + 1).alias("place"), F.concat(F.when(F.col("k") > 0, F.lit(", ")).otherwise(F.lit("")), F.coalesce("value", F.lit("null"))).alias("value"))
    return tops.unionByName(body)


def _open(meta: dict, **more: Column) -> Column:
    """The beginning of a document: meta as JSON members, and a comma."""
    members = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in meta.items()] + [v.alias(k) for k, v in more.items()]
    return F.concat(F.regexp_replace(F.to_json(F.struct(*members)), r"\}$", ""), F.lit(", "))


def write_sweep_document(sweep: DataFrame, path: str, meta: dict) -> None:
    """One JSON document path/<sweep_id>.json for each sweep, whose arrays are by tone, then point; written in ranges of
    numbers, so that no task holds a sweep. Tones and points are numbered in order, and NaN is null."""
    name = F.concat("sweep_id", F.lit(".json"))
    sweep, order = sweep.select("sweep_id", "tone", "point", *_PARTS), Window.partitionBy("sweep_id")
    tones = sweep.select("sweep_id", "tone").distinct().withColumn("t", F.row_number().over(order.orderBy("tone")) - 1)
    points = sweep.select("sweep_id", "point").distinct().withColumn("k", F.row_number().over(order.orderBy("point")) - 1)
    size = tones.groupBy("sweep_id").agg(F.count("*").alias("tones")).join(points.groupBy("sweep_id").agg(F.count("*").alias("points")), "sweep_id")
    head = size.select(name.alias("name"), "tones", _open(meta, num_tones=F.col("tones"), num_points=F.col("points")).alias("open"))
    number = lambda c: F.when(~F.isnan(c), F.col(c).cast("string"))
    values = F.array(*[F.struct(F.lit(s).alias("section"), number(c).alias("value")) for s, c in enumerate(_PARTS)])
    cells = sweep.join(tones, ["sweep_id", "tone"]).join(points, ["sweep_id", "point"]).select(name.alias("name"), F.col("t").alias("tone"), "k", F.explode(values).alias("x"))
    write_files(_document(head, cells.select("name", "x.section", "tone", "k", "x.value"), [(c, "", "tones") for c in _PARTS.values()], keyed=False), path)


def write_json_document(frames: DataFrame, path: str, tones: int | None, meta: dict) -> None:
    """One JSON document path/<stream_id>.json for each stream, with its samples by tone, then seq (which must have no
    gaps); written in ranges of numbers, so that no task holds a recording."""
    name = F.concat("stream_id", F.lit(".json"))
    n = F.max(F.size("i")) if tones is None else F.lit(tones)
    size = frames.groupBy("stream_id").agg(n.alias("tones"), F.min("seq").alias("first"), F.count("*").alias("n"))
    head = size.select(name.alias("name"), "tones", _open(meta, num_tones=F.col("tones"), num_samples=F.col("n")).alias("open"))
    few = size.select("stream_id").limit(MOST_HEADERS + 1).count() <= MOST_HEADERS
    each = frames.join(F.broadcast(size) if few else size, "stream_id").withColumn("k", F.col("seq") - F.col("first"))
    row = lambda section, values: F.transform(values, lambda x, t: F.struct(F.lit(section).alias("section"), t.alias("tone"), x.cast("string").alias("value")))
    values = F.concat(*[row(s, F.slice(c, 1, F.col("tones"))) for s, c in enumerate("iq")], row(2, F.array("packet_counter")), row(3, F.array(F.col("packet_error").cast("long"))), row(4, "flags"))
    cells = each.select(name.alias("name"), "k", F.explode(values).alias("x")).select("name", "x.section", "x.tone", "k", "x.value")
    sections = [("i_data", "%04d", "tones"), ("q_data", "%04d", "tones"), ("packet_counter", "", False), ("packet_error", "", False), ("stream_flags", "flag%d", True)]
    write_files(_document(head, cells, sections, keyed=True), path)


def write_json_lines(long_rows: DataFrame, path: str) -> None:
    long_rows.write.mode("overwrite").json(path)


PAYLOAD = "sweep_id string, num_tones int, num_points int, samples_per_point int, sweep struct<f: string, z: string, e: string>"


def decode_sweeps(payloads: DataFrame, layout: str = "point_major") -> DataFrame:
    """Long sweep rows of base64 payloads. The writer lays points out first; tone_major reads the bytes the other way."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                t, p = r["num_tones"], r["num_points"]
                f, z, e = np.frombuffer(r["f"], "<f8"), np.frombuffer(r["z"], "<c16"), np.frombuffer(r["e"], "<c16")
                n = np.arange(t * p)
                tone, point = (n % t, n // t) if layout == "point_major" else (n // p, n % p)
                yield pa.RecordBatch.from_arrays([pa.array([r["sweep_id"]] * (t * p)), pa.array(tone.astype(np.int32)), pa.array(point.astype(np.int32)), *[pa.array(x) for x in (f, z.real.copy(), z.imag.copy(), e.real.copy(), e.imag.copy())]], ["sweep_id", "tone", "point", "f", "i", "q", "ei", "eq"])

    raw = payloads.select("sweep_id", "num_tones", "num_points", *[F.unbase64(F.col(f"sweep.{c}")).alias(c) for c in "fze"])
    return raw.mapInArrow(decoded, SWEEP)


def encode_sweeps(sweep: DataFrame) -> DataFrame:
    """One payload row for each sweep, point after point."""

    def encoded(t: pa.Table) -> pa.Table:
        import base64

        t = t.sort_by([("point", "ascending"), ("tone", "ascending")])
        c = {k: t.column(k).to_numpy() for k in ("f", "i", "q", "ei", "eq", "tone", "point")}
        text = [base64.b64encode(np.ascontiguousarray(x).tobytes()).decode() for x in (c["f"], c["i"] + 1j * c["q"], c["ei"] + 1j * c["eq"])]
        return pa.table({"sweep_id": t.column("sweep_id")[:1], "num_tones": pa.array([len(set(c["tone"]))], pa.int32()), "num_points": pa.array([len(set(c["point"]))], pa.int32()), "f": text[:1], "z": text[1:2], "e": text[2:]})

    out = sweep.groupBy("sweep_id").applyInArrow(encoded, "sweep_id string, num_tones int, num_points int, f string, z string, e string")
    return out.select("sweep_id", "num_tones", "num_points", F.struct("f", "z", "e").alias("sweep"))


#: Values of a piece of a payload: a multiple of 3, so that the base64 text of pieces is that of the whole.
PIECE = 3 * 4096


def write_sweep_payloads(sweep: DataFrame, path: str, meta: dict) -> None:
    """One JSON payload path/<sweep_id>.json for each sweep, point after point, as base64 that is encoded in pieces of PIECE
    values and written side by side, so that no task holds a sweep. Every point must have every tone."""

    def encoded(t: pa.Table) -> pa.Table:
        import base64

        t = t.sort_by("place")
        c = {k: t.column(k).to_numpy() for k in ("f", "i", "q", "ei", "eq")}
        parts = (c["f"], c["i"] + 1j * c["q"], c["ei"] + 1j * c["eq"])
        return pa.table({"name": t.column("name")[:1], "piece": t.column("piece")[:1], **{k: pa.array([base64.b64encode(np.ascontiguousarray(x).tobytes()).decode()]) for k, x in zip("fze", parts, strict=True)}})

    sweep, order = sweep.select("sweep_id", "tone", "point", *_PARTS), Window.partitionBy("sweep_id")
    tones = sweep.select("sweep_id", "tone").distinct().withColumn("t", F.row_number().over(order.orderBy("tone")) - 1)
    points = sweep.select("sweep_id", "point").distinct().withColumn("k", F.row_number().over(order.orderBy("point")) - 1)
    size = tones.groupBy("sweep_id").agg(F.count("*").alias("n")).join(points.groupBy("sweep_id").agg(F.count("*").alias("points")), "sweep_id")
    name = F.concat("sweep_id", F.lit(".json")).alias("name")
    placed = sweep.join(tones, ["sweep_id", "tone"]).join(points, ["sweep_id", "point"]).join(size.select("sweep_id", "n"), "sweep_id").withColumn("place", (F.col("k") * F.col("n") + F.col("t")).cast("long"))
    pieces = placed.select(name, F.floor(F.col("place") / PIECE).alias("piece"), "place", "f", "i", "q", "ei", "eq").groupBy("name", "piece").applyInArrow(encoded, "name string, piece long, f string, z string, e string")
    section = 1 << 40
    body = pieces.select("name", F.explode(F.array(*[F.struct((F.col("piece") + k * section + 1).alias("place"), F.col(c).alias("value")) for k, c in enumerate("fze")])).alias("x")).select("name", "x.*")
    opens = [F.concat(_open(meta, num_tones=F.col("n"), num_points=F.col("points")), F.lit('"sweep": {"f": "')), F.lit('", "z": "'), F.lit('", "e": "'), F.lit('"}}\n')]
    frame = size.select(name, F.explode(F.array(*[F.struct(F.lit(k * section).alias("place"), v.alias("value")) for k, v in enumerate(opens)])).alias("x")).select("name", "x.*")
    write_files(frame.unionByName(body), path)


def read_sweep_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Long rows of the payloads under path; sweep_id is the file's name."""
    whole = spark.read.schema(PAYLOAD.partition(", ")[2]).json(path, multiLine=True)
    return decode_sweeps(whole.withColumn("sweep_id", stream_name(F.input_file_name())))


def decode_cubes(payloads: DataFrame) -> DataFrame:
    """Long raw samples of base64 cubes laid out by sample, point, tone: payloads(sweep_id, samples, points, tones,
    data_i, data_q)."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                s, p, t = r["samples"], r["points"], r["tones"]
                n = np.arange(s * p * t)
                parts = [n // (p * t), n // t % p, n % t]
                yield pa.RecordBatch.from_arrays([pa.array([r["sweep_id"]] * len(n)), *[pa.array(x.astype(np.int32)) for x in parts], pa.array(np.frombuffer(r["di"], "<f8")), pa.array(np.frombuffer(r["dq"], "<f8"))], ["sweep_id", "sample", "point", "tone", "i", "q"])

    raw = payloads.select("sweep_id", "samples", "points", "tones", F.unbase64("data_i").alias("di"), F.unbase64("data_q").alias("dq"))
    return raw.mapInArrow(decoded, "sweep_id string, sample int, point int, tone int, i double, q double")


def encode_cubes(samples: DataFrame) -> DataFrame:
    """One cube row for each sweep of long raw samples (sweep_id, sample, point, tone, i, q)."""

    def encoded(t: pa.Table) -> pa.Table:
        import base64

        t = t.sort_by([(c, "ascending") for c in ("sample", "point", "tone")])
        size = [pa.array([len(set(t.column(c).to_pylist()))], pa.int32()) for c in ("sample", "point", "tone")]
        if np.prod([c[0].as_py() for c in size]) != len(t):
            raise ValueError("a cube lacks samples, or has them twice")
        data = [pa.array([base64.b64encode(np.ascontiguousarray(t.column(c).to_numpy(), "<f8").tobytes()).decode()]) for c in "iq"]
        return pa.table([t.column("sweep_id")[:1], *size, *data], ["sweep_id", "samples", "points", "tones", "data_i", "data_q"])

    return samples.groupBy("sweep_id").applyInArrow(encoded, "sweep_id string, samples int, points int, tones int, data_i string, data_q string")


def read_calibration(spark: SparkSession, path: str, cal_id: str = "") -> DataFrame:
    """Two columns of numbers; comments and lines that are no numbers are left out. cal_order is the order of the files, by
    name, and of their lines."""
    rows = numbered_lines(spark, path, cal_id).select(F.col("seq").alias("cal_order"), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("v"))
    out = rows.select(F.lit(cal_id).alias("cal_id"), "cal_order", F.expr("try_cast(v[0] AS double)").alias("freq_hz"), F.expr("try_cast(get(v, 1) AS double)").alias("value_db"))
    return out.where("freq_hz IS NOT NULL AND value_db IS NOT NULL")


def write_calibration(cal: DataFrame, path: str, comment: str = "freq_hz value_db") -> None:
    """One file path/<cal_id>.txt for each calibration: a comment, and a line for each row of cal(cal_id, cal_order,
    freq_hz, value_db) in order of cal_order."""
    line = F.concat_ws(" ", F.col("freq_hz").cast("string"), F.col("value_db").cast("string"))
    lines = cal.select(F.col("cal_id").alias("name"), F.col("cal_order").alias("place"), line.alias("value"))
    write_files(headed(lines, cal.select(F.col("cal_id").alias("name"), F.lit(f"# {comment}").alias("value")).distinct(), ".txt"), path)


def read_tone_list(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True, schema=TONE_LIST, ignoreTrailingWhiteSpace=True)
    return rows.select(F.col("Name").alias("name"), F.col("Freq").alias("freq_hz"), F.col("`Offset att`").alias("offset_att"), F.col("All").alias("all_flag"), F.col("None").alias("none_flag"))


def tone_list_lines(tones: DataFrame, by_set: bool = False) -> DataFrame:
    """(tone, value): lines of a tone list; absent columns take the defaults K000..., 0, 1, 0."""
    has = lambda c, default: F.coalesce(F.col(c), default) if c in tones.columns else default
    name = has("name", F.format_string("K%03d", "tone"))
    cells = [name, F.format_string("%f", "freq_hz"), F.format_string("%f", has("offset_att", F.lit(0.0)).cast("double")), F.format_string("%d", has("all_flag", F.lit(1)).cast("int")), F.format_string("%d", has("none_flag", F.lit(0)).cast("int"))]
    return tones.select(*["tone_set"] * by_set, "tone", F.concat_ws("\t", *cells).alias("value"))


def write_tone_list(tones: DataFrame, path: str, name: str = "part-tones.txt", by_set: bool = False) -> None:
    """One file path/name of all tones in order of their numbers, or path/<tone_set>/name for each tone_set."""
    called = (F.concat("tone_set", F.lit("/")) if by_set else F.lit("")).alias("name")
    lines = tone_list_lines(tones, by_set).select(called, F.col("tone").cast("long").alias("place"), "value")
    heads = tones.select(called).distinct() if by_set else tones.sparkSession.createDataFrame([("",)], "name string")
    write_files(headed(lines, heads.withColumn("value", F.lit("Name\tFreq\tOffset att\tAll\tNone")), name, "\r\n"), path)
