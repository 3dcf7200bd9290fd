"""Vector code compression: product codes whose codebooks are fitted over anchors-hierarchy metric trees (Moore, 2000)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components lie within so much of 0, so that sums of squares fit 64 bits.
MOST = 2**25
#: Vectors of a block (one set of trees), and points of a ball that is not divided.
BLOCK_ROWS, LEAF = 8192, 160


# Metric trees


def anchors(x: np.ndarray) -> list[np.ndarray]:
    """Rows of x dealt to about sqrt(n) anchors, each to its nearest: a new anchor is the farthest row of the widest
    anchor, and takes rows from an anchor only down to half the distance between both, as nearer ones can't change."""
    first = np.arange(len(x))
    d = distance(x, x[0])
    order = np.argsort(-d, kind="stable")
    pivots, own, far = [x[0]], [first[order]], [d[order]]
    for _ in range(int(np.sqrt(len(x))) - 1):
        widest = int(np.argmax([f[0] for f in far]))
        if far[widest][0] == 0:
            break
        pivot = x[own[widest][0]]
        gaps = distance(np.array(pivots), pivot)
        rows, dist = [], []
        for k in np.flatnonzero(np.array([f[0] for f in far]) >= gaps / 2):
            gap = gaps[k]
            near = int(np.searchsorted(-far[k], -gap / 2, "right"))  # rows from here on are nearer to k than gap / 2
            seen = own[k][:near]
            to_new = distance(x[seen], pivot)
            moves = to_new < far[k][:near]
            if moves.any():
                rows.append(seen[moves])
                dist.append(to_new[moves])
                stays = np.concatenate([np.flatnonzero(~moves), np.arange(near, len(own[k]))])
                own[k], far[k] = own[k][stays], far[k][stays]
        rows, dist = np.concatenate(rows), np.concatenate(dist)
        order = np.argsort(-dist, kind="stable")
        pivots.append(pivot)
        own.append(rows[order])
        far.append(dist[order])
    return own


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.sqrt(np.einsum("...i,...i->...", d, d))


class Ball:
    """Points order[lo:hi] of a tree, their number and sum, a centre, and a radius about it that holds them all."""

    __slots__ = ("rows", "centre", "radius", "below", "count", "total")

    def __init__(self, x: np.ndarray, rows: np.ndarray, below: list[Ball]):
        self.rows, self.below, self.count = rows, below, len(rows)
        self.total = x[rows].sum(axis=0)
        self.centre = self.total / self.count
        self.radius = float(distance(x[rows], self.centre).max()) * (1 + 1e-9)


def middle_out(x: np.ndarray, rows: np.ndarray) -> Ball:
    """The ball of these rows: anchors in the middle, joined upwards two at a time (those first whose union has the
    smallest radius) and divided downwards in the same way."""
    if len(rows) <= LEAF:
        return Ball(x, rows, [])
    groups = anchors(x[rows])
    if len(groups) == 1:
        return Ball(x, rows, [])
    balls: list[Ball] = [middle_out(x, rows[g]) for g in groups]
    centres = np.array([b.centre for b in balls])
    radius = np.array([b.radius for b in balls])
    alive = np.ones(len(balls), bool)
    # Radius of the smallest ball about both balls of a pair.
    gap = distance(centres[:, None], centres[None])
    width = np.maximum((gap + radius[:, None] + radius[None]) / 2, np.maximum(radius[:, None], radius[None]))
    np.fill_diagonal(width, np.inf)
    for _ in range(len(balls) - 1):
        a, b = np.unravel_index(np.argmin(width), width.shape)
        joined = Ball(x, np.concatenate([balls[a].rows, balls[b].rows]), [balls[a], balls[b]])
        balls[a], centres[a], radius[a], alive[b] = joined, joined.centre, joined.radius, False
        gap = distance(centres, joined.centre)
        row = np.maximum((gap + radius + joined.radius) / 2, np.maximum(radius, joined.radius))
        row[~alive] = np.inf
        row[a] = np.inf
        width[a], width[:, a], width[b], width[:, b] = row, row, np.inf, np.inf
    return balls[int(np.flatnonzero(alive)[0])]


#: A tree as flat arrays in preorder: ball k has the points order[lo[k]:hi[k]], and next[k] is the first ball that is not
#: below k; leaves have next = k + 1. Sums are those of the points.
FLAT = {"lo": np.int32, "hi": np.int32, "next": np.int32, "radius": np.float64, "centre": np.float64, "total": np.int64, "order": np.int32}


def flatten(x: np.ndarray) -> dict[str, np.ndarray]:
    order, lo, hi, after, radius, centre, n = [], [], [], [], [], [], 0
    stack: list[Ball | int] = [middle_out(x.astype(np.float64), np.arange(len(x)))]  # a number: ball k is done
    while stack:
        ball = stack.pop()
        if isinstance(ball, int):
            hi[ball], after[ball] = n, len(lo)
            continue
        stack.append(len(lo))
        stack += ball.below[::-1]
        lo.append(n)
        hi.append(0)
        after.append(0)
        radius.append(ball.radius)
        centre.append(ball.centre)
        if not ball.below:
            order.append(ball.rows)
            n += len(ball.rows)
    order = np.concatenate(order)
    sums = np.zeros((len(x) + 1, x.shape[1]), np.int64)
    np.cumsum(x[order], axis=0, out=sums[1:])
    lo, hi = np.array(lo), np.array(hi)
    found = {"lo": lo, "hi": hi, "next": np.array(after), "radius": np.array(radius), "centre": np.array(centre), "total": sums[hi] - sums[lo], "order": order}
    return {k: np.ascontiguousarray(found[k], kind) for k, kind in FLAT.items()}


def owners(tree: dict[str, np.ndarray], x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry of each row of x, rows of each entry, sum of the rows of each entry): the nearest entry, the first of equal
    ones. Candidates of a ball are those of the ball above it without the ones that lose to the nearest entry of its
    centre all over the ball: from there on they aren't looked at. A ball with one candidate left is wholly its own."""
    entries, d = book.shape
    label, counts, sums = np.zeros(len(x), np.int32), np.zeros(entries, np.int64), np.zeros((entries, d), np.int64)
    points = x[tree["order"]].astype(np.float64)
    books = book.astype(np.float64)
    exact = 4 * d * float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))) ** 2 < 2**52
    _, distinct = np.unique(book, axis=0, return_index=True)  # of equal entries the first has all
    held = [(len(tree["lo"]), np.sort(distinct))]
    between = distance(books[:, None], books[None])
    lo, hi, after, radius, centre, total, order = (tree[k] for k in FLAT)
    k = 0
    while k < len(lo):
        while held[-1][0] <= k and len(held) > 1:
            held.pop()
        mine = held[-1][1]
        if len(mine) > 1:
            gap = books[mine] - centre[k]
            to = np.einsum("ij,ij->i", gap, gap)
            best = int(np.argmin(to))
            reach = 2 * radius[k] * between[mine[best], mine]
            mine = mine[to - to[best] <= reach + 1e-9 * (to + to[best] + 1)]  # what may be nearest somewhere in the ball
        if len(mine) == 1:
            label[order[lo[k] : hi[k]]] = mine[0]
            counts[mine[0]] += hi[k] - lo[k]
            sums[mine[0]] += total[k]
            k = after[k]
        elif after[k] == k + 1:
            rows = order[lo[k] : hi[k]]
            if exact:
                p = points[lo[k] : hi[k]]
                near = books[mine]
                won = mine[np.argmin(np.einsum("ij,ij->i", near, near) - 2 * (p @ near.T), axis=1)]
            else:
                gap = x[rows][:, None].astype(np.int64) - book[mine][None]
                won = mine[np.argmin((gap * gap).sum(axis=2), axis=1)]
            label[rows] = won
            counts += np.bincount(won, minlength=entries)
            np.add.at(sums, won, x[rows])
            k += 1
        else:
            held.append((after[k], mine))
            k += 1
    return label, counts, sums


# Blocks of vectors as rows of a table


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding as doubles) without null vectors and those with a null, NaN or infinite component."""
    v = F.col("embedding").cast("array<double>")
    good = v.isNotNull() & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("embedding"))


def integers(v: Column, dims: int) -> Column:
    """floor(SCALE * x) of each component, within MOST of 0, and zeros up to dims components."""
    x = F.transform(v, lambda c: F.least(F.greatest(F.floor(c * F.lit(float(SCALE))), F.lit(-float(MOST))), F.lit(float(MOST))).cast("int"))
    return F.concat(x, F.array_repeat(F.lit(0), F.lit(dims) - F.size(x)))


def block_type(label: T.DataType) -> T.StructType:
    lists = [T.StructField("vec_id", T.ArrayType(T.LongType())), T.StructField("label", T.ArrayType(label)), T.StructField("points", T.BinaryType())]
    return T.StructType(lists + [T.StructField(f"{k}{p}", T.BinaryType()) for p in range(PARTS) for k in FLAT])


def trees(dims: int, schema: pa.Schema, most: int) -> Callable:
    """Rows (vec_id, label, v) to blocks of at most so many: their values, and a metric tree for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks_of(batches, most):
            x = np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.int32).reshape(-1, dims)
            row = {"vec_id": [table.column("vec_id").to_pylist()], "label": [table.column("label").to_pylist()], "points": [x.tobytes()]}
            for p, part in enumerate(np.split(x, PARTS, axis=1)):
                row |= {f"{k}{p}": [v.tobytes()] for k, v in flatten(part).items()}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    return run


def blocks_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < len(batch):
            piece = batch.slice(at, most - n)
            held.append(piece)
            n += len(piece)
            at += len(piece)
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def unpacked(block: dict, dims: int, p: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The tree and the points of a block's part."""
    width = dims // PARTS
    tree = {k: np.frombuffer(block[f"{k}{p}"], kind) for k, kind in FLAT.items()}
    tree |= {k: tree[k].reshape(-1, width) for k in ("centre", "total")}
    return tree, np.frombuffer(block["points"], np.int32).reshape(-1, dims)[:, p * width : (p + 1) * width]


def sums_of(dims: int, books: np.ndarray) -> Callable:
    """(part, entry, n, sums) of each task's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for block in batch.to_pylist():
                for p in range(PARTS):
                    tree, x = unpacked(block, dims, p)
                    _, n, total = owners(tree, x, books[p])
                    counts[p] += n
                    sums[p] += total
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def codes_of(dims: int, books: np.ndarray, schema: pa.Schema) -> Callable:
    """(vec_id, label, code, error) of each vector, by the trees and the final entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, block in enumerate(batch.to_pylist()):
                names, error = np.zeros((len(block["vec_id"]), PARTS), np.uint8), np.zeros(len(block["vec_id"]), np.int64)
                for p in range(PARTS):
                    tree, x = unpacked(block, dims, p)
                    label, _, _ = owners(tree, x, books[p])
                    gap = x.astype(np.int64) - books[p][label]
                    error += (gap * gap).sum(axis=1)
                    names[:, p] = label
                text = names.tobytes().hex()
                code = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
                labels = batch.column("label").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([pa.array(block["vec_id"], pa.int64()), labels.cast(schema.field("label").type), pa.array(code), pa.array(error)], schema=schema)

    return run


def first_entries(rows: list[Row], dims: int) -> np.ndarray:
    """Part by part, the entries of the first codebooks: the parts of these vectors in their order."""
    x = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), dims)
    return np.stack(np.split(x, PARTS, axis=1))


def book_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept row of vectors(vec_id, embedding, label).

    Trees over each block of vectors are built once and written to the shared folder; each round reads them with the
    entries of the round before (at most 256, sent with the tasks) and returns, per task, the rows and sums of each
    entry, which Spark adds up. Exact: the trees only leave out entries that can't be nearest, and all sums are of
    integers, so blocks, partitions and their order don't show.

    Null vectors and vectors with a null, NaN or infinite component are left out. A vector shorter than the longest, and
    all of them up to a multiple of four components, are filled up with zeros. Components beyond MOST / SCALE count as
    that bound. Fewer than 256 vectors make as many entries. Null vec_ids come last in the order; rows that repeat a
    vec_id are ordered by their components. Columns but these three are not read. An empty table gives no rows.
    """
    kept = kept_vectors(vectors)
    longest = kept.agg(F.max(F.size("embedding")).alias("n")).first()["n"]
    dims = -(-(longest or 0) // PARTS) * PARTS
    label = kept.schema["label"].dataType
    points = kept.select("vec_id", "label", integers(F.col("embedding"), dims).alias("v"))
    books = first_entries(points.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(min(entries, 256)).collect(), dims)
    coded = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    kinds = arrow_schema(block_type(label))
    blocks = materialize(points.mapInArrow(trees(dims, kinds, block_rows), block_type(label)), "balls")
    for _ in range(rounds):
        found = blocks.mapInArrow(sums_of(dims, books), "part int, entry int, n long, sums array<long>")
        each = found.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = books.copy()
        for r in each.collect():  # at most PARTS * 256 entries times their components
            if r["at"] is not None:
                moved[r["part"], r["entry"], r["at"]] = r["s"] // r["n"]
        books = moved
    codes = materialize(blocks.mapInArrow(codes_of(dims, books, arrow_schema(coded)), coded), "codes")
    by_label = bounded(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    out = codes.join(by_label, F.col("label").eqNullSafe(F.col("of")), "left")
    return out.select("vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
