"""N-gram Jaccard join by vertical partitioning of the global n-gram order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_key
from .components import connected_components, to_least
from .textkit import mix, slices, windows, words

TOKEN_BITS = 53
_U = np.uint64
_SIZE = _U(0xFFFFFFFF)
#: A block of the exact stage has about so many n-grams and documents at most; the n-gram order is cut in so many there.
BLOCK_TOKENS, BLOCK_DOCS, FRAGMENTS = 500_000, 1_000, 4
#: Documents that are looked at for very frequent n-grams, and how many of them in 100 one must be in to count as such.
HINT_DOCS, HINT_PERCENT = 5_000, 1
_FREQUENT_DF = 2**31 - 1


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram) of each distinct n-gram, sorted, and the size of each row's set. n-grams are 53-bit hashes of k
    words, A-Z folded; a row with 1 to k - 1 words has its whole sequence as its only n-gram; one without words none."""
    w = words(texts)
    h = w.hashes()
    at, grams = windows(h, w, k)
    doc, count = w.doc[at], np.diff(w.first)
    few = np.flatnonzero((count > 0) & (count < k))
    if len(few):
        short = np.zeros(len(few), _U)
        for i in range(k - 1):
            has = count[few] > i
            short[has] = mix(short[has] * _U(0x9E3779B97F4A7C15) + h[w.first[few[has]] + i])
        doc = np.concatenate([doc, few])
        grams = np.concatenate([grams, mix(short + count[few].astype(_U) + _U(0xABCDEF))])
    keys = np.unique((doc.astype(_U) << _U(TOKEN_BITS)) | (grams >> _U(64 - TOKEN_BITS)))
    doc = (keys >> _U(TOKEN_BITS)).astype(np.int64)
    return doc, keys & _U(2**TOKEN_BITS - 1), np.bincount(doc, minlength=w.n_docs)


def _class_keys(doc: np.ndarray, tokens: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Key of each row's set (two columns): 96 bits of its n-grams and, in the low half of the second column, its size.
    Rows with equal sets are one class."""
    ends = np.searchsorted(doc, np.arange(len(size) + 1))
    out = np.empty((len(size), 2), _U)
    for k, salt in enumerate((1, 0x5851F42D4C957F2D)):
        sums = np.zeros(len(tokens) + 1, _U)
        np.cumsum(mix(tokens ^ _U(salt)), out=sums[1:])
        out[:, k] = mix(sums[ends[1:]] - sums[ends[:-1]] + size.astype(_U) * _U(0x9E3779B97F4A7C15))
    out[:, 1] = (out[:, 1] & ~_SIZE) | size.astype(_U)
    return out


def _keys(values: np.ndarray) -> pa.Array:
    """Rows of two columns as binary keys of 16 bytes."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _first_of_each(cls: np.ndarray) -> np.ndarray:
    """Which rows are the first of their key."""
    order = np.lexsort((np.arange(len(cls)), cls[:, 1], cls[:, 0]))
    ordered = cls[order]
    out = np.zeros(len(cls), bool)
    out[order[np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(axis=1)])[: len(order)]]] = True
    return out


_PACKED = "fragment long, cls binary, part binary, low binary, high binary"
_LISTED = "cls binary, n int, grams array<struct<df: int, token: long>>, doc_id long, text_key long"
_GRAM = pa.struct([("df", pa.int32()), ("token", pa.int64())])


def _pack(bits: int, k: int, frequent: np.ndarray):
    """Each piece of documents becomes one row for each fragment (range of the n-gram order), rows of ids and keys of
    texts (fragments -1 to -span), and rows of the frequent n-grams by class (fragments under -span)."""
    span = 4 << bits

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = _U(TOKEN_BITS - bits)
        serial = 0
        for batch in batches:
            for piece in slices(batch, "text"):
                doc, tokens, size = shingle_sets(piece.column("text"), k)
                cls = _class_keys(doc, tokens, size)
                ids = piece.column("doc_id").cast(pa.int64())
                rows: list[tuple] = []
                serial += 1
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                rows.append((-1 - (hash((serial, int(cls[0, 0]))) % span), cls.tobytes(), known.astype(np.int8).tobytes(), ids.fill_null(0).to_numpy().tobytes(), piece.column("text_key").to_numpy().tobytes()))
                keep = _first_of_each(cls) & (size > 0)  # a copy in the same piece adds nothing
                mine = keep[doc]
                doc, tokens = doc[mine], tokens[mine]
                often = frequent[np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)] == tokens if len(frequent) else np.zeros(len(tokens), bool)
                places = np.where(often, -1 - span - (cls[doc, 0] % _U(span)).astype(np.int64), (tokens >> shift).astype(np.int64))
                order = np.argsort(places, kind="stable")
                places, doc, tokens = places[order], doc[order], tokens[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(places)) + 1, [len(places)]])
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if hi > lo:
                        own, part = np.unique(doc[lo:hi], return_counts=True)
                        t = tokens[lo:hi] if places[lo] < 0 else tokens[lo:hi] & ((_U(1) << shift) - _U(1))
                        rows.append((int(places[lo]), cls[own].tobytes(), part.astype(np.int32).tobytes(), (t & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), (t >> _U(32)).astype(np.uint32 if places[lo] < 0 else np.uint16).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)], ["fragment", "cls", "part", "low", "high"])

    return packed


def _joined(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _count_fragment(bits: int):
    """One fragment: document frequency of each n-gram over the classes; n-grams of one class only are left out. Frequent
    n-grams are known to be in several classes: they are listed once for each class, with the highest frequency."""
    span = 4 << bits

    def counted(table: pa.Table) -> pa.Table:
        fragment = table.column("fragment")[0].as_py()
        cls, part = _joined(table, "cls", _U).reshape(-1, 2), _joined(table, "part", np.int8 if -span <= fragment < 0 else np.int32)
        n = (cls[:, 1] & _SIZE).astype(np.int32)
        names = ["cls", "n", "grams", "doc_id", "text_key"]
        if -span <= fragment < 0:
            return pa.table([_keys(cls), n, pa.nulls(len(cls), pa.list_(_GRAM)), pa.array(_joined(table, "low", np.int64), mask=part == 0), _joined(table, "high", np.int64)], names)
        tokens = (_joined(table, "high", np.uint16 if fragment >= 0 else np.uint32).astype(_U) << _U(32)) | _joined(table, "low", np.uint32)
        owner = np.repeat(np.arange(len(cls)), part)
        live = _first_of_each(cls)[owner]
        owner, tokens = owner[live], tokens[live]
        if fragment >= 0:
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order] | (_U(fragment) << _U(TOKEN_BITS - bits)), owner[order]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            count = np.diff(np.append(starts, len(tokens)))
            df = np.repeat(count, count)
            owner, tokens, df = owner[df > 1], tokens[df > 1], df[df > 1]
        else:
            df = np.full(len(tokens), _FREQUENT_DF)
        order = np.argsort(owner, kind="stable")
        own, begins = np.unique(owner[order], return_index=True)
        each = pa.StructArray.from_arrays([pa.array(df[order].astype(np.int32)), pa.array(tokens[order].astype(np.int64))], fields=list(_GRAM))
        grams = pa.ListArray.from_arrays(pa.array(np.append(begins, len(order)).astype(np.int32)), each)
        none = pa.nulls(len(own), pa.int64())
        return pa.table([_keys(cls[own]), n[own], grams, none, none], names)

    return counted


def _frequent(source: DataFrame, k: int) -> np.ndarray:
    """n-grams that about HINT_PERCENT of HINT_DOCS different texts, drawn by hash, have or more; at most as many as 100 /
    HINT_PERCENT texts have on average. They say which keys are spread over tasks, never what is compared."""
    rows = source.count()
    few = source.where(F.pmod("text_key", F.lit(max(1, rows // HINT_DOCS))) == 0).dropDuplicates(["text_key"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                tokens, count = np.unique(shingle_sets(piece.column("text"), k)[1], return_counts=True)
                several = count > 1  # what a piece has once is rare
                yield pa.RecordBatch.from_arrays([pa.array(tokens[several].view(np.int64)), pa.array(count[several])], ["token", "c"])

    counted = few.select("text").mapInArrow(listed, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    found = counted.where(F.col("c") >= max(50, min(rows, HINT_DOCS) * HINT_PERCENT // 100)).select("token").toArrow()
    return np.sort(found.column("token").to_numpy().astype(_U))


def overlaps(owner: np.ndarray, tokens: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Numbers of shared n-grams: of members of side 0 (rows) with those of side 1 (columns), or, where all are of side
    0, of each member with the later ones."""
    m, one = len(side), not side.any()
    row, col = np.cumsum(side == 0) - 1, np.arange(m) if one else np.cumsum(side == 1) - 1
    shape = (int((side == 0).sum()), m if one else int((side == 1).sum()))
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(tokens)))
    total = np.zeros(shape[0] * shape[1], np.int32)
    for c in range(2, 13):
        at = starts[count == c]
        for some in np.array_split(at, max(1, len(at) * c * c >> 22)):
            x, y = np.triu_indices(c, 1)
            mine = owner[some[:, None] + np.arange(c)]
            x, y = mine[:, x].ravel(), mine[:, y].ravel()
            if not one:
                apart = side[x] != side[y]
                x, y = x[apart], y[apart]
                x, y = np.where(side[x] == 0, x, y), np.where(side[x] == 0, y, x)
            if len(x):
                codes, times = np.unique(row[x] * shape[1] + col[y], return_counts=True)
                total[codes] += times.astype(np.int32)
    big = np.flatnonzero(count > 12)
    for some in np.array_split(big, max(1, len(big) // 1024)):
        if len(some):
            dense = np.zeros((m, len(some)), np.float32)
            at = np.repeat(np.arange(len(some)), count[some])
            dense[owner[np.repeat(starts[some], count[some]) + np.concatenate([np.arange(c) for c in count[some]])], at] = 1
            product = dense[side == 0] @ (dense if one else dense[side == 1]).T
            total += (np.triu(product, 1) if one else product).astype(np.int32).ravel()
    return total.reshape(shape)


_PARTIAL = "g long, pair string, cls binary, n binary, side binary, codes binary, counts binary"


def _partial(table: pa.Table) -> pa.Table:
    """One fragment of one block: overlaps of each pair as far as the fragment goes. Every member is in every fragment, so
    that places of pairs are the same in all; fragment 0 says who the members are."""
    cls = _joined(table, "cls", _U).reshape(-1, 2)
    order = np.lexsort((cls[:, 1], cls[:, 0]))
    rank = np.empty(len(cls), np.int64)
    rank[order] = np.arange(len(cls))
    lists = table.column("tokens").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    side = table.column("side").to_numpy()[order]
    both = overlaps(np.repeat(rank, np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), side).ravel()
    codes = np.flatnonzero(both)
    dense = len(codes) * 4 > len(both)  # then places need not be named
    first = table.column("f")[0].as_py() == 0
    own = [x.tobytes() if first else b"" for x in (cls[order], table.column("n").to_numpy()[order].astype(np.int64), side.astype(np.int8))]
    row = [table.column("g")[0].as_py(), table.column("pair")[0].as_py(), *own, b"" if dense else codes.astype(np.int64).tobytes(), (both if dense else both[codes]).astype(np.int32).tobytes()]
    return pa.table([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.string(), *[pa.binary()] * 5], strict=True)], ["g", "pair", "cls", "n", "side", "codes", "counts"])


def _links(threshold: int):
    """One block: partial overlaps are summed by pair; a star (class, least class that it is linked to by a chain within
    the block) of the exact links."""

    def linked(table: pa.Table) -> pa.Table:
        cls, n, side = _joined(table, "cls", _U).reshape(-1, 2), _joined(table, "n", np.int64), _joined(table, "side", np.int8)
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if side.any() else np.arange(len(side))
        both = np.zeros(len(left) * len(right), np.int64)
        for codes, counts in zip(table.column("codes").to_pylist(), table.column("counts").to_pylist(), strict=True):
            counts = np.frombuffer(counts, np.int32)
            if codes or not len(counts):
                both[np.frombuffer(codes, np.int64)] += counts
            else:
                both += counts
        at = np.flatnonzero(both)
        a, b, both = left[at // len(right)], right[at % len(right)], both[at]
        link = both * 100 >= threshold * (n[a] + n[b] - both)
        a, b = a[link], b[link]
        label = np.arange(len(cls))
        while True:
            old = label.copy()
            np.minimum.at(label, a, label[b])
            np.minimum.at(label, b, label[a])
            label = label[label]
            if (label == old).all():
                break
        out = np.flatnonzero(label != np.arange(len(cls)))
        return pa.table([_keys(cls[out]), _keys(cls[label[out]])], ["a", "b"])

    return linked


def ngram_classes(docs: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents, n-grams) of docs(doc_id, text), written to the shared folder.

    documents: doc_id, text_key, cls (key of the set of distinct k-word n-grams), n (its size; 0 without words). n-grams:
    cls, n, grams (df, token) of those n-grams that two classes at least have, in several rows for each class.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    parts = max(1, source.rdd.getNumPartitions())
    bits = max(5, (2 * parts).bit_length() - 1)  # fragments grow with the input, so that each stays small
    packed = source.mapInArrow(_pack(bits, k, _frequent(source, k)), _PACKED)
    listed = materialize(packed.groupBy("fragment").applyInArrow(_count_fragment(bits), _LISTED), "ngrams")
    return listed.where("grams IS NULL").select("doc_id", "text_key", "cls", "n"), listed.where("grams IS NOT NULL").select("cls", "n", "grams")


def similar_components(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text): documents whose sets of distinct k-word
    n-grams have 100 * intersection >= threshold * union are linked; component_id is the least doc_id reachable.

    1. Vertical partitions: n-grams are ordered by their hash and that order is cut into ranges (fragments); each
       fragment counts by itself in how many classes (documents with equal sets) an n-gram is. Copies cost nothing.
       n-grams that very many documents have go by class, not by fragment, so no task holds all their rows.
    2. A class is kept if enough of its n-grams are shared at all: 100 * shared >= threshold * size, which any link needs.
    3. Prefixes: with the n-grams of a class ordered by frequency, two linked classes share one of the first
       size - ceil(threshold * size / 100) + 1. Classes that share one form a candidate group (connected components).
    4. Groups are packed into blocks of bounded size; a larger group is cut by size of the sets, so that only sets of
       sizes that can link meet, and then into pairs of blocks. Each fragment of the n-gram order counts the overlaps of
       a block's pairs by itself; the partial counts are summed by pair, and each block returns a star of each chain of
       links, never all pairs.
    5. Connected components over the stars, then joined back to the documents.

    Nulls: a null or wordless text has n_shingles 0 and is its own component; a null doc_id is ignored for the minimum,
    and repeated doc_ids give repeated rows. Other columns are ignored. Nothing is capped.
    """
    out = similar_rows(docs, k, threshold)
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component)


def _blocks(members: DataFrame, threshold: int) -> DataFrame:
    """(g, pair, side, cls, n, tokens): the blocks of members(cls, n, g, tokens). A group that fits is put in a block with
    others. A larger one is cut into bands of sizes (linked sets are in one band or neighbours) and parts of a band, and
    each two parts of the same or neighbouring bands are one block, with side 0 and 1; a part by itself is one, too."""
    width = math.log(100 / threshold) * (1 + 1e-9) if threshold < 100 else 1.0
    members = members.withColumn("band", F.floor(F.log("n") / width).cast("int"))
    sizes = members.groupBy("g", "band").agg(F.count("*").alias("c"), F.sum(F.size("tokens")).alias("t"))
    whole = Window.partitionBy("g")
    many = (F.sum("c").over(whole) > BLOCK_DOCS) | (F.sum("t").over(whole) > BLOCK_TOKENS)
    order = whole.orderBy("band")
    beside = lambda f, step: F.coalesce(F.when(f("band").over(order) == F.col("band") + step, f("nb").over(order)), F.lit(0))
    sizes = sizes.withColumns({"many": many, "nb": F.greatest(F.ceil(F.col("t") / BLOCK_TOKENS), F.ceil(F.col("c") / BLOCK_DOCS)).cast("int")})
    sizes = materialize(sizes.withColumns({"up": beside(F.lead, 1), "down": beside(F.lag, -1)}), "sizes")
    all_small = sizes.where("NOT many").agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("c"), F.lit(0))).first()
    bins = int(max(all_small[0] // (BLOCK_TOKENS // 3), all_small[1] // (BLOCK_DOCS // 3)) + 1)
    placed = members.join(sizes.drop("c", "t"), ["g", "band"])
    small = placed.where("NOT many").select(F.pmod(F.xxhash64("g"), F.lit(bins)).alias("g"), F.lit("").alias("pair"), F.lit(0).alias("side"), "cls", "n", "tokens")
    own = placed.where("many").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("nb")).cast("int"))
    same = F.expr("transform(sequence(0, nb - 1), x -> named_struct('pair', concat_ws(':', band, least(own, x), band, greatest(own, x)), 'side', if(x < own, 1, 0)))")
    above = F.expr("CASE WHEN up > 0 THEN transform(sequence(0, up - 1), x -> named_struct('pair', concat_ws(':', band, own, band + 1, x), 'side', 0)) ELSE array() END")
    below = F.expr("CASE WHEN down > 0 THEN transform(sequence(0, down - 1), x -> named_struct('pair', concat_ws(':', band - 1, x, band, own), 'side', 1)) ELSE array() END")
    large = own.withColumn("p", F.explode(F.concat(same, above, below))).select(F.xxhash64("g").alias("g"), "p.pair", "p.side", "cls", "n", "tokens")
    return small.union(large)


def similar_rows(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, text_key, n, first) of every row of docs: first(no_id, doc_id, text_key) is the row that comes first in
    its component of similar_components, by doc_id, nulls last, then text_key; null if n is 0."""
    documents, grams = ngram_classes(docs, k)
    classes = grams.groupBy("cls", "n").agg(F.sum(F.size("grams")).alias("m"), F.sort_array(F.flatten(F.collect_list("grams"))).alias("grams")).where(F.col("m") * 100 >= threshold * F.col("n"))
    # n-grams of one class only stand before all others in the order, so they use up the prefix first.
    prefix = F.col("n") - F.expr(f"(n * {threshold} + 99) div 100") + 1 - (F.col("n") - F.col("m"))
    classes = materialize(classes.withColumn("p", prefix.cast("int")), "classes")
    heads = classes.where("p > 0").select("cls", F.explode(F.expr("slice(grams.token, 1, p)")).alias("token"))
    least = heads.groupBy(F.col("token").alias("u")).agg(F.min("cls").alias("m"), F.count("*").alias("c")).where("c > 1")
    total = classes.agg(F.coalesce(F.sum(F.greatest("p", F.lit(0))), F.lit(0))).first()[0]
    edges = to_least(heads, "token", least, total).where("cls != m").select("cls", "m").distinct()
    groups = connected_components(edges, "cls", "m").withColumnRenamed("node", "cls")
    members = materialize(classes.join(groups, "cls").select("cls", "n", F.col("component").alias("g"), F.col("grams.token").alias("tokens")), "members")
    cut = F.posexplode(F.expr(f"transform(sequence(0, {FRAGMENTS - 1}), f -> filter(tokens, t -> t div {2**TOKEN_BITS // FRAGMENTS} = f))")).alias("f", "tokens")
    partial = _blocks(members, threshold).select("g", "pair", "side", "cls", "n", cut).groupBy("g", "pair", "f").applyInArrow(_partial, _PARTIAL)
    stars = partial.groupBy("g", "pair").applyInArrow(_links(threshold), "a binary, b binary")
    linked = connected_components(stars, "a", "b").withColumnRenamed("node", "cls")
    by_class = documents.where("n > 0").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("least"), F.count("*").alias("c"))
    found = materialize(by_class.join(linked, "cls", "left").withColumn("component", F.coalesce("component", "cls")), "found")
    roots = found.groupBy(F.col("component").alias("u")).agg(F.min("least").alias("m"), F.count("*").alias("c"))
    n_classes, n_documents = found.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    to_root = to_least(found.withColumnRenamed("c", "copies"), "component", roots, n_classes).select(F.col("cls").alias("u"), "m", F.col("copies").alias("c"))
    known = to_least(documents.where("n > 0"), "cls", to_root, n_documents).select("doc_id", "text_key", "n", F.col("m").alias("first"))
    return known.unionByName(documents.where("n = 0").select("doc_id", "text_key", "n", F.lit(None).cast(known.schema["first"].dataType).alias("first")))
