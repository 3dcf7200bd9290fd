"""Token ids in a content-addressed store of chunks, recipes and Merkle manifests."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, new_path
from .textkit import Words, mix, slices, words

_U = np.uint64
#: Chunks end where a rolling hash of the last WINDOW ids ends in MEAN_BITS zero bits, or after MOST ids.
WINDOW, MEAN_BITS, MOST = 8, 8, 8192
#: Runs that a worker remembers (2 ** CACHE_BITS places of about 30 bytes), and the most ids and bytes of one that it does.
CACHE_BITS, CACHE_IDS, CACHE_BYTES = 20, 8, 64
#: Texts on which a tokenizer must give the ids of their runs one after another, and the same ids in lower case.
_PROBES = ["It's A b,c d.E  f\n\ng\th", "Ünïcode É é \u0301x ΣΑΣ ς", "don't we'll 42nd 北京 a\x1cb \u00a0c", " Lead and trail. \r\n", "(a) [B] {c}! --- 3.14, 1,000 x_y #tag @Me?", "éa, Éb. ßc; straße: ñ!"]
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in ".,|;:!?*#$%&"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
# Letters whose lower case and byte form need no normaliser, or marks alone.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[.,|;:!?*#$%&]+")
_tokenizers: dict[str, Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The public byte-to-letter rule of byte-level BPE: printable bytes stand for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Whole texts to ids with a tokenizer file.

    If a text's ids are those of its runs between ASCII white space in turn, whatever the case of A-Z (checked on loading
    with _PROBES), each distinct run of a piece is encoded once (marks at its end by themselves), and a cache of fixed
    size keeps runs from piece to piece: a run's place is given by its hash, a later run takes the place of an earlier
    one, and 96 bits of hash tell runs apart. Other tokenizers encode each text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        letters = _byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(128, 256)}
        self.direct = all(self._direct(x) == self._whole(x) for p in _PROBES for x in p.split() if _PLAIN.fullmatch(x))
        runs = [_split(p) for p in _PROBES]
        self.separable = all(self._whole(p) == self._whole(_lower(p)) == [i for x in r for i in self._whole(x)] for p, r in zip(_PROBES, runs, strict=True))
        size = 1 << CACHE_BITS if self.separable else 0
        self.key, self.check, self.sizes, self.ids = np.zeros(size, _U), np.zeros(size, np.uint32), np.zeros(size, np.uint8), np.zeros((size, CACHE_IDS), self.wide)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _direct(self, word: str) -> list[int]:
        """One run of letters or of marks, by the tokenizer's model."""
        word = word.lower()
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.table))]

    def _runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs, one after another, and how many each has."""
        got = [self._direct(x) if self.direct and _PLAIN.fullmatch(x) else self._whole(x) for x in runs]
        return np.fromiter((i for x in got for i in x), self.wide), np.array([len(x) for x in got], np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with end_id after it, and how many each text has; a null text is empty."""
        if not self.separable:
            each = [[*self._whole(t or ""), end_id] for t in texts.to_pylist()]
            return np.array([i for x in each for i in x], self.wide), np.array([len(x) for x in each], np.int64)
        w = _without_ends(words(texts))
        h, check, size = w.hashes(), w.checks(), w.end - w.start
        place = (h >> _U(64 - CACHE_BITS)).astype(np.int64)
        n = self.sizes[place].astype(np.int64)
        hit = (self.key[place] == h) & (self.check[place] == check) & (n > 0)
        # Long runs, which no cache keeps, and those that may hold special tokens, which have a case, go each by itself.
        own = size > CACHE_BYTES
        special = np.flatnonzero((w.data[:-1] == 0x3C) & (w.data[1:] == 0x7C))
        if len(special):
            own[np.searchsorted(w.start, special, "right") - 1] = True
            hit &= ~own
        new = np.flatnonzero(~hit)
        alone = own[new]
        shared, single = new[~alone], new[alone]
        _, first, inverse = np.unique(h[shared] ^ check[shared].astype(_U) * _U(0x9E3779B97F4A7C15), return_index=True, return_inverse=True)
        at = np.concatenate([shared[first], single])
        ids, counts = self._runs([bytes(w.data[a:b]).decode(errors="replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)])
        begins = np.cumsum(counts) - counts
        source = place * CACHE_IDS
        which = np.concatenate([inverse, len(first) + np.arange(len(single))])
        order = np.concatenate([shared, single])
        n[order], source[order] = counts[which], begins[which]
        per_text = np.bincount(w.doc, n, minlength=w.n_docs).astype(np.int64) + 1
        target = np.cumsum(n) - n + w.doc  # one end_id for each text before
        out = np.full(int(per_text.sum()), end_id, self.wide)
        for mine, flat in ((hit, self.ids.reshape(-1)), (~hit, ids)):
            k, to = n[mine], target[mine]
            step = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(to, k) + step] = flat[np.repeat(source[mine], k) + step]
        few = np.flatnonzero((counts[: len(first)] <= CACHE_IDS) & (counts[: len(first)] > 0))
        few = few[np.unique(place[at[few]], return_index=True)[1]]
        if len(few):
            kept, columns = place[at[few]], np.arange(CACHE_IDS)
            self.key[kept], self.check[kept], self.sizes[kept] = h[at[few]], check[at[few]], counts[few]
            self.ids[kept] = ids[np.minimum(begins[few][:, None] + columns, len(ids) - 1)]
        return out, per_text


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def _split(text: str) -> list[str]:
    w = _without_ends(words(pa.array([text])))
    return [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)]


def _without_ends(w: Words) -> Words:
    """Words, with the marks at the end of one that has a letter or number before them as a word of their own."""
    if not len(w.start):
        return w
    n = len(w.data)
    last = np.maximum.accumulate(np.where(_MARKS[w.data], 0, np.arange(1, n + 1)))[w.end - 1]  # end of what is before the marks
    before = w.data[np.maximum(last - 1, 0)]
    second = (w.data[np.maximum(last - 2, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
    cut = (last > w.start) & (last < w.end) & (_ALNUM[before] | second)
    opens, closes = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    opens[w.start] = closes[w.end] = True
    opens[last[cut]] = closes[last[cut]] = True
    doc = np.repeat(w.doc, 1 + cut)
    return Words(w.data, np.flatnonzero(opens), np.flatnonzero(closes), doc, np.searchsorted(doc, np.arange(w.n_docs + 1)), w.n_docs)


def encoder(path: str) -> Encoder:
    if path not in _tokenizers:
        _tokenizers[path] = Encoder(path)
    return _tokenizers[path]


def cut_points(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of the chunks of id streams that stand one after another in ids: places that depend on the last WINDOW ids
    of their own stream only, so copies cut alike."""
    h = mix(ids.astype(_U) + _U(1))
    closes = np.cumsum(lengths)
    place = np.arange(len(ids)) - np.repeat(closes - lengths, lengths)
    roll = h.copy()
    for i in range(1, WINDOW):
        roll[i:] += (h[:-i] << _U(i)) * (place[i:] >= i)
    ends = np.union1d(np.flatnonzero((mix(roll) & _U((1 << MEAN_BITS) - 1)) == 0) + 1, closes[lengths > 0])
    gaps = np.diff(np.concatenate([[0], ends]))
    if len(gaps) and gaps.max() > MOST:
        ends = np.unique(np.concatenate([np.arange(a + MOST, b, MOST) for a, b in zip(ends - gaps, ends, strict=True) if b - a > MOST] + [ends]))
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over leaves; an odd last node moves up unchanged; no leaves: the hash of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


_ROWS = "kind int, key binary, doc_id long, copies long, n_tokens long, lens array<int>, body binary"


def _encode(path: str, end_id: int):
    """Per document a recipe row (kind 0: body has the addresses of its chunks, key its Merkle root); per chunk not yet
    seen in the batch a chunk row (kind 1: body has its ids)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            seen: set[bytes] = set()
            for piece in slices(batch, "text"):
                rows: list[tuple] = []
                ids, lengths = enc.encode(piece.column("text"), end_id)
                whole, width = ids.tobytes(), ids.itemsize
                ends = cut_points(ids, lengths)
                starts = np.concatenate([[0], ends[:-1]])
                sizes = (ends - starts).tolist()
                first = np.searchsorted(ends, np.concatenate([[0], np.cumsum(lengths)]), "right").tolist()
                addresses = []
                for a, n in zip((starts * width).tolist(), sizes, strict=True):
                    body = whole[a : a + n * width]
                    addresses.append(_address(body))
                    if addresses[-1] not in seen:
                        seen.add(addresses[-1])
                        rows.append((1, addresses[-1], None, None, n, None, body))
                for k, doc_id in enumerate(piece.column("doc_id").to_pylist()):
                    own = addresses[first[k] : first[k + 1]]
                    rows.append((0, merkle(own), doc_id, 1, int(lengths[k]), sizes[first[k] : first[k + 1]], b"".join(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return encoded


_TYPES = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary()]
_NAMES = ["kind", "key", "doc_id", "copies", "n_tokens", "lens", "body"]


def write_store(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 1) -> None:
    """Write docs(doc_id, text) as a store under out:

    chunks/    address (blake2b of the ids), n, ids (little-endian, 2 or 4 bytes an id): each chunk once
    recipes/   ascending doc_id: doc_id, start, n_tokens, lens and addresses of its chunks, root (Merkle)
    manifest/  for each range of doc_ids in order: first and last doc_id, documents, tokens, Merkle root (over the roots
               of every LEAVES recipes in turn)

    A null text is empty and has the end id only; null doc_ids come first; rows that repeat a doc_id are stored each, in
    the order of their roots. Ids move in one shuffle, by address, where chunks that several tasks found become one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_encode(tokenizer_path, end_id), _ROWS)
    # A recipe's key is its doc_id and root; equal rows are counted, then given back by copies.
    name = F.when(F.col("kind") == 1, F.col("key")).otherwise(F.concat(F.col("key"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")))
    rows = rows.groupBy("kind", name.alias("name")).agg(*[F.first(c).alias(c) for c in ("key", "doc_id", "n_tokens", "lens", "body")], F.sum("copies").alias("copies"))
    rows.drop("name").write.option("compression", "zstd").partitionBy("kind").parquet(f"{out}/parts")
    schema = "key binary, doc_id long, n_tokens long, lens array<int>, body binary, copies long, kind int"
    parts = spark.read.schema(schema).parquet(f"{out}/parts")
    recipes = parts.where("kind = 0").withColumn("copy", F.explode(F.expr("sequence(1L, copies)")))
    # Ranges are cut within equal doc_ids (nulls, too) as well, by root.
    wanted = -(-(parts.where("kind = 0").agg(F.sum("copies")).first()[0] or 0) // SHARD_RECIPES)
    number = [wanted] if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    ranged = recipes.repartitionByRange(*number, "doc_id", "key", "copy").sortWithinPartitions("doc_id", "key", "copy").withColumn("shard", F.spark_partition_id())
    ranged.select("shard", "doc_id", "n_tokens", "lens", F.col("body").alias("addresses"), F.col("key").alias("root"), "copy").write.option("compression", "zstd").parquet(f"{out}/recipes")
    stored = spark.read.parquet(f"{out}/recipes")
    totals = stored.groupBy("shard").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    roots = _shard_roots(stored)
    # One row for each shard, which has about SHARD_RECIPES recipes if there are many: a window over them is small.
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals.join(roots, "shard").withColumn("start", before).write.parquet(f"{out}/manifest")


#: Recipes of a shard whose roots make one leaf of its Merkle root, and recipes of a shard, about, if there are many.
LEAVES, SHARD_RECIPES = 4096, 1_000_000


def _shard_roots(recipes: DataFrame) -> DataFrame:
    """(shard, root) of recipes(shard, doc_id, root, copy): Merkle over LEAVES roots at a time, then over those, so that
    no task holds a shard's roots at once."""
    place = F.row_number().over(Window.partitionBy("shard").orderBy("doc_id", "root", "copy")) - 1
    leaves = recipes.select("shard", "root", place.alias("at")).withColumn("block", F.floor(F.col("at") / LEAVES).cast("int"))

    def rooted(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table({"shard": t.column("shard")[:1], "at": t.column("block")[:1], "root": pa.array([merkle(t.column("root").to_pylist())], pa.binary())})

    blocks = leaves.groupBy("shard", "block").applyInArrow(rooted, "shard int, at int, root binary")
    return blocks.withColumn("block", F.lit(0)).groupBy("shard").applyInArrow(rooted, "shard int, at int, root binary").drop("at")


def _check_recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes without their lists; right: the addresses give the root, and their lengths are as many and sum up to n_tokens."""
    for b in batches:
        right = []
        for addresses, lens, root, n in zip(*(b.column(c).to_pylist() for c in ("addresses", "lens", "root", "n_tokens")), strict=True):
            whole = addresses is not None and lens is not None and len(addresses) % 16 == 0 and len(lens) * 16 == len(addresses)
            right.append(whole and merkle([addresses[i : i + 16] for i in range(0, len(addresses), 16)]) == root and sum(lens) == n)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "doc_id", "root", "copy", "n_tokens")), pa.array(right, pa.bool_())], ["shard", "doc_id", "root", "copy", "n_tokens", "right"])


def _shards(recipes: DataFrame, manifest: DataFrame) -> DataFrame:
    """(shard, base, whole) of every shard of recipes: whole if its root, documents, tokens, first and last doc_id are
    those of the manifest and it starts where the tokens of the shards before end. Raises if documents are missing."""
    totals = recipes.groupBy("shard").agg(F.min("doc_id").alias("f"), F.max("doc_id").alias("l"), F.count("*").alias("d"), F.sum("n_tokens").alias("t"))
    roots = _shard_roots(recipes).withColumnRenamed("root", "r")
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stated = manifest.withColumn("before", before)
    whole = F.expr("root <=> r AND documents <=> d AND tokens <=> t AND first_doc <=> f AND last_doc <=> l AND start <=> before")
    state = totals.join(roots, "shard").join(stated, "shard", "full").select("shard", F.col("start").alias("base"), whole.alias("whole"), (F.col("documents") - F.coalesce("d", F.lit(0))).alias("missing"))
    state = materialize(state, "shards")
    missing = state.where("missing > 0").agg(F.sum("missing"), F.count("*"), F.min("shard")).first()
    if missing[1]:
        raise ValueError(f"the store lacks {missing[0]} documents of its manifest, in {missing[1]} shards from shard {missing[2]} on")
    return state.drop("missing")


def _read_chunks(width: int):
    """Address, whether the stored ids still give it, their number and crc32 as 32-bit ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = {2: np.uint16, 4: np.uint32}[width]
        for b in batches:
            keys, bodies = b.column("key").to_pylist(), b.column("body").to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes()) for x in bodies]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([_address(x) == k for k, x in zip(keys, bodies, strict=True)], pa.bool_()), pa.array([len(x) // width for x in bodies], pa.int64()), pa.array(crc, pa.int64())], ["key", "sound", "n", "crc"])

    return read


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    out = np.zeros_like(vector)
    for i in range(32):
        out ^= np.where((vector >> np.uint32(i)) & np.uint32(1), matrix[i], np.uint32(0))
    return out


def _zero_matrices() -> list[np.ndarray]:
    """Matrix k moves a crc32 past 2**k zero bytes (polynomial arithmetic over GF(2))."""
    one = np.array([0xEDB88320, *[1 << i for i in range(31)]], np.uint32)  # one zero bit
    for _ in range(3):
        one = _times(one, one)
    out = [one]
    for _ in range(40):
        out.append(_times(out[-1], out[-1]))
    return out


_MATRICES = _zero_matrices()


def crc_shifted(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What crc32 values become when n_bytes zero bytes follow; crc(a + b) = crc_shifted(crc(a), len(b)) ^ crc(b)."""
    out, n = crc.astype(np.uint32), n_bytes.astype(np.int64).copy()
    for matrix in _MATRICES:
        if not n.any():
            break
        out = np.where(n & 1, _times(matrix, out), out)
        n >>= 1
    return out


def read_store(spark: SparkSession, out: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) of every document, from the files of a store.

    Chunk files are read whole: each chunk's ids are hashed against its address and summed up as a crc32. Recipes then
    join on addresses only, and crc32 values of chunks combine to those of documents: ids never move again. verified:
    all chunks are there, sound and as long as the recipe says; the recipe's addresses in their order give its root; and
    the roots, ids and counts of its shard are those of the manifest. Raises if documents of the manifest are missing.
    """
    schema = "key binary, doc_id long, n_tokens long, lens array<int>, body binary, copies long, kind int"
    chunks = spark.read.schema(schema).parquet(f"{out}/parts").where("kind = 1").select("key", "body").mapInArrow(_read_chunks(width), "key binary, sound boolean, n long, crc long")
    recipes, manifest = spark.read.parquet(f"{out}/recipes"), spark.read.parquet(f"{out}/manifest")
    order = Window.partitionBy("shard").orderBy("doc_id", "root", "copy")
    running = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1))
    checked = recipes.select("shard", "doc_id", "root", "copy", "n_tokens", "lens", "addresses").mapInArrow(_check_recipes, "shard int, doc_id long, root binary, copy long, n_tokens long, right boolean")
    starts = checked.withColumn("within", F.coalesce(running, F.lit(0)))
    kept = (F.col("right") & F.coalesce("whole", F.lit(False))).alias("kept")
    starts = starts.join(_shards(recipes, manifest), "shard", "left").select("doc_id", "root", "copy", "n_tokens", (F.col("base") + F.col("within")).alias("start"), kept)
    one = recipes.where("copy = 1")
    uses = one.select("doc_id", "root", F.posexplode(F.expr("transform(lens, (n, i) -> struct(substring(addresses, i * 16 + 1, 16) AS key, n AS len))")).alias("at", "u"))
    uses = uses.select("doc_id", "root", "at", "u.key", F.col("u.len").cast("long").alias("len"))
    after = F.sum("len").over(Window.partitionBy("doc_id", "root").orderBy("at").rowsBetween(1, Window.unboundedFollowing))
    uses = uses.withColumn("after", F.coalesce(after, F.lit(0)))
    shifted = F.pandas_udf(lambda crc, n: pd.Series(crc_shifted(crc.to_numpy(), n.to_numpy() * 4).astype(np.int64)), "long")
    found = uses.join(chunks, "key", "left").withColumn("moved", shifted(F.coalesce("crc", F.lit(0)), "after"))
    good = F.bool_and(F.coalesce(F.col("sound") & (F.col("n") == F.col("len")), F.lit(False)))
    docs = found.groupBy("doc_id", "root").agg(F.bit_xor("moved").alias("ids_crc32"), good.alias("verified"))
    joined = starts.join(docs, starts.doc_id.eqNullSafe(docs.doc_id) & (starts.root == docs.root), "left").select(starts.doc_id, "start", "n_tokens", "ids_crc32", (F.col("kept") & F.coalesce("verified", F.lit(False))).alias("verified"))
    return joined


def reconstruct(spark: SparkSession, out: str, width: int = 2) -> DataFrame:
    """(doc_id, copy, ids array<int>) rebuilt from recipes and chunks, for readers that need the ids themselves."""
    recipes = spark.read.parquet(f"{out}/recipes")
    chunks = spark.read.parquet(f"{out}/parts").where("kind = 1").select("key", F.col("body").alias("ids"))
    uses = recipes.select("doc_id", "root", "copy", F.posexplode(F.expr("transform(sequence(0, length(addresses) div 16 - 1), i -> substring(addresses, i * 16 + 1, 16))")).alias("at", "key"))

    def rebuilt(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), {2: np.uint16, 4: np.uint32}[width]).astype(np.int32)
        return pa.table({"doc_id": t.column("doc_id")[:1], "copy": t.column("copy")[:1], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return uses.join(chunks, "key").groupBy("doc_id", "root", "copy").applyInArrow(rebuilt, "doc_id long, copy long, ids array<int>")


def token_store(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """Write docs to a new store in the shared folder and read it back: see write_store and read_store."""
    out = new_path(docs.sparkSession, "store")
    write_store(docs, tokenizer_path, out, end_id)
    return read_store(docs.sparkSession, out, np.dtype(encoder(tokenizer_path).wide).itemsize)
