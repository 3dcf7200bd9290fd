"""Exact dedup: radix tries of whole texts, in partitions by length and content hash, say which row owns each text."""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, few_files, materialize, small_batches
from .textkit import slices

#: White space that does not count: 0x20 and 0x09 to 0x0D.
SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of a task's trie; beyond them subtrees are spilled (or, before the shuffle, the trie is sent on and begun anew).
TRIE_BYTES = 48_000_000
#: Memory of a node besides its label.
NODE_BYTES = 300
#: Tasks that share the copies of a text from all map tasks, before one task gets what they have left.
FAN = 32
#: Classes of more rows than one in so many of all are joined by broadcast, however many classes there are.
HOT_SHARE = 10_000

KEYS = "doc_id long, n_chars long, n_bytes long, h long, sha binary"
TEXTS = "n_bytes long, h long, salt int, sha binary, n long, n_chars long, doc_id long, ties long, text binary"


class Owner:
    """What a terminal node holds: rows of its text, and of these the one with most characters, then with the smallest
    identifier (none counts as largest); ties: rows alike in both."""

    __slots__ = ("sha", "n", "n_chars", "doc_id", "ties")

    def __init__(self, sha: bytes, n: int, n_chars: int, doc_id: int | None, ties: int = 1):
        self.sha, self.n, self.n_chars, self.doc_id, self.ties = sha, n, n_chars, doc_id, ties

    def rank(self) -> tuple:
        return -self.n_chars, self.doc_id is None, self.doc_id or 0

    def merge(self, other: Owner) -> None:
        self.n += other.n
        mine, its = self.rank(), other.rank()
        if its < mine:
            self.n_chars, self.doc_id, self.ties = other.n_chars, other.doc_id, other.ties
        elif its == mine:
            self.ties += other.ties


class Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.children, self.owner = label, {}, owner


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class Trie:
    """Compressed radix trie of byte strings. When it holds more than most bytes, its largest subtree below the first
    fork goes to a temporary file, to which later strings of that subtree are added; owners() works through each such
    file by a trie of its own, which forks further down, so memory stays bounded but for a single string."""

    def __init__(self, most: int):
        self.root, self.most, self.size, self.spilled = Node(b""), most, 0, []

    def insert(self, text: bytes, owner: Owner) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = Node(text[at:], owner)
                self.size += len(text) - at + NODE_BYTES
                return
            if not isinstance(child, Node):
                pickle.dump((text[at:], owner), child)
                return
            if text.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            k = common(child.label, text[at : at + len(child.label)])
            fork = Node(child.label[:k])
            node.children[text[at]], child.label = fork, child.label[k:]
            fork.children[child.label[0]] = child
            self.size += NODE_BYTES
            node, at = fork, at + k
        if node.owner:
            node.owner.merge(owner)
        else:
            node.owner = owner

    def full(self) -> bool:
        return self.size > self.most

    def spill(self) -> None:
        fork = self.root
        while len(fork.children) == 1 and isinstance(below := next(iter(fork.children.values())), Node):
            fork = below
        weights = {k: sum(len(x.label) + NODE_BYTES for x, _ in walk(child, b"")) for k, child in fork.children.items() if isinstance(child, Node)}
        if len(fork.children) < 2 or not weights:
            self.most *= 2  # one long string, or files only: nothing to part
            return
        first = max(weights, key=weights.get)
        file = tempfile.TemporaryFile()
        for node, path in walk(fork.children[first], b""):
            if node.owner:
                pickle.dump((path, node.owner), file)
        fork.children[first] = file
        prefix = self.path_to(fork)
        self.spilled.append((prefix, file))
        self.size -= weights[first]

    def path_to(self, wanted: Node) -> bytes:
        """The string down to a node that no fork stands above."""
        node, path = self.root, b""
        while node is not wanted:
            node = next(iter(node.children.values()))
            path += node.label
        return path

    def owners(self) -> Iterator[tuple[bytes, Owner]]:
        """(text, owner) of every distinct text."""
        for node, path in walk(self.root, b""):
            if node.owner:
                yield path, node.owner
        self.root = Node(b"")
        for prefix, file in self.spilled:
            file.seek(0)
            part = Trie(self.most)
            while True:
                try:
                    text, owner = pickle.load(file)
                except EOFError:
                    break
                part.insert(text, owner)
                if part.full():
                    part.spill()
            file.close()
            for text, owner in part.owners():
                yield prefix + text, owner


def walk(top: Node, path: bytes) -> Iterator[tuple[Node, bytes]]:
    """Nodes in memory from top down, and the strings that lead to them."""
    stack = [(top, path + top.label)]
    while stack:
        node, path = stack.pop()
        yield node, path
        stack += [(x, path + x.label) for x in node.children.values() if isinstance(x, Node)]


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, n_chars, text without white space, its SHA-256) of rows doc_id, n_chars, text (binary)."""
    for batch in batches:
        for piece in slices(batch, "text"):
            for doc_id, n_chars, text in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "n_chars", "text")), strict=True):
                bare = text.translate(None, SPACE)
                yield doc_id, n_chars, bare, hashlib.sha256(bare).digest()


def content_hash(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "big", signed=True)


def packed(rows: Iterator[tuple], schema: str, most_rows: int = 5000, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; their last value may be a long binary."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [pa.field(*x.split()[:1], kinds[x.split()[1]]) for x in schema.split(", ")]
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 8
        if len(held) >= most_rows or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=pa.schema(fields))
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=pa.schema(fields))


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return packed(((d, c, len(b), content_hash(s), s) for d, c, b, s in keyed(batches)), KEYS)


def local_owners(most: int) -> Callable:
    """One row for each distinct text of a task, or of as much of it as a trie holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = TaskContext.get().partitionId() % FAN

        def rows() -> Iterator[tuple]:
            trie = Trie(most)
            for doc_id, n_chars, bare, sha in keyed(batches):
                trie.insert(bare, Owner(sha, 1, n_chars, doc_id))
                if trie.full():
                    yield from out(trie)
                    trie = Trie(most)
            yield from out(trie)

        def out(trie: Trie) -> Iterator[tuple]:
            return ((len(t), content_hash(o.sha), salt, o.sha, o.n, o.n_chars, o.doc_id, o.ties, t) for t, o in trie.owners())

        return packed(rows(), TEXTS)

    return run


def merged_owners(most: int, with_text: bool) -> Callable:
    """One row for each distinct text of a partition, which meets all rows of its texts that have its salts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(most)
        for batch in batches:
            for piece in slices(batch, "text"):
                for text, *owner in zip(*(piece.column(c).to_pylist() for c in ("text", "sha", "n", "n_chars", "doc_id", "ties")), strict=True):
                    trie.insert(text, Owner(*owner))
                    if trie.full():
                        trie.spill()
        rows = ((len(t), content_hash(o.sha), 0, o.sha, o.n, o.n_chars, o.doc_id, o.ties, t if with_text else b"") for t, o in trie.owners())
        return packed(rows, TEXTS)

    return run


def copy_classes(docs: DataFrame, keys: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(n_bytes, sha, n, owner_chars, owner, ties) of each text that more than one row of docs has.

    keys (of keys_of) says which lengths and content hashes more than one row has; only texts of these are moved. Each
    map task sends a text once (a trie before the shuffle), FAN tasks share the copies of a text from all map tasks, and
    one task gets what they have left, so no task's input grows with a group of copies.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).cast("long").alias("n_chars"), text_of().cast("binary").alias("text"))
    shared = bounded(few_files(keys.groupBy("n_bytes", "h").count().where("count > 1").select("n_bytes", "h")), "shared")
    texts = rows.mapInArrow(local_owners(trie_bytes), TEXTS).join(shared, ["n_bytes", "h"], "left_semi").select(*[x.split()[0] for x in TEXTS.split(", ")])
    first = texts.repartition("n_bytes", "h", "salt").mapInArrow(merged_owners(trie_bytes, True), TEXTS)
    last = first.repartition("n_bytes", "h").mapInArrow(merged_owners(trie_bytes, False), TEXTS)
    return last.where("n > 1").select("n_bytes", "sha", "n", F.col("n_chars").alias("owner_chars"), F.col("doc_id").alias("owner"), "ties")


def text_of() -> F.Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def with_class(keys: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """keys and, where there is one, their class: by broadcast if classes are few; else those of the largest classes (at
    most HOT_SHARE) by broadcast, all others by shuffle."""
    classes = bounded(few_files(classes), "classes")
    on = ["n_bytes", "sha"]
    if classes.count() <= 500_000:
        return keys.join(classes, on, "left")
    large = F.col("n") > max(1000, total // HOT_SHARE)
    hot = F.broadcast(classes.where(large))
    return keys.join(hot, on).unionByName(keys.join(hot, on, "left_anti").join(classes.where(~large), on, "left"))


def exact_copies(docs: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each of docs(doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 (of the text without white
    space), n_bytes (its length).

    Texts are equal when they are the same bytes without white space (0x20, 0x09-0x0D), as the tries compare them byte by
    byte; broken UTF-8 counts as the bytes it is. The row with most characters stays, then the smallest doc_id; a null
    doc_id comes after all others; of rows alike in both, any one stays (their results differ in kept only). Null texts
    are empty, and empty texts are equal. Other columns of docs are not read. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).cast("long").alias("n_chars"), text_of().cast("binary").alias("text"))
    keys = materialize(rows.mapInArrow(keys_of, KEYS).withColumn("row", F.monotonically_increasing_id()), "keys")
    found = with_class(keys, copy_classes(docs, keys, trie_bytes), keys.count())
    owns = F.col("n").isNull() | (F.col("doc_id").eqNullSafe(F.col("owner")) & (F.col("n_chars") == F.col("owner_chars")))
    found = found.withColumn("owns", owns)
    ties = bounded(few_files(found.where("owns AND ties > 1").groupBy("n_bytes", "sha").agg(F.min("row").alias("first"))), "ties")
    out = found.join(ties, ["n_bytes", "sha"], "left")
    return out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("owner")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.expr("owns AND (first IS NULL OR row = first)").alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "n_bytes")
