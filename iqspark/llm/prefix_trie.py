"""Conversation prefix trie: tables of nodes by minimal perfect hashing, a shard at a time, whose sums Spark adds up."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .textkit import mix

#: Turns of a conversation that a shard holds together; longer conversations go on in other shards.
SEGMENT = 1024
#: Turns of a shard, about.
SHARD_ROWS = 200_000
#: Parents with more children than this, and than one in HOT_SHARE of all nodes, are joined by broadcast.
HOT_CHILDREN, HOT_SHARE = 1000, 10_000

ROOT = 0  # both halves of the digest of no turns
_U = np.uint64


class SlotTable:
    """A minimal perfect hash of distinct 128-bit keys: each level places the keys that meet no other one in a bit field
    of twice their number and leaves the rest to the next; a slot is the rank of its bit. Slots keep their keys, so a key
    that isn't in the table is told from those that are."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, self.a, self.b = [], np.zeros(len(a), _U), np.zeros(len(a), _U)
        left, taken = np.arange(len(a)), 0
        while len(left):
            if len(self.levels) > 200:
                raise ValueError("keys of a slot table repeat")
            at = self._places(a[left], b[left], len(self.levels), 2 * len(left))
            alone = np.bincount(at, minlength=2 * len(left))[at] == 1
            bits = np.zeros(2 * len(left), bool)
            bits[at[alone]] = True
            ranks = np.cumsum(bits) - 1 + taken
            placed = left[alone]
            self.a[ranks[at[alone]]], self.b[ranks[at[alone]]] = a[placed], b[placed]
            self.levels.append((bits, ranks))
            left, taken = left[~alone], taken + len(placed)

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(a + _U(level)) ^ b) % _U(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, verified by the key that the slot keeps; -1 for others."""
        found, left = np.full(len(a), -1), np.arange(len(a))
        for level, (bits, ranks) in enumerate(self.levels):
            at = self._places(a[left], b[left], level, len(bits))
            hit = bits[at]
            found[left[hit]] = ranks[at[hit]]
            left = left[~hit]
        known = found >= 0
        known[known] = (self.a[found[known]] == a[known]) & (self.b[found[known]] == b[known])
        return np.where(known, found, -1)


def up_the_tree(depth: np.ndarray, parent: np.ndarray, sums: list[np.ndarray], least: list[np.ndarray]) -> None:
    """Add each slot's sums to its parent's, and take minima, from the deepest slots upwards; parent -1 has none."""
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        level = level[parent[level] >= 0]
        for x in sums:
            np.add.at(x, parent[level], x[level])
        for x in least:
            np.minimum.at(x, parent[level], x[level])


# Spark: conversations in order, and rebuilt


def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part (the partition) and k (1, 2, ... within conv_id and partition) to rows sorted by conv_id."""
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        at = np.arange(len(ids))
        new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
        start = np.maximum.accumulate(np.where(new, at, -1))
        k = np.where(start >= 0, at - start + 1, at + 1 + n)
        last, n = ids[-1], int(k[-1])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("t"), batch.column("words"), pa.array(np.full(len(ids), part), pa.int32()), pa.array(k, pa.int64())], ["conv_id", "t", "words", "part", "k"])


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, part, k, t, words; ranges: conv_id, part, n, before). t is a digest of role and text. Rows are cut
    into ranges of conv_id and turn, so a conversation of any length is dealt to many tasks; k counts within a range, and
    before (known for at most one conversation of a range) says how many of its turns came in earlier ranges."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    t = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), t.alias("t"), words.alias("words"), F.monotonically_increasing_id().alias("row"))
    parts = max(conversations.sparkSession.sparkContext.defaultParallelism, -(-conversations.count() // SHARD_ROWS))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t"), F.col("row")]  # row: repeated rows are dealt out, too
    turns = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(number, "conv_id long, t binary, words long, part int, k long"), "turns")
    ranges = turns.groupBy("conv_id", "part").agg(F.max("k").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return turns, ranges.withColumn("before", before)


def rebuilt_turns(conversations: DataFrame, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(convs: conv_id, shard, total; turns: conv_id, shard, total, pos, seg, a, b, words) of rebuilt conversations.

    a and b are two 64-bit hashes of a turn and its place, whose exclusive or over the first turns is a prefix's digest.
    """
    turns, ranges = numbered_turns(conversations)
    lengths = ranges.groupBy("conv_id").agg(F.sum("n").alias("len"), F.min("part").alias("shard"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = lengths.withColumns({"base": F.col("conv_id") - F.col("conv_id") % block, "h": taken}).join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = materialize(convs.withColumn("total", F.col("m") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "convs")
    continued = F.broadcast(ranges.where("before > 0").select("conv_id", "part", "before"))
    placed = turns.join(continued, ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("before", F.lit(0))).alias("k"), "t", "words")
    first = placed.where(F.col("k") < most).select(F.col("conv_id").alias("base"), "k", "t", "words")
    heads = convs.where("m > 0").join(first, "base").where("k <= m").select("conv_id", "shard", "total", F.col("k").alias("pos"), "t", "words")
    # A conversation's facts meet its turns a segment at a time, so that a long one is no hot key.
    of = convs.select("conv_id", "shard", "total", "m", F.explode(F.expr(f"sequence(0L, len DIV {SEGMENT})")).alias("part_of"))
    own = placed.where(F.col("k") > taken).withColumn("part_of", F.expr(f"k DIV {SEGMENT}")).join(of, ["conv_id", "part_of"])
    own = own.select("conv_id", "shard", "total", (F.col("k") - taken + F.col("m")).alias("pos"), "t", "words")
    both = heads.unionByName(own).select("conv_id", "shard", "total", "pos", F.expr(f"(pos - 1) DIV {SEGMENT}").alias("seg"), F.xxhash64("t", "pos").alias("a"), F.xxhash64("pos", "t").alias("b"), "words")
    return convs.select("conv_id", "shard", "total"), materialize(both, "rebuilt")


def carried(turns: DataFrame) -> DataFrame:
    """(conv_id, shard, total, pos, seg, a, b): for each segment but the first of a long conversation, the digest of all
    turns before it."""
    sums = turns.where(F.col("total") > SEGMENT).groupBy("conv_id", "shard", "total", "seg").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    so_far = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sums.select("conv_id", "shard", "total", ((F.col("seg") + 1) * SEGMENT).alias("pos"), (F.col("seg") + 1).alias("seg"), F.bit_xor("a").over(so_far).alias("a"), F.bit_xor("b").over(so_far).alias("b"))
    return out.where("pos < total")


# Shards


NODES = "shard int, seg long, slot int, parent_slot int, a long, b long, parent_a long, parent_b long, depth long, turn_a long, words long, n long, first long, ends array<long>"


def node_table(table: pa.Table) -> pa.Table:
    """The nodes of a shard's segment, in the order of their slots: rows conv_id, total, pos, a, b, words of its
    conversations, each with a first row that stands for all turns before (the root itself in segment 0).

    n counts the shard's conversations below a node and first is the smallest of them; both are scattered to where a
    conversation leaves the segment and accumulated upwards. ends are the conversations that end at a node, ascending.
    """
    shard, seg = table["shard"][0].as_py(), table["seg"][0].as_py()
    conv, pos, total, words = (table[c].to_numpy().astype(np.int64) for c in ("conv_id", "pos", "total", "words"))
    order = np.lexsort((pos, conv))
    conv, pos, total, words = conv[order], pos[order], total[order], words[order]
    first_row = np.concatenate([[True], conv[1:] != conv[:-1]])
    last_row = np.concatenate([first_row[1:], [True]])
    starts = np.flatnonzero(first_row)
    own, digest = [], []
    for c in ("a", "b"):
        h = table[c].to_numpy().astype(np.int64)[order].view(_U)
        sums = np.bitwise_xor.accumulate(h)
        own.append(h)
        digest.append(sums ^ np.repeat(np.concatenate([np.zeros(1, _U), sums[starts[1:] - 1]]), np.diff(np.append(starts, len(conv)))))
    a, b = digest
    node = np.ones(len(conv), bool) if seg == 0 else ~first_row
    by = np.lexsort((b[node], a[node]))
    ka, kb = a[node][by], b[node][by]
    new = np.concatenate([[True], (ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])])
    slots = SlotTable(ka[new], kb[new])
    slot = np.full(len(conv), -1)
    slot[node] = slots.slots(a[node], b[node])
    n = int(new.sum())
    before = np.concatenate([[0], np.arange(len(conv) - 1)])
    rows = np.flatnonzero(node)
    facts = {"depth": pos, "parent_a": a[before].view(np.int64), "parent_b": b[before].view(np.int64), "turn_a": own[0].view(np.int64), "words": words, "parent_slot": np.where(first_row, -1, slot[before])}
    held = {}
    for name, x in facts.items():
        x = np.where(first_row & (name != "depth"), -1 if name == "parent_slot" else 0, x)
        held[name] = np.zeros(n, np.int64)
        held[name][slot[rows]] = x[rows]
        if (held[name][slot[rows]] != x[rows]).any():
            raise ValueError("two different prefixes have one digest")
    count = np.bincount(slot[last_row], minlength=n).astype(np.int64)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, slot[last_row], conv[last_row])
    up_the_tree(held["depth"], held["parent_slot"], [count], [least])
    ending = np.flatnonzero(node & (pos == total))
    ending = ending[np.lexsort((conv[ending], slot[ending]))]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(slot[ending], minlength=n))])
    ends = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(conv[ending]))
    root = (held["depth"] == 0) if n else np.zeros(0, bool)
    parents = [pa.array(held[c], mask=root) for c in ("parent_a", "parent_b")]
    columns = [pa.array(np.full(n, shard), pa.int32()), pa.array(np.full(n, seg)), pa.array(np.arange(n), pa.int32()), pa.array(held["parent_slot"], pa.int32()), pa.array(slots.a.view(np.int64)), pa.array(slots.b.view(np.int64)), *parents, pa.array(held["depth"]), pa.array(held["turn_a"]), pa.array(held["words"]), pa.array(count), pa.array(least), ends]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in NODES.split(", ")])


def subtree_sums(table: pa.Table) -> pa.Table:
    """(a, b, saved, leaves) of a shard's nodes: what is to be added at each, accumulated upwards. Rows without a slot
    are what later segments of a conversation add at the node where it goes on."""
    a, b = (table[c].to_numpy().astype(np.int64).view(_U) for c in ("a", "b"))
    slot = table["slot"].to_numpy()
    here = slot >= 0
    n = int(here.sum())
    at = slot[here].astype(np.int64)
    known = SlotTable(a[here], b[here])
    own_slot = known.slots(a[here], b[here])
    if len(np.unique(own_slot)) != n or (own_slot < 0).any():
        raise ValueError("slots of a shard repeat")
    to = np.full(n, -1)
    to[own_slot] = at  # a key's slot in this table, and the slot it got first
    depth, parent = np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth[at], parent[at] = table["depth"].to_numpy()[here], table["parent_slot"].to_numpy()[here]
    sums = []
    for c in ("saved", "leaves"):
        x, flat = table[c].to_numpy().astype(np.int64), np.zeros(n, np.int64)
        flat[at] = x[here]
        more = known.slots(a[~here], b[~here])
        if (more < 0).any():
            raise ValueError("a conversation goes on at a node that its shard doesn't have")
        np.add.at(flat, to[more], x[~here])
        sums.append(flat)
    up_the_tree(depth, parent, sums, [])
    return pa.table({"a": a[here].view(np.int64), "b": b[here].view(np.int64), "saved": sums[0][at], "leaves": sums[1][at]})


def ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ends_sha256) of rows sorted by node and shard: the lists of a node's shards go through one running hash."""
    key, sha = None, None
    out = []
    for batch in batches:
        for a, b, ends in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ends")), strict=True):
            if (a, b) != key:
                if sha:
                    out.append((*key, sha.hexdigest()))
                key, sha = (a, b), hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(map(str, ends)).encode())
        if len(out) >= 5000:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "ends_sha256"])
            out = []
    if sha:
        out.append((*key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["a", "b", "ends_sha256"])


def with_parent(nodes: DataFrame, total: int) -> DataFrame:
    """nodes and parent_first, the smallest member of their parent. Parents with many children (at most HOT_SHARE) meet
    them by broadcast, all others by shuffle."""
    many = F.col("n_children") > max(HOT_CHILDREN, total // HOT_SHARE)
    of = [F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("first").alias("parent_first")]
    on = ["parent_a", "parent_b"]
    hot = F.broadcast(nodes.where(many).select(*of).withColumn("hot", F.lit(True)))
    marked = nodes.join(hot, on, "left")
    return marked.where("hot").unionByName(marked.where("hot IS NULL").drop("parent_first").join(nodes.where(~many).select(*of), on, "left")).drop("hot")


def prefix_trie(conversations: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, as the contract names them.

    Rebuilt: the first h turns of conversation c - c % block (% keeps the sign), then c's own after its first h, where h is
    crc32(c) % most. A shard holds conversations of a range of ids, and of longer ones SEGMENT turns at a time. Its nodes
    get slots by minimal perfect hashing, counts are scattered to flat arrays and accumulated through parent slots; Spark
    adds up the shards by digest, where a node that a third of all conversations pass is one row for each shard. What is
    summed over subtrees goes to the shard of a node's smallest member, so each node counts once.

    Turns are ordered by turn, null first; equal ones by a digest of role and text, so that repeated rows are repeated
    turns. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out; a conversation
    whose turns all go is turnless and a member of the root. Other columns are not read. An empty table gives no rows.
    """
    convs, turns = rebuilt_turns(conversations, block, most)
    carry = materialize(carried(turns), "carried")
    zero = F.lit(ROOT).cast("long")
    roots = convs.select("conv_id", "shard", "total", zero.alias("pos"), zero.alias("seg"), zero.alias("a"), zero.alias("b"), zero.alias("words"))
    rows = turns.unionByName(roots).unionByName(carry.withColumn("words", zero))
    shards = materialize(rows.groupBy("shard", "seg").applyInArrow(node_table, NODES), "nodes")
    # Nodes of all shards.
    same = ["depth", "parent_a", "parent_b", "turn_a"]
    nodes = shards.groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("words").alias("words"), *[F.max(c).alias(c) for c in same], *[F.min(c).alias(f"{c}_") for c in same])
    clash = F.when(F.expr(" OR ".join(f"NOT {c} <=> {c}_" for c in same)), F.raise_error(F.lit("two different prefixes have one digest")).cast("long"))
    nodes = nodes.withColumn("depth", F.coalesce(clash, "depth")).select("a", "b", "parent_a", "parent_b", "depth", "n", "first", "words")
    children = nodes.where("depth > 0").groupBy(F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = materialize(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    # Sums over subtrees.
    mine = F.col("first") == F.col("node_first")
    facts = nodes.select("a", "b", F.col("first").alias("node_first"), ((F.col("n") - 1) * F.col("words")).alias("saves"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    each = shards.select("shard", "seg", "slot", "parent_slot", "depth", "a", "b", "first").join(facts, ["a", "b"])
    each = each.select("shard", "seg", "slot", "parent_slot", "depth", "a", "b", "first", F.when(mine, F.col("saves")).otherwise(0).alias("saved"), F.when(mine, F.col("leaf")).otherwise(0).alias("leaves"))
    each = materialize(each, "each")
    later = each.where("seg > 0 AND (saved > 0 OR leaves > 0)").groupBy(F.col("first").alias("conv_id"), "seg").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    rest = Window.partitionBy("conv_id").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = carry.join(later, ["conv_id", "seg"], "left").select("shard", (F.col("seg") - 1).alias("seg"), F.lit(-1).alias("slot"), F.lit(-1).alias("parent_slot"), zero.alias("depth"), "a", "b", *[F.coalesce(F.sum(c).over(rest), F.lit(0)).alias(c) for c in ("saved", "leaves")])
    sums = each.drop("first").unionByName(later).groupBy("shard", "seg").applyInArrow(subtree_sums, "a long, b long, saved long, leaves long")
    sums = sums.groupBy("a", "b").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = shards.where("size(ends) > 0").select("a", "b", "shard", "ends").repartition("a", "b").sortWithinPartitions("a", "b", "shard").mapInArrow(ends_digest, "a long, b long, ends_sha256 string")
    out = with_parent(nodes, nodes.count()).join(sums, ["a", "b"]).join(ends, ["a", "b"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(F.col("first").alias("conv_id"), "depth", F.col("parent_first").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
