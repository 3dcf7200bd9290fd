"""Benchmark decontamination by template canonicalisation and slot consistency."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, materialize, text_key
from .textkit import mix, slices, windows, words

_U = np.uint64
#: Words of a window, windows that reach the driver for the membership filter at most.
WINDOW, MOST_BROADCAST = 8, 2_000_000
_WHOLE = -(1 << 62)  # the place of whole pairs
#: Units that become placeholders: fixed values.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs hours minutes seconds days weeks years usd eur dollars euros percent % kb mb gb tb hz khz mhz ghz mph kmh".split()
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in "\"'()[]{}<>.,;:!?|*#$&%"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_NUM, _NAME, _UNIT = (_U(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))


def _unit_hashes() -> np.ndarray:
    return np.sort(words(pa.array([" ".join(UNITS)])).hashes())


def _trimmed(texts: pa.Array):
    """Words of texts, and the same without marks at both ends, as far as a word has other bytes."""
    w = words(texts)
    other = np.flatnonzero(~_EDGE[w.data])
    if not len(w.start) or not len(other):
        return w, w
    low, high = np.searchsorted(other, w.start), np.searchsorted(other, w.end)
    has = high > low  # a word of marks only stays as it is
    start = np.where(has, other[np.minimum(low, len(other) - 1)], w.start)
    end = np.where(has, other[np.maximum(high - 1, 0)] + 1, w.end)
    return w, type(w)(w.data, start, end, w.doc, w.first, w.n_docs)


def _folded(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """texts, and texts in Unicode lower case: word k of the one is word k of the other. Broken bytes are replaced in both."""
    texts = texts.cast(pa.large_string())
    try:
        lower = pa.compute.utf8_lower(texts)
    except pa.ArrowInvalid:
        raw = texts.cast(pa.large_binary()).to_pylist()
        texts = pa.array([None if x is None else x.decode(errors="replace") for x in raw], pa.large_string())
        lower = pa.compute.utf8_lower(texts)
    # Letters whose capitals have another lower case.
    for letter, plain in (("ß", "ss"), ("ς", "σ")):
        lower = pa.compute.replace_substring(lower, letter, plain)
    return texts, lower


def templates(texts: pa.Array):
    """Words of texts, the template's hash of each, the hash of what a placeholder stands for (0: no placeholder), the
    hashes of words where names are words too, and those of plain words.

    Marks at both ends of a word are left out and capitals folded (Unicode). Words that have digits are numbers, those of
    UNITS after a number are units, and words that begin with a capital are names unless they begin a text, line or
    sentence.
    """
    texts, lower = _folded(texts)
    w, cut = _trimmed(texts)
    start, end = cut.start, cut.end
    plain = _trimmed(lower)[1]
    h = plain.hashes()
    if not len(h):
        return w, h, h, h, h
    digits = np.concatenate([[0], np.cumsum(_DIGIT[w.data])])
    number = digits[end] > digits[start]
    # A word begins with a capital if its first character has another lower case.
    head = w.data[start]
    letter = 1 + (head >= 0xC0).astype(np.int64) + (head >= 0xE0) + (head >= 0xF0)
    capital = np.zeros(len(h), bool)
    for i in range(4):
        capital |= (i < letter) & (w.data[np.minimum(start + i, len(w.data) - 1)] != plain.data[np.minimum(plain.start + i, len(plain.data) - 1)])
    second = w.data[np.minimum(start + 1, len(w.data) - 1)]
    capital &= ~((head == 0xC3) & (second == 0x9F)) & ~((head == 0xCF) & (second == 0x82))  # ß and ς are small
    begins = np.ones(len(h), bool)
    same = w.doc[1:] == w.doc[:-1]
    stop = np.isin(w.data[w.end[:-1] - 1], [ord(c) for c in ".?!:"])
    lines = np.concatenate([[0], np.cumsum(w.data == 10)])
    begins[1:] = ~same | stop | (lines[w.start[1:]] > lines[w.end[:-1]])
    name = capital & ~begins & ~number
    units = _unit_hashes()
    unit = units[np.minimum(np.searchsorted(units, h), len(units) - 1)] == h
    unit[1:] &= number[:-1] & same
    unit[0] = False
    template, slot, nameless = h.copy(), np.zeros(len(h), _U), h.copy()
    for kind, where in ((_NUM, number), (_UNIT, unit & ~number), (_NAME, name)):
        template[where] = kind
        slot[where] = h[where] | _U(1)
    nameless[number], nameless[unit & ~number] = _NUM, _UNIT
    return w, template, slot, nameless, h


def _window_rows(keep: np.ndarray | None, lengths: list[int] | None = None):
    """Rows (id, text_key, h, at, n, slots) of each window of template words, and once more with names as words if it has
    any; only those with a hash in keep, if given. slots: the hashes of what the window's placeholders stand for, in turn.
    A window of placeholders only has their values in its hash, as numbers and names stand together in many texts.
    Texts of under WINDOW words have their plain words as one window; lengths, if given: windows of so many plain words
    are looked for in every text, too."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                w, template, slot, nameless, plain = templates(piece.column("text"))
                count = np.diff(w.first)
                at, h = windows(template, w, WINDOW)
                other = windows(nameless, w, WINDOW)[1]
                named = np.flatnonzero(other != h)
                values = np.where((nameless == _NUM) | (nameless == _UNIT), slot, _U(0))
                found = [(WINDOW, at, _with_values(h, slot, w, at), slot), (WINDOW, at[named], _with_values(other, values, w, at)[named], values)]
                for n in range(1, WINDOW) if lengths is None else lengths:
                    begin, whole = windows(plain, w, n)
                    if lengths is None:
                        mine = count[w.doc[begin]] == n
                        begin, whole = begin[mine], whole[mine]
                    found.append((n, begin, mix(whole + _U(n)), np.zeros(len(plain), _U)))
                for n, at, h, values in found:
                    if keep is not None:
                        known = keep[np.minimum(np.searchsorted(keep, h), len(keep) - 1)] == h if len(keep) else np.zeros(len(h), bool)
                        at, h = at[known], h[known]
                    doc = w.doc[at]
                    ids, keys = (piece.column(c).take(pa.array(doc)) for c in ("id", "text_key"))
                    each = values[at[:, None] + np.arange(n)] if len(at) else np.zeros((0, n), _U)
                    listed = pa.array([x[x > 0].view(np.int64) for x in each], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, keys, pa.array(h.view(np.int64)), pa.array(at - w.first[doc], pa.int64()), pa.array(count[doc], pa.int64()), listed], ["id", "text_key", "h", "at", "n", "slots"])

    return rows


def _with_values(h: np.ndarray, slot: np.ndarray, w, at: np.ndarray) -> np.ndarray:
    """Hashes of windows, with those of their values where all words are placeholders."""
    filled = np.concatenate([[0], np.cumsum(slot > 0)])
    only = filled[at + WINDOW] - filled[at] == WINDOW if len(at) else np.zeros(0, bool)
    return np.where(only, mix(h + windows(slot, w, WINDOW)[1]), h)


_ROWS = "id long, text_key long, h long, at long, n long, slots array<long>"


def template_matches(docs: DataFrame, benchmark: DataFrame, min_windows: int = 3, min_share: float = 0.3) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, reparameterised, text_key): items whose template a document has.

    Windows of WINDOW template words are hash-joined, and those that have names a second time with the names as words, so
    that copies in capitals, where no name stands out, are found (new names in such a copy are not). A window counts if
    its slots agree: a value of the item always meets the same value in the document and the reverse, over one occurrence
    (the commonest partner of each value is taken, of equal ones the value itself; windows against it don't count). An
    occurrence is a match with min_windows such windows (or all, if the item has fewer) that are min_share of the item's.

    Occurrences are told apart by where they would begin, place in the document less place in the item, in ranges of half
    an item that overlap by half, so that words put in or left out don't part an occurrence and two copies never share
    one; the whole pair counts as one more. windows is that of the best; reparameterised: some slot's value differs in
    one of the matches.

    An item of under WINDOW words is one window of plain words: it is found where it stands word for word. Null and empty
    texts match nothing. A document is a doc_id (or none) with a text,
    named by text_key, so rows that share an id are judged each.
    Copies of items (equal templates) match each. The windows of the benchmark reach tasks as a sorted list of hashes
    while they are at most MOST_BROADCAST; beyond that the same join runs on all windows by shuffle.
    """
    text = F.col("text").cast("string").alias("text")
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("id"), text, text_key(F.col("text")).alias("text_key")).distinct().mapInArrow(_window_rows(None), _ROWS)
    windows_of = F.greatest(F.col("n") - WINDOW + 1, F.lit(1))
    items = items.select(F.col("id").alias("item_id"), "h", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), windows_of.alias("item_windows"), "n")
    lengths = [r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()]
    few = items.select("h").distinct().limit(MOST_BROADCAST + 1).toArrow().column("h").to_numpy()
    keep = np.sort(few.view(_U)) if len(few) <= MOST_BROADCAST else None
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text, text_key(F.col("text")).alias("text_key")).mapInArrow(_window_rows(keep, lengths), _ROWS).withColumnRenamed("id", "doc_id")
    # Windows that an item repeats with the same values are one row that counts as often, so copies never multiply.
    items = items.groupBy("item_id", "h", "item_slots", "item_windows").agg(F.min("item_at").alias("item_at"), F.count("*").alias("times"))
    rows = materialize(rows.distinct().select("doc_id", "text_key", "h", "slots", "at"), "windows")
    hits = materialize(with_candidates(rows, items, min_windows, min_share), "hits")
    discard(rows)
    # Place p has the begins in the p-th quarter of an item and in the next one.
    step = F.expr("(item_windows + 7) div 4 + 1")
    quarter = F.floor((F.col("at") - F.col("item_at")) / step).cast("long")
    place = F.explode(F.array(quarter, quarter - 1, F.lit(_WHOLE))).alias("place")
    hits = hits.select("doc_id", "text_key", "item_id", "item_at", "item_windows", "times", "at", "h", "item_slots", "slots", place)
    occurrence = ["doc_id", "text_key", "item_id", "place"]
    pairs = hits.select(*occurrence, "item_at", "item_windows", "times", F.explode(F.expr("CASE WHEN size(slots) > 0 THEN arrays_zip(item_slots, slots) ELSE array(named_struct('item_slots', 0L, 'slots', 0L)) END")).alias("s"), "at", "h")
    pairs = pairs.select(*occurrence, "item_at", "item_windows", "times", "at", "h", F.col("s.item_slots").alias("v"), F.col("s.slots").alias("u"))
    seen = pairs.where("v != 0").groupBy(*occurrence, "v", "u").agg(F.count("*").alias("c"))
    # Of equally common partners a value itself comes first, so a copy agrees with itself however its windows repeat.
    same = (F.col("v") == F.col("u")).alias("same")
    forth = seen.groupBy(*occurrence, "v").agg(F.max(F.struct("c", same, "u"))["u"].alias("u"))
    back = seen.groupBy(*occurrence, "u").agg(F.max(F.struct("c", same, "v"))["v"].alias("v"))
    keys = [*occurrence, "v", "u"]
    agreed = forth.join(back.toDF(*[f"{c}_" for c in back.columns]), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys]).select(*[F.col(c).alias(f"{c}_") for c in keys], F.lit(True).alias("agreed"))
    judged = pairs.join(agreed, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys], "left").withColumn("good", (F.col("v") == 0) | F.coalesce("agreed", F.lit(False)))
    by_window = judged.groupBy(*occurrence, "item_at", "item_windows", "at", "h").agg(F.max("times").alias("times"), F.bool_and("good").alias("good"), F.bool_or(F.col("v") != F.col("u")).alias("changed")).where("good")
    by_item = by_window.groupBy(*occurrence, "item_at", "item_windows").agg(F.max("times").alias("times"), F.bool_or("changed").alias("changed"))
    counted = by_item.groupBy(*occurrence, "item_windows").agg(F.least(F.sum("times"), "item_windows").alias("windows"), F.bool_or("changed").alias("reparameterised"))
    enough = (F.col("windows") >= F.least(F.lit(min_windows), "item_windows")) & (F.col("windows") >= min_share * F.col("item_windows"))
    found = counted.where(enough).groupBy("doc_id", "text_key", "item_id").agg(F.max("windows").alias("windows"), F.first("item_windows").alias("item_windows"), F.bool_or("reparameterised").alias("reparameterised"))
    return found.select("doc_id", "item_id", "windows", "item_windows", "reparameterised", "text_key")


def with_candidates(rows: DataFrame, items: DataFrame, min_windows: int, min_share: float) -> DataFrame:
    """rows(doc_id, text_key, h, slots, at) joined with items by h, for all pairs of a document and an item that can match.

    A match needs k of an item's windows, k being the larger of min_share of them and min_windows (or all). Of all T rows
    that an item has here (with what it repeats, and windows with names twice), it so has one of any T - k + 1, and those
    that the fewest items have are enough to find all pairs; only the windows of found pairs are joined in full, by pair. A window that many items share, such as an instruction
    that stands in all of them, so meets no document but those that hold some rarer window of the item; items that have
    nothing but shared windows find theirs by them. No window is left out of a pair.
    """
    shared = items.groupBy("h").agg(F.count_distinct("item_id").alias("n_items"))
    needed = F.greatest(F.least(F.lit(min_windows), F.col("item_windows")), F.ceil(F.lit(min_share) * F.col("item_windows")))
    ordered = Window.partitionBy("item_id", "item_windows").orderBy("n_items", "h", "item_at")
    before = F.coalesce(F.sum("times").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("times").over(Window.partitionBy("item_id", "item_windows"))
    ranked = items.join(shared, "h").withColumns({"before": before, "total": total})
    rare = ranked.where(F.col("before") <= F.col("total") - needed).select("h", "item_id").distinct()
    pairs = rows.select("doc_id", "text_key", "h").distinct().join(rare, "h").select("doc_id", "text_key", "item_id").distinct()
    # The windows of found pairs: a document's, by pair, and the item's by item and hash.
    key = [F.col("doc_id").alias("d"), F.col("text_key").alias("t")]
    own = pairs.select(*key, "item_id")
    met = rows.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).drop("d", "t")
    return met.join(items, ["item_id", "h"]).select("h", *[c for c in rows.columns if c != "h"], *[c for c in items.columns if c != "h"])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, reparameterised) of every row of docs; item_ids is sorted. Rows without a
    doc_id are judged by their text."""
    own = [F.col("doc_id").alias("d"), F.col("text_key").alias("t")]
    found = template_matches(docs, benchmark).groupBy(*own).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.bool_or("reparameterised").alias("reparameterised"))
    found = bounded(found, "contaminated")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("k")).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k") == F.col("t")), "left")
    none = F.array().cast("array<long>")
    return out.select("doc_id", F.col("t").isNotNull().alias("contaminated"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"))
