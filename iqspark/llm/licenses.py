"""License scans: ordered signature rules with keyword prefilter, priorities and interval containment."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .signatures import signatures
from .textkit import slices, texts_of

#: The base phrases and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@dataclass(frozen=True)
class Rule:
    """priority: higher wins; order: rules of equal priority are tried, and win, in this order."""

    label: str
    pattern: re.Pattern
    keywords: tuple[str, ...]
    priority: int
    order: int


def rules() -> list[Rule]:
    return [Rule(label, re.compile(rf"(?<![^ ])(?:{p})(?![^ ])"), tuple(k.split()), priority, i) for i, (label, p, k, priority) in enumerate(signatures())]


_FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


class Scanner:
    def __init__(self):
        import ahocorasick

        self.rules = rules()
        self.by_word: dict[str, list[Rule]] = {}
        for r in self.rules:
            for k in r.keywords:
                self.by_word.setdefault(k, []).append(r)
        self.words = {k.encode() for k in self.by_word}
        self.automaton = ahocorasick.Automaton()
        for k in {*self.by_word, *(p.split()[-1] for p in BASE)}:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> set[str]:
        return {k for _, k in self.automaton.iter(text)}

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, list[str], list[tuple[str, int, int, float]]]:
        """(words, base places, first and last start, base labels, detections (label, start, end, score) in words)."""
        words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        line = b" ".join(words).decode("utf-8", "surrogatepass")
        got = self.candidates(line)
        if not got:
            return len(words), 0, None, None, [], []
        begins: list[int] = []  # where each word begins

        def word(at: int) -> int:
            """The number of the word that begins at a place."""
            if not begins:
                begins.extend(accumulate((len(w) + 1 for w in line.split(" ")), initial=0))
            return bisect_left(begins, at)

        places, labels = [], set()
        padded = f" {line} "
        for phrase, label in BASE.items():
            at = padded.find(f" {phrase} ")
            while at >= 0:
                places.append(word(at))
                labels.add(label)
                at = padded.find(f" {phrase} ", at + 1)
        tried = {r.order: r for k in got for r in self.by_word.get(k, ())}
        found = [(-r.priority, m.start() - m.end(), r.order, m.start(), m.end(), r) for r in tried.values() for m in r.pattern.finditer(line)]
        found.sort(key=lambda x: x[:5])
        spans = [(r.label, word(a), bisect_left(begins, b), r.priority / 100) for a, b, r in sorted(accepted(found), key=lambda x: (x[0], x[1], x[2].order))]
        return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), spans


def accepted(found: list[tuple]) -> list[tuple[int, int, Rule]]:
    """Detections (start, end, rule) in the order given, without those that lie within one accepted before. Of the
    accepted ones only those that lie in no other can hold a later one: they are kept sorted, so a look is a bisection."""
    kept, starts, ends = [], [], []
    for *_, a, b, r in found:
        k = bisect_right(starts, a)
        if k and ends[k - 1] >= b:
            continue
        kept.append((a, b, r))
        low = bisect_left(starts, a)
        high = bisect_right(ends, b)
        starts[low:high], ends[low:high] = [a], [b]
    return kept


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, start: long, end: long, score: double>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): words, places of base phrases, labels, score and detections.

    A-Z are folded; words are runs of 0-9, a-z and characters from U+0080. Hundreds of rules (signatures as regular
    expressions over the words, joined by one space; see signatures) are tried only where one of their keywords occurs. Detections are
    taken by priority, then length, then rule order; one that lies within an accepted one is suppressed. labels: those
    of base phrases and accepted detections, distinct and sorted; score: the highest accepted rule's confidence (base
    phrases count 0.4), 0 without any. A null text is empty. Rows are independent and texts are taken whole.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            for piece in slices(batch, "text"):
                rows = []
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts_of(piece.column("text")), strict=True):
                    n, base, first, last, own, spans = s.scan(text)
                    score = max([0.4 if own else 0.0, *(x[3] for x in spans)])
                    rows.append((doc_id, n, base, first, last, ",".join(own), ",".join(sorted({*own, *(x[0] for x in spans)})), score, [dict(zip(("label", "start", "end", "score"), x, strict=True)) for x in spans]))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPAN]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in _OUT.split(", ")[:8]] + ["detections"])

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(scanned, _OUT)
