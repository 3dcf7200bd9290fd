"""Quality rules on repetition: a suffix array of words and its longest-common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textkit import Words, mix, power, slices, texts_of, windows, words

_U = np.uint64
_SYMBOLS = "#*$%&|<>"
_WHITE = " \t\n\x0b\x0c\r"


def longest_repeats(w: Words, h: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run of 3 words or more from it that also begins elsewhere in its row
    (0: none).

    The suffixes are those of the sequence of 3-word windows, a symbol at each word, so a common prefix of k symbols is
    one of k + 2 words; positions whose window is alone in its row have no repeat and keep ranks of their own. Prefix
    doubling sorts the others, of all rows at once: a rank after k rounds tells runs of 2**k symbols apart, and only
    positions that share a rank go on, and no rank but the last is kept. In suffix order the common prefixes of
    neighbours are found by bisection over their length, with a rolling hash of the symbols; the longest repeat at a position is the larger of those with its two neighbours, which
    bound the LCP intervals that it is in.
    """
    n = len(h)
    out = np.zeros(n, np.int64)
    at, symbols = windows(h, w, 3)
    symbols = mix(symbols + w.doc[at].astype(_U))
    # A table of hashes sorts out most of the windows that are alone.
    slot = (symbols >> _U(45)).astype(np.int64)
    again = np.bincount(slot, minlength=1 << 19)[slot] > 1
    at, symbols = at[again], symbols[again]
    order = np.argsort(symbols)
    change = np.ones(len(order), bool)
    change[1:] = symbols[order][1:] != symbols[order][:-1]
    group = np.cumsum(change) - 1
    many = (np.bincount(group) > 1)[group] if len(group) else np.zeros(0, bool)
    order, group = order[many], group[many]
    if not len(order):
        return out
    live, symbols_of = at[order], symbols[order]  # positions, group by group
    rank = n + np.arange(n)
    first = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), np.arange(len(group)), 0))
    rank[live] = first  # the place of its group's first position: there is room for those that part later
    step = 1
    while True:
        count = np.bincount(rank[live], minlength=len(live))
        mine = live[count[rank[live]] > 1]
        if not len(mine):
            break
        ahead = np.minimum(mine + step, n - 1)
        after = np.where(mine + step < n, rank[ahead], -1)
        order = np.lexsort((after, rank[mine]))
        a, b = rank[mine][order], after[order]
        begin = np.concatenate([[True], a[1:] != a[:-1]])
        change = begin | np.concatenate([[True], b[1:] != b[:-1]])
        index = np.arange(len(a))
        place = np.maximum.accumulate(np.where(change, index, 0)) - np.maximum.accumulate(np.where(begin, index, 0))
        rank[mine[order]] = a + place
        step *= 2
    suffixes = live[np.argsort(rank[live], kind="stable")]
    a, b = suffixes[:-1], suffixes[1:]
    # Symbols of places whose window is alone, and the first after a row, differ from all others.
    values = mix(_U(0x9E3779B97F4A7C15) * np.arange(1, n + 1, dtype=_U))
    values[live] = mix(symbols_of + _U(7))
    sums = np.zeros(n + 1, _U)
    np.cumsum(values * power("up", n), out=sums[1:])
    common, down = np.zeros(len(a), np.int64), power("down", n + 1)
    for k in range(max(0, int(step).bit_length() - 1), -1, -1):
        x, y, length = a + common, b + common, 1 << k
        fits = np.flatnonzero(np.maximum(x, y) + length <= n)
        x, y = x[fits], y[fits]
        same = (sums[x + length] - sums[x]) * down[x] == (sums[y + length] - sums[y]) * down[y]
        common[fits] += np.where(same, length, 0)
    common = np.where(common > 0, common + 2, 0)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge)[:n] > 0


def repeat_figures(w: Words, least: int) -> dict[str, np.ndarray]:
    """Per row: words in 3-word windows found twice or more, words in repeats of least words or more, longest repeat."""
    n, rows = len(w.start), w.n_docs
    zero = np.zeros(rows, np.int64)
    if n == 0:
        return {"n_repeat_words": zero, "covered_words": zero, "longest_repeat": zero}
    longest = longest_repeats(w, w.hashes(fold=False))
    threes, long = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= least)
    cover3 = _covered(threes, np.full(len(threes), 3), n)
    cover = _covered(long, longest[long], n)
    most = zero.copy()
    np.maximum.at(most, w.doc, longest)
    return {"n_repeat_words": np.bincount(w.doc[cover3], minlength=rows), "covered_words": np.bincount(w.doc[cover], minlength=rows), "longest_repeat": most}


def _plain_figures(text: str) -> tuple[int, int, int]:
    spaces = sum(map(text.count, _WHITE))
    lines = [x for x in text.split("\n") if x.strip(_WHITE)]
    return len(text) - spaces, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]


def quality(docs: DataFrame, least: int = 10, most_covered: float = 0.3, most_repeated: int = 100) -> DataFrame:
    """Figures and verdict of every row of docs(doc_id, text), text taken whole.

    Words are runs without white space. base_failed: under 50 words, or more than half of them in repeated 3-word
    windows. The method's verdict: maximal repeated word strings of least words or more (LCP intervals of the row's
    suffix array) are united; the row fails if they cover more than most_covered of its words or if the longest repeat
    exceeds most_repeated words. kept: neither fails. Null and empty texts have no words and fail; rows are judged each
    by itself, in pieces of bounded size (a longer text is a piece of its own). Other columns are ignored.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                w = words(piece.column("text"))
                got = repeat_figures(w, least)
                n_words = np.diff(w.first)
                plain = np.array([_plain_figures(t or "") for t in texts_of(piece.column("text"))], np.int64).reshape(-1, 3)
                failed = (n_words < 50) | (100 * got["n_repeat_words"] > 50 * n_words)
                kept = ~failed & (got["covered_words"] <= most_covered * n_words) & (got["longest_repeat"] <= most_repeated)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").cast(pa.int64()), *[pa.array(c.astype(np.int64)) for c in (n_words, plain[:, 0], plain[:, 1], plain[:, 2], got["n_repeat_words"], got["covered_words"], got["longest_repeat"])], pa.array(failed), pa.array(kept)], _NAMES)

    return docs.selectExpr("CAST(doc_id AS long) doc_id", "CAST(text AS string) text").mapInArrow(judged, _OUT)
