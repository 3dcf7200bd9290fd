"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .textkit import slices, texts_of

DIM = 1 << 14  # hashed n-grams of 1 to 3 characters
_MULT = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams of the whole lower-cased text, in pieces of bounded size."""
    out = np.zeros(DIM, np.int64)
    for at in range(0, len(text), 1 << 18):
        piece = text[max(0, at - 2) : at + (1 << 18)].lower()
        c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = min(at, 2)  # characters that the last piece has counted
        h = c * np.uint32(_MULT[0])
        for n in range(1, 4):
            if n > 1:
                if len(c) < n:
                    break
                h = (h[: len(c) - n + 1] ^ (h[: len(c) - n + 1] >> np.uint32(15))) * np.uint32(_MULT[n - 1]) + c[n - 1 :]
            got = h[max(0, known - n + 1) :]
            out += np.bincount(((got * np.uint32(0x27D4EB2F)) >> np.uint32(18)).astype(np.int64), minlength=DIM)
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class Model:
    """Weights (DIM x languages), idf and temperature: a fixed size, whatever the corpus."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return (x @ self.weights[at]) / max(np.sqrt(x @ x), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.langs:
            return "und", 0.0
        p = softmax(self.logits(gram_counts(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers of documents with each hashed n-gram, of one task; entry -1 is the number of documents."""
    df, n = np.zeros(DIM, np.int64), 0
    for batch in batches:
        for piece in slices(batch, "text"):
            for text in texts_of(piece.column("text")):
                df += gram_counts(text) > 0
                n += 1
    at = np.append(np.flatnonzero(df), -1)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.append(df, n)[at], pa.int64())], ["gram", "n"])


#: Lengths to which held-back texts are cut for the temperature, besides the whole.
CUTS = (3, 6, 12, 24, 48, 96)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, fold, whole, grams, logs) of each text; of those held back (fold 0) also of a part of each length of CUTS."""
    for batch in batches:
        for piece in slices(batch, "text"):
            rows = []
            for lang, fold, text in zip(piece.column("lang").to_pylist(), piece.column("fold").to_pylist(), texts_of(piece.column("text")), strict=True):
                parts = [text]
                if fold == 0:
                    parts += [text[at : at + n] for n in CUTS if n < len(text) for at in (zlib.crc32(text.encode(errors="replace")) % (len(text) - n + 1),)]
                for part in filter(has_letter, parts):
                    counts = gram_counts(part)
                    at = np.flatnonzero(counts)
                    rows.append((lang, fold, part is text, at.astype(np.uint16).tobytes(), (1 + np.log(counts[at])).astype(np.float32).tobytes()))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()], strict=True)], ["lang", "fold", "whole", "grams", "logs"])


#: Rows of a language of which all are drawn, and how many times at most a row of a rare language counts.
LEAST_ROWS, MOST_WEIGHT = 20, 50.0


class Vectors(Sequence):
    """(grams, values, class) of training rows, each made from the features of its row (2-byte grams, 4-byte logs) when it
    is asked for: all of them at once would take several times the driver's memory that the features take."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, int]], idf: np.ndarray):
        self.rows, self.idf = rows, idf

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        grams, logs, y = self.rows[k]
        at = grams.astype(np.int64)
        x = logs * self.idf[at]
        return at, x / np.sqrt(x @ x), y


def follow_leader(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], classes: int, class_weights: np.ndarray | None = None, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal (McMahan et al., 2013) with elastic net on (grams, values, class) rows: weights and biases.

    Each weight is the closed-form minimiser of the linearised losses so far plus l1 and l2 penalties and proximal
    terms; it stays exactly 0 while its summed gradient is within l1.
    """
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def solve(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, DIM), np.append(x, 1.0)
            w = solve(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :] * (1.0 if class_weights is None else class_weights[y])
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(DIM + 1))
    return w[:DIM], w[DIM]


#: Least and greatest temperature.
TEMPERATURES = (0.01, 20.0)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-back rows, by golden-section search over its logarithm. The right
    language counts (n + 1) / (n + 2) of n rows, the others the rest, so that faultless rows don't make it vanish."""
    n, classes = logits.shape
    if not n or classes < 2:
        return 1.0
    right = (n + 1) / (n + 2)
    target = np.full((n, classes), (1 - right) / (classes - 1))
    target[np.arange(n), y] = right
    loss = lambda t: -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-300))).sum(axis=1).mean()
    lo, hi, r = *np.log(TEMPERATURES), (np.sqrt(5) - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(docs: DataFrame, rows_per_lang: int = 1000, most_rows: int = 20_000, most_langs: int = 1000) -> Model:
    """Fit on docs(doc_id, text, lang). idf counts every row; the classifier is fitted on a bounded sample: about
    rows_per_lang rows of each language and most_rows in all, chosen by a hash of doc_id and text. Of each language of
    over LEAST_ROWS rows a fifth of the sample, by another hash, is held back for the temperature, whole and cut to the
    lengths of CUTS, unless nothing would be left to learn from (as when its rows repeat); so every language is learned. A
    row counts by how rare its language is in the sample (at most MOST_WEIGHT times), so that few rows are learned, too.
    Of more than most_langs languages, those with most rows are learned, and that is logged; the model's size is bounded
    by it. Rows with null text or lang, or without letters, teach nothing."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    df = {r["gram"]: r["n"] for r in known.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    n = df.pop(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([df.get(i, 0) for i in range(DIM)]))) + 1
    langs_of = known.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    per_lang = langs_of.limit(most_langs + 1).collect()
    if not per_lang:
        return Model([], idf, np.zeros((DIM, 0)), np.zeros(0), 1.0)
    if len(per_lang) > most_langs:
        logging.getLogger(__name__).warning("only the %d languages with most rows are learned", most_langs)
        per_lang = per_lang[:most_langs]
    most = min(rows_per_lang, max(1, most_rows // len(per_lang)))
    # Of a language of few rows all are drawn: a share of them could be none.
    share = known.sparkSession.createDataFrame([(r["lang"], 1.0 if r["count"] <= LEAST_ROWS else min(1.0, max(most, 2 * LEAST_ROWS) / r["count"]), r["count"] <= LEAST_ROWS) for r in per_lang], "lang string, share double, few boolean")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1e6
    sample = known.join(F.broadcast(share), "lang").where(drawn < F.col("share"))
    fold = F.when(F.col("few"), 1).otherwise(F.pmod(F.xxhash64("text", "doc_id"), F.lit(5)))
    sample = sample.select("lang", fold.cast("int").alias("fold"), "text")
    got = sample.mapInArrow(_features, "lang string, fold int, whole boolean, grams binary, logs binary").toArrow()
    langs = sorted({r["lang"] for r in per_lang})
    number = {lang: k for k, lang in enumerate(langs)}
    lang, fold, whole = (got.column(c).to_pylist() for c in ("lang", "fold", "whole"))
    # Views of what has come, no copies.
    grams, logs = ([np.frombuffer(x.as_buffer(), kind) for x in got.column(c)] for c, kind in (("grams", np.uint16), ("logs", np.float32)))
    fit, held = [], []
    taught = {x for x, f in zip(lang, fold, strict=True) if f != 0}
    for k in pa.compute.sort_indices(got, [(c, "ascending") for c in ("lang", "grams", "logs")]).to_pylist():
        row = (grams[k], logs[k], number[lang[k]])
        if fold[k] == 0 and lang[k] in taught:
            held.append(row)
        elif whole[k]:
            fit.append(row)
    size = np.bincount([y for *_, y in fit], minlength=len(langs)) if fit else np.ones(len(langs))
    weights, bias = follow_leader(Vectors(fit, idf), len(langs), np.minimum(size.max() / np.maximum(size, 1), MOST_WEIGHT))
    logits = np.array([x @ weights[at] + bias for at, x, _ in Vectors(held, idf)]).reshape(len(held), len(langs))
    return Model(langs, idf, weights, bias, calibrate(logits, np.array([y for *_, y in held], int)))


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (two columns more, under other names if wanted; columns of these names are replaced).
    The model depends on text alone; und and 0 for a null text or one without letters."""
    at = [c for c in docs.columns if c not in names]
    docs = docs.select(*[F.col(f"`{c}`") for c in at])
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                out = [model.predict(t) for t in texts_of(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], [*at, *names])

    return docs.mapInArrow(predicted, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows of docs that are not held out, and predict every row: doc_id, held_out, lang_pred, score.
    A null doc_id is not held out; repeated rows are predicted each."""
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
