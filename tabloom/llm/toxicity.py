"""Toxicity by multiple-instance learning: noisy-or over sentence scores."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, slices

TRAIN_ROWS = 6000
TRAIN_CHARS, TEXT_CHARS = 24_000_000, 1_000_000
MAX_FEATURES = 20000
BUCKETS = 1 << 20
THRESHOLD = 0.3
WORD_OR_END = re.compile(r"[^\W\d_]+|[.!?\n]+")
MEMO = 300_000


@dataclass(frozen=True)
class ToxicityModel:
    """Sentence logit = bias + summed word weights; document = noisy-or with a leak."""

    bias: float = -20.0
    leak: float = 0.01
    weights: dict[int, float] = field(default_factory=dict)


def word_features(word: str) -> tuple[int, ...]:
    """Hashed features of a lower-case word: itself and its stems of 4 and 5 letters."""
    crc = zlib.crc32
    return tuple({crc(f"{k}{w}".encode()) % BUCKETS for k, w in (("4", word[:4]), ("5", word[:5]), ("w", word))})


def sentences(text: str) -> list[tuple[int, int, set[str]]]:
    """``(start, end, words)`` of each sentence with a word; offsets count code points."""
    out, words, start, end = [], set(), 0, 0
    low = text.lower()
    if len(low) != len(text):  # a few letters lower to two code points
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    for m in WORD_OR_END.finditer(low):
        w = m[0]
        if w[0] in ".!?\n":
            if words:
                out.append((start, m.end(), words))
                words = set()
        else:
            if not words:
                start = m.start()
            words.add(w)
            end = m.end()
    if words:
        out.append((start, end, words))
    return out


def held_out(col) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: its label, sentence lengths and the features of all sentences."""
    for b in slices(batches):
        size, ids = [], []
        for text in b.column(1).to_pylist():
            bags = [np.array([f for w in ws for f in word_features(w)], np.int32) for _, _, ws in sentences(text or "")]
            size.append(np.array([len(x) for x in bags], np.int32).tobytes())
            ids.append(np.concatenate(bags).tobytes() if bags else b"")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.binary()), pa.array(ids, pa.binary())], names=["y", "size", "ids"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, train_chars: int = TRAIN_CHARS, text_chars: int = TEXT_CHARS, max_features: int = MAX_FEATURES, rounds: int = 200) -> ToxicityModel:
    """Fit on at most ``train_rows`` labelled documents that are not held out.

    The rows are those with the smallest hashed ids, so a rerun takes the same; of their
    texts, in the order of hashes, ``train_chars`` code points at most (24 million), so that
    what comes to the driver is bounded in bytes too, and none over ``text_chars`` (a million)
    by itself. All
    texts are scored, whatever their length. An id with
    several labels counts as toxic if any says so; null ids, null labels and labels other
    than 0 and 1 are left out; equal texts count once, as toxic if any of them is. Without
    both labels the model is the leak alone, which rejects nothing.

    The sizes are the model's: words and stems are hashed to 2**20 places, of which the
    ``max_features`` (20,000) that tell the labels apart best get a weight. Two words in one
    place share a weight; with the 20,000 kept in a million places that is one in fifty.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("t"))
    rows = rows.join(F.broadcast(sample), "__id").where("t IS NOT NULL").groupBy("t").agg(F.max("y").alias("y"))  # the bound of the broadcast is train_rows
    work = Workspace(docs.sparkSession, "toxicity")
    rows = work.table(rows.select("y", "t", F.xxhash64("t").alias("h"), F.length("t").cast("long").alias("n")), "sample")
    upto = F.sum("n").over(Window.orderBy("h", "n"))  # two numbers a row, of at most train_rows rows
    taken = rows.select("h", "n").where(F.col("n") <= text_chars).select("h", "n", upto.alias("upto")).where(F.col("upto") <= train_chars).select("h", "n").distinct()
    got = rows.join(F.broadcast(taken), ["h", "n"], "left_semi").select("y", "t").mapInArrow(_bags, "y int, size binary, ids binary").toArrow()
    work.drop("sample")
    y = np.array(got["y"].to_pylist(), np.float64)
    if not len(y) or y.min() == y.max():
        return ToxicityModel()
    sizes = [np.frombuffer(x, np.int32) for x in got["size"].to_pylist()]
    ids = [np.frombuffer(x, np.int32) for x in got["ids"].to_pylist()]
    del got
    order = sorted(range(len(y)), key=lambda i: (zlib.crc32(ids[i]), y[i]))  # whatever order the rows came in
    return _train(y[order], [sizes[i] for i in order], [ids[i] for i in order], max_features, rounds)


def _train(y, sizes, ids, max_features, rounds) -> ToxicityModel:
    pos, neg = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for label, x in zip(y, ids):
        (pos if label else neg)[np.unique(x)] += 1
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((neg + 0.5) / (len(y) - y.sum() + 1))
    seen = pos + neg
    keep = np.flatnonzero(seen >= 3)
    keep = keep[np.argsort(-np.abs(odds[keep]) * np.sqrt(seen[keep]), kind="stable")[:max_features]]
    column = np.full(BUCKETS, -1, np.int32)
    column[keep] = np.arange(len(keep))
    doc_of = np.repeat(np.arange(len(y)), [len(s) for s in sizes])
    cols, owners, first = [], [], 0
    for x, s in zip(ids, sizes):  # a document at a time: only kept features are gathered
        c, of = column[x], np.repeat(np.arange(first, first + len(s), dtype=np.int32), s)
        cols.append(c[c >= 0])
        owners.append(of[c >= 0])
        first += len(s)
    col, sentence_of = np.concatenate(cols), np.concatenate(owners)
    leak, n, d = 0.01, len(doc_of), len(y)
    w, bias = np.zeros(len(keep)), np.log(y.mean() / max(1.0, n / d))
    gw, gb, l1, rate = np.full(len(keep), 1e-6), 1e-6, 0.05 / d, 0.5
    for _ in range(rounds):
        z = np.clip(bias + np.bincount(sentence_of, w[col], n), -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = (1 - leak) * np.exp(np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-12)), d))
        up = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0)
        dz = up[doc_of] * p / d
        g = np.bincount(col, dz[sentence_of], len(keep)) - 1e-4 * w / d
        gw += g * g
        step = rate / np.sqrt(gw)
        w = w + step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        g = dz.sum()
        gb += g * g
        bias = float(np.clip(bias + rate * g / np.sqrt(gb), -14, 0))
    return ToxicityModel(bias, leak, {int(f): float(x) for f, x in zip(keep, w) if abs(x) > 1e-3})


class Scorer:
    """Scores texts with a model; remembers the weight of words it has met."""

    def __init__(self, model: ToxicityModel):
        self.model, self.memo = model, {}

    def weight(self, word: str) -> float:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = sum(self.model.weights.get(f, 0.0) for f in word_features(word))
        return got

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int]], int]:
        """Document score, spans of offending sentences (own score 0.3 or more), sentences."""
        bags = sentences(text or "")
        z = np.clip(np.array([sum(map(self.weight, sorted(ws))) for _, _, ws in bags], np.float64) + self.model.bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        total = float(-np.expm1(np.log1p(-self.model.leak) + np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))
        return min(max(total, 0.0), 1.0), [bags[i][:2] for i in np.flatnonzero(p >= THRESHOLD)], len(bags)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, whole texts: ``doc_id, held_out, score, predicted,
    n_sentences, offending`` (``start:end`` of offending sentences, comma-joined).

    Null and empty texts have no sentence and score the leak. Null ids are kept (not held
    out). An empty table gives an empty result.
    """

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches):
            got = [scorer.score(t) for t in b.column(2).to_pylist()]
            s = pa.array([x[0] for x in got], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), s, pa.array([int(x[0] >= THRESHOLD) for x in got], pa.int32()), pa.array([x[2] for x in got], pa.int32()), pa.array([",".join(f"{a}:{e}" for a, e in x[1]) for x in got], pa.string())],
                names=["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences int, offending string")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score under the threshold; no shuffle.

    Null and empty texts score the leak and stay; null ids do not matter; repeated rows
    stay or go together; an empty table gives an empty result.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(model)
        for b in slices(batches):
            yield b.filter(pa.array([scorer.score(t)[0] < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
