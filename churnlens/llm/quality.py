"""Quality by Bradley-Terry ranking.

A document's strength is linear in features of its whole text.  A pair (a good
and a bad labelled document) is a contest that the good one wins with the
probability sigmoid(difference of strengths); the weights minimise the logistic
loss over the pairs' feature differences.  The cut is the quantile of the
training strengths at the share of bad labels, smoothed by the strengths next
to it, and the score is a logistic curve through it.

Fitting uses at most about ``LABELLED`` labelled rows (a stated bound) and
``PAIRS`` contests a row of the commoner class; scoring maps over all texts
without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import fold, labelled_sample, logistic, map_arrow, text_bytes

LABELLED, PAIRS, FOLDS, HELD_OUT = 20_000, 4, 3, 1
SYMBOLS, MARKS = b"#*$%&|<>~^=_{}[]\\@+", b".,;:"


def _is(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars)).astype(float)


UPPER = _is(bytes(range(65, 91)))
KINDS = np.stack([UPPER, UPPER + _is(bytes(range(97, 123))), _is(SYMBOLS), _is(b"!"), _is(b"|"), _is(bytes(range(48, 58))),
                  _is(bytes(range(128, 256))), _is(MARKS)], axis=1)
NAMES = ["length", "word_size", "upper", "symbols", "bangs", "bars", "digits", "high", "marks", "again", "distinct",
         "same_lines", "line_size", "upper_words", "symbol_words", "bang_words", "top_word"]
FEATURES = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])


def features(text: bytes) -> list[float]:
    """What tells prose from junk; shares of the text, all 0 for an empty one."""
    w = text.split()
    if not w:
        return [0.0] * len(NAMES)
    n, size, counts = len(w), len(text), Counter(w)
    upper, letters, symbols, bangs, bars, digits, high, marks = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ KINDS
    lines = [x for x in text.split(b"\n") if x.strip()]
    loud = sum(k for x, k in counts.items() if x.isupper())
    odd = sum(k for x, k in counts.items() if x[-1] in b"#*$%&|")
    cried = sum(k for x, k in counts.items() if x[-1] == 33)
    return [np.log1p(n), sum(map(len, w)) / n / 10, upper / max(letters, 1), symbols / size, bangs / size, bars / size, digits / size,
            high / size, marks / n, sum(map(eq, w, w[1:])) / n, len(counts) / n ** 0.9, 1 - len(set(lines)) / len(lines),
            np.log1p(n / len(lines)), loud / n, odd / n, cried / n, max(counts.values()) / n]


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, z * z / 8]) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.cut), -30, 30)))


def contests(y: np.ndarray, per_row: int = PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (good, bad): each row of the commoner class meets ``per_row``
    rows of the other, evenly dealt."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.empty(0, int), np.empty(0, int)
    n = per_row * max(len(good), len(bad))
    i = np.arange(n)
    return good[i % len(good)], bad[(i + i // max(len(good), len(bad)) * 7919) % len(bad)]


def fit_ranker(x: np.ndarray, y: np.ndarray) -> Ranker:
    """With labels of one class only, every score is that class's share."""
    d = len(NAMES)
    if not len(y) or y.min() == y.max():
        even = 0.0 if not len(y) else 8.0 * (2 * float(y[0]) - 1)
        return Ranker(np.zeros(d), np.ones(d), np.zeros(2 * d), -even, 1.0)
    mean = np.median(x, axis=0)
    scale = np.maximum(x.std(axis=0), 1e-6)
    r = Ranker(mean, scale, np.zeros(2 * d), 0.0, 1.0)
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.hstack([z, z * z / 8])
    good, bad = contests(y)
    diff = z[good] - z[bad]
    r.weight = logistic(diff, np.ones(len(diff)), l2=1e-3 * len(diff) / d, offset=False)
    s = z @ r.weight
    order = np.sort(s)
    at = int((y == 0).sum())  # the quantile at the share of bad labels, between its neighbours
    wide = max(1, at // 50)
    r.cut = float((order[max(0, at - wide)] + order[min(len(s) - 1, at + wide - 1)]) / 2)
    r.slope = float(4 / max(1e-6, np.std(s[y == 1])))
    return r


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Ranker:
    """From the labelled rows outside the held-out fold."""
    own = labelled_sample(docs.sparkSession, docs.select("doc_id", text_bytes()), labels, "quality", bound, FOLDS, HELD_OUT)
    own = own.select(F.col("y").cast("int").alias("y"), "text")

    def run(b: pa.RecordBatch):
        return {"y": b.column(0), "x": [features(t) for t in b.column(1).to_pylist()]}
    rows = map_arrow(own, run, FEATURES).collect()  # bounded by ``bound``
    rows.sort(key=lambda r: (r["x"], r["y"]))
    return fit_ranker(np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], dtype=int))


SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null texts count as
    empty, a null id is not held out."""
    def run(b: pa.RecordBatch):
        x = np.array([features(t) for t in b.column(1).to_pylist()])
        return {"doc_id": b.column(0), "score": ranker.score(x)}
    out = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, SCORES)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows of ``docs`` whose text scores at least 0.5, columns kept."""
    schema = docs.schema

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            keep = ranker.score(np.array([features((t or "").encode("utf-8", "replace")) for t in texts]).reshape(-1, len(NAMES))) >= 0.5
            yield b.filter(pa.array(keep))
    return docs.mapInArrow(run, schema)
