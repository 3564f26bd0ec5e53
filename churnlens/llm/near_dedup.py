"""ProbMinHash near-duplicate documents.

A document is a set of weighted five-word shingles (A-Z lowered; weight: 1 plus
the natural logarithm of the count).  Each shingle is a Poisson process whose
rate is its weight; each arrival falls on one of the signature's registers at
random, and a register keeps the shingle that arrives first.  Two documents
agree in a register with the probability Jaccard similarity of their weighted
sets.  Arrivals of a shingle are drawn one by one from its hash and stop as soon
as they are later than every register, so a long document costs little more
than a draw a shingle.  Signatures are banded for high recall at the threshold,
and candidates are verified by the exact Jaccard similarity of the five-word
shingle sets (0.8 or more).
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import near
from churnlens.llm.common import map_arrow, text_bytes
from churnlens.session import cut_lineage

RECALL = 0.9995
BANDS, ROWS = near.tune(near.SIMILARITY, RECALL, range(4, 6))
ROWS_OUT = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64()))])
TEXTS = pa.schema([("key", pa.binary()), ("body", pa.binary())])


def probminhash(elements: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """The element that arrives first in each register (uint64)."""
    first, got = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    at, h, w, k = np.zeros(len(elements)), elements, weights, 0
    while len(h):
        u = ((near.mixed(h + near.seed(2 * k)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0 ** 53
        at = at - np.log(u) / w
        on = at < first.max()
        at, h, w = at[on], h[on], w[on]
        j = (near.mixed(h + near.seed(2 * k + 1)) % np.uint64(registers)).astype(np.int64)
        before = first[j]
        np.minimum.at(first, j, at)
        new = (at == first[j]) & (at < before)  # of a tie the greatest hash, the elements being in order
        got[j[new]] = h[new]
        k += 1
    return got


def signature(words: list[bytes], registers: int = BANDS * ROWS) -> np.ndarray:
    h, n = np.unique(near.shingles(words), return_counts=True)
    return probminhash(h, 1 + np.log(n), registers)


def _rows(b: pa.RecordBatch):
    keys, docs, signs = [], [], []
    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
        w = text.lower().split()
        docs.append(doc)
        keys.append(near.key_of(w) if w else None)
        signs.append(signature(w) if w else None)
    full = [s for s in signs if s is not None]
    bands = iter(near.banded(np.array(full), BANDS, ROWS) if full else ())
    return {"doc_id": docs, "key": keys, "bands": [None if s is None else next(bands) for s in signs]}


def _bodies(bits: np.ndarray):
    def run(b: pa.RecordBatch):
        own = {}
        for text in b.column(0).to_pylist():
            w = text.lower().split()
            if w:
                own.setdefault(near.key_of(w), w)
        keys = list(own)
        hit = near.has_key(bits, keys)
        return {"key": [k for k, y in zip(keys, hit, strict=True) if y],
                "body": [b" ".join(own[k]) for k, y in zip(keys, hit, strict=True) if y]}
    return run


def near_duplicates(docs: DataFrame, similarity: float = near.SIMILARITY) -> DataFrame:
    """(doc_id, class_id, kept) for every row of ``docs`` (columns used: doc_id,
    text): ``class_id`` is the least doc_id of the row's class.

    Documents with equal words are copies, whatever their spacing and A-Z case.
    Null texts and texts without words are nobody's duplicate.  A text under
    five words is one shingle.  Rows that share a doc_id are judged by their own
    texts; null ids stay null and count only if a class has no other id."""
    rows = cut_lineage(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), _rows, ROWS_OUT))
    items = cut_lineage(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.first("bands").alias("bands")))
    texts = docs.select(text_bytes())
    comp = near.classes(items, lambda bits: map_arrow(texts, _bodies(bits), TEXTS), similarity)
    own = cut_lineage(items.select("key", "first").join(comp, "key", "left").select("key", "first", F.coalesce("comp", "key").alias("comp")))
    least = cut_lineage(own.groupBy("comp").agg(F.min("first").alias("class_id")))
    named = cut_lineage(own.join(least, "comp").select("key", "class_id"))
    out = rows.select("doc_id", "key").join(named, "key", "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")) \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def keep_one(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is its class's first; of rows that
    repeat a doc_id and text one stays."""
    ids = judged.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
