"""Repeated paragraphs by MinHash banding.

A paragraph is a line of a text with at least ``MIN_WORDS`` words.  Equal
paragraphs (A-Z lowered, spacing ignored) are one item; items get a MinHash
signature of their five-word shingles in bands tuned for recall 0.999 at
similarity 0.8; candidates are verified by exact Jaccard similarity; classes
are components.  The first occurrence of a class (least doc_id, then place)
stays, the others are removed.

Texts are read three times and never shuffled whole: for the signatures, for
the words of candidates, and for the places of repeated paragraphs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm import near
from churnlens.llm.common import map_arrow, text_bytes, written
from churnlens.session import cut_lineage

MIN_WORDS, RECALL = 10, 0.999
PENDING = 2000  # paragraphs whose words a task holds at once, besides a text's
BANDS, ROWS = near.tune(near.SIMILARITY, RECALL, range(2, 4))
ITEMS = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])
TEXTS = pa.schema([("key", pa.binary()), ("body", pa.binary())])
PLACES = pa.schema([("doc_id", pa.int64()), ("body", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("key", pa.binary())])


def paragraphs(text: bytes):
    """(number, start, length, words) of the paragraphs; start and length count
    code points."""
    start = 0
    for k, line in enumerate(text.split(b"\n")):
        words = line.lower().split()
        size = len(line.decode("utf-8", "replace"))
        if len(words) >= MIN_WORDS:
            yield k, start, size, words
        start += size + 1


def minhash(items: list[list[bytes]], registers: int = BANDS * ROWS) -> np.ndarray:
    flat, at = near.shingles_of(items)
    return np.stack([np.minimum.reduceat(near.mixed(flat ^ near.seed(i)), at) for i in range(registers)], axis=1)


def _items(b: pa.RecordBatch):
    number, n, bands, fresh = {}, [], [], []

    def done():
        bands.append(near.banded(minhash(fresh), BANDS, ROWS))
        fresh.clear()
    for text in b.column(0):
        for _, _, _, w in paragraphs(text.as_py()):
            k = number.setdefault(near.key_of(w), len(n))
            if k == len(n):
                n.append(0)
                fresh.append(w)
            n[k] += 1
        if len(fresh) >= PENDING:
            done()
    if fresh:
        done()
    return {"key": list(number), "n": n, "bands": list(np.concatenate(bands))} if n else None


def _bodies(bits: np.ndarray):
    def run(b: pa.RecordBatch):
        own, fresh = {}, {}

        def done():
            keys = [k for k in fresh if k not in own]
            own.update((k, b" ".join(fresh[k])) for k, y in zip(keys, near.has_key(bits, keys), strict=True) if y)
            fresh.clear()
        for text in b.column(0):
            for _, _, _, w in paragraphs(text.as_py()):
                fresh.setdefault(near.key_of(w), w)
            if len(fresh) >= PENDING:
                done()
        done()
        return {"key": list(own), "body": list(own.values())}
    return run


def _places(bits: np.ndarray):
    def run(b: pa.RecordBatch):
        found = [(doc, body, k, s, n, near.key_of(w)) for doc, body, text in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)
                 for k, s, n, w in paragraphs(text)]
        hit = near.has_key(bits, [f[-1] for f in found])
        cols = list(zip(*[f for f, y in zip(found, hit, strict=True) if y], strict=True)) or [()] * len(PLACES)
        return dict(zip(PLACES.names, cols, strict=True))
    return run


def repeated_paragraphs(docs: DataFrame, similarity: float = near.SIMILARITY) -> DataFrame:
    """(doc_id, body, paragraph, start, length, class_doc, class_paragraph, removed)
    for every occurrence of a paragraph that occurs, or nearly occurs, twice or
    more in ``docs`` (columns used: doc_id, text); ``class_doc`` and
    ``class_paragraph`` name the class's first occurrence, which is not removed.

    Null and empty texts have no paragraphs.  A text that repeats a paragraph
    keeps the first.  ``body`` is the hash of the row's text: rows that share a
    doc_id are told apart by it, and rows that are equal in both share their
    places, of which none is removed for the other's sake.  Null ids count last."""
    texts = docs.select(text_bytes())
    items = cut_lineage(map_arrow(texts, _items, ITEMS).groupBy("key").agg(F.sum("n").alias("n"), F.first("bands").alias("bands")))
    comp = near.classes(items, lambda bits: map_arrow(texts, _bodies(bits), TEXTS), similarity)
    twice = cut_lineage(items.where("n > 1").select("key").join(comp, "key", "full")
                        .select("key", F.coalesce("comp", "key").alias("comp")))
    bits = near.bitmap(twice, "key")
    places = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("body"), text_bytes()), _places(bits), PLACES)
    found = written(places.join(twice, "key").drop("key"), "places")
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "paragraph", "body")
    first = cut_lineage(found.groupBy("comp").agg(F.min(here).alias("f")).select("comp", "f.doc_id", "f.paragraph", "f.body")
                        .toDF("comp", "class_doc", "class_paragraph", "class_body"))
    kept = (F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("paragraph") == F.col("class_paragraph"))
            & (F.col("body") == F.col("class_body")))
    return found.join(first, "comp").select("doc_id", "body", "paragraph", "start", "length", "class_doc", "class_paragraph", (~kept).alias("removed"))


def without_repeats(docs: DataFrame, repeats: DataFrame, body: Column | None = None) -> DataFrame:
    """``docs`` with the removed lines taken out of ``text`` and ``n_chars``
    counted anew; every row stays, if need be with an empty text.  ``body``:
    the hash of the text that ``repeats`` was found in, if ``text`` has changed."""
    body = F.xxhash64("text") if body is None else body
    gone = repeats.where("removed").groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_in")).agg(F.collect_set("paragraph").alias("_gone"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.when(~F.array_contains("_gone", i), x))
    text = F.when(F.col("_gone").isNull() | F.col("text").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"))
    own = docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (body == F.col("_in")), "left").withColumn("text", text)
    count = F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else None
    own = own.withColumn("n_chars", count) if count is not None else own
    return own.select(*[f"`{c}`" for c in docs.columns])
