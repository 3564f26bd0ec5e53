"""Repeated passages wherever they stand: inside longer lines or over short ones.

A passage is a run of ``PASSAGE`` words or more (A-Z lowered, spacing and line
ends ignored) that occurs twice or more.  Of any ``PASSAGE`` words in a row,
winnowing picks the same ``GRAM``-word seeds in every text, so a repeated passage
has a repeated seed; only windows of ``PASSAGE`` words around such seeds are
compared, by a 128-bit key of their words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import near
from churnlens.llm.common import map_arrow, spark_schema, text_bytes, written
from churnlens.session import cut_lineage, ship_package

PASSAGE, GRAM = 40, 20
CHUNK = 1 << 20  # bytes of text worked on at once
LONG = 64  # bytes; a longer word is hashed by itself
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FACTORS = (0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15)  # fixed: odd, a hash each
SEEDS = pa.schema([("seed", pa.int64()), ("n", pa.int64())])
WINDOWS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("body", pa.int64()), ("paragraph", pa.int32()), ("start", pa.int64()),
                     ("stop", pa.int64()), ("key", pa.binary())])


@lru_cache(maxsize=4)
def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``factor`` and of its inverse, modulo 2^64."""
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (factor, pow(factor, -1, 1 << 64)))


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """128 bits (2 x words, uint64) of the words ``raw[start:stop]``, about
    ``CHUNK`` bytes at a time."""
    out, i = np.empty((2, len(start)), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + CHUNK)))
        at, to = start[i:j] - start[i], stop[i:j] - start[i]
        b = raw[start[i]:stop[j - 1]].astype(np.uint64) + np.uint64(1)
        for k, factor in enumerate(_FACTORS):
            power, inverse = _powers(factor, max(CHUNK, 1 << len(b).bit_length()))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(b * power[:len(b)])])
            out[k, i:j] = (sums[to] - sums[at]) * inverse[at]
        i = j
    out = near.mixed(out ^ (stop - start).astype(np.uint64))
    for i in np.flatnonzero(stop - start > LONG).tolist():
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(raw[start[i]:stop[i]].tobytes()), np.uint64)
    return out


def rolled(w: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of every ``n`` values of ``w`` in a row; longer runs from two of half the length."""
    size = len(w) - n + 1
    out, done, part, span = np.zeros(size, np.uint64), 0, w, 1
    while n:
        if n & 1:
            out, done = out * np.uint64(factor) + part[done:done + size], done + span
        n >>= 1
        if n:
            part = part[:-span] * np.uint64(factor) + part[span:]
            span, factor = 2 * span, factor * factor % (1 << 64)
    return near.mixed(out)


class Words:
    """The words of several texts, one after the other, without the lines
    ``gone`` of each: their places, the texts and lines they are in, their hashes."""

    def __init__(self, texts: list[bytes], gone: list[list[int] | None]):
        raw = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        self.first = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
        edge = np.flatnonzero(np.diff(SPACE[raw].view(np.int8), prepend=1))  # ends of lines end the last word, too
        start, stop, ends = edge[::2], edge[1::2], np.flatnonzero(raw == 10)
        line, top = np.searchsorted(ends, start), np.searchsorted(ends, self.first)
        out = [top[i] + np.array(g, np.int64) for i, g in enumerate(gone) if g]
        if out:
            on = ~np.isin(line, np.concatenate(out))
            start, stop, line = start[on], stop[on], line[on]
        self.raw, self.start, self.stop = raw, start, stop
        self.text = np.searchsorted(self.first, start, side="right") - 1
        self.line = line - top[self.text]
        self.hashes = word_hashes(raw, start, stop)

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Places (among the words) and values of the winnowed seeds; the least of
        each ``PASSAGE`` words' seeds, the first of equal ones."""
        n = len(self.start) - PASSAGE + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        g = rolled(self.hashes[0], GRAM, _FACTORS[0])
        least = np.lib.stride_tricks.sliding_window_view(g, PASSAGE - GRAM + 1).argmin(axis=1)
        at = np.unique((least + np.arange(n))[self.text[:n] == self.text[PASSAGE - 1:]])
        return at, g[at].view(np.int64)

    def around(self, places: np.ndarray) -> np.ndarray:
        """First words of the ``PASSAGE`` words that hold a seed at ``places``, in one text."""
        own = self.text[places]
        low = np.maximum(places - PASSAGE + GRAM, np.searchsorted(self.text, own))
        high = np.minimum(places, np.searchsorted(self.text, own, side="right") - PASSAGE)
        step = np.zeros(len(self.start) + 1, np.int64)
        np.add.at(step, low, 1)
        np.add.at(step, high + 1, -1)
        return np.flatnonzero(np.cumsum(step) > 0)

    def keys(self, at: np.ndarray) -> pa.Array:
        """128 bits of the ``PASSAGE`` words from each of ``at`` on."""
        both = np.stack([rolled(h, PASSAGE, f)[at] for h, f in zip(self.hashes, _FACTORS, strict=True)], axis=1)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(at), [None, pa.py_buffer(both.tobytes())]).cast(pa.binary())

    def points(self, at: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Code points of ``text`` before the byte ``at``."""
        inner = np.flatnonzero((self.raw & 0xC0) == 0x80)
        first = self.first[text]
        return at - first - np.searchsorted(inner, at) + np.searchsorted(inner, first)


def _chunks(b: pa.RecordBatch):
    """(first row, ``Words``) of rows of about ``CHUNK`` bytes together."""
    texts, gone, i, size = b.column("text").to_pylist(), b.column("gone").to_pylist(), 0, 0
    for j, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK or j + 1 == len(texts):
            yield i, Words(texts[i:j + 1], gone[i:j + 1])
            i, size = j + 1, 0


def _seeds(b: pa.RecordBatch):
    own, n = np.unique(np.concatenate([w.seeds()[1] for _, w in _chunks(b)]), return_counts=True)
    return {"seed": own, "n": n}


def _windows(bits: np.ndarray):
    def run(batches):
        for b in batches:
            for i, w in _chunks(b):
                places, values = w.seeds()
                at = w.around(places[near.has_long(bits, values)])
                if not len(at):
                    continue
                own = w.text[at]
                rows = [b.column(c).take(pa.array(i + own)) for c in ("row", "doc_id", "body")]
                places = [w.line[at], w.points(w.start[at], own), w.points(w.stop[at + PASSAGE - 1], own)]
                yield pa.RecordBatch.from_arrays([*rows, *[pa.array(x, f.type) for x, f in zip(places, list(WINDOWS)[3:6], strict=True)], w.keys(at)], schema=WINDOWS)
    return run


def repeated_passages(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, length, class_doc, class_paragraph, removed,
    body) for the repeated passages of ``docs`` outside the lines that ``repeats``
    removes: ``paragraph`` is the line in which a passage begins, start and length
    count code points, the class is the place where its beginning first occurs,
    and ``body`` is the hash of the row's text.  Rows equal in doc_id and text
    share their places, of which none is removed for the other's sake."""
    gone = repeats.where("removed").groupBy(F.col("doc_id").alias("_id"), F.col("body").alias("_in")).agg(F.collect_set("paragraph").alias("gone"))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                      F.xxhash64("text").alias("body"), text_bytes())
    own = written(own.join(gone, own["doc_id"].eqNullSafe(gone["_id"]) & (own["body"] == gone["_in"]), "left").drop("_id", "_in"), "texts")
    twice = map_arrow(own.select("text", "gone"), _seeds, SEEDS).groupBy("seed").agg(F.sum("n").alias("n")).where("n > 1")
    ship_package(docs.sparkSession)
    found = written(own.mapInArrow(_windows(near.bitmap(twice, "seed")), spark_schema(WINDOWS)), "windows")
    here = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", "body", "paragraph")
    first = cut_lineage(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("f")).where("n > 1").select("key", "f"))
    both = found.join(first, "key").withColumn("removed", ~(F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("body") == F.col("f.body"))
                                                        & (F.col("start") == F.col("f.start"))))
    run = Window.partitionBy("row", "removed").orderBy("start")
    before = F.max("stop").over(run.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(run))
    begin = F.min(F.struct("start", "paragraph", F.col("f.doc_id").alias("class_doc"), F.col("f.paragraph").alias("class_paragraph")))
    out = both.groupBy("row", "doc_id", "body", "removed", "run").agg(begin.alias("b"), F.max("stop").alias("stop"))
    return out.select("doc_id", "b.paragraph", "b.start", (F.col("stop") - F.col("b.start")).alias("length"), "b.class_doc",
                      "b.class_paragraph", "removed", "body")


def without_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the removed passages taken out of ``text``, except for their
    line ends, so that lines keep their numbers; ``n_chars`` is counted anew."""
    cuts = (passages.where("removed").select(F.col("doc_id").alias("_id"), F.col("body").alias("_body"), "start", "length").distinct()
            .groupBy("_id", "_body").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_cuts")))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s, c):
        ends = F.regexp_replace(F.substring(F.col("text"), c["start"] + 1, c["length"]), "[^\n]", "")
        kept = F.substring(F.col("text"), s["at"] + 1, F.greatest(c["start"] - s["at"], F.lit(0)))
        return F.struct((c["start"] + c["length"]).alias("at"), F.concat(s["out"], kept, ends).alias("out"))
    text = F.aggregate("_cuts", state, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    own = docs.join(cuts, docs["doc_id"].eqNullSafe(cuts["_id"]) & (F.xxhash64("text") == F.col("_body")), "left")
    own = own.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        own = own.withColumn("n_chars", F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return own.select(*[f"`{c}`" for c in docs.columns])
