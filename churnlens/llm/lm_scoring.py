"""Document log-likelihood under a gated recurrent language model.

Tokens are the words of a text (A-Z lowered) and one end.  Training documents
are those outside the held-out fold; every token of theirs is counted.

* One in ``SHARE`` of the counted words, the commonest, but at least ``WORDS`` and
  at most those that fit a task, have a softmax within classes of about equal sums
  of the square roots of counts; all other words belong to one of ``TAILS`` tail
  classes by their last two bytes.  The network gives the class, and a tail class's word has its
  smoothed share of the class's counted tokens, an unknown word the class's
  unknown share.  So the model's vocabulary is the whole counted one.
* The network is trained in ``ROUNDS`` rounds: each worker trains on its share
  of the round's documents from the same weights, and the weights are averaged
  by tokens, block by block, in Spark; the driver gets one set of weights.  The
  training documents are encoded once and stored by round, a hash class each; all
  rounds together take each training document once, whole.
* Counts of the ``LOOKUP`` commonest words go to the tasks (a size bound);
  the other words of a document are joined with their counts by word.  Both the
  base and the model need only log10(count + 0.5) of them, once.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm import gru
from churnlens.llm.common import fold, map_arrow, text_bytes
from churnlens.session import cut_lineage, scratch_path, ship_package

WORDS, SHARE, HEADS, TAILS, LOOKUP = 1024, 16, 0.6, 16, 1 << 17  # HEADS: classes, times the root of their words
FOLDS, HELD_OUT, ROUNDS, BLOCK = 5, 1, 4, 65536
END = b" "  # no word has a blank
FLUSH = 400_000
COUNTS = pa.schema([("word", pa.binary()), ("tail", pa.int32()), ("c", pa.int64())])
PARTIAL = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("word", pa.binary()), ("times", pa.int64()), ("n_tokens", pa.int64()),
                     ("n_known", pa.int64()), ("base", pa.float64()), ("model", pa.float64())])
CODED = pa.schema([("round", pa.int32()), ("ids", pa.binary())])
BLOCKS = pa.schema([("block", pa.int32()), ("seen", pa.float64()), ("part", pa.binary())])


def tail_of(word: bytes) -> int:
    return crc32(word[-2:]) % TAILS


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, tail, c) over all tokens of ``texts`` (text binary)."""
    def run(batches):
        def out():
            words = list(n)
            for i in range(0, len(words), 50_000):
                part = words[i:i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([tail_of(w) for w in part], pa.int32()),
                                                  pa.array([n[w] for w in part], pa.int64())], schema=COUNTS)
        n: Counter[bytes] = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                n.update(text.lower().split())
                n[END] += 1
                if len(n) >= FLUSH:
                    yield from out()
                    n.clear()
        yield from out()
    ship_package(texts.sparkSession)
    return texts.mapInArrow(run, "word binary, tail int, c long").groupBy("word", "tail").agg(F.sum("c").alias("c"))


def class_starts(c: np.ndarray, heads: int) -> np.ndarray:
    """First words of at most ``heads`` classes of words with counts ``c``: a
    common word's class is small, so that most tokens need few products."""
    root = np.sqrt(c)
    end = np.cumsum(root)
    return np.flatnonzero(np.diff(np.minimum((end - root / 2) / end[-1] * heads, heads - 1).astype(np.int64), prepend=-1))


class Vocabulary:
    """Counts that fit a task, and the sums over all the others."""

    def __init__(self, common: list[tuple[bytes, int]], total: int, distinct: int, tails: np.ndarray):
        """``common``: commonest words with counts, in order; ``tails``: (TAILS,
        2) tokens and words of the tail classes over all words."""
        self.total, self.distinct = total, distinct
        head = common[:max(WORDS, distinct // SHARE)]
        self.words, self.end = max(len(head), 1), 0
        left = tails.astype(float).copy()
        for w, c in head:
            left[tail_of(w)] -= (c, 1)
        self.tail_base = np.log10(left[:, 0] + 0.5 * (left[:, 1] + 1))
        self.base = float(np.log10(total + 0.5 * (distinct + 1)))
        self.rank = {w: i for i, (w, _) in enumerate(common)}
        self.id_of = np.array([i if i < self.words else self.words + tail_of(w) for i, (w, _) in enumerate(common)], dtype=np.int32)
        self.log_of = np.log10(np.array([c for _, c in common], dtype=float) + 0.5)
        self.end = self.rank.get(END, 0)
        c = np.array([c for _, c in head] or [1], dtype=float) + 0.5
        self.shape = gru.Shape(self.words, 0, TAILS, class_starts(c, int(np.ceil(HEADS * np.sqrt(self.words)))))
        own = np.add.reduceat(c, self.shape.starts)
        self.word_bias = np.log(c / own[self.shape.classes[:self.words]])
        mass = np.concatenate([own, left[:, 0] + 0.5 * (left[:, 1] + 1)])  # an untrained model is the base
        self.class_bias = np.log(mass / mass.sum())

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids, and the ranks among the common words (-1: rare)."""
        rank = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))
        ids = self.id_of[rank] if len(self.id_of) else np.zeros(len(words), np.int32)
        for k in np.flatnonzero(rank < 0).tolist():
            ids[k] = self.words + tail_of(words[k])
        return ids, rank


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From materialised counts.  The cut for the common words comes from a
    histogram of the counts in steps of a 16th of an octave, so no task sorts them."""
    level = F.floor(F.log2("c") * 16).cast("int")
    tails, total, distinct, levels = np.zeros((TAILS, 2), np.int64), 0, 0, Counter()
    for r in counts.groupBy("tail", level.alias("level")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        tails[r["tail"]] += (r["c"], r["n"])
        total, distinct = total + r["c"], distinct + r["n"]
        levels[r["level"]] += r["n"]
    cut, room = max(levels, default=0) + 1, LOOKUP
    for k in sorted(levels, reverse=True):
        if levels[k] > room:
            break
        cut, room = k, room - levels[k]
    rows = counts.where(level >= cut).select("word", "c").collect()  # LOOKUP rows at most
    common = sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (x[0] != END, -x[1], x[0]))
    return Vocabulary(common, total, distinct, tails)


# ------------------------------------------------------------- training

def _pack(p: dict) -> np.ndarray:
    return np.concatenate([p[k].reshape(-1) for k in sorted(p)])


def _unpack(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def train(texts: DataFrame, vocab: Vocabulary) -> dict[str, np.ndarray]:
    """Weights from training texts (``text`` binary, ``part`` long hash)."""
    spark, sc = texts.sparkSession, texts.sparkSession.sparkContext
    p = gru.start(vocab.shape, vocab.class_bias, vocab.word_bias)
    shared = sc.broadcast(vocab)

    def encode(b: pa.RecordBatch):
        ids = (shared.value.encode(tokens(t))[0] for t in b.column("text").to_pylist())
        return {"round": b.column("round"), "ids": [i.astype("<i4").tobytes() for i in ids]}
    coded = map_arrow(texts.select(F.pmod("part", F.lit(ROUNDS)).cast("int").alias("round"), "text"), encode, CODED)
    path = scratch_path(spark, "encoded")
    coded.write.partitionBy("round").parquet(path)
    stored = spark.read.schema("ids binary, round int").parquet(path)

    def add(table: pa.Table) -> pa.Table:
        seen = table.column("seen").to_pylist()
        total = sum(np.frombuffer(x, np.float32) * s for x, s in zip(table.column("part").to_pylist(), seen, strict=True)) / sum(seen)
        return pa.table([table.column("block").slice(0, 1), [sum(seen)], [total.astype(np.float32).tobytes()]], schema=BLOCKS)
    for k in range(ROUNDS):
        now = sc.broadcast(p)

        def work(batches, now=now):
            docs = ([np.frombuffer(x, "<i4") for x in b.column(0).to_pylist()] for b in batches)
            got, seen = gru.train(now.value, shared.value.shape, (d for d in docs if d), shared.value.end)
            if seen:
                flat = _pack(got)
                parts = [flat[i:i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)),
                                                  pa.array(parts, pa.binary())], schema=BLOCKS)
        schema = "block int, seen double, part binary"
        own = stored.where(F.col("round") == k).select("ids")
        rows = own.mapInArrow(work, schema).groupBy("block").applyInArrow(add, schema).collect()  # one set of weights
        if rows:
            rows.sort(key=lambda r: r["block"])
            p = _unpack(np.concatenate([np.frombuffer(bytes(r["part"]), np.float32) for r in rows]), p)
        now.unpersist()
    return p


# ------------------------------------------------------------- scoring

def read(v: Vocabulary, text: bytes) -> tuple[np.ndarray, int, float, float, Counter]:
    """Of a text: the model's ids, how many words are common, the sums of their
    logs and of those in tail classes, and the rare words; its other words are
    not kept, as those of a whole batch take many times its size."""
    w = tokens(text)
    ids, rank = v.encode(w)
    on = rank >= 0
    return (ids, int(on.sum()), float(v.log_of[rank[on]].sum()), v.log_of[rank[on & (ids >= v.words)]].sum(),
            Counter([w[j] for j in np.flatnonzero(~on).tolist()]))


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)
    for every row of ``docs`` (columns used: doc_id, text); scores are log10.

    Null and empty texts are one end.  A null id is in no fold, so it trains and
    is not held out.  Repeated rows are counted and scored as often as they
    occur.  Without training documents every token is unknown."""
    sc = docs.sparkSession.sparkContext
    ship_package(docs.sparkSession)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    texts = docs.where(~held).select(text_bytes(), F.xxhash64("doc_id").alias("part"))
    counts = cut_lineage(count_tokens(texts.select("text")))
    vocab = vocabulary(counts)
    weights = train(texts, vocab)
    model = sc.broadcast((vocab, weights))

    def run(b: pa.RecordBatch):
        v, p = model.value
        out = {f.name: [] for f in PARTIAL}
        coded = [read(v, t.as_py()) for t in b.column("text")]
        ll = gru.score(p, v.shape, [c[0] for c in coded], v.end) / np.log(10)
        for k, (row, doc) in enumerate(zip(b.column("row").to_pylist(), b.column("doc_id").to_pylist(), strict=True)):
            ids, known, logs, in_tail, rare = coded[k]
            tail = np.bincount(ids[ids >= v.words] - v.words, minlength=TAILS)
            base, own = logs - len(ids) * v.base, float(ll[k] + in_tail - tail @ v.tail_base)
            # the document's own row has a key that is no word, and another in each document
            out["word"] += [b" " + str(row).encode(), *rare]
            out["times"] += [0, *rare.values()]
            for name, x, y in (("row", row, row), ("doc_id", doc, doc), ("n_tokens", len(ids), 0), ("n_known", known, 0),
                               ("base", base, 0.0), ("model", own, 0.0)):
                out[name] += [x, *[y] * len(rare)]
        return out
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes())
    parts = map_arrow(keyed, run, PARTIAL)
    rare = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    known = F.when(F.coalesce("c", F.lit(0)) > 0, F.col("times")).otherwise(0)
    out = (parts.join(counts.select("word", "c"), "word", "left").groupBy("row", "doc_id")
           .agg(F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("n_known") + known).alias("n_known"),
                F.sum(F.col("base") + rare).alias("base_score"), F.sum(F.col("model") + rare).alias("score")))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known",
                      F.lit(vocab.total).cast("long").alias("train_tokens"), "base_score", "score")
