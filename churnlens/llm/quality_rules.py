"""Quality rules: hashed n-gram log-likelihood ratio, native expressions only.

Words and pairs of neighbouring words (the last with none) are hashed into ``BUCKETS`` buckets.  Two
multinomials over the buckets, of trusted documents (labelled good) and of the
whole raw corpus, are smoothed by ``SMOOTH`` counts a bucket.  A document's score is the
mean over its n-grams of log p(trusted) - log p(raw), in nats; a document below
``THRESHOLD`` is dropped, whatever the rest of the corpus scores.

The weights are ``BUCKETS`` integers (thousandths of a nat) in one literal, so
scoring is a projection without a shuffle.  The raw counts cover all documents,
the trusted ones all that are labelled good.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import let, words

BUCKETS, SMOOTH, THRESHOLD, PLACE = 1 << 14, 4.0, -0.07, 24
SYMBOLS = "[#*$%&|<>]"


def repeat_words(h: Column) -> Column:
    """Words that lie in three-word windows found twice or more, from the hashes
    ``h`` of the words in order (a lambda's variable, see ``let``).

    A window's hash and place share a long, which sorts as a primitive: the
    upper 40 bits of the hash, then 24 bits of place; neighbours that agree in
    the upper bits are compared word by word.  A text of 2^24 words or more
    takes the same steps on pairs instead."""
    low, mask = F.lit((1 << PLACE) - 1), F.lit(-(1 << PLACE))

    def window(x: Column, i: Column) -> Column:
        return F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
    starts = F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0)))

    def place(e: Column) -> Column:
        return e.bitwiseAND(low).cast("int")

    def packed_places(s: Column) -> Column:
        def same(j: Column) -> Column:
            a, b = F.get(s, j), F.get(s, j + 1)
            words = [F.get(h, place(a) + k) == F.get(h, place(b) + k) for k in range(3)]
            return (F.shiftright(a.bitwiseXOR(b), PLACE) == 0) & words[0] & words[1] & words[2]
        again = F.filter(F.sequence(F.lit(0), F.greatest(F.size(s) - 2, F.lit(0))), lambda j: F.coalesce(same(j), F.lit(False)))
        return let(again, lambda js: F.array_distinct(F.concat(
            F.transform(js, lambda j: place(F.get(s, j))), F.transform(js, lambda j: place(F.get(s, j + 1))))))

    def pair_places(p: Column) -> Column:
        return F.transform(F.filter(p, lambda e, j: F.coalesce(F.get(p, j + 1)["h"] == e["h"], F.lit(False))
                                    | ((j > 0) & (F.get(p, j - 1)["h"] == e["h"]))), lambda e: e["i"])
    packed = let(F.sort_array(F.transform(starts, lambda x, i: window(x, i).bitwiseAND(mask).bitwiseOR(i.cast("long")))), packed_places)
    pairs = let(F.sort_array(F.transform(starts, lambda x, i: F.struct(window(x, i).alias("h"), i.alias("i")))), pair_places)
    places = F.sort_array(F.when(F.size(h) <= (1 << PLACE), packed).otherwise(pairs))
    return let(places, lambda p: F.aggregate(
        F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b)).cast("long")


def _bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1))


def _pair(h: Column, x: Column, i: Column) -> Column:
    """Hash of a word and the next one; the last word meets a null."""
    return F.xxhash64(x, F.get(h, i + 1))


def hashes(w: Column) -> Column:
    """64-bit hashes of the words."""
    return F.transform(w, lambda x: F.xxhash64(x))


def ngrams(w: Column) -> Column:
    """Hashes of the words and of each word with its next."""
    return let(hashes(w), lambda h: F.concat(h, F.transform(h, lambda x, i: _pair(h, x, i))))


def weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """Thousandths of a nat by bucket; 0 without trusted documents.
    ``trusted``: distinct ids (doc_id), however many: they grow with the documents, so
    both sides are dealt by id, at every size, and none is broadcast."""
    own = docs.select("doc_id", "text").join(trusted.select("doc_id", F.lit(1).alias("t")).hint("merge"), "doc_id", "left")
    grams = own.select(F.coalesce("t", F.lit(0)).alias("t"), F.explode(ngrams(words(F.col("text")))).alias("g")).withColumn("g", _bucket(F.col("g")))
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in grams.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t")).collect():  # BUCKETS rows at most
        raw[r["g"]], good[r["g"]] = r["n"], r["t"]
    if not good.any():
        return np.zeros(BUCKETS, int)
    # the trusted counts are smoothed towards the raw ones: a bucket that they never reached is no evidence of itself
    p = (raw + SMOOTH) / (raw.sum() + SMOOTH * BUCKETS)
    q = (good + SMOOTH * p * BUCKETS) / (good.sum() + SMOOTH * BUCKETS)
    return np.rint(1000 * np.log(q / p)).astype(int)


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score, kept) for every row of ``docs`` (columns used: doc_id,
    text).

    Null and empty texts have no words, so they fail the base rules and score 0;
    repeated rows are judged alike; null ids are never trusted; without trusted
    labels all scores are 0 and the base rules decide."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1 and doc_id is not null").select("doc_id")
    weight = weights(docs, good)
    table = F.split(F.lit(",".join(map(str, weight))), ",").cast("array<int>")  # folded into one literal
    text = F.coalesce(F.col("text"), F.lit(""))
    spoken = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def total(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.get(table, _bucket(x).cast("int")) + F.get(table, _bucket(_pair(h, x, i)).cast("int")))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, v: a + v)
    # every array is a lambda's variable, so a filter on the verdict that the optimizer pushes below
    # this projection takes the struct whole and works nothing out again per element
    found = let(words(F.col("text")), lambda w: let(hashes(w), lambda h: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeat_words(h).alias("n_repeat_words"), (total(h) / F.greatest(2 * F.size(h), F.lit(1)) / 1000.0).alias("score"))))
    base = docs.select("doc_id", found.alias("f"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
                       let(spoken, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    base = base.select("doc_id", "f.n_words", "f.word_chars", "n_symbols", "n_dup_lines", "f.n_repeat_words", "f.score")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
