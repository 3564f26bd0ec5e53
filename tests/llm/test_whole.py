"""What the operators must not leave out."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from churnlens.llm import gru, lm_scoring, paragraph_dedup, passages, quality_rules, queries, search


def test_op5_asks_all_words_of_the_text(spark):
    """A query of 60 words; its 30 commoner ones are all that most of the others share with it."""
    common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(30)]
    texts = {0: " ".join(common + rare), 1: " ".join(rare)} | {i: " ".join(common[:i] + [f"x{i}"] * 3) for i in range(2, 31)}
    got = search.top_k(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), F.col("doc_id") == 0, k=20)
    bags = {i: Counter(t.encode().split()) for i, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    score = {i: sum(math.log1p((len(bags) - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * sum(b.values()) / mean))
                    for w in bags[0] if w in b) for i, b in bags.items()}
    want = sorted((-round(s, 9), i) for i, s in score.items() if s > 0)[:20]
    assert len(want) == 20 and [(-round(r.score, 9), r.doc_id) for r in sorted(got.collect(), key=lambda r: r["rank"])] == want


def test_op7_finds_a_passage_inside_lines_and_over_short_ones(spark, tmp_path):
    rnd = random.Random(4)

    def words(n):
        return [f"é{rnd.randrange(10 ** 9)}" for _ in range(n)]
    planted = words(50)
    texts = {1: " ".join(words(60) + planted + words(40)), 2: "head line\n" + " ".join(words(9) + planted + words(90)),
             3: "\n".join(" ".join(planted[i:i + 7]) for i in range(0, 50, 7)) + "\n" + " ".join(words(70)), 4: " ".join(words(200))}
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op7_paragraph_dedup(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.removed, r.class_doc) for r in rows} == {(1, False, 1), (2, True, 1), (3, True, 1)}
    assert all(texts[r.doc_id][r.start:r.start + r.length].split() == planted for r in rows) and len(rows) == 3
    lines = paragraph_dedup.repeated_paragraphs(docs)
    cut = {r.doc_id: r for r in passages.without_passages(docs, passages.repeated_passages(docs, lines)).collect()}
    for i, t in texts.items():
        assert cut[i].text.split() == [w for w in t.split() if i in (1, 4) or w not in planted] and cut[i].n_chars == len(cut[i].text)


def test_op7_loses_no_text_of_repeated_rows_or_clashing_ids(spark):
    rnd = random.Random(8)
    nine = ["\n".join(" ".join(f"p{rnd.randrange(10 ** 9)}" for _ in range(9)) for _ in range(7))][0]  # 63 words over short lines
    line, other = (" ".join(f"{x}{i}" for i in range(12)) for x in "lu")
    rows = [(1, nine), (1, nine), (5, line), (6, line), (6, other), (7, "head\n" + nine)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    out = [(r.doc_id, r.text.strip("\n")) for r in corpus_pipeline.drop_repeated_paragraphs(spark, docs, "").collect()]
    assert sorted(out) == sorted([(1, nine), (1, nine), (5, line), (6, ""), (6, other), (7, "head")])


@pytest.mark.parametrize("part", [0, 1, 2, 3, -5, 9])
def test_op1_trains_on_every_round_and_its_softmax_grows(spark, part):
    texts = spark.createDataFrame([(b"a b c d " * 20, part)] * 4, "text binary, part long")
    vocab = lm_scoring.vocabulary(lm_scoring.count_tokens(texts.select("text")).cache())
    first = gru.start(vocab.shape, vocab.class_bias, vocab.word_bias)
    got = lm_scoring.train(texts, vocab)
    assert not np.allclose(got["cb"], first["cb"]) or not np.allclose(got["V"], first["V"])
    words = [(b"w%d" % i, 2) for i in range(64_000)]
    large = lm_scoring.Vocabulary(words, 128_000, 64_000, lm_tails(words))
    assert large.words == 4000 and large.shape.heads <= 64
    ids, _ = large.encode([b"w3999", b"w4000"])
    assert ids[0] == 3999 and ids[1] == 4000 + lm_scoring.tail_of(b"w4000")


def lm_tails(words):
    out = np.zeros((lm_scoring.TAILS, 2), np.int64)
    for w, c in words:
        out[lm_scoring.tail_of(w)] += (c, 1)
    return out


def test_op2_counts_every_trusted_document(spark, monkeypatch):
    """24,000 documents labelled good, more than were once counted."""
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.format_string("w%d", F.col("id") % 1000).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    seen, real = [], quality_rules.weights
    monkeypatch.setattr(quality_rules, "weights", lambda d, t: seen.append(t.count()) or real(d, t))
    assert quality_rules.judge(docs, labels).count() == 24_000 and seen == [24_000]


def test_op5_answers_alike_in_blocks_and_keeps_k_best_over_a_tasks_shards(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, " ".join(f"w{int(rnd.paretovariate(.6))}" for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = F.col("doc_id") % 20 == 0

    def found(df):
        return sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in search.top_k(df, asked, k=3).collect())
    want = found(docs.coalesce(1))
    monkeypatch.setattr(search, "QUERY_BLOCK", 6)
    assert len(want) == 60 and found(docs.repartition(5)) == want
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    shards = search.postings(texts.repartition(5), 30.0, None).toArrow()
    terms = [(q, t.encode(), 1.0) for q, text in rows[::20] for t in set(text.split())]
    table = pa.table(list(zip(*terms, strict=True)), schema=pa.schema([("query_id", pa.int64()), ("term", pa.binary()), ("idf", pa.float64())]))
    sent = type("Sent", (), {"value": search.Asked.of(table)})
    out = pa.Table.from_batches(list(search._searching(sent, 3)(shards.to_batches())))
    assert shards.num_rows == 5 and out.num_rows == 60  # three for each of 20 queries, not for each shard
