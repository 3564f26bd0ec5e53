"""Each operator against brute force, and on odd inputs."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlens.llm import (gru, lm_scoring, mixing, near, near_dedup, packing, paragraph_dedup, quality, quality_rules, search,
                           toxicity, url_filter)
from churnlens.llm.common import table
from tests.llm.brute import classes

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, rank int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty, blank, very long, tied and repeated rows, clashing extra columns."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    line = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, line), (6, line), (None, line + "\nshort line of quite other words"), (7, "a b c"), (8, "a b c")]
    return spark.createDataFrame([(i, t, None, None if i == 4 else "s", 0, 0.5, 1, 2, "k") for i, t in rows], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int")


def test_op1_base_and_model(docs, texts):
    got = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    def cut(t): return [*t.encode().lower().split(), b" "]
    seen = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            seen.update(cut(t))
    n, v = sum(seen.values()), len(seen)
    for i, t in texts.items():
        r = got[i]
        assert math.isclose(r.base_score, sum(math.log10((seen[w] + .5) / (n + .5 * (v + 1))) for w in cut(t)), rel_tol=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(cut(t)), sum(seen[w] > 0 for w in cut(t)), n)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model(r):
    shape = gru.Shape(10, 4, 3)
    p = gru.start(shape, np.zeros(6), np.zeros(10))
    return shape, {k: a + r.standard_normal(a.shape).astype(np.float32) * .1 for k, a in p.items()}


def test_op1_gradients_equal_differences():
    r = np.random.default_rng(1)
    shape, p = small_model(r)
    p = {k: a.astype(np.float64) for k, a in p.items()}
    x, y, new, _ = gru.lanes([r.integers(0, 13, n).astype(np.int32) for n in (40, 70, 9, 1)], 3, 0)
    h = np.zeros((x.shape[1], gru.HIDDEN))
    _, n, grad, rows, _ = gru.gradients(p, shape, x, y, new, h)
    full = {k: np.zeros_like(a) for k, a in p.items()} | {k: grad[k] for k in ("W", "b", "U", "C", "cb")}
    full["E"][rows] = grad["E"]
    for lo, hi, g, gb in grad["V"]:
        full["V"][lo:hi], full["vb"][lo:hi] = g, gb
    assert n == (y >= 0).sum() == 120

    def value(k, at, step):
        a = p[k].copy()
        a[at] += step
        return gru.gradients(p | {k: a}, shape, x, y, new, h)[0]
    for k, g in full.items():
        for at in zip(*(r.integers(0, n, 6) for n in g.shape), strict=True):
            slope = (value(k, at, .05) - value(k, at, -.05)) / .1  # logits are single floats
            assert abs(slope - g[at]) < .02 + .03 * abs(g[at]), (k, at, slope, g[at])


def test_op1_training_changes_what_it_met_and_nothing_else():
    r = np.random.default_rng(2)
    shape, p = small_model(r)
    docs = [r.choice([0, 1, 2, 3, 11], 50).astype(np.int32) for _ in range(5)]  # the first class and a tail class
    got, seen = gru.train(p, shape, [docs], 0)
    assert seen == 250
    for k in ("W", "b", "U", "C", "cb"):
        assert not np.allclose(got[k], p[k])
    met = [0, 1, 2, 3, 11]
    assert (np.abs(got["E"] - p["E"]).max(axis=1) > 0).nonzero()[0].tolist() == met
    assert (np.abs(got["V"] - p["V"]).max(axis=1) > 0).nonzero()[0].tolist() == met[:4]
    more, _ = gru.train(got, shape, [docs] * 20, 0)
    assert gru.score(more, shape, docs, 0).sum() > gru.score(got, shape, docs, 0).sum() > gru.score(p, shape, docs, 0).sum()


def test_op1_a_long_training_document_is_taken_whole():
    r = np.random.default_rng(3)
    shape, p = small_model(r)
    size = 3 * gru.SEGMENT + 17
    assert gru.train(p, shape, [[r.integers(0, 13, size).astype(np.int32), np.zeros(2, np.int32)]], 0)[1] == size + 2


def test_op1_classes_are_uneven_and_cover_all_words():
    c = 1e6 / np.arange(1, 5001)
    starts = lm_scoring.class_starts(c, 43)
    sizes = np.diff([*starts, 5000])
    assert starts[0] == 0 and sizes.sum() == 5000 and (sizes > 0).all() and len(starts) <= 43 and sizes[0] < sizes[-1] / 10
    assert lm_scoring.class_starts(np.ones(1), 1).tolist() == [0]


def test_op1_state_goes_on_over_windows():
    r = np.random.default_rng(0)
    shape, p = small_model(r)
    own = [r.integers(0, 13, n).astype(np.int32) for n in (5, 90, 3, 7)]
    a = gru.score(p, shape, own, 0, window=4)
    b = np.array([gru.score(p, shape, [d], 0, window=1000)[0] for d in own])  # state carries over windows and not over documents
    assert np.allclose(a, b, atol=1e-3)


def test_op2_base_rules_and_score(spark, docs, texts):
    import xxhash
    got = {r.doc_id: r for r in quality_rules.judge(docs, table(spark, SF, "labels")).collect()}
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}

    def h(w): return xxhash.xxh64_intdigest(w.encode(), 42)
    def then(a, b): return xxhash.xxh64_intdigest(b.to_bytes(8, "little"), a)

    def grams(t):
        x = [h(w) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
        first = [xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42) for a in x]
        return [a % 2 ** 14 for a in x] + [(then(f, x[i + 1]) if i + 1 < len(x) else f) % 2 ** 14 for i, f in enumerate(first)]
    n = quality_rules.BUCKETS
    raw, trusted, smooth = np.zeros(n), np.zeros(n), quality_rules.SMOOTH
    for i, t in texts.items():
        np.add.at(raw, grams(t), 1)
        if i in good:
            np.add.at(trusted, grams(t), 1)
    p = (raw + smooth) / (raw.sum() + smooth * n)
    q = (trusted + smooth * p * n) / (trusted.sum() + smooth * n)
    weight = np.rint(1000 * np.log(q / p))
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        count, inside = Counter(windows), set()
        for k, x in enumerate(windows):
            if count[x] > 1:
                inside |= {k, k + 1, k + 2}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        score = weight[grams(t)].sum() / max(1, 2 * len(w)) / 1000
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        assert math.isclose(r.score, score, abs_tol=1e-9) and r.base_failed == failed and r.kept == (not failed and score >= quality_rules.THRESHOLD)


def test_op2_can_be_filtered_by_its_verdict(spark):
    """A pushed filter must not work the arrays out again per element."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    docs = spark.createDataFrame([(1, long), (2, "a b c " * 30), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality_rules.judge(docs, labels)
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert {r.doc_id for r in judged.where("kept").collect()} == {i for i, k in kept.items() if k}
    assert {r.doc_id for r in judged.where("not kept and n_repeat_words >= 0").collect()} == {i for i, k in kept.items() if not k}


def test_op3_rules_and_models(spark):
    urls = ["https://A.example.NET/en/1", "http://x.net", "http://x.net/a?b", "http://notnet/a", "ftp://m.a.org/fr/9#top", "http://b.org/de/1",
            "https://example.com/de/x", None, "no scheme", "http://h?x://y/z", ""]
    pages = spark.createDataFrame([(i, u, "<html>", "clash") for i, u in enumerate([*urls, urls[0]])], "page_id long, url string, html string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert [got[i].rule for i in range(7)] == ["example.net/en/", None, "net/", None, "org/fr/", None, "example.com/de/"]
    assert (got[0].host, got[0].path, got[1].path, got[9].host) == ("a.example.net", "/en/1", "", "h")
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "") and got[11].llr == got[0].llr
    assert all(r.verdict in ("allow", "block") for r in got.values())
    real = url_filter.judge(table(spark, SF, "pages")).where("rule is not null")
    assert real.where((F.col("verdict") == "allow") & (F.col("llr") < 0)).count() == 0
    counts = np.random.default_rng(1).integers(0, 3, url_filter.ALPHABET ** 4)
    assert np.allclose(np.exp(url_filter.smoothed(counts)).reshape(-1, url_filter.ALPHABET).sum(axis=1), 1)


def test_op4_and_op9_held_out(spark):
    sf = "/root/testdata/sf0.01"
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    q = quality.score(d, quality.train(d, l)).join(l, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in q]) > 0.97
    t = toxicity.score(d, toxicity.train(d, l)).join(l, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in t]) > 0.93
    assert not [r for r in t if r.predicted and not r.toxic]


def test_op9_learns_rare_terms_and_no_copied_words(spark):
    """A term of 4 % of the toxic texts counts; the words of one copied toxic text do not."""
    rnd, rows = random.Random(5), []
    copied = [f"copied{i}x" for i in range(40)]
    for i in range(1500):
        w = [f"w{rnd.randrange(400)}" for _ in range(30)]
        toxic = i % 3 == 0
        if toxic:
            w[7] = "zorgface" if i % 75 else "blimpet"
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(2000 + i, " ".join([*copied, f"end{i}"]), 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert set(model.terms) == {"zorgface", "blimpet"}
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == y for i, _, y in rows if i < 2000)


def test_op9_automaton_and_quotation():
    terms, rnd = ["idiot", "worthless", "scum", "ab"], random.Random(3)
    own = toxicity.Automaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]
    for _ in range(4000):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i:i + rnd.randint(0, 1)] = rnd.choice(["", "x", "o", "s"])
        word = "".join(w)
        near_by = [(distance(word, t), k) for k, t in enumerate(terms) if distance(word, t) <= toxicity.edits_of(t)]
        assert own.match(word) == (min(near_by) if near_by else None), word
    s = toxicity.Scorer(toxicity.Model(["idiot"], [6.0], set()))
    assert s.evidence(b'he wrote "idiot" again')[1] < s.evidence(b"you idi0t go away")[1] < s.evidence(b"you idiot go away")[1]


def test_op5_equals_full_scoring(docs, texts):
    got = search.top_k(docs.repartition(3), F.col("doc_id") % 50 == 0, k=5).collect()
    bags = {i: Counter(t.encode().lower().split()) for i, t in texts.items()}
    df = Counter(w for b in bags.values() for w in b)
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    idf = {w: math.log1p((n - c + .5) / (c + .5)) for w, c in df.items()}
    for q in [i for i in bags if i % 50 == 0]:
        terms = sorted(bags[q])
        score = {i: sum(idf[w] * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * sum(b.values()) / mean)) for w in terms if w in b) for i, b in bags.items()}
        want = sorted((-round(s, 9), i) for i, s in score.items() if s > 0)[:5]
        assert [(-round(r.score, 9), r.doc_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_op5_finds_a_text_of_its_own_words(spark):
    df = spark.createDataFrame([(0, "alone apart only"), (1, "other words"), (2, "other text")], "doc_id long, text string")
    rows = search.top_k(df, F.col("doc_id") == 0).collect()
    assert [(r.query_id, r["rank"], r.doc_id) for r in rows] == [(0, 1, 0)] and rows[0].score > 0


def test_op5_wand_skips_and_is_exact():
    r = np.random.default_rng(5)
    for _ in range(30):
        lists = [(np.sort(r.choice(4000, n, replace=False)), r.exponential(1, n) * r.choice([.1, 1, 5])) for n in r.integers(1, 1500, 5)]
        got = search.block_max_wand(lists, 10)
        total = np.zeros(4000)
        for d, w in lists:
            total[d] += w
        want = sorted(((s, int(i)) for i, s in enumerate(total) if s > 0), key=lambda x: (-x[0], x[1]))[:10]
        assert [i for _, i in got] == [i for _, i in want] and np.allclose([s for s, _ in got], [s for s, _ in want])
    assert search.block_max_wand.scored < (total > 0).sum()


def test_op6_targets(docs):
    rows = mixing.mix(docs).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    taken, target = Counter(), {}
    for r in rows:
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert math.isclose(sum(target.values()), sum(r.size for r in rows), rel_tol=1e-9)
    assert all(abs(taken[s] - t) <= 0.05 * t + 5 for s, t in target.items())
    assert mixing.shares({"a": 100, "b": 1, None: 100}) == {"b": 3.0, "a": 198 / 4, None: 198 * 3 / 4}


def test_op6_counts_rows_without_an_id_and_ids_of_two_sources(spark):
    rows = [(None, "a b", "s"), (None, "c d e f", "t"), (None, "g h", "t"), (3, "i j k", "s"), (3, "l", "t"), (4, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r.source, r.size, r.source_size) for r in got) == [
        (0, "s", 2, 5), (0, "t", 2, 7), (0, "t", 4, 7), (3, "s", 3, 5), (3, "t", 1, 7), (4, "s", 0, 5)]
    assert math.isclose(sum({r.source: r.target for r in got}.values()), 12)
    again = mixing.repeat(docs, mixing.mix(docs))
    taken, copies = Counter(), Counter((r.doc_id, r.source, r.text) for r in again.collect())
    for (_, source, text), n in copies.items():
        taken[source] += n * len((text or "").split())
    want = Counter()
    for r in got:
        want[r.source] += r.taken
    assert +taken == +want


def test_op7_and_op10_equal_brute_force(spark, docs, texts):
    base = [f"v{i}" for i in range(60)]
    extra = []
    for k in range(40):  # a chain: each a small step from the last; the ends are not alike
        base = base[:]
        base[k] = f"z{k}"
        extra.append((1000 + k, " ".join(base) + "\n" + "tail " * 3))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    own = sorted({**texts, **dict(extra)}.items())
    w = [t.encode().lower().split() for _, t in own]
    want = {own[i][0]: own[c][0] for i, c in enumerate(classes(w))}
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(both).collect()}
    assert {i: c for i, c in got.items()} == want
    places = [(i, k, s, n, x) for i, t in own for k, s, n, x in paragraph_dedup.paragraphs(t.encode())]
    comp = classes([x for *_, x in places])
    size = Counter(comp)
    want = {(places[k][0], places[k][1]): places[c][:2] for k, c in enumerate(comp) if size[c] > 1}
    rows = paragraph_dedup.repeated_paragraphs(both).collect()
    assert {(r.doc_id, r.paragraph): (r.class_doc, r.class_paragraph) for r in rows} == want
    full = dict(own)
    assert all(full[r.doc_id][r.start:r.start + r.length] == full[r.doc_id].split("\n")[r.paragraph] for r in rows)


def test_large_buckets_are_compared_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(near, "SMALL", 3)
    base = [f"v{i}" for i in range(80)]
    rows = [(g * 100 + k, " ".join([f"{x}g{g}" if i < 7 else x for i, x in enumerate(base)][:80 - k % 3])) for g in range(6) for k in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {rows[i][0]: rows[c][0] for i, c in enumerate(classes([t.encode().split() for _, t in rows]))}
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == want


def test_signatures_estimate_similarity():
    rnd, gaps = random.Random(1), []
    for _ in range(20):
        a = [f"w{rnd.randrange(3000)}".encode() for _ in range(300)]
        b = [x if rnd.random() > .03 else b"new" + x for x in a]
        j = near.jaccard(a, b)
        gaps.append(((near_dedup.signature(a, 400) == near_dedup.signature(b, 400)).mean() - j,
                     (np.equal(*paragraph_dedup.minhash([a, b], 400))).mean() - j))
    assert np.abs(np.mean(gaps, axis=0)).max() < 0.03


def test_op8_round_trip(docs, texts):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(packing.default_path())
    own.encode_special_tokens = True
    rows = packing.pack_documents(docs).collect()
    ids = {i: [*own.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r.ids_crc32
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [(r.start, r.length) for r in parts] == packing.cut(len(ids[i]), 1024)
    for members in by_bin.values():
        at = 0
        for o, n in sorted(members):
            assert o == at
            at += n
        assert at <= 1024
    assert len(by_bin) <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_odd_rows(spark, odd, labels):
    n = odd.count()
    assert len([r for r in lm_scoring.score(odd).collect() if r.n_tokens >= 1]) == n
    assert quality_rules.judge(odd, labels).where("kept is not null").count() == n
    assert quality.score(odd, quality.train(odd, labels)).where("score between 0 and 1").count() == n
    assert toxicity.score(odd, toxicity.train(odd, labels)).where("score between 0 and 1").count() == n
    assert {r.query_id for r in search.top_k(odd, F.col("doc_id") % 2 == 0, k=2).collect()} == {4, 6, 8}
    mixed = mixing.mix(odd)
    assert mixed.count() == n - 1 and mixing.repeat(odd, mixed).columns == odd.columns
    rep = paragraph_dedup.repeated_paragraphs(odd)
    assert {(r.doc_id, r.removed) for r in rep.collect()} == {(4, False), (5, True), (6, False), (None, True)}
    cut = paragraph_dedup.without_repeats(odd, rep)
    assert cut.count() == n and cut.columns == odd.columns and cut.where("doc_id is null").first().text == "short line of quite other words"
    judged = near_dedup.near_duplicates(odd)
    assert {(r.doc_id, r.class_id) for r in judged.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (None, None), (7, 7), (8, 7)}
    one = near_dedup.keep_one(odd, judged)
    assert sorted(r.doc_id or 0 for r in one.collect()) == [0, 1, 2, 3, 4, 6, 7] and one.columns == odd.columns
    assert packing.pack_documents(odd).where("length between 1 and 1024").select("doc_id").distinct().count() == 9


def test_empty_tables(spark, odd, labels):
    none, unmarked = odd.limit(0), labels.limit(0)
    assert lm_scoring.score(none).count() == quality_rules.judge(none, unmarked).count() == 0
    assert quality.score(none, quality.train(none, unmarked)).count() == toxicity.score(none, toxicity.train(none, unmarked)).count() == 0
    assert search.top_k(none, F.lit(True)).count() == mixing.mix(none).count() == 0
    assert paragraph_dedup.repeated_paragraphs(none).count() == near_dedup.near_duplicates(none).count() == packing.pack_documents(none).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert quality.score(odd, quality.train(odd, unmarked)).count() == odd.count()
