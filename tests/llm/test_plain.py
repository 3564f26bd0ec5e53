"""Operators 3, 4 and 8 against plain Python versions of their models and plans."""
import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from churnlens.llm import packing, quality, url_filter
from churnlens.llm.common import table

SF = "/root/testdata/sf0.001"
ORDER, ALPHABET = url_filter.ORDER, url_filter.ALPHABET


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[:min(ends)] if ends else rest
    path = rest[len(host):]
    for c in "?#":
        path = path.split(c, 1)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def best_rule(host, path):
    best = None
    for rule in url_filter.RULES:
        at, start = rule.split("/", 1)
        if (host == at or host.endswith("." + at)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return best


def symbols(text):
    out = [0] * ORDER
    for b in text.encode():
        c = chr(b).lower() if b < 128 else "~"
        out.append(ord(c) - 96 if "a" <= c <= "z" else 27 if c.isdigit() else {".": 28, "-": 29, "/": 30}.get(c, 31))
    return out


class Markov:
    """Witten-Bell interpolation, one context at a time."""

    def __init__(self, texts):
        self.n = defaultdict(Counter)
        for t in texts:
            s = symbols(t)
            for i in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    self.n[tuple(s[i - k:i])][s[i]] += 1

    def p(self, context, c):
        lower = self.p(context[1:], c) if context else 1 / ALPHABET
        own = self.n.get(context)
        return lower if own is None else (own[c] + len(own) * lower) / (own.total() + len(own))

    def log(self, text):
        s = symbols(text)
        return sum(math.log(self.p(tuple(s[i - ORDER:i]), s[i])) for i in range(ORDER, len(s)))


def test_op3_equals_plain_models_and_cut(spark):
    pages = table(spark, SF, "pages")
    got = url_filter.judge(pages).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    assert len(got) == len(urls)
    decided = defaultdict(list)
    for u in urls.values():
        host, path = parsed(u)
        if rule := best_rule(host, path):
            decided[url_filter.RULES[rule]].append(host + path)
    assert all(decided[v] for v in ("allow", "block"))
    allow, block = Markov(decided["allow"]), Markov(decided["block"])
    for r in got:
        host, path = parsed(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best_rule(host, path))
        text = host + path
        assert math.isclose(r.llr, (allow.log(text) - block.log(text)) / max(1, len(text.encode())), abs_tol=1e-4)
    known = [(r.verdict, int((r.llr + 5) * (url_filter.BINS / 10))) for r in got if r.rule]
    n = Counter(v for v, _ in known)

    def errors(cut):
        return sum((b < cut) / n["allow"] if v == "allow" else (b >= cut) / n["block"] for v, b in known)
    cuts = [errors(c) for c in range(url_filter.BINS + 1)]
    best = [c for c, e in enumerate(cuts) if e <= min(cuts) + 1e-9]
    cut = (best[0] + best[-1]) / 2 * 10 / url_filter.BINS - 5
    for r in got:
        if r.rule is None and abs(r.llr - cut) > 1e-6:
            assert r.verdict == ("allow" if r.llr > cut else "block")


def test_op3_long_urls_and_clashing_columns(spark):
    long = "http://a.example.org/fr/" + "x/é" * 20_000
    rows = [(1, long, "block", 9.0), (2, long, "allow", 8.0), (3, "http://b.net/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, llr double")
    got = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert got[1].path == got[2].path == "/fr/" + "x/é" * 20_000 and got[1].llr == got[2].llr > 0 > got[3].llr
    assert (got[1].verdict, got[2].verdict, got[3].verdict) == ("allow", "allow", "block")


def plain_features(text):
    w, size = text.split(), len(text)
    if not w:
        return [0.0] * len(quality.NAMES)
    def share(test):
        return sum(map(test, text))
    upper = share(lambda b: 65 <= b <= 90)
    letters = upper + share(lambda b: 97 <= b <= 122)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [math.log(1 + len(w)), sum(len(x) for x in w) / len(w) / 10, upper / max(letters, 1), share(lambda b: b in b"#*$%&|<>~^=_{}[]\\@+") / size,
            text.count(b"!") / size, text.count(b"|") / size, share(lambda b: 48 <= b <= 57) / size, share(lambda b: b >= 128) / size,
            share(lambda b: b in b".,;:") / len(w), sum(a == b for a, b in itertools.pairwise(w)) / len(w), len(set(w)) / len(w) ** 0.9,
            1 - len(set(lines)) / len(lines), math.log(1 + len(w) / len(lines)), sum(x.isupper() for x in w) / len(w),
            sum(x[-1:] in (b"#", b"*", b"$", b"%", b"&", b"|") for x in w) / len(w), sum(x.endswith(b"!") for x in w) / len(w),
            max(w.count(x) for x in set(w)) / len(w)]


def test_op4_scores_equal_plain_features_under_the_fitted_ranking(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    ranker = quality.train(docs, labels)
    assert np.allclose(quality.train(docs.repartition(7), labels.repartition(3)).weight, ranker.weight)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    got = {r.doc_id: r for r in quality.score(docs, ranker).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        x = plain_features(t)
        assert np.allclose(quality.features(t), x)
        z = np.clip((np.array(x) - ranker.mean) / ranker.scale, -8, 8)
        strength = float(z @ ranker.weight[:len(z)] + (z * z / 8) @ ranker.weight[len(z):])
        want = 1 / (1 + math.exp(-min(30.0, max(-30.0, ranker.slope * (strength - ranker.cut)))))
        assert math.isclose(got[i].score, want, abs_tol=1e-9)
        assert abs(want - 0.5) < 1e-9 or got[i].predicted == int(want >= 0.5)
    kept = {r.doc_id for r in quality.accepted(docs, ranker).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


@pytest.mark.parametrize("good, bad", [(40, 9), (7, 30), (12, 12)])
def test_op4_contests_and_optimum(good, bad):
    r = np.random.default_rng(good)
    y = np.r_[np.ones(good, int), np.zeros(bad, int)]
    x = r.standard_normal((len(y), len(quality.NAMES))) + y[:, None] * r.standard_normal(len(quality.NAMES)) * .3
    won, lost = quality.contests(y)
    assert (y[won] == 1).all() and (y[lost] == 0).all() and len(won) == quality.PAIRS * max(good, bad)
    met = np.bincount(np.r_[won, lost], minlength=len(y))
    assert met.min() >= quality.PAIRS  # the rows of the rarer class meet more
    ranker = quality.fit_ranker(x, y)
    z = np.clip((x - ranker.mean) / ranker.scale, -8, 8)
    z = np.hstack([z, z * z / 8])
    w, l2 = ranker.weight, 1e-3 * len(won) / len(quality.NAMES)

    def loss(w):
        return sum(math.log1p(math.exp(-float((z[a] - z[b]) @ w))) for a, b in zip(won, lost, strict=True)) + l2 / 2 * float(w @ w)
    for k in range(len(w)):  # no step along any weight lowers the loss
        for step in (1e-2, -1e-2):
            near = w.copy()
            near[k] += step
            assert loss(near) > loss(w)
    strengths = z @ w
    assert strengths.min() <= ranker.cut <= strengths.max()


def test_op8_two_fit_equals_all_pairs():
    r = np.random.default_rng(4)
    for _ in range(400):
        left = np.where(r.random(41) < .3, r.integers(1, 3, 41), 0)
        left[0] = 0
        room = int(r.integers(2, 41))
        above = int(r.integers(1, room))
        sizes = [z for z in range(1, 41) for _ in range(left[z])]
        sums = [a + b for a, b in itertools.combinations(sizes, 2) if above < a + b <= room]
        got = packing._two(left, above, room)
        assert (got is None) == (not sums)
        if got:
            assert sum(got) == max(sums) and all(left[z] >= n for z, n in Counter(got).items())


def test_op8_replaces_the_smallest_by_two():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]  # greedy alone: 6 + 3, 2 + 2
    assert packing.plan({7: 100, 3: 100}, 10) == [(100, [(7, 1), (3, 1)])]
    assert packing.plan({}, 10) == []


def test_op8_plans_use_every_piece_once_and_fill_well():
    r = np.random.default_rng(6)
    for capacity in (7, 64, 1024):
        for _ in range(12):
            counts = {int(z): int(r.integers(1, 500)) for z in r.integers(1, capacity + 1, 30)}
            used, bins = Counter(), 0
            for times, members in packing.plan(counts, capacity):
                assert sum(z * u for z, u in members) <= capacity and times > 0
                bins += times
                for z, u in members:
                    used[z] += u * times
            assert used == counts
            assert bins <= 11 / 9 * best_possible(counts, capacity) + 1


def best_possible(counts, capacity):
    """A bound no packing beats: all tokens, or all pieces over half a bin."""
    return max(math.ceil(sum(z * c for z, c in counts.items()) / capacity), sum(c for z, c in counts.items() if 2 * z > capacity))
