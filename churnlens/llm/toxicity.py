"""Toxicity by a lexicon with misspellings and the context of each hit.

The lexicon is learned from labelled documents: words that stand in toxic ones
far more often than chance allows.  It is held as a trie; the
Levenshtein automaton of every term (distance 1, or 2 from eight letters on)
runs over the trie at once: a state is a set of (trie node, edits so far), and
states are built when a text first needs them, so a word costs a table look-up
a letter and most words die after three or four.  A word that clean labelled
documents use is nobody's misspelling.

A hit weighs its term's log-odds, less for each edit, and far less inside
quotation marks that open and close within the window of words around it or
after a reporting word.  A document's evidence (sum, greatest hit, hits a word,
unquoted and quoted counts) goes through a logistic curve fitted to the labels.

Fitting uses at most about ``LABELLED`` labelled rows (a stated bound), near
copies of which count once; every significant word of theirs is a term.  Scoring
maps over all whole texts without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm import near
from churnlens.llm.common import fold, labelled_sample, logistic, map_arrow, text_bytes
from churnlens.session import cut_lineage

LABELLED, FOLDS, HELD_OUT, WINDOW = 20_000, 3, 1, 5
P, EDIT, QUOTED, CUT = 0.05, 0.85, 0.2, 0.7
COPIES = 3  # least shingles, any of which two copies share
EDGE = b".,!?;:\"'()[]{}<>*#$%&|"
OPENING, CLOSING = ('"', "“", "«", "'", "‘"), ('"', "”", "»", "'", "’")
REPORTING = {b"said", b"says", b"quoted", b"quote", b"wrote", b"called", b"word", b"term"}
COUNTS = pa.schema([("word", pa.binary()), ("t", pa.int64()), ("c", pa.int64())])
LEAST = pa.schema([("y", pa.int32()), ("text", pa.binary()), *[(f"m{i}", pa.int64()) for i in range(COPIES)]])
EVIDENCE = pa.schema([("y", pa.int32()), ("x", pa.list_(pa.float64()))])
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def edits_of(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """Levenshtein automata of a lexicon, intersected with its trie."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[int] = [-1]  # of the node
        self.reach: list[int] = [0]  # most edits of a term below the node
        self.spare = [edits_of(t) for t in terms]
        for k, t in enumerate(terms):
            at = 0
            self.reach[0] = max(self.reach[0], self.spare[k])
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.reach.append(0)
                at = self.children[at][c]
                self.reach[at] = max(self.reach[at], self.spare[k])
            self.term[at] = k
        self.ids: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.start = self._state({0: 0})

    def _state(self, cost: dict[int, int]) -> int:
        """Number of a state; -1 for the empty one.  Closes it under skipping a
        letter of a term."""
        queue = list(cost)
        while queue:
            n = queue.pop()
            for m in self.children[n].values():
                e = cost[n] + 1
                if e <= self.reach[m] and e < cost.get(m, 99):
                    cost[m] = e
                    queue.append(m)
        if not cost:
            return -1
        key = tuple(sorted(cost.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            ends = [(e, self.term[n]) for n, e in key if self.term[n] >= 0 and e <= self.spare[self.term[n]]]
            self.accepts.append(min(ends) if ends else None)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        cost: dict[int, int] = {}
        for n, e in self.sets[state]:
            for x, m in self.children[n].items():
                f = e + (x != c)  # the letter itself, or another in its place
                if f <= self.reach[m] and f < cost.get(m, 99):
                    cost[m] = f
            if e + 1 <= self.reach[n] and e + 1 < cost.get(n, 99):  # a letter too many
                cost[n] = e + 1
        out = self._state(cost)
        self.next[state][c] = out
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term within its distance."""
        state = self.start
        for c in word:
            after = self.next[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return None
        return self.accepts[state]


@dataclass
class Model:
    terms: list[str]
    weight: list[float]
    clean: set[str]
    curve: np.ndarray = field(default_factory=lambda: np.zeros(6))


class Memory(dict):
    """Word -> weight, worked out when first asked for; emptied when full."""
    MOST = 500_000

    def __init__(self, look):
        super().__init__()
        self.look = look

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.MOST:
            self.clear()
        got = self[word] = self.look(word)
        return got


class Scorer:
    """A task's copy of a model, with the automaton's states built so far."""

    def __init__(self, model: Model):
        self.model, self.automaton = model, Automaton(model.terms)
        self.exact = {t.encode(): k for k, t in enumerate(model.terms)}
        self.known = Memory(self.strength)

    def strength(self, word: bytes) -> float:
        """Weight of a raw word, 0 if it is no hit."""
        bare = word.strip(EDGE)
        k = self.exact.get(bare)
        if k is not None:
            return self.model.weight[k]
        text = bare.decode("utf-8", "replace")
        hit = self.automaton.match(text)
        return 0.0 if hit is None or text in self.model.clean else self.model.weight[hit[1]] * EDIT ** hit[0]

    def evidence(self, text: bytes) -> list[float]:
        w = text.lower().split()
        weights = list(map(self.known.__getitem__, w))
        hits = [(i, s) for i, s in enumerate(weights) if s] if any(weights) else []
        if not hits:
            return [0.0] * 5
        total = greatest = 0.0
        said = 0
        for i, s in hits:
            if quoted(w, i):
                said += 1
                s *= QUOTED
            total += s
            greatest = max(greatest, s)
        return [np.log1p(total), greatest, np.log1p(1000 * total / len(w)), np.log1p(len(hits) - said), np.log1p(said)]


def quoted(w: list[bytes], i: int) -> bool:
    """Within quotation marks that open before and close after word ``i``, both
    within the window, or after a reporting word in it."""
    before = [x.decode("utf-8", "replace") for x in w[max(0, i - WINDOW):i + 1]]
    after = [x.decode("utf-8", "replace") for x in w[i:i + WINDOW + 1]]
    opened = next((k for k, x in enumerate(reversed(before)) if x.startswith(OPENING)), None)
    shut = next((k for k, x in enumerate(after) if x.rstrip(".,!?;:").endswith(CLOSING)), None)
    closed_before = opened is not None and any(x.rstrip(".,!?;:").endswith(CLOSING) for x in before[len(before) - 1 - opened:-1])
    inside = opened is not None and shut is not None and not closed_before
    return inside or any(x.strip(EDGE) in REPORTING for x in w[max(0, i - WINDOW):i])


def significant(toxic: int, clean: int, words: int) -> Column:
    """Whether a word of ``t`` toxic and ``c`` clean documents stands in toxic
    ones more often than not, and its likelihood ratio against chance is
    significant among all words tried."""
    t, c, base = F.col("t"), F.col("c"), toxic / (toxic + clean)
    n = t + c
    gain = 2 * (F.when(t > 0, t * F.log(t / (n * base))).otherwise(0.0) + F.when(c > 0, c * F.log(c / (n * (1 - base)))).otherwise(0.0))
    return (2 * t > n) & (gain >= float(2 * np.log(max(words, 1) / P)))


def lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[list[str], list[float]]:
    """Terms and their weights (log-odds, 6 at most) from the (word, toxic
    documents, clean documents) of significant words of three letters or more."""
    odds = [(word, float(np.log((t + .5) / (toxic - t + .5)) - np.log((c + .5) / (clean - c + .5)))) for word, t, c in counts if len(word) >= 3]
    odds.sort(key=lambda x: (-x[1], x[0]))
    return [w for w, _ in odds], [min(o, 6.0) for _, o in odds]


def independent(own: DataFrame) -> DataFrame:
    """(y, text): of rows of one label that share one of ``COPIES`` least
    shingles, so of near copies, the first by text.  The rows are few (bounded)."""
    def least(b: pa.RecordBatch):
        out = {"y": b.column(0), "text": b.column(1)} | {f"m{i}": [] for i in range(COPIES)}
        for text in b.column(1).to_pylist():
            w = text.lower().split()
            x = near.shingles(w) if w else np.zeros(1, np.uint64)
            for i in range(COPIES):
                out[f"m{i}"].append(int(near.mixed(x ^ near.seed(i)).min().astype(np.int64)))
        return out
    own = cut_lineage(map_arrow(own, least, LEAST))
    for i in range(COPIES):
        own = own.withColumn("_k", F.row_number().over(Window.partitionBy("y", f"m{i}").orderBy("text"))).where("_k = 1").drop("_k")
    return cut_lineage(own.select("y", "text"))


def train(docs: DataFrame, labels: DataFrame, bound: int = LABELLED) -> Model:
    """From the labelled rows outside the held-out fold; without labels of both
    classes every score is the curve at no evidence."""
    own = labelled_sample(docs.sparkSession, docs.select("doc_id", text_bytes()), labels, "toxic", bound, FOLDS, HELD_OUT)
    own = independent(own.select(F.col("y").cast("int").alias("y"), "text"))

    def count(b: pa.RecordBatch):
        n = {0: Counter(), 1: Counter()}
        for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n[y].update({x.strip(EDGE) for x in text.lower().split()})
        words = list(n[0].keys() | n[1].keys())
        return {"word": words, "t": [n[1][x] for x in words], "c": [n[0][x] for x in words]}
    total = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    toxic, clean = total.get(1, 0), total.get(0, 0)
    if not toxic or not clean:
        return Model([], [], set(), np.array([0, 0, 0, 0, 0, 8.0 if toxic else -8.0]))
    words = cut_lineage(map_arrow(own, count, COUNTS).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    high = words.where(significant(toxic, clean, words.count())).collect()  # the lexicon, which every scoring task holds
    terms, weight = lexicon([(bytes(r["word"]).decode("utf-8", "replace"), r["t"], r["c"]) for r in high], toxic, clean)
    automaton_terms = list(terms)

    def near(b: pa.RecordBatch):
        match, known = Automaton(automaton_terms).match, set(automaton_terms)
        hit = [x for x in b.column(0).to_pylist() if (s := x.decode("utf-8", "replace")) not in known and match(s)]
        return {"word": hit}
    own_words = map_arrow(words.where("c > 0 and c * 4 > t").select("word"), near, pa.schema([("word", pa.binary())]))
    model = Model(terms, weight, {bytes(r["word"]).decode("utf-8", "replace") for r in own_words.collect()})

    def look(b: pa.RecordBatch):
        scorer = Scorer(model)
        return {"y": b.column(0), "x": [scorer.evidence(t) for t in b.column(1).to_pylist()]}
    rows = map_arrow(own, look, EVIDENCE).collect()  # bounded by ``bound``
    x, y = np.array([r["x"] for r in rows]).reshape(-1, 5), np.array([r["y"] for r in rows], dtype=float)
    # both classes weigh the same; at no evidence the curve must stay low
    model.curve = logistic(x, y, l2=1.0, weight=np.where(y == 1, 0.5 / max(toxic, 1), 0.5 / max(clean, 1)) * len(y))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null texts count as
    empty, a null id is not held out."""
    state: dict = {}

    def run(b: pa.RecordBatch):
        scorer = state.setdefault("scorer", None) or state.update(scorer=Scorer(model)) or state["scorer"]
        x = np.array([scorer.evidence(t) for t in b.column(1).to_pylist()])
        return {"doc_id": b.column(0), "score": 1 / (1 + np.exp(-np.clip(x @ model.curve[:-1] + model.curve[-1], -30, 30)))}
    out = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, SCORES)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= CUT).cast("int").alias("predicted"))
