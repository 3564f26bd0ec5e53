"""Spelling variant grouping by finite-state composition.

The vocabulary acceptor A, composed with a transducer T of exactly one edit and
with A again, accepts the pairs of words that one inserted, deleted or replaced
code point tells apart.  The composition is dealt by initial states:

1. A pair whose longer word has ``l`` code points agrees outside one of the two
   halves of these ``l`` places.  So a word starts in four places: as one of
   length ``l`` and as the shorter partner of length ``l + 1``, each once with
   its first half read (the initial state is the acceptor's after that prefix)
   and once with its last half read (the state of the reversed acceptor).
2. The words of one initial state (``l``, prefix, suffix) are one group.  A
   group above ``most`` code points is split again by the same step, which
   halves the unread places; with one place unread a group has no more words
   than there are letters, so every group is bounded and none is cut.
3. Inside a task the group's unread parts become a minimal acyclic acceptor,
   which is composed with T and with itself.  T is unambiguous: an inserted
   symbol must differ from the one that follows it, so that a pair is accepted
   on one path, in one group only.  Pairs are ranks of words (each state knows
   how many words it accepts) and leave the task added up per word.

Null texts have no words; a null id is the empty text in the hash's input.
Repeated rows count as often as they stand; texts of any length are read whole;
other columns are ignored; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ascii_lower, map_arrow
from churnlens.session import cut_lineage

LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, MOST = 5, 3, 1 << 18
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])
KEY = ["l", "prefix", "suffix"]


# ------------------------------------------------------------------ vocabulary

def damaged(run: Column, doc_id: Column, every: int = 97) -> Column:
    """``run`` without its code point h % length where ``every`` divides
    h = crc32 of ``<doc_id>:<run>``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): words of at least ``shortest`` code points that occur at least
    ``least`` times.  A run shorter than that cannot become a word, so the
    pattern leaves it out."""
    runs = docs.select(F.col("doc_id").alias("id"), F.explode(F.regexp_extract_all(
        F.col("text").cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    lower = F.when(F.col("run") == F.lower("run"), F.col("run")).otherwise(ascii_lower(F.col("run")))
    return (runs.select("id", lower.alias("run")).select(damaged(F.col("run"), F.col("id")).alias("word"))
            .where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least))


# ------------------------------------------------------------------ initial states

def starts(words: DataFrame) -> DataFrame:
    """Each word as the longer (or equal) and as the shorter one of a pair, with nothing read yet."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("l")
    return words.select(longer, F.lit("").alias("prefix"), F.lit("").alias("suffix"), F.col("word").alias("rest"), "n")


def split(members: DataFrame) -> DataFrame:
    """Read the first, or the last, half of the places that are unread."""
    unread = F.col("l") - F.length("prefix") - F.length("suffix")
    m = F.floor(unread / 2).cast("int")
    tail = (unread - m).cast("int")  # places of the last half
    keep = F.length("rest") - tail
    two = F.array(
        F.struct(F.concat("prefix", F.substring("rest", F.lit(1), m)).alias("prefix"), F.col("suffix").alias("suffix"),
                 F.substring(F.col("rest"), m + 1, F.length("rest")).alias("rest")),
        F.struct(F.col("prefix").alias("prefix"), F.concat(F.substring("rest", keep + 1, tail), "suffix").alias("suffix"),
                 F.substring(F.col("rest"), F.lit(1), keep).alias("rest")))
    return members.select("l", "n", F.explode(two).alias("s")).select("l", "s.prefix", "s.suffix", "s.rest", "n")


def initial_state_groups(words: DataFrame, most: int = MOST) -> DataFrame:
    """A row per initial state: its key, unread parts and counts; only states of two words or more."""
    members, done = split(starts(words)), None
    while True:
        unread = F.col("l") - F.length("prefix") - F.length("suffix")
        hot = cut_lineage(members.groupBy(*KEY).agg(F.sum(F.length("rest") + 1).alias("size"))
                          .where((F.col("size") > most) & (unread > 1)).select(*KEY))
        large = not hot.isEmpty()
        part = members.join(hot, KEY, "left_anti") if large else members
        part = (part.groupBy(*KEY).agg(F.collect_list(F.struct("rest", "n")).alias("m")).where(F.size("m") > 1)
                .select(*KEY, F.col("m.rest").alias("rests"), F.col("m.n").alias("ns")))
        done = part if done is None else done.unionByName(part)
        if not large:
            return done
        members = cut_lineage(split(members.join(hot, KEY, "left_semi")))


# ------------------------------------------------------------------ acceptor and composition

def acceptor(words: Sequence[str]) -> tuple[list[dict], list[int]]:
    """Minimal acyclic acceptor of sorted distinct words.  A state maps each of
    its symbols to (state, words that sort before that arc's); '' stands for
    accepting here.  Targets have smaller numbers, the start state the largest.
    Second: how many words each state accepts."""
    arcs, counts, known = [], [], {}

    def close(node: dict) -> int:
        key = tuple(node.items())
        if (own := known.get(key)) is None:
            own, before, out = len(arcs), 0, {}
            for c, to in key:
                out[c] = (to, before)
                before += counts[to] if c else 1
            known[key] = own
            arcs.append(out)
            counts.append(before)
        return own

    path, last = [{}], ""
    for w in words:
        k, end = 0, min(len(w), len(last))
        while k < end and w[k] == last[k]:
            k += 1
        for at in range(len(last), k, -1):
            path[at - 1][last[at - 1]] = close(path.pop())
        path.extend({} for _ in range(len(w) - k))
        path[-1][""] = -1
        last = w
    for at in range(len(last), 0, -1):
        path[at - 1][last[at - 1]] = close(path.pop())
    close(path[0])
    return arcs, counts


def shared(arcs: list[dict], counts: list[int], s: int, t: int, i: int, j: int, out: list) -> None:
    """Append the rank pairs of the words that both states accept; ranks begin at i and j."""
    todo = [(s, t, i, j)]
    while todo:
        s, t, i, j = todo.pop()
        if s == t:
            out.extend((i + k, j + k) for k in range(counts[s]))
            continue
        own, other = arcs[s], arcs[t]
        for c in own.keys() & other.keys():
            (a, x), (b, y) = own[c], other[c]
            if c:
                todo.append((a, b, i + x, j + y))
            else:
                out.append((i + x, j + y))


def compose(words: Sequence[str], context: bool = False) -> list[tuple[int, int]]:
    """A o T o A on sorted distinct words: rank pairs (i, j), each once; word i
    is word j with one symbol more, or with one replaced (then i < j).
    ``context``: the last symbol of all words is what follows the unread part;
    T may look at it but not insert it."""
    arcs, counts = acceptor(words)
    reached: list[list[int]] = [[] for _ in arcs]
    reached[-1] = [0]
    pairs = []
    for q in range(len(arcs) - 1, -1, -1):
        local, own = [], arcs[q]
        items = [(c, to, x) for c, (to, x) in own.items() if c]
        for k, (c, to, x) in enumerate(items):
            reached[to].extend(at + x for at in reached[q])
            for _, other, y in items[k + 1:]:  # T replaces c
                shared(arcs, counts, to, other, x, y, local)
            after = arcs[to]                   # T inserts c; the next symbol differs from c
            for d in after.keys() & own.keys():
                if d != c:
                    (a, y), (b, z) = after[d], own[d]
                    if d:
                        shared(arcs, counts, a, b, x + y, z, local)
                    elif not context:
                        local.append((x + y, z))
        pairs.extend((at + i, at + j) for at in reached[q] for i, j in local)
    return pairs


def _near(batch: pa.RecordBatch) -> dict:
    """Per word of each group: near words found there, the commonest of them and its count."""
    out: dict[str, list] = {f.name: [] for f in NEAR}
    for l, prefix, suffix, rests, ns in zip(*(batch.column(c).to_pylist() for c in (*KEY, "rests", "ns"))):
        unread, nxt = l - len(prefix) - len(suffix), suffix[:1]
        members = sorted(zip(rests, ns), key=lambda m: m[0] + nxt)
        tally: dict[int, list] = {}
        for i, j in compose([r + nxt for r, _ in members], bool(nxt)):
            if len(members[i][0]) < unread:  # two shorter words: another group's pair
                continue
            for a, b in ((i, j), (j, i)):
                best = (-members[b][1], prefix + members[b][0] + suffix)
                if a in tally:
                    tally[a][0] += 1
                    tally[a][1] = min(tally[a][1], best)
                else:
                    tally[a] = [1, best]
        for a, (n, (form_n, form)) in tally.items():
            out["word"].append(prefix + members[a][0] + suffix)
            out["n_near"].append(n)
            out["form"].append(form)
            out["form_n"].append(-form_n)
    return out


# ------------------------------------------------------------------ forms and roots

def forms(words: DataFrame, most: int = MOST, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n): the form is the near word of largest n
    (ties: smallest in code-point order) if it is ``ratio`` times as common."""
    near = map_arrow(initial_state_groups(words, most), _near, NEAR)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"),
                         F.lit(None).cast("long").alias("form_n")).unionByName(near.withColumn("n", F.lit(None).cast("long")))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("o"), F.col("form"))))
    one = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    is_form = -F.col("b.o") >= ratio * F.col("n")
    return one.select("word", "n", "n_near", F.when(is_form, F.col("b.form")).alias("form"),
                      F.when(is_form, -F.col("b.o")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by pointer doubling: a form
    is commoner than its word, so chains end; rounds are the logarithm of the
    longest one."""
    links = cut_lineage(links.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut_lineage(links.drop("moved").join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            return links.drop("moved")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Every word of the vocabulary with its form and the root of its group."""
    words = cut_lineage(vocabulary(docs, shortest, least))
    table = cut_lineage(forms(words, most))
    out = table.join(roots(table), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
