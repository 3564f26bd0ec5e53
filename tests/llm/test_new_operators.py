"""Spelling variants, Merkle manifest and chat formatting against brute force, and on odd inputs."""
import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from churnlens.llm import chat, merkle, queries, variants
from churnlens.llm.common import table

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ spelling variants

def one_edit(a, b):
    """Exactly one inserted, deleted or replaced code point, straight from the definition."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def grouped(words):
    """{word: (form, root, n, n_near, form_n)} by comparing all words."""
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words}


def counted(rows):
    words = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            if h % 97 == 0:
                low = low[:h % len(low)] + low[h % len(low) + 1:]
            if len(low) >= 5:
                words[low] += 1
    return {w: n for w, n in words.items() if n >= 3}


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_op11_query_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    got = result(queries.op11_spelling_variants(spark, SF))
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert got == grouped(words) and sum(f is not None for f, *_ in got.values()) > 50
    assert any(r != f for f, r, *_ in got.values() if f)  # chains of two links and more


def test_op11_composition_accepts_each_pair_once():
    rnd = random.Random(1)
    for _ in range(300):
        words = sorted({"".join(rnd.choice("abé") for _ in range(rnd.randint(0, 5))) for _ in range(rnd.randint(1, 60))})
        got = [tuple(sorted(p)) for p in variants.compose(words)]
        want = {(i, j) for j, b in enumerate(words) for i, a in enumerate(words[:j]) if one_edit(a, b)}
        assert len(got) == len(set(got)) and set(got) == want
    arcs, counts = variants.acceptor(["abc", "abd", "xbc", "xbd"])  # minimal: the suffixes are one path
    assert len(arcs) == 4 and counts[-1] == 4


@pytest.mark.parametrize("most", [1, 30, 1 << 18])
def test_op11_split_groups_lose_nothing(spark, most):
    """Every size of group, down to one unread place, gives the same answer."""
    rnd = random.Random(2)
    words = {"".join(rnd.choice("ab") for _ in range(rnd.randint(5, 9))): rnd.randint(3, 99) for _ in range(300)}
    words |= {"z" * 5000: 3, "z" * 4999 + "y": 9, "z" * 5001: 40}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    table = variants.forms(df, most).cache()
    roots = {r.word: r.root for r in variants.roots(table).collect()}
    got = {r.word: (r.form, roots.get(r.word, r.word), r.n, r.n_near, r.form_n) for r in table.collect()}
    assert got == grouped(words)


def test_op11_odd_rows(spark):
    ddl = "doc_id long, text string, word string, n long, form string"
    long = "abcdefgh " * 40_000 + "q" * 200_000
    rows = [(1, None), (2, ""), (3, long), (3, "abcdefgx ABCDEFGX"), (3, "abcdefgx ABCDEFGX"), (None, "abcdefgx Éabcd éabcd"), (4, "tiny a b")]
    df = spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in rows], ddl)
    got = result(variants.variants(df))
    assert got == grouped(counted(rows)) and got["abcdefgx"][0] == "abcdefgh"
    assert variants.variants(df.limit(0)).count() == 0


# ------------------------------------------------------------------ Merkle manifest

def leaf(row, extra=0):
    def one(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    n = row["n_chars"] if row["n_chars"] is None else row["n_chars"] + extra
    return sha("".join(map(one, (row["doc_id"], row["source"], row["lang"], n, row["text"]))))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i:i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def manifest(rows):
    """The contract by plain recursion over whole trees: a list of result rows."""
    langs = {}
    for r in rows:
        langs.setdefault(r["lang"], []).append(r)
    for k, own in langs.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([leaf(r) for r in langs[k]]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for g, k in enumerate(order):
        for i, r in enumerate(langs[k]):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node, proof = leaf(r, int(hit)), ""
            for levels, at in ((trees[k], i), (top, g)):
                for level in levels[:-1]:
                    pair = [level[x] for x in (at - at % 2, at - at % 2 + 1) if x < len(level)]
                    proof += "".join(pair[1 - at % 2:2 - at % 2])
                    pair[at % 2] = node
                    node, at = sha("".join(pair)), at // 2
            out.append((r["doc_id"], leaf(r), trees[k][-1][0], top[-1][0], sha(proof), node, node == top[-1][0]))
    return out


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def as_rows(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=repr)


@pytest.mark.parametrize("bits", [1, 3, merkle.BITS])
def test_op12_equals_brute_force_at_every_block_size(spark, bits):
    docs = table(spark, SF, "documents")
    want = sorted(manifest([r.asDict() for r in docs.collect()]), key=repr)
    assert as_rows(merkle.manifest(docs, merkle.tampered(), bits)) == want
    assert {r[-1] for r in want} == {True, False}


def test_op12_query_and_path(spark):
    rows = queries.op12_merkle_manifest(spark, SF)
    assert rows.columns == COLS and rows.where("verified").count() + rows.where("leaf is not null and not verified").count() == 200
    whole = merkle.manifest(table(spark, SF, "documents")).collect()
    assert all(r.verified and len(r.sides) <= 10 for r in whole)


def test_op12_odd_rows(spark):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root string, tree string, idx long"
    big = 2 ** 62 + 1
    own = [(1, None, None, None, None), (1, "", "", "s", 0), (None, "x", None, "s", 2 ** 63 - 1), (None, "x", None, "s", 2 ** 63 - 1),
           (14, "é\n" * 200_000, "en", "s", 7), (14, "dup", "en", "s", 7), (14, "dup", "en", "s", 7), (big, "t", "en", "s", 1), (big + 1, "u", "en", "s", 2 ** 63 - 1),
           *[(i, f"t{i}", "zz", "s", i) for i in range(20)], (5, "only", "é", "s", 1)]
    df = spark.createDataFrame([(*r, "clash", "clash", "clash", 5) for r in own], ddl)
    want = sorted(manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in own]), key=repr)
    for bits in (1, 2, 9):
        assert as_rows(merkle.manifest(df, merkle.tampered(), bits)) == want
    assert merkle.manifest(df.limit(0)).count() == 0
    one = merkle.manifest(df.where("text = 'only'")).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.sides == ""


# ------------------------------------------------------------------ chat formatting

QUOTING = "\\### Assistant: </turn> ok"


def written(turns):
    """The template of chat.py in plain Python: (formatted, loss texts)."""
    def esc(t):
        t = re.sub("#(?=##)", r"#\\", t.replace("\\", "\\\\"))
        return t.replace("</turn>", "<\\/turn>").replace("<next>", "<\\next>")
    out, last = "", None
    for role, text in turns:
        if last is not None and last != role:
            out += "</turn>\n"
        out += "<next>" if last == role else f"### {role}:\n"
        out += esc(text)
        last = role
    return out + "</turn>\n"


def chats(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def check_chats(df, rows):
    formatted = chat.format_chats(df)
    own = chats(rows)
    got = {r.conv_id: r for r in formatted.collect()}
    for c, turns in own.items():
        assert got[c].formatted == written(turns)
        under = [got[c].formatted[s.start:s.start + s.length] for s in got[c].loss]
        assert [re.sub(r"(?s)\\(.)", r"\1", u) for u in under] == [x for r, x in turns if r == "assistant"]
    digests = {r.conv_id: r for r in chat.digests(formatted).collect()}
    assert digests.keys() == own.keys()
    for c, turns in own.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert tuple(digests[c])[1:] == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said), len(written(turns)))


def test_op13_query_round_trip(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table(spark, SF, "conversations").collect()]
    rows += [(-7, 0, "user", QUOTING), (-7, 1, "assistant", QUOTING)]
    got = {r.conv_id: r for r in queries.op13_chat_formatting(spark, SF).collect()}
    check_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), rows)
    assert len(got) == len(chats(rows)) and got[-7].loss_sha256 == sha(QUOTING) and got[-7].n_turns == 2


def test_op13_control_strings_of_every_kind(spark):
    rnd, rows = random.Random(3), []
    marks = ["\\", "#", "##", "### ", "</turn>", "</turn", "<next>", "<nex", "\n", ":\n", "a", "é", "$1", "<\\next>", "\U0001f600", "%20", "+"]
    for c in range(150):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant", "assistant", "a:\nb%", "<next>"]), "".join(rnd.choice(marks) for _ in range(rnd.randint(0, 9)))))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_chats(df)).collect()}
    for c, turns in chats(rows).items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert tuple(got[c])[1:5] == (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(said), sha(said)), turns


def test_op13_odd_rows(spark):
    ddl = "conv_id long, turn long, role string, text string, t string, formatted string, loss int"
    rows = [(1, None, None, None), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (1, 1, "assistant", "x" * 300_000), (None, 3, "user", "no id"),
            (2, 5, "user", "b"), (2, 5, "user", "a"), (2, 4, "assistant", "tie"), (3, 0, "user", None)]
    rows += [(9, k, "assistant" if k % 3 else "user", f"turn {k} ###") for k in range(3000)]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows], ddl).repartition(5)
    check_chats(df, rows)
    kept = chat.digests(chat.format_chats(df))
    assert kept.where(F.col("n_turns") > 2).count() == 3  # a filter on the digests ends as well
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0
