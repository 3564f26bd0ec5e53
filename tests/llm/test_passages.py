"""The places and keys of passages against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from churnlens.llm import near, passages


def plain_windows(texts, gone):
    for i, (text, off) in enumerate(zip(texts, gone, strict=True)):
        at, words = 0, []
        for k, line in enumerate(text.split("\n")):
            if k not in (off or ()):
                words += [(k, at + m.start(), at + m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
            at += len(line) + 1
        for s in range(len(words) - passages.PASSAGE + 1):
            own = words[s:s + passages.PASSAGE]
            yield i, own[0][0], own[0][1], own[-1][2], tuple(w for *_, w in own)


def test_windows_are_those_of_plain_python_and_come_in_bounded_batches(monkeypatch):
    rnd = random.Random(5)
    vocab = ["a", "Éa", "é b", "word", "WORD", "😀", "x" * 100, "x" * 99 + "y", " "]
    texts = ["".join(rnd.choice(vocab) + rnd.choice(" \n\t ") for _ in range(rnd.randrange(120))) for _ in range(60)]
    texts += ["", "\n\n", "one", texts[0], texts[1] + " tail"]
    gone = [None if rnd.random() < 0.5 else sorted({rnd.randrange(t.count("\n") + 1) for _ in range(2)}) for t in texts]
    batch = pa.RecordBatch.from_pydict({
        "row": pa.array(range(len(texts)), pa.int64()), "doc_id": pa.array([None if i % 7 == 0 else i for i in range(len(texts))], pa.int64()),
        "body": pa.array(range(len(texts)), pa.int64()), "text": pa.array([t.encode() for t in texts], pa.binary()),
        "gone": pa.array(gone, pa.list_(pa.int32()))})
    every = np.full(1 << near.BITS - 3, 255, np.uint8)
    want = sorted(plain_windows(texts, gone))
    for size in (1 << 20, 700):
        monkeypatch.setattr(passages, "CHUNK", size)
        parts = list(passages._windows(every)([batch]))
        got = pa.Table.from_batches(parts).to_pylist()
        assert sorted((r["row"], r["paragraph"], r["start"], r["stop"]) for r in got) == [w[:4] for w in want]
        words = {w[:4]: w[4] for w in want}
        keys = {(r["key"], words[r["row"], r["paragraph"], r["start"], r["stop"]]) for r in got}
        assert len(keys) == len({k for k, _ in keys}) == len({w for _, w in keys})
        assert all(r["doc_id"] == (None if r["row"] % 7 == 0 else r["row"]) for r in got)
    assert len(parts) > 5  # before: a batch of Arrow made one batch, however large


def test_shingles_of_several_items_are_those_of_each():
    for items in ([[b"a"] * 10, [b"b", b"c"] * 9, [b"%d" % i for i in range(40)]], [[b"a"], [b"a", b"b"] * 6]):
        flat, at = near.shingles_of(items)
        own = [near.shingles(w) for w in items]
        assert np.array_equal(flat, np.concatenate(own)) and at.tolist() == np.cumsum([0, *map(len, own)])[:-1].tolist()
