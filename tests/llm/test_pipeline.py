"""corpus_pipeline.run, each stage against plain Python on its own input."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from churnlens.llm import mixing, packing, paragraph_dedup, passages, quality
from churnlens.llm.common import table
from tests.llm.brute import classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage, over the small documents and planted passages."""
    base = str(tmp_path_factory.mktemp("pipeline"))
    rnd = random.Random(6)
    planted = " ".join(f"pw{rnd.randrange(10 ** 6)}" for _ in range(60))
    docs = [r.asDict() for r in table(spark, SF, "documents").collect()]
    good = {r.doc_id for r in table(spark, SF, "labels").where("quality = 1").collect()}
    for d in [d for d in docs if d["doc_id"] in good][:6]:  # the same 60 words inside six of the better texts
        d["text"] = d["text"][:len(d["text"]) // 2] + " " + planted + " " + d["text"][len(d["text"]) // 2:]
    schema = table(spark, SF, "documents").schema
    spark.createDataFrame([tuple(d[f.name] for f in schema) for d in docs], schema).write.parquet(f"{base}/documents.parquet")
    table(spark, SF, "labels").write.parquet(f"{base}/labels.parquet")
    out, frame = [], table(spark, base, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, base).write.parquet(f"{base}/out{k}")
        after = spark.read.parquet(f"{base}/out{k}")
        out.append((frame, after))
        frame = after
    return base, out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_all_but_the_last_stage_keep_the_columns(stages):
    assert all(a.columns == b.columns for a, b in stages[1][:4])


def test_quality_stage(spark, stages):
    base, out = stages
    before, after = map(rows, out[0])
    r = quality.train(table(spark, base, "documents"), table(spark, base, "labels"))
    kept = set()
    for d in before:
        x = quality.features((d["text"] or "").encode())
        z = [min(8.0, max(-8.0, (v - m) / s)) for v, m, s in zip(x, r.mean, r.scale)]
        strength = sum(w * v for w, v in zip(r.weight, z + [v * v / 8 for v in z]))
        if strength >= r.cut:
            kept.add(d["doc_id"])
    assert {d["doc_id"] for d in after} == kept and 0 < len(after) < len(before)


def test_near_duplicate_stage(stages):
    before, after = map(rows, stages[1][1])
    before.sort(key=lambda d: d["doc_id"])
    comp = classes([(d["text"] or "").encode().lower().split() for d in before])
    assert sorted(d["doc_id"] for d in after) == [before[i]["doc_id"] for i in range(len(before)) if comp[i] == i]


def test_substring_stage(stages):
    before, after = map(rows, stages[1][2])
    places = [(d["doc_id"], k, w) for d in before for k, _, _, w in paragraph_dedup.paragraphs((d["text"] or "").encode())]
    places.sort(key=lambda p: p[:2])
    comp = classes([w for *_, w in places])
    gone = {places[i][:2] for i in range(len(places)) if comp[i] != i}
    windows, texts = defaultdict(list), {d["doc_id"]: d["text"] or "" for d in before}
    for i in sorted(texts):
        words, at = [], 0
        for k, line in enumerate(texts[i].split("\n")):
            here = at
            if (i, k) not in gone:
                for w in line.split(" "):  # the small texts part words by blanks only
                    if w:
                        words.append((here, here + len(w), w.encode().lower()))
                    here += len(w) + 1
            at += len(line) + 1
        for s in range(len(words) - passages.PASSAGE + 1):
            windows[tuple(w for *_, w in words[s:s + passages.PASSAGE])].append((i, words[s][0], words[s + passages.PASSAGE - 1][1]))
    cut = defaultdict(set)
    for found in windows.values():
        for i, a, b in found[1:]:
            cut[i] |= set(range(a, b))
    want = {}
    for i, t in texts.items():
        left = "".join(c for at, c in enumerate(t) if at not in cut[i] or c == "\n")
        want[i] = "\n".join(line for k, line in enumerate(left.split("\n")) if (i, k) not in gone)
    assert {d["doc_id"]: d["text"] or "" for d in after} == want
    assert cut and all(d["n_chars"] == len(d["text"]) for d in after if want[d["doc_id"]] != texts[d["doc_id"]])


def test_mixing_stage(stages):
    (frame, _), (before, after) = stages[1][3], map(rows, stages[1][3])
    copies = {r.doc_id: (r.copies, r.size, r.source, r.target) for r in mixing.mix(frame).collect()}
    assert Counter(d["doc_id"] for d in after) == Counter({i: n for i, (n, *_) in copies.items() if n})
    size = {d["doc_id"]: len((d["text"] or "").split()) for d in before}
    totals = Counter()
    for d in before:
        totals[d["source"]] += size[d["doc_id"]]
    goal, taken = mixing.shares(dict(totals)), Counter()
    for d in after:
        taken[d["source"]] += size[d["doc_id"]]
    for i, (n, words, source, _) in copies.items():  # one copy more or fewer brings no source nearer to its target
        lack = goal[source] - taken[source]
        assert abs(lack - words) >= abs(lack) - 1e-6 or n == mixing.CAP
        assert abs(lack + words) >= abs(lack) - 1e-6 or n == 0
    assert abs(sum(taken.values()) - sum(totals.values())) <= 0.1 * sum(totals.values())


def test_packing_stage(stages):
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(packing.default_path())
    own.encode_special_tokens = True
    before, after = map(rows, stages[1][4])
    want = Counter()
    for d in before:
        ids = [*own.encode(d["text"] or "", add_special_tokens=False).ids, packing.END_ID]
        for k, (start, length) in enumerate(packing.cut(len(ids), packing.CAPACITY)):
            want[(d["doc_id"], k, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in after) == want
    bins = defaultdict(list)
    for r in after:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for o, n in sorted(members):
            assert o == at
            at += n
        assert at <= packing.CAPACITY


def test_run_gives_the_last_stage(spark, stages):
    base, out = stages
    got = corpus_pipeline.run(spark, base)
    assert sorted(map(str, got.collect())) == sorted(map(str, out[-1][1].collect()))


def test_stages_take_empty_tables(spark, stages):
    base, out = stages
    for (_, stage), (before, _) in zip(corpus_pipeline.STAGES, out):
        assert stage(spark, before.limit(0), base).count() == 0
