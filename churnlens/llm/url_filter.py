"""URL verdicts: host and path rules, else a character language-model ratio.

Rules decide what they fit; the urls they decide train two variable-order Markov
models over the characters of host and path, one of accepted and one of rejected
urls.  A model is interpolated from order 0 to ``ORDER`` by Witten-Bell
smoothing.  Characters are folded to ``ALPHABET`` symbols, so a model has at
most ``ALPHABET ** (ORDER + 1)`` counts however many urls there are.  A url no
rule fits is judged by the difference of the two log-likelihoods per character,
against a threshold calibrated on the decided urls: the cut with the least sum of
error shares in a histogram of fixed size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import ascii_lower, map_arrow

ALPHABET, ORDER, BINS = 32, 3, 2000
# Fixed values: (host, path) and verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
_SYMBOL = np.full(256, 31, np.int64)  # 31: any other
_SYMBOL[list(range(97, 123))] = np.arange(1, 27)  # 0: before the start
_SYMBOL[list(range(65, 91))] = np.arange(1, 27)
_SYMBOL[list(range(48, 58))] = 27
_SYMBOL[[46, 45, 47]] = 28, 29, 30
COUNTS = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (of equal ones the first by code point) whose host is
    the url's or a parent domain and whose path starts the url's."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda x: (len(x), [-ord(c) for c in x])):
        at, start = r.split("/", 1)[0], "/" + r.split("/", 1)[1]
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        out = F.when(fits, F.lit(r)).otherwise(out)
    return out


def _codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each character its window of ORDER + 1 symbols as a number; lengths."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    flat = np.frombuffer(b"".join(b"\0" * ORDER + t for t in texts), np.uint8)
    start = np.cumsum(lengths + ORDER) - lengths - ORDER
    s = _SYMBOL[flat]
    for i in range(ORDER):
        s[start + i] = 0
    code = np.zeros(len(s), np.int64)
    for j in range(ORDER + 1):
        code[ORDER:] = code[ORDER:] * ALPHABET + s[j:len(s) - ORDER + j]
    real = np.ones(len(s), bool)
    for i in range(ORDER):
        real[start + i] = False
    return code[real], lengths


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Natural logs of the interpolated probabilities of all windows."""
    p = np.full((ALPHABET,), 1.0 / ALPHABET)
    for k in range(ORDER + 1):
        c = counts.reshape(-1, ALPHABET ** k, ALPHABET).sum(axis=0).astype(float)  # contexts of the last k symbols
        n, t = c.sum(axis=1, keepdims=True), (c > 0).sum(axis=1, keepdims=True)
        lower = np.broadcast_to(p.reshape(-1, ALPHABET), (max(1, ALPHABET ** (k - 1)), ALPHABET)) if k else p.reshape(1, ALPHABET)
        lower = np.tile(lower, (ALPHABET, 1)) if k else lower
        p = np.where(n > 0, (c + t * lower) / np.maximum(n + t, 1), lower)
    return np.log(p).reshape(-1)


def fit(decided: DataFrame) -> dict[str, np.ndarray]:
    """Models by verdict from (text binary, verdict)."""
    def run(b: pa.RecordBatch):
        base = np.repeat([0 if v == "allow" else ALPHABET ** (ORDER + 1) for v in b.column(1).to_pylist()],
                         [len(t) for t in b.column(0).to_pylist()])
        code, n = np.unique(_codes(b.column(0).to_pylist())[0] + base, return_counts=True)
        return {"code": code, "n": n}
    rows = map_arrow(decided, run, COUNTS).groupBy("code").agg(F.sum("n").alias("n")).collect()  # a bounded number of codes
    all_counts = np.zeros(2 * ALPHABET ** (ORDER + 1), np.int64)
    for r in rows:
        all_counts[r["code"]] = r["n"]
    allow, block = np.split(all_counts, 2)
    return {"allow": smoothed(allow), "block": smoothed(block)}


def ratio(texts: DataFrame, models: dict[str, np.ndarray], keep: list[str]) -> DataFrame:
    """``texts`` (text binary, ``keep``) with ``llr``: log-likelihood difference
    per character, accepted less rejected; 0 for an empty text."""
    table = (models["allow"] - models["block"]).astype(np.float32)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = pa.schema([*[to_arrow_schema(texts.schema).field(c) for c in keep], ("llr", pa.float64())])

    def run(b: pa.RecordBatch):
        code, n = _codes(b.column("text").to_pylist())
        total = np.bincount(np.repeat(np.arange(len(n)), n), weights=table[code], minlength=len(n))
        return {c: b.column(c) for c in keep} | {"llr": total / np.maximum(n, 1)}
    return map_arrow(texts, run, schema)


def calibrate(decided: DataFrame) -> float:
    """The cut with the least sum of the two error shares, from a histogram of
    ``BINS`` bins over (verdict, llr); the middle of the best stretch."""
    edge = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("llr") + 5) * (BINS / 10))))
    h = {"allow": np.zeros(BINS), "block": np.zeros(BINS)}
    for r in decided.groupBy("verdict", edge.alias("bin")).count().collect():
        h[r["verdict"]][r["bin"]] = r["count"]
    if not h["allow"].any() or not h["block"].any():
        return 0.0
    missed = np.concatenate([[0], np.cumsum(h["allow"])]) / h["allow"].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(h["block"])]) / h["block"].sum()
    best = np.flatnonzero(missed + passed <= (missed + passed).min() + 1e-12)
    return float((best[0] + best[-1]) / 2) * 10 / BINS - 5


def judge(pages: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, llr) for every row of ``pages``
    (columns used: page_id, url).

    Null urls and urls without ``://`` have empty host and path, fit no rule and
    have ratio 0.  Without urls decided either way the cut is 0 and a ratio of
    at least the cut is allowed.  Repeated rows are judged alike."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    base = base.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules.items()], F.lit(None).cast("string"))
    base = base.withColumn("verdict", by_rule).withColumn("text", F.concat("host", "path").cast("binary"))
    decided = base.where("verdict is not null").select("text", "verdict")
    models = fit(decided)
    cut = calibrate(ratio(decided, models, ["verdict"]))
    out = ratio(base, models, ["page_id", "host", "path", "rule", "verdict"])
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("llr") >= cut, F.lit("allow")).otherwise(F.lit("block"))))
