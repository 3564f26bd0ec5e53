"""Mixing sources to token targets by entropy balancing.

Each document has a rate r in (0, cap].  Of all rates whose taken tokens meet
the constraints, entropy balancing takes those nearest to 1 in the
Kullback-Leibler sense with tokens as the base measure; they are exponentially
tilted, ``r = min(cap, exp(sum of the multipliers of the document's groups))``.
The multipliers solve the convex dual by Newton's method: an iteration is one
distributed aggregate (tokens taken by each group and by each pair of groups),
and only these sums reach the driver.

The rates become whole copies by systematic rounding along each source's
documents from long to short: copies = the number of integers that the running
sum of rates passes.  The running sum comes from the range sequencer, so that a
source with a third of all rows is split.  A last correction moves single
documents by one copy until the rest of a source is below its fitting sizes.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import words
from churnlens.operators.ordered import sequence_within
from churnlens.session import cut_lineage

CAP, WEIGHTS = 3, (1, 2, 3)


def _document() -> list[Column]:
    """What names a document: its id and source; without an id, its text too."""
    return [F.col("doc_id").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("body")]


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, body, size): rows that share id and source are one
    document with all their words; rows without an id are told apart by their
    text's hash, ``body`` (null for others).  Null texts have 0 words."""
    return (docs.select(*_document(), F.size(words(F.col("text"))).cast("long").alias("size"))
            .groupBy("doc_id", "source", "body").agg(F.sum("size").alias("size")))


def shares(totals: dict[str | None, int], weights=WEIGHTS, cap: float = CAP) -> dict[str | None, float]:
    """Targets of the sources: by code point, null last, they weigh 1, 2, 3,
    1, ... and share all tokens; none gets more than ``cap`` times its own,
    what is above is shared again by weight among the others."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    free, rest, out = set(order), float(sum(totals.values())), {}
    while free:
        unit = rest / sum(weight[s] for s in free)
        over = [s for s in order if s in free and weight[s] * unit >= cap * totals[s]]
        for s in over or list(free):
            out[s] = float(cap * totals[s]) if over else weight[s] * unit
            rest -= out[s]
            free.discard(s)
    return out


def _group(col: str, keys: list) -> Column:
    """Number of a row's group in ``keys``; -1 if it is in none."""
    c = F.col(col)
    return F.coalesce(*[F.when(c.eqNullSafe(F.lit(k)), F.lit(i)) for i, k in enumerate(keys)], F.lit(-1))


def balance(docs: DataFrame, targets: dict[str, dict], cap: float = CAP, steps: int = 60, tol: float = 1e-9) -> Column:
    """The rate of each row of ``docs`` (materialised; column ``size``) for
    ``targets`` {column: {group: tokens}}; one column of groups, or several
    whose targets agree in total.  Newton steps are damped to 1 a multiplier,
    which keeps the iteration stable where the cap flattens the dual."""
    margins = [(c, list(t)) for c, t in targets.items()]
    goal = np.array([t[k] for c, t in targets.items() for k in t], dtype=float)
    at = np.cumsum([0, *[len(k) for _, k in margins]])
    x = np.zeros(len(goal))
    idx = [_group(c, k) for c, k in margins]
    own = [(i + int(o)).alias(f"g{m}") for m, (i, o) in enumerate(zip(idx, at, strict=False))]

    def tilt(values: np.ndarray) -> Column:
        parts = [F.element_at(F.array(*[F.lit(float(v)) for v in [0.0, *values[at[m]:at[m + 1]]]]), i + 2)
                 for m, i in enumerate(idx)]
        return sum(parts[1:], parts[0])

    def rate(values: np.ndarray) -> Column:
        return F.least(F.lit(float(cap)), F.exp(tilt(values)))

    most = math.log(cap)
    for _ in range(steps):
        taken = rate(x)
        got, curve = np.zeros(len(goal)), np.zeros((len(goal), len(goal)))
        rows = docs.select("size", taken.alias("r"), *own).groupBy(*[f"g{m}" for m in range(len(margins))]).agg(
            F.sum("size").alias("n"), F.max("r").alias("r")).collect()
        # a row per combination of groups, whose documents have one rate: sums of sizes are exact and reruns agree
        for r in sorted(rows, key=lambda r: [r[f"g{m}"] for m in range(len(margins))]):
            of = [r[f"g{m}"] for m in range(len(margins)) if r[f"g{m}"] >= at[m]]
            for a in of:
                got[a] += r["n"] * r["r"]
                for b in of:
                    curve[a, b] += r["n"] * r["r"] if r["r"] < cap else 0.0
        gap = goal - got
        if np.abs(gap).max(initial=0) <= tol * max(1.0, goal.sum()):
            break
        step = np.linalg.lstsq(curve + np.eye(len(goal)) * 1e-12 * max(1.0, goal.sum()), gap, rcond=None)[0]
        flat = (curve.diagonal() <= 0) & (gap < 0)
        step[flat] = -0.5
        x = np.minimum(x + np.clip(step, -1, 1), most if len(margins) == 1 else np.inf)
    return rate(x)


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, body, size, source_size, target, rate, copies, taken)
    for each document of ``docs`` (columns used: doc_id, text, source).

    Null sources are one source; documents without words get a rate like the
    others and take nothing; rows that share a ``doc_id`` and a source are one
    document, of those without an id the ones that share source and text; no
    rows give no rows.  Ties are broken by a hash of the id, then the id, so
    reruns agree.  The number of sources is taken to fit the driver."""
    own = cut_lineage(sizes(docs))
    totals = {r["source"]: int(r["n"]) for r in own.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = shares(totals, weights, cap)
    keys = list(totals)
    if not keys:
        none = F.lit(None)
        return own.select("doc_id", "source", "body", "size", none.cast("long").alias("source_size"), none.cast("double").alias("target"),
                          none.cast("double").alias("rate"), none.cast("long").alias("copies"), none.cast("long").alias("taken"))
    rated = own.withColumn("rate", balance(own, {"source": goal}, cap))
    run = sequence_within(rated, ["source"], [F.col("size").desc(), F.xxhash64("doc_id").asc(), F.col("doc_id").asc(), F.col("body").asc()],
                          running_sums={"rate": "_sum"})
    upto = F.floor(F.col("_sum") + 0.5 + 1e-9)
    before = F.floor(F.col("_sum") - F.col("rate") + 0.5 + 1e-9)
    copied = cut_lineage(run.select("doc_id", "source", "body", "size", "rate",
                                    F.least(F.lit(cap), F.greatest(F.lit(0), upto - before)).cast("long").alias("copies")))
    fixed = _settle(copied, goal, cap)
    pick = _group("source", keys)
    source_size = F.element_at(F.array(*[F.lit(totals[k]).cast("long") for k in keys]), pick + 1)
    target = F.element_at(F.array(*[F.lit(goal[k]) for k in keys]), pick + 1)
    return fixed.select("doc_id", "source", "body", "size", source_size.alias("source_size"), target.alias("target"), "rate", "copies",
                        (F.col("copies") * F.col("size")).alias("taken"))


def _settle(copied: DataFrame, goal: dict, cap: int, rounds: int = 12) -> DataFrame:
    """Adds or takes one copy of the document whose size is nearest to what its
    source lacks or has over, as long as that brings the source nearer to its
    target, at most ``rounds`` times a source."""
    keys = list(goal)
    spark = copied.sparkSession
    got = {r["source"]: int(r["t"]) for r in copied.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t")).collect()}
    rest = {k: goal[k] - got.get(k, 0) for k in keys}
    moved: dict[tuple, int] = {}  # (doc_id, source) -> copies more or fewer

    def changed() -> DataFrame:
        if not moved:
            return copied
        change = F.broadcast(spark.createDataFrame([(*k, n) for k, n in moved.items()], "_id long, _source string, change long"))  # rounds x sources rows at most
        on = (F.col("doc_id") == F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
        return copied.join(change, on, "left").drop("_id", "_source").withColumn("copies", F.col("copies") + F.coalesce("change", F.lit(0))).drop("change")

    for _ in range(rounds):
        need = F.element_at(F.array(*[F.lit(float(rest[k])) for k in keys]), _group("source", keys) + 1)
        able = F.when(need > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        fit = changed().where((F.col("size") > 0) & (F.col("size") < 2 * F.abs(need)) & able & F.col("doc_id").isNotNull())
        best = fit.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.abs(need)).alias("left"), F.xxhash64("doc_id").alias("h"),
                                                        F.col("doc_id").cast("long").alias("doc_id"), "size")).alias("m")).collect()
        if not best:
            break
        for r in best:
            sign = 1 if rest[r["source"]] > 0 else -1
            key = (r["m"]["doc_id"], r["source"])
            moved[key] = moved.get(key, 0) + sign
            rest[r["source"]] -= sign * r["m"]["size"]
    return changed()


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with each row as often as its document's copies, columns kept."""
    key = ["doc_id", "source", "body"]
    left = docs.select("*", *[c.alias(f"_{k}") for c, k in zip(_document(), key, strict=True)]).alias("d")
    right = mixed.where(F.col("copies") > 0).select(*key, F.col("copies").alias("_copies")).alias("m")
    on = [F.col(f"d._{k}").eqNullSafe(F.col(f"m.{k}")) for k in key]
    out = left.join(right, on[0] & on[1] & on[2])
    return out.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_nth")).drop("_nth")
