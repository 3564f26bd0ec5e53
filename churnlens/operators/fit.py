"""Elastic-net logistic fits with a checkable answer, several side by side.

The objective (H8) is ``sum(w * logloss) / W + lam * ((1 - a) / 2 * |b|^2 + a * |b|_1)``
with ``lam = 1 / (C * W)``; the intercept is free.  One *pass* over the rows gives
loss, gradient and curvature of every fit at its present coefficients: each task
adds up its own rows and a sum by (fit, place) merges the tasks.  Between passes
the driver solves a problem of a few dozen numbers (proximal Newton, coordinate
descent).  The fits of all cross-validation folds share each pass, whatever rows
they have in common, so folds cost no passes of their own.

The same gradient is the subgradient check: a coefficient is optimal when its
residual vanishes (``optimality``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.features import BINARY, CATEGORICAL, CONTINUOUS
from churnlens.operators.model import DEFAULT_PARAMS, LinearSpec, Term, parse_class_weight
from churnlens.operators.stats import exact_quantiles
from churnlens.session import stored, ship_package

TOLERANCE = 1e-12
SUMS = "fit int, place int, value double"


# ------------------------------------------------------------------ preprocessing, per fit

def members(rows: DataFrame, fits: dict[str, Column]) -> DataFrame:
    """Each row once per fit that learns from it, with the fit's name in ``fit``."""
    own = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in fits.items()]))
    return rows.select("*", F.explode(own).alias("fit"))


def preprocessors(rows: DataFrame, fits: dict[str, Column]) -> dict[str, list[Term]]:
    """H3-H7 for every fit at once: exact medians, modes (ties: smallest value),
    population mean and std of the imputed values, levels in order without the
    first.  What reaches the driver are a few numbers per fit and column."""
    own = members(rows, fits)
    medians = {(r["fit"], r["feature"]): r["m"] for r in exact_quantiles(own, CONTINUOUS, [0.5], ["m"], by=["fit"]).collect()}
    cells = own.select("fit", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                                  for c in BINARY + CATEGORICAL])).alias("x")).select("fit", "x.c", "x.v").where("v is not null")
    counts = cells.groupBy("fit", "c", "v").agg(F.count(F.lit(1)).alias("n"))
    modes = {(r["fit"], r["c"]): r["mode"] for r in counts.groupBy("fit", "c").agg(
        F.min_by("v", F.struct((-F.col("n")).alias("neg"), F.col("v"))).alias("mode")).collect()}
    levels: dict[str, list[str]] = {}
    for r in counts.where(F.col("c") == CATEGORICAL[0]).select("fit", "v").orderBy("v").collect():  # a row per plan tier
        levels.setdefault(r["fit"], []).append(r["v"])

    def imputed(c: str) -> Column:
        return F.coalesce(F.col(c).cast("double"), *[F.when(F.col("fit") == f, F.lit(float(medians.get((f, c)) or 0.0))) for f in fits])
    moments = {r["fit"]: r for r in own.groupBy("fit").agg(
        *[F.avg(imputed(c)).alias(f"{c}__m") for c in CONTINUOUS],
        *[F.stddev_pop(imputed(c)).alias(f"{c}__s") for c in CONTINUOUS]).collect()}
    out = {}
    for f in fits:
        if f not in moments:
            continue  # no rows to learn from
        m = moments[f]
        terms = [Term(f"num__{c}", c, "num", float(medians.get((f, c)) or 0.0), float(m[f"{c}__m"] or 0.0),
                      float(m[f"{c}__s"]) if m[f"{c}__s"] else 1.0) for c in CONTINUOUS]
        terms += [Term(f"bin__{c}", c, "bin", float(modes.get((f, c)) or 0)) for c in BINARY]
        mode = modes.get((f, CATEGORICAL[0]))
        terms += [Term(f"cat__{CATEGORICAL[0]}_{v}", CATEGORICAL[0], "cat", mode, level=v) for v in levels.get(f, [])[1:]]
        out[f] = terms
    return out


def preprocessor_table(spark, terms: list[Term]) -> DataFrame:
    """The fitted preprocessing as rows: what is imputed, subtracted, divided by, and which level a column stands for."""
    return spark.createDataFrame([(i, t.name, t.base, t.kind, str(t.impute) if t.kind == "cat" else None,
                                   None if t.kind == "cat" else float(t.impute), t.mean, t.scale, t.level) for i, t in enumerate(terms)],
                                 "position int, term string, base_feature string, kind string, impute_level string, impute_value double, "
                                 "mean double, scale double, level string")


# ------------------------------------------------------------------ passes

def weights(rows: DataFrame, fits: dict[str, Column], label: str, class_weight) -> dict[str, dict[int, tuple[float, int]]]:
    """Per fit and class: weight (H9) and rows."""
    counts: dict[str, dict[int, int]] = {f: {} for f in fits}
    for r in members(rows, fits).groupBy("fit", F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["fit"]][r["y"]] = r["n"]
    out = {}
    for f, c in counts.items():
        total = sum(c.values())
        out[f] = {y: (total / (len(c) * n) if class_weight == "balanced" else float(class_weight.get(y, 1.0)), n) for y, n in c.items()}
    return out


def design(rows: DataFrame, fits: dict[str, Column], terms: dict[str, list[Term]], label: str, by_class: dict) -> DataFrame:
    """Per row: label, and for each fit its weight (0: not among its rows) and its
    transformed features, a leading 1 for the intercept.  Written once, read by each pass."""
    cols = [F.col(label).cast("double").alias("y")]
    for k, (f, ts) in enumerate(terms.items()):
        w = F.coalesce(*[F.when(F.col(label).cast("int") == y, F.lit(v)) for y, (v, _) in by_class[f].items()], F.lit(0.0))
        cols.append(F.when(fits[f], w).otherwise(F.lit(0.0)).alias(f"w{k}"))
        spec = LinearSpec(0.0, ts)
        cols.append(F.array(F.lit(1.0), *[spec.transformed(t) for t in ts]).alias(f"x{k}"))
    return stored(rows.select(*cols), "design")


def one_pass(data: DataFrame, at: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """(loss, gradient, curvature) sums of each fit at its coefficients."""
    ship_package(data.sparkSession)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros(1 + len(b) + len(b) ** 2) for k, b in at.items()}
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for k, b in at.items():
                w = batch.column(f"w{k}").to_numpy(zero_copy_only=False)
                own = w > 0
                x = batch.column(f"x{k}").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(b))[own]
                m, u, v = x @ b, w[own], y[own]
                p = 1 / (1 + np.exp(-np.clip(m, -700, 700)))
                loss = np.logaddexp(0, m) - v * m
                sums[k] += np.concatenate([[u @ loss], x.T @ (u * (p - v)), ((x * (u * p * (1 - p))[:, None]).T @ x).ravel()])
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k, np.int32)), pa.array(np.arange(len(s), dtype=np.int32)), pa.array(s)],
                                             names=["fit", "place", "value"])
    used = [c for k in at for c in (f"w{k}", f"x{k}")]
    rows = data.select("y", *used).mapInArrow(partial, SUMS).groupBy("fit", "place").agg(F.sum("value").alias("value")).collect()
    out = {k: np.zeros(1 + len(b) + len(b) ** 2) for k, b in at.items()}  # as many numbers as the models' curvature has
    for r in rows:
        out[r["fit"]][r["place"]] = r["value"]
    return {k: (float(s[0]), s[1:1 + len(at[k])], s[1 + len(at[k]):].reshape(len(at[k]), -1)) for k, s in out.items()}


# ------------------------------------------------------------------ the driver's small problem

def _penalty(b: np.ndarray, lam: float, a: float) -> float:
    return lam * ((1 - a) / 2 * float(b[1:] @ b[1:]) + a * float(np.abs(b[1:]).sum()))


def residuals(b: np.ndarray, g: np.ndarray, lam: float, a: float) -> np.ndarray:
    """Distance of 0 from the subdifferential, per coefficient (the intercept first)."""
    smooth = g + lam * (1 - a) * np.concatenate([[0.0], b[1:]])
    out = np.where(b != 0, np.abs(smooth + lam * a * np.sign(b)), np.maximum(np.abs(smooth) - lam * a, 0.0))
    out[0] = abs(g[0])
    return out


def _newton(b: np.ndarray, g: np.ndarray, h: np.ndarray, lam: float, a: float) -> np.ndarray:
    """Minimum of the penalised quadratic model, by coordinate descent."""
    x, grad = b.copy(), g.copy()  # grad: the model's gradient at x
    for _ in range(10_000):
        moved = 0.0
        for j in range(len(b)):
            curve = h[j, j] + (lam * (1 - a) if j else 0.0)
            if curve <= 0:
                continue
            u = h[j, j] * x[j] - grad[j]
            new = u / curve if j == 0 else np.sign(u) * max(abs(u) - lam * a, 0.0) / curve
            if new != x[j]:
                grad += h[:, j] * (new - x[j])
                moved = max(moved, abs(new - x[j]))
                x[j] = new
        if moved < 1e-15 * (1 + np.abs(x).max()):
            break
    return x


def fit_side_by_side(rows: DataFrame, fits: dict[str, Column], label: str, params: dict | None = None,
                     start: dict[str, LinearSpec] | None = None, tol: float = TOLERANCE, most: int = 60) -> dict[str, LinearSpec]:
    """A fitted model for each entry of ``fits`` (name -> condition on the rows it
    learns from).  An entry whose rows hold one class only has no model.
    ``start``: models whose preprocessing and coefficients are gone on from."""
    params = dict(DEFAULT_PARAMS, **(params or {}))
    penalty = params.get("penalty", "elasticnet")
    a = float(params.get("l1_ratio") or 0.0) if penalty == "elasticnet" else (1.0 if penalty == "l1" else 0.0)
    by_class = weights(rows, fits, label, parse_class_weight(params["class_weight"]))
    fits = {f: c for f, c in fits.items() if len(by_class[f]) == 2}
    if not fits:
        return {}
    terms = {f: s.terms for f, s in start.items() if f in fits} if start else preprocessors(rows, fits)
    names = list(terms)
    data = design(rows, fits, terms, label, by_class)
    total = {k: sum(w * n for w, n in by_class[f].values()) for k, f in enumerate(names)}
    lam = {k: 1.0 / (float(params["C"]) * t) for k, t in total.items()}
    at = {k: np.array([start[f].intercept] + [t.coef for t in start[f].terms]) if start else np.zeros(1 + len(terms[f]))
          for k, f in enumerate(names)}
    best: dict[int, tuple] = {}   # value, coefficients, gradient, curvature, largest residual
    done: set[int] = set()
    for _ in range(most):
        sums = one_pass(data, {k: b for k, b in at.items() if k not in done})
        for k, (loss, g, h) in sums.items():
            b, g, h = at[k], g / total[k], h / total[k]
            value, off = loss / total[k] + _penalty(b, lam[k], a), float(residuals(b, g, lam[k], a).max())
            if k in best and value > best[k][0] + 1e-14 * abs(best[k][0]) and off >= best[k][4]:
                at[k] = (b + best[k][1]) / 2  # the step went too far
                if np.abs(at[k] - best[k][1]).max() < 1e-16:
                    done.add(k)
                continue
            stalled = k in best and off < 1e-9 and off >= best[k][4]  # only rounding is left
            if not stalled:
                best[k] = (value, b, g, h, off)
            if off <= tol or stalled:
                done.add(k)
            else:
                at[k] = _newton(b, g, h, lam[k], a)
        if len(done) == len(names):
            break
    out = {}
    for k, f in enumerate(names):
        b = best[k][1]
        out[f] = LinearSpec(float(b[0]), [replace(t, coef=float(c)) for t, c in zip(terms[f], b[1:])])
    return out


# ------------------------------------------------------------------ the check

def optimality(rows: DataFrame, spec: LinearSpec, label: str, params: dict | None = None, tol: float = 1e-9) -> DataFrame:
    """H8's answer checked: per term the coefficient, the smooth part's
    subgradient and its residual, from one native aggregate over the rows."""
    params = dict(DEFAULT_PARAMS, **(params or {}))
    a = float(params.get("l1_ratio") or 0.0)
    by_class = weights(rows, {"all": F.lit(True)}, label, parse_class_weight(params["class_weight"]))["all"]
    total = sum(w * n for w, n in by_class.values())
    lam = 1.0 / (float(params["C"]) * total)
    y = F.col(label).cast("double")
    pull = F.coalesce(*[F.when(y == c, F.lit(w)) for c, (w, _) in by_class.items()], F.lit(0.0)) * (F.col("_p") - y)
    scored = rows.select(F.col(label), spec.probability().alias("_p"), *[spec.transformed(t).alias(f"_x{i}") for i, t in enumerate(spec.terms)])
    sums = scored.agg(F.sum(pull).alias("g"), *[F.sum(pull * F.col(f"_x{i}")).alias(f"g{i}") for i in range(len(spec.terms))]).first()
    b = np.array([spec.intercept] + [t.coef for t in spec.terms])
    g = np.array([sums["g"]] + [sums[f"g{i}"] for i in range(len(spec.terms))]) / total
    off = residuals(b, g, lam, a)
    names = ["(intercept)"] + [t.name for t in spec.terms]
    return rows.sparkSession.createDataFrame(
        [(n, float(c), float(x), float(r), bool(r <= tol)) for n, c, x, r in zip(names, b, g, off)],
        "term string, coefficient double, gradient double, residual double, optimal boolean")
