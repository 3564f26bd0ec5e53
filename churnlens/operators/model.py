"""Elastic-net logistic churn model.

Preprocessing (median impute + population standardise for continuous,
most-frequent impute for binary, most-frequent + drop-first one-hot for the
plan tier, unseen level -> all zeros) is fitted with distributed aggregates
and kept as literals.  The fitted model therefore becomes a ``LinearSpec``:
scoring, contributions and explanations are plain column expressions inside
whole-stage codegen -- no vector UDT, no Python on the scoring path.

Training uses ``pyspark.ml.classification.LogisticRegression`` with
``regParam = 1 / (C * sum(w))``, ``elasticNetParam = l1_ratio`` and
``standardization=False`` (the features are standardised already), which is
the same objective as the reference's solver.
"""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.features import BINARY, CATEGORICAL, CONTINUOUS, FEATURES
from churnlens.operators.stats import exact_quantiles

# Default hyper-parameters (C, class weights, penalty, l1 ratio).
DEFAULT_PARAMS = {"C": 0.05, "class_weight": "{0: 1, 1: 2}", "penalty": "elasticnet", "l1_ratio": 0.2}


@dataclass
class Term:
    name: str          # transformed name, e.g. num__tenure, cat__plan_tier_Pro
    base: str          # input feature
    kind: str          # num | bin | cat
    impute: object     # median / mode (literal)
    mean: float = 0.0
    scale: float = 1.0
    level: str | None = None
    coef: float = 0.0


@dataclass
class LinearSpec:
    intercept: float
    terms: list[Term] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "terms": [asdict(t) for t in self.terms]})

    @staticmethod
    def from_json(s: str) -> "LinearSpec":
        d = json.loads(s)
        return LinearSpec(d["intercept"], [Term(**t) for t in d["terms"]])

    # ------------------------------------------------------------ expressions
    def transformed(self, t: Term) -> Column:
        x = F.col(t.base)
        if t.kind == "num":
            v = F.coalesce(x.try_cast("double"), F.lit(float(t.impute)))
            return (v - F.lit(t.mean)) / F.lit(t.scale)
        if t.kind == "bin":
            return F.coalesce(x.try_cast("double"), F.lit(float(t.impute)))
        v = F.coalesce(x.cast("string"), F.lit(str(t.impute)))
        return (v == F.lit(t.level)).cast("double")

    def contribution(self, t: Term) -> Column:
        return self.transformed(t) * F.lit(float(t.coef))

    def margin(self) -> Column:
        m = F.lit(float(self.intercept))
        for t in self.terms:
            m = m + self.contribution(t)
        return m

    def probability(self) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.margin()))

    def coefficient_table(self, spark) -> DataFrame:
        """Coefficient, abs, base name (text after the first ``__``), the
        strongest first (ties by name), with that order in ``position``."""
        terms = sorted(self.terms, key=lambda t: (-round(abs(t.coef), 9), t.name))
        rows = [(i, t.name, float(t.coef)) for i, t in enumerate(terms, 1)]
        df = spark.createDataFrame(rows, "position int, feature string, coefficient double")
        return df.select("position", "feature", "coefficient", F.abs("coefficient").alias("abs_coefficient"),
                         F.regexp_extract("feature", r"^[^_]*?__(.*)$", 1).alias("base_feature")).orderBy("position")


# --------------------------------------------------------------- fixed scorer

def fixed_scorer() -> LinearSpec:
    """A literal linear scorer on unscaled features (medians / modes given).
    Used where the whole output must be checkable by SQL; the fitted model
    goes through exactly the same expressions."""
    # Fixed values for checks: intercept and per-term coefficients.
    coefs = {
        "usage_count_qoq_delta_z": -0.35, "tickets_opened_qoq_delta_z": 0.30,
        "days_to_contract_end_capped": -0.002, "arr_amount_qoq_delta_z": -0.25,
        "seats_qoq_delta_z": -0.05, "seats": -0.004, "tenure": -0.02, "tenure_z": -0.05,
        "tenure_x_usage_drop_flag": -0.05, "tenure_x_tickets_opened_qoq_delta_z": 0.03,
        "avg_satisfaction": -0.10, "satisfaction_missing_flag": 0.10, "contract_missing_flag": 0.40,
        "usage_drop_flag": 0.20, "contract_ending_soon_flag": 0.15,
    }
    tier_coefs = {"Enterprise": -0.10, "Pro": 0.05, "none": 0.60}
    terms = []
    for c in CONTINUOUS:
        terms.append(Term(f"num__{c}", c, "num", 3.0 if c == "avg_satisfaction" else 0.0, coef=coefs[c]))
    for c in BINARY:
        terms.append(Term(f"bin__{c}", c, "bin", 0, coef=coefs[c]))
    for lvl, cf in tier_coefs.items():
        terms.append(Term(f"cat__plan_tier_{lvl}", "plan_tier", "cat", "Basic", level=lvl, coef=cf))
    return LinearSpec(-0.8, terms)


# --------------------------------------------------------------- fitting

def parse_class_weight(value: str):
    if str(value) == "balanced":
        return "balanced"
    import ast
    return {int(k): float(v) for k, v in ast.literal_eval(str(value)).items()}


def class_weight_table(df: DataFrame, label_col: str, class_weight) -> DataFrame:
    """H9: per class: rows and weight (dict, or balanced = n / (2 * n_class))."""
    counts = df.where(F.col(label_col).isNotNull()).groupBy(F.col(label_col).cast("int").alias("label")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if class_weight == "balanced":
        tot = counts.agg(F.sum("n").alias("tot"), F.count(F.lit(1)).alias("k"))
        return counts.crossJoin(F.broadcast(tot)).select(
            "label", "n", (F.col("tot") / (F.col("k") * F.col("n"))).alias("weight"))
    m = F.create_map(*[x for k, v in class_weight.items() for x in (F.lit(int(k)), F.lit(float(v)))])
    return counts.select("label", "n", F.coalesce(m[F.col("label")], F.lit(1.0)).alias("weight"))


def _mode_row(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column; ties -> smallest value (sklearn)."""
    arr = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    long = df.select(F.explode(arr).alias("x")).select("x.*").where(F.col("v").isNotNull())
    cnt = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    best = cnt.groupBy("c").agg(F.min_by("v", F.struct((-F.col("n")).alias("nn"), F.col("v"))).alias("mode"))
    return {r["c"]: r["mode"] for r in best.collect()}  # one row per column


def fit_preprocessor(train: DataFrame) -> list[Term]:
    """H3-H6: medians (exact, distributed), population mean/std of the
    imputed values, modes and the sorted category list -- all small literals."""
    med = {r["feature"]: r["q0"] for r in exact_quantiles(train, CONTINUOUS, [0.5], ["q0"]).collect()}
    modes = _mode_row(train, BINARY + CATEGORICAL)
    imputed = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float(med.get(c) or 0.0))).alias(c)
                             for c in CONTINUOUS])
    mom = imputed.agg(*[F.avg(c).alias(f"{c}__m") for c in CONTINUOUS],
                      *[F.stddev_pop(c).alias(f"{c}__s") for c in CONTINUOUS]).first()
    levels = [r["plan_tier"] for r in train.select(F.coalesce(F.col("plan_tier"), F.lit(modes.get("plan_tier")))
                                                   .alias("plan_tier")).distinct().orderBy("plan_tier").collect()]
    terms = []
    for c in CONTINUOUS:
        s = mom[f"{c}__s"]
        terms.append(Term(f"num__{c}", c, "num", float(med.get(c) or 0.0), float(mom[f"{c}__m"] or 0.0),
                          float(s) if s and s > 0 else 1.0))
    for c in BINARY:
        terms.append(Term(f"bin__{c}", c, "bin", float(modes.get(c) or 0)))
    for lvl in levels[1:]:  # drop the alphabetically first level
        terms.append(Term(f"cat__plan_tier_{lvl}", "plan_tier", "cat", modes.get("plan_tier"), level=lvl))
    return terms


def fit_logistic(train: DataFrame, label_col: str = "churn_label_q1_rolling", params: dict | None = None,
                 max_iter: int = 3000, tol: float = 1e-8) -> LinearSpec:
    """H8: fit the elastic-net logistic model; return it as a LinearSpec."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    params = dict(DEFAULT_PARAMS, **(params or {}))
    terms = fit_preprocessor(train)
    spec = LinearSpec(0.0, terms)
    cw = parse_class_weight(params["class_weight"])
    weights = class_weight_table(train, label_col, cw).collect()  # one row per class
    wmap = {int(r["label"]): float(r["weight"]) for r in weights}
    total_w = sum(wmap[int(r["label"])] * r["n"] for r in weights)
    wcol = F.create_map(*[x for k, v in wmap.items() for x in (F.lit(k), F.lit(v))])[F.col(label_col).cast("int")]
    x = train.select(*[spec.transformed(t).alias(t.name) for t in terms],
                     F.col(label_col).cast("double").alias("label"), wcol.alias("w"))
    vec = VectorAssembler(inputCols=[t.name for t in terms], outputCol="features").transform(x)
    penalty = params.get("penalty", "elasticnet")
    l1 = float(params.get("l1_ratio") or 0.0) if penalty == "elasticnet" else (1.0 if penalty == "l1" else 0.0)
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter, tol=tol,
                            regParam=1.0 / (float(params["C"]) * total_w), elasticNetParam=l1,
                            standardization=False, fitIntercept=True, family="binomial")
    m = lr.fit(vec)
    coefs = m.coefficients.toArray().tolist()
    for t, c in zip(terms, coefs):
        t.coef = float(c)
    spec.intercept = float(m.intercept)
    return spec


def pick_params(tuning: DataFrame | None) -> dict:
    """Best row by auc desc, then zero_rate asc (defaults when absent)."""
    if tuning is None:
        return dict(DEFAULT_PARAMS)
    r = tuning.orderBy(F.col("auc").desc(), F.col("zero_rate").asc()).limit(1).collect()
    if not r:
        return dict(DEFAULT_PARAMS)
    d = r[0].asDict()
    l1 = d.get("l1_ratio")
    return {"C": float(d["C"]), "class_weight": str(d["class_weight"]), "penalty": str(d["penalty"]),
            "l1_ratio": None if l1 is None or (isinstance(l1, float) and math.isnan(l1)) else float(l1)}


def save_spec(spark, spec: LinearSpec, path: str) -> None:
    """The model is a handful of literals; store it as one JSON row."""
    spark.createDataFrame([(spec.to_json(),)], "spec string").coalesce(1).write.mode("overwrite").json(path)


def load_spec(spark, path: str) -> LinearSpec:
    return LinearSpec.from_json(spark.read.json(path).first()["spec"])


__all__ = ["FEATURES", "LinearSpec", "Term", "fixed_scorer", "fit_logistic", "fit_preprocessor",
           "class_weight_table", "parse_class_weight", "pick_params", "save_spec", "load_spec"]


def fold_conditions(split_df: DataFrame, label_col: str, folds: int) -> list[dict]:
    """Expanding-window folds: each of the last ``folds`` labelled quarters is
    validated by all quarters before it.  Counts come from one row per quarter."""
    rows = split_df.groupBy("_q_idx").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label_col).cast("long")).alias("pos")).collect()
    quarters = sorted((r["_q_idx"], r["n"], r["pos"]) for r in rows)
    out = []
    for at in range(max(0, len(quarters) - folds), len(quarters)):
        q, n, pos = quarters[at]
        n_train, pos_train = sum(x[1] for x in quarters[:at]), sum(x[2] for x in quarters[:at])
        out.append({"q": q, "n_train": n_train, "pos_train": pos_train, "n_valid": n, "pos_valid": pos,
                    "skipped": not (0 < pos_train < n_train and 0 < pos < n)})
    return out


def timeseries_folds(split_df: DataFrame, label_col: str = "churn_label_q1_rolling", folds: int = 5,
                     params: dict | None = None, spec: LinearSpec | None = None) -> DataFrame:
    """H19, a row per fold: its quarter, rows and positives on both sides,
    whether it is skipped (one class only) and its AUC.  All folds are fitted
    side by side and scored in one pass; ``spec`` scores every fold instead."""
    from churnlens.functions.periods import period_label
    from churnlens.operators.fit import fit_side_by_side
    from churnlens.operators.metrics import grouped_auc

    plan = fold_conditions(split_df, label_col, folds)
    live = [f["q"] for f in plan if not f["skipped"]]
    schema = "q int, n_train long, pos_train long, n_valid long, pos_valid long, skipped boolean"
    spark = split_df.sparkSession
    table = spark.createDataFrame([tuple(f.values()) for f in plan], schema).withColumn("fold_quarter", period_label("q"))
    if not live:
        return table.select("fold_quarter", *[c for c in table.columns if c not in ("q", "fold_quarter")], F.lit(None).cast("double").alias("auc"))
    specs = ({str(q): spec for q in live} if spec is not None else
             fit_side_by_side(split_df, {str(q): F.col("_q_idx") < q for q in live}, label_col, params))
    p = F.coalesce(*[F.when(F.col("_q_idx") == int(q), s.probability()) for q, s in specs.items()])
    scored = split_df.where(F.col("_q_idx").isin(live)).select(F.col("_q_idx").alias("q"), F.col(label_col).cast("int").alias("label"), p.alias("p"))
    auc = grouped_auc(scored, "q").select("q", "auc")
    return table.join(F.broadcast(auc), "q", "left").select(
        "fold_quarter", "n_train", "pos_train", "n_valid", "pos_valid", "skipped", "auc")


def cv_summary(folds: DataFrame, params: dict | None = None) -> DataFrame:
    """The folds in one row, with the settings they were fitted by."""
    p = dict(DEFAULT_PARAMS, **(params or {}))
    l1 = float(p["l1_ratio"]) if p.get("l1_ratio") is not None else None
    return folds.agg(F.count_if(~F.col("skipped")).cast("int").alias("ts_cv_folds"), F.count_if("skipped").cast("int").alias("ts_cv_skipped_folds"),
                     F.avg("auc").alias("ts_cv_auc_mean"), F.min("auc").alias("ts_cv_auc_min"), F.max("auc").alias("ts_cv_auc_max"),
                     F.stddev_pop("auc").alias("ts_cv_auc_std")).select(
        "ts_cv_folds", "ts_cv_skipped_folds", F.lit(float(p["C"])).alias("best_c"), F.lit(str(p["class_weight"])).alias("class_weight"),
        F.lit(str(p["penalty"])).alias("penalty"), F.lit(l1).cast("double").alias("l1_ratio"),
        "ts_cv_auc_mean", "ts_cv_auc_min", "ts_cv_auc_max", "ts_cv_auc_std")
