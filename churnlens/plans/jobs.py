"""Batch jobs: ingest, panel, train, score; written tables cut lineage.

``processed_quarter_panel`` is the reference's chain of four scripts
(panel -> QoQ -> missing flags -> contract flags) as one lazy plan, with the
as-of subscription's observed end carried through the as-of pick so the
contract step needs no lookup join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from churnlens.operators import explain, features, fit, metrics, model, report, risk, upload
from churnlens.operators.flags import add_contract_flags, add_missing_flags, backfill_labels, clean_label_binary, ensure_label
from churnlens.operators.qoq import qoq_columns, qoq_transform
from churnlens.plans.inputs import Facts, load_facts
from churnlens.session import stored
from churnlens.sources import raw
from churnlens.sources.aliases import apply_aliases


def processed_quarter_panel(f: Facts, qoq_method: str = "exact", materialise: bool = True, observed: bool = False,
                            columns: Sequence[str] | None = None) -> DataFrame:
    """``columns``: those of the panel that the caller goes on to use, besides what the steps
    here read (default: all); others are neither stored nor worked out."""
    p = f.panel("quarter", observed, carry_end_date=True)
    if columns is not None:
        own = {*columns, *qoq_columns(p), *FLAG_SOURCES}
        p = p.select(*[c for c in p.columns if c in own])
    if materialise:
        # the statistics passes and the final projection all read the panel:
        # compute it once (a table in the cluster's shared folder)
        p = stored(p, "panel")
    p = qoq_transform(p, method=qoq_method)
    p = add_missing_flags(p)
    p = backfill_labels(p)
    return add_contract_flags(p, f.sub_fact)


#: Panel columns that the missing, label and contract steps read.
FLAG_SOURCES = ("satisfaction_missing_flag", "days_to_contract_end_asof_qend", "account_churn_event_in_next_quarter",
                "account_churn_event_in_second_next_quarter", "churn_label_q1_rolling", "churn_label_q2_rolling",
                "subscription_id_asof_qend", "subscription_end_date_asof_qend", "end_date_inferred")


def processed_panel_for(spark: SparkSession, sf_dir: str, **kw) -> DataFrame:
    return processed_quarter_panel(load_facts(spark, sf_dir), **kw)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, fmt: str = "parquet", compression: str | None = None) -> None:
    """A4/A5: stage sink (parquet by default; CSV with a header on request)."""
    w = df.write.mode("overwrite")
    if compression is not None:
        w = w.option("compression", compression)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


# ------------------------------------------------------------------ stage tables between jobs (A2, A4)

SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@dataclass(frozen=True)
class Stage:
    """A stored stage, bucketed by account and sorted inside a bucket, so that
    the next job's account windows and joins read it without an exchange.  An
    account's panel rows are no more than the periods, so no bucket is hot."""
    name: str
    path: str
    buckets: int
    keys: tuple[str, ...] = ("account_id",)
    order: tuple[str, ...] = ("quarter_end",)

    def write(self, df: DataFrame) -> None:
        """One file a bucket: rows are dealt by the hash that names the bucket."""
        df.sparkSession.sql(f"drop table if exists {self.name}")
        (df.repartition(self.buckets, *self.keys).write.mode("overwrite").option("path", self.path)
         .bucketBy(self.buckets, *self.keys).sortBy(*self.keys, *self.order).saveAsTable(self.name))

    def open(self, spark: SparkSession) -> DataFrame:
        """The stage, in whatever session or job: its files are entered in this
        session's catalog if it does not know them, and a bucket's one file is read as sorted."""
        if spark.conf.get(SORTED_BUCKETS, None) in (None, "false"):
            spark.conf.set(SORTED_BUCKETS, "true")
        if not spark.catalog.tableExists(self.name):
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(self.path).schema.fields)
            spark.sql(f"create table {self.name} ({ddl}) using parquet clustered by ({', '.join(self.keys)}) "
                      f"sorted by ({', '.join(self.keys + self.order)}) into {self.buckets} buckets location '{self.path}'")
        return spark.table(self.name)


# ------------------------------------------------------------------ ingest job (A1, A3)

def ingest_job(spark: SparkSession, paths: dict[str, str], out_dir: str) -> DataFrame:
    """Read raw CSV tables, write them typed under ``out_dir`` and return the
    reject counts, which the writes themselves observe (no second scan)."""
    rejects = None
    for table, path in paths.items():
        own, seen = raw.Ingest(spark.read.option("header", True).csv(path), table), Observation(f"ingest {table}")
        write_table(own.observed(seen), f"{out_dir}/{table}")
        counts = raw.observed_rejects(spark, own, seen)
        rejects = counts if rejects is None else rejects.unionByName(counts)
    write_table(rejects, f"{out_dir}/rejects")
    return rejects


# ------------------------------------------------------------------ train job (H, I, A5-A7)

LABEL = "churn_label_q1_rolling"
KEYS = ["account_id", "quarter", "quarter_end", LABEL]


#: Panel columns that the feature table reads.
FEATURE_SOURCES = (*KEYS, "signup_date", "plan_tier", "seats", "avg_satisfaction", "usage_drop_flag")


def labelled_features(processed: DataFrame) -> DataFrame:
    """The feature table of a processed panel, with keys and a clean label."""
    p = clean_label_binary(ensure_label(processed), LABEL)
    p = p.withColumn(LABEL, F.col(LABEL).cast("int"))
    return features.build_feature_set(features.add_tenure(p), keep=KEYS)


def fit_model(split_df: DataFrame, params: dict | None = None) -> model.LinearSpec:
    """Spark ML's fit of the training quarters, polished until only rounding is
    left of the optimality conditions: the answer does not depend on partitions."""
    train = split_df.where(F.col("split") == "train")
    start = model.fit_logistic(train, LABEL, params)
    return fit.fit_side_by_side(train, {"all": F.lit(True)}, LABEL, params, start={"all": start})["all"]


def validation_scores(split_df: DataFrame, spec: model.LinearSpec) -> DataFrame:
    return split_df.where(F.col("split") == "valid").select(
        "account_id", "quarter", F.col(LABEL).cast("int").alias("label"), spec.probability().alias("p"))


def metrics_row(scored: DataFrame) -> DataFrame:
    """H12-H15 in one row (each part is one row)."""
    v = stored(scored)
    return metrics.roc_auc(v).crossJoin(metrics.threshold_metrics(v)).crossJoin(
        metrics.rank_metrics(v, tie_cols=["account_id", "quarter"]))


def settings_row(spark: SparkSession, params: dict | None = None) -> DataFrame:
    p = dict(model.DEFAULT_PARAMS, **(params or {}))
    l1 = p.get("l1_ratio")
    return spark.range(1).select(F.lit(float(p["C"])).alias("best_c"), F.lit(str(p["class_weight"])).alias("class_weight"),
                                 F.lit(str(p["penalty"])).alias("penalty"),
                                 F.lit(None if l1 is None else float(l1)).cast("double").alias("l1_ratio"))


def coefficient_report(spark: SparkSession, spec: model.LinearSpec) -> DataFrame:
    """Coefficients with odds ratio and direction, strongest first."""
    return spec.coefficient_table(spark).select(
        "*", F.exp("coefficient").alias("odds_ratio"),
        F.when(F.col("coefficient") >= 0, "Increase churn risk").otherwise("Decrease churn risk").alias("interpretation"))


def train_job(feature_table: DataFrame, out_dir: str, tuning: DataFrame | None = None, folds: int = 5) -> model.LinearSpec:
    """Split by time, fit, evaluate, and write under ``out_dir``: the model, its
    metrics, coefficients, preprocessing, optimality and folds (CSV with header),
    and the latest risk and demo tables.  Returns the model that was written."""
    spark = feature_table.sparkSession
    params = model.pick_params(tuning)
    table = stored(feature_table)
    split = stored(metrics.time_split(table, LABEL))
    spec = fit_model(split, params)
    model.save_spec(spark, spec, f"{out_dir}/model")
    cv = stored(model.timeseries_folds(split, LABEL, folds, params))
    latest = risk.latest_risk_output(table, spec)
    for name, df in {
        "metrics": metrics_row(validation_scores(split, spec)).crossJoin(settings_row(spark, params)),
        "validation_report": metrics.validation_report(split, LABEL),
        "coefficients": coefficient_report(spark, spec),
        "preprocessing": fit.preprocessor_table(spark, spec.terms),
        "optimality": fit.optimality(split.where(F.col("split") == "train"), spec, LABEL, params),
        "cv_folds": cv, "cv_summary": model.cv_summary(cv, params),
        "latest_risk": latest, "demo_output": risk.demo_output(latest),
    }.items():
        write_table(df, f"{out_dir}/{name}", fmt="csv")
    return spec


def load_model(spark: SparkSession, paths: Sequence[str]) -> model.LinearSpec:
    """The first of the given models that exists; other read errors are raised."""
    for p in paths:
        try:
            return model.load_spec(spark, p)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"there is no stored model at any of {list(paths)}")


# ------------------------------------------------------------------ score job (A8, J, K, L)

MODES = {"single": ["single"], "multi": ["accounts", "subscriptions"], "quarterly": ["new"]}
OPTIONAL = {"single": [], "multi": ["usage", "tickets"], "quarterly": ["history"]}


#: types of a quarterly upload's columns; the other modes' builders read what they use by themselves
QUARTERLY_TYPES = {"as_of_quarter": "date", "signup_date": "date"} | dict.fromkeys(
    ["usage_count_total", "ticket_count", "avg_csat", "avg_resolution_hours", "avg_first_response_minutes", "escalation_count",
     "auto_renew_flag", "days_to_contract_end", "seats", "arr_amount", "mrr_amount"], "double")


def read_uploads(spark: SparkSession, mode: str, paths: dict[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """The tables of an upload by mode; optional ones may be absent."""
    if mode not in MODES:
        raise ValueError(f"no such mode: {mode!r}; there are {sorted(MODES)}")
    absent = [t for t in MODES[mode] if t not in paths]
    unknown = [t for t in paths if t not in MODES[mode] + OPTIONAL[mode]]
    if absent or unknown:
        raise ValueError(f"mode {mode!r}: tables not given {absent}, tables it does not know {unknown}")
    if fmt == "csv":
        tables = {t: raw.read_upload(spark, p, with_order=mode == "quarterly") for t, p in paths.items()}
    else:
        tables = {t: apply_aliases(spark.read.parquet(p)) for t, p in paths.items()}
    if mode == "quarterly":
        tables = {t: df.withColumns({c: F.col(c).try_cast(k) for c, k in QUARTERLY_TYPES.items() if c in df.columns}) for t, df in tables.items()}
    return tables


def upload_features(mode: str, tables: dict[str, DataFrame], today: dt.date, strict_prior: bool = False) -> DataFrame:
    if mode == "single":
        return upload.build_from_single(tables["single"], today)
    if mode == "multi":
        return upload.build_from_multi(tables["accounts"], tables["subscriptions"], tables.get("usage"), tables.get("tickets"), today)
    return upload.build_from_quarterly(tables.get("history"), tables["new"], today, strict_prior)


def score_job(spark: SparkSession, mode: str, paths: dict[str, str], models: Sequence[str], today: dt.date, out_dir: str | None = None,
              fmt: str = "csv", high: float = 0.50, medium: float = 0.35, row_level: bool = False, strict_prior: bool = False) -> dict[str, DataFrame]:
    """Upload -> features -> stored model -> explained, tiered scores and the
    report tables.  ``out_dir``: write each of them there as well (the scored
    table without display columns, the renewed history in quarterly mode)."""
    tables = read_uploads(spark, mode, paths, fmt)
    spec = load_model(spark, models)
    feats = stored(upload_features(mode, tables, today, strict_prior))
    scored = stored(explain.score(feats, spec, high, medium, row_level))
    out = {"scored": scored, "kpis": report.kpis(scored), "tier_counts": report.tier_counts(scored),
           "prob_histogram": report.prob_histogram(scored, 18).unionByName(report.prob_histogram(scored, 24)),
           "top_risk": report.top_risk(scored), "driver_counts": report.driver_counts(scored),
           "score_health": report.score_health(scored, feats)}
    if mode == "multi":
        out["coverage"] = report.coverage(tables["accounts"], tables["subscriptions"], tables.get("usage"), tables.get("tickets"))
    if out_dir is not None:
        for name, df in out.items():
            if name == "scored":
                report.export_scored(df, f"{out_dir}/scored")
            else:
                write_table(df, f"{out_dir}/{name}", fmt="csv")
        if mode == "quarterly":
            renewed = upload.renew_history(tables.get("history"), tables["new"])
            write_table(renewed.drop("_row_order"), f"{out_dir}/history")
    return out
