"""Raw-table sources (A1, A3, A8): explicit schemas, type coercion, uploads.

Schemas are declared, never inferred from data.  Coercion keeps ids as text,
parses dates / timestamps with ``try_*`` so bad values become null; ``Ingest``
counts them by column, and the rows it drops for want of an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from churnlens.sources.aliases import apply_aliases, normalize_headers

# Declared raw schemas (Spark DDL); dates/timestamps are read as text and
# coerced so that unparseable values become null instead of failing the scan.
RAW_SCHEMAS = {
    "accounts": "account_id string, account_name string, industry string, country string, signup_date string, "
                "referral_source string, plan_tier string, seats int, is_trial boolean, churn_flag boolean",
    "subscriptions": "subscription_id string, account_id string, start_date string, end_date string, "
                     "plan_tier string, seats int, mrr_amount double, arr_amount double, is_trial boolean, "
                     "upgrade_flag boolean, downgrade_flag boolean, churn_flag boolean, billing_frequency string, "
                     "auto_renew_flag boolean",
    "feature_usage": "usage_id string, subscription_id string, usage_date string, feature_name string, "
                     "usage_count int, usage_duration_secs int, error_count int, is_beta_feature boolean",
    "support_tickets": "ticket_id string, account_id string, submitted_at string, closed_at string, "
                       "resolution_time_hours double, priority string, first_response_time_minutes int, "
                       "satisfaction_score int, escalation_flag boolean",
    "churn_events": "churn_event_id string, account_id string, churn_date string, reason_code string, "
                    "refund_amount_usd double, preceding_upgrade_flag boolean, preceding_downgrade_flag boolean, "
                    "is_reactivation boolean, feedback_text string",
}
DATE_COLS = {"accounts": ["signup_date"], "subscriptions": ["start_date", "end_date"],
             "feature_usage": ["usage_date"], "churn_events": ["churn_date"]}
TIMESTAMP_COLS = {"support_tickets": ["submitted_at", "closed_at"]}
ID_COLS = ["account_id", "subscription_id"]


def read_raw(spark: SparkSession, path: str, table: str, fmt: str = "csv") -> DataFrame:
    """A1: scan one raw table (CSV with a header, or parquet).

    CSV columns are bound by header name and cast to the declared type, a bad
    value to null; an absent column is null, others are left out."""
    if fmt != "csv":
        return spark.read.parquet(path)
    return typed_by_name(spark.read.option("header", True).csv(path), table)


def typed_by_name(text: DataFrame, table: str) -> DataFrame:
    """The declared columns of ``table`` from text columns, by header name."""
    named = normalize_headers(text)
    declared = [c.strip().split(" ") for c in RAW_SCHEMAS[table].split(",")]
    return named.select(*[(F.col(c).try_cast(t) if c in named.columns else F.lit(None).cast(t)).alias(c) for c, t in declared])


def coerce_types(df: DataFrame, table: str) -> DataFrame:
    """A3: ids as text; dates / timestamps parsed, bad values -> null."""
    out = df
    for c in ID_COLS:
        if c in out.columns:
            out = out.withColumn(c, F.col(c).cast("string"))
    for c in DATE_COLS.get(table, []):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(F.col(c).try_cast("date"),
                                               F.to_date(F.col(c).try_cast("timestamp"))))
    for c in TIMESTAMP_COLS.get(table, []):
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast("timestamp_ntz"))
    return out


def read_upload(spark: SparkSession, path: str, with_order: bool = True) -> DataFrame:
    """An uploaded CSV (header, all text), headers normalised and aliased.

    ``_row_order`` keeps the ingest order for keep-last semantics: files by
    name, rows by their place in the file (a split's start, then the row's
    number, which grows through a partition's splits)."""
    raw = spark.read.option("header", True).csv(path)
    if not with_order:
        return apply_aliases(raw)
    df = apply_aliases(raw.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                                F.monotonically_increasing_id().alias("n")).alias("_row_order")))
    return df


# ------------------------------------------------------------------ ingest with a reject count

#: ids that a row cannot do without
KEY_COLS = {"accounts": ["account_id"], "subscriptions": ["subscription_id", "account_id"], "feature_usage": ["subscription_id"],
            "support_tickets": ["account_id"], "churn_events": ["account_id"]}
BAD_VALUE, MISSING_ID = "bad value", "missing id"


class Ingest:
    """A raw text table, typed, and what was refused on the way.

    ``rows``: the declared columns with their types; a value that cannot be read
    is null, a row without one of its ids is dropped.  ``rejects``: (table,
    column, reason, n) of every column that is checked.  ``refused``: the source
    rows with a refused value or id, and the columns at fault."""

    def __init__(self, text: DataFrame, table: str):
        self.table = table
        named = normalize_headers(text)
        declared = dict(c.strip().split(" ") for c in RAW_SCHEMAS[table].split(","))
        declared |= {c: "date" for c in DATE_COLS.get(table, [])} | {c: "timestamp_ntz" for c in TIMESTAMP_COLS.get(table, [])}
        given = {c: F.nullif(F.btrim(F.col(c).cast("string")), F.lit("")) if c in named.columns else F.lit(None).cast("string") for c in declared}
        typed = {c: self._read(v, declared[c]) for c, v in given.items()}
        self._bad = {c: given[c].isNotNull() & typed[c].isNull() for c in declared if declared[c] != "string" and c in named.columns}
        self._no_id = {c: given[c].isNull() for c in KEY_COLS[table]}
        at_fault = F.array_compact(F.array(*[F.when(v, F.lit(c)) for c, v in (self._bad | self._no_id).items()]))
        self._named, self._typed, self._at_fault = named, typed, at_fault
        self.columns = list(declared)

    @staticmethod
    def _read(value, dtype: str):
        if dtype == "date":
            return F.coalesce(value.try_cast("date"), F.to_date(value.try_cast("timestamp")))
        return value if dtype == "string" else value.try_cast(dtype)

    def _counts(self) -> dict:
        return {(c, BAD_VALUE): F.count_if(v) for c, v in self._bad.items()} | {(c, MISSING_ID): F.count_if(v) for c, v in self._no_id.items()}

    @property
    def rows(self) -> DataFrame:
        return self.observed(None)

    def observed(self, observation: Observation | None) -> DataFrame:
        """The typed rows; ``observation`` gets the reject counts of the action
        that writes them, so that counting costs no scan of its own."""
        counts = [n.alias(f"{reason}:{c}") for (c, reason), n in self._counts().items()]
        seen = self._named if observation is None else self._named.observe(observation, F.count(F.lit(1)).alias("rows"), *counts)
        no_id = F.lit(False)
        for v in self._no_id.values():
            no_id = no_id | v
        return seen.where(~no_id).select(*[v.alias(c) for c, v in self._typed.items()])

    @property
    def rejects(self) -> DataFrame:
        counts = self._counts()
        one = self._named.agg(*[n.alias(f"n{i}") for i, n in enumerate(counts.values())])
        return one.select(F.explode(F.array(*[F.struct(F.lit(self.table).alias("table"), F.lit(c).alias("column"), F.lit(reason).alias("reason"),
                                                       F.col(f"n{i}").alias("n")) for i, (c, reason) in enumerate(counts)])).alias("r")).select("r.*")

    @property
    def refused(self) -> DataFrame:
        return self._named.select("*", self._at_fault.alias("at_fault")).where(F.size("at_fault") > 0)


def observed_rejects(spark: SparkSession, ingest: Ingest, observation: Observation) -> DataFrame:
    """The reject counts that an ``Observation`` holds after the rows were written."""
    got = observation.get
    rows = [(ingest.table, c, reason, got[f"{reason}:{c}"]) for c, reason in ingest._counts()]
    return spark.createDataFrame(rows, "table string, column string, reason string, n long")
