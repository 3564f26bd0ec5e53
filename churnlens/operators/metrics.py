"""Evaluation metrics (H2, H12-H15, H20) and average percent rank (K2).

Every metric that needs a global order (AUC, top-k, percent rank) works on
distinct values or on the rows via ``sequence_within`` without a key, which
range-partitions the order instead of collapsing it into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.periods import period_index, period_label
from churnlens.operators.ordered import sequence_within


SALTS = 32


def with_quarter_idx(df: DataFrame) -> DataFrame:
    """Quarter order from ``quarter_end`` (text label when absent)."""
    return df.withColumn("_q_idx", period_index(F.to_date("quarter_end")))


def time_split(df: DataFrame, label_col: str = "churn_label_q1_rolling", n_valid: int = 2) -> DataFrame:
    """H1/H2: labelled rows only; the last ``n_valid`` labelled quarters are
    validation.  Adds ``split`` = train | valid (needs >= 2 quarters)."""
    lab = with_quarter_idx(df.where(F.col(label_col).isNotNull()))
    # at most n_valid quarter numbers: fetched once, used as literals
    last = [r[0] for r in lab.select("_q_idx").distinct().orderBy(F.col("_q_idx").desc()).limit(n_valid).collect()]
    if len(last) < n_valid:
        raise ValueError(f"a split by time needs {n_valid} labelled quarters or more, there are {len(last)}")
    return lab.withColumn("split", F.when(F.col("_q_idx").isin(*last), "valid").otherwise("train"))


def roc_auc(scored: DataFrame, label_col: str = "label", score_col: str = "p") -> DataFrame:
    """Exact rank-sum AUC with average ties; null when one class only.
    Works on distinct scores: pos/neg counts per score, running negatives
    below in score order, then one sum."""
    g = scored.groupBy(F.col(score_col).alias("s")).agg(
        F.sum(F.col(label_col).cast("long")).alias("pos"),
        F.sum((1 - F.col(label_col)).cast("long")).alias("neg"))
    seq = sequence_within(g, key_cols=[], order_cols=[F.col("s").asc()], running_sums={"neg": "cum_neg"})
    part = seq.select(F.col("pos"), F.col("neg"),
                      (F.col("pos") * (F.col("cum_neg") - F.col("neg") + 0.5 * F.col("neg"))).alias("u"))
    t = part.agg(F.sum("u").alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return t.select(F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u") / (F.col("n_pos") * F.col("n_neg")))
                    .alias("validation_auc"))


def grouped_auc(scored: DataFrame, by: str, label_col: str = "label", score_col: str = "p") -> DataFrame:
    """H12 for every value of ``by`` in one pass: (by, n_pos, n_neg, auc)."""
    g = scored.groupBy(by, F.col(score_col).alias("s")).agg(
        F.sum(F.col(label_col).cast("long")).alias("pos"), F.sum((1 - F.col(label_col)).cast("long")).alias("neg"))
    seq = sequence_within(g, key_cols=[by], order_cols=[F.col("s").asc()], running_sums={"neg": "cum_neg"})
    t = seq.groupBy(by).agg(F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))).alias("u"),
                            F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return t.select(by, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                                 F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def threshold_metrics(scored: DataFrame, label_col: str = "label", score_col: str = "p",
                      threshold: float = 0.5) -> DataFrame:
    """Precision / recall at a threshold (0 when undefined)."""
    pred = F.col(score_col) >= threshold
    y = F.col(label_col) == 1
    a = scored.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred).alias("pp"), F.count_if(y).alias("ap"))
    return a.select(
        F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0).alias("validation_precision_at_0_5"),
        F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(0.0).alias("validation_recall_at_0_5"))


def threshold_curve(scored: DataFrame, thresholds: list[float], label_col: str = "label", score_col: str = "p") -> DataFrame:
    """H13 at several thresholds in one aggregate: a row per threshold."""
    y = F.col(label_col) == 1
    a = scored.agg(F.count_if(y).alias("ap"), *[x for i, t in enumerate(thresholds) for x in (
        F.count_if((F.col(score_col) >= t) & y).alias(f"tp{i}"), F.count_if(F.col(score_col) >= t).alias(f"pp{i}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"pp{i}").alias("pp"), F.col("ap"))
                               for i, t in enumerate(thresholds)])).alias("r")
    r = a.select(rows).select("r.*")
    return r.select("threshold", F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0).alias("precision"),
                    F.when(F.col("ap") > 0, F.col("tp") / F.col("ap")).otherwise(0.0).alias("recall"), F.col("pp").alias("n_flagged"))


def rank_metrics(scored: DataFrame, label_col: str = "label", score_col: str = "p",
                 tie_cols: list[str] | None = None) -> DataFrame:
    """precision/recall at the top 5/10/20 % (k = ceil), lift at
    10 %, and the first k with the best precision / recall.  Rows are ordered
    by score desc then ``tie_cols``, numbered by the range-based sequencer."""
    order = [F.col(score_col).desc()] + [F.col(c).asc() for c in (tie_cols or [])]
    seq = sequence_within(scored.select(score_col, label_col, *(tie_cols or [])), key_cols=[],
                          order_cols=order, seq_col="k", running_sums={label_col: "tp"})
    t = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label_col).cast("double")).alias("npos")).first()
    n, npos = int(t["n"]), float(t["npos"] or 0.0)
    j = seq.select("*", F.lit(n).alias("n"), F.lit(npos).alias("npos"),
                   *[F.ceil(F.lit(n) * F.lit(f)).cast("long").alias(nm)
                     for f, nm in ((0.05, "k5"), (0.10, "k10"), (0.20, "k20"))])
    prec = F.col("tp") / F.col("k")
    rec = F.when(F.col("npos") > 0, F.col("tp") / F.col("npos")).otherwise(F.lit(0.0))
    j = j.select("*", prec.alias("prec"), rec.alias("rec"))
    first_best = {c: F.max_by("k", F.struct(F.col(c), -F.col("k"))) for c in ("prec", "rec")}
    at = j.agg(
        F.max(F.when(F.col("k") == F.col("k5"), F.col("prec"))).alias("precision_top5"),
        F.max(F.when(F.col("k") == F.col("k5"), F.col("rec"))).alias("recall_top5"),
        F.max(F.when(F.col("k") == F.col("k10"), F.col("prec"))).alias("precision_top10"),
        F.max(F.when(F.col("k") == F.col("k20"), F.col("rec"))).alias("recall_top20"),
        F.max("prec").alias("best_precision_at_k"), F.max("rec").alias("best_recall_at_k"),
        first_best["prec"].alias("best_precision_k"), first_best["rec"].alias("best_recall_k"))
    base = npos / n if n else 0.0
    lift = F.col("precision_top10") / F.lit(base) if base > 0 else F.lit(None).cast("double")
    return at.select(
        "precision_top5", "recall_top5", "precision_top10", "recall_top20", lift.alias("lift_top10"),
        "best_precision_at_k", "best_precision_k", "best_recall_at_k", "best_recall_k")


def pct_ranks(df: DataFrame, value_cols: dict[str, str], id_col: str) -> DataFrame:
    """K2 for several columns at once, {value: output}: average rank / non-null
    count (pandas ``rank(pct=True)``); null stays null.  ``id_col`` is unique.

    The values are unpivoted to (column, value, id) and numbered together; the
    rank of a value is the mean of its first and last number, which a window
    over the *numbered distinct values* gives, and the ranks come back by id,
    so no join has a value for its key."""
    names = list(value_cols)
    long = df.select(F.col(id_col), F.explode(F.array(*[
        F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(names)])).alias("x")
    ).select(id_col, "x.c", "x.v").where(F.col("v").isNotNull())
    # rows of equal value are told apart by id: a dominant value is spread over range partitions
    seq = sequence_within(long, key_cols=["c"], order_cols=[F.col("v").asc(), F.col(id_col).asc()], seq_col="k")
    per_value = seq.groupBy("c", "v").agg(((F.min("k") + F.max("k")) / 2.0).alias("r"))
    n = {r["c"]: r["n"] for r in long.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per column
    size = F.coalesce(*[F.when(F.col("c") == i, F.lit(m)) for i, m in n.items()], F.lit(1))
    # a dominant value is a hot join key: deal its rows over salts, its one rank to each salt
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    ranked = (seq.withColumn("salt", F.pmod("k", F.lit(SALTS)).cast("int"))
              .join(per_value.withColumn("salt", salts), ["c", "v", "salt"]).groupBy(id_col).agg(*[
                  F.max(F.when(F.col("c") == i, F.col("r") / size)).alias(out) for i, out in enumerate(value_cols.values())]))
    return df.join(ranked, id_col, "left")


def validation_report(split_df: DataFrame, label_col: str = "churn_label_q1_rolling") -> DataFrame:
    """Validation sample count, class rates, quarter lists, n_train/n_valid."""
    lab = F.col(label_col).cast("double")
    q = period_label(F.col("_q_idx"), "quarter")
    return split_df.agg(
        F.count_if(F.col("split") == "valid").alias("validation_sample_count"),
        F.avg(F.when(F.col("split") == "valid", lab)).alias("validation_positive_rate"),
        F.avg(F.when(F.col("split") == "valid", 1 - lab)).alias("validation_negative_rate"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") == "train", q))), ",").alias("train_quarters"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") == "valid", q))), ",").alias("valid_quarters"),
        F.count_if(F.col("split") == "train").alias("n_train"),
        F.count_if(F.col("split") == "valid").alias("n_valid"))
