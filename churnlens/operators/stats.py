"""Global statistics that stay distributed.

* ``exact_quantiles`` -- pandas/numpy ``linear`` quantiles, exact, by selection:
  each pass counts the values of the open intervals in ``BUCKETS`` buckets and
  keeps the buckets that hold a wanted rank, until such a bucket holds one
  value.  A pass is one map-side combined aggregate of bounded size: no sort,
  no range exchange, no task that holds the distinct values.
* ``moments`` -- one aggregate row (mean / population or sample std) that is
  joined back as a 1-row broadcast (a proven size bound).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.session import stored

BUCKETS = 4096


def unpivot_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(*by, feature, v) for every non-null value of the given numeric columns."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])
    return df.select(*by, F.explode(arr).alias("x")).select(*by, "x.feature", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    names: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per feature (and group of ``by``, which must be few): ``feature``
    plus one column per probability.  Values are finite or missing (null, NaN)."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    spark = df.sparkSession
    wide = stored(df.select(*by, *[_value(c).alias(c) for c in cols]), "values")
    wanted, found, open_ = {}, {}, []
    for key, n, low, high in _ends(wide, cols, by):
        places = [(n - 1) * float(p) for p in probs]
        wanted[key] = [(math.floor(h), math.ceil(h), h - math.floor(h)) for h in places]
        ranks = sorted({k for lo, hi, _ in wanted[key] for k in (lo, hi)})
        open_.append((key, low, high, ranks))
    first = True
    while open_:
        for key, lo, hi, ranks in open_:
            if lo == hi:
                found.update({(key, k): lo for k, _ in _local(ranks)})
        open_ = [o for o in open_ if o[1] < o[2]]
        if open_:
            open_ = _refine(spark, wide, cols, by, open_, logarithmic=first)
        first = False
    rows = []
    for key, places in wanted.items():
        values = [(found[key, lo], found[key, hi], part) for lo, hi, part in places]
        rows.append((*key, *[a + part * (b - a) for a, b, part in values]))
    fields = [df.schema[k] for k in by] + [T.StructField("feature", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in names]
    return spark.createDataFrame(rows, T.StructType(fields))


def _local(ranks: list) -> list[tuple[int, int]]:
    """(rank in the whole, rank in the interval); both are the same at first."""
    return [(k, k) if isinstance(k, int) else k for k in ranks]


def _value(c: str) -> Column:
    """The column as a double, null if it is missing."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _ends(wide: DataFrame, cols: Sequence[str], by: Sequence[str]) -> list[tuple]:
    """(key, count, least, greatest) per feature (and group) that has a value."""
    if by:
        keys = [*by, "feature"]
        rows = unpivot_values(wide, cols, by).groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        return [(tuple(r[k] for k in keys), r["n"], r["lo"], r["hi"]) for r in rows]  # a row per feature and group
    aggs = [f(c).alias(f"{name}{i}") for i, c in enumerate(cols)
            for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]
    r = wide.agg(*aggs).first()  # one row, and no row per value
    return [((c,), r[f"n{i}"], r[f"lo{i}"], r[f"hi{i}"]) for i, c in enumerate(cols) if r[f"n{i}"]]


def _scale(v: Column, logarithmic: bool) -> Column:
    return F.signum(v) * F.log1p(F.abs(v)) if logarithmic else v / 2  # halves: no overflow


def _bucket(v: Column, lo: Column, hi: Column, logarithmic: bool) -> Column:
    place = (_scale(v, logarithmic) - _scale(lo, logarithmic)) / (_scale(hi, logarithmic) - _scale(lo, logarithmic))
    return F.least(F.floor(place * BUCKETS), F.lit(BUCKETS - 1))


def _counted(wide: DataFrame, cols: Sequence[str], cuts: list) -> DataFrame:
    """``_counted_by`` without groups: the intervals are literals, so a row becomes
    the values that lie in one, and a row without such a value none."""
    inside = lambda x: F.coalesce((F.col(x[0][0]) >= F.lit(x[2])) & (F.col(x[0][0]) <= F.lit(x[3])), F.lit(False))
    held = {c: [x for x in cuts if x[0] == (c,)] for c in cols}
    places = []
    for c in (c for c in cols if held[c]):
        i = F.lit(None).cast("int")
        for x in held[c]:  # the intervals of a feature are apart
            i = F.when(inside(x), F.lit(x[1])).otherwise(i)
        places.append(F.struct(i.alias("i"), F.col(c).alias("v")))
    some = wide.where(reduce(lambda a, b: a | b, [inside(x) for x in cuts]))
    x = some.select(F.explode(F.array(*places)).alias("x")).select("x.i", "x.v").where(F.col("i").isNotNull())
    lo, hi, log = [F.array(*[F.lit(c[k]) for c in cuts])[F.col("i")] for k in (2, 3, 4)]  # the i-th cut is at place i
    return _in_buckets(x.select("i", "v", lo.alias("lo"), hi.alias("hi"), log.alias("log")))


def _in_buckets(inside: DataFrame) -> DataFrame:
    place = [_bucket(F.col("v"), F.col("lo"), F.col("hi"), log) for log in (True, False)]
    return (inside.groupBy("i", F.when(F.col("log"), place[0]).otherwise(place[1]).alias("b"))
            .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")))


def _counted_by(spark, wide: DataFrame, cols: Sequence[str], by: Sequence[str], cuts: list) -> DataFrame:
    """Per interval and bucket that holds values: how many, the least and the greatest."""
    cut = spark.createDataFrame([(*key, *rest) for key, *rest in cuts], T.StructType(
        [wide.schema[k] for k in by] + [T.StructField("feature", T.StringType()), T.StructField("i", T.IntegerType()),
                                        T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
                                        T.StructField("log", T.BooleanType())]))
    inside = unpivot_values(wide, cols, by).join(F.broadcast(cut), [*by, "feature"]) \
        .where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
    return _in_buckets(inside)


def _refine(spark, wide: DataFrame, cols: Sequence[str], by: Sequence[str], open_: list, logarithmic: bool) -> list:
    """One pass: the buckets of the open intervals that hold a wanted rank, as
    new intervals from their least to their greatest value."""
    log = lambda x: math.copysign(math.log1p(abs(x)), x)
    cuts, targets = [], []
    for i, (key, lo, hi, ranks) in enumerate(open_):
        use_log = logarithmic and log(lo) < log(hi)  # heavy tails: spread by magnitude first
        cuts.append((key, i, lo, hi, use_log))
        targets += [(i, k, at) for k, at in _local(ranks)]
    target = spark.createDataFrame(targets, "i int, rank long, at long")
    buckets = _counted_by(spark, wide, cols, by, cuts) if by else _counted(wide, cols, cuts)
    # at most BUCKETS rows an interval, and a few intervals a feature
    so_far = Window.partitionBy("i").orderBy("b")
    placed = buckets.select("*", (F.sum("c").over(so_far) - F.col("c")).alias("below"))
    hit = (F.col("at") >= F.col("below")) & (F.col("at") < F.col("below") + F.col("c"))
    rows = placed.join(F.broadcast(target), "i").where(hit).select("i", "b", "lo", "hi", "below", "rank", "at").collect()
    out: dict = {}
    for r in rows:  # a row per wanted rank
        out.setdefault((r["i"], r["b"]), (open_[r["i"]][0], r["lo"], r["hi"], []))[3].append((r["rank"], r["at"] - r["below"]))
    return list(out.values())


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                     names: Sequence[str] | None = None, accuracy: int = 100000) -> DataFrame:
    """Explicit scale option: ``percentile_approx`` (bounded memory per task)."""
    names = list(names or [f"q{i}" for i in range(len(probs))])
    long = unpivot_values(df, cols)
    pa = F.percentile_approx("v", list(map(float, probs)), accuracy)
    return long.groupBy("feature").agg(pa.alias("qs")).select(
        "feature", *[F.col("qs")[i].alias(nm) for i, nm in enumerate(names)])


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float], method: str = "exact") -> DataFrame:
    """One wide row ``{col}__q{i}`` so it can be broadcast-joined back."""
    names = [f"q{i}" for i in range(len(probs))]
    long = (exact_quantiles(df, cols, probs, names) if method == "exact"
            else approx_quantiles(df, cols, probs, names))
    aggs = []
    for c in cols:
        for nm in names:
            aggs.append(F.max(F.when(F.col("feature") == c, F.col(nm))).alias(f"{c}__{nm}"))
    return long.agg(*aggs)
