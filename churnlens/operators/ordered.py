"""Ordered sequencing inside (optional) keys: row number, lead, running sums.

``Window.partitionBy(key).orderBy(...)`` sends a whole key to one task, and a
window without ``partitionBy`` sends the whole table to one task.  When a key
may hold a large share of the rows (or there is no key at all) that does not
scale.  One plan serves every size:

1. range-partition on (key, order), so that a hot key is spread over several
   consecutive partitions, and store the partition number as a column;
2. window inside (stored partition, key): a group is never larger than one
   range partition;
3. store that as a table beside the checkpoints, so that the stored numbers are fixed
   whatever later regroups or recomputes the rows;
4. a key that continues from an earlier partition gets the totals of its
   earlier partitions added, and the last row of a key's share of a partition
   gets the next share's first row as its lead.  At most one key per partition
   continues and at most one goes on, so this correction has at most two rows
   a partition and is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.session import stored

PART, LOCAL = "_seq_part", "_seq_local"


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sequence_within(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence,
                    seq_col: str | None = None, lead_cols: dict[str, str] | None = None,
                    running_sums: dict[str, str] | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """Add ``seq_col`` (1-based), ``lead_cols`` {src: dst} (next row's value
    within the key, else null) and ``running_sums`` {src: dst} (inclusive
    running sum as double; null while every value so far is null) in the order
    ``order_cols`` inside ``key_cols``.  ``order_cols`` must make the order
    total (end with a unique key).  Null keys form one group."""
    lead_cols, running_sums, keys = dict(lead_cols or {}), dict(running_sums or {}), list(key_cols)
    order = [_as_col(c) for c in order_cols]
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = Window.partitionBy(PART, *keys).orderBy(*order)
    so_far = share.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order)
             .withColumn(PART, F.spark_partition_id())
             .select("*", F.row_number().over(share).cast("long").alias(LOCAL),
                     F.count(F.lit(1)).over(Window.partitionBy(PART, *keys)).alias("_seq_size"),
                     *[F.lead(s).over(share).alias(d) for s, d in lead_cols.items()],
                     *[F.sum(F.col(s).cast("double")).over(so_far).alias(d) for s, d in running_sums.items()]))
    local = stored(local, "sequence")

    # one row per (key, partition): its size and sums stand in its last row, its lead value in its first
    ends = local.where(F.col(LOCAL) == F.col("_seq_size")).select(
        PART, *keys, F.col("_seq_size").alias("_n"), *[F.col(d).alias(f"_s{i}") for i, d in enumerate(running_sums.values())])
    firsts = local.where(F.col(LOCAL) == 1).select(
        PART, *keys, *[F.col(s).alias(f"_f{i}") for i, s in enumerate(lead_cols)])
    shares = ends.join(firsts, _same(ends, firsts, [PART, *keys])).select(
        ends[PART], *[ends[k] for k in keys], "_n", *[f"_s{i}" for i in range(len(running_sums))],
        *[f"_f{i}" for i in range(len(lead_cols))]) if lead_cols else ends
    by_part = Window.partitionBy(*keys).orderBy(PART)
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    fix = (shares.select(F.col(PART).alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                         F.sum("_n").over(before).alias("_n0"), F.lead(F.lit(True)).over(by_part).alias("_goes_on"),
                         *[F.sum(f"_s{i}").over(before).alias(f"_s{i}") for i in range(len(running_sums))],
                         *[F.lead(f"_f{i}").over(by_part).alias(f"_f{i}") for i in range(len(lead_cols))])
           .where(F.col("_n0").isNotNull() | F.col("_goes_on")))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)],
                F.col(PART) == F.col("_p"))
    last = (F.col(LOCAL) == F.col("_seq_size")) & F.col("_goes_on")
    out = [F.col(c) for c in df.columns]
    if seq_col:
        out.append((F.col(LOCAL) + F.coalesce(F.col("_n0"), F.lit(0))).alias(seq_col))
    out += [F.when(last, F.col(f"_f{i}")).otherwise(F.col(d)).alias(d) for i, d in enumerate(lead_cols.values())]
    out += [F.coalesce(F.col(d) + F.col(f"_s{i}"), F.col(d), F.col(f"_s{i}")).alias(d)
            for i, d in enumerate(running_sums.values())]
    return local.join(F.broadcast(fix), on, "left").select(*out)


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in cols])
