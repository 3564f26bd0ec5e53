"""Shared helpers of the training-data operators.

A *word* is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; on UTF-8 bytes
``bytes.split()`` cuts at exactly these, and ``bytes.lower()`` lowers exactly
A-Z, so Python tasks work on the bytes and the native expressions below on the
text, with equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.session import scratch_path, ship_package

SPACES = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(inner) > 0, F.split(inner, SPACES)).otherwise(F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod ``parts``; a null id has none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of the text, empty for null."""
    return F.coalesce(F.col(name).cast("string").cast("binary"), F.lit(b"")).alias("text")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table beside the checkpoints, read again: for wide
    rows, which a checkpoint would hold uncompressed."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(fn: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema):
    """A ``mapInArrow`` function from one that turns a batch into columns."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows and (cols := fn(b)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)
    return run


def spark_schema(schema: pa.Schema):
    from pyspark.sql.pandas.types import from_arrow_schema
    return from_arrow_schema(schema)


def map_arrow(df: DataFrame, fn, schema: pa.Schema) -> DataFrame:
    """``mapInArrow`` with ``fn``: batch -> columns (None: no rows)."""
    ship_package(df.sparkSession)
    return df.mapInArrow(per_batch(fn, schema), spark_schema(schema))


def bounded_share(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``; every row if
    there are fewer.  Only for fitting on labelled rows: the bound is stated."""
    n = df.count()
    if n <= bound:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("share")), F.lit(1 << 30)) < int((1 << 30) * bound / n))


def labelled_sample(spark: SparkSession, docs: DataFrame, labels: DataFrame, label: str, bound: int,
                    parts: int = 3, held_out: int = 1) -> DataFrame:
    """``docs`` rows outside the held-out fold with their label ``y``; at most
    about ``bound`` label rows are taken, so their ids can be broadcast.
    A document whose label rows disagree, or are neither 0 nor 1, is left out."""
    own = (labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id"), parts) != held_out))
           .groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("_y")).where("y = _y").drop("_y"))
    own = bounded_share(own, F.col("doc_id"), bound)
    return docs.join(F.broadcast(own), "doc_id")


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 30, offset: bool = True,
             weight: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for logistic loss; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))]) if offset else x
    w, sw = np.zeros(x.shape[1]), np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    if offset:
        ridge[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (sw * (p - y)) + ridge * w
        h = (x * (sw * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(ridge)
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 5.0 / (np.abs(d).max() + 1e-12))
        if np.abs(d).max() < 1e-8:
            break
    return w
