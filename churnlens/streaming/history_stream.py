"""Quarterly-history renewal as a Structured Streaming job.

New quarterly uploads land as files in a folder; each micro-batch is merged
into the keyed history (append + keep the last row per (account, quarter)).
The table is stored by quarter: a batch reads and writes the quarters that it
holds and no other.  Version ``v`` writes ``v=<v>/q=<quarter>`` and then commits
one log row: the stream (the id in its checkpoint's metadata), the batch, and
the manifest, which names the version that holds each quarter.  The log row is
the commit: without it the files of a version are invisible and written again.

A replayed batch that is in the log is done.  A second stream, or one with a new
checkpoint, goes on from the newest version.  Only a missing log means that
there is no history yet; any other read error stops the stream.  All paths must
be on shared storage in a cluster, and one stream at a time writes a table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlens.functions.periods import quarter_start_of
from churnlens.operators.upload import renew_history

LATEST = "_latest_version"
LOG = "v long, stream string, batch long, manifest map<string, long>"
PLACE = ["_from_file", "_from_byte"]  # where a streamed row was read
NO_QUARTER = "none"  # rows without a readable quarter


def _log(spark: SparkSession, table_path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LOG).json(f"{table_path}/{LATEST}")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def latest_version(spark: SparkSession, table_path: str) -> int | None:
    log = _log(spark, table_path)
    return None if log is None else log.agg(F.max("v").alias("v")).first()["v"]


def manifest(spark: SparkSession, table_path: str) -> dict[str, int]:
    """Quarter -> version that holds it, as of the newest commit."""
    log = _log(spark, table_path)
    row = None if log is None else log.agg(F.max_by("manifest", "v").alias("m")).first()
    return dict(row["m"]) if row and row["m"] else {}


def _read(spark: SparkSession, table_path: str, held: dict[str, int]) -> DataFrame | None:
    paths = [f"{table_path}/v={v}/q={q}" for q, v in sorted(held.items())]
    return spark.read.option("mergeSchema", True).parquet(*paths) if paths else None


def read_history(spark: SparkSession, table_path: str) -> DataFrame | None:
    return _read(spark, table_path, manifest(spark, table_path))


def upsert_batch(table_path: str, checkpoint: str):
    """foreachBatch function: merge the batch into the quarters that it touches.
    Of a key's rows the last counts, by ``PLACE`` (if the batch has it) and row."""
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        stream = spark.read.text(f"{checkpoint}/metadata").first()[0]
        log = _log(spark, table_path)
        if log is not None and not log.where((F.col("stream") == stream) & (F.col("batch") == batch_id)).isEmpty():
            return  # committed before a restart
        held, last = manifest(spark, table_path), latest_version(spark, table_path)
        v = 0 if last is None else last + 1
        place = [c for c in PLACE if c in batch.columns]
        new = batch.withColumn("_row_order", F.struct(*place, F.monotonically_increasing_id().alias("n"))).drop(*place)
        quarter = F.coalesce(quarter_start_of(F.coalesce(F.col("as_of_quarter").try_cast("date"), F.to_date(
            F.col("as_of_quarter").try_cast("timestamp")))).cast("string"), F.lit(NO_QUARTER))
        touched = [r["q"] for r in new.select(quarter.alias("q")).distinct().collect()]  # quarters of a calendar
        current = _read(spark, table_path, {q: held[q] for q in touched if q in held})
        if current is not None:  # one row a key, so none of them came later than another
            current = current.withColumn("_row_order", F.lit(None).cast(new.schema["_row_order"].dataType))
        renewed = renew_history(current, new).drop("_row_order").withColumn("q", quarter)
        renewed.repartition("q", F.pmod(F.xxhash64("account_id"), F.lit(SHARES))).write.mode("overwrite").partitionBy("q").parquet(f"{table_path}/v={v}")
        commit = held | dict.fromkeys(touched, v)
        spark.createDataFrame([(v, stream, batch_id, commit)], LOG).coalesce(1).write.mode("append").json(f"{table_path}/{LATEST}")
    return run


SHARES = 8  # files that a large quarter is written as


def start(spark: SparkSession, source_dir: str, schema: T.StructType, table_path: str, checkpoint: str,
          fmt: str = "parquet", available_now: bool = True):
    """Start the renewal stream; returns the StreamingQuery.  Of a batch's rows
    the last counts: files by name, rows by their place in the file."""
    reader = spark.readStream.schema(schema)
    files = reader.option("header", True).csv(source_dir) if fmt == "csv" else reader.parquet(source_dir)
    stream = files.select("*", F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.file_block_start").alias(PLACE[1]))
    w = stream.writeStream.foreachBatch(upsert_batch(table_path, checkpoint)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
