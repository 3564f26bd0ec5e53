"""Spark session and checkpoint-directory helpers.

Production clusters name a shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session and only fall back to a scratch folder when it is
unset under a ``local[...]`` master (tests).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
#: The JVM interprets a method of more bytecode than this forever.  A wide
#: projection fused into one stage is such a method; not fused, it is split.
COMPILED_METHODS = {"spark.sql.codegen.hugeMethodLimit": "8000"}
#: Rows dealt by an account meet others dealt by it without being dealt again by all keys of
#: the join, and sides whose partitions are all small are hashed instead of sorted.
JOINS = {"spark.sql.requireAllClusterKeysForCoPartition": "false",
         "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB"}
DEFAULT_CONF |= COMPILED_METHODS | JOINS


def compile_projections(spark: SparkSession) -> None:
    """Have wide projections compiled and joins planned alike in this session too, unless it has settings of its own."""
    for k, v in (COMPILED_METHODS | JOINS).items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "churnlens",
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring the cluster setting.

    Only a ``local[...]`` master, whose tasks share the driver's disk, may fall
    back to a scratch folder; anywhere else a missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="churnlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name beside the checkpoints, for tables that one job writes and another reads."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint (never localCheckpoint): survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def stored(df, name: str = "rows"):
    """``df`` as a Parquet table beside the checkpoints, read again.  It cuts the lineage as a
    checkpoint does and is fixed like one, but columns are packed and read by themselves: a
    checkpoint holds whole rows.  How its rows were dealt and sorted is not kept."""
    if any(f.dataType.typeName() == "void" for f in df.schema.fields):  # Parquet has no such type
        return cut_lineage(df)
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that their
    functions import from any working directory and on any cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_churnlens_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="churnlens-code-"), "churnlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(here):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), os.path.dirname(here)))
    sc.addPyFile(path)
    sc._churnlens_shipped = True
