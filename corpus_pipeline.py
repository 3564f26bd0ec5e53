"""From raw documents to packed training sequences, in five stages.

Each stage reads what its predecessor wrote and returns a DataFrame; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from churnlens.llm import mixing, near_dedup, packing, paragraph_dedup, passages, quality
from churnlens.llm.common import table
from churnlens.session import cut_lineage, ensure_checkpoint_dir


def keep_quality(spark, docs, sf_dir):
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each near-duplicate class."""
    return near_dedup.keep_one(docs, near_dedup.near_duplicates(docs))


def drop_repeated_paragraphs(spark, docs, sf_dir):
    """Texts without the later occurrences of repeated paragraphs and passages."""
    lines = cut_lineage(paragraph_dedup.repeated_paragraphs(docs))
    body = "_body_before"
    cut = passages.without_passages(docs.withColumn(body, F.xxhash64("text")), passages.repeated_passages(docs, lines))
    return paragraph_dedup.without_repeats(cut, lines, F.col(body)).drop(body)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix copies them."""
    return mixing.repeat(docs, mixing.mix(docs))


def pack_sequences(spark, docs, sf_dir):
    """Tokenised pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_paragraphs),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Trained and iterative stages are not SQL; tests/llm/test_pipeline.py holds each against plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the whole ``documents`` table.  Each stage is
    written as Parquet in the shared folder, under a name of this run's own, and
    read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    base = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        path = f"{base}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
