"""The registered queries of the training-data operators, on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from churnlens.llm import (chat, lm_scoring, merkle, mixing, near_dedup, packing, paragraph_dedup, passages, quality, quality_rules, search,
                           toxicity, url_filter, variants)
from churnlens.llm.common import table
from churnlens.llm.oracle import OP11, OP12, OP13
from churnlens.session import cut_lineage


def op1_lm_scoring(spark, sf_dir):
    """Log-likelihood of every document under the recurrent language model."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    """Base rules and the hashed n-gram log-likelihood ratio."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark, sf_dir):
    """Host and path rules, else the character language-model ratio."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark, sf_dir):
    """Bradley-Terry quality scores."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_top_k_search(spark, sf_dir):
    """BM25 top 10 of the documents whose id is divisible by 50, among all."""
    return search.top_k(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def op6_mixing(spark, sf_dir):
    """Copies of every document so that the sources meet their targets."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_paragraph_dedup(spark, sf_dir):
    """Every occurrence of a repeated paragraph, and of a passage repeated
    anywhere else, with its class."""
    docs = table(spark, sf_dir, "documents")
    lines = cut_lineage(paragraph_dedup.repeated_paragraphs(docs))
    return lines.unionByName(passages.repeated_passages(docs, lines))


def op8_packing(spark, sf_dir):
    """Tokenised pieces and their places in sequences of 1024."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    """Toxicity scores."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_near_dedup(spark, sf_dir):
    """Near-duplicate class of every document."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    """Words of the corpus that one edit tells apart, with form and root."""
    return variants.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_merkle_manifest(spark, sf_dir):
    """Leaf, proof and root of every document, and what a tampered leaf folds to."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_chat_formatting(spark, sf_dir):
    """Every conversation, and one that quotes control strings, formatted and read back."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(own.unionByName(extra)))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_quality_rules, op3_url_filter, op4_quality_classifier, op5_top_k_search, op6_mixing, op7_paragraph_dedup,
    op8_packing, op9_toxicity, op10_near_dedup, op11_spelling_variants, op12_merkle_manifest, op13_chat_formatting)}

#: The first ten cannot be said in SQL with equal results (trained models, other
#: engines' hashes, tokenizers); tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": OP11, "op12_merkle_manifest": OP12, "op13_chat_formatting": OP13}
