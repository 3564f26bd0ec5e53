"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf (a digest of its length-prefixed fields, made by Spark's own
``sha2``; texts never reach Python).  The leaves of a language, numbered by the
range sequencer, make a binary tree; the languages' subroots make another.

1. A *superblock* is 2^bits consecutive leaves.  It is reduced inside one group
   to its node, whatever language it belongs to, so that a language with a third
   of all rows is spread over as many groups as it has superblocks.
2. The superblocks' nodes are numbered leaves of a tree above; the same steps
   reduce it and give each of its nodes the siblings on its way up.
3. Leaves and these outer nodes are cogrouped by superblock.  One function then
   rebuilds the levels inside, joins each leaf's inner and outer siblings to a
   proof and folds the claimed leaf along it to a root.

Rows of equal id stand in the order of their leaf digests; null ids stand first;
a null language is a tree of its own, before the others.  A null, empty or very
long text is a leaf like any other.  Extra columns are not part of a leaf.  An
empty table has no rows and no root.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.operators.ordered import sequence_within
from churnlens.session import cut_lineage, ship_package

BITS = 9
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: sides of a path: the sibling stands left or right of the node, or there is none
LEFT, RIGHT, ALONE = "<", ">", "-"


# ------------------------------------------------------------------ leaves

def leaf_hash(**changed: Column) -> Column:
    """Digest of a row's fields, each ``-`` if null, else byte count, ``:``, value."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# ------------------------------------------------------------------ reduction inside a superblock

def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def levels(nodes: list[str], height: int) -> list[list[str]]:
    """The nodes, then ``height`` levels above them, two nodes to one; a last single one is hashed alone."""
    out = [nodes]
    for _ in range(height):
        below = out[-1]
        out.append([digest("".join(below[i:i + 2])) for i in range(0, len(below), 2)])
    return out


def inner_height(block: int, n: int, bits: int) -> int:
    """A first superblock that is not full is its tree's only one and reduced as far as it goes; others by ``bits`` levels."""
    return max(n - 1, 0).bit_length() if block == 0 and n < 1 << bits else bits


def path(tree: list[list[str]], i: int) -> tuple[str, str]:
    """Sides and siblings from node ``i`` up to the last level, which is left out."""
    sides, siblings = "", ""
    for level in tree[:-1]:
        other = i ^ 1
        if other < len(level):
            sides += LEFT if other < i else RIGHT
            siblings += level[other]
        else:
            sides += ALONE
        i >>= 1
    return sides, siblings


def fold(node: str, sides: str, siblings: str) -> str:
    """The root that a node and the siblings on its path give."""
    at = 0
    for side in sides:
        if side == ALONE:
            node = digest(node)
            continue
        other = siblings[at:at + 64]
        at += 64
        node = digest(other + node if side == LEFT else node + other)
    return node


def _block(bits: int) -> Column:
    return F.shiftright("idx", bits).alias("block")


def _reduce(bits: int):
    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        nodes = rows.sort_values("idx")["node"].tolist()
        top = levels(nodes, inner_height(int(key[1]), len(nodes), bits))[-1][0]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "node": [top]})
    return reduce


def _lengthen(bits: int):
    """Cogrouped: nodes of a superblock and the path of its own node -> their paths."""
    def lengthen(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, up = rows.sort_values("idx"), outer.iloc[0]
        nodes = rows["node"].tolist()
        tree = levels(nodes, inner_height(int(key[1]), len(nodes), bits))
        own = [path(tree, i) for i in range(len(nodes))]
        return pd.DataFrame({"tree": key[0], "idx": rows["idx"].to_numpy(), "sides": [s + up["sides"] for s, _ in own],
                             "siblings": [x + up["siblings"] for _, x in own], "top": up["top"]})
    return lengthen


def _finish(bits: int):
    """Cogrouped: leaves of a superblock and the path of its node to the root ->
    proofs and folded roots of the leaves."""
    def finish(key: tuple, rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows, up = rows.sort_values("idx"), outer.iloc[0]
        nodes = rows["node"].tolist()
        tree = levels(nodes, inner_height(int(key[1]), len(nodes), bits))
        own = [path(tree, i) for i in range(len(nodes))]
        full = [(s + up["sides"], x + up["siblings"]) for s, x in own]
        folded = [fold(c, s, x) for c, (s, x) in zip(rows["claim"], full)]
        return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "tree": key[0], "position": rows["idx"].to_numpy(), "leaf": nodes,
                             "subroot": up["subroot"], "root": up["top"], "sides": [s for s, _ in full],
                             "proof_sha256": [digest(x) for _, x in full], "folded_root": folded,
                             "verified": [r == up["top"] for r in folded]})
    return finish


# ------------------------------------------------------------------ the tree above

def outer_paths(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, idx, sides, siblings, top) of every superblock of ``nodes`` (tree,
    idx, node): the way from its node to the top of its tree.  One level of this
    recursion divides the rows by 2^bits."""
    blocks = cut_lineage(nodes.select("tree", "idx", "node", _block(bits)).groupBy("tree", "block").applyInPandas(
        _reduce(bits), "tree string, idx long, node string"))
    if blocks.where("idx > 0").isEmpty():
        return blocks.select("tree", "idx", F.lit("").alias("sides"), F.lit("").alias("siblings"), F.col("node").alias("top"))
    return lengthened(blocks, outer_paths(blocks, bits), bits)


def lengthened(nodes: DataFrame, outer: DataFrame, bits: int) -> DataFrame:
    """The paths of ``nodes`` from those of their superblocks."""
    left = nodes.select("tree", "idx", "node", _block(bits)).groupBy("tree", "block")
    right = outer.withColumnRenamed("idx", "block").groupBy("tree", "block")
    return cut_lineage(left.cogroup(right).applyInPandas(
        _lengthen(bits), "tree string, idx long, sides string, siblings string, top string"))


def manifest(docs: DataFrame, claim: Column | None = None, bits: int = BITS) -> DataFrame:
    """(doc_id, lang, position, leaf, subroot, root, sides, proof_sha256,
    folded_root, verified) of every row.  ``claim``: the digest that is held
    against the manifest, the row's own leaf if not given."""
    spark = docs.sparkSession
    ship_package(spark)
    id_type = docs.schema["doc_id"].dataType
    leaves = docs.select("doc_id", F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang")).alias("tree"),
                         leaf_hash().alias("node"), (leaf_hash() if claim is None else claim).alias("claim"))
    leaves = (sequence_within(leaves, ["tree"], ["doc_id", "node"], seq_col="seq")
              .select(F.col("doc_id").cast("string").alias("doc_id"), "tree", (F.col("seq") - 1).alias("idx"), "node", "claim"))
    blocks = outer_paths(leaves, bits)
    # the tree over the languages: its leaves are the subroots, in the order of their names
    subroots = sequence_within(blocks.where("idx = 0").select("tree", F.col("top").alias("node")), [], ["tree"], seq_col="seq") \
        .select(F.lit("").alias("tree"), (F.col("seq") - 1).alias("idx"), "node", F.col("tree").alias("lang"))
    upper = lengthened(subroots, outer_paths(subroots, bits), bits)
    up = subroots.join(upper.drop("tree"), "idx").select(
        F.col("lang").alias("tree"), F.col("sides").alias("up"), F.col("siblings").alias("above"), F.col("top").alias("root"))
    ways = blocks.join(up, "tree").select(
        "tree", F.col("idx").alias("block"), F.concat("sides", "up").alias("sides"), F.concat("siblings", "above").alias("siblings"),
        F.col("top").alias("subroot"), F.col("root").alias("top"))
    done = leaves.select("*", _block(bits)).groupBy("tree", "block").cogroup(ways.groupBy("tree", "block")).applyInPandas(
        _finish(bits), "doc_id string, tree string, position long, leaf string, subroot string, root string, sides string, "
                       "proof_sha256 string, folded_root string, verified boolean")
    return done.select(F.col("doc_id").cast(id_type).alias("doc_id"), F.expr("if(tree = '', null, substr(tree, 2))").alias("lang"),
                       "position", "leaf", "subroot", "root", "sides", "proof_sha256", "folded_root", "verified")


def tampered(every: int = 7) -> Column:
    """The leaf with n_chars + 1 where ``every`` divides crc32 of the decimal
    id, else the leaf; rows without an id or without n_chars keep theirs."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    return leaf_hash(n_chars=F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(21,0)")))
