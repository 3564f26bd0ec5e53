"""From banded signatures to classes of near-duplicates.

Items are distinct contents with a ``key`` (96 bits of an MD5) and ``bands``
(64-bit bucket numbers).  Items that share a bucket are candidates, verified on
their whole contents; classes are the connected components of the links.

* Buckets that hold one item never matter.  A first count leaves a fixed-size
  bitmap of the crowded buckets (``BITS`` bits, whatever the input; a full one
  only filters less), so that just their members are shuffled on.
* No bucket is expanded into pairs.  First every member of a bucket is compared
  with one of them, the *hub*, which puts near copies into one component.  Where
  the other members still lie in several components, those outside the bucket's
  largest one (the minor ones) are compared with all members of other components,
  in tasks of about ``SMALL`` by ``SMALL`` members.  So no link between components
  is lost, a task's memory has a bound, and a member makes a row for every
  ``SMALL`` it may meet.
* Joins on keys that may be hot (bucket, hub, component) stand between two
  plain exchanges, which adaptive execution can split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import map_arrow
from churnlens.session import cut_lineage, ship_package

SHINGLE, SIMILARITY, BITS, SMALL, FLUSH = 5, 0.8, 23, 256, 400_000
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15  # fixed: splitmix64


def tune(similarity: float, recall: float, rows: range = range(2, 9)) -> tuple[int, int]:
    """(bands, rows): the fewest hash values for which two items of exactly
    ``similarity`` share a band with probability ``recall``; of these the most
    rows, which bring the fewest other candidates."""
    options = []
    for r in rows:
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** r)))
        options.append((bands * max(1.0, r / 4), -r, bands))
    _, r, bands = min(options)
    return bands, -r


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def seed(i: int) -> np.uint64:
    return np.uint64((i + 1) * _STEP & (1 << 64) - 1)


def key_of(words: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(words), usedforsecurity=False).digest()[:12]


def shingles(words: list[bytes]) -> np.ndarray:
    """Hashes of the windows of five words; a shorter item is one window."""
    n = len(words)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = out * _M1 + w[j:n - k + 1 + j]
    return mixed(out)


def shingles_of(items: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The ``shingles`` of several items, one after the other, and where each item's begin."""
    sizes = np.fromiter(map(len, items), np.int64, len(items))
    n = np.maximum(sizes - SHINGLE, 0) + 1
    at = np.cumsum(n) - n
    if sizes.min() < SHINGLE:
        return np.concatenate([shingles(w) for w in items]), at
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(items)), np.uint64, sizes.sum())
    out = np.full(len(w) - SHINGLE + 1, SHINGLE, np.uint64)
    for j in range(SHINGLE):
        out = out * _M1 + w[j:len(out) + j]
    first = np.repeat(np.cumsum(sizes) - sizes - at, n)  # windows over two items are left out
    return mixed(out[first + np.arange(len(first))]), at


def banded(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket numbers (items x bands, int64) of signatures (items x bands*rows)."""
    z = registers.reshape(len(registers), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M2, z.shape[:2])
    for j in range(rows):
        out = mixed(out ^ z[:, :, j]) + seed(j)
    return out.view(np.int64)


def jaccard(a: list[bytes], b: list[bytes]) -> float:
    """Of the sets of five-word windows, exactly."""
    def cut(w: list[bytes]) -> set:
        return {tuple(w)} if len(w) < SHINGLE else set(zip(*[w[j:] for j in range(SHINGLE)], strict=False))
    x, y = cut(a), cut(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


# ------------------------------------------------------------- bitmaps of a fixed size

def bitmap(df: DataFrame, col: str) -> np.ndarray:
    """2^BITS bits; those of the column's hashes are set.  1 MB on the driver."""
    x = F.pmod(F.xxhash64(col), F.lit(1 << BITS))
    rows = (df.select(x.alias("x")).groupBy(F.shiftright("x", 15).alias("page"))
            .agg(F.bitmap_construct_agg(F.col("x").bitwiseAND(F.lit(32767))).alias("bits")).collect())
    out = np.zeros((1 << BITS - 15, 4096), np.uint8)
    for r in rows:
        out[r["page"]] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.reshape(-1)


def _bit(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x & np.uint64((1 << BITS) - 1)
    return bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) & 1 == 1


def has_key(bits: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Spark's xxhash64 of a binary is XXH64 with seed 42."""
    return _bit(bits, np.fromiter((xxhash.xxh64_intdigest(k, 42) for k in keys), np.uint64, len(keys)))


def has_long(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same for a long: XXH64 of its 8 bytes with seed 42."""
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    p4, p5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)  # fixed: XXH64's primes

    def turn(v, k):
        return v << np.uint64(k) | v >> np.uint64(64 - k)
    h = np.uint64(42) + p5 + np.uint64(8)
    h = turn(h ^ turn(x.view(np.uint64) * p2, 31) * p1, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return _bit(bits, h ^ h >> np.uint64(32))


# ------------------------------------------------------------- candidates, links, components

MEMBERS = pa.schema([("bucket", pa.int64()), ("key", pa.binary())])
LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _crowded(items: DataFrame) -> DataFrame:
    """(bucket, key) of the buckets with more than one item, and a few others."""
    many = items.select(F.explode("bands").alias("bucket")).groupBy("bucket").count().where("count > 1")
    bits = bitmap(many, "bucket")

    def run(b: pa.RecordBatch):
        bands = b.column("bands")
        flat, per = bands.flatten().to_numpy(), np.diff(bands.offsets.to_numpy())
        hit = has_long(bits, flat)
        keys = b.column("key").take(pa.array(np.repeat(np.arange(b.num_rows), per)[hit]))
        return {"bucket": flat[hit], "key": keys}
    return map_arrow(items.select("key", "bands"), run, MEMBERS)


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def run(b: pa.RecordBatch):
        out = {"a": [], "b": []}
        for a, c, x, y in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            x, y = x.split(), y.split()
            if jaccard(x, y) >= similarity:
                out["a"].append(a)
                out["b"].append(c)
        return out
    left = texts.select(F.col("key").alias("a"), F.col("body").alias("x"))
    right = texts.select(F.col("key").alias("b"), F.col("body").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut_lineage(map_arrow(both, run, LINKS))


def _contracted(links: DataFrame) -> DataFrame:
    """``links`` with the same components and, a task, at most one link an item:
    each to the least one it is known to be linked with.  A task's memory holds
    ``FLUSH`` items at most."""
    def run(batches):
        root: dict[bytes, bytes] = {}

        def find(x):
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        def out():
            rows = [(x, r) for x in list(root) if (r := find(x)) != x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.binary()), pa.array([r for _, r in rows], pa.binary())], schema=LINKS)
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            if len(root) >= FLUSH:
                yield from out()
                root.clear()
        yield from out()
    ship_package(links.sparkSession)
    return links.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(key, comp) for every key in ``links`` (a, b): the component's least key.
    Tasks first contract their own links.  Each round then takes the least label
    among the neighbours, and the label's own label, so that long chains halve;
    it ends when no label changes."""
    own = _contracted(links)
    both = cut_lineage(own.union(own.select("b", "a")).distinct())
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("comp"))
    while True:
        far = label.select(F.col("key").alias("b"), F.col("comp").alias("near"))
        near = both.join(far, "b").groupBy(F.col("a").alias("key")).agg(F.min("near").alias("near"))
        step = label.join(near, "key").select("key", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        up = label.select(F.col("key").alias("mid"), F.col("comp").alias("up"))
        new = cut_lineage(step.join(up, "mid").select("key", "old", F.least("mid", "up").alias("comp")))
        done = new.where(F.col("old") != F.col("comp")).isEmpty()
        label = new.select("key", "comp")
        if done:
            return label


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after linking components by ``links`` (a, b: labels, or items that
    were alone)."""
    top = components(links)
    new = top.select(F.col("key").alias("comp"), F.col("comp").alias("now"))
    moved = comp.join(new, "comp", "left").select("key", F.coalesce("now", "comp").alias("comp"))
    return cut_lineage(moved.union(top.join(comp.select("key"), "key", "left_anti")))


def _compared(rest: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between the components inside buckets (bucket, key, comp, major, n,
    minor): a block of minor members meets a block of all members in a task, and
    every pair is compared unless its components have met meanwhile."""
    def run(table: pa.Table) -> pa.Table:
        keys, comps, kinds = (table.column(c).to_pylist() for c in ("key", "comp", "kind"))
        texts = [t.split() for t in table.column("body").to_pylist()]
        sets = [np.unique(shingles(t)) for t in texts]
        root = {c: c for c in comps}

        def find(c):
            while root[c] != c:
                c = root[c]
            return c

        def alike(i, j):
            x, y = sets[i], sets[j]
            if min(len(x), len(y)) < similarity * max(len(x), len(y)) - 1e-9:
                return False
            both = len(np.intersect1d(x, y, assume_unique=True))
            return both >= similarity * (len(x) + len(y) - both) - 1e-9 and jaccard(texts[i], texts[j]) >= similarity
        out = {"a": [], "b": []}
        right = [j for j, k in enumerate(kinds) if k > 0]
        for i in (i for i, k in enumerate(kinds) if k == 0):
            for j in right:
                if kinds[j] == 1 and keys[i] >= keys[j]:
                    continue  # two minor members meet twice
                x, y = find(comps[i]), find(comps[j])
                if x != y and alike(i, j):
                    root[x] = y
                    out["a"].append(comps[i])
                    out["b"].append(comps[j])
        return pa.table(out, schema=LINKS)
    minor, every = (F.ceil(F.col(c) / SMALL).cast("int") for c in ("minor", "n"))
    own = F.col("comp") != F.col("major")
    here = ["bucket", "key", "comp"]
    left = rest.where(own).select(*here, F.lit(0).alias("kind"), F.pmod(F.xxhash64("key"), minor).cast("int").alias("i"),
                                  F.explode(F.sequence(F.lit(0), every - 1)).alias("j"))
    right = rest.select(*here, F.when(own, 1).otherwise(2).alias("kind"), F.explode(F.sequence(F.lit(0), minor - 1)).alias("i"),
                        F.pmod(F.xxhash64("key", F.lit(1)), every).cast("int").alias("j"))
    full = left.union(right).join(texts, "key")
    return full.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def classes(items: DataFrame, fetch: Callable[[np.ndarray], DataFrame], similarity: float = SIMILARITY) -> DataFrame:
    """(key, comp) for the items with a near-duplicate.

    ``items``: distinct (key, bands), materialised.  ``fetch(bits)``: (key,
    body) of the items whose key is in the bitmap, and maybe others; the body is
    the words joined by blanks."""
    members = _crowded(items)
    hubs = cut_lineage(members.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n"))
                       .where("n > 1").select("bucket", "hub"))
    members = cut_lineage(members.join(hubs, "bucket"))
    bits = bitmap(members, "key")
    texts = cut_lineage(fetch(bits).groupBy("key").agg(F.first("body").alias("body")))
    pairs = members.where(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    comp = components(_verified(pairs, texts, similarity))
    rest = members.where(F.col("key") != F.col("hub")).select("bucket", "key")
    rest = cut_lineage(rest.join(comp, "key", "left").select("bucket", "key", F.coalesce("comp", "key").alias("comp")))
    # the hubs have been compared with all; what else may link two components?
    parts = rest.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n"))
    open_ = (parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"))
             .where("comps > 1").select("bucket", F.col("m.comp").alias("major"), "n", (F.col("n") - F.col("m.n")).alias("minor")))
    rest = cut_lineage(rest.join(open_, "bucket"))
    return merged(comp, cut_lineage(_compared(rest, texts, similarity)))
