"""Best-two-fit packing of tokenised documents into fixed-length sequences.

1. Tokenise (``mapInArrow``) and keep a row per piece: id, start, length and a
   checksum, never the ids.  The rows are checkpointed: tokenising is the dear
   step and happens once.
2. Packing depends on lengths only, so the plan is made on the histogram of
   lengths (at most ``capacity`` numbers reach the driver).  A *pattern* is a
   multiset of lengths that fills a bin: take the longest length left, then
   always the longest that fits (greedy best fit); then replace the smallest
   member with the two unpacked lengths that fit the gap which its removal
   leaves more tightly.  A pattern is used as often as the counts allow, so
   each use drains at least one length and the plan has a bounded size.
3. Pieces of one length are interchangeable.  They are numbered within their
   length by the range sequencer (a length that a third of the pieces share is
   split) and the number picks the bin and the place in it.
"""

from __future__ import annotations

import json
from collections import Counter
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import map_arrow, text_bytes
from churnlens.operators.ordered import sequence_within
from churnlens.session import cut_lineage

CAPACITY, END_ID = 1024, 2
PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64())])


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """Text -> ids of the byte-level BPE in the JSON file ``path``.

    The file's vocabulary is read as merge ranks, whose encoder is several
    times faster than the file's own and gives the same ids; if it refuses a
    text, the file's own encoder is asked.  Special strings are plain text."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True

    def ids(text: str) -> list[int]:
        try:
            return fast.encode_ordinary(text)
        except Exception:  # the encoder's own limits
            return own.encode(text, add_special_tokens=False).ids
    return ids


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece of every row of ``docs`` (null text: only the end id)."""
    def run(b: pa.RecordBatch):
        encode = tokenizer(path or default_path())
        out = {f.name: [] for f in PIECES}
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids = np.array([*encode(text.decode("utf-8", "replace")), end_id], dtype="<u4")
            for k, (s, n) in enumerate(cut(len(ids), capacity)):
                for name, v in zip(out, (doc, k, s, n, crc32(ids[s:s + n].tobytes())), strict=True):
                    out[name].append(v)
        return out
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, uses), ...])]: patterns that use every length up."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        left[n] = c
    out = []
    while left.any():
        members: Counter[int] = Counter()
        gap = capacity
        while gap and (fit := np.flatnonzero(left[:gap + 1])).size:
            z = int(fit[-1])
            uses = min(gap // z, int(left[z]))
            members[z] += uses
            left[z] -= uses
            gap -= uses * z
        if gap and len(members) and sum(members.values()) > 1:
            small = min(members)
            if two := _two(left, small, gap + small):
                members[small] -= 1
                left[small] += 1
                for z in two:
                    members[z] += 1
                    left[z] -= 1
        members = +members
        for z, u in members.items():
            left[z] += u
        times = int(min(left[z] // u for z, u in members.items()))
        for z, u in members.items():
            left[z] -= u * times
        out.append((times, sorted(members.items(), reverse=True)))
    return out


def _two(left: np.ndarray, above: int, room: int) -> tuple[int, int] | None:
    """The two unpacked lengths with the largest sum in (above, room]."""
    best, pair = above, None
    sizes = np.flatnonzero(left[:room])
    for a in sizes[::-1]:
        if 2 * a <= best:
            break
        b = sizes[sizes <= min(room - a, a)]
        b = b[(b != a) | (left[a] > 1)]
        if b.size and a + b[-1] > best:
            best, pair = int(a + b[-1]), (int(a), int(b[-1]))
            if best == room:
                break
    return pair


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to piece rows (``doc_id``, ``piece``,
    ``length`` in 1..capacity).  ``items`` must be materialised (read twice).

    Lengths above ``capacity`` or below 1 are an error.  Rows that repeat are
    packed as often as they occur; an empty input gives no rows."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 1 <= z <= capacity for z in counts):
        raise ValueError("a piece is longer than a sequence or empty")
    segments: dict[int, list[tuple[int, int, int, int]]] = {}  # length -> (first number, first bin, uses, place)
    used: Counter[int] = Counter()
    first_bin = 0
    for times, members in plan(counts, capacity):
        place = 0
        for z, u in members:
            segments.setdefault(z, []).append((used[z], first_bin, u, place))
            used[z] += u * times
            place += u * z
        first_bin += times
    table = {z: np.array(s, dtype=np.int64) for z, s in segments.items()}
    numbered = sequence_within(items, ["length"], ["ids_crc32", F.col("doc_id").asc(), "start"], seq_col="_k")
    out = pa.schema([*[f for f in PIECES], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(b: pa.RecordBatch):
        z, k = b.column("length").to_numpy(), b.column("_k").to_numpy() - 1
        seq, off = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
        for n in np.unique(z):
            own, t = z == n, table[n]
            s = t[np.searchsorted(t[:, 0], k[own], side="right") - 1]
            q = k[own] - s[:, 0]
            seq[own], off[own] = s[:, 1] + q // s[:, 2], s[:, 3] + q % s[:, 2] * n
        return {f.name: b.column(f.name) for f in PIECES} | {"sequence_id": seq, "offset": off}

    return map_arrow(numbered, place, out)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack every row of ``docs`` (columns used: doc_id, text).

    Null and empty texts are one end id; a null ``doc_id`` stays null; repeated
    rows are packed again; other columns are not read; no rows give no rows."""
    return pack(cut_lineage(pieces(docs, path, capacity)), capacity)
