"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The parts of a pre-token form a linked list. Every adjacent pair that the vocabulary can merge waits in the bucket of its rank, ordered by position.
A two-level bitmap of 512-bit words holds which ranks have entries; find-first-set on each level picks the least rank in constant time. Entries whose pair has changed meanwhile
are stale and skipped. A pre-token of n bytes has at most 3n entries, so very long ones cost O(n log n) for the order inside buckets.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import small_batches

#: Pre-tokens up to this length are remembered, this many at a time; the memory only saves repeated work.
MEMO_LENGTH, MEMO_SIZE = 48, 1_000_000
#: The library's own meaning of \s: the Unicode property White_Space, without the separators U+001C to U+001F.
WHITE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


_BYTES = [bytes([i]) for i in range(256)]


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: merges by least rank, then leftmost."""
    get = ranks.get
    whole = get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    parts = [_BYTES[b] for b in word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [get(word[i : i + 2]) for i in range(n - 1)]  # the rank that waits for each position, to tell stale entries
    pair.append(None)
    buckets: dict[int, list[int]] = {}  # heaps of positions
    top, low = 0, {}  # the bitmap's levels, of 512 bits a word
    for i, rank in enumerate(pair):
        if rank is not None:
            if rank in buckets:
                buckets[rank].append(i)  # rising positions are a heap
            else:
                buckets[rank] = [i]
                a = rank >> 9
                low[a] = low.get(a, 0) | 1 << (rank & 511)
                top |= 1 << a
    while top:
        a = (top & -top).bit_length() - 1
        w = low[a]
        rank = a << 9 | (w & -w).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            w &= w - 1
            low[a] = w
            if not w:
                top &= top - 1
        if pair[i] != rank:
            continue
        j = after[i]
        joined = parts[i] = parts[i] + parts[j]
        pair[j] = parts[j] = None
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            right = pair[i] = get(joined + parts[k])
        else:
            right = pair[i] = None
        if h >= 0:
            left = pair[h] = get(parts[h] + joined)
        else:
            left = None
        while right is not None or left is not None:
            if right is not None:
                rank, at, right = right, i, None
            else:
                rank, at, left = left, h, None
            if rank in buckets:
                heappush(buckets[rank], at)
            else:
                buckets[rank] = [at]
                a = rank >> 9
                low[a] = low.get(a, 0) | 1 << (rank & 511)
                top |= 1 << a
    return [ranks[p] for p in parts if p is not None]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Memo(dict):
    """The ids of pre-tokens, joined by commas; filled on demand, in two generations, so that common ones stay when it is full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.older = ranks, {}

    def __missing__(self, token: str) -> str:
        found = self.older.get(token)
        if found is None:
            found = ",".join(map(str, merge(token.encode(), self.ranks)))
            if len(token) > MEMO_LENGTH:
                return found
        if len(self) >= MEMO_SIZE // 2:
            self.older = dict(self)
            self.clear()
        self[token] = found
        return found


class Coder:
    """Encodes texts to decimal ids and decodes them; not safe for threads."""

    def __init__(self, path: str, pattern: str) -> None:
        self.ranks = read_ranks(path)
        if max(self.ranks.values(), default=0) >= 1 << 18:
            raise ValueError("ranks must be below 262144")
        self.pieces = {str(i): b for b, i in self.ranks.items()}
        # the classes first, for \S stands inside and outside of brackets
        exact = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.split = regex.compile(exact).findall
        self.ids = Memo(self.ranks).__getitem__

    def encode(self, text: str) -> str:
        """The ids of a text, joined by commas."""
        return ",".join(map(self.ids, self.split(text)))

    def decode(self, ids: str) -> bytes:
        """The bytes of ids that are joined by commas."""
        return b"".join(map(self.pieces.__getitem__, ids.split(","))) if ids else b""


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """One coder for each Python worker."""
    return Coder(path, pattern)


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes decoded from these ids).

    Each match of pattern is encoded separately, without special tokens. Null text counts as empty: no ids, both digests of nothing. Very long texts and pre-tokens are
    encoded whole. with_ids adds ids, an array of the token ids. Repeated rows each give a row. path: a rank file that every executor can open.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        code = coder(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                encoded = [code.encode(t or "") for t in b.column(1).slice(at, 256).to_pylist()]
                columns = [b.column(0).slice(at, 256), pa.array([e.count(",") + 1 if e else 0 for e in encoded], pa.int64()), pa.array([sha(e.encode()) for e in encoded]), pa.array([sha(code.decode(e)) for e in encoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([[int(i) for i in e.split(",")] if e else [] for e in encoded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    ids = ", ids array<int>" if with_ids else ""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")
