"""Near duplicates by SimHash fingerprints, found with the binary Golay code.

A fingerprint has 64 bits. Of two fingerprints that differ in at most two bits, cut into three segments, one segment is equal in
both, and the segment after it (cyclically) can be chosen so that it differs in at most one bit: with errors (2, 0, 0) the two clean
segments follow one another, with (1, 1, 0) each other segment has one error. Three families of keys therefore reach every
link: the exact bits of segment i with a Golay index of segment i + 1.

The (23, 12) Golay code is perfect: each 23-bit word lies within three bits of exactly one codeword. A word that is at most two bits off
its codeword shares that codeword with all its neighbours at distance one; a word that is three bits off has five more codewords at
distance four, and takes their indices too. So a segment gives one or six 12-bit indices, and two segments at distance one share one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .components import connected_components
from .shared import cut, drop_cut, values

#: The generator polynomial of the Golay code, and the segments of a fingerprint as (shift, bits).
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Buckets of up to so many fingerprints are joined and verified pair by pair; larger ones are linked by shared one-bit variants.
BUCKET = 128
_BITS = np.array([1 << b for b in range(64)], dtype=np.uint64)


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles: a bit is 1 if it is set in over half of the shingles' XXH64; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(width, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    tails = ends[k - 1 :]
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), 65536):
        h = np.array([digest(joined[s:e], seed) for s, e in zip(starts[i : i + 65536], tails[i : i + 65536])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * counts > len(starts)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null text counts as empty."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t or b"") for t in values(b.column(1).cast(pa.binary()))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of at most three bits, whether it has three, and the five errors of four bits with that syndrome."""
    syndrome = _syndrome
    leader, far, fill = np.zeros(2048, np.int64), np.zeros((2048, 5), np.int64), np.zeros(2048, np.int64)
    weight = np.zeros(2048, np.int64)
    for n in range(1, 5):
        errors = np.array([sum(1 << b for b in c) for c in combinations(range(23), n)], dtype=np.int64)
        for e, s in zip(errors.tolist(), syndrome(errors).tolist()):
            if n < 4:
                leader[s], weight[s] = e, n
            else:
                far[s, fill[s]] = e
                fill[s] += 1
    return leader, weight == 3, far


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    out = words.copy()
    for b in range(22, 10, -1):
        out ^= np.where(out >> b & 1, GENERATOR << (b - 11), 0)
    return out


def golay_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, index): the 12-bit indices of the codewords near each 23-bit word, one or six a word."""
    leader, three, far = _tables()
    s = _syndrome(words)
    near = (words ^ leader[s]) >> 11
    more = np.flatnonzero(three[s])
    wide = (words[more, None] ^ far[s[more]]) >> 11
    return np.concatenate([np.arange(len(words)), np.repeat(more, 5)]), np.concatenate([near, wide.ravel()])


def fingerprint_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the keys of each fingerprint (uint64), such that two at distance two or less share one."""
    segments = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    for i in range(3):
        row, index = golay_indices(segments[(i + 1) % 3])
        rows.append(row)
        keys.append((i << 34) | (segments[i][row] << 12) | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            row, key = fingerprint_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0).take(pa.array(row)), b.column(1).take(pa.array(row))], ["key", "node", "fp"])

    return fps.select("node", "fp").mapInArrow(run, "key long, node long, fp long")


def fingerprint_links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect all fingerprints at two or fewer differing bits. fps: distinct fp with a node id each.

    Buckets of up to `bucket` fingerprints give every verified pair. In a larger bucket all members take their 65 variants
    within one bit instead: two members share a variant exactly if they differ in at most two bits, and a variant has
    at most 65 members, so a hot bucket costs a linear number of rows and loses no link.
    """
    keyed = cut(_keyed(fps))
    sizes = cut(keyed.groupBy("key").count().filter("count > 1"))
    small = cut(keyed.join(sizes.filter(F.col("count") <= bucket), "key").select("key", "node", "fp"))
    a, b = (small.select("key", F.col("node").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
    close = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2)).select("a", "b")
    hot = keyed.join(sizes.filter(F.col("count") > bucket), "key").select("node", "fp").distinct()
    flips = F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")) for k in range(64))))
    met = hot.select("node", flips.alias("variant")).groupBy("variant").agg(F.min("node").alias("a"), F.collect_list("node").alias("all")).filter(F.size("all") > 1)
    links = cut(close.union(met.select("a", F.explode("all").alias("b")).filter("a < b")))
    for x in (keyed, sizes, small):
        drop_cut(x)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; shingles have three words, fewer words give one shingle, none the fingerprint zero,
    which links like any other. Null text counts as empty. Repeated rows each give a row. Rows with a null id take no part in linking and have a
    null component. Other columns of docs are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    nodes = cut(prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    links = fingerprint_links(nodes, bucket)
    roots = connected_components(links)
    drop_cut(links)
    classes = cut(nodes.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("fp", F.coalesce("root", "node").alias("component_id")))
    drop_cut(roots)
    drop_cut(nodes)
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )
