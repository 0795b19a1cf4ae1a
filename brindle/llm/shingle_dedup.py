"""Near copies by the Jaccard similarity of five-word shingles, at least 0.8: the Golay-keyed fingerprints of operator 2, and the links that these cannot reach.

At similarity 0.8 the SimHash of the shingles differs in 10 of 64 bits on average (0.15 a bit), so that Golay keys, or any keys over segments of the fingerprint, would have to number thousands
a document to find such pairs. Fingerprints at two or fewer bits therefore give only the closest candidates. All others come from 32 keys of five minima over the shingles' hashes each:
a pair at 0.8 shares two or more but with probability 5e-5, a more similar one with more certainty. Every candidate is verified with the whole sets of shingles, so no link is below the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .components import connected_components
from .golay_dedup import fingerprint_links
from .shared import cut, drop_cut, values, with_row_key, without

#: Words of a shingle, the limit as a fraction, the keys of a document with the minima of each, and the keys that candidates share.
WIDTH = 5
LIMIT = (4, 5)
BANDS, ROWS, SHARED = 32, 5, 2
#: Buckets of up to so many sets are compared pair by pair; larger ones by prefix filtering.
BUCKET = 8
#: So many words keep their hash in a worker, which saves repeated work and changes no result.
REMEMBERED = 50_000
_RNG = np.random.default_rng(42)
_FACTORS, _TERMS = (_RNG.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.array([1 << b for b in range(64)], dtype=np.uint64)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = code
        return code


_codes = _Codes()


def _mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _PRIME
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; fewer words than five give one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes, k = np.fromiter(map(_codes.__getitem__, words), np.uint64, len(words)), min(WIDTH, len(words))
    n = len(words) - k + 1
    h = np.full(n, k, dtype=np.uint64)
    for j in range(k):
        h = _mixed(h, codes[j : j + n])
    return np.unique(h)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The keys of a set of shingles; none for an empty one."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 1024):
        np.minimum(least, (found[i : i + 1024, None] * _FACTORS + _TERMS).min(axis=0), out=least)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for x in least.reshape(BANDS, ROWS).T:
        h = _mixed(h, x)
    return h.view(np.int64)


def set_fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingles as a signed long: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(found), 8192):
        counts += np.unpackbits(found[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * counts > len(found)].sum(dtype=np.uint64).view(np.int64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles reach the limit; two empty ones do."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common * LIMIT[1] >= (len(a) + len(b) - common) * LIMIT[0]


def _prints(rows: DataFrame) -> DataFrame:
    """rows (id, file, row, text) with the digest of the set of shingles, its size, fingerprint and keys in place of the text. Null text counts as empty."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                digests, sizes, fps, keys = [], [], [], []
                for t in values(part.column(3).cast(pa.binary())):
                    found = shingles(t or b"")
                    digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sizes.append(len(found))
                    fps.append(set_fingerprint(found))
                    keys.append(band_keys(found))
                new = [pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *new], ["id", "file", "row", "digest", "n", "fp", "keys"])

    return rows.mapInArrow(run, "id long, file long, row long, digest binary, n long, fp long, keys array<long>")


def _enough():
    """Whether the numbers of shingles allow the limit."""
    return (F.least("n_a", "n_b") * LIMIT[1] >= F.greatest("n_a", "n_b") * LIMIT[0]) & (F.col("a") != F.col("b"))


def _sides(df: DataFrame, x: str, *more: str) -> DataFrame:
    return df.select("key", F.col("node").alias(x), F.col("n").alias(f"n_{x}"), *(F.col(c).alias(f"{c}_{x}") for c in more))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _views(column: pa.Array):
    """The arrays of unsigned longs in a binary column, one at a time."""
    for x in column:
        yield np.frombuffer(x.as_buffer(), np.uint64) if x.as_buffer() is not None else np.empty(0, np.uint64)


def _sets(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, found): the sets of shingles of wanted (node, file, row), from texts (file, row, text)."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t or b"").tobytes() for t in values(part.column(1).cast(pa.binary()))], pa.binary())], ["node", "found"])

    return cut(texts.join(wanted, ["file", "row"]).select("node", "text").mapInArrow(run, "node long, found binary"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the limit."""

    def run(batches):
        for b in batches:
            same = [similar(x, y) for x, y in zip(_views(b.column(2)), _views(b.column(3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    a, b = (sets.select(F.col("node").alias(x), F.col("found").alias(f"found_{x}")) for x in "ab")
    return cut(_ordered(pairs).distinct().join(a, "a").join(b, "b").select("a", "b", "found_a", "found_b").mapInArrow(run, "a long, b long"))


def _rooted(frame: DataFrame, links: DataFrame) -> DataFrame:
    """frame with root, the component of its node over links."""
    roots = connected_components(links)
    out = cut(frame.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node")))
    drop_cut(roots)
    return out


def _apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes lie in different components over links."""
    roots = connected_components(links)
    of = lambda x: roots.select(F.col("a").alias(x), F.col("b").alias(f"root_{x}"))
    joined = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    out = cut(joined.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    drop_cut(roots)
    return out


def shingle_links(keyed: DataFrame, close: DataFrame, nodes: DataFrame, texts: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): verified links that connect what the candidates connect: the pairs of close, and nodes that share SHARED keys of keyed (key, node, n), or a key of more than `bucket` nodes.

    First each node is compared with the smallest of its nodes in close and with a leader of its buckets: a bucket's leader is the node that meets most others in all of its own buckets, such as the text
    that copies were made from. That connects most copies by one pair each; from then on only nodes of different components meet. Buckets of up to `bucket` nodes give every such pair. Of larger ones, the nodes
    outside the commonest component are compared with the nodes that share a shingle of their prefixes, which finds every similar pair (_prefixes). So a hot bucket of copies costs linear rows, one of
    texts that only share a passage falls apart by their own words, and a link is only left out between nodes that others connect.
    """
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("count")).filter("count > 1"))
    met_ = cut(keyed.join(sizes, "key").select("key", "node", "n", "count"))
    degree = cut(met_.groupBy("node").agg(F.sum("count").alias("degree")))
    leader = met_.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("m"), "n")).alias("first"))
    shared = cut(met_.join(cut(leader), "key").select("key", "node", "n", "count", (-F.col("first.m")).alias("first"), F.col("first.n").alias("n_first"), F.col("first.degree").alias("degree")))
    for x in (sizes, met_, degree):
        drop_cut(x)
    wanted = shared.select("node").union(close.select(F.explode(F.array("a", "b")))).distinct()
    sets = _sets(cut(nodes.select("node", "file", "row").join(wanted, "node")), texts)
    leads = shared.select("node", F.col("first").alias("a"), F.col("node").alias("b"), F.col("n_first").alias("n_a"), F.col("n").alias("n_b"), "degree").filter(_enough())
    nearest = close.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("b"))
    links = _verified(leads.groupBy("node").agg(F.max(F.struct("degree", (-F.col("a")).alias("m"))).alias("best")).select("node", (-F.col("best.m")).alias("b")).union(nearest).select(F.col("node").alias("a"), "b"), sets)
    far_close = _apart(close, links)
    # buckets that hold several components
    rooted = _rooted(shared, links)
    mixed = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    open_ = cut(rooted.join(mixed, "key"))
    drop_cut(shared)
    drop_cut(rooted)
    small, hot = open_.filter(F.col("count") <= bucket), open_.filter(F.col("count") > bucket)
    apart = F.col("root_a") != F.col("root_b")
    met = _sides(small, "a", "root").join(_sides(small, "b", "root"), "key").filter((F.col("a") < F.col("b")) & apart & _enough())
    # a pair that shares a hot key as well is judged there
    twice = met.groupBy("a", "b").count().filter(F.col("count") >= SHARED).select("a", "b")
    more = _verified(twice.union(far_close), sets)
    links = cut(links.union(more))
    drop_cut(more)
    drop_cut(far_close)
    if hot.isEmpty():
        drop_cut(open_)
        drop_cut(sets)
        return links
    again = _rooted(hot.drop("root"), links)
    main = again.groupBy("key", "root").count().groupBy("key").agg(F.max(F.struct("count", "root")).alias("m"), F.count("*").alias("k")).filter("k > 1").select("key", F.col("m.root").alias("main"))
    split = cut(again.join(main, "key").groupBy("node", "n", "root").agg(F.max((F.col("root") != F.col("main")).cast("int")).alias("aside")))
    prefixes = _prefixes(split, sets)
    met = _sides(prefixes.filter("aside = 1"), "a", "root", "reach").join(_sides(prefixes, "b", "root", "reach"), "key").filter(_enough() & apart)
    # from the first shingle that two nodes share on, either has no more than its reach, and both must share this much
    most = F.least("reach_a", "reach_b") * (LIMIT[0] + LIMIT[1]) >= (F.col("n_a") + F.col("n_b")) * LIMIT[0]
    rest = met.filter(most).select("a", "b")
    more = _verified(rest, sets)
    out = cut(links.union(more))
    for x in (open_, sets, links, more, again, split, prefixes):
        drop_cut(x)
    return out


def _prefixes(split: DataFrame, sets: DataFrame) -> DataFrame:
    """split (node, n, root, aside) with key, a row for each shingle of its prefix that another node of split has too, and reach, the number of such shingles from this one on.

    Two sets of similarity s share s * n shingles of each set of n. So, in any one order of shingles, they share one among the first n - ceil(s * n) + 1 of each (prefix filtering; Chaudhuri et al., 2006).
    The rarest come first here: a node with more shingles of its own than its prefix holds is similar to no other, and needs no row.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                found = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(4)]
                rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                keys = pa.array(np.concatenate(found) if found else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in part.columns[:4]), keys], ["node", "n", "root", "aside", "key"])

    flat = cut(split.join(sets, "node").select("node", "n", "root", "aside", "found").mapInArrow(run, "node long, n long, root long, aside int, key long"))
    known = flat.join(flat.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"), "key")
    length = F.col("n") - F.ceil(F.col("n") * LIMIT[0] / LIMIT[1]) + 1
    # shingles of its own come first in a node's order
    held = known.withColumn("k", F.count("*").over(Window.partitionBy("node"))).withColumn("left", length - (F.col("n") - F.col("k")))
    near = held.filter("left > 0").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("df", "key")))
    out = cut(near.filter("place <= left").select("key", "node", "n", "root", "aside", (F.col("k") - F.col("place") + 1).alias("reach")))
    drop_cut(flat)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, bucket: int) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """docs with a row key and its name; the prints of all rows; and (digest, root): the component of each set of shingles."""
    keyed, name = with_row_key(docs)
    rows = keyed.select(F.col(id_col).cast("long").alias("id"), F.col(f"{name}.file").alias("file"), F.col(f"{name}.row").alias("row"), F.col(text_col).alias("text"))
    prints = cut(_prints(rows))
    order = F.struct(F.col("id").isNull().alias("lacks"), "id", "file", "row")
    nodes = cut(prints.groupBy("digest").agg(F.min(order).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).select("digest", "least.file", "least.row", "n", "fp", "keys").withColumn("node", F.monotonically_increasing_id()))
    fps = cut(nodes.groupBy("fp").agg(F.min("node").alias("node")))
    same = nodes.select("fp", "node").join(fps.withColumnRenamed("node", "a"), "fp").filter("a != node").select("a", F.col("node").alias("b"))
    close = cut(fingerprint_links(fps).union(same))
    band = cut(nodes.select(F.explode("keys").alias("key"), "node", "n"))
    links = shingle_links(band, close, nodes, rows.select("file", "row", "text"), bucket)
    roots = connected_components(links)
    drop_cut(links)
    classes = cut(nodes.select("digest", "node").join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("digest", F.coalesce("root", "node").alias("root")))
    for x in (fps, close, band, nodes, roots):
        drop_cut(x)
    return keyed, name, prints.drop("keys", "fp", "n"), classes


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """One row per document: doc_id, component_id (the smallest doc_id of the component over links of similarity 0.8 and more; null if all are).

    Words are those of the fingerprints; texts without words are copies of one another. Null text counts as empty. Rows are told apart by a key of their own: repeated rows each give
    a row, rows with a null or repeated id are linked by their texts alone. Other columns of docs are not read.
    """
    _, _, prints, classes = _classes(docs, id_col, text_col, bucket)
    rooted = cut(prints.join(classes, "digest").select("id", "root"))
    least = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id")))
    return rooted.join(least, "root").select(F.col("id").alias("doc_id"), "component_id")


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each component of near copies, the one with the smallest doc_id (null last; of equal ids the first stored); columns as they came."""
    keyed, name, prints, classes = _classes(docs, id_col, text_col, bucket)
    rooted = cut(prints.join(classes, "digest").select("root", "id", "file", "row"))
    order = F.struct(F.col("id").isNull().alias("lacks"), "id", "file", "row")
    kept = cut(rooted.groupBy("root").agg(F.min(order).alias("least"), F.count("*").alias("k")).filter("k > 1").select("root", F.col("least.file").alias("kept_file"), F.col("least.row").alias("kept_row")))
    copies = rooted.join(kept, "root").filter((F.col("file") != F.col("kept_file")) | (F.col("row") != F.col("kept_row")))
    return without(keyed, name, copies.select(F.struct("file", "row").alias(name)))
