"""Masked pseudo-likelihood scores from a bidirectional window network.

A network sees two neighbours on each side of a masked token and predicts the token itself by a hierarchical softmax over the whole vocabulary. Words that make up at least one token in 2^13 are
predicted one by one: first their group of 32 words of like frequency, then the word in the group, both from both sides. All other words share groups by their endings, which the network predicts; inside
these a word has its share of the group's tokens by its own count, however rare it is. A document's score is the sum of these conditional log-probabilities, its pseudo-log-likelihood.

Counts come from all documents by a grouped sum, in whole numbers. The network is trained in numpy on all documents, one masked position in eight of each, over whole texts as context. Positions are dealt to
blocks by a hash of the row's contents; each block trains from the round's common start, in an order of its own contents, and the blocks' parameters are averaged in a fixed order (parameter mixing;
Zinkevich et al., 2010). Neither depends on how the table is cut into partitions.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .shared import cut, drop_cut, values

#: Least shares of all tokens, as powers of two, of words that are predicted one by one (so at most 2^13) and of words whose counts every worker holds (at most 2^20); counts of rarer words are joined.
PREDICTED, HELD_WORDS = 13, 20
#: Words of a group, groups of rarer words by their endings and the bytes of an ending, hidden units, neighbours on each side.
WIDTH, ENDINGS, ENDING, HIDDEN, SIDE = 32, 32, 3, 24, 2
#: One position in so many is masked in training; masked positions of a block, of a piece of a text that goes to one block, and of a training step; steps of a block in a round at least; rounds; step size.
MASK, BLOCK, PIECE, STEP, LEAST_STEPS, ROUNDS, RATE = 8, 1 << 18, 4096, 1024, 200, 2, 0.02
#: Vectors that are added up at a time, and tokens that are scored at a time.
FAN_IN, SLICE = 16, 8192
#: Distinct words that a task holds before it passes their counts on.
HELD = 300_000


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word binary, n): counts of all words `[^\\x20\\x09-\\x0D]+` of all texts."""

    def run(batches):
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        held: Counter = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                if text.is_valid:
                    held.update(text.as_py().split())
                    if len(held) > HELD:
                        yield out(held)
                        held = Counter()
        yield out(held)

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ending_group(word: bytes) -> int:
    return crc32(word[-ENDING:]) % ENDINGS


@dataclass
class Vocabulary:
    """Held words and their counts, the commonest first; the number that are predicted one by one; the tokens of each group of rarer words; all tokens."""

    counts: dict[bytes, int]
    predicted: int
    rare: np.ndarray
    tokens: int

    def __post_init__(self) -> None:
        self.codes = {w: i for i, w in zip(range(self.predicted), self.counts)}
        self.groups = -(-self.predicted // WIDTH)
        self.classes = self.groups + ENDINGS
        self.pad = self.predicted + ENDINGS
        code = np.arange(self.pad + 1)
        #: the class of each code, in which those of rarer words have classes of their own
        self.class_of = np.where(code < self.predicted, code // WIDTH, code - self.predicted + self.groups)
        mass = np.concatenate([np.fromiter(self.counts.values(), np.float64, len(self.counts))[: self.predicted], self.rare])
        self.mass = np.maximum(mass, 0.5)
        self.single = mass[: self.predicted] == 1

    def encode(self, text: bytes) -> tuple[np.ndarray, float, list[int], int]:
        """Codes of a text's words; the sum over its held rarer words of the logarithms of their counts; hashes of the words that are not held; and the words that are known to occur once."""
        codes, held, rare = self.codes, self.counts, {}
        words = text.split()
        out = np.fromiter((codes.get(w, -1) for w in words), np.int32, len(words))
        logs, unknown, alone = 0.0, [], 0
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            found = rare.get(w)
            if found is None:
                n = held.get(w)
                found = rare[w] = (self.predicted + ending_group(w), math.log(n or 1), _signed(xxhash.xxh64_intdigest(w, 42)) if n is None else None, n == 1)
            out[i] = found[0]
            logs += found[1]
            alone += found[3]
            if found[2] is not None:
                unknown.append(found[2])
        return out, logs, unknown, alone + int(np.count_nonzero(self.single[out[out < self.predicted]]))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def learn_words(counts: DataFrame) -> Vocabulary:
    """The vocabulary of a table of counts. Only words that make up one token in 2^HELD_WORDS reach the driver, which bounds their number; ties go to the smaller word."""
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    least = lambda power: max(1, -(-tokens >> power))
    found = counts.filter(F.col("n") >= least(HELD_WORDS)).collect()
    held = {bytes(r["word"]): r["n"] for r in sorted(found, key=lambda r: (-r["n"], bytes(r["word"])))}
    predicted = sum(n >= least(PREDICTED) for n in held.values())
    rare = np.zeros(ENDINGS)
    group = F.pmod(F.crc32(F.substring("word", -ENDING, ENDING)), F.lit(ENDINGS)).cast("int")
    for r in counts.filter(F.col("n") < least(PREDICTED)).groupBy(group.alias("k")).agg(F.sum("n").alias("n")).collect():
        rare[r["k"]] = r["n"]
    return Vocabulary(held, predicted, rare, tokens)


class WindowNetwork:
    """hidden = tanh(bias + sum of the neighbours' vectors); softmax over classes, and inside a class of single words over its words. All parameters lie in one flat array."""

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None) -> None:
        v = self.vocabulary = vocabulary
        self.shapes = ((2 * SIDE, v.pad + 1, HIDDEN), (HIDDEN,), (HIDDEN, v.classes), (v.classes,), (max(1, v.groups), HIDDEN, WIDTH), (max(1, v.groups), WIDTH))
        self.sizes = [int(np.prod(s)) for s in self.shapes]
        if flat is None:
            flat = self._start()
        self.flat = np.array(flat, dtype=np.float32)
        self.vectors, self.bias, self.out, self.offset, self.inner, self.inner_offset = self._views(self.flat)
        self.momentum, self.square, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0

    def _views(self, flat):
        return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum(self.sizes)[:-1]), self.shapes)]

    def _start(self) -> np.ndarray:
        """Small random vectors, and offsets that give each word its share of all tokens."""
        v, flat = self.vocabulary, np.random.RandomState(11).normal(0, 0.1, sum(self.sizes))
        _, bias, out, offset, inner, inner_offset = self._views(flat)
        bias[:], inner[:] = 0, 0
        out[:] *= 0.1
        offset[:] = np.log(np.bincount(v.class_of[: v.pad], v.mass, minlength=v.classes))
        inner_offset[:] = -30.0  # places without a word
        for g in range(v.groups):
            n = np.log(v.mass[g * WIDTH : min((g + 1) * WIDTH, v.predicted)])
            inner_offset[g, : len(n)] = n
        return flat

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        total = self.bias + self.vectors[0][around[0]]
        for k in range(1, 2 * SIDE):
            total += self.vectors[k][around[k]]
        return np.tanh(total, out=total)

    def _by_group(self, target: np.ndarray):
        """(group, rows) of the targets that are predicted one by one."""
        single = np.flatnonzero(target < self.vocabulary.predicted)
        group = target[single] // WIDTH
        order = np.argsort(group, kind="stable")
        single, group = single[order], group[order]
        ends = np.flatnonzero(np.diff(group, append=-1))
        start = 0
        for e in ends.tolist():
            yield int(group[e]), single[start : e + 1]
            start = e + 1

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of single words the logarithms of their probabilities, of rarer words those of their groups."""
        hidden, kind = self._hidden(around), self.vocabulary.class_of[target]
        out = _log_softmax(hidden @ self.out + self.offset, kind)
        for g, rows in self._by_group(target):
            out[rows] += _log_softmax(hidden[rows] @ self.inner[g] + self.inner_offset[g], target[rows] - g * WIDTH)
        return out

    def gradient(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the mean of the negative log-probabilities."""
        g_flat = np.zeros_like(self.flat)
        g_vectors, g_bias, g_out, g_offset, g_inner, g_inner_offset = self._views(g_flat)
        n, hidden = len(target), self._hidden(around)
        p = _less_target(hidden @ self.out + self.offset, self.vocabulary.class_of[target], n)
        g_out[:], g_offset[:] = hidden.T @ p, p.sum(axis=0)
        back = p @ self.out.T
        for g, rows in self._by_group(target):
            h = hidden[rows]
            p = _less_target(h @ self.inner[g] + self.inner_offset[g], target[rows] - g * WIDTH, n)
            g_inner[g], g_inner_offset[g] = h.T @ p, p.sum(axis=0)
            back[rows] += p @ self.inner[g].T
        back *= 1 - hidden * hidden
        g_bias[:] = back.sum(axis=0)
        for k in range(2 * SIDE):
            order = np.argsort(around[k], kind="stable")
            codes = around[k][order]
            starts = np.flatnonzero(np.diff(codes, prepend=-1))
            g_vectors[k][codes[starts]] = np.add.reduceat(back[order], starts, axis=0)
        return g_flat

    def train(self, around: np.ndarray, target: np.ndarray) -> None:
        """One Adam step on a batch of windows."""
        g = self.gradient(around, target)
        self.steps += 1
        self.momentum += 0.1 * (g - self.momentum)
        self.square += 0.01 * (g * g - self.square)
        fade = RATE / (1 + self.steps / 200)
        self.flat -= fade * (self.momentum / (1 - 0.9**self.steps)) / (np.sqrt(self.square / (1 - 0.99**self.steps)) + 1e-6)


def _log_softmax(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    return logits[np.arange(len(at)), at] - np.log(np.exp(logits).sum(axis=1))


def _less_target(logits: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The softmax less one at the target, over n."""
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits, out=logits)
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(at)), at] -= 1
    p /= n
    return p


def windows(codes: np.ndarray, at: np.ndarray, pad: int) -> np.ndarray:
    """The neighbours' codes of the positions at, by place: two to the left, then two to the right."""
    held = np.full(len(codes) + 2 * SIDE, pad, dtype=np.int32)
    held[SIDE:-SIDE] = codes
    return np.stack([held[at + SIDE + d] for d in range(-SIDE, SIDE + 1) if d])


def _coded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """docs (doc_id, text) as (rid, doc_id, key: a hash of both, codes, logs, unknown, alone), written once."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = [vocabulary.encode(t or b"") for t in values(part.column(2).cast(pa.binary()))]
                columns = [pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.int64())), pa.array([f[3] for f in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["doc_id", "key", "codes", "logs", "unknown", "alone"])

    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return cut(keyed.mapInArrow(run, "doc_id long, key long, codes binary, logs double, unknown array<long>, alone long").withColumn("rid", F.monotonically_increasing_id()))


def _masked(coded: DataFrame, vocabulary: Vocabulary, blocks: int) -> DataFrame:
    """(block, key, piece, payload): the windows and targets of the masked positions, as 16-bit codes."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys = part.column(0).to_numpy(zero_copy_only=False)
                out = [[], [], [], []]
                first = np.zeros(len(keys), dtype=bool)
                first[np.unique(keys, return_index=True)[1]] = True  # copies of a row train once
                for key, own, codes in zip(keys.tolist(), first.tolist(), part.column(1)):
                    if not own:
                        continue
                    codes = np.frombuffer(codes.as_buffer(), np.int32)
                    masked = np.arange(key % MASK, len(codes), MASK)
                    for piece, s in enumerate(range(0, len(masked), PIECE)):
                        p = masked[s : s + PIECE]
                        payload = np.vstack([windows(codes, p, vocabulary.pad), codes[p]]).astype(np.uint16)
                        for column, v in zip(out, (xxhash.xxh64_intdigest(f"{key} {piece}") % blocks, key, piece, payload.tobytes())):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["block", "key", "piece", "payload"])

    return cut(coded.select("key", "codes").mapInArrow(run, "block long, key long, piece long, payload binary"))


def _mixed(vectors: DataFrame, blocks: int) -> tuple[np.ndarray, float]:
    """The sum of weight times vector, and of weights, of (block, weight, vector): in a fixed order, FAN_IN vectors at a time."""
    vectors = cut(vectors)
    while True:

        def add(table):
            rows = sorted(zip(table.column("block").to_pylist(), table.column("weight").to_pylist(), table.column("vector")), key=lambda r: r[0])
            total = sum((np.frombuffer(v.as_buffer(), np.float64) for _, _, v in rows[1:]), np.frombuffer(rows[0][2].as_buffer(), np.float64))
            return pa.table({"block": pa.array([rows[0][0] // FAN_IN], pa.int64()), "weight": pa.array([sum(r[1] for r in rows)], pa.float64()), "vector": pa.array([total.tobytes()], pa.binary())})

        added = cut(vectors.groupBy(F.floor(F.col("block") / FAN_IN).cast("long").alias("to")).applyInArrow(add, "block long, weight double, vector binary"))
        drop_cut(vectors)
        vectors, blocks = added, -(-blocks // FAN_IN)
        if blocks == 1:
            row = vectors.first()
            drop_cut(vectors)
            return np.frombuffer(row["vector"], np.float64), row["weight"]


def train_network(coded: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, block: int = BLOCK) -> WindowNetwork:
    """The network after the given rounds over the masked positions of all rows of coded (key, codes)."""
    network = WindowNetwork(vocabulary)
    blocks = max(1, -(-vocabulary.tokens // (MASK * block)))
    masked = _masked(coded, vocabulary, blocks)
    if masked.isEmpty():
        return network

    def learner(flat):
        def learn(table):
            rows = sorted({(k, p): x for k, p, x in zip(table.column("key").to_pylist(), table.column("piece").to_pylist(), table.column("payload").to_pylist())}.items())
            data = np.concatenate([np.frombuffer(x, np.uint16).reshape(2 * SIDE + 1, -1) for _, x in rows], axis=1).astype(np.int32)
            own, n = WindowNetwork(vocabulary, flat), data.shape[1]
            order = np.random.RandomState(5).permutation(n)
            steps = -(-n // STEP)
            for _ in range(max(1, -(-LEAST_STEPS // steps))):
                for s in range(0, n, STEP):
                    part = data[:, order[s : s + STEP]]
                    own.train(part[:-1], part[-1])
            return pa.table({"block": table.column("block").slice(0, 1), "weight": pa.array([float(n)], pa.float64()), "vector": pa.array([(own.flat.astype(np.float64) * n).tobytes()], pa.binary())})

        return learn

    for _ in range(rounds):
        learn = learner(network.flat)
        total, weight = _mixed(masked.groupBy("block").applyInArrow(learn, "block long, weight double, vector binary"), blocks)
        network = WindowNetwork(vocabulary, total / weight)
    drop_cut(masked)
    return network


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood (sum over tokens), per_token (its mean; null without tokens), n_alone (tokens whose word occurs once in all of docs).

    Words, counts and the network come from the texts of docs themselves, all of them and whole. Null and empty texts have no tokens and a sum of 0. Repeated rows each give a row, count in the
    counts and train once. Scores do not depend on the table's partitions, but for the rounding of sums.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counts = cut(word_counts(rows))
    vocabulary = learn_words(counts)
    coded = _coded(rows, vocabulary)
    flat = train_network(coded, vocabulary, rounds, block).flat
    log_rare = np.concatenate([np.zeros(vocabulary.predicted), np.log(np.maximum(vocabulary.rare, 1.0))])

    def run(batches):
        network = WindowNetwork(vocabulary, flat)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                yield _scores(network, b.slice(at, 512), log_rare)

    scored = cut(coded.select("rid", "doc_id", "codes", "logs", "alone").mapInArrow(run, "rid long, doc_id long, n_tokens long, sum double, alone long"))
    # words that occur once have the logarithm 0
    least = max(1, -(-vocabulary.tokens >> HELD_WORDS))
    others = counts.filter((F.col("n") < least) & (F.col("n") > 1)).select(F.xxhash64("word").alias("h"), F.log(F.col("n").cast("double")).alias("log"))
    asked = coded.select("rid", F.explode("unknown").alias("h"))
    joined = cut(asked.join(others, "h", "left").groupBy("rid").agg(F.sum("log").alias("joined"), F.count_if(F.col("log").isNull()).alias("lone")))
    drop_cut(coded)
    drop_cut(counts)
    total, alone = F.col("sum") + F.coalesce("joined", F.lit(0.0)), (F.col("alone") + F.coalesce("lone", F.lit(0))).cast("long")
    mean = F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))
    return scored.join(joined, "rid", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), mean.alias("per_token"), alone.alias("n_alone"))


def _scores(network: WindowNetwork, part: pa.RecordBatch, log_rare: np.ndarray) -> pa.RecordBatch:
    """rid, doc_id, n_tokens, the sum of the log-probabilities of the words that are held, and alone, of rows (rid, doc_id, codes, logs, alone)."""
    codes = [np.frombuffer(c.as_buffer(), np.int32) for c in part.column(2)]
    counts, pad = np.array([len(c) for c in codes], dtype=np.int64), network.vocabulary.pad
    sums = part.column(3).to_numpy(zero_copy_only=False).astype(np.float64)
    edge = np.full(SIDE, pad, dtype=np.int32)
    line = np.concatenate([x for c in codes for x in (c, edge)]) if codes else edge  # texts with an edge between them
    owner = np.repeat(np.arange(len(codes)), counts + SIDE)
    at = np.flatnonzero(line != pad)
    for s in range(0, len(at), SLICE):
        p = at[s : s + SLICE]
        lo, hi = p[0], p[-1] + 1
        target = line[p]
        value = network.log_probabilities(windows(line[max(0, lo - SIDE) : hi + SIDE], p - max(0, lo - SIDE), pad), target).astype(np.float64) - log_rare[target]
        sums += np.bincount(owner[p], value, minlength=len(codes))
    return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts), pa.array(sums), part.column(4)], ["rid", "doc_id", "n_tokens", "sum", "alone"])
