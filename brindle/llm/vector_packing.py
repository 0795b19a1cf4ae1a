"""Sequence packing as vector bin packing with the dot-product heuristic (Panigrahy et al., 2011).

A sequence has three limits at once: tokens, segments and loss-bearing tokens. An example is a prompt, which bears no loss, and a rest that does. The part of a waiting example that an open
sequence can hold is a vector of three demands, in shares of the limits. A sequence opens with the example that has waited longest, so that small ones do not pile up, and then takes the example
whose demand has the largest dot product with what is left of its limits, whole ones first among equals. Examples are cut where a limit ends, so a long example's rest waits for sequences in which others' prompts leave room beside its loss-bearing tokens.
Every partition packs its own rows with a bounded pool and no shuffle; what is left at its end goes into sequences of exactly a power of two.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .shared import small_batches, values

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (1024, 4, 992)
#: Examples that wait in a partition's pool.
POOL = 512
#: Bits of a sequence id below the partition's number.
PARTITION_SHIFT = 36


class Packer:
    """Packs examples into sequences; closed ones lie in done as (sequence number, [(key, start, ids, offset)])."""

    def __init__(self, limits=LIMITS, pool: int = POOL) -> None:
        self.limits, self.size = limits, pool
        self.weights = 1.0 / np.square(np.array(limits, dtype=np.float64))
        self.length, self.quiet, self.since = (np.zeros(pool + 1, dtype=np.int64) for _ in range(3))
        self.items: list[tuple] = []  # (key, start, ids)
        self.tokens, self.number, self.arrived, self.done = 0, 0, 0, []

    def add(self, key, ids: np.ndarray, prompt: int = 0) -> None:
        """An example of which the first prompt tokens bear no loss."""
        self._wait((key, 0, ids), min(prompt, len(ids)))
        if len(self.items) > self.size or self.tokens > 4 * self.size * self.limits[0]:
            while self.items and (len(self.items) > self.size // 2 or self.tokens > 2 * self.size * self.limits[0]):
                self._close(self._fill(self.limits[0]))

    def finish(self) -> None:
        """Packs all that waits: full sequences first, then powers of two."""
        capacity = self.limits[0]
        while self.items:
            placed = self._fill(capacity, oldest=False)
            if sum(len(x[2]) for x in placed) < capacity:
                self._undo(placed)
                capacity = 1 << ((capacity - 1).bit_length() - 1)
            else:
                self._close(placed)

    def _wait(self, item: tuple, quiet: int) -> None:
        n = len(self.items)
        self.length[n], self.quiet[n], self.since[n] = len(item[2]), quiet, self.arrived
        self.arrived += 1
        self.items.append(item)
        self.tokens += len(item[2])

    def _parts(self, left) -> tuple[np.ndarray, np.ndarray]:
        """Of each waiting example, the tokens that fit and the loss-bearing ones among them."""
        n = len(self.items)
        quiet = self.quiet[:n]
        part = np.minimum(np.minimum(self.length[:n], quiet + left[2]), left[0])
        return part, np.maximum(part - quiet, 0)

    def _fill(self, capacity: int, oldest: bool = True) -> list:
        """The segments of one sequence, taken from the pool; oldest: it opens with the example that has waited longest."""
        tokens, segments, loss = capacity, self.limits[1], self.limits[2]
        placed, offset = [], 0
        w = self.weights
        while tokens and segments and self.items:
            part, bearing = self._parts((tokens, segments, loss))
            n = len(part)
            score = part * (tokens * w[0]) + bearing * (loss * w[2])
            score += (part == self.length[:n]) * 1e-9  # whole ones first among equals
            if segments == 1:  # the last segment should fill the sequence
                score += part == tokens
            i = int(score.argmax()) if offset or not oldest else int(self.since[:n].argmin())
            take = int(part[i])
            if not take:
                break
            (key, start, ids), quiet = self.items[i], int(self.quiet[i])
            if take < len(ids):
                self.items[i] = (key, start + take, ids[take:])
                self.length[i] -= take
                self.quiet[i] = max(0, quiet - take)
            else:
                self.items[i] = self.items[-1]
                for x in (self.length, self.quiet, self.since):
                    x[i] = x[n - 1]
                self.items.pop()
            self.tokens -= take
            placed.append((key, start, ids[:take], offset, min(quiet, take)))
            tokens, segments, loss, offset = tokens - take, segments - 1, loss - max(0, take - quiet), offset + take
        return placed

    def _undo(self, placed: list) -> None:
        """Returns segments to the pool; a cut example joins its rest again."""
        at = {(id(key), start): i for i, (key, start, _) in enumerate(self.items)}
        for key, start, ids, _, quiet in reversed(placed):
            i = at.pop((id(key), start + len(ids)), None)
            if i is None:
                if len(self.items) == len(self.length):
                    self.length, self.quiet, self.since = (np.concatenate([x, np.zeros(64, dtype=np.int64)]) for x in (self.length, self.quiet, self.since))
                self._wait((key, start, ids), quiet)
                at[id(key), start] = len(self.items) - 1
            else:
                rest = self.items[i][2]
                self.items[i] = (key, start, np.concatenate([ids, rest]))
                self.length[i] += len(ids)
                self.quiet[i] += quiet
                self.tokens += len(ids)
                at[id(key), start] = i

    def _close(self, placed: list) -> None:
        if placed:
            self.done.append((self.number, [x[:4] for x in placed]))
            self.number += 1


class JsonEncoder:
    """Ids of a byte-level BPE in the JSON file of the tokenizers library, as that library gives them without special tokens of its own.

    A string of an added token in a text gives that token's id, which is the library's default; ordinary=True reads it as ordinary text. Merges run in the rank encoder over the
    file's vocabulary, several times faster, so only files whose ids follow their merges are taken.
    """

    def __init__(self, path: str, pattern: str, ordinary: bool = False) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        model, added = found["model"], found["added_tokens"]
        if model["type"] != "BPE" or found["normalizer"] or found["pre_tokenizer"]["type"] != "ByteLevel" or found["pre_tokenizer"]["add_prefix_space"] or any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in added):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]  # bytes that stand for themselves in the file
        spelled = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        special = {x["content"] for x in added}
        ranks = {bytes(map(spelled.__getitem__, w)): i for w, i in model["vocab"].items() if w not in special}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or any(i >= merged[0] for w, i in ranks.items() if len(w) == 1):
            raise ValueError(f"the ids of {path} do not follow its merges")
        self.encode_part = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy
        self.added = {} if ordinary else {x["content"]: x["id"] for x in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None

    def encode(self, text: str) -> list[np.ndarray]:
        """The ids of a text, in parts."""
        if self.split is None or not any(x in text for x in self.added):
            return [self.encode_part(text, disallowed_special=()).astype("<u4", copy=False)]
        return [np.array([self.added[x]], dtype="<u4") if x in self.added else self.encode_part(x, disallowed_special=()).astype("<u4", copy=False) for x in self.split(text) if x]


@lru_cache(maxsize=2)
def json_encoder(path: str, pattern: str) -> JsonEncoder:
    """One encoder for each Python worker."""
    return JsonEncoder(path, pattern)


def first_line(text: str) -> Column:
    """The length of a text's first line with its line end, where another line follows; 0 otherwise. A heading or an instruction stands there."""
    at = F.locate("\n", F.col(text))
    return F.coalesce(F.when(at < F.length(text), at), F.lit(0)).cast("int")


def pack_documents(docs: DataFrame, path: str, pattern: str, end_id: int = 0, limits=LIMITS, id_col: str = "doc_id", text_col: str = "text", prompt: Column | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    path: a byte-level BPE of the tokenizers library as JSON, which every executor can open, with the pattern that splits text. An example is its text's ids and end_id, cut freely. prompt: a whole
    number of code points of the text; tokens that begin in them bear no loss (default: the first line, where a text has more; null: none).
    Each id lies in exactly one piece; sequences have at most limits[0] tokens, limits[1] pieces and limits[2] loss-bearing tokens, offsets without gaps. Sequences shorter than the
    limit that end a partition have a power of two of tokens. Null and empty texts have end_id alone. Repeated rows and null ids are packed like others. An empty table gives no rows. Sequence ids are
    unique and depend on the input's partitions. with_ids adds ids, the piece's token ids.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"] + ["ids"] * with_ids
    types = [pa.int64()] * 8 + [pa.list_(pa.int64())] * with_ids

    def rows(packer, first):
        columns = [[] for _ in names]
        for number, placed in packer.done:
            for (doc, total, quiet), start, ids, offset in placed:
                row = [doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first + number, offset, len(ids) - min(len(ids), max(0, quiet - start))]
                for c, v in zip(columns, row):
                    c.append(v)
                if with_ids:
                    columns[8].append(ids.astype(np.int64))
        packer.done = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def run(batches):
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        encoder, packer = json_encoder(path, pattern), Packer(limits)
        encode, end = encoder.encode, np.array([end_id], dtype="<u4")
        for b in batches:
            for doc, text, quiet in zip(*map(values, b.columns)):
                text = text or ""
                ids = np.concatenate([*encode(text), end]) if text else end
                # tokens before the prompt's end: those of the prompt alone; merges across its end belong to the token that begins in it
                k = min(len(ids), sum(map(len, encode(text[:quiet])))) if quiet else 0
                packer.add((doc, len(ids), k), ids, k)
                if len(packer.done) >= 2048:
                    yield rows(packer, first)
            if packer.done:
                yield rows(packer, first)
        packer.finish()
        if packer.done:
            yield rows(packer, first)

    quiet = first_line("text") if prompt is None else prompt.cast("int")
    schema = ", ".join(f"{n} {'array<long>' if n == 'ids' else 'long'}" for n in names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), quiet.alias("quiet")).mapInArrow(run, schema)
