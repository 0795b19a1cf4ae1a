"""Token counts by the linear longest-match automaton (Song et al., 2021): greedy word-piece lengths without building pieces.

The vocabulary forms a trie over bytes. Each node that greedy matching can be in has a failure link: the node that spells what is left after the longest vocabulary pieces were popped
off the front of the node's string, and the precomputed number of pieces popped on the way. A word is then read once, byte by byte: where the trie has no child, the automaton adds
the popped count and follows the link. No piece is ever cut out.
"""

from __future__ import annotations

from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .rank_queue_bpe import read_ranks
from .shared import small_batches

#: Counts of words up to this length are remembered, this many at a time.
MEMO_LENGTH, MEMO_SIZE = 48, 400_000


class PieceAutomaton:
    """Counts of greedy longest-match pieces of byte strings; count() is None for a string that the pieces cannot spell.

    continuation: the mark of pieces that stand inside a word, such as ## of word-piece vocabularies; a word's first piece is any piece as it is spelled, the others are marked ones without
    their mark. Without a continuation all pieces stand anywhere.
    """

    def __init__(self, pieces, continuation: bytes = b"") -> None:
        self.children: list[dict[int, int]] = [{}]
        self.final = [False]
        self.inside = self._node() if continuation else 0  # the root of what follows a piece
        for piece in sorted(pieces):
            self._insert(0, piece)
            if continuation and piece.startswith(continuation):
                self._insert(self.inside, piece[len(continuation) :])
        self.fail, self.popped = self._links()

    def _node(self) -> int:
        self.children.append({})
        self.final.append(False)
        return len(self.children) - 1

    def _insert(self, node: int, piece: bytes) -> None:
        for byte in piece:
            nxt = self.children[node].get(byte)
            if nxt is None:
                nxt = self.children[node][byte] = self._node()
            node = nxt
        self.final[node] |= bool(piece)

    def _links(self) -> tuple[list[int], list[int]]:
        """Failure links (-1: none) and popped-piece counts, breadth first; those of the inner trie, to which all links lead, before the others."""
        children, final, inside, n = self.children, self.final, self.inside, len(self.children)
        fail, popped = [-1] * n, [0] * n
        for root in {inside: None, 0: None}:
            queue = deque([root])
            while queue:
                u = queue.popleft()
                for byte, v in children[u].items():
                    if final[v]:
                        fail[v], popped[v] = inside, 1
                    else:
                        z, count = fail[u], popped[u]
                        while z >= 0 and byte not in children[z]:
                            count += popped[z]
                            z = fail[z]
                        if z >= 0:
                            fail[v], popped[v] = children[z][byte], count
                    queue.append(v)
        return fail, popped

    def count(self, word: bytes) -> int | None:
        children, fail, popped, inside = self.children, self.fail, self.popped, self.inside
        if not word:
            return 0
        node = total = 0
        for byte in word:
            nxt = children[node].get(byte)
            while nxt is None:
                if fail[node] < 0:
                    return None
                total += popped[node]
                node = fail[node]
                nxt = children[node].get(byte)
            node = nxt
        while node != inside:
            if fail[node] < 0:
                return None
            total += popped[node]
            node = fail[node]
        return total


class WordCounter(dict):
    """Counts by word, filled on demand and bounded."""

    def __init__(self, automaton: PieceAutomaton, mark: bytes) -> None:
        self.automaton, self.mark = automaton, mark

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.mark + word)
        n = 1 if n is None else n
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str) -> list[bytes]:
    """The pieces of a vocabulary file: a rank file, or a word-piece list with one piece a line where its name ends in .txt."""
    if not path.endswith(".txt"):
        return list(read_ranks(path))
    with open(path, "rb") as f:
        return [line.rstrip(b"\r\n") for line in f if line.strip()]


@lru_cache(maxsize=2)
def word_counter(path: str, mark: bytes, continuation: bytes = b"") -> WordCounter:
    return WordCounter(PieceAutomaton(read_pieces(path), continuation), mark)


def piece_counts(docs: DataFrame, path: str, mark: bytes = b" ", continuation: bytes = b"", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_pieces, and max_pieces, the most pieces of one word.

    Words are `[^\\x20\\x09-\\x0D]+` of the whole text; each is matched as mark + word against the pieces of the file at path. Vocabularies tell word starts apart by a mark before them, or, with
    an empty mark, by a continuation before the other pieces (b"##"). A word that the pieces cannot spell counts as one. Null and empty texts have zeros. Repeated rows each give a row.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        counter = word_counter(path, mark, continuation)
        for b in batches:
            words, total, most = [], [], []
            for text in b.column(1).cast(pa.binary()):
                found = (text.as_py() or b"").split()
                counts = list(map(counter.__getitem__, found))
                words.append(len(found))
                total.append(sum(counts))
                most.append(max(counts, default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, total, most))], ["doc_id", "n_words", "n_pieces", "max_pieces"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_words long, n_pieces long, max_pieces long")
