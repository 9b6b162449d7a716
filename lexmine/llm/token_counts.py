"""Token counts by a linear longest-match automaton.

Greedy word-piece matching takes the longest piece at each place of a word. The vocabulary's trie gets
failure links and, for each node, the number of pieces that are popped when its link is followed, so a
word's number of pieces comes from one pass over its bytes, and no piece is ever built.
"""

from __future__ import annotations

import functools
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmine.llm.common import as_bytes

#: Words whose counts a worker remembers; beyond it, it starts anew.
MEMO = 1_000_000


class PieceCounter:
    """Automaton over bytes. continuation: the prefix of pieces that don't begin a word ("" if any piece may)."""

    def __init__(self, pieces: list[bytes], continuation: bytes = b""):
        self.next: list[dict[int, int]] = [{}]
        ends = set()
        for piece in pieces:
            if piece and piece != continuation:
                ends.add(self._add(piece))
        self.inner = self._add(continuation)
        self.fail: list[int] = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = [0] if self.inner == 0 else [0, self.inner]
        for u in queue:
            for c, v in self.next[u].items():
                if v == self.inner:
                    continue
                if v in ends:
                    self.fail[v], self.popped[v] = self.inner, 1
                else:
                    z, more = self.fail[u], 0
                    while z >= 0 and c not in self.next[z]:
                        more += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][c], self.popped[u] + more
                queue.append(v)

    def _add(self, piece: bytes) -> int:
        u = 0
        for c in piece:
            if c not in self.next[u]:
                self.next[u][c] = len(self.next)
                self.next.append({})
            u = self.next[u][c]
        return u

    def count(self, word: bytes) -> int:
        """Number of greedy pieces; 0 if the word can't be matched to its end."""
        u, n = 0, 0
        step, fail, popped = self.next, self.fail, self.popped
        for c in word:
            v = step[u].get(c)
            while v is None:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return 0
                v = step[u].get(c)
            u = v
        while u != self.inner:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return 0
        return n


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def counter(path: str, end: str = "</w>") -> PieceCounter:
    """Automaton of a byte-level tokenizer file; word-end marks are cut off, as any piece may stand anywhere."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    symbol = byte_of_symbol()
    pieces = {t.removesuffix(end) for t in vocabulary}
    return PieceCounter([bytes(symbol[c] for c in p) for p in sorted(pieces) if all(c in symbol for c in p)])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_tokens, n_unknown.

    Words end at ASCII white space; A-Z are lowered. A word that the pieces can't cover counts as one
    token and as unknown. Null and empty texts have no words. Repeated rows are counted each; other
    columns, whatever their names, are not read. An empty table gives an empty result.
    """

    def run(batches):
        automaton, memo = counter(vocabulary), {}
        for batch in batches:
            out = []
            for text in as_bytes(batch.column(1)):
                found = text.lower().split()
                if len(memo) > MEMO:
                    memo.clear()
                for w in set(found).difference(memo):
                    memo[w] = automaton.count(w)
                sizes = list(map(memo.__getitem__, found))
                unknown = sizes.count(0)
                out.append((len(found), sum(sizes) + unknown, unknown))
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n_words", "n_tokens", "n_unknown"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, n_unknown long")
