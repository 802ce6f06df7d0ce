"""Problem 6: token ids of a whole corpus by a public byte-pair vocabulary.

Method: backtracking encoder. An Aho-Corasick automaton gives the longest token at each place of a piece; a token is kept if
it is compatible with the one before it, else shorter ones are tried, else the one before it is taken back. A pair is
compatible if merging in rank order would leave it a pair, which a table of pairs and of each token's last merge answers.
The result is that of merging in rank order, in linear time. Decoding copies from one byte string by an offset table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's makers cut a text into pieces before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers before it forgets all; bounds its memory, not what is encoded.
REMEMBERED = 300_000


@dataclass
class Merges:
    """Tables over token ids, which are ranks: single bytes first, each later token joined from two earlier ones."""

    token: list[bytes]
    shorter: list[int]  # the longest token that is a proper prefix, or -1
    halves: list[tuple[int, int]]  # what the last merge joined; itself twice for a single byte
    joined: dict[tuple[int, int], int]  # the token that two tokens merge into
    pattern: str = PIECES
    _own: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, path: str | Path, pattern: str = PIECES) -> Merges:
        ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        token = [b""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            token[i] = t
        m = cls(token, [-1] * len(token), [(i, i) for i in range(len(token))], {}, pattern)
        for t, i in sorted(ids.items(), key=lambda x: x[1]):
            m.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
            for k in range(1, len(t)):
                a, b = ids.get(t[:k], i), ids.get(t[k:], i)
                if a < i and b < i and m.compatible(a, b):
                    m.halves[i], m.joined[a, b] = (a, b), i
                    break
            else:
                if len(t) > 1:
                    raise ValueError(f"token {i} can't be merged from earlier ones")
        return m

    def compatible(self, a: int, b: int) -> bool:
        """Whether a next to b stays so: no merge across their border comes before the merges that made them.

        Merges are undone from the latest to the earliest; at each state the two tokens at the border must not join by a
        merge earlier than the one undone last.
        """
        joined, halves = self.joined, self.halves
        undone = len(self.token)
        while True:
            if joined.get((a, b), undone) < undone:
                return False
            single_a, single_b = halves[a][0] == a, halves[b][0] == b
            if single_a and single_b:
                return True
            if not single_a and (single_b or a > b):
                undone, a = a, halves[a][1]
            else:
                undone, b = b + 1, halves[b][0]  # of two equal merges the left one comes first

    def _automaton(self) -> ahocorasick.Automaton:
        if "trie" not in self._own:
            trie = ahocorasick.Automaton()
            for i, t in enumerate(self.token):
                if t:
                    trie.add_word(t.decode("latin-1"), (len(t), i))
            trie.make_automaton()
            self._own["trie"] = trie
        return self._own["trie"]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        n = len(piece)
        longest, size = [-1] * n, [0] * n
        for end, (k, i) in self._automaton().iter(piece.decode("latin-1")):
            at = end - k + 1
            if k > size[at]:
                longest[at], size[at] = i, k
        out: list[int] = []
        dead = bytearray(n + 1)
        at, t = 0, longest[0] if n else -1
        while at < n or t >= 0:
            end = at + len(self.token[t])
            if not dead[end] and (not out or self.compatible(out[-1], t)):
                out.append(t)
                at = end
                t = longest[at] if at < n else -1
            elif self.shorter[t] >= 0:
                t = self.shorter[t]
            else:
                dead[at] = 1
                t = out.pop()
                at -= len(self.token[t])
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_own": {}}


class _Pieces(dict):
    """Ids of pieces seen before, as packed int32."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = np.array(self.merges.encode_piece(piece.encode()), np.int32).tobytes()
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, merges: Merges) -> None:
        self.pieces = _Pieces(merges)
        self.cut = regex.compile(merges.pattern).findall

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as int32; none for an empty and a null text."""
        return b"".join(map(self.pieces.__getitem__, self.cut(text))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()


class Decoder:
    """All tokens in one byte string, found by an offset table."""

    def __init__(self, merges: Merges) -> None:
        self.bytes = np.frombuffer(b"".join(merges.token), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in merges.token])])

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[np.asarray(ids) + 1] - self.offset[ids]
        shift = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return self.bytes[np.arange(size.sum()) + shift].tobytes()


_WORKER: dict[tuple, object] = {}


def _kept(kind: type, shared) -> object:
    """One encoder or decoder for each Python worker and vocabulary."""
    key = (kind, shared.value.pattern, len(shared.value.token))
    if key not in _WORKER:
        _WORKER[key] = kind(shared.value)
    return _WORKER[key]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, ids array<int>) of every row of df: the ids of the whole text, without special tokens.

    Empty and null texts give an empty list, a blank text the ids of its blanks; repeated rows and null keys are kept. The
    vocabulary is read by the driver and broadcast; its size is fixed. There is no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(Merges.read(vocabulary))
    src = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _kept(Encoder, shared)
        for b in batches:
            got = [enc.packed(t) for t in b.column(1).to_pylist()]
            ends = np.cumsum([0, *(len(g) // 4 for g in got)]).astype(np.int32)
            ids = pa.array(np.frombuffer(b"".join(got), np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), ids)], [key, "ids"])

    kind = dict(src.dtypes)[key]
    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(key, text) of every row of df; null ids give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(Merges.read(vocabulary))
    src = df.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = _kept(Decoder, shared)
        for b in batches:
            texts = [dec.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    kind = dict(src.dtypes)[key]
    return src.mapInArrow(run, f"`{key}` {kind}, text string")
