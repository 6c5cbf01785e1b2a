"""Byte-level BPE by longest match and backtracking.

A piece's bytes are read as Latin-1, so an Aho-Corasick automaton over the vocabulary finds all tokens
that occur in it. From the left, the longest token that is compatible with its predecessor is taken; where
none is, the last one is given up for a shorter one. Two tokens are compatible if merging their joined
bytes from scratch keeps the border between them; this is decided by undoing merges and is memoised. Each
end position is given up at most once, so the time is linear in the piece.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyspan.llm.common import map_rows

#: Distinct pieces that one worker remembers before it starts over.
CACHE_PIECES = 250_000


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merge_below(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """Plain lowest-rank-first merging with the ranks under ``limit``; for single tokens only."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if best >= limit:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(maxsize=4)
def split_table(path: str) -> dict[int, tuple[int, int]]:
    """For each token the two tokens whose merge makes it; single bytes give themselves; unreachable ones are left out."""
    ranks = read_ranks(path)
    out = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            out[rank] = (rank, rank)
        else:
            parts = _merge_below(token, ranks, rank)
            if len(parts) == 2:
                out[rank] = (ranks[parts[0]], ranks[parts[1]])
    return out


class _Remembered(dict):
    """Values of ``make`` by key, kept until there are ``most()``; then it starts over."""

    def __init__(self, make: Callable, most: Callable[[], int]):
        self.make, self.most = make, most

    def __missing__(self, key):
        got = self.make(key)
        if len(self) >= self.most():
            self.clear()
        self[key] = got
        return got


class _Pieces(_Remembered):
    """Long pieces are not kept."""

    def __missing__(self, key):
        return super().__missing__(key) if len(key) <= 64 else self.make(key)


class Codec:
    """Encoder and decoder for one vocabulary; ``ranks`` and ``splits`` come from read_ranks and split_table."""

    def __init__(self, ranks: dict[bytes, int], splits: dict[int, tuple[int, int]], pattern: str):
        import ahocorasick
        import regex

        self.ranks, self.splits = ranks, splits
        self.token = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            if r in splits:
                self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.compatible = _Remembered(lambda pair: self._border_stays(*pair), lambda: 400_000)
        self.shorter = _Remembered(self._shorter, lambda: len(ranks) + 1)
        self.seen = _Pieces(self._digest_parts, lambda: CACHE_PIECES)

    def _shorter(self, token: int) -> int:
        """The longest other token that starts this one, or -1."""
        b = self.token[token]
        for n in range(len(b) - 1, 0, -1):
            r = self.ranks.get(b[:n], -1)
            if r in self.splits:
                return r
        return -1

    def _border_stays(self, a: int, b: int) -> bool:
        # Undo merges on both sides of the border, latest first. If the parts that then touch merge
        # earlier than what is undone next, the border would have gone before.
        token, ranks, splits = self.token, self.ranks, self.splits
        before = len(token) + 1
        while True:
            merged = ranks.get(token[a] + token[b])
            if merged is not None and merged < before:
                return False
            whole_a, whole_b = splits[a][0] == a, splits[b][0] == b
            if whole_a and whole_b:
                return True
            # On equal footing the left one of two merges of the same rank happens first.
            if not whole_a and (whole_b or a > b):
                before, a = a, splits[a][1]
            else:
                before, b = b + 1, splits[b][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, compatible, shorter, find = self.size, self.compatible, self.shorter, self.automaton.iter_long
        latin = piece.decode("latin-1")
        # The longest tokens one after another; where these are compatible, as in half of all words, they are the result.
        ids = [r for _, r in find(latin)]
        if all(map(compatible.__getitem__, zip(ids, ids[1:], strict=False))):
            return ids
        longest, at = {}, 0
        for r in ids:
            longest[at] = r
            at += size[r]
        closed = bytearray(len(piece) + 1)
        ids = []
        pos, t, last = 0, longest[0], -1
        while True:
            end = pos + size[t]
            if not closed[end] and (last < 0 or compatible[last, t]):
                ids.append(t)
                pos, last = end, t
                if pos == len(piece):
                    return ids
                t = longest.get(pos, -1)
                if t < 0:
                    t = longest[pos] = next(find(latin, pos))[1]
                continue
            t = shorter[t]
            if t < 0:
                closed[pos] = 1
                t = ids.pop()
                pos -= size[t]
                last = ids[-1] if ids else -1

    def encode(self, text: str) -> list[int]:
        return [i for p in self.find(text) for i in self.encode_piece(p.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def of(self, piece: str) -> tuple[str, int, bytes]:
        """The piece's ids as text, their count and what they decode to."""
        return self.seen[piece]

    def _digest_parts(self, piece: str) -> tuple[str, int, bytes]:
        ids = self.encode_piece(piece.encode())
        return ",".join(map(str, ids)), len(ids), self.decode(ids)


def encode_digests(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus n_tokens, ids_sha256 and decoded_sha256 of every whole text.

    A null text is encoded as the empty one: no tokens, digests of nothing. Rows are independent, so repeated
    rows and repeated or null ids give a row each. The vocabulary is read on the driver and broadcast;
    its size is fixed by the file. A text is held whole with its pieces; a very long piece takes time in proportion. Only
    ``keep`` and the text are read, so other columns may have any name.
    """
    codec_of = _share(docs, path, pattern)
    out = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        codec = codec_of()

        def run(texts):
            n, ids, back = [], [], []
            of, find = codec.seen.__getitem__, codec.find
            for t in texts:
                got = list(map(of, find(t or "")))
                shown, counts, data = zip(*got, strict=True) if got else ((), (), ())
                n.append(sum(counts))
                ids.append(hashlib.sha256(",".join(shown).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(data)).hexdigest())
            return n, ids, back

        return run

    return map_rows(docs, keep, [text], out, make)


def encode_column(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` plus ids array<int>: the operator's plain output, which ``decode_column`` turns back."""
    codec_of = _share(docs, path, pattern)
    out = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return map_rows(docs, keep, [text], out, lambda: (lambda c: lambda texts: [[c.encode(t or "") for t in texts]])(codec_of()))


def decode_column(encoded: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` plus decoded binary; null ids decode to nothing."""
    codec_of = _share(encoded, path, pattern)
    out = T.StructType([T.StructField("decoded", T.BinaryType())])
    return map_rows(encoded, keep, [ids], out, lambda: (lambda c: lambda rows: [[c.decode(r or []) for r in rows]])(codec_of()))


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(key: tuple[str, str], shared) -> Codec:
    """One codec for each vocabulary and worker process, so that its cache outlives a task."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value, key[1])
    return _CODECS[key]


def _share(df: DataFrame, path: str, pattern: str):
    """A function that gives the codec in a worker; the tables go out once by broadcast."""
    shared = df.sparkSession.sparkContext.broadcast((read_ranks(path), split_table(path)))
    return lambda: _codec((path, pattern), shared)
