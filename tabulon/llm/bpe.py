"""Byte-level BPE by tree reduction (operator 2).

Token sequences form a monoid: the halves of a byte string are encoded on their own and joined.  A join
re-encodes a window around the seam and widens it until the tokens outside cannot change.  The test for
that is local: a sequence of tokens is the encoding of its bytes exactly if every neighbouring pair is the
encoding of its own bytes, so it is enough that the two pairs at the window's ends are.  Long texts are cut
and joined the same way on the level of pattern matches, where a match is final once it ends (with the
pattern's look-ahead) inside the known text.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Generations, worker_state

#: Longest string of bytes that is merged directly; longer ones are halved.
LEAF_BYTES = 4
#: Longest text that is matched in one go; longer ones are halved.
LEAF_CHARS = 16384
#: The pattern looks at most this far beyond a match's start, or one character beyond its run.
LOOK_AHEAD = 3
#: Pieces remembered by a worker, a third as many halves, pairs and windows; a window above so many bytes isn't.
MEMO = 300_000
MEMO_WINDOW = 24
#: Rows of a batch that are held as Python objects at once.
SLICE = 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a rank file (base64 token, rank; one to a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Letters, and all characters, of plain texts; for these ``PLAIN_PATTERN`` matches as ``BYTE_PATTERN`` does (a fixed
#: value) on the faster engine.  No letter follows the apostrophe of a contraction's alternative, so their order is free.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PLAIN_LETTERS, PLAIN_SPACE = "A-Za-zÀ-ÖØ-öø-ÿ", r" \t\n\r\f\v"
PLAIN_TEXT = re.compile("[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]*").fullmatch
PLAIN_PATTERN = (rf" ?[{PLAIN_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{PLAIN_SPACE}{PLAIN_LETTERS}0-9]+"
                 rf"|[{PLAIN_SPACE}]+(?![^{PLAIN_SPACE}])|[{PLAIN_SPACE}]+")


def matcher(pattern: str):
    """Function from a text to its pattern matches."""
    import regex

    full = regex.compile(pattern).findall
    if pattern != BYTE_PATTERN:
        return full
    plain = re.compile(PLAIN_PATTERN).findall
    return lambda text: plain(text) if PLAIN_TEXT(text) else full(text)


class TreeBPE:
    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        self.ranks, self.token, self.matches = ranks, token_table(ranks), matcher(pattern)
        self.pieces = Generations(lambda p: tuple(self.encode_bytes(p.encode("utf-8", "surrogatepass"))), memo)
        self.halves = Generations(self._split, memo // 3)
        self.pairs = Generations(self._pair, memo // 3)
        self.windows = Generations(self.merge_bytes, memo // 3)

    def merge(self, b: bytes) -> list[int]:
        return self.windows[b] if len(b) <= MEMO_WINDOW else self.merge_bytes(b)

    def merge_bytes(self, b: bytes) -> list[int]:
        """Merge neighbours by lowest rank, leftmost first, with a heap of candidate pairs."""
        ranks = self.ranks
        n = len(b)
        if n <= 2:
            return [ranks[b]] if b in ranks else [ranks[b[i:i + 1]] for i in range(n)]
        part = [b[i:i + 1] for i in range(n)]
        if n <= 24:
            while len(part) > 1:
                best, at = None, -1
                for i in range(len(part) - 1):
                    r = ranks.get(part[i] + part[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if best is None:
                    break
                part[at:at + 2] = [part[at] + part[at + 1]]
            return [ranks[p] for p in part]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = b""
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    both = part[a] + part[after[a]]
                    if (r := ranks.get(both)) is not None:
                        heapq.heappush(heap, (r, a, len(both)))
        return [ranks[p] for p in part if p]

    def _pair(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.token[pair[0]] + self.token[pair[1]]) == list(pair)

    def _split(self, b: bytes) -> list[int]:
        if len(b) <= LEAF_BYTES:
            return self.merge(b)
        mid = len(b) // 2
        return self.join(self.halves[b[:mid]], self.halves[b[mid:]])

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of what ``left`` and ``right`` encode."""
        if not left or not right:
            return left + right
        token, pairs = self.token, self.pairs
        if pairs[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            window = self.merge(b"".join([token[t] for t in left[-i:]] + [token[t] for t in right[:j]]))
            firm_left = i >= len(left) or pairs[left[-i - 1], window[0]]
            firm_right = j >= len(right) or pairs[window[-1], right[j]]
            if firm_left and firm_right:
                return left[:max(0, len(left) - i)] + window + right[j:]
            i, j = (i if firm_left else 2 * i), (j if firm_right else 2 * j)

    def encode_bytes(self, b: bytes) -> list[int]:
        """Ids of one pattern match; a match that is a token stays whole."""
        r = self.ranks.get(b)
        return [r] if r is not None else self._split(b) if b else []

    def split(self, text: str) -> list[str]:
        """Pattern matches of a text, halved and joined above ``LEAF_CHARS``."""
        if len(text) <= LEAF_CHARS:
            return self.matches(text)
        mid = len(text) // 2
        return self.join_matches(self.split(text[:mid]), self.split(text[mid:]))

    def join_matches(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left + right
        i, width = 0, 0
        while i < len(left) and (width < LOOK_AHEAD or i < 1):
            i += 1
            width += len(left[-i])
        head = "".join(left[-i:])
        j = 8
        while True:
            tail = right[:j]
            ends, at = {}, 0
            for k, p in enumerate(tail):
                at += len(p)
                ends[at] = k + 1
            redone, out, known = self.matches(head + "".join(tail)), [], len(head) + at
            at = 0
            for p in redone:
                out.append(p)
                at += len(p)
                k = ends.get(at - len(head))
                if k is not None and (at + LOOK_AHEAD < known or k == len(right)):
                    return left[:-i] + out + right[k:]
            j *= 2

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))


def token_table(ranks: dict[bytes, int]) -> list[bytes]:
    """Bytes of each id."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for b, r in ranks.items():
        out[r] = b
    return out


def decode_ids(ids: list[int], token: list[bytes]) -> bytes:
    """Concatenate up the tree: bytes of the halves, joined."""
    if len(ids) <= 1 << 16:
        return b"".join(map(token.__getitem__, ids))
    mid = len(ids) // 2
    return decode_ids(ids[:mid], token) + decode_ids(ids[mid:], token)


def _codec(ranks_path: str, pattern: str) -> TreeBPE:
    state = worker_state("bpe")
    if (ranks_path, pattern) not in state:
        state[ranks_path, pattern] = TreeBPE(read_ranks(ranks_path), pattern)
    return state[ranks_path, pattern]


def _sliced(batch: pa.Array, work) -> pa.Array:
    """``work`` on a few hundred rows at a time, as a batch's Python objects take far more room than its arrays."""
    return pa.concat_arrays([work(batch.slice(i, SLICE)) for i in range(0, max(1, len(batch)), SLICE)])


def encode_column(text: Column, ranks_path: str, pattern: str, decoded: bool = False) -> Column:
    """Ids of each whole text (``array<int>``); null and empty texts give an empty array.  With ``decoded``, a struct of
    ``ids`` and ``decoded``, the bytes that those ids decode to, from one Python worker."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<ids:array<int>,decoded:binary>" if decoded else "array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(ranks_path, pattern)

        def work(texts: pa.Array) -> pa.Array:
            parts = [codec.encode(t) if t else [] for t in texts.to_pylist()]
            starts = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) for p in parts], out=starts[1:])
            flat = np.fromiter(chain.from_iterable(parts), np.int32, int(starts[-1]))
            out = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
            if not decoded:
                return out
            back = pa.array([decode_ids(p, codec.token) for p in parts], pa.binary())
            return pa.StructArray.from_arrays([out, back], ["ids", "decoded"])

        for batch in batches:
            yield _sliced(batch, work)

    return ids(text)


def decode_column(ids: Column, ranks_path: str) -> Column:
    """Bytes of each id array (``binary``); null gives empty bytes.  An id outside the vocabulary raises."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("binary")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = worker_state("bpe:tokens")
        if ranks_path not in state:
            state[ranks_path] = token_table(read_ranks(ranks_path))
        token = state[ranks_path]
        for batch in batches:
            yield _sliced(batch, lambda part: pa.array([decode_ids(x, token) for x in part.to_pylist()], pa.binary()))

    return text(F.coalesce(ids, F.array().cast("array<int>")))


def encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids.  Null and empty texts get no ids, repeated rows the same ids; an
    existing column ``out`` is replaced; an empty table stays empty."""
    return docs.withColumn(out, encode_column(F.col(f"`{text_col}`"), ranks_path, pattern))


def decode(docs: DataFrame, ranks_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that a column of ids stands for; an existing column ``out`` is replaced."""
    return docs.withColumn(out, decode_column(F.col(f"`{ids_col}`"), ranks_path))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``decoded`` (replaced if there): what ``encode`` and then ``decode`` give, in one pass."""
    both = docs.withColumn("_both", encode_column(F.col(f"`{text_col}`"), ranks_path, pattern, decoded=True))
    return both.withColumns({"ids": F.col("_both.ids"), "decoded": F.col("_both.decoded")}).drop("_both")
