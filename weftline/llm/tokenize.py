"""Byte-level BPE over whole corpora by backtracking from longest matches.

A text's pre-tokens are cut by the tokenizer's published pattern; each is mapped byte for byte to
Latin-1 so that an Aho-Corasick automaton over the vocabulary finds the longest token at a position.
Tokens are laid from the left; a token may follow another only if the merge order would never have
crossed their border (a memoised test on the two), else the next shorter token is tried, and when
none is left the last token is taken back and its end marked as a dead end. Each byte position is
marked at most once, so the work is linear in the text. The ids equal those of the merge loop.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the public pattern that cuts a text into pre-tokens before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The memo of pre-tokens is emptied beyond this many entries; it never changes a result.
MEMO_ENTRIES = 300_000
#: A rank file above this many bytes isn't shipped to the executors.
MAX_RANK_BYTES = 64 << 20


class BacktrackingBpe:
    """Encoder of one vocabulary given as {token bytes: rank}."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.ranks = {k.decode("latin-1"): v for k, v in ranks.items()}
        self.names = {v: k for k, v in self.ranks.items()}
        self.size = {v: len(k) for k, v in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for name, rank in self.ranks.items():
            self.automaton.add_word(name, rank)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}
        self._split_vocabulary()

    def _split_vocabulary(self) -> None:
        """For each token its longest proper prefix in the vocabulary, and the two tokens whose merge made it."""
        ranks = self.ranks
        for name, rank in sorted(ranks.items(), key=lambda x: x[1]):
            prefixes = [name[:i] for i in range(len(name) - 1, 0, -1) if name[:i] in ranks]
            self.shorter[rank] = ranks[prefixes[0]] if prefixes else -1
            self.parts[rank] = (rank, rank)
            for left in prefixes:
                a, b = ranks[left], ranks.get(name[len(left) :])
                if b is not None and a < rank and b < rank and self._fits(a, b, rank):
                    self.parts[rank] = (a, b)
                    break

    def _fits(self, left: int, right: int, below: int) -> bool:
        """Whether merges of rank under `below` keep the border between two tokens.

        Walks back through both tokens' merges, latest first, looking for a pair across the border
        that would have been merged before one of the two was complete.
        """
        names, ranks, parts = self.names, self.ranks, self.parts
        while True:
            joined = ranks.get(names[left] + names[right])
            if joined is not None and joined < below:
                return False
            if left > right:
                if (inner := parts[left][1]) != left:
                    below, left = left, inner
                elif (inner := parts[right][0]) != right:
                    below, right = right + 1, inner
                else:
                    return True
            elif (inner := parts[right][0]) != right:
                below, right = right + 1, inner
            elif (inner := parts[left][1]) != left:
                below, left = left, inner
            else:
                return True

    def _may_follow(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 4 * MEMO_ENTRIES:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right, 1 << 62)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as Latin-1 text of its bytes."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end, longest = len(piece), self.automaton.iter_long
        dead, out, at = bytearray(end + 1), [], 0
        token = next(longest(piece, 0))[1]
        while at < end:
            last = out[-1] if out else None
            while token >= 0:
                to = at + self.size[token]
                if not dead[to] and (last is None or self._may_follow(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = to
                if at < end:
                    token = next(longest(piece, at))[1]
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.size[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; [] for an empty text and for null. Lone surrogates count as U+FFFD."""
        if not text:
            return []
        memo, out = self.memo, []
        for piece in self.cut(text):
            ids = memo.get(piece)
            if ids is None:
                try:
                    raw = piece.encode()
                except UnicodeEncodeError:
                    raw = piece.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode()
                ids = self.encode_piece(raw.decode("latin-1"))
                if len(piece) <= 64:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in raw.splitlines() if x.strip())}


_built: dict[str, BacktrackingBpe] = {}


def encoder(raw: bytes) -> BacktrackingBpe:
    """The encoder of a rank file, built once in a process."""
    key = hashlib.sha1(raw).hexdigest()
    if key not in _built:
        _built[key] = BacktrackingBpe(read_ranks(raw))
    return _built[key]


def _ranks(df: DataFrame, path: str):
    with open(path.removeprefix("file://"), "rb") as f:
        raw = f.read(MAX_RANK_BYTES + 1)
    if len(raw) > MAX_RANK_BYTES:
        raise ValueError("the rank file is larger than MAX_RANK_BYTES")
    return df.sparkSession.sparkContext.broadcast(raw)


def token_ids(df: DataFrame, text: str | Column = "text", path: str = DEFAULT_RANKS) -> Column:
    """Column of a text's token ids, array<bigint>; an empty array for empty and null texts."""
    shared = _ranks(df, path)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(shared.value).encode
        for batch in batches:
            yield pd.Series([encode(x) for x in batch], dtype=object)

    return ids(text)


def token_count(df: DataFrame, text: str | Column = "text", path: str = DEFAULT_RANKS) -> Column:
    """Column of a text's number of tokens; 0 for empty and null texts."""
    shared = _ranks(df, path)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(shared.value).encode
        for batch in batches:
            yield pd.Series([len(encode(x)) for x in batch], dtype="int64")

    return count(text)
