"""Byte-pair encoding in linear time, over a vocabulary given as a file of ranks.

A text is cut into pieces by the vocabulary's pattern.  The encoding of a piece is the only
sequence of tokens in which every two neighbours are what merging would leave apart, so it is
found without merging: take the longest token that fits at each place, and step back to a
shorter one where it does not agree with its left neighbour.  Whether two tokens agree is
remembered.  Tokens at a place come from an Aho-Corasick automaton over bytes read as Latin-1.
"""

from __future__ import annotations

import base64

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "byte_bpe_50k"
MEMO_PIECES = 200_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Path of a public vocabulary's rank file; pass a path of your own instead where it lies elsewhere."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


def vocabulary_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PieceEncoder:
    """Encodes texts by the ranks in ``path`` and the piece pattern ``pattern``."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                token, _, rank = line.partition(b" ")
                if rank:
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.agree: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The defining procedure, for two tokens at a time: merge the neighbours of lowest rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            options = [(self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            rank, i = min(options)
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def agrees(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves just these two."""
        known = self.agree.get((left, right))
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            if len(self.agree) > 4_000_000:
                self.agree.clear()
            self.agree[(left, right)] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Tokens of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        # the tokens that start at each place, shortest first
        fits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            fits[end - length + 1].append((length, rank))
        at, tokens = 0, []
        options = [len(fits[0])]  # how many of the tokens at each token's place are still to try
        dead = bytearray(n + 1)  # places from which the rest cannot be encoded by any agreeing sequence to the left
        starts = [0]
        while at < n:
            place, found = starts[-1], False
            k = options[-1]
            while k:
                k -= 1
                length, rank = fits[place][k]
                if dead[place + length] or (tokens and not self.agrees(tokens[-1], rank)):
                    continue
                found = True
                break
            options[-1] = k
            if found:
                tokens.append(rank)
                at = place + length
                starts.append(at)
                options.append(len(fits[at]) if at < n else 0)
            else:
                # a place is reached by one agreeing sequence only, so it need not be tried again
                dead[place] = 1
                starts.pop()
                options.pop()
                tokens.pop()
                at = starts[-1]
        return tokens

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text; none for null and the empty text."""
        if not text:
            return []
        out: list[int] = []
        memo = self.memo
        for p in self.pieces(text):
            got = memo.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8", "replace"))
                if len(p) <= 64:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[p] = got
            out += got
        return out


def _encoder(path: str, pattern: str) -> PieceEncoder:
    """One encoder for each worker process and vocabulary, kept between tasks."""
    import builtins

    kept = builtins.__dict__.setdefault("_lodevec_encoders", {})
    if (path, pattern) not in kept:
        kept[path, pattern] = PieceEncoder(path, pattern)
    return kept[path, pattern]


def encode_column(path: str | None = None, pattern: str | None = None):
    """A vectorised function text -> array<int> by a vocabulary file that all executors can read."""
    path, pattern = path or vocabulary_path(), pattern or vocabulary_pattern()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encoder = _encoder(path, pattern)
        return pd.Series([encoder.encode(t) for t in texts])

    return ids


def count_column(path: str | None = None, pattern: str | None = None):
    """A vectorised function text -> number of tokens."""
    path, pattern = path or vocabulary_path(), pattern or vocabulary_pattern()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encoder = _encoder(path, pattern)
        return pd.Series([len(encoder.encode(t)) for t in texts], dtype="int64")

    return count


def encode_corpus(documents: DataFrame, text: str = "text", into: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``documents`` with the token ids of ``text``: all of it, without special tokens.

    Strings that look like special tokens are ordinary text; null and empty texts give an empty list; a
    lone surrogate counts as ``?``.  Rows are encoded where they lie: there is no shuffle.
    """
    path, pattern = path or vocabulary_path(), pattern or vocabulary_pattern()
    return documents.withColumn(into, encode_column(path, pattern)(F.col(text)))


__all__ = ["PieceEncoder", "count_column", "encode_column", "encode_corpus"]
