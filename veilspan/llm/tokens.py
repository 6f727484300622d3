"""Token counts with a public byte-level BPE vocabulary.

A pretoken of the vocabulary's pattern never runs from a non-blank to a blank, so a text may be
cut there and the counts of the pieces added; counts of short pieces are remembered, which makes
repeated words cheap.  The vocabulary file is a parameter and is read where it lies.
"""

from __future__ import annotations

import base64
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
REMEMBER = 200_000  # pieces per Python worker; the memory is emptied beyond that
_BLANK = " \\t\\n\\r\\f\\v\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PIECE = re.compile(f"[{_BLANK}]*[^{_BLANK}]+|[{_BLANK}]+")
_RARE = re.compile(f"[{_BLANK[1:].replace(chr(92) + 'n', '')}]")  # blanks but space and newline


class TokenCounter:
    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        encode = self.encode

        class Memory(dict):
            def __missing__(self, piece: str) -> int:
                n = len(encode(piece))
                if len(piece) <= 64:
                    self[piece] = n
                return n

        class After(Memory):
            """Of a word that follows one blank."""

            def __missing__(self, word: str) -> int:
                n = len(encode(" " + word))
                if len(word) <= 64:
                    self[word] = n
                return n

        self.pieces, self.after = Memory(), After()

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.pieces) + len(self.after) > REMEMBER:
            self.pieces.clear()
            self.after.clear()
        words = text.split(" ")
        # one blank between two words; else a run of blanks may be cut in the wrong place
        if "" in words or "\n \n" in text or text[-2:] == "\n " or _RARE.search(text):
            return sum(map(self.pieces.__getitem__, _PIECE.findall(text)))
        return self.pieces[words[0]] + sum(map(self.after.__getitem__, words[1:]))


_counters: dict[str, TokenCounter] = {}


def counter(vocabulary: str = VOCABULARY) -> TokenCounter:
    """One per Python worker and vocabulary."""
    if vocabulary not in _counters:
        _counters[vocabulary] = TokenCounter(vocabulary)
    return _counters[vocabulary]


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text as BIGINT; null and empty texts have 0."""

    @F.pandas_udf(LongType())
    def tokens(s: pd.Series) -> pd.Series:
        count = counter(vocabulary).count
        return pd.Series([count(t) for t in s], dtype="int64")

    return tokens(text)
