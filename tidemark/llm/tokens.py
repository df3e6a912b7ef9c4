"""Token counts with a whole-token shortcut.

The SentencePiece model escapes blanks to U+2581 and merges pairs of pieces. No piece has that
mark after another character, and none contains a line feed, so no merge crosses a place where a
blank follows a character or a place beside a line feed: a text splits there into pre-tokens that
merge independently. ``Counter32k`` proves this over the vocabulary when it is built, and also finds
the vocabulary strings that encode alone as one token; those count 1 without merging. Any other
pre-token goes to the library once and is remembered.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts

MARK = "▁"
REMEMBERED = 300_000
_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")


class TokenCounter:
    """Counts tokens of whole texts exactly as the library does without added tokens."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [(i, self.library.id_to_piece(i)) for i in range(self.library.get_piece_size())]
        plain = [(i, p) for i, p in pieces if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i))]
        if any(MARK in p.lstrip(MARK) or "\n" in p for _, p in plain):
            raise ValueError("a piece crosses pre-token borders; texts of this model cannot be split")
        head = self.library.encode("\n")
        if self.library.encode("") or len(head) != 2:
            raise ValueError("the model does not put one mark before a text")
        self.whole: dict[str, int] = {}
        for i, p in plain:
            if p[0] == MARK and p != MARK and self.library.encode(p[1:].replace(MARK, " ")) == [i]:
                self.whole[p] = 1
            elif p[0] != MARK and self.library.encode("\n" + p) == [*head, i]:
                self.whole[p] = 1
        self.whole[MARK] = 1
        self.known = _Known(self)

    def merged(self, segment: str) -> int:
        """Tokens of one pre-token by the library's own merges."""
        if segment[0] == MARK:
            return len(self.library.encode(segment[1:].replace(MARK, " ")))
        return len(self.library.encode("\n" + segment)) - 2

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(self.known) > REMEMBERED:
            self.known = _Known(self)
        segments = _SEGMENT.findall(MARK + text.replace(" ", MARK))
        return sum(map(self.known.__getitem__, segments)) + text.count("\n")


class _Known(dict):
    """Pre-token to its number of tokens; unknown ones are merged once."""

    def __init__(self, counter: TokenCounter):
        super().__init__(counter.whole)
        self.counter = counter

    def __missing__(self, segment: str) -> int:
        n = self[segment] = self.counter.merged(segment)
        return n


@lru_cache(maxsize=2)
def _counter(model_file: str) -> TokenCounter:
    return TokenCounter(model_file)


def token_count(text: Column, model_file: str) -> Column:
    """Number of tokens of each text as a long; null and empty texts have 0."""

    @F.pandas_udf("long")
    def counts(column: pd.Series) -> pd.Series:
        counter = _counter(model_file)
        return pd.Series([counter.count(t) for t in texts(column)], dtype="int64")

    return counts(text)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit for every row.

    Null texts count as empty: 0 bytes, 0 tokens, not over the limit. Null ids, repeated rows and
    very long texts keep one result row each; an empty table gives an empty result. Other columns
    are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), model_file).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
