"""Token and word counting shared by segmentation, packing and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token and word patterns (Java regex dialect).
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"
WORD_PATTERN = r"[\p{L}\p{N}]+"


def count_tokens(text: Column) -> Column:
    """Number of tokens of a text; null and empty texts have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_PATTERN)), F.lit(0))


def additive(counter) -> bool:
    """Whether texts joined by white space have as many tokens as their parts together.

    True for ``count_tokens``, whose tokens never span white space, and for counters that
    carry a true attribute ``additive``.
    """
    return getattr(counter, "additive", counter is count_tokens)


def vocabulary_counter(path: str, pattern: str):
    """A counter by the byte pairs of a vocabulary file (lines of base64 token and rank); the file is read once a worker.

    For the exact counts of an existing tokenizer; Arrow batches, so slower than the pattern.
    """

    @F.pandas_udf("int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path, pattern)
        for part in parts:
            yield part.map(lambda t: len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0).astype("int32")

    return of


_ENCODINGS: dict = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _ENCODINGS:
        import base64

        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        _ENCODINGS[path, pattern] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path, pattern]


def tokens(text: Column) -> Column:
    """The tokens of a text in order."""
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0))
