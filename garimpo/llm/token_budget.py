"""Token totals per source and language under an existing byte-level BPE vocabulary.

Texts are cut into pieces by the tokenizer's own pattern.  Per Arrow batch the distinct
pieces are stored once as arrays of symbols; adjacent symbols are joined with the table
of merge ranks, in every piece the pair of lowest rank is merged, and this is repeated
until no pair has a rank.  Long pieces (digit strings of tens of thousands) are merged one
rank at a time instead.  From the same stored pieces come the tokens of the project's own
pattern: those of each piece, less one where a token runs on from one piece into the next.
A text's counts are the sums over its pieces.

The merge table is bounded by the vocabulary (some 250,000 pairs for 50,000 symbols)
and is the only thing that is broadcast.  Pieces recur, so a worker remembers those it has
met.  Texts aren't shuffled (but for an input of fewer partitions than cores, which is spread): each row is counted where it is read, repeated deliveries
are put together by their counts, and totals leave each partition already summed.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.splitting import LETTER, OTHER, char_classes, code_points, token_starts
from garimpo.plans.tables import spread

#: Fixed value: the pre-split pattern of the public byte-level vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
MEMO = 500_000
#: Bytes from which a piece is merged rank by rank.
LONG = 96

def merge_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte -> symbol, sorted pair keys, merged symbol of each pair); a symbol's number is its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    symbols = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
    keys, merged = [], []
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                merged.append(rank)
    order = np.argsort(keys)
    return symbols, np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]


def symbol_counts(pieces: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Symbols left of each piece when no adjacent pair has a rank any more."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    result = np.empty(len(pieces), np.int64)
    for which, merge in ((sizes <= LONG, by_piece), (sizes > LONG, by_rank)):
        at = np.flatnonzero(which)
        if len(at):
            result[at] = merge([pieces[i] for i in at], table)
    return result


def by_rank(pieces: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For long pieces: one rank at a time over all of them, as linked symbols; only the neighbours of a merge are joined again."""
    symbols, keys, merged = table
    size = np.array([len(p) for p in pieces], np.int64)
    # one empty symbol (-1) after each piece keeps the pieces apart
    s = np.full(size.sum() + len(pieces) + 1, -1, np.int64)
    begin = np.cumsum(size + 1) - size
    inside = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    s[inside] = symbols[np.frombuffer(b"".join(pieces), np.uint8)]
    after, before = np.minimum(np.arange(len(s)) + 1, len(s) - 1), np.maximum(np.arange(len(s)) - 1, 0)
    none = np.int64(1) << 40

    def ranks(at: np.ndarray) -> np.ndarray:
        a, b = s[at], s[after[at]]
        pair = a << 32 | b
        found = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        return np.where((a >= 0) & (b >= 0) & (keys[found] == pair), merged[found], none)

    waiting: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        r = ranks(at)
        at, r = at[r < none], r[r < none]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(r)) + 1) if len(r) else ():
            rank = int(r[part[0]])
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(heap, rank)
            waiting[rank].append(at[part])

    add(inside)
    while heap:
        rank = heapq.heappop(heap)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[ranks(at) == rank]
        if not len(at):
            continue
        # of pairs that overlap the left one is merged
        chained = np.concatenate(([False], after[at[:-1]] == at[1:]))
        start = np.maximum.accumulate(np.where(chained, -1, np.arange(len(at))))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        gone = after[at]
        s[at], s[gone] = rank, -1
        after[at] = after[gone]
        before[after[gone]] = at
        add(np.unique(np.concatenate((at, before[at]))))
    piece = np.repeat(np.arange(len(pieces)), size)
    return np.bincount(piece[s[inside] >= 0], minlength=len(pieces))


def by_piece(pieces: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For short pieces: in every piece at once, the lowest-ranked pair."""
    symbols, keys, merged = table
    result = np.array([len(p) for p in pieces], np.int64)
    s = symbols[np.frombuffer(b"".join(pieces), np.uint8)]
    piece = np.repeat(np.arange(len(pieces)), result)
    none = np.int64(1) << 40
    while len(s) > 1:
        pair = s[:-1] << 32 | s[1:]
        at = np.minimum(np.searchsorted(keys, pair), len(keys) - 1)
        rank = np.where((keys[at] == pair) & (piece[1:] == piece[:-1]), merged[at], none)
        start = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
        lowest = np.minimum.reduceat(np.append(rank, none), start)
        # reduceat's last column of a piece belongs to the pair with the next piece, which has no rank
        live = lowest < none
        size = np.diff(np.append(start, len(s)))
        position = np.arange(len(s)) - np.repeat(start, size)
        here = np.append(rank, none) == np.repeat(np.where(live, lowest, -1), size)
        first = np.full(len(start), np.iinfo(np.int64).max)
        owner = np.repeat(np.arange(len(start)), size)
        np.minimum.at(first, owner[here], position[here])
        left = start[live] + first[live]
        s = s.copy()
        s[left] = lowest[live]
        result[piece[left]] -= 1
        keep = np.repeat(live, size)
        keep[left + 1] = False
        s, piece = s[keep], piece[keep]
    return result


class Pieces:
    """The distinct pieces met: symbols and pattern tokens of each, and how its first and last token may run on."""

    def __init__(self, table):
        self.table, self.classes = table, char_classes()
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.facts = np.empty((4, 1024), np.int64)

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.number]
        if len(self.number) + len(new) > MEMO:
            self.clear()
            new = list(pieces)
        if not new:
            return
        known = len(self.number)
        self.number.update(zip(new, range(known, known + len(new))))
        if known + len(new) > self.facts.shape[1]:
            self.facts = np.concatenate((self.facts, np.empty((4, known + 2 * len(new)), np.int64)), axis=1)
        # a blank after each piece keeps its tokens apart
        points = code_points(" ".join(new) + " ")
        kind = self.classes[points]
        size = np.fromiter(map(len, new), np.int64, len(new))
        start = np.cumsum(size + 1) - size - 1
        begins = np.zeros(len(kind) + 1, np.int64)
        begins[token_starts(kind) + 1] = 1
        before = np.cumsum(begins)
        self.facts[:, known : known + len(new)] = (
            symbol_counts([p.encode("utf-8", "replace") for p in new], self.table), before[start + size] - before[start], kind[start], kind[start + size - 1],
        )

    def counts(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, pattern tokens) of texts given by their pieces."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        ids = np.fromiter((self.number[p] for t in texts for p in t), np.int64, int(size.sum()))
        symbols, tokens, first, last = self.facts[:, ids]
        # a token of letters or signs runs on into the next piece (a run of digits is always one piece)
        on = np.zeros(len(ids), np.int64)
        on[1:] = (first[1:] == last[:-1]) & ((first[1:] == LETTER) | (first[1:] == OTHER))
        begin = np.cumsum(size) - size
        on[begin[size > 0]] = 0
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[np.concatenate((begin, [len(ids)]))])
        return total(symbols), total(tokens - on)


@lru_cache(1)
def worker_pieces(path: str) -> list:
    """Place for the pieces that this worker has met, kept over its tasks."""
    return []


def count(table, path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PIECES).findall
        held = worker_pieces(path)
        if not held:
            held.append(Pieces(table.value))
        pieces: Pieces = held[0]
        for rows in batches:
            for s in range(0, rows.num_rows, 1000):
                part = rows.slice(s, 1000)
                cut = [split(t) if t else [] for t in part.column(1).to_pylist()]
                pieces.learn({p for c in cut for p in c})
                symbols, tokens = pieces.counts(cut)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.array(symbols), *part.columns[2:]], names=["key", "tokens", "bpe_tokens", *part.schema.names[2:]])

    return of


def token_counts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, tokens, bpe_tokens, *keep)`` of every distinct key: tokens by the project's pattern and by the vocabulary.

    Null and empty texts have 0 of both; null keys are left out.  Of repeated keys the
    largest value of each column counts.
    """
    table = df.sparkSession.sparkContext.broadcast(merge_table(vocabulary))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    ddl = ", ".join(["key string, tokens long, bpe_tokens long", *(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))])
    counted = spread(rows).mapInArrow(count(table, vocabulary), ddl)
    each = counted.groupBy("key").agg(*(F.max(c).alias(c) for c in counted.columns if c != "key"))
    return each.select(F.col("key").alias(key), "tokens", "bpe_tokens", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)))


def unsound(stored, tokens, tolerance: float = 0.2):
    """Whether a stored count can't be used for a text of ``tokens`` tokens."""
    return stored.isNull() | (stored <= 0) | (F.abs(stored - tokens) > tolerance * tokens)


def budget(df: DataFrame, key: str, text: str, stored: str, by: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """Totals per combination of ``by``: texts, sound tokens, tokens by the vocabulary, and repaired counts."""
    rows = token_counts(df, key, text, vocabulary, (stored, *by)).withColumnRenamed(stored, "stored")
    bad = unsound(F.col("stored"), F.col("tokens")) & (F.col("tokens") > 0)
    sound = F.when(bad, F.col("tokens")).when(F.col("tokens") == 0, F.lit(0)).otherwise(F.col("stored"))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum(sound.cast("long")).alias("tokens"), F.sum(F.col("bpe_tokens").cast("long")).alias("bpe_tokens"),
        F.count_if(bad).alias("repaired"),
    )
