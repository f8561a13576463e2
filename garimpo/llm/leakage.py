"""Passages of held-out test items inside a training corpus.

The test items are indexed as a BM25 inverted index: per term a posting list of items
with their weights, and a shorter list of the blocks of items with the largest weight in
each (block-max).  Every passage of every document is a query.  Pairs of neighbouring words that no item has cut a
document into stretches, as no run of an item's words can cross them; stretches of
at least ``run`` words are cut into passages that overlap by ``run - 1`` words, so every
run lies whole in some passage.

The threshold loses nothing.  An item's BM25 weights don't depend on the query, so a
passage that holds ``run`` consecutive words of item i scores at least ``theta_i``, the
smallest sum of the weights of the distinct words of any such run of i.  As in block-max
WAND, a passage's terms are ordered by their largest weight; those that together stay
below the lowest threshold can't make a candidate alone, so only the lists of the others
are walked.  A block so met is opened only if its bound, the sum of its own maxima, reaches
the lowest threshold in it, and an item is a candidate if its score reaches its own.
Candidates are then verified on the words themselves.  Lists are walked for thousands of
passages at once, as arrays.

The index is cut into slices of at most ``slice_bytes``, measured, each a broadcast; a pass
over the corpus asks all slices of up to ``pass_bytes``.  Items of more than ``segment``
words are indexed in segments that overlap by ``run - 1`` words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import WORD, batch, lower, shingles
from garimpo.plans.tables import cut

K1, B = 1.2, 0.75
FOUND_SQL = "doc string, item string, run int"
FOUND = pa.schema([("doc", pa.string()), ("item", pa.string()), ("run", pa.int32())])

#: Combining marks of the Latin, Greek and Cyrillic scripts, and where others may stand.
COMMON_MARKS = re.compile("[\u0300-\u036f]+")
OTHER_MARKS = re.compile("[\u0483-\u1fff\u20d0-\u20ff\u2c00-\uffff\U00010000-\U0010ffff]")


def plain_words(text: str) -> list[str]:
    """Words after NFD and without combining marks, in lower case."""
    if not text.isascii():
        text = COMMON_MARKS.sub("", unicodedata.normalize("NFD", text))
        if OTHER_MARKS.search(text):
            text = "".join(c for c in text if unicodedata.category(c)[0] != "M")
    return WORD.findall(lower(text))


class Terms(dict):
    """Numbers of the items' words; -1 for any other word."""

    def __missing__(self, word: str) -> int:
        return -1


class Index:
    """Posting lists and block lists of the items' segments, with thresholds and the segments' words."""

    def __init__(self, items: list[tuple[str, str]], run: int, block: int = 12, segment: int = 512):
        words = [(key, plain_words(text or "")) for key, text in items]
        step = segment - run + 1
        parts = [(key, w[s : s + segment]) for key, w in words for s in range(0, max(1, len(w) - run + 1), step)]
        parts = sorted((p for p in parts if len(p[1]) >= run), key=lambda p: (len(p[1]), p[0]))
        self.run, self.block, self.keys = run, block, [key for key, _ in parts]
        self.terms = Terms()
        for _, w in parts:
            for t in w:
                self.terms.setdefault(t, len(self.terms))
        n, size = len(parts), max(1, len(self.terms))
        self.base = np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        self.words = [np.array([self.terms[t] for t in w], np.int32) for _, w in parts]
        length = np.array([len(w) for w in self.words] or [1], float)
        # posting lists: sorted by term, then segment
        pair, count = np.unique(np.concatenate([w.astype(np.int64) * max(1, n) + i for i, w in enumerate(self.words)] or [np.empty(0, np.int64)]), return_counts=True)
        term, item = pair // max(1, n), pair % max(1, n)
        known = np.bincount(term, minlength=size)
        idf = np.log(1 + (n - known + 0.5) / (known + 0.5))
        self.weight = (count * (K1 + 1) / (count + K1 * (1 - B + B * length[item] / length.mean())) * idf[term]).astype(np.float32)
        self.item = item.astype(np.int32)
        self.start = np.concatenate(([0], np.cumsum(known)))
        # block lists: the largest weight of each block
        self.blocks = max(1, -(-n // block))
        first = np.flatnonzero(np.concatenate(([True], np.diff(term * self.blocks + item // block) > 0))) if len(pair) else np.empty(0, np.int64)
        self.cell = (term * self.blocks + item // block)[first]
        self.upper = np.maximum.reduceat(self.weight, first) if len(first) else np.empty(0, np.float32)
        self.cell_start = np.append(first, len(pair))  # a cell's postings stand together
        self.block_start = np.searchsorted(self.cell, np.arange(size + 1) * self.blocks)
        self.most = np.zeros(size, np.float32)
        np.maximum.at(self.most, self.cell // self.blocks, self.upper)
        self.theta = np.full(max(1, n), np.inf, np.float32)
        for i, d in enumerate(self.words):
            windows = np.lib.stride_tricks.sliding_window_view(d, run)
            ordered = np.sort(windows, axis=1)
            distinct = np.concatenate((np.ones((len(ordered), 1), bool), np.diff(ordered, axis=1) > 0), axis=1)
            own = np.unique(d).astype(np.int64)
            w = self.weight[np.searchsorted(pair, own * n + i)]
            self.theta[i] = (w[np.searchsorted(own, ordered)] * distinct).sum(axis=1).min() * (1 - 1e-5)
        self.lowest = np.minimum.reduceat(self.theta, np.arange(0, max(1, n), block))
        self.least = float(self.theta.min())
        self.pairs = np.unique(np.concatenate([w[:-1].astype(np.int64) * size + w[1:] for w in self.words] or [np.empty(0, np.int64)]))
        self.runs: dict[int, np.ndarray] = {}

    def nbytes(self) -> int:
        arrays = (self.base, self.pairs, self.weight, self.item, self.start, self.cell, self.upper, self.cell_start, self.block_start, self.most, self.theta, *self.words)
        return sum(a.nbytes for a in arrays) + sum(len(t) + 60 for t in self.terms) + sum(len(k) + 60 for k in self.keys)

    def joined(self, at: np.ndarray) -> np.ndarray:
        """Whether some item has the words i and i + 1 of an array of term numbers (-1: a word of no item) as neighbours."""
        out = (at[:-1] >= 0) & (at[1:] >= 0)
        pair = at[:-1][out].astype(np.int64) * len(self.base) + at[1:][out]
        if len(self.pairs):
            out[out] = self.pairs[np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)] == pair
        return out

    def runs_of(self, i: int) -> np.ndarray:
        """Hashes of the runs of a segment; remembered while they are few."""
        if i not in self.runs:
            if len(self.runs) > 20_000:
                self.runs.clear()
            self.runs[i] = np.unique(shingles(self.base[self.words[i]], self.run))
        return self.runs[i]


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [begin, begin + size), one after another."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def passages(joined: np.ndarray, run: int, width: int) -> list[tuple[int, int]]:
    """[start, end) of the passages of a text, given which of its neighbouring words may stand in one run."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
    start, end = edge[::2], edge[1::2] + 1
    long = end - start >= run
    out = []
    for s, e in zip(start[long].tolist(), end[long].tolist()):
        while e - s > width:
            out.append((s, s + width))
            s += width - run + 1
        out.append((s, e))
    return out


def search(indexes: list, width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for begin in range(0, rows.num_rows, 2000):
                docs = rows.column(0).slice(begin, 2000).to_pylist()
                texts = [(i, plain_words(text)) for i, text in enumerate(rows.column(1).slice(begin, 2000).to_pylist()) if text and docs[i] is not None]
                for shared in indexes:
                    ix: Index = shared.value
                    number = ix.terms.__getitem__
                    size = np.fromiter((len(w) + 1 for _, w in texts), np.int64, len(texts))
                    at = np.fromiter((n for _, w in texts for n in (*map(number, w), -1)), np.int32, int(size.sum()))
                    found = passages(ix.joined(at), ix.run, width)
                    text = np.searchsorted(np.cumsum(size), [s for s, _ in found], "right")
                    owner, queries = [texts[t][0] for t in text], [at[s:e] for s, e in found]
                    hits = verified(ix, queries, candidates(ix, queries), owner)
                    if hits:
                        yield batch(FOUND, [docs[d] for d, _ in hits], [i for _, i in hits], [len(h) for h in hits.values()])

    return of


def verified(ix: Index, queries: list[np.ndarray], found: tuple[np.ndarray, np.ndarray], owner: list[int]) -> dict[tuple[int, str], set[int]]:
    """(document, item) -> hashes of the shared runs, of the candidates that share at least one."""
    hits: dict[tuple[int, str], set[int]] = {}
    query, item = found
    if not len(query):
        return hits
    which, place = np.unique(query, return_inverse=True)
    size = np.fromiter((len(queries[q]) for q in which), np.int64, len(which))
    h = shingles(ix.base[np.concatenate([queries[q] for q in which])], ix.run)
    end = np.cumsum(size)
    of = np.repeat(np.arange(len(which)), size)[: len(h)]
    # most candidates have no run of any candidate's item
    known = np.unique(np.concatenate([ix.runs_of(i) for i in np.unique(item).tolist()]))
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    same = np.flatnonzero((known[at] == h) & (np.arange(len(h)) + ix.run <= end[of]))
    begin = np.searchsorted(of[same], np.arange(len(which) + 1))
    for k in np.flatnonzero(np.diff(begin)[place]).tolist():
        q, i = place[k], int(item[k])
        shared = np.intersect1d(h[same[begin[q] : begin[q + 1]]], ix.runs_of(i))
        if len(shared):
            hits.setdefault((owner[query[k]], ix.keys[i]), set()).update(shared.tolist())
    return hits


def candidates(ix: Index, queries: list[np.ndarray], room: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(query, segment) whose score reaches the segment's threshold; as many queries at once as ``room`` cells of (query, block) hold."""
    none = np.empty(0, np.int64)
    if not queries or not len(ix.cell):
        return none, none
    step = max(1, room // ix.blocks)
    out = [opened(ix, queries[s : s + step], s) for s in range(0, len(queries), step)]
    return np.concatenate([q for q, _ in out]), np.concatenate([i for _, i in out])


def opened(ix: Index, queries: list[np.ndarray], number: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of some queries, the first of which has the given number."""
    size = np.fromiter(map(len, queries), np.int64, len(queries))
    terms = len(ix.most)
    pair = np.unique(np.repeat(np.arange(len(queries), dtype=np.int64) * terms, size) + np.concatenate(queries))
    query, term = pair // terms, pair % terms
    # a query's terms that together stay below the lowest threshold come first and aren't walked
    most = ix.most[term]
    order = np.lexsort((most, query))
    query, term, most = query[order], term[order], most[order]
    begin = np.searchsorted(query, np.arange(len(queries) + 1))
    total = np.concatenate(([0.0], np.cumsum(most, dtype=float)))
    walked = total[1:] - total[begin[query]] >= ix.least * (1 - 1e-6)

    def walk(some: np.ndarray, bound: np.ndarray) -> None:
        long = ix.block_start[term[some] + 1] - ix.block_start[term[some]]
        posting = spans(ix.block_start[term[some]], long)
        bound += np.bincount(np.repeat(query[some] * ix.blocks, long) + ix.cell[posting] % ix.blocks, ix.upper[posting], len(bound))

    bound = np.zeros(len(queries) * ix.blocks)
    walk(np.flatnonzero(walked), bound)
    rest = np.flatnonzero(~walked)
    others = np.bincount(query[rest], most[rest], len(queries))
    met = np.flatnonzero((bound > 0) & (bound + np.repeat(others, ix.blocks) >= np.tile(ix.lowest, len(queries)) * (1 - 1e-6)))
    first = np.searchsorted(query[rest], np.arange(len(queries) + 1))
    looked_up = np.diff(first)[met // ix.blocks].sum()
    if (ix.block_start[term[rest] + 1] - ix.block_start[term[rest]]).sum() <= 8 * looked_up:
        walk(rest, bound)  # shorter than looking the met blocks up
        exact = bound[met]
    else:
        who = met // ix.blocks
        which = np.repeat(np.arange(len(met)), np.diff(first)[who])
        cell = term[rest[spans(first[who], np.diff(first)[who])]] * ix.blocks + met[which] % ix.blocks
        place = np.minimum(np.searchsorted(ix.cell, cell), len(ix.cell) - 1)
        exact = bound[met] + np.bincount(which, np.where(ix.cell[place] == cell, ix.upper[place], 0), len(met))
    met = met[exact >= ix.lowest[met % ix.blocks] * (1 - 1e-6)]
    # the postings of every term inside the opened blocks
    who, block = met // ix.blocks, met % ix.blocks
    size = (begin[1:] - begin[:-1])[who]
    which = np.repeat(np.arange(len(met)), size)
    cell = term[spans(begin[who], size)] * ix.blocks + block[which]
    place = np.searchsorted(ix.cell, cell)
    there = ix.cell[np.minimum(place, len(ix.cell) - 1)] == cell
    place, which = place[there], which[there]
    size = ix.cell_start[place + 1] - ix.cell_start[place]
    posting = spans(ix.cell_start[place], size)
    cell = np.repeat((which - block[which]) * ix.block, size) + ix.item[posting]
    score = np.bincount(cell, ix.weight[posting], len(met) * ix.block).reshape(len(met), ix.block)
    theta = np.full(len(ix.lowest) * ix.block, np.inf)
    theta[: len(ix.theta)] = ix.theta
    q, i = np.nonzero(score >= theta.reshape(-1, ix.block)[block] * (1 - 1e-6))
    return who[q] + number, block[q] * ix.block + i


def leaks(
    corpus: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 12, width: int = 64, slice_bytes: int = 64 << 20, pass_bytes: int = 256 << 20,
) -> DataFrame:
    """``(key, item_key, runs)``: pairs that share at least one run of ``run`` consecutive words.

    ``runs`` is the number of distinct shared runs.
    Texts of fewer words, null texts and null keys have no pair.  Repeated rows of a
    document or an item don't repeat a pair.  The items are read slice by slice on the
    driver; a slice that is measured larger than ``slice_bytes`` is halved.
    """
    spark = corpus.sparkSession
    rows = corpus.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("doc"), F.col(text).alias("text"))
    known = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("string").alias("item"), F.col(item_text).alias("text"))
    known = cut(known.groupBy("item").agg(F.min("text").alias("text")))
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size * 8 // slice_bytes))  # some 5 bytes of index a character
    out, held, held_bytes = None, [], 0

    def passed() -> None:
        nonlocal out, held, held_bytes
        found = rows.mapInArrow(search(held, width), FOUND_SQL)
        out, held, held_bytes = found if out is None else out.unionByName(found), [], 0

    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part) if parts > 1 else known
        waiting = [[(r["item"], r["text"]) for r in own.toLocalIterator()]]
        while waiting:
            some = waiting.pop()
            index = Index(some, run)
            if (measured := index.nbytes()) > slice_bytes and len(some) > 1:
                waiting += [some[: len(some) // 2], some[len(some) // 2 :]]
                continue
            if held and held_bytes + measured > pass_bytes:
                passed()
            held.append(spark.sparkContext.broadcast(index))
            held_bytes += measured
    passed()
    pairs = out.groupBy("doc", "item").agg(F.max("run").alias("runs"))
    return pairs.select(F.col("doc").cast(corpus.schema[key].dataType).alias(key), F.col("item").cast(items.schema[item_key].dataType).alias(item_key), "runs")


def leaked_documents(pairs: DataFrame, key: str, item_key: str) -> DataFrame:
    """One row a document: the items that leaked into it, in order."""
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set(item_key)).alias("items"), F.sum("runs").alias("runs"))
