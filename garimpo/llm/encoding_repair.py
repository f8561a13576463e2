"""Text that was decoded with the wrong character encoding: detection and repair.

Model.  Every record has a latent chain: clean, or one of the wrong decodings below
(bytes of one encoding read as another, also twice).  Records of one source and field
share a prior over chains.  Words come from a character trigram model; a word of an
affected record is garbled with some rate, so that a text may be affected in places.

Expectation-maximisation pools the weak evidence of single words over all records: the
E-step gives each distinct word of a source and field its posterior over chains, the
M-step sums these into the priors and re-estimates the character model from the words
as repaired.  The statistics are sums over the whole collection, computed where the
words are; the model that is broadcast has a fixed size.

A record's posterior then combines its words, marginalised over the rate of garbling.
The most probable chain repairs the words whose own evidence supports it.  Words with
the replacement character have lost their bytes: their records are affected for sure,
and they are restored from the most frequent clean word that fits, if there is one.
"""

from __future__ import annotations

import codecs
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import M1, batch, mix
from garimpo.plans.tables import cut

UTF8_READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859_15", "koi8_r")
LATIN_READ_AS = ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "cp1253", "koi8_r")
#: name -> (encoding it was read as, encoding it is in), undone in this order.
CHAINS: dict[str, tuple[tuple[str, str], ...]] = {
    **{f"utf_8>{w}": ((w, "utf_8"),) for w in UTF8_READ_AS},
    **{f"cp1252>{w}": ((w, "cp1252"),) for w in LATIN_READ_AS},
    **{f"{r}>cp1252": (("cp1252", r),) for r in ("mac_roman", "cp850")},
    **{f"utf_8>{w}>utf_8>{w}": ((w, "utf_8"), (w, "utf_8")) for w in ("cp1252", "mac_roman", "cp850")},
}
NAMES = ["clean", *CHAINS]
LOSSY = "lost"
LOST = "�"
WORD = re.compile("[^ \t\n\r]+")
#: Rates of garbled words in an affected record, and their prior.
RATES, RATE_PRIOR = np.array([0.01, 0.1, 0.5, 0.95]), np.array([0.25, 0.25, 0.25, 0.25])
BITS1, BITS2, BITS3 = 16, 18, 20

WORDS_SQL = "source string, field string, word string, n long"
WORDS = pa.schema([("source", pa.string()), ("field", pa.string()), ("word", pa.string()), ("n", pa.int64())])
STATS_SQL = "kind string, source string, field string, at int, n double"
STATS = pa.schema([("kind", pa.string()), ("source", pa.string()), ("field", pa.string()), ("at", pa.int32()), ("n", pa.float64())])
VERDICT_SQL = "field string, key string, chain string, posterior double, text string"
VERDICT = pa.schema([("field", pa.string()), ("key", pa.string()), ("chain", pa.string()), ("posterior", pa.float64()), ("text", pa.string())])


@lru_cache(None)
def encoder(name: str) -> dict[int, int]:
    """Code point -> byte; bytes the encoding doesn't define stand for themselves, as lenient decoders read them."""
    table: dict[int, int] = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    if name == "cp1252":
        for b in range(0x80, 0xA0):
            table.setdefault(b, b)
    return table


def undo(word: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The word before the wrong decodings, or None if it can't be their result."""
    out = word
    for wrong, right in chain:
        try:
            raw = codecs.charmap_encode(out, "strict", encoder(wrong))[0]
            out = raw.decode(right)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return None
    return out if out != word else None


def odd_words(text: str | None) -> list[str]:
    """Words with a character outside ASCII."""
    return [] if not text or text.isascii() else [w for w in WORD.findall(text) if not w.isascii()]


class Letters:
    """Interpolated character trigrams in tables of fixed size."""

    def __init__(self, one=None, two=None, three=None):
        self.one = np.zeros(1 << BITS1, np.float32) if one is None else one
        self.two = np.zeros(1 << BITS2, np.float32) if two is None else two
        self.three = np.zeros(1 << BITS3, np.float32) if three is None else three
        self.total = float(self.one.sum())

    @staticmethod
    def index(words: list[str]) -> tuple[np.ndarray, ...]:
        """Per character: word, and the cells of its uni-, bi- and trigram and of the two contexts."""
        text = "".join(f"\x02\x02{w}\x03" for w in words)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        c = np.where((c >= 48) & (c <= 57), np.uint64(48), c)
        size = np.array([len(w) + 3 for w in words])
        word = np.repeat(np.arange(len(words)), size)
        position = np.arange(len(c)) - np.repeat(np.cumsum(size) - size, size)
        at = np.flatnonzero(position >= 2)
        a, b, x = c[at - 2], c[at - 1], c[at]
        cell = lambda v, bits: (mix(v) >> np.uint64(64 - bits)).astype(np.int64)
        pair = lambda p, q: p * M1 + q
        return word[at], cell(x, BITS1), cell(pair(b, x), BITS2), cell(pair(pair(a, b), x), BITS3), cell(b, BITS1), cell(pair(a, b), BITS2)

    def score(self, words: list[str]) -> np.ndarray:
        """Log probability of each word."""
        if not words:
            return np.empty(0)
        word, x, bx, abx, b, ab = self.index(words)
        p = (self.one[x] + 0.02) / (self.total + 100)
        p = (self.two[bx] + 5 * p) / (self.one[b] + 5)
        p = (self.three[abx] + 5 * p) / (self.two[ab] + 5)
        return np.bincount(word, np.log(p), minlength=len(words))


def count_letters(words: list[str], n: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    if not words:
        return []
    word, x, bx, abx, _, _ = Letters.index(words)
    out = []
    for kind, cells in (("1", x), ("2", bx), ("3", abx)):
        at, inverse = np.unique(cells, return_inverse=True)
        out.append((kind, at, np.bincount(inverse, n[word])))
    return out


def variants(words: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word, chain, undone word) of all chains that a word can be the result of."""
    who, chain, text = [], [], []
    for i, w in enumerate(words):
        if LOST in w:
            continue
        for c, steps in enumerate(CHAINS.values(), 1):
            if (u := undo(w, steps)) is not None:
                who.append(i)
                chain.append(c)
                text.append(u)
    return np.array(who, np.int64), np.array(chain, np.int64), text


def log_scores(letters: Letters, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Matrix words x (clean and all chains) of log probabilities, and the variants."""
    who, chain, text = variants(words)
    out = np.full((len(words), len(NAMES)), -np.inf)
    out[:, 0] = letters.score(words)
    if len(who):
        out[who, chain] = letters.score(text)
    return out, who, chain, text


def collect_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        found: Counter = Counter()
        for source, field, text in zip(*(rows[c].to_pylist() for c in ("source", "field", "text"))):
            for w in odd_words(text):
                found[source, field, w] += 1
        keys = list(found)
        yield batch(WORDS, [k[0] for k in keys], [k[1] for k in keys], [k[2] for k in keys], list(found.values()))


def expect(model, first: bool):
    """E-step over distinct words: sums for the priors and for the character model."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = None if first else Letters(*model.value)
        for rows in batches:
            words, n = rows["word"].to_pylist(), np.asarray(rows["n"], dtype=float)
            if not words:
                continue
            if first:  # words that could be misread UTF-8 don't teach the first character model
                who, chain, _ = variants(words)
                doubtful = np.zeros(len(words), bool)
                doubtful[who[chain <= len(UTF8_READ_AS)]] = True
                doubtful |= np.array([LOST in w for w in words])
                texts, weight = words, np.where(doubtful, 0, n)
                priors: list = []
            else:
                score, who, chain, undone = log_scores(letters, words)
                prior = np.array(rows["prior"].to_pylist())
                score += np.log(prior)
                score -= score.max(axis=1, keepdims=True)
                share = np.exp(score)
                share /= share.sum(axis=1, keepdims=True)
                lost = np.array([LOST in w for w in words])
                texts = words + undone
                weight = np.concatenate((np.where(lost, 0, n * share[:, 0]), n[who] * share[who, chain]))
                total: Counter = Counter()
                for s, f, row in zip(rows["source"].to_pylist(), rows["field"].to_pylist(), n[:, None] * share):
                    total[s, f] = total[s, f] + row if (s, f) in total else row
                priors = [(s, f, c, float(v)) for (s, f), row in total.items() for c, v in enumerate(row) if v > 1e-9]
            keep = weight > 1e-6
            some = [t for t, k in zip(texts, keep) if k]
            for kind, at, v in count_letters(some, weight[keep]):
                yield batch(STATS, [kind] * len(at), pa.nulls(len(at), pa.string()), pa.nulls(len(at), pa.string()), at.astype(np.int32), v)
            if priors:
                yield batch(STATS, ["p"] * len(priors), [p[0] for p in priors], [p[1] for p in priors], np.array([p[2] for p in priors], np.int32), [p[3] for p in priors])

    return of


def fit(records: DataFrame, rounds: int = 3) -> tuple[tuple, DataFrame, DataFrame]:
    """(character model, priors by source and field, distinct words)."""
    spark = records.sparkSession
    words = records.mapInArrow(collect_words, WORDS_SQL).groupBy("source", "field", "word").agg(F.sum("n").alias("n"))
    words = cut(words)
    flat = [0.5] + [0.5 / len(CHAINS)] * len(CHAINS)
    prior = words.select("source", "field").distinct().withColumn("prior", F.array(*map(F.lit, flat)))
    model = None
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model)
        rows = words.join(prior, (words["source"].eqNullSafe(prior["source"])) & (words["field"] == prior["field"])).select(words["*"], "prior")
        stats = cut(rows.mapInArrow(expect(shared, turn == 0), STATS_SQL).groupBy("kind", "source", "field", "at").agg(F.sum("n").alias("n")))
        tables = []
        for kind, bits in (("1", BITS1), ("2", BITS2), ("3", BITS3)):  # as many rows as the table has cells, at most
            got = stats.where(F.col("kind") == kind).select("at", "n").toArrow()
            cells = np.zeros(1 << bits, np.float32)
            cells[np.asarray(got["at"])] = np.asarray(got["n"])
            tables.append(cells)
        model = tuple(tables)
        if turn:
            # half a word for each chain keeps every chain possible; most of a source's words are clean
            sums = stats.where("kind = 'p'").groupBy("source", "field").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m"), F.sum("n").alias("all"))
            smooth = 0.5 / len(CHAINS)
            share = [(F.coalesce(F.try_element_at("m", F.lit(c)), F.lit(0.0)) + (20.0 if c == 0 else smooth)) / (F.col("all") + 20.5) for c in range(len(NAMES))]
            prior = cut(sums.select("source", "field", F.array(*share).alias("prior")))
    return model, prior, words


@lru_cache(1)
def known_gains(version: str) -> dict:
    return {}


def judge(model, version: str, repair: bool, threshold: float):
    """Posterior of each record; only affected records come out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, memo = Letters(*model.value), known_gains(version)
        for rows in batches:
            columns = [rows[c].to_pylist() for c in ("field", "key", "text", "prior")]
            found = [odd_words(t) for t in columns[2]]
            new = [w for w in {w for ws in found for w in ws} if w not in memo]
            if len(memo) + len(new) > 400_000:
                memo.clear()
                new = list({w for ws in found for w in ws})
            for s in range(0, len(new), 20_000):
                part = new[s : s + 20_000]
                score, *_ = log_scores(letters, part)
                gain = score[:, 1:] - score[:, :1]
                for w, g in zip(part, gain):
                    memo[w] = g if (g > 0).any() else None
            out: list[list] = [[] for _ in VERDICT]
            for field, key, text, prior, words in zip(*columns, found):
                if not words:
                    continue
                lost = LOST in text
                gains = [memo[w] for w in words if memo[w] is not None]
                chain, posterior, fixed = 0, 0.0, text
                if gains:
                    g = np.minimum(np.array(gains), 60)
                    mixed = np.log(RATES[:, None, None] * np.exp(g)[None] + (1 - RATES)[:, None, None]).sum(axis=1)
                    mixed += ((len(words) - len(gains)) * np.log(1 - RATES) + np.log(RATE_PRIOR))[:, None]
                    top = mixed.max(axis=0)
                    odds = top + np.log(np.exp(mixed - top).sum(axis=0)) + np.log(np.array(prior[1:]) / prior[0])
                    chain = int(odds.argmax()) + 1
                    peak = max(0.0, odds.max())
                    weight = np.exp(odds - peak)
                    posterior = float(weight.sum() / (weight.sum() + np.exp(-peak)))
                    if posterior > threshold and repair:
                        fixed = restore(text, memo, chain)
                if posterior > threshold or lost:
                    name = NAMES[chain] if posterior > threshold else LOSSY
                    for column, value in zip(out, (field, key, name, 1.0 if lost else posterior, fixed if repair else None)):
                        column.append(value)
            yield batch(VERDICT, *out)

    return of


def restore(text: str, memo: dict, chain: int) -> str:
    """Undo the record's chain, and any other chain that a word speaks for more clearly."""

    def word(match: re.Match) -> str:
        w = match.group()
        g = None if w.isascii() else memo.get(w)
        if g is None:
            return w
        c = chain if g[chain - 1] > 0 and g[chain - 1] >= g.max() - 8 else int(g.argmax()) + 1
        return undo(w, list(CHAINS.values())[c - 1]) or w if g[c - 1] > 0 else w

    return WORD.sub(word, text)


def affected(records: DataFrame, repair: bool = False, rounds: int = 3, threshold: float = 0.5) -> DataFrame:
    """``(field, key, chain, posterior, text)`` of the affected records of ``(field, source, key, text)``.

    ``text`` is the repaired text if ``repair``.  Null and empty texts are never affected.
    A key that is delivered repeatedly comes out once a field.
    """
    spark = records.sparkSession
    model, prior, words = fit(records, rounds)
    shared = spark.sparkContext.broadcast(model)
    p = prior.withColumnsRenamed({"source": "s", "field": "f"})
    rows = records.where("key is not null").join(p, (records["source"].eqNullSafe(p["s"])) & (records["field"] == p["f"])).select("field", "key", "text", "prior")
    version = f"{model[0].sum()}-{model[2].sum()}-{id(shared)}"
    found = rows.mapInArrow(judge(shared, version, repair, threshold), VERDICT_SQL).dropDuplicates(["field", "key"])
    return with_lost_words(cut(found), words) if repair else found


def with_lost_words(found: DataFrame, words: DataFrame) -> DataFrame:
    """Replace words with the replacement character by the most frequent clean word that fits."""
    shape = F.regexp_replace("word", "[^\\x00-\\x7f]", LOST)
    bare = F.regexp_replace("word", "[.,;:!?()]+$", "")
    clean = words.where(~F.contains("word", F.lit(LOST))).select(bare.alias("word"), "n").withColumn("shape", shape)
    best = clean.groupBy("shape", "word").agg(F.sum("n").alias("n")).groupBy("shape").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    lost = found.where(F.contains("text", F.lit(LOST))).select("field", "key", F.explode(F.split("text", "([ \t\n\r])")).alias("word")).where(F.contains("word", F.lit(LOST)))
    lost = lost.withColumn("shape", bare).distinct().select("field", "key", "shape")
    pairs = lost.join(best, "shape").groupBy("field", "key").agg(F.map_from_entries(F.collect_set(F.struct("shape", "word"))).alias("m"))
    rows = found.join(pairs, ["field", "key"], "left")
    tail = "([.,;:!?()]*)$"
    word = lambda w: F.concat(
        F.coalesce(F.try_element_at("m", F.regexp_replace(w, tail, "")), F.regexp_replace(w, tail, "")), F.regexp_extract(w, tail, 1)
    )
    lines = F.transform(F.split("text", "\n"), lambda line: F.array_join(F.transform(F.split(line, " "), word), " "))
    return rows.withColumn("text", F.when(F.col("m").isNull(), F.col("text")).otherwise(F.array_join(lines, "\n"))).drop("m")
