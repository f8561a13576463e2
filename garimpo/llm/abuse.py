"""A score for abusive, hateful or sexual language, by boosted trees over dense features.

The unit is the sentence: one abusive sentence makes a document abusive, so a document's
features come from its most suspicious sentence.  Words are brought back to a plain form
first (accents, look-alike digits, spelling with dots or blanks, stretched letters,
masked letters), and how much of that was needed is a feature.

The given lexicon is far from complete.  It is extended by a learned one: word and
word-pair weights of a sparse logistic regression over the sentences of labelled
documents, in which a positive document teaches by its most suspicious sentence
(multiple-instance learning).  The learned lexicon is cross-fitted, so the
trees see it as it behaves on unseen documents.  Isotonic regression calibrates the
trees' score on out-of-fold predictions.

The models are fitted on at most about ``sample_rows`` labelled documents; every document
is scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import batch
from garimpo.llm.linear import Trees, best_threshold, fit_logistic, isotonic
from garimpo.llm.splitting import LETTER, char_classes, code_points
from garimpo.plans.tables import bounded

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
TOKEN = re.compile(r"[^\W_]+")
#: Characters that stand in for letters.
LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e"})
#: Words that address or point at someone.
SECOND_PERSON = frozenset("voce voces tu te ti teu tua teus tuas seu sua seus suas vos you your yours usted ustedes tus su".split())
PEOPLE = frozenset("povo gente moradores vizinho vizinhos sindico pessoas people todos eles elas todas los las them they imigrantes forasteiros mulher mulheres homem homens vecino vecinos chicas girls raca esse essa esses essas quem".split())
NEGATION = frozenset("proibe proibido proibida proibidas proibidos regra regras norma politica moderacao palavra palavras termo termos chamar expressao denuncia linguagem ofensas rule rules policy word words prohibido palabra reglamento regulamento".split())

MIXED = re.compile(r"(?<![\w])(?=[\w@$!€]*[^\W\d_])(?=[\w@$!€]*[013457@$])[\w@$!€]{3,}(?![\w])")
DOTTED = re.compile(r"(?<!\w)(?:[^\W\d_][.\-_*·]){3,}[^\W\d_](?!\w)")
ACCENTS = re.compile("[\u0300-\u036f]+")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}", re.I)
MASKED = re.compile(r"(?<!\w)[^\W\d_]\w*[*#]+\w*|(?<!\w)[*#]+[^\W\d_]\w+")

FEATURES = (
    "learned", "learned_second", "learned_best", "learned_all", "lexicon_weight", "lexicon_sure", "lexicon_unsure", "classes", "density", "second_person", "near_second_person", "people", "negation",
    "capitals", "shout", "exclaims", "mixed", "dotted", "spaced", "stretched", "masked", "masked_hit", "odd_rate", "length", "position",
)


def plain(text: str) -> str:
    """Lower case without accents."""
    text = text.lower()
    return text if text.isascii() else ACCENTS.sub("", unicodedata.normalize("NFD", text))


NOTHING = (0, 0, 0, 0, 0, 0)


def members(chars: str) -> np.ndarray:
    """Table over all code points."""
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in chars]] = True
    return table


STAND_INS, SEPARATORS = members("013457@$!€"), members(".-_*·")


def may_be_disguised(text: str) -> bool:
    """Whether any sentence could need ``Reader.restored``: one look at the characters of the whole text."""
    if "*" in text or "#" in text:
        return True
    c = code_points(text.lower())
    if len(c) < 7:
        return True
    letter = char_classes()[c] == LETTER
    other = STAND_INS[c]
    if (letter[1:] & other[:-1]).any() or (letter[:-1] & other[1:]).any():
        return True
    if (letter[2:] & (c[2:] == c[1:-1]) & (c[2:] == c[:-2])).any():
        return True
    near = np.concatenate(([False], letter, [False]))
    letter = letter & ~near[:-2] & ~near[2:]  # letters between other characters
    for gap in (c == 32, SEPARATORS[c]):
        if (letter[:-6] & gap[1:-5] & letter[2:-4] & gap[3:-3] & letter[4:-2] & gap[5:-1] & letter[6:]).any():
            return True
    return False


class Reader:
    """Turns a text into sentences of plain tokens with their surface features."""

    def __init__(self, lexicon: list[tuple[str, str, int, bool]]):
        self.terms = {plain(t): (k or "?", int(w or 1), bool(a)) for t, k, w, a in lexicon if t}
        self.masks: dict[int, list[str]] = {}
        for t in self.terms:
            self.masks.setdefault(len(t), []).append(t)

    def unmask(self, word: str) -> str:
        word = plain(word).replace("#", "*")
        fits = [t for t in self.masks.get(len(word), ()) if all(a == b or a == "*" for a, b in zip(word, t))]
        return fits[0] if fits else "masked" + str(min(word.count("*"), 3))

    def sentences(self, text: str) -> list[tuple[list[str], tuple, str]]:
        """(plain tokens, counts of disguises, sentence); only texts with a sign of disguise are searched for it by sentence."""
        out = []
        odd_text = may_be_disguised(text)
        for s in SENTENCE.split(text):
            if len(s) < 4:
                continue
            t, odd = self.restored(s) if odd_text else (s, NOTHING)
            tokens = TOKEN.findall(plain(t))
            if tokens:
                out.append((tokens, odd, s))
        return out

    def restored(self, t: str) -> tuple[str, tuple]:
        masked = hit = 0
        if "*" in t or "#" in t:
            for w in MASKED.findall(t):
                u = self.unmask(w)
                masked += 1
                hit += u in self.terms
                t = t.replace(w, u, 1)
        t, dotted = DOTTED.subn(lambda m: re.sub(r"[.\-_*·]", "", m.group()), t)
        t, spaced = SPACED.subn(lambda m: m.group().replace(" ", ""), t)
        t, mixed = MIXED.subn(lambda m: m.group().translate(LOOK_ALIKE) if sum(c.isalpha() for c in m.group()) + 2 >= len(m.group()) / 2 else m.group(), t)
        t, stretched = STRETCHED.subn(r"\1", t)
        return t, (mixed, dotted, spaced, stretched, masked, hit)


def grams(tokens: list[str]) -> list[str]:
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def weigh(weights: dict[str, float], tokens: list[str]) -> tuple[float, float]:
    """Sum and largest of the learned weights of a sentence."""
    found = [weights[g] for g in tokens if g in weights]
    found += [weights[g] for a, b in zip(tokens, tokens[1:]) if (g := f"{a} {b}") in weights]
    return (weights[""] + sum(found), max(found)) if found else (weights[""], 0.0)


def learn_lexicon(documents: list[list[tuple[list[str], tuple, str]]], labels: np.ndarray, reader: Reader, seed: int = 0) -> dict[str, float]:
    """Word and pair weights; a positive document teaches by its most suspicious sentence.

    Which one that is, a model of the other half of the documents says, so that no
    sentence is suspicious only because it was learned.  Positive documents in which
    neither that model nor unusual words point at any sentence count as wrongly labelled.
    """
    random = np.random.default_rng(seed)
    seen = Counter(w for d in documents for s in d for w in set(s[0]))
    total = max(1, sum(len(d) for d in documents))
    surely = {t for t, (_, w, a) in reader.terms.items() if not a}

    def unusual(tokens, odd) -> float:
        rare = sum([log(total / (1 + seen[w])) for w in tokens if not w.isdigit()]) / (len(tokens) + 3)
        return rare + 4 * sum(t in surely for t in tokens) + 1.5 * sum(t in reader.terms for t in tokens) + sum(odd[:5])

    first = [np.array([unusual(t, o) for t, o, _ in d]) for d in documents]
    calm = np.array([f.max() for f, y in zip(first, labels) if len(f) and not y] or [0.0])
    high = float(np.quantile(calm, 0.9))

    def fit(which, tops, kept) -> dict[str, float]:
        rows, y = [], []
        for i in which:
            doc = documents[i]
            if not doc or not kept[i]:
                continue
            if labels[i]:
                rows.append(grams(doc[tops[i]][0]))
                y.append(1)
            else:
                for j in {tops[i], *random.choice(len(doc), min(3, len(doc)), replace=False).tolist()}:
                    rows.append(grams(doc[j][0]))
                    y.append(0)
        return fit_logistic(rows, np.array(y), epochs=5, l2=1e-4, least=2, seed=seed, start=0.3) if any(y) else {"": -5.0}

    tops, kept = [int(f.argmax()) if len(f) else 0 for f in first], [True] * len(documents)
    half = random.permutation(len(documents)) % 2
    both = [fit(np.flatnonzero(half == h), tops, kept) for h in (0, 1)]
    for i, doc in enumerate(documents):
        if doc:
            value = np.array([weigh(both[1 - half[i]], t)[0] for t, _, _ in doc])
            tops[i] = int((value + 0.2 * first[i]).argmax())
            kept[i] = bool(value.max() > -1.5 or first[i].max() > high) if labels[i] else bool(value.max() < 2.5)
    return fit(range(len(documents)), tops, kept)


def document_features(doc: list[tuple[list[str], tuple, str]], weights: dict[str, float], reader: Reader) -> np.ndarray:
    """Dense features of the most suspicious sentence, and some of the whole."""
    out = np.zeros(len(FEATURES))
    if not doc:
        out[0] = out[1] = -8.0
        return out
    terms = reader.terms
    scored = []
    for i, (tokens, odd, _) in enumerate(doc):
        total, best = weigh(weights, tokens)
        hits = [terms[t] for t in tokens if t in terms]
        value = total
        if hits or odd is not NOTHING:
            value += (1.0 if any(not a for _, _, a in hits) else 0) + 0.3 * sum(odd[:5])
        scored.append((value, total, best, i, hits))
    scored.sort(key=lambda v: -v[0])
    _, total, best, at, hits = scored[0]
    tokens, odd, raw = doc[at]
    marks = [i for i, t in enumerate(tokens) if t in SECOND_PERSON]
    at_terms = [i for i, t in enumerate(tokens) if t in terms or weights.get(t, 0) > 1]
    near = min((abs(a - b) for a in marks for b in at_terms), default=20)
    letters = sum(c.isalpha() for c in raw)
    words = raw.split()
    out[:] = (
        total, scored[1][1] if len(scored) > 1 else -8.0, best, sum(v[1] > 0 for v in scored), sum(w for _, w, _ in hits), sum(not a for _, _, a in hits), sum(a for _, _, a in hits),
        len({k for k, _, _ in hits}), len(at_terms) / len(tokens), len(marks), near, sum(t in PEOPLE for t in tokens), sum(t in NEGATION for t in tokens),
        sum(c.isupper() for c in raw) / max(1, letters), sum(w.isupper() and len(w) > 3 for w in words), raw.count("!"), *odd, sum(odd[:5]) / len(tokens), len(tokens), at / len(doc),
    )
    return out


class Model:
    """Learned lexicon, trees, calibration and threshold."""

    def fit(self, texts: list[str], labels: np.ndarray, lexicon: list[tuple], folds: int = 3) -> Model:
        self.reader = Reader(lexicon)
        documents = [self.reader.sentences(t or "") for t in texts]
        labels = np.asarray(labels).astype(float)
        fold = np.arange(len(texts)) % folds
        x = np.zeros((len(texts), len(FEATURES)))
        for f in range(folds):
            rest = [i for i in range(len(texts)) if fold[i] != f]
            weights = learn_lexicon([documents[i] for i in rest], labels[rest], self.reader, seed=f)
            for i in np.flatnonzero(fold == f):
                x[i] = document_features(documents[i], weights, self.reader)
        held = np.zeros(len(texts))
        for f in range(folds):
            if (fold != f).any() and (fold == f).any():
                held[fold == f] = Trees().fit(x[fold != f], labels[fold != f]).raw(x[fold == f])
        self.trees = Trees().fit(x, labels)
        self.weights = learn_lexicon(documents, labels, self.reader)
        self.calibration = isotonic(held, labels)
        p = self.calibrated(held)
        self.threshold = best_threshold(p, labels.astype(bool), 0.4, 0.8) if labels.any() and not labels.all() else 0.5
        self.held_out = (p, labels)
        return self

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, *self.calibration)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([document_features(self.reader.sentences(t or ""), self.weights, self.reader) for t in texts]).reshape(len(texts), len(FEATURES))
        return np.where([bool(t) for t in texts], self.calibrated(self.trees.raw(x)), 0.0)


def train_model(documents: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, label: str, lexicon: DataFrame, sample_rows: int = 6000) -> Model:
    """A model from at most about ``sample_rows`` labelled documents, chosen by a hash of the key.

    The whole lexicon is part of the model: it has to be a word list, not a corpus.
    Null labels are left out; of several labels of a document the majority counts, a tie as positive.
    """
    votes = labels.where(F.col(label).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("k")).agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    total = votes.count()
    share = max(1, min(1_000_000, int(1e6 * sample_rows / max(1, total))))
    # the keys of the sample: their number is bounded by sample_rows, and so is the broadcast
    votes = bounded(votes.where(F.pmod(F.xxhash64(F.lit(5), "k"), F.lit(1_000_000)) < share), 64)
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null and t != ''").join(votes, "k")
    rows = rows.dropDuplicates(["k"]).orderBy(F.xxhash64("k")).limit(2 * sample_rows).toArrow()
    terms = lexicon.select("termo", "classe", "peso", F.coalesce("ambiguo", F.lit(True)).alias("ambiguo")).where("termo is not null").orderBy("termo").toLocalIterator()
    return Model().fit(rows["t"].to_pylist(), np.asarray(rows["y"].to_pylist() or [], float), [tuple(r) for r in terms])


def scores(documents: DataFrame, key: str, text: str, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, score, abusive, *keep)``, one row a row: calibrated probability and the decision.

    Null and empty texts have score 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"), *(F.col(c).alias(f"keep_{c}") for c in keep))
    carried = [f for f in rows.schema if f.name != "text"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                part = whole.slice(s, 1000)
                p = m.score(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([*(part[f.name] for f in carried), pa.array(p), pa.array(p >= m.threshold)], names=[*(f.name for f in carried), "score", "abusive"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried) + ", score double, abusive boolean"
    out = rows.mapInArrow(of, ddl)
    return out.select(F.col("key").alias(key), "score", "abusive", *(F.col(f"keep_{c}").alias(c) for c in keep))


def rates(scored: DataFrame, source: str) -> DataFrame:
    """Documents, abusive documents and rate per source."""
    return scored.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("abusive").alias("abusive"), F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score")
    )
