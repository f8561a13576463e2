"""Defective question and answer pairs, by a multi-label linear classifier.

No pair is labelled.  Answers of a bounded sample are taken as sound; from them the
defects are made: cut answers, answers that repeat the question, answers in another
language (swapped between pairs), refusals (put together from a small grammar) and
empty ones.  A linear model per label sees hashed n-grams and pair features: overlap
with the question, languages by function words and letters, the shape of the last
sentence.  As the sample holds real defects too, the models are fitted in turns: pairs
in which a turn finds a defect are its examples in the next, doubtful ones are left out.
So wordings that no list foresees are learned from the data the model is used on.
Thresholds are set on a held-out part.  The labels of a turn are fitted in parallel.

Refusals are judged by sentence: an answer only declines if no sentence answers.
"""

from __future__ import annotations

import io
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import WORD, batch, lower
from garimpo.llm.linear import Hashed, best_threshold

LABELS = ("vazia", "recusa", "copia", "outro_idioma", "truncada")
CITATION = re.compile(r"\[\s*\d+(?:\s*[,;–-]\s*\d+)*\s*\]")
QUOTED = re.compile(r"“[^”]*”|\"[^\"\n]*\"|«[^»]*»|‘[^’]*’")
SENTENCE = re.compile(r"(?<=[.!?;])\s+|\n+")

#: The adverbial phrase that ends a sentence.
TAIL = re.compile(r"\s((?:durante|com|nas|nos|na|no|sem|em|até|após|por|ao|à|já|during|on|at|after|with|en|hasta|sin)\s[^,;.()]{4,35})\.?\s*$")
#: Answers of one word.
SHORT = ("Sim.", "Não.", "Sim", "Não", "Yes.", "No.", "Sí.", "Sim!", "Correto.", "Exato.", "Nunca.", "Sempre.", "Depende.", "Ambos.", "Nenhum.", "Todos.")

#: A number with its unit, up to the end of the phrase.
AMOUNT = re.compile(r"\d[\d.,]* (?:[^\W\d_]\S*(?: (?:de|por|da|do) \S+| \S+)?)(?=[.;,])")

#: Words that stand in for an answer.
PLACEHOLDERS = re.compile(
    r"\(?\b(?:sem resposta|sem conte[úu]do|n/?a|n\.a\.|null|none|nil|nan|undefined|vazio|vazia|resposta|answer|respuesta|response|no answer|sin respuesta|tbd|todo|pendente|em branco|lorem ipsum)\b\)?\s*:?", re.I
)
#: A label before an answer.
LABEL = re.compile(r"^\W*(?:resposta|answer|respuesta|response)\s*:", re.I)
#: Function words by language.
FUNCTION_WORDS = {
    "pt": "o a os as um uma de do da dos das em no na nos nas por pelo pela para com sem que não é são foi se ao à aos às ou e mais como quando também até entre sobre seu sua isso esse essa este esta qual quais quanto há já só deve cerca contra caso segundo",
    "es": "el la los las un una de del en por para con sin que no es son fue se al o y más como cuando también hasta entre sobre su sus eso ese esa este esta cuál cuáles cuánto hay ya sólo debe unos según lo le cada qué cómo dónde",
    "en": "the a an of in on at by for with without that not is are was be to or and more as when also until between about its this these those which how much there already only should may it from whenever what does did per if than",
    "fr": "le la les un une des du de en dans par pour avec sans que ne pas est sont été se au aux ou et plus comme quand aussi entre sur son sa ce cette quel quelle il y selon",
    "it": "il lo la i gli le un una di del della in nel nella per con senza che non è sono si al alla o e più come quando anche tra su suo sua questo questa quale ogni",
    "de": "der die das ein eine von im in auf an für mit ohne dass nicht ist sind war zu oder und mehr wie wenn auch bis zwischen über sein ihre dies diese welche nach bei",
}
LANGUAGES = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}

#: Parts of refusals, to be combined.
SUBJECT = {
    "pt": ["os trechos", "os documentos", "as fontes", "o contexto", "o corpus", "o material", "o acervo", "os textos recuperados", "as passagens", "as fontes acima", "nenhum dos trechos", "nenhuma fonte", "a base consultada", "nada no contexto", "nenhum documento"],
    "es": ["los fragmentos", "los documentos", "las fuentes", "el contexto", "el material", "ninguno de los textos", "el corpus", "ninguna fuente"],
    "en": ["the passages", "the documents", "the sources", "the context", "the material", "none of the passages", "the given text", "nothing in the context"],
}
SUBJECT["pt"] += [f"{noun} {kind}{ending}" for noun, ending in (("os trechos", "os"), ("as passagens", "as"), ("as páginas", "as"), ("os cadernos", "os"), ("os textos", "os"), ("os excertos", "os"), ("as fontes", "as"), ("os documentos", "os"), ("os manuais", "os")) for kind in ("citad", "recebid", "recuperad", "fornecid", "consultad", "dad")]
LACK = {
    "pt": ["não trata{m} disso", "não menciona{m} {x}", "não permite{m} responder", "não chega{m} a abordar {x}", "nada diz{em} sobre {x}", "silencia{m} quanto a {x}", "passa{m} ao largo de {x}", "não basta{m} para responder", "não descreve{m} {x}", "não cita{m} {x}", "é omisso nesse ponto", "são omissos", "silenciam quanto a {x}", "passam ao largo do tema que envolve {x}", "não chegam a abordar {x}", "são omissos a respeito de {x}", "tratam de outra coisa", "não traz{em} essa informação", "não contém esse dado", "não fornece{m} elementos para responder", "permite chegar a uma resposta", "não aborda{m} esse assunto"],
    "es": ["no tratan ese tema", "no mencionan {x}", "no permiten responder", "no dicen nada sobre {x}", "no contienen ese dato", "guardan silencio sobre {x}", "permite dar una respuesta", "no bastan para responder"],
    "en": ["do not mention {x}", "say nothing about {x}", "do not cover this topic", "do not contain that information", "are silent on {x}", "are not enough to answer", "allow an answer", "do not address {x}"],
}
DECLINE = {
    "pt": ["não sei responder", "não sei dizer", "não sei", "não posso ajudar com isso", "não posso ajudar com essa pergunta", "não posso responder a essa pergunta", "não tenho como responder", "não tenho como afirmar nada sobre {x}", "não tenho como dar esse valor sobre {x}", "não tenho acesso a esses dados", "não consigo opinar sobre {x}", "não consigo atender a esse pedido sobre {x}", "não disponho de dados para uma resposta", "não encontrei essa informação", "não encontrei nos trechos fornecidos elementos para responder", "não encontrei nos documentos a informação pedida", "não encontrei nada sobre {x} nos trechos", "nenhum dos trechos citados permite chegar a uma resposta", "não estou autorizado a afirmar nada sobre {x}", "não tenho autorização para dar esse valor", "não consigo dar esse valor sobre {x}", "não disponho de dados suficientes para uma resposta", "não me é permitido opinar sobre {x}", "não encontrei nos trechos elementos para responder", "não há informação suficiente", "não há registro no material", "não é possível responder com o material disponível", "não me cabe opinar sobre {x}", "prefiro não responder", "prefiro não opinar sobre esse tema", "vou me abster de responder", "me abstenho de dar a resposta", "fico devendo a resposta", "deixo em aberto a resposta", "faltam dados no acervo", "falta cobertura no acervo para essa questão", "esse dado não consta nos documentos", "esse dado não consta no material", "essa informação não consta no acervo", "não há registro nos documentos", "não há registro no acervo", "faltam dados nos documentos", "faltam dados no material", "falta informação nos trechos", "essa informação não está no corpus", "a informação solicitada não está no corpus consultado", "a informação não consta na base", "a pergunta foge do que me é permitido responder", "não estou autorizado a opinar sobre {x}", "sem resposta possível: {x} não aparece no contexto dado", "{x} não aparece em nenhuma fonte", "{x} não aparece no que foi recuperado", "não há como responder", "isso está fora do meu alcance", "como modelo de linguagem, não tenho acesso a esses dados", "como assistente, não posso dar esse valor"],
    "es": ["no puedo responder a esa pregunta", "no puedo ayudar con eso", "no sé responder", "no dispongo de datos suficientes", "no encontré esa información", "no hay información suficiente", "esa información no está en el corpus", "prefiero no opinar sobre ese tema", "no me corresponde opinar sobre {x}", "no es posible responder con el material disponible", "ese dato no consta en los documentos", "no tengo cómo responder", "como modelo de lenguaje, no tengo acceso a esos datos", "no estoy autorizado a opinar sobre {x}", "faltan datos en el material"],
    "en": ["i can't answer that from the given passages", "i cannot answer this question", "i can't help with that", "i do not know", "i don't have enough information", "i could not find that information", "there is not enough information to answer", "that information is not in the corpus", "i'd rather not comment on this topic", "as a language model, i have no access to that data", "i am not able to give that value", "i am unable to answer", "it is not possible to answer with the material available", "no answer can be given about {x}"],
}
OPENING = {
    "pt": ["", "", "", "desculpe, ", "peço desculpas, mas ", "sinto muito, mas ", "sinto, mas ", "lamento, mas ", "infelizmente ", "infelizmente, "],
    "es": ["", "", "lo siento, pero ", "lamentablemente ", "disculpe, "], "en": ["", "", "i'm sorry, but ", "sorry, ", "unfortunately, ", "regrettably "],
}
CLOSING = {
    "pt": ["", "", "", ", em especial sobre {x}", "; portanto, não há como responder", ", e por isso me abstenho", ". tente reformular a pergunta", ". consulte um profissional habilitado", ". recomendo consultar {x}", ". recomendo procurar um especialista", ": os trechos são omissos", ": as páginas tratam de outra coisa", ": os textos não bastam", ", infelizmente"],
    "es": ["", "", ". intente reformular la pregunta", ". consulte a un profesional", ", en especial sobre {x}"], "en": ["", "", ". please rephrase the question", ". please consult a professional", ", especially about {x}"],
}
#: Openings after which an answer still answers.
HEDGES = {
    "pt": ["embora o corpus não trate do caso geral, ", "não encontrei valor único, mas ", "os trechos não são unânimes, mas ", "ainda que as fontes não citem o caso exato, ", "não há consenso nos documentos, porém ", "sem dado exato no material, pode-se dizer que "],
    "es": ["aunque las fuentes no citan el caso exacto, ", "no encontré un valor único, pero "], "en": ["although the passages do not cover the general case, ", "i found no single value, but "],
}


def words(text: str) -> list[str]:
    return WORD.findall(lower(text))


def language(tokens: list[str]) -> tuple[str, float]:
    """Language with most function words, and by how much of all tokens it leads the next."""
    n = sorted(((sum(t in known for t in tokens), k) for k, known in LANGUAGES.items()), reverse=True)
    return (n[0][1] if n[0][0] else "?"), (n[0][0] - n[1][0]) / max(1, len(tokens))


def bare(answer: str | None) -> str:
    """The answer without citations and invisible characters."""
    text = "".join(c for c in unicodedata.normalize("NFC", answer or "") if unicodedata.category(c) != "Cf")
    return CITATION.sub(" ", text).strip()


def bucket(v: float, edges=(0, 0.1, 0.25, 0.4, 0.55, 0.7, 0.8, 0.9, 0.999)) -> int:
    return int(np.searchsorted(edges, v, "right"))


def empty_features(question: str, answer: str | None) -> list[str]:
    kept = words(PLACEHOLDERS.sub(" ", bare(answer)))
    n = sum(map(len, kept))
    return [f"n={min(n, 3)}", f"w={min(len(kept), 3)}", f"none={answer is None}", *(f"t={t}" for t in words(bare(answer))[:4])]


def copy_features(question: str, answer: str) -> list[str]:
    q, a = words(question), words(LABEL.sub(" ", bare(answer)))
    cq, ca = Counter(q), Counter(a)
    same = sum((cq & ca).values())
    pq, pa_ = Counter(zip(q, q[1:])), Counter(zip(a, a[1:]))
    two = sum((pq & pa_).values())
    new = len(a) - same
    fresh = min(len(set(a) - set(q)), 12)
    back, given = bucket(same / max(1, len(q))), bucket(same / max(1, len(a)))
    return [
        f"back={back}", f"given={given}", f"both={back},{given}", f"new={min(new, 12)}", f"new,back={min(new, 8)},{back}", f"fresh={fresh}", f"fresh,back={fresh},{back}", f"two={bucket(two / max(1, len(pq)))}", f"two,new={bucket(two / max(1, len(pq)))},{min(new, 8)}",
        *(f"extra={t}" for t in list((ca - cq))[:6]),
    ]


def language_features(question: str, answer: str) -> list[str]:
    q = words(question)
    a = words(QUOTED.sub(" ", bare(answer)))
    lq, _ = language(q)
    la, lead = language(a)
    out = [f"lq={lq}", f"same={lq == la}", f"same,lead={lq == la},{bucket(lead, (0, 0.03, 0.08, 0.15, 0.25))}", f"pair={lq},{la}", f"n={bucket(len(a), (1, 3, 6, 10, 20))},{lq == la}"]
    for part in SENTENCE.split(QUOTED.sub(" ", bare(answer))):  # a foreign sentence beside others isn't another language
        w = words(part)
        if len(w) >= 4 and language(w)[0] == lq:
            out.append("some own sentence")
            break
    letters = {t[i : i + 3] for t in (f" {w} " for w in a) for i in range(len(t) - 2)}
    return out + [f"letters={lq}|{g}" for g in letters]


def refusal_features(sentence: str) -> list[str]:
    w = words(sentence)
    t = [x if not x.isdigit() else "#" for x in w]
    return [*(f"1={x}" for x in t), *(f"2={x} {y}" for x, y in zip(t, t[1:])), *(f"3={x} {y} {z}" for x, y, z in zip(t, t[1:], t[2:])), f"start={' '.join(t[:2])}", f"n={min(len(t), 14)}", f"digits={'#' in t}"]


def sentences(answer: str) -> list[str]:
    return [s for s in SENTENCE.split(LABEL.sub(" ", bare(answer))) if words(s)]


class EndShape:
    """Features of how an answer ends; knows the frequent words and the words that are whole."""

    def __init__(self, texts: list[str], frequent: int = 400):
        inner, all_words = Counter(), Counter()
        for t in texts:
            w = words(t)
            all_words.update(set(w))
            inner.update(w[:-1])
        self.frequent = {w for w, _ in all_words.most_common(frequent)}
        self.whole = {w for w, n in inner.items() if n >= 2}

    def mask(self, token: str) -> str:
        t = token.lower()
        if t in self.frequent:
            return t
        if t[0].isdigit():
            return "#"
        return ("C" if token[0].isupper() else "") + "~" + t[-2:]

    def features(self, answer: str) -> list[str]:
        text = bare(answer).rstrip()
        line = text.rsplit("\n", 1)[-1].strip()
        last = re.split(r"(?<=[.!?])\s+(?=[^\W\d_]|\d|“|\[)", line)[-1].strip() or line
        end = text[-1:] or " "
        tail = last.rstrip(" .!?…\"”)»")
        raw = WORD.findall(tail)
        kind = "stop" if end in ".!?" else "close" if end in "\"”)»" else "dots" if end == "…" else "break" if end in ",;:-–(" else "digit" if end.isdigit() else "word" if end.isalpha() else "sign"
        m = [self.mask(t) for t in raw]
        low = [t.lower() for t in raw]
        opened = (last.count("(") > last.count(")"), text.count("“") > text.count("”"), text.count("[") > text.count("]"), text.count('"') % 2 == 1)
        out = [f"end={kind}", f"opened={any(opened)}", f"opened,end={opened},{kind}"]
        if not raw:
            return [*out, "blank last line", f"sign={line[-3:]}"]
        open_end = kind not in ("stop", "close")
        k = kind if open_end else "closed"
        unknown = low[-1] not in self.whole and not low[-1].isdigit() and not raw[-1][0].isupper()
        item = line[:2] in ("- ", "* ", "• ") or bool(re.match(r"\d+[.)]\s", line))
        out += [
            f"{k}:1={low[-1]}", f"{k}:2={' '.join(m[-2:])}", f"{k}:3={' '.join(m[-3:])}", f"{k}:4={' '.join(m[-4:])}", f"{k}:unknown={unknown}", f"{k}:n={min(len(raw), 16)}",
            f"{k}:start={' '.join(m[:2])}", f"{k}:item={item},{min(len(raw), 6)}", f"{k}:size={len(low[-1]) if unknown else 0}", f"{k}:tail={text[-2:] if not text[-2:].isalpha() else ''}",
            f"{k}:only={len(sentences(answer)) <= 1}", f"{k}:last={m[-1]}",
        ]
        if open_end:
            start = " ".join(m[:2]) if m[0] in self.frequent else m[0]
            known = [t for t in dict.fromkeys(m) if not t.startswith(("~", "C~"))][:25]
            out += [f"has={start}|{t}" for t in known]
            out += [f"shape={start}|{min(len(raw), 14)}", f"start,end={start}|{m[-1]}", f"start,end2={start}|{' '.join(m[-2:])}", f"commas={start}|{last.count(',')}", f"first={m[0]}|{' '.join(m[-2:])}"]
        return out


class Maker:
    """Synthetic defects from sound pairs."""

    def __init__(self, pairs: list[tuple[str, str]], seed: int):
        self.random = random.Random(seed)
        self.pairs = pairs
        self.things = [t for q, _ in pairs for t in re.findall(r"\b[oaOA] [^\W\d_]+(?: [^\W\d_]+){1,2}", q)][:4000] or ["o sistema"]
        self.by_language: dict[str, list[str]] = {}
        for _, a in pairs:
            self.by_language.setdefault(language(words(bare(a)))[0], []).append(a)

    def cut(self, a: str) -> str | None:
        """The answer, broken off: at its end, or after something was begun that isn't brought to an end."""
        pick = self.random.choice
        text = a.rstrip()
        if self.random.random() < 0.3:
            stem, thing = text.rstrip("."), pick(self.things)
            other = sentences(pick(self.pairs)[1]) or [thing]
            begun = pick(other).split(" ")
            begun = begun[: max(1, self.random.randrange(len(begun)))]
            return pick([
                f"{stem}, {thing},", f"{stem}, {thing} ({self.random.randint(1, 9999)}", f"{stem}, {thing}, {thing.rsplit(' ', 1)[0]}", f"{text}\n- {thing.split(' ', 1)[1]}\n- {thing[2:6]}", f"{stem}:\n1. {' '.join(begun)}",
                f"{text} {' '.join(begun)} {pick(['o', 'a', 'os', 'de', 'da', 'do', 'e', 'que', 'entre', 'the', 'of', 'la', 'del'])}", f"{text} Isso ocorre porque {thing} {pick(['e', 'de', 'com', 'não', 'que'])}", f"{text} {' '.join(begun)}",
            ])
        plain = [i for i, c in enumerate(text) if c == " "]
        if len(plain) < 4:
            return None
        r = self.random.random()
        if r < 0.5:  # between words, late
            at = self.random.choice(plain[max(1, len(plain) - 14) :])
        elif r < 0.75:  # within a word, anywhere
            word = self.random.choice(plain[1:])
            end = next((i for i in plain if i > word), len(text))
            at = word + self.random.randint(2, max(2, end - word - 2))
        else:
            at = self.random.choice(plain[1:])
        out = text[:at].rstrip()
        if len(out) >= len(text) - 1 or not out or out[-1] in ".!?”\"":
            return None
        if self.random.random() < 0.15:
            out += self.random.choice(["…", "...", ",", " -"])
        elif self.random.random() < 0.1:
            out += "\n- " + self.random.choice(self.things).split(" ")[0]
        return out

    def case(self, t: str) -> str:
        r = self.random.random()
        return t.upper() if r < 0.15 else t if r < 0.25 else t[:1].upper() + t[1:]

    def refusal(self) -> str:
        pick = self.random.choice
        k = self.random.choices(["pt", "es", "en"], [6, 1, 1])[0]
        if self.random.random() < 0.4:
            plural = self.random.random() < 0.6
            core = pick(SUBJECT[k]) + " " + pick(LACK[k]).replace("{m}", "m" if plural else "").replace("{em}", "em" if plural else "")
        else:
            core = pick(DECLINE[k])
        t = pick(OPENING[k]) + core + pick(CLOSING[k])
        t = re.sub(r"\{x\}", lambda _: pick(self.things), t)
        return self.case(t) + pick([".", ".", ".", "", "!"])

    def copied(self, q: str) -> str:
        pick, t = self.random.choice, q.strip()
        r = self.random.random()
        if r < 0.25:
            w = t.split(" ")
            if len(w) > 4:
                i = self.random.randrange(len(w) - 1)
                w[i : i + 1] = [] if self.random.random() < 0.5 else [w[i], pick(["mesmo", "então", "também"])]
            t = " ".join(w)
        if r > 0.7:
            t = t.rstrip("?") + pick([".", "", "...", "!"])
        if self.random.random() < 0.1:
            t = f"{t} {t}"
        t = pick(["", "", "", "Você perguntou: ", "A pergunta é: ", "Pergunta: ", "[1] ", "You asked: ", "Usted preguntó: ", "Sobre a pergunta: "]) + t
        return pick([str, str, str, str.lower, str.upper])(t)

    def foreign(self, q: str, a: str) -> str | None:
        own = language(words(q))[0]
        others = [k for k, v in self.by_language.items() if k not in (own, "?") and len(v) >= 5]
        return self.random.choice(self.by_language[self.random.choice(others)]) if others else None

    def quoting(self, a: str) -> str:
        other = [x for k, v in self.by_language.items() if k not in ("pt", "?") for x in v]
        s = self.random.choice(other) if other else "the original term"
        part = re.split(r"(?<=[.!?])\s", bare(s))[0]
        return a.rstrip() + self.random.choice([f" O termo original é “{part}”.", f" “{part}”, diz o original.", f' Como consta na fonte: "{part}".'])

    def brief(self, a: str) -> str:
        """A short answer: an amount, or one word."""
        pick, amounts = self.random.choice, AMOUNT.findall(a)
        if not amounts or self.random.random() < 0.3:
            return pick(SHORT)
        return pick(["", "", "Sim, ", "Cerca de ", "[1] "]) + pick(amounts) + pick(["", "", "."])

    def hedged(self, sentence: str) -> str:
        k = language(words(sentence))[0]
        return self.case(self.random.choice(HEDGES.get(k, HEDGES["pt"])) + sentence[:1].lower() + sentence[1:])


EMPTY = [None, "", " ", "\n", "\t", " ", "​", "-", "—", "...", "…", ".", "[1]", "[2] [3]", "[1][2]", "N/A", "n/a", "null", "None", "Resposta:", "(sem resposta)", "[4].", "***", "?", "[1] -", "\"\"", "()"]


#: Probability of a defect from which a pair of the sample no longer counts as sound, and from which it is an example of the defect.
DOUBT, SURE = 0.2, 0.6
#: Pairs that the first turn learns from: too few for it to take the sample's own defects, unmarked as yet, for sound by heart.
FIRST = 600


def readable(answer: str | None) -> bool:
    return bool(words(PLACEHOLDERS.sub(" ", bare(answer))))


class Examples:
    """What a turn learns from: the sample, the defect (or doubt) found in each pair so far, and the shape of endings."""

    def __init__(self, pairs: list[tuple[str, str]], found: list[str | None], declining: list[bool], shape: EndShape, seed: int, first: bool = False):
        self.pairs, self.found, self.declining, self.shape, self.seed = pairs, found, declining, shape, seed
        self.halves = [zlib.crc32(f"{q}\n{a}".encode("utf-8", "surrogatepass")) & 1 for q, a in pairs]
        self.used = set(random.Random(seed).sample(range(len(pairs)), FIRST)) if first and len(pairs) > FIRST else range(len(pairs))

    def rows(self, label: str) -> Iterator[tuple[list[str], int, bool, int]]:
        """(features, is the defect, held out, half of the sample) of the label's examples."""
        sound = [p for p, f in zip(self.pairs, self.found) if f is None] or self.pairs
        make = Maker(sound, self.seed)
        pick = make.random.choice
        for i, ((q, a), f, declines, half) in enumerate(zip(self.pairs, self.found, self.declining, self.halves)):
            if i not in self.used:
                continue
            h = make.random.random() < 0.2
            if f == label and label in ("recusa", "outro_idioma", "truncada"):  # found by an earlier turn
                own = sentences(a) if label == "recusa" else [a]
                for s in own:
                    yield self.features(label, q, s), 1, h, half
            if f is not None:
                continue
            yield from ((*row, h, half) for row in getattr(self, label)(make, pick, q, a, declines))

    def features(self, label: str, q: str, a: str) -> list[str]:
        return refusal_features(a) if label == "recusa" else self.shape.features(a) if label == "truncada" else {"vazia": empty_features, "copia": copy_features, "outro_idioma": language_features}[label](q, a)

    def vazia(self, make, pick, q, a, declines):
        yield empty_features(q, a), 0
        yield empty_features(q, pick(EMPTY)), 1

    def copia(self, make, pick, q, a, declines):
        yield copy_features(q, a), 0
        yield copy_features(q, make.copied(q)), 1
        yield copy_features(q, make.copied(q) + " " + a), 0

    def outro_idioma(self, make, pick, q, a, declines):
        yield language_features(q, a), 0
        yield language_features(q, make.quoting(a)), 0
        yield language_features(q, make.brief(a)), 0
        if f := make.foreign(q, a):
            yield language_features(q, f), 1

    def recusa(self, make, pick, q, a, declines):
        own = sentences(a)
        if not declines:  # some sentence reads like a refusal: it is no example of sound ones
            for s in own[:3]:
                yield refusal_features(s), 0
            if own:
                yield refusal_features(make.hedged(own[0])), 0
        for s in sorted({s for _ in range(6) for s in sentences(make.refusal())}):
            yield refusal_features(s), 1

    def truncada(self, make, pick, q, a, declines):
        f, text = self.shape.features, a.rstrip()
        yield f(a), 0
        if text.endswith("."):
            yield f(text[:-1]), 0
        things = [pick(make.things).split(" ", 1)[1] for _ in range(make.random.randint(2, 4))]
        yield f(text + "\n- " + "\n- ".join(things)), 0
        if tail := TAIL.search(a):
            yield f(pick(make.things).capitalize() + ", " + tail[1]), 0
        yield f(make.brief(a)), 0
        for _ in range(4):
            if c := make.cut(a):
                yield f(c), 1


def fit_label(label: str, examples: Examples, last: bool) -> tuple[Hashed, float, tuple[float, float], list[tuple[float, float, float]]]:
    """The label's model, threshold, held-out precision and recall; before the last turn the (least, mean, most) probability of its defect in the sentences of each pair, by a model of the other half of the sample."""
    model = Hashed()
    rows = [(model.cells(f), y, h, half) for f, y, h, half in examples.rows(label)]

    def fitted(some: list) -> Hashed:
        if label == "recusa":  # a sentence counts once, however many answers hold it
            some = list({(r[0].tobytes(), r[1]): r for r in some}.values()) + [(model.cells(refusal_features(w)), 0) for w in SHORT for _ in range(8)]
        return Hashed().fit([r[0] for r in some], np.array([r[1] for r in some]))

    if not last:
        halves = [fitted([r for r in rows if r[3] != k]) if any(r[3] != k for r in rows) else model for k in (0, 1)]
        seen = []
        for (q, a), half in zip(examples.pairs, examples.halves):
            each = [halves[half].probability(examples.features(label, q, s)) for s in (sentences(a) if label == "recusa" else [a])] or [0.0]
            seen.append((min(each), sum(each) / len(each), max(each)))
        return model, 0.5, (0.0, 0.0), seen
    model = fitted([r for r in rows if not r[2]])
    test = [r for r in rows if r[2]]
    p = np.array([model.of_cells(r[0]) for r in test] or [0.0])
    y = np.array([r[1] for r in test] or [0]).astype(bool)
    threshold = best_threshold(p, y, 0.35, 0.75) if y.any() and not y.all() else 0.5
    hit = p >= threshold
    return model, threshold, (float((hit & y).sum() / max(1, hit.sum())), float((hit & y).sum() / max(1, y.sum()))), []


class Model:
    """The five linear models with their thresholds."""

    def fit(self, pairs: list[tuple[str, str]], seed: int = 7, turns: int = 4, each: Callable[[Callable, Iterable], list] = lambda f, labels: [f(x) for x in labels]) -> Model:
        """``each`` maps the fit over the labels; it may run them in parallel."""
        pairs = [(q, a) for q, a in pairs if q and a and readable(a)] or [("Qual é o valor?", "O valor é 3 kWh.")]
        self.shape = EndShape([a for _, a in pairs])
        found: list[str | None] = [None] * len(pairs)
        declining = [False] * len(pairs)
        for turn in range(turns):
            examples = Examples(pairs, found, declining, self.shape, seed + turn, first=turn == 0)
            fitted = dict(zip(LABELS, each(lambda label, e=examples, last=turn == turns - 1: fit_label(label, e, last), LABELS)))
            if turn == turns - 1:
                break
            seen = {k: v[3] for k, v in fitted.items()}
            found, declining = [], []
            for i in range(len(pairs)):
                low, mean, high = seen["recusa"][i]
                p = {k: seen[k][i][0] for k in LABELS} | {"recusa": mean if high >= 0.8 and low >= 0.1 else low}
                found.append(next((k for k in LABELS if p[k] >= SURE), "doubt" if max(p.values()) >= DOUBT else None))
                declining.append(high >= 0.3)
            if found.count(None) < len(pairs) // 3:  # the models find fault with nearly all: they aren't trusted
                found, declining = [None] * len(pairs), [False] * len(pairs)
        self.models = {k: v[0] for k, v in fitted.items()}
        self.thresholds = {k: v[1] for k, v in fitted.items()}
        self.held_out = {k: v[2] for k, v in fitted.items()}
        return self

    def probabilities(self, question: str | None, answer: str | None) -> dict[str, float]:
        q = question or ""
        p = lambda label, f: self.models[label].probability(f)
        if not readable(answer):
            return {"vazia": p("vazia", empty_features(q, answer))}
        own = sentences(answer)
        return {
            "vazia": p("vazia", empty_features(q, answer)), "recusa": min((p("recusa", refusal_features(s)) for s in own), default=0.0), "copia": p("copia", copy_features(q, answer)) if words(q) else 0.0,
            "outro_idioma": p("outro_idioma", language_features(q, answer)) if words(q) else 0.0, "truncada": p("truncada", self.shape.features(answer)),
        }

    def defect(self, question: str | None, answer: str | None) -> str | None:
        p = self.probabilities(question, answer)
        return next((k for k in LABELS if p.get(k, 0.0) >= self.thresholds[k]), None)

    def save(self, spark: SparkSession, path: str) -> None:
        """Written as a one-row table, so that any file system of the session serves."""
        spark.createDataFrame([(bytearray(pickle.dumps(self)),)], "model binary").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Model:
        return Unpickler(io.BytesIO(bytes(spark.read.parquet(path).first()["model"]))).load()


class Unpickler(pickle.Unpickler):
    """Reads models only: names outside this package and NumPy are refused."""

    def find_class(self, module: str, name: str):
        if module.split(".")[0] in ("garimpo", "numpy") or (module, name) in (("builtins", "set"), ("_codecs", "encode")):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't part of a model")


def train_model(df: DataFrame, question: str, answer: str, sample_rows: int = 6000) -> Model:
    """A model from at most about ``sample_rows`` distinct pairs, chosen by a hash of the pair; the labels of a turn are fitted in parallel tasks."""
    spark = df.sparkSession
    pairs = df.select(F.col(question).alias("q"), F.col(answer).alias("a")).where("q is not null and a is not null").distinct()
    total = pairs.count()
    share = max(1, min(1_000_000, int(1e6 * sample_rows / max(1, total))))
    rows = pairs.where(F.pmod(F.xxhash64(F.lit(3), "q", "a"), F.lit(1_000_000)) < share).orderBy("q", "a").limit(2 * sample_rows).collect()

    def each(fit: Callable[[str], object], labels: Iterable[str]) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["n"], pa.array([pickle.dumps(fit(labels[n])) for n in b["n"].to_pylist()], pa.binary())], names=["n", "fitted"])

        fitted = spark.range(0, len(labels), numPartitions=len(labels)).toDF("n").mapInArrow(run, "n long, fitted binary").collect()
        return [pickle.loads(r["fitted"]) for r in sorted(fitted, key=lambda r: r["n"])]

    return Model().fit([(r["q"], r["a"]) for r in rows], each=each)


def defects(df: DataFrame, key: str, question: str, answer: str, model: Model | None = None, sample_rows: int = 6000) -> DataFrame:
    """``(key, defect)``: one row a defective pair, with the first label that applies.

    A null answer is empty; without a question only the answer is judged.  Repeated rows
    come out once; a key with several answers is given the first of their labels.
    """
    model = model or train_model(df, question, answer, sample_rows)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for rows in batches:
            found = [m.defect(q, a) for q, a in zip(rows["q"].to_pylist(), rows["a"].to_pylist())]
            at = pa.array([i for i, d in enumerate(found) if d])
            some = rows.take(at) if len(at) else rows.slice(0, 0)
            yield pa.RecordBatch.from_arrays([some["key"], pa.array([LABELS.index(d) for d in found if d], pa.int32())], names=["key", "rank"])

    pairs = df.select(F.col(key).alias("key"), F.col(question).alias("q"), F.col(answer).alias("a")).where("key is not null").distinct()
    ranked = pairs.mapInArrow(of, f"key {kind.simpleString()}, rank int").groupBy("key").agg(F.min("rank").alias("rank"))
    return ranked.select(F.col("key").alias(key), F.element_at(F.array(*map(F.lit, LABELS)), F.col("rank") + 1).alias("defect"))
