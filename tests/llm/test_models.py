"""Fitted operators: held-out accuracy, invariants and odd rows."""

import random

import numpy as np
import pytest

from garimpo.llm import abuse, encoding_repair, pair_defects
from garimpo.llm.linear import Hashed, Trees, fit_logistic, isotonic, probability, score


def test_trees_and_calibration():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    p = Trees(count=40).fit(x[:1500], y[:1500]).raw(x[1500:])
    assert ((p > 0) == y[1500:]).mean() > 0.95
    a, b = isotonic(p, y[1500:])
    assert (np.diff(b) >= -1e-12).all() and (np.diff(a) >= 0).all()


def test_logistic():
    rows = [["a", f"x{i}"] if i % 2 else ["b", f"x{i}"] for i in range(200)]
    model = fit_logistic(rows, np.array([i % 2 for i in range(200)]))
    assert probability(score(model, ["a"])) > 0.8 > 0.2 > probability(score(model, ["b"]))
    hashed = Hashed()
    hashed.fit([hashed.cells(r) for r in rows], np.array([i % 2 for i in range(200)]))
    assert hashed.probability(["a"]) > 0.8 > 0.2 > hashed.probability(["b"]) and hashed.probability(["never seen"]) == hashed.probability([])


# encodings

CLEAN = "A relação entre a pressão e a vazão da água é de 12 m² em operação, segundo o método de Ångström, com 5 € – “ciclo d’água” no verão às 3 ½ horas; manutenção, revisão e avaliação técnica do reservatório não são à parte".split()


def garble(text, chain):
    for wrong, right in reversed(encoding_repair.CHAINS[chain]):
        table = {b: c for c, b in encoding_repair.encoder(wrong).items()}
        text = "".join(chr(table[b]) for b in text.encode(right))
    return text


@pytest.mark.parametrize("chain", list(encoding_repair.CHAINS))
def test_chains_are_undone(chain):
    word = garble("manutenção", chain)
    assert word == "manutenção" or encoding_repair.undo(word, encoding_repair.CHAINS[chain]) == "manutenção"


def test_affected_records(spark):
    r = random.Random(0)
    rows, truth, original = [], {}, {}
    for i in range(1500):
        text = " ".join(r.choice(CLEAN) for _ in range(40))
        original[f"k{i}"] = text
        if i % 25 == 0:
            chain = ["utf_8>cp1252", "utf_8>cp850", "cp1252>mac_roman", "utf_8>cp1252>utf_8>cp1252", "utf_8>cp1251"][i // 25 % 5]
            words = text.split()
            s = 0 if i % 50 else 25
            try:
                text = " ".join(words[:s] + [garble(w.replace("€", "x"), chain) for w in words[s:]])
                truth[f"k{i}"] = chain
            except (KeyError, UnicodeEncodeError):
                pass
        rows.append(("chunks", ["f1", "f2", None][i % 3], f"k{i}", text))
    rows += [("chunks", "f1", "lost", "manuten��o da água"), ("chunks", "f1", "null", None), ("chunks", "f1", "empty", ""), ("chunks", "f1", None, "Ã£Ã£Ã£"), ("titles", "f9", "k1", "Relatório técnico"), rows[0]]
    df = spark.createDataFrame(rows, "field string, source string, key string, text string")
    got = {x["key"]: x for x in encoding_repair.affected(df, repair=True).collect()}
    found, want = set(got), set(truth) | {"lost"}
    assert len(found & want) / len(want) >= 0.95 and len(found - want) <= 3
    assert got["lost"]["chain"] in (encoding_repair.LOSSY, *encoding_repair.NAMES) and got["lost"]["text"] == "manutenção da água"
    bare = lambda t: t.replace("x", "").replace("€", "")  # noqa: E731  (the euro sign stands as x in garbled words only)
    whole = sum(bare(got[k]["text"]) == bare(original[k]) for k in set(truth) & found)
    assert whole >= 0.95 * len(set(truth) & found)
    assert encoding_repair.affected(df.limit(0)).count() == 0


# pairs


@pytest.fixture(scope="module")
def pairs():
    r = random.Random(1)
    nouns = ["o filtro solar", "a bomba central", "o duto lateral", "a calha pluvial", "o painel parcial", "a torre superior", "o ramal vertical", "a laje industrial"]
    verbs = ["alimenta", "regula", "preserva", "controla", "reduz", "mantém"]
    ends = ["durante a madrugada", "com folga de projeto", "nas áreas de circulação", "sem custo adicional"]
    line = lambda: f"{r.choice(nouns).capitalize()} {r.choice(verbs)} {r.choice(nouns)} {r.choice(ends)}."
    english = lambda: f"The {r.choice(['lower', 'upper', 'main'])} pump {r.choice(['feeds', 'controls'])} the {r.choice(['roof', 'garden', 'drain'])} during the dry season and it is not closed at night."
    out = []
    for i in range(500):
        if i % 10 == 0:
            out.append((f"How does the main pump number {i} feed the garden and the roof in the summer?", english() + " " + english()))
        else:
            out.append((f"Como {r.choice(nouns)} {r.choice(verbs)} {r.choice(nouns)} na obra {i}?", " ".join(line() for _ in range(r.randint(1, 4)))))
    return out


def test_defects(spark, pairs, tmp_path):
    rows = [(i, q, a, "x") for i, (q, a) in enumerate(pairs)]
    q = "Como o filtro solar regula a laje industrial na obra 7?"
    cases = {
        "vazia": [None, "", "[1] [2]", "(sem resposta)", "...", "Resposta:", "​"], "recusa": ["Infelizmente não há informação suficiente nos trechos para responder.", "Não sei dizer. Consulte um profissional habilitado."],
        "copia": [q, "Você perguntou: " + q.lower()], "outro_idioma": ["The lower pump controls the roof during the dry season and it is not closed at night."],
        "truncada": ["A bomba central regula o duto lateral durante a madrugada. O painel parcial mantém o", "O filtro solar alimenta a calha pluvial com folga de pro"],
    }
    extra = [(1000 + 50 * i + j, q, a, "x") for i, k in enumerate(cases) for j, a in enumerate(cases[k])]
    df = spark.createDataFrame(rows + extra + extra[:3] + [(None, q, "", "x")], "n int, q string, a string, defect string")
    got = {r["n"]: r["defect"] for r in pair_defects.defects(df, "n", "q", "a").collect()}
    for i, k in enumerate(cases):
        for j, a in enumerate(cases[k]):
            assert got.get(1000 + 50 * i + j) == k, (k, a)
    assert sum(n in got for n in range(500)) <= 15
    once = pair_defects.train_model(df, "q", "a")
    once.save(spark, f"{tmp_path}/model")
    again = {r["n"]: r["defect"] for r in pair_defects.defects(df, "n", "q", "a", pair_defects.Model.load(spark, f"{tmp_path}/model")).collect()}
    assert again == got
    assert pair_defects.defects(df.limit(0), "n", "q", "a").count() == 0


def test_refusals_no_list_foresees(pairs):
    """Wordings beyond the made ones are learned from the sample itself."""
    unseen = "Seria mero palpite responder; as fontes não detalham {}."
    things = ["a cisterna lateral", "o medidor predial", "a janela central", "o brise vertical", "a ducha regional", "o poço de recalque"]
    own = [q for q, _ in pairs if q.startswith("Como")][:12]
    real = [(q, unseen.format(things[i % 6])) for i, q in enumerate(own)]
    model = pair_defects.Model().fit(pairs + real)
    assert sum(model.defect(q, a) == "recusa" for q, a in real) >= 10


def test_held_out_defects(pairs):
    model = pair_defects.Model().fit(pairs)
    for label, (precision, recall) in model.held_out.items():
        assert precision > 0.9 and recall > 0.9, label


# abuse


def test_abuse(spark):
    r = random.Random(2)
    calm = ["A bomba regula a vazão do duto.", "O conector macho entra na fêmea do painel.", "Ovos de verme foram contados na cisterna.", "O regulamento proíbe chamar alguém de idiota.", "A leitura indicou 12 kPa no ramal."]
    rude = ["Você é um idiota completo.", "Cala a boca, seu otário!", "Esse síndico é um 1d10t4.", "Vou quebrar seus dentes.", "Esse povo é uma p r a g a e devia sumir.", "Cala a boca, seu imbeciiil!"]
    rows, labels = [], []
    for i in range(600):
        text = [r.choice(calm) for _ in range(6)]
        if i % 5 == 0:
            text.insert(r.randrange(6), r.choice(rude))
        rows.append((i, " ".join(text), f"s{i % 3}"))
        if i < 400:
            labels.append((i, 1, int(i % 5 == 0) if i % 40 else None))
    labels += [labels[1], (77777, 1, 1)]
    docs = spark.createDataFrame(rows + [(9001, None, "s0"), (9002, "", "s0")], "doc_id long, text string, source string")
    lexicon = spark.createDataFrame([("idiota", "insulto", 2, False), ("otário", "insulto", 2, False), ("verme", "insulto", 1, True), ("macho", "sexual", 1, True), (None, None, None, None)], "termo string, classe string, peso int, ambiguo boolean")
    notes = spark.createDataFrame(labels, "doc_id long, anotador int, abusivo int")
    model = abuse.train_model(docs, "doc_id", "text", notes, "doc_id", "abusivo", lexicon)
    scored = abuse.scores(docs, "doc_id", "text", model, keep=("source",))
    got = {x["doc_id"]: x for x in scored.collect()}
    held = range(400, 600)
    hits = [i for i in held if got[i]["abusive"]]
    assert sum(i % 5 == 0 for i in hits) >= 36 and sum(i % 5 != 0 for i in hits) <= 4
    assert got[9001]["score"] == got[9002]["score"] == 0 and not got[9001]["abusive"] and len(got) == 602
    assert sum(x["documents"] for x in abuse.rates(scored, "source").collect()) == 602
    assert abuse.scores(docs.limit(0), "doc_id", "text", model).count() == 0


def test_disguises():
    reader = abuse.Reader([("otário", "insulto", 2, False), ("sexo", "sexual", 1, True)])
    for text, word in (("um 0tár10 aqui", "otario"), ("um o.t.á.r.i.o aqui", "otario"), ("um s e x o aqui", "sexo"), ("um otáááário aqui", "otario"), ("um o****o aqui", "otario"), ("um OTÁRIO aqui", "otario")):
        (tokens, _, _), = reader.sentences(text)
        assert word in tokens, text
