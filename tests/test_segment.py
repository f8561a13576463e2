"""Segmentation: cases written by hand, and what must hold for any document."""

import random
import re

import pytest
from pyspark.sql import functions as F

from garimpo.functions.tokens import count_tokens, vocabulary_counter
from garimpo.operators import segment

DOCS = "doc_id string, titulo string, text string"


def cut(spark, docs, most, least, heads=True, **more):
    rows = segment.chunk_documents(spark.createDataFrame(docs, DOCS), most, least, heads, **more).orderBy("chunk_id").collect()
    return [(r["chunk_id"], r["section"], r["n_tokens"], r["text"]) for r in rows]


#: name, title, text, most, least, break on headings, chunks (section, tokens, text) worked out by hand
CASES = [
    ("fits exactly", "T", "a b c\n\nd e", 5, 1, True, [("T", 5, "a b c\n\nd e")]),
    ("one too many", "T", "a b c\n\nd e f", 5, 1, True, [("T", 3, "a b c"), ("T", 3, "d e f")]),
    ("block at the limit", "T", "a b c d e\n\nf", 5, 1, True, [("T", 5, "a b c d e"), ("T", 1, "f")]),
    ("large block by sentences", "T", "Um dois. Três quatro. Cinco seis.", 6, 1, True, [("T", 6, "Um dois. Três quatro."), ("T", 3, "Cinco seis.")]),
    ("large block of one sentence", "T", "a b c d e f g\n\nh", 5, 1, True, [("T", 7, "a b c d e f g"), ("T", 1, "h")]),
    ("large table stays whole", "T", "a | b | c\nd | e | f", 5, 1, True, [("T", 10, "a | b | c\nd | e | f")]),
    ("text before the first heading", "T", "intro\n\nANEXO A\n\ncorpo", 50, 1, True, [("T", 1, "intro"), ("ANEXO A", 3, "ANEXO A\n\ncorpo")]),
    ("headings in a row", "T", "ANEXO A\n\nANEXO B\n\nfim", 50, 1, True, [("ANEXO A", 2, "ANEXO A"), ("ANEXO B", 3, "ANEXO B\n\nfim")]),
    ("same heading twice merges", "T", "ANEXO A\n\num\n\nANEXO A\n\ndois", 50, 10, True, [("ANEXO A", 6, "ANEXO A\n\num\n\nANEXO A\n\ndois")]),
    ("small but another section", "T", "um dois\n\nANEXO A\n\ntrês", 50, 10, True, [("T", 2, "um dois"), ("ANEXO A", 3, "ANEXO A\n\ntrês")]),
    ("small without room", "T", "a b c d\n\ne f", 5, 3, True, [("T", 4, "a b c d"), ("T", 2, "e f")]),
    ("label without breaks is the later section", "T", "um\n\nANEXO A\n\ndois", 50, 1, False, [("ANEXO A", 4, "um\n\nANEXO A\n\ndois")]),
    ("title missing", None, "um", 5, 1, True, [("title missing", 1, "um")]),
    ("empty", "T", "", 5, 1, True, []), ("null", "T", None, 5, 1, True, []), ("blank", "T", " \n \n\t", 5, 1, True, []),
]


@pytest.mark.parametrize("name,title,text,most,least,heads,expected", CASES, ids=[c[0] for c in CASES])
def test_by_hand(spark, name, title, text, most, least, heads, expected):
    assert cut(spark, [(name, title, text)], most, least, heads) == [(f"{name}::{i:03d}", *e) for i, e in enumerate(expected)]


@pytest.fixture(scope="module")
def many():
    r = random.Random(5)

    def block():
        kind = r.random()
        if kind < 0.2:
            return r.choice(["SEÇÃO X", "2.1 Tema", "CAPÍTULO 9\nnome", "ANEXO B"])
        if kind < 0.3:
            return "a | b\nc | d"
        return " ".join(r.choice(["um", "dois.", "Três", "4", "cinco;"]) for _ in range(r.randint(1, 45)))

    return [(f"d{i:02d}", r.choice(["T", None]), r.choice(["\n\n", "\n \n", "\n\n\n"]).join(block() for _ in range(r.randint(0, 25)))) for i in range(30)]


@pytest.mark.parametrize("heads", [True, False])
def test_invariants(spark, many, heads):
    most, least = 20, 10
    got = cut(spark, many, most, least, heads)
    counted = spark.createDataFrame([(g[3],) for g in got], "t string").select(count_tokens(F.col("t")).alias("n")).collect()
    assert [g[2] for g in got] == [c["n"] for c in counted], "the sums carried through the folds are the counts of the texts"
    for doc, title, text in many:
        own = [g for g in got if g[0].startswith(doc + "::")]
        assert [g[0] for g in own] == [f"{doc}::{i:03d}" for i in range(len(own))]
        assert " ".join(g[3] for g in own).split() == text.split(), "nothing is lost, repeated or moved"
        known = {b.strip().splitlines()[0].strip() for b in re.split(r"\n\s*\n", text) if b.strip()} | {title or doc}
        assert all(g[1] in known for g in own)
        for g in own:
            if g[2] > most:  # one block or sentence that can't be cut
                assert "\n\n" not in g[3] and not re.search(r"[.;:!?] +[A-ZÉ\d]", g[3])
        for a, b in zip(own, own[1:]):  # what could have been merged was
            assert b[2] >= least or a[1] != b[1] or a[2] + b[2] > most
        if heads:  # a chunk holds no heading but its own section's
            for g in own:
                assert {x.splitlines()[0] for x in g[3].split("\n\n") if re.match(r"SEÇÃO X$|CAPÍTULO 9\n|ANEXO B$", x)} <= {g[1]}


def test_other_counters(spark, many):
    """A counter that isn't known to be additive counts merged texts anew; with the same counts nothing changes."""
    same = lambda text: count_tokens(text)
    assert cut(spark, many, 20, 10, counter=same) == cut(spark, many, 20, 10)


def test_counts_of_a_vocabulary(spark, tmp_path):
    import base64

    lines = [base64.b64encode(bytes([b])).decode() + f" {b}" for b in range(256)] + [base64.b64encode(b"ab").decode() + " 256"]
    (tmp_path / "v").write_text("\n".join(lines))
    rows = spark.createDataFrame([("abab c",), ("",), (None,)], "t string")
    counter = vocabulary_counter(str(tmp_path / "v"), r"\S+|\s+")
    assert [r["n"] for r in rows.select(counter("t").alias("n")).collect()] == [4, 0, 0]


def test_ids_grow_past_three_digits(spark):
    docs = spark.createDataFrame([("d", "T", "\n\n".join(["um dois"] * 1100))], DOCS)
    ids = [r["chunk_id"] for r in segment.chunk_documents(docs, 2, 1).select("chunk_id").collect()]
    assert "d::1099" in ids and "d::007" in ids and len(set(ids)) == 1100


def test_extra_and_clashing_columns(spark):
    docs = spark.createDataFrame([("d", "T", "um dois", 2014, "x", "old", 9)], "doc_id string, titulo string, text string, ano int, extra string, section string, n_tokens int")
    row = segment.chunk_documents(docs).first()
    assert (row["ano"], row["extra"], row["section"], row["n_tokens"]) == ("2014", "x", "T", 2)


def test_no_shuffle_and_no_python(spark):
    docs = spark.createDataFrame([("d", "T", "um dois")], DOCS)
    plan = segment.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_sentences(spark):
    rows = spark.createDataFrame([("Um. Dois! três? Quatro; 5 seis: Sete\nOito.\nNove",)], "t string")
    packed = lambda most: rows.select(segment.pack_sentences(F.col("t"), most).alias("p")).first()["p"]
    each = ["Um.", "Dois! três?", "Quatro;", "5 seis:", "Sete\nOito.", "Nove"]
    assert packed(1) == each
    assert packed(4) == ["Um.", "Dois! três?", "Quatro;", "5 seis:", "Sete\nOito. Nove"]
    assert packed(100) == [" ".join(each)]
