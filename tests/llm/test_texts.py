"""Splitting, budgets, packing, repeated lines and leaks against brute force."""

import base64
import os
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from garimpo.llm import leakage, packing, repeated_lines, splitting, token_budget

TOKEN = regex.compile(r"\p{L}+|\p{N}{1,3}|[^ \t\n\x0b\f\r\p{L}\p{N}]+")


def tokens(text):
    return len(TOKEN.findall(text or ""))


# splitting


def long_texts():
    r = random.Random(3)
    parts = ["abc ", "12", "7", "345 ", "\n", ". ", "... ", "X", "É ", "\n\n", "()", "9", "ANEXO A\n", " "]
    rows = {f"k{i}": "".join(r.choice(parts) for _ in range(r.randint(5, 400))) for i in range(60)}
    return rows | {"digits": "1" * 500, "word": "a" * 500, "late": "ab " + "7" * 301 + " cd" * 40, "empty": "", "null": None, "blank": " \n" * 300}


def test_cuts_do_not_depend_on_ranges(spark):
    rows = long_texts() | {"far": ("ab " * 20 + "\n" * 400 + "cd. " + " " * 300) * 5, "blanks": "x " * 30 + " " * 900 + "\n\n" + "y " * 60}
    df = spark.createDataFrame(list(rows.items()), "id string, body string")
    cuts = [sorted((r["id"], r["start"], r["end"]) for r in splitting.split(df, "id", "body", 40, 7, n).collect()) for n in (37, 200, 10_000)]
    assert cuts[0] == cuts[1] == cuts[2]


@pytest.mark.parametrize("range_bytes", [53, 400, 1 << 20])
def test_files_are_split_like_texts(spark, tmp_path, range_bytes):
    rows = {k: v for k, v in long_texts().items() if v} | {"wide": "água €5 😀 çã. " * 80 + "\n\n" + "日本語 " * 90, "far": "ab " * 30 + "\n" * 1500 + "ção " * 50}
    for k, v in rows.items():
        (tmp_path / f"{k}.txt").write_text(v, newline="")
    got = sorted((os.path.basename(r["path"])[:-4], r["piece"], r["start"], r["end"], r["n_tokens"], r["text"]) for r in splitting.split_files(spark, str(tmp_path), 40, 7, range_bytes).collect())
    df = spark.createDataFrame(list(rows.items()), "id string, body string")
    assert got == sorted((r["id"], r["piece"], r["start"], r["end"], r["n_tokens"], r["body"]) for r in splitting.split(df, "id", "body", 40, 7).collect())


@pytest.mark.parametrize("range_chars", [37, 64, 1000])
def test_pieces(spark, range_chars):
    rows = long_texts()
    df = spark.createDataFrame([(k, v, "s", 1) for k, v in rows.items()] * 2 + [(None, "x " * 99, "s", 1)], "id string, body string, section string, piece int")
    got = splitting.split(df, "id", "body", 40, 7, range_chars, keep=("section",)).collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert set(by) == {k for k, v in rows.items() if tokens(v) > 40}
    for key, pieces in by.items():
        text, pieces = rows[key], sorted(pieces, key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(pieces[0]["pieces"])) and pieces[0]["start"] == 0 and pieces[-1]["end"] == len(text)
        for p in pieces:
            assert p["body"] == text[p["start"] : p["end"]] and p["n_tokens"] == tokens(p["body"]) <= 40 and p["section"] == "s"
        for a, b in zip(pieces, pieces[1:]):
            assert tokens(text[b["start"] : a["end"]]) == 7
        whole = "".join(text[p["start"] if i == 0 else pieces[i - 1]["end"] : p["end"]] for i, p in enumerate(pieces))
        assert whole == text


def test_cuts_are_natural(spark):
    text = "\n\n".join(f"CAPÍTULO {i}\n" + "Uma frase curta aqui. " * 6 for i in range(12))
    df = spark.createDataFrame([("a", text)], "id string, body string")
    starts = [r["body"] for r in splitting.split(df, "id", "body", 100, 0).orderBy("piece").collect()]
    assert all(s.startswith("CAPÍTULO") for s in starts)
    with pytest.raises(ValueError):
        splitting.split(df, "id", "body", 10, 5)


def test_one_of_the_texts_of_a_repeated_key(spark):
    texts = ["ab " * 30 + "\n" + "cd. " * 60, "x1 " * 200 + "fim"]
    got = splitting.split(spark.createDataFrame([("a", t) for t in texts], "id string, body string"), "id", "body", 40, 7, 64).orderBy("piece").collect()
    assert any(all(p["body"] == t[p["start"] : p["end"]] and p["n_tokens"] == tokens(p["body"]) for p in got) and got[-1]["end"] == len(t) for t in texts)


def test_whole_texts_are_not_joined(spark):
    """Only ranges meet the cuts; the texts themselves are cut up where they are read."""
    df = spark.createDataFrame([("a", "ab " * 200, "s")], "id string, body string, section string")
    nodes, joins = [splitting.split(df, "id", "body", 40, 7, 64, keep=("section",))._jdf.queryExecution().optimizedPlan()], 0
    while nodes:
        node = nodes.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Join":
            joins += 1
            assert "body" not in [c.output().apply(i).name() for c in below for i in range(c.output().size())]
        nodes += below
    assert joins


# budgets


@pytest.mark.skipif(not os.path.exists(token_budget.VOCABULARY), reason="no vocabulary here")
def test_counts_equal_the_tokenizer(spark):
    import tiktoken

    with open(token_budget.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("own", pat_str=token_budget.PIECES, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    rows = ["", None, " ", "água fria", "1" * 5000, "x" * 3000, "日本語😀", "aaaa bbbb\n\n\n c", "ab" * 300, "d'água l'sabc 'llá it's's", "\u00a0—\u00a0x \u2003\u2003y", "12345a't6"] + ["".join(chr(r.choice([32, 97, 98, 233, 10, 49, 0x4E00, 39, 115, 116, 0xA0, 45, 0x661])) for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(rows)] * 2, "id string, body string")
    got = {int(x["id"]): (x["tokens"], x["bpe_tokens"]) for x in token_budget.token_counts(df, "id", "body").collect()}
    assert got == {i: (tokens(t), len(encoding.encode_ordinary(t or ""))) for i, t in enumerate(rows)}


@pytest.mark.skipif(not os.path.exists(token_budget.VOCABULARY), reason="no vocabulary here")
def test_budget(spark):
    rows = [("a", "um dois três", 3, "x"), ("a", "um dois três", 3, "x"), ("b", "um dois três", 99, "x"), ("c", "", 5, "x"), ("d", "um", None, None), (None, "um", 1, "x")]
    df = spark.createDataFrame(rows, "id string, body string, stored int, source string")
    got = {r["source"]: (r["chunks"], r["tokens"], r["repaired"]) for r in token_budget.budget(df, "id", "body", "stored", ["source"]).collect()}
    assert got == {"x": (3, 6, 1), None: (1, 1, 1)}
    assert token_budget.budget(df.limit(0), "id", "body", "stored", ["source"]).count() == 0


# packing


def test_packing(spark):
    r = random.Random(2)
    sizes = [r.choice([1, 5, 30, 99, 100]) if i % 3 else 40 for i in range(900)] + [101, 350, 0]
    df = spark.createDataFrame([(i, "x " * n, 7) for i, n in enumerate(sizes)] + [(5000, None, 7), (None, "x", 7)], "id long, body string, piece int")
    got = packing.pack(df, "id", "body", 100).collect()
    room, total = {}, {}
    for g in got:
        assert g["n_tokens"] <= 100
        if g["container"] is not None:
            room[g["container"]] = room.get(g["container"], 0) + g["n_tokens"]
        total[g["id"]] = total.get(g["id"], 0) + g["n_tokens"]
    assert max(room.values()) <= 100 and set(room) == set(range(len(room)))
    assert total == {**dict(enumerate(sizes)), 5000: 0, None: 1}
    assert {g["id"] for g in got if g["pieces"] > 1} == {900, 901}
    whole = packing.filling(packing.pack(df, "id", "body", 100), 100).first()
    assert whole["containers"] == len(room) <= whole["least_containers"] * 1.1
    assert packing.pack(df.limit(0), "id", "body", 100).count() == 0


# repeated lines


def test_repeated_lines(spark):
    r = random.Random(4)
    rows = []
    for i in range(200):
        lines = [f"Texto próprio número {r.random()} de {i}" for _ in range(3)] + ["", "curta 1"]
        if i % 2:
            lines.insert(r.randrange(4), f"  Página {i} de 200   do manual")
        if i < 5:
            lines.append("Aviso legal da fonte pequena")
        rows.append((f"c{i:03d}", "\n".join(lines), "grande" if i % 3 else "pequena", i))
    rows += [rows[1], ("z", None, "grande", 1), ("y", "", "grande", 1), (None, "Página 3 de 200 do manual", "grande", 1), ("w", "Página 3 de 200 do manual", None, 1)]
    df = spark.createDataFrame(rows, "id string, body string, source string, line_no int")
    got = {(x["id"], x["line_no"]) for x in repeated_lines.repeated_lines(df, "id", "body", "source").collect()}
    norm = lambda s: " ".join(__import__("re").sub("[0-9]+", "#", s).replace(" ", " ").split()).lower()
    seen, size, where = {}, {}, []
    for k, t, s, _ in set(rows):
        if k is None or s is None or t is None:
            continue
        size.setdefault(s, set()).add(k)
        for i, line in enumerate(t.split("\n"), 1):
            if len(n := norm(line)) >= 15:
                seen.setdefault((s, n), set()).add(k)
                where.append((s, n, k, i))
    want = {(k, i) for s, n, k, i in where if len(seen[s, n]) >= 4 and len(seen[s, n]) >= 0.03 * len(size[s])}
    assert got == want and want
    assert {(x["id"], x["line_no"]) for x in repeated_lines.repeated_lines(df, "id", "body", "source", part_lines=3).collect()} == want
    found = repeated_lines.repeated_lines(df, "id", "body", "source")
    clean = {x["id"]: x for x in repeated_lines.without_lines(df.select("id", "body"), "id", "body", found).collect()}
    assert "Página" not in clean["c001"]["body"] and clean["c001"]["removed"] == len({w for w in want if w[0] == "c001"}) and clean["z"]["body"] is None and len(clean) == 203
    assert repeated_lines.repeated_lines(df.limit(0), "id", "body", "source").count() == 0


@pytest.mark.parametrize("part_lines", [4000, 7])
def test_templates_with_word_slots(spark, part_lines):
    """A line that is different in a word each time is found by its template, however many distinct lines the leaf has."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    rows = [(f"c{i:03d}", f"Compartilhe esta página com {word()} e receba novidades\n{' '.join(word() for _ in range(8))}", "s") for i in range(120)]
    df = spark.createDataFrame(rows, "id string, body string, source string")
    by_line = repeated_lines.repeated_lines(df, "id", "body", "source", part_lines=part_lines)
    assert by_line.count() == 0
    found = repeated_lines.repeated_lines(df, "id", "body", "source", slots=True, part_lines=part_lines)
    got = found.collect()
    assert {(x["id"], x["line_no"]) for x in got} == {(f"c{i:03d}", 1) for i in range(120)}
    assert {(x["template"], x["covers"], x["texts"]) for x in got} == {("compartilhe esta página com * e receba novidades", 120, 1)}
    clean = repeated_lines.without_lines(df, "id", "body", found).collect()
    assert len(clean) == 120 and all("Compartilhe" not in x["body"] and len(x["body"].split()) == 8 for x in clean)


def test_only_lines_of_found_templates_are_counted(spark, monkeypatch):
    """Leaves with enough lines whose templates cover too few texts go no further, with slots or without."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(7))
    rows = [(f"c{i:03d}", f"Aviso legal da fonte para todos\num dois três quatro {' '.join(word() for _ in range(9))}", "s") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, body string, source string")
    seen = []
    real = repeated_lines.opened
    monkeypatch.setattr(repeated_lines, "opened", lambda held, *rest: seen.append((held.select("line").distinct().count(), (out := real(held, *rest)).select("line").distinct().count())) or out)
    for slots in (False, True):
        got = repeated_lines.repeated_lines(df, "id", "body", "source", slots=slots)
        assert {(x["id"], x["line_no"]) for x in got.collect()} == {(f"c{i:03d}", 1) for i in range(40)}
    assert seen == [(41, 1)] * 2


# leaks


def brute_leaks(docs, items, run):
    grams = lambda t: {tuple(w[i : i + run]) for w in [leakage.plain_words(t or "")] for i in range(len(w) - run + 1)}
    known = {k: grams(t) for k, t in items}
    return {(d, k) for d, t in docs if d is not None for k, g in known.items() if g & grams(t)}


@pytest.mark.parametrize("seed", range(3))
def test_leaks(spark, seed):
    r = random.Random(seed)
    vocabulary = [f"p{i}" for i in range(40)] + ["Ação", "água", "É"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 12, 30, 80])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for i in range(120):
        w = [r.choice([*vocabulary, "fora", "x9"]) for _ in range(r.randint(0, 150))]
        if i % 3 == 0:
            own = items[r.randrange(30)][1].split()
            s = r.randrange(max(1, len(own) - 11))
            w[r.randrange(len(w) + 1) :][:0] = []
            at = r.randrange(len(w) + 1)
            w[at:at] = [x.upper() if r.random() < 0.3 else x.replace("ç", "ç").replace("Ação", "AÇÃO") for x in own[s : s + r.randint(9, 20)]]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(500, None), (501, ""), (None, docs[0][1]), docs[3]]
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    for slices, passed in ((64 << 20, 64 << 20), (12_000, 30_000)):
        got = {(x["doc_id"], x["item_id"]) for x in leakage.leaks(a.select("doc_id", "text"), "doc_id", "text", b, "item_id", "text", width=30, slice_bytes=slices, pass_bytes=passed).collect()}
        assert got == brute_leaks(docs, items, 12) and got
    parts = leakage.Index([(str(k), t) for k, t in items], 12, block=3, segment=25)
    assert max(map(len, parts.words)) <= 25
    found = {}
    for k, t in docs:
        if k is not None and t:
            n = [parts.terms[w] for w in leakage.plain_words(t)]
            q = [np.array(n[s:e], np.int32) for s, e in leakage.passages(parts.joined(np.array(n)), 12, 30)]
            found |= leakage.verified(parts, q, leakage.candidates(parts, q, room=50), [k] * len(q))
    assert {(d, int(i)) for d, i in found} == brute_leaks(docs, items, 12)
    assert leakage.leaks(a.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0
    assert leakage.leaks(a, "doc_id", "text", b.limit(0), "item_id", "text").count() == 0
