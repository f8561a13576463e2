from garimpo.operators import clean


def pages(spark, docs):
    return spark.createDataFrame([(d, i + 1, p) for d, ps in docs.items() for i, p in enumerate(ps)], "doc_id string, page_no int, text string")


HEADER = "Manual {0} de Água\nlinha a{0}\nlinha b{0}\nMIOLO comum no meio\nlinha c{0}\nlinha d{0}\nPág. {0}"


def test_repeated_lines(spark):
    docs = {
        "three": [HEADER.format(i) for i in range(3)], "four": [HEADER.format(i) for i in range(4)], "blank": [HEADER.format(i) for i in range(3)] + [""],
        "ten": ["topo\n" + f"a{chr(97 + i)}\nb\nc\nd\ne\nf" if i < 5 else f"x{chr(97 + i)}\nk\nl\nm\nn\no\np" for i in range(10)], "short": ["rodapé", "rodapé", "rodapé", None],
    }
    got = {(r["doc_id"], r["key"]) for r in clean.repeated_lines(pages(spark, docs)).collect()}
    assert ("four", "manual # de água") in got and ("four", "pág. #") in got and ("blank", "manual # de água") in got
    assert not any(d == "three" for d, _ in got) and ("four", "miolo comum no meio") not in got
    assert ("ten", "topo") in got and ("short", "rodapé") in got


def test_documents(spark):
    docs = pages(spark, {"d": [HEADER.format(i) for i in range(5)]})
    row = clean.clean_documents(docs).first()
    assert row["removed_headers"] == sorted(row["removed_headers"]) and "manual # de água" in row["removed_headers"]
    assert row["n_pages"] == 5 and row["n_chars_raw"] == sum(len(HEADER.format(i)) for i in range(5))
    assert "Manual" not in row["text"] and "MIOLO comum no meio" in row["text"] and row["n_chars_clean"] == len(row["text"])


def test_other_formats_keep_their_lines(spark):
    rows = pages(spark, {"d": ["topo\n12\nfim"] * 5}).selectExpr("*", "'x/d.html' as path")
    row = clean.clean_documents(rows).first()
    assert "12" in row["text"] and row["removed_headers"] == [] and (row["name"], row["ext"]) == ("d.html", ".html")


def test_empty(spark):
    assert clean.clean_documents(pages(spark, {})).count() == 0
    assert clean.repeated_lines(pages(spark, {"d": [None] * 4})).count() == 0
