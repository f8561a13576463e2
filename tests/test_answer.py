from pyspark.sql import functions as F

from garimpo.operators import answer as A
from garimpo.operators.vectors import embed


def index(spark):
    rows = [("d::000", "d", "T", "F", "2014", "1 Água", "A água é tratada. Depois volta.", "agua"), ("d::001", "d", "T", None, None, "", "A energia solar cresce. Fim.", "energia")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, titulo string, fonte string, ano string, section string, text string, subcategoria string")
    for c in ("categoria", "vigencia", "url"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    return df.withColumn("n_tokens", F.lit(5)).withColumn("embedding", embed(F.col("text"), "passage"))


def test_answers(spark):
    asked = spark.createDataFrame([("água tratada",), ("energia solar",), (None,)], "question string")
    got = {r["question"]: r for r in A.answer(index(spark), asked, 2).collect()}
    assert got["água tratada"]["answer"] == "A água é tratada. [1]" and got["energia solar"]["answer"] == "A energia solar cresce. [1]"
    assert got["água tratada"]["context"].startswith("[1] (Fonte: F - T, 2014; seção: 1 Água)\nA água")
    assert "[1] (Fonte: ? - T, ?)\n" in got["energia solar"]["context"] and [s["n"] for s in got["energia solar"]["sources"]] == [1, 2]
    none = A.answer(index(spark), asked, 2, {"subcategoria": "x"}).collect()
    assert {r["answer"] for r in none} == {A.REFUSAL} and all(r["sources"] == [] for r in none)


def test_evaluation(spark):
    asked = spark.createDataFrame([(1, "água tratada", True), (2, "sem nada", False)], "n int, question string, comparar boolean")
    answers = A.answer(index(spark), asked.select("question"), 2, {"subcategoria": "agua"})
    rows = {r["n"]: r for r in A.evaluate(answers, asked).collect()}
    assert rows[1]["coberta"] and rows[1]["fontes"] == ["[1] F, T"] and rows[1]["fonte_top"].startswith("F (")
    assert A.coverage(A.evaluate(answers, asked)).first()["perguntas"] == 2
    pair = A.compare(answers, asked).collect()
    assert len(pair) == 1 and pair[0]["fontes_rag"] == ["[1] F"]
    assert A.coverage(A.evaluate(answers, asked).limit(0)).first()["taxa"] == 0


def test_coverage_mark(spark):
    cases = {A.REFUSAL: False, A.REFUSAL.upper(): False, "Texto. A informação não está no corpus consultado. Mais.": False, "Sim [1].": True, "": True}
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "a string").coalesce(1)
    assert [r["c"] for r in rows.select(A.covered(F.col("a")).alias("c")).collect()] == [*cases.values(), False]


def test_readiness():
    def broken():
        raise OSError

    assert A.model_ready(lambda: ["a:1b", "modelo:7b"], "modelo:3b") and not A.model_ready(lambda: ["a"], "modelo:3b") and not A.model_ready(broken, "a")
