import numpy as np
import pytest

from garimpo.operators import project, vectors


def index(spark):
    rows = [("a", [1.0, 0.0], "x"), ("b", [2.0, 0.0], "x"), ("c", [0.0, 1.0], "y"), ("d", [-1.0, 0.0], "y"), ("e", [0.0, 0.0], "x"), ("f", None, "x"), ("g", [1.0], "x")]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<double>, cat string")


def queries(spark, rows):
    return spark.createDataFrame(rows, "qid string, embedding array<double>")


def test_ties_and_order(spark):
    got = vectors.search(index(spark), queries(spark, [("q", [3.0, 0.0])]), 4).orderBy("rank").collect()
    assert [(r["rank"], r["chunk_id"], r["distance"]) for r in got] == [(1, "a", 0.0), (2, "b", 0.0), (3, "c", 1.0), (4, "d", 2.0)]


def test_filter_and_small_results(spark):
    q = queries(spark, [("q", [0.0, 1.0]), ("zero", [0.0, 0.0]), ("null", None)])
    assert [r["chunk_id"] for r in vectors.search(index(spark), q, 5, {"cat": "y"}).orderBy("rank").collect()] == ["c", "d"]
    assert vectors.search(index(spark), q, 5, {"cat": "z"}).count() == 0
    assert vectors.search(index(spark).limit(0), q, 5).count() == 0
    assert vectors.search(index(spark), q.limit(0), 5).count() == 0


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    r = np.random.default_rng(0)
    x = r.normal(size=(60, 8))
    rows = spark.createDataFrame([(f"{i:02d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, embedding array<double>")
    got = {(h["qid"], h["chunk_id"]) for h in vectors.search(rows, rows.withColumnRenamed("chunk_id", "qid"), 3).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(f"{i:02d}", f"{j:02d}") for i, d in enumerate(1 - u @ u.T) for j in np.argsort(d)[:3]}
    assert got == want


def test_where(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, s string")
    run = lambda w: [r["n"] for r in rows.where(vectors.compile_where(w)).orderBy("n").collect()]
    assert run({"s": "b"}) == [2] and run({"n": {"$gt": 1, "$lte": 3}}) == [2, 3] and run({"s": {"$in": ["a", "c"]}}) == [1, 3]
    assert run({"$or": [{"n": 1}, {"$and": [{"n": {"$ne": 2}}, {"s": {"$nin": ["a"]}}]}]}) == [1, 3]
    assert vectors.compile_where(None) is None
    with pytest.raises(ValueError):
        vectors.compile_where({"n": {"$near": 1}})


def test_filter_reaches_the_scan(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    plan = rows.where(vectors.compile_where({"label": 3})).select("vec_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan


def test_embedding(spark):
    rows = spark.createDataFrame([("água e energia",), ("água e energia",), (None,), ("",)], "t string").coalesce(1)
    got = [r["v"] for r in rows.select(vectors.embed(rows.t, "passage").alias("v")).collect()]
    assert got[0] == got[1] and got[2] is None and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    other = rows.select(vectors.embed(rows.t, "query").alias("v")).first()["v"]
    assert other != got[0]


def test_sanitised(spark):
    rows = spark.createDataFrame([("c", "d", None, 2014, None)], "chunk_id string, doc_id string, titulo string, ano int, n_tokens int")
    row = vectors.sanitised(rows).first()
    assert (row["titulo"], row["ano"], row["n_tokens"], row["url"]) == ("", "2014", 0, "")


def test_projection(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(80, 6)) * np.array([9, 4, 1, 1, 1, 1])
    rows = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)] + [(99, None, 0)], "id int, v array<double>, label int")
    got = project.project(rows, "v", ["id", "label"]).toPandas()
    assert len(got) == 80 and got.x.var() > got.y.var() > 4
    assert {r["label"] for r in project.dispersion(project.project(rows, "v", ["label"]), "label").collect()} == {0, 1}
    assert (project.perplexity(10), project.perplexity(60), project.perplexity(1000)) == (5, 15, 30)
