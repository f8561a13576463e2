import io
import json
import os
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from garimpo.operators import answer as A
from garimpo.operators.report import at_position, chunk_report, first_by, histogram, report_sets
from garimpo.plans import tables
from garimpo.sources import catalogue as C
from garimpo.sources import documents as D
from garimpo.sources import sinks

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(paragraphs, rows):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {NS}><w:body>{p(paragraphs[0])}{table}{"".join(map(p, paragraphs[1:]))}</w:body></w:document>')
    return out.getvalue()


def test_formats(spark):
    cases = [("PDF", "text/html", "x.txt", ".pdf"), ("htm", None, None, ".htm"), (None, "Text/HTML", "a.pdf", ".html"), ("odt", "application/msword", "", ".docx"), ("", None, "h/a.PDF?x=1", ".pdf"), (None, None, "a.htm", ".htm"), (None, None, "a.bin", ".pdf"), (None, None, None, ".pdf")]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, tipo string, ct string, url string, want string")
    assert rows.where(C.resolve_format(F.col("tipo"), F.col("ct"), F.col("url")) != F.col("want")).count() == 0


def test_html(spark):
    cases = {
        "<p>a</p><p>b</p>": "a\nb", "<p>a</p>\n<p>b</p>": "a\n\n\nb", "a<!-- x > y -->b": "a\nb", "<script>if (a<b) '</p>'</script>x": "x", "<b>a</b>c <i>d</i>": "a\nc \nd",
        "<title>t</title><nav>n</nav><footer>f</footer><header>h</header><noscript>z</noscript><style>s</style>z": "t\nz", "a &amp; b &eacute;": "a & b é", "1 < 2": "1 < 2", "": "",
    }
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, h string").coalesce(1)
    assert [r["t"] for r in rows.orderBy("i").select(D.html_text(F.col("h")).alias("t")).collect()] == list(cases.values())


def test_pages_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("água\xff".encode("latin-1") + "é".encode())
    (tmp_path / "b.html").write_text("<p>olá</p>")
    (tmp_path / "c.docx").write_bytes(docx(["um", "dois"], [["x", "y"], ["", ""]]))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.odt").write_bytes(b"x")
    pdf = spark.createDataFrame([("d", 1, "p1"), ("d", 2, "p2")], "doc_id string, page_no int, text string")
    got = {(r["doc_id"], r["page_no"]): (r["text"], r["error"]) for r in D.read_pages(spark, str(tmp_path), pdf).collect()}
    assert got["a", 1] == ("guaé", None) or got["a", 1][0].endswith("é")
    assert got["b", 1][0] == "olá" and got["c", 1][0] == "um\ndois\nx | y" and got["d", 2][0] == "p2"
    assert got["e", None][1] == "no pages" and "unsupported" in got["f", None][1] and got["bad", 1][0] is None and got["bad", 1][1]


def test_fetch(spark, tmp_path):
    web, raw = tmp_path / "web" / "h.example", str(tmp_path / "raw")
    web.mkdir(parents=True)
    (web / "a.pdf").write_bytes(b"123")
    (web / "z.txt").write_bytes(b"")
    rows = spark.createDataFrame([("a", "https://h.example/a.pdf?v=2", None, None), ("gone", "https://h.example/none.pdf", "pdf", True), ("z", "https://h.example/z.txt", None, False), (None, "x", None, None)], "id string, url string, tipo string, insecure boolean")
    run = lambda **k: {r["id"]: r for r in C.fetch(rows, C.FolderFetcher(str(tmp_path / "web")), raw, tasks=2, **k).collect()}
    got = run()
    assert got["a"]["downloaded"] and got["a"]["bytes"] == 3 and got["a"]["local_path"].endswith("a.pdf")
    assert not got["gone"]["downloaded"] and "FileNotFoundError" in got["gone"]["error"] and not got["z"]["downloaded"] and got["z"]["error"] == ""
    (web / "a.pdf").write_bytes(b"12345")
    assert run()["a"]["bytes"] == 3 and run(overwrite=True)["a"]["bytes"] == 5
    files = C.raw_files(spark, raw)
    assert {r["id"] for r in C.missing(rows.where("id is not null"), files).collect()} == {"gone", "z"}  # an empty file is no file
    assert C.fetch_summary(C.fetch(rows, C.FolderFetcher(str(tmp_path / "web")), raw, tasks=1)).first()["ok"] == 1


@pytest.fixture
def service():
    """A small web service: pages, a redirect, an error, and a chat model that repeats its question."""

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
                return self.end_headers()
            if self.path == "/gone":
                return self.send_error(404)
            body = json.dumps({"models": [{"name": "modelo:7b"}]}).encode() if self.path == "/api/tags" else self.headers["User-Agent"].encode()
            self.answer(body, "text/html; charset=utf-8")

        def do_POST(self):  # noqa: N802
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = f" {[m['role'] for m in asked['messages']]} {asked['messages'][-1]['content'].splitlines()[-1]} {asked['options']} "
            self.answer(json.dumps({"message": {"content": said}}).encode(), "application/json")

        def answer(self, body, kind):
            self.send_response(200)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_fetch_over_http(spark, tmp_path, service):
    rows = spark.createDataFrame([("a", service + "/page", None, True), ("b", service + "/moved", None, False), ("c", service + "/gone", "pdf", None), ("d", "http://127.0.0.1:1/x", None, None)], "id string, url string, tipo string, insecure boolean")
    got = {r["id"]: r for r in C.fetch(rows, C.HttpFetcher(), str(tmp_path / "raw"), timeout=20, tasks=2).collect()}
    assert got["a"]["local_path"].endswith("a.html") and got["b"]["downloaded"] and "404" in got["c"]["error"] and got["d"]["error"]
    assert (tmp_path / "raw" / "a.html").read_text().startswith("Mozilla/5.0")


def test_chat_over_http(spark, service):
    model = A.HttpChat("modelo:3b", service)
    assert model.ready() and not A.HttpChat("outro", service).ready() and not A.HttpChat("modelo", "http://127.0.0.1:1").ready()
    rows = spark.createDataFrame([("Qual?", "[1] x")], "question string, context string")
    say = lambda g: rows.select(g(F.col("question"), F.col("context"), F.lit(None)).alias("a")).first()["a"]
    assert say(A.chat(lambda: model)) == "['system', 'user'] Responda citando as fontes pelos números entre colchetes. {'temperature': 0.0, 'num_ctx': 8192}"
    assert say(A.chat(lambda: model, with_context=False, temperature=0.5, context_tokens=10)) == "['system', 'user'] Qual? {'temperature': 0.5, 'num_ctx': 10}"


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "á", "ano": 2014, "verified": True}, {"id": "b", "titulo": "T"}], ensure_ascii=False))
    rows = C.read_manifest(spark, str(tmp_path / "m.json"))
    assert rows.count() == 2 and rows.where("id = 'b'").first()["ano"] is None
    sinks.write_json_array(rows, str(tmp_path / "out"), "id")
    part = next(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    assert [r["id"] for r in json.loads((tmp_path / "out" / part).read_text())] == ["b", "á"]


def test_index_and_texts(spark, tmp_path):
    rows = spark.createDataFrame([("d::000", "d", "agua", "t", [1.0]), ("d::000", "d", "agua", "t", [1.0]), ("d::001", "d", None, "u", None)], "chunk_id string, doc_id string, categoria string, text string, embedding array<float>")
    path = str(tmp_path / "index")
    sinks.write_index(rows, path)
    sinks.write_index(rows, path, reset=False)
    assert sinks.read_index(spark, path).count() == 2 and set(sinks.read_index(spark, path).columns) == set(rows.columns)
    assert sinks.write_texts(rows.dropDuplicates(["doc_id"]), str(tmp_path / "txt")) == 1 and (tmp_path / "txt" / "d.txt").exists()
    assert sinks.write_texts(rows.limit(0), str(tmp_path / "none"), fan_out=4) == 0
    sinks.write_json_lines(rows, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3


def test_report(spark):
    rows = spark.createDataFrame([("a", "x", "d1", 10), (None, "x", "d1", 21), ("a", None, "d2", 12)], "categoria string, subcategoria string, doc_id string, n_tokens int")
    got = {(r["grupo"], r["valor"]): r["chunks"] for r in report_sets(rows).collect()}
    assert got == {("total", ""): 3, ("categoria", "a"): 2, ("categoria", "?"): 1, ("subcategoria", "x"): 2, ("subcategoria", "?"): 1, ("documento", "d1"): 2, ("documento", "d2"): 1}
    one = chunk_report(rows).first()
    assert (one["total_chunks"], one["tokens_medio"], one["tokens_min"], one["tokens_max"], one["por_categoria"]) == (3, 14.3, 10, 21, {"?": 1, "a": 2})
    empty = chunk_report(rows.limit(0)).first()
    assert (empty["total_chunks"], empty["tokens_medio"], empty["tokens_max"], empty["por_documento"]) == (0, 0.0, 0, {})


def test_histogram(spark):
    rows = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10, 10)] + [(None,)], "v double")
    assert {r["bin"]: r["n"] for r in histogram(rows, "v", 10).collect()} == {1: 1, 2: 1, 6: 1, 10: 2}
    assert histogram(rows.limit(0), "v").count() == 0
    assert histogram(rows.where("v = 10"), "v").first()["n"] == 2


def test_positions_and_numbers(spark):
    rows = spark.createDataFrame([("big", f"c{i:04d}") for i in range(701)] + [("one", "x"), ("two", "a"), ("two", "b"), (None, "z")], "g string, o string").repartition(5)
    got = {r["g"]: r["o"] for r in at_position(rows, "g", "o", 0.5).collect()}
    assert got["big"] == "c0350" and got["one"] == "x" and got["two"] == "b"
    assert {r["g"]: r["o"] for r in first_by(rows, "g", "o", []).collect()}["big"] == "c0000"
    assert [r["n"] for r in tables.numbered(rows.select("o"), "o").orderBy("o").collect()] == list(range(1, 706))
    assert at_position(rows.limit(0), "g", "o", 0.5).count() == 0 and tables.numbered(rows.limit(0), "o").count() == 0


def test_checkpoint_folder(spark, tmp_path, monkeypatch):
    """On a cluster a folder has to be named; one machine may have its own."""

    class Context:
        def __init__(self, master):
            self.master, self.folder = master, None

        getCheckpointDir = lambda self: self.folder  # noqa: E731, N815
        setCheckpointDir = lambda self, folder: setattr(self, "folder", folder)  # noqa: E731, N815
        getConf = lambda self: {}  # noqa: E731, N815

    class Session:
        conf = {}

        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            tables.ensure_checkpoint_dir(Session(master))
    assert tables.ensure_checkpoint_dir(Session("local[2]")).startswith("file://")
