import pytest
from pyspark.sql import functions as F

from garimpo.functions import text as T
from garimpo.functions.tokens import count_tokens


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return [r["r"] for r in rows.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_page_numbers(spark):
    yes = ["12", "pág. 3", "Página 3 de 40", "2014", "12345678", "  PAG 7 / 9 ", "pagina 12"]
    no = ["Page 3", "12 x", "", "pág.", "123456789"]
    assert apply(spark, T.is_page_number, yes + no) == [True] * len(yes) + [False] * len(no)


def test_lines(spark):
    given = ["a\nb", "a\r\nb\r", "", "\n", "a\x0bb\x0cc\x1cd\u0085e\u2028f\u2029g", "a\n\nb\n"]
    assert apply(spark, T.lines, given) == [v.splitlines() for v in given]


def test_line_keys(spark):
    given = ["  Página 12 de 400 ", "A\u00a0B\t c", "", None]
    assert apply(spark, T.line_key, given) == ["página # de #", "a b c", "", None]


def test_references(spark):
    ten = [f"l{i}" for i in range(10)]
    at = lambda i, t="Referências": "\n".join([*ten[:i], t, *ten[i + 1 :]])
    given = [at(6), at(7), at(2), at(8, "REFERÊNCIAS Bibliográficas :"), at(9, "Bibliografia geral"), "\n".join([*ten[:7], "references", "bibliografia", "x"]), "", None]
    want = [at(6), "\n".join(ten[:7]), at(2), "\n".join(ten[:8]), at(9, "Bibliografia geral"), "\n".join(ten[:7]), "", None]
    assert apply(spark, T.cut_references, given) == want


def test_characters(spark):
    given = ["a\u00a0b\u2009c\u200bd\u202fe\u3000f\ufeffg", "\ufb01m \u00bd \uff11\uff12", None, ""]
    assert apply(spark, T.repair_characters, given) == ["a b c d e fg", "fim 1\u20442 12", None, ""]


def test_hyphens(spark):
    given = ["efici-\nência", "a-\nb-\nc", "A-\nB", "efici-\n\nência"]
    assert apply(spark, T.join_hyphenated, given) == ["eficiência", "ab-\nc", "A-\nB", "efici-\n\nência"]


def test_structured(spark):
    table = "a | b\nc | d\nprosa longa sem coluna nenhuma que passa de cinquenta caracteres\nmais uma linha de prosa que passa de cinquenta caracteres"
    cases = {
        "uma linha | só": False, table: True, "a | b\nprosa corrida\noutra prosa": False, "x\ty\nz\tw": True, "1. um\n2. dois\n3. três": True, "Art. 5 abc\nart 6 def\nfim": True, "• a\n• b": True,
        "linha curta 1\nlinha 2\noutra": True, "prosa sem nada\nmais prosa\ne mais": False, "": False,
    }
    assert apply(spark, T.is_structured, list(cases)) == list(cases.values())


def test_headings(spark):
    cases = {
        "CAPÍTULO 2": True, "seção 1 coisas": True, "SEÇÃO": True, "capitulário": False, "Art. 5 da norma": True, "artigo 7": True, "Crédito EA 1": True, "3.2 Sistemas": True, "3.2 sistemas": False,
        "3.2 Sistemas. Fim": False, "ABCD": True, "ABC": False, "ÁGUA FRIA.": False, "ÁGUA 3,5": True, "Anexo\nsegunda": True, "Anexo\nb\nc": False, "ANEXO " + "x" * 84: True, "ANEXO " + "x" * 85: False, "texto": False, "": False,
    }
    assert apply(spark, T.is_heading, list(cases)) == list(cases.values())


def test_clean(spark):
    given = ["Um parágrafo com\nquebra de li-\nnha.\n\n1. item  um\n2. item dois\n\n\n\n  Fim  \n", "", None, "   \n \n "]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, text string")
    assert [r["text"] for r in T.clean_text(rows).orderBy("i").collect()] == ["Um parágrafo com quebra de linha.\n\n1. item um\n2. item dois\n\nFim", "", None, ""]


def test_tokens(spark):
    assert apply(spark, count_tokens, ["água 12345, (ok)...", "", None]) == [7, 0, 0]


@pytest.mark.parametrize("path,name,suffix", [("a/b/c.PDF", "c.PDF", ".pdf"), (r"C:\x\y.Docx", "y.Docx", ".docx"), ("noext", "noext", ""), (".hidden", ".hidden", "")])
def test_paths(spark, path, name, suffix):
    assert apply(spark, T.file_name, [path]) == [name]
    assert apply(spark, T.file_suffix, [path]) == [suffix]
