"""Raw documents to pages ``(doc_id, page_no, text, path, error)``."""

from __future__ import annotations

import html
import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from garimpo.functions.text import file_name, file_suffix

#: Elements whose whole content is no text of the document.
DROPPED = ("script", "style", "nav", "footer", "header", "noscript")
_SUBTREES = "|".join(DROPPED)
#: A run of adjacent tags, comments and dropped elements is one break between texts.
MARKUP = rf"(?is)(?:<!--.*?-->|<({_SUBTREES})\b[^>]*>.*?</\1\s*>|<[!/?a-z][^>]*>)+"
WORD_NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@F.pandas_udf(StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or "&" not in t else html.unescape(t))


def html_text(source: Column, entities: bool = True) -> Column:
    """Visible text of a page, text nodes on lines of their own; null stays null."""
    text = F.regexp_replace(F.regexp_replace(source, MARKUP, "\n"), r"^\n|\n$", "")
    return unescape(text) if entities else text


@F.pandas_udf(StringType())
def decode_utf8(content: pd.Series) -> pd.Series:
    """UTF-8 without the bytes that aren't."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def docx_paragraphs(content: bytes) -> str:
    """All body paragraphs, then every table row with a filled cell, cells joined by `` | ``."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(WORD_NS + "body")
    tab, br = WORD_NS + "tab", WORD_NS + "br"

    def text(p) -> str:
        out = []
        for node in p.iter():
            if node.tag == WORD_NS + "t":
                out.append(node.text or "")
            elif node.tag == tab:
                out.append("\t")
            elif node.tag == br:
                out.append("\n")
        return "".join(out)

    rows = [text(p) for p in body.findall(WORD_NS + "p")]
    for table in body.findall(WORD_NS + "tbl"):
        for row in table.findall(WORD_NS + "tr"):
            cells = ["\n".join(text(p) for p in cell.findall(WORD_NS + "p")).strip() for cell in row.findall(WORD_NS + "tc")]
            if any(cells):
                rows.append(" | ".join(cells))
    return "\n".join(rows)


def docx_of(paragraphs: list[str]) -> bytes:
    """A document of plain paragraphs."""
    body = "".join(f"<w:p><w:r><w:t xml:space=\"preserve\">{html.escape(p)}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORD_NS[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error", StringType())]))
def read_docx(content: pd.Series) -> pd.DataFrame:
    out = []
    for b in content:
        try:
            out.append((docx_paragraphs(bytes(b)), None))
        except Exception as e:  # noqa: BLE001
            out.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(out, columns=["text", "error"])


def read_pages(spark: SparkSession, folder: str, pdf_pages: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """Pages of all documents of a folder, by the suffix of their file.

    HTML, DOCX and plain text have one page.  PDF pages come from ``pdf_pages``
    ``(doc_id, page_no, text)``, made by any layout reader; a PDF without pages there has an
    error.  An unknown suffix is an error value, or fails the query if ``strict``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.select("path", "content", file_suffix(F.col("path")).alias("ext"), F.regexp_extract(file_name(F.col("path")), r"^(.+?)\.[^.]+$", 1).alias("doc_id"))
    one = lambda rows, text, error=None: rows.select("doc_id", F.lit(1).alias("page_no"), text.alias("text"), "path", (error if error is not None else F.lit(None).cast("string")).alias("error"))
    web = one(files.where("ext in ('.html', '.htm')"), html_text(decode_utf8("content")))
    plain = one(files.where("ext = '.txt'"), decode_utf8("content"))
    word = files.where("ext = '.docx'").withColumn("r", read_docx("content"))
    out = web.unionByName(plain).unionByName(one(word, F.col("r.text"), F.col("r.error")))
    pdf = files.where("ext = '.pdf'").select("doc_id", "path")
    if pdf_pages is not None:
        rows = pdf.join(pdf_pages.select("doc_id", "page_no", "text"), "doc_id", "left")
    else:
        rows = pdf.withColumn("page_no", F.lit(None).cast("int")).withColumn("text", F.lit(None).cast("string"))
    out = out.unionByName(rows.select("doc_id", "page_no", "text", "path", F.when(F.col("page_no").isNull(), "no pages").alias("error")))
    message = F.concat(F.lit("unsupported format: "), "ext", F.lit(" ("), file_name(F.col("path")), F.lit(")"))
    other = files.where("ext not in ('.pdf', '.docx', '.html', '.htm', '.txt')")
    return out.unionByName(other.select("doc_id", F.lit(None).cast("int").alias("page_no"), F.lit(None).cast("string").alias("text"), "path", (F.raise_error(message).cast("string") if strict else message).alias("error")))
