"""From pages to clean documents: repeated lines, page numbers, text repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import text as T


def repeated_lines(pages: DataFrame, zone: int = 3, min_ratio: float = 0.5, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, key, pages)``: line keys that stand in the first or last ``zone`` filled lines of many pages.

    Many: at least ``max(3, floor(min_ratio * pages))`` of a document of four pages or
    more.  A key counts once a page.  Null pages count as empty pages.  The count is
    aggregated per partition first, so a document with very many pages is no hot key.
    """
    rows = T.filled_lines(F.coalesce(F.col(text), F.lit("")))
    zone_lines = F.concat(F.slice(rows, 1, zone), F.slice(rows, F.greatest(F.size(rows) - (zone - 1), F.lit(1)), F.lit(zone)))
    keys = F.array_distinct(F.filter(F.transform(F.when(F.size(rows) > 0, zone_lines).otherwise(F.array().cast("array<string>")), T.line_key), lambda k: k != ""))
    found = pages.select(doc, F.explode(keys).alias("key")).groupBy(doc, "key").agg(F.count(F.lit(1)).alias("pages"))
    sizes = pages.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    need = F.greatest(F.lit(3), F.floor(F.col("n") * F.lit(float(min_ratio))))
    return found.join(sizes, doc).where((F.col("n") >= 4) & (F.col("pages") >= need)).select(doc, "key", "pages")


def kept_lines(text: Column, repeated: Column) -> Column:
    """The page's lines that are neither repeated (anywhere on the page) nor page numbers."""
    drop = lambda line: F.coalesce(F.array_contains(repeated, T.line_key(line)), F.lit(False)) | T.is_page_number(line)
    return F.array_join(F.filter(T.lines(text), lambda line: ~drop(line)), "\n")


def stripped_pages(pages: DataFrame, zone: int = 3, min_ratio: float = 0.5) -> DataFrame:
    """``pages`` with repeated lines and page numbers taken out, and ``removed_headers`` of the document.

    A document has at most ``2 * zone / min_ratio`` repeated keys, as each page gives no
    more than ``2 * zone``; so the array that joins back is bounded.
    """
    found = repeated_lines(pages, zone, min_ratio).groupBy("doc_id").agg(F.array_sort(F.collect_set("key")).alias("removed_headers"))
    rows = pages.join(found, "doc_id", "left").withColumn("removed_headers", F.coalesce("removed_headers", F.array().cast("array<string>")))
    return rows.withColumn("text", kept_lines(F.coalesce("text", F.lit("")), F.col("removed_headers")))


def clean_documents(pages: DataFrame, zone: int = 3, min_ratio: float = 0.5, drop_references: bool = True, normalise: bool = True) -> DataFrame:
    """One row a document from ``(doc_id, page_no, text[, path])``.

    Paged documents (``.pdf``, or no path given) lose repeated lines and page numbers;
    others only have their pages joined.
    """
    if "path" not in pages.columns:
        pages = pages.withColumn("path", F.concat("doc_id", F.lit(".pdf")))
    pages = pages.withColumn("ext", T.file_suffix(F.col("path"))).withColumn("chars", F.length(F.coalesce("text", F.lit(""))))
    paged = stripped_pages(pages.where("ext = '.pdf'"), zone, min_ratio)
    other = pages.where("ext != '.pdf'").withColumn("removed_headers", F.array().cast("array<string>"))
    rows = paged.unionByName(other).groupBy("doc_id").agg(
        F.first("path").alias("path"), F.first("ext").alias("ext"), F.count(F.lit(1)).cast("int").alias("n_pages"), F.sum("chars").alias("n_chars_raw"),
        F.first("removed_headers").alias("removed_headers"), F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"),
    )
    raw = F.array_join(F.transform("p", lambda page: F.coalesce(page["text"], F.lit(""))), "\n\n")
    rows = T.clean_text(rows.withColumn("text", raw), "text", drop_references, normalise=normalise)
    return rows.select("doc_id", "path", T.file_name(F.col("path")).alias("name"), "ext", "n_pages", "n_chars_raw", F.length("text").cast("long").alias("n_chars_clean"), "removed_headers", "text")


def diagnostics(clean: DataFrame) -> DataFrame:
    return clean.select("doc_id", "n_pages", "n_chars_raw", "n_chars_clean", F.size("removed_headers").alias("n_headers"))
