"""Text functions as columns: lines, blocks, headings, repairs of layout.

All run inside the JVM except ``nfkc``, for which Spark has no function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns that decide what counts as what (Java dialect, Unicode classes).
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
BLOCK_BREAK = r"(?U)\n\s*\n"
SENTENCE_BREAK = r"(?U)(?<=[.!?;:])\s+(?=\p{Lu}|\d)"
PAGE_NUMBER = r"(?iU)^\s*(p[áa]g(?:ina)?\.?\s*)?\d{1,4}\s*(/|de|of)?\s*\d{0,4}\s*$"
REFERENCES = r"(?iU)^\s*(refer[êe]ncias(\s+bibliogr[áa]ficas)?|bibliografia|references)\s*:?\s*$"
STRUCTURED_LINE = r"(?iU)^\s*(\d+(\.\d+)*[).\-–]\s|[a-z][).]\s|[•\-–*]\s|art\.?\s*\d+|cr[ée]dito\s|tabela\s*\d+|requisito\s)"
HEADINGS = (
    r"(?iU)^\s*(CAP[ÍI]TULO|SE[ÇC][ÃA]O|T[ÍI]TULO|ANEXO|PARTE)\b", r"(?iU)^\s*Art(?:igo)?\.?\s*\d+", r"(?iU)^\s*Cr[ée]dito\s+\S", r"(?U)^\s*\d+(\.\d+){0,3}\s+\p{Lu}[^.]{0,80}$",
)
WIDE_SPACES = r"[\u00a0\u2000-\u200b\u202f\u205f\u3000]"
BYTE_ORDER_MARK = "\ufeff"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where it stands inside array functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def lines(text: Column) -> Column:
    """Lines at any line break; a break at the end opens no further line."""
    return let(F.split(text, LINE_BREAK, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def filled_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda line: ~is_blank(line))


def blocks(text: Column) -> Column:
    """What stands between blank lines, without blank blocks."""
    return F.filter(F.split(text, BLOCK_BREAK, -1), lambda block: ~is_blank(block))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_BREAK, -1)


def line_key(line: Column) -> Column:
    """Normal form for comparing lines: digit runs to #, trimmed, lower case, single blanks."""
    return F.regexp_replace(F.lower(strip(F.regexp_replace(line, r"(?U)\d+", "#"))), r"(?U)[\s\x1c-\x1f]+", " ")


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def has_reference_title(line: Column) -> Column:
    return line.rlike(REFERENCES)


def cut_references(text: Column, after: float = 0.6) -> Column:
    """The lines before the first reference title past the share ``after`` of the lines; else the text as it is."""

    def of(all_lines: Column) -> Column:
        past = F.floor(F.size(all_lines) * F.lit(float(after))).cast("int") + 1
        rest = F.slice(all_lines, past + 1, F.greatest(F.size(all_lines) - past, F.lit(0)))
        first = F.array_position(F.transform(rest, has_reference_title), F.lit(True))
        return F.when(first > 0, F.array_join(F.slice(all_lines, F.lit(1), past + first.cast("int") - 1), "\n")).otherwise(text)

    return F.when(text.isNotNull(), let(lines(text), of))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def repair_characters(text: Column, normalise: bool = True) -> Column:
    """Compatibility form, plain spaces, no byte order marks."""
    text = nfkc(text) if normalise else text
    return F.replace(F.regexp_replace(text, WIDE_SPACES, " "), F.lit(BYTE_ORDER_MARK), F.lit(""))


def join_hyphenated(text: Column) -> Column:
    """Words broken by a hyphen at a line's end, put together."""
    return F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2")


def is_structured(block: Column) -> Column:
    """Tables, lists and numbered requirements, whose line breaks mean something."""

    def of(rows: Column) -> Column:
        n = F.size(rows).cast("double")
        count = lambda test: F.size(F.filter(rows, test)).cast("double")
        at_least = lambda share: F.greatest(F.lit(2.0), n * F.lit(share))
        columns = count(lambda line: line.contains("|") | line.contains("\t")) >= at_least(0.5)
        listed = count(lambda line: line.rlike(STRUCTURED_LINE)) >= at_least(0.4)
        short = (count(lambda line: F.length(strip(line)) < 50) >= n * F.lit(0.7)) & (count(lambda line: line.rlike(r"(?U)\d")) >= n * F.lit(0.5))
        return (n > 1) & (columns | listed | short)

    return let(filled_lines(block), of)


def join_prose(block: Column) -> Column:
    """One paragraph on one line."""
    return strip(F.regexp_replace(F.regexp_replace(block, r"[ \t]*\n[ \t]*", " "), r"[ \t]{2,}", " "))


def tidy_lines(block: Column) -> Column:
    """The lines of a structured block without trailing and repeated blanks and without blank lines."""
    tidy = F.transform(lines(block), lambda line: F.regexp_replace(F.regexp_replace(line, r"(?U)[\s\x1c-\x1f]+$", ""), r"[ \t]{2,}", " "))
    return F.array_join(F.filter(tidy, lambda line: ~is_blank(line)), "\n")


def normalise_blocks(text: Column) -> Column:
    bare = F.transform(F.split(text, BLOCK_BREAK, -1), lambda b: F.regexp_replace(b, r"^\n+|\n+$", ""))
    kept = F.filter(bare, lambda b: ~is_blank(b))
    return F.array_join(F.transform(kept, lambda b: F.when(is_structured(b), tidy_lines(b)).otherwise(join_prose(b))), "\n\n")


def clean_layout(text: Column, drop_references: bool = True) -> Column:
    """Hyphenation, references and blocks of a text whose characters are repaired.  Null stays null, empty stays empty."""
    text = join_hyphenated(text)
    text = cut_references(text) if drop_references else text
    return strip(F.regexp_replace(normalise_blocks(text), r"\n{3,}", "\n\n"))


def clean_text(df: DataFrame, column: str = "text", drop_references: bool = True, repair: Callable[[Column], Column] | None = None, normalise: bool = True) -> DataFrame:
    """The column cleaned: an optional repair of wrong decodings, characters, then layout.

    A step of its own for the characters, as their Python function may not stand inside
    array functions.
    """
    if repair:
        df = df.withColumn(column, repair(F.col(column)))
    return df.withColumn(column, repair_characters(F.col(column), normalise)).withColumn(column, clean_layout(F.col(column), drop_references))


def first_line(block: Column) -> Column:
    return strip(F.element_at(lines(strip(block)), 1))


def is_heading(block: Column) -> Column:
    """One or two lines, the first at most 90 characters long and of a heading's form or all in capitals."""

    def of_line(first: Column) -> Column:
        capitals = (F.length(F.regexp_replace(first, r"\P{L}", "")) >= 4) & ~first.rlike(r"[\p{L}&&\P{Lu}]") & ~first.endswith(".")
        form = first.rlike(HEADINGS[0])
        for pattern in HEADINGS[1:]:
            form = form | first.rlike(pattern)
        return (F.length(first) <= 90) & (form | capitals)

    of = lambda rows: F.when(F.size(rows).between(1, 2), let(strip(F.element_at(rows, 1)), of_line)).otherwise(False)
    return F.coalesce(let(filled_lines(block), of), F.lit(False))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def excerpt(text: Column, length: int, mark: str = "...") -> Column:
    return F.concat(F.substring(text, 1, length), F.lit(mark))
