"""Lines that come back in very many texts of one source, and their removal.

Lines are normalised (digit runs to ``#``, runs of blanks to one space, trimmed, lower
case) and run down a fixed-depth token tree: first by their number of tokens, then by
their first tokens, a token with a digit being a wildcard.  Counting leaves with a
partial and a final aggregate merges the trees of all partitions; a leaf holds at least
as many texts as any of its lines.  The leaves that cover enough texts are opened: their
distinct lines are clustered into templates with wildcard slots, and a template is found
if the texts that hold any of its lines, each counted once, are enough.  With ``slots``
that decides; without, a line has to be in enough texts by itself as well, and only lines
of found templates are counted for that: a template covers at least what each line does.

A source that holds a third of all texts is no hot key: counts are aggregated per
partition first, and exact counts are by (source, line, text) before (source, line).  A
leaf with very many distinct lines is clustered in salted parts of at most ``part_lines``,
whose templates are then clustered with each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm.common import batch
from garimpo.plans.tables import cut, small

TEMPLATE_SQL = "source string, leaf long, line string, template string"
TEMPLATE = pa.schema([("source", pa.string()), ("leaf", pa.int64()), ("line", pa.string()), ("template", pa.string())])
#: A slot of a template.
SLOT = "*"


def normalised(text):
    """The text with all its lines in normal form (but for trimming)."""
    t = F.regexp_replace(text, r"[0-9]+", "#")
    return F.lower(F.regexp_replace(t, "[ \t\u00a0]+", " "))


def lines_of(df: DataFrame, key: str, text: str, source: str, shortest: int, depth: int) -> DataFrame:
    """``(source, key, line_no, line, leaf)`` of every line that is long enough."""
    rows = df.select(F.col(source).alias("source"), F.col(key).alias("key"), F.posexplode(F.split(normalised(F.col(text)), "\n")).alias("i", "raw"))
    rows = rows.select("source", "key", (F.col("i") + 1).cast("int").alias("line_no"), F.trim("raw").alias("line")).where(F.length("line") >= shortest)
    head = F.regexp_replace(F.substring_index("line", " ", depth), r"[^ ]*#[^ ]*", "*")
    width = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    return rows.withColumn("leaf", F.xxhash64(width, head))


def clustered(lines: list[str], counts: list[int], share: float) -> list[str]:
    """The template of each line, most frequent lines first: of the templates of a line's width the first that agrees in a ``share`` of its tokens; tokens that differ become slots."""
    order = sorted(range(len(lines)), key=lambda i: (-counts[i], lines[i]))
    tokens = [line.split(" ") for line in lines]
    number: dict[str, int] = {SLOT: 0}
    ids = [np.array([number.setdefault(t, len(number)) for t in w]) for w in tokens]
    names = list(number)
    held: dict[int, np.ndarray] = {}  # width -> templates, one a row, with room for more
    used: dict[int, int] = {}
    of: list[tuple[int, int]] = [(0, 0)] * len(lines)
    for i in order:
        w, width = ids[i], len(ids[i])
        known = held.setdefault(width, np.zeros((4, width), np.int64))
        n = used.get(width, 0)
        same = known[:n] == w
        near = np.flatnonzero((same | (known[:n] == 0) | (w == 0)).sum(axis=1) >= share * width)
        if len(near):
            at = int(near[0])
            known[at][~same[at]] = 0
        else:
            at = n
            if n == len(known):
                known = held[width] = np.concatenate((known, np.zeros_like(known)))
            known[at] = w
            used[width] = n + 1
        of[i] = width, at
    return [" ".join(names[t] for t in held[width][at]) for width, at in of]


def templates(share: float):
    """Cluster the lines of a group ``(source, leaf, line, texts)``."""

    def of(rows: pa.Table) -> pa.Table:
        lines = rows["line"].to_pylist()
        return pa.Table.from_batches([batch(TEMPLATE, rows["source"].to_pylist(), rows["leaf"].to_pylist(), lines, clustered(lines, rows["texts"].to_pylist(), share))])

    return of


def formed(by_line: DataFrame, alike: float, part_lines: int) -> DataFrame:
    """``(source, leaf, line, template)`` of the distinct lines: in salted parts of their leaf, then the parts' templates with each other."""
    leaf = ["source", "leaf"]
    sizes = by_line.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / part_lines).cast("int").alias("parts"))
    rows = by_line.join(small(cut(sizes)), leaf).withColumn("part", F.pmod(F.xxhash64("line"), F.col("parts")))
    first = cut(rows.select(*leaf, "part", "line", "texts").groupBy(*leaf, "part").applyInArrow(templates(alike), TEMPLATE_SQL))
    drafts = first.join(by_line, [*leaf, "line"]).groupBy(*leaf, F.col("template").alias("line")).agg(F.sum("texts").alias("texts"))
    final = drafts.groupBy(*leaf).applyInArrow(templates(alike), TEMPLATE_SQL).select(*leaf, F.col("line").alias("draft"), "template")
    return first.withColumnRenamed("template", "draft").join(final, [*leaf, "draft"]).select(*leaf, "line", "template")


def opened(held: DataFrame, parsed: DataFrame, covers: DataFrame) -> DataFrame:
    """The lines, text by text, of the templates that cover enough; all that follows sees no others."""
    kept = cut(parsed.join(small(covers), ["source", "leaf", "template"]))
    return held.join(small(kept), ["source", "leaf", "line"])


def repeated_lines(
    df: DataFrame, key: str, text: str, source: str, share: float = 0.03, least: int = 4, shortest: int = 15, depth: int = 4, alike: float = 0.7, slots: bool = False, part_lines: int = 4000,
) -> DataFrame:
    """``(source, key, line_no, line, template, texts, covers)``: every line whose template
    is in at least ``least`` texts and a ``share`` of the texts of its source; without
    ``slots`` the line itself has to be, too.

    Texts are counted by distinct key; null texts and rows without source are left out.
    ``line`` is the normal form, ``texts`` and ``covers`` are the numbers of texts of the
    source that hold the line, and any line of its template.
    """
    rows = df.where(F.col(source).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    sizes = rows.groupBy(F.col(source).alias("source")).agg(F.count_distinct(F.col(key)).alias("size"))
    sizes = cut(sizes.select("source", F.greatest(F.lit(float(least)), F.col("size") * F.lit(share)).alias("need")))
    lines = lines_of(rows, key, text, source, shortest, depth)
    leaves = lines.groupBy("source", "leaf").agg(F.count(F.lit(1)).alias("n")).join(small(sizes), "source").where(F.col("n") >= F.col("need") - 1e-9)
    leaves = cut(leaves.select("source", "leaf"))
    held = cut(lines.join(small(leaves), ["source", "leaf"]))
    # occurrences order the lines for the templates; texts are counted only for lines of templates that cover enough
    seen = cut(held.groupBy("source", "leaf", "line").agg(F.count(F.lit(1)).alias("texts")))
    parsed = cut(formed(seen, alike, part_lines))
    named = ["source", "leaf", "template"]
    # a template's texts, each once, however many of its lines it holds
    covers = held.join(small(parsed), ["source", "leaf", "line"]).groupBy(*named).agg(F.count_distinct("key").alias("covers")).join(small(sizes), "source")
    covers = cut(covers.where(F.col("covers") >= F.col("need") - 1e-9))
    found = cut(opened(held, parsed, covers))
    kept = found.groupBy("source", "leaf", "line", "template", "covers", "need").agg(F.count_distinct("key").alias("texts"))
    if not slots:
        kept = kept.where(F.col("texts") >= F.col("need") - 1e-9)
    return found.select("source", "leaf", "line", "key", "line_no").join(small(cut(kept.select("source", "leaf", "line", "template", "texts", "covers"))), ["source", "leaf", "line"]).select(
        "source", F.col("key").alias(key), "line_no", "line", "template", "texts", "covers"
    ).distinct()


def without_lines(df: DataFrame, key: str, text: str, found: DataFrame) -> DataFrame:
    """``(key, text, removed)``: each key once, its text without the lines found for it."""
    gone = found.groupBy(key).agg(F.collect_set("line_no").alias("gone"))
    rows = df.where(F.col(key).isNotNull()).select(key, text).join(gone, key, "left")
    kept = F.filter(F.split(F.col(text), "\n"), lambda line, i: ~F.array_contains(F.col("gone"), i + 1))
    rows = rows.select(
        key, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text), F.coalesce(F.size("gone"), F.lit(0)).alias("n")
    )
    return rows.select(key, text, F.greatest("n", F.lit(0)).alias("removed")).dropDuplicates([key])
