"""Segmentation of clean documents into token-bounded chunks under headings.

A document is one row, so the ordered, stateful steps are folds over arrays inside the
row: no shuffle, and the folds' states hold numbers of blocks, sentences and chunks, not
text.  Texts are put together once, from the ranges the folds end with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions import text as T
from garimpo.functions.tokens import additive, count_tokens
from garimpo.schemas import INHERITED

Counter = Callable[[Column], Column]
RANGE = "struct<first:int,last:int,section:string,large:boolean,n:int>"
SPAN = "struct<first:int,last:int,n:int>"
MERGED = "struct<first:int,last:int,section:string,n:int>"


def pack_counts(counts: Column, target_max: int) -> Column:
    """Ranges of numbers put together, in order, as long as their sum fits; one over the limit stands alone."""
    start = F.struct(F.array().cast(f"array<{SPAN}>").alias("out"), F.lit(0).alias("first"), F.lit(0).alias("n"), F.lit(0).alias("i"))
    span = lambda s: F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["n"].alias("n"))

    def step(s: Column, n: Column) -> Column:
        full = (s["i"] > s["first"]) & (s["n"] + n > target_max)
        return F.struct(
            F.when(full, F.array_append(s["out"], span(s))).otherwise(s["out"]).alias("out"), F.when(full, s["i"]).otherwise(s["first"]).alias("first"),
            F.when(full, n).otherwise(s["n"] + n).alias("n"), (s["i"] + 1).alias("i"),
        )

    return F.aggregate(counts, start, step, lambda s: F.when(s["i"] > s["first"], F.array_append(s["out"], span(s))).otherwise(s["out"]))


def cut_out(parts: Column, r: Column, separator: str) -> Column:
    """The parts of a range as one text."""
    return F.array_join(F.slice(parts, r["first"] + 1, r["last"] - r["first"] + 1), separator)


def sentence_pieces(block: Column, target_max: int, counter: Counter) -> Column:
    """``(text, n)`` of the pieces of a block; n is the sum of their sentences' counts."""
    of = lambda parts: F.transform(pack_counts(F.transform(parts, counter), target_max), lambda r: F.struct(cut_out(parts, r, " ").alias("text"), r["n"].alias("n")))
    return T.let(T.sentences(block), of)


def pack_sentences(block: Column, target_max: int, counter: Counter = count_tokens) -> Column:
    """Sentences of a block put together, with one blank, as long as their token counts fit.

    A sentence over the limit stays whole.
    """
    return F.transform(sentence_pieces(block, target_max, counter), lambda p: p["text"])


def block_table(text: Column, counter: Counter = count_tokens) -> Column:
    """Blocks with token count, heading mark and title."""
    return F.transform(T.blocks(text), lambda b: F.struct(b.alias("text"), counter(b).alias("n"), T.is_heading(b).alias("head"), T.first_line(b).alias("title")))


def pack_blocks(table: Column, section: Column, target_max: int, break_on_heading: bool = True) -> Column:
    """Ranges of blocks: greedy packing that starts anew at headings and around large blocks."""
    start = F.struct(F.array().cast(f"array<{RANGE}>").alias("out"), F.lit(-1).alias("first"), F.lit(0).alias("n"), section.cast("string").alias("section"), F.lit(0).alias("i"))
    make = lambda first, last, title, large, n: F.struct(first.alias("first"), last.alias("last"), title.alias("section"), F.lit(large).alias("large"), n.alias("n"))

    def step(s: Column, b: Column) -> Column:
        title = F.when(b["head"], b["title"]).otherwise(s["section"])
        breaks = b["head"] & F.lit(break_on_heading)
        large = b["n"] > target_max
        flush = (s["first"] >= 0) & (breaks | large | (s["n"] + b["n"] > target_max))
        # a heading closes the open chunk under the old section, a full chunk closes under the current one
        out = F.when(flush, F.array_append(s["out"], make(s["first"], s["i"] - 1, F.when(breaks, s["section"]).otherwise(title), False, s["n"]))).otherwise(s["out"])
        anew = flush | (s["first"] < 0)
        return F.struct(
            F.when(large, F.array_append(out, make(s["i"], s["i"], title, True, b["n"]))).otherwise(out).alias("out"),
            F.when(large, F.lit(-1)).when(anew, s["i"]).otherwise(s["first"]).alias("first"),
            F.when(large, F.lit(0)).when(anew, b["n"]).otherwise(s["n"] + b["n"]).alias("n"), title.alias("section"), (s["i"] + 1).alias("i"),
        )

    return F.aggregate(table, start, step, lambda s: F.when(s["first"] >= 0, F.array_append(s["out"], make(s["first"], s["i"] - 1, s["section"], False, s["n"]))).otherwise(s["out"]))


def merge_small(chunks: Column, target_max: int, target_min: int, counter: Counter = count_tokens) -> Column:
    """``(text, section, n)``: chunks below ``target_min`` joined to the one before, if it has the same section and room.

    With an additive counter the fold holds ranges and sums, and texts are joined at its
    end; any other counter has to count every merged text, so its fold holds texts.
    """
    if not additive(counter):

        def grow(out: Column, c: Column) -> Column:
            last = F.try_element_at(out, F.lit(-1))
            fits = last.isNotNull() & (c["n"] < target_min) & last["section"].eqNullSafe(c["section"]) & (last["n"] + c["n"] <= target_max)
            text = F.concat(last["text"], F.lit("\n\n"), c["text"])
            merged = F.struct(text.alias("text"), last["section"].alias("section"), counter(text).alias("n"))
            return F.when(fits, F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), merged)).otherwise(F.array_append(out, c))

        return F.aggregate(chunks, F.array().cast("array<struct<text:string,section:string,n:int>>"), grow)
    start = F.struct(F.array().cast(f"array<{MERGED}>").alias("out"), F.lit(0).alias("first"), F.lit(None).cast("string").alias("section"), F.lit(0).alias("n"), F.lit(0).alias("i"))
    span = lambda s: F.struct(s["first"].alias("first"), (s["i"] - 1).alias("last"), s["section"].alias("section"), s["n"].alias("n"))

    def step(s: Column, c: Column) -> Column:
        fits = (s["i"] > 0) & (c["n"] < target_min) & s["section"].eqNullSafe(c["section"]) & (s["n"] + c["n"] <= target_max)
        closed = (s["i"] > 0) & ~fits
        return F.struct(
            F.when(closed, F.array_append(s["out"], span(s))).otherwise(s["out"]).alias("out"), F.when(closed, s["i"]).otherwise(s["first"]).alias("first"),
            c["section"].alias("section"), F.when(fits, s["n"] + c["n"]).otherwise(c["n"]).alias("n"), (s["i"] + 1).alias("i"),
        )

    sizes = F.transform(chunks, lambda c: F.struct(c["section"].alias("section"), c["n"].alias("n")))
    ranges = F.aggregate(sizes, start, step, lambda s: F.when(s["i"] > 0, F.array_append(s["out"], span(s))).otherwise(s["out"]))
    texts = F.transform(chunks, lambda c: c["text"])
    return F.transform(ranges, lambda r: F.struct(cut_out(texts, r, "\n\n").alias("text"), r["section"].alias("section"), r["n"].alias("n")))


def chunk_documents(docs: DataFrame, target_max: int = 1024, target_min: int = 512, break_on_heading: bool = True, counter: Counter = count_tokens) -> DataFrame:
    """Chunks of ``(doc_id, text, *metadata)``, numbered ``doc_id::000`` in order.

    The metadata columns are inherited, ``ano`` as a string.  The first section is the
    title, or the id without one.  Empty and null texts have no chunk.  An additive
    counter counts each block, and each sentence of a large block, once.
    """
    kept = [c for c in docs.columns if c not in ("doc_id", "text", "section", "n_tokens", "chunk_id")]
    title = F.coalesce("titulo", F.col("doc_id").cast("string")) if "titulo" in docs.columns else F.col("doc_id").cast("string")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", *(F.col(c).cast("string").alias(c) if c == "ano" else c for c in kept), title.alias("__title"), block_table(F.col("text"), counter).alias("__b"))
    rows = rows.withColumn("__r", pack_blocks(F.col("__b"), F.col("__title"), target_max, break_on_heading))
    size = lambda text, n: n if additive(counter) else counter(text)
    chunk = lambda text, section, n: F.struct(text.alias("text"), section.alias("section"), size(text, n).alias("n"))

    def bodies(r: Column) -> Column:
        large = F.transform(sentence_pieces(F.element_at(F.col("__b"), r["first"] + 1)["text"], target_max, counter), lambda p: chunk(p["text"], r["section"], p["n"]))
        texts = F.transform(F.slice(F.col("__b"), r["first"] + 1, r["last"] - r["first"] + 1), lambda b: b["text"])
        return F.when(r["large"], large).otherwise(F.array(T.let(T.strip(F.array_join(texts, "\n\n")), lambda t: chunk(t, r["section"], r["n"]))))

    rows = rows.withColumn("__c", F.flatten(F.transform("__r", bodies)))
    rows = rows.select("doc_id", *kept, F.posexplode(merge_small(F.col("__c"), target_max, target_min, counter)).alias("i", "c"))
    return rows.select(F.format_string("%s::%03d", F.col("doc_id").cast("string"), "i").alias("chunk_id"), "doc_id", *kept, F.col("c.section").alias("section"), F.col("c.n").alias("n_tokens"), F.col("c.text").alias("text"))


def enrich(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents with the metadata of their catalogue row; each catalogue id counts once."""
    from garimpo.plans.tables import small

    meta = manifest.where("id is not null").select(F.col("id").alias("doc_id"), *INHERITED).dropDuplicates(["doc_id"]).withColumn("ano", F.col("ano").cast("string"))
    return docs.select("doc_id", "text").join(small(meta), "doc_id", "left")


def sections_of_blocks(docs: DataFrame) -> DataFrame:
    """``(doc_id, block_no, heading, section)``: the title of the last heading at or before each block, else the id."""
    from pyspark.sql import Window

    rows = docs.select("doc_id", F.posexplode(F.transform(T.blocks(F.col("text")), lambda b: F.struct(T.is_heading(b).alias("heading"), T.first_line(b).alias("title")))).alias("block_no", "b"))
    so_far = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("b.heading"), F.col("b.title")), ignorenulls=True).over(so_far)
    return rows.select("doc_id", "block_no", F.col("b.heading").alias("heading"), F.coalesce(title, F.col("doc_id").cast("string")).alias("section"))
