"""Splitting oversized texts and files at natural boundaries, without a task ever holding a whole text's tokens.

A text is cut into ranges of characters, a file into ranges of bytes that tasks read by
themselves.  Each range, with a halo on either side, finds the tokens that start in it
and the natural boundaries among them: a heading, paragraph, line or sentence that begins
at a token.  The halo before a range reaches back over blanks to the last character that
isn't one, so boundaries don't depend on where ranges begin.  Ranges report counts and
boundaries; these small tables are stitched per text (prefix sums over the ranges, and
the phase of a digit run that crosses a border, as tokens take three digits at a time),
the cuts are chosen on token numbers, and the cuts' offsets are looked up in the range
that holds the token.  Each range then emits its part of every piece that touches it, and
the parts are joined by key and piece.  A text is passed over once each time, however
many ranges it has; of a file no task reads more than its range and halos.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm.common import batch
from garimpo.plans.tables import cut

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Boundary levels, best last.
SENTENCE, LINE, PARAGRAPH, HEADING = 2, 3, 4, 5
HALO = 96

HEADING_LINE = re.compile(
    r"\s*(?:(?:cap[íi]tulo|se[çc][ãa]o|t[íi]tulo|anexo|parte|chapter|section|annex)\b|art(?:igo)?\.?\s*\d|cr[ée]dito\s+\S|#{1,6}\s|\d+(?:\.\d+){0,3}\.?\s+[^\W\d_])", re.I
)

RANGE_SQL = "key string, version bigint, number int, chars int, tokens int, lead int, whole boolean, tail int, starts binary, marks binary, levels binary"
RANGE = pa.schema(
    [("key", pa.string()), ("version", pa.int64()), ("number", pa.int32()), ("chars", pa.int32()), ("tokens", pa.int32()), ("lead", pa.int32()), ("whole", pa.bool_()), ("tail", pa.int32()), ("starts", pa.binary()), ("marks", pa.binary()), ("levels", pa.binary())]
)
CUT_SQL = "key string, version bigint, range_end int, piece int, pieces int, total int, first int, last int, range_first int, base_first bigint, at_first int, direct_first int, range_last int, base_last bigint, at_last int, direct_last int"
PART_SQL = "key string, version bigint, number int, size int, left int, part string"
PART = pa.schema([("key", pa.string()), ("version", pa.int64()), ("number", pa.int32()), ("size", pa.int32()), ("left", pa.int32()), ("part", pa.string())])
CUT = pa.schema([(x.split()[0], {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[x.split()[1]]) for x in CUT_SQL.split(", ")])


@lru_cache(1)
def char_classes() -> np.ndarray:
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[[9, 10, 11, 12, 13, 32]] = SPACE
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_starts(classes: np.ndarray, carried: int = 0) -> np.ndarray:
    """Starts of tokens; ``carried`` digits of a run stand before the first character."""
    n = len(classes)
    if not n:
        return np.empty(0, np.int64)
    change = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1])))
    run = np.repeat(change, np.diff(np.append(change, n)))
    begins = np.zeros(n, bool)
    begins[change] = True
    since = np.arange(n) - run
    if carried and classes[0] == NUMBER:
        first_run = change[1] if len(change) > 1 else n
        since[:first_run] += carried
        begins[0] = carried % 3 == 0
    digits = classes == NUMBER
    begins[digits] = since[digits] % 3 == 0
    return np.flatnonzero(begins & (classes != SPACE))


def boundary_levels(text: str, classes: np.ndarray, points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Level of the gap before each token start (0: none of the natural ones)."""
    solid = np.where(classes != SPACE, np.arange(len(classes)), -1)
    before = np.concatenate(([-1], np.maximum.accumulate(solid)[:-1]))[starts]
    breaks = np.concatenate(([0], np.cumsum(points == 10)))
    newlines = breaks[starts] - breaks[before + 1]
    level = np.zeros(len(starts), np.uint8)
    gap = starts - before > 1
    stop = np.isin(points, np.frombuffer(".!?;…".encode("utf-32-le"), np.uint32))
    closer = np.isin(points, np.frombuffer("\"')]”’»".encode("utf-32-le"), np.uint32))
    ends = stop[np.maximum(before, 0)] | (closer[np.maximum(before, 0)] & stop[np.maximum(before - 1, 0)])
    level[gap & ends & (before >= 0)] = SENTENCE
    level[gap & (newlines == 1)] = LINE
    level[gap & (newlines > 1)] = PARAGRAPH
    for i in np.flatnonzero(level >= LINE):
        s = int(starts[i])
        end = text.find("\n", s, s + HALO)
        line = text[s : end if end >= 0 else s + HALO].rstrip()
        if end >= 0 and len(line) <= 90 and (HEADING_LINE.match(line) or (line.isupper() and len(line) >= 4 and not line.endswith("."))):
            level[i] = HEADING
    return level


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: tokens that start in it (their offsets in the range) and the natural boundaries among them."""
    table = char_classes()
    for rows in batches:
        out: list[list] = [[] for _ in RANGE]
        for key, version, number, size, left, text in zip(*(rows[c].to_pylist() for c in PART.names)):
            points = code_points(text)
            classes = table[points]
            own = classes[left : left + size]
            if not len(own):
                continue
            lead, whole, tail = 0, False, 0
            if left and classes[left - 1] == own[0] and own[0] != SPACE:  # a run that began in an earlier range
                other = np.flatnonzero(own != own[0])
                lead = int(other[0]) if len(other) else len(own)
                whole = lead == len(own)
            if own[-1] == NUMBER:
                other = np.flatnonzero(own[::-1] != NUMBER)
                tail = int(other[0]) if len(other) else len(own)
            starts = token_starts(classes) if not left else token_starts(classes[left + lead :]) + left + lead
            starts = starts[starts < left + size]
            level = boundary_levels(text, classes, points, starts)
            natural = np.flatnonzero(level)
            digits = own[0] == NUMBER
            for column, value in zip(out, (key, version, number, size, len(starts), lead if digits else 0, whole, tail, (starts - left).astype(np.int32).tobytes(), natural.astype(np.int32).tobytes(), level[natural].tobytes())):
                column.append(value)
        yield batch(RANGE, *out)


def choose(total: int, marks: np.ndarray, levels: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Pieces as token numbers [first, last): best boundary in the last half of the room, then in all of it, else the limit."""
    pieces, first = [], 0
    while total - first > limit:
        last = 0
        for low in (first + limit // 2, first + overlap):
            i, j = np.searchsorted(marks, (low, first + limit), "right")
            if i < j:
                last = int(marks[i:j][np.flatnonzero(levels[i:j] == levels[i:j].max())[-1]])
                break
        last = last or first + limit
        pieces.append((first, last))
        first = last - overlap
    return [*pieces, (first, total)]


def stitch(limit: int, overlap: int):
    def of(rows: pa.Table) -> pa.Table:
        version = pc.min(rows["version"]).as_py()  # of a key's different texts one
        rows = rows.filter(pc.equal(rows["version"], version))
        order = np.argsort(rows["number"].to_numpy())
        _, once = np.unique(rows["number"].to_numpy()[order], return_index=True)  # a repeated delivery repeats its ranges
        rows = rows.take(pa.array(order[once]))
        carried, total, base, marks, levels = 0, 0, [], [], []
        lead_tokens, lead_start = [], []
        for tokens, lead, whole, tail, m, lv in zip(*(rows[c].to_pylist() for c in ("tokens", "lead", "whole", "tail", "marks", "levels"))):
            extra = len(range(-carried % 3, lead, 3)) if lead else 0
            base.append(total)
            lead_tokens.append(extra)
            lead_start.append(-carried % 3)
            marks.append(np.frombuffer(m, np.int32) + total + extra)
            levels.append(np.frombuffer(lv, np.uint8))
            total += tokens + extra
            carried = (carried + lead) if whole and lead else tail
        if total <= limit:
            return CUT.empty_table()
        marks, levels = np.concatenate(marks), np.concatenate(levels)
        pieces = choose(total, marks[marks > 0], levels[marks > 0], limit, overlap)
        numbers, base = rows["number"].to_pylist(), np.array(base)
        begin = np.concatenate(([0], np.cumsum(rows["chars"].to_numpy().astype(np.int64))))

        def place(token: int) -> tuple[int, int, int, int | None]:
            """(range, its first character, number among the range's own starts, offset in the range if the token is in a digit run from an earlier one)."""
            at = int(np.searchsorted(base, token, "right")) - 1
            own = token - int(base[at])
            direct = lead_start[at] + 3 * own if own < lead_tokens[at] else None
            return numbers[at], int(begin[at]), own - lead_tokens[at], direct

        key = rows["key"][0].as_py()
        table = [(key, version, numbers[-1], i, len(pieces), total, f, t, *place(f), *(place(t) if t < total else (-1, int(begin[-1]), 0, None))) for i, (f, t) in enumerate(pieces)]
        return pa.Table.from_batches([batch(CUT, *map(list, zip(*table)))])

    return of


def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("piece", pa.int32()), ("side", pa.string()), ("offset", pa.int32())])
    for rows in batches:
        found = []
        for at, starts, direct in zip(rows["at"].to_pylist(), rows["starts"].to_pylist(), rows["direct"].to_pylist()):
            if direct is not None:
                found.append(direct)
                continue
            found.append(int(np.frombuffer(starts, np.int32, 1, 4 * at)[0]))
        yield batch(schema, rows["key"], rows["piece"], rows["side"], found)


def text_ranges(df: DataFrame, key: str, text: str, range_chars: int) -> DataFrame:
    """``(key, version, number, size, left, part)``: each text's ranges of ``range_chars`` characters; ``part`` holds ``left`` characters of the halo before, the range itself and the halo behind."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key, version, body in zip(rows["key"].to_pylist(), rows["version"].to_pylist(), rows["body"].to_pylist()):
                out: list[list] = [[] for _ in PART]
                for number, begin in enumerate(range(0, len(body), range_chars)):
                    own = body[begin : begin + range_chars]
                    back = max(0, begin - HALO)
                    if back and not own.isspace():
                        while back and body[back : back + HALO].isspace():
                            back = max(0, back - HALO)
                    for column, value in zip(out, (key, version, number, len(own), begin - back, body[back : begin + range_chars + HALO])):
                        column.append(value)
                    if len(out[0]) == 64:
                        yield batch(PART, *out)
                        out = [[] for _ in PART]
                if out[0]:
                    yield batch(PART, *out)

    rows = df.select(F.col(key).cast("string").alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("body"))
    return rows.mapInArrow(of, PART_SQL)


def file_ranges(spark: SparkSession, folder: str, range_bytes: int, longer_than: int = 0) -> DataFrame:
    """The same of the UTF-8 files of a folder: ranges of ``range_bytes`` bytes, each read by its task, with its halos only.

    The key is the file's path.  A range begins at the first character that begins in it;
    bytes that aren't UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") > longer_than)
    files = files.select(F.col("path").alias("key"), F.xxhash64("length", "modificationTime").alias("version"), "length", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {range_bytes} as int)"))).alias("number"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for key, version, length, number in zip(*(rows[c].to_pylist() for c in ("key", "version", "length", "number"))):
                yield batch(PART, *([v] for v in (key, version, number, *file_range(key, length, number * range_bytes, min(length, (number + 1) * range_bytes)))))

    # a range is a row of numbers: they are spread before any byte is read
    return files.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "key", "number").mapInArrow(of, PART_SQL)


def file_range(path: str, length: int, begin: int, end: int) -> tuple[int, int, str]:
    """(characters of the range, of the halo before it, text with halos) of the bytes [begin, end) of a file."""
    from urllib.parse import unquote

    from garimpo.sources.files import file_system

    system, name = file_system(path if "://" in path else unquote(path))
    first = lambda data, at: next((i for i in range(at, min(at + 4, len(data))) if data[i] & 0xC0 != 0x80), min(at + 4, len(data)))
    with system.open_input_file(name) as file:
        reach, behind = 4 * HALO, 4 * HALO + 4
        while True:
            low, high = max(0, begin - reach), min(length, end + behind)
            file.seek(low)
            data = file.read(high - low)
            own = first(data, begin - low) if begin else 0
            stop = first(data, end - low) if end < length else len(data)
            start = first(data, 0) if low else 0
            left, body = data[start:own].decode("utf-8", "replace"), data[own:stop].decode("utf-8", "replace")
            if not low or not left.isspace() or body.isspace():
                break
            reach *= 4
    right = data[stop:].decode("utf-8", "ignore")[:HALO]
    return len(body), len(left), left + body + right


def cut_table(ranges: DataFrame, limit: int, overlap: int, range_chars: int = 0) -> tuple[DataFrame, DataFrame]:
    """(what the ranges found, the pieces as token numbers with the ranges that hold their ends).

    A first range of fewer than ``range_chars`` characters is a whole text; with no more
    tokens than the limit it isn't stitched.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half of limit")
    table = cut(ranges.mapInArrow(scan, RANGE_SQL))
    short = (F.col("number") == 0) & (F.col("chars") < range_chars) & (F.col("tokens") <= limit)
    return table, cut(table.where(~short).drop("starts").groupBy("key").applyInArrow(stitch(limit, overlap), CUT_SQL))


def pieces_of(ranges: DataFrame, limit: int, overlap: int, range_chars: int = 0) -> DataFrame:
    """``(key, version, piece, pieces, start, end, n_tokens, text)`` from ranges."""
    table, cuts = cut_table(ranges, limit, overlap, range_chars)
    sides = cuts.select("key", "version", "piece", F.explode(F.array(
        F.struct(F.lit("first").alias("side"), F.col("range_first").alias("number"), F.col("at_first").alias("at"), F.col("direct_first").alias("direct")),
        F.struct(F.lit("last").alias("side"), F.col("range_last").alias("number"), F.col("at_last").alias("at"), F.col("direct_last").alias("direct")),
    )).alias("s")).select("key", "version", "piece", "s.*").where("number >= 0")
    found = sides.join(table.select("key", "version", "number", "starts").dropDuplicates(["key", "version", "number"]), ["key", "version", "number"]).mapInArrow(offsets, "key string, piece int, side string, offset int")
    at = found.groupBy("key", "piece").agg(F.max(F.when(F.col("side") == "first", F.col("offset"))).alias("from"), F.max(F.when(F.col("side") == "last", F.col("offset"))).alias("upto"))
    pieces = cuts.join(at, ["key", "piece"], "left").withColumn("from", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("from")))
    pieces = pieces.withColumn("range_first", F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("range_first"))).select(
        "key", "version", "piece", "pieces", (F.col("last") - F.col("first")).alias("n_tokens"), "from", "upto", "range_first", "range_last",
        F.when(F.col("piece") == 0, F.lit(0)).otherwise(F.col("base_first") + F.col("from")).alias("start"), (F.col("base_last") + F.coalesce("upto", F.lit(0))).alias("end"),
        F.explode(F.sequence("range_first", F.when(F.col("range_last") >= 0, F.col("range_last")).otherwise(F.col("range_end")))).alias("number"),
    )
    # each range's part of the pieces that touch it; a repeated delivery repeats its parts
    own = ranges.select("key", "version", "number", F.substring("part", F.col("left") + 1, F.col("size")).alias("own"))
    skip = F.when(F.col("number") == F.col("range_first"), F.col("from")).otherwise(F.lit(0))
    upto = F.when(F.col("number") == F.col("range_last"), F.col("upto")).otherwise(F.length("own"))
    parts = pieces.join(own, ["key", "version", "number"]).withColumn("part", F.substring("own", skip + 1, upto - skip))
    rows = parts.groupBy("key", "version", "piece", "pieces", "n_tokens", "start", "end").agg(F.sort_array(F.collect_set(F.struct("number", "part"))).alias("parts"))
    return rows.select("key", "version", "piece", "pieces", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "n_tokens", F.array_join("parts.part", "").alias("text"))


def long_texts(df: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """Rows whose text may have more than ``limit`` tokens."""
    return df.where((F.length(text) > limit) & F.col(key).isNotNull())


def split(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, range_chars: int = 32_768, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(key, piece, pieces, start, end, n_tokens, text, *keep)`` of every text of more than ``limit`` tokens.

    ``piece`` counts from 0; [start, end) are character offsets.  Consecutive pieces share
    exactly ``overlap`` tokens.  Repeated keys count once, with one of their texts; null
    texts and keys have no piece.
    """
    long = long_texts(df, key, text, limit)
    rows = pieces_of(text_ranges(long, key, text, range_chars), limit, overlap, range_chars)
    rows = rows.select(F.col("key").alias("_key"), F.col("version").alias("_version"), "piece", "pieces", "start", "end", "n_tokens", F.col("text").alias("_text"))
    out = [F.col("_key").alias(key), *(F.col(c) for c in ("piece", "pieces", "start", "end", "n_tokens")), F.col("_text").alias(text)]
    if not keep:
        return rows.select(*out)
    kept = long.select(F.col(key).cast("string").alias("_key"), F.xxhash64(text).alias("_version"), F.struct(*keep).alias("_kept")).dropDuplicates(["_key", "_version"])
    return rows.join(kept, ["_key", "_version"]).select(*out, *(F.col("_kept")[c].alias(c) for c in keep))


def split_files(spark: SparkSession, folder: str, limit: int = 1024, overlap: int = 64, range_bytes: int = 1 << 20) -> DataFrame:
    """``(path, piece, pieces, start, end, n_tokens, text)`` of every file of more than ``limit`` tokens, by byte ranges."""
    rows = pieces_of(file_ranges(spark, folder, range_bytes, limit), limit, overlap)
    return rows.select(F.col("key").alias("path"), "piece", "pieces", "start", "end", "n_tokens", "text")


def oversized(df: DataFrame, key: str, text: str, limit: int = 1024, overlap: int = 64, range_chars: int = 32_768) -> DataFrame:
    """Keys of the texts that must be split: those for which cuts were chosen."""
    cuts = cut_table(text_ranges(long_texts(df, key, text, limit), key, text, range_chars), limit, overlap, range_chars)[1]
    return cuts.where("piece = 0").select(F.col("key").alias(key)).distinct()
