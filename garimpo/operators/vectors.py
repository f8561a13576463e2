"""Embedding, normalisation, metadata filters and exact cosine search."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from garimpo.plans.tables import cut
from garimpo.schemas import INDEXED

#: Queries that are broadcast at once: at most so many, of at most so many floats.
QUERY_BLOCK = 4096
#: Blocks that one pass over the index asks at once.
BLOCKS_A_PASS = 8


class Embedder(Protocol):
    """Any model: a name (its cache key), a dimension, and unit vectors for texts."""

    name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic stand-in for a language model: hashed word counts, of unit length."""

    def __init__(self, dim: int = 256):
        self.name, self.dim = f"hashing-{dim}", dim
        self.cells: dict[str, int] = {}

    def cell(self, word: str) -> int:
        """The word's coordinate, with the sign of its count in the lowest bit."""
        if word not in self.cells:
            if len(self.cells) >= 1_000_000:
                self.cells.clear()
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            self.cells[word] = 2 * (h % self.dim) + (h >> 31)
        return self.cells[word]

    def encode(self, texts: list[str]) -> np.ndarray:
        words = [re.findall(r"\w+", t.lower()) for t in texts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        cells = np.fromiter((self.cell(w) for part in words for w in part), np.int64, int(size.sum()))
        at = np.repeat(np.arange(len(words)) * self.dim, size) + (cells >> 1)
        out = np.bincount(at, (cells & 1) * 2.0 - 1, len(words) * self.dim).reshape(len(words), self.dim).astype(np.float32)
        return out / np.maximum(np.linalg.norm(out, axis=1), 1e-12)[:, None]


_LOADED: dict[str, Any] = {}


def embed(text: Column, role: str, load: Callable[[], Embedder] = HashingEmbedder, batch_size: int = 256) -> Column:
    """Vectors of texts with their role prefix (``passage`` or ``query``).

    ``load`` runs once a worker and model; nulls give null.
    """
    name = load().name

    @F.pandas_udf("array<float>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if name not in _LOADED:
            _LOADED[name] = load()
        model = _LOADED[name]
        for part in parts:
            texts = part.tolist()
            known = [i for i, t in enumerate(texts) if isinstance(t, str)]
            vectors: list = [None] * len(texts)
            for s in range(0, len(known), batch_size):
                at = known[s : s + batch_size]
                for i, v in zip(at, model.encode([texts[i] for i in at])):
                    vectors[i] = v
            yield pd.Series(vectors, dtype=object)

    return of(F.concat(F.lit(f"{role}: "), text))


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` values, none of them null, and not all zero."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull()) & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def compile_where(where: dict[str, Any] | None) -> Column | None:
    """A metadata filter as a column: equality, ``$eq $ne $gt $gte $lt $lte $in $nin`` and ``$and $or``."""
    if not where:
        return None
    tests = {
        "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v,
        "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v),
    }
    out: Column | None = None
    for key, value in where.items():
        if key in ("$and", "$or"):
            part = compile_where(value[0])
            for v in value[1:]:
                part = part & compile_where(v) if key == "$and" else part | compile_where(v)
        elif isinstance(value, dict):
            part = None
            for name, v in value.items():
                if name not in tests:
                    raise ValueError(f"unknown operator {name}")
                test = tests[name](F.col(key), v)
                part = test if part is None else part & test
        else:
            part = F.col(key) == value
        out = part if out is None else out & part
    return out


def sanitised(chunks: DataFrame) -> DataFrame:
    """Index rows: text metadata as strings, never null; token count never null."""
    extra = [c for c in ("chunk_id", "text", "embedding") if c in chunks.columns]
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in chunks.columns else F.lit("").alias(c) for c in INDEXED]
    n = F.coalesce(F.col("n_tokens").cast("int"), F.lit(0)) if "n_tokens" in chunks.columns else F.lit(0)
    return chunks.select(*extra[:1], *known, n.alias("n_tokens"), *extra[1:])


def _block_top(queries: list, k: int, key: str, vector: str):
    """Per Arrow batch: the k nearest rows of every query of every block, as matrix products."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("qid", pa.string()), ("key", pa.string()), ("distance", pa.float64())])
        for rows in batches:
            for block in queries:
                ids, q = block.value
                lists = rows[vector]
                fit = np.asarray(pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(lists), q.shape[1]), False))
                at = np.flatnonzero(fit)
                if not len(at) or not len(ids):
                    continue
                x = pa.compute.list_flatten(lists.take(pa.array(at))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(at), -1)
                length = np.linalg.norm(x, axis=1)
                at, x = at[length > 0], x[length > 0] / length[length > 0][:, None]
                names = np.array(rows[key].take(pa.array(at)).cast(pa.string()).to_pylist(), object)
                order = np.argsort(names, kind="stable")
                names, x = names[order], x[order]
                for s in range(0, len(ids), 256):
                    d = np.round(1 - q[s : s + 256] @ x.T, 9)
                    top = np.argsort(d, axis=1, kind="stable")[:, :k]
                    n = top.shape[1]
                    if n:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.repeat(ids[s : s + 256], n), pa.string()), pa.array(names[top.reshape(-1)], pa.string()), pa.array(np.take_along_axis(d, top, 1).reshape(-1))], schema=schema
                        )

    return of


def search(index: DataFrame, queries: DataFrame, k: int = 5, where: dict[str, Any] | None = None, key: str = "chunk_id", vector: str = "embedding", query_key: str = "qid") -> DataFrame:
    """``(qid, rank, key, distance, score)``: the k nearest rows of each query, exactly, ties by key.

    The filter is applied before the search and reaches the scan.  The queries' vectors are
    made once, kept in the shared folder and read in blocks of ``QUERY_BLOCK``, each of them
    a broadcast of at most that many vectors; the index is passed over once for every
    ``BLOCKS_A_PASS`` of them, so tasks hold a bounded number of vectors.  Every batch of the index keeps k rows a query, so
    what is shuffled grows with batches, not rows.  Vectors that are null, of another length
    or zero are never found; such queries find nothing.
    """
    spark = index.sparkSession
    condition = compile_where(where)
    rows = (index if condition is None else index.where(condition)).select(F.col(key).cast("string").alias("key"), F.col(vector).alias("vector"))
    known = queries.where(F.col(query_key).isNotNull() & F.col(vector).isNotNull()).select(F.col(query_key).cast("string").alias("qid"), F.col(vector).alias("vector"))
    known = cut(known)
    blocks = max(1, -(-known.count() // QUERY_BLOCK))
    out, held = None, []
    for b in range(blocks):
        part = (known.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b) if blocks > 1 else known).orderBy("qid").toArrow()
        lists = part["vector"].combine_chunks()
        size = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) if len(part) else np.empty(0, np.int64)
        dim = int(size.max()) if len(size) else 0
        keep = np.flatnonzero(size == dim)
        q = pa.compute.list_flatten(lists.take(pa.array(keep))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(keep), dim) if len(keep) else np.empty((0, dim))
        length = np.linalg.norm(q, axis=1)
        ids = np.array(part["qid"].to_pylist(), object)[keep][length > 0] if len(keep) else np.empty(0, object)
        held.append(spark.sparkContext.broadcast((ids, q[length > 0] / length[length > 0][:, None])))
        if len(held) == BLOCKS_A_PASS or b == blocks - 1:
            hits = rows.mapInArrow(_block_top(held, k, "key", "vector"), "qid string, key string, distance double")
            out, held = hits if out is None else out.unionByName(hits), []
    best = Window.partitionBy("qid").orderBy("distance", "key")
    ranked = out.dropDuplicates(["qid", "key"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("qid", "rank", F.col("key").alias(key), "distance", (F.lit(1.0) - F.col("distance")).alias("score"))
