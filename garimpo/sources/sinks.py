"""Where results go: JSON catalogues and reports, texts, chunk lines, the vector index."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.sources.files import file_system, write_file


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept, characters as they are."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, key: str) -> None:
    """The rows as one JSON array in one file, ordered by ``key``; for catalogues and reports, not for corpora."""
    rows = df.select(F.struct(*df.columns).alias("r"), F.col(key).alias("k"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.to_json("r", {"ignoreNullFields": "false", "pretty": "true"}).alias("j")))), lambda x: x["j"]), ",\n")
    rows.agg(F.concat(F.lit("[\n"), lines, F.lit("\n]")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_texts(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", fan_out: int = 1) -> int:
    """One file ``<key>.txt`` a document with its text as UTF-8; the number of files.

    Null texts have no file.  Written by the tasks that hold the rows, without a shuffle;
    with ``fan_out`` above 1 into that many subfolders by a hash of the key, as file
    systems don't bear millions of files in one folder.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for rows in batches:
            for name, part, content in zip(rows["name"].to_pylist(), rows["part"].to_pylist(), rows["content"].to_pylist()):
                write_file(system, f"{root}/{part}/{name}.txt" if fan_out > 1 else f"{root}/{name}.txt", [content.encode("utf-8", "surrogatepass")])
            yield pa.RecordBatch.from_arrays([pa.array([rows.num_rows], pa.int64())], names=["n"])

    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("name"), F.lpad(F.hex(F.pmod(F.xxhash64(key), F.lit(fan_out))), 4, "0").alias("part"), F.col(text).alias("content"))
    return rows.mapInArrow(of, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_index(chunks: DataFrame, path: str, reset: bool = True) -> None:
    """The vector index as Parquet, by category.  Without ``reset`` only chunk ids that aren't there yet are added.

    Known ids are looked for only in the categories that the new rows have; the others
    aren't read.  A chunk keeps its category; one that comes again under another counts as new.
    """
    rows = chunks.dropDuplicates(["chunk_id"]).withColumn("part", F.when(F.col("categoria") != "", F.col("categoria")).otherwise("?"))  # an empty name would come back as null
    if not reset and index_exists(chunks.sparkSession, path):
        there = chunks.sparkSession.read.parquet(path).select("chunk_id", "part")
        rows = rows.join(there.join(rows.select("part").distinct(), "part", "left_semi"), ["chunk_id", "part"], "left_anti")
    rows.write.mode("overwrite" if reset else "append").partitionBy("part").parquet(path)


def index_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")
