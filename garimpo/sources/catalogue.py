"""The document catalogue: reading, format resolution, lookup of raw files, fetching."""

from __future__ import annotations

import io
import os
import ssl
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions.text import file_name
from garimpo.schemas import MANIFEST, MANIFEST_STATUS
from garimpo.sources.files import file_system, write_file

#: Known suffixes in the order in which addresses are tried, marks of content types, headers of a request.
SUFFIXES = (".pdf", ".docx", ".html", ".htm", ".txt")
CONTENT_MARKS = (("pdf", ".pdf"), ("html", ".html"), ("word", ".docx"), ("officedocument", ".docx"))
HEADERS = {"User-Agent": "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/124.0 Safari/537.36", "Accept": "*/*"}
FETCHED_SQL = "id string, local_path string, downloaded boolean, bytes long, error string"


def read_manifest(spark: SparkSession, path: str, status: bool = False) -> DataFrame:
    """A JSON array of documents; absent keys are null."""
    return spark.read.schema(MANIFEST_STATUS if status else MANIFEST).option("multiLine", True).json(path)


def suffix_by_type(tipo: Column) -> Column:
    suffix = F.concat(F.lit("."), F.lower(F.coalesce(tipo, F.lit(""))))
    return F.when(suffix.isin(*SUFFIXES), suffix)


def suffix_by_address(url: Column) -> Column:
    address = F.element_at(F.split(F.lower(F.coalesce(url, F.lit(""))), r"\?"), 1)
    return F.coalesce(*(F.when(address.endswith(suffix), suffix) for suffix in SUFFIXES))


def resolve_format(tipo: Column, content_type: Column, url: Column) -> Column:
    """File suffix by declared type, else content type, else the address, else ``.pdf``."""
    content = F.lower(F.coalesce(content_type, F.lit("")))
    by_content = F.coalesce(*(F.when(content.contains(mark), suffix) for mark, suffix in CONTENT_MARKS))
    return F.coalesce(suffix_by_type(tipo), by_content, suffix_by_address(url), F.lit(".pdf"))


def raw_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(id, path, length)`` of the files ``<id>.<suffix>`` of a folder; contents are not read, empty files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return rows.withColumn("id", F.regexp_extract(file_name(F.col("path")), r"^(.+?)\.[^.]+$", 1))


def locate(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The catalogue with ``path``: of several files of an id the first by name, null if there is none."""
    return manifest.join(files.groupBy("id").agg(F.min("path").alias("path")), "id", "left")


def missing(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Catalogue rows without a raw file."""
    return manifest.join(files.select("id").distinct(), "id", "left_anti")


class FolderFetcher:
    """Fetches documents from a folder tree that mirrors their addresses; any object with ``open`` will do."""

    def __init__(self, root: str):
        self.root = root

    def open(self, url: str, verify: bool, timeout: float):
        """(binary stream, content type)."""
        path = os.path.join(self.root, url.split("://", 1)[-1].split("?")[0].lstrip("/"))
        return open(path, "rb"), None


class HttpFetcher:
    """Fetches documents over HTTP; redirects are followed, certificates of insecure rows aren't verified, an error status is an error."""

    def __init__(self, headers: dict[str, str] | None = None):
        self.headers = HEADERS if headers is None else headers

    def open(self, url: str, verify: bool, timeout: float):
        trust = ssl.create_default_context() if verify else ssl._create_unverified_context()  # noqa: S323
        answer = urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=timeout, context=trust)  # noqa: S310
        return answer, answer.headers.get("Content-Type")


class EchoFetcher:
    """Makes a document of each address's form that holds the address; for dry runs of a catalogue."""

    def open(self, url: str, verify: bool, timeout: float):
        from garimpo.sources.documents import docx_of

        kind = next((s for s in SUFFIXES if url.lower().split("?")[0].endswith(s)), "")
        body = docx_of([url]) if kind == ".docx" else f"<html><body><p>{url}</p></body></html>".encode() if kind in (".html", ".htm") else url.encode()
        return io.BytesIO(body), None


def fetch(manifest: DataFrame, fetcher, folder: str, overwrite: bool = False, timeout: float = 120, tasks: int = 32) -> DataFrame:
    """``(id, local_path, downloaded, bytes, error)``: never fails for a document, its error is a value.

    ``folder`` is one that all executors share (a mounted path, or an address of a file
    system that Arrow knows).  A file that exists is kept unless ``overwrite``.  Nothing
    received counts as not downloaded.
    """

    def of(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = file_system(folder)
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                try:
                    stream, content_type = fetcher.open(row.url, not row.insecure, timeout)
                    with stream:
                        by_content = next((suffix for mark, suffix in CONTENT_MARKS if mark in (content_type or "").lower()), None)
                        path = f"{root}/{row.id}{row.declared or by_content or row.addressed or '.pdf'}"
                        known = system.get_file_info(path)
                        if overwrite or not known.is_file:
                            size = write_file(system, path, iter(lambda: stream.read(65_536), b""))  # noqa: B023
                        else:
                            size = known.size
                    out.append((row.id, path, size > 0, size, ""))
                except Exception as e:  # noqa: BLE001
                    out.append((row.id, "", False, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "local_path", "downloaded", "bytes", "error"])

    rows = manifest.where("id is not null").select("id", "url", suffix_by_type(F.col("tipo")).alias("declared"), suffix_by_address(F.col("url")).alias("addressed"), F.coalesce("insecure", F.lit(False)).alias("insecure"))
    return rows.repartition(tasks, "id").mapInPandas(of, FETCHED_SQL)


def fetch_summary(status: DataFrame) -> DataFrame:
    """Documents, downloaded, failed and kilobytes."""
    return status.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("downloaded").alias("ok"), F.count_if(~F.coalesce("downloaded", F.lit(False))).alias("failed"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / 1024, 1).alias("kb"),
    )

