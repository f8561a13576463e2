"""Sends the package to the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a session; they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_garimpo_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="garimpo-")
    try:
        shutil.copytree(package, os.path.join(folder, "root", "garimpo"), ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(os.path.join(folder, "garimpo"), "zip", os.path.join(folder, "root")))
    finally:
        shutil.rmtree(os.path.join(folder, "root"), ignore_errors=True)
    sc._garimpo_shipped = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run
