"""Table access and lineage control shared by all operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Largest side, in bytes, that is ever hinted as a broadcast.
BROADCAST_LIMIT = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names.

    A session of one machine that names none gets a temporary folder; on a cluster, where
    such a folder would be lost with an executor or unseen by others, none is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder; set it to one that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="garimpo-checkpoints-")
    sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written to the shared folder and the lineage ends there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(df: DataFrame) -> DataFrame:
    """The rows, cut off from their lineage, and the disk of what led to them given back.

    Spark deletes shuffle files and checkpoints only once the driver's JVM has collected the
    objects that stand for them, which a large heap can put off until the end of the query.
    The plan that is given must not be held by the caller, or its files stay.
    """
    spark = df.sparkSession
    sc, rows = spark.sparkContext, cut(df)
    del df
    spark.range(1, numPartitions=1).collect()  # else the scheduler still holds the last of the plan's jobs
    gc.collect()
    released(sc)
    try:
        sc._jsc.sc().listenerBus().waitUntilEmpty(2000)  # events that aren't told yet hold their plan
    except Py4JJavaError:
        pass  # a slow listener only keeps the files longer
    sc._jvm.System.gc()
    return rows


def released(sc: SparkContext, seconds: float = 3.0) -> bool:
    """Wait until the JVM is told of the objects that Python has dropped: Py4J does so in a thread that looks once a second, and until then they count as held."""
    waiting = getattr(sc._gateway._gateway_client, "finalizer_deque", ())
    until = time.monotonic() + seconds
    while waiting and time.monotonic() < until:
        time.sleep(0.02)
    time.sleep(0.02)  # the last one may just be told
    return not waiting


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast only if the plan's size estimate is under ``limit``; else leave the join to Catalyst.

    Estimates of unfiltered scans come from file sizes and those of operators above
    them are upper bounds, so a side that grows with the data loses the hint by itself.
    """
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def bounded(df: DataFrame, row_bytes: int, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The rows, cut off from their lineage and counted; hinted as a broadcast if ``row_bytes`` times their number is under ``limit``."""
    rows = cut(df)
    return F.broadcast(rows) if rows.count() * row_bytes <= limit else rows


def numbered(df: DataFrame, by: str, name: str = "n") -> DataFrame:
    """Rows numbered from 1 in the order of ``by``: sorted in ranges, numbered inside each and shifted by the sizes of those before."""
    rows = df.repartitionByRange(by).sortWithinPartitions(by)
    rows = cut(rows.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")))
    # one row a partition
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("size"), F.min("__i").alias("first"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("__p", (F.coalesce(F.sum("size").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    return rows.join(F.broadcast(shifts), "__p").select((F.col("__i") + F.col("shift")).alias(name), *df.columns)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input with fewer partitions than cores, spread over all of them; a larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
