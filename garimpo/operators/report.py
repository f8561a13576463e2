"""Reports over chunks: totals by grouping sets, histogram, value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.plans.tables import cut, small


def report_sets(chunks: DataFrame) -> DataFrame:
    """``(grupo, valor, chunks, tokens_medio, tokens_min, tokens_max)`` for all, category, subcategory and document.

    One pass with grouping sets.  Missing values count under ``?``.
    """
    rows = chunks.select(*(F.coalesce(F.col(c).cast("string"), F.lit("?")).alias(c) for c in ("categoria", "subcategoria", "doc_id")), "n_tokens")
    c, s, d = F.col("categoria"), F.col("subcategoria"), F.col("doc_id")
    sets = rows.groupingSets([[], [c], [s], [d]], c, s, d).agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("chunks"), F.round(F.avg("n_tokens"), 1).alias("tokens_medio"), F.min("n_tokens").alias("tokens_min"), F.max("n_tokens").alias("tokens_max")
    )
    group = F.when(F.col("g") == 3, "categoria").when(F.col("g") == 5, "subcategoria").when(F.col("g") == 6, "documento").otherwise("total")
    return sets.select(group.alias("grupo"), F.coalesce("categoria", "subcategoria", "doc_id", F.lit("")).alias("valor"), "chunks", "tokens_medio", "tokens_min", "tokens_max")


def chunk_report(chunks: DataFrame) -> DataFrame:
    """The report as one row with three maps; all zero and empty for no chunks.

    The map by document has one entry a document; ``report_sets`` is the form for large corpora.
    """
    sets = report_sets(chunks)
    of = lambda g: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("grupo") == g, F.struct("valor", "chunks"))), lambda e: e.isNotNull())))
    total = lambda c: F.max(F.when(F.col("grupo") == "total", F.col(c)))
    return sets.agg(
        F.coalesce(total("chunks"), F.lit(0)).alias("total_chunks"), F.coalesce(total("tokens_medio"), F.lit(0.0)).alias("tokens_medio"),
        F.coalesce(total("tokens_min"), F.lit(0)).alias("tokens_min"), F.coalesce(total("tokens_max"), F.lit(0)).alias("tokens_max"),
        of("categoria").alias("por_categoria"), of("subcategoria").alias("por_subcategoria"), of("documento").alias("por_documento"),
    )


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``(bin, low, high, n)`` of equal-width bins from minimum to maximum; the last bin includes the maximum.

    Nulls are left out.  If all values are equal they lie in the last of ``bins`` bins around it.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ends = values.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    width = (F.col("b") - F.col("a")) / F.lit(float(bins))
    number = F.when(F.col("b") == F.col("a"), F.lit(bins)).otherwise(F.least(F.lit(bins), (F.floor((F.col("v") - F.col("a")) / F.nullif(width, F.lit(0.0))) + 1).cast("int")))
    rows = values.crossJoin(F.broadcast(ends)).select(number.alias("bin"), "a", width.alias("w"))  # one row of ends
    return rows.groupBy("bin", "a", "w").agg(F.count(F.lit(1)).alias("n")).select("bin", F.round(F.col("a") + (F.col("bin") - 1) * F.col("w"), 6).alias("low"), F.round(F.col("a") + F.col("bin") * F.col("w"), 6).alias("high"), "n")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_first(column))


def first_by(df: DataFrame, group: str, order: str, keep: list[str]) -> DataFrame:
    """``(group, order, *keep)``: the row of the least ``order`` of each group, ties by the kept values.  No sort: a partial minimum per partition."""
    least = df.groupBy(group).agg(F.min(F.struct(order, *keep)).alias("r"))
    return least.select(group, "r.*")


def at_position(df: DataFrame, group: str, order: str, share: float) -> DataFrame:
    """``(group, order)``: in each group the row number ``floor(share * rows)`` from 0, in the order given; ``order`` has distinct values.

    Rows are sorted in ranges of (group, order), so a hot group is spread over many tasks;
    a row's number is its place in its range plus the group's rows in the ranges before.
    """
    rows = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    rows = cut(rows.select(group, order, F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")))
    sizes = rows.groupBy(group, "p").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first"))  # a row a group and range
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = F.floor(F.sum("n").over(Window.partitionBy(group)) * F.lit(share))
    sizes = sizes.select(group, "p", (F.col("first") + wanted - before).alias("i"), (wanted - before).between(0, F.col("n") - 1).alias("here")).where("here").drop("here")
    return rows.join(small(sizes), [group, "p", "i"]).select(group, order)


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)
