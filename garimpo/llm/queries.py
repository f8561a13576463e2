"""Queries pN_... over the test tables, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import abuse, encoding_repair, leakage, near_duplicates, packing, pair_defects, repeated_lines, splitting, token_budget, vector_neighbours
from garimpo.plans.tables import small, table

Query = Callable[[SparkSession, str], DataFrame]


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, fonte, idioma), each document once."""
    rows = table(spark, folder, "manifest").where("id is not null")
    return rows.groupBy(F.col("id").alias("doc_id")).agg(F.min("fonte").alias("m_fonte"), F.min("idioma").alias("m_idioma"))


def category(column):
    """One spelling a category; unknown marks are null."""
    c = F.replace(F.lower(F.trim(column)), F.lit(" "), F.lit("_"))
    return F.when(~c.isin("", "?"), c)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    members, pairs = near_duplicates.similar_sets(table(spark, folder, "chunks"), "chunk_id", "text")
    return near_duplicates.expand(members, pairs).toDF("chunk_id_a", "chunk_id_b")


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(table(spark, folder, "chunks"), "chunk_id", "text")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return vector_neighbours.neighbour_pairs(vector_neighbours.nearest(table(spark, folder, "chunks"), "chunk_id", "embedding")).toDF("chunk_id_a", "chunk_id_b")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pair_defects.defects(table(spark, folder, "avaliacao"), "n", "pergunta", "resposta").toDF("n", "defeito")


def records(spark: SparkSession, folder: str) -> DataFrame:
    """(field, source, key, text) of chunks and catalogue titles."""
    sources = catalogue(spark, folder)
    chunks = table(spark, folder, "chunks").select("chunk_id", "doc_id", "text").join(small(sources), "doc_id", "left")
    titles = table(spark, folder, "manifest")
    row = lambda df, field, source, key, text: df.select(F.lit(field).alias("field"), F.col(source).alias("source"), F.col(key).alias("key"), F.col(text).alias("text"))
    return row(chunks, "chunks", "m_fonte", "chunk_id", "text").unionByName(row(titles, "manifest", "fonte", "id", "titulo"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.affected(records(spark, folder)).select(F.col("field").alias("tabela"), F.col("key").alias("chave"))


def p4_repaired(spark: SparkSession, folder: str) -> DataFrame:
    found = encoding_repair.affected(records(spark, folder), repair=True)
    return found.select(F.col("field").alias("tabela"), F.col("key").alias("chave"), F.col("chain").alias("cadeia"), "posterior", F.col("text").alias("texto"))


def with_source(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", "doc_id", "text").join(small(catalogue(spark, folder)), "doc_id").select("chunk_id", "text", "m_fonte")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines.repeated_lines(with_source(spark, folder), "chunk_id", "text", "m_fonte").select("chunk_id", F.col("line_no").alias("linha_no"))


def p5_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates that cover enough chunks of a source, those with word slots too."""
    found = repeated_lines.repeated_lines(with_source(spark, folder), "chunk_id", "text", "m_fonte", slots=True)
    return found.groupBy(F.col("source").alias("fonte"), "template").agg(F.max("covers").alias("chunks"), F.count_distinct("line").alias("lines"))


def p5_cleaned(spark: SparkSession, folder: str) -> DataFrame:
    found = repeated_lines.repeated_lines(with_source(spark, folder), "chunk_id", "text", "m_fonte")
    return repeated_lines.without_lines(table(spark, folder, "chunks"), "chunk_id", "text", found)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(table(spark, folder, "chunks"), "chunk_id", "text")


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split(table(spark, folder, "chunks"), "chunk_id", "text", keep=("section",))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = token_budget.token_counts(table(spark, folder, "chunks"), "chunk_id", "text", keep=("n_tokens",))
    return rows.where((F.col("tokens") > 0) & token_budget.unsound(F.col("n_tokens"), F.col("tokens"))).select("chunk_id")


def budget(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunks").join(small(catalogue(spark, folder)), "doc_id", "left")
    rows = rows.select("chunk_id", "text", "n_tokens", F.col("m_fonte").alias("fonte"), F.col("m_idioma").alias("idioma"), category(F.col("categoria")).alias("categoria"))
    return token_budget.budget(rows, "chunk_id", "text", "n_tokens", ["fonte", "idioma", "categoria"])


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    return budget(spark, folder).drop("bpe_tokens")


def p7_bpe_totals(spark: SparkSession, folder: str) -> DataFrame:
    return budget(spark, folder)


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_packing(spark, folder).where("pieces > 1 and piece = 0").select("doc_id")


def p8_filling(spark: SparkSession, folder: str) -> DataFrame:
    return packing.filling(p8_packing(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "itens_teste"), "item_id", "text")


def p9_documents(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaked_documents(p9_leaks(spark, folder), "doc_id", "item_id")
    return found.select("doc_id", F.array_join("items", ",").alias("items"), "runs")


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = abuse.train_model(documents, "doc_id", "text", table(spark, folder, "rotulos"), "doc_id", "abusivo", table(spark, folder, "lexico"))
    return abuse.scores(documents, "doc_id", "text", model, keep=("source",))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_scores(spark, folder).where("abusive").select("doc_id").distinct()


def p10_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(p10_scores(spark, folder), "source")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_groups, p2_found, p3_found, p4_found, p4_repaired, p5_found, p5_templates, p5_cleaned, p6_found, p6_pieces, p7_found, p7_totals, p7_bpe_totals, p8_packing, p8_found, p8_filling,
        p9_found, p9_leaks, p9_documents, p10_found, p10_scores, p10_rates,
    )
}
