"""The registered queries of the core operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.functions import text as T
from garimpo.functions.tokens import count_tokens, count_words
from garimpo.operators import answer as A
from garimpo.operators import clean, project, report, segment, vectors
from garimpo.oracles import ORACLES  # noqa: F401
from garimpo.plans.tables import bounded, cut, numbered, scratch, small, spread, table
from garimpo.sources import catalogue as C
from garimpo.sources import sinks
from garimpo.sources.documents import html_text, read_pages
from garimpo.streaming.ingest import windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def once(df: DataFrame, key: str) -> DataFrame:
    """Repeated deliveries of a key as one row."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


# sources


@query
def format_resolution(spark, d):
    return table(spark, d, "manifest").select("id", C.resolve_format(F.col("tipo"), F.lit(None).cast("string"), F.col("url")).alias("ext")).distinct()


@query
def format_resolution_by_address(spark, d):
    rows = table(spark, d, "manifest_status")
    return rows.select("id", C.resolve_format(F.lit(""), F.when(F.col("ano") % 5 == 0, "text/HTML; charset=utf-8").when(F.col("ano") % 5 == 1, "application/msword"), F.concat("url", F.lit("?v=1"))).alias("ext")).distinct()


@query
def missing_files(spark, d):
    return C.missing(table(spark, d, "manifest"), table(spark, d, "manifest_status").where("downloaded")).select("id").distinct()


@query
def located_files(spark, d):
    files = table(spark, d, "manifest_status").where("downloaded").select("id", F.col("local_path").alias("path"))
    return C.locate(table(spark, d, "manifest").select("id").distinct(), files)


@query
def fetch_summary(spark, d):
    return C.fetch_summary(table(spark, d, "manifest_status"))


@query
def path_parts(spark, d):
    path = F.col("local_path")
    return table(spark, d, "manifest_status").select("id", T.file_name(path).alias("name"), T.file_suffix(path).alias("suffix")).distinct()


def marked_up(text):
    """A page around a text, with what must not be seen."""
    safe = F.regexp_replace(text, "[<>&]", " ")
    return F.concat(F.lit("<html><head><title>t</title><style>p{}</style></head><body><nav>menu</nav><!-- note --><p>"), F.replace(safe, F.lit("\n"), F.lit("</p>\n<p>")), F.lit("</p><script>a<b</script><footer>fim</footer></body></html>"))


@query
def html_visible_text(spark, d):
    return table(spark, d, "documents").select("doc_id", html_text(marked_up(F.col("text")), entities=False).alias("text"))


@query
def html_char_stats(spark, d):
    rows = table(spark, d, "documents").select("source", F.length(marked_up(F.col("text"))).alias("a"), F.length(html_text(marked_up(F.col("text")), entities=False)).alias("b"))
    return rows.groupBy("source").agg(F.sum("a").alias("chars_raw"), F.sum("b").alias("chars_text"))


def catalogue(spark, d):
    """Catalogue rows, each once."""
    return table(spark, d, "manifest").where("id is not null").select("id", "titulo", "fonte", "categoria", "ano", "tipo", "url", "insecure").distinct()


# written and read again


@query
def manifest_json(spark, d):
    path = scratch(spark, "manifest")
    sinks.write_json_array(catalogue(spark, d), path, "id")
    return C.read_manifest(spark, path).select("id", "titulo", "fonte", "categoria", F.col("ano").cast("string").alias("ano"), "tipo", "url", "insecure")


@query
def text_files(spark, d):
    path = scratch(spark, "texts")
    sinks.write_texts(table(spark, d, "documents"), path, fan_out=16)
    return read_pages(spark, path).select("doc_id", "page_no", "text")


@query
def chunk_lines(spark, d):
    path = scratch(spark, "lines")
    rows = once(table(spark, d, "chunks"), "chunk_id").select("chunk_id", "doc_id", "titulo", "fonte", "categoria", "ano", "section", "n_tokens", "text")
    sinks.write_json_lines(rows, path)
    return spark.read.schema(rows.schema).json(path).withColumn("n_tokens", F.col("n_tokens").cast("string"))


@query
def report_json(spark, d):
    path = scratch(spark, "report")
    sinks.write_json_array(report.chunk_report(once(table(spark, d, "chunks"), "chunk_id")), path, "total_chunks")
    return spark.read.schema("total_chunks long, tokens_medio double, tokens_min long, tokens_max long").option("multiLine", True).json(path)


@query
def index_growth(spark, d):
    """An index of half the chunks, to which all are added."""
    path = scratch(spark, "index")
    rows = once(table(spark, d, "chunks"), "chunk_id")
    sinks.write_index(rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(2)) == 0), path)
    sinks.write_index(rows, path, reset=False)
    return sinks.read_index(spark, path).groupBy(F.coalesce("categoria", F.lit("")).alias("categoria")).agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.size("embedding") > 0).alias("vectors"))


@query
def fetched_pages(spark, d):
    """Every document of the catalogue fetched (in a dry run) and its pages read."""
    path = scratch(spark, "raw")
    C.fetch(catalogue(spark, d), C.EchoFetcher(), path).write.format("noop").mode("overwrite").save()
    return read_pages(spark, path).select("doc_id", "text", "error")


@query
def fetched_totals(spark, d):
    return C.fetch_summary(C.fetch(catalogue(spark, d), C.EchoFetcher(), scratch(spark, "raw"))).select("total", "ok", "failed")


# cleaning


@query
def line_norm_keys(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", T.line_key(F.col("line")).alias("key"))


def pages(spark, d):
    """Chunks as the pages of their document."""
    rows = once(table(spark, d, "chunks"), "chunk_id")
    return rows.select("doc_id", F.regexp_extract("chunk_id", r"(\d+)$", 1).cast("int").alias("page_no"), "chunk_id", "text")


@query
def repeated_lines(spark, d):
    return clean.repeated_lines(pages(spark, d), zone=3, min_ratio=0.1)


@query
def header_stripped_pages(spark, d):
    return clean.stripped_pages(pages(spark, d), zone=3, min_ratio=0.1).select("chunk_id", "text", F.size("removed_headers").alias("n_headers"))


@query
def page_number_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.lines(F.concat("text", F.lit("\nPág. "), F.col("doc_id") % 1000, F.lit(" de 40\n"), F.col("doc_id")))).alias("line"))
    return rows.where(T.is_page_number(F.col("line"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query
def references_cut(spark, d):
    text = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.lit("\nREFERÊNCIAS Bibliográficas :\n[1] Norma local.")).otherwise("\nReferências e notas"))
    return table(spark, d, "documents").select("doc_id", T.cut_references(text).alias("text"))


@query
def dehyphenated(spark, d):
    return table(spark, d, "documents").select("doc_id", T.join_hyphenated(F.regexp_replace("text", "([aeo])([nrs])", "$1-\n$2")).alias("text"))


@query
def unicode_spaces(spark, d):
    rows = once(table(spark, d, "chunks"), "chunk_id")
    return rows.select("chunk_id", T.repair_characters(F.concat(F.lit("﻿"), "text", F.lit(" ​.")), normalise=False).alias("text"))


@query
def compatibility_form(spark, d):
    return once(table(spark, d, "chunks"), "chunk_id").select("chunk_id", T.repair_characters(F.col("text")).alias("text"))


def chunk_blocks(spark, d):
    return once(table(spark, d, "chunks"), "chunk_id").select("chunk_id", F.posexplode(T.blocks(F.col("text"))).alias("block_no", "block"))


@query
def structured_blocks(spark, d):
    return chunk_blocks(spark, d).select("chunk_id", "block_no", T.is_structured(F.col("block")).alias("structured"))


@query
def heading_flags(spark, d):
    return chunk_blocks(spark, d).select("chunk_id", "block_no", T.is_heading(F.col("block")).alias("heading"))


@query
def normalised_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalise_blocks(F.col("text")).alias("text"))


@query
def clean_texts(spark, d):
    return T.clean_text(once(table(spark, d, "chunks"), "chunk_id").select("chunk_id", "text"))


@query
def clean_diagnostics(spark, d):
    return clean.diagnostics(clean.clean_documents(pages(spark, d), min_ratio=0.1))


@query
def document_excerpts(spark, d):
    return table(spark, d, "documents").select("doc_id", T.excerpt(F.col("text"), 55).alias("excerpt"))


# segmentation


@query
def token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", count_tokens(F.col("text")).alias("tokens"), count_words(F.col("text")).alias("words"))


@query
def token_histogram(spark, d):
    return report.histogram(once(table(spark, d, "chunks"), "chunk_id"), "n_tokens", 30)


@query
def section_carry(spark, d):
    return segment.sections_of_blocks(once(table(spark, d, "chunks"), "chunk_id").select(F.col("chunk_id").alias("doc_id"), "text")).withColumnRenamed("doc_id", "chunk_id")


@query
def sentence_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


@query
def sentence_pack(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(segment.pack_sentences(F.col("text"), 120)).alias("piece_no", "piece"))


@query
def block_pack(spark, d):
    rows = table(spark, d, "documents").select("doc_id", segment.block_table(F.col("text")).alias("b"))
    rows = rows.select("doc_id", F.posexplode(segment.pack_blocks(F.col("b"), F.col("doc_id").cast("string"), 200)).alias("chunk_no", "r"))
    return rows.select("doc_id", "chunk_no", F.col("r.first").alias("first_block"), F.col("r.last").alias("last_block"))


def documents_with_title(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("fonte"), "categoria")).withColumn("titulo", F.lit(None).cast("string"))


@query
def document_chunks(spark, d):
    docs = T.clean_text(documents_with_title(spark, d))
    return segment.chunk_documents(docs, 256, 128).select("chunk_id", "doc_id", "fonte", "section", "n_tokens", "text")


@query
def document_metadata(spark, d):
    docs = once(table(spark, d, "chunks"), "chunk_id").select("doc_id").distinct().withColumn("text", F.lit(""))
    return segment.enrich(docs, table(spark, d, "manifest")).drop("text")


# reports


@query
def chunk_report_sets(spark, d):
    return report.report_sets(once(table(spark, d, "chunks"), "chunk_id"))


@query
def chunk_report(spark, d):
    rows = report.chunk_report(once(table(spark, d, "chunks"), "chunk_id"))
    return rows.select("total_chunks", "tokens_medio", "tokens_min", "tokens_max", F.size("por_categoria").alias("categorias"), F.size("por_documento").alias("documentos"))


@query
def category_counts(spark, d):
    return report.value_counts(table(spark, d, "manifest"), "categoria")


@query
def category_labels(spark, d):
    return report.distinct_labels(table(spark, d, "chunks"), "subcategoria")


@query
def middle_chunk(spark, d):
    """A positional sample: the chunk in the middle of each document, found by ranks within ranges of ids."""
    rows = once(table(spark, d, "chunks"), "chunk_id").select("doc_id", "chunk_id")
    return report.at_position(rows, "doc_id", "chunk_id", 0.5)


@query
def first_by_fonte(spark, d):
    """A sample: the first chunk of each source, with the start of its text."""
    rows = once(table(spark, d, "chunks"), "chunk_id").where("fonte is not null")
    return report.first_by(rows, "fonte", "chunk_id", ["text"]).select("fonte", "chunk_id", F.substring("text", 1, 900).alias("excerpt"))


@query
def event_windows(spark, d):
    return windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day")


# vectors and retrieval


@query
def metadata_sanitised(spark, d):
    rows = once(table(spark, d, "chunks"), "chunk_id")
    return vectors.sanitised(rows.drop("text", "embedding"))


@query
def index_counts(spark, d):
    return once(table(spark, d, "chunks").where("embedding is not null"), "chunk_id").groupBy("categoria").agg(F.count(F.lit(1)).alias("n"))


@query
def vector_norms(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.norm(v), 5).alias("norm"), F.round(vectors.norm(vectors.unit(v)), 5).alias("unit_norm"))


def vector_queries(spark, d):
    """Every row whose id is divisible by 20, against all rows."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")


def shown(hits):
    return hits.select(F.col("qid").cast("long").alias("qid"), "rank", F.col("vec_id").cast("long").alias("vec_id"), F.round("distance", 5).alias("distance"))


@query
def cosine_topk(spark, d):
    return shown(vectors.search(table(spark, d, "embeddings"), vector_queries(spark, d), 5, key="vec_id"))


@query
def cosine_topk_filtered(spark, d):
    return shown(vectors.search(table(spark, d, "embeddings"), vector_queries(spark, d), 5, {"label": 3}, key="vec_id"))


@query
def where_operators(spark, d):
    where = {"$or": [{"ano": {"$gte": 2010, "$lt": 2015}, "categoria": {"$ne": "norma_certificacao"}}, {"$and": [{"subcategoria": {"$in": ["agua", "ambos"]}}, {"tipo": {"$nin": ["pdf"]}}, {"ano": {"$gt": 2020}}]}, {"ano": {"$eq": 1999}}]}
    return table(spark, d, "manifest").where(vectors.compile_where(where)).select("id").distinct()


def hits(spark, d):
    """The three longest chunks of a document as its hits."""
    rows = once(table(spark, d, "chunks"), "chunk_id").where("text is not null").withColumn("score", F.lit(1.0) / F.length(F.concat("text", F.lit("."))))
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "chunk_id")
    rows = rows.withColumn("rank", F.row_number().over(order)).where("rank <= 3")
    hit = F.struct("rank", "titulo", "fonte", "ano", "vigencia", "categoria", "subcategoria", "section", "doc_id", "text", "score")
    return rows.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))


@query
def context_strings(spark, d):
    context = A.context_of(F.col("hits"))
    return hits(spark, d).select("id", context.alias("context"), A.prompt_of(context, F.concat(F.lit("O que diz "), "id", F.lit("?"))).alias("prompt"))


@query
def citation_labels(spark, d):
    rows = hits(spark, d).withColumn("s", A.sources_of(F.col("hits")))
    return rows.select("id", A.top_label(F.col("s")).alias("top"), F.posexplode(A.source_labels(F.col("s"))).alias("i", "label"))


@query
def chat_messages(spark, d):
    """What a chat model is sent for each document's hits."""
    rows = hits(spark, d).withColumn("m", A.messages_of(F.concat(F.lit("O que diz "), "id", F.lit("?")), A.context_of(F.col("hits"))))
    return rows.select("id", F.posexplode("m").alias("turn", "m")).select("id", "turn", "m.role", "m.content")


@query
def passage_vectors(spark, d):
    """Chunks with vectors of the stand-in model."""
    rows = once(table(spark, d, "chunks"), "chunk_id").where("text is not null").withColumn("embedding", vectors.embed(F.col("text"), "passage"))
    return rows.select("chunk_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


def index(spark, d):
    """Chunks with their stored vectors."""
    return once(table(spark, d, "chunks"), "chunk_id").where("text is not null").drop("carregado_em")


def numbered_chunks(rows):
    """Those whose number is divisible by 20; they stand for the questions."""
    return rows.where("cast(regexp_extract(chunk_id, '(\\\\d+)$', 1) as int) % 20 = 0")


def questions(spark, d):
    """A question about every such chunk, with the chunk's stored vector."""
    rows = numbered_chunks(index(spark, d)).where(vectors.usable(F.col("embedding"), 768))
    return rows.select(F.concat(F.lit("O que diz "), "chunk_id", F.lit("?")).alias("question"), "embedding").withColumn("comparar", F.length("question") % 2 == 0)


@query
def question_hits(spark, d):
    rows = A.hits_of(index(spark, d), questions(spark, d), 5).select("question", F.explode("hits").alias("h"))
    return rows.select("question", F.col("h.rank").alias("rank"), F.col("h.chunk_id").alias("chunk_id"), F.round("h.score", 6).alias("score"))


@query
def answer_sources(spark, d):
    rows = A.answer(index(spark, d), questions(spark, d), 5).select("question", F.explode("sources").alias("s"))
    return rows.select("question", "s.*")


@query
def question_answers(spark, d):
    asked = numbered(questions(spark, d).select("question").distinct(), "question")
    return A.evaluate(A.answer(index(spark, d), questions(spark, d), 5), asked).select("n", "pergunta", "coberta", "resposta", "fonte_top")


@query
def filtered_answers(spark, d):
    return A.answer(index(spark, d), questions(spark, d), 5, {"subcategoria": "energia"}).select("question", "answer", F.size("sources").alias("n_sources"))


@query
def answer_comparison(spark, d):
    return A.compare(A.answer(index(spark, d), questions(spark, d), 5), questions(spark, d)).select("pergunta", "rag", F.array_join("fontes_rag", "; ").alias("fontes_rag"), "puro")


@query
def answer_coverage(spark, d):
    return A.coverage(table(spark, d, "avaliacao").select(A.covered(F.col("resposta")).alias("coberta")))


@query
def coverage_labels(spark, d):
    rows = table(spark, d, "avaliacao").withColumn("c", A.covered(F.col("resposta")))
    return rows.select("n", F.when(F.col("c"), "sim").otherwise("não (sem cobertura)").alias("cobertura"), F.coalesce(F.try_element_at("fontes", F.lit(1)), F.lit("")).alias("primeira")).distinct()


@query
def compared_questions(spark, d):
    asked = table(spark, d, "perguntas").where("comparar").select(F.col("q").alias("pergunta")).distinct()
    return table(spark, d, "avaliacao").join(small(asked), "pergunta").groupBy("pergunta").agg(F.count_distinct("n").alias("respostas"), F.count_if(A.covered(F.col("resposta"))).alias("cobertas"))


@query
def projection(spark, d):
    return project.project(table(spark, d, "embeddings"), "embedding", ["vec_id", "label"])


@query
def label_dispersion(spark, d):
    return project.dispersion(projection(spark, d), "label")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean the chunks' texts, cut them into pieces, index and search: the best pieces for a question about every 20th chunk.

    A piece has the stored vector of its chunk.  What is kept between the steps are ids,
    metadata and vectors; texts end with the cut.
    """
    rows = index(spark, d).where(vectors.usable(F.col("embedding"), 768))
    docs = T.clean_text(spread(rows.select(F.col("chunk_id").alias("doc_id"), "text", F.col("doc_id").alias("source_id"), "fonte", "embedding")))
    pieces = cut(segment.chunk_documents(docs, 256, 128).select(F.col("chunk_id").alias("piece_id"), F.col("doc_id").alias("chunk_id"), F.col("source_id").alias("doc_id"), "fonte", "section", "embedding"))
    asked = numbered_chunks(pieces).select(F.concat(F.lit("O que diz "), "chunk_id", F.lit("?")).alias("question"), "embedding").dropDuplicates(["question"])
    found = bounded(vectors.search(pieces, asked, 5, key="piece_id", query_key="question").withColumnRenamed("qid", "question"), 200)
    return pieces.drop("embedding").join(found, "piece_id").select("question", "rank", "piece_id", "doc_id", "fonte", "section", F.round("score", 6).alias("score"))


query(flagship)
