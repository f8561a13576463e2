"""Schemas of the corpus tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


S, I, L, B, D = StringType(), IntegerType(), LongType(), BooleanType(), DoubleType()

MANIFEST = _struct(id=S, titulo=S, fonte=S, categoria=S, subcategoria=S, ano=I, vigencia=S, tipo=S, url=S, insecure=B, verified=B, notas=S)
MANIFEST_STATUS = StructType([*MANIFEST.fields, *_struct(local_path=S, downloaded=B, bytes=L, error=S).fields])
PAGES = _struct(doc_id=S, page_no=I, text=S)
CLEAN_DOCS = _struct(path=S, name=S, ext=S, n_pages=I, n_chars_raw=L, n_chars_clean=L, removed_headers=ArrayType(S), text=S)
CHUNKS = _struct(chunk_id=S, doc_id=S, titulo=S, fonte=S, categoria=S, subcategoria=S, ano=S, vigencia=S, url=S, section=S, n_tokens=I, text=S)
INDEX = StructType([*CHUNKS.fields, StructField("embedding", ArrayType(FloatType()), True)])
QUESTIONS = _struct(q=S, comparar=B)
SOURCE = _struct(n=I, titulo=S, fonte=S, ano=S, vigencia=S, categoria=S, subcategoria=S, section=S, doc_id=S, score=D)
EVALUATION = _struct(n=I, pergunta=S, coberta=B, resposta=S, fontes=ArrayType(S), fonte_top=S)
COMPARISON = _struct(pergunta=S, rag=S, fontes_rag=ArrayType(S), puro=S)

#: Metadata that chunks inherit from their document, and that an index keeps.
INHERITED = ("titulo", "fonte", "categoria", "subcategoria", "ano", "vigencia", "url")
INDEXED = ("doc_id", *INHERITED, "section")
