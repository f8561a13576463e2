"""Questions to answers with citations: context, prompt, sources, evaluation."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.operators.vectors import Embedder, HashingEmbedder, embed, search
from garimpo.plans.tables import bounded

#: The sentence of an answer that declines, and what it is known by.
REFUSAL = "A informação não está no corpus consultado."
REFUSAL_MARK = "não está no corpus"
#: Frame of a prompt.
PROMPT = ("CONTEXTO:\n", "\n\nPERGUNTA: ", "\n\nResponda citando as fontes pelos números entre colchetes.")

#: What a language model is told, with passages and without.
SYSTEM_RAG = """Você é um assistente técnico especializado em edifícios verdes e Net Zero de água e energia.
Responda EXCLUSIVAMENTE com base nos trechos numerados fornecidos no CONTEXTO.

Regras obrigatórias:
1. Use apenas informações presentes no CONTEXTO; não recorra a conhecimento próprio.
2. Para CADA afirmação técnica, cite a fonte com o número do trecho entre colchetes, ex.: [2].
3. Se a resposta não estiver no CONTEXTO, responda exatamente: "A informação não está no corpus consultado." Não invente nada.
4. Seja objetivo e técnico, em português. Reproduza valores, normas e parâmetros exatamente como aparecem no trecho.
"""
SYSTEM_PLAIN = """Você é um assistente técnico especializado em edifícios verdes e Net Zero de água e energia.
Responda à pergunta de forma técnica e objetiva, em português."""

Generator = Callable[[Column, Column, Column], Column]
MESSAGES = "array<struct<role:string,content:string>>"


class Chat(Protocol):
    """Any chat model: one answer for the messages ``[{"role": ..., "content": ...}]``."""

    def complete(self, messages: list[dict[str, str]], temperature: float, context_tokens: int) -> str: ...


class HttpChat:
    """A model behind a local HTTP service that takes and gives JSON: ``POST <address>/api/chat``."""

    def __init__(self, model: str, address: str = "http://127.0.0.1:11434", timeout: float = 600):
        self.model, self.address, self.timeout = model, address.rstrip("/"), timeout

    def ask(self, path: str, body: dict | None = None) -> dict:
        request = urllib.request.Request(self.address + path, json.dumps(body).encode() if body is not None else None, {"Content-Type": "application/json"})  # noqa: S310
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.load(answer)

    def complete(self, messages: list[dict[str, str]], temperature: float, context_tokens: int) -> str:
        body = {"model": self.model, "messages": messages, "stream": False, "options": {"temperature": temperature, "num_ctx": context_tokens}}
        return self.ask("/api/chat", body)["message"]["content"]

    def ready(self) -> bool:
        return model_ready(lambda: [m.get("model") or m.get("name", "") for m in self.ask("/api/tags").get("models", [])], self.model)


def messages_of(question: Column, context: Column | None = None) -> Column:
    """What a chat model is sent: its instructions, then the question, framed by the context if there is one."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    if context is None:
        return F.array(turn("system", F.lit(SYSTEM_PLAIN)), turn("user", question))
    return F.array(turn("system", F.lit(SYSTEM_RAG)), turn("user", prompt_of(context, question)))


def chat(load: Callable[[], Chat], with_context: bool = True, temperature: float = 0.0, context_tokens: int = 8192) -> Generator:
    """A generator that asks a chat model; ``load`` runs once a worker.  An error of the model fails the query."""

    @F.pandas_udf("string")
    def complete(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            yield part.map(lambda turns: None if turns is None else model.complete([{"role": t["role"], "content": t["content"]} for t in turns], temperature, context_tokens).strip())

    return lambda question, context, hits: complete(messages_of(question, context if with_context else None))



def context_of(hits: Column) -> Column:
    """Numbered passages with source, title, year and section."""

    def passage(h: Column, i: Column) -> Column:
        known = lambda c: F.coalesce(h[c], F.lit("?"))
        section = F.when(F.coalesce(h["section"], F.lit("")) != "", F.concat(F.lit("; seção: "), h["section"])).otherwise("")
        return F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] (Fonte: "), known("fonte"), F.lit(" - "), known("titulo"), F.lit(", "), known("ano"), section, F.lit(")\n"), F.coalesce(h["text"], F.lit("")))

    return F.array_join(F.transform(hits, passage), "\n\n")


def prompt_of(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), context, F.lit(PROMPT[1]), question, F.lit(PROMPT[2]))


def sources_of(hits: Column) -> Column:
    fields = ("titulo", "fonte", "ano", "vigencia", "categoria", "subcategoria", "section", "doc_id")
    return F.transform(hits, lambda h, i: F.struct((i + 1).alias("n"), *(h[f].alias(f) for f in fields), F.round(h["score"], 3).alias("score")))


def source_labels(sources: Column, separator: str = ", ") -> Column:
    return F.transform(sources, lambda s: F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), F.coalesce(s["fonte"], F.lit("?")), F.lit(separator), F.coalesce(s["titulo"], F.lit("?"))))


def top_label(sources: Column) -> Column:
    """Source and score of the best hit, empty without hits."""
    first = F.try_element_at(sources, F.lit(1))
    return F.when(first.isNull(), "").otherwise(F.concat(F.coalesce(first["fonte"], F.lit("?")), F.lit(" ("), F.format_string("%.3f", first["score"]), F.lit(")")))


def extractive(question: Column, context: Column, hits: Column) -> Column:
    """Deterministic generator: the first sentence of the best passage with its citation, or the refusal."""
    first = F.try_element_at(hits, F.lit(1))["text"]
    sentence = F.regexp_extract(F.coalesce(first, F.lit("")), r"(?s)^\s*(.+?[.!?])(?:\s|$)", 1)
    return F.when((context == "") | (sentence == ""), REFUSAL).otherwise(F.concat(sentence, F.lit(" [1]")))


def plain(question: Column, context: Column, hits: Column) -> Column:
    """Deterministic generator without context."""
    return F.concat(F.lit("Sem contexto: "), question)


def covered(answer: Column) -> Column:
    return ~F.lower(F.coalesce(answer, F.lit(REFUSAL))).contains(REFUSAL_MARK)


def hits_of(index: DataFrame, questions: DataFrame, k: int = 5, where: dict[str, Any] | None = None, load: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """``(question, hits)``: the k best passages of each distinct question as an ordered array.

    Questions with a column ``embedding`` keep their vectors (one of them, if a question comes
    with several), others get those of the model.  The hits are broadcast to the passages if
    their counted number is small; else both sides are shuffled.
    """
    asked = questions.where("question is not null").dropDuplicates(["question"])
    asked = asked.select("question", "embedding") if "embedding" in asked.columns else asked.select("question").withColumn("embedding", embed(F.col("question"), "query", load))
    found = bounded(search(index, asked, k, where, query_key="question").withColumnRenamed("qid", "question"), 400)
    rows = index.drop("embedding").join(found, "chunk_id")
    hit = F.struct("rank", "chunk_id", "doc_id", "titulo", "fonte", "categoria", "subcategoria", "ano", "vigencia", "url", "section", "n_tokens", "text", "distance", "score")
    packed = rows.groupBy("question").agg(F.array_sort(F.collect_list(hit)).alias("hits"))  # k hits a question
    empty = F.slice(F.array(F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in packed.schema["hits"].dataType.elementType))), 1, 0)
    return asked.select("question").join(packed, "question", "left").withColumn("hits", F.coalesce("hits", empty))


def answer(index: DataFrame, questions: DataFrame, k: int = 5, where: dict[str, Any] | None = None, generate: Generator = extractive, load: Callable[[], Embedder] = HashingEmbedder) -> DataFrame:
    """``(question, answer, sources, context, hits)`` for each distinct question, in one job."""
    rows = hits_of(index, questions, k, where, load).withColumn("context", context_of(F.col("hits")))
    rows = rows.withColumn("answer", F.trim(generate(F.col("question"), F.col("context"), F.col("hits"))))
    return rows.select("question", "answer", sources_of(F.col("hits")).alias("sources"), "context", "hits")


def evaluate(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """One row a question in its order ``n``: answer, coverage, source labels."""
    rows = questions.join(answers, "question", "left")
    return rows.select(
        "n", F.col("question").alias("pergunta"), covered(F.col("answer")).alias("coberta"), F.col("answer").alias("resposta"), source_labels(F.col("sources")).alias("fontes"), top_label(F.col("sources")).alias("fonte_top")
    )


def coverage(evaluation: DataFrame) -> DataFrame:
    return evaluation.agg(
        F.count(F.lit(1)).alias("perguntas"), F.count_if("coberta").alias("cobertas"), F.round(F.count_if("coberta") / F.greatest(F.lit(1), F.count(F.lit(1))), 6).alias("taxa")
    )


def compare(answers: DataFrame, questions: DataFrame, generate: Generator = plain, top: int = 3) -> DataFrame:
    """Flagged questions: the answer with context beside one without."""
    rows = questions.where("comparar").select("question").distinct().join(answers, "question")
    sources = F.transform(F.slice("sources", 1, top), lambda s: F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), F.coalesce(s["fonte"], F.lit("?"))))
    return rows.select(F.col("question").alias("pergunta"), F.col("answer").alias("rag"), sources.alias("fontes_rag"), generate(F.col("question"), F.lit(""), F.col("hits")).alias("puro"))


def model_ready(installed: Callable[[], list[str]], name: str) -> bool:
    """Whether any installed model has the base name of ``name`` (before its tag); a service that fails isn't ready."""
    try:
        return any(name.split(":")[0] in known for known in installed())
    except Exception:  # noqa: BLE001
        return False
