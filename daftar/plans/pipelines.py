"""Whole pipelines over DataFrames: index building, retrieval, prompting, question generation, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions.text import clean_arabic, col, fill, numbered, numbered_documents, source_label
from daftar.operators.chunking import marker_split
from daftar.operators.knn import knn_join
from daftar.operators.numbering import by_order, vector_ids
from daftar.operators.providers import LLM, Embedder, embed, generate
from daftar.operators.qa import parse_responses
from daftar.operators.ranking import reciprocal_rank_fusion, retrieval_metrics, stuff, unique_union
from daftar.session import cut

# Fixed value: what a model says when the context holds no answer.
NO_ANSWER = "NO ANSWER IS AVAILABLE."
ANSWER = f"Answer the question from the context only. If it is not there, say '{NO_ANSWER}'\n### Context\n{{context}}\n### Question\n{{question}}\n### Answer:"
HYPOTHESIS = "Write a short passage of a law book that answers the question.\n### Question\n{question}"
VARIANT = "Say the question in other words, variant {number}.\n{question}"
GENERATE = "Write questions on the context with their answers, each as 'Question : question | answer'.\n### Context\n{context}"


def build_index(docs: DataFrame, embedder: Embedder, key: list[str], separator: str = "Page number", size: int = 1000, overlap: int = 0, clean_first: bool = False) -> DataFrame:
    """source, page_content -> id, document, metadata, embedding, as a written table.

    Splits raw texts and cleans the chunks, or the other way round; numbers run in the order of ``key``, which must
    tell the documents apart, so ids do not depend on partitions.  Documents without source come like any others, with
    metadata without source.
    """
    text = clean_arabic("page_content") if clean_first else col("page_content")
    keys = [f"_k{i}" for i in range(len(key))]
    chunks = docs.select(*[col(k).alias(x) for k, x in zip(key, keys)], "source", F.posexplode(marker_split(text, separator, size, overlap)).alias("position", "document"))
    if not clean_first:
        chunks = chunks.withColumn("document", clean_arabic("document"))
    chunks = by_order(chunks, [*keys, "position"], "n")
    rows = vector_ids(chunks, "n").withColumn("metadata", F.to_json(F.struct(source_label("source").alias("source"), F.col("n").alias("chunk_id"))))
    return cut(embed(rows.select("id", "document", "metadata"), "document", embedder))


def retrieve(queries: DataFrame, store: DataFrame, embedder: Embedder, text: str = "question", k: int = 10, metric: str = "cosine") -> DataFrame:
    """query_id, rank, distance, id, document, metadata of the texts' nearest documents."""
    q = embed(queries.select("query_id", text), text, embedder)
    hits = knn_join(q, store, "query_id", "id", k=k, metric=metric)
    return hits.join(store.select("id", "document", "metadata"), "id")


def prompts(queries: DataFrame, hits: DataFrame, template: str = ANSWER) -> DataFrame:
    """query_id, question, context, prompt; queries without hits have an empty context."""
    j = queries.select("query_id", "question").join(stuff(hits), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return j.withColumn("prompt", fill(template, context="context", question="question"))


def answer(queries: DataFrame, store: DataFrame, embedder: Embedder, models: list[LLM] | None = None, k: int = 7) -> DataFrame:
    """Direct retrieval: query_id, question, context, prompt, response, attempts, error."""
    return generate(prompts(queries, retrieve(queries, store, embedder, k=k)), "prompt", models)


def answer_by_hypothesis(queries: DataFrame, store: DataFrame, embedder: Embedder, models: list[LLM] | None = None, k: int = 5) -> DataFrame:
    """Retrieval by a hypothetical answer; the original question is what is answered."""
    h = generate(queries.select("query_id", "question").withColumn("_p", fill(HYPOTHESIS, question="question")), "_p", models, "hypothesis")
    hits = retrieve(h.select("query_id", F.coalesce("hypothesis", "question").alias("hypothesis")), store, embedder, "hypothesis", k)
    return generate(prompts(queries, hits), "prompt", models)


def _listed(hits: DataFrame) -> DataFrame:
    """query_id, documents, metadatas in order of rank; at most k a query."""
    g = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "document", F.coalesce("metadata", F.lit("")).alias("metadata")))).alias("x"))
    return g.select("query_id", F.transform("x", lambda y: y["document"]).alias("_d"), F.transform("x", lambda y: y["metadata"]).alias("_m"))


def serve(queries: DataFrame, store: DataFrame, embedder: Embedder, models: list[LLM] | None = None, k: int = 7) -> DataFrame:
    """What a direct-retrieval service shows of each question: query_id, answer, documents (one display)."""
    hits = cut(retrieve(queries, store, embedder, k=k))
    a = generate(prompts(queries, hits), "prompt", models)
    j = a.join(_listed(hits), "query_id", "left")
    return j.select("query_id", F.coalesce("response", F.concat(F.lit("An error occurred: "), F.coalesce("error", F.lit("")))).alias("answer"), F.coalesce(numbered_documents("_d", "_m"), F.lit("")).alias("documents"))


def serve_by_hypothesis(queries: DataFrame, store: DataFrame, embedder: Embedder, models: list[LLM] | None = None, k: int = 5) -> DataFrame:
    """As serve, retrieved by a hypothetical answer: query_id, answer, documents, metadatas; of an error only its message."""
    h = cut(generate(queries.select("query_id", "question").withColumn("_p", fill(HYPOTHESIS, question="question")), "_p", models, "hypothesis").withColumnRenamed("error", "_first").drop("attempts"))
    hits = cut(retrieve(h.where("_first is null"), store, embedder, "hypothesis", k))
    a = generate(prompts(h.where("_first is null"), hits), "prompt", models)
    j = h.select("query_id", "_first").join(a.drop("question"), "query_id", "left").join(_listed(hits), "query_id", "left")
    error = F.coalesce("_first", "error")
    shown = lambda c: F.when(error.isNull(), F.coalesce(c, F.lit(""))).otherwise("")
    return j.select("query_id", F.when(error.isNull(), F.col("response")).otherwise(F.concat(F.lit("An error occurred: "), error)).alias("answer"), shown(numbered("Document", "_d")).alias("documents"), shown(numbered("Metadata", "_m")).alias("metadatas"))


def multi_query(queries: DataFrame, store: DataFrame, embedder: Embedder, models: list[LLM] | None = None, variants: int = 3, k: int = 4) -> DataFrame:
    """Ranked lists of variants of each question: query_id, list_id, rank (from 0), doc."""
    v = queries.select("query_id", "question", F.explode(F.sequence(F.lit(1), F.lit(variants))).alias("list_id"))
    v = generate(v.withColumn("_p", fill(VARIANT, number=F.col("list_id").cast("string"), question="question")), "_p", models, "variant")
    v = v.select(F.col("query_id").alias("_q"), "list_id", F.xxhash64("query_id", "list_id").alias("query_id"), F.coalesce("variant", "question").alias("variant"))
    hits = retrieve(v, store, embedder, "variant", k)
    return hits.join(v.select("query_id", "_q", "list_id"), "query_id").select(F.col("_q").alias("query_id"), "list_id", (F.col("rank") - 1).alias("rank"), F.col("id").alias("doc"))


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    return reciprocal_rank_fusion(lists, k)


def united(lists: DataFrame) -> DataFrame:
    return unique_union(lists)


def generate_pairs(chunks: DataFrame, models: list[LLM] | None = None, keep: list[str] | None = None) -> DataFrame:
    """context (page_content), question, answer: pairs that a model writes on each chunk."""
    keep = keep or []
    r = generate(chunks.select(*keep, "page_content").withColumn("_p", fill(GENERATE, context="page_content")), "_p", models)
    return parse_responses(r, "response", [*keep, "page_content"]).withColumnRenamed("page_content", "context")


def evaluate(pairs: DataFrame, store: DataFrame, embedder: Embedder, k: int = 10) -> DataFrame:
    """avg_hit_rate, avg_reciprocal_rank of pairs (query_id, question, context): the context itself must be retrieved."""
    hits = retrieve(pairs, store, embedder, k=k).select("query_id", "rank", F.col("document").alias("doc"))
    return retrieval_metrics(hits, pairs.select("query_id", F.col("context").alias("doc")), k)
