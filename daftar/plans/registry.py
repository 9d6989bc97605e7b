"""Queries of the core and their oracle SQL; each query takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from daftar.functions import text as T
from daftar.functions import vectors as V
from daftar.operators import adapter, chunking, knn, lexical, numbering, providers, qa, ranking, sampling
from daftar.plans import pipelines
from daftar.plans.oracle import SQL  # noqa: F401
from daftar.session import cut, fresh
from daftar.sources import readers, sinks
from daftar.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _asked(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """The stated query set: rows whose id is divisible by 50."""
    return df.where(F.col(key) % 50 == 0)


def _usable(df: DataFrame) -> DataFrame:
    return df.where((F.size("embedding") == 64) & F.exists("embedding", lambda x: x != 0))


# --- retrieval -------------------------------------------------------------------------------------------------


def _nearest(s: SparkSession, d: str, metric: str, k: int = 10) -> DataFrame:
    e = table(s, d, "embeddings")
    return knn.knn_join(_asked(e), e, "vec_id", "vec_id", k=k, metric=metric, exclude_self=True)


@query
def knn_cosine_topk(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d, "cosine").select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


@query
def knn_l2_topk(s: SparkSession, d: str) -> DataFrame:
    return _nearest(s, d, "l2").select("query_id", "rank", "id", F.round("distance", 6).alias("distance"))


def _two_lists(s: SparkSession, d: str) -> DataFrame:
    a = _nearest(s, d, "cosine", 6).withColumn("list_id", F.lit(0))
    e = table(s, d, "embeddings")
    first = e.withColumn("embedding", F.transform("embedding", lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float"))))
    b = knn.knn_join(_asked(first), first, "vec_id", "vec_id", k=6, metric="l2", exclude_self=True).withColumn("list_id", F.lit(1))
    return a.union(b).select("query_id", "list_id", (F.col("rank") - 1).alias("rank"), F.col("id").alias("doc"))


@query
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(_two_lists(s, d)).select("query_id", "doc", F.round("score", 6).alias("score"), "fused_rank")


@query
def multi_query_union(s: SparkSession, d: str) -> DataFrame:
    return ranking.unique_union(_two_lists(s, d))


@query
def hit_rate_mrr(s: SparkSession, d: str) -> DataFrame:
    """Truth of a query: the smallest other id with its label."""
    e = table(s, d, "embeddings")
    two = e.groupBy("label").agg(F.min("vec_id").alias("a")).join(e.select("label", "vec_id"), "label")
    second = two.where("vec_id > a").groupBy("label", "a").agg(F.min("vec_id").alias("b"))
    truth = _asked(e).join(second, "label").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("doc"))
    m = ranking.retrieval_metrics(_nearest(s, d, "cosine").select("query_id", "rank", F.col("id").alias("doc")), truth)
    return m.select(F.round("avg_hit_rate", 6).alias("avg_hit_rate"), F.round("avg_reciprocal_rank", 6).alias("avg_reciprocal_rank"))


@query
def rag_prompt(s: SparkSession, d: str) -> DataFrame:
    v = _usable(table(s, d, "vectors"))
    hits = knn.knn_join(_asked(v), v, "vec_id", "vec_id", k=3, exclude_self=True)
    docs = v.select(F.col("vec_id").alias("id"), F.coalesce("document", F.lit("")).alias("document"))
    q = _asked(v).select(F.col("vec_id").alias("query_id"), F.coalesce("document", F.lit("")).alias("question"))
    return pipelines.prompts(q, hits.join(docs, "id")).select("query_id", "prompt")


def _first_five(s: SparkSession, d: str) -> DataFrame:
    """Each source's first five vectors' documents and metadata: cut before they are collected."""
    v = table(s, d, "vectors").where("source is not null and document is not null").select("source", "vec_id", "document", "metadata")
    v = v.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("vec_id"))).where("rank <= 5")
    x = v.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("rank", "document", "metadata"))).alias("x"))
    return x.select("source", F.transform("x", lambda y: y["document"]).alias("d"), F.transform("x", lambda y: y["metadata"]).alias("m"))


@query
def display_frozen(s: SparkSession, d: str) -> DataFrame:
    return _first_five(s, d).select("source", T.numbered_documents("d", "m").alias("display"))


@query
def display_hyde(s: SparkSession, d: str) -> DataFrame:
    return _first_five(s, d).select("source", T.numbered("Document", "d").alias("documents"), T.numbered("Metadata", "m").alias("metadatas"))


@query
def lookup_ids(s: SparkSession, d: str) -> DataFrame:
    return knn.lookup(table(s, d, "vectors"), "id", ["chunk_0", "chunk_7", "chunk_90"]).select("id", "vec_id", "document")


@query
def store_count(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "vectors").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"))


@query
def add_if_absent(s: SparkSession, d: str) -> DataFrame:
    """Chunks that no vector belongs to."""
    store = table(s, d, "vectors").select(F.col("chunk_key").alias("id"))
    return knn.add_if_absent(store, table(s, d, "chunks").select(F.col("chunk_key").alias("id"), "source"))


# --- text ------------------------------------------------------------------------------------------------------


@query
def clean_keep_digits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_key", T.clean_arabic("page_content").alias("cleaned"))


@query
def clean_drop_digits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_pairs").select("row_id", *[T.clean_arabic(c, keep_digits=False).alias(c) for c in ("context", "question", "answer")])


@query
def marker_removal(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_key", T.remove_page_marks("page_content").alias("cleaned"))


@query
def source_labels(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_key", T.source_label("source").alias("label"))


@query
def squad_answer(s: SparkSession, d: str) -> DataFrame:
    j = F.to_json(F.struct(F.array("answer").alias("text")))
    return table(s, d, "qa_pairs").select("row_id", T.first_answer(j).alias("answer"))


@query
def merge_columns(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_pairs").select("row_id", T.merged("question", "answer", "context").alias("merged"))


@query
def format_answer(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_pairs").select("row_id", T.format_answer("answer").alias("formatted"))


@query
def build_prompt(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_pairs").select("row_id", T.fill("C: {context}\nQ: {question}\nA:", context="context", question="question").alias("prompt"))


@query
def strip_join_lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").select("chunk_key", T.strip_join_lines("page_content").alias("joined"))


@query
def csv_documents(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_pairs").select("row_id", "context", "question", "answer")
    return readers.csv_documents(q, "qa.csv", "row_id")


@query
def error_policy(s: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("event_type") == "error", F.lit("HTTP 429: Rate Limit")).when(F.col("event_type") == "view", F.lit("503 Service Unavailable")).when(F.col("event_type") == "click", F.lit("broken pipe"))
    return table(s, d, "events").withColumn("policy", T.error_class(m)).groupBy("event_type", "policy").agg(F.count("*").alias("n"))


@query
def page_marked_text(s: SparkSession, d: str) -> DataFrame:
    """The chunks of each source as pages of one text, line by line."""
    c = table(s, d, "chunks").where("source is not null and page_content is not null")
    return readers.page_marked_lines(c.select("source", F.col("chunk_id").alias("page_number"), F.col("chunk_key").alias("row_no"), "page_content"))


@query
def page_marked_document(s: SparkSession, d: str) -> DataFrame:
    """Each item's sentences as pages of one line, as one text."""
    lines = F.transform(F.split("text", "\\.", -1), lambda x, i: F.struct((i + 1).alias("page_number"), F.array(F.struct(x.alias("content"))).alias("lines")))
    return table(s, d, "eval_items").where("text is not null").select("item_id", readers.page_marked(lines).alias("text"))


@query
def page_lines(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks").select(F.col("chunk_key").alias("source"), "page_content")
    return readers.text_lines(c)


# --- question-answer data --------------------------------------------------------------------------------------


@query
def qa_parse(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "qa_pairs").select("row_id", F.concat(F.lit("preamble Question : "), "question", F.lit(" | "), "answer", F.lit(" Question : a | b | c Question :  q2 | \n a2 ")).alias("response"))
    return qa.parse_responses(r, "response", ["row_id"])


@query
def human_qa_islands(s: SparkSession, d: str) -> DataFrame:
    """Twenty rows make a file: a numbered question line each, then the lines of the answer, then a page line."""
    q = table(s, d, "qa_pairs").where("question is not null")
    flat = lambda c: F.translate(c, "\n", " ")
    lines = F.array(F.lit("Page number: 1"), F.concat(F.lit("س "), F.col("row_id").cast("string"), F.lit(") "), flat("question")), F.concat(F.lit("  "), flat(F.coalesce("answer", F.lit("")))), F.lit("unwanted"), F.lit("end"))
    x = q.select(F.floor(F.col("row_id") / 20).alias("file"), "row_id", F.posexplode(lines).alias("p", "line"))
    x = x.select("file", (F.col("row_id") * 10 + F.col("p")).alias("line_no"), "line")
    return qa.numbered_pairs(x, "file", "line_no", "line", "unwanted")


@query
def append_frames(s: SparkSession, d: str) -> DataFrame:
    a = table(s, d, "eval_items").select(F.col("item_id").alias("id"), "text", "split")
    return qa.append(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang"), a)


@query
def generated_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs written by the stand-in model: it repeats the last line of the prompt, here the chunk's own opening and end."""
    flat = lambda c: T.strip(F.regexp_replace(c, rf"[{T.WS}|]", " "))
    own = F.concat(F.lit("\nQuestion : "), flat(F.substring("page_content", 1, 60)), F.lit(" | "), flat(F.substring("page_content", 30, 80)))
    c = table(s, d, "chunks").where("page_content is not null").withColumn("page_content", F.concat("page_content", own))
    return pipelines.generate_pairs(c, keep=["chunk_key"]).select("chunk_key", "question", "answer")


# --- splitting and counting ------------------------------------------------------------------------------------


@query
def chunk_pages(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents")
    return c.select("doc_id", F.posexplode(chunking.marker_split("text", "\n", 400)).alias("position", "chunk"))


@query
def chunk_overlap(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "chunks")
    return c.select("chunk_key", F.posexplode(chunking.marker_split("page_content", "\n", 500, 200)).alias("position", "chunk"))


@query
def token_chunks(s: SparkSession, d: str) -> DataFrame:
    """Raw texts cut at paragraphs, lines, blanks and characters, by words."""
    return chunking.token_split(table(s, d, "chunks").select("chunk_key", F.col("page_content").alias("text")), "text", 60, 10).drop("text")


@query
def processed_documents(s: SparkSession, d: str) -> DataFrame:
    """Cleaned, cut by the tokens of a public vocabulary at the reference's 600 and 100, and numbered."""
    return chunking.process_documents(table(s, d, "documents").select("doc_id", "source", F.col("text").alias("page_content")), ["doc_id"])


@query
def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    n = F.length("page_content")
    return table(s, d, "chunks").groupBy("source").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@query
def chunk_numbers(s: SparkSession, d: str) -> DataFrame:
    """Numbers over all sources in order, and vector ids."""
    c = table(s, d, "chunks").select("chunk_key", "source", "chunk_id")
    n = numbering.by_order(c, [F.coalesce("source", F.lit("")), "chunk_id", "chunk_key"], "position")
    return numbering.vector_ids(n, "position").select("chunk_key", "position", "id")


@query
def positional_slice(s: SparkSession, d: str) -> DataFrame:
    """The 2nd to 278th chunk."""
    return chunk_numbers(s, d).where("position between 2 and 278").select("chunk_key", "position")


@query
def head_tail(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_pairs").select("row_id", "question")
    return q.orderBy("row_id").limit(5).union(q.orderBy(F.desc("row_id")).limit(5))


@query
def cell_access(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "qa_pairs").where("row_id = 77").select("row_id", "context")


@query
def stuff_context(s: SparkSession, d: str) -> DataFrame:
    """The first three chunks of each source as one context."""
    c = table(s, d, "chunks").where("source is not null and page_content is not null")
    c = c.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("chunk_id", "chunk_key"))).where("rank <= 3")
    return ranking.stuff(c.select(F.col("source").alias("query_id"), "rank", F.col("page_content").alias("document"))).withColumnRenamed("query_id", "source")


# --- sampling and training -------------------------------------------------------------------------------------


@query
def train_test_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.train_test_split(table(s, d, "documents").select("doc_id"), "doc_id")


@query
def negative_sample(s: SparkSession, d: str) -> DataFrame:
    return sampling.negatives(table(s, d, "qa_pairs").select("row_id"), "row_id", table(s, d, "chunks"), "chunk_key")


@query
def shuffled_batches(s: SparkSession, d: str) -> DataFrame:
    return sampling.batches(table(s, d, "documents").select("doc_id"), "doc_id")


def _triplets(s: SparkSession, d: str) -> DataFrame:
    """Each vector, the next id's, and that of five hundred ids on, around the table."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    n = e.agg(F.max("vec_id") + 1).first()[0]
    p = e.select(F.col("vec_id").alias("p"), F.col("embedding").alias("positive"))
    m = e.select(F.col("vec_id").alias("m"), F.col("embedding").alias("negative"))
    return e.withColumn("p", (F.col("vec_id") + 1) % n).withColumn("m", (F.col("vec_id") * 7 + 3) % n).join(p, "p").join(m, "m").withColumnRenamed("embedding", "query")


@query
def triplet_loss(s: SparkSession, d: str) -> DataFrame:
    return _triplets(s, d).select("vec_id", F.round(V.triplet_loss("query", "positive", "negative"), 6).alias("loss"))


@query
def linear_adapter(s: SparkSession, d: str) -> DataFrame:
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda j: ((i * 7 + j * 3) % 5 - 2) / 10.0))
    b = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i / 100.0)
    y = table(s, d, "embeddings").select("vec_id", F.posexplode(V.linear("embedding", w, b)).alias("i", "y"))
    return y.select("vec_id", "i", F.round("y", 5).alias("y"))


@query
def lr_schedule(s: SparkSession, d: str) -> DataFrame:
    return s.range(0, 401).select(F.col("id").alias("step"), F.round(V.warmup_schedule("id", 100, 300), 6).alias("factor"))


@query
def adapter_training(s: SparkSession, d: str) -> DataFrame:
    """Mean loss of the first and the last epoch, and metrics without and with the adapter on the queries."""
    t = _triplets(s, d)
    w, b, losses = adapter.train(t, 64, "vec_id")
    e = table(s, d, "embeddings")
    q = adapter.apply(_asked(e), "embedding", w, b)
    truth = _asked(t).select(F.col("vec_id").alias("query_id"), F.col("p").alias("doc"))
    out = None
    for name, vec in (("base", "embedding"), ("adapted", "adapted")):
        hits = knn.knn_join(q, e, "vec_id", "vec_id", qvec=vec, k=10, exclude_self=True).select("query_id", "rank", F.col("id").alias("doc"))
        m = ranking.retrieval_metrics(hits, truth).select(F.lit(name).alias("model"), F.lit(losses[0 if name == "base" else -1]).alias("loss"), "avg_hit_rate", "avg_reciprocal_rank")
        out = m if out is None else out.union(m)
    return out


# --- pipelines with stand-in models ----------------------------------------------------------------------------


def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, providers.HashingEmbedder]:
    e = providers.HashingEmbedder()
    store = pipelines.build_index(table(s, d, "chunks").select("chunk_key", "source", "page_content"), e, ["chunk_key"])
    q = table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "question")
    return store, _asked(q, "query_id"), e


@query
def index_build(s: SparkSession, d: str) -> DataFrame:
    return _index(s, d)[0].select("id", "document", "metadata")


@query
def frozen_rag(s: SparkSession, d: str) -> DataFrame:
    store, q, e = _index(s, d)
    return pipelines.answer(q, store, e).select("query_id", "prompt", "response", "attempts")


@query
def hyde_rag(s: SparkSession, d: str) -> DataFrame:
    store, q, e = _index(s, d)
    return pipelines.answer_by_hypothesis(q, store, e).select("query_id", "prompt", "response", "attempts")


@query
def serve_frozen(s: SparkSession, d: str) -> DataFrame:
    store, q, e = _index(s, d)
    return pipelines.serve(q, store, e)


@query
def serve_hyde(s: SparkSession, d: str) -> DataFrame:
    store, q, e = _index(s, d)
    return pipelines.serve_by_hypothesis(q, store, e)


@query
def multi_query_rag(s: SparkSession, d: str) -> DataFrame:
    store, q, e = _index(s, d)
    return pipelines.fused(pipelines.multi_query(q, store, e)).withColumn("score", F.round("score", 6))


@query
def embed_texts(s: SparkSession, d: str) -> DataFrame:
    """The stand-in's vectors, not scaled."""
    x = providers.embed(table(s, d, "eval_items").select("item_id", "text"), "text", providers.HashingEmbedder(16, normalise=False))
    return x.select("item_id", F.posexplode("embedding").alias("i", "x"))


@query
def retrieval_evaluation(s: SparkSession, d: str) -> DataFrame:
    q = table(s, d, "qa_pairs").where("question is not null and context is not null")
    store = providers.embed(q.select(F.concat(F.lit("chunk_"), "row_id").alias("id"), F.col("context").alias("document"), F.lit("{}").alias("metadata")), "document", providers.HashingEmbedder())
    m = pipelines.evaluate(_asked(q, "row_id").select(F.col("row_id").alias("query_id"), "question", "context"), cut(store), providers.HashingEmbedder())
    return m.select(F.round("avg_hit_rate", 6).alias("avg_hit_rate"), F.round("avg_reciprocal_rank", 6).alias("avg_reciprocal_rank"))


# --- sources and sinks: written to the shared folder and read back ------------------------------------------------


def _files(s: SparkSession, d: str) -> str:
    """A folder with one text file for each row of sources: title, form feed, kind, language."""
    at = fresh(s)
    x = table(s, d, "sources").select(F.md5("source").alias("f"), F.concat("title", F.lit("\n\f"), "kind", F.lit("\n"), "lang").alias("t"))
    x.repartition("f").write.partitionBy("f").option("lineSep", "\n").text(at)
    return f"{at}/*"


def _file(c: str = "source") -> Column:
    return F.regexp_extract(c, "/f=([0-9a-f]+)/", 1).alias("file")


@query
def text_files(s: SparkSession, d: str) -> DataFrame:
    """Whole files of a directory, by pattern."""
    return readers.text_documents(s, _files(s, d), "*.txt").select(_file(), "page_content")


@query
def split_files(s: SparkSession, d: str) -> DataFrame:
    x = readers.load_and_split(s, _files(s, d), "\n", 30, glob="part-*")
    return x.select(_file(), "position", "page_content")


@query
def scan_lines(s: SparkSession, d: str) -> DataFrame:
    """Binary files through the stand-in extractor to pages, and pages to lines."""
    return readers.page_lines(readers.read_scans(s, _files(s, d))).select(_file(), "page_number", "line_no", "line")


@query
def csv_files(s: SparkSession, d: str) -> DataFrame:
    """Triples with quoted line breaks and quotes, written as CSV and read back."""
    at = fresh(s)
    sinks.write_csv(table(s, d, "qa_pairs").select("context", "question", "answer"), at)
    return readers.read_csv(s, at)


@query
def named_splits(s: SparkSession, d: str) -> DataFrame:
    at = fresh(s)
    table(s, d, "qa_pairs").select("row_id", "question", "split").write.partitionBy("split").parquet(at)
    return readers.read_split(s, {x: f"{at}/split={x}" for x in ("train", "validation", "test")}, "validation").select("row_id", "question")


@query
def vector_store(s: SparkSession, d: str) -> DataFrame:
    """Vectors added to a store twice, read through a store opened anew."""
    v = table(s, d, "vectors").where("size(embedding) = 64").select("id", "document", "metadata", "embedding", "vec_id")
    at = fresh(s)
    store = knn.VectorStore(s, at, "test", 64)
    store.add(v.where("vec_id % 3 > 0"))
    store.add(v)
    return knn.VectorStore(s, at, "test", 64).all().select("id", "document", "metadata")


@query
def memory_store(s: SparkSession, d: str) -> DataFrame:
    """The items' texts added to a collection in two calls."""
    store = knn.MemoryStore(s, "Book", providers.HashingEmbedder())
    x = table(s, d, "eval_items").select("item_id", "text", "split")
    for part in ("item_id <= 100", "item_id > 100"):
        store.add_texts(x.where(part), "text", ["item_id"], "split")
    return store.rows.select("id", "document", "metadata")


@query
def adapter_files(s: SparkSession, d: str) -> DataFrame:
    """The mean vectors of the labels as an adapter's rows, saved and loaded."""
    e = table(s, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "x"))
    m = e.groupBy("label", "j").agg(F.avg(F.col("x").cast("double")).alias("x")).orderBy("label", "j").collect()  # labels x dimensions
    rows: dict[int, list[float]] = {}
    for r in m:
        rows.setdefault(r.label, []).append(r.x)
    at = fresh(s)
    sinks.save_adapter(s, at, [rows[k] for k in sorted(rows)], [float(k) for k in sorted(rows)], dim=64)
    w, b, params = sinks.load_adapter(s, at)
    out = s.createDataFrame([(i, j, float(y), b[i], params["dim"]) for i, x in enumerate(w) for j, y in enumerate(x)], "i int, j int, w double, b double, dim int")
    return out.withColumn("w", F.round("w", 6))


# --- beyond: lexical retrieval, streams ------------------------------------------------------------------------


@query
def tf_idf(s: SparkSession, d: str) -> DataFrame:
    return lexical.tf_idf(table(s, d, "eval_items"), "item_id", "text").withColumn("weight", F.round("weight", 6))


@query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    q = _asked(table(s, d, "eval_items"), "item_id")
    return lexical.bm25(q, table(s, d, "documents").where("text <> ''"), "item_id", "doc_id", "question", "text").withColumn("score", F.round("score", 4))


@query
def stream_windows(s: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the events as a stream; the last windows stay open until later events come."""
    schema = table(s, d, "events").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    at = fresh(s)
    q = ingest.write_once(ingest.windowed_counts(stream, "ts", "event_type", "value"), f"{at}/data", f"{at}/state")
    q.awaitTermination()
    return s.read.schema("window_start timestamp, event_type string, n long, total double").parquet(f"{at}/data")
