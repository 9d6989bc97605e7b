import math
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daftar.functions import vectors as V
from daftar.operators import adapter, chunking, knn, lexical, numbering, providers, qa, ranking, sampling
from daftar.plans import pipelines, registry


def merge_plain(text, sep, size, overlap):
    import re

    def emit(cur):
        t = "".join(cur).strip()
        return [t] if t else []

    out, cur = [], []
    for p in [x for x in re.split(f"(?={re.escape(sep)})", text) if x]:
        n, total = len(p), sum(map(len, cur))
        if n >= size:
            out += emit(cur) + [p]
            cur = []
        elif cur and total + n > size:
            out += emit(cur)
            while cur and not (sum(map(len, cur)) <= overlap and sum(map(len, cur)) + n <= size):
                cur.pop(0)
            cur.append(p)
        else:
            cur.append(p)
    return out + emit(cur)


@pytest.mark.parametrize("size, overlap", [(14, 0), (14, 8), (30, 10)])
def test_marker_split(spark, size, overlap):
    rnd = random.Random(size + overlap)
    texts = ["".join(rnd.choice("PPaab \n") for _ in range(rnd.randrange(60))) for _ in range(300)] + ["", "H\nP1 aa\nP2 bb\nP3 cccccccccccccccccccc\nP4 d\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(chunking.marker_split("t", "P", size, overlap)).collect()]
    assert got == [merge_plain(t, "P", size, overlap) for t in texts]
    assert spark.createDataFrame([(None,)], "t string").select(chunking.marker_split("t", "P", 9)).first()[0] is None


def test_token_chunks_at_finer_separators():
    t = "a b c\n\n" + "d e f g h i\nj k" + "\n\n" + "x" * 25
    c = chunking.token_chunks(t, 4, 0, chunking.words)
    assert c == ["a b c", "d e f g", "h i", "j k", "x" * 25]
    c = chunking.token_chunks(t, 6, 0, len)
    assert all(len(x) <= 6 for x in c) and "".join(c).replace("\n", "").replace(" ", "") == t.replace("\n", "").replace(" ", "")
    count = chunking.TokenCounter()
    text = "قانون العمل الموحد في المادة ١٢ من النظام " * 60
    some = chunking.token_chunks(text, 100, 20, count)
    assert len(some) > 5 and all(count(x) <= 110 for x in some)
    assert all(a.split()[-1] in b.split()[:8] for a, b in zip(some, some[1:]))


def test_process_documents_numbers_over_all(spark):
    docs = spark.createDataFrame([(2, "/a/x_y.txt", "المادة 12 " * 30), (1, None, "قانون (law) العمل"), (3, "s", None), (4, "s", "")], "doc_id long, source string, page_content string")
    got = [(r.doc_id, r.source, r.chunk_id) for r in chunking.process_documents(docs.repartition(3), ["doc_id"], 20, 5, chunking.words).orderBy("chunk_id").collect()]
    assert got[0] == (1, None, 1) and {x[:2] for x in got[1:]} == {(2, "x y")} and [x[2] for x in got] == list(range(1, len(got) + 1))


def test_index_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", f"نص رقم {i}") for i in range(200)] + [(200, None, "بلا مصدر")], "k long, source string, page_content string")
    e = providers.HashingEmbedder(8)
    a, b = ({r.id: (r.document, r.metadata) for r in pipelines.build_index(docs.repartition(n), e, ["k"]).collect()} for n in (1, 7))
    assert a == b and len(a) == 201 and '"source"' not in a["chunk_200"][1]


def test_knn_with_string_ids_and_large_numbers(spark):
    rows = [(f"r{i}", [float(1e8 + i), 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "i string, embedding array<double>")
    got = [(r.query_id, r.id, r.distance) for r in knn.knn_join(df.where("i = 'r5'"), df, "i", "i", k=2, metric="l2", exclude_self=True).orderBy("rank").collect()]
    assert got == [("r5", "r4", 1.0), ("r5", "r6", 1.0)]
    assert knn.knn_join(df.limit(0), df, "i", "i").count() == 0 == knn.knn_join(df, df.limit(0), "i", "i").count()


def test_memory_store(spark):
    store = knn.MemoryStore(spark, "Book", providers.HashingEmbedder(16))
    store.add_texts(spark.createDataFrame([(2, "عقد البيع"), (1, "قانون العمل"), (3, None)], "n long, t string"), "t", ["n"])
    store.add_texts(spark.createDataFrame([(9, "سند")], "n long, t string"), "t", ["n"])
    assert [(r.id, r.document) for r in store.rows.orderBy("id").collect()] == [("chunk_0", "قانون العمل"), ("chunk_1", "عقد البيع"), ("chunk_2", "سند")]
    assert store.query(spark.createDataFrame([(1, "عقد البيع")], "q long, t string"), "q", "t", 1).first().id == "chunk_1"


def test_serving_shows_errors_as_rows(spark):
    e = providers.HashingEmbedder(16)
    store = pipelines.build_index(spark.createDataFrame([("a", "قانون العمل")], "source string, page_content string"), e, ["source"])
    q = spark.createDataFrame([(1, "قانون العمل"), (2, "fail")], "query_id long, question string")

    def model(prompt, **options):
        assert options == {}
        if "fail" in prompt:
            raise RuntimeError("503")
        return "ok"

    from unittest import mock

    with mock.patch.object(providers.generate, "__defaults__", (None, "response", 2, lambda s: None, None, None)):
        a = {r.query_id: r for r in pipelines.serve(q, store, e, [model]).collect()}
        h = {r.query_id: r for r in pipelines.serve_by_hypothesis(q, store, e, [model]).collect()}
    assert a[1].answer == "ok" and a[1].documents.startswith("**Document 1:**") and a[2].answer == "An error occurred: 503"
    assert h[1].answer == "ok" and h[1].metadatas.startswith("Metadata 1:") and (h[2].answer, h[2].documents, h[2].metadatas) == ("An error occurred: 503", "", "")




def test_page_marked_lines(spark):
    from daftar.sources import readers

    p = spark.createDataFrame([("s", 2, 7, "c"), ("s", 1, 9, "a\nb")], "source string, page_number long, row_no long, page_content string")
    got = [r.line for r in readers.page_marked_lines(p).orderBy("page_number", "row_no", "line_no").collect()]
    assert got == ["Total pages: 2", "", "Page number: 1", "", "a", "b", "", "Page number: 2", "", "c"]


def test_token_chunks():
    t = " ".join(map(str, range(100)))
    c = chunking.token_chunks(t, 30, 10, chunking.words)
    assert all(len(x.split()) <= 30 for x in c) and c[0].split()[-10:] == c[1].split()[:10]
    assert {w for x in c for w in x.split()} == set(t.split())
    assert chunking.token_chunks("", 5, 1, chunking.words) == []


def test_parse_responses(spark):
    cases = {"Question : ما | جواب": [("ما", "جواب")], "none": [], "x Question : a | b | c Question :  q2\n | \n a2 ": [("q2", "a2")], "Question : a|b": [], "Question :  | ": [("", "")], " Question : q\xa0 | a\x1f": [("q", "a")], None: []}
    for r, want in cases.items():
        df = spark.createDataFrame([(1, r)], "id long, r string")
        assert [(x.question, x.answer) for x in qa.parse_responses(df, "r", ["id"]).collect()] == want


def test_numbered_pairs(spark):
    lines = ["Total pages: 2", "", "Page number: 1", "", "intro", "س 1) ما؟", "جواب  أول", "", "Page number: 2", "تكملة", "س2) فارغ", "س 3) سطر فارغ فقط", "", "س ١) عربي", "x", "UNW", "س 9) last", "end"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    got = [(r.question, r.answer) for r in qa.numbered_pairs(df, "file", "line_no", "line", "UNW").orderBy("pair_no").collect()]
    assert got == [("س 1) ما؟", "جواب  أول  تكملة"), ("س 3) سطر فارغ فقط", ""), ("س ١) عربي", "x"), ("س 9) last", "end")]


def test_fusion_and_union(spark):
    rows = [(1, i, r, x) for i, docs in enumerate(["abc", "bad", "de"]) for r, x in enumerate(docs)]
    df = spark.createDataFrame(rows, "query_id long, list_id int, rank int, doc string")
    f = ranking.reciprocal_rank_fusion(df).orderBy("fused_rank").collect()
    assert [r.doc for r in f] == list("abdec")
    assert math.isclose(f[0].score, 1 / 60 + 1 / 61, abs_tol=1e-8) and math.isclose(f[2].score, 1 / 62 + 1 / 60, abs_tol=1e-8)
    assert [r.doc for r in ranking.unique_union(df).orderBy("position").collect()] == list("abcde")


@pytest.mark.parametrize("truth, k, hr, rr", [("x", 10, 1, 1), ("y", 10, 1, 0.5), ("z", 10, 0, 0), ("y", 1, 0, 0)])
def test_metrics(spark, truth, k, hr, rr):
    got = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (1, 3, "x")], "query_id long, rank int, doc string")
    m = ranking.retrieval_metrics(got, spark.createDataFrame([(1, truth)], "query_id long, doc string"), k).first()
    assert (m.avg_hit_rate, m.avg_reciprocal_rank) == (hr, rr)


@pytest.mark.parametrize("metric", ["cosine", "l2"])
def test_knn_equals_brute_force(spark, metric, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BYTES", 7 * 40)
    monkeypatch.setattr(knn, "BASE_ROWS", 9)
    monkeypatch.setattr(knn, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (80, 5)).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(90, None), (91, [0.0] * 5)], "i long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in knn.knn_join(df.where("i % 4 = 0"), df, "i", "i", k=3, metric=metric, exclude_self=True).collect()}
    ids = [*range(80), 91]
    for q in range(0, 80, 4):
        def d(i):
            y = x[i] if i < 80 else np.zeros(5)
            if metric == "l2":
                return round(float(((x[q] - y) ** 2).sum()), 9)
            n = np.linalg.norm(x[q]) * np.linalg.norm(y)
            return round(1 - float(x[q] @ y) / n, 9) if n else math.inf

        want = sorted((i for i in ids if i != q and d(i) < math.inf), key=lambda i: (d(i), i))[:3] if metric == "l2" or x[q].any() else []
        assert [got[q, r + 1] for r in range(len(want))] == want


def test_vector_store(spark, tmp_path):
    store = knn.VectorStore(spark, f"file://{tmp_path}/s", "m", 2)
    rows = spark.createDataFrame([("a", "x", "{}", [1.0, 0.0]), ("b", "y", "{}", [0.0, 1.0])], store.SCHEMA)
    assert store.count() == 0
    store.add(rows)
    store.add(rows.unionByName(spark.createDataFrame([("c", "z", "{}", [1.0, 1.0])], store.SCHEMA)))
    assert store.count() == 3 and store.get(["c"]).first().document == "z"
    q = spark.createDataFrame([(1, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert [r.id for r in store.query(q, "query_id", 2).orderBy("rank").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        knn.VectorStore(spark, f"file://{tmp_path}/s", "other", 2)
    with pytest.raises(ValueError):
        store.add(spark.createDataFrame([("d", "x", "{}", [1.0])], store.SCHEMA))


def test_numbering_and_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    p = numbering.by_hash(df, ["k"], "s").toPandas()
    assert sorted(p.position) == list(range(1, 1001))
    o = numbering.by_order(df.withColumn("one", F.lit(1)), ["one", "k"]).toPandas()
    assert (o.position == o.k + 1).all()
    assert numbering.by_order(df.limit(0), ["k"]).count() == 0
    assert sampling.train_test_split(df, "k").where("is_test").count() == 200
    b = sampling.batches(df, "k", 32).toPandas().batch.value_counts()
    assert (b == 32).sum() == 31 and b.sum() == 1000
    n = sampling.negatives(df, "k", spark.range(5, 15).withColumnRenamed("id", "c"), "c").toPandas()
    assert len(n) == 1000 and set(n.negative) == set(range(5, 15))
    assert sampling.negatives(df, "k", spark.range(0).withColumnRenamed("id", "c"), "c").count() == 0


def test_vectors(spark):
    df = spark.sql("select array(1D, 2D) a, array(0D, 0D) p, array(1D, 1D) n, array(array(1D, 2D), array(0D, 3D)) w, array(1D, 1D) b")
    r = df.select(V.triplet_loss("a", "p", "n").alias("t"), V.linear("a", "w", "b").alias("y"), V.cosine_distance("a", "p").alias("z"), V.squared_l2("a", "n").alias("l")).first()
    assert round(r.t, 6) == 2.236068 and r.y == [6.0, 7.0] and r.z is None and r.l == 1.0
    steps = {0: 0, 50: 0.5, 100: 1, 200: 0.5, 300: 0, 400: 0}
    for s, want in steps.items():
        assert spark.range(s, s + 1).select(V.warmup_schedule("id", 100, 300)).first()[0] == want == adapter.schedule(s, 100, 300)


def test_adapter_learns(spark):
    rng = np.random.default_rng(0)
    p = rng.standard_normal((120, 4))
    turn = np.linalg.qr(rng.standard_normal((4, 4)))[0]
    t = pd.DataFrame({"query": list(p @ turn), "positive": list(p), "negative": list(rng.permutation(p))})
    w, b, losses = adapter.train_local(t, epochs=15, lr=0.02, warmup=5)
    assert losses[-1] < 0.7 * losses[0]
    df = spark.createDataFrame([(q.tolist(), x.tolist(), n.tolist()) for q, x, n in t.itertuples(index=False)], "query array<double>, positive array<double>, negative array<double>")
    df = df.withColumn("k", F.monotonically_increasing_id())
    for block in (1000, 50):  # one block, and three whose states are averaged
        w, b, losses = adapter.train(df, 4, "k", block, adapter.Settings(epochs=15, lr=0.02, warmup=5))
        assert len(losses) == 15 and losses[-1] < 0.75 * losses[0]
    assert adapter.train(df.limit(0), 4, "k")[2] == []
    one = adapter.apply(spark.createDataFrame([([1.0, 0.0, 0.0, 0.0],), (None,)], "v array<double>"), "v", w, b).collect()
    assert np.allclose(one[0].adapted, w[:, 0] + b, atol=1e-5) and one[1].adapted is None


def test_gradient():
    rng = np.random.default_rng(2)
    w, b, q, p, n = rng.standard_normal((3, 3)), rng.standard_normal(3), *rng.standard_normal((3, 5, 3))
    _, gw, gb = adapter.loss_and_gradient(w, b, q, p, n, 5.0)
    e = np.zeros((3, 3))
    e[1, 2] = 1e-6
    up, down = adapter.loss_and_gradient(w + e, b, q, p, n, 5.0)[0], adapter.loss_and_gradient(w - e, b, q, p, n, 5.0)[0]
    assert abs((up - down) / 2e-6 - gw[1, 2]) < 1e-4


def test_models_get_the_options_that_are_set(spark):
    df = spark.createDataFrame([("a b c",)], "p string")
    assert providers.generate(df, "p", max_tokens=2, temperature=0.7).first().response == "a b"
    assert providers.generate(df, "p", [lambda p: p.upper()]).first().response == "A B C"


def test_retry():
    calls = []

    def model(i, errors):
        def call(p):
            calls.append(i)
            if errors:
                raise RuntimeError(errors.pop(0))
            return f"{i}:{p}"

        return call

    waits = []
    assert providers.with_retry([model(0, ["429"]), model(1, ["503 gone"])], "p", wait=waits.append) == ("1:p", 3, None, 1)
    assert calls == [0, 1, 1] and waits == [2, 5]
    waits.clear()
    answer, n, error, _ = providers.with_retry([model(0, ["x"] * 9)], "p", attempts=3, wait=waits.append)
    assert answer is None and n == 3 and error == "x" and waits == [2, 2]
    assert providers.with_retry.__defaults__[1] is time.sleep


def test_pipelines(spark):
    e = providers.HashingEmbedder(32)
    docs = spark.createDataFrame([("/a/x_1.txt", "Page number: 1\nقانون العمل\nPage number: 2\nعقد البيع"), ("/a/y.txt", None)], "source string, page_content string")
    store = pipelines.build_index(docs, e, ["source"], size=20)
    rows = store.orderBy("id").collect()
    assert [r.id for r in rows] == ["chunk_0", "chunk_1"] and rows[0].document == "قانون العمل"
    q = spark.createDataFrame([(1, "عقد البيع"), (2, "قانون العمل")], "query_id long, question string")
    hits = pipelines.retrieve(q, store, e, k=1).orderBy("query_id").collect()
    assert [h.document for h in hits] == ["عقد البيع", "قانون العمل"]
    a = pipelines.answer(q, store, e, k=1).orderBy("query_id").collect()
    assert a[0].context == "عقد البيع" and a[0].response == "### Answer:" and a[0].error is None
    assert pipelines.answer_by_hypothesis(q, store, e, k=1).count() == 2
    lists = pipelines.multi_query(q, store, e, k=2)
    assert pipelines.united(lists).count() == 4 and pipelines.fused(lists).where("fused_rank = 1").count() == 2
    ev = pipelines.evaluate(q.withColumn("context", F.col("question")), store, e, k=1).first()
    assert ev.avg_hit_rate == 1.0 == ev.avg_reciprocal_rank
    g = pipelines.generate_pairs(spark.createDataFrame([("c",)], "page_content string"), [lambda p: "Question : q | a"]).collect()
    assert [(r.context, r.question, r.answer) for r in g] == [("c", "q", "a")]


def test_lexical(spark):
    d = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "i long, t string")
    w = {(r.i, r.term): r.weight for r in lexical.tf_idf(d, "i", "t").collect()}
    assert math.isclose(w[2, "b"] ** 2 + w[2, "c"] ** 2, 1) and w[2, "c"] > w[2, "b"]
    r = lexical.bm25(spark.createDataFrame([(9, "c x")], "q long, s string"), d, "q", "i", "s", "t").collect()
    assert [(x.query_id, x.doc_id, x["rank"]) for x in r] == [(9, 2, 1)]


def test_registered_adapter_is_trained(spark):
    """The loss of the reference's 30 epochs; four full-batch steps stayed above 0.98."""
    r = {x.model: x.loss for x in registry.QUERIES["adapter_training"](spark, "/root/testdata/sf0.001").collect()}
    assert r["adapted"] < 0.7 < 0.9 < r["base"]
