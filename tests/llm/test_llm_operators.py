import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from daftar.llm import answer_defects, eval_leaks, lookalikes, mixing, mojibake, pieces, queries, scan_noise, site_lines, split_overlap, vector_neighbors
from daftar.llm.codes import Words, grams, winnow

D = "/root/testdata/sf0.001"


# --- 1 ---------------------------------------------------------------------------------------------------------


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=14))
@settings(max_examples=200, deadline=None)
def test_edit_distance(a, b):
    t = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, t[0] = t[0], i
        for j, y in enumerate(b, 1):
            before, t[j] = t[j], min(t[j] + 1, t[j - 1] + 1, before + (x != y))
    assert split_overlap.edit_distance(a, b) == t[-1]
    assert split_overlap.chained_distance(a, b, 2) >= t[-1]


def test_winnowing_guarantee():
    rnd = random.Random(1)
    for _ in range(200):
        run = [str(rnd.randrange(50)) for _ in range(5)]
        texts = [" ".join([str(rnd.randrange(50)) for _ in range(rnd.randrange(9))] + run + [str(rnd.randrange(50)) for _ in range(rnd.randrange(9))]) for _ in range(2)]
        w = Words(texts)
        g, at = grams(w.hashes, w.text, 4)
        kept = winnow(g, at, w.text, 2)
        a, b = (set(g[kept][w.text[at[kept]] == i].tolist()) for i in (0, 1))
        assert a & b


@pytest.mark.parametrize("hot", [10**9, 3, 0])
def test_overlaps_equal_brute_force(spark, hot):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]

    def text(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    def change(words):
        out = list(words)
        for _ in range(len(words) // 8):
            i = rnd.randrange(len(out))
            rnd.choice([lambda: out.pop(i), lambda: out.insert(i, "neu"), lambda: out.__setitem__(i, "neu")])()
        return out

    rows, n = [], 0
    for i in range(60):
        q, c = text(rnd.randrange(8, 25)), text(rnd.randrange(30, 90))
        for split in ("train", rnd.choice(["validation", "test"])) if i % 2 else ("train",):
            n += 1
            a, b = (q, c) if split == "train" else (change(q), change(c))
            rows.append((n, split, "s", " ".join(a) + "؟", "\n".join(b)))
    rows += [(900, "test", "s", None, "c"), (901, "train", "s", "q", None), (902, "test", "s", "!", "!")]
    qa = spark.createDataFrame(rows, "row_id long, split string, source string, question string, context string")
    got = {(r.row_id_a, r.row_id_b) for r in split_overlap.found(qa.repartition(3)).collect()} if hot == 10**9 else {tuple(sorted((r.train_id, r.eval_id))) for r in split_overlap.overlaps(qa, hot).collect()}
    want = set()
    for a in rows[:-3]:
        for b in rows[:-3]:
            if a[1] == "train" != b[1]:
                far = [split_overlap.edit_distance(x.rstrip("؟").split(), y.rstrip("؟").split()) / max(len(x.split()), len(y.split())) for x, y in ((a[3], b[3]), (a[4], b[4]))]
                if max(far) <= split_overlap.DIFFER:
                    want.add(tuple(sorted((a[0], b[0]))))
    assert len(want) == 30 and got == want


def test_overlaps_with_changes_evenly_spread(spark):
    """One word in eight replaced at even spacing in long contexts, one dropped from short ones: no pair is lost."""
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        q = " ".join(f"q{i}w{j}" for j in range(rnd.choice([8, 12, 16, 24])))
        n = rnd.choice([8, 16, 48, 96, 190])
        c = [f"c{rnd.randrange(10**9)}" for _ in range(n)]
        other = list(c)
        for j in [(k + 1) * n // (n // 8 + 1) for k in range(n // 8)][::-1]:
            other[j : j + 1] = [] if n < 48 else [f"d{j}"]
        rows += [(2 * i, "train", "s", q, " ".join(c)), (2 * i + 1, "test", "s", q, " ".join(other))]
    qa = spark.createDataFrame(rows, "row_id long, split string, source string, question string, context string")
    assert {(r.row_id_a, r.row_id_b) for r in split_overlap.found(qa).collect()} == {(2 * i, 2 * i + 1) for i in range(3000)}


@pytest.mark.parametrize("hot", [10**9, 3, 0])
def test_overlaps_of_short_texts(spark, hot):
    """Runs of four words in questions, of four to seven in contexts; every question has four words that all others have, so they are hot."""
    rnd = random.Random(2)

    def change(words, at):
        out = list(words)
        for j in at:
            out[j] = f"n{rnd.randrange(10**9)}"
        return out

    rows = []
    for i in range(300):
        n = rnd.choice([8, 9, 10])
        q = ["what", "does", "the", "law", *(f"q{i}w{j}" for j in range(4, n))]
        m = rnd.choice([8, 9, 12, 16, 24, 48, 56])
        c = [f"c{i}w{j}" for j in range(m)]
        e = m // 8
        other = change(c, [(k + 1) * m // (e + 1) for k in range(e)])
        rows += [(2 * i, "train", "s", " ".join(q), " ".join(c)), (2 * i + 1, "test", "s", " ".join(change(q, [4])), " ".join(other))]
    qa = spark.createDataFrame(rows, "row_id long, split string, source string, question string, context string")
    assert {(r.train_id, r.eval_id) for r in split_overlap.overlaps(qa, hot).collect()} == {(2 * i, 2 * i + 1) for i in range(300)}


@pytest.mark.parametrize("hot", [10**9, 3, 0])
def test_overlaps_around_the_share_that_may_differ(spark, hot):
    """Questions and contexts with none to a quarter of their words changed, among many with four words of theirs: those within one in eight come out, whatever is hot."""
    rnd = random.Random(8)

    def change(words, n):
        out = list(words)
        for j in rnd.sample(range(len(out)), n):
            out[j] = f"n{rnd.randrange(10**9)}"
        return out

    rows = []
    for i in range(400):
        q = [f"q{i}w{j}" for j in range(rnd.choice([7, 8, 9, 10, 12, 16, 17, 24]))]
        q[1:5] = ["what", "does", "the", "law"]
        c = [f"c{i}w{j}" for j in range(rnd.choice([8, 12, 20, 60]))]
        rows += [(2 * i, "train", "s", q, c), (2 * i + 1, "test", "s", change(q, rnd.randrange(len(q) // 4 + 1)), change(c, rnd.randrange(len(c) // 4 + 1)))]
    # a passage marked in two places, so that all words in a row that are unique in both texts stand in the wrong place
    r = [f"r{j}" for j in range(20)]
    s = r[:10] + ["x"] + r[11:]
    rows += [(1000, "train", "s", [f"m{j}" for j in range(12)], r + s + r * 4), (1001, "test", "s", [f"m{j}" for j in range(12)], r * 4 + s + r)]
    want = {(a[0], b[0]) for a, b in zip(rows[::2], rows[1::2]) if all(8 * split_overlap.edit_distance(x, y) <= len(x) for x, y in zip(a[3:], b[3:]))}
    qa = spark.createDataFrame([(*x[:3], " ".join(x[3]), " ".join(x[4])) for x in rows], "row_id long, split string, source string, question string, context string")
    assert 50 < len(want) < 350 and (1000, 1001) in want
    assert {(r.train_id, r.eval_id) for r in split_overlap.overlaps(qa, hot).collect()} == want


def test_overlaps_of_copies(spark):
    """Three copies in train and two in test of one record, and a near copy: every pair of rows comes out."""
    q, c = "how may the debtor divide the boundary plan if the employer has refused", " ".join(f"c{i}" for i in range(40))
    rows = [(i, "train" if i < 3 else "test", "s", q, c) for i in range(5)] + [(9, "validation", "t", q.replace("debtor", "buyer"), c)]
    qa = spark.createDataFrame(rows, "row_id long, split string, source string, question string, context string")
    got = sorted((r.row_id_a, r.row_id_b) for r in split_overlap.found(qa).collect())
    assert got == sorted((a, b) for a in range(3) for b in (3, 4, 9))
    r = {x.row_id: (x.links, x.context_coverage) for x in split_overlap.records(qa).collect()}
    assert r == {3: (3, 1.0), 4: (3, 1.0), 9: (3, 1.0)}


def test_kept_hashes_of_short_questions_meet():
    for n in (8, 9):
        for k in range(300):
            a = [f"k{k}w{j}" for j in range(n)]
            for b in (a[:4] + ["x"] + a[5:], a[:4] + ["x"] + a[4:], a[:4] + a[5:]):
                w = Words([" ".join(a), " ".join(b)])
                h, t, _, _ = split_overlap.kept(w, split_overlap.SEED, split_overlap.WINDOW, split_overlap.FEW)
                assert set(h[t == 0]) & set(h[t == 1])


def test_overlap_ignores_forms(spark):
    a = "How can the debtor divide the boundary plan if the employer has refused"
    rows = [(1, "train", "s", a, "قانون العمل المُوَحَّد في المادة ١٢ من النظام"), (2, "test", "t", "Ηοw  can the DEBTOR divide, the boundary plan​ if the employer has refused?", "قانون العمل الموحد في المادة 12 من النظام"), (3, "test", "t", a, "لائحة أخرى تماماً لا علاقة لها بما سبق من القول")]
    qa = spark.createDataFrame(rows, "row_id long, split string, source string, question string, context string")
    assert [(r.row_id_a, r.row_id_b) for r in split_overlap.found(qa).collect()] == [(1, 2)]
    r = {(x.split, x.source): (x.records, x.leaked) for x in split_overlap.report(qa).collect()}
    assert r == {("test", "t"): (2, 1)}


# --- 2 ---------------------------------------------------------------------------------------------------------


def test_neighbours_recall_and_copies(spark, monkeypatch):
    monkeypatch.setattr(vector_neighbors, "PER_CELL", 40)
    monkeypatch.setattr(vector_neighbors, "BLOCK", 100)
    monkeypatch.setattr(vector_neighbors, "QUERY_BLOCK", 300)
    rng = np.random.default_rng(3)
    mid = rng.standard_normal((12, 64))
    x = mid[rng.integers(0, 12, 1500)] + 0.6 * rng.standard_normal((1500, 64))
    x[100:140] = x[100]  # a class of copies
    x *= rng.uniform(0.1, 9, (1500, 1))
    x[100:140] = x[100]
    rows = [(i + 1, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 64), (5002, [1.0] * 48), (5003, [float("nan")] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in vector_neighbors.neighbours(df).orderBy("vec_id", "rank").collect():
        got[r.vec_id].append(r.neighbour_id)
    u = np.array([r[1] for r in rows[:1500]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for i in range(1500):
        s = np.round(u @ u[i], 12)
        s[i] = -9
        want = (np.lexsort((np.arange(1500), -s))[:10] + 1).tolist()
        assert i + 1 not in got[i + 1] and len(got[i + 1]) == 10
        hit += len(set(want) & set(got[i + 1]))
        if 100 <= i < 140:
            assert got[i + 1] == [j for j in range(101, 113) if j != i + 1][:10]
    assert hit >= 0.97 * 15000
    assert not set(got) & {5000, 5001, 5002, 5003}


def test_packed_products_estimate_the_exact_ones():
    """The bit counts agree with the unpacked signs, and the bound holds as often as it promises."""
    rng = np.random.default_rng(4)
    x = vector_neighbors.unit(pd.Series(list(rng.standard_normal((600, 64)) + 2 * rng.standard_normal(64))))
    c, rot = x[:500].mean(0, keepdims=True), vector_neighbors.rotation(64)
    codes, scalars = vector_neighbors.coded(x[:500], c, np.zeros(500, int), rot)
    cell = vector_neighbors.Cell(x[:500], np.arange(500), codes, scalars, c[0], rot)
    e = (x[500:] - c[0]) @ rot
    sums, low, total, error = cell._products(e)
    signs = np.where((x[:500] - c[0]) @ rot > 0, 1.0, -1.0)
    got = 2 * (sums + low[:, None] * np.bitwise_count(codes).sum(1)) - total[:, None]
    assert (np.abs(got - e @ signs.T) <= error[:, None]).mean() > 0.93
    estimate = got * scalars[:, 0]
    exact = e @ ((x[:500] - c[0]) @ rot).T
    bound = scalars[:, 2] * np.sqrt((e * e).sum(1))[:, None] + error[:, None] * scalars[:, 0]
    assert (np.abs(estimate - exact) <= bound).mean() > 0.94


def test_isotropic_vectors_visit_enough_cells(spark, monkeypatch):
    """Without clusters the calibration visits many cells; recall stays."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in vector_neighbors.neighbours(df).collect():
        got[r.vec_id].add(r.neighbour_id)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u[:300] @ u.T
    s[np.arange(300), np.arange(300)] = -9
    want = np.argsort(-s, axis=1)[:, :10]
    assert sum(len(got[i] & set(want[i].tolist())) for i in range(300)) >= 0.97 * 3000


# --- 3 ---------------------------------------------------------------------------------------------------------


def test_defects(spark):
    c = "يجب على المدين سداد الرسم خلال 5 أيام. يلتزم البائع بتسليم المبيع إلى المشتري."
    q = "متى يجب على المدين سداد الرسم المستحق؟"
    e = "When must the debtor pay the fee that is due?"
    cases = [
        (q, None, "empty"), (q, " ​\n", "empty"), (q, "N/A", "empty"), (q, "_____", "empty"), (q, "لا شيء", "empty"), (q, "«»", "empty"),
        (q, "عذراً، لا أستطيع الإجابة عن هذا السؤال", "refusal"), (e, "I'm sorry, but I can't help with that request.", "refusal"), (e, "Désolé, le passage fourni ne contient pas la réponse...", "refusal"),
        (q, "يعتذر المدين كتابة ثم يلتزم البائع بتسليم المبيع إلى المشتري.", None),
        (q, q, "copy"), (q, "الجواب: " + q, "copy"), (q, f"{q} {q}", "copy"), (e, "(" + e.upper() + ")", "copy"), (q, q + " والجواب أنه يلتزم البائع بتسليم المبيع إلى المشتري.", None),
        (q, "The debtor must pay the fee within the agreed term.", "language"), (e, "Le débiteur doit payer la somme avant que le délai soit fini.", "language"), (e, "يلتزم البائع بتسليم المبيع إلى المشتري.", "language"),
        (q, "يلتزم البائع بتسليم المبيع إلى،", "truncated"), (q, "يلتزم البائع بتسليم (المادة", "truncated"), (q, "يلتزم البائع. ثانياً:", "truncated"), (e, "The debtor must pay the fee. 2)", "truncated"), (q, "يلتزم البائع بتسليم المب", "truncated"), (q, "يلتزم البائع بتسليم…", "truncated"), (q, "يلتزم البائع بتسليم المبيع إلى", "truncated"),
        (e, "I'm afraid I have no information about that.", "refusal"), (q, "عذرا، لا أعرف الجواب.", "refusal"), (e, "Sorry, I don't know.", "refusal"), (e, "Lo siento, no puedo responder a esa pregunta.", "refusal"), (e, "К сожалению, я не могу ответить на этот вопрос.", "refusal"),
        (e, "A judge may say I cannot answer only where the law forbids it.", None), (q, "You asked: " + q, "copy"), (e, "Here you go: " + e, "copy"), (e, "When must the debtor pay the fee that is due? Within five days of the notice.", None),
        (e, "El deudor debe pagar la suma antes de que termine el plazo.", "language"), (q, "Der Schuldner muss die Gebühr vor dem Ablauf der Frist zahlen.", "language"), (q, "Должник должен уплатить сбор до окончания срока.", "language"), (q, "بدهکار باید هزینه را پیش از پایان مهلت بپردازد و رسید آن را بگیرد.", "language"),
        (q, "يلتزم البائع بتسليم المبيع إلى المشتري", None), (q, "يلتزم البائع بتسليم المبيع إلى المشتري.", None), (None, "يلتزم البائع بتسليم المبيع إلى المشتري.", None), (None, None, "empty"),
    ]
    rows = [(i, "s", x, c, a) for i, (x, a, _) in enumerate(cases)]
    qa = spark.createDataFrame(rows, "row_id long, source string, question string, context string, answer string")
    got = {r.row_id: r.defect for r in answer_defects.found(qa).collect()}
    assert [(i, got.get(i)) for i in range(len(cases))] == [(i, d) for i, (_, _, d) in enumerate(cases)]
    assert sum(r.rows for r in answer_defects.report(qa).collect()) == len(got)


@given(st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcde"), max_size=12), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_suffix_automaton(q, a, run):
    runs = {tuple(q[i:j]) for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
    want = [any(tuple(a[i:j]) in runs for i in range(k + 1) for j in range(k + 1, len(a) + 1) if j - i >= run) for k in range(len(a))]
    assert answer_defects.SuffixAutomaton(q).copied(a, run) == want


# --- 4 ---------------------------------------------------------------------------------------------------------


def test_canonical():
    same = {"ＳＥＣ": "SEC", "SЕС-9": "SEC-9", "οf thе": "of the", "café": "café", "الجدار‌ الفاصل": "الجدار الفاصل", "ﻻ ﺍﻟﻤﺎﺩﺓ": "لا المادة", "علی کتاب ۰۸": "على كتاب ٠٨", "a b　c": "a b c", "أحكام": "أحكام", "in\xadvisible": "invisible"}
    for a, b in same.items():
        assert lookalikes.canonical(a) == unicodedata.normalize("NFC", b), a
    for t in ("نص عادي مُشَكَّل ـ ممدود\n12 a\tb", "Москва и Київ", "x² ½ é", "«São» £ § ±"):
        t = unicodedata.normalize("NFC", t)
        assert lookalikes.canonical(t) == t


@given(st.text(max_size=30))
@settings(max_examples=300, deadline=None)
def test_canonical_is_a_fixed_point(t):
    a = lookalikes.canonical(t)
    assert lookalikes.canonical(a) == a
    assert lookalikes.suspicious([t])[0] or a == t


def test_lookalike_groups(spark):
    rows = [(1, "How can", "c"), (2, "Ηow can", None), (3, None, "ﺍﻟﻌﻘﺪ"), (4, "other", "")]
    qa = spark.createDataFrame(rows, "row_id long, question string, context string")
    assert sorted(map(tuple, lookalikes.found(qa).collect())) == [(2, "question"), (3, "context")]
    g = lookalikes.groups(qa, "question").collect()
    assert [(r.rows, r.originals) for r in g] == [(2, 2)]
    n = {r.row_id: r.question for r in lookalikes.normalised(qa, ["question", "context"]).collect()}
    assert n[1] == n[2] and n[3] is None


def test_lookalike_groups_of_both_fields_with_their_rows(spark, tmp_path):
    rows = [(1, "How can", "العقد"), (2, "Ηow can", "other"), (3, None, "ﺍﻟﻌﻘﺪ"), (4, "other", ""), (5, "How can", "العقد")]
    spark.createDataFrame(rows, "row_id long, question string, context string").write.parquet(f"{tmp_path}/qa_pairs.parquet")
    g = {r.field_name: r for r in queries.QUERIES["p4_groups"](spark, str(tmp_path)).collect()}
    assert {f: (r.rows, r.originals) for f, r in g.items()} == {"question": (3, 2), "context": (3, 2)}
    m = queries.QUERIES["p4_members"](spark, str(tmp_path)).collect()
    want = {(i, "question") for i in (1, 2, 5)} | {(i, "context") for i in (1, 3, 5)}
    assert {(r.row_id, r.field_name) for r in m} == want and len(m) == 6
    assert all(r.skeleton == g[r.field_name].skeleton for r in m)


# --- 5 ---------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="abج .،\n", max_size=150), st.integers(1, 40), st.integers(0, 45))
@settings(max_examples=400, deadline=None)
def test_pieces(text, limit, overlap):
    c = pieces.cuts(text, limit, overlap)
    assert all(b - a <= limit for a, b in c) and c[0][0] == 0 and c[-1][1] == len(text)
    assert text == text[: c[0][1]] + "".join(text[p[1] : q[1]] for p, q in zip(c, c[1:]))
    assert all(p[1] - q[0] == min(overlap, limit - 1) for p, q in zip(c, c[1:]))
    assert (len(c) == 1) == (len(text) <= limit)


def test_cohesion_equals_direct_count():
    rnd = random.Random(2)
    words = [rnd.choice("abcdef") for _ in range(120)]
    text = " ".join(words)
    at = np.arange(2, len(text), 2)
    got = pieces.cohesion(Words([text]), at)
    for g, p in zip(got, range(1, 120)):
        a, b = Counter(words[max(0, p - pieces.BLOCK_WORDS) : p]), Counter(words[p : p + pieces.BLOCK_WORDS])
        want = sum(a[x] * b[x] for x in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
        assert abs(g - want) < 1e-9


def test_cut_at_topic_change():
    a = "العقد شريعة المتعاقدين والعقد ملزم. " * 12
    b = "تطير الطيور فوق البحر كل صباح. " * 12
    text = a + b
    assert abs(pieces.cuts(text, 500, 0)[0][1] - len(a)) <= 2


def test_numbering(spark):
    c = spark.read.parquet(f"{D}/chunks.parquet")
    p = pieces.numbered(c, spark.read.parquet(f"{D}/sources.parquet"), spark.read.parquet(f"{D}/split_limits.parquet")).toPandas()
    for _, g in p.groupby("source"):
        assert sorted(g.chunk_id) == list(range(1, len(g) + 1))
        o = g.sort_values("chunk_id")
        assert (o.old_chunk_id.diff().dropna() >= 0).all()


# --- 6 ---------------------------------------------------------------------------------------------------------


def key(line):
    line = unicodedata.normalize("NFKC", line)
    return "".join(x.lower() for x in line if unicodedata.category(x)[0] in "LN" and x != "ـ")


def test_repeated_lines_equal_brute_force(spark):
    rnd = random.Random(4)
    rows, k = [], 0
    lines = ["Back to top", "BACK​ to—top!", "جميع الحقوق محفوظة FoDi 2013", "جميع الحُقوق محفـوظة fodi 2013", "***", "", "جميع الحقوق محفوظة FoDi 2014"]
    for s, n in (("a", 30), ("b", 200), (None, 9)):
        for _ in range(n):
            k += 1
            body = ["".join(rnd.choices("abcdefghijklmnop", k=12))] * 2 + [x for x in lines if rnd.random() < (0.3 if s == "a" else 0.03)]
            rnd.shuffle(body)
            rows.append((k, s, "\n".join(body)))
    rows.append((k + 1, "a", None))
    count, total = defaultdict(set), Counter(r[1] for r in rows)
    for i, s, t in rows:
        for x in (t or "").split("\n"):
            if s and key(x):
                count[s, key(x)].add(i)
    want = {(i, j + 1) for i, s, t in rows if s and t for j, x in enumerate(t.split("\n")) if key(x) and len(count[s, key(x)]) >= max(5, 0.05 * total[s])}
    df = spark.createDataFrame(rows, "chunk_key long, source string, page_content string")
    assert {(r.chunk_key, r.line_no) for r in site_lines.found(df).collect()} == want and want
    c = {r.chunk_key: r for r in site_lines.clean(df).collect()}
    # clusters hold lines that differ in numbers only, so the line of 2014 goes with that of 2013
    rights = "".join(filter(str.isalpha, key(lines[2])))
    gone = want | {(i, j + 1) for i, s, t in rows if s and t for j, x in enumerate(t.split("\n")) if rights in key(x) and any((a, b) in want and rights in key(u.split("\n")[b - 1]) for a, v, u in rows if v == s and u for b in range(1, u.count("\n") + 2))}
    for i, s, t in rows:
        kept = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if (i, j + 1) not in gone)
        assert c[i].page_content == kept
    assert sum(r.lines for r in site_lines.report(df).collect()) == len(gone)


def test_lines_with_other_dates_and_small_misreadings_are_one_cluster(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(100):
        own = " ".join(rnd.choice("abcdefghij") * rnd.randrange(2, 6) + str(i) for _ in range(9))
        rows.append((i, "s", f"{own}\nPublished on 2024-0{1 + i % 9}-1{i % 10} by desk {i}\nAll rights of this gazette are re{'s' if i % 3 else 'z'}erved and no part may be copied"))
    df = spark.createDataFrame(rows, "chunk_key long, source string, page_content string")
    assert all(r.page_content.count("\n") == 0 and r.lines_removed == 2 for r in site_lines.clean(df).collect())
    assert sorted((r.chunks, r.lines) for r in site_lines.report(df).collect()) == [(100, 100), (100, 100)]
    assert {r.line_no for r in site_lines.found(df).collect()} == {3}



# --- 7 ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lex():
    words = "the landlord must deliver inventory of pledge notice to court under article and seal it before hearing procès-verbal procès verbal العقار المفرز في قانون المحكمة على المدين سداد الرسم تسليم".split()
    return scan_noise.Lexicon({w: 1000 for w in words} | {"عقد": 4000, "عقذ": 12})


def page(text, lex, titles=("Practical Notes on the Lease",)):
    bare = [[x for x in scan_noise.fold(t) if not x.isspace()] for t in titles]
    p = scan_noise.Page(text, bare, set(), lex)
    return p, p.paragraphs()


def test_scan_noise(lex):
    p, t = page("the landl-\nord must de1iver the inven¬\n— 12 —\ntory of the\nPract!cal Notes on the Lease | 77\npledge noticc.", lex)
    assert p.kinds == {"hyphen", "char", "page_number", "header"}
    assert t == "the landlord must deliver the inventory of the pledge notice."
    p, t = page("the procès-\nverbal of the court.\nالمادة 9", lex)
    assert p.kinds == set() and "procès-verbal" in t
    for line in ("صفحة 531", "- ٤٦٣ -", "[9]", "9 / 12", "Page number: 193", "ص 4", "17"):
        assert page(f"the court\n{line}\nunder article", lex)[0].kinds == {"page_number"}, line
    p, t = page("قانون ا1مفرز على العق|ر", lex)
    assert p.kinds == {"char"} and t == "قانون المفرز على العقار"
    assert page("ABX-77 zzkq الموكل", lex)[0].kinds == set()
    assert "عقد" in lex.cost and "عقذ" not in lex.cost  # a frequent misreading


def test_decode_splits_and_merges(lex):
    assert scan_noise.decode(["thecourt"], lex) == [("split", "the court", 1)]
    assert scan_noise.decode(["land", "lord"], lex)[0] == ("merge", "landlord", 2)


def test_scan_noise_end_to_end(spark):
    words = "the landlord must deliver the inventory of the pledge notice to the court under the article"
    rows = [(i, "p", words) for i in range(40)] + [(100, "s", words.replace("landlord", "landl0rd")), (101, "p", words.replace("landlord", "landl0rd")), (102, None, "the inven-\ntory\nThe Big Title\n5"), (103, "s", None), (104, "s", "")]
    chunks = spark.createDataFrame(rows, "chunk_key long, source string, page_content string")
    qa = spark.createDataFrame([(1, "s", "the land¬\nlord")], "row_id long, source string, context string")
    sources = spark.createDataFrame([("p", "portal", "X"), ("s", "scan", "The Big Title")], "source string, kind string, title string")
    got = sorted(map(tuple, scan_noise.found(chunks, qa, sources).collect()))
    assert got == [("chunks", 100, "char"), ("chunks", 102, "header"), ("chunks", 102, "hyphen"), ("chunks", 102, "page_number"), ("qa_pairs", 1, "hyphen")]
    r = {x.row_key: x.text for x in scan_noise.repaired(chunks, qa, sources).collect()}
    assert r[102] == "the inventory" and r[100] == words


def test_repeated_lines_are_those_of_the_own_source(spark):
    """Two scanned sources without titles: the lines that one repeats are text in the other."""
    words = "the tenant must return the inventory to the landlord before the lease ends and the notary keeps it".split()
    rnd = random.Random(6)
    rows = [(i, "ab"[i % 2], " ".join(rnd.choice(words) for _ in range(120)) + "\n" + ("the notary keeps the lnventory" if i in range(0, 22, 2) else "the landlord waits")) for i in range(400)] + [(999, "b", "the lease ends\nthe notary keeps the lnventory")]
    chunks = spark.createDataFrame(rows, "chunk_key long, source string, page_content string").coalesce(1)
    qa = spark.createDataFrame([], "row_id long, source string, context string")
    sources = spark.createDataFrame([("a", "scan", None), ("b", "scan", None)], "source string, kind string, title string")
    got = {r.row_key for r in scan_noise.found(chunks, qa, sources).where("noise = 'char'").collect()}
    assert got == {999}


# --- 8 ---------------------------------------------------------------------------------------------------------


def holds(doc, item, n=25, most=2):
    """Whether n running words of item are in doc with at most ``most`` edits: semi-global alignment of every window."""
    for i in range(len(item) - n + 1):
        row = [0] * (len(doc) + 1)
        for j, x in enumerate(item[i : i + n], 1):
            before, row[0] = row[0], j
            for k, y in enumerate(doc, 1):
                before, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, before + (x != y))
        if min(row) <= most:
            return True
    return False


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, "test", [rnd.choice(vocabulary) for _ in range(rnd.choice([10, 26, 60]))]) for i in range(8)]
    docs = []
    for d in range(70):
        body = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 60))]
        it = rnd.choice(items)[2]
        n = rnd.choice([12, 20, 24, 25, 26, 40])
        if len(it) >= n:
            i = rnd.randrange(len(it) - n + 1)
            part = it[i : i + n]
            for _ in range(rnd.randrange(4)):
                j = rnd.randrange(1, len(part) - 1)
                rnd.choice([lambda: part.pop(j), lambda: part.insert(j, "zz"), lambda: part.__setitem__(j, "zz")])()
            at = rnd.randrange(len(body) + 1)
            body[at:at] = part
        docs.append((d, body))
    want = {(d, i) for d, b in docs for i, _, t in items if holds(b, t)}
    documents = spark.createDataFrame([(d, "  \n".join(x.upper() + "," for x in b)) for d, b in docs] + [(99, None), (98, "")], "doc_id long, text string")
    ev = spark.createDataFrame([(i, s, " ".join(t)) for i, s, t in items] + [(77, "test", None)], "item_id long, split string, text string")
    got = {(r.doc_id, r.item_id) for r in eval_leaks.found(documents, ev).collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 15
    r = {x.item_id: x.documents for x in eval_leaks.report(documents, ev).collect()}
    assert sum(r.values()) == len(got) and r[77] == 0


def test_leaks_of_any_length_at_the_bound(spark):
    """One word in ten changed, evenly spaced or anywhere: passages of 25 to 60 words, and one that begins where another pair of texts ends alike."""
    rnd = random.Random(4)
    items, docs = [], []
    for k in range(240):
        n = [25, 30, 33, 39, 40, 44, 49, 60][k % 8]
        part = [f"k{k}w{j}" for j in range(n)]
        items.append((k, "test", " ".join(part)))
        m = n // 10
        for i in sorted([(j + 1) * n // (m + 1) for j in range(m)] if k % 16 < 8 else rnd.sample(range(n), m), reverse=True):
            part[i : i + 1] = [[], ["zz"], ["zz", part[i]]][rnd.randrange(3)]
        docs.append((k, " ".join(["vor"] * rnd.randrange(3) + part + ["nach"])))
        few = [f"k{k}w{j}" for j in range(n)]
        for i in range(4, n, 8):
            few[i] = "zz"  # one in eight
        docs.append((1000 + k, " ".join(few)))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    ev = spark.createDataFrame(items, "item_id long, split string, text string")
    got = {(r.doc_id, r.item_id): r.item_words_leaked for r in eval_leaks.leaks(documents, ev).collect()}
    assert {k for k in got if k[0] < 1000} == {(k, k) for k in range(240)}
    assert all(25 <= n <= 60 for n in got.values())
    words = {d: t.split() for d, t in docs}
    for d, i in got:
        if d >= 1000:
            assert any(holds(words[d], items[i][2].split(), n, m) for n, m in ((25, 2), (30, 3), (40, 4)))


def test_leak_where_the_texts_before_end_alike():
    item = [f"w{i}" for i in range(25)]
    index = eval_leaks.Index([1, 2], [" ".join([f"x{i}" for i in range(29)] + ["end"]), " ".join(item)])
    got = eval_leaks.leaks_in(index, np.array([5, 6]), ["other end end", " ".join(item)])
    assert list(zip(got.doc_id, got.item_id)) == [(6, 2)]


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(eval_leaks, "ITEM_WORDS", 30)
    items = [(i, "test", " ".join(f"i{i}w{j}" for j in range(26))) for i in range(4)]
    ev = spark.createDataFrame(items, "item_id long, split string, text string")
    docs = spark.createDataFrame([(i, t) for i, _, t in items], "doc_id long, text string")
    assert sorted(map(tuple, eval_leaks.found(docs, ev).collect())) == [(i, i) for i in range(4)]


# --- 9 ---------------------------------------------------------------------------------------------------------


def test_mixture(spark):
    rnd = random.Random(9)
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    docs = [(i, rnd.choice("aaaabbc"), "word " * rnd.randrange(1, 60)) for i in range(3000)] + [(5000, None, "x"), (5001, "a", None), (5002, "a", ""), (5003, "zz", "x")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    t = spark.createDataFrame([(k, v, 3) for k, v in shares.items()] + [("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mixture(d, t).toPandas()
    assert m.doc_id.is_unique and m.copies.between(1, 3).all() and set(m.source) == set(shares)
    s = {r.source: r for r in mixing.shares(d, t).collect()}
    for k, v in shares.items():
        assert abs(s[k].reached_share - v) < 0.01 and s[k].most_copies <= 3
    assert s["none"].documents == 0
    big = {r.source: r for r in mixing.shares(d, t, total=1e9).collect()}
    assert all(big[k].most_copies == 3 for k in shares)
    half = mixing.mixture(d, t, total=2000.0).toPandas()
    assert abs((half.copies * half.n_tokens).sum() - 2000) < 200


def test_copies_brute_force():
    """floor(u + r i) - floor(u + r (i - 1)) sums to floor or ceil of r n and never exceeds ceil(r)."""
    for r in (0.3, 1.0, 2.7):
        c = [int(np.floor(0.41 + r * i) - np.floor(0.41 + r * (i - 1))) for i in range(1, 500)]
        assert max(c) <= np.ceil(r) and abs(sum(c) - r * 499) <= 1


# --- 10 --------------------------------------------------------------------------------------------------------


def garble(text, read, true, times=1):
    chars = mojibake._bytes_of(read)
    for _ in range(times):
        text = "".join(chars[b] for b in text.encode(true))
    return text


def test_garbled_round_trip(spark):
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").collect()]
    clean = [d for d in docs if "?" not in d[2] and not mojibake._strange(np.frombuffer(d[2].encode("utf-32-le"), np.uint32)).any()]
    arabic = [d for d in clean if sum("ا" <= x <= "ي" for x in d[2]) > 150][:40]
    cases = [("cp1252", "utf_8", 1), ("latin_1", "utf_8", 1), ("cp437", "utf_8", 1), ("cp1251", "utf_8", 1), ("mac_roman", "utf_8", 1), ("cp1256", "utf_8", 1), ("cp1252", "utf_8", 2), ("latin_1", "cp1256", 1), ("latin_1", "iso8859_6", 1)]
    rows, truth = [(d, s, t) for d, s, t in clean], {}
    for i, d in enumerate(arabic):
        read, true, times = cases[i % len(cases)]
        try:
            bad = garble(d[2].translate({0x60C: ",", 0x61B: ";", 0x61F: "?"} if true != "utf_8" else {}), read, true, times)
        except UnicodeEncodeError:
            continue
        truth[100_000 + i] = (d[2], true)
        rows.append((100_000 + i, d[1], bad))
    df = spark.createDataFrame(rows + [(200_000, "s", "��� ��"), (200_001, "s", "???? ??? ?? ???"), (200_002, "s", "Is that so??? Yes."), (200_003, None, None)], "doc_id long, source string, text string")
    got = {r.doc_id for r in mojibake.found(df).collect()}
    assert got == set(truth) | {200_000, 200_001}
    back = {r.doc_id: r for r in mojibake.restored(df).collect()}
    right = sum(back[i].text == t for i, (t, true) in truth.items() if true == "utf_8")
    assert right >= 0.95 * sum(true == "utf_8" for _, true in truth.values())
    assert not back[200_000].whole and not back[200_001].whole


def test_few_wrong_accents(spark):
    """One French sentence with one to seven wrong accents, also read as Cyrillic or Arabic; soft hyphens and Arabic prefixes are no cases."""
    docs = [(r.doc_id, r.source, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text <> ''").collect()]
    clean = [d for d in docs if "?" not in d[2] and not mojibake._strange(np.frombuffer(d[2].encode("utf-32-le"), np.uint32)).any()]
    swaps = [("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("iso8859_6", "cp1252"), ("cp1251", "mac_roman")]
    texts = ["Le débiteur doit payer la somme.", "La société a été jugée après délai.", "Le président a signé le contrat."]
    rows = [(10**6 + 10 * i + j, "s", garble(t, read, true)) for i, (read, true) in enumerate(swaps) for j, t in enumerate(texts)]
    odd = [(2 * 10**6, "s", "The seat\xad and the liquidat\xadeur."), (2 * 10**6 + 1, "s", "ملف والPDF في المادة"), (2 * 10**6 + 2, "s", "Señor Müller à Łódź.")]
    df = spark.createDataFrame(clean + rows + odd, "doc_id long, source string, text string")
    assert {r.doc_id for r in mojibake.found(df).collect()} == {r[0] for r in rows}


def test_unknown_swap_is_learned(spark):
    """Letters of one source replaced by others that no code page has: found, and most letters restored."""
    docs = [(r.doc_id, "u", r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'ar' and text <> ''").collect()]
    clean = [d for d in docs if sum("\u0621" <= x <= "\u064a" for x in d[2]) > 0.7 * len(d[2])]
    letters = sorted({x for d in clean for x in d[2] if "\u0621" <= x <= "\u064a"})
    rnd = random.Random(3)
    to = [chr(0x1200 + 7 * i) for i in range(len(letters))]
    rnd.shuffle(to)
    table = {ord(a): b for a, b in zip(letters, to)}
    bad = [(10**6 + d[0], "u", d[2].translate(table)) for d in clean[:60]]
    df = spark.createDataFrame(clean[60:] + bad, "doc_id long, source string, text string")
    assert {r.doc_id for r in mojibake.found(df).collect()} == {b[0] for b in bad}
    back = {r.doc_id: r for r in mojibake.restored(df).collect()}
    truth = {10**6 + d[0]: d[2] for d in clean}
    pairs = [(x, y) for i, r in back.items() for x, y in zip(truth[i], r.text) if "\u0621" <= x <= "\u064a"]
    assert {r.key for r in back.values()} == {"unknown"}
    assert sum(x == y for x, y in pairs) > 0.9 * len(pairs)


def _page(text, counts):
    return scan_noise.Page(text, [], set(), scan_noise.Lexicon(counts))


def test_words_in_pieces_and_run_together_are_read_over_the_stream():
    counts = {w: 1000 for w in "the court decided that case in favour of buyer law".split()}
    for text, want in (
        ("the cou\nrt decided", "the court decided"), ("that the court deci\nded the case", "that the court decided the case"),
        ("in courtdecidedthat case", "in court decided that case"), ("the c o u r t decided", "the court decided"), ("the c o\nu r t decided", "the court decided"),
        ("the buyer decided", "the buyer decided"), ("of the\ncourt", "of the court"),
    ):
        p = _page(text, counts)
        assert " ".join(t for line in p.read() for t in line) == want and not p.kinds, text


def test_rare_words_stay_and_are_joined_where_they_are_many(spark, monkeypatch):
    """A word with few occurrences that resembles a frequent one stays, unless the other is RATIO times as frequent."""
    rows = [(i, "a", "the court decided that the buyer may keep the land " * 3) for i in range(200)] + [(200 + i, "a", "the clerk and the cleric met in " + ("kourt" if i % 2 else "court")) for i in range(8)]
    chunks = spark.createDataFrame([(k, s, t, "d", 1) for k, s, t in rows], "chunk_key long, source string, page_content string, document string, chunk_id long")
    qa = spark.createDataFrame([], "row_id long, source string, context string")
    sources = spark.createDataFrame([("a", "scan", "Quite Another Title")], "source string, kind string, title string")
    monkeypatch.setattr(scan_noise, "SHARE", 0.01)
    got = []
    for most in (500_000, 0):
        monkeypatch.setattr(scan_noise, "RARE", most)
        got.append({r.row_key: r.text for r in scan_noise.repaired(chunks, qa, sources).collect()})
    assert got[0] == got[1]
    assert "the clerk and the cleric met in court" in got[0][201] and "the clerk and the cleric met in court" in got[0][200]


class _Asked(frozenset):
    """Rare words that write down what is looked up."""

    def __contains__(self, word):
        self.seen.add(word)
        return super().__contains__(word)


@given(st.lists(st.lists(st.sampled_from("cle cle- rk, metric metric- Kou-rt rt¬ court- 7 - ¬ the. x\u00ad ab_ (met".split(" ")), max_size=4).map(" ".join), max_size=9).map("\n".join), st.sets(st.sampled_from(["clerk", "cle-metric", "courtrt", "metriccle", "cle", "rt¬", "met"])))
@settings(max_examples=400, deadline=None)
def test_asked_are_all_words_that_a_page_looks_up(text, rare):
    lex = scan_noise.Lexicon({w: 1000 for w in "the court met".split()})
    lex.rare = _Asked(rare)
    lex.rare.seen = set()
    got = scan_noise.Page(text, [], set(), lex)
    read = got.read()
    own = scan_noise.asked(text)
    assert lex.rare.seen - {""} <= own
    lex.rare = frozenset(rare & own)  # the lexicon's memory of other texts changes nothing
    again = scan_noise.Page(text, [], set(), lex)
    assert again.read() == read and again.kinds == got.kinds


def test_rare_words_broken_over_lines_are_joined_where_they_are_many(spark, monkeypatch):
    """A rare word in two halves, with one mark or another, another line in between or a hyphen of its own; no text has it whole."""
    rows = [(i, "a", "the court decided that the buyer may keep the land " * 3) for i in range(200)] + [(200 + i, "p", "replevin usufructuary quasi-delict") for i in range(4)]
    broken = ["the court may keep reple-\nvin", "the court may keep usufruc¬\n\nthe buyer\ntuary land", "the land quasi-\ndelict", "the repl-\nevin usu-\nfructuary land", "the buyer may zzyq-\nvin"]
    rows += [(300 + i, "a", t) for i, t in enumerate(broken)]
    chunks = spark.createDataFrame(rows, "chunk_key long, source string, page_content string")
    qa = spark.createDataFrame([], "row_id long, source string, context string")
    sources = spark.createDataFrame([("a", "scan", "Quite Another Title"), ("p", "portal", "X")], "source string, kind string, title string")
    monkeypatch.setattr(scan_noise, "SHARE", 0.01)
    got = []
    for most in (500_000, 0):
        monkeypatch.setattr(scan_noise, "RARE", most)
        got.append(({(r.row_key, r.noise) for r in scan_noise.found(chunks, qa, sources).collect()}, {r.row_key: r.text for r in scan_noise.repaired(chunks, qa, sources).collect()}))
    assert got[0] == got[1]
    assert got[1][0] == {(300, "hyphen"), (301, "hyphen"), (303, "hyphen")} and got[1][1][300] == "the court may keep replevin"


def test_look_alikes_of_more_scripts():
    assert lookalikes.canonical("ꓮ ꓐꓳ ⲟ ꮃ ꮩ ᴠ ᴏ ᴡ ᴢ ɑ ѡ ʋ") == "A BO o w v v o w z a w u"
    assert lookalikes.canonical("− ‐ ⁃ ‚ ∕ ׃ ǃ ꞌ") == "- - - , / : ! '"
    assert lookalikes.canonical("ⲡⲣⲱⲙⲉ ꓡꓲ-ꓢꓴ") == "ⲡⲣⲱⲙⲉ LI-SU"  # Coptic words with letters of their own stay


@pytest.mark.parametrize("n", [12, 30, 41, 112])
def test_a_cell_gives_every_query_all_it_can_and_never_itself(n):
    rng = np.random.default_rng(n)
    x = vector_neighbors.unit(pd.Series(list(rng.standard_normal((n, 64)) + 2 * rng.standard_normal(64))))
    c, rot = x.mean(0, keepdims=True), vector_neighbors.rotation(64)
    cell = vector_neighbors.Cell(x, np.arange(n), *vector_neighbors.coded(x, c, np.zeros(n, int), rot), c[0], rot)
    for i, (_, ids) in enumerate(cell.search(x, np.arange(n), np.full(n, -np.inf), 10)):
        assert len(set(ids.tolist())) == 10 and i not in ids
