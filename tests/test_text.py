import re

import pytest

from daftar.functions import text as T


def one(spark, expr, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(expr).first()[0]


@pytest.mark.parametrize(
    "text, dropped, kept",
    [
        ("Page number: 12 قانون - ٣ - العقوبات", "قانون العقوبات", "قانون العقوبات"),
        ("المادة 12 و١٢ ، ٤٥ نص؟", "المادة و١٢ ، نص؟", "المادة 12 و١٢ ، ٤٥ نص؟"),
        ("ﻻ presentation نص", "نص", "نص"),
        ("Page number: ٧ ا", "ا", "ا"),
        ("قال (article) 5-3: نعم", "قال نعم", "قال 53 نعم"),
        ("", "", ""),
        (None, None, None),
    ],
)
def test_cleaning(spark, text, dropped, kept):
    assert one(spark, T.clean_arabic("t", keep_digits=False), t=text) == dropped
    assert one(spark, T.clean_arabic("t"), t=text) == kept


def test_cleaning_equals_python_on_random_texts(spark):
    import random

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("اب٣5x -\n  ،Page number: 1") for _ in range(rnd.randrange(30))) for _ in range(400)]

    def plain(t):
        t = re.sub(r"- \d+ -", "", re.sub(r"Page number: \d+", "", t))
        return re.sub(r"\s+", " ", re.sub(r"[^؀-ۿ0-9\s]", "", t)).strip()

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.clean_arabic("t")).collect()]
    assert got == [plain(t) for t in texts]


def test_source_label(spark):
    for path, label in (("/a/b/x_y_z.txt", "x y z"), ("x.txt.txt", "x.txt"), ("a_b.csv", "a b.csv"), (None, None)):
        assert one(spark, T.source_label("s"), s=path) == label


def test_first_answer(spark):
    for j, a in (('{"text":["x","y"],"answer_start":[3]}', "x"), (None, None), ("broken", None), ('{"text":[]}', None), ('{"text":[null]}', None), ('{"text":["null"]}', "null")):
        assert one(spark, T.first_answer("j"), j=j) == a
    df = spark.sql("select named_struct('text', array('p', 'q')) as a")
    assert df.select(T.first_answer("a", is_json=False)).first()[0] == "p"


def test_answer_format_and_displays(spark):
    assert one(spark, T.format_answer("t"), t="أ: ب\nج") == "أ:\n\n ب\n\nج"
    df = spark.sql("select array('d1', 'd2') as d, array('m1', 'm2') as m")
    assert df.select(T.numbered_documents("d", "m")).first()[0] == "**Document 1:**\nd1\n**Metadata:** m1\n**Document 2:**\nd2\n**Metadata:** m2"
    assert df.select(T.numbered("Document", "d")).first()[0] == "Document 1:\nd1\n\nDocument 2:\nd2"


def test_fill_does_not_read_values_again(spark):
    assert one(spark, T.fill("{a}-{b}-{c}", a="x", b="y"), x="{b}", y="2") == "{b}-2-{c}"


def test_errors(spark):
    for m, c in (("Rate Limit hit", "rate_limit"), ("code 429", "rate_limit"), ("503", "unavailable"), ("Service Unavailable", "unavailable"), ("x", "unknown"), (None, None)):
        assert one(spark, T.error_class("m"), m=m) == c


def test_lines(spark):
    assert one(spark, T.strip_join_lines("t"), t=" a \n\n b\n") == "a  b "
    assert one(spark, T.merged("q", "a", "c"), q="1", a=None, c="3") == "السؤال: 1\nالإجابة: None\nالسياق: 3"
    assert one(spark, T.is_question_line("t"), t="س 12) ما") and not one(spark, T.is_question_line("t"), t="x س 1)")
