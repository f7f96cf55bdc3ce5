import re
import random

import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T


def paragraphs(t):
    t = t.replace("\ufeff", "").replace("\xa0", " ").replace("\t", " ")
    while "  " in t:
        t = t.replace("  ", " ")
    while "\n \n" in t:
        t = t.replace("\n \n", "\n")
    while "\n\n" in t:
        t = t.replace("\n\n", "\n")
    t = t[1:] if t.startswith("\n") else t
    t = t[:-1] if t.endswith("\n") else t
    return t.split("\n")


def column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", expr(F.col("t")).alias("x")).orderBy("i").collect()]


def test_paragraphs_of_random_strings(spark):
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab \n\t\xa0\ufeff.") for _ in range(draw.randint(0, 25))) for _ in range(3000)] + ["", "\ufeff", "\n\n"]
    assert column(spark, texts, T.paragraphs) == [paragraphs(t) for t in texts]


def test_words_are_split_at_unicode_space(spark):
    texts = ["a b\u2003c\xa0d\n e ", "", "   "]
    assert column(spark, texts, T.words) == [t.split() for t in texts]


def test_clean_spaces_and_subtitles(spark):
    texts = ["a \t\xa0 b , c .", "x\nSubtitles by me\ny\n", "no SUBTITLE end", "a\r\nsubtitle\r\nb"]
    assert column(spark, texts, T.clean_spaces) == [re.sub("[ \t\xa0]([.,;!?])", r"\1", re.sub("[ \t\xa0]+", " ", t)) for t in texts]
    assert column(spark, texts, T.drop_subtitle_lines) == [re.compile(r"^.*subtitle.*$\n", re.M | re.I).sub("", t) for t in texts]


def rounds(text, n, version):
    if version == 1:
        turns = [t.strip() for t in re.findall(r"((?:A::|B::)[^AB]*?)(?=(?:A::|B::)|$)", text, re.S)]
        return "\n".join([t for t in turns if t][: 2 * n])
    turns = re.findall(r"(A::|B::)(.*?)(?=(?:A::|B::)|$)", text, re.S)
    return " ".join(a + b.strip() for a, b in turns[: 2 * n])


@pytest.mark.parametrize("version", [1, 2])
def test_first_rounds(spark, version):
    texts = ["A:: hi there \nB:: yes\nA:: And you?\nB:: Bye", "B:: x", "none", "", "A:: one\nB:: All is lost\nA:: two\n"]
    for n in (1, 2):
        assert column(spark, texts, lambda t, n=n: T.first_rounds(t, n, version)) == [rounds(t, n, version) for t in texts]


def test_response_content_order(spark):
    texts = ["p: a [/INST] b", "x<|start_header_id|>assistant<|end_header_id|>\n\n c<|eot_id|>", "p: rest", "else"]
    assert [x.strip() for x in column(spark, texts, lambda t: T.response_content(t, F.lit("p:")))] == ["b", "c", "rest", "else"]


def test_division_by_zero_is_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r.x for r in df.select(T.safe_div(F.col("a"), F.col("b")).alias("x")).collect()] == [0.0, 0.5, None]


def test_vocabulary_entries(spark):
    assert column(spark, ["dog/doggy* ", "a/ a!/b?"], T.cdi_words) == [["dog", "doggy"], ["a", "b"]]


def test_markers_initials_and_counts(spark):
    assert column(spark, ["A:: x B:: y", "CA:: z"], T.strip_markers) == [" x  y", "CA:: z"]
    assert column(spark, [" B: x", "  ", ""], T.speaker_initial) == ["B", "Unknown", "Unknown"]
    assert column(spark, ["don't go, now!"], T.token_count) == [7]
