"""Scalar functions on hand-made texts with hand-computed results."""

import pytest
from pyspark.sql import functions as F

from scriptloom.functions import clock as K
from scriptloom.functions import costs
from scriptloom.functions import helpers as H
from scriptloom.functions import text as T


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    return [r.v for r in df.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert values(spark, ["(1:02) كتاب، يہ_ہے!", "تعالیٰ  أب", ""], T.normalize) == ["کتاب یہ ہے", "تعالی اب", ""]


def test_tokens_keep_marks(spark):
    assert values(spark, ["یہ، ہے۔ \"تعالیٰ\"", " . "], T.tokens) == [["یہ", "ہے", "تعالیٰ"], []]


def test_corrections_are_whole_words_in_order(spark):
    rules = [("سبر", "صبر"), ("a.b", "$1\\x"), ("صبر", "X")]
    assert values(spark, ["سبر اور سبرا", "a.b axb", "تعالیٰسبر  سبر "], lambda c: T.apply_corrections(c, rules)) == ["X اور سبرا", "$1\\x axb", "تعالیٰسبر X"]


def test_many_rules_agree(spark):
    rules = [("سبر", "صبر"), ("a.b", "$1\\x"), ("صبر", "X")]
    texts = ["سبر اور سبرا", "a.b axb", "تعالیٰسبر  سبر ", None]
    assert values(spark, texts, H.apply_many_rules(rules)) == values(spark, texts, lambda c: T.apply_corrections(c, rules))


@pytest.mark.parametrize(
    ("text", "want"),
    [("ری ل ی ٹ ڈ", "ریلیٹڈ"), ("کتاب ا ب", "کتاب اب"), ("یہ، ا ب", "یہ، اب"), ("و آ ا", "و آ ا"), ("5 6 a", "5 6 a"), ("a b", "ab"), ("", ""), ("abc d e fg h i", "abcde fghi")],
)
def test_join_broken_words(spark, text, want):
    assert values(spark, [text], T.join_broken_words) == [want]


def test_scripts(spark):
    df = spark.createDataFrame([("हिन्दी",), ("كتاب",), ("abc",), ("Please SUBSCRIBE",), ("ہے۔",), ("ہے۔»",)], "c string")
    c = F.col("c")
    got = df.select(T.has_devanagari(c), T.has_arabic_only(c), T.has_latin(c), T.is_invented(c), T.ends_sentence(c)).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False, False), (False, True, False, False, False), (False, False, True, False, False), (False, False, True, True, False), (False, False, False, False, True), (False, False, False, False, True)]


def test_repeated_phrase(spark):
    assert values(spark, ["a b b b c", "a b a b a b", "a a", "x a b c d a b c d a b c d", ""], T.repeated_phrase) == ["b", "a b", None, "a b c d", None]


def test_names(spark):
    assert values(spark, ["My talk: (1)", "___", "درس-1"], T.safe_name) == ["My_talk_1", "clip", "درس-1"]
    assert values(spark, [7, 12345], lambda c: T.clip_file(F.lit("n"), c), "int") == ["n_0007.wav", "n_12345.wav"]


def test_clock(spark):
    assert values(spark, ["1:02:03.5", "31:14,2", "95", "1:2:3:4", "x", "١:٠٢"], K.parse_time) == [3723.5, 1874.2, 95.0, None, None, 62.0]
    assert values(spark, ["1:00:00:00", "0:30"], K.clock_seconds) == [216000.0, 30.0]
    assert values(spark, ["00:57", " 01:03:27 ", "5:3", "text"], K.heading_seconds) == [57.0, 3807.0, None, None]
    assert values(spark, ["00:00:02,46 --> 00:00:05,160 [Speaker 0]", "00:57"], K.cue_seconds) == [2.46, None]
    assert values(spark, [59.9, 3600.0, 7325.0], K.stamp, "double") == ["00:59", "1:00:00", "2:02:05"]
    assert values(spark, [1874.25, 59.96, 3599.99], K.clock, "double") == ["00:31:14.2", "00:01:00.0", "01:00:00.0"]
    assert values(spark, [1.5], K.srt_clock, "double") == ["00:00:01,500"]


def test_costs(spark):
    lengths = [0.5, 1.0, 1.9, 2.0, 4.0, 5.0, 10.0, 12.0, 15.0, 16.0]
    assert values(spark, lengths, costs.clip_cost, "double") == pytest.approx([60, 35, 26, 2.4, 0.8, 0, 0, 1.2, 3, 110])
    assert values(spark, [0.0, 0.05, 0.15, 0.3], lambda p: costs.cut_cost(p, F.lit(True)), "double") == [25, 6, 2, 0]
    assert values(spark, [0.0, 0.05, 0.15, 0.3], lambda p: costs.cut_cost(p, F.lit(False)), "double") == [25, 8, 3, 1]
