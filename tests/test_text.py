import math

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.stopwords import ENGLISH_STOP_WORDS


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()["x"]


def test_tokens_split_like_python_on_every_white_space(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    line = "".join(f"Word{i}{space}{space}" for i, space in enumerate(spaces)) + "e.nd,"
    assert one(spark, line, T.tokens(F.col("text"))) == line.lower().split()
    assert sorted(T.SPACES) == sorted(spaces)


def test_tokens_of_missing_or_blank_text(spark):
    assert one(spark, None, T.tokens(F.col("text"))) == []
    assert one(spark, " \n\t ", T.tokens(F.col("text"))) == []


def test_compress_and_sigmoid(spark):
    row = spark.range(1).select(
        T.compress_score(F.lit(3.0)).alias("a"), T.compress_score(F.lit(-3.0)).alias("b"),
        T.compress_score(F.lit(0.0)).alias("c"), T.sigmoid(F.lit(-1e9)).alias("d"),
        T.sigmoid(F.lit(0.0)).alias("e"), T.guarded_ratio(F.lit(3), F.lit(0)).alias("f"),
    ).first()
    assert math.isclose(row.a, math.log(4)) and math.isclose(row.b, -math.log(4))
    assert row.c == 0.0 and row.d > 0.0 and row.e == 0.5 and row.f == 3.0


def test_grams_drop_stop_words_before_pairing(spark):
    words = T.content_words(F.col("text"))
    assert one(spark, "The quick, x fox of Café_9 fox", T.unigrams_and_bigrams(words)) == [
        "quick", "fox", "café_9", "fox", "quick fox", "fox café_9", "café_9 fox",
    ]
    assert one(spark, "fox", T.unigrams_and_bigrams(words)) == ["fox"]
    assert one(spark, "", T.unigrams_and_bigrams(words)) == []


def test_stop_list_is_sparks_default(spark):
    assert ENGLISH_STOP_WORDS == StopWordsRemover.loadDefaultStopWords("english")


def test_shingles(spark):
    got = one(spark, "a b c d", T.shingles(T.tokens(F.col("text")), 3))
    assert got == ["a b c", "b c d"]
    assert one(spark, "a b", T.shingles(T.tokens(F.col("text")), 3)) == []


def test_preview(spark):
    text = "\n  first\nline " + "x" * 50
    assert one(spark, text, T.preview(F.col("text"), 12)) == "first line x"
    assert one(spark, text, T.preview(F.col("text"), 4, strip=False)) == "   f"
