import random
import re
import string
import sys

from pyspark.sql import functions as F

from gradeline.functions import text as T


def one(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r.out for r in rows.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def squad(text):
    bare = "".join(c for c in text.lower() if c not in string.punctuation)
    return " ".join(re.sub(r"\b(a|an|the)\b", " ", bare).split())


NORMALIZED = {
    "The Red!": "red", "a-b": "ab", "a": "", "<NO_VALUE>": "novalue", "12.5 oz.": "125 oz",
    "An  apple\tthe pie": "apple pie", "th.e red": "red", "Théa the ÉCRU": "théa écru",
    "rock'n'roll": "rocknroll", "": "", "\x1cthe\x1fcat  sat　": "cat sat",
}


def test_normalize_edges(spark):
    assert one(spark, NORMALIZED, T.normalize_answer) == list(NORMALIZED.values())


def test_normalize_like_python(spark):
    rng = random.Random(5)
    alphabet = "\u0301\u0903\u00b2\u0e01\u4e00aAnNtThHeE étß  \t\n.,'-_!  \x1e0"
    samples = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24))) for _ in range(400)]
    assert one(spark, samples, T.normalize_answer) == [squad(s) for s in samples]


def test_whitespace_is_pythons():
    spaces = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}
    assert set(T.WHITESPACE) == spaces


def test_strip(spark):
    values = [f"{w} x {w}y{w}" for w in T.WHITESPACE] + ["", " ", "x", None]
    assert one(spark, values, T.strip) == [v.strip() if v is not None else None for v in values]


def test_line_break_is_splitlines():
    text = "".join(f"{i}{c}" for i, c in enumerate("\n\r\x0b\x0c\x1c\x1d\x1e\x85  ")) + "a\r\nb\tc\x1fd"
    assert re.split(T.LINE_BREAK, text) == text.splitlines()


def test_one_line(spark):
    values = ["plain", 'q"uote', "two\nlines", 'a\r"b"\\', "é\n"]
    assert one(spark, values, T.one_line) == ["plain", 'q"uote', '"two\\nlines"', '"a\\r\\"b\\"\\\\"', '"é\\n"']


def test_count_words(spark):
    assert one(spark, ["", " ", "a", " a  b\nc "], T.count_words) == [0, 0, 1, 3]
