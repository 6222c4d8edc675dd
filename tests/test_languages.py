"""Scripts, limits and negation by language, on literal lines."""

import pytest
from pyspark.sql import functions as F

from cuewright.functions import languages as lang

NEGATION = [
    ("I do not know", "Ich weiß nicht", "en", "de", False),
    ("I do not know", "Ich weiß", "en", "de", True),
    ("I don't know", "Je sais", "en-US", "fr", True),
    ("I don't know", "I don't", "en", "en", False),
    ("Bilmiyorum", "I know", "tr", "en", True),
    ("Gelmedi", "He came", "tr-TR", "en", True),
    ("Tamam, hemen", "Okay, at once", "tr", "en", False),
    ("Bu doğru değil", "That is not right", "tr", "en", False),
    ("No one", "我知道", "en", "zh", True),
    ("No one", "我不知道", "en", "zh", False),
    ("Non lo so", "I know", "it", "en", True),
    ("not at all", "qualcosa", "en", "it", False),
    ("nothing", "", "en", "ar", True),
    ("notable", "Bekannt", "en", "de", False),
    ("не знаю", "I know", "ru", "en", True),
]


def test_lost_negation(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(NEGATION)], "i int, s string, t string, sl string, tl string, want boolean")
    got = df.select("i", lang.lost_negation(F.col("s"), F.col("t"), F.col("sl"), F.col("tl")).alias("lost")).orderBy("i").collect()
    assert [r["lost"] for r in got] == [x[-1] for x in NEGATION]


@pytest.mark.parametrize("text,code,share", [
    ("привет мир", "ru", 1.0), ("привет abc", "uk-UA", 6 / 9), ("hello", "ar", 0.0), ("مرحبا", "fa", 1.0), ("שלום ok", "he", 4 / 6), ("", "el", 1.0), ("12 !", "ja", 1.0),
    ("日本のカメラ", "ja", 1.0), ("日本のカメラ", "zh", 2 / 6), ("안녕", "ko", 1.0), ("नमस", "hi", 1.0), ("hello", "de", None), ("hello", "xx", None), ("ไทย", "th", 1.0),
])
def test_share_of_a_script(spark, text, code, share):
    got = spark.createDataFrame([(text, code)], "t string, c string").select(lang.script_share(F.col("t"), F.col("c")), lang.wrong_script(F.col("t"), F.col("c"))).first()
    assert got[0] == (None if share is None else pytest.approx(share)) and got[1] == (share is not None and share < 0.6)


def test_limits(spark):
    df = spark.createDataFrame([("ja-JP",), ("de",), (None,)], "c string").select(lang.limits(F.col("c")).alias("x"))
    assert [tuple(r["x"]) for r in df.collect()] == [(17, 16, 0.2, 1.5), (17, 42, 0.4, 2.5), (17, 42, 0.4, 2.5)]


def test_every_language_has_one_script():
    codes = [c for cs in lang.SCRIPTS.values() for c in cs]
    assert len(codes) == len(set(codes)) == 43


def test_letters_are_not_made_strings_one_by_one(spark):
    rows = [("ab" * 3 + "привет\U00010400 " * 2, "ru"), (None, "ru"), ("א1-b", "he-IL"), ("x", None)]
    df = spark.createDataFrame(rows, "t string, c string").select(lang.script_share(F.col("t"), F.col("c")).alias("share"), lang.wrong_script(F.col("t"), F.col("c")).alias("wrong"))
    assert [tuple(r) for r in df.collect()] == [(pytest.approx(12 / 20), False), (None, False), (0.5, True), (None, False)]
    assert not any(x in df._jdf.queryExecution().optimizedPlan().toString() for x in ("regexp_count", "regexp_extract_all"))
