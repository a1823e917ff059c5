import re

from siltgate.operators import catalogue, report


def test_every_code_has_a_text_in_each_language():
    for code, texts in catalogue.TEXTS.items():
        names = [sorted(re.findall(r"%\{(\w+)\}", t)) for t in texts]
        assert len(texts) == len(catalogue.LOCALES) and all(texts) and all(n == names[0] for n in names), code


def test_fallbacks_and_placeholders(spark):
    texts = spark.createDataFrame(
        [("en", "a", "one %{x} and %{y}"), ("zh-Hant", "a", "繁 %{x}"), ("zh", "a", "简 %{x}"), ("en", "b", "only english"), ("ko", "a", "하나 %{x}"), ("ko", "b", None), ("en", "c", "50% %{ %{}")], "locale string, code string, text string"
    )
    cases = [
        ("zh_Hant-TW", "a", {"x": "1"}, "繁 1"),
        ("zh-CN", "a", {"x": "1"}, "简 1"),
        ("ko_KR.UTF-8", "a", {"x": "%{y}", "y": "2"}, "하나 %{y}"),
        ("ko", "b", {}, "only english"),
        ("fr", "a", {"x": "%{y}", "y": "2"}, "one %{y} and 2"),
        (None, "a", {"y": "2"}, "one %{x} and 2"),
        ("", "nothing", {}, "[nothing]"),
        ("en", "c", {"": "z"}, "50% %{ %{}"),
        ("en", "a", None, "one %{x} and %{y}"),
    ]
    df = spark.createDataFrame([(i, loc, code, p, "own") for i, (loc, code, p, _) in enumerate(cases)], "i int, locale string, code string, params map<string,string>, text string")
    from pyspark.sql import functions as F

    got = {r.i: r.text for r in catalogue.translated(df, F.col("locale"), texts).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)} | {7: got[7]} and got[7] in ("50% %{ %{}", "50% %{ z")
    default = {r.i: r.text for r in catalogue.translated(df.selectExpr("i", "'emoji' as code", "map('char', 'U+1F600') as params"), "ja").collect()}
    assert set(default.values()) == {"絵文字 U+1F600"}
    assert report.TEMPLATES["emoji"] == "emoji %{char}"
