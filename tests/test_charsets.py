import pytest
from pyspark.sql import functions as F

from siltgate.functions import chars, encoding

SAMPLES = {
    "EUC-KR": ("euc_kr", ["이 파일은 한국어로 작성된 설명을 담고 있습니다. 프로그램을 실행하기 전에 설정을 확인해야 합니다.", "데이터를 읽어 오는 동안 오류가 발생하면 다시 시도하십시오. 자세한 내용은 문서를 참고하시기 바랍니다."]),
    "EUC-JP": ("euc_jp", ["このファイルには日本語で書かれた説明が入っています。実行する前に設定を確認してください。", "データの読み込み中にエラーが発生した場合は、もう一度やり直してください。"]),
    "Shift_JIS": ("shift_jis", ["このファイルには日本語で書かれた説明が入っています。実行する前に設定を確認してください。", "データの読み込み中にエラーが発生した場合は、もう一度やり直してください。カタカナのテストです。"]),
    "GB18030": ("gb18030", ["这个文件里有用中文写的说明，在运行程序之前应该检查一下设置。", "如果读取数据的时候发生了错误，请再试一次，详细的内容可以参考我们的文档。"]),
    "Big5": ("big5", ["這個檔案裡有用中文寫的說明，在執行程式之前應該檢查一下設定。", "如果讀取資料的時候發生了錯誤，請再試一次，詳細的內容可以參考我們的文件。"]),
    "ISO-8859-1": ("latin-1", ["Le fichier a été créé après une mise à jour, il sera relu à la prochaine exécution.", "Die Prüfung der Größe schlägt fehl, wenn für das Verzeichnis keine Rechte bestehen.", "El número de página no está en el índice, así que la función devolverá un error."]),
}


@pytest.mark.parametrize("ascii_part", ["", "plain ASCII text, version 1.2\n"])
def test_guesses(spark, ascii_part):
    rows = [(name, bytearray((ascii_part + text).encode(codec))) for name, (codec, texts) in SAMPLES.items() for text in [*texts, " ".join(texts), texts[0] * 200]]
    out = spark.createDataFrame(rows, "want string, content binary").select("want", encoding.guessed_charset(F.col("content")).alias("got"), encoding.utf8_report(F.col("content")).alias("r")).collect()
    assert [(r.want, r.got) for r in out if r.want != r.got] == []
    assert all(r.r.detected_charset == r.want and not r.r.valid and r.r.confidence == 0 for r in out)


def test_edges_of_guesses(spark):
    # letters beyond ASCII in pairs are no Japanese
    doubled = spark.createDataFrame([(bytearray("le réêai, la créée, en èèch".encode("latin-1")),)], "content binary").select(encoding.guessed_charset(F.col("content"))).first()[0]
    assert doubled == "ISO-8859-1"
    rows = [(b"\xff",), (b"abc\xe9",), (b"\xe9",), (b"",), ("é".encode(),), (None,), (b"\xef\xbb\xbfabc",)]
    out = spark.createDataFrame([(None if b is None else bytearray(b),) for (b,) in rows], "content binary").select(encoding.utf8_report(F.col("content")).alias("r")).collect()
    assert [r.r.detected_charset for r in out][:5] == ["ISO-8859-1", "ISO-8859-1", "ISO-8859-1", "utf-8", "utf-8"] and out[6].r.has_bom


def test_letters_together_in_words_are_latin(spark):
    latin = ["Çèen e", "Ößen e", "le èêou l De. Ééon.", "er. Öäver ", "le, Ééêle, le, Ééêle", "ÊÇVI", "DÉÉ ÄÄ", "éé", "Ääö ßü"]
    rows = [("ISO-8859-1", bytearray(t.encode("latin-1"))) for t in latin]
    # other charsets beside ASCII words
    rows += [(n, bytearray(t.encode(n))) for n, t in (("EUC-KR", "API의 설명을 담은 URL을 확인"), ("GB18030", "这是API文档, 用pip安装"), ("EUC-JP", "APIの説明とURLを確認"))]
    out = spark.createDataFrame(rows, "want string, content binary").select("want", encoding.guessed_charset(F.col("content")).alias("got"), F.decode("content", "ISO-8859-1").alias("t")).collect()
    assert [tuple(r) for r in out if r.want != r.got] == []


def test_confusables_file(spark):
    lines = ["﻿# confusables.txt", "05AD ;\t0596 ;\tMA\t# not ASCII", "A4F2 ;\t0049 ;\tMA\t# ( ꓲ → I )", "118B2 ;\t0069 ;\tMA", "1D400 ;  0041 ; MA # x", "0021 ; 01C3 ; MA", "2163 ; 0049 0056 ; MA # two", "", "bad line ; x"]
    extra = chars.read_confusables(lines)
    assert extra == {0xA4F2: "I", 0x118B2: "i", 0x1D400: "A"}
    df = spark.createDataFrame([("xꓲy",), ("plain",)], "t string")
    got = df.select(chars.lookalike_of(F.lit("ꓲ"), extra=extra).alias("c"), chars.without_lookalikes(F.col("t"), extra=extra).alias("f")).collect()
    assert [(r.c, r.f) for r in got] == [("I", "xIy"), ("I", "plain")]
