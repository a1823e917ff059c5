import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltgate.llm import eliasfano, tokenfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=900))
def test_elias_fano(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    data = eliasfano.encode(values)
    r = eliasfano.Reader(b"xyz" + data, 3)
    assert r.all().tolist() == values.tolist() and r.end == 3 + len(data)
    for i in range(0, len(values), 7):
        assert r.select(i) == values[i]
    with pytest.raises(IndexError):
        r.select(len(values))
    if len(values) > 100:
        top = int(values[-1])
        assert len(data) <= 64 + len(values) * (3 + max(0, np.log2(max(1, top / len(values))))) / 8 + len(values) / eliasfano.EVERY * 4


TEXTS = ["", " ", "a", " a", "a  b", "a   b ", "x\n y", "x \n  y\t z ", "It's  don't 'll", "é\U0001f600 ñ  中文 text", "  lead", "trail  ", "<|endoftext|> x", "x <|endoftext|> y", "a<|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|> b", "\n\n", "a b c d e f", "1234 5,678.90"]


def test_chunks_give_the_ids_of_whole_texts():
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice([" ", "  ", "\n", "\t", "a", "the", "'s", "é", "9", ".", " \n "]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    c = tokenfile.Coder(PATH)
    for _ in range(2):
        ids, n = c.encode(texts)
        at = 0
        for t, k in zip(texts, n.tolist()):
            assert ids[at : at + k].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)
            at += k


def test_files_and_documents(spark, monkeypatch):
    tok = Tokenizer.from_file(PATH)
    rows = [(i * 3 % 47, f"document {i} " * (i % 9)) for i in range(47)] + [(50, None), (51, ""), (60, "long text " * 60_000), (61, "same"), (61, "same"), (62, "x <|endoftext|> y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as start", "1 as part").repartition(3)
    out = tokenfile.token_table(df, PATH).orderBy("start").collect()
    at = 0
    for (i, t), r in zip(sorted(rows, key=lambda x: x[0]), out, strict=True):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenfile.token_table(df.limit(0), PATH).collect() == []
    lone = tokenfile.token_table(spark.createDataFrame([(3, "b"), (None, "a b")], "doc_id long, text string"), PATH).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in lone] == [(None, 0), (3, 3)]


def test_file_selects_documents():
    ids, ends = np.arange(20, dtype=np.uint32), np.array([3, 3, 11, 20])
    f = tokenfile.TokenFile(tokenfile.pack(np.array([5, 6, 7, 9]), np.ones(4, bool), ends, ids, 2))
    assert [f.document(i).tolist() for i in range(4)] == [[0, 1, 2], [], list(range(3, 11)), list(range(11, 20))]
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"\0" * 80)
