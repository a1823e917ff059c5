from pyspark.sql import functions as F
"""The pipeline against plain Python versions of its stages."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltgate.llm import mixing, packing, toxicity

from .test_minhash import brute
from .test_pii import KINDS, brute_terms, luhn

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NEEDLE = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def corpus():
    rng = random.Random(11)
    syl = "ka le mi na pu ra se ti vo zu".split()
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(420):
        words = [word() for _ in range(rng.choice([4, 30, 90]))]
        if i % 7 == 3:
            words[rng.randrange(len(words))] = "idiot"
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice([f"u{i}@x.org", "10.0.0.1", "+1 (212) 555-0100", "4111 1111 1111 1111", "999.1.1.1"])
        text = " ".join(words)
        if rows and i % 6 == 0:
            text = rng.choice(rows)[1]
        rows.append((i, text, rng.choice(["en", "de"]), rng.choice(["a", "a", "b"]), len(text)))
        labels.append((i, 1, int("idiot" in text)))
    return rows + [(9000, None, None, "a", None), (9001, "", "en", None, 0)], labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def redact(text, terms=()):
    spans = []
    for k, p in KINDS:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d or "1"), "phone": 8 <= len(d) <= 15}[k]:
                spans.append((m.start(), -m.end(), k))
    base = list(spans)
    for m in re.finditer(r"[^\W\d_]{3,}", text):
        if m[0].lower() in terms and not any(s < m.end() and m.start() < -e for s, e, _ in base):
            spans.append((m.start(), -m.end(), "term"))
    out, at = "", 0
    for s, e, k in sorted(spans):
        if s >= at:
            out += text[at:s] + NEEDLE.get(k, "")
        at = max(at, -e)
    return out + text[at:]


def test_run_against_plain_python(spark, folder):
    rows, _ = corpus()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    words, begin = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    s = toxicity.Scorer(words, begin)
    kept = [r for r in rows if s.score(r[1] or "") < 0.7]
    assert {r[0] for r in rows} - {r[0] for r in kept} == {r[0] for r in rows if r[1] and "idiot" in r[1]}
    group = brute([(r[0], r[1]) for r in kept], 5, 80)
    kept = [r for r in kept if group[r[0]] == r[0]]
    terms = brute_terms([r[1] for r in kept])
    assert terms
    kept = [(r[0], None if r[1] is None else redact(r[1], terms), *r[2:4]) for r in kept]
    n = lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
    topic = lambda t: "table" if (t or "").count("|") >= 8 else "snippet" if n(t) < 50 else "prose"
    cell = lambda r: (r[3], r[2], topic(r[1]))
    tokens = {}
    for r in kept:
        tokens[cell(r)] = tokens.get(cell(r), 0) + n(r[1])
    cells, share = list(tokens), np.array(list(tokens.values()), float)
    share /= share.sum()
    w = share.copy()
    margin = lambda j, x: {v: x[[c[j] == v for c in cells]].sum() for v in {c[j] for c in cells}}
    for _ in range(10):
        for j, m in enumerate(mixing.MARGINS):
            raised = {v: x ** mixing.POWERS[m] if x > 0 else 0.0 for v, x in margin(j, share).items()}
            have = margin(j, w)
            w = np.array([x * raised[c[j]] / sum(raised.values()) / have[c[j]] if have[c[j]] else 0.0 for x, c in zip(w, cells)])
    ratio = {c: x / y if y > 0 else 0.0 for c, x, y in zip(cells, w, share)}
    top = max(ratio.values())
    chance = lambda i: int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:8], 16) / 2**32
    kept = [r for r in kept if chance(r[0]) < ratio[cell(r)] / top]
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {r[0]: n(r[1]) + 1 for r in kept}
    room = {}
    for r in out:
        room.setdefault(r.bin_id, [r.capacity, 0])[1] += r.n_tokens
    assert all(used <= cap and cap in packing.CAPACITIES for cap, used in room.values())


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("score", "predicted", "topic", "n_tokens", "weight", "probability", "kept", "_source", "_lang", "_topic", "_text", "_email", "_key", "_marked", "_term", "row", "_row", "k", "term", "component_id"):
        docs = docs.withColumn(name, F.concat(F.lit(name + ":"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, folder)
        assert new.columns == docs.columns
        rows = new.collect()
        assert rows and all(r[name] == (None if r.doc_id is None else f"{name}:{r.doc_id}") for r in rows for name in docs.columns[5:])
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_repeated_rows_are_one_document(spark, folder):
    rows = [(1, "a b c d e f", "en", "a", 11)] * 3 + [(2, "a b c d e f", "en", "a", 11), (None, "x", "en", "a", 1), (None, "x", "en", "a", 1)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), folder)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "None", "None"]


def test_texts_of_one_doc_id_stay(spark, folder):
    rows = [(1, "a b c d e f", "en", "a", 11), (1, "quite other words that stand here", "en", "a", 33), (1, "a b c d e f", "de", "a", 11), (1, None, "en", "a", None), (2, "far from all of those", "en", "a", 21)]
    for n in (1, 4):
        out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA).repartition(n), folder)
        got = sorted((r.doc_id, r.text or "", r.lang) for r in out.collect())
        assert [g[:2] for g in got] == [(1, ""), (1, "a b c d e f"), (1, "quite other words that stand here"), (2, "far from all of those")]
        first = got if n == 1 else first  # noqa: F821
        assert got == first
