import heapq
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from siltgate.llm import ann, urlfilter

VECS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType())])


def test_walk_visits_pairs_in_order():
    rng = np.random.default_rng(0)
    left, right = rng.random(6), rng.random(5)
    sizes = np.ones(30, np.int64)
    order = ann.walk(left, right, sizes.tolist(), 30)
    sums = [left[c // 5] + right[c % 5] for c in order]
    assert sorted(order) == list(range(30)) and all(a <= b + 1e-12 for a, b in zip(sums, sums[1:]))
    assert ann.walk(left, right, sizes.tolist(), 7) == order[:7] and heapq.nsmallest(1, sums)[0] == sums[0]
    sizes[order[:3]] = 0
    assert ann.walk(left, right, sizes.tolist(), 4) == order[3:7]


@pytest.mark.parametrize("block", [10_000, 100])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    x = (centres[rng.integers(0, 8, 3000)] + 0.4 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[50:400] = x[0]  # a hot vector
    rows = [(i, v.tolist(), "r") for i, v in enumerate(x)]
    rows += [(5000, None, "r"), (5100, [0.0] * 16, "r"), (5200, [float("nan")] + [1.0] * 15, "r"), (5300, [1.0, 2.0], "r"), (None, x[3].tolist(), "r"), (5400, [None] + [1.0] * 15, "r")]
    out = ann.neighbours(spark.createDataFrame(rows, VECS), k=10, every=100).collect()
    got = {}
    for r in out:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    d64 = x.astype(np.float64)
    hit = 0
    assert set(got) == set(range(0, 3000, 100))
    for q, found in got.items():
        dist = np.sqrt(((d64 - d64[q]) ** 2).sum(1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(3000), dist))[:10]
        assert sorted(found) == found and [f[0] for f in found] == list(range(1, 11))
        assert all(abs(dist[v] - s) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & set(best.tolist()))
    assert hit >= 0.9 * 10 * len(got)
    assert [v for _, v, _ in got[0]] == list(range(50, 60)) and [v for _, v, _ in got[100]] == [0, *range(50, 59)]


def test_recall_without_structure(spark):
    # independent normal components: the hardest case for any index, at the default settings
    x = np.random.default_rng(6).normal(size=(20_000, 64))
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(20_000), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 64).cast(pa.list_(pa.float64()))}))
    out = ann.neighbours(rows)
    assert "CoGroup" not in (plan := out._jdf.queryExecution().toString()) and "CartesianProduct" not in plan
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(found & set(np.argpartition(d, 10)[:10].tolist()))
    assert len(got) == 200 and hits >= 0.9 * 2000, hits


def test_few_rows(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b")]
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.neighbours(spark.createDataFrame(rows, VECS)).collect()] == [(0, 1, 1)]
    assert ann.neighbours(spark.createDataFrame([], VECS)).collect() == []


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"), ("a.org/x/y.html", "block"), ("a.org/x/y", "allow")]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for r, v in RULES for h, p in [(r.split("/", 1)[0], "/" + r.split("/", 1)[1])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls_against_brute_force(spark):
    rng = random.Random(1)
    urls = [None, "", "no scheme", "http://", "http://com", "HTTP://EXAMPLE.com/en/?q", "x://a.org/x/y.htmlz", "x://a.org/x/yes#f", "http://u@example.com/en/", "http://www.example.com./en/", "http://É.net/fr/ü", "a://b://c.net/es/", "http://" + "a." * 60 + "net/fr/" + "p/" * 200]
    urls += [f"http://{rng.choice(['www.', 'm.', '', 'x.y.'])}{rng.choice(['example.com', 'b.net', 'a.org', 'net'])}{rng.choice(['', '/', '/en/', '/es/1', '/fr', '/x/y', '/x/y.html', '/EN/'])}{rng.choice(['', '?a=/en/', '#z'])}" for _ in range(300)]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[5], "h")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = urlfilter.rule_table(spark, RULES + RULES[:2])
    for most in (urlfilter.BROADCAST_RULES, 0):
        urlfilter.BROADCAST_RULES, keep = most, urlfilter.BROADCAST_RULES
        try:
            out = urlfilter.judge(df, rules).collect()
        finally:
            urlfilter.BROADCAST_RULES = keep
        assert len(out) == len(rows)
        for r in out:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url
    assert urlfilter.judge(df.limit(0), rules).collect() == [] and urlfilter.judge(df, rules.limit(0)).where("verdict <> 'allow'").count() == 0


def test_share_follows_the_structure():
    rng = np.random.default_rng(8)
    loose = rng.normal(size=(4000, 32))
    tight = rng.normal(size=(200, 32))[rng.integers(0, 200, 4000)] + 0.05 * rng.normal(size=(4000, 32))
    shares = []
    for x in (loose, tight):
        books = (ann.kmeans(x[:, :16], 64), ann.kmeans(x[:, 16:], 64))
        shares.append(ann.needed_share(x, books, 16, 10, 0.95))
    assert 0.1 < shares[0] < 0.7 and shares[1] < 0.1
    assert ann.needed_share(x[:1], books, 16, 10, 0.95) == 1.0
