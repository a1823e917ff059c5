import random
import re

import pytest
from pyspark.sql import types as T

from siltgate.llm.minhash import near_duplicates

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def shingles(text, w):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + w]) for i in range(max(1, len(words) - w + 1)))


def brute(rows, w, percent):
    sets = {}
    for i, t in rows:
        if i is not None and (s := shingles(t, w)):
            sets.setdefault(i, []).append(s)
    parent = {i: i for i, _ in rows if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if any(100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    rows = []
    for i in range(n):
        kind = rng.random()
        if i > 5 and kind < 0.45:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = " ".join(words)
            text = text.upper() if rng.random() < 0.2 else text
        else:
            text = " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 6, 30, 120, 400])))
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("width,seed", [(2, 1), (5, 2)])
def test_against_brute_force(spark, width, seed):
    rows = corpus(seed)
    out = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, DOCS), width, 80).collect()}
    want = brute(rows, width, 80)
    assert {i: r.component_id for i, r in out.items()} == want
    for i, t in rows:
        assert out[i].n_shingles == len(shingles(t, width))
        assert out[i].kept == (want[i] == i)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, "one"), (6, long), (7, long + " y"), (8, "a b c"), (8, "q r s"), (9, "Q r S"), (9, "Q r S"), (10, "é É x")]
    df = spark.createDataFrame([(i, t, 5, "k") for i, t in rows], "doc_id long, text string, n long, key string")
    out = near_duplicates(df, 2, 80).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id): r for r in out if r.doc_id is not None}
    assert [got[i].n_shingles for i in (1, 2, 3, 4, 10)] == [0, 0, 0, 1, 1]
    assert [got[i].component_id for i in (1, 2, 3, 4, 5, 6, 7, 9)] == [1, 2, 3, 4, 4, 6, 6, 8]
    lost = [r for r in out if r.doc_id is None]
    assert lost[0].component_id is None and lost[0].kept
    assert near_duplicates(df.limit(0), 2, 80).collect() == []


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    out = near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80)
    assert {r.doc_id: r.component_id for r in out.collect()} == brute(rows, 2, 80)


def test_components_in_rounds_and_in_one_task(spark):
    from siltgate.llm.components import components
    from siltgate.llm.scratch import Scratch

    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)]
    want = {}
    for one_task in (0, 10**6):
        got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "u long, v long"), Scratch(spark, "t"), one_task=one_task).collect()}
        want = want or got
        assert got == want
    assert want[440] == 400 and all(want.get(u, u) == want.get(v, v) for u, v in pairs)


def family(seed, n=500, size=120):
    """Near copies at distances about the threshold, strays that collide with all and join few."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 8, 9, 10, 11])):
            words[rng.randrange(size)] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("block,shingles", [(2048, 2_000_000), (64, 2_000_000), (2048, 9_000)])
def test_near_copies_with_strays_in_blocks(spark, monkeypatch, block, shingles):
    from siltgate.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
    rows = family(11)
    out = near_duplicates(spark.createDataFrame(rows, DOCS), 2, 80, collisions=28)
    assert {r.doc_id: r.component_id for r in out.collect()} == brute(rows, 2, 80)


def test_spanning_forest_is_exact_and_bounded():
    import numpy as np

    from siltgate.llm.minhash import spanning

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 90, dtype=np.uint64)
    sets = []
    for _ in range(120):
        own = base.copy()
        at = rng.choice(90, rng.integers(0, 16), replace=False)
        own[at] = rng.integers(0, 1 << 60, len(at), dtype=np.uint64)
        sets.append(np.unique(own))
    sets += [np.unique(rng.integers(0, 50, 20).astype(np.uint64)) for _ in range(30)]
    ids = np.arange(150) * 3
    c = np.where(rng.random(150) < 0.3, 0, ids)
    for part in (None, rng.integers(0, 2, 150)):
        root = {x: x for x in set(c.tolist())}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def join(x, y):
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)

        for x in range(150):
            for y in range(x):
                same = len(np.intersect1d(sets[x], sets[y]))
                if (part is None or part[x] != part[y]) and 100 * same >= 80 * (len(sets[x]) + len(sets[y]) - same):
                    join(int(c[x]), int(c[y]))
        want = {x: find(x) for x in root}
        links = spanning(ids, c, part, sets, 80)
        root = {x: x for x in root}
        for u, v in links:
            join(int(c[u // 3]), int(c[v // 3]))
        assert {x: find(x) for x in root} == want
        assert len(links) == len(set(c.tolist())) - len(set(want.values()))
