import random

import numpy as np

from siltgate.llm import mixing, packing


def docs(n=4000):
    rng = random.Random(2)
    out = []
    for i in range(n):
        k = rng.choice([5, 80, 120])
        text = " ".join(["w"] * k) + (" |" * 10 if rng.random() < 0.2 else "")
        out.append((i, text, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "a", "b", "c"]), "old"))
    return out


def test_rake_against_numpy(spark):
    rng = random.Random(3)
    cells = [(s, lg, t, rng.randint(0, 500), 1) for s in "abcd" for lg in ("en", None) for t in ("x", "y", "z") if rng.random() < 0.9]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long, n long")
    powers = {"source": 0.5, "lang": 0.8, "topic": 0.9}
    from siltgate.llm.scratch import Scratch

    for small in (mixing.SMALL, 0):
        keep, mixing.SMALL = mixing.SMALL, small
        try:
            got = {(r.source, r.lang, r.topic): r.weight for r in mixing.rake(df, Scratch(spark, "t"), powers, 30).collect()}
        finally:
            mixing.SMALL = keep
        share = np.array([c[3] for c in cells], float)
        share /= share.sum()
        w = share.copy()
        for _ in range(30):
            for j, m in enumerate(mixing.MARGINS):
                values = [c[j] for c in cells]
                own = {v: share[[x == v for x in values]].sum() for v in set(values)}
                raised = {v: s ** powers[m] if s > 0 else 0 for v, s in own.items()}
                have = {v: w[[x == v for x in values]].sum() for v in own}
                w = np.array([x * raised[v] / sum(raised.values()) / have[v] if have[v] else 0 for x, v in zip(w, values)])
        assert all(abs(got[c[:3]] - x) < 1e-9 for c, x in zip(cells, w))


def test_sample_has_the_targets(spark):
    df = spark.createDataFrame(docs(), "doc_id long, text string, lang string, source string, weight string")
    out = mixing.mix(df, {"source": 0.5, "lang": 1.0, "topic": 1.0})
    rows = out.collect()
    assert len(rows) == 4000 and all(0 <= r.probability <= 1 for r in rows) and max(r.probability for r in rows) == 1
    total, kept = {}, {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + r.n_tokens
        if r.kept:
            kept[r.source] = kept.get(r.source, 0) + r.n_tokens
    target = {s: (n / sum(total.values())) ** 0.5 for s, n in total.items()}
    for s in total:
        assert abs(kept[s] / sum(kept.values()) - target[s] / sum(target.values())) < 0.05
    assert {(r.doc_id, r.kept) for r in mixing.mix(df.repartition(7), {"source": 0.5, "lang": 1.0, "topic": 1.0}).collect()} == {(r.doc_id, r.kept) for r in rows}


def test_given_targets_are_reached(spark):
    from siltgate.llm.scratch import Scratch

    targets = {"source": {"a": 1, "b": 2, "c": 1, "nowhere": 5}, "lang": {"en": 0.25, None: 0.25, "de": 0.5}}
    df = spark.createDataFrame(docs(), "doc_id long, text string, lang string, source string, weight string")
    rows = mixing.mix(df, {"topic": 1.0}, rounds=60, targets=targets, tolerance=1e-9).collect()
    kept = [r for r in rows if r.kept]
    assert len(kept) > 200
    for m, wanted in targets.items():
        real = {v: w for v, w in wanted.items() if v != "nowhere"}
        for v, w in real.items():
            have = sum(r.n_tokens for r in kept if r[m] == v) / sum(r.n_tokens for r in kept)
            # expected tokens are exact, the sample's are near
            expected = sum(r.n_tokens * r.probability for r in rows if r[m] == v) / sum(r.n_tokens * r.probability for r in rows)
            assert abs(expected - w / sum(real.values())) < 1e-6 and abs(have - w / sum(real.values())) < 0.08
    # a value that isn't named goes
    only = mixing.mix(df, targets={"source": {"a": 1.0}}).where("kept").select("source").distinct().collect()
    assert [r.source for r in only] == ["a"]
    cells = df.selectExpr("source", "lang", "'t' as topic", "length(text) as tokens", "1L as n").groupBy("source", "lang", "topic").agg({"tokens": "sum", "n": "sum"}).toDF("source", "lang", "topic", "tokens", "n")
    for rounds, most in ((1, 1.0), (60, 1e-9)):
        assert mixing.error(mixing.rake(cells, Scratch(spark, "t"), {}, rounds, targets, 1e-9)) <= most


def test_mix_edges(spark):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(None, "a b", "en", None), (1, None, None, "s"), (2, "", "en", "s"), (3, "a b c", "en", "s"), (3, "a b c", "en", "s")]
    out = mixing.mix(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 5 and [r.n_tokens for r in out if r.doc_id == 1] == [0] and not any(r.kept for r in out if r.doc_id == 1)
    assert mixing.mix(spark.createDataFrame([], schema)).collect() == []
    assert not any(r.kept for r in mixing.mix(spark.createDataFrame(rows[1:3], schema)).collect())


def check_bins(rows, capacities):
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for rs in bins.values():
        at = 0
        for r in sorted(rs, key=lambda r: (r["bin_start"], -r["n_tokens"] == 0)):
            assert r["bin_start"] == at or r["n_tokens"] == 0
            at += r["n_tokens"]
        cap = rs[0]["capacity"]
        assert at <= cap and all(r["capacity"] == cap for r in rs) and cap == next(c for c in sorted(capacities) if c >= at)
    return bins


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([0, 3, 40, 700, 3000, 9000, 30000]) + rng.randrange(3), "x") for i in range(900)] + [(None, None, "x"), (7, -4, "x"), (9, 100, "x"), (9, 100, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, bin_id string")
    for shard in (20_000, 200):
        out = [r.asDict() for r in packing.best_fit(df, shard=shard).collect()]
        bins = check_bins(out, packing.CAPACITIES)
        assert sum(r["n_tokens"] for r in out) == sum(max(n or 0, 0) for _, n, _ in rows)
        by = {}
        for r in out:
            by.setdefault(r["doc_id"], []).append(r)
        for i, n, _ in rows:
            if i not in (None, 7, 9):
                parts = sorted(by[i], key=lambda r: r["piece"])
                assert [r["start"] for r in parts] == [8192 * k for k in range(len(parts))] and sum(r["n_tokens"] for r in parts) == n
        waste = sum(rs[0]["capacity"] for rs in bins.values()) / sum(r["n_tokens"] for r in out)
        assert waste < 1.06
    assert packing.best_fit(df.limit(0)).collect() == []


def test_opens_the_least_cost_size_and_downsizes():
    bins, offsets, caps = packing.pack(np.array([500, 10]), (512, 1024), 64)
    assert bins.tolist() == [0, 0] and offsets.tolist() == [0, 500] and caps.tolist() == [512, 512]
    _, _, caps = packing.pack(np.array([600, 300, 100]), (512, 1024), 64)
    assert caps.tolist() == [1024] * 3
    bins, _, caps = packing.pack(np.array([512, 512, 300]), (512, 1024), 64)
    assert sorted(set(zip(bins.tolist(), caps.tolist()))) == [(0, 1024), (1, 512)]


def spent(bins, caps, **k):
    return sum(packing.cost(c, **k) for c in dict(zip(bins.tolist(), caps.tolist())).values())


def test_sizes_are_weighed_jointly():
    rng = np.random.default_rng(7)
    lengths = np.minimum(8192, rng.lognormal(5.6, 1.1, 20_000).astype(int) + 1)
    bins, _, caps = packing.pack(lengths)
    assert len(set(caps.tolist())) >= 4
    for alone in (4096, 8192):
        some = np.minimum(lengths, alone)
        b, _, c = packing.pack(some, (alone,))
        all_sizes = spent(*packing.pack(some)[::2])
        used = np.bincount(b, weights=some)
        downsized = sum(packing.cost(next(k for k in packing.CAPACITIES if k >= u)) for u in used)
        assert all_sizes < 0.95 * downsized


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def test_against_every_packing():
    rng = np.random.default_rng(8)
    caps, k = (8, 16, 32), {"overhead": 1, "attention": 32}
    ratios = []
    for _ in range(60):
        lengths = rng.integers(1, 33, rng.integers(1, 8))
        bins, _, final = packing.pack(lengths, caps, **k)
        best = min(sum(packing.cost(next(c for c in caps if c >= sum(b)), **k) for b in p) for p in partitions(lengths.tolist()) if all(sum(b) <= 32 for b in p))
        ratios.append(spent(bins, final, **k) / best)
    assert min(ratios) >= 1 and max(ratios) <= 1.35 and sum(ratios) / len(ratios) <= 1.06, (max(ratios), sum(ratios) / len(ratios))


def test_zero_lengths_share_a_bin():
    bins, offsets, caps = packing.pack(np.zeros(1000, int))
    assert set(bins.tolist()) == {0} and set(caps.tolist()) == {512}
    bins, offsets, caps = packing.pack(np.array([0, 512, 0]))
    assert bins.tolist() == [0, 0, 0] and offsets.tolist() == [512, 0, 512]


def test_bins_do_not_depend_on_the_partitions(spark):
    rows = [(i % 400 if i % 9 else None, (i * 37) % 900) for i in range(1200)] + [(7, 50)] * 30 + [(8, 20_000)] * 3
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    bins = [sorted((str(r.doc_id), r.piece, r.n_tokens, r.bin_id, r.bin_start, r.capacity) for r in packing.best_fit(d, shard=100).collect()) for d in (df.coalesce(1), df.repartition(3), df.repartition(5, "n_tokens"))]
    assert bins[0] == bins[1] == bins[2] and len(bins[0]) == 1230 + 9
