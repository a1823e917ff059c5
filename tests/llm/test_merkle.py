import hashlib
import zlib

from siltgate.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, grp int, all string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(r, text):
    return sha("".join(told(v) for v in (r[0], r[3], r[2], r[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    out = []
    for nodes in tree[:-1]:
        a = i // 16 * 16
        out.append(("".join(nodes[a:i]), "".join(nodes[i + 1 : a + 16])))
        i //= 16
    return out


def brute(rows):
    """Leaf, subroot, root, proof and folded root of every row, in any order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        trees[s] = levels([leaf_of(r, r[1]) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = path(trees[s], i) + path(top, k)
            text = r[1]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            d = leaf_of(r, text)
            for a, b in steps:
                d = sha(a + d + b)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), d, d == top[-1][0]))
    return out


def got(df):
    return [tuple(r) for r in merkle.checked(df).collect()]


def key(t):
    return tuple((x is not None, x) for x in t)


def test_against_brute_force(spark):
    rows = []
    for i in range(700):  # one group of three rounds of blocks, others of one leaf, 16, 17 and of a null source
        s = {0: "a", 1: None, 2: "Z"}.get(i % 40, "hot") if i < 600 else f"s{i % 50:02d}é"
        rows.append((i, f"Text {i} ünd A" if i % 3 else "lower", "en" if i % 7 else None, s, i, "x", 1, "y"))
    rows += [(None, None, None, None, None, "x", 1, "y"), (None, "A", "en", "hot", 3, "x", 1, "y"), (5, "", "en", "hot", 0, "x", 1, "y")]
    rows += [(11, "Same", "en", "hot", 4, "x", 1, "y")] * 20 + [(-3, "Z" * 300_000, "en", "big", 300_000, "x", 1, "y")]
    want = sorted(brute([r[:5] for r in rows]), key=key)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(got(df), key=key) == want
    assert sorted(got(df.repartition(7, "n_chars")), key=key) == want
    bad = [w for w in want if not w[6]]
    assert len(bad) > 50 and all(w[0] is not None for w in bad)


def test_sizes_about_the_borders(spark):
    for n in (1, 16, 17, 256, 257):
        rows = [(i, "t", "en", "s", i) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        assert sorted(got(df)) == sorted(brute(rows)), n
        if n == 257:
            assert got(df.limit(0)) == []


def test_many_groups_and_shuffled_counts(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 300}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    merkle.SMALL, keep = 0, merkle.SMALL
    try:
        assert sorted(got(df)) == sorted(brute(rows))
    finally:
        merkle.SMALL = keep


def test_small_blocks(spark):
    """The levels of a block don't matter for the result."""
    rows = [(i, f"T{i}", "en", "s" if i % 3 else "t", i) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    merkle.LEVELS, keep = 1, merkle.LEVELS
    try:
        one = sorted(got(df))
    finally:
        merkle.LEVELS = keep
    assert one == sorted(brute(rows))
