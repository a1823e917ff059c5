import random

from siltgate.config import PolicyConfig
from siltgate.operators import repo
from siltgate.sources import commits, gitdiff


def ancestors(parents, start):
    seen, todo = set(), [start]
    while todo:
        c = todo.pop()
        if c in parents and c not in seen:
            seen.add(c)
            todo += [p for p in parents[c] if p is not None]
    return seen


def graphs(seed, n):
    """Histories with merges of two and three parents, long straight runs and several roots."""
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        if i == 0 or rng.random() < 0.02:
            out[f"c{i}"] = []
        else:
            k = 1 if rng.random() < 0.75 else rng.choice([2, 3])
            out[f"c{i}"] = list({f"c{max(0, i - 1 - int(rng.expovariate(0.3)))}" for _ in range(k)})
    return out


def frame(spark, parents):
    return spark.createDataFrame([(c, p) for c, p in parents.items()], "hash string, parents array<string>")


def test_ranges_and_bases_against_brute_force(spark):
    rng = random.Random(3)
    for seed, hops in ((1, 8), (2, 1), (3, 16)):
        parents = graphs(seed, 120)
        parents["shallow"] = ["c5", "gone", None]
        df = frame(spark, parents)
        ends = [(i, rng.choice([*parents, "nowhere", None]), rng.choice([*parents, "nowhere"])) for i in range(12)]
        ranges = spark.createDataFrame(ends, "range_id int, start string, stop string")
        got = {(r.range_id, r.hash) for r in commits.in_ranges(df, ranges, hops).collect()}
        assert got == {(i, c) for i, a, b in ends for c in ancestors(parents, b) - (ancestors(parents, a) if a else set())}, seed
        pairs = spark.createDataFrame(ends, "pair_id int, left string, right string")
        want = set()
        for i, a, b in ends:
            common = (ancestors(parents, a) if a else set()) & ancestors(parents, b)
            want |= {(i, c) for c in common if not any(c in ancestors(parents, d) for d in common - {c})}
        assert {(r.pair_id, r.hash) for r in commits.merge_bases(df, pairs, hops).collect()} == want, seed


def test_criss_cross_and_comparison(spark):
    parents = {"r": [], "a": ["r"], "b": ["r"], "x": ["a", "b"], "y": ["b", "a"], "z": ["x"], "other": []}
    df = frame(spark, parents)
    pairs = spark.createDataFrame([(1, "z", "y"), (2, "z", "other"), (3, "x", "a")], "pair_id int, left string, right string")
    assert {(r.pair_id, r.hash) for r in commits.merge_bases(df, pairs).collect()} == {(1, "a"), (1, "b"), (3, "a")}
    assert {(r.pair_id, r.hash) for r in commits.merge_base(df, pairs).collect()} == {(1, "a"), (3, "a")}
    dated = df.selectExpr("*", "case hash when 'b' then 5 when 'a' then 4 else 1 end as date")
    assert {(r.pair_id, r.hash) for r in commits.merge_base(dated, pairs).collect()} == {(1, "b"), (3, "a")}
    base = commits.resolver(df)
    assert gitdiff.comparison(["z...y"], merge_base=base) == ("a", "y") and gitdiff.comparison(["z..y"], merge_base=base) == ("z", "y")
    assert gitdiff.comparison(["z...other"], merge_base=base) == ("z", "other") and gitdiff.comparison(["z...y"]) == ("z", "y")


def test_messages_of_a_push(spark):
    parents = {"a": [], "b": ["a"], "c": ["b"], "d": ["b"], "e": ["c", "d"]}
    zero = "0" * 40
    lines = spark.createDataFrame([("refs/x e refs/x b",), (f"refs/y d refs/y {zero}",), (f"refs/z {zero} refs/z a",)], "line string")
    told = {(r.start, r.stop) for r in gitdiff.push_ranges(lines, base="a").collect()}
    assert told == {("b", "e"), ("a", "d")} and {r.start for r in gitdiff.push_ranges(lines).collect()} == {"b", None}
    ranges = spark.createDataFrame([(1, "b", "e"), (2, "a", "d")], "range_id int, start string, stop string")
    texts = spark.createDataFrame([(c, bytearray(f"message {c}\n\n".encode())) for c in parents], "hash string, content binary")
    got = {(r.range_id, r.path, r.text) for r in commits.range_messages(texts, frame(spark, parents), ranges).collect()}
    assert got == {(i, c, f"message {c}") for i, cs in ((1, "cde"), (2, "bd")) for c in cs}


def walk(paths):
    """A plain walk over the tree that the paths make."""
    files = set(paths)
    folders = {"/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 1)}
    inside = lambda d, x: f"{d}/{x}" if d else x
    up = lambda d: d.rpartition("/")[0]
    env = lambda d: inside(d, "pyvenv.cfg") in files | folders

    def cache(d):
        name = d.rpartition("/")[2]
        beside = any(inside(up(d), x) in files if x != "*.py" else any(f.endswith(".py") and up(f) == up(d) for f in files) for x in repo.BESIDE.get(name, []))
        return beside or any(inside(d, x.rstrip("/")) in (folders if x.endswith("/") else files) for x in repo.INSIDE.get(name, []))

    found = set()

    def visit(at):
        for d in sorted(x for x in folders if up(x) == at and x != at):
            name = d.rpartition("/")[2]
            if name in (".git", ".svn", ".hg", ".bzr"):
                continue
            known = name in repo.CACHE_DIRS
            if env(d) or known and cache(d):
                found.add(d)
            if not env(d) and not known and not name.startswith("."):
                visit(d)

    visit("")
    nearest = {}
    for p in files:
        d = up(p)
        while d and not (env(d) or cache(d)):
            d = up(d)
        if d:
            nearest[p] = d
    return found, nearest


def test_walk_of_the_reported_paths(spark):
    paths = ["env/pyvenv.cfg", "env/lib/a.py", "x/.hid/package.json", "x/.hid/node_modules/a.js", "y/build/z/package.json", "y/build/z/dist/a.js"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.dir for r in repo.walked(df).collect()} == {"env"} == walk(paths)[0]
    assert {(r.path, r.params["files"]) for r in repo.committed_cache_dirs(df, PolicyConfig()).collect()} == {("env", "2")}


def test_walk_against_a_plain_one(spark):
    names = ["node_modules", "dist", "build", ".venv", "env", ".hid", ".git", "src", "a", ".embuild", "espressif", "__pycache__", ".dart_tool", "pyvenv.cfg"]
    leaves = ["package.json", "pyvenv.cfg", "m.py", "go.mod", "CMakeCache.txt", "package_config.json", "f.txt", "espressif", "build.ninja"]
    rng = random.Random(8)
    for _ in range(3):
        paths = set()
        for _ in range(250):
            d = "/".join(rng.choice(names) for _ in range(rng.randrange(0, 5)))
            paths.add((d + "/" if d else "") + rng.choice(leaves))
        folders = {"/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 1)}
        paths = sorted(paths - folders)  # a name is a file or a folder
        found, nearest = walk(paths)
        df = spark.createDataFrame([(p,) for p in paths], "path string")
        assert {r.dir for r in repo.walked(df).collect()} == found
        cfg = PolicyConfig(cache_dir_ignore=["dist"], global_ignore=["src/**"])
        want = {d: min(p for p in paths if nearest.get(p) == d and not p.startswith("src/")) for d in {v for p, v in nearest.items() if not p.startswith("src/")} if not d.endswith("dist") or d.endswith("/xdist")}
        want = {d: p for d, p in want.items() if d.rpartition("/")[2] != "dist"}
        got = repo.staged_cache_dirs(df.selectExpr("path", "false as is_deleted"), df, cfg).collect()
        assert {r.params["dir"]: r.path for r in got} == want
        sized = repo.cache_sizes(df.selectExpr("path", "1L as size", "true as tracked")).collect()
        assert {r.cache_dir: r.size for r in sized} == {d: sum(p.startswith(d + "/") for p in paths) for d in found}


def test_findings_of_a_push(spark):
    from siltgate.operators import messages

    parents = {f"{c}" * 40: [f"{p}" * 40 for p in ps] for c, ps in {"a": "", "b": "a", "c": "b", "d": "b", "e": "cd"}.items()}
    texts = {"a": b"bad", "b": b"feat: fine", "c": b"no prefix\n\n", "d": b"wip: x\xff", "e": b"feat: y"}
    bodies = spark.createDataFrame([(c * 40, bytearray(t)) for c, t in texts.items() if c != "b"], "hash string, content binary")
    ranges = spark.createDataFrame([(1, "b" * 40, "e" * 40), (2, "a" * 40, "d" * 40), (3, "e" * 40, "a" * 40)], "range_id int, start string, stop string")
    cfg = PolicyConfig()
    cfg.commit_message.conventional_enabled = True
    got = sorted((r.range_id, r.path, r.code, r.line) for r in messages.check_push(bodies, frame(spark, parents), ranges, cfg).collect())
    assert got == [(1, "c" * 7, "conventional_format", 1), (1, "d" * 7, "bad_byte", 1), (1, "d" * 7, "conventional_type", 1), (2, "d" * 7, "bad_byte", 1), (2, "d" * 7, "conventional_type", 1)]


def test_only_what_ends_reach_is_dealt_out(spark):
    # 20,000 commits in merges of their eight predecessors, two of them asked for: ancestors of all others are not listed
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select(F.col("id").alias("hash"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.col("id") - i).alias("parents"))
    ends = spark.createDataFrame([(1, 10), (2, 30), (3, 99_999)], "key int, hash long")
    scratch = commits.Scratch(spark, "commits")
    got = commits.reachable(rows, ends, scratch=scratch)
    assert {(r.key, r.hash) for r in got.collect()} == {(k, h) for k, e in ((1, 10), (2, 30)) for h in range(e + 1)} and got.count() == 42
    # the links of the graph and the rows of the rounds, no ancestors of ancestors
    written = [spark.read.parquet(f"{scratch.root}/{i + 1}") for i in range(scratch.n)]
    assert sum(d.count() for d in written) < 21_000
