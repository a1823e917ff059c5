"""Units of comments found without their texts, and those with an added line."""

import random

import pytest
from pyspark.sql import functions as F

from siltgate.config import PolicyConfig
from siltgate.operators import changes, directives, files
from siltgate.operators.comments import parse_comments


def policy(strings=False):
    cfg = PolicyConfig()
    cfg.comment_language.languages = ["python", "go", "typescript"]
    cfg.comment_language.file_languages = [("*.ts", "english")]
    cfg.comment_language.check_strings = strings
    return cfg


def sources(rng, n):
    said = ["some words", "한국어 설명", "", " ", "siltgate:ignore", "siltgate:disable", "siltgate:enable", "siltgate:lang=ja", "Siltgate:file-lang=en", "next:  "]
    out = []
    for i in range(n):
        mark, ext = rng.choice([("#", "py"), ("//", "go"), ("//", "ts")])
        lines = ["package x"] if ext == "go" else []
        for _ in range(rng.randint(0, 25)):
            kind = rng.random()
            text = rng.choices(said, [6, 6, 2, 1, 1, 1, 1, 1, 0.3, 1])[0]
            code = f"x = '{text}'" if ext != "go" else f'x("{text}")'
            block = f"/* {text}\n\n * more */" if mark == "//" else f'"""{text}\nmore"""'
            lines.append(f"{mark} {text}" if kind < 0.6 else code if kind < 0.75 else block if kind < 0.9 else "y")
        out.append((f"d{i % 5}/{i}.{ext}", "\n".join(lines)))
    return [*out, ("none.py", None), (None, "# words"), ("other.bin", "# words"), ("empty.py", "")]


@pytest.mark.parametrize("strings", [False, True])
def test_units_and_added_lines_against_whole_rows(spark, strings):
    rng = random.Random(11)
    cfg, names = policy(strings), ["path", "unit_id", "text", "line", "end_line", "lang", "kind"]
    corpus = spark.createDataFrame(sources(rng, 150), "path string, text string").repartition(5)
    default = F.when(F.col("path").endswith(".ts"), "english").otherwise("korean")
    whole = directives.units(directives.states(parse_comments(corpus), default), strings).select(names).collect()
    assert len(whole) > 300 and {r.kind for r in whole} == ({"Comment", "String"} if strings else {"Comment"})
    assert sorted(map(tuple, files.comment_units(corpus, cfg).select(names).collect())) == sorted(map(tuple, whole))
    added = [(r.path, n) for r in corpus.where("path is not null").collect() for n in range(1, 40) if rng.random() < 0.15]
    lines = spark.createDataFrame([*added, *added[:50], (None, 1), ("gone.py", 1)], "path string, line long")
    told = set(added)
    wanted = [tuple(r) for r in whole if any((r.path, n) in told for n in range(r.line, r.end_line + 1))]
    assert 0 < len(wanted) < len(whole)
    assert sorted(map(tuple, files.comment_units(corpus, cfg, lines).select(names).collect())) == sorted(wanted)
    # the same for units that have their texts
    units = spark.createDataFrame(whole)
    assert sorted(map(tuple, directives.touched(units, lines).select(names).collect())) == sorted(wanted)


def shuffled(spark, df):
    """Bytes that the stages of a query write for shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = lambda: {s.stageId(): s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    had = stages()
    rows = df.collect()
    context.listenerBus().waitUntilEmpty()
    return rows, sum(n for i, n in stages().items() if i not in had)


def test_texts_are_shuffled_once(spark):
    rng = random.Random(12)
    letters = [chr(c) for c in range(0x61, 0x7B)] + [chr(c) for c in range(0x400, 0x460)]
    texts = ["\n".join(f"x = 1\n# {''.join(rng.choices(letters, k=400))}" for _ in range(20)) for _ in range(60)]
    corpus = spark.createDataFrame([(f"f{i}.py", t) for i, t in enumerate(texts)], "path string, text string").repartition(4)
    diff = corpus.select("path", *[F.lit(False).alias(c) for c in ("is_deleted", "is_submodule", "is_symlink")], F.array(F.lit(6).cast("long"), F.lit(8).cast("long")).alias("added_lines"))
    rows, written = shuffled(spark, changes.comment_language(diff, corpus, policy()))
    assert sorted((r.path, r.line) for r in rows) == sorted((f"f{i}.py", n) for i in range(60) for n in (6, 8))
    # the texts go by path once, after they were dealt to four tasks here, and all else is small
    size = sum(len(t.encode()) for t in texts)
    assert size > 700_000 and written < 3 * size
