import random
import zlib

import pytest

from siltgate.llm import toxicity


@pytest.fixture(scope="module")
def scorer():
    return toxicity.Scorer({w: toxicity.PRIOR for w in toxicity.INSULTS}, {"grob": 6.0})


def test_grammar(scorer):
    s = scorer.score
    assert s("") == s("a plain text.") < 0.3
    assert s("You are an idiot.") > s("The idiot.") >= 0.7
    assert s("You are not an idiot.") < 0.5 and s("She said he is an idiot.") < s("He is an idiot.")
    assert s("I will kill you.") >= 0.7 and s("I will not kill you.") < 0.5 and s("Kill the process.") < 0.5 and s("He said I will kill you.") < 0.7
    assert s("what a grobling thing") >= 0.7 and s("grob") < 0.3  # a beginning needs a longer word
    # a negation or report holds for its own clause
    assert s("Not here. Idiot!") >= 0.7 and s("x said. Idiot!") >= 0.7
    assert s("idiots everywhere; " * 5) >= s("idiots everywhere;") and s("IDIOT") >= 0.7
    assert 0 <= s("idiot moron " * 2000) <= 1


def planted():
    rows, labels = [], []
    rng = __import__("random").Random(1)
    for i in range(900):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(5, 60))]
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["zlom" + x for x in ("ar", "eth", "ing", "u", "x")] + ["krentz"])
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_learned_words_hold_out(spark):
    rows, labels = planted()
    docs = spark.createDataFrame([*rows, (None, "idiot"), (1000, None), (1001, ""), (5, rows[5][1])], "doc_id long, text string").selectExpr("*", "1 as score", "'x' as predicted")
    out = toxicity.toxic_scores(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) + 4
    by = {r.doc_id: r for r in out}
    for i, _, y in labels:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert by[i].predicted == y == int(by[i].score >= 0.7)
    assert by[None].predicted == 1 and not by[None].held_out and by[1000].score == by[1001].score < 0.3
    words, begin = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert begin.keys() == {"zlom"} and "krentz" in words


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "you idiot"), (2, "fine")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxicity.toxic_scores(docs, none).orderBy("doc_id").collect()] == [1, 0]
    assert toxicity.toxic_scores(docs.limit(0), none).collect() == []


def test_insults_in_stock_phrases_are_learned(spark):
    """A word that always follows the same one, in many different texts; and one that stands in copies of one text alone."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("aeioutrnsl") for _ in range(rng.randrange(3, 8))) for _ in range(n))
    docs = [(i, f"{say(20)}. {say(3)} you zorblat {say(4)}. {say(15)}", 1) for i in range(500)]
    docs += [(500 + i, f"{say(20)}. {say(3)} you {say(5)}. {say(15)}", 0) for i in range(1000)]
    copied = f"{say(60)} quixlorp {say(60)}"
    docs += [(1500 + i, f"{copied} {say(2)}", 1) for i in range(60)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in docs], "doc_id long, toxic int")
    words, begin = toxicity.learn(df, labels)
    assert "zorblat" in words and "quixlorp" not in words and not any("quixlorp".startswith(b) for b in begin)
    out = toxicity.toxic_scores(df, labels).where("held_out and doc_id < 1500").collect()
    assert sum(r.predicted for r in out if r.doc_id < 500) >= 0.99 * sum(r.doc_id < 500 for r in out)
    assert sum(r.predicted for r in out if r.doc_id >= 500) == 0


def test_classes_of_texts():
    base = [f"w{i}" for i in range(100)]
    texts = {1: " ".join(base), 2: " ".join(base[:50] + ["x"] + base[51:]), 3: " ".join(base[::-1]), 4: "", 5: "", 6: "a b"}
    got = toxicity.text_classes({d: toxicity._sketch(t) for d, t in texts.items()})
    assert got[1] == got[2] == 1 and got[3] == 3 and got[4] == got[5] == 4 and got[6] == 6


def test_other_languages():
    s = toxicity.Scorer({"zorblat": 5.0}, {})
    plain, quoted, denied = s.clause("du bist ein zorblat"), s.clause("er sagte zorblat"), s.clause("nicht zorblat")
    assert plain > quoted > denied and s.clause("voy a matar ti") > toxicity.BIAS and s.clause("no voy a matar ti") < plain


def plain_score(text, words, beginnings):
    """Clause by clause, the four rewritings one after the other, word by word."""
    import math
    import re

    best_of, hits = 0.0, 0
    for clause in re.split(r"[.!?;\n]", text.lower()):
        symbols, weights = [], []
        for w in re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", clause):
            weight = max([words.get(w, 0.0), *(v for b, v in beginnings.items() if len(w) > len(b) and w.startswith(b))])
            fixed = next((s for s, ws in (("report", toxicity.REPORTS), ("not", toxicity.NEGATIONS), ("target", toxicity.TARGETS), ("threat", toxicity.THREATS)) if w in ws), "other")
            symbols.append("insult" if weight > 0 else fixed)
            weights.append(weight)
        # reported speech: what follows a reporting verb is quoted
        quoting, out = False, []
        for s in symbols:
            out.append({"insult": "quoted", "threat": "other"}.get(s, s) if quoting else s)
            quoting = quoting or s == "report"
        # a negation reaches over three symbols
        reach, denied = 0, []
        for s in out:
            if s == "not":
                reach = 3
                denied.append(s)
                continue
            denied.append({"insult": "denied", "threat": "other"}.get(s, s) if reach else s)
            reach = max(0, reach - 1)
        # a threat counts with a target within two symbols, an insult within four after a target counts more
        extra = [0.0] * len(denied)
        threat = target = 0
        for i, s in enumerate(denied):
            if s == "threat":
                threat = 2
            elif threat:
                if s == "target":
                    extra[i] += toxicity.THREAT
                    threat = 0
                else:
                    threat -= 1
            if s == "target":
                target = 4
            elif target:
                extra[i] += 0.5 if s == "insult" else 0.0
                target -= 1
        best, more = 0.0, 0.0
        for s, w, e in zip(denied, weights, extra):
            got = w * {"insult": 1.0, "quoted": 0.5, "denied": 0.25}.get(s, 0.0) + e
            best, more = (got, more + best) if got > best else (best, more + got)
        total = best + 0.1 * min(more, 10.0)
        hits += total > toxicity.BIAS
        best_of = max(best_of, total)
    return 1 / (1 + math.exp(toxicity.BIAS - best_of - 0.3 * math.log1p(max(0, hits - 1))))


def test_scores_against_a_plain_reading(spark):
    rng = random.Random(12)
    words, begin = {"zorblat": 6.0, "grobnik": 3.0, "idiot": 4.0}, {"quix": 5.0}
    pool = ["zorblat", "grobnik", "idiot", "quixly", "quix", "you", "they", "not", "never", "said", "kill", "hurt", "the", "word", "plain", "it's", "Él", "dijo", "nicht", "du", ".", "!", "\n", ",", "zorblats"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(0, 25))) for _ in range(600)] + ["", "x" * 200_000, ("plain words here. " * 20_000) + "you zorblat"]
    s = toxicity.Scorer(words, begin)
    for t in texts:
        assert abs(s.score(t) - plain_score(t, words, begin)) < 1e-12, t[:200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(df, words, begin).collect()}
    assert all(abs(got[i] - plain_score(t, words, begin)) < 1e-12 for i, t in enumerate(texts))
