import hashlib
import math
import random
import re

from siltgate.llm import pii

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for k, p in KINDS:
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d) if k == "card" else 0, "phone": 8 <= len(d) <= 15}[k]
            if good:
                out.append((k, m.start(), m.end()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


TEXTS = [
    None, "", "mail a.b@c-d.org, x@y and a@b.c_d@e.f! é\U0001f600 z@w.io", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3.99999999999999999999",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 12 3 4111  1111", "+1 (212) 555-0100 +1 2 +49 30 1234567890123456 +1+12345678",
    "a" * 50_000 + " " + "1" * 50_000 + "@x.y" + ".z" * 3000, "x@a..b x@-.- %@1.2.3.4 (+1 555 0100 00)",
]


def test_base_spans_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "y", 4)] * 2, "doc_id long, text string, spans string, _term int")
    out = pii.span_table(df).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        want = brute(TEXTS[r.doc_id] if r.doc_id is not None else TEXTS[2])
        assert r.spans == want and r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert pii.span_table(df.limit(0)).collect() == []


def corpus():
    rows = [(i, f"filler line number {'abcdefgh'[i % 8] * 3} common words here\nother common text {i}") for i in range(60)]
    rows += [(100 + i, f"case {'xyz'[i] * 3}: Zorblatt wrote from zed@q.org about {'uvw'[i] * 4} common words") for i in range(3)]
    rows += [(110 + i, "case copy: Quux wrote from copy@q.org common") for i in range(5)]
    return rows + [(200, "a memo names Zorblatt only"), (201, None)]


def test_disclosing_terms(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    # wrote and from stand in four lines (the copies count once), case too: they disclose less than zorblatt, in four with three of the address
    out = {r.doc_id: r for r in pii.span_table(df, share=0.9, support=3).collect()}
    marked = {corpus_text[a:b] for i, r in out.items() for corpus_text in [dict(corpus())[i] or ""] for k, a, b in [x.split(":") for x in r.spans.split(",") if x] if k == "term" for a, b in [(int(a), int(b))]}
    assert "Zorblatt" in marked and "Quux" not in marked and "common" not in marked
    assert out[200].n_term == 1 and out[0].spans == ""


def test_sanitised(spark):
    df = spark.createDataFrame([*corpus(), (300, "call +1 (212) 555-0100 or a@b.co, card 4111 1111 1111 1111."), (301, "plain")], "doc_id long, text string").selectExpr("doc_id", "text", "1 as n")
    out = pii.sanitised(df)
    assert out.columns == ["doc_id", "text", "n"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[300] == "call [PHONE] or [EMAIL], card [CARD]." and got[301] == "plain" and got[201] is None and got[200] == "a memo names  only"


def test_entities_of_one_line_take_part(spark):
    rows = [(i, f"filler line number {i} with common words wrote about case") for i in range(1500)]
    rows += [(2000, "case: Vandermeer wrote from once@q.org about common words"), (2001, "a memo names Vandermeer with common words")]
    rows += [(2100 + i, "case copy: Quux wrote from copy@q.org common") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marked = {(r.doc_id, rows_text[int(a) : int(b)]) for r in pii.span_table(df).collect() for rows_text in [dict(rows)[r.doc_id]] for k, a, b in [x.split(":") for x in r.spans.split(",") if x] if k == "term"}
    # the name in two lines, one with the address; the copies of a line count once but count
    assert {(2000, "Vandermeer"), (2001, "Vandermeer"), (2100, "Quux"), (2104, "Quux")} <= marked
    assert not {w for _, w in marked} & {"common", "words", "wrote", "about", "filler", "case"}
    got = {r.doc_id: r.text for r in pii.sanitised(df).where("doc_id = 2001").collect()}
    assert got == {2001: "a memo names  with common words"}


def entities_of(line):
    out = set()
    for k, a, b in (x.split(":") for x in brute(line).split(",") if x):
        v = line[int(a) : int(b)]
        out.add((k, v.lower() if k == "email" else v if k == "ip" else re.sub("[^0-9]", "", v)))
    return out


def brute_terms(texts, share=0.9):
    """The disclosing terms by counting every term with every value over the distinct lines."""
    lines = {x for t in texts for x in (t or "").split("\n") if x}
    n, ents, terms, both = len(lines), {}, {}, {}
    for x in lines:
        found, words = entities_of(x), set(re.findall(r"[^\W\d_]{3,}", re.sub(KINDS[0][1], " ", x).lower()))
        for e in found:
            ents[e] = ents.get(e, 0) + 1
        for w in words:
            terms[w] = terms.get(w, 0) + 1
            for e in found:
                both[w, e] = both.get((w, e), 0) + 1
    out = set()
    for (w, e), m in both.items():
        pmi, ic = math.log(m * n / (terms[w] * ents[e])), math.log(n / ents[e])
        if ic > 0 and pmi >= share * ic and m * pmi >= -math.log(pii.CHANCE):
            out.add(w)
    return out


def test_terms_against_brute_force(spark):
    rng = random.Random(12)
    names = ["Alba", "Boro", "Cele", "Duna", "Etta", "Faro"]
    rows = []
    for i in range(900):
        line = [rng.choice(["some", "text", "about", "nothing", "much", "today", "green", "water"]) for _ in range(6)]
        if i % 5 == 0:
            k = rng.randrange(len(names))
            line += [names[k], f"p{k}@mail.org" if rng.random() < 0.9 else f"p{(k + 1) % 6}@mail.org"]
        elif i % 37 == 0:
            line.append(rng.choice(names))
        if i % 90 == 0:
            line += [f"only{'abcdefghij'[i // 90]}", f"u{i}@x.org", f"v{i}@x.org"]
        rows.append((i, " ".join(line) + f"\nline {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]} of its own"))
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    want = brute_terms([t for _, t in rows])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.term for r in pii.disclosing_terms(df.select(df.text.alias("_text")), pii.Scratch(spark, "t")).collect()}
    assert got == want and len(want) >= 5 and "water" not in want


def test_long_texts_and_lines_take_linear_time(spark):
    import time

    many = " ".join(f"w{'abcdefghij'[i % 10] * (1 + i // 10 % 7)} a{i}@b.co" for i in range(4000))
    df = spark.createDataFrame([(1, many), (2, many + "\n" + many + " x"), (3, "word " * 60_000 + " z@z.org Zorro"), (4, "Zorro came z@z.org")], "doc_id long, text string")
    pii.sanitised(df.limit(1)).collect()
    began = time.time()
    out = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert time.time() - began < 30
    assert out[1].count("[EMAIL]") == 4000 and "@" not in out[2] and out[3].count("word") == 60_000
