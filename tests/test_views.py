from siltgate.plans.views import VIEWS


def seen(spark, name, table, rows, schema):
    return {r[0]: r.text for r in spark.sql(VIEWS[name].replace(f"from {table}", "from {t}"), t=spark.createDataFrame(rows, schema)).collect()}


def test_document_views_hold_whole_texts(spark):
    rows = [(i, "web", "en", "a" * 300 + f"end{i}") for i in range(12)]
    for name in ("docs_scripts", "docs_blanks"):
        got = seen(spark, name, "documents", rows, "doc_id long, source string, lang string, text string")
        assert all(text in got[i] for i, _, _, text in rows)


def test_messages_hold_whole_texts(spark):
    rows = [(c, t, "b" * 200 + f"\nend{c}_{t}") for c in range(6) for t in range(3)]
    got = seen(spark, "msgs", "conversations", rows, "conv_id long, turn int, text string")
    assert all(text in got[c * 1000 + t] for c, t, text in rows)
