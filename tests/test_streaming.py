"""Streams give what batches give."""

from __future__ import annotations

import datetime as dt

from siltgate.config import PolicyConfig
from siltgate.operators.messages import check_messages
from siltgate.streaming.checks import deduplicated, stream_findings, windowed_counts

SCHEMA = "path string, text string, content binary, ts timestamp"


def test_findings_and_windows(spark, tmp_path):
    cfg = PolicyConfig()
    cfg.commit_message.conventional_enabled = True
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(f"m{i}", ["feat: a​b", "bad subject", "fix: ok"][i % 3], bytearray(b"x"), t + dt.timedelta(minutes=i)) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))

    def drain(df, name, mode="append"):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = drain(stream_findings(source(), cfg), "stream_found")
    want = check_messages(spark.read.parquet(str(tmp_path / "in")), cfg)
    key = lambda d: sorted((r.path, r.check, r.line, r.col) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) == 8
    counts = drain(windowed_counts(source(), cfg), "stream_counts", "update")
    assert sum(r.n for r in counts.collect()) == 8
    assert drain(deduplicated(source()), "stream_once").count() == 12
