"""Streamed texts of every kind are counted, as the same texts in a table are."""

from collections import Counter
from datetime import datetime

from tokiwa.operators import lattice
from tokiwa.streaming import counts

TEXTS = ["the stone", "東京のAPI開発を3時間", "key 0123456789abcdef0123456789abcdef01234567", "12_34 the", "stone over it. " * 2500, "", None]


def test_every_text_is_counted(spark, tmp_path):
    at = datetime(2024, 1, 1, 0, 5)
    rows = spark.createDataFrame([(at, t) for t in TEXTS], "ts timestamp, text string")
    rows.write.parquet(f"{tmp_path}/in")
    engine = lattice.Analyzer()
    engine.plain = False
    expected = Counter(m.surface for t in TEXTS if t for m in engine.analyze(t))
    assert {r["surface"]: r["n"] for r in counts.token_counts(rows).collect()} == expected
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    writer = counts.token_counts(stream).writeStream.format("memory").queryName("whole_counts").outputMode("complete")
    run = writer.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    try:
        assert run.awaitTermination(90)
    finally:
        run.stop()
    assert {r["surface"]: r["n"] for r in spark.table("whole_counts").collect()} == expected
