"""The tokens of a stream of texts. The analyzer keeps no state, so it runs on streams as it does on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokiwa.operators import analyze


def token_counts(stream: DataFrame, time: str = "ts", text: str = "text", window: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """Tokens of every text counted by window of event time, by the closed form or the lattice as for tables.

    Rows later than `late` are left out, as Spark's watermark has it.
    """
    made = analyze.surfaces(stream.withWatermark(time, late), text=text, key=time)
    found = made.select(time, F.explode_outer("surfaces").alias("surface")).where(F.col("surface").isNotNull())
    spans = F.window(time, window, slide) if slide else F.window(time, window)
    return found.groupBy(spans.alias("span"), "surface").agg(F.count("*").alias("n")).select(F.col("span.start").alias("window_start"), F.col("span.end").alias("window_end"), "surface", "n")
