"""Phrases of a live stream of notes: session windows whose gap is the rest threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_phrases(notes: DataFrame, rest_seconds: float = 0.5, late_seconds: float = 10.0, min_notes: int = 3) -> DataFrame:
    """A stream (melid, ts timestamp, duration_seconds, pitch) to its phrases, each emitted once it can't grow.

    A gap is measured from the latest end so far, and one equal to the threshold doesn't split.
    """
    pitched = notes.filter(F.col("pitch").isNotNull()).withWatermark("ts", f"{late_seconds} seconds")
    gap = F.concat(F.format_string("%.6f", F.col("duration_seconds") + rest_seconds), F.lit(" seconds"))
    p = pitched.groupBy("melid", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_notes"), F.min("ts").alias("start"), F.max("ts").alias("last_onset"))
    return p.filter(F.col("n_notes") >= min_notes).select("melid", "start", "last_onset", "n_notes")
