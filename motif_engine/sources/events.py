"""The note view over the driver tables: one solo per user, one note per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One hour is one beat; beats count from here.
START = "2024-01-01 00:00:00"


def _key(melid: str) -> int | None:
    """The user of a solo; None for a name that no solo has."""
    digits = melid.removeprefix("ev-")
    return int(digits) if melid == f"ev-{digits}" and digits.isascii() and digits.isdigit() else None


def notes(spark: SparkSession, sf_dir: str, melid: str | None = None) -> DataFrame:
    """melid, note_idx, pitch (null: a rest), onset_beat, duration_beats, velocity; of one solo, the scan reads its user only."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    if melid is not None:
        e = e.filter(F.col("user_id") == F.lit(_key(melid)))
    k = F.get_json_object("props", "$.k").cast("int")
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{START}', cast(ts as timestamp_ntz))")
    return e.select(
        F.concat(F.lit("ev-"), F.col("user_id").cast("string")).alias("melid"),
        F.col("event_id").cast("long").alias("note_idx"),
        F.when(F.col("event_type") != "error", 54 + k % 13).cast("int").alias("pitch"),
        (micros / F.lit(3600000000.0)).alias("onset_beat"),
        (F.lit(0.25) + F.col("value") / F.lit(5.0)).alias("duration_beats"),
        F.lit(None).cast("int").alias("velocity"),
    )


def metadata(spark: SparkSession, sf_dir: str, melid: str | None = None) -> DataFrame:
    """melid, performer, title, style, year: the customer and nation of each user."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_nationkey")
    if melid is not None:
        c = c.filter(F.col("c_custkey") == F.lit(_key(melid)))
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        F.concat(F.lit("ev-"), F.col("c_custkey").cast("string")).alias("melid"),
        F.col("c_name").alias("performer"),
        F.concat(F.lit("solo of "), F.col("c_name")).alias("title"),
        F.col("n_name").alias("style"),
        (F.lit(1950) + F.pmod("c_custkey", F.lit(50))).cast("int").alias("year"),
    )


def corpus(spark: SparkSession, sf_dir: str):
    """The view as a corpus whose lookups read one user's rows."""
    from motif_engine.corpus import Corpus

    return Corpus("events", notes(spark, sf_dir), metadata(spark, sf_dir), lambda m: (notes(spark, sf_dir, m), metadata(spark, sf_dir, m)))
