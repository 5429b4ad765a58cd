"""Phrases: runs of notes between rests, cut to a longest length, without those that are too small."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SegmentationConfig:
    rest_threshold_beats: float = 0.5
    max_phrase_beats: float = 16.0
    min_phrase_beats: float = 0.5
    min_phrase_notes: int = 3
    skip_first_beats: float = 0.0


def split_at_rests(notes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pitched notes with run: a new one where the gap to the previous note's end is over threshold.

    run_start and run_end are the run's first onset and the end of its last note.
    """
    w = W.partitionBy("melid").orderBy("onset_beat", "note_idx")
    n = notes.filter(F.col("pitch").isNotNull())
    gap = F.col("onset_beat") - F.lag(F.col("onset_beat") + F.col("duration_beats")).over(w)
    n = n.withColumn("_new", F.coalesce((gap > threshold).cast("int"), F.lit(0)))
    n = n.withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    whole = W.partitionBy("melid", "run").orderBy("onset_beat", "note_idx").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return n.withColumns({"run_start": F.first("onset_beat").over(whole), "run_end": F.last(F.col("onset_beat") + F.col("duration_beats")).over(whole)})


def force_split(runs: DataFrame, max_beats: float = 16.0) -> DataFrame:
    """split_at_rests' notes with chunk, start_beat and end_beat: runs cut every max_beats."""
    last = F.greatest(F.ceil((F.col("run_end") - F.col("run_start")) / max_beats) - 1, F.lit(0))
    chunk = F.least(F.floor((F.col("onset_beat") - F.col("run_start")) / max_beats), last)
    start = F.col("run_start") + F.col("chunk") * max_beats
    return runs.withColumns({"chunk": chunk, "_last": last}).withColumns(
        {"start_beat": start, "end_beat": F.when(F.col("chunk") == F.col("_last"), F.col("run_end")).otherwise(start + max_beats)}
    ).drop("_last")


def phrases(notes: DataFrame, config: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """melid, phrase_id ('phrase-0', ..), run, chunk, start_beat, end_beat, n_notes."""
    chunks = force_split(split_at_rests(notes, config.rest_threshold_beats), config.max_phrase_beats)
    p = chunks.groupBy("melid", "run", "chunk").agg(F.first("start_beat").alias("start_beat"), F.first("end_beat").alias("end_beat"), F.count(F.lit(1)).alias("n_notes"))
    p = p.filter((F.col("end_beat") - F.col("start_beat") >= config.min_phrase_beats) & (F.col("n_notes") >= config.min_phrase_notes))
    if config.skip_first_beats > 0:
        p = p.filter(F.col("start_beat") >= config.skip_first_beats)
    number = F.row_number().over(W.partitionBy("melid").orderBy("start_beat", "run", "chunk")) - 1
    return p.select("melid", F.concat(F.lit("phrase-"), number.cast("string")).alias("phrase_id"), "run", "chunk", "start_beat", "end_beat", "n_notes")


segment_hybrid = phrases


def phrase_notes(notes: DataFrame, config: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """The notes of the phrases, with phrase_id, start_beat and end_beat."""
    chunks = force_split(split_at_rests(notes, config.rest_threshold_beats), config.max_phrase_beats)
    p = phrases(notes, config).select("melid", "run", "chunk", "phrase_id")
    return chunks.join(p, ["melid", "run", "chunk"])


def phrase_iois(members: DataFrame) -> DataFrame:
    """Intervals between onsets of a phrase's neighbouring notes (rests and zeros included)."""
    w = W.partitionBy("melid", "phrase_id").orderBy("onset_beat", "note_idx")
    out = members.withColumn("ioi", F.lead("onset_beat").over(w) - F.col("onset_beat"))
    return out.filter(F.col("ioi").isNotNull()).select("melid", "phrase_id", "note_idx", "ioi")
