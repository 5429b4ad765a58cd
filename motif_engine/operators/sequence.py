"""Operators on the order of notes: slices, the start of a solo, merging, thinning, filters, runs of frequencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motif_engine.functions.transforms import hz_to_midi, midi_to_hz
from motif_engine.operators.features import total_beats as _total_beats


def slice_notes(notes: DataFrame, start: float, end: float) -> DataFrame:
    """Notes with start <= onset < end; onsets stay."""
    return notes.filter((F.col("onset_beat") >= start) & (F.col("onset_beat") < end))


def total_beats(notes: DataFrame) -> DataFrame:
    return notes.groupBy("melid").agg(_total_beats().alias("total_beats"))


def seconds_to_beats(notes: DataFrame, bpm: Column | float) -> DataFrame:
    beat = F.lit(60.0) / (bpm if isinstance(bpm, Column) else F.lit(float(bpm)))
    return notes.withColumns({"onset_beat": F.col("onset_beat") / beat, "duration_beats": F.col("duration_beats") / beat})


def solo_start(notes: DataFrame, window: int = 4, longest: float = 1.0, min_offset: int = 8, min_notes: int = 3) -> DataFrame:
    """melid, start_beat: the first whole beat from min_offset on, before the last onset's whole beat, at which the
    next window beats have min_notes onsets with a median duration below longest; min_offset where none has."""
    last = F.max("onset_beat").over(W.partitionBy("melid"))
    n = notes.withColumn("_last", F.floor(last))
    # a note lies in the windows that start at the whole beats of (onset - window, onset]
    low, high = F.greatest(F.floor(F.col("onset_beat")) - window + 1, F.lit(min_offset)), F.least(F.floor(F.col("onset_beat")), F.col("_last") - 1)
    low = F.when(F.col("onset_beat") == F.floor("onset_beat"), F.greatest(F.col("onset_beat") - window + 1, F.lit(min_offset)).cast("long")).otherwise(low.cast("long"))
    at = n.filter(low <= high).select("melid", "duration_beats", F.explode(F.sequence(low, high.cast("long"))).alias("start"))
    fine = at.groupBy("melid", "start").agg(F.count(F.lit(1)).alias("n"), F.percentile("duration_beats", F.lit(0.5)).alias("median"))
    first = fine.filter((F.col("n") >= min_notes) & (F.col("median") < longest)).groupBy("melid").agg(F.min("start").alias("start"))
    return notes.select("melid").distinct().join(first, "melid", "left").select("melid", F.coalesce("start", F.lit(min_offset)).cast("double").alias("start_beat"))


def from_start(notes: DataFrame, starts: DataFrame, min_notes: int = 4) -> DataFrame:
    """Notes from their solo's start on, counted from it; solos with fewer than min_notes are dropped."""
    n = notes.join(starts, "melid").filter(F.col("onset_beat") >= F.col("start_beat"))
    n = n.withColumn("onset_beat", F.col("onset_beat") - F.col("start_beat")).drop("start_beat")
    return n.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("melid"))).filter(F.col("_n") >= min_notes).drop("_n")


def merge_close_notes(notes: DataFrame, max_gap: float = 0.1, max_pitch_diff: int = 0) -> DataFrame:
    """A note that begins at most max_gap after the merged note before it, at most max_pitch_diff from that one's
    first pitch, extends it. Rests are left out. The fold is one aggregate over each solo's ordered array."""
    note = F.struct("onset_beat", "note_idx", "pitch", "duration_beats", "velocity")
    solos = notes.filter(F.col("pitch").isNotNull()).groupBy("melid").agg(F.sort_array(F.collect_list(note)).alias("notes"))
    kind = "array<struct<onset_beat:double,note_idx:bigint,pitch:int,duration_beats:double,velocity:int>>"
    merged = f"""aggregate(slice(notes, 2, size(notes)), named_struct('done', cast(array() as {kind}), 'last', notes[0]), (a, n) ->
        if(n.onset_beat - (a.last.onset_beat + a.last.duration_beats) <= {float(max_gap)!r}D + 1e-9D and abs(n.pitch - a.last.pitch) <= {int(max_pitch_diff)},
           named_struct('done', a.done, 'last', named_struct('onset_beat', a.last.onset_beat, 'note_idx', a.last.note_idx, 'pitch', a.last.pitch,
                        'duration_beats', (n.onset_beat + n.duration_beats) - a.last.onset_beat, 'velocity', a.last.velocity)),
           named_struct('done', array_append(a.done, a.last), 'last', n)),
        a -> array_append(a.done, a.last))"""
    out = solos.select("melid", F.explode(F.expr(merged)).alias("n"))
    return out.select("melid", "n.note_idx", "n.pitch", "n.onset_beat", "n.duration_beats", "n.velocity")


def thinned(start: np.ndarray, end: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Indices of the events to keep, by start. Events come by start, the stronger first; each is held against the
    first kept one that it overlaps, and of these two the stronger one has that place (the kept one if equal)."""
    kept = np.zeros(len(start), np.int64)
    low, high, n = np.zeros(len(start)), np.zeros(len(start)), 0
    for i in np.lexsort((-strength, start)).tolist():
        over = np.flatnonzero((start[i] < high[:n]) & (end[i] > low[:n]))
        k = int(over[0]) if len(over) else n
        if k == n:
            n += 1
        elif strength[i] <= strength[kept[k]]:
            continue
        kept[k], low[k], high[k] = i, start[i], end[i]
    kept = kept[:n]
    return kept[np.argsort(start[kept], kind="stable")]


def monophonic(notes: DataFrame) -> DataFrame:
    """Keeps one of overlapping notes, see thinned; the order of decisions matters, so each solo is one group."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("note_idx").reset_index(drop=True)
        start = pdf["onset_beat"].to_numpy(float)
        return pdf.iloc[thinned(start, start + pdf["duration_beats"].to_numpy(float), pdf["velocity"].fillna(0).to_numpy(float))]

    slim = notes.select("melid", "note_idx", "pitch", "onset_beat", "duration_beats", F.col("velocity").cast("double").alias("velocity"))
    return slim.groupBy("melid").applyInPandas(one, slim.schema)


def filter_notes(
    notes: DataFrame, min_length: float = 0.0, min_hz: float | None = None, max_hz: float | None = None, min_velocity: float = 0.0
) -> DataFrame:
    """Cuts by length, frequency and raw velocity; velocities up to 1 are then scaled to 0..127."""
    hz = midi_to_hz(F.col("pitch"))
    n = notes.filter(F.col("duration_beats") >= min_length)
    if min_hz is not None:
        n = n.filter(hz >= min_hz)
    if max_hz is not None:
        n = n.filter(hz <= max_hz)
    v = F.col("velocity")
    n = n.filter(v >= min_velocity)
    return n.withColumn("velocity", F.when(v <= 1, F.rint(v * 127)).otherwise(F.rint(v)).cast("int"))


def frequencies_to_notes(frames: DataFrame, min_length_ms: float = 50.0, rate: float = 22050.0, hop: int = 512) -> DataFrame:
    """frames (melid, frame, time, voiced, f0) to notes: runs of voiced frames, with the pitch of the median frequency.

    Runs need max(1, int(min_length_ms / 1000 * rate / hop)) frames, but not the one that reaches the last frame.
    A run ends at the time of the first frame after it, or of the last frame.
    """
    least = max(1, int(min_length_ms / 1000.0 * rate / hop))
    w = W.partitionBy("melid").orderBy("frame")
    sound = F.coalesce(F.col("voiced") & (F.col("f0") > 0), F.lit(False))
    f = frames.withColumn("_on", sound).withColumn("_run", F.sum((~F.col("_on")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    f = f.withColumns({"_next": F.lead("time").over(w)}).filter("_on")
    runs = f.groupBy("melid", "_run").agg(
        F.min("frame").alias("note_idx"), F.min("time").alias("onset_beat"), F.count(F.lit(1)).alias("_n"), F.percentile("f0", F.lit(0.5)).alias("_f0"),
        F.max_by("_next", "frame").alias("_end"), F.max("time").alias("_last"),
    )
    runs = runs.filter((F.col("_n") >= least) | F.col("_end").isNull())
    return runs.select(
        "melid", F.col("note_idx").cast("long").alias("note_idx"), hz_to_midi(F.col("_f0")).alias("pitch"), "onset_beat",
        (F.coalesce("_end", "_last") - F.col("onset_beat")).alias("duration_beats"), F.lit(None).cast("int").alias("velocity"),
    )


def from_detections(
    events: DataFrame, bpm: float = 120.0, keep_polyphonic: bool = False, min_length_ms: float = 50.0, min_hz: float | None = None,
    max_hz: float | None = None, min_velocity: float = 0.0,
) -> DataFrame:
    """Raw detections (onset_beat and duration_beats in seconds, raw velocity) to notes in beats: thinned to one voice,
    filtered, scaled."""
    n = events if keep_polyphonic else monophonic(events)
    return seconds_to_beats(filter_notes(n, min_length_ms / 1000.0, min_hz, max_hz, min_velocity), bpm)


def from_frequencies(frames: DataFrame, bpm: float = 120.0, min_length_ms: float = 50.0, max_gap: float = 0.2, max_pitch_diff: int = 1) -> DataFrame:
    """Frequency frames to notes in beats, with wobbling notes merged; max_gap is in beats."""
    return merge_close_notes(seconds_to_beats(frequencies_to_notes(frames, min_length_ms), bpm), max_gap, max_pitch_diff)
