"""Tables of the engine, and checks of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOTES = "melid string, note_idx long, pitch int, onset_beat double, duration_beats double, velocity int"
NOTE = "struct<note_idx:bigint,pitch:int,onset_beat:double,duration_beats:double,velocity:int>"
SOLOS = (
    "melid string, title string, performer string, recording_year int, track_year int, instrument string, key string, tempo_bpm int,"
    " style string, source_corpus string, audio_url string, extra map<string,string>"
)


class CorpusError(RuntimeError):
    """A corpus can't be loaded."""


def validate_notes(notes: DataFrame, mode: str = "raise") -> DataFrame:
    """Notes need a pitch of 0..127 or none (a rest), and a duration over 0.

    mode 'raise' fails the job at the first bad note, 'drop' removes bad notes.
    """
    good = (F.col("pitch").isNull() | F.col("pitch").between(0, 127)) & (F.col("duration_beats") > 0) & F.col("onset_beat").isNotNull()
    good = F.coalesce(good, F.lit(False))
    if mode == "drop":
        return notes.filter(good)
    if mode != "raise":
        raise ValueError(f"mode is 'raise' or 'drop', not {mode!r}")
    bad = F.concat(F.lit("bad note in "), F.coalesce("melid", F.lit("?")), F.lit(" at "), F.coalesce(F.col("onset_beat").cast("string"), F.lit("?")))
    return notes.filter(F.when(good, F.lit(True)).otherwise(F.raise_error(bad).cast("boolean")))  # a filter isn't pruned


def to_solos(notes: DataFrame) -> DataFrame:
    """Flat notes to one row per solo: melid, notes (by onset, then note_idx)."""
    note = F.struct("onset_beat", "note_idx", "pitch", "duration_beats", "velocity")
    ordered = F.sort_array(F.collect_list(note))
    back = F.transform(ordered, lambda n: F.struct(n["note_idx"].alias("note_idx"), n["pitch"].alias("pitch"), n["onset_beat"].alias("onset_beat"), n["duration_beats"].alias("duration_beats"), n["velocity"].alias("velocity")))
    return notes.groupBy("melid").agg(back.alias("notes"))


def to_notes(solos: DataFrame) -> DataFrame:
    """The inverse of to_solos."""
    return solos.select("melid", F.explode("notes").alias("n")).select("melid", "n.*")
