"""Notes from files: JSON, MusicXML, MIDI, result pages in HTML, and the state of data files."""

from __future__ import annotations

import io
import struct
import wave
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motif_engine.operators.sequence import from_start, solo_start
from motif_engine.schema import NOTES, CorpusError, validate_notes

_JSON = "notes array<struct<pitch:int,onset_beat:double,duration_beats:double,velocity:int>>, tempo_bpm double, time_signature array<int>, key_signature string"


def read_json(spark: SparkSession, path: str, tempo_bpm: float = 120.0) -> DataFrame:
    """One row per file: melid (its name), notes ordered by onset, tempo_bpm, ts_num, ts_den, key_signature."""
    raw = spark.read.schema(_JSON).json(path, multiLine=True).withColumn("melid", _stem(F.input_file_name()))
    numbered = F.transform("notes", lambda n, i: F.struct(n["onset_beat"].alias("onset_beat"), i.cast("long").alias("note_idx"), n["pitch"].alias("pitch"), n["duration_beats"].alias("duration_beats"), n["velocity"].alias("velocity")))
    signature = F.col("time_signature")
    return raw.select(
        "melid", F.sort_array(numbered).alias("notes"), F.coalesce("tempo_bpm", F.lit(tempo_bpm)).alias("tempo_bpm"),
        F.coalesce(F.get(signature, F.lit(0)), F.lit(4)).alias("ts_num"), F.coalesce(F.get(signature, F.lit(1)), F.lit(4)).alias("ts_den"), "key_signature",
    )


def write_json(solos: DataFrame, path: str) -> None:
    """One line per solo."""
    solos.write.json(path)


def _stem(path: Column) -> Column:
    name = F.url_decode(F.element_at(F.split(path, "/"), -1))
    return F.regexp_replace(name, r"\.[^.]*$", "")


_STEP = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def parse_musicxml(content: bytes) -> list[tuple[float, float, int]] | None:
    """(onset, duration, pitch) in quarter beats of the second part, or the only one; None if it can't be read.

    A measure is four beats. Chord symbols are no notes; of notes that sound together the highest counts.
    """
    try:
        return _musicxml_notes(ET.parse(io.BytesIO(content)).getroot())
    except (ET.ParseError, ValueError, AttributeError, KeyError, TypeError, ZeroDivisionError):  # not XML, or a note without what a note needs
        return None


def _musicxml_notes(root: ET.Element) -> list[tuple[float, float, int]] | None:
    parts = [e for e in root.iter() if e.tag.rpartition("}")[2] == "part"]
    if not parts:
        return None
    name = lambda e: e.tag.rpartition("}")[2]
    child = lambda e, tag: next((c for c in e if name(c) == tag), None)
    out: list[tuple[float, float, int]] = []
    divisions = 1.0
    for measure in (m for m in parts[1 if len(parts) > 1 else 0] if name(m) == "measure"):
        digits = "".join(c for c in measure.get("number", "") if c.isdigit())
        if not digits or not int(digits):
            continue
        base, at, chord_at = (int(digits) - 1) * 4.0, 0.0, None
        for e in measure:
            kind = name(e)
            length = float(getattr(child(e, "duration"), "text", 0) or 0) / divisions if kind in ("note", "backup", "forward") else 0.0
            if kind == "attributes" and child(e, "divisions") is not None:
                divisions = float(child(e, "divisions").text)
            elif kind == "backup":
                at -= length
            elif kind == "forward":
                at += length
            elif kind == "note" and child(e, "grace") is None:
                pitch = child(e, "pitch")
                together = child(e, "chord") is not None and chord_at is not None
                onset = chord_at if together else at
                if pitch is not None:
                    alter = float(getattr(child(pitch, "alter"), "text", 0) or 0)
                    midi = int(12 * (int(child(pitch, "octave").text) + 1) + _STEP[child(pitch, "step").text] + alter)
                    if together and out and out[-1][0] == base + onset:
                        out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], midi))
                    else:
                        out.append((base + onset, length, midi))
                if not together:
                    chord_at, at = at, at + length
    return out


def _note_files(spark: SparkSession, path: str, parse) -> DataFrame:
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for melid, content in zip(pdf["melid"], pdf["content"], strict=True):
                got = parse(content) or []
                yield pd.DataFrame(
                    {"melid": melid, "note_idx": range(len(got)), "pitch": [p for _, _, p in got], "onset_beat": [o for o, _, _ in got],
                     "duration_beats": [d for _, d, _ in got], "velocity": pd.array([None] * len(got), "Int32")}
                )

    files = spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("melid"), "content")
    return files.mapInPandas(rows, NOTES)


def read_musicxml(spark: SparkSession, path: str, trim: bool = True, bad_notes: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(notes, metadata) of a folder or glob of MusicXML files; trim drops what stands before the solo's start.

    Files that can't be read are skipped; bad_notes is validate_notes' mode.
    """
    notes = validate_notes(_note_files(spark, path, parse_musicxml), bad_notes)
    if trim:
        notes = from_start(notes, solo_start(notes))
    meta = notes.select("melid").distinct().select(
        "melid", F.translate("melid", "_", " ").alias("title"), F.lit("Charlie Parker").alias("performer"), F.lit(None).cast("int").alias("year"),
        F.lit("alto saxophone").alias("instrument"),
    )
    return notes, meta


def parse_midi(content: bytes) -> list[tuple[float, float, int]] | None:
    """(onset, duration, pitch) in beats of all notes of a standard MIDI file; None if it isn't one."""
    try:
        kind, size, _, tracks, division = struct.unpack_from(">4sIHHH", content)
        if kind != b"MThd" or division & 0x8000:
            return None
        at, out = 8 + size, []
        for _ in range(tracks):
            chunk, size = struct.unpack_from(">4sI", content, at)
            at, end = at + 8, at + 8 + size
            tick, status, open_notes = 0, 0, {}
            while at < end and chunk == b"MTrk":
                delta = 0
                while True:
                    byte = content[at]
                    at += 1
                    delta = delta << 7 | byte & 0x7F
                    if byte < 0x80:
                        break
                tick += delta
                if content[at] >= 0x80:
                    status = content[at]
                    at += 1
                if status in (0xF0, 0xF7, 0xFF):
                    at += status == 0xFF
                    size = 0
                    while True:
                        byte = content[at]
                        at += 1
                        size = size << 7 | byte & 0x7F
                        if byte < 0x80:
                            break
                    at += size
                    continue
                event, key = status & 0xF0, (status & 0x0F, content[at])
                velocity = 0 if event in (0xC0, 0xD0) else content[at + 1]
                at += 1 if event in (0xC0, 0xD0) else 2
                if event == 0x90 and velocity:
                    open_notes.setdefault(key, []).append(tick)
                elif event in (0x80, 0x90) and open_notes.get(key):
                    start = open_notes[key].pop(0)
                    out.append((start / division, (tick - start) / division, key[1]))
            at = end
        return sorted(out)
    except (IndexError, struct.error):
        return None


def read_midi(spark: SparkSession, path: str) -> DataFrame:
    return _note_files(spark, path, parse_midi)


def _pcm(raw: bytes, width: int) -> np.ndarray:
    """Samples of 1 (unsigned), 2, 3 or 4 bytes as -1..1."""
    if width == 1:
        return np.frombuffer(raw, np.uint8) / 128.0 - 1.0
    if width == 3:
        padded = np.zeros((len(raw) // 3, 4), np.uint8)
        padded[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        return padded.view("<i4")[:, 0] / 2.0**31
    return np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """One row per PCM file: melid, rate, samples (mono, -1..1); files of another kind have null samples."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for melid, content in zip(pdf["melid"], pdf["content"], strict=True):
                rate, samples = None, None
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rate = w.getframerate()
                        x = _pcm(w.readframes(w.getnframes()), w.getsampwidth()).reshape(-1, w.getnchannels())
                        samples = x.mean(axis=1).astype(np.float32)
                except (wave.Error, EOFError):
                    pass
                yield pd.DataFrame({"melid": [melid], "rate": pd.array([rate], "Int32"), "samples": [samples]})

    files = spark.read.format("binaryFile").load(path).select(_stem(F.col("path")).alias("melid"), "content")
    return files.mapInPandas(rows, "melid string, rate int, samples array<float>")


def read_transcription(spark: SparkSession, path: str) -> DataFrame:
    """Notes of a file by its suffix: .json, .mid or .midi, .xml or .musicxml."""
    suffix = path.rpartition(".")[2].lower()
    if suffix == "json":
        return read_json(spark, path).select("melid", F.explode("notes").alias("n")).select("melid", "n.note_idx", "n.pitch", "n.onset_beat", "n.duration_beats", "n.velocity")
    if suffix in ("mid", "midi"):
        return read_midi(spark, path)
    if suffix in ("xml", "musicxml"):
        return read_musicxml(spark, path, trim=False)[0]
    raise ValueError(f"unsupported file format: .{suffix}")


#: Fixed order of the result table's columns.
RESULT_COLUMNS = (
    "database", "melid", "ngram", "frequency", "length", "performer", "title", "year", "instrument", "start_position", "duration",
    "pitch_range", "contour", "similarity", "edit_distance",
)


def parse_result_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """The rows of result tables in pages: kept columns of pages, and the table's. Malformed rows are skipped."""
    keep = [c for c in pages.columns if c != html]
    rows = pages.select(*keep, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "tr"))
    cells = F.regexp_extract_all("tr", F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " ")))
    rows = rows.select(*keep, "row_no", clean.alias("c")).filter(F.size("c") >= len(RESULT_COLUMNS))
    cell = {name: F.col("c")[i] for i, name in enumerate(RESULT_COLUMNS)}
    digits = cell["year"].rlike("^[0-9]+$")
    out = rows.select(
        *keep, "row_no", cell["database"].alias("database"), cell["melid"].alias("melid"), cell["frequency"].try_cast("int").alias("frequency"),
        cell["performer"].alias("performer"), cell["title"].alias("title"), F.when(digits, cell["year"].try_cast("int")).alias("year"),
        cell["instrument"].alias("instrument"), cell["start_position"].try_cast("double").alias("start_position"), cell["duration"].try_cast("double").alias("duration"),
        cell["similarity"].try_cast("double").alias("similarity"), cell["edit_distance"].try_cast("int").alias("edit_distance"),
    )
    return out.filter(F.col("frequency").isNotNull() & F.col("similarity").isNotNull() & F.col("edit_distance").isNotNull())


def default_edit_cap(n: int, min_similarity: float) -> int:
    """The cap that a remote search sends where none is given."""
    return max(1, n - int(n * min_similarity))


def data_status(spark: SparkSession, paths: dict[str, str], expected: dict[str, str] | None = None) -> DataFrame:
    """name, present, file_count, size_bytes, is_sqlite, sha256 (of a single file) for each data file or folder glob.

    verified: whether the file has the expected SHA-256 (hex, by name); null where none is expected.
    """
    expected = expected or {}
    out = None
    for name, path in sorted(paths.items()):
        try:
            files = spark.read.format("binaryFile").load(path)
        except Exception as e:  # Spark has one type for this and many other failures
            if "PATH_NOT_FOUND" not in str(e):
                raise CorpusError(str(e)) from e
            files = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
        one = files.agg(
            F.count(F.lit(1)).alias("file_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"),
            F.coalesce(F.bool_and(F.substring("content", 1, 15) == F.lit(b"SQLite format 3")), F.lit(False)).alias("is_sqlite"),
            F.when(F.count(F.lit(1)) == 1, F.first(F.sha2("content", 256))).alias("sha256"),
        )
        verified = F.coalesce(F.col("sha256") == expected[name].lower(), F.lit(False)) if name in expected else F.lit(None).cast("boolean")
        one = one.select(F.lit(name).alias("name"), (F.col("file_count") > 0).alias("present"), "*", verified.alias("verified"))
        out = one if out is None else out.unionByName(one)
    return out


def numbered(notes: DataFrame) -> DataFrame:
    """Gives notes that have no note_idx one by onset and pitch."""
    w = W.partitionBy("melid").orderBy("onset_beat", "pitch")
    return notes.withColumn("note_idx", F.row_number().over(w) - 1)
