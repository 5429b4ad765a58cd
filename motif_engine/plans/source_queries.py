"""Queries of the file sources: each writes small files from a driver table, reads them back, and has the same in SQL.

Files go to the shared folder (spark.checkpoint.dir), and to a temporary one where that is unset in local mode.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import io
import json
import shutil
import sqlite3
import tempfile
import uuid
import wave

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from motif_engine.functions import transforms as T
from motif_engine.operators import features as FE
from motif_engine.operators import search as S
from motif_engine.operators import sequence as SEQ
from motif_engine.plans.queries import _NOTES, QUERIES, SQL, _r, _with, query
from motif_engine.schema import to_solos
from motif_engine.sources import events, files, sqlite


@functools.lru_cache(1)
def _local_folder() -> str:
    path = tempfile.mkdtemp(prefix="motif-sources-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _local_folder()
    return f"{base.rstrip('/')}/sources-{uuid.uuid4().hex}"


def _write(spark: SparkSession, path: str, content: bytes) -> None:
    """A file in any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()


def _by_nation(spark: SparkSession, sf: str) -> dict[int, list[int]]:
    """Each nation's customers, in order: the files' notes."""
    out: dict[int, list[int]] = {}
    for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_nationkey", "c_custkey").orderBy("c_custkey").collect():
        out.setdefault(r.c_nationkey, []).append(r.c_custkey)
    return out


_FILE_NOTES = """n AS (SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS melid, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS note_idx,
  CAST(54 + c_custkey % 13 AS INT) AS pitch FROM customer)"""
_FILE_SQL = f"WITH {_FILE_NOTES} SELECT melid, note_idx, pitch, CAST(note_idx AS DOUBLE) AS onset_beat, 1.0::DOUBLE AS duration_beats FROM n"
_NOTE_COLUMNS = ("melid", "note_idx", "pitch", "onset_beat", "duration_beats")
_SHARPS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


@query(_FILE_SQL)
def src_musicxml(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of MusicXML files; one of them can't be parsed and one has a note without an octave, so both are skipped."""
    folder = _folder(spark)
    for nation, customers in _by_nation(spark, sf).items():
        body = []
        for i, c in enumerate(customers):
            pitch = 54 + c % 13
            step = _SHARPS[pitch % 12]
            alter = "<alter>1</alter>" if len(step) > 1 else ""
            head = f'<measure number="{i // 4 + 1}"><attributes><divisions>2</divisions></attributes>' if i % 4 == 0 else ""
            note = f"<note><pitch><step>{step[0]}</step>{alter}<octave>{pitch // 12 - 1}</octave></pitch><duration>2</duration></note>"
            body.append(head + note + ("</measure>" if i % 4 == 3 or i + 1 == len(customers) else ""))
        _write(spark, f"{folder}/nation_{nation}.xml", f'<score-partwise><part id="P1">{"".join(body)}</part></score-partwise>'.encode())
    _write(spark, f"{folder}/broken.xml", b"<score-partwise><part>")
    _write(spark, f"{folder}/no_octave.xml", b'<s><part><measure number="1"><note><pitch><step>C</step></pitch><duration>1</duration></note></measure></part></s>')
    return files.read_musicxml(spark, f"{folder}/*.xml", trim=False)[0].select(*_NOTE_COLUMNS)


@query(_FILE_SQL)
def src_midi(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    for nation, customers in _by_nation(spark, sf).items():
        track = b"".join(bytes([0, 0x90, 54 + c % 13, 64, 0x83, 0x60, 0x80, 54 + c % 13, 0]) for c in customers) + bytes([0, 0xFF, 0x2F, 0])
        head = b"MThd" + (6).to_bytes(4, "big") + bytes([0, 0, 0, 1]) + (480).to_bytes(2, "big")
        _write(spark, f"{folder}/nation_{nation}.mid", head + b"MTrk" + len(track).to_bytes(4, "big") + track)
    _write(spark, f"{folder}/broken.mid", b"RIFF")
    return files.read_midi(spark, f"{folder}/*.mid").select(*_NOTE_COLUMNS)


def _json_solos(spark: SparkSession, sf: str) -> DataFrame:
    folder = _folder(spark)
    for nation, customers in _by_nation(spark, sf).items():
        notes = [{"pitch": 54 + c % 13, "onset_beat": float(i), "duration_beats": 1.0} for i, c in enumerate(customers)]
        _write(spark, f"{folder}/nation_{nation}.json", json.dumps({"notes": notes, "tempo_bpm": 90 + nation, "time_signature": [3, 4]}, indent=1).encode())
    return files.read_json(spark, f"{folder}/*.json")


@query(_FILE_SQL)
def src_json(spark: SparkSession, sf: str) -> DataFrame:
    return _json_solos(spark, sf).select("melid", F.explode("notes").alias("n")).select("melid", "n.note_idx", "n.pitch", "n.onset_beat", "n.duration_beats")


@query(
    f"""WITH {_FILE_NOTES} SELECT melid, count(*) AS n_notes, CAST(sum(pitch) AS BIGINT) AS pitches, CAST(90 + CAST(substr(melid, 8) AS INT) AS DOUBLE) AS tempo_bpm,
    3 AS ts_num, 4 AS ts_den FROM n GROUP BY melid"""
)
def sink_json(spark: SparkSession, sf: str) -> DataFrame:
    """Solos written as lines of JSON and read back."""
    path = _folder(spark)
    files.write_json(_json_solos(spark, sf), path)
    kind = "melid string, notes array<struct<onset_beat:double,note_idx:bigint,pitch:int>>, tempo_bpm double, ts_num int, ts_den int"
    pitches = F.aggregate("notes", F.lit(0).cast("long"), lambda a, n: a + n["pitch"])
    return spark.read.schema(kind).json(path).select("melid", F.size("notes").cast("long").alias("n_notes"), pitches.alias("pitches"), "tempo_bpm", "ts_num", "ts_den")


def _wav_folder(spark: SparkSession, sf: str) -> str:
    folder = _folder(spark)
    for nation, customers in _by_nation(spark, sf).items():
        held = io.BytesIO()
        with wave.open(held, "wb") as w:
            w.setnchannels(1), w.setsampwidth(2), w.setframerate(8000 + nation)
            w.writeframes(np.array([c * 37 % 65536 - 32768 for c in customers], "<i2").tobytes())
        _write(spark, f"{folder}/nation_{nation}.wav", held.getvalue())
    return folder


@query(
    """SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS melid, CAST(8000 + c_nationkey AS INT) AS rate, count(*) AS n,
    round(sum((c_custkey * 37 % 65536 - 32768) / 32768.0::DOUBLE), 6) AS total FROM customer GROUP BY c_nationkey"""
)
def src_wav(spark: SparkSession, sf: str) -> DataFrame:
    found = files.read_wav(spark, f"{_wav_folder(spark, sf)}/*.wav")
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select("melid", "rate", F.size("samples").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query(
    """WITH t AS (SELECT 'SQLite format 3' || string_agg(r_name, '|' ORDER BY r_regionkey) AS x FROM region)
    SELECT 'db' AS name, true AS present, 1 AS file_count, length(x) AS size_bytes, true AS is_sqlite, sha256(x) AS sha256, true AS verified FROM t
    UNION ALL SELECT 'gone', false, 0, 0, false, NULL, false
    UNION ALL SELECT 'wavs', true, count(DISTINCT c_nationkey), 44 * count(DISTINCT c_nationkey) + 2 * count(*), false, NULL, NULL FROM customer"""
)
def data_status(spark: SparkSession, sf: str) -> DataFrame:
    import hashlib

    names = [r.r_name for r in spark.read.parquet(f"{sf}/region.parquet").orderBy("r_regionkey").select("r_name").collect()]
    content, folder = b"SQLite format 3" + "|".join(names).encode(), _folder(spark)
    _write(spark, f"{folder}/x.db", content)
    paths = {"db": f"{folder}/x.db", "gone": f"{folder}/nothing/*.xml", "wavs": f"{_wav_folder(spark, sf)}/*.wav"}
    return files.data_status(spark, paths, {"db": hashlib.sha256(content).hexdigest(), "gone": "0" * 64})


def _database(spark: SparkSession, sf: str) -> str:
    """A solo database: customers as solos, events as their melodies in seconds."""
    folder = _folder(spark).removeprefix("file://")
    if "://" in folder:
        raise RuntimeError("a SQLite file needs a folder that is mounted")
    import os

    os.makedirs(folder)
    path = f"{folder}/solos.db"
    with contextlib.closing(sqlite3.connect(path)) as c:
        c.executescript("""
        CREATE TABLE solo_info (melid INTEGER, performer TEXT, title TEXT, titleaddon TEXT, instrument TEXT, style TEXT, avgtempo REAL, tempoclass TEXT, key TEXT, signature TEXT, chorus_count INTEGER, compid INTEGER, recordid INTEGER);
        CREATE TABLE melody (melid INTEGER, onset REAL, pitch REAL, duration REAL);
        CREATE TABLE composition_info (compid INTEGER, composer TEXT, form TEXT);
        CREATE TABLE record_info (recordid INTEGER, artist TEXT, recordtitle TEXT, releasedate TEXT);
        INSERT INTO composition_info VALUES (3, 'C', 'AABA');
        INSERT INTO record_info VALUES (5, 'A', 'R', '1959-08-17');""")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    fixed = {"instrument": "ts", "style": "BOP", "avgtempo": 90.0, "tempoclass": "UP", "key": "C", "signature": "3/4", "chorus_count": 2}
    solos = spark.read.parquet(f"{sf}/customer.parquet").select(
        key.alias("melid"), F.col("c_name").alias("performer"), F.lit("T").alias("title"), key.cast("string").alias("titleaddon"),
        *[F.lit(v).alias(k) for k, v in fixed.items()], nation.alias("compid"), nation.alias("recordid"),
    )
    notes = events.notes(spark, sf).select(
        F.substring("melid", 4, 20).cast("long").alias("melid"), F.col("onset_beat").alias("onset"), F.coalesce("pitch", F.lit(0)).cast("double").alias("pitch"), F.col("duration_beats").alias("duration")
    )
    sqlite.write_table(solos, path, "solo_info")
    sqlite.write_table(notes, path, "melody")
    return path


_SOLO_NOTES = """s AS (SELECT user_id, 'wjazzd-' || CAST(user_id AS VARCHAR) AS melid, pitch, onset_beat / (60.0::DOUBLE / 90.0::DOUBLE) AS o, duration_beats / (60.0::DOUBLE / 90.0::DOUBLE) AS d
  FROM notes JOIN events ON note_idx = event_id WHERE pitch IS NOT NULL), k AS (SELECT melid, count(*) AS n_notes, round(sum(o), 4) AS onsets, round(sum(d), 4) AS durations FROM s GROUP BY melid HAVING count(*) >= 4)"""
_META = "'wjazzd-' || CAST(c_custkey AS VARCHAR) AS melid, c_name AS performer, 'T ' || CAST(c_custkey AS VARCHAR) AS title, CASE WHEN c_nationkey = 5 THEN 1959 END AS year, CASE WHEN c_nationkey = 3 THEN 'AABA' END AS form"


def _totals(notes: DataFrame, meta: DataFrame) -> DataFrame:
    sums = notes.groupBy("melid").agg(F.count(F.lit(1)).alias("n_notes"), F.round(F.sum("onset_beat"), 4).alias("onsets"), F.round(F.sum("duration_beats"), 4).alias("durations"))
    return meta.select("melid", "performer", "title", "year", F.col("extra")["form"].alias("form")).join(sums, "melid", "left")


@query(_with(f"{_SOLO_NOTES}, m AS (SELECT {_META} FROM customer) SELECT m.*, n_notes, onsets, durations FROM m LEFT JOIN k ON m.melid = k.melid"))
def src_sqlite_solos(spark: SparkSession, sf: str) -> DataFrame:
    """A whole solo database file: joins, beats, and the least number of notes."""
    return _totals(*sqlite.read_solo_database(spark, _database(spark, sf), partitions=4))


@query(_with(f"{_SOLO_NOTES}, m AS (SELECT {_META} FROM customer) SELECT m.*, n_notes, onsets, durations FROM m JOIN k ON m.melid = k.melid WHERE m.melid = 'wjazzd-7'"))
def src_sqlite_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One solo by its key, which goes into the file's own queries."""
    one = sqlite.solo_corpus(spark, _database(spark, sf)).lookup("wjazzd-7")
    return _totals(*one).filter("n_notes is not null")


@query(
    """SELECT user_id AS melid, count(*) AS n, round(sum(0.25 + value / 5.0), 4) AS durations FROM events
    WHERE user_id >= 5 AND user_id < 12 AND event_type <> 'error' GROUP BY user_id"""
)
def src_sqlite_scan(spark: SparkSession, sf: str) -> DataFrame:
    """A table in four parts, with range filters that go into the file's own queries."""
    t = sqlite.read_table(spark, _database(spark, sf), "melody", partitions="4", partition_column="melid")
    t = t.filter((F.col("melid") >= 5) & (F.col("melid") < 12) & (F.col("pitch") > 0))
    return t.groupBy("melid").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration"), 4).alias("durations"))


@query("SELECT (SELECT count(*) FROM customer) AS solos, (SELECT count(*) FROM events) AS notes")
def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    corpus = events.corpus(spark, sf)
    return spark.createDataFrame([Row(solos=len(corpus), notes=corpus.total_notes())], "solos long, notes long")


@query(_with("x AS (SELECT 1) SELECT notes.melid, any_value(performer) AS performer, count(*) AS n_notes, round(max(onset_beat), 6) AS last FROM notes JOIN meta ON notes.melid = meta.melid WHERE notes.melid = 'ev-7' GROUP BY notes.melid"))
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """One solo by its key; the scan of the notes is filtered by user."""
    last = F.array_max(F.transform("notes", lambda n: n["onset_beat"]))
    return events.corpus(spark, sf).get("ev-7").select("melid", "performer", F.size("notes").cast("long").alias("n_notes"), _r(last).alias("last"))


def _fails(function, *args: object, **kw: object) -> bool:
    try:
        function(*args, **kw)
    except ValueError:
        return True
    return False


@query(
    """SELECT n_nationkey, n_nationkey BETWEEN 2 AND 20 AS pattern_fine, n_nationkey BETWEEN 1 AND 500 AS limit_fine, n_nationkey <= 5 AS length_fine,
    n_nationkey / 20.0::DOUBLE BETWEEN 0.5 AND 1 AS similarity_fine, n_nationkey >= 2 AS text_fine, CASE WHEN n_nationkey >= 2 THEN CAST(n_nationkey * (n_nationkey - 1) // 2 AS BIGINT) END AS text_sum,
    n_nationkey % 2 = 0 AS suffix_fine FROM nation"""
)
def request_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What requests, pattern texts and file names are refused, for numbers from the nations' keys."""
    rows = []
    for r in spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey").collect():
        k = r.n_nationkey
        ask = lambda **kw: not _fails(lambda: S.SearchRequest(**({"pattern": [1, 2]} | kw)).validate())
        text = ", ".join(map(str, range(k)))
        parsed = None if _fails(T.parse_pattern, text) else sum(T.parse_pattern(text))
        suffix = not _fails(files.read_transcription, spark, f"{_folder(spark)}/x.{'json' if k % 2 == 0 else 'wav'}") if k % 2 else True
        rows.append((k, ask(pattern=list(range(k))), ask(limit=k), ask(max_length_difference=k), ask(min_similarity=k / 20.0), parsed is not None, parsed, suffix))
    return spark.createDataFrame(rows, "n_nationkey long, pattern_fine boolean, limit_fine boolean, length_fine boolean, similarity_fine boolean, text_fine boolean, text_sum long, suffix_fine boolean")


@query(_with("x AS (SELECT 1) SELECT melid, round(avg(pitch), 6) AS mean_pitch FROM notes GROUP BY melid"))
def own_feature(spark: SparkSession, sf: str) -> DataFrame:
    """A feature function of the user's own, by solo."""
    FE.register("mean_pitch", lambda pdf: float(pdf["pitch"].mean()), "double")
    return FE.GROUPED["mean_pitch"](events.notes(spark, sf)).select("melid", _r("values").alias("mean_pitch"))


@query(SQL["solo_start"].replace("SELECT e.melid, CAST(coalesce(b.start, 8) AS DOUBLE) AS start_beat", "SELECT melid, note_idx, CAST(round((onset_beat - start_beat) * 3600000000.0::DOUBLE) AS BIGINT) AS micros FROM (SELECT notes.melid, note_idx, onset_beat, start_beat, count(*) OVER (PARTITION BY notes.melid) AS n FROM notes JOIN (SELECT e.melid, CAST(coalesce(b.start, 8) AS DOUBLE) AS start_beat") + ") z ON z.melid = notes.melid WHERE onset_beat >= start_beat) y WHERE n >= 4")
def rebase_from_start(spark: SparkSession, sf: str) -> DataFrame:
    n = events.notes(spark, sf)
    # beats are hours here, and times whole microseconds: rounded to these they have no ties
    return SEQ.from_start(n, SEQ.solo_start(n, window=12, longest=6.0)).select("melid", "note_idx", F.round(F.col("onset_beat") * F.lit(3600000000.0)).cast("long").alias("micros"))


# SQL of the folds whose steps depend on those before

SQL["merge_close_notes_drift"] = f"""WITH RECURSIVE {_NOTES},
o AS (SELECT *, row_number() OVER (PARTITION BY melid ORDER BY onset_beat, note_idx) AS k FROM notes WHERE pitch IS NOT NULL),
r AS (SELECT melid, k, note_idx, pitch, onset_beat AS s, duration_beats AS d FROM o WHERE k = 1
  UNION ALL SELECT o.melid, o.k, CASE WHEN m THEN r.note_idx ELSE o.note_idx END, CASE WHEN m THEN r.pitch ELSE o.pitch END, CASE WHEN m THEN s ELSE onset_beat END, CASE WHEN m THEN onset_beat + duration_beats - s ELSE duration_beats END
  FROM r JOIN o ON o.melid = r.melid AND o.k = r.k + 1, LATERAL (SELECT onset_beat - (s + d) <= 20.0::DOUBLE + 1e-9::DOUBLE AND abs(o.pitch - r.pitch) <= 1 AS m))
SELECT melid, note_idx, any_value(pitch) AS pitch, round(any_value(s), 6) AS onset_beat, round(arg_max(d, k), 6) AS duration_beats FROM r GROUP BY melid, note_idx"""
SQL["monophonic_greedy"] = f"""WITH RECURSIVE {_NOTES},
e AS (SELECT melid, note_idx, pitch, onset_beat AS s, onset_beat + duration_beats AS t, (note_idx * 37 % 100) / 100.0::DOUBLE AS v FROM notes WHERE pitch IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY melid ORDER BY s, v DESC, note_idx) AS k FROM e),
r AS (SELECT melid, k, [struct_pack(s := s, t := t, v := v, i := note_idx)] AS kept FROM o WHERE k = 1
  UNION ALL SELECT o.melid, o.k, CASE WHEN p IS NULL THEN list_append(kept, struct_pack(s := o.s, t := o.t, v := o.v, i := o.note_idx)) WHEN o.v <= kept[p].v THEN kept
    ELSE list_concat(list_append(kept[: p - 1], struct_pack(s := o.s, t := o.t, v := o.v, i := o.note_idx)), kept[p + 1 :]) END
  FROM r JOIN o ON o.melid = r.melid AND o.k = r.k + 1, LATERAL (SELECT list_position(list_transform(r.kept, lambda x: o.s < x.t AND o.t > x.s), true) AS p)),
f AS (SELECT melid, unnest(arg_max(kept, k)) AS x FROM r GROUP BY melid)
SELECT f.melid, x.i AS note_idx, pitch, round(x.s, 6) AS onset_beat, x.v AS velocity FROM f JOIN notes ON notes.note_idx = x.i"""
