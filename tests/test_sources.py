import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from motif_engine.schema import NOTES, CorpusError, validate_notes
from motif_engine.sources import files, sqlite
from motif_engine.streaming.phrases import live_phrases

XML = """<score-partwise><part id="P1"><measure number="1"><note><pitch><step>C</step><octave>2</octave></pitch><duration>4</duration></note></measure></part>
<part id="P2"><measure number="0"><note><pitch><step>C</step><octave>4</octave></pitch><duration>4</duration></note></measure>
<measure number="3"><attributes><divisions>2</divisions></attributes><harmony><root><root-step>C</root-step></root></harmony>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration></note><note><chord/><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration></note>
<note><rest/><duration>1</duration></note><note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>3</duration></note></measure></part></score-partwise>"""


def test_musicxml(spark, tmp_path):
    (tmp_path / "A_tune.xml").write_text(XML)
    (tmp_path / "bad.xml").write_text("<score")
    for name, note in {"no_octave": "<pitch><step>C</step></pitch>", "no_step": "<pitch><octave>4</octave></pitch>", "bad_step": "<pitch><step>H</step><octave>4</octave></pitch>", "bad_octave": "<pitch><step>C</step><octave>x</octave></pitch>"}.items():
        (tmp_path / f"{name}.xml").write_text(f"<s><part><measure number='1'><note>{note}<duration>1</duration></note></measure></part></s>")
    n, meta = files.read_musicxml(spark, f"{tmp_path}/*.xml", trim=False)
    assert [(r.melid, r.pitch, r.onset_beat, r.duration_beats) for r in n.orderBy("onset_beat").collect()] == [("A_tune", 64, 8.0, 1.0), ("A_tune", 66, 9.5, 1.5)]
    assert [r.title for r in meta.collect()] == ["A tune"]
    assert files.parse_musicxml(b"") is None and files.parse_musicxml(b"<a/>") is None


def test_midi(spark, tmp_path):
    track = bytes([0, 0xFF, 0x51, 3, 7, 0xA1, 0x20, 0, 0x90, 60, 64, 96, 0x80, 60, 0, 0, 0x90, 62, 64, 0x81, 0x40, 62, 0, 0, 0xFF, 0x2F, 0])
    (tmp_path / "x.mid").write_bytes(b"MThd" + (6).to_bytes(4) + bytes([0, 0, 0, 1, 0, 96]) + b"MTrk" + len(track).to_bytes(4) + track)
    got = files.read_transcription(spark, f"{tmp_path}/x.mid").orderBy("onset_beat").collect()
    assert [(r.pitch, r.onset_beat, r.duration_beats) for r in got] == [(60, 0.0, 1.0), (62, 1.0, 2.0)]
    assert files.parse_midi(b"RIFF") is None
    with pytest.raises(ValueError):
        files.read_transcription(spark, "x.wav")


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"notes": [{"pitch": 62, "onset_beat": 1, "duration_beats": 1}, {"onset_beat": 0, "duration_beats": 1, "velocity": 9}], "time_signature": [3, 4]}, indent=1))
    r = files.read_json(spark, f"{tmp_path}/a.json").first()
    assert (r.melid, r.tempo_bpm, r.ts_num, r.ts_den, r.key_signature) == ("a", 120.0, 3, 4, None)
    assert [(n.pitch, n.onset_beat, n.velocity) for n in r.notes] == [(None, 0.0, 9), (62, 1.0, None)]
    with pytest.raises(Exception, match="bad note"):
        validate_notes(spark.createDataFrame([("a", 0, 200, 0.0, 1.0, None)], NOTES)).select("melid").collect()
    files.write_json(files.read_json(spark, f"{tmp_path}/a.json"), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1


@pytest.fixture
def database(tmp_path):
    path = str(tmp_path / "solos.db")
    with sqlite3.connect(path) as c:
        c.executescript("""
        CREATE TABLE solo_info (melid INTEGER, performer TEXT, title TEXT, titleaddon TEXT, instrument TEXT, style TEXT, avgtempo REAL, tempoclass TEXT, key TEXT, signature TEXT, chorus_count INTEGER, compid INTEGER, recordid INTEGER);
        CREATE TABLE melody (melid INTEGER, onset REAL, pitch REAL, duration REAL);
        CREATE TABLE composition_info (compid INTEGER, composer TEXT, form TEXT);
        CREATE TABLE record_info (recordid INTEGER, artist TEXT, recordtitle TEXT, releasedate TEXT);
        INSERT INTO solo_info VALUES (1, 'P', 'T', NULL, 'ts', 'BOP', 60, 'SLOW', 'C', '3/4', 2, 7, 8), (2, NULL, NULL, 'x', 'xx', NULL, 0, NULL, NULL, NULL, 1, 99, 98), (3, 'Q', 'U', '2', NULL, NULL, NULL, NULL, NULL, NULL, 1, NULL, NULL);
        INSERT INTO composition_info VALUES (7, 'C', 'AABA'), (7, 'C', 'AABA');
        INSERT INTO record_info VALUES (8, 'A', 'R', '1959-08-17');""")
        c.executemany("INSERT INTO melody VALUES (?, ?, ?, ?)", [(m, float(i), 60.5 + i if i else 0.0, 0.5) for m, n in ((1, 6), (2, 5), (3, 3)) for i in range(n)])
    return path


@pytest.mark.parametrize("partitions", [1, 3])
def test_solo_database(spark, database, partitions):
    notes, meta = sqlite.read_solo_database(spark, database, partitions)
    m = {r.melid: r for r in meta.collect()}
    assert set(m) == {"wjazzd-1", "wjazzd-2", "wjazzd-3"}
    corpus = sqlite.solo_corpus(spark, database, partitions)
    assert len(corpus) == 3 and {r.melid for r in corpus.solos().collect()} == {"wjazzd-1", "wjazzd-2"}
    assert [len(r.notes) for r in corpus.get("wjazzd-1").collect()] == [5] and corpus.get("wjazzd-9").count() == 0 and corpus.get("x").count() == 0
    a, b = m["wjazzd-1"], m["wjazzd-2"]
    assert (a.title, a.recording_year, a.instrument, a.tempo_bpm, a.ts_num, a.ts_den, a.extra["form"]) == ("T", 1959, "Tenor saxophone", 60, 3, 4, "AABA")
    assert (b.title, b.performer, b.instrument, b.tempo_bpm, b.recording_year) == ("Unknown", "Unknown", "xx", None, None)
    n = [(r.pitch, r.onset_beat) for r in notes.filter("melid = 'wjazzd-2'").orderBy("onset_beat").collect()]
    assert n == [(62, 2.0), (62, 4.0), (64, 6.0), (64, 8.0)]


def test_sqlite_filters_and_errors(spark, database):
    t = sqlite.read_table(spark, database, "melody")
    assert t.filter("melid = 1 AND onset >= 2").count() == 4 and t.filter("melid = 9").count() == 0
    with pytest.raises(CorpusError):
        sqlite.read_solo_database(spark, database + "x")


def test_sqlite_write(spark, tmp_path):
    path = str(tmp_path / "w.db")
    with sqlite3.connect(path) as c:
        c.execute('CREATE TABLE "a b" (k INTEGER, "x ""y" REAL, t TEXT)')
    rows = [(i, None if i % 3 == 0 else i / 7, None if i % 5 == 0 else f"n'{i}") for i in range(25_000)]
    df = spark.createDataFrame([*rows, (None, None, None)], 'k long, `x "y` double, t string').repartition(7)
    assert [sqlite.write_table(df, path, "a b") for _ in range(2)] == [25_001, 25_001]  # once more: the same rows, not twice
    read = lambda: sorted(map(tuple, sqlite.read_table(spark, path, "a b").collect()), key=str)
    assert read() == sorted([*rows, (None, None, None)], key=str)
    with pytest.raises(Exception, match="late"):  # what fails leaves the rows as they were
        sqlite.write_table(df.withColumn("k", F.when(F.col("k") == 24_999, F.raise_error(F.lit("late")).cast("long")).otherwise(1)), path, "a b")
    assert len(read()) == 25_001
    assert sqlite.write_table(df.limit(0), path, "a b") == 0 and read() == []


@pytest.mark.parametrize("name", ["src_sqlite_lookup", "src_sqlite_scan", "src_sqlite_solos"])
def test_sqlite_queries_keep_rows_off_the_driver(spark, tmp_path, monkeypatch, name):
    from motif_engine.plans import source_queries

    spark.range(40).selectExpr("id AS c_custkey", "concat('c', id) AS c_name", "cast(id % 25 as int) AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(4000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 40 AS user_id", "if(id % 7 = 0, 'error', 'view') AS event_type", "1.0D AS value", "'{\"k\": 3}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    kind, sent = type(spark.range(0)), []
    for way in ("collect", "toPandas", "toArrow", "toLocalIterator", "tail"):  # head, take and first collect, too

        def counted(self, *args, f=getattr(kind, way), **kw):
            rows = f(self, *args, **kw)
            rows = list(rows) if way == "toLocalIterator" else rows
            sent.append(len(rows))
            return iter(rows) if way == "toLocalIterator" else rows

        monkeypatch.setattr(kind, way, counted)
    df = source_queries.QUERIES[name](spark, str(tmp_path))
    assert max(sent, default=0) <= 1
    monkeypatch.undo()
    assert df.count() == {"src_sqlite_lookup": 1, "src_sqlite_scan": 7, "src_sqlite_solos": 40}[name]


def test_result_pages(spark):
    cells = ["db", "m1", "1", "4", "3", "P <b>X</b>", "T", "1960", "tp", "1.5", "x", "", "", "0.9", "1"]
    row = lambda c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = row(cells) + row(cells[:10]) + row(cells[:14] + ["one"]) + row([*cells[:7], "n/a", *cells[8:]])
    got = files.parse_result_pages(spark.createDataFrame([(html,), (None,), ("",)], "html string")).collect()
    assert [(r.performer, r.year, r.start_position, r.duration, r.similarity, r.edit_distance) for r in got] == [("P X", 1960, 1.5, None, 0.9, 1), ("P X", None, 1.5, None, 0.9, 1)]
    assert files.default_edit_cap(5, 0.8) == 1


def test_data_status(spark, tmp_path, database):
    got = {r.name: r for r in files.data_status(spark, {"db": database, "none": f"{tmp_path}/nothing/*.xml"}).collect()}
    assert got["db"].present and got["db"].is_sqlite and len(got["db"].sha256) == 64 and got["db"].file_count == 1
    assert not got["none"].present and got["none"].size_bytes == 0 and got["db"].verified is None
    sha = got["db"].sha256
    assert [r.verified for r in files.data_status(spark, {"db": database}, {"db": sha.upper()}).collect()] == [True]
    assert [r.verified for r in files.data_status(spark, {"db": database, "no": f"{tmp_path}/no"}, {"db": "0" * 64, "no": sha}).orderBy("name").collect()] == [False, False]


def test_live_phrases(spark, tmp_path):
    rows = [("a", s, 1.0, 60) for s in (0, 1, 2, 10, 11, 12, 13, 100)]
    df = spark.createDataFrame(rows, "melid string, s int, duration_seconds double, pitch int").select("melid", F.timestamp_seconds("s").alias("ts"), "duration_seconds", "pitch")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = live_phrases(stream).writeStream.format("memory").queryName("live").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n_notes for r in spark.sql("SELECT * FROM live").collect()) == [3, 4]


def test_wav(spark, tmp_path):
    import wave

    with wave.open(f"{tmp_path}/a.wav", "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes((16384).to_bytes(2, "little") * 4)
    (tmp_path / "b.wav").write_bytes(b"no")
    got = {r.melid: r for r in files.read_wav(spark, f"{tmp_path}/*.wav").collect()}
    assert got["a"].rate == 8000 and got["a"].samples == [0.5, 0.5] and got["b"].samples is None


def test_command_line(spark, database, tmp_path):
    from motif_engine.__main__ import main

    lines = []
    assert main(["search", "0 2", "--corpus", f"solos:{database}", "--min-similarity", "0.5"], lines.append, spark) == 0
    assert {json.loads(x)["melid"] for x in lines} == {"wjazzd-1", "wjazzd-2"}
    for args in (["features", "--corpus", f"solos:{database}"], ["phrases", "--corpus", f"solos:{database}"], ["status", f"db={database}"], ["health"]):
        lines.clear()
        assert main(args, lines.append, spark) == 0 and all(json.loads(x) for x in lines)
    with pytest.raises(CorpusError):
        main(["features", "--corpus", "x:y"], lines.append, spark)
