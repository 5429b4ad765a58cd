import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motif_engine.functions import transforms as T
from motif_engine.operators import grams as G
from motif_engine.operators import segment as SEG
from motif_engine.schema import to_notes, to_solos, validate_notes
from tests.conftest import SAMPLE


def arrays(spark, pitches, name):
    return spark.createDataFrame([(pitches,)], "p array<int>").select(T.transform(F.col("p"), name)).first()[0]


@pytest.mark.parametrize(
    "name, pitches, want",
    [
        ("pitch", [60, 62], [60, 62]),
        ("interval", [60, 62, 61], [2, -1]),
        ("interval", [60], []),
        ("interval", [], []),
        ("fuzzyinterval", [60, 61, 63, 66, 70, 75, 75, 70], [1, 2, 3, 3, 5, 0, -5]),
        ("cdpcx", [60, 62, 64, 65, 67, 69, 71, 66], [0, 1, 2, 3, 4, 5, 6, -1]),
    ],
)
def test_array_transforms(spark, name, pitches, want):
    assert arrays(spark, pitches, name) == want


def test_unknown_transformation():
    with pytest.raises(ValueError):
        T.check("contour")


def test_degrees_with_chords(spark):
    rows = [(69 + d, 9, q) for d, q in ((0, "m7"), (2, "m7"), (3, "m7"), (4, "maj7"), (3, "dim"), (4, "7alt"))] + [(59, 0, "maj7")]
    df = spark.createDataFrame(rows, "p int, r int, q string")
    assert [x[0] for x in df.select(T.degree(F.col("p"), F.col("r"), F.col("q"))).collect()] == [0, 1, 2, 2, 2, 2, 6]


def test_grams_of_nine_notes(notes):
    got = G.grams(notes(a=SAMPLE), 4).orderBy("pos").collect()
    assert [r["values"] for r in got] == [[2, 2, 1, 2], [2, 1, 2, -2], [1, 2, -2, -1], [2, -2, -1, -2], [-2, -1, -2, -2]]
    assert [r.onset_beat for r in got] == [0, 1, 2, 3, 4]


def test_grams_skip_rests_and_short_solos(notes):
    df = notes(a=[(60, 0, 1), (None, 1, 1), (62, 2, 1), (64, 3, 1)], b=[(60, 0, 1)])
    got = G.grams(df, 2).collect()
    assert [(r.melid, r["values"]) for r in got] == [("a", [2, 2])]
    with pytest.raises(ValueError):
        G.grams(df, 1)


def test_flat_and_array_grams_agree(notes):
    df = notes(a=SAMPLE, b=SAMPLE[:3], c=SAMPLE[:1])
    for name in T.TRANSFORMATIONS:
        flat = {(r.melid, r.pos, tuple(r["values"])) for r in G.grams(df, 3, name).collect()}
        rows = {(r.melid, r.pos, tuple(r["values"])) for r in G.solo_grams(to_solos(df), 3, name).collect()}
        assert flat == rows


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(40, 80), min_size=3, max_size=12), st.integers(-12, 12))
def test_intervals_dont_change_under_transposition(notes, pitches, by):
    df = notes(a=[(p, i, 1) for i, p in enumerate(pitches)], b=[(p + by, i, 1) for i, p in enumerate(pitches)])
    rows = G.grams(df, 2).collect()
    assert sorted((r.pos, r["values"]) for r in rows if r.melid == "a") == sorted((r.pos, r["values"]) for r in rows if r.melid == "b")


def test_signatures(notes):
    ns = [(p, i, 1) for i, p in enumerate((60, 62, 64, 65))] + [(p, 10 + i, 1) for i, p in enumerate((67, 69, 71, 72))]
    got = G.signatures(SEG.phrase_notes(notes(a=ns)), 3).orderBy("phrase_id").collect()
    assert [(r.phrase_id, r["values"]) for r in got] == [("phrase-0", [2, 2, 1]), ("phrase-1", [2, 2, 1])]


def test_round_trip_and_validation(spark, notes):
    df = notes(a=SAMPLE, b=[(None, 0, 1), (128, 1, 1), (60, 2, 0)])
    assert sorted(map(tuple, to_notes(to_solos(df)).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert validate_notes(df, "drop").count() == 10
    with pytest.raises(Exception, match="bad note in b"):
        validate_notes(df).collect()


def test_pattern_and_names(spark):
    assert T.parse_pattern("2, 2 1,-1") == [2, 2, 1, -1]
    with pytest.raises(ValueError):
        T.parse_pattern("2")
    df = spark.createDataFrame([(60,), (69,), (0,)], "p int")
    assert [tuple(r) for r in df.select(T.note_name(F.col("p")), F.round(T.midi_to_hz(F.col("p")), 3)).collect()] == [("C4", 261.626), ("A4", 440.0), ("C-1", 8.176)]
    assert [r[0] for r in spark.createDataFrame([(440.0,), (0.0,), (None,)], "h double").select(T.hz_to_midi(F.col("h"))).collect()] == [69, None, None]


def test_time_signatures(spark):
    df = spark.createDataFrame([("6/8",), ("4",), (None,), ("a/b",), ("3/",)], "s string")
    num, den = T.time_signature(F.col("s"))
    assert [tuple(r) for r in df.select(num, den).collect()] == [(6, 8), (4, 4), (4, 4), (4, 4), (4, 4)]
