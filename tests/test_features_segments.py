import numpy as np
import pytest
from pyspark.sql import functions as F

from motif_engine.operators import features as FE
from motif_engine.operators import segment as SEG
from motif_engine.operators import sequence as SEQ
from tests.conftest import SAMPLE


def test_basic_features(notes):
    r = FE.extract(notes(a=SAMPLE), FE.BASIC).first()
    assert r.pitch_range == 7 and r.note_density == pytest.approx(0.9) and r.chromaticism_ratio == 0 and r.rhythmic_variability == 0
    assert r.pitch_class_histogram == [2, 0, 2, 0, 2, 2, 0, 1, 0, 0, 0, 0]


def test_features_of_a_solo_of_rests(notes):
    r = FE.extract(notes(a=[(None, 0, 1)]), FE.BASIC).first()
    assert (r.pitch_range, r.note_density, r.chromaticism_ratio, r.rhythmic_variability) == (0, 0, 0, 0)
    d = FE.with_iois(notes(a=[(None, 0, 1)])).groupBy("melid").agg(FE.duration_stats().alias("s"), FE.pitch_class_distribution().alias("d")).first()
    assert tuple(d.s) == (0, 0, 0) and sum(d.d.values()) == 0 and len(d.d) == 12


def test_rhythm_features_agree_with_numpy(notes):
    rng = np.random.default_rng(1)
    onsets, durations = np.cumsum(rng.exponential(1, 40)), rng.exponential(1, 40) + 0.1
    df = notes(a=[(60 if i % 4 else None, o, d) for i, (o, d) in enumerate(zip(onsets, durations, strict=True))])
    r = FE.extract(df, FE.RHYTHM).first()
    pitched = durations[np.arange(40) % 4 != 0]
    assert tuple(r.duration_stats) == pytest.approx((pitched.mean(), np.median(pitched), pitched.std()))
    ioi = np.diff(onsets)
    assert r.rhythmic_variability == pytest.approx(ioi.std() / ioi.mean())
    assert r.ioi_histogram_log == np.histogram(ioi, np.logspace(np.log10(ioi.min()), np.log10(ioi.max()), 17))[0].tolist()
    linear = FE.ioi_histogram_linear(df).first()["values"]
    assert linear == np.histogram(ioi, np.linspace(0, ioi.max(), 17))[0].tolist()


def test_log_histogram_edges():
    assert FE.log_histogram(np.array([])).sum() == 0 and FE.log_histogram(np.array([0.0, -1.0])).sum() == 0
    assert FE.log_histogram(np.array([0.5, 0.5]))[-1] == 2
    with pytest.raises(ValueError):
        FE.log_histogram(np.array([1e-4, 2e-4]))


def test_configurations():
    with pytest.raises(TypeError):
        FE.MachineConfig.from_dict({"name": "x", "features": [{"name": "a", "function": "pitch_range", "bins": 3}]})
    assert FE.MachineConfig.from_dict({"name": "x", "features": [{"name": "a", "function": "pitch_range"}]}).features[0].type == "scalar"


def test_unknown_and_own_features(notes):
    with pytest.raises(ValueError):
        FE.extract(notes(a=SAMPLE), FE.MachineConfig("x", (FE.FeatureConfig("a", "os:system"),)))
    FE.register("first_pitch", lambda pdf: int(pdf["pitch"].iloc[0]), "int")
    FE.register("fails", lambda pdf: 1 / 0, "int")
    r = FE.extract(notes(a=SAMPLE), FE.MachineConfig("x", (FE.FeatureConfig("f", "first_pitch"), FE.FeatureConfig("g", "fails")))).first()
    assert r.f == 60 and r.g is None and r.g_error.startswith("ZeroDivisionError")


def spans(df):
    return [(r.phrase_id, r.start_beat, r.end_beat, r.n_notes) for r in df.orderBy("start_beat").collect()]


def test_rests_split_phrases(notes):
    df = notes(a=[(60, i, 1) for i in range(3)] + [(60, 5 + i, 1) for i in range(3)])
    assert spans(SEG.phrases(df)) == [("phrase-0", 0, 3, 3), ("phrase-1", 5, 8, 3)]


def test_a_gap_of_the_threshold_doesnt_split(notes):
    assert len(spans(SEG.phrases(notes(a=[(60, i * 1.5, 1) for i in range(6)])))) == 1


def test_long_phrases_are_cut(notes):
    got = spans(SEG.phrases(notes(a=[(60, i * 1.1, 1.1) for i in range(20)]), SEG.SegmentationConfig(max_phrase_beats=8.0)))
    assert [g[3] for g in got] == [8, 7, 5] and got[0][1:3] == (0, 8) and got[-1][2] == pytest.approx(22)


def test_exact_multiples_make_no_empty_chunk(notes):
    assert [g[1:3] for g in spans(SEG.phrases(notes(a=[(60, i, 1) for i in range(16)]), SEG.SegmentationConfig(max_phrase_beats=8.0)))] == [(0, 8), (8, 16)]


def test_small_phrases_and_skips(notes):
    df = notes(a=[(60, 0, 0.1), (60, 5, 1), (62, 6, 1), (64, 7, 1), (60, 20, 1), (60, 21, 1), (60, 22, 1)])
    assert spans(SEG.phrases(df)) == [("phrase-0", 5, 8, 3), ("phrase-1", 20, 23, 3)]
    assert spans(SEG.phrases(df, SEG.SegmentationConfig(skip_first_beats=6.0))) == [("phrase-0", 20, 23, 3)]
    assert SEG.phrases(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "ns, gap, diff, want",
    [
        ([(60, 0, 0.3), (60, 0.4, 0.3)], 0.1, 0, [(60, 0, 0.7)]),
        ([(60, 0, 0.3), (60, 0.5, 0.3)], 0.1, 0, [(60, 0, 0.3), (60, 0.5, 0.3)]),
        ([(60, 0, 0.5), (61, 0.6, 0.5), (60, 1.2, 0.5)], 0.2, 1, [(60, 0, 1.7)]),
        ([(60, 0, 0.5), (61, 0.6, 0.5), (62, 1.2, 0.5)], 0.2, 1, [(60, 0, 1.1), (62, 1.2, 0.5)]),
    ],
)
def test_merge(notes, ns, gap, diff, want):
    got = [(r.pitch, r.onset_beat, r.duration_beats) for r in SEQ.merge_close_notes(notes(a=ns), gap, diff).orderBy("onset_beat").collect()]
    assert [x for g in got for x in g] == pytest.approx([x for w in want for x in w])


def test_monophonic(notes):
    df = notes(a=[(60, 0, 2, 50), (62, 1, 2, 80), (64, 3, 1, 10), (65, 3, 1, 20)])
    assert [r.pitch for r in SEQ.monophonic(df).orderBy("onset_beat").collect()] == [62, 65]


def test_thinning_agrees_with_a_plain_list():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = 30
        start, strength = rng.integers(0, 20, n).astype(float), rng.integers(0, 5, n).astype(float)
        end = start + rng.integers(1, 5, n)
        kept = []
        for i in sorted(range(n), key=lambda i: (start[i], -strength[i])):
            at = next((k for k, j in enumerate(kept) if start[i] < end[j] and end[i] > start[j]), None)
            if at is None:
                kept.append(i)
            elif strength[i] > strength[kept[at]]:
                kept[at] = i
        assert SEQ.thinned(start, end, strength).tolist() == sorted(kept, key=lambda i: start[i])


def test_note_filters(spark, notes):
    df = notes(a=[(60, 0, 1), (80, 1, 0.01), (30, 2, 1)]).withColumn("velocity", F.when(F.col("pitch") == 60, 0.5).otherwise(90.0))
    got = SEQ.filter_notes(df, 0.05, min_hz=100.0).collect()
    assert [(r.pitch, r.velocity) for r in got] == [(60, 64)]


def test_runs_of_frequencies(spark):
    rows = [("a", i, i * 0.1, v, f) for i, (v, f) in enumerate([(True, 440.0)] * 4 + [(False, None)] + [(True, 220.0)] + [(False, 0.0)] + [(True, 880.0)])]
    got = SEQ.frequencies_to_notes(spark.createDataFrame(rows, "melid string, frame int, time double, voiced boolean, f0 double"), 60.0).orderBy("onset_beat").collect()
    assert [(r.pitch, round(r.onset_beat, 3), round(r.duration_beats, 3)) for r in got] == [(69, 0, 0.4), (81, 0.7, 0.0)]


def test_solo_start(notes):
    head, solo = [(60, 4 * i, 4) for i in range(5)], [(60, 20 + i * 0.5, 0.5) for i in range(16)]
    df = notes(a=head + solo, b=head)
    got = {r.melid: r.start_beat for r in SEQ.solo_start(df).collect()}
    assert got == {"a": 18.0, "b": 8.0}
    kept = SEQ.from_start(df, SEQ.solo_start(df)).collect()
    assert {r.melid for r in kept} == {"a"} and min(r.onset_beat for r in kept) == 2.0


def test_slices_and_beats(notes):
    df = notes(a=SAMPLE)
    assert SEQ.slice_notes(df, 2, 4).count() == 2 and SEQ.total_beats(df).first().total_beats == 10
    assert SEQ.seconds_to_beats(df, 120.0).agg(F.max("onset_beat")).first()[0] == pytest.approx(16)


def test_whole_ways_from_detections(spark, notes):
    raw = notes(a=[(60, 0, 0.5), (62, 0.25, 0.5), (64, 2, 0.01), (65, 3, 0.5)]).withColumn("velocity", F.col("pitch") / 100)
    got = SEQ.from_detections(raw, bpm=120.0).orderBy("onset_beat").collect()
    assert [(r.pitch, r.onset_beat, r.duration_beats, r.velocity) for r in got] == [(62, 0.5, 1.0, 79), (65, 6.0, 1.0, 83)]
    rows = [("a", i, i * 0.05, i != 4, f) for i, f in enumerate([440.0] * 4 + [0.0] + [445.0] * 4)]
    frames = spark.createDataFrame(rows, "melid string, frame int, time double, voiced boolean, f0 double")
    assert [r.pitch for r in SEQ.from_frequencies(frames).collect()] == [69]


def test_solos_without_phrases_give_all_grams(notes):
    from motif_engine.operators import grams as G

    df = notes(a=SAMPLE, b=SAMPLE)
    only_a = SEG.phrase_notes(df).filter("melid = 'a'")
    got = [r.melid for r in G.solo_or_signature_grams(df, only_a, 3).collect()]
    assert got.count("a") == 1 and got.count("b") == 6 and G.solo_or_signature_grams(df, None, 3).count() == 12
