import pytest
from pyspark.sql import functions as F

from motif_engine.corpus import Corpus, search_corpora
from motif_engine.operators import grams as G
from motif_engine.operators import search as S
from tests.conftest import SAMPLE


@pytest.mark.parametrize("a, b, want", [([1, 2], [1, 2], (0, 1.0)), ([1, 1, 1], [9, 9, 9], (3, 0.0)), ([1, 2, 3], [1, 2, 4], (1, 2 / 3)), ([1, 2], [1, 2, 3], (1, 2 / 3)), ([], [], (0, 1.0))])
def test_pattern_similarity(a, b, want):
    assert S.pattern_similarity(a, b) == pytest.approx(want)


def corpus(spark, values):
    return spark.createDataFrame([(f"m{i}", 0, 0.0, v, G.encode(v)) for i, v in enumerate(values)], "melid string, pos int, onset_beat double, values array<int>, enc string")


def test_search_agrees_with_the_driver_side_distance(spark):
    values = [[1, 2, 3], [1, 2, 4], [3, 2, 1], [9, 9, 9], [1, 2], [1, 2, 3, 3]]
    got = S.search_grams(corpus(spark, values), [1, 2, 3], 0.5, max_length_difference=1).collect()
    want = {f"m{i}": S.pattern_similarity([1, 2, 3], v) for i, v in enumerate(values)}
    assert {r.melid: (r.edit_distance, r.similarity) for r in got} == {k: v for k, v in want.items() if v[1] >= 0.5}


def test_threshold_is_not_floored(spark):
    assert S.search_grams(corpus(spark, [[1, 2, 3, 4, 9]]), [1, 2, 3, 4, 5], 0.8).count() == 1


def test_edit_cap_limit_and_order(spark):
    g = corpus(spark, [[1, 2, 4], [1, 2, 3], [1, 2, 3]])
    assert [r.melid for r in S.search_grams(g, [1, 2, 3], 0.5, limit=2).collect()] == ["m1", "m2"]
    assert S.search_grams(g, [1, 2, 3], 0.5, max_edit_distance=0).count() == 2


@pytest.mark.parametrize("values, n", [([[1, 2, 3]] * 2 + [[9, 9, 9]], 2), ([[1, 2, 3]] + [[5, 5, 5]] * 3, 3)])
def test_min_frequency(spark, values, n):
    pattern = max(values, key=values.count)
    assert S.search_grams(corpus(spark, values), pattern, 0.5, min_frequency=2).count() == n


def test_out_of_range_values_match_nothing(spark):
    assert S.search_grams(corpus(spark, [[1, 2, 3]]), [1, 2, 300], 0.9).count() == 0


@pytest.mark.parametrize("bad", [{"pattern": [1]}, {"pattern": [1] * 21}, {"min_similarity": 0.4}, {"max_length_difference": 6}, {"max_edit_distance": 21}, {"min_frequency": 0}, {"limit": 0}, {"databases": ()}, {"transformation": "x"}])
def test_request_validation(bad):
    with pytest.raises(ValueError):
        S.SearchRequest(**({"pattern": [1, 2]} | bad)).validate()


def test_corpora_are_merged_and_errors_kept(spark, notes):
    meta = spark.createDataFrame([("a", "P", "T", 1960), ("b", "Q", "U", None)], "melid string, performer string, title string, year int")
    c = Corpus("one", notes(a=SAMPLE, b=SAMPLE[:5]), meta)
    broken = Corpus("two", c.notes.withColumn("pitch", F.raise_error(F.lit("lost")).cast("int")), meta)
    got = search_corpora([c, broken], S.SearchRequest([2, 2, 1], ("one", "two", "three"), min_similarity=0.6))
    assert [(r.melid, r.edit_distance) for r in got.matches.collect()] == [("b", 0), ("a", 0)]
    assert set(got.errors) == {"two", "three"} and "Unknown corpus" in got.errors["three"]
    assert len(c) == 2 and c.total_notes() == 14 and c.get("a").count() == 1
    assert c.search([2, 2, 1], min_similarity=1.0).count() == 2 and c.search_solo("a", [2, 2, 1], min_similarity=1.0).count() == 1


def test_expanded_lengths(notes):
    request = S.SearchRequest([2, 2, 1, 2], min_similarity=0.75, max_length_difference=1)
    assert {len(r["values"]) for r in S.search_notes(notes(a=SAMPLE), request, expand_lengths=True).collect()} == {3, 4, 5}
    assert {len(r["values"]) for r in S.search_notes(notes(a=SAMPLE), request).collect()} == {4}


def test_batch(notes):
    got = S.search_batch(G.grams(notes(a=SAMPLE), 3), {"x": [2, 2, 1], "y": [-2, -1, -2]}, 1.0).collect()
    assert {(r["query"], r.pos) for r in got} == {("x", 0), ("y", 4)}
