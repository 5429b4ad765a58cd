"""One query per operator over the driver tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

from pyspark.sql import functions as F

from motif_engine.functions import transforms as T
from motif_engine.operators import features as FE
from motif_engine.operators import grams as G
from motif_engine.operators import search as S
from motif_engine.operators import segment as SEG
from motif_engine.operators import sequence as SEQ
from motif_engine.sources import events, files
from motif_engine.sources.sqlite import solos_from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_NOTES = """notes AS (SELECT 'ev-' || CAST(user_id AS VARCHAR) AS melid, event_id AS note_idx,
  CASE WHEN event_type = 'error' THEN NULL ELSE CAST(54 + CAST(json_extract(props, '$.k') AS INT) % 13 AS INT) END AS pitch,
  (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 3600000000.0::DOUBLE AS onset_beat, 0.25 + value / 5.0 AS duration_beats FROM events),
pitched AS (SELECT *, row_number() OVER w - 1 AS pos, lead(pitch) OVER w - pitch AS step FROM notes WHERE pitch IS NOT NULL
  WINDOW w AS (PARTITION BY melid ORDER BY onset_beat, note_idx)),
meta AS (SELECT 'ev-' || CAST(c_custkey AS VARCHAR) AS melid, c_name AS performer, n_name AS style, CAST(1950 + c_custkey % 50 AS INT) AS year, c_custkey
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey)"""
_SIZE_CLASS = "CAST(sign(step) * CASE WHEN abs(step) <= 1 THEN 1 WHEN abs(step) = 2 THEN 2 WHEN abs(step) <= 4 THEN 3 ELSE abs(step) END AS INT)"
_MAJOR = "[0, 2, 4, 5, 7, 9, 11]"
_VALUE = {
    "pitch": "pitch",
    "interval": "step",
    "fuzzyinterval": _SIZE_CLASS,
    "cdpcx": f"coalesce(list_position({_MAJOR}, pitch % 12), 0) - 1",
}


def _with(body: str) -> str:
    return f"WITH {_NOTES},\n{body}"


def _values(name: str) -> str:
    return f"t AS (SELECT melid, pos, onset_beat, v FROM (SELECT *, CAST({_VALUE[name]} AS INT) AS v FROM pitched) WHERE v IS NOT NULL)"


def _grams(n: int, name: str = "interval", of: str = "t", out: str = "g") -> str:
    """SQL for grams; enc has one byte a value, as DuckDB's levenshtein counts bytes."""
    cells = ["v", *[f"lead(v, {i}) OVER w" for i in range(1, n)]]
    shift = 0 if name == "pitch" else 80
    return f"""{out} AS (SELECT *, {" || ".join(f"chr(v{i} + {shift})" for i in range(n))} AS enc, concat_ws(',', {", ".join(f"v{i}" for i in range(n))}) AS gram
      FROM (SELECT melid, pos, onset_beat, {", ".join(f"{c} AS v{i}" for i, c in enumerate(cells))} FROM {of} WINDOW w AS (PARTITION BY melid ORDER BY pos)) WHERE v{n - 1} IS NOT NULL)"""


def _pattern(values: list[int], name: str = "interval") -> str:
    shift = 0 if name == "pitch" else 80
    return " || ".join(f"chr({v + shift})" for v in values)


def _matched(values: list[int], n: int | None = None, longest: int | None = None, of: str = "g", name: str = "interval") -> str:
    longest = longest or max(len(values), n or 0)
    return f"SELECT *, CAST(levenshtein(enc, {_pattern(values, name)}) AS INT) AS edit_distance, 1.0::DOUBLE - levenshtein(enc, {_pattern(values, name)}) / {longest}::DOUBLE AS similarity FROM {of}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _joined(values: Column | str) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _transformed(name: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return G.transformed(events.notes(spark, sf), name).select("melid", "pos", F.col("v").alias("value"))

    QUERIES[f"t_{name}" if name != "cdpcx" else "t_cdpcx_c"] = f
    SQL[f"t_{name}" if name != "cdpcx" else "t_cdpcx_c"] = _with(_values(name)) + " SELECT melid, pos, v AS value FROM t"


def _gram_query(name: str) -> None:
    def f(spark: SparkSession, sf: str) -> DataFrame:
        return G.grams(events.notes(spark, sf), 4, name).select("melid", "pos", _r("onset_beat").alias("onset_beat"), _joined("values").alias("gram"))

    key = f"ngram_{ {'fuzzyinterval': 'fuzzy'}.get(name, name) }"
    QUERIES[key] = f
    SQL[key] = _with(_values(name) + ", " + _grams(4, name)) + " SELECT melid, pos, round(onset_beat, 6) AS onset_beat, gram FROM g"


for _name in T.TRANSFORMATIONS:
    _transformed(_name)
    _gram_query(_name)


@query(
    _with("c AS (SELECT *, note_idx % 12 AS root, ['maj7', 'm7', 'dim7', '7alt', 'min', 'maj'][CAST(note_idx % 6 AS INT) + 1] AS q FROM pitched)")
    + f""", d AS (SELECT melid, pos, ((pitch - root) % 12 + 12) % 12 AS chroma,
        CASE WHEN q IN ('m7', 'min') THEN [0, 2, 3, 5, 7, 8, 10] WHEN q = 'dim7' THEN [0, 2, 3, 5, 6, 8, 9, 11] WHEN q = '7alt' THEN [0, 3, 4, 7, 9, 10]
        ELSE {_MAJOR} END AS scale FROM c)
      SELECT melid, pos, CAST(coalesce(list_position(scale, chroma), 0) - 1 AS INT) AS value FROM d"""
)
def t_cdpcx_chords(spark: SparkSession, sf: str) -> DataFrame:
    root = F.col("note_idx") % 12
    quality = F.element_at(F.array(*[F.lit(q) for q in ("maj7", "m7", "dim7", "7alt", "min", "maj")]), (F.col("note_idx") % 6 + 1).cast("int"))
    return G.transformed(events.notes(spark, sf), "cdpcx", root, quality).select("melid", "pos", F.col("v").alias("value"))


@query(_with(_values("interval") + ", " + _grams(3)) + " SELECT gram, count(*) AS n FROM g GROUP BY gram")
def ngram_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return G.frequencies(G.grams(events.notes(spark, sf), 3)).select(_joined("values").alias("gram"), "n")


@query(_with(_values("interval") + ", " + _grams(3)) + " SELECT melid, pos, gram FROM g")
def ngram_solo_arrays(spark: SparkSession, sf: str) -> DataFrame:
    from motif_engine.schema import to_solos

    return G.solo_grams(to_solos(events.notes(spark, sf)), 3).select("melid", "pos", _joined("values").alias("gram"))


_SIMILAR = [2, 2, 1]
_OUT = "melid, pos, round(onset_beat, 6) AS onset_beat, edit_distance, round(similarity, 6) AS similarity"


def _found(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "melid", "pos", _r("onset_beat").alias("onset_beat"), "edit_distance", _r("similarity").alias("similarity"))


_G3 = _values("interval") + ", " + _grams(3)
_G5 = _values("interval") + ", " + _grams(5)
_P5 = [-1, -1, 4, -5, -2]


@query(_with(f"{_G3}, m AS ({_matched(_SIMILAR)}) SELECT {_OUT} FROM m WHERE similarity >= 1.0"))
def search_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_grams(G.grams(events.notes(spark, sf), 3), _SIMILAR, 1.0))


@query(
    _with(
        f"""{_G3}, m AS ({_matched(_SIMILAR)}), k AS (SELECT * FROM m WHERE similarity >= 0.6 ORDER BY similarity DESC, melid, pos LIMIT 100)
        SELECT performer, style, {_OUT.replace("melid,", "k.melid,")} FROM k LEFT JOIN meta ON k.melid = meta.melid"""
    )
)
def search_similar(spark: SparkSession, sf: str) -> DataFrame:
    request = S.SearchRequest(_SIMILAR, min_similarity=0.6, limit=100)
    return _found(S.search_notes(events.notes(spark, sf), request, events.metadata(spark, sf)), "performer", "style")


@query(_with(f"{_G5}, m AS ({_matched(_P5)}) SELECT {_OUT} FROM m WHERE similarity >= 0.5 AND edit_distance <= 2"))
def search_max_edit(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_grams(G.grams(events.notes(spark, sf), 5), _P5, 0.5, max_edit_distance=2))


@query(
    _with(f"{_G3}, m AS ({_matched(_SIMILAR)}) SELECT {_OUT} FROM m WHERE similarity >= 0.6 AND gram IN (SELECT gram FROM g GROUP BY gram HAVING count(*) >= 5)")
)
def search_min_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_grams(G.grams(events.notes(spark, sf), 3), _SIMILAR, 0.6, min_frequency=5))


@query(
    _with(
        f"""{_values("interval")}, {_grams(3, out="g3")}, {_grams(4, out="g4")}, {_grams(5, out="g5")},
        m AS ({" UNION ALL ".join(f"SELECT {n} AS length, melid, pos, onset_beat, edit_distance, similarity FROM ({_matched([2, 2, 1, 2], n, of=f'g{n}')})" for n in (3, 4, 5))})
        SELECT length, {_OUT} FROM m WHERE similarity >= 0.75"""
    )
)
def search_len_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    request = S.SearchRequest([2, 2, 1, 2], min_similarity=0.75, max_length_difference=1)
    found = S.search_notes(events.notes(spark, sf), request, expand_lengths=True, limit=False)
    return _found(found.withColumn("length", F.size("values")), "length")


@query(_with(f"{_G3}, m AS ({_matched([2, -2, 3])}) SELECT {_OUT} FROM m WHERE similarity >= 0.5 ORDER BY m.similarity DESC, melid, pos LIMIT 20"))
def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_grams(G.grams(events.notes(spark, sf), 3), [2, -2, 3], 0.5, limit=20))


@query(_with(f"{_G3}, m AS ({_matched(_SIMILAR)}) SELECT {_OUT} FROM m WHERE similarity >= 0.5 AND melid = 'ev-15'"))
def search_solo(spark: SparkSession, sf: str) -> DataFrame:
    return _found(events.corpus(spark, sf).search_solo("ev-15", _SIMILAR, min_similarity=0.5, limit=500))


@query(_with(f"{_G3}, m AS ({_matched(_SIMILAR)}) SELECT melid, count(*) AS n_matches, max(similarity) AS best FROM m WHERE similarity >= 0.6 GROUP BY melid"))
def search_per_solo_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = S.search_grams(G.grams(events.notes(spark, sf), 3), _SIMILAR, 0.6)
    return found.groupBy("melid").agg(F.count(F.lit(1)).alias("n_matches"), F.max("similarity").alias("best"))


def _corpus_sql(name: str, of: str) -> str:
    return f"(SELECT '{name}' AS database, * FROM (SELECT m.*, meta.year FROM ({of}) AS m LEFT JOIN meta ON m.melid = meta.melid ORDER BY similarity DESC, m.melid, pos LIMIT 60))"


@query(
    _with(
        f"""{_G3}, m AS ({_matched(_SIMILAR)}), f AS (SELECT * FROM m WHERE similarity >= 0.5),
        u AS ({_corpus_sql("first", "SELECT * FROM f")} UNION ALL {_corpus_sql("second", "SELECT * FROM f")}),
        r AS (SELECT *, row_number() OVER (PARTITION BY database, melid ORDER BY similarity DESC, pos) AS k FROM u)
        SELECT database, {_OUT}, year FROM (SELECT * FROM r WHERE k = 1 ORDER BY similarity DESC, edit_distance, coalesce(year, 0), database, melid LIMIT 60) AS r"""
    )
)
def search_multi_corpus_dedup(spark: SparkSession, sf: str) -> DataFrame:
    notes, meta = events.notes(spark, sf), events.metadata(spark, sf)
    request = S.SearchRequest(_SIMILAR, ("first", "second", "missing"), min_similarity=0.5, limit=60)
    found = S.search_databases({"first": lambda: (notes, meta), "second": lambda: (notes, meta)}, request)
    return _found(found.matches.withColumn("year", F.col("year").cast("int")), "database", "year")


_BATCH = {"up": [2, 2, 1], "down": [-2, -2, -1], "turn": [1, -1, 2], "leap": [7, -2, -2]}


@query(
    _with(
        f"""{_G3}, m AS ({" UNION ALL ".join(f"SELECT '{q}' AS query, melid, pos, onset_beat, edit_distance, similarity FROM ({_matched(p)})" for q, p in _BATCH.items())})
        SELECT query, {_OUT} FROM m WHERE similarity >= 0.6"""
    )
)
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_batch(G.grams(events.notes(spark, sf), 3), _BATCH, 0.6), "query")


# features

_IOI = "io AS (SELECT *, lead(onset_beat) OVER (PARTITION BY melid ORDER BY onset_beat, note_idx) - onset_beat AS ioi FROM notes)"
_HISTOGRAM = "concat_ws(',', " + ", ".join(f"count(*) FILTER (pitch % 12 = {i})" for i in range(12)) + ")"


def _aggregated(spark: SparkSession, sf: str, *columns: Column) -> DataFrame:
    return FE.with_iois(events.notes(spark, sf)).groupBy("melid").agg(*columns)


@query(_with(f"x AS (SELECT 1) SELECT melid, {_HISTOGRAM} AS histogram FROM notes GROUP BY melid"))
def f_pc_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return _aggregated(spark, sf, FE.pitch_class_histogram().alias("h")).select("melid", _joined("h").alias("histogram"))


@query(
    _with(
        """k AS (SELECT unnest(range(12)) AS pc), s AS (SELECT melid, count(pitch) AS n FROM notes GROUP BY melid), c AS (SELECT melid, pitch % 12 AS pc, count(*) AS c FROM pitched GROUP BY ALL)
        SELECT s.melid, CAST(k.pc AS INT) AS pc, round(CASE WHEN n > 0 THEN coalesce(c, 0) / n::DOUBLE ELSE 0 END, 6) AS share FROM s CROSS JOIN k LEFT JOIN c ON c.melid = s.melid AND c.pc = k.pc"""
    )
)
def f_pc_distribution(spark: SparkSession, sf: str) -> DataFrame:
    d = _aggregated(spark, sf, FE.pitch_class_distribution().alias("d"))
    return d.select("melid", F.explode("d").alias("pc", "share")).select("melid", "pc", _r("share").alias("share"))


@query(_with("x AS (SELECT 1) SELECT melid, coalesce(max(pitch) - min(pitch), 0) AS pitch_range FROM notes GROUP BY melid"))
def f_pitch_range(spark: SparkSession, sf: str) -> DataFrame:
    return _aggregated(spark, sf, FE.pitch_range().alias("pitch_range"))


@query(_with("x AS (SELECT 1) SELECT melid, round(coalesce(avg(CASE WHEN pitch IS NULL THEN NULL WHEN pitch % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN 0.0 ELSE 1.0 END), 0), 6) AS ratio FROM notes GROUP BY melid"))
def f_chromaticism(spark: SparkSession, sf: str) -> DataFrame:
    return _aggregated(spark, sf, _r(FE.chromaticism_ratio()).alias("ratio"))


@query(_with("x AS (SELECT 1) SELECT melid, round(count(pitch) / max(onset_beat + duration_beats), 6) AS density FROM notes GROUP BY melid"))
def f_note_density(spark: SparkSession, sf: str) -> DataFrame:
    return _aggregated(spark, sf, _r(FE.note_density()).alias("density"))


@query(
    _with(
        """x AS (SELECT 1) SELECT melid, round(coalesce(avg(duration_beats) FILTER (pitch IS NOT NULL), 0), 6) AS mean, round(coalesce(quantile_cont(duration_beats, 0.5) FILTER (pitch IS NOT NULL), 0), 6) AS median,
        round(coalesce(stddev_pop(duration_beats) FILTER (pitch IS NOT NULL), 0), 6) AS std FROM notes GROUP BY melid"""
    )
)
def f_duration_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = _aggregated(spark, sf, FE.duration_stats().alias("s"))
    return s.select("melid", _r("s.mean").alias("mean"), _r("s.median").alias("median"), _r("s.std").alias("std"))


_VARIABILITY = "round(coalesce(CASE WHEN count(*) >= 3 AND avg(ioi) FILTER (ioi > 0) > 0 THEN stddev_pop(ioi) FILTER (ioi > 0) / avg(ioi) FILTER (ioi > 0) END, 0), 6)"


@query(_with(f"{_IOI} SELECT melid, {_VARIABILITY} AS variability FROM io GROUP BY melid"))
def f_rhythmic_variability(spark: SparkSession, sf: str) -> DataFrame:
    return _aggregated(spark, sf, _r(FE.rhythmic_variability()).alias("variability"))


@query(
    _with(
        f"""{_IOI}, s AS (SELECT melid, CASE WHEN ioi > 0 THEN ioi END AS ioi, max(CASE WHEN ioi > 0 THEN ioi END) OVER (PARTITION BY melid) / 16::DOUBLE AS step FROM io),
        b AS (SELECT melid, {" + ".join(f"CAST(ioi >= {i}.0::DOUBLE * step AS INT)" for i in range(1, 16))} AS k FROM s)
        SELECT melid, concat_ws(',', {", ".join(f"count(*) FILTER (k = {i})" for i in range(16))}) AS histogram FROM b GROUP BY melid"""
    )
)
def f_ioi_hist_linear(spark: SparkSession, sf: str) -> DataFrame:
    return FE.ioi_histogram_linear(events.notes(spark, sf)).select("melid", _joined("values").alias("histogram"))


@query()
def f_ioi_hist_log(spark: SparkSession, sf: str) -> DataFrame:
    return FE.ioi_histogram_log(events.notes(spark, sf)).select("melid", _joined("values").alias("histogram"), "error")


@query(
    _with(
        f"""{_IOI} SELECT melid, {_HISTOGRAM} AS pitch_class_histogram, coalesce(max(pitch) - min(pitch), 0) AS pitch_range,
        round(coalesce(avg(CASE WHEN pitch IS NULL THEN NULL WHEN pitch % 12 IN (0, 2, 4, 5, 7, 9, 11) THEN 0.0 ELSE 1.0 END), 0), 6) AS chromaticism_ratio,
        round(count(pitch) / max(onset_beat + duration_beats), 6) AS note_density, {_VARIABILITY} AS rhythmic_variability FROM io GROUP BY melid"""
    )
)
def feature_machine_basic(spark: SparkSession, sf: str) -> DataFrame:
    f = FE.extract(events.notes(spark, sf), FE.BASIC)
    return f.select(
        "melid", _joined("pitch_class_histogram").alias("pitch_class_histogram"), "pitch_range", _r("chromaticism_ratio").alias("chromaticism_ratio"),
        _r("note_density").alias("note_density"), _r("rhythmic_variability").alias("rhythmic_variability"),
    )


@query()
def feature_machine_rhythm(spark: SparkSession, sf: str) -> DataFrame:
    f = FE.extract(events.notes(spark, sf), FE.RHYTHM)
    return f.select(
        "melid", _r("note_density").alias("note_density"), _joined("ioi_histogram_log").alias("ioi_histogram_log"), "ioi_histogram_log_error",
        _r("duration_stats.mean").alias("mean"), _r("duration_stats.median").alias("median"), _r("duration_stats.std").alias("std"),
        _r("rhythmic_variability").alias("rhythmic_variability"),
    )


@query(_with(f"x AS (SELECT 1) SELECT melid, {_HISTOGRAM} AS pitch_class_histogram FROM notes GROUP BY melid"))
def feature_machine_contour(spark: SparkSession, sf: str) -> DataFrame:
    return FE.extract(events.notes(spark, sf), FE.CONTOUR).select("melid", _joined("pitch_class_histogram").alias("pitch_class_histogram"))


@query(_with("x AS (SELECT 1) SELECT style, count(DISTINCT performer) AS performers, count(*) AS solos FROM meta GROUP BY style"))
def distinct_performers(spark: SparkSession, sf: str) -> DataFrame:
    return events.metadata(spark, sf).groupBy("style").agg(F.countDistinct("performer").alias("performers"), F.count(F.lit(1)).alias("solos"))


# phrases

_RUNS = """a AS (SELECT *, CASE WHEN onset_beat - lag(onset_beat + duration_beats) OVER w > 0.5 THEN 1 ELSE 0 END AS new FROM notes WHERE pitch IS NOT NULL WINDOW w AS (PARTITION BY melid ORDER BY onset_beat, note_idx)),
b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY melid ORDER BY onset_beat, note_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a),
r AS (SELECT *, first(onset_beat) OVER w AS run_start, last(onset_beat + duration_beats) OVER w AS run_end FROM b WINDOW w AS (PARTITION BY melid, run ORDER BY onset_beat, note_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
l AS (SELECT *, CAST(greatest(ceil((run_end - run_start) / 16.0::DOUBLE) - 1, 0) AS BIGINT) AS final FROM r),
c AS (SELECT *, least(CAST(floor((onset_beat - run_start) / 16.0::DOUBLE) AS BIGINT), final) AS chunk FROM l),
d AS (SELECT *, run_start + chunk * 16.0::DOUBLE AS start_beat, CASE WHEN chunk = final THEN run_end ELSE run_start + chunk * 16.0::DOUBLE + 16.0::DOUBLE END AS end_beat FROM c),
e AS (SELECT melid, run, chunk, any_value(start_beat) AS start_beat, any_value(end_beat) AS end_beat, count(*) AS n_notes FROM d GROUP BY melid, run, chunk),
f AS (SELECT * FROM e WHERE end_beat - start_beat >= 0.5 AND n_notes >= 3),
p AS (SELECT *, 'phrase-' || CAST(row_number() OVER (PARTITION BY melid ORDER BY start_beat, run, chunk) - 1 AS VARCHAR) AS phrase_id FROM f)"""
_SPAN = "round(start_beat, 6) AS start_beat, round(end_beat, 6) AS end_beat, n_notes"
_span = lambda df, *c: df.select("melid", *c, _r("start_beat").alias("start_beat"), _r("end_beat").alias("end_beat"), "n_notes")


@query(_with(f"{_RUNS} SELECT melid, run, round(run_start, 6) AS start_beat, round(run_end, 6) AS end_beat, count(*) AS n_notes FROM r GROUP BY melid, run, run_start, run_end"))
def seg_rest_split(spark: SparkSession, sf: str) -> DataFrame:
    runs = SEG.split_at_rests(events.notes(spark, sf)).groupBy("melid", "run").agg(F.first("run_start").alias("start_beat"), F.first("run_end").alias("end_beat"), F.count(F.lit(1)).alias("n_notes"))
    return _span(runs, "run")


@query(_with(f"{_RUNS} SELECT melid, run, chunk, {_SPAN} FROM e"))
def seg_force_split(spark: SparkSession, sf: str) -> DataFrame:
    chunks = SEG.force_split(SEG.split_at_rests(events.notes(spark, sf)))
    chunks = chunks.groupBy("melid", "run", "chunk").agg(F.first("start_beat").alias("start_beat"), F.first("end_beat").alias("end_beat"), F.count(F.lit(1)).alias("n_notes"))
    return _span(chunks, "run", "chunk")


@query(_with(f"{_RUNS} SELECT melid, run, chunk, {_SPAN} FROM f"))
def seg_min_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _span(SEG.phrases(events.notes(spark, sf)), "run", "chunk")


@query(_with(f"{_RUNS}, q AS (SELECT *, 'phrase-' || CAST(row_number() OVER (PARTITION BY melid ORDER BY start_beat, run, chunk) - 1 AS VARCHAR) AS id FROM f WHERE start_beat >= 100) SELECT melid, id AS phrase_id, {_SPAN} FROM q"))
def seg_skip_first(spark: SparkSession, sf: str) -> DataFrame:
    return _span(SEG.phrases(events.notes(spark, sf), SEG.SegmentationConfig(skip_first_beats=100.0)), "phrase_id")


@query(_with(f"{_RUNS} SELECT melid, phrase_id, {_SPAN} FROM p"))
def seg_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return _span(SEG.phrases(events.notes(spark, sf)), "phrase_id")


_MEMBERS = f"{_RUNS}, pn AS (SELECT d.*, p.phrase_id FROM d JOIN p USING (melid, run, chunk))"


@query(_with(f"{_MEMBERS}, i AS (SELECT *, lead(onset_beat) OVER (PARTITION BY melid, phrase_id ORDER BY onset_beat, note_idx) - onset_beat AS ioi FROM pn) SELECT melid, phrase_id, note_idx, round(ioi, 6) AS ioi FROM i WHERE ioi IS NOT NULL"))
def phrase_iois(spark: SparkSession, sf: str) -> DataFrame:
    out = SEG.phrase_iois(SEG.phrase_notes(events.notes(spark, sf)))
    return out.select("melid", "phrase_id", "note_idx", _r("ioi").alias("ioi"))


@query(
    _with(
        f"""{_MEMBERS}, i AS (SELECT *, row_number() OVER w AS k, lead(pitch) OVER w - pitch AS a, lead(pitch, 2) OVER w - lead(pitch) OVER w AS b, lead(pitch, 3) OVER w - lead(pitch, 2) OVER w AS c FROM pn WINDOW w AS (PARTITION BY melid, phrase_id ORDER BY onset_beat, note_idx))
        SELECT melid, phrase_id, concat_ws(',', a, b, c) AS signature FROM i WHERE k = 1 AND c IS NOT NULL"""
    )
)
def phrase_signature(spark: SparkSession, sf: str) -> DataFrame:
    out = G.signatures(SEG.phrase_notes(events.notes(spark, sf)), 3)
    return out.select("melid", "phrase_id", _joined("values").alias("signature"))


# order of notes


@query(_with("x AS (SELECT 1) SELECT melid, note_idx, coalesce(pitch, -1) AS pitch, round(onset_beat, 6) AS onset_beat FROM notes WHERE onset_beat >= 50 AND onset_beat < 120"))
def slice_notes(spark: SparkSession, sf: str) -> DataFrame:
    return SEQ.slice_notes(events.notes(spark, sf), 50.0, 120.0).select("melid", "note_idx", F.coalesce("pitch", F.lit(-1)).alias("pitch"), _r("onset_beat").alias("onset_beat"))


@query(_with("x AS (SELECT 1) SELECT melid, round(max(onset_beat + duration_beats), 6) AS total_beats FROM notes GROUP BY melid"))
def total_beats(spark: SparkSession, sf: str) -> DataFrame:
    return SEQ.total_beats(events.notes(spark, sf)).select("melid", _r("total_beats").alias("total_beats"))


@query(
    _with(
        """e AS (SELECT melid, floor(max(onset_beat)) AS final FROM notes GROUP BY melid), n AS (SELECT notes.*, final FROM notes JOIN e USING (melid)),
        s AS (SELECT melid, duration_beats, unnest(range(greatest(CAST(floor(onset_beat) AS BIGINT) - 11, 8), least(CAST(floor(onset_beat) AS BIGINT), CAST(final AS BIGINT) - 1) + 1)) AS start, onset_beat FROM n),
        w AS (SELECT melid, start, count(*) AS k, quantile_cont(duration_beats, 0.5) AS m FROM s WHERE start <= onset_beat AND onset_beat < start + 12 GROUP BY melid, start),
        b AS (SELECT melid, min(start) AS start FROM w WHERE k >= 3 AND m < 6.0 GROUP BY melid)
        SELECT e.melid, CAST(coalesce(b.start, 8) AS DOUBLE) AS start_beat FROM e LEFT JOIN b ON e.melid = b.melid"""
    )
)
def solo_start(spark: SparkSession, sf: str) -> DataFrame:
    return SEQ.solo_start(events.notes(spark, sf), window=12, longest=6.0)


@query(
    _with(
        """a AS (SELECT *, CASE WHEN pitch = lag(pitch) OVER w AND onset_beat - lag(onset_beat + duration_beats) OVER w <= 20.0 + 1e-9 THEN 0 ELSE 1 END AS new FROM notes WHERE pitch IS NOT NULL WINDOW w AS (PARTITION BY melid ORDER BY onset_beat, note_idx)),
        b AS (SELECT *, sum(new) OVER (PARTITION BY melid ORDER BY onset_beat, note_idx ROWS UNBOUNDED PRECEDING) AS run FROM a)
        SELECT melid, arg_min(note_idx, (onset_beat, note_idx)) AS note_idx, min(pitch) AS pitch, round(min(onset_beat), 6) AS onset_beat,
        round(arg_max(onset_beat + duration_beats, (onset_beat, note_idx)) - min(onset_beat), 6) AS duration_beats FROM b GROUP BY melid, run"""
    )
)
def merge_close_notes(spark: SparkSession, sf: str) -> DataFrame:
    out = SEQ.merge_close_notes(events.notes(spark, sf), max_gap=20.0, max_pitch_diff=0)
    return out.select("melid", "note_idx", "pitch", _r("onset_beat").alias("onset_beat"), _r("duration_beats").alias("duration_beats"))


@query()
def merge_close_notes_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = SEQ.merge_close_notes(events.notes(spark, sf), max_gap=20.0, max_pitch_diff=1)
    return out.select("melid", "note_idx", "pitch", _r("onset_beat").alias("onset_beat"), _r("duration_beats").alias("duration_beats"))


def _detected(spark: SparkSession, sf: str) -> DataFrame:
    """Notes with raw strengths of 0..1, from their place in the table."""
    n = events.notes(spark, sf).filter(F.col("pitch").isNotNull())
    return n.withColumn("velocity", (F.col("note_idx") * 37 % 100) / F.lit(100.0))


@query()
def monophonic_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return SEQ.monophonic(_detected(spark, sf)).select("melid", "note_idx", "pitch", _r("onset_beat").alias("onset_beat"), "velocity")


@query(
    _with(
        """d AS (SELECT *, (note_idx * 37 % 100) / 100.0::DOUBLE AS v, 440.0::DOUBLE * pow(2.0::DOUBLE, (pitch - 69) / 12.0::DOUBLE) AS hz FROM notes WHERE pitch IS NOT NULL)
        SELECT melid, note_idx, pitch, CAST(round_even(v * 127, 0) AS INT) AS velocity FROM d WHERE duration_beats >= 5 AND hz >= 200 AND hz <= 350 AND v >= 0.3"""
    )
)
def note_filter(spark: SparkSession, sf: str) -> DataFrame:
    return SEQ.filter_notes(_detected(spark, sf), 5.0, 200.0, 350.0, 0.3).select("melid", "note_idx", "pitch", "velocity")


@query(
    _with(
        """f AS (SELECT melid, note_idx AS frame, onset_beat AS time, event_type <> 'error' AS voiced, 200 + value AS f0 FROM notes JOIN events ON note_idx = event_id),
        g AS (SELECT *, lead(time) OVER (PARTITION BY melid ORDER BY frame) AS next, sum(CASE WHEN voiced AND f0 > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY melid ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM f),
        r AS (SELECT melid, run, min(frame) AS note_idx, min(time) AS onset, count(*) AS n, quantile_cont(f0, 0.5) AS m, arg_max_null(next, frame) AS stop, max(time) AS last FROM g WHERE voiced AND f0 > 0 GROUP BY melid, run)
        SELECT melid, note_idx, CAST(round_even(69 + 12 * log2(m / 440.0::DOUBLE), 0) AS INT) AS pitch, round(onset, 6) AS onset_beat, round(coalesce(stop, last) - onset, 6) AS duration_beats FROM r WHERE n >= 2 OR stop IS NULL"""
    )
)
def f0_to_notes(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    f = events.notes(spark, sf).join(e, F.col("note_idx") == F.col("event_id")).select("melid", F.col("note_idx").alias("frame"), F.col("onset_beat").alias("time"), (F.col("event_type") != "error").alias("voiced"), (200 + F.col("value")).alias("f0"))
    out = SEQ.frequencies_to_notes(f, min_length_ms=50.0)
    return out.select("melid", "note_idx", "pitch", _r("onset_beat").alias("onset_beat"), _r("duration_beats").alias("duration_beats"))


@query(
    _with(
        """h AS (SELECT melid, note_idx, pitch, 440.0::DOUBLE * pow(2.0::DOUBLE, (pitch - 69) / 12.0::DOUBLE) AS hz FROM notes WHERE pitch IS NOT NULL)
        SELECT melid, note_idx, round(hz, 6) AS hz, CAST(round_even(69 + 12 * log2(hz * 1.01 / 440.0::DOUBLE), 0) AS INT) AS midi FROM h"""
    )
)
def midi_hz(spark: SparkSession, sf: str) -> DataFrame:
    n = events.notes(spark, sf).filter(F.col("pitch").isNotNull()).withColumn("f", T.midi_to_hz(F.col("pitch")))
    return n.select("melid", "note_idx", _r("f").alias("hz"), T.hz_to_midi(F.col("f") * F.lit(1.01)).alias("midi"))


@query(_with("x AS (SELECT 1) SELECT melid, note_idx, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][pitch % 12 + 1] || CAST(pitch // 12 - 1 AS VARCHAR) AS name FROM notes WHERE pitch IS NOT NULL"))
def note_name(spark: SparkSession, sf: str) -> DataFrame:
    n = events.notes(spark, sf).filter(F.col("pitch").isNotNull())
    return n.select("melid", "note_idx", T.note_name(F.col("pitch")).alias("name"))


@query(_with("b AS (SELECT melid, note_idx, onset_beat / (60.0::DOUBLE / 90.0::DOUBLE) AS o, duration_beats / (60.0::DOUBLE / 90.0::DOUBLE) AS d FROM notes) SELECT melid, note_idx, round(o, 6) AS onset_beat, round(d, 6) AS duration_beats FROM b"))
def seconds_to_beats(spark: SparkSession, sf: str) -> DataFrame:
    n = SEQ.seconds_to_beats(events.notes(spark, sf), 90.0)
    return n.select("melid", "note_idx", _r("onset_beat").alias("onset_beat"), _r("duration_beats").alias("duration_beats"))


# sources


@query(_with("s AS (SELECT melid, count(*) AS n_notes FROM notes GROUP BY melid) SELECT s.melid, n_notes, performer, style FROM s LEFT JOIN meta ON s.melid = meta.melid"))
def metadata_left_join(spark: SparkSession, sf: str) -> DataFrame:
    n = events.notes(spark, sf).groupBy("melid").agg(F.count(F.lit(1)).alias("n_notes"))
    return n.join(events.metadata(spark, sf), "melid", "left").select("melid", "n_notes", "performer", "style")


_SIGNATURES = ["4/4", "3/4", "6/8", "x/4", "5", "", "12/8", "4/y"]


@query(
    "WITH s AS (SELECT c_custkey, [" + ", ".join(f"'{x}'" for x in _SIGNATURES) + "][CAST(c_custkey % 8 AS INT) + 1] AS s FROM customer), p AS (SELECT *, string_split(s, '/') AS p FROM s), "
    "q AS (SELECT *, CASE WHEN len(p) = 2 THEN TRY_CAST(p[1] AS INT) END AS a, CASE WHEN len(p) = 2 THEN TRY_CAST(p[2] AS INT) END AS b FROM p) "
    "SELECT c_custkey, CASE WHEN a IS NULL OR b IS NULL THEN 4 ELSE a END AS num, CASE WHEN a IS NULL OR b IS NULL THEN 4 ELSE b END AS den FROM q"
)
def time_sig_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey")
    text = F.element_at(F.array(*[F.lit(x) for x in _SIGNATURES]), (F.col("c_custkey") % 8 + 1).cast("int"))
    num, den = T.time_signature(F.col("s"))
    return c.withColumn("s", text).select("c_custkey", num.alias("num"), den.alias("den"))


@query(
    """SELECT c_custkey, 'db' AS database, 'm' || CAST(c_custkey AS VARCHAR) AS melid, CAST(c_custkey % 7 AS INT) AS frequency, c_name AS performer, 'A tune' AS title,
    CASE WHEN c_custkey % 3 = 0 THEN 1950 + CAST(c_custkey % 50 AS INT) ELSE 0 END AS year, 'tp' AS instrument, c_custkey % 100 / 4.0::DOUBLE AS start_position,
    CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 1.5::DOUBLE END AS duration, 0.75::DOUBLE AS similarity, CAST(c_custkey % 4 AS INT) AS edit_distance FROM customer WHERE c_custkey % 11 <> 0"""
)
def result_html_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    k = F.col("c_custkey")
    cells = [
        F.lit("db"), F.concat(F.lit("m"), k.cast("string")), F.lit("1 2"), (k % 7).cast("string"), F.lit("3"), F.concat(F.lit(" <b>"), F.col("c_name"), F.lit("</b>\n")),
        F.lit("A  <i>tune</i>"), F.when(k % 3 == 0, (1950 + k % 50).cast("string")).otherwise("n/a"), F.lit("tp"), (k % 100 / F.lit(4.0)).cast("string"),
        F.when(k % 5 == 0, F.lit("?")).otherwise("1.5"), F.lit("9"), F.lit("up"), F.when(k % 11 == 0, F.lit("bad")).otherwise("0.75"), (k % 4).cast("string"),
    ]
    row = F.concat(F.lit("<table><tr><th>x</th></tr><TR class='r'>"), *[F.concat(F.lit("<td a=1>"), x, F.lit("</td>")) for x in cells], F.lit("</TR></table>"))
    return files.parse_result_pages(c.select("c_custkey", row.alias("html"))).drop("row_no").withColumn("year", F.coalesce("year", F.lit(0)))


@query(
    """WITH m AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_linenumber) AS s FROM lineitem WHERE l_quantity > 5 GROUP BY l_orderkey HAVING count(*) >= 4)
    SELECT 'wjazzd-' || CAST(o_orderkey AS VARCHAR) AS melid, 'Tune ' || CAST(o_orderkey AS VARCHAR) AS title, c_name AS performer, CAST(year(o_orderdate) AS INT) AS year, 'Trumpet' AS instrument, n AS n_notes
    FROM orders JOIN m ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey"""
)
def solo_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The solo database's joins and filters, on orders as solos and their lines as notes."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_name")
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    key = F.col("o_orderkey")
    solo = o.join(c, o.o_custkey == c.c_custkey, "left").select(
        key.alias("melid"), F.concat(F.lit("Tune "), key.cast("string")).alias("title"), F.lit(None).cast("string").alias("titleaddon"), F.col("c_name").alias("performer"),
        F.lit("tp").alias("instrument"), F.lit(None).cast("string").alias("style"), F.lit(90.0).alias("avgtempo"), F.lit("fast").alias("tempoclass"), F.lit("C").alias("key"),
        F.lit("4/4").alias("signature"), F.lit(2).alias("chorus_count"), key.alias("compid"), key.alias("recordid"),
    )
    melody = line.select(F.col("l_orderkey").alias("melid"), F.col("l_linenumber").cast("double").alias("onset"), F.when(F.col("l_quantity") > 5, F.lit(60.0)).otherwise(0.0).alias("pitch"), F.lit(0.5).alias("duration"))
    comp = o.select(key.alias("compid"), F.lit(None).cast("string").alias("composer"), F.lit(None).cast("string").alias("form"))
    rec = o.select(key.alias("recordid"), F.lit("a").alias("artist"), F.lit("t").alias("recordtitle"), F.col("o_orderdate").cast("date").cast("string").alias("releasedate"))
    notes, meta = solos_from_tables(solo, melody, comp, rec)
    return meta.join(notes.groupBy("melid").agg(F.count(F.lit(1)).alias("n_notes")), "melid").select("melid", "title", "performer", "year", "instrument", "n_notes")


@query(_with("x AS (SELECT 1) SELECT melid, string_agg(coalesce(CAST(pitch AS VARCHAR), '-'), ' ' ORDER BY onset_beat, note_idx) AS pitches FROM notes GROUP BY melid"))
def solos_as_rows(spark: SparkSession, sf: str) -> DataFrame:
    from motif_engine.schema import to_solos

    pitches = F.transform("notes", lambda n: F.coalesce(n["pitch"].cast("string"), F.lit("-")))
    return to_solos(events.notes(spark, sf)).select("melid", F.array_join(pitches, " ").alias("pitches"))


@query(_with("x AS (SELECT 1) SELECT melid, note_idx FROM notes WHERE duration_beats > 0 AND (pitch IS NULL OR pitch BETWEEN 0 AND 127)"))
def validated_notes(spark: SparkSession, sf: str) -> DataFrame:
    from motif_engine.schema import validate_notes

    return validate_notes(events.notes(spark, sf), "drop").select("melid", "note_idx")
