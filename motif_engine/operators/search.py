"""Approximate pattern search: grams ranked by normalised edit distance."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motif_engine.functions import transforms as T
from motif_engine.operators import grams as G

#: Batch searches broadcast their queries; more of them go in several batches.
BATCH = 1000


@dataclass(frozen=True)
class SearchRequest:
    """A search over one or more databases; validate() raises ValueError."""

    pattern: list[int]
    databases: tuple[str, ...] = ("events",)
    transformation: str = "interval"
    min_similarity: float = 0.8
    max_length_difference: int = 0
    max_edit_distance: int | None = None
    min_frequency: int = 1
    limit: int = 50

    def validate(self) -> SearchRequest:
        def need(fine: bool, what: str) -> None:
            if not fine:
                raise ValueError(what)

        need(2 <= len(self.pattern) <= 20 and all(isinstance(v, int) for v in self.pattern), "a pattern has 2 to 20 integers")
        T.check(self.transformation)
        need(0.5 <= self.min_similarity <= 1.0, "min_similarity is in 0.5..1")
        need(0 <= self.max_length_difference <= 5, "max_length_difference is in 0..5")
        need(self.max_edit_distance is None or 0 <= self.max_edit_distance <= 20, "max_edit_distance is in 0..20")
        need(self.min_frequency >= 1, "min_frequency is at least 1")
        need(1 <= self.limit <= 500, "limit is in 1..500")
        need(len(self.databases) >= 1, "at least one database is named")
        return self


def similarity(distance: Column, longest: Column | int) -> Column:
    """1 - distance / longest; two empty sequences are alike."""
    longest = F.lit(longest) if isinstance(longest, int) else longest
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - distance / longest)


def pattern_similarity(a: list[int], b: list[int]) -> tuple[int, float]:
    """Edit distance and similarity of two short sequences, on the driver."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    longest = max(len(a), len(b))
    return row[-1], 1.0 - row[-1] / longest if longest else 1.0


def search_grams(
    g: DataFrame, pattern: list[int], min_similarity: float = 0.8, max_length_difference: int = 0,
    max_edit_distance: int | None = None, min_frequency: int = 1, limit: int | None = None,
) -> DataFrame:
    """g with edit_distance and similarity, best first (ties by melid, pos, length); limit None keeps all.

    Lengths are cut first, then the bounded edit distance, which gives up early beyond what the similarity allows.
    """
    if not 0.5 <= min_similarity <= 1.0:
        raise ValueError("min_similarity is in 0.5..1")
    if max_length_difference < 0:
        raise ValueError("max_length_difference is at least 0")
    n = len(pattern)
    if min_frequency > 1:
        often = G.frequencies(g).filter(F.col("n") >= min_frequency).select("values")
        g = g.join(often, "values", "left_semi").select(*g.columns)
    size = F.size("values")
    g = g.filter(size.between(max(0, n - max_length_difference), n + max_length_difference))
    cap = math.ceil((1 - min_similarity) * (n + max_length_difference) + 1e-9)
    if max_edit_distance is not None:
        cap = min(cap, max_edit_distance)
    g = g.withColumn("edit_distance", F.levenshtein("enc", F.lit(G.encode(pattern)), cap)).filter(F.col("edit_distance") >= 0)
    g = g.withColumn("similarity", similarity(F.col("edit_distance"), F.greatest(size, F.lit(n)))).filter(F.col("similarity") >= min_similarity)
    if limit is None:
        return g
    return g.orderBy(F.desc("similarity"), "melid", "pos", size).limit(limit)


def search_notes(notes: DataFrame, request: SearchRequest, metadata: DataFrame | None = None, expand_lengths: bool = False, limit: bool = True) -> DataFrame:
    """Searches notes. expand_lengths also builds grams that are shorter or longer by max_length_difference."""
    request.validate()
    n, d = len(request.pattern), request.max_length_difference if expand_lengths else 0
    g = G.grams_of_sizes(notes, list(range(max(2, n - d), n + d + 1)), request.transformation) if d else G.grams(notes, n, request.transformation)
    found = search_grams(
        g, request.pattern, request.min_similarity, request.max_length_difference, request.max_edit_distance, request.min_frequency,
        request.limit if limit else None,
    )
    return found if metadata is None else found.join(metadata, "melid", "left")


def search_batch(g: DataFrame, patterns: dict[str, list[int]], min_similarity: float) -> DataFrame:
    """Many patterns against grams of their lengths: query, melid, pos, onset_beat, edit_distance, similarity.

    The patterns are expanded next to each distinct gram of their lengths only; what is alike is joined back to the grams.
    """
    if not 0 < len(patterns) <= BATCH:
        raise ValueError(f"1 to {BATCH} patterns a batch")
    each = F.array(*[F.struct(F.lit(q).alias("query"), F.lit(G.encode(p)).alias("p"), F.lit(len(p)).alias("n")) for q, p in sorted(patterns.items())])
    lengths = sorted({len(p) for p in patterns.values()})
    distinct = g.filter(F.size("values").isin(lengths)).select("enc").distinct()
    fitting = F.filter(each, lambda q: q["n"] == F.length("enc"))
    alike = distinct.withColumn("q", F.explode(fitting)).withColumn("edit_distance", F.levenshtein("enc", F.col("q.p")))
    alike = alike.withColumn("similarity", similarity(F.col("edit_distance"), F.col("q.n"))).filter(F.col("similarity") >= min_similarity)
    rows = g.select("melid", "pos", "onset_beat", "enc").join(alike.select("enc", "q.query", "edit_distance", "similarity"), "enc")
    return rows.select("query", "melid", "pos", "onset_beat", "edit_distance", "similarity")


@dataclass
class MergedSearch:
    """matches: best match of each solo over all databases; errors: by database, of those that failed."""

    matches: DataFrame | None
    errors: dict[str, str] = field(default_factory=dict)


def merge(results: list[tuple[str, DataFrame]], limit: int) -> DataFrame:
    """One row per database and solo, the best and among equals the first; then by similarity, distance and year."""
    from pyspark.sql import Window as W

    rows = None
    for k, (name, df) in enumerate(results):
        df = df.withColumn("database", F.lit(name)).withColumn("_arrival", F.lit(k))
        rows = df if rows is None else rows.unionByName(df, allowMissingColumns=True)
    w = W.partitionBy("database", "melid").orderBy(F.desc("similarity"), "_arrival", "pos")
    best = rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank", "_arrival")
    return best.orderBy(F.desc("similarity"), "edit_distance", F.coalesce("year", F.lit(0)), "database", "melid").limit(limit)


def search_databases(sources: dict[str, Callable[[], tuple[DataFrame, DataFrame]]], request: SearchRequest) -> MergedSearch:
    """Each named database is searched with its own limit, then all are merged; one that fails leaves an error."""
    request.validate()
    found, errors = [], {}
    for name in request.databases:
        if name not in sources:
            errors[name] = f"Unknown corpus: {name}"
            continue
        try:
            notes, metadata = sources[name]()
            rows = search_notes(notes, request, metadata)
            # run once, and here, so that what fails leaves an error; a search has at most limit rows, 500
            found.append((name, notes.sparkSession.createDataFrame(rows.collect(), rows.schema)))
        except Exception as e:  # a failing database must not hide the others' results
            errors[name] = f"{type(e).__name__}: {e}"
    return MergedSearch(merge(found, request.limit) if found else None, errors)
