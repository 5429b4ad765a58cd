"""Embedding near-dedup: exact metric range join over pivot cells.

Vectors are compared by cosine; on unit vectors a cosine of at least s is a chord distance of at most
r = sqrt(2 - 2 s), a metric. Equal vectors meet first and go on as one with a weight. Pivots come from a bounded
sample by farthest-first choice; each vector lives in the cell of its nearest pivot. A vector visits another
cell only if the triangle inequality lets a member of it be within r: its distance to that pivot and to each of the
first REFERENCES pivots is within r of the range that the cell's members have, and its distance to the bisecting plane
of both pivots is at most r. Of two cells only the one of the higher index is visited, so each pair meets once. Cells
join independently; a cell over TILE vectors is dealt in tiles, rings of its members by their distance to its pivot, and
a vector visits the rings within r of its own distance. Single precision decides pairs that are clearly within or
outside, double precision the rest. Tasks return link counts and, of the links, a spanning forest only.

Edge cases: null vectors, empty ones, zero ones and those with null or non-finite components link with nothing;
vectors of different lengths don't link; rows of one vec_id are separate vectors, whether these are equal or not,
and link by their vectors only; a null vec_id has no links, a null component and isn't kept; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HUB, HUBS, connected_components, parts, ship, table, union, with_least

#: Rows that pivots are chosen from; the driver gets these.
SAMPLE = 4096
#: Vectors a cell holds on average, and at most so many pivots.
CELL = 4096
MOST_PIVOTS = 1024
TILE = 2048
#: Pivots that all cells have ranges of distances to.
REFERENCES = 16
#: Different lengths of vectors that one table can hold.
MOST_LENGTHS = 64
_QUANTILES = 256
_VISITORS_AT_ONCE = 4096
#: Single precision is trusted beyond this distance from the threshold.
_MARGIN = 1e-4


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def farthest_first(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(n, len(x)):
        k = int(near.argmin())
        chosen.append(k)
        near = np.maximum(near, x @ x[k])
    return x[chosen]


def _assign(pivots: np.ndarray):
    """Rows (id, mult, v) to the same with home, the nearest pivot, and far, the distance to it."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dot = _unit(_matrix(b.column("v"))) @ pivots.T
            home = dot.argmax(axis=1)
            far = np.sqrt(np.maximum(0, 2 - 2 * dot[np.arange(len(dot)), home]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mult"), b.column("v"), pa.array(home.astype(np.int32)), pa.array(far)], ["id", "mult", "v", "home", "far"])

    return assign


def _ranged(pivots: np.ndarray):
    """Rows (home, k, low, high): a task's least and largest distance of a cell's members to reference k."""

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots[:REFERENCES]
        low = np.full((len(pivots), len(references)), np.inf)
        high = np.full(low.shape, -np.inf)
        for b in batches:
            if b.num_rows:
                home = b.column("home").to_numpy()
                d = np.sqrt(np.maximum(0, 2 - 2 * _unit(_matrix(b.column("v"))) @ references.T))
                np.minimum.at(low, home, d)
                np.maximum.at(high, home, d)
        home, k = np.nonzero(np.isfinite(low))
        yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(low[home, k]), pa.array(high[home, k])], ["home", "k", "low", "high"])

    return ranged


class _Cells:
    """What tasks know of all cells: the ranges of distances to the references, and the rings that the members are cut into."""

    def __init__(self, pivots: np.ndarray, r: float):
        n = len(pivots)
        self.pivots, self.r, self.top = pivots, r, np.zeros(n)
        self.low, self.high = np.full((n, min(n, REFERENCES)), np.inf), np.full((n, min(n, REFERENCES)), -np.inf)
        #: Of all rings, those of one cell after those of another: the least distance to the pivot; and each cell's first ring.
        self.rings, self.first = np.zeros(0), np.zeros(n + 1, np.int64)
        self.between = np.sqrt(np.maximum(1e-18, 2 - 2 * pivots @ pivots.T))

    def home_ring(self, home: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The ring of each vector within its cell."""
        out = np.zeros(len(home), np.int64)
        for c in np.unique(home).tolist():
            at = home == c
            out[at] = np.maximum(np.searchsorted(self.rings[self.first[c] : self.first[c + 1]], far[at], "right") - 1, 0)
        return out

    def visits(self, x: np.ndarray, home: np.ndarray, ring: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, cell, first ring, rings) beyond each vector's own ring that it has to visit."""
        r = self.r + 1e-9
        square = np.maximum(0, 2 - 2 * x @ self.pivots.T)
        d = np.sqrt(square)
        near = ((square - square[np.arange(len(home)), home][:, None]) / (2 * self.between[home]) <= r) & (np.arange(len(self.pivots)) > home[:, None])
        for k in range(self.low.shape[1]):
            near &= (d[:, k, None] >= self.low[:, k] - r) & (d[:, k, None] <= self.high[:, k] + r)
        row, cell = np.nonzero(near)
        at = np.append(d[row, cell], far)
        least = np.append(np.zeros(len(row), np.int64), ring + 1)  # of the own cell only the later rings
        row, cell = np.append(row, np.arange(len(home))), np.append(cell, home)
        low, high = np.zeros(len(row), np.int64), np.full(len(row), -1)
        for c in np.unique(cell).tolist():
            some = np.flatnonzero((cell == c) & (at <= self.top[c] + r))
            rings = self.rings[self.first[c] : self.first[c + 1]]
            low[some] = np.maximum(np.searchsorted(rings, at[some] - r, "right") - 1, least[some])
            high[some] = np.searchsorted(rings, at[some] + r, "right") - 1
        n = np.maximum(high - low + 1, 0)
        some = n > 0
        return row[some], cell[some], low[some], n[some]


def _dealt(cells: _Cells):
    """Rows (cell, tile, visitor, id, mult, v) of each vector's home and of the rings that it visits."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, _VISITORS_AT_ONCE):
                b = whole.slice(s, _VISITORS_AT_ONCE)

                def rows(row: np.ndarray, cell: np.ndarray, tile: np.ndarray, visitor: int, b: pa.RecordBatch = b) -> Iterator[pa.RecordBatch]:
                    for k in range(0, len(row), 10_000):
                        cut = slice(k, k + 10_000)
                        take = pa.array(row[cut])
                        columns = [cell[cut].astype(np.int32), tile[cut].astype(np.int32), np.full(len(take), visitor, np.int8)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(b.column(c).take(take) for c in ("id", "mult", "v"))], ["cell", "tile", "visitor", "id", "mult", "v"])

                home, far = b.column("home").to_numpy().astype(np.int64), b.column("far").to_numpy()
                ring = cells.home_ring(home, far)
                yield from rows(np.arange(len(home)), home, ring, 0)
                row, cell, low, n = cells.visits(_unit(_matrix(b.column("v"))), home, ring, far)
                cuts = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + 1_000_000, 1_000_000)).tolist()
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    m = n[i:j]
                    yield from rows(np.repeat(row[i:j], m), np.repeat(cell[i:j], m), np.repeat(low[i:j], m) + _counted(m), 1)

    return dealt


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def _near(a: np.ndarray, b: np.ndarray, cosine: float) -> np.ndarray:
    s = a.astype(np.float32) @ b.astype(np.float32).T
    near = s >= cosine
    i, j = np.nonzero(np.abs(s - np.float32(cosine)) < _MARGIN)
    for k in range(0, len(i), 100_000):
        p, q = i[k : k + 100_000], j[k : k + 100_000]
        near[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= cosine
    return near


class _Tile:
    """The home vectors of one tile, compared with each other and with visitors as these arrive."""

    def __init__(self, ids: np.ndarray, mult: np.ndarray, x: np.ndarray, cosine: float):
        self.ids, self.mult, self.x, self.cosine = ids, mult, x, cosine
        self.low, self.count = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        near = _near(x, x, cosine)
        np.fill_diagonal(near, False)
        self.count += near @ mult
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            self._merge(np.append(np.flatnonzero(near[i]), i))

    def _merge(self, at: np.ndarray) -> None:
        low = self.low[at]
        if (low != low[0]).any():
            low = np.unique(low)
            self.low[np.isin(self.low, low)] = low[0]

    def visit(self, ids: np.ndarray, mult: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(a, b, n): each linked visitor, a home vector it links with, the weight of all of these."""
        near = _near(self.x, x, self.cosine)
        self.count += near @ mult
        linked = np.flatnonzero(near.any(axis=0))
        for j in linked.tolist():
            self._merge(np.flatnonzero(near[:, j]))
        near = near[:, linked]
        return ids[linked], self.ids[near.argmax(axis=0)], self.mult @ near

    def close(self) -> tuple[np.ndarray, ...]:
        own = self.count > 0
        return self.ids[own], self.ids[self.low[own]], self.count[own]


def _joined(cosine: float):
    """For mapInArrow over rows in the order (cell, tile, visitor): (a, b, n), see _Tile."""

    def batch(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in rows], ["a", "b", "n"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile, homes = None, None, []

        def opened() -> _Tile | None:
            return _Tile(*(np.concatenate(c) for c in zip(*homes, strict=True)), cosine) if homes else None

        for b in batches:
            if not b.num_rows:
                continue
            cells, tiles, visitor = (b.column(c).to_numpy() for c in ("cell", "tile", "visitor"))
            ids, mult, x = b.column("id").to_numpy(), b.column("mult").to_numpy(), _unit(_matrix(b.column("v")))
            change = np.flatnonzero((np.diff(cells) != 0) | (np.diff(tiles) != 0) | (np.diff(visitor) != 0)) + 1
            for s, e in zip([0, *change.tolist()], [*change.tolist(), len(ids)], strict=True):
                if (cells[s], tiles[s]) != key:
                    tile = tile or opened()
                    if tile:
                        yield batch(tile.close())
                    key, tile, homes = (cells[s], tiles[s]), None, []
                if not visitor[s]:
                    homes.append((ids[s:e], mult[s:e], x[s:e]))
                    continue
                tile = tile or opened()
                for k in range(s, e if tile else s, _VISITORS_AT_ONCE):
                    cut = slice(k, min(e, k + _VISITORS_AT_ONCE))
                    yield batch(tile.visit(ids[cut], mult[cut], x[cut]))
        tile = tile or opened()
        if tile:
            yield batch(tile.close())

    return joined


def _range_join(reps: DataFrame, cosine: float) -> DataFrame:
    """reps (id, mult, v) of one length to (a, b, n): a links with b, and so far with vectors of weight n."""
    n, columns = reps.count(), f"id long, mult long, v {reps.schema['v'].dataType.simpleString()}"
    pivots = farthest_first(_unit(np.array([r.v for r in reps.select("v").orderBy(F.xxhash64("id")).limit(SAMPLE).collect()])), min(MOST_PIVOTS, -(-n // CELL)))
    assigned = table(reps.mapInArrow(_assign(pivots), f"{columns}, home int, far double"), "cells")
    cells = _Cells(pivots, math.sqrt(2 - 2 * cosine))
    found = assigned.mapInArrow(_ranged(pivots), "home int, k int, low double, high double").groupBy("home", "k").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    for c in found.collect():  # MOST_PIVOTS * REFERENCES rows at most
        cells.low[c.home, c.k], cells.high[c.home, c.k] = c.low, c.high
    sizes = assigned.groupBy("home").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("top"), F.percentile_approx("far", [i / _QUANTILES for i in range(_QUANTILES + 1)]).alias("q"))
    rings = [np.zeros(1)] * len(pivots)
    for c in sizes.collect():  # MOST_PIVOTS rows at most
        tiles = -(-c.n // TILE)
        cells.top[c.home] = c.top
        rings[c.home] = np.append(0.0, np.interp(np.arange(1, tiles) / tiles, np.linspace(0, 1, _QUANTILES + 1), c.q))
    cells.rings, cells.first = np.concatenate(rings), np.cumsum([0, *map(len, rings)])
    rows = assigned.mapInArrow(_dealt(cells), f"cell int, tile int, visitor byte, {columns}")
    rows = rows.repartition(max(parts(reps.sparkSession), min(len(cells.rings), 100_000)), "cell", "tile").sortWithinPartitions("cell", "tile", "visitor")
    return rows.mapInArrow(_joined(cosine), "a long, b long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"  # floats are kept as such, for they move; all arithmetic is in doubles
    rows = vectors.select(F.col(ident).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    fine = F.coalesce(F.col("vec_id").isNotNull() & finite, F.lit(False))
    keyed = rows.withColumn("key", F.when(fine, F.unhex(F.sha2(F.col("v").cast("string"), 256))))
    reps = keyed.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v"))
    # a distinct vector has a number of its own: rows of one vec_id can have several
    reps = table(reps.withColumn("id", F.monotonically_increasing_id()), "vectors")
    lengths = [x[0] for x in reps.select(F.size("v")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of over {MOST_LENGTHS} lengths")
    if not lengths:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = table(union([_range_join(reps.filter(F.size("v") == d).select("id", "mult", "v"), cosine) for d in lengths]), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "id")
    classes = connected_components(found.filter("a <> b").select("a", "b"))
    info = reps.select("key", "id", "mult", "first").join(counts, "id", "left").join(classes, "id", "left")
    info = table(info.select("key", "first", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("u")), "named")
    least = table(info.groupBy("u").agg(F.min("first").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    info = with_least(info, least, max(HUB, least.count() // HUBS)).select("key", "n_links", F.col("m").alias("component_id"))
    out = keyed.select("vec_id", "key").join(table(info, "classes"), "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
