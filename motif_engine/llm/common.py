"""Shared helpers: tables in the shared folder, graph components, small column tools."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that operators add to a caller's rows start with this, so that no name clashes.
OWN = "__llm_"

_paths: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives executors this package, once per application; Spark's file server carries it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(), "motif_engine_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode, and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="motif-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        _paths.append(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/motif/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    for path in _paths:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before this process
            pass


atexit.register(_remove_all)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


#: A node with more links than this is a hub; its links don't meet in one task. With more links than HUB * HUBS in all,
#: hubs have more, so that there are 2 * HUBS of them at most (two numbers each), which is what is broadcast.
HUB = 4096
HUBS = 100_000
#: Links that one task unites; more than these take rounds, whose plans and jobs are what fills the driver's memory.
UNITED = 1 << 18


def with_least(both: DataFrame, low: DataFrame, hub: int | None) -> DataFrame:
    """both (u, v) and m, the least number of u's row in low (u, m, n); a hub's links stay where they are. None: there is no hub."""
    if hub is None:
        return both.join(low.select("u", "m"), "u")
    hubs = F.broadcast(low.filter(F.col("n") > hub).select("u", F.col("m").alias("hub_m")))
    marked = both.join(hubs, "u", "left")
    rest = marked.filter("hub_m is null").drop("hub_m").join(low.filter(F.col("n") <= hub).select("u", "m"), "u")
    return marked.filter("hub_m is not null").withColumnRenamed("hub_m", "m").unionByName(rest)


def connected_components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(a, b) links to (id, component): the smallest id that links reach, for each id in edges.

    Up to UNITED links are united by one task. More of them alternate large-star and small-star until the edges stay as
    they are, however many rounds that takes; every round is a table in the shared folder. Degrees are unbounded there:
    minima use partial aggregation, and a hub's minimum is broadcast to its links, so that no task holds all links of a node.
    """
    e = (
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    e, mark = table(e, "edges"), None
    if e.count() <= UNITED:
        ship(e.sparkSession)
        return e.coalesce(1).mapInArrow(_classes, "id long, component long")
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            break
        mark, limit = tuple(now), max(hub, now[0] // HUBS)
        limit = limit if now[0] > limit else None  # no node has more links than there are

        def least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
            """links and their minima; where there can be hubs, both are tables, so that the plan of a round stays small."""
            links = links if limit is None else table(links, "links")
            low = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
            return links, low if limit is None else table(low, "least")

        both, low = least(_both_ways(e, "u", "v", "v", "u"))
        large = with_least(both, low, limit).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, low = least(large.filter("u <> v").distinct())
        e = table(_both_ways(with_least(large, low, limit), "u", "m", "v", "m").filter("u <> v").distinct(), "stars")
    return _both_ways(e, "u", "v", "v", "v").toDF("id", "component").distinct()


def united(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """low (each index's root, the smallest of its component) after links between a and b."""
    while True:
        x, y = low[a], low[b]
        apart = x != y
        if not apart.any():
            return low
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = low[low]
            if (up == low).all():
                break
            low = up


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v), all links in one task, to (id, component)."""
    rows = [tuple(b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("u", "v")) for b in batches if b.num_rows]
    if rows:
        u, v = (np.concatenate(x) for x in zip(*rows, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = united(np.arange(len(ids)), at[: len(u)], at[len(u) :])
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[low])], ["id", "component"])


def _both_ways(rows: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """(u, v): columns a and b of each row, and c and d; rows are read once."""
    return rows.select(F.inline(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(c).alias("u"), F.col(d).alias("v")))))


def whole_text(col: str | Column = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
