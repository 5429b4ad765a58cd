"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents, in a fixed order, cut into slices of at most SLICE ids. In each round, which
stands for one window of a sequence's length, a queue's deficit grows by its quantum, the share of the window that
its target gives it, and the queue serves slices from its head as long as the deficit covers them; what is left
over carries to the next round. Weights are the targets, or by default the queues' sizes, so that all queues end
together; a queue that ends early leaves the window to the others. Served slices form one stream, which is cut at each
window's end, so that most documents stay whole and no window but the last is short.

A queue starts with a deficit of its own, a seeded part of its first slice, so that queues of one kind neither wait nor
come together. Its deficit after any round follows from what it has served: the slice that ends at place p of its
queue is served in round ceil((p - first deficit) / quantum). So tasks need no state of one another; a deficit carries over partitions as it
does over windows. Slices are sorted by (round, queue, place) in segments of about SEGMENT ids, whose sizes, SEGMENTS
numbers at most, are summed on the driver and give each segment its place in the stream. Ids are shuffled once, for that
sort. Sources are never merged, whatever their number, and none is collected.

Edge cases: a null text counts as empty and has the end id only; a null source is a queue of its own; repeated
rows are packed each; a document longer than a slice is served in several; only the last sequence can be short; an
empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts, ship, table
from .token_ids import encoder, vocabulary_path

LENGTH = 2048
#: Ids of a document that are served at once. Smaller slices bring each window nearer to the targets and cut documents more.
SLICE = 256
#: Ids of a segment, and how many segments there are at most, by larger ones.
SEGMENT = 1 << 18
SEGMENTS = 100_000
#: Ids of a task in the sort.
_TASK = 1 << 26
#: Rows (bucket, queue) that are joined by broadcast; more are joined by shuffle.
BROADCAST_PLACES = 500_000
#: The least weight, of the largest one.
_LEAST = 1e-6
_PHASES = 1 << 20
_TEXTS_AT_ONCE = 256


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, text: str, ident: str, queue: Column) -> DataFrame:
    """A table of (bucket, queue, place, n, doc_id, ids): place counts the ids of the bucket's queue before the document."""
    ship(docs.sparkSession)

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, bucket = encoder(vocabulary), TaskContext.get().partitionId()
        end, so_far = np.array([end_id], encode.dtype).tobytes(), {}
        for pdf in batches:
            for k in range(0, len(pdf), _TEXTS_AT_ONCE):
                cut = pdf.iloc[k : k + _TEXTS_AT_ONCE]
                ids = [b + end for b in encode.encode(cut["text"].tolist())]
                n = [len(b) // encode.dtype.itemsize for b in ids]
                place = []
                for q, m in zip(cut["queue"], n, strict=True):
                    place.append(so_far.get(q, 0))
                    so_far[q] = place[-1] + m
                yield pd.DataFrame({"bucket": bucket, "queue": cut["queue"], "place": place, "n": n, "doc_id": cut["doc_id"], "ids": ids})

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), queue.alias("queue"))
    out = rows.select("doc_id", "text", "queue").mapInPandas(_nullable(encoded), "bucket int, queue string, place long, n long, doc_id long, ids binary")
    return table(out, "tokens")


def _nullable(function):
    """Keeps null identifiers apart from floats."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return function(pdf.assign(doc_id=pdf["doc_id"].astype("Int64")) for pdf in batches)

    return wrapped


def _quanta(queues: DataFrame, weights: dict[str, float] | None, length: int) -> tuple[DataFrame, list[tuple[float, float]] | None]:
    """queues (queue, size) with quantum, and, where queues can end early, the fluid stream's pieces (end, rate)."""
    total, n = queues.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not weights:
        return queues.withColumn("quantum", F.col("size") * F.lit(length) / F.lit(float(total))), None
    top = max(weights.values())
    weights = {k: max(w, _LEAST * top) for k, w in weights.items()}
    least, name = min(weights.values()), F.regexp_replace("queue", "^=", "")
    named = sorted(r.q for r in queues.select(name.alias("q")).filter(F.col("q").isin(list(weights))).collect())
    whole = math.fsum([weights[q] for q in named] + [least * (n - len(named))])
    own = F.create_map(*[F.lit(x) for q, w in sorted(weights.items()) for x in (q, float(w))])
    queues = queues.withColumn("quantum", F.coalesce(F.try_element_at(own, name), F.lit(least)) * F.lit(length / whole))
    # queues of one quantum and nearly one size are one piece: this decides on the segments' sizes only
    pieces = queues.groupBy("quantum", F.floor(4 * F.log2("size")).alias("scale")).agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return queues, sorted((r["size"] / r.quantum, r.n * r.quantum) for r in pieces.collect())


def _segments(pieces: list[tuple[float, float]], segment: int) -> np.ndarray:
    """The rounds at which segments of so many ids end, were ids divisible."""
    end, rate = np.array(pieces).T
    times = np.unique(np.append(0.0, end))
    served = (np.minimum(times[:, None], end) * rate).sum(axis=1)
    return np.interp(np.arange(segment, served[-1], segment, dtype=float), served, times)


def pack(
    docs: DataFrame, vocabulary: str, end_id: int = 1, length: int = LENGTH, weights: dict[str, float] | None = None,
    text: str = "text", ident: str = "doc_id", source: str = "source", slice_ids: int = SLICE, segment_ids: int = SEGMENT,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (uint32, little-endian bytes), doc_tokens, sequence_id, offset, queue.

    weights: target share of a source's ids in every window; a source that isn't named has the least of them.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    tokens = tokenized(docs, vocabulary, end_id, text, ident, name)
    width = np.dtype("<u4" if encoder(vocabulary).dtype.itemsize == 4 else "<u2")
    sums = table(tokens.groupBy("bucket", "queue").agg(F.sum("n").alias("n")), "sums")
    queues = table(sums.groupBy("queue").agg(F.sum("n").alias("size")), "queues")
    total = queues.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string")
    queues, pieces = _quanta(queues, weights, length)
    queues = queues.withColumn("credit", F.pmod(F.xxhash64("queue"), F.lit(_PHASES)) / F.lit(float(_PHASES)) * F.least(F.lit(slice_ids), "size"))
    before = W.partitionBy("queue").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    places = sums.select("bucket", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).join(queues.drop("size"), "queue")
    places = table(places, "places")
    if places.count() <= BROADCAST_PLACES:
        places = F.broadcast(places)
    segment = max(segment_ids, -(-total // SEGMENTS))
    if pieces is None:
        number = F.floor(F.col("round") * F.lit(length) / F.lit(float(segment)))
    else:
        ends = _segments(pieces, segment)
        number = F.pandas_udf(lambda r: pd.Series(np.searchsorted(ends, r.to_numpy(np.float64))), "long")("round")

    def slices(*keep: str) -> DataFrame:
        rows = tokens.select("bucket", "queue", "place", "n", *keep).join(places, ["bucket", "queue"])
        rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(slice_ids).cast("long"))))
        rows = rows.withColumn("size", F.least(F.lit(slice_ids), F.col("n") - F.col("start"))).withColumn("first", F.col("base") + F.col("place"))
        due = (F.col("first") + F.col("start") + F.col("size") - F.col("credit")) / F.col("quantum")
        rows = rows.withColumn("round", F.greatest(F.ceil(F.least(due, F.lit(9e18))), F.lit(1)))
        if keep:
            w = width.itemsize
            rows = rows.withColumn("ids", F.substring("ids", (F.col("start") * w + 1).cast("int"), (F.col("size") * w).cast("int")))
        return rows.select("queue", "round", "first", "start", "size", "n", *keep).withColumn("segment", number)

    got = slices().groupBy("segment").agg(F.sum("size").alias("n")).collect()  # about SEGMENTS rows at most
    sizes = np.zeros(max(r.segment for r in got) + 1, np.int64)
    for r in got:
        sizes[r.segment] = r.n
    bases = np.cumsum(sizes) - sizes

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at = -1, 0
        for pdf in batches:
            of, size = pdf["segment"].to_numpy(np.int64), pdf["size"].to_numpy(np.int64)
            if not len(of):
                continue
            so_far = np.cumsum(size) - size
            new = np.append(of[0] != now, of[1:] != of[:-1])
            base = np.where(np.append(True, of[1:] != of[:-1]), np.where(new, bases[of], at) - so_far, np.iinfo(np.int64).min)
            run = np.flatnonzero(base != np.iinfo(np.int64).min)
            place = so_far + np.repeat(base[run], np.diff(np.append(run, len(of))))
            now, at = of[-1], int(place[-1] + size[-1])
            # a slice's windows
            low = place // length
            n = (place + size - 1) // length - low + 1
            row = np.repeat(np.arange(len(of)), n)
            window = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            begin = np.maximum(place[row], window * length)
            end = np.minimum((place + size)[row], (window + 1) * length)
            start = pdf["start"].to_numpy(np.int64)[row] + begin - place[row]
            first, queue = pdf["first"].to_numpy(np.int64)[row], pdf["queue"].to_numpy()[row]
            # slices of one document that follow one another in a window are one piece
            joins = (window[1:] == window[:-1]) & (first[1:] == first[:-1]) & (start[1:] == start[:-1] + (end - begin)[:-1]) & (queue[1:] == queue[:-1]) & (begin[1:] == end[:-1])
            head = np.flatnonzero(np.append(True, ~joins))
            tail = np.append(head[1:], len(row)) - 1
            w = width.itemsize
            raw = pdf["ids"].tolist()
            bits = [raw[r][w * a : w * b] for r, a, b in zip(row.tolist(), (begin - place[row]).tolist(), (end - place[row]).tolist(), strict=True)]
            ids = [np.frombuffer(b"".join(bits[a : b + 1]) if a < b else bits[a], width).astype("<u4").tobytes() for a, b in zip(head.tolist(), tail.tolist(), strict=True)]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].array[row[head]], "start": start[head], "length": end[tail] - begin[head], "ids": ids,
                "doc_tokens": pdf["n"].to_numpy(np.int64)[row[head]], "sequence_id": window[head], "offset": begin[head] % length, "queue": queue[head],
            })

    rows = slices("doc_id", "ids").repartition(max(parts(spark), -(-total // _TASK)), "segment")
    rows = rows.sortWithinPartitions("segment", "round", "queue", "first", "start")
    return rows.mapInPandas(_nullable(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, queue string")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = pack(docs, vocabulary_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")
