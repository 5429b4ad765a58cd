"""Token ids in patched frame-of-reference files, and their reader.

Documents are dealt by ranges of doc_id, so that shard numbers and, within a shard, chunk numbers follow doc_id.
A chunk holds whole documents, about CHUNK ids, and is one row of a Parquet table (shard, chunk, payload). Payload,
all little-endian:

    magic 'PFR1', uint32 documents, uint64 ids, uint32 blocks, uint64 first id's place in the shard
    int64 doc_id and uint64 ids for each document, bit map of null doc_ids
    index: uint32 place of each block in the body
    body: blocks of BLOCK ids (the last is shorter): uint32 minimum, uint8 width, uint16 exceptions, then the ids
    less the minimum, their low width bits packed from the most significant bit on, then uint16 place and uint32
    value of each exception

The width is what PERCENTILE of the block's differences need; larger ones are exceptions. Writing and reading back
are exact inverses, and a reader can decode single blocks by the index.

Edge cases: a null text counts as empty and has the end id only; a null doc_id sorts first; rows of one doc_id
keep one place each, in the order of their texts; an empty table writes no chunk; a text longer than a chunk makes
a chunk of its own; other columns aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_path, parts, ship, table
from .token_ids import encoder, vocabulary_path

BLOCK = 128
CHUNK = 1 << 18
PERCENTILE = 90
#: With more shards (two numbers each), their places are joined by shuffle.
BROADCAST_SHARDS = 1_000_000
_HEAD = struct.Struct("<4sIQIQ")
_MAGIC = b"PFR1"


def _pack(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The body and the index for ids (uint32)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, ids[-1] if n else 0, np.uint32)
    padded[:n] = ids
    x = padded.reshape(blocks, BLOCK)
    low = x.min(axis=1)
    x = x - low[:, None]
    rank = -(-BLOCK * PERCENTILE // 100) - 1
    width = np.ceil(np.log2(np.partition(x, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.int64)
    size = np.full(blocks, BLOCK)
    if n % BLOCK:
        size[-1] = n % BLOCK
    body: list[bytes] = [b""] * blocks
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        for k in range(0, len(at), 1024):
            some = at[k : k + 1024]
            v = x[some]
            bits = ((v[:, :, None] >> np.arange(w - 1, -1, -1, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8).reshape(len(some), BLOCK * w)
            packed = np.packbits(bits, axis=1)
            row, place = np.nonzero(v >> np.uint32(w) if w < 32 else np.zeros_like(v))
            cuts = np.searchsorted(row, np.arange(len(some) + 1)).tolist()
            place, value = place.astype("<u2"), v[row, place].astype("<u4")
            for j, b in enumerate(some.tolist()):
                s, e = cuts[j], cuts[j + 1]
                p, q, m = place[s:e], value[s:e], int(size[b])
                if m < BLOCK:  # padding repeats the last id and may be an exception
                    p, q = p[p < m], q[p < m]
                body[b] = struct.pack("<IBH", int(low[b]), w, len(p)) + packed[j, : (m * w + 7) // 8].tobytes() + p.tobytes() + q.tobytes()
    sizes = np.fromiter(map(len, body), np.int64, blocks)
    return b"".join(body), (np.cumsum(sizes) - sizes).astype("<u4")


def unpack_block(body: bytes, at: int, size: int) -> np.ndarray:
    """The ids of the block at a place of the body."""
    low, w, n = struct.unpack_from("<IBH", body, at)
    at += 7
    long = (size * w + 7) // 8
    bits = np.unpackbits(np.frombuffer(body, np.uint8, long, at), count=size * w).reshape(size, w)
    out = (bits @ (np.uint32(1) << np.arange(w - 1, -1, -1, dtype=np.uint32))).astype(np.uint32) if w else np.zeros(size, np.uint32)
    at += long
    if n:
        out[np.frombuffer(body, "<u2", n, at)] = np.frombuffer(body, "<u4", n, at + 2 * n)
    return out + np.uint32(low)


def _unpack(body: bytes, index: np.ndarray, n: int) -> np.ndarray:
    """All ids; blocks of one width at once."""
    blocks, raw = len(index), np.frombuffer(body, np.uint8)
    out = np.zeros((blocks, BLOCK), np.uint32)
    at = index.astype(np.int64)
    if not blocks:
        return out.ravel()
    head = raw[at[:, None] + np.arange(7)]
    low = head[:, :4].copy().view("<u4")[:, 0]
    width, exceptions = head[:, 4].astype(np.int64), head[:, 5:].copy().view("<u2")[:, 0].astype(np.int64)
    whole = blocks - 1 if n % BLOCK else blocks
    for w in np.unique(width[:whole]).tolist() if whole else []:
        some = np.flatnonzero(width[:whole] == w)
        if w:
            for k in range(0, len(some), 1024):
                cut = some[k : k + 1024]
                bits = np.unpackbits(raw[at[cut][:, None] + 7 + np.arange(BLOCK * w // 8)], axis=1).reshape(len(cut), BLOCK, w)
                value = np.zeros((len(cut), BLOCK), np.uint32)
                for j in range(w):
                    value = (value << np.uint32(1)) | bits[:, :, j]
                out[cut] = value
    for b in np.flatnonzero(exceptions[:whole]).tolist():
        m, s = int(exceptions[b]), int(at[b]) + 7 + BLOCK * int(width[b]) // 8
        out[b, np.frombuffer(body, "<u2", m, s)] = np.frombuffer(body, "<u4", m, s + 2 * m)
    out[:whole] += low[:whole, None]
    if n % BLOCK:
        out[-1, : n % BLOCK] = unpack_block(body, int(at[-1]), n % BLOCK)
    return out.ravel()[:n]


def encode_chunk(doc_ids: list[int | None], documents: list[np.ndarray], start: int) -> bytes:
    lengths = np.array([len(d) for d in documents], "<u8")
    ids = np.concatenate(documents).astype(np.uint32) if documents else np.zeros(0, np.uint32)
    body, index = _pack(ids)
    null = np.packbits(np.array([d is None for d in doc_ids], bool)).tobytes()
    named = np.array([d or 0 for d in doc_ids], "<i8")
    return _HEAD.pack(_MAGIC, len(documents), len(ids), len(index), start) + named.tobytes() + lengths.tobytes() + null + index.tobytes() + body


def decode_chunk(payload: bytes) -> tuple[list[int | None], list[np.ndarray], int]:
    """doc_ids, each one's ids (uint32), the first id's place in the shard."""
    magic, docs, n, blocks, start = _HEAD.unpack_from(payload)
    if magic != _MAGIC:
        raise ValueError("not a chunk of token ids")
    at = _HEAD.size
    named = np.frombuffer(payload, "<i8", docs, at).tolist()
    lengths = np.frombuffer(payload, "<u8", docs, at + 8 * docs).astype(np.int64)
    at += 16 * docs
    null = np.unpackbits(np.frombuffer(payload, np.uint8, -(-docs // 8), at), count=docs).tolist()
    at += -(-docs // 8)
    index = np.frombuffer(payload, "<u4", blocks, at)
    ids = _unpack(payload[at + 4 * blocks :], index, n)
    return [None if z else d for d, z in zip(named, null, strict=True)], np.split(ids, np.cumsum(lengths)[:-1]) if docs else [], start


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, text: str = "text", ident: str = "doc_id") -> None:
    """Writes the ids of each document, the end id after them, in ascending order of ident."""
    ship(docs.sparkSession)

    def written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, shard, chunk, start = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        names: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pd.DataFrame:
            return pd.DataFrame({"shard": [shard], "chunk": [chunk], "n_ids": [size], "payload": [encode_chunk(names, held, start)]})

        for pdf in batches:
            ids = pdf["id"].astype("Int64")
            for name, text in zip(ids, pdf["text"], strict=True):
                raw = np.frombuffer(encode.encode([text])[0], encode.dtype)
                names.append(None if name is pd.NA else int(name))
                held.append(np.append(raw, encode.dtype.type(end_id)))
                size += len(raw) + 1
                if size >= CHUNK:
                    yield row()
                    start, chunk, size = start + size, chunk + 1, 0
                    names.clear(), held.clear()
        if held:
            yield row()

    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(2 * parts(docs.sparkSession), "id").sortWithinPartitions("id", "text")
    rows.mapInPandas(written, "shard int, chunk int, n_ids long, payload binary").write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), ids (uint32, little-endian bytes)."""
    ship(spark)
    chunks = spark.read.schema("shard int, chunk int, n_ids long, payload binary").parquet(path)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for payload, before in zip(pdf["payload"], pdf["before"], strict=True):
                names, documents, start = decode_chunk(payload)
                lengths = np.array([len(d) for d in documents], np.int64)
                starts = start + int(before) + np.cumsum(lengths) - lengths
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": starts, "ids": [d.astype("<u4").tobytes() for d in documents]})

    shards = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # one row a written file
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shards = table(shards.select("shard", before.alias("before")), "shards")
    if shards.count() <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)
    placed = chunks.join(shards, "shard")
    return placed.select("payload", "before").mapInPandas(read, "doc_id long, start long, ids binary")




def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = new_path(spark, "token-files")
    write_tokens(docs, path, vocabulary_path("byte_bpe_50k.json"), 2)
    out = read_tokens(spark, path)
    return out.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
