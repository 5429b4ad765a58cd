"""Near-dedup: links of close SimHash fingerprints (op3), and links of texts with similar shingle sets (the pipeline's stage).

The first, components(), is an exact search in a forest of vantage-point trees. The second, deduplicate(), takes that
search's links of fingerprints, confirms each on the shingle sets, and finds the similar texts that fingerprints tell
apart by a prefix filter across the components that are left.

Fingerprints: a bit is set if it is set in over half the XXH64 values (seed 42) of a text's word shingles,
repeats included. Words are runs without ASCII white space; A-Z are lower-cased.

Search: equal fingerprints meet first, so that only distinct ones are compared. The 64 bits are cut into BLOCKS
blocks with a radius each; the radii and one for each block add up to distance + 1, so that two fingerprints within the
distance are within the radius of some block (4 bits: 22, 22 and 20 bits with radii 1, 1 and 0). Each block has a
vantage-point tree under the Hamming distance on its bits: a level has one vantage point, a node one child per
distance to it. A fingerprint is stored in the shard its own distances lead to. It also queries other shards: by the
triangle inequality, |d(x, v) - d(y, v)| <= radius on each level, so that of a level's rings only those beside its own
stay open, and of the branches through open rings only those that reach some value within the radius are followed. Of
two shards that lie within reach the one of the larger path is queried, so each pair meets once. The trees' depth
follows the number of fingerprints, which changes how many are compared and not what is found. A shard over SHARD
rows is cut by further trees over blocks of the bits outside its block, and what is still larger is dealt in tiles:
each pair of its pieces is one task. Shards return links between a fingerprint and the smallest one of its local
component only, so their number stays below the number of stored rows.

Edge cases: a text without words (null counts as empty) has fingerprint zero; with fewer words than a shingle
has, the whole sequence is the one shingle; equal texts share a fingerprint and need no comparison; repeated
doc_ids are one document's rows and each gives a row; an empty table gives an empty result.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HUB, HUBS, OWN, connected_components, parts, ship, table, union, united, with_least

SEED = 42
#: Values whose bits are counted at once; bounds the memory that a long text takes.
_AT_ONCE = 1 << 15
#: Rows of one shard that one task compares with each other.
SHARD = 8192
BLOCKS = 3
#: Most vantage points of a tree; the distances to them tell nearly all values of a block of 22 bits apart.
LEVELS = 7
#: Fingerprints that a shard stores on average, by the choice of the depth, and the bits that one level tells apart.
_HELD = 128
_LEVEL_BITS = 3.2
_ROWS_AT_ONCE = 1 << 16


def _hashes(text: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 values of a text's shingles (text in UTF-8), _AT_ONCE at a time; none for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = (end - length)[: max(1, len(words) - shingle + 1)].tolist()
    end = end[min(shingle, len(words)) - 1 :].tolist()
    for k in range(0, len(start), _AT_ONCE):
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(start[k : k + _AT_ONCE], end[k : k + _AT_ONCE], strict=True)], np.uint64)


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Of a text in UTF-8."""
    return _majority(_hashes(text, shingle))


def _majority(hashes: Iterable[np.ndarray]) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 4) -> DataFrame:
    """docs and a long: the fingerprint's 64 bits."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, fp(F.col(f"`{text}`").cast("binary")))


def radii(distance: int, blocks: int) -> list[int]:
    """A radius for each block; two values that differ in more than each block's radius differ in over distance bits."""
    whole, more = divmod(distance + 1, min(blocks, distance + 1))
    return [whole - (i >= more) for i in range(min(blocks, distance + 1))]


def _blocks(bits: list[int], radius: list[int]) -> list[list[int]]:
    """The bits cut into a block for each radius, two bits more for each step of it."""
    sizes = np.diff(np.linspace(0, len(bits) - 2 * sum(radius), len(radius) + 1).astype(int)) + 2 * np.array(radius)
    cuts = np.cumsum(sizes).tolist()
    return [bits[c - n : c] for c, n in zip(cuts, sizes.tolist(), strict=True)]


def _mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


class Tree:
    """A vantage-point tree over the bits of one block, the same vantage points in every branch of a level."""

    def __init__(self, bits: list[int], radius: int, seed: int, levels: int = LEVELS):
        rng = random.Random(seed)
        self.bits, self.radius = bits, radius
        self.mask = np.uint64(_mask(bits))
        # the first vantage point is zero, the others are random halves of the block
        self.vantage = [np.uint64(v) for v in [0] + [_mask(rng.sample(bits, max(1, len(bits) // 2))) for _ in range(levels - 1)]]
        #: What a value within the radius can differ by.
        self.steps = [np.uint64(_mask(c)) for r in range(1, radius + 1) for c in combinations(bits, r)]

    def distances(self, fps: np.ndarray) -> np.ndarray:
        """A row for each fingerprint: its distance to each level's vantage point."""
        return np.stack([np.bitwise_count((fps ^ v) & self.mask) for v in self.vantage], axis=1).astype(np.int64)

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The path of a fingerprint's own shard: its distances as digits of one number."""
        return self.distances(fps) @ (len(self.bits) + 1) ** np.arange(len(self.vantage))[::-1]

    def queried(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint's index, path) of the shards beyond its own that it queries, without repeats.

        A value within the radius has rings that the triangle bound leaves open, on every level, and it has the same
        parity of its differences on all of them; these branches are found from the values themselves.
        """
        if not self.steps or not len(fps):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        own = self.home(fps)
        paths = np.sort(np.stack([self.home(fps ^ s) for s in self.steps], axis=1), axis=1)
        fresh = np.append(np.ones((len(fps), 1), bool), paths[:, 1:] != paths[:, :-1], axis=1) & (paths > own[:, None])
        row, at = np.nonzero(fresh)
        return row, paths[row, at]


def _linked_large(fps: np.ndarray, homes: int, distance: int) -> np.ndarray:
    """For each fingerprint the index of the smallest one in its component, over pairs with one of the first homes."""
    low = np.arange(len(fps))
    step = max(1, (1 << 18) // len(fps))
    for i in range(0, homes, step):
        rows = fps[i : min(homes, i + step)]
        a, b = np.nonzero(np.bitwise_count(rows[:, None] ^ fps[None, i:]) <= distance)
        some = a < b
        if some.any():
            low = united(low, a[some] + i, b[some] + i)
    return low


def _linked_small(fps: np.ndarray, group: np.ndarray, visitor: np.ndarray, distance: int) -> np.ndarray:
    """The same for many small groups that follow one another, homes first: rows are compared at growing offsets."""
    low, at, a, b = np.arange(len(fps)), np.flatnonzero(~visitor), [], []
    for off in range(1, len(fps)):
        at = at[at + off < len(fps)]
        at = at[group[at] == group[at + off]]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + off]) <= distance]
        a.append(near)
        b.append(near + off)
    return united(low, np.concatenate(a), np.concatenate(b)) if a else low


def _search(distance: int, small: int = 64):
    """For mapInArrow over rows (shard, visitor, id) in that order: (a, b) links of ids; visitors aren't compared with each other."""

    def pairs(shard: np.ndarray, visitor: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        fps = ids.view(np.uint64)
        cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        sizes = np.diff(np.append(cuts, len(ids)))
        low = np.arange(len(ids))
        for c, n in zip(cuts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
            low[c : c + n] = c + _linked_large(fps[c : c + n], int((~visitor[c : c + n]).sum()), distance)
        few = np.repeat((sizes > 1) & (sizes <= small), sizes)
        if few.any():
            at = np.flatnonzero(few)
            low[at] = at[_linked_small(fps[at], shard[at], visitor[at], distance)]
        linked = ids[low] != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[low[linked]])], ["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def whole() -> tuple[np.ndarray, ...]:
            return tuple(np.concatenate(x) for x in zip(*held, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "visitor", "id")))
            size += batch.num_rows
            if size >= _ROWS_AT_ONCE and held[-1][0][-1] != held[0][0][0]:
                rows = whole()
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                yield pairs(*(x[:cut] for x in rows))
                held, size = [tuple(x[cut:] for x in rows)], len(rows[0]) - cut
        if held:
            yield pairs(*whole())

    return search


def _stored(fps: DataFrame, trees: list[Tree]) -> DataFrame:
    """fps (id, outer) to (outer, tree, shard, visitor, id): a row for the own shard and one for each shard that is queried.

    Shard numbers are hashes of outer, tree and path; where two meet in one number, they are compared in vain only.
    """

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _ROWS_AT_ONCE // 8):
                cut = batch.slice(k, _ROWS_AT_ONCE // 8)
                ids, outer = cut.column("id").to_numpy(), cut.column("outer").to_numpy()
                fps = ids.view(np.uint64)
                for i, tree in enumerate(trees):
                    row, path = tree.queried(fps)
                    row = np.append(np.arange(len(ids)), row)
                    path = np.append(tree.home(fps), path)
                    shard = _mixed(_mixed(outer[row].view(np.uint64) + np.uint64(i + 1)) ^ path.astype(np.uint64))
                    columns = [outer[row], np.full(len(row), i, np.int8), shard.view(np.int64), np.arange(len(row)) >= len(ids), ids[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["outer", "tree", "shard", "visitor", "id"])

    return fps.mapInArrow(stored, "outer long, tree byte, shard long, visitor boolean, id long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads neighbouring numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _dealt(rows: DataFrame, distance: int) -> DataFrame:
    """Links within each shard; a shard is in one task."""
    rows = rows.select("shard", "visitor", "id").repartition(parts(rows.sparkSession), "shard").sortWithinPartitions("shard", "visitor", "id")
    return rows.mapInArrow(_search(distance), "a long, b long")


def forest(n: int, bits: list[int], distance: int, blocks: int, seed: int) -> list[Tree]:
    """A tree for each block of bits; their depth follows the number of fingerprints."""
    radius = radii(distance, blocks)
    levels = min(LEVELS, max(1, int(np.ceil(np.log2(max(2, n) / _HELD) / _LEVEL_BITS))))
    return [Tree(b, r, seed + i, levels) for i, (b, r) in enumerate(zip(_blocks(bits, radius), radius, strict=True))]


def links(fps: DataFrame, distance: int = 4, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """(fp) distinct to (a, b): links within distance, enough of them to connect all that links connect."""
    fps = fps.select(F.col("fp").alias("id"), F.lit(0).cast("long").alias("outer"))
    trees = forest(fps.count(), list(range(64)), distance, blocks, 0)
    first = _stored(fps, trees)
    large = table(first.groupBy("shard", "tree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard), "large")
    if large.isEmpty():
        return _dealt(first, distance)
    found = [_dealt(first.join(large, "shard", "left_anti"), distance)]
    # one level deeper: blocks of the bits that the shard's tree hasn't used
    deeper = []
    for i, t in enumerate(trees):
        own = first.filter(F.col("tree") == i).join(large.filter(F.col("tree") == i).select("shard"), "shard", "left_semi")
        rest = [x for x in range(64) if x not in t.bits]
        deeper.append(_stored(own.select("id", F.col("shard").alias("outer")), forest(1 << 60, rest, distance, blocks, 100 + 10 * i)))
    second = table(union(deeper).select("shard", "visitor", "id"), "deeper")
    sizes = second.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    huge = table(sizes.withColumn("pieces", F.expr(f"cast(ceil(2 * n / {shard}) as int)")), "huge")
    found.append(_dealt(second.join(huge, "shard", "left_anti"), distance))
    if not huge.isEmpty():
        tiled = second.join(huge, "shard").withColumn("mine", F.expr("cast(pmod(xxhash64(id), pieces) as int)"))
        tiled = tiled.withColumn("other", F.explode(F.expr("sequence(0, pieces - 1)")))
        tile = F.xxhash64("shard", F.least("mine", "other"), F.greatest("mine", "other"))
        found.append(_dealt(tiled.select("id", "visitor", tile.alias("shard")), distance))
    return union(found)


def components(docs: DataFrame, text: str = "text", ident: str = "doc_id", distance: int = 4, shingle: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest doc_id that links reach)."""
    rows = table(with_fingerprint(docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("t")), "t", "fp", shingle).drop("t"), "fingerprints")
    first = table(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    classes = connected_components(links(first.select("fp"), distance)).select(F.col("id").alias("fp"), "component")
    named = table(first.join(classes, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("u")), "named")
    least = table(named.groupBy("u").agg(F.min("first").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    named = table(with_least(named, least, max(HUB, first.count() // HUBS)).select("fp", F.col("m").alias("component_id")), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


#: Near copies share this part of their distinct shingles, as a fraction of integers.
SIMILAR = (4, 5)
#: Texts whose shingles are counted for the order of prefixes, and shingles that are kept from them. The order decides
#: the number of pairs to compare, never which ones are found.
COUNTED = 5_000
FREQUENT = 200_000
#: More rows to drop than this are joined by shuffle instead of broadcast.
BROADCAST_DROPS = 1_000_000
#: Words of 64 parities of a set.
WORDS = 8
#: Rows of the sample that make a prefix value a frequent one.
OFTEN = 16
#: Lists of more rows than this are compared with PIVOTS of their members, in ROUNDS at most, before all pairs are.
LONG = 64
PIVOTS = 16
ROUNDS = 1
#: Pairs of one id that one salt holds.
SALT_PAIRS = 1024


def shingles(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles, sorted."""
    return _distinct(list(_hashes(text, shingle)))


def _distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of SIMILAR or more."""
    part, whole = SIMILAR
    n = len(np.intersect1d(a, b, assume_unique=True))
    return whole * n >= part * (len(a) + len(b) - n)


def prefix(values: np.ndarray, frequent: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The rarest values of a set, so many that two similar sets share one of them."""
    part, whole = SIMILAR
    seen = np.zeros(len(values), np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, values), len(frequent) - 1)
        seen = np.where(frequent[at] == values, count[at], 0)
    n = len(values)
    return values[np.lexsort((values, seen))][: n + 1 + -part * n // whole]


def parities(values: np.ndarray) -> list[int]:
    """WORDS words: whether the number of values is odd in each of so many bits' classes. Two sets' parities differ in
    no more bits than the sets differ in values."""
    odd = np.bincount((values & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").tolist()


def wide(values: np.ndarray) -> bytes:
    """The number of values and their parities in two to four times as many classes, a power of two; folded, they are
    those of fewer classes."""
    bits = 1 << max(8, int(2 * len(values) - 1).bit_length()) if len(values) else 1 << 8
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(values).to_bytes(4, "little") + np.packbits(odd.astype(np.uint8)).tobytes()


def may_be_similar(a: bytes, b: bytes) -> bool:
    """Whether wide() of two sets leaves it open that these are similar."""
    part, whole = SIMILAR
    n = int.from_bytes(a[:4], "little") + int.from_bytes(b[:4], "little")
    x, y = sorted((np.frombuffer(a, np.uint8, offset=4), np.frombuffer(b, np.uint8, offset=4)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return (whole + part) * int(np.bitwise_count(x ^ y).sum()) <= (whole - part) * n


def _frequent(docs: DataFrame, text: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of about COUNTED texts, sorted, and their counts."""
    every = -(-docs.count() // COUNTED)
    texts = docs.select(F.col(f"`{text}`").cast("binary").alias("t"))

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["t"]:
                yield pd.DataFrame({"s": shingles(t, shingle).view(np.int64)})

    texts = texts.filter(F.pmod(F.xxhash64("t"), F.lit(every)) == 0) if every > 1 else texts
    found = texts.mapInPandas(values, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    rows = found.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()
    frequent, count = np.array([r.s for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(frequent)
    return frequent[order], count[order]


def _possible(a: str, b: str) -> str:
    """SQL: whether two sets of n values can be similar if the first value they share is at these places."""
    part, whole = SIMILAR
    return f"{part + whole} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {part} * ({a}.n + {b}.n)"


def _close(a: str, b: str) -> str:
    """SQL: whether the parities of two sets leave it open that these are similar."""
    part, whole = SIMILAR
    bits = " + ".join(f"bit_count({a}.p{i} ^ {b}.p{i})" for i in range(WORDS))
    return f"{whole + part} * ({bits}) <= {whole - part} * ({a}.n + {b}.n)"


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose texts (id, t) are similar."""

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, mine = None, None
        for pdf in batches:
            keep = []
            for a, s, t in zip(pdf["a"], pdf["s"], pdf["t"], strict=True):
                if a != last:
                    last, mine = a, shingles(s, shingle)
                keep.append(similar(mine, shingles(t, shingle)))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    # only texts of pairs move
    ids = table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "paired")
    texts = texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_DROPS else ids, "id", "left_semi")
    both = _with_texts(pairs, texts, b="t", a="s")
    return both.sortWithinPartitions("a").select("a", "b", "s", "t").mapInPandas(confirm, "a long, b long")


def _left_open(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A table of the distinct pairs (a, b) that wide() of their sets (id, wide) doesn't rule out."""

    @F.pandas_udf("boolean")
    def close(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([may_be_similar(a, b) for a, b in zip(x, y, strict=True)], dtype=bool)

    pairs, sets = table(pairs.distinct(), "pairs"), sets.select("id", F.col("wide").alias("t"))
    both = _with_texts(pairs, sets, b="y", a="x")
    return table(both.filter(close("x", "y")).select("a", "b"), "open")


def _with_texts(pairs: DataFrame, texts: DataFrame, **names: str) -> DataFrame:
    """pairs with the texts (column t of id) of its key columns, under these names; the pairs of an id that has many are
    dealt by salts. The ids of all keys are counted at once, before any text is joined."""
    ids = F.explode(F.array(*[F.struct(F.lit(key).alias("key"), F.col(key).alias("id")) for key in names]))
    many = pairs.select(ids.alias("e")).groupBy("e.key", "e.id").agg((F.count(F.lit(1)) / SALT_PAIRS).cast("int").alias("salts"))
    many = table(many.filter("salts > 0").orderBy(F.desc("salts"), "key", "id").limit(HUBS), "many")
    salted = not many.isEmpty()
    for key, name in names.items():
        own = texts.select(F.col("id").alias(key), F.col("t").alias(name))
        if not salted:
            pairs = pairs.join(own, key)
            continue
        salts = F.broadcast(many.filter(F.col("key") == key).select(F.col("id").alias(key), "salts"))
        pairs = pairs.join(salts, key, "left").withColumn("salt", F.expr("cast(pmod(xxhash64(a, b), coalesce(salts, 0) + 1) as int)"))
        own = own.join(salts, key, "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 0))")))
        pairs = pairs.drop("salts").join(own.drop("salts"), [key, "salt"]).drop("salt")
    return pairs


def _lists(sets: DataFrame) -> DataFrame:
    """A table (token, id, n, pos) of the sets that share a prefix value with others.

    A value that a sample of the sets shows often is counted and its row broadcast; the others' lists, which are
    short then, are windows. The sample decides the way only.
    """
    every = -(-sets.count() // COUNTED)
    each = sets.select("id", "n", F.posexplode("tokens").alias("pos", "token"))
    often = each.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    often = often.filter(F.col("c") >= OFTEN).orderBy(F.desc("c"), "token").limit(HUBS).select("token", F.lit(True).alias("often"))
    often = table(often, "often")
    each = each.join(F.broadcast(often), "token", "left")
    by = W.partitionBy("token").orderBy("id")
    short = each.filter("often is null").withColumn("last", F.lag("id").over(by)).withColumn("next", F.lead("id").over(by))
    short = short.filter("last is not null or next is not null").drop("last", "next")
    return table(short.unionByName(each.filter("often")).drop("often"), "lists")


def _by_token(rows: DataFrame, lists: DataFrame, most: int) -> DataFrame:
    """rows joined with lists (token, size and more), those of more than most rows by broadcast."""
    large, small = lists.filter(F.col("size") > most), lists.filter(F.col("size") <= most)
    if large.isEmpty():
        return rows.join(lists, "token")
    return rows.join(F.broadcast(large), "token").unionByName(rows.join(small, "token"))


def _across(lists: DataFrame, classes: DataFrame, words: DataFrame, most: int) -> DataFrame:
    """A table of the lists that hold several components: their rows with component, the list's size, the major
    component, which has most of its rows, and others, the number of rows outside it, and with the set's words."""
    named = table(lists.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id")), "named")
    parted = named.groupBy("token", "component").agg(F.count(F.lit(1)).alias("rows")).groupBy("token")
    parted = parted.agg(F.sum("rows").alias("size"), F.max(F.struct("rows", "component")).alias("top")).filter("size > top.rows")
    parted = table(parted.select("token", "size", F.expr("size - top.rows").alias("others"), F.expr("top.component").alias("major")), "parted")
    return table(_by_token(named, parted, most).join(words, "id"), "rest")


def nominated(sets: DataFrame, distance: int = 4) -> DataFrame:
    """sets (id, fp) to distinct (a, b): each set and the first one of its fingerprint, and the first ones of fingerprints
    that the search in vantage-point trees links."""
    first = table(sets.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    firsts = first.select(F.col("fp").alias("id"), F.col("first").alias("t"))
    close = table(links(first.select("fp"), distance).distinct(), "close")
    close = _with_texts(close, firsts, b="y", a="x").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    equal = _with_texts(sets.select(F.col("fp").alias("a"), F.col("id").alias("b")), firsts, a="x").filter("x <> b")
    return close.unionByName(equal.select(F.col("x").alias("a"), "b")).distinct()


def similar_links(sets: DataFrame, texts: DataFrame, shingle: int = 5, distance: int = 4) -> DataFrame:
    """sets (id, fp, n, tokens: their prefixes, p0 ..: their parities, wide) and texts (id, t) to (a, b): similar pairs that connect all that similar pairs connect.

    Links of fingerprints come first; those whose sets are similar make components. All sets that share a prefix value
    are a list. Each list in several components has its members compared with the first one of its major component, a
    long list with PIVOTS of its members, ROUNDS times at most. Then each pair across a list's components is, unless
    places or parities rule it out; pairs within the component that has most of a list are never made, and long lists
    are dealt in tiles, each pair of pieces a task.
    """
    words = [f"p{i}" for i in range(WORDS)]
    found = table(_confirmed(table(nominated(sets.select("id", "fp"), distance), "nominated"), texts, shingle), "similar")
    lists = _lists(sets)
    most = max(HUB, lists.count() // HUBS)
    own = F.struct("id", "n", "pos", "component", *words)
    for k in range(ROUNDS + 1):
        # lists in one component stay so, so that later rounds read only what is left
        rest = _across(lists, table(connected_components(found), "components"), sets.select("id", *words), most)
        lists = rest.drop("component", "size", "others", "major", *words)
        if k == ROUNDS:
            break
        rank = F.xxhash64("id", F.lit(k))
        slot = F.when(F.col("size") > LONG, F.pmod(rank, F.lit(PIVOTS))).when(F.col("component") == F.col("major"), -1)
        pivots = rest.withColumn("slot", slot).filter("slot is not null")
        pivots = pivots.groupBy("token", "slot").agg(F.min_by(own, F.when(F.col("slot") < 0, F.col("id")).otherwise(rank)).alias("x"), F.max("size").alias("size"))
        pivots = table(pivots.groupBy("token").agg(F.collect_list("x").alias("xs"), F.max("size").alias("size")), "pivots")
        pairs = _by_token(rest.select("token", own.alias("y")), pivots, most).select("y", F.explode("xs").alias("x"))
        pairs = pairs.filter(f"x.component <> y.component and {_possible('x', 'y')} and {_close('x', 'y')}")
        found = found.unionByName(table(_confirmed(_left_open(_ordered(pairs), sets), texts, shingle), "similar"))
    # tiles: a piece of a list's others against a piece of the list
    piece = f"cast(ceil({{}} / {SHARD}) as int)"
    xs, ys = piece.format("others"), piece.format("size")
    x = rest.filter("component <> major").select("token", own.alias("x"), F.expr(f"cast(pmod(xxhash64(id), {xs}) as int)").alias("i"), F.explode(F.expr(f"sequence(0, {ys} - 1)")).alias("j"))
    y = rest.select("token", "major", own.alias("y"), F.expr(f"cast(pmod(xxhash64(id), {ys}) as int)").alias("j"), F.explode(F.expr(f"sequence(0, {xs} - 1)")).alias("i"))
    once = "x.component <> y.component and (y.component = major or x.id < y.id)"
    pairs = x.join(y, ["token", "i", "j"]).filter(f"{once} and {_possible('x', 'y')} and {_close('x', 'y')}")
    return found.unionByName(_confirmed(_left_open(_ordered(pairs), sets), texts, shingle))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def deduplicate(docs: DataFrame, text: str = "text", ident: str = "doc_id", shingle: int = 5) -> DataFrame:
    """docs with one row of each group of near copies, the one of the smallest identifier; columns as they were.

    Near copies are texts whose sets of shingles have a Jaccard similarity of SIMILAR or more, and what such pairs
    connect. Fingerprints close to each other nominate pairs first, a prefix filter over the sets those that are left,
    without loss, and each is confirmed on the sets themselves.
    """
    ship(docs.sparkSession)
    row = f"{OWN}row"
    frequent, count = _frequent(docs, text, shingle)

    words = [f"p{i}" for i in range(WORDS)]

    @F.pandas_udf(f"fp long, n int, same binary, wide binary, tokens array<long>, {' long, '.join(words)} long")
    def described(texts: pd.Series) -> pd.DataFrame:
        fps, sets = [], []
        for t in texts:
            hashes = list(_hashes(t, shingle))
            fps.append(_majority(hashes))
            sets.append(_distinct(hashes))
        return pd.DataFrame({
            "fp": np.array(fps, np.uint64).view(np.int64), "wide": [wide(s) for s in sets],
            "n": pd.Series([len(s) for s in sets], dtype="int32"), "same": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "tokens": [prefix(s, frequent, count).view(np.int64) for s in sets],
            **dict(zip(words, np.array([parities(s) for s in sets], np.int64).reshape(-1, WORDS).T, strict=True)),
        })

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row))
    packed = packed.select(row, F.col(row).getField(ident).alias("doc_id"), described(F.col(row).getField(text).cast("binary")).alias("w"))
    rows = table(packed.select(row, "doc_id", "w.*", F.monotonically_increasing_id().alias("rid")), "shingles")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = table(rows.groupBy("same").agg(F.min(key).alias("first")).select(F.col("first.rid").alias("id"), "first"), "classes")
    sets = _without(rows, rows.select("rid").join(first.select(F.col("id").alias("rid")), "rid", "left_anti"))
    texts = rows.select(F.col("rid").alias("id"), F.col(row).getField(text).cast("binary").alias("t"))
    classes = connected_components(similar_links(sets.select(F.col("rid").alias("id"), "fp", "n", "wide", "tokens", *words), texts, shingle))
    named = first.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"))
    return _without(rows, rows.select("rid").join(stay, "rid", "left_anti")).select(f"{row}.*")


def _without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    dropped = table(dropped, "dropped")
    if dropped.count() <= BROADCAST_DROPS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, "rid", "left_anti")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
