"""Exact dedup over a log-structured merge index of text digests, with DataFrame functions only.

Memtables: each task's batch of (digest, identifier) entries. A flush writes it as a sorted run whose Parquet
blocks carry Bloom filters on the digest. Compaction merges all runs into one sorted level that keeps, for
each digest, the smallest identifier and the number of entries. A bounded bitmap over the digests with several
entries decides, in a second scan of the texts, which rows may be hits; only these move. Hits are verified
byte by byte against the row that the index keeps, and groups whose digests collide are dealt anew by text.

Edge cases: a null text counts as empty; empty texts equal each other and texts without white space differ from
those with it; rows repeated with one doc_id form a group of which one row stays; a null doc_id sorts last; an
empty table gives an empty result; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, table, whole_text

WHITE = "[\\x20\\x09-\\x0D]+"
#: Most bits of the bitmap over hit digests that is broadcast (8 MB).
FILTER_BITS = 1 << 26
#: Rows of one group that are verified in one salt.
SALT_ROWS = 2048
#: A group of over HOT rows is hot; hot groups hold MOST_HOT entries at most, by a larger HOT for more rows than HOT * MOST_HOT.
HOT = 4096
MOST_HOT = 100_000
_BITS_A_BITMAP = 32768


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """Runs of (digest, ident) in the shared folder; ident is any orderable column."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.runs, self.level = spark, new_path(spark, "lsm"), [], None

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        bloom = {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        df.sortWithinPartitions("digest").write.options(compression="zstd", **bloom).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def flush(self, entries: DataFrame) -> None:
        """Writes each task's entries as a sorted run with filters."""
        self.runs.append(self._write(entries.select("digest", "ident"), f"run-{len(self.runs)}"))

    def compact(self) -> DataFrame:
        """Merges the runs: digest, smallest ident, entries."""
        merged = self.runs[0]
        for run in self.runs[1:]:
            merged = merged.unionByName(run)
        level = merged.groupBy("digest").agg(F.min("ident").alias("ident"), F.count(F.lit(1)).alias("n"))
        self.level = self._write(level, "level-1")
        return self.level

    def hits(self) -> DataFrame:
        return self.level.filter("n > 1")

    def hit_filter(self) -> tuple[DataFrame, int]:
        """Bitmaps over the hit digests, and their number of bits, which is bounded."""
        n, bits = self.hits().count(), _BITS_A_BITMAP
        while bits < min(16 * n, FILTER_BITS):
            bits *= 2
        at = F.expr(f"pmod(xxhash64(digest), {bits}L) + 1")
        maps = self.hits().select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket"))
        return maps.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits")), bits

    def with_maybe(self, rows: DataFrame) -> DataFrame:
        """rows (with a column digest) and maybe: true for all hits and few others."""
        maps, bits = self.hit_filter()
        rows = rows.withColumn("at", F.expr(f"pmod(xxhash64(digest), {bits}L)"))
        rows = rows.withColumn("bucket", F.expr(f"`at` div {_BITS_A_BITMAP} + 1"))
        rows = rows.join(F.broadcast(maps), "bucket", "left")
        byte = f"cast(conv(hex(substring(bits, cast(`at` % {_BITS_A_BITMAP} div 8 + 1 as int), 1)), 16, 10) as int)"
        rows = rows.withColumn("maybe", F.expr(f"coalesce(getbit({byte}, cast(`at` % 8 as int)) = 1, false)"))
        return rows.drop("at", "bucket", "bits")


def _rows(docs: DataFrame, text: str, ident: str, digest: Callable[[Column], Column]) -> DataFrame:
    """row (all columns), id, norm, digest."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select(
        "row", F.col("row").getField(ident).alias("id"), normalised(whole_text(F.col("row").getField(text))).alias("norm")
    )
    return rows.withColumn("digest", digest(F.col("norm")))


def _indexed(rows: DataFrame) -> DigestIndex:
    index = DigestIndex(rows.sparkSession)
    # a null identifier sorts after all others
    index.flush(rows.select("digest", F.struct(F.col("id").isNull().alias("none"), "id").alias("ident")))
    index.compact()
    return index


def _looked_up(index: DigestIndex, maybe: DataFrame) -> DataFrame:
    """A table of the rows that may be hits, with keep and n from the index (null for those that aren't).

    Hot groups, MOST_HOT at most, are broadcast, so that their rows don't meet in one task. The others are joined by digest.
    """
    total = index.level.agg(F.sum("n")).first()[0] or 0
    most = max(HOT, total // MOST_HOT)
    hits = index.hits().select("digest", F.col("ident").getField("id").alias("keep"), "n")
    hot = hits.filter(F.col("n") > most).withColumn("hot", F.lit(True))
    cold = hits.filter(F.col("n") <= most)
    by_hot = maybe.join(F.broadcast(hot), "digest", "left")
    rest = by_hot.filter("hot is null").drop("keep", "n", "hot").join(cold, "digest", "left")
    found = by_hot.filter("hot").drop("hot").unionByName(rest)
    return table(found.withColumn("rid", F.monotonically_increasing_id()), "hits")


def _verified(members: DataFrame) -> DataFrame:
    """members with keep_id, group_size and kept, after every text was compared with the kept one's."""
    first = members.filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest")
    first = first.agg(F.min("rid").alias("first"), F.min_by("norm", "rid").alias("kept_norm"), F.max("n").alias("of"))
    first = first.withColumn("salt", F.explode(F.expr(f"sequence(0L, (of - 1) div {SALT_ROWS})"))).drop("of")
    checked = members.withColumn("salt", F.expr(f"pmod(rid, (n - 1) div {SALT_ROWS} + 1)")).join(first, ["digest", "salt"])
    checked = checked.withColumn("same", F.col("norm") == F.col("kept_norm"))
    checked = table(checked.select("row", "id", "digest", "norm", "keep", "n", "rid", "first", "same"), "verified")
    wrong = checked.filter("not same").select("digest").distinct()
    plain = ["row", "id", "digest", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"), F.expr("rid = first").alias("kept")]
    if wrong.isEmpty():
        return checked.select(*plain)
    # rows of colliding digests are grouped by digest and text instead
    wrong = table(wrong, "collisions")
    again = checked.join(wrong, "digest", "left_semi").drop("first", "keep", "n")
    by_text = again.groupBy("digest", "norm").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("first"), F.count(F.lit(1)).alias("size")
    )
    again = again.join(by_text, ["digest", "norm"]).select(
        "row", "id", "digest", F.col("first.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
    )
    return checked.join(wrong, "digest", "left_anti").select(*plain).unionByName(again)


def duplicate_groups(
    docs: DataFrame, text: str = "text", ident: str = "doc_id", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest."""
    rows = _rows(docs.select(ident, text), text, ident, digest)
    index = _indexed(rows)
    alone = index.level.filter("n = 1").select(F.col("ident").getField("id").alias("doc_id"), "digest")
    alone = alone.select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    slim = rows.select(F.lit(None).cast("int").alias("row"), "id", "norm", "digest")
    members = _looked_up(index, index.with_maybe(slim).filter("maybe").drop("maybe")).filter("n is not null")
    several = _verified(members).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "digest")
    return alone.unionByName(several)


def deduplicate(
    docs: DataFrame, text: str = "text", ident: str = "doc_id", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """docs with one row of each group of equal texts, columns as they were; rows that can't be hits don't move."""
    rows = _rows(docs, text, ident, digest)
    index = _indexed(rows)
    flagged = index.with_maybe(rows)
    found = _looked_up(index, flagged.filter("maybe").drop("maybe"))
    kept = _verified(found.filter("n is not null")).filter("kept").select("row")
    return flagged.filter("not maybe").select("row").unionByName(found.filter("n is null").select("row")).unionByName(kept).select("row.*")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = duplicate_groups(docs)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
