"""Tables of a SQLite file as a Spark data source, and solos from the tables of a solo database.

Options: path, table, and partitions with a numeric column partition_column. Equality and range filters on any
column go into the file's own query.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from motif_engine.functions.transforms import time_signature
from motif_engine.schema import CorpusError, validate_notes

_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


class SqliteDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> StructType:
        with _open(self.options["path"]) as c:
            columns = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not columns:
            raise CorpusError(f"no table {self.options['table']} in {self.options['path']}")
        kinds = {"INT": LongType(), "REA": DoubleType(), "FLO": DoubleType(), "DOU": DoubleType(), "NUM": DoubleType()}
        return StructType([StructField(c[1], kinds.get((c[2] or "TEXT")[:3].upper(), StringType())) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), schema)


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.schema, self.where = options, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _OPERATORS and len(f.attribute) == 1 and isinstance(f.value, (int, float, str)):
                self.where.append((f"{_quoted(f.attribute[0])} {_OPERATORS[type(f)]} ?", f.value))
            else:
                yield f

    def partitions(self) -> list[_Range]:
        n, column = int(self.options.get("partitions", "1")), self.options.get("partition_column")
        if n < 2 or not column:
            return [_Range(None, None)]
        with _open(self.options["path"]) as c:
            low, high = c.execute(f"SELECT min({_quoted(column)}), max({_quoted(column)}) FROM {_quoted(self.options['table'])}").fetchone()
        if low is None:
            return [_Range(None, None)]
        cuts = [low + (high - low + 1) * i // n for i in range(1, n)]
        return [_Range(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        where, values = [w for w, _ in self.where], [v for _, v in self.where]
        column = _quoted(self.options.get("partition_column", ""))
        if partition.low is not None:
            where.append(f"{column} >= ?")
            values.append(partition.low)
        if partition.high is not None:
            where.append(f"({column} < ?" + (f" OR {column} IS NULL)" if partition.low is None else ")"))
            values.append(partition.high)
        casts = [{"long": int, "double": float}.get(f.dataType.typeName(), str) for f in self.schema.fields]
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        with _open(self.options["path"]) as c:
            for row in c.execute(f"SELECT {columns} FROM {_quoted(self.options['table'])}" + (" WHERE " + " AND ".join(where) if where else ""), values):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))


def read_table(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteDataSource)
    return spark.read.format("sqlite_table").options(path=path, table=table, **options).load()


def write_table(df: DataFrame, path: str, table: str) -> int:
    """Rows of df in place of the table's own, and their count. A file has one writer: one task takes them batch by batch, and none go to the driver."""
    insert = f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, df.columns))}) VALUES ({', '.join('?' * len(df.columns))})"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with closing(sqlite3.connect(f"file:{path}?mode=rw", uri=True, timeout=600, isolation_level=None)) as c:
            c.execute("BEGIN IMMEDIATE")  # a failed attempt leaves nothing, a second one writes the same rows again
            c.execute(f"DELETE FROM {_quoted(table)}")
            for b in batches:
                values = [x.to_pylist() if x.null_count else x.to_numpy(zero_copy_only=False).tolist() for x in b.columns]  # the latter is 20 times as fast
                c.executemany(insert, zip(*values, strict=True))
                n += b.num_rows
            c.execute("COMMIT")
        yield pa.RecordBatch.from_pydict({"n": [n]})

    done = df.repartition(1).mapInArrow(write, "n long").collect()
    if not done:  # no task runs over what Spark knows to be empty
        list(write(iter(())))
    return sum(r.n for r in done)


#: Instrument codes of the solo database.
INSTRUMENTS = {
    "as": "Alto saxophone", "ts": "Tenor saxophone", "ss": "Soprano saxophone", "bs": "Baritone saxophone", "ts-c": "C melody saxophone",
    "tp": "Trumpet", "cor": "Cornet", "tb": "Trombone", "cl": "Clarinet", "bcl": "Bass clarinet", "p": "Piano", "g": "Guitar", "vib": "Vibraphone",
}


def instrument(code) -> F.Column:
    pairs = [F.lit(x) for kv in INSTRUMENTS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code, F.lit(""))


def solos_from_tables(solo_info: DataFrame, melody: DataFrame, composition_info: DataFrame, record_info: DataFrame, corpus: str = "wjazzd") -> tuple[DataFrame, DataFrame]:
    """(notes, metadata): notes in beats at the solo's average tempo, of solos with four pitched notes or more; metadata of all solos.

    Of several rows of one composition or record the one that sorts first counts.
    """

    def first(df: DataFrame, key: str, *columns: str) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*columns)).alias("row")).select(key, "row.*")

    comp = first(composition_info, "compid", "composer", "form")
    rec = first(record_info, "recordid", "artist", "recordtitle", "releasedate")
    s = solo_info.join(comp, "compid", "left").join(rec, "recordid", "left")
    tempo = F.col("avgtempo").cast("double")
    bpm = F.when(tempo > 0, tempo).otherwise(F.lit(120.0))
    num, den = time_signature(F.col("signature"))
    year = F.substring("releasedate", 1, 4).try_cast("int")
    melid = F.concat(F.lit(f"{corpus}-"), F.col("melid").cast("string"))
    title = F.when(F.length("title") > 0, F.trim(F.concat_ws(" ", "title", "titleaddon"))).otherwise("Unknown")
    extra = {"source_melid": "melid", "composer": "composer", "form": "form", "chorus_count": "chorus_count", "tempoclass": "tempoclass"}
    meta = s.select(
        F.col("melid").alias("solo_key"), melid.alias("melid"), title.alias("title"), F.coalesce(F.when(F.length("performer") > 0, F.col("performer")), F.lit("Unknown")).alias("performer"),
        year.alias("recording_year"), year.alias("track_year"), year.alias("year"), instrument(F.col("instrument")).alias("instrument"), F.col("key").alias("key"),
        F.when(tempo != 0, bpm.cast("int")).alias("tempo_bpm"), bpm.alias("bpm"), "style", F.lit(corpus).alias("source_corpus"), F.lit(None).cast("string").alias("audio_url"),
        num.alias("ts_num"), den.alias("ts_den"), F.create_map(*[x for k, c in extra.items() for x in (F.lit(k), F.col(c).cast("string"))]).alias("extra"),
    )
    m = melody.filter(F.col("pitch") > 0).select(F.col("melid").alias("solo_key"), "onset", "pitch", "duration")
    enough = m.groupBy("solo_key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4").select("solo_key")
    beat = F.lit(60.0) / F.col("bpm")
    place = W.partitionBy("solo_key").orderBy("onset", "pitch", "duration")
    notes = m.join(enough, "solo_key", "left_semi").join(meta.select("solo_key", "melid", "bpm"), "solo_key").select(
        "melid", (F.row_number().over(place) - 1).cast("long").alias("note_idx"), F.rint("pitch").cast("int").alias("pitch"), (F.col("onset") / beat).alias("onset_beat"),
        (F.col("duration") / beat).alias("duration_beats"), F.lit(None).cast("int").alias("velocity"),
    )
    return notes, meta.drop("solo_key", "bpm")


def read_solo_database(spark: SparkSession, path: str, partitions: int = 1, bad_notes: str = "raise", key: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(notes, metadata) of a solo database file, or of its solo with this key; bad_notes is validate_notes' mode."""
    import os

    if not os.path.exists(path):
        raise CorpusError(f"no database at {path}")
    parted = {"partitions": str(partitions), "partition_column": "melid"} if partitions > 1 else {}
    tables = {t: read_table(spark, path, t, **(parted if t == "melody" else {})) for t in ("solo_info", "melody", "composition_info", "record_info")}
    if key is not None:  # both filters go into the file's own queries
        tables |= {t: tables[t].filter(F.col("melid") == key) for t in ("solo_info", "melody")}
    notes, meta = solos_from_tables(**tables)
    return validate_notes(notes, bad_notes), meta


def solo_corpus(spark: SparkSession, path: str, partitions: int = 1, corpus: str = "wjazzd"):
    """The file as a corpus whose lookups read one solo's rows."""
    from motif_engine.corpus import Corpus

    def lookup(melid: str) -> tuple[DataFrame, DataFrame]:
        digits = melid.removeprefix(f"{corpus}-")
        known = digits.isascii() and digits.isdigit() and digits != melid
        return read_solo_database(spark, path, key=int(digits) if known else -1)

    return Corpus(corpus, *read_solo_database(spark, path, partitions), lookup)
