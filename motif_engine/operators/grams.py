"""N-grams of transformed pitch sequences over flat notes. One exchange and sort by solo serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from motif_engine.functions import transforms as T

#: A value's character is its number plus this; pitches, intervals and degrees lie in -127..127.
OFFSET = 128


def pitched(notes: DataFrame) -> DataFrame:
    """Notes without rests, with pos: 0, 1, .. by onset (ties by note_idx) within the solo."""
    w = W.partitionBy("melid").orderBy("onset_beat", "note_idx")
    return notes.filter(F.col("pitch").isNotNull()).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def transformed(notes: DataFrame, name: str, root: Column | None = None, quality: Column | None = None) -> DataFrame:
    """Notes with pos and v, the transformed value that starts at the note; the last note has no interval."""
    T.check(name)
    w = W.partitionBy("melid").orderBy("onset_beat", "note_idx")
    p = F.col("pitch")
    step = F.lead("pitch").over(w) - p
    v = {"pitch": p, "interval": step, "fuzzyinterval": T.size_class(step), "cdpcx": T.degree(p, root, quality)}[name]
    return pitched(notes).withColumn("v", v.cast("int")).filter(F.col("v").isNotNull())


def grams(notes: DataFrame, n: int, name: str = "interval") -> DataFrame:
    """Every window of n transformed values: melid, pos, onset_beat, values, enc (one character a value)."""
    if n < 2:
        raise ValueError("n is at least 2")
    w = W.partitionBy("melid").orderBy("onset_beat", "note_idx")
    t = transformed(notes, name)
    cells = [F.lead("v", i).over(w) if i else F.col("v") for i in range(n)]
    out = t.select("melid", "pos", "onset_beat", *[c.alias(f"v{i}") for i, c in enumerate(cells)]).filter(F.col(f"v{n - 1}").isNotNull())
    values = [F.col(f"v{i}") for i in range(n)]
    return out.select("melid", "pos", "onset_beat", F.array(*values).alias("values"), encoded(values).alias("enc"))


def grams_of_sizes(notes: DataFrame, sizes: list[int], name: str = "interval") -> DataFrame:
    """The grams of several sizes from one pass over the windows; columns as of grams()."""
    if min(sizes) < 2:
        raise ValueError("n is at least 2")
    w = W.partitionBy("melid").orderBy("onset_beat", "note_idx")
    t = transformed(notes, name)
    longest = max(sizes)
    t = t.select("melid", "pos", "onset_beat", *[(F.lead("v", i).over(w) if i else F.col("v")).alias(f"v{i}") for i in range(longest)])
    values = [F.col(f"v{i}") for i in range(longest)]
    each = [F.when(values[n - 1].isNotNull(), F.struct(F.array(*values[:n]).alias("values"), encoded(values[:n]).alias("enc"))) for n in sorted(sizes)]
    out = t.select("melid", "pos", "onset_beat", F.explode(F.array_compact(F.array(*each))).alias("g"))
    return out.select("melid", "pos", "onset_beat", "g.values", "g.enc")


def encoded(values: list[Column]) -> Column:
    return F.concat(*[F.char(v + OFFSET) for v in values])


def encode(pattern: list[int]) -> str:
    """A pattern as the grams' characters; a value that no gram can have becomes a character that none has."""
    return "".join(chr(v + OFFSET) if -127 <= v <= 127 else chr(0) for v in pattern)


def gram_arrays(values: Column, n: int) -> Column:
    """All windows of n of an array; none if it is shorter."""
    if n < 2:
        raise ValueError("n is at least 2")
    some = F.transform(F.sequence(F.lit(1), F.size(values) - n + 1), lambda i: F.slice(values, i, n))
    return F.when(F.size(values) >= n, some).otherwise(F.array().cast("array<array<int>>"))


def solo_grams(solos: DataFrame, n: int, name: str = "interval") -> DataFrame:
    """The same grams from solos with an array of notes: melid, pos, values."""
    pitches = F.transform(F.filter("notes", lambda x: x["pitch"].isNotNull()), lambda x: x["pitch"])
    out = solos.select("melid", F.posexplode(gram_arrays(T.transform(pitches, name), n)).alias("pos", "values"))
    return out.withColumn("pos", F.col("pos").cast("long"))


def signatures(phrase_notes: DataFrame, n: int, name: str = "interval") -> DataFrame:
    """Of notes with phrase_id: each phrase's first gram; phrases with too few notes have none."""
    keyed = phrase_notes.withColumn("melid", F.struct("melid", "phrase_id"))
    first = grams(keyed, n, name).filter("pos = 0")
    return first.select("melid.melid", "melid.phrase_id", "onset_beat", "values", "enc")


def solo_or_signature_grams(notes: DataFrame, phrase_notes: DataFrame | None, n: int, name: str = "interval") -> DataFrame:
    """Signatures for solos that have phrases, all grams for the others: melid, onset_beat, values, enc."""
    columns = ["melid", "onset_beat", "values", "enc"]
    if phrase_notes is None:
        return grams(notes, n, name).select(*columns)
    rest = notes.join(phrase_notes.select("melid").distinct(), "melid", "left_anti")
    return signatures(phrase_notes, n, name).select(*columns).unionByName(grams(rest, n, name).select(*columns))


def frequencies(g: DataFrame) -> DataFrame:
    return g.groupBy("values").agg(F.count(F.lit(1)).alias("n"))
