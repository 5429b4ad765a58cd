"""Per-solo features. Built-in ones are aggregates, so that one pass over the notes gives all of a configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C_MAJOR = (0, 2, 4, 5, 7, 9, 11)


def with_iois(notes: DataFrame) -> DataFrame:
    """notes with ioi: the interval to the next onset of the solo, rests included; null at the last note."""
    w = W.partitionBy("melid").orderBy("onset_beat", "note_idx")
    return notes.withColumn("ioi", F.lead("onset_beat").over(w) - F.col("onset_beat"))


# Aggregates over with_iois(notes), grouped by solo.


def pitch_class_histogram(bins: int = 12) -> Column:
    return F.array(*[F.count_if(F.pmod("pitch", F.lit(bins)) == i) for i in range(bins)])


def pitch_class_distribution() -> Column:
    n = F.count("pitch")
    share = [F.when(n > 0, F.count_if(F.pmod("pitch", F.lit(12)) == i) / n).otherwise(F.lit(0.0)) for i in range(12)]
    return F.map_from_arrays(F.sequence(F.lit(0), F.lit(11)), F.array(*share))


def pitch_range() -> Column:
    return F.coalesce(F.max("pitch") - F.min("pitch"), F.lit(0))


def chromaticism_ratio() -> Column:
    outside = F.when(F.col("pitch").isNotNull(), (~F.pmod("pitch", F.lit(12)).isin(*C_MAJOR)).cast("double"))
    return F.coalesce(F.avg(outside), F.lit(0.0))


def total_beats() -> Column:
    return F.coalesce(F.max(F.col("onset_beat") + F.col("duration_beats")), F.lit(0.0))


def note_density() -> Column:
    return F.when(total_beats() > 0, F.count("pitch") / total_beats()).otherwise(F.lit(0.0))


def duration_stats() -> Column:
    d = F.when(F.col("pitch").isNotNull(), F.col("duration_beats"))
    zero = F.lit(0.0)
    return F.struct(
        F.coalesce(F.avg(d), zero).alias("mean"), F.coalesce(F.percentile(d, F.lit(0.5)), zero).alias("median"), F.coalesce(F.stddev_pop(d), zero).alias("std")
    )


def rhythmic_variability() -> Column:
    ioi = F.when(F.col("ioi") > 0, F.col("ioi"))
    fine = (F.count(F.lit(1)) >= 3) & (F.avg(ioi) > 0)
    return F.coalesce(F.when(fine, F.stddev_pop(ioi) / F.avg(ioi)), F.lit(0.0))


def ioi_histogram_linear(notes: DataFrame, bins: int = 16) -> DataFrame:
    """melid, values: counts of positive intervals in bins equal parts of 0..longest, the last one closed."""
    n = with_iois(notes).withColumn("ioi", F.when(F.col("ioi") > 0, F.col("ioi")))
    step = F.max("ioi").over(W.partitionBy("melid")) / F.lit(bins)
    # the number of inner edges at or below the interval
    at = sum(((F.col("ioi") >= F.lit(float(i)) * F.col("step")).cast("int") for i in range(1, bins)), F.lit(0))
    n = n.withColumn("step", step).withColumn("at", at)
    return n.groupBy("melid").agg(F.array(*[F.count_if(F.col("at") == i) for i in range(bins)]).alias("values"))


def log_histogram(iois: np.ndarray, bins: int = 16) -> np.ndarray:
    """Counts between edges at equal steps of the logarithm, from the least (0.001 at least) to the largest value."""
    x = iois[iois > 0]
    if not x.size:
        return np.zeros(bins, np.int64)
    edges = np.logspace(np.log10(max(x.min(), 1e-3)), np.log10(x.max()), bins + 1)
    return np.histogram(x, bins=edges)[0].astype(np.int64)


def ioi_histogram_log(notes: DataFrame, bins: int = 16) -> DataFrame:
    """melid, values, error. The edges' rounding decides bins, so this goes through numpy; a solo is one group."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        onsets = pdf.sort_values(["onset_beat", "note_idx"])["onset_beat"].to_numpy()
        try:
            return pd.DataFrame({"melid": [key[0]], "values": [log_histogram(np.diff(onsets), bins).tolist()], "error": [None]})
        except ValueError as e:
            return pd.DataFrame({"melid": [key[0]], "values": [None], "error": [str(e)]})

    slim = notes.select("melid", "note_idx", "onset_beat")
    return slim.groupBy("melid").applyInPandas(one, "melid string, values array<long>, error string")


#: Features by the names that configurations use. No configuration can name other code.
AGGREGATES: dict[str, Callable[..., Column]] = {
    "pitch_class_histogram": pitch_class_histogram,
    "pc_histogram": pitch_class_histogram,
    "pitch_class_distribution": pitch_class_distribution,
    "pitch_range": pitch_range,
    "chromaticism_ratio": chromaticism_ratio,
    "note_density": note_density,
    "duration_stats": duration_stats,
    "rhythmic_variability": rhythmic_variability,
}
GROUPED: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, function: Callable[[pd.DataFrame], object], kind: str) -> None:
    """Adds a feature of one's own: function(notes of one solo, **args) to a value of the SQL type kind."""

    def grouped(notes: DataFrame, **args: object) -> DataFrame:
        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            try:
                return pd.DataFrame({"melid": [key[0]], "values": [function(pdf.sort_values(["onset_beat", "note_idx"]), **args)], "error": [None]})
            except Exception as e:  # a feature that fails for one solo leaves an error there
                return pd.DataFrame({"melid": [key[0]], "values": [None], "error": [f"{type(e).__name__}: {e}"]})

        return notes.groupBy("melid").applyInPandas(one, f"melid string, values {kind}, error string")

    GROUPED[name] = grouped


def _ioi_histogram(notes: DataFrame, bins: int = 16, log_scale: bool = True) -> DataFrame:
    if log_scale:
        return ioi_histogram_log(notes, bins)
    return ioi_histogram_linear(notes, bins).withColumn("error", F.lit(None).cast("string"))


GROUPED["ioi_histogram"] = _ioi_histogram


@dataclass(frozen=True)
class FeatureConfig:
    name: str
    function: str
    type: str = "scalar"
    args: dict = field(default_factory=dict)


@dataclass(frozen=True)
class MachineConfig:
    name: str
    features: tuple[FeatureConfig, ...]
    description: str = ""

    @classmethod
    def from_dict(cls, raw: dict) -> MachineConfig:
        """A feature has the keys name, function, type and args only."""
        return cls(raw["name"], tuple(FeatureConfig(**f) for f in raw.get("features", [])), raw.get("description", ""))


BASIC = MachineConfig(
    "basic_jazz_features",
    (
        FeatureConfig("pitch_class_histogram", "pitch_class_histogram", "histogram", {"bins": 12}),
        FeatureConfig("pitch_range", "pitch_range"),
        FeatureConfig("chromaticism_ratio", "chromaticism_ratio"),
        FeatureConfig("note_density", "note_density"),
        FeatureConfig("rhythmic_variability", "rhythmic_variability"),
    ),
)
RHYTHM = MachineConfig(
    "rhythm_features",
    (
        FeatureConfig("note_density", "note_density"),
        FeatureConfig("ioi_histogram_log", "ioi_histogram", "histogram", {"bins": 16, "log_scale": True}),
        FeatureConfig("duration_stats", "duration_stats"),
        FeatureConfig("rhythmic_variability", "rhythmic_variability"),
    ),
)
CONTOUR = MachineConfig("contour_features", (FeatureConfig("pitch_class_histogram", "pitch_class_histogram", "histogram", {"bins": 12}),))
CONFIGS = {"basic": BASIC, "rhythm": RHYTHM, "contour": CONTOUR}


def extract(notes: DataFrame, config: MachineConfig) -> DataFrame:
    """melid and a column for each feature; a grouped feature also has {name}_error."""
    for f in config.features:
        if f.function not in AGGREGATES and f.function not in GROUPED:
            raise ValueError(f"no feature {f.function!r}")
    columns = [AGGREGATES[f.function](**f.args).alias(f.name) for f in config.features if f.function in AGGREGATES]
    out = with_iois(notes).groupBy("melid").agg(*columns) if columns else notes.select("melid").distinct()
    for f in config.features:
        if f.function in GROUPED and f.function not in AGGREGATES:
            more = GROUPED[f.function](notes, **f.args).withColumnsRenamed({"values": f.name, "error": f"{f.name}_error"})
            out = out.join(more, "melid", "left")
    return out.select("melid", *[c for f in config.features for c in out.columns if c in (f.name, f"{f.name}_error")])
