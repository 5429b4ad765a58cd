"""Transformations of pitch sequences, as Columns over one value or over an array.

Names: pitch (as it is), interval (differences of neighbours), fuzzyinterval (signed size classes of intervals),
cdpcx (degree of the chord's scale, -1 outside it).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMATIONS = ("pitch", "interval", "fuzzyinterval", "cdpcx")

#: Pitch classes of the scales that chord qualities stand for.
MAJOR = (0, 2, 4, 5, 7, 9, 11)
MINOR = (0, 2, 3, 5, 7, 8, 10)
DIMINISHED = (0, 2, 3, 5, 6, 8, 9, 11)
ALTERED = (0, 3, 4, 7, 9, 10)
MINOR_QUALITIES = ("m", "m7", "min", "min7", "minor")


def check(name: str) -> str:
    if name not in TRANSFORMATIONS:
        raise ValueError(f"unknown transformation {name!r}; one of {', '.join(TRANSFORMATIONS)}")
    return name


def size_class(interval: Column) -> Column:
    """1 stays 1, 2 stays 2, 3 and 4 become 3, wider ones and 0 stay; the sign stays."""
    size = F.abs(interval)
    return (F.signum(interval) * F.when(size <= 1, 1).when(size == 2, 2).when(size <= 4, 3).otherwise(size)).cast("int")


def degree(pitch: Column, root: Column | None = None, quality: Column | None = None) -> Column:
    """The 0-based degree of a pitch in its chord's scale, -1 outside; without a root the chord is C major."""

    def scale(values: tuple[int, ...]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    chroma = F.pmod(pitch - (F.lit(0) if root is None else root), F.lit(12))
    of = scale(MAJOR)
    if root is not None and quality is not None:
        minor = quality.isin(*MINOR_QUALITIES) | (quality.startswith("m") & ~quality.startswith("maj"))
        of = F.when(minor, scale(MINOR)).when(quality.contains("dim"), scale(DIMINISHED)).when(quality.contains("alt"), scale(ALTERED)).otherwise(of)
    return (F.array_position(of, chroma.cast("int")) - 1).cast("int")


def intervals(pitches: Column) -> Column:
    """Of an array: differences of neighbours, empty for fewer than two."""
    n = F.size(pitches)
    some = F.zip_with(F.slice(pitches, 1, n - 1), F.slice(pitches, 2, n - 1), lambda a, b: b - a)
    return F.when(n >= 2, some).otherwise(F.array().cast("array<int>"))


def transform(pitches: Column, name: str) -> Column:
    """An array of pitches (without rests) to the array of its transformed values."""
    build: dict[str, Callable[[Column], Column]] = {
        "pitch": lambda p: p,
        "interval": intervals,
        "fuzzyinterval": lambda p: F.transform(intervals(p), size_class),
        "cdpcx": lambda p: F.transform(p, lambda x: degree(x)),
    }
    return build[check(name)](pitches)


def midi_to_hz(pitch: Column) -> Column:
    return F.lit(440.0) * F.pow(F.lit(2.0), (pitch - 69) / F.lit(12.0))


def hz_to_midi(hz: Column) -> Column:
    """The nearest pitch, halves to even; null for no frequency."""
    return F.when(hz > 0, F.rint(69 + 12 * F.log2(hz / F.lit(440.0))).cast("int"))


def note_name(pitch: Column) -> Column:
    names = F.array(*[F.lit(n) for n in ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")])
    return F.concat(F.element_at(names, (F.pmod(pitch, F.lit(12)) + 1).cast("int")), (F.floor(pitch / F.lit(12)) - 1).cast("string"))


def parse_pattern(text: str) -> list[int]:
    """'2, 2 1' to [2, 2, 1]; at least two numbers."""
    values = [int(x) for x in re.split(r"[\s,]+", text.strip()) if x]
    if len(values) < 2:
        raise ValueError("a pattern has at least two values")
    return values


def time_signature(text: Column) -> tuple[Column, Column]:
    """'6/8' to 6 and 8; 4 and 4 for anything else."""
    parts = F.split(text, "/")
    num = F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).try_cast("int")
    den = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).try_cast("int")
    fine = num.isNotNull() & den.isNotNull()
    return F.when(fine, num).otherwise(4), F.when(fine, den).otherwise(4)
