from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOTES = "melid string, note_idx long, pitch int, onset_beat double, duration_beats double, velocity int"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def notes(spark):
    """Builds notes from (pitch, onset, duration[, velocity]) lists by solo."""

    def build(**solos):
        rows = [(m, i, n[0], float(n[1]), float(n[2]), n[3] if len(n) > 3 else None) for m, ns in solos.items() for i, n in enumerate(ns)]
        return spark.createDataFrame(rows, NOTES)

    return build


SAMPLE = [(60, 0, 1), (62, 1, 1), (64, 2, 1), (65, 3, 1), (67, 4, 1), (65, 5, 1), (64, 6, 1), (62, 7, 1), (60, 8, 2)]
