"""Command line: python -m motif_engine search | features | phrases | status | health. Results are lines of JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motif_engine.corpus import Corpus, search_corpora
from motif_engine.functions.transforms import TRANSFORMATIONS, parse_pattern
from motif_engine.operators import features
from motif_engine.operators.search import SearchRequest
from motif_engine.operators.segment import SegmentationConfig
from motif_engine.schema import CorpusError
from motif_engine.sources import events, files, sqlite


def open_corpus(spark: SparkSession, at: str) -> Corpus:
    """kind:path, where kind is solos (SQLite), xml (MusicXML glob), file (JSON or MIDI) or events (driver tables)."""
    kind, _, path = at.partition(":")
    if kind == "solos":
        return sqlite.solo_corpus(spark, path)
    if kind == "xml":
        return Corpus("xml", *files.read_musicxml(spark, path))
    if kind == "events":
        return events.corpus(spark, path)
    if kind == "file":
        notes = files.read_transcription(spark, path)
        meta = notes.select("melid").distinct().select("melid", F.col("melid").alias("title"), F.lit("Unknown").alias("performer"), F.lit(None).cast("int").alias("year"))
        return Corpus("file", notes, meta)
    raise CorpusError(f"unknown corpus {at!r}")


def _printed(df: DataFrame, out: Callable[[str], object]) -> None:
    for line in df.toJSON().toLocalIterator():
        out(line)


def main(args: list[str], out: Callable[[str], object] = print, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="motif_engine")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search")
    s.add_argument("pattern", help="'2 2 1' or '2,2,1'")
    s.add_argument("--corpus", action="append", required=True)
    s.add_argument("--transformation", default="interval", choices=TRANSFORMATIONS)
    s.add_argument("--min-similarity", type=float, default=0.8)
    s.add_argument("--max-length-difference", type=int, default=0)
    s.add_argument("--max-edit-distance", type=int)
    s.add_argument("--min-frequency", type=int, default=1)
    s.add_argument("--limit", type=int, default=50)
    f = sub.add_parser("features")
    f.add_argument("--corpus", required=True)
    f.add_argument("--config", default="basic", choices=sorted(features.CONFIGS))
    g = sub.add_parser("phrases")
    g.add_argument("--corpus", required=True)
    g.add_argument("--skip-first-beats", type=float, default=0.0)
    d = sub.add_parser("status")
    d.add_argument("paths", nargs="+", help="name=path or name=glob")
    sub.add_parser("health")
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.appName("motif_engine").getOrCreate()
    if a.command == "health":
        out(json.dumps({"status": "ok", "spark": spark.version}))
    elif a.command == "status":
        _printed(files.data_status(spark, dict(x.partition("=")[::2] for x in a.paths)), out)
    elif a.command == "features":
        _printed(open_corpus(spark, a.corpus).features(features.CONFIGS[a.config]), out)
    elif a.command == "phrases":
        _printed(open_corpus(spark, a.corpus).phrases(SegmentationConfig(skip_first_beats=a.skip_first_beats)), out)
    else:
        corpora = [open_corpus(spark, c) for c in a.corpus]
        request = SearchRequest(
            parse_pattern(a.pattern), tuple(c.name for c in corpora), a.transformation, a.min_similarity, a.max_length_difference, a.max_edit_distance, a.min_frequency, a.limit
        )
        found = search_corpora(corpora, request)
        if found.matches is not None:
            _printed(found.matches.drop("enc"), out)
        for name, error in found.errors.items():
            print(f"{name}: {error}", file=sys.stderr)
        return int(bool(found.errors))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
