"""A corpus: notes and the metadata of their solos."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motif_engine.operators import features, grams, search, segment
from motif_engine.schema import to_solos


@dataclass(frozen=True)
class Corpus:
    name: str
    notes: DataFrame
    metadata: DataFrame
    #: (notes, metadata) of one solo, read by its key; without it, all are filtered by name.
    lookup: Callable[[str], tuple[DataFrame, DataFrame]] | None = None

    def _only(self, melid: str) -> Corpus:
        if self.lookup:
            return Corpus(self.name, *self.lookup(melid))
        return Corpus(self.name, self.notes.filter(F.col("melid") == melid), self.metadata.filter(F.col("melid") == melid))

    def solos(self) -> DataFrame:
        """One row per solo: metadata and an array of notes."""
        return self.metadata.join(to_solos(self.notes), "melid")

    def get(self, melid: str) -> DataFrame:
        return self._only(melid).solos()

    def __len__(self) -> int:
        """All solos that the corpus names, also those without enough notes to be iterated."""
        return self.metadata.count()

    def total_notes(self) -> int:
        return self.notes.count()

    def all_ngrams(self, n: int = 5, transformation: str = "interval") -> DataFrame:
        return grams.grams(self.notes, n, transformation)

    def search(self, pattern: list[int], expand_lengths: bool = False, **options: object) -> DataFrame:
        request = search.SearchRequest(pattern, databases=(self.name,), **options)
        return search.search_notes(self.notes, request, self.metadata, expand_lengths)

    def search_solo(self, melid: str, pattern: list[int], **options: object) -> DataFrame:
        request = search.SearchRequest(pattern, databases=(self.name,), **options)
        one = self._only(melid)
        return search.search_notes(one.notes, request, one.metadata)

    def features(self, config: features.MachineConfig = features.BASIC) -> DataFrame:
        return features.extract(self.notes, config)

    def phrases(self, config: segment.SegmentationConfig = segment.SegmentationConfig()) -> DataFrame:
        return segment.phrases(self.notes, config)


def search_corpora(corpora: list[Corpus], request: search.SearchRequest) -> search.MergedSearch:
    return search.search_databases({c.name: (lambda c=c: (c.notes, c.metadata)) for c in corpora}, request)
