"""Language identification by nearest centroid.

Vectors: hashed counts of letter 1-, 2- and 3-grams of the whole lower-cased text, with every run of other
characters as one separator, damped as log(1 + n), times the inverse document frequency, of length one. Document
frequencies are counted over all training rows. For each language, spherical k-means on a sample of SAMPLE
training rows on average (by the doc_id's hash) gives CENTROIDS centroids and, for each, the distance that
REJECT_SHARE of its members stay within. A text takes the language of the centroid of the largest cosine; beyond
that centroid's distance it is marked as rejected and its score is halved. The score is the language's share of
exp(cosine / TEMPERATURE), summed over the best cosines of the languages.

Edge cases: a null text, an empty one and one without letters give 'und' and score 0, and so do all texts if no
row can be learned from; ties go to the language that sorts first; rows with null lang or null doc_id aren't
learned from; repeated rows each give a row; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import letters
from .common import ship

DIMENSIONS = 4096
GRAMS = (1, 2, 3)
SAMPLE = 1000
CENTROIDS = 4
REJECT_SHARE = 0.995
TEMPERATURE = 0.05
_ROUNDS = 12
_TEXTS_AT_ONCE = 256


def fold(ident: str, n: int) -> Column:
    return F.crc32(F.col(ident).cast("string")) % n


def gram_counts(texts: list[str | None]) -> np.ndarray:
    """A row of DIMENSIONS counts for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for index, codes, of in letters.groups(texts):
        letter = letters.is_letter()[codes]
        keep = letter | np.append(False, letter[:-1])  # of other characters the one after a letter
        c, of = np.where(letter, codes, 32)[keep].astype(np.uint64), of[keep]
        flat = np.zeros(len(index) * DIMENSIONS, np.int64)
        for n in GRAMS:
            if len(c) < n:
                continue
            h = np.zeros(len(c) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(1_000_003) + c[k : len(c) - n + 1 + k]
            h = ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)
            at = of[: len(h)]
            fine = at == of[n - 1 :] if n > 1 else letter[keep]
            flat += np.bincount((at * DIMENSIONS + h.astype(np.int64))[fine], minlength=len(flat))
        np.add.at(out, index, flat.reshape(len(index), DIMENSIONS))
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of a column text: the number of texts that have each gram bucket, and of all texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(DIMENSIONS, np.int64), 0
        for pdf in batches:
            t = pdf["text"].tolist()
            for k in range(0, len(t), _TEXTS_AT_ONCE):
                df += (gram_counts(t[k : k + _TEXTS_AT_ONCE]) > 0).sum(axis=0)
            n += len(t)
        yield pd.DataFrame({"at": np.arange(DIMENSIONS + 1), "n": np.append(df, n)})

    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in texts.select("text").mapInPandas(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r.n
    return out[:-1], int(out[-1])


def k_means(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: centroids and their members' quantile of distance."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(_ROUNDS):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].sum(axis=0)
                c[j] = m / max(np.sqrt(m @ m), 1e-12)
    dot = x @ c.T
    own = dot.argmax(axis=1)
    far = [float(np.quantile(1 - dot[own == j, j], REJECT_SHARE)) if (own == j).any() else 0.0 for j in range(len(c))]
    return c, np.array(far)


class Model:
    def __init__(self, langs: list[str], centroids: np.ndarray, far: np.ndarray, idf: np.ndarray):
        self.langs, self.centroids, self.far, self.idf = langs, centroids, far, idf
        self.names = sorted(set(langs))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts = gram_counts(texts)
        some = counts.any(axis=1)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        dot = vectors(counts, self.idf) @ self.centroids.T
        of = np.array([self.names.index(x) for x in self.langs])
        best = np.stack([dot[:, of == j].max(axis=1) for j in range(len(self.names))], axis=1)
        lang = best.argmax(axis=1)
        share = np.exp((best - best.max(axis=1, keepdims=True)) / TEMPERATURE)
        share = 1 / share.sum(axis=1)
        rejected = 1 - dot.max(axis=1) > self.far[dot.argmax(axis=1)] + 1e-6
        score = np.where(some, np.clip(np.where(rejected, share / 2, share), 0, 1), 0.0)
        return [self.names[j] if s else "und" for j, s in zip(lang.tolist(), some.tolist(), strict=True)], score, rejected | ~some


def train(docs: DataFrame, text: str = "text", lang: str = "lang", ident: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fits on docs; every row of docs with a lang counts towards document frequencies."""
    ship(docs.sparkSession)
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each language
    df, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    if not counts:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.zeros(0), idf)
    # only the sample's texts are shuffled
    limit = F.try_element_at(F.create_map(*[F.lit(x) for k, m in sorted(counts.items()) for x in (k, int(min(1.0, sample / m) * (1 << 30)))]), F.col("lang"))
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limit).select("lang", "text")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["text"].tolist()
        x = np.concatenate([vectors(gram_counts(t[k : k + _TEXTS_AT_ONCE]), idf) for k in range(0, len(t), _TEXTS_AT_ONCE)])
        x = x[x.any(axis=1)]
        if not len(x):
            return pd.DataFrame({"lang": [], "c": [], "far": []})
        c, far = k_means(x, CENTROIDS)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "c": list(c), "far": far})

    got = sorted(chosen.groupBy("lang").applyInPandas(fit, "lang string, c array<float>, far double").collect(), key=lambda r: (r.lang, r.far))
    return Model([r.lang for r in got], np.array([r.c for r in got], np.float32), np.array([r.far for r in got]), idf)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score, rejected."""
    ship(docs.sparkSession)
    columns = list(keep)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), _TEXTS_AT_ONCE):
                cut = pdf.iloc[k : k + _TEXTS_AT_ONCE]
                lang, s, rejected = model.predict(cut["__text"].tolist())
                yield cut[columns].assign(lang_pred=lang, score=s.astype(float), rejected=rejected)

    schema = docs.select(*columns).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*columns, F.col(text).alias("__text")).mapInPandas(score, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(fold("doc_id", 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
