"""Toxicity by non-negative positive-unlabelled learning.

Features: which of a text's words, and of the words' first 4, 5 and 6 letters, occur (64-bit hashes). All counts are over
all training rows: those of features in confirmed toxic texts first, of which the ones in at least LEAST_TEXTS of them
and a share of LEAST_SHARE are candidates (a text of F features bounds their number by F / LEAST_SHARE on average), then
those of the candidates in the other texts. Candidates that toxic texts have more often by MIN_Z standard errors and
MIN_LIFT times are kept, FEATURES at most. A linear classifier is fitted in numpy, on at most POSITIVES confirmed toxic
texts and UNLABELLED other texts on average, both by the doc_id's hash, to the risk
prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with logistic loss; where the bracket is below zero its
gradient is reversed. The class prior is the share of toxic rows among the labelled training rows, or less if fewer
unlabelled texts have any of the features, each counted over all of them. Scoring reads whole texts.

Edge cases: a null text counts as empty and scores as the classifier's bias; labels without a document, null
labels and null doc_ids aren't learned from; without a toxic training text every score is 0; repeated rows each
give a row; an empty table gives an empty result; other columns pass the filter as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import letters
from .common import OWN, ship, table
from .language_id import fold

POSITIVES = 4000
UNLABELLED = 8000
FEATURES = 1024
MIN_Z = 5.0
MIN_LIFT = 2.0
PREFIXES = (4, 5, 6)
LEAST_TEXTS = 3
LEAST_SHARE = 0.0005
#: Confirmed identifiers that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_ROUNDS = 400
_RATE = 0.1
_DECAY = 1e-3
_TEXTS_AT_ONCE = 512
_FILTER_BITS = 24


def features(texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts' indices, text, hash) for the features of a group of texts, repeats included."""
    for index, codes, of in letters.groups(texts):
        start, end, total = letters.words(codes)
        at, h = [of[start]], [letters.hashed(total, start, end, 0)]
        for n in PREFIXES:
            s = start[end - start >= n]
            at.append(of[s])
            h.append(letters.hashed(total, s, s + n, n))
        yield index, np.concatenate(at), np.concatenate(h)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(h, n): texts with a feature."""
    for pdf in batches:
        texts = pdf["text"].tolist()
        for k in range(0, len(texts), _TEXTS_AT_ONCE):
            seen = [np.zeros(0, np.uint64)]
            for _, at, h in features(texts[k : k + _TEXTS_AT_ONCE]):
                order = np.lexsort((h, at))
                at, h = at[order], h[order]
                seen.append(h[np.append(True, (at[1:] != at[:-1]) | (h[1:] != h[:-1]))] if len(h) else h)
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pd.DataFrame({"h": h.view(np.int64), "n": n})


class Model:
    """Sorted feature hashes, their weights and the bias."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray | None = None, bias: float = -50.0):
        self.hashes = np.sort(hashes.astype(np.int64).view(np.uint64))
        self.weights = np.zeros(len(hashes)) if weights is None else weights
        self.bias = bias

    def present(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of text and feature that occur, without repeats."""
        shift = np.uint64(64 - _FILTER_BITS)
        maybe = np.zeros(1 << _FILTER_BITS, bool) if getattr(self, "_maybe", None) is None else self._maybe
        if getattr(self, "_maybe", None) is None:
            maybe[(self.hashes >> shift).astype(np.int64)] = True
            self._maybe = maybe
        found = [np.zeros(0, np.int64)]
        n = max(1, len(self.hashes))
        for index, at, h in features(texts):
            some = maybe[(h >> shift).astype(np.int64)]
            at, h = np.array(index, np.int64)[at[some]], h[some]
            k = np.minimum(np.searchsorted(self.hashes, h), n - 1)
            same = self.hashes[k] == h if len(self.hashes) else np.zeros(len(h), bool)
            found.append(at[same] * n + k[same])
        pairs = np.unique(np.concatenate(found))
        return pairs // n, pairs % n

    def scores(self, texts: list[str | None]) -> np.ndarray:
        row, k = self.present(texts)
        z = self.bias + np.bincount(row, self.weights[k] if len(k) else None, minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_maybe"}


def fit(x: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the least non-negative risk met; full-batch Adam from fixed starts over the features present."""
    n, k = x.shape
    row, col = np.nonzero(x)
    w, m, v = np.zeros(k + 1), np.zeros(k + 1), np.zeros(k + 1)
    share = np.where(toxic, 1 / max(1, toxic.sum()), 1 / max(1, (~toxic).sum()))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    best, least = w, np.inf
    for t in range(1, _ROUNDS + 1):
        z = np.bincount(row, w[col], n) + w[-1]
        as_clean = np.logaddexp(0, z) * share
        bracket = as_clean[~toxic].sum() - prior * as_clean[toxic].sum()
        positive = bracket >= 0
        risk = prior * (np.logaddexp(0, -z[toxic]) * share[toxic]).sum() + max(0.0, bracket) + 0.5 * _DECAY * prior * (w[:-1] ** 2).sum()
        if risk < least:
            best, least = w, risk
        # of the loss as clean: the unlabelled texts' less prior times the toxic ones'; of that as toxic: prior times these
        of_clean = sigmoid(z) * share * np.where(toxic, -prior, 1.0)
        g = of_clean + np.where(toxic, -prior * sigmoid(-z) * share, 0.0) if positive else -of_clean
        g = np.append(np.bincount(col, g[row], k), g.sum())
        g[:-1] += _DECAY * w[:-1] * prior
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - _RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return best[:-1], float(best[-1])


def _occurrences(texts: DataFrame, model: Model, any_feature: bool = False) -> DataFrame:
    """(k, n): texts with the model's feature k, or, as 0, texts with any of them; a task returns a row for each at most."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(max(1, len(model.hashes)), np.int64)
        for pdf in batches:
            t = pdf["text"].tolist()
            for k in range(0, len(t), _TEXTS_AT_ONCE):
                row, feature = model.present(t[k : k + _TEXTS_AT_ONCE])
                n += np.bincount(np.zeros(len(np.unique(row)), np.int64) if any_feature else feature, minlength=len(n))
        k = np.flatnonzero(n)
        yield pd.DataFrame({"k": k, "n": n[k]})

    return texts.select("text").mapInPandas(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ident: str = "doc_id", toxic: str = "toxic") -> Model:
    """docs: the texts that may be learned from; labels (ident, toxic) of rows that may be learned from."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col(ident).isNotNull() & F.col(toxic).isNotNull()).select(F.col(ident).alias("id"), F.col(toxic).cast("int").alias("toxic"))
    prior = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not prior:
        return Model(np.zeros(0, np.int64))
    prior = min(prior, 0.9)
    texts = docs.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(text).alias("text"))
    confirmed = table(known.groupBy("id").agg(F.max("toxic").alias("toxic")).filter("toxic = 1").select("id"), "confirmed")
    chosen = confirmed.orderBy(F.xxhash64("id"), "id").limit(POSITIVES)
    if confirmed.count() <= BROADCAST_IDS:
        confirmed = F.broadcast(confirmed)
    positive = table(texts.join(confirmed, "id", "left_semi"), "positive")
    others = texts.join(confirmed, "id", "left_anti")
    n, np_ = texts.count(), float(positive.count())
    nu = n - np_
    if not np_ or not nu:
        return Model(np.zeros(0, np.int64))
    often = positive.select("text").mapInPandas(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("p"))
    often = often.filter((F.col("p") >= LEAST_TEXTS) & (F.col("p") >= LEAST_SHARE * np_)).orderBy("h").collect()
    candidates = Model(np.array([r.h for r in often], np.int64))
    p = {r.h: r.p for r in often}
    counted = np.zeros(len(candidates.hashes))
    for r in _occurrences(others, candidates).collect():  # a row for each candidate at most
        counted[r.k] = r.n
    p = np.array([p[h] for h in candidates.hashes.view(np.int64).tolist()], float)
    both = (p + counted) / (np_ + nu)
    z = (p / np_ - counted / nu) / np.sqrt(both * (1 - both) * (1 / np_ + 1 / nu) + 1e-12)
    fine = np.flatnonzero((z >= MIN_Z) & (p / np_ >= MIN_LIFT * counted / nu))
    fine = fine[np.lexsort((candidates.hashes[fine], -z[fine]))][:FEATURES]
    hashes = candidates.hashes[fine].view(np.int64)
    model = Model(hashes)
    if not len(hashes):
        return model
    any_of = [sum(r.n for r in _occurrences(t, model, True).collect()) / m for t, m in ((positive, np_), (others, nu))]
    # if toxic texts have a feature with probability p, unlabelled ones have one with prior * p at least
    prior = min(prior, any_of[1] / max(any_of[0], 1e-9))
    toxic_texts = positive.join(F.broadcast(chosen), "id", "left_semi").select("id", "text", F.lit(True).alias("toxic"))
    unlabelled = others.filter(F.pmod(F.xxhash64("id", F.lit("unlabelled")), F.lit(1 << 30)) < min(1.0, UNLABELLED / nu) * float(1 << 30))
    sample = table(toxic_texts.unionByName(unlabelled.select("id", "text", F.lit(False).alias("toxic"))), "sample")

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            row, k = model.present(pdf["text"].tolist())
            cuts = np.searchsorted(row, np.arange(1, len(pdf)))
            yield pd.DataFrame({"id": pdf["id"], "toxic": pdf["toxic"], "k": np.split(k, cuts)})

    got = sample.mapInPandas(present, sample.select("id", "toxic").schema.add("k", ArrayType(LongType()))).select("id", "toxic", "k").collect()
    got.sort(key=lambda r: (str(r.id), r.toxic))
    x = np.zeros((len(got), len(hashes)), bool)
    for i, r in enumerate(got):
        x[i, r.k] = True
    is_toxic = np.array([r.toxic for r in got])
    model.weights, model.bias = fit(x, is_toxic, max(prior, 1e-4))
    return model


def score(docs: DataFrame, model: Model, text: str, name: str) -> DataFrame:
    """docs and a double."""
    ship(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        t = texts.tolist()
        return pd.Series(np.concatenate([model.scores(t[k : k + _TEXTS_AT_ONCE]) for k in range(0, len(t), _TEXTS_AT_ONCE)] or [np.zeros(0)]))

    return docs.withColumn(name, scored(F.col(f"`{text}`")))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without those that score 0.5 or more."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return score(docs, model, text, f"{OWN}score").filter(F.col(f"{OWN}score") < 0.5).select(*columns)


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """From the rows outside the held-out fold."""
    return train(docs.filter(fold("doc_id", 5) != 0), labels.filter(fold("doc_id", 5) != 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = score(docs, learned(docs, labels), "text", "score")
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
