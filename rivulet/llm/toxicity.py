"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over the presence of words is fitted in numpy from confirmed toxic documents and unlabelled ones.
The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); where the bracket falls below zero, its gradient is followed
upwards. The fit uses samples of at most ``positives`` and ``unlabelled`` documents, those with the least hashes of their ids, of each at most
``words`` distinct words (those with the least hashes), and the ``features`` words whose share differs most between them. The class prior is the
share of toxic labels, or the parameter ``prior``, and is taken between PRIORS. Every document is scored on its whole text.

Defined results: a null or empty text has the score of the intercept; a null doc_id is kept, not held out and never learned from; rows given
twice get equal scores; with no confirmed document, or no unlabelled one, the score is NONE_TOXIC everywhere; where all labels are toxic the prior is
the upper one of PRIORS unless it is given; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm.arrow import map_blocks
from rivulet.llm.words import ALNUM, Words, blocks

#: Bounds of the class prior.
PRIORS = (1e-4, 0.5)
#: The score without anything to learn from: practically 0.
NONE_TOXIC = float(1 / (1 + np.exp(50)))


def fold(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float

    def score(self, words: Words) -> np.ndarray:
        z = np.full(words.docs, self.intercept)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words.hash), len(self.words) - 1)
            hit = self.words[at] == words.hash
            pairs = np.unique(words.doc[hit] * np.int64(len(self.words)) + at[hit])
            z += np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], words.docs)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(prior * R_p(+), R_u(-) - prior * R_p(-)) under the logistic loss; the second is the bracket that must not be negative."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def slope(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The bracket, and the direction that the fit descends along, by each document's z: the risk's gradient, or against a negative bracket."""
    bracket = risk(zp, zu, prior)[1]
    p, u = (1 / (1 + np.exp(-np.clip(z, -50, 50))) for z in (zp, zu))
    rest = np.concatenate([-prior * p / len(zp), u / len(zu)])
    if bracket < 0:
        return bracket, -rest
    rest[: len(zp)] += prior * (p - 1) / len(zp)
    return bracket, rest


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, features: int = 2048, rounds: int = 300) -> Model:
    """positive, unlabelled: each document's distinct word hashes."""
    prior = min(max(prior, PRIORS[0]), PRIORS[1])
    if not positive or not unlabelled:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -50.0)
    docs = [*positive, *unlabelled]
    n = len(positive)
    words, inverse = np.unique(np.concatenate(docs), return_inverse=True)
    doc = np.repeat(np.arange(len(docs)), [len(x) for x in docs])
    in_p = np.bincount(inverse[doc < n], minlength=len(words))
    in_u = np.bincount(inverse[doc >= n], minlength=len(words))
    p, u = (in_p + 0.5) / (n + 1), (in_u + 0.5) / (len(docs) - n + 1)
    strength = np.abs(p - u) / np.sqrt(p * (1 - p) / n + u * (1 - u) / (len(docs) - n))
    best = np.sort(np.lexsort((words, -np.where(in_p + in_u >= 5, strength, 0)))[:features])
    column = np.full(len(words), -1)
    column[best] = np.arange(len(best))
    x = np.zeros((len(docs), len(best)), np.float32)
    own = column[inverse]
    x[doc[own >= 0], own[own >= 0]] = 1
    w, b = np.zeros(len(best)), float(np.log(prior / (1 - prior)))
    mean, square = np.zeros(len(best) + 1), np.zeros(len(best) + 1)
    for k in range(1, rounds + 1):
        z = x @ w.astype(np.float32) + b
        zp, zu = z[:n], z[n:]
        bracket, g = slope(zp, zu, prior)
        grad = np.append(x.T @ g.astype(np.float32) + 1e-4 * w * (bracket >= 0), g.sum())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        step = 0.05 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return Model(words[best], w, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, positives: int = 2000, unlabelled: int = 6000, words: int = 4000, prior: float | None = None) -> Model:
    """Labels and texts of fold 0 are not used. What reaches the driver is at most (positives + unlabelled) * words hashes of 8 bytes."""
    spark = docs.sparkSession
    labelled = labels.where((fold(folds) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = labelled.agg(F.avg("toxic").alias("prior")).first()["prior"]
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    p = labelled.where("toxic = 1").orderBy(*by_hash).limit(positives).select("doc_id", F.lit(1).alias("kind")).collect()
    u = docs.where(fold(folds) != 0).select("doc_id").orderBy(*by_hash).limit(unlabelled).distinct().select("doc_id", F.lit(0).alias("kind")).collect()
    ids = F.broadcast(spark.createDataFrame([*p, *u], "doc_id long, kind int"))  # at most positives + unlabelled rows

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            own = Words(data, at, ALNUM, lower=True)
            yield {"doc_id": batch.column("doc_id").slice(first, n), "kind": batch.column("kind").slice(first, n), "words": [np.unique(own.hash[a : a + c])[:words].tobytes() for a, c in zip(own.first, own.count)]}

    rows = map_blocks(docs.select("doc_id", "text").join(ids, "doc_id").select("doc_id", "kind", "text"), per_batch, "doc_id long, kind int, words binary").collect()
    rows.sort(key=lambda r: (r["kind"], r["doc_id"], r["words"]))
    return fit(*([np.frombuffer(r["words"], np.uint64) for r in rows if r["kind"] == k] for k in (1, 0)), prior=prior or count or 0)


def scored(docs: DataFrame, labels: DataFrame, folds: int = 5, **params) -> DataFrame:
    """doc_id, held_out, score, predicted. params: those of ``train``."""
    model = train(docs, labels, folds, **params)

    def per_batch(batch: pa.RecordBatch):
        for first, n, data, at in blocks(batch.column("text")):
            score = model.score(Words(data, at, ALNUM, lower=True))
            yield {"doc_id": batch.column("doc_id").slice(first, n), "held_out": batch.column("held_out").slice(first, n), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

    return map_blocks(docs.select("doc_id", "text", F.coalesce(fold(folds) == 0, F.lit(False)).alias("held_out")), per_batch, "doc_id long, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """docs with all their columns, without those predicted toxic; one pass, no shuffle. Only texts go to Python, and only scores come back."""
    model = train(docs, labels, **params)

    @F.arrow_udf("double")
    def toxic(text: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(Words(data, at, ALNUM, lower=True)) for _, _, data, at in blocks(text)] or [np.zeros(0)]))

    return docs.where(toxic("text") < 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
