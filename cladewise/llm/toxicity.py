"""Operator 2: toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .common import pick

WORD = re.compile(r"[^\W\d_]+")
#: A word is a feature if so many of the labelled rows have it; their number is bounded by the rows' words.
LEAST_ROWS = 12
RIDGE, STEPS, RATE = 2e-3, 80, 0.3
#: A feature takes part in a category's model if its share of positive rows is so many deviations off.
TELLING = 3.5
#: Labelled rows that a chain is fitted on at most; so much goes to the driver, however many labels there are.
SAMPLE = 12_000
FOLDS = 3
THRESHOLD = 0.5


def features(text: str) -> np.ndarray:
    """The hashes (CRC-32) of the words of a whole text in lower case, each once, in order."""
    words = {*WORD.findall(text.lower())}
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint32, len(words)))


class Rows:
    """Sparse rows end to end; known: the hashes that are features, in order."""

    def __init__(self, rows: list[np.ndarray], least: int = LEAST_ROWS):
        every = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        hashes, place, number = np.unique(every, return_inverse=True, return_counts=True)
        common = number >= least
        kept = common[place] if len(every) else np.zeros(0, bool)
        self.known = hashes[common]
        self.place = (np.cumsum(common) - 1)[place][kept] if len(every) else place
        self.row, self.count = owner[kept], len(rows)

    def telling(self, target: np.ndarray, use: np.ndarray) -> Rows:
        """The rows with only the features that lean to one class among the rows in use."""
        used = use[self.row]
        number = np.bincount(self.place[used], minlength=len(self.known)).astype(float)
        hits = np.bincount(self.place[used], target[self.row[used]], len(self.known))
        share = target[use].mean() if use.any() else 0.0
        off = np.abs(hits - number * share) / np.sqrt(np.maximum(number * share * (1 - share), 1e-9))
        out = object.__new__(Rows)
        out.chosen = np.flatnonzero((off > TELLING) & (number > 0))
        to = np.full(len(self.known), -1)
        to[out.chosen] = np.arange(len(out.chosen))
        kept = to[self.place] >= 0
        out.known, out.place, out.row, out.count = self.known[out.chosen], to[self.place[kept]], self.row[kept], self.count
        return out

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.place], self.count)

    def turned_dot(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, x[self.row], len(self.known))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: Rows, extra: np.ndarray, target: np.ndarray, use: np.ndarray, steps: int = STEPS, ridge: float = RIDGE, rate: float = RATE) -> np.ndarray:
    """Weights (features, extra columns, bias) of a logistic model of the rows in `use`, classes weighted evenly; Adam on all rows."""
    n = int(use.sum())
    positive = max(1, int(target[use].sum()))
    share = np.where(target > 0, n / (2 * positive), n / (2 * max(1, n - positive))) * use / max(1, n)
    every = len(rows.known)
    rows = rows.telling(target, use)
    size = len(rows.known)
    weights = np.zeros(size + extra.shape[1] + 1)
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, steps + 1):
        score = rows.dot(weights[:size]) + extra @ weights[size:-1] + weights[-1]
        off = (sigmoid(score) - target) * share
        slope = np.concatenate([rows.turned_dot(off), extra.T @ off, [off.sum()]]) + ridge * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        weights -= rate / (1 + step / 30) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(every + extra.shape[1] + 1)
    out[rows.chosen], out[every:] = weights[:size], weights[size:]
    return out


class Chain:
    """The hashes that are features, and one model's weights for each category in order."""

    def __init__(self, known: np.ndarray, models: list[np.ndarray]):
        self.index = {int(h): i for i, h in enumerate(known)}
        self.models = models

    def probabilities(self, text: str) -> list[float]:
        """The chain's probabilities of one text, category by category."""
        index, size = self.index, len(self.index)
        hashes = {zlib.crc32(w.encode()) for w in {*WORD.findall(text.lower())}}
        places = np.array([index[h] for h in hashes & index.keys()], np.int64)
        out: list[float] = []
        for w in self.models:
            out.append(float(sigmoid(w[places].sum() + w[size:-1] @ np.array(out) + w[-1])))
        return out


def chain_of(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """One model for each label column, in order.

    A later model sees the probabilities of the earlier categories. In training these
    are out-of-fold predictions, from models that did not see the row, so they are as
    good as they will be on new rows.
    """
    sparse, models = Rows(rows), []
    size = len(sparse.known)
    seen = np.zeros((len(rows), 0))
    for k in range(labels.shape[1]):
        target = labels[:, k].astype(float)
        known = ~np.isnan(target)
        target = np.nan_to_num(target)
        out = np.zeros(len(rows))
        if k + 1 < labels.shape[1]:
            for f in range(FOLDS):
                held = folds == f
                w = fit(sparse, seen, target, known & ~held)
                score = sparse.dot(w[:size]) + seen @ w[size:-1] + w[-1]
                out[held] = sigmoid(score)[held]
        models.append(fit(sparse, seen, target, known))
        seen = np.c_[seen, out]
    return Chain(sparse.known, models)


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int = SAMPLE) -> Chain:
    """A chain fitted on at most `sample` labelled rows, those whose ids hash lowest.

    Rows without id, text or any label take no part and leave their place in the sample
    to others; of a document labelled twice both labels count, equal ones once. Of
    repeated documents each row counts, up to `sample` rows in all, so no more than that
    comes to the driver. Without a labelled row of both classes the chain says 0.5 at
    most, so it rejects nothing.
    """
    texts = pick(docs, "doc_id", "text").where("text is not null")
    told = pick(labels, "doc_id", *categories).where(F.col("doc_id").isNotNull() & F.coalesce(*categories).isNotNull()).distinct()
    told = told.join(texts.select("doc_id"), "doc_id", "left_semi")
    told = told.orderBy(F.xxhash64("doc_id"), *categories).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [features(x.as_py()).tobytes() for x in batch.column("text")]
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], [*kept, "places"])

    joined = texts.join(F.broadcast(told), "doc_id")  # at most `sample` rows
    kinds = [(f.name, f.dataType.simpleString()) for f in joined.schema if f.name != "text"]
    found = joined.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*kinds, ("places", "binary")]))
    got = found.orderBy(F.xxhash64("doc_id"), *categories, "places").limit(sample).toPandas()
    got = got.sort_values(["doc_id", *categories]).reset_index(drop=True)
    rows = [np.frombuffer(x, np.uint32) for x in got["places"]]
    folds = np.array([zlib.crc32(str(x).encode()) % FOLDS for x in got["doc_id"]], int)
    values = got[list(categories)].to_numpy(float) if len(got) else np.zeros((0, len(categories)))
    return chain_of(rows, values, folds)


def scorer(docs: DataFrame, chain: Chain, categories: tuple[str, ...]):
    """A Column function of text: a struct of the categories' probabilities. A null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # at most SAMPLE rows' words / LEAST_ROWS features

    @F.pandas_udf(", ".join(f"`{c}` double" for c in categories))
    def score(texts: pd.Series) -> pd.DataFrame:
        out = [sent.value.probabilities(t or "") for t in texts]
        return pd.DataFrame(np.array(out).reshape(-1, len(categories)), columns=list(categories))

    return score


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """doc_id and the probability of each category, p_<category>, of each row, its whole text read; one narrow pass.

    Null texts count as empty; null ids and repeated rows are kept row by row; an empty
    table gives no rows; other columns are left out.
    """
    chain = train(docs, labels, categories)
    rows = pick(docs, "doc_id", "text")
    scored = rows.select("doc_id", scorer(docs, chain, categories)(F.coalesce("text", F.lit(""))).alias("_p"))
    return scored.select("doc_id", *(F.col(f"_p.{c}").alias(f"p_{c}") for c in categories))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose probability of `toxic` exceeds the threshold; columns as they were."""
    categories = ("quality", "toxic")
    chain = train(docs, labels, categories)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = F.coalesce(F.col(f"c{docs.columns.index('text')}"), F.lit(""))
    kept = plain.withColumn("_p", scorer(docs, chain, categories)(text)).where(F.col("_p.toxic") <= threshold).drop("_p")
    return kept.toDF(*docs.columns)
