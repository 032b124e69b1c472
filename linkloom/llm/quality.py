"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text gives four streams of n-grams: words and word pairs (lower-cased), and shapes and shape pairs.
A word's shape is its bytes mapped to classes (upper, lower, digit, the sign itself) with runs
collapsed; a word equal to the one before it has a shape of its own. Each stream contributes the mean
weight of its n-grams, so long and short texts weigh alike.

Training uses a bounded, documented sample of the labelled texts, split into ``SHARDS`` groups. In
each epoch every shard continues from the averaged state and the states are averaged again in Spark.

Null and empty texts have no n-grams: their score is that of the bias alone. Repeated rows are scored
alike; other columns stay as they are. Without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm import words
from linkloom.llm.common import bounded_sample, held_out, pieces, stored, utf8

BITS = 18
#: Rows of the training sample; chosen by the hash of the key.
SAMPLE_ROWS = 12_000
SHARDS, EPOCHS = 8, 4
THRESHOLD = 0.3
_SCALE = 6.0
_ALPHA, _BETA, _L1, _L2 = 0.3, 1.0, 0.02, 0.1

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 97
_CLASS[65:91] = 1  # no letter, as hashing lower-cases letters
_CLASS[48:58] = 48
_CLASS[128:] = 97


def features(array: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each of the four streams: bucket of every n-gram, and each row's offsets in them."""
    data, offsets = utf8(array)
    h, at, _, _ = words.word_hashes(data, offsets)
    kind = _CLASS[data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep |= ~words.NOT_SPACE[data]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    shape = words.word_hashes(kind[keep], np.concatenate(([0], np.cumsum(keep)))[offsets])[0]
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    again[at[:-1][at[:-1] < len(h)]] = False
    shape[again] ^= np.uint64(0x5851F42D4C957F2D)
    out = []
    for i, (hashes, k) in enumerate(((h, 1), (h, 2), (shape, 1), (shape, 2))):
        g = words.grams(hashes, at, k)[0]
        g ^= np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))
        n = np.maximum(np.diff(at) - (k - 1), 0)
        out.append(((words.mix(g) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(([0], np.cumsum(n)))))
    return out


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def score(self, array: pa.Array) -> np.ndarray:
        out = np.zeros(len(array))
        for at, to in pieces(array):
            logit = np.full(to - at, self.bias)
            for buckets, offsets in features(array.slice(at, to - at)):
                n = np.diff(offsets)
                full = n > 0
                if full.any():
                    logit[full] += _SCALE * np.add.reduceat(self.weights[buckets], offsets[:-1][full]) / n[full]
            out[at:to] = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return out


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= _L1, 0.0, -(z - np.sign(z) * _L1) / ((_BETA + np.sqrt(n)) / _ALPHA + _L2))


def _train(part: pd.DataFrame, z: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One pass of per-row updates over a shard. The last place of z and n is the bias."""
    z, n = z.copy(), n.copy()
    part = part.sort_values("k")
    array = pa.array(part["t"], pa.string())
    y = part["y"].to_numpy(float)
    for at, to in pieces(array):
        streams = features(array.slice(at, to - at))
        for row in range(to - at):
            idx, values = [np.array([1 << BITS])], [np.ones(1)]
            for buckets, offsets in streams:
                own = buckets[offsets[row] : offsets[row + 1]]
                if len(own):
                    found, often = np.unique(own, return_counts=True)
                    idx.append(found)
                    values.append(_SCALE * often / len(own))
            i, x = np.concatenate(idx), np.concatenate(values)
            # Streams may share a bucket; its values then add up.
            i, back = np.unique(i, return_inverse=True)
            x = np.bincount(back, x)
            w = _weights(z[i], n[i])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y[at + row]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / _ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    full = np.flatnonzero(n)
    return pd.DataFrame({"i": full, "z": z[full], "n": n[full]})


def _trainer(state: Broadcast) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def train(part: pd.DataFrame) -> pd.DataFrame:
        return _train(part, *state.value)

    return train


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> QualityModel:
    """The sample of labels is bounded by ``rows`` and therefore broadcast to the texts."""
    named = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).filter("k is not null and y is not null")
    chosen = bounded_sample(named, "k", rows)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sample = texts.join(F.broadcast(chosen), "k").withColumn("shard", F.pmod(F.xxhash64("k"), F.lit(SHARDS)).cast("int"))
    sample = stored(sample, "quality-sample")
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        state = docs.sparkSession.sparkContext.broadcast((z, n))
        states = sample.groupBy("shard").applyInPandas(_trainer(state), "i long, z double, n double")
        # A shard that did not touch a coordinate still holds the common value there.
        mean = states.groupBy("i").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("c")).toArrow()
        state.unpersist()
        shards = min(SHARDS, sample.select("shard").distinct().count())
        if not shards:
            break
        i, rest = mean["i"].to_numpy(), shards - mean["c"].to_numpy()
        z_new, n_new = z.copy(), n.copy()
        z_new[i] = (mean["z"].to_numpy() + rest * z[i]) / shards
        n_new[i] = (mean["n"].to_numpy() + rest * n[i]) / shards
        z, n = z_new, n_new
    w = _weights(z, n)
    return QualityModel(w[:-1], float(w[-1]))


def score(docs: DataFrame, model: QualityModel, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; row-local."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(array: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(array), pa.float64())

    return docs.withColumn(to, scored(F.col(text)))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out("doc_id", 5, 0))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The registered query."""
    docs = docs.select("doc_id", "text")
    model = fit(training_rows(docs), training_rows(labels))
    scored = score(docs.withColumn("held_out", held_out("doc_id", 5, 0)), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pipeline stage: documents with a score of at least ``THRESHOLD``, all their columns as they are."""
    model = fit(training_rows(docs), training_rows(labels))
    return score(docs, model, to="__score").filter(F.col("__score") >= THRESHOLD).drop("__score")
