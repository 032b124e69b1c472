"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are folded to lower case below U+0250, everything that is not a letter counts as one blank.
N-grams of one to three characters fall into ``BUCKETS`` hash buckets. Training counts buckets per
language over a bounded, documented sample of the labelled texts; the matrix of log probabilities
(languages x buckets) is broadcast, and a batch of texts is scored in numpy by adding up the matrix
columns of each text's n-grams.

Null texts, and texts without a letter, get ``und`` and score 0. Repeated rows are scored alike.
Without any labelled text every text gets ``und``. Ties go to the alphabetically first language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import bounded_sample, held_out, pieces, utf8

BUCKETS = 1 << 15
#: Rows of the training sample; chosen by the hash of the key.
SAMPLE_ROWS = 20_000
UNKNOWN = "und"
_fold: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Character code to folded code, 0 for all that is no letter."""
    if not _fold:
        codes = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x250):
            codes[i] = ord(chr(i).lower()[0]) if unicodedata.category(chr(i))[0] in "LM" else 0
        for low, high in ((0x2000, 0x2BFF), (0x3000, 0x3004), (0xFF00, 0xFF20), (0x1F000, 0x1FAFF)):
            codes[low : high + 1] = 0
        _fold.append(codes)
    return _fold[0]


def _buckets(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram (one row for each n), and each text's offsets in the columns."""
    texts = [(t or "") + " " for t in array.to_pylist()]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    c = _folded()[codes]
    # A run of blanks is one blank, so that neither layout nor digits weigh more than words.
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    keep[offsets[:-1]] = True
    offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
    c = c[keep]
    shift = np.uint32(32 - 15)
    one = c * np.uint32(0x9E3779B1)
    two = one.copy()
    two[1:] = (two[1:] ^ (one[:-1] >> np.uint32(7))) * np.uint32(0x85EBCA77)
    three = two.copy()
    three[1:] = (three[1:] ^ (two[:-1] >> np.uint32(5)) ^ one[1:]) * np.uint32(0xC2B2AE3D)
    return np.stack([one >> shift, two >> shift, three >> shift]).astype(np.int32), offsets


@dataclass
class LanguageModel:
    """``matrix``: log probability of each bucket, a row for each language, float32."""

    languages: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def score(self, array: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for at, to in pieces(array):
            part = array.slice(at, to - at)
            buckets, offsets = _buckets(part)
            sums = np.empty((len(self.languages), to - at))
            for k, row in enumerate(self.matrix):
                each = row[buckets[0]]
                each += row[buckets[1]]
                each += row[buckets[2]]
                sums[k] = np.add.reduceat(each, offsets[:-1], dtype=np.float64) + self.prior[k]
            best = sums.argmax(0)
            scores.append(1 / np.exp(sums - sums.max(0)).sum(0))
            names += [self.languages[i] for i in best]
        return names, np.concatenate(scores) if scores else np.zeros(0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Counts come from Spark as one row for each language and bucket, which bounds what the driver gets."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("t is not null and l is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, part in batch.groupby("l"):
                array = pa.array(part["t"], pa.string())
                own = sums.setdefault(name, np.zeros(BUCKETS + 1, np.int64))
                for at, to in pieces(array):
                    own[:BUCKETS] += np.bincount(_buckets(array.slice(at, to - at))[0].ravel(), minlength=BUCKETS)
                own[BUCKETS] += len(part)
        for name, own in sums.items():
            full = np.flatnonzero(own)
            yield pd.DataFrame({"l": name, "b": full, "n": own[full]})

    counted = bounded_sample(labelled, "k", rows).select("t", "l").mapInPandas(count, "l string, b long, n long")
    table = counted.groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(table["l"].unique())
    n = np.zeros((len(names), BUCKETS + 1))
    n[table["l"].map({x: i for i, x in enumerate(names)}).to_numpy(int), table["b"].to_numpy(int)] = table["n"]
    docs_in, n = n[:, BUCKETS], n[:, :BUCKETS] + 0.5
    prior = np.log(docs_in / max(1.0, docs_in.sum())) if names else np.zeros(0)
    return LanguageModel(names, prior, np.log(n / n.sum(1, keepdims=True)).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability; no shuffle."""
    if not model.languages:
        return docs.withColumns({pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<p:string,s:double>")
    def found(array: pa.Array) -> pa.Array:
        names, scores = shared.value.score(array)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["p", "s"])

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumns({"__lettered": lettered, "__found": found(F.col(text))})
    known = F.col("__lettered")
    named = {pred: F.when(known, F.col("__found.p")).otherwise(UNKNOWN), score: F.when(known, F.col("__found.s")).otherwise(0.0)}
    return out.withColumns(named).drop("__lettered", "__found")


def query(docs: DataFrame) -> DataFrame:
    """The registered query: learn from three quarters of the documents, predict all."""
    docs = docs.select("doc_id", "text", "lang")
    apart = held_out("doc_id", 4, 2)
    model = fit(docs.filter(~apart))
    told = docs.select("doc_id", "text", apart.alias("held_out"))
    return identify(told, model).select("doc_id", "held_out", "lang_pred", "score")
