"""Classifiers on Spark ML: JVM transformers from text to model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators.terms import terms_of
from linkloom.operators.windows import top_n_per_group


class TermFeatures:
    """Counts (``counts``) and unit-length TF-IDF (``features``) vectors of a text column."""

    def __init__(self, text: str, max_features: int = 5000, stop_words: Sequence[str] = (),
                 ngram_range: tuple[int, int] = (1, 1), min_df: float = 1.0):
        self.text, self.stop_words, self.ngram_range = text, tuple(stop_words), ngram_range
        self._counter = CountVectorizer(inputCol="_terms", outputCol="counts", vocabSize=max_features, minDF=min_df)
        self._model: PipelineModel | None = None

    def _terms(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_terms", terms_of(self.text, self.stop_words, self.ngram_range))

    def fit(self, df: DataFrame) -> "TermFeatures":
        words = self._terms(df)
        counter = self._counter.fit(words)
        idf = IDF(inputCol="counts", outputCol="_idf").fit(counter.transform(words))
        # Spark's idf has no "+ 1"; scaling the counts by idf + 1 gives the smoothed form.
        scale = ElementwiseProduct(
            inputCol="counts", outputCol="_scaled", scalingVec=DenseVector(idf.idf.toArray() + 1.0)
        )
        norm = Normalizer(inputCol="_scaled", outputCol="features", p=2.0)
        self._model = PipelineModel([counter, scale, norm])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        assert self._model is not None, "fit first"
        return self._model.transform(self._terms(df)).drop("_terms", "_scaled")

    @property
    def vocabulary(self) -> list[str]:
        assert self._model is not None, "fit first"
        counter = self._model.stages[0]
        assert isinstance(counter, CountVectorizerModel)
        return counter.vocabulary


def fit_logistic(
    df: DataFrame, label: str, c: float = 0.5, features: str = "features", n_rows: int | None = None, max_iter: int = 100
) -> LogisticRegressionModel:
    """Multinomial logistic regression with inverse regularisation strength ``c``."""
    n = n_rows if n_rows is not None else df.count()
    return LogisticRegression(
        featuresCol=features,
        labelCol=label,
        family="multinomial",
        regParam=1.0 / (c * max(n, 1)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
    ).fit(df)


def fit_naive_bayes(df: DataFrame, label: str, features: str = "features", smoothing: float = 1.0) -> NaiveBayesModel:
    return NaiveBayes(featuresCol=features, labelCol=label, modelType="multinomial", smoothing=smoothing).fit(df)


def predict(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("predicted"),
                      F.array_max(vector_to_array("probability")).alias("confidence"))


def top_weights(spark, model: LogisticRegressionModel, vocabulary: Sequence[str], k_pos: int = 20, k_neg: int = 20) -> DataFrame:
    """Strongest positive and negative terms per class: ``class, term, weight, side``.

    The table has classes x vocabulary rows, both bounded by the model.
    """
    matrix = model.coefficientMatrix.toArray()
    rows = [(int(c), term, float(matrix[c][j])) for c in range(matrix.shape[0]) for j, term in enumerate(vocabulary)]
    long = spark.createDataFrame(rows, "`class` int, term string, weight double")
    up = top_n_per_group(long, ["class"], [F.desc("weight"), F.col("term")], k_pos).withColumn("side", F.lit("positive"))
    down = top_n_per_group(long, ["class"], [F.asc("weight"), F.col("term")], k_neg).withColumn("side", F.lit("negative"))
    return up.unionByName(down)
