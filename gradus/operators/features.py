"""Feature vectors: text encoding and the blend with pay."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, IDFModel, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import text, vectors


@dataclass
class HashedTfIdf:
    """Text to unit vector: hashed word counts, smooth inverse document frequency.

    No substitute for a trained sentence encoder; ``encode_with`` takes one.
    """

    width: int
    weights: list[float]

    @staticmethod
    def fit(df: DataFrame, column: str, width: int = 384) -> HashedTfIdf:
        counts = HashedTfIdf._count(df, column, width, "_tf")
        model: IDFModel = IDF(inputCol="_tf", outputCol="_w").fit(counts)
        return HashedTfIdf(width, [float(x) + 1.0 for x in model.idf])

    @staticmethod
    def _count(df: DataFrame, column: str, width: int, out: str) -> DataFrame:
        tokens = F.filter(F.split(F.lower(F.coalesce(column, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
        tf = HashingTF(numFeatures=width, inputCol="_tokens", outputCol=out)
        return tf.transform(df.withColumn("_tokens", tokens)).drop("_tokens")

    def encode(self, df: DataFrame, column: str, out: str) -> DataFrame:
        counted = self._count(df, column, self.width, "_tf")
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense(self.weights), inputCol="_tf", outputCol="_w"
        ).transform(counted)
        unit = Normalizer(p=2.0, inputCol="_w", outputCol="_u").transform(weighted)
        return unit.withColumn(out, vector_to_array("_u")).drop("_tf", "_w", "_u")


def encode_with(
    df: DataFrame, column: str, out: str, load: Callable[[], Callable[[list[str]], np.ndarray]]
) -> DataFrame:
    """Encode with a user's model; ``load`` runs once per task and returns a batch encoder."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            rows = np.asarray(model(texts.fillna("").tolist()), dtype=np.float64)
            lengths = np.linalg.norm(rows, axis=1, keepdims=True)
            yield pd.Series(list(rows / np.where(lengths == 0, 1.0, lengths)), index=texts.index)

    return df.withColumn(out, encode(column))


def blend_with_pay(
    df: DataFrame, vec: str, wage: str, out: str, width: int, blend: float = fixed.WAGE_BLEND,
    proportional: bool = False,
) -> DataFrame:
    """``(1 - blend) * vec + blend * pay``, scaled to unit length.

    The pay vector is the scaled wage in every dimension brought to unit length, hence the
    same for every wage above the lowest and zero for the lowest. ``proportional`` keeps
    the scaled wage as a factor instead.
    """
    usable = F.when(~F.isnan(wage), F.col(wage))
    low, high = df.agg(F.min(usable), F.max(usable)).first()
    if low is None or high == low:
        scaled = F.lit(0.0)
    else:
        scaled = F.coalesce((usable - low) / (high - low), F.lit(0.0))
    strength = scaled if proportional else F.when(scaled > 0, 1.0).otherwise(0.0)
    shift = strength * (blend / math.sqrt(width))
    mixed = F.zip_with(vec, F.array_repeat(shift, width), lambda x, s: x * (1 - blend) + s)
    return df.withColumn("_mixed", mixed).withColumn(out, vectors.unit(F.col("_mixed"))).drop("_mixed")
