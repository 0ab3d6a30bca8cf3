"""Batched model inference with a model the user supplies."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def embed_batch(
    df: DataFrame, column: str, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    batch_size: int = 64, out: str = "features",
) -> DataFrame:
    """Adds ``out``: one float vector per row. ``make_model`` runs once per worker and returns a batch function."""
    predict = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(out, predict(F.col(column)))


def byte_histogram_model() -> Callable[[np.ndarray], np.ndarray]:
    """A stand-in without weights: how often each byte value occurs in the whole UTF-8 text."""

    def predict(texts: np.ndarray) -> np.ndarray:
        raw = [np.frombuffer(str(text).encode("utf-8"), dtype=np.uint8) for text in texts]
        return np.stack([np.bincount(values, minlength=256) for values in raw]).astype(np.float32)

    return predict
