"""Two-dimensional coordinates of feature vectors."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.vectors import l2_normalize


def project_2d(df: DataFrame, item: str, features: str) -> DataFrame:
    """(id, x, y): first two principal components of the unit vectors, centred.

    The signs are fixed: the largest loading of each component is positive. Only the width x width covariance and the
    mean leave the executors.
    """
    rows = df.select(F.col(item).alias("id"), array_to_vector(l2_normalize(F.col(features))).alias("_v"))
    summary = rows.agg(Summarizer.metrics("mean", "count").summary(F.col("_v")).alias("_s")).first()["_s"]
    if summary["count"] < 2:
        return rows.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    mean = summary["mean"].toArray()
    model = PCA(k=min(2, len(mean)), inputCol="_v", outputCol="_p").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(loadings.shape[1])])
    centre = mean @ loadings
    placed = model.transform(rows).withColumn("_a", vector_to_array("_p"))
    axes = [(F.element_at("_a", i + 1) - float(centre[i])) * float(signs[i]) for i in range(loadings.shape[1])]
    axes += [F.lit(0.0)] * (2 - len(axes))
    return placed.select("id", axes[0].alias("x"), axes[1].alias("y"))
