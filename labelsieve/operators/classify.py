"""Class probabilities: out-of-fold logistic regression, and the centroid fallback.

Both give ``probability``: an array with one value per class code.
"""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.control import bind
from labelsieve.functions.vectors import l2_norm, l2_normalize
from labelsieve.operators.checks import union_all
from labelsieve.operators.encode import class_weights, stratified_folds
from labelsieve.schema import CENTROID_TEMPERATURE
from labelsieve.session import materialize, small_table

CENTROID_FLOOR = 1e-8
TILE_CLASSES = 512
TILE_COPIES = 32
BLOCK_ROWS = 1024
PARALLEL_FITS = 2


def centroids(df: DataFrame, code: str, unit: str) -> DataFrame:
    """Unit-length mean of every class: (code, centroid). The sums combine on the map side."""
    means = df.groupBy(code).agg(vector_to_array(Summarizer.mean(array_to_vector(F.col(unit)))).alias("_mean"))
    length = F.greatest(l2_norm(F.col("_mean")), F.lit(CENTROID_FLOOR))
    return means.select(code, bind(length, lambda floor: F.transform("_mean", lambda v: v / floor)).alias("centroid"))


def centroid_matrix(df: DataFrame, code: str, unit: str, classes: int) -> np.ndarray:
    """The centroids as a matrix in code order: a model of classes x width doubles."""
    width = len(df.select(unit).first()[0])
    matrix = np.zeros((classes, width))
    for row in centroids(df, code, unit).collect():
        matrix[row[code]] = row["centroid"]
    return matrix


def with_centroid_probability(df: DataFrame, vector: str, matrix: np.ndarray, out: str = "probability") -> DataFrame:
    """Softmax of 8 x cosine to every centroid, row by row in Arrow batches, no shuffle. A zero vector has cosine 0."""

    @F.pandas_udf("array<double>")
    def softmax(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            rows = np.stack(list(batch)).astype(np.float64)
            length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            logits = rows / np.where(length > 0, length, 1.0) @ matrix.T * CENTROID_TEMPERATURE
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            yield pd.Series(list(logits / logits.sum(axis=1, keepdims=True)))

    return df.withColumn(out, softmax(F.col(vector)))


def class_tiles(units: DataFrame, code: str, unit: str, tile_classes: int = TILE_CLASSES) -> DataFrame:
    """(tile, codes, centroids): the centroids of neighbouring class codes, packed; tiles count from 0."""
    numbered = centroids(units, code, unit).select(
        F.floor(F.col(code) / tile_classes).cast("int").alias("tile"), F.struct(F.col(code).cast("long").alias("code"), "centroid").alias("_c"))
    packed = numbered.groupBy("tile").agg(F.array_sort(F.collect_list("_c")).alias("_cs"))  # at most ``tile_classes`` of them
    return packed.select("tile", F.col("_cs.code").alias("codes"), F.flatten("_cs.centroid").alias("centroids"))


def _row_blocks(df: DataFrame, block_rows: int) -> DataFrame:
    """Rows (id, vec, wanted) packed by partition: (ids, sizes, wanted, matrix), wanted codes of all rows in one list."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), block_rows):
                part = batch.iloc[begin:begin + block_rows]
                matrix = np.stack(list(part["vec"])).astype(np.float64)
                length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                yield pd.DataFrame([{
                    "ids": part["id"].to_numpy(np.int64), "sizes": part["wanted"].map(len).to_numpy(np.int32),
                    "wanted": np.concatenate(list(part["wanted"])).astype(np.int64), "matrix": (matrix / np.where(length > 0, length, 1.0)).tobytes()}])

    return df.select("id", "vec", "wanted").mapInPandas(pack, "ids array<bigint>, sizes array<int>, wanted array<bigint>, matrix binary")


def sparse_centroid_probability(
    df: DataFrame, code: str, vector: str, wanted: Column, tile_classes: int = TILE_CLASSES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, likeliest, peak, shares): softmax of 8 x cosine to the centroids of all classes, for the classes that matter.

    ``likeliest`` is the most probable class (the lowest code on a tie), ``peak`` its probability, ``shares`` an array of
    (code, p) for the distinct codes in ``wanted``. Blocks of rows meet tiles of classes; each meeting gives a row's
    greatest logit and the sum of exponentials below it, and these merge over the tiles. So no row holds a value for every
    class, no class table passes the driver, and one tile, the usual case, needs no merge of more than one row.
    """
    units = df.select(F.col(code).alias("code"), l2_normalize(F.col(vector)).alias("unit"))
    tiles = materialize(class_tiles(units, "code", "unit", tile_classes))
    count = tiles.count()
    rows = df.select("id", F.col(vector).alias("vec"), F.array_distinct(wanted).cast("array<bigint>").alias("wanted"))
    blocks = _row_blocks(rows, block_rows).withColumns({
        "tile": F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)))), "copy": F.pmod(F.xxhash64("ids"), F.lit(TILE_COPIES)).cast("int")})
    copied = tiles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(TILE_COPIES - 1))))  # many blocks meet a tile: not all in one task

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples(index=False):
                ids, codes = np.asarray(block.ids), np.asarray(block.codes)
                matrix = np.frombuffer(block.matrix).reshape(len(ids), -1)
                logits = matrix @ np.asarray(block.centroids).reshape(len(codes), -1).T * CENTROID_TEMPERATURE
                best = logits.argmax(axis=1)  # codes ascend, so the first of equal ones is the lowest
                top = logits[np.arange(len(ids)), best]
                owner, wanted = np.repeat(np.arange(len(ids)), block.sizes), np.asarray(block.wanted)
                place = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
                here = codes[place] == wanted
                found = [[] for _ in range(len(ids))]
                for row, name, value in zip(owner[here], wanted[here], logits[owner[here], place[here]]):
                    found[row].append({"code": int(name), "logit": float(value)})
                yield pd.DataFrame({
                    "id": ids, "best": codes[best], "top": top, "rest": np.exp(logits - top[:, None]).sum(axis=1), "found": found})

    met = blocks.join(copied, ["tile", "copy"]).select("ids", "sizes", "wanted", "matrix", "codes", "centroids").mapInPandas(
        meet, "id bigint, best bigint, top double, rest double, found array<struct<code:bigint,logit:double>>")
    parts = met.groupBy("id").agg(
        F.collect_list(F.struct("top", (-F.col("best")).alias("low"), "rest", "found")).alias("_p"))  # a row per tile
    peak = F.array_max(F.transform("_p", lambda p: F.struct(p["top"], p["low"])))

    def merged(best: Column) -> Column:
        total = F.aggregate("_p", F.lit(0.0), lambda s, p: s + p["rest"] * F.exp(p["top"] - best["top"]))
        shares = bind(total, lambda whole: F.transform(F.flatten(F.transform("_p", lambda p: p["found"])), lambda w: F.struct(
            w["code"].alias("code"), (F.exp(w["logit"] - best["top"]) / whole).alias("p"))))
        return F.struct((-best["low"]).alias("likeliest"), (F.lit(1.0) / total).alias("peak"), shares.alias("shares"))

    return parts.select("id", bind(peak, merged).alias("_m")).select("id", "_m.*")


class FoldModels(NamedTuple):
    """``data``: the rows with ``fold``, ``_vector`` and ``_weights``, a weight for every model; ``models`` by fold;
    ``train_rows`` of each."""

    data: DataFrame
    models: list
    train_rows: list[int]


def fit_folds(
    df: DataFrame, item: str, code: str, features: str, folds: int,
    max_iter: int = 1200, tol: float = 1e-6, seed: int = 42, parallel: int = PARALLEL_FITS,
) -> FoldModels:
    """A logistic regression for every fold, fitted on the rows of the other folds.

    Same objective as an L2 logistic regression with C=1 and balanced weights: these weights sum to the number of
    training rows m, so the penalty per row is 1/m, on unscaled features. All fits read one table, in which a row has a
    weight for each model, 0 for that of its own fold; at most ``parallel`` of them run and hold their instances at a time.
    """
    unit = array_to_vector(l2_normalize(F.col(features)))
    dealt = stratified_folds(df, code, item, folds, seed).withColumn("_vector", unit)
    weights = small_table(class_weights(dealt, code, "fold", folds).withColumnRenamed("fold", "_for"))
    sums = {row["_for"]: row["m"] for row in weights.groupBy("_for").agg(F.sum("train_rows").alias("m")).collect()}
    by_class = weights.groupBy(code).agg(F.map_from_entries(F.collect_list(F.struct("_for", "weight"))).alias("_by_fold"))
    every = F.array(*[
        F.when(F.col("fold") == k, 0.0).otherwise(F.coalesce(F.try_element_at("_by_fold", F.lit(k).cast("long")), F.lit(0.0))) for k in range(folds)])
    data = materialize(dealt.join(small_table(by_class), code).withColumn("_weights", every).drop("_by_fold"))

    def fit(fold: int):
        train = data.select(F.col(code).cast("double").alias("_label"), "_vector", F.get("_weights", F.lit(fold)).alias("weight"))
        return LogisticRegression(
            featuresCol="_vector", labelCol="_label", weightCol="weight", predictionCol="_prediction",
            rawPredictionCol="_raw", probabilityCol="_probability", regParam=1.0 / sums[fold],
            elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=tol,
        ).fit(train)

    pool = ThreadPool(min(parallel, folds))
    try:
        models = pool.map(inheritable_thread_target(df.sparkSession)(fit), range(folds), chunksize=1)
    finally:
        pool.close()
    return FoldModels(data, models, [sums[k] for k in range(folds)])


def out_of_fold_probability(
    df: DataFrame, item: str, code: str, features: str, classes: int, folds: int, out: str = "probability", **options,
) -> DataFrame:
    """Each fold is predicted by the model fitted on the others (``fit_folds``, which takes the ``options``)."""
    fitted = fit_folds(df, item, code, features, folds, **options)
    zeros = F.array_repeat(F.lit(0.0), classes)
    predicted = []
    for fold, model in enumerate(fitted.models):
        held = model.transform(fitted.data.filter(F.col("fold") == fold))
        full = F.slice(F.concat(vector_to_array("_probability"), zeros), 1, classes)
        predicted.append(held.withColumn(out, full).drop("_raw", "_probability", "_prediction"))
    return union_all(predicted).drop("_vector", "_weights", "fold")


def gradient_norms(fitted: FoldModels, code: str) -> list[float]:
    """By fold the length of the objective's gradient at the fitted model; 0 at the optimum.

    The gradient is summed over the training rows where they are, as one vector per partition.
    """
    norms = []
    for fold, model in enumerate(fitted.models):
        classes, width = model.numClasses, model.numFeatures
        weighted = fitted.data.withColumn("_w", F.get("_weights", F.lit(fold))).filter("_w > 0")
        rows = model.transform(weighted).select(
            F.col(code).cast("long").alias("c"), "_w", vector_to_array("_probability").alias("p"), vector_to_array("_vector").alias("x"))

        def sums(batches: Iterator[pd.DataFrame], shape=(classes, width + 1)) -> Iterator[pd.DataFrame]:
            total, mass = np.zeros(shape), 0.0
            for batch in batches:
                if len(batch):
                    p, x, w = np.stack(list(batch["p"])), np.stack(list(batch["x"])), batch["_w"].to_numpy()
                    p = p.copy()
                    p[np.arange(len(p)), batch["c"]] -= 1.0
                    total += (p * w[:, None]).T @ np.column_stack([x, np.ones(len(x))])
                    mass += w.sum()
            yield pd.DataFrame([{"g": np.append(total.ravel(), mass)}])

        parts = rows.mapInPandas(sums, "g array<double>").select(Summarizer.sum(array_to_vector("g")).alias("s")).first().s.toArray()
        slope = parts[:-1].reshape(classes, width + 1) / max(parts[-1], 1e-300)
        if classes == 2 and model.coefficientMatrix.numRows == 1:
            slope, coefficients = slope[1:], model.coefficientMatrix.toArray()
        else:
            coefficients = model.coefficientMatrix.toArray()
        slope[:, :width] += coefficients / fitted.train_rows[fold]
        norms.append(float(np.sqrt((slope * slope).sum())))
    return norms
