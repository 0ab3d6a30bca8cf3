"""Neighbour vote, blend with class probabilities, suspicion score and suggestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.control import bind
from labelsieve.functions.vectors import has_non_finite, is_finite_number
from labelsieve.operators.classify import out_of_fold_probability, sparse_centroid_probability
from labelsieve.operators.encode import class_codes, class_encode, class_summary
from labelsieve.operators.neighbors import APPROXIMATE_PROBES, neighbor_lists
from labelsieve.schema import CLASSIFIER_WEIGHT, DISTANCE_OFFSET, NEIGHBOR_WEIGHT, NEIGHBORS
from labelsieve.session import materialize


def vote_weight(distance: Column) -> Column:
    return F.lit(1.0) / (F.greatest(F.lit(0.0), distance) + F.lit(DISTANCE_OFFSET))


def vote_shares(neighbors: Column, k: int = NEIGHBORS) -> Column:
    """Normalised vote of a neighbour list: array<struct<code,share>>, one entry per class that got votes."""
    def shares(valid: Column) -> Column:
        total = F.aggregate(valid, F.lit(0.0), lambda sum_, n: sum_ + vote_weight(n["distance"]))
        codes = F.array_sort(F.array_distinct(F.transform(valid, lambda n: n["neighbor_label"])))

        def share(code: Column, whole: Column) -> Column:
            mass = F.aggregate(
                F.filter(valid, lambda n: n["neighbor_label"] == code), F.lit(0.0),
                lambda sum_, n: sum_ + vote_weight(n["distance"]),
            )
            return F.struct(code.alias("code"), (mass / F.greatest(whole, F.lit(1e-8))).alias("share"))

        return bind(total, lambda whole: F.transform(codes, lambda code: share(code, whole)))

    return bind(F.slice(F.filter(neighbors, lambda n: is_finite_number(n["distance"])), 1, k), shares)


def share_of(shares: Column, code: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(shares, lambda s: s["code"] == code), F.lit(1))["share"], F.lit(0.0))


def at(probability: Column, code: Column) -> Column:
    """Probability of a class that ``shares`` of a sparse probability holds."""
    return F.try_element_at(F.filter(probability["shares"], lambda s: s["code"] == code), F.lit(1))["p"]


def sparse_of(dense: Column, code: Column, neighbors: Column) -> Column:
    """(likeliest, peak, shares of the own and the voted classes) of an array with one value per class."""
    codes = F.array_distinct(F.concat(F.array(code), F.transform(neighbors, lambda n: n["neighbor_label"])))
    peak = F.array_max(dense)
    shares = F.transform(codes, lambda c: F.struct(c.alias("code"), F.element_at(dense, (c + 1).cast("int")).alias("p")))
    return F.struct((F.array_position(dense, peak) - 1).cast("long").alias("likeliest"), peak.alias("peak"), shares.alias("shares"))


def blend_at(probability: Column, shares: Column, code: Column) -> Column:
    """0.7 x probability + 0.3 x vote of one class."""
    return at(probability, code) * F.lit(CLASSIFIER_WEIGHT) + share_of(shares, code) * F.lit(NEIGHBOR_WEIGHT)


def best_blend(probability: Column, shares: Column) -> Column:
    """Class with the highest blend, the lowest code on a tie.

    Only classes with votes and the most probable class can win, so the others are never looked at.
    """
    def entry(value: Column, code: Column) -> Column:
        return F.struct(value.alias("value"), (-code).alias("low"))

    voted = F.transform(shares, lambda s: entry(
        at(probability, s["code"]) * F.lit(CLASSIFIER_WEIGHT) + s["share"] * F.lit(NEIGHBOR_WEIGHT), s["code"]))
    unvoted = F.array(entry(probability["peak"] * F.lit(CLASSIFIER_WEIGHT), probability["likeliest"]))
    return -F.array_max(F.concat(voted, unvoted))["low"]


def score_rows(df: DataFrame) -> DataFrame:
    """(id, code, probability, neighbors) -> scores, computed inside the row: no shuffle.

    ``probability`` is sparse: (likeliest, peak, shares). Without any neighbour the probabilities stand in for the vote.
    """
    rows = df.withColumn("_shares", vote_shares(F.col("neighbors")))
    own, probability, shares = F.col("code"), F.col("probability"), F.col("_shares")
    lonely = F.size("neighbors") == 0
    likeliest = probability["likeliest"]
    judged = rows.select(
        "id", "code",
        F.when(lonely, likeliest).otherwise(best_blend(probability, shares)).alias("suggested_code"),
        F.when(lonely, at(probability, own)).otherwise(blend_at(probability, shares, own)).alias("confidence"),
        F.when(lonely, at(probability, own)).otherwise(share_of(shares, own)).alias("support"),
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("confidence")) * 100))
    return judged.select("id", "code", score.alias("score"), "suggested_code", "confidence", "support")


def scorable(df: DataFrame, item: str, label: str, features: str) -> tuple[DataFrame, DataFrame]:
    """(rows that can be scored, (item, reason) of the others): no label, no vector, a non-finite or missing value."""
    vector = F.col(features)
    gap = F.exists(vector, lambda v: v.isNull())
    reason = (
        F.when(F.col(label).isNull(), "no_label").when(vector.isNull() | (F.size(vector) == 0), "no_features")
        .when(F.coalesce(gap | has_non_finite(vector), F.lit(True)), "non_finite_feature"))
    judged = df.withColumn("_reason", reason)
    return judged.filter("_reason IS NULL").drop("_reason"), judged.filter("_reason IS NOT NULL").select(
        F.col(item).alias("item"), F.col("_reason").alias("reason"))


def suspicion_scores(
    df: DataFrame, item: str, label: str, features: str, classifier: str = "auto",
    neighbors: str = "exact", probes: int = APPROXIMATE_PROBES, **classifier_options,
) -> DataFrame:
    """The whole scoring of a labelled feature table.

    Returns (id, label, score, suggested_label, confidence, support), written out, because a sort or a report would
    otherwise run the scoring twice. ``classifier`` is ``logreg``, ``centroid`` or ``auto``: logistic regression when
    there are at least two classes with at least two members each. ``neighbors`` is ``exact``, at every size, or
    ``approximate``: then only the cells of the ``probes`` nearest pivots are searched. Rows that ``scorable`` sets aside
    are not scored and influence no other row.
    """
    if neighbors not in ("exact", "approximate"):
        raise ValueError("neighbors must be 'exact' or 'approximate'")
    df, _ = scorable(df, item, label, features)
    codes = class_codes(df, label)
    summary = class_summary(codes).first()
    if classifier == "auto":
        classifier = "logreg" if summary.folds else "centroid"
    encoded = class_encode(df, label, codes).select(
        F.col(item).cast("long").alias("id"), "code", F.col(features).alias("vec")
    )
    lists = neighbor_lists(encoded, "id", "vec", "code", probes=probes if neighbors == "approximate" else None)
    if classifier == "centroid":
        lists = materialize(lists)
        voted = F.concat(F.array("code"), F.transform("neighbors", lambda n: n["neighbor_label"]))
        sparse = sparse_centroid_probability(lists, "code", "vec", voted)
        rows = lists.drop("vec").join(sparse.withColumn("probability", F.struct("likeliest", "peak", "shares")), "id")
    else:
        predicted = out_of_fold_probability(
            encoded, "id", "code", "vec", summary.classes, summary.folds, **classifier_options
        )
        joined = lists.drop("vec").join(predicted.select("id", "probability"), "id")
        rows = joined.withColumn("probability", sparse_of(F.col("probability"), F.col("code"), F.col("neighbors")))
    names = codes.select(F.col("code").alias("_code"), label)
    own = names.select(F.col("_code").alias("code"), F.col(label).alias("label"))
    suggested = names.select(F.col("_code").alias("suggested_code"), F.col(label).alias("suggested_label"))
    return materialize(
        score_rows(rows).join(own, "code").join(suggested, "suggested_code")
        .select("id", "label", "score", "suggested_label", "confidence", "support")
    )


def item_updates(scores: DataFrame, coordinates: DataFrame | None = None) -> DataFrame:
    """Scores as the update batch that is stored: score to 2 decimals, shares to 5."""
    updates = scores.select(
        "id",
        F.round("score", 2).alias("suspicion_score"),
        "suggested_label",
        F.round("confidence", 5).alias("label_confidence"),
        F.round("support", 5).alias("neighbor_support"),
        F.lit("analyzed").alias("analysis_state"),
    )
    return updates if coordinates is None else updates.join(coordinates.select("id", "x", "y"), "id")
