"""Learners: closed-form ridge, boosted trees, ensembles, equal weights, gates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ridge(frame: DataFrame, features: list[str], target: str, alpha: float = 1.0) -> dict[str, float]:
    """Ridge coefficients with an unpenalised intercept. One aggregate gathers the k x k moments;
    the driver solves the small system, whatever the number of rows."""
    rows = frame.where(F.col(target).isNotNull() & ~F.isnan(target)).dropna(subset=features)
    names = [*features, target]
    moments = [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]
    got = rows.agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{i}") for i, c in enumerate(names)], *moments).first()
    k, n = len(features), got["n"]
    if not n:
        return {**dict.fromkeys(features, 0.0), "intercept": 0.0}
    mean = np.array([got[f"s_{i}"] for i in range(k + 1)]) / n
    gram = np.array([[got[f"m_{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)]) - n * np.outer(mean, mean)
    w = np.linalg.solve(gram[:k, :k] + alpha * np.eye(k), gram[:k, k])
    return {**{f: float(x) for f, x in zip(features, w, strict=True)}, "intercept": float(mean[k] - mean[:k] @ w)}


def linear_score(weights: dict[str, float]) -> Column:
    out = F.lit(weights["intercept"])
    for f, w in weights.items():
        if f != "intercept":
            out = out + F.coalesce(F.col(f), F.lit(0.0)) * w
    return out


def boosted(frame: DataFrame, features: list[str], target: str, depth: int = 4, rounds: int = 20, seed: int = 7):  # noqa: ANN201
    """Gradient-boosted trees on the cluster; scores are not those of other boosting libraries."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    steps = [VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip"), GBTRegressor(featuresCol="_features", labelCol=target, predictionCol="score", maxDepth=depth, maxIter=rounds, seed=seed)]
    return Pipeline(stages=steps).fit(frame.where(F.col(target).isNotNull()))


def equal_weight(features: list[str]) -> Column:
    """Mean of the factors that are there."""
    n = sum((F.col(f).isNotNull().cast("int") for f in features), F.lit(0))
    return sum((F.coalesce(F.col(f), F.lit(0.0)) for f in features), F.lit(0.0)) / F.nullif(n, F.lit(0))


def ensemble(scores: list[Column]) -> Column:
    return sum(scores[1:], scores[0]) / len(scores)


def renamed_features(frame: DataFrame, wanted: list[str], flipped: dict[str, str]) -> DataFrame:
    """The columns a model was trained on; one that is missing is the negative of another."""
    return frame.select(*[c for c in frame.columns if c not in wanted], *[F.col(c) if c in frame.columns else (-F.col(flipped[c])).alias(c) for c in wanted])


def sensitivity(frame: DataFrame, weights: dict[str, float], feature: str, *by: str) -> DataFrame:
    """How much the score of each row moves if ``feature`` is put at its cross-section's median."""
    median = frame.groupBy(*by).agg(F.percentile(feature, 0.5).alias("_median"))
    return frame.join(median, list(by)).withColumn("delta", weights[feature] * (F.col(feature) - F.col("_median"))).drop("_median")


def promotion(new_ic: Column, old_ic: Column, horizon: Column, n: Column, net: Column, force: Column | None = None, delta: float = -0.015, floor: float = 0.04, least: int = 10) -> Column:
    """Why a candidate may not replace the live model, or ``promote``. What is missing or no number
    fails; a live model without a measurement (null) leaves only the floor. Economics (``n`` periods of
    mean ``net``) count at a horizon of 12 alone. ``force`` promotes whatever the rest says."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    number = lambda x: x.isNotNull() & ~F.isnan(x)
    pass_floor = holds(number(new_ic) & (new_ic >= floor))
    pass_delta = holds(number(new_ic) & (old_ic.isNull() | (number(old_ic) & (new_ic - old_ic >= delta))))
    earns = holds((n >= least) & number(net) & (F.abs(net) < float("inf")) & (net > 0))
    reason = F.when(~pass_floor, "below_floor").when(~pass_delta, "worse").when(holds(horizon == 12) & ~earns, "economics").otherwise("promote")
    return reason if force is None else F.when(holds(force), "promote").otherwise(reason)


def importances(models: list[dict[str, float]]) -> dict[str, float]:
    """Mean share of each feature over the models, each normalised to a sum of 1; shares sum to 1."""
    shares = []
    for m in models:
        size = {f: abs(w) for f, w in m.items() if f != "intercept"}
        total = sum(size.values())
        shares.append({f: w / total if total else 0.0 for f, w in size.items()})
    names = sorted({f for s in shares for f in s})
    return {f: sum(s.get(f, 0.0) for s in shares) / len(shares) for f in names}


def sensitivities(frame: DataFrame, weights: dict[str, float], *by: str) -> DataFrame:
    """``frame`` unpivoted to a row (by, entity, feature, delta) for each feature: how much the score
    moves if that feature is put at the median of its cross-section. One pass for all features."""
    features = [f for f in weights if f != "intercept"]
    long = frame.select(*by, "entity", *features).unpivot([*by, "entity"], features, "feature", "value")
    w = Window.partitionBy(*by, "feature")
    weight = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(weights[f]))])
    return long.select(*by, "entity", "feature", (weight[F.col("feature")] * (F.col("value") - F.percentile("value", 0.5).over(w))).alias("delta"))
