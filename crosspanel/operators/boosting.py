"""Gradient boosting on histograms, many models at a time.

Features are cut at their quantiles once. For each level of a tree, tasks sum gradients and counts by
model, node, feature and bin, which a grouping merges; the driver sees these sums alone, whose size does
not depend on the rows, and sends the splits back. Folds of a walk-forward are trained together: a level
is one job, however many models there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.sources.tables import kept_table

#: Depth, rounds and step of the models that the panel's scores come from.
DEPTH, ROUNDS, RATE = 4, 300, 0.05
BINS = 64
#: After so many rounds the scores so far are written beside the rows, so that no tree is walked again.
KEPT_ROUNDS = 25


def cuts(frame: DataFrame, features: list[str], bins: int = BINS, accuracy: int = 10_000) -> list[list[float]]:
    """The quantiles that part each feature into ``bins``."""
    at = [i / bins for i in range(1, bins)]
    got = frame.agg(*[F.percentile_approx(f, at, accuracy).alias(f"q{i}") for i, f in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in got]


def binned(value: Column, edges: list[float]) -> Column:
    """How many of the edges lie below a value."""
    edge = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    return F.size(F.filter(edge, lambda e: e < value)).cast("tinyint")


class Trees:
    """The trees of one model: for each round arrays of feature, bin and value by node, as in a heap."""

    def __init__(self, base: float, depth: int) -> None:
        self.base, self.depth, self.rounds = base, depth, []

    def start(self) -> None:
        size = 2 ** (self.depth + 1)
        self.rounds.append((np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32), np.zeros(size)))

    def nodes(self, x: np.ndarray, nth: int) -> np.ndarray:
        """The node, from 1, at which each row of bins ends in the nth tree as far as it has grown."""
        feature, cut, _ = self.rounds[nth]
        at = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            inner = feature[at] >= 0
            right = x[np.arange(len(x)), np.maximum(feature[at], 0)] > cut[at]
            at = np.where(inner, 2 * at + right, at)
        return at

    def predict(self, x: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
        """What the trees from ``first`` to before ``last`` add up to, with the base if from the first on."""
        out = np.full(len(x), 0.0 if first else self.base)
        for nth in range(first, len(self.rounds) if last is None else last):
            out += self.rounds[nth][2][self.nodes(x, nth)]
        return out


def best_split(total: np.ndarray, n: np.ndarray, penalty: float, least: int) -> tuple[int, int]:
    """Feature and bin of the split of largest gain, from sums of gradients and counts by feature and bin;
    feature -1 if none gains. Of equal gains the first feature and bin win."""
    left, left_n = total.cumsum(axis=1), n.cumsum(axis=1)
    all_g, all_n = left[:, -1:], left_n[:, -1:]
    right, right_n = all_g - left, all_n - left_n
    gain = left**2 / (left_n + penalty) + right**2 / (right_n + penalty) - all_g**2 / (all_n + penalty)
    gain[(left_n < least) | (right_n < least)] = -np.inf
    gain = np.round(gain, 12)
    at = int(gain.argmax())
    return divmod(at, gain.shape[1]) if gain.flat[at] > 1e-12 else (-1, 0)


def train(frame: DataFrame, by: str, features: list[str], target: str, depth: int = DEPTH, rounds: int = ROUNDS, rate: float = RATE, bins: int = BINS, penalty: float = 1.0, least: int = 20) -> tuple[dict, list[list[float]]]:
    """A model of squared error for each value of ``by``, and the edges of the features' bins.

    Rows without the target or a feature take no part. The bins are those of all rows. Each leaf moves
    the score by ``rate`` times its mean gradient, shrunk by ``penalty`` rows of none; a node of fewer
    than twice ``least`` rows is not split. The result does not depend on the partitioning, but for the
    order in which sums are rounded.
    """
    rows = frame.dropna(subset=[*features, target])
    edges = cuts(rows, features, bins)
    x = F.array(*[binned(F.col(f), e) for f, e in zip(features, edges, strict=True)])
    data = kept_table(rows.select(F.col(by).alias("model"), x.alias("x"), F.col(target).alias("y"), F.lit(0.0).alias("score")), "bins")
    models = {r.model: Trees(r.base, depth) for r in data.groupBy("model").agg(F.avg("y").alias("base")).collect()}  # a row a model
    width = max((len(e) for e in edges), default=0) + 1
    kind = f"model {frame.schema[by].dataType.simpleString()}"

    def parts(got: pd.DataFrame):  # noqa: ANN202
        for model, part in got.groupby("model", sort=False):
            yield model, part, np.stack(part["x"].to_numpy()).astype(np.int64)

    def sums(done: int, nth: int):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            held: dict = {}
            for got in batches:
                for model, part, bins_of in parts(got):
                    trees = models[model]
                    gradient = part["y"].to_numpy() - part["score"].to_numpy() - trees.predict(bins_of, done, nth)
                    node = trees.nodes(bins_of, nth)
                    for at in np.unique(node):
                        mine = node == at
                        total, n = held.setdefault((model, int(at)), (np.zeros((len(features), width)), np.zeros((len(features), width))))
                        for f in range(len(features)):
                            total[f] += np.bincount(bins_of[mine, f], gradient[mine], width)
                            n[f] += np.bincount(bins_of[mine, f], minlength=width)
            for (model, at), (total, n) in held.items():
                place = np.flatnonzero(n)
                yield pd.DataFrame({"model": model, "node": at, "place": place, "total": total.flat[place], "n": n.flat[place]})

        return run

    def moved(done: int, last: int):  # noqa: ANN202
        def run(batches):  # noqa: ANN001, ANN202
            for got in batches:
                for model, part, bins_of in parts(got):
                    yield part.assign(score=part["score"] + models[model].predict(bins_of, done, last))

        return run

    done = 0
    for nth in range(rounds if models else 0):
        for m in models.values():
            m.start()
        for level in range(depth):
            got = data.mapInPandas(sums(done, nth), f"{kind}, node int, place int, total double, n double").where(F.col("node") >= 2**level)  # not the leaves of earlier levels
            merged = got.groupBy("model", "node", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()  # nodes of one level by bins, whatever the rows
            for (model, node), part in merged.groupby(["model", "node"]):
                feature, cut, value = models[model].rounds[nth]
                total, n = np.zeros((len(features), width)), np.zeros((len(features), width))
                total.flat[part["place"].to_numpy()], n.flat[part["place"].to_numpy()] = part["total"].to_numpy(), part["n"].to_numpy()
                all_g, all_n = total[0].sum(), n[0].sum()
                value[node] = rate * all_g / (all_n + penalty)
                f, b = feature[node], cut[node] = best_split(total, n, penalty, least)
                if f >= 0:  # the leaves, if no further level parts them
                    low, low_n = total[f, : b + 1].sum(), n[f, : b + 1].sum()
                    value[2 * node], value[2 * node + 1] = rate * low / (low_n + penalty), rate * (all_g - low) / (all_n - low_n + penalty)
        if (nth + 1) % KEPT_ROUNDS == 0:
            data = kept_table(data.mapInPandas(moved(done, nth + 1), data.schema), "bins")
            done = nth + 1
    return models, edges


def scored(frame: DataFrame, models: dict, edges: list[list[float]], by: str, features: list[str]) -> DataFrame:
    """``frame`` with a column score: null where a feature or the model is missing."""
    x = F.array(*[binned(F.col(f), e) for f, e in zip(features, edges, strict=True)])
    whole = sum((F.col(f).isNull().cast("int") for f in features), F.lit(0)) == 0
    shared = frame.sparkSession.sparkContext.broadcast(models)  # nodes of all trees: bounded by models and rounds

    @F.pandas_udf("double")
    def predict(model: pd.Series, bins_of: pd.Series) -> pd.Series:
        out = np.full(len(model), np.nan)
        for m, trees in shared.value.items():
            mine = (model == m).to_numpy()
            if mine.any():
                out[mine] = trees.predict(np.stack(bins_of[mine].to_numpy()).astype(np.int64))
        return pd.Series(out)

    return frame.withColumn("score", F.when(whole, F.nanvl(predict(F.col(by), x), F.lit(None).cast("double"))))
