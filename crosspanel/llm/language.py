"""Language identification: multinomial logistic regression on character n-grams.

Features are hashed n-grams of one to three characters (letters lower-cased, all else a space),
weighted by relative frequency in the text and inverse document frequency over all training
documents. The weights are learned by follow-the-regularised-leader with elastic-net penalties, from
a bounded sample of labelled documents, and one temperature, fitted on a part of the sample that
the weights did not see, calibrates the scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import as_strings, in_small_batches, trimming

#: Hashed features; a power of two.
FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
#: Labelled rows that the weights are learned from: of each language, and of all together.
SAMPLE_PER_LABEL, SAMPLE_ROWS = 400, 8192
#: Weights of a model: with very many languages, n-grams share features.
MOST_WEIGHTS = 1 << 23
#: Scales relative frequencies to values that the learner's rates suit.
SCALE = 40.0
UNKNOWN = "und"
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    if not _LETTERS:
        _LETTERS.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32))
    return _LETTERS[0]


def ngrams(text: str, bits: int = FEATURE_BITS) -> np.ndarray:
    """Hashed features of all n-grams of the whole text; empty if it has no letter."""
    points = letters()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")]
    if not (points != 32).any():
        return np.empty(0, dtype=np.uint32)
    points = np.concatenate([[32], points, [32]]).astype(np.uint32)
    with np.errstate(over="ignore"):
        one = points * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x51ED270B)) * np.uint32(0x85EBCA6B) + points[1:] * np.uint32(0xC2B2AE35)
        three = (two[:-1] ^ np.uint32(0x2545F491)) * np.uint32(0x27D4EB2F) + points[2:] * np.uint32(0x165667B1)
        return np.concatenate([one * np.uint32(0x27D4EB2F), two * np.uint32(0x9E3779B1), three * np.uint32(0x9E3779B1)]) >> np.uint32(32 - bits)


@dataclass
class LanguageModel:
    labels: list[str]
    #: idf times weight, features x labels
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int = FEATURE_BITS

    def scores(self, features: np.ndarray) -> np.ndarray:
        logits = (self.weights[features].mean(axis=0) * SCALE + self.bias) / self.temperature
        e = np.exp(logits - logits.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        features = ngrams(text, self.bits) if text and self.labels else np.empty(0)
        if not len(features):
            return UNKNOWN, 0.0
        p = self.scores(features)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def learn_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], labels: int, features: int = FEATURES, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = 4, seed: int = 11) -> np.ndarray:
    """Weights, ``features`` and a bias last x ``labels``, by FTRL-proximal with per-coordinate rates."""
    z, n = np.zeros((features + 1, labels)), np.zeros((features + 1, labels))

    def weight(at: np.ndarray) -> np.ndarray:
        zs, ns = z[at], n[at]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in draw.permutation(len(rows)):
            at, x, y = rows[i]
            w = weight(at)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weight(np.arange(features + 1))


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, ratio = np.log(0.3), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train_language_model(docs: DataFrame, training: Column, per_label: int = SAMPLE_PER_LABEL, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on the rows of ``docs`` where ``training`` holds and text and lang are not null.

    Document frequencies count all of these rows, and every value of lang is learned. The weights
    are learned from ``per_label`` rows of each language at most, and about ``sample_rows`` of all
    (but one of each language at least): those whose hash of doc_id and text is smallest. Without
    rows the model knows no language.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    rows = docs.where(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    labels = sorted(r.lang for r in counts)
    total = sum(r.n for r in counts)
    if not labels:
        return LanguageModel([], np.zeros((FEATURES, 1)), np.zeros(1), 1.0)
    bits = max(8, min(FEATURE_BITS, int(math.log2(MOST_WEIGHTS / len(labels)))))
    per_label = max(1, min(per_label, sample_rows // len(labels)))
    sizes = spark.createDataFrame([(r.lang, min(1.0, 3.0 * per_label / r.n + 1e-3)) for r in counts], "lang string, share double")
    # few more rows than needed are ranked: those whose draw, as a share of its range, is small enough
    drawn = rows.join(F.broadcast(sizes), "lang").where(F.col("draw") / 2.0**64 + 0.5 <= F.col("share"))
    drawn = drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= per_label)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for text in as_strings(batch.column(0)):
                seen = np.zeros(1 << bits, dtype=bool)
                seen[ngrams(text, bits)] = True
                total += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["feature", "n"])

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.unique(ngrams(t, bits), return_counts=True) for t in as_strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a.astype(np.int32) for a, _ in made], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in made], pa.list_(pa.int32())), batch.column(2)], names=["lang", "feature", "n", "draw"]
            )

    found = rows.select("text").mapInArrow(trimming(frequencies), "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(1 << bits)
    for r in found:
        df[r.feature] = r.n
    idf = np.log((1 + total) / (1 + df)) + 1
    sample = drawn.select("lang", "text", "draw").mapInArrow(trimming(term_counts), "lang string, feature array<int>, n array<int>, draw bigint").collect()
    learn, hold = [], []
    for r in sorted(sample, key=lambda r: (r.draw, r.lang)):
        if not r.feature:
            continue
        at, n = np.array(r.feature), np.array(r.n, dtype=float)
        row = (np.append(at, 1 << bits), np.append(SCALE * n / n.sum() * idf[at], 1.0), labels.index(r.lang))
        (hold if r.draw % 5 == 0 else learn).append(row)
    w = learn_ftrl(learn, len(labels), 1 << bits)
    logits = np.array([x @ w[at] for at, x, _ in hold]) if hold else np.zeros((0, len(labels)))
    return LanguageModel(labels, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], fit_temperature(logits, np.array([y for *_, y in hold], dtype=int)), bits)


def predict_language(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, with lang_pred and score (0 to 1) of its whole text.

    A text that is null or has no letter is ``und`` with score 0. Repeated rows each get a row, an
    empty table gives none; ``keep`` may hold any columns but lang_pred and score.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # features x labels: of fixed size

    more = [] if "text" in keep else ["text"]
    at = [*keep, *more].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns[: len(keep)], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, *more).mapInArrow(trimming(run), f"{fields}, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of ``least`` or more, by a model
    trained on the labelled rows.

    Texts that are null or have no letter go. Without labelled rows all texts with a letter stay.
    Repeated rows stay repeated, an empty table gives an empty table, and all columns, whatever
    their names, stay. Texts are read whole."""
    model = train_language_model(docs, F.lit(True))
    if not model.labels:  # nothing to learn from: nothing is rejected but texts without letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    columns = docs.columns
    renamed = {c: f"kept_{i}" for i, c in enumerate(columns) if c != "text"}
    plain = docs.select(*[F.col(f"`{c}`").alias(renamed.get(c, c)) for c in columns])
    told = predict_language(plain, model, tuple(renamed.get(c, c) for c in columns))
    kept = told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(renamed.get(c, c)).alias(c) for c in columns])


def identify(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred and score: train where ``held_out`` is false, predict all.

    A text that is null or has no letter is ``und`` with score 0, as are all texts where nothing can
    be learned. A null ``held_out`` counts as false in the result and is not trained on. Repeated
    rows each get a row, an empty table gives none; columns other than doc_id, text and lang, whatever
    their names, are not read (but by ``held_out``)."""
    model = train_language_model(docs, ~held_out)
    return predict_language(docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text"), model, ("doc_id", "held_out"))
