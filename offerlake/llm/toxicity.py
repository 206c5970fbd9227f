"""Toxicity: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import freed, slices, stored
from .words import Memory

WORD = re.compile(r"[^\W_]+")
SHOUTED = re.compile(r"\b[A-Z]{2,}\b")
DISGUISED = re.compile(r"[^\W\d_]+(?:[0-9@$*!|]+[^\W\d_]+)+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
PLAIN = str.maketrans("0134578@$!|", "oieastbasil")
#: Insults that a labelled sample may lack.
SEEDS = frozenset("idiot idiots moron morons stupid dumb loser losers trash scum worthless pathetic disgusting clown imbecile bastard filth vermin ugly".split())
#: Second persons in the corpus's languages.
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus".split())
NAMES = (
    "log_words", "hits", "weight", "distinct_hits", "largest_weight", "three_largest", "hits_by_you", "you", "capitals",
    "shouted", "marks", "punctuation", "disguised", "disguised_hits", "stretched", "seeds",
)
#: Classes of bytes: 1 capital, 2 small letter or other text, 3 exclamation or question mark, 4 other punctuation.
CLASSES = np.full(256, 2, np.uint8)
CLASSES[:33] = 0
for _c in range(33, 127):
    CLASSES[_c] = 1 if chr(_c).isupper() else 3 if chr(_c) in "!?" else 2 if chr(_c).isalnum() else 4


def units(word: str) -> tuple[str, ...]:
    """What a lexicon may hold of a word: the word, and its beginnings, which inflected forms share."""
    return (word, *(f"{word[:n]}-" for n in (5, 7) if len(word) > n))


class Lexicon:
    """Weights of units, learned from labelled texts."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.of = Memory(lambda word: max((weights.get(u, 0.0) for u in units(word)), default=0.0))

    def __reduce__(self):
        return Lexicon, (self.weights,)

    def features(self, text: str | None) -> list[float]:
        text = text or ""
        words = WORD.findall(text.lower())
        n = max(len(words), 1)
        weights = np.fromiter(map(self.of.__getitem__, words), np.float64, len(words))
        at = np.flatnonzero(weights)
        best = sorted({words[i]: weights[i] for i in at}.values(), reverse=True)
        you = [i for i, w in enumerate(words) if w in YOU]
        near = 0.0
        if you and len(at):
            k = np.searchsorted(you, at)
            y = np.array([-99, *you, len(words) + 99])
            near = float(np.mean(np.minimum(at - y[k], y[k + 1] - at) <= 5))
        counts = np.bincount(CLASSES[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=5)
        letters, size = max(counts[1] + counts[2], 1), max(len(text), 1)
        disguised = DISGUISED.findall(text)
        return [
            math.log1p(len(words)), len(at) / n, float(weights.sum()) / n, math.log1p(len(best)), best[0] if best else 0.0, sum(best[:3]), near,
            len(you) / n, counts[1] / letters, len(SHOUTED.findall(text)) / n, counts[3] / size, counts[4] / size, len(disguised) / n,
            sum(self.of[w.lower().translate(PLAIN).replace("*", "")] > 0 for w in disguised) / n, len(STRETCHED.findall(text)) / n,
            sum(w in SEEDS for w in words) / n,
        ]


def _features(text, fold, lexicons: tuple[Lexicon, ...]):
    """Column of dense features; fold picks the lexicon."""

    @F.arrow_udf("array<double>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        with freed(*(x.of for x in lexicons)):
            for texts, folds in parts:
                yield pa.array([lexicons[f].features(t.as_py()) for t, f in zip(texts, folds.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return run(text, fold)


def _unit_counts(sample: DataFrame) -> list[tuple[str, list[int]]]:
    """For each unit, in how many texts of (fold, label) it occurs; four numbers. The sample is bounded, so is this."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [Counter() for _ in range(4)]
        with freed(*counts):
            for batch in slices(batches, limit=4 << 20):
                for text, fold, label in zip(*(batch.column(c).to_pylist() for c in ("text", "fold", "label")), strict=True):
                    counts[2 * fold + int(label)].update({u for w in set(WORD.findall((text or "").lower())) for u in units(w)})
            for k, found in enumerate(counts):
                yield pa.record_batch([pa.array(found.keys(), pa.string()), pa.array([k] * len(found), pa.int32()), pa.array(found.values(), pa.int64())], ["unit", "k", "n"])

    summed = sample.select("text", "fold", "label").mapInArrow(run, "unit string, k int, n long").groupBy("unit")
    found = summed.agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(4)])
    return [(r[0], list(r[1:])) for r in found.where("n1 + n3 >= 3 and n1 + n3 > 0.15 * (n0 + n2)").collect()]


def _lexicon(counts: list[tuple[str, list[int]]], totals: list[int], folds: tuple[int, ...]) -> Lexicon:
    """Units that occur in at least three toxic texts and far more often in toxic texts than in others."""
    other, toxic = (sum(totals[2 * f + k] for f in folds) + 1 for k in (0, 1))
    weights = {w: 2.0 for w in SEEDS}
    for unit, n in counts:
        a, b = (sum(n[2 * f + k] for f in folds) for k in (1, 0))
        weight = math.log((a + 0.5) / toxic) - math.log((b + 0.5) / other)
        if a >= 3 and weight > 2:
            weights[unit] = weight
    return Lexicon(weights)


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: GBTClassificationModel | None, calibration: IsotonicRegressionModel | None, base: float):
        self.lexicon, self.trees, self.calibration, self.base = lexicon, trees, calibration, base

    def score(self, docs: DataFrame) -> DataFrame:
        """docs (with text) plus toxicity, from 0 to 1; existing columns named toxicity, or starting with _toxicity_, are
        replaced. Whole texts count; null and empty ones score as texts without words; repeated rows each get a row; an
        empty table gives an empty one."""
        kept = [f"`{c}`" for c in docs.columns if c != "toxicity" and not c.startswith("_toxicity_")]
        if self.trees is None:
            return docs.select(*kept, F.lit(float(self.base)).alias("toxicity"))
        made = docs.select(*kept, array_to_vector(_features(F.col("text"), F.lit(0), (self.lexicon,))).alias("_toxicity_features"))
        scored = self.calibration.transform(self.trees.transform(made).withColumn("_toxicity_share", vector_to_array("_toxicity_probability")[1]))
        # calibrated scores come in steps; a hundredth of the trees' own orders texts within a step
        return scored.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.99 * F.col("_toxicity_calibrated") + 0.01 * F.col("_toxicity_share"))).alias("toxicity"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 25, depth: int = 4) -> ToxicityModel:
    """Fits lexicon, trees and calibration to docs (doc_id, text) that labels (doc_id, toxic 0 or 1) marks.

    At most `sample` labelled documents are used, the first in the order of a hash of their ids; null labels and ids
    are left out, and where a document has several labels the largest counts. The lexicon's weights are learned on
    one half for the features of the other, so that the trees see them as they are on new texts; the final lexicon
    is learned on all. Three quarters fit the trees, one the calibration. With labels of one kind only, or none, the
    model gives the overall rate to all.
    """
    ids = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # 24 bytes a row, so the broadcast is bounded
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(8))
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    chosen = stored(chosen.select("doc_id", "text", "label", (part % 2).cast("int").alias("fold"), part.alias("part")), "toxicity-sample")
    totals = [0] * 4
    for fold, label, n in chosen.groupBy("fold", "label").count().collect():
        totals[2 * fold + int(label)] += n
    base = (totals[1] + totals[3]) / max(sum(totals), 1)
    counts = _unit_counts(chosen)
    lexicon = _lexicon(counts, totals, (0, 1))
    if not min(totals):
        return ToxicityModel(lexicon, None, None, base)
    folds = (_lexicon(counts, totals, (1,)), _lexicon(counts, totals, (0,)))
    ready = chosen.select("label", "part", array_to_vector(_features(F.col("text"), F.col("fold"), folds)).alias("_toxicity_features")).coalesce(4).persist()
    fitted = GBTClassifier(featuresCol="_toxicity_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7).fit(ready.where("part < 6"))
    fitted.setProbabilityCol("_toxicity_probability").setRawPredictionCol("_toxicity_raw").setPredictionCol("_toxicity_class")
    rest = fitted.transform(ready.where("part >= 6")).withColumn("_toxicity_share", vector_to_array("_toxicity_probability")[1])
    calibration = IsotonicRegression(featuresCol="_toxicity_share", labelCol="label", predictionCol="_toxicity_calibrated").fit(rest)
    ready.unpersist()
    return ToxicityModel(lexicon, fitted, calibration, base)
