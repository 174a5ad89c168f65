"""Operator 4: toxicity.

Method: gradient-boosted trees over dense features, with isotonic calibration: densities of a lexicon (single hits, weights, the densest
stretch), second-person words near hits, and rates of capitals, punctuation and obfuscated words.

The lexicon is a short fixed list and terms mined from labelled rows: words and word beginnings that toxic rows hold much more
often than others. A bounded sample of labelled rows that are not held out serves for it all: folds 0-4 for the
lexicon, 5-7 for the trees, 8-9 for the calibration, so no part is fitted on what an earlier part has seen.

Counts of hits are features up to 20: trees need no finer scale there, and the rates beside them have no bound.

Cases: null and empty texts have all features zero and get the score the model gives those; a null doc_id is kept, is not held out and
never learnt from; repeated rows are scored alike, rows that repeat a doc_id each by its own text; texts of any length are read whole; an empty
table gives an empty result; other columns are ignored; labels,
lang, source and doc_id are no inputs of a score; without labelled rows of both kinds in each part the score is the share of
toxic labels (0.5 without any label).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, materialise, slices, texts_of, training_rows

#: Bound of the sample that everything is fitted on, and of the mined lexicon.
SAMPLE_ROWS, LEXICON_TERMS = 12_000, 1_500
LEXICON_FOLDS, TREE_FOLDS = 5, 8
#: A mined term is in so many toxic rows at least, and this much more often (log of the ratio of the shares).
LEAST_ROWS, LEAST_ODDS = 4, 2.0
BEGINNINGS = (4, 5, 6)
NEAR_WORDS = 5
THRESHOLD = 0.7
TREES = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.2, "maxBins": 32, "seed": 7}

#: Common insults, and second-person words of several languages.
INSULTS = ("idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "trash", "worthless", "pathetic", "disgusting", "clown", "dumb", "jerk", "fool")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "vous", "votre", "du", "dich", "dir", "dein", "deine", "euch", "ihr", "tú", "ti", "usted", "ustedes", "vosotros", "os")

FEATURES = ("hits", "hit_rate", "weight_rate", "most_in_50", "distinct_hits", "near_you_rate", "you_rate", "capital_rate", "mark_rate", "obfuscated_rate", "log_words")
_EDGE = " \t\n.,;:!?\"'()[]{}<>*_-%$#&|"
_OBFUSCATED = re.compile(r"[^\W\d_][0-9@$!*#+]+[^\W\d_]")


def words_of(text: str) -> list[str]:
    return [w for w in (x.strip(_EDGE) for x in text.lower().split()) if w]


def terms_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def mine_lexicon(rows: DataFrame, limit: int = LEXICON_TERMS) -> dict[str, float]:
    """Weights of the terms that tell toxic rows from others; each task sends a term's counts once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in slices(batches):
            for text, label in zip(texts_of(batch), batch.column("label").to_pylist()):
                found[label >= 0.5].update({t for w in set(words_of(text)) for t in terms_of(w)})
        terms = list(found[0].keys() | found[1].keys())
        for k in range(0, len(terms), 50_000):
            part = terms[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([found[y][t] for t in part], pa.int64()) for y in (1, 0))], names=["term", "toxic", "other"])

    n = dict(rows.groupBy("label").count().collect())
    toxic, other = n.get(1.0, 0), n.get(0.0, 0)
    counts = map_texts(rows.select("text", "label"), count, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("other") + 0.5) / (other + 1.0))
    top = counts.where(F.col("toxic") >= LEAST_ROWS).select("term", odds.alias("odds")).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "term").limit(limit)
    return {r.term: min(float(r.odds), 6.0) for r in top.collect()} | {w: 4.0 for w in INSULTS}


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.weights = lexicon, {}

    def weight(self, word: str) -> float:
        found = self.weights.get(word)
        if found is None:
            if len(self.weights) >= 300_000:
                self.weights.clear()
            found = self.weights[word] = max(self.lexicon.get(t, 0.0) for t in terms_of(word))
        return found

    def of(self, text: str) -> tuple[float, ...]:
        words = words_of(text)
        n = max(len(words), 1)
        hits = [(i, v) for i, v in enumerate(map(self.weight, words)) if v]
        you = [i for i, w in enumerate(words) if w in _YOU]
        near, k = 0, 0
        for i, _ in hits:
            while k < len(you) and you[k] < i - NEAR_WORDS:
                k += 1
            near += k < len(you) and you[k] <= i + NEAR_WORDS
        densest, low = 0, 0
        for high in range(len(hits)):
            while hits[high][0] - hits[low][0] >= 50:
                low += 1
            densest = max(densest, high - low + 1)
        letters = sum(map(len, words)) or 1
        capitals = len(_CAPITALS.findall(text)) if not text.islower() else 0
        marks = len(_MARKS.findall(text))
        odd = len(_OBFUSCATED.findall(text))
        return (
            float(min(len(hits), 20)), len(hits) / n, sum(v for _, v in hits) / n, float(min(densest, 20)), float(min(len({words[i] for i, _ in hits}), 20)),
            near / n, len(you) / n, capitals / letters, marks / max(len(text), 1), odd / n, math.log1p(len(words)),
        )


_YOU = frozenset(SECOND_PERSON)
_CAPITALS = re.compile("[A-ZÀ-ÖØ-Þ]")
_MARKS = re.compile(r"[^\w\s]")


def features(rows: DataFrame, lexicon: dict[str, float], *keep: str) -> DataFrame:
    """(*keep, *FEATURES) of every row."""
    held = rows.sparkSession.sparkContext.broadcast(lexicon)  # at most LEXICON_TERMS and the fixed words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Features(held.value)
        for batch in slices(batches):
            found = [own.of(t) for t in texts_of(batch)]
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=[*keep, *FEATURES])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_texts(rows.select(*keep, "text"), run, f"{kinds}, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: PipelineModel | None
    calibration: IsotonicRegressionModel | None
    share: float


def _raw(df: DataFrame, trees: PipelineModel) -> DataFrame:
    return trees.transform(df).withColumn("raw_score", vector_to_array("probability")[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = materialise(training_rows(docs, labels, "toxic", SAMPLE_ROWS), "toxicity-sample")
    part = F.when(F.col("fold") < LEXICON_FOLDS, 0).when(F.col("fold") < TREE_FOLDS, 1).otherwise(2)
    seen = {(r.part, r.label) for r in rows.groupBy(part.alias("part"), "label").count().collect()}
    share = rows.agg(F.avg("label")).first()[0]
    share = 0.5 if share is None else float(share)
    if seen != {(p, y) for p in range(3) for y in (0.0, 1.0)}:
        return Model({}, None, None, share)
    lexicon = mine_lexicon(rows.where(F.col("fold") < LEXICON_FOLDS))
    known = materialise(features(rows.where(F.col("fold") >= LEXICON_FOLDS), lexicon, "doc_id", "label", "fold").coalesce(4), "toxicity-features")
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="features"), GBTClassifier(labelCol="label", featuresCol="features", **TREES)]
    trees = Pipeline(stages=stages).fit(known.where(F.col("fold") < TREE_FOLDS).orderBy("doc_id").coalesce(2))
    rest = _raw(known.where(F.col("fold") >= TREE_FOLDS), trees).select("label", "raw_score")
    return Model(lexicon, trees, IsotonicRegression(labelCol="label", featuresCol="raw_score", predictionCol="score").fit(rest), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; no shuffle."""
    if model.trees is None or model.calibration is None:
        scored = docs.select("doc_id").withColumn("score", F.lit(model.share))
    else:
        scored = model.calibration.transform(_raw(features(docs, model.lexicon, "doc_id"), model.trees))
    score = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
