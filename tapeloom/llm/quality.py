"""Operator 6: quality by compression.

Method: zstandard dictionaries are trained on text labelled good and on text labelled bad; each text is compressed with
both, and the difference of the sizes, normalised by the text's length, (bad - good) / bytes, becomes a score by
logistic calibration. (Normalised by the sum of the sizes instead, endless repetitions of a word, which both
dictionaries shrink to nothing, would look as good as bad; the length keeps them near zero, where good texts are not.)

Texts are compressed in pieces of ``PIECE`` bytes, all of them, so that a long text does not outgrow the dictionary's
influence; sizes are summed. Dictionaries come from folds 0-5 of a bounded sample of the labelled rows that are not held
out, the calibration from the other folds. The sample is written out once, so the documents are read twice: for it and for the scores.

Cases: null and empty texts get the calibrated score of a difference of zero; a null doc_id is kept, is not held out and never
learnt from; rows that repeat are scored alike, each by its own text; an empty table gives an empty result; other columns are ignored;
labels, lang, source and doc_id are no inputs of a score; without labelled rows of both kinds the score is the share of good
labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, held_out, map_texts, materialise, positional, slices, training_rows

#: Bounds of the sample that the classifier is fitted on: rows, and bytes for each dictionary (a longer text is cut there).
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 6_000_000
DICTIONARY_BYTES, PIECE, LEVEL = 65_536, 1024, 3
DICTIONARY_FOLDS = 6
THRESHOLD = 0.5


@dataclass
class Model:
    good: bytes
    bad: bytes
    #: score = 1 / (1 + exp(-(a + b * difference)))
    a: float
    b: float


class Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.presses = []
        for data in (good, bad):
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(level=LEVEL)
            self.presses.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False))

    def difference(self, data: bytes) -> float:
        """(bad - good) / bytes: the higher, the better the good dictionary suits the text; 0 for no text."""
        good, bad = (sum([len(p.compress(data[k : k + PIECE])) for k in range(0, len(data), PIECE)]) for p in self.presses)
        return (bad - good) / len(data) if data else 0.0


def dictionary(texts: list[bytes]) -> bytes:
    pieces = [t[k : k + PIECE] for t in texts for k in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:  # too little text: the text itself serves as dictionary
        return (b" ".join(texts) or b" " * 8)[:DICTIONARY_BYTES].ljust(8)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, both classes with equal weight, with a slight pull to zero."""
    scale = float(x.std()) or 1.0
    design = np.stack([np.ones_like(x), x / scale], axis=1)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    beta = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-2 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1] / scale)


def _collect_texts(rows: DataFrame, label: float) -> list[bytes]:
    """Texts of a label, in hash order, as many as SAMPLE_BYTES hold."""
    rows = rows.where((F.col("label") == label) & (F.col("fold") < DICTIONARY_FOLDS))
    rows = rows.select(F.xxhash64("doc_id").alias("h"), F.substring(F.col("text").cast("binary"), 1, SAMPLE_BYTES).alias("data"))
    total, last = 0, None
    for h, n in sorted(map(tuple, rows.select("h", F.octet_length("data")).collect())):  # two numbers for each of at most SAMPLE_ROWS
        total += n
        if total > SAMPLE_BYTES:
            break
        last = h
    if last is None:
        return []
    return sorted(bytes(r.data) for r in rows.where(F.col("h") <= last).select("data").collect())  # at most SAMPLE_BYTES


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = materialise(training_rows(docs, labels, "quality", SAMPLE_ROWS), "quality-sample")
    good, bad = _collect_texts(rows, 1.0), _collect_texts(rows, 0.0)
    if not good or not bad:
        share = rows.agg(F.avg("label")).first()[0]
        share = 0.5 if share is None else min(max(share, 0.01), 0.99)
        return Model(b" " * 8, b" " * 8, float(np.log(share / (1 - share))), 0.0)
    model = Model(dictionary(good), dictionary(bad), 0.0, 1.0)
    rest = differences(rows.where(F.col("fold") >= DICTIONARY_FOLDS), model, "label").select("label", "difference").collect()  # two numbers a row
    y, x = (np.array([r[k] for r in rest], float) for k in (0, 1))
    if len(set(y.tolist())) == 2:
        model.a, model.b = logistic(x, y)
    return model


def differences(rows: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, difference) of every row."""
    held = rows.sparkSession.sparkContext.broadcast((model.good, model.bad))  # two dictionaries of at most DICTIONARY_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(*held.value)
        for batch in slices(batches):
            found = [sizes.difference(x) for x in bytes_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.float64())], names=[key, "difference"])

    return map_texts(rows.select(key, "text"), run, f"{key} {rows.schema[key].dataType.simpleString()}, difference double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    score = 1 / (1 + F.exp(-(F.lit(model.a) + F.lit(model.b) * F.col("difference"))))
    return differences(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least the threshold; no join, no shuffle. Columns may have any names."""
    names, docs = docs.columns, positional(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        sizes = Sizes(m.good, m.bad)
        for batch in slices(batches):
            x = np.array([sizes.difference(t) for t in bytes_of(batch)])
            yield batch.filter(pa.array(1 / (1 + np.exp(-(m.a + m.b * x))) >= threshold, pa.bool_()))

    return map_texts(docs, run, docs.schema).toDF(*names)
