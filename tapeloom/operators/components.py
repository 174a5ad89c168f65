"""Principal components for each fold of a cross-validation, all folds from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FoldComponents(NamedTuple):
    """Of one fold: mean and scale of each column, loadings (component by column), share of the variance of each component, rows trained on."""

    fold: int
    mean: np.ndarray
    scale: np.ndarray
    loadings: np.ndarray
    shares: np.ndarray
    n: int


def _sums(rows: DataFrame, columns: list[str], shift: list[float], folds: list[tuple[int, int, int]], on: str, embargo: int) -> dict[int, np.ndarray]:
    """By fold, and -1 for all rows: the sums that means and products need, over the rows that the fold does not train on. Each task adds up matrices
    and sends one for each fold that it has rows of."""
    d = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}

        def add(key: int, x: np.ndarray, seen: np.ndarray) -> None:
            held = total.setdefault(key, np.zeros((3 * d + 1, d)))
            held[:d] += x.T @ x  # products where both are known
            held[d : 2 * d] += x.T @ seen  # sums of the one where both are known
            held[2 * d : 3 * d] += seen.T @ seen
            held[3 * d, 0] += len(x)

        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1) - shift
            seen = np.isfinite(x)
            x = np.where(seen, x, 0.0)
            seen = seen.astype(float)
            time = batch.column(on).to_numpy(zero_copy_only=False)
            add(-1, x, seen)
            for fold, low, high in folds:
                inside = (time >= low - embargo) & (time <= high + embargo)
                if inside.any():
                    add(fold, x[inside], seen[inside])
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.ravel().tolist() for m in total.values()], pa.list_(pa.float64()))], names=["fold", "m"])

    parts = rows.select(on, *columns).mapInArrow(run, "fold int, m array<double>")
    # element by element, so that the driver gets one matrix for each fold
    cells = parts.select("fold", F.posexplode("m").alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in cells.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("m")).collect():
        out[r["fold"]] = np.array(r["m"]).reshape(3 * d + 1, d)
    return out


def fit_folds(rows: DataFrame, columns: list[str], folds: DataFrame, on: str, k: int, embargo: int = 0) -> list[FoldComponents]:
    """The components of every fold (fold, lo, hi), fitted on the rows outside of its block and of the embargo around it: what a fold trains on is the total less its block, so
    one pass gives all folds. A missing value counts as the mean of its column, columns are scaled to a deviation of one (of the population; constant ones are left), and
    of each component the loading of the greatest size is positive. ``columns`` are some hundred at most, as their products come to the driver."""
    blocks = [(int(r["fold"]), int(r["lo"]), int(r["hi"])) for r in folds.select("fold", "lo", "hi").collect()]  # a row for each fold
    first = rows.agg(*[F.avg(F.when(~F.isnan(c), F.col(c))).alias(c) for c in columns]).first()
    shift = [0.0 if first[c] is None else float(first[c]) for c in columns]  # products about the mean lose fewer digits
    sums, d, out = _sums(rows, columns, shift, blocks, on, embargo), len(columns), []
    for fold, _, _ in sorted(blocks):
        m = sums.get(-1, np.zeros((3 * d + 1, d))) - sums.get(fold, np.zeros((3 * d + 1, d)))
        xx, xs, ss, n = m[:d], m[d : 2 * d], m[2 * d : 3 * d], int(round(m[3 * d, 0]))
        if n < 2:
            continue
        seen = np.maximum(np.diag(ss), 1)
        mean = np.diag(xs) / seen
        cov = (xx - xs * mean[None, :] - xs.T * mean[:, None] + ss * np.outer(mean, mean)) / n
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale = np.where(scale > 1e-12 * np.maximum(np.abs(mean + shift), 1e-300), scale, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
        order = np.argsort(values)[::-1][:k]
        loadings = vectors[:, order].T
        signs = np.sign(loadings[np.arange(len(order)), np.abs(loadings).argmax(axis=1)])
        total = values.sum()
        out.append(FoldComponents(fold, mean + shift, scale, loadings * np.where(signs == 0, 1, signs)[:, None], np.maximum(values[order], 0) / (total if total > 0 else 1.0), n))
    return out


def fold_scores(rows: DataFrame, columns: list[str], folds: DataFrame, on: str, models: list[FoldComponents], keep: list[str], embargo: int = 0) -> DataFrame:
    """(keep, fold, pc): each row's components by the last fold that it is tested or trained in, that is in whose embargo it does not lie; null if there is none."""
    blocks = {int(r["fold"]): (int(r["lo"]), int(r["hi"])) for r in folds.select("fold", "lo", "hi").collect()}  # a row for each fold
    held = rows.sparkSession.sparkContext.broadcast([(m, *blocks[m.fold]) for m in sorted(models, key=lambda m: m.fold)])  # k times the columns, for each fold
    kept = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
            time = batch.column(on).to_numpy(zero_copy_only=False)
            fold, scores = np.full(len(x), -1), [None] * len(x)
            for m, low, high in held.value:
                reach = (time >= low - embargo) & (time <= high + embargo)
                fold[~reach | ((time >= low) & (time <= high))] = m.fold
            for m, _, _ in held.value:
                own = np.flatnonzero(fold == m.fold)
                z = np.where(np.isfinite(x[own]), (x[own] - m.mean) / m.scale, 0.0) @ m.loadings.T
                for i, row in zip(own.tolist(), z.tolist()):
                    scores[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([None if f < 0 else f for f in fold.tolist()], pa.int32()), pa.array(scores, pa.list_(pa.float64()))], names=[*keep, "fold", "pc"])

    return rows.select(*dict.fromkeys([*keep, on, *columns])).mapInArrow(run, kept + ", fold int, pc array<double>")


def component_tables(spark, models: list[FoldComponents], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fold, component, share, rows) and (fold, component, feature, loading)."""
    shares = [(m.fold, c, float(s), m.n) for m in models for c, s in enumerate(m.shares)]
    loads = [(m.fold, c, name, float(v)) for m in models for c, row in enumerate(m.loadings) for name, v in zip(columns, row)]
    return spark.createDataFrame(shares, "fold int, component int, share double, rows long"), spark.createDataFrame(loads, "fold int, component int, feature string, loading double")
