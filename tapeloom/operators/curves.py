"""Curves of classifiers with several classes: one against the rest, all decisions together (micro), and the mean of the classes (macro)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ratio
from .ranks import below, join_on


def curve_points(scores: DataFrame, by: list[str], y: str, probs: list[str]) -> DataFrame:
    """(by, curve, score, tp, fp, pos, neg, tpr, fpr, precision) at every distinct score of each curve: what is called positive has at least that score.

    Curves are named by class number (its probability is the column of that place in ``probs``), and ``micro``: all classes' decisions taken together. Rows without a class
    or a probability are left out. Equal scores are counted together, and what lies below one is summed by cells (``ranks``), so all curves
    of all groups take one pass and no window spans a curve.
    """
    known = scores.where(F.col(y).isNotNull())
    for p in probs:
        known = known.where(F.col(p).isNotNull() & ~F.isnan(p))
    each = [F.struct(F.lit(str(k)).alias("curve"), F.col(p).cast("double").alias("score"), (F.col(y) == k).cast("long").alias("hit")) for k, p in enumerate(probs)]
    both = F.flatten(F.transform(F.array(*each), lambda s: F.array(s, F.struct(F.lit("micro").alias("curve"), s["score"].alias("score"), s["hit"].alias("hit")))))
    rows = known.select(*by, F.explode(both).alias("one decision")).select(*by, F.col("`one decision`.curve"), F.col("`one decision`.score"), F.col("`one decision`.hit"))
    keys = [*by, "curve"]
    counts = rows.groupBy(*keys, "score").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"))
    ranked = below(counts, keys, "score", ["hits", "n"])
    totals = counts.groupBy(*keys).agg(F.sum("hits").alias("pos"), (F.sum("n") - F.sum("hits")).alias("neg"))
    found = join_on(ranked, totals, keys)
    tp = F.col("pos") - F.col("`below hits`")
    fp = F.col("neg") - (F.col("`below n`") - F.col("`below hits`"))
    found = found.select(*keys, "score", "hits", "n", tp.alias("tp"), fp.alias("fp"), "pos", "neg")
    return found.withColumns({"tpr": ratio(F.col("tp") * 1.0, F.col("pos")), "fpr": ratio(F.col("fp") * 1.0, F.col("neg")), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))})


def curve_areas(scores: DataFrame, by: list[str], y: str, probs: list[str]) -> DataFrame:
    """(by, curve, auc, ap): area under the ROC curve by trapezoids and average precision of each curve, and of ``macro``, the mean of the classes that have both
    kinds of rows. Null where a curve has none of one kind."""
    p = curve_points(scores, by, y, probs)
    # a step to the right by the misses of a score, at the mean height of its ends; nothing but the row itself is needed
    misses = F.col("n") - F.col("hits")
    area = F.sum(misses * (F.col("tp") - F.col("hits") / 2.0))
    found = p.groupBy(*by, "curve").agg(area.alias("area"), F.sum(F.col("hits") * F.col("precision")).alias("gain"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    found = found.select(*by, "curve", ratio(F.col("area"), F.col("pos") * F.col("neg")).alias("auc"), ratio(F.col("gain"), F.col("pos")).alias("ap"))
    macro = found.where("curve <> 'micro'").groupBy(*by).agg(F.avg("auc").alias("auc"), F.avg("ap").alias("ap"))
    return found.unionByName(macro.withColumn("curve", F.lit("macro")))
