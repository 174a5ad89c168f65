"""Alpha expressions: trees of operators over columns, compiled to Spark columns.

A tree is a column name, a number, or a tuple (operator, left[, right[, width]]). Windows do not nest in Spark, so
``evaluate`` materialises each inner window as a column of its own; equal subtrees are computed once, whole generations
of trees in one job.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import EPS, correlation, gated, ratio
from .windows import decay_linear, last_n, pct_rank_all

COMMUTATIVE = {"+", "*"}
WINDOWED = {"rank", "scale", "delay", "delta", "rolling_mean", "rolling_std", "covariance", "correlation", "decay_linear"}


def canonical(tree) -> tuple | str | float:
    """The tree with commutative arguments in order and constants rounded to 8 digits: equal trees compare equal."""
    if isinstance(tree, (int, float)):
        return round(float(tree), 8)
    if isinstance(tree, str):
        return tree
    op, *args = tree
    done = [canonical(a) for a in args]
    return (op, *(sorted(done, key=repr) if op in COMMUTATIVE else done))


def digest(tree) -> str:
    """A short name of a tree: the digest of its canonical form as JSON. Equal trees have equal names in any process."""
    return hashlib.blake2b(json.dumps(canonical(tree), ensure_ascii=False, separators=(",", ":")).encode(), digest_size=16).hexdigest()


def _number(x) -> int:
    return int(max(1, min(252, round(float(x)))))


def _split(args: tuple) -> tuple[object, int]:
    """(series, width) in either order."""
    a, b = args
    return (b, _number(a)) if isinstance(a, (int, float)) else (a, _number(b))


class Compiler:
    def __init__(self, df: DataFrame, by: list[str], on: str):
        self.df, self.by, self.w, self.names = df, by, W.partitionBy(*by).orderBy(on), {}

    def column(self, tree) -> Column:
        if isinstance(tree, (int, float)):
            return F.lit(float(tree))
        if isinstance(tree, str):
            return F.col(tree)
        if tree[0] in WINDOWED:
            return F.col(self.stored(tree))
        op, *args = tree
        a = self.column(args[0])
        if op in "+-*/":
            b = self.column(args[1])
            if op == "/":
                return F.when(F.abs(b) > EPS, a / F.when(F.abs(b) > EPS, b))
            return {"+": a + b, "-": a - b, "*": a * b}[op]
        if op == "sqrt":
            return F.sqrt(F.greatest(a, F.lit(0.0)))
        if op == "log":
            return F.log(F.abs(a) + 1)
        if op == "inverse":
            return F.when(F.abs(a) > EPS, 1 / F.when(F.abs(a) > EPS, a))
        if op == "sigmoid":
            return 0.5 * (1 + F.tanh(a / 2))
        if op == "signedpower":
            return F.signum(a) * F.pow(F.abs(a), F.lit(float(max(1, min(16, round(float(args[1])))))))
        raise ValueError(f"unknown operator {op!r}")

    def stored(self, tree) -> str:
        """The name of the column that holds a windowed tree, computed on first use."""
        if tree in self.names:
            return self.names[tree]
        op, *args = tree
        inner = [a if isinstance(a, (int, float)) else self.plain(a) for a in args]
        if op == "rank":
            value = pct_rank_all(F.col(inner[0]), *self.by)
        elif op == "scale":
            total = F.sum(F.abs(F.col(inner[0]))).over(W.partitionBy(*self.by))
            value = F.when(total >= EPS, F.col(inner[0]) / F.when(total >= EPS, total))
        elif op in ("covariance", "correlation"):
            a, b, width = F.col(inner[0]), F.col(inner[1]), _number(inner[2])
            frame = last_n(self.w, width)
            value = gated(F.covar_samp(a, b).over(frame) if op == "covariance" else correlation(a, b, frame), a + b, frame, width)
        else:
            name, width = _split(tuple(inner))
            x, frame = F.col(name), last_n(self.w, width)
            value = {
                "delay": lambda: F.lag(x, width).over(self.w), "delta": lambda: x - F.lag(x, width).over(self.w),
                "rolling_mean": lambda: gated(F.avg(x).over(frame), x, frame, width), "rolling_std": lambda: gated(F.stddev_samp(x).over(frame), x, frame, width),
                "decay_linear": lambda: decay_linear(x, self.w, width),
            }[op]()
        self.names[tree] = f"alpha_{len(self.names)}"
        self.df = self.df.withColumn(self.names[tree], value)
        return self.names[tree]

    def plain(self, tree) -> str:
        """A column name for any tree."""
        if isinstance(tree, str):
            return tree
        if tree in self.names:
            return self.names[tree]
        if tree[0] in WINDOWED:
            return self.stored(tree)
        value = self.column(tree)
        self.names[tree] = f"alpha_{len(self.names)}"
        self.df = self.df.withColumn(self.names[tree], value)
        return self.names[tree]


def evaluate(df: DataFrame, trees: dict[str, object], by: list[str], on: str) -> DataFrame:
    """``df`` with a column for each named tree."""
    compiler = Compiler(df, by, on)
    found = {name: compiler.plain(canonical(tree)) for name, tree in trees.items()}
    return compiler.df.select(*df.columns, *[F.col(c).alias(name) for name, c in found.items()])


def sign_sharpe(alpha: str, target: str) -> Column:
    """Mean over deviation of the target held by the sign of the alpha."""
    gain = F.signum(F.col(f"`{alpha}`")) * F.col(f"`{target}`")
    return ratio(F.avg(gain), F.stddev_pop(gain), EPS)


def fitness(df: DataFrame, names: list[str], target: str, by: list[str], measure=correlation) -> DataFrame:
    """(by, alpha, ic): a measure of every alpha against the target, all in one aggregate. ``measure`` turns two column names into an aggregate column."""
    row = df.groupBy(*by).agg(F.array(*[F.struct(F.lit(n).alias("alpha"), measure(n, target).alias("ic")) for n in names]).alias("p"))
    return row.select(*by, F.explode("p").alias("p")).select(*by, "p.*")
