"""A genetic search over alpha expressions. A generation is one Spark job; only its scores come to the driver."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alpha import canonical, evaluate, fitness

UNARY = ("sqrt", "log", "inverse", "sigmoid", "rank", "scale")
BINARY = ("+", "-", "*", "/")
LAGGED = ("delay", "delta", "rolling_mean", "rolling_std", "decay_linear")
PAIRED = ("covariance", "correlation")


def grow(rng: random.Random, columns: list[str], depth: int) -> tuple | str:
    """A random tree of at most ``depth`` operators from root to leaf; windows are explicit numbers from 2 to 20."""
    if depth < 1 or rng.random() < 0.2:
        return rng.choice(columns)
    op = rng.choice(UNARY + BINARY + LAGGED + PAIRED)
    a = grow(rng, columns, depth - 1)
    if op in UNARY:
        return (op, a)
    if op in LAGGED:
        return (op, a, rng.randint(2, 20))
    b = grow(rng, columns, depth - 1)
    return (op, a, b) if op in BINARY else (op, a, b, rng.randint(2, 20))


def spots(tree, at: tuple = ()) -> list[tuple]:
    """Paths of all subtrees that are series; numbers are parameters and stay where they are."""
    found = [at]
    if isinstance(tree, tuple):
        for k, part in enumerate(tree[1:], 1):
            if not isinstance(part, (int, float)):
                found += spots(part, (*at, k))
    return found


def part(tree, at: tuple):
    return part(tree[at[0]], at[1:]) if at else tree


def graft(tree, at: tuple, new):
    """The tree with the subtree at a path replaced; every operator keeps its number of arguments."""
    return (*tree[: at[0]], graft(tree[at[0]], at[1:], new), *tree[at[0] + 1 :]) if at else new


def depth_of(tree) -> int:
    return 1 + max(map(depth_of, tree[1:])) if isinstance(tree, tuple) else 0


def score(df: DataFrame, trees: list, target: str, by: list[str], on: str) -> dict:
    """The mean over keys of each tree's correlation with the target, as a magnitude; 0 where it is nowhere defined."""
    names = {f"tree_{k}": t for k, t in enumerate(trees)}
    ics = fitness(evaluate(df, names, by, on), list(names), target, by)
    rows = ics.groupBy("alpha").agg(F.abs(F.avg("ic")).alias("score")).collect()  # a row for each tree
    return {names[r.alpha]: r.score if r.score is not None and r.score == r.score else 0.0 for r in rows}


def evolve(df: DataFrame, columns: list[str], target: str, by: list[str], on: str, size: int = 40, generations: int = 10, depth: int = 4, elite: int = 4, tournament: int = 3, mutation: float = 0.2, seed: int = 0) -> list[tuple[object, float]]:
    """(tree, score) of the last generation, best first. Equal trees are scored once in the whole search; ties are in order of the trees' text."""
    rng, known = random.Random(seed), {}
    people = [canonical(grow(rng, columns, depth)) for _ in range(size)]
    for generation in range(generations + 1):
        new = sorted({t for t in people if t not in known}, key=repr)
        if new:
            known |= score(df, new, target, by, on)
        order = sorted(set(people), key=lambda t: (-known[t], repr(t)))
        if generation == generations:
            break
        pick = lambda: min((rng.choice(people) for _ in range(tournament)), key=lambda t: (-known[t], repr(t)))
        children = list(order[:elite])
        while len(children) < size:
            child, other = pick(), pick()
            child = graft(child, rng.choice(spots(child)), part(other, rng.choice(spots(other))))
            if rng.random() < mutation:
                child = graft(child, rng.choice(spots(child)), grow(rng, columns, 2))
            children.append(canonical(child if depth_of(child) <= depth + 2 else grow(rng, columns, depth)))
        people = children
    return [(t, known[t]) for t in order]
