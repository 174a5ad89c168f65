"""Order-book features: array functions on one snapshot (bids and asks as sorted arrays of price and qty)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .windows import carried

DEPTHS = (5, 10, 25, 50)
BINS = ((0, 5), (5, 10), (10, 25), (25, 50))


def _total(levels: Column, keep) -> Column:
    return F.aggregate(F.filter(levels, keep), F.lit(0.0), lambda a, x: a + x.qty)


def top_of_book() -> dict[str, Column]:
    bid, ask = F.col("bids")[0], F.col("asks")[0]
    size = bid.qty + ask.qty
    return {
        "best_bid": bid.price, "best_bid_qty": bid.qty, "best_ask": ask.price, "best_ask_qty": ask.qty, "spread": ask.price - bid.price,
        "mid": (bid.price + ask.price) / 2, "imbalance_l1": F.when(size == 0, 0.0).otherwise((bid.qty - ask.qty) / F.when(size != 0, size)),
        "microprice": F.when(size > 0, (ask.price * bid.qty + bid.price * ask.qty) / F.when(size > 0, size)),
    }


def _mid() -> Column:
    return (F.col("bids")[0].price + F.col("asks")[0].price) / 2


def depth_within(bps: tuple[int, ...] = DEPTHS) -> dict[str, Column]:
    mid, out = _mid(), {}
    for b in bps:
        low, high = mid * (1 - b / 1e4), mid * (1 + b / 1e4)
        out[f"depth_bid_{b}"] = F.when(mid > 0, _between(F.col("bids"), lambda x: x.price, low, None)).otherwise(0.0)
        out[f"depth_ask_{b}"] = F.when(mid > 0, _between(F.col("asks"), lambda x: x.price, None, high)).otherwise(0.0)
    return out


def _between(levels: Column, value, low, high, closed: bool = True) -> Column:
    """Quantity of the levels whose value lies from low to high (None: no bound); ``closed`` tells whether high itself counts."""

    def keep(x: Column) -> Column:
        v = value(x)
        up = F.lit(True) if high is None else v <= high if closed else v < high
        return up if low is None else up & (v >= low)

    return _total(levels, keep)


def distance_bins(bins=BINS) -> dict[str, Column]:
    """Quantity by distance from the middle in basis points; the last bin holds its upper end too."""
    mid, out = _mid(), {}
    for k, (low, high) in enumerate(bins):
        last = k == len(bins) - 1
        out[f"bin_bid_{low}_{high}"] = F.when(mid > 0, _between(F.col("bids"), lambda x: (mid - x.price) / mid * 1e4, low, high, last)).otherwise(0.0)
        out[f"bin_ask_{low}_{high}"] = F.when(mid > 0, _between(F.col("asks"), lambda x: (x.price - mid) / mid * 1e4, low, high, last)).otherwise(0.0)
    return out


def book_quality(full_depth: int = 1000) -> dict[str, Column]:
    bids, asks = F.col("bids"), F.col("asks")
    steps = lambda s, bad: F.exists(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s)), lambda a, b: bad(a.price, b.price)), lambda x: F.coalesce(x, F.lit(False)))
    return {
        "flag_crossed": bids[0].price >= asks[0].price, "flag_bad_sorting": steps(bids, lambda a, b: a < b) | steps(asks, lambda a, b: a > b),
        "flag_low_depth": F.col("depth") < full_depth, "flag_nonpositive_qty": F.exists(bids, lambda x: x.qty <= 0) | F.exists(asks, lambda x: x.qty <= 0),
    }


CALCULATORS = (top_of_book, depth_within, distance_bins, book_quality)


def book_features(snapshots: DataFrame, *keep: str, calculators=CALCULATORS) -> DataFrame:
    """Features of every snapshot with both sides present; the others are rejected (see ``rejected``)."""
    columns = {k: v for c in calculators for k, v in c().items()}
    good = snapshots.where("size(bids) > 0 and size(asks) > 0")
    return good.select(*keep, *[v.alias(k) for k, v in columns.items()])


def rejected(snapshots: DataFrame) -> DataFrame:
    """Snapshots that lack a side."""
    return snapshots.where("bids is null or asks is null or size(bids) = 0 or size(asks) = 0")


def last_write_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row by ``seq`` of each key, by an aggregate that combines before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), seq).alias("row")).select(*keys, "row.*")


def replay_book(diffs: DataFrame, until: Column | None = None) -> DataFrame:
    """The local book from diffs (symbol, side, price, qty, seq): the last quantity of each price, zero quantities gone."""
    rows = diffs if until is None else diffs.where(F.col("seq") <= until)
    return last_write_wins(rows.select("symbol", "side", "price", "qty", "seq"), ["symbol", "side", "price"], "seq").where("qty <> 0").drop("seq")


def top_levels(book: DataFrame, k: int) -> DataFrame:
    """The best k levels of each side as sorted arrays (bids descending, asks ascending)."""
    order = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    ranked = book.withColumn("level", F.row_number().over(W.partitionBy("symbol", "side").orderBy(order))).where(F.col("level") <= k)
    return ranked.groupBy("symbol", "side").agg(F.array_sort(F.collect_list(F.struct("level", "price", "qty"))).alias("levels"))


def sequence_gaps(diffs: DataFrame, cell: int = 1 << 18) -> DataFrame:
    """Add gap (the previous final id is not this one's predecessor) and epoch (count of gaps so far) to diffs
    (symbol, seq, first_id, final_id, prev_id); a missing prev_id means first_id - 1. Worked on by cells of ``cell`` arrivals."""
    rows = carried(diffs, ["symbol"], "seq", cell, {"before": ("last", F.col("final_id"))})
    rows = rows.withColumn("gap", F.coalesce(F.coalesce("prev_id", F.col("first_id") - 1) != F.col("before"), F.lit(False))).drop("before")
    return carried(rows, ["symbol"], "seq", cell, {"epoch": ("sum", F.col("gap").cast("int"))}, own=True)


def align_to_snapshot(diffs: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Diffs that continue a snapshot (symbol, last_id): those up to it go; the first kept one must hold last_id + 1."""
    rows = diffs.join(snapshots, "symbol").where("final_id > last_id")
    start = rows.where("first_id <= last_id + 1 and final_id >= last_id + 1").groupBy("symbol").agg(F.min("seq").alias("start"))
    return rows.join(start, "symbol").where("seq >= start").drop("start")
