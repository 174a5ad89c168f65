"""Books on arrival, the feature table, zipped archives and small operators against plain forms."""

import gzip
import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import bartime
from tapeloom.operators import alpha, book, indicators, tables
from tapeloom.sources import archives
from tapeloom.sources.store import FeatureTable
from tapeloom.streaming.localbook import books_on_arrival

EVENT = "symbol string, seq long, kind string, first_id long, final_id long, prev_id long, last_id long, bids array<struct<price:string,qty:string>>, asks array<struct<price:string,qty:string>>"


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, old) if old else spark.conf.unset(name)


def levels(rng, n):
    return [{"price": f"{rng.randrange(90, 110)}.{rng.randrange(2)}0", "qty": rng.choice(["0", "0.00000000", "1.5", "2", "7.25"])} for _ in range(n)]


def feed(symbol, rng, batches, per):
    """Batches of events with gaps, snapshots that come late, old differences and snapshots in the midst of a sequence."""
    seq, ids, out = 0, 100, []
    for b in range(batches):
        own = []
        for _ in range(per):
            seq += 1
            if rng.random() < 0.12:
                own.append((symbol, seq, "snapshot", None, None, None, ids - rng.randrange(3), levels(rng, 6), levels(rng, 6)))
                continue
            skip = rng.choice([0] * 12 + [3])
            first = ids + 1 + skip
            final = first + rng.randrange(3)
            prev = rng.choice([None, first - 1]) if skip == 0 else first - 1
            own.append((symbol, seq, "diff", first, final, prev, None, levels(rng, 3), levels(rng, 3)))
            ids = final
        out.append(own)
    return out


def plain_books(events):
    """After each event: (epoch, last id, in sequence, book)."""
    last, running, epoch, sides, held, out = None, False, 0, {}, [], []

    def change(e):
        for side, rows in (("bid", e[7]), ("ask", e[8])):
            for r in rows:
                if float(r["qty"]):
                    sides[side, r["price"]] = float(r["qty"])
                else:
                    sides.pop((side, r["price"]), None)

    def take(e):
        nonlocal last, running
        if last is None:
            held.append(e)
        elif not running:
            if e[4] > last and e[3] <= last + 1 <= e[4]:
                running = True
                change(e)
                last = e[4]
        elif (e[3] - 1 if e[5] is None else e[5]) != last:
            sides.clear()
            last, running = None, False
            held.append(e)
        else:
            change(e)
            last = e[4]

    for e in events:
        if e[2] == "diff":
            take(e)
        elif not running:
            sides.clear()
            last, epoch = e[6], epoch + 1
            change(e)
            waiting, held = held, []
            for w in waiting:
                take(w)
        out.append((epoch, last, running, dict(sides)))
    return out


def test_books_on_arrival_equal_plain_replay(spark, rocksdb, tmp_path):
    rng = random.Random(11)
    feeds = {s: feed(s, rng, 8, 12) for s in ("a", "b")}
    for k in range(8):
        rows = [e for s in feeds for e in feeds[s][k]]
        rng.shuffle(rows)
        lines = "\n".join(json.dumps(dict(zip(("symbol", "seq", "kind", "first_id", "final_id", "prev_id", "last_id", "bids", "asks"), e))) for e in rows)
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{k:03d}.json").write_text(lines)
    got = {}
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def keep(batch, k):
        got.update({(r.symbol, k): r for r in batch.collect()})

    books_on_arrival(stream, depth=5).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(got) == 16
    seen = set()
    for s, batches in feeds.items():
        after = plain_books([e for b in batches for e in b])
        for k in range(8):
            epoch, last, running, sides = after[12 * (k + 1) - 1]
            r = got[s, k]
            assert (r.epoch, r.last_id, r.in_sequence) == (epoch, last, running), (s, k)
            for side, shown in (("bid", r.bids), ("ask", r.asks)):
                want = sorted(((float(p), q) for (x, p), q in sides.items() if x == side), reverse=side == "bid")[:5]
                assert [tuple(x) for x in shown] == want
            seen.add((running, epoch > 1, bool(r.gaps), bool(r.waiting)))
    assert len({x[0] for x in seen}) == 2 and any(x[1] for x in seen) and any(x[2] for x in seen)


def test_book_in_sequence_equals_batch_replay(spark, rocksdb, tmp_path):
    rng = random.Random(2)
    diffs = [("a", k, "diff", 10 + k, 10 + k, None, None, levels(rng, 3), levels(rng, 3)) for k in range(40)]
    (tmp_path / "in").mkdir()
    names = ("symbol", "seq", "kind", "first_id", "final_id", "prev_id", "last_id", "bids", "asks")
    # the snapshot comes after fifteen differences, of which it holds nine
    order = [*diffs[:15], ("a", 15, "snapshot", None, None, None, 18, [], []), *[(d[0], d[1] + 1, *d[2:]) for d in diffs[15:]]]
    (tmp_path / "in" / "all.json").write_text("\n".join(json.dumps(dict(zip(names, e))) for e in order))
    got = []
    stream = spark.readStream.schema(EVENT).json(str(tmp_path / "in"))
    books_on_arrival(stream, depth=1000).writeStream.foreachBatch(lambda b, k: got.extend(b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start().awaitTermination()
    rows = [("a", side, float(x["price"]), float(x["qty"]), k * 100 + j) for k, d in enumerate(diffs) if d[4] > 18 for side, own in (("bid", d[7]), ("ask", d[8])) for j, x in enumerate(own)]
    batch = {(r.side, r.price): r.qty for r in book.replay_book(spark.createDataFrame(rows, "symbol string, side string, price double, qty double, seq long")).collect()}
    assert got[-1].applied == 31 and got[-1].dropped == 9
    assert {("bid", x.price): x.qty for x in got[-1].bids} | {("ask", x.price): x.qty for x in got[-1].asks} == batch


def test_feature_table(spark, tmp_path):
    t = FeatureTable(spark, str(tmp_path / "t"), most=5)
    frame = lambda rows: spark.createDataFrame(rows, "symbol string, bar_open_ms long, x double")
    assert t.version() == -1
    t.append(frame([("001", k, float(k)) for k in range(8)] + [("b", 1, 1.0)]))
    t.append(frame([("001", 7, 70.0), ("001", 8, 80.0), ("001", 8, 81.0)]).coalesce(1))
    t.append(frame([("c", 3, 3.0)]).withColumn("y", F.lit("new")))
    rows = lambda df: sorted((r.symbol, r.bar_open_ms, r.x) for r in df.collect())
    whole = [("001", 4, 4.0), ("001", 5, 5.0), ("001", 6, 6.0), ("001", 7, 70.0), ("001", 8, 81.0), ("b", 1, 1.0), ("c", 3, 3.0)]
    assert rows(t.rows()) == whole and rows(t.rows("b")) == [("b", 1, 1.0)]
    assert [(r.bar_open_ms, r.x) for r in t.window("001", 3).collect()] == [(6, 6.0), (7, 70.0), (8, 81.0)]
    assert t.window("001", 100).count() == 5 and t.window("001", 0).count() == 0 and t.window("none", 3).count() == 0
    assert rows(t.latest()) == [("001", 8, 81.0), ("b", 1, 1.0), ("c", 3, 3.0)] and rows(t.latest("b")) == [("b", 1, 1.0)]
    assert rows(t.rows("001", version=0)) == [("001", k, float(k)) for k in range(3, 8)]  # as it was
    assert t.compact() == 2 and rows(t.rows()) == whole
    t.append(frame([("001", 9, 9.0)]))
    assert t.version() == 3 and [(r.bar_open_ms, r.x) for r in t.window("001", 2).collect()] == [(8, 81.0), (9, 9.0)]
    t.append(frame([("001", 9, 9.0)]), version=3)  # a repeated batch changes nothing
    assert t.version() == 3 and t.window("001", 100).count() == 5
    spark.createDataFrame([("001", 10, 1.0)], "symbol string, bar_open_ms long, x double").write.parquet(str(tmp_path / "t/part/9"))
    (tmp_path / "t/part/9/_SUCCESS").unlink()
    assert t.version() == 3  # half a version is none
    plan = t.latest("b")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key_folder" in plan


def archive(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def test_zipped_members_and_dates(spark, tmp_path, monkeypatch):
    head = "id,price,flag\n"
    archive(tmp_path / "x-2024-01-01.zip", {"a.csv": head + "1,1.5,true\n2,,false\n", "notes.txt": "no rows", "b.csv.gz": gzip.compress((head + "3,3.5,true\n").encode())})
    archive(tmp_path / "x-2024-01-02.zip", {"a.csv": head, "c.csv": ""})
    (tmp_path / "sub").mkdir()
    archive(tmp_path / "sub" / "x-2024-02-01.zip", {"a.csv": head + "".join(f"{k},0.5,false\n" for k in range(100, 30_100))})
    (tmp_path / "y-2024-01-03.zip").write_bytes(b"this is no archive")
    schema = "price double, id long, flag boolean, file_date string, member string"
    df = archives.read_zipped(spark, f"{tmp_path}/x-*.zip", schema)
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [(1.5, 1, True, "2024-01-01", "a.csv"), (None, 2, False, "2024-01-01", "a.csv"), (3.5, 3, True, "2024-01-01", "b.csv.gz")]
    every = archives.read_zipped(spark, str(tmp_path), schema)
    # the broken archive is never opened if its date is not asked for
    got = every.where("file_date >= '2024-01-31'").agg(F.count("*").alias("n"), F.sum("id").alias("s")).first()
    assert (got.n, got.s) == (30_000, sum(range(100, 30_100)))
    assert every.where("file_date in ('2024-01-01', '2024-01-02') and flag").count() == 2
    with pytest.raises(Exception, match="[Zz]ip"):
        every.where("file_date >= '2024-01-02'").count()
    reader = archives.ZippedReader(every.schema, {"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("file_date",), "2024-01-01"), EqualTo(("id",), 1)])) == [EqualTo(("id",), 1)]
    assert [(p.archive.rpartition("/")[2], p.member) for p in reader.partitions()] == [("x-2024-01-01.zip", "a.csv"), ("x-2024-01-01.zip", "b.csv.gz")]
    assert archives.read_zipped(spark, f"{tmp_path}/x-2024-01-01.zip").columns == ["id", "price", "flag", "file_date", "archive", "member"]
    assert archives.read_zipped(spark, f"{tmp_path}/none-*.zip", schema).count() == 0


def test_members_are_streamed(spark, tmp_path):
    """A member far larger than a block comes in many batches."""
    line = "1234567,0.123456789\n"
    archive(tmp_path / "big-2024-03-01.zip", {"a.csv": "id,price\n" + line * 1_500_000})
    reader = archives.ZippedReader(spark.createDataFrame([], "id long, price double").schema, {"path": str(tmp_path)})
    batches = list(reader.read(reader.partitions()[0]))
    assert len(batches) >= 7 and sum(b.num_rows for b in batches) == 1_500_000 and max(b.num_rows for b in batches) < 300_000


def test_feature_columns(spark):
    df = spark.createDataFrame([], "t long, a double, b int, y_reg double, y_cls int, c_flag int, ok boolean, name string, d decimal(10,2)")
    assert tables.feature_columns(df, "t") == ["a", "b", "c_flag", "d"]
    assert tables.feature_columns(df, "t", exclude=["*_flag"]) == ["a", "b", "d"]
    assert tables.feature_columns(df, "t", exclude=["b"], labels=True) == ["a", "y_reg", "y_cls", "c_flag", "d"]
    assert tables.feature_columns(df, "t", prefixes=["t", "y", "a"], labels=True) == ["t", "a", "y_reg", "y_cls"]


def test_strict_and_skipping_names(spark):
    assert indicators.known_names(["rsi_14", "# none", "nope_3", "rsi_14", "fng", "close", "close_3", "tod_sin", "??"]) == (["rsi_14", "fng", "close", "tod_sin"], ["nope_3", "close_3", "??"])
    assert indicators.known_names(["fng_diff1"], ["close"]) == ([], ["fng_diff1"])
    assert indicators.known_names(indicators.DEFAULT_PLAN) == (list(indicators.DEFAULT_PLAN), [])
    bars = spark.createDataFrame([("a", k, 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 3.0) for k in range(20)], "symbol string, bar long, open double, high double, low double, close double, volume double")
    with pytest.raises(ValueError, match="nope_3"):
        indicators.compute(bars, ["mom_2", "nope_3"], ["symbol"], "bar")
    assert indicators.compute(bars, ["mom_2", "nope_3"], ["symbol"], "bar", strict=False).columns == ["symbol", "bar", "mom_2"]


def test_digest_of_trees():
    a, b = ("+", "close", ("rolling_mean", "volume", 5)), ("+", ("rolling_mean", "volume", 5.000000001), "close")
    assert alpha.digest(a) == alpha.digest(b) != alpha.digest(("-", *a[1:]))
    assert alpha.digest("close") == hashlib.blake2b(b'"close"', digest_size=16).hexdigest() and len(alpha.digest(a)) == 32


def test_times_of_books():
    assert not hasattr(bartime, "trade_time")  # the chain of fallbacks lies in sources.records
