"""Periodic runs, repeated passages and the manifest against plain forms, on random and on odd tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import manifest, periodic, queries, repeats


def plain_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def periodic_words(rng, n, kinds, heads):
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(heads):
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_plain_runs(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n = rng.choice([1, 5, 12, 30, 60, 150, 400])
        words = periodic_words(rng, n, rng.choice([1, 2, 3, 5, 40]), rng.randrange(3))
        assert periodic.find_runs(np.array(words)) == plain_runs(words)


def test_lag_counts_of_frequent_and_rare_words():
    rng = random.Random(1)
    words = [0 if rng.random() < 0.5 else 1 + rng.randrange(3000) for _ in range(6000)]  # one word takes the transform, the others differences
    ids = np.array(words)
    want = [int((ids[q:] == ids[: len(ids) - q]).sum()) for q in range(1, 3001)]
    assert periodic.lag_matches(ids, 3000).tolist()[1:] == want


def test_long_periodic_texts_do_not_scan_each_multiple():
    ids = np.tile(np.arange(7), 60_000)
    assert periodic.find_runs(ids) == [(0, len(ids), 7)]
    assert periodic.find_runs(np.zeros(300_000, np.int64)) == [(0, 300_000, 1)]


def words_of(text):
    return (text or "").encode().split()


def odd_table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("key", "crc", "n", "idx", "g", "h", "at", "a.b", "spans", "runs", "part"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


LONG = " ".join(f"w{i % 9973}" for i in range(120_000))
ODD = [(None, "no id " * 40), (None, None), (1, ""), (1, None), (2, "one"), (3, LONG), (3, LONG), (4, LONG[5000:9000] + " tail"), (5, "é ü " * 50), (5, "a b c " * 20), (6, " ".join(f"x{i}" for i in range(34))), (6, " ".join(f"x{i}" for i in range(34)))]


def test_run_table_of_odd_rows(spark):
    rows = periodic.run_table(odd_table(spark, ODD), edit=True).collect()

    def want(doc_id, text):
        words = words_of(text)
        h = zlib.crc32(str(doc_id).encode())
        if doc_id is not None and words and h % 10 == 0:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        # the plain form is too slow for the long text: all of it but a tail is one run
        runs = plain_runs(words) if len(words) < 1000 else [(0, len(words), 9973)]
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        return doc_id, len(words), tuple(runs), b" ".join(w for i, w in enumerate(words) if i not in drop).decode()

    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in rows) == Counter(want(*r) for r in ODD)
    assert periodic.run_table(odd_table(spark, [])).count() == 0


def plain_repeats(rows, window):
    texts = [(i, words_of(t)) for i, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in texts for i in range(len(w) - window + 1))
    out = []
    for doc_id, w in texts:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                keep[i : i + window] = [False] * window
        kept = b" ".join(x for x, k in zip(w, keep) if k)
        out.append((doc_id, len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window, seed", [(35, 10), (12, 4), (5, 2)])
def test_repeats_equal_plain_windows(spark, window, seed):
    rng = random.Random(window)
    passages = [[f"p{rng.randrange(30)}" for _ in range(rng.randint(window - 3, 3 * window))] for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(rng.randrange(6)):
            words += [f"w{rng.randrange(500)}" for _ in range(rng.randrange(2 * window))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                words += p[rng.randrange(len(p)) :] if rng.random() < 0.5 else p
        words = rng.choice([words] * 8 + [["a"] * rng.randrange(3 * window), ["a", "b"] * rng.randrange(3 * window)])
        rows.append((rng.choice([None, i, i, i]), " ".join(words)))
        if rng.random() < 0.1:
            rows.append((i + 1000, rows[-1][1]))
    got = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string"), window, seed).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(plain_repeats(rows, window))
    assert all(sum(x.n_words for x in r.repeats) == r.n_removed and all(x.n_words >= window for x in r.repeats) for r in got)


def test_repeats_of_odd_rows(spark):
    df = odd_table(spark, ODD)
    got = [tuple(r)[:4] for r in repeats.repeat_report(df).collect()]
    assert Counter(got) == Counter(plain_repeats(ODD, 35))
    assert repeats.repeat_report(odd_table(spark, [])).count() == 0
    left = {hashlib.sha256(b" ".join(words_of(r.text))).hexdigest() for r in repeats.without_repeats(df).collect()}
    assert left == {r[3] for r in got}


def test_texts_are_found_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BROADCAST_TEXTS", 0)
    got = [tuple(r)[:4] for r in repeats.repeat_report(odd_table(spark, ODD)).collect()]
    assert Counter(got) == Counter(plain_repeats(ODD, 35))


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows, fanout=2):
    """Rows (doc_id, source, lang, n_chars, text)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, more=0: digest(*map(part, (*r[:3], None if r[3] is None else r[3] + more, r[4])))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g] = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in names}
    upper = tree([trees[g][-1][0] for g in names]) if names else []
    out = []
    for k, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            now = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0)
            beside = []
            for levels, at in ((trees[g], i), (upper, k)):
                for nodes in levels[:-1]:
                    first = at - at % fanout
                    left, right = "".join(nodes[first:at]), "".join(nodes[at + 1 : first + fanout])
                    beside += [left, right]
                    now, at = digest(left, now, right), at // fanout
            out.append((r[0], leaf(r), trees[g][-1][0], upper[-1][0], digest(*beside), now, now == upper[-1][0]))
    return out


@pytest.mark.parametrize("n, fanout, span", [(0, 2, 9), (1, 2, 9), (9, 2, 1), (260, 2, 3), (700, 2, 9), (300, 3, 4), (200, 5, 5)])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, fanout, span):
    monkeypatch.setattr(manifest, "SPAN", span)
    rng = random.Random(n)
    langs = [None, "", "en", "en", "en", "en", "zz", "é", *(f"l{k}" for k in range(n % 40))]
    rows = [(rng.choice([None, i, i, i // 3]), rng.choice([None, "a", "ü"]), rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "x" * i, "日本"])) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for name in ("g", "key", "extra", "level", "a.b", "digest"):
        df = df.withColumn(name, F.lit("x"))
    altered = {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    where = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    got = manifest.merkle_report(df.repartition(3), altered=altered, where=where, fanout=fanout)
    assert Counter(map(tuple, got.collect())) == Counter(plain_manifest(rows, fanout))


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_repeats", "op13_manifest"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = queries.queries()[name](spark, "/root/testdata/sf0.001")
    assert sorted(rows.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in rows.collect()) == Counter(found.fetchall())
