"""Columns of any name and type through the stages of the pipeline, and license scans of texts that hold many licenses."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapeloom.llm import decontaminate, licenses, quality, secrets, simhash

DATA = "/root/testdata/sf0.001"
NAMES = ["a.b", "c`d", "simhash fp", "SIMHASH FP", "TEXT_DIGEST", "Digest", "masked", "FP", "root", "row", "X0", "x1", "doc id", "é"]


@pytest.fixture(scope="module")
def wide(spark):
    """200 documents, some with another row of the same doc_id, and columns whose names clash with helpers or need quotes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 20").withColumn("text", F.concat(F.lit("other words of the same doc_id "), F.col("text")))).union(docs.where("doc_id between 10 and 15"))
    plain = [c for c in NAMES if c not in ("SIMHASH FP", "X0")]
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in plain], F.create_map(F.lit("k"), F.col("doc_id")).alias("m.p"), F.parse_json(F.concat(F.lit('{"k":'), F.col("doc_id"), F.lit("}"))).alias("va`r"))
    return docs.repartition(3)


def shown(df):
    return sorted(str((r.doc_id, r.text, *[str(r[k]) for k in range(len(df.columns)) if df.columns[k] not in ("n_chars",)])) for r in df.collect())


STAGES = {
    "quality": lambda spark, d: quality.keep_good(d, quality.Model(b" " * 8, b" " * 8, 1.0, 0.0)),
    "near_dedup": lambda spark, d: simhash.keep_one(d),
    "decontamination": lambda spark, d: decontaminate.drop_leaks(d, spark.read.parquet(f"{DATA}/benchmark.parquet")),
    "secrets": lambda spark, d: secrets.mask_secrets(d),
}


@pytest.mark.parametrize("stage", list(STAGES))
def test_columns_of_any_name_stay(spark, wide, stage):
    out = STAGES[stage](spark, wide)
    plain = STAGES[stage](spark, wide.select("doc_id", "text", "lang", "source", "n_chars"))
    assert out.columns == wide.columns and [f.dataType for f in out.schema] == [f.dataType for f in wide.schema]
    rows = out.collect()
    key = lambda r: (r["doc_id"], r["text"], r["n_chars"])
    assert sorted(map(key, rows)) == sorted(map(key, plain.collect())) and rows
    at = {c: k for k, c in enumerate(out.columns)}
    for r in rows:
        assert all(r[at[c]] == f"{c} of {r['doc_id']}" for c in at if c in NAMES)
        assert r[at["m.p"]] == {"k": r["doc_id"]} and r[at["va`r"]].toPython() == {"k": r["doc_id"]}


@pytest.mark.parametrize("stage", list(STAGES))
@pytest.mark.parametrize("name", ["SIMHASH FP", "X0", "TEXT_DIGESTSPANS"])
def test_other_cases_of_names(spark, wide, stage, name):
    docs = wide.select("doc_id", "text", "lang", "source", "n_chars", F.lit("kept").alias(name))
    out = STAGES[stage](spark, docs)
    assert out.columns == docs.columns and {r[5] for r in out.collect()} == {"kept"}


def test_columns_survive_the_stages_together(spark, wide, tmp_path):
    folder = str(tmp_path)
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    docs = wide
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.columns == wide.columns
    at = {c: k for k, c in enumerate(docs.columns)}
    rows = docs.collect()
    assert rows and all(r[at[c]] == f"{c} of {r['doc_id']}" for r in rows for c in at if c in NAMES)


FULL = [text for _, text in licenses.TEXTS]


def test_many_full_licenses_in_one_text():
    scanner = licenses.Scanner()
    began = time.process_time()
    found = scanner.scan(" ".join(FULL).encode())
    joined = time.process_time() - began
    assert [f[0] for f in found] == [name for name, _ in licenses.TEXTS] and all(f[3] > 0.99 for f in found)
    gpl = max((t for n, t in licenses.TEMPLATES if n == "GPL-3.0"), key=len)
    words = len(licenses.normal_words(gpl.encode()))
    began = time.process_time()
    found = scanner.scan(" ".join([gpl] * 100).encode())
    copies = time.process_time() - began
    assert [(f[0], f[1]) for f in found] == [("GPL-3.0", k * words) for k in range(100)]
    assert joined < 2 and copies < 6  # a window at a time it was 89 seconds for the first text alone


def test_shares_equal_plain_containment():
    import numpy as np

    rng = np.random.default_rng(4)
    template = " ".join(f"t{k}" for k in range(60))
    scanner = licenses.Scanner([("T", template)])
    own = scanner.templates[0][3]
    words = rng.choice([f"t{k}" for k in range(60)] + ["x", "y"], 4000).tolist()
    for k in range(0, 4000, 300):
        words[k : k + 60] = template.split()
    h = licenses.shingle_hashes(scanner.hashes.of(licenses.normal_words(" ".join(words).encode())))
    known = np.flatnonzero(np.isin(h, own))
    starts = np.arange(0, len(h) - 56, 7)
    want = [np.isin(own, h[s : s + 56]).mean() for s in starts]
    assert np.allclose(scanner.shares(0, known, h, 56, starts), want)
