"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, ctph, decontaminate, licenses, manifest, periodic, quality, repeats, secrets, simhash, token_files, toxicity, warc

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_fingerprints(table(spark, sf_dir, "documents"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.run_table(table(spark, sf_dir, "documents"), edit=True)
    # the longest run, of equals the first one, then that of the smallest period
    found = found.withColumn("best", F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    return manifest.merkle_report(table(spark, sf_dir, "documents"), altered={"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}, where=tampered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_files, op2_simhash, op3_decontamination, op4_toxicity, op5_bpe, op6_quality, op7_fingerprints, op8_licenses, op9_secrets, op10_warc, op11_periodic_runs, op12_repeats, op13_manifest)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op10_warc": WARC_SQL, "op11_periodic_runs": RUNS_SQL, "op12_repeats": REPEATS_SQL, "op13_manifest": MANIFEST_SQL}


#: Base32 of a SHA-1: every five of its hex digits are four letters.
WARC_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first_id
  FROM pages
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p
"""

#: CRC-32 of a number's decimals: each byte is mixed in, then eight shifts.
CRC_SQL = """list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 4294967295::BIGINT)"""

#: All equal pairs of words at a distance, and the islands of neighbouring pairs.
RUNS_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words, xor({CRC_SQL}, 4294967295) AS h
  FROM documents
), e AS (
  SELECT *, len(words) AS n, CASE WHEN h % 10 = 0 AND len(words) > 0 THEN (h // 10) % len(words) END AS a FROM d
), f AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM e
), w AS (
  SELECT r, n, i, words[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS word FROM f, unnest(range(0, n)) AS t(i)
), pairs AS (
  SELECT x.r, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 2 * (y.i - x.i) <= x.n
), islands AS (
  SELECT r, q, min(i) AS s, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island
), runs AS (
  SELECT r, s, length, min(q) AS q FROM islands WHERE length >= greatest(12, 2 * q) GROUP BY r, s, length
), drops AS (
  SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + length)) AS t(i)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM w ANTI JOIN drops USING (r, i) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first({{'s': s, 'l': length, 'q': q}} ORDER BY length DESC, s, q) AS b
  FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.s::BIGINT AS start, b.l::BIGINT AS length, b.q::BIGINT AS period, (1000 * b.l // b.q)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM d LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""

REPEATS_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(words[i:i+34], ' ')) AS k FROM d, unnest(range(1, len(words) - 33)) AS t(i)
), again AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM windows) WHERE n > 1
), removed AS (
  SELECT DISTINCT r, i + j AS i FROM again, range(0, 35) AS t(j)
), kept AS (
  SELECT r, count(*) AS n, string_agg(words[i], ' ' ORDER BY i) AS text
  FROM (SELECT r, i, words FROM d, unnest(range(1, len(words) + 1)) AS t(i)) ANTI JOIN removed USING (r, i) GROUP BY r
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def _part(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_part, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


#: Levels by recursion, over the leaves of each language and over the subroots; then the siblings of each leaf, and its fold.
MANIFEST_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('1' || lang, '') AS g, {_leaf("n_chars")} AS leaf, xor({CRC_SQL}, 4294967295) % 7 = 0 AS bad, {_leaf("(n_chars + 1)")} AS other
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves
), nodes AS (
  SELECT g, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY g) AS n FROM placed
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY g, level, idx // 2, n
), subroots AS (
  SELECT g, level AS height, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper AS (
  SELECT 0 AS level, place AS idx, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (n + 1) // 2 FROM upper WHERE n > 1 GROUP BY level, idx // 2, n
), steps AS (
  SELECT r, l AS step, (p.idx >> l) & 1 AS odd, n.digest AS sibling
  FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN unnest(range(0, height)) AS t(l) LEFT JOIN nodes n ON n.g = p.g AND n.level = l AND n.idx = xor(p.idx >> l, 1)
  UNION ALL
  SELECT r, height + l, (place >> l) & 1, u.digest
  FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN unnest(range(0, (SELECT max(level) FROM upper))) AS t(l) LEFT JOIN upper u ON u.level = l AND u.idx = xor(place >> l, 1)
), folds AS (
  SELECT r, 0::BIGINT AS step, CASE WHEN bad THEN other ELSE leaf END AS digest FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(CASE WHEN odd = 1 THEN coalesce(sibling, '') || f.digest ELSE f.digest || coalesce(sibling, '') END)
  FROM folds f JOIN steps s ON s.r = f.r AND s.step = f.step
)
SELECT p.doc_id, p.leaf, s.subroot, t.digest AS root, sha256(coalesce(x.siblings, '')) AS proof_sha256, y.digest AS folded_root, y.digest = t.digest AS verified
FROM placed p JOIN subroots s ON s.g = p.g CROSS JOIN (SELECT digest FROM upper WHERE n = 1) t
LEFT JOIN (SELECT r, string_agg(sibling, '' ORDER BY step) AS siblings FROM steps GROUP BY r) x ON x.r = p.r
JOIN (SELECT r, arg_max(digest, step) AS digest FROM folds GROUP BY r) y ON y.r = p.r
"""
