"""One odd table through every training-data operator, and brute-force forms of what SQL cannot express."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tapeloom.llm import bpe, common, ctph, decontaminate, licenses, quality, secrets, simhash, token_files, toxicity, warc
from tapeloom.llm.queries import tokenizer_path

DATA = "/root/testdata/sf0.001"
SHARED = " ".join(f"common{i}" for i in range(40))
LICENSE = "This work is licensed under the GNU General Public License, version 3."
PASSAGE = " ".join(f"item{i} word" for i in range(30))
LONG = " ".join(f"w{i % 997}x{i % 89}" for i in range(160_000)) + f" {PASSAGE} {LICENSE} password=hunter2222 end"
ROWS = [
    (None, "a text without an id"), (None, "another text without an id"), (None, None),
    (1, SHARED), (5, SHARED), (5, "five has a second text of its own"), (5, "five has a second text of its own"), (7, ""), (8, None), (9, SHARED.upper()),
    (12, LONG), (13, "\U0001f642 caf\u00e9 \x00 \u2028 mixed"), (14, f"{PASSAGE} {LICENSE}"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in ("lang", "fp", "ids", "row", "h", "bucket", "place", "label", "score", "fold", "text_digest", "text_digestspans", "page_id"):
        df = df.withColumn(name, F.lit("x"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def library():
    import tokenizers

    return tokenizers.Tokenizer.from_file(tokenizer_path())


def same(got, want):
    assert Counter(got) == Counter(want)


def test_long_text_is_over_a_mebibyte():
    assert len(LONG.encode()) > 1 << 20


def test_token_ids(odd, library):
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS]
    rows = token_files.token_files(odd, tokenizer_path()).orderBy("start").collect()
    crc = lambda x: zlib.crc32(np.array([*x, 1], "<u4").tobytes())
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows], [(i, len(x) + 1, crc(x)) for i, x in ids])
    assert [r.doc_id for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(odd, tokenizer_path()).collect()]
    same(got, [(i, len(x), digest(" ".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for i, x in ids])


def test_simhash(odd):
    rows = simhash.near_groups(odd).collect()
    prints = lambda t: simhash.fingerprint((t or "").encode())
    same([(r.doc_id, r.fp & (1 << 64) - 1) for r in rows], [(i, prints(t)) for i, t in ROWS])
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.fp] = min(least.get(r.fp, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(r.fp) for r in rows)  # here only equal prints are linked
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    same([(r.doc_id, r.text) for r in kept.collect()], [ROWS[k] for k in (0, 1, 2, 3, 5, 7, 10, 11, 12)])


def test_decontamination_and_licenses(spark, odd):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (4, "..."), (5, "words that nothing else holds at all")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    same([(r.doc_id, r.item_id, r.similarity) for r in decontaminate.leaks(odd, benchmark).collect()], [(12, 1, 1.0), (14, 1, 1.0)])
    left = decontaminate.drop_leaks(odd, benchmark)
    assert left.columns == odd.columns
    same([(r.doc_id, r.text) for r in left.collect()], [r for r in ROWS if r[0] not in (12, 14)])
    same([(r.doc_id, r.license) for r in licenses.license_matches(odd).collect()], [(12, "GPL-3.0"), (14, "GPL-3.0")])
    assert licenses.license_matches(odd.where("false")).count() == 0


def test_classifiers(spark, odd):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for module in (quality, toxicity):
        rows = module.score(odd, module.fit(docs, labels)).collect()
        same([r.doc_id for r in rows], [i for i, _ in ROWS])
        assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
        assert module.score(odd.where("false"), module.fit(docs, labels)).count() == 0


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(3, f"text {k:05d}") for k in range(5000)] + [(i, f"own {i}") for i in range(4, 300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1)], "doc_id long, quality int")
    rows = common.training_rows(docs, labels, "quality", 50).collect()
    assert len(rows) <= 50 and len({r.doc_id for r in rows}) == len(rows) and all(r.text == "text 00000" for r in rows if r.doc_id == 3)
    assert not any(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_quality_sample_is_cut_at_its_bound(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1000)
    rows = spark.createDataFrame([(i, "ab" * 900, 1.0, 0) for i in range(5)], "doc_id long, text string, label double, fold int")
    assert [len(t) for t in quality._collect_texts(rows, 1.0)] == [1000]


def test_quality_scores_from_the_plain_definition(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    sizes = []
    for data in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(data)
        sizes.append(lambda x, d=d: len(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False).compress(x)))
    texts = {r.doc_id: r.text.encode() for r in docs.limit(60).collect()}
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, data in texts.items():
        good, bad = (sum(size(data[k : k + 1024]) for k in range(0, len(data), 1024)) for size in sizes)
        x = (bad - good) / len(data) if data else 0.0
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(model.a + model.b * x))))


def test_toxicity_features_from_plain_loops():
    lexicon = {"bad": 2.0, "wors*": 3.0, "idiot": 4.0}
    own = toxicity.Features(lexicon)
    texts = ["", "You are BAD, you w0rst worstest idiot!!!", "bad " * 60 + "you", "nothing here at all.", "(you) x y z a b c idiot d e f g h your"]
    for text in texts:
        words = [w for w in (x.strip(toxicity._EDGE) for x in text.lower().split()) if w]
        weight = lambda w: max([lexicon.get(w, 0.0)] + [lexicon.get(w[:n] + "*", 0.0) for n in (4, 5, 6) if len(w) >= n])
        hits = [i for i, w in enumerate(words) if weight(w)]
        you = [i for i, w in enumerate(words) if w in toxicity.SECOND_PERSON]
        n = max(len(words), 1)
        letters = sum(map(len, words)) or 1
        want = (
            min(len(hits), 20), len(hits) / n, sum(weight(w) for w in words) / n, min(max([sum(i <= j < i + 50 for j in hits) for i in hits], default=0), 20), min(len({words[i] for i in hits}), 20),
            sum(any(abs(i - j) <= 5 for j in you) for i in hits) / n, len(you) / n, sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) / letters, sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / max(len(text), 1),
            len(re.findall(r"[a-zA-Z][0-9@$!*#+]+[a-zA-Z]", text)) / n, math.log1p(len(words)),
        )
        assert own.of(text) == pytest.approx(want)


def plain_letters(data, size):
    """A cut after every byte at which the hash of the last 7 bytes is size - 1 modulo size; a letter for each chunk."""
    out, start = "", 0
    for end in range(1, len(data) + 1):
        h = 0
        for b in (bytes(6) + data)[end - 1 : end + 6]:
            h = (h * 0x01000193 + b) & 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x85EBCA6B & 0xFFFFFFFF
        h ^= h >> 13
        if end == len(data) or h % size == size - 1 and len(out) < 63:
            out += ctph.ALPHABET[(zlib.crc32(data[start:end]) * 2654435761 >> 20) & 63]
            start = end
    return out


def plain_print(text):
    data = text.encode()
    if not data:
        return "3::"
    size = 3
    while size * 64 < len(data):
        size *= 2
    while len(plain_letters(data, size)) < 32 and size > 3:
        size //= 2
    return f"{size}:{plain_letters(data, size)}:{plain_letters(data, 2 * size)}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    x, y = ({int(p[0]): p[1], 2 * int(p[0]): p[2]} for p in (a.split(":"), b.split(":")))
    for size in x.keys() & y.keys():
        s, t = x[size], y[size]
        if not s or not t:
            continue
        runs = lambda v: {v[i : i + 4] for i in range(max(len(v) - 3, 1))}
        if not runs(s) & runs(t):
            continue
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            before, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (c != d))
        best = max(best, 1 - row[-1] / max(len(s), len(t)))
    return best


def test_fingerprints_and_likeness_equal_plain_loops(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(40).collect()]
    docs += [(10_000 + k, t) for k, t in enumerate(["", "a", "aaaaaaa" * 40, docs[3][1][:-20], docs[3][1] * 2, None])]
    got = {r.doc_id: r for r in ctph.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), ranges=7).collect()}
    for (i, text), (_, following) in zip(docs, [*docs[1:], docs[0]]):
        text, following = text or "", following or ""
        n = len(text)
        edited = text[: n - n // 4] + following[: n // 4]
        prints = [plain_print(t) for t in (text, edited, following)]
        assert [got[i].fingerprint, got[i].edited_fingerprint] == prints[:2]
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((plain_likeness(prints[0], prints[1]), plain_likeness(prints[0], prints[2])))
    pairs = [(plain_print(a), plain_print(b)) for a in [t for _, t in docs[3:7]] for b in [docs[3][1] * 2, docs[3][1][:-20], docs[4][1]]]
    near = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ctph.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in near] == pytest.approx([plain_likeness(r.a, r.b) for r in near])


@pytest.mark.parametrize("ranges", [1, 6, 40])
def test_next_documents_of_ids_that_very_many_rows_have(spark, ranges):
    rows = [(None, f"null {i} " * 3) for i in range(40)] + [(7, f"seven {i} " * 4) for i in range(60)] + [(i, f"doc {i} " * 5) for i in range(8, 90)] + [(i, f"low {i}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = [r for r in ctph.with_next(df, ranges).collect() if not r.ahead]
    order = sorted(dealt, key=lambda r: (r.bucket, r.doc_id is not None, r.doc_id or 0, r.h, r.text))
    assert [r.doc_id for r in order] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    if ranges == 40:
        assert max(Counter(r.bucket for r in dealt).values()) < 25
    edited = lambda a, b: a[: len(a) - len(a) // 4] + b[: len(a) // 4]
    want = [(a.doc_id, hashlib.sha256(edited(a.text, b.text).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1])]
    same([(r.doc_id, r.edited_sha256) for r in ctph.edited_fingerprints(df, ranges).collect()], want)


def test_fingerprints(odd):
    rows = ctph.edited_fingerprints(odd, ranges=4).collect()
    same([(r.doc_id, r.n_chars, r.fingerprint) for r in rows], [(i, len(t or ""), ctph.fingerprint(t or "")) for i, t in ROWS])


def test_secrets(odd):
    rows = secrets.secret_report(odd).collect()
    at = LONG.index("password=")
    same([(r.doc_id, r.spans) for r in rows], [(i, f"assign:{at}:{at + 19}" if t == LONG else "") for i, t in ROWS])
    masked = secrets.mask_secrets(odd)
    assert masked.columns == odd.columns
    same([(r.doc_id, r.text) for r in masked.collect()], [(i, t.replace("password=hunter2222", "[SECRET]") if t else t) for i, t in ROWS])


def plain_shingles(words, size):
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_licenses_against_plain_windows():
    """Spans and containments of altered notices by plain windows over words; recall at containments of 0.8 and more."""
    from tapeloom.llm import shingles

    rng = np.random.default_rng(6)
    scanner = licenses.Scanner()
    split = lambda text: shingles.normal_words(text.encode())
    short = [(name, split(text)) for name, text in licenses.TEMPLATES if 5 <= len(text.split()) <= 150]
    wanted = found = 0
    for k in range(240):
        name, words = short[k % len(short)]
        text = list(words)
        for at in rng.choice(len(text), min(len(text) - 1, int(rng.integers(0, 1 + len(text) // 20))), replace=False):
            text[at] = b"changed%d" % rng.integers(1000)
        text = [b"before%d" % i for i in range(int(rng.integers(0, 30)))] + text + [b"after%d" % i for i in range(int(rng.integers(0, 30)))]
        best = {}
        for other, template in short:
            size = min(5, len(template))
            bag = plain_shingles(template, size)
            for start in range(max(len(text) - len(template), 0) + 1 if len(text) >= size else 0):
                window = text[start : start + len(template)]
                share = len(bag & plain_shingles(window, size)) / len(bag)
                if share >= 0.8:
                    best[other, start, len(window)] = max(share, best.get((other, start, len(window)), 0))
        got = scanner.scan(b" ".join(text))
        for license_, start, n, share in got:  # whatever is reported holds
            assert best[license_, start, n] == pytest.approx(share)
        if best:
            wanted += 1
            found += bool(got)
    assert wanted > 150 and found / wanted > 0.98


def test_recall_of_decontamination_near_the_threshold():
    rng = np.random.default_rng(8)
    items, texts = [], []
    for n in (20, 40, 100):
        for _ in range(60):
            words = [f"w{x}" for x in rng.integers(0, 10**9, n)]
            other = list(words)
            other[int(rng.integers(n))] = "x"
            if n > 40:
                other[int(rng.integers(n))] = "y"
            items.append((len(items), " ".join(words)))
            texts.append("some words before it " + " ".join(other) + " and some after")
    bench = decontaminate.Benchmark(items)
    bag = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    wanted = 0
    for (i, item), text in zip(items, texts):
        w, t = item.split(), text.split()
        a = bag(w)
        best = 0.0
        for s in range(len(t) - len(w) + 1):
            b = bag(t[s : s + len(w)])
            best = max(best, (a & b).total() / (a | b).total())
        got = {m[0]: m[3] for m in bench.matches(text.encode())}
        if best >= 0.8:
            wanted += 1
            assert got[i] == pytest.approx(best)
        else:
            assert i not in got
    assert wanted > 60


def test_archives(spark, tmp_path):
    big = "<p>hello world</p>" * 300_000
    rows = [(1, "u", big), (2, None, big), (2, "u", "other"), (None, "u", big), (None, None, None), (3, "u", ""), (3, "u", ""), (4, "u", "other"), (5, "x\r\ny: z", "\U0001f642" * 400_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).withColumn("number", F.lit(1)).withColumn("payload", F.lit(2))
    got = warc.archive_round_trip(pages, folder=str(tmp_path / "w")).collect()
    bare = lambda h: base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in rows:
        h = h or ""
        again = i is not None and first[h] != i
        want.append((i, len(h.encode()), bare(h), "revisit" if again else "response", first[h] if again else None))
    same([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], want)


def test_archive_reader_at_every_bound():
    import io

    for size in (0, 1, 4, 1000):
        for unit in (b"a", b"<p>hello world</p>"):
            body = unit * 3000
            head = warc.record_head(1, "u", len(body), hashlib.sha1(body).digest(), None)
            press = zlib.compressobj(9, zlib.DEFLATED, 31)
            member = press.compress(head + body + b"\r\n\r\n") + press.flush()
            stream = warc.MemberStream(io.BytesIO(member * 3), max(size, 1))
            for _ in range(3):
                assert stream.head() + b"\r\n\r\n" == head and stream.read(len(body)) == body and stream.read(4) == b"\r\n\r\n"
            assert stream.head() is None


def test_stages_take_the_odd_table(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    base = odd.select("doc_id", "text").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    both = docs.select(*base.columns).union(base).withColumn("fp", F.lit(1)).withColumn("simhash_root", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, both, DATA)
        assert out.columns == both.columns and 0 < out.count() <= both.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, both, DATA).count() == both.count()
