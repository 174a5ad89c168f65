"""Operator 9: secret scans, by DataFrame functions only.

Base kinds are found by regular expressions, leftmost and without overlap for each kind: ``assign`` (a named value of 6 characters or more),
``access`` (access identifiers of 20 or more) and ``hex`` (runs of 24 or more). A pattern's matches and the gaps between them come from
``regexp_extract_all`` and ``split`` with the same pattern; running sums of their lengths are the offsets, in code points.

Method: multipart credential linking. Weak candidates are ``identifier`` (user or client names with a value), ``key40`` (40 characters of
base64) and ``endpoint`` (addresses with a scheme). A weak candidate is reported only if complementary parts lie in its
scope, the same text with an end at most ``REACH`` code points away, and do not overlap it: an identifier needs a secret, a key40 needs an
identifier, an endpoint needs a secret and an identifier that itself has a secret in its scope. Parts are joined as intervals: equal text and equal cell of ``REACH`` code points,
the weak side in all cells that it and its surroundings touch, with distance and order as further conditions; as a
semi-join it makes no pairs. A weak candidate within a base span is part of that and not reported besides.

Cases: null and empty texts have no spans (the hash is that of the empty string); every input row gives one
row, repeats included; a null doc_id is kept; other columns are ignored; a text of any length is scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialise, positional

REACH = 200
#: Texts with secrets, and spans in them (16 bytes each), that may be broadcast when texts are rewritten.
BROADCAST_ROWS, BROADCAST_SPANS = 50_000, 500_000
MASK = "[SECRET]"
SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"

#: Kinds in their order, with their patterns and the role of each part.
PATTERNS = {
    "assign": "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "identifier": "(?i)\\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?|key_?id)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.@-]{3,}",
    "key40": "(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": "(?:https?|ftp|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+",
}
BASE = ("assign", "access", "hex")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key40": "secret", "endpoint": "endpoint"}
#: What a text must hold for its weak patterns to be tried: cheap searches for a fixed string.
HINTS = {"endpoint": "://"}


def _parts(text: Column, kind: str) -> Column:
    """Array of (gap before the match, length of the match, length of its value), all in code points."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    zipped = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("n"), F.length(v).alias("value")))
    parts = F.zip_with(F.slice(gaps, 1, F.size(zipped)), zipped, lambda g, z: F.struct(g.alias("gap"), z.n.alias("n"), z.value.alias("value")))
    hint = text.contains(HINTS[kind]) if kind in HINTS else F.lit(True)
    return F.when(hint & text.rlike(pattern), parts).otherwise(F.array().cast("array<struct<gap:int,n:int,value:int>>"))


def scanned(docs: DataFrame, *keep: Column) -> DataFrame:
    """(row, doc_id, *keep, parts) of every row: the only pass over the texts, written out as it numbers the rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    columns = [_parts(text, k).alias(k) for k in PATTERNS]
    return materialise(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *keep, *columns), "secret-parts")


def spans_of(parts: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the base spans and of the weak candidates that complementary parts support."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in PATTERNS])
    hits = parts.where(" or ".join(f"size({k}) > 0" for k in PATTERNS)).select("row", F.explode(kinds).alias("k")).select("row", "k.kind", F.posexplode("k.found").alias("at", "m"))
    order = W.partitionBy("row", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.n")).over(order)
    spans = hits.select("row", "kind", end.alias("end"), F.col("m.n").alias("n"), F.col("m.value").alias("value"))
    spans = spans.where("kind <> 'assign' or value >= 6").select("row", "kind", (F.col("end") - F.col("n")).alias("start"), "end")
    spans = materialise(spans, "secret-spans")
    role = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    parts_of = lambda *roles: spans.where(role[F.col("kind")].isin(*roles))
    identifiers = supported(parts_of("identifier"), parts_of("secret"))
    weak = identifiers.where("kind = 'identifier'")
    keys = supported(spans.where("kind = 'key40'"), parts_of("identifier"))
    endpoints = supported(supported(spans.where("kind = 'endpoint'"), identifiers), parts_of("secret"))
    base = spans.where(F.col("kind").isin(*BASE))
    found = base.withColumn("weak", F.lit(0)).unionByName(weak.unionByName(keys).unionByName(endpoints).withColumn("weak", F.lit(1)))
    # what lies within a base span is no further part: a base span that begins before or there ends no earlier
    upto = W.partitionBy("row").orderBy("start", "weak").rowsBetween(W.unboundedPreceding, 0)  # the spans of a text
    found = found.withColumn("covered", F.max(F.when(F.col("weak") == 0, F.col("end"))).over(upto))
    return found.where("weak = 0 or covered is null or covered < end").drop("weak", "covered")


def supported(weak: DataFrame, parts: DataFrame) -> DataFrame:
    """The spans of ``weak`` with a part that ends or starts at most REACH code points away and does not overlap them: an interval semi-join."""
    ends = parts.select(F.col("row").alias("a_row"), F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.explode(F.array("start", "end")).alias("point"))
    ends = ends.withColumn("cell", F.floor(F.col("point") / REACH))
    near = weak.withColumn("near", F.explode(F.sequence(F.floor(F.col("start") / REACH) - 1, F.floor(F.col("end") / REACH) + 1)))
    reached = [F.col("a_row") == F.col("row"), F.col("cell") == F.col("near"), F.col("point") >= F.col("start") - REACH, F.col("point") <= F.col("end") + REACH, (F.col("a_end") <= F.col("start")) | (F.col("a_start") >= F.col("end"))]
    return near.join(ends, reached, "left_semi").select("row", "kind", "start", "end").distinct()


def _rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(i)) for i, k in enumerate(PATTERNS)])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row: sorted array of (start, rank, kind, end)."""
    parts = scanned(docs)
    any_part = " or ".join(f"size({k}) > 0" for k in PATTERNS)
    none = F.array().cast(SPANS)
    marks = parts.where(any_part).select("row", "doc_id", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    spans = spans_of(parts).select("row", F.lit(None).cast(parts.schema["doc_id"].dataType).alias("doc_id"), "kind", "start", "end")
    one = F.when(F.col("kind").isNotNull(), F.struct(F.col("start").cast("long").alias("start"), _rank(F.col("kind")).alias("rank"), "kind", F.col("end").cast("long").alias("end")))
    found = marks.unionByName(spans).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(one)).alias("spans"))
    rest = parts.where(f"not ({any_part})").select("doc_id", none.alias("spans"))
    return rest.unionByName(found.select("doc_id", F.col("spans").cast(SPANS).alias("spans")))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans, for every row."""
    own = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return secret_spans(docs).select("doc_id", *[own(k) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def merged(spans: DataFrame, by: str) -> DataFrame:
    """(by, masked): the spans of each text as a sorted array of (start, end), overlapping ones as one."""
    own = spans.select(by, F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end")).distinct()
    before = W.partitionBy(by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)  # the spans of a text
    own = own.withColumn("fresh", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int"))
    own = own.withColumn("part", F.sum("fresh").over(W.partitionBy(by).orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    one = own.groupBy(by, "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return one.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("masked"))


def masked_text(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every span of a sorted array without overlaps replaced. Pieces are cut from UTF-32, where a code point's place is known, so
    the work grows with the text's length only."""
    cut = lambda wide, a, n: F.decode(F.substring(wide, 4 * a + 1, 4 * n), "UTF-32")

    def rebuilt(wide: Column) -> Column:
        start_of = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        pieces = F.transform(spans, lambda s, i: cut(wide, start_of(i), s.start - start_of(i)))
        last = F.element_at(spans, -1)["end"]
        return F.array_join(F.concat(pieces, F.array(F.substring(text, last + 1, F.length(text)))), mask)

    # an array of one, so that the wide form is made once and not for each piece
    return F.transform(F.array(F.encode(text, "UTF-32")), rebuilt)[0]


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The rows of ``docs``, all columns, with every span replaced by ``mask`` (overlapping spans by one) and n_chars
    set anew. Spans depend on the text alone, so they are joined by the text's digest. Columns may have any names."""
    names, docs, key = docs.columns, positional(docs, ("doc_id", "text", "n_chars")), "digest"
    parts = scanned(docs, F.sha2(F.coalesce("text", F.lit("")), 256).alias(key))
    found = materialise(merged(spans_of(parts).join(parts.select("row", key), "row"), key), "secret-masks")
    rows, marks = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("masked")), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and marks <= BROADCAST_SPANS
    both = docs.withColumn(key, F.sha2(F.coalesce("text", F.lit("")), 256)).join(F.broadcast(found) if small else found, key, "left")
    spans = F.col("masked")
    out = both.withColumn("text", F.when(spans.isNull() | F.col("text").isNull(), F.col("text")).otherwise(masked_text(F.col("text"), spans, mask)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns).toDF(*names)
