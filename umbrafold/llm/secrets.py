"""Secret scanning by multipart credential linking, with DataFrame functions alone.

Strong forms (an assigned password or token, an access key id, a long hexadecimal string) are reported
wherever they match. Weak candidates (a random-looking string, a value under a vague name) are reported only when a
complementary part lies near them in the same document and apart from them: an interval join links them with identifiers
and endpoints. The texts are read once for the base forms and once for the weak parts of those that have both; all else works on spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import fresh, staged

# The base forms as the contract gives them, in Java's notation. The second entry is the group to measure and its least length.
BASE = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12),
    "access": (r"AKIA[A-Z0-9]{14,}+", 0),
    "hex": (r"[0-9a-f]{16,}+", 0),
}
# The parts that are linked.
IDENTIFIER = r"""(?i:client_?id|key_?id|user(?:_?name)?|login|account(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+|AKIA[A-Z0-9]{14,}+"""
ENDPOINT = r"""(?:https?|ftps?|sftp|amqps?|redis|mongodb|mysql|postgres(?:ql)?)://[^\x00-\x20"'<>]++|(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}+"""
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])[A-Za-z0-9+/_=-]{20,}+"
NAMED = r"""(?i:pwd|pass|auth|credentials?|private_?key|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_=!@#%^&*-]{8,}+"""
DISTANCE = 400
BLOCK = 512


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda total, x: total + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def match_spans(text: Column, pattern: str, least: int = 0) -> Column:
    """Array of (start, end) of the pattern's leftmost non-overlapping matches, in code points, end exclusive.

    least: drop matches whose first group is shorter. Starts are sums of the lengths before, taken in blocks,
    so the work follows the number of matches.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # each step of the text: a gap and the match behind it; the gap after the last match has none
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("g"), whole.alias("m"))
    value = (lambda m: F.length(F.regexp_extract(m, pattern, 1))) if least else F.length
    steps = F.transform(steps, lambda s: F.struct(F.length(s["g"]).cast("long").alias("g"), F.length(s["m"]).cast("long").alias("m"), value(s["m"]).alias("v")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())

    def placed(s: Column) -> Column:
        return _let(F.transform(s, lambda x: x["g"] + x["m"]), lambda sizes: _let(befores(sizes), lambda before: F.transform(s, lambda x, i: span(x, i, sizes, before))))

    def befores(sizes: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: _sum(F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))))
        return _let(blocks, lambda t: F.transform(F.sequence(F.lit(0), F.size(t) - 1), lambda b: _sum(F.slice(t, F.lit(1), b))))

    def span(x: Column, i: Column, sizes: Column, before: Column) -> Column:
        b = F.floor(i / BLOCK).cast("int")
        start = F.get(before, b) + _sum(F.slice(sizes, b * BLOCK + 1, i - b * BLOCK)) + x["g"]
        return F.struct(start.alias("start"), (start + x["m"]).alias("end"), x["v"].alias("v"))

    found = F.filter(_let(steps, placed), lambda x: x["v"] >= least)
    none = F.array().cast("array<struct<start:bigint,end:bigint,v:int>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


SPANS = "array<struct<start:bigint,end:bigint>>"


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def linked_spans(parts: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """parts(h, m, random, named, identifier, endpoint, base), arrays of (start, end) for each distinct text (h, m), to (h, m, linked).

    The interval join: each candidate asks the bins of `distance` code points around it, each part stands in the bins that it covers. Spans of a
    kind don't overlap, so a bin holds a bounded number of each, however long the text. A part counts if it lies within `distance` of the
    candidate and shares no code point with it; a candidate that touches a base span is not reported.
    """
    width = F.lit(distance)
    bins = lambda start, end, more: F.explode(F.sequence(F.floor(start / width) - more, F.floor((end - 1) / width) + more))
    rows = parts.select(F.struct("h", "m").alias("scope"), "random", "named", "identifier", "endpoint", "base")
    each = lambda name, kind: rows.select("scope", F.lit(kind).alias("kind"), F.explode(name).alias("s")).select("scope", "kind", F.col("s.start").alias("p0"), F.col("s.end").alias("p1"))
    known = each("identifier", "identifier").union(each("endpoint", "endpoint")).union(each("base", "base")).withColumn("bin", bins(F.col("p0"), F.col("p1"), 0))
    weak = each("random", "random").union(each("named", "named")).select("scope", (F.col("kind") == "named").alias("named"), F.col("p0").alias("start"), F.col("p1").alias("end"))
    asks = weak.withColumn("bin", bins(F.col("start"), F.col("end"), 1))
    met = asks.join(known, ["scope", "bin"])
    apart = (F.col("p1") <= F.col("start")) | (F.col("p0") >= F.col("end"))
    within = (F.col("p0") < F.col("end") + width) & (F.col("p1") > F.col("start") - width)
    complements = (F.col("kind") == "identifier") | (F.col("named") & (F.col("kind") == "endpoint"))
    spans = met.groupBy("scope", "start", "end").agg(F.bool_or(complements & apart & within).alias("links"), F.bool_or((F.col("kind") == "base") & ~apart).alias("taken"))
    spans = spans.where("links AND NOT taken").groupBy("scope")
    return spans.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("linked")).select("scope.h", "scope.m", "linked")  # as many as fit one text


def secret_spans(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, h, m, assign, access, hex, linked): arrays of (start, end) by start; h and m are a hash of doc_id and text and one of the text.

    linked holds weak candidates that touch no base span and have an identifier within `distance` code points, or, if they are
    named, an endpoint, outside of the candidate itself. A null text is empty. Rows that repeat doc_id and text give equal results; a null doc_id is kept.
    Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents.select("doc_id", text.alias("text"))
    keys = (F.xxhash64("doc_id", "text").alias("h"), F.md5("text").alias("m"))
    base = staged(docs.select("doc_id", *keys, *[_plain(match_spans(F.col("text"), p, n)).alias(k) for k, (p, n) in BASE.items()]), "base")
    both = docs.where(F.col("text").rlike(f"{RANDOM}|{NAMED}") & F.col("text").rlike(f"{IDENTIFIER}|{ENDPOINT}"))
    forms = {"random": RANDOM, "named": NAMED, "identifier": IDENTIFIER, "endpoint": ENDPOINT}
    weak = staged(both.select(*keys, *[_plain(match_spans(F.col("text"), p)).alias(k) for k, p in forms.items()]), "weak").dropDuplicates(["h", "m"])
    near = base.select("h", "m", F.concat(*BASE).alias("base")).dropDuplicates(["h", "m"])
    links = linked_spans(weak.join(near, ["h", "m"]), distance)
    joined = base.join(links, ["h", "m"], "left")
    return joined.select("doc_id", "h", "m", *BASE, F.coalesce("linked", F.array().cast(SPANS)).alias("linked"))


def spans_text(kinds: dict[str, str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas. kinds: column to the name to print."""

    def told(column: str, k: int, name: str) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), F.lit(name).alias("name")))

    all_spans = F.concat(*[told(c, k, name) for k, (c, name) in enumerate(kinds.items())])
    return F.concat_ws(",", F.transform(F.array_sort(all_spans), lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])))


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of op3 from secret_spans()."""
    base = {k: k for k in BASE}
    return spans.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(base | {"linked": "linked"}).alias("spans"))


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All columns of documents(doc_id, text, n_chars, ...), each reported secret in text replaced by a mark and n_chars counted anew.

    The base forms are replaced by their patterns, so a form hidden behind a dropped shorter match goes as well; linked
    candidates by their text, wherever it occurs in the document. Null texts stay null.
    """
    own, other, hidden = (fresh(documents, n) for n in ("own_hash", "other_hash", "hidden"))
    some = secret_spans(documents).where(F.size("linked") > 0).select(F.col("h").alias(other), F.col("linked").alias(hidden)).dropDuplicates([other])
    joined = documents.withColumn(own, F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).join(some, F.col(own) == F.col(other), "left")
    quoted = lambda s: F.replace(F.substring(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    values = F.concat_ws("|", F.array_distinct(F.transform(hidden, lambda s: F.concat(F.lit(r"\Q"), quoted(s), F.lit(r"\E")))))
    text = F.when(F.col(hidden).isNotNull(), F.regexp_replace("text", values, F.lit(mark))).otherwise(F.col("text"))
    for pattern, least in BASE.values():
        text = F.regexp_replace(text, pattern.replace("]+)", f"]{{{least},}}+)") if least else pattern, mark)
    out = joined.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*documents.columns)
