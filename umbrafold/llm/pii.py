"""Personal data by weak supervision.

Candidate spans come from the base patterns and from wider ones. Regex, gazetteer and context labelers vote on each
candidate (for, against or silent). Expectation-maximisation over the counts of vote patterns of the whole corpus estimates how reliable
each labeler is for each kind. A logistic span classifier then learns the posteriors from the span's own shape and the words around it, on about
SAMPLE_SPANS spans of each kind, chosen by a hash. Spans that it accepts are added to the base spans, which always stay. The driver gets counts by pattern, of which there
is a fixed number, and the sample.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import staged

# The base patterns of the contract, written so that no text makes them slow.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
# Wider candidate patterns, gazetteers and context words of the labelers.
KINDS = (*BASE, "ssn", "iban", "name")
WIDE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]++)+")),
    ("phone", re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
)
TITLES = ("Mr. ", "Mr ", "Mrs. ", "Mrs ", "Ms. ", "Miss ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Mme. ", "Mme ", "Mlle ", "Monsieur ", "Madame ", "Sr. ", "Sra. ", "Señor ", "Señora ", "Don ", "Doña ")
TITLED = re.compile(r"[A-Z][a-z]+(?: [A-Z][a-z]+)?")
GIVEN = re.compile(r"(?<![A-Za-z])([A-Z][a-z]+) [A-Z][a-z]+")
TOP_DOMAINS = frozenset("at au be biz br ca ch cn co com cz de dk edu es eu fi fr gov gr ie in info int io it jp kr mx net nl no nz org pl pt ru se tv uk us za".split())
CALLING_CODES = tuple("1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 64 65 81 82 86 90 91 351 352 353 358 380 420 421".split())
IBAN_COUNTRIES = frozenset("AD AE AL AT BA BE BG CH CY CZ DE DK EE ES FI FO FR GB GE GI GL GR HR HU IE IL IS IT KW KZ LB LI LT LU LV MC MD ME MK MT NL NO PL PT QA RO RS SA SE SI SK SM TN TR UA VA XK".split())
GIVEN_NAMES = frozenset(
    "Adam Alan Albert Alejandro Alexander Alice Amanda Amélie Ana Andrea Andrew Angela Anna Anne Antonio Barbara Ben Brian Camille Carlos Carmen Caroline Catherine Charles Charlotte Chloe Chris Christian Christine Claire Claudia Daniel David Deborah "
    "Diana Diego Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Erik Eva Fernando Francisco Frank Friedrich Gabriel George Gerhard Hannah Hans Heinz Helen Henri Henry Ines Isabel Jack Jacques James Jan Jane Janet Javier Jean Jennifer Jessica Joan Johann "
    "John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Lea Leon Linda Lisa Louis Lucas Lucia Lucie Luis Luke Manuel Marc Marco Margaret Maria Marie Mark Markus Martin Mary Matthew Max Michael Michel Miguel Monika Nancy Nicolas "
    "Nicole Olivia Pablo Patricia Paul Pedro Peter Petra Philip Pierre Rachel Raul Rebecca Richard Robert Rosa Ruth Sabine Samuel Sandra Sara Sarah Sergio Simon Sofia Sophie Stefan Stephen Steven Susan Sven Teresa Thomas Tim Tom Ursula Victor Walter William Wolfgang".split()
)
FOR = re.compile(r"e-?mail|contact|tel|phone|call|mobile|card|visa|account|iban|ssn|social|address|name|write to", re.I)
AGAINST = re.compile(r"version|isbn|order|sku|part|serial|build|ratio|score|page|§|#", re.I)
LABELERS = 6
SAMPLE_SPANS = 3000
DIMENSIONS = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(start, end, kind) of the base matches that hold and of those that fail."""
    good, failed, end = [], [], 0
    if "@" in text:
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                good.append((start, end, "email"))
    for m in IP.finditer(text):
        parts = m.group().split(".")
        (good if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in parts) else failed).append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                good.append((*m.span(), "card"))
            elif 12 <= len(d) <= 19:
                failed.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            (good if 10 <= len(_digits(m.group())) <= 15 else failed).append((*m.span(), "phone"))
    return good, failed


def wide_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    for kind, pattern in WIDE:
        if kind != "email" or "at)" in text or "at]" in text:
            found += [(*m.span(), kind) for m in pattern.finditer(text)]
    for title in TITLES:
        at = text.find(title)
        while at >= 0:
            m = TITLED.match(text, at + len(title))
            if m:
                found.append((*m.span(), "name"))
            at = text.find(title, at + 1)
    taken = {a for a, _, kind in found if kind == "name"}
    found += [(*m.span(), "name") for m in GIVEN.finditer(text) if m[1] in GIVEN_NAMES and m.start() not in taken]
    return found


def _iban_holds(value: str) -> bool:
    v = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def votes(text: str, start: int, end: int, kind: str, holds: bool) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, 2 against, 0 silent."""
    value, d = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40) : start]
    strict = {"iban": lambda: _iban_holds(value), "ssn": lambda: d[:3] not in ("000", "666") and d[:3] < "900" and d[3:5] != "00" and d[5:] != "0000", "phone": lambda: holds or d[0] in "23456789"}
    ok = strict[kind]() if kind in strict else holds
    listed = {
        "email": lambda: value.rsplit(".", 1)[-1].lower() in TOP_DOMAINS or "dot" in value,
        "phone": lambda: d.startswith(CALLING_CODES) if value[0] == "+" else None,
        "iban": lambda: value[:2] in IBAN_COUNTRIES,
        "name": lambda: value.split()[0] in GIVEN_NAMES,
    }
    known = listed[kind]() if kind in listed else None
    edge = (text[start - 1 : start] + " ")[0].isalnum() or (text[end : end + 1] + " ")[0].isalnum()
    return (
        1 if ok else 2,
        0 if known is None else 1 if known else 2,
        1 if FOR.search(before) else 0,
        2 if AGAINST.search(before) else 0,
        2 if d and len(set(d)) < 3 else 0,
        2 if edge else 1,
    )


def pattern_of(kind: str, vote: tuple[int, ...], length: int) -> int:
    code = KINDS.index(kind)
    for v in vote:
        code = code * 3 + v
    return code * 4 + min(3, length // 12)


def _decoded(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and votes of pattern codes."""
    code, each = patterns // 4, []
    for _ in range(LABELERS):
        each.append(code % 3)
        code = code // 3
    return code, np.stack(each[::-1], 1)


def reliabilities(kind: np.ndarray, vote: np.ndarray, n: np.ndarray, steps: int = 50, pooled: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation: the posterior of each pattern and table[kind, labeler, truth, vote].

    It starts from majority votes. A kind's table starts from that of all kinds together, which counts as `pooled` spans, so rare kinds lean on
    the others; a smoothing count of one keeps every chance above zero.
    """
    ahead = (vote == 1).sum(1) - (vote == 2).sum(1)
    post = np.clip(0.5 + 0.2 * ahead, 0.05, 0.95)
    table = np.zeros((len(KINDS), LABELERS, 2, 3))
    for _ in range(steps):
        share = np.stack((n * (1 - post), n * post))
        for k in range(LABELERS):
            whole = np.stack([np.bincount(vote[:, k], share[t], 3) for t in (0, 1)]) + 1
            whole /= whole.sum(1, keepdims=True)
            for j in range(len(KINDS)):
                own = kind == j
                mine = pooled * whole + np.stack([np.bincount(vote[own, k], share[t, own], 3) for t in (0, 1)])
                table[j, k] = mine / mine.sum(1, keepdims=True)
        prior = np.array([(1 + share[1, kind == k].sum()) / (2 + n[kind == k].sum()) for k in range(len(KINDS))])
        odds = np.log(prior[kind]) - np.log(1 - prior[kind])
        for k in range(LABELERS):
            odds += np.log(table[kind, k, 1, vote[:, k]]) - np.log(table[kind, k, 0, vote[:, k]])
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return post, table


SHAPES = str.maketrans("".join(map(chr, range(128))), "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in map(chr, range(128))))
RUNS = re.compile(r"(.)\1*", re.S)
WORD = re.compile(r"[^\W\d_]+")
WIDTH = 14  # features of a span


def span_features(text: str, start: int, end: int, kind: str, holds: bool) -> list[int]:
    """WIDTH hashed features of a span: its shape, length, digits, ends and checksum, and the words and characters around it."""
    value = text[start:end]
    shape = value[:80].translate(SHAPES)
    digits = [c for c in value if "0" <= c <= "9"]
    before, after = WORD.findall(text[max(0, start - 32) : start].lower()), WORD.search(text[end : end + 24].lower())
    told = (
        "", RUNS.sub(r"\1", shape), shape[:8], shape[-6:], str(len(value) // 4), str(len(digits)), str(len(set(digits))), re.split(r"[ .@-]", value)[-1].lower()[:12], value[:3].lower(),
        before[-1] if before else "", before[-2] if len(before) > 1 else "", after[0] if after else "", text[max(0, start - 1) : start].translate(SHAPES) + "|" + text[end : end + 1].translate(SHAPES), str(holds),
    )
    return [xxhash.xxh32_intdigest(f"{kind}{k}{t}".encode("utf-8", "surrogatepass")) % DIMENSIONS for k, t in enumerate(told)]


def span_classifier(features: np.ndarray, post: np.ndarray, times: np.ndarray, steps: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model of the posteriors, by gradient steps (Adam) from zero; row k counts times[k] times."""
    w, one, two = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    if not len(features):
        return w
    share = times / times.sum()
    for step in range(1, steps + 1):
        err = share * (post - chances(w, features))
        grad = np.bincount(features.ravel(), np.repeat(err, features.shape[1]), DIMENSIONS) - l2 * w
        one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad**2
        w = w + 0.1 * (one / (1 - 0.9**step)) / (np.sqrt(two / (1 - 0.999**step)) + 1e-8)
    return w


def chances(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(weights[features].sum(1), -30, 30)))


SPAN = "start:int,end:int,kind:string"
COUNTS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long"
SCANNED = f"{COUNTS}, base array<struct<{SPAN}>>, others array<struct<{SPAN}>>, patterns array<int>, features array<array<int>>"
ORDER = {k: n for n, k in enumerate(KINDS)}


def _listed(rows: list[list[tuple[int, int, str]]]) -> pa.Array:
    """Arrays of (start, end, kind), built column by column."""
    flat = [s for row in rows for s in row]
    columns = [pa.array([s[k] for s in flat], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["start", "end", "kind"]))


def _scan(batches):
    """Base spans and other candidates; patterns and features of the base spans, then of the others."""
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base", "others", "patterns", "features"]
    for batch in batches:
        n, base, others, patterns, features = ([], [], [], []), [], [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            good, failed = base_spans(text)
            good.sort(key=lambda s: (s[0], ORDER[s[2]]))
            rest, broken = failed + wide_spans(text), set(failed)
            for k, kind in enumerate(BASE):
                n[k].append(sum(s[2] == kind for s in good))
            base.append(good)
            others.append(rest)
            all_spans = [(*s, True) for s in good] + [(a, b, k, k in ("email", "name") or (a, b, k) not in broken) for a, b, k in rest]
            patterns.append([pattern_of(k, votes(text, a, b, k, holds), b - a) for a, b, k, holds in all_spans])
            features.append([span_features(text, a, b, k, holds) for a, b, k, holds in all_spans])
        kind = pa.list_(pa.list_(pa.int32()))
        columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], _listed(base), _listed(others), pa.array(patterns, pa.list_(pa.int32())), pa.array(features, kind)]
        yield pa.record_batch(columns, names)


def trained_weights(scanned: DataFrame, sample: int = SAMPLE_SPANS) -> np.ndarray:
    """The classifier's weights: posteriors from the pattern counts of all spans, features from about `sample` spans of each kind."""
    each = scanned.select("doc_id", F.posexplode("patterns").alias("k", "pattern"))
    counted = each.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # kinds x votes x lengths at most
    if not counted:
        return np.zeros(DIMENSIONS)
    patterns, n = np.array([r["pattern"] for r in counted]), np.array([r["n"] for r in counted], float)
    kind, vote = _decoded(patterns)
    post, _ = reliabilities(kind, vote, n)
    of_kind = np.bincount(kind, n, len(KINDS))
    share = F.lit(0.0)
    per_kind = 4 * 3**LABELERS
    for k, total in enumerate(of_kind.tolist()):
        share = F.when(F.floor(F.col("pattern") / per_kind) == k, min(1.0, sample / max(total, 1))).otherwise(share)
    drawn = F.pmod(F.xxhash64("doc_id", "k", "pattern"), F.lit(1 << 30)) < share * (1 << 30)
    spans = scanned.select("doc_id", F.posexplode(F.arrays_zip("patterns", "features")).alias("k", "s")).select("doc_id", "k", F.col("s.patterns").alias("pattern"), F.col("s.features").alias("x"))
    rows = spans.where(drawn).groupBy("pattern", "x").agg(F.count("*").alias("n")).orderBy("pattern", "x").toArrow()  # about `sample` rows for each kind
    if not rows.num_rows:
        return np.zeros(DIMENSIONS)
    x = np.array(rows["x"].to_pylist(), np.int64).reshape(-1, WIDTH)
    own = rows["pattern"].to_numpy()
    return span_classifier(x, post[np.searchsorted(patterns, own)], rows["n"].to_numpy().astype(float))


def accepted(base: list[tuple[int, int]], others: list[tuple[int, int, str]], chance: list[float], least: float) -> list[tuple[int, int, str]]:
    """The surest candidates that touch no base span or each other, by start."""
    starts, ends = [], []  # taken stretches, disjoint and in order
    for a, b in sorted(base):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    mine = []
    for _, (a, b, kind) in sorted(((-c, s) for c, s in zip(chance, others, strict=True) if c >= least), key=lambda x: (x[0], x[1][0], ORDER[x[1][2]])):
        at = bisect_left(starts, b)
        if at == 0 or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            mine.append((a, b, kind))
    return sorted(mine, key=lambda s: (s[0], ORDER[s[2]]))


def personal_spans(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, n_email, n_ip, n_card, n_phone, base, added).

    base and added are arrays of (start, end, kind) by start, then kind: the base spans, and accepted candidates that touch no base span or each
    other (the surer first). A null or empty text has none. Rows with null or repeated ids are each scanned.
    Other columns are ignored. A text's time grows with its length and its number of candidates alone.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = staged(docs.mapInArrow(_scan, SCANNED), "scanned")
    weights = trained_weights(scanned)

    def decide(batches):
        for batch in batches:
            added = []
            for base, others, features in zip(*(batch.column(c).to_pylist() for c in ("base", "others", "features")), strict=True):
                own = np.array(features[len(base) :], np.int64).reshape(-1, WIDTH)
                chance = chances(weights, own).tolist() if len(own) else []
                added.append(accepted([(s["start"], s["end"]) for s in base], [(s["start"], s["end"], s["kind"]) for s in others], chance, least))
            kept = [batch.column(c) for c in ("doc_id", *[f"n_{k}" for k in BASE], "base")]
            yield pa.record_batch([*kept, _listed(added)], ["doc_id", *[f"n_{k}" for k in BASE], "base", "added"])

    return scanned.mapInArrow(decide, f"{COUNTS}, base array<struct<{SPAN}>>, added array<struct<{SPAN}>>")


def digest(spans: DataFrame) -> DataFrame:
    """The columns of op1 from personal_spans(), and n_spans, the number of all spans."""

    def joined(base: list, added: list) -> str:
        return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(base + added, key=lambda s: (s["start"], ORDER[s["kind"]])))

    def run(batches):
        for batch in batches:
            base, added = batch.column("base").to_pylist(), batch.column("added").to_pylist()
            sha = [hashlib.sha256(joined(x, []).encode()).hexdigest() for x in base]
            kept = [batch.column(c) for c in ("doc_id", *[f"n_{k}" for k in BASE])]
            told = pa.array([joined(x, y) for x, y in zip(base, added, strict=True)], pa.string())
            n = pa.array([len(x) + len(y) for x, y in zip(base, added, strict=True)], pa.int64())
            yield pa.record_batch([*kept, pa.array(sha), told, n], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_spans"])

    return spans.mapInArrow(run, f"{COUNTS}, base_sha256 string, spans string, n_spans long")
