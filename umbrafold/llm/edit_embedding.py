"""Document fingerprints by randomised edit embedding.

A shared random walk reads a text: at step j it writes the character under its pointer and then moves on by h(j, character), which is 0 or
1 and the same for all texts. Texts at a small edit distance fall into step again after each edit, so their
outputs differ in few steps (the Hamming distance). The fingerprint keeps the outputs at fixed random steps, SAMPLES
in each octave of steps (the last OCTAVES that the text reaches, each of which weighs as many steps as it spans), one hexadecimal digit each.
The likeness of two fingerprints is the share of steps at which the outputs agree, corrected for chance.

Near-duplicates are found by banding these samples and verified by the fingerprints; documents that verified pairs connect form a class.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import column_bytes, joined_apart, mixed, slices, staged
from umbrafold.llm.components import connected_components

SAMPLES = 48
OCTAVES = 5
CHANCE = 0.09  # of two unrelated characters to have one digit
PERIOD = 4096
SEED = 20240501

_random = np.random.default_rng(SEED)
#: Whether the pointer moves, by step modulo PERIOD and code of the character.
MOVES = _random.integers(0, 2, (PERIOD, 256), dtype=np.int64)
#: A character's digit, 1 to 15; 0 stands for the end of the text.
DIGITS = np.concatenate(([0], _random.integers(1, 16, 255))).astype(np.uint8)
_FIRST = 6  # steps below 2 ** _FIRST are all sampled


def sampled_steps(octave: int) -> np.ndarray:
    """The sampled steps from 2 ** octave on, below twice that; for the first octave all steps from 0 on."""
    if octave == _FIRST:
        return np.arange(1 << (_FIRST + 1))
    draw = np.random.default_rng((SEED, octave))
    return np.sort(draw.choice(1 << octave, SAMPLES, replace=False) + (1 << octave))


def codes(text: str) -> np.ndarray:
    """One byte for each character, from 1 on."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (1 + (points * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(255)).astype(np.uint8)


def walk(texts: list[np.ndarray]) -> list[dict[int, np.ndarray]]:
    """For each text and octave the digits at the sampled steps; all texts take each step together.

    A text leaves when its pointer has passed its end; what it would write from then on is the digit 0.
    """
    out: list[dict[int, np.ndarray]] = [{} for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes + PERIOD // 16)))[:-1]  # zeros behind each text
    line = np.zeros(int(starts[-1] + sizes[-1]) + PERIOD // 16 + 1 if len(texts) else 1, np.uint8)
    for t, at in zip(texts, starts.tolist(), strict=True):
        line[at : at + len(t)] = t
    live = np.flatnonzero(sizes > 0)
    at, end = starts[live], (starts + sizes)[live]
    octave, step, flat = _FIRST, 0, MOVES.ravel()
    while len(live):
        wanted = sampled_steps(octave)
        upto = 2 << octave
        found = np.zeros((len(texts), len(wanted)), np.uint8)
        taken = 0
        present = live
        while step < upto and len(live):
            for step in range(step, min(upto, step + PERIOD // 16)):
                c = line[at]
                if taken < len(wanted) and wanted[taken] == step:
                    found[live, taken] = DIGITS[c]
                    taken += 1
                at += flat[(step % PERIOD) * 256 + c.astype(np.int64)]
            step += 1
            stay = at < end
            if not stay.all():
                live, at, end = live[stay], at[stay], end[stay]
        for k in present.tolist():
            out[k][octave] = found[k]
            out[k].pop(octave - OCTAVES, None)
        octave += 1
        step = upto
    return out


HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def fingerprint(n_chars: int, octaves: dict[int, np.ndarray]) -> str:
    """The length, then octave:digits of each kept octave."""
    return "|".join([str(n_chars), *[f"{k}:{HEX[v].tobytes().decode()}" for k, v in sorted(octaves.items())]])


def _parsed(value: str) -> tuple[int, dict[int, np.ndarray]]:
    size, *rest = value.split("|")
    return int(size), {int(k): np.frombuffer(v.encode(), np.uint8) for k, v in (x.split(":") for x in rest)}


def likeness(x: str, y: str) -> float:
    """0 to 1: the share of steps that agree, by octave, corrected for chance. Equal fingerprints, also of empty texts, have 1."""
    if x == y:
        return 1.0
    (nx, a), (ny, b) = _parsed(x), _parsed(y)
    if not a or not b:
        return 0.0
    agree = total = 0.0
    for k in range(max(min(a), min(b)), max(max(a), max(b)) + 1):
        own, other = a.get(k), b.get(k)
        digits = own if own is not None else other
        width = (2 << k) if k == _FIRST else (1 << k)
        inside = digits != 48 if other is None or own is None else (own != 48) | (other != 48)
        weight = width / len(digits)
        total += weight * inside.sum()
        if own is not None and other is not None:
            agree += weight * ((own == other) & inside).sum()
    return float(min(1.0, max(0.0, (agree / total - CHANCE) / (1 - CHANCE)))) if total else float(nx == ny)


def edited(text: str, following: str) -> str:
    """The last quarter of the text's characters replaced by as many first ones of the following text, or all."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


GROUP_CHARS = 12_000_000
PER_RANGE = 50
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
SENT = "doc_id long, packed binary, tie long, key long, bucket int, ahead boolean, class_id long"
NO_ID = -(1 << 63)


def _prints_of(texts: list[str]) -> list[str]:
    """The fingerprint of each text; equal texts are walked once."""
    at = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    prints = [fingerprint(len(t), f) for t, f in zip(at, walk([codes(t) for t in at]), strict=True)]
    return [prints[at[t]] for t in texts]


def own_fingerprints(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, fingerprint) without a shuffle. A null text is empty; rows with a null doc_id are left out."""

    def run(batches):
        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids.append(i)
                texts.append(text or "")
                chars += len(texts[-1])
                if chars > GROUP_CHARS or len(ids) >= 20_000:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(_prints_of(texts), pa.string())], ["doc_id", "fingerprint"])
                    ids, texts, chars = [], [], 0
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(_prints_of(texts), pa.string())], ["doc_id", "fingerprint"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    return docs.mapInArrow(run, "doc_id long, fingerprint string")


def _compare(rows: list[tuple[int | None, int | None, str, str]]) -> pa.RecordBatch:
    """rows: (doc_id, class_id, text, following text)."""
    texts = [x for _, _, text, following in rows for x in (text, edited(text, following), following)]
    prints = _prints_of(texts)
    own, new, after = (prints[k::3] for k in range(3))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in texts[1::3]]
    columns = [
        pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int64()), pa.array(sha, pa.string()), pa.array(own, pa.string()), pa.array(new, pa.string()),
        pa.array([likeness(x, y) for x, y in zip(own, new, strict=True)], pa.float64()), pa.array([likeness(x, y) for x, y in zip(own, after, strict=True)], pa.float64()),
        pa.array([r[1] for r in rows], pa.int64()),
    ]
    return pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"])


def _in_order(batches):
    """SENT rows by bucket and key, a document's class before its text; the row ahead of a bucket's end only serves as the next text."""
    last, ready, chars, known = None, [], 0, (None, None)
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for i, packed, key, bucket, ahead, cls in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "key", "bucket", "ahead", "class_id")), strict=True):
            if packed is None:
                known = (key, cls)
                continue
            text = unpack(packed).decode()
            if last is not None and last[3] == bucket and not last[4]:
                ready.append((last[0], last[1], last[2], text))
                chars += len(last[2])
            own = i if i is None or known[0] != i else known[1]
            last = (i, own, text, bucket, ahead)
            if chars > GROUP_CHARS or len(ready) >= 20_000:
                yield _compare(ready)
                ready, chars = [], 0
    if ready:
        yield _compare(ready)


def fingerprints(documents: DataFrame, buckets: int = 0, classes: DataFrame | None = None) -> DataFrame:
    """documents(doc_id, text, ...) to RESULT's columns: fingerprints of each text and of its edited text, and likenesses.

    The next document follows by doc_id, then a hash of the text; the last one's is the first. A null text is empty. Rows with a null doc_id come first. Repeated rows
    are documents of their own. Documents are dealt by ranges of doc_id; each range also gets the row after its end. Texts are compressed for that way.
    With classes(doc_id, class_id), as of near_classes(), class_id is the document's class (itself where none is listed, null without doc_id); without, it is left out.
    Other columns are ignored.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(NO_ID).cast("long"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", key)
    n = docs.count()
    buckets = buckets or min(50_000, max(1, n // 2000))
    # the ranges' ends come from a share of the ids, about PER_RANGE a range; they decide on balance alone
    share = F.pmod(F.xxhash64("key"), F.lit(max(1, n // (PER_RANGE * buckets)))) == 0
    ids = np.sort(docs.where(share).select("key").distinct().toArrow()["key"].to_numpy()) if buckets > 1 else np.zeros(0, np.int64)
    cuts = np.unique(ids[np.arange(1, buckets) * len(ids) // buckets]) if len(ids) else ids
    in_range = F.pandas_udf(lambda keys: _ranges(cuts, keys), "int")
    # the first row of each bucket also goes behind the end of the one before; the very first behind the last
    placed = docs.select("key", in_range("key").alias("bucket"))
    order = sorted((r["bucket"], r["first"]) for r in placed.groupBy("bucket").agg(F.min("key").alias("first")).collect())  # a row for each bucket
    firsts = np.array([f for _, f in order], np.int64)
    before = [order[k - 1][0] for k in range(len(order))]

    def send(batches):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            keys = batch.column("key").to_numpy()
            own = np.searchsorted(cuts, keys, "right")
            at = np.minimum(np.searchsorted(firsts, keys), len(firsts) - 1)
            texts = column_bytes(batch, "text")
            packed, ties = [pack(t) for t in texts], [xxhash.xxh64_intdigest(t) - (1 << 63) for t in texts]
            copies = np.flatnonzero(firsts[at] == keys)
            for rows, bucket, ahead in ((np.arange(len(keys)), own, False), (copies, np.array([before[k] for k in at[copies].tolist()], np.int64), True)):
                take = rows.tolist()
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(rows)), pa.array([packed[k] for k in take], pa.binary()), pa.array([ties[k] for k in take], pa.int64()),
                     pa.array(keys[rows]), pa.array(bucket.astype(np.int32)), pa.array([ahead] * len(rows), pa.bool_()), pa.nulls(len(rows), pa.int64())],
                    ["doc_id", "packed", "tie", "key", "bucket", "ahead", "class_id"],
                )

    dealt = docs.mapInArrow(send, SENT)
    if classes is not None:
        others = classes.where("class_id <> doc_id").select(F.col("doc_id").alias("key"), "class_id")
        nothing = F.lit(None)
        told = others.select(nothing.cast("long").alias("doc_id"), nothing.cast("binary").alias("packed"), nothing.cast("long").alias("tie"), "key", in_range("key").alias("bucket"), F.lit(False).alias("ahead"), "class_id")
        dealt = dealt.union(told)
    dealt = dealt.repartition(max(1, len(order)), "bucket")
    # nulls come first, so a document's class stands before its text
    result = dealt.sortWithinPartitions("bucket", "ahead", "key", "tie").mapInArrow(_in_order, RESULT)
    return result if classes is not None else result.drop("class_id")


def _ranges(cuts: np.ndarray, keys: pd.Series) -> pd.Series:
    return pd.Series(np.searchsorted(cuts, keys.to_numpy(np.int64), "right").astype(np.int32))


LEAST = 0.75
BANDED_OCTAVES = 3
ROWS = 8  # unrelated texts agree in that many digits with a chance of about CHANCE ** ROWS, 4 in a thousand million
PART = 1000
MARKED = 2000  # fingerprints that are marked together
BLOCK = 512


@functools.cache
def _draws(octave: int) -> np.ndarray:
    """Draws of ROWS of an octave's samples each: runs of neighbours, so that an octave half reached has whole ones; over the few steps of the first octave spread ones."""
    n = len(sampled_steps(octave)) // ROWS
    return np.arange(n * ROWS).reshape(ROWS, n).T if octave == _FIRST else np.arange(n * ROWS).reshape(n, ROWS)


MARKS = "doc_id long, fingerprint string, reach int, last long, before long, bands array<long>"
SEEN = 64  # samples of an octave that a sketch has a bit for, at most


def marked(ids: pa.Array, prints: list[str]) -> pa.RecordBatch:
    """MARKS of fingerprints: a sketch and keys (bands). All of the prints are worked on together, octave by octave.

    Bands are the fingerprint itself and the draws of its last BANDED_OCTAVES octaves. Empty texts have none.
    Draws that reach past the text's end say little and are left out, where more than two of a draw's digits do in the first octave; so texts of fewer than about 90 steps only meet their copies.
    The sketch: the last octave and how many of its samples the text reaches (256 * octave + number), and of this octave and the one before the last bit of each digit, up to SEEN samples.
    """
    n = len(prints)
    parts: dict[int, tuple[list[int], list[str]]] = {}
    top = np.zeros(n, np.int64)
    for i, value in enumerate(prints):
        for x in value.split("|")[1:]:
            k, digits = x.split(":")
            rows, found = parts.setdefault(int(k), ([], []))
            rows.append(i)
            found.append(digits)
            top[i] = int(k)  # in ascending order
    some = np.flatnonzero(top)
    owner, bands = [some], [np.array([xxhash.xxh64_intdigest(prints[i]) for i in some.tolist()], np.uint64)]
    reach, bits = np.zeros(n, np.int32), np.zeros((2, n), np.uint64)
    for k, (rows, found) in parts.items():
        rows, digits = np.array(rows), np.frombuffer("".join(found).encode(), np.uint8).reshape(len(found), -1)
        for back in (0, 1):
            of = top[rows] == k + back
            seen = (digits[of, :SEEN] & 1).astype(np.uint64)
            bits[back, rows[of]] = (seen << np.arange(seen.shape[1], dtype=np.uint64)).sum(1, dtype=np.uint64)
        last = top[rows] == k
        reach[rows[last]] = 256 * k + (digits[last] != 48).sum(1)
        near = top[rows] < k + BANDED_OCTAVES
        rows, drawn = rows[near], np.ascontiguousarray(digits[near][:, _draws(k)])
        told = (drawn == 48).sum(2) <= (2 if k == _FIRST else 0)
        salts = mixed(np.arange(1, drawn.shape[1] + 1, dtype=np.uint64) + np.uint64(k << 32))
        owner.append(np.repeat(rows, told.sum(1)))
        bands.append(mixed(drawn.view("<u8")[..., 0] ^ salts)[told])
    owner, bands = np.concatenate(owner), np.concatenate(bands)
    order = np.argsort(owner, kind="stable")
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[order].view(np.int64)))
    columns = [ids, pa.array(prints, pa.string()), pa.array(reach), *(pa.array(x.view(np.int64)) for x in bits), lists]
    return pa.record_batch(columns, [c.split()[0] for c in MARKS.split(", ")])


def at_most(x: tuple[np.ndarray, np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """What the likeness() of two texts that are not empty can't exceed, from their sketches (reach, last, before) alone.

    The longer text's last two octaves have at least half of the steps that are compared. There, digits whose bits differ do, and so do those that only one of the texts reaches; all others are taken to agree.
    """
    longer = x[0] >= y[0]
    (rx, x_last, x_before), (ry, y_last, y_before) = ([np.where(c, u, v) for u, v in zip(p, q, strict=True)] for c, p, q in ((longer, x, y), (~longer, x, y)))
    kx, cx, ky, cy = rx >> 8, rx & 255, ry >> 8, ry & 255
    size = np.where(kx == _FIRST, cx, 2.0**kx * (1 + cx / SAMPLES))
    first = np.maximum(kx - OCTAVES + 1, _FIRST)
    total = size - np.where(first > _FIRST, 2.0**first, 0)

    def differ(p: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        n = np.minimum(n, SEEN)
        told = np.where(n > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (SEEN - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))
        return np.bitwise_count((p.view(np.uint64) ^ q.view(np.uint64)) & told).astype(np.int64)

    same, full = kx == ky, np.where(kx - 1 == _FIRST, 2 << _FIRST, SAMPLES)
    at_last = np.where(same, differ(x_last, y_last, cy) + cx - cy, cx)
    reached = np.where(same, full, np.where(ky == kx - 1, cy, 0))
    at_before = np.where(kx == _FIRST, 0, differ(x_before, np.where(same, y_before, y_last), reached) + full - reached)
    weight = [np.where(k == _FIRST, 1.0, 2.0**k / SAMPLES) for k in (kx, kx - 1)]
    share = 1 - (weight[0] * at_last + weight[1] * at_before) / np.maximum(total, 1)
    return (share - CHANCE) / (1 - CHANCE)


def _sketch(batch: pa.RecordBatch, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(batch.column(prefix + c).to_numpy() for c in ("reach", "last", "before"))


def likenesses(prints: list[str], upto: int, start: int):
    """For each of the first `upto` fingerprints, none of them empty: its position, the next one's (`start` at least), and its likeness() to all from there on."""
    parsed = [_parsed(p)[1] for p in prints]
    low = np.array([min(x) for x in parsed])
    digits = {}
    for k in sorted(set().union(*parsed)):
        none = np.full(len(next(x[k] for x in parsed if k in x)), 48, np.uint8)
        digits[k] = np.stack([x.get(k, none) for x in parsed])
    for i in range(upto):
        j = max(i + 1, start)
        agree, total = np.zeros(len(prints) - j), np.full(len(prints) - j, 1e-9)
        for k, d in digits.items():
            inside = ((d[i] != 48) | (d[j:] != 48)) & (k >= np.maximum(low[i], low[j:]))[:, None]
            weight = ((2 << k) if k == _FIRST else (1 << k)) / d.shape[1]
            total += weight * inside.sum(1)
            agree += weight * ((d[i] == d[j:]) & inside).sum(1)
        yield i, j, np.clip((agree / total - CHANCE) / (1 - CHANCE), 0, 1)


PAIRS = "doc_id long, near_id long, likeness double"


def _pairs(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "near_id", "likeness"])


def _across(least: float):
    """Rows in order of band, pair of blocks and block to near pairs of different classes, one of each block where the blocks are two.

    A pair is given only where those before it in its group don't connect its classes, so a group gives fewer pairs than it has rows.
    """

    def near(place: list | None, rows: list[tuple]):
        if len({cls for _, cls, _, _ in rows}) < 2:
            return
        top = {cls: cls for _, cls, _, _ in rows}

        def class_of(c: int) -> int:
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        in_lo = sum(block == place[1] for _, _, block, _ in rows)
        for i, start, near_by in likenesses([r[3] for r in rows], in_lo, 0 if place[1] == place[2] else in_lo):
            for j in (np.flatnonzero(near_by >= least) + start).tolist():
                (x, a, *_), (y, b, *_) = rows[i], rows[j]
                if (a := class_of(a)) != (b := class_of(b)):
                    top[max(a, b)] = min(a, b)
                    yield max(x, y), min(x, y), float(near_by[j - start])

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for *place, i, cls, block, value in zip(*(batch.column(c).to_pylist() for c in ("band", "lo", "hi", "doc_id", "class", "block", "fingerprint")), strict=True):
                if place != at:
                    yield _pairs(list(near(at, rows)))
                    at, rows = place, []
                rows.append((i, cls, block, value))
        yield _pairs(list(near(at, rows)))

    return run


MEETING = "band long, lo int, hi int, doc_id long, class long, block int"


def _hopeful(least: float, at_once: int = 1 << 19):
    """Rows in order of band, pair of blocks and block to those that by their sketches may be near one of another class, of the other block where the blocks are two."""
    names = [c.split()[0] for c in MEETING.split(", ")]

    def kept(table: pa.Table) -> pa.RecordBatch:
        batch = table.combine_chunks().to_batches()[0]
        sketch, (band, lo, hi, _, cls, block) = _sketch(batch), (batch.column(c).to_numpy() for c in names)
        edges = np.flatnonzero((band[1:] != band[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        sizes = np.diff(np.concatenate(([0], edges, [len(band)])))
        others = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(band)) - 1  # rows after each in its group
        upto, keep, at = np.cumsum(others), np.zeros(len(band), bool), 0
        while at < len(band):  # about at_once pairs, each row's together
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
            n = others[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            met = np.flatnonzero((cls[i] != cls[j]) & ((lo[i] == hi[i]) | (block[i] != block[j])))
            i, j = i[met], j[met]
            near = at_most(tuple(c[i] for c in sketch), tuple(c[j] for c in sketch)) >= least - 1e-9
            keep[i[near]] = keep[j[near]] = True
            at = to
        return batch.select(names).filter(pa.array(keep))

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            place = [table.column(c).to_numpy() for c in names[:3]]
            own = np.flatnonzero(np.any([p != p[-1] for p in place], axis=0))  # the last group may go on in the next batch
            whole = int(own[-1]) + 1 if len(own) else 0
            rest = table.slice(whole)
            if whole:
                yield kept(table.slice(0, whole))
        if rest is not None:
            yield kept(rest)

    return run


def near_classes(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """Classes (doc_id, class_id) of the documents that near_pairs() connects; class_id is the smallest doc_id of the class. Documents without a pair are not listed."""
    pairs = near_pairs(prints, least)
    return connected_components(pairs.select(F.col("doc_id").alias("u"), F.col("near_id").alias("v"))).select(F.col("id").alias("doc_id"), F.col("component").alias("class_id"))


def near_pairs(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """Pairs (doc_id, near_id, likeness), likeness at least `least`, from (doc_id, fingerprint): documents that share a band, verified by whole fingerprints.

    Each document meets the smallest doc_id of each of its bands first. Where a band's documents are not in one class then, those of different classes
    meet as well, in pairs of blocks of about BLOCK. Sketches tell beforehand which of those that meet can't be near, as their bound at_most() is below `least`: most bands are shared by chance,
    ever more of them as documents do, and only the ids and sketches of these are moved. So every near pair that shares a band is given or connected by pairs that are; a family of copies needs a pair each.
    Two texts whose likeness is s all over, a share a = s + 0.09 (1 - s) of equal digits, share one of the about 15 bands of a text with a chance of
    1 - (1 - a ** ROWS) ** 15: 0.86 at 0.75, 0.97 at 0.8, more above and where edits lie together; copies always do. Empty texts have no bands; rows with a null doc_id are left out; the rows of a repeated doc_id are one document.
    """

    def marks_of(batches):
        for batch in batches:
            for part in slices([batch], MARKED):
                yield marked(part.column("doc_id"), part.column("fingerprint").to_pylist())

    known = prints.select("doc_id", "fingerprint").where("doc_id IS NOT NULL").mapInArrow(marks_of, MARKS)
    marks = staged(known.where("reach > 0"), "marks")
    known, sketches = marks.select("doc_id", "fingerprint"), marks.select("doc_id", "reach", "last", "before")
    keys = marks.select("doc_id", F.explode("bands").alias("band"))
    first = staged(keys.groupBy("band").agg(F.min("doc_id").alias("near_id"), F.count("*").alias("n")).where("n > 1"), "first")
    total = first.agg(F.sum("n")).first()[0] or 0
    star = joined_apart(keys, "band", first, "n", total).where("near_id IS NOT NULL")
    star = staged(star.select("band", "doc_id", "near_id", (1 + F.col("n") / PART).cast("int").alias("parts")), "bands")

    asked = star.where("doc_id <> near_id").groupBy("doc_id", "near_id").agg(F.max("parts").alias("parts"))
    asked = staged(asked.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int")), "asked")

    def with_both(asked: DataFrame, values: DataFrame) -> DataFrame:
        """values' columns for doc_id, and for near_id with other_ before their names; an end that many ask is split in parts."""
        other = values.toDF(*("near_id" if c == "doc_id" else f"other_{c}" for c in values.columns))
        ends = asked.groupBy("near_id").agg(F.max("parts").alias("parts")).join(other, "near_id").distinct()
        ends = ends.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        return asked.join(values, "doc_id").join(ends, ["near_id", "part"])

    def hopeful(batches):
        for batch in batches:
            near = at_most(_sketch(batch), _sketch(batch, "other_")) >= least - 1e-9
            yield batch.select(["doc_id", "near_id", "parts", "part"]).filter(pa.array(near))

    asked = staged(with_both(asked, sketches).mapInArrow(hopeful, "doc_id long, near_id long, parts int, part int"), "hopeful")

    def verified(batches):
        for batch in batches:
            values = (batch.column(c).to_pylist() for c in ("doc_id", "near_id", "fingerprint", "other_fingerprint"))
            scored = [(i, j, likeness(x, y)) for i, j, x, y in zip(*values, strict=True)]
            yield _pairs([r for r in scored if r[2] >= least])

    wanted = known.join(asked.select("doc_id").union(asked.select("near_id")).distinct(), "doc_id", "left_semi")
    pairs = with_both(asked, staged(wanted, "known")).mapInArrow(verified, PAIRS)
    pairs = staged(pairs.groupBy("doc_id", "near_id").agg(F.max("likeness").alias("likeness")), "pairs")

    classes = connected_components(pairs.select(F.col("doc_id").alias("u"), F.col("near_id").alias("v"))).select(F.col("id").alias("doc_id"), "component")
    # copies of one text in one class ask once, by the smallest of them
    digests = marks.select("doc_id", F.xxhash64("fingerprint").alias("d0"), F.xxhash64(F.lit(1), "fingerprint").alias("d1"))
    asking = digests.join(classes, "doc_id").groupBy("component", "d0", "d1").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    classes = staged(classes.join(asking.withColumn("asks", F.lit(True)), "doc_id", "left"), "asking")
    member = star.select("band", "doc_id").join(classes, "doc_id", "left").where("component IS NULL OR asks").select("band", "doc_id", F.coalesce("component", "doc_id").alias("class"))
    member = staged(member, "members")
    several = member.groupBy("band").agg(F.min("class").alias("a"), F.max("class").alias("b"), ((F.count("*") + (BLOCK - 1)) / BLOCK).cast("int").alias("blocks")).where("a < b").select("band", "blocks")
    split = member.join(several, "band").join(sketches, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).cast("int"))
    meeting = split.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("band", F.least("block", "o").alias("lo"), F.greatest("block", "o").alias("hi"), "doc_id", "class", "block", "reach", "last", "before")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "block")

    # sketches first; fingerprints are moved only for those that may be near
    meeting = staged(grouped(meeting).mapInArrow(_hopeful(least), MEETING), "meeting").distinct()
    across = grouped(meeting.join(known, "doc_id").select("band", "lo", "hi", "doc_id", "class", "block", "fingerprint")).mapInArrow(_across(least), PAIRS)
    return pairs.union(staged(across.groupBy("doc_id", "near_id").agg(F.max("likeness").alias("likeness")), "across"))
