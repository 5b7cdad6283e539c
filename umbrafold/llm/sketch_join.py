"""Jaccard join of texts on word shingles by parity sketches.

Each set of shingles is XOR-hashed into a bit sketch: a shingle flips the one bit that its hash
names, so the Hamming distance of two sketches is at most the size of the sets' symmetric
difference. The sketch is cut into words of 2 ** 40 bits or more, each held as the XOR of the numbers of its set bits.
At similarity 0.75 a set of s shingles differs from a partner by at most d = floor(s / 3), so at
most d words of the sketches differ and, by the pigeonhole principle, of any d + 1 non-zero words
that come first in an order common to all sets, one is equal in both sketches. Sets whose sketch has
no more than d non-zero words share one key of their own. A second, short sketch of a few bits for
each shingle goes with each candidate and rules most of the wrong ones out by its Hamming distance.
The number of words follows the size band
(bands grow fourfold; a set close to the upper edge of its band also joins the next one).
The common order puts words that few sets hold first, by counts over the whole corpus in a table of fixed
size, which follows the number of documents; it affects cost alone, since any order gives all pairs. Candidates are verified exactly.
Of a text that occurs several times the first document alone gives keys, as long as it is the most frequent such text in its bucket of a table
of bounded size; copies beside it would only bring pairs of the same two texts again.

A word held by very many sets gathers, within each batch of rows, at one of them, so no task
receives a row per holder. These holders are compared with each other later, in blocks of bounded size, where they are
not yet in one component. Two holders that share one of the few frequent keys before this one in both their orders have met at
that key and don't meet again.

Links are counted once the components are known, as none leads out of one: a component's sets meet in pairs of blocks of
bounded size, and a task gives each set's number of links, never the pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.llm.common import AT_ONCE, column_bytes, distinct, each_bytes, mixed, shingle_hashes, signed, slices, staged, word_hashes
from umbrafold.llm.components import connected_components

LEAST_BITS, MOST_BITS = 19, 21  # of the table of counts
REPEATED = 64  # what a sketch word counts more for each holder beside others of the same batch
GATHERED = 2000  # texts whose sketch words a worker holds at once
SMALL_GROUP = 64
PARITY_LONGS = 16
LARGE, SALTS = 256, 32  # groups of more rows than LARGE are joined in SALTS parts
MOST_LARGE = 1_000_000  # groups of that kind whose keys go to every task; beyond it they are joined unsalted and adaptive execution splits them
COPIES = 1 << 18  # buckets of texts that occur several times, of each of which the most frequent one goes to every task
EARLIER = 4  # frequent keys before one's own that tell whether a pair has met already
BLOCK = 1000  # holders of a frequent key, or sets of a component, that meet as many others in one group
BLOCK_SHINGLES = 1 << 20  # of a block of a component's sets


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return distinct(shingle_hashes(word_hashes(text)))


def band_words(size: int) -> list[tuple[int, int]]:
    """(band, number of sketch words) for the bands in which a set of this size meets its partners."""
    out = []
    for s in (size, size * 4 // 3):
        band = (s.bit_length() - 1) // 2
        if not out or out[-1][0] != band:
            out.append((band, max(64, 4 ** (band + 1))))
    return out


def sketch_keys(shingles: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys of the non-zero sketch words for each band, as one array, and how many belong to the first band. numbers: mixed(shingles), which name the bits."""
    parts, first = [], 0
    for band, words in band_words(len(shingles)):
        place = shingles >> np.uint64(64 - (words.bit_length() - 1))
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        word = np.bitwise_xor.reduceat(numbers, starts)  # equal XORs of the set bits' numbers mean equal bits
        keep = word != 0
        keys = mixed(word[keep] ^ ((place[starts[keep]] + np.uint64(band << 48)) * np.uint64(0x9E3779B97F4A7C15)))
        parts.append(keys)
        first = first or len(keys)
    return (np.concatenate(parts), first) if len(parts) > 1 else (parts[0], len(parts[0]))


def short_sketch(numbers: np.ndarray) -> bytes:
    """The parity sketch as few bits, two for each shingle that the band can hold at most: bit i flips for each shingle whose number starts with i."""
    if not len(numbers):
        return b""
    bits = 2 * 4 ** ((len(numbers).bit_length() - 1) // 2 + 1)
    place = (numbers >> np.uint64(64 - (bits.bit_length() - 1))).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1).tobytes()


def parity_bits(numbers: np.ndarray) -> np.ndarray:
    """A sketch of 64 * PARITY_LONGS bits as longs, for joins."""
    place = (numbers & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=64 * PARITY_LONGS).astype(np.uint8) & 1).view(np.int64)


def sketch_distance(x: bytes, y: bytes) -> int:
    """Hamming distance, the longer sketch folded to the length of the other: no more than the sets' symmetric difference."""
    u, v = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(u) == len(v):
        return int(np.bitwise_count(u ^ v).sum())
    u, v = sorted((np.unpackbits(u), np.unpackbits(v)), key=len)
    return int((u ^ (v.reshape(len(u), -1).sum(1) & 1).astype(np.uint8)).sum())


def _digest(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


SIZES = 2 / np.log(4 / 3)  # sets that link are at most two size steps apart
PLACES = (1 << 24) - 1
_sizes_upto = np.exp((np.arange(256) + 1) / SIZES)  # of the sets of a step


def _size_step(n: int) -> int:
    return int(np.log(n) * SIZES)


def _may_link(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sets of these infos may link and share no key before this one: at 0.75 they differ in a seventh of both sizes together at most, so in no more words, and a key of a set's own may stand before them."""
    u, v = (x >> 24) & 255, (y >> 24) & 255
    place = np.maximum(x & PLACES, y & PLACES)
    return (np.abs(u - v) <= 3) & (7 * (place - 1) <= _sizes_upto[u] + _sizes_upto[v] + 1)


def _bucket(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of keys in a table of `size` counts, a power of two."""
    return (keys >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _add_counts(counts: np.ndarray, keys: np.ndarray, part: int = 250_000) -> None:
    """Sorted keys into counts by bucket, a part at a time: equal keys count REPEATED each, a single one counts one."""
    at = 0
    while at < len(keys):
        to = min(len(keys), at + part)
        if to < len(keys):
            to = int(np.searchsorted(keys, keys[to - 1], "right"))
        own = keys[at:to]
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        times = np.diff(np.append(first, len(own)))
        np.add.at(counts, _bucket(own[first], len(counts)), np.where(times > 1, times * REPEATED, 1))
        at = to


def _describe(size: int):
    """For each document its set's size, digest and short sketch; at the end of a partition, how often sketch words of each of `size` buckets occur."""

    def run(batches):
        seen, counts = set(), np.zeros(size, np.int64)
        names = ["doc_id", "n_shingles", "hi", "lo", "sketch", "parity", "buckets", "counts"]
        for batch in slices(batches, GATHERED):
            n, hi, lo, sketch, parity, held = [], [], [], [], [], []
            for text in each_bytes(batch, "text"):
                s = shingle_set(text)
                d = _digest(s)
                n.append(len(s))
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                numbers = mixed(s)
                sketch.append(short_sketch(numbers))
                parity.append(parity_bits(numbers))
                if len(s) and d not in seen:
                    seen.add(d)
                    held.append(sketch_keys(s, numbers)[0])
            if held:
                keys = np.concatenate(held)
                held.clear()
                keys.sort()
                _add_counts(counts, keys)
            none = pa.nulls(len(n), pa.list_(pa.int64()))
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sketch, pa.binary()), pa.array(parity, pa.list_(pa.int64())), none, none], names)
        full = np.flatnonzero(counts)
        for at in range(0, len(full), 1 << 16):
            one, none, some = pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int64())), full[at : at + (1 << 16)]
            yield pa.record_batch([one, one, one, one, pa.nulls(1, pa.binary()), none, pa.array([some]), pa.array([counts[some]])], names)

    return run


def _copied(first: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, by their first half, and first documents of texts that occur several times: of each of COPIES buckets the most frequent one."""
    most = F.max(F.struct("copies", "hi", "lo", "rep")).alias("most")
    rows = first.where("copies > 1 AND rep IS NOT NULL").groupBy(F.pmod(F.xxhash64("hi"), F.lit(COPIES)).alias("bucket")).agg(most)
    table = rows.select("most.hi", "most.lo", "most.rep").orderBy("hi").toArrow()  # at most COPIES rows
    return tuple(table[c].to_numpy() for c in ("hi", "lo", "rep"))


def _is_copy(doc_id: int, digest: bytes, copied: tuple[np.ndarray, np.ndarray, np.ndarray]) -> bool:
    """Whether the table names another document as the first one of the same text; one that it lacks counts as no copy."""
    hi, lo, rep = copied
    own, rest = np.frombuffer(digest, np.int64)
    at = int(np.searchsorted(hi, own))
    while at < len(hi) and hi[at] == own:
        if lo[at] == rest:
            return bool(rep[at] != doc_id)
        at += 1
    return False


def _emit(shared):
    """Sketch keys (key, doc_id, info, hub). info: the document's weight, that is how often its keys occur on average, and
    the set's step of size and the key's place in its order; hub: for a frequent key the document of the batch, that of most weight, at which its holders gather."""

    def run(batches):
        df, common, copied = shared.value
        seen = set()
        for batch in slices(batches, GATHERED):
            rows, hubs = [], {}
            for i, text in zip(batch.column("doc_id").to_pylist(), each_bytes(batch, "text"), strict=True):
                s = shingle_set(text)
                if i is None or not len(s) or (d := _digest(s)) in seen or _is_copy(i, d, copied):
                    continue
                seen.add(d)
                keys, first = sketch_keys(s, mixed(s))
                count = df[_bucket(keys, len(df))]
                differ, chosen, often, places = len(s) // 3, [], [], []
                for at, to, (band, _) in zip((0, first), (first, len(keys)), band_words(len(s)), strict=False):
                    k, c = keys[at:to], count[at:to]
                    if len(k) <= differ:
                        k, c = np.append(k, mixed(np.array([band + 1], np.uint64))), np.append(c, 0)
                    order = np.argsort((np.minimum(c, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (k >> np.uint64(24)))[: differ + 1]
                    chosen.append(k[order])
                    often.append(c[order] > common)
                    places.append(np.arange(len(order)))
                k, o = np.concatenate(chosen), np.concatenate(often)
                info = (int(np.minimum(count, 4 * common).mean()) << 32) + (_size_step(len(s)) << 24) + np.minimum(np.concatenate(places), PLACES)
                rows.append((i, signed(k[~o]), info[~o]))
                for x, y in zip(signed(k[o]).tolist(), info[o].tolist(), strict=True):
                    hubs.setdefault(x, []).append((-(y >> 32), i, y))
            keys = [r[1] for r in rows]
            docs = [np.full(len(r[1]), r[0], np.int64) for r in rows]
            infos = [r[2] for r in rows]
            to = [np.full(sum(map(len, keys)), -1, np.int64)]
            none = [np.ones(len(to[0]), bool)]
            for x, holders in hubs.items():
                hub = min(holders)[1]
                mine = np.array([h[1] for h in holders], np.int64)
                keys.append(np.full(len(mine), x, np.int64))
                docs.append(mine)
                infos.append(np.array([h[2] for h in holders], np.int64))
                to.append(np.full(len(mine), hub, np.int64))
                none.append(np.zeros(len(mine), bool))
            if keys:
                columns = [pa.array(np.concatenate(x)) for x in (keys, docs, infos)]
                out = pa.record_batch([*columns, pa.array(np.concatenate(to), mask=np.concatenate(none))], ["key", "doc_id", "info", "hub"])
                for at in range(0, out.num_rows, 500_000):
                    yield out.slice(at, 500_000)

    return run


def _meet(batches):
    """Rows sorted by key to candidate pairs (a, b) and holders of frequent keys (a, key, place)."""

    def out(a, b, key=None, info=None):
        n = len(a)
        columns = [a, b, key, None if info is None else info & PLACES]
        return pa.record_batch([pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in columns], ["a", "b", "key", "place"])

    last = [np.empty(0, np.int64)] * 3
    big: tuple | None = None  # the last key with more rows than fit a small group, and its document of most weight
    for batch in chain(batches, [None]):
        if batch is None:
            key, doc, info = last
        else:
            hub = batch.column("hub")
            hot, to = np.asarray(hub.is_valid()), np.asarray(hub.fill_null(0))
            rows = [np.asarray(batch.column(c)) for c in ("key", "doc_id", "info")]
            away = hot & (to != rows[1])
            if hot.any():
                yield out(rows[1][away], to[away])
                yield out(rows[1][hot], None, rows[0][hot], rows[2][hot])
            key, doc, info = (np.concatenate((x, y[~away])) for x, y in zip(last, rows, strict=True))
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        if batch is not None:  # the last group may go on in the next batch
            last = [x[starts[-1] :] for x in (key, doc, info)]
            if len(last[0]) <= SMALL_GROUP:
                starts, sizes = starts[:-1], sizes[:-1]
            else:
                last = [x[:0] for x in last]
        goes_on = int(len(starts) > 0 and big is not None and key[starts[0]] == big[0])
        small = goes_on + np.flatnonzero((sizes[goes_on:] > 1) & (sizes[goes_on:] <= SMALL_GROUP))
        for size in np.unique(sizes[small]).tolist():
            first = starts[small[sizes[small] == size]][:, None]
            x, y = ((first + pair).ravel() for pair in np.triu_indices(size, 1))
            keep = _may_link(info[x], info[y])
            yield out(doc[x[keep]], doc[y[keep]])
        for g in [0] * goes_on + (goes_on + np.flatnonzero(sizes[goes_on:] > SMALL_GROUP)).tolist():
            group = slice(starts[g], starts[g] + sizes[g])
            members = doc[group]
            big = big if g < goes_on else (int(key[starts[g]]), members[np.argmax(info[group])])
            yield out(members, np.full(len(members), big[1]))
            yield out(members, None, key[group], info[group])


def _sets(batches):
    for batch in slices(batches, AT_ONCE):
        sets = [signed(shingle_set(t)) for t in column_bytes(batch, "text")]
        yield pa.record_batch([batch.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "shingles"])


def _near(batches):
    """Pairs whose sketches don't rule out the similarity: at 0.75 the symmetric difference is a seventh of both sizes together at most."""
    for batch in batches:
        x, y, na, nb = (batch.column(k).to_pylist() for k in ("sa", "sb", "na", "nb"))
        keep = [7 * sketch_distance(*z) <= i + j for *z, i, j in zip(x, y, na, nb, strict=True)]
        yield pa.record_batch([batch.column("ra"), batch.column("rb")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows whose doc_id is in ids(doc_id), which holds none twice."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    some = docs.withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")  # at most 2 ** 20 numbers
    return some.join(ids, "doc_id", "left_semi").select("doc_id", "text")


def _verified(docs: DataFrame, sizes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(a, b), those between different sets that link, written; a < b are the sets' first documents."""
    x = sizes.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    y = sizes.select(F.col("doc_id").alias("b"), F.col("rep").alias("rb"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    near = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.join(x, "a").join(y, "b").where("ra <> rb AND 4 * least(na, nb) >= 3 * greatest(na, nb)")
    near = near.select("ra", "rb", "na", "nb", "sa", "sb").mapInArrow(_near, "a long, b long")
    near = staged(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    ids = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    sets = staged(_texts_of(docs, ids).mapInArrow(_sets, "doc_id long, shingles array<long>"), "sets")
    sa = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    sb = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = near.join(sa, "a").join(sb, "b").where(100 * both >= 75 * (F.size("sa") + F.size("sb") - both))
    return staged(linked.select("a", "b").distinct(), "links")


def linked_in(sets: list[np.ndarray], upto: int, start: int):
    """For each of the first `upto` sets, which of those from the position `start` on link with it, itself among them."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(len(sets)), sizes)[order]
    value = flat[order]
    first = np.concatenate(([True], value[1:] != value[:-1]))
    begin = np.flatnonzero(first)  # of the holders of each shingle, which stand in their own order
    holders = np.diff(np.append(begin, len(owner)))
    number = np.empty(len(flat), np.int64)
    number[order] = np.cumsum(first) - 1
    ends = np.cumsum(sizes)
    for i in range(upto):
        held = number[ends[i] - sizes[i] : ends[i]]
        held = held[holders[held] > 1]
        n = holders[held]
        at = np.arange(n.sum()) + np.repeat(begin[held] - (np.cumsum(n) - n), n)
        both = np.bincount(owner[at], minlength=len(sets))
        both[i] = sizes[i]
        yield np.flatnonzero(100 * both[start:] >= 75 * (sizes[i] + sizes[start:] - both[start:])) + start


def _count_links(batches):
    """Texts in order of component, pair of blocks and block to how many of the other documents' sets link with each, by document."""

    def counted(place: list | None, ids: list[int], blocks: list[int], texts: list[bytes]):
        sets = [shingle_set(t) for t in texts]
        have = [k for k, s in enumerate(sets) if len(s)]
        if len(have) < 2:
            return
        own, block, sets = np.array([ids[k] for k in have]), [blocks[k] for k in have], [sets[k] for k in have]
        in_lo = len(sets) if place[-2] == place[-1] else sum(b == place[-2] for b in block)
        far: dict[int, set] = {}
        for i, found in enumerate(linked_in(sets, in_lo, 0 if in_lo == len(sets) else in_lo)):
            others = own[found]
            far.setdefault(int(own[i]), set()).update(others[others != own[i]].tolist())
        near: dict[int, int] = {}
        for i, others in far.items():
            near[i] = near.get(i, 0) + len(others)
            if in_lo < len(sets):
                for j in others:
                    near[j] = near.get(j, 0) + 1
        if near:
            yield pa.record_batch([pa.array(list(near), pa.int64()), pa.array(list(near.values()), pa.int64())], ["id", "n_links"])

    at, rows = None, ([], [], [])
    for batch in batches:
        for *place, i, block, text in zip(*(batch.column(c).to_pylist() for c in ("component", "lo", "hi", "doc_id", "own")), column_bytes(batch, "text"), strict=True):
            if place != at:
                yield from counted(at, *rows)
                at, rows = place, ([], [], [])
            for x, value in zip(rows, (i, block, text), strict=True):
                x.append(value)
    yield from counted(at, *rows)


def _degrees(docs: DataFrame, sizes: DataFrame, found: DataFrame) -> DataFrame:
    """(id, n_links) of the documents in found(id, component) that link: with how many others, by their whole sets."""
    members = found.join(sizes.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_shingles").alias("n")), "id")
    members = staged(members.select("component", F.col("id").alias("doc_id"), "n"), "members")
    parts = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    texts = _texts_of(docs, members.select("doc_id")).join(members, "doc_id")
    dealt = _join_groups(texts, parts, ["component"], "parts", ["doc_id"]).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc_id", "own", "text")
    counts = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "own").mapInArrow(_count_links, "id long, n_links long")
    return counts.groupBy("id").agg(F.sum("n_links").alias("n_links"))


def _join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, spread: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups(on, size, ...), which holds a row for each group; the rows of a large one come in SALTS parts, by a hash of `spread`."""
    large = groups.where(F.col(size) > LARGE).select(*on, F.lit(True).alias("is_large"))
    if large.count() > MOST_LARGE:
        return rows.join(groups, on, how)
    many = F.sequence(F.lit(0), F.lit(SALTS - 1))
    dealt = groups.withColumn("salt", F.explode(F.when(F.col(size) > LARGE, many).otherwise(F.array(F.lit(0)))))
    marked = rows.join(F.broadcast(large), on, "left")  # at most MOST_LARGE rows
    marked = marked.withColumn("salt", F.when(F.col("is_large"), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(F.lit(0)))
    return marked.join(dealt, [*on, "salt"], how).drop("salt", "is_large")


def jaccard_components(documents: DataFrame, count_links: bool = True) -> DataFrame:
    """documents(doc_id long, text, ...) to (doc_id, n_shingles, component_id, n_links); without count_links, n_links is left out.

    Words, shingles and links are as in op4: sets of distinct five-word shingles, linked at a Jaccard
    similarity of at least 0.75. n_links counts all links between the document's distinct set and other distinct sets; without it
    links inside a component that follow from others may stay unverified.
    A null text counts as empty: n_shingles 0, its own component. A null doc_id gets a null component.
    Rows that repeat a doc_id are one document whose links are those of all its rows. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = 1 << min(MOST_BITS, max(LEAST_BITS, docs.count().bit_length() + 1))
    told = staged(docs.mapInArrow(_describe(size), "doc_id long, n_shingles long, hi long, lo long, sketch binary, parity array<long>, buckets array<long>, counts array<long>"), "described")
    counts = told.where("buckets IS NOT NULL").select(F.inline(F.arrays_zip("buckets", "counts"))).groupBy("buckets").agg(F.sum("counts").alias("n")).toArrow()  # at most 2 ** MOST_BITS rows
    df = np.zeros(size, np.int64)
    df[counts["buckets"].to_numpy()] = counts["n"].to_numpy()
    usual = float(np.median(df))
    known = told.where("n_shingles IS NOT NULL").select("doc_id", "n_shingles", "hi", "lo", "sketch", "parity")
    first = staged(known.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "first")
    shared = spark.sparkContext.broadcast((df, usual + 6 * usual**0.5 + 16 * REPEATED, _copied(first)))
    whole = staged(_join_groups(known, first, ["hi", "lo"], "copies", ["doc_id"], "left").select("doc_id", "n_shingles", "sketch", "parity", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "sets_of")
    sizes = whole.where("n_shingles > 0 AND doc_id IS NOT NULL").distinct()

    keys = docs.mapInArrow(_emit(shared), "key long, doc_id long, info long, hub long")
    keys = keys.repartition(F.when(F.col("hub").isNull() | (F.col("hub") == F.col("doc_id")), F.col("key")).otherwise(F.col("doc_id"))).sortWithinPartitions("key")
    met = staged(keys.mapInArrow(_meet, "a long, b long, key long, place long"), "met")
    links = _verified(docs, sizes, met.where("b IS NOT NULL"))
    several = whole.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).where("u <> last").select("doc_id", "u")
    same = several.join(whole.select("doc_id", F.col("rep").alias("v")), "doc_id").where("u <> v").select("u", "v")  # rows that repeat a doc_id
    found = staged(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(same)), "components")

    # holders of a frequent key that are still in different components; of a pair that links, the first key that both hold
    # stands no later in either order than the words that may differ and one key, and no key before it is in both
    hot = met.where("key IS NOT NULL").select("key", F.col("a").alias("doc_id"), "place")
    hot = hot.join(sizes, "doc_id").groupBy("key", F.col("rep").alias("id")).agg(F.min("place").alias("place"))
    hot = staged(hot.join(found, "id", "left").select("key", "id", "place", F.coalesce("component", "id").alias("c")), "hot")
    apart = hot.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("holders"))
    apart = apart.where("c0 <> c1").select("key", "holders", F.ceil(F.col("holders") / BLOCK).cast("int").alias("parts"))
    apart = staged(apart, "frequent")
    reps = sizes.where("doc_id = rep").select(F.col("rep").alias("id"), F.col("n_shingles").alias("n"), *[F.get("parity", F.lit(k)).alias(f"p{k}") for k in range(PARITY_LONGS)]).dropDuplicates(["id"])
    # holders of block i meet those of block j in group (i, j), i <= j
    own = _join_groups(hot, apart, ["key"], "holders", ["id"]).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    order = Window.partitionBy("id").orderBy("place", "key")
    own = own.withColumns({f"e{k}": F.lag("key", k + 1).over(order) for k in range(EARLIER)})
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = own.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("parts", "other", "holders")
    left = staged(own.join(reps, "id"), "apart")
    x, y = left.alias("l"), left.alias("r")
    both = F.col("l.n") + F.col("r.n")
    differ = sum((F.bit_count(F.col(f"l.p{k}").bitwiseXOR(F.col(f"r.p{k}"))) for k in range(PARITY_LONGS)), F.lit(0))
    met_before = [F.coalesce(F.col(f"l.e{i}") == F.col(f"r.e{j}"), F.lit(False)) for i in range(EARLIER) for j in range(EARLIER)]
    near = (7 * (F.greatest("l.place", "r.place") - 1) <= both) & (7 * differ <= both) & (4 * F.least("l.n", "r.n") >= 3 * F.greatest("l.n", "r.n")) & ~reduce(or_, met_before)
    met_once = (F.col("l.key") == F.col("r.key")) & (F.col("l.lo") == F.col("r.lo")) & (F.col("l.hi") == F.col("r.hi")) & ((F.col("l.own") != F.col("r.own")) | (F.col("l.lo") == F.col("l.hi")))
    cross = x.join(y, met_once & (F.col("l.c") < F.col("r.c")) & near).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    more = _verified(docs, sizes, cross)
    links = links.union(more).distinct()
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(same))
    if not count_links:
        return whole.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    found = staged(found, "components")
    named = found.join(_degrees(docs, sizes, found), "id", "left").withColumnRenamed("id", "rep")
    return whole.join(named, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
