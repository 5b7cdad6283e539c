"""Benchmark decontamination: size-partitioned MinHash containment search of short items inside long documents.

Items are partitioned by size: classes of more than L / 2 and up to L shingles, L a power of two. An item's signature is the
bottom-k sketch of its shingle hashes, its SIGNATURE least ones; items of fewer shingles keep all of them. A MinHash of a whole long document
says little about a short item, so it is the item's minima alone that are looked up: the share of them that a document
holds estimates the item's containment whatever the document's length. Each class has a least number of common
minima, chosen so that an item of which the threshold lies in the document falls short with a chance of MISS at most (none for items that
keep all shingles); documents with too few shingles for a class are not compared with it. Candidates are verified by exact containment of
the item's shingles in the whole document.

A benchmark of up to INDEX_CHARS characters goes to every task as flat arrays, under 32 bytes a word of it. A
larger one stays a table: one scan of the documents emits the hashes that a bit map of fixed size takes for minima,
a join on these hashes counts common minima, and candidates are verified by joining their texts.
"""

from __future__ import annotations

from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import WordHashes, column_bytes, distinct, fresh, shingle_hashes, shingle_set, signed, slices, staged, words_of

THRESHOLD = 0.75
SIGNATURE = 32
MISS = 1e-6
INDEX_CHARS = 16_000_000
MAP_BITS = 27  # of the bit map for larger benchmarks, 16 MB
HITS = "doc_id long, item_id long, n_item long, n_common long, containment double"


def size_class(n: int) -> int:
    """The least power of two that is at least n."""
    return 1 << (n - 1).bit_length()


def signature(sorted_hashes: np.ndarray) -> np.ndarray:
    """The bottom-k sketch of sorted distinct hashes. Hashes of shingles are well mixed, so their order is that of a random permutation."""
    return sorted_hashes[:SIGNATURE]


def least_common(n: int, threshold: float = THRESHOLD) -> int:
    """How many of an item's minima a document must hold to be a candidate; n: the item's shingles.

    The minima are drawn without replacement, for which the binomial tail is an upper bound.
    """
    if n <= SIGNATURE:
        return max(1, ceil(threshold * n - 1e-9))
    tail, k = 0.0, 0
    while k < SIGNATURE:
        tail += comb(SIGNATURE, k) * threshold**k * (1 - threshold) ** (SIGNATURE - k)
        if tail > MISS:
            break
        k += 1
    return max(1, k)


class ItemIndex:
    """Minima and shingles of a bounded number of items, in flat sorted arrays."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = THRESHOLD):
        hashes = WordHashes()
        ids, sets, minima = [], [], []
        for item, text in items:
            s = shingle_set(text, hashes)
            if item is not None and len(s):
                ids.append(item)
                sets.append(s)
                minima.append(signature(s))
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.shingles = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        keys = np.concatenate(minima) if minima else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(ids)), [len(m) for m in minima]).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.need = np.array([least_common(n, threshold) for n in self.sizes.tolist()], np.int64)
        self.least_size = np.ceil(threshold * self.sizes - 1e-9).astype(np.int64)
        self.bits = max(16, (8 * len(keys)).bit_length())
        self.map = np.zeros(1 << self.bits, bool)
        self.map[self._place(self.keys)] = True

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def set_of(self, k: int) -> np.ndarray:
        return self.shingles[self.ends[k] - self.sizes[k] : self.ends[k]]

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the items of which the document holds enough minima; shingles: its hashes in any order."""
        some = distinct(shingles[self.map[self._place(shingles)]])
        at, to = np.searchsorted(self.keys, some, "left"), np.searchsorted(self.keys, some, "right")
        n = to - at
        if not n.any():
            return np.zeros(0, np.int64)
        at, n = at[n > 0], n[n > 0]
        rows = np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, common = np.unique(self.owner[rows], return_counts=True)
        return item[(common >= self.need[item]) & (self.least_size[item] <= len(shingles))]


def common_shingles(whole: np.ndarray, own: np.ndarray) -> int:
    """How many of `own` are in `whole`, both sorted and distinct."""
    return int((whole[np.minimum(np.searchsorted(whole, own), len(whole) - 1)] == own).sum()) if len(whole) else 0


def _hits(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_common", "containment"])


def _search(shared, threshold: float):
    def run(batches):
        index: ItemIndex = shared.value
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                shingles = shingle_hashes(hashes.array(words_of(text)))
                found = index.candidates(shingles) if doc is not None and len(shingles) else ()
                if len(found):
                    whole = distinct(shingles)
                    for k in found.tolist():
                        size = int(index.sizes[k])
                        common = common_shingles(whole, index.set_of(k))
                        if common >= threshold * size:
                            rows.append((doc, int(index.ids[k]), size, common, common / size))
            yield _hits(rows)

    return run


def _item_minima(threshold: float):
    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, 1000):
            item, keys, need, least = [], [], [], []
            for i, text in zip(batch.column("item_row").to_pylist(), column_bytes(batch, "text"), strict=True):
                s = shingle_set(text, hashes)
                own = signature(s)
                item.append(np.full(len(own), i, np.int64))
                keys.append(signed(own))
                need.append(np.full(len(own), least_common(len(s), threshold) if len(s) else 0, np.int32))
                least.append(np.full(len(own), ceil(threshold * len(s) - 1e-9), np.int64))
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in (item, keys, need, least)] if item else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())], ["item_row", "key", "need", "least"])

    return run


def _document_minima(shared):
    """(doc_row, n, key) of the distinct shingles that the bit map takes for an item's minimum."""

    def run(batches):
        bitmap: np.ndarray = shared.value
        hashes = WordHashes()
        for batch in slices(batches, 200):
            docs, sizes, keys = [], [], []
            for i, text in zip(batch.column("doc_row").to_pylist(), column_bytes(batch, "text"), strict=True):
                s = shingle_set(text, hashes)
                place = s & np.uint64((1 << MAP_BITS) - 1)
                own = signed(s[(bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1])
                docs.append(np.full(len(own), i, np.int64))
                sizes.append(np.full(len(own), len(s), np.int64))
                keys.append(own)
            yield pa.record_batch([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (docs, sizes, keys)], ["doc_row", "n", "key"])

    return run


def _bit_map(batches):
    """One row for each 2 ** 13 bits of the map in which a partition of minima has some: (part, bits)."""
    held = np.zeros(1 << MAP_BITS, bool)
    for batch in batches:
        held[batch.column("key").to_numpy() & ((1 << MAP_BITS) - 1)] = True
    parts = np.packbits(held, bitorder="little").reshape(-1, 1024)
    full = np.flatnonzero(parts.any(1))
    yield pa.record_batch([pa.array(full, pa.int32()), pa.array([parts[k].tobytes() for k in full], pa.binary())], ["part", "bits"])


def _verify(threshold: float):
    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, 200):
            rows = []
            columns = (batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(), column_bytes(batch, "text"), column_bytes(batch, "item_text"))
            for doc, item, text, item_text in zip(*columns, strict=True):
                own = shingle_set(item_text, hashes)
                common = common_shingles(shingle_set(text, hashes), own)
                if common >= threshold * len(own):
                    rows.append((doc, item, len(own), common, common / len(own)))
            yield _hits(rows)

    return run


def _joined(docs: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """The hits of a benchmark that is too large to go to every task."""
    spark = docs.sparkSession
    items = staged(items.withColumn("item_row", F.xxhash64("item_id", "text")).dropDuplicates(["item_id", "text"]), "items")
    minima = staged(items.select("item_row", "text").mapInArrow(_item_minima(threshold), "item_row long, key long, need int, least long"), "minima")
    bitmap = np.zeros((1 << MAP_BITS) // 8192, "V1024")
    for r in minima.select("key").coalesce(8).mapInArrow(_bit_map, "part int, bits binary").toLocalIterator():  # 8 maps of a fixed size at most
        before = np.frombuffer(bitmap[r["part"]].tobytes(), np.uint8)
        bitmap[r["part"]] = (before | np.frombuffer(r["bits"], np.uint8)).tobytes()
    shared = spark.sparkContext.broadcast(bitmap.view(np.uint8))
    rows = docs.where("doc_id IS NOT NULL").withColumn("doc_row", F.xxhash64("doc_id", "text"))
    held = rows.select("doc_row", "text").mapInArrow(_document_minima(shared), "doc_row long, n long, key long")
    # rows that are repeated count a minimum once
    counted = held.join(minima, "key").where("least <= n").groupBy("doc_row", "item_row").agg(F.count_distinct("key").alias("common"), F.max("need").alias("need"))
    near = staged(counted.where("common >= need").select("doc_row", "item_row"), "candidates")
    texts = rows.join(near, "doc_row").join(items.select("item_row", "item_id", F.col("text").alias("item_text")), "item_row")
    return texts.select("doc_id", "item_id", "text", "item_text").mapInArrow(_verify(threshold), HITS)


def contained_items(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_common, containment) where at least `threshold` of the item's distinct five-word shingles are in the document.

    The documents are read once whatever the benchmark's size. An item of more than SIGNATURE shingles that belongs to a document is missed with a chance of
    MISS at most; smaller ones never. Items and documents with null ids, null texts or no words have no pairs;
    an item of fewer than five words is one shingle, found in a document of just these words. Repeated rows give
    one pair for each item_id and doc_id, that of the largest containment. Other columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    if (own.agg(F.sum(F.length("text"))).first()[0] or 0) <= INDEX_CHARS:
        rows = own.collect()  # INDEX_CHARS characters
        shared = spark.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"].encode()) for r in rows], threshold))
        hits = docs.mapInArrow(_search(shared, threshold), HITS)
    else:
        hits = _joined(docs, own, threshold)
    best = F.max(F.struct("containment", "n_item", "n_common")).alias("best")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.n_item", "best.n_common", "best.containment")


def clean_documents(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item. Rows with a null doc_id can't be named in a hit and stay."""
    name = fresh(documents, "hit_id")
    hit = contained_items(documents, items, threshold).select(F.col("doc_id").alias(name)).distinct()
    return documents.join(hit, F.col("doc_id") == F.col(name), "left_anti")
