"""Packing of documents into sequences, planned by best fit over a histogram of lengths.

Only the histogram (one row for each length up to the sequence size) goes to the driver. The plan names,
for each length, ranges of ranks and the sequences and offsets that they take; each document then finds its slot by
its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbrafold.llm.common import column_bytes, staged

RANK_BUCKETS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, first long, per long, at long"


#: A comma or full stop between a letter or digit and white space is a token piece of its own in any case.
STOP = re.compile(rb"(?<=[a-z0-9])([,.])(?=[ \n]|\Z)")


class WordIds(dict):
    """Token ids of a word as little-endian bytes, for words used lately; those before move to `old` when the table is full.

    Words end at a space or a line feed, which the tokenizer's own splitting never crosses; it lowers letters itself.
    """

    limit = 500_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encode_word, self.old = Tokenizer.from_file(path).encode, {b"": b""}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = array("I", self.encode_word(word.decode("utf-8", "replace"), None, False, False).ids).tobytes()
        if len(self) >= self.limit:
            self.old = self.copy()
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, STOP.sub(rb" \1", text.lower().replace(b"\n", b" ")).split(b" ")))


@functools.cache
def _table(path: str) -> WordIds:
    """One table for all tasks of a worker; it holds twice the limit at most."""
    return WordIds(path)


def _cut(path: str, end_id: int, size: int, lasting: bool):
    def run(batches):
        words = _table(path) if lasting else WordIds(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, text in zip(batch.column("doc_id").to_pylist(), column_bytes(batch, "text"), strict=True):
                ids = words.encode(text) + end
                rows += [(i, k, at // 4, len(part) // 4, zlib.crc32(part)) for k, at in enumerate(range(0, len(ids), 4 * size)) for part in (ids[at : at + 4 * size],)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(documents: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, lasting: bool = False) -> DataFrame:
    """lasting: workers keep their word table between tasks, which is faster and takes up to about 200 MB each.

    Each document's token ids and end_id, cut every `size` tokens: (doc_id, piece, start, length, ids_crc32). A null text is empty and gives the end alone."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(tokenizer_path, end_id, size, lasting), PIECES)


def best_fit(histogram: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by descending length over counts: rows (length, rank_from, rank_to, first, per, at).

    Ranks rank_from..rank_to-1 of a length go to the sequences from `first` on, `per` to a sequence,
    from offset `at` on. Sequences of equal contents are handled together, so the work follows the number of lengths.
    """
    plan, room, groups, following = [], [], {}, 0  # room: the free sizes in order; groups: free size -> [(first, sequences)]

    def put(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in groups:
                bisect.insort(room, free)
                groups[free] = []
            groups[free].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            k = bisect.bisect_left(room, length)
            if k < len(room):
                free = room[k]
                first, n = groups[free].pop()
                if not groups[free]:
                    del groups[free], room[k]
            else:
                free, first, n = size, following, -(-left // (size // length))
                following += n
            per = free // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, rank + full * per, first, per, size - free))
                put(free - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if full < n and left and left < per:
                plan.append((length, rank, rank + left, first + full, left, size - free))
                put(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(free, first + full, n - full)
    return plan


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """pieces(doc_id, piece, length, ...) with (sequence_id, offset) added: gapless sequences of at most `size` tokens.

    Every row gets one slot. Ties, repeated rows and null ids are told apart by their order within a length. A length
    must be from 1 to size. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).alias("bucket")
    counts = staged(pieces.groupBy("length", bucket).agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = spark.createDataFrame(best_fit(histogram, size), PLAN)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", *[c for c in pieces.columns if c not in ("doc_id", "piece", "length")])
    ranked = pieces.withColumn("bucket", bucket).withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "bucket")
    slot = F.broadcast(plan.withColumnRenamed("length", "planned"))  # a few rows for each length
    placed = ranked.join(slot, (F.col("length") == F.col("planned")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    sequence = (F.col("first") + F.floor(nth / F.col("per"))).cast("long")
    offset = (F.col("at") + nth % F.col("per") * F.col("length")).cast("long")
    return placed.select(*pieces.columns, sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(documents: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 2048, lasting: bool = False) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is one piece with the end alone. Rows with a null or repeated doc_id are each packed. Other columns are ignored.
    """
    return pack(staged(token_pieces(documents, tokenizer_path, end_id, size, lasting), "pieces"), size)
