"""Token ids in length-delimited binary records, with an offset index for reads in any order.

A record is an 8-byte length, the masked CRC-32C of these 8 bytes, the data, and the masked CRC-32C of the data, all
little-endian: the common framing of record files, which any reader of that framing takes. The data are the document's id
(8 bytes), whether it has one (1 byte), the bytes of a token id (1 byte: 2 or 4), and the ids, the end id last.

Texts are dealt out by ranges of doc_id, so the shards in the order of their parts hold ascending ids; each task writes its
own shards. The index is a table with a row for each record: shard, offset, length, first token's place and count. A shard
that a failed task left is in no index, and no task writes to another's file.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import fresh, shared_dir, slices, staged
from umbrafold.llm.token_ids import byte_level

LANE = 64
HEAD, FRAME = "<qBB", 16
SHARD_BYTES, READ_BYTES = 128 << 20, 8 << 20
# The reversed Castagnoli polynomial and the checksum's mask.
CASTAGNOLI, MASK = 0x82F63B78, 0xA282EAD8
INDEX = "doc_id long, part int, file string, offset long, length long, n_tokens long, at long"


class CorruptRecord(ValueError):
    """A record's length or checksum is not what its bytes or the index say."""


@functools.cache
def _byte_tables() -> np.ndarray:
    """T[k][v]: the remainder after byte v and k zero bytes."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> 1) ^ np.where(t & 1, np.uint32(CASTAGNOLI), np.uint32(0))
    out = [t]
    for _ in range(3):
        out.append(t[out[-1] & 255] ^ (out[-1] >> 8))
    return np.array(out)


@functools.cache
def _word_tables() -> tuple[np.ndarray, np.ndarray]:
    """For the low and the high half of a 32-bit word."""
    t, v = _byte_tables(), np.arange(1 << 16)
    return t[3][v & 255] ^ t[2][v >> 8], t[1][v & 255] ^ t[0][v >> 8]


@functools.cache
def _shift(level: int) -> np.ndarray:
    """S[k][v]: what byte k of a remainder, of value v, becomes after LANE * 2**level zero bytes."""
    if level:
        before = _shift(level - 1)
        return _moved(before, before)
    s, low, high = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]), *_word_tables()
    for _ in range(LANE // 4):
        s = low[s & 0xFFFF] ^ high[s >> 16]
    return s


def _moved(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each part, of 4 bytes or more, computed together: lanes of 64 bytes side by side, then lanes joined in pairs."""
    size = np.array([len(p) for p in parts], np.int64)
    lanes = -(-size // LANE)
    ends = np.cumsum(lanes)
    raw = np.zeros((int(ends[-1]) if len(ends) else 0) * LANE, np.uint8)
    for p, n, end in zip(parts, size.tolist(), ends.tolist(), strict=True):
        at = end * LANE - n
        raw[at : at + n] = np.frombuffer(p, np.uint8)
        raw[at : at + 4] ^= 255
    words, low, high = np.ascontiguousarray(raw.view("<u2").reshape(-1, LANE // 2).T), *_word_tables()
    state = np.zeros(words.shape[1], np.uint32)
    for k in range(0, LANE // 2, 2):
        state = low[words[k] ^ state.astype(np.uint16)] ^ high[words[k + 1] ^ (state >> np.uint32(16)).astype(np.uint16)]
    level = 0
    while len(state) > len(parts):  # each part's lanes, from its last on, go together in pairs
        half = (lanes + 1) // 2
        to = np.cumsum(half)
        nth = np.repeat(to, half) - 1 - np.arange(int(to[-1]))
        last = np.repeat(ends, half) - 1 - 2 * nth
        first = last - 1 >= np.repeat(ends - lanes, half)
        state = state[last] ^ np.where(first, _moved(_shift(level), state[np.maximum(last - 1, 0)]), np.uint32(0))
        lanes, ends, level = half, to, level + 1
    return state ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def framed(data: list[bytes]) -> list[bytes]:
    """Each of the data as a record."""
    sizes = [struct.pack("<Q", len(d)) for d in data]
    heads, tails = (masked(crc32c(x)).astype("<u4").tobytes() for x in (sizes, data))
    return [s + heads[4 * k : 4 * k + 4] + d + tails[4 * k : 4 * k + 4] for k, (s, d) in enumerate(zip(sizes, data, strict=True))]


def unframed(records: list[bytes]) -> list[bytes]:
    """The data of whole records, whose lengths and checksums are verified."""
    data = [r[12:-4] for r in records]
    for kept, given in ((masked(crc32c([r[:8] for r in records])), [r[8:12] for r in records]), (masked(crc32c(data)), [r[-4:] for r in records])):
        if kept.astype("<u4").tobytes() != b"".join(given):
            raise CorruptRecord("a record's checksum does not hold")
    if any(struct.unpack_from("<Q", r)[0] != len(d) for r, d in zip(records, data, strict=True)):
        raise CorruptRecord("a record's length does not hold")
    return data


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class _Shards:
    """The files that one task writes, each of `most` bytes or a record more."""

    def __init__(self, folder: str, part: int, most: int):
        self.most = most
        self.store, self.path = _opened(folder)
        self.store.create_dir(self.path, recursive=True)
        self.prefix, self.n, self.out = f"{part:07d}-{uuid.uuid4().hex[:12]}", 0, None

    def write(self, records: list[bytes]) -> list[tuple[str, int]]:
        places = []
        for r in records:
            if self.out is None or self.at >= self.most:
                self.close()
                self.name, self.at = f"{self.prefix}-{self.n:05d}.rec", 0
                self.out, self.n = self.store.open_output_stream(f"{self.path}/{self.name}"), self.n + 1
            self.out.write(r)
            places.append((self.name, self.at))
            self.at += len(r)
        return places

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _writer(folder: str, tokenizer_path: str, end_id: int, shard_bytes: int):
    def run(batches):
        encode, end, at, shards = byte_level(tokenizer_path).encode, np.array([end_id], "<u4").tobytes(), 0, None
        part = TaskContext.get().partitionId()
        for batch in slices(batches, 256):
            if shards is None:
                shards = _Shards(folder, part, shard_bytes)
            ids, data, rows = batch.column("doc_id").to_pylist(), [], []
            for i, text in zip(ids, batch.column("text").to_pylist(), strict=True):
                tokens = np.frombuffer(encode(text) + end, "<u4")
                width = 2 if tokens.max() < 1 << 16 else 4
                data.append(struct.pack(HEAD, i or 0, i is not None, width) + tokens.astype(f"<u{width}").tobytes())
                rows.append(len(tokens))
            places = shards.write(framed(data))
            starts = at + np.cumsum([0, *rows[:-1]])
            at = int(starts[-1]) + rows[-1]
            names, offsets = zip(*places, strict=True)
            columns = [pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(names, pa.string()), *(pa.array(c, pa.int64()) for c in (offsets, [len(d) + FRAME for d in data], rows, starts))]
            yield pa.record_batch(columns, [c.split()[0] for c in INDEX.split(", ")])
        if shards:
            shards.close()

    return run


def write_records(documents: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes documents(doc_id, text, ...) to record files in the folder, in ascending doc_id order, and returns their index.

    The index (doc_id, part, file, offset, length, n_tokens, at, start) is a written table; start counts the tokens of all
    records before. A null text is empty: its record holds the end id alone. Null doc_ids come first. Rows with the same
    doc_id come in the order of a hash of their text, equal rows one after the other. An empty table gives no files and an
    empty index. Other columns are ignored. The folder is a URI or path that executors share, on a store that pyarrow opens.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", "tie", "nth"]  # repeated ids, even repeated rows, don't all go to one task
    dealt = rows.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("nth")).repartitionByRange(*order).sortWithinPartitions(*order)
    index = staged(dealt.select("doc_id", "text").mapInArrow(_writer(folder, tokenizer_path, end_id, shard_bytes), INDEX), "index")
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())  # a row for each task
    before = np.cumsum([0, *(n for _, n in totals)])
    bases = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, before, strict=False)], "of_part int, base long")
    joined = index.join(F.broadcast(bases), F.col("part") == F.col("of_part"))
    return joined.select(*index.columns, (F.col("base") + F.col("at")).alias("start"))


def _reader(folder: str, with_ids: bool, at_once: int):
    def run(batches):
        store, path = _opened(folder)
        name, source = None, None
        for batch in slices(batches, 256):
            files, offsets, sizes, starts = (batch.column(c).to_pylist() for c in ("file", "offset", "length", "start"))
            records, k = [], 0
            while k < len(files):
                if files[k] != name:
                    if source:
                        source.close()
                    name, source = files[k], store.open_input_file(f"{path}/{files[k]}")
                last = k  # records that follow each other in a file are read at once
                while last + 1 < len(files) and files[last + 1] == name and offsets[last + 1] == offsets[last] + sizes[last] and offsets[last + 1] + sizes[last + 1] - offsets[k] <= at_once:
                    last += 1
                block = source.read_at(offsets[last] + sizes[last] - offsets[k], offsets[k])
                records += [block[o - offsets[k] : o - offsets[k] + n] for o, n in zip(offsets[k : last + 1], sizes[k : last + 1], strict=True)]
                k = last + 1
            if any(len(r) != n for r, n in zip(records, sizes, strict=True)):
                raise CorruptRecord("a shard ends within a record")
            out = []
            for d, start in zip(unframed(records), starts, strict=True):
                i, known, width = struct.unpack_from(HEAD, d)
                tokens = np.frombuffer(d, f"<u{width}", offset=struct.calcsize(HEAD)).astype("<u4")
                out.append((i if known else None, start, len(tokens), zlib.crc32(tokens.tobytes()), tokens))
            columns = [pa.array([r[j] for r in out], pa.int64()) for j in range(4)]
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([r[4].astype(np.int64) for r in out], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.record_batch(columns, names)
        if source:
            source.close()

    return run


def read_records(index: DataFrame, folder: str, with_ids: bool = False, at_once: int = READ_BYTES) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of the index's records, read from the files at their offsets and verified.

    Any rows of an index may be asked for, in any order; those that follow each other in a file are read together. A record
    that its length or checksum belies raises CorruptRecord.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return index.select("file", "offset", "length", "start").mapInArrow(_reader(folder, with_ids, at_once), schema)


def shuffled(index: DataFrame, seed: int, parts: int) -> DataFrame:
    """The index in a random order that the seed fixes, in so many parts: a reader takes records from all files, each from its place."""
    key = fresh(index, "drawn")
    drawn = index.withColumn(key, F.xxhash64(F.lit(seed), "file", "offset"))
    return drawn.repartition(parts, key).sortWithinPartitions(key).drop(key)


def record_round_trip(documents: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """documents(doc_id, text, ...) written as records in the shared folder and read back: (doc_id, start, n_tokens, ids_crc32)."""
    folder = f"{shared_dir(documents.sparkSession)}/umbrafold/{uuid.uuid4().hex}/records"
    return read_records(write_records(documents, folder, tokenizer_path, end_id), folder)
