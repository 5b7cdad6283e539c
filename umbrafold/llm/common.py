"""What the text operators share: reading tables, written intermediate tables, words and shingles."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
#: A key is sent to every task if it has more than one in so many rows; no more keys than this can.
HOT_KEYS = 2000
#: Texts of an Arrow batch that are Python objects at once.
AT_ONCE = 200
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WEIGHTS = tuple(np.uint64(w) for w in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/umbrafold-shared"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: it cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/umbrafold/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_apart(many: DataFrame, key: str, few: DataFrame, fan: str, total: int) -> DataFrame:
    """many left-joined with few on `key`, which is unique in few.

    `fan` is a column of few: how many rows of many have the key, at most; total is their sum or more. Keys of more than
    total / HOT_KEYS rows, fewer than HOT_KEYS of them, are sent to every task; the rows of the others are shuffled.
    """
    share = F.coalesce(F.col(fan), F.lit(0).cast("long")) * HOT_KEYS
    hot = F.broadcast(few.where(share > total))
    rest = many.join(hot.select(key), key, "left_anti").join(few.where(share <= total), key, "left")
    return many.join(hot, key).unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, rows: int):
    """The batches in parts of `rows` at most, where what a part gives rise to is much larger than itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def column_bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def each_bytes(batch: pa.RecordBatch, name: str):
    """As column_bytes(), AT_ONCE texts at a time."""
    for part in slices([batch], AT_ONCE):
        yield from column_bytes(part, name)


def words_of(text: bytes) -> list[bytes]:
    """A-Z in lower case, cut at the ASCII white space \\x20 and \\x09-\\x0D."""
    return text.lower().split()


class WordHashes(dict):
    """64-bit hash of each word as bytes, kept for words seen lately."""

    limit = 1 << 18

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh64_digest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


#: Words are polynomials of their bytes modulo 2 ** 64 at BASE: a number for each byte, letters in lower case, times the power of its place.
BASE = 0x9E3779B97F4A7C13
LETTERS = np.random.default_rng(20240502).integers(0, 1 << 64, 256, np.uint64)
LETTERS[65:91] = LETTERS[97:123]
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
PIECE = 1 << 20  # bytes of text that are hashed at once, unless a word is longer
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]  # of BASE and of its inverse, as many as were needed so far


def _powers_upto(n: int) -> list[np.ndarray]:
    for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
        while len(_powers[k]) < n:
            size = len(_powers[k])
            _powers[k] = np.concatenate((_powers[k], _powers[k] * np.uint64(pow(base, size, 1 << 64))))
    return _powers


def _pieces(text: bytes):
    """The text in parts of about PIECE bytes, cut at white space."""
    at = 0
    while len(text) - at > PIECE:
        spaces = np.flatnonzero(SPACES[np.frombuffer(text, np.uint8, PIECE, at)])
        to = at + (int(spaces[-1]) + 1 if len(spaces) else PIECE)
        while not len(spaces) and to < len(text):  # a word of more than PIECE bytes
            spaces = np.flatnonzero(SPACES[np.frombuffer(text, np.uint8, min(PIECE, len(text) - to), to)])
            to += int(spaces[0]) + 1 if len(spaces) else min(PIECE, len(text) - to)
        yield text[at:to]
        at = to
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each of words_of(text), in order, without an object for each word."""
    return _hashes(text) if len(text) <= PIECE else np.concatenate([_hashes(p) for p in _pieces(text)])


def _hashes(text: bytes) -> np.ndarray:
    codes = np.frombuffer(text, np.uint8)
    spaces = np.concatenate(([True], SPACES.take(codes), [True]))
    edges = np.flatnonzero(spaces[1:] != spaces[:-1])
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers_upto(len(codes))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(LETTERS.take(codes) * powers[: len(codes)])))
    own = (sums[ends] - sums[starts]) * inverse[starts]
    return mixed(own ^ ((ends - starts).astype(np.uint64) * _WEIGHTS[0]))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words, in order; a shorter text is one shingle, no words none."""
    n = len(ids)
    if n == 0:
        return ids
    k = min(n, size)
    total = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        total += ids[i : n - k + 1 + i] * _WEIGHTS[i]
    return mixed(total)


def shingle_set(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return distinct(shingle_hashes(hashes.array(words_of(text))))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
