"""Alignment of two tokenizers over the same texts, by the byte offsets at which tokens end.

Tokens of both sides are merged by the bytes at which they end: each end closes a link, and an end that both sides have closes a
group. Texts are cut into words over which no token of either side reaches, so a text's ids are its words' in a
row; a task keeps the ids of words used lately, tokenizes the new words of a batch together and merges the ends of its texts at once.

How many links of the corpus hold a pair of ids comes from one count of exploded links. Pairs that make up a given share of
all links, which bounds their number, are sent to every task; the others are joined by shuffle.
"""

from __future__ import annotations

import contextlib
import functools
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import AT_ONCE, slices, staged
from umbrafold.llm.token_ids import LONGEST, ByteLevelIds, IrregularSpace, Kept, cut, lengths

#: A pair is sent to every task if it holds more than one link in so many; no more pairs than this can.
FREQUENT = 1 << 18
#: Words whose ids a worker keeps, for both sides.
KEPT = 200_000
#: What tells an id of B from one of A.
OF_B = 1 << 31
#: What a piece must not hold for the cuts of token_ids to hold on its side too.
CROSSING = re.compile("[^▁]▁|[A-Za-z][.,]|\n")
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, link_a array<int>, link_b array<int>, groups string"
TOKENS = "doc_id long, a_ids array<int>, a_ends array<int>, b_ids array<int>, b_ends array<int>"


class UnequalBytes(ValueError):
    """The tokens' bytes are not the text's."""


class BothIds:
    """Ids of a space and a text by a byte-level file, and of the text by a piece model that adds the space."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a, self.pieces = ByteLevelIds(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, ids = self.a.token_bytes(), range(self.pieces.get_piece_size())
        names = [self.pieces.id_to_piece(i) for i in ids]
        self.b_bytes = {i: _piece_bytes(names[i], self.pieces.is_byte(i)) for i in ids}
        self.a_lengths, self.b_lengths = lengths(self.a_bytes), lengths(self.b_bytes)
        self.crossed = any(CROSSING.search(names[i]) for i in ids if not self.pieces.is_byte(i))
        self.words = Kept(self._word, KEPT)
        self.both = Kept(lambda word: self._both_of(word, self._pieces_of([word])[0]), KEPT)
        a, b = len(self.a_lengths), len(self.b_lengths)
        self.a_size, self.written = a, [f"{i}{c}" for c, n in ((",", a), ("|", a), (",", b), (";", b)) for i in range(n)]

    def _b(self, text: str) -> list[int]:
        """Of a space and the text, or, after a line feed, of the text without the space."""
        ids = self.pieces.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, ids)) != f" {text}".encode():
            raise UnequalBytes
        return ids

    def _word(self, word: str) -> tuple[bytes, bytes]:
        a = self.a.word(word)
        if word in self.a.marks:
            ids = self._b(f"\n{word[1]}")[2:]
        else:  # the first piece is the added space
            ids = self._b(word)[1:] if word[0] == "\n" else self._b(word)
        return a, array("I", ids).tobytes()

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """Ids of both sides as little-endian unsigned 32-bit numbers; none where bytes differ or the text is empty."""
        if not text:
            return b"", b""
        try:
            if "\0" not in text and not self.crossed:
                try:  # no piece of either side reaches over a cut
                    pairs = list(map(self.words.__getitem__, cut(text)))
                    return b"".join([a for a, _ in pairs]), b"".join([b for _, b in pairs])
                except IrregularSpace:
                    pass
            return self.a.encode(f" {text}"), array("I", self._b(text)).tobytes()
        except UnequalBytes:
            return b"", b""


    def _pieces_of(self, words: list[str]) -> list[list[int]]:
        """Of words as _aligned_word() takes them, encoded at once."""
        return self.pieces.encode([f"\n{w[1]}" if w in self.a.marks else w for w in words], num_threads=1)

    def _both_of(self, word: str, b: list[int]) -> bytes | None:
        """Ids of a word, those of B with the bit OF_B; none where bytes differ. b: what the piece model gives for the word, or for a mark behind a line feed."""
        a, mark = self.a.word(word), word in self.a.marks  # first, as it tells of irregular space
        if b"".join(map(self.b_bytes.__getitem__, b)) != (f" \n{word[1]}" if mark else f" {word}").encode():
            return None
        b = b[2:] if mark else b[1:] if word[0] == "\n" else b  # the first piece is the added space
        return a + array("I", [x | OF_B for x in b]).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """For each text the ids of both sides, those of B with the bit OF_B, each side in order; none where bytes differ or the text is empty."""
        words = [cut(t) if t and "\0" not in t and not self.crossed else [] for t in texts]
        kept = self.both
        new = [w for w in set().union(*words) if w not in kept and w not in kept.old and len(w) <= LONGEST]
        for word, b in zip(new, self._pieces_of(new), strict=True):
            with contextlib.suppress(IrregularSpace):  # its text is told by it once more
                kept.keep(word, self._both_of(word, b))
        return [self._encoded(t, w) for t, w in zip(texts, words, strict=True)]

    def _encoded(self, text: str, words: list[str]) -> bytes:
        if words:
            try:  # no piece of either side reaches over a cut
                found = list(map(self.both.__getitem__, words))
                return b"" if None in found else b"".join(found)
            except IrregularSpace:
                pass
        a, b = self.encode(text)
        return a + (np.frombuffer(b, "<u4") | OF_B).astype("<u4").tobytes()


def _piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace("▁", " ").encode()


@functools.cache
def both_ids(a_path: str, b_path: str) -> BothIds:
    """One for all tasks of a worker, with at most twice KEPT words."""
    return BothIds(a_path, b_path)


def _tokenizer(a_path: str, b_path: str):
    def arrays(ids: list[bytes], size: np.ndarray) -> tuple[pa.Array, pa.Array]:
        at = np.cumsum([0, *(len(x) // 4 for x in ids)])
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        ends = np.concatenate(([0], np.cumsum(size[flat], dtype=np.int64)))
        own = ends[1:] - np.repeat(ends[at[:-1]], np.diff(at))
        offsets = pa.array(at, pa.int32())
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (flat, own.astype(np.int32)))

    def run(batches):
        both = both_ids(a_path, b_path)
        for batch in slices(batches, 64):
            pairs = [both.encode(t or "") for t in batch.column("text").to_pylist()]
            columns = [*arrays([a for a, _ in pairs], both.a_lengths), *arrays([b for _, b in pairs], both.b_lengths)]
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *columns], [c.split()[0] for c in TOKENS.split(", ")])

    return run


def tokenized(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, a_ids, a_ends, b_ids, b_ends). Null and empty texts, and those whose tokens' bytes are not a space and the text, have no tokens."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenizer(a_path, b_path), TOKENS)


LOW = (1 << 32) - 1


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def aligned_batch(doc_id: pa.Array, a_at: np.ndarray, a: np.ndarray, a_ends: np.ndarray, b_at: np.ndarray, b: np.ndarray, b_ends: np.ndarray, written: tuple) -> pa.RecordBatch:
    """ALIGNED rows of texts in a row. a, a_ends: ids of all texts and the bytes, counted over all, at which they end; a_at: where each text's ids begin, and the end; likewise b.

    written: names of A ids before a comma, of A ids before a stroke, of B ids before a comma and before a semicolon, and how many A ids there are.
    """
    names, size = written
    upto = np.concatenate(([0], a_ends))[a_at]  # bytes before each text
    ends_a, ends_b = np.zeros(upto[-1] + 1, bool), np.zeros(upto[-1] + 1, bool)
    ends_a[a_ends] = ends_b[b_ends] = True
    before_a, before_b = (np.cumsum(x, dtype=np.int32) - x for x in (ends_a, ends_b))
    common = ends_a & ends_b
    groups = np.cumsum(common, dtype=np.int32)
    ends = np.flatnonzero(ends_a | ends_b)
    at = pa.array(np.searchsorted(ends, upto, "right"), pa.int32())
    link_a, link_b = (pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (a[before_a[ends]], b[before_b[ends]]))
    # a group's A tokens stand before its B tokens
    order = np.argsort(np.concatenate((2 * (groups[a_ends] - common[a_ends]), 2 * (groups[b_ends] - common[b_ends]) + 1)), kind="stable")
    name = np.concatenate((a + size * common[a_ends], 2 * size + b + (len(names) // 2 - size) * common[b_ends]))[order]
    tokens = (a_at + b_at).tolist()
    texts = ["".join(map(names.__getitem__, name[x:y].tolist()))[:-1] for x, y in zip(tokens, tokens[1:], strict=False)]
    return pa.record_batch([doc_id.cast(pa.int64()), pa.array(np.diff(a_at)), pa.array(np.diff(b_at)), pa.array(np.diff(groups[upto].astype(np.int64))), link_a, link_b, pa.array(texts, pa.string())], [c.split()[0] for c in ALIGNED.split(", ")])


def aligned(tokens: DataFrame) -> DataFrame:
    """tokens(doc_id, a_ids, a_ends, b_ids, b_ends) to (doc_id, n_a, n_b, n_groups, link_a, link_b, groups).

    link_a and link_b are the ids of each pair of an A and a B token whose bytes overlap, in order. groups is the text of the
    groups between common ends, empty without tokens. Both sides must end at the same byte, and no token may be empty.
    """

    def run(batches):
        for batch in slices(batches, AT_ONCE):
            (a_at, a), (_, a_ends), (b_at, b), (_, b_ends) = (_flat(batch.column(c)) for c in ("a_ids", "a_ends", "b_ids", "b_ends"))
            last = np.concatenate((a_ends, [0]))[np.maximum(a_at[1:], 1) - 1] * (np.diff(a_at) > 0)  # bytes of each text
            start = np.cumsum(last) - last
            size = int(a.max(initial=0)) + 1
            names = [f"{i}{c}" for c, n in ((",", size), ("|", size), (",", int(b.max(initial=0)) + 1), (";", int(b.max(initial=0)) + 1)) for i in range(n)]
            yield aligned_batch(batch.column("doc_id"), a_at, a, a_ends + np.repeat(start, np.diff(a_at)), b_at, b, b_ends + np.repeat(start, np.diff(b_at)), (names, size))

    return tokens.select(*[c.split()[0] for c in TOKENS.split(", ")]).mapInArrow(run, ALIGNED)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each list's values begin, and the end, and all values."""
    at = np.concatenate(([0], np.cumsum([len(x) for x in column]))).astype(np.int64)
    return at, column.flatten().to_numpy().astype(np.int64)


def aligned_texts(documents: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """aligned() of tokenized(): documents(doc_id, text, ...) to (doc_id, n_a, n_b, n_groups, link_a, link_b, groups), of AT_ONCE texts at a time."""

    def run(batches):
        both = both_ids(a_path, b_path)
        for batch in slices(batches, AT_ONCE):
            yield aligned_of(batch.column("doc_id"), both.encode_all([t or "" for t in batch.column("text").to_pylist()]), both)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ALIGNED)


def aligned_of(doc_id: pa.Array, found: list[bytes], both: BothIds) -> pa.RecordBatch:
    """ALIGNED rows of what encode_all() gives; as both sides of a text have its bytes, their ends are counted over all texts."""
    flat = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
    of_b = flat >= OF_B
    at = np.cumsum([0, *(len(x) // 4 for x in found)])
    b_at = np.concatenate(([0], np.cumsum(of_b)))[at]
    a, b = flat[~of_b], flat[of_b] - OF_B
    return aligned_batch(doc_id, at - b_at, a, np.cumsum(both.a_lengths[a], dtype=np.int64), b_at, b, np.cumsum(both.b_lengths[b], dtype=np.int64), (both.written, both.a_size))


def links_of(alignments: DataFrame, *keys: str) -> DataFrame:
    """A row for each link: (keys..., link), the A id times 2^32 plus the B id."""
    each = alignments.select(*keys, F.posexplode("link_a").alias("p", "a"), "link_b")
    return each.select(*keys, F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.get("link_b", F.col("p")).cast("long")).alias("link"))


def pair_counts(links: DataFrame) -> DataFrame:
    """links(link) to (link, n, best): how many links hold the pair, and whether no pair of the same B id has more."""
    counts = staged(links.groupBy("link").agg(F.count("*").alias("n")), "pairs")
    of_b = F.col("link").bitwiseAND(_long(LOW))
    most = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))  # no more pairs for a B id than there are A ids
    return counts.join(most, of_b == F.col("b")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))


def link_report(alignments: DataFrame) -> DataFrame:
    """alignments as of aligned() to (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each of its rows.

    n_best counts the links whose pair is one of the commonest of its B id in the corpus, count_sum sums their pairs' counts.
    Rows with a null or repeated doc_id each have their row. An empty table gives an empty result.
    """
    rows = staged(alignments.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", "link_a", "link_b", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")), "alignments")
    links = links_of(rows, "row")
    counts = staged(pair_counts(links), "pair_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    known = counts.select(F.col("link").alias("pair"), "n", "best")
    frequent = F.broadcast(known.where(F.col("n") * FREQUENT > total))  # fewer than FREQUENT rows
    sums = lambda x: x.groupBy("row").agg(F.sum("n").alias("s"), F.count_if("best").alias("k"))
    often = links.join(frequent, F.col("link") == F.col("pair"))
    seldom = links.join(frequent.select("pair"), F.col("link") == F.col("pair"), "left_anti").join(known.where(F.col("n") * FREQUENT <= total), F.col("link") == F.col("pair"))
    found = sums(often).union(sums(seldom)).groupBy("row").agg(F.sum("s").alias("s"), F.sum("k").alias("k")).withColumnRenamed("row", "of_row")
    out = rows.join(found, F.col("row") == F.col("of_row"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.size("link_a").cast("long").alias("n_links"), zero("k").alias("n_best"), zero("s").alias("count_sum"), "groups_sha256")
