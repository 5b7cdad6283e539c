"""Hidden Markov language model.

States emit word classes; a class gives its words by their counts. The most frequent words are classes of their own, the others
share a class with the words of like ending, so the emission table has a fixed size while the counts grow with
the corpus. P(text) = P(class sequence), summed over all state paths by the scaled forward recursion, times the chance of each word in its class: (c + 1) / (C + V + 1)
for a word of count c in a class of V words and C occurrences, so every class also has room for words never seen.
Baum-Welch trains the states: each partition adds up its expected counts, and their sums give the next model.

Tokens: words between ASCII white space with A-Z in lower case, then one end. The counts of the RESOLVED most frequent words go
to every task; the other words find theirs by a join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import column_bytes, staged, words_of

STATES = 6
OWN_CLASSES = 1024
ENDINGS = 1024
RESOLVED = 65_536
ROUNDS = 4
CHUNK_TOKENS = 600_000
END = b"\n"
CLASSES = OWN_CLASSES + ENDINGS
TOKEN = np.dtype([("h", "<i8"), ("c", "<u2")])
RESCALE = 8


class Tokens(dict):
    """Hash and class of a word as bytes, for words seen lately. The last bits of a hash are the class of the word's ending.

    own: class by hash of the words that are classes of their own.
    """

    limit = 1 << 19

    def __init__(self, own: dict[int, int]):
        self.own = {h.to_bytes(8, "little", signed=True): k.to_bytes(2, "little") for h, k in own.items()}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        ending = xxhash.xxh32_intdigest(word.rstrip(b".,;:!?")[-3:]) % ENDINGS
        h = (xxhash.xxh64_intdigest(word) & -ENDINGS | ending).to_bytes(8, "little")
        value = self[word] = h + (self.own.get(h) or (OWN_CLASSES + ending).to_bytes(2, "little"))
        return value

    def array(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        words.append(END)
        return np.frombuffer(b"".join(map(self.__getitem__, words)), TOKEN)


@dataclass
class Hmm:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state, state]
    emit: np.ndarray  # [class, state]


@dataclass
class Counts:
    total: int  # tokens in training
    words: int  # distinct ones
    own: dict[int, int] = field(default_factory=dict)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of the resolved words, sorted
    logs: np.ndarray = field(default_factory=lambda: np.zeros(0))  # their log10(count + 1)
    room: np.ndarray = field(default_factory=lambda: np.zeros(CLASSES))  # log10(C + V + 1) by class; 0 for a class of one word
    share: np.ndarray = field(default_factory=lambda: np.full(CLASSES, 1 / CLASSES))  # of the tokens, smoothed, by class


def first_model(share: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
    """A start with states that tend to stay and emissions that differ at random."""
    random = np.random.default_rng(seed)
    emit = share[:, None] * random.gamma(1.0, 1.0, (len(share), states)) + 1e-3 * share[:, None]
    return Hmm(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))


class Lanes:
    """Class sequences side by side, longest first, so that each step handles all sequences that reach it at once."""

    def __init__(self, sequences: list[np.ndarray]):
        self.order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
        sizes = np.array([len(sequences[k]) for k in self.order])
        self.live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")  # sequences that reach each step
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        self.flat = np.empty(int(self.at[-1]), np.int64)
        for lane, k in enumerate(self.order):
            self.flat[self.at[: sizes[lane]] + lane] = sequences[k]
        self.sizes = sizes

        self.scaled = np.zeros(len(self.live), bool)  # every few steps, and where a sequence ends
        self.scaled[RESCALE - 1 :: RESCALE] = True
        self.scaled[np.append(self.live[1:] < self.live[:-1], True)] = True

    def forward(self, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emission chances, scaled forward chances and scales, by step and lane."""
        emit = model.emit[self.flat]
        ahead = np.empty_like(emit)
        scale = np.ones(len(self.flat))
        a = 0
        for t, (n, scaled) in enumerate(zip(self.live.tolist(), self.scaled.tolist(), strict=True)):
            now = ahead[a : a + n]
            np.multiply(emit[a : a + n], ahead[before : before + n] @ model.move if t else model.start, out=now)
            if scaled:
                scale[a : a + n] = s = now.sum(1)
                now /= s[:, None]
            before, a = a, a + n
        return emit, ahead, scale

    def likelihoods(self, model: Hmm) -> np.ndarray:
        """log10 of each sequence's chance, in the order given."""
        logs = np.log10(self.forward(model)[2])
        total = np.zeros(len(self.sizes))
        for t, n in enumerate(self.live.tolist()):
            total[:n] += logs[self.at[t] : self.at[t] + n]
        out = np.empty(len(total))
        out[self.order] = total
        return out

    def expected(self, model: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts of first states, moves and emissions, and the log10 likelihood."""
        emit, ahead, scale = self.forward(model)
        behind, onward, back = np.ones_like(ahead), np.empty_like(ahead), np.ascontiguousarray(model.move.T)
        for t in range(len(self.live) - 1, 0, -1):
            a, b, n = int(self.at[t - 1]), int(self.at[t]), int(self.live[t])
            now = onward[b : b + n]
            np.multiply(emit[b : b + n], behind[b : b + n], out=now)
            if self.scaled[t]:
                now /= scale[b : b + n, None]
            np.matmul(now, back, out=behind[a : a + n])
        first = int(self.live[0])
        step = np.repeat(np.arange(1, len(self.live)), self.live[1:])
        previous = np.arange(first, len(self.flat)) - self.at[step] + self.at[step - 1]
        moves = ahead[previous].T @ onward[first:]
        state = ahead * behind
        state /= state.sum(1, keepdims=True)
        emissions = np.stack([np.bincount(self.flat, state[:, k], len(model.emit)) for k in range(len(model.start))], 1)
        return state[: self.live[0]].sum(0), moves * model.move, emissions, float(np.log10(scale).sum())


def chunks(sequences: list[np.ndarray]):
    """Indexes of sequences of like length, CHUNK_TOKENS together or a single longer one."""
    part, n = [], 0
    for k in sorted(range(len(sequences)), key=lambda k: len(sequences[k])):
        if part and n + len(sequences[k]) > CHUNK_TOKENS:
            yield part
            part, n = [], 0
        part.append(k)
        n += len(sequences[k])
    if part:
        yield part


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 7 is 2; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def count_words(training: DataFrame) -> tuple[Counts, DataFrame]:
    """Counts of fixed size, and all of them as a table (h, n)."""

    def run(batches):
        tokens = Tokens({})
        for batch in batches:
            texts = [tokens.array(t)["h"] for t in column_bytes(batch, "text")]
            if texts:
                every = np.sort(np.concatenate(texts))
                first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
                yield pa.record_batch([pa.array(every[first]), pa.array(np.diff(np.append(first, len(every))))], ["h", "n"])

    counted = training.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = staged(counted, "words")
    total, words = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    top = counted.orderBy(F.desc("n"), "h").limit(RESOLVED).toArrow()  # RESOLVED rows
    hashes, n = top["h"].to_numpy(), top["n"].to_numpy()
    order = np.argsort(hashes)
    own = {h: k for k, h in enumerate(hashes[:OWN_CLASSES].tolist())}
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counted.groupBy((OWN_CLASSES + F.col("h").bitwiseAND(F.lit(ENDINGS - 1))).alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # ENDINGS rows
        size[r["c"]], kinds[r["c"]] = r["n"], r["v"]
    for k, (h, m) in enumerate(zip(hashes[:OWN_CLASSES].tolist(), n[:OWN_CLASSES].tolist(), strict=True)):
        size[OWN_CLASSES + h % ENDINGS] -= m
        kinds[OWN_CLASSES + h % ENDINGS] -= 1
        size[k] = m
    room = np.log10(size + kinds + 1)
    room[: len(own)] = np.log10(n[:OWN_CLASSES] + 1)  # a class of one word: its chance there is 1
    share = (size + 1) / (size + 1).sum()
    return Counts(int(total), int(words), own, hashes[order], np.log10(n[order] + 1.0), room, share), counted.select("h", "n")


def train(training: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """Baum-Welch over all training texts; the model and the log10 likelihood before each round."""

    def classes(batches):
        tokens = Tokens(counts.own)
        for batch in batches:
            yield pa.record_batch([pa.array([tokens.array(t)["c"].tobytes() for t in column_bytes(batch, "text")], pa.binary())], ["classes"])

    sequences = staged(training.select("text").mapInArrow(classes, "classes binary"), "classes")
    model, likelihoods = first_model(counts.share, states), []
    for _ in range(rounds):
        now = model

        def expect(batches, now=now):
            start, move, emit, likelihood = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)), 0.0
            for batch in batches:
                own = [np.frombuffer(x, np.uint16) for x in batch.column("classes").to_pylist()]
                for part in chunks(own):
                    s, m, e, x = Lanes([own[k] for k in part]).expected(now)
                    start, move, emit, likelihood = start + s, move + m, emit + e, likelihood + x
            rows = np.concatenate((emit, move, start[None], np.full((1, states), likelihood)))
            used = np.flatnonzero(rows.any(1))
            yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(rows[used]), pa.list_(pa.float64()))], ["row", "values"])

        sums = sequences.mapInArrow(expect, "row int, values array<double>").groupBy("row").agg(*[F.sum(F.get("values", F.lit(k))).alias(f"v{k}") for k in range(states)]).collect()  # CLASSES + states + 2 rows
        rows = np.zeros((CLASSES + states + 2, states))
        for r in sums:
            rows[r["row"]] = [r[f"v{k}"] for k in range(states)]
        likelihoods.append(float(rows[-1, 0]))
        emit = rows[:CLASSES] + 20 * counts.share[:, None]
        move = rows[CLASSES : CLASSES + states] + 1
        start = rows[CLASSES + states] + 1
        model = Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model, likelihoods


PARTS = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_part double, score_part double, hs array<long>, times array<int>"


def score_documents(documents: DataFrame, counts: Counts, words: DataFrame, model: Hmm) -> DataFrame:
    """documents(doc_id, text, ...) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score).

    base_score is the sum of log10((c + 1) / (N + V + 1)) over the tokens, score the model's log10 chance of the text. A null text is empty: its end alone. Rows with null or
    repeated ids are each scored. Other columns are ignored.
    """
    floor = np.log10(counts.total + counts.words + 1)

    def run(batches):
        tokens = Tokens(counts.own)
        for batch in batches:
            texts = [tokens.array(t) for t in column_bytes(batch, "text")]
            if not texts:
                continue
            paths = np.empty(len(texts))
            for part in chunks(texts):
                paths[part] = Lanes([texts[k]["c"] for k in part]).likelihoods(model)
            n, known, base, score, hs, times = [], [], [], [], [], []
            for path, t in zip(paths.tolist(), texts, strict=True):
                c = t["c"]
                own = c < OWN_CLASSES  # these words' logs are their classes'
                h = t["h"][~own]
                at = np.minimum(np.searchsorted(counts.hashes, h), max(0, len(counts.hashes) - 1))
                here = counts.hashes[at] == h if len(counts.hashes) else np.zeros(len(h), bool)
                logs = counts.room[c[own]].sum() + counts.logs[at[here]].sum()
                rest, m = np.unique(h[~here], return_counts=True)
                n.append(len(t))
                known.append(int(own.sum() + here.sum()))
                base.append(logs - len(t) * floor)
                score.append(path + logs - counts.room[c].sum())
                hs.append(rest)
                times.append(m.astype(np.int32))
            columns = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(hs, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]
            yield pa.record_batch([*[batch.column(x) for x in ("uid", "doc_id", "held_out")], *columns], ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_part", "score_part", "hs", "times"])

    docs = documents.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    parts = staged(docs.mapInArrow(run, PARTS), "parts")
    rest = parts.select("uid", F.inline(F.arrays_zip(F.col("hs").alias("h"), F.col("times").alias("m"))))
    found = rest.join(words, "h").groupBy("uid").agg(F.sum(F.col("m") * F.log10(F.col("n") + 1.0)).alias("logs"), F.sum("m").cast("long").alias("known"))
    both = parts.drop("hs", "times").join(found, "uid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return both.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("base_part") + logs).alias("base_score"), (F.col("score_part") + logs).alias("score"))


def language_model_scores(documents: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the documents that are not held out and scores all; columns as in score_documents()."""
    training = documents.where(~held_out(F.col("doc_id"))).select("text")
    counts, words = count_words(training)
    model, _ = train(training, counts, states, rounds)
    return score_documents(documents, counts, words, model)
