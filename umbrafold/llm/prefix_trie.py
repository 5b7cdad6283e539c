"""Trie of the prefixes that conversations share, with sums over each node's subtree by pointer jumping.

A prefix's digest is a polynomial of its turns' digests, so it is carried over from one part of a conversation to the next:
turns are dealt out by ranges of conversation and place, each task runs over its own, and the parts that a conversation
fills are continued from one row for each task. No task holds a whole conversation. A digest without its last turn is
the parent's, which gives the edges.

Sums go up in rounds: a node adds what the nodes that point to it have gathered and then points where its target points,
twice as far. After as many rounds as the depth has binary digits every ancestor has everything. Nodes of one member are
chains of a single leaf and need no round. A node that many point to is sent to every task instead of being shuffled to.
"""

from __future__ import annotations

import functools
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbrafold.llm.common import joined_apart, staged

#: Prefix digests are numbers below this prime, at 16 bytes; STEP is an arbitrary base.
PRIME = (1 << 127) - 1
STEP = 0x3A7C15F39CC0605CEDC8341BA9F5C3D1
BACK = pow(STEP, -1, PRIME)
ROOT = bytes(16)
CHUNK = 1 << 16
SCANNED = "part int, conv_id long, pos long, hash binary, turn_hash binary, chars long"
PREFIXES = "conv_id long, pos long, id binary, parent binary, chars long"


def turn_hash(role: Column, text: Column) -> Column:
    """16 bytes of the SHA-256 of role and text, of which neither is null."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))


def _number(raw: bytes) -> int:
    return int.from_bytes(raw, "little")


def _bytes(number: int) -> bytes:
    return number.to_bytes(16, "little")


def _scan(batches):
    """Places and prefix digests of the turns of a task, as if each conversation began there."""
    part, conv, pos, h = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        places, hashes = [], []
        for c, t in zip(batch.column("conv_id").to_pylist(), batch.column("turn_hash").to_pylist(), strict=True):
            if c != conv:
                conv, pos, h = c, -1, 0
            pos, h = pos + 1, (h * STEP + _number(t)) % PRIME
            places.append(pos)
            hashes.append(_bytes(h))
        columns = [pa.array([part] * len(places), pa.int32()), batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(hashes, pa.binary()), batch.column("turn_hash"), batch.column("chars")]
        yield pa.record_batch(columns, [c.split()[0] for c in SCANNED.split(", ")])


def _continued(carried: dict[int, tuple[int, int, int]]):
    def run(batches):
        power = functools.lru_cache(4096)(lambda n: pow(STEP, n, PRIME))
        for batch in batches:
            places, ids, parents = [], [], []
            for part, c, pos, h, t in zip(*(batch.column(k).to_pylist() for k in ("part", "conv_id", "pos", "hash", "turn_hash")), strict=True):
                n = _number(h)
                conv, before, prefix = carried.get(part, (None, 0, 0))
                if conv == c:
                    n, pos = (prefix * power(pos + 1) + n) % PRIME, pos + before
                places.append(pos)
                ids.append(_bytes(n))
                parents.append(_bytes((n - _number(t)) * BACK % PRIME))
            columns = [batch.column("conv_id"), pa.array(places, pa.int64()), pa.array(ids, pa.binary()), pa.array(parents, pa.binary()), batch.column("chars"), batch.column("turn_hash")]
            yield pa.record_batch(columns, ["conv_id", "pos", "id", "parent", "chars", "turn_hash"])

    return run


def placed(turns: DataFrame, *order: str) -> DataFrame:
    """turns(conv_id, turn_hash, chars, ...) in their order within conversations: (conv_id, pos, id, parent, chars, turn_hash).

    pos counts from 0, id is the digest of the prefix that ends here, parent that of the one before. conv_id must not be null.
    """
    by = ["conv_id", *order]
    dealt = turns.repartitionByRange(*by).sortWithinPartitions(*by).select("conv_id", "turn_hash", "chars")
    scanned = staged(dealt.mapInArrow(_scan, SCANNED), "scanned")
    own = F.struct("conv_id", "pos")
    parts = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(own).alias("last"), F.max_by("hash", own).alias("hash")).collect()  # a row for each task
    carried, still = {}, None
    for r in sorted(parts, key=lambda r: r["part"]):
        conv, n, h = r["last"]["conv_id"], r["last"]["pos"] + 1, _number(r["hash"])
        if still and still[0] == r["first"]:
            carried[r["part"]] = still
            if conv == still[0]:  # all of this part
                n, h = still[1] + n, (still[2] * pow(STEP, n, PRIME) + h) % PRIME
        still = (conv, n, h)
    return scanned.mapInArrow(_continued(carried), PREFIXES + ", turn_hash binary")


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to (conv_id, turn, turn_hash, chars): texts go no further. Null role and text are empty, rows with a null conv_id are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id IS NOT NULL")
    return rows.select("conv_id", "turn", turn_hash(F.col("role"), F.col("text")).alias("turn_hash"), F.char_length("text").cast("long").alias("chars"))


def regrouped(conversations: DataFrame, group: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first turns are those of their group's head: (turns(conv_id, pos, turn_hash, chars), convs(conv_id)).

    With h = crc32(conv_id as text) % (most + 1), the first h turns of c are replaced by those of c - c % group, of which
    there may be fewer or none. % has the sign of c. Turns are in the order of `turn`, null first, ties by their digest.
    """
    turns = staged(placed(hashed_turns(conversations), "turn", "turn_hash"), "turns").select("conv_id", "pos", "turn_hash", "chars")
    head = F.when(F.col("pos") < most, F.struct("pos", "turn_hash", "chars"))
    convs = staged(turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(head)).alias("heads")), "convs")  # `most` turns each
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most + 1)).cast("int")
    base = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    joined = convs.join(base, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left")  # `group` rows for a base
    taken = F.coalesce(F.slice("base_heads", 1, F.col("h")), F.array().cast("array<struct<pos:bigint,turn_hash:binary,chars:bigint>>"))
    plan = staged(joined.withColumn("h", h).select("conv_id", "n", "h", taken.alias("taken")), "plan")
    lent = plan.select("conv_id", F.explode("taken").alias("t")).select("conv_id", "t.pos", "t.turn_hash", "t.chars")
    total = convs.agg(F.sum("n")).first()[0] or 0
    known = plan.select("conv_id", "n", "h", F.size("taken").alias("k"))
    own = joined_apart(turns, "conv_id", known, "n", total).where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "turn_hash", "chars")
    return lent.union(own), plan.select("conv_id")


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """nodes(id, parent, depth, values...) with each value summed over the node's subtree: (id, values...).

    A parent must be a row of its own, one less deep; depth 0 has none. Rounds double the distance that pointers go.
    """
    now = staged(nodes.select("id", F.when(F.col("depth") > 0, F.col("parent")).alias("up"), "depth", *values), "round")
    deepest, step = now.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        pointing = now.where(F.col("depth") >= step)
        gained = pointing.groupBy("up").agg(F.count("*").alias("fan"), *(F.sum(v).alias(f"more_{v}") for v in values)).withColumnRenamed("up", "of")
        summed = now.join(gained, F.col("id") == F.col("of"), "left")
        grown = [(F.col(v) + F.coalesce(F.col(f"more_{v}"), F.lit(0).cast("long"))).alias(v) for v in values]
        if 2 * step > deepest:
            return summed.select("id", *grown)
        summed = staged(summed.select("id", "up", "depth", *grown, F.coalesce("fan", F.lit(0).cast("long")).alias("fan")), "summed")
        total = summed.agg(F.sum("fan")).first()[0]
        ahead = summed.where("fan > 0").select(F.col("id").alias("up"), F.col("up").alias("next"), "fan")
        far = joined_apart(summed.where(F.col("depth") >= 2 * step).select("id", "depth", "up", *values), "up", ahead, "fan", total)
        near = summed.where(F.col("depth") < 2 * step).select("id", F.lit(None).cast("binary").alias("up"), "depth", *values)
        now, step = staged(far.select("id", F.col("next").alias("up"), "depth", *values).union(near), "round"), 2 * step
    return now.select("id", *values)


def _chunks(chunk: int):
    """Ascending ids of each node as text, in pieces of about so many bytes."""

    def run(batches):
        node, first, held, size = None, None, [], 0
        for batch in batches:
            rows = []
            for i, c in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if i != node or size >= chunk:
                    if held:
                        rows.append((node, first, ",".join(held)))
                    node, first, held, size = i, c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            yield _chunk_batch(rows)
        if held:
            yield _chunk_batch([(node, first, ",".join(held))])

    return run


def _chunk_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], ["id", "first", "ids"])


def _digests(batches):
    """SHA-256 over the pieces of each node, one after the other."""
    node, running = None, None
    for batch in batches:
        done = []
        for i, text in zip(batch.column("id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if i != node:
                if running:
                    done.append((node, running.hexdigest()))
                node, running = i, hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
        yield pa.record_batch([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["id", "sha"])
    if running:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], ["id", "sha"])


def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ends(id, conv_id) to (id, sha): SHA-256 of each id's conv_ids in ascending order, joined by commas.

    The order of bytes is the contract's, so a node's bytes pass one running hash; they arrive sorted, as pieces of text.
    """
    dealt = ends.select("id", "conv_id").repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces = dealt.mapInArrow(_chunks(chunk), "id binary, first long, ids string")
    return pieces.repartition("id").sortWithinPartitions("id", "first").mapInArrow(_digests, "id binary, sha string")


def prefix_trie(turns: DataFrame, convs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """turns(conv_id, pos, turn_hash, chars) and convs(conv_id), which also lists conversations without turns, to the trie's nodes.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member and the
    number of turns name a node. Without conversations there are no nodes; equal conversations share all of theirs.
    """
    prefixes = placed(turns, "pos").drop("turn_hash")
    of_turns = prefixes.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), (F.min("pos") + 1).alias("depth"), F.min("parent").alias("parent"), F.min("chars").alias("chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(ROOT).alias("id"), "conv_id", "n_convs", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("chars"))
    nodes = staged(of_turns.union(root), "nodes")
    children = nodes.where("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single")).withColumnRenamed("parent", "of")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    known = staged(nodes.join(children, F.col("id") == F.col("of"), "left").select(*nodes.columns, zero("n_children"), zero("n_single")), "known")
    shared = known.where("n_convs > 1")
    own_leaves = F.col("n_single") + (F.col("n_children") == 0).cast("long")
    sums = subtree_sums(shared.select("id", "parent", "depth", own_leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")), ["leaves", "saved"])
    last = prefixes.groupBy("conv_id").agg(F.max_by("id", "pos").alias("id")).withColumnRenamed("conv_id", "of")
    ends = convs.join(last, F.col("conv_id") == F.col("of"), "left").select(F.coalesce("id", F.lit(ROOT)).alias("id"), "conv_id")
    total = known.count()
    parents = shared.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("fan"))
    with_parent = joined_apart(known, "parent", parents, "fan", total)
    out = with_parent.join(sums.withColumnRenamed("id", "of_sum"), F.col("id") == F.col("of_sum"), "left").join(ends_digest(ends, chunk).withColumnRenamed("id", "of_end"), F.col("id") == F.col("of_end"), "left")
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
