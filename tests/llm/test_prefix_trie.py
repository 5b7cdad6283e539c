"""op11 against a plain trie in Python: the given conversations, and odd ones."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from conftest import SF
from pyspark.sql import functions as F

from umbrafold.llm import prefix_trie, queries

ROWS = "conv_id long, turn long, role string, text string, pos long, n long, fan long, id string, up string"


def plain_digest(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain_nodes(rows: list[tuple]) -> set[tuple]:
    """The contract's nodes from (conv_id, turn, role, text)."""
    own: dict = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, plain_digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(x)] for c, x in own.items()}
    members: dict = {}
    ends: dict = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - int(c - 100 * int(c / 100)), [])
        rebuilt = (*base[:h], *turns[h:])
        for d in range(len(rebuilt) + 1):
            members.setdefault(rebuilt[:d], []).append(c)
        ends.setdefault(rebuilt, []).append(c)
    children: dict = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) or 1
        saved[node] = sum(saved[x] for x in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return {(min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children.get(x, [])), leaves[x], saved[x], sha(x)) for x, m in members.items()}


def odd_rows() -> list[tuple]:
    r = random.Random(5)
    rows = [(c, t, ("user", "assistant")[t % 2], f"{r.choice('abc')} é{r.choice('xy')}") for c in range(90, 230) for t in range(r.randint(0, 7))]
    rows += [(c, t, "user", "same" if t < 3 else f"own {c % 7}") for c in range(300, 420) for t in range(5)]  # one prefix of many
    rows += [(500, t, "user", f"turn {t}") for t in range(700)] + [(511, t, "user", f"turn {t}") for t in range(700)]  # deep, shared
    rows += [(601, None, None, None), (601, 3, "user", "x"), (601, 3, "user", "x"), (601, 3, "user", "y"), (601, -2, "", ""), (None, 0, "user", "nobody"), (-105, 0, "user", "negative"), (-100, 0, "user", "base of it"), (702, 0, "user", "long " * 50_000)]
    r.shuffle(rows)
    return rows


def found(df) -> set[tuple]:
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def trie(df):
    return prefix_trie.prefix_trie(*prefix_trie.regrouped(df))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_the_query_equals_a_plain_trie(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_prefix_trie(spark, sf)) == plain_nodes(rows)


def test_odd_conversations_equal_a_plain_trie(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, "i", "u") for r in rows], ROWS)
    assert found(trie(df)) == plain_nodes(rows)
    assert found(trie(df.where("conv_id = 601"))) == plain_nodes([r for r in rows if r[0] == 601])


def test_a_conversation_over_many_tasks_and_hot_nodes(spark, monkeypatch):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, "i", "u") for r in rows], ROWS).where("conv_id >= 300")
    monkeypatch.setattr("umbrafold.llm.common.HOT_KEYS", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = found(prefix_trie.prefix_trie(*prefix_trie.regrouped(df), chunk=40))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == plain_nodes([r for r in rows if r[0] is not None and r[0] >= 300])


def test_turnless_conversations_and_empty_tables(spark):
    df = spark.createDataFrame([], ROWS)
    assert found(trie(df)) == set()
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 1)
    rows = [(c, 0, "user", "replaced by nothing")]
    assert found(trie(spark.createDataFrame([(*r, 1, 2, 3, "i", "u") for r in rows], ROWS))) == plain_nodes(rows) == {(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())}


def test_sums_over_any_forest(spark):
    r = random.Random(3)
    parents = {k: r.randrange(max(0, k - 4), k) if k % 50 else None for k in range(1, 400)} | {0: None}
    depth: dict = {}
    for k in sorted(parents):
        depth[k] = 0 if parents[k] is None else depth[parents[k]] + 1
    want = {k: 0 for k in parents}
    for k in parents:
        at = k
        while at is not None:
            want[at] += k
            at = parents[at]
    name = lambda k: None if k is None else str(k).encode()
    nodes = spark.createDataFrame([(name(k), name(p), depth[k], k) for k, p in parents.items()], "id binary, parent binary, depth long, v long")
    got = {int(bytes(x["id"])): x["v"] for x in prefix_trie.subtree_sums(nodes, ["v"]).collect()}
    assert got == want and prefix_trie.subtree_sums(nodes.where(F.lit(False)), ["v"]).count() == 0
