from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame, shingles

from umbrafold.llm import common, ordinal, sketch_join
from umbrafold.llm.common import mixed
from umbrafold.llm.components import connected_components
from umbrafold.llm.sketch_join import jaccard_components, short_sketch, sketch_distance


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if any(100 * len(x & y) >= 75 * len(x | y) for x in sets[i] for y in sets[j] if x and y):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), None if i is None else top(i)) for i in sets for s in sets[i]}


def test_equals_brute_force_with_odd_rows(spark):
    rows = corpus()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_components(frame(spark, rows)).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute(rows)


def test_frequent_keys_and_big_groups(spark, monkeypatch):
    """Families larger than a small group, whose members mostly link only by way of one of them."""
    monkeypatch.setattr(sketch_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(sketch_join, "REPEATED", 1)
    base, r = [f"w{k}" for k in range(200)], random.Random(3)
    rows = [(500, " ".join(base))]
    for k in range(40):
        own = list(base)
        for i in r.sample(range(200), 2 + k % 6):
            own[i] = f"x{k}_{i}"
        rows.append((k, " ".join(own)))
    got = {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_components(frame(spark, rows).repartition(5)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_links_of_big_groups_are_all_counted(spark, monkeypatch, block):
    """A family that shares frequent keys, in several batches and blocks, against all pairs."""
    monkeypatch.setattr(sketch_join, "SMALL_GROUP", 4)
    monkeypatch.setattr(sketch_join, "REPEATED", 1)
    monkeypatch.setattr(sketch_join, "BLOCK", block)
    base, r = [f"w{k}" for k in range(200)], random.Random(3)
    rows = [(500, " ".join(base)), (501, " ".join(base))]
    for k in range(40):
        own = list(base)
        for i in r.sample(range(200), 2 + k % 4):
            own[i] = f"x{k}_{i}"
        rows.append((k, " ".join(own)))
    sets = {i: shingles(t) for i, t in rows}
    distinct = {frozenset(s) for s in sets.values()}
    links = {i: sum(100 * len(s & o) >= 75 * len(s | o) for o in distinct if o != s) for i, s in sets.items()}
    table = frame(spark, rows).repartition(5)
    assert {x["doc_id"]: x["n_links"] for x in jaccard_components(table).collect()} == links and max(links.values()) > 20
    assert {(x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_components(table, count_links=False).collect()} == brute(rows)


def test_links_of_a_family_are_counted_without_a_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(sketch_join, "SMALL_GROUP", 8)
    monkeypatch.setattr(sketch_join, "REPEATED", 1)
    monkeypatch.setattr(sketch_join, "BLOCK", 100)
    made, staged = {}, sketch_join.staged

    def counting(df, name):
        out = staged(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(sketch_join, "staged", counting)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: k % 59], f"x{k}", *base[k % 59 + 1 :]])) for k in range(240)]
    sets = {i: shingles(t) for i, t in rows}
    links = {i: sum(100 * len(s & o) >= 75 * len(s | o) for o in sets.values()) - 1 for i, s in sets.items()}
    assert {x["doc_id"]: x["n_links"] for x in jaccard_components(frame(spark, rows).repartition(3)).collect()} == links
    assert sum(links.values()) > 20_000 and max(made.get(k, 0) for k in ("pairs", "links", "sets", "components", "members")) < 10 * len(rows)


def test_words_are_hashed_as_words(monkeypatch):
    r, seen = random.Random(1), {}
    for piece in (common.PIECE, 50, 7, 1):
        monkeypatch.setattr(common, "PIECE", piece)
        for _ in range(200):
            text = "".join(r.choices("abAB \t\n\x0b\x1c\u00e9\u3000", k=r.randint(0, 60))).encode()
            found = common.word_hashes(text).tolist()
            assert len(found) == len(common.words_of(text)) and all(seen.setdefault(w, h) == h for w, h in zip(common.words_of(text), found, strict=True))
    assert len(set(seen.values())) == len(seen) > 500


def test_links_of_odd_rows(spark):
    rows = [(i, t) for i, t in corpus() if i is not None and i not in (5009, 5010)]
    sets = {i: shingles(t) for i, t in rows}
    distinct = {frozenset(s) for s in sets.values() if s}
    links = {i: sum(100 * len(s & o) >= 75 * len(s | o) for o in distinct if o != s) if s else 0 for i, s in sets.items()}
    assert {x["doc_id"]: x["n_links"] for x in jaccard_components(frame(spark, rows)).collect()} == links


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [])).count() == 0


def test_sketch_distance_is_a_lower_bound():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 90), dtype=np.uint64))
        b = np.unique(np.concatenate((r.choice(a, len(a) // 2 + 1, replace=False), r.integers(0, 1 << 63, r.integers(1, 300), dtype=np.uint64))))
        assert sketch_distance(short_sketch(mixed(a)), short_sketch(mixed(b))) <= len(np.setxor1d(a, b))


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    random.Random(5).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:], strict=False), (7, 7), (None, 3), (100, 101)], "u long, v long")
    got = {r["id"]: r["component"] for r in connected_components(edges).collect()}
    assert got == {**dict.fromkeys(ids, 0), 100: 100, 101: 100}


def test_copies_are_told_by_whole_digest():
    import numpy as np

    from umbrafold.llm.sketch_join import _digest, _is_copy

    digests = [_digest(np.array([k], np.uint64)) for k in range(5)]
    rows = sorted((*np.frombuffer(d, np.int64).tolist(), 100 + k) for k, d in enumerate(digests[:3]))
    hi, lo, rep = (np.array(c, np.int64) for c in zip(*rows, strict=True))
    assert all(not _is_copy(100 + k, d, (hi, lo, rep)) and _is_copy(200 + k, d, (hi, lo, rep)) for k, d in enumerate(digests[:3]))
    assert not any(_is_copy(1, d, (hi, lo, rep)) for d in digests[3:])
    assert not _is_copy(200, digests[0], (hi, lo ^ 1, rep))  # the first half alone is no match
    assert not _is_copy(1, digests[0], (hi[:0], lo[:0], rep[:0]))


def test_a_batch_of_texts_is_worked_on_in_parts(monkeypatch):
    """Neither texts nor sets nor sketch words of a whole Arrow batch are in memory at once, and the parts give what the whole gives."""
    batch = pa.record_batch([pa.array(range(5000), pa.int64()), pa.array([f"a b {k} d e f" for k in range(5000)])], ["doc_id", "text"])
    sets = list(sketch_join._sets([batch]))
    assert max(b.num_rows for b in sets) <= common.AT_ONCE and sum(b.num_rows for b in sets) == 5000
    told = list(sketch_join._describe(1 << 19)([batch]))
    assert max(b.num_rows for b in told) <= sketch_join.GATHERED and sum(b.num_rows - b.column("n_shingles").null_count for b in told) == 5000

    seen, model = [], ordinal.OrdinalModel({"bad": 0}, np.array([9.0]), np.array([3.0]))
    plain = model.at_most(["bad bad", "good", None] * 300)[:, 0]
    at_most = ordinal.OrdinalModel.at_most
    monkeypatch.setattr(ordinal.OrdinalModel, "at_most", lambda self, texts, known: (seen.append(len(texts)), at_most(self, texts, known))[1])
    kept = ordinal.harmless(pa.array(["bad bad", "good", None] * 300), model, ordinal.Known(model.features))
    assert kept.to_pylist() == (1 - plain < 0.5).tolist() == [False, True, True] * 300 and max(seen) <= common.AT_ONCE
    assert len(ordinal.harmless(pa.array([], pa.string()), model, ordinal.Known(model.features))) == 0
