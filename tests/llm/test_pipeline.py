"""The pipeline stage by stage, each held against a plain version on its own input."""

from __future__ import annotations

import re

from fixtures import shingles
from pyspark.sql import functions as F

import corpus_pipeline
from umbrafold.llm.common import staged


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, staged(stage(spark, docs, sf), name))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == columns

    rows = {name: ({r["doc_id"]: r["text"] for r in before.collect()}, after.collect()) for name, (before, after) in seen.items()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before, after = rows["toxicity"]
    kept = {r["doc_id"] for r in after}
    assert all(i in kept for i in before if labels.get(i) == 0)

    before, after = rows["near_duplicates"]
    sets = {i: shingles(t) for i, t in before.items()}
    ids = sorted(sets)
    parent = {i: i for i in ids}
    top = lambda x: x if parent[x] == x else top(parent[x])
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in after} == {i for i in ids if top(i) == i}

    before, after = rows["decontamination"]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in after} == {i for i, t in before.items() if not any(q and len(q & shingles(t)) >= 0.75 * len(q) for q in items)}

    before, after = rows["secret_scans"]
    assert {r["doc_id"] for r in after} == set(before)
    assert not any(re.search(r"(?<![0-9a-f])[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r["text"]) for r in after)
    assigned = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{12,})""")
    assert not any(assigned.search(r["text"]) for r in after)
    untouched = {r["doc_id"]: r["text"] for r in after if "[SECRET]" not in r["text"]}
    assert all(before[i] == t for i, t in untouched.items()) and len(untouched) > 0.5 * len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)

    before, after = rows["packing"]
    assert {r["doc_id"] for r in after} == set(before)
    places, ends = {}, {}
    for r in after:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ends.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts in (*places.values(), *ends.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    assert all(sum(n for _, n in parts) <= 2048 for parts in places.values())


def test_toxic_documents_go(spark):
    """On a table with enough labels to learn from; some of its toxic documents hold no toxic word."""
    sf = "/root/testdata/sf0.1"
    kept = {r["doc_id"] for r in corpus_pipeline.toxicity(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic, clean = [i for i, t in labels.items() if t == 1], [i for i, t in labels.items() if t == 0]
    assert len(toxic) > 20 and sum(i in kept for i in toxic) < 0.2 * len(toxic) and sum(i in kept for i in clean) > 0.985 * len(clean)


def test_stages_take_odd_rows(spark, sf):
    """Null ids and texts, repeated rows, extra columns with the stages' own names, and no rows at all."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2000").limit(40)
    odd = docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")).union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))).union(docs.limit(2)).union(docs.limit(2).withColumn("text", F.lit("")))
    more = staged(docs.union(odd).withColumns({c: F.lit("x") for c in ("hit_id", "other_id", "own_hash", "other_hash", "hidden", "h", "m", "linked", "rep", "key", "label")}), "odd")
    now = more
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, more.limit(0), sf)
        assert empty.count() == 0
        now = staged(stage(spark, now, sf), name)
        assert now.count() > 0
        if name != "packing":
            assert now.columns == more.columns == empty.columns
            assert now.where("doc_id IS NULL").count() == 3  # these rows can't be named by another and none of them is toxic
