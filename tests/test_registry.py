"""Each registered query of the raster part against its own DuckDB SQL on the same tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from umbrafold.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_the_text_operators(tmp_path):
    """A copy of the repository without the text operators, their tests and the pipeline imports, and registers all other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    code = "import __spark_entry__ as e, umbrafold; q = e.queries(); assert set(e.oracle_sql()) <= set(q); assert not any(n.startswith('op1') or n == 'pipeline' for n in q); print(umbrafold.__file__, len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    where, n = done.stdout.split()
    assert where.startswith(str(tmp_path)) and int(n) == len(registry.queries())


def test_tracks_use_every_event(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    got = registry.queries()["keyframe_tracks"](spark, sf)
    assert e.join(got, ["user_id", "event_type", "t"], "left_anti").count() == 0
    types = {r["user_id"]: r["n"] for r in e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).collect()}
    times = {r["user_id"]: r["n"] for r in e.groupBy("user_id").agg(F.countDistinct("t").alias("n")).collect()}
    assert got.count() == sum(types[u] * times[u] for u in types)


def test_tracks_are_dealt_once_by_the_number_of_events(spark, sf, monkeypatch):
    """The rows of all tracks, several for each event, are neither shuffled nor more in a task when there are more events."""
    from umbrafold.plans import relational

    monkeypatch.setattr(relational, "EVENTS_A_TASK", 100)
    df = registry.queries()["keyframe_tracks"](spark, sf)
    dealt = 1 + spark.read.parquet(f"{sf}/events.parquet").count() // 100
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == plan.count(f", {dealt}), REPARTITION_BY_NUM") > 0 and "BroadcastExchange" not in plan


def test_focus_blend_gives_every_pixel(spark, sf):
    labels = spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().count()
    assert registry.queries()["focus_blend"](spark, sf).select("label", "pos").distinct().count() == 64 * labels
