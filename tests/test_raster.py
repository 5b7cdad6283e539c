"""File sources, kernels, trees, logs and streams on small inputs whose results are known."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbrafold.operators import events, images, neighborhood, trees
from umbrafold.sources import files
from umbrafold.streaming import journals


def test_pnm_round_trip_and_errors(spark, tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes([0, 1, 2, 253, 254, 255]))
    (tmp_path / "b.ppm").write_bytes(b"P3 1 1 255\n9 8 7\n")
    (tmp_path / "c.pbm").write_bytes(b"P4\n9 1\n" + bytes([0b10101010, 0b10000000]))
    (tmp_path / "d.pgm").write_bytes(b"P5\n3 2\n255\n\x00")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert got["a.pgm"]["samples"] == [0, 1, 2, 253, 254, 255]
    assert (got["b.ppm"]["channels"], got["b.ppm"]["samples"]) == (3, [9, 8, 7])
    assert got["c.pbm"]["samples"] == [0, 1, 0, 1, 0, 1, 0, 1, 0]
    assert got["d.pgm"]["samples"] is None and got["d.pgm"]["error"]
    frame = spark.createDataFrame([("a", 3, 2, 1, [0, 1, 2, 253, 254, 255])], "name string, width int, height int, channels int, samples array<int>")
    content = files.encoded_pnm(frame).first()["content"]
    assert files.decode_pnm(bytes(content))[4].tolist() == [0, 1, 2, 253, 254, 255]


def test_sniff_and_listing(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "y.bin").write_bytes(b"P6 1 1 255\n")
    binary = spark.read.format("binaryFile").load(str(tmp_path))
    assert {r["path"][-5:]: r["format"] for r in files.sniffed(binary).collect()} == {"x.png": "png", "y.bin": "pnm"}
    assert [r["extension"] for r in files.listing(spark, str(tmp_path)).collect()] == ["png", "bin"]


def test_fits_stretch():
    cards = ["SIMPLE  =                    T", "BITPIX  =                   16", "NAXIS   =                    2", "NAXIS1  =                    2", "NAXIS2  =                    2", "BZERO   =                   10", "END"]
    head = "".join(c.ljust(80) for c in cards).ljust(2880).encode()
    w, h, _, depth, samples = files.decode_fits(head + np.array([0, 10, 20, 40], ">i2").tobytes())
    assert (w, h, depth, samples.tolist()) == (2, 2, 65535, [0, 16384, 32768, 65535])


def test_cube_and_data_sets(spark, tmp_path):
    (tmp_path / "t.cube").write_text('TITLE "x"\nLUT_3D_SIZE 2\n' + "".join(f"{r} {g} {b}\n" for b in (0, 1) for g in (0, 1) for r in (0, 1)))
    rows = files.cube_table(spark, str(tmp_path / "t.cube")).collect()
    assert len(rows) == 8 and all((r["i"], r["j"], r["k"]) == (r["r"], r["g"], r["b"]) for r in rows)
    (tmp_path / "s.csv").write_text('title,shown\n"a, ""b""\nc",yes\nd,no\n')
    got = {(r["variable"], r["value"]) for r in files.data_sets(spark, str(tmp_path / "s.csv"), ["title", "shown"]).collect()}
    assert got == {("title", 'a, "b"\nc'), ("shown", "yes"), ("title", "d"), ("shown", "no")}
    with pytest.raises(ValueError, match="unknown"):
        files.data_sets(spark, str(tmp_path / "s.csv"), ["title"])


def test_separable_equals_square(spark):
    rows = [(k, np.random.default_rng(k).integers(0, 256, 35).tolist()) for k in range(5)]
    df = spark.createDataFrame(rows, "id int, codes array<int>")
    c = F.col("codes")
    both = df.select(neighborhood.box_sum(c, 2, 7, 5).alias("a"), neighborhood.gathered(c, neighborhood.square(2), 7, 5, neighborhood.total).alias("b"), neighborhood.minimum(c, 1, 7, 5).alias("m"), neighborhood.gathered(c, neighborhood.square(1), 7, 5, F.array_min).alias("n"))
    assert all(r["a"] == r["b"] and r["m"] == r["n"] for r in both.collect())


def test_kernels_by_image(spark):
    img = [255 if (k % 8 in (0, 7)) else 0 for k in range(64)]
    df = spark.createDataFrame([(1, img)], "vec_id long, codes array<int>")
    assert sorted((r["n"], r["x0"], r["x1"]) for r in images.components(df).collect()) == [(8, 0, 1), (8, 7, 8)]
    assert {r["pos"] % 8 for r in images.wand(df, 3, 3, 5).collect()} == {1, 2, 3, 4, 5, 6}
    power = {(r["u"], r["v"]): r["power"] for r in images.spectrum(df).collect()}
    assert power[0, 0] == sum(img) ** 2
    assert {r["out"] for r in images.error_diffused(df).collect()} == {0, 255}


def test_trees(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent string")
    assert {(r["id"], r["depth"]) for r in trees.levels(nodes).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 1)}
    assert trees.problems(nodes).count() == 0
    cyclic = spark.createDataFrame([("a", None), ("b", "c"), ("c", "b"), ("e", "x"), ("a", None)], "id string, parent string")
    assert {(r["id"], r["problem"]) for r in trees.problems(cyclic).collect()} == {("a", "duplicate"), ("e", "orphan")}
    with pytest.raises(ValueError, match="cycle"):
        trees.levels(cyclic)


def test_interpolation_ends_and_easing(spark):
    keys = spark.createDataFrame([(1, 10, 0.0), (1, 20, 10.0)], "g int, t long, value double")
    asks = spark.createDataFrame([(1, 5), (1, 10), (1, 15), (1, 20), (1, 25), (2, 1)], "g int, t long")
    got = {(r["g"], r["t"]): r["value"] for r in events.interpolated(keys, asks, "g").collect()}
    assert got == {(1, 5): 0.0, (1, 10): 0.0, (1, 15): 5.0, (1, 20): 10.0, (1, 25): 10.0, (2, 1): None}
    assert {r["t"]: r["value"] for r in events.interpolated(keys, asks, "g", "ease_in").collect()}[15] == 2.5


def test_a_long_track_takes_one_look_back(spark):
    """Frames that reach to a group's end are computed anew for each row, and a second order sorts all asks again."""
    n = 50_000
    keys = spark.range(n).selectExpr("1 g", "id * 10 t", "cast(id * id AS double) value")
    asks = spark.range(n).selectExpr("1 g", "id * 10 + 5 t")
    df = events.interpolated(keys, asks, "g")
    plan = df._jdf.queryExecution().executedPlan().toString().lower()
    assert "unboundedfollowing" not in plan and plan.count("window [") == 2  # one over the keys alone
    assert df.where("value != CASE WHEN t > 499990 THEN 49999D * 49999 ELSE ((t - 5) / 10 * (t - 5) / 10 + (t + 5) / 10 * (t + 5) / 10) / 2 END").count() == 0
    assert df.count() == n


def test_journal_recovery_and_replay(spark, tmp_path):
    lines = [json.dumps({"seq": k, "kind": "Command", "payload": str(k), "document_hash": "h"}) for k in range(4)]
    (tmp_path / "j.json").write_text("\n".join([*lines[:3], '{"seq": 3, "ki', lines[3]]))
    assert sorted(r["seq"] for r in events.recovered(files.journal(spark, str(tmp_path))).collect()) == [0, 1, 2]
    log = spark.createDataFrame([("a", 1, "set", 1.0), ("a", 2, "clear", None), ("b", 1, "set", 5.0)], "k string, o int, action string, value double")
    assert [(r["k"], r["value"]) for r in events.replayed(log, "k", "o").collect()] == [("b", 5.0)]


def test_absorb_adds_each_record_once(spark, tmp_path):
    side, target = tmp_path / "side", str(tmp_path / "log")
    side.mkdir()
    write = lambda name, ids: (side / name).write_text("\n".join(json.dumps({"seq": k, "kind": "Command", "payload": "", "document_hash": ""}) for k in ids))
    write("1.json", [1, 2, 2])
    for n, k in ((2, "c1"), (3, "c1"), (3, "c2")):  # c2 starts anew and reads all files again
        if n == 3 and k == "c1":
            write("2.json", [2, 3])
        q = journals.absorb(journals.follow(spark, str(side)), target, str(tmp_path / k))
        q.processAllAvailable()
        q.stop()
        assert sorted(r["seq"] for r in spark.read.parquet(target).collect()) == list(range(1, n + 1))


def test_frames_as_stream(spark, tmp_path, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = journals.frames(stream).writeStream.format("memory").queryName("frames").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT sum(n) AS n FROM frames").first()["n"]
    assert got == e.count()


def test_palettes(spark):
    from umbrafold.operators import palettes

    rows = [(250, 0, 0)] * 30 + [(252, 2, 1)] * 10 + [(0, 0, 200)] * 20 + [(0, 220, 0)] * 5
    px = spark.createDataFrame(rows, "r int, g int, b int")
    found = palettes.median_cut(palettes.color_histogram(px), 3)
    assert len(found) == 3
    entry = px.select("r", palettes.nearest_entry((F.col("r"), F.col("g"), F.col("b")), found).alias("e"))
    assert all(abs(found[r["e"]][0] - r["r"]) <= 2 for r in entry.collect())
    assert palettes.median_cut(palettes.color_histogram(px.limit(0)), 4) == [] and len(palettes.web_palette()) == 216


def test_whole_image_kernels_take_any_width(spark):
    rows = [(0, 0, [255, 0, 0, 0, 0, 255, 255, 0, 0, 255, 0, 0])]  # 6 wide, 2 high
    df = spark.createDataFrame(rows, "vec_id long, label int, codes array<int>")
    assert sorted((r["n"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in images.components(df, width=6).collect()) == [(1, 3, 1, 4, 2), (1, 5, 0, 6, 1), (2, 0, 0, 1, 2)]
    assert {r["pos"] for r in images.wand(df, 0, 1, 5, width=6).collect()} == {0, 6}
    assert images.spectrum(df, width=6).where("u = 0 AND v = 0").first()["power"] == (4 * 255) ** 2
