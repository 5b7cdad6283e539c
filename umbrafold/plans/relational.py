"""Lookups, joins, trees, logs and set operations over the tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbrafold.functions.blend import blend_channel
from umbrafold.operators import events as ev
from umbrafold.operators import images as im
from umbrafold.operators import style_runs, trees
from umbrafold.sources.rasters import PX_SQL, images, pixels

QUERIES: dict = {}


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = (fn, sql)
        return fn

    return keep


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TILES_SQL = f"WITH {PX_SQL}, tiles AS (SELECT vec_id, x // 4 AS tx, y // 4 AS ty, md5(string_agg(code::VARCHAR, ',' ORDER BY pos)) AS hash FROM px GROUP BY ALL)"


def tiles(spark, sf_dir: str) -> DataFrame:
    """Content-addressed 4 x 4 tiles of the images."""
    px = pixels(spark, sf_dir).withColumns({"tx": F.floor(F.col("x") / 4).cast("int"), "ty": F.floor(F.col("y") / 4).cast("int")})
    members = F.array_sort(F.collect_list(F.struct("pos", "code")))  # 16 pixels
    return px.groupBy("vec_id", "tx", "ty").agg(F.md5(F.array_join(F.transform(members, lambda m: m["code"].cast("string")), ",")).alias("hash"))


@query(TILES_SQL + " SELECT vec_id, tx, ty, hash FROM tiles")
def tile_hashes(spark, sf_dir: str) -> DataFrame:
    return tiles(spark, sf_dir)


@query(TILES_SQL + ", b AS (SELECT hash, min(vec_id) AS owner, count(*) AS refs FROM tiles GROUP BY hash) SELECT t.vec_id, t.tx, t.ty, b.owner, b.refs FROM tiles t JOIN b USING (hash)")
def tile_lookup(spark, sf_dir: str) -> DataFrame:
    t = tiles(spark, sf_dir)
    blobs = t.groupBy("hash").agg(F.min("vec_id").alias("owner"), F.count("*").alias("refs"))
    return t.join(blobs, "hash").select("vec_id", "tx", "ty", "owner", "refs")


_RECTS = "rects AS (SELECT l_orderkey AS id, l_linenumber AS ln, CAST(l_quantity AS INT) AS x0, CAST(l_quantity AS INT) + CAST(l_linenumber AS INT) * 8 AS x1 FROM lineitem)"


@query(f"WITH {_RECTS} SELECT CAST(t AS INT) AS tile, CAST(count(*) AS BIGINT) AS n, CAST(sum(ln) AS BIGINT) AS lines FROM rects, range(0, 20) r(t) WHERE x0 < (t + 1) * 8 AND x1 > t * 8 GROUP BY t")
def region_tiles(spark, sf_dir: str) -> DataFrame:
    """Tiles that each interval covers, listed from its ends instead of joined with all tiles."""
    x0 = F.col("l_quantity").cast("int")
    x1 = x0 + F.col("l_linenumber").cast("int") * 8
    cover = F.explode(F.sequence(F.floor(x0 / 8).cast("int"), F.floor((x1 - 1) / 8).cast("int")))
    return _table(spark, sf_dir, "lineitem").select("l_linenumber", cover.alias("tile")).groupBy("tile").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))


PALETTE = (0, 60, 90, 128, 150, 190, 255)


@query(f"WITH {PX_SQL}, pal AS (SELECT unnest({list(PALETTE)}) AS c, unnest(range({len(PALETTE)})) AS idx), d AS (SELECT vec_id, pos, idx, row_number() OVER (PARTITION BY vec_id, pos ORDER BY (code - c) * (code - c), idx) AS k FROM px, pal) SELECT vec_id, pos, CAST(idx AS INT) AS idx FROM d WHERE k = 1")
def nearest_palette(spark, sf_dir: str) -> DataFrame:
    """The palette's nearest entry, the lower index at a tie; the palette is an array in the expression."""
    best = F.array_min(F.transform(F.array(*map(F.lit, PALETTE)), lambda c, i: F.struct(((F.col("code") - c) * (F.col("code") - c)).alias("d"), i.alias("i"))))
    return pixels(spark, sf_dir).select("vec_id", "pos", best["i"].alias("idx"))


_KEYS = "k AS (SELECT user_id, epoch_us(ts) AS t, avg(value) AS value FROM events WHERE event_id % 3 = 0 GROUP BY ALL), a AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events WHERE event_id % 3 = 1)"


@query(
    f"WITH {_KEYS}, p AS (SELECT a.user_id, a.t, k.t AS pt, k.value AS pv FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t >= k.t), n AS (SELECT a.user_id, a.t, k.t AS nt, k.value AS nv FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.t) "
    "SELECT p.user_id, p.t, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((p.t - pt)::DOUBLE / (nt - pt)::DOUBLE) END, 4) AS value FROM p JOIN n USING (user_id, t)"
)
def keyframe_asof(spark, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))").alias("t"), "value")
    keys = e.where("event_id % 3 = 0").groupBy("user_id", "t").agg(F.avg("value").alias("value"))
    asks = e.where("event_id % 3 = 1").select("user_id", "t").distinct()
    return ev.interpolated(keys, asks, "user_id").withColumn("value", F.round("value", 4))


EVENTS_A_TASK = 100_000
_TRACKS = "k AS (SELECT user_id, event_type, epoch_us(ts) AS t, avg(value) AS value FROM events GROUP BY ALL), a AS (SELECT DISTINCT e.user_id, d.event_type, epoch_us(e.ts) AS t FROM events e JOIN (SELECT DISTINCT user_id, event_type FROM events) d ON d.user_id = e.user_id)"


@query(
    f"WITH {_TRACKS}, p AS (SELECT a.*, k.t AS pt, k.value AS pv FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.event_type = k.event_type AND a.t >= k.t), n AS (SELECT a.*, k.t AS nt, k.value AS nv FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.event_type = k.event_type AND a.t <= k.t) "
    "SELECT p.user_id, p.event_type, p.t, round(CASE WHEN pt IS NULL THEN nv WHEN nt IS NULL THEN pv WHEN nt = pt THEN pv ELSE pv + (nv - pv) * ((p.t - pt)::DOUBLE / (nt - pt)::DOUBLE) END, 4) AS value FROM p JOIN n USING (user_id, event_type, t)"
)
def keyframe_tracks(spark, sf_dir: str) -> DataFrame:
    """Each user's event types as tracks, all read at the time of each of the user's events; every event is a key and asks all tracks."""
    e = _table(spark, sf_dir, "events").select("user_id", "event_type", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))").alias("t"), "value")
    e = e.repartition(1 + e.count() // EVENTS_A_TASK, "user_id")  # dealt once; all steps below stay within a user
    keys = e.groupBy("user_id", "event_type", "t").agg(F.avg("value").alias("value"))
    asks = e.select("user_id", "t").distinct().join(e.select("user_id", "event_type").distinct().hint("shuffle_hash"), "user_id")
    return ev.interpolated(keys, asks, ["user_id", "event_type"]).select("user_id", "event_type", "t", F.round("value", 4).alias("value"))


@query("WITH f AS (SELECT o_orderkey AS id, 1000 + CAST(o_orderkey % 7 AS INT) * 500 AS len, 12 + CAST(o_orderkey % 3 AS INT) * 6 AS fps FROM orders), g AS (SELECT id, len, fps, i FROM f, range(0, 200) r(i) WHERE i < ceil(len * fps / 1000)) SELECT id, CAST(i AS INT) AS frame, CAST(floor(i * 1000 / fps + 0.5) AS INT) AS start_ms, CAST(least(floor((i + 1) * 1000 / fps + 0.5), len) - floor(i * 1000 / fps + 0.5) AS INT) AS dur_ms FROM g")
def frame_grid(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (1000 + (F.col("o_orderkey") % 7).cast("int") * 500).alias("len"), (12 + (F.col("o_orderkey") % 3).cast("int") * 6).alias("fps"))
    return o.select("id", F.inline(ev.frame_times(F.col("fps"), F.col("len"))))


@query("WITH w AS (SELECT user_id, ts, event_id, value FROM events), c AS (SELECT *, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ahead FROM w) SELECT user_id, event_id, round(ahead, 3) AS ends FROM c")
def frame_ends(spark, sf_dir: str) -> DataFrame:
    """Where each clip of a track ends: running sums of durations."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _table(spark, sf_dir, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 3).alias("ends"))


@query("SELECT md5(text) AS h, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def gc_anti(spark, sf_dir: str) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def retain_semi(spark, sf_dir: str) -> DataFrame:
    c, o = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS refs FROM orders GROUP BY 1")
def refcounts(spark, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("refs"))


_NODES = "nodes AS (SELECT 'r' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query(f"WITH RECURSIVE {_NODES}, w AS (SELECT id, 0 AS depth, id AS path FROM nodes WHERE parent IS NULL UNION ALL SELECT n.id, w.depth + 1, w.path || '/' || n.id FROM nodes n JOIN w ON n.parent = w.id) SELECT id, CAST(depth AS INT) AS depth, path FROM w")
def tree_depth_first(spark, sf_dir: str) -> DataFrame:
    tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
    nodes = (
        _table(spark, sf_dir, "region").select(tag("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
        .union(_table(spark, sf_dir, "nation").select(tag("n", "n_nationkey"), tag("r", "n_regionkey")))
        .union(_table(spark, sf_dir, "supplier").select(tag("s", "s_suppkey"), tag("n", "s_nationkey")))
    )
    return trees.levels(nodes).select("id", "depth", F.array_join("path", "/").alias("path"))


@query("WITH s AS (SELECT l_orderkey, l_linenumber, sum(CASE WHEN l_returnflag <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM lineitem) SELECT l_orderkey, CAST(run AS BIGINT) AS run, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1, 2")
def clipping_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of clipped lines on the base line below them."""
    marked = trees.runs(_table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], F.col("l_returnflag") != "N")
    return marked.groupBy("l_orderkey", "run").agg(F.count("*").alias("n"))


@query("WITH m AS (SELECT user_id, max(event_id) AS marked FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT e.user_id, CAST(count(*) AS BIGINT) AS n FROM events e LEFT JOIN m USING (user_id) WHERE marked IS NULL OR event_id > marked GROUP BY 1")
def journal_suffix(spark, sf_dir: str) -> DataFrame:
    left = ev.after_last_marker(_table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "purchase")
    return left.groupBy("user_id").agg(F.count("*").alias("n"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) SELECT user_id, value FROM r WHERE k = 1 AND event_type <> 'logout'")
def replay_state(spark, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").withColumn("action", F.when(F.col("event_type") == "logout", "clear").otherwise("set"))
    return ev.replayed(e, "user_id", "event_id")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k <= 20")
def history_cap(spark, sf_dir: str) -> DataFrame:
    """The newest 20 commands of each history."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))
    return _table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k")).where("k <= 20").drop("k")


@query("SELECT r_regionkey AS set_no, n_nationkey AS variable, r_name || ':' || n_name AS value FROM region, nation")
def dataset_cross(spark, sf_dir: str) -> DataFrame:
    """Every data set for every bound layer; both are small tables by nature."""
    return _table(spark, sf_dir, "region").crossJoin(_table(spark, sf_dir, "nation")).select(F.col("r_regionkey").alias("set_no"), F.col("n_nationkey").alias("variable"), F.concat_ws(":", "r_name", "n_name").alias("value"))


@query(f"WITH {PX_SQL}, s AS (SELECT label, pos, list(code / 255.0::DOUBLE ORDER BY vec_id) AS l FROM px GROUP BY ALL) SELECT label, pos, round(list_reduce(l, lambda b, c: b + (b + c - b * c - b) * 0.25), 6) AS out FROM s")
def stack_composite(spark, sf_dir: str) -> DataFrame:
    """The images of a label laid over each other in order of vec_id, screen mode at a quarter's opacity; a stack has as many layers as its document."""
    px = pixels(spark, sf_dir).groupBy("label", "pos").agg(F.array_sort(F.collect_list(F.struct("vec_id", (F.col("code") / F.lit(255.0)).alias("v")))).alias("l"))
    v = F.transform("l", lambda s: s["v"])
    fold = F.aggregate(F.slice(v, 2, F.size(v)), F.get(v, F.lit(0)), lambda b, c: b + (blend_channel("screen", b, c) - b) * 0.25)
    return px.select("label", "pos", F.round(fold, 6).alias("out"))


@query(f"WITH {PX_SQL}, v AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS z FROM embeddings) SELECT a.vec_id AS upper_id, b.vec_id AS lower_id, CAST(sum(abs(p.code - q.code)) AS BIGINT) AS difference FROM v a JOIN v b ON a.label = b.label AND a.z = b.z + 1 JOIN px p ON p.vec_id = a.vec_id JOIN px q ON q.vec_id = b.vec_id AND q.pos = p.pos GROUP BY 1, 2")
def layer_differences(spark, sf_dir: str) -> DataFrame:
    """Each layer against the one below it, from the two arrays."""
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("vec_id")
    img = images(spark, sf_dir).select("vec_id", "codes", F.lag("vec_id").over(w).alias("lower_id"), F.lag("codes").over(w).alias("lower"))
    diff = F.aggregate(F.zip_with("codes", "lower", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda t, d: t + d)
    return img.where("lower_id IS NOT NULL").select(F.col("vec_id").alias("upper_id"), "lower_id", diff.alias("difference"))


@query("SELECT o_orderkey, lower(trim(o_orderpriority)) IN ('1-urgent', '2-high') AS visible, regexp_replace(o_orderpriority, '[^A-Za-z0-9_() -]', '_', 'g') AS stem, o_orderstatus || ' copy' AS copy_name FROM orders")
def layer_names(spark, sf_dir: str) -> DataFrame:
    o = _table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.lower(F.trim("o_orderpriority")).isin("1-urgent", "2-high").alias("visible"), F.regexp_replace("o_orderpriority", r"[^A-Za-z0-9_() -]", "_").alias("stem"), F.concat("o_orderstatus", F.lit(" copy")).alias("copy_name"))


@query(None)
def image_components(spark, sf_dir: str) -> DataFrame:
    return im.components(images(spark, sf_dir))


@query(None)
def wand_contiguous(spark, sf_dir: str) -> DataFrame:
    return im.wand(images(spark, sf_dir), 3, 3, 24)


@query(None)
def fft_power(spark, sf_dir: str) -> DataFrame:
    return im.spectrum(images(spark, sf_dir))


@query(None)
def dither_diffusion(spark, sf_dir: str) -> DataFrame:
    return im.error_diffused(images(spark, sf_dir))


_RUN = """runs AS (SELECT l_orderkey AS text, l_partkey % 50 - 3 AS s, l_partkey % 50 - 3 + CAST(l_quantity AS BIGINT) % 20 AS e, l_linenumber AS ord,
  CASE WHEN l_returnflag <> 'N' THEN l_returnflag || l_linestatus END AS family, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 3 END AS weight FROM lineitem),
cut AS (SELECT text, greatest(s, 0) AS s, least(e, 40) AS e, ord, family, weight FROM runs WHERE greatest(s, 0) < least(e, 40))"""


@query(f"""WITH {_RUN}, places AS (SELECT text, s AS at_ FROM cut UNION SELECT text, e FROM cut UNION SELECT o_orderkey, 0 FROM orders UNION SELECT o_orderkey, 40 FROM orders),
parts AS (SELECT text, at_ AS s, lead(at_) OVER (PARTITION BY text ORDER BY at_) AS e FROM places),
valued AS (SELECT p.text, p.s, p.e, coalesce((max({{'o': c.ord, 'v': c.family}}) FILTER (c.family IS NOT NULL)).v, 'PLAIN') AS family, coalesce((max({{'o': c.ord, 'v': c.weight}}) FILTER (c.weight IS NOT NULL)).v, 4) AS weight
  FROM parts p LEFT JOIN cut c ON c.text = p.text AND c.s <= p.s AND c.e > p.s WHERE p.e IS NOT NULL GROUP BY p.text, p.s, p.e),
marked AS (SELECT *, CASE WHEN lag(family) OVER w = family AND lag(weight) OVER w = weight THEN 0 ELSE 1 END AS fresh FROM valued WINDOW w AS (PARTITION BY text ORDER BY s)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY text ORDER BY s) AS run FROM marked)
SELECT text, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end", any_value(family) AS family, CAST(any_value(weight) AS BIGINT) AS weight FROM numbered GROUP BY text, run""")
def style_stretches(spark, sf_dir: str) -> DataFrame:
    """Each order is a text of 40 places, its lines are runs of overrides, of which the later ones win."""
    line, start = _table(spark, sf_dir, "lineitem"), F.col("l_partkey") % 50 - 3
    runs = line.select(F.col("l_orderkey").alias("text"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 20).alias("end"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") != "N", F.concat("l_returnflag", "l_linestatus")).alias("family"), F.when(F.col("l_linenumber") % 2 == 0, (F.col("l_suppkey") % 3).cast("long")).alias("weight"))
    base = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("text"), F.lit(40).alias("length"), F.lit("PLAIN").alias("family"), F.lit(4).cast("long").alias("weight"))
    return style_runs.resolved(base, runs, ["family", "weight"])
