"""Queries on graphs, masks, identities over days, propagation, movies, models and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions import pairwise
from tracewell.operators import episodes, features, graph, imaging, inference, matching, models, peaks, similarity, traces, waves
from tracewell.plans import workflows
from tracewell.plans.registry import GRID, query
from tracewell.plans.trace_queries import PROMINENCE, WINDOWED, Z
from tracewell.scratch import cut
from tracewell.sources import adapters, recordings
from tracewell.sources.adapters import table
from tracewell.streaming import online


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


PAIRS = Z + """,
pairs AS (SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, round(1 - sum(a.z * b.z) / count(*), 6) AS distance
          FROM z a JOIN z b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame GROUP BY ALL)"""
COMPONENTS = PAIRS.replace("WITH", "") + """,
e AS (SELECT recording_id, i AS a, j AS b FROM pairs WHERE distance <= 0.45 UNION ALL SELECT recording_id, j, i FROM pairs WHERE distance <= 0.45),
nodes AS (SELECT DISTINCT recording_id, roi_idx FROM grid),
reach(recording_id, node, l) AS (SELECT recording_id, roi_idx, roi_idx FROM nodes UNION SELECT e.recording_id, e.b, r.l FROM reach r JOIN e ON e.recording_id = r.recording_id AND e.a = r.node),
comp AS (SELECT recording_id, node, min(l) AS component FROM reach GROUP BY ALL)"""


def _distances(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = adapters.day_traces(spark, sf)
    d = similarity.near_traces(adapters.trace_arrays(s), 0.45, digits=6)
    return d, s.select("recording_id", F.col("roi_idx").alias("node")).distinct()


@query("q50_threshold_components", f"WITH RECURSIVE {COMPONENTS} SELECT recording_id, node, component FROM comp")
def threshold_components(spark: SparkSession, sf: str) -> DataFrame:
    arrays = cut(adapters.trace_arrays(adapters.day_traces(spark, sf)))
    nodes = arrays.select("recording_id", F.col("roi_idx").alias("node"))
    return graph.components(nodes, similarity.near_stars(arrays, 0.45, digits=6), ["recording_id"])


@query("q51_min_group_size", f"""WITH RECURSIVE {COMPONENTS}, s AS (SELECT *, count(*) OVER (PARTITION BY recording_id, component) AS group_size FROM comp)
    SELECT recording_id, node, component, group_size, dense_rank() OVER (PARTITION BY recording_id ORDER BY component) AS group_id FROM s WHERE group_size >= 2""")
def min_group_size(spark: SparkSession, sf: str) -> DataFrame:
    d, nodes = _distances(spark, sf)
    out = graph.threshold_groups(d, nodes, ["recording_id"], 0.45, 2)
    return out.select("recording_id", "node", "component", "group_size", F.col("group_id").cast("long").alias("group_id"))


@query("q52_average_linkage")
def average_linkage(spark: SparkSession, sf: str) -> DataFrame:
    arrays = adapters.trace_arrays(adapters.day_traces(spark, sf))
    return graph.hierarchical_rows(arrays, ["recording_id"], "roi_idx", pairwise.CrossCorrelation(1), 0.65)


@query("q52b_soft_dtw")
def soft_dtw(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.soft_dtw_pairs(adapters.trace_arrays(adapters.day_traces(spark, sf)), downsample=3, digits=6)


MASKS = """m AS (SELECT DISTINCT l_suppkey % 20 AS fov, l_suppkey AS mask, l_partkey % 997 AS px, l_linenumber % 2 AS day FROM lineitem),
a AS (SELECT DISTINCT fov, mask AS a, px FROM m WHERE day = 1), b AS (SELECT DISTINCT fov, mask AS b, px FROM m WHERE day = 0),
c AS (SELECT fov, a, b, count(*) AS common FROM a JOIN b USING (fov, px) GROUP BY ALL),
iou AS (SELECT c.fov, c.a, c.b, common, common / (na + nb - common) AS iou FROM c JOIN (SELECT fov, a, count(*) AS na FROM a GROUP BY ALL) x ON x.fov = c.fov AND x.a = c.a JOIN (SELECT fov, b, count(*) AS nb FROM b GROUP BY ALL) y ON y.fov = c.fov AND y.b = c.b)"""


def _masks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("fov"), F.col("l_suppkey").alias("mask"), (F.col("l_partkey") % 997).alias("px"), (F.col("l_linenumber") % 2).alias("day"))
    return m.filter("day = 1"), m.filter("day = 0")


@query("q53_mask_iou", f"WITH {MASKS} SELECT fov, a, b, common, round(iou, 6) AS iou FROM iou")
def mask_iou(spark: SparkSession, sf: str) -> DataFrame:
    return matching.mask_iou(*_masks(spark, sf), ["fov"], "mask", "px", digits=6)


@query("q53b_assignment")
def assignment(spark: SparkSession, sf: str) -> DataFrame:
    return matching.assign_masks(*_masks(spark, sf), ["fov"], "mask", "px", 0.05, digits=6)


PTS = "pts AS (SELECT CAST(label AS BIGINT) AS episode, vec_id AS node, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y, CAST(embedding[3] AS DOUBLE) AS onset, CAST(embedding[1] AS DOUBLE) * 3 - CAST(embedding[2] AS DOUBLE) * 2 + CAST(embedding[3] AS DOUBLE) * 0.1 AS onset_line FROM embeddings)"
NEAR = PTS + ", near AS (SELECT a.episode, a.node AS a, b.node AS b, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS distance FROM pts a JOIN pts b ON a.episode = b.episode AND a.node <> b.node WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 60)"


@query("q54_spatial_candidates", f"WITH {NEAR} SELECT episode, a, b, round(distance, 4) AS distance FROM near WHERE a < b")
def spatial_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.points(spark, sf)
    return matching.near_pairs(p, p, 60.0, ["episode"]).filter("a < b").select("episode", "a", "b", _r("distance", 4))


@query("q55_mask_shift_histogram", """WITH p AS (SELECT DISTINCT l_suppkey % 20 AS fov, l_partkey % 61 AS y, l_orderkey % 53 AS x, l_linenumber AS day FROM lineitem WHERE l_linenumber <= 2),
    d AS (SELECT a.fov, a.y - b.y AS dy, a.x - b.x AS dx, count(*) AS overlap FROM (SELECT DISTINCT fov, y, x FROM p WHERE day = 1) a JOIN (SELECT DISTINCT fov, y, x FROM p WHERE day = 2) b ON a.fov = b.fov
          WHERE abs(a.y - b.y) <= 8 AND abs(a.x - b.x) <= 8 GROUP BY ALL)
    SELECT fov, dy, dx, overlap FROM d QUALIFY row_number() OVER (PARTITION BY fov ORDER BY overlap DESC, abs(dy) + abs(dx), dy, dx) = 1""")
def mask_shift_histogram(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("fov"), (F.col("l_partkey") % 61).alias("y"), (F.col("l_orderkey") % 53).alias("x"), "l_linenumber")
    return matching.mask_shift(p.filter("l_linenumber = 1"), p.filter("l_linenumber = 2"), ["fov"], 8)


@query("q56_first_day_history", """SELECT conv_id AS cell, count(DISTINCT turn + 1) AS n_days, min(turn + 1) AS first_seen_day, min(turn + 1) FILTER (WHERE role = 'assistant') AS first_active_day,
    min(turn + 1) FILTER (WHERE length(text) > 200) AS first_grouped_day FROM conversations GROUP BY ALL""")
def first_day_history(spark: SparkSession, sf: str) -> DataFrame:
    h = table(spark, sf, "conversations").select(F.col("conv_id").alias("cell"), (F.col("turn") + 1).alias("day"), "role", "text")
    return matching.first_days(h, ["cell"], "day", {"seen": F.lit(True), "active": F.col("role") == "assistant", "grouped": F.length("text") > 200})


@query("q57_group_overlap_jaccard", """WITH a AS (SELECT DISTINCT c_nationkey % 5 AS region, c_nationkey AS ga, c_custkey AS item FROM customer), b AS (SELECT DISTINCT c_nationkey % 5 AS region, c_mktsegment AS gb, c_custkey AS item FROM customer WHERE c_acctbal > 0),
    c AS (SELECT region, ga, gb, count(*) AS n_common FROM a JOIN b USING (region, item) GROUP BY ALL),
    s AS (SELECT c.*, n_common / (na + nb - n_common) AS jaccard FROM c JOIN (SELECT region, ga, count(*) AS na FROM a GROUP BY ALL) x USING (region, ga) JOIN (SELECT region, gb, count(*) AS nb FROM b GROUP BY ALL) y USING (region, gb))
    SELECT region, ga, gb, n_common, round(jaccard, 6) AS jaccard FROM s QUALIFY row_number() OVER (PARTITION BY region, ga ORDER BY n_common DESC, jaccard DESC, gb) = 1""")
def group_overlap(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("region", F.col("c_nationkey") % 5)
    a = c.select("region", F.col("c_nationkey").alias("ga"), F.col("c_custkey").alias("item"))
    b = c.filter("c_acctbal > 0").select("region", F.col("c_mktsegment").alias("gb"), F.col("c_custkey").alias("item"))
    return matching.dominant_overlap(a, b, ["region"], "item").select("region", "ga", "gb", "n_common", _r("jaccard"))


KNN = NEAR + ", k AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY episode, a ORDER BY distance, b) <= 3), edges AS (SELECT episode, least(a, b) AS i, greatest(a, b) AS j, min(distance) AS distance FROM k GROUP BY ALL)"


@query("q59_knn_graph", f"WITH {KNN} SELECT episode, i, j, round(distance, 4) AS distance FROM edges")
def knn_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.knn_edges(adapters.points(spark, sf), ["episode"], 3, 60.0).select("episode", "i", "j", _r("distance", 4))


@query("q60_edge_xcorr", f"""WITH {GRID}, lags(k) AS (SELECT unnest(range(-2, 3))), e AS (SELECT DISTINCT recording_id, roi_idx AS i, roi_idx + 5 AS j FROM grid WHERE roi_idx + 5 IN (SELECT roi_idx FROM grid)),
    c AS (SELECT e.recording_id, i, j, k, coalesce(CASE WHEN sqrt(greatest(avg(x.v * x.v) - pow(avg(x.v), 2), 0)) * sqrt(greatest(avg(y.v * y.v) - pow(avg(y.v), 2), 0)) < 1e-12 THEN 0
            ELSE (avg(x.v * y.v) - avg(x.v) * avg(y.v)) / (sqrt(greatest(avg(x.v * x.v) - pow(avg(x.v), 2), 0)) * sqrt(greatest(avg(y.v * y.v) - pow(avg(y.v), 2), 0))) END, 0) AS c
          FROM e CROSS JOIN lags JOIN grid x ON x.roi_idx = e.i JOIN grid y ON y.roi_idx = e.j AND y.frame = x.frame + k GROUP BY ALL)
    SELECT recording_id, i, j, CAST(arg_min(k, (-round(c, 9), k)) AS INT) AS lag, round(max(c), 5) AS corr, round(max(c) - median(c), 5) AS sharpness FROM c GROUP BY ALL""")
def edge_xcorr(spark: SparkSession, sf: str) -> DataFrame:
    arrays = adapters.trace_arrays(adapters.day_traces(spark, sf))
    nodes = arrays.select("recording_id", F.col("roi_idx").alias("i"))
    edges = nodes.select("recording_id", "i", (F.col("i") + 5).alias("j")).join(nodes.select(F.col("i").alias("j")), "j", "left_semi")
    return similarity.lagged_edges(edges, arrays, 2, ["recording_id"]).select("recording_id", "i", "j", "lag", _r("corr", 5), _r("sharpness", 5))


@query("q61_planar_r2", f"""WITH {PTS}, m AS (SELECT episode, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(onset_line) AS tt, covar_pop(x, y) AS xy, covar_pop(x, onset_line) AS xt, covar_pop(y, onset_line) AS yt FROM pts GROUP BY 1),
    f AS (SELECT *, (xt * yy - yt * xy) / (xx * yy - xy * xy) AS bx, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS "by" FROM m)
    SELECT episode, n, round(greatest((bx * xt + "by" * yt) / tt, 0), 6) AS r2 FROM f""")
def planar_r2(spark: SparkSession, sf: str) -> DataFrame:
    return waves.planar_r2(adapters.points(spark, sf), ["episode"], t="onset_line").select("episode", "n", _r("r2"))


@query("q62_radial_score", f"""WITH {PTS}, e AS (SELECT episode, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1), g(gi) AS (SELECT unnest(range(0, 5))), h(gj) AS (SELECT unnest(range(0, 5))),
    d AS (SELECT episode, gi, gj, onset, sqrt(pow(x - (x0 - 0.25 * (x1 - x0) + 1.5 * (x1 - x0) * gi / 4), 2) + pow(y - (y0 - 0.25 * (y1 - y0) + 1.5 * (y1 - y0) * gj / 4), 2)) AS d FROM pts JOIN e USING (episode) CROSS JOIN g CROSS JOIN h),
    r AS (SELECT episode, gi, gj, covar_pop(d, onset) / nullif(stddev_pop(d) * stddev_pop(onset), 0) AS r FROM d GROUP BY ALL)
    SELECT episode, round(max(pow(greatest(coalesce(r, 0), 0), 2)), 6) AS score FROM r GROUP BY ALL""")
def radial_score(spark: SparkSession, sf: str) -> DataFrame:
    return waves.radial_score(adapters.points(spark, sf), ["episode"]).select("episode", _r("score"))


@query("q62b_fit_propagation")
def fit_propagation(spark: SparkSession, sf: str) -> DataFrame:
    return waves.fit_propagation(adapters.points(spark, sf).select("episode", "node", "x", "y", "onset_line"), ["episode"], 49, t="onset_line")


@query("q62c_graph_arrivals")
def graph_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.points(spark, sf)
    edges = graph.knn_edges(p, ["episode"], 3, 60.0)
    t = p.select("episode", F.col("node").alias("i"), F.col("onset_line").alias("ti")), p.select("episode", F.col("node").alias("j"), F.col("onset_line").alias("tj"))
    lagged = edges.join(t[0], ["episode", "i"]).join(t[1], ["episode", "j"]).select("episode", "i", "j", (F.col("tj") - F.col("ti")).alias("lag"), F.lit(1.0).alias("corr"))
    return waves.arrivals(lagged, ["episode"]).select("episode", "node", _r("arrival"))


@query("q62d_recurrence_clusters", f"""WITH RECURSIVE {PTS}, ep AS (SELECT episode, node, x, y, onset * 180 AS direction FROM pts),
    e AS (SELECT a.episode, a.node AS a, b.node AS b FROM ep a JOIN ep b ON a.episode = b.episode AND a.node <> b.node AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 40
          WHERE (pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / 1600 + pow(abs(((a.direction - b.direction + 180) - 360 * floor((a.direction - b.direction + 180) / 360)) - 180) / 45, 2) <= 1),
    reach(episode, node, l) AS (SELECT episode, node, node FROM ep UNION SELECT e.episode, e.b, r.l FROM reach r JOIN e ON e.a = r.node AND e.episode = r.episode),
    c AS (SELECT episode, node, min(l) AS component FROM reach GROUP BY ALL)
    SELECT episode, node, CASE WHEN count(*) OVER (PARTITION BY episode, component) > 1 THEN component ELSE -1 END AS cluster FROM c""")
def recurrence_clusters(spark: SparkSession, sf: str) -> DataFrame:
    ep = adapters.points(spark, sf).select("episode", "node", "x", "y", (F.col("onset") * 180).alias("direction"))
    return waves.recurrence_clusters(ep, ["episode"], 40.0, 45.0).select("episode", "node", "cluster")


MOVIE = "movie AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS frame, CAST(hour(ts) AS INT) AS y, CAST(user_id % 12 AS INT) AS x, round(sum(value), 6) AS v FROM events GROUP BY ALL)"


def _movie(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    frame = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    return e.groupBy(frame.alias("frame"), F.hour("ts").alias("y"), (F.col("user_id") % 12).cast("int").alias("x")).agg(F.round(F.sum("value"), 6).alias("v"))


@query("q66_block_mean", f"WITH {MOVIE} SELECT frame, y // 5 AS \"by\", x // 5 AS bx, round(avg(v), 5) AS v FROM movie WHERE y < 20 AND x < 10 GROUP BY ALL")
def block_mean(spark: SparkSession, sf: str) -> DataFrame:
    return waves.block_mean(_movie(spark, sf), ["frame"], 5, 24, 12).select("frame", "by", "bx", _r("v", 5))


PHASIC = MOVIE + """, m AS (SELECT *, median(v) OVER (PARTITION BY y, x) AS m FROM movie), d AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY y, x) AS mad FROM m),
act AS (SELECT frame, y, x FROM d WHERE (v - m) / greatest(mad * 1.4826, 1e-7) >= 0.8),
ok AS (SELECT a.frame, a.y, a.x FROM act a JOIN act b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY ALL HAVING count(*) >= 1)"""


def _phasic(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _movie(spark, sf).select(F.lit(0).alias("rec"), "frame", F.col("y").alias("by"), F.col("x").alias("bx"), "v")
    return waves.phasic(blocks, ["rec"], 0.8, 1)


@query("q67_phasic_voxels", f"WITH {PHASIC} SELECT frame, y AS \"by\", x AS bx FROM ok")
def phasic_voxels(spark: SparkSession, sf: str) -> DataFrame:
    return _phasic(spark, sf).select("frame", "by", "bx")


@query("q68_flood_fill", f"""WITH RECURSIVE {PHASIC}, n AS (SELECT frame, y, x, (CAST(frame AS BIGINT) * 1048576 + y) * 1048576 + x AS id FROM ok),
    e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND abs(a.frame - b.frame) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach(id, l) AS (SELECT id, id FROM n UNION SELECT e.b, least(r.l, e.b) FROM reach r JOIN e ON e.a = r.id WHERE r.l < e.b),
    c AS (SELECT id, min(l) AS component FROM reach GROUP BY ALL)
    SELECT frame, y AS "by", x AS bx, component, count(*) OVER (PARTITION BY component) AS component_size FROM n JOIN c USING (id)""")
def flood_fill(spark: SparkSession, sf: str) -> DataFrame:
    return waves.flood_fill(_phasic(spark, sf), ["rec"]).select("frame", "by", "bx", "component", "component_size")


@query("q68b_nearest_arrivals", """WITH c(centre) AS (VALUES (5), (14), (23)), o AS (SELECT DISTINCT user_id % 5 AS rec, user_id AS node, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS onset FROM events WHERE event_type = 'purchase')
    SELECT rec, centre, node, arg_min(onset, (abs(onset - centre), onset)) AS onset FROM c JOIN o ON abs(onset - centre) <= 3 GROUP BY ALL""")
def nearest_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    o = table(spark, sf, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 5).alias("rec"), F.col("user_id").alias("node"), day.alias("onset")).distinct()
    centres = o.select("rec").distinct().withColumn("centre", F.explode(F.array(F.lit(5), F.lit(14), F.lit(23))))
    return matching.nearest_arrivals(centres, o, ["rec"], 3)


@query("q76_rf_classifier")
def rf_classifier(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", " ")).cast("double").alias("n_words"), (F.size(F.split("text", "[.]")) - 1).cast("double").alias("n_stops"))
    rows = d.join(table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id")
    train, test = models.split(rows, "doc_id")
    model = models.fit(train, ["n_chars", "n_words", "n_stops"], "label", "RF", numTrees=20, maxDepth=4)
    return models.predict(model, test).select("doc_id", "label", "prediction")


@query("q77_names_and_days", """WITH n AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN c_custkey % 7 || '-' || c_custkey % 3 WHEN 1 THEN c_custkey % 7 || '-' || c_custkey % 3 || '_Day' || c_custkey % 28 WHEN 2 THEN c_custkey % 7 || '-1_day7' ELSE 'notes' || c_custkey END AS video, c_mktsegment AS tp FROM customer)
    SELECT id, video, tp AS timepoint, CASE WHEN regexp_matches(video, '^\\d+-\\d+(_Day\\d+)?$', 'i') THEN regexp_extract(video, '^(\\d+-\\d+)', 1) END AS region, CASE WHEN regexp_matches(video, '_Day\\d+$', 'i') THEN CAST(regexp_extract(video, '_Day(\\d+)$', 1, 'i') AS INT) ELSE 1 END AS day FROM n""")
def names_and_days(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    base = F.concat((k % 7).cast("string"), F.lit("-"))
    name = F.when(k % 4 == 0, F.concat(base, (k % 3).cast("string"))).when(k % 4 == 1, F.concat(base, (k % 3).cast("string"), F.lit("_Day"), (k % 28).cast("string"))).when(
        k % 4 == 2, F.concat(base, F.lit("1_day7"))).otherwise(F.concat(F.lit("notes"), k.cast("string")))
    paths = table(spark, sf, "customer").select(k.alias("id"), F.concat(F.lit("/data/exp/"), F.lit("ctl/"), F.col("c_mktsegment"), F.lit("/"), name).alias("path"))
    return recordings.recording_metadata(paths).select("id", "video", "timepoint", "region", "day")


@query("q78_tree_nodes", """WITH p AS (SELECT DISTINCT n_regionkey AS r, n_nationkey AS n FROM nation), x AS (SELECT 'exp' AS node, '' AS parent, 'exp' AS name, 1 AS depth, false AS is_leaf UNION SELECT 'exp/' || r, 'exp', CAST(r AS VARCHAR), 2, false FROM p UNION SELECT 'exp/' || r || '/' || n, 'exp/' || r, CAST(n AS VARCHAR), 3, true FROM p)
    SELECT * FROM x""")
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    paths = table(spark, sf, "nation").select(F.concat_ws("/", F.lit("/exp"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("path"))
    return recordings.tree_nodes(paths)


@query("q79_windowed_rates", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_rates(spark: SparkSession, sf: str) -> DataFrame:
    out = online.windowed_rates(table(spark, sf, "events"), "ts", "event_type", "value")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", _r("total", 4))


@query("q80_bursts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def bursts(spark: SparkSession, sf: str) -> DataFrame:
    return online.bursts(table(spark, sf, "events"), "ts", "user_id").select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("q81_cumulative_shifts", """WITH a AS (SELECT n_regionkey AS region, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS day, n_nationkey % 7 - 3 AS dy, n_nationkey % 5 - 2 AS dx, round(1 - n_nationkey / 100.0, 4) AS corr FROM nation)
    SELECT region, day - 1 AS day, CAST(sum(dy) OVER w AS DOUBLE) AS dy, CAST(sum(dx) OVER w AS DOUBLE) AS dx, min(corr) OVER w AS corr FROM a WHERE day <= 4 WINDOW w AS (PARTITION BY region ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    UNION ALL SELECT region, day, CAST(-sum(dy) OVER w AS DOUBLE), CAST(-sum(dx) OVER w AS DOUBLE), min(corr) OVER w FROM a WHERE day > 4 WINDOW w AS (PARTITION BY region ORDER BY day)""")
def cumulative_shifts(spark: SparkSession, sf: str) -> DataFrame:
    from tracewell.operators import ranking

    n = table(spark, sf, "nation")
    day = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) + 1
    a = n.select(F.col("n_regionkey").alias("region"), day.cast("long").alias("day"), (F.col("n_nationkey") % 7 - 3).cast("double").alias("dy"), (F.col("n_nationkey") % 5 - 2).cast("double").alias("dx"), F.round(1 - F.col("n_nationkey") / 100.0, 4).alias("corr"))
    return ranking.cumulative_shifts(a, ["region"], "day", 4)


@query("q82_coverage_event_frequency", """WITH e AS (SELECT user_id % 5 AS grp, user_id, count(*) AS spikes, avg(value) AS m, var_pop(value) AS v FROM events GROUP BY ALL)
    SELECT grp, count(*) AS n, round(avg(spikes / 30.0), 6) AS frequency, round(avg(v), 3) AS within, round(var_pop(m), 4) AS between FROM e GROUP BY ALL""")
def event_frequency(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").groupBy((F.col("user_id") % 5).alias("grp"), "user_id").agg(F.count(F.lit(1)).alias("spikes"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return e.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("spikes") / 30.0), 6).alias("frequency"), F.round(F.avg("v"), 3).alias("within"), F.round(F.var_pop("m"), 4).alias("between"))


@query("q83_correlation_significance")
def correlation_significance(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.significant_pairs(adapters.trace_arrays(adapters.day_traces(spark, sf)), digits=8)


@query("q84_mean_within_groups", f"""WITH {GRID}, s AS (SELECT a.recording_id, a.roi_idx % 3 AS grp, a.roi_idx AS i, b.roi_idx AS j, CASE WHEN stddev_pop(a.v) * stddev_pop(b.v) < 1e-12 THEN 0 ELSE covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS r
      FROM grid a JOIN grid b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame AND a.roi_idx % 3 = b.roi_idx % 3 GROUP BY ALL),
    g AS (SELECT DISTINCT recording_id, roi_idx % 3 AS grp FROM grid)
    SELECT g.recording_id, g.grp AS "group", round(avg(r), 6) AS mean_similarity FROM g LEFT JOIN s ON s.recording_id = g.recording_id AND s.grp = g.grp GROUP BY ALL""")
def mean_within_groups(spark: SparkSession, sf: str) -> DataFrame:
    arrays = adapters.trace_arrays(adapters.day_traces(spark, sf))
    groups = arrays.select("recording_id", (F.col("roi_idx") % 3).alias("group"), F.col("roi_idx").alias("node"))
    return similarity.mean_within_traces(groups, arrays, ["recording_id"]).select("recording_id", "group", _r("mean_similarity"))


IMAGES = "img AS (SELECT l_suppkey % 4 AS fov, l_linenumber AS day, CAST(l_partkey % 24 AS INT) AS y, CAST(l_orderkey % 20 AS INT) AS x, round(avg(l_quantity), 6) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL)"


def _images(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").filter("l_linenumber <= 2")
    return rows.groupBy((F.col("l_suppkey") % 4).alias("fov"), F.col("l_linenumber").alias("day"), (F.col("l_partkey") % 24).cast("int").alias("y"), (F.col("l_orderkey") % 20).cast("int").alias("x")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))


@query("q86_image_correlation", f"""WITH {IMAGES} SELECT a.fov, round(coalesce(covar_pop(a.v, b.v) / nullif(stddev_pop(a.v) * stddev_pop(b.v), 0), 0), 6) AS r
    FROM img a JOIN img b ON a.fov = b.fov AND a.y = b.y + 2 AND a.x = b.x - 1 WHERE a.day = 1 AND b.day = 2 GROUP BY ALL""")
def image_correlation(spark: SparkSession, sf: str) -> DataFrame:
    i = _images(spark, sf)
    return imaging.correlation_for_shift(i.filter("day = 1").drop("day"), i.filter("day = 2").drop("day"), ["fov"], 2, -1).select("fov", _r("r"))


@query("q87_shift_stretch", f"""WITH {IMAGES}, q AS (SELECT fov, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.995) AS hi FROM img WHERE day = 1 GROUP BY 1)
    SELECT i.fov, y + 3 AS y, x - 2 AS x, round(least(greatest(coalesce((v - lo) / nullif(hi - lo, 0), 0), 0), 1) * 180, 4) AS v FROM img i JOIN q ON q.fov = i.fov WHERE day = 1 AND y + 3 < 24 AND x - 2 >= 0""")
def shift_stretch(spark: SparkSession, sf: str) -> DataFrame:
    bright = imaging.stretch(_images(spark, sf).filter("day = 1").drop("day"), ["fov"])
    return imaging.shift_image(bright, ["fov"], 3, -2, 24, 20).select("fov", "y", "x", _r("v", 4))


@query("q88_translations")
def translations(spark: SparkSession, sf: str) -> DataFrame:
    i = _images(spark, sf)
    return imaging.translations(i.filter("day = 1").drop("day"), i.filter("day = 2").drop("day"), ["fov"], 24, 20, 6).select("fov", "dy", "dx", _r("r"))


MASK = "mask AS (SELECT DISTINCT l_suppkey % 5 AS fov, CAST(l_partkey % 23 AS INT) AS y, CAST(l_orderkey % 19 AS INT) AS x FROM lineitem WHERE l_quantity > 40)"


@query("q89_mask_outline", f"""WITH {MASK}, s(dy, dx) AS (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)), v AS (SELECT fov, y + dy AS y, x + dx AS x FROM mask CROSS JOIN s)
    SELECT fov, y, x FROM v WHERE y BETWEEN 0 AND 22 AND x BETWEEN 0 AND 18 GROUP BY ALL HAVING count(*) < 5""")
def mask_outline(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "lineitem").filter("l_quantity > 40").select((F.col("l_suppkey") % 5).alias("fov"), (F.col("l_partkey") % 23).cast("int").alias("y"), (F.col("l_orderkey") % 19).cast("int").alias("x"))
    return imaging.outline(m, ["fov"], 23, 19)


@query("q90_front_boundary", f"""WITH {PHASIC}, full_ AS (SELECT a.frame, a.y, a.x FROM ok a JOIN ok b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 9)
    SELECT frame, y AS "by", x AS bx FROM ok ANTI JOIN full_ USING (frame, y, x)""")
def front_boundary(spark: SparkSession, sf: str) -> DataFrame:
    return imaging.front_boundary(_phasic(spark, sf), ["rec"]).select("frame", "by", "bx")


@query("q92_component_extent", f"""WITH RECURSIVE {PHASIC}, n AS (SELECT frame, y, x, (CAST(frame AS BIGINT) * 1048576 + y) * 1048576 + x AS id FROM ok),
    e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND abs(a.frame - b.frame) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach(id, l) AS (SELECT id, id FROM n UNION SELECT e.b, least(r.l, e.b) FROM reach r JOIN e ON e.a = r.id WHERE r.l < e.b),
    c AS (SELECT id, min(l) AS component FROM reach GROUP BY ALL)
    SELECT component, count(*) AS n_voxels, max(frame) - min(frame) + 1 AS duration, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width, count(DISTINCT (y, x)) AS n_places FROM n JOIN c USING (id) GROUP BY component""")
def component_extent(spark: SparkSession, sf: str) -> DataFrame:
    return waves.component_extent(waves.flood_fill(_phasic(spark, sf), ["rec"]), ["rec"]).drop("rec")


@query("q96_lag_null")
def lag_null(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.points(spark, sf)
    edges = graph.knn_edges(p, ["episode"], 3, 60.0)
    t = p.select("episode", F.col("node").alias("i"), F.col("onset_line").alias("ti")), p.select("episode", F.col("node").alias("j"), F.col("onset_line").alias("tj"))
    lagged = edges.join(t[0], ["episode", "i"]).join(t[1], ["episode", "j"]).select("episode", "i", "j", (F.col("tj") - F.col("ti")).alias("lag"), F.lit(1.0).alias("corr"))
    return imaging.lag_null(lagged, p, ["episode"], 19)


@query("q97_area_asymmetry", f"""WITH {WINDOWED} SELECT recording_id, roi_idx, frame, round(coalesce((sum(CASE WHEN i > pk THEN abs(y) ELSE 0 END) - sum(CASE WHEN i < pk THEN abs(y) ELSE 0 END))
    / nullif(sum(CASE WHEN i > pk THEN abs(y) ELSE 0 END) + sum(CASE WHEN i < pk THEN abs(y) ELSE 0 END), 0), 0), 6) AS value FROM ws GROUP BY ALL""")
def area_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    ws = peaks.window_samples(s, peaks.valley_windows(s, peaks.local_maxima(s)))
    return features.area_asymmetry(ws).select("recording_id", "roi_idx", "frame", _r("value"))


@query("q99_peak_density", f"""WITH {PROMINENCE}, p AS (SELECT m.roi_idx, count(*) AS k, median(prominence) AS mp, sum(prominence) AS total, avg(m.v - g.v) AS lm FROM prom m JOIN grid g ON g.roi_idx = m.roi_idx AND g.frame = m.left_base GROUP BY 1),
    s AS (SELECT recording_id, roi_idx, count(*) AS n, max(v) - min(v) AS r FROM grid GROUP BY ALL)
    SELECT recording_id, s.roi_idx, round(coalesce(k, 0) / n, 6) AS density, round(coalesce(mp, 0), 6) AS median_prominence, round(coalesce(total / nullif(r, 0) / n, 0), 6) AS weighted_density, round(lm, 6) AS left_mean
    FROM s LEFT JOIN p ON p.roi_idx = s.roi_idx""")
def peak_density(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    out = features.peak_density(peaks.prominences(s), s)
    return out.select("recording_id", "roi_idx", _r("density"), _r("median_prominence"), _r("weighted_density"), _r("left_mean"))


@query("q100_treatment_comparison", """WITH r AS (SELECT o_orderstatus AS treatment, CAST(c_nationkey AS VARCHAR) AS animal, o_custkey, count(*) AS w, avg(o_totalprice) AS mean, var_pop(o_totalprice) AS var FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
    a AS (SELECT treatment, animal, sum(mean * w) / sum(w) AS mean, sum(var * w) / sum(w) + greatest(sum(mean * mean * w) / sum(w) - pow(sum(mean * w) / sum(w), 2), 0) AS var, count(*) AS w FROM r GROUP BY ALL)
    SELECT treatment, round(sum(mean * w) / sum(w), 3) AS mean, count(*) AS n_children, CAST(sum(w) AS BIGINT) AS w FROM a GROUP BY ALL""")
def treatment_comparison(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("animal"))
    r = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("treatment"), "o_custkey").agg(F.count(F.lit(1)).alias("w"), F.avg("o_totalprice").alias("mean"), F.var_pop("o_totalprice").alias("var_total"))
    out = workflows.treatment_comparison(r.join(c, "o_custkey"))["treatments"]
    return out.select("treatment", _r("mean", 3), "n_children", F.col("w").cast("long").alias("w"))


@query("q101_recording_analysis")
def recording_analysis(spark: SparkSession, sf: str) -> DataFrame:
    out = workflows.analyse_recordings(adapters.day_traces(spark, sf), workflows.Settings(fs=1.0, sigma=1.0, distance=3))
    return out["combined"].groupBy("recording_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
