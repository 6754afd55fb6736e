"""Queries on recordings as records: cells over days, tests between days, files' metadata, labels, gates, validation and graphs of neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import episodes, features, graph, imaging, inference, labels, longitudinal, matching, models, peaks, similarity, traces, validation, wave_tables
from tracewell.plans.registry import GRID, query
from tracewell.plans.spatial_queries import PHASIC, _phasic
from tracewell.plans.trace_queries import PROMINENCE, WINDOWED, _windowed
from tracewell.scratch import shared_dir
from tracewell.sources import adapters, bundles, planes, recordings
from tracewell.sources.adapters import table


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


# ---- tests between days and arms

DAYS = """r AS (SELECT c_mktsegment AS treatment, c_custkey % 50 AS recording, CAST(year(o_orderdate) AS INT) AS day, avg(o_totalprice) AS v
         FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    d AS (SELECT a.treatment, a.day AS day_row, b.day AS day_col, a.v AS x, b.v AS y FROM r a JOIN r b ON a.treatment = b.treatment AND a.recording = b.recording AND a.day < b.day)"""


def _days(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("treatment"))
    o = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy("treatment", (F.col("c_custkey") % 50).alias("recording"), F.year("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))


@query("q102_day_pairs", f"""WITH {DAYS} SELECT treatment, day_row, day_col, count(*) AS n_pairs, round(avg(x), 4) AS mean_day_row, round(avg(y), 4) AS mean_day_col, round(avg(y - x), 4) AS change,
    round(CASE WHEN count(*) < 3 THEN NULL WHEN max(abs(x - y)) = 0 THEN 0 ELSE avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) END, 6) AS statistic FROM d GROUP BY ALL""")
def day_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = inference.day_pairs(_days(spark, sf), ["treatment"], "recording", "day", "price")
    return out.select("treatment", "day_row", "day_col", "n_pairs", _r("mean_day_row", 4), _r("mean_day_col", 4), _r("change", 4), _r("statistic"))


@query("q102b_day_pair_tests")
def day_pair_tests(spark: SparkSession, sf: str) -> DataFrame:
    return inference.day_pair_tests(_days(spark, sf), ["treatment"], "recording", "day", "price")


@query("q102c_day_pair_ranks")
def day_pair_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return inference.day_pair_tests(_days(spark, sf), ["treatment"], "recording", "day", "price", "wilcoxon")


@query("q103_independent_t", """WITH a AS (SELECT n_regionkey AS family, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS n1, count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS n2,
      avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS m1, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS m2,
      var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS v1, var_samp(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY') AS v2
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT family, n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), 6) AS t, CAST(n1 + n2 - 2 AS DOUBLE) AS df FROM a""")
def independent_t(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return inference.independent_t(c.withColumn("family", F.col("n_regionkey")), ["family"], "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY").select("family", "n1", "n2", _r("t"), "df")


@query("q103b_compare_distributions")
def compare_distributions(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("family", F.col("c_nationkey"))
    out = None
    for test in ("ttest", "mannwhitneyu", "ks"):
        one = inference.compare_distributions(c, ["family"], "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", test).withColumn("test", F.lit(test))
        one = one.withColumn("statistic", F.col("statistic").cast("double"))
        out = one if out is None else out.unionByName(one)
    return out


@query("q103c_correlation_t", f"""WITH {GRID}, c AS (SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, count(*) AS n,
      CASE WHEN stddev_pop(a.v) * stddev_pop(b.v) < 1e-12 THEN 0 ELSE covar_pop(a.v, b.v) / (stddev_pop(a.v) * stddev_pop(b.v)) END AS r
      FROM grid a JOIN grid b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame GROUP BY ALL)
    SELECT recording_id, i, j, round(r * sqrt((n - 2) / (1 - r * r + 1e-10)), 5) AS t FROM c""")
def correlation_t(spark: SparkSession, sf: str) -> DataFrame:
    p = similarity.pairs(adapters.trace_arrays(adapters.day_traces(spark, sf)))
    r = p.select("recording_id", "i", "j", similarity.pearson(F.col("fa"), F.col("fb")).alias("r"), F.size("fa").alias("n"))
    return inference.correlation_significance(r, "r", "n").select("recording_id", "i", "j", _r("t", 5))


# ---- cells over days: a customer is a cell, a year a day, customers who ordered on the anchor day are its cells

KEYS = ["recording"]
CELLS = """o AS (SELECT o_custkey % 5 AS recording, o_custkey AS cell, CAST(year(o_orderdate) AS INT) AS day, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
    rec AS (SELECT DISTINCT recording, day FROM o),
    anchor AS (SELECT DISTINCT recording, cell AS anchor_roi, cell % 7 AS anchor_group_id FROM o WHERE day = 1995),
    matched AS (SELECT recording, day, cell AS anchor_roi, CASE WHEN day = 1995 THEN cell ELSE cell + 1000000 END AS day_roi, CAST(CASE WHEN day = 1995 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score, CAST(CASE WHEN day = 1995 THEN 1.0 ELSE 0.8 END AS DOUBLE) AS iou,
                CAST(CASE WHEN day = 1995 THEN 0.0 ELSE 1.5 END AS DOUBLE) AS distance, day <> 1995 AND count(*) > 2 AS ambiguous FROM o JOIN (SELECT recording, anchor_roi AS cell FROM anchor) USING (recording, cell) GROUP BY recording, day, cell),
    active AS (SELECT DISTINCT recording, day, CASE WHEN day = 1995 THEN cell ELSE cell + 1000000 END AS day_roi FROM o WHERE status = 'F'),
    members AS (SELECT DISTINCT recording, day, cell % 4 AS group_id, CASE WHEN day = 1995 THEN cell ELSE cell + 1000000 END AS day_roi FROM o WHERE priority IN ('1-URGENT', '2-HIGH')),
    hist AS (SELECT a.recording, anchor_group_id, count(*) OVER (PARTITION BY a.recording, anchor_group_id, r.day) AS anchor_group_size, a.anchor_roi, r.day, m.day_roi, m.day_roi IS NOT NULL AS detected,
             c.day_roi IS NOT NULL AS active, g.ids IS NOT NULL AS grouped, coalesce(g.ids, '') AS daily_group_ids, m.score AS match_score, m.iou AS mask_iou, m.distance AS centroid_distance, coalesce(m.ambiguous, false) AS ambiguous_match
      FROM anchor a JOIN rec r ON r.recording = a.recording LEFT JOIN matched m ON m.recording = a.recording AND m.day = r.day AND m.anchor_roi = a.anchor_roi
      LEFT JOIN active c ON c.recording = a.recording AND c.day = r.day AND c.day_roi = m.day_roi
      LEFT JOIN (SELECT recording, day, day_roi, string_agg(group_id, ';' ORDER BY CAST(group_id AS VARCHAR)) AS ids FROM members GROUP BY ALL) g ON g.recording = a.recording AND g.day = r.day AND g.day_roi = m.day_roi)"""


def _cells(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 5).alias("recording"), F.col("o_custkey").alias("cell"), F.year("o_orderdate").alias("day"), "o_orderstatus", "o_orderpriority")
    roi = F.when(F.col("day") == 1995, F.col("cell")).otherwise(F.col("cell") + 1_000_000)
    groups = o.filter("day = 1995").select("recording", (F.col("cell") % 7).alias("anchor_group_id"), F.col("cell").alias("anchor_roi")).distinct()
    seen = o.groupBy("recording", "cell", "day").agg((F.count(F.lit(1)) > 2).alias("ambiguous"))
    matches = seen.filter("day <> 1995").select(
        "recording", "day", F.col("cell").alias("anchor_roi"), roi.alias("day_roi"), F.lit(0.9).alias("score"), F.lit(0.8).alias("iou"), F.lit(1.5).alias("distance"), "ambiguous")
    matches = matches.join(groups.select("recording", "anchor_roi"), ["recording", "anchor_roi"], "left_semi")
    spikes = o.filter("o_orderstatus = 'F'").select("recording", "day", roi.alias("neuron_idx"))
    stats = o.filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").groupBy("recording", "day", (F.col("cell") % 4).alias("group_id")).agg(F.collect_set(roi).alias("neuron_indices")).withColumn("method", F.lit("combined"))
    return {
        "groups": groups, "recordings": o.select("recording", "day", (F.col("day") == 1995).alias("is_anchor")).distinct(), "matches": matches,
        "active": longitudinal.active_neurons(spikes, ["recording", "day"]), "members": longitudinal.load_groups(stats, "combined", ["recording", "day"])}


def _history(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    c = _cells(spark, sf)
    matched = longitudinal.day_matches(c["matches"], c["groups"], c["recordings"], KEYS)
    return longitudinal.cell_history(c["groups"], c["recordings"], matched, c["active"], c["members"], KEYS), matched, c


@query("q104_cell_history", f"""WITH {CELLS} SELECT *, min(CASE WHEN detected THEN day END) OVER c AS first_detected_day, min(CASE WHEN active THEN day END) OVER c AS first_active_day,
    min(CASE WHEN grouped THEN day END) OVER c AS first_grouped_day FROM hist WINDOW c AS (PARTITION BY recording, anchor_roi)""")
def cell_history(spark: SparkSession, sf: str) -> DataFrame:
    return _history(spark, sf)[0]


@query("q104b_group_days", f"""WITH {CELLS}, n AS (SELECT recording, anchor_group_id, anchor_group_size, day, CAST(count(*) FILTER (WHERE detected) AS BIGINT) AS n_detected, count(*) FILTER (WHERE active) AS n_active, count(*) FILTER (WHERE grouped) AS n_grouped FROM hist GROUP BY ALL),
    mapped AS (SELECT DISTINCT recording, day, group_id, anchor_roi FROM members JOIN matched USING (recording, day, day_roi)),
    s AS (SELECT recording, day, group_id, count(*) AS n_mapped FROM mapped GROUP BY ALL),
    sh AS (SELECT recording, day, anchor_group_id, anchor_group_size, group_id, count(*) AS n_shared FROM mapped JOIN hist USING (recording, day, anchor_roi) GROUP BY ALL),
    b AS (SELECT *, n_shared / (anchor_group_size + n_mapped - n_shared) AS jaccard FROM sh JOIN s USING (recording, day, group_id)),
    d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY recording, day, anchor_group_id ORDER BY n_shared DESC, jaccard DESC, group_id) = 1)
    SELECT n.*, coalesce(CAST(group_id AS VARCHAR), '') AS dominant_group_id, coalesce(n_shared, 0) AS n_shared, round(coalesce(jaccard, 0), 6) AS jaccard
    FROM n LEFT JOIN d ON n.recording = d.recording AND n.day = d.day AND n.anchor_group_id = d.anchor_group_id""")
def group_days(spark: SparkSession, sf: str) -> DataFrame:
    history, matched, c = _history(spark, sf)
    return longitudinal.group_days(history, c["members"], matched, KEYS).withColumn("jaccard", F.round("jaccard", 6))


@query("q104c_registration_quality", f"""WITH {CELLS} SELECT recording, day, count(*) AS n_matches, round(avg(score), 6) AS mean_score, round(avg(iou), 6) AS mean_iou, round(avg(distance), 6) AS mean_distance, count(*) FILTER (WHERE ambiguous) AS n_ambiguous FROM matched GROUP BY ALL""")
def registration_quality(spark: SparkSession, sf: str) -> DataFrame:
    out = longitudinal.registration_quality(_history(spark, sf)[1], KEYS)
    return out.select(*KEYS, "day", "n_matches", _r("mean_score"), _r("mean_iou"), _r("mean_distance"), "n_ambiguous")


@query("q104d_track_anchor_groups", f"""WITH {CELLS}, z AS (SELECT recording, anchor_group_id, count(*) AS size FROM anchor GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY size DESC, anchor_group_id) AS rank, count(*) OVER (PARTITION BY recording) AS n FROM z)
    SELECT recording, anchor_group_id, size, CAST(rank AS INT) AS rank FROM k WHERE rank <= greatest(ceil(n * 0.3), 1)""")
def track_anchor_groups(spark: SparkSession, sf: str) -> DataFrame:
    out = longitudinal.track(**_cells(spark, sf), keys=KEYS)["anchor_groups"]
    return out.select("recording", "anchor_group_id", "size", F.col("rank").cast("int").alias("rank"))


# ---- graphs of neighbours

EDGES = """e AS (SELECT DISTINCT o_orderkey % 4 AS rec, o_custkey % 300 AS i, (o_orderkey * 7) % 300 AS j, (CAST(floor(o_totalprice) AS BIGINT) % 1000) / 1000.0 AS corr, (CAST(floor(o_totalprice) AS BIGINT) % 7) / 100.0 AS sharpness FROM orders),
    good AS (SELECT * FROM e WHERE corr >= 0.95 AND sharpness >= 0.03),
    both_ AS (SELECT rec, i AS a, j AS b FROM good UNION SELECT rec, j, i FROM good),
    reach(rec, node, l) AS (SELECT DISTINCT rec, a, a FROM both_ UNION SELECT r.rec, b.b, r.l FROM reach r JOIN both_ b ON b.rec = r.rec AND b.a = r.node),
    comp AS (SELECT rec, node, min(l) AS c FROM reach GROUP BY ALL),
    size AS (SELECT rec, c, count(*) AS n FROM comp GROUP BY rec, c), big AS (SELECT rec, c FROM size QUALIFY row_number() OVER (PARTITION BY rec ORDER BY n DESC, c) = 1)"""


@query("q105_reliable_component", f"""WITH RECURSIVE {EDGES} SELECT g.rec, g.i, g.j, g.corr, g.sharpness FROM good g JOIN comp n ON n.rec = g.rec AND n.node = g.i JOIN big b ON b.rec = n.rec AND b.c = n.c""")
def reliable_component(spark: SparkSession, sf: str) -> DataFrame:
    price = F.floor("o_totalprice").cast("long")
    e = table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 4).alias("rec"), (F.col("o_custkey") % 300).alias("i"), (F.col("o_orderkey") * 7 % 300).alias("j"), (price % 1000 / 1000.0).alias("corr"), (price % 7 / 100.0).alias("sharpness")).distinct()
    return wave_tables.reliable_component(e, ["rec"], 0.95, 0.03)


@query("q105b_graph_fronts")
def graph_fronts(spark: SparkSession, sf: str) -> DataFrame:
    p = adapters.points(spark, sf)
    near = graph.knn_edges(p.select("episode", "node", "x", "y"), ["episode"], 4, 2000.0)
    t = p.select("episode", "node", "onset_line")
    e = near.join(t.select("episode", F.col("node").alias("i"), F.col("onset_line").alias("a")), ["episode", "i"]).join(t.select("episode", F.col("node").alias("j"), F.col("onset_line").alias("b")), ["episode", "j"])
    e = e.select("episode", "i", "j", F.round((F.col("b") - F.col("a")) * 10).alias("lag"), F.lit(0.8).alias("corr"), F.lit(0.1).alias("sharpness"))
    fronts = wave_tables.graph_fronts(e, p, ["episode"], wave_tables.GraphSettings(repeats=19, least_nodes=5))
    return wave_tables.significant_fronts(fronts.withColumn("recording", F.lit(0)), ["recording"])


@query("q91_front_speed", f"""WITH RECURSIVE {PHASIC}, full_ AS (SELECT a.frame, a.y, a.x FROM ok a JOIN ok b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL HAVING count(*) = 9),
    fr AS (SELECT frame, y, x FROM ok ANTI JOIN full_ USING (frame, y, x)),
    near AS (SELECT a.frame, a.y, a.x, min(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) AS d FROM fr a JOIN fr b ON b.frame = a.frame - 2 GROUP BY ALL),
    md AS (SELECT frame, median(d) AS d FROM near GROUP BY frame),
    e AS (SELECT a.frame, a.y * 10000 + a.x AS a, b.y * 10000 + b.x AS b FROM ok a JOIN ok b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach(frame, id, l) AS (SELECT frame, a, a FROM e WHERE a = b UNION SELECT e.frame, e.b, r.l FROM reach r JOIN e ON e.frame = r.frame AND e.a = r.id WHERE r.l < e.b),
    parts AS (SELECT frame, count(DISTINCT l) AS n FROM (SELECT frame, id, min(l) AS l FROM reach GROUP BY ALL) GROUP BY frame)
    SELECT (SELECT round(median(d) / 2, 6) FROM md) AS speed, (SELECT round(avg(CAST(n = 1 AS INT)), 6) FROM parts) AS fraction""")
def front_speed_and_parts(spark: SparkSession, sf: str) -> DataFrame:
    v = _phasic(spark, sf)
    return imaging.leading_edge_speed(v, ["rec"], 2).join(imaging.single_front_fraction(v, ["rec"]), "rec").select(_r("speed"), _r("fraction"))


EPISODES = """p AS (SELECT vec_id AS episode, CASE WHEN vec_id % 3 = 0 THEN 'radial' ELSE 'planar' END AS model, CASE WHEN vec_id % 3 <> 0 THEN (vec_id * 37) % 360 END AS direction, (vec_id * 13) % 900 * 1.0 AS source_x, (vec_id * 29) % 900 * 1.0 AS source_y FROM embeddings),
    m AS (SELECT vec_id AS episode, CASE WHEN vec_id % 4 = 0 THEN 'radial' ELSE 'planar' END AS model, (vec_id % 10) / 100.0 AS p, (vec_id * 41) % 360 AS direction, (vec_id * 17) % 900 * 1.0 AS source_x, (vec_id * 23) % 900 * 1.0 AS source_y FROM embeddings WHERE vec_id % 5 <> 0)"""


@query("q107_confirmed_episodes", f"""WITH {EPISODES} SELECT p.episode, p.model, coalesce(m.model = p.model AND m.p <= 0.05 AND CASE WHEN p.model = 'radial' THEN sqrt(pow(p.source_x - m.source_x, 2) + pow(p.source_y - m.source_y, 2)) <= 250
    ELSE abs((p.direction - m.direction + 180 + 720) % 360 - 180) <= 45 END, false) AS confirmed FROM p LEFT JOIN m USING (episode)""")
def confirmed_episodes(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vec_id")
    e = table(spark, sf, "embeddings").select(
        v.alias("episode"), F.when(v % 3 == 0, "radial").otherwise("planar").alias("model"), F.when(v % 3 != 0, (v * 37 % 360).cast("double")).alias("direction"), (v * 13 % 900).cast("double").alias("source_x"), (v * 29 % 900).cast("double").alias("source_y"))
    m = table(spark, sf, "embeddings").filter("vec_id % 5 <> 0").select(
        v.alias("episode"), F.when(v % 4 == 0, "radial").otherwise("planar").alias("model"), (v % 10 / 100.0).alias("p"), (v * 41 % 360).cast("double").alias("direction"), (v * 17 % 900).cast("double").alias("source_x"), (v * 23 % 900).cast("double").alias("source_y"))
    return episodes.significant_episodes(e, m, ["episode"]).select("episode", "model", "confirmed")


@query("q107b_candidate_frames", f"WITH {GRID} SELECT recording_id, roi_idx, frame FROM grid WHERE (frame >= 3 AND frame < 9) OR (frame >= 7 AND frame < 12) OR (frame >= 28 AND frame < 40)")
def candidate_frames(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.overlapping_ranges(adapters.day_traces(spark, sf), [(3, 9), (7, 12), (28, 40)]).select("recording_id", "roi_idx", "frame")


# ---- events

@query("q108_trapezoid_asymmetry", f"""WITH {WINDOWED}, t AS (SELECT *, (abs(y) + abs(yb)) / 2 AS area FROM ws)
    SELECT recording_id, roi_idx, frame, round(coalesce((coalesce(sum(area) FILTER (WHERE i > pk), 0) - coalesce(sum(area) FILTER (WHERE i <= pk), 0))
      / nullif(coalesce(sum(area) FILTER (WHERE i > pk), 0) + coalesce(sum(area) FILTER (WHERE i <= pk), 0), 0), 0), 6) AS value FROM t GROUP BY ALL""")
def trapezoid_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    return features.trapezoid_asymmetry(_windowed(spark, sf)).select("recording_id", "roi_idx", "frame", _r("value"))


@query("q108c_event_features", f"""WITH {PROMINENCE.replace('WITH ', '')} SELECT m.recording_id, m.roi_idx, m.frame, round(m.prominence / (r.r + 1e-9), 6) AS spike_prom FROM prom m JOIN (SELECT roi_idx, max(v) - min(v) AS r FROM grid GROUP BY 1) r USING (roi_idx)""")
def event_features(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    p = peaks.peak_hierarchy(peaks.prominences(s), 3.0)
    return features.event_features(p, peaks.valley_windows(s, peaks.local_maxima(s)), s).select("recording_id", "roi_idx", "frame", _r("spike_prom"))


# ---- settings, labels, gates

@query("q109_resolved_settings", """WITH f(fs) AS (VALUES (5.0), (7.5), (10.0), (15.0), (20.0), (30.0), (60.0)), g AS (SELECT CAST(fs AS DOUBLE) AS fs FROM f), w AS (SELECT fs, CAST(least(51, fs * 2) AS INT) AS m FROM g)
    SELECT fs, greatest(CAST(0.5 AS DOUBLE), 4 * fs / 15) AS sigma, CAST(greatest(3, round_even(20 * fs / 15, 0)) AS INT) AS distance, CASE WHEN m - (1 - m % 2) > 3 THEN m - (1 - m % 2) END AS savgol,
      range(3, CAST(fs * 4 AS BIGINT), 10) AS pulses FROM w""")
def resolved_settings(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(fs, traces.scale_sigma(4.0, fs), peaks.min_distance_frames(fs), traces.resolve_savgol_window(int(fs * 2)), matching.resolve_schedule("r", int(fs * 4), None, 3, 10)) for fs in (5.0, 7.5, 10.0, 15.0, 20.0, 30.0, 60.0)]
    return spark.createDataFrame(rows, "fs double, sigma double, distance int, savgol int, pulses array<long>")


@query("q110_preserved_labels", "SELECT doc_id AS key, CASE WHEN doc_id % 3 <> 0 AND coalesce(toxic, -1) <> -1 THEN toxic ELSE coalesce(quality, -1) END AS value FROM labels")
def preserved_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels")
    new = rows.select(F.col("doc_id").alias("key"), F.coalesce("quality", F.lit(-1)).alias("value"))
    return labels.preserve_labels(new, rows.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("key"), F.coalesce("toxic", F.lit(-1)).alias("value")), "key")


@query("q110b_reset_labels", "SELECT doc_id AS key, -1 AS value, 'unknown' AS source, coalesce(quality, -1) <> -1 AS changed FROM labels")
def reset_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.coalesce("quality", F.lit(-1)).alias("value"), F.lit("manual").alias("source"))
    return labels.reset_labels(rows)


@query("q110c_deduplicated_keys", """SELECT s_suppkey, CASE WHEN r > 1 THEN k || '_dup' || (r - 1) ELSE k END AS key FROM (SELECT s_suppkey, 'n' || s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS r FROM supplier)""")
def deduplicated_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("key"))
    return labels.deduplicated_keys(rows, "key", ["s_suppkey"])


@query("q110d_quality_flags", """WITH v AS (SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN CAST('nan' AS DOUBLE) WHEN s_suppkey % 7 = 2 THEN CAST('inf' AS DOUBLE) ELSE s_acctbal END AS x FROM supplier),
    f AS (SELECT s_suppkey, x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) AS x_valid FROM v) SELECT s_suppkey, x_valid, CASE WHEN x_valid THEN -1 ELSE 0 END AS label_value, CASE WHEN x_valid THEN 'unknown' ELSE 'auto' END AS label_source FROM f""")
def quality_flags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    x = F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, float("inf")).otherwise(F.col("s_acctbal"))
    flagged = features.quality_flags(table(spark, sf, "supplier").select("s_suppkey", x.alias("x")), ["x"])
    return features.auto_label(flagged.withColumn("x_valid", F.coalesce("x_valid", F.lit(False))), ["x"]).drop("x")


GATED = "g AS (SELECT o_orderpriority AS video, o_orderkey AS roi, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS prediction FROM orders)"


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("video"), F.col("o_orderkey").alias("roi"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("prediction"))


@query("q111_pass_rates", f"WITH {GATED} SELECT video, count(*) AS n_total, count(*) FILTER (WHERE prediction = 1) AS n_kept, round(count(*) FILTER (WHERE prediction = 1) / count(*), 6) AS pass_rate FROM g GROUP BY video")
def pass_rates(spark: SparkSession, sf: str) -> DataFrame:
    return models.pass_rates(_gated(spark, sf), ["video"]).withColumn("pass_rate", F.round("pass_rate", 6))


@query("q111b_filtered_rois", f"WITH {GATED} SELECT video, roi, CAST(row_number() OVER (PARTITION BY video ORDER BY roi) - 1 AS INT) AS filtered_index FROM g WHERE prediction = 1")
def filtered_rois(spark: SparkSession, sf: str) -> DataFrame:
    return models.filter_predicted(_gated(spark, sf), ["video"], "roi").select("video", "roi", "filtered_index")


# ---- files, metadata, validation

@query("q112_ome_metadata", """SELECT n_nationkey AS folder, CASE WHEN n_nationkey % 5 <> 0 THEN (n_nationkey + 1) / 4.0 END AS pixel_size_um,
    CASE WHEN n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN round(1.0 / (n_nationkey + 1), 9) ELSE round(1000.0 / (n_nationkey + 1), 9) END AS fs FROM nation""")
def ome_metadata(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey")
    size = F.when(k % 5 != 0, F.concat(F.lit(' PhysicalSizeX="'), ((k + 1) / 4.0).cast("string"), F.lit('"'))).otherwise("")
    unit = F.when(k % 3 == 0, ' DeltaTUnit="s"').otherwise("")
    planes_ = F.array_join(F.transform(F.sequence(F.lit(0), F.when(k % 7 == 0, 0).otherwise(4)), lambda i: F.concat(F.lit('<Plane TheT="'), i.cast("string"), F.lit('" DeltaT="'), (i * (k + 1)).cast("string"), F.lit('"'), unit, F.lit("/>"))), "")
    xml = F.concat(F.lit('<?xml version="1.0"?><OME xmlns="x"><Image ID="1"><Pixels ID="2"'), size, F.lit(">"), planes_, F.lit("</Pixels></Image></OME>"))
    return planes.ome_metadata(table(spark, sf, "nation").select(k.alias("folder"), xml.alias("xml"))).withColumn("fs", F.round("fs", 9))


@query("q112b_parsed_lists", "SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN [] ELSE range(0, n_nationkey % 4) END AS ids FROM nation")
def parsed_lists(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    text = F.when(k > 0, F.concat(F.lit("["), F.array_join(F.sequence(F.lit(0), k - 1), ", "), F.lit("]")))
    return table(spark, sf, "nation").select("n_nationkey", recordings.parse_list(text).cast("array<long>").alias("ids"))


SUMMARIES = "SELECT n_name AS video, CAST(n_nationkey AS BIGINT) AS n, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE CAST(n_nationkey * 1.5 AS DOUBLE) END AS x FROM nation"


@query("q112c_summary_artifacts", SUMMARIES)
def summary_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from tracewell.scratch import forget_at_exit

    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(F.col("n_name").alias("video"), k.cast("long").alias("n"), F.when(k % 3 == 0, float("nan")).otherwise(k * 1.5).alias("x"))
    path = forget_at_exit(spark, f"{shared_dir(spark)}/tracewell-artifacts-{uuid.uuid4().hex}")
    recordings.write_summaries(rows, path)
    return recordings.read_summaries(spark, path, "video string, n long, x double")[0]


@query("q112d_metadata_file", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def metadata_file(spark: SparkSession, sf: str) -> DataFrame:
    return recordings.read_metadata(spark, f"{sf}/nation.parquet")


@query("q112e_complete_folders", """WITH f AS (SELECT 'rec' || (s_suppkey % 40) AS folder, CASE s_suppkey % 3 WHEN 0 THEN 'F.npy' WHEN 1 THEN 'iscell.npy' ELSE 'ops.npy' END AS name FROM supplier WHERE s_suppkey % 11 < 4),
    h AS (SELECT folder, bool_or(name = 'F.npy') AS f, bool_or(name = 'iscell.npy') AS c FROM f GROUP BY folder)
    SELECT folder, f AND c AS complete, CASE WHEN f AND c THEN 0 ELSE 1 END AS n_missing FROM h WHERE f OR c""")
def complete_folders(spark: SparkSession, sf: str) -> DataFrame:
    return planes.inventory(_listed(spark, sf)).select("folder", "complete", F.size("missing").alias("n_missing"))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.when(k % 3 == 0, "F.npy").when(k % 3 == 1, "iscell.npy").otherwise("ops.npy")
    return table(spark, sf, "supplier").filter(k % 11 < 4).select(F.concat(F.lit("rec"), (k % 40).cast("string")).alias("folder"), name.alias("name"))


@query("q113_small_groups", """SELECT 'error' AS severity, 'group_too_small' AS code, c_nationkey || '/' || c_mktsegment AS grp, count(*) || ' of at least 12' AS message FROM customer GROUP BY c_nationkey, c_mktsegment HAVING count(*) < 12""")
def small_groups(spark: SparkSession, sf: str) -> DataFrame:
    return validation.small_groups(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 12)


@query("q113b_alignment_inputs", """WITH f AS (SELECT 'rec' || (s_suppkey % 40) AS folder, CASE s_suppkey % 3 WHEN 0 THEN 'F.npy' WHEN 1 THEN 'iscell.npy' ELSE 'ops.npy' END AS name FROM supplier WHERE s_suppkey % 11 < 4),
    r AS (SELECT 'rec' || i AS folder FROM range(0, 40) t(i)), n AS (SELECT folder, name FROM r CROSS JOIN (VALUES ('ops.npy'), ('stat.npy')) v(name))
    SELECT 'error' AS severity, 'missing_alignment_input' AS code, folder AS grp, 'missing ' || name AS message FROM n ANTI JOIN f USING (folder, name)
    UNION ALL SELECT 'error', 'missing_snap', folder, 'alignment needs a snapshot' FROM r""")
def alignment_inputs(spark: SparkSession, sf: str) -> DataFrame:
    recs = spark.range(40).select(F.concat(F.lit("rec"), F.col("id").cast("string")).alias("folder"))
    return validation.alignment_inputs(recs, _listed(spark, sf), "folder")


@query("q114_sheet_names", """SELECT * FROM (VALUES ('a[b]:c', 'a_b__c'), ('a?b?*c', 'a_b__c_1'), ('', 'sheet'), ('x', 'x'), ('x', 'x_1'), ('a very long name of a table in a workbook', 'a very long name of a table in '), ('a very long name of a table in another', 'a very long name of a table i_1')) t(name, sheet)""")
def sheet_names(spark: SparkSession, sf: str) -> DataFrame:
    names = ["a[b]:c", "a?b?*c", "", "x", "x", "a very long name of a table in a workbook", "a very long name of a table in another"]
    return spark.createDataFrame(list(zip(names, bundles.sheet_names(names), strict=True)), "name string, sheet string")


@query("q114b_merged_tables", """SELECT n_nationkey AS k, n_name AS a, CAST(NULL AS INT) AS b FROM nation UNION ALL SELECT r_regionkey, NULL, r_regionkey * 2 FROM region""")
def merged_tables(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("a"))
    two = table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), (F.col("r_regionkey") * 2).alias("b"))
    return bundles.merge_tables([{"t": one}, {"t": two, "empty": spark.range(0).select()}])["t"]
