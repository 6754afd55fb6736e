"""Queries on traces, peaks and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import inference, matching, peaks, similarity, traces, waves
from tracewell.plans.registry import GRID, PEAKS, query
from tracewell.sources import adapters

KEY = ["recording_id", "roi_idx"]


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


@query("q01_dense_trace", f"WITH {GRID} SELECT recording_id, roi_idx, frame, v FROM grid")
def dense_trace(spark: SparkSession, sf: str) -> DataFrame:
    return adapters.day_traces(spark, sf)


@query("q02_minmax_global", f"""WITH {GRID}, e AS (SELECT recording_id, min(v) AS lo, max(v) AS hi FROM grid GROUP BY 1)
    SELECT recording_id, roi_idx, frame, round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 6) AS v FROM grid JOIN e USING (recording_id)""")
def minmax_global(spark: SparkSession, sf: str) -> DataFrame:
    return traces.minmax(adapters.day_traces(spark, sf)).select(*KEY, "frame", _r("v"))


@query("q03_zscore_trace", f"""WITH {GRID} SELECT recording_id, roi_idx, frame,
    round((v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0), 6) AS v FROM grid WINDOW w AS (PARTITION BY roi_idx)""")
def zscore_trace(spark: SparkSession, sf: str) -> DataFrame:
    return traces.zscore(adapters.day_traces(spark, sf)).select(*KEY, "frame", _r("v"))


def _kernel_sql(weights: list[float], where: str = "true") -> str:
    r = len(weights) // 2
    rows = ", ".join(f"({k - r}, {w!r})" for k, w in enumerate(weights))
    return f"""WITH {GRID}, k(o, w) AS (VALUES {rows}),
        placed AS (SELECT g.recording_id, g.roi_idx, g.frame, k.w, g.frame + k.o AS p FROM grid g CROSS JOIN k WHERE {where}),
        folded AS (SELECT recording_id, roi_idx, frame, w, ((p % 60) + 60) % 60 AS m FROM placed)
        SELECT f.recording_id, f.roi_idx, f.frame, round(sum(f.w * g.v), 6) AS v
        FROM folded f JOIN grid g ON g.roi_idx = f.roi_idx AND g.frame = CASE WHEN m < 30 THEN m ELSE 59 - m END GROUP BY ALL"""


GAUSS, SAVGOL = traces.gaussian_weights(1.5), traces.savgol_weights(11, 3)


@query("q04_gaussian_smooth", _kernel_sql(GAUSS))
def gaussian_smooth(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.convolve(adapters.trace_arrays(adapters.day_traces(spark, sf)), GAUSS)
    return traces.samples_of(out).select(*KEY, "frame", _r("v"))


@query("q05_savgol_interior", _kernel_sql(SAVGOL, "g.frame BETWEEN 5 AND 24"))
def savgol_interior(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.convolve(adapters.trace_arrays(adapters.day_traces(spark, sf)), SAVGOL, "interior")
    return traces.samples_of(out).filter("v is not null").select(*KEY, "frame", _r("v"))


def _savgol_sql(window: int, order: int) -> str:
    rows = ", ".join(f"({i}, {j}, {w!r})" for i, row in enumerate(traces.savgol_matrix(window, order)) for j, w in enumerate(row))
    start = f"least(greatest(g.frame - {window // 2}, 0), 30 - {window})"
    return f"""WITH {GRID}, k(i, j, w) AS (VALUES {rows}) SELECT g.recording_id, g.roi_idx, g.frame, round(sum(k.w * h.v), 6) AS v
        FROM grid g JOIN k ON k.i = g.frame - {start} JOIN grid h ON h.roi_idx = g.roi_idx AND h.frame = {start} + k.j GROUP BY ALL"""


@query("q05b_savgol_edges", _savgol_sql(11, 3))
def savgol_edges(spark: SparkSession, sf: str) -> DataFrame:
    out = traces.savgol(adapters.trace_arrays(adapters.day_traces(spark, sf)), 11, 3)
    return traces.samples_of(out).select(*KEY, "frame", _r("v"))


@query("q06_rolling_var_of_var", f"""WITH {GRID}, r AS (
      SELECT recording_id, roi_idx, row_number() OVER w AS rn,
             greatest(avg(v * v) OVER (w ROWS 9 PRECEDING) - pow(avg(v) OVER (w ROWS 9 PRECEDING), 2), 0) AS x
      FROM grid WINDOW w AS (PARTITION BY roi_idx ORDER BY frame))
    SELECT recording_id, roi_idx, round(var_pop(x) FILTER (WHERE rn >= 10), 2) AS value FROM r GROUP BY ALL""")
def rolling_var_of_var(spark: SparkSession, sf: str) -> DataFrame:
    return traces.rolling_variance_of_variance(adapters.day_traces(spark, sf), 10).select(*KEY, _r("value", 2))


@query("q07_autocorr_decay", f"""WITH {GRID}, c AS (SELECT *, v - avg(v) OVER (PARTITION BY roi_idx) AS x FROM grid),
    l AS (SELECT *, lag(x, 1) OVER w AS y1, lag(x, 5) OVER w AS y5 FROM c WINDOW w AS (PARTITION BY roi_idx ORDER BY frame))
    SELECT recording_id, roi_idx, round(
      sum(x * y1) / sqrt(sum(x * x) FILTER (WHERE y1 IS NOT NULL) * sum(y1 * y1) + 1e-12)
      - sum(x * y5) / sqrt(sum(x * x) FILTER (WHERE y5 IS NOT NULL) * sum(y5 * y5) + 1e-12), 6) AS value FROM l GROUP BY ALL""")
def autocorr_decay(spark: SparkSession, sf: str) -> DataFrame:
    return traces.autocorr_decay(adapters.day_traces(spark, sf)).select(*KEY, _r("value"))


@query("q08_snr_mad", f"""WITH {GRID}, m AS (SELECT recording_id, roi_idx, v, median(v) OVER (PARTITION BY roi_idx) AS m FROM grid),
    p AS (SELECT recording_id, roi_idx, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.2) AS p20, median(abs(v - m)) AS mad FROM m GROUP BY ALL)
    SELECT recording_id, roi_idx, round(CASE WHEN mad <= 0 THEN 0.0 ELSE (p95 - p20) / (mad * 1.4826 + 1e-9) END, 6) AS value FROM p""")
def snr_mad(spark: SparkSession, sf: str) -> DataFrame:
    return traces.snr(adapters.day_traces(spark, sf)).select(*KEY, _r("value"))


@query("q09_derivative_skew_asym", f"""WITH {GRID}, d AS (SELECT recording_id, roi_idx, v - lag(v) OVER (PARTITION BY roi_idx ORDER BY frame) AS d FROM grid),
    c AS (SELECT *, d - avg(d) OVER (PARTITION BY roi_idx) AS x FROM d WHERE d IS NOT NULL)
    SELECT recording_id, roi_idx, round(coalesce(avg(x * x * x) / nullif(pow(avg(x * x), 1.5), 0), 0), 6) AS skew,
      round(sum(CASE WHEN d > 0 THEN d ELSE 0 END) / (sum(CASE WHEN d < 0 THEN -d ELSE 0 END) + 1e-9), 6) AS asymmetry FROM c GROUP BY ALL""")
def derivative_skew_asym(spark: SparkSession, sf: str) -> DataFrame:
    return traces.derivative_features(adapters.day_traces(spark, sf)).select(*KEY, _r("skew"), _r("asymmetry"))


@query("q10_local_maxima", f"WITH {PEAKS} SELECT recording_id, roi_idx, frame, v FROM peaks")
def local_maxima(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.local_maxima(adapters.day_traces(spark, sf))


PROMINENCE = PEAKS + """,
le AS (SELECT p.roi_idx, p.frame, coalesce(max(g.frame), -1) AS e FROM peaks p LEFT JOIN grid g ON g.roi_idx = p.roi_idx AND g.frame < p.frame AND g.v > p.v GROUP BY ALL),
re AS (SELECT p.roi_idx, p.frame, coalesce(min(g.frame), 999) AS e FROM peaks p LEFT JOIN grid g ON g.roi_idx = p.roi_idx AND g.frame > p.frame AND g.v > p.v GROUP BY ALL),
lb AS (SELECT p.roi_idx, p.frame, min(g.v) AS m, max(g.frame) FILTER (WHERE g.v = x.m) AS at FROM peaks p JOIN le USING (roi_idx, frame)
       JOIN (SELECT p.roi_idx, p.frame, min(g.v) AS m FROM peaks p JOIN le USING (roi_idx, frame) JOIN grid g ON g.roi_idx = p.roi_idx AND g.frame > le.e AND g.frame <= p.frame GROUP BY ALL) x USING (roi_idx, frame)
       JOIN grid g ON g.roi_idx = p.roi_idx AND g.frame > le.e AND g.frame <= p.frame GROUP BY ALL),
rb AS (SELECT p.roi_idx, p.frame, min(g.v) AS m, min(g.frame) FILTER (WHERE g.v = x.m) AS at FROM peaks p JOIN re USING (roi_idx, frame)
       JOIN (SELECT p.roi_idx, p.frame, min(g.v) AS m FROM peaks p JOIN re USING (roi_idx, frame) JOIN grid g ON g.roi_idx = p.roi_idx AND g.frame < re.e AND g.frame >= p.frame GROUP BY ALL) x USING (roi_idx, frame)
       JOIN grid g ON g.roi_idx = p.roi_idx AND g.frame < re.e AND g.frame >= p.frame GROUP BY ALL),
prom AS (SELECT p.recording_id, p.roi_idx, p.frame, p.v, CAST(lb.at AS INT) AS left_base, CAST(rb.at AS INT) AS right_base, p.v - greatest(lb.m, rb.m) AS prominence
         FROM peaks p JOIN lb USING (roi_idx, frame) JOIN rb USING (roi_idx, frame))"""


@query("q11_prominence", f"WITH {PROMINENCE} SELECT recording_id, roi_idx, frame, left_base, right_base, round(prominence, 6) AS prominence FROM prom")
def prominence(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.prominences(adapters.day_traces(spark, sf)).select(*KEY, "frame", "left_base", "right_base", _r("prominence"))


@query("q12_peak_clusters", f"""WITH {PEAKS}, f AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 3 THEN 1 ELSE 0 END AS far FROM peaks WINDOW w AS (PARTITION BY roi_idx ORDER BY frame))
    SELECT recording_id, roi_idx, frame, CAST(sum(far) OVER (PARTITION BY roi_idx ORDER BY frame) AS INT) AS cluster FROM f""")
def peak_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.peak_clusters(peaks.local_maxima(adapters.day_traces(spark, sf)), 3).select(*KEY, "frame", "cluster")


@query("q13_peak_features", f"""WITH {PROMINENCE}, f AS (SELECT *, CASE WHEN frame - lag(frame) OVER w > 3 THEN 1 ELSE 0 END AS far FROM prom WINDOW w AS (PARTITION BY roi_idx ORDER BY frame)),
    c AS (SELECT *, sum(far) OVER (PARTITION BY roi_idx ORDER BY frame) AS cluster FROM f),
    p AS (SELECT *, max(prominence) OVER (PARTITION BY roi_idx, cluster) AS parent FROM c)
    SELECT recording_id, roi_idx, frame, round(parent, 6) AS parent_prominence, round(prominence / (parent + 1e-9), 6) AS dominance FROM p""")
def peak_features(spark: SparkSession, sf: str) -> DataFrame:
    out = peaks.peak_hierarchy(peaks.prominences(adapters.day_traces(spark, sf)), 3)
    return out.select(*KEY, "frame", _r("parent_prominence"), _r("dominance"))


@query("q14_peaks_min_distance")
def peaks_min_distance(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.peaks_min_distance(adapters.trace_arrays(adapters.day_traces(spark, sf)), 3)


VALLEYS = PEAKS + """,
near AS (SELECT *, coalesce(lag(frame) OVER w, 0) AS prev, coalesce(lead(frame) OVER w, 30) AS next FROM peaks WINDOW w AS (PARTITION BY roi_idx ORDER BY frame)),
wlo AS (SELECT n.roi_idx, n.frame, arg_min(g.frame, (g.v, g.frame)) AS lo FROM near n JOIN grid g ON g.roi_idx = n.roi_idx AND g.frame >= n.prev AND g.frame < n.frame GROUP BY ALL),
whi AS (SELECT n.roi_idx, n.frame, arg_min(g.frame, (g.v, g.frame)) AS hi FROM near n JOIN grid g ON g.roi_idx = n.roi_idx AND g.frame >= n.frame AND g.frame < n.next GROUP BY ALL),
valley AS (SELECT n.recording_id, n.roi_idx, n.frame, lo, hi FROM near n JOIN wlo USING (roi_idx, frame) JOIN whi USING (roi_idx, frame))"""


@query("q15_valley_windows", f"WITH {VALLEYS} SELECT recording_id, roi_idx, frame, lo, hi FROM valley")
def valley_windows(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    return peaks.valley_windows(s, peaks.local_maxima(s))


WINDOWED = VALLEYS + """,
ws0 AS (SELECT w.recording_id, w.roi_idx, w.frame, g.frame - w.lo AS i, g.v, min(g.v) OVER q AS b, max(g.v) OVER q - min(g.v) OVER q AS a, count(*) OVER q AS n
        FROM valley w JOIN grid g ON g.roi_idx = w.roi_idx AND g.frame >= w.lo AND g.frame < w.hi WINDOW q AS (PARTITION BY w.roi_idx, w.frame)),
ws1 AS (SELECT recording_id, roi_idx, frame, i, (v - b) / a AS y FROM ws0 WHERE n >= 3 AND a > 1e-8),
ws AS (SELECT *, first_value(i) OVER (PARTITION BY roi_idx, frame ORDER BY y DESC, i) AS pk, lag(y) OVER o AS yb, lead(y) OVER o AS ya FROM ws1 WINDOW o AS (PARTITION BY roi_idx, frame ORDER BY i)),
ids AS (SELECT DISTINCT recording_id, roi_idx, frame FROM ws)"""


def _windowed(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    return peaks.window_samples(s, peaks.valley_windows(s, peaks.local_maxima(s)))


@query("q16_rise_slope", f"""WITH {WINDOWED} SELECT recording_id, roi_idx, frame, round(CASE WHEN count(*) >= 2 THEN regr_slope(y, i) END, 6) AS value
    FROM ws WHERE i <= pk GROUP BY ALL""")
def rise_slope(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.rise_slope(_windowed(spark, sf)).select(*KEY, "frame", _r("value"))


@query("q17_decay_tau", f"""WITH {WINDOWED}, d AS (SELECT *, i - pk AS j FROM ws WHERE i >= pk),
    c AS (SELECT roi_idx, frame, j, y, yb FROM d WHERE y <= exp(-1) QUALIFY row_number() OVER (PARTITION BY roi_idx, frame ORDER BY j) = 1)
    SELECT recording_id, roi_idx, frame, round(CASE WHEN j = 0 THEN 0.0 ELSE j - 1 + (yb - exp(-1)) / (yb - y) END, 6) AS value FROM ids LEFT JOIN c USING (roi_idx, frame)""")
def decay_tau(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.decay_tau(_windowed(spark, sf)).select(*KEY, "frame", _r("value"))


@query("q18_half_max_width", f"""WITH {WINDOWED},
    l AS (SELECT roi_idx, frame, i + (0.5 - y) / (ya - y) AS a FROM ws WHERE i < pk AND y <= 0.5 QUALIFY row_number() OVER (PARTITION BY roi_idx, frame ORDER BY i DESC) = 1),
    r AS (SELECT roi_idx, frame, i - 1 + (yb - 0.5) / (yb - y) AS b FROM ws WHERE i > pk AND y <= 0.5 QUALIFY row_number() OVER (PARTITION BY roi_idx, frame ORDER BY i) = 1)
    SELECT recording_id, roi_idx, frame, round(b - a, 6) AS value FROM ids LEFT JOIN l USING (roi_idx, frame) LEFT JOIN r USING (roi_idx, frame)""")
def half_max_width(spark: SparkSession, sf: str) -> DataFrame:
    return peaks.half_max_width(_windowed(spark, sf)).select(*KEY, "frame", _r("value"))


@query("q19_neuron_summary", f"""WITH {PROMINENCE} SELECT recording_id, roi_idx, count(*) AS spike_count, round(count(*) / 30.0, 6) AS spike_freq,
    array_to_string(list_sort(list(frame)), ',') AS spike_indices, round(avg(prominence), 6) AS mean_prominence, round(var_samp(prominence), 4) AS var_prominence FROM prom GROUP BY ALL""")
def neuron_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = peaks.neuron_summary(peaks.prominences(adapters.day_traces(spark, sf)), adapters.DAYS)
    return out.select(*KEY, "spike_count", _r("spike_freq"), F.array_join("spike_indices", ",").alias("spike_indices"), _r("mean_prominence"), _r("var_prominence", 4))


@query("q20_section_summary", f"""WITH {PEAKS}, s(section, lo, hi) AS (VALUES ('whole', 0, 30), ('early', 0, 10), ('late', 20, 30)), r AS (SELECT DISTINCT recording_id, roi_idx FROM peaks)
    SELECT r.recording_id, r.roi_idx, s.section, count(p.frame) AS spike_count, round(count(p.frame) / (any_value(hi) - any_value(lo)), 6) AS spike_freq, count(p.frame) > 0 AS active
    FROM r CROSS JOIN s LEFT JOIN peaks p ON p.roi_idx = r.roi_idx AND p.frame >= lo AND p.frame < hi GROUP BY r.recording_id, r.roi_idx, s.section""")
def section_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = peaks.section_summary(peaks.local_maxima(adapters.day_traces(spark, sf)), {"whole": (0, 30), "early": (0, 10), "late": (20, 30)})
    return out.select(*KEY, "section", "spike_count", _r("spike_freq"), "active")


MATCHED = PEAKS + """, pulse(p) AS (SELECT unnest(range(2, 30, 5))),
hit AS (SELECT *, CASE WHEN p IS NOT NULL AND row_number() OVER (PARTITION BY roi_idx, p ORDER BY frame) = 1 THEN p END AS pulse
        FROM peaks LEFT JOIN pulse ON frame BETWEEN p AND p + 2)"""


def _matched(spark: SparkSession, sf: str) -> DataFrame:
    return matching.pulse_match(peaks.local_maxima(adapters.day_traces(spark, sf)), matching.schedule(2, 5, 30), 2, KEY)


@query("q40_pulse_match", f"WITH {MATCHED} SELECT recording_id, roi_idx, frame, CAST(pulse AS INT) AS pulse, pulse IS NOT NULL AS evoked, CAST((frame - pulse) * 1000 AS INT) AS latency_ms FROM hit")
def pulse_match(spark: SparkSession, sf: str) -> DataFrame:
    return _matched(spark, sf).select(*KEY, "frame", "pulse", F.col("pulse").isNotNull().alias("evoked"), ((F.col("frame") - F.col("pulse")) * 1000).alias("latency_ms"))


@query("q40b_response_groups", f"""WITH {MATCHED} SELECT recording_id, roi_idx, count(DISTINCT pulse) AS n_responses,
    CASE WHEN count(DISTINCT pulse) > 0 THEN 'ON_' || count(DISTINCT pulse) || '_response(s)' END AS group_id FROM hit GROUP BY ALL""")
def response_groups(spark: SparkSession, sf: str) -> DataFrame:
    return matching.response_groups(_matched(spark, sf), KEY)


@query("q41_stereotypy", f"""WITH {MATCHED} SELECT recording_id, roi_idx, count(*) AS n, round(avg(frame - pulse), 6) AS mean, round(stddev_samp(frame - pulse), 6) AS sd,
    round(stddev_samp(frame - pulse) / nullif(avg(frame - pulse), 0), 6) AS cv FROM hit WHERE pulse IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def stereotypy(spark: SparkSession, sf: str) -> DataFrame:
    latency = _matched(spark, sf).withColumn("latency", (F.col("frame") - F.col("pulse")).cast("double"))
    return matching.stereotypy(latency, KEY, "latency").select(*KEY, "n", _r("mean"), _r("sd"), _r("cv"))


@query("q42_light_evoked_bins", f"""WITH {GRID}, d AS (SELECT *, v - lag(v) OVER (PARTITION BY roi_idx ORDER BY frame) AS d FROM grid),
    b(bin, lo, hi) AS (VALUES (0, 2, 5), (1, 10, 13), (2, 18, 21), (3, 25, 28)),
    x AS (SELECT recording_id, roi_idx, bin, max(greatest(d, 0)) AS up, max(greatest(-d, 0)) AS down FROM d JOIN b ON frame >= lo AND frame < hi GROUP BY ALL),
    s AS (SELECT recording_id, roi_idx, bin, CASE WHEN up >= down THEN 1 ELSE -1 END AS sign FROM x WHERE greatest(up, down) >= 50)
    SELECT recording_id, roi_idx, bin, sign FROM s QUALIFY sum(sign) OVER (PARTITION BY roi_idx) = 0 OR sign(sum(sign) OVER (PARTITION BY roi_idx)) = sign""")
def light_evoked_bins(spark: SparkSession, sf: str) -> DataFrame:
    return matching.activations(adapters.day_traces(spark, sf), KEY, [(2, 5), (10, 13), (18, 21), (25, 28)], 50.0)


DT, STOP = 43_200, 30 * 86_400
TRAINS = """buys AS (SELECT user_id % 5 AS recording_id, user_id AS roi, CAST(floor(epoch(ts)) AS BIGINT) - CAST(epoch(TIMESTAMP '2024-01-01') AS BIGINT) AS t FROM events WHERE event_type = 'purchase'),
own AS (SELECT *, row_number() OVER () AS id FROM buys),
hits AS (SELECT a.recording_id, a.roi AS i, b.roi AS j, count(DISTINCT a.id) AS hits FROM own a JOIN own b ON a.recording_id = b.recording_id AND a.roi <> b.roi AND abs(a.t - b.t) <= 43200 GROUP BY ALL),
sizes AS (SELECT recording_id, roi AS i, count(*) AS n_i FROM buys GROUP BY ALL),
clipped AS (SELECT recording_id, roi, greatest(t - 43200, 0) AS lo, least(t + 43200, 2592000) AS hi FROM buys),
grown AS (SELECT *, greatest(hi - greatest(lo, coalesce(max(hi) OVER (PARTITION BY roi ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)), 0) AS add FROM clipped WHERE hi > lo),
tiled AS (SELECT recording_id, roi, sum(add) / 2592000.0 AS tiled FROM grown GROUP BY ALL)"""


@query("q43_coincidence", f"WITH {TRAINS} SELECT recording_id, i, j, hits, n_i FROM hits JOIN sizes USING (recording_id, i)")
def coincidence(spark: SparkSession, sf: str) -> DataFrame:
    return matching.coincidence(adapters.purchases(spark, sf), DT)


@query("q44_tiled_fraction", f"WITH {TRAINS} SELECT recording_id, roi AS roi_idx, round(tiled, 6) AS tiled FROM tiled")
def tiled_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return matching.tiled_fraction(adapters.purchases(spark, sf), DT, 0, STOP, KEY).select(*KEY, _r("tiled"))


@query("q45_sttc", f"""WITH {TRAINS}, p AS (SELECT h.recording_id, h.i, h.j, hits / n_i AS p FROM hits h JOIN sizes USING (recording_id, i)),
    x AS (SELECT a.recording_id, a.roi AS i, b.roi AS j, a.tiled AS ta, b.tiled AS tb, coalesce(p.p, 0) AS pa, coalesce(q.p, 0) AS pb
          FROM tiled a JOIN tiled b ON a.recording_id = b.recording_id AND a.roi < b.roi
          LEFT JOIN p ON p.i = a.roi AND p.j = b.roi LEFT JOIN p q ON q.i = b.roi AND q.j = a.roi)
    SELECT recording_id, i, j, round(0.5 * (coalesce((pa - tb) / nullif(1 - pa * tb, 0), 0) + coalesce((pb - ta) / nullif(1 - pb * ta, 0), 0)), 6) AS sttc FROM x""")
def sttc(spark: SparkSession, sf: str) -> DataFrame:
    return matching.sttc(adapters.purchases(spark, sf), DT, 0, STOP, digits=6)


Z = GRID + """,
z AS (SELECT recording_id, roi_idx, frame, CASE WHEN stddev_pop(v) OVER w < 1e-8 THEN 0 ELSE (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) END AS z FROM grid WINDOW w AS (PARTITION BY roi_idx))"""


@query("q46_lagged_corr", f"""WITH {Z}, lags(k) AS (SELECT unnest(range(-3, 4))),
    c AS (SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, k, sum(a.z * b.z) / count(*) AS c
          FROM z a JOIN z b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx JOIN lags ON a.frame = b.frame + k GROUP BY ALL)
    SELECT recording_id, i, j, round(least(greatest(max(c), 0), 1), 6) AS value FROM c GROUP BY ALL""")
def lagged_corr(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.max_crosscorr(adapters.trace_arrays(adapters.day_traces(spark, sf)), 3, digits=6)


@query("q47_weighted_pearson", f"""WITH {GRID}, p AS (SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, a.v AS x, b.v AS y, pow(greatest(abs(a.v), abs(b.v)), 2) AS w
      FROM grid a JOIN grid b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame),
    m AS (SELECT recording_id, i, j, sum(w * x) / nullif(sum(w), 0) AS mx, sum(w * y) / nullif(sum(w), 0) AS my, sum(w * x * y) / nullif(sum(w), 0) AS xy,
          sum(w * x * x) / nullif(sum(w), 0) AS xx, sum(w * y * y) / nullif(sum(w), 0) AS yy FROM p GROUP BY ALL),
    d AS (SELECT *, sqrt(greatest(xx - mx * mx, 0) * greatest(yy - my * my, 0)) AS d FROM m)
    SELECT recording_id, i, j, round(coalesce(CASE WHEN d < 1e-12 THEN 0 ELSE least(greatest((xy - mx * my) / nullif(d, 0), -1), 1) END, 0), 5) AS value FROM d""")
def weighted_pearson(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.weighted_pearson_pairs(adapters.trace_arrays(adapters.day_traces(spark, sf)), digits=5)


@query("q48_ordinal_spearman", f"""WITH {GRID}, r AS (SELECT *, row_number() OVER (PARTITION BY roi_idx ORDER BY v, frame) - 1 AS r FROM grid)
    SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, round(corr(a.r, b.r), 6) AS value
    FROM r a JOIN r b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame GROUP BY ALL""")
def ordinal_spearman(spark: SparkSession, sf: str) -> DataFrame:
    ranked = adapters.trace_arrays(adapters.day_traces(spark, sf)).withColumn("f", similarity.ordinal(F.col("f")))
    return similarity.pearson_pairs(ranked, digits=6)


@query("q49_combined_similarity", f"""WITH {Z}, {TRAINS.replace("hits AS", "hit2 AS", 1).replace("FROM own a JOIN own b", "FROM own a JOIN own b")},
    p AS (SELECT h.recording_id, h.i, h.j, hits / n_i AS p FROM hit2 h JOIN sizes USING (recording_id, i)),
    x AS (SELECT a.recording_id, a.roi AS i, b.roi AS j, a.tiled AS ta, b.tiled AS tb, coalesce(p.p, 0) AS pa, coalesce(q.p, 0) AS pb
          FROM tiled a JOIN tiled b ON a.recording_id = b.recording_id AND a.roi < b.roi
          LEFT JOIN p ON p.i = a.roi AND p.j = b.roi LEFT JOIN p q ON q.i = b.roi AND q.j = a.roi),
    s AS (SELECT recording_id, i, j, 0.5 * (coalesce((pa - tb) / nullif(1 - pa * tb, 0), 0) + coalesce((pb - ta) / nullif(1 - pb * ta, 0), 0)) AS v FROM x),
    c AS (SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, sum(a.z * b.z) / count(*) AS c
          FROM z a JOIN z b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame GROUP BY ALL)
    SELECT c.recording_id, c.i, c.j, round(least(greatest(c, 0), 1) * least(greatest(v, 0), 1), 6) AS value FROM c JOIN s USING (recording_id, i, j)""")
def combined_similarity(spark: SparkSession, sf: str) -> DataFrame:
    trains = matching.trains(adapters.purchases(spark, sf), DT, 0, STOP)
    return similarity.combined_pairs(adapters.trace_arrays(adapters.day_traces(spark, sf)), trains, 0, DT, digits=6)


SHIFTED = """reps(repeat) AS (SELECT unnest(range(0, 50))),
shifted AS (SELECT recording_id, CAST(repeat AS INT) AS repeat, (frame + CAST('0x' || substr(md5(concat(roi_idx, '|', repeat, '|42')), 1, 12) AS BIGINT)) % 30 AS spot, count(*) AS n FROM {peaks} CROSS JOIN reps GROUP BY ALL)"""
SPREAD = traces.gaussian_weights(1.5)
OFFSETS = "k(o, w) AS (VALUES " + ", ".join(f"({i - len(SPREAD) // 2}, {w!r})" for i, w in enumerate(SPREAD)) + ")"
DENSITY = """r AS (SELECT DISTINCT recording_id FROM {peaks}), c AS (SELECT recording_id, frame, count(DISTINCT roi_idx) AS n FROM {peaks} GROUP BY ALL),
density AS (SELECT r.recording_id, CAST(f.frame AS INT) AS frame, round(coalesce(sum(c.n * k.w), 0), 12) AS v FROM r CROSS JOIN range(0, 30) f(frame) LEFT JOIN k ON true LEFT JOIN c ON c.recording_id = r.recording_id AND c.frame + k.o = f.frame GROUP BY ALL)"""
MAXIMA = "wrapped AS (SELECT recording_id, repeat, (spot + o + 30) % 30 AS spot, sum(n * w) AS v FROM shifted CROSS JOIN k GROUP BY ALL), maxima AS (SELECT recording_id, repeat, round(max(v), 12) AS peak FROM wrapped GROUP BY ALL)"


@query("q63_circular_shift_null", f"WITH {PEAKS}, {SHIFTED.format(peaks='peaks')} SELECT recording_id, repeat, max(n) AS peak FROM shifted GROUP BY ALL")
def circular_shift_null(spark: SparkSession, sf: str) -> DataFrame:
    return inference.circular_shift_null(peaks.local_maxima(adapters.day_traces(spark, sf)), "recording_id", "roi_idx", "frame", adapters.DAYS, 50)


@query("q63b_event_density", f"""WITH {PEAKS}, r AS (SELECT DISTINCT recording_id FROM peaks)
    SELECT r.recording_id, CAST(f.frame AS INT) AS frame, count(p.frame) AS n FROM r CROSS JOIN range(0, 30) f(frame) LEFT JOIN peaks p ON p.recording_id = r.recording_id AND p.frame = f.frame GROUP BY ALL""")
def event_density(spark: SparkSession, sf: str) -> DataFrame:
    return waves.event_density(peaks.local_maxima(adapters.day_traces(spark, sf)), ["recording_id"], "frame", adapters.DAYS)


@query("q63c_smoothed_density", f"WITH {PEAKS}, {OFFSETS}, {DENSITY.format(peaks='peaks')} SELECT recording_id, frame, round(v, 6) AS v FROM density")
def smoothed_density(spark: SparkSession, sf: str) -> DataFrame:
    at = peaks.local_maxima(adapters.day_traces(spark, sf))
    return waves.smoothed_density(at, ["recording_id"], "roi_idx", "frame", adapters.DAYS, 1.5).select("recording_id", "frame", _r("v"))


@query("q63d_smoothed_null", f"WITH {PEAKS}, {OFFSETS}, {SHIFTED.format(peaks='peaks')}, {MAXIMA} SELECT recording_id, repeat, round(peak, 6) AS peak FROM maxima")
def smoothed_null(spark: SparkSession, sf: str) -> DataFrame:
    at = peaks.local_maxima(adapters.day_traces(spark, sf))
    return inference.circular_shift_null(at, "recording_id", "roi_idx", "frame", adapters.DAYS, 50, sigma=1.5).select("recording_id", "repeat", _r("peak"))
