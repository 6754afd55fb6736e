"""Queries on travelling activity, movies and feature tables, and the whole analyses of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import episodes, features, imaging, inference, peaks, similarity, traces, wave_tables, waves
from tracewell.plans import wave_workflows
from tracewell.plans.registry import GRID, ORACLES, PEAKS, query
from tracewell.plans.spatial_queries import MOVIE, PHASIC, _movie, _phasic
from tracewell.plans.trace_queries import DENSITY, MAXIMA, OFFSETS, PROMINENCE, SHIFTED, WINDOWED
from tracewell.sources import adapters

KEY = ["recording_id", "roi_idx"]


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _kernel(name: str, weights: list[float]) -> str:
    return f"{name}(o, w) AS (VALUES " + ", ".join(f"({k - len(weights) // 2}, {w!r})" for k, w in enumerate(weights)) + ")"


@query("q83b_correlation_t", f"""WITH {GRID}, r AS (SELECT a.recording_id, a.roi_idx AS i, b.roi_idx AS j, covar_pop(a.v, b.v) AS c, stddev_pop(a.v) * stddev_pop(b.v) AS s, count(*) AS n
      FROM grid a JOIN grid b ON a.recording_id = b.recording_id AND a.roi_idx < b.roi_idx AND a.frame = b.frame GROUP BY ALL),
    q AS (SELECT recording_id, i, j, n, CASE WHEN s < 1e-12 THEN 0 ELSE c / s END AS r FROM r)
    SELECT recording_id, i, j, round(r * sqrt((n - 2) / (1 - r * r + 1e-10)), 5) AS t FROM q""")
def correlation_t(spark: SparkSession, sf: str) -> DataFrame:
    p = similarity.pairs(adapters.trace_arrays(adapters.day_traces(spark, sf)))
    r = p.select("recording_id", "i", "j", similarity.pearson(F.col("fa"), F.col("fb")).alias("r"), F.size("fa").alias("n"))
    return inference.correlation_significance(r, "r", "n").select("recording_id", "i", "j", _r("t", 5))


@query("q85_roi_feature_table", f"""WITH a AS ({ORACLES["q06_rolling_var_of_var"]}), b AS ({ORACLES["q07_autocorr_decay"]}), c AS ({ORACLES["q08_snr_mad"]}), d AS ({ORACLES["q09_derivative_skew_asym"]}),
    p AS ({ORACLES["q11_prominence"]}), n AS (SELECT recording_id, roi_idx, count(*) AS n_peaks, median(prominence) AS median_prominence FROM p GROUP BY ALL)
    SELECT a.recording_id, a.roi_idx, a.value AS variance_of_variance, b.value AS autocorr_decay, c.value AS snr, d.skew, d.asymmetry, n.n_peaks, round(n.median_prominence, 5) AS median_prominence
    FROM a JOIN b USING (roi_idx) JOIN c USING (roi_idx) JOIN d USING (roi_idx) LEFT JOIN n ON n.roi_idx = a.roi_idx""")
def roi_feature_table(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    peak = peaks.prominences(s).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_peaks"), F.round(F.median("prominence"), 5).alias("median_prominence"))
    return _rounded_features(traces.roi_features(s, 10)).join(peak, KEY, "left")


def _rounded_features(features_: DataFrame) -> DataFrame:
    """Rounded as the queries on the single features are."""
    return features_.select(*KEY, *[_r(c, ROUNDED.get(c, 6)) for c in features_.columns if c not in KEY])


#: Digits of the single features' queries where they aren't 6.
ROUNDED = {"variance_of_variance": 2}


@query("q67b_phasic_derivative", f"""WITH {MOVIE}, g AS (SELECT frame, y, x, v AS raw, lead(v) OVER w AS a, lag(v) OVER w AS b FROM movie WINDOW w AS (PARTITION BY y, x ORDER BY frame)),
    s AS (SELECT frame, y, x, coalesce((a - b) / 2, a - raw, raw - b, 0) AS v FROM g), m AS (SELECT *, median(v) OVER (PARTITION BY y, x) AS m FROM s), d AS (SELECT *, median(abs(v - m)) OVER (PARTITION BY y, x) AS mad FROM m),
    act AS (SELECT frame, y, x FROM d WHERE (v - m) / greatest(mad * 1.4826, 1e-7) >= 0.8)
    SELECT a.frame, a.y AS "by", a.x AS bx FROM act a JOIN act b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY ALL""")
def phasic_derivative(spark: SparkSession, sf: str) -> DataFrame:
    return waves.phasic(_blocks(spark, sf), ["recording_id"], 0.8, 1, "derivative").select("frame", "by", "bx")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _movie(spark, sf).select(F.lit(0).alias("recording_id"), "frame", F.col("y").alias("by"), F.col("x").alias("bx"), "v")


CHANGE = f"""{MOVIE}, {_kernel("k", traces.gaussian_weights(5.0))},
pos AS (SELECT *, row_number() OVER (PARTITION BY y, x ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY y, x) AS n FROM movie),
base AS (SELECT p.frame, p.y, p.x, p.i, p.n, p.v, sum(k.w * q.v) AS b FROM pos p CROSS JOIN k JOIN pos q ON q.y = p.y AND q.x = p.x AND q.i = least(greatest(p.i + k.o, 0), p.n - 1) GROUP BY ALL),
rel AS (SELECT frame, y, x, i, n, (v - b) / greatest(b, median(b) OVER (PARTITION BY y, x) * 0.05, 1) AS c FROM base),
change AS (SELECT frame, y, x, i, n, c - median(c) OVER (PARTITION BY frame) AS v FROM rel)"""


@query("q93b_relative_change", f"""WITH {CHANGE} SELECT frame, y AS "by", x AS bx, round(v, 6) AS v FROM change""")
def relative_change(spark: SparkSession, sf: str) -> DataFrame:
    return imaging.relative_change(_blocks(spark, sf), ["recording_id"], 5.0).select("frame", "by", "bx", _r("v"))


_Z = ", ".join(f"({c} - median({c}) OVER ()) / greatest(mad_{c} * 1.4826, 1e-12) AS {c}" for c in ("energy", "spatiality", "coherence", "divergence"))
_MAD = ", ".join(f"(SELECT median(abs({c} - m)) FROM frames, (SELECT median({c}) AS m FROM frames)) AS mad_{c}" for c in ("energy", "spatiality", "coherence", "divergence"))


@query("q93_movie_gradient_metrics", f"""WITH {CHANGE}, {_kernel("kd", traces.derivative_weights(1.0))},
    t AS (SELECT p.frame, p.y, p.x, p.v, sum(kd.w * q.v) AS gt FROM change p CROSS JOIN kd JOIN change q ON q.y = p.y AND q.x = p.x AND q.i = least(greatest(p.i + kd.o, 0), p.n - 1) GROUP BY ALL),
    s AS (SELECT frame, y, x, gt, coalesce((lead(v) OVER wy - lag(v) OVER wy) / 2, lead(v) OVER wy - v, v - lag(v) OVER wy, 0) AS gy, coalesce((lead(v) OVER wx - lag(v) OVER wx) / 2, lead(v) OVER wx - v, v - lag(v) OVER wx, 0) AS gx
          FROM t WINDOW wy AS (PARTITION BY frame, x ORDER BY y), wx AS (PARTITION BY frame, y ORDER BY x)),
    d AS (SELECT *, gx * gx + gy * gy AS steep, greatest(quantile_cont(gx * gx + gy * gy, 0.75) OVER (PARTITION BY frame) * 0.1, 1e-12) AS damp FROM s),
    f AS (SELECT *, -gt * gx / (steep + damp) AS fx, -gt * gy / (steep + damp) AS fy, greatest(gt, 0) AS rise FROM d),
    u AS (SELECT *, sqrt(fx * fx + fy * fy) AS size, rise * sqrt(steep) AS w, coalesce((lead(fx) OVER wx - lag(fx) OVER wx) / 2, lead(fx) OVER wx - fx, fx - lag(fx) OVER wx, 0) + coalesce((lead(fy) OVER wy - lag(fy) OVER wy) / 2, lead(fy) OVER wy - fy, fy - lag(fy) OVER wy, 0) AS div
          FROM f WINDOW wy AS (PARTITION BY frame, x ORDER BY y), wx AS (PARTITION BY frame, y ORDER BY x)),
    frames AS (SELECT frame, quantile_cont(rise, 0.9) AS energy, stddev_pop(gt) / (avg(abs(gt)) + 1e-12) AS spatiality,
          sqrt(pow(coalesce(sum(w * fx / size) FILTER (WHERE size > 0) / nullif(sum(w), 0), 0), 2) + pow(coalesce(sum(w * fy / size) FILTER (WHERE size > 0) / nullif(sum(w), 0), 0), 2)) AS coherence, quantile_cont(greatest(div, 0), 0.95) AS divergence FROM u GROUP BY frame),
    mads AS (SELECT {_MAD}), z AS (SELECT frame, {_Z} FROM frames CROSS JOIN mads)
    SELECT frame, round(energy, 5) AS energy, round(spatiality, 5) AS spatiality, round(coherence, 5) AS coherence, round(divergence, 5) AS divergence, round(energy + 0.5 * spatiality + 0.5 * greatest(coherence, divergence), 5) AS score FROM z""")
def movie_gradient_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = imaging.gradient_metrics(imaging.relative_change(_blocks(spark, sf), ["recording_id"], 5.0), ["recording_id"])
    return out.select("frame", *[_r(c, 5) for c in ("energy", "spatiality", "coherence", "divergence", "score")])


def _renamed(sql: str, names: list[str]) -> str:
    """sql with its common tables renamed, so that it can stand before another text with the same names."""
    import re

    return re.sub(r"\b(" + "|".join(names) + r")\b(?=\s|\)|,|\.)", r"\g<1>0", sql)


_FIRST = _renamed(PEAKS, ["users", "daily", "grid", "marked", "runs", "sides", "peaks"])
_SLOPES = _renamed(GRID, ["users", "daily", "grid"])


@query("q94_derivative_onsets", f"""WITH {PEAKS.replace(GRID, f"""{_SLOPES}, {_kernel("kd", traces.derivative_weights(1.5))},
    grid AS (SELECT g.recording_id, g.roi_idx, g.frame, round(sum(kd.w * h.v), 9) AS v FROM grid0 g CROSS JOIN kd JOIN grid0 h ON h.roi_idx = g.roi_idx AND h.frame = least(greatest(g.frame + kd.o, 0), 29) GROUP BY ALL)""")},
    level AS (SELECT roi_idx, quantile_cont(v, 0.9) AS height FROM grid GROUP BY 1)
    SELECT recording_id, p.roi_idx, frame, round(v, 6) AS v FROM peaks p JOIN level l ON l.roi_idx = p.roi_idx WHERE v >= height""")
def derivative_onsets(spark: SparkSession, sf: str) -> DataFrame:
    return episodes.derivative_onsets(adapters.trace_arrays(adapters.day_traces(spark, sf)), 1.5, 0.9).select(*KEY, "frame", _r("v"))


@query("q95_candidate_episodes", f"""WITH {PROMINENCE.replace(GRID, f"""{_FIRST}, {OFFSETS}, {SHIFTED.format(peaks="peaks0")}, {MAXIMA}, {DENSITY.format(peaks="peaks0")},
    grid AS (SELECT recording_id, recording_id AS roi_idx, frame, v FROM density)""")},
    level AS (SELECT recording_id, quantile_cont(peak, 0.1) AS threshold FROM maxima GROUP BY 1)
    SELECT p.recording_id, frame, round(v, 6) AS v, round(threshold, 6) AS threshold FROM prom p JOIN level l ON l.recording_id = p.recording_id WHERE v >= threshold AND prominence >= greatest(0.25, threshold * 0.05)""")
def candidate_episodes(spark: SparkSession, sf: str) -> DataFrame:
    at = peaks.local_maxima(adapters.day_traces(spark, sf))
    density = waves.smoothed_density(at, ["recording_id"], "roi_idx", "frame", adapters.DAYS, 1.5)
    null = inference.circular_shift_null(at, "recording_id", "roi_idx", "frame", adapters.DAYS, 50, sigma=1.5)
    return episodes.candidate_episodes(density, null, "recording_id", 0.9).select("recording_id", "frame", _r("v"), _r("threshold"))


@query("q98_decay_shape", f"""WITH {WINDOWED}, d AS (SELECT recording_id, roi_idx, frame, y, i - pk AS j, count(*) OVER q AS n, CASE WHEN y > 1e-6 THEN ln(y) END AS ly, sum(CASE WHEN y > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY roi_idx, frame ORDER BY i) AS c,
      lead(y) OVER o - 2 * y + lag(y) OVER o AS curve, avg(y) OVER q AS m FROM ws WHERE i >= pk WINDOW q AS (PARTITION BY roi_idx, frame), o AS (PARTITION BY roi_idx, frame ORDER BY i)),
    g AS (SELECT recording_id, roi_idx, frame, any_value(n) AS n, count(ly) AS k, var_pop(ly) AS spread, regr_r2(ly, j) AS r2, regr_r2(ly, c) AS straight, avg(pow(y - m, 3)) / nullif(pow(var_pop(y), 1.5), 0) AS skewness, avg(pow(y - m, 4)) / nullif(pow(var_pop(y), 2), 0) - 3 AS kurtosis,
      max(curve) FILTER (WHERE j = n // 2 AND n // 2 > 1 AND n // 2 < n - 2) AS curvature, regr_slope(ly, c) FILTER (WHERE j < n // 2) AS s1, regr_slope(ly, c) FILTER (WHERE j >= n // 2) AS s2, count(ly) FILTER (WHERE j < n // 2) AS k1, count(ly) FILTER (WHERE j >= n // 2) AS k2
      FROM d WHERE n >= 3 GROUP BY ALL),
    h AS (SELECT *, CASE WHEN k >= 2 THEN CASE WHEN spread > 0 THEN r2 ELSE 0 END END AS fit, CASE WHEN spread > 0 THEN straight ELSE 1 END AS line FROM g)
    SELECT recording_id, roi_idx, frame, round(fit, 6) AS r2, round(CASE WHEN k >= 2 THEN sqrt(greatest(spread * (1 - fit), 0)) END, 6) AS residual_sd, round(skewness, 6) AS skewness, round(kurtosis, 6) AS kurtosis, round(curvature, 6) AS curvature,
      round(CASE WHEN n >= 6 AND k >= 4 AND k1 >= 2 AND k2 >= 2 THEN CASE WHEN s1 < 0 AND s2 < 0 THEN s1 / s2 ELSE 1 END END, 5) AS biphasic, round(CASE WHEN k >= 3 THEN 1 / (1 + sqrt(greatest(spread * (1 - line), 0))) END, 5) AS linearity FROM h""")
def decay_shape(spark: SparkSession, sf: str) -> DataFrame:
    s = adapters.day_traces(spark, sf)
    out = features.decay_shape(peaks.window_samples(s, peaks.valley_windows(s, peaks.local_maxima(s))))
    digits = {"biphasic": 5, "linearity": 5}
    return out.select(*KEY, "frame", *[_r(c, digits.get(c, 6)) for c in out.columns if c not in (*KEY, "frame")])


SMALL = wave_tables.PhasicSettings(pixels=1, pixel_um=2.0, fs=1.0, threshold=0.8, least_voxels=2, extent_um=8.0, least_span=2, separation=2, fit_places=8, repeats=19)


@query("q108_component_rows", f"""WITH RECURSIVE {PHASIC}, n AS (SELECT frame, y, x, (CAST(frame AS BIGINT) * 1048576 + y) * 1048576 + x AS id FROM ok),
    e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id AND abs(a.frame - b.frame) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    reach(id, l) AS (SELECT id, id FROM n UNION SELECT e.b, least(r.l, e.b) FROM reach r JOIN e ON e.a = r.id WHERE r.l < e.b),
    c0 AS (SELECT id, min(l) AS component FROM reach GROUP BY ALL), c1 AS (SELECT n.*, component, count(*) OVER (PARTITION BY component) AS size FROM n JOIN c0 USING (id)), c AS (SELECT * FROM c1 WHERE size >= 2),
    w AS (SELECT component, min(frame) AS start, max(frame) AS "end", count(*) AS n_voxels, (max(x) - min(x) + 1) * 2.0 AS ex, (max(y) - min(y) + 1) * 2.0 AS ey FROM c GROUP BY 1),
    p AS (SELECT component, count(*) AS n_places, max(f) - min(f) AS arrival_span FROM (SELECT component, y, x, min(frame) AS f FROM c GROUP BY ALL) GROUP BY 1),
    fe AS (SELECT a.component, a.frame, a.id AS a, b.id AS b FROM c a JOIN c b ON a.component = b.component AND a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
    fr(component, frame, id, l) AS (SELECT component, frame, a, a FROM fe WHERE a = b UNION SELECT fe.component, fe.frame, fe.b, r.l FROM fr r JOIN fe ON fe.a = r.id WHERE r.l < fe.b),
    fp AS (SELECT component, frame, count(DISTINCT l) AS n FROM (SELECT component, frame, id, min(l) AS l FROM fr GROUP BY ALL) GROUP BY ALL),
    sf AS (SELECT component, avg(CAST(n = 1 AS INT)) AS single_front FROM fp GROUP BY 1),
    inner_ AS (SELECT a FROM fe GROUP BY a HAVING count(*) = 9), front AS (SELECT component, frame, y, x FROM c WHERE id NOT IN (SELECT a FROM inner_)),
    near AS (SELECT a.component, a.frame, a.y, a.x, min(sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) AS d FROM front a JOIN front b ON a.component = b.component AND a.frame = b.frame + 2 GROUP BY ALL),
    byf AS (SELECT component, frame, median(d) AS d FROM near GROUP BY ALL), sp AS (SELECT component, median(d) * 2.0 / 2 AS speed, count(*) AS pairs FROM byf GROUP BY 1)
    SELECT w.component, start, "end", n_voxels, n_places, CAST(arrival_span AS INT) AS arrival_span, ex AS extent_x_um, ey AS extent_y_um, n_places * 4.0 AS area_um2, round(single_front, 6) AS single_front, round(speed, 6) AS speed, coalesce(pairs, 0) AS pairs,
      greatest(ex, ey) >= 8 AND arrival_span >= 2 AS propagating, greatest(ex, ey) >= 8 AND arrival_span >= 2 AND single_front >= 0.5 AS strict_front
    FROM w JOIN p USING (component) JOIN sf USING (component) LEFT JOIN sp ON sp.component = w.component""")
def component_rows(spark: SparkSession, sf: str) -> DataFrame:
    filled = waves.flood_fill(_phasic(spark, sf), ["rec"], SMALL.least_voxels)
    out = wave_tables.component_rows(filled, ["rec"], SMALL)
    return out.select("component", "start", "end", "n_voxels", "n_places", "arrival_span", "extent_x_um", "extent_y_um", "area_um2", _r("single_front"), _r("speed"), "pairs", "propagating", "strict_front")


@query("q109_phasic_analysis")
def phasic_analysis(spark: SparkSession, sf: str) -> DataFrame:
    return wave_workflows.analyse_phasic(_blocks(spark, sf), SMALL, 5.0)["components"]


@query("q110_movie_analysis")
def movie_analysis(spark: SparkSession, sf: str) -> DataFrame:
    s = wave_tables.MovieSettings(pixels=1, fs=1.0, baseline_sigma=5.0, separation=3, prominence=0.0, half_window=4, least_blocks=20, patch=4, repeats=19)
    return wave_workflows.analyse_movies(_blocks(spark, sf), s)["episodes"]


def _dataset(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    s = adapters.day_traces(spark, sf)
    coords = s.select(*KEY).distinct().select(*KEY, (F.col("roi_idx") % 37 * 10.0).alias("x"), (F.col("roi_idx") % 41 * 10.0).alias("y"))
    recordings = coords.select("recording_id").distinct().withColumn("day", (F.col("recording_id") % 3).cast("int"))
    settings = wave_workflows.WaveSettings(fs=1.0, density_sigma=1.0, onset_quantile=0.8, onset_separation=3, onset_sigma=1.0, half_window=4, separation=5, least_participants=5, null_repeats=50, fit_repeats=19, alpha=0.9, movie_pixels=1, movie_repeats=19)
    each = F.explode(F.array(*[F.lit(k).cast("long") for k in range(adapters.RECORDINGS)])).alias("recording_id")
    movies = _blocks(spark, sf).drop("recording_id").select(each, "frame", "by", "bx", "v")  # one movie for all
    return wave_workflows.analyse_wave_dataset(s, coords, recordings, [0, 1], movies, settings)


@query("q111_wave_episodes")
def wave_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf)["episodes"]


@query("q111b_wave_summary")
def wave_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _dataset(spark, sf)["summary"]
