"""Queries on hierarchies, groups, tests, labels and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import inference, labels, ranking, summary, traces, validation
from tracewell.plans.registry import query
from tracewell.sources import adapters
from tracewell.sources.adapters import table


def _r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


STATS = ("mean", "var_total", "var_within", "var_between")
LEAVES = """leaves AS (SELECT n_regionkey AS region, n_nationkey AS nation, c_custkey AS customer, count(*) AS w, avg(o_totalprice) AS mean, var_pop(o_totalprice) AS var
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def _law(mean: str, var: str, w: str) -> str:
    m, within = f"sum({mean} * {w}) / sum({w})", f"sum({var} * {w}) / sum({w})"
    between = f"greatest(sum({mean} * {mean} * {w}) / sum({w}) - pow({m}, 2), 0)"
    return f"round({m}, 3) AS mean, round({within} + {between}, 0) AS var_total, round({within}, 0) AS var_within, round({between}, 0) AS var_between"


def _coarse(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, _r("mean", 3), *[_r(c, 0) for c in STATS[1:]])


@query("q21_summarize_video", f"""WITH {LEAVES}, b AS (SELECT nation, 'unweighted' AS scheme, mean, var, 1.0 AS w FROM leaves UNION ALL SELECT nation, 'weighted', mean, var, w FROM leaves)
    SELECT nation, 'price' AS stat, scheme, {_law("mean", "var", "w")} FROM b GROUP BY ALL""")
def summarize_video(spark: SparkSession, sf: str) -> DataFrame:
    n = adapters.order_leaves(spark, sf).select("nation", F.lit("price").alias("stat"), F.col("mean").alias("m"), F.col("var").alias("v"), "w")
    return _coarse(summary.summarize_video(n, ["nation"]), "nation", "stat", "scheme")


@query("q22_aggregate_children", f"WITH {LEAVES} SELECT region, nation, {_law('mean', 'var', 'w')}, CAST(sum(w) AS BIGINT) AS w, count(*) AS n_children FROM leaves GROUP BY ALL")
def aggregate_children(spark: SparkSession, sf: str) -> DataFrame:
    return _coarse(summary.aggregate_children(adapters.order_leaves(spark, sf), ["region", "nation"], var="var"), "region", "nation", "w", "n_children")


@query("q23_tree_rollup", f"""WITH {LEAVES},
    l2 AS (SELECT region, nation, sum(mean * w) / sum(w) AS mean, sum(var * w) / sum(w) + greatest(sum(mean * mean * w) / sum(w) - pow(sum(mean * w) / sum(w), 2), 0) AS var, CAST(count(*) AS DOUBLE) AS w FROM leaves GROUP BY ALL),
    l1 AS (SELECT region, sum(mean * w) / sum(w) AS mean, sum(var * w) / sum(w) + greatest(sum(mean * mean * w) / sum(w) - pow(sum(mean * w) / sum(w), 2), 0) AS var, sum(w) AS w FROM l2 GROUP BY ALL)
    SELECT 2 AS depth, 'root/' || region || '/' || nation AS node, {_law("mean", "var", "w")}, count(*) AS n_children FROM leaves GROUP BY region, nation
    UNION ALL SELECT 1, 'root/' || region, {_law("mean", "var", "w")}, count(*) FROM l2 GROUP BY region
    UNION ALL SELECT 0, 'root', {_law("mean", "var", "w")}, count(*) FROM l1""")
def tree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _coarse(summary.tree_rollup(adapters.order_leaves(spark, sf), ["region", "nation", "customer"]), "depth", "node", "n_children")


@query("q24_sibling_rows", f"""WITH {LEAVES}, n AS (SELECT region, nation, {_law('mean', 'var', 'w')} FROM leaves GROUP BY ALL)
    SELECT region, CAST(nation AS VARCHAR) AS child, mean, var_total, count(*) OVER (PARTITION BY region) AS n_siblings FROM n QUALIFY count(*) OVER (PARTITION BY region) >= 2""")
def sibling_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = summary.aggregate_children(adapters.order_leaves(spark, sf), ["region", "nation"], var="var").withColumnRenamed("nation", "child")
    return summary.sibling_rows(n, "region", "child").select("region", "child", _r("mean", 3), _r("var_total", 0), "n_siblings")


@query("q24b_comparison_columns", f"""WITH {LEAVES}, b AS (SELECT nation, 'u' AS s, mean, var, 1.0 AS w FROM leaves UNION ALL SELECT nation, 'w', mean, var, w FROM leaves),
    s AS (SELECT nation, s, {_law("mean", "var", "w")} FROM b GROUP BY ALL)
    SELECT nation, max(mean) FILTER (WHERE s = 'u') AS price_mean_unweighted, max(mean) FILTER (WHERE s = 'w') AS price_mean_weighted,
           max(var_between) FILTER (WHERE s = 'w') AS price_between_weighted FROM s GROUP BY nation""")
def comparison_columns(spark: SparkSession, sf: str) -> DataFrame:
    n = adapters.order_leaves(spark, sf).select("nation", F.lit("price").alias("stat"), F.col("mean").alias("m"), F.col("var").alias("v"), "w")
    wide = summary.comparison_columns(summary.summarize_video(n, ["nation"]), ["nation"], ["price_mean_unweighted", "price_mean_weighted", "price_between_weighted"])
    return wide.select("nation", _r("price_mean_unweighted", 3), _r("price_mean_weighted", 3), _r("price_between_weighted", 0))


@query("q25_grouped_ungrouped", """WITH g AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 400000)
    SELECT c_nationkey AS nation, count(g.o_custkey) AS n_grouped, count(*) - count(g.o_custkey) AS n_ungrouped, round(count(g.o_custkey) / count(*), 6) AS grouped_fraction,
      round(avg(c_acctbal) FILTER (WHERE g.o_custkey IS NOT NULL), 4) AS mean_grouped, round(avg(c_acctbal) FILTER (WHERE g.o_custkey IS NULL), 4) AS mean_ungrouped
    FROM customer LEFT JOIN g ON g.o_custkey = c_custkey GROUP BY ALL""")
def grouped_ungrouped(spark: SparkSession, sf: str) -> DataFrame:
    members = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), "c_acctbal")
    grouped = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("id"))
    out = summary.grouped_ungrouped(members, grouped, "id", "nation", "c_acctbal")
    return out.select("nation", "n_grouped", "n_ungrouped", _r("grouped_fraction", 6), _r("mean_grouped"), _r("mean_ungrouped"))


GROUPS = """sizes AS (SELECT l_suppkey, p_brand, count(DISTINCT l_partkey) AS size, avg(l_extendedprice) AS price FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"""


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_extendedprice").join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return rows.groupBy("l_suppkey", "p_brand").agg(F.countDistinct("l_partkey").alias("size"), F.avg("l_extendedprice").alias("price"))


@query("q26_group_stats_rollup", f"""WITH {GROUPS}, s AS (SELECT l_suppkey, count(*) AS n_groups, avg(size) AS size, avg(price) AS price FROM sizes GROUP BY 1),
    t AS (SELECT l_suppkey % 10 AS node, 'size' AS key, size AS value, n_groups FROM s UNION ALL SELECT l_suppkey % 10, 'price', price, n_groups FROM s)
    SELECT node, key, round(sum(value * n_groups) / sum(n_groups), 4) AS value, CAST(sum(n_groups) AS BIGINT) AS n_groups FROM t GROUP BY ALL""")
def group_stats_rollup(spark: SparkSession, sf: str) -> DataFrame:
    per = _groups(spark, sf).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_groups"), F.avg("size").alias("size"), F.avg("price").alias("price"))
    tall = per.select((F.col("l_suppkey") % 10).alias("node"), "n_groups", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("value")) for k in ("size", "price")])).alias("x"))
    return summary.group_stats_rollup(tall.select("node", "n_groups", "x.key", "x.value"), ["node", "key"]).select("node", "key", _r("value"), "n_groups")


@query("q27_group_summary_rows", """SELECT p_brand AS group_id, count(DISTINCT l_partkey) AS group_size, round(avg(l_quantity), 6) AS mean_rate, round(avg(l_extendedprice), 4) AS mean_amplitude
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def group_summary_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("group_id")), "l_partkey")
    out = summary.group_sizes(rows, "group_id", "l_partkey", {"mean_rate": "l_quantity", "mean_amplitude": "l_extendedprice"})
    return out.select("group_id", "group_size", _r("mean_rate", 6), _r("mean_amplitude"))


@query("q28_recording_metrics", """SELECT c_nationkey AS recording, count(*) AS n_detected, count(*) FILTER (WHERE c_acctbal > 5000) AS n_active, round(count(*) FILTER (WHERE c_acctbal > 5000) / count(*), 6) AS active_fraction,
    round(avg(c_acctbal), 4) AS mean_value, round(median(c_acctbal), 4) AS median_value, round(count(*) FILTER (WHERE c_acctbal = 0) / count(*), 6) AS zero_fraction,
    round(count(*) FILTER (WHERE c_acctbal > 5000) / count(*) * 1000, 4) AS active_per_1000 FROM customer GROUP BY ALL""")
def recording_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").withColumnRenamed("c_nationkey", "recording")
    out = summary.recording_metrics(rows, "recording", "c_acctbal", F.col("c_acctbal") > 5000)
    return out.select("recording", "n_detected", "n_active", _r("active_fraction", 6), _r("mean_value"), _r("median_value"), _r("zero_fraction", 6), _r("active_per_1000"))


@query("q29_day_stratified", """SELECT CAST(year(o_orderdate) AS INT) AS day, o_orderpriority AS treatment, count(*) AS n, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev_samp(o_totalprice), 3) AS o_totalprice_sd
    FROM orders GROUP BY ALL""")
def day_stratified(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").alias("day"), F.col("o_orderpriority").alias("treatment"), "o_totalprice")
    return summary.stratified(rows, ["day", "treatment"], ["o_totalprice"]).select("day", "treatment", "n", _r("o_totalprice_mean"), _r("o_totalprice_sd", 3))


@query("q30_coverage", """SELECT c_mktsegment AS treatment, c_nationkey % 5 AS day, count(DISTINCT c_nationkey) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(c_nationkey AS VARCHAR))), ',') AS items FROM customer GROUP BY ALL""")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("treatment"), (F.col("c_nationkey") % 5).alias("day"), "c_nationkey")
    return summary.coverage(rows, ["treatment", "day"], "c_nationkey")


@query("q31_pivot_day", """SELECT o_orderpriority AS outcome, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS f, round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 4) AS o,
    round(avg(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 4) AS p FROM orders GROUP BY ALL""")
def pivot_day(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("outcome")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.avg("o_totalprice"))
    return wide.select("outcome", F.round("F", 4).alias("f"), F.round("O", 4).alias("o"), F.round("P", 4).alias("p"))


P = "p AS (SELECT c_custkey AS id, c_nationkey AS family, round((c_custkey * 7919 % 10007) / 10007.0, 8) AS p FROM customer WHERE c_custkey <= 1000000000)"


def _p(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("family"), F.round((F.col("c_custkey") * 7919 % 10007) / 10007.0, 8).alias("p"))


@query("q32_bh_monotone", f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS n FROM p)
    SELECT id, family, round(least(min(p * n / r) OVER (PARTITION BY family ORDER BY r DESC), 1), 6) AS q FROM r""")
def bh_monotone(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.benjamini_hochberg(_p(spark, sf), "p", ["family"], ["id"]).select("id", "family", _r("q", 6))


@query("q33_bh_plain", f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r, count(*) OVER (PARTITION BY family) AS n FROM p)
    SELECT id, family, round(least(p * n / r, 1), 6) AS q FROM r""")
def bh_plain(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.benjamini_hochberg(_p(spark, sf), "p", ["family"], ["id"], monotone=False).select("id", "family", _r("q", 6))


@query("q33b_bh_rejected", f"""WITH {P}, r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p) AS r, count(*) OVER (PARTITION BY family) AS n FROM p),
    m AS (SELECT family, max(p) AS m FROM r WHERE p <= r * 0.2 / n GROUP BY 1)
    SELECT id, p.family, coalesce(p <= m, false) AS rejected FROM p LEFT JOIN m ON m.family = p.family""")
def bh_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.bh_rejected(_p(spark, sf), "p", 0.2, ["family"]).select("id", "family", "rejected")


@query("q34_bonferroni", f"WITH {P} SELECT id, family, round(least(p * count(*) OVER (PARTITION BY family), 1), 6) AS q FROM p")
def bonferroni(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.bonferroni(_p(spark, sf), "p", ["family"]).select("id", "family", _r("q", 6))


@query("q35_stars", f"WITH {P} SELECT id, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars, round(-log10(greatest(p, 1e-12)), 6) AS strength FROM p")
def stars(spark: SparkSession, sf: str) -> DataFrame:
    return _p(spark, sf).select("id", ranking.stars(F.col("p")).alias("stars"), F.round(-F.log10(F.greatest("p", F.lit(1e-12))), 6).alias("strength"))


MWU = """x AS (SELECT c_nationkey AS family, o_orderstatus AS arm, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O')),
r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY v) + (count(*) OVER (PARTITION BY family, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY family, v) AS t FROM x)"""


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", F.col("o_orderstatus").alias("arm"), F.col("o_totalprice").alias("v"))
    return orders.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("family")), "o_custkey").select("family", "arm", "v")


@query("q36_mannwhitney_u", f"""WITH {MWU} SELECT family, count(*) FILTER (WHERE arm = 'F') AS n1, count(*) FILTER (WHERE arm = 'O') AS n2,
    round(sum(r) FILTER (WHERE arm = 'F') - count(*) FILTER (WHERE arm = 'F') * (count(*) FILTER (WHERE arm = 'F') + 1) / 2.0, 4) AS u, CAST(sum(t * t - 1) AS BIGINT) AS ties,
    round(median(v) FILTER (WHERE arm = 'F') - median(v) FILTER (WHERE arm = 'O'), 4) AS median_difference FROM r GROUP BY ALL""")
def mannwhitney_u(spark: SparkSession, sf: str) -> DataFrame:
    out = inference.mann_whitney(_arms(spark, sf), ["family"], "v", "arm", "F", "O")
    return out.select("family", "n1", "n2", _r("u"), "ties", _r("median_difference"))


@query("q36b_mannwhitney_p_fdr")
def mannwhitney_p(spark: SparkSession, sf: str) -> DataFrame:
    u = inference.mann_whitney(_arms(spark, sf), ["family"], "v", "arm", "F", "O")
    tested = u.withColumn("p", inference.mann_whitney_p("u", "n1", "n2", F.col("ties").cast("double")))
    return ranking.benjamini_hochberg(tested, "p", order=["family"]).withColumn("stars", ranking.stars(F.col("q"))).select("family", _r("p", 8), _r("q", 8), "stars")


PAIRS = """d AS (SELECT l_suppkey % 20 AS family, l_orderkey, avg(l_extendedprice) FILTER (WHERE l_linenumber = 1) AS a, avg(l_extendedprice) FILTER (WHERE l_linenumber = 2) AS b
    FROM lineitem GROUP BY ALL)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda k: F.avg(F.when(F.col("l_linenumber") == k, F.col("l_extendedprice")))
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("family"), "l_orderkey").agg(at(1).alias("a"), at(2).alias("b"))


@query("q37_paired_t", f"""WITH {PAIRS} SELECT family, count(*) AS n, round(avg(a - b), 3) AS mean_difference,
    round(CASE WHEN count(*) < 3 THEN NULL WHEN max(abs(a - b)) = 0 THEN 0 ELSE avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0) END, 5) AS t
    FROM d WHERE a - b IS NOT NULL GROUP BY ALL""")
def paired_t(spark: SparkSession, sf: str) -> DataFrame:
    return inference.paired_t(_pairs(spark, sf), ["family"], "a", "b").select("family", "n", _r("mean_difference", 3), _r("t", 5))


@query("q37b_wilcoxon", f"""WITH {PAIRS}, e AS (SELECT family, a - b AS d FROM d WHERE a - b <> 0),
    r AS (SELECT *, rank() OVER (PARTITION BY family ORDER BY abs(d)) + (count(*) OVER (PARTITION BY family, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY family, abs(d)) > 1 AS tied FROM e)
    SELECT family, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS w, count(*) AS n, bool_or(tied) AS ties FROM r GROUP BY ALL""")
def wilcoxon(spark: SparkSession, sf: str) -> DataFrame:
    return inference.wilcoxon(_pairs(spark, sf), ["family"], "a", "b")


@query("q38_effect_sizes", """WITH x AS (SELECT c_nationkey AS family, o_orderstatus AS arm, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey),
    a AS (SELECT family, count(*) FILTER (WHERE arm = 'F') AS n1, count(*) FILTER (WHERE arm = 'O') AS n2, avg(v) FILTER (WHERE arm = 'F') AS m1, avg(v) FILTER (WHERE arm = 'O') AS m2,
          var_samp(v) FILTER (WHERE arm = 'F') AS v1, var_samp(v) FILTER (WHERE arm = 'O') AS v2 FROM x GROUP BY 1),
    d AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS s FROM a)
    SELECT family, n1, n2, round((m1 - m2) / s, 6) AS cohen_d, round((m1 - m2) / s * (1 - 3.0 / (4.0 * (n1 + n2) - 9)), 6) AS hedges_g FROM d""")
def effect_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return inference.effect_sizes(_arms(spark, sf), ["family"], "v", "arm", "F", "O").select("family", "n1", "n2", _r("cohen_d", 6), _r("hedges_g", 6))


@query("q38b_kolmogorov_smirnov", """WITH x AS (SELECT c_nationkey AS family, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS one, o_totalprice AS v FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus IN ('F', 'O')),
    d AS (SELECT family, one, abs(sum(one) OVER w / sum(one) OVER p - sum(1 - one) OVER w / sum(1 - one) OVER p) AS d FROM x WINDOW w AS (PARTITION BY family ORDER BY v), p AS (PARTITION BY family))
    SELECT family, CAST(sum(one) AS BIGINT) AS n1, CAST(count(*) - sum(one) AS BIGINT) AS n2, round(max(d), 6) AS d FROM d GROUP BY ALL""")
def kolmogorov(spark: SparkSession, sf: str) -> DataFrame:
    return inference.kolmogorov_smirnov(_arms(spark, sf), ["family"], "v", "arm", "F", "O").select("family", "n1", "n2", _r("d", 6))


@query("q39_outliers", """WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.75) AS b FROM customer GROUP BY 1)
    SELECT c_custkey, c_acctbal < a - 0.4 * (b - a) OR c_acctbal > b + 0.4 * (b - a) AS outlier FROM customer JOIN q USING (c_mktsegment)""")
def outliers(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return inference.outliers(rows, ["c_mktsegment"], "c_acctbal", "iqr", 0.4).select("c_custkey", "outlier")


@query("q39b_outliers_z", """SELECT c_custkey, coalesce(abs(c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0) > 1.5, false) AS outlier FROM customer WINDOW w AS (PARTITION BY c_mktsegment)""")
def outliers_z(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return inference.outliers(rows, ["c_mktsegment"], "c_acctbal", "zscore", 1.5).select("c_custkey", "outlier")


@query("q64_permutation_test")
def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    return inference.permutation_test(_arms(spark, sf).filter("arm in ('F', 'O')"), "family", "v", "arm", "F", 99)


@query("q65_bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return inference.bootstrap_ci(_arms(spark, sf), "family", "v", 100)


LABELS = "l AS (SELECT d.doc_id, d.source, coalesce(CAST(quality AS INT), -1) AS value, CASE WHEN quality IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'auto' ELSE 'manual' END AS label_source FROM documents d LEFT JOIN labels USING (doc_id))"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "labels").select("doc_id", "quality", "toxic")  # noqa: E741
    d = table(spark, sf, "documents").select("doc_id", "source").join(l, "doc_id", "left")
    label = labels.normalized_label(F.col("quality"), F.when(F.col("quality").isNotNull(), F.when(F.col("toxic") == 1, "auto").otherwise("manual")))
    return d.select("doc_id", "source", label.alias("x")).select("doc_id", "source", "x.value", F.col("x.source").alias("label_source"))


@query("q69_label_filters", f"WITH {LABELS} SELECT doc_id, CASE value WHEN 1 THEN 'good' WHEN 0 THEN 'bad' ELSE 'unlabeled' END AS label, doc_id || '-' || value AS key FROM l WHERE value <> -1 AND label_source = 'auto'")
def label_filters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf).filter(labels.matches_mode(F.col("value"), F.col("label_source"), auto=True))
    return rows.select("doc_id", labels.label_text(F.col("value")).alias("label"), labels.spike_key(F.col("doc_id").cast("string"), F.col("value")).alias("key"))


@query("q70_label_summary", f"""WITH {LABELS} SELECT source, count(*) AS total, count(*) FILTER (WHERE value = 1) AS good, count(*) FILTER (WHERE value = 0) AS bad, count(*) FILTER (WHERE value = -1) AS unlabeled,
    count(*) FILTER (WHERE value <> -1 AND label_source = 'manual') AS manual, count(*) FILTER (WHERE value <> -1 AND label_source = 'auto') AS auto FROM l GROUP BY ALL""")
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return labels.label_summary(_labels(spark, sf), ["source"], "value", "label_source")


@query("q70b_label_updates", f"""WITH {LABELS}, u AS (SELECT doc_id, 1 AS new FROM documents WHERE source = 'src1')
    SELECT doc_id, coalesce(new, value) AS value, CASE WHEN new IS NOT NULL THEN 'manual' ELSE label_source END AS source, new IS NOT NULL AND new IS DISTINCT FROM value AS changed FROM l LEFT JOIN u USING (doc_id)""")
def label_updates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labels(spark, sf)
    new = rows.filter("source = 'src1'").select("doc_id", F.lit(1).alias("value"))
    return labels.update_labels(rows.select("doc_id", "value", F.col("label_source").alias("source")), new, "doc_id")


@query("q71_feature_transforms", """SELECT c_custkey, round(ln(1 + abs(c_acctbal)), 6) AS logged, round(sqrt(abs(c_acctbal)), 6) AS rooted, round(c_acctbal * c_acctbal, 3) AS squared FROM customer""")
def feature_transforms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", *[F.col("c_acctbal").alias(k) for k in ("logged", "rooted", "squared")])
    for c, k in (("logged", "log"), ("rooted", "sqrt"), ("squared", "square")):
        rows = traces.transform_features(rows, [c], k)
    return rows.select("c_custkey", _r("logged", 6), _r("rooted", 6), _r("squared", 3))


@query("q72_validation_duplicates", """WITH r AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS rn FROM conversations)
    SELECT 'error' AS severity, 'duplicate_key' AS code, conv_id || '/' || role AS grp, 'row ' || turn || ' repeats a key' AS message FROM r WHERE rn > 1""")
def validation_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return validation.duplicate_keys(table(spark, sf, "conversations"), ["conv_id", "role"], "turn")


@query("q73_low_replicates", """SELECT 'warning' AS severity, 'low_replicates' AS code, CAST(conv_id AS VARCHAR) AS grp, count(DISTINCT turn) || ' replicates' AS message FROM conversations GROUP BY conv_id HAVING count(DISTINCT turn) < 5
    UNION ALL SELECT 'error', 'group_too_small', CAST(conv_id AS VARCHAR), count(*) || ' of at least 4' FROM conversations GROUP BY conv_id HAVING count(*) < 4""")
def low_replicates(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    return validation.report(validation.low_replicates(c, "conv_id", "turn", 5), validation.small_groups(c, ["conv_id"], 4))


@query("q74_metadata_override", """SELECT c_custkey AS id, coalesce(n_name, 'unknown') AS region, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, 'none') AS treatment
    FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0""")
def metadata_override(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    inferred = c.select(F.col("c_custkey").alias("id"), F.lit("unknown").alias("region"), F.lit("none").alias("treatment"))
    n = table(spark, sf, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("region"))
    given = c.join(n, "c_nationkey", "left").select(F.col("c_custkey").alias("id"), "region", F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("treatment"))
    return validation.override_metadata(inferred, given, "id", ["region", "treatment"])


@query("q74b_accounting", """SELECT o_custkey AS recording, count(*) - (count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_orderstatus = 'O')) AS difference FROM orders GROUP BY ALL
    HAVING count(*) <> count(*) FILTER (WHERE o_orderstatus = 'F') + count(*) FILTER (WHERE o_orderstatus = 'O')""")
def accounting(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("recording")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count_if(F.col("o_orderstatus") == "O").alias("o"))
    return validation.accounting(rows, "recording", "n", ["f", "o"])


@query("q75_legend", """WITH c(name) AS (VALUES ('n_videos'), ('amplitude_mean_unweighted'), ('amplitude_between_weighted'), ('n_groups_combined'), ('other'))
    SELECT name, CASE WHEN name LIKE 'n\\_groups\\_%' ESCAPE '\\' THEN 'Number of groups, strategy ' || name[10:] WHEN name = 'n_videos' THEN 'Number of recordings'
      WHEN regexp_matches(name, '_mean_[a-z]+$') THEN 'Mean of ' || regexp_extract(name, '^(.*)_mean_([a-z]+)$', 1) || ', ' || regexp_extract(name, '^(.*)_mean_([a-z]+)$', 2)
      WHEN regexp_matches(name, '_between_[a-z]+$') THEN 'Variance between parts of ' || regexp_extract(name, '^(.*)_between_([a-z]+)$', 1) || ', ' || regexp_extract(name, '^(.*)_between_([a-z]+)$', 2) ELSE '' END AS description FROM c""")
def legend(spark: SparkSession, sf: str) -> DataFrame:
    names = ["n_videos", "amplitude_mean_unweighted", "amplitude_between_weighted", "n_groups_combined", "other"]
    return summary.legend(spark.createDataFrame([(n,) for n in names], "name string"))


@query("q58_anchor_topk", """WITH g AS (SELECT c_nationkey AS grp, c_mktsegment AS day, count(*) AS size FROM customer GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY size DESC, grp) AS rank, count(*) OVER (PARTITION BY day) AS n FROM g)
    SELECT day, grp, size, rank FROM r WHERE rank <= greatest(ceil(n * 0.2), 1)""")
def anchor_topk(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("day")).agg(F.count(F.lit(1)).alias("size"))
    return ranking.top_groups(g, "size", "grp", fraction=0.2, keys=["day"]).select("day", "grp", "size", F.col("rank").cast("long").alias("rank"))


@query("q58b_rank_bins", """SELECT c_custkey, CAST(least(3, floor((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) - 1) * 4 / count(*) OVER (PARTITION BY c_nationkey))) AS INT) AS bin FROM customer""")
def rank_bins(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.rank_bins(table(spark, sf, "customer"), "c_acctbal", "c_custkey", 4, ["c_nationkey"]).select("c_custkey", "bin")
