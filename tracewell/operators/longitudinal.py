"""Cells over days: each anchor cell's history, and what becomes of the anchor's groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def day_matches(matches: DataFrame, anchor_cells: DataFrame, recordings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., day, anchor_roi, day_roi, score, iou, distance, ambiguous): the anchor day's cells match themselves with score 1, other days'
    matches are taken as they are. recordings(keys.., day, is_anchor), matches(keys.., day, anchor_roi, day_roi, ..)."""
    anchor = recordings.filter("is_anchor").select(*keys, "day").join(anchor_cells.select(*keys, "anchor_roi").distinct(), keys)
    own = anchor.select(*keys, "day", "anchor_roi", F.col("anchor_roi").alias("day_roi"), F.lit(1.0).alias("score"), F.lit(1.0).alias("iou"), F.lit(0.0).alias("distance"), F.lit(False).alias("ambiguous"))
    other = matches.join(recordings.filter("is_anchor").select(*keys, "day"), [*keys, "day"], "left_anti")
    return own.unionByName(other.select(*own.columns))


def registration_quality(matched: DataFrame, keys: list[str]) -> DataFrame:
    """Per day: matches, mean score, overlap and distance, and ambiguous ones."""
    return matched.groupBy(*keys, "day").agg(
        F.count(F.lit(1)).alias("n_matches"), F.avg("score").alias("mean_score"), F.avg("iou").alias("mean_iou"), F.avg("distance").alias("mean_distance"), F.count_if("ambiguous").alias("n_ambiguous"))


def cell_history(groups: DataFrame, recordings: DataFrame, matched: DataFrame, active: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each anchor cell of groups(keys.., anchor_group_id, anchor_roi) and day of recordings(keys.., day): its cell of the day,
    whether it is detected, active (active(keys.., day, roi)) and grouped (members(keys.., day, group_id, roi)), the groups' ids joined by
    semicolons, the match's quality, and the first day of each. Days are few, so cells times days is the output's own size."""
    sized = groups.withColumn("anchor_group_size", F.count(F.lit(1)).over(Window.partitionBy(*keys, "anchor_group_id")))
    grid = sized.join(recordings.select(*keys, "day").distinct(), keys)
    found = grid.join(matched, [*keys, "day", "anchor_roi"], "left")
    act = active.select(*keys, "day", F.col("roi").alias("day_roi")).distinct().withColumn("active", F.lit(True))
    grouped = members.groupBy(*keys, "day", F.col("roi").alias("day_roi")).agg(F.array_join(F.array_sort(F.collect_set(F.col("group_id").cast("string"))), ";").alias("daily_group_ids"))
    rows = found.join(act, [*keys, "day", "day_roi"], "left").join(grouped, [*keys, "day", "day_roi"], "left")
    rows = rows.select(
        *keys, "anchor_group_id", "anchor_group_size", "anchor_roi", "day", "day_roi", F.col("day_roi").isNotNull().alias("detected"), F.coalesce("active", F.lit(False)).alias("active"),
        F.col("daily_group_ids").isNotNull().alias("grouped"), F.coalesce("daily_group_ids", F.lit("")).alias("daily_group_ids"), F.col("score").alias("match_score"), F.col("iou").alias("mask_iou"),
        F.col("distance").alias("centroid_distance"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous_match"))
    cell = Window.partitionBy(*keys, "anchor_roi")
    return rows.withColumns({f"first_{c}_day": F.min(F.when(F.col(c), F.col("day"))).over(cell) for c in ("detected", "active", "grouped")})


def group_days(history: DataFrame, members: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each anchor group and day of history: cells detected, active and grouped, and the day's group that shares most of its cells
    (dominant_group_id, n_shared, jaccard; by size of the share, jaccard, id), empty and 0 where none shares any.

    A day's group counts by its cells that match an anchor cell, whichever group that is in.
    """
    counts = history.groupBy(*keys, "anchor_group_id", "anchor_group_size", "day").agg(
        F.count_if("detected").alias("n_detected"), F.count_if("active").alias("n_active"), F.count_if("grouped").alias("n_grouped"))
    mapped = members.select(*keys, "day", "group_id", F.col("roi").alias("day_roi")).distinct().join(matched.select(*keys, "day", "anchor_roi", "day_roi"), [*keys, "day", "day_roi"])
    sizes = mapped.groupBy(*keys, "day", "group_id").agg(F.countDistinct("anchor_roi").alias("n_mapped"))
    anchor = history.select(*keys, "day", "anchor_group_id", "anchor_group_size", "anchor_roi")
    shared = mapped.join(anchor, [*keys, "day", "anchor_roi"]).groupBy(*keys, "day", "anchor_group_id", "anchor_group_size", "group_id").agg(F.countDistinct("anchor_roi").alias("n_shared"))
    scored = shared.join(sizes, [*keys, "day", "group_id"]).withColumn("jaccard", F.col("n_shared") / (F.col("anchor_group_size") + F.col("n_mapped") - F.col("n_shared")))
    best = scored.groupBy(*keys, "day", "anchor_group_id").agg(F.min(F.struct((-F.col("n_shared")).alias("a"), (-F.col("jaccard")).alias("b"), "group_id")).alias("d"))
    out = counts.join(best, [*keys, "day", "anchor_group_id"], "left")
    return out.select(
        *keys, "anchor_group_id", "anchor_group_size", "day", "n_detected", "n_active", "n_grouped", F.coalesce(F.col("d.group_id").cast("string"), F.lit("")).alias("dominant_group_id"),
        F.coalesce(-F.col("d.a"), F.lit(0)).alias("n_shared"), F.coalesce(-F.col("d.b"), F.lit(0.0)).alias("jaccard"))


def load_groups(stats: DataFrame, method: str, keys: list[str]) -> DataFrame:
    """(keys.., group_id, roi) of stats(keys.., method, group_id, neuron_indices): a method without rows has no groups."""
    mine = stats.filter(F.col("method") == F.lit(method))
    return mine.select(*keys, "group_id", F.explode("neuron_indices").alias("roi")).filter("roi is not null").distinct()


def active_neurons(spikes: DataFrame, keys: list[str], neuron: str = "neuron_idx") -> DataFrame:
    return spikes.select(*keys, F.col(neuron).alias("roi")).filter("roi is not null").distinct()


def track(groups: DataFrame, recordings: DataFrame, matches: DataFrame, active: DataFrame, members: DataFrame, keys: list[str], fraction: float | None = 0.3, top_n: int | None = None) -> dict[str, DataFrame]:
    """The longitudinal tables of the anchor's largest groups: matches with their quality, the cells' histories, the groups' days. groups(keys..,
    anchor_group_id, anchor_roi) are the anchor day's; keys without a group give no rows."""
    from tracewell.operators.ranking import top_groups

    sizes = groups.groupBy(*keys, "anchor_group_id").agg(F.count(F.lit(1)).alias("size"))
    chosen = top_groups(sizes, "size", "anchor_group_id", fraction if top_n is None else None, top_n, keys)
    mine = groups.join(chosen.select(*keys, "anchor_group_id"), [*keys, "anchor_group_id"], "left_semi")
    matched = day_matches(matches, groups, recordings, keys)
    history = cell_history(mine, recordings, matched, active, members, keys)
    return {"matches": matched, "registrations": registration_quality(matched, keys), "anchor_groups": chosen, "cell_history": history, "group_days": group_days(history, members, matched, keys)}
