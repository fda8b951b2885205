"""Reviewer decisions: the latest per gap, ranks of what is active, and calibration of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lowstress.lookups import FALSE_POSITIVE_REASONS, GAP_PRIORITY
from lowstress.operators.ranking import ranked


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """(gap_id, reason, ts) of each gap's last decision; ties by event."""
    return decisions.groupBy("gap_id").agg(F.max_by(F.struct("reason", "ts"), F.struct("ts", "event_id")).alias("m")).select("gap_id", "m.*")


def active_rank(scored: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Adds dismissed and active_rank: the rank among gaps that are not dismissed, null for those that are."""
    out = scored.join(dismissed.select("gap_id", F.lit(True).alias("d")).distinct(), "gap_id", "left").withColumn("dismissed", F.coalesce("d", F.lit(False))).drop("d")
    # active ones come first, so their places are their ranks
    return ranked(out, "active_rank", "dismissed", F.desc("composite"), "ord").withColumn("active_rank", F.when(~F.col("dismissed"), F.col("active_rank").cast("int")))


def by_reason(dismissed: DataFrame) -> DataFrame:
    return dismissed.groupBy("reason").agg(F.count("*").alias("n")).withColumn("false_positive", F.col("reason").isin(*FALSE_POSITIVE_REASONS))


def metric_distribution(dismissed: DataFrame, gaps: DataFrame, metric: str) -> DataFrame:
    """Per reason: n, least, median and largest value of a gap metric (infinite and missing ones left out)."""
    v = F.col(metric)
    both = dismissed.join(gaps.select("gap_id", metric), "gap_id", "left").where(v.isNotNull() & (F.abs(v) != float("inf")))
    return both.groupBy("reason").agg(F.count("*").alias("n"), F.min(v).alias("low"), F.median(v).alias("mid"), F.max(v).alias("high"))


def restored(decisions: DataFrame) -> DataFrame:
    """The dismissals that hold: the latest decision of each gap, without gaps whose latest one restores them (a null reason)."""
    return latest_decisions(decisions).where("reason is not null")


def with_imported(own: DataFrame, imported: DataFrame) -> DataFrame:
    """Decisions of this review, and imported ones of gaps that it says nothing about."""
    return own.unionByName(imported.join(own.select("gap_id"), "gap_id", "left_anti"), allowMissingColumns=True)


def filtered(ranked: DataFrame, name: str) -> DataFrame:
    """The gaps that a filter of the review shows: all, active, dismissed, high, or a gap type (of any state)."""
    rule = {"all": F.lit(True), "active": ~F.col("dismissed"), "dismissed": F.col("dismissed"), "high": ~F.col("dismissed") & (F.col("composite") >= 66)}
    if name not in rule and name not in ("corridor", *GAP_PRIORITY):
        raise ValueError(f"unknown filter: {name}")
    return ranked.where(rule.get(name, F.col("gap_type") == name))


def review_list(ranked: DataFrame) -> DataFrame:
    """Active gaps first, by rank."""
    return ranked.orderBy("dismissed", "rank")


def review_stats(ranked: DataFrame) -> DataFrame:
    """(active, dismissed, high, medium): the last two of active gaps."""
    live, score = ~F.col("dismissed"), F.col("composite")
    return ranked.agg(F.count_if(live).alias("active"), F.count_if("dismissed").alias("dismissed"), F.count_if(live & (score >= 66)).alias("high"), F.count_if(live & (score >= 33) & (score < 66)).alias("medium"))


def reasons_by_count(dismissed: DataFrame) -> DataFrame:
    """Reasons, the most frequent first; an empty or missing one is Unspecified."""
    named = dismissed.withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit("Unspecified")))
    return by_reason(named).orderBy(F.desc("n"), "reason")


def suggestions(dismissed: DataFrame, gaps: DataFrame) -> DataFrame:
    """The advice that dismissals of connected gaps give on the connected ratio, if these have values."""
    out = metric_distribution(dismissed.where(F.col("reason") == "Already connected"), gaps, "separation_ratio")
    return out.select("reason", F.format_string("raise the connected ratio to %.2f", F.col("high") + 0.05).alias("suggestion"))


def advice(dismissed: DataFrame, gaps: DataFrame) -> DataFrame:
    """(reason, n, suggestion): a line of advice for each false-positive reason, with a number where gaps give one."""
    counts = dismissed.where(F.col("reason").isin(*FALSE_POSITIVE_REASONS)).groupBy("reason").agg(F.count("*").alias("n"))
    ratio = metric_distribution(dismissed.where(F.col("reason") == "Already connected"), gaps, "separation_ratio")
    length = "straight_line_m" if "straight_line_m" in gaps.columns else "len_m"
    span = metric_distribution(dismissed.where(F.col("reason") == "Same corridor (fragmentation)"), gaps, length)
    numbers = ratio.select("reason", F.format_string("raise the connected ratio to %.2f", F.col("high") + 0.05).alias("s")).unionByName(
        span.select("reason", F.format_string("raise the edge snap to %.0f m", F.least(F.col("high"), F.lit(30.0))).alias("s"))
    )
    plain = F.when(F.col("reason") == "Data error", "check the source data").when(F.col("reason") == "Parallel facility", "raise the distance between parallel gaps").otherwise("no values of these gaps")
    return counts.join(numbers, "reason", "left").select("reason", "n", F.coalesce("s", plain).alias("suggestion"))
