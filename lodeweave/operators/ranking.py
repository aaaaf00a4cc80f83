"""Strategy outcomes: counters, merging and the order in which strategies are tried."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """(strategy_id, wins, zeros, losses, last_win) of outcomes(strategy_id, kind, ts)."""
    return outcomes.groupBy("strategy_id").agg(
        F.count_if(F.col("kind") == "win").alias("wins"),
        F.count_if(F.col("kind") == "zero").alias("zeros"),
        F.count_if(F.col("kind") == "loss").alias("losses"),
        F.max(F.when(F.col("kind") == "win", F.col("ts"))).alias("last_win"),
    )


def merge_counts(*stats: DataFrame) -> DataFrame:
    """Counters added up, the latest win kept; a strategy in one of them only is kept as it is."""
    both = stats[0]
    for s in stats[1:]:
        both = both.unionByName(s)
    return both.groupBy("strategy_id").agg(*(F.sum(c).alias(c) for c in ("wins", "zeros", "losses")), F.max("last_win").alias("last_win"))


def strategy_order(defaults: DataFrame, stats: DataFrame, margin: int = 3) -> DataFrame:
    """(strategy_id, place): by 10 * wins - zeros, later last win, default place, if the leader is ``margin`` wins ahead.

    defaults(strategy_id, idx) is a constant list of strategies; strategies without counters score zero.
    """
    zero = F.lit(0)
    s = defaults.join(stats, "strategy_id", "left").withColumns({"_score": F.coalesce(F.col("wins") * 10 - F.col("zeros"), zero), "_wins": F.coalesce("wins", zero), "_last": F.coalesce(F.col("last_win").cast("timestamp"), F.timestamp_seconds(zero))})
    # the whole list of strategies is one window; its length is that of the constant defaults
    w = Window.orderBy(F.col("_score").desc(), F.col("_last").desc(), "idx")
    by_score = Window.orderBy(F.col("_score").desc(), "idx")
    ranked = s.withColumns({"_new": F.row_number().over(w), "_s": F.row_number().over(by_score)})
    lead = F.max(F.when(F.col("_s") == 1, F.col("_wins"))).over(Window.partitionBy()) - F.coalesce(F.max(F.when(F.col("_s") == 2, F.col("_wins"))).over(Window.partitionBy()), zero)
    out = ranked.withColumn("_lead", lead)
    return out.select("strategy_id", F.when(F.col("_lead") < margin, F.col("idx") + 1).otherwise(F.col("_new")).cast("bigint").alias("place"))
