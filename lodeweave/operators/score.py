"""Scores and classes of search hits, their filters and rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import ad_marked, r3

NOT_ORGANIC = ("sponsored", "knowledge_panel", "related")


def _flag(geometry: Column | None, name: str) -> Column:
    return F.coalesce(geometry[name], F.lit(False)) if geometry is not None else F.lit(False)


def classify(title: Column, description: Column, locale: Column, geometry: Column | None = None) -> Column:
    """STRUCT<classification, ad_likelihood>; the first rule that holds decides.  geometry: STRUCT of block signals or NULL."""
    known = geometry.isNotNull() if geometry is not None else F.lit(False)
    desc = F.coalesce(description, F.lit(""))
    marked = ad_marked(F.coalesce(title, F.lit("")), locale) | ad_marked(desc, locale)
    say = lambda name, p: F.struct(F.lit(name).alias("classification"), F.lit(p).alias("ad_likelihood"))
    return (
        F.when(known & _flag(geometry, "overlaps_ad"), say("sponsored", 0.95))
        .when(marked, say("sponsored", 0.8))
        .when(known & _flag(geometry, "overlaps_sidebar"), say("knowledge_panel", 0.05))
        .when(known & ~_flag(geometry, "has_h3") & (F.length(desc) < 50), say("related", 0.1))
        .when(known & _flag(geometry, "in_organic") & _flag(geometry, "has_h3") & _flag(geometry, "has_link"), say("organic", 0.05))
        .when(~known, say("organic", 0.1))
        .otherwise(say("unknown", 0.3))
    )


def score_hits(hits: DataFrame, locale: Column | str = "en-US", geometry: str | None = None) -> DataFrame:
    """hits(title, url, description, ...) with classification, ad_likelihood, structural, geometric, overall, confidence."""
    loc = F.lit(locale) if isinstance(locale, str) else locale
    geo = F.col(geometry) if geometry else None
    out = hits.withColumn("_class", classify(F.col("title"), F.col("description"), loc, geo))
    structural = (
        F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, 0.3).otherwise(0.0)
        + F.when(F.coalesce(F.col("url"), F.lit("")).startswith("http"), 0.3).otherwise(0.0)
        + F.when(F.coalesce(F.length("description"), F.lit(0)) > 20, 0.4).otherwise(0.0)
    )
    geometric = F.coalesce(geo["confidence"], F.lit(0.5)) if geometry else F.lit(0.5)
    base = geometric * 0.5 + structural * 0.5
    kind = F.col("_class.classification")
    boosted = F.least(F.lit(1.0), base * 1.1) if geometry else base
    organic = F.when(geo.isNotNull(), boosted).otherwise(base) if geometry else base
    overall = F.when(kind == "sponsored", base * 0.2).when(kind == "knowledge_panel", base * 0.6).when(kind == "related", base * 0.5).when(kind == "organic", organic).otherwise(base)
    label = F.when(overall >= 0.8, "high").when(overall >= 0.5, "medium").otherwise("low")
    return out.select(
        *(F.col(c) for c in hits.columns),
        kind.alias("classification"),
        F.col("_class.ad_likelihood").alias("ad_likelihood"),
        r3(structural).alias("structural"),
        r3(geometric).alias("geometric"),
        r3(overall).alias("overall"),
        label.alias("confidence"),
    )


def kept(hits: DataFrame) -> DataFrame:
    return hits.where(~F.col("classification").isin(*NOT_ORGANIC))


def filter_organic(hits: DataFrame, least: float = 0.5) -> DataFrame:
    return hits.where((F.col("classification") == "organic") & (F.col("overall") >= least))


def first_hits(hits: DataFrame, key: str, limit: int, position: str = "pos") -> DataFrame:
    """The first ``limit`` kept hits of each page, in page order, with their rank."""
    w = Window.partitionBy(key).orderBy(position)
    return kept(hits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def drops(hits: DataFrame, key: str, limit: int, position: str = "pos") -> DataFrame:
    """(key, dropped, reasons) counted only until ``limit`` hits were kept; reasons in order of appearance."""
    w = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    out = F.col("classification").isin(*NOT_ORGANIC)
    seen = hits.withColumn("before", F.coalesce(F.sum(F.when(out, 0).otherwise(1)).over(w), F.lit(0))).where((F.col("before") < limit) & out)
    first = seen.groupBy(key, "classification").agg(F.count("*").alias("n"), F.min(position).alias("at"))
    # three reasons at most
    return first.groupBy(key).agg(F.sum("n").alias("dropped"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "classification"))), lambda x: x["classification"]), ",").alias("reasons"))


def rollup(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean overall, mean geometric and share of organic hits, zero where there are none."""
    mean = lambda c: r3(F.coalesce(F.avg(c), F.lit(0.0)))
    return scored.groupBy(*keys).agg(
        mean("overall").alias("mean_overall"), mean("geometric").alias("mean_geometric"), mean((F.col("classification") == "organic").cast("double")).alias("organic_share"), F.count("*").alias("hits")
    )


def best_strategy(candidates: DataFrame, key: str) -> DataFrame:
    """The strategy with the most hits * (1 + confidence) of each page; the first one wins ties.

    candidates(key, strategy_id, strategy_pos, hits, confidence); later ones than the first good one don't count.
    """
    good = (F.col("hits") >= 5) & (F.col("confidence") >= 0.7)
    stop = F.min(F.when(good, F.col("strategy_pos"))).over(Window.partitionBy(key))
    tried = candidates.withColumn("_stop", stop).where(F.col("_stop").isNull() | (F.col("strategy_pos") <= F.col("_stop")))
    value = F.col("hits") * (1 + F.col("confidence"))
    pick = F.max_by(F.struct("strategy_id", "hits", "confidence"), F.struct(value, -F.col("strategy_pos"))).alias("best")
    return tried.groupBy(key).agg(pick).select(key, "best.strategy_id", "best.hits", "best.confidence")


def of_best_strategy(hits: DataFrame, key: str) -> DataFrame:
    """The hits of the strategy best_strategy picks, in one pass over hits(key, strategy_id, strategy_pos, _conf, ...)."""
    n = F.count("*").over(Window.partitionBy(key, "strategy_id"))
    page = Window.partitionBy(key)
    good = (F.col("_hits") >= 5) & (F.col("_conf") >= 0.7)
    value = F.struct(F.col("_hits") * (1 + F.col("_conf")), -F.col("strategy_pos"))
    tried = hits.withColumn("_hits", n).withColumn("_stop", F.min(F.when(good, F.col("strategy_pos"))).over(page))
    tried = tried.withColumn("_value", F.when(F.col("_stop").isNull() | (F.col("strategy_pos") <= F.col("_stop")), value))
    return tried.withColumn("_best", F.max("_value").over(page)).where("_value = _best").drop("_hits", "_stop", "_value", "_best")


def best_attempt(attempts: DataFrame, key: str) -> DataFrame:
    """The attempt with the most hits of each key; the first one wins ties.  attempts(key, attempt, hits)."""
    return attempts.groupBy(key).agg(F.max_by("attempt", F.struct("hits", -F.col("attempt"))).alias("attempt"), F.max("hits").alias("hits"))
