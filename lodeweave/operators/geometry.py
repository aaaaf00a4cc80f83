"""Layout evidence: block rectangles against advertisements, side columns and the organic region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import mean3, r3

SIGNALS = ("in_organic", "overlaps_ad", "overlaps_sidebar", "hit", "has_h3", "has_link")


def signals(blocks: DataFrame, regions: DataFrame, viewport: int = 1366, left_ratio: float = 0.65, header: int = 100) -> DataFrame:
    """blocks(page_id, block_index, x, y, w, h, has_h3, has_link) with the signals and their confidence.

    regions(page_id, ad_x, ad_y, ad_w, ad_h, side_x): the first advertisement and side column of a page, NULL if none.
    """
    b = blocks.join(regions, "page_id", "left")
    x, y, w, h = (F.col(c) for c in "xywh")
    organic = (x > 30) & (x < left_ratio * viewport) & (y > header)
    ad = (x <= F.col("ad_x") + F.col("ad_w")) & (x + w >= F.col("ad_x")) & (y <= F.col("ad_y") + F.col("ad_h")) & (y + h >= F.col("ad_y"))
    side = F.when(F.col("side_x").isNotNull(), x + w >= F.col("side_x")).otherwise(x > left_ratio * viewport)
    hit = F.col("has_h3") & F.col("has_link")
    out = b.select(*(F.col(c) for c in blocks.columns), organic.alias("in_organic"), F.coalesce(ad, F.lit(False)).alias("overlaps_ad"), side.alias("overlaps_sidebar"), hit.alias("hit"))
    return out.withColumn("confidence", confidence())


def confidence() -> Column:
    add = lambda c, p: F.when(F.col(c), p).otherwise(0.0)
    total = add("in_organic", 0.3) + add("has_h3", 0.2) + add("has_link", 0.2) + add("hit", 0.1) + 0.2 - add("overlaps_ad", 0.6) - add("overlaps_sidebar", 0.4)
    return r3(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def region_stats(blocks: DataFrame, key: str = "page_id", stale_below: float = 0.5) -> DataFrame:
    """Shares of blocks in the organic, advertisement and side regions, mean confidence, and whether that is stale."""
    share = lambda c: r3(F.avg(F.col(c).cast("double")))
    mean = F.coalesce(mean3(F.col("confidence")), F.lit(0.0))
    return blocks.groupBy(key).agg(
        share("in_organic").alias("organic_share"), share("overlaps_ad").alias("ad_share"), share("overlaps_sidebar").alias("side_share"), mean.alias("mean_confidence"), (mean < stale_below).alias("is_stale")
    )
