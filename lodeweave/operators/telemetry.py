"""Event-log aggregates: windows, counts, nearest-rank percentiles, means and weighted averages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored


SLOTS = 1 << 21  # of keys delivered twice; at most so many are broadcast


def latest(df: DataFrame, key: str, at: str, tie: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key, the one delivered last; of those, the greatest in the columns of ``tie``.

    Keys delivered twice are found on the key alone.  Only rows in the slots of such keys, whose number is bounded,
    are shuffled with all their columns.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(SLOTS)).cast("int")
    twice = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(slot.alias("_slot")).distinct()
    marked = df.withColumn("_slot", slot)
    once = marked.join(F.broadcast(twice), "_slot", "left_anti").drop("_slot")
    order = Window.partitionBy(key).orderBy(F.col(at).desc(), *(F.col(c).desc() for c in tie))
    last = marked.join(F.broadcast(twice), "_slot", "left_semi").drop("_slot").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return once.unionByName(last)


def since(df: DataFrame, at: str, now: str, days: float) -> DataFrame:
    """Events strictly later than ``days`` before now; there is no upper bound."""
    seconds = int(days * 86_400)
    return df.where(F.col(at) > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {seconds} SECONDS"))


def number_field(json: Column | str, field: str) -> Column:
    """A field of a JSON text if it is a number, not a number written as a string; NULL also for broken JSON."""
    whole = F.try_parse_json(json if isinstance(json, Column) else F.col(json))
    kind = F.schema_of_variant(F.try_variant_get(whole, f"$.{field}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(whole, f"$.{field}", "double"))


def nearest_rank(df: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """(group, percentile): the value at place floor(p * n), clamped, of each group, exactly.

    Counted values are written once in ranges of (group, value), so that a large group is in several of them.  The
    sums of the ranges, a few for each group, tell which one holds the place; only its values are put in order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("_g"), F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    ranges = stored(counts.repartitionByRange("_g", "_v").withColumn("_part", F.spark_partition_id()), "percentile")
    sums = ranges.groupBy("_g", "_part").agg(F.sum("_k").alias("_size"))
    every = Window.partitionBy("_g")
    sums = sums.withColumns({"_n": F.sum("_size").over(every), "_upto": F.sum("_size").over(every.orderBy("_part"))})
    place = F.least(F.col("_n") - 1, F.greatest(F.lit(0), F.floor(F.lit(p) * F.col("_n"))))
    holds = sums.withColumn("_place", place).where((F.col("_upto") > F.col("_place")) & (F.col("_upto") - F.col("_size") <= F.col("_place")))
    inside = ranges.join(holds.select("_g", "_part", (F.col("_place") - F.col("_upto") + F.col("_size")).alias("_at")), ["_g", "_part"])
    upto = F.sum("_k").over(Window.partitionBy("_g", "_part").orderBy("_v"))
    return inside.withColumn("_upto", upto).where("_upto > _at").groupBy(F.col("_g").alias(group)).agg(F.min("_v").alias("percentile"))


def mean(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"))


def ewma(df: DataFrame, group: str, value: str, order: list[str], alpha: float = 0.3) -> DataFrame:
    """(group, ewma) from the oldest value to the newest, started with the oldest.

    The weight of a value falls by (1 - alpha) with each newer one, so only the newest ones whose weights differ
    from zero in double precision are needed; each group is cut to these before its sum is taken.
    """
    depth = 1 if alpha >= 1 else math.ceil(math.log(1e-18) / math.log(1 - alpha))
    have = df.where(F.col(value).isNotNull())
    newest = Window.partitionBy(group).orderBy(*(F.col(c).desc() for c in order))
    ranked = have.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= depth + 1).withColumn("_r", F.col("_r") - 1)
    sizes = have.groupBy(group).agg(F.count("*").alias("_n"))
    weight = F.when(F.col("_r") == F.col("_n") - 1, F.pow(F.lit(1 - alpha), F.col("_r"))).otherwise(F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("_r")))
    return ranked.join(sizes, group).groupBy(group).agg(F.sum(F.col(value) * weight).alias("ewma"))


def truncated(df: DataFrame, ts: str, kind: str, data: str, most: int = 4096) -> Column:
    """The data of an event, or a note that it was cut if the line is over ``most`` bytes."""
    line = F.concat(F.lit('{"ts":"'), F.coalesce(F.col(ts), F.lit("")), F.lit('","type":"'), F.col(kind), F.lit('","data":'), F.coalesce(F.col(data), F.lit("null")), F.lit("}"))
    note = F.concat(F.lit('{"_truncated":true,"_originalType":"'), F.col(kind), F.lit('"}'))
    return F.when(F.octet_length(line) > most, note).otherwise(F.col(data))


def sessions(df: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    return df.groupBy(key, F.session_window(at, gap)).agg(F.count("*").alias("events")).groupBy(key).agg(F.count("*").alias("sessions"), F.max("events").alias("longest"))
