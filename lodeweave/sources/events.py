"""Event logs, cache entries and strategy counters as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.telemetry import truncated

EVENT = "ts string, type string, data variant, _corrupt_record string"


_DAY = r"(\d{4}-\d{2}-\d{2})[^/]*(?:/[^/]*)?$"


def read_events(spark: SparkSession, path: str, since_day: str | None = None) -> DataFrame:
    """(ts, type, data, day) of the valid lines of a log: <day>.jsonl files, or day=<day> folders as write_events makes.

    Broken lines are left out; days before since_day are not read.
    """
    raw = spark.read.schema(EVENT).option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jsonl,txt}").json(path)
    raw = raw.withColumn("day", F.regexp_extract(F.col("_metadata.file_path"), _DAY, 1))
    if since_day:
        raw = raw.where(F.col("day") >= since_day)
    shape = F.schema_of_variant("data")
    return raw.where(F.col("_corrupt_record").isNull() & F.col("ts").isNotNull() & F.col("type").isNotNull() & (shape.startswith("OBJECT") | shape.startswith("ARRAY"))).select("ts", "type", "data", "day")


def event_line(events: DataFrame, most: int = 4096) -> Column:
    """The line of an event(ts, type, data JSON text) in a log; NULL if its data is no JSON."""
    data = F.try_parse_json(truncated(events, "ts", "type", "data", most))
    return F.when(data.isNotNull(), F.to_json(F.struct("ts", "type", data.alias("data"))))


def write_events(events: DataFrame, path: str, most: int = 4096, enabled: bool = True) -> None:
    """Append events(ts, type, data JSON text), one folder a UTC day; data of lines that are too long is cut to a note.

    Events whose data is no JSON are left out; a log that is not enabled writes nothing.
    """
    if enabled:
        lines = events.select(event_line(events, most).alias("value"), F.substring("ts", 1, 10).alias("day"))
        lines.where("value is not null and day is not null").write.mode("append").partitionBy("day").text(path)


def log_size(spark: SparkSession, path: str, enabled: bool = True) -> DataFrame:
    """(files, events): empty files count as files; a log that is not enabled has none of either."""
    if not enabled:
        return spark.range(1).select(F.lit(0).alias("files"), F.lit(0).cast("bigint").alias("events"))
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sum(len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{glob}")) or ()) for glob in ("*.jsonl", "*/*.txt"))
    return read_events(spark, path).agg(F.lit(found).alias("files"), F.count("*").alias("events"))


def read_stats(spark: SparkSession, path: str, known: list[str]) -> DataFrame:
    """(strategy_id, wins, zeros, losses, last_win) of stored counters; other schemas and unknown strategies are left out."""
    shape = "schema int, stats map<string, struct<wins double, zeros double, losses double, lastWinAt string>>"
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("j")).where("j.schema = 1").select(F.explode("j.stats").alias("strategy_id", "s"))
    whole = lambda c: F.greatest(F.lit(0), F.floor(F.coalesce(f"s.{c}", F.lit(0.0))).cast("bigint"))
    good = rows.where(F.col("strategy_id").isin(known) & F.col("s.wins").isNotNull() & F.col("s.zeros").isNotNull())
    return good.select("strategy_id", *(whole(c).alias(c) for c in ("wins", "zeros", "losses")), F.col("s.lastWinAt").alias("last_win"))


def write_stats(stats: DataFrame, path: str) -> None:
    entry = F.struct("wins", "zeros", "losses", F.col("last_win").alias("lastWinAt"))
    doc = stats.agg(F.to_json(F.struct(F.lit(1).alias("schema"), F.map_from_entries(F.collect_list(F.struct("strategy_id", entry))).alias("stats"))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def cache_key(*parts: str | Column) -> Column:
    """STRUCT<key, name>: the key of a cached search and its file name."""
    key = F.concat_ws("|", *parts)
    return F.struct(key.alias("key"), F.substring(F.sha2(key, 256), 1, 16).alias("name"))


def put_entries(entries: DataFrame, new: DataFrame, most: int | None = None) -> DataFrame:
    """Entries (ns, key, value, stored_at, expires_at) with the new ones; the one stored last wins.

    most: how many entries a namespace keeps, those stored last.
    """
    both = entries.unionByName(new)
    out = both.groupBy("ns", "key").agg(F.max_by(F.struct("value", "stored_at", "expires_at"), F.struct("stored_at", "value")).alias("e")).select("ns", "key", "e.*")
    if most is not None:
        newest = Window.partitionBy("ns").orderBy(F.col("stored_at").desc(), F.col("key").desc())
        out = out.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most).drop("_n")
    return out


def get_entries(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """requests(ns, key, at, ...) with hit: an entry with the same key that has not expired."""
    e = entries.select("ns", "key", "value", "expires_at")
    out = requests.join(e, ["ns", "key"], "left")
    alive = F.col("value").isNotNull() & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.col("at")))
    return out.withColumns({"hit": alive, "value": F.when(alive, F.col("value"))}).drop("expires_at")


def drop_entries(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys, ["ns", "key"], "left_anti")


def clear_entries(entries: DataFrame, namespace: str | None = None) -> DataFrame:
    """Entries without those of one namespace, or none at all."""
    return entries.where(F.lit(False)) if namespace is None else entries.where(F.col("ns") != namespace)


def cache_size(entries: DataFrame) -> DataFrame:
    return entries.groupBy("ns").agg(F.count("*").alias("entries"))
