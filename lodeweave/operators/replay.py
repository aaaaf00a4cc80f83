"""State over keyed event sequences, replayed from a log: admission, cache, escalation, retries.

A replay walks the events of a key in order with a state of fixed size.  Keys are hashed to partitions and sorted
there, and rows stream through: no key's events are ever held together, however many there are.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def fold(df: DataFrame, key: str, order: list[str], schema: str, start: Callable[[], object], step: Callable) -> DataFrame:
    """Rows of ``schema`` from step(state, row values...) -> (state, output tuple or None), walked by key in order."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        now, state = object(), None
        for b in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if row[0] != now:
                    now, state = row[0], start()
                state, made = step(state, *row)
                if made is not None:
                    out.append(made)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    columns = [key, *[c for c in df.columns if c != key]]
    return df.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def admissions(requests: DataFrame, per: int, window_us: int) -> DataFrame:
    """(key, request_id, granted, recent, retry_after_us) for requests(key, at_us, request_id).

    At most ``per`` grants stand in any window.  recent: grants in the window once the request is decided;
    retry_after_us: how long a request that comes then has to wait, 0 below the limit.  Only grants count.
    """

    def step(grants, key, at, request):
        live = [g for g in grants if g > at - window_us]
        granted = len(live) < per
        if granted:
            live.append(at)
        wait = max(0, window_us - (at - live[0])) + 5_000 if len(live) >= per else 0
        return live, (key, request, granted, len(live), wait)

    schema = "key bigint, request_id bigint, granted boolean, recent int, retry_after_us bigint"
    return fold(requests.select("key", "at_us", "request_id"), "key", ["at_us", "request_id"], schema, list, step)


def queued_admissions(requests: DataFrame, per: int, window_us: int, wait_us: int) -> DataFrame:
    """(key, request_id, granted, start_us): as admissions, but a request may wait its turn for up to ``wait_us``."""

    def step(grants, key, at, request):
        live = [g for g in grants if g > at - window_us]
        # later grants lie in the future of this request; its turn comes when the per-th last one runs out
        turn = max(at, live[-1] if live else at)
        if len(live) >= per:
            turn = max(turn, live[-per] + window_us)
        if turn - at <= wait_us:
            return [*live, turn][-per:], (key, request, True, turn)
        return live, (key, request, False, None)

    return fold(requests.select("key", "at_us", "request_id"), "key", ["at_us", "request_id"], "key bigint, request_id bigint, granted boolean, start_us bigint", list, step)


def cache_replay(reads: DataFrame, ttl_us: int | None) -> DataFrame:
    """(key, request_id, hit): a miss stores the entry until ttl_us later; hits do not extend it; a ttl of 0 never hits."""

    def step(until, key, at, request):
        hit = until is not None and ttl_us != 0 and (until < 0 or at <= until)
        if hit:
            return until, (key, request, True)
        return (-1 if ttl_us is None else at + ttl_us), (key, request, False)

    return fold(reads.select("key", "at_us", "request_id"), "key", ["at_us", "request_id"], "key bigint, request_id bigint, hit boolean", lambda: None, step)


def cascade_replay(attempts: DataFrame, first: int = 1, second: int = 2) -> DataFrame:
    """(key, request_id, mode, failures, off, on, step) after each of attempts(key, at_us, request_id, captcha).

    A captcha counts in its mode.  Off turns on at ``first`` of them; on asks for the third tier at ``second``, which
    starts its count again and leaves it on.  A success changes nothing.  off, on: captchas so far in each mode;
    step: what the captcha led to ('on', 'retry', 'tier3', 'fail'), NULL for a success.
    """

    def step(state, key, at, request, captcha):
        mode, n, off, on = state
        made = None
        if captcha:
            n += 1
            off, on = (off + 1, on) if mode == "off" else (off, on + 1)
            if mode == "off":
                made = "fail"
                if n >= first:
                    mode, n, made = "on", 0, "on"
            else:
                made = "retry"
                if n >= second:
                    n, made = 0, "tier3"
        return (mode, n, off, on), (key, request, mode, n, off, on, made)

    schema = "key bigint, request_id bigint, mode string, failures int, off int, on int, step string"
    return fold(attempts.select("key", "at_us", "request_id", "captcha"), "key", ["at_us", "request_id"], schema, lambda: ("off", 0, 0, 0), step)


def name_lookups(lookups: DataFrame, life_us: int = 300_000_000) -> DataFrame:
    """(key, request_id, address, asked) for lookups(key, at_us, request_id, address): a name's address is kept for its life.

    key: the name; address: what the name server would say then, NULL if it fails, which is not kept.
    """

    def step(held, key, at, request, address):
        if held is not None and held[1] > at:
            return held, (key, request, held[0], False)
        return ((address, at + life_us) if address is not None else None), (key, request, address, True)

    schema = "key string, request_id bigint, address string, asked boolean"
    return fold(lookups.select("key", "at_us", "request_id", "address"), "key", ["at_us", "request_id"], schema, lambda: None, step)


def failure_budget(events: DataFrame, most: int = 3) -> DataFrame:
    """(key, request_id, failures, given_up) for rebuilds(key, at_us, request_id, failed): a success starts the count again.

    From ``most`` failures in a row on, nothing is tried any more and the count stays.
    """

    def step(n, key, at, request, failed):
        if n < most:
            n = n + 1 if failed else 0
        return n, (key, request, n, n >= most)

    schema = "key bigint, request_id bigint, failures int, given_up boolean"
    return fold(events.select("key", "at_us", "request_id", "failed"), "key", ["at_us", "request_id"], schema, int, step)


def longest_failure_run(events: DataFrame, key: str, order: list[str], failed: str, limit: int = 3) -> DataFrame:
    """(key, longest, falls_back): the longest run of failures; from ``limit`` on the pool is given up for good."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("_run", F.sum(F.when(~F.col(failed), 1).otherwise(0)).over(w))
    runs = marked.groupBy(key, "_run").agg(F.count_if(F.col(failed)).alias("_n"))
    return runs.groupBy(key).agg(F.max("_n").alias("longest"), (F.max("_n") >= limit).alias("falls_back"))


def newest_entries(entries: DataFrame, namespace: str, at: str, cap: int, tie: str) -> DataFrame:
    """The ``cap`` entries of each namespace written last."""
    w = Window.partitionBy(namespace).orderBy(F.col(at).desc(), F.col(tie).desc())
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def backoff_schedule(spark: SparkSession, initial_ms: int, factor: float, attempts: int) -> DataFrame:
    """(attempt, delay_ms) between the attempts."""
    return spark.range(max(0, attempts - 1)).select(F.col("id").alias("attempt"), (F.lit(initial_ms) * F.pow(F.lit(factor), F.col("id"))).cast("bigint").alias("delay_ms"))
