"""The five calls a user makes, over tables of captured pages and fetches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config
from ..functions.text import mean3
from ..operators import extract as ex, ranking, replay, score, serp, triage
from ..sources import events as ev


def clamp(value: int | None, default: int, low: int, high: int) -> int:
    return max(low, min(high, default if value is None else value))


def queries_of(requests: DataFrame) -> DataFrame:
    """requests(query) with trimmed queries and an error for blank ones."""
    q = F.trim("query")
    return requests.withColumn("query", q).withColumn("error", F.when(F.coalesce(F.length(q), F.lit(0)) == 0, "query required"))


def _scored(pages: DataFrame, n: int, config: Config, blocks: DataFrame | None, stats: DataFrame | None) -> DataFrame:
    """The scored hits of each page's best strategy.  Pages are parsed once, and one exchange by page serves all of it."""
    spark = pages.sparkSession
    parsed = serp.hits(serp.raw_blocks(pages), serp.over_fetch(n))
    if stats is not None and config.self_healing:
        # strategies without counters, or unknown to the learned order, keep their place behind the others
        defaults = serp.strategies(spark).select("strategy_id", F.col("strategy_pos").alias("idx"))
        order = ranking.strategy_order(defaults, stats)
        places = defaults.join(order, "strategy_id", "left").select("strategy_id", F.coalesce("place", F.col("idx") + 1000).cast("int").alias("_place"))
        parsed = parsed.join(F.broadcast(places), "strategy_id").withColumn("strategy_pos", F.col("_place")).drop("_place")
    if blocks is None:
        return score.score_hits(score.of_best_strategy(parsed.withColumn("_conf", F.lit(0.5)), "page_id"), config.locale)  # without layout, neutral evidence
    keys = ["page_id", "strategy_id"]
    mean = blocks.groupBy(*keys).agg(mean3(F.col("confidence")).alias("_conf"))
    signals = ("confidence", "in_organic", "overlaps_ad", "overlaps_sidebar", "has_h3", "has_link")
    one = blocks.groupBy(*keys, "block_index").agg(F.max(F.struct(*signals)).alias("_geo"))
    best = score.of_best_strategy(parsed.join(mean, keys, "left").withColumn("_conf", F.coalesce("_conf", F.lit(0.0))), "page_id")
    return score.score_hits(best.join(one, [*keys, "block_index"], "left"), config.locale, "_geo")


def search(pages: DataFrame, limit: int | None = None, config: Config = Config(), blocks: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(page_id, strategy_id, rank, title, url, description, classification, overall, confidence) of the best hits.

    blocks(page_id, strategy_id, block_index, ...): layout evidence as geometry.signals gives it, by strategy; a hit
    without evidence scores as neutral.  stats: counters of strategies, which set the order they are tried in.
    """
    n = clamp(limit, 10, 1, 20)
    return score.first_hits(_scored(pages, n, config, blocks, stats), "page_id", n).select("page_id", "strategy_id", "rank", "title", "url", "description", "classification", "overall", "confidence")


def search_meta(pages: DataFrame, limit: int | None = None, config: Config = Config(), blocks: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """(page_id, strategy_id, results, dropped, dropped_reasons) of each page with hits, counted until enough were kept."""
    n = clamp(limit, 10, 1, 20)
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = F.col("classification").isin(*score.NOT_ORGANIC)
    seen = _scored(pages, n, config, blocks, stats).withColumn("_before", F.coalesce(F.sum(F.when(out, 0).otherwise(1)).over(page), F.lit(0))).where(F.col("_before") < n)
    reasons = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(out, F.struct("pos", "classification")))), lambda x: x["classification"]))  # over_fetch(n) hits at most
    return seen.groupBy("page_id").agg(F.first("strategy_id").alias("strategy_id"), F.count_if(~out).alias("results"), F.count_if(out).alias("dropped"), reasons.alias("dropped_reasons"))


def answer(requests: DataFrame, pages: DataFrame, entries: DataFrame, limit: int | None = None, config: Config = Config(), blocks: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """search as a call: (request_id, query, cache, results, dropped, dropped_reasons, code, message, retry_after_ms).

    requests(request_id, at, query, page_id) and, where several are served, client, each with a limit of its own;
    page_id is the page captured for the query.  A blank query is an error;
    a live entry of the cache answers at once; the rest goes through the rate limit in order of time, and what it
    refuses is an error that says when to come again.  entries as for events.get_entries, under the namespace 'search';
    a cached value is the JSON of results.
    """
    n = clamp(limit, 10, 1, 20)
    asked = queries_of(requests)
    key = ev.cache_key(F.col("query"), F.lit(config.locale), F.lit(str(n)))
    bad = asked.where("error is not null")
    found = ev.get_entries(asked.where("error is null").withColumns({"ns": F.lit("search"), "key": key["key"]}), entries)
    shape = "array<struct<rank: int, title: string, url: string, description: string>>"
    none = lambda t: F.lit(None).cast(t)

    def rows(df: DataFrame, **have) -> DataFrame:
        want = {"cache": "string", "results": shape, "dropped": "bigint", "dropped_reasons": "array<string>", "code": "string", "message": "string", "retry_after_ms": "bigint"}
        return df.select("request_id", "query", *(have.get(k, none(t)).cast(t).alias(k) for k, t in want.items()))

    missed = found.where("not hit")
    client = F.xxhash64("client") if "client" in requests.columns else F.lit(0).cast("bigint")
    admitted = replay.admissions(missed.select(client.alias("key"), F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "request_id"), config.requests_per_minute, 60_000_000)
    judged = missed.join(admitted.select("request_id", "granted", "retry_after_us"), "request_id")
    listed = search(pages, n, config, blocks, stats).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url", "description"))).alias("results"))  # twenty at most
    meta = search_meta(pages, n, config, blocks, stats).select("page_id", "dropped", "dropped_reasons")
    done = judged.where("granted").join(listed, "page_id", "left").join(meta, "page_id", "left")
    return (
        rows(bad, code=F.lit("INTERNAL"), message=F.col("error"))
        .unionByName(rows(found.where("hit"), cache=F.lit("hit"), results=F.from_json("value", shape)))
        .unionByName(rows(judged.where("not granted"), cache=F.lit("miss"), code=F.lit("RATE_LIMITED"), message=F.lit("internal rate limit; retry shortly"), retry_after_ms=F.ceil(F.col("retry_after_us") / 1000)))
        .unionByName(rows(done, cache=F.lit("miss"), results=F.coalesce("results", F.array().cast(shape)), dropped=F.coalesce("dropped", F.lit(0)), dropped_reasons=F.coalesce("dropped_reasons", F.array().cast("array<string>"))))
    )


def search_parallel(pages: DataFrame, limit: int | None = None, config: Config = Config()) -> DataFrame:
    """One row a page with its hits as an array; a page that fails has none and an error."""
    found = search(pages, limit, config)
    rows = found.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("rank", "title", "url", "description"))).alias("results"))  # twenty at most
    out = pages.select("page_id").join(rows, "page_id", "left")
    return out.withColumn("error", F.when(F.col("results").isNull(), "no results"))


def extract(fetches: DataFrame, max_chars: int | None = None, mode: str = "full", pdf_pages: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """The texts of addresses with code, message and wait of those that failed."""
    if mode not in ("full", "abstract", "metadata"):
        raise ValueError("mode is full, abstract or metadata")
    out = ex.extract(fetches, pdf_pages, mode, clamp(max_chars, config.extract_chars, 200, 50_000), allow_private=config.allow_private)
    return out.withColumn("failure", triage.extract_outcome(F.col("content"), F.col("error")))


def search_extract(pages: DataFrame, fetches: DataFrame, limit: int | None = None, max_chars: int | None = None, mode: str = "abstract", config: Config = Config(), pdf_pages: DataFrame | None = None) -> DataFrame:
    """The hits of search with what was extracted from their addresses, one row a hit; a failure is a value of its row."""
    if mode not in ("full", "abstract"):
        raise ValueError("mode is full or abstract")
    hits = search(pages, clamp(limit, 5, 1, 10), config)
    texts = ex.extract(fetches, pdf_pages, mode, clamp(max_chars, 1500 if mode == "abstract" else 8000, 200, 20_000), allow_private=config.allow_private)
    return hits.join(texts.drop("title"), "url", "left")


def health(events: DataFrame, entries: DataFrame, stats: DataFrame, attempts: DataFrame, requests: DataFrame, rebuilds: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: log size and errors, cache by namespace, strategies and their order, escalation, rate limit, pool, settings.

    attempts, requests and rebuilds are the logs of the one process asked about, as for replay.cascade_replay,
    admissions and failure_budget; the state after their last rows counts.
    """
    spark = events.sparkSession
    last = lambda df, *cols: df.agg(*(F.max_by(c, F.struct("at_us", "request_id")).alias(a) for c, a in cols))
    timed = lambda out, log: out.join(log.select("request_id", "at_us"), "request_id")
    e = events.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "tool.error").alias("errors"))
    c = entries.agg(F.count_if(F.col("ns") == "search").alias("cache_search"), F.count_if(F.col("ns") == "extract").alias("cache_extract"))
    order = ranking.strategy_order(serp.strategies(spark).select("strategy_id", F.col("strategy_pos").alias("idx")), stats)
    o = order.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "strategy_id"))), lambda x: x["strategy_id"]), ",").alias("strategy_order"))  # three strategies
    s = stats.agg(F.count("*").alias("strategies"), F.coalesce(F.sum("wins"), F.lit(0)).alias("wins"))
    cascade = last(timed(replay.cascade_replay(attempts), attempts), ("mode", "cascade_mode"), ("failures", "cascade_failures"), ("off", "captchas_off"), ("on", "captchas_on"))
    limiter = last(timed(replay.admissions(requests, config.requests_per_minute, 60_000_000), requests), ("recent", "recent_requests"))
    pool = last(timed(replay.failure_budget(rebuilds), rebuilds), ("failures", "pool_failures"), ("given_up", "pool_fallback"))
    out = e
    for one in (c, o, s, cascade, limiter, pool):
        out = out.crossJoin(one)  # one row each
    return out.withColumns({"requests_per_minute": F.lit(config.requests_per_minute), "telemetry": F.lit(config.telemetry), "self_healing": F.lit(config.self_healing)})
