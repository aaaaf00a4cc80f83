"""Repair of block selectors: candidates from elements, gates, trials and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import mean3

# Attributes that last, best first, with their selector and path.
STABLE = (("data-ved", "[data-ved]", "//*[@data-ved]"), ("jscontroller", "div[jscontroller]", "//div[@jscontroller]"), ("data-hveid", "div[data-hveid]", "//div[@data-hveid]"))


def _has(attribute: str):
    return lambda m: F.map_contains_key(m, attribute)


def synthesize(elements: DataFrame) -> DataFrame:
    """(element_id, place, selector, xpath, source) of elements(element_id, tag, attributes, ancestors)."""
    maps = F.concat(F.array("attributes"), "ancestors")
    found = [
        F.when(F.exists(maps, _has(a)), F.struct(F.lit(k).alias("place"), F.lit(s).alias("selector"), F.lit(x).alias("xpath"), F.lit(a).alias("source")))
        for k, (a, s, x) in enumerate(STABLE)
    ]
    stable = F.filter(F.array(*found), lambda x: x.isNotNull())
    tokens = F.filter(F.split(F.coalesce(F.element_at("attributes", F.lit("class")), F.lit("")), r"\s+"), lambda t: (F.length(t) >= 4) & t.rlike("^[a-zA-Z]"))
    longest = F.get(F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), F.lit(0))["t"]
    fallback = F.array(F.struct(F.lit(9).alias("place"), F.concat("tag", F.lit("."), longest).alias("selector"), F.concat(F.lit("//"), "tag", F.lit('[contains(@class, "'), longest, F.lit('")]')).alias("xpath"), F.lit("class-fallback").alias("source")))
    either = F.when(F.size(stable) > 0, stable).when(longest.isNotNull(), fallback)
    return elements.select("element_id", F.explode(either).alias("c")).select("element_id", "c.*")


def gate_a(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Enough blocks, most of them organic and confident; below five blocks the figures are zero."""
    n = F.count("*")
    ratio, mean = F.avg(F.col("in_organic").cast("double")), mean3(F.col("confidence"))
    zero = F.lit(0.0)
    return blocks.groupBy(key).agg(n.alias("blocks"), F.when(n < 5, zero).otherwise(ratio).alias("organic_ratio"), F.when(n < 5, zero).otherwise(mean).alias("mean_confidence"), ((n >= 5) & (ratio >= 0.6) & (mean >= 0.5)).alias("passed"))


def gate_b(selector: Column, source: Column) -> Column:
    """NULL if the selector passes, else the reason."""
    return (
        F.when(F.coalesce(F.length(selector), F.lit(0)) < 3, "selector too short or empty")
        .when(selector.rlike(r"(?i)#tads|#tadsb|\[data-text-ad\]"), "matches ad selectors")
        .when((source == "class-fallback") & ~selector.rlike(r"\[(data-ved|jscontroller|data-hveid)\]"), "class-only fallback (less stable)")
    )


def gate_c(confidence: Column, decision: Column) -> Column:
    return (confidence != "low") & decision.isin("approve_candidate", "propose_new")


def trials(queries: DataFrame, least: int = 3) -> DataFrame:
    """queries(query_id, results, mean_confidence) with passed and reason."""
    mean = F.coalesce("mean_confidence", F.lit(0.0))
    few = F.concat(F.lit("results count "), F.col("results").cast("string"), F.lit(f" < min {least}"))
    reason = F.when(F.col("results") < least, few).when(mean < 0.5, F.format_string("geometric mean %.2f < 0.5", mean))
    return queries.withColumns({"passed": reason.isNull(), "reason": reason})


def triple_gate(layouts: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """(key, a, b, c, passed): the three gates of each proposal together.

    layouts: what gate_a gives by key; a proposal without a layout fails the first gate.
    proposals(key, selector, source, confidence, decision).
    """
    b, c = gate_b(F.col("selector"), F.col("source")).isNull(), gate_c(F.col("confidence"), F.col("decision"))
    both = proposals.select(key, b.alias("b"), F.coalesce(c, F.lit(False)).alias("c")).join(layouts.select(key, F.col("passed").alias("_a")), key, "left")
    a = F.coalesce("_a", F.lit(False))
    return both.select(key, a.alias("a"), "b", "c", (a & F.col("b") & F.col("c")).alias("passed"))


def verdict(passed: Column, total: Column) -> Column:
    return F.when((passed == total) & (total >= 3), "apply").when(passed >= 2, "caution_flag").otherwise("escalate")


def decision(gates_passed: Column, verdict_: Column) -> Column:
    """STRUCT<open, caution>."""
    go = gates_passed & (verdict_ != "escalate")
    return F.struct(go.alias("open"), (go & (verdict_ == "caution_flag")).alias("caution"))


def offline_choice(first_selector: Column, reason: str = "model not enabled") -> Column:
    """The choice made without a model: the first candidate, or a fixed selector.  reason: why no model was asked."""
    any_ = first_selector.isNotNull()
    return F.struct(
        F.when(any_, "approve_candidate").otherwise("propose_new").alias("decision"),
        F.coalesce(first_selector, F.lit("[data-ved] h3")).alias("selector"),
        F.when(any_, f"[mock] {reason}, defaulting to first candidate").otherwise(f"[mock] {reason}, fallback to data-ved anchor").alias("rationale"),
        F.lit("low").alias("confidence"),
        F.lit(5).alias("expected_min_blocks"),
    )


def offline_choices(pages: DataFrame, selectors: DataFrame) -> DataFrame:
    """The choice for each of pages(page_id) among what synthesize gives with a page_id; the first by element and place."""
    first = selectors.groupBy("page_id").agg(F.min_by("selector", F.struct("element_id", "place")).alias("_first"))
    return pages.join(first, "page_id", "left").select("page_id", offline_choice(F.col("_first")).alias("c")).select("page_id", "c.*")


def report(selector: Column, verdict_: Column, lines: Column) -> Column:
    """Text of a change proposal with one line for each trial."""
    return F.concat_ws("\n", F.concat(F.lit("Selector: "), selector), F.concat(F.lit("Verdict: "), verdict_), F.array_join(lines, "\n"))
