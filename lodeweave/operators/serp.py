"""Captured result pages to rows: blocks, hits, page signals, and candidate elements for repair."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.dom import Node, Selector, parse
from ..functions.text import clean_snippet, host, jtrim

_ADS = '#tads, #tadsb, #bottomads, [aria-label*="Sponsored" i], [data-text-ad], [data-pcu]'
# Parsing strategies, as (id, block selector, selector of advertisement containers).
STRATEGIES = (
    ("data-ved-anchor-v1", "div[data-ved], div[data-snc], div[data-hveid]", _ADS),
    ("class-mjjyud-v1", "div.g, div.MjjYud, div.tF2Cxc", _ADS),
    ("hveid-jscontroller-v1", "div[data-hveid][jscontroller]", _ADS),
)
# Selectors of a snippet, best first, and hosts that are never results.
SNIPPETS = ('[data-sncf="1"]', ".VwiC3b", 'div[style*="-webkit-line-clamp"]')
SKIP_HOSTS = ("www.google.com", "accounts.google.com", "webcache.googleusercontent.com", "translate.google.com")
OWN_HOST = "google.com"


def strategies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *s) for k, s in enumerate(STRATEGIES)], "strategy_pos int, strategy_id string, block_selector string, ad_selector string")


_H3, _LINK = Selector("h3"), Selector("a[href^=http]")
_BLOCKS = [(k, s, Selector(b), Selector(a)) for k, (s, b, a) in enumerate(STRATEGIES)]
_SNIPPET = [Selector(s) for s in SNIPPETS]


def _rows(html: str | None) -> list[tuple]:
    """Raw blocks of one page for every strategy, in document order."""
    root, out = parse(html), []
    for k, name, blocks, ads in _BLOCKS:
        for i, block in enumerate(blocks.all(root)):
            h3, link = _H3.first(block), _LINK.first(block)
            snippet = next((n for n in (s.first(block) for s in _SNIPPET) if n is not None), None)
            out.append((k, name, i, h3.text() if h3 else None, link.attrs["href"] if link else None, snippet.text() if snippet else "", ads.closest(block) is not None))
    return out


def raw_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, strategy_pos, strategy_id, block_index, title, url, description, in_ad) of pages(page_id, html)."""
    schema = "page_id bigint, strategy_pos int, strategy_id string, block_index int, title string, url string, description string, in_ad boolean"
    types = pa.schema([("page_id", pa.int64()), ("strategy_pos", pa.int32()), ("strategy_id", pa.string()), ("block_index", pa.int32()), ("title", pa.string()), ("url", pa.string()), ("description", pa.string()), ("in_ad", pa.bool_())])

    def run(batches):
        for b in batches:
            rows = [(i, *r) for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in _rows(html)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows), types)], schema=types)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def hits(blocks: DataFrame, most: int = 20) -> DataFrame:
    """The parsed hits: complete, outside advertisements, first of their URL, the first ``most`` of page and strategy."""
    good = blocks.where(~F.col("in_ad") & F.col("title").isNotNull() & F.col("url").isNotNull()).withColumn("host", host("url"))
    good = good.where(F.col("host").isNotNull() & ~F.col("host").isin(*SKIP_HOSTS))
    keys = ["page_id", "strategy_id"]
    # one exchange by page serves every window below, and those of search
    good = good.repartition("page_id")
    once = good.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "url").orderBy("block_index"))).where("_n = 1")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("block_index"))
    out = once.withColumn("pos", rank - 1).where(F.col("pos") < most)
    return out.select("page_id", "strategy_pos", "strategy_id", "block_index", "pos", jtrim("title").alias("title"), "url", "host", clean_snippet("description").alias("description"))


def over_fetch(limit: int) -> int:
    """How many hits to parse so that ``limit`` are left after filtering."""
    return max(2 * limit, limit + 5)


def page_signals(pages: DataFrame) -> DataFrame:
    """(page_id, h3_count, link_count, marked_count, class_count, layout) of each page."""
    schema = "page_id bigint, h3_count int, link_count int, marked_count int, class_count int, layout string"
    region = (Selector("#rso"), Selector("#search"))

    def signals(html):
        root = parse(html)
        nodes = list(root.walk())[1:]
        links = sum(1 for n in nodes if n.tag == "a" and n.attrs.get("href", "").startswith("http") and OWN_HOST not in (urlsplit(n.attrs["href"]).hostname or ""))
        classes = {c for n in nodes for c in n.attrs.get("class", "").split()}
        at = region[0].first(root) or region[1].first(root)
        tags = [n.tag for n in list(at.walk())[1:201]] if at else []
        layout = f"{len(tags)}-{','.join(tags[:20])}|{','.join(tags[-20:])}"
        return sum(n.tag == "h3" for n in nodes), links, sum("data-hveid" in n.attrs for n in nodes), len(classes), layout

    def run(batches):
        for b in batches:
            rows = [(i, *signals(h)) for i, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["page_id", "h3_count", "link_count", "marked_count", "class_count", "layout"])

    return pages.select("page_id", "html").mapInArrow(run, schema)


def page_state(signals: DataFrame, parsed: DataFrame, stale_h3: int = 5) -> DataFrame:
    """(page_id, h3_count, hits, is_stale, error): many headings but no hit under any strategy.

    signals may hold wait_error, what went wrong while the page was awaited; on a page without hits it goes before stale.
    """
    n = parsed.groupBy("page_id").agg(F.count("*").alias("hits"))
    out = signals.join(n, "page_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    none = F.col("hits") == 0
    wait = F.col("wait_error") if "wait_error" in signals.columns else F.lit(None).cast("string")
    error = F.when(none & wait.isNotNull(), F.concat(F.lit("search wait failed and no results: "), F.substring(wait, 1, 120))).when(
        none & (F.col("h3_count") >= stale_h3), F.concat(F.lit("parser stale: "), F.col("h3_count").cast("string"), F.lit(" h3 elements but 0 results extracted by any strategy"))
    )
    return out.select("page_id", "h3_count", "hits", ((F.col("h3_count") >= stale_h3) & none).alias("is_stale"), error.alias("error"))


def parse_compat(pages: DataFrame, most: int) -> DataFrame:
    """(page_id, h3_count, pos, title, url, description): the hits of the class strategy alone; pages without hits have none."""
    found = hits(raw_blocks(pages).where(F.col("strategy_id") == STRATEGIES[1][0]), most)
    heads = page_signals(pages).select("page_id", "h3_count")
    return found.join(heads, "page_id").select("page_id", "h3_count", "pos", "title", "url", "description")


def repair_html(pages: DataFrame, most: int = 100_000) -> DataFrame:
    """pages with the HTML cut to what a repair looks at."""
    return pages.withColumn("html", F.substring("html", 1, most))


def candidates(pages: DataFrame, most: int = 5) -> DataFrame:
    """(page_id, element_id, tag, attributes, ancestors, preview, has_h3, has_link) above the first headings."""
    schema = "page_id bigint, element_id int, tag string, attributes map<string,string>, ancestors array<map<string,string>>, preview string, has_h3 boolean, has_link boolean"

    def of(html):
        for k, h3 in enumerate(_H3.all(parse(html))[:most]):
            at: Node = h3
            for _ in range(5):
                if at.parent is None or at.parent.tag == "#root":
                    break
                at = at.parent
                if _LINK.first(at) is not None:
                    break
            above = [a.attrs for a in list(at.ancestors())[:3] if a.tag != "#root"]
            yield k, at.tag, at.attrs, above, " ".join(at.text().split())[:200], True, _LINK.first(at) is not None

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(i, *c) for i, h in zip(f["page_id"], f["html"]) for c in of(h)]
            if rows:
                yield pd.DataFrame(rows, columns=["page_id", "element_id", "tag", "attributes", "ancestors", "preview", "has_h3", "has_link"])

    return pages.select("page_id", "html").mapInPandas(run, schema)


def resolve(base: str | None, url: str | None) -> str | None:
    if not url:
        return None
    try:
        got = urljoin(base or "", url)
    except ValueError:
        return None
    return got if urlsplit(got).scheme else None
