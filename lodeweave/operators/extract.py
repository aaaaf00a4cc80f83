"""Text extraction from fetched pages in tiers of cost; every failure is a value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.dom import main_markdown, main_text, markdown
from ..functions.text import PRIVATE, abstract, citation_pdf, clip, fence, full_text_address, host, is_pdf, page_title, pdf_address, url_guard
from .serp import resolve as _resolve

MAX_BODY = 25 * 1024 * 1024


@F.pandas_udf(StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(main_text, na_action="ignore")


@F.pandas_udf(StringType())
def html_markdown(html: pd.Series) -> pd.Series:
    return html.map(markdown, na_action="ignore")


@F.pandas_udf(StringType())
def absolute(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([_resolve(b, u) for b, u in zip(base, url)])


def excerpt(content: Column) -> Column:
    return clip(content, 200)


def clipped(df: DataFrame, text: Column, most: int = 8000) -> DataFrame:
    """df with content cut to ``most`` characters, its excerpt and length."""
    c = clip(text, most)
    return df.withColumns({"content": c, "excerpt": excerpt(c), "length": F.length(c)})


def resolved_guard(urls: DataFrame, dns: DataFrame) -> DataFrame:
    """urls(url, ...) with reason: the guard on the address, then on what dns(host, address) resolves its host to.

    A host that dns does not know is allowed.  replay.name_lookups gives the addresses with their five minutes of life.
    """
    known = dns.groupBy("host").agg(F.max(F.col("address").rlike(PRIVATE)).alias("_private")).withColumnRenamed("host", "_host")
    joined = urls.withColumn("_host", host("url")).join(known, "_host", "left")
    late = F.when(F.col("_private"), "resolved to private address")
    return joined.withColumn("reason", F.coalesce(url_guard("url"), late)).drop("_host", "_private")


def landed(fetches: DataFrame, max_hops: int = 5, allow_private: bool = False) -> DataFrame:
    """(url, landed, status, content_type, body, error): where each address ended, one row an address.

    fetches(url, hop, status, location, content_type, body) holds every answer, hop 0 first; a location may be
    relative to the address before.  Of several captures of one address, told apart by a column fetch_id if there is
    one, the last is taken; a hop delivered twice counts once.  The chains hold no bodies and max_hops + 2 hops at most.
    """
    own = F.col("fetch_id").cast("bigint") if "fetch_id" in fetches.columns else F.lit(0).cast("bigint")
    rows = fetches.where(F.col("url").isNotNull()).withColumn("_fetch", own)
    hop = F.struct("hop", "location", "status")
    chains = rows.where(F.col("hop") <= max_hops + 1).groupBy("url", "_fetch").agg(F.array_sort(F.collect_set(hop)).alias("hops"))
    chains = chains.groupBy("url").agg(F.max_by(F.struct("_fetch", "hops"), "_fetch").alias("c")).select("url", "c.*")

    def walk(frames):
        for f in frames:
            out = []
            for url, hops in zip(f["url"], f["hops"]):
                at, path = url, []
                for h in hops:
                    if path and path[-1][0] == h["hop"]:
                        continue
                    path.append((int(h["hop"]), at))
                    at = _resolve(at, h["location"]) if h["location"] else None
                out.append([{"hop": k, "at": x} for k, x in path])
            f["path"] = out
            yield f[["url", "_fetch", "path"]]

    paths = chains.mapInPandas(walk, "url string, _fetch bigint, path array<struct<hop: int, at: string>>")
    steps = F.transform("path", lambda p: F.struct(p["hop"].alias("hop"), p["at"].alias("at"), url_guard(p["at"], allow_private).alias("reason")))
    bad = F.get(F.filter(steps, lambda p: p["reason"].isNotNull()), F.lit(0))
    ends = paths.select("url", "_fetch", F.element_at("path", -1)["hop"].alias("hop"), F.element_at("path", -1)["at"].alias("landed"), bad.alias("bad"))
    bodies = rows.select("url", "_fetch", "hop", "status", "content_type", "body").groupBy("url", "_fetch", "hop").agg(F.max_by(F.struct("status", "content_type", F.substring("body", 1, MAX_BODY).alias("body")), "status").alias("r"))
    error = (
        F.when(F.col("bad").isNotNull() & (F.col("bad.hop") > 0), F.concat("bad.reason", F.lit(": "), F.coalesce("bad.at", F.lit(""))))
        .when(F.col("bad").isNotNull(), F.col("bad.reason"))
        .when(F.col("hop") > max_hops, "too many redirects")
        .when(F.col("r.status") >= 400, F.concat(F.lit("http "), F.col("r.status").cast("string")))
    )
    return ends.join(bodies, ["url", "_fetch", "hop"]).select("url", "landed", "r.status", "r.content_type", "r.body", error.alias("error"))


def pdf_tiers(pages: DataFrame, mode: str = "full", most: int = 8000) -> DataFrame:
    """(url, page_count, content, excerpt, length, extraction_quality) of pdf pages(url, page_no, text)."""
    agg = pages.groupBy("url").agg(
        F.count("*").cast("int").alias("page_count"),
        F.min_by("text", "page_no").alias("first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n\n").alias("all"),
    )
    text = {"full": F.col("all"), "abstract": F.col("first"), "metadata": F.lit(None).cast("string")}[mode]
    quality = {"full": "full_text", "abstract": "abstract", "metadata": "metadata_only"}[mode]
    return clipped(agg, text, most).select("url", "page_count", "content", "excerpt", "length", F.lit(quality).alias("extraction_quality"))


@F.pandas_udf(StructType([StructField("markdown", StringType()), StructField("text", StringType())]))
def html_article(html: pd.Series) -> pd.DataFrame:
    """Both forms of a page from one parse of its batch: the article as Markdown, and plain text to fall back on."""
    return pd.DataFrame({"markdown": html.map(main_markdown, na_action="ignore"), "text": html.map(main_text, na_action="ignore")})


def extract(fetches: DataFrame, pdf_pages: DataFrame | None = None, mode: str = "full", most: int = 8000, fenced: bool = False, allow_private: bool = False) -> DataFrame:
    """(url, title, content, is_pdf, page_count, extraction_quality, error, excerpt, length), one row an address.

    Tiers in order of cost: guard, redirects and status; PDF by type or magic; in abstract mode the abstract of the meta
    tags; a PDF named by the citation tag or by rules for the landed address; the PDF of the archive page that an index
    page links to; then, but for metadata mode, the article as Markdown, or plain text.  A row leaves with the first
    tier that settles it.  fetches as for ``landed``: it also holds the candidates' answers under their own addresses,
    and a candidate counts only if it was fetched, is allowed, and is a PDF.  pdf_pages(url, page_no, text) holds the
    text of PDFs read elsewhere.
    """
    spark = fetches.sparkSession
    pages = pdf_pages if pdf_pages is not None else spark.createDataFrame([], "url string, page_no int, text string")
    end = landed(fetches, allow_private=allow_private).withColumns({"_pdf": F.col("error").isNull() & is_pdf("body", "content_type"), "_magic": F.col("error").isNull() & is_pdf("body", F.lit(""))})
    head = end.select("url", "landed", "error", "_pdf", F.when(F.col("error").isNull() & ~F.col("_pdf"), F.decode("body", "UTF-8")).alias("html"))
    none = lambda t: F.lit(None).cast(t)
    # one row of small columns for each page; its candidates' addresses are resolved only where a tag names one
    cite, mine = citation_pdf("html"), page_title("html")
    shown = head.select("url", "landed", "error", "_pdf", "html", mine.alias("title"), F.when(cite.isNotNull(), absolute(F.col("landed"), cite)).alias("cited"), pdf_address("landed").alias("ruled"), full_text_address("html").alias("archive"))
    if mode == "abstract":
        shown = shown.withColumn("_a", abstract("html"))
    else:
        shown = shown.withColumn("_a", F.lit(None).cast("struct<source: string, content: string>"))
    # the citation tag of archive pages, by their own address
    archives = shown.where("cited is not null").select(F.col("url").alias("archive"), F.col("cited").alias("archived"))
    reads = pdf_tiers(pages, mode, most).select(F.col("url").alias("_at"), F.struct("page_count", "content", "extraction_quality").alias("_read"))
    named = reads.join(end.where("_magic").select(F.col("url").alias("_at")), "_at")
    near = lambda df, column, name, found=named: df.join(found.withColumnRenamed("_at", column).withColumnRenamed("_read", name), column, "left")
    out = shown.join(archives, "archive", "left")
    for column, name in (("cited", "_r1"), ("ruled", "_r2"), ("archived", "_r3")):
        out = near(out, column, name)
    out = near(out.withColumn("own", F.when(F.col("_pdf"), F.col("url"))), "own", "_r0", reads)
    meta = F.col("_a").isNotNull()
    read = F.when(F.col("_pdf"), F.col("_r0")).when(~meta & F.col("error").isNull(), F.coalesce("_r1", "_r2", "_r3"))
    out = out.withColumns({"_meta": meta & F.col("error").isNull(), "_read": read})
    open_ = F.col("error").isNull() & ~F.col("_pdf") & ~F.col("_meta") & F.col("_read").isNull()
    settled = out.where(~open_).select(
        "url", "title", F.when(F.col("_meta"), clip("_a.content", most)).otherwise(F.col("_read.content")).alias("content"), F.when(F.col("_pdf") | F.col("_read").isNotNull(), F.lit(True)).alias("is_pdf"), "_read.page_count",
        F.when(F.col("_meta"), "meta_abstract").otherwise(F.col("_read.extraction_quality")).alias("extraction_quality"),
        F.when(F.col("_pdf") & F.col("_read").isNull(), "pdf parse failed: no pages").otherwise(F.col("error")).alias("error"),
    )
    rest = out.where(open_)
    if mode == "metadata":
        last = rest.select("url", none("string").alias("title"), none("string").alias("content"), none("boolean").alias("is_pdf"), none("int").alias("page_count"), none("string").alias("extraction_quality"), none("string").alias("error"))
    else:
        # the costly tier: only rows that nothing settled before reach the Python worker
        article = rest.select("url", "title", html_article("html").alias("_t"))
        text = F.coalesce(F.nullif("_t.markdown", F.lit("")), F.nullif("_t.text", F.lit("")))
        last = article.select("url", "title", clip(text, most).alias("content"), none("boolean").alias("is_pdf"), none("int").alias("page_count"), F.when(text.isNotNull(), "full_text").alias("extraction_quality"), F.when(text.isNull(), "no extractable content").alias("error"))
    both = settled.unionByName(last).withColumns({"excerpt": excerpt(F.col("content")), "length": F.length("content")})
    return both.withColumn("content", fence("content")) if fenced else both
