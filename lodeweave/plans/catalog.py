"""Every registered query of the library and, where SQL can say it, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..config import Config
from ..functions import text as T
from ..functions.text import r3
from ..operators import extract as ex, geometry, ranking, repair, replay, score, serp, telemetry, triage
from ..sources import events as ev
from ..storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits_of(spark, d) -> DataFrame:
    return telemetry.latest(table(spark, d, "search_hit"), "hit_id", "loaded_at", ("captured_at", "pos"))


def extracts_of(spark, d) -> DataFrame:
    return telemetry.latest(table(spark, d, "extract_result"), "extract_id", "loaded_at", ("fetched_at", "hit_id"))


def log_of(spark, d) -> DataFrame:
    return telemetry.latest(table(spark, d, "telemetry_event"), "event_id", "logged_at", ("ts",))


HITS = "hits AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY hit_id ORDER BY loaded_at DESC, captured_at DESC, pos DESC) n FROM search_hit) WHERE n = 1)"
EXTRACTS = "ext AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY extract_id ORDER BY loaded_at DESC, fetched_at DESC, hit_id DESC) n FROM extract_result) WHERE n = 1)"
LOG = "log AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY logged_at DESC, ts DESC) n FROM telemetry_event) WHERE n = 1)"
SQL_HOST = "nullif(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '')"
_EN = r"(?i)(^|[^A-Za-z0-9_])(sponsored|advertisement)($|[^A-Za-z0-9_])|(^|\s)ads?(\s*[·•‧▾\-—]|\s*$)"
_MARK = f"(regexp_matches(coalesce(title, ''), '{_EN}') OR regexp_matches(coalesce(description, ''), '{_EN}'))"
SCORED = f"""{HITS}, scored AS (SELECT *, CASE WHEN overall >= 0.8 THEN 'high' WHEN overall >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM (
SELECT *, CASE WHEN classification = 'sponsored' THEN (0.25 + s * 0.5) * 0.2 ELSE 0.25 + s * 0.5 END AS overall FROM (
SELECT *, CASE WHEN {_MARK} THEN 'sponsored' ELSE 'organic' END AS classification, CASE WHEN {_MARK} THEN 0.8 ELSE 0.1 END AS ad_likelihood,
(CASE WHEN length(coalesce(title, '')) > 0 THEN 0.3 ELSE 0.0 END)::DOUBLE + (CASE WHEN starts_with(coalesce(url, ''), 'http') THEN 0.3 ELSE 0.0 END)::DOUBLE + (CASE WHEN length(coalesce(description, '')) > 20 THEN 0.4 ELSE 0.0 END)::DOUBLE AS s FROM hits)))"""
R3 = lambda x: f"floor(({x}) * 1000 + 0.5) / 1000"


# ---- hits --------------------------------------------------------------------------------------------------


@query(f"WITH {HITS} SELECT hit_id, {SQL_HOST} AS host FROM hits")
def hit_host(spark, d):
    return hits_of(spark, d).select("hit_id", T.host("url").alias("host"))


@query(f"WITH {SCORED} SELECT hit_id, classification, ad_likelihood::DOUBLE AS ad_likelihood, {R3('s')} AS structural, 0.5::DOUBLE AS geometric, {R3('overall')} AS overall, confidence FROM scored")
def hit_score(spark, d):
    return score.score_hits(hits_of(spark, d)).select("hit_id", "classification", "ad_likelihood", "structural", "geometric", "overall", "confidence")


@query(f"WITH {SCORED}, r AS (SELECT page_id, hit_id, title, {R3('overall')} AS overall, row_number() OVER (PARTITION BY page_id ORDER BY pos, hit_id) AS rank FROM scored WHERE classification = 'organic') SELECT page_id, rank::INT AS rank, hit_id, title, overall FROM r WHERE rank <= 5")
def hit_filter_topk(spark, d):
    """The first five hits of each page after scoring and filtering."""
    at = F.struct("pos", "hit_id")
    kept = score.first_hits(score.score_hits(hits_of(spark, d)).withColumn("at", at), "page_id", 5, "at")
    return kept.select("page_id", "rank", "hit_id", "title", "overall")


@query(f"WITH {SCORED} SELECT hit_id, {R3('overall')} AS overall FROM scored WHERE classification = 'organic' AND {R3('overall')} >= 0.7")
def hit_organic(spark, d):
    return score.filter_organic(score.score_hits(hits_of(spark, d)), 0.7).select("hit_id", "overall")


@query(
    f"""WITH {HITS}, m AS (SELECT *, ((coalesce(title, '') || ' ' || coalesce(description, '')) LIKE '%limit%') AS bad FROM hits),
b AS (SELECT *, coalesce(sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos, hit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT page_id, count(*)::BIGINT AS dropped, 'sponsored' AS reasons FROM b WHERE bad AND before < 5 GROUP BY page_id"""
)
def hit_drops(spark, d):
    """Dropped hits and reasons until five were kept; hits that speak of a limit stand for advertisements."""
    bad = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit(""))).contains("limit")
    marked = hits_of(spark, d).select("page_id", F.struct("pos", "hit_id").alias("at"), F.when(bad, "sponsored").otherwise("organic").alias("classification"))
    return score.drops(marked, "page_id", 5, "at")


@query(
    f"WITH {SCORED} SELECT strategy_id, {R3('avg(' + R3('overall') + ')')} AS mean_overall, {R3('avg(0.5::DOUBLE)')} AS mean_geometric, {R3(chr(97) + 'vg((classification = ' + chr(39) + 'organic' + chr(39) + ')::INT)')} AS organic_share, count(*)::BIGINT AS hits FROM scored GROUP BY strategy_id"
)
def score_rollup(spark, d):
    return score.rollup(score.score_hits(hits_of(spark, d)), "strategy_id")


@query(
    f"""WITH {HITS}, c AS (SELECT (page_id / 7)::INT AS query_id, page_id, any_value(strategy_id) AS sid, count(*) AS n, (page_id % 10) / 10.0 AS conf FROM (SELECT * REPLACE (page_id - page_id % 7 + page_id % 7 AS page_id) FROM hits) GROUP BY page_id),
k AS (SELECT (page_id - page_id % 7) / 7 AS q, page_id % 7 AS p, n, conf, sid FROM c),
g AS (SELECT q, min(p) AS stop FROM k WHERE n >= 5 AND conf >= 0.7 GROUP BY q),
t AS (SELECT k.*, row_number() OVER (PARTITION BY k.q ORDER BY n * (1 + conf) DESC, p) AS r FROM k LEFT JOIN g ON k.q = g.q WHERE g.stop IS NULL OR k.p <= g.stop)
SELECT q::BIGINT AS query_id, ('s' || (p::INT)::VARCHAR) AS strategy_id, n::BIGINT AS hits, conf::DOUBLE AS confidence FROM t WHERE r = 1"""
)
def best_strategy(spark, d):
    """Seven pages stand for the tries of one query; confidence is arithmetic on the page's id (synthetic)."""
    per = hits_of(spark, d).groupBy("page_id").agg(F.count("*").alias("hits"))
    tries = per.select(
        ((F.col("page_id") - F.col("page_id") % 7) / 7).cast("bigint").alias("query_id"),
        (F.col("page_id") % 7).alias("strategy_pos"),
        F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string")).alias("strategy_id"),
        "hits",
        ((F.col("page_id") % 10) / 10).alias("confidence"),
    )
    return score.best_strategy(tries, "query_id")


@query(
    f"""WITH {HITS} SELECT hit_id, CASE lang WHEN 0 THEN regexp_matches(t, '{_EN}') WHEN 1 THEN regexp_matches(t, '광고|스폰서') WHEN 2 THEN regexp_matches(t, '広告|スポンサー') WHEN 3 THEN regexp_matches(t, '(?i)sponsorisé|annonce')
WHEN 4 THEN regexp_matches(t, '(?i)anzeige|gesponsert') WHEN 5 THEN regexp_matches(t, '(?i)anuncio|patrocinado') WHEN 6 THEN regexp_matches(t, '广告|赞助|廣告') ELSE regexp_matches(t, '(?i)patrocinado|anúncio') END AS marked
FROM (SELECT hit_id, hit_id % 8 AS lang, coalesce(title, '') || (CASE hit_id % 5 WHEN 0 THEN ' · Sponsored' WHEN 1 THEN ' ANNONCE' WHEN 2 THEN ' 광고' WHEN 3 THEN ' ads' ELSE '' END) AS t FROM hits)"""
)
def ad_markers(spark, d):
    """Advertisement markers of eight languages on titles with endings by id (synthetic)."""
    langs = F.array(*map(F.lit, ("en-US", "ko-KR", "ja-JP", "fr-FR", "de-DE", "es-ES", "zh-CN", "pt-BR")))
    ends = F.array(*map(F.lit, (" · Sponsored", " ANNONCE", " 광고", " ads", "")))
    t = F.concat(F.coalesce("title", F.lit("")), F.get(ends, (F.col("hit_id") % 5).cast("int")))
    return hits_of(spark, d).select("hit_id", T.ad_marked(t, F.get(langs, (F.col("hit_id") % 8).cast("int"))).alias("marked"))


@query(f"WITH {HITS} SELECT page_id, url, min(pos) AS pos, count(*)::BIGINT AS times FROM hits WHERE url IS NOT NULL GROUP BY page_id, url")
def first_seen_url(spark, d):
    return hits_of(spark, d).where("url is not null").groupBy("page_id", "url").agg(F.min("pos").alias("pos"), F.count("*").alias("times"))


_TRIM = r"[\s\x{00a0}\x{feff}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"WITH {HITS} SELECT hit_id, substr(regexp_replace(regexp_replace(description, '^{_TRIM}|{_TRIM}$', '', 'g'), '(?i)\\s*(\\.{{3}}|…)?\\s*(Read more|More results|더보기)\\s*$', ''), 1, 600) AS snippet FROM hits")
def hit_snippet(spark, d):
    return hits_of(spark, d).select("hit_id", T.clean_snippet("description").alias("snippet"))


# ---- geometry (synthetic rectangles from ids) ---------------------------------------------------------------

_RECT = "SELECT page_id, hit_id AS block_index, ((hit_id * 37) % 1200)::DOUBLE AS x, ((hit_id * 53) % 1500)::DOUBLE AS y, 500.0::DOUBLE AS w, 100.0::DOUBLE AS h, hit_id % 7 <> 0 AS has_h3, hit_id % 5 <> 0 AS has_link FROM hits"
_REGION = "SELECT DISTINCT page_id, 700.0::DOUBLE AS ad_x, ((page_id * 91) % 900)::DOUBLE AS ad_y, 300.0::DOUBLE AS ad_w, 200.0::DOUBLE AS ad_h, CASE WHEN page_id % 3 = 0 THEN 900.0::DOUBLE END AS side_x FROM hits"
_GEO = f"""{HITS}, rect AS ({_RECT}), region AS ({_REGION}), sig AS (SELECT rect.*, (x > 30 AND x < 0.65 * 1366 AND y > 100) AS in_organic,
(x <= ad_x + ad_w AND x + w >= ad_x AND y <= ad_y + ad_h AND y + h >= ad_y) AS overlaps_ad, CASE WHEN side_x IS NOT NULL THEN x + w >= side_x ELSE x > 0.65 * 1366 END AS overlaps_sidebar FROM rect JOIN region USING (page_id)),
geo AS (SELECT *, floor(greatest(0, least(1, (CASE WHEN in_organic THEN 0.3 ELSE 0 END)::DOUBLE + (CASE WHEN has_h3 THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN has_link THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN has_h3 AND has_link THEN 0.1 ELSE 0 END)::DOUBLE + 0.2::DOUBLE
- (CASE WHEN overlaps_ad THEN 0.6 ELSE 0 END)::DOUBLE - (CASE WHEN overlaps_sidebar THEN 0.4 ELSE 0 END)::DOUBLE)) * 1000 + 0.5) / 1000 AS confidence FROM sig)"""


def blocks_of(spark, d) -> DataFrame:
    h = hits_of(spark, d)
    num = lambda e: F.expr(f"cast({e} as double)")
    rect = h.select("page_id", F.col("hit_id").alias("block_index"), num("(hit_id * 37) % 1200").alias("x"), num("(hit_id * 53) % 1500").alias("y"), F.lit(500.0).alias("w"), F.lit(100.0).alias("h"), (F.col("hit_id") % 7 != 0).alias("has_h3"), (F.col("hit_id") % 5 != 0).alias("has_link"))
    region = h.select("page_id").distinct().select("page_id", F.lit(700.0).alias("ad_x"), num("(page_id * 91) % 900").alias("ad_y"), F.lit(300.0).alias("ad_w"), F.lit(200.0).alias("ad_h"), F.when(F.col("page_id") % 3 == 0, 900.0).alias("side_x"))
    return geometry.signals(rect, region)


@query(f"WITH {_GEO} SELECT page_id, block_index, in_organic, overlaps_ad, overlaps_sidebar, confidence FROM geo")
def geometry_confidence(spark, d):
    return blocks_of(spark, d).select("page_id", "block_index", "in_organic", "overlaps_ad", "overlaps_sidebar", "confidence")


@query(f"WITH {_GEO} SELECT page_id, {R3('avg(in_organic::INT)')} AS organic_share, {R3('avg(overlaps_ad::INT)')} AS ad_share, {R3('avg(overlaps_sidebar::INT)')} AS side_share, floor(sum(round(confidence * 1000)) / count(*) + 0.5) / 1000 AS mean_confidence, floor(sum(round(confidence * 1000)) / count(*) + 0.5) / 1000 < 0.5 AS is_stale FROM geo GROUP BY page_id")
def region_stats(spark, d):
    return geometry.region_stats(blocks_of(spark, d))


@query(
    f"""WITH {_GEO} SELECT page_id, n AS blocks, {R3('CASE WHEN n < 5 THEN 0 ELSE o END')} AS organic_ratio, {R3('CASE WHEN n < 5 THEN 0 ELSE m END')} AS mean_confidence, (n >= 5 AND o >= 0.6 AND m >= 0.5) AS passed
FROM (SELECT page_id, count(*)::BIGINT AS n, avg(in_organic::INT) AS o, floor(sum(round(confidence * 1000)) / count(*) + 0.5) / 1000 AS m FROM geo GROUP BY page_id)"""
)
def repair_gate_a(spark, d):
    g = repair.gate_a(blocks_of(spark, d))
    return g.select("page_id", "blocks", r3(F.col("organic_ratio")).alias("organic_ratio"), r3(F.col("mean_confidence")).alias("mean_confidence"), "passed")


_PAGE_MEAN = "floor(sum(round(confidence * 1000)) / count(*) + 0.5) / 1000"
_TRIALS = f"q AS (SELECT page_id, count(*) AS results, avg(in_organic::INT) AS o, {_PAGE_MEAN} AS m FROM geo GROUP BY page_id), t AS (SELECT *, page_id % 50 AS selector_id, CASE WHEN results < 3 THEN 'results count ' || results || ' < min 3' WHEN m < 0.5 THEN 'geometric mean ' || printf('%.2f', floor(m * 100 + 0.5) / 100) || ' < 0.5' END AS reason FROM q)"


def trials_of(spark, d) -> DataFrame:
    return repair.trials(blocks_of(spark, d).groupBy("page_id").agg(F.count("*").alias("results"), T.mean3(F.col("confidence")).alias("mean_confidence")))


@query(f"WITH {_GEO}, {_TRIALS} SELECT page_id, results::BIGINT AS results, m AS mean_confidence, reason IS NULL AS passed, reason FROM t")
def repair_trials(spark, d):
    return trials_of(spark, d).select("page_id", "results", "mean_confidence", "passed", "reason")


@query(
    f"""WITH {_GEO}, {_TRIALS}, v AS (SELECT selector_id, count(*) FILTER (reason IS NULL) AS ok, count(*) AS total FROM t GROUP BY selector_id), w AS (SELECT *, CASE WHEN ok = total AND total >= 3 THEN 'apply' WHEN ok >= 2 THEN 'caution_flag' ELSE 'escalate' END AS verdict FROM v),
g AS (SELECT w.*, coalesce(results >= 5 AND o >= 0.6 AND m >= 0.5, false) AS a, selector_id % 5 <> 2 AS b, selector_id % 3 <> 0 AS c FROM w LEFT JOIN q ON q.page_id = w.selector_id)
SELECT selector_id::BIGINT AS selector_id, ok::BIGINT AS passed, total::BIGINT AS total, verdict, a AS gate_a, b AS gate_b, c AS gate_c, (a AND b AND c AND verdict <> 'escalate') AS opens, (a AND b AND c AND verdict = 'caution_flag') AS caution FROM g"""
)
def repair_verdict(spark, d):
    """Trials of pages grouped by id, the three gates of a proposal each (its selector and confidence synthetic), and the decision."""
    t = trials_of(spark, d).groupBy((F.col("page_id") % 50).alias("selector_id")).agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    v = t.withColumn("verdict", repair.verdict(F.col("passed"), F.col("total")))
    i = F.col("selector_id")
    proposals = v.select("selector_id", F.when(i % 5 == 2, "#tads div").otherwise("[data-ved]").alias("selector"), F.lit("data-ved").alias("source"), F.when(i % 3 == 0, "low").otherwise("high").alias("confidence"), F.lit("approve_candidate").alias("decision"))
    layouts = repair.gate_a(blocks_of(spark, d)).withColumnRenamed("page_id", "selector_id")
    gates = repair.triple_gate(layouts, proposals, "selector_id").withColumnRenamed("passed", "gates")
    x = v.join(gates, "selector_id").withColumn("_d", repair.decision(F.col("gates"), F.col("verdict")))
    return x.select("selector_id", "passed", "total", "verdict", F.col("a").alias("gate_a"), F.col("b").alias("gate_b"), F.col("c").alias("gate_c"), F.col("_d.open").alias("opens"), F.col("_d.caution").alias("caution"))


@query(
    f"""WITH {HITS}, c AS (SELECT hit_id, CASE hit_id % 5 WHEN 0 THEN '[data-ved]' WHEN 1 THEN 'div.g' WHEN 2 THEN '#tads div' WHEN 3 THEN '' ELSE 'div[jscontroller]' END AS selector, CASE WHEN hit_id % 5 = 1 THEN 'class-fallback' ELSE 'data-ved' END AS source FROM hits)
SELECT hit_id, selector, CASE WHEN length(selector) < 3 THEN 'selector too short or empty' WHEN selector LIKE '%#tads%' THEN 'matches ad selectors' WHEN source = 'class-fallback' THEN 'class-only fallback (less stable)' END AS reason,
(hit_id % 3 <> 0 AND hit_id % 2 = 0) AS choice_passes FROM c"""
)
def repair_gate_b(spark, d):
    pick = F.get(F.array(*map(F.lit, ("[data-ved]", "div.g", "#tads div", "", "div[jscontroller]"))), (F.col("hit_id") % 5).cast("int"))
    c = hits_of(spark, d).select("hit_id", pick.alias("selector"), F.when(F.col("hit_id") % 5 == 1, "class-fallback").otherwise("data-ved").alias("source"))
    ok = repair.gate_c(F.when(F.col("hit_id") % 3 == 0, "low").otherwise("high"), F.when(F.col("hit_id") % 2 == 0, "approve_candidate").otherwise("reject"))
    return c.select("hit_id", "selector", repair.gate_b(F.col("selector"), F.col("source")).alias("reason"), ok.alias("choice_passes"))


# ---- extracted texts ----------------------------------------------------------------------------------------


@query("SELECT doc_id, substr(text, 1, 200) AS excerpt, length(substr(text, 1, 8000))::INT AS length FROM documents WHERE text IS NOT NULL")
def document_excerpt(spark, d):
    out = ex.clipped(table(spark, d, "documents").where("text is not null"), F.col("text"))
    return out.select("doc_id", "excerpt", "length")


@query("SELECT doc_id, replace(replace(replace(replace(replace(replace(e, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' ') AS plain FROM (SELECT doc_id, 'A &amp;lt; B &quot;' || coalesce(title, '') || '&#39; &nbsp;' AS e FROM documents)")
def entity_decode(spark, d):
    raw = F.concat(F.lit("A &amp;lt; B &quot;"), F.coalesce("title", F.lit("")), F.lit("&#39; &nbsp;"))
    return table(spark, d, "documents").select("doc_id", T.decode_entities(raw).alias("plain"))


@query(
    f"""WITH {HITS}, u AS (SELECT hit_id, CASE hit_id % 10 WHEN 0 THEN 'http://127.0.0.1/a' WHEN 1 THEN 'http://10.' || (hit_id % 250)::VARCHAR || '.0.1/' WHEN 2 THEN 'http://172.' || (hit_id % 40)::VARCHAR || '.1.1/x' WHEN 3 THEN 'ftp://files.example/a' WHEN 4 THEN 'not a url' WHEN 5 THEN 'http://localhost:80/' WHEN 6 THEN 'https://fcexample.test/' ELSE url END AS url FROM hits)
SELECT hit_id, CASE WHEN url IS NULL OR NOT regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN 'invalid url' WHEN NOT regexp_matches(url, '^https?:') THEN 'unsupported protocol: ' || regexp_extract(url, '^([a-zA-Z]+:)', 1)
WHEN regexp_matches({SQL_HOST}, '^(localhost|127[.].*|10[.].*|172[.](1[6-9]|2[0-9]|3[01])[.].*)$') THEN 'private/internal address blocked' END AS reason FROM u"""
)
def url_guard(spark, d):
    """Addresses of several kinds by id (synthetic) and the reasons not to fetch them."""
    k = (F.col("hit_id") % 10).cast("int")
    kinds = F.array(
        F.lit("http://127.0.0.1/a"), F.concat(F.lit("http://10."), (F.col("hit_id") % 250).cast("string"), F.lit(".0.1/")), F.concat(F.lit("http://172."), (F.col("hit_id") % 40).cast("string"), F.lit(".1.1/x")),
        F.lit("ftp://files.example/a"), F.lit("not a url"), F.lit("http://localhost:80/"), F.lit("https://fcexample.test/"),
    )
    return hits_of(spark, d).select("hit_id", T.url_guard(F.when(k < 7, F.get(kinds, k)).otherwise(F.col("url"))).alias("reason"))


@query(
    f"""WITH {HITS} SELECT hit_id, CASE hit_id % 6 WHEN 0 THEN 'https://openreview.net/pdf?id=p' || hit_id::VARCHAR WHEN 1 THEN 'https://www.biorxiv.org/content/10.1/' || hit_id::VARCHAR || '.full.pdf' WHEN 2 THEN 'https://www.nature.com/articles/s' || hit_id::VARCHAR || '.pdf' END AS pdf FROM hits"""
)
def pdf_address(spark, d):
    n = F.col("hit_id").cast("string")
    urls = F.array(
        F.concat(F.lit("https://openreview.net/forum?id=p"), n, F.lit("&x=1")), F.concat(F.lit("https://www.biorxiv.org/content/10.1/"), n, F.lit("/?q=1")), F.concat(F.lit("https://www.nature.com/articles/s"), n),
        F.concat(F.lit("https://www.nature.com/articles/s"), n, F.lit(".pdf")), F.concat(F.lit("https://openreview.net/forum?x="), n), F.lit("not a url"),
    )
    return hits_of(spark, d).select("hit_id", T.pdf_address(F.get(urls, (F.col("hit_id") % 6).cast("int"))).alias("pdf"))


@query(f"WITH {EXTRACTS} SELECT extract_id, CASE WHEN f THEN 'EXTRACT_FAILED' END AS code, CASE WHEN f THEN error END AS message, CASE WHEN f THEN true END AS retryable, CASE WHEN f THEN 1000 END::BIGINT AS retry_after_ms FROM (SELECT *, coalesce(error, '') <> '' AND coalesce(content, '') = '' AS f FROM ext)")
def extract_outcome(spark, d):
    return extracts_of(spark, d).select("extract_id", triage.extract_outcome(F.col("content"), F.col("error")).alias("e")).select("extract_id", "e.*")


# Messages of every kind by id (synthetic), with the errors of the extracts among them.
_MESSAGES = ("Google CAPTCHA at home", "Profile not initialized. Run bootstrap", "page.goto: Timeout 12000ms exceeded", "HTTP 429", "Rate-limit hit", "parser stale: 7 h3 elements but 0 results extracted by any strategy", "private/internal address blocked", "resolved to loopback", "something broke")
_KINDS = f"k AS (SELECT extract_id, extract_id % 2 = 0 AS cloud, CASE WHEN extract_id % 10 = 9 THEN error ELSE [{', '.join(chr(39) + m + chr(39) for m in _MESSAGES)}][extract_id % 10 + 1] END AS m FROM ext)"
_CODE = """c AS (SELECT *, CASE WHEN m IS NULL THEN NULL WHEN starts_with(m, 'Google CAPTCHA at ') THEN CASE WHEN cloud THEN 'CAPTCHA_REQUIRED' ELSE 'CAPTCHA_RECOVER_FAIL' END WHEN regexp_matches(m, '(?i)profile not initialized') THEN 'PROFILE_MISSING' WHEN regexp_matches(m, '(?i)timeout') THEN 'NAV_TIMEOUT'
WHEN regexp_matches(m, '(?i)429|too many requests|rate.?limit') THEN 'RATE_LIMITED' WHEN regexp_matches(m, '(?i)parser.?stale|h3.+but.+0 results') THEN 'PARSER_STALE' WHEN regexp_matches(m, '(?i)private/internal address|loopback') THEN 'PRIVATE_ADDRESS' ELSE 'INTERNAL' END AS code FROM k),
e AS (SELECT extract_id, code, CASE WHEN code = 'CAPTCHA_REQUIRED' THEN 'Google CAPTCHA encountered. Cloud mode cannot solve interactively.' WHEN code = 'INTERNAL' THEN substr(m, 1, 500) ELSE m END AS message, CASE WHEN code IS NOT NULL THEN code IN ('NAV_TIMEOUT', 'RATE_LIMITED') END AS retryable, CASE code WHEN 'NAV_TIMEOUT' THEN 1000 WHEN 'RATE_LIMITED' THEN 60000 END::BIGINT AS retry_after_ms,
CASE code WHEN 'CAPTCHA_REQUIRED' THEN 'Run on an interactive desktop session, or refresh profile: npm run bootstrap' WHEN 'CAPTCHA_RECOVER_FAIL' THEN 'Solve CAPTCHA in opened browser, or run: npm run bootstrap' WHEN 'PROFILE_MISSING' THEN 'Run: npm run bootstrap' WHEN 'PARSER_STALE' THEN 'Selector may need update. Check repo for newer version.' END AS user_action FROM c)"""


def errors_of(spark, d) -> DataFrame:
    i = F.col("extract_id")
    m = F.when(i % 10 == 9, F.col("error")).otherwise(F.get(F.array(*map(F.lit, _MESSAGES)), (i % 10).cast("int")))
    rows = extracts_of(spark, d).select("extract_id", m.alias("m"))
    return rows.select("extract_id", triage.error_info(F.col("m"), F.col("m").startswith("Google CAPTCHA at "), i % 2 == 0).alias("e"))


@query(f"WITH {EXTRACTS}, {_KINDS}, {_CODE} SELECT * FROM e")
def error_info(spark, d):
    return errors_of(spark, d).select("extract_id", "e.*")


@query(f"WITH {EXTRACTS}, {_KINDS}, {_CODE} SELECT extract_id, 'Error [' || code || ']: ' || message || coalesce(chr(10) || 'Action: ' || user_action, '') || coalesce(chr(10) || 'Retry after: ' || retry_after_ms || 'ms', '') AS text, code IS NOT NULL AS is_error FROM e WHERE code IS NOT NULL")
def error_response(spark, d):
    """What a reader is told about each error."""
    none = F.lit(None).cast("string")
    answers = errors_of(spark, d).where("e is not null").select("extract_id", triage.response(none, F.col("e"), none).alias("r"))
    return answers.select("extract_id", "r.text", "r.is_error")


@query("SELECT event_id, event_type IN ('error') OR event_id % 3 = 0 AS known FROM events")
def error_codes(spark, d):
    """Words that are error codes and words that are not (synthetic)."""
    word = F.when((F.col("event_type") == "error") | (F.col("event_id") % 3 == 0), F.get(F.array(*map(F.lit, triage.ERROR_CODES)), (F.col("event_id") % 10).cast("int"))).otherwise(F.upper("event_type"))
    return table(spark, d, "events").select("event_id", triage.is_error_code(word).alias("known"))


@query(f"WITH {HITS}, {EXTRACTS} SELECT hits.hit_id, ext.extract_id, ext.extraction_quality, coalesce(ext.error, '') AS error, length(ext.content)::INT AS length FROM hits LEFT JOIN ext ON hits.hit_id = ext.hit_id")
def hit_enrich(spark, d):
    e = extracts_of(spark, d).select("hit_id", "extract_id", "extraction_quality", F.coalesce("error", F.lit("")).alias("error"), F.length("content").alias("length"))
    return hits_of(spark, d).select("hit_id").join(e, "hit_id", "left").withColumn("error", F.when(F.col("extract_id").isNotNull(), F.col("error")).otherwise(""))


@query("SELECT source AS host, count(*)::BIGINT AS documents, count(text)::BIGINT AS with_text, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source")
def host_volume(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("host")).agg(F.count("*").alias("documents"), F.count("text").alias("with_text"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("chars"))


@query(
    f"""WITH {EXTRACTS}, p AS (SELECT url, extract_id, content FROM ext WHERE content IS NOT NULL AND is_pdf)
SELECT extract_id, 2::INT AS page_count, substr(substr(content, 1, 500), 1, 300) AS content, length(substr(substr(content, 1, 500), 1, 300))::INT AS length, 'abstract' AS extraction_quality FROM p"""
)
def pdf_first_page(spark, d):
    """PDF texts cut into two pages; the tier that keeps the first."""
    e = extracts_of(spark, d).where("content is not null and is_pdf")
    cut = F.array(F.struct(F.lit(1).alias("page_no"), F.substring("content", 1, 500).alias("text")), F.struct(F.lit(2).alias("page_no"), F.expr("substring(content, 501)").alias("text")))
    pages = e.select(F.col("extract_id").cast("string").alias("url"), F.explode(cut).alias("p")).select("url", "p.*")
    out = ex.pdf_tiers(pages, "abstract", 300)
    return out.select(F.col("url").cast("bigint").alias("extract_id"), "page_count", "content", "length", "extraction_quality")


@query()
def article_text(spark, d):
    """Text and Markdown of articles' HTML."""
    a = telemetry.latest(table(spark, d, "readability_output"), "article_id", "loaded_at").where("content is not null")
    return a.select("article_id", ex.html_text("content").alias("text"), ex.html_markdown("content").alias("markdown"))


@query(
    f"""WITH {HITS}, u AS (SELECT hit_id, url, {SQL_HOST} AS host FROM hits), dns AS (SELECT host, min(hit_id) % 3 = 0 AS private FROM u WHERE host IS NOT NULL GROUP BY host HAVING min(hit_id) % 2 = 0)
SELECT hit_id, CASE WHEN url IS NULL THEN 'invalid url' WHEN private THEN 'resolved to private address' END AS reason FROM u LEFT JOIN dns USING (host)"""
)
def url_guard_resolved(spark, d):
    """Half of the hosts are known to the name table, some of them with a private address (synthetic)."""
    h = hits_of(spark, d).select("hit_id", "url")
    first = h.where("url is not null").groupBy(T.host("url").alias("host")).agg(F.min("hit_id").alias("i")).where("i % 2 = 0")
    dns = first.select("host", F.when(F.col("i") % 3 == 0, "10.0.0.1").otherwise("93.184.216.34").alias("address"))
    return ex.resolved_guard(h, dns).select("hit_id", "reason")


@query(f"WITH {EXTRACTS} SELECT extract_id, (url LIKE '%/sorry/%' OR url LIKE '%consent.google.%' OR coalesce(regexp_matches(content, '(?i)unusual traffic|systems have detected|are not a robot'), false) OR extract_id % 50 < 2) AS blocked FROM ext WHERE url IS NOT NULL")
def block_detect(spark, d):
    """Block pages by address, text and HTML, where some pages hold a captcha's form or frame by id (synthetic)."""
    i = F.col("extract_id") % 50
    html = F.when(i == 0, "<p>x</p><form class='a' id='captcha-form' action='x'>").when(i == 1, '<iframe title="t" src="https://x.test/recaptcha/api">').otherwise('<form id="captcha-formal"></form><iframe src="/a"></iframe>')
    return extracts_of(spark, d).where("url is not null").select("extract_id", triage.blocked(F.col("url"), F.col("content"), html).alias("blocked"))


@query(f"WITH {EXTRACTS} SELECT extract_id, chr(10) || '--- BEGIN UNTRUSTED CONTENT ---' || chr(10) || content || chr(10) || '--- END UNTRUSTED CONTENT ---' || chr(10) AS fenced FROM ext WHERE content IS NOT NULL")
def fenced_content(spark, d):
    return extracts_of(spark, d).where("content is not null").select("extract_id", T.fence("content").alias("fenced"))


@query(f"WITH {HITS}, a AS (SELECT page_id, pos % 3 AS attempt, count(*) AS n FROM hits GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, attempt) AS k FROM a) SELECT page_id, attempt::INT AS attempt, n::BIGINT AS hits FROM r WHERE k = 1")
def best_attempt(spark, d):
    a = hits_of(spark, d).groupBy("page_id", (F.col("pos") % 3).alias("attempt")).agg(F.count("*").alias("hits"))
    return score.best_attempt(a, "page_id")


@query(f"WITH {HITS} SELECT hit_id, CASE WHEN hit_id % 4 = 0 THEN 'propose_new' ELSE 'approve_candidate' END AS decision, CASE WHEN hit_id % 4 = 0 THEN '[data-ved] h3' ELSE 'div.x' || hit_id::VARCHAR END AS selector, '[mock] model not enabled, ' || CASE WHEN hit_id % 4 = 0 THEN 'fallback to data-ved anchor' ELSE 'defaulting to first candidate' END AS rationale, 'low' AS confidence, 5::INT AS expected_min_blocks FROM hits")
def repair_offline_choice(spark, d):
    first = F.when(F.col("hit_id") % 4 != 0, F.concat(F.lit("div.x"), F.col("hit_id").cast("string")))
    return hits_of(spark, d).select("hit_id", repair.offline_choice(first).alias("c")).select("hit_id", "c.*")


# ---- event log ----------------------------------------------------------------------------------------------


def fields_of(spark, d) -> DataFrame:
    log = log_of(spark, d)
    at = F.expr("try_to_timestamp(ts)").cast("timestamp_ntz")
    return log.select("event_id", "event_type", "event_data", at.alias("at"), telemetry.number_field("event_data", "ms").alias("ms"), F.get_json_object("event_data", "$.strategy").alias("strategy"), telemetry.number_field("event_data", "results").alias("results"))


_FIELDS = f"""{LOG}, f AS (SELECT event_id, event_type, event_data, try_cast(replace(replace(ts, 'T', ' '), 'Z', '') AS TIMESTAMP) AS happened,
CASE WHEN json_valid(event_data) AND NOT regexp_matches(event_data, '"ms"\\s*:\\s*"') THEN try_cast(json_extract_string(event_data, '$.ms') AS DOUBLE) END AS ms, CASE WHEN json_valid(event_data) THEN json_extract_string(event_data, '$.strategy') END AS strategy,
CASE WHEN json_valid(event_data) AND NOT regexp_matches(event_data, '"results"\\s*:\\s*"') THEN try_cast(json_extract_string(event_data, '$.results') AS DOUBLE) END AS results FROM log)"""


@query(f"WITH {_FIELDS} SELECT event_id, ms, results, strategy FROM f WHERE json_valid(event_data)")
def event_fields(spark, d):
    ok = F.expr("try_parse_json(event_data) IS NOT NULL")
    return fields_of(spark, d).where(ok).select("event_id", "ms", "results", "strategy")


@query(f"WITH {_FIELDS}, v AS (SELECT event_type, ms, row_number() OVER (PARTITION BY event_type ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM f WHERE ms IS NOT NULL AND json_valid(event_data)) SELECT event_type, ms AS percentile FROM v WHERE i = least(n - 1, floor(0.95 * n))")
def event_percentile(spark, d):
    f = fields_of(spark, d).where("try_parse_json(event_data) IS NOT NULL")
    return telemetry.nearest_rank(f, "event_type", "ms", 0.95)


@query(f"WITH {_FIELDS} SELECT event_type, {R3('avg(ms)')} AS mean FROM f WHERE json_valid(event_data) AND ms IS NOT NULL GROUP BY event_type")
def event_mean(spark, d):
    m = telemetry.mean(fields_of(spark, d).where("try_parse_json(event_data) IS NOT NULL"), "event_type", "ms")
    return m.select("event_type", r3(F.col("mean")).alias("mean"))


@query("WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, round(sum(value * CASE WHEN r = n - 1 THEN pow(0.7, r) ELSE 0.3 * pow(0.7, r) END), 6) AS ewma FROM v GROUP BY event_type")
def event_ewma(spark, d):
    e = telemetry.ewma(table(spark, d, "events"), "event_type", "value", ["ts", "event_id"])
    return e.select("event_type", F.round("ewma", 6).alias("ewma"))


@query("SELECT event_id, event_type FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAYS")
def event_rolling_window(spark, d):
    return telemetry.since(table(spark, d, "events").where("event_type = 'click'"), "ts", "2024-01-31 00:00:00", 7).select("event_id", "event_type")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_json_field(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query(f"WITH {_FIELDS} SELECT strftime(happened, '%Y-%m-%d') AS day, count(*)::BIGINT AS events, count(*) FILTER (NOT json_valid(event_data))::BIGINT AS broken FROM f GROUP BY 1")
def event_days(spark, d):
    f = fields_of(spark, d)
    return f.groupBy(F.date_format("at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("events"), F.count_if(F.expr("try_parse_json(event_data) IS NULL")).alias("broken"))


@query(f"WITH {LOG} SELECT event_id, CASE WHEN strlen('{{\"ts\":\"' || coalesce(ts, '') || '\",\"type\":\"' || event_type || '\",\"data\":' || coalesce(event_data, 'null') || '}}') > 110 THEN '{{\"_truncated\":true,\"_originalType\":\"' || event_type || '\"}}' ELSE event_data END AS data FROM log")
def event_truncate(spark, d):
    log = log_of(spark, d)
    return log.select("event_id", telemetry.truncated(log, "ts", "event_type", "event_data", 110).alias("data"))


# ---- strategies ---------------------------------------------------------------------------------------------

_OUT = "o AS (SELECT event_id, strategy AS strategy_id, CASE WHEN results > 0 AND event_id % 10 <> 3 THEN 'win' WHEN event_id % 10 = 3 THEN 'loss' ELSE 'zero' END AS kind, happened AS ts FROM f WHERE strategy IS NOT NULL AND json_valid(event_data))"
_STATS = "SELECT strategy_id, count(*) FILTER (kind = 'win')::BIGINT AS wins, count(*) FILTER (kind = 'zero')::BIGINT AS zeros, count(*) FILTER (kind = 'loss')::BIGINT AS losses, max(ts) FILTER (kind = 'win') AS last_win FROM"


def outcomes_of(spark, d) -> DataFrame:
    f = fields_of(spark, d).where("strategy is not null and try_parse_json(event_data) IS NOT NULL")
    kind = F.when((F.coalesce("results", F.lit(0.0)) > 0) & (F.col("event_id") % 10 != 3), "win").when(F.col("event_id") % 10 == 3, "loss").otherwise("zero")
    return f.select("event_id", F.col("strategy").alias("strategy_id"), kind.alias("kind"), F.col("at").alias("ts"))


@query(f"WITH {_FIELDS}, {_OUT} {_STATS} o GROUP BY strategy_id")
def strategy_stats(spark, d):
    return ranking.outcome_counts(outcomes_of(spark, d))


@query(f"WITH {_FIELDS}, {_OUT}, a AS ({_STATS} o WHERE event_id % 2 = 0 GROUP BY strategy_id), p AS (SELECT * REPLACE (CASE WHEN strategy_id = 'class' THEN 'class-b' ELSE strategy_id END AS strategy_id) FROM o WHERE event_id % 2 = 1), b AS ({_STATS} p GROUP BY strategy_id), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT strategy_id, sum(wins)::BIGINT AS wins, sum(zeros)::BIGINT AS zeros, sum(losses)::BIGINT AS losses, max(last_win) AS last_win FROM u GROUP BY strategy_id")
def strategy_merge(spark, d):
    """Counters of two sources, here the even and the odd events, with a strategy that each has alone."""
    o = outcomes_of(spark, d)
    even = ranking.outcome_counts(o.where("event_id % 2 = 0"))
    renamed = F.when(F.col("strategy_id") == "class", "class-b").otherwise(F.col("strategy_id"))
    odd = ranking.outcome_counts(o.where("event_id % 2 = 1").withColumn("strategy_id", renamed))
    return ranking.merge_counts(even, odd)


@query(
    f"""WITH {_FIELDS}, {_OUT}, s AS ({_STATS} o GROUP BY strategy_id), d AS (SELECT * FROM (VALUES ('structural', 0), ('fallback', 1), ('class', 2), ('unused', 3)) t(strategy_id, idx)),
j AS (SELECT d.strategy_id, idx, coalesce(wins * 10 - zeros, 0) AS score, coalesce(wins, 0) AS wins, coalesce(last_win, TIMESTAMP '1970-01-01') AS last FROM d LEFT JOIN s USING (strategy_id)),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, last DESC, idx) AS n, row_number() OVER (ORDER BY score DESC, idx) AS k FROM j)
SELECT strategy_id, CASE WHEN (SELECT wins FROM r WHERE k = 1) - (SELECT wins FROM r WHERE k = 2) < 3 THEN idx + 1 ELSE n END::BIGINT AS place FROM r"""
)
def strategy_order(spark, d):
    defaults = spark.createDataFrame([("structural", 0), ("fallback", 1), ("class", 2), ("unused", 3)], "strategy_id string, idx int")
    return ranking.strategy_order(defaults, ranking.outcome_counts(outcomes_of(spark, d)))


# ---- faults -------------------------------------------------------------------------------------------------

_SIGNAL = f"""{HITS}, p AS (SELECT page_id, count(*) FILTER (page_id % 4 <> 0) AS results FROM hits GROUP BY page_id), s AS (SELECT page_id, results::INT AS results, (page_id % 12)::INT AS h3, CASE page_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 200 END AS status,
CASE WHEN page_id % 17 = 0 THEN 'https://example.test/sorry/index' ELSE 'https://example.test/search' END AS url, (page_id % 20) * 1000 AS ms, CASE WHEN page_id % 3 = 0 THEN (page_id % 10) / 10.0 END AS geom, CASE WHEN page_id % 5 = 0 THEN (page_id % 4)::INT END AS zeros FROM p)"""
_FAULT = "f AS (SELECT *, CASE WHEN url LIKE '%/sorry/%' THEN 'blocked' WHEN status = 429 THEN 'rate_limited' WHEN status >= 400 THEN 'network_error' WHEN (h3 > 5 AND results = 0)::INT + coalesce(geom < 0.4, false)::INT + coalesce(zeros >= 2, false)::INT >= 2 AND status = 200 THEN 'selector_broken' WHEN ms > 15000 AND results BETWEEN 1 AND 2 THEN 'rate_limited' WHEN h3 > 5 AND results = 0 AND status = 200 THEN 'selector_broken' ELSE 'unknown' END AS fault FROM s)"


def faults_of(spark, d) -> DataFrame:
    p = hits_of(spark, d).groupBy("page_id").agg(F.count_if(F.col("page_id") % 4 != 0).cast("int").alias("results"))
    i = F.col("page_id")
    s = p.withColumns(
        {
            "h3": (i % 12).cast("int"),
            "status": F.when(i % 9 == 0, 429).when(i % 9 == 1, 503).otherwise(200),
            "url": F.when(i % 17 == 0, "https://example.test/sorry/index").otherwise("https://example.test/search"),
            "ms": (i % 20) * 1000,
            "geom": F.when(i % 3 == 0, (i % 10) / 10),
            "zeros": F.when(i % 5 == 0, (i % 4).cast("int")),
        }
    )
    return s.withColumn("fault", triage.fault(*(F.col(c) for c in ("url", "status", "ms", "results", "h3", "geom", "zeros"))))


@query(f"WITH {_SIGNAL}, {_FAULT} SELECT page_id, results, h3, status, fault FROM f")
def fault_triage(spark, d):
    """Signals by arithmetic on the page's id (synthetic), and the fault they speak for."""
    return faults_of(spark, d).select("page_id", "results", "h3", "status", "fault")


@query(f"WITH {_SIGNAL}, {_FAULT} SELECT page_id, 'type=' || fault || ' results=' || results::VARCHAR || ' h3=' || h3::VARCHAR || CASE WHEN status <> 200 THEN ' status=' || status::VARCHAR ELSE '' END || CASE WHEN geom IS NOT NULL THEN ' geom=' || printf('%.2f', geom::DOUBLE) ELSE '' END AS description FROM f")
def fault_text(spark, d):
    f = faults_of(spark, d)
    return f.select("page_id", triage.describe(*(F.col(c) for c in ("fault", "results", "h3", "status", "geom"))).alias("description"))


@query(
    f"""WITH {_SIGNAL}, {_FAULT}, r AS (SELECT * FROM (VALUES ('selector_broken', 'retry_with_strategy', NULL, NULL, NULL), ('blocked', 'backoff', 1800000, 1.0, 1), ('rate_limited', 'backoff', 60000, 2.0, 3), ('network_error', 'backoff', 1000, 2.0, 3), ('unknown', 'alert_only', NULL, NULL, NULL)) t(fault, action, initial_ms, factor, max_attempts))
SELECT fault, action, initial_ms::BIGINT AS initial_ms, factor::DOUBLE AS factor, max_attempts::INT AS max_attempts, count(*)::BIGINT AS pages FROM f JOIN r USING (fault) GROUP BY ALL"""
)
def fault_recovery(spark, d):
    counts = faults_of(spark, d).groupBy("fault").agg(F.count("*").alias("pages"))
    return counts.join(triage.recovery(spark), "fault")


# ---- state over keyed sequences -----------------------------------------------------------------------------


def requests_of(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("request_id"), "event_type")


_REQ = "q AS (SELECT user_id AS key, epoch_us(ts) AS at_us, event_id AS request_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n FROM events)"


_LIMITER = f"""{_REQ}, w AS (SELECT key, n, request_id, at_us, true AS granted, [at_us] AS g FROM q WHERE n = 1 UNION ALL
SELECT q.key, q.n, q.request_id, q.at_us, len(list_filter(w.g, lambda x: x > q.at_us - 3600000000)) < 2, CASE WHEN len(list_filter(w.g, lambda x: x > q.at_us - 3600000000)) < 2 THEN list_append(list_filter(w.g, lambda x: x > q.at_us - 3600000000), q.at_us) ELSE list_filter(w.g, lambda x: x > q.at_us - 3600000000) END
FROM w JOIN q ON q.key = w.key AND q.n = w.n + 1)"""


@query(f"WITH RECURSIVE {_LIMITER} SELECT key, request_id, granted FROM w")
def limiter_replay(spark, d):
    return replay.admissions(requests_of(spark, d), 2, 3_600_000_000).select("key", "request_id", "granted")


@query(f"WITH RECURSIVE {_LIMITER} SELECT key, request_id, len(g)::INT AS recent FROM w")
def recent_count(spark, d):
    """Grants in the window once each request is decided."""
    return replay.admissions(requests_of(spark, d), 2, 3_600_000_000).select("key", "request_id", "recent")


@query(f"WITH RECURSIVE {_LIMITER} SELECT key, request_id, CASE WHEN len(g) < 2 THEN 0 ELSE greatest(0, 3600000000 - (at_us - g[1])) + 5000 END::BIGINT AS retry_after_us FROM w")
def retry_after(spark, d):
    """How long a request that comes next would have to wait."""
    return replay.admissions(requests_of(spark, d), 2, 3_600_000_000).select("key", "request_id", "retry_after_us")


@query(
    f"""WITH RECURSIVE {_REQ}, w AS (SELECT key, n, request_id, false AS hit, at_us + 86400000000 AS until FROM q WHERE n = 1 UNION ALL
SELECT q.key, q.n, q.request_id, q.at_us <= w.until, CASE WHEN q.at_us <= w.until THEN w.until ELSE q.at_us + 86400000000 END FROM w JOIN q ON q.key = w.key AND q.n = w.n + 1) SELECT key, request_id, hit FROM w"""
)
def ttl_replay(spark, d):
    return replay.cache_replay(requests_of(spark, d), 86_400_000_000)


@query(
    f"""WITH RECURSIVE {_REQ}, e AS (SELECT *, (event_type IN ('error', 'click'))::INT AS c FROM q), w AS (SELECT key, n, request_id, CASE WHEN c = 1 THEN 'on' ELSE 'off' END AS mode, 0 AS failures, c AS off, 0 AS "on", CASE WHEN c = 1 THEN 'on' END AS step FROM e WHERE n = 1 UNION ALL
SELECT e.key, e.n, e.request_id, CASE WHEN e.c = 1 THEN 'on' ELSE w.mode END, CASE WHEN e.c = 0 THEN w.failures WHEN w.mode = 'off' OR w.failures + 1 >= 2 THEN 0 ELSE w.failures + 1 END, w.off + CASE WHEN w.mode = 'off' THEN e.c ELSE 0 END, w."on" + CASE WHEN w.mode = 'on' THEN e.c ELSE 0 END,
CASE WHEN e.c = 0 THEN NULL WHEN w.mode = 'off' THEN 'on' WHEN w.failures + 1 >= 2 THEN 'tier3' ELSE 'retry' END FROM w JOIN e ON e.key = w.key AND e.n = w.n + 1) SELECT key, request_id, mode, failures, off, "on", step FROM w"""
)
def cascade_replay(spark, d):
    return replay.cascade_replay(requests_of(spark, d).withColumn("captcha", F.col("event_type").isin("error", "click")))


@query(
    f"""WITH RECURSIVE {_REQ}, w AS (SELECT key, n, request_id, at_us AS start, [at_us] AS g FROM q WHERE n = 1 UNION ALL SELECT key, n, request_id, CASE WHEN ok THEN turn END, CASE WHEN ok THEN list_append(g, turn)[-2:] ELSE g END FROM (SELECT *, turn - at_us <= 600000000 AS ok FROM
(SELECT q.key, q.n, q.request_id, q.at_us, list_filter(w.g, lambda x: x > q.at_us - 3600000000) AS g, greatest(q.at_us, coalesce(list_filter(w.g, lambda x: x > q.at_us - 3600000000)[-1], q.at_us), CASE WHEN len(list_filter(w.g, lambda x: x > q.at_us - 3600000000)) >= 2 THEN list_filter(w.g, lambda x: x > q.at_us - 3600000000)[-2] + 3600000000 ELSE q.at_us END) AS turn FROM w JOIN q ON q.key = w.key AND q.n = w.n + 1)))
SELECT key, request_id, start IS NOT NULL AS granted, start AS start_us FROM w"""
)
def queue_replay(spark, d):
    """Requests that may wait up to ten minutes for their turn."""
    return replay.queued_admissions(requests_of(spark, d), 2, 3_600_000_000, 600_000_000)


@query(
    f"""WITH RECURSIVE {_REQ}, a AS (SELECT *, CASE WHEN request_id % 7 <> 0 THEN '10.0.0.' || (request_id % 200) END AS address FROM q), w AS (SELECT key, n, request_id, address, true AS asked, CASE WHEN address IS NULL THEN 0 ELSE at_us + 36000000000 END AS until FROM a WHERE n = 1 UNION ALL
SELECT a.key, a.n, a.request_id, CASE WHEN w.until > a.at_us THEN w.address ELSE a.address END, w.until <= a.at_us, CASE WHEN w.until > a.at_us THEN w.until WHEN a.address IS NULL THEN 0 ELSE a.at_us + 36000000000 END FROM w JOIN a ON a.key = w.key AND a.n = w.n + 1) SELECT key::VARCHAR AS key, request_id, address, asked FROM w"""
)
def name_lookups(spark, d):
    """Names that are users' ids, with an address for each request (synthetic) that lives ten hours."""
    i = F.col("request_id")
    address = F.when(i % 7 != 0, F.concat(F.lit("10.0.0."), (i % 200).cast("string")))
    return replay.name_lookups(requests_of(spark, d).withColumns({"key": F.col("key").cast("string"), "address": address}), 36_000_000_000)


@query(
    f"""WITH RECURSIVE {_REQ}, b AS (SELECT *, (event_type <> 'view')::INT AS bad FROM q), w AS (SELECT key, n, request_id, bad AS failures FROM b WHERE n = 1 UNION ALL
SELECT b.key, b.n, b.request_id, CASE WHEN w.failures >= 3 THEN w.failures WHEN bad = 1 THEN w.failures + 1 ELSE 0 END FROM w JOIN b ON b.key = w.key AND b.n = w.n + 1) SELECT key, request_id, failures::INT AS failures, failures >= 3 AS given_up FROM w"""
)
def failure_budget(spark, d):
    return replay.failure_budget(requests_of(spark, d).withColumn("failed", F.col("event_type") != "view"))


@query(f"WITH {_REQ}, m AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY key ORDER BY at_us, request_id) AS run FROM q), g AS (SELECT key, run, count(*) FILTER (event_type = 'error') AS k FROM m GROUP BY key, run) SELECT key, max(k)::BIGINT AS longest, max(k) >= 3 AS falls_back FROM g GROUP BY key")
def pool_fallback(spark, d):
    r = requests_of(spark, d).withColumn("failed", F.col("event_type") == "error")
    return replay.longest_failure_run(r, "key", ["at_us", "request_id"], "failed")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 10")
def lru_keep(spark, d):
    return replay.newest_entries(table(spark, d, "events"), "user_id", "ts", 10, "event_id").select("user_id", "event_id")


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), s AS (SELECT user_id, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTES)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*)::BIGINT AS sessions, max(n)::BIGINT AS longest FROM c GROUP BY user_id")
def session_counts(spark, d):
    return telemetry.sessions(table(spark, d, "events"), "user_id", "ts")


@query("SELECT event_id, event_type || '|en-US|10' AS key, substr(sha256(event_type || '|en-US|10'), 1, 16) AS name FROM events")
def cache_key(spark, d):
    e = table(spark, d, "events")
    return e.withColumns({"loc": F.lit("en-US"), "lim": F.lit("10")}).select("event_id", ev.cache_key("event_type", "loc", "lim").alias("k")).select("event_id", "k.*")


@query("WITH e AS (SELECT event_type AS key, max_by(value, (ts, event_id)) AS value, max(ts) + INTERVAL 1 HOUR AS until FROM events WHERE event_id % 2 = 0 GROUP BY event_type) SELECT events.event_id, coalesce(e.until >= events.ts, false) AS hit FROM events LEFT JOIN e ON events.event_type = e.key WHERE events.event_id % 2 = 1")
def cache_lookup(spark, d):
    e = table(spark, d, "events")
    puts = e.where("event_id % 2 = 0").select(F.lit("search").alias("ns"), F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.col("ts").alias("stored_at"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("expires_at"))
    entries = ev.put_entries(puts.limit(0), puts)
    reads = e.where("event_id % 2 = 1").select(F.lit("search").alias("ns"), F.col("event_type").alias("key"), F.col("ts").alias("at"), "event_id")
    return ev.get_entries(reads, entries).select("event_id", "hit")


@query("SELECT i AS attempt, (100 * pow(2, i))::BIGINT AS delay_ms FROM generate_series(0, 2) t(i)")
def backoff_schedule(spark, d):
    return replay.backoff_schedule(spark, 100, 2.0, 4)


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'cloud_fail_fast' WHEN event_id % 2 = 0 THEN 'remote_debug' WHEN event_id % 3 <> 0 THEN 'always_headed' ELSE 'notify_spawn' END AS mode FROM events")
def captcha_mode(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", triage.captcha_mode(i % 5 == 0, i % 3 == 0, i % 2 == 0).alias("mode"))


@query("SELECT event_type AS mode, count(*) FILTER (value > 50)::BIGINT AS captchas, count(*)::BIGINT AS total FROM events GROUP BY event_type")
def captchas_by_mode(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count_if(F.col("value") > 50).alias("captchas"), F.count("*").alias("total"))


@query(
    f"""WITH RECURSIVE {_REQ}, l AS (SELECT *, row_number() OVER (ORDER BY at_us, request_id) AS i FROM q WHERE key = 1),
lw AS (SELECT i, at_us, [at_us] AS g FROM l WHERE i = 1 UNION ALL SELECT l.i, l.at_us, CASE WHEN len(list_filter(lw.g, lambda x: x > l.at_us - 60000000)) < 10 THEN list_append(list_filter(lw.g, lambda x: x > l.at_us - 60000000), l.at_us) ELSE list_filter(lw.g, lambda x: x > l.at_us - 60000000) END FROM lw JOIN l ON l.i = lw.i + 1),
c AS (SELECT i, CASE WHEN event_type = 'error' THEN 'on' ELSE 'off' END AS mode, 0 AS n, (event_type = 'error')::INT AS o, 0 AS k FROM l WHERE i = 1 UNION ALL SELECT l.i, CASE WHEN l.event_type = 'error' THEN 'on' ELSE c.mode END, CASE WHEN l.event_type <> 'error' THEN c.n WHEN c.mode = 'off' OR c.n + 1 >= 2 THEN 0 ELSE c.n + 1 END, c.o + CASE WHEN c.mode = 'off' AND l.event_type = 'error' THEN 1 ELSE 0 END, c.k + CASE WHEN c.mode = 'on' AND l.event_type = 'error' THEN 1 ELSE 0 END FROM c JOIN l ON l.i = c.i + 1),
b AS (SELECT i, (event_type <> 'view')::INT AS n FROM l WHERE i = 1 UNION ALL SELECT l.i, CASE WHEN b.n >= 3 THEN b.n WHEN l.event_type <> 'view' THEN b.n + 1 ELSE 0 END FROM b JOIN l ON l.i = b.i + 1),
{_FIELDS}, {_OUT}, s AS ({_STATS} o GROUP BY strategy_id)
SELECT (SELECT count(*) FROM f)::BIGINT AS events, (SELECT count(*) FILTER (event_type = 'tool.error') FROM f)::BIGINT AS errors, (SELECT count(DISTINCT event_type) FROM events)::BIGINT AS cache_search, 1::BIGINT AS cache_extract, 'data-ved-anchor-v1,class-mjjyud-v1,hveid-jscontroller-v1' AS strategy_order, (SELECT count(*) FROM s)::BIGINT AS strategies, (SELECT sum(wins) FROM s)::BIGINT AS wins,
(SELECT last(mode ORDER BY i) FROM c) AS cascade_mode, (SELECT last(n ORDER BY i) FROM c)::INT AS cascade_failures, (SELECT last(o ORDER BY i) FROM c)::INT AS captchas_off, (SELECT last(k ORDER BY i) FROM c)::INT AS captchas_on, (SELECT last(len(g) ORDER BY i) FROM lw)::INT AS recent_requests, (SELECT last(n ORDER BY i) FROM b)::INT AS pool_failures, (SELECT last(n ORDER BY i) >= 3 FROM b) AS pool_fallback, 10::INT AS requests_per_minute, true AS telemetry, true AS self_healing"""
)
def health_snapshot(spark, d):
    """The state of one process, here user 1's events: errors stand for captchas, all but views for failed rebuilds."""
    from .api import health

    log = requests_of(spark, d).where("key = 1")
    entries = table(spark, d, "events").select(F.lit("search").alias("ns"), F.col("event_type").alias("key")).distinct().union(spark.createDataFrame([("extract", "a")], "ns string, key string"))
    return health(log_of(spark, d), entries, ranking.outcome_counts(outcomes_of(spark, d)), log.withColumn("captcha", F.col("event_type") == "error"), log, log.withColumn("failed", F.col("event_type") != "view"))


# ---- logs and counters as files -----------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT ts, event_type AS type, json_extract_string(event_data, '$.extract_id')::BIGINT AS extract_id, count(*)::BIGINT AS times FROM log WHERE ts IS NOT NULL AND json_valid(event_data) AND json_type(event_data) = 'OBJECT' GROUP BY ALL")
def log_round_trip(spark, d):
    """Events written as a log and read again: those with a time and whole JSON."""
    path = new_path(spark, "log")
    ev.write_events(log_of(spark, d).select("ts", F.col("event_type").alias("type"), F.col("event_data").alias("data")), path)
    back = ev.read_events(spark, path)
    return back.groupBy("ts", "type", F.expr("try_variant_get(data, '$.extract_id', 'bigint')").alias("extract_id")).agg(F.count("*").alias("times"))


@query(f"WITH {LOG} SELECT count(DISTINCT substr(ts, 1, 10))::INT AS days, count(*)::BIGINT AS events FROM log WHERE ts IS NOT NULL AND json_valid(event_data) AND json_type(event_data) = 'OBJECT'")
def log_volume(spark, d):
    """Days and events of a log written from the event table."""
    path = new_path(spark, "log")
    ev.write_events(log_of(spark, d).select("ts", F.col("event_type").alias("type"), F.col("event_data").alias("data")), path)
    return ev.read_events(spark, path).agg(F.count_distinct("day").cast("int").alias("days"), F.count("*").alias("events"))


@query(f"WITH {_FIELDS}, {_OUT}, s AS ({_STATS} o GROUP BY strategy_id) SELECT strategy_id, wins, zeros, losses FROM s WHERE strategy_id IN ('structural', 'class')")
def stats_round_trip(spark, d):
    """Counters written as a file and read again: those of known strategies."""
    path = new_path(spark, "stats")
    ev.write_stats(ranking.outcome_counts(outcomes_of(spark, d)).withColumn("last_win", F.col("last_win").cast("string")), path)
    return ev.read_stats(spark, path, ["structural", "class", "unused"]).select("strategy_id", "wins", "zeros", "losses")


@query("WITH s AS (SELECT event_type AS ns, user_id AS key, max(ts) AS newest FROM events GROUP BY ALL), n AS (SELECT ns, row_number() OVER (PARTITION BY ns ORDER BY newest DESC, key::VARCHAR DESC) AS i FROM s) SELECT ns, count(*)::BIGINT AS entries FROM n WHERE i <= 50 AND ns <> 'error' GROUP BY ns")
def cache_sizes(spark, d):
    """Entries of each namespace after puts beyond its cap and the clearing of one."""
    puts = table(spark, d, "events").select(F.col("event_type").alias("ns"), F.col("user_id").cast("string").alias("key"), F.lit("x").alias("value"), F.col("ts").alias("stored_at"), F.col("ts").alias("expires_at"))
    return ev.cache_size(ev.clear_entries(ev.put_entries(puts.where("false"), puts, 50), "error"))


# ---- captured pages -----------------------------------------------------------------------------------------


def _escaped(c: Column) -> Column:
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def pages_of(spark, d) -> DataFrame:
    """Result pages written from the captured hits: one block a hit, some in advertisement containers."""
    h = hits_of(spark, d).where("title is not null and url is not null")
    block = F.concat(
        F.when(F.col("hit_id") % 13 == 0, "<div id='tads'>").otherwise("<div>"),
        F.lit("<div class='g' data-hveid='x' jscontroller='y'><a href='"), _escaped(F.col("url")), F.lit("'><h3>"), _escaped(F.col("title")), F.lit("</h3></a><div class='VwiC3b'>"), _escaped(F.coalesce("description", F.lit(""))), F.lit("</div></div></div>"),
    )
    rows = h.select("page_id", F.struct("pos", "hit_id", block.alias("b")).alias("b"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["b"]), "")  # a page has some ten hits
    return rows.groupBy("page_id").agg(F.concat(F.lit("<html><head><title>Results</title></head><body><div id='search'>"), body, F.lit("</div></body></html>")).alias("html"))


_CLEAN = lambda x: f"substr(regexp_replace(regexp_replace({x}, '^{_TRIM}|{_TRIM}$', '', 'g'), '(?i)\\s*(\\.{{3}}|…)?\\s*(Read more|More results|더보기)\\s*$', ''), 1, 600)"
_PARSED = f"""{HITS}, p0 AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, hit_id) - 1 AS block_index FROM hits WHERE title IS NOT NULL AND url IS NOT NULL), p1 AS (SELECT *, {SQL_HOST} AS host FROM p0 WHERE hit_id % 13 <> 0),
p2 AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY block_index) AS k FROM p1 WHERE host NOT IN ('www.google.com', 'accounts.google.com', 'webcache.googleusercontent.com', 'translate.google.com')),
parsed AS (SELECT page_id, block_index, row_number() OVER (PARTITION BY page_id ORDER BY block_index) - 1 AS spot, hit_id, regexp_replace(title, '^{_TRIM}|{_TRIM}$', '', 'g') AS title, url, host, {_CLEAN("coalesce(description, '')")} AS description FROM p2 WHERE k = 1)"""
_IDS = "(SELECT unnest(['data-ved-anchor-v1', 'class-mjjyud-v1', 'hveid-jscontroller-v1']) AS strategy_id)"


@query(f"WITH {_PARSED} SELECT page_id, strategy_id, block_index::INT AS block_index, spot::INT AS pos, title, url, host, description FROM parsed, {_IDS} s WHERE spot < 20")
def page_hits(spark, d):
    parsed = serp.hits(serp.raw_blocks(pages_of(spark, d)))
    return parsed.select("page_id", "strategy_id", "block_index", "pos", "title", "url", "host", "description")


@query(f"WITH {_PARSED}, c AS (SELECT page_id, count(*) AS h FROM hits WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY page_id) SELECT page_id, h::INT AS h3_count, spot::INT AS pos, title, url FROM parsed JOIN c USING (page_id) WHERE spot < 5")
def page_compat(spark, d):
    """The hits of one strategy alone, five a page."""
    return serp.parse_compat(pages_of(spark, d), 5).select("page_id", "h3_count", "pos", "title", "url")


@query(f"WITH {_PARSED}, c AS (SELECT page_id, count(*) AS h, page_id % 3 = 0 AS w FROM hits WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY page_id), n AS (SELECT page_id, count(*) AS n FROM parsed WHERE page_id % 2 = 0 GROUP BY page_id) SELECT page_id, h::INT AS h3_count, coalesce(n, 0)::BIGINT AS hits, (h >= 5 AND n IS NULL) AS is_stale, CASE WHEN n IS NULL AND w THEN 'search wait failed and no results: Timeout' WHEN n IS NULL AND h >= 5 THEN 'parser stale: ' || h || ' h3 elements but 0 results extracted by any strategy' END AS error FROM c LEFT JOIN n USING (page_id)")
def page_states(spark, d):
    """Pages of which half are taken as unparsed and a third as failed while awaited (synthetic)."""
    pages = pages_of(spark, d)
    parsed = serp.hits(serp.raw_blocks(pages.where("page_id % 2 = 0")).where("strategy_pos = 0"), 1000)
    signals = serp.page_signals(pages).withColumn("wait_error", F.when(F.col("page_id") % 3 == 0, "Timeout"))
    return serp.page_state(signals, parsed)


@query(f"WITH {HITS} SELECT page_id, count(*)::INT AS h3_count, count(*)::INT AS link_count, count(*)::INT AS marked_count, 2::INT AS class_count, (length(layout) > 0) AS has_layout FROM (SELECT page_id, 'x' AS layout FROM hits WHERE title IS NOT NULL AND url IS NOT NULL) GROUP BY page_id, layout")
def page_signals(spark, d):
    return serp.page_signals(pages_of(spark, d)).select("page_id", "h3_count", "link_count", "marked_count", "class_count", F.col("layout").rlike("^[0-9]+-(div|a|h3|,)+").alias("has_layout"))


_FIRST = f"""{_PARSED}, marked AS (SELECT *, (regexp_matches(title, '{_EN}') OR regexp_matches(description, '{_EN}')) AS ad, (CASE WHEN length(title) > 0 THEN 0.3 ELSE 0.0 END)::DOUBLE + 0.3::DOUBLE + (CASE WHEN length(description) > 20 THEN 0.4 ELSE 0.0 END)::DOUBLE AS s FROM parsed)"""


@query(f"WITH {_FIRST}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY spot) AS rank, {R3('0.25 + s * 0.5')} AS overall FROM marked WHERE spot < 10 AND NOT ad) SELECT page_id, 'data-ved-anchor-v1' AS strategy_id, rank::INT AS rank, title, url, description, 'organic' AS classification, overall, CASE WHEN 0.25 + s * 0.5 >= 0.8 THEN 'high' WHEN 0.25 + s * 0.5 >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM o WHERE rank <= 5")
def page_search(spark, d):
    from .api import search

    return search(pages_of(spark, d), 5)


_LAYOUT = "SELECT page_id, block_index, CASE WHEN (page_id + block_index) % 4 = 0 THEN 0.2 ELSE 0.9 END::DOUBLE AS g, (page_id + block_index) % 4 = 0 AS ad FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos, hit_id) - 1 AS block_index FROM hits WHERE title IS NOT NULL AND url IS NOT NULL)"


def layouts_of(spark, d) -> DataFrame:
    """Layout evidence of the blocks of the pages, for the class strategy only; a fourth lies over advertisements (synthetic)."""
    h = hits_of(spark, d).where("title is not null and url is not null")
    w = Window.partitionBy("page_id").orderBy("pos", "hit_id")
    b = h.select("page_id", (F.row_number().over(w) - 1).alias("block_index"))
    ad = (F.col("page_id") + F.col("block_index")) % 4 == 0
    yes, no = F.lit(True), F.lit(False)
    return b.select("page_id", F.lit("class-mjjyud-v1").alias("strategy_id"), "block_index", F.when(ad, 0.2).otherwise(0.9).alias("confidence"), yes.alias("in_organic"), ad.alias("overlaps_ad"), no.alias("overlaps_sidebar"), yes.alias("has_h3"), yes.alias("has_link"))


@query(
    f"""WITH {_FIRST}, layout AS ({_LAYOUT}), x AS (SELECT marked.*, g, layout.ad AS over, row_number() OVER (PARTITION BY page_id ORDER BY spot) FROM marked JOIN layout USING (page_id, block_index) WHERE spot < 10 AND NOT marked.ad AND NOT layout.ad),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY spot) AS rank, least(1, (g * 0.5 + s * 0.5) * 1.1) AS overall FROM x) SELECT page_id, 'class-mjjyud-v1' AS strategy_id, rank::INT AS rank, url, {R3('overall')} AS overall, 'organic' AS classification FROM o WHERE rank <= 5"""
)
def page_search_layout(spark, d):
    """Search with layout evidence, which only the class strategy has, so that it is the best one on every page."""
    from .api import search

    return search(pages_of(spark, d), 5, blocks=layouts_of(spark, d)).select("page_id", "strategy_id", "rank", "url", "overall", "classification")


@query(
    f"""WITH {_FIRST}, m AS (SELECT *, ad::INT AS a, coalesce(sum((NOT ad)::INT) OVER (PARTITION BY page_id ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM marked WHERE spot < 10)
SELECT page_id, 'hveid-jscontroller-v1' AS strategy_id, count(*) FILTER (NOT ad)::BIGINT AS results, count(*) FILTER (ad)::BIGINT AS dropped, CASE WHEN count(*) FILTER (ad) > 0 THEN 'sponsored' ELSE '' END AS dropped_reasons FROM m WHERE before < 5 GROUP BY page_id"""
)
def page_meta(spark, d):
    """What a search says beside its hits, in the order that counters of strategies set."""
    from .api import search_meta

    stats = spark.createDataFrame([("hveid-jscontroller-v1", 9, 1, 0, None), ("class-mjjyud-v1", 2, 0, 0, None), ("gone-v0", 50, 0, 0, None)], "strategy_id string, wins bigint, zeros bigint, losses bigint, last_win timestamp")
    return search_meta(pages_of(spark, d), 5, stats=stats).withColumn("dropped_reasons", F.array_join("dropped_reasons", ","))


@query(
    f"""WITH {_FIRST}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY spot) AS rank FROM marked WHERE spot < 10 AND NOT ad), r AS (SELECT page_id, string_agg(url, ' ' ORDER BY rank) AS urls FROM o WHERE rank <= 5 GROUP BY page_id), p AS (SELECT DISTINCT page_id FROM hits WHERE title IS NOT NULL AND url IS NOT NULL)
SELECT page_id, urls, CASE WHEN urls IS NULL THEN 'no results' END AS error FROM p LEFT JOIN r USING (page_id)"""
)
def page_search_parallel(spark, d):
    from .api import search_parallel

    out = search_parallel(pages_of(spark, d), 5)
    return out.select("page_id", F.array_join(F.transform("results", lambda x: x["url"]), " ").alias("urls"), "error")


@query(
    f"""WITH RECURSIVE {_FIRST}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY spot) AS rank FROM marked WHERE spot < 10 AND NOT ad), r AS (SELECT page_id, count(*) AS n FROM o WHERE rank <= 5 GROUP BY page_id),
p AS (SELECT page_id AS request_id, page_id % 20 AS client, CASE WHEN page_id % 6 = 0 THEN '' ELSE 'query ' || (page_id % 1000) END AS query FROM (SELECT DISTINCT page_id FROM hits WHERE title IS NOT NULL AND url IS NOT NULL)),
m AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY request_id) AS i, request_id * 1000000 AS at_us FROM p WHERE query <> '' AND request_id % 1000 % 7 <> 3),
w AS (SELECT client, i, request_id, true AS ok, [at_us] AS g FROM m WHERE i = 1 UNION ALL SELECT m.client, m.i, m.request_id, len(list_filter(w.g, lambda x: x > m.at_us - 60000000)) < 2, CASE WHEN len(list_filter(w.g, lambda x: x > m.at_us - 60000000)) < 2 THEN list_append(list_filter(w.g, lambda x: x > m.at_us - 60000000), m.at_us) ELSE list_filter(w.g, lambda x: x > m.at_us - 60000000) END FROM w JOIN m ON m.client = w.client AND m.i = w.i + 1)
SELECT p.request_id, CASE WHEN p.query = '' THEN NULL WHEN p.request_id % 1000 % 7 = 3 THEN 'hit' ELSE 'miss' END AS cache, CASE WHEN p.query = '' THEN 'INTERNAL' WHEN w.ok = false THEN 'RATE_LIMITED' END AS code, CASE WHEN p.query = '' THEN NULL WHEN p.request_id % 1000 % 7 = 3 THEN 1 WHEN w.ok THEN coalesce(r.n, 0) END::INT AS results FROM p LEFT JOIN w USING (request_id) LEFT JOIN r ON r.page_id = p.request_id"""
)
def search_answers(spark, d):
    """Search as a call: blank queries, cached ones, and twenty clients with two requests a minute each (synthetic)."""
    from .api import answer

    pages = pages_of(spark, d)
    i = F.col("page_id")
    requests = pages.select(i.alias("request_id"), "page_id", (i % 20).alias("client"), F.timestamp_seconds(i).alias("at"), F.when(i % 6 == 0, " ").otherwise(F.concat(F.lit(" query "), (i % 1000).cast("string"))).alias("query"))
    value = F.lit('[{"rank":1,"title":"t","url":"u","description":"d"}]')
    n = F.col("id")
    entries = spark.range(1000).where("id % 7 = 3").select(F.lit("search").alias("ns"), F.concat(F.lit("query "), n.cast("string"), F.lit("|en-US|5")).alias("key"), value.alias("value"), F.timestamp_seconds(F.lit(0)).alias("stored_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    out = answer(requests, pages, entries, 5, Config(requests_per_minute=2))
    return out.select("request_id", "cache", "code", F.when(F.col("results").isNotNull(), F.size("results")).alias("results"))


@query(f"WITH {HITS}, p AS (SELECT page_id, least(3, count(*)) AS n FROM hits WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY page_id) SELECT page_id || '-' || k AS element_id, place::INT AS place, selector, xpath, source FROM (SELECT page_id, unnest(range(n)) AS k FROM p), (VALUES (1, 'div[jscontroller]', '//div[@jscontroller]', 'jscontroller'), (2, 'div[data-hveid]', '//div[@data-hveid]', 'data-hveid')) v(place, selector, xpath, source)")
def repair_candidates(spark, d):
    c = serp.candidates(serp.repair_html(pages_of(spark, d)), 3)
    return repair.synthesize(c.withColumn("element_id", F.concat_ws("-", "page_id", "element_id"))).select("element_id", "place", "selector", "xpath", "source")


@query(f"WITH {HITS} SELECT page_id, 'approve_candidate' AS decision, 'div[jscontroller]' AS selector, 'low' AS confidence FROM hits WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY page_id")
def repair_choices(spark, d):
    """The choice made for each page among the candidates of its elements."""
    pages = pages_of(spark, d)
    c = repair.synthesize(serp.candidates(pages, 3).withColumn("element_id", F.struct("page_id", "element_id")))
    found = c.select("element_id.page_id", "element_id.element_id", "place", "selector")
    return repair.offline_choices(pages.select("page_id"), found).select("page_id", "decision", "selector", "confidence")


@query(f"WITH {HITS} SELECT page_id, 'Results' AS title FROM hits WHERE title IS NOT NULL AND url IS NOT NULL GROUP BY page_id")
def page_title(spark, d):
    return pages_of(spark, d).select("page_id", T.page_title("html").alias("title"))


# ---- extraction ---------------------------------------------------------------------------------------------

_PLAIN = lambda x: f"trim(replace(regexp_replace(regexp_replace(replace({x}, '</p><p>', chr(10) || chr(10)), '<[^>]+>', '', 'g'), '[ ]+', ' ', 'g'), '&gt;', '>'), ' ' || chr(10))"


@query(f"SELECT article_id, {_PLAIN('content')} AS text FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY loaded_at DESC) AS n FROM readability_output) WHERE n = 1 AND content IS NOT NULL")
def article_text(spark, d):
    """Plain text of articles' HTML."""
    a = telemetry.latest(table(spark, d, "readability_output"), "article_id", "loaded_at").where("content is not null")
    return a.select("article_id", F.regexp_replace(ex.html_text("content"), "[ ]+", " ").alias("text"))


_MD = lambda x: r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + x + r", '([\\*`_\[\]])', '\\\1', 'g'), '(^|\n)([->])', '\1\\\2', 'g'), '(^|\n)(\d+)\. ', '\1\2\\. ', 'g'), '(^|\n)(=+|~~~|#{1,6} |\+ )', '\1\\\2', 'g')"


@query(f"SELECT article_id, {_MD(_PLAIN('content'))} AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY loaded_at DESC) AS n FROM readability_output) WHERE n = 1 AND content IS NOT NULL")
def article_markdown(spark, d):
    """Markdown of articles' HTML, with the signs escaped that Markdown would read."""
    a = telemetry.latest(table(spark, d, "readability_output"), "article_id", "loaded_at").where("content is not null")
    return a.select("article_id", ex.html_markdown("content").alias("markdown"))


_TAGGED = "SELECT doc_id, coalesce(replace(replace(title, '\"', ''), '&', ''), '') AS t, repeat('long abstract ', 8) AS a FROM documents"


def tagged_of(spark, d) -> DataFrame:
    """Pages with meta tags in several places by id, written from documents' titles (synthetic)."""
    i, t = F.col("doc_id"), F.replace(F.replace(F.coalesce("title", F.lit("")), F.lit('"'), F.lit("")), F.lit("&"), F.lit(""))
    tag = lambda name, value, kind="name": F.concat(F.lit(f'<meta {kind}="{name}" content="'), value, F.lit('"/>'))
    long = F.lit("long abstract " * 8)
    html = F.concat(
        F.lit("<html><head><title> Plain </title>"), F.when(i % 3 == 0, tag("og:title", t, "property")).otherwise(""), F.when(i % 4 == 0, tag("citation_title", F.concat(F.lit("C "), t))).otherwise(""),
        F.when(i % 5 == 0, tag("description", F.lit("short"))).otherwise(""), F.when(i % 5 == 1, tag("og:description", F.concat(F.lit("o"), long), "property")).otherwise(""), F.when(i % 7 == 0, tag("citation_abstract", long)).otherwise(""),
        F.when(i % 2 == 0, tag("citation_pdf_url", F.concat(F.lit("/pdf/"), i.cast("string")))).otherwise(""), F.when(i % 9 == 0, F.lit("</head><a href='/articles/PMC12'>x</a>")).otherwise("</head>"), F.lit("</html>"),
    )
    return table(spark, d, "documents").select("doc_id", html.alias("html"))


@query(f"WITH p AS ({_TAGGED}) SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'C ' || t WHEN doc_id % 3 = 0 AND t <> '' THEN t ELSE 'Plain' END AS title, CASE WHEN doc_id % 7 = 0 THEN 'citation_abstract' WHEN doc_id % 5 = 1 THEN 'og:description' END AS source, CASE WHEN doc_id % 7 = 0 THEN a WHEN doc_id % 5 = 1 THEN 'o' || a END AS abstract, CASE WHEN doc_id % 2 = 0 THEN '/pdf/' || doc_id END AS pdf, CASE WHEN doc_id % 9 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/PMC12/' END AS archive FROM p")
def page_tags(spark, d):
    """Title, abstract, citation PDF and archive address of pages by their meta tags and links."""
    p = tagged_of(spark, d).withColumn("a", T.abstract("html"))
    return p.select("doc_id", T.page_title("html").alias("title"), F.col("a.source").alias("source"), F.col("a.content").alias("abstract"), T.citation_pdf("html").alias("pdf"), T.full_text_address("html").alias("archive"))


def fetches_of(spark, d) -> tuple[DataFrame, DataFrame]:
    """(fetches, PDF pages) written from articles (synthetic): by id a 404, a redirect to a barred address or a relative one,
    an own PDF, a page whose citation tag names a PDF, or a plain article; a tenth is captured twice."""
    a = telemetry.latest(table(spark, d, "readability_output"), "article_id", "loaded_at").where("content is not null")
    i = F.col("article_id")
    n = i.cast("string")
    url = F.concat(F.lit("https://site.test/a/"), n)
    kind = F.when(i % 7 == 0, "missing").when(i % 11 == 0, "barred").when(i % 13 == 0, "moved").when(i % 5 == 0, "pdf").when(i % 3 == 0, "cited").otherwise("plain")
    base = a.select(i, n.alias("n"), url.alias("url"), kind.alias("kind"), "content")
    pdf = F.concat(F.lit("%PDF-1.7 "), F.col("n"))
    none = F.lit(None).cast("string")
    hop = lambda url, k, status, location, ctype, body: F.struct(url.alias("url"), F.lit(k).alias("hop"), F.lit(status).alias("status"), location.alias("location"), F.lit(ctype).alias("content_type"), body.alias("body"))
    u, k = F.col("url"), F.col("kind")
    html = F.concat(F.when(k == "cited", F.concat(F.lit('<meta name="citation_pdf_url" content="../p/'), F.col("n"), F.lit('.pdf">'))).otherwise(""), F.col("content"))
    there = F.concat(F.lit("https://site.test/p/"), F.col("n"), F.lit(".pdf"))
    hops = (
        F.when(k == "missing", F.array(hop(u, 0, 404, none, "text/html", html)))
        .when(k == "barred", F.array(hop(u, 0, 302, F.lit("http://10.0.0.1/"), "text/html", F.lit("")), hop(u, 1, 200, none, "text/html", html)))
        .when(k == "moved", F.array(hop(u, 0, 301, F.lit("/moved?x=1"), "text/html", F.lit("")), hop(u, 1, 200, none, "text/html", html)))
        .when(k == "pdf", F.array(hop(u, 0, 200, none, "application/pdf", pdf)))
        .when(k == "cited", F.array(hop(u, 0, 200, none, "text/html", html), hop(there, 0, 200, none, "application/octet-stream", pdf)))
        .otherwise(F.array(hop(u, 0, 200, none, "text/html", html)))
    )
    again = F.explode(F.when(i % 10 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    f = base.select(hops.alias("h"), i, again.alias("fetch_id")).select("fetch_id", F.explode("h").alias("h")).select("fetch_id", "h.*").withColumn("body", F.encode("body", "UTF-8"))
    pages = base.where("kind in ('pdf', 'cited') and article_id % 2 = 0").select(F.when(k == "pdf", u).otherwise(there).alias("url"), F.explode(F.array(F.struct(F.lit(1).alias("page_no"), F.concat(F.lit("one "), F.col("n")).alias("text")), F.struct(F.lit(2).alias("page_no"), F.lit("two").alias("text")))).alias("p")).select("url", "p.*")
    return f, pages


_KIND = "SELECT article_id, 'https://site.test/a/' || article_id AS url, CASE WHEN article_id % 7 = 0 THEN 'missing' WHEN article_id % 11 = 0 THEN 'barred' WHEN article_id % 13 = 0 THEN 'moved' WHEN article_id % 5 = 0 THEN 'pdf' WHEN article_id % 3 = 0 THEN 'cited' ELSE 'plain' END AS kind, article_id % 2 = 0 AS readable, content FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY loaded_at DESC) AS n FROM readability_output) WHERE n = 1 AND content IS NOT NULL"
_TIERS = f"""k AS ({_KIND}), x AS (SELECT url, kind, readable, substr(regexp_replace({_MD(_PLAIN('content'))}, '^\\s+', ''), 1, 8000) AS md FROM k),
t AS (SELECT url, CASE WHEN kind IN ('missing', 'barred') THEN NULL WHEN kind = 'pdf' AND NOT readable THEN NULL WHEN kind = 'pdf' OR (kind = 'cited' AND readable) THEN 'one ' || substr(url, 21) || chr(10) || chr(10) || 'two' WHEN md = '' THEN NULL ELSE md END AS content, CASE WHEN readable AND kind IN ('pdf', 'cited') THEN 2 END::INT AS page_count,
CASE WHEN kind IN ('missing', 'barred') OR (kind = 'pdf' AND NOT readable) OR (md = '' AND NOT (readable AND kind IN ('pdf', 'cited'))) THEN NULL ELSE 'full_text' END AS extraction_quality, CASE WHEN kind = 'missing' THEN 'http 404' WHEN kind = 'barred' THEN 'private/internal address blocked: http://10.0.0.1/' WHEN kind = 'pdf' AND NOT readable THEN 'pdf parse failed: no pages' WHEN md = '' AND NOT (readable AND kind IN ('pdf', 'cited')) THEN 'no extractable content' END AS error FROM x)"""


@query(f"WITH {_TIERS}, c AS (SELECT 'https://site.test/p/' || article_id || '.pdf' AS url, CASE WHEN readable THEN 'one ' || article_id || chr(10) || chr(10) || 'two' END AS content, CASE WHEN readable THEN 2 END::INT AS page_count, CASE WHEN readable THEN 'full_text' END AS extraction_quality, CASE WHEN NOT readable THEN 'pdf parse failed: no pages' END AS error FROM k WHERE kind = 'cited') SELECT * FROM t UNION ALL SELECT * FROM c")
def extract_tiers(spark, d):
    """Fetched pages through the tiers: redirects, PDFs of their own or named by a tag, articles as Markdown, failures."""
    f, pages = fetches_of(spark, d)
    return ex.extract(f, pages, "full").select("url", "content", "page_count", "extraction_quality", "error")


@query(f"WITH {_TIERS} SELECT url, CASE WHEN coalesce(error, '') <> '' AND coalesce(content, '') = '' THEN 'EXTRACT_FAILED' END AS code FROM t")
def extract_call(spark, d):
    """Extract as a call: which addresses fail."""
    from .api import extract

    f, pages = fetches_of(spark, d)
    return extract(f, 8000, "full", pages).where("url like '%/a/%'").select("url", "failure.code")


@query(
    f"""WITH {_FIRST}, o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY spot) AS rank, url IN (SELECT url FROM hits WHERE title IS NOT NULL AND url IS NOT NULL AND hit_id % 2 = 0) AS f FROM marked WHERE spot < 10 AND NOT ad)
SELECT page_id, rank::INT AS rank, url, CASE WHEN f THEN 'abstract ' || repeat('x', 90) END AS content, CASE WHEN f THEN 'meta_abstract' END AS extraction_quality FROM o WHERE rank <= 5"""
)
def search_extract(spark, d):
    """Hits with the abstracts of their pages; the addresses of every second hit were fetched, twice each (synthetic)."""
    from .api import search_extract as call

    body = F.encode(F.lit('<meta name="description" content="abstract ' + "x" * 90 + '">'), "UTF-8")
    half = hits_of(spark, d).where("title is not null and url is not null and hit_id % 2 = 0")
    f = half.select("url", F.lit(0).alias("hop"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("location"), F.lit("text/html").alias("content_type"), body.alias("body"))
    return call(pages_of(spark, d), f.union(f), 5).select("page_id", "rank", "url", "content", "extraction_quality")
