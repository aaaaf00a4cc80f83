import pytest
from pyspark.sql import functions as F

from lodeweave.config import Config
from lodeweave.operators import extract, geometry, ranking, repair, replay, score, serp, telemetry, triage
from lodeweave.plans import api

GEO = "STRUCT<in_organic: boolean, overlaps_ad: boolean, overlaps_sidebar: boolean, has_h3: boolean, has_link: boolean, confidence: double>"


@pytest.mark.parametrize(
    "geo, kind, overall, label",
    [((True, False, False, True, True, 0.9), "organic", 1.0, "high"), ((True, True, False, True, True, 0.9), "sponsored", 0.19, "low"), ((True, False, True, True, True, 0.9), "knowledge_panel", 0.57, "medium"), (None, "organic", 0.75, "medium")],
)
def test_scores(spark, geo, kind, overall, label):
    df = spark.createDataFrame([("Title", "https://a.test", "a long enough description", geo)], f"title string, url string, description string, geo {GEO}")
    r = score.score_hits(df, geometry="geo").first()
    assert (r.classification, r.overall, r.confidence) == (kind, overall, label)


def test_rollup_and_nulls(spark):
    df = spark.createDataFrame([("a", 0.9, 0.5, "organic"), ("a", 0.5, 0.5, "organic"), ("a", 0.2, 0.5, "sponsored")], "k string, overall double, geometric double, classification string")
    r = score.rollup(df, "k").first()
    assert (r.mean_overall, r.organic_share) == (0.533, 0.667)
    none = spark.createDataFrame([(None, None, None)], "title string, url string, description string")
    assert score.score_hits(none).first().overall == 0.25
    assert score.score_hits(none.limit(0)).count() == 0


def test_drops_stop_at_the_limit(spark):
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(["organic", "sponsored", "organic", "related", "organic"])], "p int, pos int, classification string")
    r = score.drops(df, "p", 2).first()
    assert (r.dropped, r.reasons) == (1, "sponsored")
    assert [x.pos for x in score.first_hits(df, "p", 2).orderBy("pos").collect()] == [0, 2]


def test_strategy_choice_ties_and_early_exit(spark):
    df = spark.createDataFrame([(1, "a", 0, 4, 0.5), (1, "b", 1, 4, 0.5), (2, "a", 0, 5, 0.7), (2, "b", 1, 9, 0.9)], "p int, strategy_id string, strategy_pos int, hits int, confidence double")
    assert {r.p: r.strategy_id for r in score.best_strategy(df, "p").collect()} == {1: "a", 2: "a"}


def test_geometry(spark):
    b = spark.createDataFrame([(1, 0, 700.0, 200.0, 100.0, 50.0, True, True), (1, 1, 100.0, 200.0, 100.0, 50.0, True, True)], "page_id int, block_index int, x double, y double, w double, h double, has_h3 boolean, has_link boolean")
    r = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 200.0, None)], "page_id int, ad_x double, ad_y double, ad_w double, ad_h double, side_x double")
    out = {x.block_index: x for x in geometry.signals(b, r, viewport=1024).collect()}
    assert not out[0].in_organic and out[1].in_organic
    assert out[1].overlaps_ad  # touching edges overlap
    assert 0 <= out[0].confidence <= 1
    s = geometry.region_stats(geometry.signals(b, r, viewport=1024)).first()
    assert s.organic_share == 0.5


def events(spark, values):
    return spark.createDataFrame([("t", float(v), i) for i, v in enumerate(values)], "k string, v double, i int")


@pytest.mark.parametrize("p, want", [(0.5, 5.0), (0.0, 1.0), (0.99, 10.0)])
def test_percentile(spark, p, want):
    assert telemetry.nearest_rank(events(spark, [1, 5, 10]), "k", "v", p).first().percentile == want


def test_percentile_of_many_and_even(spark):
    assert telemetry.nearest_rank(events(spark, [1, 2, 3, 4]), "k", "v", 0.5).first().percentile == 3
    many = spark.range(20_000).select(F.lit("t").alias("k"), (F.col("id") * 7919 % 20_000).cast("double").alias("v"))
    assert telemetry.nearest_rank(many, "k", "v", 0.95).first().percentile == 19_000
    ties = spark.range(5_000).select(F.lit("t").alias("k"), (F.col("id") % 3).cast("double").alias("v"))
    assert telemetry.nearest_rank(ties, "k", "v", 0.5).first().percentile == 1
    assert telemetry.nearest_rank(events(spark, []), "k", "v", 0.5).count() == 0


@pytest.mark.parametrize("alpha, want", [(0.5, 6.5), (0.3, 4.54)])
def test_ewma(spark, alpha, want):
    assert telemetry.ewma(events(spark, [1, 5, 10]), "k", "v", ["i"], alpha).first().ewma == pytest.approx(want)


def test_ewma_of_many_equals_the_fold(spark):
    vs = [(i * 37 % 101) / 7 for i in range(2000)]
    e = vs[0]
    for v in vs[1:]:
        e = 0.3 * v + 0.7 * e
    assert telemetry.ewma(events(spark, vs), "k", "v", ["i"]).first().ewma == pytest.approx(e, abs=1e-9)


def test_number_field(spark):
    df = spark.createDataFrame([('{"a": 5}',), ('{"a": "5"}',), ('{"a": tr',), ('{"b": 1}',), (None,), ('{"a": 1.5e3}',)], "j string")
    assert [r.x for r in df.select(telemetry.number_field("j", "a").alias("x")).collect()] == [5.0, None, None, None, None, 1500.0]


DEFAULTS = [("alpha", 0), ("beta", 1), ("gamma", 2)]


@pytest.mark.parametrize(
    "stats, want",
    [
        ([("gamma", 2, 0, 0)], "alpha beta gamma"), ([("gamma", 3, 0, 0)], "gamma alpha beta"), ([("gamma", 5, 0, 0)], "gamma alpha beta"), ([("alpha", 4, 0, 0), ("beta", 0, 10, 0)], "alpha gamma beta"),
        ([("alpha", 0, 0, 100)], "alpha beta gamma"), ([("alpha", 5, 0, 0), ("beta", 5, 0, 0)], "alpha beta gamma"), ([], "alpha beta gamma"),
    ],
)
def test_strategy_order(spark, stats, want):
    d = spark.createDataFrame(DEFAULTS, "strategy_id string, idx int")
    s = spark.createDataFrame([(*x, None) for x in stats], "strategy_id string, wins bigint, zeros bigint, losses bigint, last_win timestamp")
    assert " ".join(r.strategy_id for r in ranking.strategy_order(d, s).orderBy("place").collect()) == want


@pytest.mark.parametrize(
    "args, want",
    [
        (("x/sorry/y", 200, 100, 0, 0, None, None), "blocked"), (("x", 429, 100, 0, 0, None, None), "rate_limited"), (("x", 503, 100, 0, 0, None, None), "network_error"), (("x", 200, 100, 0, 8, None, None), "selector_broken"),
        (("x", 200, 100, 0, 3, 0.1, 3), "selector_broken"), (("x", 200, 18_000, 1, 0, None, None), "rate_limited"), (("x", 200, 100, 10, 0, 0.9, None), "unknown"),
    ],
)
def test_faults(spark, args, want):
    df = spark.createDataFrame([args], "u string, s int, ms int, n int, h int, g double, z int")
    assert df.select(triage.fault(*(F.col(c) for c in "u s ms n h g z".split())).alias("x")).first().x == want


def test_error_codes(spark):
    df = spark.createDataFrame([("Timeout 5",), ("got 429",), ("private/internal address blocked",), ("7 h3 but 0 results",), ("resolved to private address",), (None,)], "m string")
    assert [r.e and r.e.code for r in df.select(triage.error_info(F.col("m")).alias("e")).collect()] == ["NAV_TIMEOUT", "RATE_LIMITED", "PRIVATE_ADDRESS", "PARSER_STALE", "INTERNAL", None]
    for cloud, own, want in ((True, None, "CAPTCHA_REQUIRED"), (False, None, "CAPTCHA_RECOVER_FAIL"), (False, "do this", "CAPTCHA_RECOVER_FAIL")):
        e = spark.range(1).select(triage.error_info(F.lit("captcha timeout"), True, cloud, F.lit(own)).alias("e")).first().e
        assert e.code == want and not e.retryable and e.user_action == (own or triage.ADVICE[want])
    long = spark.range(1).select(triage.error_info(F.lit("x" * 900)).alias("e")).first().e
    assert len(long.message) == 500
    assert [r.k for r in spark.createDataFrame([("INTERNAL",), ("OTHER",), (None,)], "c string").select(triage.is_error_code(F.col("c")).alias("k")).collect()] == [True, False, None]
    r = spark.range(1).select(triage.response(F.lit("d"), triage.error_info(F.lit("Timeout")), F.lit("m")).alias("r")).first().r
    assert r.is_error and r.text == "Error [NAV_TIMEOUT]: Timeout\nRetry after: 1000ms"
    assert df.select(triage.h3_in_message(F.col("m")).alias("n")).collect()[3].n == 7


@pytest.mark.parametrize("passed, total, want", [(3, 3, "apply"), (2, 3, "caution_flag"), (1, 3, "escalate"), (2, 2, "caution_flag")])
def test_verdict(spark, passed, total, want):
    assert spark.range(1).select(repair.verdict(F.lit(passed), F.lit(total)).alias("v")).first().v == want


def test_synthesis(spark):
    rows = [("a", "div", {"class": "ab longest Wide7"}, []), ("b", "div", {}, [{"data-hveid": "1"}, {"data-ved": "2"}]), ("c", "p", {}, [])]
    df = spark.createDataFrame(rows, "element_id string, tag string, attributes map<string,string>, ancestors array<map<string,string>>")
    out = [(r.element_id, r.selector) for r in repair.synthesize(df).orderBy("element_id", "place").collect()]
    assert out == [("a", "div.longest"), ("b", "[data-ved]"), ("b", "div[data-hveid]")]


def test_replays(spark):
    req = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 20, 100, 105])], "key bigint, at_us bigint, request_id bigint")
    got = {r.request_id: r.granted for r in replay.admissions(req, 2, 100).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False}
    q = {r.request_id: r.start_us for r in replay.queued_admissions(req, 2, 100, 90).collect()}
    assert q == {0: 0, 1: 10, 2: 100, 3: 110, 4: None}
    assert [r.hit for r in replay.cache_replay(req, 20).orderBy("request_id").collect()] == [False, True, True, False, True]
    assert not any(r.hit for r in replay.cache_replay(req, 0).collect())
    ev = req.withColumn("captcha", F.col("request_id") != 3)
    # a success keeps the count, and the third tier leaves the mode on
    assert [(r.mode, r.failures, r.off, r.on, r.step) for r in replay.cascade_replay(ev).orderBy("request_id").collect()] == [("on", 0, 1, 0, "on"), ("on", 1, 1, 1, "retry"), ("on", 0, 1, 2, "tier3"), ("on", 0, 1, 2, None), ("on", 1, 1, 3, "retry")]
    a = {r.request_id: (r.recent, r.retry_after_us) for r in replay.admissions(req, 2, 100).collect()}
    assert a == {0: (1, 0), 1: (2, 5_090), 2: (2, 5_080), 3: (2, 5_010), 4: (2, 5_005)}
    names = req.select(F.lit("h").alias("key"), "at_us", "request_id", F.when(F.col("request_id") > 0, F.col("request_id").cast("string")).alias("address"))
    assert [(r.address, r.asked) for r in replay.name_lookups(names, 90).orderBy("request_id").collect()] == [(None, True), ("1", True), ("1", False), ("3", True), ("3", False)]
    b = replay.failure_budget(req.withColumn("failed", F.col("request_id") != 0), 3).orderBy("request_id").collect()
    assert [(r.failures, r.given_up) for r in b] == [(0, False), (1, False), (2, False), (3, True), (3, True)]
    assert replay.admissions(req.limit(0), 2, 100).count() == 0


def test_backoff(spark):
    assert [r.delay_ms for r in replay.backoff_schedule(spark, 100, 2.0, 4).orderBy("attempt").collect()] == [100, 200, 400]


PAGE = """<html><body><div id="tads"><div class="g"><a href="https://ad.test"><h3>Ad</h3></a></div></div><div id="search">
<div class="g" data-hveid="1" jscontroller="x"><a href="https://one.test/a"><h3> One </h3></a><div class="VwiC3b">First … Read more</div></div>
<div class="g"><a href="https://two.test/a"><h3>Two</h3></a></div><div class="g"><a href="https://one.test/a"><h3>Again</h3></a></div>
<div class="g"><a href="https://www.google.com/x"><h3>Own</h3></a></div><div class="g"><a href="https://sub.google.com/x"><h3>Sub</h3></a></div><div class="g"><h3>No link</h3></div></div></body></html>"""


def test_page_parsing(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<html></html>"), (3, None)], "page_id bigint, html string")
    hits = serp.hits(serp.raw_blocks(pages)).where("strategy_id = 'class-mjjyud-v1'").orderBy("pos").collect()
    assert [(r.title, r.description) for r in hits] == [("One", "First"), ("Two", ""), ("Sub", "")]
    s = {r.page_id: r for r in serp.page_signals(pages).collect()}
    assert s[1].h3_count == 7 and s[2].h3_count == 0 and s[3].layout == "0-|"
    state = {r.page_id: r.is_stale for r in serp.page_state(serp.page_signals(pages), serp.hits(serp.raw_blocks(pages))).collect()}
    assert state == {1: False, 2: False, 3: False}
    found = api.search(pages, 2).orderBy("rank").collect()
    assert [r.title for r in found] == ["One", "Two"]
    both = {r.page_id: r.error for r in api.search_parallel(pages, 2).collect()}
    assert both == {1: None, 2: "no results", 3: "no results"}
    c = serp.candidates(pages, 2).collect()
    assert len(c) == 2 and c[0].has_link


def test_extract_tiers(spark):
    rows = [
        ("https://a.test/", 0, 200, "text/html", None, b"<title>A</title><main>Body text</main>"),
        ("https://b.test/", 0, 200, "text/html", "http://10.0.0.1/", b""), ("https://b.test/", 1, 200, "text/html", None, b"<p>x"),
        ("https://c.test/", 0, 404, "text/html", None, b""),
        ("https://d.test/", 0, 200, None, None, b"%PDF-1.7"),
        ("http://localhost/", 0, 200, "text/html", None, b"x"),
        ("https://e.test/", 0, 200, "text/html", None, b"<script>1</script>"),
    ]
    f = spark.createDataFrame(rows, "url string, hop int, status int, content_type string, location string, body binary")
    pdf = spark.createDataFrame([("https://d.test/", 1, "one"), ("https://d.test/", 2, "two")], "url string, page_no int, text string")
    out = {r.url: r for r in extract.extract(f, pdf).collect()}
    assert out["https://a.test/"].content == "Body text" and out["https://a.test/"].title == "A"
    assert out["https://b.test/"].error == "private/internal address blocked: http://10.0.0.1/"
    assert out["https://c.test/"].error == "http 404"
    assert out["https://d.test/"].content == "one\n\ntwo" and out["https://d.test/"].page_count == 2
    assert out["http://localhost/"].error == "private/internal address blocked"
    assert out["https://e.test/"].error == "no extractable content"
    assert {r.extraction_quality for r in api.extract(f, mode="metadata").collect()} <= {"metadata_only", None}
    with pytest.raises(ValueError):
        api.extract(f, mode="other")


def test_one_row_an_address_and_relative_redirects(spark):
    rows = [
        (1, "https://a.test/x/1", 0, 302, "text/html", "/y", b""), (1, "https://a.test/x/1", 1, 302, "text/html", "z?q=1", b""), (1, "https://a.test/x/1", 2, 200, "text/html", None, b"<p>old</p>"),
        (2, "https://a.test/x/1", 0, 200, "text/html", None, b"<p>new</p>"), (2, "https://a.test/x/1", 0, 200, "text/html", None, b"<p>new</p>"),
        *((1, "https://b.test/", k, 302, None, "/" + "r" * k, b"") for k in range(7)), (1, "https://c.test/", 0, 302, None, "//10.0.0.1/", b""), (1, "https://c.test/", 1, 200, None, None, b"x"), (1, None, 0, 200, None, None, b"x"),
    ]
    f = spark.createDataFrame(rows, "fetch_id int, url string, hop int, status int, content_type string, location string, body binary")
    got = {r.url: r for r in extract.landed(f).collect()}
    assert set(got) == {"https://a.test/x/1", "https://b.test/", "https://c.test/"} and bytes(got["https://a.test/x/1"].body) == b"<p>new</p>"
    assert got["https://b.test/"].error == "too many redirects" and got["https://c.test/"].error == "private/internal address blocked: https://10.0.0.1/"
    old = extract.landed(f.where("fetch_id = 1")).where("url = 'https://a.test/x/1'").first()
    assert (old.landed, old.error, bytes(old.body)) == ("https://a.test/z?q=1", None, b"<p>old</p>")
    assert extract.extract(f.limit(0)).count() == 0


def test_candidates_for_pdfs(spark):
    page = b'<title>T</title><meta name="citation_pdf_url" content="../p.pdf"><p>text</p>'
    rows = [
        ("https://a.test/x/", "text/html", page), ("https://a.test/p.pdf", "text/html", b"%PDF"),
        ("https://openreview.net/forum?id=7", "text/html", b"<p>o</p>"), ("https://openreview.net/pdf?id=7", None, b"%PDF"),
        ("https://i.test/", "text/html", b"<a href='/articles/PMC12'>x</a>"), ("https://pmc.ncbi.nlm.nih.gov/articles/PMC12/", "text/html", b'<meta name="citation_pdf_url" content="m.pdf">m'), ("https://pmc.ncbi.nlm.nih.gov/articles/PMC12/m.pdf", None, b"%PDF"),
        ("https://n.test/", "text/html", b'<meta name="citation_pdf_url" content="http://10.0.0.1/p.pdf"><p>n</p>'), ("http://10.0.0.1/p.pdf", None, b"%PDF"),
    ]
    f = spark.createDataFrame([(u, 0, 200, c, None, b) for u, c, b in rows], "url string, hop int, status int, content_type string, location string, body binary")
    pdf = spark.createDataFrame([(u, 1, u[-5:]) for u, _, b in rows if b == b"%PDF"], "url string, page_no int, text string")
    out = {r.url: r for r in extract.extract(f, pdf).collect()}
    assert [out[u].content for u in ("https://a.test/x/", "https://openreview.net/forum?id=7", "https://i.test/")] == ["p.pdf", "?id=7", "m.pdf"]
    assert out["https://a.test/x/"].title == "T" and out["https://n.test/"].content == "n"
    fenced = {r.url: r for r in extract.extract(f, pdf, fenced=True).collect()}
    assert fenced["https://n.test/"].content == "\n--- BEGIN UNTRUSTED CONTENT ---\nn\n--- END UNTRUSTED CONTENT ---\n"


def test_fault_text_and_captcha_modes(spark):
    df = spark.createDataFrame([("selector_broken", 0, 8, 200, 0.3), ("network_error", 0, 0, 503, None)], "k string, n int, h int, s int, g double")
    assert [r.d for r in df.select(triage.describe(*(F.col(c) for c in "k n h s g".split())).alias("d")).collect()] == ["type=selector_broken results=0 h3=8 geom=0.30", "type=network_error results=0 h3=0 status=503"]
    modes = [(True, False, True, "cloud_fail_fast"), (False, True, True, "remote_debug"), (False, False, False, "always_headed"), (False, True, False, "notify_spawn")]
    df = spark.createDataFrame(modes, "c boolean, h boolean, r boolean, want string")
    assert all(r.m == r.want for r in df.select("want", triage.captcha_mode(F.col("c"), F.col("h"), F.col("r")).alias("m")).collect())


def test_plans(spark):
    """A bounded group limit before the sort, narrow keys before wide rows, pages parsed once."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    e = spark.createDataFrame([("a", 1.0, 1, 1)], "g string, v double, t int, i int")
    assert "WindowGroupLimit" in plan(telemetry.ewma(e, "g", "v", ["t", "i"]))
    pages = spark.createDataFrame([(1, PAGE)], "page_id bigint, html string")
    found = plan(api.search(pages, 2))
    assert found.count("MapInArrow") <= 2 and found.count("Exchange") <= 2 or "AdaptiveSparkPlan" in found and found.count("MapInArrow") == 1
    wide = telemetry.latest(spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, t int, x string"), "k", "t")
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 2, "y"), (2, 1, "z")]


def test_resolve():
    assert serp.resolve("https://a.test/x/", "../p.pdf") == "https://a.test/p.pdf"
    assert serp.resolve(None, "p") is None and serp.resolve("https://a.test", None) is None


def test_config():
    c = Config.load({"LODEWEAVE_REQUESTS_PER_MINUTE": "9999", "LODEWEAVE_EXTRACT_CHARS": "x", "LODEWEAVE_ALLOW_PRIVATE": "TRUE"})
    assert (c.requests_per_minute, c.extract_chars, c.allow_private) == (600, 8000, True)
    assert Config.load({}) == Config()
