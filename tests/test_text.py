import pytest
from pyspark.sql import functions as F

from lodeweave.functions import text as T
from lodeweave.functions.dom import Selector, main_text, markdown, parse


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "url, reason",
    [
        ("http://172.15.0.1/", None),
        ("http://172.32.0.1/", None),
        ("http://172.16.0.1/", "private/internal address blocked"),
        ("http://172.31.9.9/", "private/internal address blocked"),
        ("http://10.1.2.3/", "private/internal address blocked"),
        ("http://192.168.0.1/", "private/internal address blocked"),
        ("http://169.254.1.1/", "private/internal address blocked"),
        ("http://0.0.0.0/", "private/internal address blocked"),
        ("http://[::1]/", "private/internal address blocked"),
        ("http://[fc00::1]/", "private/internal address blocked"),
        ("http://[fe80::1]/", "private/internal address blocked"),
        ("https://fcexample.test/", None),
        ("https://10.example.test/", None),
        ("ftp://a.test/", "unsupported protocol: ftp:"),
        ("nothing", "invalid url"),
        (None, "invalid url"),
    ],
)
def test_url_guard(spark, url, reason):
    assert one(spark, T.url_guard("u"), u=url) == reason
    if url and url.startswith("http://10.1"):
        assert one(spark, T.url_guard("u", allow_private=True), u=url) is None


@pytest.mark.parametrize(
    "locale, text, marked",
    [
        ("en-US", "Sponsored result", True), ("en-US", "Ads · shop", True), ("en-US", "buy ads", True), ("en-US", "Google Ads API docs", False), ("en-US", "roads", False), ("en-US", "an ADVERTISEMENT here", True),
        ("ko-KR", "광고 상품", True), ("ja-JP", "スポンサー", True), ("fr-FR", "SPONSORISÉ", True), ("de-DE", "Anzeige", True), ("es-ES", "patrocinado", True), ("zh-CN", "廣告", True), ("pt-BR", "ANÚNCIO", True), ("xx", "sponsored", True), ("fr-FR", "sponsored", False),
    ],
)
def test_ad_markers(spark, locale, text, marked):
    assert one(spark, T.ad_marked("t", "l"), t=text, l=locale) is marked


def test_entities_decode_in_order(spark):
    assert one(spark, T.decode_entities("s"), s="&amp;lt; &quot;a&#39;&nbsp;") == "< \"a' "


def test_meta_prefers_citation_and_keeps_apostrophes(spark):
    html = """<META content="It's 1" name="citation_title"><meta property='og:title' content='B'><title>C</title>"""
    assert one(spark, T.page_title("h"), h=html) == "It's 1"
    assert one(spark, T.page_title("h"), h="<title> x &amp; y </title>") == "x & y"
    assert one(spark, T.page_title("h"), h="<p>") is None
    long = "a" * 80
    html = f"<meta name='description' content='{long}'><meta name='citation_abstract' content='short'>"
    assert tuple(one(spark, T.abstract("h"), h=html)) == ("description", long)


def test_pdf_address(spark):
    f = lambda u: one(spark, T.pdf_address("u"), u=u)
    assert f("https://openreview.net/forum?id=abc&x=1") == "https://openreview.net/pdf?id=abc"
    assert f("https://www.biorxiv.org/content/10.1/v1/?q") == "https://www.biorxiv.org/content/10.1/v1.full.pdf"
    assert f("https://www.nature.com/articles/s1") == "https://www.nature.com/articles/s1.pdf"
    assert f("https://www.nature.com/articles/s1.pdf") is None
    assert f("https://a.test/forum?id=1") is None and f(None) is None
    assert one(spark, T.full_text_address("h"), h="<a href='/articles/PMC123/'>") == "https://pmc.ncbi.nlm.nih.gov/articles/PMC123/"


def test_trim_round_and_snippet(spark):
    assert one(spark, T.jtrim("s"), s="  \t a\n ") == "a"
    assert one(spark, T.clean_snippet("s"), s="Text … Read more ") == "Text"
    assert one(spark, T.clean_snippet("s"), s="x" * 700) == "x" * 600
    assert spark.range(1).select(T.r3(F.lit(0.5335)).alias("x")).first().x == 0.534


def test_pdf_magic(spark):
    df = spark.createDataFrame([(b"%PDF-1", None), (b"<html", "application/PDF; x"), (b"", None), (None, None)], "b binary, c string")
    assert [r.x for r in df.select(T.is_pdf("b", "c").alias("x")).collect()] == [True, True, False, False]


def test_dom_survives_broken_pages():
    root = parse("<div class='g x'><p>a<p>b<h3>T</h3><a href='http://x.test'>l</a></div></div><b>")
    assert [n.tag for n in Selector("div.g h3, [href^='http']").all(root)] == ["h3", "a"]
    assert Selector('[class*="G" i]').first(root).tag == "div"
    assert parse(None).children == [] and main_text(None) == ""


def test_main_text_and_markdown():
    html = "<html><body><nav>Menu</nav><main><h1>T</h1><p>a <b>b</b> <a href='u'>l</a></p><ul><li>x</li><li>y</li></ul><pre>c d</pre></main><footer>F</footer></body></html>"
    assert main_text(html).split("\n") == ["T", "", "a b l", "", "x", "", "y", "", "c d"] or "Menu" not in main_text(html)
    assert markdown(html.replace("<nav>Menu</nav>", "")).startswith("# T\n\na **b** [l](u)\n\n-   x\n-   y\n\n```\nc d\n```")
