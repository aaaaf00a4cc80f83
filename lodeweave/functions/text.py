"""Column helpers: trimming, rounding, hosts, clipping, markers, meta tags and URL rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPACE = "[\\s\\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
HOST = "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)"

# Advertisement markers by language.  Word edges are spelled out, as only ASCII letters count there.
AD_MARKERS = {
    "en": r"(^|[^A-Za-z0-9_])(sponsored|advertisement)($|[^A-Za-z0-9_])|(^|\s)ads?(\s*[·•‧▾\-—]|\s*$)",
    "ko": "광고|스폰서",
    "ja": "広告|スポンサー",
    "fr": "sponsorisé|annonce",
    "de": "anzeige|gesponsert",
    "es": "anuncio|patrocinado",
    "zh": "广告|赞助|廣告",
    "pt": "patrocinado|anúncio",
}
# Sources of an abstract, best first, as (attribute, value).
ABSTRACT_SOURCES = (("name", "citation_abstract"), ("name", "dc.description"), ("name", "description"), ("property", "og:description"))
# Fixed value: the ending of cut snippets.
READ_MORE = r"(?iu)\s*(?:\.{3}|…)?\s*(?:Read more|More results|더보기)\s*$"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def jtrim(x: Column | str) -> Column:
    """Trim every kind of white space at both ends."""
    return F.regexp_replace(col(x), f"^{_SPACE}+|{_SPACE}+$", "")


def r3(x: Column) -> Column:
    """Round half up to three places, by the same arithmetic in every engine."""
    return F.floor(x * 1000 + 0.5) / 1000


def mean3(x: Column) -> Column:
    """Aggregate: mean, to three places, of values that have three places; summed as integers, so in any order."""
    return F.floor(F.sum(F.round(x * 1000)) / F.count(x) + 0.5) / 1000


def host(url: Column | str) -> Column:
    """Lower-case host name; NULL if the URL has none."""
    return F.lower(F.nullif(F.regexp_extract(col(url), HOST, 2), F.lit("")))


def clip(x: Column | str, n: int) -> Column:
    return F.substring(col(x), 1, n)


def clean_snippet(x: Column | str) -> Column:
    """A snippet without its trailing "read more", 600 characters at most."""
    return clip(F.regexp_replace(jtrim(x), READ_MORE, ""), 600)


def decode_entities(x: Column | str) -> Column:
    out = col(x)
    for name, ch in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def ad_marked(text: Column | str, locale: Column | str) -> Column:
    """Whether text holds the advertisement marker of the locale's language; English if it has none."""
    lang, out = F.lower(F.split_part(col(locale), F.lit("-"), F.lit(1))), None
    for name, pattern in AD_MARKERS.items():
        hit = col(text).rlike(f"(?iu){pattern}")
        if name != "en":
            out = F.when(lang == name, hit) if out is None else out.when(lang == name, hit)
    return out.otherwise(col(text).rlike(f"(?iu){AD_MARKERS['en']}"))


def meta_content(html: Column | str, attr: str, value: str) -> Column:
    """Content of the first meta tag with attr=value that has any; quotes of the other kind may stand inside."""
    tags = F.regexp_extract_all(col(html), F.lit(r"(?is)<meta\s+([^>]+?)\s*/?>"), F.lit(1))
    esc = value.replace(".", r"\.")
    fits = F.filter(tags, lambda t: t.rlike(rf"(?iu)(^|\s){attr}\s*=\s*[\"']{esc}[\"']") & t.rlike(r"(?i)(^|\s)content\s*=\s*(\"[^\"]*\"|'[^']*')"))
    found = F.get(fits, F.lit(0))
    double = F.regexp_extract(found, r'(?is)(?:^|\s)content\s*=\s*"([^"]*)"', 1)
    single = F.regexp_extract(found, r"(?is)(?:^|\s)content\s*=\s*'([^']*)'", 1)
    return F.nullif(F.when(double != "", double).otherwise(single), F.lit(""))


def page_title(html: Column | str) -> Column:
    tag = F.nullif(jtrim(F.regexp_extract(col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
    return decode_entities(F.coalesce(meta_content(html, "name", "citation_title"), meta_content(html, "property", "og:title"), tag))


def abstract(html: Column | str, least: int = 80) -> Column:
    """STRUCT<source, content> of the best abstract long enough; NULL if there is none."""
    tries = []
    for attr, value in ABSTRACT_SOURCES:
        v = meta_content(html, attr, value)
        tries.append(F.when(F.length(jtrim(v)) >= least, F.struct(F.lit(value).alias("source"), v.alias("content"))))
    return F.coalesce(*tries)


def citation_pdf(html: Column | str) -> Column:
    """Address of the PDF that a page's meta tags name, as written there; NULL if there is none."""
    return meta_content(html, "name", "citation_pdf_url")


def pdf_address(url: Column | str) -> Column:
    """Address of the PDF behind an article page of three kinds of sites; NULL for other pages."""
    u = col(url)
    h = host(u)
    path = F.regexp_extract(u, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    origin = F.regexp_extract(u, r"^([a-zA-Z]+://[^/?#]+)", 1)
    ident = F.nullif(F.regexp_extract(u, r"[?&]id=([^&#]*)", 1), F.lit(""))
    bare = F.regexp_replace(path, "/$", "")
    return (
        F.when((h == "openreview.net") & path.isin("/forum", "/forum/") & ident.isNotNull(), F.concat(F.lit("https://openreview.net/pdf?id="), ident))
        .when(h.rlike("(biorxiv|medrxiv)[.]org$") & path.startswith("/content/") & ~path.endswith(".pdf"), F.concat(origin, bare, F.lit(".full.pdf")))
        .when(h.isin("www.nature.com", "nature.com") & path.startswith("/articles/") & ~path.endswith(".pdf"), F.concat(origin, bare, F.lit(".pdf")))
    )


def full_text_address(html: Column | str) -> Column:
    """Address of the archive's full text that an index page links to."""
    n = F.nullif(F.regexp_extract(col(html), r"/articles/PMC(\d+)", 1), F.lit(""))
    return F.concat(F.lit("https://pmc.ncbi.nlm.nih.gov/articles/PMC"), n, F.lit("/"))


# Address ranges that must not be fetched.
PRIVATE = r"^(localhost|0[.]0[.]0[.]0|127[.]\d+[.]\d+[.]\d+|10[.]\d+[.]\d+[.]\d+|0[.]\d+[.]\d+[.]\d+|169[.]254[.]\d+[.]\d+|192[.]168[.]\d+[.]\d+|172[.](1[6-9]|2\d|3[01])[.]\d+[.]\d+)$"
PRIVATE_V6 = r"(?i)^https?://\[(::1\]|f[cd][0-9a-f]{2}:|fe80:)"


def url_guard(url: Column | str, allow_private: bool = False) -> Column:
    """NULL if the address may be fetched, else the reason.  Names that begin like a range are allowed."""
    u = col(url)
    scheme = F.lower(F.nullif(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1), F.lit("")))
    out = F.when(u.isNull() | scheme.isNull() | (scheme.isin("http", "https") & host(u).isNull()), "invalid url").when(~scheme.isin("http", "https"), F.concat(F.lit("unsupported protocol: "), scheme, F.lit(":")))
    if not allow_private:
        out = out.when(host(u).rlike(PRIVATE) | u.rlike(PRIVATE_V6), "private/internal address blocked")
    return out


# The lines around untrusted text.
FENCE = ("--- BEGIN UNTRUSTED CONTENT ---", "--- END UNTRUSTED CONTENT ---")


def fence(x: Column | str) -> Column:
    """Untrusted text between marker lines."""
    return F.concat(F.lit(f"\n{FENCE[0]}\n"), col(x), F.lit(f"\n{FENCE[1]}\n"))


def is_pdf(body: Column | str, content_type: Column | str) -> Column:
    magic = F.coalesce(F.substring(col(body), 1, 4) == F.lit(b"%PDF"), F.lit(False))
    return magic | F.coalesce(F.lower(col(content_type)).contains("application/pdf"), F.lit(False))
