"""Template residue and error pages.

A linear word model (see notices) scores every text, of any length.  Those that do not clearly read like ordinary
text are masked, pre-aggregated and mined for templates with a fixed-depth prefix tree: first by number of tokens,
then by the leading tokens, then by the nearest template in the leaf.  Leaves are salted, so that none is mined in one
task, and the templates of the salts are merged by leaf.  Each template is classified once, by a model of its words,
support, spread over sites and form, and its verdict goes back to all its messages.
Ordinary records are searched separately for slots that were never filled, filler passages and printed empty
values; text quoted as code is left out of that search.

Defined cases: null and blank values give no finding; a repeated row gives its id once; texts of any length are
read whole; without a column url a template's spread counts as one site.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import notices
from .common import map_batches, stored

DEPTH = 3  # leading tokens that the prefix tree looks at
SIMILARITY = 0.5  # share of equal tokens that joins a message to a template
SALTS = 16  # parts of each leaf, so that no leaf is mined in one task
MAX_ROWS = 600  # records whose sentences train the word model, taken by the hash of their id
MAX_TEMPLATES = 5000  # templates that train the template model, taken by the hash of their text

# Forms in which templating systems write a slot.
_NAME = r"[A-Za-z_][\w.\-]*(?:\s[A-Za-z_][\w.\-]*){0,3}"
SLOT = re.compile(
    r"\{\{[^{}\n]+\}\}|\$\{[^{}\n]+\}|\{%[^%\n]+%\}|<%[^%\n]+%>|#\{[^{}\n]+\}"
    rf"|__[A-Z][A-Za-z0-9_.]*__|%%{_NAME}%%|@@{_NAME}@@|\[\[{_NAME}\]\]"
    r"|\[(?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|ADD|Add)\s[^\]\n]+\]"
    r"|(?<![\w{$#\\])\{[A-Za-z_][\w.]{2,}\}|(?<![\w{$#\\])\{[A-Z_]+(?:\s[A-Z_]+){0,3}\}|<[A-Z][A-Z_.]{2,}(?:\s[A-Z_.]{2,}){0,3}>"
    r"|(?<![\w%])%[A-Z][A-Z_]{2,}%(?!\w)"
)
_SLOT_MARK = re.compile(r"[{%@\[<_]")
CODE = re.compile(r"```.*?```|`[^`\n]*`|<(code|pre|kbd|samp)\b[^>]*>.*?</\1>", re.S | re.I)

# The words of placeholder Latin and of placeholder Korean.
LATIN = frozenset(
    "a ac adipiscing aliqua aliquam aliquet aliquip amet anim ante arcu at auctor aute bibendum blandit cillum commodo condimentum congue "
    "consectetur consequat convallis cras culpa cupidatat curabitur cursus dapibus deserunt diam dictum dignissim do dolor dolore donec duis ea "
    "efficitur egestas eget eiusmod eleifend elementum elit enim erat eros esse est et eu euismod ex excepteur exercitation facilisis fames "
    "faucibus felis fermentum feugiat fringilla fugiat fusce gravida habitant hendrerit iaculis id imperdiet in incididunt integer interdum ipsum "
    "irure justo labore laboris laborum lacinia lacus laoreet lectus leo libero ligula lobortis lorem luctus maecenas magna malesuada massa "
    "mattis mauris maximus metus mi minim molestie mollis mollit morbi nam nec neque netus nibh nisi nisl non nostrud nulla nullam nunc occaecat "
    "odio officia orci ornare pariatur pellentesque pharetra phasellus placerat porta porttitor posuere praesent pretium proident pulvinar purus "
    "quam qui quis reprehenderit rhoncus risus rutrum sagittis sapien scelerisque sed sem semper senectus sint sit sodales sollicitudin sunt "
    "suscipit suspendisse tellus tempor tempus tincidunt tortor tristique turpis ullamco ullamcorper ultrices ultricies urna ut varius vehicula "
    "vel velit venenatis veniam vestibulum vitae vivamus viverra voluptate volutpat vulputate".split()
)
# Latin words that are also words of living languages say little by themselves.
_WEAK_LATIN = frozenset("a ac at do ea et eu ex id in leo mi nam non quam qui sed sem sit ut vel est dolor culpa nulla porta massa magna".split())
_STRONG_LATIN = LATIN - _WEAK_LATIN
KOREAN_FILLER = frozenset("이 글은 본문 본문이 내용이 내용을 들어갈 자리 자리를 자리입니다 텍스트 텍스트를 예시 예시입니다 임시 채우기 위한 여기에 입력하세요 실제 문장입니다 문장을 더미 샘플".split())
EMPTY_VALUE = re.compile(r"\[object Object\]|(?<![\w.])(?:undefined|NaN|null|Invalid Date)(?![\w.(])")
PROMPT = re.compile(
    r"lorem ipsum dolor sit amet|\bthis is (?:a|an) (?:sample|example|placeholder|dummy) (?:page|post|text|paragraph)\b|\breplace this text\b|\bplaceholder (?:copy|text|content) (?:for|goes|here)"
    r"|\bTODO:? (?:add|write|insert|replace|fill)\b|\b(?:your|page|body) (?:text|content|copy) goes here\b|\bclick (?:here )?to (?:edit|add) (?:this )?text\b|\bsample text (?:here|for)\b"
    r"|(?:임시|예시|샘플|더미) (?:텍스트|본문)입니다|여기에 (?:내용|본문|텍스트)[을를] 입력|hier steht (?:ihr|dein) text|texte d.exemple à remplacer|texto de (?:ejemplo|muestra) para reemplazar|ダミーテキスト|ここに(?:本文|テキスト)",
    re.I,
)
# Every form of PROMPT holds one of these; looking for them first is cheaper.
_PROMPT_KEYS = ("lorem ipsum", "sample", "example page", "example text", "example post", "example paragraph", "placeholder", "dummy", "todo", "goes here", "replace this", "click", "임시", "예시", "샘플", "더미", "여기에", "hier steht", "à remplacer", "para reemplazar", "ダミー", "ここに")
_EMPTY_KEYS = ("undefined", "NaN", "null", "[object", "Invalid Date")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")

# The extractor's own short errors, when filled in.
OWN_ERROR = re.compile(
    r"(?:http \d{3}|net::[A-Z][A-Z0-9_]+|(?:page\.goto: )?timeout.{0,40}|(?:page\.goto: )?Timeout \d+ ?ms exceeded\.?|timed? ?out.{0,40}|invalid url|blocked url|bad url|too many redirects"
    r"|unsupported protocol: \S{1,20}|(?:private|internal|private/internal) address blocked(?: \(redirected\))?|resolved to private address|no extractable content|no content"
    r"|pdf parse failed: .{1,80}|(?:fetch|request|navigation|extract(?:ion)?) failed|empty (?:body|response))\s*",
    re.I,
)

_NUM, _HEX, _HOST = re.compile(r"\d+(?:[.,]\d+)*"), re.compile(r"\b(?=[0-9a-f.]*\d)(?=[0-9a-f.]*[a-f])[0-9a-f]{4,}(?:\.[0-9a-f]{4,})*\b", re.I), re.compile(r"\b(?:[\w-]+\.)+[a-z]{2,12}\b")
WILD = "<*>"


def mask(text: str) -> str:
    """The message without its variable parts: hosts, hexadecimal ids and numbers."""
    return " ".join(_NUM.sub("<num>", _HEX.sub("<hex>", _HOST.sub("<host>", text))).split())


def has_slot(text: str) -> bool:
    if not _SLOT_MARK.search(text):
        return False
    return SLOT.search(CODE.sub(" ", text) if "`" in text or "<" in text else text) is not None


def has_filler(text: str) -> bool:
    """A passage of filler text, or printed empty values."""
    low = text.lower()
    words, strong = low.split(), _STRONG_LATIN
    if len(strong.intersection(words)) >= 4 or (not text.isascii() and len(KOREAN_FILLER.intersection(words)) >= 4):
        run = hits = 0
        for s in _SENTENCE.split(text):
            w = [x.strip(".,;:!?()\"'“”") for x in s.lower().split()]
            if not w:
                continue
            latin, solid = sum(x in LATIN for x in w), sum(x in strong for x in w)
            korean = sum(x in KOREAN_FILLER for x in w)
            if (latin >= 0.7 * len(w) and solid >= 0.4 * len(w)) or korean >= 0.6 * len(w):
                run, hits = run + len(w), hits + 1
                if run >= 5:
                    return True
            else:
                run = 0
    if any(k in low for k in _PROMPT_KEYS) and PROMPT.search(text):
        for s in _SENTENCE.split(CODE.sub(" ", text)):
            m = PROMPT.search(s)
            # an article may name filler text; a passage of it is a line that starts so, or the words themselves
            if m and (m.start() <= 12 or len(m.group()) > 24):
                return True
    if any(k in text for k in _EMPTY_KEYS):
        plain = CODE.sub(" ", text)
        empty = EMPTY_VALUE.findall(plain)
        if len(empty) >= 2 and len(empty) >= 0.1 * len(plain.split()) or "[object Object]" in plain:
            return True
    return False


class PrefixTree:
    """Templates of messages that share token count and leading tokens (one leaf of a fixed-depth tree)."""

    def __init__(self) -> None:
        self.templates: list[list[str]] = []

    def add(self, tokens: list[str]) -> int:
        best, at = -1.0, -1
        for i, t in enumerate(self.templates):
            same = sum(a == b for a, b in zip(t, tokens)) / max(1, len(tokens))
            if same > best:
                best, at = same, i
        if at >= 0 and best >= SIMILARITY:
            t = self.templates[at]
            self.templates[at] = [a if a == b else WILD for a, b in zip(t, tokens)]
            return at
        self.templates.append(list(tokens))
        return len(self.templates) - 1


def leaf_key(masked: str, depth: int = DEPTH) -> str:
    tokens = masked.split(" ")
    return f"{len(tokens)}|" + " ".join(WILD if any(c.isdigit() for c in t) or t[:1] == "<" else t for t in tokens[:depth])


def scan_records(model: notices.WordModel, ids: list[int], contents: list[str | None], errors: list[str | None], urls: list[str | None]) -> dict[str, list]:
    """(extract_id, field_name, kind, message, leaf, site): 'residue' for slots and filler, 'message' for what is to be mined."""
    out: dict[str, list] = {"extract_id": [], "field_name": [], "kind": [], "message": [], "leaf": [], "site": []}
    for i, *values, url in zip(ids, contents, errors, urls):
        for field, text in zip(("content", "error"), values):
            if i is None or not text or text.isspace():
                continue
            if has_slot(text) or has_filler(text):
                row = ("residue", None, None, None)
            elif field == "error" and OWN_ERROR.fullmatch(text):
                continue
            elif model(text) >= notices.CANDIDATE:
                m = mask(text)
                site = _SITE.match(url or "")
                row = ("message", m, leaf_key(m), site[1].lower() if site else "")
            else:
                continue
            for k, v in zip(out, (i, field, *row)):
                out[k].append(v)
    return out


_SITE = re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def _mine(parts: DataFrame, by: str) -> DataFrame:
    """(by, place, message, template): each message with the place of its template, and each template of a part.

    Rows stream through sorted parts; only the templates of one part are held.
    """

    def run(batches):
        part, tree = None, PrefixTree()

        def found():
            n = len(tree.templates)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([None] * n, pa.string()), pa.array([" ".join(t) for t in tree.templates], pa.string())], names=names)

        names = [by, "place", "message", "template"]
        for b in batches:
            rows = ([], [], [])
            for key, message in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if key != part:
                    if tree.templates:
                        yield found()
                    part, tree = key, PrefixTree()
                for column, v in zip(rows, (key, tree.add(message.split(" ")), message)):
                    column.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.string()), pa.nulls(len(rows[0]), pa.string())], names=names)
        if tree.templates:
            yield found()

    return parts.select(by, "message").repartition(by).sortWithinPartitions(by, "message").mapInArrow(run, f"{by} string, place bigint, message string, template string")


def mine_templates(messages: DataFrame) -> DataFrame:
    """(message, template) of different messages(message, leaf)."""
    salt = F.pmod(F.xxhash64("message"), F.lit(SALTS)).cast("string")
    mined = stored(_mine(messages.select(F.concat_ws("#", "leaf", salt).alias("part"), "message"), "part"), "mined")
    ends = mined.where("template is not null").select("part", "place", "template", F.regexp_replace("part", "#[0-9]+$", "").alias("leaf"))
    # the templates of a leaf's salts, merged by mining them again
    merged = stored(_mine(ends.select("leaf", F.col("template").alias("message")).distinct(), "leaf"), "merged")
    whole = merged.where("template is not null").select("leaf", "place", F.col("template").alias("whole"))
    to = merged.where("template is null").select("leaf", "place", F.col("message").alias("template")).join(whole, ["leaf", "place"]).select("leaf", "template", "whole")
    places = ends.join(to, ["leaf", "template"]).select("part", "place", F.col("whole").alias("template"))
    return mined.where("template is null").select("part", "place", "message").join(places, ["part", "place"]).select("message", "template")


def word_model(extracts: DataFrame) -> notices.WordModel:
    """Fitted to the labelled examples and to at most MAX_ROWS records, taken by the hash of their id."""
    ids = extracts.where("content is not null and trim(content) != ''").select("extract_id").orderBy(F.xxhash64("extract_id"), "extract_id").limit(MAX_ROWS)
    rows = extracts.join(F.broadcast(ids.distinct()), "extract_id", "left_semi").select("extract_id", "content").dropDuplicates(["extract_id"]).orderBy("extract_id")
    first = notices.train([])
    return notices.train([r[1] for r in rows.collect() if r[1] and not (first(r[1]) > 0 or has_slot(r[1]) or has_filler(r[1]))])


def classify(templates: DataFrame, model: notices.WordModel) -> DataFrame:
    """(template) of those of templates(template, n, sites) that are notices."""
    spark = templates.sparkSession
    sample = templates.orderBy(F.xxhash64("template"), "template").limit(MAX_TEMPLATES).collect()
    box = spark.sparkContext.broadcast((model, notices.TemplateModel([notices.form(r[0], model(plain(r[0])), r[1], r[2]) for r in sample])))

    def run(texts, ns, sites):
        words, judge = box.value
        yes = judge([notices.form(t, words(plain(t)), n, k) for t, n, k in zip(texts, ns, sites)])
        return {"template": [texts[i] for i in np.flatnonzero(yes)]}

    return map_batches(templates.select("template", "n", "sites"), "template string", run)


def plain(template: str) -> str:
    """A template without its wildcards and masks."""
    return _MASK.sub(" ", template)


_MASK = re.compile(r"<(?:\*|num|hex|host)>")


def find_residue(extracts: DataFrame) -> DataFrame:
    """(extract_id, field_name, kind, template): rows of extracts(extract_id, content, error, url) to be left out."""
    url = F.col("url") if "url" in extracts.columns else F.lit(None).cast("string")
    model = word_model(extracts)
    box = extracts.sparkSession.sparkContext.broadcast(model)
    marked = map_batches(
        extracts.select("extract_id", "content", "error", url.alias("url")),
        "extract_id bigint, field_name string, kind string, message string, leaf string, site string",
        lambda *columns: scan_records(box.value, *columns),
    )
    marked = stored(marked, "messages")
    counted = marked.where("kind = 'message'").groupBy("message", "leaf", "site").agg(F.count("*").alias("n"))
    mined = stored(mine_templates(counted.select("message", "leaf").distinct()), "templates")
    support = counted.groupBy("message", "site").agg(F.sum("n").alias("n")).join(mined, "message").groupBy("template").agg(F.sum("n").alias("n"), F.approx_count_distinct("site").alias("sites"))
    verdicts = mined.join(classify(support, model), "template")
    notes = marked.where("kind = 'message'").join(verdicts, "message").select("extract_id", "field_name", F.lit("notice").alias("kind"), "template")
    residue = marked.where("kind = 'residue'").select("extract_id", "field_name", "kind", F.lit(None).cast("string").alias("template"))
    return residue.unionByName(notes).distinct()
