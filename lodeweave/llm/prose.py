"""Per-document text statistics and the nearest structural profile.

Every text is cut into segments (paragraphs, parted again where lines with and without function words meet).
A segment gives two distributions: its function words by grammatical group in each language, and its characters
by class.  Jensen-Shannon divergence to prose profiles of each language and to profiles of lists, tables, code,
logs and junk assigns the nearest one; a document is prose if most of its characters lie in prose segments.

Defined cases: null and blank text give NULL shares, zero counts and the profile 'empty', never a finding;
repeated rows give the same row; a text of any length is read whole; further columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from .common import map_batches

# Common function words by language, in the groups article/determiner, preposition,
# conjunction/adverb, pronoun, auxiliary/verb.
FUNCTION_WORDS = {
    "en": (
        "the a an this that these those every each any some no all both neither another",
        "of in on at by for with from to into than until since before after over under between about as near during without against through",
        "and or but nor so yet if when while because although though then there here not only more most very still also even too again once however meanwhile instead",
        "it its he she they them their his her you your we our us i my me who whom which what whose one ones nobody anyone other others hardly",
        "is are was were be been being has have had do does did will would can could may might must should shall need seem seems",
    ),
    "fr": (
        "le la les un une des du au aux ce cette ces l d son sa ses leur leurs mon notre votre quelques chaque tout tous toute",
        "de à en dans par pour sur avec sans sous entre chez vers depuis jusqu après avant contre près côté grâce dès",
        "et ou mais donc or ni car que si comme quand plus moins très bien ne pas aussi encore déjà",
        "il elle ils elles on je tu nous vous qui dont où se lui y",
        "est sont était étaient a ont avait avaient été être avoir fait peut",
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines kein keine dieser diese dieses jeder jede mehrere",
        "in im an am auf aus bei mit nach von vom zu zum zur über unter für durch gegen ohne um vor während trotz wegen laut",
        "und oder aber denn doch als wenn weil dass ob auch noch nur schon sehr nicht mehr früher häufig zunächst",
        "er sie es ich du wir ihr sein seine ihre ihren ihm ihn sich man wer was",
        "ist sind war waren hat haben hatte hatten wird werden wurde wurden kann können muss soll",
    ),
    "es": (
        "el la los las un una unos unas este esta estos estas ese esa cada todo todos su sus mi tu nuestro",
        "de del a al en con por para sin sobre entre hasta desde hacia contra según tras durante",
        "y e o u pero sino que si como cuando más menos muy no ya también aún después luego mucha",
        "él ella ellos ellas yo se lo le les nos quien cual cuyo donde",
        "es son era eran fue fueron ha han había está están ser haber puede",
    ),
    "pt": (
        "o a os as um uma uns umas este esta estes estas esse essa cada todo todos seu sua seus suas meu nosso",
        "de do da dos das em no na nos nas ao à aos às com por para sem sobre entre até desde pelo pela além segundo",
        "e ou mas que se como quando mais menos muito não já também só então porém após ainda",
        "ele ela eles elas eu ele lhe quem qual onde isto isso",
        "é são era eram foi foram tem têm tinha está estão ser ter há pode",
    ),
    "ru": (
        "этот эта это эти тот та те весь вся всё все каждый свой своя своё какой",
        "в во на с со к ко по за из от до для без под над при о об у через перед между после",
        "и а но или что чтобы если когда как не ни же ли бы только уже ещё также очень тоже снова",
        "он она оно они я ты мы вы его её их ему ей им себя кто который которая",
        "был была было были есть будет быть может надо",
    ),
    "it": (
        "il lo la i gli le un uno una questo questa questi ogni tutto tutti suo sua",
        "di del della dei delle da dal in nel nella con su per tra fra senza al alla a",
        "e o ma che se come quando più meno molto non anche ancora",
        "lui lei loro io si ci chi cui dove",
        "è sono era erano ha hanno aveva stato essere avere può",
    ),
}
# Endings that mark case, topic and sentence end where words carry them.
KOREAN = ("는은가이", "를을", "서에로지터께", "의와과도만씩", "다요고며")
KANA = ("のこそ", "をにで", "もとやか", "はが", "たるすいてだ")


# Profiles: shares of the five groups and of the rest, as averages over prose (see fit_profiles); the Italian one is set
# by hand.
PROSE = {
    "en": (0.123, 0.121, 0.064, 0.039, 0.074, 0.579),
    "fr": (0.197, 0.138, 0.014, 0.005, 0.088, 0.558),
    "de": (0.205, 0.166, 0.021, 0.005, 0.005, 0.598),
    "es": (0.234, 0.133, 0.026, 0.005, 0.005, 0.597),
    "pt": (0.183, 0.18, 0.083, 0.005, 0.014, 0.535),
    "ru": (0.012, 0.146, 0.015, 0.005, 0.005, 0.817),
    "it": (0.18, 0.16, 0.07, 0.03, 0.04, 0.52),
    "ko": (0.171, 0.147, 0.126, 0.033, 0.132, 0.391),
    "ja": (0.043, 0.092, 0.033, 0.056, 0.093, 0.683),
}
BARE = (0.005, 0.01, 0.003, 0.003, 0.002, 0.977)  # words of lists, tables, code and logs

CLASSES = ("lower", "upper", "digit", "space", "stop", "comma", "bracket", "symbol", "ideograph", "hangul", "odd", "break")
# Character shares by class, in the order of CLASSES, as averages (see fit_profiles); numbered lists, delimited tables and
# the kinds of junk are set by hand.
STRUCTURES = {
    "prose": (0.755, 0.028, 0.020, 0.158, 0.013, 0.014, 0.003, 0.001, 0.0, 0.0, 0.0, 0.008),
    "prose, capitals": (0.02, 0.763, 0.020, 0.158, 0.013, 0.014, 0.003, 0.001, 0.0, 0.0, 0.0, 0.008),
    "prose, hangul": (0.131, 0.025, 0.020, 0.209, 0.028, 0.007, 0.014, 0.0, 0.0, 0.555, 0.0, 0.011),
    "prose, ideographs": (0.134, 0.025, 0.028, 0.005, 0.040, 0.044, 0.0, 0.0, 0.709, 0.0, 0.0, 0.015),
    "list": (0.757, 0.031, 0.026, 0.064, 0.014, 0.029, 0.030, 0.028, 0.0, 0.0, 0.0, 0.021),
    "list, numbered": (0.740, 0.060, 0.060, 0.075, 0.012, 0.013, 0.005, 0.015, 0.0, 0.0, 0.0, 0.060),
    "table": (0.363, 0.022, 0.153, 0.363, 0.016, 0.024, 0.0, 0.032, 0.0, 0.0, 0.0, 0.027),
    "table, delimited": (0.46, 0.05, 0.19, 0.09, 0.03, 0.10, 0.0, 0.06, 0.0, 0.0, 0.0, 0.02),
    "code": (0.502, 0.010, 0.156, 0.032, 0.045, 0.085, 0.11, 0.046, 0.0, 0.0, 0.0, 0.014),
    "log": (0.344, 0.022, 0.310, 0.101, 0.014, 0.156, 0.018, 0.015, 0.0, 0.0, 0.0, 0.02),
    "junk": (0.28, 0.24, 0.12, 0.08, 0.045, 0.065, 0.05, 0.11, 0.0, 0.0, 0.0, 0.01),
    "junk, drawn": (0.02, 0.01, 0.02, 0.02, 0.03, 0.03, 0.01, 0.15, 0.0, 0.0, 0.70, 0.01),
    "junk, ruled": (0.01, 0.01, 0.01, 0.01, 0.10, 0.12, 0.02, 0.70, 0.0, 0.0, 0.0, 0.02),
}
COMMON = {w for words in FUNCTION_WORDS.values() for group in words for w in group.split()}
_LANGS = tuple(FUNCTION_WORDS)
_ORDER = {w: i + 1 for i, w in enumerate(sorted(COMMON))}
_WORD_ID = {a + w + b: i for w, i in _ORDER.items() for a in ("", '"', "(", "“", "«", "„") for b in ("", ",", ".", ";", ":", "!", "?", ")", '"', '."', ',"')}
_GROUP_OF = np.full((len(_LANGS), len(_ORDER) + 1), 5, np.int64)
for _k, _lang in enumerate(_LANGS):
    for _g, _words in enumerate(FUNCTION_WORDS[_lang]):
        for _w in _words.split():
            _GROUP_OF[_k, _ORDER[_w]] = _g


@functools.cache
def class_table() -> np.ndarray:
    """Class number of every code point."""
    out = np.full(0x110000, CLASSES.index("odd"), np.uint8)
    for cp in range(0x30000):
        ch, cat = chr(cp), unicodedata.category(chr(cp))
        if ch == "\n":
            name = "break"
        elif cat[0] == "Z" or ch in "\t\r":
            name = "space"
        elif 0xAC00 <= cp <= 0xD7A3 or 0x1100 <= cp <= 0x11FF:
            name = "hangul"
        elif 0x3040 <= cp <= 0x30FF or 0x3400 <= cp <= 0x9FFF or 0x20000 <= cp:
            name = "ideograph"
        elif cat == "Lu":
            name = "upper"
        elif cat[0] in "LM":
            name = "lower"
        elif cat == "Nd":
            name = "digit"
        elif ch in ".!?。！？…":
            name = "stop"
        elif ch in ",;:'\"、，；：“”‘’«»„-–—「」":
            name = "comma"
        elif ch in "()[]{}<>（）":
            name = "bracket"
        elif cat[0] in "PS" and not 0x2190 <= cp <= 0x2BFF:
            name = "symbol"
        else:
            continue
        out[cp] = CLASSES.index(name)
    return out


def word_groups(text: str, lang: str) -> np.ndarray:
    """Shares of a language's five groups of function words, or endings and particles, and of the rest."""
    out = np.zeros(6)
    if lang == "ja":
        groups = _kana_table()[np.frombuffer("".join(c for c in text if c < "\U00010000").encode("utf-16-le"), np.uint16)]
        out += np.bincount(groups[groups < 6], minlength=6)
    elif lang == "ko":
        ends = {ch: j for j, group in enumerate(KOREAN) for ch in group}
        for w in text.lower().split():
            out[ends.get(w.rstrip(",.")[-1:], 5)] += 1
    else:
        ids = [_WORD_ID.get(w, 0) for w in text.lower().split()]
        out += np.bincount(_GROUP_OF[_LANGS.index(lang)][ids], minlength=6)
    return out / max(1.0, out.sum())


def class_shares(text: str) -> np.ndarray:
    """Shares of the character classes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[codes], minlength=len(CLASSES)) / max(1, len(codes))


def fit_profiles(samples: list[tuple[str, str | None, str]]) -> tuple[dict[str, tuple[float, ...]], dict[str, tuple[float, ...]]]:
    """(prose profiles by language, structure profiles) as averages over labelled samples (structure, language, text).

    A language's profile comes from its samples of a structure that begins with 'prose'; no share is under 0.005, and
    those of a profile add up to one, as in PROSE and STRUCTURES.
    """
    words: dict[str, list[np.ndarray]] = {}
    chars: dict[str, list[np.ndarray]] = {}
    for structure, lang, text in samples:
        if not text or text.isspace():
            continue
        chars.setdefault(structure, []).append(class_shares(text))
        if lang and structure.startswith("prose"):
            words.setdefault(lang, []).append(word_groups(text, lang))

    def mean(rows: list[np.ndarray], least: float) -> tuple[float, ...]:
        m = np.maximum(np.mean(rows, 0), least)
        return tuple(np.round(m / m.sum(), 3).tolist())

    return {k: mean(v, 0.005) for k, v in words.items()}, {k: mean(v, 0.0) for k, v in chars.items()}


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits of rows of p (n, k) and profiles q (m, k): an (n, m) array."""
    p, q = p[:, None, :] + 1e-9, q[None, :, :] + 1e-9
    m = (p + q) / 2
    return 0.5 * (p * np.log2(p / m)).sum(-1) + 0.5 * (q * np.log2(q / m)).sum(-1)


_RULED = re.compile(r"^\s*(?:[-*•·+]\s|\|)|\|.*\||\t|\s{3,}\S.*\s{3,}|^\s*(?:at |/|https?://|\.?[\w.#-]+\s*\{)|[{}]|=>|\)\s*;$|\]\(http")
_EAST = re.compile("[\u3040-\u9fff\uac00-\ud7a3]")
_CLAUSE = re.compile("[다는を。たが]")
_ENDS = (".", "!", "?", "。", "！", "？", '."', '!"', '?"', ".”", "?”", "!”", "…", ".’", ".)")


def _line_kind(line: str, n: int, hits: int) -> int:
    """1: reads like prose, 0: does not, -1: too short to tell."""
    if n >= 6 and hits >= 0.2 * n:
        return 1
    if not line.isascii():
        east = len(_EAST.findall(line))
        if east > 0.3 * len(line):
            return 1 if east > 8 and _CLAUSE.search(line) else -1
    if _RULED.search(line):
        return 0
    return 0 if n >= 4 and hits == 0 else -1


def _merge_lines(lines: list[str], kinds: list[int], blank_before: list[bool]) -> list[int]:
    """Segment number of every line: a new one after a blank line and where prose and other lines meet."""
    out, seg, kind = [], -1, -1
    last = len(kinds) - 1
    for i, (k, fresh) in enumerate(zip(kinds, blank_before)):
        if k == 1 and not fresh and len(lines[i]) < 120 and kinds[i - 1] == 0 and (i == last or blank_before[i + 1] or kinds[i + 1] == 0):
            k = 0  # a line between ruled ones, such as the title over each address of a list
        if fresh or (k >= 0 and kind >= 0 and k != kind):
            seg += 1
            kind = k
        elif k >= 0:
            kind = k
        out.append(seg)
    return out


@functools.cache
def _kana_table() -> np.ndarray:
    """Group of the Japanese prose profile for every code point of the basic plane; 6: no Japanese character."""
    out = np.full(0x10000, 6, np.uint8)
    out[0x3040:0x30FF] = out[0x3400:0xA000] = 5
    for g, chars in enumerate(KANA):
        for ch in chars:
            out[ord(ch)] = g
    return out


def describe(texts: list[str | None]) -> dict[str, list]:
    """Statistics and profiles of a batch of texts."""
    n_docs, k = len(texts), len(CLASSES)
    lines, doc_of, blank_before = [], [], []
    for i, t in enumerate(texts):
        fresh = True
        for line in (t or "").split("\n"):
            if not line or line.isspace():
                fresh = True
            else:
                lines.append(line)
                doc_of.append(i)
                blank_before.append(fresh)
                fresh = False
    if not lines:
        none = [None] * n_docs
        return {"word_count": [0] * n_docs, "mean_word_length": none, "symbol_ratio": none, "ended_line_share": none, "common_word_share": none, "prose_share": none, "profile": ["empty"] * n_docs}
    doc = np.array(doc_of)
    word_lists = [x.lower().split() for x in lines]
    per_line = np.fromiter(map(len, word_lists), np.int64, len(lines))
    flat = list(itertools.chain.from_iterable(word_lists))
    ids = np.fromiter(map(_WORD_ID.get, flat, itertools.repeat(0)), np.int64, len(flat))
    line_of_word = np.repeat(np.arange(len(lines)), per_line)
    hits = np.bincount(line_of_word, ids > 0, len(lines)).astype(np.int64)
    kinds = np.where((per_line >= 6) & (hits >= 0.2 * per_line), 1, 2)
    rest = np.flatnonzero(kinds == 2)
    ruled = np.zeros(len(lines), bool)
    ruled[rest] = [_RULED.search(lines[i]) is not None for i in rest.tolist()]
    for i, n, h in zip(rest.tolist(), per_line[rest].tolist(), hits[rest].tolist()):
        kinds[i] = _line_kind(lines[i], n, h)
    seg = np.array(_merge_lines(lines, kinds.tolist(), blank_before))
    n_seg = int(seg[-1]) + 1
    seg_doc = np.zeros(n_seg, np.int64)
    seg_doc[seg] = doc

    chars = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    seg_of_char = np.repeat(seg, chars)
    counts = np.bincount(seg_of_char * k + class_table()[codes], minlength=n_seg * k).reshape(-1, k).astype(float)
    counts[:, CLASSES.index("break")] += np.bincount(seg, minlength=n_seg) - 1
    size = counts.sum(1)
    share = counts / size[:, None]

    seg_of_word = seg[line_of_word]
    words = np.bincount(seg_of_word, minlength=n_seg)
    prose, most = np.full(n_seg, np.inf), np.zeros(n_seg)
    known = ids > 0  # words outside every list are the rest of each language
    seg_known, ids_known = seg_of_word[known], ids[known]

    def compare(lang: str, groups: np.ndarray) -> None:
        nonlocal prose, most
        total = np.maximum(1, groups.sum(1, keepdims=True))
        full = divergence(groups / total, np.array([PROSE[lang]]))[:, 0]
        used, rest = groups[:, :5].sum(1, keepdims=True), groups[:, 5:]
        few = divergence(np.hstack((used, rest)) / total, np.array([[sum(PROSE[lang][:5]), PROSE[lang][5]]]))[:, 0]
        w = np.minimum(1.0, total[:, 0] / 80)  # the groups of a short segment are left to chance, the sum is not
        prose = np.minimum(prose, w * np.minimum(full, 1.5 * few + 0.05) + (1 - w) * few)
        most = np.maximum(most, used[:, 0] / total[:, 0])

    for j, lang in enumerate(_LANGS):
        g = np.bincount(seg_known * 6 + _GROUP_OF[j][ids_known], minlength=n_seg * 6).reshape(-1, 6)
        g[:, 5] = words - g[:, :5].sum(1)
        compare(lang, g)
    hangul, ideograph = CLASSES.index("hangul"), CLASSES.index("ideograph")
    east = np.zeros(n_seg, bool)
    if counts[:, hangul].any():
        line_is = np.isin(seg, np.flatnonzero(share[:, hangul] > 0.2))
        g = np.zeros((n_seg, 6))
        ends = {ch: j for j, group in enumerate(KOREAN) for ch in group}
        for i in np.flatnonzero(line_is).tolist():
            for w in word_lists[i]:
                g[seg[i], ends.get(w.rstrip(",.")[-1:], 5)] += 1
        at = g.sum(1) > 0
        east |= at
        before = prose.copy()
        compare("ko", g)
        prose = np.where(at, prose, before)
    if counts[:, ideograph].any():
        low = codes < 0x10000
        kana = _kana_table()[codes[low]]
        g = np.bincount(seg_of_char[low][kana < 6] * 6 + kana[kana < 6], minlength=n_seg * 6).reshape(-1, 6)
        at = share[:, ideograph] > 0.2
        east |= at
        before = prose.copy()
        compare("ja", g)
        prose = np.where(at, prose, before)
    bare = divergence(np.stack((most, 1 - most), 1), np.array([[1 - BARE[5], BARE[5]]]))[:, 0]
    trust = np.where(east, 1.0, np.minimum(1.0, words / 8))  # few words say little about function words
    score = divergence(share, np.array(list(STRUCTURES.values())))
    first = np.array([x.startswith("prose") for x in STRUCTURES])
    drawn = np.bincount(seg, ruled * chars, n_seg) / np.maximum(1, np.bincount(seg, chars, n_seg))
    shape = divergence(np.stack((drawn, 1 - drawn), 1), np.array([[0.02, 0.98], [0.5, 0.5]]))
    score = score + np.where(first, prose[:, None], bare[:, None]) * 2 * trust[:, None] + np.where(first, shape[:, :1], shape[:, 1:] * 0.3)
    names = [x.partition(",")[0] for x in STRUCTURES]
    profiles = sorted(set(names))
    by = np.zeros((n_docs, len(profiles)))
    np.add.at(by, (seg_doc, np.array([profiles.index(x) for x in names])[score.argmin(1)]), size)
    seen = by.sum(1)
    there = seen > 0
    ended = np.bincount(doc, np.fromiter((x.rstrip().endswith(_ENDS) for x in lines), float, len(lines)), n_docs)
    n_lines = np.bincount(doc, minlength=n_docs)
    doc_of_word = doc[line_of_word]
    n_words = np.bincount(doc_of_word, minlength=n_docs)
    letters = np.bincount(doc_of_word, np.fromiter(map(len, flat), float, len(flat)), n_docs)
    char = np.zeros((n_docs, k))
    np.add.at(char, seg_doc, counts)
    odd = sum(char[:, CLASSES.index(x)] for x in ("bracket", "symbol", "odd"))

    def column(a: np.ndarray, b: np.ndarray) -> list:
        return [round(x / y, 6) if y else None for x, y in zip(a.tolist(), b.tolist())]

    return {
        "word_count": n_words.tolist(),
        "mean_word_length": column(letters, n_words),
        "symbol_ratio": column(odd, char.sum(1)),
        "ended_line_share": column(ended, n_lines),
        "common_word_share": column(np.bincount(doc_of_word, ids > 0, n_docs), n_words),
        "prose_share": column(by[:, profiles.index("prose")], seen),
        "profile": [profiles[j] if ok else "empty" for j, ok in zip(by.argmax(1).tolist(), there.tolist())],
    }


STATISTICS = "doc_id bigint, word_count bigint, mean_word_length double, symbol_ratio double, ended_line_share double, common_word_share double, prose_share double, profile string, is_prose boolean"


def text_statistics(documents: DataFrame) -> DataFrame:
    """One row of STATISTICS for every row of documents(doc_id, text)."""

    def run(ids: list[int], texts: list[str | None]) -> dict[str, list]:
        out = describe(texts)
        out["is_prose"] = [None if p is None else p >= 0.5 for p in out["prose_share"]]
        return out | {"doc_id": ids}

    return map_batches(documents.select("doc_id", "text"), STATISTICS, run)
