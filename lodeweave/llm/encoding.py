"""Text decoded with the wrong character encoding: found, and restored where nothing was lost.

A hidden Markov model labels the characters of a value.  One state is clean text; every other state stands for a
pair (encoding the text was written in, encoding it was read with) and emits the characters that such a misreading
leaves, in the order in which the written encoding puts its bytes.  The most likely path gives the spans; each span
gets the inverse transform of its state, again and again until nothing is left to change (text garbled twice).
Replacement characters have a state of their own, whose text can't be restored.

Costs are negative logarithms.  Those of Hangul, kana and Chinese characters follow their frequencies in all values
(see ``Frequencies``); where a script hardly stands in the corpus, the levels of the national standards tell common
characters from rare ones.  The other costs are per class of character and stated below.

ASCII characters say nothing and cost nothing in any state.  Runs of other characters are first labelled alone with
a bonus for the other states, each different run once; only values with a run that does not read as clean text then
are labelled whole.

A value counts as restored whole only if nothing was lost, every span encodes back to what stood there, no span is as
likely in another pair, no word mixes scripts that it did not mix before, and the result reads as clean text.

Defined cases: null, blank and ASCII values are clean; a repeated row gives its id once; a value of any length is
read whole; a value that can't be restored keeps its text with the lost characters in place.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .common import map_batches

# (written, read): the states besides clean text, likelier ones first.
PAIRS = (
    *(("utf-8", r) for r in ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "iso8859_2", "cp1250", "cp866", "cp1253", "iso8859_15", "cp1254")),
    ("cp949", "cp1252"), ("cp949", "latin-1"), ("euc_jp", "cp1252"), ("euc_jp", "latin-1"), ("cp932", "cp1252"), ("cp932", "latin-1"), ("gbk", "cp1252"),
    ("gbk", "latin-1"), ("big5", "cp1252"), ("big5", "latin-1"), ("gbk", "cp949"), ("cp949", "gbk"), ("big5", "gbk"), ("gbk", "cp932"), ("euc_jp", "gbk"),
    ("cp932", "mac_roman"), ("gbk", "mac_roman"), ("euc_jp", "mac_roman"), ("cp949", "mac_roman"), ("euc_jp", "cp932"), ("cp949", "cp932"), ("utf-8", "cp932"), ("utf-8", "gbk"), ("utf-8", "cp949"),
    ("cp1251", "cp1252"), ("cp1251", "latin-1"), ("cp1251", "mac_roman"), ("cp1251", "koi8_r"), ("koi8_r", "cp1252"), ("koi8_r", "cp1251"), ("koi8_r", "latin-1"), ("cp866", "cp1252"), ("cp866", "cp1251"), ("cp1251", "cp866"),
    ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1250", "cp1252"), ("iso8859_7", "cp1252"), ("iso8859_7", "latin-1"),
)
_WIDE = ("cp949", "euc_jp", "cp932", "gbk", "big5")
LOST = len(PAIRS)  # the state of replacement characters
ENTER, ENTER_SINGLE, ENTER_WIDE, LEAVE, WITHIN = 7.0, 9.0, 10.0, 2.0, 3.0  # negative logarithms of the transitions
_ENTER = [ENTER if w == "utf-8" and r not in _WIDE else ENTER_WIDE if w in _WIDE or r in _WIDE else ENTER_SINGLE for w, r in PAIRS]
_ORDINARY = set("’‘“”„«»–—…·•¿¡、。「」『』・ー〜！？（）：；，．％＆")
_SELDOM = set("¬¦¨¯´¸¤√∂∑∏≈≠∫∆Ω†‡‰ˆ˜")
_AFTER_WORD = set("™®©°ªº²³")


def _script(cp: int) -> str | None:
    """The scripts whose characters' frequencies count."""
    return "hangul" if 0xAC00 <= cp <= 0xD7A3 else "kana" if 0x3041 <= cp <= 0x30FE else "han" if 0x3400 <= cp <= 0x9FFF or 0xF900 <= cp <= 0xFAFF else None


@functools.lru_cache(65536)
def _level(ch: str) -> int:
    """0: a common character by the levels of a national standard, 1: one of its further levels, 2: outside of them."""
    script, best = _script(ord(ch)), 2
    if script == "kana":
        return 0
    if script == "hangul":
        try:
            return 0 if len(ch.encode("euc_kr")) == 2 else 2
        except UnicodeEncodeError:
            return 2
    for name, last in (("gb2312", 0xD7), ("euc_jp", 0xCF), ("big5", 0), ("euc_kr", 0)):
        try:
            b = ch.encode(name)
        except UnicodeEncodeError:
            continue
        if len(b) == 2:
            best = min(best, 0 if b[0] <= last else 1)
    return best


_SIZE = {"hangul": (2350, 1, 8822), "kana": (180, 1, 1), "han": (6500, 9000, 12000)}  # characters of each level
_SHARE = (0.985, 0.0149, 0.0001)  # of each level in text of the script, before the corpus is seen
PRIOR = 500  # so many values the levels count for


class Frequencies:
    """How much rarer or more frequent a character is than its script's characters are on the whole (a cost to add)."""

    def __init__(self, counts: dict[str, int] | None = None):
        self.counts = {c: n for c, n in (counts or {}).items() if _script(ord(c))}
        self.total = dict.fromkeys(_SIZE, 0)
        for c, n in self.counts.items():
            self.total[_script(ord(c))] += n
        self.mean = {}
        for script, sizes in _SIZE.items():
            seen = [self._cost(c, script) * n for c, n in self.counts.items() if _script(ord(c)) == script]
            rest = sum(PRIOR * share * math.log((self.total[script] + PRIOR) * k / (PRIOR * share)) for share, k in zip(_SHARE, sizes) if k > 1)
            self.mean[script] = (sum(seen) + rest) / (self.total[script] + PRIOR)
        self.key = hash(frozenset(self.counts.items()))

    def _cost(self, ch: str, script: str) -> float:
        level = _level(ch)
        p = (self.counts.get(ch, 0) + PRIOR * _SHARE[level] / _SIZE[script][level]) / (self.total[script] + PRIOR)
        return -math.log(p)

    def __call__(self, ch: str) -> float:
        script = _script(ord(ch))
        return max(-1.5, min(5.0, self._cost(ch, script) - self.mean[script])) if script else 0.0


_frequencies = Frequencies()


def use(frequencies: Frequencies) -> None:
    """Take these frequencies from now on in this process."""
    global _frequencies
    if frequencies.key != _frequencies.key:
        _frequencies = frequencies
        for f in (_from_bytes, _unit, _moves, _clean):
            f.cache_clear()
        _verdicts.clear()


def _plausible(ch: str) -> float:
    """Cost of a character in restored text."""
    cp = ord(ch)
    if cp < 0x80:
        return 0.5
    if 0xAC00 <= cp <= 0xD7A3:
        return 3.4 + max(-1.5, min(1.5, _frequencies(ch)))
    if 0x3041 <= cp <= 0x30FE:
        return 1.8 + max(-1.5, min(1.5, _frequencies(ch)))
    if 0x4E00 <= cp <= 0x9FFF:
        return 5.2 + max(-1.5, min(1.5, _frequencies(ch)))
    if ch in _ORDINARY or ch in " €":
        return 3.0
    if 0x430 <= cp <= 0x44F or cp == 0x451:
        return 2.4
    if 0x410 <= cp <= 0x42F:
        return 4.0
    if 0xDF <= cp <= 0xFF and ch not in "÷ð þý":
        return 2.5 if ch == "é" else 2.6  # the most frequent one
    if 0xC0 <= cp <= 0xDE and ch not in "×ÐÞÝ":
        return 4.0
    if ch in "£§©®°±²³µ¼½¾×÷™¥ªº¢¶†−≤≥≈≠∞→←":
        return 3.5
    if 0x100 <= cp <= 0x17F:
        return 4.0
    if 0x3AC <= cp <= 0x3CE:
        return 2.9
    if 0x391 <= cp <= 0x3AB:
        return 4.5
    if 0x3000 <= cp <= 0x303F or 0xFF01 <= cp <= 0xFF5E:
        return 4.5
    if cp == 0xFFFD:
        return 6.0  # a character that was lost before the misreading
    return 14.0


class _Codec:
    """Characters of a reading encoding and the bytes they came from."""

    def __init__(self, read: str):
        self.byte: dict[str, bytes] = {}
        for b in range(0x80, 0x100):
            try:
                ch = bytes([b]).decode(read)
            except UnicodeDecodeError:
                ch = chr(b) if read in ("cp1252", "cp1250", "cp1253", "cp1254", "cp1251") else ""
            if ch and ord(ch) >= 0x80:
                self.byte[ch] = bytes([b])
        self.wide = read if read in ("cp932", "gbk", "cp949") else None
        self.narrow = {ord(ch): b[0] for ch, b in self.byte.items()}

    def encode(self, text: str) -> bytes | None:
        """The bytes of a whole text; None if it has a character that the encoding lacks."""
        try:
            if not self.wide:
                return text.translate(self.narrow).encode("latin-1") if all(ch < "\x80" or ch in self.byte for ch in set(text)) else None
            return text.encode(self.wide)
        except UnicodeEncodeError:
            return None

    def __getitem__(self, ch: str) -> bytes:
        """The bytes of one character; b'' if the encoding has none."""
        if ch < "\x80":
            return ch.encode()
        b = self.byte.get(ch)
        if b is None and self.wide:
            try:
                b = ch.encode(self.wide)
            except UnicodeEncodeError:
                b = b""
            self.byte[ch] = b
        return b or b""


_CODECS = {r: _Codec(r) for _, r in PAIRS}
_BY_READ = {r: tuple(k for k, p in enumerate(PAIRS) if p[1] == r) for r in _CODECS}


# Lead bytes of common characters, and of the further ones, in each written encoding of two bytes.
_LEADS = {"gbk": ((0xB0, 0xD7), (0xD8, 0xF7)), "euc_jp": ((0xB0, 0xCF), (0xD0, 0xF4)), "cp932": ((0x88, 0x97), (0x98, 0xEA)), "big5": ((0xA4, 0xC6), (0xC9, 0xF9)), "cp949": ((0xB0, 0xC8), (0, 0))}


@functools.lru_cache(65536)
def _rare_in(ch: str, written: str) -> float:
    """Cost of a Chinese character or Hangul that the written encoding does not hold among its common ones."""
    common, further = _LEADS[written]
    b = ch.encode(written)
    if common[0] <= b[0] <= common[1] and (b[-1] >= 0xA1 or written in ("big5", "cp932")):
        return 0.0
    return 3.0 if further[0] <= b[0] <= further[1] and (b[-1] >= 0xA1 or written in ("big5", "cp932")) else 5.0


@functools.lru_cache(65536)
def _in_text(ch: str, written: str) -> float:
    script = _script(ord(ch))
    if script and written in _LEADS:
        return _plausible(ch) + (3.0 if script == "kana" and written not in ("euc_jp", "cp932") else 0.0 if script == "kana" else _rare_in(ch, written))
    if written == "utf-8" and "\x80" <= ch <= "\xbf":
        return min(_plausible(ch), 3.2 if ch >= "\xa0" else 4.5)  # perhaps a byte of text that was misread twice
    return _plausible(ch)


@functools.lru_cache(65536)
def _from_bytes(data: bytes, written: str) -> tuple[str, float]:
    try:
        ch = data.decode(written)
    except UnicodeDecodeError:
        return "", 0.0
    return ch, sum(_in_text(c, written) for c in ch)


@functools.lru_cache(262144)
def _unit(state: int, ahead: str) -> tuple[int, str, float]:
    """How many characters the state emits at once at the head of ahead, what they stand for, and the cost."""
    written, read = PAIRS[state]
    codec = _CODECS[read]
    head = codec[ahead[0]]
    if not head:
        return 0, "", 0.0
    if written == "utf-8":
        lead = head[0]
        need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
        if not need or lead < 0x80:
            return 0, "", 0.0
    elif written in _WIDE:
        if written == "cp932" and 0xA1 <= head[0] <= 0xDF:
            return 0, "", 0.0
        need = 2
    else:
        need = 1
    data, n = head, 1
    while len(data) < need and n < len(ahead):
        more = codec[ahead[n]]
        if not more:
            return 0, "", 0.0
        data += more
        n += 1
    if written == "utf-8" and codec.wide and len(data) > need:  # characters of two bytes straddle those of three
        while len(data) % need and n < len(ahead) and n < 12 and codec[ahead[n]]:
            data += codec[ahead[n]]
            n += 1
    elif len(data) != need and not (codec.wide and len(data) == need):
        return 0, "", 0.0
    ch, cost = _from_bytes(data, written)
    return (n, ch, cost) if ch else (0, "", 0.0)


@functools.lru_cache(262144)
def _moves(ahead: str, among: frozenset[int]) -> tuple[tuple[int, int, str, float], ...]:
    """(state, characters, what they stand for, cost) of the states that emit the head of ahead, at most four characters,
    but for those whose reading encoding has characters of two bytes and whose written one is UTF-8."""
    out = []
    for state in _states_of(ahead[0]):
        if state in among and not (_CODECS[PAIRS[state][1]].wide and PAIRS[state][0] == "utf-8"):
            k, got, cost = _unit(state, ahead)
            if k:
                out.append((state, k, got, cost))
    return tuple(out)


_ALL = frozenset(range(len(PAIRS)))
_STRADDLING = tuple(k for k, (w, r) in enumerate(PAIRS) if w == "utf-8" and r in ("cp932", "gbk", "cp949"))


@functools.lru_cache(65536)
def _clean(before: str, ch: str) -> float:
    """Cost of a character other than ASCII in clean text after the character before."""
    cp, cat = ord(ch), unicodedata.category(ch)
    if cp == 0xFFFD:
        return 40.0
    if cp < 0xA0:
        return 25.0
    near = before != "" and before != "\n"
    bcat = unicodedata.category(before) if near else "Zs"
    letter_before, foreign_before = bcat[0] == "L", near and before >= "\x80" and bcat[0] == "L"
    if ch in _ORDINARY:
        return 1.5 + (10.0 if near and before in "ÃÂâ" else 3.0 if ch in "„·•¡¿" and foreign_before else 0)
    if cat[0] == "Z":
        return 1.0 + (8.0 if foreign_before and bcat == "Lu" else 0)
    if 0xFF61 <= cp <= 0xFF9F:
        return 8.0
    if cat[0] in "LM":
        cost = 2.2 if cat != "Lu" else 3.6
        wide = 0x1100 <= cp <= 0x11FF or 0x2E80 <= cp
        if wide:
            return (1.5 if cp < 0x3100 else 2.2 if cp >= 0xAC00 else 3.0) + _frequencies(ch) + (4.0 if near and {_script(cp), _script(ord(before))} in ({"hangul", "han"}, {"hangul", "kana"}) else 0.0) + (8.0 if near and 0xC0 <= ord(before) <= 0x24F else 0)
        if letter_before:
            latin, before_latin = cp < 0x250 or 0x1E00 <= cp <= 0x1EFF, ord(before) < 0x250
            if latin != before_latin and ord(before) < 0x1100:
                cost += 4.0 if 0x370 <= cp <= 0x3FF or 0x370 <= ord(before) <= 0x3FF else 9.0  # Greek letters name quantities
            elif foreign_before and latin:
                cost += 3.0 if bcat == cat == "Lu" else 5.0  # capitals stand side by side in words in capitals
            if bcat == "Ll" and cat == "Lu":
                cost += 8.0
        elif near and before >= "\x80" and bcat[0] in "SNC" and before not in "€£°½¼¾×§":
            cost += 6.0
        if not latin_letter(ch) and cp < 0x250:
            cost += 4.0
        return cost
    if cat[0] in "SNPC":
        cost = 6.0 if ch in _SELDOM else 3.5 if cp < 0x2190 else 5.0
        if foreign_before and ord(before) < 0x1100:
            cost += 8.0
        elif letter_before and ch not in _AFTER_WORD:
            cost += 4.0
        elif near and before >= "\x80" and bcat[0] in "SNPC" and before not in _ORDINARY:
            cost += 6.0
        return cost
    return 3.0


def _clean_between(before: str, ch: str, after: str) -> float:
    """Cost of a character in clean text between two others."""
    cost = _clean(before, ch) + ((13.0 if ch > "\u03ff" else 3.0) if "\u0370" <= ch < "\u1100" and after in _ASCII_LETTERS else 0.0)
    if before in _LOWER and after in _LOWER and "\xa0" < ch < "\u2e80" and ch not in _ORDINARY and not latin_letter(ch) and not "\u0100" <= ch < "\u0250":
        cost += 6.0  # a sign or a foreign letter inside a word
    return cost


def latin_letter(ch: str) -> bool:
    return ch in "áàâäãåæçéèêëíìîïñóòôöõøœúùûüßÿÁÀÂÄÃÅÆÇÉÈÊËÍÌÎÏÑÓÒÔÖÕØŒÚÙÛÜªº"


@functools.cache
def _states_of(ch: str) -> tuple[int, ...]:
    return tuple(k for k, (_, read) in enumerate(PAIRS) if _CODECS[read][ch])


def _pieces(text: str) -> list[tuple[int, int]]:
    """Parts of some PIECE characters; they end at white space, or else before an ASCII character, never inside a run."""
    out, at = [], 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            cut = max(text.rfind("\n", at + PIECE // 2, to), text.rfind(" ", at + PIECE // 2, to)) + 1
            if not cut:
                m = _ASCII.search(text, to)
                cut = m.start() if m else len(text)
            to = cut
        out.append((at, min(to, len(text))))
        at = to
    return out


def label(text: str, enter: float = 0.0, among: frozenset[int] = _ALL) -> list[tuple[int, int, int]]:
    """(start, end, state) of the spans that are not clean on the most likely path; enter is added to ENTER.

    among: the pairs whose states take part.

    Long texts are labelled in pieces, so that the lattice stays small.
    """
    if len(text) > PIECE:
        parts = _pieces(text)
        if len(parts) > 1:
            return [(x + a, y + a, k) for a, b in parts for x, y, k in label(text[a:b], enter, among)]
    n = len(text)
    best: dict[int, dict[int, tuple[float, int, int]]] = {0: {-1: (0.0, -1, -2)}}  # place -> state -> cost, place and state before
    places = [m.start() for m in _FOREIGN.finditer(text)]
    at = 0
    foreign = iter(places + [n])
    nxt = next(foreign)
    # a state that costs more than this over the best one is never better than entering it again
    straddling = [k for k in _STRADDLING if k in among]
    bound = [e + enter + k * 0.02 + LEAVE + WITHIN for k, e in enumerate(_ENTER)]
    while at < n:
        here = best[at]
        low, low_state = min((c, k) for k, (c, _, _) in here.items())
        live = [(k, c) for k, (c, _, _) in here.items() if k < 0 or k == LOST or c <= low + bound[k]]
        while nxt < at:
            nxt = next(foreign)
        if nxt > at:  # ASCII up to the next foreign character
            to = best.setdefault(nxt, {})
            for k, c in live:
                if k not in to or c < to[k][0]:
                    to[k] = (c, at, k)
            at = nxt
            continue
        own_cost = dict(live)
        before, ch = text[at - 1] if at else "", text[at]
        after = text[at + 1 : at + 2]
        inside = WITHIN if before >= "\x80" and before.isalpha() else 0.0  # states seldom change inside a run
        clean_from = min((c + (LEAVE + inside if k >= 0 else 0.0), k) for k, c in live)
        steps = [(1, -1, clean_from[0] + _clean_between(before, ch, after), clean_from[1])]
        if ch == "�":
            own = own_cost.get(LOST, 1e9)
            c = min(own, low + ENTER)
            steps.append((1, LOST, c + 2.0, LOST if c == own else low_state))
        moves = _moves(text[at : at + 4], among)
        if straddling and (ch > "\u02ff" or ch in "àáèéêìíòóùúü§¨°±×÷·´¶¤¡¿ªº®¸¹²³¼½¾ÆÐØÞßæðøþ"):
            ahead = text[at : at + 12]
            extra = [(k, *_unit(k, ahead)) for k in straddling if _CODECS[PAIRS[k][1]][ch]]
            moves = (*moves, *(m for m in extra if m[1]))
        from_low = low + enter + (LEAVE if low_state >= 0 else 0.0) + inside
        for k, size, got, cost in moves:
            if got[0] > "\u024f":  # other scripts do not stand inside words of Latin letters
                left, right = before in _ASCII_LETTERS, text[at + size : at + size + 1] in _ASCII_LETTERS
                if got[0] < "\u1100":
                    cost += 5.0 * (left + right)
                elif left and right and got[0] > "\u2e80":
                    cost += 8.0
            if got == "’" and before in _ASCII_LETTERS and _SHORTENED.match(text, at + size):
                cost -= 2.0
            own = own_cost.get(k, 1e9)
            come = from_low + _ENTER[k] + k * 0.02
            steps.append((size, k, min(own, come) + cost, k if own <= come else low_state))
        for size, k, c, came in steps:
            to = best.setdefault(at + size, {})
            if k not in to or c < to[k][0]:
                to[k] = (c, at, came)
        at += 1
        while at not in best:
            at += 1
    end = min(best[n], key=lambda k: best[n][k][0] + (LEAVE if k >= 0 else 0))
    spans, place, state = [], n, end
    while place > 0:
        c, came, s_before = best[place][state]
        if state >= 0 and any(ch >= "\x80" for ch in text[came:place]):
            if spans and spans[-1][2] == state and not _FOREIGN.search(text, place, spans[-1][0]):
                spans[-1] = (came, spans[-1][1], state)
            else:
                spans.append((came, place, state))
        place, state = came, s_before
    return spans[::-1]


_ASCII_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = frozenset("abcdefghijklmnopqrstuvwxyz")
_SHORTENED = re.compile("(?:s|t|d|m|re|ve|ll)(?![a-zA-Z])")  # after an apostrophe
PIECE = 20_000
_ASCII_END, _ASCII_HEAD = re.compile("[a-zA-Z]{0,3}$"), re.compile("[a-zA-Z]{0,3}")
_FOREIGN, _ASCII = re.compile("[^\x00-\x7f]"), re.compile("[\x00-\x7f]")
_RUNS = re.compile("[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")
_MIXED = re.compile("[a-zA-Zß-öø-ÿ][\u0370-\u04ff]|[\u0370-\u04ff][a-zA-Zß-öø-ÿ]|[\u0370-\u04ff][\u3041-\u9fff가-힣]|[\u3041-\u9fff가-힣][a-z\u0370-\u04ff]")
MARGIN = 4.5  # by so much the pair of a span must be likelier than any other that gives another text


_JUMPS = re.compile("[가-힣][\u3041-\u9fff]|[\u3041-\u9fff][가-힣]|[а-яёα-ωß-öø-ÿ][А-ЯЁΑ-ΩÀ-ÖØ-Þ]|[a-zA-Z][\u0370-\u04ff]|[\u0370-\u04ff][a-zA-Zß-öø-ÿ]")
_SIGN_INSIDE = re.compile(r"(?<=[^\W\d_])[^\w\s'’\-‑,.;:!?)\"…/。、」』）？！](?=[^\W\d_])")
_SHORT = re.compile("(?<=[a-zA-Z])’(?:s|t|d|m|re|ve|ll)(?![a-zA-Z])")
_CHINESE = re.compile("[\u4e00-\u9fff]{2}")


def _cost_of(text: str, written: str) -> float:
    """Cost of a text from an encoding, with what neighbouring characters say."""
    cost = sum(_in_text(ch, written) for ch in text if ch >= "\x80")
    if "’" in text:
        cost -= 2.0 * len(_SHORT.findall(text))
    cost += 5.0 * len(_JUMPS.findall(text)) + 4.0 * len(_SIGN_INSIDE.findall(text))
    if written in ("euc_jp", "cp932"):
        cost += 0.8 * len(_CHINESE.findall(text))  # kana is missed
    if written == "utf-8" and "\xc2" <= max(text, default="") and not text.isascii():
        for read in ("cp1252", "latin-1"):
            data = _CODECS[read].encode(text)
            if data is not None:
                try:
                    return min(cost, ENTER + _cost_of(data.decode("utf-8"), "utf-8"))
                except UnicodeDecodeError:
                    continue
    return cost


def _reading(garbled: str, state: int) -> tuple[int, str | None, bool]:
    """(pair, text, whether it is certain): the likeliest reading of all spans of a state together, the pair's own first.

    It is certain if no other pair gives another text at a cost within MARGIN.
    """
    found: dict[str, tuple[float, int]] = {}
    for read, states in _BY_READ.items():
        data = _CODECS[read].encode(garbled)
        if data is None:
            continue
        for k in states:
            try:
                text = data.decode(PAIRS[k][0])
            except UnicodeDecodeError:
                continue
            # few languages have these letters, many the other
            cost = _cost_of(text, PAIRS[k][0]) + _ENTER[k] - 2.0 * len(_SHORT.findall(text)) + sum(map(text.count, "ìïëòùûýÿøæî")) - 0.4 * text.count("é")
            if text != garbled and (text not in found or (cost, k) < found[text]):
                found[text] = (cost, k)
    if not found:
        return state, None, False
    ranked = sorted((c, k != state, k, t) for t, (c, k) in found.items())
    return ranked[0][2], ranked[0][3], len(ranked) == 1 or ranked[1][0] - ranked[0][0] >= MARGIN


_TOKEN = re.compile("[^ \t\n\r]*[^\x00-\x7f][^ \t\n\r]*")


def _left_over(text: str, spans: list[tuple[int, int, int]], states: set[int]) -> bool:
    """Whether a word with characters outside of the spans might as well belong to one of the states."""
    inside = bytearray(len(text))
    for a, b, _ in spans:
        inside[a:b] = b"\1" * (b - a)
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if all(inside[i] or text[i] < "\x80" for i in range(a, b)):
            continue
        token = m.group()
        for k in states:
            data = _CODECS[PAIRS[k][1]].encode(token)
            if data is not None:
                try:
                    other = data.decode(PAIRS[k][0])
                except UnicodeDecodeError:
                    continue
                if other != token:
                    now = sum(_clean_between(x, y, z) for x, y, z in zip(" " + token, token, token[1:] + " ") if y >= "\x80")
                    if _cost_of(other, PAIRS[k][0]) < now + MARGIN:
                        return True
    return False


def restore(text: str) -> tuple[str, bool, bool]:
    """(restored text, whether any of it was wrong, whether all of it came back).

    The pairs that take part are those that could stand behind some run of the text.
    """
    wrong, whole, seen = False, True, {text}
    while True:
        among = frozenset().union(*map(odd, set(_RUNS.findall(text))))
        spans = label(text, among=among) if among else []
        if not spans:
            break
        wrong = True
        # all spans of a state are read together: they tell more than each alone
        readings = {}
        for k in {k for _, _, k in spans if k != LOST}:
            # with the letters beside them, where these are ASCII
            beside = "\n".join(_ASCII_END.search(text[max(0, a - 3) : a]).group() + text[a:b] + _ASCII_HEAD.match(text, b).group() for a, b, j in spans if j == k)
            best, _, certain = _reading(beside, k)
            readings[k] = best
            whole &= certain
        whole = whole and not _left_over(text, spans, set(readings.values()))
        out, at, changed = [], 0, False
        for a, b, k in spans:
            out.append(text[at:a])
            at = b
            got = None
            if k != LOST:
                for written, read in dict.fromkeys((PAIRS[readings[k]], PAIRS[k])):
                    data = b"".join(_CODECS[read][ch] for ch in text[a:b])
                    try:
                        got = data.decode(written)
                        whole &= got.encode(written) == data
                        break
                    except UnicodeError:
                        whole, got = False, None
            if got is None:
                whole = False
                out.append(text[a:b])
                continue
            changed = True
            whole &= not _MIXED.search(text[max(0, a - 1) : a] + got + text[b : b + 1])
            out.append(got)
        new = "".join(out) + text[at:]
        if not changed or new in seen:
            whole = False
            break
        seen.add(new)
        text = new
        if clean(text):
            break
    return text, wrong, whole and not ("�" in text or _SIGN_INSIDE.search(text) or _MIXED.search(text))


_verdicts: dict[str, frozenset[int]] = {}


def odd(run: str) -> frozenset[int]:
    """The pairs that may stand behind a run with its ASCII neighbours; none if it is clean.

    A pair that explains the whole run better than clean text does is taken; if there is none, the run is labelled.
    """
    got = _verdicts.get(run)
    if got is None:
        if len(_verdicts) > 200_000:
            _verdicts.clear()
        costs = [_clean_between(a, b, c) if b >= "\x80" else 0.0 for a, b, c in zip(" " + run, run, run[1:] + " ")]
        best, at = sum(costs), None
        some: list[int] = []  # the pairs that could explain a part of the run
        for read, states in _BY_READ.items():
            codec = _CODECS[read]
            data = codec.encode(run)
            if data is None:
                if any(ch >= "\x80" and ch not in _ORDINARY and codec[ch] for ch in run):
                    some += states
                continue
            for k in states:
                written = PAIRS[k][0]
                if written == "utf-8" and not (_gain_wide(costs, run, codec, data) > _ENTER[k] - 4.0 if codec.wide else _ONE.search(data)):
                    continue
                try:
                    text = data.decode(written)
                except UnicodeDecodeError:
                    pass
                else:
                    cost = _cost_of(text, written) + _ENTER[k] - 4.0
                    if cost < best and text != run:
                        best, at = cost, k
                # character for character: whether any part costs less so; the others are left to the lattice
                alike = written in _WIDE if codec.wide else written not in _WIDE and written != "utf-8"
                if not alike or _gain(costs, run, codec, written) > _ENTER[k] - 4.0:
                    some.append(k)
        if at is not None:
            got = frozenset((at,))
        elif some or "�" in run:
            got = frozenset(k for _, _, k in label(run, enter=-4.0, among=frozenset(some)))
        else:
            got = frozenset()
        _verdicts[run] = got
    return got


# A character of UTF-8; two of them, as characters of two bytes hold no single one.
_ONE = re.compile(b"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_TWO = re.compile(b"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){2}(?:[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})*")


def _gain_wide(costs: list[float], run: str, codec: _Codec, data: bytes) -> float:
    """The most by which a stretch of UTF-8 in the bytes of a run costs less than the characters that hold it."""
    most, at = 0.0, None
    for m in _TWO.finditer(data):
        if at is None:
            at = [0]
            for ch in run:
                at.append(at[-1] + len(codec[ch]))
        held = sum(c for c, a, b in zip(costs, at, at[1:]) if b > m.start() and a < m.end())
        least = sum(min(_in_text(ch, "utf-8"), 6.0) for ch in m.group().decode("utf-8", "ignore") if ch >= "\x80")
        most = max(most, held - least)
    return most



def _gain(costs: list[float], run: str, codec: _Codec, written: str) -> float:
    """The most by which a part of a run costs less if each of its characters is read anew."""
    most = now = 0.0
    for c, ch in zip(costs, run):
        if ch >= "\x80":
            got, cost = _from_bytes(codec[ch], written)
            now = max(0.0, now + c - cost) if got else 0.0
            most = max(most, now)
    return most


def clean(text: str) -> bool:
    return not any(odd(run) for run in set(_RUNS.findall(text)))


def examine(values: list[str | None]) -> list[tuple[str, bool] | None]:
    """For each value None if clean, else (restored text, whether it came back whole)."""
    out: list[tuple[str, bool] | None] = []
    for t in values:
        found = None
        if t and not t.isascii() and not clean(t):
            text, wrong, whole = restore(t)
            if wrong:
                found = (text, whole)
        out.append(found)
    return out


def frequencies_of(values: DataFrame) -> Frequencies:
    """Over all values of all string columns: in how many each character stands.  There are no more rows than characters."""

    def count(*columns):
        seen: Counter = Counter()
        for column in columns:
            for t in column:
                if t and not t.isascii():
                    seen.update(c for c in set(t) if c > "\u2fff")
        return {"ch": list(seen), "n": list(seen.values())}

    counts = map_batches(values, "ch string, n bigint", count).groupBy("ch").agg(F.sum("n").alias("n"))
    return Frequencies({r[0]: r[1] for r in counts.collect()})


def find_garbled(extracts: DataFrame) -> DataFrame:
    """(extract_id, field_name, restored, is_whole) of the values of extracts(extract_id, content, title) read wrongly."""
    fitted = extracts.sparkSession.sparkContext.broadcast(frequencies_of(extracts.select("content", "title")))

    def run(ids, contents, titles):
        use(fitted.value)
        out = {"extract_id": [], "field_name": [], "restored": [], "is_whole": []}
        for field, values in (("content", contents), ("title", titles)):
            for i, found in zip(ids, examine(values)):
                if found and i is not None:
                    for k, v in zip(out, (i, field, *found)):
                        out[k].append(v)
        return out

    return map_batches(extracts.select("extract_id", "content", "title"), "extract_id bigint, field_name string, restored string, is_whole boolean", run)
