"""Evaluation texts inside corpus documents, found by an FM-index over each shard.

A shard is one Arrow batch of documents.  Its words are mapped to the vocabulary of the test items; only runs
in which every neighbouring pair of words also stands side by side in some item can hold a match, so the rest
of the text is left out of the index without losing one.  The remaining runs are indexed (suffix array, BWT,
wavelet matrix); every item's words are searched backwards from every end position at once, occurrences are
located through sampled suffix positions and overlapping ones merged into removal spans.

Defined cases: null or empty text or item text gives no rows; an item shorter than ``min_words`` cannot match;
repeated documents or items give the same rows for each of their ids; further columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import INVISIBLE, map_batches

WORD, _PIECES = re.compile(r"[^\W_]+"), re.compile("(?:[^\\W_]|\ue000)+")
_INLINE = re.compile(r"</?(?:a|abbr|b|big|code|em|font|i|ins|kbd|mark|s|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_ENTITY = re.compile(r"&(?:[a-zA-Z]{2,8}|#\d{1,6}|#[xX][0-9a-fA-F]{1,6});")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?=[^\W\d_])")


def word_numbers(text: str) -> list[int]:
    """For each word of the text without breaks at line ends, the number of the first of its pieces among words(text).

    Pieces are marked before the text is split, so that both texts are split alike.
    """
    marked = words(_BROKEN.sub(_JOINT, text.replace(_JOINT, " ")), _PIECES)
    out, at = [], 0
    for w in marked:
        out.append(at)
        at += w.count(_JOINT) + 1
    out.append(at)
    return out


_JOINT = "\ue000"  # a private character that counts as a letter between pieces


def words(text: str, pattern: re.Pattern = WORD) -> list[str]:
    """Runs of letters and digits in lower case, without markup and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text and _ENTITY.search(text):
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    return pattern.findall(text.lower())


class WaveletMatrix:
    """rank(c, i): how often symbol c stands in the first i places, for whole arrays of c and i at once."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.cum, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.cum.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(seq) - int(self.cum[-1][-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        start = np.zeros_like(i)
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            cum, zeros = self.cum[k], self.zeros[k]
            a, b = cum[i], cum[start]
            i = np.where(one, zeros + a, i - a)
            start = np.where(one, zeros + b, start - b)
        return i - start


class FMIndex:
    """FM-index of an integer text with symbols 1..sigma; 0 parts the runs."""

    def __init__(self, text: np.ndarray, sigma: int, every: int = 8):
        text = np.concatenate((text.astype(np.int64) + 1, [0]))  # a smallest symbol of its own ends the text
        sigma += 1
        n = len(text)
        rank, k = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] if k < n else 0
            key = rank * (n + 2) + after
            sa = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[sa] = np.cumsum(np.concatenate(([1], np.diff(key[sa]) != 0)))
            rank, k = new, k * 2
            if int(rank.max()) == n or k >= n:
                break
        bwt = text[sa - 1]
        self.n = n
        self.wavelet = WaveletMatrix(bwt, max(1, int(sigma).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma + 1))))[:-1]
        self.bwt, self.sampled = bwt, np.where(sa % every == 0, sa, -1)

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = c + 1
        return self.before[c] + self.wavelet.rank(c, lo), self.before[c] + self.wavelet.rank(c, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows, walking back to the nearest sampled one."""
        at, out, walked = rows.copy(), np.full(len(rows), -1, np.int64), 0
        todo = np.arange(len(rows))
        while len(todo):
            s = self.sampled[at[todo]]
            found = s >= 0
            out[todo[found]] = (s[found] + walked) % self.n
            todo = todo[~found]
            c = self.bwt[at[todo]]
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            walked += 1
        return out


class Phrases:
    """The test items: vocabulary, neighbouring pairs and, for every item, the run length that counts."""

    def __init__(self, items: list[tuple[int, str | None]], min_words: int = 12, share: float = 0.5):
        self.vocab: dict[str, int] = {}
        ids, seqs, need = [], [], []
        for item, text in sorted((i, t) for i, t in items if i is not None and t):
            w = words(text)
            if len(w) >= min_words:
                ids.append(item)
                seqs.append([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w])
                need.append(max(min_words, -(-int(len(w) * share * 1000) // 1000)))
        self.ids, self.min_words = np.array(ids, np.int64), min_words
        size = [len(s) for s in seqs]
        self.flat = np.array(list(itertools.chain.from_iterable(seqs)), np.int64)
        self.first = np.repeat(np.cumsum([0, *size])[:-1], size).astype(np.int64) if size else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(len(size)), size)
        self.need = np.repeat(need, size).astype(np.int64) if size else np.zeros(0, np.int64)
        self.sigma = len(self.vocab)
        a, b = self.flat[:-1], self.flat[1:]
        inside = self.first[:-1] == self.first[1:] if size else np.zeros(0, bool)
        self.pairs = np.unique(a[inside] * (self.sigma + 1) + b[inside])

    def search(self, index: FMIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(item no., lo, hi, length) of every item window of the length that counts which stands in the text."""
        end = np.flatnonzero(np.arange(len(self.flat)) - self.first + 1 >= self.need)
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), index.n, np.int64)
        out, k = [], 0
        while len(end):
            lo, hi = index.step(self.flat[end - k], lo, hi)
            k += 1
            alive = hi > lo
            done = alive & (self.need[end] == k)
            out.append((self.item[end[done]], lo[done], hi[done], self.need[end[done]]))
            alive &= ~done
            end, lo, hi = end[alive], lo[alive], hi[alive]
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def find_in_shard(phrases: Phrases, docs: list[int], texts: list[str | None]) -> dict[str, np.ndarray]:
    """doc_id, item_id, first_word, last_word (numbered from 0, inclusive) of the merged spans of a shard."""
    none = {k: np.zeros(0, np.int64) for k in ("doc_id", "item_id", "first_word", "last_word")}
    if not len(phrases.ids):
        return none
    streams, owner, numbers = [], [], []
    get, zero = phrases.vocab.get, itertools.repeat(0)
    for d, t in zip(docs, texts):
        if not t or d is None:
            continue
        # a text with words broken at line ends is searched both ways; places are those of the text as it stands
        for variant in (False, True) if _BROKEN.search(t) else (False,):
            w = words(_BROKEN.sub("", t) if variant else t)
            if len(w) >= phrases.min_words:
                streams.append(np.fromiter(map(get, w, zero), np.int64, len(w)))
                owner.append(d)
                numbers.append(np.array(word_numbers(t)) if variant else None)
    if not streams:
        return none
    lens = np.array([len(s) for s in streams])
    flat = np.concatenate([np.append(s, 0) for s in streams])  # a 0 ends every document
    starts = np.concatenate(([0], np.cumsum(lens + 1)))
    key = flat[:-1] * (phrases.sigma + 1) + flat[1:]
    at = np.minimum(np.searchsorted(phrases.pairs, key), len(phrases.pairs) - 1)
    good = (phrases.pairs[at] == key) & (flat[:-1] > 0) & (flat[1:] > 0)
    edge = np.diff(np.concatenate(([0], good.astype(np.int8), [0])))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # words a..b are a run
    keep = b - a + 1 >= phrases.min_words
    a, b = a[keep], b[keep]
    if not len(a):
        return none
    size = b - a + 1
    begin = np.concatenate(([0], np.cumsum(size + 1)))
    text = np.zeros(begin[-1], np.int64)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin[:-1], size) + within] = flat[np.repeat(a, size) + within]
    index = FMIndex(text, phrases.sigma)
    item, lo, hi, length = phrases.search(index)
    if not len(item):
        return none
    count = hi - lo
    rows = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    item, length = np.repeat(item, count), np.repeat(length, count)
    pos = index.locate(rows)
    run = np.searchsorted(begin, pos, side="right") - 1
    word = a[run] + pos - begin[run]  # place in flat
    stream = np.searchsorted(starts, word, side="right") - 1
    first = word - starts[stream]
    last = first + length - 1
    for k in np.unique(stream):
        if numbers[k] is not None:
            own = stream == k
            first[own], last[own] = numbers[k][first[own]], numbers[k][last[own] + 1] - 1
    doc = np.array(owner, np.int64)[stream]
    order = np.lexsort((last, first, item, doc))
    doc, item, first, last = doc[order], item[order], first[order], last[order]
    # windows of one item overlap by all but one word: a span goes on while the next one starts inside or right behind it
    cut = np.ones(len(doc), bool)
    reach = last.copy()
    for i in range(1, len(doc)):
        if doc[i] == doc[i - 1] and item[i] == item[i - 1] and first[i] <= reach[i - 1] + 1:
            cut[i], reach[i] = False, max(reach[i], reach[i - 1])
    heads = np.flatnonzero(cut)
    return {"doc_id": doc[heads], "item_id": phrases.ids[item[heads]], "first_word": first[heads], "last_word": np.maximum.reduceat(last, heads)}


def leaked_spans(documents: DataFrame, items: DataFrame, min_words: int = 12, share: float = 0.5, part_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, item_id, first_word, last_word): where documents hold unbroken runs of test items.

    The test items are searched in parts of some part_chars characters, each of which every task holds while it reads
    the documents once; a larger set takes more passes.  Sizes are added up by hash of the id, and no item is split.
    """
    spark = documents.sparkSession
    known = items.select("item_id", "text").where("item_id is not null and text is not null")
    total = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_chars))
    found = None
    for k in range(parts):
        own = known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else known
        phrases = spark.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in own.collect()], min_words, share))  # about part_chars characters
        spans = map_batches(
            documents.select("doc_id", "text").where("text is not null"),
            "doc_id bigint, item_id bigint, first_word bigint, last_word bigint",
            lambda ids, texts, phrases=phrases: find_in_shard(phrases.value, ids, texts),
        )
        found = spans if found is None else found.unionByName(spans)
    return found
