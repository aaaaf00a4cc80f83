"""Noise in text from scanned pages: running lines, broken words, misread characters; repair into paragraphs.

1. Word counts over the whole corpus.  Words with at least ``max(4, N / 10^6)`` of the N occurrences are the
   lexicon; by that threshold it has 10^6 entries at most, which is the bound on what is broadcast.  Right forms
   are all words that stand four times; they are joined, not broadcast.
2. Every word of two letters or more gets correction candidates by an inverted join on its rarest character q-grams;
   gradient-boosted trees, trained on words misread on purpose and on short names that only look alike, rank the
   candidates, and the best one replaces the word if it scores over one half.  A word with two misread places has no
   candidate unless they are neighbours.
3. A logistic classifier over each line and its neighbours tells running lines (headers, footers, page numbers)
   from body; another one over a line that ends in a mark and the next body line tells words broken by the mark from
   compounds.  Both are trained on the corpus, labelled by sure signs.

Defined cases: null and blank content, and null ids, give no rows; a repeated row gives its lines once; content of any length is
read whole; a word without a likely candidate stays as it is; a tie goes to the candidate that is more frequent.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_batches, stored

MARKS = "-‐‑¬­"
_TRAIL = ".,;:?\"”’'"
_LEAD = "\"“‘'"
_NUMBER = re.compile(r"[\d.,%:/=<>+\-–()\[\]$€£#&*]+")
_LETTERS = re.compile(r"[^\W\d_]")

# Character groups that scanners take for one another.
CONFUSIONS = (
    "rn m", "m rn", "cl d", "d cl", "vv w", "w vv", "li h", "h li", "ii u", "ri n", "nn m", "in m", "l 1", "1 l", "I 1", "1 I", "l I", "I l", "i l", "l i", "i 1", "1 i", "l |", "| l", "I |", "i |", "i !", "! i", "l !", "! l", "i j", "j i", "i ¡",
    "O 0", "0 O", "o 0", "0 o", "D O", "O D", "Q O", "O Q", "S 5", "5 S", "S 8", "8 S", "s 5", "5 s", "s S", "B 8", "8 B", "g 9", "9 g", "q 9", "9 q", "g q", "q g", "Z 2", "2 Z", "z 2", "2 z", "b 6", "6 b", "G 6", "6 G", "G C", "C G", "T 7", "7 T",
    "e c", "c e", "c o", "o c", "e o", "o e", "a o", "o a", "a e", "e a", "t f", "f t", "f r", "r f", "h b", "b h", "n u", "u n", "v y", "y v", "u v", "v u", "n h", "h n", "n r", "r n", "c (", "( c", "C (", "( C", "t +", "t l", "l t", "t 1", "1 t", "h n", "k lc", "x k", "y g", "g y", "p q", "q p", "d a", "a d", "a s", "s a", "a u", "u a", "a @", "@ a", "s $", "$ s", "S $", "$ S", "E F", "F E", "P R", "R P", "V Y", "Y V", "M N", "N M", "e 6", "e €", "fi ﬁ", "ﬁ fi", "fl ﬂ", "ﬂ fl", "t i", "J I", "L I", "U V", "K X", "H N", "N H", "W VV", "z s", "s z", "g 8", "8 g", "4 A", "A 4", "ci a", "tl d", "ni m", "rr n",
)
_VISUAL = {tuple(x.split(" ")) for x in CONFUSIONS}  # (seen or true, true or seen): read in both directions
_TAKEN: dict[str, set[str]] = {}  # both directions, by piece
for _a, _b in _VISUAL:
    _TAKEN.setdefault(_a, set()).add(_b)
    _TAKEN.setdefault(_b, set()).add(_a)
_DIGIT_OF = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "!": "1", "O": "0", "o": "0", "D": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "g": "9", "q": "9", "Z": "2", "z": "2", "b": "6", "G": "6", "T": "7", "A": "4", "(": "1"})


def core(token: str) -> str:
    """A token without the punctuation around it; signs that may be misread letters stay."""
    return token.rstrip(_TRAIL).rstrip(")]").rstrip(_TRAIL).lstrip(_LEAD)


# ---- words -------------------------------------------------------------------------------------------------


def count_words(texts: list[str | None]) -> Counter:
    """Counts of a batch, without the pieces of words broken at line ends."""
    out: Counter = Counter()
    for t in texts:
        if not t:
            continue
        out.update(t.split())
        skip, left = False, []
        for line in map(str.rstrip, t.split("\n")):
            if not line:
                continue
            ends = line[-1] in MARKS
            if skip or ends:
                w = line.split()
                if skip:
                    left.append(w[0])
                    w = w[1:]
                skip = ends and bool(w) and len(w[-1]) > 1
                if skip:
                    left.append(w[-1])
        for x in left:
            out[x] -= 1
    words: Counter = Counter()
    for token, n in out.items():
        c = core(token) if n else ""
        if c and not _NUMBER.fullmatch(c):
            if c[0] in "([":
                inner = c.strip("([")
                if len(inner) > 3 and inner.isalpha() and inner.islower():
                    words[c] += n  # perhaps a misread c; if not, the word stands without the sign elsewhere
                elif inner:
                    words[inner] += n
            else:
                words[c] += n
    return words


def qgrams(word: str) -> list[str]:
    q = 2 if len(word) <= 5 else 3
    w = f"^{word}$"
    return sorted({w[i : i + q] for i in range(len(w) - q + 1)})


def differing(w: str, c: str) -> tuple[int, str, str]:
    """(place, piece of w, piece of c) after the common head and tail are cut off."""
    a, n = 0, min(len(w), len(c))
    while a < n and w[a] == c[a]:
        a += 1
    b = 0
    while b < n - a and w[-1 - b] == c[-1 - b]:
        b += 1
    return a, w[a : len(w) - b], c[a : len(c) - b]


def _visual(x: str, y: str) -> float:
    """Cost of taking y for x: 0.3 for a known confusion, else edits; longer pieces by alignment."""
    if x == y:
        return 0.0
    if y in _TAKEN.get(x, ()):
        return 0.3
    if len(x) <= 1 and len(y) <= 1:
        return 1.0
    if len(x) > 8 or len(y) > 8:
        return float(max(len(x), len(y)))
    above, last = [], [float(j) for j in range(len(y) + 1)]
    twos = [y[j - 1 : j + 1] for j in range(1, len(y))]
    for i, p in enumerate(x):
        one, two = _TAKEN.get(p, ()), _TAKEN.get(x[i - 1 : i + 1], ()) if i else ()
        row = [i + 1.0]
        for j, q in enumerate(y):
            cost = last[j] + (0.0 if p == q else 0.3 if q in one else 1.0)
            if last[j + 1] + 1.0 < cost:
                cost = last[j + 1] + 1.0
            if row[j] + 1.0 < cost:
                cost = row[j] + 1.0
            if one and j and twos[j - 1] in one:
                cost = min(cost, last[j - 1] + 0.3)
            if two:
                if q in two:
                    cost = min(cost, above[j] + 0.3)
                if j and twos[j - 1] in two:
                    cost = min(cost, above[j - 1] + 0.3)
            row.append(cost)
        above, last = last, row
    return last[-1]


class CharModel:
    """Character trigram model of the lexicon."""

    def __init__(self, lexicon: dict[str, int]):
        tri: Counter = Counter()
        bi: Counter = Counter()
        for w, n in lexicon.items():
            k = math.log1p(n)
            s = f"^^{w.lower()}$"
            for i in range(len(s) - 2):
                tri[s[i : i + 3]] += k
                bi[s[i : i + 2]] += k
        self.p = {t: math.log((n + 0.01) / (bi[t[:2]] + 0.5)) for t, n in tri.items()}
        self.memo: dict[str, float] = {}
        self.total = max(1, sum(lexicon.values()))

    def __call__(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            s = f"^^{w.lower()}$"
            ps = [self.p.get(s[i : i + 3], -8.0) for i in range(len(s) - 2)]
            got = self.memo[w] = sum(ps) / len(ps) + 0.5 * min(ps)
        return got


def pair_features(w: str, c: str, nw: int, nc: int, model: CharModel, pieces: tuple[str, str] | None = None) -> list[float]:
    """pieces: those of differing(w, c), where they are known."""
    x, y = pieces or differing(w, c)[1:]
    seen_odd = sum(not ch.isalpha() and ch not in "-'’" for ch in w)
    return [
        _visual(x, y),
        float(max(len(x), len(y))),
        math.log(nc / nw),
        math.log(max(nw / model.total, RARE)),  # both are alike at every size of the corpus
        float(len(w)),
        float(w[:1] == c[:1]),
        float(seen_odd),
        model(w),
        model(c) - model(w),
        float(w[:1].isupper()) + 2 * float(w.isupper()),
        float(abs(len(w) - len(c))),
        float(x.lower() == y.lower()),
    ]


class BoostedTrees:
    """Gradient boosting of depth-2 regression trees for the logistic loss."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 24):
        self.rounds, self.rate, self.bins = rounds, rate, bins
        self.trees: list[tuple] = []
        self.base = 0.0

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float] | None:
        best, at = 1e-6, None
        total = g.sum() ** 2 / (h.sum() + 1)
        for j in range(x.shape[1]):
            for t in self.cuts[j]:
                left = x[:, j] <= t
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = g.sum() - gl, h.sum() - hl
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total
                if hl > 2 and hr > 2 and gain > best:
                    best, at = gain, (j, float(t))
        return at

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, self.bins))) for j in range(x.shape[1])]
        p = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(p / (1 - p))
        z = np.full(len(y), self.base)
        leaf = lambda g, h: float(-self.rate * g.sum() / (h.sum() + 1))
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = q - y, q * (1 - q)
            root = self._split(x, g, h)
            if root is None:
                break
            left = x[:, root[0]] <= root[1]
            sides = []
            for m in (left, ~left):
                s = self._split(x[m], g[m], h[m])
                if s is None:
                    sides.append((0, np.inf, leaf(g[m], h[m]), 0.0))
                else:
                    low = x[m][:, s[0]] <= s[1]
                    sides.append((*s, leaf(g[m][low], h[m][low]), leaf(g[m][~low], h[m][~low])))
            self.trees.append((root, *sides))
            z += self._tree(self.trees[-1], x)
        return self

    @staticmethod
    def _tree(tree: tuple, x: np.ndarray) -> np.ndarray:
        (j, t), a, b = tree
        side = lambda s: np.where(x[:, s[0]] <= s[1], s[2], s[3])
        return np.where(x[:, j] <= t, side(a), side(b))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._tree(tree, x)
        return 1 / (1 + np.exp(-z))


def misread(word: str, rng: random.Random) -> str | None:
    """The word with one confusion, as a scanner might make it."""
    options = [(i, a, b) for i in range(len(word)) for a, b in _VISUAL if word.startswith(a, i)]
    if not options:
        return None
    i, a, b = rng.choice(options)
    return word[:i] + b + word[i + len(a) :]


def train_ranker(lexicon: dict[str, int], rare: dict[str, int] | list[str], most: int = 3000, seed: int = 7) -> tuple[BoostedTrees, CharModel]:
    """Train on at most ``most`` words of the lexicon, misread on purpose, and as many pairs of words that are both right."""
    model, rng = CharModel(lexicon), random.Random(seed)
    common = sorted((w for w, n in lexicon.items() if len(w) >= 3 and w.isalpha()), key=lambda w: (-lexicon[w], w))[: 2 * most]
    x, y = [], []
    for c in rng.sample(common, min(most, len(common))):
        for _ in range(3):
            w = misread(c, rng)
            if w and w not in lexicon:
                nc = lexicon[c]
                ratio = math.exp(rng.uniform(math.log(LIKELY), max(math.log(2 * LIKELY), math.log(model.total) - 6)))
                if nc / ratio > 3 * RARE * model.total:
                    ratio *= 10  # seldom is one misreading as frequent as that
                x.append(pair_features(w, c, nc / ratio, nc, model))
                y.append(1.0)
    grams: dict[str, list[str]] = {}
    for c in common:
        for q in qgrams(c):
            grams.setdefault(q, []).append(c)
    right = [w for w in rare if w.isalpha()][:most] + common[-most:]
    counts = {**dict.fromkeys(rare, 1), **(rare if isinstance(rare, dict) else {}), **lexicon}
    for w in rng.sample(right, min(most, len(right))):
        near = Counter(c for q in qgrams(w) for c in grams.get(q, ()) if c != w and abs(len(c) - len(w)) <= 1)
        for c, _ in near.most_common(2):
            _, a, b = differing(w, c)
            if w not in lexicon and _visual(a, b) <= 0.6 and (w.islower() or model(w) < -3.5):
                continue  # may well be misread
            if w in lexicon and _visual(a, b) <= 0.6:
                if LEAST_RATIO * lexicon[w] <= lexicon[c] < LIKELY * lexicon[w]:
                    x.append(pair_features(w, c, lexicon[w], lexicon[c], model))  # too frequent for a misreading
                    y.append(0.0)
                if rng.random() > 0.1:
                    continue  # words that are both right and look alike are seldom
            x.append(pair_features(w, c, counts[w], max(lexicon[c], LEAST_RATIO * counts[w]), model))
            y.append(0.0)
    # short names differ by as little as a misread one does, and are right
    for w in sorted(w for w in rare if 2 <= len(w) <= 4 and w.isalpha() and w[0].isupper() and not w.isupper()):
        near = {w[:i] + b + w[i + len(a) :] for a, b in _VISUAL for i in range(len(w)) if w.startswith(a, i)} | {w[:i] + b + w[i + 1 :] for i in range(1, len(w)) for b in "aeiourntl"}
        for c in sorted(near - {w}):
            if c in lexicon and lexicon[c] >= LEAST_RATIO * counts[w]:
                x += [pair_features(w, c, counts[w], lexicon[c], model)] * 5
                y += [0.0] * 5
    # so frequent a word is right although a look-alike is up to 100 times as frequent; such pairs are few, hence the copies
    for w in (w for w, n in lexicon.items() if n > 3 * RARE * model.total and len(w) >= 3 and w.isalpha()):
        near = {w[:i] + b + w[i + len(a) :] for a, b in _VISUAL for i in range(len(w)) if w.startswith(a, i)}
        for c in sorted(near):
            if LEAST_RATIO * lexicon[w] <= lexicon.get(c, 0) < 100 * lexicon[w]:
                x += [pair_features(w, c, lexicon[w], lexicon[c], model)] * 30
                y += [0.0] * 30
    if len(set(y)) < 2:
        x, y = [[0.3] + [0.0] * 11, [9.0] + [0.0] * 11], [1.0, 0.0]
    return BoostedTrees().fit(np.array(x), np.array(y)), model


LEAST_COUNT = 4  # of a right form, whatever the size of the corpus
RARE = 3e-5  # share of all occurrences; rarer words are alike to the ranker
LEAST_RATIO = 5  # a right form is so many times as frequent as a misread one, whatever the size of the corpus
LIKELY = 30  # the ratio from which on words are misread on purpose; what lies between is left to the ranker


def enough(n, n_right):
    """Whether a candidate is so much more frequent that the ranker is asked (Columns or numbers)."""
    return n_right >= LEAST_RATIO * n


GRAMS = 1 << 16  # counters of q-grams, whatever the corpus


def changed(word: str) -> int:
    """How many q-grams one confusion changes at most: four of three characters, or three of two."""
    return 3 if len(word) <= 5 else 4


def gram_counts(lexicon: DataFrame) -> np.ndarray:
    """In how many words of the lexicon the q-grams of a counter stand."""

    def count(ws):
        n = np.bincount(np.fromiter((crc32(g.encode()) % GRAMS for w in ws for g in set(qgrams_of(w, 2)) | set(qgrams_of(w, 3))), np.int64), minlength=GRAMS)
        at = np.flatnonzero(n)
        return {"at": at.tolist(), "n": n[at].tolist()}

    out = np.zeros(GRAMS, np.int64)
    for r in map_batches(lexicon.select("word"), "at int, n bigint", count).groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def rarest(word: str, counts: np.ndarray) -> list[str]:
    """The q-grams of a word by which it is looked up: a word that differs by one confusion has at least one of them."""
    grams = qgrams(word)
    return sorted(grams, key=lambda g: (counts[crc32(g.encode()) % GRAMS], g))[: changed(word) + 1]


def find_corrections(words: DataFrame, lexicon: DataFrame, ranker) -> DataFrame:
    """(word, right): replacements among the lexicon(word, n) for words(word, n), by an inverted join on q-grams.

    A word is looked up by its rarest q-grams only, as many as one confusion can change and one more, so that lists of
    frequent q-grams are met by words that have no rarer ones alone; longer lists are left to adaptive execution.
    """
    spark = words.sparkSession
    box, often = spark.sparkContext.broadcast(ranker), spark.sparkContext.broadcast(gram_counts(lexicon))

    def exploded(df: DataFrame, spread: bool) -> DataFrame:
        def run(ws, ns):
            out = {"gram": [], "size": [], "word": [], "n": []}
            for w, n in zip(ws, ns):
                for k in (len(w) - 1, len(w), len(w) + 1) if spread else (len(w),):
                    # words of five and six letters meet on both lengths of q-gram
                    for g in sorted(set(qgrams_of(w, 2 if k <= 5 else 3))) if spread else rarest(w, often.value):
                        out["gram"].append(g)
                        out["size"].append(k)
                        out["word"].append(w)
                        out["n"].append(n)
            return out

        return map_batches(df.select("word", "n"), "gram string, size int, word string, n bigint", run)

    low = exploded(words.where(F.length("word") >= SHORTEST), False)
    high = exploded(lexicon.where(F.length("word") >= SHORTEST), True).withColumnsRenamed({"word": "right", "n": "n_right"})
    met = low.join(high, ["gram", "size"]).where(enough(F.col("n"), F.col("n_right")) & (F.lower("word") != F.lower("right")))
    pairs = met.select("word", "right", "n", "n_right").distinct()

    def rank(ws, rs, ns, nrs):
        forest, model = box.value
        keep, x = [], []
        for row in zip(ws, rs, ns, nrs):
            _, a, b = differing(row[0], row[1])
            if len(a) <= 4 and len(b) <= 4 and alike(row[0], row[1]):
                keep.append(row)
                x.append(pair_features(*row, model, (a, b)))
        if not keep:
            return None
        p = forest(np.array(x))
        return {"word": [r[0] for r in keep], "right": [r[1] for r in keep], "n_right": [r[3] for r in keep], "p": p.tolist()}

    scored = map_batches(pairs, "word string, right string, n_right bigint, p double", rank).where("p >= 0.5")
    best = scored.groupBy("word").agg(F.max_by("right", F.struct("p", "n_right", "right")).alias("right"))
    return best


SHORTEST = 2  # letters of a word that is looked up


def alike(word: str, right: str) -> bool:
    """Whether the words share the q-grams that one confusion leaves."""
    q = 2 if len(word) <= 5 else 3
    return len(set(qgrams_of(word, q)).intersection(qgrams_of(right, q))) >= max(1, len(word) - changed(word))


def qgrams_of(word: str, q: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + q] for i in range(len(w) - q + 1)]


def number_of(token: str) -> str | None:
    """The number a token of digits and letters stands for, if it was misread."""
    if any(ch.isdigit() for ch in token):
        fixed = token.translate(_DIGIT_OF)
        digits = sum(ch.isdigit() for ch in token)
        if fixed != token and fixed.replace(",", "").replace(".", "").rstrip("%").isdigit() and 2 * digits >= len(token) - 1:
            return fixed
    return None


# ---- lines -------------------------------------------------------------------------------------------------

_STOP = re.compile(r"[.!?:][\"”’)\]]*$")
_N = r"[\dlIOoSsBgqZz|]{1,4}"
_PAGE = re.compile(rf"^(?:[-–—·]\s*{_N}\s*[-–—·]|\[\s*{_N}\s*\]|\(\s*{_N}\s*\)|{_N}|(?:[pP][ao][gqe]{{1,2}}[ec]?|[pP]\.|[Ss]eite|[Pp]ág\.|[Pp]agina|стр\.)\s*{_N}(?:\s*(?:of|0f|oF|/|von|de|из|sur|ot)\s*{_N})?|[ivxlcIVXLC]{{1,6}})$")
_ISSUE = re.compile(r"\b(?:vol|no|issue|bd|tome)[.,]?\s*[\dlIOS]+|\bdownloaded from\b|\bdoi\b|\bissn\b|©|\baccepted (?:for publication|manuscript)\b|\bpreprint\b|\ball rights reserved\b|\b(?:bulletin|annals|proceedings|transactions|journal|letters|working papers|technical reports?|quarterly)\b|\b[\w-]+\.(?:com|org|net|example|test|invalid)\b", re.I)
_ROMAN = re.compile(r"^[ivxlc\dIl]{1,6}\s*[|·•]\s*\S|\S\s*[|·•]\s*[ivxlc\dIl]{1,6}$", re.I)
_EDGE_NUMBER = re.compile(r"^[\dlIOS]{1,4}\s{2,}\S|\S\s{2,}[\dlIOS]{1,4}$")
_SAME = str.maketrans({**{c: "l" for c in "1|!iIj"}, **{c: "o" for c in "0OcCeaQD("}, **{c: "s" for c in "5S$"}, **{c: "n" for c in "uhbr"}, **{c: "t" for c in "f+"}, **{c: "g" for c in "9q"}, **{c: "#" for c in "234678"}})
_SIGNS, _RUN = re.compile(r"\W+"), re.compile("[#los]+")
# the same on lower-case ASCII, behind signs without which there is no match
_ISSUE_LOW = re.compile(r"\b(?:vol|issue|bd|tome)[.,]?\s*[\dlios]|\bdownloaded from\b|\bdoi\b|\bissn\b|\baccepted (?:for publication|manuscript)\b|\bpreprint\b|\ball rights reserved\b|\b(?:bulletin|annals|proceedings|transactions|journal|letters|working papers|technical reports?|quarterly)\b")
_ISSUE_SIGNS = ("vol", "issue", "bd", "tome", "download", "doi", "issn", "accepted", "print", "rights", "bulletin", "annals", "proceed", "transac", "journal", "letters", "papers", "technical", "quarterly")
_ISSUE_NO = re.compile(r"no(?<=\bno)[.,]?\s*[\dlios]")
_ISSUE_HOST = re.compile(r"\.(?:com|org|net|example|test|invalid)\b")
_CLOSING, _FULL = "\"”’)]", (".", "!", "?", ":")
FEATURES = 22


def issue(s: str) -> bool:
    """Whether ``_ISSUE`` is found in a line."""
    if not s.isascii():
        return _ISSUE.search(s) is not None
    low = s.lower()
    for x in _ISSUE_SIGNS:
        if x in low:
            if _ISSUE_LOW.search(low):
                return True
            break
    return "no" in low and _ISSUE_NO.search(low) is not None or "." in low and _ISSUE_HOST.search(low) is not None and _ISSUE.search(s) is not None


def line_features(lines: list[str]) -> np.ndarray:
    """One row for each line that is not blank: its form, and how the lines before and after it run on."""
    return features_of([lines])[2]


def features_of(docs: list[list[str]]) -> tuple[list[list[int]], list[int], np.ndarray]:
    """Of each document's lines: the indices of those that are not blank, the width of full lines; the rows of all."""
    solids, widths, text, ends = [], [], [], [0]
    for lines in docs:
        stripped = list(map(str.strip, lines))
        solid = [i for i, s in enumerate(stripped) if s]
        text += [stripped[i] for i in solid] if len(solid) < len(stripped) else stripped
        solids.append(solid)
        widths.append(sorted(map(len, stripped))[len(stripped) - len(solid) + int(0.8 * (len(solid) - 1))] if solid else 1)
        ends.append(len(text))
    n = len(text)
    out = np.zeros((n, FEATURES), np.float32)
    if not n:
        return solids, widths, out
    count = np.diff(ends)
    opens, closes = np.zeros(n, bool), np.zeros(n, bool)  # a document
    opens[np.array(ends[:-1])[count > 0]] = closes[np.array(ends[1:])[count > 0] - 1] = True
    at = np.fromiter((i for solid in solids for i in solid), np.int64, n)
    final = np.repeat(np.fromiter(map(len, docs), np.int64, len(docs)), count) - 1 == at
    step = np.diff(at) != 1
    gap_before, gap_after = np.append(True, step), np.append(step, True)
    gap_before[opens], gap_after[closes] = at[opens] == 0, final[closes]
    gap_before |= opens & (at > 0)
    gap_after |= closes & ~final
    size = np.fromiter(map(len, text), np.int64, n)
    firsts, lasts = [s[0] for s in text], [s[-1] for s in text]
    lower = np.fromiter(map(str.islower, firsts), bool, n)
    stops = np.fromiter((c in _FULL or c in _CLOSING and s.rstrip(_CLOSING)[-1:] in _FULL for c, s in zip(lasts, text)), bool, n)
    out[:, 7], out[:, 8], out[:, 10], out[:, 11], out[:, 12] = stops, lower, gap_before & gap_after, gap_before, gap_after
    out[:, 13] = size / np.repeat(np.array(widths), count)
    out[:, 16], out[:, 17], out[:, 18] = opens, closes, [c in MARKS for c in lasts]
    out[:, 20], out[:, 21] = np.fromiter(map(str.isdigit, lasts), bool, n), size > 110
    plain = lower & np.fromiter((c not in "ivxlc" for c in firsts), bool, n) | (size > 110)
    runs_on = ~np.append(True, stops[:-1]) & ~opens & ~gap_before & ~closes & np.append(lower[1:], False) & ~lower & ~plain
    out[:, 9] = runs_on
    odd = np.flatnonzero(~plain)
    rows, keys = [], []
    for k in odd.tolist():
        s = text[k]
        words = s.split()
        initial = sum([w[0].isupper() or not w[0].isalpha() for w in words]) / len(words)
        keys.append(_RUN.sub("#", _SIGNS.sub(" ", s.translate(_SAME).lower())) if initial > 0.4 else None)
        rows.append((
            len(words) < 6 and _PAGE.match(s) is not None,
            len(words) < 14 and issue(s),
            ("|" in s or "·" in s or "•" in s) and len(words) < 16 and _ROMAN.search(s) is not None,
            "  " in s and _EDGE_NUMBER.search(s) is not None,
            not s[1:2].islower() and sum(map(str.isupper, s)) > 0.8 * sum(map(str.isalpha, s)) and sum(map(str.isalpha, s)) > 3,
            initial > 0.55 and len(words) >= 3,
            initial,
            len(words) <= 2,
        ))
    if rows:
        out[np.ix_(odd, (0, 1, 2, 3, 4, 14, 15, 19))] = np.array(rows, np.float32)
        own = list(zip(np.repeat(np.arange(len(docs)), count)[odd].tolist(), keys))
        often = Counter(own)
        again = np.array([x[1] is not None and often[x] > 1 for x in own])
        out[odd, 5], out[odd, 6] = again, again & (out[odd, 13] < 0.75)
    return solids, widths, out


_PRODUCT = ((4, 7), (5, 7), (9, 14), (0, 7), (14, 13), (15, 9), (14, 11), (14, 12), (16, 14), (17, 14), (5, 14), (8, 5), (9, 13), (19, 0), (16, 15), (12, 14), (10, 4), (7, 14))


def _expand(x: np.ndarray) -> np.ndarray:
    a, b = np.array(_PRODUCT).T
    return np.hstack((x, x[:, a] * x[:, b], np.ones((len(x), 1), np.float32)))


def seed_running(x: np.ndarray) -> np.ndarray:
    """1 running line, 0 body line, -1 not sure, by sure signs in the features."""
    y = np.full(len(x), -1)
    y[(x[:, 8] > 0) | (x[:, 13] > 0.85) & (x[:, 14] == 0) | (x[:, 21] > 0) | (x[:, 7] > 0) & (x[:, 0] == 0)] = 0
    y[(x[:, 10] > 0) & (x[:, 0] == 0)] = 0
    y[(x[:, 13] > 0.8) & (x[:, 5] == 0) & (x[:, :5].sum(1) == 0)] = 0
    sure = (x[:, 0] > 0) & (x[:, 7] == 0) | (x[:, 1] > 0) & (x[:, 8] == 0) & ((x[:, 15] > 0.5) | (x[:, 9] > 0)) & (x[:, 7] == 0) | (x[:, 2] > 0)
    sure |= (x[:, 4] > 0) & (x[:, 10] == 0) & (x[:, 8] == 0)
    sure |= (x[:, 6] > 0) & (x[:, 7] == 0) & (x[:, 8] == 0) & (x[:, 14] > 0) & (x[:, 10] == 0)
    sure |= (x[:, 3] > 0) & (x[:, 14] > 0)
    y[sure] = 1
    return y


def train_lines(texts: list[str]) -> np.ndarray:
    x = [line_features(t.split("\n")) for t in texts if t]
    x = np.vstack(x) if x else np.zeros((0, FEATURES), np.float32)
    y = seed_running(x)
    x, y = _expand(x[y >= 0]), y[y >= 0].astype(float)
    if not len(y):
        w = np.zeros(FEATURES + len(_PRODUCT) + 1)
        w[-1] = -4.0
        return w
    return logistic(x, y)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    square = np.full(len(w), 1e-6)
    for _ in range(400):
        g = x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + 1e-4 * w
        square += g * g
        w -= 0.3 * g / np.sqrt(square)
    return w


def running_lines(lines: list[str], w: np.ndarray) -> set[int]:
    """Indices (from 0) of the running lines."""
    (solid,), _, x = features_of([lines])
    return {i for i, z in zip(solid, _expand(x) @ w) if z > 0}


def known(word: str, lexicon: dict[str, int]) -> int:
    return lexicon.get(word) or lexicon.get(word.lower()) or lexicon.get(word.strip("([!|")) or 0


def halves(left: str, right: str) -> tuple[str, str]:
    return left.lstrip("([" + _LEAD), core(right).strip("([")


def joins(left: str, mark: str, right: str, lexicon: dict[str, int]) -> bool:
    """Whether a mark at a line end breaks a word, by the counts alone: the sure signs that train the classifier."""
    a, b = halves(left, right)
    if not a or not b or not b[0].isalpha():
        return False
    if mark not in "-":
        return True
    whole, compound = known(a + b, lexicon), known(f"{a}-{b}", lexicon)
    if whole or compound:
        return whole >= compound
    if b[0].isupper():
        return False
    return not (known(a, lexicon) and known(b, lexicon))


_COMPOUND = re.compile(r"([^\W\d_]+)-([^\W\d_]+)")


def broken_ends(lines: list[str], run: set[int]) -> list[tuple[str, str, str, float]]:
    """(left piece, mark, next word, length of the line to that of full lines) of the body lines that end in a mark."""
    body = [s for i, s in enumerate(lines) if i not in run and s and not s.isspace()]
    width = full_width(lines)
    out = []
    for s, after in zip(body, body[1:]):
        last = s.split()[-1]
        if last[-1] in MARKS and len(last) > 1 and _LETTERS.search(last[-2]):
            out.append((last[:-1], last[-1], after.split()[0], len(s.strip()) / width))
    return out


def full_width(lines: list[str]) -> int:
    sizes = sorted(len(s.strip()) for s in lines if s and not s.isspace())
    return sizes[int(0.8 * (len(sizes) - 1))] or 1 if sizes else 1


class JoinModel:
    """Logistic classifier over a line that ends in a mark and the next line: whether the mark breaks a word.

    It goes by the counts of whole, compound and halves, the characters at the break, other compounds of the halves,
    the mark, and the length of the line.  Trained on line pairs of the corpus and on words and compounds of the
    lexicon broken on purpose, each with its counts and again without them, as words stand that are not in the lexicon.
    """

    def __init__(self, lexicon: dict[str, int], texts: list[str], w: np.ndarray, most: int = 3000, seed: int = 7):
        rng = random.Random(seed)
        self.memo: dict[tuple, bool] = {}
        self.looked: dict[str, tuple] = {}  # what look() gave for the tokens of the lexicon's texts
        self.heads: Counter = Counter()
        self.tails: Counter = Counter()
        parts, half = Counter(), Counter()
        compounds = []
        for word, n in lexicon.items():
            m = _COMPOUND.fullmatch(word)
            if m:
                compounds.append(word)
                self.heads[m[1].lower()] += 1
                self.tails[m[2].lower()] += 1
            for piece in word.split("-"):
                if piece:
                    parts[piece] += n
                    if not crc32(word.lower().encode()) % 2:
                        half[piece] += n
        self.chars = CharModel(half)  # words that are hidden below are not among its words
        by_count = lambda ws: sorted(ws, key=lambda x: (-lexicon[x], x))[:most]
        rows: list[tuple[tuple, float]] = []
        for t in texts:
            lines = t.split("\n")
            for end in broken_ends(lines, running_lines(lines, w)):
                a, b = halves(end[0], end[2])
                if b and b[0].isalpha() and (end[1] != "-" or bool(known(a + b, lexicon)) != bool(known(f"{a}-{b}", lexicon))):
                    rows.append((end, float(joins(*end[:3], lexicon))))
        shares = [end[3] for end, _ in rows] or [1.0]
        whole = []
        for word in by_count(x for x in lexicon if x.isalpha() and len(x) >= 4):
            cuts = range(2, len(word) - 1)
            whole.append((word, rng.choice(cuts)))
            words = [k for k in cuts if known(word[:k], lexicon) and known(word[k:], lexicon)]
            if words:
                whole.append((word, rng.choice(words)))
        rows += [((x[:k], "-", x[k:], rng.choice(shares)), 1.0) for x, k in whole]
        split = by_count(compounds)
        for x in split * max(1, len(whole) // (4 * len(split))) if split else ():
            a, b = x.split("-")
            rows.append(((a, "-", b, rng.choice(shares)), 0.0))
        both = []
        for end, y in rows:
            a, b = halves(end[0], end[2])
            both.append((self.features(*end, lexicon), y))
            if crc32((a + b if y else f"{a}-{b}").lower().encode()) % 2:
                both.append((self.features(*end, lexicon, True), y))
        self.chars = CharModel(parts)
        self.w: np.ndarray | None = None  # no example of either kind: the counts decide
        if len({y for _, y in both}) == 2:
            self.w = logistic(np.array([x for x, _ in both]), np.array([y for _, y in both]))

    def features(self, left: str, mark: str, right: str, share: float, lexicon: dict[str, int], hidden: bool = False) -> list[float]:
        a, b = halves(left, right)
        whole, compound, na, nb = known(a + b, lexicon), known(f"{a}-{b}", lexicon), known(a, lexicon), known(b, lexicon)
        own = bool(compound)
        if hidden:
            whole = compound = 0
        x, y, p = a.lower(), b.lower(), self.chars.p
        head = ("^^" + x)[-2:]
        inside = p.get(head + y[0], -8.0) + p.get((head[-1] + y + "$")[:3], -8.0)
        apart = p.get(head + "$", -8.0) + p.get("^^" + y[0], -8.0) + p.get(("^" + y + "$")[:3], -8.0)
        return [
            max(-4.0, min(4.0, math.log((whole + 0.5) / (compound + 0.5)))),
            float(whole > 0),
            float(compound > 0),
            float(na > 0),
            float(nb > 0),
            float(na > 0 and nb > 0),
            float(not (whole or compound) and na > 0 and nb > 0),
            float(mark in "‐‑"),
            float(mark in "¬\xad"),
            (inside - apart) / 8,
            self.chars(x + y) / 4,
            math.log1p(max(0, self.heads[x] - own)),
            math.log1p(max(0, self.tails[y] - own)),
            float(b[0].isupper()),
            float(a[:1].isupper()),
            min(len(a), 6) / 6,
            min(len(b), 6) / 6,
            min(share, 1.2),
            1.0,
        ]

    def __call__(self, left: str, mark: str, right: str, share: float, lexicon: dict[str, int]) -> bool:
        a, b = halves(left, right)
        if not a or not b or not b[0].isalpha():
            return False
        if self.w is None:
            return joins(left, mark, right, lexicon)
        key = (a, mark, b, round(share, 1))
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            got = self.memo[key] = float(np.dot(self.features(a, mark, b, key[3], lexicon), self.w)) > 0
        return got


def look(token: str, lexicon: dict[str, int]) -> tuple[tuple[str, str | None], ...]:
    """(word, right or None if yet unknown) of a token that is not in the lexicon as it stands."""
    c = core(token)
    if not c or known(c, lexicon) or _NUMBER.fullmatch(c):
        return ()
    fixed = number_of(c.strip("()[]"))
    if fixed:
        return ((c, fixed),)
    if len(c) > 1:
        return ((c, None), (c.strip("(["), None)) if c[0] in "([" and len(c) > 3 else ((c, None),)
    return ()


def examine(lines: list[str], body: list[int], width: int, lexicon: dict[str, int], model: JoinModel) -> tuple[set[int], list[tuple[int, str, str | None]]]:
    """(lines with a broken word, (line, word, right or None if yet unknown)), lines from 0; width is that of full lines."""
    broken: set[int] = set()
    odd: list[tuple[int, str, str | None]] = []
    looked = model.looked
    skip_first = False
    for k, i in enumerate(body):
        tokens = lines[i].split()
        if skip_first:
            tokens = tokens[1:]
        skip_first = False
        if tokens and tokens[-1][-1] in MARKS and len(tokens[-1]) > 1 and _LETTERS.search(tokens[-1][-2]) and k + 1 < len(body):
            nxt = lines[body[k + 1]].split()[0]
            left, mark = tokens[-1][:-1], tokens[-1][-1]
            skip_first = True
            if model(left, mark, nxt, len(lines[i].strip()) / width, lexicon):
                broken.add(i)
                whole = core(left + nxt)
                if not known(whole, lexicon):
                    odd.append((i, f"{left}\n{core(nxt)}", None))  # which line is wrong shows with the correction
            else:
                whole = core(f"{left}-{nxt}")
                if not known(whole, lexicon):
                    odd.append((i, f"{left}-\n{core(nxt)}", None))
            tokens = tokens[:-1]
        for t in tokens:
            if t not in lexicon:
                got = looked.get(t)
                if got is None:
                    if len(looked) > 200_000:
                        looked.clear()
                    got = looked[t] = look(t, lexicon)
                for word, right in got:
                    odd.append((i, word, right))
    return broken, odd


NOISE = "pdf_id bigint, line_no int, noise string, word string, right string, next_line int"


def scan_lines(ids: list[int], texts: list[str | None], w: np.ndarray, lexicon: dict[str, int], model: JoinModel) -> dict[str, list]:
    out = {k: [] for k in ("pdf_id", "line_no", "noise", "word", "right", "next_line")}

    def add(*row):
        for k, v in zip(out, row):
            out[k].append(v)

    def settle():
        solids, widths, x = features_of([lines for _, lines in docs])
        running, n = (_expand(x) @ w > 0).tolist(), 0
        for (i, lines), solid, width in zip(docs, solids, widths):
            own = running[n : n + len(solid)]
            n += len(solid)
            body = [k for k, r in zip(solid, own) if not r]
            broken, odd = examine(lines, body, width, lexicon, model)
            for k, r in zip(solid, own):
                if r:
                    add(i, k + 1, "running_line", None, None, None)
            for k in broken:
                add(i, k + 1, "hyphen", None, None, None)
            after = dict(zip(body, body[1:])) if odd else {}
            for k, word, right in odd:
                add(i, k + 1, "misread" if right else "unknown", word, right, after.get(k, k) + 1)

    docs, size = [], 0  # some thousand lines are looked at together
    for i, t in zip(ids, texts):
        if t and not t.isspace():
            docs.append((i, t.split("\n")))
            size += len(docs[-1][1])
            if size >= 8192:
                settle()
                docs, size = [], 0
    settle()
    return out


class Scans:
    """The models fitted to one corpus, and the tables they give."""

    def __init__(self, pdfs: DataFrame, max_sample: int = 400):
        """pdfs(pdf_id, content).  The line classifiers are trained on at most max_sample documents, taken by the hash of their id."""
        self.pdfs = pdfs.select("pdf_id", "content").where("pdf_id is not null and content is not null")
        spark = pdfs.sparkSession

        def count(texts):
            c = count_words(texts)
            return {"word": list(c), "n": list(c.values())}

        counts = map_batches(self.pdfs.select("content"), "word string, n bigint", count).groupBy("word").agg(F.sum("n").alias("n"))
        self.words = stored(counts, "words")
        total = self.words.agg(F.sum("n")).first()[0] or 0
        self.least = max(LEAST_COUNT, total // 1_000_000)  # of the lexicon that is broadcast
        self.rights = self.words.where(F.col("n") >= LEAST_COUNT)
        frequent = self.words.where(F.col("n") >= self.least)
        lexicon = dict(sorted((r[0], r[1]) for r in frequent.collect()))  # at most 10^6 entries, by the threshold
        few = self.words.where(F.col("n") < self.least).orderBy(F.xxhash64("word"), "word").limit(3000)
        rare = {r[0]: r[1] for r in few.collect()}
        ranker = train_ranker(lexicon, rare)
        self.corrections = stored(find_corrections(self.words, self.rights, ranker), "corrections")
        wrong = {r[0] for r in self.corrections.join(frequent, "word").select("word").collect()}
        good = {w: n for w, n in lexicon.items() if w not in wrong}
        ids = self.pdfs.select("pdf_id").distinct().orderBy(F.xxhash64("pdf_id"), "pdf_id").limit(max_sample)
        picked = self.pdfs.join(F.broadcast(ids), "pdf_id", "left_semi").dropDuplicates(["pdf_id"]).orderBy("pdf_id")
        sample = [r[1] for r in picked.collect()]
        weights = train_lines(sample)
        self.box = spark.sparkContext.broadcast((weights, good, JoinModel(good, sample, weights)))
        self.ranker = ranker

    def noise(self) -> DataFrame:
        """(pdf_id, line_no, noise, word, right) of every finding."""
        box = self.box
        marked = stored(map_batches(self.pdfs, NOISE, lambda ids, texts: scan_lines(ids, texts, *box.value)), "marked")
        plain = marked.where("noise != 'unknown'").select("pdf_id", "line_no", "noise", "word", "right")
        unknown = marked.where("noise = 'unknown'").withColumn("key", F.regexp_replace("word", "\n", ""))
        # words broken at a line end were not counted whole: they get candidates of their own
        split = unknown.where(F.col("word").contains("\n"))
        fresh = split.select(F.col("key").alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(self.words.select("word"), "word", "left_anti")
        more = find_corrections(fresh, self.rights, self.ranker)
        fixes = self.corrections.unionByName(more).withColumnsRenamed({"word": "key", "right": "fix"})
        found = unknown.drop("right").join(fixes, "key")
        cut = F.instr("word", "\n") - 1
        # a difference behind the break belongs to the next line
        head = F.expr("substring(key, 1, instr(word, '\n') - 1) = substring(fix, 1, instr(word, '\n') - 1)")
        line = F.when((cut > 0) & head, F.col("next_line")).otherwise(F.col("line_no"))
        return plain.unionByName(found.select("pdf_id", line.alias("line_no"), F.lit("misread").alias("noise"), "word", F.col("fix").alias("right")))

    def repaired(self) -> DataFrame:
        """(pdf_id, content): running lines cut, words joined and corrected, lines joined to paragraphs."""
        box = self.box
        fixes = self.noise().where("noise = 'misread'").select("pdf_id", F.struct("word", "right").alias("fix")).distinct()
        per = fixes.groupBy("pdf_id").agg(F.collect_list("fix").alias("fixes"))  # one document's words
        docs = self.pdfs.dropDuplicates(["pdf_id"]).join(per, "pdf_id", "left").select("pdf_id", "content", "fixes")

        def run(ids, texts, lists):
            weights, lexicon, model = box.value
            return {"pdf_id": ids, "content": [repair(t, {f["word"]: f["right"] for f in fs or ()}, weights, lexicon, model) for t, fs in zip(texts, lists)]}

        return map_batches(docs, "pdf_id bigint, content string", run)


def repair(text: str, fixes: dict[str, str], w: np.ndarray, lexicon: dict[str, int], model: JoinModel) -> str:
    lines = text.split("\n")
    run = running_lines(lines, w)
    width = full_width(lines)
    fixes = {k.replace("\n", ""): v for k, v in fixes.items()}

    def mend(token: str) -> str:
        c = core(token)
        for x in (c, c.strip("([")):
            if x in fixes:
                return token.replace(x, fixes[x], 1)
        return token

    out: list[list[str]] = [[]]
    pending: tuple[str, str, float] | None = None
    for i, line in enumerate(lines):
        if i in run:
            continue
        tokens = line.split()
        if not tokens:
            if out[-1] and pending is None and _STOP.search(out[-1][-1]) or (out[-1] and len(out[-1]) < 8):
                out.append([])
            continue
        if pending:
            left, mark, share = pending
            tokens[0] = left + tokens[0] if model(left, mark, tokens[0], share, lexicon) else f"{left}{mark}{tokens[0]}"
            pending = None
        if tokens[-1][-1] in MARKS and len(tokens[-1]) > 1 and tokens[-1][-2].isalpha():
            pending = tokens[-1][:-1], tokens[-1][-1], len(line.strip()) / width
            tokens = tokens[:-1]
        out[-1].extend(map(mend, tokens))
    if pending:
        out[-1].append("".join(pending[:2]))
    return "\n\n".join(" ".join(p) for p in out if p)
