import random

import numpy as np
import pytest

from lodeweave.llm import scans as S

WORDS = "the garden river council bridge evening members report schedule question although between different important morning yellow purple village machine letter picture window station mountain teacher doctor library history science".split()


def text(seed, n=60):
    r = random.Random(seed)
    out = []
    for _ in range(n // 6):
        s = " ".join(r.choice(WORDS) for _ in range(6))
        out.append(s[0].upper() + s[1:] + ".")
    return " ".join(out)


def wrapped(t, width=60):
    import textwrap

    return textwrap.wrap(t, width, break_on_hyphens=False)


def corpus():
    docs = []
    for k in range(80):
        lines = wrapped(text(k, 240))
        lines = [*lines[:6], f"Page {k % 9 + 1} of 12", "JOURNAL OF THE RIVER", *lines[6:12], f"Page {k % 9 + 2} of 12", "JOURNAL OF THE RIVER", *lines[12:]]
        docs.append((k, "\n".join(lines)))
    return docs


def test_qgram_and_differences():
    assert S.qgrams("abc") == ["^a", "ab", "bc", "c$"] and S.differing("surpriscd", "surprised") == (7, "c", "e") and S.differing("cletail", "detail") == (0, "cl", "d")
    assert S._visual("cl", "d") == 0.3 and S._visual("", "x") == 1.0 and S._visual("a", "a") == 0.0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    assert ((S.BoostedTrees().fit(x[:600], y[:600])(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def test_ranker_on_held_out_words():
    lexicon = {w: 5000 - 7 * i for i, w in enumerate(WORDS)}
    forest, model = S.train_ranker(lexicon, ["Brumel", "Tarvo", "Kilden"])
    rng = random.Random(99)
    ok = n = 0
    for c in WORDS:
        w = S.misread(c, rng)
        if w and w not in lexicon:
            n += 1
            ok += forest(np.array([S.pair_features(w, c, 1, lexicon[c], model)]))[0] > 0.5
    assert ok >= 0.9 * n


def test_candidates_at_every_size_of_the_corpus(spark):
    lexicon = {w: 4000 - 7 * i for i, w in enumerate(WORDS)} | {"now": 300, "how": 2700}
    wrong = {"br1dge": ("bridge", 60), "quest1on": ("question", 45), "irnportant": ("important", 80), "Kolvarn": ("Kolvam", 30)}
    got = []
    for times in (1, 10, 100):
        right = {w: n * times for w, n in lexicon.items()} | {"Kolvam": 150 * times}
        words = right | {w: max(1, right[c] // r) for w, (c, r) in wrong.items()}
        frame = lambda d: spark.createDataFrame(list(d.items()), "word string, n bigint")
        ranker = S.train_ranker(right, {})
        got.append({r.word: r.right for r in S.find_corrections(frame(words), frame(right), ranker).collect()})
        assert S.enough(words["br1dge"], right["bridge"])
    assert got[0] == got[1] == got[2] and got[0]["br1dge"] == "bridge" and got[0]["quest1on"] == "question" and "now" not in got[0]


def test_numbers():
    assert S.number_of("l98O") == "1980" and S.number_of("B12") is None or S.number_of("B12") == "812"
    assert S.number_of("3g7") == "397" and S.number_of("abc") is None and S.number_of("123") is None


def test_joins():
    lex = {"bridge": 50, "rain-barrel": 40, "rain": 40, "barrel": 40, "playground": 9}
    assert S.joins("brid", "-", "ge", lex) and S.joins("playgr", "-", "ound", lex)
    assert not S.joins("rain", "-", "barrel", lex) and S.joins("xy", "¬", "zz", lex) and not S.joins("brid", "-", "", lex)


HEADS, TAILS = "rain garden river stone well long short late".split(), "barrel gate bank wall term dated fed drained".split()
WHOLES = "overcame overgrown overland overload overlap overcast overhead overtake income outcome become welcome became residue subdue pursue tissue within without outside output outline outlook inside insight midway midnight undergo".split()


def test_join_classifier_on_words_the_lexicon_lacks():
    lexicon = {w: 400 - k for k, w in enumerate(WORDS + WHOLES)} | dict.fromkeys("over look come out in side with and for".split() + HEADS + TAILS, 300)
    lexicon |= {f"{a}-{b}": 60 for i, a in enumerate(HEADS) for j, b in enumerate(TAILS) if (i + j) % 3}
    model = S.JoinModel(lexicon, [], S.train_lines([]))
    assert not S.joins("over", "-", "look", lexicon) and model("over", "-", "look", 1.0, lexicon)
    assert not model("garden", "-", "look", 1.0, lexicon)
    assert model("brid", "-", "ge", 1.0, lexicon) and not model("rain", "-", "gate", 1.0, lexicon) and not model("brid", "-", "", 1.0, lexicon)


def test_frame(spark):
    docs = corpus()
    lines = docs[3][1].split("\n")
    bad = [*lines]
    at = next(i for i, x in enumerate(lines) if "important" in x)
    bad[at] = bad[at].replace("important", "imp0rtant")
    cut = next(i for i, x in enumerate(lines[:-1]) if i != at and i + 1 != at and lines[i + 1][:1].islower() and len(lines[i + 1].split()[0]) > 5 and "Page" not in x and "JOURNAL" not in x)
    first, rest = lines[cut + 1].split(" ", 1)
    bad[cut], bad[cut + 1] = f"{bad[cut]} {first[:3]}-", f"{first[3:]} {rest}"
    rows = [*docs, (100, "\n".join(bad)), (101, None), (102, "  \n"), (100, "\n".join(bad)), (103, text(5, 12_000))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "pdf_id bigint, content string, noise string")
    s = S.Scans(df)
    got = {(r.line_no, r.noise) for r in s.noise().where("pdf_id = 100").collect()}
    running = {(i + 1, "running_line") for i, x in enumerate(bad) if x.startswith(("Page ", "JOURNAL"))}
    assert got == running | {(at + 1, "misread"), (cut + 1, "hyphen")}
    fixed = {r.pdf_id: r.content for r in s.repaired().collect()}
    assert len(fixed) == len({r[0] for r in rows if r[1] is not None})
    assert fixed[100] == fixed[3] and "Page" not in fixed[100] and "important" in fixed[100]


def test_right_forms_below_the_broadcast_lexicon(spark, monkeypatch):
    rows = [(k, x) for k, x in corpus()] + [(200 + k, "The wonderful marmalade of yesterday.") for k in range(6)] + [(300, "The wonderful rnarmalade of yesterday.")]
    df = spark.createDataFrame(rows, "pdf_id bigint, content string")
    whole = S.Scans(df)
    monkeypatch.setattr(S, "max", lambda *a: 50 if len(a) == 2 and a[0] == 4 else max(*a), raising=False)  # as N / 10^6 is in a large corpus
    cut = S.Scans(df)
    assert cut.least == 50 and whole.least == 4
    found = lambda s: {(r.word, r.right) for r in s.corrections.where("right = 'marmalade'").collect()}
    assert found(cut) == found(whole) == {("rnarmalade", "marmalade")}


def test_empty(spark):
    df = spark.createDataFrame([], "pdf_id bigint, content string")
    assert S.Scans(df).noise().count() == 0
    with pytest.raises(Exception):
        S.Scans(df.drop("content"))


def test_rarest_grams_lose_no_candidate():
    """Words that differ by one confusion share one of the q-grams by which the first is looked up."""
    counts = np.random.default_rng(2).integers(0, 50, S.GRAMS)
    for right in ("rn", "of", "the", "come", "modern", "corner", "learning", "wild", "hill", "communication"):
        for a, b in sorted(S._VISUAL):
            for i in range(len(right)):
                if right.startswith(a, i):
                    w = right[:i] + b + right[i + len(a) :]
                    if len(w) >= S.SHORTEST and w.lower() != right.lower() and abs(len(w) - len(right)) <= 1 and S.alike(w, right):
                        q = 2 if len(w) <= 5 else 3
                        assert set(S.rarest(w, counts)) & set(S.qgrams_of(right, q)), (w, right)


def test_words_of_two_letters_and_short_names(spark):
    text = "He went home of course, and many of them were out of work in the town. Anna met Bert. " * 30
    rows = [(k, text) for k in range(20)] + [(99, "many 0f them\nBerl was out")]
    found = S.Scans(spark.createDataFrame(rows, "pdf_id bigint, content string")).noise().where("noise = 'misread' and pdf_id = 99").collect()
    assert ("0f", "of") in {(r.word, r.right) for r in found}


ODD = ["", " \n ", "\n\nabc\n", "A", "x-\n", "-\n-\nfoo-\nbar", "No. 5\nVol 3\nwww.Foo.COM\nÉtude no. 4\nſsue. doi", "[12]\n(3)\n\n", ")\n)]\n”", "　x\x1c\ny\n", "Word " * 40 + "\nword " * 3, "The River Report  7\nrain-\nbarrel l98O\n\nThe River Report  9\n(come l98O"]


def test_documents_are_looked_at_together():
    """The same rows as one by one, with each different token looked up once and the features of many documents in one matrix."""
    texts = [*ODD, *(x for _, x in corpus())] * 3
    lexicon, w = dict.fromkeys(WORDS[5:], 9), S.train_lines(texts)
    model = S.JoinModel(lexicon, [], w)
    single = [row for k, x in enumerate(texts) for row in zip(*S.scan_lines([k], [x], w, lexicon, model).values())]
    x = np.vstack([S.line_features(t.split("\n")) for t in texts])
    assert (S.features_of([t.split("\n") for t in texts])[2] == x).all() and len(x) > 3000

    model, calls = S.JoinModel(lexicon, [], w), dict.fromkeys(("core", "_expand"), 0)
    with pytest.MonkeyPatch.context() as m:
        for name in calls:
            m.setattr(S, name, lambda *a, f=getattr(S, name), name=name: calls.update({name: calls[name] + 1}) or f(*a))
        got = S.scan_lines(list(range(len(texts))), texts, w, lexicon, model)
    assert list(zip(*got.values())) == single and {r[2] for r in single} == {"running_line", "hyphen", "misread", "unknown"}
    broken = sum(n == "hyphen" for n in got["noise"])
    assert calls["_expand"] <= 2 and calls["core"] <= len({t for x in texts for t in x.split()}) + 6 * broken + 50


def test_signs_of_issues_and_counts_by_line():
    for line in (y for x in (*ODD, "a no. 5", "know 5", "no schedule", "-.com", "a-.com x", "_.net", "--.org", "Preprint", "preprints", "The Annals of", "annalsof", "© x", "BD l", "tome, 3", "İSSN", "accepted manuscript") for y in x.split("\n")):
        assert S.issue(line) == (S._ISSUE.search(line) is not None), line
    assert S.count_words(["a b-\nc d e\n\nf-\ng h", "a b-\n\nc-\nd e", None, "l98O (come 12 -"]) == {"a": 2, "d": 2, "e": 2, "h": 1, "l98O": 1, "(come": 1}


def test_cost_of_a_misreading():
    def plain(x, y):
        best = {(0, 0): 0.0}
        for i in range(len(x) + 1):
            for j in range(len(y) + 1):
                for a in range(min(i, 2) + 1):
                    for b in range(min(j, 2) + 1):
                        p, q = x[i - a : i], y[j - b : j]
                        cost = 0.0 if a == b == 1 and p == q else 0.3 if (p, q) in S._VISUAL or (q, p) in S._VISUAL else 1.0 if a <= 1 and b <= 1 and a + b else None
                        if cost is not None:
                            best[i, j] = min(best.get((i, j), 99.0), best[i - a, j - b] + cost)
        return best[len(x), len(y)]

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("rnmcldvwhi1l0OoeEf") for _ in range(rng.randrange(6)))
    for x, y in [(word(), word()) for _ in range(3000)] + sorted(S._VISUAL):
        assert S._visual(x, y) == plain(x, y), (x, y)
