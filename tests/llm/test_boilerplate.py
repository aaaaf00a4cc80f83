import numpy as np
import pytest

from lodeweave.llm import boilerplate as B

SENTENCE = "The town council met on Monday evening and talked for two hours about the new bridge over the river."


def page(k):
    return f"Home | News | Sports | Login\nYou may also like\nRead next: Why the garden closed {k}\n\nThe bridge of town {k}\nBy Anna Smith\n{SENTENCE}\n\nBackground\n{SENTENCE} {SENTENCE}\n- {k} red tulips, often\n- {k} roses\n{SENTENCE}\n\n{k} comments\nSign up for our newsletter\n© 2020 town. All rights reserved."


@pytest.fixture(scope="module")
def model():
    return B.train([(page(k), f"The bridge of town {k}") for k in range(60)])


def test_furniture_of_a_page(model):
    ((numbers, prob, lines),) = B.classify(model, [page(99)], ["The bridge of town 99"], B.Features())
    furniture = {x for x, p in zip(lines, prob) if p < 0.5}
    assert furniture == {"Home | News | Sports | Login", "You may also like", "Read next: Why the garden closed 99", "99 comments", "Sign up for our newsletter", "© 2020 town. All rights reserved."}
    assert numbers[:4] == [1, 2, 3, 5]


def test_messages_give_the_exact_marginals():
    rng = np.random.default_rng(3)
    soft = lambda m: np.log(m / m.sum(1, keepdims=True))
    m = B.TreeModel(rng.normal(size=B.Features.FORM + B.BUCKETS + 1), soft(rng.random((2, 2)) + 0.1), soft(rng.random((2, 2)) + 0.1))
    rows, block, pages = [[1, 2], [3], [4, 5], [6]], np.array([0, 0, 1, 1]), np.array([0, 0])
    got = m.marginals(rows, block, pages)
    z = m.evidence(rows)
    want, total = np.zeros(4), 0.0
    for root in (0, 1):
        for b in np.ndindex(2, 2):
            for y in np.ndindex(2, 2, 2, 2):
                p = np.prod([np.exp(m.page_block[root, s]) for s in b]) * np.prod([np.exp(m.block_line[b[block[i]], y[i]]) / (1 + np.exp(-z[i] if y[i] else z[i])) for i in range(4)])
                total += p
                want += p * np.array(y)
    assert got == pytest.approx(want / total, abs=1e-9)


def test_frame(spark, model):
    rows = [("t", 1, "The bridge of town 7", page(7)), ("t", 2, None, None), ("t", 3, "", " \n "), ("t", 4, None, SENTENCE), ("t", 5, None, page(1) + ("\n" + SENTENCE) * 5000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "table_name string, row_id bigint, title string, text string, line_no int")
    got = B.furniture_lines(df, model).collect()
    assert {(r.row_id, r.line_no) for r in got if r.row_id in (1, 4)} == {(1, n) for n in (1, 2, 3, 15, 16, 17)}
    bodies = {r.row_id: r.body for r in B.main_bodies(df, model).collect()}
    assert bodies[2] is None and bodies[3] is None and bodies[4] == SENTENCE and "comments" not in bodies[1] and "Background" in bodies[1]
    fitted = B.fit(df)
    assert fitted.weights.any() and B.label_lines(df.limit(0), fitted).count() == 0
    assert B.classify(B.train([]), ["a\nb"], [None], B.Features())[0][1].min() > 0.5


def test_messages_are_exact_on_deeper_trees():
    rng = np.random.default_rng(5)
    soft = lambda m: np.log(m / m.sum(1, keepdims=True))
    m = B.TreeModel(rng.normal(size=B.Features.FORM + B.BUCKETS + 1), soft(rng.random((2, 2)) + 0.1), soft(rng.random((2, 2)) + 0.1))
    rows, at, parent = [[1, 2], [3], [4, 5], [6]], np.array([2, 3, 3, 4]), np.array([-1, 0, 1, 1, 0])
    got, z = m.tree_marginals(rows, at, parent), m.evidence(rows)
    want, total = np.zeros(4), 0.0
    for nodes in np.ndindex(2, 2, 2, 2, 2):
        for y in np.ndindex(2, 2, 2, 2):
            p = np.prod([np.exp(m.page_block[nodes[parent[k]], nodes[k]]) for k in range(1, 5)])
            p *= np.prod([np.exp(m.block_line[nodes[at[i]], y[i]]) / (1 + np.exp(-z[i] if y[i] else z[i])) for i in range(4)])
            total += p
            want += p * np.array(y)
    assert got == pytest.approx(want / total, abs=1e-9)


HTML = f"<div id='wrap'><nav class='top-menu'><ul><li><a href='/'>Ants</a></li><li><a href='/b'>Bees</a></li></ul></nav><article><h2>Early days</h2><p>{SENTENCE}</p><p>Two\nlines</p></article>loose<div><div><div>deep</div></div></div></div>"


def test_lines_are_aligned_to_elements():
    page = B.parse(f"Ants\nBees\n\nEarly days\n{SENTENCE}\nTwo\nlines\nloose\ndeep\nnowhere", None, HTML)
    assert len(page.parent) > 6 and all(p < k for k, p in enumerate(page.parent))
    roots = [page.parent[k] for k in page.at]
    assert roots[0] == roots[1] != roots[2] and roots[2] == roots[3] == roots[4] and roots[8] == 0
    assert ".menu" in page.marks[0] and "links" in page.marks[0] and "<h2>" in page.marks[2] and not page.marks[8]
    assert B.parse("a", None, "<p>a<div><<").lines == ["a"]
    deep = B.parse("x", None, "<div>" * 5000 + "x")
    assert len(deep.parent) >= 1000


# Wordings that stand nowhere in the labelled examples.
UNSEEN = [
    "Our shop and its advertising partners would like to place cookies on your phone or computer so that we can measure visits, remember your choices and show you offers that fit your interests; you may refuse.",
    "You can refuse cookies in the settings at any time.", "Sign up for the weekly mail", "Share by email", "Also interesting: Nine rivers of the north", "17 reader comments", "© 2014 The Valley Post. No copying without permission.", "Privacy settings", "Scroll to top",
    "Teilen Sie diesen Beitrag", "Tous les commentaires", "Suscripción al boletín", "쿠키 설정",
]
BODY = [SENTENCE, "She baked cookies for the whole village and sold them at the market, and the children shared what was left.", "A year of drought", "- four large onions", "By Peter Hall", "Der Fluss stieg in der Nacht um zwei Meter an.", "Le vent venait du sud et la mer était calme."]


def test_wordings_that_are_not_among_the_examples():
    found = [B.seed_label(x, "", False) for x in UNSEEN]
    assert sum(y == 0 for y in found) >= 0.75 * len(UNSEEN) and 1 not in found[:1], [x for x, y in zip(UNSEEN, found) if y != 0]
    assert 0 not in [B.seed_label(x, "", False) for x in BODY]


def test_repeated_lines_of_unknown_wording_are_learnt():
    odd = "Zorbel quandary framps for 4 units"
    pages = [(f"{page(k)}\n{odd}" if k % 2 else page(k), f"The bridge of town {k}", None, f"site{k}") for k in range(60)]
    model = B.train(pages)
    ((_, prob, lines),) = B.classify(model, [f"{page(77)}\n{odd}"], ["The bridge of town 77"], B.Features())
    assert prob[lines.index(odd)] < 0.5 < prob[lines.index("Background")]
