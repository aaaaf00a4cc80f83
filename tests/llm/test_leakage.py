import numpy as np
from hypothesis import given, settings, strategies as st

from lodeweave.llm import leakage as L


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=80), st.lists(st.integers(1, 4), min_size=1, max_size=4))
def test_index_counts_and_locates(text, pattern):
    index = L.FMIndex(np.array(text), 4)
    lo, hi = np.array([0]), np.array([index.n])
    for c in reversed(pattern):
        lo, hi = index.step(np.array([c]), lo, hi)
    want = [i for i in range(len(text)) if text[i : i + len(pattern)] == pattern]
    assert sorted(index.locate(np.arange(lo[0], max(lo[0], hi[0]))).tolist()) == want


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega"


def brute(items, docs, least=12, share=0.5):
    out = set()
    for j, t in items:
        w = L.words(t or "")
        need = max(least, -(-len(w) // 2))
        grams = {tuple(w[k : k + need]) for k in range(len(w) - need + 1)}
        for i, d in docs:
            dw = L.words(d or "")
            if any(tuple(dw[k : k + need]) in grams for k in range(len(dw) - need + 1)):
                out.add((i, j))
    return out


def test_finds_what_brute_force_finds(spark):
    w = ITEM.split()
    docs = [
        (1, "x " + ITEM + " y"), (2, " ".join(w[:12])), (3, " ".join(w[:11])), (4, " ".join(w[:6] + ["other"] + w[6:])), (5, "**" + ", ".join(x.upper() for x in w[4:20]) + "**"), (6, "".join(f"<b>{x}</b>&nbsp;" for x in w[10:])),
        (7, None), (8, ""), (9, "al​pha be­ta " + "\n".join(w[2:14])), (10, " ".join(w * 3)), (10, " ".join(w * 3)), (11, "zz " * 30_000 + ITEM),
    ]
    items = [(1, ITEM), (2, None), (3, "too short"), (4, ITEM), (5, "entirely different words " * 6)]
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    spans = L.leaked_spans(d, i).collect()
    assert {(r.doc_id, r.item_id) for r in spans} == brute(items, docs)
    whole = [r for r in spans if r.doc_id == 1 and r.item_id == 1]
    assert [(r.first_word, r.last_word) for r in whole] == [(1, 24)]
    assert L.leaked_spans(d.limit(0), i).count() == 0 and L.leaked_spans(d, i.limit(0)).count() == 0
    parts = L.leaked_spans(d, i, part_chars=150)  # items on both sides of the bound
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, spans))


def test_spans_are_numbered_as_the_document_stands():
    w = ITEM.split()
    p = L.Phrases([(1, ITEM)])
    text = "aa bb cc-\ndd ee " + ITEM + " zz"
    found = L.find_in_shard(p, [7], [text])
    at = L.words(text).index("alpha")
    assert (found["first_word"].tolist(), found["last_word"].tolist()) == ([at], [at + 23])
    broken = "aa bb cc-\ndd " + " ".join(w[:11]) + " " + w[11][0] + "-\n" + w[11][1:] + " " + " ".join(w[12:]) + " zz"
    found = L.find_in_shard(p, [7], [broken])
    at = L.words(broken).index("alpha")
    assert (found["first_word"].tolist(), found["last_word"].tolist()) == ([at], [at + 24])  # one word stands in two pieces
    assert L.words("a\ue000b") == ["a", "b"]
