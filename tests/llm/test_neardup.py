import itertools
import random

import numpy as np
import pytest

from lodeweave.llm import neardup as N

SMALL = {"slots": 1 << 18, "coarse": 1 << 12}


def texts(seed=4, groups=40, length=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    for g in range(groups):
        base = [r.choice(vocabulary) for _ in range(length)]
        for _ in range(r.choice((1, 1, 2, 3))):
            t = [*base]
            for _ in range(r.choice((0, 0, 1, 2, 4, 8, 12))):
                t[r.randrange(length)] = r.choice(vocabulary)
            if r.random() < 0.3:
                k = r.randrange(length)
                t = t[k:] + t[:k]
            rows.append(("content" if g % 2 else "description", i, " ".join(t)))
            i += 1
    return rows


def brute(rows, least, k=3, threshold=0.6):
    out, sets = set(), {}
    for f, i, t in rows:
        w = N.words(t) if t else []
        if i is not None and len(w) >= least[f]:
            sets[f, i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    for ((f, a), s), ((g, b), t) in itertools.combinations(sorted(sets.items()), 2):
        if f == g and len(s & t) >= threshold * len(s | t) - 1e-9:
            out.add((f, a, b))
    return out


def test_words():
    assert N.words(' "Hello,  wörld!" -- (B12) ... don\'t\tx_y_ ') == ["hello", "wörld", "b12", "don't", "x_y"]


def test_pack_round_trip_and_bits():
    s = N.Shingler().hashes([f"w{k}" for k in range(40)])
    assert (N.unpack(N.pack(s)) == s).all() and len(s) == 38
    sets = [N.Shingler().hashes([f"w{k}" for k in range(a, a + 200)]) for a in (0, 10, 5000)]
    bits = N.Shingler.bits(sets)
    same = lambda a, b: 128 - sum(int(x).bit_count() for x in (bits[a] ^ bits[b]))
    assert same(0, 1) > 110 and 40 < same(0, 2) < 88


def test_posterior_bound():
    m = [N.least_matches(n) for n in (32, 64, 96, 128)]
    assert m == sorted(m) and m[3] < 128 * 0.8
    rng = np.random.default_rng(5)
    assert (rng.binomial(128, 0.8, 100_000) < m[3]).mean() < 1e-3


def test_pairs_equal_brute_force(spark):
    least = {"content": 50, "description": 20}
    rows = texts()
    copies = [("content", 900 + k, rows[5][2]) for k in range(4)] + [(rows[6][0], 950, rows[6][2].upper() + " !")]
    odd = [("content", 800, None), ("content", 801, ""), ("content", 802, "too short"), ("content", 803, "a " * 30_000), ("content", 804, "a " * 30_001), (*rows[0][:2], rows[0][2])]
    every = rows + copies + odd
    df = spark.createDataFrame([(*r, 1) for r in every], "field_name string, id bigint, text string, rep int").where("text != ''")
    got = {tuple(r) for r in N.similar_pairs(df, least, **SMALL).collect()}
    assert got == brute(dict.fromkeys(every), least) and got
    groups = {(r.field_name, r.id): r for r in N.near_duplicate_groups(df, least, **SMALL).collect()}
    assert len(groups) == len({r[:2] for r in every if r[2]})
    parent = {k: k for k in groups}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for f, a, b in got:
        parent[root((f, a))] = root((f, b))
    classes = {}
    for k, g in groups.items():
        classes.setdefault((k[0], g.class_id), set()).add(root(k))
    assert all(len(v) == 1 for v in classes.values()) and len(classes) == len({root(k) for k in groups})


def test_empty_and_hot_copies(spark):
    df = spark.createDataFrame([], "field_name string, id bigint, text string")
    assert N.similar_pairs(df, {"content": 50}, **SMALL).count() == 0
    hot = spark.range(3000).selectExpr("'content' AS field_name", "id", "IF(id % 3 = 0, repeat('same words again and again ', 12), concat_ws(' ', transform(sequence(1, 60), k -> concat('u', xxhash64(id, k))))) AS text")
    g = N.near_duplicate_groups(hot, {"content": 50}, **SMALL)
    assert g.where("class_id = 0").count() == 1000 and g.count() == 3000


def test_groups_of_short_texts(spark):
    error = "Internal Server Error. The server could not answer this request, please try again later or write to us. Incident"
    rows = [(1, f"{error} 85aeea62."), (2, f"{error} 17bc03d9."), (3, f"{error} 85aeea62."), (4, "Read more"), (5, "Read more"), (6, "READ MORE…"), (7, "Read less"), (8, "---"), (9, "---"), (10, "***")]
    least = {"content": 0}
    df = spark.createDataFrame([("content", *r) for r in rows], "field_name string, id bigint, text string")
    got = {r.id: (r.class_id, r.links) for r in N.near_duplicate_groups(df, least, shingle=5, threshold=0.8, **SMALL).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (4, 1), 5: (4, 1), 6: (4, 1), 7: (7, 0), 8: (8, 0), 9: (8, 0), 10: (10, 0)}


def test_query_groups_texts_of_any_length(spark, tmp_path):
    from lodeweave.llm import queries

    hits = [(1, "two words"), (2, "two words"), (3, "other words")]
    spark.createDataFrame(hits, "hit_id bigint, description string").write.parquet(str(tmp_path / "search_hit.parquet"))
    spark.createDataFrame([(1, "one short line of text"), (2, "one short line of text")], "extract_id bigint, content string").write.parquet(str(tmp_path / "extract_result.parquet"))
    got = {(r.field_name, r.id): r.class_id for r in queries.p2_groups(spark, str(tmp_path)).collect()}
    assert got == {("description", 1): 1, ("description", 2): 1, ("description", 3): 3, ("content", 1): 1, ("content", 2): 1}


@pytest.mark.parametrize("k, threshold", [(5, 0.8)])
def test_default_of_stages(spark, k, threshold):
    least = {"content": 50, "description": 50}
    rows = texts(9)
    df = spark.createDataFrame(rows, "field_name string, id bigint, text string")
    assert {tuple(r) for r in N.similar_pairs(df, least, shingle=k, threshold=threshold, **SMALL).collect()} == brute(rows, least, k, threshold)


def test_long_lists_meet_in_blocks(spark):
    """A third of all texts share their rarest shingles' lists; lists of more than eight postings are met in blocks."""
    least = {"content": 50, "description": 20}
    rows = texts(4)
    stem = "every one of these texts begins with the same long sentence about the weather in the north"
    rows += [("content", 5000 + k, f"{stem} " + " ".join(f"w{(k * 7 + j) % 40}" for j in range(50))) for k in range(len(rows) // 2)]
    df = spark.createDataFrame(rows, "field_name string, id bigint, text string")
    want = brute(rows, least)
    assert {tuple(r) for r in N.similar_pairs(df, least, **SMALL, least=8).collect()} == want and want
    reps, pairs = N.similar_representatives(df, least, **SMALL, least=1)
    assert pairs.count() == N.similar_representatives(df, least, **SMALL)[1].count()


def test_copies_stand_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "MEMBERS", 3)
    a, b = " ".join(f"w{j}" for j in range(60)), " ".join(f"w{j}" for j in range(58)) + " x y"
    rows = [("content", k, a) for k in range(10)] + [("content", 100 + k, b) for k in range(7)] + [("content", 200, a + " tail")]
    df = spark.createDataFrame(rows, "field_name string, id bigint, text string")
    got = [tuple(r) for r in N.similar_pairs(df, {"content": 50}, **SMALL).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, {"content": 50})
