import numpy as np
import pytest

from lodeweave.llm import prose, prose as P

PROSE = "The committee met in the old hall on Monday, and most of the members were there. They had read the report before, so the talk was short. "
CASES = [
    (PROSE * 2, True), (PROSE.upper() * 2, True), ("\n".join(f"{k}. {s}." for k, s in enumerate((PROSE * 2).split(". ")[:-1], 1)), True), (PROSE.lower().replace(".", "").replace(",", "") * 2, True),
    ("Die Behörde plante die Brücke mit der Firma, und das Museum war nicht in der Nähe der Straße. " * 2, True), ("농부는 올해 봄 겨울 채소를 강가에서 찾아냈다. 의사는 이번 달부터 낡은 다리를 지켰다. " * 2, True), ("昨日、図書館は新しい規則を静かに修理した。先週、委員会が長い一覧を公開した。" * 2, True),
    ("Недавно институт построил тёплый зал вместе с помощниками. Город закрыл весь урожай для детей и не был у реки. " * 2, True),
    ("a,b,c\n" + "\n".join(f"x{k},{k * 7},{k}%" for k in range(40)), False), ("\n".join(f"* red apple {k}" for k in range(30)), False), ("\n".join(f"    at a.b (/srv/x.js:{k}:1)" for k in range(20)), False),
    (".c1{margin:2px;color:#fff}\n" * 20, False), ("aGVsbG8gd29ybGQ" * 40, False), ("\n".join(f"[x{k}](https://a.test/{k})" for k in range(20)), False),
]


@pytest.mark.parametrize("text, is_prose", CASES)
def test_profiles(text, is_prose):
    assert (prose.describe([text])["prose_share"][0] >= 0.5) is is_prose


def test_counts():
    o = prose.describe(["One two.\nthree", None, " \n", "!!! {} x"])
    assert o["word_count"] == [3, 0, 0, 3] and o["mean_word_length"][:3] == [4.0, None, None]
    assert o["ended_line_share"][0] == 0.5 and o["profile"][1:3] == ["empty", "empty"] and o["prose_share"][2] is None
    assert o["symbol_ratio"][3] > 0.2


def test_mixed_texts_go_by_characters():
    table = "\n".join(f"name{k} | {k} | {k * 3}%" for k in range(60))
    assert prose.describe([PROSE + "\n\n" + table])["prose_share"][0] < 0.5 < prose.describe([PROSE * 20 + "\n\n" + table])["prose_share"][0]


def test_frame(spark):
    df = spark.createDataFrame([(1, PROSE, "z"), (2, None, "z"), (2, None, "z"), (3, "", "z"), (4, PROSE * 3000, "z")], "doc_id bigint, text string, is_prose string")
    rows = prose.text_statistics(df).collect()
    assert len(rows) == 5 and {r.doc_id: r.is_prose for r in rows} == {1: True, 2: None, 3: None, 4: True}
    assert prose.text_statistics(df.limit(0)).count() == 0


def test_fitted_profiles():
    english = "The river was high in the night, and the people of the town had to leave their houses because of it. They were tired. " * 20
    korean = "시청은 오늘 아침 검색 결과를 확인했다. 농부는 올해 봄 도서관에서 채소를 찾아냈다. " * 20
    table = "1204 | 33.5 | 17\n" * 50
    words, chars = P.fit_profiles([("prose", "en", english), ("prose, hangul", "ko", korean), ("table", None, table), ("prose", "en", " ")])
    for lang, got in words.items():
        assert abs(sum(got) - 1) < 0.01 and P.divergence(np.array([got]), np.array([P.PROSE[lang]]))[0, 0] < 0.12
        near = {k: P.divergence(np.array([got]), np.array([v]))[0, 0] for k, v in P.PROSE.items()}
        assert near[lang] <= min(near.values()) + 0.06
    assert abs(sum(chars["table"]) - 1) < 0.01 and chars["table"][P.CLASSES.index("digit")] > 0.4
    assert P.fit_profiles([]) == ({}, {})
