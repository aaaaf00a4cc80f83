import pytest

from lodeweave.llm import encoding as E

CLEAN = [
    "Café près de l’hôtel « où » l’été — 21 °C, £35, 3 × 4, ½ prix, naïve", "A FUNDAÇÃO de São Paulo não achou o coração à beira do açude. EM SÃO", "Für Gäste über Nacht, Äcker größer. Straße “Nicht”", "El niño cambió la montaña, ¿señor? Según él", "농부는 올해 봄 Braststow에서 채소를 찾아냈다.", "昨日、図書館は新しい規則を修理した。「はい」・ー",
    "Весной институт проверил старую дорогу у реки. В субботу", "Łąkowo – Øster Lundby | Åse", "Δx = 5 µm, ±2 ≥ 1", "plain ASCII", "ελληνικά κείμενο",
]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_of_any_language_stays(text):
    assert E.examine([text]) == [None]


ROUND = [
    ("El niño cambió la montaña, según él y con mucha atención", "utf-8", "cp1252"), ("Für Gäste über Nacht größer", "utf-8", "latin-1"), ("The town’s café – “Not yet", "utf-8", "cp1252"), ("naïve · jalapeño £35", "utf-8", "mac_roman"), ("naïve · jalapeño", "utf-8", "cp437"), ("Früher die Universität größer", "utf-8", "cp850"),
    ("Театр построил тёплый зал без объяснений", "utf-8", "cp1251"), ("Музей сохранил зимний сад для детей", "cp1251", "latin-1"), ("시청은 오늘 아침 검색 결과를 말대로 확인했다", "cp949", "latin-1"), ("農家は今年の春、古い橋を静かに修理した。", "utf-8", "latin-1"),
]


@pytest.mark.parametrize("text, written, read", ROUND)
def test_round_trip(text, written, read):
    (found,) = E.examine([text.encode(written).decode(read)])
    assert found == (text, True)


@pytest.mark.parametrize("text, written, read", [("The town’s answer came late.", "utf-8", "cp850"), ("I don’t know what they’re doing", "mac_roman", "cp1252"), ("the café, the résumé, the fiancé", "cp1252", "mac_roman"), ("the café, the résumé, the fiancé", "cp1252", "cp850")])
def test_capitals_left_by_a_misreading(text, written, read):
    assert E.examine([text.encode(written).decode(read)]) == [(text, True)]


@pytest.mark.parametrize("text", ["MÜNCHEN UND KÖLN, ÄÖÜ", "PÃO DE AÇÚCAR; AÇÃO; CORAÇÕES; ÀS; ÇA", "L'École d'Évora, Àvila. LÁ, É, Ô!"])
def test_capitals_of_clean_text_stay(text):
    assert E.examine([text]) == [None]


def test_garbled_twice():
    once = "Gärtnerin für 30 €".encode().decode("cp1252")
    twice = once.encode().decode("cp1252", "replace")
    (found,) = E.examine([twice])
    assert found is not None
    assert E.examine([once]) == [("Gärtnerin für 30 €", True)]


def test_long_text_is_labelled_in_pieces():
    text = "El niño cambió la montaña, según él. " * 3000
    assert E.examine([text.encode().decode("latin-1")]) == [(text, True)]


def test_lost_characters_are_found_but_not_whole():
    (found,) = E.examine(["the caf�� by the quay"])
    assert found[1] is False


def test_frame(spark):
    bad = "jalapeño".encode().decode("latin-1")
    rows = [(1, bad, None), (2, None, bad), (3, "clean café", "x"), (4, None, None), (5, "", " "), (1, bad, None), (6, "word " * 50_000 + bad, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "extract_id bigint, content string, title string, is_whole int")
    got = E.find_garbled(df).distinct().collect()
    assert sorted((r.extract_id, r.field_name) for r in got) == [(1, "content"), (2, "title"), (6, "content")]
    assert {r.restored for r in got if r.extract_id < 3} == {"jalapeño"}
    assert E.find_garbled(df.limit(0)).count() == 0
