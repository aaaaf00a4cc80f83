"""How much of planted text comes back: short texts of six kinds through every declared pair."""

from collections import Counter

import pytest

from lodeweave.llm import encoding as E

TEXTS = {
    "latin": ["El niño cambió la montaña", "según él y con atención", "Für Gäste über Nacht größer", "le café était fermé", "déjà vu à l’hôtel", "coração não está aqui", "El jalapeño añejo"],
    "ru": ["Театр построил тёплый зал", "Музей сохранил сад", "Весной институт", "новости дня", "старую дорогу у реки"],
    "ko": ["시청은 오늘 아침", "검색 결과를 확인했다", "농부는 올해 봄", "도서관 규칙", "채소를 찾아냈다"],
    "ja": ["農家は今年の春", "古い橋を静かに", "図書館は新しい規則を", "修理した。", "トマトを買う"],
    "zh": ["农民今年春天", "图书馆的新规则", "修理了旧桥", "今天上午的结果", "我们都很高兴"],
    "el": ["Το θέατρο έχτισε", "νέα της ημέρας", "ο παλιός δρόμος"],
}
LANGUAGE = {"cp949": "ko", "euc_jp": "ja", "cp932": "ja", "gbk": "zh", "big5": "zh", "cp1251": "ru", "koi8_r": "ru", "cp866": "ru", "iso8859_7": "el"}
TRADITIONAL = str.maketrans("农图书馆规则旧桥结们兴", "農圖書館規則舊橋結們興")


def planted():
    for written, read in E.PAIRS:
        for kind in TEXTS if written == "utf-8" else [LANGUAGE.get(written, "latin")]:
            for text in TEXTS[kind]:
                for t in (text, text.split()[0], f"{text}. {TEXTS[kind][0]}"):
                    t = t.translate(TRADITIONAL) if written == "big5" else t
                    try:
                        garbled = t.encode(written).decode(read)
                    except UnicodeError:
                        continue
                    if garbled != t:
                        yield (written, read), t, garbled


def test_restored_exactly_and_never_called_whole_when_wrong():
    n: Counter = Counter()
    per: dict[tuple, list[bool]] = {}
    for pair, text, garbled in planted():
        (found,) = E.examine([garbled])
        right = found is not None and found[0] == text
        n["all"] += 1
        n["right"] += right
        n["wrong whole"] += found is not None and found[1] and not right
        per.setdefault(pair, []).append(right)
    assert n["right"] >= 0.8 * n["all"] and n["wrong whole"] <= 0.001 * n["all"], n
    for pair, got in per.items():
        if pair[0] == "utf-8" and pair[1] not in ("cp932", "gbk", "cp949"):
            assert sum(got) >= 0.9 * len(got), pair


@pytest.mark.parametrize("read", ["cp1252", "latin-1"])
@pytest.mark.parametrize("kind", TEXTS)
def test_misread_twice_comes_back(kind, read):
    for text in TEXTS[kind]:
        try:
            garbled = text.encode().decode(read).encode().decode(read)
        except UnicodeError:
            continue
        assert E.examine([garbled]) == [(text, True)]


def test_misread_three_times_comes_back():
    garbled = "El niño cambió la montaña"
    for _ in range(3):
        garbled = garbled.encode().decode("latin-1")
    assert E.examine([garbled]) == [("El niño cambió la montaña", True)]


def test_clean_texts_of_all_kinds_stay():
    assert E.examine([t for ts in TEXTS.values() for t in ts]) == [None] * sum(map(len, TEXTS.values()))


def test_pieces_end_between_runs():
    text = "é" * (E.PIECE + 50) + " a" + "ö" * 30
    parts = E._pieces(text)
    assert [a for a, _ in parts[1:]] == [b for _, b in parts[:-1]] and all(not text[a - 1].isalpha() or text[a] < "\x80" for a, _ in parts[1:])
    long = "niño montaña " * 4000
    assert E.examine([long.encode().decode("latin-1")]) == [(long, True)]


def test_frequencies():
    f = E.Frequencies({"가": 900, "나": 100})
    assert f("가") < f("나") < f("뷁") and f("a") == 0.0
    assert E.Frequencies()("的") < E.Frequencies()("犲")
