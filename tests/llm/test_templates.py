import pytest

from lodeweave.llm import templates as T

ARTICLE = "The town council met on Monday and talked about the bridge. " * 8


@pytest.mark.parametrize(
    "text, found",
    [
        ("Price: {{price}}", True), ("Hello ${user.name}, welcome", True), ("By <%= author %>", True), ("{% title %}", True), ("#{city} news", True), ("__TITLE__", True), ("%%city%%", True), ("@@name@@", True), ("[[title]]", True), ("[INSERT CITY HERE]", True), ("[Your company]", True),
        ("Date: {DATE}", True), ("<PHONE_NUMBER>", True), (ARTICLE + "It cost {price} more.", True), ("Write `{{ user.name }}` in the template", False), ("run <code>echo ${HOME}</code> now", False), ("Sets such as {a, b} belong here", False), ("if (a<b) { return; }", False), ("50% off, 20% more", False), ("an <b>bold</b> word", False), ("", False),
    ],
)
def test_slots(text, found):
    assert T.has_slot(text) is found


@pytest.mark.parametrize(
    "text, found",
    [
        ("Lorem ipsum dolor sit amet consectetur adipiscing elit.", True), (ARTICLE + "\n\nNostrud anim tempor esse enim viverra ullamco incididunt deserunt non.", True), ("undefined\n\nBy null on NaN/NaN/NaN\n\n[object Object]", True), ("TODO: add page text here.", True), ("This is a sample page. Replace this text with your own words.", True),
        ("여기에 들어갈 본문 내용을 입력하세요 임시 텍스트 문장입니다", True), (ARTICLE + "The designers still use lorem ipsum when they draft a layout.", False), (ARTICLE, False), (ARTICLE + " The value was null and undefined in one case.", False),
    ],
)
def test_filler(text, found):
    assert T.has_filler(text) is found


def test_tree_joins_messages_of_one_template():
    tree = T.PrefixTree()
    a, b = tree.add("Copy for Anna Smith today".split()), tree.add("Copy for Bert Jones today".split())
    assert a == b and tree.templates[a] == ["Copy", "for", T.WILD, T.WILD, "today"]
    assert tree.add("quite another set of words".split()) != a


def test_frame(spark):
    rows = [
        (1, ARTICLE, None), (2, "404 Not Found\n\nThe page you asked for does not exist.", None), (3, None, "http 404"), (4, None, "net::ERR_CONNECTION_RESET"), (5, None, "Please enable JavaScript to view this page."), (6, None, "net::${code}"), (7, None, None), (8, "", " "), (9, ARTICLE + "\nEnable JavaScript to load the comments.", None),
        (10, "Für die Anzeige dieser Seite muss JavaScript aktiviert sein.", None), (10, "Für die Anzeige dieser Seite muss JavaScript aktiviert sein.", None), (11, ARTICLE + " Access was denied to 5 hikers after the storm.", None), (12, "A short but real note about the garden.", None), (13, ARTICLE * 2000 + "{{slot}}", None),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "extract_id bigint, content string, error string, message string")
    assert sorted({r.extract_id for r in T.find_residue(df).collect()}) == [2, 5, 6, 10, 13]
    assert T.find_residue(df.limit(0)).count() == 0


def test_hot_message(spark):
    df = spark.range(30_000).selectExpr("id AS extract_id", "CAST(NULL AS string) AS content", "IF(id % 3 = 0, concat('Too many requests. Ray ID: ', id), 'http 500') AS error")
    assert T.find_residue(df).count() == 10_000


LONG = "404 Not Found. The page you requested could not be located on our web server. Please check the address or go back to the home page. "


@pytest.mark.parametrize("text, found", [("{{ " + "x" * 90 + " }}", True), ("[Insert " + "name of the city " * 10 + "here]", True), ("${" + "a.b" * 60 + "}", True), ("{" + "long_name" * 9 + "}", True), ("%" + "NAME_" * 20 + "%", True)])
def test_slots_of_any_length(text, found):
    assert T.has_slot(text) is found


# Wordings that stand nowhere in the labelled examples.
UNSEEN = [
    "This page needs JavaScript switched on.", "Please update your browser to view this website.", "The resource cannot be displayed.", "Error 521: web server is down", "Your IP has been temporarily blocked. Contact the site administrator.", "Cookies are turned off in your browser; please allow them for this site.",
    "We couldn't find the page. Try the search or return home.", "Sign in again, your session is no longer valid.", "The server is busy. Please try again in a moment.", "Bitte schalten Sie JavaScript ein, um die Seite zu sehen.", "La page demandée n'est plus disponible.", "La página solicitada no está disponible.", "요청한 페이지가 없습니다. 주소를 확인해 주세요.", "ページが存在しません。アドレスを確認してください。", LONG.strip(), LONG * 6,
]
ORDINARY = [
    "A short but real note about the garden.", "Tomato soup with basil and garlic", "The library will open again on Monday.", "He walked along the river until it was dark.", "Seven people came to the meeting.", "Das Museum zeigt alte Karten.", "Le marché ouvre en mai.", "농부는 올해 봄 채소를 찾아냈다.", "農家は今年の春、古い橋を修理した。",
    ARTICLE + "Access was denied to 5 hikers after the storm, and the page of the report was not found.", ARTICLE + "The browser needs JavaScript, the author explains, or the site shows an error.", ARTICLE * 40,
]


def test_unseen_wordings(spark):
    rows = [(i, t, None) for i, t in enumerate([*UNSEEN, *ORDINARY])] + [(1000 + k, ARTICLE + f"Sentence number {k} about trees.", None) for k in range(30)]
    got = {r.extract_id for r in T.find_residue(spark.createDataFrame(rows, "extract_id bigint, content string, error string")).collect()}
    want = set(range(len(UNSEEN)))
    assert len(got & want) >= 0.95 * len(want), [UNSEEN[i] for i in want - got]
    assert len(got & want) >= 0.95 * len(got), [([*UNSEEN, *ORDINARY] + [""] * 2000)[i] for i in got - want]


def test_templates_of_all_salts_are_merged_and_supported(spark):
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrst" for b in "klmnopqrstuvwxyz"]
    rows = [(i, f"Access denied for visitor {w}. You lack permission to open this resource.", None, f"https://h{i % 7}.test/x") for i, w in enumerate(words)]
    found = T.find_residue(spark.createDataFrame(rows, "extract_id bigint, content string, error string, url string")).collect()
    assert len(found) == len(rows) and len({r.template for r in found}) == 1


def test_mining_holds_templates_only(spark):
    n = 60_000  # messages of one part
    df = spark.range(n).selectExpr("concat('Error in module x', id, ' of the server') AS message", "'6|Error in module' AS leaf")
    assert [tuple(r) for r in T.mine_templates(df).groupBy("template").count().collect()] == [("Error in module <*> of the server", n)]
