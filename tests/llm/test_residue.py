import random
import re
from re import _parser

import pytest
from pyspark.sql import types as T

from sigmill.llm import residue

LEFT_OVER = {
    "placeholder": [
        "# {{ your_name }}", "Contact {{dataset}} for questions.", "The goal is {% block title %}{% endblock %}.", "by <% client %>", "${objective}", "#{summary}", "@@description@@", "&&TEAM&&",
        "<<VERSION>>", "About %PROJECT_NAME%", "[[project_name]]", "__DEADLINE__", "Author: XX_TEAM_XX", "In this lesson, {dataset}, we go on.", "[deadline goes here]", "[INSERT AUTHOR HERE]",
        "(TBD: course id)", "<your project name>", "| data | {{cookiecutter.email}} |",
    ],
    "dummy": ["Lorem ipsum dolor sit amet.", "Dummy content. Dummy content.", "Your text here.", "Click to edit this cell.", "asdf asdf asdf", "To be replaced before publishing.", "Filler, filler.", "Type your answer here, then delete this line.",
              "sed plavit ipsa nulle ipsa palor vestra tincor valis negro valis nulle eda"],
    "error": ["503 Service Temporarily Unavailable\nPlease come back in a few minutes.", "Oops, 404. the link has expired!", "(500) we hit a snag.\nGo back to the start page.", "Access denied\nYou need permission to open /a/b.ipynb. Error e68f595a",
              "<html><head><title>403 Forbidden</title></head><body><center>403 Forbidden</center></body></html>", "Seite nicht gefunden – zurück zur Startseite", "ページが見つかりません（bd202272）", "Página no encontrada\nLa dirección /u/1/x.ipynb no existe."],
    "scripts": ["Please enable JavaScript to view this notebook.", "Bitte aktivieren Sie JavaScript, um das Notizbuch anzuzeigen.", "Loading widget… (scripts are turned off)", "For the full viewer, turn your script blocker off!",
                "JavaScript is required. Turn it on in your browser settings and reload.", "Votre navigateur bloque les scripts ; activez-les pour afficher cette page."],
}
FINE = [
    "If the request returns 404 we skip that basket and retry after 702 seconds.",
    "Status 404 means that the cohort page is gone, 503 that the upstream is down: we count both per cohort.",
    "The template below uses `{{ cell }}` markers; `render()` replaces each of them, see the output.",
    "Cells marked `<TITLE>` in the shelf form were filled by the script above; 7 are done.",
    "Shell expands `${HOME}` before the ledger loader starts, so quote it.",
    "Sites that say “please enable JavaScript” were scraped with a browser instead (12 of them).",
    "Our detector for lorem-style dummy paragraphs finds 5 of the tile pages, which is odd.",
    "TODO later: pivot again once the ticket export is fixed.",
    "We compare $x_{i}$ with \\frac{a}{b} for all 500 rows.",
    "```\n{{ name }}\n```",
    "shareの値が7を超えたので、もう一度確認してください。結果は少しおかしいです（4件）。",
    "",
]


@pytest.mark.parametrize("kind, cell", [(k, c) for k, cells in LEFT_OVER.items() for c in cells])
def test_left_over_cells(kind, cell):
    assert residue.cell_case(cell) == kind
    script = "# %% [markdown]\n" + "\n".join("# " + line for line in cell.split("\n"))
    assert residue.cell_case(script) == kind


@pytest.mark.parametrize("cell", FINE)
def test_cells_that_only_write_about_it(cell):
    assert residue.cell_case(cell) is None


SHORT = {
    "placeholder": ["< insert name >", "( TBD: course id)", "[ tbc ]"],
    "dummy": ["Describe results below.", "Blind copy"],
    "error": ["The page you requested has been removed.", "This file was deleted.", "Please sign in.", "Something failed.", "Something is broken.", "The server could not answer.", "Payload too large", "THE PAGE WAS DELETED.", "Thıſ fİle waſ deleted."],
    "scripts": ["Please disable your ad blocker.", "Turn off the ad-blocker."],
}


@pytest.mark.parametrize("kind, cell", [(k, c) for k, cells in SHORT.items() for c in cells])
def test_a_short_cell_alone(kind, cell):
    assert residue.cell_case(cell) == kind


MENU = "Home | Products and services | Prices | Contact us | Imprint | Terms of use | Privacy\n" * 6
LONG_PAGES = {
    "error": MENU + "404 Not Found\nThe page you requested does not exist.\n" + MENU,
    "scripts": MENU + "Please enable JavaScript to view this page.\nCookies are required too.\n" + MENU,
}


@pytest.mark.parametrize("kind", LONG_PAGES)
def test_a_whole_page_with_menus_has_any_length(kind):
    assert residue.cell_case(LONG_PAGES[kind], whole=True) == kind
    prose = "The shop opened early that day and sold the last of its baskets before noon, as it had done for years. " * 4
    assert residue.cell_case(LONG_PAGES[kind] + prose, whole=True) is None


def test_a_long_block_of_messages():
    assert residue.cell_case("The server could not answer. " * 15) == "error"
    assert residue.cell_case("The server could not answer. " + "The shop sold baskets before noon that day. " * 15) is None


def test_long_instructions():
    assert residue.cell_case("Click here to edit this cell and then describe in your own words what the data shows.") == "dummy"
    assert residue.cell_case("Replace this text with two or three sentences on where the data came from and who made it.") == "dummy"
    assert residue.cell_case("Sample text from the shop was read aloud by two people and then typed into the ledger by hand.") is None


def written(tree, rng):
    """A text that the parsed pattern matches, positions and looks around aside."""
    out = ""
    for what, value in tree:
        if what is _parser.LITERAL:
            out += chr(value)
        elif what is _parser.BRANCH:
            out += written(rng.choice(value[1]), rng)
        elif what is _parser.SUBPATTERN:
            out += written(value[-1], rng)
        elif what in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
            out += "".join(written(value[2], rng) for _ in range(rng.randint(value[0], min(value[1], value[0] + 2))))
        elif what is _parser.IN and value[0][0] is _parser.NEGATE:
            out += rng.choice("w ")
        elif what is _parser.IN:
            out += next((chr(v if w is _parser.LITERAL else v[0]) for w, v in value if w in (_parser.LITERAL, _parser.RANGE)), "7" if (_parser.CATEGORY, _parser.CATEGORY_DIGIT) in value else " " if (_parser.CATEGORY, _parser.CATEGORY_SPACE) in value else "w")
    return out


@pytest.mark.parametrize("pattern", ["|".join(f"(?:{p})" for p in residue.PLACEHOLDERS.values()), residue.ERROR, residue.SCRIPTS], ids=["placeholders", "error", "scripts"])
def test_no_alternative_is_spared(pattern):
    """Texts made from each alternative alone: whatever the pattern matches has the words that it needs."""
    rng, needs, found, tree = random.Random(5), residue.Needs(pattern), re.compile(pattern), _parser.parse(pattern)
    for alternative in tree[0][1][1]:
        texts = [text for made in (written(alternative, rng) for _ in range(300)) for text in (made, made.upper()) if found.search(text)]
        assert texts and all(needs.met(residue.folded(text)) for text in texts)


@pytest.mark.parametrize("times", [1, 3, 12, 60, 400])
def test_length_alone_decides_nothing(times):
    page = "404 Not Found\n" + "The page that you asked for does not exist. " * times
    prose = "404 Not Found\n" + "The table of this row holds seven of the old counts. " * times
    assert residue.cell_case(page, whole=True) == "error" and residue.cell_case(prose, whole=True) is None
    notice = "Please enable JavaScript to view this notebook. " * times
    assert residue.cell_case(notice, whole=True) == "scripts" and residue.cell_case(notice) == "scripts"


def test_stock_phrases_count_by_their_share_of_the_sentence():
    assert residue.cell_case("Sample text for the lab report of the second week.") == "dummy"
    assert residue.cell_case("Sample text is drawn from the corpus by the loader above, and every tenth of the rows that it gives back is kept for the tests.") is None
    assert residue.cell_case("Describe your main results here, then hand in the sheet at the end of the lesson, please.") == "dummy"


def test_needs_of_a_pattern():
    assert residue.Needs(r"(?i)Ab\s+(?:c?|de)|f(?:gh|ij)+k*").alternatives == [[["ab"]], [["f"], ["gh", "ij"]]]
    assert residue.Needs(r"\d+").met("")


def test_folding_is_that_of_patterns():
    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    words = {w for n in (residue._PLACEHOLDER_NEEDS, residue._ERROR_NEEDS, residue._SCRIPTS_NEEDS) for sets in n.alternatives for ws in sets for w in ws}
    for char in set("".join(words)):
        assert {residue.folded(c) for c in re.findall(re.escape(char), every, re.I)} == {char}


def test_documents(spark):
    text = "Some prose.\n\nIn [1]:\n{{ name }}\n\n🙂 {{ name }}"
    at = text.index("In [1]"), text.index("🙂")
    rows = [
        (1, text, ["text", "code", "text"], [0, *at], "x"), (2, text[: at[1]], ["text", "code"], [0, at[0]], "x"), (3, None, [], [], "x"), (4, " \n", [], [], "x"), (5, "Home | Help\n404 Not Found\nBack", [], [], "x"),
        (6, "plain words", None, None, "x"), (1, text, ["text", "code", "text"], [0, *at], "x"), (None, "{{ x }}", [], [], "x"), (7, "short", ["text", "text"], [0, 900], "x"), (8, "The table holds row 7 of the batch. " * 5000, ["text"], [0], "x"), (9, "word " * 50000, ["text"], [0], "x"),
    ]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("cell_kinds", T.ArrayType(T.StringType())), T.StructField("cell_starts", T.ArrayType(T.IntegerType())), T.StructField("kind", T.StringType())])
    df = spark.createDataFrame(rows, schema)
    got = sorted(((r.doc_id or 0), r.kind) for r in residue.residue(df).collect())
    assert got == [(0, "placeholder"), (1, "placeholder"), (5, "error"), (9, "dummy")]
    assert residue.residue(df.limit(0)).count() == 0
