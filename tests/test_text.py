import pytest

from lexigraph.functions import templates, wikitext
from lexigraph.functions.porter import stem, tokens


@pytest.mark.parametrize(
    "text, want",
    [
        ("[[Rome|the city]] and [[Oslo]]", "the city and Oslo"),
        ("'''a''' ''b'' '''''c'''''", "a b c"),
        ("x<ref>n</ref>y<ref name=q/>z<REF>w {{cite|v}}</REF>!", "xyz!"),
        ("left {{Infobox|a={{b|c}}|d=e}} right", "left right"),
        ("kept <ref>never closed [[Hidden]]", "kept"),
        ("{|\n| a\n{|\n| b\n|}\n|}\nbelow", "below"),
        ("p [[File:X.png|thumb|[[in]] it]] q [[Category:Y]] [[:Category:Z|shown]] [[fr:Autre]]", "p q shown"),
        ("go [http://x.org here] or [https://y.org]", "go here or"),
        ("one<br/>two<sub>3</sub> &nbsp;&lt;", "onetwo3 <"),
        ("* first\n#second\n; term", "first\nsecond\nterm"),
        ("seen <!-- not --> seen <!-- not", "seen seen"),
        ("broken {{open and [[also", "broken open and also"),
        ("a {{unknown|x}}, b ({{IPA|x}}; born 1900) c", "a, b (born 1900) c"),
        ("__TOC__text", "text"),
        ("{{convert|10|km|mi}}, {{convert|5|to|9|ft}}", "10 km (6.2 mi), 5 to 9 ft (1.5 to 2.7 m)"),
        ("{{convert|5|ft|6|in|m}} {{convert|1.8|m|ftin}}", "5 ft 6 in (1.7 m) 1.8 m (5 ft 11 in)"),
        ("{{convert|20|C}} {{convert|300|sqft|disp=flip}} {{convert|40|odd}}", "20 °C (68 °F) 28 m² (300 sq ft) 40 odd"),
        ("{{birth date|1950|03|07|df=yes}}; {{end date|2005|9}}; {{date|2023-05-09|mdy}}", "7 March 1950; September 2005; May 9, 2023"),
        ("{{as of|2020|5|lc=y}} {{circa|1500|1510}} {{BCE|5}} {{nee|Doe}}", "as of May 2020 c. 1500–1510 5 BCE née Doe"),
        ("{{lang|fr|mot}} {{lang-de|Wort}} {{transl|ru|X|slovo}} {{lit|word}}", "mot Wort slovo lit. word"),
        ("{{frac|1|2}} {{ordinal|23}} {{ordinal|112}} {{#expr:(2+3)*4}} {{formatnum:1234567}}", "1/2 23rd 112th 20 1,234,567"),
        ("{{CAD|5}} {{nowrap|a b}} {{ubl|x|y}} {{chem|H|2|O}} {{HMS|Beagle}}", "C$5 a b x, y H2O HMS Beagle"),
    ],
)
def test_clean(text, want):
    assert wikitext.clean(text) == want


@pytest.mark.parametrize("text", ["", "{{", "}}", "[[[[", "<ref>", "{|", "'''''", "==", "{{{{{{x", "<!--", "|}", "[[File:", "{{a|[[b}}]]"])
def test_clean_takes_anything(text):
    assert isinstance(wikitext.clean(text), str) and isinstance(wikitext.extract_links(text), list)


def test_templates_never_run_code():
    assert templates.render("#expr:__import__('os')", [], {}) is None
    assert templates.render("#expr:1/0", [], {}) == "" and templates.render("#expr:2**3", [], {}) == ""
    assert templates.render("convert", [], {}) == "" and templates.render("sfn", ["a"], {}) is None


def test_units_round_trip():
    for name, unit in templates.UNITS.items():
        assert abs(unit.of_base(unit.base(7.25)) - 7.25) < 1e-9, name


ARTICLE = ":''For others see [[Elsewhere]].''\n{{Box\n== no heading ==\n}}\nThe '''thing''' is [[Good]] (or [[Aside]]).\n== History ==\nIt began in [[Rome]]. ''[[Slanted]]''\n== References ==\n* [[List]]"


def test_sections_and_leads():
    assert [h for h, _ in wikitext.sections(ARTICLE)] == ["", "History", "References"]
    assert wikitext.lead(ARTICLE) == "The thing is Good (or Aside)."
    assert wikitext.to_text(ARTICLE).endswith("History\nIt began in Rome. Slanted")
    assert wikitext.lead("== Only ==\nStarts here.") == "Starts here." and wikitext.lead("") == ""
    long = "Dr. A. Lee went to the U.S. in May. " * 20
    assert wikitext.trim(long, 100).endswith("May.") and len(wikitext.trim(long, 100)) <= 100
    assert wikitext.trim("word " * 50, 23) == "word word word word…"
    assert wikitext.is_disambiguation("X", "{{Disambig|geo}}") and not wikitext.is_disambiguation("X", "{{disambiguation needed}}")


def test_links():
    got = [(x.target, x.lead, x.plain) for x in wikitext.extract_links(ARTICLE)]
    assert got == [("Elsewhere", True, False), ("Good", True, True), ("Aside", True, False), ("Rome", False, True), ("Slanted", False, False), ("List", False, True)]
    seen = lambda t: [x.target for x in wikitext.extract_links(t)]
    assert seen("{{a [[In]] [[x]] {{b|[[Gone]]}}") == ["In", "X"]
    assert seen("<ref>open [[Kept]]") == ["Kept"] and seen("[[File:A|[[Lost]]\n[[Kept]]") == ["Kept"]
    assert seen("[[CSI: Miami]] [[de:Stadt]] [[Talk:X]] [[:Colon]]") == ["CSI: Miami", "Colon"]
    assert [wikitext.normalize_title(t) for t in ("new__york", "A&amp;B", "a%20b", "#top", "/sub", "50% off")] == ["New york", "A&B", "A b", None, None, "50% off"]


def test_porter():
    pairs = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "revival": "reviv", "adoption": "adopt", "probate": "probat", "controll": "control", "sky": "sky", "running": "run", "plants": "plant"}
    assert {w: stem(w) for w in pairs} == pairs
    assert tokens("Café naïve running plants O'Brien_x-y") == ["cafe", "naiv", "run", "plant", "o", "brien", "x", "y"]


def test_porter_against_the_index_of_sqlite():
    import sqlite3

    words = "nationalization electricity formalize adjustable replacement dependent communism effective bowdlerize rate cease roll generate conditional digitizer operator sensibility goodness analogy flying tried bled sized feed conformably differently".split()
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE q USING fts5(t, tokenize='porter unicode61 remove_diacritics 2')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(q, 'row')")
    for w in words:
        db.execute("DELETE FROM q")
        db.execute("INSERT INTO q VALUES (?)", (w,))
        assert [r[0] for r in db.execute("SELECT term FROM v")] == [stem(w)], w


def test_over_dataframes(spark):
    pages = spark.createDataFrame([(10, "A", ARTICLE), (11, "B", None), (12, "Mercury (disambiguation)", "x")], "page_id long, title string, text string")
    assert wikitext.link_rows(pages).count() == 6
    assert [(r.pos, r.heading) for r in wikitext.section_rows(pages).where("page_id = 10").orderBy("pos").collect()] == [(0, ""), (1, "History")]
    leads = {r.page_id: (r.lead, r.disambig) for r in wikitext.lead_rows(pages).collect()}
    assert leads[11] == ("", 0) and leads[12] == ("x", 1)
    articles = spark.createDataFrame([(10, 0, "A"), (20, 1, "Good"), (21, 2, "Rome")], "page_id long, idx long, title string")
    red = spark.createDataFrame([(30, "Aside", 20), (31, "List", 10)], "page_id long, title string, target long")
    edges, nodes = wikitext.prose_graph(wikitext.link_rows(pages), articles, red)
    assert sorted((r.dst, r.ord, r.is_lead) for r in edges.collect()) == [(1, 0, True), (2, 1, False)]
    assert [tuple(r) for r in nodes.collect()] == [(0, 1)]
