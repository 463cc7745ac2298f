"""Query text, filters, lexemes, stems, snippets: no Spark."""

import pytest

from scriptorium.functions import filters as FL
from scriptorium.functions import query as Q
from scriptorium.functions.lexemes import lex
from scriptorium.functions.snippets import highlighted, snippet
from scriptorium.functions.stemming import lex_english, stem


@pytest.mark.parametrize(
    "raw, normalized",
    [
        ("A-12 defect", "a-12 defect"),
        ("engine OR OR motor", "engine OR motor"),
        ("OR engine OR", "engine"),
        ('"" engine', "engine"),
        ("'; DROP TABLE documents; --", "drop table documents"),
        ('engine "inspection report" -aircraft OR helicopter', 'engine "inspection report" -aircraft OR helicopter'),
        ('"open phrase', '"open phrase"'),
    ],
)
def test_normalized(raw, normalized):
    assert Q.parse(raw).normalized == normalized


@pytest.mark.parametrize("raw", ["---", "-aircraft", "", '""', "x" * 257, " ".join(f"w{i}" for i in range(25))])
def test_rejected(raw):
    with pytest.raises(Q.QueryError):
        Q.parse(raw)


def test_parts():
    q = Q.parse('engine "inspection report" -aircraft OR helicopter engine')
    assert q.phrases == (("inspection", "report"),) and q.excluded == ("aircraft",) and q.has_or
    assert q.terms == ("engine", "inspection", "report", "helicopter") and not q.ends_excluded
    assert Q.say(Q.strict(q)) == "(engine & (inspection<->report) & !aircraft | helicopter & engine)"


@pytest.mark.parametrize(
    "raw, said",
    [
        ("engine -aircraft inspect", "engine & inspect:* & !aircraft"),
        ('"inspection report" eng', "(inspection<->report) & eng:*"),
        ("engine OR motor", None),
        ('engine "inspection report"', None),
        ("engine -inspect", None),
        ("engine in", None),
    ],
)
def test_prefix(raw, said):
    tree = Q.prefix(Q.parse(raw))
    assert (tree and Q.say(tree)) == said


@pytest.mark.parametrize(
    "raw, said",
    [
        ('engine "inspection report"', "(engine | (inspection<->report))"),
        ("engine motor -aircraft", "(engine | motor) & !aircraft"),
        ("engine", "engine"),
        (" ".join(f"w{i}" for i in range(10)), "(" + " | ".join(f"w{i}" for i in range(8)) + ")"),
    ],
)
def test_partial(raw, said):
    assert Q.say(Q.partial(Q.parse(raw))) == said


@pytest.mark.parametrize(
    "raw, said",
    [
        ("flu", "(flu | influenza)"),
        ("influenza", None),
        ("flu OR covid", None),
        ('"flu season"', None),
        ("mask respirator", None),
        ('"flu season" covid -x', "(flu<->season) & (covid | coronavirus | (sars-cov<->sars<->cov<->-2)) & !x"),
    ],
)
def test_synonym(raw, said):
    tree = Q.synonym(Q.parse(raw))
    assert (tree and Q.say(tree)) == said


def test_cover():
    q = Q.parse('engine "hot pump" -cold')
    counts = {("engine", False): 5, ("hot", False): 9, ("pump", False): 2}
    assert Q.leaves(Q.strict(q)) == set(counts) and Q.cover(Q.strict(q), counts) == (2, {("pump", False)})
    assert Q.cover(Q.partial(q), counts) == (7, {("engine", False), ("pump", False)})
    assert Q.leaves(Q.prefix(Q.parse("engine ins"))) == {("engine", False), ("ins", True)}
    either = Q.strict(Q.parse("engine OR -cold"))
    assert Q.cover(either, {("engine", False): 1}) is None


def test_lexemes():
    assert lex("A-12 A12 A 12") == ["a", "-12", "a12", "a", "12"]
    assert lex("up-to-date v2.5 12ab Été") == ["up-to-date", "up", "to", "date", "v2", "5", "12ab", "été"]
    assert lex("2.5 -3") == ["2.5", "-3"]


@pytest.mark.parametrize(
    "word, want",
    [("inspected", "inspect"), ("inspection", "inspect"), ("programs", "program"), ("trained", "train"), ("training", "train"), ("skies", "sky"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"),
     ("generously", "generous"), ("flies", "fli"), ("cries", "cri"), ("happiness", "happi"), ("agreed", "agre"), ("consignment", "consign"), ("knightly", "knight"), ("news", "news"), ("a12", "a12"), ("controlling", "control")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_english_lexemes():
    assert lex_english("The inspections were finished") == ["inspect", "finish"]


def test_filters():
    f = FL.parse(document_id="doc-1", page_start="2", page_end="9", block_type="heading")
    assert f.page_range == (2, 9) and not f.empty and FL.parse().empty
    for bad in [{"page": "0"}, {"page": "1e3"}, {"page": "1", "page_start": "1", "page_end": "2"}, {"page_start": "1"}, {"page_start": "5", "page_end": "2"}, {"page_start": "1", "page_end": "2002"}, {"document_id": "Bad id"}, {"block_type": "x' OR 1"}, {"section_id": "a" * 129}]:
        with pytest.raises(FL.FilterError):
            FL.parse(**bad)


def test_snippets():
    text = "filler " * 60 + "beacon here beacon again " + "filler " * 60
    out = snippet(text, ("beacon",))
    assert len(out["snippet"]) < 250 and out["snippet"].startswith("... ") and out["snippet"].endswith(" ...")
    assert all(out["snippet"][m["start"] : m["end"]] == "beacon" for m in out["matches"]) and len(out["matches"]) == 2
    assert snippet("short  text", ("none",)) == {"snippet": "short text", "matches": []}
    assert snippet("x" * 300, ())["snippet"] == "x" * 192 + " ..."
    assert highlighted("a <b> c", [{"start": 2, "end": 5}]) == [("a ", False), ("<b>", True), (" c", False)]
