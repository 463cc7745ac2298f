"""The library end to end over a small beekeeping handbook."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import titles as T
from scriptorium.functions.filters import Filters
from scriptorium.functions.html import render
from scriptorium.operators import index
from scriptorium.operators import records as R
from scriptorium.operators import search as S
from scriptorium.plans import jobs
from scriptorium.plans.engine import Conflict, Engine, Invalid
from scriptorium.plans.store import Change
from scriptorium.streaming import ingest as stream

RAMBLE = "the keeper walks along the hedge and looks at clouds, clover and the long grass beside the pond. " * 20
#: id, level (0: paragraph), section, page, text
HANDBOOK = [
    ("top", 1, "start", 1, "Keeping Bees Through the Year"),
    ("swarm-head", 1, "swarms", 2, "Catching a Swarm"),
    ("swarm-text", 0, "swarm-branch", 2, "In May a swarm may hang from a low branch for an hour or two."),
    ("honey-phrase", 0, "honey-bread", 3, "We tasted heather honey on warm bread."),
    ("honey-apart", 0, "honey-slope", 3, "Honey is darker wherever the bees have found a slope of heather."),
    ("smoke-first", 0, "smoke-in", 4, "Smoke goes in at the entrance, then wait and lift the lid."),
    ("lid-first", 0, "lid", 4, "The lid comes off only much later, once the guards have calmed and nobody needs smoke."),
    ("frame-pine", 0, "pine", 5, "A pine frame holds wax well."),
    ("frame-cedar", 0, "cedar", 5, "A cedar frame holds paint well."),
    ("no-frame", 0, "skeps", 5, "Skeps of straw had nothing of the kind."),
    ("feeding", 0, "feeding", 6, "Syrup feeders are filled at dusk."),
    ("rain-day", 0, "rain", 7, "Rain keeps foragers at home."),
    ("frost-day", 0, "frost", 7, "Frost does them no harm in a tight cluster."),
    ("box-code", 0, "boxes", 8, "The deep box K-47 takes eleven frames."),
    ("stemmable", 0, "records", 9, "Each colony gets a painted number."),
    ("clothes", 0, "clothes", 10, "A respirator helps when oxalic acid is used."),
    ("queen-head", 2, "queens", 11, "Quorbeline Queens"),
    ("queen-text", 0, "queens", 11, "The quorbeline strain is gentle."),
    ("odd-text", 0, "odd", 12, "<b onclick=x()>bold-claim-3141</b> '; drop table hives --"),
    ("pollen-one", 0, "pollen", 13, "Willow pollen arrives first."),
    ("pollen-two", 0, "pollen", 13, "Hazel pollen is poor food."),
    ("long-walk", 0, "walk", 14, RAMBLE + "there stands the old-mill-hive today. " + RAMBLE),
    ("zyl-head", 2, "parts", 14, "Zylm Spacers"),
    ("zyl-text", 0, "parts", 14, "Order spacer ZYLM-8 in spring."),
]


def document(ident, title, blocks, assets=()):
    pages: dict[int, list] = {}
    for i, level, section, page, text in blocks:
        pages.setdefault(page, []).append({"type": "heading" if level else "paragraph", "id": i, "sectionId": section, "pageNumber": page, "text": [{"text": text}]} | ({"level": level} if level else {}))
    return json.dumps({"metadata": {"id": ident, "pageCount": len(pages), "title": title}, "pages": [{"pageNumber": p, "blocks": b} for p, b in pages.items()], "outline": [], "assets": list(assets)})


def short(i, t, text="Weight of box B-7"):
    return (document(i, t, [("h-1", 1, None, 1, t), ("p-1", 0, None, 1, text)]),)


def frame_of(spark, *rows):
    return spark.createDataFrame(list(rows), "semantic string")


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("library")))
    failed = e.ingest(frame_of(spark, (document("bees", "A Handbook of Bees", HANDBOOK),), (document("wood", "Notes on Wood", [("wood-text", 0, "pine", 1, "A pine frame for a window, in another book.")]),), ("{not json",)))
    assert failed.count() == 1
    return e


BEES = Filters(document_id="bees")


def page(n):
    return Filters(document_id="bees", page=n)


def found(engine, text, filters=Filters()):
    return [r.block_id for r in engine.search(text, 50, 20, filters).results.collect()]


@pytest.mark.parametrize(
    "text, filters, strategy, want",
    [
        ("feed", page(6), "prefix", ["feeding"]),
        ("rain frost", page(7), "partial", {"rain-day", "frost-day"}),
        ("K-47", page(8), "strict", ["box-code"]),
        ("K47", page(8), "strict", ["box-code"]),
        ("K 47", page(8), "strict", ["box-code"]),
        ("numbering", page(9), "stemmed", ["stemmable"]),
        ("mask", page(10), "synonym", ["clothes"]),
        ("bold-claim-3141", BEES, "strict", ["odd-text"]),
    ],
)
def test_one_stage(engine, text, filters, strategy, want):
    out = engine.search(text, 50, 20, filters)
    got = [r.block_id for r in out.results.collect()]
    assert out.strategy == strategy and (set(got) if isinstance(want, set) else got) == want


def test_order(engine):
    got = found(engine, "swarm")
    assert got.index("swarm-head") < got.index("swarm-text")
    rows = engine.search("smoke lid", 50, 20, BEES).results.collect()
    near = {r.block_id: r.score_components.ordered_near_match for r in rows}
    assert rows[0].block_id == "smoke-first" and near["smoke-first"] and not near["lid-first"]
    first = found(engine, "heather honey", BEES)
    assert first.index("honey-phrase") < first.index("honey-apart") and first == found(engine, "heather honey", BEES)


def test_or_and_exclusion(engine):
    got = set(found(engine, "wax OR paint", BEES))
    assert {"frame-pine", "frame-cedar"} <= got and "no-frame" not in got
    got = set(found(engine, "frame -wax", BEES))
    assert "frame-cedar" in got and "frame-pine" not in got


def test_correction(engine):
    out = engine.search("quorbelnie", 50, 20, page(11))
    rows = [r.block_id for r in out.results.collect()]
    assert rows[0] == "queen-head" and set(rows) == {"queen-head", "queen-text"} and out.strategy == "corrected" and out.corrected_query == "quorbeline"


def test_groups_and_snippets(engine):
    [group] = engine.search("pollen", 50, 20, page(13)).results.collect()
    assert {group.block_id, *(m.block_id for m in group.additional_matches)} == {"pollen-one", "pollen-two"}
    [long] = [r for r in engine.search("old-mill-hive", 50, 20, page(14)).results.collect() if r.block_id == "long-walk"]
    assert len(long.snippet) < 400 and long.snippet[long.matches[0].start : long.matches[0].end] == "old-mill-hive"
    assert engine.search("   ").results.count() == 0


def test_suggest(engine):
    assert [(r.suggestion_type, r.text) for r in engine.suggest("zylm").collect()] == [("heading", "Zylm Spacers"), ("technical", "ZYLM-8")]
    assert engine.suggest("z").count() == 0 and engine.suggest("50%").count() == 0
    assert "StringStartsWith(normalized,zylm)" in engine.explain_suggest("zylm")


def test_many_and_explain(engine, spark):
    asked = spark.createDataFrame([(1, "pine frame"), (2, "no such words"), (3, "frame"), (4, " "), (5, "pine frame window")], "query_id long, text string")
    got = {(r.query_id, r.block_id) for r in engine.search_many(asked).collect()}
    assert got == {(1, "frame-pine"), (1, "wood-text"), (3, "frame-pine"), (3, "frame-cedar"), (3, "wood-text"), (5, "wood-text")}
    plan = engine.explain("wax", "direct", page(5))
    scans = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert any("lexeme" in line and "EqualTo(document_id,bees)" in line for line in scans)
    assert any("EqualTo(page_number,5)" in line and "document_id" in line for line in scans) and "BatchEvalPython" not in plan


def test_stages_by_postings_and_by_scans_agree(engine, monkeypatch):
    """Documents named by postings, and blocks scanned with the whole expression, give the same rows."""
    asked = ['"pine frame"', "wax OR paint -cedar", "fram", "handbook"]
    by_postings = [engine.search(q, 50, 20).results.drop("score_components").collect() for q in asked]
    monkeypatch.setattr(S, "FETCH", 0)
    assert by_postings == [engine.search(q, 50, 20).results.drop("score_components").collect() for q in asked]


def test_library(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lib"))
    assert e.documents().count() == 0 and e.search("anything").results.count() == 0
    assert e.ingest(frame_of(spark, short("one", "First manual"), short("two", "Second manual", "Other words"))).count() == 0
    refused = e.ingest(frame_of(spark, short("one", "Third manual"), short("three", "First manual"), short("four", "Fourth manual")))
    assert {(r.document_id, r.reason) for r in refused.collect()} == {("one", "document_id is taken"), ("three", "title is taken")}
    assert {r.document_id for r in e.documents().collect()} == {"one", "two", "four"} and e.load("one").count() == 1 and e.load("none").count() == 0
    assert json.loads(e.load("one").first().semantic)["metadata"]["displayTitle"] == "First manual"
    assert S.has_term(e.table("vocabulary"), "first") and e.retitle("one", "Renamed  handbook") and not e.retitle("none", "x y")
    assert [r.text for r in e.suggest("renamed").collect()] == ["Renamed handbook"] and found(e, "renamed") == ["one"]
    with pytest.raises(Conflict):
        e.retitle("two", "Renamed handbook")
    with pytest.raises(Invalid):
        e.retitle("two", " ")
    changed, failed = e.reindex()
    assert changed.count() == 0 and failed.count() == 0 and e.delete(["one", "missing"]) == 1 and e.documents().count() == 2
    assert all(e.table(t).where("document_id = 'one'").isEmpty() for t in ("blocks", "postings", "title_postings", "english_postings", "vocabulary", "suggestions", "semantic"))
    sizes = {r.name: r for r in e.sizes().collect()}
    assert sizes["blocks"].rows == 4 and sizes["blocks"].bytes > 0 and sizes["assets"].rows == 0
    e.stage_title("two", "Staged title")
    assert e.load("two").first().title == "Second manual" and e.publish_title("two") and not e.publish_title("two") and e.load("two").first().title == "Staged title"
    e.stage_title("two", "Another")
    e.discard_title("two")
    assert not e.publish_title("two") and not e.publish_title("../two")


def test_commits_cost_what_they_bring(spark, tmp_path):
    """A commit adds segments; what lies there already is not written again."""
    e = Engine(spark, str(tmp_path / "lib"))
    e.ingest(frame_of(spark, *[short(f"d{i}", f"Manual {i}", f"text number {i}") for i in range(4)]))
    before = e.store.manifest()
    e.ingest(frame_of(spark, short("more", "One more", "text of more")))
    e.delete(["d0"])
    e.ingest(frame_of(spark, short("d1", "Manual 1 again", "text is new")), replace=True)
    after = e.store.manifest()
    assert after.tables["blocks"][0] == before.tables["blocks"][0] and len(after.tables["blocks"]) == 3
    ids = lambda: ({r.document_id for r in e.documents().collect()}, {r.text for r in e.table("blocks").where("block_id = 'p-1'").collect()})
    want = ({"d1", "d2", "d3", "more"}, {"text is new", "text number 2", "text number 3", "text of more"})
    assert ids() == want
    e.store.compact()
    assert ids() == want and len(e.store.manifest().tables["blocks"]) == 1 and not e.store.manifest().gone
    assert e.store.vacuum(keep=1) > 0 and ids() == want and e.store.vacuum(keep=1) == 0


def test_two_writers(spark, tmp_path):
    """Of two writers that saw the same manifest one goes first, whole, and the other starts again."""
    root = str(tmp_path / "lib")
    one, two = Engine(spark, root), Engine(spark, root)
    one.ingest(frame_of(spark, short("base", "Base")))
    tries = 0

    def change(base):
        nonlocal tries
        tries += 1
        if tries == 1:  # another writer comes first
            assert two.ingest(frame_of(spark, short("quick", "Quick"))).count() == 0
        return Change(gone=spark.createDataFrame([("base",)], "document_id string"))

    version = one.store.commit(change)
    assert tries == 2 and version == 3 and {r.document_id for r in one.documents().collect()} == {"quick"}
    assert one.store._put_new("{}", "manifest", f"{version:012d}.json") is False and one.store.manifest().version == version


def test_one_bad_document_fails_alone(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lib"))
    twice = document("twice", "Twice", [("p-1", 0, None, 1, "a"), ("p-1", 0, None, 1, "b")])
    long = document("long", "Long", [("p-1", 0, None, 1, "x" * 20_001)])
    refused = e.ingest(frame_of(spark, (twice,), (long,), short("Bad Id", "T"), short("same-a", "Same"), short("same-b", "Same"), ("[]",), short("good", "Good")))
    reasons = {r.document_id: r.reason for r in refused.collect()}
    assert reasons.keys() >= {"twice", "long", "Bad Id", "same-b"} and len(reasons) == 5, reasons
    assert {r.document_id for r in e.documents().collect()} == {"same-a", "good"}


def test_assets(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "lib"))
    figure = json.dumps({"metadata": {"id": "pic", "title": "Picture"}, "pages": [{"pageNumber": 1, "blocks": [{"type": "figure", "id": "f-1", "imageId": "img-1", "caption": [{"text": "A hive"}]}]}]})
    rows = [(figure, [("img-1", "image/png", 1, 1, bytearray(b"abc"))]), (figure.replace('"pic"', '"out"').replace("Picture", "Outside"), [("../x", "image/png", 1, 1, bytearray(b"abc"))])]
    refused = e.ingest(spark.createDataFrame(rows, "semantic string, assets array<struct<id: string, mime_type: string, width: int, height: int, content: binary>>"))
    assert [(r.document_id, r.reason) for r in refused.collect()] == [("out", "invalid asset name")]
    assert 'src="data:image/png;base64,YWJj"' in e.html("pic") and e.html("out") is None
    assert 'src="img-1"' in e.pages().first().html and e.load("pic").first().assets[0].content == b"abc"


def test_named_jobs(spark):
    with jobs.named(spark, "counting"):
        spark.range(100).selectExpr("sum(id)").collect()
    seen = jobs.progress(spark, "counting")
    assert seen.jobs >= 1 and seen.tasks == seen.done and seen.failed == 0
    jobs.cancel(spark, "counting")
    assert jobs.progress(spark, "unknown").jobs == 0


def test_stream(spark, tmp_path):
    """A batch with a repeated and a taken title goes on; what was refused is written."""
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(document("a", "Alpha manual", [("p-1", 0, None, 1, "words of a")]))
    e = Engine(spark, str(tmp_path / "lib"))
    run = lambda: stream.ingest(e, stream.json_documents(spark, str(folder)), str(tmp_path / "check"), failures=str(tmp_path / "failed")).awaitTermination()
    run()
    (folder / "b.json").write_text(document("b", "Beta manual", [("p-1", 0, None, 1, "words of b")]))
    (folder / "c.json").write_text(document("c", "Alpha manual", [("p-1", 0, None, 1, "words of c")]))
    (folder / "d.json").write_text(document("d", "Beta manual", [("p-1", 0, None, 1, "words of d")]))
    run()
    assert {r.document_id for r in e.documents().collect()} == {"a", "b"}
    refused = spark.read.parquet(str(tmp_path / "failed"))
    assert {(r.document_id, r.reason) for r in refused.collect()} == {("c", "title is taken"), ("d", "title repeats in this import")}


def test_postings_of_a_block(spark):
    """Positions are grouped where they are made; only whole blocks are shuffled."""
    blocks = spark.createDataFrame([("d", "b", "\x01a\x01b\x01a\x01"), ("d", "c", "\x01"), ("d", "e", None)], "document_id string, block_id string, lex_simple string")
    out = index.postings(blocks)
    assert sorted((r.lexeme, r.block_id, r.positions) for r in out.collect()) == [("a", "b", [0, 2]), ("b", "b", [1])]
    plan = S.explain(index.postings(blocks), "simple")
    assert plan.count("Exchange ") == 1 and "Exchange hashpartitioning(document_id" in plan


TREE = {
    "metadata": {"id": "tree", "title": "Tree"},
    "pages": [{"pageNumber": 1, "blocks": [
        {"type": "heading", "id": "h-1", "level": 1, "pageNumber": 1, "text": [{"text": "Gear"}]},
        {"type": "paragraph", "id": "p-1", "pageNumber": 1, "text": [{"text": "See "}, {"text": "site", "link": {"kind": "external", "href": "https://x.example/?a=1&b"}}, {"text": " now", "link": {"kind": "external", "href": "javascript:x"}}]},
        {"type": "list", "id": "l-1", "ordered": True, "pageNumber": 1, "items": [{"id": "li-1", "blocks": [{"type": "paragraph", "id": "p-2", "pageNumber": 1, "text": [{"text": "Light  it"}]}, {"type": "list", "id": "l-2", "pageNumber": 1, "items": [{"id": "li-2", "blocks": [{"type": "paragraph", "id": "p-4", "text": [{"text": "inner"}]}]}]}]}]},
        {"type": "table", "id": "t-1", "pageNumber": 1, "rows": [{"cells": [{"id": "th-1", "isHeader": True, "pageNumber": 1, "blocks": [{"type": "paragraph", "id": "p-5", "text": [{"text": "Item"}]}]}]}, {"cells": [{"id": "td-1", "isHeader": False, "pageNumber": 1, "colSpan": 2, "blocks": [{"type": "paragraph", "id": "p-3", "text": [{"text": "Smoker <2>"}]}]}]}]},
        {"type": "figure", "id": "f-1", "pageNumber": 1, "caption": [{"text": "A figure"}]},
        {"type": "paragraph", "id": "p-6", "pageNumber": 1, "text": [{"text": "  "}]},
    ]}],
    "outline": [{"title": "Gear", "children": [{"title": "Inner", "target": {"pageNumber": 2}}]}],
}


def test_tree():
    rows = list(R.records(TREE))
    assert [(r["block_id"], r["block_type"]) for r in rows] == [("h-1", "heading"), ("p-1", "paragraph"), ("li-1", "list-item"), ("li-2", "list-item"), ("th-1", "table-cell"), ("td-1", "table-cell"), ("f-1", "figure-caption")]
    cell = rows[5]
    assert cell["table_header"] == "Item" and cell["row_header"] is None and cell["heading_path"] == ["Gear"] and cell["section_id"] == "h-1"
    assert rows[2]["text"] == "Light it inner"
    assert R.semantic_ids(TREE) == ["h-1", "p-1", "l-1", "li-1", "p-2", "l-2", "li-2", "p-4", "t-1", "th-1", "p-5", "td-1", "p-3", "f-1", "p-6"]
    assert [(r["ordinal_path"], r["title"], r["target_page"]) for r in R.outline_rows(TREE)] == [([0], "Gear", None), ([0, 0], "Inner", 2)]
    page = render(TREE)
    assert '<a href="https://x.example/?a=1&amp;b">site</a>' in page and "javascript" not in page and '<td id="td-1" colspan="2"><p id="p-3">Smoker &lt;2&gt;</p></td>' in page


def test_validation(spark):
    flat = R.flatten(spark.createDataFrame([("tree", "Tree", json.dumps(TREE)), ("Bad", "t", json.dumps(TREE)), ("broken", "t", "{")], "document_id string, title string, semantic string"))
    good, bad = R.split_failures(flat)
    assert good.count() == 7 and {r.document_id for r in bad.collect()} == {"Bad", "broken"}
    known = spark.createDataFrame([("tree", i) for i in R.semantic_ids(TREE) if i != "td-1"], "document_id string, block_id string")
    assert [(r.block_id, r.reason) for r in R.validate(good, known).collect()] == [("td-1", "references an unknown block")]


def test_builders(spark):
    records = spark.createDataFrame(
        [("d", "Smokers", None, "Fuel", "Box K-47 and K47, KL47MN58, a 47 year, Kl47", "table-cell", 1), ("d", "Smokers", None, None, "Smokers", "heading", 0)],
        "document_id string, heading string, table_header string, row_header string, text string, block_type string, ordinal int",
    )
    documents = spark.createDataFrame([("d", "Apiary Guide")], "document_id string, title string")
    assert {r.term for r in index.vocabulary(records, documents).collect()} == {"apiary", "guide", "smokers", "fuel", "k47"}
    assert {(r.suggestion_type, r.text) for r in index.suggestions(records, documents).collect()} == {("title", "Apiary Guide"), ("heading", "Smokers"), ("technical", "K-47")}
    assert [r.technical_variants for r in index.index_blocks(records, english=False).where("block_type = 'table-cell'").collect()] == ["K-47 K47 K 47"]
    many = spark.createDataFrame([("d", "title", "queen", 0), ("d", "heading", "queen", 1), *[("d", "technical", f"QU-{i}", i) for i in range(20)]], "document_id string, suggestion_type string, text string, n int").withColumn("normalized", F.lower("text"))
    got = S.rank_suggestions(many).collect()
    assert len(got) == 10 and got[0].suggestion_type == "title" and got[1].text == "QU-0"


def test_titles(spark):
    rows = spark.createDataFrame(
        [(None, "BY ORDER OF THE", None, "bee1book_2.pdf"), ("  Host  title ", "Meta", "Head", "f.pdf"), (None, "Meta title", "Head", "f.pdf"), (None, "for official use only", "Head", "f.pdf"), (None, "ab", "abc", ".pdf"), (None, None, None, "HIVE-x.pdf")],
        "host string, meta string, heading string, file string",
    )
    got = [(r.t.title, r.t.source, r.t.confidence) for r in rows.select(T.select_title(*map(F.col, rows.columns)).alias("t")).collect()]
    assert got == [("Bee1book 2", "filename", 0.2), ("Host title", "host", 1.0), ("Meta title", "pdf-metadata", 0.8), ("Head", "first-page-heading", 0.65), ("Untitled document", "filename", 0.2), ("HIVE X", "filename", 0.2)]
    ids = spark.createDataFrame([("My File (2).pdf",), ("2024 report.pdf",), ("???.pdf",)], "f string").select(T.document_id(F.col("f"), F.lit("0123456789abcdef")).alias("i")).collect()
    assert [r.i for r in ids] == ["my-file-2-0123456789ab", "document-2024-report-0123456789ab", "document-pdf-0123456789ab"]


def test_first_line_is_searched_whole(spark):
    """The heading is a label of 80 characters; the block holds the line to its end."""
    from scriptorium.sources import corpus

    line = " ".join(f"word{i}" for i in range(40)) + " Z-99 lastword"
    rows = spark.createDataFrame([(1, f"\n {line}\nnext", "en", "src1")], "doc_id long, text string, lang string, source string")
    first, second = corpus.records(rows).orderBy("ordinal").collect()
    assert (first.text, first.heading, first.block_type) == (line, line[:80], "heading") and second.text == "next"
    block = index.index_blocks(corpus.records(rows), english=False).where("ordinal = 0").first()
    assert "\x01lastword\x01" in block.lex_simple and "Z99" in block.technical_variants
