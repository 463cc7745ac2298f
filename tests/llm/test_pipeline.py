"""The pipeline against a plain run over its stages' own results, and the entry without this part."""

import os
import re
import subprocess
import sys

import corpus_pipeline
from scriptorium.llm import exactdup, mixing, neardup, quality

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    one = corpus_pipeline.quality_stage(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == good and one.columns == docs.columns
    two = corpus_pipeline.exact_stage(spark, one, SF)
    assert {r.doc_id for r in two.collect()} == {r.keep_id for r in exactdup.exact_duplicates(one).collect()}
    three = corpus_pipeline.near_stage(spark, two, SF)
    assert {r.doc_id for r in three.collect()} == {r.component_id for r in neardup.near_duplicates(two).collect()}
    four = corpus_pipeline.mix_stage(spark, three, SF)
    taken = {r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies}
    rows = [r.doc_id for r in four.collect()]
    assert {i: rows.count(i) for i in set(rows)} == taken and four.columns == docs.columns
    five = corpus_pipeline.pieces_stage(spark, four, SF).collect()
    assert sorted(r.doc_id for r in five) == sorted(rows) and all(r.exact for r in five)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pieces"]


def plain_copies(rows):
    """Ids that stay of (id, text): of texts that are equal but for A-Z, the largest id."""
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    best = {}
    for i, t in rows:
        best[low(t)] = max(i, best.get(low(t), i))
    return set(best.values())


def plain_near(rows, width, percent):
    """Ids that stay: the least of each component, by comparing all pairs' sets of shingles."""
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
    least = {i: i for i in sets}
    while True:
        before = dict(least)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
        if before == least:
            return {i for i in sets if least[i] == i}


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    two = corpus_pipeline.exact_stage(spark, docs, SF)
    kept = [(r.doc_id, r.text) for r in two.collect()]
    assert {i for i, _ in kept} == plain_copies(rows) and len(kept) == len(plain_copies(rows))
    three = corpus_pipeline.near_stage(spark, two, SF)
    assert {r.doc_id for r in three.collect()} == plain_near(kept, 5, 80)


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows and ids, extra columns, and an empty table."""
    form = "doc_id long, text string, lang string, source string, n_chars long, score string, copies string, __file string"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 1, "x", "y", "f"), (1, words, "en", "a", 1, "x", "y", "f"), (2, words + " more", None, None, None, None, None, None), (None, "no id here at all", "de", "b", 1, "x", "y", "f"), (3, None, None, "a", 0, "x", "y", "f"), (4, "", "en", None, 0, "x", "y", "f"), (5, "other words stand here", "fr", "b", 1, "x", "y", "f")]
    for table in (rows, []):
        docs = spark.createDataFrame(table, form)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            got = {tuple(r) for r in out.collect()}
            assert got <= {tuple(r) for r in docs.collect()}, name
    out = corpus_pipeline.pieces_stage(spark, spark.createDataFrame(rows, form), SF)
    assert out.count() == len(rows) and all(r.exact for r in out.collect())


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


def test_entry_without_this_part(tmp_path):
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import __spark_entry__ as e; names = list(e.queries()); assert names and not any(n.startswith('op1_') for n in names), names"
    os.symlink(f"{top}/__spark_entry__.py", tmp_path / "__spark_entry__.py")
    os.mkdir(tmp_path / "scriptorium")
    for name in os.listdir(f"{top}/scriptorium"):
        if name != "llm":
            os.symlink(f"{top}/scriptorium/{name}", tmp_path / "scriptorium" / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)
