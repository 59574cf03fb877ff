"""Repairs against a corpus: golden rows of the rules, and scanned texts that come back as they were."""
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import edits as E
from palimpsest.operators import repair
from palimpsest.plans.queries import QUERIES
from palimpsest.sources.tables import view

SF = "/root/testdata/sf0.01"
KNOWN = "wilson manhattan in paris exact harmony of dominion he visited the quick brown fox jumped over lazy dog william eerdmans modern example time burn"
GOLDEN = [
    ("W i l s o n", "Wilson"), ("M a n h a t t a n", "Manhattan"), ("W i l s o n in P a r i s", "Wilson in Paris"), ("e x a c t h a r m o n y o f d o m i n i o n", "exact harmony of dominion"),
    ("W i ls on in P a r i s", "W i ls on in Paris"), ("He visited W i l s o n in Paris", "He visited Wilson in Paris"), ("The quick brown fox", "The quick brown fox"), (". . . . . . .", ". . . . . . ."),
    ("a b", "a b"), ("U S A", "U S A"), ("O O O O", "O O O O"), ("d o m i n i o n ' s", "dominion's"), ("W I L L I A M B . E E R D M A N S", "WILLIAMB . EERDMANS"), ("W l L L l A M", "WILLIAM"), ("A [ 1 2 ]", "A [12]"),
    ("q z x w v", "q z x w v"), ("an exam-\nple of it", "an example\nof it"), ("an exam-\nple, yes", "an example, yes"), ("self-\nmade", "self-\nmade"), ("well-\nknown to", "well-known\nto"),
    ("rnodern tirne", "modern time"), ("Rnodern TIRNE", "Modern TIME"), ("bum", "burn"), (None, None), ("", ""),
]


def test_golden(spark):
    rows = [(1000 + k, f"{KNOWN} the well-known one. " * 30) for k in range(2)] + [(k, t) for k, (t, _) in enumerate(GOLDEN)]
    got = {r["doc_id"]: r for r in repair.repaired(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for k, (t, want) in enumerate(GOLDEN):
        assert got[k]["text"] == want, (t, got[k])
    assert got[2]["n_spaced"] == 2 and got[16]["n_cut"] == 1 and got[20]["n_words"] == 2
    assert repair.repaired(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scanned_texts_come_back(spark):
    whole = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}
    scanned = {r["doc_id"]: r["text"] for r in view(spark, SF, "scanned_v").collect()}
    got = {r["doc_id"]: r["text"] for r in repair.repaired(view(spark, SF, "scanned_v")).collect()}
    assert set(got) == set(whole)
    worse = [k for k in whole if scanned[k] == whole[k] and got[k] != whole[k]]
    spaced = [k for k in whole if k % 4 == 0 and scanned[k] != whole[k]]
    assert spaced and sum("t h a t" not in got[k] for k in spaced) == len(spaced)
    cut = [k for k in whole if k % 4 == 1 and scanned[k] != whole[k]]
    assert sum(got[k].count("ti-\non") for k in cut) < 0.2 * sum(scanned[k].count("ti-\non") for k in cut)
    assert len(worse) < 0.1 * len(whole)
    assert QUERIES["repaired_texts"](spark, SF).count() == len(whole)


def test_texts_are_not_counted_before_the_query_runs(spark):
    docs = spark.createDataFrame([(k, f"{KNOWN} " * 30) for k in range(3)] + [(9, "self-\nmade W i l s o n [ 1 2 ]"), (10, None)], "doc_id long, text string")
    spark.sparkContext.setJobGroup("repair is built", "")
    got = repair.repaired(docs)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("repair is built")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["doc_id"]: r["text"] for r in got.where("doc_id > 8").collect()} == {9: "self-\nmade Wilson [12]", 10: None}


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("<p>a</p><p>b</p><p>c</p><p>d</p><p>e</p><h2>x</h2><p>Subject Index</p>\n<p>Grace, 12</p><p>14</p><p>Hope, 3-</p><p>5</p><p>Love, 9,</p><p>11 and more</p>", "<p>a</p><p>b</p><p>c</p><p>d</p><p>e</p><h2>x</h2><p>Subject Index</p>\n<p>Grace, 12 14</p><p>Hope, 3-5</p><p>Love, 9, 11 and more</p>", 3),
        ("<p>a</p><p>b</p><p>c</p><p class=x>Index</p><p>Genesis 1:2</p><p>3:4 ff and so on</p><p>Mark</p>", "<p>a</p><p>b</p><p>c</p><p class=x>Index</p><p>Genesis 1:2 3:4 ff and so on</p><p>Mark</p>", 1),
        ("<p>Index</p><p>only prose here</p><p>12</p>", "<p>Index</p><p>only prose here</p><p>12</p>", 0),
        ("<p>none</p>", "<p>none</p>", 0),
    ],
)
def test_index_in_pages(text, want, n):
    assert E.IndexMender(()).mend(text) == (want, n)


def test_anchors_by_the_first_spelling(spark):
    issue = [{"category": "toc_navigation", "description": "missing anchors"}]
    rows = [(1, 'see NOTE 3, note 3 and Note  12, note12', issue), (2, '<p id="note 7">x</p> note 7', issue), (3, '<a id="note5"></a>note 5', issue), (4, "note 35 and note 3", issue), (5, None, issue), (6, "note 1", None)]
    d = spark.createDataFrame(rows, "k int, t string, i array<struct<category: string, description: string>>")
    got = {r["k"]: r["f"] for r in d.select("k", E.fix_reported(F.col("t"), F.col("i")).alias("f")).collect()}
    assert (got[1]["text"], got[1]["n"]) == ('see <a id="note3"></a>NOTE 3, note 3 and <a id="note12"></a>Note  12, note12', 2)
    assert got[2]["text"] == '<p id="<a id="note7"></a>note 7">x</p> note 7' and got[2]["n"] == 1
    assert got[3]["n"] == 0 and got[6]["n"] == 0
    assert got[4]["text"] == '<a id="note35"></a>note 35 and note 3'.replace('<a id="note35"></a>note 35', '<a id="note35"></a><a id="note3"></a>note 35') and got[4]["n"] == 2


def test_issues_act_in_their_order(spark):
    a, b = {"category": "heading_formatting", "description": "unstyled"}, {"category": "paragraph_flow", "description": "split lines"}
    d = spark.createDataFrame([(1, "PART I\nand more", [a, b]), (2, "PART I\nand more", [b, a])], "k int, t string, i array<struct<category: string, description: string>>")
    got = {r["k"]: r["f"]["text"] for r in d.select("k", E.fix_reported(F.col("t"), F.col("i")).alias("f")).collect()}
    assert got == {1: "## PART I\nand more", 2: "PART I and more"}


def test_whole_documents_and_dry_runs(spark):
    issue = [{"category": "toc_navigation", "description": "anchor"}]
    rows = [(1, "a   b ,c\n)\n\nnote 4", False, issue), (2, "<p></p><p>x</p>\n,\n\nz", True, None), (3, None, False, None), (4, "plain", None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, is_html boolean, issues array<struct<category: string, description: string>>")
    got = {r["doc_id"]: r for r in E.fix_documents(d).collect()}
    dry = {r["doc_id"]: r for r in E.fix_documents(d, dry_run=True).collect()}
    assert got[1]["text"] == 'a b,c\n\n<a id="note4"></a>note 4' and got[1]["counts"] == {"whitespace": 2, "orphan_fragments": 1, "vqa_targeted": 1} and got[1]["modified"]
    assert got[2]["text"] == "<p>x</p>\n\nz" and got[2]["total"] == 2
    assert got[3]["text"] is None and not got[3]["modified"] and got[4]["total"] == 0
    assert dry[1]["text"] == rows[0][1] and dry[1]["total"] == 4 and not dry[1]["modified"]
    assert E.fix_documents(d, ("orphan_fragments",)).where("doc_id = 1").first()["counts"] == {"orphan_fragments": 1}
