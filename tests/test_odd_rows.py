"""Rows that the small tables do not hold."""
from datetime import datetime

from palimpsest.functions import forum
from palimpsest.operators import bookheads, store
from palimpsest.plans.audits import HTML
from palimpsest.streaming import events as ev


def _events(spark, *times):
    rows = [(k, 1, datetime.fromisoformat(f"2024-01-{t}"), True) for k, t in enumerate(times)]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, failed boolean")


def test_breaker_gap_is_in_rounded_seconds(spark):
    late = _events(spark, "01 00:00:00.400", "02 00:00:00.600", "02 00:00:01")  # 86,401 rounded seconds: a new run
    kept = _events(spark, "01 00:00:00.600", "02 00:00:01.400", "02 00:00:02")
    assert [ev.breaker_openings(e, "user_id", "failed", 3, 86_400).count() for e in (late, kept)] == [0, 1]


def test_sliding_limit_counts_rounded_seconds(spark):
    within = lambda *times: ev.over_limit(_events(spark, *times), "user_id", 1, 86_400).count()
    assert within("01 00:00:00.400", "01 23:59:59.600") == 0 and within("01 00:00:00.600", "01 23:59:59.900") == 1


def test_exit_without_a_score_takes_the_first_later_one(spark):
    rows = [(1, 1, None, 2500), (1, 2, 54, 10), (1, 3, 90, 10), (2, 1, None, 2500)]
    got = store.converge_exit(spark.createDataFrame(rows, "book_id long, iteration int, score int, cost_cents long"))
    assert sorted((r["book_id"], r["iteration"], r["score"], r["reason"]) for r in got.collect()) == [(1, 1, 54, "COST"), (2, 1, None, "COST")]


def test_links_of_short_posts(spark):
    page = '<html><article class=x data-author="u1" data-content="post-1"><div class="bbWrapper">Hi <a href="https://news.example.org/a/1">Read this</a></div> </div> </div> </article>'
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [(r["id"], [x["url"] for x in r["links"]]) for r in forum.linked(pages, "html", "page_id").collect()] == [("post-1", ["https://news.example.org/a/1"])]
    assert forum.posts(pages, "html", "page_id").count() == 0


def test_headings_of_elements_alone(spark):
    pages = spark.createDataFrame([(1, "<h1>Ab</h1><p>4129332095140658 He said.</p>")], "page_id long, html string")
    assert [r["text"] for r in bookheads.epub_headings(pages, "html", "page_id", (1,), 2).collect()] == ["Ab"]


def test_text_is_no_heading(spark):
    docs = spark.createDataFrame([(1, "4703443633947811 Ach ist.", "de", "web", 25), (2, "12. Words", "de", "web", 9), (3, None, "de", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = bookheads.epub_headings(docs.selectExpr("doc_id", f"{HTML} AS html"), "html", "doc_id").collect()
    assert sorted((r["doc_id"], r["layer"]) for r in got) == [(d, k) for d in (1, 2, 3) for k in (1, 2, 3, 4)]


def test_category_stats_by_severity_too(spark):
    """All of a category, and each of its severities, issues without one among them."""
    rows = [("a", "low", True, True), ("a", "low", True, False), ("a", "high", True, False), ("a", "high", False, False), ("a", None, False, False), ("b", "low", None, None)]
    got = store.category_stats(spark.createDataFrame(rows, "category string, severity string, fix_attempted boolean, fix_succeeded boolean")).collect()
    want = {("a", None, 1, 5, 3, 1, 33.3), ("a", "low", 0, 2, 2, 1, 50.0), ("a", "high", 0, 2, 1, 0, 0.0), ("a", None, 0, 1, 0, 0, 0.0), ("b", None, 1, 1, 0, 0, 0.0), ("b", "low", 0, 1, 0, 0, 0.0)}
    assert len(got) == len(want) and set(map(tuple, got)) == want
