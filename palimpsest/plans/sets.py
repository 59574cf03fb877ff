"""Queries of filters, set operations, top rows, joins, sections, images and baselines."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import choose as C
from ..operators import gates, layout, pages as P, reportfiles as R, store
from .registry import query


@query("optional_filters", "SELECT book_id FROM books_v WHERE publisher = (SELECT max(publisher) FROM books_v) AND (format = 'en' OR format IS NULL)", "books_v")
def optional_filters(b):
    top = b.agg(F.max("publisher").alias("publisher"))
    d = b.join(F.broadcast(top), "publisher", "left_semi")  # one row
    return C.where_given(d, year=None).where(C.matches_or_any("format", "en")).select("book_id")


@query("completed_filter", "SELECT file_id, status FROM runs_v WHERE run = 199503 AND file_id NOT IN (SELECT file_id FROM runs_v WHERE run < 199503 AND status = 'PASS')", "runs_v")
def completed_filter(r):
    return C.not_done(r.where("run = 199503"), r.where("run < 199503 AND status = 'PASS'"), "file_id").select("file_id", "status")


@query("resumed_run", "SELECT status, count(*) AS n FROM (SELECT file_id, status FROM runs_v WHERE run = 199502 UNION ALL SELECT file_id, status FROM runs_v WHERE run = 199503 AND file_id NOT IN (SELECT file_id FROM runs_v WHERE run = 199502)) GROUP BY 1", "runs_v")
def resumed_run(r):
    old = r.where("run = 199502").select("file_id", "status")
    return C.resumed(old, r.where("run = 199503").select("file_id", "status"), "file_id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("chain_succeeded", "SELECT o_orderkey, (o_orderstatus = 'F' OR o_totalprice > 250000 OR starts_with(o_orderpriority, '1') OR o_orderpriority = '2-HIGH') AND (o_totalprice > 20000 OR starts_with(o_orderpriority, '5')) AS ok FROM orders", "orders")
def chain_succeeded(o):
    """Of each order two links: delivery unless it is final, and payment; urgent ones count as skipped, high ones as disabled."""
    p, price = F.col("o_orderpriority"), F.col("o_totalprice")
    message = F.when(p.startswith("1"), F.concat(F.lit("skipped: "), p)).when(p == "2-HIGH", "disabled").otherwise(p)
    unpaid = F.when(p.startswith("5"), F.concat(F.lit("skipped by "), p)).otherwise("error")
    return o.select("o_orderkey", C.chain_ok([(F.col("o_orderstatus") != "F", price > 250_000, message), (F.lit(True), price > 20_000, unpaid)]).alias("ok"))


@query("headings_without_twin", r"WITH h AS (SELECT doc_id, text, trim(regexp_replace(lower(regexp_replace(text, '(?i)^(chapter|part|section)\s+[0-9ivxlc]+[.:)]*\s*', '')), '\s+', ' ', 'g')) AS k FROM (SELECT DISTINCT doc_id, text, font_size FROM blocks_v)) SELECT DISTINCT a.doc_id, a.text FROM h a WHERE NOT EXISTS (SELECT 1 FROM blocks_v b WHERE b.doc_id = a.doc_id AND b.page = 3 AND trim(regexp_replace(lower(regexp_replace(b.text, '(?i)^(chapter|part|section)\s+[0-9ivxlc]+[.:)]*\s*', '')), '\s+', ' ', 'g')) = a.k)", "blocks_v")
def headings_without_twin(b):
    d = b.select("doc_id", "text").distinct()
    return layout.without_twin(d, b.where("page = 3"), "doc_id")


@query("stem_sets", "WITH l AS (SELECT DISTINCT book_id FROM conversions_v WHERE path = 'R' AND book_id % 3 = 0), r AS (SELECT DISTINCT book_id FROM conversions_v WHERE path = 'A' AND book_id % 2 = 0) SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM l INTERSECT SELECT * FROM r) UNION ALL SELECT 'left', count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT 'right', count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l)", "conversions_v")
def stem_sets(c):
    return C.sides(c.where("path = 'R' AND book_id % 3 = 0").select("book_id"), c.where("path = 'A' AND book_id % 2 = 0").select("book_id")).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


PAGES = "p AS (SELECT book_id, report, list_sort(list(DISTINCT page_number)) AS p FROM vqa_v GROUP BY 1, 2), ab AS (SELECT a.book_id, a.p AS a, b.p AS b FROM p a JOIN p b ON a.book_id = b.book_id AND a.report = 'candidate' AND b.report = 'baseline')"


def _pages_by_report(v):
    d = v.groupBy("book_id", "report").agg(F.sort_array(F.collect_set("page_number")).alias("p"))
    side = lambda r, n: d.where(F.col("report") == r).select("book_id", F.col("p").alias(n))
    return side("candidate", "a").join(side("baseline", "b"), "book_id")


@query("page_sets", f"WITH {PAGES} SELECT book_id, a = b AS same, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missing, CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 THEN 'complete' ELSE 'partial' END AS state FROM ab", "vqa_v")
def page_sets(v):
    return _pages_by_report(v).select("book_id", C.same_set(F.col("a"), F.col("b")).alias("same"), R.coverage(F.col("a"), F.col("b")).alias("c")).select("book_id", "same", F.array_join("c.missing", ",").alias("missing"), "c.state")


@query("signals", "SELECT doc_id, page, text, y0, array_to_string(list_filter([CASE WHEN is_bold THEN 'bold' END, CASE WHEN font_size >= 15 THEN 'large' END, CASE WHEN x0 >= 120 THEN 'centered' END], lambda x: x IS NOT NULL), ',') AS signals, count(*) AS n FROM blocks_v GROUP BY ALL", "blocks_v")
def signals(b):
    """Signals of each block, some told twice."""
    bold, large, centred = (F.when(F.expr(c), n) for c, n in (("is_bold", "bold"), ("font_size >= 15", "large"), ("x0 >= 120", "centered")))
    d = b.select("doc_id", "page", "text", "y0", F.array_join(C.ordered_signals(bold, large, bold, centred, large), ",").alias("signals"))
    return d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("n"))


@query("latest_scored", "SELECT book_id, score, created_at FROM conversions_v WHERE score IS NOT NULL ORDER BY created_at DESC, l_orderkey, l_partkey, l_suppkey, iteration LIMIT 20", "conversions_v")
def latest_scored(c):
    """The last 20 scored conversions: a report's limit."""
    return C.newest(c.where("score IS NOT NULL"), "created_at", 20, "l_orderkey", "l_partkey", "l_suppkey", "iteration").select("book_id", "score", "created_at")


@query("applicable_fixes", "SELECT fix, times_applied, success_rate, row_number() OVER (ORDER BY success_rate DESC, times_applied DESC, fix) AS place FROM (SELECT category AS fix, count(*) AS times_applied, avg(fix_succeeded::INT) AS success_rate FROM issues_v WHERE fix_attempted GROUP BY 1) WHERE success_rate >= 0.7", "issues_v")
def applicable_fixes(i):
    return C.applicable_fixes(i)


@query("failing_types", "SELECT publisher, n FROM (SELECT coalesce(publisher, 'unknown') AS publisher, count(*) AS n FROM conversions_v JOIN books_v USING (book_id) WHERE score < 30 GROUP BY 1) ORDER BY n DESC, publisher LIMIT 3", "conversions_v", "books_v")
def failing_types(c, b):
    """The three sources with most failures: a report's limit."""
    return C.most_common(c.where("score < 30").join(b, "book_id").select(F.coalesce("publisher", F.lit("unknown")).alias("publisher")), "publisher", 3)


@query("newest_output", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-05' AND event_type = 'view' GROUP BY 1", "events")
def newest_output(e):
    return C.newest_after(e.where("event_type = 'view'"), "user_id", "2024-01-05 00:00:00")


@query("best_extractor", "SELECT book_id, arg_max(path, (score, cost_cents, path)) AS path FROM conversions_v WHERE score IS NOT NULL GROUP BY 1", "conversions_v")
def best_extractor(c):
    return C.best_by(c.where("score IS NOT NULL"), "book_id", "score", "cost_cents", "path")


@query("extractor_wins", "WITH r AS (SELECT book_id, CASE WHEN book_id % 7 >= book_id % 5 THEN 'a' ELSE 'b' END AS extractor FROM books_v) SELECT extractor, count(*) AS wins, round_even(count(*) * 100::DOUBLE / (SELECT count(*) FROM r), 1) AS percent FROM r GROUP BY 1", "books_v")
def extractor_wins(b):
    entry = lambda n: F.struct((F.col("book_id") % n).alias("score"), F.lit(1).alias("words"))
    return P.best_extractors(b.select(F.create_map(F.lit("a"), entry(7), F.lit("b"), entry(5)).alias("results")))


@query("fix_type_stats", "SELECT category, count(*) AS n, count_if(fix_attempted) AS attempted, round_even(avg(book_id), 1) AS mean_book FROM issues_v GROUP BY 1", "issues_v")
def fix_type_stats(i):
    return store.fix_stats(i)


@query("histograms", "SELECT publisher, format, count(*) AS n FROM books_v GROUP BY GROUPING SETS ((publisher), (format))", "books_v")
def histograms(b):
    return store.histograms(b, "publisher", "format")


@query("cached_books", "SELECT event_id, book_id FROM cache_v LEFT JOIN (SELECT book_id, book_id % 50 AS h FROM books_v) ON hash = h", "cache_v", "books_v")
def cached_books(c, b):
    """Entries with each book of their hash, fan-out and all."""
    return c.join(b.select("book_id", (F.col("book_id") % 50).alias("hash")), "hash", "left").select("event_id", "book_id")


@query("override_lookup", "WITH a AS (SELECT s_suppkey AS wanted, 0 AS way, book_id FROM supplier JOIN books_v ON book_id = s_suppkey * 7 UNION ALL SELECT s_suppkey, 1, book_id FROM supplier JOIN books_v ON file_size = s_suppkey + 200 UNION ALL SELECT s_suppkey, 2, book_id FROM supplier JOIN books_v ON title = 'doc ' || s_suppkey * 2 UNION ALL SELECT s_suppkey, 3, book_id FROM supplier JOIN books_v ON year = 1950 + s_suppkey) SELECT wanted, way, min(book_id) AS book_id FROM a JOIN (SELECT wanted, min(way) AS way FROM a GROUP BY 1) USING (wanted, way) GROUP BY 1, 2", "supplier", "books_v")
def override_lookup(s, b):
    w = s.select(F.col("s_suppkey").alias("wanted"))
    return store.fallback_lookup(w, [(b, b["book_id"] == w["wanted"] * 7), (b, b["file_size"] == w["wanted"] + 200), (b, b["title"] == F.concat(F.lit("doc "), (w["wanted"] * 2).cast("string"))), (b, b["year"] == 1950 + w["wanted"])], "wanted")


@query("zipped_pages", "WITH r AS (SELECT book_id, report, page_number, row_number() OVER (PARTITION BY book_id, report ORDER BY page_number) - 1 AS pos FROM (SELECT DISTINCT book_id, report, page_number FROM vqa_v)), n AS (SELECT book_id, report, count(*) AS n FROM r GROUP BY 1, 2) SELECT a.book_id, a.pos::INT AS pos, a.page_number AS page_a, b.page_number AS page_b FROM r a JOIN r b ON a.book_id = b.book_id AND a.pos = b.pos AND a.report = 'candidate' AND b.report = 'baseline' JOIN n x ON x.book_id = a.book_id AND x.report = 'candidate' JOIN n y ON y.book_id = a.book_id AND y.report = 'baseline' WHERE x.n = y.n", "vqa_v")
def zipped_pages(v):
    d = v.groupBy("book_id", "report").agg(F.sort_array(F.collect_set("page_number")).alias("p"))
    side = lambda r: d.where(F.col("report") == r).select("book_id", "p")
    return C.zipped(side("candidate"), side("baseline"), "book_id")[0]


@query("duplicate_lines", "WITH l AS (SELECT doc_id, pos, line, lag(line) OVER w AS before FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM outline_v)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), g AS (SELECT *, sum(CASE WHEN line = before AND line <> '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS place FROM g) SELECT doc_id, count_if(place % 2 = 0) AS n_dropped FROM r GROUP BY 1", "outline_v")
def duplicate_lines(d):
    """Second lines of pairs in runs of equal lines, counted inside each row."""

    def n(lines):
        starts = F.transform(lines, lambda x, i: F.when((x == F.get(lines, i - 1)) & (x != ""), F.lit(-1)).otherwise(i))
        return F.size(F.filter(F.transform(L.latest(F.transform(starts, lambda s: F.coalesce(s, F.lit(0)))), lambda s, i: (i - s) % 2), lambda odd: odd == 1)).cast("long")

    return d.select("doc_id", L.once(F.split("text", "\n"), n).alias("n_dropped"))


@query("line_sections", "WITH l AS (SELECT doc_id, unnest(range(len(l)))::INT AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM outline_v)) SELECT section, count(*) AS n FROM (SELECT last_value(CASE WHEN starts_with(line, 'CHAPTER') OR starts_with(line, '#') THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS section FROM l) GROUP BY 1", "outline_v")
def line_sections(d):
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    head = F.col("line").startswith("CHAPTER") | F.col("line").startswith("#")
    return P.sections(lines, head, "doc_id").groupBy("section").agg(F.count(F.lit(1)).alias("n"))


@query("text_chapters", r"WITH p AS (SELECT doc_id, unnest(range(len(l)))::INT AS place, trim(regexp_replace(unnest(l), '^\s+|\s+$', '', 'g')) AS line FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM outline_v)), h AS (SELECT *, length(line) <= 120 AND line = upper(line) AND regexp_matches(line, '(?:^|\s)\pL{2,}(?:\s|$)') AS head FROM p WHERE line <> ''), c AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS chapter FROM h) SELECT doc_id, chapter::BIGINT AS chapter, coalesce(max(CASE WHEN head THEN line END), 'FRONT MATTER') AS title, count_if(NOT head) AS n_paragraphs, sum(CASE WHEN head THEN 0 ELSE length(line) END)::BIGINT AS n_chars FROM c GROUP BY 1, 2 HAVING count_if(NOT head) > 0", "outline_v")
def text_chapters(d):
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("place", "line"))
    return P.chapters(lines, "doc_id")


@query("readable_bookmarks", r"SELECT page_id, readable, count(*) AS n FROM (SELECT page_id, coalesce(length(t) >= 2 AND length(regexp_replace(t, '[\p{C}\p{Zl}\p{Zp}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g'))::DOUBLE / length(t) >= 0.7 AND regexp_matches(t, '\pL'), false) AS readable FROM (SELECT page_id, trim(unnest(string_split(regexp_replace(html, '<[^>]+>', '|', 'g'), '|')), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM pages)) GROUP BY 1, 2", "pages")
def readable_bookmarks(p):
    """Every text between the tags of each page, as if it were a bookmark."""
    d = p.select("page_id", F.explode(F.split(F.regexp_replace("html", "<[^>]+>", "|"), r"\|", -1)).alias("t"))
    return d.groupBy("page_id", P.readable_bookmark(F.col("t")).alias("readable")).agg(F.count(F.lit(1)).alias("n"))


@query("sample_places", "WITH s AS (SELECT book_id, n, floor(n * 0.1::DOUBLE)::INT AS a, floor(n * 0.9::DOUBLE)::INT AS b FROM (SELECT book_id, file_size % 400 AS n FROM books_v)) SELECT book_id, CASE WHEN b <= a THEN array_to_string(range(least(10, n)), ',') ELSE array_to_string(list_filter(list_transform(range(10), lambda i: a + i * greatest(1, (b - a) // 10)), lambda p: p < b), ',') END AS places FROM s", "books_v")
def sample_places(b):
    return b.select("book_id", F.array_join(P.sample_places(F.col("file_size") % 400), ",").alias("places"))


@query("page_ranges", "SELECT book_id, count(*) AS n_parts, max(least(first + 30, n)) AS last FROM (SELECT book_id, n, unnest(range(0, n, 30)) AS first FROM (SELECT book_id, file_size % 400 AS n FROM books_v)) GROUP BY 1", "books_v")
def page_ranges(b):
    d = b.select("book_id", F.explode(P.page_ranges(F.col("file_size") % 400, 30)).alias("r"))
    return d.groupBy("book_id").agg(F.count(F.lit(1)).alias("n_parts"), F.max("r.end").cast("long").alias("last"))


IMAGES = "im AS (SELECT l_suppkey AS file_id, l_partkey % 20 AS page, (l_partkey * 7) % 900 AS width, (l_orderkey * 3) % 900 AS height, l_orderkey % 9000 AS bytes, 400000 AS page_area FROM lineitem), k AS (SELECT *, CASE WHEN width < 50 OR height < 50 THEN 'icon' WHEN width * height > page_area * 0.7 THEN 'full-page' WHEN bytes / 1024.0 < 2 THEN 'tiny' ELSE 'meaningful' END AS kind FROM im)"


def _images(x):
    return x.selectExpr("l_suppkey AS file_id", "l_partkey % 20 AS page", "(l_partkey * 7) % 900 AS width", "(l_orderkey * 3) % 900 AS height", "l_orderkey % 9000 AS bytes", "400000 AS page_area")


@query("image_kinds", f"WITH {IMAGES} SELECT kind, count(*) AS n FROM k GROUP BY 1", "lineitem")
def image_kinds(x):
    return P.image_kinds(_images(x)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("image_density", f"WITH {IMAGES}, p AS (SELECT file_id, page, count(*) AS n, count_if(kind = 'meaningful') AS m, count_if(kind = 'full-page') AS f FROM k GROUP BY 1, 2), d AS (SELECT file_id, sum(n)::BIGINT AS total_images, sum(m)::BIGINT AS meaningful, count(*) AS pages_with_images, count_if(n = 1 AND f = 1) AS scan_pages FROM p GROUP BY 1) SELECT file_id, total_images, meaningful, pages_with_images, scan_pages, round_even(total_images / 20.0::DOUBLE, 2) AS images_per_page FROM d WHERE meaningful >= 3 AND NOT scan_pages >= 14", "lineitem", "supplier")
def image_density(x, s):
    d = P.image_density(_images(x), s.select(F.col("s_suppkey").alias("file_id"), F.lit(20).alias("total_pages")))
    return P.image_candidates(d, 3).select("file_id", "total_images", "meaningful", "pages_with_images", "scan_pages", "images_per_page")


@query("columned", "WITH b AS (SELECT l_suppkey AS doc_id, l_partkey % 5 AS page, CASE WHEN l_suppkey % 3 = 0 THEN (l_linenumber % 2) * 320 ELSE l_linenumber * 60 END AS x0, 600 AS w FROM lineitem), c AS (SELECT *, x0 + 250 AS x1 FROM b), p AS (SELECT doc_id, page, count(*) AS n, count_if(x0 < 240) AS l, count_if(x0 > 180) AS r, max(CASE WHEN x0 < 240 THEN x1 END) AS le, min(CASE WHEN x0 > 180 THEN x0 END) AS rs FROM c GROUP BY 1, 2), t AS (SELECT doc_id, count(*) AS n_pages, count_if(n >= 4 AND l >= 2 AND r >= 2 AND rs - le > 30) AS n_columned FROM p GROUP BY 1) SELECT *, n_columned >= least(2, n_pages) AS columned FROM t", "lineitem")
def columned(x):
    x0 = F.when(F.col("l_suppkey") % 3 == 0, (F.col("l_linenumber") % 2) * 320).otherwise(F.col("l_linenumber") * 60)
    return P.columned(x.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 5).alias("page"), x0.alias("x0"), (x0 + 250).alias("x1"), F.lit(600).alias("page_width")))


MEASURES = "SELECT p_partkey AS id, (p_size * {k}) % 9 AS h1_count, p_size % 11 AS h2_count, (p_size * {k}) % 4 AS h3_count, (p_partkey * {k}) % 5 AS linked_footnotes, p_partkey % 6 AS ligature_splits, (p_partkey * {k}) % 8 AS double_spaces FROM part"


def _measures(p, k):
    return p.selectExpr("p_partkey AS id", f"(p_size * {k}) % 9 AS h1_count", "p_size % 11 AS h2_count", f"(p_size * {k}) % 4 AS h3_count", f"(p_partkey * {k}) % 5 AS linked_footnotes", "p_partkey % 6 AS ligature_splits", f"(p_partkey * {k}) % 8 AS double_spaces")


@query("baseline_gate", f"WITH n AS ({MEASURES.format(k=1)}), o AS ({MEASURES.format(k=3)}), j AS (SELECT n.id, unnest(['h1_count', 'h2_count', 'h3_count', 'linked_footnotes', 'ligature_splits', 'double_spaces']) AS rule, unnest([o.h1_count, o.h2_count, o.h3_count, o.linked_footnotes, o.ligature_splits, o.double_spaces])::BIGINT AS expected, unnest([n.h1_count, n.h2_count, n.h3_count, n.linked_footnotes, n.ligature_splits, n.double_spaces])::BIGINT AS actual FROM n JOIN o USING (id)) SELECT *, CASE WHEN rule IN ('h1_count', 'h2_count', 'h3_count') THEN abs(actual - expected) <= 2 WHEN rule = 'linked_footnotes' THEN actual >= expected ELSE actual <= expected END AS passed FROM j WHERE NOT (rule = 'linked_footnotes' AND expected = 0)", "part")
def baseline_gate(p):
    return P.against_baseline(_measures(p, 1), _measures(p, 3), "id")


@query("audit_codes", "SELECT book_id, max(CASE category WHEN 'text_integrity' THEN 3 WHEN 'page_layout' THEN 2 WHEN 'paragraph_flow' THEN 1 ELSE 0 END) AS code FROM vqa_v GROUP BY 1", "vqa_v")
def audit_codes(v):
    return gates.exit_codes(v, "book_id", {"text_integrity": 3, "page_layout": 2, "paragraph_flow": 1}, "category")


@query("model_costs", "SELECT event_id, CASE event_type WHEN 'view' THEN 0.00025::DOUBLE WHEN 'click' THEN 0.003::DOUBLE ELSE 0.015::DOUBLE END * user_id AS cost FROM events", "events")
def model_costs(e):
    name = F.when(F.col("event_type") == "view", "x-haiku").when(F.col("event_type") == "click", "a-sonnet-4").otherwise("opus")
    return e.select("event_id", C.cost(name, F.col("user_id"), {"haiku": 0.00025, "sonnet": 0.003}, 0.015).alias("cost"))


@query("footnote_blocks", "SELECT doc_id, count_if((y0 / 800.0::DOUBLE <= 0.15 AND font_size / 12.0::DOUBLE < 0.95) OR (y0 / 800.0::DOUBLE <= 0.40 AND font_size / 12.0::DOUBLE < 0.85)) AS n FROM blocks_v GROUP BY 1", "blocks_v")
def footnote_blocks(b):
    return b.groupBy("doc_id").agg(F.sum(F.when(layout.footnote(F.col("y0") / 800, F.col("font_size") / 12), 1).otherwise(0)).alias("n"))


@query("toc_levels", "SELECT doc_id, CASE WHEN count(*) > 5 AND bool_and(level = 1) THEN 2 ELSE min(level) END AS top FROM (SELECT l_orderkey AS doc_id, CASE WHEN l_returnflag = 'N' THEN 1 ELSE l_linenumber END AS level FROM lineitem) GROUP BY 1", "lineitem")
def toc_levels(x):
    d = x.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "N", 1).otherwise(F.col("l_linenumber")).alias("level"))
    return layout.demoted(d, "doc_id").groupBy("doc_id").agg(F.min("level").alias("top"))


@query("heading_texts", r"SELECT DISTINCT text, trim(lower(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'), ' *[0-9]{1,3}$', ''))) AS plain, trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^(chapter|part|section)\s+[0-9ivxlc]+[.:)]*\s*', ''), '^[0-9]+[.:)]\s*', ''), '^[IVXLC]+[.:)]\s*', '')), '\s+', ' ', 'g')) AS key FROM blocks_v", "blocks_v")
def heading_texts(b):
    from ..functions.text import normal_heading

    return b.select("text").distinct().select("text", normal_heading(F.col("text")).alias("plain"), layout.dedup_key(F.col("text")).alias("key"))


@query("scripts", r"SELECT doc_id, len(regexp_extract_all(text, '\p{Greek}'))::BIGINT AS greek, len(regexp_extract_all(text, '[\x{100}-\x{24f}]'))::BIGINT AS latin_ext, round_even(len(regexp_extract_all(text, '[\x{c0}-\x{24f}]')) * 100::DOUBLE / greatest(length(text), 1), 2) AS accented FROM documents", "documents")
def scripts(d):
    return d.select("doc_id", *(c.alias(n) for n, c in C.scripts(F.col("text")).items()))


@query("debris_density", r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0b]+'), lambda x: x <> '') AS w FROM dirty_v) SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '[{}|\\]|!!!|\pL\(\pL|�')))::DOUBLE / len(w) ELSE 0 END AS density FROM w", "dirty_v")
def debris_density(d):
    return d.select("doc_id", C.debris(F.col("text")).alias("density"))


@query("zones", "WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, len(w[1:3000])::INT AS head, greatest(0, least(2000, len(w) - 3000))::INT AS tail FROM w", "documents")
def zones(d):
    z = C.zones(F.col("text"))
    return d.select("doc_id", F.size(z["head"]).alias("head"), F.size(z["tail"]).alias("tail"))


@query("decades", "SELECT book_id, (year // 10 * 10)::VARCHAR || 's' AS decade FROM books_v", "books_v")
def decades(b):
    from ..functions.naming import decade

    return b.select("book_id", decade(F.col("year")).alias("decade"))


@query("profiles", """WITH b AS (SELECT book_id, coalesce(publisher, '') AS publisher, coalesce(format, '') AS format, (year // 10 * 10)::VARCHAR || 's' AS decade FROM books_v), l AS (SELECT book_id, max(iteration) AS last FROM conversions_v GROUP BY 1), c AS (SELECT * FROM conversions_v JOIN b USING (book_id) JOIN l USING (book_id)),
m AS (SELECT publisher, format, count(DISTINCT book_id) AS n_books, avg(CASE WHEN iteration = 1 THEN score END) AS first_score, avg(score) AS mean_score, avg(last) AS mean_iterations FROM c GROUP BY 1, 2), p AS (SELECT publisher, format, arg_max(path, (s, path)) AS best_path FROM (SELECT publisher, format, path, avg(score) AS s FROM c WHERE score IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
i AS (SELECT publisher, format, string_agg(category || '(' || n || ')', ', ' ORDER BY n DESC, category) AS common_issues FROM (SELECT *, row_number() OVER (PARTITION BY publisher, format ORDER BY n DESC, category) AS place FROM (SELECT publisher, format, category, count(*) AS n FROM issues_v JOIN b USING (book_id) GROUP BY 1, 2, 3)) WHERE place <= 5 GROUP BY 1, 2)
SELECT publisher, format, decade, n_books, first_score, mean_score, mean_iterations, best_path, common_issues FROM (SELECT DISTINCT publisher, format, decade FROM b) JOIN m USING (publisher, format) LEFT JOIN p USING (publisher, format) LEFT JOIN i USING (publisher, format)""", "conversions_v", "books_v", "issues_v")
def profiles(c, b, i):
    return store.profiles(c, b, i)
