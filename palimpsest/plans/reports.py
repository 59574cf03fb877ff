"""Queries over reports, layout, lines, sources, caches and fixes."""
from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import gates, layout, sourcing, store
from ..streaming import events as ev
from .registry import query

ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
FIRST = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY report, book_id, page_number ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity) AS place FROM vqa_v) WHERE place = 1)"
DELTAS = f"""{FIRST}, a AS (SELECT * FROM f WHERE report = 'candidate'), b AS (SELECT * FROM f WHERE report = 'baseline'),
d AS (SELECT *, overlap_pages::DOUBLE / greatest(candidate_pages, baseline_pages) AS overlap FROM (SELECT coalesce(a.book_id, b.book_id) AS book_id, count(a.book_id) AS candidate_pages, count(b.book_id) AS baseline_pages, count_if(a.book_id IS NOT NULL AND b.book_id IS NOT NULL) AS overlap_pages, avg(abs(a.score - b.score)) AS mean_delta, max(abs(a.score - b.score)) AS max_delta, count_if(a.n_issues = 0 AND b.n_issues > 0) AS misses FROM a FULL JOIN b ON a.book_id = b.book_id AND a.page_number = b.page_number GROUP BY 1) WHERE candidate_pages > 0 AND baseline_pages > 0)"""


def _deltas(v):
    report = lambda name: gates.first_pages(v.where(F.col("report") == name), *ORDER)
    return gates.book_deltas(report("candidate"), report("baseline"))


@query("book_deltas", f"WITH {DELTAS} SELECT * FROM d", "vqa_v")
def book_deltas(v):
    return _deltas(v)


@query("gate", f"WITH {DELTAS} SELECT count(*) AS n_books, avg(mean_delta) AS equal_mean, sum(mean_delta * overlap_pages) FILTER (mean_delta IS NOT NULL) / sum(overlap_pages) FILTER (mean_delta IS NOT NULL) AS page_mean, max(mean_delta) AS worst_book, coalesce(bool_or(overlap < 0.5), false) AS overlap_fails, coalesce(avg(mean_delta) < 15 AND max(mean_delta) <= 20, false) AS passed FROM d", "vqa_v")
def gate(v):
    return gates.gate(_deltas(v))


@query("category_scores", "WITH w AS (SELECT book_id, coalesce(category, 'unknown') AS category, page_number, CASE severity WHEN 'critical' THEN 25 WHEN 'major' THEN 15 WHEN 'moderate' THEN 10 ELSE 5 END AS weight FROM vqa_v) SELECT book_id, category, sum(weight)::BIGINT AS deducted, count(DISTINCT page_number) AS n_pages, greatest(0, round_even(100 - sum(weight)::DOUBLE / count(DISTINCT page_number), 0))::BIGINT AS score FROM w GROUP BY 1, 2", "vqa_v")
def category_scores(v):
    return gates.category_scores(v)


BOOK_MODES = f"WITH {FIRST}, j AS (SELECT a.book_id, a.score >= 80 AND a.n_issues > 1 AS a, a.score >= 80 AND NOT a.n_issues > 1 AND b.n_issues > 0 AS b FROM f a JOIN f b ON a.book_id = b.book_id AND a.page_number = b.page_number AND a.report = 'candidate' AND b.report = 'baseline' WHERE a.score >= 75), s AS (SELECT book_id, avg(a::INT) AS share_a, avg(b::INT) AS share_b, count(*) AS n_pages FROM j GROUP BY 1) SELECT *, CASE WHEN share_a >= 0.7 THEN 'a' WHEN share_b >= 0.7 THEN 'b' WHEN share_a >= 0.55 THEN 'dominant-a' WHEN share_b >= 0.55 THEN 'dominant-b' ELSE 'mixed' END AS mode FROM s"


@query("book_modes", BOOK_MODES, "vqa_v")
def book_modes(v):
    a, b = (gates.first_pages(v.where(F.col("report") == r), *ORDER) for r in ("candidate", "baseline"))
    d = a.where("score >= 75").select("book_id", "page_number", "score", (F.col("n_issues") > 1).alias("own_serious")).join(b.select("book_id", "page_number", (F.col("n_issues") > 0).alias("other_serious")), ["book_id", "page_number"])
    return gates.book_modes(d)


@query("overall_mode", "WITH m AS (" + BOOK_MODES + ") SELECT avg((mode IN ('a', 'dominant-a'))::INT) AS share_a, avg((mode IN ('b', 'dominant-b'))::INT) AS share_b, count(*) AS n_books, CASE WHEN avg((mode IN ('a', 'dominant-a'))::INT) >= 0.7 THEN 'a' WHEN avg((mode IN ('b', 'dominant-b'))::INT) >= 0.7 THEN 'b' WHEN avg((mode IN ('a', 'dominant-a'))::INT) >= 0.55 THEN 'dominant-a' WHEN avg((mode IN ('b', 'dominant-b'))::INT) >= 0.55 THEN 'dominant-b' ELSE 'mixed' END AS mode FROM m", "vqa_v")
def overall_mode(v):
    return gates.overall_mode(book_modes(v))


@query("roll_up", """WITH p AS (SELECT book_id, page_number, max(score) AS score, page_number % 3 AS k FROM vqa_v GROUP BY book_id, page_number), t AS (SELECT book_id, round_even(avg(coalesce(score, 0)), 0)::BIGINT AS score FROM p GROUP BY 1), i AS (SELECT book_id, 'd' || page_number % 4 AS d, min(page_number) AS first FROM p WHERE k > 0 AND page_number % 5 > 1 GROUP BY 1, 2), l AS (SELECT book_id, string_agg(d, ',' ORDER BY first) AS top FROM i GROUP BY 1) SELECT t.book_id, t.score, coalesce(top, '') AS top FROM t LEFT JOIN l USING (book_id)""", "vqa_v")
def roll_up(v):
    p = v.groupBy("book_id", "page_number").agg(F.max("score").alias("score"))
    k = F.col("page_number")
    issue = F.struct(F.lit("x").alias("category"), F.when(k % 5 == 0, "minor").when(k % 5 == 1, "odd").when(k % 5 == 2, "moderate").otherwise("critical").alias("severity"), F.concat(F.lit("d"), (k % 4).cast("string")).alias("description"))
    d = gates.roll_up(p.withColumn("issues", F.when(k % 3 > 0, F.array(issue))))
    return d.select("book_id", "score", F.array_join("top_issues", ",").alias("top"))


@query("uniform_scores", f"WITH {FIRST}, p AS (SELECT book_id, page_number, CASE WHEN book_id % 3 = 0 AND page_number % 9 > 0 THEN 80 ELSE score END AS score FROM f WHERE report = 'candidate'), c AS (SELECT book_id, score, count(*) AS n, min(page_number) AS first FROM p GROUP BY 1, 2), t AS (SELECT book_id, sum(n) AS total, arg_max(score, (n, -first)) AS score, max(n) AS n FROM c GROUP BY 1) SELECT p.book_id, p.page_number, p.score FROM p JOIN t ON p.book_id = t.book_id AND p.score = t.score WHERE t.n >= 3 AND t.n >= 0.75 * total", "vqa_v")
def uniform_scores(v):
    p = gates.first_pages(v.where("report = 'candidate'"), *ORDER).select("book_id", "page_number", F.when((F.col("book_id") % 3 == 0) & (F.col("page_number") % 9 > 0), 80).otherwise(F.col("score")).alias("score"))
    return gates.uniform_scores(p).select("book_id", "page_number", "score")


FONTS = "c AS (SELECT doc_id, font_size, font_name, sum(length(text)) AS chars FROM blocks_v GROUP BY 1, 2, 3), z AS (SELECT doc_id, font_size, sum(chars) AS chars, arg_min(font_name, (-chars, font_name)) AS font_name FROM c GROUP BY 1, 2), fonts AS (SELECT doc_id, arg_min(font_size, (-chars, font_size)) AS body_size, arg_min(font_name, (-chars, font_size)) AS body_font, max(chars)::BIGINT AS body_chars FROM z GROUP BY 1)"


@query("body_fonts", f"WITH {FONTS} SELECT * FROM fonts", "blocks_v")
def body_fonts(b):
    return layout.body_fonts(b)


@query("noise_texts", """WITH pages AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM blocks_v GROUP BY 1), t AS (SELECT DISTINCT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) AS text, round_even(y0 / 5.0, 0)::BIGINT AS band, page FROM blocks_v),
x AS (SELECT doc_id, key, 'header' AS why, max(n) AS n, 0.5 AS share FROM (SELECT doc_id, lower(text) AS key, band, count(DISTINCT page) AS n FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2 UNION ALL SELECT doc_id, key, 'running', max(n), 0.3 FROM (SELECT doc_id, text, lower(text) AS key, count(DISTINCT page) AS n FROM t WHERE text = upper(text) AND len(string_split(text, ' ')) <= 5 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT doc_id, key, why, n FROM x JOIN pages USING (doc_id) WHERE n > share * n_pages""", "blocks_v")
def noise_texts(b):
    return layout.noise_texts(b)


HEADINGS = rf"""WITH {FONTS}, r AS (SELECT *, font_size::DOUBLE / body_size AS ratio, regexp_matches(text, '^(?:(?i:chapter|part)\s+[0-9]+|[0-9]+\.\s+[\pL\pN_]|[0-9]+\s+[A-Z]|[IVXLC]+\.\s+[\pL\pN_]|(?i:introduction|conclusion|preface|foreword|epilogue|prologue|appendix)\b)') AS chapter, (x1 - x0) / page_width::DOUBLE <= 0.75 AND abs((x0 + x1) / 2.0::DOUBLE - page_width / 2.0::DOUBLE) / page_width < 0.15 AS centered, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n_words FROM blocks_v JOIN fonts USING (doc_id)),
h AS (SELECT *, least(99, 30 + CASE WHEN ratio >= 1.5 THEN 30 ELSE 0 END + CASE WHEN is_bold THEN 20 ELSE 0 END + CASE WHEN chapter THEN 30 ELSE 0 END + CASE WHEN centered THEN 10 ELSE 0 END + CASE WHEN n_words <= 10 THEN 10 ELSE 0 END)::BIGINT AS confidence FROM r WHERE length(text) BETWEEN 3 AND 120 AND (ratio >= 1.5 OR (is_bold AND ratio >= 1.2) OR chapter)),
k AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY font_size DESC) AS rank FROM h),
l AS (SELECT *, CASE WHEN rank = 1 OR chapter THEN 1 WHEN rank = 2 OR (is_bold AND abs(font_size - (body_size + 2)) < 0.6) THEN 2 WHEN rank = 3 OR (is_bold AND abs(font_size - body_size) < 0.6) THEN 3 ELSE 2 END AS level FROM k)"""


@query("headings", f"{HEADINGS} SELECT doc_id, page, text, level, confidence, count(*) AS n FROM l GROUP BY 1, 2, 3, 4, 5", "blocks_v")
def headings(b):
    d = layout.heading_levels(layout.heading_candidates(b, layout.body_fonts(b)))
    return d.groupBy("doc_id", "page", "text", "level", "confidence").agg(F.count(F.lit(1)).alias("n"))


B = r"[ \t\r\f\x0b]"
MERGE = rf"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM lines_v), k AS (SELECT *, list_transform(l, lambda x, i: i > 1 AND regexp_matches(regexp_replace(x, '^{B}+|{B}+$', '', 'g'), '^\p{{Ll}}') AND regexp_matches(regexp_replace(l[i - 1], '^{B}+|{B}+$', '', 'g'), '^[^#]') AND NOT regexp_matches(regexp_replace(l[i - 1], '^{B}+|{B}+$', '', 'g'), '[.!?:;"”]$')) AS j FROM s),
o AS (SELECT doc_id, len(list_filter(j, lambda x: x))::BIGINT AS n_merged, list_transform(list_transform(l, lambda x, i: CASE WHEN j[i] THEN ' ' || regexp_replace(x, '^{B}+|{B}+$', '', 'g') WHEN i > 1 THEN chr(10) || x ELSE x END), lambda x, i: CASE WHEN coalesce(j[i + 1], false) THEN regexp_replace(x, '{B}+$', '') ELSE x END) AS p FROM k) SELECT doc_id, n_merged, md5(array_to_string(p, '')) AS digest FROM o"""


@query("merge_continuations", MERGE, "lines_v")
def merge_continuations(d):
    d = d.select("doc_id", L.merged(F.col("text")).alias("m"))
    return d.select("doc_id", "m.n_merged", F.md5(F.col("m.text").cast("binary")).alias("digest"))


COMMON_SQL = ", ".join(f"'{w}'" for w in L.COMMON)


@query("common_words", rf"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\x0b]+'), lambda x: length(x) BETWEEN 3 AND 15) AS w FROM documents) SELECT doc_id, CASE WHEN len(w) >= 50 THEN len(list_filter(w[1:200], lambda x: x IN ({COMMON_SQL})))::DOUBLE / least(200, len(w)) END AS share FROM w", "documents")
def common_words(d):
    return d.select("doc_id", L.common_share(F.col("text")).alias("share"))


@query("source_kinds", """WITH a AS (SELECT *, CASE WHEN density < 50 THEN 'scan_no_text' WHEN density < 500 AND (image_dominant OR kb_page > 100) THEN 'scan_with_text' ELSE 'digital_native' END AS k0, CASE WHEN density < 50 AND image_dominant THEN 95 WHEN density < 50 THEN 70 WHEN density < 500 AND (image_dominant OR kb_page > 100) THEN 85 WHEN density >= 500 AND NOT image_dominant THEN 90 ELSE 60 END AS s0, coalesce(producer LIKE '%internet archive%', false) AS ia, coalesce(producer LIKE '%lura%', false) AS lu FROM files_v),
b AS (SELECT *, coalesce(k0 = 'digital_native' AND density >= 500 AND hit_rate < 0.05, false) AS garbled, CASE WHEN (ia OR lu) AND density < 200 THEN 'scan_no_text' WHEN ia THEN 'scan_with_text' ELSE k0 END AS k1, CASE WHEN ia AND density < 200 THEN greatest(s0, 85) WHEN ia THEN greatest(s0, 70) WHEN lu AND density < 200 THEN greatest(s0, 80) ELSE s0 END AS s1, (ia OR lu) AND density < 200 AS p1 FROM a)
SELECT file_id, CASE WHEN k1 = 'digital_native' AND kb_page > 25 THEN 'scan_with_text' ELSE k1 END AS kind, CASE WHEN k1 = 'digital_native' AND kb_page > 25 THEN least(95, greatest(s1 - 10, 60) + CASE WHEN ia OR lu THEN 10 ELSE 0 END) ELSE s1 END AS sure, garbled, p1 OR (density < 50 AND kb_page > 50) AS paid FROM b""", "files_v")
def source_kinds(f):
    return sourcing.classify_sources(f).select("file_id", "kind", "sure", "garbled", "paid")


@query("merge_metadata", "WITH old AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_name END AS title, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_brand END AS author, p_size % 6 AS priority FROM part), new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS title, o_orderstatus AS author, o_custkey % 6 AS priority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_custkey, o_totalprice) AS place FROM orders) WHERE place = 1) SELECT old.id, CASE WHEN new.title IS NOT NULL AND (old.title IS NULL OR new.priority > old.priority) THEN new.title ELSE old.title END AS title, CASE WHEN new.author IS NOT NULL AND (old.author IS NULL OR new.priority > old.priority) THEN new.author ELSE old.author END AS author, greatest(old.priority, new.priority) AS priority FROM old LEFT JOIN new USING (id)", "part", "orders")
def merge_metadata(p, o):
    null_if = lambda c, v: F.when(~c, F.col(v))
    old = p.select(F.col("p_partkey").alias("id"), null_if(F.col("p_size") % 3 == 0, "p_name").alias("title"), null_if(F.col("p_size") % 4 == 0, "p_brand").alias("author"), (F.col("p_size") % 6).cast("long").alias("priority"))
    new = ev.first_claims(o, ["o_orderkey"], "o_custkey", "o_totalprice").select(F.col("o_orderkey").alias("id"), null_if(F.col("o_orderkey") % 5 == 0, "o_orderpriority").alias("title"), F.col("o_orderstatus").alias("author"), (F.col("o_custkey") % 6).alias("priority"))
    return sourcing.merge_by_priority(old, new, "id", ["title", "author"])


@query("promoted_fixes", "SELECT *, n_applied >= 3 AND success_rate >= 0.7 AS promoted FROM (SELECT book_id % 40 AS fix, count(*) AS n_applied, avg(CASE WHEN fix_succeeded OR category = 'view' THEN 1.0::DOUBLE ELSE 0 END) AS success_rate FROM issues_v GROUP BY 1)", "issues_v")
def promoted_fixes(i):
    return sourcing.promoted_fixes(i.select((F.col("book_id") % 40).alias("fix"), (F.col("fix_succeeded") | (F.col("category") == "view")).alias("worked")))


@query("cache_stats", "SELECT tier, method, count(*) AS n, sum(served)::BIGINT AS served, sum(CASE WHEN served > 0 THEN cost_cents * served ELSE 0 END)::BIGINT AS saved_cents FROM cache_v GROUP BY GROUPING SETS ((), (tier), (method))", "cache_v")
def cache_stats(c):
    return store.cache_stats(c)


@query("best_cached", "SELECT hash, tier, quality, event_id FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY tier DESC, quality DESC NULLS LAST, event_id) AS place FROM cache_v WHERE quality IS NULL OR quality >= 20) WHERE place = 1", "cache_v")
def best_cached(c):
    return store.best_cached(c, 20, "event_id").select("hash", "tier", "quality", "event_id")


@query("quality_tiers", "SELECT publisher, median(score) AS middle, stddev_samp(score) AS spread, CASE WHEN floor(median(score)) >= 75 THEN 'clean' WHEN floor(median(score)) >= 50 THEN 'moderate' ELSE 'poor' END AS tier FROM conversions_v JOIN books_v USING (book_id) WHERE score IS NOT NULL GROUP BY 1", "conversions_v", "books_v")
def quality_tiers(c, b):
    return store.quality_tiers(c, b)


@query("top_categories", "SELECT publisher, category, n, place FROM (SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY n DESC, category) AS place FROM (SELECT coalesce(publisher, 'unknown') AS publisher, category, count(*) AS n FROM issues_v JOIN books_v USING (book_id) GROUP BY 1, 2)) WHERE place <= 5", "issues_v", "books_v")
def top_categories(i, b):
    return store.top_categories(i, b, 5)


@query("title_search", "SELECT p_partkey FROM part WHERE p_name ILIKE '%AR%'", "part")
def title_search(p):
    return p.where(F.col("p_name").ilike("%AR%")).select("p_partkey")


@query("sessions", "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM r GROUP BY user_id, run", "events")
def sessions(e):
    return ev.sessions(e, "user_id", "30 minutes")


@query("sliding_limit", "SELECT event_id, n FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2", "events")
def sliding_limit(e):
    return ev.over_limit(e, "user_id", 2, 86_400).select("event_id", "n")


@query("inbox", "SELECT user_id, event_type, min(ts) AS ts FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) GROUP BY 1, 2", "events", "customer")
def inbox(e, c):
    seen = c.where("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"))
    return ev.first_claims(e.join(seen, "user_id", "left_anti"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "ts")


@query("retry_numbers", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt FROM events", "events")
def retry_numbers(e):
    return e.select("event_id", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("attempt"))
