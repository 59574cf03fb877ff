"""Every query: an operator applied to whole tables, and the SQL whose rows it must equal (None where SQL has no form)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify, recipes, runs, search, store
from ..streaming import events as ev
from .registry import Q, query

def score_sql(t: str) -> str:
    """Score of a text by its replacement characters, torn ligatures, doubled blanks and control characters."""
    k = f"(1000.0::DOUBLE / length({t}))"
    ligatures = r"\b(?:[Tt]h e\b|[Tt]h is\b|[Tt]h at\b|[Tt]h ey\b|[Tt]h en\b|[Tt]h ere\b|[Tt]h ose\b|[Tt]h us\b|[Tt]h an\b|[Tt]h eir\b|[Tt]h em\b|[Tt]h ese\b|fi [a-z]|fl [a-z]|ffi [a-z]|ffl [a-z])"
    return f"""CASE WHEN length({t}) > 0 THEN greatest(0, round_even(100.0::DOUBLE - least(40.0::DOUBLE, (length({t}) - length(replace({t}, '�', ''))) * {k} * 5) - least(20.0::DOUBLE, len(regexp_extract_all({t}, '{ligatures}')) * {k} * 2) - least(10.0::DOUBLE, len(regexp_extract_all({t}, '  ')) * {k}) - least(10.0::DOUBLE, len(regexp_extract_all({t}, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) * {k} * 3), 0)) ELSE 0 END::BIGINT"""


SCORED = f"""judged AS (SELECT doc_id, source, lang, length(text) - length(replace(text, '�', '')) AS n_replaced, len(regexp_extract_all(text, '\\b(?:[Tt]h (?:e|is|at|ey|en|ere|ose|us|an|eir|em|ese)\\b|(?:fi|fl|ffi|ffl) [a-z])')) AS n_ligatures, len(regexp_extract_all(text, '  ')) AS n_doubles, len(regexp_extract_all(text, '[^{T.WHITE}]+')) AS n_words, {score_sql('text')} AS score FROM dirty_v)"""


@query("quality_by_source", f"WITH {SCORED} SELECT source, count(*) AS n_docs, count_if(NOT (score < 50 AND n_words > 100)) AS n_pass, count_if(score < 50 AND n_words > 100) AS n_warn, count_if(n_ligatures > 20) AS n_ligature, count_if(n_doubles > 20) AS n_double, count_if(n_words < 100) AS n_short, count_if(score < 50 AND n_words > 100) AS n_low, count_if(score >= 50 AND score < 75 AND n_words > 100) AS n_borderline, sum(n_words)::BIGINT AS n_words FROM judged GROUP BY source", "dirty_v")
def quality_by_source(d):
    return classify.quality_by_source(d)


@query("segment_quality", f"WITH {SCORED} SELECT doc_id, n_replaced, n_ligatures, n_doubles, n_words, score FROM judged", "dirty_v")
def segment_quality(d):
    return classify.text_quality(d).select("doc_id", "n_replaced", "n_ligatures", "n_doubles", "n_words", "score")


@query("source_profile", "WITH last AS (SELECT book_id, max(iteration) AS last FROM conversions_v GROUP BY 1) SELECT coalesce(publisher, 'unknown') AS publisher, count(DISTINCT book_id) AS n_books, count(*) AS n_conversions, avg(CASE WHEN iteration = 1 THEN score END) AS first_score, avg(score) AS mean_score, avg(last) AS mean_iterations FROM conversions_v JOIN books_v USING (book_id) LEFT JOIN last USING (book_id) GROUP BY 1", "conversions_v", "books_v")
def source_profile(c, b):
    return store.source_profile(c, b)


@query("best_paths", "SELECT *, row_number() OVER (PARTITION BY publisher ORDER BY mean_score DESC, path) AS place FROM (SELECT coalesce(publisher, 'unknown') AS publisher, path, avg(score) AS mean_score, count(*) AS n FROM conversions_v JOIN books_v USING (book_id) WHERE score IS NOT NULL GROUP BY 1, 2)", "conversions_v", "books_v")
def best_paths(c, b):
    return store.best_paths(c, b)


@query("category_stats", "SELECT category, severity, grouping(severity) AS grouping, count(*) AS n_issues, count_if(fix_attempted) AS attempted, count_if(fix_succeeded) AS succeeded, CASE WHEN count_if(fix_attempted) > 0 THEN round(count_if(fix_succeeded)::DOUBLE / count_if(fix_attempted) * 100, 1) ELSE 0 END AS fix_rate_pct FROM issues_v GROUP BY GROUPING SETS ((category), (category, severity))", "issues_v")
def category_stats(i):
    return store.category_stats(i)


@query("cost_summary", "SELECT count(*) AS n, count(DISTINCT book_id) AS n_books, sum(cost_cents)::BIGINT AS cost_cents, avg(cost_cents) AS mean_cents, sum(l_orderkey)::BIGINT AS input_tokens, sum(l_partkey)::BIGINT AS output_tokens, avg(score) AS mean_score FROM conversions_v", "conversions_v")
def cost_summary(c):
    return store.cost_summary(c.withColumnsRenamed({"l_orderkey": "input_tokens", "l_partkey": "output_tokens"}))


@query("publisher_report", "SELECT coalesce(publisher, 'unknown') AS publisher, count(DISTINCT book_id) AS n_books, count(score) AS n_scored, avg(score) AS mean_score, min(score) AS low, max(score) AS high FROM books_v LEFT JOIN (SELECT book_id, score FROM conversions_v) USING (book_id) GROUP BY 1 HAVING count(DISTINCT book_id) >= 10", "books_v", "conversions_v")
def publisher_report(b, c):
    return store.publisher_report(b, c, 10)


@query("amortisation", "SELECT *, CASE WHEN each = 0 THEN 'free' WHEN each < 50 THEN 'amortized' WHEN each < 200 THEN 'recovering' ELSE 'sunk' END AS state FROM (SELECT b.book_id, count(c.book_id) AS n, coalesce(sum(cost_cents // 1000), 0)::BIGINT AS cost_cents, max(score) AS best, CASE WHEN count(c.book_id) = 0 THEN 0 ELSE round(coalesce(sum(cost_cents // 1000), 0)::DOUBLE / count(c.book_id), 2) END AS each FROM books_v b LEFT JOIN conversions_v c USING (book_id) GROUP BY 1)", "books_v", "conversions_v")
def amortisation(b, c):
    return store.amortised(b, c.withColumn("cost_cents", F.floor(F.col("cost_cents") / 1000)))


@query("best_conversion", "SELECT book_id, score, created_at, path, iteration FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY score DESC NULLS LAST, created_at DESC, l_orderkey, l_partkey, l_suppkey, iteration, cost_cents) AS place FROM conversions_v) WHERE place = 1", "conversions_v")
def best_conversion(c):
    return store.best_conversion(c)


BY_ITERATION = "it AS (SELECT book_id, iteration, max(score) AS score, sum(cost_cents)::BIGINT AS cost_cents FROM conversions_v GROUP BY 1, 2)"


@query("score_changes", f"WITH {BY_ITERATION} SELECT book_id, iteration, score, score - lag(score) OVER (PARTITION BY book_id ORDER BY iteration) AS change FROM it", "conversions_v")
def score_changes(c):
    return store.score_changes(c)


@query("converge_exit", f"WITH {BY_ITERATION}, r AS (SELECT *, CASE WHEN score >= 85 THEN 'PASS' WHEN gain >= 0 AND gain < 3 THEN 'CEILING' WHEN spent >= 2000 THEN 'COST' WHEN next IS NULL THEN 'LAST' END AS reason FROM (SELECT *, score - lag(score) OVER w AS gain, sum(cost_cents) OVER (PARTITION BY book_id ORDER BY iteration ROWS UNBOUNDED PRECEDING) AS spent, lead(iteration) OVER w AS next FROM it WINDOW w AS (PARTITION BY book_id ORDER BY iteration))) SELECT book_id, min(iteration) AS iteration, arg_min(score, iteration) FILTER (reason IS NOT NULL) AS score, arg_min(reason, iteration) AS reason FROM r WHERE reason IS NOT NULL GROUP BY 1", "conversions_v")
def converge_exit(c):
    return store.converge_exit(c)


@query("orphan_issues", "SELECT category, count(*) AS n FROM issues_v WHERE book_id NOT IN (SELECT book_id FROM conversions_v WHERE path = 'R' AND iteration = 1 AND score > 60) GROUP BY 1", "issues_v", "conversions_v")
def orphan_issues(i, c):
    return store.orphans(i, c.where("path = 'R' AND iteration = 1 AND score > 60"))


@query("duplicate_texts", "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1", "documents")
def duplicate_texts(d):
    return d.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("lookup_cascade", "WITH a AS (SELECT s_suppkey AS wanted, 0 AS way, book_id FROM supplier JOIN books_v ON book_id = s_suppkey * 3 UNION ALL SELECT s_suppkey, 1, book_id FROM supplier JOIN books_v ON file_size = s_suppkey UNION ALL SELECT s_suppkey, 2, book_id FROM supplier JOIN books_v ON year = 1950 + s_suppkey) SELECT wanted, way, min(book_id) AS book_id FROM a JOIN (SELECT wanted, min(way) AS way FROM a GROUP BY 1) USING (wanted, way) GROUP BY 1, 2", "supplier", "books_v")
def lookup_cascade(s, b):
    w = s.select(F.col("s_suppkey").alias("wanted"))
    return store.fallback_lookup(w, [(b, b["book_id"] == w["wanted"] * 3), (b, b["file_size"] == w["wanted"]), (b, b["year"] == 1950 + w["wanted"])], "wanted")


@query("keep_better", "WITH e AS (SELECT book_id, path, score, l_orderkey, l_partkey, l_suppkey, iteration, cost_cents, row_number() OVER w AS pos, sum(CASE WHEN coalesce(score, 0) = 0 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS run FROM conversions_v WINDOW w AS (PARTITION BY book_id ORDER BY created_at, l_orderkey, l_partkey, l_suppkey, iteration, cost_cents)) SELECT book_id, path, score FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY run DESC, score DESC NULLS LAST, pos DESC) AS place FROM e) WHERE place = 1", "conversions_v")
def keep_better(c):
    return store.keep_better(c, "book_id", "score", "created_at", "l_orderkey", "l_partkey", "l_suppkey", "iteration", "cost_cents").select("book_id", "path", "score")


@query("recommend", """WITH c AS (SELECT book_id, path, score, publisher, format, source_type FROM conversions_v JOIN (SELECT book_id, publisher, format, CASE WHEN year % 9 = 0 THEN NULL ELSE 's' || year % 4 END AS source_type FROM books_v) USING (book_id) WHERE score IS NOT NULL AND (book_id % 4 < 2)),
a AS (SELECT book_id, arg_max(path, (s, path)) AS p, sum(n) AS n FROM (SELECT book_id, path, avg(score) AS s, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT publisher, format, arg_max(path, (s, path)) AS p FROM (SELECT publisher, format, path, avg(score) AS s FROM c WHERE publisher IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2), bn AS (SELECT publisher, format, count(DISTINCT book_id) AS n FROM c WHERE publisher IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT book_id) >= 2),
d AS (SELECT source_type, format, arg_max(path, (s, path)) AS p, sum(n) AS n FROM (SELECT source_type, format, path, avg(score) AS s, count(*) AS n FROM c WHERE source_type IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2) GROUP BY 1, 2),
k AS (SELECT book_id, publisher, format, CASE WHEN year % 9 = 0 THEN NULL ELSE 's' || year % 4 END AS source_type FROM books_v)
SELECT k.book_id, coalesce(a.p, CASE WHEN bn.n IS NOT NULL THEN b.p END, d.p) AS path, CASE WHEN a.p IS NOT NULL THEN least(95, 50 + 15 * a.n) WHEN bn.n IS NOT NULL THEN least(70, 30 + 10 * bn.n) WHEN d.p IS NOT NULL THEN least(50, 20 + 5 * d.n) ELSE 0 END::BIGINT AS sure, CASE WHEN a.p IS NOT NULL THEN 'book_history' WHEN bn.n IS NOT NULL THEN 'publisher_profile' WHEN d.p IS NOT NULL THEN 'source_type_profile' ELSE 'default' END AS basis
FROM k LEFT JOIN a ON k.book_id = a.book_id LEFT JOIN b ON k.publisher = b.publisher AND k.format = b.format LEFT JOIN bn ON k.publisher = bn.publisher AND k.format = bn.format LEFT JOIN d ON k.source_type = d.source_type AND k.format = d.format""", "books_v", "conversions_v")
def recommend(b, c):
    b = b.withColumn("source_type", F.when(F.col("year") % 9 > 0, F.concat(F.lit("s"), (F.col("year") % 4).cast("string"))))
    return recipes.recommended(b, c.where("book_id % 4 < 2"))


@query("run_trend", "SELECT *, n_pass::DOUBLE / greatest(n, 1) AS pass_share FROM (SELECT run, count(*) AS n, count_if(status = 'PASS') AS n_pass, count_if(status = 'FAIL') AS n_fail FROM runs_v GROUP BY 1) ORDER BY run DESC LIMIT 20", "runs_v")
def run_trend(r):
    return runs.run_trend(r, 20)


LATEST = "a AS (SELECT file_id, arg_max(status, o_orderkey) AS old_status FROM runs_v WHERE run = 199503 GROUP BY 1), b AS (SELECT file_id, arg_max(status, o_orderkey) AS new_status FROM runs_v WHERE run = 199504 GROUP BY 1)"


@query("changed_files", f"WITH {LATEST} SELECT * FROM a JOIN b USING (file_id) WHERE old_status <> new_status", "runs_v")
def changed_files(r):
    return runs.changed_files(r, 199503, 199504)


@query("status_counts", f"WITH {LATEST}, x AS (SELECT old_status AS status, count(*) AS n_old FROM a GROUP BY 1), y AS (SELECT new_status AS status, count(*) AS n_new FROM b GROUP BY 1) SELECT status, coalesce(n_old, 0) AS n_old, coalesce(n_new, 0) AS n_new FROM x FULL JOIN y USING (status)", "runs_v")
def status_counts(r):
    return runs.status_counts(r, 199503, 199504)


@query("boolean_search", "SELECT conv_id, turn FROM posts_v WHERE contains(lower(body), 'the') AND (contains(lower(body), 'tion') OR contains(lower(body), 'er th')) AND NOT contains(lower(body), 'ing')", "posts_v")
def boolean_search(p):
    has = search.holds(F.col("body"))
    return p.where(has("the") & (has("tion") | has("er th")) & ~has("ing")).select("conv_id", "turn")


@query("keyword_search", "SELECT conv_id, turn FROM posts_v WHERE contains(lower(body), 'thand') OR contains(lower(body), 'que')", "posts_v")
def keyword_search(p):
    return search.keyword_filter(p, ["Thand", "que"], "body").select("conv_id", "turn")


TRAIL = f"(?m)[{T.LINE_WHITE}]+$"
WHITE_SQL = f"""WITH a AS (SELECT doc_id, text AS t0, regexp_replace(text, ' {{3,}}', ' ', 'g') AS t1 FROM dirty_v), b AS (SELECT *, regexp_replace(t1, ' +([.,;:!?])', '\\1', 'g') AS t2 FROM a), c AS (SELECT *, regexp_replace(t2, '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g') AS t3 FROM b), d AS (SELECT *, regexp_replace(t3, '{TRAIL}', '', 'g') AS t4 FROM c)
SELECT doc_id, md5(replace(t4, chr(9), ' ')) AS digest, (len(regexp_extract_all(t0, ' {{3,}}')) + len(regexp_extract_all(t1, ' +[.,;:!?]')) + len(regexp_extract_all(t2, '\\n{{4,}}')) + len(regexp_extract_all(t3, '{TRAIL}')) + len(regexp_extract_all(t4, '\\t')))::BIGINT AS n_fixes FROM d"""


@query("fix_whitespace", WHITE_SQL, "dirty_v")
def fix_whitespace(d):
    d = d.select("doc_id", T.fix_whitespace(F.col("text")).alias("f"))
    return d.select("doc_id", F.md5(F.col("f.text").cast("binary")).alias("digest"), F.col("f.n").alias("n_fixes"))


HTML_SQL = "replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#039;', ''''), '&nbsp;', ' ')"


@query("clean_html", f"SELECT page_id, md5(trim(regexp_replace(regexp_replace({HTML_SQL}, '&#[0-9]+;', '', 'g'), '[{T.WHITE}]+', ' ', 'g'), ' ')) AS digest FROM pages", "pages")
def clean_html(p):
    return p.select("page_id", F.md5(T.clean_html(F.col("html")).cast("binary")).alias("digest"))


COUNTS = {"h1_count": "<h1[ >]", "h2_count": "<h2[ >]", "h3_count": "<h3[ >]", "paragraphs": "<p[ >]", "list_items": "<li[ >]", "em_tags": "<(?:em|i)[ >]", "bold_tags": "<(?:b|strong)[ >]", "blockquotes": "<blockquote[ >]", "page_numbers": "<p[^>]*>[0-9]{1,3}</p>", "links": "<a [^>]*href", "double_spaces": "  +"}


@query("html_structure", "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i){p}'))::BIGINT AS {n}" for n, p in COUNTS.items()) + " FROM pages", "pages")
def html_structure(p):
    return p.select("page_id", T.structure(F.col("html")).alias("s")).select("page_id", "s.*")


HOST_SQL = r"regexp_replace(lower(regexp_extract(url, 'https?://([^/]+)', 1)), '^[w.]+', '')"
SKIP_SQL = "|".join(h.replace(".", r"\.") for h in T.SKIPPED_HOSTS)


@query("fetchable_urls", rf"SELECT page_id, {HOST_SQL} AS host FROM links_v WHERE length(url) >= 12 AND starts_with(url, 'http') AND NOT contains(url, 'utm_medium=footer') AND NOT contains(url, 'utm_content=footer') AND NOT regexp_matches(lower(string_split(url, '?')[1]), '\.(?:jpg|jpeg|png|gif|webp|svg|mp4|webm|mov|avi|mp3|pdf|bmp|ico|tiff)$') AND {HOST_SQL} <> '' AND NOT regexp_matches({HOST_SQL}, '(^|\.)(?:{SKIP_SQL})$')", "links_v")
def fetchable_urls(p):
    return p.where(T.fetchable(F.col("url"))).select("page_id", T.host_of(F.col("url")).alias("host"))


@query("redact_addresses", "SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+', '[redacted]', 'g')) AS digest FROM documents WHERE contains(text, '@')", "documents")
def redact_addresses(d):
    return d.where(F.contains("text", F.lit("@"))).select("doc_id", F.md5(T.redact_addresses(F.col("text")).cast("binary")).alias("digest"))


@query("title_keys", r"""WITH t AS (SELECT id, author, list_filter(regexp_split_to_array(regexp_replace(lower(regexp_split_to_array(title, '[:—]')[1]), '[^\p{L}\p{N}_ ]', ' ', 'g'), ' +'), lambda w: w <> '' AND w NOT IN ('the','a','an','and','or','of','in','on','at','to','for','by','with','from','is','was','are')) AS w, list_filter(regexp_split_to_array(regexp_replace(author, '[^\p{L}\p{N}_ ]', ' ', 'g'), ' +'), lambda w: length(w) > 1) AS a FROM titles_v)
SELECT id, nullif(array_to_string(list_concat(w, CASE WHEN len(a) > 0 THEN [lower(CASE WHEN contains(author, ',') THEN a[1] ELSE a[-1] END)] ELSE [] END), ' '), '') AS title_key FROM t""", "titles_v")
def title_keys(p):
    return p.select("id", T.title_key(F.col("title"), F.col("author")).alias("title_key"))


@query("repeated_lines", r"WITH l AS (SELECT doc_id, page, text FROM blocks_v), p AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM l GROUP BY 1) SELECT doc_id, md5(text) AS digest, n FROM (SELECT doc_id, text, count(DISTINCT page) AS n FROM l WHERE length(text) BETWEEN 15 AND 150 AND NOT regexp_matches(text, '[{}();=]') GROUP BY 1, 2) JOIN p USING (doc_id) WHERE n >= 5 AND n >= 0.1 * n_pages", "blocks_v")
def repeated_lines(b):
    return classify.repeated_lines(b).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n")


@query("first_claims", "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS place FROM events) WHERE place = 1", "events")
def first_claims(e):
    return ev.first_claims(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "ts", "event_id")


@query("rate_limited", "SELECT client, make_timestamp(called_at // 60 * 60000000) AS window_start, count(*) AS n, count(*) - 5 AS n_refused FROM calls_v GROUP BY 1, 2 HAVING count(*) > 5", "calls_v")
def rate_limited(c):
    """Calls of each client over the five a minute that one parent is allowed."""
    return ev.rate_limited(c.withColumn("ts", F.timestamp_seconds("called_at")), "client", 5).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("breaker_openings", "WITH s AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR NOT lag(event_type <> 'purchase') OVER w OR epoch(ts)::BIGINT - epoch(lag(ts) OVER w)::BIGINT > 86400 THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS n FROM r WHERE event_type <> 'purchase') SELECT user_id, ts AS opened_at FROM n WHERE n = 3", "events")
def breaker_openings(e):
    return ev.breaker_openings(e.withColumn("failed", F.col("event_type") != "purchase"), "user_id", "failed", 3, 86400)


@query("expired", "SELECT event_type, count_if(ts < TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS n_gone, count_if(ts >= TIMESTAMP '2024-01-20' - INTERVAL 7 DAY) AS n_kept FROM events GROUP BY 1", "events")
def expired(e):
    return ev.expired(e, "2024-01-20 00:00:00", 7)


@query("counts_since", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1", "events")
def counts_since(e):
    return ev.counts_since(e, "2024-01-10 00:00:00")


@query("window_counts", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2", "events")
def window_counts(e):
    return ev.window_counts(e, "1 day")


@query("delivery_state", "WITH s AS (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM events) SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM s WHERE NOT (event_type = 'click' AND seen = 1) GROUP BY 1", "events")
def delivery_state(e):
    return ev.delivery_state(e, "user_id", ("purchase",), "click")


from . import audits, converted, diagnosed, edited, gated, ledgers, marked, parsed, reports, sets, told  # noqa: E402, F401  (they register their queries)

QUERIES = {k: v[0] for k, v in Q.items()}
ORACLE = {k: v[1] for k, v in Q.items() if v[1]}
