"""Queries of gates and rules: uploads, recipients, baselines of pages, breakers, sweeps, what a run leaves in the store."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as E
from ..operators import choose as C
from ..operators import diagnostics as D
from ..operators import headmatch as H
from ..operators import pages as P
from ..operators import repair
from ..operators import sketches as S
from ..sources.stored import run_tables
from ..streaming import machines as M
from .diagnosed import DIAGNOSED
from .registry import query


@query("font_inventory", f"WITH f AS (SELECT doc_id, list_sort(list(DISTINCT font_name)) AS f FROM fonts_v WHERE font_name <> '' GROUP BY 1), r AS (SELECT *, list_filter(f, lambda x: regexp_matches(lower(x), '{'|'.join(P.RISKY_FONTS)}')) AS r FROM f) SELECT doc_id, len(f)::INT AS n_fonts, array_to_string(f[1:30], ',') AS fonts, array_to_string(r, ',') AS risky_fonts, len(r) > 0 AS risky FROM r", "fonts_v")
def font_inventory(b):
    return P.font_inventory(b).withColumns({"fonts": F.array_join("fonts", ","), "risky_fonts": F.array_join("risky_fonts", ",")})


@query("upload_checks", """WITH k AS (SELECT *, CASE WHEN starts_with(header, '%PDF') THEN 'pdf' WHEN starts_with(header, 'PK' || chr(3) || chr(4)) THEN 'epub' WHEN starts_with(header, chr(137) || 'PNG') THEN NULL WHEN lower(regexp_extract(name, '\\.([^./\\\\]*)$', 1)) IN ('mobi', 'azw', 'azw3', 'djvu') THEN lower(regexp_extract(name, '\\.([^./\\\\]*)$', 1)) END AS kind FROM uploads_v)
SELECT page_id, kind, CASE WHEN size = 0 THEN 'EMPTY_FILE' WHEN size > CASE WHEN tier = 'free' THEN 20971520 ELSE 104857600 END THEN 'FILE_TOO_LARGE' WHEN kind IS NULL THEN 'INVALID_MIME' WHEN output NOT IN ('epub', 'mobi') AND NOT (tier = 'premium' AND output = 'kfx') THEN 'INVALID_OUTPUT_FORMAT' ELSE 'ok' END AS verdict,
CASE WHEN output <> 'epub' THEN 'FORMAT_NOT_KINDLE_ELIGIBLE' WHEN size > 26214400 THEN 'OUTPUT_TOO_LARGE_FOR_KINDLE' ELSE 'ok' END AS attachment FROM k""", "uploads_v")
def upload_checks(u):
    col = F.col
    return u.select("page_id", C.file_kind(col("header"), col("name")).alias("kind"), C.upload_verdict(col("header"), col("name"), col("size"), col("tier"), col("output")).alias("verdict"), C.attachment_verdict(col("output"), col("size")).alias("attachment"))


@query("recipient_checks", "WITH r AS (SELECT c_custkey, lower(trim(address)) AS a FROM recipients_v) SELECT c_custkey, CASE WHEN a IS NULL OR NOT regexp_matches(a, '^[^\\s@<>()\\[\\],;:\\\\\"+]+@[^\\s@<>()\\[\\],;:\\\\\"]+$') THEN 'INVALID_RECIPIENT_FORM' WHEN split_part(a, '@', 2) NOT IN ('kindle.com', 'free.kindle.com') THEN 'INVALID_RECIPIENT_DOMAIN' ELSE 'ok' END AS verdict FROM r", "recipients_v")
def recipient_checks(r):
    return r.select("c_custkey", C.recipient_verdict(F.col("address")).alias("verdict"))


H2 = r"<h2(?:\s[^>]*)?>"
#: Each second-level heading with the first paragraph of its own section or of the nearest later one that has any.
OPENINGS = rf"""s AS (SELECT {{key}}, html, regexp_extract_all(html, '{H2}(.*?)</h2>', 1) AS t, string_split_regex(html, '{H2}.*?</h2>')[2:] AS s FROM {{of}}),
o AS (SELECT {{key}}, unnest(range(1, len(s) + 1)) AS i, s, t FROM s),
m AS (SELECT {{key}}, i, t[i] AS heading, list_filter(range(i, len(s) + 1), lambda j: regexp_matches(s[j], '<p>.*?</p>'))[1] AS j, s FROM o),
op AS (SELECT {{key}}, i, heading, left(trim(regexp_replace(regexp_extract(s[j], '<p>(.*?)</p>', 1), '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)), 60) AS opening FROM m WHERE j IS NOT NULL)"""


@query("chapter_openings", f"WITH {OPENINGS.format(key='doc_id', of='chapters_v')} SELECT doc_id, heading, opening FROM op WHERE opening <> ''", "chapters_v")
def chapter_openings(b):
    return b.select("doc_id", F.explode(P.baseline(F.col("html"))["chapter_openings"]).alias("o")).select("doc_id", "o.*")


def _measured(b, html: str, *names: str):
    m = P.baseline(F.col(html))
    return b.select("doc_id", *(m[n].alias(n) for n in names), (m["h1_count"] + m["h2_count"] + m["h3_count"]).alias("toc_entries"), F.floor(F.length(html) / 1024).alias("output_kb"))


@query("openings_matched", f"WITH {OPENINGS.format(key='doc_id', of='chapters_v')}, {OPENINGS.format(key='doc_id', of='later_v').replace('s AS', 's2 AS', 1).replace('o AS', 'o2 AS', 1).replace('FROM s)', 'FROM s2)').replace('m AS', 'm2 AS', 1).replace('FROM o)', 'FROM o2)').replace('op AS', 'op2 AS', 1).replace('FROM m WHERE', 'FROM m2 WHERE')}, a AS (SELECT doc_id, heading, left(arg_max(opening, i), 40) AS x FROM op WHERE opening <> '' GROUP BY 1, 2), b AS (SELECT doc_id, heading, left(arg_max(opening, i), 40) AS x FROM op2 WHERE opening <> '' GROUP BY 1, 2) SELECT doc_id, count_if(a.x = b.x) AS matched, count(*) AS compared FROM a JOIN b USING (doc_id, heading) GROUP BY 1", "chapters_v", "later_v")
def openings_matched(b, later):
    return P.openings_matched(_measured(later, "html", "chapter_openings"), _measured(b, "html", "chapter_openings"), "doc_id")


def _heads(of: str) -> str:
    return f"(SELECT doc_id, regexp_extract_all(html, '{H2}(.+?)</h2>', 1) AS h FROM {of})"


@query("heading_changes", f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(o.h), lambda x: NOT list_contains(n.h, x))), '|') AS missing, array_to_string(list_sort(list_filter(list_distinct(n.h), lambda x: NOT list_contains(o.h, x))), '|') AS added FROM {_heads('chapters_v')} o JOIN {_heads('later_v')} n USING (doc_id) WHERE len(o.h) > 0 AND len(n.h) > 0 AND o.h <> n.h", "chapters_v", "later_v")
def heading_changes(b, later):
    d = P.heading_changes(_measured(later, "html", "h2_headings"), _measured(b, "html", "h2_headings"), "doc_id")
    return d.select("doc_id", F.array_join("missing", "|").alias("missing"), F.array_join("added", "|").alias("added"))


RULES = ("h1_count", "h2_count", "h3_count", "h1_headings", "h2_headings", "linked_footnotes", "ligature_splits", "double_spaces")


def _counts(of: str) -> str:
    n = lambda p: f"len(regexp_extract_all(html, '{p}'))"
    heads = [rf"<h{k}(?:\s[^>]*)?>.+?</h{k}>" for k in (1, 2, 3)]
    return f"(SELECT doc_id, {', '.join(f'{n(h)} AS h{k}' for k, h in enumerate(heads, 1))}, length(html) // 1024 AS kb, len(regexp_extract_all(regexp_replace(html, '<[^>]+>', '', 'g'), '  ')) AS doubles, regexp_extract_all(html, '{H2}(.+?)</h2>', 1) AS h FROM {of})"


@query("baseline_rules", f"""WITH j AS (SELECT doc_id, o.h1 AS o1, n.h1 AS n1, o.h2 AS o2, n.h2 AS n2, o.h3 AS o3, n.h3 AS n3, o.kb AS ok, n.kb AS nk, o.doubles AS od, n.doubles AS nd, o.h AS oh, n.h AS nh FROM {_counts('chapters_v')} o JOIN {_counts('later_v')} n USING (doc_id))
SELECT doc_id, 'h1_count' AS rule, o1::BIGINT AS expected, n1::BIGINT AS actual, abs(n1 - o1) <= 2 AS passed FROM j UNION ALL SELECT doc_id, 'h2_count', o2, n2, abs(n2 - o2) <= 2 FROM j UNION ALL SELECT doc_id, 'h3_count', o3, n3, abs(n3 - o3) <= 2 FROM j UNION ALL SELECT doc_id, 'double_spaces', od, nd, nd <= od FROM j
UNION ALL SELECT doc_id, 'toc_entries', o1 + o2 + o3, n1 + n2 + n3, abs(n1 + n2 + n3 - o1 - o2 - o3) <= 5 FROM j UNION ALL SELECT doc_id, 'h2_headings', 0, len(list_filter(list_distinct(oh), lambda x: NOT list_contains(nh, x))), oh = nh FROM j WHERE len(oh) > 0 AND len(nh) > 0
UNION ALL SELECT doc_id, 'output_kb', ok, nk, abs(nk - ok) * 100 <= 10 * ok FROM j WHERE ok > 0""", "chapters_v", "later_v")
def baseline_rules(b, later):
    return P.against_baseline(_measured(later, "html", *RULES), _measured(b, "html", *RULES), "doc_id").where("rule <> 'ligature_splits'")


@query("column_merges", r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)[1:200], lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 20) AS p FROM wide_v),
l AS (SELECT doc_id, p, list_sum(list_transform(p, lambda x: len(list_filter(string_split(x, chr(10)), lambda y: length(trim(y)) > 150)))) AS long FROM p) SELECT doc_id, len(p) > 10 AND coalesce(long, 0)::DOUBLE / greatest(1, len(p)) > 0.3 AS merged FROM l""", "wide_v")
def column_merges(p):
    return p.select("doc_id", P.column_merge(F.col("html")).alias("merged"))


@query("link_viability", "WITH n AS (SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href=')) AS links, len(regexp_extract_all(html, '<img\\b')) AS images, len(regexp_extract_all(html, '<figure')) AS large FROM pages) SELECT page_id, CASE WHEN links > 0 THEN 'viable' ELSE 'none' END AS links, CASE WHEN images = 0 THEN 'none' WHEN large > 0 THEN 'viable' ELSE 'decorative_only' END AS images FROM n", "pages")
def link_viability(p):
    n = lambda x: F.regexp_count("html", F.lit(x))
    return p.select("page_id", P.link_viability(n(r"<a\s[^>]*href="), n(r"<img\b"), n("<figure")).alias("v")).select("page_id", "v.links", "v.images")


#: Failures numbered since the last success or longer gap; islands of trips; what stays half open.
BREAKERS = """WITH c AS (SELECT client, called_at, call_id, failed, lag(called_at) OVER w AS before, lag(failed) OVER w AS failed_before, lead(called_at) OVER w AS next FROM calls_v WINDOW w AS (PARTITION BY client ORDER BY called_at, call_id)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR NOT failed_before OR called_at - before > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY client ORDER BY called_at, call_id ROWS UNBOUNDED PRECEDING) AS run FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY client, run ORDER BY called_at, call_id) AS n FROM r WHERE failed),
t AS (SELECT *, CASE WHEN called_at - lag(called_at) OVER (PARTITION BY client ORDER BY called_at, call_id) < 30 THEN 0 ELSE 1 END AS apart FROM n WHERE n >= 5),
i AS (SELECT *, sum(apart) OVER (PARTITION BY client ORDER BY called_at, call_id ROWS UNBOUNDED PRECEDING) AS island FROM t),
o AS (SELECT client, island, min(called_at) AS began, max(called_at) AS last, arg_max(coalesce(next, 9999999999), (called_at, call_id)) AS next FROM i GROUP BY 1, 2)
SELECT client AS key, 'open' AS state, began, last + 30 AS ended FROM o UNION ALL SELECT client, 'half_open', last + 30, least(next, last + 60) FROM o WHERE next > last + 30"""


@query("breaker_periods", BREAKERS, "calls_v")
def breaker_periods(c):
    return M.breaker_periods(c, "client", "called_at", "call_id", "failed")


@query("swept_jobs", "SELECT job_id AS key, (floor(expires_at / 600.0::DOUBLE) + 1)::BIGINT * 600 AS swept_at FROM jobs_v WHERE expires_at IS NOT NULL AND (floor(expires_at / 600.0::DOUBLE) + 1) * 600 <= 1500", "jobs_v")
def swept_jobs(j):
    return M.swept(j.select(F.col("job_id").alias("key"), "expires_at", F.lit(False).alias("used")), 1500, 600)


@query("swept_tokens", "WITH t AS (SELECT o_custkey AS key, max(o_orderkey) AS due, bool_or(o_orderstatus = 'F') AS used FROM orders GROUP BY 1) SELECT key, (floor((due + 3000) / 3600.0::DOUBLE) + 1)::BIGINT * 3600 AS swept_at FROM t WHERE used AND (floor((due + 3000) / 3600.0::DOUBLE) + 1) * 3600 <= 14400", "orders")
def swept_tokens(o):
    return M.swept(o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("expires_at"), (F.col("o_orderstatus") == "F").alias("used")), 14400, 3600, 3000, True)


def _runs(d):
    return run_tables(D.diagnose(d))


@query("recorded_runs", f"WITH {DIAGNOSED} SELECT run, count(*) AS books_total, count_if(status = 'PASS') AS books_pass, count_if(status = 'WARN') AS books_warn, count_if(status = 'FAIL') AS books_fail, count_if(status = 'ERROR') AS books_error, round(sum(coalesce(cost_cents, 0)) / 100.0::DOUBLE, 4) AS total_api_cost, avg(CASE WHEN vqa_attempted THEN vqa_score END) AS avg_vqa_score FROM d GROUP BY 1", "diags_v")
def recorded_runs(d):
    return _runs(d)["batch_runs"]


@query("recorded_books", f"WITH {DIAGNOSED} SELECT run, book_id, filename, status FROM d", "diags_v")
def recorded_books(d):
    return _runs(d)["batch_books"].select("run", "book_id", "filename", "status")


@query("recorded_conversions", f"WITH {DIAGNOSED} SELECT run, book_id, extraction_path, CASE WHEN vqa_attempted THEN vqa_score END AS vqa_score, text_layer_score AS text_quality_score, cost_cents FROM d WHERE extraction_success", "diags_v")
def recorded_conversions(d):
    return _runs(d)["conversions"]


@query("recorded_issues", f"WITH {DIAGNOSED} SELECT run, book_id, string_split(x, ':')[2] AS category, string_split(x, ':')[1] AS severity FROM (SELECT run, book_id, unnest(found) AS x FROM d WHERE extraction_success)", "diags_v")
def recorded_issues(d):
    return _runs(d)["issues"]


#: The blocks of a page in order: level 1 to 3 for headings, else 0.
BLOCKS = r"(?is)<(h[1-3]|p|li)(?:\s[^>]*)?>(.*?)</\1>"


def _blocks(p):
    d = p.select(F.col("page_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("html", F.lit(BLOCKS), F.lit(0))).alias("place", "b"))
    part = lambda k: F.regexp_extract("b", BLOCKS, k)
    return d.select("doc_id", "place", F.regexp_extract(part(1), "[1-3]", 0).alias("level"), F.trim(F.regexp_replace(part(2), "<[^>]+>", " ")).alias("text"))


@query("heading_paragraphs", None, "pages")
def heading_paragraphs(p):
    """The headings of each page, in capitals, against all its blocks."""
    blocks = _blocks(p)
    heads = blocks.where("level <> ''").select("doc_id", "place", F.upper("text").alias("title"), F.col("level").cast("int").alias("level"))
    return H.roles(heads, H.matched(heads, blocks.select("doc_id", "place", "text")))


@query("repaired_texts", None, "scanned_v")
def repaired_texts(d):
    return repair.repaired(d).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_spaced", "n_cut", "n_words")


@query("fixed_documents", None, "outline_v", "pages")
def fixed_documents(d, p):
    """Every pass over texts and pages, with a report's issues."""
    issue = lambda c, t: F.struct(F.lit(c).alias("category"), F.lit(t).alias("description"))
    issues = F.array(issue("toc_navigation", "missing anchors"), issue("paragraph_flow", "split mid-sentence"), issue("heading_formatting", "Unstyled heading"), issue("text_integrity", "space before punctuation"))
    texts = d.select("doc_id", "text", F.lit(False).alias("is_html"), issues.alias("issues"))
    whole = texts.unionByName(p.select((-F.col("page_id") - 1).alias("doc_id"), F.col("html").alias("text"), F.lit(True).alias("is_html"), F.lit(None).cast("array<struct<category: string, description: string>>").alias("issues")))
    f = E.fix_documents(whole)
    return f.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "total", "modified", *(F.col("counts")[k].alias(k) for k in (*E.PASSES, "index_fragments", "vqa_targeted")))


@query("merged_sketches", "SELECT grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS grouping, o_orderstatus AS status, o_orderpriority AS priority, count(DISTINCT o_custkey) AS n_distinct, quantile_disc(o_totalprice, 0.5) AS middle, count(*) AS n, true AS distinct_near, true AS rank_near, true AS same_n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
def merged_sketches(o):
    """Exact counts of a rollup beside what sketches of its finest level, merged, tell."""
    levels = ["o_orderstatus", "o_orderpriority"]
    told = S.merged(S.sketched(o, levels, "o_custkey", "o_totalprice"), levels).select("grouping", *(F.col(x).alias(f"_{x}") for x in levels), "ids", "values", F.col("n").alias("_n"))
    true = S.exact(o, levels, "o_custkey", "o_totalprice")
    same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in levels]
    d = true.join(told, "grouping").where(same[0] & same[1])
    d = S.with_rank(d, o, levels, "o_totalprice", S.quantile(F.col("values"), 0.5))
    return d.select(F.col("grouping").cast("long").alias("grouping"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "n_distinct", F.col("quantile").alias("middle"), "n", S.near(S.distinct_count(F.col("ids")), F.col("n_distinct")).alias("distinct_near"), S.rank_near(0.5).alias("rank_near"), (F.col("n") == F.col("_n")).alias("same_n"))
