"""Queries of recommendations with their reasons, and of written reports."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from ..operators import recipes
from ..operators import written as R
from .diagnosed import DIAGNOSED
from .registry import query

#: Every book, and a book of each kind that has no conversions yet.
WANTED = "k AS (SELECT book_id, publisher, format, chapter_count, CASE WHEN year % 9 > 0 THEN 's' || year % 4 END AS source_type FROM books_v UNION ALL SELECT book_id + 1000000, publisher, format, chapter_count, CASE WHEN year % 9 > 0 THEN 's' || year % 4 END FROM books_v)"
SCORED = "c AS (SELECT book_id, CASE path WHEN 'R' THEN 'html_extraction' WHEN 'A' THEN 'legacy' ELSE 'column_aware' END AS path, score, seconds AS toc FROM conversions_v WHERE score IS NOT NULL)"


def _wanted(b):
    b = b.select("book_id", "publisher", "format", "chapter_count", F.when(F.col("year") % 9 > 0, F.concat(F.lit("s"), (F.col("year") % 4).cast("string"))).alias("source_type"))
    return b.unionByName(b.withColumn("book_id", F.col("book_id") + 1_000_000))


def _named(c):
    return c.withColumn("path", F.when(F.col("path") == "R", "html_extraction").when(F.col("path") == "A", "legacy").otherwise("column_aware")).withColumnRenamed("seconds", "toc")


def _ranked(key: str, where: str = "TRUE", having: str = "TRUE") -> str:
    return f"(SELECT {key}, string_agg(path, ',' ORDER BY s / n DESC, best DESC, path) AS paths, arg_max(path, (s / n, best)) AS first, max(s / n) AS mean, sum(n) AS n, arg_max(n, (s / n, best)) AS n_first FROM (SELECT {key}, path, sum(score)::DOUBLE AS s, count(*) AS n, max(score) AS best FROM c JOIN k USING (book_id) WHERE {where} GROUP BY {key}, path HAVING {having}) GROUP BY {key})"


RECOMMENDATIONS = f"""WITH {WANTED}, {SCORED},
pb AS (SELECT book_id, path, avg(score) AS m, max(score) AS best, count(*) AS n FROM c GROUP BY 1, 2), po AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY m DESC, best DESC, path) AS place FROM pb),
own AS (SELECT book_id, string_agg(path, ',' ORDER BY place) AS paths, sum(n) AS n, max(CASE WHEN place = 1 THEN path END) AS p1, max(CASE WHEN place = 1 THEN m END) AS m1, max(CASE WHEN place = 2 THEN path END) AS p2, max(CASE WHEN place = 2 THEN m END) AS m2 FROM po GROUP BY 1),
top AS (SELECT book_id, max(score) AS best, arg_max(toc, (score, toc)) AS toc FROM c GROUP BY 1),
h AS {_ranked('publisher, format', 'publisher IS NOT NULL')}, hb AS (SELECT publisher, format, count(DISTINCT book_id) AS books, avg(score) AS mean FROM c JOIN k USING (book_id) WHERE publisher IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT book_id) >= 2),
ic AS (SELECT publisher, format, category, row_number() OVER (PARTITION BY publisher, format ORDER BY n DESC, category) AS place FROM (SELECT publisher, format, CASE category WHEN 'click' THEN 'toc_navigation' ELSE category END AS category, count(*) AS n FROM issues_v JOIN k USING (book_id) WHERE publisher IS NOT NULL AND severity <> 'low' GROUP BY 1, 2, 3)), it AS (SELECT publisher, format, bool_or(category = 'toc_navigation') AS toc FROM ic WHERE place <= 5 GROUP BY 1, 2),
s AS {_ranked('source_type, format', 'source_type IS NOT NULL', 'count(*) >= 2')}, j AS (SELECT k.book_id, k.publisher, k.source_type, k.chapter_count, own.paths AS paths1, own.n AS n1, own.p1, own.m1, own.p2, own.m2, top.best, top.toc AS toc1, h.first AS first2, hb.books, hb.mean AS mean2, coalesce(it.toc, false) AS toc2, s.paths AS paths3, s.first AS first3, s.mean AS mean3, s.n AS n3, s.n_first FROM k LEFT JOIN own USING (book_id) LEFT JOIN top USING (book_id) LEFT JOIN hb ON hb.publisher = k.publisher AND hb.format = k.format LEFT JOIN h ON h.publisher = hb.publisher AND h.format = hb.format LEFT JOIN it ON it.publisher = hb.publisher AND it.format = hb.format LEFT JOIN s ON s.source_type = k.source_type AND s.format = k.format),
l AS (SELECT *, CASE WHEN paths1 IS NOT NULL THEN 1 WHEN first2 IS NOT NULL THEN 2 WHEN paths3 IS NOT NULL THEN 3 ELSE 4 END AS level FROM j), f AS (SELECT *, CASE level WHEN 1 THEN coalesce(chapter_count, 0) = 0 OR coalesce(toc1, 100) < 60 WHEN 2 THEN toc2 ELSE false END AS chapters FROM l)
SELECT book_id, CASE level WHEN 1 THEN paths1 WHEN 2 THEN first2 || ',' || array_to_string(list_filter(['html_extraction', 'legacy', 'column_aware'], lambda x: x <> first2), ',') WHEN 3 THEN paths3 ELSE '' END AS paths, chapters AS UseClaudeChapters, level = 1 AND p1 = 'column_aware' AS ForceColumns,
CASE level WHEN 1 THEN least(95, 50 + 15 * n1) WHEN 2 THEN least(70, 30 + 10 * books) WHEN 3 THEN least(50, 20 + 5 * n3) ELSE 0 END::BIGINT AS sure, CASE level WHEN 1 THEN 'book_history' WHEN 2 THEN 'publisher_profile' WHEN 3 THEN 'source_type_profile' ELSE 'default' END AS basis, best AS best_prior_score, coalesce(n1, 0)::BIGINT AS prior_conversions,
CASE level WHEN 1 THEN p1 || ' scored avg ' || round_even(m1, 0)::BIGINT || CASE WHEN p2 IS NOT NULL THEN '; vs ' || p2 || ' avg ' || round_even(m2, 0)::BIGINT ELSE '' END || CASE WHEN chapters THEN '; no chapters detected in prior runs' ELSE '' END WHEN 2 THEN publisher || ' books avg ' || round_even(mean2, 0)::BIGINT || ' with ' || first2 || ' (' || books || ' books)' WHEN 3 THEN source_type || ' PDFs avg ' || round_even(mean3, 0)::BIGINT || ' with ' || first3 || ' (' || n_first || ' conversions)' ELSE 'no historical data available' END AS reason FROM f"""


@query("recommendations", RECOMMENDATIONS, "books_v", "conversions_v", "issues_v")
def recommendations(b, c, i):
    i = i.where("severity <> 'low'").withColumn("category", F.when(F.col("category") == "click", "toc_navigation").otherwise(F.col("category")))
    return recipes.recommendations(_wanted(b), _named(c), i).withColumn("paths", F.array_join("paths", ","))


BOOKS = f"""WITH {DIAGNOSED}, p AS (SELECT string_split(x, ':')[2] AS pattern, string_split(x, ':')[1] AS severity, source_type, filename, found FROM (SELECT unnest(found) AS x, found, source_type, filename FROM d)),
t AS (SELECT count(*) AS total, count_if(status = 'PASS') AS p, count_if(status = 'WARN') AS w, count_if(status = 'FAIL') AS f, count_if(status = 'ERROR') AS e, sum(cost_cents) AS cents, count(CASE WHEN vqa_attempted THEN vqa_score END) AS n, avg(CASE WHEN vqa_attempted THEN vqa_score END) AS mean, min(CASE WHEN vqa_attempted THEN vqa_score END) AS low, max(CASE WHEN vqa_attempted THEN vqa_score END) AS high FROM d),
z AS (SELECT pattern, severity, count(*) AS n, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS rank FROM p GROUP BY 1, 2),
fs AS (SELECT pattern, string_agg(filename, ', ' ORDER BY filename) AS shown FROM (SELECT pattern, filename FROM p QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY filename) <= 5) GROUP BY 1),
ty AS (SELECT pattern, string_agg(source_type || ' (' || n || ')', ', ' ORDER BY n DESC, source_type) AS types FROM (SELECT pattern, source_type, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1 HAVING count_if(source_type <> 'unknown') > 0),
ov AS (SELECT pattern, string_agg(other, ', ' ORDER BY other) AS also FROM (SELECT a.pattern, a.other, count(*) AS n FROM (SELECT pattern, string_split(unnest(found), ':')[2] AS other FROM p) a WHERE a.pattern <> a.other GROUP BY 1, 2) o JOIN z USING (pattern) WHERE o.n = z.n AND z.n >= 2 GROUP BY 1),
cl AS (SELECT z.*, shown, types, also, total, rank || lpad((1000000000000 - z.n)::VARCHAR, 13, '0') || pattern AS k FROM z JOIN fs USING (pattern) LEFT JOIN ty USING (pattern) LEFT JOIN ov USING (pattern), t),
r AS (SELECT 1 AS section, '0' AS key, '# Batch report batch' AS line UNION ALL SELECT 1, '1', 'Books processed: ' || total || ' | Passed: ' || p || ' | Warnings: ' || w || ' | Failed: ' || f || ' | Errors: ' || e || '  ' FROM t UNION ALL SELECT 1, '2', 'API cost: $' || printf('%.2f', cents / 100.0::DOUBLE) || '  ' FROM t UNION ALL SELECT 1, '3', 'Visual QA: ' || n || ' scored | avg ' || printf('%.1f', round_even(mean, 1)) || ' | range ' || low || '-' || high || '  ' FROM t
UNION ALL SELECT 2, k || ' 0', '### ' || upper(severity) || ' - ' || pattern || ' (' || n || ' books)' FROM cl UNION ALL SELECT 2, k || ' 1', 'Affected: ' || shown || '  ' FROM cl UNION ALL SELECT 2, k || ' 2', '(+' || (n - 5) || ' more)  ' FROM cl WHERE n > 5 UNION ALL SELECT 2, k || ' 3', 'Source types: ' || types || '  ' FROM cl WHERE types IS NOT NULL UNION ALL SELECT 2, k || ' 4', 'All also in: ' || also || '  ' FROM cl WHERE also IS NOT NULL UNION ALL SELECT 2, k || ' 5', 'Impact: Affects ' || round_even(n * 100.0::DOUBLE / total, 0)::BIGINT || '% of all books in this batch.  ' FROM cl WHERE n >= total * 0.15
UNION ALL SELECT 4, i::VARCHAR, '| ' || low || '-' || high || ' | ' || n || ' |' FROM (SELECT b.i, b.low, b.high, count(*) AS n FROM d JOIN (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([90, 80, 70, 60, 0]) AS low, unnest([100, 89, 79, 69, 59]) AS high) b ON vqa_attempted AND vqa_score BETWEEN b.low AND b.high GROUP BY 1, 2, 3) UNION ALL SELECT 4, '5', '| No VQA | ' || (total - n) || ' |' FROM t WHERE total > n
UNION ALL SELECT 5, filename, '| ' || filename || ' | ' || status || ' | ' || CASE WHEN extraction_success THEN chapter_count::VARCHAR ELSE '-' END || ' | ' || len(found) || ' |' FROM d)"""


@query("written_report", f"{BOOKS} SELECT * FROM r", "diags_v")
def written_report(d):
    """The Markdown report of a batch; observations are the query correlations'."""
    return R.markdown(R.report(D.diagnose(d), "batch")).where("section <> 3")


@query("report_page", f"{BOOKS} SELECT section, key, CASE WHEN starts_with(line, '# ') THEN '<h1>' || line[3:] || '</h1>' WHEN starts_with(line, '### ') THEN '<h3>' || line[5:] || '</h3>' WHEN starts_with(line, '| ') THEN '<tr><td>' || replace(line[3:-3], ' | ', '</td><td>') || '</td></tr>' ELSE '<p>' || rtrim(line) || '</p>' END AS line FROM r", "diags_v")
def report_page(d):
    """The same as a page."""
    return R.html(R.report(D.diagnose(d), "batch")).where("section <> 3")
