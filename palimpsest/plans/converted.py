"""Queries of recipes, made-up pages, alignment, content filters and mended indexes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as E
from ..operators import alignment as A
from ..operators import contentfilter as X
from ..operators import recipes as R
from .registry import query

CASE = "CASE WHEN format = 'epub' THEN 'epub' WHEN format = 'mobi' THEN 'other' WHEN kind = 'scan_no_text' THEN 'image' WHEN kind = 'scan_with_text' AND coalesce(score, 0) < 50 THEN 'poor' WHEN kind = 'scan_with_text' AND coalesce(score, 0) < 75 THEN 'moderate' WHEN kind = 'scan_with_text' THEN 'clean' WHEN kind = 'digital_native' AND common_rate < 0.05 AND coalesce(score, 0) < 70 THEN 'garbled' WHEN kind = 'digital_native' THEN 'native' ELSE 'unknown' END"


@query("recipes", f"""WITH c AS (SELECT *, {CASE} AS kase FROM recipes_v), s AS (SELECT *, kase NOT IN ('epub', 'other') AS pdf, kase NOT IN ('epub', 'other', 'image') AND (footnotes IS NOT NULL OR index IS NOT NULL OR links IS NOT NULL) AS seen FROM c), t AS (SELECT *, pdf AND coalesce(history IN ('book_history', 'publisher_profile') AND best_score >= 70, false) AS proven, pdf AND coalesce(history <> 'default', false) AS known FROM s),
f AS (SELECT *, CASE kase WHEN 'image' THEN 'text-only' WHEN 'poor' THEN 'text-only' WHEN 'moderate' THEN 'clean-read' ELSE 'full' END AS profile, CASE WHEN seen THEN coalesce(footnotes, 'none') IN ('unusable', 'none') OR (footnotes = 'degraded' AND kind IN ('scan_with_text', 'scan_no_text')) ELSE kase IN ('image', 'poor') END AS no_footnotes, CASE WHEN seen THEN coalesce(index, 'none') <> 'viable' ELSE kase IN ('image', 'poor') END AS no_index, CASE WHEN seen THEN coalesce(links, 'none') = 'none' ELSE kase IN ('image', 'moderate') END AS no_links, (kase IN ('moderate', 'clean', 'native', 'unknown') AND chapters_advised) OR (proven AND prior_chapters) AS chapters, (pdf AND two_columns) OR (proven AND prior_columns) AS columns,
CASE WHEN proven THEN CASE WHEN prior_columns THEN 'column_aware,legacy,ocr' ELSE 'legacy,ocr' END ELSE CASE WHEN pdf AND two_columns THEN 'column_aware,' ELSE '' END || CASE kase WHEN 'epub' THEN 'epub_html,direct' WHEN 'other' THEN 'direct' WHEN 'image' THEN 'ocr' WHEN 'poor' THEN 'legacy,ocr' WHEN 'moderate' THEN 'legacy' WHEN 'garbled' THEN 'ocr,gemini,vision' ELSE 'html_extraction,legacy' END END AS strategy,
CASE WHEN seen THEN least(0.95::DOUBLE, sure + 0.05::DOUBLE) ELSE sure END AS c1 FROM t), g AS (SELECT *, CASE WHEN proven THEN least(0.95::DOUBLE, c1 + 0.1::DOUBLE) WHEN known THEN least(0.95::DOUBLE, c1 + 0.05::DOUBLE) ELSE c1 END AS c2 FROM f)
SELECT file_id, kase AS "case", profile, strategy, no_footnotes, no_index, no_links, chapters, columns, CASE kase WHEN 'epub' THEN 90 WHEN 'other' THEN 85 ELSE round(least(0.95::DOUBLE, CASE WHEN coalesce(score, 0) < 30 OR coalesce(score, 0) > 85 THEN least(0.95::DOUBLE, c2 + 0.05::DOUBLE) ELSE c2 END) * 100) END::BIGINT AS confidence FROM g""", "recipes_v")
def recipes(f):
    d = R.recipes(f.withColumn("prior", F.array(F.lit("legacy"), F.lit("ocr"))))
    flag = lambda k, n: F.col("flags")[k].alias(n)
    return d.select("file_id", "case", "profile", F.array_join("strategy", ",").alias("strategy"), flag("NoFootnotes", "no_footnotes"), flag("NoIndex", "no_index"), flag("NoHyperlinks", "no_links"), flag("UseClaudeChapters", "chapters"), flag("ForceColumns", "columns"), F.round(F.col("confidence") * 100).cast("long").alias("confidence"))


@query("size_tiers", "SELECT file_id, CASE WHEN size < 10485760 THEN 120 WHEN size < 52428800 THEN 300 ELSE 600 END AS seconds, CASE WHEN size > 31457280 OR file_id % 600 > 500 THEN 72 ELSE 150 END AS dpi, CASE WHEN size > 31457280 OR file_id % 600 > 500 THEN 4 ELSE 8 END AS pages FROM (SELECT p_partkey AS file_id, p_partkey % 90 * 1048576 AS size FROM part)", "part")
def size_tiers(p):
    d = p.select(F.col("p_partkey").alias("file_id"), (F.col("p_partkey") % 90 * 1_048_576).alias("size"))
    d = d.select("file_id", R.timeout(F.col("size")).alias("seconds"), R.page_budget(F.col("size"), F.col("file_id") % 600, F.lit(150), F.lit(8)).alias("b"))
    return d.select("file_id", "seconds", "b.dpi", "b.pages")


@query("token_costs", "SELECT event_id, CASE event_type WHEN 'view' THEN user_id / 1000000.0::DOUBLE * 1 + event_id / 1000000.0::DOUBLE * 5 WHEN 'click' THEN user_id / 1000000.0::DOUBLE * 3 + event_id / 1000000.0::DOUBLE * 15 ELSE user_id / 1000000.0::DOUBLE * 5 + event_id / 1000000.0::DOUBLE * 25 END AS cost FROM events", "events")
def token_costs(e):
    name = F.when(F.col("event_type") == "view", "x-Haiku").when(F.col("event_type") == "click", "a-sonnet-4").otherwise("OPUS")
    return e.select("event_id", R.model_cost(name, F.col("user_id"), F.col("event_id")).alias("cost"))


@query("fallback_pages", """WITH p AS (SELECT book_id AS batch, page_number, min(CASE l_orderkey % 3 WHEN 0 THEN 'cover' WHEN 1 THEN 'index' ELSE 'body' END) AS page_type, CASE WHEN book_id % 5 = 0 THEN 90 WHEN book_id % 4 = 0 AND page_number % 9 > 0 THEN 65 ELSE max(score) END AS score, CASE WHEN book_id % 5 = 0 OR page_number % 4 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN page_number % 7 = 0 THEN 'I Cannot See the page' ELSE 'x' END AS description, min(severity) AS severity FROM vqa_v GROUP BY book_id, page_number),
b AS (SELECT batch, bool_and(n = 0) AS empty, max(score) AS top FROM p GROUP BY 1), s AS (SELECT batch, score, count(*) AS k, min(page_number) AS first FROM p GROUP BY 1, 2), m AS (SELECT batch, sum(k) AS scored, arg_max(score, (k, -first)) AS common, max(k) AS k FROM s GROUP BY 1)
SELECT * FROM (SELECT p.batch, page_number, CASE WHEN empty AND top >= 80 THEN 3 WHEN n = 0 AND score >= 80 THEN 1 WHEN n > 0 AND page_number % 7 = 0 THEN 2 WHEN k >= 3 AND k >= 0.75 * scored AND score = common THEN 4 WHEN ((page_type = 'cover' AND score > 40) OR (page_type = 'index' AND score > 60)) AND NOT (n > 0 AND severity IN ('critical', 'major', 'moderate')) THEN 5 END AS test FROM p JOIN b USING (batch) JOIN m USING (batch)) WHERE test IS NOT NULL""", "vqa_v")
def fallback_pages(v):
    kind = F.when(F.col("l_orderkey") % 3 == 0, "cover").when(F.col("l_orderkey") % 3 == 1, "index").otherwise("body")
    p = v.groupBy(F.col("book_id").alias("batch"), "page_number").agg(F.min(kind).alias("page_type"), F.max("score").alias("s"), F.min("severity").alias("severity"))
    none = (F.col("batch") % 5 == 0) | (F.col("page_number") % 4 == 0)
    issue = F.struct(F.when(F.col("page_number") % 7 == 0, "I Cannot See the page").otherwise("x").alias("description"), "severity")
    p = p.withColumn("score", F.when(F.col("batch") % 5 == 0, 90).when((F.col("batch") % 4 == 0) & (F.col("page_number") % 9 > 0), 65).otherwise(F.col("s"))).withColumn("issues", F.when(~none, F.array(issue)))
    return R.fallback_pages(p, phrases=("cannot see",), ceilings={"cover": 40, "index": 60})


@query("filtered_html", None, "book_v")
def filtered_html(b):
    d = b.select("doc_id", X.filter_html(F.col("html"), "text-only").alias("f"))
    return d.select("doc_id", F.md5(F.col("f.html").cast("binary")).alias("digest"), F.col("f.removed")["footnotes"].alias("footnotes"), F.col("f.removed")["front_matter"].alias("front_matter"), F.col("f.removed")["back_matter"].alias("back_matter"), "f.reduction")


@query("clean_read_html", None, "book_v")
def clean_read_html(b):
    d = b.select("doc_id", X.filter_html(F.col("html"), "clean-read").alias("f"))
    return d.select("doc_id", F.md5(F.col("f.html").cast("binary")).alias("digest"), F.col("f.removed")["index"].alias("index"), F.col("f.removed")["bibliography"].alias("bibliography"), F.col("f.removed")["hyperlinks"].alias("hyperlinks"))


@query("filtered_text", rf"""WITH l AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', '.' || chr(10) || '# Notes' || chr(10)) || chr(10) || '## Chapter' || chr(10) || 'end', chr(10)) AS l FROM documents)),
s AS (SELECT *, last_value(CASE WHEN regexp_matches(line, '^#{{1,3}}\s+.') THEN trim(regexp_extract(line, '^#{{1,3}}\s+(.+)', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS head FROM l)
SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY i)) AS digest FROM s WHERE head IS NULL OR NOT regexp_matches(head, '{X.NOTES}') AND NOT regexp_matches(head, '{X.INDEX}') AND NOT regexp_matches(head, '{X.FRONT.replace(chr(39), chr(39) * 2)}') GROUP BY 1""", "documents")
def filtered_text(d):
    text = F.concat(F.replace("text", F.lit(". "), F.lit(".\n# Notes\n")), F.lit("\n## Chapter\nend"))
    return d.select("doc_id", F.md5(X.filter_text(text, "clean-read").cast("binary")).alias("digest"))


@query("chapter_alignment", None, "book_v")
def chapter_alignment(b):
    heads = A.output_headings(b, "html", "doc_id")
    return A.aligned(heads.where("place % 3 < 2").withColumn("title", F.concat("title", F.lit(" 12"))), heads)


@query("alignment_scores", None, "book_v")
def alignment_scores(b):
    heads = A.output_headings(b, "html", "doc_id")
    return A.alignment_scores(A.aligned(heads.withColumn("title", F.concat("title", F.lit(" 12"))), heads))


@query("output_headings", r"WITH h AS (SELECT doc_id, regexp_extract_all(html, '<h[123]>(.*?)</h[123]>', 1) AS h FROM book_v) SELECT doc_id, len(h) AS n, md5(array_to_string(list_transform(h, lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), '|')) AS digest FROM h WHERE len(h) > 0", "book_v")
def output_headings(b):
    d = A.output_headings(b, "html", "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "title"))).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.transform("t", lambda x: x["title"]), "|").cast("binary")).alias("digest"))


@query("mended_index", None, "matter_v")
def mended_index(d):
    d = d.select("doc_id", F.concat(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\nSubject Index\n\nGrace, 12,\n\n14\n\nHope, 3-\n\n5\n\nLove, 9")).alias("text"))
    f = E.fix_index(d, ("genesis", "exodus"))
    return f.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n")


@query("reported_fixes", None, "outline_v")
def reported_fixes(d):
    issue = lambda c, t: F.struct(F.lit(c).alias("category"), F.lit(t).alias("description"))
    issues = F.array(issue("heading_formatting", "Unstyled heading"), issue("paragraph_flow", "split mid-sentence"), issue("toc_navigation", "missing anchors"))
    f = d.select("doc_id", E.fix_reported(F.col("text"), issues).alias("f"))
    return f.select("doc_id", F.md5(F.col("f.text").cast("binary")).alias("digest"), "f.n")
