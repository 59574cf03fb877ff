"""Queries over diagnostics: patterns, status, clusters, correlations, reports, runs."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnostics as D
from .queries import score_sql
from .registry import query

#: The patterns as one list of names by severity, for the checking engine.
ISSUES = ", ".join(f"CASE WHEN coalesce({c}, false) THEN '{s}:{k}' END" for k, (s, c) in D.PATTERNS.items())
DIAGNOSED = f"""i AS (SELECT *, list_filter([{ISSUES}], lambda x: x IS NOT NULL) AS found FROM diags_v),
d AS (SELECT *, CASE WHEN NOT extraction_success THEN 'ERROR' WHEN len(list_filter(found, lambda x: starts_with(x, 'critical'))) > 0 OR (vqa_attempted AND vqa_score < coalesce(vqa_threshold, 70) - 10) THEN 'FAIL' WHEN len(list_filter(found, lambda x: starts_with(x, 'high'))) > 0 OR (vqa_attempted AND vqa_score < coalesce(vqa_threshold, 70)) THEN 'WARN' ELSE 'PASS' END AS status FROM i)"""


def _issues(d):
    return D.diagnose(d)


@query("diagnosis", f"WITH {DIAGNOSED} SELECT book_id, status, array_to_string(list_transform(found, lambda x: string_split(x, ':')[2]), ',') AS patterns FROM d", "diags_v")
def diagnosis(d):
    return _issues(d).select("book_id", "status", F.array_join(F.transform("issues", lambda x: x["pattern"]), ",").alias("patterns"))


@query("failure_clusters", f"""WITH {DIAGNOSED}, p AS (SELECT string_split(x, ':')[2] AS pattern, string_split(x, ':')[1] AS severity, source_type, format, filename FROM (SELECT unnest(found) AS x, source_type, format, filename FROM d)),
s AS (SELECT pattern, string_agg(source_type || '=' || n, ',' ORDER BY source_type) AS source_types FROM (SELECT pattern, source_type, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1), f AS (SELECT pattern, string_agg(format || '=' || n, ',' ORDER BY format) AS formats FROM (SELECT pattern, format, count(*) AS n FROM p GROUP BY 1, 2) GROUP BY 1)
SELECT pattern, severity, count(*) AS n_books, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 9 END AS rank, any_value(source_types) AS source_types, any_value(formats) AS formats FROM p JOIN s USING (pattern) JOIN f USING (pattern) GROUP BY 1, 2""", "diags_v")
def failure_clusters(d):
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return D.clusters(_issues(d)).select("pattern", "severity", "n_books", "rank", told("by_source_type").alias("source_types"), told("by_format").alias("formats"))


@query("cluster_books", f"WITH {DIAGNOSED} SELECT string_split(x, ':')[2] AS pattern, filename FROM (SELECT unnest(found) AS x, filename FROM d)", "diags_v")
def cluster_books(d):
    return D.cluster_books(_issues(d))


@query("correlations", f"""WITH {DIAGNOSED}, t AS (SELECT count(*) AS total, count_if(status IN ('FAIL', 'ERROR')) AS failed, count_if(chapter_count = 0) AS chapters, count_if(status IN ('FAIL', 'ERROR') AND file_size > 10485760) AS large, count_if(vqa_attempted AND vqa_score < 60) AS low FROM d),
s AS (SELECT source_type, count(*) AS n FROM d WHERE status IN ('FAIL', 'ERROR') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)
SELECT 'source type' AS kind, source_type AS what, round(n * 100.0::DOUBLE / failed, 1) AS share, n FROM s, t WHERE source_type <> 'unknown' AND n >= 2 AND n * 100 >= 75 * failed
UNION ALL SELECT 'no chapters', NULL, round(chapters * 100.0::DOUBLE / total, 1), chapters FROM t WHERE chapters * 100 >= 15 * total
UNION ALL SELECT 'large files', NULL, round(large * 100.0::DOUBLE / greatest(failed, 1), 1), large FROM t WHERE large >= 2 AND large >= 0.5 * failed
UNION ALL SELECT 'low scores', NULL, round(low * 100.0::DOUBLE / total, 1), low FROM t WHERE low >= 2""", "diags_v")
def correlations(d):
    return D.correlations(_issues(d.withColumn("chapter_count", F.col("chapter_count"))))


SUMMARY = "count(*) AS total, count_if(status = 'PASS') AS passed, count_if(status = 'WARN') AS warned, count_if(status = 'FAIL') AS failed, count_if(status = 'ERROR') AS errored, count_if(status = 'SKIP') AS skipped, sum(cost_cents)::BIGINT AS cost_cents"


@query("batch_summary", f"WITH {DIAGNOSED} SELECT *, round_even(passed * 100::DOUBLE / greatest(total, 1), 1) AS pass_rate, round_even(passed * 100::DOUBLE / greatest(total - skipped, 1), 1) AS pass_rate_run FROM (SELECT run, {SUMMARY} FROM d GROUP BY 1)", "diags_v")
def batch_summary(d):
    return D.summary(_issues(d), "run")


@query("run_deltas", f"""WITH {DIAGNOSED}, s AS (SELECT run, {SUMMARY} FROM d GROUP BY 1), r AS (SELECT run, unnest(['total', 'passed', 'warned', 'failed', 'errored', 'pass_rate']) AS metric, unnest([1, 1, -1, -1, -1, 1]) AS sign, unnest([total::DOUBLE, passed::DOUBLE, warned::DOUBLE, failed::DOUBLE, errored::DOUBLE, round_even(passed * 100::DOUBLE / greatest(total, 1), 1)]) AS value FROM s)
SELECT metric, o.value AS old, n.value AS new, n.value - o.value AS change, (sign(n.value - o.value) * o.sign)::INT AS direction FROM r o JOIN r n USING (metric) WHERE o.run = 0 AND n.run = 1""", "diags_v")
def run_deltas(d):
    return D.run_deltas(_issues(d), 0, 1)


@query("cluster_deltas", f"WITH {DIAGNOSED}, p AS (SELECT string_split(x, ':')[2] AS pattern, run FROM (SELECT unnest(found) AS x, run FROM d)) SELECT pattern, count_if(run = 0) AS n_old, count_if(run = 1) AS n_new, count_if(run = 1) - count_if(run = 0) AS change FROM p GROUP BY 1", "diags_v")
def cluster_deltas(d):
    return D.cluster_deltas(_issues(d), 0, 1)


@query("json_report", f"WITH {DIAGNOSED} SELECT count(*) AS total, count_if(status = 'PASS') AS passed, (SELECT count(DISTINCT x) FROM (SELECT unnest(found) AS x FROM d)) AS n_clusters FROM d", "diags_v")
def json_report(d):
    j = D.json_report(_issues(d))
    return j.select(F.get_json_object("report", "$.summary.books_total").cast("long").alias("total"), F.get_json_object("report", "$.summary.books_passed").cast("long").alias("passed"), F.json_array_length(F.get_json_object("report", "$.failure_clusters")).cast("long").alias("n_clusters"))


@query("markdown_report", f"WITH {DIAGNOSED}, s AS (SELECT {SUMMARY} FROM d) SELECT unnest([0, 1, 2, 3, 4, 5, 6])::INT AS place, unnest(['- Books: ' || total, '- Passed: ' || passed, '- Warned: ' || warned, '- Failed: ' || failed, '- Errors: ' || errored, '- Skipped: ' || skipped, '- Pass rate without skipped: ' || round_even(passed * 100::DOUBLE / greatest(total - skipped, 1), 1)]) AS line FROM s", "diags_v")
def markdown_report(d):
    return D.markdown_lines(_issues(d))


SAMPLE = "substring(text, (greatest(0, floor(length(text) * p)::BIGINT - least(2000, length(text) // 6) // 2) + 1)::BIGINT, least(2000, length(text) // 6)::BIGINT)"


@query("quality_variance", f"""WITH p AS (SELECT doc_id, list_transform([0.10::DOUBLE, 0.25::DOUBLE, 0.50::DOUBLE, 0.75::DOUBLE, 0.90::DOUBLE], lambda p: {SAMPLE}) AS x FROM dirty_v WHERE length(text) >= 2500), s AS (SELECT doc_id, list_transform(x, lambda t: {score_sql('t')}) AS s FROM p)
SELECT doc_id, array_to_string(s, ',') AS scores, round(list_sum(s)::DOUBLE / 5, 1) AS mean, round(list_stddev_pop(s), 1) AS std_dev, list_stddev_pop(s) > 15 AS high_variance, [0.10::DOUBLE, 0.25::DOUBLE, 0.50::DOUBLE, 0.75::DOUBLE, 0.90::DOUBLE][list_position(s, list_min(s))] AS worst_position FROM s""", "dirty_v")
def quality_variance(d):
    v = d.where("length(text) >= 2500").select("doc_id", D.quality_variance(F.col("text")).alias("v"))  # shorter ones have none; a filter on v would make it twice
    return v.select("doc_id", F.array_join("v.scores", ",").alias("scores"), "v.mean", "v.std_dev", "v.high_variance", "v.worst_position")


@query("backmatter_headings", "WITH h AS (SELECT page_id, regexp_extract_all(html, '<h[12](?:\\s[^>]*)?>(.+?)</h[12]>', 1) AS h FROM pages) SELECT page_id, len(h) > 0 AND len(list_filter(h, lambda x: NOT regexp_matches(lower(x), 'notes|bibliography|index|references|appendix|appendices|glossary|further reading|suggested reading|about the author|acknowledgments|acknowledgements|works cited|endnotes|permissions|credits|colophon'))) = 0 AS only_backmatter FROM h", "pages")
def backmatter_headings(p):
    return p.select("page_id", D.backmatter_only(F.regexp_extract_all("html", F.lit(r"<h[12](?:\s[^>]*)?>(.+?)</h[12]>"), F.lit(1))).alias("only_backmatter"))


@query("scan_rule", "SELECT book_id, CASE WHEN word_count < 100 AND file_size > 5242880 THEN 'scan' ELSE source_type END AS source_type FROM (SELECT book_id, word_count // 50 AS word_count, file_size, source_type FROM diags_v)", "diags_v")
def scan_rule(d):
    return d.select("book_id", D.source_type(F.col("source_type"), F.floor(F.col("word_count") / 50), F.col("file_size")).alias("source_type"))
