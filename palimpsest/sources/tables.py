"""Tables, and views that shape them as books, conversions, issues, runs and posts.

The view texts run unchanged in Spark and in the engine that checks results. Money is in cents, so sums are exact.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "books_v": "SELECT doc_id AS book_id, concat('doc ', cast(doc_id AS string)) AS title, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE source END AS publisher, lang AS format, n_chars AS file_size, 1950 + doc_id % 75 AS year, doc_id % 5 AS chapter_count FROM {documents}",
    "conversions_v": "SELECT l_partkey % (SELECT count(*) FROM {documents}) AS book_id, l_linenumber AS iteration, l_returnflag AS path, CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE cast(l_quantity * 2 AS int) END AS score, cast(floor(l_extendedprice / 100) AS bigint) AS cost_cents, cast(floor(l_discount * 1000) AS bigint) AS seconds, l_shipdate AS created_at, l_orderkey, l_partkey, l_suppkey FROM {lineitem}",
    "issues_v": "SELECT event_id AS issue_id, event_id % (SELECT count(*) FROM {documents}) AS book_id, event_type AS category, CASE event_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, event_id % 3 = 0 AS fix_attempted, event_id % 3 = 0 AND CASE WHEN event_type = 'click' THEN value > 5 ELSE event_id % 6 = 0 END AS fix_succeeded FROM {events}",
    "dirty_v": "SELECT doc_id, source, lang, CASE doc_id % 5 WHEN 0 THEN replace(replace(text, ', ', ' ,    '), 'the ', 'th e ') WHEN 1 THEN replace(text, '. ', concat('.  ', '�', ' ')) ELSE text END AS text FROM {documents}",
    "runs_v": "SELECT cast(extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate) AS int) AS run, o_custkey AS file_id, CASE o_orderstatus WHEN 'F' THEN 'FAIL' WHEN 'O' THEN 'PASS' ELSE 'WARN' END AS status, o_orderkey FROM {orders}",
    "vqa_v": "SELECT l_suppkey % 50 AS book_id, l_partkey % 60 AS page_number, CASE l_returnflag WHEN 'R' THEN 'candidate' WHEN 'A' THEN 'baseline' ELSE 'other' END AS report, cast(l_quantity * 2 AS int) AS score, l_linenumber % 3 AS n_issues, CASE l_linenumber % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'moderate' WHEN 3 THEN 'minor' ELSE 'odd' END AS severity, CASE l_orderkey % 4 WHEN 0 THEN 'text_integrity' WHEN 1 THEN 'page_layout' WHEN 2 THEN 'paragraph_flow' END AS category, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM {lineitem}",
    "blocks_v": "SELECT l_suppkey AS doc_id, l_partkey % 30 AS page, CASE l_linenumber WHEN 1 THEN concat('PART ', cast(l_suppkey % 7 AS string)) WHEN 2 THEN 'A  Running head' WHEN 3 THEN concat('Chapter ', cast(l_partkey % 90 AS string)) ELSE concat('words on a line ', cast(l_orderkey % 40 AS string)) END AS text, l_returnflag AS font_name, CASE l_linenumber WHEN 1 THEN 18 WHEN 3 THEN 15 ELSE 10 + l_partkey % 2 END AS font_size, l_linestatus = 'O' AS is_bold, CASE WHEN l_linenumber <= 2 THEN 50 ELSE cast(l_quantity * 10 AS int) END AS y0, (l_orderkey % 5) * 60 AS x0, 200 + (l_orderkey % 5) * 60 AS x1, 600 AS page_width FROM {lineitem}",
    "lines_v": "SELECT doc_id, replace(replace(text, ', ', concat(',', chr(10), '  ')), '. ', concat('.', chr(10))) AS text FROM {documents}",
    "files_v": "SELECT p_partkey AS file_id, (p_size * 37) % 1200 AS density, p_partkey % 4 = 0 AS image_dominant, p_partkey % 140 AS kb_page, CASE p_partkey % 9 WHEN 0 THEN 'internet archive' WHEN 1 THEN 'lura document' WHEN 2 THEN NULL ELSE 'quartz' END AS producer, CASE p_partkey % 5 WHEN 0 THEN 0.01 WHEN 1 THEN NULL ELSE 0.4 END AS hit_rate FROM {part}",
    "cache_v": "SELECT event_id, user_id AS hash, event_id % 3 AS tier, CASE WHEN event_id % 7 = 0 THEN NULL ELSE cast(floor(value) AS bigint) END AS quality, event_type AS method, event_id % 5 AS served, event_id % 11 AS cost_cents FROM {events}",
    "diags_v": "SELECT doc_id AS book_id, 'batch' AS batch, doc_id % 2 AS run, concat('doc', cast(doc_id AS string), '.pdf') AS filename, CASE doc_id % 4 WHEN 0 THEN 'scan' WHEN 1 THEN 'digital_native' WHEN 2 THEN 'unknown' ELSE 'multi_column' END AS source_type, lang AS format, doc_id % 7 AS chapter_count, doc_id % 13 = 0 AS only_backmatter, (doc_id * 7) % 40 AS ligature_splits, doc_id % 25 AS footnotes_unlinked, doc_id % 3 AS footnotes_linked, doc_id % 2 = 0 AS vqa_attempted, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE 40 + (doc_id * 11) % 60 END AS vqa_score, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE 70 END AS vqa_threshold, doc_id % 37 <> 0 AS extraction_success, doc_id % 5 = 0 AS kfx_attempted, CASE WHEN doc_id % 15 = 0 THEN NULL ELSE doc_id % 10 <> 0 END AS kfx_success, doc_id % 9 AS page_numbers, doc_id % 4 AS italic_tags, doc_id % 6 AS bold_tags, n_chars * 3 AS word_count, (doc_id * 3) % 50 AS double_spaces, CASE WHEN doc_id % 21 = 0 THEN 'File is Encrypted' WHEN doc_id % 23 = 0 THEN 'PASSWORD needed' WHEN doc_id % 2 = 0 THEN 'other' END AS errors, doc_id % 8 = 0 AS has_non_latin, doc_id % 16 AS non_latin_pct, CASE doc_id % 3 WHEN 0 THEN 'claude_vision' WHEN 1 THEN 'legacy' END AS extraction_path, cast(doc_id % 10 AS double) / 10 AS column_confidence, CASE WHEN doc_id % 12 = 0 THEN NULL ELSE (doc_id * 13) % 101 END AS text_layer_score, doc_id % 14 AS encoding_fixes, n_chars * 9000 AS file_size, doc_id % 30 AS cost_cents FROM {documents}",
    "quotes_v": "SELECT doc_id, replace(replace(replace(text, ' th', concat(' ', chr(34), 'th')), 'e ', concat('e', chr(34), ' ')), 'o ', concat('o', chr(39), 's ')) AS text FROM {documents}",
    "masked_v": "SELECT doc_id, replace(replace(replace(text, 'the ', 'f**king '), 'and ', 'cr*p '), 'of ', 'S***x ') AS text FROM {documents}",
    "broken_v": "SELECT doc_id, replace(replace(text, 'the ', concat('th', chr(195), chr(169), ' ')), 'and ', concat('an', chr(12), 'd ')) AS text FROM {documents}",
    "spoken_v": "SELECT doc_id, replace(replace(text, '. ', concat('.', chr(10), '<silence msec=', chr(34), '250', chr(34), '/> ', chr(10))), ', ', concat(',<voice name=x>', chr(10), repeat(chr(123), 2), 'Pause=50', repeat(chr(125), 2), chr(10), '</voice>')) AS text FROM {documents}",
    "outline_v": "SELECT doc_id, replace(replace(replace(replace(text, '. ', concat('.', chr(10), '# Head', chr(10), '# Head', chr(10))), ', ', concat(',', chr(10), ')', chr(10), chr(10))), 'e t', concat('e', chr(10), 't')), 'n o', concat('n', chr(10), chr(10), 'CHAPTER IV', chr(10), chr(10), 'o')) AS text FROM {documents}",
    "names_v": "SELECT o_orderkey AS id, CASE o_custkey % 10 WHEN 0 THEN concat('Andrew Cooper - The Oil Kings', cast(o_custkey AS string), ' (2011, Simon & Schuster) - libgen.li.pdf') WHEN 1 THEN concat('Big Book -- John Doe -- Some House, 2019 -- ', cast(1950 + o_custkey % 70 AS string), ' -- 9780306406157 -- abcdef0123456789abcdef01 -- Anna', chr(39), 's Archive.epub') WHEN 2 THEN concat('(Great Books) Ann Author - A Title', cast(o_custkey AS string), '-House Books (1989).pdf') WHEN 3 THEN concat('Title_', cast(o_custkey AS string), '_-_Someone_Else_2004_House.mobi') WHEN 4 THEN concat('A Plain Title ', cast(o_custkey AS string), '.txt') WHEN 5 THEN concat('Legacy Title - Old Author', cast(o_custkey AS string), '_visual_qa_report.json') WHEN 6 THEN concat('Curly', cast(o_custkey AS string), chr(123), 'An Author', chr(125), '(1999, A House)', chr(123), '77', chr(125), ' libgen.li.pdf') WHEN 7 THEN concat('Curly two', chr(123), 'By Author', chr(125), chr(123), cast(o_custkey AS string), chr(125), ' libgen.li.pdf') WHEN 8 THEN concat('(1987) by Some One - Under__scored_ Title ', cast(o_custkey AS string), '.pdf') ELSE concat('c:/x/y/Deep: path? - 1955 and 2003 ', cast(o_custkey AS string), '.azw3') END AS name FROM {orders}",
    "debris_v": "SELECT o_orderkey AS id, CASE o_custkey % 7 WHEN 0 THEN '256' WHEN 1 THEN '2 5 6' WHEN 2 THEN concat('256 Chapter ', cast(o_custkey AS string)) WHEN 3 THEN '2 5 6 Chapter 3 Machine' WHEN 4 THEN '3 Chapter 1 Introduction' WHEN 5 THEN 'body text 12' ELSE o_orderpriority END AS t FROM {orders}",
    "forum_v": "SELECT conv_id * 1000 + turn AS page_id, concat('<html>', '<article class=x data-author=', chr(34), 'u', cast(turn AS string), chr(34), ' data-content=', chr(34), 'post-', cast(turn AS string), chr(34), '><time class=t datetime=', chr(34), '2024-01-0', cast(1 + turn % 9 AS string), 'T10:00:00+0200', chr(34), '></time><div class=', chr(34), 'bbWrapper', chr(34), '>', CASE turn % 3 WHEN 0 THEN concat('<blockquote><div class=', chr(34), 'bbCodeBlock-title', chr(34), '><a>Bob said:</a></div><div class=', chr(34), 'bbCodeBlock-expandContent', chr(34), '>', text, '</div></blockquote>short') WHEN 1 THEN concat(text, ' <a href=', chr(34), 'https://news.example.org/a/', cast(conv_id AS string), chr(34), '>Read <b>this</b></a> and https://x.com/me/status/', cast(turn AS string), '.') ELSE text END, '</div> </div> </div> </article>') AS html FROM {conversations}",
    "matter_v": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ', ', concat(', 12-14', chr(10))) WHEN 1 THEN replace(text, '. ', concat('.', chr(10), '17. ')) WHEN 2 THEN replace(text, ' ', concat(' é 12', chr(10), '3 ')) ELSE text END AS text FROM {documents}",
    "jobs_v": "SELECT o_orderkey AS job_id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_orderkey - o_custkey % 7 END AS parent_id, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_custkey % 60 END AS message_id, CASE o_custkey % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'queued' WHEN 2 THEN 'done' ELSE 'failed' END AS state, o_custkey AS created_at, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE o_custkey % 2000 END AS expires_at FROM {orders}",
    "recipes_v": "SELECT p_partkey AS file_id, CASE p_partkey % 7 WHEN 0 THEN 'epub' WHEN 1 THEN 'mobi' ELSE 'pdf' END AS format, CASE p_size % 4 WHEN 0 THEN 'scan_no_text' WHEN 1 THEN 'scan_with_text' WHEN 2 THEN 'digital_native' ELSE 'unknown' END AS kind, cast(50 + p_partkey % 40 AS double) / 100 AS sure, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey % 101 END AS score, CASE WHEN p_partkey % 3 = 0 THEN 0.01 ELSE 0.4 END AS common_rate, p_partkey % 2 = 0 AS chapters_advised, CASE p_partkey % 5 WHEN 0 THEN 'viable' WHEN 1 THEN 'degraded' WHEN 2 THEN 'unusable' WHEN 3 THEN 'none' END AS footnotes, CASE p_partkey % 4 WHEN 0 THEN 'viable' WHEN 1 THEN 'degraded' END AS index, CASE p_partkey % 3 WHEN 0 THEN 'viable' WHEN 1 THEN 'none' END AS links, p_partkey % 11 = 0 AS two_columns, CASE p_partkey % 6 WHEN 0 THEN 'book_history' WHEN 1 THEN 'publisher_profile' WHEN 2 THEN 'source_type_profile' WHEN 3 THEN 'default' END AS history, 50 + p_partkey % 50 AS best_score, p_partkey % 4 = 0 AS prior_chapters, p_partkey % 8 = 0 AS prior_columns FROM {part}",
    "book_v": "SELECT doc_id, concat('<h1>Preface</h1><p>by</p><h2>Chapter ', cast(doc_id % 9 AS string), '</h2><p>', text, '<sup>3</sup><a href=', chr(34), 'http://x.org', chr(34), '>link</a></p><blockquote>said</blockquote><h2>More of <i>it</i></h2><p>', source, ' ', replace(text, chr(10), ' '), '</p><h1>Index of names</h1><p>a</p><h2>Bibliography</h2><p>b</p>') AS html FROM {documents}",
    "links_v": "SELECT page_id, CASE page_id % 9 WHEN 0 THEN concat(url, '?utm_medium=footer') WHEN 1 THEN concat(url, '.PNG?x=1') WHEN 2 THEN concat('https://www.reddit.com/r/', cast(page_id AS string)) WHEN 3 THEN concat('http://i.imgur.com/', cast(page_id AS string)) WHEN 4 THEN concat('https://x.com/a/status/', cast(page_id AS string)) WHEN 5 THEN concat(url, '?utm_source=mail') WHEN 6 THEN 'ftp://short' ELSE url END AS url FROM {pages}",
    "fonts_v": "SELECT l_suppkey AS doc_id, CASE WHEN l_partkey % 53 = 0 THEN 'ZapfDingbats' WHEN l_partkey % 59 = 0 THEN 'ABCDEF+CIDFont' WHEN l_partkey % 61 = 0 THEN 'Zed-Identity-H' WHEN l_partkey % 67 = 0 THEN '' ELSE concat('Font-', cast(l_partkey % 47 AS string)) END AS font_name FROM {lineitem}",
    "uploads_v": "SELECT page_id, concat(CASE page_id % 5 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN concat('PK', chr(3), chr(4)) WHEN 2 THEN concat(chr(137), 'PNG') ELSE '' END, substring(html, 1, 260)) AS header, CASE page_id % 4 WHEN 0 THEN concat(url, '.MOBI') WHEN 1 THEN concat(url, '.djvu') WHEN 2 THEN concat(url, '.exe') ELSE url END AS name, CASE WHEN length(html) % 9 = 0 THEN 0 ELSE cast(length(html) AS bigint) * 6000 END AS size, CASE WHEN page_id % 3 = 0 THEN 'free' ELSE 'premium' END AS tier, CASE length(html) % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'mobi' WHEN 2 THEN 'kfx' ELSE 'pdf' END AS output FROM {pages}",
    "recipients_v": "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN concat('  ', c_name, '@Kindle.com ') WHEN 1 THEN concat('<', c_name, '@kindle.com>') WHEN 2 THEN concat('a+', c_name, '@kindle.com') WHEN 3 THEN concat(c_name, ' <x@kindle.com>') WHEN 4 THEN concat(c_name, '@free.kindle.com') WHEN 5 THEN concat(c_name, '@example.org') WHEN 6 THEN '@kindle.com' WHEN 7 THEN concat(c_name, '@kindle.com.example.org') END AS address FROM {customer}",
    "calls_v": "SELECT user_id AS client, event_id AS call_id, cast(floor(event_id / 8) AS bigint) AS called_at, event_type <> 'purchase' AS failed FROM {events}",
    "chapters_v": "SELECT doc_id, concat('<h1>Preface</h1><h2>Empty</h2><h2 class=x>Chapter ', cast(doc_id % 9 AS string), '</h2><p>', replace(text, '. ', '.</p><h2>Part</h2><p>'), '</p><h3>Of <i>it</i></h3><p>', source, '</p><h2>Last</h2>') AS html FROM {documents}",
    "later_v": "SELECT doc_id, concat('<h1>Preface</h1><h2>Chapter ', cast(doc_id % 9 AS string), '</h2><p>', replace(replace(text, '. ', '.</p><h2>Part</h2><p>'), 'e ', CASE WHEN doc_id % 3 = 0 THEN 'a  ' ELSE 'e ' END), '</p>', CASE WHEN doc_id % 4 = 0 THEN '<h2>New</h2>' ELSE '' END, '<p>', source, '</p>') AS html FROM {documents}",
    "scanned_v": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, ' that ', ' t h a t ') WHEN 1 THEN replace(text, 'tion ', concat('ti-', chr(10), 'on ')) WHEN 2 THEN CASE WHEN doc_id % 50 = 2 THEN replace(text, 'm', 'rn') ELSE text END ELSE text END AS text FROM {documents}",
    "scripts_v": "SELECT doc_id, CASE lang WHEN 'fr' THEN translate(text, 'aeiou', 'αεиוא') WHEN 'de' THEN translate(text, 'nrst', '漢あカ�') WHEN 'es' THEN translate(text, 'dlmc', 'अ한جж') ELSE text END AS text FROM {documents}",
    "marked_v": "SELECT doc_id, concat('<h1>', source, '</h1><h2 id=x>', lang, '</h2><p><b>', replace(replace(text, '. ', '.</p><p class=a>'), 'q', concat('�', '<strong>q</strong>')), '</p>') AS html FROM {documents}",
    "wide_v": "SELECT doc_id, concat('<p>', replace(CASE WHEN doc_id % 2 = 0 THEN text ELSE replace(text, ', ', concat(',', chr(10))) END, '. ', '.</p><p class=a>'), '</p>') AS html FROM {documents}",
    "titles_v": "SELECT o_orderkey AS id, concat(o_orderpriority, CASE o_custkey % 4 WHEN 0 THEN ': a subtitle' WHEN 1 THEN ' — or not' WHEN 2 THEN ', The Land 25-48' ELSE ' of Öre (2nd)' END) AS title, CASE o_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('Smith', cast(o_custkey % 90 AS string), ', J. R.') WHEN 2 THEN concat('Gary M. Burge', cast(o_custkey % 70 AS string)) WHEN 3 THEN 'X' ELSE 'Anna-Lena Öst' END AS author FROM {orders}",
    "posts_v": "SELECT conv_id, turn, role, text AS body FROM {conversations}",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables that it names."""
    tables = re.findall(r"\{(\w+)\}", VIEWS[name])
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in dict.fromkeys(tables)})


def with_views(sql: str) -> str:
    """sql with the views that it uses as common table expressions, for the checking engine."""
    used = [f"{v} AS ({re.sub(r'[{}]', '', VIEWS[v])})" for v in VIEWS if v in sql]
    own = sql.strip().removeprefix("WITH ") if sql.strip().startswith("WITH ") else None
    return sql if not used else f"WITH {', '.join(used)}, {own}" if own else f"WITH {', '.join(used)} {sql}"
