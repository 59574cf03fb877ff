"""Queries of numbers of books, scripts, speech, snippets, dates and the whole structure of a page."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forum, speech
from ..functions import text as T
from ..operators import alignment as A
from ..operators import choose as C
from ..operators import pages as P
from .registry import query


@query("isbn_checks", "WITH i AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'ISBN: 978-' WHEN 'O' THEN 'isbn 979 ' ELSE '' END || lpad(o_custkey::VARCHAR, 9, '0') || '-' || CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderpriority[1:1] END || CASE WHEN o_totalprice < 20000 THEN '7' ELSE '' END AS t FROM orders) SELECT o_orderkey, regexp_matches(regexp_replace(regexp_replace(lower(t), '^ *isbn[: ]*', ''), '[- ]', '', 'g'), '^(97[89])?[0-9]{9}[0-9x]$') AS valid FROM i", "orders")
def isbn_checks(o):
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    front = F.when(status == "F", "ISBN: 978-").when(status == "O", "isbn 979 ").otherwise("")
    text = F.concat(front, F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("-"), F.when(price > 200_000, "X").otherwise(F.substring("o_orderpriority", 1, 1)), F.when(price < 20_000, "7").otherwise(""))
    return o.select("o_orderkey", T.valid_isbn(text).alias("valid"))


def _share(script: str) -> str:
    return f"round_even(len(regexp_extract_all(text, '\\p{{{script}}}')) * 100::DOUBLE / greatest(len(regexp_extract_all(text, '\\pL')), 1), 1) AS {script.lower()}"


@query("script_shares", f"WITH s AS (SELECT doc_id, {', '.join(_share(s) for s in C.SCRIPTS)}, round_even(len(regexp_extract_all(text, '�')) * 100::DOUBLE / greatest(length(text), 1), 2) AS replaced, len(regexp_extract_all(text, '\\pL')) - {' - '.join(f'''len(regexp_extract_all(text, '\\p{{{s}}}'))''' for s in C.SCRIPTS)} > 0 AS unknown FROM scripts_v) SELECT doc_id, {', '.join(s.lower() for s in C.SCRIPTS)}, replaced, round_even({' + '.join(s.lower() for s in C.SCRIPTS if s != 'Latin')}, 1) AS non_latin FROM s", "scripts_v")
def script_shares(d):
    return d.select("doc_id", *(c.alias(n) for n, c in C.script_shares(F.col("text")).items()))


@query("spoken_spans", "WITH s AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[\"“]([^\"“”]+)[\"”]', 1), lambda x: len(regexp_extract_all(x, '[^\\s\\x0b]+')) >= 3 AND regexp_matches(x, '\\pL')) AS s FROM quotes_v) SELECT doc_id, len(s)::BIGINT AS n, md5(array_to_string(s, '|')) AS digest FROM s", "quotes_v")
def spoken_spans(d):
    s = d.select("doc_id", speech.spoken(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("closing_sentences", "WITH p AS (SELECT doc_id, regexp_replace(unnest(string_split(text, chr(10))), '[\\s\\x0b]+$', '') AS p FROM documents), s AS (SELECT doc_id, string_split(regexp_replace(p, '([.!?])[\\s\\x0b]+', '\\1' || chr(10), 'g'), chr(10)) AS s FROM p), l AS (SELECT doc_id, len(s) AS n, s[len(s)] AS last FROM s) SELECT doc_id, count(*) AS n, sum(length(last))::BIGINT AS n_chars FROM l WHERE n > 1 AND regexp_matches(last, '[.!]$') AND len(regexp_extract_all(last, '[^\\s\\x0b]+')) BETWEEN 3 AND 18 AND NOT regexp_matches(last, '[\"“”]') AND last <> upper(last) GROUP BY 1", "documents")
def closing_sentences(d):
    p = d.select("doc_id", F.explode(F.split("text", "\n")).alias("p")).select("doc_id", speech.closer(F.col("p")).alias("last"))
    return p.where("last IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("last")).alias("n_chars"))


@query("dash_pauses", "WITH t AS (SELECT doc_id, replace(replace(replace(replace(replace(text, '-', ''), '–', ''), ', ', '--'), '. ', ' — '), 'e t', 'e–t') AS t FROM documents WHERE NOT contains(text, ', , ') AND NOT contains(text, ',, ')) SELECT doc_id, md5(replace(replace(regexp_replace(t, '[\\s\\x0b]*—[\\s\\x0b]*', '<silence msec=\"250\"/>', 'g'), '--', '<silence msec=\"250\"/>'), 'e–t', 'e<silence msec=\"150\"/>t')) AS digest FROM t", "documents")
def dash_pauses(d):
    text = F.col("text")
    for old, new in (("-", ""), ("–", ""), (", ", "--"), (". ", " — "), ("e t", "e–t")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return d.where(~F.contains("text", F.lit(", , ")) & ~F.contains("text", F.lit(",, "))).select("doc_id", F.md5(speech.dash_pauses(text).cast("binary")).alias("digest"))


@query("heading_snippets", r"""WITH h AS (SELECT doc_id, string_split_regex(html, '<h[123]>.*?</h[123]>')[2:] AS s FROM book_v), p AS (SELECT doc_id, unnest(range(len(s)))::INT AS place, unnest(s) AS x FROM h)
SELECT doc_id, place, left(array_to_string(list_filter(list_transform(regexp_extract_all(x, '<p>(.*?)</p>', 1), lambda t: trim(regexp_replace(t, '<[^>]+>', '', 'g'), ' ')), lambda t: t <> ''), ' '), 200) AS body FROM p""", "book_v")
def heading_snippets(b):
    return A.output_headings(b, "html", "doc_id").select("doc_id", "place", "body")


@query("date_arguments", "WITH a AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 'O' THEN strftime(o_orderdate, ' %Y-%m-%dT%H:%M:%S') ELSE CASE WHEN o_totalprice > 100000 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(o_orderdate, '%d/%m/%Y') END END AS t, CASE WHEN o_orderstatus = 'P' AND o_totalprice <= 100000 THEN NULL WHEN o_orderstatus = 'F' THEN date_trunc('day', o_orderdate)::TIMESTAMP ELSE o_orderdate::TIMESTAMP END AS given FROM orders) SELECT o_orderkey, given FROM a", "orders")
def date_arguments(o):
    day, status = F.col("o_orderdate").cast("timestamp"), F.col("o_orderstatus")
    text = F.when(status == "F", F.date_format(day, "yyyy-MM-dd")).when(status == "O", F.date_format(day, " yyyy-MM-dd'T'HH:mm:ss")).when(F.col("o_totalprice") > 100_000, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    return o.select("o_orderkey", forum.date_argument(text).cast("timestamp_ntz").alias("given"))


@query("page_structure", r"""WITH w AS (SELECT doc_id, html, doc_id % 2 = 0 AS columns, CASE WHEN length(html) % 3 = 0 THEN 'pymupdf_columns' ELSE 'legacy' END AS path, regexp_replace(html, '<[^>]+>', ' ', 'g') AS body FROM marked_v),
m AS (SELECT *, list_filter(list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1)[1:200], lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) >= 20) AS p FROM w)
SELECT doc_id, (len(regexp_extract_all(html, '<h1(?:\s[^>]*)?>(.+?)</h1>')) + len(regexp_extract_all(html, '<h2(?:\s[^>]*)?>(.+?)</h2>')))::INT AS chapter_count, len(regexp_extract_all(body, '[^\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))::INT AS word_count, len(regexp_extract_all(html, '<(?:strong|b)>'))::INT AS bold_tags, len(regexp_extract_all(body, '�'))::BIGINT AS encoding_errors,
columns AND path <> 'pymupdf_columns' AND len(p) > 10 AND coalesce(list_sum(list_transform(p, lambda x: len(list_filter(string_split(x, chr(10)), lambda y: length(trim(y, ' ' || chr(9) || chr(13))) > 150)))), 0)::DOUBLE / greatest(1, len(p)) > 0.3 AS possible_column_merge FROM m""", "marked_v")
def page_structure(d):
    s = P.structure(F.col("html"), F.col("doc_id") % 2 == 0, F.when(F.length("html") % 3 == 0, "pymupdf_columns").otherwise("legacy"))
    return d.select("doc_id", *(s[n].alias(n) for n in ("chapter_count", "word_count", "bold_tags", "encoding_errors", "possible_column_merge")))
