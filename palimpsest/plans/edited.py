"""Queries of text editing."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edits as E
from .queries import WHITE_SQL
from .registry import query

#: Every transform that is split into lines gets them from this view's text.
DIGEST = "md5(text) AS digest"


def _told(d, made, *more):
    d = d.select("doc_id", made.alias("f"))
    return d.select("doc_id", F.md5(F.col("f.text").cast("binary")).alias("digest"), *(more or [F.col("f.n").alias("n")]))


def steps_sql(view: str, rules: list[tuple[str, str]]) -> str:
    """SQL of replacements in order, and of how many places each changes."""
    ctes = [f"s0 AS (SELECT doc_id, text AS t, 0 AS n FROM {view})"]
    ctes += [f"s{k + 1} AS (SELECT doc_id, regexp_replace(t, '{p}', '{to}', 'g') AS t, n + len(regexp_extract_all(t, '{p}')) AS n FROM s{k})" for k, (p, to) in enumerate(rules)]
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, md5(t) AS digest, n::BIGINT AS n FROM s{len(rules)}"


#: The rules without lookaround: what stands before and after a quote is put back.
QUOTES_SQL = [(r"(?m)(^|[\s(])\"([\pL\pN_])", r"\1“\2"), (r"(?m)([\pL\pN_.,;:!?])\"([\s.,;:!?)]|$)", r"\1”\2"), (r"(?m)^\"([\pL\pN_])", r"“\1"), (r"([\pL\pN_])''([\pL\pN_])", r"\1’\2"), (r"(?m)(^|[\s(])''([\pL\pN_])", r"\1‘\2"), (r"(?m)([\pL\pN_])''([\s.,;:!?]|$)", r"\1’\2")]


@query("fix_smart_quotes", steps_sql("quotes_v", QUOTES_SQL), "quotes_v")
def fix_smart_quotes(d):
    return _told(d, E.fix_smart_quotes(F.col("text")))


@query("fix_headings", None, "outline_v")
def fix_headings(d):
    return _told(d, E.fix_headings(F.col("text")))


@query("fix_html_headings", None, "pages")
def fix_html_headings(p):
    return _told(p.select(F.col("page_id").alias("doc_id"), E.fix_headings(F.col("html"), html=True).alias("f")).select("doc_id", F.col("f").alias("g")), F.col("g"))


@query("drop_empty_paragraphs", r"SELECT page_id AS doc_id, md5(regexp_replace(h, '<p>\s*</p>', '', 'g')) AS digest, len(regexp_extract_all(h, '<p>\s*</p>'))::BIGINT AS n FROM (SELECT page_id, replace(html, '. ', '.<p> </p>') AS h FROM pages)", "pages")
def drop_empty_paragraphs(p):
    return _told(p.select(F.col("page_id").alias("doc_id"), F.replace("html", F.lit(". "), F.lit(".<p> </p>")).alias("h")), E.fix_paragraphs(F.col("h"), html=True))


@query("fix_orphans", None, "outline_v")
def fix_orphans(d):
    return _told(d, E.fix_orphans(F.col("text")))


@query("apply_fixes", None, "outline_v")
def apply_fixes(d):
    return _told(d, E.apply_fixes(F.col("text")), *(F.col("f.counts")[k].alias(k) for k in E.PASSES))


@query("apply_whitespace_only", WHITE_SQL, "dirty_v")
def apply_whitespace_only(d):
    return _told(d, E.apply_fixes(F.col("text"), ("whitespace",)), F.col("f.counts")["whitespace"].alias("n_fixes"))


@query("unmask", steps_sql("masked_v", [(p.replace(r"\\", "\\"), to) for p, to in E.MASKED]), "masked_v")
def unmask(d):
    return _told(d, E.unmask(F.col("text")))


TABLE = {"ﬁ": "fi", "ﬂ": "fl", "teh ": "the ", "th e ": "the "}


@query("replace_by_table", "SELECT doc_id, md5(replace(replace(replace(replace(text, 'th e ', 'the '), 'teh ', 'the '), 'ﬁ', 'fi'), 'ﬂ', 'fl')) AS digest, ((length(text) - length(replace(text, 'th e ', ''))) // 5)::BIGINT AS n FROM dirty_v", "dirty_v")
def replace_by_table(d):
    return _told(d, E.replaced(F.col("text"), TABLE))


@query("normalize_encoding", "SELECT doc_id, md5(translate(replace(replace(text, 'Ã©', 'é'), 'â€™', '’'), chr(12), '')) AS digest, ((length(text) - length(replace(text, 'Ã©', ''))) // 2 + (length(text) - length(replace(text, 'â€™', ''))) // 3)::BIGINT AS mojibake_fixed, (length(text) - length(replace(text, chr(12), '')))::BIGINT AS control_chars_removed FROM broken_v", "broken_v")
def normalize_encoding(d):
    return _told(d, E.normalize_encoding(F.col("text")), "f.mojibake_fixed", "f.control_chars_removed")


@query("pronounced", "SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ' '), lambda w: CASE w WHEN 'the' THEN 'thee' WHEN 'of' THEN 'ov' ELSE w END), ' ')) AS digest FROM documents", "documents")
def pronounced(d):
    return d.select("doc_id", F.md5(E.pronounced(F.col("text"), {"the": "thee", "of": "ov"}).cast("binary")).alias("digest"))


@query("strip_speech_tags", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '(?i)<voice[^>]*>|</voice>|<silence\s+msec=\"[0-9]+\"\s*/?>|<rate[^>]*>|</rate>', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM spoken_v", "spoken_v")
def strip_speech_tags(d):
    return d.select("doc_id", F.md5(E.strip_speech_tags(F.col("text")).cast("binary")).alias("digest"))


@query("lone_silence", r"SELECT doc_id, line_no, line FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, trim(unnest(l)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM spoken_v)) WHERE regexp_matches(line, '^<silence\s+msec=\"[0-9]+\"\s*/>\s*$') OR regexp_matches(line, '^\{\{Pause=[0-9]+\}\}\s*$')", "spoken_v")
def lone_silence(d):
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.trim("line").alias("line"))
    return lines.where(F.col("line").rlike(r'^<silence\s+msec="[0-9]+"\s*/>\s*$') | F.col("line").rlike(r"^\{\{Pause=[0-9]+\}\}\s*$"))


@query("chunked", None, "documents")
def chunked(d):
    return d.select("doc_id", F.posexplode(E.chunks(F.col("text"))).alias("place", "chunk")).select("doc_id", "place", F.md5(F.col("chunk").cast("binary")).alias("digest"), F.size(F.split("chunk", r"\s+")).alias("n_words"))


@query("book_stems", r"WITH t AS (SELECT id, lower(name) AS s FROM names_v), u AS (SELECT id, s, regexp_extract(s, '(?s)^.+ - (.*?)$', 1) AS x FROM t) SELECT id, trim(regexp_replace(CASE WHEN regexp_matches(s, '(?s)^.+ - ') AND length(x) BETWEEN 2 AND 40 AND regexp_matches(x, '^[\pL\pN_\s,.\-]+$') THEN regexp_extract(s, '(?s)^(.+) - .*?$', 1) ELSE s END, '[^\pL\pN_]+', ' ', 'g'), ' ') AS stem FROM u", "names_v")
def book_stems(n):
    return n.select("id", E.book_stem(F.col("name")).alias("stem"))


@query("page_debris", r"SELECT id, CASE WHEN regexp_matches(t, '^\s*[0-9]( ?[0-9])*\s*$') THEN '' WHEN regexp_matches(t, '^([0-9] ?){3,}Chapter\b') THEN regexp_replace(t, '^([0-9] ?)+', '') ELSE t END AS t FROM debris_v", "debris_v")
def page_debris(d):
    return d.select("id", E.page_debris(F.col("t")).alias("t"))


@query("scalar_names", r"SELECT id, trim(regexp_replace(regexp_replace(name, '[<>:\"/\\|?*]', '', 'g'), '\s+', ' ', 'g'), ' ') AS file, CASE WHEN id % 2 = 0 AND NOT ends_with(lower(name), '.pdf') THEN 'Convert: ' || name ELSE name END || CASE WHEN id % 3 > 0 THEN ' (Part ' || id % 3 || ' of 2)' ELSE '' END AS subject FROM names_v", "names_v")
def scalar_names(n):
    return n.select("id", E.safe_filename(F.col("name")).alias("file"), E.mail_subject(F.col("name"), F.col("name"), F.col("id") % 2 == 0, F.col("id") % 3, F.lit(2)).alias("subject"))
