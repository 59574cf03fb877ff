"""What a reader does not want of a converted book: notes, index, bibliography, links, front and back matter, images, quotes.

A page is cut before its first- and second-level headings; sections stay or go as wholes, so everything is arrays inside one row.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lines import once

#: What each profile leaves out.
PROFILES = {"full": (), "clean-read": ("footnotes", "index", "hyperlinks", "front_matter", "bibliography"), "text-only": ("footnotes", "index", "hyperlinks", "front_matter", "back_matter", "images", "block_quotes")}
#: Headings of what may go.
NOTES = r"(?i)^(?:notes?|endnotes?|footnotes?)$"
INDEX = r"(?i)^(?:index|indices|scripture\s+index|subject\s+index|author\s+index|name\s+index|search\s+items?\s+of\s+biblical\s+and\s+ancient\s+sources|index\s+of\s+.+)$"
BIBLIOGRAPHY = r"(?i)^(?:bibliography|references?|works?\s+cited|sources?\s+cited|selected\s+bibliography|annotated\s+bibliography|further\s+reading|suggested\s+reading|recommended\s+reading|list\s+of\s+(?:works|references|sources)\s+cited)$"
FRONT = r"(?i)^(?:preface|foreword|acknowledge?ments?|dedication|endorsements?|epigraph|contributors?|list\s+of\s+(?:illustrations|abbreviations|maps|tables)|translator'?s?\s+note|editor'?s?\s+note|introduction\s+to\s+the\s+series)$"
BACK = r"(?i)^(?:notes?|endnotes?|footnotes?|bibliography|references?|index|works?\s+cited|further\s+reading|selected\s+bibliography|acknowledge?ments?|appendix|appendices|glossary|abbreviations?|scripture\s+index|subject\s+index|author\s+index|name\s+index|search\s+items?\s+of\s+biblical\s+and\s+ancient\s+sources|about\s+the\s+authors?)$"
SECTION = r"(?=<h[12](?:\s[^>]*)?>)"
HEAD = r"^<h[12](?:\s[^>]*)?>(.*?)</h[12]>"


def _heading(section: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(section, rf"(?s){HEAD}", 1), "<[^>]+>", ""))


def filter_html(html: Column, profile: str = "full") -> Column:
    """Struct of the filtered page, removed (a map: how many of what) and the size reduction in percent."""
    chosen = PROFILES[profile]
    if not chosen:
        return F.struct(html.alias("html"), F.create_map().cast("map<string,bigint>").alias("removed"), F.lit(0.0).alias("reduction"))

    def stage(name: str, state: Column) -> Column:
        put = lambda new, n: F.struct(new.alias("html"), F.when(n > 0, F.map_concat(state["removed"], F.create_map(F.lit(name), n.cast("bigint")))).otherwise(state["removed"]).alias("removed"))
        page = state["html"]
        count = lambda p: F.regexp_count(page, F.lit(p))
        cut = lambda keep: once(F.split(page, SECTION), lambda s: once(keep(s), lambda k: put(F.array_join(k, ""), F.size(s) - F.size(k))))
        named = lambda p: cut(lambda s: F.filter(s, lambda x: ~_heading(x).rlike(p)))
        if name == "footnotes":
            mark = r'<sup>\s*<a\s[^>]*href="#[^>]*>.*?</a>\s*</sup>|<sup>\s*[0-9]+\s*</sup>'
            target = r'<p[^>]*>(?:(?!</p>).)*<a\s[^>]*id="(?:endnote_|footnote_)[^>]*>(?:(?!</p>).)*</p>'
            marks = count(mark)
            return once(put(F.regexp_replace(page, mark, ""), marks), lambda a: once(F.split(a["html"], SECTION), lambda s: once(F.filter(s, lambda x: ~_heading(x).rlike(NOTES)), lambda k: once(F.array_join(k, ""), lambda t: put(F.regexp_replace(t, target, ""), marks + F.size(s) - F.size(k) + F.regexp_count(t, F.lit(target)))))))
        if name == "index":
            return named(INDEX)
        if name == "bibliography":
            return named(BIBLIOGRAPHY)
        if name == "hyperlinks":
            link = r"""(?s)<a\s(?![^>]*\bid=)[^>]*href=[^>]*>(.*?)</a>"""
            return put(F.regexp_replace(page, link, "$1"), count(link))
        if name == "front_matter":
            # Only sections before the first that is no front matter.
            def before(s: Column) -> Column:
                other = F.filter(F.transform(s, lambda x, i: F.when(x.rlike(r"^<h[12][\s>]") & ~_heading(x).rlike(FRONT) & ~F.lower(_heading(x)).startswith("front matter"), i)), lambda i: i.isNotNull())
                return once(F.coalesce(F.get(other, F.lit(0)), F.lit(1 << 30)), lambda first: F.filter(s, lambda x, i: (i >= first) | ~_heading(x).rlike(FRONT)))

            return cut(before)
        if name == "back_matter":
            def until(s: Column) -> Column:
                found = F.filter(F.transform(s, lambda x, i: F.when(_heading(x).rlike(BACK), i)), lambda i: i.isNotNull())
                return once(F.coalesce(F.get(found, F.lit(0)), F.size(s)), lambda first: F.slice(s, 1, first))

            return once(cut(until), lambda a: F.struct(a["html"].alias("html"), F.when(F.length(a["html"]) < F.length(page), F.map_concat(state["removed"], F.create_map(F.lit(name), F.lit(1).cast("bigint")))).otherwise(state["removed"]).alias("removed")))
        if name == "images":
            figure, image = r"(?s)<figure[^>]*>.*?</figure>", r"<img\b[^>]*>"
            return once(F.regexp_replace(page, figure, ""), lambda t: put(F.regexp_replace(F.regexp_replace(t, image, ""), r"(?s)<figcaption[^>]*>.*?</figcaption>", ""), count(figure) + F.regexp_count(t, F.lit(image))))
        quote, bare = r"(?s)<blockquote[^>]*>((?:(?!</blockquote>).)*<p(?:(?!</blockquote>).)*)</blockquote>", r"(?s)<blockquote[^>]*>(.*?)</blockquote>"
        return put(F.regexp_replace(F.regexp_replace(page, quote, "$1"), bare, "<p>$1</p>"), count(bare))

    value = F.struct(html.alias("html"), F.create_map().cast("map<string,bigint>").alias("removed"))
    for name in ("footnotes", "index", "bibliography", "hyperlinks", "front_matter", "back_matter", "images", "block_quotes"):
        if name in chosen:
            value = once(value, _bound(stage, name))
    return once(value, lambda v: F.struct(v["html"].alias("html"), v["removed"].alias("removed"), F.when(F.length(html) > 0, F.bround((1 - F.length(v["html"]) / F.length(html)) * 100, 1)).otherwise(0.0).alias("reduction")))


def _bound(stage, name: str):  # noqa: ANN001, ANN202
    return lambda v: stage(name, v)


def filter_text(text: Column, profile: str = "full") -> Column:
    """Text whose #, ## and ### sections go by their headings: a section ends at the next heading of any level."""
    chosen = PROFILES[profile]
    patterns = [p for name, p in (("footnotes", NOTES), ("index", INDEX), ("front_matter", FRONT), ("back_matter", BACK)) if name in chosen]
    head = lambda s: F.trim(F.regexp_extract(s, r"^#{1,3}\s+(.+)", 1))
    goes = lambda s: _any(head(s), patterns)
    kept = F.filter(F.split(text, r"(?md)\n(?=#{1,3}\s+.)"), lambda s: ~goes(s))
    return F.array_join(kept, "\n")


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out
