"""Posts of forum pages: author, time, quotes, body and links as Columns over a page's HTML."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .edits import unmask
from .lines import once
from .text import clean_html, fetchable, is_tweet

#: Where a post's parts lie in its HTML.
POST = r'(?=<article[^>]+data-author=")'
BODY = r'(?s)class="[^"]*bbWrapper[^"]*">(.*?)(?=</div>\s*</div>\s*</div>\s*</article>|<div class="message-actionBar)'
QUOTE = r"(?s)<blockquote[^>]*>(.*?)</blockquote>"
QUOTED_BY = r"(?s)bbCodeBlock-title.*?>\s*(.*?)\s+said:"
QUOTED = r'(?s)bbCodeBlock-expandContent[^>]*>(.*?)(?:</div>|<div class="bbCodeBlock-expandLink)'
DROPPED = (QUOTE, r'(?s)<div[^>]*class="[^"]*js-unfurl[^"]*"[^>]*>.*?</div>', r'(?s)<div[^>]*class="[^"]*bbMediaWrapper[^"]*"[^>]*>.*?</div>')
CHROME = (r"(?s)Toggle signature.*", r"[0-9]+ Reactions?:.*", r"Click to expand\.\.\.", r"Last edited:.*")
EMBED, EMBEDDED = r"(?i)data-s9e-mediaembed-iframe='([^']+)'", r"(?i)s9e[.]github[.]io/iframe/[0-9]+/([a-z]+)[.]min[.]html#([^#\]]+)"
CARD = r'(?is)<[^>]+class="[^"]*(?:js-unfurl|unfurl)[^"]*"[^>]*>.*?</(?:div|article)>'
CARD_TITLE, CARD_HEAD = r'(?i)(?:unfurl-title|contentRow-title)[^"]*"[^>]*>([^<]+)<', r"(?i)<(?:h[1-6]|strong)[^>]*>([^<]{5,120})<"
ANCHOR, BARE = r"""(?is)<a\s[^>]*href=["']([^"'#][^"']*)["'][^>]*>(.*?)</a>""", r"""https?://[^\s<>"')\]]+"""
TRAIL = r"""[.,;:)"']+$"""
LEAST_BODY, LEAST_QUOTE = 60, 20


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def quotes(block: Column) -> Column:
    """Array of (quoted_user, quoted_text) of more than LEAST_QUOTE characters."""

    def one(q: Column) -> Column:
        text = unmask(clean_html(F.regexp_extract(q, QUOTED, 1)))["text"]
        return F.struct(F.coalesce(clean_html(_found(q, QUOTED_BY)), F.lit("unknown")).alias("quoted_user"), text.alias("quoted_text"))

    return F.filter(F.transform(F.regexp_extract_all(block, F.lit(QUOTE), F.lit(1)), one), lambda q: F.length(q["quoted_text"]) > LEAST_QUOTE)


def body(block: Column) -> Column:
    """What the post itself says, without quotes, cards, media and the forum's own words."""
    raw = F.regexp_extract(block, BODY, 1)
    for gone in DROPPED:
        raw = F.regexp_replace(raw, gone, "")
    text = clean_html(raw)
    for k, gone in enumerate(CHROME):
        text = F.regexp_replace(text, gone, "")
        if k < 2:
            text = F.trim(text)
    return unmask(text)["text"]


def links(block: Column) -> Column:
    """Struct of links (url, title, source) worth fetching and of tweets, each URL once: embeds first, then cards, anchors and bare URLs, the last two from the post's body only."""
    clean = block
    for tag in ("script", "style"):
        clean = F.regexp_replace(clean, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")

    def item(url: Column, title: Column, source: str) -> Column:
        return F.struct(F.regexp_replace(F.trim(url), TRAIL, "").alias("url"), F.trim(title).alias("title"), F.lit(source).alias("source"))

    def card(c: Column) -> Column:
        plain = clean_html(c)
        title = F.coalesce(clean_html(F.coalesce(_found(c, CARD_TITLE), _found(c, CARD_HEAD))), F.when(F.length(plain) < 160, F.substring(plain, 1, 120)).otherwise(""))
        url = F.coalesce(_found(c, r"""data-url=["']([^"']+)["']"""), _found(c, r"""href=["']([^"']+)["']"""), _found(plain, r"(https?://\S+)"), F.lit(""))
        return item(url, title, "unfurl")

    def every(page: Column) -> Column:
        inside = F.coalesce(_found(page, BODY), page)
        embeds = F.transform(F.regexp_extract_all(page, F.lit(EMBED), F.lit(1)), lambda x: F.replace(x, F.lit("\\/"), F.lit("/")))
        embeds = F.filter(embeds, lambda x: F.lower(F.regexp_extract(x, EMBEDDED, 1)) == "twitter")
        embeds = F.transform(embeds, lambda x: F.struct(F.concat(F.lit("https://x.com/i/status/"), F.trim(F.regexp_extract(x, EMBEDDED, 2))).alias("url"), F.lit("").alias("title"), F.lit("embed").alias("source")))
        cards = F.transform(F.regexp_extract_all(page, F.lit(CARD), F.lit(0)), card)
        anchors = F.filter(F.regexp_extract_all(inside, F.lit(ANCHOR), F.lit(0)), lambda a: ~F.trim(F.regexp_extract(a, ANCHOR, 1)).startswith("/"))
        anchors = F.transform(anchors, lambda a: item(F.regexp_extract(a, ANCHOR, 1), clean_html(F.regexp_extract(a, ANCHOR, 2)), "anchor"))
        bare = F.transform(F.regexp_extract_all(inside, F.lit(BARE), F.lit(0)), lambda u: item(u, F.lit(""), "inline"))
        return once(F.filter(F.concat(embeds, cards, anchors, bare), lambda x: x["url"] != ""), first)

    def first(found: Column) -> Column:
        urls = F.transform(found, lambda x: x["url"])
        return once(urls, lambda u: once(F.filter(found, lambda x, i: F.array_position(u, x["url"]) == i + 1), lambda f: F.struct(F.filter(f, lambda x: ~is_tweet(x["url"]) & fetchable(x["url"])).alias("links"), F.transform(F.filter(f, lambda x: is_tweet(x["url"])), lambda x: x["url"]).alias("tweets"))))

    return once(clean, every)


def blocks(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """place and block of each post of each page."""
    return pages.select(*keys, F.posexplode(F.slice(F.split(html, POST), 2, 1 << 30)).alias("place", "block"))


def post_id(block: Column) -> Column:
    return F.regexp_extract(block, r'data-content="(post-[0-9]+)"', 1)


def linked(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """place, id, links and tweets of each post of each page, however short the post is."""
    return blocks(pages, html, *keys).select(*keys, "place", post_id(F.col("block")).alias("id"), links(F.col("block")).alias("l")).select(*keys, "place", "id", "l.links", "l.tweets")


def posts(pages: DataFrame, html: str = "html", *keys: str) -> DataFrame:
    """A row for each post of each page: username, id, date, datetime, quotes, body, links, tweets. Posts of under LEAST_BODY characters without quotes, and those that are one URL, are left out."""
    d = blocks(pages, html, *keys).select(*keys, "place", F.regexp_extract("block", 'data-author="([^"]+)"', 1).alias("username"), post_id(F.col("block")).alias("id"), F.regexp_extract("block", r'<time[^>]+datetime="([^"]+)"', 1).alias("datetime"), quotes(F.col("block")).alias("quotes"), body(F.col("block")).alias("body"), links(F.col("block")).alias("l"))
    d = d.where((F.col("username") != "") & ((F.length("body") >= LEAST_BODY) | (F.size("quotes") > 0)) & ~F.col("body").rlike(r"^https?://\S+$"))
    return d.select(*keys, "place", "username", "id", F.substring("datetime", 1, 10).alias("date"), "datetime", "quotes", "body", "l.links", "l.tweets")


def when_posted(text: Column) -> Column:
    """A post's time as written, its offset taken off and not applied; null where no form fits."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), "Z+$", ""), "[+-][0-9]{2}:?[0-9]{2}$", ""))
    return F.coalesce(*(F.try_to_timestamp(bare, F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def in_range(posts: DataFrame, since: str, until: str) -> DataFrame:
    """Posts between two times; those whose time cannot be read stay."""
    at = when_posted(F.col("datetime"))
    return posts.where(at.isNull() | at.between(F.to_timestamp(F.lit(since)), F.to_timestamp(F.lit(until))))


def date_argument(text: Column) -> Column:
    """A date in one of the accepted forms, the first that fits; null where none does."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
