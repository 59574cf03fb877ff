"""Column expressions over text."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lines import once

#: Letters torn apart where a ligature stood.
LIGATURES = r"[Tt](?<=\b[Tt])h (?:e|is|at|ey|en|ere|ose|us|an|eir|em|ese)\b|f(?<=\bf)(?:i|l|fi|fl) [a-z]"
#: White space in the Unicode sense, as character classes without their brackets; LINE_WHITE is without the newline, NEAR_WHITE without what lies beyond Latin-1.
NEAR_WHITE, FAR_WHITE = r" \t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}", r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_WHITE = NEAR_WHITE + FAR_WHITE
WHITE = r"\n" + LINE_WHITE
#: Stop words of title keys.
TITLE_STOPS = ("the", "a", "an", "and", "or", "of", "in", "on", "at", "to", "for", "by", "with", "from", "is", "was", "are")


def count_of(text: Column, literal: str) -> Column:
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(literal)))) / len(literal))


def _by_white(text: Column, of: Callable[[str], Column]) -> Column:
    """of the class of white space that the text needs: the one without far characters is matched much faster, and one range tells most texts that need no other."""
    return F.when(text.rlike(r"[\x{1680}-\x{3000}]"), of(LINE_WHITE)).otherwise(of(NEAR_WHITE))


def word_count(text: Column) -> Column:
    """Words between white space: the parts that it cuts a text into, without the empty ones at its ends."""

    def parts(white: str) -> Column:
        empty = lambda c: F.when(c.rlike(rf"[\n{white}]"), 1).otherwise(0)
        return F.size(F.split(text, rf"[\n{white}]+", -1)) - empty(F.substring(text, 1, 1)) - empty(F.substring(text, -1, 1))

    return F.when(F.length(text) > 0, _by_white(text, parts)).when(text.isNotNull(), 0)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


#: Where LIGATURES may match, found by the blank in it; every match of theirs holds one of these.
MAYBE_LIGATURE = r" (?:(?<=\b[Tt]h )(?:e|is|at|ey|en|ere|ose|us|an|eir|em|ese)\b|(?<=\bf(?:i|l|fi|fl) )[a-z])"
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def penalties(text: Column) -> dict[str, Column]:
    """Counts from which the segment score is made."""
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return {"n_replaced": count_of(text, "�"), "n_ligatures": F.when(text.rlike(MAYBE_LIGATURE), count(LIGATURES)).when(text.isNotNull(), 0).cast("long"), "n_doubles": count_of(text, "  "), "n_controls": count(CONTROLS), "n_words": word_count(text).cast("long")}


def segment_score(replaced: Column, ligatures: Column, doubles: Column, controls: Column, chars: Column) -> Column:
    """100 less bounded penalties for each thousand characters, rounded half to even; 0 for empty text."""
    k = 1000.0 / chars
    rate = lambda n, weight, most: F.least(F.lit(float(most)), n * k * weight)
    return F.when(chars > 0, F.greatest(F.lit(0.0), F.bround(100.0 - rate(replaced, 5.0, 40) - rate(ligatures, 2.0, 20) - rate(doubles, 1.0, 10) - rate(controls, 3.0, 10)))).otherwise(0.0).cast("long")


#: What whitespace editing replaces, and by what. Order matters: tabs become spaces after runs of spaces have gone.
WHITESPACE = ((" {3,}", " "), (" ++([.,;:!?])", "$1"), ("\n{4,}", "\n\n\n"), ("(?d)[{white}]++(?=\n|\\z)", ""), ("\t", " "))


def edited(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Struct of the text after all replacements in order, and n, how many places they changed. Each stage is computed once."""

    def stage(pattern: str, to: str) -> Callable[[Column], Column]:
        if len(pattern) == 1:  # a literal that takes another's place: no pattern is needed
            return lambda v: F.struct(F.replace(v["text"], F.lit(pattern), F.lit(to)).alias("text"), (v["n"] + count_of(v["text"], pattern)).alias("n"))
        # Most stages find nothing in most texts; then the count alone has looked.
        changed = lambda v, n: F.when(n > 0, F.struct(F.regexp_replace(v["text"], pattern, to).alias("text"), (v["n"] + n).alias("n"))).otherwise(F.struct(v["text"].alias("text"), v["n"].alias("n")))
        return lambda v: once(F.regexp_count(v["text"], F.lit(pattern)), lambda n: changed(v, n))

    value = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    for pattern, to in rules:
        value = once(value, stage(pattern, to))
    return value


def fix_whitespace(text: Column) -> Column:
    return _by_white(text, lambda white: edited(text, tuple((p.replace("{white}", white), to) for p, to in WHITESPACE)))


def clean_html(html: Column) -> Column:
    """Text of a page: scripts and styles go, tags become spaces, six entities are decoded, numeric ones go, white space collapses."""
    for tag in ("script", "style"):
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    html = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, to in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&nbsp;", " ")):
        html = F.replace(html, F.lit(entity), F.lit(to))
    return F.trim(once(F.regexp_replace(html, "&#[0-9]+;", ""), lambda t: _by_white(t, lambda white: F.regexp_replace(t, rf"[\n{white}]+", " "))))


def redact_addresses(text: Column) -> Column:
    return F.regexp_replace(text, "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "[redacted]")


def normal_heading(text: Column) -> Column:
    """Tags out, white space collapsed, a trailing page number of one to three digits dropped, lower case."""
    text = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), "[ \t\n\r\f\x0b]+", " ")
    return F.lower(F.trim(F.regexp_replace(F.trim(text), " *[0-9]{1,3}$", "")))


def _plain_words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(text, rf"[^\p{{L}}\p{{N}}_{WHITE}]", " "), f"[{WHITE}]+"), "")


def title_key(title: Column, author: Column | None = None) -> Column:
    """Key of a title: the subtitle after a colon or long dash cut, punctuation as spaces, stop words dropped, order kept, the author's last name behind. Null without words."""
    words = F.filter(_plain_words(F.lower(F.split(title, "[:—]", 2)[0])), lambda w: ~w.isin(*TITLE_STOPS))
    if author is not None:
        parts = F.filter(_plain_words(author), lambda w: F.length(w) > 1)
        last = F.when(F.contains(author, F.lit(",")), F.get(parts, F.lit(0))).otherwise(F.get(parts, F.size(parts) - 1))
        words = F.concat(words, F.array_compact(F.array(F.lower(last))))
    return F.when(F.size(words) > 0, F.array_join(words, " "))


def valid_isbn(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "^ *isbn[: ]*", ""), "[- ]", "")
    return F.coalesce(bare.rlike("^(97[89])?[0-9]{9}[0-9x]$"), F.lit(False))


def host_of(url: Column) -> Column:
    """Host of a URL, its port with it, in lower case; leading w's and dots go, whatever they belong to."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, "https?://([^/]+)", 1)), "^[w.]+", "")


#: Endings of media files, and hosts whose pages are not fetched.
MEDIA = r"\.(?:jpg|jpeg|png|gif|webp|svg|mp4|webm|mov|avi|mp3|pdf|bmp|ico|tiff)$"
SKIPPED_HOSTS = (
    "twitter.com", "x.com", "facebook.com", "instagram.com", "reddit.com", "youtube.com", "youtu.be", "tiktok.com",
    "discord.com", "discord.gg", "twitch.tv", "imgur.com", "giphy.com", "gfycat.com", "tenor.com", "i.ytimg.com",
    "cdn.drawception.com", "pbs.twimg.com", "schema.org", "xenforo.com", "dragonbyte-tech.com", "firesofheaven.org",
)


def fetchable(url: Column, skipped: tuple[str, ...] = SKIPPED_HOSTS) -> Column:
    """A link worth fetching: long enough, no media file, no footer campaign, host and its parents not skipped."""
    hosts = F.array(*map(F.lit, skipped))
    listed = lambda h: F.when(h == "", True).otherwise(F.exists(hosts, lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s))))
    footer = F.contains(url, F.lit("utm_medium=footer")) | F.contains(url, F.lit("utm_content=footer"))
    return F.coalesce((F.length(url) >= 12) & url.startswith("http") & ~F.lower(F.split(url, r"\?", 2)[0]).rlike(MEDIA) & ~footer & ~once(host_of(url), listed), F.lit(False))


def is_tweet(url: Column) -> Column:
    return F.coalesce(host_of(url).isin("twitter.com", "x.com") & url.rlike("/status/[0-9]+"), F.lit(False))


TAGS = {"h1_count": ("h1",), "h2_count": ("h2",), "h3_count": ("h3",), "paragraphs": ("p",), "list_items": ("li",), "em_tags": ("em", "i"), "bold_tags": ("b", "strong"), "blockquotes": ("blockquote",)}


def structure(html: Column) -> Column:
    """Struct of the structural counts of a page's HTML: names of tags are found in one scan and counted in a small array."""
    count = lambda p: F.regexp_count(html, F.lit(p)).cast("long")
    names = F.transform(F.regexp_extract_all(html, F.lit("(?i)<(h[123]|p|li|em|i|b|strong|blockquote)[ >]"), F.lit(1)), lambda t: F.lower(t))

    def of(found: Column, tags: tuple[str, ...]) -> Column:
        return F.size(F.filter(found, lambda x: x.isin(*tags))).cast("long")

    others = {"page_numbers": count("(?i)<p[^>]*>[0-9]{1,3}</p>"), "links": count("(?i)<a [^>]*href"), "double_spaces": count("  +")}
    return once(names, lambda found: F.struct(*(of(found, tags).alias(n) for n, tags in TAGS.items()), *(c.alias(n) for n, c in others.items())))
