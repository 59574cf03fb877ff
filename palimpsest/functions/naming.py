"""Titles, authors, years and numbers from file names and embedded metadata."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Programs that write their own name into a metadata field, and titles, authors and placeholders that say nothing.
PROGRAMS = ("microsoft word", "adobe indesign", "adobe acrobat", "latex", "pdflatex", "xelatex", "lualatex", "tex", "pdftex", "xetex", "quarkxpress", "libreoffice", "openoffice", "google docs", "calibre", "prince", "wkhtmltopdf", "phantomjs", "chrome", "firefox", "acrobat distiller", "acrobat pdfmaker", "microsoft office word", "pages")
EMPTY_TITLES = ("untitled", "document", "microsoft word", "unnamed")
NOBODY = ("unknown", "unknown author")
PLACEHOLDERS = ("none", "null", "n/a", "na", "undefined", "nil")
UNTRUSTED = ("pdf995", "pdfcreator", "pdfsam")
#: Endings that the pipeline or a download site adds to a stem, in order.
ADDED = ("_visual_qa_report", "_visual_qa_report_LEGACY", "_visual_qa_report_HTML")
NOISE = (r"(?i)\s*-\s*libgen[.\s]?li\s*$", r"(?i)\s*--\s*Anna'?’?s?\s*Archive\s*$")
#: Forms of file names, in order; title and author are the groups that follow.
FORMS = (
    (r"(?i)^(.+?)\{(.+?)\}\(([0-9]{4}),?\s*([^)]*)\)\{[^}]*\}\s*libgen", 1, 2),
    (r"(?i)^(.+?)\{(.+?)\}\{[^}]*\}\s*libgen", 1, 2),
    (r"(?i)^(.+?)\s+--\s+(.+?)(\s+--\s+|$)", 1, 2),
    (r"(?i)^(.+?)\s+-\s+(.+?)(?:\s*[(\[]|$)", 2, 1),
    (r"(?i)^(.+?)_-_(.+?)(?:_[0-9]{4}_|_-_|$)", 2, 1),
)
UNDERSCORED = 4
CLEAN = (r"(?i)\s*-\s*libgen[.\s]?li\s*$", r"(?i)\s*[0-9a-f]{20,}\s*$", r"(?i)\s*Anna'?s?\s*Archive\s*$")
ISBN = r"(97[89]-?[0-9]-?[0-9]{2}-?[0-9]{4}-?[0-9]-?[0-9]|-?[0-9]{9}[0-9Xx])"
PUBLISHER = r"(?i)^.+?\s+--\s+.+?\s+--\s+(.+?)(?:\s+--\s+|$)"
YEAR_IN_PARENTHESES, BARE_YEAR = r"\((1[89][0-9]{2}|20[0-9]{2})(?:[,\s)]|$)", r"\b(1[89][0-9]{2}|20[0-9]{2})\b"


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def _group(text: Column, pattern: str, k: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, k))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def title_and_author(path: Column) -> Column:
    """Struct of title and author: "Author - Title (...)" where the stem has a bracket, else "Title - Author", else a title alone."""
    stem = stem_of(path)
    for end in ADDED:
        stem = F.when(stem.endswith(end), F.regexp_replace(stem, f"{end}$", "")).otherwise(stem)
    for noise in NOISE:
        stem = F.regexp_replace(stem, noise, "")
    stem = _trimmed(stem)
    series = _group(stem, r"^\(([^)]+)\)\s+(.+)$")
    stem = F.when(series.isNotNull() & ~F.coalesce(series, F.lit("")).rlike(r"^\s*[0-9]{4}\s*$"), F.regexp_extract(stem, r"^\(([^)]+)\)\s+(.+)$", 2)).otherwise(stem)
    bracket = r"^(.+?)\s+-\s+(.+?)\s*[(\[]"
    tidy = lambda x: _trimmed(F.regexp_replace(_trimmed(x), "-+$", ""))
    last = r"(?s)^(.*) - (.*?)$"
    cut = stem.rlike(last)
    return F.when(stem.rlike(bracket), F.struct(tidy(F.regexp_extract(stem, bracket, 2)).alias("title"), tidy(F.regexp_extract(stem, bracket, 1)).alias("author"))).otherwise(
        F.struct(F.when(cut, _trimmed(F.regexp_extract(stem, last, 1))).otherwise(stem).alias("title"), F.when(cut, _trimmed(F.regexp_extract(stem, last, 2))).alias("author"))
    )


def legacy_title_and_author(stem: Column) -> Column:
    """Struct of a report's stem read as "Title - Author"."""
    for end in ADDED:
        stem = F.when(stem.endswith(end), F.regexp_replace(stem, f"{end}$", "")).otherwise(stem)
    last = r"(?s)^(.*) - (.*?)$"
    cut = stem.rlike(last)
    return F.struct(F.when(cut, _trimmed(F.regexp_extract(stem, last, 1))).otherwise(_trimmed(stem)).alias("title"), F.when(cut, _trimmed(F.regexp_extract(stem, last, 2))).alias("author"))


def first_year(text: Column) -> Column:
    return _group(text, "(1[89][0-9]{2}|20[0-9]{2})")


def last_year(path: Column) -> Column:
    """The last year from 1900 on in a file's stem."""
    years = F.regexp_extract_all(stem_of(path), F.lit(r"\b(19[0-9]{2}|20[0-9]{2})\b"), F.lit(1))
    return F.get(years, F.size(years) - 1)


def clean_field(value: Column, field: str = "generic") -> Column:
    """A metadata value, or null where it says nothing; field: author, title, publisher or generic."""
    bare = _trimmed(value)
    nothing = {"author": NOBODY + PROGRAMS, "title": EMPTY_TITLES, "publisher": PROGRAMS}.get(field, ())
    return F.when((bare != "") & ~F.lower(bare).isin(*PLACEHOLDERS, *nothing), bare)


def suspicious(creator: Column, producer: Column, title: Column, file_author: Column) -> Column:
    """Embedded metadata not to be trusted: a known tool wrote it, or the title holds the author of the file name."""
    by = F.lit(False)
    for tool in UNTRUSTED:
        by = by | F.coalesce(F.contains(F.lower(creator), F.lit(tool)), F.lit(False)) | F.coalesce(F.contains(F.lower(producer), F.lit(tool)), F.lit(False))
    return by | F.coalesce((file_author != "") & F.contains(F.lower(title), F.lower(file_author)), F.lit(False))


def described(path: Column) -> Column:
    """Struct of title, authors, publisher, year, isbn and series of a file name in one of FORMS, "" where there is none."""
    stem = stem_of(path)
    title = author = None
    spaced = lambda x: _trimmed(F.replace(x, F.lit("_"), F.lit(" ")))
    for k, (pattern, t, a) in reversed(list(enumerate(FORMS))):
        tidy = spaced if k == UNDERSCORED else _trimmed
        hit = stem.rlike(pattern)
        title = F.when(hit, tidy(F.regexp_extract(stem, pattern, t))).otherwise(spaced(stem) if title is None else title)
        author = F.when(hit, tidy(F.regexp_extract(stem, pattern, a))).otherwise(F.lit("") if author is None else author)
    for k, noise in enumerate(CLEAN):
        title, author = F.regexp_replace(title, noise, ""), F.regexp_replace(author, noise, "")
        if k == 0:
            title, author = F.regexp_replace(title, r"\s+", " "), F.regexp_replace(author, r"\s+", " ")
    lead = _group(stem, r"^\(([^)]+)\)\s+")
    series = F.when(~_trimmed(lead).rlike("^[0-9]{4}$"), _trimmed(lead))
    prefix = F.concat(F.lit("("), series, F.lit(")"))
    author = F.when(series.isNotNull() & author.startswith(prefix), F.ltrim(F.substring(author, F.length(prefix) + 1, F.length(author)))).otherwise(author)
    bound, bare = (F.regexp_extract_all(stem, F.lit(p), F.lit(1)) for p in (YEAR_IN_PARENTHESES, BARE_YEAR))
    year = F.coalesce(F.get(bound, F.size(bound) - 1), F.get(bare, F.size(bare) - 1), F.lit(""))
    house = F.regexp_extract(stem, PUBLISHER, 1)
    for gone in (r"\b(?:1[89][0-9]{2}|20[0-9]{2})\b", r"\b[0-9]{10,13}\b", r"(?i)\b[0-9a-f]{20,}\b"):
        house = F.regexp_replace(house, gone, "")
    house = F.regexp_replace(F.regexp_replace(house, r"\s+", " "), "^[ ,;-]+|[ ,;-]+$", "")
    title = F.regexp_replace(F.regexp_replace(F.regexp_replace(title, r"(?i)([\p{L}\p{N}_])_\s+([A-Z])", "$1: $2"), "__+", ": "), r"\s{2,}", " ")
    author = F.regexp_replace(F.regexp_replace(author, r"(?i)^by\s+", ""), r"\s{2,}", " ")
    return F.struct(
        _trimmed(title).alias("title"), _trimmed(author).alias("authors"), F.when(F.length(house) > 2, house).otherwise("").alias("publisher"), year.alias("year"), F.replace(F.regexp_extract(stem, ISBN, 1), F.lit("-"), F.lit("")).alias("isbn"), F.coalesce(series, F.lit("")).alias("series")
    )


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))
