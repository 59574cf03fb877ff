"""Editing passes over a text: each gives a struct of the text and n, the number of places it changed."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import latest, merged, once
from .text import LINE_WHITE, WHITE, count_of, edited, fix_whitespace

_W = r"[\p{L}\p{N}_]"
#: Which straight quotes become which curly ones, in order.
QUOTES = (
    (rf'(?md)(^|[{WHITE}(])"(?={_W})', "$1“"),
    (rf'(?md)(?<=[\p{{L}}\p{{N}}_.,;:!?])"(?=[{WHITE}.,;:!?)]|$)', "”"),
    (rf'(?md)^"(?={_W})', "“"),
    (rf"(?<={_W})'(?={_W})", "’"),
    (rf"(?md)(^|[{WHITE}(])'(?={_W})", "$1‘"),
    (rf"(?md)(?<={_W})'(?=[{WHITE}.,;:!?]|$)", "’"),
)
#: Line breaks round headings in HTML.
HTML_HEADINGS = ((r"(?<!</p>)(<h[1-6][^>]*>)", "\n$1"), (rf"(</h[1-6]>)(?![{WHITE}]*<)", "$1\n"))
EMPTY_PARAGRAPHS = ((rf"<p>[{WHITE}]*</p>", ""),)
#: Lines in capitals that are headings.
HEADING = r"(?i)^(?:CHAPTER|PART|INTRODUCTION|CONCLUSION|APPENDIX|EPILOGUE|PROLOGUE|PREFACE|FOREWORD|AFTERWORD|ACKNOWLEDGMENT|BIBLIOGRAPHY|GLOSSARY|INDEX)" + rf"(?:[{WHITE}]+[IVXLCDM\p{{Nd}}]+)?(?:[{WHITE}]*[.:\-].*)?$"
#: Single marks that are litter on a line of their own.
LITTER = (")", "]", ",", ".", "-", "–", "—", "(", "[")
#: Masked swear words, in order.
MASKED = (
    (r"(?i)\bf\*{2,3}\b", "fuck"),
    (r"(?i)\bfu\*{2}\b", "fuck"),
    (r"(?i)\bfuc\*\b", "fuck"),
    (r"(?i)\bf\*\*king\b", "fucking"),
    (r"(?i)\bfu\*\*ing\b", "fucking"),
    (r"(?i)\bf\*\*\*ing\b", "fucking"),
    (r"(?i)\bs\*{2,3}\b", "shit"),
    (r"(?i)\bsh\*t\b", "shit"),
    (r"(?i)\ba\*{2}\b", "ass"),
    (r"(?i)\ba\*\*hole\b", "asshole"),
    (r"(?i)\bc\*{2,3}\b", "cunt"),
    (r"(?i)\bb\*{2,3}h\b", "bitch"),
    (r"(?i)\bd\*{2,2}\b", "damn"),
    (r"(?i)\bp\*{3,4}\b", "piss"),
    (r"(?i)\bc\*{2}k\b", "cock"),
    (r"(?i)\bd\*{3}k\b", "dick"),
    (r"(?i)\bb\*{6}\b", "bastard"),
    (r"(?i)\bm\*\*\*erf\*\*\*er\b", "motherfucker"),
    (r"(?i)\bwh\*{3}\b", "whore"),
    (r"(?i)\bcr\*p\b", "crap"),
)
#: Speech markup.
SPEECH_TAGS = rf'<voice[^>]*>|</voice>|<silence[{WHITE}]+msec="[0-9]+"[{WHITE}]*/?>|<rate[^>]*>|</rate>'


def _inked(x: Column, *ends: int) -> Column:
    """Whether these ends of a line are visible ASCII, as most are: then no pattern need look for white space there."""
    return reduce(and_, (F.substring(x, at, 1).between("!", "~") for at in ends))


def _strip(x: Column) -> Column:
    return F.when(_inked(x, 1, -1), x).otherwise(F.regexp_replace(x, f"^[{LINE_WHITE}]+|[{LINE_WHITE}]+$", ""))


def _rstrip(x: Column) -> Column:
    return F.when(_inked(x, -1), x).otherwise(F.regexp_replace(x, f"[{LINE_WHITE}]+$", ""))


def _rows(text: Column) -> Column:
    """Each line with its bare form."""
    return F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _strip(x).alias("bare")))


def _capitals(x: Column) -> Column:
    return x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}|\p{Lt}")


def fix_smart_quotes(text: Column) -> Column:
    """Texts without one of the marks need none of its rules."""

    def stage(mark: str) -> Callable[[Column], Column]:
        rules = tuple(r for r in QUOTES if mark in r[0])
        both = lambda v, r: F.struct(r["text"].alias("text"), (v["n"] + r["n"]).alias("n"))
        return lambda v: F.when(F.contains(v["text"], F.lit(mark)), once(edited(v["text"], rules), lambda r: both(v, r))).otherwise(F.struct(v["text"].alias("text"), v["n"].alias("n")))

    return once(once(F.struct(text.alias("text"), F.lit(0).cast("long").alias("n")), stage('"')), stage("'"))


def unmask(text: Column) -> Column:
    return edited(text, MASKED)


def fix_headings(text: Column, html: bool = False) -> Column:
    """Of a heading that a line repeats, every second line goes; # headings get blank lines round them; capitals between blank lines that name a chapter become ##."""
    if html:
        return edited(text, HTML_HEADINGS)

    def run(rows: Column) -> Column:
        twin = lambda x, i: (x["bare"] != "") & (x["bare"] == F.get(rows, i - 1)["bare"]) & (x["bare"].startswith("#") | _capitals(x["bare"]))
        starts = F.transform(rows, lambda x, i: F.when(F.coalesce(twin(x, i), F.lit(False)), F.lit(-1)).otherwise(i))
        return once(latest(starts), lambda first: once(F.transform(rows, lambda x, i: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), ((i - F.get(first, i)) % 2 == 1).alias("gone"))), place))

    def place(r: Column) -> Column:
        # The first of a pair is kept as it is; a heading without a twin gets its blank lines. What a line is, is told once and not at each use.
        paired = lambda i: F.coalesce(F.get(r, i + 1)["gone"], F.lit(False))
        told = F.transform(r, lambda x, i: once(paired(i), lambda two: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), x["gone"].alias("gone"), two.alias("paired"), (x["bare"].startswith("#") & ~two).alias("head"))))
        return once(told, spaced)

    def spaced(r: Column) -> Column:
        def around(i: Column) -> Column:
            """Whether the last line put out and the next are not blank."""
            before = F.get(r, i - 1)
            full_before = F.when(before["gone"], True).when(before["head"], False).otherwise(before["bare"] != "")
            return F.struct(F.coalesce(full_before, F.lit(False)).alias("before"), F.coalesce(F.get(r, i + 1)["bare"] != "", F.lit(False)).alias("after"))

        def put(x: Column, full: Column) -> Column:
            heading = ~x["paired"] & ~full["before"] & ~full["after"] & (F.length(x["bare"]) < 80) & _capitals(x["bare"]) & x["bare"].rlike(HEADING)
            out = lambda line, n: F.struct(line.alias("out"), n.cast("int").alias("n"))
            blank = lambda there: F.when(there, "\n").otherwise("")
            parted = out(F.concat(blank(full["before"]), x["line"], blank(full["after"])), full["before"].cast("int") + full["after"].cast("int"))
            return F.when(x["gone"], out(F.lit(None).cast("string"), F.lit(1))).when(x["head"], parted).when(heading, out(F.concat(F.lit("## "), x["bare"]), F.lit(1))).otherwise(out(x["line"], F.lit(0)))

        each = F.transform(r, lambda x, i: once(around(i), lambda full: put(x, full)))
        return once(each, lambda o: F.struct(F.array_join(F.transform(o, lambda x: x["out"]), "\n").alias("text"), F.aggregate(o, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))

    return once(_rows(text), run)


def fix_paragraphs(text: Column, html: bool = False) -> Column:
    """Lines that go on a sentence join the line before; in HTML empty paragraphs go."""
    if html:
        return edited(text, EMPTY_PARAGRAPHS)
    return once(merged(text), lambda m: F.struct(m["text"].alias("text"), m["n_merged"].alias("n")))


def fix_orphans(text: Column) -> Column:
    """Single marks beside a blank line go; fragments of under five characters that follow a full line join what is kept before them."""

    def kept(rows: Column) -> Column:
        full = lambda i: F.coalesce(F.get(rows, i)["bare"] != "", F.lit(False))
        seen = F.transform(rows, lambda x, i: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), (x["bare"].isin(*LITTER) & ~(full(i - 1) & full(i + 1))).alias("gone"), full(i - 1).alias("after_full")))
        return once(seen, lambda s: once(F.filter(s, lambda x: ~x["gone"]), lambda k: joined(k, F.size(s) - F.size(k))))

    def joined(k: Column, n_gone: Column) -> Column:
        joins = lambda x, i: F.coalesce((x["bare"] != "") & (F.length(x["bare"]) < 5) & (F.get(k, i - 1)["bare"] != "") & ~x["bare"].rlike(r"^(?:#|\p{Lu}|\p{Lt})") & x["after_full"], F.lit(False))
        flagged = F.transform(k, lambda x, i: F.struct(x["line"].alias("line"), x["bare"].alias("bare"), joins(x, i).alias("joins")))

        def put(f: Column) -> Column:
            def each(x: Column, i: Column) -> Column:
                line = F.when(F.coalesce(F.get(f, i + 1)["joins"], F.lit(False)), _rstrip(x["line"])).otherwise(x["line"])
                return F.when(x["joins"], F.concat(F.lit(" "), x["bare"])).when(i > 0, F.concat(F.lit("\n"), line)).otherwise(line)

            return F.struct(F.array_join(F.transform(f, each), "").alias("text"), (n_gone + F.size(F.filter(f, lambda x: x["joins"]))).cast("long").alias("n"))

        return once(flagged, put)

    return once(_rows(text), kept)


#: The passes in their order; the names are those of their counts.
PASSES = {"whitespace": lambda t, html: fix_whitespace(t), "smart_quotes": lambda t, html: F.struct(t.alias("text"), F.lit(0).cast("long").alias("n")) if html else fix_smart_quotes(t), "heading_formatting": fix_headings, "paragraph_spacing": fix_paragraphs, "orphan_fragments": lambda t, html: fix_orphans(t)}


def apply_fixes(text: Column, chosen: tuple[str, ...] = tuple(PASSES), html: bool = False) -> Column:
    """Struct of text and counts (a map by pass) after the chosen passes, in their fixed order."""

    def stage(name: str) -> Callable[[Column], Column]:
        return lambda v: once(PASSES[name](v["text"], html), lambda r: F.struct(r["text"].alias("text"), F.map_concat(v["counts"], F.create_map(F.lit(name), r["n"])).alias("counts")))

    value = F.struct(text.alias("text"), F.create_map().cast("map<string,bigint>").alias("counts"))
    for name in PASSES:
        if name in chosen:
            value = once(value, stage(name))
    return value


def replaced(text: Column, table: dict[str, str]) -> Column:
    """Literal replacements of a table, longest first, each of the whole text; a struct as the passes give."""

    def stage(old: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(F.replace(v["text"], F.lit(old), F.lit(table[old])).alias("text"), (v["n"] + count_of(v["text"], old)).alias("n"))

    value = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    for old in sorted(table, key=lambda k: (-len(k), k)):
        value = once(value, stage(old))
    return value


#: UTF-8 that was read as Windows-1252, and what it stood for.
MOJIBAKE = {"â€™": "’", "â€˜": "‘", "â€œ": "“", "â€“": "–", "â€”": "—", "Ã©": "é", "Ã¨": "è", "Ã¶": "ö", "Ã¼": "ü", "Ã±": "ñ", "Â ": " "}
CONTROLS = "".join(map(chr, [*range(9), 11, 12, *range(14, 32), 127]))


def normalize_encoding(text: Column, table: dict[str, str] = MOJIBAKE) -> Column:
    """Struct of text, mojibake_fixed, control_chars_removed and replacements (their sum)."""

    def bare(r: Column) -> Column:
        clean = F.translate(r["text"], CONTROLS, "")
        return once(clean, lambda c: F.struct(c.alias("text"), r["n"].alias("mojibake_fixed"), (F.length(r["text"]) - F.length(c)).cast("long").alias("control_chars_removed"), (r["n"] + F.length(r["text"]) - F.length(c)).cast("long").alias("replacements")))

    return once(replaced(text, table), bare)


def pronounced(text: Column, words: dict[str, str]) -> Column:
    """Words that a dictionary holds, case and all, give way to how they are spoken."""
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv))
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def strip_speech_tags(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?i){SPEECH_TAGS}", " "), f"^[{WHITE}]+|[{WHITE}]+$", "")


def book_stem(stem: Column) -> Column:
    """A file stem for matching: lower case, the author behind the last " - " cut if it looks like one, other marks as one space."""
    low = F.lower(stem)
    suffix = F.regexp_extract(low, r"(?s)^.+ - (.*?)$", 1)
    named = low.rlike("(?s)^.+ - ") & F.length(suffix).between(2, 40) & suffix.rlike(rf"^[\p{{L}}\p{{N}}_{WHITE},.\-]+$")
    cut = F.when(named, F.regexp_extract(low, r"(?s)^(.+) - .*?$", 1)).otherwise(low)
    return F.trim(F.regexp_replace(cut, r"[^\p{L}\p{N}_]+", " "))


def page_debris(text: Column) -> Column:
    """A paragraph of digits, spaced or not, goes; three digits or more before "Chapter" go."""
    digits = F.regexp_replace(F.regexp_extract(text, r"^((?:[0-9] ?)+)(?=Chapter\b)", 1), " ", "")
    return F.when(text.rlike(rf"^[{WHITE}]*[0-9](?:[ ]?[0-9])*[{WHITE}]*$"), "").when(F.length(digits) >= 3, F.regexp_replace(text, r"^(?:[0-9] ?)+(?=Chapter\b)", "")).otherwise(text)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', ""), f"[{WHITE}]+", " "), "^ | $", "")


def strip_fences(text: Column) -> Column:
    """A fenced answer without its fences."""
    bare = F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")
    return F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"^```[\p{L}\p{N}_]*\n?", ""), rf"\n?```[{WHITE}]*$", "")).otherwise(bare)


def mail_subject(title: Column, path: Column, convert: Column, part: Column, parts: Column) -> Column:
    head = F.when(convert & ~F.lower(path).endswith(".pdf"), F.concat(F.lit("Convert: "), title)).otherwise(title)
    return F.when((part > 0) & (parts > 0), F.concat(head, F.lit(" (Part "), part, F.lit(" of "), parts, F.lit(")"))).otherwise(head)


def _packed(text: str, marks: str, most: int) -> list[str]:
    """What ends with one of the marks before white space, packed in order into pieces of up to `most` words; what is longer stays alone."""
    out, held = [], 0
    for unit in filter(None, map(str.strip, re.split(rf"(?<=[{marks}])\s+", text))):
        n = len(unit.split())
        if not out or held + n > most:
            out.append([])
            held = 0
        out[-1].append(unit)
        held += n
    return [" ".join(units) for units in out]


def chunked_text(text: str, most: int) -> list[str]:
    """Python's white space is the class WHITE."""
    out = []
    for piece in _packed(text, ".!?", most):
        for part in [piece] if len(piece.split()) <= most else _packed(piece, ";,:", most):
            words = part.split()
            out += [part] if len(words) <= most else [" ".join(words[k : k + most]) for k in range(0, len(words), most)]
    return out


def chunks(text: Column, most: int = 100) -> Column:
    """Pieces of up to `most` words: sentences packed as they fit, clauses of longer sentences, words of longer clauses. A step from sentence to sentence, so it runs in Arrow batches."""

    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else chunked_text(t, most) for t in texts], dtype=object)

    return F.pandas_udf(each, "array<string>")(text)


#: Headings of an index, what its entries look like, and the first words of scripture references.
INDEX_HEADING = r"(?i)index|scripture|biblical|references|sources|concordance"
VERSE = r"[0-9]{1,3}[.:][0-9]{1,3}(?:\s*[-–—]\s*[0-9]{1,3})?"
ENTRY = r"^[A-Z][a-zA-Z\s'-]{2,},\s*[0-9]"
FRAGMENT = r"^[0-9.\-–—,\s]{1,8}$"


class IndexMender:
    """Puts the pieces of a broken index together, one paragraph after another; the last piece that is not empty takes what belongs to it."""

    def __init__(self, books: tuple[str, ...]):
        self.heading, self.verse, self.entry, self.fragment = (re.compile(p) for p in (INDEX_HEADING, VERSE, ENTRY, FRAGMENT))
        self.books = books

    def dense(self, sample: list[str]) -> bool:
        """Whether paragraphs look like an index: shares of references, known books, entries and bare numbers."""
        there = [x for x in sample if x]
        n = max(1, len(there))
        share = lambda test: sum(bool(test(x)) for x in there)
        verses, entries, bits = share(self.verse.search), share(self.entry.match), share(self.fragment.match)
        books = share(lambda x: " ".join(x.lower().split()[:3]).startswith(self.books)) if self.books else 0
        return bool(sample) and (verses >= 0.3 * n or books >= 0.2 * n or entries >= 0.2 * n or (entries >= 1 and bits >= 0.2 * n))

    def joints(self, texts: list[str]) -> Iterator[tuple[int, int, str]]:
        """(parent, piece, what the parent gets) for bare paragraphs in order; texts changes with it."""
        start = next((k + 1 for k in range(int(len(texts) * 0.4), len(texts) - 1) if self.heading.search(texts[k]) and self.dense(texts[k + 1 : k + 16])), len(texts))
        held = None  # the last paragraph of the index that is not empty
        for k in range(start, len(texts)):
            bare, before = texts[k], texts[held] if held is not None else ""
            if not bare:
                continue
            joint = None
            if before and before[-1] in "-–—" and held == k - 1:
                joint = ""
            elif before and self.fragment.match(bare):
                joint = "" if before[-1] in "-–—" else " "
            elif before and bare[0].isdigit() and len(bare) < 40 and (before[-1] == "," or self.verse.search(before)):
                joint = " "
            if joint is None:
                held = k
                continue
            texts[held], texts[k] = before + joint + bare, ""
            yield held, k, joint + bare

    def mend(self, text: str | None) -> tuple[str | None, int]:
        """The text, and how many pieces found their place: paragraphs of a page are its <p> elements, of plain text what blank lines part."""
        if text is None:
            return None, 0
        return self.mend_html(text) if "<p>" in text or "<p " in text else self.mend_text(text)

    def mend_text(self, text: str) -> tuple[str, int]:
        parts, n = text.split("\n\n"), 0
        for held, k, more in self.joints([x.strip() for x in parts]):
            parts[held], parts[k] = parts[held].rstrip() + more, ""
            n += 1
        return (re.sub(r"(\n\n){2,}", "\n\n", "\n\n".join(parts)), n) if n else (text, 0)

    def mend_html(self, text: str) -> tuple[str, int]:
        parts, n = re.split(r"(?s)(<p[^>]*>.*?</p>)", text), 0
        at = [k for k, x in enumerate(parts) if re.match("<p[^>]*>", x)]
        for held, k, more in self.joints([re.sub("<[^>]+>", "", parts[k]).strip() for k in at]):
            if parts[at[held]].endswith("</p>"):
                parts[at[held]] = f"{parts[at[held]][:-4]}{more}</p>"
            parts[at[k]] = ""
            n += 1
        return "".join(parts), n


def fix_index(docs: DataFrame, books: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text and n after index fragments have found their place, and the other columns; a step from paragraph to paragraph, so it runs in Arrow batches."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mender = IndexMender(books)
        for p in parts:
            got = [mender.mend(t) for t in p["text"]]
            yield p.assign(text=[g[0] for g in got], n=[g[1] for g in got])

    return docs.mapInPandas(each, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, n long")


def fix_reported(text: Column, issues: Column, most: int = 50) -> Column:
    """Fixes that a report's issues (category, description) ask for, one issue after another: headings that lost their marks, sentences cut by lines, anchors of notes; an issue of blanks before marks counts as mended."""

    def headed(v: Column) -> Column:
        lost = lambda x: (x["bare"] != "") & ~x["bare"].startswith("#") & (F.length(x["bare"]) < 80) & _capitals(x["bare"]) & x["bare"].rlike(HEADING)
        return once(_rows(v["text"]), lambda r: F.struct(F.array_join(F.transform(r, lambda x: F.when(lost(x), F.concat(F.lit("## "), x["bare"])).otherwise(x["line"])), "\n").alias("text"), (v["n"] + F.size(F.filter(r, lost))).alias("n")))

    def joined(v: Column) -> Column:
        return once(merged(v["text"]), lambda m: F.struct(m["text"].alias("text"), (v["n"] + m["n_merged"]).alias("n")))

    def anchored(v: Column) -> Column:
        """Anchors for up to `most` notes that have none, before the first place where the spelling stands in which each is met first, not counting ids."""
        note = F.lit(r"""(?i)(?<!\bid=["'])(\bnote\s*([0-9]+))""")
        spelt, numbers = (F.regexp_extract_all(v["text"], note, F.lit(k)) for k in (1, 2))
        anchor = lambda k: F.concat(F.lit('<a id="note'), k, F.lit('"></a>'))

        def put(t: Column, x: Column) -> Column:
            at = F.instr(t, x["spelt"])
            return F.concat(F.substr(t, F.lit(1), at - 1), anchor(x["k"]), F.substr(t, at))

        def fresh(every: Column) -> Column:
            named = F.transform(every, lambda x: x["k"])
            return once(named, lambda ks: F.slice(F.filter(every, lambda x, i: (F.array_position(ks, x["k"]) == i + 1) & ~F.contains(v["text"], anchor(x["k"]))), 1, most))

        notes = F.zip_with(spelt, numbers, lambda a, k: F.struct(a.alias("spelt"), k.alias("k")))
        return once(once(notes, fresh), lambda f: F.struct(F.aggregate(f, v["text"], put).alias("text"), (v["n"] + F.size(f)).alias("n")))

    def step(v: Column, i: Column) -> Column:
        says = F.lower(F.coalesce(i["description"], F.lit("")))
        asks = lambda category, *words: (i["category"] == category) & says.rlike("|".join(words))
        spaced = (i["category"] == "text_integrity") & F.contains(says, F.lit("space")) & F.contains(says, F.lit("punctuation"))
        v = F.struct(v["text"].alias("text"), (v["n"] + F.when(F.coalesce(spaced, F.lit(False)), 1).otherwise(0)).alias("n"))
        for wanted, stage in ((asks("heading_formatting", "unstyled", "missing"), headed), (asks("paragraph_flow", "split", "break"), joined), (asks("toc_navigation", "anchor"), anchored)):
            v = once(v, _if(wanted, stage))
        return v

    begin = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.coalesce(issues, F.array().cast("array<struct<category: string, description: string>>")), begin, step)


def fix_documents(docs: DataFrame, chosen: tuple[str, ...] = (*PASSES, "index_fragments", "vqa_targeted"), books: tuple[str, ...] = (), dry_run: bool = False) -> DataFrame:
    """All passes in their fixed order over docs (doc_id, text, is_html and issues, which may be null): doc_id, text, counts (passes that changed something), total, modified.

    A dry run counts what would change and gives the text as it was. Passes that are not known are left out; quotes are not touched in pages.
    """
    column_passes = tuple(p for p in PASSES if p in chosen)
    both = lambda html: apply_fixes(F.col("text"), column_passes, html)
    d = docs.select("doc_id", F.col("text").alias("before"), "is_html", "issues", F.when(F.coalesce("is_html", F.lit(False)), both(True)).otherwise(both(False)).alias("f"))
    d = d.select("doc_id", "before", "issues", F.col("f.text").alias("text"), F.col("f.counts").alias("counts"))
    plus = lambda name, n: F.map_concat("counts", F.create_map(F.lit(name), n.cast("long")))
    if "index_fragments" in chosen:
        d = fix_index(d, books).withColumn("counts", plus("index_fragments", F.col("n"))).drop("n")
    if "vqa_targeted" in chosen:
        d = d.withColumn("f", fix_reported(F.col("text"), F.col("issues"))).withColumn("text", F.when(F.col("text").isNotNull(), F.col("f.text"))).withColumn("counts", plus("vqa_targeted", F.coalesce("f.n", F.lit(0)))).drop("f")
    counts = F.map_filter("counts", lambda _, n: n > 0)
    d = d.select("doc_id", "before", "text", counts.alias("counts"))
    total = F.aggregate(F.map_values("counts"), F.lit(0).cast("long"), lambda a, n: a + n).alias("total")
    changed = ~F.col("text").eqNullSafe(F.col("before"))
    return d.select("doc_id", F.col("before" if dry_run else "text").alias("text"), "counts", total, (F.lit(not dry_run) & changed).alias("modified"))


def _if(wanted: Column, stage: Callable[[Column], Column]) -> Callable[[Column], Column]:
    same = lambda v: F.struct(v["text"].alias("text"), v["n"].alias("n"))
    return lambda v: F.when(F.coalesce(wanted, F.lit(False)), stage(v)).otherwise(same(v))
