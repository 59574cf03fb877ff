"""Line editing inside one row: arrays of lines and higher-order functions, so nothing is shuffled."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = "[ \t\r\f\x0b]"


def bare(line: Column) -> Column:
    return F.regexp_replace(line, f"^{BLANK}+|{BLANK}+$", "")


def _continues(lines: Column, line: Column, at: Column) -> Column:
    before = bare(F.get(lines, at - 1))
    return F.coalesce(bare(line).rlike("^\\p{Ll}") & before.rlike("^[^#]") & ~before.rlike("[.!?:;\"”]$"), F.lit(False))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once a row and not once for each element of the lambdas inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merged(text: Column) -> Column:
    """Struct of the text with lines that go on a sentence joined to the line before, and n_merged; the text is null if it was."""
    flagged = lambda lines: F.transform(lines, lambda x, i: F.struct(x.alias("line"), _continues(lines, x, i).alias("joins")))

    def join(f: Column) -> Column:
        def each(s: Column, i: Column) -> Column:
            line = F.when(F.coalesce(F.get(f, i + 1)["joins"], F.lit(False)), F.regexp_replace(s["line"], f"{BLANK}+$", "")).otherwise(s["line"])
            return F.when(s["joins"], F.concat(F.lit(" "), bare(s["line"]))).when(i > 0, F.concat(F.lit("\n"), line)).otherwise(line)

        return F.struct(F.array_join(F.transform(f, each), "").alias("text"), F.size(F.filter(f, lambda s: s["joins"])).cast("long").alias("n_merged"))

    return once(F.split(text, "\n"), lambda lines: once(flagged(lines), join))


#: Common words by which readable text is told from garbled text.
COMMON = (
    "the", "and", "for", "that", "this", "with", "from", "have", "was", "are", "but", "not",
    "you", "all", "can", "had", "her", "one", "our", "out", "his", "has", "been", "were",
    "they", "will", "when", "who", "said", "each", "which", "their", "time", "very", "than", "other",
    "about", "into", "some", "could", "them", "would", "make", "like", "just", "over",
)


def common_share(text: Column, first: int = 200, least: int = 50) -> Column:
    """Share of common words among the first words of 3 to 15 characters; null under `least` of them."""
    words = F.filter(F.split(F.lower(text), "[ \t\n\r\f\x0b]+"), lambda w: F.length(w).between(3, 15))
    return once(words, lambda w: F.when(F.size(w) >= least, F.size(F.filter(F.slice(w, 1, first), lambda x: x.isin(*COMMON))) / F.least(F.size(w), F.lit(first))))


def latest(marks: Column) -> Column:
    """For each place the greatest value so far (itself included) of an array of int; blocks of about the square root of its size keep it near linear."""

    def scan(some: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(some, begin, lambda a, x: F.struct(F.greatest(a["at"], x).alias("at"), F.concat(a["out"], F.array(F.greatest(a["at"], x))).alias("out")), lambda a: a["out"])

    def over(marks: Column, size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(marks) - 1) / size).cast("int")), lambda k: F.slice(marks, k * size + 1, size))

        def joined(b: Column) -> Column:
            tops = scan(F.transform(b, lambda some: F.array_max(some)), F.lit(-1))
            return F.flatten(once(tops, lambda t: F.transform(b, lambda some, i: scan(some, F.coalesce(F.get(t, i - 1), F.lit(-1))))))

        return once(blocks, joined)

    # marks may be a long expression: it is computed once and not for each block
    return once(marks, lambda m: F.when(F.size(m) > 0, once(F.ceil(F.sqrt(F.size(m))).cast("int"), lambda size: over(m, size))).otherwise(F.array().cast("array<int>")))
