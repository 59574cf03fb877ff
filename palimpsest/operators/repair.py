"""Repairs of scanned text against the corpus's own vocabulary: spaced letters, words cut at line ends, letters taken for others.

Words and how often they occur are counted over all texts; what may be wrong is collected from all texts once each, held against the vocabulary by joins, and the table of corrections is joined back to the documents that need them. No list of
words is built in. Nothing but a document's own corrections meets in one row.

Null texts stay null, empty ones empty. Repeated rows are repaired each. Of corrections equally common the first by name counts. Other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is known from so many occurrences; a correction must be so many times as common; the longest word looked for among spaced letters.
LEAST, RATIO, LONGEST = 5, 20, 24
#: What scanners take for each other.
CONFUSED = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("li", "h"), ("ii", "u"), ("0", "o"), ("1", "l"))
RUN = r"(?<![\p{L}\p{N}])\p{L}(?: \p{L}){3,}(?: ['’] \p{L})?(?![\p{L}\p{N}])"
BRACKETS = r"\[(?: [\p{L}\p{N}])+ \]"
CUT = r"(\p{L}{2,})-\n(\p{Ll}+)"
WORD = r"[\p{L}01]+"


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group))


def vocabulary(docs: DataFrame, pattern: str = WORD) -> DataFrame:
    """word (lower case) and n over all texts; summed before the shuffle."""
    return docs.select(F.explode(_all(F.lower("text"), pattern)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _bare(run: Column) -> Column:
    """A run's letters without blanks; a small l among capitals is an I."""
    s = F.replace(run, F.lit(" "), F.lit(""))
    capitals = F.replace(s, F.lit("l"), F.lit(""))
    return F.when(s.contains("l") & (F.length(capitals) >= 3) & (capitals == F.upper(capitals)), F.replace(s, F.lit("l"), F.lit("I"))).otherwise(s)


def cut_words(text: str, found: list[tuple[int, int, int]], total: int) -> str | None:
    """text cut into known words, the most probable way; null if no way is whole. found: (place from 0, length, count)."""
    best: list[tuple[float, int] | None] = [(0.0, 0)] + [None] * len(text)
    for at, size, n in sorted(found):
        if best[at] is not None:
            score = best[at][0] + math.log(n / total)
            if best[at + size] is None or score > best[at + size][0]:
                best[at + size] = (score, at)
    if best[-1] is None:
        return None
    out, end = [], len(text)
    while end:
        out.append(text[best[end][1] : end])
        end = best[end][1]
    return " ".join(reversed(out))


def spaced_words(docs: DataFrame, known: DataFrame) -> DataFrame:
    """run, fix: each run of spaced letters that known words make up, as those words; runs in capitals that they do not make up as one word. Runs of under three different letters stay."""
    runs = docs.select(F.explode(F.array_distinct(_all(F.col("text"), RUN))).alias("run")).distinct()
    runs = runs.withColumn("letters", _bare(F.regexp_replace("run", r" ?['’] ?\p{L}$", ""))).where(F.size(F.array_distinct(F.split(F.lower("letters"), ""))) >= 3)
    places = F.sequence(F.lit(0), F.length("letters") - 1)
    parts = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("letters") - i)), lambda k: F.struct(i.alias("at"), k.alias("size"), F.substr(F.lower("letters"), i + 1, k).alias("word")))))
    met = runs.select("run", F.explode(parts).alias("p")).select("run", "p.*").where((F.col("size") > 1) | F.col("word").isin("a", "i"))
    met = met.join(known, "word").groupBy("run").agg(F.sort_array(F.collect_list(F.struct("at", "size", "n"))).alias("found"))
    total = known.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))  # a row beside each run: no pass over the texts of its own

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[(x["at"], x["size"], x["n"]) for x in f] if f is not None else [] for f in b["found"]]
            yield pd.DataFrame({"run": b["run"], "letters": b["letters"], "words": [cut_words(t, f, n) for t, f, n in zip(b["letters"], found, b["total"], strict=True)]})

    d = runs.join(met, "run", "left").crossJoin(F.broadcast(total)).select("run", "letters", "found", "total").mapInPandas(each, "run string, letters string, words string")
    made = F.coalesce("words", F.when(F.col("letters") == F.upper("letters"), F.col("letters")))
    tail = F.replace(F.regexp_extract("run", r" ?['’] ?\p{L}$", 0), F.lit(" "), F.lit(""))
    return d.where(made.isNotNull()).select("run", F.concat(made, tail).alias("fix"))


def cut_lines(docs: DataFrame, known: DataFrame) -> DataFrame:
    """cut, fix: words cut at the ends of lines, joined if the whole is known and at least as common as the same with a hyphen, with the hyphen if that is the more common."""
    cuts = docs.where(F.col("text").contains("-\n")).select(F.explode(_all(F.col("text"), CUT)).alias("x")).distinct().select(F.split("x", "-\n").alias("x")).select(F.get("x", 0).alias("a"), F.get("x", 1).alias("b"))
    hyphened = vocabulary(docs.where(F.col("text").contains("-")), r"(?<!\p{L})\p{L}+-\p{L}+(?!\p{L})").select(F.col("word").alias("two"), F.col("n").alias("n_two"))
    d = cuts.withColumns({"word": F.lower(F.concat("a", "b")), "two": F.lower(F.concat_ws("-", "a", "b"))}).join(known, "word", "left").join(hyphened, "two", "left")
    one, two = F.coalesce("n", F.lit(0)), F.coalesce("n_two", F.lit(0))
    fix = F.when((one >= LEAST) & (one >= two), F.concat("a", "b")).when(two >= LEAST, F.concat_ws("-", "a", "b"))
    return d.select(F.concat("a", F.lit("-\n"), "b").alias("cut"), fix.alias("fix")).where("fix IS NOT NULL")


def taken_for(words: DataFrame) -> DataFrame:
    """word, fix: rare words that one confusion away from a word RATIO times as common. words: word, n of all words."""
    def swapped(old: str, new: str) -> Column:
        places = F.filter(F.sequence(F.lit(1), F.length("word") - len(old) + 1), lambda i: F.substr("word", i, F.lit(len(old))) == old)
        made = F.transform(places, lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.lit(new), F.substr("word", i + len(old))))
        return F.when(F.length("word") >= len(old), made).otherwise(F.array().cast("array<string>"))

    rare = words.where((F.col("n") < LEAST) & (F.length("word") > 2)).select("word", "n", F.explode(F.flatten(F.array(*(swapped(a, b) for a, b in CONFUSED)))).alias("fix")).distinct()
    good = words.where(F.col("n") >= LEAST).select(F.col("word").alias("fix"), F.col("n").alias("m"))
    d = rare.join(good, "fix").where(F.col("m") >= RATIO * F.col("n"))
    return d.groupBy("word").agg(F.min(F.struct((-F.col("m")).alias("m"), "fix")).alias("x")).select("word", F.col("x.fix").alias("fix"))


def _own(docs: DataFrame, found: Column, key: str, table: DataFrame, name: str) -> DataFrame:
    """doc_id and an array of the document's own corrections, the longest first. table has a key once; only what has a correction is compared."""
    mine = docs.select("doc_id", F.explode(F.array_distinct(found)).alias(key)).join(table, key).distinct()
    order = F.struct((-F.length(key)).alias("size"), F.col(key).alias("old"), F.col("fix").alias("new"))
    return mine.groupBy("doc_id").agg(F.sort_array(F.collect_list(order)).alias(name))


def _cased(word: Column, fix: Column) -> Column:
    return F.when(word == F.upper(word), F.upper(fix)).when(F.substring(word, 1, 1) == F.upper(F.substring(word, 1, 1)), F.concat(F.upper(F.substring(fix, 1, 1)), F.substr(fix, F.lit(2)))).otherwise(fix)


def repaired(docs: DataFrame) -> DataFrame:
    """doc_id, text, and how many different runs, cuts and words were mended in it. docs: doc_id (one row each), text."""
    words = vocabulary(docs)
    known = words.where(F.col("n") >= LEAST)
    literal = spaced_words(docs, known).select(F.col("run").alias("key"), "fix", F.lit(True).alias("spaced")).unionByName(cut_lines(docs, known).select(F.col("cut").alias("key"), F.concat("fix", F.lit("\n")).alias("fix"), F.lit(False).alias("spaced")))
    seen = docs.select("doc_id", F.explode(F.array_distinct(F.concat(_all(F.col("text"), RUN), F.when(F.col("text").contains("-\n"), _all(F.col("text"), CUT)).otherwise(F.array().cast("array<string>"))))).alias("key")).join(literal, "key")
    n = lambda c: F.count_if(c).cast("long")
    whole = seen.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("key")).alias("size"), F.col("key").alias("old"), F.col("fix").alias("new")))).alias("literal"), n(F.col("spaced")).alias("n_spaced"), n(~F.col("spaced")).alias("n_cut"))
    wrong = _own(docs, _all(F.lower("text"), WORD), "word", taken_for(words), "wrong")
    d = docs.select("doc_id", "text").join(whole, "doc_id", "left").join(wrong, "doc_id", "left")
    # a cut word's line ends behind it, and the blank that stood there goes
    none = F.array().cast("array<struct<size: int, old: string, new: string>>")
    text = F.aggregate(F.coalesce("literal", none), F.col("text"), lambda t, x: F.when(x["new"].endswith("\n"), F.replace(F.replace(t, F.concat(x["old"], F.lit(" ")), x["new"]), x["old"], F.regexp_replace(x["new"], "\n$", ""))).otherwise(F.replace(t, x["old"], x["new"])))
    d = d.withColumn("text", F.when(F.col("literal").isNotNull(), text).otherwise(F.col("text")))
    bracketed = F.array_join(F.zip_with(F.split("text", BRACKETS, -1), _all(F.col("text"), BRACKETS), lambda a, b: F.concat(a, F.replace(F.coalesce(b, F.lit("")), F.lit(" "), F.lit("")))), "")
    d = d.withColumn("text", F.when(F.col("text").contains("[ "), bracketed).otherwise(F.col("text")))
    table = F.map_from_entries(F.transform("wrong", lambda x: F.struct(x["old"], x["new"])))
    pieces = F.regexp_extract_all("text", F.lit(rf"{WORD}|[^\p{{L}}01]+"), F.lit(0))
    mended = F.array_join(F.transform(pieces, lambda w: F.coalesce(_cased(w, F.try_element_at("fixes", F.lower(w))), w)), "")
    d = d.withColumn("fixes", table).withColumn("text", F.when(F.col("fixes").isNotNull(), mended).otherwise(F.col("text")))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return d.select("doc_id", "text", count(F.col("n_spaced")).alias("n_spaced"), count(F.col("n_cut")).alias("n_cut"), count(F.when(F.col("wrong").isNotNull(), F.size("wrong"))).alias("n_words"))
