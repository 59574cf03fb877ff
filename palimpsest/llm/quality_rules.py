"""Quality rules with cross-document line frequency; DataFrame functions only.

A normalised line (lower case, runs of blanks as one, trimmed, not empty) is hashed with its host. Lines that more than
LINE_LIMIT distinct documents of one host hold are boilerplate; exact copies of a text are one document, so copying alone
makes no line boilerplate and copies share their verdict. Such lines are removed from a document, and a document
that would lose more than MAX_REMOVED of its words is rejected.

Null text counts as no text (base_failed), a null host as the host "". Repeated rows get equal verdicts; an empty table gives
an empty result; other columns are ignored. Line state is 64-bit hashes, never text; a very long text costs memory in
proportion to its words.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, let, stored, text_or_empty, unboxed, words_of

LINE_LIMIT = 10
MAX_REMOVED = 0.5
MIN_WORDS = 50
LISTED = 2_000_000  # frequent lines that may be broadcast, 8 bytes each


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _normal_lines(text: Column) -> Column:
    return F.transform(_lines(F.regexp_replace(F.lower(text), "[ \\t\\x0B\\f\\r]+", " ")), lambda x: F.trim(x))


def _repeated_words(w: Column) -> Column:
    """Words in windows of three that occur twice or more: equal windows meet when hashes are sorted with their places."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))

    def places(s: Column) -> Column:
        met = F.filter(s, lambda e, i: (F.get(s, i - 1)["x"] == e["x"]) | (F.get(s, i + 1)["x"] == e["x"]))
        return F.sort_array(F.transform(met, lambda e: e["i"]))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(let(ordered, places), covered)).otherwise(F.lit(0))

    return F.when(F.size(w) >= 4, let(hashes, count)).otherwise(F.lit(0))


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, and the base rule's counts and verdict, for each row."""
    t = F.col("t")
    full = F.filter(_lines(t), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    words = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("repeated")))
    d = docs.select("doc_id", text_or_empty().alias("t")).select(
        "doc_id",
        F.xxhash64("t").alias("digest"),
        words.alias("w"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        let(full, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )
    d = d.select("doc_id", "digest", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.repeated").cast("long").alias("n_repeat_words"))
    return d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _line_rows(docs: DataFrame, host: str) -> DataFrame:
    """A row for each line that is not empty: h, doc_id, digest (of the whole text), i, words."""
    t = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text_or_empty().alias("t"))
    t = t.withColumn("digest", F.xxhash64("t"))
    rows = F.transform(_normal_lines(F.col("t")), lambda x, i: F.when(F.length(x) > 0, F.struct(F.xxhash64("host", x).alias("h"), i.alias("i"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("words"))))
    t = t.select("doc_id", "digest", F.explode(F.array_compact(rows)).alias("l"))
    return t.select("l.h", "doc_id", "digest", "l.i", "l.words")


def frequent_lines(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """h and n_docs (distinct texts) of the lines above the limit."""
    held = _line_rows(docs, host).groupBy("h", "digest").agg(F.lit(1).alias("one"))
    return held.groupBy("h").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > limit)


def quality_verdicts(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT, max_removed: float = MAX_REMOVED) -> DataFrame:
    """Base counts, removed_words, drop (places of the lines to remove) and kept, for each row of docs."""
    often = stored(frequent_lines(docs, host, limit).select("h"))
    often = F.broadcast(often) if often.count() <= LISTED else often
    hit = _line_rows(docs, host).join(often, "h").groupBy("doc_id", "digest").agg(F.collect_set(F.struct("i", "words")).alias("hits"))
    hit = hit.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "hits")
    d = base_metrics(docs)
    d = d.join(hit, d["doc_id"].eqNullSafe(hit["_id"]) & (d["digest"] == hit["_digest"]), "left").drop("_id", "_digest")
    d = d.withColumn("removed_words", F.coalesce(F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long")))
    d = d.withColumn("drop", F.transform("hits", lambda x: x["i"]))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("removed_words") <= max_removed * F.col("n_words"))).drop("hits")


def apply_quality_rules(docs: DataFrame, host: str = "source", limit: int = LINE_LIMIT) -> DataFrame:
    """The kept rows of docs with all their columns; frequent lines are gone from text, and n_chars (if there) follows."""
    v = quality_verdicts(docs, host, limit).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.first("drop").alias("_drop"), F.max("kept").alias("_kept")).where("_kept")
    d = boxed(docs).withColumn("_key", F.xxhash64(text_or_empty()))
    d = d.join(v, d["doc_id"].eqNullSafe(v["_id"]) & (d["_key"] == v["_digest"]))
    clean = F.array_join(F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains("_drop", i)), "\n")
    return unboxed(d.withColumn("text", F.when(F.size("_drop") > 0, clean).otherwise(F.col("text"))), docs)
