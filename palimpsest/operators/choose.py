"""Filters, set operations, top rows and small verdicts."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def where_given(rows: DataFrame, **wanted) -> DataFrame:  # noqa: ANN003
    """Rows equal to each argument that is not None; one that is None asks nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def matches_or_any(column: str, value: object) -> Column:
    """A row whose column is null stands for every value."""
    return F.col(column).isNull() | (F.col(column) == value)


def not_done(files: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return files.join(done.select(key).distinct(), key, "left_anti")


def resumed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Results of an interrupted run and, of its continuation, the files that it had not done."""
    return old.unionByName(not_done(new, old, key), allowMissingColumns=True)


def chain_ok(links: list[tuple[Column, Column, Column]]) -> Column:
    """(enabled, ok, message) of each link: a link that is off, disabled or skipped is not required."""
    fine = lambda on, ok, message: ~on | ok | (message == "disabled") | message.startswith("skipped")
    return reduce(lambda a, b: a & b, (F.coalesce(fine(*x), F.lit(False)) for x in links))


def sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both, and where each is: both, left or right."""
    d = left.distinct().withColumn("_l", F.lit(1)).join(right.distinct().withColumn("_r", F.lit(1)), left.columns, "full")
    return d.withColumn("side", F.when(F.col("_l").isNull(), "right").when(F.col("_r").isNull(), "left").otherwise("both")).drop("_l", "_r")


def same_set(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))


def ordered_signals(*signals: Column) -> Column:
    """Those that are there, each once, in the order they came."""
    return F.array_distinct(F.array_compact(F.array(*signals)))


def newest(rows: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc(at), *ties).limit(n)


def most_common(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def newest_after(rows: DataFrame, key: str, since: str) -> DataFrame:
    d = rows.where(F.col("ts") > F.expr(f"timestamp_ntz '{since}'")).groupBy(key).agg(F.max(F.struct("ts", "event_id")).alias("e"))
    return d.select(key, "e.ts", "e.event_id")


def best_by(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """The last of the columns, of the row that is greatest by all of them in order."""
    return rows.groupBy(key).agg(F.max(F.struct(*columns)).alias("b")).select(key, f"b.{columns[-1]}")


def applicable_fixes(outcomes: DataFrame, least: float = 0.7) -> DataFrame:
    """Fixes by success rate, then by how often they were tried; a row for each category of fix."""
    d = outcomes.where("fix_attempted").groupBy(F.col("category").alias("fix")).agg(F.count(F.lit(1)).alias("times_applied"), F.avg(F.col("fix_succeeded").cast("int")).alias("success_rate")).where(F.col("success_rate") >= least)
    return d.withColumn("place", F.row_number().over(W.orderBy(F.desc("success_rate"), F.desc("times_applied"), "fix")))


def zipped(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Arrays p of both frames side by side, place by place; and the keys whose arrays differ in length, which have no pairs."""
    d = a.select(key, F.col("p").alias("_a")).join(b.select(key, F.col("p").alias("_b")), key)
    even = F.size("_a") == F.size("_b")
    pairs = d.where(even).select(key, F.posexplode(F.arrays_zip("_a", "_b")).alias("pos", "x"))
    return pairs.select(key, "pos", F.col("x._a").alias("page_a"), F.col("x._b").alias("page_b")), d.where(~even).select(key)


#: Limits of uploads in bytes by tier, the formats that a file may be told by its name, and what each tier may ask for.
UPLOAD_BYTES = {"free": 20 * 1024 * 1024, "premium": 100 * 1024 * 1024}
BY_NAME = ("mobi", "azw", "azw3", "djvu")
OUTPUTS = {"free": ("epub", "mobi"), "premium": ("epub", "mobi", "kfx")}
#: First characters of files of other kinds, which no name excuses.
OTHER_KINDS = ("\x89PNG", "\xff\xd8\xff", "GIF8", "MZ", "Rar!", "7z\xbc\xaf", "\x1f\x8b", "BZh", "\x7fELF", "ID3", "RIFF", "%!", "{\\rtf")
#: Where readers' devices take mail, its largest attachment in bytes, and the formats they read.
DEVICE_DOMAINS, DEVICE_BYTES, DEVICE_FORMATS = ("kindle.com", "free.kindle.com"), 25 * 1024 * 1024, ("epub",)


def file_kind(header: Column, name: Column) -> Column:
    """pdf, epub or a format told by the name; null for what is not taken. header: the first bytes, one character for each (Latin-1)."""
    other = F.lit(False)
    for x in OTHER_KINDS:
        other = other | header.startswith(x)
    bare = F.regexp_replace(header, "^\xef\xbb\xbf", "")
    zipped = F.substring(header, 1, 4).isin("PK\x03\x04", "PK\x05\x06", "PK\x07\x08")
    ext = F.lower(F.regexp_extract(name, r"\.([^./\\]*)$", 1))
    return F.when(bare.startswith("%PDF"), "pdf").when(zipped, "epub").when(~F.coalesce(other, F.lit(False)) & ext.isin(*BY_NAME), ext)


def upload_verdict(header: Column, name: Column, size: Column, tier: Column, output: Column) -> Column:
    """What is wrong with an upload, the first that holds, or ok: EMPTY_FILE, FILE_TOO_LARGE, INVALID_MIME, INVALID_OUTPUT_FORMAT. A tier that is not free is premium."""
    free = tier == "free"
    most = F.when(free, UPLOAD_BYTES["free"]).otherwise(UPLOAD_BYTES["premium"])
    given = F.when(free, output.isin(*OUTPUTS["free"])).otherwise(output.isin(*OUTPUTS["premium"]))
    wrong = ((F.coalesce(size, F.lit(0)) == 0, "EMPTY_FILE"), (size > most, "FILE_TOO_LARGE"), (file_kind(header, name).isNull(), "INVALID_MIME"), (~F.coalesce(given, F.lit(False)), "INVALID_OUTPUT_FORMAT"))
    return F.coalesce(*(F.when(c, code) for c, code in wrong), F.lit("ok"))


def recipient_verdict(address: Column) -> Column:
    """INVALID_RECIPIENT_FORM for what is no bare address (a name, brackets, blanks, a plus in it), INVALID_RECIPIENT_DOMAIN for one of another domain, else ok."""
    bare = F.lower(F.trim(F.coalesce(address, F.lit(""))))
    form = bare.rlike(r"^[^\s@<>()\[\],;:\\\"+]+@[^\s@<>()\[\],;:\\\"]+$")
    return F.when(~form, "INVALID_RECIPIENT_FORM").when(~F.regexp_extract(bare, "@(.*)$", 1).isin(*DEVICE_DOMAINS), "INVALID_RECIPIENT_DOMAIN").otherwise("ok")


def attachment_verdict(output: Column, size: Column) -> Column:
    """FORMAT_NOT_KINDLE_ELIGIBLE or OUTPUT_TOO_LARGE_FOR_KINDLE for what cannot be sent to a device, else ok."""
    return F.when(~F.lower(F.coalesce(output, F.lit(""))).isin(*DEVICE_FORMATS), "FORMAT_NOT_KINDLE_ELIGIBLE").when(size > DEVICE_BYTES, "OUTPUT_TOO_LARGE_FOR_KINDLE").otherwise("ok")


def cost(model: Column, tokens: Column, rates: dict[str, float], otherwise: float) -> Column:
    """Cost by the first rate whose name the model's holds."""
    rate = F.lit(otherwise)
    for name, r in reversed(rates.items()):
        rate = F.when(F.contains(model, F.lit(name)), r).otherwise(rate)
    return rate * tokens


def scripts(text: Column) -> dict[str, Column]:
    n = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    return {"greek": n(r"\p{IsGreek}"), "latin_ext": n(r"[\x{100}-\x{24f}]"), "accented": F.bround(n(r"[\x{c0}-\x{24f}]") * 100 / F.greatest(F.length(text), F.lit(1)), 2)}


#: The scripts told apart, by their Unicode names.
SCRIPTS = ("Latin", "Greek", "Cyrillic", "Hebrew", "Arabic", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul")


def script_shares(text: Column) -> dict[str, Column]:
    """Share in percent of a text's letters that are of each script, of all but the Latin ones together, and of its characters that were lost."""
    letters = F.greatest(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(1))
    shares = {s.lower(): F.bround(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")) * 100 / letters, 1) for s in SCRIPTS}
    others = [shares[s.lower()] for s in SCRIPTS if s != "Latin"]
    return shares | {"replaced": F.bround(F.regexp_count(text, F.lit("�")) * 100 / F.greatest(F.length(text), F.lit(1)), 2), "non_latin": F.bround(reduce(lambda a, b: a + b, others), 1)}


def debris(text: Column) -> Column:
    """Share of tokens with braces, bars, backslashes, shouts, brackets inside words or replacement characters."""
    words = F.filter(F.split(text, "[ \t\n\r\f\x0b]+"), lambda w: w != "")
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.size(F.filter(w, lambda x: x.rlike(r"[{}|\\]|!!!|\p{L}\(\p{L}|�"))) / F.size(w)).otherwise(0.0)), F.lit(0))


def zones(text: Column, head: int = 3000, samples: int = 8, each: int = 500, tail: int = 2000) -> dict[str, Column]:
    """Words for a model to see: the first, evenly spaced samples from between, the last; a short text has no middle."""
    words = F.filter(F.split(text, "[ \t\n\r\f\x0b]+"), lambda w: w != "")
    n = F.size(words)
    rest = F.greatest(F.lit(0), n - head)
    room = F.greatest(F.lit(0), n - head - tail)
    middle = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.slice(words, head + 1 + F.floor(room * k / samples).cast("int"), F.least(F.lit(each), F.floor(room / samples).cast("int")))))
    return {"head": F.slice(words, 1, head), "middle": middle, "tail": F.slice(words, F.greatest(F.lit(1), n - F.least(F.lit(tail), rest) + 1), F.least(F.lit(tail), rest))}
