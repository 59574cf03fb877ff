"""Personal data: four exact base kinds, and candidate spans that boosted trees judge. Column functions only.

Base spans (leftmost, not overlapping, by kind): email, ip, card, phone. On top of them, generators
of high recall propose spans that may overlap: bare phone numbers, written-out e-mail addresses,
loosely grouped card numbers, social security numbers, IBANs, and keys or passwords. Each candidate gets features
of its form and of the CONTEXT characters on both sides; boosted trees (see pii_model), fitted in windows of the documents themselves, score it as
one Column expression, and the threshold of its kind, calibrated on held-out rows, selects it.
Base spans stand; a selected span may overlap them, and only one equal to a base span in kind, start and end is dropped.

Offsets count code points, ends are exclusive. Null text counts as empty. Matches are found in one pass
without backtracking over repeated groups, and places follow from blocks of lengths, so very long texts with very many
spans are safe. Repeated rows are judged alike, other columns are ignored, an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pii_model
from .common import boxed, let, text_or_empty, unboxed

CONTEXT = pii_model.CONTEXT
PAGE = 1024  # characters of the pieces that a text is redacted by

#: Base kinds, in the order of the results. A start inside a run that an earlier start covers cannot
#: match, so those are ruled out at once; runs are possessive because what follows cannot be in them.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these cannot hold the kind.
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}

#: name -> (kind of the span, pattern)
GENERATORS = {
    "bare_phone": ("phone", r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
    "spelt_email": ("email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[a-z0-9-]++\x20?(?:[\[(]dot[\])]|\.)\x20?[a-z]{2,}+(?![a-z0-9])"),
    "loose_card": ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2}[\x20._/-]{1,2}[0-9]{1,7}(?![0-9])"),
    "ssn": ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "named_secret": ("secret", r"(?i)(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api_?key)\x20?[=:]\x20?[^\x20\x09-\x0D]{6,}+"),
    "key_like": ("secret", r"(?<![A-Za-z0-9_])[A-Z0-9_]{16,}+(?![A-Za-z0-9_])"),
}
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret")


def _span(start: Column, end: Column, kind: str | Column, text: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), text.alias("text"))


EMPTY = "array<struct<kind:string,start:int,end:int,text:string>>"


def running(values: Column, zero: Column, plus: Callable[[Column, Column], Column]) -> Column:
    """For each element what those before it come to by plus (associative): blocks of about the square root of their number, so no long array is copied for each element."""

    def scan(some: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(some, begin, lambda a, x: F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def over(size: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, size))

        def joined(b: Column) -> Column:
            heads = scan(F.transform(b, lambda some: F.aggregate(some, zero, plus)), zero)
            return F.flatten(let(heads, lambda h: F.zip_with(b, h, scan)))

        return let(blocks, joined)

    return F.when(F.size(values) > 0, let(F.ceil(F.sqrt(F.size(values))).cast("int"), over)).otherwise(F.array().cast("array<int>"))


def _near(between: Column, found: Column, i: Column) -> tuple[Column, Column]:
    """CONTEXT characters on both sides of match i; they reach over one other match at most."""
    tail = lambda x: F.coalesce(F.substring(x, -CONTEXT, CONTEXT), F.lit(""))
    head = lambda x: F.coalesce(F.substring(x, 1, CONTEXT), F.lit(""))
    before = F.concat(tail(F.get(between, i - 1)), tail(F.get(found, i - 1)), tail(F.get(between, i)))
    after = F.concat(head(F.get(between, i + 1)), head(F.get(found, i + 1)), head(F.get(between, i + 2)))
    return F.substring(before, -CONTEXT, CONTEXT), F.substring(after, 1, CONTEXT)


def matches(text: Column, pattern: str, kind: str, near: bool = False) -> Column:
    """All matches with their places: the lengths of what lies between them and of themselves add up to the offsets. near: with before and after, the text around them."""

    def placed(p: Column) -> Column:
        between, found = p["between"], p["found"]
        sizes = F.zip_with(F.slice(between, 1, F.greatest(F.lit(1), F.size(found))), found, lambda b, m: F.coalesce(F.length(b) + F.length(m), F.lit(0)))

        def spans(at: Column) -> Column:
            def one(m: Column, i: Column) -> Column:
                start = F.get(at, i) + F.length(F.get(between, i))
                span = _span(start, start + F.length(m), kind, m)
                if not near:
                    return span
                before, after = _near(between, found, i)
                return F.struct(span.alias("c"), before.alias("before"), after.alias("after"))

            return F.transform(found, one)

        return let(running(sizes, F.lit(0), lambda a, x: a + x), spans)

    return let(F.struct(F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn check."""
    backwards = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9"))).otherwise(F.when(c >= "5", F.try_to_number(c, F.lit("9")) * 2 - 9).otherwise(F.try_to_number(c, F.lit("9")) * 2)).cast("int"))
    return F.aggregate(backwards, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    n = F.length(_digits(m))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, BASE[kind], kind), lambda x: _valid(kind, x["text"]))
    return F.when(text.rlike(NEEDS[kind]), found).otherwise(F.array().cast(EMPTY))


def _form_holds(name: str, m: Column, digits: Column) -> Column:
    """Whether a candidate's own form is one that the real thing has."""
    if name == "bare_phone":
        return digits.rlike(pii_model.PHONE_FORM)
    if name == "spelt_email":
        return F.lower(m).rlike(pii_model.EMAIL_FORM)
    if name == "ssn":
        return m.rlike(pii_model.SSN_FORM)
    if name != "iban":
        return F.lit(False)
    bare = F.replace(m, F.lit(" "), F.lit(""))
    letters = F.split(F.concat(F.substr(bare, F.lit(5)), F.substring(bare, 1, 4)), "")
    return F.aggregate(letters, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97) == 1


def _features(name: str, c: Column) -> Column:
    """Numbers of a candidate's form and of what stands around it, in the order of pii_model.features()."""
    m, before, after = c["c"]["text"], F.lower(c["before"]), F.lower(c["after"])
    digits = _digits(m)
    return F.array(
        *(F.lit(int(name == g)) for g in GENERATORS),
        F.length(m),
        F.length(digits),
        F.regexp_count(m, F.lit("[A-Z]")),
        F.regexp_count(m, F.lit("[a-z]")),
        F.regexp_count(m, F.lit("[^A-Za-z0-9]")),
        F.regexp_count(m, F.lit("(?:[0-9][A-Z]|[A-Z][0-9])")),
        F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False).cast("int"),
        before.rlike(pii_model.NEAR_CLUE).cast("int"),
        before.rlike(pii_model.COUNTER_BEFORE).cast("int"),
        before.rlike(pii_model.NEAR_COUNTER).cast("int"),
        after.rlike(pii_model.COUNTER_AFTER).cast("int"),
        F.substring(before, -1, 1).rlike("[#$%/=]").cast("int"),
        F.substring(after, 1, 1).rlike("[%/=_]").cast("int"),
        F.coalesce(_form_holds(name, m, digits), F.lit(False)).cast("int"),
    ).cast("array<double>")


def _tree(node: tuple, f: Column) -> Column:
    if len(node) == 1:
        return F.lit(float(node[0]))
    feature, limit, low, high = node
    return F.when(f[feature] <= limit, _tree(low, f)).otherwise(_tree(high, f))


def score(f: Column, model: pii_model.Model) -> Column:
    total = F.lit(float(model.start))
    for t in model.trees:
        total = total + _tree(t, f)
    return total


def _selected(text: Column, name: str, kind: str, pattern: str, model: pii_model.Model) -> Column:
    described = F.transform(matches(text, pattern, kind, near=True), lambda c: F.struct(c["c"].alias("c"), _features(name, c).alias("f")))
    return F.transform(F.filter(described, lambda x: score(x["f"], model) >= model.thresholds[kind]), lambda x: x["c"])


def candidate_spans(text: Column, model: pii_model.Model) -> Column:
    """Candidates of all generators that pass their kind's threshold."""
    out = []
    for name, (kind, pattern) in GENERATORS.items():
        out.append(_selected(text, name, kind, pattern, model))
    return F.when(text.rlike("[0-9]{3}|[=:@\\[(]|[A-Z0-9_]{16}"), F.flatten(F.array(*out))).otherwise(F.array().cast(EMPTY))


def windows(docs: DataFrame, most: int = pii_model.TRAIN_WINDOWS) -> tuple[str, ...]:
    """A window of text around a place of each of up to `most` documents, chosen by hashes: the contexts that the classifier is fitted in. Only some four times as many leave their tasks, however large the table."""
    text = F.col("text").cast("string")
    h = F.xxhash64("text")
    place = F.pmod(h, F.greatest(F.length(text) - 2 * CONTEXT, F.lit(1)))
    drawn = F.pmod(F.xxhash64(h), F.lit(1 << 30)) < int(min(1.0, 4 * most / max(1, docs.count())) * (1 << 30))
    some = docs.where((F.length(text) > 2 * CONTEXT) & drawn).select(h.alias("h"), F.substr(text, (place + 1).cast("int"), F.lit(2 * CONTEXT)).alias("w")).distinct()
    return tuple(r["w"] for r in some.orderBy("h", "w").limit(most).collect())


def find_pii(docs: DataFrame, keep: tuple[str, ...] = (), model: pii_model.Model | None = None) -> DataFrame:
    """doc_id, the columns in keep, base (spans of the base kinds) and spans (base and selected ones, by kind and start)."""
    model = model or pii_model.fitted(windows(docs.select("text")))
    d = docs.select("doc_id", *keep, text_or_empty().alias("_t"))
    t = F.col("_t")

    def chosen(base: Column) -> Column:
        return let(F.concat(base, candidate_spans(t, model)), lambda every: F.struct(base.alias("base"), F.concat(*(of_kind(every, k) for k in KINDS)).alias("spans")))

    def of_kind(every: Column, kind: str) -> Column:
        """In order; equal spans are neighbours then, and one of them stays."""
        return let(F.sort_array(F.filter(every, lambda x: x["kind"] == kind)), lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) != x, F.lit(True))))

    d = d.withColumn("_found", let(F.concat(*(base_spans(t, k) for k in BASE)), chosen))
    return d.select("doc_id", *keep, F.col("_found.base").alias("base"), F.col("_found.spans").alias("spans"))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, model: pii_model.Model | None = None) -> DataFrame:
    """docs with every span in text replaced by its kind in brackets; overlapping spans become one. n_chars follows where it is there; null texts stay null."""
    d = find_pii(boxed(docs), ("text", "__rest"), model)
    by_start = F.sort_array(F.transform("spans", lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("k"))))
    pages = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0))

    def clean(at: Column) -> Column:
        spans, pages = at["spans"], at["pages"]

        def cut(start: Column, end: Column) -> Column:
            """text[start:end] by way of its pages, so that a far place costs no more than a near one."""
            first = F.floor(start / PAGE).cast("int")
            some = F.array_join(F.slice(pages, first + 1, F.floor(end / PAGE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(some, start - first * PAGE + 1, end - start)).otherwise(F.lit(""))

        def marked(reach: Column) -> Column:
            told = F.transform(spans, lambda x, i: F.when(x["s"] >= F.get(reach, i), F.concat(cut(F.get(reach, i), x["s"]), F.lit("["), F.upper(x["k"]), F.lit("]"))).otherwise(F.lit("")))
            last = F.greatest(F.get(reach, F.size(reach) - 1), F.get(spans, F.size(spans) - 1)["e"])
            return F.concat(F.array_join(told, ""), cut(last, F.length("text")))

        ends = F.transform(spans, lambda x: x["e"])
        return let(running(ends, F.lit(0), lambda a, x: F.greatest(a, x)), marked)

    redacted = let(F.struct(by_start.alias("spans"), pages.alias("pages")), clean)
    return unboxed(d.withColumn("text", F.when(F.size("spans") > 0, redacted).otherwise(F.col("text"))), docs)
