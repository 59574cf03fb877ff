"""Marking text for speech: pauses after headings and scenes, slower closing sentences, pauses for dashes, spoken spans."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.bookheads import scene_break
from .lines import once

#: Words of a closing sentence and of a spoken span; pauses of dashes in milliseconds.
CLOSER_WORDS, SPOKEN_WORDS = (3, 18), 3
LONG_DASH, SHORT_DASH = 250, 150
#: Pauses in milliseconds; a part's is longer than a chapter's.
PAUSES = {"part": 1500, "chapter": 1000, "scene": 800, "closer": 300}
OPTIONS = ("chapter_silence", "scene_break_silence", "emphatic_closers", "em_dash_pause")
QUOTED = r"[\"“]([^\"“”]+)[\"”]"


def pause(ms: int, syntax: str) -> str:
    return f'<silence msec="{ms}"/>' if syntax == "sapi" else f"{{{{Pause={ms}}}}}"


def dash_pauses(text: Column, syntax: str = "sapi") -> Column:
    """Long dashes, and two hyphens that are no more, become pauses; short dashes only between what is no number."""
    return F.regexp_replace(F.regexp_replace(text, r"\s*—\s*|(?<!-)--(?!-)", pause(LONG_DASH, syntax)), r"(?<![0-9])–(?![0-9])", pause(SHORT_DASH, syntax))


def closer(paragraph: Column) -> Column:
    """The last of two sentences or more if it states something in three to eighteen words, not shouted, not spoken; else null."""
    sentences = F.split(F.regexp_replace(paragraph, r"\s+$", ""), r"(?<=[.!?])\s+")
    last = F.get(sentences, F.size(sentences) - 1)
    words = F.regexp_count(last, F.lit(r"\S+"))
    good = (F.size(sentences) > 1) & last.rlike("[.!]$") & words.between(*CLOSER_WORDS) & ~last.rlike("[\"“”]") & (last != F.upper(last))
    return F.when(F.coalesce(good, F.lit(False)), last)


def spoken(text: Column) -> Column:
    """Quoted spans of three words or more with a letter in them."""
    return F.filter(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda s: (F.regexp_count(s, F.lit(r"\S+")) >= SPOKEN_WORDS) & s.rlike(r"\p{L}"))


def voiced(paragraphs: Column, parts: Column, chapters: Column, syntax: str = "sapi", options: tuple[str, ...] = OPTIONS, pauses: dict[str, int] | None = None) -> Column:
    """Paragraphs with marks. parts and chapters are arrays of the places of headings, which are put in capitals; a scene break goes, and its pause follows the paragraph before."""
    ms = {**PAUSES, **(pauses or {})}
    mark = lambda kind: F.lit(pause(ms[kind], syntax))
    on = lambda name: name in options

    def kinds(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.struct(x.alias("x"), F.when(F.array_contains(parts, i), "part").when(F.array_contains(chapters, i), "chapter").when(scene_break(x), "scene").otherwise("text").alias("kind")))

    def put(k: Column) -> Column:
        def each(e: Column, i: Column) -> Column:
            after = F.coalesce(F.get(k, i + 1)["kind"], F.lit(""))
            head = F.upper(e["x"])
            if on("chapter_silence"):
                head = F.concat(head, F.when(e["kind"] == "part", mark("part")).otherwise(mark("chapter")))
            text = dash_pauses(e["x"], syntax) if on("em_dash_pause") else e["x"]
            if on("emphatic_closers"):
                last = closer(e["x"])
                told = dash_pauses(last, syntax) if on("em_dash_pause") else last
                start = F.substring(text, F.lit(1), F.length(text) - F.length(told))
                slow = F.concat(F.lit('<rate speed="-1">'), told, F.lit("</rate>")) if syntax == "sapi" else told
                still = F.when(after.isin("part", "chapter", "scene"), "").otherwise(mark("closer"))
                text = F.when(last.isNotNull(), F.concat(start, slow, still)).otherwise(text)
            if on("scene_break_silence"):
                text = F.when(after == "scene", F.concat(text, mark("scene"))).otherwise(text)
            scene = F.lit(None).cast("string") if on("scene_break_silence") else e["x"]
            return F.when(e["kind"].isin("part", "chapter"), head).when(e["kind"] == "scene", scene).otherwise(text)

        return F.array_compact(F.transform(k, each))

    return once(paragraphs, lambda p: once(kinds(p), put))
