"""Text predicates that Spark can push down."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_filter(posts: DataFrame, keywords: list[str], *columns: str) -> DataFrame:
    """Rows in which any keyword occurs, whatever its case."""
    body = F.lower(F.concat_ws(" ", *columns))
    return posts.where(reduce(lambda a, b: a | b, (F.contains(body, F.lit(k.lower())) for k in keywords), F.lit(False)))


def holds(text: Column) -> Callable[[str], Column]:
    """A predicate maker: the text has a word or phrase as a substring, whatever its case. Queries are made of these with &, | and ~."""
    low = F.lower(text)
    return lambda phrase: F.contains(low, F.lit(phrase.lower()))
