"""Tokens, refunds, jobs and messages: what keyed events come to, and rewrites of stored rows.

Events of one key are folded in order inside applyInPandas; a key is one token, so a group is its own few events.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The form of a token, and the answers to one that is not accepted.
TOKEN = r"^lb_pk_[A-Za-z0-9_-]{43}$"
#: Event types that are logged; others are refused.
LIFETIME_DAYS = 30


def well_formed(token: Column) -> Column:
    return F.coalesce(token.rlike(TOKEN), F.lit(False))


class Token:
    """A token's state; each method is one event at time `now` (seconds) and gives its answer."""

    def __init__(self, used: bool = False, disputed: bool = False, expires_at: int | None = None):
        self.used, self.disputed, self.expires_at = used, disputed, expires_at

    def mint(self, now: int, lifetime: int) -> str:
        if self.expires_at is not None:
            return "DUPLICATE"
        self.expires_at = now + lifetime
        return "MINTED"

    def consume(self, now: int, _: int) -> str:
        if self.expires_at is None:
            return "INVALID_OR_EXPIRED"
        if self.disputed:
            return "DISPUTED"
        if self.used:
            return "ALREADY_USED"
        if self.expires_at <= now:
            return "INVALID_OR_EXPIRED"
        self.used = True
        return "OK"

    def dispute(self, now: int, _: int) -> str:
        self.disputed = self.expires_at is not None or self.disputed
        return "DISPUTED" if self.disputed else "UNKNOWN"

    def refund(self, now: int, _: int) -> str:
        if self.used and not self.disputed and self.expires_at is not None and self.expires_at > now:
            self.used = False
            return "reverse_consumed"
        return "ledgered_only"


def token_answers(events: DataFrame, lifetime: int = LIFETIME_DAYS * 86_400) -> DataFrame:
    """events: token, ts (seconds), seq, action (mint, consume, dispute, refund). The answer to each event, in order of ts and seq."""

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        p, t = p.sort_values(["ts", "seq"]), Token()
        p["answer"] = [getattr(t, a)(int(now), lifetime) for a, now in zip(p["action"], p["ts"], strict=True)]
        return p[["token", "ts", "seq", "action", "answer"]]

    return events.select("token", "ts", "seq", "action").groupBy("token").applyInPandas(fold, "token long, ts long, seq long, action string, answer string")


def token_stream(events: DataFrame, lifetime: int = LIFETIME_DAYS * 86_400) -> DataFrame:
    """token_answers for a stream: the state of each token is kept between batches; events of one batch are put in order, later ones that come late meet the state as it is."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        t = Token(*state.get) if state.exists else Token()
        p = pd.concat(parts).sort_values(["ts", "seq"])
        p["answer"] = [getattr(t, a)(int(now), lifetime) for a, now in zip(p["action"], p["ts"], strict=True)]
        state.update((t.used, t.disputed, t.expires_at))
        yield p[["token", "ts", "seq", "action", "answer"]]

    return events.select("token", "ts", "seq", "action").groupBy("token").applyInPandasWithState(fold, "token long, ts long, seq long, action string, answer string", "used boolean, disputed boolean, expires_at long", "append", "NoTimeout")


def token_state(answers: DataFrame) -> DataFrame:
    """From answered events: whether each token is used and disputed in the end."""
    last = lambda c: F.max(F.when(c, F.struct("ts", "seq")))
    d = answers.groupBy("token").agg(last(F.col("answer") == "OK").alias("ok"), last(F.col("answer") == "reverse_consumed").alias("back"), F.bool_or((F.col("action") == "dispute") & (F.col("answer") == "DISPUTED")).alias("disputed"))
    return d.select("token", (F.col("ok").isNotNull() & (F.col("back").isNull() | (F.col("ok") > F.col("back")))).alias("used"), "disputed")


def refunds(answers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Refund events beside the token's own row, by outcome."""
    return answers.where("action = 'refund'").join(tokens, "token", "left").select("token", "ts", F.col("answer").alias("outcome"), "pack")


def children(jobs: DataFrame) -> DataFrame:
    """Parent and child jobs, a child's place by when it was made."""
    parent = jobs.select(F.col("job_id").alias("parent_id"), F.col("state").alias("parent_state"))
    w = W.partitionBy("parent_id").orderBy("created_at", "job_id")
    return jobs.where("parent_id IS NOT NULL").join(parent, "parent_id").select("parent_id", "parent_state", "job_id", F.row_number().over(w).alias("place"))


def matched(events: DataFrame, jobs: DataFrame) -> DataFrame:
    """Webhook events with the job whose message they tell of; others are ignored. events may be a stream."""
    return events.join(jobs.select("message_id", "job_id"), "message_id")


def expired_jobs(jobs: DataFrame, now: int) -> DataFrame:
    return jobs.where((F.col("expires_at") <= now) & ~F.col("state").isin("running", "queued"))


def purged(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    return jobs.join(gone.select("job_id"), "job_id", "left_anti")


def logged(events: DataFrame, allowed: tuple[str, ...], *details: str) -> DataFrame:
    """Events of the allowed types; their details as JSON with sorted keys."""
    return events.where(F.col("event_type").isin(*allowed)).select("event_id", "event_type", F.to_json(F.struct(*sorted(details))).alias("details"))


def with_ttl(tokens: DataFrame, days: int = LIFETIME_DAYS) -> DataFrame:
    """Tokens that have no time of expiry get one, `days` after they were made."""
    return tokens.withColumn("expires_at", F.coalesce("expires_at", F.col("created_at") + days * 86_400))


def upserted(stored: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored rows after a merge: new keys come in, and null or empty fields of old rows are filled from the found ones."""
    new = found.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    fill = lambda f: F.when(F.col(f).isNull() | (F.col(f).cast("string").isin("", "0")), F.coalesce(f"_{f}", f)).otherwise(F.col(f)).alias(f)
    return stored.join(new, key, "full").select(key, *(fill(f) for f in fields))


def replaced_fields(stored: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Stored rows after a merge in which what is found and not null wins."""
    new = found.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return stored.join(new, key, "full").select(key, *(F.coalesce(f"_{f}", f).alias(f) for f in fields))


def fix_counts(applied: DataFrame) -> DataFrame:
    """Rule-based fixes by category: times applied and succeeded (each application counts as a success), the first book, and the rate, which such records never change."""
    d = applied.where("n > 0").groupBy(F.col("category").alias("fix_type"))
    return d.agg(F.count(F.lit(1)).alias("times_applied"), F.count(F.lit(1)).alias("times_succeeded"), F.min("book_id").alias("first_seen_book_id")).withColumn("success_rate", F.lit(0.0))


def invalidated(cache: DataFrame, source_hash: int | None = None, book_id: int | None = None, older_than: int | None = None) -> DataFrame:
    """A cache without what an invalidation deletes; of several arguments the first given counts, without one nothing goes."""
    if source_hash is not None:
        return cache.where(~F.col("hash").eqNullSafe(F.lit(source_hash)))
    if book_id is not None:
        return cache.where(~F.col("book_id").eqNullSafe(F.lit(book_id)))
    if older_than is not None:
        return cache.where(~F.coalesce(F.col("version") < older_than, F.lit(False)))
    return cache


def image_counts(cache: DataFrame) -> DataFrame:
    """Entries without a count of images get it from their HTML."""
    return cache.withColumn("image_count", F.coalesce("image_count", F.regexp_count("html", F.lit("<figure>"))))


def first_of(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Of rows that share the keys (null equal to "") the one of the least `by` stays."""
    shared = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]
    least = rows.groupBy(*(c.alias(f"_{k}") for k, c in zip(keys, shared, strict=True))).agg(F.min(by).alias(by)).select(by)
    return rows.join(least, by, "left_semi")


def history(conversions: DataFrame, issues: DataFrame) -> DataFrame:
    """A book's conversions and issues as ordered arrays. One book's history is small by nature."""
    c = conversions.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("iteration", "path", "score"))).alias("conversions"))
    i = issues.groupBy("book_id").agg(F.sort_array(F.collect_list(F.struct("severity", "category", "issue_id"))).alias("issues"))
    return c.join(i, "book_id", "full")


def switches(conversions: DataFrame) -> DataFrame:
    """Changes of path between a book's iterations, and what they did to the score; a score not known gives no change."""
    w = W.partitionBy("book_id").orderBy("iteration")
    d = conversions.select("book_id", "iteration", F.col("path").alias("to_path"), F.col("score").alias("score_after"), F.lag("path").over(w).alias("from_path"), F.lag("score").over(w).alias("score_before"))
    return d.where("from_path <> to_path").withColumn("change", F.col("score_after") - F.col("score_before"))
