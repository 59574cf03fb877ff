"""Queries of tokens, jobs, caches and stored rows."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from .registry import query

ACTION = "CASE event_type WHEN 'purchase' THEN 'mint' WHEN 'click' THEN 'consume' WHEN 'view' THEN 'consume' ELSE CASE event_id % 3 WHEN 0 THEN 'dispute' ELSE 'refund' END END"


def _token_events(e):
    return e.selectExpr("user_id AS token", "unix_timestamp(ts) AS ts", "event_id AS seq", f"{ACTION} AS action")


@query("token_answers", None, "events")
def token_answers(e):
    return L.token_answers(_token_events(e))


@query("token_states", None, "events")
def token_states(e):
    return L.token_state(L.token_answers(_token_events(e)))


@query("refund_ledger", None, "events", "customer")
def refund_ledger(e, c):
    return L.refunds(L.token_answers(_token_events(e)), c.select(F.col("c_custkey").alias("token"), F.col("c_nationkey").alias("pack")))


@query("job_children", "SELECT c.parent_id, p.state AS parent_state, c.job_id, row_number() OVER (PARTITION BY c.parent_id ORDER BY c.created_at, c.job_id) AS place FROM jobs_v c JOIN jobs_v p ON c.parent_id = p.job_id", "jobs_v")
def job_children(j):
    return L.children(j)


@query("matched_events", "SELECT event_id, job_id FROM events JOIN (SELECT message_id, job_id FROM jobs_v WHERE message_id IS NOT NULL) ON user_id = message_id", "events", "jobs_v")
def matched_events(e, j):
    return L.matched(e.withColumnRenamed("user_id", "message_id"), j).select("event_id", "job_id")


@query("expired_jobs", "SELECT job_id FROM jobs_v WHERE expires_at <= 1000 AND state NOT IN ('running', 'queued')", "jobs_v")
def expired_jobs(j):
    return L.expired_jobs(j, 1000).select("job_id")


@query("purged_jobs", "SELECT state, count(*) AS n FROM jobs_v WHERE NOT (coalesce(expires_at, 9999) <= 1000 AND state NOT IN ('running', 'queued')) GROUP BY 1", "jobs_v")
def purged_jobs(j):
    return L.purged(j, L.expired_jobs(j, 1000)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("logged_events", "SELECT event_id, event_type, '{\"user_id\":' || user_id || '}' AS details FROM events WHERE event_type IN ('purchase', 'view')", "events")
def logged_events(e):
    return L.logged(e, ("purchase", "view"), "user_id")


@query("token_ttl", "SELECT job_id, coalesce(expires_at, created_at + 30 * 86400) AS expires_at FROM jobs_v", "jobs_v")
def token_ttl(j):
    return L.with_ttl(j.select("job_id", "created_at", F.col("expires_at"))).select("job_id", "expires_at")


OLD = "old AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 3 = 1 THEN '' ELSE o_orderpriority END AS producer, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_custkey END AS pages FROM orders WHERE o_orderkey % 5 > 0), new AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 > 0 THEN o_orderstatus END AS producer, o_custkey % 7 AS pages FROM orders WHERE o_orderkey % 7 > 0)"


def _old_new(o):
    k = F.col("o_custkey")
    old = o.where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("id"), F.when(k % 3 == 0, None).when(k % 3 == 1, "").otherwise(F.col("o_orderpriority")).alias("producer"), F.when(k % 4 == 0, 0).otherwise(k).cast("long").alias("pages"))
    new = o.where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("id"), F.when(k % 5 > 0, F.col("o_orderstatus")).alias("producer"), (k % 7).cast("long").alias("pages"))
    return old, new


@query("book_upserts", f"WITH {OLD} SELECT id, CASE WHEN old.producer IS NULL OR old.producer IN ('', '0') THEN coalesce(new.producer, old.producer) ELSE old.producer END AS producer, CASE WHEN old.pages IS NULL OR old.pages = 0 THEN coalesce(new.pages, old.pages) ELSE old.pages END::BIGINT AS pages FROM old FULL JOIN new USING (id)", "orders")
def book_upserts(o):
    return L.upserted(*_old_new(o), "id", ["producer", "pages"])


@query("metadata_upserts", f"WITH {OLD} SELECT id, coalesce(new.producer, old.producer) AS producer, coalesce(new.pages, old.pages)::BIGINT AS pages FROM old FULL JOIN new USING (id)", "orders")
def metadata_upserts(o):
    return L.replaced_fields(*_old_new(o), "id", ["producer", "pages"])


@query("fix_counts", "SELECT category AS fix_type, count(*) AS times_applied, count(*) AS times_succeeded, min(book_id) AS first_seen_book_id, 0.0::DOUBLE AS success_rate FROM issues_v WHERE fix_attempted GROUP BY 1", "issues_v")
def fix_counts(i):
    return L.fix_counts(i.withColumn("n", F.col("fix_attempted").cast("int")))


@query("invalidated_cache", "SELECT 'hash' AS way, count(*) AS n FROM cache_v WHERE hash IS DISTINCT FROM 7 UNION ALL SELECT 'version', count(*) FROM cache_v WHERE NOT coalesce(served < 3, false) UNION ALL SELECT 'nothing', count(*) FROM cache_v", "cache_v")
def invalidated_cache(c):
    c = c.withColumn("version", F.col("served"))
    n = lambda d, way: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(way).alias("way"), "n")
    return n(L.invalidated(c, source_hash=7, older_than=3), "hash").unionByName(n(L.invalidated(c, older_than=3), "version")).unionByName(n(L.invalidated(c), "nothing"))


@query("cache_image_counts", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 5 ELSE len(regexp_extract_all(replace(html, '<p>', '<figure><p>'), '<figure>')) END::BIGINT AS image_count FROM pages", "pages")
def cache_image_counts(p):
    d = p.select("page_id", F.when(F.col("page_id") % 3 == 0, 5).alias("image_count"), F.replace("html", F.lit("<p>"), F.lit("<figure><p>")).alias("html"))
    return L.image_counts(d).select("page_id", F.col("image_count").cast("long").alias("image_count"))


@query("profile_dedupe", "SELECT min(book_id) AS book_id FROM books_v GROUP BY coalesce(publisher, ''), coalesce(format, '')", "books_v")
def profile_dedupe(b):
    return L.first_of(b, ["publisher", "format"], "book_id").select("book_id")


@query("book_history", "WITH c AS (SELECT book_id, count(*) AS n_conversions, count(DISTINCT iteration) AS iterations FROM conversions_v GROUP BY 1), i AS (SELECT book_id, count(*) AS n_issues FROM issues_v GROUP BY 1) SELECT book_id, coalesce(n_conversions, 0) AS n_conversions, coalesce(n_issues, 0) AS n_issues, coalesce(iterations, 0) AS iterations FROM c FULL JOIN i USING (book_id)", "conversions_v", "issues_v")
def book_history(c, i):
    n = lambda x: F.coalesce(F.size(x), F.lit(0)).cast("long")
    return L.history(c, i).select("book_id", F.when(F.col("conversions").isNull(), 0).otherwise(n("conversions")).cast("long").alias("n_conversions"), F.when(F.col("issues").isNull(), 0).otherwise(n("issues")).cast("long").alias("n_issues"), F.when(F.col("conversions").isNull(), 0).otherwise(n(F.array_distinct(F.transform("conversions", lambda x: x["iteration"])))).cast("long").alias("iterations"))


ONE = "one AS (SELECT book_id, iteration, min(path) AS path, max(score) AS score FROM conversions_v GROUP BY 1, 2)"


@query("path_switches", f"WITH {ONE}, w AS (SELECT book_id, iteration, path AS to_path, score AS score_after, lag(path) OVER w AS from_path, lag(score) OVER w AS score_before FROM one WINDOW w AS (PARTITION BY book_id ORDER BY iteration)) SELECT *, score_after - score_before AS change FROM w WHERE from_path <> to_path", "conversions_v")
def path_switches(c):
    return L.switches(c.groupBy("book_id", "iteration").agg(F.min("path").alias("path"), F.max("score").alias("score")))
