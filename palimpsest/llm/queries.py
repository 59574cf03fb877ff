"""The opN_ queries: each operator over its whole table, with the columns its contract names."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, collocations, exact_dedup, html_labeller, kneser_ney, nn_descent, packing, pii, piece_dropout, quality_rules, simhash, token_output, warc
from .common import load


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_verdicts(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_blocks(token_output.write_blocks(load(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_pages(warc.write_archives(load(spark, sf_dir, "pages"))).drop("payload")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pii.find_pii(load(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.told(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.told(F.col("spans")).alias("spans"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even doc_id are history, the others arrive later; together they are the table."""
    out = exact_dedup.exact_groups(load(spark, sf_dir, "documents"), F.col("doc_id") % 2 == 0)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op6_html_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.main_text(load(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_components(load(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = kneser_ney.held_out(F.col("doc_id"))
    model = kneser_ney.train(docs.where(~out))
    return kneser_ney.score(docs, model).select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op10_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.segment(load(spark, sf_dir, "documents")).drop("ids")


def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return nn_descent.search(nn_descent.build(vectors, "vec_id", "embedding"), vectors.where("vec_id % 50 = 0"), "vec_id", "embedding")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(load(spark, sf_dir, "documents")).drop("groups")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_token_ids, op3_warc, op4_pii, op5_exact_dedup, op6_html_labeller, op7_simhash, op8_packing, op9_kneser_ney, op10_piece_dropout, op11_nn_descent, op12_collocations, op13_alignment)}

_SPACE = "[\\x09-\\x0D ]"

#: keep_id by the normalised text's digest; every row.
OP5 = f"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

#: Base counts by word positions; lines by their normalised text and host.
OP1 = f"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w FROM t),
tri AS (SELECT doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
met AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM met) GROUP BY 1),
base AS (
  SELECT doc_id, host, t, len(w) AS n_words, length(regexp_replace(t, '{_SPACE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D ]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D ]')))) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id)),
lines AS (SELECT doc_id, host, t, trim(unnest(string_split(regexp_replace(lower(t), '[\\t\\x0B\\f\\r ]+', ' ', 'g'), chr(10))), ' ') AS line FROM base),
counted AS (SELECT *, len(string_split(line, ' ')) AS words FROM lines WHERE line <> ''),
often AS (SELECT host, line FROM counted GROUP BY 1, 2 HAVING count(DISTINCT t) > 10),
hit AS (SELECT doc_id, sum(words) AS removed_words FROM counted JOIN often USING (host, line) GROUP BY 1),
v AS (SELECT base.*, coalesce(removed_words, 0) AS removed_words, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM base LEFT JOIN hit USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND removed_words <= 0.5 * n_words AS kept, removed_words::BIGINT AS removed_words
FROM v
"""

#: Counts by positions within pieces; products as 128-bit integers.
OP12 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
pos AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE len(w) > 0),
g AS (SELECT lang, w[i] AS phrase, 1 AS words FROM pos UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM pos WHERE i + 1 <= len(w) UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM pos WHERE i + 2 <= len(w)),
f AS (SELECT lang, phrase, words, count(*) AS f FROM g GROUP BY 1, 2, 3),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY 1),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words >= 2 AND f >= 10),
cuts AS (SELECT lang, phrase, a, 1 AS k, w[1] AS x, CASE WHEN words = 2 THEN w[2] ELSE w[2] || ' ' || w[3] END AS y FROM c UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE words = 3),
s AS (SELECT cuts.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f))::BIGINT AS score FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3) GROUP BY 1, 2),
kept AS (SELECT worst.* FROM worst LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op12_collocations": OP12, "op1_quality_rules": OP1, "op5_exact_dedup": OP5}
