"""A language model of very many files under a low limit of open ones."""
import resource

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from palimpsest.llm import kneser_ney


def test_three_hundred_shards_under_256_descriptors(spark, monkeypatch, tmp_path):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()[:60])], "doc_id long, text string").repartition(2)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    few = kneser_ney.train(docs)
    want = {r["doc_id"]: r["score"] for r in kneser_ney.score(docs, few).collect()}
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", max(1, sum(map(len, texts)) // 300))
    many = kneser_ney.train(docs)
    assert many.shards >= 300 and few.shards < 300
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, hard))
    try:
        tokens, n = kneser_ney.hashed_tokens(texts)
        _, _, kn = kneser_ney.score_tokens(many, tokens, n)
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    looked = kneser_ney._mapped(many).looked
    assert looked <= 2 * many.shards  # once through each file for all texts together
    kneser_ney.score_tokens(many, *kneser_ney.hashed_tokens(["one or two"]))
    assert kneser_ney._mapped(many).looked - looked <= 9  # a few keys open a few files
    got = np.add.reduceat(kn, np.concatenate(([0], np.cumsum(n)[:-1])))
    assert np.allclose(got, [want[k] for k in range(len(texts))])
    assert kneser_ney.score(docs.where(F.col("doc_id") < 3), many).count() == 3
