"""Registered queries over whole tables against plain versions, and the pipeline on odd rows."""
import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from palimpsest.llm import piece_dropout, queries

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_op3_over_all_pages(spark):
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    first = {}
    for p in pages:
        raw = (p["html"] or "").encode()
        first[raw] = min(first.get(raw, p["page_id"]), p["page_id"])
    want = set()
    for p in pages:
        raw = (p["html"] or "").encode()
        to = None if first[raw] == p["page_id"] else first[raw]
        want.add((p["page_id"], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if to is not None else "response", to))
    got = queries.op3_warc(spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == len(pages) and set(map(tuple, got)) == want


def test_op9_base_over_all_documents(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    tokens = {d["doc_id"]: [*WORD.findall(lower(d["text"])), None] for d in docs}
    out = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    count = collections.Counter(w for k, ws in tokens.items() if not out[k] for w in ws)
    total, kinds = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op9_kneser_ney(spark, SF).collect()}
    assert set(got) == set(tokens)
    for k, ws in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(ws), sum(count[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0


def test_op10_over_all_documents(spark):
    docs = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in queries.op10_piece_dropout(spark, SF).collect()}
    assert set(got) == set(docs) and all(r["lossless"] for r in got.values())
    enc = piece_dropout.Encoder(piece_dropout.DROPOUT, piece_dropout.SEED)
    for k in sorted(docs)[::7]:  # one word after another by the heap, each with its own key
        words = piece_dropout.WORDS.findall((" " + docs[k]).replace(piece_dropout.MARK, piece_dropout.OWN_MARK).replace(" ", piece_dropout.MARK)) if docs[k] else []
        ids, skipped = [], 0
        for w, key in zip(words, enc._keys(np.array([len(words)]), [k]).tolist(), strict=True):
            bare, tails = enc._bare([w])
            some, n = piece_dropout._by_heap(bare[0] if len(w) <= piece_dropout.LONG else w, piece_dropout.DROPOUT, key)
            ids += some
            skipped += n
            if tails[0] and len(w) <= piece_dropout.LONG:
                ids += piece_dropout.pieces().spell(tails[0])
        assert (got[k]["n_tokens"], got[k]["n_skipped"], got[k]["ids_crc32"]) == (len(ids), skipped, zlib.crc32(np.array(ids, "<u4").tobytes())), k


def test_pipeline_on_odd_rows_and_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, `_id` long, id long, w0 long"
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(0, None, "en", None, None, "d", 1, 2, 3), (1, "", "en", "h", 0, "d", 1, 2, 3), (2, long, "en", "h", len(long), None, None, None, None), (3, long, "en", "h", len(long), "x", 9, 9, 9)]
    text = " ".join(f"alpha{k % 70} beta{k}" for k in range(60))
    rows += [(4, text, "en", None, len(text), "x", 9, 9, 9)] * 2 + [(None, text + " more", None, None, 1, "x", 9, 9, 9), (5, text.replace(" ", "\n"), "de", "h", 3, "x", 9, 9, 9)]
    docs, none = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        docs, none = stage(spark, docs, SF), stage(spark, none, SF)
        assert none.count() == 0, name
        if name != "packing":
            assert docs.columns == [f.strip("`") for f in re.findall(r"(\S+) (?:long|string)", schema)], name
            docs = spark.createDataFrame(docs.collect(), schema)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {2, 4} or kept == {2, 4, None}
