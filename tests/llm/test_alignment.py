"""Cross-tokenizer alignment against a token-by-token version with the libraries alone."""
import collections
import hashlib
import json

import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import alignment, queries

SF = "/root/testdata/sf0.01"


def plain(rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    spell = {}
    free = 256
    for b in range(256):  # the byte-level alphabet
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            spell[chr(b)] = b
        else:
            spell[chr(free)] = b
            free += 1
    entry = {i: bytes(spell[c] for c in t) for t, i in a.get_vocab(with_added_tokens=True).items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    piece = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    found, count = [], collections.Counter()
    for k, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = sp.encode(text) if text else []
        want = (" " + (text or "")).encode()
        if not text or b"".join(entry[i] for i in ids_a) != want or b"".join(piece(i) for i in ids_b) != want:
            found.append((k, 0, 0, [], []))
            continue
        ends = []
        for ids, of in ((ids_a, entry.get), (ids_b, piece)):
            at, here = 0, []
            for i in ids:
                at += len(of(i))
                here.append(at)
            ends.append(here)
        common = set(ends[0]) & set(ends[1])
        cuts, sides = [], []
        for ids, here in zip((ids_a, ids_b), ends, strict=True):
            groups, now = [], []
            for i, e in zip(ids, here, strict=True):
                now.append(i)
                if e in common:
                    groups.append(now)
                    now = []
            sides.append(groups)
        cuts = list(zip(*sides, strict=True))
        links = [(x[-1], y[-1]) for x, y in cuts]
        count.update(links)
        found.append((k, len(ids_a), len(ids_b), cuts, links))
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for k, n_a, n_b, cuts, links in found:
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in cuts)
        out.append((k, n_a, n_b, len(cuts), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_whole_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert rows_of(queries.op13_alignment(spark, SF)) == plain([(r["doc_id"], r["text"]) for r in t])


def test_odd_rows(spark):
    texts = [None, "", " ", "a", "▁", "a ▁ b", "<|endoftext|> is plain", "x<|endoftext|>", "</s><s><unk>", "\n\n", "tab\tand space", "  two  blanks ", "\x00nul", "café naïve 你好 \U0001f600", "é combining", "'s it's", "1 22 333", "a\x1cb", "　wide", "word " * 40_000, "same", "same"]
    rows = [*enumerate(texts), (None, "no id"), (5, "same")]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a int, links string").repartition(3)
    assert rows_of(alignment.align(docs)) == plain(rows)
    said = {r["doc_id"]: r["groups"] for r in alignment.align(docs, groups=True).where("doc_id = 3").collect()}
    assert json.dumps(bytes(said[3]).decode()).count("|") == 1
    assert alignment.align(docs.limit(0)).count() == 0
    assert rows_of(alignment.align(docs.where("text IS NULL"))) == [(0, 0, 0, 0, 0, 0, 0, "")]
