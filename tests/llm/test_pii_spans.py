"""Secrets and keys of any length, and selected spans that overlap base ones."""
import random

from palimpsest.llm import pii


def test_long_secrets_are_whole(spark):
    rng = random.Random(2)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    long = draw("abcdefghijklmnopqrstuvwxyz0123456789", 900)
    key = "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 300)
    texts = [f"wh password={long} enes", f"the key {key} end", "q" * 20_000 + " " + "token=" * 20_000, "A_" * 30_000 + "b"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r[0]: r[1] for r in pii.find_pii(d).select("doc_id", pii.told("spans")).collect()}
    assert spans[0] == f"secret:3:{12 + len(long)}" and spans[1] == f"secret:8:{8 + len(key)}"
    red = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert red[0] == "wh [SECRET] enes" and red[1] == "the key [SECRET] end"


def test_selected_spans_may_overlap_base_ones(spark):
    secret = "password=ab7db7aa4a5f:user@host.example:9f8e7d6c5b4a"
    iban = "DE384111111111111111" + "00"
    texts = [f"wh {secret} enes", f"iban {iban} enes", "card 4111-1111-1111-1111 enes"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(d).select("doc_id", "base", pii.told("spans").alias("s")).collect()}
    assert [b["kind"] for b in got[0]["base"]] == ["email"] and f"secret:3:{3 + len(secret)}" in got[0]["s"].split(",")
    assert got[2]["s"].split(",").count("card:5:24") == 1
    assert pii.redact(d).where("doc_id = 0").first()["text"] == "wh [SECRET] enes"


def test_very_many_spans_and_long_addresses(spark):
    many = " ".join(f"u{k}@ho{k % 97}.example.com and" for k in range(50_000))
    spelt = "a" * 90 + " [at] " + "b" * 80 + " [dot] example"
    phones = " ".join(f"+1 (988) 555-{k % 10_000:04d} call 988-555-{k % 10_000:04d}," for k in range(20_000))
    d = spark.createDataFrame([(1, many), (2, f"mail {spelt} now"), (3, phones), (4, "😀 a@b.co é a@b.co"), (5, "")], "doc_id long, text string")
    red = {r["doc_id"]: r["text"] for r in pii.redact(d).collect()}
    assert red[1] == " ".join(["[EMAIL] and"] * 50_000)
    assert red[2] == "mail [EMAIL] now"
    assert red[3] == " ".join(["[PHONE] call [PHONE],"] * 20_000)
    assert red[4] == "😀 [EMAIL] é [EMAIL]" and red[5] == ""


def test_counter_words_count_only_beside_a_span(spark):
    taken = ["she said to call 555-123-4567", "we did call him at 555-123-4567", "the department's phone 415-555-0123", "share my number 555-123-4567 please", "his ssn, he said, is 123-45-6789", "the id is bob and password=hunter2secret", "write to bob [at] example [dot] com", "in part because 415.555.0123 rang", "iban DE89 3704 0044 0532 0130 00 it is"]
    left = ["order no. 555-123-4567 came", "serial: 123-45-6789", "part 555-123-4567", "sha AB12CD34EF56GH78IJ90", "the range 000-12-3456 ends", "call CONSTANT_NAME_HERE_X now"]
    d = spark.createDataFrame(list(enumerate(taken + left)), "doc_id long, text string")
    spans = {r[0]: r[1] for r in pii.find_pii(d).select("doc_id", pii.told("spans")).collect()}
    assert all(spans[k] for k in range(len(taken))), [taken[k] for k in range(len(taken)) if not spans[k]]
    assert not any(spans[len(taken) + k] for k in range(len(left))), [(left[k], spans[len(taken) + k]) for k in range(len(left)) if spans[len(taken) + k]]
