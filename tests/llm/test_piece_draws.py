"""Each occurrence of a word draws its own dropout."""
import math

from palimpsest.llm import piece_dropout


def test_occurrences_draw_for_themselves():
    n, share = 40_000, 0.1
    word = "▁international"
    candidates = piece_dropout.with_skips([(word, 0)])[0][2]
    texts = [" ".join(["international"] * (n // 4))] * 4
    enc = piece_dropout.Encoder(share, 1)
    got = enc.encode(texts, [0, 1, 2, None])
    assert len({ids.tobytes() for ids, _ in got}) == 4
    forms = {k for k in enc.cache if k[0] == word}
    assert len(forms) > 4 * 4 and all(piece_dropout.decode(ids) == t for t, (ids, _) in zip(texts, got, strict=True))
    plain = piece_dropout.Encoder(0.0, 1).encode(["international"], [0])[0][0].tobytes()
    whole = sum(ids.tobytes().count(plain) for ids, _ in got) if len(plain) > 2 else sum((ids == int.from_bytes(plain, "little")).sum() for ids, _ in got)
    want = (1 - share) ** candidates  # no candidate skipped
    assert whole / n >= want - 5 * math.sqrt(want * (1 - want) / n)
    unskipped = sum(1 for k in range(2000) if piece_dropout.encode_word(word, share, 1, k)[1] == 0) / 2000
    assert abs(unskipped - want) < 5 * math.sqrt(want * (1 - want) / 2000)


def test_words_with_one_merge_vary_at_the_share():
    word = next(t for t in piece_dropout.pieces().id if len(t) == 2 and t[0] == piece_dropout.MARK and t[1].isalpha())
    n, share = 50_000, 0.1
    ((ids, skipped),) = piece_dropout.Encoder(share, 1).encode([" ".join([word[1]] * n)], [5])
    assert abs(skipped / n - share) < 5 * math.sqrt(share * (1 - share) / n) and len(ids) == n + skipped


def test_documents_and_caches_do_not_matter():
    texts = ["of the international station " * 50, "supercalifragilistic, " * 30 + "x" * 300, None, "the station."]
    together = piece_dropout.Encoder(0.3, 1).encode(texts, [1, 2, 3, 4])
    tiny = piece_dropout.Encoder(0.3, 1, 2)
    for t, d, (ids, skipped) in zip(texts, [1, 2, 3, 4], together, strict=True):
        (other, n), = tiny.encode([t], [d])
        assert (other == ids).all() and n == skipped
