"""Golden rows of text expressions and of the boolean query compiler."""
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import lines as L
from palimpsest.functions import text as T


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_golden(spark):
    assert one(spark, "<b>Hello</b> world", T.normal_heading) == "hello world" and one(spark, "some text 42", T.normal_heading) == "some text"
    assert one(spark, "ISBN 978-0-306-40615-7", T.valid_isbn) and not one(spark, "123", T.valid_isbn) and one(spark, None, T.valid_isbn) is False
    assert one(spark, "http://wow.com/x", T.host_of) == "ow.com"
    assert one(spark, "a     b ,c\t\n\n\n\n\nd", lambda t: T.fix_whitespace(t)["text"]) == "a b,c\n\n\nd"


@pytest.mark.parametrize(("text", "want", "n"), [("One, \n  two\nThree.\nfour", "One, two\nThree.\nfour", 1), ("# head\nsmall", "# head\nsmall", 0), ("A\n\nb\n c \nd", "A\n\nb c d", 2), ("", "", 0), (None, None, None), ("x", "x", 0)])
def test_merge_continuations(spark, text, want, n):
    got = one(spark, text, L.merged)
    assert (got["text"], got["n_merged"]) == (want, n)


def test_merge_continuations_in_a_long_text(spark):
    got = one(spark, "Begin\n" + "so it goes\n" * 50_000 + "on", L.merged)
    assert got["n_merged"] == 50_001 and "\n" not in got["text"]


def test_counts_of_words_and_torn_letters(spark):
    import re

    odd = ["", " ", "\n", "a", " a", "a ", "\ta\x0bb \n", "a b", "　a b", "th e", "Th e the re", "with e", "fi x fl y", "f i x", "fi fl x", "th\ne", "of i x", "th at th ey", "word " * 9 + "fi n"]
    d = spark.createDataFrame([(t,) for t in [*odd, None]], "t string")
    got = {r["t"]: (r["w"], r["n"]) for r in d.select("t", T.word_count(F.col("t")).alias("w"), T.penalties(F.col("t"))["n_ligatures"].alias("n")).collect()}
    plain = re.compile(r"\b[Tt]h (?:e|is|at|ey|en|ere|ose|us|an|eir|em|ese)\b|\bf(?:i|l|fi|fl) [a-z]")
    for t in odd:
        assert got[t] == (len(t.split()), len(plain.findall(t))), t
    assert got[None] == (None, None)
