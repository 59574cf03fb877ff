"""What is told of each line does not grow with the number of lines of its text."""
from pyspark.sql import functions as F

from palimpsest.functions import edits as E
from palimpsest.functions.lines import latest


def test_marks_are_computed_once(spark):
    """The expression of the marks stands once in the plan, and not in each block's slice."""
    d = spark.createDataFrame([("a\nb\nb",)], "t string")
    marks = F.transform(F.split("t", "\n"), lambda x, i: F.when(x.rlike("^zzz$"), i).otherwise(-1))
    made = d.select(latest(marks).alias("x"))
    assert made.first()["x"] == [-1, -1, -1]
    assert made._jdf.queryExecution().analyzed().toString().count("zzz") == 1


def test_headings_among_odd_lines(spark):
    rows = {"# A\n# A\n\n  # B\u2003\nx": "# A\n\n  # B\u2003\n\nx", "\u00a0PART II\u00a0\n\n# A": "## PART II\n\n# A", "PREFACE\nx": "PREFACE\nx", "é\n# É\n# É\n# É": "é\n# É\n\n# É"}
    d = spark.createDataFrame([(k,) for k in rows], "t string")
    assert {r["t"]: r["x"] for r in d.select("t", E.fix_headings(F.col("t"))["text"].alias("x")).collect()} == rows
    quoted = spark.createDataFrame([("\"a\" b's",), ("no marks",), ("it's",), (None,)], "t string").select(E.fix_smart_quotes(F.col("t")).alias("f")).select("f.*").collect()
    assert [tuple(r) for r in quoted] == [("“a” b’s", 3), ("no marks", 0), ("it’s", 1), (None, 0)]
