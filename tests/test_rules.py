"""Rules whose rows the tables do not reach, and names by the thousand."""
from pyspark.sql import functions as F

from palimpsest.operators import audit, choose, contentfilter, pages


def test_names_by_the_thousand(spark):
    books = spark.range(30_000).select((F.col("id") + 1).alias("book_id"), F.concat(F.lit("The Book no. "), F.col("id").cast("string"), F.lit(" of all")).alias("title"))
    wanted = spark.range(20_000).select(F.concat(F.lit("BOOK NO. "), F.col("id").cast("string"), F.lit(" ")).alias("name"))
    got = {r["name"]: r["book_id"] for r in audit.found_by_name(wanted, books).collect()}
    assert len(got) == 20_000 and all(got[f"BOOK NO. {k} "] == k + 1 for k in range(0, 20_000, 777))
    odd = spark.createDataFrame([("of",), ("",), (None,), ("q",), ("The Book no. 5 of all",), ("k no. 29999",), ("nowhere",)], "name string")
    got = {r["name"]: (r["book_id"], r["way"]) for r in audit.found_by_name(odd, books).collect()}
    assert got == {"of": (30_000, 1), "The Book no. 5 of all": (6, 0), "k no. 29999": (30_000, 1)}
    assert audit.found_by_name(odd, books.limit(0)).count() == 0 and audit.found_by_name(odd.limit(0), books).count() == 0


def test_matter_before_and_behind(spark):
    def left(html, profile):
        return spark.createDataFrame([(html,)], "html string").select(contentfilter.filter_html(F.col("html"), profile).alias("f")).first()["f"]["html"]

    body = "<h1>One</h1><p>text</p>"
    assert left(f"{body}<h2>About the Author</h2><p>me</p>", "text-only") == body
    assert left(f"{body}<h2>About the  authors</h2><p>us</p>", "text-only") == body
    assert left(f"<h1>Preface</h1><p>p</p><h1><img></h1><h1>Foreword</h1><p>f</p>{body}", "clean-read") == f"<h1><img></h1><h1>Foreword</h1><p>f</p>{body}"
    assert left(f"<p>x</p><h1>Preface</h1><p>p</p>{body}", "clean-read") == f"<p>x</p>{body}"


def test_fonts_beyond_the_list(spark):
    rows = [(1, f"A{k:02d}") for k in range(40)] + [(1, "Zed+Wingdings-Regular"), (1, "Type3"), (2, "Plain"), (2, None), (3, None)]
    got = {r["doc_id"]: r for r in pages.font_inventory(spark.createDataFrame(rows, "doc_id int, font_name string")).collect()}
    assert (got[1]["n_fonts"], len(got[1]["fonts"]), got[1]["risky_fonts"], got[1]["risky"]) == (42, 30, ["Zed+Wingdings-Regular"], True)
    assert (got[2]["fonts"], got[2]["risky"]) == (["Plain"], False) and 3 not in got


def test_uploads_and_recipients(spark):
    def of(column, *rows):
        return [r[0] for r in spark.createDataFrame(rows, "header string, name string, size long, tier string, output string").select(column).collect()]

    verdict = choose.upload_verdict(*(F.col(c) for c in ("header", "name", "size", "tier", "output")))
    rows = [("%PDF-1", "a", 5, "free", "epub"), ("ï»¿%PDF", "a", 5, "free", "epub"), ("PK\x03\x04", "a.exe", 5, "premium", "kfx"), ("text", "A.AZW3", 5, "free", "mobi"), ("\x89PNG", "a.mobi", 5, "free", "epub"), ("text", None, 5, "free", "epub"), (None, "a.mobi", 0, "free", "epub"), ("%PDF", "a", 21 << 20, "free", "epub"), ("%PDF", "a", 21 << 20, "premium", "epub"), ("%PDF", "a", 5, "free", "kfx"), ("%PDF", "a", 5, "free", None)]
    assert of(verdict, *rows) == ["ok", "ok", "ok", "ok", "INVALID_MIME", "INVALID_MIME", "EMPTY_FILE", "FILE_TOO_LARGE", "ok", "INVALID_OUTPUT_FORMAT", "INVALID_OUTPUT_FORMAT"]
    form, domain = "INVALID_RECIPIENT_FORM", "INVALID_RECIPIENT_DOMAIN"
    said = {" X@Kindle.com ": "ok", "x@free.kindle.com": "ok", "<x@kindle.com>": form, "x @kindle.com": form, "(c)x@kindle.com": form, "Bob <x@kindle.com>": form, "a+b@kindle.com": form, "@kindle.com": form, "x": form, "": form, "x@evil-kindle.com": domain, "x@kindle.com.org": domain}
    d = spark.createDataFrame([(k,) for k in said], "a string").select("a", choose.recipient_verdict(F.col("a")).alias("v"))
    assert {r["a"]: r["v"] for r in d.collect()} == said


def test_reports_as_files(spark, tmp_path):
    from palimpsest.operators import diagnostics, written
    from palimpsest.sources.tables import view

    d = diagnostics.diagnose(view(spark, "/root/testdata/sf0.001", "diags_v").withColumn("filename", F.when(F.col("book_id") == 3, "a <b> & c | d" + "x" * 50).otherwise(F.col("filename"))))
    v = spark.createDataFrame([("f", (1.5, 80.0, True, 0.25)), ("g", (1.0, 90.0, False, 0.5))], "filename string, v struct<std_dev: double, mean: double, high_variance: boolean, worst_position: double>")
    runs = spark.createDataFrame([("r1", 3, 2, 66.7)], "run_id string, total int, passed int, pass_rate double")
    rows = written.report(d, "one", v, runs)
    for form, name in (("markdown", "md"), ("html", "html")):
        written.write(rows, str(tmp_path / name), form)
    text = "\n".join(p.read_text() for p in sorted((tmp_path / "md").glob("part-*")))
    page = "\n".join(p.read_text() for p in sorted((tmp_path / "html").glob("part-*")))
    assert text.startswith("# Batch report one\nBooks processed: 200 |") and "- f: std_dev=1.5, mean=80.0, worst section at 25%" in text and "| r1 | 3 | 2 | 66.7 |" in text
    assert "| a <b> & c \\| d" in text and "<td>a &lt;b&gt; &amp; c | d" in page and "..." in text
    assert text.index("### ") < text.index("| 90-100") < text.index("| doc1.pdf") and "- g" not in text
    none = written.markdown(written.report(d.limit(0), "none")).collect()
    assert [r["line"] for r in none][:2] == ["# Batch report none", "Books processed: 0 | Passed: 0 | Warnings: 0 | Failed: 0 | Errors: 0  "]
