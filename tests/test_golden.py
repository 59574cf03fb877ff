"""Golden rows, worked out by hand from the rules, and runs of the queries that SQL has no form for."""
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import edits as E
from palimpsest.functions import forum, naming
from palimpsest.operators import alignment, choose, contentfilter, diagnostics, ledger, pages
from palimpsest.operators import reportfiles as R
from palimpsest.plans.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("# A\n# A\ntext", "# A\ntext", 1),
        ("text\n# A\nmore", "text\n\n# A\n\nmore", 2),
        ("# A\n# A\n# A\nx", "# A\n\n# A\n\nx", 3),
        ("PART I\nPART I\n\nPART I", "PART I\n\n## PART I", 2),
        ("\nCHAPTER IV: Rain\n".upper(), "\n## CHAPTER IV: RAIN\n", 1),
        ("x\nCHAPTER IV\n\ny", "x\nCHAPTER IV\n\ny", 0),
        ("# A\n# B", "# A\n\n# B", 1),
        ("SHOUT\n\nSHOUT", "SHOUT\n\nSHOUT", 0),
        ("", "", 0),
        (None, None, None),
    ],
)
def test_headings(spark, text, want, n):
    got = one(spark, text, E.fix_headings)
    assert (got["text"], got["n"]) == (want, n) if text is not None else got is None or got["text"] in (None, "")


def test_headings_in_html(spark):
    got = one(spark, "<p>a</p><h2>b</h2>c<h1>d</h1><p>", lambda t: E.fix_headings(t, html=True))
    assert (got["text"], got["n"]) == ("<p>a</p><h2>b</h2>\nc\n<h1>d</h1><p>", 2)


@pytest.mark.parametrize(
    ("text", "want", "n"),
    [
        ("line one\n)\n\nnext", "line one\n\nnext", 1),
        ("a line\nof\nit", "a line of it", 2),
        ("a line\n)\nof", "a line\n) of".replace("\n)", " )"), 2),
        ("a line  \nit \nThe", "a line it\nThe", 1),
        ("a line\n\nof", "a line\n\nof", 0),
        ("\n-\nx", "\nx", 1),
        ("# H\nab", "# H ab", 1),
    ],
)
def test_orphans(spark, text, want, n):
    got = one(spark, text, E.fix_orphans)
    assert (got["text"], got["n"]) == (want, n)


def test_smart_quotes(spark):
    got = one(spark, 'He said "yes," and "no"\n"It\'s" (\'so\') don\'t', E.fix_smart_quotes)
    assert got["text"] == "He said “yes,” and “no”\n“It’s” (‘so') don’t" and got["n"] == 9


def test_masks_need_a_word_beside_them(spark):
    assert one(spark, "f**king cr*p sh*t S***x a**hole f*** !", E.unmask)["text"] == "fuckking crap shit shitx asshole f*** !"


def test_passes_in_order(spark):
    got = one(spark, "a    b ,c\n# H\nd\nof", E.apply_fixes)
    assert got["text"] == "a b,c\n\n# H\n\nd of" and got["counts"] == {"whitespace": 2, "smart_quotes": 0, "heading_formatting": 2, "paragraph_spacing": 1, "orphan_fragments": 0}
    assert one(spark, "a    b", lambda t: E.apply_fixes(t, ("orphan_fragments",)))["text"] == "a    b"


def test_chunks(spark):
    text = "One two three. Four five, six; seven eight. " + "w " * 7 + "end"
    assert one(spark, text, lambda t: E.chunks(t, 4)) == ["One two three.", "Four five, six;", "seven eight.", "w w w w", "w w w end"]
    assert one(spark, "", E.chunks) == []


@pytest.mark.parametrize(("text", "want"), [("256", ""), ("2 5 6", ""), ("256 Chapter 3 Machine-Level Representation", "Chapter 3 Machine-Level Representation"), ("2 5 6 Chapter 3 Machine", "Chapter 3 Machine"), ("3 Chapter 1 Introduction", "3 Chapter 1 Introduction"), ("This is body text.", "This is body text.")])
def test_page_debris(spark, text, want):
    assert one(spark, text, E.page_debris) == want


def test_stems_and_names(spark):
    assert one(spark, "Big Book - Smith, J.", E.book_stem) == "big book" and one(spark, "Foo - A: Subtitle", E.book_stem) == "foo a subtitle" and one(spark, "日本 - Öst", E.book_stem) == "日本"
    assert one(spark, "```json\n{}\n```", E.strip_fences) == "{}" and one(spark, ' a<b>:  "c" ', E.safe_filename) == "ab c"
    d = one(spark, "Andrew Scott Cooper - The Oil Kings (2011, Simon & Schuster) - libgen.li.pdf", naming.described)
    assert (d["title"], d["authors"], d["year"]) == ("The Oil Kings", "Andrew Scott Cooper", "2011")
    d = one(spark, "My Book Title -- John Doe -- Publisher -- 2020 -- Anna's Archive.epub", naming.described)
    assert (d["title"], d["authors"], d["publisher"], d["year"]) == ("My Book Title", "John Doe", "Publisher", "2020")
    d = one(spark, "(Great Books in Philosophy) A. Author - Title (1989).pdf", naming.described)
    assert (d["series"], d["authors"], d["title"]) == ("Great Books in Philosophy", "A. Author", "Title")
    t = one(spark, "(Great Books) A. Author - Title-Prometheus (1989).pdf", naming.title_and_author)
    assert (t["title"], t["author"]) == ("Title-Prometheus", "A. Author")
    assert one(spark, "x 1955 reprint 2003.pdf", naming.last_year) == "2003" and one(spark, "D:20190415120000", naming.first_year) == "2019"
    from palimpsest.functions.text import title_key

    key = spark.createDataFrame([("The Book of Ezekiel, Chapters 25-48", "Daniel I. Block"), ("Jesus and the Land", "Gary M. Burge"), ("The: x", None)], "t string, a string").select(title_key(F.col("t"), F.col("a"))).collect()
    assert [r[0] for r in key] == ["book ezekiel chapters 25 48 block", "jesus land burge", None]


def test_index_pieces_find_their_place():
    m = E.IndexMender(("genesis",))
    text = "\n\n".join(["body text here"] * 5 + ["Subject Index", "Grace, 12,", "14", "Hope, 3-", "5", "Love, 9", "genesis 1:3", "12 and more", "Plain words"])
    got, n = m.mend(text)
    assert got.split("\n\n")[5:] == ["Subject Index", "Grace, 12, 14", "Hope, 3-5", "Love, 9", "genesis 1:3 12 and more", "Plain words"] and n == 3
    assert m.mend("Index of things\n\nno entries at all\n\nhere") == ("Index of things\n\nno entries at all\n\nhere", 0) and m.mend(None) == (None, 0) and m.mend("") == ("", 0)


def test_reported_fixes(spark):
    issues = F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("description")) for c, t in (("toc_navigation", "missing anchors"), ("heading_formatting", "missing style"))))
    got = one(spark, "PART I\nsee Note 3 and note 3", lambda t: E.fix_reported(t, issues))
    assert got["text"] == '## PART I\nsee <a id="note3"></a>Note 3 and note 3' and got["n"] == 2


def test_tokens():
    t = ledger.Token()
    assert t.consume(5, 0) == "INVALID_OR_EXPIRED" and t.refund(5, 0) == "ledgered_only" and t.mint(10, 100) == "MINTED"
    assert [t.consume(20, 0), t.consume(21, 0), t.refund(22, 0), t.consume(23, 0), t.dispute(24, 0), t.consume(25, 0), t.refund(26, 0)] == ["OK", "ALREADY_USED", "reverse_consumed", "OK", "DISPUTED", "DISPUTED", "ledgered_only"]
    t = ledger.Token(expires_at=50)
    assert t.consume(50, 0) == "INVALID_OR_EXPIRED"


def test_token_states_follow_from_answers(spark):
    rows = [(1, 1, 1, "mint"), (1, 2, 2, "consume"), (1, 3, 3, "refund"), (2, 1, 4, "mint"), (2, 5, 5, "consume"), (2, 6, 6, "dispute"), (3, 1, 7, "consume")]
    a = ledger.token_answers(spark.createDataFrame(rows, "token long, ts long, seq long, action string"))
    assert {(r["token"], r["used"], r["disputed"]) for r in ledger.token_state(a).collect()} == {(1, False, False), (2, True, True), (3, False, False)}


def test_content_filter(spark):
    html = '<h1>Preface</h1><p>x</p><h2>Chapter 1</h2><p>a<sup><a href="#n1">1</a></sup><sup>2</sup> <a href="u">b</a> <a id="k" href="u">c</a></p><figure><img src=q></figure><blockquote>q</blockquote><blockquote><p>r</p></blockquote><h2>Notes</h2><p>n</p><h1>Index of names</h1><p>i</p>'
    got = one(spark, html, lambda t: contentfilter.filter_html(t, "text-only"))
    assert got["html"] == '<h2>Chapter 1</h2><p>a b <a id="k" href="u">c</a></p><p>q</p><p>r</p>'
    assert got["removed"] == {"footnotes": 3, "index": 1, "hyperlinks": 1, "front_matter": 1, "images": 1, "block_quotes": 2}
    assert one(spark, html, contentfilter.filter_html)["html"] == html
    assert one(spark, "a\n# Notes\nb\n## Part\nc\n# Index\nd", lambda t: contentfilter.filter_text(t, "clean-read")) == "a\n## Part\nc"


def test_alignment(spark):
    marks = spark.createDataFrame([(1, 0, "Chapter One 12", "it was the best of times"), (1, 1, "Nothing like it", "zzz"), (1, 2, "Chapter Two", "qqqq")], "doc_id long, place int, title string, body string")
    heads = spark.createDataFrame([(1, 0, "<b>Chapter One</b>", "It was the best of  times"), (1, 1, "Chapter Two", "other words wholly")], "doc_id long, place int, title string, body string")
    got = alignment.aligned(marks, heads)
    assert [(r["place"], r["heading"], r["status"]) for r in got.orderBy("place").collect()] == [(0, 0, "aligned"), (1, None, "unmatched"), (2, 1, "title_only")]
    assert alignment.alignment_scores(got).first()["score"] == 33


def test_forum_links(spark):
    post = """<article class="m" data-author="Ann" data-content="post-7"><time datetime="2024-03-01T10:00:00-0500"></time><div class="bbWrapper">See https://a.example.org/x). <a href="/local">no</a> <a href="https://b.example.org/p.png">img</a> <a href="https://c.example.org/story">A <b>story</b></a> and some more words to make it long enough to keep here</div> </div> </div> </article><span data-s9e-mediaembed-iframe='["x","https:\\/\\/s9e.github.io\\/iframe\\/2\\/twitter.min.html#99#theme=dark"]'></span>"""
    r = forum.posts(spark.createDataFrame([(1, "<html>" + post)], "page long, html string"), "html", "page").first()
    assert (r["username"], r["id"], r["date"]) == ("Ann", "post-7", "2024-03-01")
    assert [(x["url"], x["title"], x["source"]) for x in r["links"]] == [("https://c.example.org/story", "A story", "anchor"), ("https://a.example.org/x", "", "inline")]
    assert r["tweets"] == ["https://x.com/i/status/99"]
    assert str(one(spark, "2024-03-01T10:00:00-0500", forum.when_posted)) == "2024-03-01 10:00:00" and one(spark, "soon", forum.when_posted) is None


def test_patterns_and_status(spark):
    base = dict(book_id=1, filename="a.pdf", source_type="scan", format="en", chapter_count=0, only_backmatter=False, ligature_splits=21, footnotes_unlinked=11, footnotes_linked=0, vqa_attempted=True, vqa_score=59, vqa_threshold=None, extraction_success=True, kfx_attempted=True, kfx_success=None, page_numbers=6, italic_tags=0, bold_tags=0, word_count=90, double_spaces=21, errors="PDF is Encrypted", has_non_latin=True, non_latin_pct=6, extraction_path=None, column_confidence=0.3, text_layer_score=40, encoding_fixes=11, file_size=1, cost_cents=0)
    types = ", ".join(f"{k} {'string' if k in ('filename', 'source_type', 'format', 'errors', 'extraction_path') else 'boolean' if k in ('only_backmatter', 'vqa_attempted', 'extraction_success', 'kfx_attempted', 'kfx_success', 'has_non_latin') else 'double' if k == 'column_confidence' else 'long'}" for k in base)
    r = diagnostics.diagnose(spark.createDataFrame([tuple(base.values())], types)).first()
    assert [i["pattern"] for i in r["issues"]] == ["CHAPTER_DETECTION_ZERO", "LIGATURE_SPLITS_HIGH", "FOOTNOTES_UNLINKED", "VQA_SCORE_LOW", "PAGE_NUMBERS_PRESENT", "DOUBLE_SPACES", "LIKELY_SCAN_NO_OCR", "DRM_ENCRYPTED", "MULTI_SCRIPT_NO_VISION", "ENCODING_FIXED"]
    assert r["status"] == "FAIL" and r["reason"] == "score far below"


def test_small_verdicts(spark):
    got = one(spark, "x", lambda t: R.aligned(F.array(F.lit(5), F.lit(6)), F.array(*(F.struct(F.lit(p).alias("page_number"), F.lit(s).alias("score")) for p, s in ((1, 10), (2, 20), (3, 30))))))
    assert [(x["page_number"], x["score"]) for x in got] == [(5, 10), (6, 20), (3, 30)]
    assert one(spark, "a b", lambda t: pages.readable_bookmark(t)) and not one(spark, "7", lambda t: pages.readable_bookmark(t)) and not one(spark, None, lambda t: pages.readable_bookmark(t))
    assert one(spark, "x" * 10, lambda t: choose.debris(t)) == 0.0 and one(spark, "{a b", lambda t: choose.debris(t)) == 0.5
    assert one(spark, "", lambda t: choose.debris(t)) == 0.0


def voice(spark, paragraphs, parts=(), chapters=(), **kw):
    from palimpsest.functions import speech

    ints = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    return spark.createDataFrame([(paragraphs,)], "p array<string>").select(speech.voiced(F.col("p"), ints(parts), ints(chapters), **kw)).first()[0]


def test_voice_marks(spark):
    from palimpsest.functions import speech

    P, sapi = speech.PAUSES, lambda ms: f'<silence msec="{ms}"/>'
    assert voice(spark, ["Part One", "Chapter Two", "Body."], [0], [1]) == ["PART ONE" + sapi(P["part"]), "CHAPTER TWO" + sapi(P["chapter"]), "Body."]
    assert voice(spark, ["Body text.", "***", "More body text."]) == ["Body text." + sapi(P["scene"]), "More body text."]
    assert voice(spark, ["He walked into the room. He was alone."]) == ['He walked into the room. <rate speed="-1">He was alone.</rate>' + sapi(P["closer"])]
    assert voice(spark, ["He walked. He was alone.", "***"]) == ['He walked. <rate speed="-1">He was alone.</rate>' + sapi(P["scene"])]
    assert voice(spark, ["Chapter One", "He walked. He was alone."], (), [0], syntax="universal") == [f"CHAPTER ONE{{{{Pause={P['chapter']}}}}}", f"He walked. He was alone.{{{{Pause={P['closer']}}}}}"]
    assert voice(spark, ["Chapter One", "***", "Body text."], (), [0], options=()) == ["CHAPTER ONE", "***", "Body text."]
    assert voice(spark, ["The king arrived—his last refuge--before nightfall.", "See pages 10–20.", "The Paris–London express.", "a well-known one", '<silence msec="300"/>']) == [f"The king arrived{sapi(250)}his last refuge{sapi(250)}before nightfall.", "See pages 10–20.", f"The Paris{sapi(150)}London express.", "a well-known one", '<silence msec="300"/>']


@pytest.mark.parametrize(("text", "want"), [("He walked into the room. The doors were closed. He was alone.", "He was alone."), ("He was alone.", None), ("He walked in. Was he alone?", None), ('He sat down. "He was alone."', None), ("He sat down. He froze.", None), ("He walked into the room. HE WAS ALONE.", None), ("He looked around. He was free!", "He was free!"), ("He walked in. " + "word " * 18 + "end.", None)])
def test_closers(spark, text, want):
    from palimpsest.functions import speech

    assert one(spark, text, speech.closer) == want


def test_spoken_spans_and_spaced_letters(spark):
    from palimpsest.functions import speech
    from palimpsest.operators.bookheads import joined_letters, sampled_pages, scene_break

    assert one(spark, 'He said, "I never meant for this to happen." She nodded.', speech.spoken) == ["I never meant for this to happen."]
    assert one(spark, 'She said "no" firmly. The sign read "1234, 5678, 9012." “This changes everything.”', speech.spoken) == ["This changes everything."]
    j = lambda t: joined_letters(t, ("wilson", "paris", "exact"))
    assert one(spark, "W i l s o n in P a r i s", j) == "Wilson in Paris" and one(spark, "W i ls on in P a r i s", j) == "W i ls on in Paris"
    for same in (". . . . . . .", "a b", "U S A", "The quick brown fox"):
        assert one(spark, same, j) == same
    for yes in ("***", "* * *", "###", "---", "———", "— — —", "⁂", "~", "# # #"):
        assert one(spark, yes, scene_break), yes
    for no in ("", "Some text.", None):
        assert not one(spark, no, scene_break)
    assert sampled_pages(0) == [] and sampled_pages(5) == [1, 2, 3, 4, 5] and sampled_pages(100, 8) == sorted(sampled_pages(100, 8)) and len(sampled_pages(100, 8)) == 8 and sampled_pages(100, 8)[:3] == [1, 2, 3]
