"""Pages in layouts written by hand, which no generator made: texts compared."""
import pytest

from palimpsest.llm import html_labeller


def say(n, k=0):
    return " ".join(f"word{(i * 7 + k) % 50}" for i in range(n)) + "."


BODY = [say(30 + i * 9, i) for i in range(4)]
ARTICLE = "<h1>Head line here</h1>" + "".join(f"<p>{x}</p>" for x in BODY)
NAV = '<div class="nav"><ul><li><a href="#">Home</a></li><li><a href="#">News</a></li><li><a href="#">About us</a></li></ul></div>'
FOOT = '<div class="footer"><p>Copyright 2020 someone. All rights.</p></div>'
PAGES = {
    "named in camel case": f'<html><head><title>T</title></head><body>{NAV}<div id="bodyContent">{ARTICLE}</div>{FOOT}</body></html>',
    "a thread below": f'<html><body>{NAV}<article>{ARTICLE}</article><div id="disqus_thread"><p>Great post, I agree with all of it.</p><p>Thanks for writing this one down.</p></div>{FOOT}</body></html>',
    "cells of a table": f'<html><body><table><tr><td class="nav"><a href="a">Home</a><br><a href="b">News</a></td><td>{ARTICLE}</td></tr></table></body></html>',
    "columns and an overlay": f'<html><body><header><p>Site name</p></header>{NAV}<main>{ARTICLE}</main><div class="right-col"><h3>Most read</h3><ul><li><a href="x">One story</a></li></ul></div><div class="gdpr-overlay"><p>We use cookies on this site.</p><button>Accept</button></div>{FOOT}</body></html>',
    "nothing else": f"<html><body>{ARTICLE}</body></html>",
    "replies below": f'<html><body>{NAV}<div class="story-text">{ARTICLE}</div><div class="replies"><p>Nice one, thanks for it.</p><p>I do not agree at all here.</p></div>{FOOT}</body></html>',
}


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(k, n, h) for k, (n, h) in enumerate(PAGES.items())]
    return {r["url"]: r["text"] for r in html_labeller.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("name", PAGES)
def test_text_of_the_article(texts, name):
    assert texts[name] == "\n".join(["Head line here", *BODY])


def test_whole_table_against_its_own_tags(spark):
    """The tables' pages hold one article element each; its blocks, and no others, are the text."""
    import pyarrow.parquet as pq

    from palimpsest.llm import html_blocks, queries

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    got = {r["page_id"]: r["text"] for r in queries.op6_html_labeller(spark, "/root/testdata/sf0.01").collect()}
    for p in pages:
        assert got[p["page_id"]] == "\n".join(b.text for b in html_blocks.blocks(p["html"]) if "article" in b.path and not {"aside", ".comments", ".ad", "form"} & set(b.path)), p["page_id"]


@pytest.mark.parametrize(("share", "least"), [(0.5, 0.94), (1.0, 0.9)])
def test_names_that_are_unknown(share, least):
    """New pages whose names are unknown or gone: words, links, lengths and neighbours tell."""
    import numpy as np

    rng = np.random.default_rng(77)
    made = [html_labeller._made_page(rng, share) for _ in range(200)]
    got = html_labeller.label_pages(html_labeller.trained(), [p for p, _ in made])
    assert np.mean(np.concatenate(got) == np.concatenate([np.array(y, bool) for _, y in made])) > least
