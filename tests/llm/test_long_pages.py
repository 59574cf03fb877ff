"""Pages with very many blocks or tags that never end, and elements whose text is not thrown away."""
import time
import tracemalloc

import pyarrow.parquet as pq
import pytest

from palimpsest.llm import html_blocks, html_labeller


@pytest.mark.parametrize("piece", ["<a b", '<a title="x ', "<b>", "<p>a", "x < y <3 ", "<!-- x", "<!x", '"<a', "</i></b>", "<a \"'>", "<li><b>"])
def test_fifty_thousand_tags_in_seconds(piece):
    began = time.perf_counter()
    html_blocks.blocks(piece * 50_000)
    assert time.perf_counter() - began < 10


def test_only_scripts_and_styles_are_no_text():
    page = "<article><p>see <math>x</math> here</p><noscript><p>plain</p></noscript><object>seen</object><script>no<b</script><style>no</style></article>"
    assert [b.text for b in html_blocks.blocks(page)] == ["see x here", "plain", "seen"]


def test_tags_end_outside_quotes():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts('a <b c="d>e">f</b> g') == ["a f g"]
    assert texts('<p>1 <a "x>2') == ['1 <a "x>2']
    assert texts("1 < 2 <3 <p>4") == ["1 < 2 <3", "4"]
    assert texts("<p>x<!-- y > --> z<!-- never ends <p>q") == ["x z"]


def test_a_long_page_beside_short_ones_takes_little_memory():
    long = html_blocks.blocks("<body><article>" + "<p>some words here and there.</p>" * 20_000 + "</article>")
    short = [html_blocks.blocks("<nav><ul><li><a href=x>Home</a></li></ul></nav><article><p>hello there, world.</p></article>")] * 63
    weights = html_labeller.trained()
    tracemalloc.start()
    got = html_labeller.label_pages(weights, [long, *short])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6 and got[0].all() and all((x == got[1]).all() for x in got[1:])


def test_labels_do_not_depend_on_the_batch():
    pages = [html_blocks.blocks(h) for h in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()[:80]]
    weights = html_labeller.trained()
    a, b = html_labeller.label_pages(weights, pages), html_labeller.label_pages(weights, pages, cells=1)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))
