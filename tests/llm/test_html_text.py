import numpy as np

from weft.llm.html_text import extract_text, main_text, smoothed, threshold

PARAGRAPHS = ["A first paragraph of running text, long enough to count as dense.", "A second one &amp; it has an <b>odd</b>\n  <i>tag</i> or two in its sentences.", "Short."]
WANT = "Title\nA first paragraph of running text, long enough to count as dense.\nA second one & it has an odd tag or two in its sentences.\nShort."


def test_article_among_furniture():
    body = "<h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    html = f"<html><head><title>x</title><style>p{{}}</style><script>var t='</p><p>no';</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy now, buy now, buy now, buy now.</div><article>{body}<aside>More</aside></article><footer>&copy; me</footer>"
    assert main_text(html) == WANT
    assert main_text(html.replace("</p>", "")) == WANT
    assert main_text(html.replace("<article>", "<form><article>")) == WANT


def test_page_without_article():
    body = "<h1>Title</h1>" + "".join(f"<p>{p}" for p in PARAGRAPHS)
    html = f"<body><div id=cookie-notice>We use cookies.</div><header><a href=/>Home</a></header><div><div class=content>{body}</div><div class=sidebar><ul><li><a>One</a></ul></div><div id=comments><p>Nice post, thank you so much for writing all of this about things.</div></div><footer>x</footer>"
    assert main_text(html) == WANT


def test_unequal_paragraphs_without_article():
    texts = [f"{k} " + "word " * (1000 if k == 5 else 60) + "end." for k in range(11)]
    for tag in ("div", "li", "blockquote", "pre", "td", "p"):
        body = "".join(f"<{tag}>{t}</{tag}>" for t in texts)
        html = f"<body><nav><a href=/>Home</a></nav><div><ul><li><a href=/a>Some other page</a></ul><div class=content>{body}</div><div class=sidebar>More</div></div><footer>x</footer>"
        assert main_text(html) == "\n".join(texts)
    nested = "".join(f"<div><p>{t}</p><p>{t}</p><p>{t}</p></div>" for t in texts)
    assert main_text(f"<body>{nested}</body>") == "\n".join(t for t in texts for _ in range(3))


def test_odd_input(spark):
    assert main_text(None) == main_text("") == main_text("<p> </p>") == main_text("<script>x") == ""
    assert main_text("just text") == "just text"
    assert main_text("<article><p>cut off &am") == "cut off &am"
    rows = [(1, "u", "<p>a</p>", 1), (1, "u", "<p>a</p>", 2), (2, None, None, 3), (3, "v", "<div>" * 3000 + "deep" + "</div>" * 3000, 4)]
    got = sorted(map(tuple, extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()), key=str)
    assert got == [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0), (3, "v", "deep", 4)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_page():
    html = "<article>" + "<p>word word word</p>" * 50_000 + "</article>"
    assert main_text(html).count("\n") == 49_999


def test_clustering():
    assert threshold(np.array([1.0, 1.0])) == -np.inf
    assert 2 < threshold(np.array([1.0, 2.0, 9.0, 10.0])) < 9
    assert np.allclose(smoothed(np.ones(7)), 1)


def test_deep_nesting_takes_time_in_proportion():
    import time

    def took(n):
        html = "<div>" * n + "".join(f"<b><i>word {k}</i>" for k in range(n)) + "</div>" * n
        began = time.process_time()
        assert main_text(html).startswith("word 0word 1")
        return time.process_time() - began

    took(500)
    assert took(16_000) < 20 * max(took(2_000), 0.02)


def test_link_paragraph_of_running_text():
    text = "A sentence that runs on for a while, so that it is plainly part of the article and no menu."
    html = f"<div><p>{text} One.</p><p><a href=x>The whole paragraph is one link here.</a></p><p>{text} Two.</p></div><p><a href=y>Elsewhere</a></p>"
    assert main_text(html) == f"{text} One.\nThe whole paragraph is one link here.\n{text} Two."
