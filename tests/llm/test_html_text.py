import pytest

from tracewell.llm import html_text as h

ARTICLE = ["A headline of the page", "First paragraph, with a comma. And more text in it & so on.", "Second one; it is long enough to stand, too."]


def page(article, i=0):
    blocks = f"<h1>{article[0]}</h1>" + "".join(f"<p>{b.replace('&', '&amp;')}</p>" for b in article[1:])
    return (
        f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><ul>"
        f"<li><a href='/a'>home {i}</a></li><li><a href=/b>news</a></li></ul></nav><!-- ad --><div class=\"ad\">Buy this now.</div>"
        f"<article>{blocks}</article><div id=comments><p>I say, nice.</p></div><footer>&copy; me</footer></body></html>"
    )


@pytest.fixture(scope="module")
def forest():
    return h.train([page([f"Headline {i}", *[f"Paragraph {k} of page {i}, with words. It goes on, and on." for k in range(1 + i % 6)]], i) for i in range(60)])


def text(forest, source):
    p = h.Page(source)
    return p.main_text(forest.score(p.features()))


def test_article_without_its_surroundings(forest):
    assert text(forest, page(ARTICLE)) == "\n\n".join(ARTICLE)


def test_other_structures(forest):
    made = h.Layouts([ARTICLE, [*ARTICLE, "A third paragraph, which closes it."]], ["home", "about us", "imprint"], 7)
    right = 0
    for _ in range(60):
        source = made.page()
        p = h.Page(source)
        right += text(forest, source) == "\n\n".join(t for t, m in zip(p.text, p.label, strict=True) if t and m)
    assert right >= 54


def test_parser():
    runs = lambda s: [t for t in h.Page(s).text if t]
    assert runs("<p>a<b>b<p>c<br>d &amp;amp; \n\t e&nbsp;f") == ["ab", "c d &amp; e f"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul></ul>") == ["a", "b", "c"]
    assert runs("<script>x<p></script>y<!-- z") == ["y"]
    assert runs("") == []
    assert runs("a < b <a title='>'>c</a>") == ["a < b c"]
    assert runs("</p></div>x") == ["x"]
    deep = "<div>" * 5_000 + "x"
    assert runs(deep) == ["x"]
    h.Page(deep).features()


def test_decoding_keeps_ancestors(forest):
    import numpy as np

    p = h.Page("<div><p>one</p></div><div><p>two</p></div>")
    score = np.array([3.0 if t is None else -1.0 for t in p.text])
    score[p.text.index("one")] = 2.0
    assert p.main_text(score) == "one"
    score[0] = -99.0
    assert p.main_text(score) == ""


def test_rows(spark, forest):
    rows = [(1, "u", page(ARTICLE)), (1, "u", page(ARTICLE)), (None, None, None), (2, "u", ""), (3, "u", "x" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' AS text")
    out = h.extract(pages, forest).collect()
    assert [r.text for r in out[:4]] == ["\n\n".join(ARTICLE)] * 2 + ["", ""]
    assert h.extract(pages.limit(0)).collect() == []
