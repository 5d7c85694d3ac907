from awardforge.llm import html

SCHEMA = "page_id long, url string, html string, text string"


def page(k, body, host="h.example"):
    return (k, f"http://{host}/{k}", body, "clash")


def framed(k, content):
    return f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var t="</p>x";</script></head><body>
    <nav><ul><li><a>n{k}</a></li></ul></nav><header>Site</header><!-- c --><div class="ad">buy {k}</div>{content}
    <div id="comments"><p>reader {k}</p></div><form>mail</form><footer>&copy; x</footer></body></html>"""


def test_parts_of_a_page():
    body = framed(1, "<article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>x<i>y</i>z<aside>side</aside><ul><li>l1<li>l2</ul><footer>f</footer></article>")
    assert html.main_text(body, []) == "A & B\none two three\nxyz\nl1\nl2"
    assert html.main_text(body[: body.index("<ul><li>l1") + 9], []) == "A & B\none two three\nxyz\nl"
    assert html.main_text(None, []) == "" == html.main_text("", [])
    assert html.main_text("plain &lt;text&gt;", []) == "plain <text>"
    assert html.main_text("<div class='sidebar'>s</div><main><p>m<div class='cookie-notice'>c</div></main><p>out", []) == "m"


def test_template_of_pages_without_a_main_element(spark):
    words = ["red", "green", "blue", "black", "white"]
    pages = [page(k, f"<html><body><div><b>Welcome to our site</b></div><div><p>story {w} {k}</p><p>more {w}</p></div><div>All rights reserved</div></body></html>") for k, w in enumerate(words)]
    pages += [page(10, "<div>Welcome to our site</div><p>alone</p>", "other.example"), (11, None, "<p>no url", None), (12, "::bad", None, None), page(0, pages[0][2])]
    df = spark.createDataFrame(pages, SCHEMA).repartition(3)
    out = html.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    rows = out.collect()
    assert sorted((r.page_id, r.text) for r in rows) == sorted([(k, f"story {w} {k}\nmore {w}") for k, w in enumerate(words)] + [(10, "Welcome to our site\nalone"), (11, "no url"), (12, ""), (0, "story red 0\nmore red")])
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html.extract(df.limit(0)).count() == 0


def test_names_that_only_speak_of_what_is_beside():
    for name in ("content with-sidebar", "post has-banner", "no-comments", "page-with-ads"):
        assert html.main_text(f"<div class='{name}'><p>story</div>", []) == "story"
        assert html.main_text(f"<main><div class='{name}'><p>story</div></main>", []) == "story"
    for name in ("sidebar", "cookie-notice", "site-footer", "comment-list", "comments-wrapper", "ad"):
        assert html.main_text(f"<p>story<div class='{name}'>x</div>", []) == "story"
    assert html.main_text("<article>E = <math>mc</math> holds</article><p>x</p><article>Part two</article>", []) == "E = mc holds\nPart two"
    assert html.main_text("<div class='banner'><article>kept</article></div>", []) == "kept"


def test_very_long_and_deep_pages():
    deep = "<div>" * 50_000 + "story" + "</div>" * 50_000
    assert html.main_text(deep, []) == "story"
    assert html.main_text("<p>word " * 100_000 + "</b></i>" * 10_000, []).count("word") == 100_000


def plain_classes(pages):
    """The valid classes of one host, by comparing whole occurrence vectors."""
    read = [[t for t, *_ in html.tokens_of(p)] for p in pages]
    every = sorted({t for r in read for t in r})
    vectors = {}
    for t in every:
        vector = tuple(r.count(t) for r in read)
        n = sum(c > 0 for c in vector)
        if n >= html.LEAST_PAGES and n >= html.LEAST_SHARE * len(pages):
            place = sum(r.index(t) for r in read if t in r) / n
            vectors.setdefault(vector, []).append((place, t))
    return sorted([t for _, t in sorted(v)] for v in vectors.values() if len(v) >= html.LEAST_CLASS)


def unmarked(k, n):
    """An article that repeats unmarked boilerplate among its own paragraphs."""
    own = "".join(f"<p>Paragraph {j} of story {k} tells of {'abcdefgh'[k % 8] * (j + 3)} at some length, more than the frame.</p>" for j in range(n))
    return f"<html><body><div><ul><li>menu {k}</li><li>{k} more</li></ul></div><article><h2>Follow us</h2><p>Sign up for our letters {'and so on ' * 40}</p><section>{own * 12}</section><p>Written by our desk</p></article></body></html>"


def test_template_inside_the_article_and_plain_vectors(spark):
    pages = [unmarked(k, 1 + k % 3) for k in range(9)]
    df = spark.createDataFrame([page(k, p) for k, p in enumerate(pages)] + [page(20 + k, pages[0], "copies.example") for k in range(5)], SCHEMA).repartition(3)
    found = {r.host: sorted([t % 2**64 for t in c] for c in r.classes) for r in html.templates(html._pages(df)).collect()}
    assert found["h.example"] == plain_classes(pages)
    rows = {r.page_id: r.text for r in html.extract(df).collect()}
    for k in range(9):
        assert "Follow us" not in rows[k] and "Sign up" not in rows[k] and "Written" not in rows[k]
        assert rows[k].count(f"of story {k} tells") == 12 * (1 + k % 3) and "menu" not in rows[k]
    # a host of copies of one article is no template
    assert all(rows[20 + k].startswith("Follow us\nSign up") and "story 0" in rows[20 + k] for k in range(5))


def test_classes_out_of_order_or_crossing_are_not_fixed():
    assert html.template_places([1, 9, 2, 8], [[1, 2]]) == {0, 2}
    assert html.template_places([2, 9, 1], [[1, 2]]) == set()
    assert html.template_places([1, 2, 9, 1, 2], [[1, 2]]) == {0, 1, 3, 4}
    assert html.template_places([1, 3, 9, 2, 4], [[1, 2], [3, 4]]) in ({0, 3}, {1, 4})
    assert html.template_places([1, 3, 9, 4, 2], [[1, 2], [3, 4]]) == {0, 1, 3, 4}
