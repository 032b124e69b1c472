import random

import pytest
from pyspark.sql import functions as F

from linkloom.operators import html as H

PAGE = """<html><body><article><div><h2>Sources</h2><ul><li>See <a href="https://en.wikipedia.org/wiki/Alpha">Alpha</a> here</li></ul></div></article>
<footer><p>From <a href="https://en.wikipedia.org/wiki/Beta#s">Beta</a></p></footer>
<div class="comment-body"><p>x <a href="http://de.wikipedia.org/wiki/Gamma">Gamma</a> y</p></div>
<div id="sidebar"><p><a href="/local">no</a></p></div></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame(list(enumerate(htmls)), "page_id long, html string")


def test_structure_page(spark):
    rows = {r.hypertext: r for r in H.page_order(H.link_features(pages(spark, PAGE))).collect()}
    assert set(rows) == {"Alpha", "Beta", "Gamma"}
    a, b, g = rows["Alpha"], rows["Beta"], rows["Gamma"]
    assert (a.a1, a.a2, a.header, a.tag_footer, a.class_response, a.order) == ("li", "ul", "Sources", False, False, 1)
    assert (b.a1, b.a2, b.header, b.tag_footer, b.class_response, b.order) == ("p", "footer", None, True, False, 0)
    assert (g.a1, g.a2, g.header, g.tag_footer, g.class_response, g.order) == ("p", "div", None, False, True, 2)
    assert a.nbhd_text == "See  [BREAK] Alpha [BREAK]  here"
    assert b.nbhd_text == "From  [BREAK] Beta [BREAK] "
    assert g.nbhd_text == "x  [BREAK] Gamma [BREAK]  y"


def test_sidebar_by_id(spark):
    rows = H.page_order(H.link_features(pages(spark, PAGE), "^/local")).collect()
    assert [(r.class_sidebar, r.order) for r in rows] == [(True, 0)]


def test_contexts(spark):
    rows = {r.hypertext: r for r in H.link_contexts(pages(spark, PAGE)).collect()}
    assert rows["Gamma"].text1 == '<p>x <a href="http://de.wikipedia.org/wiki/Gamma">Gamma</a> y</p>'
    assert rows["Alpha"].raw_text == "See Alpha here"
    para = {r.hypertext: r for r in H.link_contexts(pages(spark, PAGE), only_para=True).collect()}
    assert para["Alpha"].text1 is None and para["Beta"].raw_text == "From Beta"


def test_unclosed_and_nested_lists(spark):
    html = "<ul><li>a<ul><li>x<li>y</ul><li>b<br><p>q <b>w<p>r</ul><p>z&#8364; &amp;<img src='a>b'/>"
    rows = H.element_text(pages(spark, html), H.html_elements(pages(spark, html))).collect()
    got = {r.pos: (r.tag, r.text) for r in rows}
    assert got[1] == ("li", "axy") and got[9] == ("li", "bq wr") and got[14] == ("b", "w")
    assert got[19] == ("p", "z€ &") and got[21] == ("img", "")


def test_attributes(spark):
    df = spark.createDataFrame([("<a title='x>y' HREF=/q?a=1&amp;b=2 data-x=1>",)], "t string")
    r = df.select(H.attribute("t", "href").alias("h"), H.attribute("t", "class").alias("c")).head()
    assert (r.h, r.c) == ("/q?a=1&b=2", None)


def test_links_ignore_comments_and_scripts(spark):
    html = '<!-- <a href="/no"> --><script>"<a href=/no>"</script><a href="/yes">y</a>'
    assert pages(spark, html).select(H.page_links("html", "^/").alias("l")).head().l == ["/yes"]


def test_huge_tag(spark):
    html = f"<p x={'y ' * 40000}><a href='/deep'>t</a></p>"
    assert pages(spark, html).select(H.page_links("html", "^/").alias("l")).head().l == ["/deep"]


def test_comment_attribute(spark):
    df = pages(spark, "<p data-comment='1'>x</p>", "<p class=comment>x</p>")
    rows = df.select("page_id", H.has_attribute_like("html", "comment").alias("f")).orderBy("page_id").collect()
    assert [r.f for r in rows] == [True, False]


VOID = {"br"}


def brute(tokens):
    """Spans, depths and ancestors of a well-formed token list with a plain stack."""
    stack, out = [], {}
    for pos, (kind, tag) in enumerate(tokens):
        if kind == "open":
            out[pos] = [tag, None, [p for p, _ in stack]]
            stack.append((pos, tag))
        elif kind == "close":
            start, _ = stack.pop()
            out[start][1] = pos
        elif kind == "void":
            out[pos] = [tag, pos, [p for p, _ in stack]]
    return out


@pytest.mark.parametrize("seed", range(5))
def test_well_formed_trees(spark, seed):
    rng = random.Random(seed)
    tokens, stack = [], []
    for _ in range(120):
        kind = rng.choice(["open", "open", "close", "void", "text"])
        if kind == "open" and len(stack) < 8:
            tag = rng.choice(["div", "ul", "p", "b", "footer", "section"])
            stack.append(tag)
            tokens.append(("open", tag))
        elif kind == "close" and stack:
            tokens.append(("close", stack.pop()))
        elif kind == "void":
            tokens.append(("void", "br"))
        elif kind == "text" and (not tokens or tokens[-1][0] != "text"):
            tokens.append(("text", "t"))
    tokens += [("close", stack.pop()) for _ in range(len(stack))]
    write = {"open": "<{}>", "close": "</{}>", "void": "<{}>", "text": "{}"}
    html = "".join(write[k].format(t) for k, t in tokens)
    want = brute(tokens)
    placed = H.element_regions(H.html_elements(pages(spark, html)), {"in_footer": F.col("tag") == "footer"}).cache()
    got = {r.pos: r for r in placed.collect()}
    assert set(got) == set(want)
    for pos, (tag, close, path) in want.items():
        r = got[pos]
        assert (r.tag, r.close_pos, r.depth) == (tag, close, len(path))
        assert r.in_footer == (tag == "footer" or any(want[p][0] == "footer" for p in path))
    ups = {r.pos: r for r in H.ancestors(placed, F.lit(True), 2).collect()}
    for pos, (_, _, path) in want.items():
        up1, up2 = ups[pos].up1, ups[pos].up2
        assert (up1.pos if up1 else None) == (path[-1] if path else None)
        assert (up2.pos if up2 else None) == (path[-2] if len(path) > 1 else None)


# --- spans by offsets ------------------------------------------------------------------------------------
def flat(tokens, start, stop):
    """Visible text between two tokens, and markup from the first to the one that ends it."""
    return "".join(t for t in tokens[start + 1 : stop] if not t.startswith("<"))


@pytest.mark.parametrize("cut", [8 << 20, 200])
def test_spans_equal_the_tokens_between(spark, monkeypatch, cut):
    """With a small ``CUT_CHARS`` the rows of a page are cut in many parts."""
    monkeypatch.setattr(H, "CUT_CHARS", cut)
    rng = random.Random(7)
    htmls = []
    for _ in range(6):
        words = [rng.choice(["<p>", "<div>", "<b>", "</b>", "</p>", "</div>", "<br>", "né ", "a &amp; b ", "x", "<i>", "</i>", "<h2>", "</h2>"]) for _ in range(80)]
        htmls.append("".join(words) + "<p>unclosed")
    df = pages(spark, *htmls)
    tokens = {r.page_id: r.toks for r in df.select("page_id", H.token_array("html").alias("toks")).collect()}
    elements = H.html_elements(df)
    found = H.element_text(df, elements).collect()
    assert len(found) == elements.count() > 100
    for r in found:
        assert r.text == flat(tokens[r.page_id], r.pos, min(r.close_pos, len(tokens[r.page_id]))).replace("&amp;", "&"), r
    arrays = H.page_arrays(df)
    marked = H.cut_spans(H.elements_of(arrays), H.page_texts(arrays), {"m": H.Span(markup=True)}).collect()
    for r in marked:
        toks = tokens[r.page_id]
        stop = min(r.close_pos, len(toks))
        own = stop < len(toks) and toks[stop] == f"</{r.tag}>"
        assert r.m == "".join(toks[r.pos : max(stop + own, r.pos + 1)])


def test_page_with_ten_thousand_links(spark):
    links = " ".join(f'<a href="https://en.wikipedia.org/wiki/T{i}">t{i}</a>' for i in range(10_000))
    df = pages(spark, f"<html><body><div><p>{links}</p></div></body></html>", "<p>no link</p>")
    rows = H.link_features(df).select("hypertext", "nbhd_text", "a1", "a2").collect()
    assert len(rows) == 10_000 and {(r.a1, r.a2) for r in rows} == {("p", "div")}
    by = {r.hypertext: r.nbhd_text for r in rows}
    assert by["t0"].startswith(" [BREAK] t0 [BREAK]  t1 t2") and " [BREAK] t5000 [BREAK] " in by["t5000"]


@pytest.mark.parametrize("numbers", [[], [3], [1, 0, 2], list(range(64)), list(range(65)), list(range(1000))])
def test_prefix_sums(spark, numbers):
    df = spark.createDataFrame([(numbers,)], "x array<int>")
    assert df.select(H.prefix_sums(F.col("x"))).first()[0] == [sum(numbers[:i]) for i in range(len(numbers) + 1)]


def test_linked_pages_lose_no_link(spark):
    """The raw test may keep too much, never too little: entities in the href, odd quotes, upper case."""
    htmls = [
        '<a href="https://en&#46;wikipedia.org/wiki/X">x</a>', "<A HREF='https://en.wikipedia.org/wiki/X'>x</A>",
        '<a href="https://en&period;wikipedia&#x2e;org&sol;wiki/X">x</a>', "<a class=b href=//fr.m.wikipedia.org/wiki/X>x</a>",
        "<p>wikipedia.org/ without an anchor</p>", '<a href="/local?a=1&amp;b=2">y</a>',
    ]
    kept = {r.page_id for r in H.linked_pages(pages(spark, *htmls)).collect()}
    found = {r.page_id for r in pages(spark, *htmls).select("page_id", F.explode(H.page_links("html")).alias("l")).collect()}
    assert found == {0, 1, 2, 3} == kept
    assert {r.page_id for r in H.linked_pages(pages(spark, *htmls), "^/local").collect()} == {0, 1, 2, 3, 5}
    assert {r.page_id for r in H.linked_pages(pages(spark, *htmls), "a=1.b").collect()} >= {5}


def test_repeated_urls_give_each_link_once(spark, tmp_path):
    from linkloom.sources.readers import read_pages, with_page_key

    page = '<p>See <a href="https://en.wikipedia.org/wiki/{}">{}</a></p>'
    for part in range(3):
        rows = [("u", page.format(f"T{part}{i}", f"t{part}{i}")) for i in range(4)] + [("u", page.format("Same", "same"))]
        spark.createDataFrame(rows, "url string, html string").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    keyed = with_page_key(read_pages(spark, str(tmp_path / "pages")))
    assert keyed.select("page_key").distinct().count() == 15
    links = [r.hypertext for r in H.link_contexts(keyed, key="page_key", carry=["url"]).collect()]
    assert sorted(links) == sorted([f"t{p}{i}" for p in range(3) for i in range(4)] + ["same"] * 3)
