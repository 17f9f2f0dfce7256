"""HTML areas, references and links on pages written by hand."""

import pytest
from pyspark.sql import functions as F

from orgloom.functions import extract as X
from orgloom.functions import html_tree as H
from orgloom.operators import extraction as E


def one(spark, html, make):
    return spark.createDataFrame([(1, html, "http://a.kr/x/")], "id int, html string, url string").select(make(F.col("html")).alias("v")).first().v


NESTED = ('<html><body><div class="footer"><div class="addr">서울시</div><p>전화 02-123-4567</p><div>팩스 02-123-4568</div></div><p>after</p></body></html>')


@pytest.mark.parametrize("html, want", [
    (NESTED, "서울시전화 02-123-4567팩스 02-123-4568"),
    ("<footer class=bottom><b>0123456789</b> abc</footer>", "0123456789 abc"),
    ('<div class="x info"><div class="contact">inner block text</div> outer</div>', "inner block text outer\ninner block text"),
    ('<div class="footer">short</div>whole page', "shortwhole page"), ("<p>no footer</p>", "no footer"), ('<div class="footer">never closed text', "never closed text"),
    ('<div title="a>b" class="footer">quoted &gt; sign</div>', "quoted > sign"), ("", "")])
def test_footer(spark, html, want):
    assert one(spark, html, X.html_footer) == want


def test_footer_may_be_cut(spark):
    assert one(spark, "<p>" + "x" * 50 + "</p>", lambda h: X.html_footer(h, last=5)) == "xxxxx"


@pytest.mark.parametrize("html, want", [
    ("info&#64;corp.kr", "info@corp.kr"), ("a&#x40;b &#X26;lt; &amp;#64;", "a@b &lt; &#64;"), ("&#128512;&#0;&#55296;", "\U0001f600��"),
    ("&hellip;&commat;&copy;&unknown;", "…@©&unknown;"), ("x&#160;&nbsp;y", "x y"), ("&#9999999;", "�")])
def test_character_references(spark, html, want):
    assert one(spark, html, X.html_text) == want


def test_links(spark):
    html = "<a href=/c>연락<b>처</b></a> <a class='n' href='d.html'>contact us</a> <a name=x>contact</a> <a data-href=\"no\" href=\"http://b.kr\">map</a> <abbr href=1>연락처</abbr>"
    anchors = [tuple(a) for a in one(spark, html, X.html_anchors)]
    assert anchors == [("/c", "연락처"), ("d.html", "contact us"), ("http://b.kr", "map")]
    rows = E.contact_links(spark.createDataFrame([(1, html, "http://a.kr/x/")], "id int, html string, url string")).collect()
    assert ("http://a.kr/c", "연락처") in {(r.url, r.text) for r in rows}


def test_best_text_takes_any_element_and_role(spark):
    long = "word " * 60
    html = f'<nav>menu</nav><span role="main"><span>{long}</span> end</span>'
    row = E.best_text(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert row.method == "full" and row.text == "menu" + long + "end"
    areas = one(spark, html, lambda h: X.html_areas(h, [X.opens("[a-z]+", X.MAIN_MARKS)]))
    assert areas == [[long + " end"]]


def texts(html, css):
    found, nodes = H.elements(html)
    return ["".join(nodes[e.first:e.last]) for e in found if H.selector(css)(e)]


@pytest.mark.parametrize("html, css, want", [
    ("<div><p>a<div>b</div>c</div>d", "div", ["abc", "b"]),  # an unclosed paragraph ends with what holds it
    ("<section>a<div>b</section>c</div>d", "div", ["b"]), ("a</div>b<div>c", "div", ["c"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", "li", ["a", "bc", "c", "d"]), ("<table><tr><td>a<td>b<tr><td>c</table>", "td", ["a", "b", "c"]),
    ("<dl><dt>a<dd>b<dt>c</dl>", "dt", ["a", "c"]), ("<p>a<br>b<img src=x>c</p>d", "p", ["abc"]), ("<br>x", "br", [""]), ("<div/>x", "div", [""]),
    ('<b class="x main-content y">1</b><b class=main-contents>2</b><b CLASS=\'main-content\'>3</b>', ".main-content", ["1", "3"]),
    ('<i id=content>1</i><i id="content x">2</i>', "#content", ["1"]), ('<i role="main">1</i><i role=main>2</i><i role="mainly">3</i>', '[role="main"]', ["1", "2"]),
    ('<i class="my-contacts">1</i><i class="Contact">2</i><i id="contact">3</i>', '[class*="contact"]', ["1"]), ('<i data-class="footer" title="a>b" class="foot">1</i>', '[class*="footer"]', []),
    ('<a title="x>y">in</a>', "a", ["in"]), ("1 < 2 <b>3</b> < 4", "b", ["3"]), ("<i hidden>1</i><i>2</i>", "[hidden]", ["1"]), ('<i class="a b" id=q>1</i><i class="a">2</i>', "i.a#q", ["1"])])
def test_elements(html, css, want):
    assert texts(html, css) == want


def test_selectors_are_checked(spark):
    for css in ("", "a b", "a > b", "..x", "a:hover"):
        with pytest.raises(ValueError):
            H.selector(css)
    page = "<style>.x{}</style><div class=footer>전화&nbsp;&#48;2</div><script>a</script>"
    assert one(spark, page, lambda h: X.html_select(h, [".footer", "#footer"])) == [["전화 02"], []]
    assert one(spark, None, lambda h: X.html_select(h, [".footer"])) is None


def test_deep_pages_in_one_pass():
    """Twice the tags take about twice the time, however deep."""
    import time

    def seconds(n):
        page = "<div class=a>" * n + "x" + "</span>" * n + "</div>" * n
        start = time.perf_counter()
        found, nodes = H.elements(page)
        assert len(found) == n and all((e.first, e.last) == (0, 1) for e in found)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(80_000) < 12 * seconds(20_000)


def test_attributes_are_parsed_once_for_all_selectors(monkeypatch):
    from orgloom.functions import html_tree as H

    parsed = []

    class Counting:
        findall = staticmethod(lambda text, found=H._ATTRIBUTE.findall: parsed.append(text) or found(text))

    monkeypatch.setattr(H, "_ATTRIBUTE", Counting)
    found, _ = H.elements('<div class="a b" id=x><p class=b>t</p></div>')
    tests = [H.selector(css) for css in (".a", ".b", "#x", '[class*="a"]', "[id]", "p.b")]
    assert [[e.name for e in found if t(e)] for t in tests] == [["div"], ["div", "p"], ["div"], ["div"], ["div"], ["p"]]
    assert len(parsed) == 2
