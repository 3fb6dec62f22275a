"""Page text against documents it was made of, and markup of many kinds."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rivermeld.llm import html_text
from rivermeld.llm.html_text import text_of
from rivermeld.llm.shared import table

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("html, text", [
    (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a\nb"), ("<p>x<b>y</b>z", "xyz"),
    ("<div>one<br>two<ul><li>i<li>j</ul>tail</div>", "one two\ni\nj\ntail"),
    ("<article><h1>T</h1><p>a&nbsp;&lt;b&gt; &eacute;\n c</p><div class='share'>tweet</div></article><footer>f</footer>", "T\na <b> é c"),
    ("<main><p>m</p><aside>s</aside></main><p>out</p>", "m"), ("<body class='nav-open'><p>kept</p></body>", "kept"),
    ("<nav>n</nav><header>h</header><p>t</p><form>f</form><footer>f</footer>", "t"),
    ("<article><header><h1>Title</h1></header><p>x</p><section id='comments'>c</section></article>", "Title\nx"),
    ("<article class='comment'>no</article><article>yes</article>", "yes"),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t<!-- <p>no</p> -->u</p>", "tu"),
    ("<p title='a>b' data-x=\"</p>\">q</p>", "q"), ("<p>un<unknown>kn</unknown>own</p></div></p>", "unknown"),
    ("<table><tr><td>a<td>b<tr><th>c</table>", "a b\nc"), ("<p hidden>h</p><p style='display: none'>d</p><p>v</p>", "v"),
    ("<div role=navigation>n</div><div aria-hidden=true>x</div>ok", "ok"), ("<p>broken <a href='x", "broken"), ("<p>1 < 2 <3</p>", "1 < 2 <3"),
    ("<title>t</title><p>x</p><textarea><p>no</p></textarea>", "x"), ("<script>never closed <p>x", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    ("<p>before</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>", "before\ndeep\nafter"),
    ("<div><article><p>a</p>" + "<div>" * 400 + "</div>" * 400 + "<p>b</p></article></div>", "a\nb"),
    ("a" + "<b>" * 20000 + "x" + "</b>" * 20000 + "</i>" * 20000 + "y", "axy"), ("<p>" + "long text " * 200_000 + "</p>", ("long text " * 200_000).strip()),
    ("<div class='layout has-sidebar'><nav>n</nav><div><p>kept</p></div></div>", "kept"), ("<div class='sidebar'><h1>T</h1><p>kept</p></div>", "T\nkept"),
    ("<article><div class='entry-header'><h1>T</h1></div><p>x</p></article>", "T\nx"), ("<article><div class='header'>T</div><p>x</p></article>", "T\nx"),
    ("<article><p>a</p><section class='social-history'><p>b</p></section><section id='related-work'>c</section></article>", "a\nb\nc"),
    ("<article><p>a</p><div class='related-posts'>r</div><div class='site-footer big'>f</div><div class='col ad'>d</div></article>", "a"),
    ("<div class='ad'>only</div>", ""), ("<p>ok<", "ok<"), ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
])
def test_markup(html, text):
    assert text_of(html)[0] == text


def test_pages_give_the_documents_they_show(spark):
    """Below their heading the pages of the test tables hold the text of a document."""

    def plain(text):
        return "\n".join(x for x in (" ".join(line.split()) for line in text.split("\n")) if x)

    docs = {plain(r["text"]) for r in table(spark, SF_DIR, "documents").select("text").collect()}
    rows = html_text.op6(spark, SF_DIR).collect()
    assert len(rows) == table(spark, SF_DIR, "pages").count()
    assert all(r["text"].split("\n", 1)[1] in docs and r["n_chars"] == len(r["text"]) for r in rows)


def test_titles_are_the_headings_of_the_pages(spark):
    """Every page of the test tables shows its title in a first heading, and that is the first line."""
    import re
    from html import unescape

    heads = {r["page_id"]: re.search("<h1>(.*?)</h1>", r["html"], re.S) for r in table(spark, SF_DIR, "pages").collect()}
    rows = {r["page_id"]: r["text"] for r in html_text.op6(spark, SF_DIR).collect()}
    told = {k: " ".join(unescape(re.sub("<[^>]*>", "", m.group(1))).split()) for k, m in heads.items() if m}
    assert len(told) > 200 and all(rows[k].split("\n", 1)[0] == title for k, title in told.items())


def site(k, template=True, host="a.example.com"):
    extra = "<div><p>Buy our things today, only on this page.</p></div>" if template else ""
    return f"http://{host}/{k}", f"<html><body>{extra}<div><p>Own text number {k}.</p><p>Said by all.</p></div></body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(k, u, h, 7) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string, text long")


@pytest.mark.parametrize("broadcast_rows", [0, 50_000])
def test_containers_that_recur_on_a_host_go(spark, broadcast_rows):
    rows = [site(k) for k in range(12)] + [site(99, True, "b.example.com")] + [site(5)] * 3 + [(None, None), (None, "<p>x</p>")] * 2
    got = {(r["page_id"]): r["text"] for r in html_text.main_text(pages(spark, rows), broadcast_rows=broadcast_rows).collect()}
    assert len(got) == len(rows)
    for k in range(12):
        assert got[k] == f"Own text number {k}.\nSaid by all."
    assert got[12].startswith("Buy our things")
    assert [got[k] for k in (13, 14, 15)] == [got[5]] * 3
    assert [got[k] for k in range(16, 20)] == ["", "x", "", "x"]


def test_copies_of_one_page_are_no_template(spark):
    rows = [("http://c.example.com/same", "<div><div><p>One article, stored again and again.</p></div></div>")] * 30
    got = html_text.main_text(pages(spark, rows)).collect()
    assert len(got) == 30 and {r["text"] for r in got} == {"One article, stored again and again."}


def test_rotating_blocks_of_plain_markup_go_on_a_large_host(spark):
    """Each of 12 blocks stands on a twelfth of the pages; the tags are of all kinds and have no telling name."""
    tags = ("div", "section", "center", "address", "fieldset", "table")

    def advert(k):
        return f"<{tags[k % 6]}><tr><td>Advert of kind {k} to be seen.</td></tr></{tags[k % 6]}>"

    rows = [(f"http://big.example.com/{k}", f"<body><div><p>Text of page {k}.</p><p>Said by all.</p></div>{advert(k % 12)}</body>") for k in range(240)]
    # One article at one place, seen again with other adverts and other marks in the address, is no template.
    rows += [(f"http://big.example.com/again?utm_source=s{k}", f"<body><div><p>The same.</p></div>{advert(k)}<div>{k} readers</div></body>") for k in range(12)]
    # Nor at several places, if all that differs are the adverts.
    rows += [(f"http://big.example.com/copy{k}", f"<body><div><p>Copied.</p></div>{advert(k)}</body>") for k in range(12)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(pages(spark, rows)).collect()}
    assert [got[k] for k in range(240)] == [f"Text of page {k}.\nSaid by all." for k in range(240)]
    assert [got[240 + k] for k in range(12)] == [f"The same.\n{k} readers" for k in range(12)]
    assert [got[252 + k] for k in range(12)] == ["Copied."] * 12


def test_empty_table(spark, tmp_path):
    frame = pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())})
    pq.write_table(frame, tmp_path / "pages.parquet")
    assert html_text.op6(spark, str(tmp_path)).count() == 0
