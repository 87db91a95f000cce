"""Main text on pages of known content; site templates on planted hosts."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pitpanel.llm import html_text

SF = "/root/testdata/sf0.01"
PAGE = "page_id long, url string, html string, host string, hashes string"


@pytest.mark.parametrize("source, want", [
    ("", ""),
    ("plain  text\nx", "plain text x"),
    ("<p>a<p>b<br>c <b>d</p>e<div class='ad-box'>x</div>", "a\n\nb c d\n\ne"),
    ("<body><main class=content><h1>T</h1><ul><li>a<li>b</ul><aside>no</aside>"
     "<section id=comments><p>no</p></section></main><footer>no", "T\n\na\n\nb"),
    ("<nav>no</nav><article><p>x &lt;b&gt; &copy;&nbsp;y &amp z</p><form><p>no</form>"
     "<script>if(a<b){'</p>'}</script><p hidden>no</p><article class=comment>no</article>"
     "</article>no", "x <b> © y & z"),
    ("<article>A</article><p>no</p><article>B</article>", "A\n\nB"),
    ("<a href='x>y'>q</a> < 3 <unclosed", "q < 3 <unclosed"),
    ("<!-- no --><p>a<!-- no > --> b</p><!-- open", "a b"),
    ("<div class='has-sidebar'><article><p>kept</p></article></div>", "kept"),
    ("</p></div>stray<p>a", "stray\n\na"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"),
    ("<style>p{}</style><title>no</title><textarea>no</textarea>x", "x"),
])
def test_pages(source, want):
    assert html_text.main_text(source) == want


def test_long_and_deep_pages():
    assert html_text.main_text("<p>" + "word " * 50_000 + "</p>") == ("word " * 50_000).strip()
    assert html_text.main_text("<div>" * 3000 + "x") == "x"


def test_site_template(spark):
    def page(k, host):
        return (f"<html><body><div><span>Top of the site</span> <a href=/>Home</a></div>"
                f"<div><p>story {host} {k}</p><p>shared words</p></div>"
                f"<div>All of it is ours</div></body></html>")

    rows = [(k, f"http://A.example/{k}?x", page(k, "a"), "h", "s") for k in range(12)]
    rows += [(50 + k, f"https://u@b.example:80/{k}", page(k, "b"), "h", "s") for k in range(2)]
    # Copies of one page are one page.
    rows += [(70 + k, f"//c.example/{k}", page(0, "c"), "h", "s") for k in range(30)]
    rows += [(100, None, None, None, None), (101, "", "", "", ""), rows[0]]
    pages = spark.createDataFrame(rows, PAGE)
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "host", "hashes", "text"]
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows)
    assert got[3] == "story a 3"
    assert got[50].split("\n\n") == ["Top of the site Home", "story b 0", "shared words",
                                     "All of it is ours"]
    assert got[75].startswith("Top of the site") and got[100] == got[101] == ""
    assert html_text.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_prose_of_an_article_stays(spark):
    rows = [(k, "http://a.example/", f"<article><p>{k}</p><p>again</p><div class=x>more on us"
             "</div></article>", "", "") for k in range(9)]
    got = html_text.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert sorted(r.text for r in got) == [f"{k}\n\nagain" for k in range(9)]


def test_small_section_templates_of_a_large_host(spark):
    """Counts equal brute force; a block of 12 pages goes on a host of 2,000."""
    def page(k):
        section = f"<div>All about section {k % 160}</div>"
        return (f"<html><body><div><b>Site</b> top</div>{section}"
                f"<div><p>story number {k}</p></div></body></html>")

    rows = [(k, f"http://big.example/{k}", page(k), "", "") for k in range(2000)]
    pages = spark.createDataFrame(rows, PAGE)
    got = {r.page_id: (r.text, r.n) for r in html_text.extract(pages, removed="n").collect()}
    assert got == {k: (f"story number {k}", 2) for k in range(2000)}
    held = Counter()
    for row in rows:
        held.update(set(html_text.subtree_hashes(row[2])[1]))
    want = {(h, n) for h, n in held.items() if n >= 5}
    found = html_text.templates(html_text.subtrees(pages)).collect()
    assert {(r["hash"], r.pages) for r in found} == want


def test_copies_of_an_article_in_unlike_frames_are_one_page(spark):
    rows = [(k, "http://a.example/", f"<nav>menu {k}</nav><article><div class=body>told once"
             f"</div></article><div class=ad>{k}</div>", "", "") for k in range(20)]
    got = html_text.extract(spark.createDataFrame(rows, PAGE)).collect()
    assert {r.text for r in got} == {"told once"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_counts_do_the_work_of_word_lists(spark):
    """Without words of class, id and role nearly all given pages have the same text."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    with_words = html_text.extract(pages, removed="n").select("page_id", "text", "n")
    without = html_text.extract(pages, by_words=False).select(
        "page_id", F.col("text").alias("plain"))
    both = with_words.join(without, "page_id")
    changed = both.filter("text != plain").count()
    assert both.filter("n > 0").count() > 0
    assert changed <= 0.05 * both.count()
