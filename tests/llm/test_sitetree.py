import math
from collections import Counter
from html.parser import HTMLParser

import pytest
from plumbline.llm.sitetree import LOW, Page, boilerplate_name, extract, style_tree
from xxhash import xxh64_intdigest


@pytest.mark.parametrize(("page", "text"), [("<p>a<b>b<p>c</b>d", "ab\ncd"), ("<ul><li>x<li>y<ul><li>z</ul><li>w</ul>", "x\ny\nz\nw"), ("a < b & c &lt;d&gt; <!-- x", "a < b & c <d>"), ("<nav>m</nav><article><div class='comments'>no</div><header><h1>T</h1></header>ok<br>go</article>after", "T\nok go"), ("<script>var x='</p>'</script>hi", "hi"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<div class=\"ad\" x='>'>q</div>z", "z"), ('<p/>x<p title="unclosed>y</p>', "x\ny"), ("", ""), ("<textarea>abc", ""), ("<p>&copy;&nbsp; a \n b&#x41;</p>", "© a bA"), ("<b>" * 20000 + "deep", "deep"), ("<p>" * 20000 + "last", "last")])
def test_pages(page, text):
    assert Page(page).decided({}).text() == text


class Plain(HTMLParser):
    """The library's own parser: what stands in no menu, footer, advert or head, a line for each title and paragraph."""

    def __init__(self):
        super().__init__()
        self.lines, self.skip = [""], []

    def handle_starttag(self, tag, attrs):
        if tag in ("nav", "footer", "head") or (tag == "div" and ("class", "ad") in attrs):
            self.skip.append(tag)
        elif tag in ("p", "h1", "article"):
            self.lines.append("")
        elif tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if self.skip and self.skip[-1] == tag:
            self.skip.pop()
        elif tag in ("p", "h1", "article"):
            self.lines.append("")

    def handle_data(self, data):
        if not self.skip:
            self.lines[-1] += data


def test_given_pages(spark):
    """Every page against the library's own parser; the rule cuts menu, advert and footer of each, by weights, as contents differ from page to page."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    want = {}
    for r in rows.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        want[r.page_id] = "\n".join(x for x in (" ".join(x.split()) for x in plain.lines) if x)
    got = extract(rows).collect()
    assert {r.id: r.text for r in got} == want and min(r.cut for r in got) == 3


LONG = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="layout no-sidebar"><article><h1>T</h1><p>{LONG}</p></article></div>', f"T\n{LONG}"),
        (f'<article class="post social"><p>{LONG}</p></article>', LONG),
        (f'<article><p>{LONG}</p><section class="search-engines"><p>On engines</p></section><div class="ad-hoc-networks"><p>On networks</p></div></article>', f"{LONG}\nOn engines\nOn networks"),
        (f'<article><p>{LONG}</p></article><div id="related-work"><p>{LONG} too</p></div>', f"{LONG}\n{LONG} too"),
        (f'<h1>Headline</h1><p class="standfirst">Short lead</p><article><p>{LONG}</p></article>', f"Headline\nShort lead\n{LONG}"),
        (f'<div class="story"><p>{LONG}</p><p>{LONG}</p></div><article><p>A teaser</p></article>', f"{LONG}\n{LONG}\nA teaser"),
        (f'<div class="page widget"><main><p>{LONG}</p></main></div>', LONG),
        (f'<form id="aspnetForm"><input value=x><main><p>{LONG}</p></main></form>', LONG),
        (f'<article><p>{LONG}</p></article><section class="comments"><article><p>I think so</p></article><article><p>No way at all, as I have said before now</p></article></section>', LONG),
        (f'<article><p>{LONG}</p><div class="social-share">Share on all of the networks that there are today</div><div id="comment-list"><p>{LONG}</p></div></article>', LONG),
        (f'<div class="site-header"><a href=/>Our site, where all of the news of the day is</a></div><article><p>{LONG}</p></article>', LONG),
        (f'<header><h1>The title</h1></header><main><p>{LONG}</p></main>', f"The title\n{LONG}"),
        (f'<header><h1>Our site</h1></header><main><h1>The title</h1><p>{LONG}</p></main>', f"The title\n{LONG}"),
        (f'<ul><li><a href=a>Home of all</a><li><a href=b>News</a></ul><div><p>{LONG}</p><ul><li>one</li><li>two</li></ul></div>', f"{LONG}\none\ntwo"),
        (f'<div class="social"><p>{LONG}</p></div>', LONG),
    ],
)
def test_names_and_articles_weigh_and_do_not_gate(page, text):
    assert Page(page).decided({}).text() == text


def test_names():
    assert all(map(boilerplate_name, "ad sidebar site-footer comment-list cookie-banner sidebar-left ad_slot_2".split()))
    assert not any(map(boilerplate_name, "no-sidebar search-engines ad-hoc-networks related-work menus adhoc list main post".split()))


def test_importance_and_weight_are_one_rule():
    page = Page(f"<article><p>{LONG}</p><div class=x>note</div></article><div class=y>{LONG}</div>")
    x, y = (page.path[page.tag.index("div", k)] for k in (0, page.tag.index("div") + 1))
    for at, value, kept in ((x, LOW / 3 - 0.01, "y"), (x, LOW / 3 + 0.01, "xy"), (y, LOW - 0.01, "x"), (y, LOW + 0.01, "xy")):
        got = page.decided({at: value})
        assert ("note" in got.text(), got.text().count("word39") == 2) == ("x" in kept, "y" in kept) and got.by_tree == 2 - len(kept)


def test_repeated_branches_go(spark):
    """Without any name that helps, what stands on every page of a host goes, and what differs stays."""
    rows = [(i, "http://h/%d" % i, f"<div><div class=x>All rights reserved by h</div><div class=y><p>Text {i} of its own</p></div></div>", "c") for i in range(9)]
    rows += [(100, "http://lone/", "<div class=x>All rights reserved by h</div>", "c"), (101, None, None, "c"), (102, "odd", "", "c"), (None, "http://h/a", "<p>x", "c"), (103, "http://h/", "<p>" + "word " * 50000, "c"), (0, "http://h/0", rows[0][2], "c")]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    by = {r.id: r.text for r in got}
    assert len(got) == len(rows)
    assert all(by[i] == f"Text {i} of its own" for i in range(9))
    assert by[100] == "All rights reserved by h" and by[101] == by[102] == "" and by[None] == "x" and len(by[103]) == 249999


def path(*keys):
    at = 0
    for k in keys:
        at = xxh64_intdigest(k, seed=at)
    return at


def test_importance_by_counting(spark):
    """Entropies of a host's nodes, counted here by hand from what the pages were made of."""
    notes = ["same", "same", "same", "same", "other", "third"]
    pages = [f"<html><body><article><h1>Title {k}</h1><div class=note>{x}</div><p>body {k}</p>{'<p>more</p>' * (k % 2)}</article></body></html>" for k, x in enumerate(notes)]
    df = spark.createDataFrame([("h", x) for x in pages + pages[:1] * 50], "host string, html string")
    tree = {r.path % 2**64: r for r in style_tree(df).collect()}

    def entropy(values):
        n = Counter(values)
        m = sum(n.values())
        return -sum(c / m * math.log(c / m) for c in n.values()) / math.log(m)

    top = ("html", "body", "article")
    for keys, contents in (((*top, "div note"), notes), ((*top, "h1"), range(6)), ((*top, "p"), [*[f"b{k}" for k in range(6)], "more", "more", "more"])):
        got = tree[path(*keys)]
        assert got.seen == len(contents) and got.importance == pytest.approx(0.9 * entropy(contents))
    assert tree[path(*top, "div note")].importance < tree[path(*top, "h1")].importance == pytest.approx(0.9)


def test_the_tree_cuts_inside_articles(spark):
    """A notice that stands in every article of a host goes though no name gives it away; copies of an article, headings and what differs stay; without the tree all of it stays."""
    note = "<div class=x7><p>Read more of our series</p></div>"
    rows = [(k, f"http://h/{k}", f"<body><div>Site line</div><article><h1>Title {k}</h1><h2>Overview</h2><p>Body {k}</p>{note}</article></body>") for k in range(12)]
    rows += [(100 + k, f"http://h/c{k}", f"<body><article><h1>Copied</h1><section><p>The very same body</p></section></article><p>{k}</p></body>") for k in range(40)]
    rows += [(200, "http://h/m", "<nav><main>menu</main></nav><p>a page without an article</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r for r in extract(df).collect()}
    assert all(got[k].text == f"Title {k}\nOverview\nBody {k}" and got[k].cut > 0 for k in range(12))
    assert all(got[100 + k].text == "Copied\nThe very same body" and got[100 + k].cut == 0 for k in range(40))
    assert got[200].text == "a page without an article"
    off = {r.id: r for r in extract(df, use_tree=False).collect()}
    assert all(off[k].text.endswith("Read more of our series") and off[k].cut == 0 for k in range(12))


def test_empty(spark):
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
