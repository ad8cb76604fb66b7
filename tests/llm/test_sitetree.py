import html
import math
import re
from collections import Counter

from tabwork.llm import sitetree

ONE = sitetree.Parser()


def text(page, low=frozenset()):
    return ONE.text(page, low)


def test_blocks_references_and_white_space():
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style></head><body>
    <article><h1>A&nbsp;&amp;&#32;B</h1><p>one <b>two</b>\n  three<br>four<p>unclosed &eacute;&#x1F600;<ul><li>x<li>y</ul>
    <script>var t="</p>";</script><table><tr><td>1<td>2<tr><td>3</table>a < b</article></body>"""
    assert text(page).split("\n\n") == ["A & B", "one two three four", "unclosed é😀", "x", "y", "1", "2", "3", "a < b"]


def test_named_parts_go_and_article_stays():
    parts = ["<nav><a href=x>menu</a></nav>", "<header>site</header>", "<div class='sidebar-left'>side</div>", "<div id=cookie-notice>cookies</div>",
             "<div class=\"adBox\">buy</div>", "<aside>aside</aside>", "<form><input><button>go</button></form>", "<section class=comments><p>first!</p></section>",
             "<div role=banner>b</div>", "<p hidden>h</p>", "<footer><p>&copy; me</footer>", "<div style='display: none'>n</div>", "<!-- <p>c</p> -->"]
    body = "<p>text one</p><div class='shadow loads'><p>text two</p></div>"
    assert text("".join(parts[:6]) + body + "".join(parts[6:])) == "text one\n\ntext two"
    inner = "<article class='post has-comments'><header><h1>Title</h1><p>by me</p></header>" + body + "".join(parts[6:8]) + "</article>"
    assert text("<div>outside</div>" + inner + "<article class=comment>me too</article>") == "Title\n\ntext one\n\ntext two"


def test_broken_pages():
    assert text("") == "" and text("plain &lt;text&gt;  here") == "plain <text> here"
    assert text("<article><p>cut off <b>here") == "cut off here"
    assert text("<p>a</div></p></article>b<p title=\"x>y\">c<p title=\"open>d") == "a\n\nb\n\nc\n\nd"
    assert text("<article><!-- never closed <p>x") == "" and text("<script>x") == ""
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def pages(n=12):
    """A site whose notice and box have neameless markup and read the same on every page."""
    rows = []
    for i in range(n):
        rows.append((i, f"http://a.example/{i}", f"<body><div class=x{i}><div class=box>Join our club, member {i}!</div>"
                     f"<div class=body><p>story {'abcdefghijklmnop'[i]} begins</p><p>and ends {'ponmlkjihgfedcba'[i]}</p></div><div class=tail>Made by us</div></div>"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, text string, n_chars int").repartition(3)


def test_tree_removes_what_a_site_repeats(spark):
    rows = pages() + [(100 + i, "http://b.example/", pages()[i][2]) for i in range(3)]
    rows += [(200, None, None), (201, "http://a.example/q", ""), (202, None, "<p>free</p>"), (3, rows[3][1], rows[3][2]), (None, "HTTP://A.example/", pages()[1][2])]
    got = {(r.page_id, r.url): r for r in sitetree.extracted(frame(spark, rows)).collect()}
    for i in range(12):
        c, d = "abcdefghijklmnop"[i], "ponmlkjihgfedcba"[i]
        assert got[i, rows[i][1]].text == f"story {c} begins\n\nand ends {d}"
    # three pages are too few to judge a site by
    assert got[100, "http://b.example/"].text.startswith("Join our club") and got[100, "http://b.example/"].text.endswith("Made by us")
    assert got[200, None].text == got[201, "http://a.example/q"].text == "" and got[202, None].text == "free"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert sitetree.extracted(frame(spark, rows)).count() == len(rows)
    assert sitetree.extracted(frame(spark, rows).filter("page_id < -1")).collect() == []


def test_importances_equal_brute_force(spark):
    rows = pages(9)
    found = sitetree.importances(frame(spark, rows).selectExpr("'h' AS host", "html")).collect()
    seen = {}
    for _, _, page in rows:
        for path, _, structure, content in ONE.facts(page):
            for kind, v in ((0, structure), (1, content)):
                seen.setdefault((path, kind), []).append(v)

    def entropy(values):
        m = len(values)
        return 1.0 if m == 1 else -sum(c / m * math.log(c / m, m) for c in Counter(values).values())
    for r in found:
        assert r.pages == len(seen[r.path, 0])
        assert abs(r.importance - 0.1 * entropy(seen[r.path, 0]) - 0.9 * entropy(seen[r.path, 1])) < 1e-9


def test_query(spark, sf):
    got = {r.page_id: r for r in sitetree.op7_site_style_tree(spark, sf).collect()}
    raw = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(raw)
    for r in raw:  # the article of this template, read without the parser
        article = r.html[r.html.index("<article>") + 9:r.html.index("</article>")]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert got[r.page_id].text == "\n\n".join(x for x in parts if x)


def test_copies_on_a_host_keep_their_text(spark):
    page = "<body><div class=content><p>{}</p><p>It goes on for a while.</p></div><div class=tail>Made by us</div></body>"
    rows = [(i, f"http://c.example/?utm={i}", page.format("The same story on every mirror.")) for i in range(1000)]
    rows += [(1000 + i, f"http://c.example/{i}", page.format(f"Story {w}, found only here.")) for i, w in enumerate("abcdef")]
    # near-copies: the text is equal, a line beside it differs, so the pages are distinct
    near = "<body><div class=x><div class=line>by {}</div><div class=content><p>One text on all pages of this host, of some length.</p></div></div></body>"
    rows += [(2000 + i, f"http://d.example/{i}", near.format(c)) for i, c in enumerate("abcdefghij")]
    got = {r.page_id: r.text for r in sitetree.extracted(frame(spark, rows)).collect()}
    assert all(got[i] == "The same story on every mirror.\n\nIt goes on for a while." for i in range(1000))
    for i, w in enumerate("abcdef"):
        assert got[1000 + i] == f"Story {w}, found only here.\n\nIt goes on for a while."
    for i, c in enumerate("abcdefghij"):
        assert got[2000 + i] == f"by {c}\n\nOne text on all pages of this host, of some length."


def test_names_are_a_prior_only(spark):
    story = "<p>A long story begins on this page.</p><p>It goes on, and ends in a second paragraph.</p>"
    want = "A long story begins on this page.\n\nIt goes on, and ends in a second paragraph."
    side = "<div class=sidebar>side</div><nav>menu</nav>"
    assert text(f"<div id=page class='layout sidebar-right'>{side}<div class=content>{story}</div></div>") == want
    assert text(f"<div class='related-work'>{story}</div><div class=ad>buy</div>") == want
    # beside an article such a branch stays out, and so do the small ones within a wrapper
    assert text(f"<article>{story}</article><div class=comments>{story * 2}</div>") == want
    assert text(f"<div class='layout sidebar-right'><article>{story}</article><div class=comments>{story * 2}</div></div>") == want
    # elements that are no text by tag stay out whatever they hold
    assert text(f"<nav>{story * 9}</nav><p>text</p>") == "text"
    cards = "<article><h2>More</h2></article><article><h2>And more</h2></article>"
    assert text(f"<div class=content>{story}</div>{cards}").startswith(want)
    # a named branch that reads the same on every page is boilerplate, however long
    rows = [(i, f"http://e.example/{i}", f"<div class=sidebar>{story}</div><div class=x><p>{c * 15}</p></div>") for i, c in enumerate("abcdefgh")]
    assert {r.text for r in sitetree.extracted(frame(spark, rows)).collect()} == {c * 15 for c in "abcdefgh"}


def test_wrappers_of_a_whole_page_keep_its_text():
    story = "<h1>Title</h1><p>A long story begins on this page.</p><p>It goes on, and ends in a second paragraph.</p>"
    want = "Title\n\nA long story begins on this page.\n\nIt goes on, and ends in a second paragraph."
    assert text(f"<body><form id=aspnetForm><nav>menu</nav><div class=c>{story}</div></form></body>") == want
    assert text(f"<div class='page-header-wrap'>{story}</div><footer>f</footer>") == want
    assert text(f"<div class='page-header-wrap'><main>{story}</main></div>") == want
    assert text(f"<body style='display:none'>{story}</body>") == want
    assert text(f"<div hidden=until-found>{story}</div><div class=ad>buy this, and that, and all of it</div>") == want
    assert text(f"<div role=dialog><form>{story}</form></div>") == want
    # inside the wrapper and beside the text they are no article text
    assert text(f"<form id=aspnetForm>{story}<form><label>Your name and your address</label></form><p hidden>secret</p></form>") == want
    assert text(f"{story}<dialog><p>We use cookies on all our pages, as everybody does.</p></dialog>") == want
    assert text(f"<div class='site-header'><p>The site of sites, for all of us.</p></div>{story}") == want
    assert text(f"<div aria-hidden=true>{story}</div>") == ""
