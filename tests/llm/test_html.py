import random
import re
from html.parser import HTMLParser
from itertools import product

import numpy as np
import pytest

from casekit.llm import html_pages, html_tree


@pytest.fixture(scope="module")
def model():
    return html_tree.train()


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    for n in (1, 2, 6, 9):
        nodes = [html_tree.Node("#root", "", -1)] + [html_tree.Node(str(rng.choice(["p", "div", "nav"])), "", int(rng.integers(0, i))) for i in range(1, n)]
        unary, edge = rng.normal(size=n).tolist(), rng.normal(size=(3, 2, 2))
        total, sums, pair = 0.0, np.zeros(n), np.zeros((n, 4))
        for ys in product((0, 1), repeat=n):
            score = sum(u * y for u, y in zip(unary, ys)) + sum(edge[html_tree._edge_kind(nodes[nodes[v].parent], nodes[v]), ys[nodes[v].parent], ys[v]] for v in range(1, n))
            w = np.exp(score)
            total += w
            sums += w * np.array(ys)
            for v in range(1, n):
                pair[v, 2 * ys[nodes[v].parent] + ys[v]] += w
        p, joint, log = html_tree.marginals(nodes, unary, edge)
        assert np.allclose(p, sums / total) and np.allclose(log, np.log(total))
        assert all(np.allclose(joint[v], pair[v] / total) for v in range(1, n))


def test_held_out_pages(model):
    right = total = 0
    for source in html_pages.labelled_pages(150, 77):
        nodes, blocks = html_tree.parse(source)
        gold = [int(m[1]) if (m := re.search(r'data-y="(\d)"', n.attr)) else 0 for n in nodes]
        for n in nodes:
            n.attr = re.sub(r'\s*data-y="\d"', "", n.attr)
        p = model.content(nodes)
        right += sum((p[k] >= 0.5) == gold[k] for k, _ in blocks)
        total += len(blocks)
    assert right / total > 0.98


PAGE = """<!DOCTYPE html><html lang=en><head><title>Site - </p> T</title><style>p{x:"<p>"}</style><script>var a="</head><p>no</p>";</script></head><body>
<header class=top><div class="logo">Logo</div></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy now.</div><aside><h3>Related</h3><ul><li><a href=x>One</a></li></ul></aside>
<article><h1>Title &amp; more</h1><p>First   <b>bold<br>text</b> &lt;5 &nbsp;&eacute; a < b<p>Second<ul><li>item one<li>item two</ul><div class="ad-slot">Promo text here</div><form action=x><p>Sign up</p><input><button>Go</button></form><blockquote><p>Quoted</p></blockquote>
<pre>code  here</pre></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I think that this is a long reader comment about it.</p></div></section>
<div class="cookie-banner">We use cookies.</div><footer>&copy; site</footer></body></html>"""


def test_a_page(model):
    assert html_tree.main_text(PAGE, model).split("\n") == ["Title & more", "First bold text <5 é a < b", "Second", "item one", "item two", "Quoted", "code here"]


def test_odd_pages(spark, model):
    rows = [None, "", "plain text only", "<article><p>cut <b>of", "<p" * 3000, "<article>" + "<div>" * 3000 + "deep", '<article><p title="a > b">x</p><p title="un>y</p></article>', "<article><p>" + "long " * 50000 + "</p></article>", "</p></div><script>never ended"]
    df = spark.createDataFrame([(h, i, "old") for i, h in enumerate(rows)], "html string, page_id int, text string")
    out = html_tree.extract_text(df, model)
    assert out.columns == ["html", "page_id", "text", "text_"] and out.where("text <> 'old'").isEmpty()
    got = {r.page_id: r.text_ for r in out.collect()}
    assert len(got) == len(rows) and got[0] == got[1] == got[4] == got[8] == ""
    assert got[3] == "cut of" and got[7] == ("long " * 50000).strip() and got[6].startswith("x")
    rng = random.Random(1)
    bits = ["<p>", "</p>", "<div class='ad'>", "</div>", "x", "&amp", "<", ">", "<!--", "-->", "<script>", "</script>", '"', "<a href=", "</", "<article>"]
    for _ in range(500):
        html_tree.main_text("".join(rng.choices(bits, k=rng.randint(1, 30))), model)


def test_formulas_and_embedded_content_keep_their_text():
    texts = lambda page: [t for _, t in html_tree.parse(page)[1]]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><p>next") == ["so x=2 holds", "next"]
    assert texts("<p>a <svg><title>no</title><style>no</style><text>chart</text></svg> b</p>") == ["a chart b"]
    for tag in ("video", "audio", "object", "canvas", "math", "svg"):
        assert texts(f"<div>a</div><{tag} class=x>fallback<p>the article</p><p>goes on</p>") == ["a", "fallback", "the article", "goes on"]


def test_inline_elements_do_not_split_blocks():
    texts = lambda page: [t for _, t in html_tree.parse(page)[1]]
    for tag in ("ins", "del", "output", "custom-x", "b", "slot"):
        assert texts(f"<p>We have <{tag}>added</{tag}> words here</p>") == ["We have added words here"]
        assert texts(f"<p><{tag}>Added</{tag}> words</p><p>more") == ["Added words", "more"]
        assert texts(f"<div><{tag}>Added</{tag}> words<{tag}>.</{tag}></div>") == ["Added words."]
        assert texts(f"<div>We have <{tag}>added<p>a block</p></{tag}> and more</div>") == ["We have added", "a block", "and more"]
        assert texts(f"<li><{tag}>an item</{tag}></li><li>b") == ["an item", "b"]
        assert texts(f"<p>open <{tag}>to the end") == ["open to the end"]
        assert texts(f"a<{tag}/>b</{tag}>c") == ["abc"]
    assert texts("<p>one<wbr>two<img src=x>three<br>four</p>") == ["onetwothree four"]
    assert texts("<div><ins class=ads>Buy</ins><!-- x --> <p>text</p></div>") == ["Buy", "text"]
    assert texts("<p>Press <button>Go</button> to go on</p><p>b") == ["Press", "Go", "to go on", "b"]


def test_kinds_of_inserted_and_own_elements(model):
    body = "<article><h1>A title here</h1><p>The first paragraph of a text that goes on for a while.</p>{}<p>The last paragraph of the text, which is long too.</p></article>"
    assert "was added later" in html_tree.main_text(body.format("<ins><p>This paragraph was added later, by the same hand.</p></ins>"), model)
    assert "Buy" not in html_tree.main_text(body.format('<ins class="ads">Buy this now</ins>'), model)
    assert "Buy" not in html_tree.main_text(body.format('<amp-ad class="ad-slot"><p>Buy this now</p></amp-ad>'), model)


def test_many_unknown_and_unclosed_names_take_linear_time():
    page = "".join(f"<x{i}>w " for i in range(30_000)) + "<ins>" * 30_000
    assert len(html_tree.parse(page)[1]) == 1


def test_raw_elements_end_where_they_end():
    texts = lambda page: [t for _, t in html_tree.parse(page)[1]]
    assert texts("<p>" + "İ" * 60 + "</p><script>var x = '<p>';</SCRIPT ><p>one</p><p>two</p>") == ["İ" * 60, "one", "two"]
    for tag in ("textarea", "iframe", "noscript", "template", "title"):
        assert texts(f"<p>a</p><{tag}><p>b</p><p>c</p>") == ["a", "b", "c"]
    assert texts("<p>a</p><script>x </scripts> <p>b</p></script><p>c</p>") == ["a", "c"]


class Slow(HTMLParser):
    """Blocks of a page by the library's parser: text between the bounds of block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.bits, self.skip = [], [], 0

    def close_block(self):
        text = " ".join("".join(self.bits).split())
        self.out += [text] if text else []
        self.bits = []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "br":
            self.bits.append(" ")
        elif tag not in html_tree._INLINE:
            self.close_block()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = 0
        elif tag not in html_tree._INLINE and tag != "br":
            self.close_block()

    def handle_data(self, data):
        if not self.skip:
            self.bits.append(data)


def test_parsing_against_the_librarys_parser():
    rng = random.Random(3)
    tags = ["p", "div", "b", "i", "ul", "li", "span", "article", "h2", "blockquote", "td", "em", "a"]

    def make(depth):
        kind = rng.random()
        if depth > 5 or kind < 0.3:
            return rng.choice(["word ", "é &amp; &lt;x&gt; ", "İstanbul", "\n\t", "a&nbsp;b", "1 < 2", "<br>", "<!-- no <p> -->", "<script>var a = '<p>no</p>';</script>", "<STYLE>p{}</STYLE>"])
        inner = "".join(make(depth + 1) for _ in range(rng.randint(0, 4)))
        tag = rng.choice(tags)
        return f'<{tag.upper() if rng.random() < 0.2 else tag} class="x > y" id=z>{inner}</{tag}>'

    for _ in range(400):
        page = "".join(make(0) for _ in range(4))
        slow = Slow()
        slow.feed(page)
        slow.close()
        slow.close_block()
        assert [t for _, t in html_tree.parse(page)[1]] == slow.out, page


def test_repeated_rows_and_empty_tables(spark, model):
    df = spark.createDataFrame([(1, PAGE), (1, PAGE)], "page_id int, html string")
    rows = [r.text for r in html_tree.extract_text(df, model).collect()]
    assert len(rows) == 2 and rows[0] == rows[1] != ""
    assert html_tree.extract_text(df.limit(0), model).count() == 0


def test_names_that_say_nothing(model):
    right = total = 0
    for source in html_pages.labelled_pages(150, 78, unknown=1.0):
        nodes, blocks = html_tree.parse(source)
        gold = [int(m[1]) if (m := re.search(r'data-y="(\d)"', n.attr)) else 0 for n in nodes]
        for n in nodes:
            n.attr = re.sub(r'\s*data-y="\d"', "", n.attr)
        p = model.content(nodes)
        right += sum((p[k] >= 0.5) == gold[k] for k, _ in blocks)
        total += len(blocks)
    assert right / total > 0.97


#: Pages of other makers, by hand: (page, blocks that are content, blocks that are not).
OTHERS = [
    ("""<html><body class="home single"><div id="page" class="hfeed"><header id="top"><a href="/">The Daily Stone</a><p>News since 1901</p></header><nav id="site"><ul><li><a href=1>World</a></li><li><a href=2>Sport</a></li></ul></nav>
    <div id="primary"><article id="p-12" class="hentry"><h1>Bridge reopens after a long repair</h1><p>The old bridge over the river was opened again on Monday, after two years of work on its arches.</p><p>Engineers said that the stones had been cleaned and put back one by one.</p></article>
    <section id="talk"><h2>3 thoughts</h2><ol class="commentlist"><li><p>Great news, I missed that way to work.</p></li></ol></section></div><aside id="second"><h3>Recent</h3><ul><li><a href=3>Older item</a></li></ul></aside><footer><p>All rights reserved.</p></footer></div></body></html>""",
     ["Bridge reopens after a long repair", "The old bridge over the river was opened again on Monday, after two years of work on its arches.", "Engineers said that the stones had been cleaned and put back one by one."],
     ["The Daily Stone", "News since 1901", "World", "Sport", "3 thoughts", "Great news, I missed that way to work.", "Recent", "Older item", "All rights reserved."]),
    ("""<body><div role="banner"><a href=/>Docs</a></div><div class="wy-grid"><nav><ul><li><a href=a>Install</a></li><li><a href=b>Use</a></li></ul></nav><main role="main"><div><h1>Install</h1><p>Get the archive and unpack it into a folder of your own.</p><pre>tar xf tool.tar</pre><p>Then run the script with the name of the folder.</p><ul><li>Linux and others need a shell.</li><li>No account is needed.</li></ul></div></main></div><footer role="contentinfo">Built by a tool</footer></body>""",
     ["Install", "Get the archive and unpack it into a folder of your own.", "tar xf tool.tar", "Then run the script with the name of the folder.", "Linux and others need a shell.", "No account is needed."],
     ["Docs", "Use", "Built by a tool"]),
    ("""<body><div class="z1"><div class="z2"><a href=1>Shop</a> <a href=2>Cart</a> <a href=3>Help</a></div><div class="z3"><div class="z4"><h2>On keeping bees in town</h2><p>Bees do well in towns, since gardens flower from spring to autumn and few sprays are used there.</p><p>A hive needs sun in the morning, a little water near by and a place where nobody walks past its front.</p><blockquote><p>They taught me to be slow, said one keeper.</p></blockquote><p>Two hives make it easier to tell whether one of them is ill.</p></div><div class="z5"><form><label>Mail</label><input><button>Join</button></form></div></div><div class="z6"><a href=4>Imprint</a> <a href=5>Terms</a></div></div></body>""",
     ["On keeping bees in town", "Bees do well in towns, since gardens flower from spring to autumn and few sprays are used there.", "A hive needs sun in the morning, a little water near by and a place where nobody walks past its front.", "They taught me to be slow, said one keeper.", "Two hives make it easier to tell whether one of them is ill."],
     ["Shop Cart Help", "Mail", "Join", "Imprint Terms"]),
]


def test_pages_of_other_makers(model):
    right = total = 0
    for page, content, rest in OTHERS:
        got = html_tree.main_text(page, model).split("\n")
        right += sum(x in got for x in content) + sum(x not in got for x in rest)
        total += len(content) + len(rest)
    assert right / total > 0.9, right / total
