import re
from html.parser import HTMLParser

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casekit.operators import dom, extract

WORD = re.compile("(?i)sum[aá]rio")


class Plain(HTMLParser):
    """Nested lists [tag, parts], by recursion over objects."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [["#page", []]]

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in dom._VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        if any(n[0] == tag for n in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        self.open[-1][1].append(data)

    def handle_comment(self, data):
        self.open[-1][1].append(None)


def plain(source):
    p = Plain()
    p.feed(source)
    p.close()
    return p.open[0]


def strings(node, drop=()):
    if node[0] in drop:
        return []
    return [x for k in node[1] for x in (strings(k, drop) if isinstance(k, list) else [k.strip()] if k and k.strip() and node[0] not in dom._NO_TEXT else [])]


def only(node):
    return None if len(node[1]) != 1 else only(node[1][0]) if isinstance(node[1][0], list) else node[1][0]


def plain_section(root):
    def walk(node):
        for i, k in enumerate(node[1]):
            if not isinstance(k, list):
                continue
            if k[0] in ("b", "strong") and (name := only(k)) and WORD.search(name):
                lines = []
                for after in node[1][i + 1 :]:
                    if isinstance(after, list):
                        if after[0] in ("b", "strong"):
                            break
                        lines.append("".join(strings(after)))
                if len(text := "\n".join(x for x in lines if x)) > 20:
                    return text
            if (found := walk(k)) is not None:
                return found
        return None

    return walk(root)


PIECES = ["<b>", "</b>", "<strong>", "</strong>", "<p>", "</p>", "<div class='a>b'>", "</div>", "<nav>", "</nav>", "<br>", "<br/>", "<i/>", "<!-- c -->", "Sumário", "sumario: ", " ", "words of a text ", "&amp;", "&lt;p>", "<script>x<b></script>", "<b>Sumário</b>", "<form>", "</form>"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40))
def test_trees_against_nested_objects(pieces):
    source = "".join(pieces)
    t, root = dom.tree(source), plain(source)
    drop = frozenset({"nav", "form"})
    assert "".join("".join(t.lines(0, drop)).split()) == "".join("".join(strings(root, drop)).split())
    assert dom.section(t, WORD) == plain_section(root)


def test_nested_and_unclosed_pages():
    def section(page):
        return dom.section(dom.tree(page), WORD)

    assert section("<b>Sumário:</b><p>Uma <i>coisa</i> muito longa<div>outra</div>") == "Umacoisamuito longaoutra"
    assert section("<div><strong><em>SUMARIO</em></strong> solto <p>primeiro ponto</p>solto<ul><li>a<li>b</ul><b>Texto</b><p>fora</p></div>") is None
    assert section("<div><strong><em>SUMARIO</em></strong> solto <p>primeiro ponto longo</p>solto<ul><li>a<li>b</ul><b>Texto</b><p>fora</p></div><p>fora</p>") == "primeiro ponto longo\nab"
    assert section("<b>Sumário</b><p>curto</p><b>x</b><td><b>o sumário</b><span>este é o que conta, e basta</span>") == "este é o que conta, e basta"
    assert section("<b>Sumário <i>x</i></b><p>um texto com mais de vinte</p>") is None
    assert dom.tree("a<nav>b<nav>c</nav>d</nav>e<form>f<p>g").lines(0, frozenset({"nav", "form"})) == ["a", "e"]
    assert dom.tree("x</p></nav>y<P CLASS=a>z</p >").lines() == ["x", "y", "z"]
    assert dom.tree("<script>if (a</b) '<p>'</script>t<style>u").lines() == ["t"]


def test_deep_and_long_pages():
    deep = "<div>" * 20_000 + "<b>Sumário</b>" + "<i></i>" * 20_000 + "<p>um texto com mais de vinte</p>"
    assert dom.section(dom.tree(deep), WORD) == "um texto com mais de vinte"
    assert len(dom.tree("<p>w" * 50_000).lines()) == 50_000


def test_columns(spark):
    pages = [(None,), ("",), ("<b>Sumário</b><p>pequeno</p><p>Relatório:</p>",), ("<i>Sumário:</i> o que se diz em mais de vinte<br>Acordam:<b>x</b>",), ("<b>Sumário</b><p>o que se diz em mais de vinte",)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "i int, h string").repartition(3)
    got = {r.i: (r.s, r.t) for r in df.select("i", extract.summary_of_page(F.col("h")).alias("s"), extract.full_text(F.col("h"), "boc").alias("t")).collect()}
    assert got[0] == (None, None) and got[1] == (None, "") and got[2][0] is None
    assert got[3][0] == got[4][0] == "o que se diz em mais de vinte"
    assert spark.createDataFrame([], "h string").select(extract.summary_of_page(F.col("h"))).count() == 0


def test_references_without_semicolon(spark):
    """The query's SQL reads a name that is cut off before its semicolon as text."""
    assert dom.tree("a &amp</h1>b &amp; c &lt;d").lines() == ["a &", "b & c <d"]
    assert dom.tree("a &amp</h1>b &amp; c &lt;d &#65; &#x42; &none; &notit; &amp;quot;", True).lines() == ["a &amp", 'b & c <d A B &none; &notit; &quot;']
    df = spark.createDataFrame([("<b>Sumário</b><p>o que se diz em mais de vinte &amp</p>",)], "h string")
    got = df.select(extract.summary_of_page(F.col("h"), closed=True).alias("s"), extract.full_text(F.col("h"), "dv", closed=True).alias("t")).first()
    assert got.s == "o que se diz em mais de vinte &amp" and got.t.endswith("vinte &amp")


def test_summaries_of_any_length(spark):
    df = spark.createDataFrame([("<b>Sumário:</b><h1>um</h1><p>dois</p></article><footer>o que fica de fora da página</footer>",)], "h string")
    got = df.select(extract.summary_of_page(F.col("h"), least=0).alias("s"), extract.summary_of_page(F.col("h")).alias("t")).first()
    assert got.s.startswith("um\ndois") and got.t is not None
