"""Pages whose wrappers are named like boilerplate, and pages whose text is not all in an article."""

from html.parser import HTMLParser

import pytest

from tidegrid.llm import html
from tidegrid.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"

PROSE = "The river was low and it is said that the bank of the stream was on the map for a year or so in the past. "
LONG, OTHER = (PROSE * 2).strip(), ("It is a town in the hills and the road to it was built by the men who were at the mill in that year. " * 2).strip()


@pytest.mark.parametrize("wrapper", ["<div class='layout has-sidebar'>", "<div id='page-with-header'>", "<div class='no-ads'>", "<form id=aspnetForm action=x>", "<div class='header-layout'>", "<section class=pageWithHeader>", "<div class=ads>"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_wrappers_named_like_boilerplate(wrapper, inner):
    if inner == "div" and "=ads" in wrapper:
        return
    tag = wrapper[1:].split()[0]
    page = f"<body><nav><a href=1>Home</a></nav>{wrapper}<{inner}><h1>Title</h1><p>{LONG}</p><p>Short.</p><form>Name <input></form><div class=ad>Buy</div><div id=comments><p>{OTHER}</p></div></{inner}><div class=sidebar>side</div></{tag}><footer>me</footer></body>"
    assert html.main_text(page) == f"Title\n{LONG}\nShort."


def test_boilerplate_beside_the_text_stays_out():
    page = f"<article><p>{LONG} {LONG} {LONG}</p></article><div class=related><article><p>{OTHER}</p></article></div><div class=ad>{OTHER}</div><div class=sidebar>{OTHER}</div><form>{OTHER}</form>"
    assert html.main_text(page) == f"{LONG} {LONG} {LONG}"


def test_prose_outside_a_teaser_article():
    page = f"<div><h1>Title</h1><p>{LONG}</p><p>Short one.</p><p>{OTHER}</p></div><div><article><h2>Teaser</h2><p>Soon.</p></article></div>"
    assert html.main_text(page) == f"Title\n{LONG}\nShort one.\n{OTHER}\nTeaser\nSoon."


def test_undecided_blocks_inherit_in_their_article():
    menu = "".join(f"<p><a href={k}>Another story {k}</a></p>" for k in range(4))
    page = f"<h1>Site</h1><article><p>{LONG}</p><p>A line.</p>{menu}<p>You may like</p>{menu}</article><article><p>Only short.</p></article>"
    assert html.main_text(page) == f"{LONG}\nA line.\nOnly short."
    odd = "Zażółć gęślą jaźń " * 12
    assert html.main_text(f"<p>Site</p><main><p>{odd}</p><p>Krótko.</p></main>") == f"{odd.strip()}\nKrótko."


@pytest.mark.parametrize(
    ("lang", "line", "short"),
    [
        ("ru", "Река была низкой, и говорят, что берег ручья был на карте уже год. ", "Коротко."),
        ("zh", "河水很低，据说这条小溪的岸边在地图上已经有一年多了。", "短句。"),
        ("tr", "İstanbul'da nehir alçaktı ve derenin kıyısının bir yıldır haritada olduğu söyleniyor. ", "Kısa."),
        ("en", "Река была низкой, и говорят, что берег ручья был на карте уже год. ", "Коротко."),
    ],
)
def test_languages_without_stop_words(lang, line, short):
    prose = (line * 4).strip()
    page = f"<html lang={lang}><body><nav><a href=1>{short}</a></nav><div><p>{prose}</p><SCRIPT>var x = '<p>';</SCRIPT><p>{short}</p></div><div class=ad>{prose}</div><footer>{short}</footer>"
    assert html.main_text(page) == f"{prose}\n{short}"
    outside = f"<html lang={lang}><body><div>{prose}</div><article><p>{prose}</p><p>{short}</p></article><div>{short}</div>"
    assert html.main_text(outside) == f"{prose}\n{short}"


def test_raw_text_ends_in_any_case():
    page = f"<p>İ {LONG}</p><SCRIPT>a<b</script ><p>{OTHER}</p><style>p{{}}</STYLE><p>{LONG}"
    assert html.main_text(page) == f"İ {LONG}\n{OTHER}\n{LONG}"


class _Article(HTMLParser):
    """Blocks of the article of pages as the tables have them: written from what their markup means, with another parser."""

    OUT = {"nav", "footer", "header", "aside", "form", "script", "style", "title", "figure", "noscript", "button"}
    NAMED = {"ad", "sidebar", "comments", "related", "share", "newsletter", "cookie"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.lines, self.now = [], [], ""

    def cut(self):
        if line := " ".join(self.now.split()):
            self.lines.append(line)
        self.now = ""

    def handle_starttag(self, tag, attributes):
        if tag in ("br", "img", "meta", "hr", "input", "link"):
            self.now += " "
            return
        if tag not in ("a", "b", "i", "em", "span", "strong", "code"):
            self.cut()
        out = tag in self.OUT or bool(self.NAMED & set(" ".join(v or "" for k, v in attributes if k in ("class", "id")).split()))
        self.open.append((tag, out))

    def handle_endtag(self, tag):
        if tag not in ("a", "b", "i", "em", "span", "strong", "code"):
            self.cut()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t in ("article", "main") for t, _ in self.open) and not any(out for _, out in self.open):
            self.now += data


def plain_text(page):
    parser = _Article()
    parser.feed(page or "")
    parser.close()
    parser.cut()
    return "\n".join(parser.lines)


def test_query_against_a_plain_version(spark):
    got = {r.page_id: r for r in QUERIES["op4_html_extraction"](spark, SF_DIR).collect()}
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()
    assert len(got) == len(pages) and all((got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (t := plain_text(p.html), len(t), p.url) for p in pages)


def test_pages_without_article_elements(spark):
    """The same pages with plain elements keep at least 99 % of the characters of those that have a long block."""
    pages = [(p.html, plain_text(p.html)) for p in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()]
    pages = [(p.replace("<article", "<div").replace("</article", "</div"), t) for p, t in pages if any(len(line) >= html.LONG for line in t.split("\n"))]
    assert pages and sum(len(html.main_text(p)) for p, _ in pages) >= 0.99 * sum(len(t) for _, t in pages)
