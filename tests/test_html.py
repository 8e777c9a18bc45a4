"""Trees, content scope and extraction on hand-written pages."""

import time
from datetime import datetime

import pytest

from pagestrata.html import udf, weburl
from pagestrata.html.extract import Page, instant, max_snippet, person_like, phone_digits, text_date
from pagestrata.html.scope import as_read
from pagestrata.html.tree import DEPTH, parse

URL = "https://www.example.ch/de/artikel/x?page=2"


def page(body, head="", url=URL, attrs=' lang="de-CH"'):
    return Page(f"<!doctype html><html{attrs}><head>{head}</head><body>{body}</body></html>", url)


def record(body, **kw):
    return page(body, **kw).record()


# -- tree --


def shape(e):
    return [e.tag, *(c if isinstance(c, str) else shape(c) for c in e.children)]


def body_of(html):
    return shape(parse(html).child_elements[1])[1:]


def test_implied_ends():
    assert body_of("<p>a<p>b<div>c</div>") == [["p", "a"], ["p", "b"], ["div", "c"]]
    assert body_of("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [["ul", ["li", "a"], ["li", "b", ["ul", ["li", "c"]]], ["li", "d"]]]
    assert body_of("<table><tr><td>a<td>b<tr><th>c</table>x") == [["table", ["tr", ["td", "a"], ["td", "b"]], ["tr", ["th", "c"]]], "x"]
    assert body_of("<dl><dt>a<dd>b<dt>c</dl>") == [["dl", ["dt", "a"], ["dd", "b"], ["dt", "c"]]]
    assert body_of("a<br>b<img src=x>c") == ["a", ["br"], "b", ["img"], "c"]


def test_formatting_goes_on_after_a_block_ends():
    assert body_of("<p><b>a<p>b</b>c") == [["p", ["b", "a"]], ["p", ["b", "b"], "c"]]


def test_raw_text_and_head():
    root = parse('<title>T &amp; U</title><script>var t="</p>";</script><p>x')
    assert [e.tag for e in root.child_elements[0].child_elements] == ["title", "script"]
    assert root.child_elements[0].child_elements[0].text == "T & U"


def test_broken_pages():
    for html in ("", None, "just text", "<", "</p></div>", "<p" * 50, "<div>" * 3000 + "deep", "<!-- open", "<html><body><p>cut", "\x00<p>&#0;&unknown;"):
        made = Page(html, URL).record()
        assert made["lists"] == []


def test_deep_and_large_pages():
    deep = "<div>" * 5000 + "<p>A paragraph far down, long enough to be one.</p>"
    made = Page(deep, URL)
    assert max(sum(1 for _ in e.line()) for e in made.elements) <= DEPTH + 1 and made.record()["paragraphs"] == ["A paragraph far down, long enough to be one."]
    began = time.process_time()
    for html in ("<p><b>" * 5000 + "x", "<ul><li>" * 5000, "".join(f"<section><h2>Is it {i}?</h2><p>The answer to question {i} is this paragraph.</p></section>" for i in range(3000))):
        Page(html, URL).record()
    assert time.process_time() - began < 20


def test_formatting_alike_goes_on_three_times():
    shape_ = body_of("<p><b><b><b><b><b>a<p>b")
    assert shape_[1] == ["p", ["b", ["b", ["b", "b"]]]]


def test_batches_by_pages_and_bytes():
    assert udf.cuts([]) == [] and udf.cuts([1] * 130) == [64, 128, 130]
    assert udf.cuts([9_000_000, 1, 7_999_999, 1]) == [1, 3, 4]


def test_numbers_follow_the_document():
    root = parse("<div><p>a</p><p>b<i>c</i></p></div><hr>")
    order = [e.pre for e in root.walk()]
    assert order == sorted(order) and len(set(order)) == len(order)
    div, hr = root.tags("div")[0], root.tags("hr")[0]
    assert div.contains(root.tags("i")[0]) and not div.contains(hr)


# -- URLs --


@pytest.mark.parametrize(
    "given, want",
    [
        ("/a/../b/./c", "https://www.example.ch/b/c"), ("?q=1", "https://www.example.ch/de/artikel/x?q=1"), ("//Other.COM:443/x", "https://other.com/x"), ("HTTP://x.y:80", "http://x.y/"),
        ("../z", "https://www.example.ch/de/z"), ("a b/ü", "https://www.example.ch/de/artikel/a%20b/%C3%BC"), ("mailto:a@b", None), ("javascript:void(0)", None), ("http://", None),
    ],
)
def test_resolving(given, want):
    u = weburl.parse(given, URL)
    assert (u.href if u else None) == want


def test_registrable():
    assert [weburl.registrable(h) for h in ("shop.example.co.uk", "a.b.example.com", "example.ch", "localhost", "10.0.0.1")] == ["example.co.uk", "example.com", "example.ch", "localhost", "10.0.0.1"]


# -- scope --


def test_root_is_the_article_with_the_title():
    r = record("<article><p>Teaser text of another article, long enough.</p></article><article><h1>Main</h1><p>The text of the main article is here, long enough.</p></article>")
    assert r["paragraphs"] == ["The text of the main article is here, long enough."]


def test_title_outside_widens_the_root():
    r = record("<main><h1>Title</h1><p>An introduction above the article, long enough.</p><article><p>The text of the article itself is here.</p></article></main>")
    assert len(r["paragraphs"]) == 2 and r["headings"][0] == {"level": 1, "text": "Title"}


def test_chrome_is_left_out():
    r = record(
        "<header><nav><ul><li>Menu</ul></nav></header><main><h1>T</h1><div class='newsletter-box'><ul><li>x</ul></div><div class='unrelated shared-layout'><ul><li>kept</ul></div>"
        "<div aria-label='Artikel teilen'><ul><li>x</ul></div><aside><ul><li>x</ul></aside><section><header><h2>Inner</h2></header></section></main><footer><ul><li>Imprint</ul></footer>"
    )
    assert [x["items"] for x in r["lists"]] == [["kept"]]
    assert [h["text"] for h in r["headings"]] == ["T", "Inner"]


def test_boilerplate_heading_takes_its_block():
    r = record("<main><h1>T</h1><div><div><h2>Related articles</h2><ul><li>one</ul></div></div><div><h2>Own part</h2><ul><li>two</ul></div></main>")
    assert [x["items"] for x in r["lists"]] == [["two"]] and [h["text"] for h in r["headings"]] == ["T", "Own part"]


def test_promo_block_and_source_list():
    promo = "<div><h3>Dossier</h3><a href='/a'>All about the topic of the year</a></div>"
    sources = "<div><h3>Sources</h3><ul><li><a href='https://other.org/a'>A study about the topic</a></ul></div>"
    r = record(f"<main><h1>T</h1>{promo}{sources}</main>")
    assert [h["text"] for h in r["headings"]] == ["T", "Sources"] and len(r["lists"]) == 1
    assert [(x["isExternal"], x["isNavigational"]) for x in r["links"]] == [(False, True), (True, False)]


def test_banner_title_counts():
    r = record("<header><h1>Site title</h1></header><main><h2>Part</h2></main>")
    assert [h["level"] for h in r["headings"]] == [1, 2]


# -- text --


def test_paragraphs():
    long = "This is a block of prose without a paragraph tag. It is long enough to be read as body text."
    r = record(f"<main><h1>The title of this page is repeated here</h1><p>The title of this page is repeated here</p><p>Short.</p><p>A paragraph that is long enough to count.</p><p>A paragraph that is long enough to count.</p><div>{long}</div><div>label only {'x' * 90}</div><a href='/x'><p>A teaser paragraph inside a link, long enough.</p></a></main>")
    assert r["paragraphs"] == ["A paragraph that is long enough to count.", long]


def test_reading_keeps_blocks_apart():
    e = parse("<a><div>Lukas Federer</div><div>Bereichs<b>leiter</b></div></a>").tags("a")[0]
    assert as_read(e) == "Lukas Federer Bereichsleiter"


def test_summary_box():
    r = record("<main><h1>T</h1><p>An introduction that is long enough to count.</p><div><h2>Auf einen Blick</h2><ul><li>one<li>two</ul></div></main>")
    assert r["leadSummary"] == {"heading": "Auf einen Blick", "items": ["one", "two"], "paragraphsBefore": 1}
    assert record("<main><h2>Summary</h2></main>")["leadSummary"] is None


def test_faq_and_answers():
    r = record(
        "<main><h1>T</h1><h2>How does it work?</h2><p>It works in this way, as this paragraph says.</p><ul><li>a<li>b</ul><h2>Was wir bieten</h2><p>This is no question and so no answer.</p>"
        "<details><summary>Is it open?</summary><p>It is open every day of the week.</p></details><details><summary>Is it empty?</summary></details>"
        "<div data-state='closed'><h3><button aria-expanded='false' aria-controls='p1'>What is hidden?</button></h3><div id='p1' role='region' hidden></div></div><div class='faq-question'>Wo liegt das Haus</div></main>"
    )
    assert r["faqQuestions"] == ["Is it open?", "Is it empty?", "What is hidden?", "Wo liegt das Haus"] and r["faqAnswersHidden"] == 2
    pairs = {x["question"]: x["answer"] for x in r["questionAnswers"]}
    assert pairs == {"How does it work?": "It works in this way, as this paragraph says. a b", "What is hidden?": ""}


def test_tables_and_images():
    r = record("<main><table><caption>C</caption><tr><th>a<th>b<tr><td>1<td>2</table><table role=presentation><tr><td>1<td>2<tr><td>3<td>4</table><table><tr><td>one</table><img src=a.png alt=''><img data-src=b.png><img alt=none></main>")
    assert r["tables"] == [{"rows": 2, "cols": 2, "hasHeader": True, "caption": "C"}]
    assert [(i["src"], i["alt"]) for i in r["images"]] == [("a.png", ""), ("b.png", None)]


def test_local_signals():
    r = record("<main><h1>T</h1></main><footer>Hauptstrasse 12, 8001 Zürich · <a href='tel:+41442629900'>call</a> 044 262 99 01 · Öffnungszeiten</footer>")
    assert r["local"] == {"addresses": ["Hauptstrasse 12, 8001 Zürich"], "postalCodes": ["8001"], "phones": ["0442629901", "0442629900"], "hasOpeningHours": True}
    assert phone_digits("+41 44 262 99 00") == "0442629900"


# -- head --


def test_meta():
    head = (
        '<title> A  title </title><meta property="description" content="by property"><meta name="robots" content="NoIndex, max-snippet: 40"><meta name="googlebot" content="max-snippet:20">'
        '<link rel="canonical" href="/x/"><link rel="ALTERNATE" hreflang="fr" href="/fr/x"><meta name="viewport" content="width = device-width, user-scalable=0"><meta name="og:title" content=" "><meta property="og:title" content="OG"><meta property="twitter:card" content="summary">'
    )
    r = record("<main data-x><p data-nosnippet>hidden</p><p>shown</p><a href='/en/x'>English</a><a href='/de/y'>Deutsch</a></main>", head=head)
    assert r["meta"]["title"] == "A title" and r["meta"]["description"] == "by property"
    assert r["robotsMeta"]["hasNoIndex"] and r["robotsMeta"]["maxSnippet"] == 20 and 0 < r["robotsMeta"]["noSnippetShare"] < 0.5
    assert r["canonical"] == "https://www.example.ch/x/" and r["hreflang"] == {"alternates": [{"hreflang": "fr", "href": "https://www.example.ch/fr/x"}], "languageLinks": ["https://www.example.ch/en/x"]}
    assert r["viewport"] == {"hasViewport": True, "hasDeviceWidth": True, "userScalableNo": True, "rawContent": "width = device-width, user-scalable=0"}
    assert r["openGraph"]["title"] == "OG" and r["twitterCard"]["card"] == "summary" and r["lang"] == "de"


def test_languages_of_a_page():
    assert [record("", attrs=a)["lang"] for a in (' lang="EN_us"', ' lang=" PL "', ' lang="x-default"', "")] == ["en", "pl", None, None]
    head = '<script type="application/ld+json">{"@type":"WebPage","inLanguage":[{"alternateName":"fr"}]}</script>'
    assert record("", head=head, attrs="")["lang"] == "fr"
    assert max_snippet(["max-snippet:-1"]) == -1 and max_snippet(["max-snippet:-1", "max-snippet:5"]) == 5 and max_snippet([]) is None


# -- structured data --


GRAPH = """<script type="application/ld+json">[{"@context":"https://schema.org","@graph":[
{"@type":"NewsArticle","@id":"#a","headline":"H","author":{"@id":"#p"},"publisher":{"@id":"#o"},"datePublished":"2024-01-05T10:00:00+02:00","dateModified":"2024-02-05"},
{"@type":"Person","@id":"#p","name":"Jane Doe","url":"https://x"},{"@type":["Organization","schema:Brand"],"@id":"#o","name":"Org","logo":"l","url":"u"}]}]</script>"""


def test_graph():
    r = record("", head=GRAPH + GRAPH + "<script type='application/ld+json'>{broken</script>")
    assert r["schemaTypes"] == ["NewsArticle", "Person", "Organization", "Brand"] and len(r["schema"]) == 3
    assert r["identity"] == {"org_name": "Org", "org_verifiable": True, "org_unnamed": False, "person_named": True, "person_verifiable": True, "topic": False, "linked_graph": True}
    assert r["completeness"] == {"found": 6, "total": 6, "gaps": [], "complete": ["NewsArticle", "Person", "Organization"], "unnamed_author": False}
    assert r["author"] == {"name": "Jane Doe", "source": "schema"}
    assert [(d["date"], d["source"]) for d in r["dates"]] == [(datetime(2024, 2, 5), "schema"), (datetime(2024, 1, 5, 8), "schema")]


def test_unnamed_author_and_circles():
    head = '<script type="application/ld+json">[{"@type":"Article","headline":"H","author":{"@type":"Person"},"datePublished":"2024-01-01"},{"@type":"Thing","@id":"#a","author":"#b"},{"@type":"Thing","@id":"#b","author":"#a","name":5}]</script>'
    r = record("", head=head)
    assert r["completeness"]["gaps"] == [{"type": "Article", "missing": ["author"]}] and r["completeness"]["unnamed_author"]
    assert r["author"] is None


def test_product_and_business():
    head = '<script type="application/ld+json">[{"@type":"Product","name":"P","sku":"1","brand":"B","offers":{"price":5,"priceCurrency":"CHF"},"hasVariant":[{"image":"i"}]},{"@type":"Bakery","name":"B","address":{"streetAddress":"s","postalCode":"8001"},"telephone":"+41 44 262 99 00","openingHours":"Mo"}]</script>'
    r = record("", head=head)
    assert {k for k, v in r["product"].items() if v is True} == {"price", "sku", "brand", "image"} and r["product"]["variants"] == 1
    assert r["business"] == {"type": "Bakery", "name": "B", "address_fields": ["streetAddress", "postalCode"], "postal_code": "8001", "telephone": "+41 44 262 99 00", "hours": True, "geo": False}


def test_microdata_and_rdfa():
    r = record("<div itemscope itemtype='https://schema.org/Recipe'><span itemprop=name>Cake</span><div itemprop=author itemscope itemtype='https://schema.org/Person'><span itemprop=name>Ann</span></div></div><div typeof='schema:FAQPage'><span typeof=Question></span></div>")
    assert r["schemaTypes"] == ["Recipe", "Person", "FAQPage"] and r["author"]["name"] == "Ann"


# -- author and dates --


def test_bylines():
    assert record("<main><h1>T</h1><p class=byline>von Hans-Peter von Arx</p></main>")["author"] == {"name": "Hans-Peter von Arx", "source": "dom"}
    assert record("<main><h1>T</h1></main><div id=comments><span class=comment-author>Jane Doe</span></div>")["author"] is None
    assert record("<main><span class=author>Über die Autorin</span></main>")["author"] is None
    assert person_like("Jane Doe") and not person_like("Read more from our authors") and not person_like("Jane")


@pytest.mark.parametrize(
    "text, want",
    [
        ("Stand: 11. August 2025", "2025-08-11"), ("Last updated: August 11, 2025", "2025-08-11"), ("Aug 1st 2024", "2024-08-01"), ("3. März 2021", "2021-03-03"), ("2024-02-30 or 11.08.2024", "2024-08-11"),
        ("08/11/2025", "2025-08-11"), ("25/12/2024", "2024-12-25"), ("11.08.2024", "2024-08-11"), ("31.02.2024", None), ("1. Mai 1685", None), ("no date", None),
    ],
)
def test_text_dates(text, want):
    found = text_date(text)
    assert (found.isoformat() if found else None) == want


def test_a_date_out_of_range_hides_no_other():
    assert text_date("2099-01-01, updated 3. März 2021", 2025).isoformat() == "2021-03-03" and text_date("2099-01-01", 2025) is None
    made = page("<main><h1>T</h1><p class='updated'>2099-01-01, then 11.08.2024</p></main>")
    made.last_year = 2025
    assert [d["formatted"] for d in made.dates()] == ["2099-01-01, then 11.08.2024"] and made.dates()[0]["date"] == datetime(2024, 8, 11)


def test_repeated_nodes_count_where_they_come_first():
    a, b = '{"@type":"Article","author":"Bob"}', '{"@type":"Thing","author":"Carl"}'
    r = record("", head="".join(f'<script type="application/ld+json">{x}</script>' for x in (a, b, a)))
    assert r["schemaTypes"] == ["Article", "Thing"] and r["author"] == {"name": "Bob", "source": "schema"}


def test_dates_of_a_page():
    r = record("<main><h1>T</h1><time datetime='2024-03-01'>1 March</time><div class='article-date'>3. April 2024</div><p>On 5. Mai 2024 it rained.</p><aside><time datetime='2020-01-01'></time></aside><a href=/x><time datetime='2019-01-01'></time></a></main><footer><p>Zuletzt aktualisiert: 6. Juni 2024</p></footer>")
    assert [(d["date"].date().isoformat(), d["source"]) for d in r["dates"]] == [("2024-03-01", "time-element"), ("2024-04-03", "text"), ("2024-06-06", "text")]
    assert instant("Tue, 05 Mar 2024 10:00:00 GMT") == datetime(2024, 3, 5, 10) and instant("soon") is None
