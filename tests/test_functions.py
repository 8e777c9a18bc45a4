"""Column functions on the cases that pin their behaviour."""

import pytest
from pyspark.sql import functions as F

from pagestrata.functions import checks, dates, readability, robots, text, urls
from pagestrata.functions.numbers import half_up, round1


def column(spark, values, expression, kind="string"):
    """The expression (a function of the column) for each value."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_rounding(spark):
    assert column(spark, [-2.5, 2.5, 0.04, 0.05], lambda v: half_up(v).cast("int"), "double") == [-2, 3, 0, 0]
    assert column(spark, [2.25, -2.25, 1.0], round1, "double") == [2.3, -2.2, 1.0]


def test_url_keys(spark):
    url = ["https://www.Example.com:443/a%20b/?q=1#x", "http://example.com", "nonsense"]
    assert column(spark, url, urls.history_key) == ["https://www.example.com/a%20b", "http://example.com", "nonsense"]
    assert column(spark, url, urls.snapshot_path) == ["/a%20b?q=1", "/", "nonsense"]
    assert column(spark, url, urls.page_key) == ["example.com/a b", "example.com/", None]
    assert column(spark, url, urls.canonical_key) == ["https://www.example.com/a%20b", "http://example.com/", None]
    assert column(spark, url, urls.link_key) == ["www.example.com/a%20b?q=1", "example.com/", None]
    assert column(spark, url, urls.robots_path) == ["/a%20b/?q=1", "/", "/"]
    assert column(spark, ["https://a.b.co.uk/", "http://x.y.example.ch", "http://localhost:80/", "http://10.0.0.1/"], urls.registrable_domain) == ["b.co.uk", "example.ch", "localhost", "10.0.0.1"]
    assert column(spark, [" example.com/x ", "HTTP://a", "a b", ""], urls.normalized_input) == ["https://example.com/x", "HTTP://a", None, None]
    assert column(spark, ["https://A.org/x/#y", "https://a.org/X"], urls.source_key) == ["https://a.org/x", "https://a.org/x"]


FACTS = [
    "30 % of all", "30% of", "4,5 Prozent", "12 percent", "5 TWh Strom", "1,2 Mrd. Franken", "300 Millionen Menschen", "50 CHF", "20 € pro Tag", "36 m² Fläche", "250 Quadratmeter", "12 km weit", "3,5 kg schwer",
    "200 Liter", "21 °C warm", "2 Hektar", "CHF 50", "$5", "1'200 Personen", "1 200 Stück", "gemäss BFE", "laut Studie", "einer Umfrage zufolge", "according to a study", "120 square feet",
]
NO_FACTS = ["Copyright 2024", "Energiestrategie 2050", "044 421 35 35", "Kapitel 3", "lautlos", "nothing here", "12 kmx"]


def test_facts(spark):
    assert column(spark, FACTS, text.is_fact) == [True] * len(FACTS)
    assert column(spark, NO_FACTS, text.is_fact) == [False] * len(NO_FACTS)


def test_citations(spark):
    cases = ["so (Schärli, 2023) says", "(Bundesamt für Energie, 2024)", "(BFE 2024)", "(Müller et al. 2023)", "as [1] and [2, 3]", "Quelle: BFS", "just (2024)", "(müller, 2023)"]
    assert column(spark, cases, text.citation_count) == [1, 1, 1, 1, 2, 1, 0, 0]


def test_definitions(spark):
    yes = ["Ein Smart Meter ist ein digitaler Stromzähler. Mehr.", "Überschuss bezeichnet den Teil.", "Unter Eigenverbrauch versteht man den Anteil.", "First. A heat pump is a device that heats.", "Photovoltaik wird oft als Technik definiert als Umwandlung.", "La biomasse désigne la matière.", "El hidrógeno es un gas.", "A biomassa é um recurso.", "La biomassa è una fonte."]
    no = ["Ob das sinnvoll ist, wissen wir nicht.", "Das ist ein Problem.", "It is a good idea.", "Was ist ein Smart Meter?", "Hier ist ein Überblick.", "We walked."]
    assert all(column(spark, yes, text.definition))
    assert column(spark, no, text.definition) == [None] * len(no)
    assert column(spark, ["A first one. A tree is a plant."], text.definition) == ["A tree is a plant."]


def test_steps_and_questions(spark):
    assert column(spark, ["1. Schritt eins", "2) dann", "- Punkt", "Erstens dies", "1. Januar 2025", "1. 000", "Text"], text.is_structured) == [True, True, True, True, False, False, False]
    assert column(spark, ["Was kostet es", "how is it", "Où est", "Wasser", "¿x"], text.opens_question) == [True, True, True, False, False]
    assert column(spark, ["  Was  IST das ? ", "x"], text.question_key) == ["was ist das", "x"]
    assert column(spark, ["a. b! c? d… e", "", "z. B. so"], text.sentences) == [["a.", "b!", "c?", "d…", "e"], [], ["z.", "B.", "so"]]


def test_anchors_images_titles(spark):
    assert column(spark, ["hier", "Read More", "→", "Our report", " mehr erfahren "], text.is_descriptive) == [False, False, False, True, False]
    assert column(spark, ["https://x.y/img/site-logo.png?x", "/a/default_image.jpg", "/a/photo-of-logos.jpg", "logo.svg"], text.is_generic_image) == [True, True, False, True]
    assert column(spark, ["https://x.y/a/b%20c.png?x=1", "", "d.png"], text.file_name) == ["b c.png", "", "d.png"]
    assert column(spark, ["Do this first. Then that.", "x" * 100], text.first_sentence_title) == ["Do this first", "x" * 89 + "…"]


def readable(spark, blocks, lang):
    df = spark.createDataFrame([(blocks, lang)], "b array<string>, l string")
    return readability.with_readability(df, F.col("b"), F.col("l")).select("readability").head()[0]


def test_readability(spark):
    # ten words, six of them long, one sentence: 10 + 60
    r = readable(spark, ["Bewilligungsverfahren Energieversorgung Stromproduktion Versorgungssicherheit Regulierung Gesetzgebung das ist so da"], "de")
    assert r["raw"] == 70.0 and r["score"] == 0.0 and r["formula"] == "lix"
    assert readable(spark, ["The cat sat on the mat. The dog ran to the log. It was a fun day for all."], "en")["score"] == 1.0
    assert readable(spark, ["too short"], "en") is None
    one, two = (readable(spark, b, "de")["raw"] for b in (["Das Haus ist alt und gross genug Das Dach ist neu und rot und gut"], ["Das Haus ist alt und gross genug", "Das Dach ist neu und rot und gut"]))
    assert two == one / 2
    assert column(spark, ["table", "make", "tree", "a", "reliable", ""], readability.syllables) == [2, 1, 1, 1, 3, 0]
    assert column(spark, ["neue", "Haus", "Mauer", "Seele"], lambda v: readability.syllables(v, "de")) == [2, 1, 2, 2]
    assert column(spark, ["der die das und ist nicht", "the and is are of to", "der the und and ist", "la le"], readability.guessed_language) == ["de", "en", None, None]
    blocks = F.array(F.lit("der die das und ist nicht"))
    assert column(spark, ["de-CH", "EN_us", " PL ", "und", None], lambda v: readability.content_language(v, blocks)) == ["de", "en", "pl", "de", "de"]
    assert column(spark, [25.0, 35.0, 45.0, 55.0, 65.0], lambda v: readability.band(v, F.lit("lix")), "double") == ["very_easy", "easy", "medium", "hard", "very_hard"]
    assert column(spark, [0.0, 0.5, 1.0], lambda v: readability.raw_for_score(v, F.lit("lix")), "double") == [65.0, 52.5, 40.0]


@pytest.mark.parametrize(
    "given, want",
    [
        ("2024-08-11 10:00", "2024-08-11"), ("Last updated: August 11, 2024", "2024-08-11"), ("11. März 2024", "2024-03-11"), ("08/11/2024", "2024-08-11"), ("25/12/2023", "2023-12-25"), ("11.08.2024", "2024-08-11"),
        ("31.02.2024", None), ("1. Mai 1685", None), ("1. Mai 2030", None), ("2024-02-31, 1.3.2024", "2024-03-01"), ("", None),
    ],
)
def test_text_dates(spark, given, want):
    found = column(spark, [given], lambda v: dates.text_date(v, F.lit("2024-09-01").cast("timestamp")))[0]
    assert (found.isoformat() if found else None) == want


def test_ages(spark):
    now = F.lit("2024-07-01 12:00:00").cast("timestamp")
    at = ["2023-07-01 12:00:00", "2023-07-01 11:59:59", "2024-07-02 12:00:00", "2024-07-02 12:00:01"]
    assert column(spark, at, lambda v: dates.within_last_year(v.cast("timestamp"), now)) == [True, False, True, False]
    assert column(spark, [0, 2, 61, 730], dates.age_bucket, "int") == ["today", "days", "months", "years"]
    assert [tuple(x) for x in column(spark, ["2024-07-01 11:59:45", "2024-07-01 11:30:00", "2024-06-29 12:00:00"], lambda v: dates.relative_label(v.cast("timestamp"), now))] == [("now", 0), ("minutes", 30), ("days", 2)]


def test_check_changes(spark):
    df = spark.createDataFrame([({"a": True, "b": False, "c": True}, {"a": False, "b": True, "d": True})], "x map<string,boolean>, y map<string,boolean>")
    assert tuple(df.select(checks.fixed(F.col("x"), F.col("y")), checks.regressed(F.col("x"), F.col("y"))).head()) == (["b"], ["a"])


# -- robots --


def blocked(spark, body, path="/x", bot="GPTBot"):
    return column(spark, [body], lambda v: robots.is_blocked(robots.rules_for(robots.groups(v), F.lit(bot)), F.lit(path)))[0]


@pytest.mark.parametrize(
    "body, path, bot, want",
    [
        ("User-agent: *\nDisallow: /", "/x", "GPTBot", True),
        ("User-agent: *\nDisallow:", "/x", "GPTBot", False),
        ("User-agent: gptbot\n\nDisallow: /", "/x", "GPTBot", True),
        ("User-agent: GPTBot # no\nDisallow: / # all", "/x", "GPTBot", True),
        ("User-agent: *\nDisallow: /\nUser-agent: GPTBot\nAllow: /", "/x", "GPTBot", False),
        ("User-agent: GPTBot\nUser-agent: CCBot\nDisallow: /", "/x", "CCBot", True),
        ("User-agent: GPTBot\nDisallow: /a\nUser-agent: *\nDisallow: /\nUser-agent: GPTBot\nDisallow: /b", "/b", "GPTBot", True),
        ("User-agent: GPTBot\nDisallow: /a\nUser-agent: *\nDisallow: /", "/x", "GPTBot", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", "GPTBot", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", "GPTBot", False),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf", "GPTBot", True),
        ("User-agent: *\nDisallow: /*.pdf$", "/x/y.pdf?z", "GPTBot", False),
        ("User-agent: *\nDisallow: /a*b", "/a--b", "GPTBot", True),
        ("User-agent: *\nDisallow: /a.b", "/aXb", "GPTBot", False),
        ("User-agent: *\r\nCrawl-delay: 5\r\nDisallow: /x", "/x?y", "GPTBot", True),
        ("Disallow: /\nUser-agent: *", "/x", "GPTBot", False),
        ("", "/x", "GPTBot", False),
    ],
)
def test_robots(spark, body, path, bot, want):
    assert blocked(spark, body, path, bot) is want


def test_robots_files(spark):
    df = spark.createDataFrame([(200, "User-agent: CCBot\nDisallow: /"), (503, ""), (404, "x"), (200, "<!DOCTYPE html>"), (200, " \n"), (200, "User-agent: *\nContent-Signal: search=no, ai-train=yes, x=maybe")], "s int, b string")
    rows = [r[0] for r in df.select(robots.robots_txt(F.col("s"), F.col("b"), F.lit("/"))).collect()]
    assert [(r["exists"], r["unreachable"], len(r["blockedBots"])) for r in rows] == [(True, False, 1), (False, True, 14), (False, False, 0), (False, False, 0), (False, False, 0), (True, False, 0)]
    assert rows[5]["signals"] == {"search": "no", "ai-train": "yes"} and rows[0]["signals"] is None
    assert column(spark, ["Sitemap: https://a/s.xml # x\nsitemap : /rel\nSITEMAP: http://b/t.xml"], robots.sitemaps) == [["https://a/s.xml", "http://b/t.xml"]]


def test_headers(spark):
    given = ["noindex, nofollow", "otherbot: noindex", "otherbot: noindex, googlebot: nosnippet, max-snippet: 20", "max-snippet:5, gptbot: none", "", None]
    assert column(spark, given, robots.header_directives) == [["noindex", "nofollow"], [], ["nosnippet", "max-snippet: 20"], ["max-snippet:5", "none"], [], []]
    assert column(spark, given[:4], lambda v: robots.max_snippet(robots.header_directives(v))) == [None, None, 20, 5]
    assert column(spark, [403, 200, 503, 404], lambda v: robots.is_blocked_response(v, F.lit(None).cast("string")), "int") == [True, False, True, False]
    assert column(spark, [200], lambda v: robots.is_blocked_response(v, F.lit("challenge")), "int") == [True]


def test_cuts_of_text(spark):
    long = "Ein langer Satz über die Heizung, der rund 30 % der Energie im Haus spart und dann noch sehr lange weitergeht, ohne Ende."
    assert column(spark, [long, "kurz", "x" * 80], text.clip_at_word) == ["Ein langer Satz über die Heizung, der rund 30 % der Energie…", "kurz", "x" * 60 + "…"]
    cut = column(spark, [long, "nichts davon", "30 % sind kurz", "30 % am Anfang " + long, long[:90] + "genau 5 %"], lambda t: text.match_excerpt(t, [r"\d+ %"]))
    assert cut[1] is None and cut[2] == "30 % sind kurz" and cut[3].startswith("30 % am Anfang") and cut[3].endswith("…")
    assert cut[0].startswith("…") and cut[0].endswith("…") and "30 %" in cut[0] and len(cut[0]) <= 62 and cut[0].strip("…") in long
    many = spark.createDataFrame([(["a b", "c"],)], "t array<string>").select(text.quoted(F.col("t"))).head()[0]
    assert many == "«a b», «c»"


def test_markup_and_placeholders(spark):
    body = "## Was & wie\n\n**Fett** und `code` siehe https://a.ch/x\n- eins\n- zwei <b>\n---\nEnde\n```html\n<p>\n  \"x\"\n```\nnach"
    html = column(spark, [body, "", "- a\n\n- b"], text.markdown_html)
    assert html[0].split("\n") == [
        "<h2>Was &amp; wie</h2>", '<p><strong>Fett</strong> und <code>code</code> siehe <a href="https://a.ch/x">https://a.ch/x</a></p>', "<ul><li><p>eins</p></li><li><p>zwei &lt;b&gt;</p></li></ul>", "<p>Ende</p>",
        "<p><code>&lt;p&gt;<br>  &quot;x&quot;</code></p>", "<p>nach</p>",
    ]
    assert html[1] == ""
    row = spark.createDataFrame([("{n} von {m}, {x}", {"n": "3", "m": "4"})], "t string, p map<string,string>").select(text.filled(F.col("t"), F.col("p")), text.escaped(F.lit("a'<"))).head()
    assert tuple(row) == ("3 von 4, {x}", "a&#39;&lt;")
