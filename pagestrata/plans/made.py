"""Queries over pages that are made from rows: each row's key decides what its page has, so the SQL can tell what it scores.

Customers become pages that differ in their head, parts become product pages, suppliers become pages with fetched inputs,
and orders become articles. The pages go through the whole engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..html.udf import dealt_out, page_data
from ..operators import scoring as S

AS_OF = "2024-07-01 00:00:00"
BASE = "https://www.example.ch/p/"
ALL_BOTS = [b for b, _ in config.BOTS]


#: Bytes of keys, as the plan estimates them, for a task: some ten thousand pages.
KEY_BYTES = 50_000
#: Parts of a record that decide the type of a page, which many criteria read.
TYPED = ("schemaTypes", "openGraph", "meta")


def scored(pages: DataFrame, criteria: tuple[str, ...], fields: tuple[str, ...]) -> DataFrame:
    """Rows of the named criteria. pages: page_id, url, html and inputs. fields: the parts of a record that they read."""
    records = page_data(pages, last_year=2025, fields=(*TYPED, *fields), dealt=True)
    return S.some_criteria(records, ("page_id",), criteria, F.lit(AS_OF).cast("timestamp")).select("page_id", "criterion", "points", "weight", "found", "met", "value")


def either(condition: str, text: str) -> Column:
    """The text where the condition on the key k holds; $k stands for the key."""
    return F.when(F.expr(condition), F.replace(F.lit(text), F.lit("$k"), F.col("k").cast("string"))).otherwise(F.lit(""))


def pages_of(rows: DataFrame, key: str, head: list[Column], body: list[Column]) -> DataFrame:
    k = F.col(key).alias("k")
    keyed = dealt_out(rows.select(k, *[c for c in rows.columns if c != "k"]), KEY_BYTES)  # keys are dealt out, not the pages made of them
    html = F.concat(F.lit('<!DOCTYPE html><html lang="de"><head>'), *head, F.lit("</head><body>"), *body, F.lit("</body></html>"))
    return keyed.select(F.col("k").alias("page_id"), F.concat(F.lit(BASE), F.col("k").cast("string")).alias("url"), html.alias("html"), "k")


SEO = ("title_quality", "meta_description", "image_alts", "indexability", "viewport", "social_cards", "canonical", "hreflang")
TITLES, DESCRIPTIONS = (0, 5, 45, 80), (0, 60, 140, 200, 119)


def head_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages that differ in title, description, images, robots, viewport, cards, canonical and alternates."""
    head = [either(f"k % 4 = {i}", f"<title>{'t' * n}</title>") for i, n in enumerate(TITLES) if n]
    head += [either(f"k % 5 = {i}", f'<meta name="description" content="{"d" * n}">') for i, n in enumerate(DESCRIPTIONS) if n]
    head += [either(f"k % 6 = {i}", f'<meta name="robots" content="{t}">') for i, t in ((1, "noindex"), (2, "nosnippet"), (3, "max-snippet:20"), (4, "none"), (5, "max-snippet:-1"))]
    head += [either(f"k % 3 = {i}", f'<meta name="viewport" content="{t}">') for i, t in ((1, "width=device-width, initial-scale=1"), (2, "width=600"))]
    head += [either(f"(k div {2**i}) % 2 = 1", f'<meta {a}="{t}" content="website">') for i, (a, t) in enumerate((("property", "og:title"), ("property", "og:description"), ("property", "og:url"), ("property", "og:type"), ("name", "twitter:card")))]
    head += [either(f"k % 3 = {i}", f'<meta property="og:image" content="https://x.ch/{t}">') for i, t in ((1, "photo.jpg"), (2, "logo.png"))]
    head += [either("k % 7 IN (3, 4)", f'<link rel="canonical" href="{BASE}$k">'), either("k % 7 = 5", f'<link rel="canonical" href="{BASE}$k/?a=1">'), either("k % 7 = 6", f'<link rel="canonical" href="{BASE}0$k">')]
    head += [either("k % 4 IN (1, 2)", f'<link rel="alternate" hreflang="de" href="{BASE}$k"><link rel="alternate" hreflang="en" href="{BASE}en$k">'), either("k % 4 = 2", f'<link rel="alternate" hreflang="x-default" href="{BASE}x$k">'), either("k % 4 = 3", f'<link rel="alternate" hreflang="english" href="{BASE}en$k">')]
    images = [either(f"k % 4 >= {i} AND k % 3 >= {i}", f'<img src="a{i}.png" alt="a">') for i in (1, 2, 3)] + [either(f"k % 4 >= {i} AND k % 3 < {i}", f'<img src="a{i}.png">') for i in (1, 2, 3)]
    return scored(pages_of(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), "c_custkey", head, images), SEO, ("images", "robotsMeta", "viewport", "twitterCard", "canonical", "hreflang"))


SHOP = ("productData", "publisher", "schema", "schema_completeness", "entities", "author")


def shop_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as product pages that differ in their structured data and in the links to who sells them."""
    fields = [("k % 2 = 1", ',"name":"x"'), ("k % 3 = 1", ',"brand":"b"'), ("k % 5 < 2", ',"image":"i.jpg"'), ("k % 4 = 2", ',"description":"d"'), ("k % 7 = 3", ',"aggregateRating":{"ratingValue":4}'), ("k % 6 = 0", ',"gtin13":"1"'), ("k % 6 IN (1, 2)", ',"sku":"s"')]
    offer = [("k % 3 <> 0", ',"price":"5","priceCurrency":"CHF"'), ("k % 5 = 3", ',"availability":"InStock"'), ("k % 9 = 4", ',"shippingDetails":{"a":1}')]
    data = [F.lit('<script type="application/ld+json">{"@type":"Product"'), *(either(*f) for f in fields), either("k % 8 <> 0", ',"offers":{"@type":"Offer"'), *(F.when(F.expr("k % 8 <> 0"), either(*f)).otherwise("") for f in offer), either("k % 8 <> 0", "}"), F.lit("}</script>")]
    links = [either("k % 2 = 0", '<a href="/impressum">Impressum</a>'), either("k % 3 = 0", '<a href="/kontakt">Kontakt</a>'), either("k % 5 = 0", '<a href="/wir">Über uns</a>')]
    return scored(pages_of(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey", data, links), SHOP, ("product", "identity", "completeness", "author", "links", "faqQuestions", "headings"))


ACCESS = ("llmsTxt", "robotsTxt", "crawlerView", "sitemap")
BLOCKED = ([], ["GPTBot"], ["OAI-SearchBot", "GPTBot"], ALL_BOTS, ["Googlebot"])
VIEWS = ("ok", "partial", "js-only", "auth-wall")


def access_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as pages with fetched inputs: llms.txt, robots.txt, what the server answers crawlers, the view without scripts, the sitemap."""
    pages = pages_of(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey", [F.lit("")], [F.lit("")])
    listed = lambda bots: F.array(*map(F.lit, bots)) if bots else F.array().cast("array<string>")
    nothing = F.create_map().cast("map<string,string>")
    when = F.expr
    blocked = F.when(when("k % 5 = 0"), listed(BLOCKED[0]))
    for i in (1, 2, 3):
        blocked = blocked.when(when(f"k % 5 = {i}"), listed(BLOCKED[i]))
    view = F.struct(F.get(F.array(*map(F.lit, VIEWS)), when("CAST(k % 5 AS INT)")).alias("status"), when("(k % 10) / 10.0D").alias("coverage"), F.lit(9).alias("renderedChars"), F.lit(9).alias("rawChars"), listed([]).alias("missingHeadings"))
    sitemap = F.struct(when("k % 4 <> 0").alias("exists"), when("k % 2 = 1").alias("declaredInRobots"), when("CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 > 1 END").alias("listed"), F.when(when("k % 7 < 4"), F.lit("2024-06-01")).alias("pageLastmod"), F.lit(9).cast("bigint").alias("entries"), F.lit(0.5).alias("lastmodShare"), when("k % 11 = 0").alias("lastmodUniform"))
    inputs = {
        "llmsTxt": F.struct(when("k % 2 = 0").alias("exists"), F.lit(5).alias("contentLength"), when("k % 3 = 0").alias("fullExists"), F.lit(5).alias("fullContentLength")),
        "robotsTxt": F.struct(F.lit(True).alias("exists"), when("k % 11 = 0").alias("unreachable"), F.lit(200).alias("httpStatus"), F.lit("/").alias("path"), blocked.otherwise(listed(BLOCKED[4])).alias("blockedBots"), listed(ALL_BOTS).alias("checkedBots"), F.when(when("k % 7 = 0"), F.create_map(F.lit("ai-input"), F.lit("no"))).otherwise(nothing).alias("signals")),
        "botAccess": F.struct(listed(ALL_BOTS).alias("checked"), F.when(when("k % 4 = 1"), listed(["ClaudeBot"])).when(when("k % 4 = 2"), listed(["PerplexityBot", "GPTBot"])).otherwise(listed([])).alias("blocked")),
        "crawlerView": F.when(when("k % 5 < 4"), view),
        "sitemap": F.when(when("k % 3 <> 0"), sitemap),
    }
    return scored(pages.withColumns(inputs).drop("k"), ACCESS, ("robotsMeta", "crawler", "paragraphs", "headings"))


READER = ("h1", "hierarchy", "scannable", "lists", "sections", "author", "date", "sources", "facts", "faq", "definitions", "semanticHtml")
FILLER = "und so geht der Text noch eine ganze Weile weiter damit er lang genug ist"


def reader_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as articles that differ in headings, paragraphs, lists, questions, definitions, facts, author, date and sources."""
    body = [F.lit("<article>"), either("k % 4 = 1", "<h1>Ein Titel</h1>"), either("k % 4 = 2", "<h1>Ein Titel</h1><h1>Noch einer</h1>"), either("k % 4 = 3", "<h1>abc</h1>")]
    body += [either("k % 5 = 1", '<p class="byline">Hans Muster</p>'), either("k % 3 = 0", '<time datetime="2024-05-01">im Mai</time>'), either("k % 3 = 1", '<time datetime="2020-05-01">damals</time>')]
    body += [either(f"k % 6 > {i}", f"<h2>Was ist Teil {i}?</h2><p>Absatz {i} von $k, {FILLER}.</p>") for i in range(5)]
    body += [either("k % 7 = 3", "<h4>Tief</h4>")]
    body += [either(f"k % 3 > {i}", f"<ul><li>eins {i}<li>zwei</ul>") for i in range(2)]
    body += [either(f"(k div 2) % 5 > {i}", f"<p>Im Jahr {i} stieg der Anteil um {i}7 % und {FILLER}.</p>") for i in range(4)]
    body += [either(f"(k div 3) % 4 > {i}", f"<p>Ding{i} ist ein Gerät, {FILLER}.</p>") for i in range(3)]
    body += [either(f"k % 7 > {i + 3}", f"<details><summary>Was ist Frage {i}?</summary><p>Die Antwort auf die Frage {i} lautet so, {FILLER}.</p></details>") for i in range(3)]
    body += [either(f"(k div 5) % 4 > {i}", f'<p>Mehr dazu: <a href="https://quelle{i}.org/a">Studie {i} der Hochschule</a></p>') for i in range(3)]
    body += [F.lit("</article>"), either("k % 2 = 0", "<footer>unten</footer>")]
    return scored(pages_of(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), "o_orderkey", [F.lit("")], body), READER, ("headings", "paragraphs", "lists", "tables", "links", "author", "dates", "schemaDates", "faqQuestions", "faqAnswersHidden", "questionAnswers", "semanticElements"))


# -- the SQL: points, found, met and value from the same keys --


def unpivoted(table: str, key: str, parts: str, rows: list[tuple[str, str, str, str, str, str | None]]) -> str:
    """rows: criterion, score (points if it begins with =), found, complete, value, and when it is there (null: always)."""
    made = ", ".join(
        f"CASE WHEN {there or 'true'} THEN {{'criterion': '{name}', 'points': {score[1:] if score[0] == '=' else f'({score}) * {config.WEIGHTS[name]}e0'}, 'weight': {config.WEIGHTS[name]}e0, 'found': ({found}), 'met': ({found}) AND ({complete}), 'value': {value}}} END" for name, score, found, complete, value, there in rows
    )
    return f"WITH k AS (SELECT {key} AS k FROM {table}), {parts}, c AS (SELECT k, unnest(list_filter([{made}], lambda x: x IS NOT NULL)) AS c FROM x) SELECT k AS page_id, c.criterion AS criterion, c.points AS points, c.weight AS weight, c.found AS found, c.met AS met, c.value AS value FROM c"


def percent(score: str) -> str:
    return f"floor(({score}) * 100.0e0 + 0.5e0)::BIGINT"


def shown(score: str) -> str:
    return f"{percent(score)}::VARCHAR || '%'"


def full(score: str) -> str:
    return f"{percent(score)} >= 100"


def lengths(n: str, low: int, high: int) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0.0e0 WHEN {n} BETWEEN {low} AND {high} THEN 1.0e0 WHEN {n} < {low} THEN greatest(0.3e0, {n} / {low}.0e0) ELSE greatest(0.3e0, 1.0e0 - ({n} - {high}) / {high}.0e0) END)"


def part(condition: str, share: float) -> str:
    return f"(CASE WHEN {condition} THEN {share}e0 ELSE 0.0e0 END)"


def added(*terms: str) -> str:
    """A sum from the left."""
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return out


def one_of(key: str, values: list) -> str:
    return "(CASE " + " ".join(f"WHEN {key} = {i} THEN {v}" for i, v in enumerate(values)) + " END)"


def made_sql() -> dict[str, str]:
    head = f"""x AS (SELECT k, {one_of('k % 4', TITLES)} AS t, {one_of('k % 5', DESCRIPTIONS)} AS d, k % 4 AS n, least(k % 4, k % 3) AS alts, k % 6 NOT IN (1, 4) AS indexed, {one_of('k % 6', ['1.0e0', '1.0e0', '0.25e0', '0.6e0', '1.0e0', '1.0e0'])} AS snippet,
  {one_of('k % 3', ['0.0e0', '1.0e0', '0.4e0'])} AS view, (k & 1) + ((k >> 1) & 1) + ((k >> 2) & 1) + ((k >> 3) & 1) + ((k >> 4) & 1) + (k % 3 = 1)::INTEGER AS cards, {one_of('k % 7', ['0.0e0'] * 3 + ['1.0e0'] * 3 + ['0.4e0'])} AS canon, {one_of('k % 4', ['0.0e0', '0.8e0', '1.0e0', '0.2e0'])} AS lang FROM k)"""
    title, described = lengths("t", 30, 60), lengths("d", 120, 160)
    alts = "(CASE WHEN n = 0 THEN 1.0e0 ELSE alts::DOUBLE / n::DOUBLE END)"
    # shares that add up to 0.8 the way they are added
    seo = [
        ("title_quality", title, f"{title} >= 0.7e0", full(title), "CASE WHEN t = 0 THEN 'notPresent' ELSE 'chars' END", None),
        ("meta_description", described, f"{described} >= 0.7e0", full(described), "CASE WHEN d = 0 THEN 'notPresent' ELSE 'chars' END", None),
        ("image_alts", alts, f"n = 0 OR {alts} >= 0.8e0", "n = 0 OR alts >= n", "CASE WHEN n = 0 THEN 'noImages' ELSE alts::VARCHAR || '/' || n::VARCHAR END", None),
        ("indexability", "CASE WHEN indexed THEN snippet ELSE 0.0e0 END", "indexed AND snippet = 1", "indexed AND snippet = 1", "CASE WHEN NOT indexed THEN 'noindex' WHEN snippet < 1 THEN 'snippetLimited' ELSE 'indexable' END", None),
        ("viewport", "view", "view = 1", "view = 1", "CASE WHEN view = 0 THEN 'notPresent' WHEN view < 1 THEN 'viewport_misconfigured' ELSE 'present' END", None),
        ("social_cards", "cards / 6.0e0", "cards / 6.0e0 >= 0.75e0", "cards >= 6", "CASE WHEN cards = 6 THEN '6/6' ELSE 'socialCardsMissing' END", None),
        ("canonical", "canon", "canon = 1", "canon = 1", "CASE WHEN canon = 0 THEN 'notPresent' WHEN canon = 1 THEN 'present' ELSE 'canonical_mismatch' END", None),
        ("hreflang", "lang", "lang >= 0.99e0", full("lang"), "CASE WHEN lang >= 0.99e0 THEN 'present' ELSE 'hreflang_incomplete' END", "k % 4 <> 0"),
    ]
    q = config.PRODUCT
    offer = lambda c: f"k % 8 <> 0 AND {c}"
    product = f"least(1.0e0, {added(part(offer('k % 3 <> 0'), q['price']), part(offer('k % 5 = 3'), q['availability']), '(CASE WHEN k % 6 = 0 THEN ' + str(q['identifier']) + 'e0 WHEN k % 6 IN (1, 2) THEN ' + str(q['identifier']) + 'e0 / 2 ELSE 0.0e0 END)', part('k % 3 = 1', q['brand']), part('k % 5 < 2', q['image']), part('k % 4 = 2', q['description']), part('k % 7 = 3', q['rating']), part(offer('k % 9 = 4'), q['shipping']))})"
    shop = f"y AS (SELECT *, {product} AS product, (k % 2 = 0)::INTEGER + (k % 3 = 0)::INTEGER + (k % 5 = 0)::INTEGER AS kinds, (k % 2 = 1)::INTEGER + (k % 8 <> 0)::INTEGER AS filled FROM k), x AS (SELECT *, least(1.0e0, {config.PUBLISHER['links']}e0 * least(1.0e0, kinds / 2.0e0)) AS who FROM y)"
    sold = [
        ("productData", "product", "product >= 0.99e0", full("product"), "CASE WHEN product >= 0.99e0 THEN 'present' ELSE 'productData_partial' END", None),
        ("publisher", "who", "false", "false", "CASE WHEN who > 0 THEN 'publisher_partial' ELSE 'notPresent' END", None),
        ("schema", "0.5e0", "true", "false", "'schemaTypes'", None),
        ("schema_completeness", "filled / 2.0e0", "filled = 2", "filled = 2", "CASE WHEN filled = 2 THEN 'complete' ELSE 'Product: ' || concat_ws(', ', CASE WHEN k % 2 <> 1 THEN 'name' END, CASE WHEN k % 8 = 0 THEN 'offers' END) END", None),
        ("entities", "0.0e0", "false", "false", "'0%'", None),
    ]
    weight = {b: config.PURPOSE_WEIGHTS[p] for b, p in config.BOTS}
    total = sum(weight.values())
    lost = [sum(weight[b] for b in bots) for bots in BLOCKED]
    walled = lambda bots: [sum(weight[b] for b in bots if b not in shut) for shut in BLOCKED]
    answers = [int(any(weight[b] > 1 for b in bots)) for bots in BLOCKED]
    some = lambda bots: [int(any(weight[b] > 1 for b in bots if b not in shut)) for shut in BLOCKED]
    access = f"""y AS (SELECT k, k % 11 = 0 AS down, {one_of('k % 5', lost)} AS lost, CASE WHEN k % 4 = 1 THEN {one_of('k % 5', walled(['ClaudeBot']))} WHEN k % 4 = 2 THEN {one_of('k % 5', walled(['PerplexityBot', 'GPTBot']))} ELSE 0 END AS walls,
  k % 11 = 0 OR {one_of('k % 5', answers)} = 1 AS shut, CASE WHEN k % 4 = 1 THEN {one_of('k % 5', some(['ClaudeBot']))} WHEN k % 4 = 2 THEN {one_of('k % 5', some(['PerplexityBot', 'GPTBot']))} ELSE 0 END = 1 AS wall, k % 7 = 0 AS out, {one_of('k % 5', [len(b) for b in BLOCKED])} AS n,
  k % 4 <> 0 AS there, k % 2 = 1 AS declared, CASE WHEN k % 5 = 0 THEN NULL ELSE k % 5 > 1 END AS listed, k % 7 < 4 AS dated, k % 11 = 0 AS uniform FROM k),
x AS (SELECT *, greatest(0.0e0, 1.0e0 - (lost + walls * 0.5e0) / {total}) * (CASE WHEN out THEN {config.SIGNAL_OPT_OUT_SHARE}e0 ELSE 1.0e0 END) AS crawl, CASE WHEN k % 5 = 0 THEN 1.0e0 ELSE (k % 10) / 10.0e0 END AS view,
  CASE WHEN NOT there THEN 0.0e0 ELSE (({config.SITEMAP['exists']}e0 + (CASE WHEN declared THEN {config.SITEMAP['declared']}e0 ELSE 0.0e0 END)) + (CASE WHEN coalesce(listed, true) THEN {config.SITEMAP['listed']}e0 ELSE 0.0e0 END))
    + (CASE WHEN listed AND dated AND uniform THEN {config.SITEMAP['lastmod']}e0 / 2 WHEN listed AND dated THEN {config.SITEMAP['lastmod']}e0 WHEN listed IS NULL THEN {config.SITEMAP['lastmod']}e0 ELSE 0.0e0 END) END AS map FROM y)"""
    fetched = [
        ("llmsTxt", "CASE WHEN k % 2 = 0 THEN 1.0e0 WHEN k % 3 = 0 THEN 0.5e0 ELSE 0.0e0 END", "k % 2 = 0 OR k % 3 = 0", "k % 2 = 0", "CASE WHEN k % 6 = 0 THEN 'llms_both' WHEN k % 2 = 0 THEN 'llms_indexOnly' WHEN k % 3 = 0 THEN 'llms_fullOnly' ELSE 'notFound' END", None),
        ("robotsTxt", "crawl", "NOT shut AND NOT wall AND NOT out", "n = 0", f"CASE WHEN down OR n = {len(ALL_BOTS)} THEN 'allBotsBlocked' WHEN n > 0 THEN 'someBotsBlocked' WHEN wall THEN 'botsBlockedByServer' WHEN out THEN 'botsOptOut' ELSE 'allBotsAllowed' END", None),
        ("crawlerView", "view", "k % 5 = 0", full("view"), "CASE WHEN k % 5 = 0 THEN 'crawlerOk' WHEN k % 5 = 1 THEN 'crawlerPartial' ELSE 'crawlerJsOnly' END", "k % 5 < 3"),
        ("sitemap", "map", "map >= 0.999e0", full("map"), "CASE WHEN NOT there THEN 'noneFound' WHEN map >= 0.999e0 THEN 'sitemapOk' ELSE 'sitemapPartial' END", "k % 3 <> 0"),
    ]
    h = config.HIERARCHY
    text = len(FILLER) + 1
    reader = f"""a AS (SELECT k, CASE k % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS n1, k % 4 = 1 AS good, k % 6 AS n2, k % 7 = 3 AS deep, k % 3 AS nl, (k // 2) % 5 AS nf, (k // 3) % 4 AS nd, greatest(0, k % 7 - 3) AS nq, (k // 5) % 4 AS ns, k % 3 AS day FROM k),
b AS (SELECT *, n2 + nf + nd + nq AS n, n2 + nf + nd + nq + ns AS n_ps, n2 + deep::INTEGER AS lower_heads, n1 + n2 + deep::INTEGER AS heads, CASE WHEN deep AND n1 + n2 > 0 THEN {h['skip']}e0 ELSE 0.0e0 END AS skip,
  (n2 * ({len('Absatz 0 von , ') + text} + length(k::VARCHAR)) + nf * {len('Im Jahr 0 stieg der Anteil um 07 % und ') + text} + nd * {len('Ding0 ist ein Gerät, ') + text} + nq * {len('Die Antwort auf die Frage 0 lautet so, ') + text})::DOUBLE AS chars FROM a),
c0 AS (SELECT *, ((((CASE WHEN n1 = 0 THEN {h['no_h1']}e0 ELSE 0.0e0 END) + (CASE WHEN n1 > 1 THEN {h['several_h1']}e0 ELSE 0.0e0 END)) + skip) + (CASE WHEN n2 < 2 THEN {h['few_subheadings']}e0 ELSE 0.0e0 END)) AS penalty, n2::DOUBLE / nullif(n + nl, 0)::DOUBLE AS ratio FROM b),
x AS (SELECT *, CASE WHEN heads = 0 THEN 0.0e0 ELSE greatest(0.0e0, least(1.0e0, CASE WHEN n1 = 0 THEN least({h['cap']}e0, 1.0e0 - penalty) ELSE (1.0e0 - penalty) + (CASE WHEN penalty = 0 AND n2 >= 4 THEN {h['bonus']}e0 ELSE 0.0e0 END) END)) END AS outline,
  least(1.0e0, (((CASE WHEN n >= 3 THEN 0.3e0 WHEN n >= 1 THEN 0.075e0 ELSE 0.0e0 END) + (CASE WHEN n = 0 THEN 0.0e0 WHEN chars / n < 300 THEN 0.25e0 ELSE 0.15e0 END)) + (CASE WHEN nl >= 2 THEN 0.25e0 WHEN nl >= 1 THEN 0.15e0 ELSE 0.0e0 END))
    + (CASE WHEN n + nl = 0 THEN 0.0e0 WHEN ratio BETWEEN 0.2e0 AND 1.0e0 THEN 0.2e0 WHEN ratio BETWEEN 0.1e0 AND 2.0e0 THEN 0.1e0 ELSE 0.0e0 END)) AS scan,
  least(1.0e0, lower_heads / 3.0e0) * (CASE WHEN n_ps >= 3 THEN 1.0e0 ELSE 0.5e0 END) AS sections, least(1.0e0, nf / 4.0e0) AS facts, CASE WHEN n2 >= 5 THEN 1.0e0 WHEN n2 >= 3 THEN 0.6e0 WHEN n2 >= 1 THEN 0.3e0 ELSE 0.0e0 END AS faq,
  least(1.0e0, (nd + n2) / 3.0e0) * 0.7e0 + 0.0e0 AS defs, CASE WHEN k % 2 = 0 THEN {config.SEMANTIC['article']}e0 + {config.SEMANTIC['footer']}e0 ELSE {config.SEMANTIC['article']}e0 END AS marks FROM c0)"""
    read = [
        ("h1", "CASE WHEN good THEN 1.0e0 WHEN n1 > 0 THEN 0.5e0 ELSE 0.0e0 END", "good", "good", "CASE WHEN n1 = 0 THEN 'notPresent' WHEN good THEN 'present' ELSE 'h1Optimal' END", None),
        ("hierarchy", "outline", "outline > 0.6e0", full("outline"), shown("outline"), None),
        ("scannable", "scan", "scan > 0.5e0", full("scan"), shown("scan"), None),
        ("lists", "least(1.0e0, nl / 3.0e0)", "nl >= 1", "nl >= 3", "'lists'", None),
        ("sections", "sections", "lower_heads >= 3 AND n_ps >= 3", "lower_heads >= 3", "'subheadings'", None),
        ("author", "CASE WHEN k % 5 = 1 THEN 1.0e0 ELSE 0.0e0 END", "k % 5 = 1", "k % 5 = 1", "CASE WHEN k % 5 = 1 THEN 'Hans Muster' ELSE 'notRecognizable' END", None),
        ("date", "CASE day WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.5e0 ELSE 0.0e0 END", "day < 2", "day = 0", "CASE day WHEN 0 THEN '2024-05-01' WHEN 1 THEN 'olderThanYear' ELSE 'noDateFound' END", None),
        ("sources", f"=CASE WHEN ns >= 2 THEN {config.WEIGHTS['sources']}e0 WHEN ns > 0 THEN 0.5e0 ELSE 0.0e0 END", "ns >= 2", "ns >= 2", "'sourceLinks'", None),
        ("facts", "facts", "facts > 0.3e0", full("facts"), shown("facts"), None),
        ("faq", "faq", "faq > 0", full("faq"), shown("faq"), None),
        ("definitions", "defs", "defs > 0.3e0", full("defs"), shown("defs"), None),
        ("semanticHtml", "marks", "marks > 0.5e0", full("marks"), shown("marks"), None),
    ]
    return {
        "reader_pages": unpivoted("orders", "o_orderkey", reader, read),
        "head_pages": unpivoted("customer", "c_custkey", head, seo),
        "shop_pages": unpivoted("part", "p_partkey", shop, sold) + " UNION ALL SELECT p_partkey, 'author', 0.0e0, 0.0e0, true, true, 'notApplicable' FROM part",
        "access_pages": unpivoted("supplier", "s_suppkey", access, fetched),
    }


QUERIES = {f.__name__: f for f in (head_pages, shop_pages, access_pages, reader_pages)}
