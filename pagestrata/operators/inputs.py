"""Optional inputs of pages, from tables of fetched files: robots, llms.txt, crawler probes, crawler view, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import robots, urls
from ..functions.numbers import size
from ..functions.steps import small
from .scoring import with_inputs

MAX_DEPTH = 3
SIDE_FILES = {"robots": "/robots.txt", "llms": "/llms.txt", "full": "/llms-full.txt"}
#: Origins up to which what is known of them is broadcast.
FEW_ORIGINS = 10_000
UNIFORM_ENTRIES, UNIFORM_SHARE = 10, 0.9
OK_COVERAGE, JS_COVERAGE, IGNORED_CHARS, JS_CHARS = 0.8, 0.25, 500, 200
AUTH_PATH = r"(?i)(^|/)(login|signin|sign-in|anmelden|auth|authorize|account/login|session/new)(/|$|\?)"


def side_files(files: DataFrame) -> DataFrame:
    """One row an origin: status and body of robots.txt, llms.txt and llms-full.txt, each from one row, that with the longest body.

    One aggregation over all files; bodies of other files aren't exchanged.
    """

    def chosen(path: str) -> Column:
        own = F.struct(F.length(F.coalesce("body", F.lit(""))).alias("n"), F.col("status"), F.coalesce("body", F.lit("")).alias("body"))
        return F.max(F.when(F.col("path") == path, own))

    known = files.groupBy("origin").agg(*(chosen(path).alias(name) for name, path in SIDE_FILES.items()))
    return known.select("origin", *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in SIDE_FILES for c in ("status", "body")))


def with_side_files(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Adds robotsTxt and llmsTxt to pages. files: origin, path, status, body; each file is parsed once an origin.

    Pages of an origin without any row keep their inputs null. Parsed files are broadcast if they are few, so that pages of a
    large site stay where they are.
    """
    status = F.coalesce("robots_status", F.lit(404))
    body = F.coalesce("robots_body", F.lit(""))
    parsed = side_files(files).select(
        "origin", status.alias("_status"), body.alias("_body"), robots.groups(body).alias("_groups"),
        robots.llms_txt(F.coalesce("llms_status", F.lit(404)), F.coalesce("llms_body", F.lit("")), F.coalesce("full_status", F.lit(404)), F.coalesce("full_body", F.lit(""))).alias("llmsTxt"),
    )
    keyed = pages.drop("robotsTxt", "llmsTxt").withColumn("_origin", urls.origin(F.col("url")))
    met = keyed.join(small(parsed, FEW_ORIGINS), F.col("_origin") == F.col("origin"), "left")
    verdict = F.when(F.col("_status").isNotNull(), robots.robots_txt(F.col("_status"), F.col("_body"), urls.robots_path(F.col("url")), F.col("_groups")))
    return met.withColumn("robotsTxt", verdict).drop("_origin", "origin", "_status", "_body", "_groups")


def with_header(pages: DataFrame, column: str = "x_robots_tag") -> DataFrame:
    """Merges the X-Robots-Tag header into robotsMeta."""
    return pages.withColumn("robotsMeta", robots.with_header(F.col("robotsMeta"), F.col(column)))


def with_probes(pages: DataFrame, probes: DataFrame) -> DataFrame:
    """Adds botAccess from probes(origin, bot, status, cf_mitigated)."""
    walled = robots.is_blocked_response(F.col("status"), F.col("cf_mitigated"))
    seen = probes.groupBy("origin").agg(F.array_sort(F.collect_set("bot")).alias("checked"), F.array_sort(F.collect_set(F.when(walled, F.col("bot")))).alias("blocked"))
    seen = seen.select("origin", F.struct("checked", "blocked").alias("botAccess"))
    return pages.drop("botAccess").withColumn("origin", urls.origin(F.col("url"))).join(small(seen, FEW_ORIGINS), "origin", "left").drop("origin")


def crawler_view(rendered: Column, raw: Column, moved: Column | None = None) -> Column:
    """What is left of a rendered page without scripts. rendered and raw: the crawler field of their records.

    moved: the path that the fetch was redirected to, if any.
    """
    coverage = F.when(rendered["chars"] == 0, 1.0).otherwise(F.least(F.lit(1.0), raw["chars"] / F.nullif(rendered["chars"], F.lit(0))))
    delta = rendered["chars"] - raw["chars"]
    wall = (raw["hasPassword"] & ~rendered["hasPassword"]) | (F.coalesce(moved.rlike(AUTH_PATH), F.lit(False)) if moved is not None else F.lit(False))
    status = F.when(wall, "auth-wall").when((coverage >= OK_COVERAGE) | (delta < IGNORED_CHARS), "ok").when((coverage < JS_COVERAGE) | (raw["chars"] < JS_CHARS), "js-only").otherwise("partial")
    low = F.transform(raw["headings"], F.lower)
    missing = F.slice(F.filter(rendered["headings"], lambda h: ~F.array_contains(low, F.lower(h))), 1, 5)
    return F.struct(status.alias("status"), coverage.alias("coverage"), rendered["chars"].alias("renderedChars"), raw["chars"].alias("rawChars"), missing.alias("missingHeadings"))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """Entries of sitemap files(url, body): sitemap, kind (page or sitemap), loc, lastmod, published.

    An entry of a page list that names an XML file is another sitemap.
    """
    plain = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    root = F.regexp_extract(plain, r"(?s)^\s*(?:<\?.*?\?>\s*|<!DOCTYPE[^>]*>\s*)*<(?:[\w-]+:)?(urlset|sitemapindex)[\s>]", 1)
    blocks = F.regexp_extract_all(plain, F.lit(r"(?s)<(?:[\w-]+:)?(?:url|sitemap)(?:\s[^>]*)?>.*?</(?:[\w-]+:)?(?:url|sitemap)\s*>"), F.lit(0))

    def field(block: Column, name: str) -> Column:
        raw = F.regexp_extract(block, rf"(?s)<(?:[\w-]+:)?{name}(?:\s[^>]*)?>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:[\w-]+:)?{name}\s*>", 1)
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            raw = F.replace(raw, F.lit(a), F.lit(b))
        return F.nullif(F.trim(raw), F.lit(""))

    rows = files.where((root != "") & F.col("body").isNotNull()).select(F.col("url").alias("sitemap"), F.posexplode(blocks).alias("position", "block"))
    rows = rows.select("sitemap", "position", F.regexp_extract("block", r"^<(?:[\w-]+:)?(\w+)", 1).alias("tag"), field(F.col("block"), "loc").alias("loc"), field(F.col("block"), "lastmod").alias("lastmod"), field(F.col("block"), "publication_date").alias("published"))
    nested = (F.col("tag") == "sitemap") | urls.path(F.col("loc")).rlike(r"(?i)\.xml(\.gz)?$")
    return rows.where("loc IS NOT NULL").select("sitemap", "position", F.when(nested, "sitemap").otherwise("page").alias("kind"), "loc", "lastmod", "published")


def reached_sitemaps(origins: DataFrame, entries: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """Sitemaps of each origin by nesting: origin, sitemap, depth. origins: origin, robots_body.

    Starts at the Sitemap lines of robots.txt for the same host, else at /sitemap.xml.
    """
    host = urls.bare_host(F.col("origin"))
    listed = F.filter(robots.sitemaps(F.coalesce("robots_body", F.lit(""))), lambda u: urls.bare_host(u) == host)
    start = F.when(size(listed) > 0, listed).otherwise(F.array(F.concat(F.col("origin"), F.lit("/sitemap.xml"))))
    level = origins.select("origin", (size(listed) > 0).alias("declared"), F.explode(F.array_distinct(start)).alias("sitemap")).withColumn("depth", F.lit(0))
    children = entries.where("kind = 'sitemap'").select(F.col("sitemap").alias("parent"), F.col("loc").alias("child"))
    found = level
    for d in range(1, depth + 1):
        level = level.join(children, F.col("sitemap") == F.col("parent")).where(urls.bare_host(F.col("child")) == urls.bare_host(F.col("origin"))).select("origin", "declared", F.col("child").alias("sitemap"), F.lit(d).alias("depth")).distinct()
        found = found.unionByName(level)
    return found.groupBy("origin", "declared", "sitemap").agg(F.min("depth").alias("depth"))


def sitemap_stats(origins: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per origin: exists, declared, entries, share with lastmod, uniform; the pages listed with their lastmod).

    entries: as of sitemap_entries, best from a written table, since they are read for every level and figure.
    """
    reached = reached_sitemaps(origins, entries)
    exists = reached.join(entries.select("sitemap").distinct(), "sitemap", "left_semi").select("origin").distinct().withColumn("exists", F.lit(True))
    pages = reached.join(entries.where("kind = 'page'"), "sitemap")
    days = pages.where("lastmod IS NOT NULL").groupBy("origin", F.substring("lastmod", 1, 10).alias("day")).agg(F.count("*").alias("n"))
    top = days.groupBy("origin").agg(F.sum("n").alias("dated"), F.max("n").alias("top"))
    counts = pages.groupBy("origin").agg(F.count("*").alias("entries"))
    stats = reached.select("origin", "declared").distinct().join(exists, "origin", "left").join(counts, "origin", "left").join(top, "origin", "left")
    dated = F.coalesce("dated", F.lit(0))
    uniform = (dated >= UNIFORM_ENTRIES) & (F.coalesce("top", F.lit(0)) / F.nullif(dated, F.lit(0)) >= UNIFORM_SHARE)
    stats = stats.select("origin", F.coalesce("exists", F.lit(False)).alias("exists"), "declared", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce(dated / F.nullif(F.col("entries"), F.lit(0)), F.lit(0.0)).alias("lastmodShare"), F.coalesce(uniform, F.lit(False)).alias("lastmodUniform"))
    listed = pages.groupBy("origin", urls.page_key(F.col("loc")).alias("page_key")).agg(F.max("lastmod").alias("lastmod"), F.max("published").alias("published"))
    return stats, listed


def with_sitemap(pages: DataFrame, origins: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds sitemap to pages. origins: origin, robots_body; entries: as of sitemap_entries."""
    stats, listed = sitemap_stats(origins, entries)
    keyed = pages.drop("sitemap").withColumns({"_origin": urls.origin(F.col("url")), "_key": urls.page_key(F.col("url"))})
    met = keyed.join(small(stats, FEW_ORIGINS), F.col("_origin") == stats["origin"], "left").drop("origin")
    met = met.join(listed.select(F.col("origin").alias("_o"), F.col("page_key").alias("_k"), F.coalesce("lastmod", "published").alias("_lastmod"), F.lit(True).alias("_listed")), (F.col("_origin") == F.col("_o")) & (F.col("_key") == F.col("_k")), "left")
    made = F.struct("exists", F.col("declared").alias("declaredInRobots"), F.coalesce("_listed", F.lit(False)).alias("listed"), F.col("_lastmod").alias("pageLastmod"), "entries", "lastmodShare", "lastmodUniform")
    return met.withColumn("sitemap", F.when(F.col("exists").isNotNull(), made)).drop("_origin", "_key", "exists", "declared", "entries", "lastmodShare", "lastmodUniform", "_o", "_k", "_lastmod", "_listed")


def discovered_pages(origins: DataFrame, entries: DataFrame, current: str | None = None, most: int = 30) -> DataFrame:
    """Pages to analyze from sitemaps: each once by origin and path, of the same host, in order, at most ``most`` an origin."""
    from pyspark.sql import Window as W

    found = reached_sitemaps(origins, entries).join(entries.where("kind = 'page'"), "sitemap")
    same = found.where(urls.hostname(F.col("loc")) == urls.hostname(F.col("origin"))).withColumn("key", urls.history_key(F.col("loc")))
    if current is not None:
        same = same.where(F.col("key") != urls.history_key(F.lit(current)))
    once = same.groupBy("origin", "key").agg(F.min(F.struct("depth", "sitemap", "position", "loc")).alias("x"))
    ranked = once.withColumn("n", F.row_number().over(W.partitionBy("origin").orderBy("x")))
    return ranked.where(F.col("n") <= most).select("origin", F.col("x.loc").alias("url"), "n")


def search_verification(pages: DataFrame, files: DataFrame) -> DataFrame:
    """How a site proves itself to a search console: meta, file or null. pages: url, bingMeta."""
    auth = files.where((F.col("path") == "/BingSiteAuth.xml") & F.col("status").between(200, 299) & F.col("body").rlike(r"(?i)<users>\s*<user>")).select("origin").distinct().withColumn("_file", F.lit(True))
    met = pages.withColumn("origin", urls.origin(F.col("url"))).join(auth, "origin", "left")
    return met.select("url", F.when(F.col("bingMeta"), "meta").when(F.col("_file"), "file").alias("verification"))


def complete(pages: DataFrame) -> DataFrame:
    """All optional inputs as columns, null where they are missing, and the names of those that are there."""
    full = with_inputs(pages)
    names = ("llmsTxt", "robotsTxt", "botAccess", "crawlerView", "sitemap")
    return full.withColumn("inputs", F.filter(F.array(*(F.when(F.col(n).isNotNull(), F.lit(n)) for n in names)), lambda n: n.isNotNull()))
