"""The engine's registered queries: each runs operators over whole tables; SQL that checks them is in oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import readability as R
from ..functions import robots as B
from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import round1, size
from ..functions.steps import once
from ..html.udf import page_data
from ..operators import criteria as C
from ..operators import history as H
from ..operators import inputs as I
from ..operators import reports as P
from ..operators import runs as D
from ..operators import scoring as S
from ..operators import targets as T
from ..sources.pages import first_of_each
from . import made
from .oracles import ORACLE_SQL  # noqa: F401

AS_OF = "2024-07-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def records(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    """Page records, or the named parts of them."""
    return page_data(table(spark, sf_dir, "pages").select("page_id", "url", "html"), last_year=int(AS_OF[:4]) + 1, fields=fields or None)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.analyze(records(spark, sf_dir), as_of(), evidence=False)


def blocks() -> Column:
    """Lines of a document as blocks of text."""
    return F.split(F.coalesce("text", F.lit("")), "\n")


def mean_value() -> Column:
    """The mean of the values in hundredths, which no order of addition changes."""
    return round1(F.sum(F.floor(F.col("value") * 100.0 + 0.5)) / F.count("value") / F.lit(100.0))


# -- pages --


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their scores."""
    return results(spark, sf_dir).select("page_id", "url", "pageType", "totalScore", "rating", *config.CATEGORIES)


def worst_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred pages that need work most; a top-k, so no page is sorted that doesn't come near it."""
    return S.worst_first(flagship(spark, sf_dir)).limit(100)


def page_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.criteria_table(results(spark, sf_dir), "page_id").select("page_id", "category", "criterion", "points", "weight", "found", "met", "value")


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.findings_table(results(spark, sf_dir), "page_id")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "lang", "headings", "paragraphs", "links", "crawler").select("page_id", "lang", size(F.col("headings")).alias("n_headings"), size(F.col("paragraphs")).alias("n_paragraphs"), size(F.col("links")).alias("n_links"), F.col("crawler.chars").alias("n_chars"))


def page_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.highlight_targets(results(spark, sf_dir), "page_id")


def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.status_counts(results(spark, sf_dir), "page_id")


def title_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = records(spark, sf_dir, "meta").select("page_id", F.char_length(X.squeezed(F.col("meta.title"))).cast("long").alias("title_length"))
    return found.withColumn("score_percent", C.percent(C.length_score(F.col("title_length"), 30, 60)).cast("long"))


def h1_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    h1s = F.filter("headings", lambda h: h["level"] == 1)
    return records(spark, sf_dir, "headings").select("page_id", F.size(h1s).cast("long").alias("n_h1"), F.char_length(F.get(h1s, 0)["text"]).cast("long").alias("h1_length"))


def landmark_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = [F.col(f"semanticElements.has{n.capitalize()}") for n in config.SEMANTIC]
    score = sum((F.when(m, F.lit(s)).otherwise(0.0) for m, s in zip(marks, config.SEMANTIC.values())), F.lit(0.0))
    return records(spark, sf_dir, "semanticElements").select("page_id", C.percent(F.least(F.lit(1.0), score)).cast("long").alias("landmark_percent"))


def link_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "links").select("page_id", size(F.col("links")).cast("long").alias("n_links"), size(F.array_distinct(F.transform("links", lambda x: U.link_key(x["href"])))).cast("long").alias("n_targets"), size(F.filter("links", lambda x: x["isExternal"])).cast("long").alias("n_external"))


def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.history_key(u).alias("history_key"), U.snapshot_path(u).alias("path"), U.page_key(u).alias("page_key"), U.canonical_key(u).alias("canonical_key"), U.link_key(u).alias("link_key"), U.source_key(u).alias("source_key"), U.registrable_domain(u).alias("domain"), U.robots_path(u).alias("robots_path"))


def pages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page a history key: the first."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("position"), U.history_key(F.col("url")).alias("url"))
    return first_of_each(pages).select(F.col("position").alias("page_id"), F.col("url").alias("history_key"))


def site_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, languages and longest URL by domain."""
    return table(spark, sf_dir, "pages").groupBy(U.registrable_domain(F.col("url")).alias("domain")).agg(F.count("*").alias("pages"), F.count_distinct(F.regexp_extract(U.path(F.col("url")), "^/([a-z]{2})/", 1)).alias("languages"), F.max(F.char_length("url")).cast("long").alias("longest_url"))


ROBOTS = "User-agent: *\nDisallow: /fr/\nAllow: /fr/1\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\nAllow: /en/\nContent-Signal: ai-train=no, search=yes\n# end"


def robots_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawlers that one robots.txt keeps from each page."""
    pages = table(spark, sf_dir, "pages").select("page_id", U.robots_path(F.col("url")).alias("path"))
    blocked = B.blocked_bots(B.groups(F.lit(ROBOTS)), F.col("path"), F.array(F.lit("GPTBot"), F.lit("Googlebot")))
    return pages.select("page_id", F.array_join(F.array_sort(blocked), ",").alias("blocked"))


# -- text of documents --


def readability_lix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = once(table(spark, sf_dir, "documents").select("doc_id", R.joined(blocks()).alias("t")), {"words": R.word_count(F.col("t")), "sentences": R.sentence_count(F.col("t")), "long_words": R.long_word_count(F.col("t"))})
    counts = [F.col(n).cast("long").alias(n) for n in ("words", "sentences", "long_words")]
    return docs.select("doc_id", *counts, round1(R.lix(F.col("words"), F.col("long_words"), F.col("sentences"))).alias("lix"))


def readability_flesch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = once(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", R.joined(blocks()).alias("t")), {"words": R.word_count(F.col("t")), "sentences": R.sentence_count(F.col("t")), "syllables": R.syllable_count(F.col("t"))})
    return docs.select("doc_id", F.col("syllables").cast("long").alias("syllables"), round1(R.flesch(F.col("words"), F.col("syllables"), F.col("sentences"))).alias("flesch"))


def readability_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.with_readability(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), blocks(), F.col("lang"), "r")
    return docs.where("r IS NOT NULL").groupBy(F.col("r.formula").alias("formula"), R.band(F.col("r.raw"), F.col("r.formula")).alias("band")).agg(F.count("*").alias("documents"))


def content_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.guessed_language(F.col("text")).alias("guess"))


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", size(F.filter(blocks(), X.is_fact)).cast("long").alias("fact_lines"))


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.citation_count(F.col("text")).cast("long").alias("citations"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", size(F.filter(blocks(), lambda p: X.definition(p).isNotNull())).cast("long").alias("definition_lines"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = X.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(cut).cast("long").alias("sentences"), size(F.filter(cut, lambda s: s.endswith("?"))).cast("long").alias("questions"))


def documents_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document a text: that with the smallest id."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("text_sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# -- histories and runs: events as entries, users as pages --


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean value of a user and day as the score of a page."""
    days = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url_norm"), F.to_date("ts").alias("ts")).agg(mean_value().alias("total_score"))
    return days.where("total_score IS NOT NULL")


def trend_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.trend(history(spark, sf_dir)).select("url_norm", "ts", "total_score", "previous_score", "delta", "direction")


def history_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.newest(history(spark, sf_dir), kept=5).select("url_norm", "ts", "total_score", F.col("position").cast("long").alias("position"))


def history_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.overview(history(spark, sf_dir))


def daily_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("url_norm"), "ts").agg(F.min("event_id").alias("event_id"))
    return H.daily_once(reports).select("url_norm", "day", "event_id")


def asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's entry of a user with the latest earlier day on which the user had one."""
    pages = history(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("url_norm").cast("string").alias("path"), "total_score", F.lit("ok").alias("status"), F.create_map().cast("map<string,boolean>").alias("checks"))
    runs = pages.select("run_id").distinct().withColumn("created_at", F.to_timestamp("run_id"))
    return H.previous_page_run(pages, runs).select("run_id", "path", "total_score", "previous_run", "previous_score", "delta", "direction")


def run(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    """One half of the time that events cover as a run; every event is in one of both.

    What a user did with a key is a page, the mean value its score, and its event types are its findings.
    """
    events = table(spark, sf_dir, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(at).alias("first"), F.max(at).alias("last")).head()
    middle = ((ends["first"] or 0) + (ends["last"] or 0)) // 2
    rows = events.where((at >= middle) == F.lit(late))
    path = F.concat(F.lit("/"), F.col("user_id").cast("string"), F.lit("/"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("-")))
    kinds = F.array_sort(F.collect_set("event_type"))
    finding = lambda k: F.struct(k.alias("key"), F.concat(F.lit("finding:"), k).alias("fingerprint"), F.lit("dev").alias("owner"), F.lit("quick").alias("effort"), F.char_length(k).alias("priority"), k.alias("text"))
    pages = rows.groupBy(path.alias("path")).agg(mean_value().alias("total_score"), kinds.alias("kinds"))
    checks = F.map_from_entries(F.transform("kinds", lambda k: F.struct(k, F.col("total_score") > F.char_length(k) * 5)))
    return pages.select("path", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), "total_score", checks.alias("checks"), F.transform("kinds", finding).alias("findings"), F.lit(0).cast("bigint").alias("position"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.matched(run(spark, sf_dir, False), run(spark, sf_dir, True))


def run_page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = [F.array_join(F.array_sort(n), ",").alias(n) for n in ("fixed", "regressed", "findings_fixed", "findings_new")]
    return D.page_changes(pairs(spark, sf_dir)).select("path", "before", "after", "delta", *lists)


def run_finding_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.finding_changes(pairs(spark, sf_dir)).select("key", "priority", "before", "after", "fixed", "new")


def run_pages_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pages_added(pairs(spark, sf_dir))


def run_pages_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.pages_removed(pairs(spark, sf_dir))


def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.diff_totals(pairs(spark, sf_dir)).select("pages", "fixed", "new", "pages_up", "pages_down", "regression")


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.run_totals(run(spark, sf_dir, True).withColumn("run_id", F.lit("b")), "run_id")


def ticket_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = D.plan_tickets(run(spark, sf_dir, True), "https://example.org", run(spark, sf_dir, False), min_priority=5)
    return plan.select("key", "state", "priority", "level", F.col("page_count").cast("long").alias("page_count"), "before", "after", "title", "marker")


def sitemap_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as sites, events as the entries of their sitemaps; clicks all say the same day, and every fourth entry says none."""
    events = table(spark, sf_dir, "events")
    origin = F.concat(F.lit("https://"), F.col("event_type"), F.lit(".example"))
    day = F.when(F.col("event_id") % 4 != 0, F.when(F.col("event_type") == "click", "2024-01-01").otherwise(F.date_format("ts", "yyyy-MM-dd")))
    entries = events.select(F.concat(origin, F.lit("/sitemap.xml")).alias("sitemap"), F.lit(0).alias("position"), F.lit("page").alias("kind"), F.concat(origin, F.lit("/"), F.col("event_id").cast("string")).alias("loc"), day.alias("lastmod"), F.lit(None).cast("string").alias("published"))
    origins = events.select(origin.alias("origin"), F.lit(None).cast("string").alias("robots_body")).distinct()
    stats, listed = I.sitemap_stats(origins, entries)
    return stats.join(listed.groupBy("origin").agg(F.count("*").alias("pages"), F.max("lastmod").alias("newest")), "origin")


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have to be analyzed again: those whose text isn't that of another document of their language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("url_norm"), F.sha2("text", 256).alias("content_hash"))
    first = docs.groupBy("url_norm", "content_hash").agg(F.count("*").alias("n")).where("n > 1").withColumn("version", F.lit(config.TOOL_VERSION))
    return H.stale(docs, first, config.TOOL_VERSION).select("doc_id")


def rating_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by the rating of a score made from their balance."""
    score = round1(F.col("c_acctbal") / F.lit(333.0))
    return table(spark, sf_dir, "customer").groupBy(S.rating(score).alias("rating")).agg(F.count("*").alias("customers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        flagship, worst_pages, page_criteria, page_findings, page_targets, page_status, page_records, title_lengths, h1_check, landmark_score, link_counts, url_keys, pages_once, site_overview, robots_verdict,
        readability_lix, readability_flesch, readability_bands, content_language, fact_documents, citations, definitions, sentences, documents_once,
        trend_lag, history_newest, history_overview, daily_reports, asof_previous, run_page_changes, run_finding_changes, run_pages_added, run_pages_removed, run_totals, run_summaries,
        ticket_plan, sitemap_uniform, cache_misses, rating_counts,
    )
}
QUERIES |= made.QUERIES
