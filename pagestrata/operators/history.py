"""Scores over time: trends, overviews, and the run that a run is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import checks, urls
from ..functions.numbers import round1

KEPT = 50


def direction(delta: Column) -> Column:
    return F.when(delta > 0, "up").when(delta < 0, "down").otherwise("flat")


def trend(history: DataFrame, key: str = "url_norm", at: str = "ts", score: str = "total_score") -> DataFrame:
    """Each entry against the one before it: delta, direction, and criteria fixed and regressed."""
    order = W.partitionBy(key).orderBy(at)
    rows = history.withColumns({"previous_score": F.lag(score).over(order), "previous_ts": F.lag(at).over(order)})
    delta = round1(F.col(score) - F.col("previous_score"))
    rows = rows.withColumns({"delta": F.abs(delta), "direction": F.when(delta.isNotNull(), direction(delta))})
    if "checks" not in history.columns:
        return rows
    rows = rows.withColumn("previous_checks", F.lag("checks").over(order))
    return rows.withColumns({"fixed": checks.fixed(F.col("previous_checks"), F.col("checks")), "regressed": checks.regressed(F.col("previous_checks"), F.col("checks"))}).drop("previous_checks")


def newest(history: DataFrame, key: str = "url_norm", at: str = "ts", kept: int = KEPT) -> DataFrame:
    """The newest entries of each page."""
    return history.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy(F.desc(at)))).where(F.col("position") <= kept)


def overview(history: DataFrame, host: str | None = None, key: str = "url_norm", at: str = "ts", score: str = "total_score") -> DataFrame:
    """The latest score of each page of a host (of that very name), the change before it and the number of entries."""
    rows = history if host is None else history.where(urls.hostname(F.col(key)) == host)
    order = W.partitionBy(key).orderBy(F.desc(at))
    ranked = rows.select(key, F.col(at).alias("last_ts"), F.col(score).alias("last_score"), F.row_number().over(order).alias("position"), F.lead(score).over(order).alias("previous"), F.count("*").over(W.partitionBy(key)).alias("analysis_count"))
    return ranked.where("position = 1").select(key, "last_ts", "last_score", round1(F.col("last_score") - F.col("previous")).alias("delta"), "analysis_count")


def previous_page_run(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """Each analyzed page with the latest earlier run that analyzed it."""
    at = pages.where("status = 'ok'").join(runs.select("run_id", "created_at"), "run_id")
    order = W.partitionBy("path").orderBy("created_at", "run_id")
    rows = at.withColumns({n: F.lag(c).over(order) for n, c in (("previous_run", "run_id"), ("previous_ts", "created_at"), ("previous_score", "total_score"), ("previous_checks", "checks"))})
    delta = round1(F.coalesce("total_score", F.lit(0.0)) - F.coalesce("previous_score", F.lit(0.0)))
    some = F.col("previous_run").isNotNull()
    return rows.select("run_id", "path", "created_at", "total_score", "previous_run", "previous_ts", "previous_score", F.when(some, F.abs(delta)).alias("delta"), F.when(some, direction(delta)).alias("direction"), checks.fixed(F.col("previous_checks"), F.col("checks")).alias("fixed"), checks.regressed(F.col("previous_checks"), F.col("checks")).alias("regressed"))


def previous_run(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """The run that each run is compared with: for a site the latest earlier site, for a single page the latest earlier run that has it.

    Runs of a path stand in a window by time; each looks at the last analyzed one before it, so no run meets all others.
    """
    kinds = runs.join(pages.groupBy("run_id").agg(F.count("*").alias("n")), "run_id").withColumn("kind", F.when(F.col("n") == 1, "page").otherwise("site"))
    sites = kinds.where("kind = 'site'").select("run_id", "kind", F.lag("run_id").over(W.partitionBy("origin").orderBy("created_at", "run_id")).alias("previous_run"))
    earlier = W.partitionBy("path").orderBy("created_at").rangeBetween(W.unboundedPreceding, -1)
    at = pages.select("run_id", "path", "status").join(kinds.select("run_id", "kind", "created_at"), "run_id").withColumn("created_at", F.unix_micros("created_at"))
    seen = F.max(F.when(F.col("status") == "ok", F.struct("created_at", "run_id"))).over(earlier)
    return sites.unionByName(at.withColumn("seen", seen).where("kind = 'page'").select("run_id", "kind", F.col("seen.run_id").alias("previous_run")))


def run_points(runs: DataFrame, totals: DataFrame, current: str | None = None) -> DataFrame:
    """Runs as points of a chart."""
    return runs.join(totals, "run_id").select("run_id", "created_at", "label", "average_score", "analyzed", (F.col("run_id") == F.lit(current)).alias("current"))


def earlier_runs(runs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Each run with every earlier one of its site: origin, before, after.

    That is all pairs of a site's runs. done: pairs (before, after) that have been compared; with it, only runs that lack
    a comparison with some earlier one meet those.
    """
    a, b = runs.select("origin", F.col("run_id").alias("after"), F.col("created_at").alias("at")), runs.select("origin", F.col("run_id").alias("before"), F.col("created_at").alias("before_at"))
    if done is not None:
        rank = F.row_number().over(W.partitionBy("origin").orderBy("created_at", "run_id")) - 1
        due = runs.select(F.col("run_id").alias("after"), rank.alias("due"))
        had = done.distinct().groupBy("after").agg(F.count("*").alias("had"))
        open_ = due.join(had, "after", "left").where(F.coalesce("had", F.lit(0)) < F.col("due")).select("after")
        a = a.join(open_, "after", "left_semi")
    pairs = a.join(b, "origin").where("before_at < at").select("origin", "before", "after")
    return pairs if done is None else pairs.join(done, ["before", "after"], "left_anti").select("origin", "before", "after")


def missing_reports(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages of runs whose report hasn't been made: keys run_id and path of ``done`` are left out."""
    return pages.join(done.select("run_id", "path").distinct(), ["run_id", "path"], "left_anti")


def stale(records: DataFrame, cache: DataFrame, version: str) -> DataFrame:
    """Records that have to be analyzed: their hash isn't in the cache for this version."""
    known = cache.where(F.col("version") == version).select("url_norm", "content_hash")
    return records.join(known, ["url_norm", "content_hash"], "left_anti")


def pruned_cache(cache: DataFrame, version: str) -> DataFrame:
    return cache.where(F.col("version") == version)


def content_hash(record: DataFrame) -> Column:
    """A hash of what a page shows: title, description, headings, text and counts."""
    return F.xxhash64("meta.title", "meta.description", F.to_json("headings"), F.array_join("paragraphs", "\n"), F.size("links"), F.size("images"), F.size("lists"), F.size("schema"))


def daily_once(reports: DataFrame, key: str = "url_norm", at: str = "ts") -> DataFrame:
    """One report a page and day: the first."""
    day = F.to_date(at)
    return reports.withColumn("day", day).withColumn("n", F.row_number().over(W.partitionBy(key, "day").orderBy(at))).where("n = 1").drop("n")
