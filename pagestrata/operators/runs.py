"""Runs over a site: snapshots, their comparison, and the work items that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions import checks, urls
from ..functions.numbers import round1, size
from ..functions.steps import small
from ..functions.text import first_sentence_title
from .scoring import checks_map

CATEGORY_FIELDS = ", ".join(f"{n}: DOUBLE" for n in config.CATEGORIES)
SNAPSHOT_PAGES = f"""
run_id STRING, url STRING, path STRING, status STRING, error STRING, http_status INT, total_score DOUBLE, page_type STRING,
categories STRUCT<{CATEGORY_FIELDS}>, checks MAP<STRING, BOOLEAN>,
findings ARRAY<STRUCT<key: STRING, fingerprint: STRING, owner: STRING, effort: STRING, priority: INT, text: STRING>>, position BIGINT
""".replace("\n", " ").strip()
SNAPSHOTS = "run_id STRING, format STRING, tool_version STRING, created_at TIMESTAMP, label STRING, lang STRING, origin STRING, source STRING"
LISTED_PAGES = 25


def snapshot_pages(results: DataFrame, run_id: str | Column) -> DataFrame:
    """Page rows of a run. A row with an error, or without a score, is a failed page. position: the order of the inputs, if they tell one, else that of the rows."""
    run = F.lit(run_id) if isinstance(run_id, str) else run_id
    path = urls.snapshot_path(F.col("url"))
    error = F.col("error") if "error" in results.columns else F.lit(None).cast("string")
    http = F.col("http_status") if "http_status" in results.columns else F.lit(None).cast("int")
    position = F.col("position") if "position" in results.columns else F.monotonically_increasing_id()
    ok = error.isNull()
    findings = F.transform(F.col("findings"), lambda f: F.struct(f["key"].alias("key"), F.concat(F.lit("finding:"), f["key"], F.lit(":"), path).alias("fingerprint"), F.coalesce(f["owner"], F.lit("dev")).alias("owner"), F.coalesce(f["effort"], F.lit("medium")).alias("effort"), F.coalesce(f["priority"], F.lit(0)).alias("priority"), f["key"].alias("text")))
    return results.select(
        run.alias("run_id"), "url", path.alias("path"), F.when(ok, "ok").otherwise("error").alias("status"), error.alias("error"), http.cast("int").alias("http_status"),
        F.when(ok, round1(F.col("totalScore"))).alias("total_score"), F.when(ok, F.col("pageType")).alias("page_type"),
        F.when(ok, F.struct(*(round1(F.col(n)).alias(n) for n in config.CATEGORIES))).alias("categories"), F.when(ok, checks_map(F.col("criteria"))).alias("checks"), F.when(ok, findings).alias("findings"), position.cast("bigint").alias("position"),
    )


def snapshot_header(spark: SparkSession, run_id: str, created_at: str, origin: str, source: str = "urls", label: str | None = None, lang: str = "en") -> DataFrame:
    row = [(run_id, config.SNAPSHOT_FORMAT, config.TOOL_VERSION, created_at, label, lang, origin, source)]
    return spark.createDataFrame(row, SNAPSHOTS.replace("TIMESTAMP", "STRING")).withColumn("created_at", F.to_timestamp("created_at"))


def write_snapshot(pages: DataFrame, header: DataFrame, folder: str) -> None:
    """Appends a run: pages partitioned by run, and one header row."""
    pages.write.mode("append").partitionBy("run_id").parquet(f"{folder}/pages")
    header.write.mode("append").parquet(f"{folder}/runs")


def read_snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(headers, pages) of the runs in the format that this engine knows."""
    runs = spark.read.schema(SNAPSHOTS).parquet(f"{folder}/runs").where(F.col("format") == config.SNAPSHOT_FORMAT)
    pages = spark.read.schema(SNAPSHOT_PAGES).parquet(f"{folder}/pages")
    return runs, pages.join(small(runs.select("run_id")), "run_id", "left_semi")


def run_totals(pages: DataFrame, *by: str) -> DataFrame:
    """Pages, analyzed pages and the mean of their scores; null without any."""
    ok = F.col("status") == "ok"
    return pages.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(ok).alias("analyzed"), round1(F.avg(F.when(ok, F.coalesce("total_score", F.lit(0.0))))).alias("average_score"))


def last_by_path(pages: DataFrame) -> DataFrame:
    """One row a path: of repeated ones the last by position, or by the order of the rows where there is none."""
    placed = pages if "position" in pages.columns else pages.withColumn("position", F.monotonically_increasing_id())
    cols = [c for c in placed.columns if c != "path"]
    return placed.groupBy("path").agg(F.max_by(F.struct(*cols), F.coalesce("position", F.lit(-1))).alias("x")).select("path", "x.*")


def matched(before: DataFrame, after: DataFrame) -> DataFrame:
    """All paths of two runs, side by side as structs b and a."""
    b = last_by_path(before)
    a = last_by_path(after)
    left = b.select("path", F.struct(*[c for c in b.columns if c != "path"]).alias("b"))
    right = a.select("path", F.struct(*[c for c in a.columns if c != "path"]).alias("a"))
    return left.join(right, "path", "full_outer")


def common_pages(pairs: DataFrame) -> DataFrame:
    return pairs.where((F.col("b.status") == "ok") & (F.col("a.status") == "ok"))


def pages_added(pairs: DataFrame) -> DataFrame:
    return pairs.where("b IS NULL").select("path")


def pages_removed(pairs: DataFrame) -> DataFrame:
    return pairs.where("a IS NULL").select("path")


def pages_failed(pairs: DataFrame) -> DataFrame:
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return pairs.where(both & ~((F.col("b.status") == "ok") & (F.col("a.status") == "ok"))).select("path", F.col("b.error").alias("before"), F.col("a.error").alias("after"))


def new_criteria(before: DataFrame, after: DataFrame) -> DataFrame:
    """Criteria that only the later run checked, on whatever page."""
    names = [p.select(F.explode(F.map_keys("checks")).alias("criterion")).distinct() for p in (before, after)]
    return names[1].join(names[0], "criterion", "left_anti")


def page_changes(pairs: DataFrame) -> DataFrame:
    """Scores, criteria and findings that changed on the pages of both runs."""
    before, after = (F.coalesce(F.col(f"{s}.total_score"), F.lit(0.0)) for s in "ba")
    keys = [F.transform(F.coalesce(F.col(f"{s}.findings"), F.array()), lambda f: f["key"]) for s in "ba"]
    none = F.create_map().cast("map<string,boolean>")
    checked = [F.coalesce(F.col(f"{s}.checks"), none) for s in "ba"]
    return common_pages(pairs).select(
        "path", before.alias("before"), after.alias("after"), round1(after - before).alias("delta"), checks.fixed(*checked).alias("fixed"), checks.regressed(*checked).alias("regressed"),
        F.array_except(keys[0], keys[1]).alias("findings_fixed"), F.array_except(keys[1], keys[0]).alias("findings_new"),
    )


def first_pages(rows: DataFrame, *names: str) -> DataFrame:
    """(key, names): of each list the first LISTED_PAGES paths. rows: key, path and a boolean column by name.

    Ranks are cut before rows are exchanged, so a finding of all pages sends no more of them than it lists.
    """
    each = rows.select("key", "path", F.explode(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in names)))).alias("list"))
    ranked = each.withColumn("n", F.row_number().over(W.partitionBy("key", "list").orderBy("path"))).where(F.col("n") <= LISTED_PAGES)
    lists = ranked.groupBy("key").agg(*(F.array_sort(F.collect_list(F.when(F.col("list") == n, F.col("path")))).alias(n) for n in names))
    return lists


def finding_changes(pairs: DataFrame) -> DataFrame:
    """Findings of both runs on their common pages: pages before and after, on how many it went (fixed) or came (new), and the first of these pages."""
    common = common_pages(pairs)
    sides = [common.select("path", F.explode(f"{s}.findings").alias(s)).select("path", F.col(f"{s}.key").alias("key"), s) for s in "ba"]
    met = sides[0].join(sides[1], ["path", "key"], "full_outer").withColumns({"fixed_on": F.col("a").isNull(), "new_on": F.col("b").isNull()})
    rows = met.groupBy("key").agg(
        F.min_by(F.coalesce(F.col("a"), F.col("b")), F.struct(F.col("a").isNull(), F.col("path"))).alias("of"), F.count_if(F.col("b").isNotNull()).alias("before"), F.count_if(F.col("a").isNotNull()).alias("after"),
        F.count_if("fixed_on").alias("fixed"), F.count_if("new_on").alias("new"),
    )
    none = F.array().cast("array<string>")
    listed = rows.join(first_pages(met, "fixed_on", "new_on"), "key", "left")
    return listed.select("key", "of.text", "of.owner", "of.effort", "of.priority", "before", "after", "fixed", "new", F.coalesce("fixed_on", none).alias("fixed_on"), F.coalesce("new_on", none).alias("new_on"))


def diff_totals(pairs: DataFrame) -> DataFrame:
    """One row: common pages with their means, findings fixed and new, pages up and down, regression."""
    changes = page_changes(pairs)
    worse = (F.col("delta") < 0) | (F.size("findings_new") > 0) | (F.size("regressed") > 0)
    rows = changes.agg(
        F.count("*").alias("pages"), round1(F.avg("before")).alias("before"), round1(F.avg("after")).alias("after"), F.coalesce(F.sum(F.size("findings_fixed")), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.size("findings_new")), F.lit(0)).alias("new"),
        F.count_if(F.col("delta") > 0).alias("pages_up"), F.count_if(F.col("delta") < 0).alias("pages_down"), F.coalesce(F.bool_or(worse), F.lit(False)).alias("regression"),
    )
    return rows.withColumn("delta", round1(F.col("after") - F.col("before")))


def has_regression(pairs: DataFrame) -> bool:
    return bool(diff_totals(pairs).head()["regression"])


def gate(pages: DataFrame, least: float) -> bool:
    """Whether a run's mean score reaches a mark; a run without any page doesn't."""
    mean = run_totals(pages).head()["average_score"]
    return mean is not None and mean >= least


def level(priority: Column) -> Column:
    return F.when(priority >= 10, "high").when(priority >= 7, "medium").otherwise("low")


def open_findings(pages: DataFrame) -> DataFrame:
    """Findings of a run with the number of their pages and the first of these; owner and the like as on the first."""
    rows = pages.select("path", F.explode("findings").alias("f")).select("path", "f", F.col("f.key").alias("key"), F.lit(True).alias("pages"))
    counted = rows.groupBy("key").agg(F.min_by("f", "path").alias("of"), F.count("*").alias("page_count"))
    return counted.join(first_pages(rows, "pages"), "key").select("key", "of.text", "of.owner", "of.effort", "of.priority", "page_count", "pages")


def plan_tickets(pages: DataFrame, origin: str, baseline: DataFrame | None = None, owner: str | None = None, min_priority: int = 0) -> DataFrame:
    """Open findings as work items, and, against a baseline, those that are gone from every common page."""
    opened = open_findings(pages)
    host = urls.hostname(F.lit(origin))
    keep = F.col("priority") >= min_priority if owner is None else (F.col("priority") >= min_priority) & (F.col("owner") == owner)
    none = F.lit(None).cast("array<string>")
    if baseline is None:
        planned = opened.select("*", F.lit("open").alias("state"), F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"), none.alias("fixed_on"), none.alias("new_on"))
    else:
        changes = finding_changes(matched(baseline, pages))
        now = opened.join(changes.select("key", "before", "after", "fixed_on", "new_on"), "key", "left").select("key", "text", "owner", "effort", "priority", "page_count", "pages", F.lit("open").alias("state"), "before", "after", "fixed_on", "new_on")
        gone = changes.join(opened.select("key"), "key", "left_anti").where("before > 0").select("key", "text", "owner", "effort", "priority", F.lit(0).cast("bigint").alias("page_count"), F.array().cast("array<string>").alias("pages"), F.lit("resolved").alias("state"), "before", "after", "fixed_on", "new_on")
        planned = now.unionByName(gone)
    listed = F.concat(F.transform("pages", lambda p: F.concat(F.lit(f"- {origin}"), p)), F.when(F.col("page_count") > LISTED_PAGES, F.array(F.concat(F.lit("- +"), (F.col("page_count") - LISTED_PAGES).cast("string")))).otherwise(F.array().cast("array<string>")))
    marker = F.concat(F.lit("finding:"), host, F.lit(":"), F.col("key"))
    body = F.concat_ws("\n\n", F.concat(F.lit("**"), F.col("owner"), F.lit("** · "), F.col("effort")), F.when(F.col("state") == "open", F.concat_ws("\n\n", F.col("text"), F.array_join(listed, "\n"))), F.concat(F.lit("`"), marker, F.lit("`")))
    return planned.where(keep).withColumns({"marker": marker, "title": first_sentence_title(F.col("text")), "level": level(F.col("priority")), "body": body})


def findings_json(pages: DataFrame) -> DataFrame:
    """One JSON document a finding of a page."""
    flat = pages.select("url", "path", F.explode("findings").alias("f"))
    return flat.select(F.to_json(F.struct("f.key", "f.fingerprint", "f.owner", "f.effort", "f.priority", "f.text", "url", "path")).alias("value"))


def snapshot_json(header: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs as JSON documents, line by line: run_id, place, value. A run's lines in the order of place are its document.

    There is a line to open it with the header, one a page in the order of paths, and one to end it with the summary; so no
    row holds a whole run, whatever its size.
    """
    opening = F.to_json(F.struct("format", F.struct(F.col("tool_version").alias("version")).alias("tool"), "created_at", "label", "lang", "origin", "source"))
    summary = header.select("run_id").join(run_totals(pages, "run_id"), "run_id", "left")
    first = pages.groupBy("run_id").agg(F.min(F.struct("path", "url")).alias("first"))
    entry = F.to_json(F.struct("path", "url", "status", "error", "http_status", "total_score", "page_type", "categories", "checks", "findings"))
    own = pages.join(small(first), "run_id").select("run_id", F.struct(F.lit(1).alias("part"), "path", "url").alias("place"), F.concat(F.when(F.struct("path", "url") == F.col("first"), F.lit("  ")).otherwise(F.lit("  ,")), entry).alias("value"))
    edge = lambda part: F.struct(F.lit(part).alias("part"), F.lit("").alias("path"), F.lit("").alias("url")).alias("place")
    start = header.select("run_id", edge(0), F.concat(F.regexp_replace(opening, r"\}$", ""), F.lit(',"pages":[')).alias("value"))
    end = summary.select("run_id", edge(2), F.concat(F.lit('],"summary":'), F.to_json(F.struct(F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("analyzed", F.lit(0)).alias("analyzed"), "average_score")), F.lit("}")).alias("value"))
    return start.unionByName(own).unionByName(end)


def write_snapshot_json(header: DataFrame, pages: DataFrame, folder: str) -> None:
    """Text files below run_id=...: read one after the other, by name, they are the run's document."""
    lines = snapshot_json(header, pages).repartitionByRange("run_id", "place").sortWithinPartitions("run_id", "place")
    lines.select("run_id", "value").write.partitionBy("run_id").text(folder)


def parse_snapshot_json(text: DataFrame) -> DataFrame:
    """Runs from JSON documents (column value); others are dropped."""
    fields = T._parse_datatype_string(SNAPSHOT_PAGES)
    page = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in fields if f.name != "run_id")
    parsed = text.select(F.from_json("value", f"format STRING, created_at TIMESTAMP, label STRING, origin STRING, pages ARRAY<STRUCT<{page}>>").alias("x")).select("x.*")
    return parsed.where((F.col("format") == config.SNAPSHOT_FORMAT) & F.col("pages").isNotNull())


def page_report_name(path: Column) -> Column:
    """A file name for a page: a slug of at most 60 characters and six digits of a digest."""
    slug = F.substring(F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.concat(F.when(slug == "", F.lit("index")).otherwise(slug), F.lit("-"), F.substring(F.sha1(path), 1, 6), F.lit(".html"))


