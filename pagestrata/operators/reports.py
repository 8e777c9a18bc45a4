"""What reports show of results and runs: counts, orders, outlines, and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.numbers import half_up, round1, size
from ..functions.text import markdown_html
from .orders import in_order
from .runs import open_findings
from .scoring import category_level, status

#: Findings shown before the rest is folded.
SHOWN = 5


def status_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Criteria by status (fail, partial, ok) and findings by owner of each page."""
    scored = F.filter("criteria", lambda c: c["weight"] > 0)
    counts = [size(F.filter(scored, lambda c: status(c) == F.lit("fail"))).alias("fail"), size(F.filter(scored, lambda c: status(c) == F.lit("partial"))).alias("partial"), size(F.filter(scored, lambda c: status(c) == F.lit("ok"))).alias("ok")]
    owners = [size(F.filter("findings", lambda f: f["owner"] == F.lit("editorial"))).alias("editorial"), size(F.filter("findings", lambda f: f["owner"] == F.lit("dev"))).alias("dev")]
    return results.select(*keys, *counts, *owners)


def criteria_in_order(results: DataFrame, *keys: str) -> DataFrame:
    """Criteria of a page for a report: failing ones first, then partial ones, then the rest, each as analyzed."""
    rank = lambda c: F.when(status(c) == "fail", 0).when(status(c) == "partial", 1).otherwise(2)
    ranked = F.array_sort(F.transform("criteria", lambda c, i: F.struct(rank(c).alias("rank"), i.alias("ordinal"), c["criterion"].alias("criterion"), c["category"].alias("category"), c["value"].alias("value"), status(c).alias("status"), half_up(100 * c["points"] / F.nullif(c["weight"], F.lit(0.0))).alias("percent"))))
    rows = results.select(*keys, F.posexplode_outer(ranked).alias("position", "c")).where("c IS NOT NULL")
    return rows.select(*keys, "position", "c.criterion", "c.category", "c.value", "c.status", "c.percent")


def visible_findings(findings: Column) -> Column:
    """The findings shown at once, and those that are folded."""
    return F.struct(F.slice(findings, 1, SHOWN).alias("shown"), F.slice(findings, SHOWN + 1, 1000).alias("folded"))


def findings_by_key(pages: DataFrame) -> DataFrame:
    """Findings of a run with the number of their pages and the first of these."""
    found = open_findings(pages.where("status = 'ok'"))
    return found.select("key", "priority", F.col("page_count").alias("n"), F.col("pages").alias("paths"))


def category_means(pages: DataFrame) -> DataFrame:
    """Mean of each category over the analyzed pages of a run, with its level."""
    ok = pages.where("status = 'ok'")
    means = ok.agg(*(round1(F.avg(f"categories.{n}")).alias(n) for n in config.CATEGORIES))
    return means.select(F.explode(F.array(*(F.struct(F.lit(n).alias("category"), F.col(n).alias("score"), category_level(F.col(n)).alias("level")) for n in config.CATEGORIES))).alias("x")).select("x.*")


def usage_rows(results: DataFrame) -> DataFrame:
    """What a page's usage record would hold: its category scores and distinct findings. Nothing is sent."""
    return results.select("url", F.struct(*config.CATEGORIES).alias("categories"), F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["key"]))).alias("findings"))


def outline(records: DataFrame, *keys: str) -> DataFrame:
    """The headings of a page, and where a level is left out."""
    rows = records.select(*keys, "headings", F.posexplode_outer("headings").alias("position", "h")).where("h IS NOT NULL")
    jump = F.col("h.level") - F.get("headings", F.col("position") - 1)["level"] > 1
    return rows.select(*keys, "position", "h.level", "h.text", F.coalesce((F.col("position") > 0) & jump, F.lit(False)).alias("jump"))


def signed(x: Column) -> Column:
    return F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), F.format_number(x, 1))


def diff_markdown(changes: DataFrame) -> DataFrame:
    """One Markdown line a changed page (page_changes), the largest losses first."""
    lists = [F.when(size(F.col(c)) > 0, F.concat(F.lit(f" · {label}: "), F.array_join(c, ", "))).otherwise(F.lit("")) for c, label in (("findings_fixed", "fixed"), ("findings_new", "new"), ("regressed", "regressed"))]
    return in_order(changes, "page_changes").select(F.concat(F.lit("- `"), "path", F.lit("` "), F.format_number("before", 1), F.lit(" → "), F.format_number("after", 1), F.lit(" ("), signed(F.col("delta")), F.lit(")"), *lists).alias("value"))


def ticket_markdown(plan: DataFrame) -> DataFrame:
    """One Markdown section a work item (plan_tickets), in the plan's order."""
    return in_order(plan, "tickets").select(F.concat(F.lit("## "), "title", F.lit("\n\n"), F.lit("state: "), "state", F.lit(", level: "), "level", F.lit("\n\n"), "body").alias("value"))


def terminal_lines(results: DataFrame) -> DataFrame:
    """One line a page: score, rating, URL and its first findings; the lowest scores first."""
    first = F.array_join(F.transform(visible_findings(F.col("findings"))["shown"], lambda f: f["key"]), ", ")
    return in_order(results, "pages").select(F.concat(F.lpad(F.format_number("totalScore", 1), 5, " "), F.lit("/30  "), F.rpad("rating", 9, " "), F.lit("  "), "url", F.lit("  "), first).alias("value"))


def ticket_html(plan: DataFrame) -> DataFrame:
    """Work items with their body as HTML: key, title and html."""
    return plan.select("key", "title", markdown_html(F.col("body")).alias("html"))


def crawler_table(views: DataFrame, *keys: str) -> DataFrame:
    """What a crawler without scripts sees of each page beside what a reader sees: a row a measure. views: the column crawlerView."""
    v = F.col("crawlerView")
    lines = [("status", v["status"], F.lit("ok")), ("characters", v["rawChars"].cast("string"), v["renderedChars"].cast("string")), ("coverage", F.concat(half_up(v["coverage"] * 100).cast("string"), F.lit("%")), F.lit("100%")), ("missing headings", F.array_join(v["missingHeadings"], ", "), F.lit(""))]
    rows = F.array(*(F.struct(F.lit(name).alias("measure"), raw.alias("raw"), rendered.alias("rendered")) for name, raw, rendered in lines))
    return views.where(v.isNotNull()).select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*")


def diff_lines(totals: DataFrame) -> DataFrame:
    """One line of plain text for the comparison of two runs (diff_totals)."""
    return totals.select(F.concat(F.col("pages").cast("string"), F.lit(" pages, "), F.format_number("before", 1), F.lit(" → "), F.format_number("after", 1), F.lit(" ("), signed(F.col("delta")), F.lit("), findings -"), F.col("fixed").cast("string"), F.lit(" +"), F.col("new").cast("string"), F.when(F.col("regression"), F.lit(", worse")).otherwise(F.lit(""))).alias("value"))


def run_lines(summary: DataFrame) -> DataFrame:
    """One line of plain text a run (run_totals by run_id)."""
    return summary.select(F.concat("run_id", F.lit(": "), F.col("analyzed").cast("string"), F.lit("/"), F.col("pages").cast("string"), F.lit(" pages, mean "), F.coalesce(F.format_number("average_score", 1), F.lit("-")), F.lit("/30")).alias("value"))
