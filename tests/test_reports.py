"""Reports, selectors and highlight targets."""

from pyspark.sql import functions as F

from pagestrata.html.extract import Page
from pagestrata.html.udf import page_data
from pagestrata.operators import reports as P
from pagestrata.operators import runs as D
from pagestrata.operators import scoring as S
from pagestrata.operators import targets as T
from pagestrata.operators.orders import in_order

HTML = f"""<html lang="de"><body><main id="m"><h1>Eins</h1><h1>Der zweite Titel</h1><h4>Tief</h4><div id="x.y"><p>Rund 30 % der Haushalte heizen so. {'Sehr lange Zusammensetzungsungetüme erschweren Leseverständnisleistungen ' * 9}</p></div>
<p>Rund 40 % nach <a href="https://bfe.admin.ch/x">dem Bundesamt</a> in diesem Absatz.</p><img src="a.png"><img src="b.png" alt=""></main><p id="twice"></p><p id="twice"></p></body></html>"""


def results(spark):
    pages = spark.createDataFrame([(1, "https://example.ch/a", HTML), (2, "https://example.ch/b", "")], "page_id bigint, url string, html string")
    return S.analyze(page_data(pages), F.lit("2024-07-01").cast("timestamp"))


def test_selectors():
    paths = Page(HTML, "https://example.ch/a").paths()
    assert paths["headings"] == ["#m > h1:nth-of-type(1)", "#m > h1:nth-of-type(2)", "#m > h4"]
    assert paths["paragraphs"] == [{"path": r"#x\.y > p", "sourced": False}, {"path": "#m > p", "sourced": True}]
    assert paths["images"] == ["#m > img:nth-of-type(1)"]


def test_targets_and_reports(spark, tmp_path):
    results(spark).write.parquet(f"{tmp_path}/r")
    found = spark.read.parquet(f"{tmp_path}/r")
    got = {(r["finding"], r["path"], r["label"]) for r in T.highlight_targets(found, "page_id").where("page_id = 1").collect()}
    assert got == {
        ("images_missing_alts", "#m > img:nth-of-type(1)", "missing_alt"), ("bad_hierarchy", "#m > h1:nth-of-type(2)", "extra_h1"), ("bad_hierarchy", "#m > h4", "heading_jump"), ("low_scanability", r"#x\.y > p", "long_paragraph"),
        ("no_h1", "#m > h1:nth-of-type(1)", "h1_too_short"), ("no_h1", "#m > h1:nth-of-type(2)", "extra_h1"), ("no_sourced_claims", r"#x\.y > p", "unsourced_claim"), ("no_key_info_upfront", r"#x\.y > p", "key_info"), ("low_readability", r"#x\.y > p", "read_band_very_hard"),
    }
    for r in P.status_counts(found, "page_id").collect():
        row = found.where(F.col("page_id") == r["page_id"]).head()
        assert r["fail"] + r["partial"] + r["ok"] == sum(c["weight"] > 0 for c in row["criteria"]) and r["dev"] + r["editorial"] == len(row["findings"])
    order = [r["status"] for r in P.criteria_in_order(found, "page_id").where("page_id = 1").orderBy("position").collect()]
    assert order == sorted(order, key=["fail", "partial", "ok"].index)
    assert [(r["level"], r["jump"]) for r in P.outline(found, "page_id").orderBy("position").collect()] == [(1, False), (1, False), (4, True)]
    pages = D.snapshot_pages(found, "r")
    by_key = in_order(P.findings_by_key(pages), "findings").collect()
    assert [r["n"] for r in by_key] == sorted((r["n"] for r in by_key), reverse=True) and by_key[0]["paths"] == ["/a", "/b"]
    assert P.category_means(pages).count() == 6
    assert P.usage_rows(found).count() == 2
    lines = [r["value"] for r in P.terminal_lines(found).collect()]
    assert len(lines) == 2 and lines[0].endswith("title_missing, no_h1, no_schema, description_missing, no_definitions") and "/30" in lines[0]
    shown = found.select(P.visible_findings(F.col("findings")).alias("v")).head()["v"]
    assert len(shown["shown"]) == 5 and shown["folded"]
    assert P.ticket_markdown(D.plan_tickets(pages, "https://example.ch")).head()["value"].startswith("## ")
    before = pages.withColumn("total_score", F.col("total_score") + 1.5)
    assert P.diff_markdown(D.page_changes(D.matched(before, pages))).head()["value"].split(" (")[1].startswith("-1.5)")
    assert P.run_lines(D.run_totals(pages, "run_id")).head()["value"].startswith("r: 2/2 pages, mean ")
    assert P.diff_lines(D.diff_totals(D.matched(before, pages))).head()["value"].startswith("2 pages, ") and P.diff_lines(D.diff_totals(D.matched(before, pages))).head()["value"].endswith(", worse")
    assert P.ticket_html(D.plan_tickets(pages, "https://example.ch")).head()["html"].startswith("<p><strong>")
    views = spark.createDataFrame([(1, ("partial", 0.5, 100, 50, ["A", "B"])), (2, None)], "page_id int, crawlerView struct<status: string, coverage: double, renderedChars: int, rawChars: int, missingHeadings: array<string>>")
    assert [tuple(r) for r in P.crawler_table(views, "page_id").collect()] == [(1, "status", "partial", "ok"), (1, "characters", "50", "100"), (1, "coverage", "50%", "100%"), (1, "missing headings", "A, B", "")]
