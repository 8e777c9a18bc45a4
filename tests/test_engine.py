"""Criteria, scores, findings, runs, histories, inputs and streams."""

import glob
import json
import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pagestrata import config
from pagestrata.functions import robots
from pagestrata.html.udf import page_data
from pagestrata.operators import history as H
from pagestrata.operators import inputs as I
from pagestrata.operators import runs as D
from pagestrata.operators import scoring as S
from pagestrata.operators.orders import in_order
from pagestrata.sources import pages as P
from pagestrata.streaming import pages as stream

NOW = "2024-07-01 00:00:00"
PROSE = "Wärmepumpen heizen mit Wärme aus der Luft. Sie sparen rund 30 % Energie im Vergleich. Das Gerät ist leise und braucht wenig Platz im Haus. "
ARTICLE = f"""<!doctype html><html lang="de"><head><title>Wärmepumpen im Überblick für Eigentümer</title>
<meta name="description" content="{'Was eine Wärmepumpe kostet, wie sie funktioniert und wann sie sich lohnt. ' * 2}"><link rel="canonical" href="https://www.example.ch/ratgeber/waermepumpe">
<meta name="viewport" content="width=device-width, initial-scale=1"><meta property="og:title" content="t"><meta property="og:description" content="d"><meta property="og:image" content="/img/pumpe.jpg"><meta property="og:url" content="u"><meta property="og:type" content="article"><meta name="twitter:card" content="summary">
<script type="application/ld+json">{{"@graph":[{{"@type":"Article","@id":"#a","headline":"h","author":{{"@id":"#p"}},"datePublished":"2024-05-01","publisher":{{"@id":"#o"}},"about":"Heizen"}},{{"@type":"Person","@id":"#p","name":"Jane Doe","url":"https://x"}},{{"@type":"Organization","@id":"#o","name":"Org","url":"u","logo":"l"}}]}}</script></head>
<body><header><nav><a href="/">Start</a></nav></header><main><article><h1>Wärmepumpen im Überblick</h1><p>Von Jane Doe, aktualisiert am 1. Mai 2024</p><p>Eine Wärmepumpe ist eine Heizung, die Umgebungswärme nutzt. {PROSE}</p>
<section><h2>Was ist eine Wärmepumpe?</h2><p>Eine Wärmepumpe ist ein Gerät, das Wärme verschiebt. {PROSE}</p><ul><li>Luft</li><li>Wasser</li></ul></section><section><h2>Was kostet sie?</h2><p>Eine Anlage kostet CHF 30'000 bis 50'000. {PROSE}</p><ol><li>Planen</li><li>Bauen</li></ol></section>
<section><h2>Lohnt sie sich?</h2><p>Erstens spart sie Energie (BFE 2024). {PROSE}</p><table><tr><th>a<th>b<tr><td>1<td>2</table></section><p>Quellen: <a href="https://bfe.admin.ch/studie">Studie des Bundes</a>, <a href="https://www.eth.ch/x">Bericht der Hochschule</a>, <a href="https://facebook.com/x">Facebook</a></p>
<p>Mehr zu <a href="/ratgeber/solar">Solarstrom im Haus</a>, <a href="/ratgeber/daemmung">Dämmung von Dächern</a> und <a href="/ratgeber/foerderung">Förderung durch Kantone</a> lesen.</p><img src="a.jpg" alt="x"></article></main><footer><a href="/impressum">Impressum</a></footer></body></html>"""
EMPTY = "<html><body><div id=root></div></body></html>"
HOME = """<html lang="de"><head><title>Org</title><meta name="robots" content="noindex"></head><body><h1>Willkommen</h1><h1>Zwei</h1><h4>Tief</h4><a href="/kontakt">Kontakt</a><a href="/impressum">Impressum</a><p>Hauptstrasse 12, 8001 Zürich. Öffnungszeiten</p></body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://www.example.ch/ratgeber/waermepumpe", ARTICLE), (2, "https://www.example.ch/app", EMPTY), (3, "https://www.example.ch/de/", HOME), (4, "not a url", None)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


@pytest.fixture(scope="module")
def results(spark, pages, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('engine')}/results"
    S.analyze(page_data(pages), F.lit(NOW).cast("timestamp")).write.parquet(path)
    return spark.read.parquet(path)


def criteria(results, page):
    row = results.where(F.col("page_id") == page).head()
    return {c["criterion"]: c for c in row["criteria"]}, [f["key"] for f in row["findings"]], row


def test_article(results):
    c, findings, row = criteria(results, 1)
    assert row["pageType"] == "article" and row["rating"] in ("good", "excellent")
    full = {k for k, x in c.items() if math.isclose(x["points"], x["weight"])}
    assert {"h1", "hierarchy", "lists", "sections", "author", "date", "sources", "schema", "schema_completeness", "internalLinks", "facts", "title_quality", "meta_description", "image_alts", "indexability", "viewport", "social_cards", "canonical", "robotsTxt"} <= full
    assert math.isclose(c["definitions"]["points"], 2.0 * (0.7 + 0.15)) and math.isclose(c["entities"]["points"], 1.5) and math.isclose(c["semanticHtml"]["points"], 1.0)
    assert math.isclose(c["faq"]["points"], 1.5 * 0.6) and c["llmsTxt"]["points"] == 0
    assert "sitemap" not in c and "crawlerView" not in c and "publisher" not in c and "hreflang" not in c
    assert "no_llms_txt" in findings and not {"no_h1", "no_author", "no_schema", "few_sources"} & set(findings)


def test_empty_page(results):
    c, findings, row = criteria(results, 2)
    assert c["h1"]["value"] == "notPresent" and c["hierarchy"]["points"] == 0 and "readability" not in c
    assert c["image_alts"]["points"] == 1.5 and c["date"]["value"] == "noDateFound"
    priorities = [f["priority"] for f in row["findings"]]
    assert priorities == sorted(priorities, reverse=True) and findings[:2] == ["title_missing", "no_h1"]


def test_homepage(results):
    c, findings, row = criteria(results, 3)
    assert row["pageType"] == "homepage"
    for name in ("definitions", "faq", "keyInfoUpfront", "author", "date", "sources"):
        assert c[name]["weight"] == 0 and c[name]["found"] and c[name]["value"] == "notApplicable"
    # two of three link kinds, no organization: 0.3 of 2 points
    assert math.isclose(c["publisher"]["points"], 0.6) and c["h1"]["points"] == 0.75
    assert math.isclose(c["hierarchy"]["points"], 1.5 * (1 - 0.1 - 0.2 - 0.1))
    assert c["localBusiness"]["value"] == "noneFound" and c["indexability"]["points"] == 0
    assert findings[0] == "page_is_noindex" and {"publisher_unclear", "local_business_incomplete", "title_too_short"} <= set(findings)


def test_scores_add_up(results):
    for row in results.collect():
        total = 0.0
        for name in config.CATEGORIES:
            own = [c for c in row["criteria"] if c["category"] == name]
            points, weight = sum(c["points"] for c in own), sum(c["weight"] for c in own)
            want = math.floor(min(5, points / weight * 5) * 10 + 0.5) / 10 if weight else 0
            assert math.isclose(row[name], want, abs_tol=1e-9) and 0 <= row[name] <= 5
            total += row[name]
        assert math.isclose(row["totalScore"], math.floor(total * 10 + 0.5) / 10, abs_tol=1e-9)
        keys = {k for k, *_ in config.FINDINGS}
        assert {f["key"] for f in row["findings"]} <= keys and len({c["criterion"] for c in row["criteria"]}) == len(row["criteria"])
    assert len(config.FINDINGS) == 50 and len(config.WEIGHTS) == 34 and sum(config.PURPOSE_WEIGHTS[p] for _, p in config.BOTS) == 27


def test_tables(results):
    rows = S.criteria_table(results, "page_id")
    assert rows.where("met AND NOT found").count() == 0 and rows.where("applicable != (weight > 0)").count() == 0
    assert S.findings_table(results, "page_id").where("page_id = 1 AND key = 'no_llms_txt' AND priority = 8 AND owner = 'dev'").count() == 1
    checks = results.where("page_id = 3").select(S.checks_map(F.col("criteria"))).head()[0]
    assert "faq" not in checks and checks["robotsTxt"] is True and checks["h1"] is False
    assert [r["page_id"] for r in S.worst_first(results).collect()][-1] == 1


# -- inputs --


def test_optional_inputs(spark, pages):
    files = spark.createDataFrame(
        [("https://www.example.ch", "/robots.txt", 200, "User-agent: OAI-SearchBot\nDisallow: /app\nUser-agent: *\nContent-Signal: search=yes\nSitemap: https://example.ch/map.xml"), ("https://www.example.ch", "/llms.txt", 200, "# index"), ("https://www.example.ch", "/BingSiteAuth.xml", 200, "<users> <user>1</user></users>")],
        "origin string, path string, status int, body string",
    )
    probes = spark.createDataFrame([("https://www.example.ch", "GPTBot", 403, None), ("https://www.example.ch", "ClaudeBot", 200, "challenge"), ("https://www.example.ch", "PerplexityBot", 200, None)], "origin string, bot string, status int, cf_mitigated string")
    maps = spark.createDataFrame(
        [("https://example.ch/map.xml", "<?xml version='1.0'?><urlset><url><loc>https://example.ch/sub.xml</loc></url></urlset>"), ("https://example.ch/sub.xml", "<urlset><url><loc>https://example.ch/app/</loc><lastmod>2024-06-01T00:00</lastmod></url><url><loc>https://www.example.ch/de</loc></url><url><loc>https://www.example.ch/other?a=1&amp;b=2</loc></url></urlset>")],
        "url string, body string",
    )
    origins = spark.createDataFrame([("https://www.example.ch", files.where("path = '/robots.txt'").head()["body"])], "origin string, robots_body string")
    made = I.with_sitemap(I.with_probes(I.with_side_files(page_data(pages.where("page_id < 4")), files), probes), origins, I.sitemap_entries(maps))
    got = {r["page_id"]: r for r in I.complete(made).collect()}
    assert got[2]["robotsTxt"]["blockedBots"] == ["OAI-SearchBot"] and got[1]["robotsTxt"]["blockedBots"] == [] and got[1]["llmsTxt"]["exists"] and not got[1]["llmsTxt"]["fullExists"]
    assert got[1]["botAccess"]["checked"] == ["ClaudeBot", "GPTBot", "PerplexityBot"] and got[1]["botAccess"]["blocked"] == ["ClaudeBot", "GPTBot"]
    assert [(got[i]["sitemap"]["listed"], got[i]["sitemap"]["pageLastmod"]) for i in (1, 2, 3)] == [(False, None), (True, "2024-06-01T00:00"), (True, None)]
    assert got[2]["sitemap"]["declaredInRobots"] and got[2]["sitemap"]["entries"] == 3 and sorted(got[2]["inputs"]) == ["botAccess", "llmsTxt", "robotsTxt", "sitemap"]
    c, findings, _ = criteria(S.analyze(made, F.lit(NOW).cast("timestamp")), 2)
    assert math.isclose(c["robotsTxt"]["points"], 1.5 * (1 - (3 + 0.5 * 2) / 27)) and {"ai_bots_blocked"} <= set(findings) and "ai_bots_firewall" not in findings
    assert math.isclose(c["sitemap"]["points"], 1.0) and c["llmsTxt"]["points"] == 0.5
    assert [r["verification"] for r in I.search_verification(page_data(pages.where("page_id = 1")), files).collect()] == ["file"]
    found = I.discovered_pages(origins, I.sitemap_entries(maps), current="https://www.example.ch/de/", most=5)
    assert [r["url"] for r in found.collect()] == ["https://www.example.ch/other?a=1&b=2"]


def test_crawler_view(spark):
    kind = "struct<chars: int, headings: array<string>, hasH1: boolean, schemaBlocks: int, hasPassword: boolean>"
    side = lambda n, heads=(), password=False: (n, list(heads), True, 0, password)
    rows = [(side(5000, ["A", "B"]), side(5000, ["a"])), (side(5000), side(100)), (side(5000), side(2500)), (side(1000), side(600)), (side(0), side(0)), (side(5000), side(300, (), True))]
    df = spark.createDataFrame(rows, f"rendered {kind}, raw {kind}").select(I.crawler_view(F.col("rendered"), F.col("raw")).alias("v")).select("v.*")
    assert [r["status"] for r in df.collect()] == ["ok", "js-only", "partial", "ok", "ok", "auth-wall"]
    assert df.head()["missingHeadings"] == ["B"]


def test_header_merges(spark, results):
    row = results.where("page_id = 1").withColumn("x_robots_tag", F.lit("googlebot: noindex, max-snippet: 9"))
    merged = I.with_header(row).select("robotsMeta.*").head()
    assert merged["hasNoIndex"] and merged["maxSnippet"] == 9 and merged["headerContent"] == "googlebot: noindex, max-snippet: 9"
    assert robots is not None


# -- runs --


def snapshot(spark, run_id, rows):
    """rows: path, score, findings, checks; a score of None is a failed page."""
    meta = {k: (p, o, e) for k, p, o, e in config.FINDINGS}
    made = []
    for path, score, findings, checks in rows:
        own = [(k, f"finding:{k}:{path}", meta[k][1], meta[k][2], meta[k][0], k) for k in findings]
        ok = score is not None
        made.append((run_id, f"https://example.ch{path}", path, "ok" if ok else "error", None if ok else "timeout", None, score, "other", None, checks if ok else None, own if ok else None, len(made)))
    return spark.createDataFrame(made, D.SNAPSHOT_PAGES)


@pytest.fixture(scope="module")
def two_runs(spark):
    before = snapshot(spark, "r1", [("/", 10.0, ["no_h1", "no_date"], {"h1": False, "date": False}), ("/a", 12.0, [], {"h1": True}), ("/old", 8.0, ["no_h1"], {}), ("/f", 5.0, [], {})])
    after = snapshot(spark, "r2", [("/", 14.0, ["no_date"], {"h1": True, "date": False}), ("/a", 11.0, ["no_lists"], {"h1": False, "lists": False}), ("/new", 20.0, ["no_lists"], {}), ("/f", None, [], {})])
    return before, after


def test_diff(two_runs):
    pairs = D.matched(*two_runs)
    assert [r["path"] for r in D.pages_added(pairs).collect()] == ["/new"] and [r["path"] for r in D.pages_removed(pairs).collect()] == ["/old"]
    assert [tuple(r) for r in D.pages_failed(pairs).collect()] == [("/f", None, "timeout")]
    assert [tuple(r) for r in in_order(D.page_changes(pairs), "page_changes").collect()] == [("/a", 12.0, 11.0, -1.0, [], ["h1"], [], ["no_lists"]), ("/", 10.0, 14.0, 4.0, ["h1"], [], ["no_h1"], [])]
    assert [(r["key"], r["before"], r["after"], r["fixed_on"], r["new_on"]) for r in in_order(D.finding_changes(pairs), "finding_changes").collect()] == [("no_lists", 0, 1, [], ["/a"]), ("no_date", 1, 1, [], []), ("no_h1", 1, 0, ["/"], [])]
    totals = D.diff_totals(pairs).head()
    assert (totals["pages"], totals["before"], totals["after"], totals["delta"]) == (2, 11.0, 12.5, 1.5)
    assert (totals["fixed"], totals["new"], totals["pages_up"], totals["pages_down"], totals["regression"]) == (1, 1, 1, 1, True)
    assert [r[0] for r in D.new_criteria(*two_runs).collect()] == ["lists"]


def test_diff_with_itself_and_mirrored(two_runs):
    before, after = two_runs
    assert not D.has_regression(D.matched(before, before))
    same = D.diff_totals(D.matched(after, after)).head()
    assert (same["fixed"], same["new"], same["pages_up"], same["delta"]) == (0, 0, 0, 0.0)
    there, back = (D.diff_totals(D.matched(*x)).head() for x in ((before, after), (after, before)))
    assert (there["fixed"], there["new"], there["pages_up"]) == (back["new"], back["fixed"], back["pages_down"]) and there["delta"] == -back["delta"]


def test_totals_and_gate(two_runs):
    before, after = two_runs
    assert tuple(D.run_totals(after, "run_id").head()) == ("r2", 4, 3, 15.0)
    assert D.gate(after, 15.0) and not D.gate(after, 15.1) and not D.gate(after.where("status = 'error'"), 0)


def test_last_of_repeated_pages_and_long_lists(spark):
    twice = snapshot(spark, "r1", [("/", 10.0, ["no_h1"], {}), ("/a", 1.0, [], {}), ("/", 14.0, [], {})])
    for rows in (twice, twice.orderBy("total_score", ascending=False), twice.drop("position")):
        assert {r["path"]: r["total_score"] for r in D.last_by_path(rows).collect()} == {"/": 14.0, "/a": 1.0} or "position" not in rows.columns
    many = snapshot(spark, "r2", [(f"/{i:03}", 1.0, ["no_h1"], {}) for i in range(60)])
    row = D.plan_tickets(many, "https://example.ch").head()
    assert row["page_count"] == 60 and row["pages"] == [f"/{i:03}" for i in range(25)] and "- +35" in row["body"]
    gone = D.finding_changes(D.matched(many, snapshot(spark, "r3", [(f"/{i:03}", 1.0, [], {}) for i in range(60)]))).head()
    assert (gone["before"], gone["after"], gone["fixed"], gone["new"], len(gone["fixed_on"])) == (60, 0, 60, 0, 25)


def test_a_side_file_is_one_row(spark):
    files = spark.createDataFrame([("https://a.ch", "/robots.txt", 500, "zz"), ("https://a.ch", "/robots.txt", 200, "a longer body"), ("https://b.ch", "/other.txt", 200, "x")], "origin string, path string, status int, body string")
    got = {r["origin"]: (r["robots_status"], r["robots_body"], r["llms_body"]) for r in I.side_files(files).collect()}
    assert got == {"https://a.ch": (200, "a longer body", None), "https://b.ch": (None, None, None)}


def test_tickets(two_runs):
    before, after = two_runs
    rows = [(r["key"], r["state"], r["pages"], r["level"], r["marker"]) for r in in_order(D.plan_tickets(after, "https://example.ch", before), "tickets").collect()]
    assert rows == [("no_lists", "open", ["/a", "/new"], "medium", "finding:example.ch:no_lists"), ("no_date", "open", ["/"], "medium", "finding:example.ch:no_date"), ("no_h1", "resolved", [], "high", "finding:example.ch:no_h1")]
    assert [r["key"] for r in D.plan_tickets(after, "https://example.ch", owner="dev").collect()] == []
    assert [r["key"] for r in D.plan_tickets(before, "https://example.ch", min_priority=8).collect()] == ["no_h1"]
    assert "- https://example.ch/a" in in_order(D.plan_tickets(after, "https://example.ch"), "tickets").head()["body"]


def test_snapshots_round_trip(spark, results, tmp_path):
    pages = D.snapshot_pages(results, "r1")
    header = D.snapshot_header(spark, "r1", "2024-07-01 00:00:00", "https://www.example.ch")
    D.write_snapshot(pages, header, str(tmp_path))
    D.write_snapshot(D.snapshot_pages(results, "r2"), header.withColumns({"run_id": F.lit("r2"), "format": F.lit("other/1")}), str(tmp_path))
    runs, back = D.read_snapshots(spark, str(tmp_path))
    assert runs.count() == 1 and back.count() == 4 and {r["run_id"] for r in back.collect()} == {"r1"}
    row = back.where("path = '/ratgeber/waermepumpe'").head()
    assert row["total_score"] == results.where("page_id = 1").head()["totalScore"] and row["findings"][0]["fingerprint"].startswith("finding:")
    D.write_snapshot_json(header, pages, f"{tmp_path}/json")
    document = "\n".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/json/run_id=r1/*.txt")))
    assert [p["path"] for p in json.loads(document)["pages"]] == sorted(r["path"] for r in pages.select("path").collect()) and json.loads(document)["summary"]["pages"] == 4
    empty = "".join(r["value"] for r in D.snapshot_json(header, pages.limit(0)).orderBy("place").collect())
    assert json.loads(empty)["pages"] == [] and json.loads(empty)["summary"]["pages"] == 0
    text = spark.createDataFrame([(document,), ('{"format": "x"}',)], "value string")
    parsed = D.parse_snapshot_json(text).collect()
    assert len(parsed) == 1 and len(parsed[0]["pages"]) == 4
    assert D.findings_json(pages).count() == sum(len(r["findings"]) for r in results.collect())
    names = [r[0] for r in pages.orderBy("path").select(D.page_report_name(F.col("path"))).collect()]
    assert len(set(names)) == 4 and all(n.endswith(".html") for n in names)


# -- histories --


def test_history(spark):
    rows = [("https://a.ch/x", f"2024-01-0{d}", float(s), {"h1": s > 11}) for d, s in ((1, 10), (2, 12.5), (3, 12.5), (4, 9))] + [("https://www.a.ch/y", "2024-01-01", 5.0, {})]
    df = spark.createDataFrame(rows, "url_norm string, ts string, total_score double, checks map<string,boolean>").withColumn("ts", F.to_timestamp("ts"))
    got = [(r["delta"], r["direction"], r["fixed"], r["regressed"]) for r in H.trend(df).where("url_norm = 'https://a.ch/x'").orderBy("ts").collect()]
    assert got == [(None, None, None, None), (2.5, "up", ["h1"], []), (0.0, "flat", [], []), (3.5, "down", [], ["h1"])]
    assert [r["total_score"] for r in H.newest(df, kept=2).where("url_norm = 'https://a.ch/x'").orderBy("position").collect()] == [9.0, 12.5]
    assert [(r["last_score"], r["delta"], r["analysis_count"]) for r in H.overview(df, "a.ch").collect()] == [(9.0, -3.5, 4)]
    assert [r["url_norm"] for r in in_order(H.overview(df), "overview").collect()] == ["https://www.a.ch/y", "https://a.ch/x"]
    assert H.daily_once(df.union(df)).count() == 5


def test_previous_runs(spark):
    runs = spark.createDataFrame([(f"r{i}", "o", datetime(2024, 1, i)) for i in range(1, 6)], "run_id string, origin string, created_at timestamp")
    rows = [("r1", "/a", 1.0), ("r1", "/b", 1.0), ("r2", "/a", 2.0), ("r3", "/a", None), ("r3", "/b", 3.0), ("r4", "/a", 4.0), ("r4", "/b", 4.0), ("r5", "/c", 5.0)]
    pages = spark.createDataFrame([(r, p, s, "error" if s is None else "ok", {}) for r, p, s in rows], "run_id string, path string, total_score double, status string, checks map<string,boolean>")
    got = {(r["run_id"], r["path"]): (r["previous_run"], r["delta"], r["direction"]) for r in H.previous_page_run(pages, runs).collect()}
    assert got["r4", "/a"] == ("r2", 2.0, "up") and got["r3", "/b"] == ("r1", 2.0, "up") and got["r1", "/a"] == (None, None, None) and ("r3", "/a") not in got
    assert {r["run_id"]: r["previous_run"] for r in H.previous_run(pages, runs).collect()} == {"r1": None, "r2": "r1", "r3": "r1", "r4": "r3", "r5": None}
    assert H.earlier_runs(runs).count() == 10
    done = spark.createDataFrame([("r1", "r2"), ("r1", "r3"), ("r2", "r3"), ("r1", "r4")], "before string, after string")
    assert {(r["before"], r["after"]) for r in H.earlier_runs(runs, done).collect()} == {("r2", "r4"), ("r3", "r4"), ("r1", "r5"), ("r2", "r5"), ("r3", "r5"), ("r4", "r5")}
    assert H.missing_reports(pages, pages.where("run_id < 'r3'")).count() == 5
    points = in_order(H.run_points(runs.withColumn("label", F.lit(None).cast("string")), D.run_totals(pages, "run_id"), "r4"), "runs").collect()
    assert [p["run_id"] for p in points if p["current"]] == ["r4"] and [p["average_score"] for p in points] == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_cache(spark, results):
    rows = results.select("url", H.content_hash(results).alias("content_hash")).withColumnRenamed("url", "url_norm")
    cache = rows.where("url_norm != 'not a url'").withColumn("version", F.lit("1"))
    assert [r["url_norm"] for r in H.stale(rows, cache, "1").collect()] == ["not a url"]
    assert H.stale(rows, cache, "2").count() == 4 and H.pruned_cache(cache, "2").count() == 0


# -- sources and streams --


def test_sources(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# list\nexample.ch/a\n\n  https://example.ch/b \nexample.ch/a\nnot a url at all\n")
    listed = P.url_list(spark, str(tmp_path / "urls.txt"))
    assert [r["url"] for r in in_order(P.first_of_each(listed.where("url IS NOT NULL")), "inputs").collect()] == ["https://example.ch/a", "https://example.ch/b"]
    named = spark.createDataFrame([("https://example.ch/b", 7), ("chrome://settings", 8), (None, 9)], "url string, position int")
    assert [r["url"] for r in in_order(P.all_inputs(named, listed, named), "inputs").collect()] == ["https://example.ch/b", "https://example.ch/a"]
    listed.write.parquet(f"{tmp_path}/entries")
    assert P.stored_entries(spark, f"{tmp_path}/entries").count() == listed.count()
    (tmp_path / "site").mkdir()
    (tmp_path / "site" / "p.html").write_text(ARTICLE)
    files = P.html_files(spark, str(tmp_path / "site"), "https://example.ch/")
    assert files.head()["url"] == "https://example.ch/p.html" and page_data(files).head()["lang"] == "de"


def test_streams(spark, pages, tmp_path):
    for i in (1, 2):
        pages.where(F.col("page_id") == i).write.mode("append").parquet(f"{tmp_path}/in")
    seen = {}
    query = stream.analyze_stream(stream.page_stream(spark, f"{tmp_path}/in", 1), lambda df, n: seen.update({r["page_id"]: r["totalScore"] for r in df.select("page_id", "totalScore").collect()}), f"{tmp_path}/check", NOW)
    query.awaitTermination(120)
    assert set(seen) == {1, 2} and seen[1] > seen[2]


def test_history_stream(spark, tmp_path):
    kind = "url_norm string, ts timestamp, total_score double"
    for day, rows in enumerate(([("a", 10.0), ("b", 1.0)], [("a", 12.5)], [("a", 9.0)]), 1):  # a late entry follows below
        spark.createDataFrame([(u, datetime(2024, 1, day), s) for u, s in rows], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    entries = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = stream.history_stream(entries).writeStream.format("memory").queryName("trends").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r["delta"], r["direction"], r["analysis_count"]) for r in spark.sql("SELECT * FROM trends WHERE url_norm = 'a' ORDER BY ts").collect()]
    assert got == [(None, None, 1), (2.5, "up", 2), (3.5, "down", 3)]
    daily = stream.daily_stream(spark.readStream.schema(kind).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/check2").trigger(availableNow=True).start()
    daily.awaitTermination(120)
    # the last two days are still open: the watermark is a day behind
    assert sorted((r["url_norm"], r["total_score"]) for r in spark.sql("SELECT * FROM daily").collect()) == [("a", 10.0), ("b", 1.0)]
