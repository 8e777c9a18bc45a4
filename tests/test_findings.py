"""Cases that a review found slow on larger tables: what was computed too often, for nothing, or in one task."""

import random

from pyspark.sql import functions as F

from pagestrata import config
from pagestrata.functions import readability, text
from pagestrata.html.udf import dealt_out, page_data
from pagestrata.operators import scoring

URL = "https://www.example.ch/a"
HTML = '<html lang="de"><head><title>Titel</title></head><body><article><h1>Ein Titel</h1><p>Ding ist ein Gerät, und so geht der Text noch eine ganze Weile weiter.</p><h2>Was ist das?</h2><p>Im Jahr 1 stieg der Anteil um 7 % und so weiter und so weiter.</p><ul><li>eins<li>zwei</ul><a href="https://quelle.org/a">Studie</a></article></body></html>'


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def pages(spark):
    return spark.createDataFrame([(1, URL, HTML), (2, URL, None)], "page_id bigint, url string, html string")


def test_large_stored_pages_are_dealt_out(spark, tmp_path):
    draw = random.Random(1)
    rows = [(i, URL, "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=5000))) for i in range(100)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    parts = dealt_out(stored, 10_000).rdd.glom().map(len).collect()
    assert len(parts) >= 20 and max(parts) <= 20 and sum(parts) == 100


def test_only_asked_fields_are_made(spark):
    fields = ("headings", "links", "faqQuestions")
    whole = page_data(pages(spark), 2025).orderBy("page_id").collect()
    some = page_data(pages(spark), 2025, fields).orderBy("page_id").collect()
    assert [set(r.asDict()) for r in some] == [set(r.asDict()) for r in whole]
    for a, b in zip(some, whole):
        assert all(a[n] == b[n] if n in ("page_id", "url", *fields) else a[n] is None for n in a.asDict())


def test_only_named_criteria_are_computed(spark):
    records = page_data(pages(spark), 2025)
    now = F.lit("2024-07-01").cast("timestamp")
    names = ("h1", "title_quality", "author")
    some = scoring.some_criteria(records, ("page_id",), names, now)
    shown = ["page_id", "criterion", "points", "weight", "found", "met", "value", "applicable"]
    whole = scoring.criteria_table(scoring.analyze(records, now, evidence=False), "page_id").where(F.col("criterion").isin(*names))
    assert sorted(some.select(shown).collect()) == sorted(whole.select(shown).collect())
    assert not any(p in plan(some) for p in (*config.FACTS, *config.DEFINITIONS, readability.WORD))


def test_hosts_that_are_no_sources(spark):
    hosts = {"facebook.com": 0, "m.facebook.com": 0, "www.t.me": 0, "notfacebook.com": 1, "facebook.com.org": 1, "mastodon.example": 0, "my.mastodon.example": 1, "tXme": 1}
    rows = [(h, f"https://{h}/x", "text", True, False) for h in hosts]
    link = F.struct("href", "text", "isExternal", "isNavigational")
    df = spark.createDataFrame(rows, "host string, href string, text string, isExternal boolean, isNavigational boolean").repartition(1)
    made = df.select("host", text.is_source_link(link).cast("int").alias("ok"))
    assert dict(made.collect()) == hosts
    assert plan(made).count("regexp_extract") + plan(made).count("regexp_replace") < 10


def test_text_is_counted_once(spark):
    df = spark.createDataFrame([("The tree makes a reliable table here.", True)], "t string, en boolean").repartition(1)
    assert plan(df.select(readability.rated(F.col("t"), F.col("en")).alias("r"))).count(readability.WORD) == 1
