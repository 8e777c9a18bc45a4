"""The 34 criteria as column expressions over a page record.

A criterion is a struct: criterion, category, points (score times weight), weight, found, value, current
and target of its progress, fix, evidence. A criterion that doesn't apply has weight 0 and found true;
one whose input is missing is null and is left out. Each category function returns its criteria and its
findings, in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from ..functions import dates as D
from ..functions import readability as R
from ..functions import text as X
from ..functions import urls as U
from ..functions.numbers import clamp, half_up, part, size
from ..functions.steps import bind

Evidence = list[tuple[Column | None, str, dict[str, Column]]]


_WANTED = ContextVar("evidence", default=True)


@contextmanager
def evidence_wanted(wanted: bool) -> Iterator[None]:
    """Whether the criteria built inside tell what they rest on; if not, their evidence is empty."""
    token = _WANTED.set(wanted)
    try:
        yield
    finally:
        _WANTED.reset(token)


_MADE: ContextVar[list[tuple[str, Column]] | None] = ContextVar("made", default=None)


@contextmanager
def made_inside() -> Iterator[list[tuple[str, Column]]]:
    """The criteria built inside, each with its name."""
    token = _MADE.set(made := [])
    try:
        yield made
    finally:
        _MADE.reset(token)


def evidence_of(lines: Evidence) -> Column:
    """Lines whose condition holds: key and parameters."""
    if not _WANTED.get():
        lines = []
    made = []
    for condition, key, params in lines:
        values = F.create_map(*(x for k, v in params.items() for x in (F.lit(k), v.cast("string")))) if params else F.create_map().cast("map<string,string>")
        line = F.struct(F.lit(key).alias("key"), values.alias("params"))
        made.append(line if condition is None else F.when(condition, line))
    kind = "array<struct<key: string, params: map<string, string>>>"
    return F.array_compact(F.array(*made)).cast(kind) if made else F.array().cast(kind)


def criterion(
    category: str,
    name: str,
    score: Column,
    found: Column,
    value: Column,
    current: Column,
    target: Column,
    *,
    points: Column | None = None,
    applies: Column | None = None,
    present: Column | None = None,
    fix: Column | None = None,
    evidence: Evidence = (),
) -> Column:
    weight = config.WEIGHTS[name]
    own = F.struct(
        F.lit(name).alias("criterion"), F.lit(category).alias("category"), (score * F.lit(weight) if points is None else points).cast("double").alias("points"), F.lit(weight).alias("weight"),
        found.alias("found"), value.cast("string").alias("value"), current.cast("double").alias("current"), target.cast("double").alias("target"),
        F.coalesce(fix if fix is not None else F.lit(None).cast("string"), F.lit(name)).alias("fix"), evidence_of(list(evidence)).alias("evidence"),
    )
    if applies is not None:
        idle = F.struct(
            F.lit(name).alias("criterion"), F.lit(category).alias("category"), F.lit(0.0).alias("points"), F.lit(0.0).alias("weight"),
            F.lit(True).alias("found"), F.lit("notApplicable").alias("value"), F.lit(1.0).alias("current"), F.lit(1.0).alias("target"),
            F.lit(name).alias("fix"), evidence_of([]).alias("evidence"),
        )
        own = F.when(applies, own).otherwise(idle)
    own = own if present is None else F.when(present, own)
    if (made := _MADE.get()) is not None:
        made.append((name, own))
    return own


def percent(score: Column) -> Column:
    return half_up(score * F.lit(100.0))


def shown(score: Column) -> Column:
    return F.concat(percent(score).cast("string"), F.lit("%"))




class Steps:
    """Measures that several expressions use, each computed once: named columns, in layers that build on each other."""

    def __init__(self) -> None:
        self.layers: list[dict[str, Column]] = [{}]

    def __call__(self, name: str, value: Column) -> Column:
        self.layers[-1][f"_m_{name}"] = value
        return F.col(f"_m_{name}")

    def then(self) -> None:
        self.layers.append({})


def page_type() -> Column:
    """Structured data decides first, then the path, then the Open Graph type."""
    types, code = F.col("schemaTypes"), rf"(?:{config.LANGUAGE_CODES})(?:[-_][a-z]{{2,4}})?"
    p = U.without_slash(U.path(F.col("url")))
    home = (p == "/") | p.rlike(rf"(?i)^(?:/{code})?(?:/(?:index|home|start)\.(?:html?|php))?$|^/{code}\.html?$|^/[a-z0-9-]+/{code}/(?:index|home|start)\.html?$")
    og = F.lower(F.coalesce(F.nullif(F.col("openGraph.type"), F.lit("")), F.col("meta.ogType"), F.lit("")))
    article = F.arrays_overlap(types, F.array(*map(F.lit, config.ARTICLE_TYPES)))
    return (
        F.when(F.array_contains(types, "Product"), "product").when(article, "article").when(home, "homepage").when(og == "article", "article").when(og.startswith("product"), "product").otherwise("other")
    )


def count_where(array: Column, test: Callable[[Column], Column]) -> Column:
    return size(F.filter(array, test))


def content_clarity(let: Steps) -> tuple[list[Column], list[tuple[str, Column]]]:
    cat, headings, paragraphs, lists = "contentClarity", F.col("headings"), F.col("paragraphs"), F.col("lists")
    h1s = F.filter(headings, lambda h: h["level"] == 1)
    n1, length = let("h1_count", size(h1s)), let("h1_length", F.char_length(F.get(h1s, 0)["text"]))
    levels = F.transform(headings, lambda h: h["level"])
    skips = let("skips", size(F.filter(F.zip_with(F.slice(levels, 2, F.greatest(size(levels), F.lit(1))), F.slice(levels, 1, F.greatest(size(levels) - 1, F.lit(0))), lambda b, a: b - a), lambda d: d > 1)))
    subs, late = let("subheadings", count_where(headings, lambda h: h["level"].between(2, 3))), let("late_h1", F.array_position(levels, 1) > 3)
    solid = let("solid", F.filter(paragraphs, lambda p: F.char_length(p) >= 80))
    let.then()
    good = F.coalesce((n1 == 1) & length.between(5, 150), F.lit(False))
    half = F.when(good, 1.0).when(n1 > 0, 0.5).otherwise(0.0)

    k = config.HIERARCHY
    penalty = part(n1 == 0, k["no_h1"]) + part(n1 > 1, k["several_h1"]) + part(late, k["late_h1"])
    penalty = F.aggregate(F.sequence(F.lit(0), skips), penalty, lambda acc, i: acc + F.when(i > 0, F.lit(k["skip"])).otherwise(0.0)) + part(subs < 2, k["few_subheadings"])
    penalty = let("penalty", penalty)
    n = let("solid_count", size(solid))
    mean = let("solid_mean", F.aggregate(solid, F.lit(0), lambda a, p: a + F.char_length(p)) / F.nullif(size(solid), F.lit(0)))
    let.then()
    outline = F.lit(1.0) - penalty + part((penalty == 0) & (subs >= 4), k["bonus"])
    outline = let("outline", F.when(size(headings) == 0, 0.0).otherwise(clamp(F.when(n1 == 0, F.least(outline, F.lit(k["cap"]))).otherwise(outline))))
    blocks = n + size(lists)
    ratio = subs / F.nullif(blocks, F.lit(0))
    scan = F.when(n >= 3, 0.3).when(n >= 1, 0.075).otherwise(0.0)
    scan += F.when(n == 0, 0.0).when(mean < 300, 0.25).when(mean < 500, 0.15).when(mean < 800, 0.05).otherwise(0.0)
    scan += F.when(size(lists) >= 2, 0.25).when(size(lists) >= 1, 0.15).otherwise(0.0)
    scan += F.when(blocks == 0, 0.0).when(ratio.between(0.2, 1.0), 0.2).when(ratio.between(0.1, 2.0), 0.1).otherwise(0.0)
    scan = let("scan", F.least(F.lit(1.0), scan))

    read = F.col("readability")
    # of equal ones the first
    longest = F.get(F.array_sort(F.transform(solid, lambda p, i: F.struct((-F.char_length(p)).alias("rank"), i.alias("at"), p.alias("text")))), 0)
    english = read["formula"] == "flesch"
    rated = F.transform(solid, lambda p, i: F.struct(R.block_readability(p, english)["raw"].alias("raw"), i.alias("at"), p.alias("text")))
    hardest = F.get(F.array_sort(F.transform(F.filter(rated, lambda r: r["raw"].isNotNull()), lambda r: F.struct(F.when(english, r["raw"]).otherwise(-r["raw"]).alias("rank"), r["at"].alias("at"), r["raw"].alias("raw"), r["text"].alias("text")))), 0)
    rows = [
        criterion(
            cat, "h1", half, good, F.when(n1 == 0, "notPresent").when(good, "present").otherwise("h1Optimal"), half, F.lit(1),
            fix=F.when(n1 > 1, "h1_multiple").when((n1 == 1) & ~good, "h1_length"),
            evidence=[(n1 == 0, "h1_none", {}), (n1 > 1, "h1_multiple", {"count": n1}), ((n1 == 1) & (length < 5), "h1_too_short", {"length": length}), ((n1 == 1) & (length > 150), "h1_too_long", {"length": length}), (good, "h1_ok", {"length": length})],
        ),
        criterion(
            cat, "hierarchy", outline, outline > 0.6, shown(outline), percent(outline), F.lit(100),
            fix=F.when(size(headings) == 0, "hierarchy_none").when(n1 == 0, "hierarchy_no_h1"),
            evidence=[(size(headings) == 0, "hierarchy_none", {}), (size(headings) > 0, "hierarchy_outline", {"headings": size(headings)}), (n1 == 0, "hierarchy_no_h1", {}), (n1 > 1, "hierarchy_multiple_h1", {"count": n1}), (late, "hierarchy_late_h1", {}), (skips > 0, "hierarchy_skips", {"count": skips}), (subs < 2, "hierarchy_few_subheadings", {"count": subs}), (penalty == 0, "hierarchy_ok", {})],
        ),
        criterion(
            cat, "scannable", scan, scan > 0.5, shown(scan), percent(scan), F.lit(100),
            fix=F.when(F.col("faqAnswersHidden") > 0, "scannable_hidden"),
            evidence=[(n == 0, "scannable_no_paragraphs", {}), (n > 0, "scannable_paragraphs", {"count": n, "average": half_up(mean)}), ((n > 1) & (-longest["rank"] >= 300), "scannable_longest", {"length": -longest["rank"], "text": X.clip_at_word(longest["text"]), "count": count_where(solid, lambda p: F.char_length(p) > 300)}), (size(lists) > 0, "scannable_lists", {"count": size(lists)}), (size(lists) == 0, "scannable_no_lists", {}), ((blocks > 0) & (ratio > 1), "scannable_headings_too_many", {}), ((blocks > 0) & (ratio < 0.2), "scannable_headings_too_few", {}), ((blocks > 0) & ratio.between(0.2, 1.0), "scannable_headings_ok", {})],
        ),
        criterion(
            cat, "readability", read["score"], read["score"] >= 0.5, F.concat(half_up(read["raw"]).cast("string"), F.when(read["formula"] == "lix", " LIX").otherwise(" Flesch")), percent(read["score"]), F.lit(100),
            present=read.isNotNull(),
            evidence=[(read["formula"] == "flesch", "readability_formula_flesch", {}), (read["formula"] == "lix", "readability_formula_lix", {"band": R.band(read["raw"], read["formula"])}), (hardest.isNotNull(), "readability_hardest", {"value": half_up(hardest["raw"]), "text": X.clip_at_word(hardest["text"])})],
        ),
    ]
    return rows, [("no_h1", ~good), ("bad_hierarchy", ~(outline > 0.6)), ("low_scanability", ~(scan > 0.5)), ("low_readability", read["score"] < 0.5)]


def answerability(let: Steps) -> tuple[list[Column], list[tuple[str, Column]]]:
    cat, paragraphs, pairs = "answerability", F.col("paragraphs"), F.col("questionAnswers")
    home = F.col("pageType") == "homepage"
    defining = let("defining", F.filter(paragraphs, lambda p: X.definition(p).isNotNull()))
    first = lambda qa: F.get(X.sentences(qa["answer"]), 0)
    answered = let("answered", F.filter(F.coalesce(pairs, F.array()), lambda qa: bind(first(qa), lambda s: F.coalesce(~s.endswith("?") & (size(X.words(s)) >= 4), F.lit(False)))))
    steps = let("steps", count_where(paragraphs, X.is_structured))
    tables = let("headed_tables", count_where(F.col("tables"), lambda t: t["hasHeader"]))
    subs = let("sections", count_where(F.col("headings"), lambda h: h["level"] >= 2))
    let.then()
    example = let("definition_example", X.definition(F.get(defining, 0)))
    counted = let("counted", size(defining) + count_where(answered, lambda qa: ~F.exists(defining, lambda p: qa["answer"].startswith(p))))
    let.then()
    score = F.least(F.lit(1.0), counted / F.lit(3.0)) * 0.7 + F.least(F.lit(1.0), steps / F.lit(2.0)) * 0.3
    score = let("definitions", score)
    n = size(F.col("lists")) + tables
    body = size(paragraphs) >= 3
    sections = F.least(F.lit(1.0), subs / F.lit(3.0)) * F.when(body, 1.0).otherwise(0.5)
    hidden = F.col("faqAnswersHidden") > 0
    rows = [
        criterion(
            cat, "definitions", score, score > 0.3, shown(score), percent(score), F.lit(100), applies=~home,
            fix=F.when(hidden, "definitions_hidden").when((counted >= 3) & (steps < 2), "definitions_structured"),
            evidence=[(size(defining) > 0, "definitions_sentences", {"count": size(defining), "example": example}), (size(defining) == 0, "definitions_sentences_none", {}), (size(pairs) == 0, "definitions_no_questions", {}), (size(pairs) > 0, "definitions_answers", {"questions": size(pairs), "answered": size(answered)}), (None, "definitions_total", {"count": counted, "target": F.lit(3)}), (None, "definitions_structured", {"count": steps})],
        ),
        criterion(
            cat, "lists", F.least(F.lit(1.0), n / F.lit(3.0)), n >= 1, F.lit("lists"), F.least(n, F.lit(3)), F.lit(3),
            evidence=[(size(F.col("lists")) == 0, "lists_none", {}), (size(F.col("lists")) > 0, "lists_found", {"count": size(F.col("lists"))}), (tables > 0, "tables_found", {"count": tables}), (size(F.col("tables")) > tables, "tables_no_header", {"count": size(F.col("tables")) - tables})],
        ),
        criterion(
            cat, "sections", sections, (subs >= 3) & body, F.lit("subheadings"), F.least(subs, F.lit(3)), F.lit(3),
            fix=F.when(hidden, "sections_hidden").when(subs >= 3, "sections_thin"),
            evidence=[(subs > 0, "sections_count", {"count": subs}), (subs == 0, "sections_none", {}), (body, "sections_paragraphs_ok", {"count": size(paragraphs)}), (~body & (subs > 0), "sections_thin_half", {"count": size(paragraphs)}), (~body & (subs == 0), "sections_thin", {"count": size(paragraphs)})],
        ),
    ]
    return rows, [("no_definitions", ~home & ~(score > 0.3)), ("no_lists", n < 1), ("few_sections", ~((subs >= 3) & body))]


def publisher_name() -> Column:
    return F.coalesce(F.col("identity.org_name"), F.when(F.col("author.source") == "publisher", F.col("author.name")))


def trust_sources(let: Steps, as_of: Column) -> tuple[list[Column], list[tuple[str, Column]]]:
    cat, skip = "trustSources", F.col("pageType").isin("homepage", "product")
    author, all_dates = F.col("author"), let("dates", F.filter(F.col("dates"), lambda d: d["date"] <= as_of + F.expr("INTERVAL 1 DAY")))
    links = F.col("links")

    def names(text: str, path: str) -> Column:
        """Whether a link of the site has such a label or path."""
        return F.exists(links, lambda x: ~x["isExternal"] & (((F.char_length(x["text"]) <= 40) & x["text"].rlike(text)) | F.coalesce(F.try_url_decode(U.path(x["href"])), F.lit("")).rlike(path)))

    kinds = {k: let(f"link_{k}", names(*patterns)) for k, patterns in config.PUBLISHER_LINKS.items()}
    let.then()
    known = let("dated", size(all_dates) > 0)
    recent = let("recent", F.exists(all_dates, lambda d: D.within_last_year(d["date"], as_of)))
    newest = let("newest", F.array_max(F.transform(all_dates, lambda d: d["date"])))
    seen = let("seen_dates", F.filter(all_dates, lambda d: d["source"].isin("time-element", "text")))
    let.then()
    first_newest = F.get(F.filter(all_dates, lambda d: d["date"] == newest), 0)
    visible = let("visible_date", ~known | F.exists(seen, lambda d: D.iso_day(d["date"]) == D.iso_day(newest)))
    modified = F.exists(F.col("schemaDates"), lambda s: (s["kind"] == "dateModified") & (s["date"] == newest)) | F.coalesce(F.try_to_timestamp(F.col("meta.modifiedDate")) == newest, F.lit(False))
    published = F.exists(F.col("schemaDates"), lambda s: (s["kind"] == "datePublished") & (s["date"] == newest)) | F.coalesce(F.try_to_timestamp(F.col("meta.publishDate")) == newest, F.lit(False)) | (first_newest["source"] == "meta")
    kind = let("date_kind", F.when(modified, "modified").when(published, "published").otherwise("visible"))
    days = let("date_age", D.age_days(newest, as_of))
    let.then()
    share = F.when(visible, 1.0).otherwise(0.7)
    # an older date earns points outright, not a share of the weight
    date_points = F.when(recent, share * config.WEIGHTS["date"]).when(known, share * 0.75).otherwise(0.0)

    named = publisher_name().isNotNull()
    n_kinds = sum((k.cast("int") for k in kinds.values()), F.lit(0))
    who = let("publisher", F.least(F.lit(1.0), part(named, config.PUBLISHER["named"]) + part(named & F.col("identity.org_verifiable"), config.PUBLISHER["verifiable"]) + F.lit(config.PUBLISHER["links"]) * F.least(F.lit(1.0), n_kinds / F.lit(2.0))))

    sources = F.col("sourceLinks")
    rows = [
        criterion(
            cat, "author", part(author.isNotNull(), 1.0), author.isNotNull(), F.coalesce(author["name"], F.lit("notRecognizable")), author.isNotNull().cast("int"), F.lit(1), applies=~skip,
            evidence=[(author["source"] == s, f"author_{e}", {"name": author["name"]}) for s, e in (("schema", "schema"), ("meta", "meta"), ("publisher", "publisher"), ("dom", "byline"))] + [(author.isNull(), "author_none", {})],
        ),
        criterion(
            cat, "date", F.lit(0.0), known, F.when(~known, "noDateFound").when(recent, D.iso_day(newest)).otherwise("olderThanYear"), F.when(recent, 1.0).when(known, 0.5).otherwise(0.0), F.lit(1), points=date_points, applies=~skip,
            fix=F.when(~known, "date").when(~recent | visible, "date_old").otherwise("date_visible"),
            evidence=[(~known, "date_none", {})] + [(known & (kind == k), f"date_newest_{k}", {"date": D.iso_day(newest)}) for k in ("modified", "published", "visible")] + [(known & (D.age_bucket(days) == b), f"date_age_{b}", {"days": days}) for b in ("today", "days", "months", "years")] + [(known & ~recent, "date_stale", {}), (known & (kind == "published"), "date_no_modified", {}), (known & ~visible & (size(seen) > 0), "date_invisible_older", {"date": D.iso_day(newest)}), (known & ~visible & (size(seen) == 0), "date_invisible", {"date": D.iso_day(newest)})],
        ),
        criterion(
            cat, "publisher", who, who >= 0.99, F.when(who >= 0.99, "present").when(who > 0, "publisher_partial").otherwise("notPresent"), percent(who), F.lit(100), present=skip,
            evidence=[(named, "publisher_schema", {"name": publisher_name()}), (named & F.col("identity.org_verifiable"), "publisher_verifiable", {}), (named & ~F.col("identity.org_verifiable"), "publisher_unverifiable", {}), (~named & F.col("identity.org_unnamed"), "publisher_schema_unnamed", {}), (~named & ~F.col("identity.org_unnamed"), "publisher_schema_none", {})] + [(c if ok else ~c, f"publisher_{k}_{'ok' if ok else 'missing'}", {}) for k, c in kinds.items() for ok in (True, False)],
        ),
        criterion(
            cat, "sources", F.lit(0.0), sources >= 2, F.lit("sourceLinks"), F.least(sources, F.lit(2)), F.lit(2), points=F.when(sources >= 2, config.WEIGHTS["sources"]).when(sources > 0, 0.5).otherwise(0.0), applies=~skip,
            evidence=[(sources > 0, "sources_found", {"count": sources}), (sources == 0, "sources_none", {})],
        ),
    ]
    found = [("no_author", ~skip & author.isNull()), ("no_date", ~skip & ~known), ("date_not_visible", ~skip & known & ~visible), ("few_sources", ~skip & (sources < 2)), ("publisher_unclear", skip & (who < 0.7))]
    return rows, found


def machine_readability(let: Steps) -> tuple[list[Column], list[tuple[str, Column]]]:
    cat, types, kind = "machineReadability", F.col("schemaTypes"), F.col("pageType")
    questions = let("questions", size(X.visible_questions(F.col("faqQuestions"), F.col("headings"))))
    let.then()
    unbacked = let("unbacked_faq", F.array_contains(types, "FAQPage") & (questions == 0))
    let.then()
    relevant = let("relevant_types", F.filter(types, lambda t: t.isin(config.RELEVANT_TYPES) & ~(unbacked & (t == "FAQPage"))))
    let.then()
    no_article = let("no_article", (kind == "article") & ~F.arrays_overlap(relevant, F.array(*map(F.lit, config.ARTICLE_TYPES))))
    no_faq = let("no_faq", (size(F.col("faqQuestions")) >= 3) & ~F.array_contains(relevant, "FAQPage"))
    lacking = no_article | no_faq
    current = F.when(lacking, F.least(size(relevant), F.lit(1))).otherwise(F.least(size(relevant), F.lit(2)))
    has = size(relevant) > 0

    full = F.col("completeness")
    filled = full["found"] / F.nullif(full["total"], F.lit(0))

    who, author = F.col("identity"), F.col("author")
    org, person = publisher_name().isNotNull(), who["person_named"] | F.coalesce(author["source"] != "publisher", F.lit(False))
    k = config.ENTITIES
    entities = let("entities", F.least(F.lit(1.0), part(org, k["org_named"]) + part(who["org_verifiable"], k["org_verifiable"]) + part(person, k["person_named"]) + part(who["person_verifiable"], k["person_verifiable"]) + part(who["linked_graph"], k["linked_graph"]) + part(who["topic"], k["topic"])))

    marks = {n: F.col(f"semanticElements.has{n.capitalize()}") for n in config.SEMANTIC}
    semantic = let("semantic", F.least(F.lit(1.0), sum((part(marks[n], s) for n, s in config.SEMANTIC.items()), F.lit(0.0))))

    inner = F.filter(F.col("links"), lambda x: ~x["isExternal"] & ~x["isNavigational"])
    aimed = let("aimed", F.filter(F.transform(inner, lambda x: F.struct(U.link_target(x["href"], F.col("url")).alias("to"), X.is_descriptive(x["text"]).alias("ok"))), lambda x: x["to"].isNotNull()))
    blocked = let("blocked", F.coalesce(F.col("robotsTxt.blockedBots"), F.array().cast("array<string>")))
    let.then()
    targets = let("targets", size(F.array_distinct(F.transform(aimed, lambda x: x["to"]))))
    telling = let("telling", size(F.array_distinct(F.transform(F.filter(aimed, lambda x: x["ok"]), lambda x: x["to"]))))
    walled = let("walled", F.filter(F.coalesce(F.col("botAccess.blocked"), F.array().cast("array<string>")), lambda b: ~F.array_contains(blocked, b)))
    let.then()
    ratio = let("telling_share", F.when(targets > 0, telling / targets).otherwise(0.0))
    let.then()
    linking = let("linking", F.when(targets > 0, F.least(F.lit(1.0), targets / F.lit(3.0)) * 0.5 + F.least(F.lit(1.0), ratio / F.lit(0.8)) * 0.5).otherwise(0.0))
    linked = (targets >= 3) & (ratio >= 0.8)

    llms = F.coalesce(F.col("llmsTxt.exists"), F.lit(False))
    llms_full = F.coalesce(F.col("llmsTxt.fullExists"), F.lit(False))
    llms_score = F.when(llms, 1.0).when(llms_full, 0.5).otherwise(0.0)

    robots = F.col("robotsTxt")
    weights = F.create_map(*(F.lit(x) for b, p in config.BOTS for x in (b, config.PURPOSE_WEIGHTS[p])))
    weight_of = lambda b: F.coalesce(F.try_element_at(weights, b), F.lit(config.PURPOSE_WEIGHTS["training"]))
    total = lambda bots: F.aggregate(bots, F.lit(0), lambda a, b: a + weight_of(b))
    checked = F.when(size(robots["checkedBots"]) > 0, robots["checkedBots"]).otherwise(F.array(*(F.lit(b) for b, _ in config.BOTS)))
    answers = lambda bots: F.exists(bots, lambda b: weight_of(b) > config.PURPOSE_WEIGHTS["training"])
    signals = F.coalesce(robots["signals"], F.create_map().cast("map<string,string>"))
    opted_out = let("opted_out", F.coalesce(F.try_element_at(signals, F.lit("ai-input")) == "no", F.lit(False)) | F.coalesce(F.try_element_at(signals, F.lit("search")) == "no", F.lit(False)))
    unreachable = F.coalesce(robots["unreachable"], F.lit(False))
    shut, wall = let("answers_shut", unreachable | answers(blocked)), let("answers_walled", answers(walled))
    let.then()
    crawl = F.greatest(F.lit(0.0), F.lit(1.0) - (total(blocked) + total(walled) * F.lit(0.5)) / total(checked)) * F.when(opted_out, config.SIGNAL_OPT_OUT_SHARE).otherwise(1.0)
    n_checked = size(robots["checkedBots"])
    all_blocked = unreachable | ((size(blocked) > 0) & (size(blocked) == n_checked))
    robots_value = F.when(all_blocked, "allBotsBlocked").when(F.coalesce(robots["exists"], F.lit(False)) & (size(blocked) > 0), "someBotsBlocked").when(wall, "botsBlockedByServer").when(opted_out, "botsOptOut").otherwise("allBotsAllowed")

    view = F.col("crawlerView")
    seen = view.isNotNull() & (view["status"] != "auth-wall")
    view_score = F.when(view["status"] == "ok", 1.0).otherwise(view["coverage"])

    p, q = F.col("product"), config.PRODUCT
    product = let(
        "product_score",
        F.when(p.isNull(), 0.0).otherwise(F.least(F.lit(1.0), part(p["price"], q["price"]) + part(p["availability"], q["availability"]) + F.when(p["identifier"], q["identifier"]).when(p["sku"], q["identifier"] / 2).otherwise(0.0) + part(p["brand"], q["brand"]) + part(p["image"], q["image"]) + part(p["description"], q["description"]) + part(p["rating"], q["rating"]) + part(p["shipping"], q["shipping"]))),
    )

    b, local, w = F.col("business"), F.col("local"), config.LOCAL
    digits = F.regexp_replace(F.regexp_replace(b["telephone"], "[^0-9]", ""), "^(?:00)?(41|49|43)", "0")
    code_off = b["postal_code"].isNotNull() & (b["postal_code"] != "") & (size(local["postalCodes"]) > 0) & ~F.array_contains(local["postalCodes"], b["postal_code"])
    phone_off = b["telephone"].isNotNull() & (size(local["phones"]) > 0) & ~F.array_contains(local["phones"], digits)
    off = F.coalesce(code_off, F.lit(False)) | F.coalesce(phone_off, F.lit(False))
    at_place = (size(local["addresses"]) > 0) & local["hasOpeningHours"] & ((kind == "homepage") | F.coalesce(F.try_url_decode(U.path(F.col("url"))).rlike(config.LOCAL_PAGE), F.lit(False)))
    is_local = let("is_local", b.isNotNull() | F.coalesce(at_place, F.lit(False)))
    business = let("business_score", F.when(b.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.lit(w["node"]) + F.lit(w["address"]) * (size(b["address_fields"]) / F.lit(3.0)) + part(b["telephone"].isNotNull(), w["telephone"]) + part(b["hours"], w["hours"]) + part(b["geo"], w["geo"]) + part(~off, w["consistent"]))))

    m, s = F.col("sitemap"), config.SITEMAP
    dated = (m["listed"] == True) & m["pageLastmod"].isNotNull()  # noqa: E712
    sitemap = let(
        "sitemap_score",
        F.when(~m["exists"], 0.0).otherwise(F.lit(s["exists"]) + part(m["declaredInRobots"], s["declared"]) + part(F.coalesce(m["listed"], F.lit(True)), s["listed"]) + F.when(dated & m["lastmodUniform"], s["lastmod"] / 2).when(dated, s["lastmod"]).when(m["listed"].isNull(), s["lastmod"]).otherwise(0.0)),
    )
    rows = [
        criterion(
            cat, "schema", current / F.lit(2.0), has, F.when(~has, "noneFound").when(lacking, "schemaTypesMissing").otherwise("schemaTypes"), current, F.lit(2),
            fix=F.when(no_article, "schema_article").when(no_faq, "schema_faq").when(has & (current < 2), "schema_more"),
            evidence=[(has, "schema_found", {"types": F.array_join(relevant, ", ")}), (~has, "schema_none", {}), (size(types) > size(relevant), "schema_other", {"types": F.array_join(F.array_except(types, relevant), ", ")}), (unbacked, "schema_faq_unbacked", {}), (no_article, "schema_missing_article", {}), (no_faq, "schema_missing_faq", {}), (size(relevant) < 2, "schema_too_few", {"count": size(relevant)})],
        ),
        criterion(
            cat, "schema_completeness", filled, filled >= 0.99, F.when(size(full["gaps"]) > 0, F.array_join(F.transform(full["gaps"], lambda g: F.concat(g["type"], F.lit(": "), F.array_join(g["missing"], ", "))), " · ")).otherwise("complete"), full["found"], full["total"],
            present=full["total"] > 0, fix=F.when(full["unnamed_author"], "schema_completeness_author"),
            evidence=[(None, "schema_completeness_summary", {"found": full["found"], "total": full["total"]}), (size(full["gaps"]) > 0, "schema_completeness_missing", {"count": size(full["gaps"])}), (full["unnamed_author"], "schema_completeness_author_unnamed", {}), (size(full["complete"]) > 0, "schema_completeness_ok", {"types": F.array_join(full["complete"], ", ")})],
        ),
        criterion(
            cat, "entities", entities, entities > 0.3, shown(entities), percent(entities), F.lit(100),
            evidence=[(org, "entities_org_named", {"name": publisher_name()}), (org & who["org_verifiable"], "entities_org_verifiable", {}), (org & ~who["org_verifiable"], "entities_org_unverifiable", {}), (~org, "entities_org_none", {}), (person, "entities_person_named", {}), (person & who["person_verifiable"], "entities_person_verifiable", {}), (~person, "entities_person_none", {}), (who["linked_graph"], "entities_graph_linked", {}), (~who["linked_graph"], "entities_graph_loose", {}), (who["topic"], "entities_topic", {}), (~who["topic"], "entities_topic_none", {})],
        ),
        criterion(
            cat, "semanticHtml", semantic, semantic > 0.5, shown(semantic), percent(semantic), F.lit(100),
            evidence=[(semantic > 0, "semanticHtml_present", {}), (semantic == 0, "semanticHtml_none", {})] + [(~c, f"semanticHtml_missing_{n}", {}) for n, c in marks.items() if n != "aside"],
        ),
        criterion(
            cat, "internalLinks", linking, linked, F.when(targets == 0, "notPresent").otherwise(F.concat(targets.cast("string"), F.lit(" ("), shown(ratio), F.lit(")"))), percent(linking), F.lit(100),
            fix=F.when((targets >= 3) & (ratio < 0.8), "internalLinks_anchors"),
            evidence=[(targets == 0, "internalLinks_none", {}), (targets > 0, "internalLinks_count", {"count": targets}), (telling < targets, "internalLinks_generic", {"count": targets - telling}), (targets > 0, "internalLinks_ratio", {"percent": percent(ratio)})],
        ),
        criterion(
            cat, "llmsTxt", llms_score, llms | llms_full, F.when(llms & llms_full, "llms_both").when(llms, "llms_indexOnly").when(llms_full, "llms_fullOnly").otherwise("notFound"), llms_score, F.lit(1),
            fix=F.when(~llms & llms_full, "llmsTxt_fullOnly"), evidence=[(llms, "llmsTxt_found", {}), (~llms, "llmsTxt_none", {})],
        ),
        criterion(
            cat, "robotsTxt", crawl, ~shut & ~wall & ~opted_out, robots_value, F.greatest(F.lit(0), n_checked - size(blocked)), n_checked,
            fix=F.when(unreachable, "robotsTxt_unreachable").when(wall, "robotsTxt_firewall").when(opted_out, "robotsTxt_signal").when((size(blocked) > 0) & ~shut, "robotsTxt_training"),
            evidence=[(unreachable, "robotsTxt_unreachable", {"status": robots["httpStatus"]})] + [(~unreachable & F.arrays_overlap(blocked, F.array(*(F.lit(n) for n, y in config.BOTS if y == p_))), f"robotsTxt_blocked_{p_}", {}) for p_ in config.PURPOSE_WEIGHTS] + [(wall, "robotsTxt_firewall", {"bots": F.array_join(walled, ", ")}), (opted_out, "robotsTxt_signal", {})],
        ),
        criterion(
            cat, "crawlerView", view_score, view["status"] == "ok", F.when(view["status"] == "ok", "crawlerOk").when(view["status"] == "partial", "crawlerPartial").otherwise("crawlerJsOnly"), percent(view_score), F.lit(100), present=seen,
            evidence=[(None, "crawlerView_coverage", {"percent": percent(view["coverage"])}), (size(view["missingHeadings"]) > 0, "crawlerView_headings", {"headings": F.array_join(view["missingHeadings"], ", ")})],
        ),
        criterion(
            cat, "productData", product, product >= 0.99, F.when(p.isNull(), "noneFound").when(product >= 0.99, "present").otherwise("productData_partial"), percent(product), F.lit(100), present=kind == "product",
            evidence=[(p.isNull(), "product_none", {}), (p.isNotNull(), "product_found", {"count": p["products"], "variants": p["variants"]})] + [(p.isNotNull() & ~p[f], f"product_missing_{f}", {}) for f in q if f != "identifier"] + [(p["identifier"], "product_gtin", {}), (~p["identifier"] & p["sku"], "product_sku_only", {}), (~p["identifier"] & ~p["sku"], "product_no_identifier", {})],
        ),
        criterion(
            cat, "localBusiness", business, business >= 0.99, F.when(business >= 0.99, "present").when(b.isNotNull(), "localBusiness_partial").otherwise("noneFound"), percent(business), F.lit(100), present=is_local,
            evidence=[(b.isNull(), "local_detected_page", {"address": F.get(local["addresses"], 0)}), (b.isNotNull(), "local_detected_schema", {"type": b["type"]}), (size(b["address_fields"]) == 3, "local_address_ok", {}), (size(b["address_fields"]) < 3, "local_address_missing", {}), (code_off, "local_postal_mismatch", {}), (phone_off, "local_phone_mismatch", {})],
        ),
        criterion(
            cat, "sitemap", sitemap, sitemap >= 0.999, F.when(~m["exists"], "noneFound").when(sitemap >= 0.999, "sitemapOk").otherwise("sitemapPartial"), percent(sitemap), F.lit(100), present=m.isNotNull(),
            fix=F.when(m["exists"] & (m["listed"] == False), "sitemap_listed").when(m["exists"] & ((dated & m["lastmodUniform"]) | ((m["listed"] == True) & m["pageLastmod"].isNull())), "sitemap_lastmod").when(m["exists"] & ~m["declaredInRobots"], "sitemap_robots"),  # noqa: E712
            evidence=[(~m["exists"], "sitemap_none", {}), (m["exists"], "sitemap_entries", {"count": m["entries"]}), (m["exists"] & ~m["declaredInRobots"], "sitemap_undeclared", {})],
        ),
    ]
    findings = [
        ("product_data_incomplete", (kind == "product") & (product < 0.7)), ("local_business_incomplete", is_local & (business < 0.7)),
        ("no_sitemap", ~m["exists"]), ("sitemap_page_missing", m["exists"] & (m["listed"] == False)),  # noqa: E712
        ("sitemap_lastmod", m["exists"] & F.coalesce(m["listed"], F.lit(True)) & (((m["listed"] == True) & (F.coalesce(m["pageLastmod"], F.lit("")) == "")) | m["lastmodUniform"])),  # noqa: E712
        ("sitemap_not_in_robots", m["exists"] & ~m["declaredInRobots"]),
        ("no_faq_schema", has & no_faq & ~no_article), ("no_schema", ~(has & no_faq & ~no_article) & (~has | lacking)), ("schema_incomplete", (full["total"] > 0) & (size(full["gaps"]) > 0)),
        ("few_entities", ~(entities > 0.3)), ("weak_semantic_html", ~(semantic > 0.5)), ("weak_internal_links", ~linked), ("no_llms_txt", ~llms),
        ("ai_bots_blocked", shut), ("ai_bots_firewall", wall), ("content_signal_opt_out", opted_out), ("js_only_content", view["status"].isin("partial", "js-only")),
    ]
    return rows, findings


def ai_citation(let: Steps) -> tuple[list[Column], list[tuple[str, Column]]]:
    cat, paragraphs, home = "aiCitation", F.col("paragraphs"), F.col("pageType") == "homepage"
    facts = let("facts", F.filter(paragraphs, X.is_fact))
    questions = let("questions_cited", size(X.visible_questions(F.col("faqQuestions"), F.col("headings"))))
    cited, sources = let("citations", X.citation_count(F.array_join(paragraphs, " "))), F.col("sourceLinks")
    h1 = let("h1_text", F.get(F.filter(F.col("headings"), lambda h: h["level"] == 1), 0)["text"])
    let.then()
    fact_score = let("fact_score", F.least(F.lit(1.0), size(facts) / F.lit(4.0)))
    title = let("h1_plain", F.coalesce(X.squeezed(F.lower(h1)), F.lit("")))
    hidden = let("hidden_answers", F.least(F.greatest(F.lit(0), F.coalesce(F.col("faqAnswersHidden"), F.lit(0))), questions))
    marked = F.arrays_overlap(F.col("schemaTypes"), F.array(F.lit("FAQPage"), F.lit("QAPage")))
    weighty = lambda t: size(F.split(F.trim(t), X.WHITE)) >= 8
    pairs = F.col("questionAnswers")
    by_pairs = let("answered_questions", size(F.array_distinct(F.transform(F.filter(pairs, lambda qa: weighty(qa["answer"])), lambda qa: X.question_key(qa["question"])))))
    let.then()
    answered = let("faq_answered", F.least(questions - hidden, F.when(pairs.isNotNull(), by_pairs).otherwise(count_where(paragraphs, weighty))))
    let.then()
    faq = let("faq_score", F.least(F.lit(1.0), F.when(answered >= 5, 1.0).when(answered >= 3, 0.6).when(answered >= 1, 0.3).otherwise(0.0) + part(marked & (questions > 0), 0.4)))
    unseen = ~home & (hidden > 0)

    sourced = let("sourced", F.least(F.lit(1.0), F.least(F.lit(0.5), cited / F.lit(4.0)) + part((sources >= 2) & (size(facts) > 0), 0.3) + part(sources >= 4, 0.2)))

    def leads(ps: Column) -> Column:
        """Body paragraphs with substance: not the title again, not a short label."""

        def fits(p: Column) -> Column:
            t = X.squeezed(F.lower(p))
            again = (title != "") & ((t == title) | (F.contains(title, t) & (F.char_length(t) < F.char_length(title) + 20)))
            return (t != "") & ~again & (size(F.split(t, " ")) >= 8)

        return F.filter(ps, fits)

    own = let("leads", leads(paragraphs))
    box = F.col("leadSummary")
    box = let("summary_box", F.when(box.isNotNull() & (size(leads(F.slice(paragraphs, F.lit(1), F.greatest(F.coalesce(box["paragraphsBefore"], F.lit(0)), F.lit(0))))) <= 1), box))
    let.then()
    first = let("lead", F.slice(F.when(size(own) > 0, own).otherwise(paragraphs), 1, 3))
    let.then()
    points = F.transform(box["items"], lambda i: F.when(i.rlike("[.!?…]$"), i).otherwise(F.concat(i, F.lit("."))))
    start = let("start", F.array_join(F.slice(F.filter(F.split(F.array_join(F.filter(F.concat(F.coalesce(F.array(F.array_join(points, " ")), F.array(F.lit(""))), first), lambda t: t != ""), " "), X.WHITE), lambda t: t != ""), 1, 150), " "))
    let.then()
    described = F.coalesce(F.col("meta.description"), F.lit(""))
    lead_length = F.char_length(F.get(first, 0))
    defined, figure = let("start_defines", box.isNotNull() | X.definition(start).isNotNull()), let("start_has_fact", X.is_fact(start))
    let.then()
    upfront = let("upfront", F.when(start == "", 0.0).otherwise(F.least(F.lit(1.0), part(F.char_length(h1) >= 5, 0.2) + part(lead_length < 500, 0.15) + part(F.char_length(described) > 50, 0.15) + part(defined, 0.3) + part(figure, 0.2))))
    rows = [
        criterion(
            cat, "facts", fact_score, fact_score > 0.3, shown(fact_score), percent(fact_score), F.lit(100), fix=F.when((hidden > 0) & (fact_score < 1), "facts_hidden"),
            evidence=[(size(paragraphs) == 0, "facts_no_paragraphs", {}), (size(paragraphs) > 0, "facts_counted", {"total": size(paragraphs), "facts": size(facts)}), (size(facts) > 0, "facts_example", {"text": X.match_excerpt(F.get(facts, 0), config.FACTS)}), ((hidden > 0) & (fact_score < 1), "facts_hidden_faq", {"hidden": hidden})],
        ),
        criterion(
            cat, "faq", faq, faq > 0, F.when(unseen, "faqAnswersHidden").otherwise(shown(faq)), percent(faq), F.lit(100), applies=~home,
            fix=F.when(unseen, "faq_hidden").when(questions > 0, "faq_more").when(marked, "faq_schema_only").otherwise("faq"),
            evidence=[((questions == 0) & marked, "faq_schema_only", {}), ((questions == 0) & ~marked, "faq_none", {}), (questions > 0, "faq_questions", {"count": questions, "answered": answered}), (hidden > 0, "faq_hidden", {"hidden": hidden, "total": questions}), (marked & (questions > 0), "faq_schema_yes", {}), (~marked, "faq_schema_no", {})],
        ),
        criterion(
            cat, "sourcedClaims", sourced, sourced > 0.3, shown(sourced), percent(sourced), F.lit(100),
            evidence=[(cited > 0, "sourcedClaims_citations", {"count": cited}), (cited == 0, "sourcedClaims_no_citations", {}), (sources > 0, "sourcedClaims_links", {"count": sources}), (sources == 0, "sourcedClaims_no_links", {}), ((sources >= 2) & (size(facts) == 0), "sourcedClaims_links_no_numbers", {})],
        ),
        criterion(
            cat, "keyInfoUpfront", upfront, upfront > 0.5, shown(upfront), percent(upfront), F.lit(100), applies=~home,
            evidence=[(start == "", "keyInfoUpfront_no_text", {}), (box.isNotNull(), "keyInfoUpfront_lead_summary", {"heading": box["heading"]}), (box.isNull() & (start != ""), "keyInfoUpfront_lead", {"text": F.substring(start, 1, 160)}), (F.char_length(h1) >= 5, "keyInfoUpfront_h1_ok", {}), (h1.isNull(), "keyInfoUpfront_h1_missing", {}), (lead_length < 500, "keyInfoUpfront_short_ok", {"chars": lead_length}), (lead_length >= 500, "keyInfoUpfront_short_long", {"chars": lead_length}), (F.char_length(described) > 50, "keyInfoUpfront_meta_ok", {}), (defined, "keyInfoUpfront_definition_ok", {}), (~defined, "keyInfoUpfront_definition_missing", {}), (figure, "keyInfoUpfront_number_ok", {}), (~figure, "keyInfoUpfront_number_missing", {})],
        ),
    ]
    return rows, [("no_facts", ~(fact_score > 0.3)), ("faq_answers_hidden", unseen), ("no_faq", ~unseen & ~home & ~(faq > 0)), ("no_sourced_claims", ~(sourced > 0.3)), ("no_key_info_upfront", ~home & ~(upfront > 0.5))]


def length_score(n: Column, low: int, high: int) -> Column:
    """1 within the range; shorter or longer loses in proportion, down to 0.3; nothing scores 0."""
    short, long = F.greatest(F.lit(0.3), n / F.lit(float(low))), F.greatest(F.lit(0.3), F.lit(1.0) - (n - high) / F.lit(float(high)))
    return F.when(n == 0, 0.0).when(n.between(low, high), 1.0).when(n < low, short).otherwise(long)


def on_page_seo(let: Steps) -> tuple[list[Column], list[tuple[str, Column]]]:
    cat = "onPageSeo"
    title, described = (let(f"{n}_length", F.char_length(X.squeezed(F.coalesce(F.col(f"meta.{n}"), F.lit(""))))) for n in ("title", "description"))

    images = F.col("images")
    n, alts = size(images), count_where(images, lambda i: i["hasAltAttribute"])
    alts = let("alts", alts)
    here, there = let("own_key", U.page_key(F.coalesce(F.col("canonical"), F.col("url")))), let("url_key", U.page_key(F.col("url")))
    own = let("self_canonical", F.coalesce(U.canonical_key(F.col("canonical")) == U.canonical_key(F.col("url")), F.lit(False)))
    let.then()
    title_score, described_score = let("title_score", length_score(title, 30, 60)), let("description_score", length_score(described, 120, 160))
    alt_score = F.when(n == 0, 1.0).otherwise(alts / n)

    robots = F.col("robotsMeta")
    most, share = robots["maxSnippet"], F.coalesce(robots["noSnippetShare"], F.lit(0.0))
    snippet = let(
        "snippet",
        F.least(F.when(robots["hasNoSnippet"] | F.coalesce(most == 0, F.lit(False)), 0.25).when(most.between(1, 49), 0.6).otherwise(1.0),
        F.when(share >= 0.5, 0.5).when(share >= 0.2, 0.8).otherwise(1.0)),
    )
    indexed = ~robots["hasNoIndex"]
    limited = indexed & (snippet < 1)

    view = F.col("viewport")
    view_score = F.when(~view["hasViewport"], 0.0).when(~view["hasDeviceWidth"], 0.4).otherwise(1.0)

    og, tw = F.col("openGraph"), F.col("twitterCard")
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    article = F.arrays_overlap(F.col("schemaTypes"), F.array(*map(F.lit, config.ARTICLE_TYPES)))
    og_type = F.lower(F.trim(F.coalesce(F.nullif(og["type"], F.lit("")), F.col("meta.ogType"), F.lit(""))))
    cards = {
        "og:title": given(og["title"]), "og:description": given(og["description"]), "og:image": given(og["image"]) & ~X.is_generic_image(F.coalesce(og["image"], F.lit(""))),
        "og:url": given(og["url"]), "og:type": F.when(article, og_type == "article").otherwise(og_type != ""), "twitter:card": given(tw["card"]),
    }
    cards = {t: let(f"card_{i}", c) for i, (t, c) in enumerate(cards.items())}
    h = F.col("hreflang")
    self_ = let("self_alternate", F.get(F.filter(h["alternates"], lambda a: F.coalesce((U.page_key(a["href"]) == here) | (U.page_key(a["href"]) == there), F.lit(False))), 0))
    let.then()
    n_cards = let("cards", sum((c.cast("int") for c in cards.values()), F.lit(0)))
    card_score = n_cards / F.lit(6.0)
    lost = F.array_join(F.filter(F.array(*(F.when(~c, F.lit(t)) for t, c in cards.items())), lambda x: x.isNotNull()), ", ")

    canonical = F.col("canonical")
    canonical_score = F.when(canonical.isNull(), 0.0).when(own, 1.0).otherwise(0.4)

    many, switch = size(h["alternates"]), size(h["languageLinks"])
    default = F.exists(h["alternates"], lambda a: F.lower(a["hreflang"]) == "x-default")
    valid = F.forall(h["alternates"], lambda a: a["hreflang"].rlike(config.HREFLANG_CODE))
    tongue = F.get(F.split(F.lower(self_["hreflang"]), "-"), 0)
    match = self_.isNull() | F.col("lang").isNull() | (tongue == "x") | (tongue == F.lower(F.col("lang")))
    lang_score = let("hreflang_score", F.when(many == 0, 0.0).otherwise(part(self_.isNotNull(), 0.4) + part(default, 0.2) + part(valid, 0.2) + part(match, 0.2)))
    several = (many > 0) | (switch > 0)

    def case(name: str, length: Column, low: int, high: int) -> Evidence:
        return [(length == 0, f"{name}_missing", {}), (length.between(1, low - 1), f"{name}_short", {"length": length, "min": F.lit(low)}), (length > high, f"{name}_long", {"length": length, "max": F.lit(high)}), (length.between(low, high), f"{name}_ok", {"length": length})]

    rows = [
        criterion(cat, "title_quality", title_score, title_score >= 0.7, F.when(title == 0, "notPresent").otherwise("chars"), percent(title_score), F.lit(100), evidence=case("title_quality", title, 30, 60)),
        criterion(cat, "meta_description", described_score, described_score >= 0.7, F.when(described == 0, "notPresent").otherwise("chars"), percent(described_score), F.lit(100), evidence=case("meta_description", described, 120, 160)),
        criterion(
            cat, "image_alts", alt_score, (alt_score >= 0.8) | (n == 0), F.when(n == 0, "noImages").otherwise(F.concat_ws("/", alts.cast("string"), n.cast("string"))), F.when(n == 0, 1).otherwise(alts), F.greatest(n, F.lit(1)),
            fix=F.when(n == 0, "image_alts_none"), evidence=[(n == 0, "image_alts_none", {}), (n > 0, "image_alts_count", {"with": alts, "total": n}), (alts < n, "image_alts_missing", {"files": F.array_join(F.transform(F.slice(F.filter(images, lambda i: ~i["hasAltAttribute"]), 1, 3), lambda i: X.file_name(i["src"])), ", ")})],
        ),
        criterion(
            cat, "indexability", F.when(indexed, snippet).otherwise(0.0), indexed & ~limited, F.when(~indexed, "noindex").when(limited, "snippetLimited").otherwise("indexable"), (indexed & ~limited).cast("int"), F.lit(1),
            fix=F.when(limited, "indexability_snippet"), evidence=[(~indexed, "indexability_noindex", {}), (indexed, "indexability_ok", {}), (robots["headerContent"].isNotNull(), "indexability_header", {"header": robots["headerContent"]}), (robots["hasNoSnippet"], "indexability_nosnippet", {}), (most >= 0, "indexability_max_snippet", {"max": most}), (share > 0, "indexability_data_nosnippet", {"percent": percent(share)})],
        ),
        criterion(
            cat, "viewport", view_score, view_score >= 0.99, F.when(~view["hasViewport"], "notPresent").when(~view["hasDeviceWidth"], "viewport_misconfigured").otherwise("present"), (view_score >= 0.99).cast("int"), F.lit(1),
            fix=F.when(view["hasViewport"] & ~view["hasDeviceWidth"], "viewport_device_width"), evidence=[(~view["hasViewport"], "viewport_missing", {}), (view["hasViewport"] & ~view["hasDeviceWidth"], "viewport_no_device_width", {}), (view["hasDeviceWidth"], "viewport_ok", {}), (view["userScalableNo"], "viewport_no_zoom", {})],
        ),
        criterion(
            cat, "social_cards", card_score, card_score >= 0.75, F.when(n_cards == 6, "6/6").otherwise("socialCardsMissing"), n_cards, F.lit(6),
            evidence=[(n_cards > 0, "social_cards_present", {"count": n_cards}), (n_cards < 6, "social_cards_missing", {"tags": lost}), (given(og["image"]) & ~cards["og:image"], "social_cards_generic_image", {"file": X.file_name(F.coalesce(og["image"], F.lit("")))})],
        ),
        criterion(
            cat, "canonical", canonical_score, canonical_score >= 0.99, F.when(canonical.isNull(), "notPresent").when(own, "present").otherwise("canonical_mismatch"), own.cast("int"), F.lit(1),
            fix=F.when(canonical.isNotNull() & ~own, "canonical_mismatch"), evidence=[(canonical.isNull(), "canonical_missing", {}), (own, "canonical_self", {"canonical": canonical}), (canonical.isNotNull() & ~own, "canonical_mismatch", {"canonical": canonical})],
        ),
        criterion(
            cat, "hreflang", lang_score, lang_score >= 0.99, F.when(many == 0, "notPresent").when(lang_score >= 0.99, "present").otherwise("hreflang_incomplete"), percent(lang_score), F.lit(100), present=several,
            fix=F.when((many > 0) & (lang_score < 0.99), "hreflang_incomplete"), evidence=[(many == 0, "hreflang_missing", {"count": switch}), (many > 0, "hreflang_found", {"count": many}), ((many > 0) & self_.isNull(), "hreflang_self_missing", {}), ((many > 0) & ~default, "hreflang_xdefault_missing", {}), ((many > 0) & ~valid, "hreflang_invalid", {}), ((many > 0) & ~match, "hreflang_lang_mismatch", {})],
        ),
    ]
    findings = [
        ("hreflang_missing", several & (many == 0)), ("hreflang_incomplete", several & (many > 0) & (lang_score < 0.99)),
        ("title_missing", title == 0), ("title_too_short", title.between(1, 29)), ("title_too_long", title > 60),
        ("description_missing", described == 0), ("description_too_short", described.between(1, 119)), ("description_too_long", described > 160),
        ("images_missing_alts", (n > 0) & (alt_score < 0.8)), ("page_is_noindex", ~indexed), ("snippet_restricted", limited),
        ("viewport_missing", ~view["hasViewport"]), ("viewport_misconfigured", view["hasViewport"] & ~view["hasDeviceWidth"]), ("social_cards_missing", ~(card_score >= 0.75)),
        ("canonical_missing", canonical.isNull()), ("canonical_mismatch", canonical.isNotNull() & ~own),
    ]
    return rows, findings
