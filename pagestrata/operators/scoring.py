"""From page records to scores, ratings and ordered findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config, schema
from ..functions import readability as R
from ..functions import text as X
from ..functions.numbers import clamp, round1
from ..functions.steps import once
from . import criteria as C
from .orders import in_order


#: What analyze adds to a record.
ADDED = ("pageType", "sourceLinks", "readability", "criteria", "findings", *config.CATEGORIES, "totalScore", "rating")


def rating(total: Column) -> Column:
    return F.when(total >= 25, "excellent").when(total >= 19, "good").when(total >= 12, "moderate").otherwise("poor")


def category_level(score: Column) -> Column:
    return F.when(score >= 4, "green").when(score >= 3, "lime").when(score >= 2, "yellow").otherwise("red")


def category_score(rows: Column) -> Column:
    """Points over weights, on a scale to 5; 0 if nothing applies. Sums are taken in order."""
    points = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["points"])
    weight = F.aggregate(rows, F.lit(0.0), lambda a, r: a + r["weight"])
    return F.when(weight == 0, 0.0).otherwise(round1(clamp(points / weight * F.lit(5.0), 0.0, 5.0)))


def met(row: Column) -> Column:
    """Found, and its progress complete."""
    return row["found"] & F.coalesce(row["current"] >= row["target"], F.lit(True))


def status(row: Column) -> Column:
    return F.when(met(row), "ok").when(row["found"] | (row["points"] > 0), "partial").otherwise("fail")


def with_inputs(pages: DataFrame) -> DataFrame:
    """Adds what the page has no column for: a missing input is null, and its check is left out."""
    for field in T._parse_datatype_string(schema.PAGE_INPUTS):
        if field.name not in pages.columns:
            pages = pages.withColumn(field.name, F.lit(None).cast(field.dataType))
    return pages


def fired(findings: list[tuple[str, Column]]) -> Column:
    """The findings whose condition holds, the most urgent first, those of equal urgency as listed."""
    known = {key: of for key, *of in config.FINDINGS}
    made = []
    for i, (key, condition) in enumerate(findings):
        priority, owner, effort = known[key]
        made.append(F.when(condition, F.struct(F.lit(-priority).alias("rank"), F.lit(i).alias("ordinal"), F.lit(key).alias("key"), F.lit(priority).alias("priority"), F.lit(owner).alias("owner"), F.lit(effort).alias("effort"))))
    return F.array_sort(F.array_compact(F.array(*made)))


#: Expressions of analyze that have been built, by JVM, time and whether evidence is asked for: building them takes seconds. So many are held at most.
MOST_BUILT = 8
_BUILT: dict[tuple, tuple] = {}


def built(as_of: Column | None, evidence: bool) -> tuple[list[dict[str, Column]], dict[str, Column], dict[str, Column]]:
    """Layers of measures, the rows of each category with all findings, and each criterion. They name columns, so they suit every DataFrame."""
    now = F.current_timestamp() if as_of is None else as_of
    key = (id(now._jc._gateway_client), now._jc.toString(), evidence)
    if key not in _BUILT:
        steps = [C.Steps() for _ in config.CATEGORIES]
        builders = (C.content_clarity, C.answerability, lambda let: C.trust_sources(let, now), C.machine_readability, C.ai_citation, C.on_page_seo)
        with C.evidence_wanted(evidence), C.made_inside() as each:
            parts = [build(let) for build, let in zip(builders, steps)]
        layers = [{n: c for s in steps if depth < len(s.layers) for n, c in s.layers[depth].items()} for depth in range(max(len(s.layers) for s in steps))]
        made = {f"_{name}": F.array_compact(F.array(*rows)) for name, (rows, _) in zip(config.CATEGORIES, parts)}
        made["findings"] = fired([x for _, findings in parts for x in findings])
        if len(_BUILT) >= MOST_BUILT:
            _BUILT.clear()
        _BUILT[key] = [layer for layer in layers if layer], made, {name: row for rows, _ in parts for row in rows for name, own in each if own is row}
    return _BUILT[key]


def measured(records: DataFrame, layers: list[dict[str, Column]], readability: bool = True) -> DataFrame:
    """Page records with all that criteria read. What isn't asked for afterwards isn't computed, but for readability, unless it is left out."""
    pages = with_inputs(records)
    pages = pages.withColumns({"pageType": C.page_type(), "sourceLinks": X.source_link_count(F.col("links"))})
    if readability:
        pages = R.with_readability(pages, F.col("paragraphs"), R.content_language(F.col("lang"), F.col("paragraphs")))
    else:
        pages = pages.withColumn("readability", F.lit(None).cast("struct<score: double, raw: double, formula: string>"))
    for layer in layers:
        pages = pages.withColumns(layer)
    return pages


def analyze(records: DataFrame, as_of: Column | None = None, evidence: bool = True) -> DataFrame:
    """Page records with pageType, criteria, findings, six category scores, totalScore and rating.

    as_of: the time that ages are counted from; now if not given. evidence: whether criteria tell what they rest on.
    """
    layers, made, _ = built(as_of, evidence)
    pages = once(measured(records, layers), made)
    pages = pages.withColumns({name: category_score(F.col(f"_{name}")) for name in config.CATEGORIES})
    total = sum((F.col(n) for n in config.CATEGORIES[1:]), F.col(config.CATEGORIES[0]))
    pages = pages.withColumns({"criteria": F.concat(*(F.col(f"_{n}") for n in config.CATEGORIES)), "totalScore": round1(total)})
    pages = pages.withColumn("findings", F.transform("findings", lambda x: F.struct(x["key"].alias("key"), x["priority"].alias("priority"), x["owner"].alias("owner"), x["effort"].alias("effort"))))
    return pages.withColumn("rating", rating(F.col("totalScore"))).select(*records.columns, *ADDED)


def checks_map(rows: Column) -> Column:
    """Criterion to whether it is met; what doesn't apply is left out."""
    return F.map_from_entries(F.transform(F.filter(rows, lambda r: r["weight"] > 0), lambda r: F.struct(r["criterion"], met(r))))


def criteria_table(results: DataFrame, *keys: str) -> DataFrame:
    """One row a criterion of a page."""
    rows = results.select(*keys, F.posexplode_outer("criteria").alias("ordinal", "c")).where("c IS NOT NULL").select(*keys, "ordinal", "c.*")
    return rows.withColumn("applicable", F.col("weight") > 0).withColumn("met", F.col("found") & F.coalesce(F.col("current") >= F.col("target"), F.lit(True)))


def some_criteria(records: DataFrame, keys: tuple[str, ...], names: tuple[str, ...], as_of: Column | None = None) -> DataFrame:
    """The named criteria of page records as in criteria_table, without evidence; no other is computed. None of them reads readability unless it is named."""
    layers, _, each = built(as_of, False)
    rows = F.array(*(row for name, row in each.items() if name in names))
    pages = measured(records, layers, "readability" in names)
    table = pages.select(*keys, F.explode_outer(rows).alias("c")).where("c IS NOT NULL").select(*keys, "c.*")
    return table.withColumn("applicable", F.col("weight") > 0).withColumn("met", F.col("found") & F.coalesce(F.col("current") >= F.col("target"), F.lit(True)))


def findings_table(results: DataFrame, *keys: str) -> DataFrame:
    """One row a finding of a page, the most urgent first."""
    return results.select(*keys, F.posexplode_outer("findings").alias("ordinal", "f")).where("f IS NOT NULL").select(*keys, "ordinal", "f.*")


def worst_first(results: DataFrame) -> DataFrame:
    return in_order(results, "pages")


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Pages, analyzed pages and their mean score and category means."""
    ok = F.col("status") == "ok" if "status" in results.columns else F.lit(True)
    means = [round1(F.avg(F.when(ok, F.col(n)))).alias(n) for n in ("totalScore", *config.CATEGORIES) if n in results.columns]
    return results.groupBy(*by).agg(F.count("*").alias("pages"), F.count_if(ok).alias("analyzed"), *means)
