"""Where on a page a finding shows: one row an element, with its selector and the key of its label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import readability as R
from ..functions import text as X

LONG_PARAGRAPH = 500


def rows(finding: Column, fired: Column, elements: Column) -> Column:
    """struct(finding, path, label, value) of the elements, if the finding fired. elements: array<struct<path, label, value>>."""
    named = F.transform(elements, lambda m: F.struct(finding.alias("finding"), m["path"].alias("path"), m["label"].alias("label"), m["value"].alias("value")))
    return F.when(fired, named).otherwise(F.array().cast("array<struct<finding: string, path: string, label: string, value: string>>"))


def mark(path: Column, label: str | Column, value: Column | None = None) -> Column:
    name = F.lit(label) if isinstance(label, str) else label
    return F.struct(path.alias("path"), name.alias("label"), (F.lit(None) if value is None else value).cast("string").alias("value"))


def highlight_targets(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, finding, path, label, value) for findings that have a place. Elements are looked at for fired findings only."""
    fired = F.transform("findings", lambda f: f["key"])
    has = lambda key: F.array_contains(fired, key)
    heads = F.transform("headings", lambda h, i: F.struct(h["level"].alias("level"), F.char_length(h["text"]).alias("n"), F.get("paths.headings", i).alias("path"), i.alias("i")))
    before = lambda h: F.get("headings", h["i"] - 1)["level"]
    first_h1 = F.array_position(F.transform("headings", lambda h: h["level"]), 1) - 1
    extra = lambda h: (h["level"] == 1) & (h["i"] > first_h1)
    breaks = F.filter(heads, lambda h: extra(h) | F.coalesce((h["i"] > 0) & (h["level"] - before(h) > 1), F.lit(False)))
    titles = F.filter(heads, lambda h: (h["level"] == 1) & ((h["n"] < 5) | (h["n"] > 150) | (h["i"] > first_h1)))
    texts = F.arrays_zip(F.col("paragraphs").alias("text"), F.col("paths.paragraphs").alias("at"))
    long = F.filter(texts, lambda p: F.char_length(p["text"]) > LONG_PARAGRAPH)
    claims = F.filter(texts, lambda p: X.is_fact(p["text"]) & (X.citation_count(p["text"]) == 0) & ~p["at"]["sourced"])
    english = F.coalesce(R.content_language(F.col("lang"), F.col("paragraphs")) == "en", F.lit(False))
    rated = F.transform(texts, lambda p: F.struct(p["at"]["path"].alias("path"), R.block_readability(p["text"], english).alias("r")))
    hard = F.filter(rated, lambda p: F.coalesce(p["r"]["score"] < 0.5, F.lit(False)))
    places = {
        "images_missing_alts": F.transform("paths.images", lambda p: mark(p, "missing_alt")),
        "bad_hierarchy": F.transform(breaks, lambda h: mark(h["path"], F.when(extra(h), "extra_h1").otherwise("heading_jump"), h["level"])),
        "low_scanability": F.transform(long, lambda p: mark(p["at"]["path"], "long_paragraph", F.char_length(p["text"]))),
        "no_h1": F.transform(titles, lambda h: mark(h["path"], F.when(h["n"] < 5, "h1_too_short").when(h["n"] > 150, "h1_too_long").otherwise("extra_h1"), h["n"])),
        "no_sourced_claims": F.transform(claims, lambda p: mark(p["at"]["path"], "unsourced_claim")),
        "no_key_info_upfront": F.transform(F.slice("paths.paragraphs", 1, 1), lambda p: mark(p["path"], "key_info")),
        "low_readability": F.transform(hard, lambda p: mark(p["path"], F.concat(F.lit("read_band_"), R.band(p["r"]["raw"], p["r"]["formula"])), p["r"]["raw"])),
    }
    made = F.flatten(F.array(*(rows(F.lit(key), has(key), elements) for key, elements in places.items())))
    return results.select(*keys, F.explode(made).alias("m")).select(*keys, "m.*")
