"""Sentences, definitions, facts, citations and questions in text."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .numbers import size
from .steps import bind

#: Hosts that are no sources, and what is below them.
NON_SOURCE = r"(?:^|\.)(?:" + "|".join(map(re.escape, config.NON_SOURCE_HOSTS)) + r")\z|^mastodon\."
WHITE = r"[\s\u0085\p{Z}]+"


def any_of(text: Column, patterns: list[str]) -> Column:
    return reduce(or_, (text.rlike(p) for p in patterns))


def squeezed(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, WHITE, " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), WHITE), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Cut after a final mark that white space follows."""
    return F.filter(F.transform(F.split(text, rf"(?<=[.!?…]){WHITE}"), lambda s: F.trim(F.regexp_replace(s, rf"^{WHITE}|{WHITE}$", ""))), lambda s: s != "")


def definition(text: Column) -> Column:
    """The first sentence that defines a term; null if none does."""
    return F.get(F.filter(sentences(text), lambda s: ~s.endswith("?") & any_of(s, config.DEFINITIONS)), 0)


def is_fact(text: Column) -> Column:
    return any_of(text, config.FACTS)


def citation_count(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in config.CITATIONS[1:]), F.regexp_count(text, F.lit(config.CITATIONS[0])))


def is_structured(text: Column) -> Column:
    """Whether a paragraph reads like a step of a list."""
    return any_of(text, config.STEPS)


def opens_question(text: Column) -> Column:
    return any_of(text, config.QUESTIONS)


def question_key(text: Column) -> Column:
    return F.regexp_replace(squeezed(F.lower(text)), r"\s*\?$", "")


def visible_questions(faq: Column, headings: Column) -> Column:
    """Questions a reader sees, each once."""
    asked = F.filter(F.transform(headings, lambda h: F.trim(h["text"])), lambda t: t.rlike("[?？]$"))
    return F.filter(F.array_distinct(F.transform(F.concat(F.coalesce(faq, F.array().cast("array<string>")), asked), question_key)), lambda q: q != "")


def is_source_link(link: Column) -> Column:
    """External, in the content, with text, and not to a social network, messenger or tracker."""
    from . import urls

    social = urls.bare_host(link["href"]).rlike(NON_SOURCE)  # one mention: a host is several patterns over the URL
    return F.coalesce(link["isExternal"] & ~F.coalesce(link["isNavigational"], F.lit(False)) & (F.trim(link["text"]) != "") & ~social, F.lit(False))


def source_link_count(links: Column) -> Column:
    from . import urls

    return size(F.array_distinct(F.transform(F.filter(links, is_source_link), lambda x: urls.source_key(x["href"]))))


def is_descriptive(text: Column) -> Column:
    t = F.trim(text)
    return (F.char_length(t) > 2) & ~any_of(t, config.GENERIC_ANCHORS)


def first_sentence_title(text: Column, most: int = 90) -> Column:
    """A ticket's title: the first sentence without its mark, cut at a length."""
    first = F.regexp_replace(F.get(F.split(text, r"(?<=[.!?])\s"), 0), "[.!?]$", "")
    return F.when(F.char_length(first) > most, F.concat(F.rtrim(F.substring(first, 1, most - 1)), F.lit("…"))).otherwise(first)


def file_name(src: Column) -> Column:
    """The last part of an image's path, decoded."""
    p = F.regexp_replace(F.regexp_replace(src, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    last = F.try_element_at(F.filter(F.split(p, "/"), lambda x: x != ""), F.lit(-1))
    return F.coalesce(F.try_url_decode(last), last, src)


def is_generic_image(src: Column) -> Column:
    p = F.regexp_replace(F.regexp_replace(src, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), r"[?#].*$", "")
    return F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"(?i)\.[a-z0-9]+$", "").rlike(config.GENERIC_IMAGE)


def clip(text: Column, most: int = 60) -> Column:
    """White space squeezed, and cut at a length."""
    t = squeezed(text)
    return F.when(F.char_length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def excerpt(text: Column, most: int = 60) -> Column:
    """Cut at a word, as long as that keeps more than half, and without a mark at the end."""
    t = squeezed(text)
    head = F.substring(t, 1, most - 1)
    whole = F.regexp_replace(head, r"\s\S*$", "")
    cut = F.when(F.char_length(whole).between(most // 2 + 1, most - 2), whole).otherwise(head)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.rtrim(cut), "[.,:;]$", ""), F.lit("…")))


def clip_at_word(text: Column, most: int = 60) -> Column:
    """Cut at a word where that keeps more than three fifths, without marks at the end."""
    t = squeezed(text)
    head = F.substring(t, 1, most)
    whole = F.regexp_replace(head, r"\s\S*$", "")
    cut = F.when(F.char_length(whole) > most * 0.6, whole).otherwise(head)
    return F.when(F.char_length(t) <= most, t).otherwise(F.concat(F.regexp_replace(cut, r"[\s,;:.-]+$", ""), F.lit("…")))


def quoted(texts: Column, shown: int = 3, most: int = 50) -> Column:
    """The first texts, clipped and in quotation marks."""
    return F.array_join(F.transform(F.slice(texts, 1, shown), lambda t: F.concat(F.lit("«"), clip_at_word(t, most), F.lit("»"))), ", ")


def match_excerpt(text: Column, patterns: list[str], most: int = 60) -> Column:
    """The part of a text around the first match of the first pattern that matches, cut at words; null without a match."""
    squeezed_text = squeezed(text)
    hits = F.array(*(F.struct((F.regexp_instr(squeezed_text, F.lit(p)) - 1).alias("at"), F.char_length(F.regexp_extract(squeezed_text, p, 0)).alias("n")) for p in patterns))

    def around(x: Column) -> Column:
        t, at, past, size_ = x["t"], x["hit"]["at"], x["hit"]["at"] + x["hit"]["n"], F.char_length(x["t"])
        left = F.greatest(F.lit(0), at - F.floor((F.lit(most) - x["hit"]["n"]) / 2).cast("int"))
        right = F.least(size_, left + most)
        return bind(F.struct(F.greatest(F.lit(0), right - most).alias("a"), right.alias("b")), lambda w: F.when(size_ <= most, t).otherwise(cut(t, at, past, size_, w["a"], w["b"])))

    def cut(t: Column, at: Column, past: Column, size_: Column, a: Column, b: Column) -> Column:
        gap = F.call_function("locate", F.lit(" "), t, a + 1) - 1  # the first blank from the left end on
        start = F.when((a > 0) & (gap >= 0) & (gap < at), gap + 1).otherwise(a)
        back = F.instr(F.reverse(F.substring(t, F.lit(1), b + 1)), " ")  # the last blank up to the right end
        stop = F.when((b < size_) & (back > 0) & (b + 1 - back > past), b + 1 - back).otherwise(b)
        inside = F.trim(F.substring(t, start + 1, stop - start))
        return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), F.when(stop < size_, F.concat(F.regexp_replace(inside, "[.,:;]$", ""), F.lit("…"))).otherwise(inside))

    return bind(F.struct(squeezed_text.alias("t"), F.get(F.filter(hits, lambda h: h["at"] >= 0), 0).alias("hit")), lambda x: F.when(x["hit"].isNotNull(), around(x)))


def escaped(text: Column) -> Column:
    """Text for HTML, in attributes too."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def filled(text: Column, params: Column) -> Column:
    """The text with each {name} replaced by its value in a map; names that aren't there stay."""
    return F.aggregate(F.map_entries(params), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def markdown_html(text: Column) -> Column:
    """The Markdown of ticket bodies as HTML: second-level headings, lists, rules, code fences, bold, code and bare addresses.

    Fences cut the text into parts, every second of them code; in the others lines become blocks by patterns over the whole part.
    """

    def code(part: Column) -> Column:
        return F.concat(F.lit("<p><code>"), F.replace(F.regexp_replace(escaped(part), r"\n$", ""), F.lit("\n"), F.lit("<br>")), F.lit("</code></p>"))

    def blocks(part: Column) -> Column:
        steps = (
            (r"\*\*(.+?)\*\*", "<strong>$1</strong>"), (r"`([^`\n]+)`", "<code>$1</code>"), (r"(?m)(^|\s)(https?://[^\s<]+)", '$1<a href="$2">$2</a>'),
            (r"(?m)^(?:---|[ \t]*)$\n?", ""), (r"(?m)^- (.*)$", "<li><p>$1</p></li>"), (r"(?m)((?:^<li>.*$\n?)+)", "<ul>$1</ul>\n"), (r"</li>\n(?=<li>|</ul>)", "</li>"),
            (r"(?m)^##\s+(.*)$", "<h2>$1</h2>"), (r"(?m)^(?!<h2>|<ul>)(.+)$", "<p>$1</p>"),
        )
        html = escaped(part)
        for pattern, to in steps:
            html = F.regexp_replace(html, pattern, to)
        return F.regexp_replace(html, r"^\n+|\n+$", "")

    parts = F.split(text, r"(?m)^```.*$\n?")
    return F.array_join(F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 1, code(p)).otherwise(blocks(p))), lambda x: x != ""), "\n")


def host_list(links: Column, most: int = 5) -> Column:
    """Distinct hosts of links, the first ones, with a mark if there are more."""
    from . import urls

    hosts = F.array_distinct(F.transform(links, lambda x: urls.bare_host(x["href"])))
    return F.concat(F.array_join(F.slice(hosts, 1, most), ", "), F.when(F.size(hosts) > most, F.lit(" …")).otherwise(F.lit("")))
