"""Markup to start from for the findings that have one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config

#: Finding, language of the markup, and the markup.
SNIPPETS = {
    "no_schema": ("json-ld", '{"@context": "https://schema.org", "@type": "Article", "headline": "…", "author": {"@type": "Person", "name": "…"}, "datePublished": "YYYY-MM-DD"}'),
    "no_faq": ("html", "<section><h2>…?</h2><p>The answer in two or three sentences.</p></section>"),
    "no_faq_schema": ("html", '<script type="application/ld+json">{"@context": "https://schema.org", "@type": "FAQPage", "mainEntity": [{"@type": "Question", "name": "…?", "acceptedAnswer": {"@type": "Answer", "text": "…"}}]}</script>'),
    "no_author": ("html", '<p class="byline">By <a rel="author" href="/team/…">First and last name</a></p>'),
    "no_date": ("html", '<p>Last updated: <time datetime="YYYY-MM-DD">…</time></p>'),
    "no_llms_txt": ("txt", "# Name of the site\n\n> One sentence on what it offers.\n\n## Pages\n\n- [Title](https://…): what it is about"),
    "ai_bots_blocked": ("robots", "\n".join(f"User-agent: {bot}" for bot, purpose in config.BOTS if purpose != "training") + "\nAllow: /"),
    "no_h1": ("html", "<h1>What this page is about</h1>"),
    "no_definitions": ("html", "<p><strong>Term</strong> is a … that …</p>"),
    "no_lists": ("html", "<ul>\n  <li>First point</li>\n  <li>Second point</li>\n</ul>"),
    "weak_semantic_html": ("html", "<header>…</header>\n<nav>…</nav>\n<main><article><section>…</section></article></main>\n<footer>…</footer>"),
    "few_entities": ("json-ld", '{"@context": "https://schema.org", "@type": "Organization", "@id": "https://…/#org", "name": "…", "logo": "https://…", "sameAs": ["https://…"]}'),
    "no_sourced_claims": ("html", '<p>… 42 % … (<a href="https://…">Publisher, 2024</a>)</p>'),
    "no_facts": ("html", "<p>… costs 1'200 … and saves 30 % …</p>"),
    "no_key_info_upfront": ("html", "<h1>…</h1>\n<p>The main point in one or two sentences.</p>"),
    "few_sections": ("html", "<h2>First part</h2>\n<p>…</p>\n<h2>Second part</h2>\n<p>…</p>"),
    "few_sources": ("html", '<p>Sources: <a href="https://…">Study by …</a>, <a href="https://…">Report of …</a></p>'),
    "canonical_missing": ("html", '<link rel="canonical" href="https://…/this-page">'),
    "weak_internal_links": ("html", '<a href="/topic">What the linked page is about</a>'),
}
#: Findings for which there is deliberately none: what to do depends on the page.
WITHOUT = ("canonical_mismatch", "bad_hierarchy", "js_only_content", "low_scanability", "faq_answers_hidden")


def with_snippets(findings: DataFrame) -> DataFrame:
    """Adds snippet (language, code) to findings with a column key; null where there is none."""
    table = F.create_map(*(x for key, (language, code) in SNIPPETS.items() for x in (F.lit(key), F.struct(F.lit(language).alias("language"), F.lit(code).alias("code")))))
    return findings.withColumn("snippet", F.try_element_at(table, F.col("key")))
