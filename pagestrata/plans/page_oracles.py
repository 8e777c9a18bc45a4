"""DuckDB SQL for the scores of the table pages: records by regular expressions, then criteria, findings and sums as plain SQL.

The pages of that table have one heading, one article of paragraphs, a menu, and no metadata beyond a title; what they lack
is asked for all the same, so a page that had it would differ. Patterns with look-around are derived from those of
config by stated steps, since this SQL has none.
"""

from __future__ import annotations

from .. import config

#: What DuckDB's patterns write for the look-arounds that the fixed patterns have: the neighbouring character is matched.
LOOKS = ((r"(?![\p{L}])", r"(?:[^\p{L}]|$)"), (r"(?<![\p{L}])", r"(?:^|[^\p{L},;:])"), ("(?iu)", "(?i)"), ("(?u)", ""))
REFERENCES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&"))
WHITE = "[\\s\\x{0085}\\p{Z}]+"


def plain(pattern: str) -> str:
    for a, b in LOOKS:
        pattern = pattern.replace(a, b)
    return pattern.replace("'", "''")


def opener(pattern: str) -> tuple[list[str], str]:
    """What a pattern may not begin with, and the rest of it."""
    excluded = []
    pattern = pattern.removeprefix("^")
    while pattern.startswith("(?!"):
        depth, at = 0, 0
        for at, c in enumerate(pattern):
            depth += (c == "(" and pattern[at - 1] != "\\") - (c == ")" and pattern[at - 1] != "\\")
            if not depth:
                break
        excluded.append(pattern[3:at])
        pattern = pattern[at + 1 :]
    return excluded, "^" + pattern


def defines(sentence: str) -> str:
    """Whether a sentence defines a term."""
    cases = []
    for pattern in config.DEFINITIONS:
        excluded, rest = opener(pattern)
        cases.append(" AND ".join([f"regexp_matches({sentence}, '{plain(rest)}')"] + [f"NOT regexp_matches({sentence}, '^(?:{plain(x)})')" for x in excluded]))
    return f"(NOT ends_with({sentence}, '?') AND (" + " OR ".join(f"({c})" for c in cases) + "))"


def sentences(text: str) -> str:
    cut = f"string_split(regexp_replace({text}, '([.!?…]){WHITE}', '\\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: regexp_replace(s, '^{WHITE}|{WHITE}$', '', 'g')), lambda s: s <> '')"


def has_definition(text: str) -> str:
    return f"(len(list_filter({sentences(text)}, lambda s: {defines('s')})) > 0)"


def fact(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns) + ")"


def structured(text: str) -> str:
    """Whether a paragraph begins like a step."""
    numbered = rf"(regexp_matches({text}, '^\d{{1,2}}[.)]\s+[^\d\s]') AND NOT regexp_matches({text}, '^\d{{1,2}}[.)]\s+{config.MONTH_NAMES}\.?(?:[^\p{{L}}]|$)'))"
    return f"({numbered} OR regexp_matches({text}, '^[-*•]\\s+') OR " + " OR ".join(f"regexp_matches({text}, '{plain(p)}')" for p in config.STEPS[2:]) + ")"


def unescaped(text: str) -> str:
    for a, b in REFERENCES:
        text = f"replace({text}, '{a}', '{b}')"
    return text


def squeezed(text: str) -> str:
    return f"trim(regexp_replace({text}, '{WHITE}', ' ', 'g'))"


def half_up(x: str) -> str:
    return f"floor({x} + 0.5e0)::BIGINT"


def round1(x: str) -> str:
    return f"floor(({x}) * 10.0e0 + 0.5e0) / 10.0e0"


def percent(score: str) -> str:
    return half_up(f"({score}) * 100.0e0")


def shown(score: str) -> str:
    return f"{percent(score)}::VARCHAR || '%'"


VOWELS = "[aeiouyäöüáéíóúàèìòùâêîôûãõ]"
LABELS = "de|en|fr|it|es|pt|nl|rm|deutsch|english|français|francais|italiano|español|espanol|português|portugues|nederlands|rumantsch"


SYLLABLES = f"(CASE WHEN length(x) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(lower(x), '{VOWELS}+')) - CASE WHEN len(regexp_extract_all(lower(x), '{VOWELS}+')) > 1 AND regexp_matches(lower(x), 'e$') AND NOT regexp_matches(lower(x), '[aeiouy]e$') AND NOT regexp_matches(lower(x), '[^aeiouy]le$') THEN 1 ELSE 0 END) END)"


def records(facts: list[str]) -> str:
    """CTEs up to m: a row a page with what its criteria read. facts: the patterns of a fact without look-around."""
    text = squeezed(unescaped("regexp_replace(x, '<[^>]*>', ' ', 'g')"))
    prefix = f"regexp_extract(%s, '(?i)^/({config.LANGUAGE_CODES})(?:[-_][a-z]{{2,4}})?(?:/|$)', 1)"
    own = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
    return f"""
WITH raw AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS body FROM pages),
r AS (SELECT *, lower(regexp_extract(html, '<html lang="([a-z]+)', 1)) AS lang, {squeezed(unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"))} AS title,
  list_filter(list_transform(regexp_extract_all(body, '(?s)<h1>(.*?)</h1>', 1), lambda x: {text}), lambda x: x <> '') AS h1,
  len(regexp_extract_all(body, '<h[23][ >]')) AS subs, len(regexp_extract_all(body, '<h[2-6][ >]')) AS heads, len(regexp_extract_all(body, '<[uo]l[ >]')) AS lists,
  len(regexp_extract_all(html, '<img[ >]')) AS images, regexp_extract_all(html, '(?s)<nav>.*?</nav>')[1] AS menu,
  list_transform(list_filter(string_split(regexp_replace(body, '(?s)</p>', '<p>', 'g'), '<p>'), lambda x: x <> ''), lambda x: {text}) AS parts FROM raw),
p AS (SELECT *, list_filter(parts, lambda x, i: length(x) > 30 AND NOT list_contains(h1, x) AND list_position(parts, x) = i) AS ps FROM r),
q AS (SELECT *, list_filter(ps, lambda x: length(x) >= 80) AS solid, regexp_replace(regexp_replace(list_aggregate(ps, 'string_agg', ' '), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g') AS flow,
  list_filter(flatten(list_transform(ps, lambda x: list_transform(string_split_regex(x, '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}-]', '', 'g')))), lambda w: regexp_matches(w, '(?i){VOWELS}')) AS w,
  list_sum(list_transform(ps, lambda x: len(list_filter(string_split_regex(x, '[.!?…]+(?:\\s|$)'), lambda s: trim(s) <> '')))) AS s,
  list_filter(ps, lambda t: NOT (h1[1] IS NOT NULL AND lower(h1[1]) <> '' AND (lower(t) = lower(h1[1]) OR (contains(lower(h1[1]), lower(t)) AND length(t) < length(h1[1]) + 20))) AND len(string_split(lower(t), ' ')) >= 8) AS leads,
  len(list_filter(list_zip(regexp_extract_all(coalesce(menu, ''), '<a href="([^"]*)">([^<]*)</a>', 1), regexp_extract_all(coalesce(menu, ''), '<a href="([^"]*)">([^<]*)</a>', 2)),
    lambda a: regexp_matches(trim(a[2]), '(?i)^(?:{LABELS})$') AND {prefix % 'a[1]'} <> '' AND lower({prefix % 'a[1]'}) <> lower({prefix % own}))) AS switches FROM p),
t AS (SELECT *, list_slice(CASE WHEN len(leads) > 0 THEN leads ELSE ps END, 1, 3) AS first3 FROM q),
u AS (SELECT *, coalesce(array_to_string(list_slice(list_filter(string_split(array_to_string(first3, ' '), ' '), lambda x: x <> ''), 1, 150), ' '), '') AS start FROM t),
m AS (SELECT *, len(h1) AS n1, length(h1[1]) AS h1_length, len(solid) AS n, list_sum(list_transform(solid, lambda x: length(x)))::DOUBLE / nullif(len(solid), 0)::DOUBLE AS mean, len(ps) AS n_ps,
  len(w) AS words, len(list_filter(w, lambda x: length(x) > 6)) AS longs, list_sum(list_transform(w, lambda x: {SYLLABLES}))::DOUBLE AS sounds,
  len(list_filter(ps, lambda x: {has_definition('x')})) AS defining, len(list_filter(ps, lambda x: {structured('x')})) AS steps, len(list_filter(ps, lambda x: {fact('x', facts)})) AS facts,
  length(first3[1]) AS lead_length, {has_definition('start')} AS defined, {fact('start', facts)} AS figure, length(title) AS title_length FROM u)
"""


RAW = "(CASE WHEN length(array_to_string(ps, ' ')) >= 50 AND words > 0 AND s > 0 THEN (CASE WHEN lang = 'en' THEN greatest(0.0e0, least(100.0e0, 206.835e0 - 1.015e0 * (words::DOUBLE / s::DOUBLE) - 84.6e0 * (sounds / words::DOUBLE))) ELSE words::DOUBLE / s::DOUBLE + longs * 100.0e0 / words::DOUBLE END) END)"
CLAMP = "greatest(0.0e0, least(1.0e0, {}))"
TITLE = "(CASE WHEN title_length = 0 THEN 0.0e0 WHEN title_length BETWEEN 30 AND 60 THEN 1.0e0 WHEN title_length < 30 THEN greatest(0.3e0, title_length / 30.0e0) ELSE greatest(0.3e0, 1.0e0 - (title_length - 60) / 60.0e0) END)"


def no(pattern: str) -> str:
    return f"NOT regexp_matches(html, '{pattern}')"


#: Scores by criterion, where it isn't told that a page has none of what the criterion looks for.
SCORES = f"""
s AS (SELECT *, CASE WHEN n1 = 1 AND h1_length BETWEEN 5 AND 150 THEN 1.0e0 WHEN n1 > 0 THEN 0.5e0 ELSE 0.0e0 END AS s_h1,
  CASE WHEN n1 + heads = 0 THEN 0.0e0 WHEN n1 = 0 THEN least(0.6e0, 1.0e0 - (0.4e0 + CASE WHEN subs < 2 THEN 0.1e0 ELSE 0.0e0 END)) ELSE 1.0e0 - ((CASE WHEN n1 > 1 THEN 0.1e0 ELSE 0.0e0 END) + (CASE WHEN subs < 2 THEN 0.1e0 ELSE 0.0e0 END)) END AS s_hierarchy,
  least(1.0e0, (CASE WHEN n >= 3 THEN 0.3e0 WHEN n >= 1 THEN 0.075e0 ELSE 0.0e0 END) + (CASE WHEN n = 0 THEN 0.0e0 WHEN mean < 300 THEN 0.25e0 WHEN mean < 500 THEN 0.15e0 WHEN mean < 800 THEN 0.05e0 ELSE 0.0e0 END)
    + (CASE WHEN lists >= 2 THEN 0.25e0 WHEN lists >= 1 THEN 0.15e0 ELSE 0.0e0 END) + (CASE WHEN n + lists = 0 THEN 0.0e0 WHEN subs::DOUBLE / (n + lists)::DOUBLE BETWEEN 0.2e0 AND 1.0e0 THEN 0.2e0 WHEN subs::DOUBLE / (n + lists)::DOUBLE BETWEEN 0.1e0 AND 2.0e0 THEN 0.1e0 ELSE 0.0e0 END)) AS s_scannable,
  {RAW} AS raw, CASE WHEN lang = 'en' THEN {CLAMP.format(f"({RAW} - 30) / 60.0e0")} ELSE {CLAMP.format(f"(65.0e0 - {RAW}) / 25.0e0")} END AS s_readability,
  least(1.0e0, defining / 3.0e0) * 0.7e0 + least(1.0e0, steps / 2.0e0) * 0.3e0 AS s_definitions, least(1.0e0, lists / 3.0e0) AS s_lists,
  least(1.0e0, heads / 3.0e0) * (CASE WHEN n_ps >= 3 THEN 1.0e0 ELSE 0.5e0 END) AS s_sections,
  least(1.0e0, {' + '.join(["0.0e0"] + [f"(CASE WHEN regexp_matches(html, '<{tag}[ >]') THEN {share}e0 ELSE 0.0e0 END)" for tag, share in config.SEMANTIC.items()])}) AS s_semantic,
  least(1.0e0, facts / 4.0e0) AS s_facts,
  CASE WHEN start = '' THEN 0.0e0 ELSE least(1.0e0, ((((CASE WHEN h1_length >= 5 THEN 0.2e0 ELSE 0.0e0 END) + (CASE WHEN lead_length < 500 THEN 0.15e0 ELSE 0.0e0 END)) + 0.0e0) + (CASE WHEN defined THEN 0.3e0 ELSE 0.0e0 END)) + (CASE WHEN figure THEN 0.2e0 ELSE 0.0e0 END)) END AS s_upfront,
  {TITLE} AS s_title,
  {no('application/ld.json|itemscope|typeof=|name="author"|property="article:author"|rel="author"|itemprop="author"|byline')} AS nobody,
  {no('<time|article:published_time|datePublished|application/ld.json|class="[^"]*date')} AS undated,
  {no('<meta name="description"')} AS undescribed, {no('<meta name="viewport"')} AS unsized, {no('rel="canonical"')} AS uncanonical, {no('property="og:|name="twitter:|name="og:')} AS uncarded,
  {no('<meta name="robots"|<meta name="googlebot"|data-nosnippet')} AS indexable, len(regexp_extract_all(body, '<a href')) = 0 AS unlinked, {no('<details|aria-expanded|faq|accordion')} AS no_questions, {no('application/ld.json|itemscope|typeof=')} AS no_schema FROM m)
"""

#: Criteria in order: category, name, score, found, value, whether its progress is complete, when it is there.
ROWS = [
    ("contentClarity", "h1", "s_h1", "s_h1 = 1", "CASE WHEN n1 = 0 THEN 'notPresent' WHEN s_h1 = 1 THEN 'present' ELSE 'h1Optimal' END", "s_h1 >= 1", None),
    ("contentClarity", "hierarchy", "s_hierarchy", "s_hierarchy > 0.6e0", shown("s_hierarchy"), f"{percent('s_hierarchy')} >= 100", None),
    ("contentClarity", "scannable", "s_scannable", "s_scannable > 0.5e0", shown("s_scannable"), f"{percent('s_scannable')} >= 100", None),
    ("contentClarity", "readability", "s_readability", "s_readability >= 0.5e0", f"{half_up('raw')}::VARCHAR || CASE WHEN lang = 'en' THEN ' Flesch' ELSE ' LIX' END", f"{percent('s_readability')} >= 100", "raw IS NOT NULL"),
    ("answerability", "definitions", "s_definitions", "s_definitions > 0.3e0", shown("s_definitions"), f"{percent('s_definitions')} >= 100", None),
    ("answerability", "lists", "s_lists", "lists >= 1", "'lists'", "lists >= 3", None),
    ("answerability", "sections", "s_sections", "heads >= 3 AND n_ps >= 3", "'subheadings'", "heads >= 3", None),
    ("trustSources", "author", "CASE WHEN nobody THEN 0.0e0 END", "NOT nobody", "'notRecognizable'", "NOT nobody", None),
    ("trustSources", "date", "CASE WHEN undated THEN 0.0e0 END", "NOT undated", "'noDateFound'", "NOT undated", None),
    ("trustSources", "sources", "CASE WHEN unlinked THEN 0.0e0 END", "NOT unlinked", "'sourceLinks'", "NOT unlinked", None),
    ("machineReadability", "schema", "CASE WHEN no_schema THEN 0.0e0 END", "NOT no_schema", "'noneFound'", "NOT no_schema", None),
    ("machineReadability", "entities", "CASE WHEN nobody THEN 0.0e0 END", "NOT nobody", "'0%'", "NOT nobody", None),
    ("machineReadability", "semanticHtml", "s_semantic", "s_semantic > 0.5e0", shown("s_semantic"), f"{percent('s_semantic')} >= 100", None),
    ("machineReadability", "internalLinks", "CASE WHEN unlinked THEN 0.0e0 END", "NOT unlinked", "'notPresent'", "NOT unlinked", None),
    ("machineReadability", "llmsTxt", "0.0e0", "false", "'notFound'", "false", None),
    ("machineReadability", "robotsTxt", "1.0e0", "true", "'allBotsAllowed'", "true", None),
    ("aiCitation", "facts", "s_facts", "s_facts > 0.3e0", shown("s_facts"), f"{percent('s_facts')} >= 100", None),
    ("aiCitation", "faq", "CASE WHEN no_questions THEN 0.0e0 END", "NOT no_questions", "'0%'", "NOT no_questions", None),
    ("aiCitation", "sourcedClaims", "least(1.0e0, least(0.5e0, cited / 4.0e0))", "least(1.0e0, least(0.5e0, cited / 4.0e0)) > 0.3e0", shown("least(1.0e0, least(0.5e0, cited / 4.0e0))"), "false", None),
    ("aiCitation", "keyInfoUpfront", "s_upfront", "s_upfront > 0.5e0", shown("s_upfront"), f"{percent('s_upfront')} >= 100", None),
    ("onPageSeo", "title_quality", "s_title", "s_title >= 0.7e0", "CASE WHEN title_length = 0 THEN 'notPresent' ELSE 'chars' END", f"{percent('s_title')} >= 100", None),
    ("onPageSeo", "meta_description", "CASE WHEN undescribed THEN 0.0e0 END", "NOT undescribed", "'notPresent'", "NOT undescribed", None),
    ("onPageSeo", "image_alts", "CASE WHEN images = 0 THEN 1.0e0 END", "images = 0", "'noImages'", "images = 0", None),
    ("onPageSeo", "indexability", "CASE WHEN indexable THEN 1.0e0 END", "indexable", "'indexable'", "indexable", None),
    ("onPageSeo", "viewport", "CASE WHEN unsized THEN 0.0e0 END", "NOT unsized", "'notPresent'", "NOT unsized", None),
    ("onPageSeo", "social_cards", "CASE WHEN uncarded THEN 0.0e0 END", "NOT uncarded", "'socialCardsMissing'", "NOT uncarded", None),
    ("onPageSeo", "canonical", "CASE WHEN uncanonical THEN 0.0e0 END", "NOT uncanonical", "'notPresent'", "NOT uncanonical", None),
    ("onPageSeo", "hreflang", "0.0e0", "false", "'notPresent'", "false", "switches > 0"),
]
#: Findings in order, with what makes them.
FIRED = [
    ("no_h1", "NOT s_h1 = 1"), ("bad_hierarchy", "NOT s_hierarchy > 0.6e0"), ("low_scanability", "NOT s_scannable > 0.5e0"), ("low_readability", "raw IS NOT NULL AND s_readability < 0.5e0"),
    ("no_definitions", "NOT s_definitions > 0.3e0"), ("no_lists", "lists < 1"), ("few_sections", "NOT (heads >= 3 AND n_ps >= 3)"), ("no_author", "nobody"), ("no_date", "undated"), ("few_sources", "unlinked"),
    ("no_schema", "no_schema"), ("few_entities", "nobody"), ("weak_semantic_html", "NOT s_semantic > 0.5e0"), ("weak_internal_links", "unlinked"), ("no_llms_txt", "true"),
    ("no_facts", "NOT s_facts > 0.3e0"), ("no_faq", "no_questions"), ("no_sourced_claims", "NOT least(1.0e0, least(0.5e0, cited / 4.0e0)) > 0.3e0"), ("no_key_info_upfront", "NOT s_upfront > 0.5e0"),
    ("hreflang_missing", "switches > 0"), ("title_missing", "title_length = 0"), ("title_too_short", "title_length BETWEEN 1 AND 29"), ("title_too_long", "title_length > 60"),
    ("description_missing", "undescribed"), ("viewport_missing", "unsized"), ("social_cards_missing", "uncarded"), ("canonical_missing", "uncanonical"),
]


def scored(facts: list[str], citations: list[str]) -> str:
    cited = " + ".join(f"len(regexp_extract_all(array_to_string(ps, ' '), '{p}'))" for p in citations)
    return records(facts).replace(", length(title) AS title_length FROM u)", f", length(title) AS title_length, {cited} AS cited FROM u)") + "," + SCORES


def criteria_rows() -> str:
    made = [
        f"CASE WHEN {there or 'true'} THEN {{'category': '{category}', 'criterion': '{name}', 'points': ({score}) * {config.WEIGHTS[name]}e0, 'weight': {config.WEIGHTS[name]}e0, 'found': ({found}), 'met': ({found}) AND ({complete}), 'value': {value}}} END"
        for category, name, score, found, value, complete, there in ROWS
    ]
    return "list_filter([" + ",\n".join(made) + "], lambda x: x IS NOT NULL)"


def page_sql(facts: list[str], citations: list[str]) -> dict[str, str]:
    """SQL by query."""
    base = scored(facts, citations)
    known = {key: of for key, *of in config.FINDINGS}
    rows = f"{base}, c AS (SELECT page_id, url, unnest({criteria_rows()}) AS c FROM s)"
    ranked = ",\n".join(f"CASE WHEN {when} THEN {{'rank': {-known[key][0]}, 'at': {i}, 'key': '{key}', 'priority': {known[key][0]}, 'owner': '{known[key][1]}', 'effort': '{known[key][2]}'}} END" for i, (key, when) in enumerate(FIRED))
    found = f"{base}, f AS (SELECT page_id, list_sort(list_filter([{ranked}], lambda x: x IS NOT NULL)) AS f FROM s)"
    each = []
    for category in config.CATEGORIES:
        own = [(score, config.WEIGHTS[name], there) for c, name, score, _, _, _, there in ROWS if c == category]
        points = "0.0e0" + "".join(f" + CASE WHEN {there or 'true'} THEN ({score}) * {weight}e0 ELSE 0.0e0 END" for score, weight, there in own)
        weight = "0.0e0" + "".join(f" + CASE WHEN {there or 'true'} THEN {weight}e0 ELSE 0.0e0 END" for _, weight, there in own)
        each.append(f"{round1(f'greatest(0.0e0, least(5.0e0, ({points}) / ({weight}) * 5.0e0))')} AS {category}")
    totals = f"{base}, t2 AS (SELECT page_id, url, {', '.join(each)} FROM s), t3 AS (SELECT *, {round1(' + '.join(config.CATEGORIES))} AS total FROM t2)"
    rating = "CASE WHEN total >= 25 THEN 'excellent' WHEN total >= 19 THEN 'good' WHEN total >= 12 THEN 'moderate' ELSE 'poor' END"
    flagship = f"""{totals} SELECT page_id, url, 'other' AS "pageType", total AS "totalScore", {rating} AS rating, {', '.join(f'{c} AS "{c}"' for c in config.CATEGORIES)} FROM t3"""
    status = "CASE WHEN c.met THEN 'ok' WHEN c.found OR c.points > 0 THEN 'partial' ELSE 'fail' END"
    own_words = f"list_filter(list_transform(string_split_regex(t, '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}-]', '', 'g')), lambda w: regexp_matches(w, '(?i){VOWELS}'))"
    own_raw = RAW.replace("array_to_string(ps, ' ')", "t").replace("words", "len(v)").replace("AND s > 0", "AND z > 0").replace("s::DOUBLE", "z::DOUBLE").replace("longs", "len(list_filter(v, lambda x: length(x) > 6))").replace("sounds", f"list_sum(list_transform(v, lambda x: {SYLLABLES}))::DOUBLE")
    bands = "CASE WHEN lang = 'en' THEN (CASE WHEN own >= 80 THEN 'very_easy' WHEN own >= 70 THEN 'easy' WHEN own >= 60 THEN 'medium' WHEN own >= 50 THEN 'hard' ELSE 'very_hard' END) ELSE (CASE WHEN own < 30 THEN 'very_easy' WHEN own < 40 THEN 'easy' WHEN own < 50 THEN 'medium' WHEN own < 60 THEN 'hard' ELSE 'very_hard' END) END"
    low = "CASE WHEN lang = 'en' THEN (own - 30) / 60.0e0 < 0.5e0 ELSE (65.0e0 - own) / 25.0e0 < 0.5e0 END"
    uncited = " AND ".join(f"NOT regexp_matches(t, '{c}')" for c in citations)
    marks = [
        ("low_scanability", "'long_paragraph'", "length(t)::VARCHAR", "length(t) > 500"),
        ("no_key_info_upfront", "'key_info'", "NULL", "nth = 1"),
        ("no_sourced_claims", "'unsourced_claim'", "NULL", f"{fact('t', facts)} AND {uncited}"),
        ("low_readability", f"'read_band_' || {bands}", "own::VARCHAR", low),
    ]
    fires = dict(FIRED)
    targets = f"""{base}, e AS (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s), g AS (SELECT *, parts[i] AS t FROM e WHERE i > 1 AND list_contains(ps, parts[i]) AND list_position(parts, parts[i]) = i),
o AS (SELECT *, CASE WHEN len(parts) = 2 THEN 'body > article > p' ELSE 'body > article > p:nth-of-type(' || (i - 1) || ')' END AS path, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, {own_words} AS v, len(list_filter(string_split_regex(t, '[.!?…]+(?:\\s|$)'), lambda s: trim(s) <> '')) AS z FROM g),
own AS (SELECT *, {own_raw} AS own FROM o) """ + " UNION ALL ".join(f"SELECT page_id, '{key}' AS finding, path, {label} AS label, {value} AS value FROM own WHERE ({fires[key]}) AND ({when})" for key, label, value, when in marks)
    return {
        "flagship": flagship,
        "page_targets": targets,
        "worst_pages": f'{flagship} ORDER BY "totalScore", url, page_id LIMIT 100',
        "page_criteria": f"{rows} SELECT page_id, c.category AS category, c.criterion AS criterion, c.points AS points, c.weight AS weight, c.found AS found, c.met AS met, c.value AS value FROM c",
        "page_findings": f"{found}, g AS (SELECT page_id, unnest(f) AS x, unnest(range(len(f))) AS i FROM f) SELECT page_id, i::INTEGER AS ordinal, x.key AS key, x.priority::INTEGER AS priority, x.owner AS owner, x.effort AS effort FROM g",
        "page_status": f"{rows}, k AS (SELECT page_id, count(*) FILTER ({status} = 'fail') AS fail, count(*) FILTER ({status} = 'partial') AS partial, count(*) FILTER ({status} = 'ok') AS ok FROM c GROUP BY 1),\n"
        + found.split("WITH ", 1)[1].split(", f AS (", 1)[1].join(["f AS (", ""])
        + " SELECT k.page_id, fail::INTEGER AS fail, partial::INTEGER AS partial, ok::INTEGER AS ok, len(list_filter(f, lambda x: x.owner = 'editorial'))::INTEGER AS editorial, len(list_filter(f, lambda x: x.owner = 'dev'))::INTEGER AS dev FROM k JOIN f USING (page_id)",
        "page_records": f"""{base} SELECT page_id, lang, (n1 + heads)::INTEGER AS n_headings, n_ps::INTEGER AS n_paragraphs, len(regexp_extract_all(html, '<a href="'))::INTEGER AS n_links,
  length({squeezed(unescaped("regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->', '', 'g'), '(?s)<(?:script|style)>.*?</(?:script|style)>', '', 'g'), '<[^>]*>', '', 'g')"))})::INTEGER AS n_chars FROM s""",
    }
