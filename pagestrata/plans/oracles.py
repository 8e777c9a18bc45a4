"""DuckDB SQL that gives the same rows as the queries of the same names."""

from __future__ import annotations

from .. import config
from . import made, page_oracles

VOWELS = "[aeiouyäöüáéíóúàèìòùâêîôûãõ]"
#: Character references that the titles and headings of the pages have.
UNESCAPED = "replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
HOST = r"regexp_extract(url, '^https?://([^/?#]+)', 1)"
PATH = r"regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
QUERY = r"regexp_extract(url, '^[^?#]*(\?[^#]*)', 1)"
SCHEME = "regexp_extract(url, '^(https?)://', 1)"
NO_SLASH = f"(CASE WHEN regexp_replace({PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({PATH}, '/+$', '') END)"
ROUND1 = "floor(({}) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE"
MEAN = "sum(CAST(floor(value * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT))::DOUBLE / count(value) / 100.0::DOUBLE"

WORDS = rf"""
WITH blocks AS (SELECT doc_id, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS b FROM documents),
clean AS (SELECT doc_id, lang, trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS b FROM blocks),
parts AS (SELECT doc_id, lang,
  list_filter(list_transform(string_split_regex(b, '\s+'), lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}-]', '', 'g')), lambda w: regexp_matches(w, '(?i){VOWELS}')) AS w,
  len(list_filter(string_split_regex(b, '[.!?…]+(?:\s|$)'), lambda s: trim(s) <> '')) AS s FROM clean),
counted AS (SELECT doc_id, lang, sum(len(w))::BIGINT AS words, sum(s)::BIGINT AS sentences, sum(len(list_filter(w, lambda x: length(x) > 6)))::BIGINT AS long_words, flatten(list(w)) AS w FROM parts GROUP BY ALL)
"""
LIX = "words / sentences::DOUBLE + long_words * 100.0::DOUBLE / words"

#: Patterns of a fact without look-around: the neighbouring character is matched instead.
NOT_LETTER, START, SPACE = r"(?:[^\p{L}]|$)", r"(?:^|[^\p{L}])", "[\\s ]"
NUMBER = r"\d+(?:[''’.,]\d+)*"
FACTS = [
    rf"(?i){NUMBER}{SPACE}?(?:%|‰|Prozent|percent|per cent|pour cent|por ciento|por cento|per cento)",
    rf"(?i){NUMBER}{SPACE}?(?:[TGMk]Wh|[TGMk]W|CHF|Fr\.|Franken|EUR|Euro|€|\$|USD|£|Mio\.?|Mrd\.?|Millionen|Milliarden|millions?|billions?|milliards?|Tonnen|tonnes?){NOT_LETTER}",
    rf"(?i){NUMBER}{SPACE}?(?:m[²³23]|km[²2]|km/h|qm|[kcm]?m|ha|[km]?g|ml|°{SPACE}?[CF]|Quadratmetern?|Kubikmetern?|Kilometern?|Metern?|Hektar|Kilogramm|Gramm|Litern?|Grad|square (?:metres?|meters?|feet)|sq\.? ?ft|(?:kilo)?met(?:re|er)s?|lit(?:re|er)s?|mètres?(?: carrés| cubes)?|kilomètres?|metros?(?: cuadrados| quadrados| cúbicos)?|quilômetros?|kilómetros?|metri(?: quadri| cubi)?|chilometri|litros?|litri)(?:[^\p{{L}}\d]|$)",
    rf"{START}(?:CHF|Fr\.|EUR|USD|€|\$|£){SPACE}?\d",
    "(?:^|[^\\d.,''’])\\d{1,3}(?:[''’   ]\\d{3})+(?:$|[^\\d''’   ]|[''’   ](?:[^\\d]|$))",
    rf"(?i){START}(?:laut|gemäss|gemäß|zufolge|according to|selon|según|secondo|segundo){NOT_LETTER}",
]
CITATIONS = [
    r"\(\p{Lu}[\p{L}\p{M}.''’&-]*(?:\s+[\p{L}\p{M}.''’&-]+){0,6},\s*\d{4}[a-z]?(?:,\s*S\.\s*\d+)?\)",
    r"\(\p{Lu}{2,}[\p{Lu}\d-]*\s+\d{4}[a-z]?\)",
    r"\(\p{Lu}[\p{L}\p{M}''’-]*\s+et\s+al\.\s+\d{4}[a-z]?\)",
    r"\[\d+(?:,\s*\d+)*\]",
    rf"(?i){START}(?:Quellen?|Sources?|Fuentes?|Fontes?)\s*[:\-–]",
]


def listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


HISTORY = f"""
WITH history AS (SELECT user_id AS url_norm, CAST(ts AS DATE) AS ts, {ROUND1.format(MEAN)} AS total_score FROM events GROUP BY 1, 2 HAVING avg(value) IS NOT NULL)
"""
RUNS = f"""
WITH half AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS middle FROM events),
rows_of AS (SELECT CASE WHEN epoch_us(ts) < (SELECT middle FROM half) THEN 'b' ELSE 'a' END AS side, '/' || user_id || '/' || coalesce(json_extract_string(props, '$.k'), '-') AS path, event_type AS key, value FROM events),
scores AS (SELECT side, path, {ROUND1.format(MEAN)} AS score, list_sort(list(DISTINCT key)) AS keys FROM rows_of GROUP BY ALL),
b AS (SELECT * FROM scores WHERE side = 'b'), a AS (SELECT * FROM scores WHERE side = 'a'),
common AS (SELECT a.path, b.score AS before, a.score AS after, {ROUND1.format('a.score - b.score')} AS delta, b.keys AS bk, a.keys AS ak,
  list_filter(a.keys, lambda k: list_contains(b.keys, k) AND a.score > length(k) * 5 AND NOT b.score > length(k) * 5) AS fixed,
  list_filter(a.keys, lambda k: list_contains(b.keys, k) AND NOT a.score > length(k) * 5 AND b.score > length(k) * 5) AS regressed,
  list_filter(b.keys, lambda k: NOT list_contains(a.keys, k)) AS ff, list_filter(a.keys, lambda k: NOT list_contains(b.keys, k)) AS fn FROM a JOIN b USING (path)),
keys AS (SELECT DISTINCT key FROM rows_of),
changes AS (SELECT key, length(key)::INTEGER AS priority, count(*) FILTER (list_contains(bk, key)) AS before, count(*) FILTER (list_contains(ak, key)) AS after,
  count(*) FILTER (list_contains(ff, key)) AS fixed, count(*) FILTER (list_contains(fn, key)) AS new FROM keys CROSS JOIN common GROUP BY 1, 2 HAVING before + after > 0),
open AS (SELECT key, count(DISTINCT path) AS page_count FROM rows_of WHERE side = 'a' GROUP BY 1)
"""

ORACLE_SQL: dict[str, str] = {
    "title_lengths": f"""
WITH t AS (SELECT page_id, length(trim(regexp_replace({UNESCAPED.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g'))) AS title_length FROM pages)
SELECT page_id, title_length, CAST(floor((CASE WHEN title_length = 0 THEN 0.0 WHEN title_length BETWEEN 30 AND 60 THEN 1.0::DOUBLE
  WHEN title_length < 30 THEN greatest(0.3::DOUBLE, title_length / 30.0::DOUBLE) ELSE greatest(0.3::DOUBLE, 1.0::DOUBLE - (title_length - 60) / 60.0::DOUBLE) END) * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS score_percent FROM t""",
    "h1_check": f"""
WITH h AS (SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1), lambda x: trim({UNESCAPED.format('x')})), lambda x: x <> '') AS h FROM pages)
SELECT page_id, len(h) AS n_h1, length(h[1]) AS h1_length FROM h""",
    "landmark_score": "SELECT page_id, CAST(floor(least(1.0, "
    + " + ".join(f"(CASE WHEN regexp_matches(html, '<{n}[ >]') THEN {s}::DOUBLE ELSE 0.0::DOUBLE END)" for n, s in config.SEMANTIC.items())
    + ") * 100.0::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS landmark_percent FROM pages",
    "url_keys": f"""
SELECT page_id, {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') AS history_key,
  (CASE WHEN length({PATH}) > 1 THEN regexp_replace({PATH}, '/+$', '') ELSE '/' END) || {QUERY} AS path,
  regexp_replace({HOST}, '^www\\.', '') || url_decode({NO_SLASH}) AS page_key, {SCHEME} || '://' || {HOST} || {NO_SLASH} AS canonical_key, {HOST} || {NO_SLASH} || {QUERY} AS link_key,
  lower(regexp_replace(string_split(url, '#')[1], '/$', '')) AS source_key, regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, {PATH} || {QUERY} AS robots_path FROM pages""",
    "pages_once": f"SELECT min(page_id) AS page_id, {SCHEME} || '://' || {HOST} || regexp_replace({PATH}, '/+$', '') AS history_key FROM pages GROUP BY 2",
    "site_overview": f"SELECT regexp_extract({HOST}, '([^.]+\\.[^.]+)$', 1) AS domain, count(*) AS pages, count(DISTINCT regexp_extract({PATH}, '^/([a-z]{{2}})/', 1)) AS languages, max(length(url)) AS longest_url FROM pages GROUP BY 1",
    "robots_verdict": f"""
SELECT page_id, concat_ws(',', CASE WHEN NOT starts_with({PATH}, '/en/') THEN 'GPTBot' END, CASE WHEN starts_with({PATH}, '/fr/') AND NOT starts_with({PATH}, '/fr/1') THEN 'Googlebot' END) AS blocked FROM pages""",
    "readability_lix": f"{WORDS} SELECT doc_id, words, sentences, long_words, CASE WHEN words > 0 AND sentences > 0 THEN {ROUND1.format(LIX)} END AS lix FROM counted",
    "readability_flesch": f"""{WORDS},
sounds AS (SELECT doc_id, words, sentences, list_sum(list_transform(list_transform(w, lambda x: lower(x)), lambda x: CASE WHEN length(x) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '{VOWELS}+'))
  - CASE WHEN len(regexp_extract_all(x, '{VOWELS}+')) > 1 AND regexp_matches(x, 'e$') AND NOT regexp_matches(x, '[aeiouy]e$') AND NOT regexp_matches(x, '[^aeiouy]le$') THEN 1 ELSE 0 END) END))::BIGINT AS syllables FROM counted WHERE lang = 'en')
SELECT doc_id, coalesce(syllables, 0) AS syllables, CASE WHEN words > 0 AND sentences > 0 THEN {ROUND1.format('greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences::DOUBLE) - 84.6::DOUBLE * (syllables / words::DOUBLE)))')} END AS flesch FROM sounds""",
    "content_language": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS w FROM documents),
n AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({listed(config.GERMAN_WORDS)}, x))) AS de, len(list_filter(w, lambda x: list_contains({listed(config.ENGLISH_WORDS)}, x))) AS en FROM t)
SELECT doc_id, CASE WHEN de + en < 5 THEN NULL WHEN de >= en * 2 THEN 'de' WHEN en >= de * 2 THEN 'en' END AS guess FROM n""",
    "fact_documents": "SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda b: " + " OR ".join(f"regexp_matches(b, '{p}')" for p in FACTS) + ")) AS fact_lines FROM documents",
    "citations": "SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in CITATIONS) + " AS citations FROM documents",
    "documents_once": "SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "trend_lag": f"""{HISTORY}, l AS (SELECT *, lag(total_score) OVER (PARTITION BY url_norm ORDER BY ts) AS previous_score FROM history),
d AS (SELECT *, {ROUND1.format('total_score - previous_score')} AS x FROM l)
SELECT url_norm, ts, total_score, previous_score, abs(x) AS delta, CASE WHEN x > 0 THEN 'up' WHEN x < 0 THEN 'down' WHEN x = 0 THEN 'flat' END AS direction FROM d""",
    "history_newest": f"{HISTORY} SELECT url_norm, ts, total_score, row_number() OVER (PARTITION BY url_norm ORDER BY ts DESC) AS position FROM history QUALIFY position <= 5",
    "history_overview": f"""{HISTORY} SELECT url_norm, ts AS last_ts, total_score AS last_score, {ROUND1.format('total_score - lead(total_score) OVER w')} AS delta, count(*) OVER (PARTITION BY url_norm) AS analysis_count
FROM history WINDOW w AS (PARTITION BY url_norm ORDER BY ts DESC) QUALIFY row_number() OVER w = 1""",
    "daily_reports": """WITH r AS (SELECT user_id AS url_norm, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2)
SELECT url_norm, CAST(ts AS DATE) AS day, event_id FROM r QUALIFY row_number() OVER (PARTITION BY url_norm, CAST(ts AS DATE) ORDER BY ts) = 1""",
    "asof_previous": f"""{HISTORY}, l AS (SELECT *, lag(ts) OVER w AS p, lag(total_score) OVER w AS previous_score FROM history WINDOW w AS (PARTITION BY url_norm ORDER BY ts)),
d AS (SELECT *, {ROUND1.format('total_score - previous_score')} AS x FROM l)
SELECT strftime(ts, '%Y-%m-%d') AS run_id, url_norm::VARCHAR AS path, total_score, strftime(p, '%Y-%m-%d') AS previous_run, previous_score, abs(x) AS delta, CASE WHEN x > 0 THEN 'up' WHEN x < 0 THEN 'down' WHEN x = 0 THEN 'flat' END AS direction FROM d""",
    "run_page_changes": f"{RUNS} SELECT path, before, after, delta, array_to_string(fixed, ',') AS fixed, array_to_string(regressed, ',') AS regressed, array_to_string(ff, ',') AS findings_fixed, array_to_string(fn, ',') AS findings_new FROM common",
    "run_finding_changes": f"{RUNS} SELECT * FROM changes",
    "run_pages_added": f"{RUNS} SELECT path FROM a WHERE path NOT IN (SELECT path FROM b)",
    "run_pages_removed": f"{RUNS} SELECT path FROM b WHERE path NOT IN (SELECT path FROM a)",
    "run_totals": f"{RUNS} SELECT count(*) AS pages, sum(len(ff))::BIGINT AS fixed, sum(len(fn))::BIGINT AS new, count(*) FILTER (delta > 0) AS pages_up, count(*) FILTER (delta < 0) AS pages_down, bool_or(delta < 0 OR len(fn) > 0 OR len(regressed) > 0) AS regression FROM common",
    "run_summaries": f"{RUNS} SELECT 'b' AS run_id, count(*) AS pages, count(*) AS analyzed, {ROUND1.format('avg(score)')} AS average_score FROM a",
    "ticket_plan": f"""{RUNS}, t AS (SELECT key, 'open' AS state, page_count, c.before, c.after FROM open LEFT JOIN changes c USING (key)
  UNION ALL SELECT key, 'resolved', 0, before, after FROM changes WHERE key NOT IN (SELECT key FROM open) AND before > 0)
SELECT key, state, length(key)::INTEGER AS priority, CASE WHEN length(key) >= 10 THEN 'high' WHEN length(key) >= 7 THEN 'medium' ELSE 'low' END AS level, page_count, before, after, key AS title, 'finding:example.org:' || key AS marker FROM t WHERE length(key) >= 5""",
    "sitemap_uniform": """
WITH d AS (SELECT 'https://' || event_type || '.example' AS origin, CASE WHEN event_id % 4 <> 0 THEN CASE WHEN event_type = 'click' THEN '2024-01-01' ELSE strftime(ts, '%Y-%m-%d') END END AS day FROM events),
n AS (SELECT origin, day, count(*) AS n FROM d GROUP BY ALL), s AS (SELECT origin, sum(n)::BIGINT AS entries, coalesce(sum(n) FILTER (day IS NOT NULL), 0)::DOUBLE AS dated, max(n) FILTER (day IS NOT NULL) AS top, max(day) AS newest FROM n GROUP BY 1)
SELECT origin, true AS "exists", false AS declared, entries, dated / entries::DOUBLE AS "lastmodShare", dated >= 10 AND top / dated >= 0.9e0 AS "lastmodUniform", entries AS pages, newest FROM s""",
    "definitions": f"SELECT doc_id, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda b: {page_oracles.has_definition('b')})) AS definition_lines FROM documents",
    "sentences": f"WITH c AS (SELECT doc_id, {page_oracles.sentences('text')} AS c FROM documents) SELECT doc_id, len(c) AS sentences, len(list_filter(c, lambda s: ends_with(s, '?'))) AS questions FROM c",
    "readability_bands": f"""{WORDS},
size AS (SELECT doc_id, length(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda b: {page_oracles.squeezed('b')}), lambda b: b <> ''), ' ')) AS n FROM documents),
sounds AS (SELECT *, list_sum(list_transform(list_transform(w, lambda x: lower(x)), lambda x: CASE WHEN length(x) <= 2 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '{VOWELS}+'))
  - CASE WHEN len(regexp_extract_all(x, '{VOWELS}+')) > 1 AND regexp_matches(x, 'e$') AND NOT regexp_matches(x, '[aeiouy]e$') AND NOT regexp_matches(x, '[^aeiouy]le$') THEN 1 ELSE 0 END) END))::BIGINT AS syllables FROM counted),
raw AS (SELECT coalesce(lang, '') = 'en' AS english, CASE WHEN lang = 'en' THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences::DOUBLE) - 84.6::DOUBLE * (syllables / words::DOUBLE))) ELSE {LIX} END AS raw FROM sounds JOIN size USING (doc_id) WHERE n >= 50 AND words > 0 AND sentences > 0)
SELECT CASE WHEN english THEN 'flesch' ELSE 'lix' END AS formula, CASE WHEN english THEN (CASE WHEN raw >= 80 THEN 'very_easy' WHEN raw >= 70 THEN 'easy' WHEN raw >= 60 THEN 'medium' WHEN raw >= 50 THEN 'hard' ELSE 'very_hard' END)
  ELSE (CASE WHEN raw < 30 THEN 'very_easy' WHEN raw < 40 THEN 'easy' WHEN raw < 50 THEN 'medium' WHEN raw < 60 THEN 'hard' ELSE 'very_hard' END) END AS band, count(*) AS documents FROM raw GROUP BY 1, 2""",
    "link_counts": """
WITH l AS (SELECT page_id, list_filter(regexp_extract_all(html, '<a href="([^"]*)"', 1), lambda h: h <> '' AND NOT starts_with(h, '#') AND (starts_with(h, '/') OR regexp_matches(h, '^https?://'))) AS l FROM pages)
SELECT page_id, len(l) AS n_links, len(list_distinct(list_transform(l, lambda h: regexp_replace(split_part(h, '#', 1), '/+$', '')))) AS n_targets, len(list_filter(l, lambda h: NOT starts_with(h, '/') OR starts_with(h, '//'))) AS n_external FROM l""",
    "cache_misses": "SELECT doc_id FROM documents WHERE (lang, sha256(text)) NOT IN (SELECT (lang, sha256(text)) FROM documents GROUP BY lang, sha256(text) HAVING count(*) > 1)",
    "rating_counts": f"WITH s AS (SELECT {ROUND1.format('c_acctbal / 333.0::DOUBLE')} AS x FROM customer) SELECT CASE WHEN x >= 25 THEN 'excellent' WHEN x >= 19 THEN 'good' WHEN x >= 12 THEN 'moderate' ELSE 'poor' END AS rating, count(*) AS customers FROM s GROUP BY 1",
}
ORACLE_SQL |= page_oracles.page_sql(FACTS, CITATIONS) | made.made_sql()
