"""Spark types of the engine's records."""

from __future__ import annotations

PAGE_RECORD = """
headings ARRAY<STRUCT<level: INT, text: STRING>>, paragraphs ARRAY<STRING>,
lists ARRAY<STRUCT<type: STRING, itemCount: INT, items: ARRAY<STRING>>>,
links ARRAY<STRUCT<href: STRING, text: STRING, isExternal: BOOLEAN, isNavigational: BOOLEAN>>,
meta STRUCT<title: STRING, description: STRING, author: STRING, publishDate: STRING, modifiedDate: STRING, ogType: STRING>,
schema ARRAY<STRING>, schemaTypes ARRAY<STRING>, schemaDates ARRAY<STRUCT<kind: STRING, date: TIMESTAMP>>,
identity STRUCT<org_name: STRING, org_verifiable: BOOLEAN, org_unnamed: BOOLEAN, person_named: BOOLEAN, person_verifiable: BOOLEAN, topic: BOOLEAN, linked_graph: BOOLEAN>,
completeness STRUCT<found: INT, total: INT, gaps: ARRAY<STRUCT<type: STRING, missing: ARRAY<STRING>>>, complete: ARRAY<STRING>, unnamed_author: BOOLEAN>,
product STRUCT<products: INT, variants: INT, price: BOOLEAN, availability: BOOLEAN, identifier: BOOLEAN, sku: BOOLEAN, brand: BOOLEAN, image: BOOLEAN, description: BOOLEAN, rating: BOOLEAN, shipping: BOOLEAN>,
business STRUCT<type: STRING, name: STRING, address_fields: ARRAY<STRING>, postal_code: STRING, telephone: STRING, hours: BOOLEAN, geo: BOOLEAN>,
author STRUCT<name: STRING, source: STRING>, dates ARRAY<STRUCT<date: TIMESTAMP, formatted: STRING, source: STRING>>,
semanticElements STRUCT<hasArticle: BOOLEAN, hasMain: BOOLEAN, hasNav: BOOLEAN, hasAside: BOOLEAN, hasHeader: BOOLEAN, hasFooter: BOOLEAN, hasSection: BOOLEAN>,
faqQuestions ARRAY<STRING>, faqAnswersHidden INT, questionAnswers ARRAY<STRUCT<question: STRING, answer: STRING>>,
leadSummary STRUCT<heading: STRING, items: ARRAY<STRING>, paragraphsBefore: INT>, lang STRING,
images ARRAY<STRUCT<src: STRING, alt: STRING, hasAltAttribute: BOOLEAN>>,
openGraph STRUCT<title: STRING, description: STRING, image: STRING, url: STRING, type: STRING>,
twitterCard STRUCT<card: STRING, title: STRING, description: STRING, image: STRING>,
robotsMeta STRUCT<hasNoIndex: BOOLEAN, hasNoFollow: BOOLEAN, hasNoArchive: BOOLEAN, hasNoSnippet: BOOLEAN, rawContent: STRING, headerContent: STRING, maxSnippet: INT, noSnippetShare: DOUBLE>,
viewport STRUCT<hasViewport: BOOLEAN, hasDeviceWidth: BOOLEAN, userScalableNo: BOOLEAN, rawContent: STRING>,
canonical STRING, hreflang STRUCT<alternates: ARRAY<STRUCT<hreflang: STRING, href: STRING>>, languageLinks: ARRAY<STRING>>,
tables ARRAY<STRUCT<rows: INT, cols: INT, hasHeader: BOOLEAN, caption: STRING>>,
local STRUCT<addresses: ARRAY<STRING>, postalCodes: ARRAY<STRING>, phones: ARRAY<STRING>, hasOpeningHours: BOOLEAN>,
crawler STRUCT<chars: INT, headings: ARRAY<STRING>, hasH1: BOOLEAN, schemaBlocks: INT, hasPassword: BOOLEAN>,
bingMeta BOOLEAN,
paths STRUCT<headings: ARRAY<STRING>, paragraphs: ARRAY<STRUCT<path: STRING, sourced: BOOLEAN>>, images: ARRAY<STRING>>
""".replace("\n", " ").strip()

#: Optional inputs of a page: null means that the check did not run, and its criterion is absent.
PAGE_INPUTS = """
llmsTxt STRUCT<exists: BOOLEAN, contentLength: INT, fullExists: BOOLEAN, fullContentLength: INT>,
robotsTxt STRUCT<exists: BOOLEAN, unreachable: BOOLEAN, httpStatus: INT, path: STRING, blockedBots: ARRAY<STRING>, checkedBots: ARRAY<STRING>, signals: MAP<STRING, STRING>>,
botAccess STRUCT<checked: ARRAY<STRING>, blocked: ARRAY<STRING>>,
crawlerView STRUCT<status: STRING, coverage: DOUBLE, renderedChars: INT, rawChars: INT, missingHeadings: ARRAY<STRING>>,
sitemap STRUCT<exists: BOOLEAN, declaredInRobots: BOOLEAN, listed: BOOLEAN, pageLastmod: STRING, entries: BIGINT, lastmodShare: DOUBLE, lastmodUniform: BOOLEAN>
""".replace("\n", " ").strip()
