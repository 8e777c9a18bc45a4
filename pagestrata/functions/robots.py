"""robots.txt, X-Robots-Tag and Content-Signal: groups, rules and verdicts as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .numbers import size

RULE = "struct<kind: string, path: string>"
GROUP = f"struct<agents: array<string>, rules: array<{RULE}>, signals: map<string, string>>"
STATE = f"struct<done: array<{GROUP}>, agents: array<string>, rules: array<{RULE}>, signals: map<string, string>, ruled: boolean>"
NO_SIGNALS = "map<string,string>"


def looks_like_html(body: Column) -> Column:
    return body.rlike(r"(?i)^\s*(<!DOCTYPE|<html|<head)")


def lines(body: Column) -> Column:
    """Fields of a robots.txt: name in lower case and value, without comments."""
    plain = F.transform(F.split(body, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))
    kept = F.filter(plain, lambda x: x.contains(":"))
    return F.transform(kept, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))).alias("name"), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)).alias("value")))


def content_signals(value: Column) -> Column:
    """name=yes or name=no, comma-separated; a later one replaces an earlier."""
    parts = F.filter(F.transform(F.split(F.lower(value), ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^[a-z-]+\s*=\s*(yes|no)$"))
    pairs = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^([a-z-]+)", 1), F.regexp_extract(p, "(yes|no)$", 1)))
    return F.aggregate(pairs, F.create_map().cast(NO_SIGNALS), lambda m, p: merged(m, F.map_from_entries(F.array(p))))


def merged(a: Column, b: Column) -> Column:
    """Both maps; the second one wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def groups(body: Column) -> Column:
    """User agents with their rules and signals. A group ends at the agent line that follows a rule."""
    none = F.lit(None).cast(NO_SIGNALS)
    start = F.struct(F.array().cast(f"array<{GROUP}>").alias("done"), F.array().cast("array<string>").alias("agents"), F.array().cast(f"array<{RULE}>").alias("rules"), none.alias("signals"), F.lit(False).alias("ruled")).cast(STATE)

    def closed(s: Column) -> Column:
        own = F.struct(s["agents"].alias("agents"), s["rules"].alias("rules"), s["signals"].alias("signals"))
        return F.when(size(s["agents"]) > 0, F.concat(s["done"], F.array(own))).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        fresh = (x["name"] == "user-agent") & s["ruled"]
        agent = F.struct(
            F.when(fresh, closed(s)).otherwise(s["done"]).alias("done"), F.when(fresh, F.array(F.lower(x["value"]))).otherwise(F.array_append(s["agents"], F.lower(x["value"]))).alias("agents"),
            F.when(fresh, F.array().cast(f"array<{RULE}>")).otherwise(s["rules"]).alias("rules"), F.when(fresh, none).otherwise(s["signals"]).alias("signals"), F.lit(False).alias("ruled"),
        ).cast(STATE)
        rule = F.struct(s["done"].alias("done"), s["agents"].alias("agents"), F.array_append(s["rules"], F.struct(x["name"].alias("kind"), x["value"].alias("path"))).alias("rules"), s["signals"].alias("signals"), F.lit(True).alias("ruled")).cast(STATE)
        signal = F.struct(s["done"].alias("done"), s["agents"].alias("agents"), s["rules"].alias("rules"), merged(F.coalesce(s["signals"], F.create_map().cast(NO_SIGNALS)), content_signals(x["value"])).alias("signals"), s["ruled"].alias("ruled")).cast(STATE)
        known = size(s["agents"]) > 0
        return F.when(x["name"] == "user-agent", agent).when(x["name"].isin("allow", "disallow") & known, rule).when((x["name"] == "content-signal") & known, signal).otherwise(s)

    return F.aggregate(lines(body), start, step, closed)


def rule_regex(path: Column) -> Column:
    """A rule's path as a regular expression: * is anything, a final $ the end."""
    anchored = path.endswith("$")
    body = F.when(anchored, F.regexp_replace(path, r"\$$", "")).otherwise(path)
    quoted = F.array_join(F.transform(F.split(body, r"\*", -1), lambda p: F.concat(F.lit("\\Q"), F.replace(p, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), ".*")
    return F.concat(F.lit("^"), quoted, F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def is_blocked(rules: Column, path: Column) -> Column:
    """The longest rule that matches decides, and allows on a tie; without one the path is free."""
    fitting = F.filter(rules, lambda r: (r["path"] != "") & F.regexp_like(path, rule_regex(r["path"])))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(F.char_length(r["path"]).alias("length"), (r["kind"] == "allow").alias("allow"))))
    return F.coalesce(~best["allow"], F.lit(False))


def rules_for(parsed: Column, bot: Column) -> Column:
    """All rules of the groups that name the bot; if none does, of the groups for everyone."""
    named = F.filter(parsed, lambda g: F.array_contains(g["agents"], F.lower(bot)))
    chosen = F.when(size(named) > 0, named).otherwise(F.filter(parsed, lambda g: F.array_contains(g["agents"], "*")))
    return F.flatten(F.transform(chosen, lambda g: g["rules"]))


def bots() -> Column:
    return F.array(*(F.lit(b) for b, _ in config.BOTS))


def blocked_bots(parsed: Column, path: Column, checked: Column | None = None) -> Column:
    return F.filter(bots() if checked is None else checked, lambda b: is_blocked(rules_for(parsed, b), path))


def signals_of(parsed: Column) -> Column:
    """Signals for everyone, else those of the first group that has any; null if there are none."""
    some = F.filter(parsed, lambda g: g["signals"].isNotNull())
    everyone = F.filter(some, lambda g: F.array_contains(g["agents"], "*"))
    found = F.coalesce(F.get(everyone, 0), F.get(some, 0))["signals"]
    return F.when(F.size(F.map_keys(found)) > 0, found)


def robots_txt(status: Column, body: Column, path: Column, parsed: Column | None = None) -> Column:
    """What a fetched robots.txt says for a path. Server errors and 429 shut everything; other failures nothing."""
    unreachable = (status >= 500) | (status == 429)
    usable = (status.between(200, 299)) & ~looks_like_html(body) & (F.trim(F.regexp_replace(body, r"\s+", " ")) != "")
    read = groups(body) if parsed is None else parsed
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(usable & ~unreachable, F.lit(False)).alias("exists"), F.coalesce(unreachable, F.lit(False)).alias("unreachable"), F.when(unreachable, status).alias("httpStatus"), path.alias("path"),
        F.when(unreachable, bots()).when(usable, blocked_bots(read, path)).otherwise(none).alias("blockedBots"), bots().alias("checkedBots"), F.when(usable & ~unreachable, signals_of(read)).alias("signals"),
    )


def sitemaps(body: Column) -> Column:
    """Absolute URLs of the Sitemap lines."""
    found = F.filter(lines(body), lambda x: x["name"] == "sitemap")
    return F.filter(F.transform(found, lambda x: F.regexp_extract(x["value"], r"^(\S+)", 1)), lambda u: u.rlike("(?i)^https?://"))


def llms_txt(index_status: Column, index: Column, full_status: Column, full: Column) -> Column:
    """Which of the two files there are: text, not a page, and not empty."""

    def usable(status: Column, body: Column) -> Column:
        return F.coalesce(status.between(200, 299) & ~looks_like_html(body) & (F.trim(F.regexp_replace(body, r"\s+", " ")) != ""), F.lit(False))

    one, two = usable(index_status, index), usable(full_status, full)
    return F.struct(one.alias("exists"), F.when(one, F.char_length(index)).alias("contentLength"), two.alias("fullExists"), F.when(two, F.char_length(full)).alias("fullContentLength"))


def header_directives(header: Column) -> Column:
    """Directives of an X-Robots-Tag that concern search engines and the known crawlers. A crawler's name before a
    directive holds for those after it."""
    valued = ["unavailable_after", "max-snippet", "max-image-preview", "max-video-preview"]
    agents = ["googlebot", "bingbot", *(b.lower() for b, _ in config.BOTS)]
    parts = F.filter(F.transform(F.split(F.lower(header), ","), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.lit(None).cast("string").alias("agent"), F.array().cast("array<string>").alias("found")).cast("struct<agent: string, found: array<string>>")

    def step(s: Column, p: Column) -> Column:
        name = F.regexp_extract(p, r"^([a-z0-9_.-]+)\s*:", 1)
        scoped = (name != "") & ~name.isin(valued)
        agent = F.when(scoped, name).otherwise(s["agent"])
        rest = F.when(scoped, F.trim(F.regexp_extract(p, r"^[a-z0-9_.-]+\s*:\s*(.*)$", 1))).otherwise(p)
        ours = (rest != "") & (agent.isNull() | (agent == "*") | agent.isin(agents))
        return F.struct(agent.alias("agent"), F.when(F.coalesce(ours, F.lit(False)), F.array_append(s["found"], rest)).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.coalesce(parts, F.array().cast("array<string>")), start, step, lambda s: s["found"])


def max_snippet(tokens: Column) -> Column:
    """The smallest limit, -1 if none of them limits, null without any."""
    limits = F.transform(F.filter(tokens, lambda t: t.rlike(r"(?i)^max-snippet\s*:\s*-?\d+$")), lambda t: F.regexp_extract(t, r"(-?\d+)$", 1).cast("int"))
    return F.when(size(limits) > 0, F.coalesce(F.array_min(F.filter(limits, lambda n: n >= 0)), F.lit(-1)))


def with_header(meta: Column, header: Column) -> Column:
    """The page's robots directives and those of the header together."""
    tokens = header_directives(header)
    limits = F.filter(F.array(meta["maxSnippet"], max_snippet(tokens)), lambda n: n.isNotNull())
    has = lambda *names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    both = F.struct(
        (meta["hasNoIndex"] | has("noindex", "none")).alias("hasNoIndex"), (meta["hasNoFollow"] | has("nofollow", "none")).alias("hasNoFollow"), (meta["hasNoArchive"] | has("noarchive")).alias("hasNoArchive"),
        (meta["hasNoSnippet"] | has("nosnippet")).alias("hasNoSnippet"), meta["rawContent"].alias("rawContent"), F.trim(header).alias("headerContent"),
        F.when(size(limits) > 0, F.coalesce(F.array_min(F.filter(limits, lambda n: n >= 0)), F.lit(-1))).alias("maxSnippet"), meta["noSnippetShare"].alias("noSnippetShare"),
    )
    return F.when(F.trim(F.coalesce(header, F.lit(""))) != "", both).otherwise(meta)


def is_blocked_response(status: Column, mitigated: Column) -> Column:
    """Whether an answer to a crawler is a wall rather than the page."""
    return status.isin(list(config.BLOCK_STATUSES)) | F.coalesce(mitigated.rlike("(?i)challenge|block"), F.lit(False))
