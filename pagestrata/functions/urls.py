"""Keys that tell whether two URLs mean the same, one for each use. URLs are absolute; what isn't gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, host with port, path, query with its mark, fragment.
SHAPE = r"^(?i:(https?)://(?:[^/?#@]*@)?([^/?#\s]+))((?:/[^?#]*)?)(\?[^#]*)?(#.*)?$"


def _group(url: Column, k: int) -> Column:
    found = F.regexp_extract(url, SHAPE, k)
    return F.when(url.rlike(SHAPE), found)


def scheme(url: Column) -> Column:
    return F.lower(_group(url, 1))


def host(url: Column) -> Column:
    """Host in lower case, with a port that isn't the scheme's own."""
    whole = F.lower(_group(url, 2))
    return F.when(scheme(url) == "http", F.regexp_replace(whole, ":80$", "")).otherwise(F.regexp_replace(whole, ":443$", ""))


def hostname(url: Column) -> Column:
    return F.regexp_replace(host(url), r":\d+$", "")


def bare_host(url: Column) -> Column:
    return F.regexp_replace(hostname(url), r"^www\.", "")


def path(url: Column) -> Column:
    p = _group(url, 3)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    q = _group(url, 4)
    return F.when(q == "?", F.lit("")).otherwise(q)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url))


def without_slash(p: Column) -> Column:
    cut = F.regexp_replace(p, "/+$", "")
    return F.when(cut == "", F.lit("/")).otherwise(cut)


def normalized_input(raw: Column) -> Column:
    """What a user typed as a URL: https unless a scheme is there; null if it can't be one."""
    t = F.trim(raw)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(full.rlike(SHAPE), full)


def history_key(url: Column) -> Column:
    """Origin and path: one history for a page, whatever query it was opened with."""
    return F.coalesce(F.concat(origin(url), F.regexp_replace(path(url), "/+$", "")), url)


def snapshot_path(url: Column) -> Column:
    """Path and query: the same page on any host."""
    return F.coalesce(F.concat(F.when(F.char_length(path(url)) > 1, F.regexp_replace(path(url), "/+$", "")).otherwise("/"), query(url)), url)


def page_key(url: Column) -> Column:
    """Host without www. and the decoded path."""
    return F.concat(bare_host(url), without_slash(F.coalesce(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), path(url))))


def canonical_key(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), host(url), without_slash(path(url)))


def link_key(url: Column) -> Column:
    """Host, path and query of a link's target."""
    return F.concat(host(url), without_slash(path(url)), query(url))


def link_target(href: Column, page: Column) -> Column:
    """The key of a link that leads to other content: null for service paths and for the page itself."""
    key = link_key(href)
    return F.when(path(href).startswith("/cdn-cgi/") | (key == F.coalesce(link_key(page), F.lit(""))), F.lit(None)).otherwise(key)


def source_key(href: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring_index(href, "#", 1), "/$", ""))


def robots_path(url: Column) -> Column:
    return F.coalesce(F.concat(path(url), query(url)), F.lit("/"))


def registrable_domain(url: Column) -> Column:
    """Two labels of the host, or three below a known second-level label; an address stays whole."""
    h = F.regexp_replace(hostname(url), r"\.$", "")
    labels = F.split(h, r"\.")
    known = F.element_at(labels, -2).isin("co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go", "gv") & (F.char_length(F.element_at(labels, -1)) == 2)
    n = F.when(known, 3).otherwise(2)
    return F.when(h.rlike(r"^[\d.]+$") | h.contains(":") | (F.size(labels) <= 2), h).otherwise(F.array_join(F.slice(labels, -n, n), "."))
