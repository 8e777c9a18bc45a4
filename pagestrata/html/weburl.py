"""URLs as browsers read them, as far as pages need it: resolving, normalising, splitting."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import quote, unquote, urljoin, urlsplit

DEFAULT_PORTS = {"http": "80", "https": "443", "ftp": "21"}
SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*:")
#: Second-level labels under which two-letter domains are sold.
SECOND_LEVEL = {"co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go", "gv"}


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str
    port: str
    path: str
    query: str
    fragment: str

    @property
    def netloc(self) -> str:
        return f"{self.host}:{self.port}" if self.port else self.host

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.netloc}"

    @property
    def search(self) -> str:
        return f"?{self.query}" if self.query else ""

    @property
    def href(self) -> str:
        return f"{self.origin}{self.path}{self.search}" + (f"#{self.fragment}" if self.fragment else "")


def parse(url: str | None, base: str | None = None) -> Url | None:
    """The http(s) URL that a reference means on a page; None if it isn't one."""
    raw = re.sub(r"[\t\n\r]", "", (url or "").strip())
    try:
        if SCHEME.match(raw):
            scheme = raw.split(":", 1)[0].lower()
            if scheme not in ("http", "https"):
                return None
            rest = raw.split(":", 1)[1].replace("\\", "/").lstrip("/")
            whole = f"{scheme}://{rest}"
        elif base is None:
            return None
        else:
            head, mark, tail = raw.partition("?")
            whole = urljoin(base, head.replace("\\", "/") + mark + tail)
        parts = urlsplit(whole)
        host = (parts.hostname or "").lower()
        if not host or re.search(r"[\s<>^|%#@]", host):
            return None
        host = host.encode("idna").decode() if not host.isascii() else host
        port = str(parts.port or "")
    except (ValueError, UnicodeError):
        return None
    scheme = parts.scheme.lower()
    path = quote(dots(parts.path or "/"), safe="/%:@!$&'()*+,;=-._~[]|")
    query = quote(parts.query, safe="/%:@!$&()*+,;=-._~?[]|{}^`\\")
    return Url(scheme, host, "" if DEFAULT_PORTS.get(scheme) == port else port, path, query, quote(parts.fragment, safe="/%:@!$&'()*+,;=-._~?#[]|{}^\\"))


def dots(path: str) -> str:
    """The path without . and .. segments."""
    out: list[str] = []
    parts = path.split("/")
    for i, p in enumerate(parts):
        low = p.lower().replace("%2e", ".")
        if low == "..":
            if len(out) > 1:
                out.pop()
            if i == len(parts) - 1:
                out.append("")
        elif low == ".":
            if i == len(parts) - 1:
                out.append("")
        else:
            out.append(p)
    return "/".join(out) or "/"


def decoded(text: str) -> str:
    return unquote(text, errors="strict") if "%" in text else text


def registrable(host: str) -> str:
    """The domain a site is registered under: two labels, or three below a known second-level label."""
    host = host.lower().rstrip(".")
    labels = host.split(".")
    if re.fullmatch(r"[\d.]+", host) or ":" in host or len(labels) <= 2:
        return host
    take = 3 if len(labels[-1]) == 2 and labels[-2] in SECOND_LEVEL else 2
    return ".".join(labels[-take:])
