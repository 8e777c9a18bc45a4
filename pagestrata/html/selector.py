"""A CSS selector that names one element of a page."""

from __future__ import annotations

import re

from .tree import Element


def step(e: Element) -> str:
    """The element among its siblings: its tag, with a number if there are more of that kind."""
    alike = [s for s in e.parent.child_elements if s.tag == e.tag] if e.parent is not None else [e]
    return e.tag if len(alike) == 1 else f"{e.tag}:nth-of-type({next(i for i, s in enumerate(alike, 1) if s is e)})"


def css_path(e: Element, times: dict[str, int]) -> str:
    """From the nearest id that is used once, else from the body. times: how often each id occurs."""
    steps: list[str] = []
    for x in e.line():
        own = x.get("id")
        if x.tag in ("html", "body"):
            steps.append(x.tag)
        elif own and times.get(own) == 1:
            steps.append("#" + re.sub(r"([^a-zA-Z0-9_-])", r"\\\1", own))
        else:
            steps.append(step(x))
            continue
        break
    return " > ".join(reversed(steps))
