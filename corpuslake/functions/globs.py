"""Glob patterns as regular expressions, translated once on the driver."""

from __future__ import annotations

import re


def _one(pattern: str, any_: str, single: str) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(any_)
        elif c == "?":
            out.append(single)
        elif c == "[" and "]" in pattern[i + 2 :]:
            j = pattern.index("]", i + 2)
            inner = pattern[i + 1 : j].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def fnmatch_regex(pattern: str) -> str:
    """A star crosses slashes."""
    return "(?s)^" + _one(pattern, ".*", ".") + "$"


def segment_regex(pattern: str) -> str:
    """A star stays within its segment; ``**`` stands for any number of segments, none included."""
    parts, out = pattern.split("/"), ""
    for i, p in enumerate(parts):
        last = i == len(parts) - 1
        if p == "**":
            out += "(?:[^/]+(?:/[^/]+)*)?" if last else "(?:[^/]+/)*"
        else:
            out += _one(p, "[^/]*", "[^/]") + ("" if last else "/")
    return "^" + re.sub(r"/\(\?:\[\^/\]\+\(\?:/\[\^/\]\+\)\*\)\?$", lambda m: "(?:/[^/]+)*", out) + "$"
