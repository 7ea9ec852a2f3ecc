"""Links in Markdown: wiki links by pattern, inline links by a scanner, and what may be an internal target."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslake.functions.paths import suffix

WIKI = r"\[\[([^\[\]|#\n]+?)(?:#[^\]|\n]*)?(?:\|[^\]\n]*)?\]\]"
# File suffixes of attachments and of link targets.
ATTACHMENT_SUFFIXES = (".pdf", ".pptx", ".png", ".jpg", ".jpeg", ".gif", ".doc", ".docx", ".xlsx", ".csv", ".html", ".mp4", ".zip", ".py")
LINK_SUFFIXES = (*ATTACHMENT_SUFFIXES, ".md")
LINKS = T.ArrayType(T.StructType([T.StructField("display", T.StringType()), T.StructField("target", T.StringType())]))


def wiki_targets(line: Column) -> Column:
    """Targets of the wiki links of a line, trimmed, in order."""
    return F.transform(F.regexp_extract_all(line, F.lit(WIKI), F.lit(1)), lambda t: F.trim(t))


class _Cursor:
    """A left-to-right reader of one line."""

    def __init__(self, line: str):
        self.line = line

    def closing(self, at: int, opener: str | None, closer: str) -> int:
        """Where ``closer`` closes what began before ``at``, escapes skipped and nested openers counted; -1 if nowhere."""
        depth = 1
        while at < len(self.line):
            c = self.line[at]
            if c == "\\":
                at += 2
                continue
            if opener is not None and c == opener:
                depth += 1
            elif c == closer:
                depth -= 1
                if not depth:
                    return at
            at += 1
        return -1


def scan_inline_links(line: str) -> list[tuple[str, str]]:
    """(display, target) of each ``[display](target)``: no images, nested parentheses and escapes allowed, angle brackets removed."""
    found, cursor, at = [], _Cursor(line), line.find("[")
    while at >= 0:
        step = at + 1
        if not (at and line[at - 1] == "!"):
            close = cursor.closing(at + 1, None, "]")
            if close >= 0 and line[close + 1 : close + 2] == "(":
                end = cursor.closing(close + 2, "(", ")")
                if end >= 0:
                    target = line[close + 2 : end].strip()
                    if target[:1] == "<" and target[-1:] == ">":
                        target = target[1:-1].strip()
                    found.append((line[at + 1 : close].strip(), target))
                    step = end + 1
        at = line.find("[", step)
    return found


@F.pandas_udf(LINKS)
def inline_links(lines: pd.Series) -> pd.Series:
    """Nested parentheses are not regular, so this scanner runs in Python, on lines that hold ``](`` only."""
    return lines.map(lambda x: [{"display": d, "target": t} for d, t in scan_inline_links(x)] if isinstance(x, str) and "](" in x else [])


def clean_target(raw: Column) -> Column:
    """Percent escapes decoded, anchor and query cut off, slashes forward."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(F.trim(raw), r"\+", "%2B")), F.trim(raw))
    return F.regexp_replace(F.trim(F.regexp_extract(decoded, r"(?s)^([^#?]*)", 1)), r"\\", "/")


def target_name(raw: Column) -> Column:
    return F.trim(F.element_at(F.split(clean_target(raw), "/"), -1))


def internal_candidate(target: Column) -> Column:
    """Whether an inline link's target may be a file of the corpus."""
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(F.trim(target), r"\+", "%2B")), F.trim(target))
    t = F.trim(F.regexp_extract(decoded, r"(?s)^([^#?]*)", 1))
    ext = suffix(F.regexp_replace(t, "/+$", ""))
    return (
        F.when((t == "") | t.contains("@") | F.lower(t).startswith("www.") | t.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), False)
        .when(ext != "", ext.isin(*LINK_SUFFIXES))
        .when(t.rlike(r"^[A-Za-z0-9.-]+\.[A-Za-z]{2,}(?:/.*)?$"), False)
        .otherwise(t.contains("/"))
    )
