"""Small text formats: taxonomies, policies, dated logs, token lists, marked lines and marked sections."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as X


def categories(doc: DataFrame) -> DataFrame:
    """(name, pos): category names of a taxonomy text: backticked ``name/`` tokens, else names in list items; first place of each."""
    found = F.flatten(F.array(F.regexp_extract_all("text", F.lit(r"`([^`/\s]+)/`"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^\s*[-*]\s+([^\s/:|`]+)/(?:\s|$)"), F.lit(1))))
    return doc.select(F.posexplode(found).alias("pos", "name")).groupBy("name").agg(F.min("pos").alias("pos"))


def head(text: Column, n: int = 60) -> Column:
    """The first lines of a text."""
    return F.array_join(F.slice(X.lines(text), 1, n), "\n")


# Headings of a rules text under which protected directories are listed.
PROTECTED_HEADINGS = ("隐私目录", "受保护目录", "受保护", "隐私", "protected", "privacy")


def protected_directories(rules: str, listed: str = "") -> set[str]:
    """Directory names of a comma-separated list if there is one, else the bare names (no path) that a rules text lists under a heading on protection."""
    if listed.strip():
        return {d.strip() for d in listed.split(",") if d.strip()}
    inside, found = False, set()
    for line in rules.splitlines():
        if heading := re.match(r"#+\s*(.*)", line):
            inside = heading[1].strip().lower().startswith(PROTECTED_HEADINGS)
        elif inside and (item := re.fullmatch(r"\s*[-*]\s+`?([\w.\-]+(?:【[^】]+】)?)/?`?\s*", line)):
            found.add(item[1])
    return found


def large_file_policy(doc: DataFrame) -> DataFrame:
    """(path, action) of ``path -> action`` lines; the last line of a path counts."""
    line = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:[-*]\s+)?`?[^`\n]+?`?\s*->\s*(?:allow|llm_skip|skip)\s*$"), F.lit(0))).alias("pos", "line")
    parsed = doc.select(line).select("pos", F.regexp_extract("line", r"^\s*(?:[-*]\s+)?`?([^`\n]+?)`?\s*->", 1).alias("path"), F.regexp_extract("line", r"(allow|llm_skip|skip)\s*$", 1).alias("action"))
    return parsed.groupBy("path").agg(F.max_by("action", "pos").alias("action"))


def log_entries(doc: DataFrame) -> DataFrame:
    """(date, pos, time, title, body) of a dated log: ``## YYYY-MM-DD`` sections of ``### [HH:MM] title`` entries."""
    days = F.filter(F.split("text", r"(?md)(?=^## )"), lambda s: s.rlike(r"^## \d{4}-\d{2}-\d{2}"))
    day = doc.select(F.posexplode(days).alias("day_pos", "section")).withColumn("date", F.regexp_extract("section", r"^## (\d{4}-\d{2}-\d{2})", 1))
    entries = F.filter(F.split("section", r"(?md)(?=^### )"), lambda s: s.startswith("### "))
    return day.select("date", "day_pos", F.posexplode(entries).alias("pos", "entry")).select(
        "date", "day_pos", "pos",
        F.nullif(F.regexp_extract("entry", r"^### \[?(\d{1,2}:\d{2})", 1), F.lit("")).alias("time"),
        F.trim(F.regexp_extract("entry", r"^### (?:\[?\d{1,2}:\d{2}\]?\s*)?([^\n]*)", 1)).alias("title"),
        F.regexp_replace(F.regexp_replace("entry", r"^### [^\n]*\n?", ""), r"^\s+|\s+$", "").alias("body"),
    )


def titles(entries: DataFrame, limit: int) -> DataFrame:
    """The newest titles."""
    return entries.orderBy(F.desc("date"), "day_pos", "pos").select("date", "time", "title").limit(limit)


def show(entries: DataFrame, date: str | None = None, match: str | None = None, limit: int = 20) -> DataFrame:
    """Entries of a date and with a substring, in either case."""
    if date:
        entries = entries.where(F.col("date") == date)
    if match:
        entries = entries.where(F.lower(F.concat_ws("\n", "title", "body")).contains(match.lower()))
    return entries.orderBy(F.desc("date"), "day_pos", "pos").limit(limit)


def recent(entries: DataFrame, days: int, as_of: str) -> DataFrame:
    """Entries of the last days."""
    return entries.where(F.to_date("date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def token_list(lines: DataFrame) -> DataFrame:
    """Tokens of a list file, one a line; blanks, comments and front matter marks are skipped."""
    t = F.trim("value")
    return lines.where((t != "") & ~t.startswith("#") & ~t.startswith("---")).select(F.regexp_replace(t, r"^[-*]\s+", "").alias("token"))


def backticked(lines: DataFrame, marker: str) -> DataFrame:
    """Backticked tokens of the lines that hold a marker."""
    return lines.where(F.col("value").contains(marker)).select(F.explode(F.regexp_extract_all("value", F.lit(r"`([^`]+)`"), F.lit(1))).alias("token"))


def alternatives(lines: DataFrame, name: str) -> DataFrame:
    """The parts of an ``A|B|C`` literal that is assigned to a name."""
    literal = F.regexp_extract("value", rf"{name}\s*=\s*['\"]([^'\"]+)['\"]", 1)
    return lines.select(literal.alias("v")).where("v <> ''").select(F.explode(F.split("v", r"\|")).alias("token"))


def replace_section(text: str, section: str, begin: str, end: str) -> str:
    """A marked section of a text replaced, appended if it is not there."""
    block = f"{begin}\n{section}\n{end}"
    if begin in text and end in text.partition(begin)[2]:
        before, _, rest = text.partition(begin)
        return before + block + rest.partition(end)[2]
    return f"{text.rstrip()}\n\n{block}\n" if text.strip() else block + "\n"
