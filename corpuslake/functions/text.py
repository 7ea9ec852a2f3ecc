"""Text functions on columns: tokens, chunks, front matter, tags and titles. All run inside the JVM.

Regular expressions that must not depend on the Java version's idea of ``\\b``,
``\\w`` or line ends say so with inline flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "一-鿿"
#: What str.splitlines() breaks at.
LINE_BREAK = "\r\n|[\n\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"


def _pieces(run: Column, width: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - (width - 1)), lambda i: F.substring(run, i, F.lit(width)))


def tokenize(text: Column) -> Column:
    """Lower-cased runs of CJK or of a-z0-9. A CJK run gives itself, its characters and its pairs, in that order."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(f"[{CJK}]+|[a-z0-9]+"), F.lit(0))

    def expand(run: Column) -> Column:
        pairs = F.when(F.length(run) > 1, _pieces(run, 2)).otherwise(F.array().cast("array<string>"))
        return F.when(run.rlike(f"^[{CJK}]"), F.concat(F.array(run), _pieces(run, 1), pairs)).otherwise(F.array(run))

    return F.when(text.rlike(f"[{CJK}]"), F.flatten(F.transform(runs, expand))).otherwise(runs)


def query_terms(query: Column) -> Column:
    """CJK runs and Latin or digit runs of two or more, lower-cased."""
    return F.regexp_extract_all(F.lower(query), F.lit(f"[{CJK}]+|[a-z0-9]{{2,}}"), F.lit(0))


def windows(text: Column, size: int = 3000, overlap: int = 300) -> Column:
    """Overlapping character windows; the last one ends with the text, an empty text gives one empty window."""
    stride, n = size - overlap, F.length(text)
    many = F.transform(F.sequence(F.lit(0), F.ceil((n - size) / stride).cast("int")), lambda i: F.substring(text, i * stride + 1, F.lit(size)))
    return F.when(n <= size, F.array(text)).otherwise(many)


def sections(text: Column) -> Column:
    """The text cut before every second-level heading; a blank beginning is dropped if there is a heading."""
    heading = r"(?mdU)^##\s"
    parts = F.split(text, r"(?mdU)(?=^##\s)", -1)
    parts = F.filter(parts, lambda p, i: ~((i == 0) & ~p.rlike(heading) & ~p.rlike(r"(?U)\S")))
    return F.when(text.rlike(heading), parts).otherwise(F.array(text))


def chunks(text: Column, size: int = 3000, overlap: int = 300) -> Column:
    """Sections, each cut into windows."""
    return F.flatten(F.transform(sections(F.coalesce(text, F.lit(""))), lambda s: windows(s, size, overlap)))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the UTF-8 bytes."""
    return F.substring(F.sha2(text, 256), 1, 16)


def lines(text: Column) -> Column:
    """Lines as str.splitlines() has them: no last line after a trailing break."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def content_lines(text: Column) -> Column:
    """(line_no, line) outside fenced code, inline code removed. A fence closes only on its own marker."""
    numbered = F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line")))
    marker = lambda s: F.regexp_extract(s, r"(?U)^\s*(```|~~~)", 1)
    state = F.struct(F.lit("").alias("fence"), F.array().cast("array<struct<line_no:int,line:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        m = marker(x["line"])
        fence = F.when(m == "", acc["fence"]).when(acc["fence"] == "", m).when(m == acc["fence"], F.lit("")).otherwise(acc["fence"])
        keep = (m == "") & (acc["fence"] == "")
        row = F.struct(x["line_no"].alias("line_no"), F.regexp_replace(x["line"], "`[^`\n]*`", "").alias("line"))
        return F.struct(fence.alias("fence"), F.when(keep, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    fenced = F.aggregate(numbered, state, step, lambda acc: acc["out"])
    plain = F.transform(numbered, lambda x: F.struct(x["line_no"].alias("line_no"), F.regexp_replace(x["line"], "`[^`\n]*`", "").alias("line")))
    return F.when(text.rlike(r"(?mU)^\s*(```|~~~)"), fenced).otherwise(plain)


# ------------------------------------------------------------ front matter


def frontmatter(text: Column) -> Column:
    """What stands between a leading --- and the next line that starts with ---; else empty."""
    return F.regexp_extract(text, r"(?s)\A---(.*?)\n---", 1)


def body(text: Column) -> Column:
    """The text behind the front matter, or all of it."""
    return F.regexp_replace(text, r"(?s)\A---.*?\n---[^\n]*\n?", "")


def strict_split(text: Column) -> Column:
    """(fm, body, ok): the front matter must be closed by a line of its own; an unclosed one is not ok."""
    pattern = r"(?s)\A---\n(.*?\n)?---[ \t]*(?:\n|\z)"
    ok = text.rlike(pattern)
    opened = text.rlike(r"\A---\n")
    return F.struct(F.when(ok, F.regexp_extract(text, pattern, 1)).otherwise("").alias("fm"), F.when(ok, F.regexp_replace(text, pattern, "")).otherwise(text).alias("body"), (ok | ~opened).alias("ok"))


def _bare(value: Column) -> Column:
    """A value without surrounding blanks and quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(value), r"^[\"]+|[\"]+$", ""), r"^[']+|[']+$", ""))


def field(text: Column, key: str) -> Column:
    """A top-level scalar of the front matter, else the same key below ``metadata``; null if neither is there."""
    fm = F.concat(F.lit("\n"), frontmatter(text), F.lit("\n"))
    top = F.regexp_extract(fm, rf"\n{key}[ \t]*:[ \t]*([^\n]*)", 1)
    nested = F.regexp_extract(fm, rf"\nmetadata[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+{key}[ \t]*:[ \t]*([^\n]*)", 1)
    clean = lambda c: F.nullif(_bare(c), F.lit(""))
    return F.coalesce(clean(top), clean(nested))


def frontmatter_map(text: Column) -> Column:
    """Top-level scalars of the front matter as a map; values that cannot be read are left out."""
    pairs = F.regexp_extract_all(frontmatter(text), F.lit(r"(?m)^([A-Za-z_][\w-]*)[ \t]*:[ \t]*(\S[^\n]*)$"), F.lit(0))
    entries = F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, r"^([\w-]+)", 1).alias("key"), _bare(F.regexp_replace(p, r"^[\w-]+[ \t]*:[ \t]*", "")).alias("value")))
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.map_from_entries(first)


def set_field(text: Column, key: str, value: Column) -> Column:
    """The text with the first such field of its front matter rewritten."""
    before = F.regexp_extract(text, rf"(?s)\A(---.*?\n{key}:)[^\n]*", 1)
    after = F.regexp_extract(text, rf"(?s)\A---.*?\n{key}:[^\n]*(.*)\z", 1)
    return F.when(before == "", text).otherwise(F.concat(before, F.lit(" "), value, after))


def _yaml_list(fm: Column, key: str) -> tuple[Column, Column]:
    """Values of an inline list and of a block list; null where the form is not there."""
    inline = F.regexp_extract(fm, rf"(?m)^{key}\s*:\s*\[([^\]]*)\]\s*$", 1)
    has_inline = fm.rlike(rf"(?m)^{key}\s*:\s*\[([^\]]*)\]\s*$")
    block = F.regexp_extract(fm, rf"(?m)^{key}\s*:\s*\n((?:\s+-\s+[^\n]+\n?)+)", 1)
    one = F.when(has_inline, F.transform(F.filter(F.split(inline, ","), lambda x: F.trim(x) != ""), _bare))
    two = F.when(block != "", F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s+-\s+([^\n]+)$"), F.lit(1)), _bare))
    return one, two


def aliases(text: Column) -> Column:
    """Aliases of the front matter: an inline list, else a block list, else a single ``alias``."""
    fm = frontmatter(text)
    inline, block = _yaml_list(fm, "aliases")
    single = F.regexp_extract(fm, r"(?m)^alias\s*:\s*([^\n]+)\s*$", 1)
    return F.coalesce(inline, block, F.when(single != "", F.array(_bare(single))), F.array().cast("array<string>"))


def frontmatter_tags(text: Column) -> Column:
    """Distinct lower-cased tags of the front matter: inline list, block list, or words."""
    fm = frontmatter(text)
    inline, block = _yaml_list(fm, "tags")
    scalar = F.regexp_extract(fm, r"(?m)^tags[ \t]*:[ \t]*([^\[\n][^\n]*)$", 1)
    words = F.when(F.trim(scalar) != "", F.transform(F.split(F.trim(F.regexp_replace(scalar, ",", " ")), r"\s+"), _bare))
    found = F.coalesce(inline, block, words, F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.lower(t)), lambda t: t != ""))


def inline_tags(text: Column) -> Column:
    """Sorted distinct ``#tag`` of the first 20 lines that no word character, slash or hash stands before."""
    head = F.slice(lines(text), 1, 20)
    found = F.flatten(F.transform(head, lambda x: F.regexp_extract_all(x, F.lit(r"(?U)(?<![\w/#])#([\w\-/]+)"), F.lit(1))))
    return F.array_sort(F.array_distinct(found))


def tag_lines(text: Column) -> Column:
    """Distinct tags of ``- #tag`` lines."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^-\s+#(\S+)"), F.lit(1)))


def heading(text: Column, within: int = 30) -> Column:
    """The first top-level heading of the first lines; null if there is none."""
    head = F.slice(lines(text), 1, within)
    found = F.filter(head, lambda x: x.rlike(r"^# "))
    return F.when(F.size(found) > 0, F.trim(F.substring(F.get(found, F.lit(0)), 3, 100000)))


def title(text: Column, stem: Column) -> Column:
    """The front matter's title, else the first heading, else the file's stem."""
    return F.coalesce(field(text, "title"), heading(text, 100_000), stem)


def first_line(text: Column, most: int = 200) -> Column:
    """The first non-empty line of the body that is no heading, cut to ``most`` characters."""
    rows = F.filter(lines(body(text)), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^[#>]"))
    return F.substring(F.trim(F.get(rows, F.lit(0))), 1, most)


def excerpt(summary: Column, text: Column, most: int = 1500) -> Column:
    """The summary if there is one, else the body, cut to ``most`` characters."""
    return F.substring(F.coalesce(F.nullif(F.trim(summary), F.lit("")), F.trim(body(text))), 1, most)


def slug(text: Column, most: int | None = 50, default: str = "untitled") -> Column:
    """Word characters, CJK, blanks and hyphens only; blanks become hyphens."""
    kept = F.regexp_replace(F.regexp_replace(text, rf"(?U)[^{CJK}\w\s-]", ""), r"(?U)\s+", "-")
    kept = F.regexp_replace(kept, r"^-+|-+$", "")
    kept = F.substring(kept, 1, most) if most else kept
    return F.when(kept == "", default).otherwise(kept)


# ------------------------------------------------------------ dates and numbers


def date_of(value: Column) -> Column:
    """The first ten characters as a date; null if they are none."""
    return F.try_to_timestamp(F.substring(value.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def days_since(date: Column, as_of: str) -> Column:
    """Whole days from a date to ``as_of``, rounded down."""
    return F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(date.cast("timestamp"))) / 86400).cast("int")


def proper_noun(term: Column) -> Column:
    """Whether a term looks like a concept: capitalised ASCII, mixed scripts, a technical suffix, or 4 to 15 CJK characters."""
    # Suffixes of technical terms.
    suffixes = ["工程", "理论", "架构", "模型", "方法", "系统", "框架", "原则", "范式", "编程", "智能", "学习", "网络", "驱动", "设计", "分析", "优化"]
    return (
        term.rlike(r"^[A-Z][a-zA-Z0-9_\-/]+$")
        | term.rlike(rf"^[A-Za-z][a-zA-Z0-9_\-]+[{CJK}]")
        | term.rlike(rf"^[{CJK}]+[A-Za-z][a-zA-Z0-9_\-]+$")
        | term.rlike("|".join(suffixes))
        | term.rlike(rf"^[{CJK}]{{4,15}}$")
    )
