"""Path functions on root-relative posix paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslake.functions.globs import fnmatch_regex, segment_regex


def segments(path: Column) -> Column:
    return F.split(path, "/")


def directories(path: Column) -> Column:
    parts = segments(path)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def directory(path: Column) -> Column:
    return F.array_join(directories(path), "/")


def ancestors(path: Column) -> Column:
    """The root (empty) and every directory that a path lies in, from the top down."""
    parts = directories(path)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def file_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    """The last suffix in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1))


def relative(uri: Column, root: str) -> Column:
    """A file URI below ``root`` as a relative path, percent escapes decoded."""
    tail = F.regexp_replace(uri, "^[a-z0-9]+:/*(?=/)", "")
    plain = F.regexp_replace(tail, r"\+", "%2B")
    return F.regexp_replace(F.coalesce(F.try_url_decode(plain), tail), "^" + _quote(root.rstrip("/")) + "/", "")


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def category(path: Column, inbox: str) -> Column:
    """The first segment; files at the root are in the inbox."""
    return F.when(F.size(segments(path)) == 1, F.lit(inbox)).otherwise(F.element_at(segments(path), 1))


def archived(path: Column, markers: Iterable[str]) -> Column:
    """Whether a directory's name contains one of the markers."""
    found = list(markers)
    return F.exists(directories(path), lambda s: F.exists(F.array(*map(F.lit, found)), lambda m: s.contains(m))) if found else F.lit(False)


def excluded(path: Column, directories_: Iterable[str], top_files: Iterable[str]) -> Column:
    """Whether any directory is in the exclude set, or the path is an excluded file at the root."""
    dirs, tops = sorted(directories_), sorted(top_files)
    by_dir = F.arrays_overlap(directories(path), F.array(*map(F.lit, dirs))) if dirs else F.lit(False)
    return by_dir | ((F.size(segments(path)) == 1) & path.isin(tops))


def leading_date(name: Column) -> Column:
    """YYYYMMDD at the start of a name as YYYY-MM-DD, else a dash; the calendar is not consulted."""
    d = F.regexp_extract(name, r"^(\d{4})(\d{2})(\d{2})", 0)
    return F.when(d == "", "-").otherwise(F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2)))


def in_scope(path: Column, scope: str, memory_prefix: str) -> Column:
    """Scope predicate: ``notes`` is what is not in the memory tree, ``memory`` what is, ``all`` everything."""
    if scope not in ("notes", "memory", "all"):
        raise ValueError(f"unknown scope {scope!r}")
    return {"all": F.lit(True), "memory": path.startswith(memory_prefix), "notes": ~path.startswith(memory_prefix)}[scope]


def normalised(path: Column) -> Column:
    """``.`` and ``..`` and doubled slashes folded away; leading ``..`` that nothing undoes stay."""
    step = lambda acc, s: (
        F.when((s == "") | (s == "."), acc)
        .when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(segments(path), F.array().cast("array<string>"), step), "/")


def common_directories(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    pairs = F.zip_with(directories(a), directories(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(pairs, False), F.lit(0)) - 1, F.size(pairs).cast("long"))


def normalise_token(token: Column) -> Column:
    """A path token without quoting, a leading ``./``, stars and a trailing slash."""
    bare = F.regexp_replace(F.trim(token), "^[`\"']+|[`\"']+$", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"^\./", ""), r"\*", ""), "/+$", "")


def is_directory_token(token: Column) -> Column:
    return F.trim(token).endswith("/")


def posix_lower(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, r"\\", "/"))


def matches_any(path: Column, patterns: Iterable[str]) -> Column:
    """Segment globs, ``**`` included."""
    out = F.lit(False)
    for p in patterns:
        out = out | path.rlike(segment_regex(p))
    return out


def selected(path: Column, scope_pattern: str) -> Column:
    """Comma-separated file globs against the path or the name; ``*`` crosses slashes."""
    out = F.lit(False)
    for p in filter(None, (x.strip() for x in scope_pattern.split(","))):
        out = out | path.rlike(fnmatch_regex(p)) | file_name(path).rlike(fnmatch_regex(p))
    return out
