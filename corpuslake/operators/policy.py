"""Policy checks: path rules, token sets, sidecars and plan status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.functions import paths as P
from corpuslake.functions import text as X
from corpuslake.functions.globs import segment_regex


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Deny rules from JSON; a missing or damaged file is an error."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def tool_paths(calls: DataFrame, keys: tuple[str, ...] = ("file_path", "path", "notebook_path", "command")) -> DataFrame:
    """calls (call_id, tool, input map) -> (call_id, tool, path) of the known keys."""
    values = F.map_values(F.map_filter("input", lambda k, v: k.isin(*keys) & v.isNotNull()))
    return calls.select("call_id", "tool", F.explode(values).alias("path")).withColumn("path", F.regexp_replace("path", r"^(\./)+", ""))


def private_access(paths: DataFrame, patterns: list[str], exempt: tuple[str, ...] = ("Glob",)) -> DataFrame:
    """Calls on private paths; tools that only list are exempt."""
    return paths.where(~F.col("tool").isin(*exempt) & P.matches_any(F.col("path"), patterns))


def redirected_edits(paths: DataFrame, protected: str, tools: tuple[str, ...] = ("Edit", "Write")) -> DataFrame:
    """Direct edits of a file that only its own command may change."""
    return paths.where(F.col("tool").isin(*tools) & (P.file_name(F.col("path")) == protected))


def first_denial(paths: DataFrame, rules: list[tuple[str, str]], host_of: DataFrame | None = None, host: str | None = None) -> DataFrame:
    """(call_id, path, rule, message) of the first rule (glob, message) that matches; files that name this host as theirs are free."""
    hit = F.coalesce(*[F.when(F.col("path").rlike(segment_regex(g)), F.struct(F.lit(i).alias("rule"), F.lit(m).alias("message"))) for i, (g, m) in enumerate(rules)])
    out = paths.withColumn("hit", hit).where("hit is not null")
    if host_of is not None:
        out = out.join(host_of.where(F.col("host") == host).select("path"), "path", "left_anti")
    return out.select("call_id", "path", "hit.rule", "hit.message")


def unmatched_tokens(wanted: DataFrame, given: DataFrame) -> DataFrame:
    """Wanted tokens that no given one covers: equal, or a file below a given directory, or a directory above a given file."""
    w = wanted.select(F.col("token").alias("w_raw"), P.normalise_token(F.col("token")).alias("w"), P.is_directory_token(F.col("token")).alias("w_dir")).distinct()
    g = given.select(P.normalise_token(F.col("token")).alias("g"), P.is_directory_token(F.col("token")).alias("g_dir")).distinct()
    # by equality, and by each directory above: equi joins, so no pair of all tokens is made
    up = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), F.lit(1), i), "/"))
    above = w.select("w_raw", F.explode(up(F.col("w"))).alias("g")).join(g.where("g_dir"), "g").select("w_raw")
    below = g.select(F.explode(up(F.col("g"))).alias("w")).join(w.where("w_dir"), "w").select("w_raw")
    same = w.join(g, F.col("w") == F.col("g")).select("w_raw")
    return w.join(same.unionByName(above).unionByName(below).distinct(), "w_raw", "left_anti").select(F.col("w_raw").alias("token"))


def compare_sets(ssot: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(side, problem, token): tokens that a side lacks or has beyond the reference list."""
    out = None
    for name, other in others.items():
        for problem, rows in (("missing", unmatched_tokens(ssot, other)), ("extra", unmatched_tokens(other, ssot))):
            part = rows.select(F.lit(name).alias("side"), F.lit(problem).alias("problem"), "token")
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("nothing to compare with")
    return out


def sidecar_issues(sidecars: DataFrame) -> DataFrame:
    """sidecars (path, expected, source) whose source field is missing or wrong, sorted."""
    return sidecars.where(F.col("source").isNull() | (F.col("source") != F.col("expected"))).select("path", F.when(F.col("source").isNull(), "missing").otherwise("wrong").alias("problem"), "expected", "source").orderBy("path")


def plan_files(files: DataFrame, root: str = "plans/", states: tuple[str, ...] = ("active", "completed", "abandoned"), exempt: tuple[str, ...] = ("README.md",)) -> DataFrame:
    """Plans below the directories of the states: (path, expected, status, content); index files are exempt."""
    state = F.regexp_extract("path", "^" + root + r"([^/]+)/", 1)
    return files.where(state.isin(*states) & ~P.file_name(F.col("path")).isin(*exempt)).select("path", state.alias("expected"), X.field(F.col("content"), "status").alias("status"), "content")


def sidecar_sources(sidecars: DataFrame, prefix: str) -> DataFrame:
    """Sidecars (path, content) with the source that their place says and the one that they state."""
    return sidecars.select("path", F.regexp_extract("path", "^" + prefix + "(.*)$", 1).alias("expected"), X.field(F.col("content"), "source").alias("source"))


def status_mismatches(plans: DataFrame) -> DataFrame:
    """plans (path, expected, status) whose status is not that of their directory."""
    return plans.where(~F.col("expected").eqNullSafe(F.col("status")))


def archive_ready(plans: DataFrame) -> DataFrame:
    """Active plans (path, content) whose check boxes, one at least, are all ticked."""
    open_, done = F.regexp_count("content", F.lit(r"(?m)^\s*[-*]\s+\[ \]")), F.regexp_count("content", F.lit(r"(?m)^\s*[-*]\s+\[[xX]\]"))
    return plans.where((open_ == 0) & (done > 0)).select("path", done.alias("done"))
