"""Incremental maintenance: renames, embedding plans, size gates, memory signals, frequencies, cached classifications."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import text as X
from corpuslake.functions.arrow import tidy
from corpuslake.session import cut_lineage

#: Days and rates of the memory channels.
WORKFLOW_DECAY_DAYS, WORKFLOW_DECAY, WORKFLOW_BORDERLINE = 180, 0.05, 0.03
FEEDBACK_DORMANT_DAYS, FEEDBACK_ARCHIVE_DAYS, FEEDBACK_STABLE = 180, 365, 3
PROJECT_STALE_DAYS = 90


def rename_plan(old: DataFrame, new: DataFrame, renames: DataFrame | None = None, similar: float | None = None) -> DataFrame:
    """(action, old_path, new_path): known renames first, then one-to-one hash matches of vanished and new paths; other vanished paths are archived.

    old and new: path, content_hash, and content if ``similar`` is given: then vanished
    files without a match go to the new one that is so similar. A match must be the
    only one of both its sides. renames: (old, new), or (seq, old, new) of a history.
    """
    if similar is not None:
        exact = cut_lineage(rename_plan(old, new, renames))
        lost = exact.where("action = 'archive'").select(F.col("old_path").alias("path"))
        taken = exact.where("action = 'rename'").select(F.col("new_path").alias("path"))
        signed = lambda df: df.select("path", signature(F.coalesce("content", F.lit(""))).alias("sig"))
        came = signed(new).join(old.select("path"), "path", "left_anti").join(taken, "path", "left_anti")
        found = similar_renames(signed(old).join(lost, "path", "left_semi"), came, similar)
        changed = found.select(F.lit("rename").alias("action"), F.col("old").alias("old_path"), F.col("new").alias("new_path"))
        return exact.join(changed.select("old_path"), "old_path", "left_anti").select("action", "old_path", "new_path").unionByName(changed)
    if renames is not None and "seq" in renames.columns:
        renames = close_renames(renames)
    o, n = old.select("path", "content_hash").distinct(), new.select("path", "content_hash").distinct()
    missing = o.join(n.select("path"), "path", "left_anti")
    added = n.join(o.select("path"), "path", "left_anti")
    known = None
    if renames is not None:
        known = renames.select(F.col("old").alias("old_path"), F.col("new").alias("new_path")).join(missing.select(F.col("path").alias("old_path")), "old_path", "left_semi")
        missing = missing.join(known.select(F.col("old_path").alias("path")), "path", "left_anti")
        added = added.join(known.select(F.col("new_path").alias("path")), "path", "left_anti")
    lost = missing.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_old"), F.min("path").alias("old_path"))
    came = added.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_new"), F.min("path").alias("new_path"))
    pairs = lost.where("n_old = 1").join(came.where("n_new = 1"), "content_hash").select("old_path", "new_path")
    gone = missing.select(F.col("path").alias("old_path")).join(pairs.select("old_path"), "old_path", "left_anti")
    out = pairs.select(F.lit("rename").alias("action"), "old_path", "new_path").unionByName(gone.select(F.lit("archive").alias("action"), "old_path", F.lit(None).cast("string").alias("new_path")))
    return out if known is None else out.unionByName(known.select(F.lit("rename").alias("action"), "old_path", "new_path"))


#: Words of a shingle and shingles of a window, of which the least hash is kept.
SHINGLE, WINDOW = 5, 4


def signature(content: Column) -> Column:
    """Winnowed shingles of a text's words, distinct: the least hash of each window of WINDOW neighbours, as a long; a short text has one, an empty one none."""
    words = F.filter(F.split(content, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    places = lambda n, width: F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))
    hashed = lambda w: F.transform(places(F.size(w), SHINGLE), lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, SHINGLE), " ")), 1, 16))
    least = lambda h: F.array_distinct(F.transform(places(F.size(h), WINDOW), lambda i: F.array_min(F.slice(h, i, WINDOW))))
    half = lambda h, at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    longs = lambda h: F.transform(h, lambda x: F.shiftleft(half(x, 1), 32).bitwiseOR(half(x, 9)))
    return once(words, lambda w: F.when(F.size(w) > 0, longs(once(hashed(w), least))).otherwise(F.array().cast("array<long>")))


#: Hashes that are ordered by how many files hold them, the most held ones; all others come before them.
COMMON = 100_000


def similar_renames(missing: DataFrame, added: DataFrame, least: float = 0.8) -> DataFrame:
    """missing, added (path, content or its sig) -> (old, new, similarity): paths whose contents are alike, though not equal; each is the other's most similar one.

    Similarity is the number of shared signature hashes over the larger number of
    both. Ties go to the smaller path. Files that share their whole signature with
    another one of their side are ambiguous and match nothing; nor do empty files.
    Hashes are ordered by themselves, the COMMON most held ones behind all others, and only those that a pair of
    ``least`` cannot do without are joined, so a passage that all files share joins nothing. Any order gives
    the same pairs. Files go by numbers, whole signatures only to the pairs that are to be scored.
    """
    sig = lambda df: F.col("sig") if "sig" in df.columns else signature(F.coalesce("content", F.lit(""))).alias("sig")
    sides = missing.select(F.lit(0).alias("side"), "path", sig(missing)).unionByName(added.select(F.lit(1).alias("side"), "path", sig(added)))
    # the filter comes after the cut, as below it signatures would be made for it once more
    signed = cut_lineage(sides.withColumn("id", F.monotonically_increasing_id())).where(F.size("sig") > 0)
    whole = F.sha2(F.array_join(F.transform(F.array_sort("sig"), lambda x: x.cast("string")), ","), 256)
    alone = signed.groupBy("side", whole.alias("whole")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("id")
    files = cut_lineage(signed.join(alone, "id", "left_semi"))
    held = files.select(F.explode("sig").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("held")).where("held > 2")
    common = held.orderBy(F.desc("held"), "h").limit(COMMON).collect()[::-1]
    by_hash = np.sort(np.array([r.h for r in common], np.int64))
    turn = np.zeros(len(common) + 1, np.int64)  # of each of them by its number of holders, rare ones first
    turn[np.searchsorted(by_hash, np.array([r.h for r in common], np.int64))] = np.arange(1, len(common) + 1)

    def prefixes(batches):
        for b in batches:
            n = np.diff(b.column(2).offsets.to_numpy())
            h = b.column(2).flatten().to_numpy()
            row, first = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
            at = np.searchsorted(by_hash, h)
            known = at < len(by_hash)
            known[known] = by_hash[at[known]] == h[known]
            order = np.lexsort((h, np.where(known, turn[at], 0), row))
            keep = order[np.arange(len(h)) - first[row] < (n - np.ceil(n * least) + 1)[row]]
            yield pa.record_batch([b.column(0).take(row[keep]), b.column(1).take(row[keep]), pa.array(n[row[keep]].astype(np.int32)), pa.array(h[keep])], names=["side", "id", "n", "h"])

    prefix = files.select("side", "id", "sig").mapInArrow(tidy(prefixes), "side int, id long, n int, h long")
    near = (F.col("n") >= F.ceil(F.col("m") * least)) & (F.col("m") >= F.ceil(F.col("n") * least))
    right = prefix.where("side = 1").select(F.col("id").alias("new_id"), F.col("n").alias("m"), "h")
    pairs = cut_lineage(prefix.where("side = 0").select(F.col("id").alias("old_id"), "n", "h").join(right, "h").where(near).select("old_id", "new_id").distinct())
    side = lambda i, name: files.where(F.col("side") == i).select(F.col("id").alias(f"{name}_id"), F.col("path").alias(name), F.col("sig").alias(f"sig_{name}"))
    shared = F.size(F.array_intersect("sig_old", "sig_new")) / F.greatest(F.size("sig_old"), F.size("sig_new"))
    scored = cut_lineage(pairs.join(side(0, "old"), "old_id").join(side(1, "new"), "new_id").select("old", "new", shared.alias("similarity")).where(F.col("similarity") >= least))
    best = lambda of, other: scored.groupBy(of).agg(F.min(F.struct((-F.col("similarity")).alias("s"), other)).alias("b")).select(of, F.col(f"b.{other}").alias(other))
    return cut_lineage(scored.join(best("old", "new"), ["old", "new"], "left_semi").join(best("new", "old"), ["old", "new"], "left_semi"))


def close_renames(renames: DataFrame) -> DataFrame:
    """renames (seq, old, new) -> (old, new): where each path that was there at first is after all renames.

    A rename goes on with the next one that leaves its new path; chains are closed by
    pointers that jump twice as far each round. Paths that end where they began are left out.
    """
    r = renames.select("seq", "old", "new").where("old <> new").distinct()
    events = r.select(F.col("new").alias("path"), "seq", F.lit(1).alias("leaves"), F.struct("seq", "old", "new").alias("of")).unionByName(r.select(F.col("old").alias("path"), "seq", F.lit(0).alias("leaves"), F.struct("seq", "old", "new").alias("of")))
    # along one path: the rename that left it next, if nothing else came to it before
    w = Window.partitionBy("path").orderBy("seq", "leaves")
    placed = events.withColumn("next", F.when(F.lead("leaves").over(w) == 0, F.lead("of").over(w)))
    chain = cut_lineage(placed.where("leaves = 1").select("of", F.col("next").alias("next"), F.col("of.new").alias("end")))
    heads = chain.select("of").join(chain.where("next is not null").select(F.col("next").alias("of")), "of", "left_anti")
    while not chain.where("next is not null").isEmpty():
        ahead = chain.select(F.col("of").alias("next"), F.col("next").alias("next2"), F.col("end").alias("end2"))
        chain = cut_lineage(chain.join(ahead, "next", "left").select("of", F.col("next2").alias("next"), F.coalesce("end2", "end").alias("end")))
    return chain.join(heads, "of", "left_semi").select(F.col("of.old").alias("old"), F.col("end").alias("new")).where("old <> new")


def gate(files: DataFrame, policy: DataFrame | None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """files (path, size_bytes, ...) with gate: pass for small or allowed ones, else llm_skip, skip or pending."""
    large = F.col("size_bytes") > config.large_bytes
    if policy is None:
        return files.withColumn("gate", F.when(large, "pending").otherwise("pass"))
    joined = files.join(policy.select("path", F.col("action").alias("__action")), "path", "left")
    return joined.withColumn("gate", F.when(~large | (F.col("__action") == "allow"), "pass").otherwise(F.coalesce("__action", F.lit("pending")))).drop("__action")


def oversize_ledger(files: DataFrame, ledger: DataFrame | None, policy: DataFrame | None, today: str, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(path, size_bytes, first_detected, last_seen) of large files that no policy allows or skips for models."""
    rows = files.where(F.col("size_bytes") > config.large_bytes).select("path", "size_bytes")
    if policy is not None:
        rows = rows.join(policy.where(F.col("action").isin("allow", "llm_skip")).select("path"), "path", "left_anti")
    if ledger is not None:
        rows = rows.join(ledger.select("path", "first_detected"), "path", "left")
    else:
        rows = rows.withColumn("first_detected", F.lit(None).cast("string"))
    return rows.select("path", "size_bytes", F.coalesce("first_detected", F.lit(today)).alias("first_detected"), F.lit(today).alias("last_seen"))


def embedding_plan(known: DataFrame, current: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """(path, action) of a vector table: add, change, skip (same hash), delete (gone, or barred from models), wait (large, undecided: old vectors stay)."""
    k = known.select("path", F.col("content_hash").alias("known_hash")).distinct()
    rows = current.select("path", "content_hash").join(k, "path", "full_outer")
    rows = rows.join(gates.select("path", "gate"), "path", "left") if gates is not None else rows.withColumn("gate", F.lit("pass"))
    action = (
        F.when(F.col("content_hash").isNull(), "delete")
        .when((F.col("gate") == "llm_skip"), F.when(F.col("known_hash").isNotNull(), "delete").otherwise("skip"))
        .when(F.col("gate").isin("pending", "skip"), "wait")
        .when(F.col("known_hash").isNull(), "add")
        .when(F.col("known_hash") == F.col("content_hash"), "skip")
        .otherwise("change")
    )
    return rows.select("path", action.alias("action"))


def memory_signals(memory: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """memory with signal by channel.

    memory: path, type, frequency, last_used, liveness, last_confirmed,
    confirmed_count, status, completed_at, changed_at (the last change known
    from history or file time; null if unknown). Rules are tried in order.
    """
    days = lambda c: X.days_since(X.date_of(F.col(c)), config.as_of)
    changed = X.days_since(F.col("changed_at"), config.as_of)
    used, confirmed, completed = days("last_used"), F.coalesce(days("last_confirmed"), changed), F.coalesce(days("completed_at"), changed)
    live, status = F.coalesce("liveness", F.lit("active")), F.coalesce("status", F.lit("active"))
    workflow = (
        F.when(F.col("frequency").isNull() | used.isNull(), "UNKNOWN")
        .when((F.col("frequency") < WORKFLOW_DECAY) & (used > WORKFLOW_DECAY_DAYS), "DECAY")
        .when((F.col("frequency") >= WORKFLOW_BORDERLINE) & (F.col("frequency") < WORKFLOW_DECAY), "BORDERLINE")
        .otherwise("ACTIVE")
    )
    feedback = (
        F.when(confirmed.isNull(), "UNKNOWN")
        .when((live == "active") & (confirmed > FEEDBACK_DORMANT_DAYS), "DORMANT")
        .when((live == "dormant") & (confirmed > FEEDBACK_ARCHIVE_DAYS), "ARCHIVE")
        .when((live == "active") & (F.coalesce("confirmed_count", F.lit(0)) >= FEEDBACK_STABLE), "STABLE")
        .when(live == "dormant", "DORMANT")
        .otherwise("ACTIVE")
    )
    project = F.when((status == "complete") & (completed > PROJECT_STALE_DAYS), "STALE").when((status == "complete") & (completed <= PROJECT_STALE_DAYS), "FRESH").otherwise("ACTIVE")
    kind = F.coalesce("type", F.element_at(F.reverse(F.split("path", "/")), 2))
    signal = F.when(kind == "workflow", workflow).when(kind == "feedback", feedback).when(kind == "project", project).when(kind == "reference", "INACTIVE").otherwise("UNKNOWN")
    return memory.withColumn("signal", signal)


def memory_rows(notes: DataFrame) -> DataFrame:
    """The memory relation from notes' front matter."""
    t = F.col("content")
    text = {k: X.field(t, k) for k in ("type", "last_used", "liveness", "last_confirmed", "status")}
    return notes.select("path", F.col("mtime").alias("changed_at"), X.field(t, "frequency").try_cast("double").alias("frequency"), X.field(t, "confirmed_count").try_cast("int").alias("confirmed_count"), F.coalesce(X.field(t, "completed_at"), X.field(t, "date")).alias("completed_at"), *(v.alias(k) for k, v in text.items()))


def signal_counts(memory: DataFrame) -> DataFrame:
    return memory.groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def woken(archived: DataFrame, history: DataFrame) -> DataFrame:
    """Archived files that have any history (path, changed_at)."""
    return archived.select("path").join(history.groupBy("path").agg(F.max("changed_at").alias("changed_at")), "path")


def frequency(events: DataFrame, as_of: str, key: str = "path", ts: str = "ts", days: int = 30) -> DataFrame:
    """(key, frequency, last_used): hits of the last days over days, at most 1, three decimals."""
    now = F.lit(as_of).cast("timestamp")
    recent = (F.col(ts) > now - F.expr(f"INTERVAL {days} DAYS")) & (F.col(ts) <= now)
    return events.where(F.col(ts) <= now).groupBy(key).agg(F.bround(F.least(F.count_if(recent) / F.lit(float(days)), F.lit(1.0)), 3).alias("frequency"), F.max(ts).alias("last_used"))


def active_session(rows: DataFrame, where: Column, as_of: str, window_seconds: int = 120) -> DataFrame:
    """One row: the latest model; certain if exactly one row lies within the window, degraded otherwise. Without a row of the place the latest of all counts."""
    here = rows.where(where)
    src = here if not here.isEmpty() else rows
    near = F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(as_of).cast("timestamp"))) <= window_seconds * 1_000_000
    return src.agg(F.max_by("model", F.struct("ts", "model")).alias("model"), F.max("ts").alias("ts"), F.count_if(near).alias("active")).withColumn("degraded", (F.col("active") != 1) | F.lit(src is rows))


def cached_classes(notes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, open): notes whose content hash has a cached answer, and those to ask about."""
    joined = notes.join(cache.select("path", "content_hash", "categories"), ["path", "content_hash"], "left")
    return joined.where("categories is not null"), joined.where("categories is null").drop("categories")


def match_categories(answer: Column, names: list[str], most: int = 2) -> Column:
    """Known names that an answer contains, in the taxonomy's order."""
    return F.slice(F.filter(F.array(*map(F.lit, names)), lambda n: answer.contains(n)), 1, most)
