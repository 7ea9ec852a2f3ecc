"""Decay, fusion, escalation, iterative search and reranking over (path, score) relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import text as X

YEAR = 365.25 * 86400


def age_years(as_of: str, *sources: Column) -> Column:
    """Age by the first date that is there; null if none is."""
    return (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.coalesce(*sources).cast("timestamp"))) / YEAR


def decay(score: Column, age: Column, params: tuple[float, float, float] = (1.0, 0.8, 0.5)) -> Column:
    """Steps at one and two years; an unknown age changes nothing."""
    return score * F.when(age.isNull(), 1.0).when(age < 1.0, params[0]).when(age < 2.0, params[1]).otherwise(params[2])


def decayed(results: DataFrame, ages: DataFrame, params: tuple[float, float, float], k: int | None = None) -> DataFrame:
    """Scores decayed by ages (path, age_years), ranked again."""
    out = results.join(ages.select("path", "age_years"), "path", "left").select("path", decay(F.col("score"), F.col("age_years"), params).alias("score"))
    return out if k is None else top(out, k)


def top(results: DataFrame, k: int) -> DataFrame:
    return results.orderBy(F.desc(F.round("score", 6)), "path").limit(k)


def _scaled(name: str) -> Column:
    low, high = F.min(name).over(Window.partitionBy()), F.max(name).over(Window.partitionBy())
    return (F.col(name) - low) / F.when(high > low, high - low).otherwise(1.0)


def fuse(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float] = (0.6, 0.4), k: int | None = 5) -> DataFrame:
    """Full outer merge of two (path, score) lists, a missing side 0, each side scaled to 0..1 (0 if it is constant), weighted sum.

    Both sides are bounded top lists, so the ranges over all rows are of a small relation.
    """
    d = dense.groupBy("path").agg(F.max("score").alias("d"))
    s = sparse.groupBy("path").agg(F.max("score").alias("s"))
    both = d.join(s, "path", "full_outer").select("path", F.coalesce("d", F.lit(0.0)).alias("d"), F.coalesce("s", F.lit(0.0)).alias("s"))
    out = both.select("path", (weights[0] * _scaled("d") + weights[1] * _scaled("s")).alias("score"))
    return out if k is None else top(out, k)


def merge(*results: DataFrame) -> DataFrame:
    """Union of result lists, the best score of each path."""
    out = results[0].select("path", "score")
    for r in results[1:]:
        out = out.unionByName(r.select("path", "score"))
    return out.groupBy("path").agg(F.max("score").alias("score"))


def tag_miss(results: DataFrame, tags: DataFrame, query: str, extracts_prefix: str) -> DataFrame:
    """One row, tag_miss: no tag of the five best notes contains a query term or is contained in one; extracts have no say."""
    best = top(results, 5).where(~F.col("path").startswith(extracts_prefix)).join(tags.select("path", "tags"), "path", "left")
    terms = X.query_terms(F.lit(query))
    hit = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.exists(terms, lambda q: t.contains(q) | q.contains(t)))
    return best.agg(F.coalesce((F.count(F.lit(1)) > 0) & ~F.bool_or(hit), F.lit(False)).alias("miss")).select((F.col("miss") & (F.size(terms) > 0)).alias("tag_miss"))


def triggers(score: float, age: float | None, tag_missed: bool, config: EngineConfig = EngineConfig()) -> list[str]:
    """Why a result list needs more: its best score, its tags, its age."""
    found = []
    if score < config.escalation_below:
        found.append("low_confidence")
    if tag_missed:
        found.append("tag_miss")
    if config.gray_zone[0] <= score <= config.gray_zone[1] and age is not None and age > config.gray_zone_years:
        found.append("gray_zone")
    return found


def escalate(
    results: DataFrame, query: str, k: int, *, age: Callable[[str], float | None], tag_missed: bool,
    hybrid: Callable[[int, tuple[float, float]], DataFrame], deep: Callable[[int], DataFrame] | None = None,
    rerank: Callable[[DataFrame, int], DataFrame] | None = None, config: EngineConfig = EngineConfig(),
) -> tuple[DataFrame, list[str], list[str]]:
    """(results, triggers, branches). Without a trigger the results come back as they are. One row, the best, reaches the driver.

    Raw cosines and fused scores are compared by their maximum, mixed scales as they are.
    """
    best = top(results, 1).collect()
    if not best:
        return results, [], []
    why = triggers(best[0].score, age(best[0].path), tag_missed, config)
    if not why:
        return results, [], []
    low = "low_confidence" in why
    merged, branches = merge(results, hybrid(config.escalation_recall if low else max(k, 10), config.escalation_weights)), ["hybrid"]
    if low and "tag_miss" not in why and deep is not None:
        merged = merge(merged, deep(max(k, 5)))
        branches.append("deep")
    if rerank is not None and len(merged.limit(10).collect()) >= 10:
        merged = merge(merged, rerank(top(merged, 20), k))
        branches.append("rerank")
    return top(merged, k), why, branches


def iterate(query: str, search: Callable[[str], DataFrame], ask: Callable[[str, int, list], list[str]], rounds: int = 2, breadth: int = 5) -> list[tuple[int, DataFrame, list[str]]]:
    """Iterative retrieval of 2 to 4 rounds: each asks further queries of what was found and reports the paths that are new."""
    if not 2 <= rounds <= 4:
        raise ValueError("rounds must be from 2 to 4")
    out, seen, found = [], None, []
    for i in range(rounds):
        queries = [query] if i == 0 else ask(query, breadth, found)
        if not queries:
            break
        got = merge(*[search(q) for q in queries])
        if seen is not None:
            got = got.join(seen, "path", "left_anti")
        got = top(got, breadth)
        found = got.collect()  # at most ``breadth`` rows
        if not found and i:
            break
        out.append((i + 1, got, queries))
        seen = got.select("path") if seen is None else seen.unionByName(got.select("path")).distinct()
    return out


def prompt_rows(results: DataFrame, summaries: DataFrame, most: int = 3) -> DataFrame:
    """The best results with their summaries, one line each."""
    return top(results, most).join(summaries.select("path", "summary"), "path", "left").orderBy(F.desc("score"), "path").select(F.concat_ws(" ", F.format_string("- %s (%.3f)", "path", "score"), F.coalesce("summary", F.lit(""))).alias("line"))


def rerank(results: DataFrame, chunks: DataFrame, score: Callable[[list[tuple[str, int, str]]], list[float]], m: int = 5) -> DataFrame:
    """The chunks of the 20 best paths, at most 20, scored by a model, scaled to 0..1, the best of each path. If the model fails the order stays."""
    spark = results.sparkSession
    best = top(results, 20)
    rows = best.join(chunks, "path").orderBy(F.desc("score"), "path", "chunk_index").select("path", "chunk_index", "chunk_text").limit(20).collect()
    try:
        scores = score([(r.path, r.chunk_index, r.chunk_text) for r in rows])
        if len(scores) != len(rows):
            raise ValueError("a score for each candidate is needed")
    except Exception:
        return top(results, m)
    if not rows:
        return top(results, m)
    low, high = min(scores), max(scores)
    scaled = [(r.path, (s - low) / (high - low if high > low else 1.0)) for r, s in zip(rows, scores)]
    return top(merge(spark.createDataFrame(scaled, "path string, score double")), m)
