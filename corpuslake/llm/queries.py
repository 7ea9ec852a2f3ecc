"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslake.llm import conversations, decontaminate, impact_topk, language_id, line_dedup, packing, quality, resample, secrets, simhash, substring_dedup, token_store, warc


def tokenizer_path(name: str) -> str:
    """Where the named public tokenizer file is; its bytes stay there."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives, their runs merged, and every record read back. The timestamp is made from page_id."""
    second = F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(100_000_000)))
    pages = _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", F.date_format(second, "yyyyMMddHHmmss").alias("ts"), F.col("html").alias("payload"))
    read = warc.capture_history(pages, min_bytes=0)
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "range", "position")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those whose crc32(doc_id) leaves another remainder than 2 by 4."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language_id.learn(docs.where(~held_out).select("text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Lines (least length, edits) that count as repeated: equal ones, then 1 edit, 2, 3 and a fortieth of the length, as far as one word can band them.
LINE_BANDS = [(1, 0), (12, 1), (24, 2), (72, 3), *((40 * e, e) for e in range(4, line_dedup.MOST_EDITS + 1))]


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one within the edits of LINE_BANDS."""
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), bands=LINE_BANDS)
    return kept.select("doc_id", "n_lines", "n_removed", "n_links", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "class_docs", "class_lines")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that a smaller doc_id holds too."""
    kept = substring_dedup.repeated_windows(_table(spark, sf_dir, "documents"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of at most 2048 byte-level BPE ids."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048).drop("ids")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token ids, written to Elias-Fano indexed shards and read back."""
    back = token_store.store(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents by fixed patterns and by the randomness battery."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex", "random")),
        F.sha2(joined(of("assign", "access", "hex")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of documents."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of every 50th vector against all others."""
    vectors = impact_topk.quantise(_table(spark, sf_dir, "embeddings"), 256.0)
    return impact_topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations damaged by rule and repaired by the cheapest edits; one row for each, also where no row is left."""
    given = _table(spark, sf_dir, "conversations")
    report, rows = conversations.repair(conversations.damage(given))
    # keyed by conv_id as text behind a mark, so that a null one meets itself
    key = F.concat(F.when(F.col("conv_id").isNull(), "n").otherwise("v"), F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).alias("key")
    ids = given.select("conv_id").distinct().select("conv_id", key)
    found = ids.join(report.select(key, *(c for c in report.columns if c != "conv_id")), "key", "left").join(conversations.digests(rows).select(key, "sha256"), "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of documents, drawn towards the word pairs of benchmark."""
    drawn = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and the likelihood ratio of labelled good documents against all documents."""
    found = quality.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "weight", "limit")


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v) and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op10_impact_topk": OP10_SQL}
