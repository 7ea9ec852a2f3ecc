"""Quality rules: fixed base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Two multinomials over hashed words and word pairs are counted: one over the trusted
documents, one over the whole raw corpus. A document's weight is the mean, over its
features, of the log ratio of the two (in thousandths, rounded down), so it does not
depend on length. A document passes if its weight reaches a limit.

The limit comes from trusted documents that the trusted multinomial was not counted
on: half of the trusted ones are counted, the other half says how far a clean but
unseen document falls. It lies as far below the lowest hundredth of that half as the
hundredth lies below its median, so the clean ones pass and what is left out is far
from any of them.

A text is split once for the counts and once for the weights; those of trusted
documents are counted once more, for which texts are joined with the trusted ids.
A bitmap of a fixed size, in which each trusted id sets the bit of its hash, goes
through first: what it leaves is shuffled, nearly only trusted texts while the ids are
few beside ``BITS``, never more than all. The join is by shuffle at every size, so
that disk grows with the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from corpuslake.llm.workspace import materialise, new_workspace

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
BUCKETS = 1 << 16
#: Bits of the map of trusted ids, 64 to a word.
BITS = 1 << 23


def _once(value: Column, function) -> Column:
    """function(value), for which ``value`` is computed once however often it is used there."""
    return F.element_at(F.transform(F.array(value), function), 1)


def words(text: Column) -> Column:
    """Runs of anything but white space; none in a blank text."""
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def _chained(hashes: Column, step: int) -> Column:
    """Hashes of each entry with the one ``step`` places behind it, where there is one."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; windows in text order."""

    def places(ordered: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        twin = F.filter(ordered, lambda x, j: same(x, F.get(ordered, j - 1)) | same(x, F.get(ordered, j + 1)))
        return F.sort_array(F.transform(twin, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _once(
        _once(ordered, places),
        lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, b: a + b),
    )


def _trusted(labels: DataFrame) -> DataFrame:
    """(doc_id, half): all documents of quality 1 that no row calls toxic; half 0 is counted, half 1 sets the limit, by hash."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    return good.where("quality = 1 and toxic = 0").select("doc_id", _half(_hash_of_id()).alias("half"))


def _hash_of_id() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"))


def _half(h: Column) -> Column:
    return F.shiftright(h, 1).bitwiseAND(1).cast("int")


def _place(h: Column) -> tuple[Column, Column]:
    """Word and bit of a hash in the map, from other bits than those of its half."""
    return F.shiftright(h, 16).bitwiseAND(BITS // 64 - 1).cast("int"), F.shiftright(h, 8).bitwiseAND(63).cast("int")


def _likely(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """The rows of ``texts`` that may have an id of ``counted`` (of half 0): all that have, and few others."""
    kinds = {type(x.schema["doc_id"].dataType) for x in (texts, counted)}
    if len(kinds) > 1 or not issubclass(*kinds, (IntegralType, StringType)):
        return texts  # ids that are equal may be spelt in two ways
    word, bit = _place(_hash_of_id())
    bits = counted.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
    found = [0] * (BITS // 64)
    for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect():  # a row for each word
        found[r.word] = r.bits
    stored = F.split(F.lit(",".join(map(str, found))), ",").cast("array<long>")
    return texts.where((_half(_hash_of_id()) == 0) & (F.getbit(F.get(stored, word), bit) == 1))


def _gains(raw: DataFrame, trusted: DataFrame) -> Column | None:
    """An array constant of each bucket's gain, from the buckets of all features and of trusted ones; null without trusted features."""
    rows = raw.groupBy("bucket").agg(F.count(F.lit(1)).alias("s"), F.lit(0).cast("long").alias("t")).unionByName(trusted.groupBy("bucket").agg(F.lit(0).cast("long").alias("s"), F.count(F.lit(1)).alias("t")))
    counted = rows.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()  # a row for each bucket
    s_all, t_all = sum(r.s for r in counted), sum(r.t for r in counted)
    if not t_all:
        return None
    gain = lambda s, t: math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS))))
    found = [gain(0, 0)] * BUCKETS
    for r in counted:
        found[r.bucket] = gain(r.s, r.t)
    return F.split(F.lit(",".join(map(str, found))), ",").cast("array<int>")


def scan(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text), labels (doc_id, quality, toxic) -> one row for each document.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a
    word, equal to an earlier line), n_repeat_words (words in windows of 8 words that
    the text has twice or more), base_failed (under 20 words, or over 30 % of words
    repeated), n_features (words and pairs), weight (null without features or without
    trusted documents), limit, kept: not base_failed and a weight of the limit or more.

    Words are runs of anything but white space; windows are equal if their 64-bit
    hashes are. Trusted documents are those of labels with quality 1 and toxic 0, all
    of them. Without trusted ones, or without any in the half that
    sets the limit, base rules alone decide. Null text is empty, a null doc_id is
    never trusted, rows that repeat a doc_id are judged each, other columns are
    ignored, no rows give no rows. Cost is linear in a text's length, but for texts
    with repeated windows, whose windows are sorted.
    """
    place = new_workspace(docs.sparkSession, "quality")
    trusted = materialise(_trusted(labels), f"{place}/trusted")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))

    def features(rows: DataFrame) -> DataFrame:
        singles = rows.select(hashed(words(F.col("t"))).alias("h"))
        return singles.select(F.explode(F.concat("h", _chained(F.col("h"), 1))).alias("f")).select(_bucket(F.col("f")).alias("bucket"))

    counted = trusted.where("half = 0").select("doc_id")
    gains = _gains(features(texts), features(_likely(texts, counted).join(counted.hint("merge"), "doc_id", "left_semi")))

    lines = F.filter(F.split("t", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    one = texts.select(
        "doc_id", words(F.col("t")).alias("w"), F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _once(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    two = one.select("doc_id", "n_symbols", "n_dup_lines", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), hashed(F.col("w")).alias("h"))
    three = two.withColumn("pairs", _chained(F.col("h"), 1))
    four = three.withColumn("windows", _chained(_chained(F.col("pairs"), 2), 4))
    n_repeat = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))).otherwise(F.lit(0).cast("long"))
    n_features = F.size("h") + F.size("pairs")
    total = lambda hashes: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + F.get(gains, _bucket(h)))
    weight = F.lit(None).cast("long") if gains is None else F.when(n_features > 0, F.floor((total(F.col("h")) + total(F.col("pairs"))) / n_features))
    scored = four.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", n_repeat.alias("n_repeat_words"), n_features.cast("long").alias("n_features"), weight.alias("weight"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = materialise(scored.withColumn("base_failed", failed), f"{place}/scored")

    # percentiles are exact: weights are whole numbers and counted by value
    judges = scored.where("not base_failed").select("doc_id", "weight").join(trusted.where("half = 1").select("doc_id"), "doc_id", "left_semi")
    unseen = judges.agg(F.percentile("weight", 0.5).alias("middle"), F.percentile("weight", 0.01).alias("low")).first()
    limit = None if unseen.low is None else math.floor(2 * unseen.low - unseen.middle)
    passing = F.lit(True) if limit is None else F.coalesce(F.col("weight") >= limit, F.lit(True))
    return scored.withColumn("limit", F.lit(limit).cast("long")).withColumn("kept", ~F.col("base_failed") & passing)
