"""Secret scan: fixed patterns and a randomness test battery, in DataFrame functions only.

The battery looks at every run of 20 or more characters of base64 and its URL
variant. The narrowest of the usual encodings that the run fits gives its
alphabet. Three tests of uniform randomness over it are combined by Fisher's
method into one p-value: chi-squared of the character counts, runs above and
below the alphabet's middle, and serial correlation of neighbours.

Truly random runs have uniform p-values, words and paths have small ones. In
each stratum (encoding and length band; short runs are harder to tell apart, so
each length has its own) the upper half of the p-values gives the number of
random runs, and the lowest threshold is taken above which the estimated share
of others stays below ``fdr``. A stratum of fewer than LEAST_RUNS runs takes the
threshold of its encoding over all lengths, and an encoding with as few that of
all runs together. The strata's histograms are counted over all documents; what
reaches the driver is one threshold for each stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.llm.workspace import materialise, new_workspace

# The patterns of the three base kinds, and the least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What every match of a pattern holds, in small letters; it spares most texts the pattern.
HOLDS = {ASSIGN: ("password", "passwd", "secret", "token", "apikey", "api_key"), ACCESS: ("akia",)}

RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
RUN_LEAST = 20
BANDS = 8
BINS = 100
#: Runs that a stratum needs for a threshold of its own.
LEAST_RUNS = 40
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, test and alphabet of each encoding, narrowest first.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("alpha", "^[a-z]+$", _LOWER),
    ("ALPHA", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("base36", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("BASE36", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("base62", "^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "", _UPPER + _LOWER + _DIGITS + "-_"),
)


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches: characters before each since the one before it, its own, and its value. Null if there are none."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    # split gives one part more than there are matches
    both = F.arrays_zip(F.slice(between, F.lit(1), F.size(found)).alias("between"), found.alias("found"), value.alias("value"))
    lengths = F.transform(both, lambda x: F.struct(F.length(x["between"]).alias("gap"), F.length(x["found"]).alias("n"), x["value"].alias("value")))
    likely = text.rlike(pattern)
    if pattern in HOLDS:
        some = F.lit(False)
        for word in HOLDS[pattern]:
            some = some | F.contains(F.lower(text), F.lit(word))
        likely = some & likely
    return F.when(likely, lengths)


def _spans(found: DataFrame) -> DataFrame:
    """(r, start, number, end, kind, value, encoding of random ones) of every match: a running sum of lengths in each text."""
    rows = None
    for number, kind in enumerate(KINDS):
        one = found.where(F.col(kind).isNotNull()).select("r", F.lit(number).alias("number"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("i", "x")).select("r", "number", "kind", "i", "x.*")
        one = one.withColumn("encoding", _encoding(F.col("value")) if kind == "random" else F.lit(None).cast("int"))
        rows = one if rows is None else rows.unionByName(one)
    before = Window.partitionBy("r", "number").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(before).cast("int")
    return rows.select("r", (end - F.col("n")).alias("start"), "number", end.alias("end"), "kind", "value", "encoding").where((F.col("kind") != "assign") | (F.length("value") >= ASSIGN_LEAST))


def _clear(spans: DataFrame) -> DataFrame:
    """Random runs that overlap no base span: none before reaches into one, and the next one begins behind it."""
    base = F.col("kind") != "random"
    ordered = Window.partitionBy("r").orderBy("start", "number")
    reach = F.max(F.when(base, F.col("end"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("start"))).over(ordered.rowsBetween(1, Window.unboundedFollowing))
    marked = spans.select("*", F.coalesce(reach > F.col("start"), F.lit(False)).alias("inside"), F.coalesce(following < F.col("end"), F.lit(False)).alias("covers"))
    return marked.where(base | ~(F.col("inside") | F.col("covers"))).drop("inside", "covers")


def _phi(z: Column) -> Column:
    """The normal distribution, by a logistic approximation good to 0.0002."""
    z = F.least(F.greatest(z, F.lit(-8.0)), F.lit(8.0))
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _encoding(run: Column) -> Column:
    """The number of the narrowest encoding that a run fits."""
    encoding = F.lit(len(ENCODINGS) - 1)
    for i, (_, test, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
        encoding = F.when(run.rlike(test), i).otherwise(encoding)
    return encoding


def _battery(run: Column, encoding: Column) -> Column:
    """(length, p) of a run of characters; encoding must be a column at hand, as it is looked up for each character."""
    alphabet = F.element_at(F.array(*[F.lit(letters) for _, _, letters in ENCODINGS]), encoding + 1)
    k = F.element_at(F.array(*[F.lit(float(len(letters))) for _, _, letters in ENCODINGS]), encoding + 1)
    n = F.length(run).cast("double")
    half, middle, spread = k / 2, (k - 1) / 2, (k * k - 1) / 12
    each = F.filter(F.split(run, ""), lambda c: c != "")
    # the sum of squared counts, as the sum of odd numbers along the sorted characters
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("k"), F.lit(0.0).alias("sum"))
    step = lambda acc, c, k: F.struct(c.alias("last"), k.alias("k"), (acc["sum"] + 2 * k - 1).alias("sum"))
    same = F.aggregate(F.array_sort(each), start, lambda acc, c: step(acc, c, F.when(acc["last"] == c, acc["k"] + 1).otherwise(1)), lambda acc: acc["sum"])
    # changes of side and products of neighbours; an index of -1 (a base64 run that mixes both variants' signs) counts as the letter before the first
    first = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("turns"), F.lit(0.0).alias("serial"))
    turned = lambda acc, i: F.when((acc["last"] >= half) != (i >= half), 1.0).otherwise(0.0)
    product = lambda acc, i: F.coalesce((acc["last"] - middle) * (i - middle), F.lit(0.0))
    pairs = F.aggregate(
        F.transform(each, lambda c: (F.instr(alphabet, c) - 1).cast("double")), first,
        lambda acc, i: F.struct(i.alias("last"), (acc["turns"] + turned(acc, i)).alias("turns"), (acc["serial"] + product(acc, i)).alias("serial")),
    )
    least = F.lit(1e-12)
    both_tails = lambda z: F.greatest(2 * (1 - _phi(F.abs(z))), least)

    def logs(v: Column) -> Column:
        chi = v["same"] * k / n - n
        p_chi = 1 - _phi((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))
        z_runs = (v["pairs"]["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        z_serial = v["pairs"]["serial"] / spread / F.sqrt(n - 1)
        return -(F.log(F.greatest(p_chi, least)) + F.log(both_tails(z_runs)) + F.log(both_tails(z_serial)))

    x = _once(F.struct(same.alias("same"), pairs.alias("pairs")), logs)
    return F.struct(F.length(run).alias("n"), _once(x, lambda x: F.exp(-x) * (1 + x + x * x / 2)).alias("p"))


def _once(value: Column, function) -> Column:
    """function(value), for which ``value`` is computed once however often it is used there."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _limits(histogram: DataFrame, by: list[str], fdr: float) -> DataFrame:
    """For each stratum of ``by`` with LEAST_RUNS runs or more the lowest bin that passes (BINS if none does)."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = histogram.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    above = F.sum("n").over(w.orderBy(F.desc("bin")))
    total = F.sum("n").over(w)
    random = 2 * F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).over(w) * (1 - F.col("bin") / BINS)
    found = counts.select(*by, "bin", above.alias("above"), random.alias("random"), total.alias("total")).where(F.col("total") >= LEAST_RUNS)
    passing = F.when((F.col("above") - F.least("above", "random")) <= fdr * F.col("above"), F.col("bin")).otherwise(BINS)
    return found.groupBy(*by).agg(F.min(passing).alias("limit"))


def _threshold(histogram: DataFrame, fdr: float) -> Column:
    """The least bin of a run (columns encoding, band) that passes; null without control."""
    levels = (["encoding", "band"], ["encoding"], [])
    key = lambda by: sum((F.col(c) * BANDS ** (1 - i) for i, c in enumerate(by)), F.lit(0)).cast("int")
    rows = None
    for level, by in enumerate(levels):
        one = _limits(histogram, by, fdr).select(F.lit(level).alias("level"), key(by).alias("key"), "limit")
        rows = one if rows is None else rows.unionByName(one)
    found = sorted(rows.collect())  # a row for each stratum of a level: len(ENCODINGS) * BANDS at most, and a few
    out = []
    for level, by in enumerate(levels):
        if own := [x for r in found if r.level == level for x in (r.key, r.limit)]:
            out.append(F.element_at(F.create_map(*map(F.lit, own)), key(by)))
    return F.coalesce(*out) if out else F.lit(None).cast("int")


def scan(docs: DataFrame, fdr: float = 0.05) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans: array of (start, number, end, kind, value), sorted by start and kind.

    Places are in code points, the end is exclusive. Kinds assign, access and hex
    are the fixed patterns; random are runs that pass the battery and overlap
    none of those. With fewer than LEAST_RUNS runs in all documents nothing can
    be said on the share of false discoveries, so no run is random. Null text is
    empty. Repeated rows and null doc_ids are scanned alike; cost is linear in a
    text's length, the length of its runs and the number of its matches. Other
    columns are ignored, no rows give no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    place = new_workspace(docs.sparkSession, "secrets")
    patterns = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "random": (RUN, 0)}
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("r"), text.alias("t"))
    found = materialise(texts.select("doc_id", "r", *[_matches(F.col("t"), *patterns[k]).alias(k) for k in KINDS]), f"{place}/found")
    tested = _clear(_spans(found)).select("*", F.when(F.col("kind") == "random", _battery(F.col("value"), F.col("encoding"))).alias("test"))
    kept = materialise(tested, f"{place}/tested")

    band = F.least(F.floor(2 * F.log2(F.col("test.n") / F.lit(float(RUN_LEAST)))), F.lit(BANDS - 1)).cast("int")
    bin_ = F.least(F.floor(F.col("test.p") * BINS), F.lit(BINS - 1)).cast("int")
    placed = kept.withColumns({"band": band, "bin": bin_})
    histogram = placed.where("kind = 'random'").groupBy("encoding", "band", "bin").agg(F.count(F.lit(1)).alias("n"))
    passing = placed.where((F.col("kind") != "random") | (F.col("bin") >= _threshold(histogram, fdr)))
    spans = passing.groupBy("r").agg(F.array_sort(F.collect_list(F.struct("start", "number", "end", "kind", "value"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,number:int,end:int,kind:string,value:string>>")
    return found.select("doc_id", "r").join(spans, "r", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))
