"""Corpus lint: broken links, concepts without a note, stale years, concept contexts, secrets."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslake.functions import text as X
from corpuslake.functions.arrow import tidy
from corpuslake.functions.globs import fnmatch_regex

# Content patterns of credentials.
CONTENT_PATTERNS = {
    "api_key": r"sk-[a-zA-Z0-9]{20,}",
    "access_key": r"AKIA[0-9A-Z]{16}",
    "hub_token": r"gh[pousr]_[0-9A-Za-z]{36}",
    "chat_token": r"xox[baprs]-[0-9A-Za-z-]{10,}",
    "search_key": r"AIza[0-9A-Za-z\-_]{35}",
    "private_key": r"-----BEGIN .*PRIVATE KEY-----",
}
# File name patterns of private documents, of credentials in two languages, and of key files.
NAME_PATTERNS = (
    "*账号*", "*账户*", "*密码*", "*口令*", "*证件*", "身份证*", "护照*", "银行卡*",
    "*password*", "*passwd*", "*credentials*", "*credential*", "*secret*", "*token*", "*apikey*", "*api_key*", "*private*", "*sensitive*",
    "*.pem", "*.key", "*.keystore", "*.p12", "*.pfx", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", ".env", ".env.*", "htpasswd", ".netrc",
)

# Places of credentials; those that end in a slash are directories.
PLACES = (".aws/credentials", ".aws/config", ".gnupg/", ".ssh/")


def broken_links(broken: DataFrame) -> DataFrame:
    """Unresolved links, one of each (source, raw target, syntax), at its first line."""
    return broken.groupBy("source", "raw", "syntax").agg(F.min("line_no").alias("line_no"), F.min("reason").alias("reason"))


def concept_terms(notes: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """(term, path) of emphasised terms and code spans that look like concepts, one row for each time."""
    bold = F.transform(F.regexp_extract_all("content", F.lit(r"\*\*([^*]{2,30})\*\*"), F.lit(1)), lambda t: F.struct(F.trim(t).alias("term"), F.lit(False).alias("code")))
    code = F.transform(F.regexp_extract_all("content", F.lit(r"`([^`]{2,30})`"), F.lit(1)), lambda t: F.struct(F.trim(t).alias("term"), F.lit(True).alias("code")))
    return filter_terms(notes.select("path", F.explode(F.concat(bold, code)).alias("x")).select("path", "x.term", "x.code"), common)


def filter_terms(rows: DataFrame, common: tuple[str, ...] = ()) -> DataFrame:
    """Rows (path, term, code) whose term has 3 to 25 characters, a letter, is not common, and looks like a concept."""
    t = F.col("term")
    keep = F.length(t).between(3, 25) & t.rlike(f"[{X.CJK}A-Za-z]") & F.when(F.col("code"), t.rlike(r"^[A-Z][a-zA-Z0-9_\-/]+$")).otherwise(X.proper_noun(t))
    if common:
        keep = keep & ~F.lower(t).isin(*[c.lower() for c in common])
    return rows.where(keep).select("path", "term")


def orphan_concepts(terms: DataFrame, names: DataFrame, least: int = 3, most_terms: int = 60, top: int = 20) -> DataFrame:
    """(term, count) of frequent terms that no note is named after, nor nearly: equal but for case, or one within the other at no more than twice the length.

    Only the ``most_terms`` most frequent terms meet the names, so the fuzzy
    anti join broadcasts a side of that bound.
    """
    frequent = terms.groupBy("term").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "term").limit(most_terms).where(F.col("count") >= least)
    n, t = F.lower("name"), F.lower("term")
    ratio = F.greatest(F.length("name"), F.length("term")) / F.least(F.length("name"), F.length("term"))
    near = (n == t) | ((F.length("name") > 2) & (F.length("term") > 2) & (n.contains(t) | t.contains(n)) & (ratio <= 2))
    taken = names.select(F.col("basename").alias("name")).distinct().join(F.broadcast(frequent), near).select("term").distinct()
    return frequent.join(taken, "term", "left_anti").orderBy(F.desc("count"), "term").limit(top)


def stale_years(notes: DataFrame, current_year: int) -> DataFrame:
    """(path, year, context): the first year 2000 to 2059 before last year, dated forms before bare ones, with 25 characters around it."""
    dated, bare = r"(?U)(?<!\w)20[0-5]\d\s*[年/\-]", r"(?U)(?<!\w)20[0-5]\d(?!\w)"
    has_dated = F.col("content").rlike(dated)

    def first(pattern: str) -> Column:
        found, between = F.regexp_extract_all("content", F.lit(pattern), F.lit(0)), F.split("content", pattern, -1)
        places = F.aggregate(
            F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("out")),
            lambda acc, x: F.struct((acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["b"])).alias("start"), x["m"].alias("text")))).alias("out")),
            lambda acc: acc["out"],
        )
        return F.get(F.filter(places, lambda p: F.substring(p["text"], 1, 4).cast("int") < current_year - 1), F.lit(0))

    hit = notes.where(F.col("content").rlike(bare) | has_dated).select("path", "content", F.when(has_dated, first(dated)).otherwise(first(bare)).alias("p")).where("p is not null")
    start = F.greatest(F.lit(0), F.col("p.start") - 25)
    end = F.col("p.start") + F.length("p.text") + 25
    return hit.select("path", F.substring("p.text", 1, 4).cast("int").alias("year"), F.trim(F.regexp_replace(F.substring(F.col("content"), start + 1, end - start), "\n", " ")).alias("context"))


#: Terms of one automaton. Each block of as many is a pass over the notes of its own.
TERMS_AT_ONCE = 50_000
#: Characters around a term that are shown whatever they are, and marks that end a sentence.
AROUND, ENDS = 80, ".。!！?？\n"
_REST = re.compile(f"[^{ENDS}]*")


def _context(text: str, at: int, n: int, most: int) -> str:
    """The neighbourhood of n characters from ``at`` and its sentence, from the end mark before it on, on one line, cut to ``most`` characters."""
    low, high = max(at - AROUND, 0), at + n + AROUND
    lead = text[max(0, *(text.rfind(m, 0, low) for m in ENDS)) : low]
    found = (lead + text[low:high] + _REST.match(text, high)[0]).replace("\n", " ").strip(" ")
    return found[:most] + "..." if len(found) > most else found


def term_hits(notes: DataFrame, terms: DataFrame, most: int = 200) -> DataFrame:
    """notes (path, content), terms (term) -> (term, path, context): every note that holds a term, in any case, with the surroundings of its first place.

    An automaton of all terms reads each note once, however many terms there are.
    Null and empty terms and contents are left out; repeated terms count once.
    """
    rows = notes.where("content is not null").select("path", "content", F.lower("content").alias("low"))
    kind = dict(rows.dtypes)["path"]
    out = rows.sparkSession.createDataFrame([], f"term string, path {kind}, context string")

    def reader(block: list[tuple[str, str]]):
        by_low: dict[str, list[str]] = {}
        for term, low in block:
            by_low.setdefault(low, []).append(term)

        def read(batches):
            machine = ahocorasick.Automaton()
            for low in by_low:
                machine.add_word(low, low)
            machine.make_automaton()
            for b in batches:
                found: list[tuple] = []
                for path, content, low in zip(*(c.to_pylist() for c in b.columns)):
                    first: dict[str, int] = {}
                    for end, word in machine.iter(low):
                        first.setdefault(word, end + 1 - len(word))
                    for word, at in first.items():
                        shown = _context(content, at, len(word), most)
                        found += [(term, path, shown) for term in by_low[word]]
                columns = list(zip(*found)) or [(), (), ()]
                yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], b.column(0).type), pa.array(columns[2], pa.string())], names=["term", "path", "context"])

        return read

    block: list[tuple[str, str]] = []
    wanted = terms.where("term <> ''").select("term", F.lower("term").alias("low")).distinct()
    for r in wanted.toLocalIterator():
        block.append((r.term, r.low))
        if len(block) == TERMS_AT_ONCE:
            out, block = out.unionByName(rows.mapInArrow(tidy(reader(block)), out.schema)), []
    return out.unionByName(rows.mapInArrow(tidy(reader(block)), out.schema)) if block else out


def term_contexts(hits: DataFrame, sources: int = 4) -> DataFrame:
    """(term, notes, path, context): the first notes of each term by path, and how many hold it."""
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).alias("notes"))
    order = Window.partitionBy("term").orderBy("path")
    first = hits.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sources).drop("r")
    return first.join(counts, "term").select("term", "notes", "path", "context")


def concept_contexts(notes: DataFrame, term: str, most: int = 200, sources: int = 4) -> DataFrame:
    """(path, context) of the first notes that hold a term: its sentence and its neighbourhood, cut to ``most`` characters."""
    terms = notes.sparkSession.createDataFrame([(term,)], "term string")
    return term_contexts(term_hits(notes, terms, most), sources).select("path", "context").orderBy("path")


def contradiction_candidates(terms: DataFrame, top: int = 30, candidates: int = 8) -> DataFrame:
    """(term, n): the concepts in most notes, those in two or more."""
    return terms.groupBy("term").agg(F.countDistinct("path").alias("n")).where("n >= 2").orderBy(F.desc("n"), "term").limit(min(top, candidates))


def contradictions(terms: DataFrame, notes: DataFrame, judge, top: int = 30, candidates: int = 8) -> list[dict]:
    """Verdicts of a model on the contexts of the most frequent concepts; negative answers are dropped. One pass over the notes serves all concepts."""
    chosen = [(r.term, r.n) for r in contradiction_candidates(terms, top, candidates).collect()]  # ``candidates`` rows
    found = term_contexts(term_hits(notes, notes.sparkSession.createDataFrame(chosen, "term string, n long"))) if chosen else None
    of: dict[str, list[tuple[str, str]]] = {}
    for r in found.orderBy("term", "path").collect() if chosen else []:  # a few rows for each
        of.setdefault(r.term, []).append((r.path, r.context))
    out = []
    for term, _ in chosen:
        contexts = of.get(term, [])
        answer = judge(term, contexts)
        if answer and not answer.strip().lower().startswith(("no ", "none", "no.")):
            out.append({"term": term, "verdict": answer, "sources": [p for p, _ in contexts]})
    return out


def secrets_in(content: Column) -> Column:
    """Names of the content patterns that a text holds."""
    return F.filter(F.array(*[F.when(content.rlike(p), F.lit(k)) for k, p in CONTENT_PATTERNS.items()]), lambda x: x.isNotNull())


def private_name(name: Column) -> Column:
    """Whether a file name is one of private documents or credentials, in any case."""
    out = F.lit(False)
    for p in NAME_PATTERNS:
        out = out | F.lower(name).rlike(fnmatch_regex(p.lower()))
    return out


def private_path(path: Column) -> Column:
    """Whether a path is private by its name, or lies at a place where credentials are kept."""
    slashed = F.concat(F.lit("/"), F.lower(path))
    out = private_name(F.element_at(F.split(path, "/"), -1))
    for p in PLACES:
        out = out | (slashed.contains(f"/{p}") if p.endswith("/") else slashed.endswith(f"/{p}"))
    return out


