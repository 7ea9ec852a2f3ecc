"""The link graph: extraction, resolution, edges, degrees, traversals, communities and their statistics.

Iterations cut their lineage with ``checkpoint()``; the frontier of a traversal
is a relation, and only its size reaches the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpuslake.config import EngineConfig
from corpuslake.functions import links as L
from corpuslake.functions import paths as P
from corpuslake.functions import text as X
from corpuslake.session import cut_lineage, remove, scratch

EDGE = "src string, dst string, type string, weight double, count long, raw_target string, link_syntax string, confidence string, reason string"


# ------------------------------------------------------------ links


def links(notes: DataFrame) -> DataFrame:
    """(source, line_no, pos, syntax, display, raw) of wiki links and internal inline links outside code."""
    rows = notes.select(F.col("path").alias("source"), F.explode(X.content_lines(F.coalesce("content", F.lit("")))).alias("x")).select("source", "x.line_no", "x.line")
    wiki = rows.where(F.col("line").contains("[[")).select("source", "line_no", F.posexplode(L.wiki_targets(F.col("line"))).alias("pos", "raw")).select("source", "line_no", "pos", F.lit("wiki").alias("syntax"), F.lit("").alias("display"), "raw")
    inline = rows.where(F.col("line").contains("](")).select("source", "line_no", F.posexplode(L.inline_links(F.col("line"))).alias("pos", "x"))
    md = inline.select("source", "line_no", "pos", F.lit("md").alias("syntax"), F.col("x.display").alias("display"), F.col("x.target").alias("raw")).where(L.internal_candidate(F.col("raw")))
    return wiki.unionByName(md)


def resolve(found: DataFrame, notes: DataFrame) -> DataFrame:
    """found with target, or null and a reason: by path, then alias, then base name; of several candidates the one that shares most leading directories, then the least path.

    notes: path, basename, aliases. Ambiguous names go up a ladder: each has its least
    path below every directory, a link's source looks up its own directories, and
    the deepest that is there decides. No link ever meets the list of candidates.
    """
    t = F.when(F.col("syntax") == "md", F.trim(F.regexp_extract(F.coalesce(F.try_url_decode(F.regexp_replace(F.trim("raw"), r"\+", "%2B")), F.trim("raw")), r"(?s)^([^#]*)", 1))).otherwise(F.trim("raw"))
    d = P.directory(F.col("source"))
    joined = P.normalised(F.concat(d, F.lit("/"), F.col("t")))
    slash = F.col("t").contains("/")
    base = F.when((F.col("syntax") == "wiki") & ~F.col("t").startswith("."), F.col("t")).otherwise(joined)
    with_md = F.when(base.endswith(".md"), base).otherwise(F.concat(base, F.lit(".md")))
    rows = found.withColumn("t", t).withColumn("by_path", F.when(slash, with_md)).withColumn("by_literal", F.when(slash & (F.col("syntax") == "md"), base)).withColumn("by_name", F.when(~slash & (F.col("t") != ""), F.regexp_replace("t", r"\.md$", "")))
    rows = rows.withColumn("by_alias", F.when(~slash & (F.col("t") != ""), F.col("t"))).withColumn("id", F.monotonically_increasing_id())
    known = notes.select("path").distinct()
    alias = notes.select("path", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min("path").alias("alias_path"))
    names = notes.groupBy("basename").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("only"))
    out = (
        rows.join(known.withColumnRenamed("path", "p1"), F.col("by_path") == F.col("p1"), "left")
        .join(known.withColumnRenamed("path", "p2"), F.col("by_literal") == F.col("p2"), "left")
        .join(alias, F.col("by_alias") == F.col("alias"), "left")
        .join(names, F.col("by_name") == F.col("basename"), "left")
    )
    sure = F.coalesce("p1", "p2", "alias_path", F.when(F.col("n") == 1, F.col("only")))
    out = out.withColumn("target", sure)
    several = names.where("n > 1").select(F.col("basename").alias("by_name"))
    rungs = notes.select(F.col("basename").alias("by_name"), "path").join(several, "by_name", "left_semi").select("by_name", "path", F.explode(P.ancestors(F.col("path"))).alias("above"))
    ladder = rungs.groupBy("by_name", "above").agg(F.min("path").alias("cand"))
    asked = out.where(F.col("target").isNull() & (F.col("n") > 1)).select(d.alias("dir"), "by_name").distinct()
    steps = asked.select("dir", "by_name", F.explode(P.ancestors(F.concat("dir", F.when(F.col("dir") == "", "").otherwise("/"), F.lit("x")))).alias("above"))
    closest = steps.join(ladder, ["by_name", "above"]).groupBy("dir", "by_name").agg(F.max_by("cand", F.length("above")).alias("closest"))
    out = out.withColumn("dir", d).join(closest, ["dir", "by_name"], "left").withColumn("target", F.coalesce("target", F.when(F.col("n") > 1, F.col("closest"))))
    reason = F.when(F.col("target").isNotNull(), None).when(F.col("t") == "", "empty target").when(slash, F.concat(F.lit("path not found: "), "t")).otherwise(F.concat(F.lit("basename not found: "), "t"))
    return out.select(*found.columns, "target", reason.alias("reason"))


def link_edges(resolved: DataFrame) -> DataFrame:
    """One edge for each (source, target, syntax): how often, and the first raw target; links to oneself are dropped."""
    hit = resolved.where(F.col("target").isNotNull() & (F.col("target") != F.col("source")))
    first = F.min_by("raw", F.struct("line_no", "pos"))
    return hit.groupBy(F.col("source").alias("src"), F.col("target").alias("dst"), F.col("syntax").alias("link_syntax")).agg(F.count(F.lit(1)).alias("count"), first.alias("raw_target")).select(
        "src", "dst", F.lit("user-wikilink").alias("type"), F.lit(1.0).alias("weight"), "count", "raw_target", "link_syntax", F.lit("EXTRACTED").alias("confidence"), F.lit(None).cast("string").alias("reason")
    )


def semantic_edges(related: DataFrame, config: EngineConfig = EngineConfig(), legacy_rounding: bool = False) -> DataFrame:
    """related (a, b, similarity) above the threshold as edges, the heaviest of each pair."""
    w = F.round("similarity", 2) if legacy_rounding else F.col("similarity")
    rows = related.where(F.col("a") != F.col("b")).withColumn("w", w).where(F.col("w") > config.semantic_edge).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("w").alias("weight"))
    null = lambda t: F.lit(None).cast(t)
    return rows.select("src", "dst", F.lit("semantic").alias("type"), "weight", null("long").alias("count"), null("string").alias("raw_target"), null("string").alias("link_syntax"), F.when(F.col("weight") >= config.semantic_inferred, "INFERRED").otherwise("AMBIGUOUS").alias("confidence"), null("string").alias("reason"))


def related_bands(related: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """related with its band: strong from the inferred threshold on, else weak; and the two-decimal form with the target's stem."""
    strong = F.col("similarity") >= config.semantic_inferred
    return related.where(F.col("similarity") >= config.related_least).select("a", "b", "similarity", F.when(strong, "strong").otherwise("weak").alias("band"), F.bround("similarity", 2).alias("shown"), P.stem(F.col("b")).alias("target"))


def broken(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("target").isNull()).drop("target")


def classify_broken(rows: DataFrame, attachment_keys: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """rows with category, and the attachment that has the target's name; the first rule that holds decides."""
    clean, base = L.clean_target(F.col("raw")), L.target_name(F.col("raw"))
    # Targets that web clippers leave, and documents about the corpus itself.
    clip, meta = ("↩", "link", "PDF", "HTML"), ("AGENTS.md", "README.md", "CHANGELOG.md")
    keyed = rows.withColumn("key", F.lower(base)).join(attachment_keys.withColumnRenamed("path", "attachment"), "key", "left").drop("key")
    plain_suffix = P.suffix(clean) == ""
    category = (
        F.when((F.col("syntax") == "wiki") & F.trim("raw").isin(*clip), "CLIP-JUNK")
        .when(F.regexp_replace(clean, r"^[./]+", "").startswith("docs/") | base.isin(*meta), "META-DOC")
        .when(P.archived(F.col("source"), config.archive_markers) | F.col("source").contains("/archived/"), "ARCHIVED")
        .when(F.col("attachment").isNotNull(), "ATTACHMENT-EXISTS")
        .when((F.col("syntax") == "md") & (F.trim("raw").startswith("[") | F.col("raw").contains("](")), "SYNTAX-NOISE")
        .when((F.col("syntax") == "wiki") & ~clean.contains("/") & plain_suffix & (F.length(clean) <= 30), "CONCEPT-CANDIDATE")
        .otherwise("REAL-BROKEN")
    )
    return keyed.withColumn("category", category).withColumn("attachment", F.when(F.col("category") == "ATTACHMENT-EXISTS", F.col("attachment")))


# ------------------------------------------------------------ nodes


def nodes(notes: DataFrame, edges: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """notes (path, ...) with category, archived and four degrees; inline links count as wiki links."""
    wiki, sem = F.col("type") == "user-wikilink", F.col("type") == "semantic"
    into = edges.groupBy(F.col("dst").alias("path")).agg(F.count_if(wiki).alias("in_degree_wiki"), F.count_if(sem).alias("in_degree_semantic"))
    out = edges.groupBy(F.col("src").alias("path")).agg(F.count_if(wiki).alias("out_degree_wiki"), F.count_if(sem).alias("out_degree_semantic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    kept = [c for c in notes.columns if c not in ("content", "category", "archived")]
    have = lambda c, made: F.col(c) if c in notes.columns else made.alias(c)
    return notes.join(into, "path", "left").join(out, "path", "left").select(
        *kept, have("category", P.category(F.col("path"), config.inbox)), have("archived", P.archived(F.col("path"), config.archive_markers)),
        zero("in_degree_wiki"), zero("in_degree_semantic"), zero("out_degree_wiki"), zero("out_degree_semantic"),
    )


def backlinks(edges: DataFrame, target: str) -> DataFrame:
    """Edges that end in the target, distinct, by source and type."""
    return edges.where(F.col("dst") == target).select(F.col("src").alias("source"), "type").distinct().orderBy("source", "type")


def link_backlinks(resolved: DataFrame, target: str) -> DataFrame:
    """Single links to the target with their lines."""
    return resolved.where(F.col("target") == target).select("source", "line_no", F.col("syntax").alias("link_type"), "raw").distinct().orderBy("source", "line_no", "link_type", "raw")


def find_backlinks(edges: DataFrame, resolved: DataFrame, target: str) -> DataFrame:
    """The graph's answer, or the links' where the graph has none."""
    by_graph = backlinks(edges, target)
    return by_graph if not by_graph.isEmpty() else link_backlinks(resolved, target)


def orphans_by_stem(notes: DataFrame, found: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Notes whose stem no link names, resolved or not; ``more`` (raw) are links that machines keep."""
    raw = found.select("raw") if more is None else found.select("raw").unionByName(more.select("raw"))
    named = raw.select(P.stem(L.clean_target(F.col("raw"))).alias("basename")).distinct()
    return notes.join(named, "basename", "left_anti")


def orphans_by_graph(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("in_degree_wiki = 0")


def god_nodes(nodes_: DataFrame, top: int = 15) -> DataFrame:
    total = F.col("in_degree_wiki") + F.col("in_degree_semantic")
    return nodes_.where(~F.col("archived") & (total > 0)).withColumn("total_in", total).orderBy(F.desc("total_in"), "path").limit(top)


def cross_category(edges: DataFrame, nodes_: DataFrame, top: int = 10) -> DataFrame:
    """The heaviest inferred edges between categories, one of each undirected pair."""
    cat = nodes_.select("path", "category")
    rows = edges.where("confidence = 'INFERRED'").join(cat.withColumnsRenamed({"path": "src", "category": "src_cat"}), "src").join(cat.withColumnsRenamed({"path": "dst", "category": "dst_cat"}), "dst").where("src_cat <> dst_cat")
    one = rows.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(F.min_by(F.struct("src", "src_cat", "dst", "dst_cat", "weight"), F.struct("src", "dst")).alias("e"))
    return one.select("e.*").orderBy(F.desc(F.round("weight", 6)), "src", "dst").limit(top)


# ------------------------------------------------------------ traversals


def neighbors(edges: DataFrame, start: str, max_hops: int = 2, types: tuple[str, ...] = ("user-wikilink", "semantic"), least: float = 0.75) -> DataFrame:
    """(path, edge_type, weight, hop): every qualifying edge whose source is fewer than ``max_hops`` hops from the start."""
    kind = F.lit(False)
    for t in types:
        kind = kind | F.col("type").contains(t)
    e = edges.where(kind & (F.coalesce("weight", F.lit(1.0)) >= least)).select("src", "dst", "type", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    spark = edges.sparkSession
    near = spark.createDataFrame([(start, 0)], "node string, hop int")
    frontier = near
    for hop in range(1, max_hops):
        frontier = e.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(near, "node", "left_anti").withColumn("hop", F.lit(hop))
        if hop >= 3:
            frontier = cut_lineage(frontier)
            if frontier.isEmpty():
                break
        near = near.unionByName(frontier)
    return e.join(near.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("path"), F.col("type").alias("edge_type"), "weight", (F.col("hop") + 1).alias("hop")).orderBy("hop", F.desc("weight"), "path")


#: Hops that one job takes of the walk along a path that is found.
HOPS = 8


class _Reach:
    """Distances from one end: levels of (node, prev, type, hop), as far as they have been asked for."""

    def __init__(self, both: DataFrame, start: str):
        first = both.sparkSession.createDataFrame([(start, None, "start", 0)], "node string, prev string, type string, hop int")
        self.both, self.levels, self.size, self.ended = both, [first], 1, False

    @property
    def hops(self) -> int:
        return len(self.levels) - 1

    def grow(self) -> DataFrame:
        """One level more; its nodes."""
        last, hop = self.levels[-1], len(self.levels)
        # a neighbour of the last level is in it, in the one before, or new
        near = last.select("node").unionByName(self.levels[-2].select("node")) if hop > 1 else last.select("node")
        at = self.both.join(last.select(F.col("node").alias("src")), "src")
        found = at.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("o", "src", "type")).alias("p")).join(near, "node", "left_anti")
        new = cut_lineage(found.select("node", F.col("p.src").alias("prev"), F.col("p.type").alias("type"), F.lit(hop).alias("hop")))
        self.size = new.count()
        if self.size:
            self.levels.append(new)
        else:
            self.ended = True
        return new


def shortest_path(edges: DataFrame, source: str, target: str) -> list[dict[str, str]]:
    """Nodes from source to target over edges in either direction, each with the type of the edge that leads to it; empty if there is none.

    The search goes on from the end whose last level is smaller until both have met;
    there is no limit of hops. A node's predecessor is the one
    of the smallest (order, src): ``edge_ord`` is the edges' order if they have one.
    """
    if source == target:
        return [{"path": source, "edge_type": "self"}]
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.xxhash64("src", "dst", "type")
    e = edges.where("src <> dst").select("src", "dst", "type", order.alias("o"))
    both = cut_lineage(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "o")))
    ahead, back = _Reach(both, source), _Reach(both, target)
    length = None
    while length is None:
        side, other = (ahead, back) if (ahead.size <= back.size and not ahead.ended) or back.ended else (back, ahead)
        if side.ended:
            return []
        new = side.grow()
        # the first level that meets the other side meets its last one
        if not side.ended and not new.join(other.levels[-1].select("node"), "node", "left_semi").isEmpty():
            length = ahead.hops + back.hops
    # where both halves meet, and from there only nodes that lie on a shortest path
    middle = min(ahead.hops, length)
    steps = ahead.levels[1 : middle + 1]
    layer = ahead.levels[middle].join(back.levels[length - middle].select("node"), "node", "left_semi") if length > middle else ahead.levels[middle]
    for hop in range(middle + 1, length + 1):
        at = both.join(layer.select(F.col("node").alias("src")), "src").join(back.levels[length - hop].select(F.col("node").alias("dst")), "dst", "left_semi")
        layer = at.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("o", "src", "type")).alias("p")).select("node", F.col("p.src").alias("prev"), F.col("p.type").alias("type"), F.lit(hop).alias("hop"))
        if hop % HOPS == 0:
            layer = cut_lineage(layer)
        steps.append(layer)
    out, at = [], target
    while steps:
        here, steps = steps[-HOPS:][::-1], steps[:-HOPS]
        walk = here[0].where(F.col("node") == at).select(F.col("prev").alias("at"), F.array(F.struct("node", "type")).alias("seen"))
        for x in here[1:]:
            walk = walk.join(x, F.col("at") == F.col("node")).select(F.col("prev").alias("at"), F.concat("seen", F.array(F.struct("node", "type"))).alias("seen"))
        row = walk.first()
        out += [{"path": x.node, "edge_type": x.type} for x in row.seen]
        at = row.at
    return [{"path": source, "edge_type": "start"}, *out[::-1]]


# ------------------------------------------------------------ communities


#: Share of the nodes that may move in a round while many want to, and at most; where so many in 20 or fewer want to, crowds are not looked at.
AWAKE, MOST_AWAKE, FEW = 0.5, 0.95, 20


def _wishes(adjacent: DataFrame, state: DataFrame, twice: float, number: int, share: float) -> tuple[DataFrame, Observation]:
    """(node, comm, k, to, gain, go) of every node, and figures of the state as it is: inner and squares give its modularity, want says how many nodes gain by a move, n how many there are.

    adjacent: src, dst, w in both directions; state: node, comm, k (weighted degree).
    A node's wish is the neighbouring community of greatest gain. Edges are shuffled
    twice, to the community of one end and to the other end; the rest is as large as nodes are.
    """
    now = state.join(state.groupBy("comm").agg(F.sum("k").alias("all")), "comm")
    to = now.select(F.col("node").alias("dst"), F.col("comm").alias("c"), "all")
    near = adjacent.join(to, "dst").select("src", "c", "w", "all").repartition("src").groupBy("src", "c").agg(F.sum("w").alias("w"), F.first("all").alias("all"))
    own = now.select(F.col("node").alias("src"), F.col("comm").alias("own"), "k", F.col("all").alias("full"))
    same = F.col("c") == F.col("own")
    worth = F.col("w") - F.col("all") * F.col("k") / twice
    best = own.join(near, "src", "left").groupBy("src").agg(
        F.first("own").alias("comm"), F.first("k").alias("k"), F.first("full").alias("full"), F.coalesce(F.max(F.when(same, F.col("w"))), F.lit(0.0)).alias("inner"),
        F.min(F.when(~same, F.struct((-F.round(worth, 9)).alias("m"), "c", worth.alias("worth")))).alias("x"),
    )
    gain = F.coalesce(F.col("x.worth") - F.col("inner") + (F.col("full") - F.col("k")) * F.col("k") / twice, F.lit(0.0))
    awake = F.pmod(F.xxhash64("src", F.lit(number)), F.lit(1000)) < int(1000 * share)
    rows = best.withColumn("gain", gain).withColumn("go", (F.col("gain") > 1e-9) & awake)
    seen = Observation()
    rows = rows.observe(seen, F.sum("inner").alias("inner"), F.sum(F.col("k") * F.col("full")).alias("squares"), F.count_if(F.col("gain") > 1e-9).alias("want"), F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("src").alias("node"), "comm", "k", F.col("x.c").alias("to"), "gain", "go"), seen


def _admitted(wishes: DataFrame, twice: float, number: int) -> DataFrame:
    """The next state, where many may want the same community, whose weight then grows.

    They are dealt to levels, each half as full as the one before, and one moves if
    that still pays with all of its own and the emptier ones before it; the first of a
    community always does.
    """
    # level i with a share of 2 ** -(i + 1), from the leading zeros of a hash; the emptiest go first
    level = F.length(F.regexp_extract(F.lpad(F.bin(F.xxhash64("node", F.lit(number), F.lit("level"))), 64, "0"), "^0*", 0))
    asking = wishes.where("go").select("node", "to", "gain", "k", level.alias("level"))
    order = F.struct(F.round("gain", 9).alias("g"), F.xxhash64("node").alias("h"), "node")
    ahead = Window.partitionBy("to").orderBy(F.desc("level"))  # 65 levels at most
    crowd = asking.groupBy("to", "level").agg(F.sum("k").alias("sum"), F.max(order).alias("x"))
    crowd = crowd.select("to", "level", F.sum("sum").over(ahead).alias("ahead"), F.max("x").over(Window.partitionBy("to"))["node"].alias("first"))
    pays = (F.col("node") == F.col("first")) | (F.col("gain") - (F.col("ahead") - F.col("k")) * F.col("k") / twice > 1e-9)
    moves = asking.join(crowd, ["to", "level"]).where(pays).select("node", F.col("to").alias("moved"))
    return wishes.select("node", "comm", "k").join(moves, "node", "left").select("node", F.coalesce("moved", "comm").alias("comm"), "k")


def _moved(adjacent: DataFrame, state: DataFrame, twice: float, least: float, number: int) -> DataFrame:
    """``state`` after rounds of local moves, or itself if none is left that pays.

    In a round a part of the nodes, drawn anew by hash, move at once; fewer than all, so
    that neighbours seldom swap, and nearly all when few want to move. The next
    round measures what that has brought; a round by which modularity falls is taken
    back. It ends when two in a row gain less than ``least``.
    """
    spark = state.sparkSession
    kept, best, still, share, crowded, made = state, None, 0, AWAKE, True, []

    def only(*needed: DataFrame) -> None:
        """Other tables of the rounds go."""
        for df, where in [x for x in made if not any(x[0] is y for y in needed)]:
            remove(spark, where)
        made[:] = [x for x in made if any(x[0] is y for y in needed)]

    while True:
        number += 1
        rows, seen = _wishes(adjacent, state, twice, number, share)
        if crowded:
            made.append((wishes := cut_lineage(rows, at := scratch(spark, "moves")), at))
            new = _admitted(wishes, twice, number)
        else:
            new = rows.select("node", F.when(F.col("go"), F.col("to")).otherwise(F.col("comm")).alias("comm"), "k")
        made.append((new := cut_lineage(new, at := scratch(spark, "moves")), at))
        found = seen.get
        quality, want, n = found["inner"] / twice - found["squares"] / twice**2, found["want"], found["n"]
        fell = False
        if best is None:
            best = quality
        elif state is not kept:
            still = 0 if quality - best >= least else still + 1
            fell = quality - best <= 1e-12
            if not fell:
                kept, best = state, quality
        if still == 2 or (state is kept and not want):
            only(kept)
            return kept
        share = AWAKE if fell else 1.0 if want == 1 else min(MOST_AWAKE, max(AWAKE, 1 - 3 * want / n))
        crowded = want * FEW > n
        state = kept if fell else new
        only(state, kept)


def modularity(pairs: DataFrame, labels: DataFrame) -> float:
    """pairs (a, b, w), each once; labels (path, leader) of all their nodes."""
    m = pairs.agg(F.sum("w")).first()[0]
    if not m:
        return 0.0
    side = lambda c: labels.select(F.col("path").alias(c), F.col("leader").alias(f"l_{c}"))
    placed = pairs.join(side("a"), "a").join(side("b"), "b")
    inner = placed.where("l_a = l_b").agg(F.sum("w")).first()[0] or 0.0
    ends = placed.select(F.col("l_a").alias("l"), "w").unionByName(placed.select(F.col("l_b").alias("l"), "w"))
    return inner / m - ends.groupBy("l").agg(F.sum("w").alias("k")).agg(F.sum(F.pow(F.col("k") / (2 * m), 2))).first()[0]


def louvain(pairs: DataFrame, least: float = 1e-5) -> DataFrame:
    """pairs (a, b, w), each once -> (path, leader): communities of greatest modularity found by local moves, named by their smallest member.

    Rounds of moves go on until two in a row gain less than ``least``; then communities
    become nodes, edges between them are added up, and it starts again until nothing
    moves. Only modularity and the number of nodes that want to move reach the driver.
    """
    adjacent = cut_lineage(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w")))
    state = cut_lineage(adjacent.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).select("node", F.col("node").alias("comm"), "k"))
    twice = state.agg(F.sum("k")).first()[0] or 0.0
    member = state.select(F.col("node").alias("path"), F.col("node").alias("leader"))
    for number in itertools.count(0, 1 << 20):
        before = state
        state = _moved(adjacent, state, twice, least, number) if twice else state
        if state is before:
            break
        names = state.groupBy("comm").agg(F.min("node").alias("name"))
        named = cut_lineage(state.join(names, "comm").select("node", "name", "k"))
        member = cut_lineage(member.join(named.select(F.col("node").alias("leader"), "name"), "leader").select("path", F.col("name").alias("leader")))
        side = lambda c: named.select(F.col("node").alias(c), F.col("name").alias(f"n_{c}"))  # noqa: E731, B023
        joined = adjacent.join(side("src"), "src").join(side("dst"), "dst").where("n_src <> n_dst")
        adjacent = cut_lineage(joined.groupBy(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")).agg(F.sum("w").alias("w")))
        state = cut_lineage(named.groupBy(F.col("name").alias("node")).agg(F.sum("k").alias("k")).select("node", F.col("node").alias("comm"), "k"))
    return member


def communities(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, community_id): -2 archived, -1 without edges, else numbers by falling size, ties by smallest member.

    Louvain over relations, with rules in place of a random seed, so equal inputs give equal results.
    """
    live = nodes_.where(~F.col("archived")).select("path")
    order = F.col("edge_ord") if "edge_ord" in edges.columns else F.struct("src", "dst", "type")
    flat = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.coalesce("weight", F.lit(1.0)).alias("w"), order.alias("o"))
    pairs = cut_lineage(flat.join(live.withColumnRenamed("path", "a"), "a", "left_semi").join(live.withColumnRenamed("path", "b"), "b", "left_semi").groupBy("a", "b").agg(F.max_by("w", "o").alias("w")))
    placed = louvain(pairs)
    ranked = _dense_rank(placed.groupBy("leader").agg(F.count(F.lit(1)).alias("size")))
    found = placed.join(ranked, "leader").select("path", "community_id")
    return nodes_.select("path", "archived").join(found, "path", "left").select("path", F.when(F.col("archived"), -2).otherwise(F.coalesce("community_id", F.lit(-1))).cast("int").alias("community_id"))


def _dense_rank(sizes: DataFrame) -> DataFrame:
    """Communities numbered from 0 by falling size. Sizes are counted first, so that the only global order is over distinct sizes."""
    by_size = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
    base = by_size.select("size", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = sizes.withColumn("r", F.row_number().over(Window.partitionBy("size").orderBy("leader")) - 1)
    return within.join(base, "size").select("leader", (F.col("base") + F.col("r")).alias("community_id"))


def community_stats(members: DataFrame, edges: DataFrame, top: int = 15) -> DataFrame:
    """(community_id, size, cohesion, categories, hubs) of the largest communities.

    members: path, community_id, category, total_in. Cohesion is the share of
    possible undirected pairs that are linked, rounded half to even.
    """
    m = members.where("community_id >= 0")
    sizes = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    side = lambda c: m.select(F.col("path").alias(c), F.col("community_id").alias(f"c_{c}"))
    inner = edges.where("src <> dst").select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").where("c_src = c_dst")
    linked = inner.select(F.col("c_src").alias("community_id"), F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).distinct().groupBy("community_id").agg(F.count(F.lit(1)).alias("linked"))
    cats = m.groupBy("community_id", "category").agg(F.count(F.lit(1)).alias("n")).groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("s"), "category", "n"))), lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n"))).alias("categories"))
    order = Window.partitionBy("community_id").orderBy(F.desc("total_in"), "path")
    hubs = m.withColumn("r", F.row_number().over(order)).where("r <= 5").groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("hubs"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    cohesion = F.when(possible > 0, F.bround(F.coalesce("linked", F.lit(0)) / possible, 2)).otherwise(0.0)
    return sizes.join(linked, "community_id", "left").join(cats, "community_id").join(hubs, "community_id").select("community_id", "size", cohesion.alias("cohesion"), "categories", "hubs").orderBy(F.desc("size"), "community_id").limit(top)


def deviation_signals(stats: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Communities that mix categories (the second one 30 % or more), or journal ones that hold together (cohesion over 0.25)."""
    pct = lambda i: F.bround(F.col("categories")[i]["n"] / F.col("size") * 100).cast("int")
    rows = stats.where(F.size("categories") >= 2).select("community_id", "size", "cohesion", F.col("categories")[0]["category"].alias("top_cat"), pct(0).alias("top_pct"), F.col("categories")[1]["category"].alias("second_cat"), pct(1).alias("second_pct"))
    journal = F.lit(False)
    for m in config.journal_markers:
        journal = journal | F.lower("top_cat").contains(m.lower())
    kind = F.when(F.col("second_pct") >= 30, "cross-category").when(journal & (F.col("cohesion") > 0.25), "diary-theme")
    return rows.withColumn("type", kind).where("type is not null")
