"""Code graph: build, reach, rank, coupling, cycles, file selection.

Iterative jobs write the table of each round to the shared folder and read it back, so lineage stays one
round long and a lost executor costs a re-read. Rounds read a count or a sum from the table they wrote;
nothing else reaches the driver.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from glintmark.functions import constants as K
from glintmark.operators.matching import checks_of_path, files_by_words, sink_calls
from glintmark.session import Scratch, settle


def build_graph(symbols: DataFrame, edge_sets: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges: edges are one per (caller, callee, line), nodes are symbols and callers."""
    edges = reduce(DataFrame.unionByName, edge_sets).dropDuplicates(["caller", "callee", "line"])
    nodes = symbols.select(F.col("qname").alias("node")).union(edges.select("caller")).distinct()
    return nodes, edges


def _links(edges: DataFrame, direction: str, min_confidence: float | None) -> DataFrame:
    if min_confidence is not None:
        edges = edges.filter(F.col("confidence") >= min_confidence)
    ahead = edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    back = edges.select(F.col("callee").alias("src"), F.col("caller").alias("dst"))
    links = {"forward": ahead, "backward": back}.get(direction)
    return (ahead.unionAll(back) if links is None else links).distinct()


_BITS = 63  # bits of a long that may be set without touching its sign
_WORDS = 16  # longs of a node's mask; more tags than they hold are walked in several turns


def reach(
    seeds: DataFrame, edges: DataFrame, hops: int, direction: str = "backward",
    min_confidence: float | None = 0.3, tag: str = "tag", max_hops: Column | None = None,
) -> DataFrame:
    """(tag, node, depth) within ``hops`` of the seeds (tag, node), breadth first.

    All starts share one traversal: a tag is a bit, a node has one mask of the tags that reached it, and a hop is one join
    with the edges and one aggregation, however many tags there are. ``max_hops``, an expression of the tag, may limit each tag
    by itself. A round writes every node reached so far with its old and its new tags; rounds before the last are removed.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "reach")
    links = scratch.save(_links(edges, direction, min_confidence), "links")
    seeds = scratch.save(seeds.select(tag, "node"), "seeds")
    limit = F.lit(hops) if max_hops is None else F.least(F.lit(hops), max_hops)
    tags = [(r[0], r[1]) for r in seeds.select(tag, limit.alias("limit")).distinct().orderBy(tag).collect()]  # one row per check
    width = _BITS * _WORDS
    parts = [_walk(spark, scratch, seeds, links, tags[at:at + width], tag, f"part{at}") for at in range(0, max(len(tags), 1), width)]
    return reduce(DataFrame.unionAll, parts)


def _walk(spark: SparkSession, scratch: Scratch, seeds: DataFrame, links: DataFrame, tags: list[tuple], tag: str, name: str) -> DataFrame:
    """The traversal of at most as many tags as a mask holds."""
    kind = seeds.schema[tag].dataType.simpleString()
    numbered = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(tags)], f"bit int, {tag} {kind}")
    masks = [f"m{k}" for k in range(max(1, -(-len(tags) // _BITS)))]

    def allowed(hop: int) -> list[int]:
        """Per long, the bits of the tags that may take this hop."""
        out = [0] * len(masks)
        for i, (_, most) in enumerate(tags):
            out[i // _BITS] |= (most is not None and most >= hop) << (i % _BITS)
        return out

    def gathered(rows: DataFrame) -> DataFrame:
        """One row per node: what it had, and what is new to it."""
        both = rows.groupBy("node").agg(*[F.bit_or(f"old_{m}").alias(f"old_{m}") for m in masks], *[F.bit_or(m).alias(m) for m in masks])
        return both.select("node", *[F.col(f"old_{m}") for m in masks], *[F.col(m).bitwiseAND(F.bitwise_not(f"old_{m}")).alias(m) for m in masks])

    place = seeds.join(F.broadcast(numbered), seeds[tag].eqNullSafe(numbered[tag])).select("node", "bit")
    none = [F.lit(0).cast("bigint").alias(f"old_{m}") for m in masks]
    now = scratch.save(gathered(place.select("node", *none, *[
        F.when(F.floor(F.col("bit") / _BITS) == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % _BITS)).otherwise(F.lit(0).cast("bigint")).alias(m)
        for k, m in enumerate(masks)])), f"{name}_hop0")
    fresh = reduce(lambda a, b: a | b, [F.col(m) != 0 for m in masks])
    rounds = [scratch.save(now.filter(fresh).select("node", *masks, F.lit(0).alias("depth")), f"{name}_new0")]
    hop = 0
    while any(allowed(hop + 1)) and not rounds[-1].isEmpty():
        hop += 1
        front = now.select("node", *[F.col(m).bitwiseAND(F.lit(bits)).alias(m) for m, bits in zip(masks, allowed(hop), strict=True)]).filter(fresh)
        step = front.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node"), *none, *masks)
        had = now.select("node", *[F.col(f"old_{m}").bitwiseOR(F.col(m)).alias(f"old_{m}") for m in masks], *[F.lit(0).cast("bigint").alias(m) for m in masks])
        now = scratch.save(gathered(had.unionByName(step)), f"{name}_hop{hop}")
        scratch.drop(f"{name}_hop{hop - 1}")
        rounds.append(scratch.save(now.filter(fresh).select("node", *masks, F.lit(hop).alias("depth")), f"{name}_new{hop}"))
    found = reduce(DataFrame.unionAll, rounds)
    each = F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(tags) - 1)), lambda i: reduce(
        lambda a, b: a | b, [(F.floor(i / _BITS) == k) & (F.call_function("shiftright", F.col(m), (i % _BITS).cast("int")).bitwiseAND(F.lit(1)) == 1) for k, m in enumerate(masks)])))
    if not tags:
        return found.limit(0).select(F.lit(None).cast(kind).alias(tag), "node", "depth")
    return found.select("node", "depth", each.alias("bit")).join(F.broadcast(numbered), "bit").select(tag, "node", "depth")


def sink_seeds(edges: DataFrame, tagged: DataFrame | None = None) -> DataFrame:
    """(tag, node): callers of sinks and local sink symbols, per CWE; both sides use bare numbers.

    ``tagged`` has (qname, cwe_id). Seeds do not depend on the confidence of their edge.
    """
    seeds = sink_calls(edges).select(F.col("cwe_id").alias("tag"), F.col("caller").alias("node"))
    if tagged is not None:
        seeds = seeds.unionAll(tagged.select(F.regexp_replace("cwe_id", "^CWE-", ""), "qname"))
    return seeds.distinct()


def reached_files(reached: DataFrame, symbol_files: DataFrame, tag: str = "tag") -> DataFrame:
    return (
        reached.join(symbol_files.select(F.col("qname").alias("node"), "file"), "node")
        .select(tag, "file").distinct()
    )


def both_ways(backward: DataFrame, forward: DataFrame, tags: list[str], tag: str = "tag", item: str = "file") -> DataFrame:
    """Items reached both ways per tag; if there are none, those of the side that has any, backward first.

    ``forward`` has no tag: it is the same for all of them. ``tags`` are the (few) tags asked for.
    """
    ahead = forward.select(item).distinct()
    back = (
        backward.filter(F.col(tag).isin(tags)).select(tag, item).distinct()
        .join(ahead.withColumn("_f", F.lit(True)), item, "left").withColumn("_f", F.coalesce("_f", F.lit(False)))
    )
    met = back.groupBy(tag).agg(F.max("_f").alias("_any")).withColumnRenamed(tag, "_t")
    kept = back.join(met, F.col(tag) == F.col("_t")).filter(F.col("_f") | ~F.col("_any"))
    reached = back.agg(F.collect_set(tag)).scalar()
    alone = ahead.select(F.explode(F.array_except(F.array(*[F.lit(t) for t in tags]), reached)).alias(tag), item)
    return kept.select(tag, item, F.when(F.col("_f"), F.lit("both")).otherwise(F.lit("backward")).alias("via")).unionByName(
        alone.withColumn("via", F.lit("forward")))


def blast_radius(edges: DataFrame, symbol_files: DataFrame, changed: DataFrame, hops: int = 2) -> DataFrame:
    """Changed files and the files of symbols within ``hops`` calls of theirs, in either direction."""
    seeds = symbol_files.join(changed.select("file"), "file", "left_semi").select(
        F.lit("change").alias("tag"), F.col("qname").alias("node")
    )
    hit = reach(seeds, edges, hops, "either", None)
    return reached_files(hit, symbol_files).select("file").union(changed.select("file")).distinct()


def affected_checks(
    checks: DataFrame, blast: DataFrame, edges: DataFrame, symbol_files: DataFrame, entry_points: DataFrame,
) -> DataFrame:
    """Checks a change may affect; all of them when there is nothing to narrow by.

    ``checks`` has (cwe_id, direction, sinks), ``edges`` the file of the call, ``entry_points`` qname.
    """
    blast = settle(blast.select("file"), "blast")  # four steps read it
    entry = symbol_files.join(entry_points.select("qname"), "qname", "left_semi").join(blast, "file", "left_semi")
    any_entry = entry.agg(F.count(F.lit(1)) > 0).scalar()
    sinks = sink_calls(edges.join(blast, "file", "left_semi")).agg(F.collect_set("cwe_id")).scalar()
    words = blast.select(F.explode(checks_of_path(F.col("file"))).alias("c")).agg(F.collect_set("c")).scalar()
    any_blast = blast.agg(F.count(F.lit(1)) > 0).scalar()
    any_edge = edges.agg(F.count(F.lit(1)) > 0).scalar()
    hit = (
        F.when(F.col("direction") == "forward", any_entry)
        .when(F.col("direction").isin("backward", "both"), F.array_contains(sinks, F.col("sinks")))
        .otherwise(F.array_contains(words, F.col("cwe_id")))
    )
    rows = checks.withColumn("_hit", F.coalesce(hit, F.lit(False)) & any_blast & any_edge)
    some = rows.agg(F.max("_hit")).scalar()
    return rows.filter(F.col("_hit") | ~some).select("cwe_id", F.col("_hit").alias("narrowed"))


def pagerank(
    nodes: DataFrame, edges: DataFrame, damping: float = 0.85, max_rounds: int = 100, tolerance: float = 1e-6,
) -> DataFrame:
    """(node, rank) with the highest rank 1. ``edges`` has (src, dst).

    Self-loops and edges with an unknown end are dropped; parallel edges count. Rank without an outgoing
    edge is spread over all nodes. Stops when the ranks change by less than ``tolerance`` in total, and fails
    if ``max_rounds`` do not get there. Nodes get numbers, by which the rounds join and add up. The edges keep the
    share 1/outdegree and never change: they lie in a table bucketed by source, which a round joins with the ranks where
    the edges are, so only ranks and contributions summed per target are shuffled. Change and lost rank are observed
    while a round is written.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "pagerank")
    known = scratch.save(nodes.select("node").distinct().withColumn("id", F.monotonically_increasing_id()), "known")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"pagerank_{uuid.uuid4().hex}"
    (
        edges.filter(F.col("src") != F.col("dst")).select("src", "dst")
        .join(known.select(F.col("node").alias("src"), F.col("id").alias("_from")), "src")
        .join(known.select(F.col("node").alias("dst"), F.col("id").alias("_to")), "dst")
        .select(F.col("_from").alias("src"), F.col("_to").alias("dst")).repartition(buckets, "src")
        .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
        .select("src", "dst", (F.col("m") / F.sum("m").over(Window.partitionBy("src"))).alias("share"))
        .write.option("path", scratch.path("shares")).bucketBy(buckets, "src").sortBy("src").saveAsTable(table)
    )
    try:
        shares = spark.table(table)
        out = shares.select(F.col("src").alias("id"), F.lit(True).alias("out")).distinct()
        ranks = _ranked(spark, scratch, shares, known.select("id").join(out, "id", "left")
                        .select(F.col("id").alias("node"), F.col("out").isNull().alias("dangling")), damping, max_rounds, tolerance)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        for name in ("nodes", "shares"):
            scratch.drop(name)
    top = ranks.agg(F.max("rank")).scalar()
    named = ranks.select(F.col("node").alias("id"), "rank").join(known, "id")
    return named.select("node", F.when(top > 0, F.col("rank") / top).otherwise(F.col("rank")).alias("rank"))


def _ranked(spark: SparkSession, scratch: Scratch, shares: DataFrame, nodes: DataFrame, damping: float, max_rounds: int,
            tolerance: float) -> DataFrame:
    base = scratch.save(nodes, "nodes")
    n, dangling = base.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    if n == 0:
        return spark.createDataFrame([], f"node {base.schema['node'].dataType.simpleString()}, rank double")
    ranks = scratch.save(base.select("node", "dangling", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("change")), "round=0")
    lost = dangling / n
    for k in range(1, max_rounds + 1):
        given = shares.join(ranks.select(F.col("node").alias("src"), "rank"), "src").select(
            F.col("dst").alias("node"), (F.col("rank") * F.col("share")).alias("gain"))
        # Old ranks and contributions meet in one aggregation per node, summed before the shuffle.
        new = F.lit((1.0 - damping) / n + damping * lost / n) + F.lit(damping) * F.coalesce("gain", F.lit(0.0))
        step = (
            ranks.select("node", "dangling", F.col("rank").alias("old")).unionByName(given, allowMissingColumns=True)
            .groupBy("node").agg(F.max("dangling").alias("dangling"), F.max("old").alias("old"), F.sum("gain").alias("gain"))
            .select("node", "dangling", new.alias("rank"), F.abs(new - F.col("old")).alias("change"))
        )
        seen = Observation()
        ranks = scratch.save(step.observe(
            seen, F.sum("change").alias("change"), F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("lost")), f"round={k}")
        scratch.drop(f"round={k - 1}")
        lost = seen.get["lost"] or 0.0
        if seen.get["change"] < tolerance:
            return ranks
    raise RuntimeError(f"ranks still change by {seen.get['change']} after {max_rounds} rounds")


def call_graph_rank(nodes: DataFrame, call_edges: DataFrame, ref_edges: DataFrame | None = None, **options) -> DataFrame:
    """Rank over the distinct call and reference edges."""
    pairs = call_edges.select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    if ref_edges is not None:
        pairs = pairs.unionAll(ref_edges.select("source", "target"))
    return pagerank(nodes, pairs.distinct(), **options)


def coupling(edges: DataFrame, by: list[str] | None = None, src: str = "source", dst: str = "target") -> DataFrame:
    """(by, node, ce, ca): outgoing and incoming edges of every node that has any."""
    by = by or []
    ends = edges.select(*by, F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(
        edges.select(*by, F.col(dst), F.lit(0), F.lit(1))
    )
    return ends.groupBy(*by, "node").agg(F.sum("o").alias("ce"), F.sum("i").alias("ca"))


def _rake(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges in and out: no other lies on a cycle."""
    ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
    return edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst")


def _compress(edges: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contract chains of nodes with one edge in and one out: (edges left, chain members, closed loops).

    A chain is found by pointer jumping, so its length costs its logarithm in rounds. ``members`` has (v, head, tail): the node
    lies on a cycle just when the two ends of its chain lie on one together. A ring of such nodes has no end; after enough
    jumps to go round it, the largest node met names it (``loops``: node, component).
    """
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select("dst", F.lit(0), F.lit(1)))
    single = ends.groupBy("v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).filter("o = 1 AND i = 1").select("v")
    single = scratch.save(single, f"{name}_single")
    n = single.count()
    if not n:
        empty = edges.limit(0)
        return edges, empty.select(F.col("src").alias("v"), F.col("src").alias("head"), F.col("dst").alias("tail")), empty.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    inner = single.select(F.col("v").alias("dst"), F.lit(True).alias("in_chain"))
    onward = edges.join(single.withColumnRenamed("v", "src"), "src", "left_semi").join(inner, "dst", "left")
    last = onward.filter("in_chain IS NULL").select(F.col("src").alias("to"))
    jump = scratch.save(onward.select(F.col("src").alias("v"), F.when(F.col("in_chain"), F.col("dst")).otherwise(F.col("src")).alias("to"), F.col("src").alias("most")), f"{name}_jump0")
    k, span = 0, 1
    while span < n:
        ahead = jump.select(F.col("v").alias("to"), F.col("to").alias("next"), F.col("most").alias("more"))
        moved = Observation()
        step = jump.join(ahead, "to").select("v", F.col("next").alias("to"), F.greatest("most", "more").alias("most"), (F.col("next") != F.col("to")).alias("moved"))
        k, span = k + 1, span * 2
        jump = scratch.save(step.observe(moved, F.max("moved").alias("any")), f"{name}_jump{k}").drop("moved")
        scratch.drop(f"{name}_jump{k - 1}")
        if not moved.get["any"]:
            break
    chains = scratch.save(
        jump.join(last, "to", "left_semi").select("v", "to").join(edges.select(F.col("src").alias("to"), F.col("dst").alias("tail")), "to"), f"{name}_chains")
    loops = jump.join(last, "to", "left_anti").select(F.col("v").alias("node"), F.col("most").alias("component"))
    heads = edges.join(single.withColumnRenamed("v", "src"), "src", "left_anti").join(chains.select(F.col("v").alias("dst"), "to", "tail"), "dst").select("to", F.col("src").alias("head"), "tail")
    heads = scratch.save(heads, f"{name}_heads")
    free = edges.join(single.withColumnRenamed("v", "src"), "src", "left_anti").join(single.withColumnRenamed("v", "dst"), "dst", "left_anti").select("src", "dst")
    left = scratch.save(free.unionAll(heads.select("head", "tail")).distinct(), f"{name}_left")
    return left, chains.select("v", "to").join(heads, "to").select("v", "head", "tail"), loops


def _colour(edges: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, colour): the largest node from which each can be reached along ``edges``.

    What reaches the colour of a node reaches the node, so a round takes the best colour of the neighbours and then the
    colour of that colour: with node numbers in no order, colours travel in strides that double.
    """
    now = scratch.save(nodes.select("node", F.col("node").alias("colour")), f"{name}0")
    k = 0
    while True:
        passed = edges.join(now.select(F.col("node").alias("src"), "colour"), "src").select(F.col("dst").alias("node"), "colour")
        own = now.select("node", "colour", F.col("colour").alias("had"))
        best = own.unionByName(passed, allowMissingColumns=True).groupBy("node").agg(F.max("colour").alias("colour"), F.max("had").alias("had"))
        k += 1
        best = scratch.save(best, f"{name}_best{k}")
        further = best.select(F.col("node").alias("colour"), F.col("colour").alias("next"))
        moved = Observation()
        step = best.join(further, "colour").select("node", F.greatest("colour", "next").alias("colour"), (F.greatest("colour", "next") > F.col("had")).alias("moved"))
        now = scratch.save(step.observe(moved, F.max("moved").alias("any")), f"{name}{k}").drop("moved")
        scratch.drop(f"{name}_best{k}")
        scratch.drop(f"{name}{k - 1}")
        if not moved.get["any"]:
            return now


def cyclic_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node on a cycle; a component is named by its largest node.

    Does not depend on a visiting order. Nodes get numbers in no order. A turn rakes nodes without edges in or out,
    contracts chains by pointer jumping, then colours every node with the largest node that reaches it: inside a colour, what
    reaches the colour's own node is one strongly connected component. Components leave, edges between colours go, and
    the rest takes another turn. Long paths cost the logarithm of their length, and work grows with edges, never with pairs
    of nodes. Tables of rounds that are over are removed.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "cycles")
    raw = scratch.save(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).distinct(), "raw")
    # An odd factor below 2^50 permutes the numbers below 2^63.
    number = F.expr("cast(pmod(cast(monotonically_increasing_id() as decimal(20,0)) * 1111111111111111, 9223372036854775808) as bigint)")
    names = scratch.save(raw.select(F.col("a").alias("name")).union(raw.select("b")).distinct().withColumn("node", number), "names")
    coded = raw.join(names.select(F.col("name").alias("a"), F.col("node").alias("src")), "a").join(names.select(F.col("name").alias("b"), F.col("node").alias("dst")), "b").select("src", "dst")
    coded = scratch.save(coded, "coded")
    alone = [coded.filter("src = dst").select(F.col("src").alias("node"))]  # nodes on a cycle of their own, if on no larger one
    left, k = coded.filter("src <> dst"), 0
    found, chains = [], []
    while True:
        left = scratch.save(_rake(scratch.save(_rake(left), f"t{k}_rake")), f"t{k}_raked")
        if left.isEmpty():
            break
        left, members, loops = _compress(left, scratch, f"t{k}")
        found.append(loops)
        chains.append(members)
        alone.append(left.filter("src = dst").select(F.col("src").alias("node")))
        left = left.filter("src <> dst")
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colours = _colour(left, nodes, scratch, f"t{k}_to")
        inside = scratch.save(
            left.join(colours.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colours.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst")
            .filter("cs = cd").select("src", "dst"), f"t{k}_inside")
        back = _colour(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colours, scratch, f"t{k}_from")
        whole = scratch.save(colours.join(back.withColumnRenamed("colour", "reaches"), "node").select("node", "colour", "reaches"), f"t{k}_colours")
        done = whole.filter("colour = reaches").select("node", F.col("colour").alias("component"))
        found.append(done)
        rest = whole.filter("colour <> reaches").select("node", "colour", "reaches")
        kept = inside.join(rest.select(F.col("node").alias("src"), F.col("reaches").alias("rs")), "src").join(rest.select(F.col("node").alias("dst"), F.col("reaches").alias("rd")), "dst").filter("rs = rd")
        left = kept.select("src", "dst")
        k += 1
    # A component of one node is a cycle only if the node leads to itself, in the graph or through a chain.
    empty = coded.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    members = scratch.save(reduce(DataFrame.unionAll, found, empty), "members")
    big = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    rings = reduce(DataFrame.unionAll, found[0::2], empty).select("component").distinct()
    known = scratch.save(members.join(big.union(rings).distinct(), "component", "left_semi").select("node", "component"), "known")

    def with_singles(known: DataFrame, nodes: DataFrame) -> DataFrame:
        return known.unionByName(nodes.distinct().join(known.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))

    for i, chain in reversed(list(enumerate(chains))):
        known = scratch.save(with_singles(known, alone[i + 1]), f"singles{i}")
        at = known.select(F.col("node").alias("head"), F.col("component").alias("ch")), known.select(F.col("node").alias("tail"), F.col("component").alias("ct"))
        closed = chain.join(at[0], "head").join(at[1], "tail").filter("ch = ct").select(F.col("v").alias("node"), F.col("ch").alias("component"))
        known = scratch.save(known.unionByName(closed), f"known{i}")
    named = with_singles(known, alone[0]).join(names, "node").select("component", "name")
    return named.join(named.groupBy("component").agg(F.max("name").alias("largest")), "component").select(F.col("name").alias("node"), F.col("largest").alias("component"))


def two_cycles(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Pairs of nodes that point at each other, smaller name first."""
    a, b = F.col(src), F.col(dst)
    pairs = edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), (a < b).alias("up"))
    return pairs.groupBy("a", "b").agg(F.max("up").alias("u"), F.min("up").alias("d")).filter("u AND NOT d").select("a", "b")


def files_by_rank(selected: DataFrame, symbol_files: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """Selected files with the summed rank of their symbols."""
    sums = (
        symbol_files.join(ranks.select(F.col("node").alias("qname"), "rank"), "qname", "left")
        .groupBy("file").agg(F.sum(F.coalesce("rank", F.lit(0.0))).alias("file_rank"))
    )
    return selected.join(sums, "file", "left").select(*by, "file", F.coalesce("file_rank", F.lit(0.0)).alias("file_rank"))


def select_files(manifest: DataFrame, graph_files: DataFrame) -> DataFrame:
    """(cwe_id, file, by_graph, by_words): union of graph reach and path words, source languages only."""
    source = manifest.filter(F.col("language").isin(K.SOURCE_LANGUAGES)).select("file")
    sides = graph_files.join(source, "file", "left_semi").select(
        "cwe_id", "file", F.lit(True).alias("g"), F.lit(False).alias("w")
    ).unionAll(files_by_words(manifest).select("cwe_id", "file", F.lit(False), F.lit(True)))
    return sides.groupBy("cwe_id", "file").agg(F.max("g").alias("by_graph"), F.max("w").alias("by_words"))


def selection_counts(selected: DataFrame, graph_files: DataFrame) -> DataFrame:
    """Files per check by graph, by words and in all, and the method that applied."""
    reached = graph_files.groupBy("cwe_id").agg(F.count_distinct("file").alias("graph_files"))
    sums = selected.groupBy("cwe_id").agg(
        F.count_if("by_words").alias("word_files"), F.count(F.lit(1)).alias("selected"))
    n = F.coalesce("graph_files", F.lit(0).cast("bigint"))
    return sums.join(reached, "cwe_id", "left").select(
        "cwe_id", F.when(n > 0, F.lit("graph")).otherwise(F.lit("keyword")).alias("method"),
        n.alias("graph_files"), "word_files", "selected")


def code_map_totals(modules: DataFrame, symbols: DataFrame, by: list[str]) -> DataFrame:
    """Files, lines, classes and functions per project."""
    files = modules.groupBy(*by).agg(F.count(F.lit(1)).alias("n_files"), F.sum("lines").alias("n_lines"))
    kinds = symbols.groupBy(*by).agg(
        F.count_if(F.col("kind") == "class").alias("n_classes"),
        F.count_if(F.col("kind") == "function").alias("n_functions"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return files.join(kinds, by, "left").select(*by, "n_files", "n_lines", zero("n_classes"), zero("n_functions"))


def layer_ranks(modules: DataFrame, ranks: DataFrame) -> DataFrame:
    """Summed rank and files per layer of the tree."""
    from glintmark.functions.paths import layer, module_name

    ranked = modules.withColumn("node", module_name(F.col("file"))).join(ranks, "node", "left")
    return ranked.groupBy(layer(F.col("file")).alias("layer")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(F.coalesce("rank", F.lit(0.0))).alias("layer_rank"))


def top_modules(modules: DataFrame, ranks: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` modules (file, lines, classes, functions) of highest rank; a module without a rank has 0."""
    from glintmark.functions.paths import module_name

    ranked = modules.withColumn("node", module_name(F.col("file"))).join(ranks, "node", "left")
    return ranked.select("file", "lines", "classes", "functions", F.coalesce("rank", F.lit(0.0)).alias("rank")).orderBy(F.desc("rank"), "file").limit(k)


def import_pairs(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(module, imported) inside the project: the import or its parent is a module of it."""
    prefixes = F.array_distinct(F.array("imported", F.regexp_replace("imported", r"\.[^.]*$", "")))
    return (
        imports.select("module", "imported", F.explode(prefixes).alias("_p"))
        .join(modules.select(F.col("module").alias("_p")).distinct(), "_p", "left_semi")
        .select("module", "imported").distinct()
    )
