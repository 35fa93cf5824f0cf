"""Trail expansion and shortest paths over stored edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.schema import MAX_PATH_HOPS, KnowledgeGraph
from graphweft.session import SEEK_KEYS, Scratch, rows_within, seek_edges

DIRECTIONS = ("in", "out", "both")


def incidences(relationships: DataFrame, direction: str) -> DataFrame:
    """Edges seen from one end: (near_kind, near_qn, far_kind, far_qn, rel_type,
    eid). ``both`` reads the edges once and shows a self-loop once."""
    eid = F.xxhash64("from_kind", "from_qn", "to_kind", "to_qn", "rel_type")
    forward = F.struct(
        F.col("from_kind").alias("near_kind"),
        F.col("from_qn").alias("near_qn"),
        F.col("to_kind").alias("far_kind"),
        F.col("to_qn").alias("far_qn"),
    )
    backward = F.struct(
        F.col("to_kind").alias("near_kind"),
        F.col("to_qn").alias("near_qn"),
        F.col("from_kind").alias("far_kind"),
        F.col("from_qn").alias("far_qn"),
    )
    if direction == "out":
        return relationships.select("rel_type", eid.alias("eid"), forward.alias("s")).select("s.*", "rel_type", "eid")
    if direction == "in":
        return relationships.select("rel_type", eid.alias("eid"), backward.alias("s")).select("s.*", "rel_type", "eid")
    loop = (F.col("from_kind") == F.col("to_kind")) & (F.col("from_qn") == F.col("to_qn"))
    sides = F.when(loop, F.array(forward)).otherwise(F.array(forward, backward))
    return relationships.select(F.inline(sides), "rel_type", eid.alias("eid"))


def neighbors(graph: KnowledgeGraph, targets: DataFrame, depth: int = 1, direction: str = "both") -> DataFrame:
    """Entities reachable over 1..``depth`` edges from every target.

    One row per edge of each trail: the trail's far end with that edge's type,
    so the row count is the sum of trail lengths. An edge is used once per trail
    while nodes may repeat. ``targets`` holds ``qualified_name``; any direction
    other than ``in`` and ``out`` means both.
    """
    direction = direction if direction in DIRECTIONS else "both"
    wanted = targets.select(F.col("qualified_name").alias("near_qn"))
    ends = {"in": ["to_qn"], "out": ["from_qn"], "both": ["from_qn", "to_qn"]}[direction]
    scratch, relationships = Scratch(graph.entities.sparkSession), graph.relationships
    many = depth > 1 and rows_within(wanted, SEEK_KEYS) is None
    if depth > 1 and not many and graph.incoming is None:  # still to be computed, read several times
        relationships = scratch.write(relationships.select("from_kind", "from_qn", "to_kind", "to_qn", "rel_type"), "edges")
    names = graph.entities.select(F.col("kind").alias("far_kind"), F.col("qualified_name").alias("far_qn"), "name", F.lit(True).alias("known"))
    steps = incidences(relationships, direction)
    if many:
        # From many targets an edge ends many trails: it is named once, not once per trail.
        asked = wanted.distinct().withColumn("asked", F.lit(True))
        steps = scratch.write(steps.join(names, ["far_kind", "far_qn"], "left").join(asked, "near_qn", "left"), "steps")
        first = steps.where("asked")
    else:
        first = incidences(seek_edges(relationships, graph.incoming, ends, wanted), direction).join(wanted, "near_qn", "left_semi")
    far = ["name", "known"] if many else []
    trails = first.select(
        F.col("near_qn").alias("target"),
        F.col("far_kind").alias("kind"),
        F.col("far_qn").alias("qualified_name"),
        F.array("eid").alias("eids"),
        F.array("rel_type").alias("types"),
        *far,
    )
    levels, arriving = [trails], first
    for _ in range(depth - 1):
        middles, coming_rows, onward_rows = _middles(arriving, steps, direction, scratch)
        if not coming_rows:
            break
        near = ["near_kind", "near_qn"]
        onward = steps.join(middles.select(*near), near, "left_semi")
        # The fewer rows are written, so that the optimizer sees that they are few.
        coming = trails.drop(*far).join(middles.select(*near).toDF("kind", "qualified_name"), ["kind", "qualified_name"], "left_semi")
        if onward_rows < coming_rows:
            onward = met = scratch.write(onward, "onward")
        else:
            coming, met = scratch.write(coming, "coming"), steps
        step = met.select("near_kind", "near_qn", F.col("far_kind").alias("_kind"), F.col("far_qn").alias("_qn"), "rel_type", "eid", *far)
        trails = (
            coming.join(step, (F.col("kind") == F.col("near_kind")) & (F.col("qualified_name") == F.col("near_qn")))
            .where(~F.array_contains("eids", F.col("eid")))
            .select(
                "target",
                F.col("_kind").alias("kind"),
                F.col("_qn").alias("qualified_name"),
                F.array_append("eids", F.col("eid")).alias("eids"),
                F.array_append("types", F.col("rel_type")).alias("types"),
                *far,
            )
        )
        levels.append(trails)
        arriving = onward
    reached = reduce(DataFrame.unionByName, levels).drop("eids")
    # The name is there before the edge lists are unrolled: one probe per
    # trail at most, not one per row.
    if not far:
        reached = reached.join(names.withColumnsRenamed({"far_kind": "kind", "far_qn": "qualified_name"}), ["kind", "qualified_name"])
    return reached.where("known").select(
        "target", "name", "qualified_name", "kind", F.explode("types").alias("rel_type"), F.lit(direction).alias("direction")
    )


def _middles(arriving: DataFrame, steps: DataFrame, direction: str, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """(near_kind, near_qn) of the nodes where edges arrive and a further step
    begins, and how many edges arrive there and how many steps begin. Where an
    edge shows from both ends, the one that arrives is itself such a step and
    cannot be used again, so a second is asked for. Nodes of kinds that stand on
    one side only are left out before anything is counted."""
    kinds = [rows_within(df.select(kind).distinct(), SEEK_KEYS) for df, kind in ((arriving, "far_kind"), (steps, "near_kind"))]
    if None not in kinds:
        both = sorted({r[0] for r in kinds[0]} & {r[0] for r in kinds[1]} - {None})
        arriving, steps = arriving.where(F.col("far_kind").isin(*both)), steps.where(F.col("near_kind").isin(*both))
    came = arriving.groupBy(F.col("far_kind").alias("near_kind"), F.col("far_qn").alias("near_qn")).agg(F.count(F.lit(1)).alias("came"))
    goes = steps.groupBy("near_kind", "near_qn").agg(F.count(F.lit(1)).alias("goes")).where(F.col("goes") > (1 if direction == "both" else 0))
    middles = scratch.write(came.join(goes, ["near_kind", "near_qn"]), "middles")
    rows = middles.agg(F.sum("came"), F.sum("goes")).first()
    return middles, rows[0] or 0, rows[1] or 0


def _node(qn: str, kind: str, seed: int) -> Column:
    """A node as a number; null where a part of its key is."""
    return F.when(F.col(qn).isNotNull() & F.col(kind).isNotNull(), F.xxhash64(F.lit(seed), F.col(qn), F.col(kind)))


def _numbered(graph: KnowledgeGraph, scratch: Scratch) -> tuple[DataFrame, int]:
    """(qualified_name, kind, node) of all entities, and the seed under which no two have one number."""
    for seed in range(8):
        nodes = graph.entities.select("qualified_name", "kind", _node("qualified_name", "kind", seed).alias("node"))
        if graph.incoming is None:  # still to be computed, read many times
            nodes = scratch.write(nodes, "nodes")
        check = F.xxhash64("kind", "qualified_name")
        twins = nodes.where("node IS NOT NULL").groupBy("node").agg(F.min(check).alias("least"), F.max(check).alias("most")).where("least <> most")
        if twins.isEmpty():
            return nodes, seed
    raise RuntimeError("nodes share a number under every seed")


def _adjacency(graph: KnowledgeGraph, scratch: Scratch, seed: int) -> DataFrame:
    """(near, far) of every edge both ways. A stored graph is read where it lies;
    edges that are still to be computed are written, since every hop reads them."""
    ends = incidences(graph.relationships, "both").select(_node("near_qn", "near_kind", seed).alias("near"), _node("far_qn", "far_kind", seed).alias("far"))
    ends = ends.where("near IS NOT NULL AND far IS NOT NULL")
    return ends if graph.incoming is not None else scratch.write(ends, "adjacency")


#: The bit of a numbered pair.
_BIT = "shiftleft(1L, CAST(number & 63 AS INT))"
#: From so many pairs on the distances to hubs pay, which cost as much as one block of pairs.
HUB_PAIRS = 65


class _Search:
    """A search for many pairs at once, from both ends.

    Pairs are numbered; 64 of them are a block, and each is a bit of it. What one
    side has reached after some hops is a table (block, node, bits): the pairs
    for which the node is that far away. A hop joins it with the edges and ors
    the bits that arrive at a node, so its rows are bounded by the nodes times
    the blocks, not the pairs. ``levels`` keeps these tables by side. Every level
    is written: a lost executor repeats at most one hop, and the optimizer sees
    the size of the frontier.
    """

    def __init__(self, graph: KnowledgeGraph, pairs: DataFrame):
        self.scratch = Scratch(graph.entities.sparkSession)
        self.nodes, seed = _numbered(graph, self.scratch)
        self.adjacency = _adjacency(graph, self.scratch, seed)
        numbered = pairs.select(F.monotonically_increasing_id().alias("number"), "pair_id", "from_qn", "to_qn")
        self.pairs, self.wanted, _ = self.scratch.write_counted(numbered, "pairs")
        nodes = self.nodes.where("node IS NOT NULL").select("qualified_name", "node")
        block, bit = F.shiftright("number", 6).alias("block"), F.expr(_BIT)
        self.levels: dict[str, list[DataFrame]] = {}
        self.sizes: dict[str, int] = {}
        for end in ("from_qn", "to_qn"):
            start = self.pairs.select(block, bit.alias("bit"), F.col(end).alias("qualified_name")).join(nodes, "qualified_name")
            level, size, _ = self.scratch.write_counted(start.groupBy("block", "node").agg(F.bit_or("bit").alias("bits")), end)
            self.levels[end], self.sizes[end] = [level], size
        self.hubs: dict[int, int] = {}

    def cost(self, level: DataFrame, rows: int) -> int:
        """What extending a level takes: its rows, and the edges of the hubs in it, where these are known."""
        if not self.hubs or not rows:
            return rows
        edges = F.element_at(F.create_map(*[F.lit(v).cast("long") for pair in self.hubs.items() for v in pair]), F.col("node"))
        return rows + (level.where(F.col("node").isin(*self.hubs)).agg(F.sum(edges)).first()[0] or 0)

    def step(self, level: DataFrame) -> DataFrame:
        """The nodes next to those of a level, with the bits that arrive there."""
        arrived = level.join(self.adjacency, F.col("node") == F.col("near")).select("block", F.col("far").alias("node"), "bits")
        return arrived.groupBy("block", "node").agg(F.bit_or("bits").alias("bits"))

    def extend(self, levels: list[DataFrame]) -> DataFrame:
        """The level after some levels."""
        step = self.step(levels[-1])
        # Undirected levels only touch the two before them.
        for seen in levels[-2:]:
            step = step.join(seen.withColumnRenamed("bits", "_seen"), ["block", "node"], "left").select(
                "block", "node", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long")))).alias("bits")
            )
        return step.where("bits <> 0")

    def meetings(self, max_hops: int, settled: DataFrame | None = None):
        """(hops, levels of the one side, of the other, table of the bits that met)
        for each number of hops at which pairs meet, always extending the side
        that costs less, until all have met or a side is exhausted.
        ``settled`` (number, at) are pairs that need no search beyond ``at`` hops."""
        level, end, hops, closed = self.levels["from_qn"].pop(), "from_qn", 0, []
        while True:
            other = "to_qn" if end == "from_qn" else "from_qn"
            opposite = self.levels[other][-1].withColumnRenamed("bits", "_other")
            both = level.join(opposite, ["block", "node"], "left").withColumn("met", F.col("bits").bitwiseAND(F.col("_other")))
            made, size, here = self.scratch.write_counted(both.select("block", "node", "bits", F.expr("nullif(met, 0L)").alias("met")), f"level{hops}", "met")
            self.levels[end].append(made.drop("met"))
            self.sizes[end] = self.cost(made, size)
            done = []
            if here:
                met = made.where("met IS NOT NULL").select("block", "node", F.col("met").alias("bits"))
                yield hops, list(self.levels["from_qn"]), list(self.levels["to_qn"]), met
                done.append(met.select("block", "bits"))
            if settled is not None:
                done.append(settled.where(F.col("at") == hops).select(F.shiftright("number", 6).alias("block"), F.expr(_BIT).alias("bits")))
            if done:
                done = reduce(DataFrame.unionByName, done).groupBy("block").agg(F.bit_or("bits").alias("_done"))
                done, blocks, _ = self.scratch.write_counted(done, "done")
                closed += [done] if blocks else []
            if closed:
                every = reduce(DataFrame.unionByName, closed).groupBy("block").agg(F.bit_or("_done").alias("_done"))
                if every.agg(F.sum(F.bit_count("_done"))).first()[0] == self.wanted:
                    return
            if self.wanted == 0 or hops == max_hops or not all(self.sizes.values()):
                return
            if closed and closed[-1] is done:
                for side in self.levels:
                    left = self.levels[side][-1].join(done, "block", "left")
                    left = left.withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_done", F.lit(0).cast("long")))))
                    self.levels[side][-1], size, _ = self.scratch.write_counted(left.where("bits <> 0").drop("_done"), "open")
                    self.sizes[side] = self.cost(self.levels[side][-1], size)
                if not all(self.sizes.values()):
                    return
            hops += 1
            end = "from_qn" if self.sizes["from_qn"] <= self.sizes["to_qn"] else "to_qn"
            level = self.extend(self.levels[end])

    def numbers(self, level: DataFrame) -> DataFrame:
        """(number, node): a row for each pair of each node."""
        held = F.expr("explode(filter(sequence(0, 63), b -> (shiftright(bits, b) & 1L) = 1L))")
        return level.select("block", "node", held.alias("_bit")).select((F.col("block") * 64 + F.col("_bit")).alias("number"), "node")


def _hub_bounds(search: _Search, max_hops: int) -> DataFrame:
    """(number, upper, at) of the pairs whose ends both reach one of the 64 nodes
    with most edges: a path over such a hub has ``upper`` hops, and once ``at``
    hops are searched none can be shorter.

    In a component without an odd cycle all paths between two nodes are even or
    all are odd, so after ``upper - 2`` hops only ``upper`` is left; else after
    ``upper - 1``. A hub's component has an odd cycle if and only if an edge joins
    two nodes equally far from the hub. One block of bits stands for all hubs.
    """
    scratch = search.scratch
    degree = search.adjacency.groupBy("near").agg(F.count(F.lit(1)).alias("n"))
    search.hubs = {r[0]: r[1] for r in degree.orderBy(F.desc("n"), "near").limit(64).collect()}
    hubs = list(search.hubs)
    for end, (first,) in search.levels.items():
        search.sizes[end] = search.cost(first, search.sizes[end])
    bits = [1 << i if i < 63 else -(1 << 63) for i in range(len(hubs))]
    levels = [scratch.write(scratch.spark.createDataFrame(list(zip([0] * len(hubs), hubs, bits)), "block long, node long, bits long"), "hubs")]
    odd, whole = 0, not hubs
    while not whole and len(levels) <= max_hops:
        # an edge inside the level closes an odd cycle
        arrived = search.step(levels[-1]).withColumnRenamed("bits", "_all")
        own = levels[-1].withColumnRenamed("bits", "_own")
        step = arrived.join(own, ["block", "node"], "left").withColumn("odd", F.expr("nullif(_all & _own, 0L)"))
        step = step.select("block", "node", F.expr("_all & ~coalesce(_own, 0L)").alias("bits"), "odd")
        if len(levels) > 1:
            before = levels[-2].withColumnRenamed("bits", "_seen")
            step = step.join(before, ["block", "node"], "left").select("block", "node", F.expr("bits & ~coalesce(_seen, 0L)").alias("bits"), "odd")
        made, _, odds = scratch.write_counted(step.where("bits <> 0 OR odd IS NOT NULL"), "hubs", "odd")
        if odds:
            odd |= made.agg(F.bit_or("odd")).first()[0]
        made = made.where("bits <> 0").drop("odd")
        whole = made.isEmpty()
        levels.append(made)
    far = reduce(DataFrame.unionByName, [made.select("node", "bits", F.lit(d).alias("d")) for d, made in enumerate(levels)])
    ends = {}
    for end in ("from_qn", "to_qn"):
        node = search.numbers(search.levels[end][0])
        only = node.groupBy("number").agg(F.min("node").alias("node"), (F.count(F.lit(1)) == 1).alias("only"))
        ends[end] = scratch.write(only.where("only").drop("only").join(far, "node").select("number", "bits", "d"), "to_hubs")
    both = ends["from_qn"].join(ends["to_qn"].toDF("number", "_bits", "_d"), "number").withColumn("bits", F.expr("bits & _bits")).where("bits <> 0")
    even = F.max(F.col("bits").bitwiseAND(F.lit(~odd).cast("long")) != 0) if whole else F.lit(False)
    upper = both.groupBy("number").agg(F.min(F.expr("d + _d")).alias("upper"), even.alias("_even")).where(F.col("upper") <= max_hops)
    at = F.greatest(F.lit(0), F.col("upper") - F.when(F.col("_even"), 2).otherwise(1))
    return scratch.write(upper.select("number", "upper", at.alias("at")), "bounds")


def path_lengths(graph: KnowledgeGraph, pairs: DataFrame, max_hops: int = MAX_PATH_HOPS) -> DataFrame:
    """(pair_id, hops) of a shortest undirected path per pair, of pairs that have one.

    Many pairs are first bounded by their distances to hubs: a pair is searched
    only until no path can be shorter than the one over a hub, so that what lies
    around the hubs is not spread out again for every block of pairs.
    """
    search = _Search(graph, pairs)
    bounds = _hub_bounds(search, max_hops) if search.wanted >= HUB_PAIRS else None
    found = [search.numbers(met).select("number").distinct().withColumn("hops", F.lit(hops)) for hops, _, _, met in search.meetings(max_hops, bounds)]
    if bounds is not None:
        found.append(bounds.select("number", F.col("upper").alias("hops")))
    if not found:
        return pairs.sparkSession.createDataFrame([], "pair_id long, hops int")
    least = reduce(DataFrame.unionByName, found).groupBy("number").agg(F.min("hops").alias("hops"))
    return least.join(search.pairs, "number").select("pair_id", "hops")


def shortest_paths(graph: KnowledgeGraph, pairs: DataFrame, max_hops: int = MAX_PATH_HOPS) -> DataFrame:
    """One shortest undirected path per pair, whatever the edge types.

    ``pairs`` holds (pair_id, from_qn, to_qn). Of several shortest paths the one
    with the smallest node sequence is kept. Returns (pair_id, hops, path) where
    path is an array of ``struct<qualified_name, kind>``; pairs without one are
    absent.

    Where pairs meet, the nodes on any of their shortest paths are marked from
    the meeting points back to both ends, again with 64 pairs a row. The path
    then takes the smallest marked node next to its last one, hop by hop.
    """
    search = _Search(graph, pairs)
    found = [_walked(search, *meeting) for meeting in search.meetings(max_hops)]
    if not found:
        return pairs.sparkSession.createDataFrame([], "pair_id long, hops int, path array<struct<qualified_name:string,kind:string>>")
    as_struct = F.transform("path", lambda n: F.struct(n["qualified_name"].alias("qualified_name"), n["kind"].alias("kind")))
    return reduce(DataFrame.unionByName, found).join(search.pairs, "number").select("pair_id", "hops", as_struct.alias("path"))


def _walked(search: _Search, hops: int, ahead: list[DataFrame], behind: list[DataFrame], met: DataFrame) -> DataFrame:
    """(number, hops, path) of the pairs that meet after some hops; ``ahead`` and
    ``behind`` are the levels from either end."""

    def marked(near: DataFrame, level: DataFrame) -> DataFrame:
        on = search.step(near).join(level.withColumnRenamed("bits", "_level"), ["block", "node"])
        on = on.withColumn("bits", F.col("bits").bitwiseAND(F.col("_level"))).where("bits <> 0").drop("_level")
        return search.scratch.write(on, "marked")

    marks = [met]
    for level in reversed(ahead[:-1]):
        marks.insert(0, marked(marks[0], level))
    for level in reversed(behind[:-1]):
        marks.append(marked(marks[-1], level))
    scratch = search.scratch

    def smallest(choices: DataFrame) -> DataFrame:
        """(number, n) with the smallest of the nodes (number, node)."""
        named = scratch.write(choices, "choices").join(search.nodes, "node")
        return named.groupBy("number").agg(F.min(F.struct("qualified_name", "kind", "node")).alias("n"))

    path = scratch.write(smallest(search.numbers(marks[0])).select("number", F.array("n").alias("path")), "walked")
    for mark in marks[1:]:
        # from the last node along its edges: never all marked nodes of a pair
        heads = path.select("number", F.element_at("path", -1)["node"].alias("near"))
        far = heads.join(search.adjacency, "near").select("number", F.shiftright("number", 6).alias("block"), F.col("far").alias("node"))
        choices = far.join(mark, ["block", "node"]).where(F.col("bits").bitwiseAND(F.expr(_BIT)) != 0).select("number", "node")
        path = scratch.write(path.join(smallest(choices), "number").select("number", F.array_append("path", F.col("n")).alias("path")), "walked")
    return path.select("number", F.lit(hops).alias("hops"), "path")


def path_nodes(graph: KnowledgeGraph, paths: DataFrame) -> DataFrame:
    """Paths as rows: (pair_id, ordinal, name, qualified_name, kind,
    relationship, direction); the last two are blank on a path."""
    steps = paths.select("pair_id", F.posexplode("path").alias("ordinal", "n")).select("pair_id", "ordinal", "n.*")
    names = graph.entities.select("kind", "qualified_name", "name")
    return steps.join(names, ["kind", "qualified_name"]).select(
        "pair_id", "ordinal", "name", "qualified_name", "kind", F.lit("").alias("relationship"), F.lit("").alias("direction")
    )
