"""Graph operators as loops of joins. Edges are (src, dst); each round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .loops import empty, stored


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src <> dst").distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are among nodes(node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "dst"), "dst", "left_semi")


def union_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


#: Rows of a round up to which what was seen is looked through for them, instead of being shuffled.
FEW = 1_000_000


def unseen(step: DataFrame, seen: DataFrame | None, keys: list[str], few: bool) -> DataFrame:
    """Rows of step whose keys are not in seen. If a round has few rows, seen is first cut down to these by a broadcast,
    so that it is read and not shuffled: it grows by the round, and late rounds are small."""
    if seen is None:
        return step
    if few:
        step = stored(step)
        seen = seen.join(F.broadcast(step.select(*keys).distinct()), keys, "left_semi")
    return step.join(seen.select(*keys), keys, "left_anti")


def levels(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, level): what each start reaches, and in how many steps at least; the start itself never counts."""
    edges = stored(no_loops(edges))
    front = starts.select(F.col("node").alias("start"), "node").distinct()
    seen, level, n = None, 0, FEW + 1
    while True:
        level += 1
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).where("start <> node").distinct()
        front = stored(unseen(step, seen, ["start", "node"], n <= FEW).withColumn("level", F.lit(level)))
        seen = front if seen is None else seen.unionByName(front)
        n = front.count()
        if not n:
            return seen


#: Graphs of at most so many edges are searched in one place, as their rounds cost more than their rows; callers may say another number, 0 for never.
SMALL = 20_000


def small(edges: DataFrame, most: int) -> list[tuple] | None:
    """The edges, sorted, if there are at most so many; else null. No more than most + 1 rows come to the driver."""
    rows = edges.limit(most + 1).collect() if most else []
    return sorted(map(tuple, rows)) if most and len(rows) <= most else None


def shortest_cycles(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, cycle): closed lists of the shortest cycles' length, one for each node on such a cycle.

    All nodes search at once, a level a round, and stop at the first level at which any comes back; of
    equal paths the smallest in dictionary order is kept. Loops do not count. Rows: at most nodes
    squared, but only as deep as the shortest cycle. Small graphs are searched alike on the driver.
    """
    edges = stored(no_loops(edges))
    few = small(edges, SMALL if most is None else most)
    if few is not None:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(kernels.shortest_cycles(few), f"node {kind}, cycle array<{kind}>")
    return search_cycles(edges)


def search_cycles(edges: DataFrame) -> DataFrame:
    """As shortest_cycles, for edges without loops of any number.

    A shortest closed walk of length i + j from a node has, i steps on, a node that is i steps away and from
    which it is j steps back; so distances of half the length are enough, and the two halves, each the smallest
    of its length, meet in one join. Cycles of two edges are looked for first, then those of three. If there are none,
    edges that lie on no cycle go before anything is searched: what is left is inside strong components.
    """
    for short in (mutual_cycles, triangles):
        met = stored(short(edges))
        if not empty(met):
            return met
    edges = stored(inside_components(edges))
    last = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")))
    seen = last.select("node", "at")
    while not empty(last):
        step = last.join(edges, last["at"] == edges["src"]).where("node <> dst").select("node", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        step = stored(step.join(seen, ["node", "at"], "left_anti").groupBy("node", "at").agg(F.min("path").alias("path")))
        for back in (last, step):
            met = stored(closed(step, back))
            if not empty(met):
                return met
        seen, last = seen.unionByName(step.select("node", "at")), step
    return met


def mutual_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle): of each node that has cycles of two edges the smallest; edges without loops."""
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.bool_or(F.col("src") < F.col("dst")).alias("there"), F.bool_or(F.col("src") > F.col("dst")).alias("back"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("at")), F.struct(F.col("b").alias("node"), F.col("a").alias("at"))))
    least = pairs.where("there and back").select(ways.alias("way")).groupBy("way.node").agg(F.min("way.at").alias("at"))
    return least.select("node", F.array("node", "at", "node").alias("cycle"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, cycle): of each node that has cycles of three edges the smallest; edges without loops.

    A cycle is met once, at its node of the fewest edges (of equal ones the first by name): an edge into it and one out
    of it, both from and to nodes of more, and the third edge closes them. A node has few such neighbours even if it has
    very many edges, and no paths are stored.
    """
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    at = lambda c: ends.select(F.col("node").alias(c), F.struct("n", "node").alias(f"{c}_rank"))
    ranked = stored(edges.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", (F.col("src_rank") < F.col("dst_rank")).alias("up")))
    first, last = ranked.where("up").select(F.col("src").alias("a"), F.col("dst").alias("b")), ranked.where("not up").select(F.col("dst").alias("a"), F.col("src").alias("c"))
    met = first.join(last, "a").join(edges.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    turns = F.array(F.array("a", "b", "c", "a"), F.array("b", "c", "a", "b"), F.array("c", "a", "b", "c"))
    return met.select(F.explode(turns).alias("cycle")).groupBy(F.col("cycle")[0].alias("node")).agg(F.min("cycle").alias("cycle"))


def closed(there: DataFrame, back: DataFrame) -> DataFrame:
    """(node, cycle): the smallest closed path of each node that is one of there(node, at, path) and then one of back."""
    b = back.select(F.col("node").alias("at"), F.col("at").alias("node"), F.col("path").alias("rest"))
    both = there.join(b, ["node", "at"])
    return both.groupBy("node").agg(F.min(F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))).alias("cycle"))


def inside_components(edges: DataFrame) -> DataFrame:
    """Edges whose ends are in one strong component: those that lie on a cycle."""
    of = strong_components(edges)
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("c")), of.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    return edges.join(a, "src").join(b, "dst").where("c = d").select("src", "dst")


def sibling_groups(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, level, parent, nodes): what each visited node is the first to lead to, sorted; nodes are visited breadth
    first, siblings by name, and the start never counts.

    A node's place among those of its level is the path of names by which it was first reached, as visits go by
    (parent's place, name); so the first of several parents is the one of the smallest path, and no level of a
    start is sorted in one place.
    """
    edges = stored(no_loops(edges))
    front = starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path")).distinct()
    seen, out, level, n = None, None, 0, FEW + 1
    while True:
        level += 1
        step = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node"), "path").where("start <> node")
        step = step.groupBy("start", "node").agg(F.min("path").alias("path"))
        step = stored(unseen(step, seen, ["start", "node"], n <= FEW))
        n = step.count()
        groups = step.groupBy("start", "path").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
        groups = groups.select("start", F.lit(level).alias("level"), F.element_at("path", -1).alias("parent"), "nodes")
        if not n:
            return groups if out is None else out
        out = groups if out is None else out.unionByName(groups)
        front = step.select("start", "node", F.array_append("path", F.col("node")).alias("path"))
        here = step.select("start", "node")
        seen = here if seen is None else seen.unionByName(here)


def without_external_cycles(edges: DataFrame, fragments: DataFrame) -> DataFrame:
    """Edges (src, dst) between files, some of modules and some of none, without those that close a cycle through a
    module's own files; cycles of files of no module stay.

    Only edges inside a strong component that has a file of a module can close one; each such component is one
    group, cleaned by kernels.broken_external_cycles, whose errors (cycles through several modules) are raised
    from there. All other edges pass.
    """
    edges = stored(edges.select("src", "dst").distinct())
    place = fragments.groupBy(F.col("file").alias("node")).agg(F.min("module").alias("module"))
    of = strong_components(edges)
    inner = of.join(place, "node").select("component").distinct()
    loops = edges.where("src = dst").join(place.select(F.col("node").alias("src")), "src", "left_semi")
    of = stored(of.join(inner, "component", "left_semi"))
    a, b = of.select(F.col("node").alias("src"), F.col("component").alias("c")), of.select(F.col("node").alias("dst"), F.col("component").alias("d"))
    on = stored(edges.join(a, "src").join(b, "dst").where("c = d and src <> dst").select("src", "dst", "c"))
    modules = place.toDF("src", "src_module")
    left = kernels.cleaned(on.join(modules, "src", "left").join(place.toDF("dst", "dst_module"), "dst", "left"), "c")
    rest = edges.join(on.select("src", "dst"), ["src", "dst"], "left_anti").join(loops, ["src", "dst"], "left_anti")
    return rest.unionByName(left.select("src", "dst"))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): the smallest node of each connected component, for nodes with an edge to another."""
    edges = stored(no_loops(edges))
    few = small(edges, SMALL if most is None else most)
    if few is not None:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(kernels.components(few), f"node {kind}, component {kind}")
    return label_components(edges)


def label_components(edges: DataFrame) -> DataFrame:
    """As components, for edges of any number, by contraction.

    Each node goes to the smallest of its neighbours if that is smaller than itself, and on by doubled steps to a node
    that goes nowhere; edges between what is then one are dropped, so each round has fewer. A path stays a path, and
    the smallest node of a component goes nowhere: when no edge is left, all have come to it. The rounds' steps are joined from the last to
    the first, as the last have the fewest rows.
    """
    e = stored(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    rounds = []
    while not empty(e):
        step = stored(e.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")))
        while True:
            far = step.select(F.col("node").alias("to"), F.col("to").alias("far"))
            jumped = stored(step.join(far, "to", "left").select("node", F.coalesce("far", "to").alias("to"), F.col("far").isNotNull().alias("on")))
            step = jumped.select("node", "to")
            if empty(jumped.where("on")):
                break
        rounds.append((e, step))
        moved = e.join(step.toDF("a", "a_to"), "a", "left").join(step.toDF("b", "b_to"), "b")
        a, b = F.coalesce("a_to", "a"), F.col("b_to")
        e = stored(moved.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct())
    found = None
    for e, step in reversed(rounds):
        nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().join(step, "node", "left").select("node", F.coalesce("to", "node").alias("to"))
        if found is not None:
            nodes = nodes.join(found.toDF("to", "end"), "to", "left").select("node", F.coalesce("end", "to").alias("to"))
        found = stored(nodes)
    return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0) if found is None else found.toDF("node", "component")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges, mostly on paths between cycles: rounds drop edges out of nodes nothing leads to, and into nodes nothing
    leaves, as long as a round drops a twentieth."""
    edges = stored(edges)
    n = edges.count()
    while n:
        entered, left_ = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        left = stored(edges.join(entered, "src", "left_semi").join(left_, "dst", "left_semi").select("src", "dst"))
        m, n, edges = n, left.count(), left
        if m - n < max(1, m / 20):
            break
    return edges


def strong_components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, component): strongly connected components of more than one node, named by their smallest."""
    edges = stored(no_loops(edges))
    few = small(edges, SMALL if most is None else most)
    if few is not None:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.sparkSession.createDataFrame(kernels.strong_components(few), f"node {kind}, component {kind}")
    return color_components(edges)


#: Labels besides the first that nodes get in a pass, each way.
LABELS = 2
#: Nodes with new labels up to which these are broadcast to the edges, which are then not shuffled.
FEW_FRESH = 200_000


def color_components(edges: DataFrame) -> DataFrame:
    """As strong_components, for edges of any number, by colouring.

    Nodes have draws, and get the least of what reaches them and the least of what they reach. If both are one node's, they
    are in its component. Nodes of one component are reached by the same nodes, and reach the same, so edges between
    ends of different labels lie on no cycle: they go, with the found nodes, the rest is trimmed, and so on with new draws.
    Nodes have several draws at a time, all of which must agree: without them a graph of very many small components
    would lose but half of the edges between these in a pass. Nodes go by numbers, as labels travel over every edge.
    """
    kind = edges.schema["src"].dataType.simpleString()
    edges, found, nth = trimmed(no_loops(edges)), None, 0
    named = stored(edges.select(F.col("src").alias("name")).union(edges.select("dst")).distinct().withColumn("node", F.monotonically_increasing_id()))
    at = lambda c: named.select(F.col("name").alias(c), F.col("node").alias(f"{c}_node"))
    edges = stored(edges.join(at("src"), "src").join(at("dst"), "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst")))
    while not empty(edges):
        of = colored(edges, nth)
        got = of.where("met").select("node", "component")
        found = got if found is None else found.unionByName(got)
        left = of.where("not met")
        ends = [left.select(F.col("node").alias(c), F.col("labels").alias(f"{c}_labels")) for c in ("src", "dst")]
        edges, nth = trimmed(edges.join(ends[0], "src").join(ends[1], "dst").where("src_labels = dst_labels").select("src", "dst")), nth + 1
    if found is None:
        return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    found = stored(found.join(named, "node").select(F.col("name").alias("node"), "component"))
    least = found.groupBy("component").agg(F.min("node").alias("name"), F.count("*").alias("n")).where("n > 1")
    return found.join(least, "component").select("node", F.col("name").alias("component"))


def colored(edges: DataFrame, nth: int) -> DataFrame:
    """(node, met, component, labels) of edges between numbers: whether a node is in the component of the least draw that
    reaches it, as it reaches that too; that draw, which is one node's only; and a digest of its labels both ways.

    Both ways go at once: a node is two, one that hands labels on along the edges and one against them. Only what has new
    labels hands them on.
    """
    labels = [f"label{i}" for i in range(LABELS + 1)]
    # A digest of one number is another for each other number.
    draws = [F.xxhash64(F.lit(nth * (LABELS + 1) + i), "node").alias(c) for i, c in enumerate(labels)]
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    color = stored(nodes.select(F.explode(F.array(F.expr("node * 2"), F.expr("node * 2 + 1"))).alias("node"), *draws, F.lit(True).alias("fresh")))
    ways = edges.selectExpr("src * 2 as src", "dst * 2 as dst").unionByName(edges.selectExpr("dst * 2 + 1 as src", "src * 2 + 1 as dst"))
    n = FEW_FRESH + 1
    while n:
        fresh = color.where("fresh").select(F.col("node").alias("src"), *labels)
        best = ways.join(F.broadcast(fresh) if n <= FEW_FRESH else fresh, "src").groupBy(F.col("dst").alias("node")).agg(*[F.min(c).alias(f"new_{c}") for c in labels])
        lower = F.lit(False)
        for c in labels:
            lower = lower | F.coalesce(F.col(f"new_{c}") < F.col(c), F.lit(False))
        color = stored(color.join(best, "node", "left").select("node", *[F.least(c, f"new_{c}").alias(c) for c in labels], lower.alias("fresh")))
        n = color.where("fresh").count()
    way = lambda k, c: color.where(f"node % 2 = {k}").select(F.expr("node div 2").alias("node"), F.col("label0").alias(c), F.struct(*labels).alias(f"{c}_labels"))
    both = way(0, "by").join(way(1, "to"), "node")
    return stored(both.select("node", (F.col("by") == F.col("to")).alias("met"), F.col("by").alias("component"), F.xxhash64("by_labels", "to_labels").alias("labels")))


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """(node): nodes on some cycle, loops included."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"))
    return strong_components(edges).select("node").union(loops).distinct()


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of an acyclic graph in which src depends on dst: a node's layer is one above its dependencies' highest.

    Each round keeps the nodes that depend on the last round's, so a round costs what is left; a node's
    layer is its last round. On a cycle nodes stay for ever: a round that drops none is an error.
    """
    edges = stored(edges.select("src", "dst").distinct())
    front = stored(nodes.select("node").union(edges.select("src")).union(edges.select("dst")).distinct().withColumn("layer", F.lit(0)))
    out, level, left = front, 0, front.count()
    while left:
        level += 1
        front = stored(front.select(F.col("node").alias("dst")).join(edges, "dst").select(F.col("src").alias("node")).distinct().withColumn("layer", F.lit(level)))
        before, left = left, front.count()
        if left == before:
            raise ValueError("a graph with a cycle has no layers")
        out = out.unionByName(front)
    return out.groupBy("node").agg(F.max("layer").alias("layer"))


def topological_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer, cyclic): an order is by cyclic, layer, node; nodes on a cycle are left out of the layers and come last."""
    bad = stored(cyclic_nodes(edges))
    rest = nodes.select("node").distinct().join(bad, "node", "left_anti")
    good = layers(rest, induced(edges, rest)).withColumn("cyclic", F.lit(False))
    last = nodes.select("node").distinct().join(bad, "node", "left_semi").select("node", F.lit(None).cast("int").alias("layer"), F.lit(True).alias("cyclic"))
    return good.unionByName(last)


def include_closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst): all include edges met on the way down from the roots(node), each once; cycles end."""
    edges = stored(edges.select("src", "dst").distinct())
    front = stored(roots.select("node").distinct())
    seen, out = front, None
    while not empty(front):
        got = stored(edges.join(front.withColumnRenamed("node", "src"), "src", "left_semi"))
        out = got if out is None else out.unionByName(got)
        front = stored(got.select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return edges.limit(0) if out is None else out


def flow_edges(cycles: DataFrame, uses: DataFrame, fragments: DataFrame) -> DataFrame:
    """(cycle_id, src, src_side, dst, dst_side, capacity): the network whose cut breaks each closed cycle(cycle_id, cycle).

    Sides: 'in' and 'out' of a file, 'hub' of a module, 'source' and 'sink' of the cycle's first module.
    Only uses between consecutive modules count.
    """
    inf = F.lit(float("inf"))
    members = cycles.select("cycle_id", F.posexplode(F.slice("cycle", F.lit(1), F.size("cycle") - 1)).alias("at", "module"))
    pairs = cycles.select("cycle_id", F.posexplode(F.arrays_zip(F.slice("cycle", F.lit(1), F.size("cycle") - 1).alias("a"), F.slice("cycle", F.lit(2), F.size("cycle") - 1).alias("b"))).alias("at", "e"))
    pairs = pairs.select("cycle_id", F.col("e.a").alias("from_module"), F.col("e.b").alias("to_module"))
    # Most modules may be on none of the cycles; their files go before uses are joined.
    place = stored(fragments.select("file", "module").join(members.select("module").distinct(), "module", "left_semi"))
    e = uses.select("dependee", "dependency").distinct()
    e = e.join(place.select(F.col("file").alias("dependee"), F.col("module").alias("from_module")), "dependee").join(place.select(F.col("file").alias("dependency"), F.col("module").alias("to_module")), "dependency")
    e = stored(e.join(pairs, ["from_module", "to_module"]).select("cycle_id", "dependee", "dependency", "from_module", "to_module"))
    ends = e.select("cycle_id", F.explode(F.array(F.struct(F.col("dependee").alias("file"), F.col("from_module").alias("module"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dependency").alias("file"), F.col("to_module").alias("module"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    deg = ends.groupBy("cycle_id", "x.module", "x.file").agg(F.sum("x.o").alias("o"), F.sum("x.i").alias("i")).join(members, ["cycle_id", "module"])
    both = deg.groupBy("cycle_id", "module").agg(F.max((F.col("o") > 0) & (F.col("i") > 0)).alias("both"))
    deg = deg.join(both, ["cycle_id", "module"])
    o, i, first = F.col("o") > 0, F.col("i") > 0, F.col("at") == 0
    edge = lambda a, s, b, t, c: F.struct(a.alias("src"), F.lit(s).alias("src_side"), b.alias("dst"), F.lit(t).alias("dst_side"), c.cast("double").alias("capacity"))
    m, f = F.col("module"), F.col("file")
    rules = [
        (first & i, edge(f, "in", m, "sink", inf)),
        (first & o, edge(m, "source", f, "out", inf)),
        (~first & i & o, edge(f, "in", f, "out", inf)),
        (~first & o & ~i, edge(m, "hub", f, "out", F.when(F.col("both"), F.col("o")).otherwise(inf))),
        (~first & i & ~o, edge(f, "in", m, "hub", F.when(F.col("both"), F.col("i")).otherwise(inf))),
    ]
    found = F.filter(F.array(*[F.when(c, x) for c, x in rules]), lambda x: x.isNotNull())
    inner = deg.select("cycle_id", F.explode(found).alias("x")).select("cycle_id", "x.*")
    outer = e.select("cycle_id", F.col("dependee").alias("src"), F.lit("out").alias("src_side"), F.col("dependency").alias("dst"), F.lit("in").alias("dst_side"), F.lit(1.0).alias("capacity"))
    return inner.unionByName(outer)


def contracted(flow: DataFrame) -> DataFrame:
    """flow_edges with the same cut values, but as many nodes as inner files on both sides, and two for each module.

    What the first module's files send comes from the source without a limit, and what they get goes to the sink:
    they are one with these. A file on one side only gets no more than its hub takes, and sends no more than its hub
    gives: it is one with its hub. A file on both sides is one node. Uses between the same two are one edge, whose
    capacity is their number.
    """
    at = lambda c: F.struct(F.col(c).alias("name"), F.col(f"{c}_side").alias("side"))
    side = lambda c, s: F.col(f"{c}_side") == s
    both = F.struct(F.col("src").alias("name"), F.lit("both").alias("side"))
    entry = lambda node, into: F.struct(node.alias("node"), into.alias("into"))
    met = (
        F.when(side("src", "source") | side("src", "hub"), F.array(entry(at("dst"), at("src"))))
        .when(side("dst", "sink") | side("dst", "hub"), F.array(entry(at("src"), at("dst"))))
        .when(side("src", "in") & side("dst", "out"), F.array(entry(at("src"), both), entry(at("dst"), both)))
    )
    flow = stored(flow)
    place = flow.select("cycle_id", F.explode(met).alias("e")).select("cycle_id", F.col("e.node.name").alias("name"), F.col("e.node.side").alias("side"), F.col("e.into").alias("into"))
    a = place.select("cycle_id", F.col("name").alias("src"), F.col("side").alias("src_side"), F.col("into").alias("a"))
    b = place.select("cycle_id", F.col("name").alias("dst"), F.col("side").alias("dst_side"), F.col("into").alias("b"))
    uses = flow.where(side("src", "out") & side("dst", "in"))
    joined = uses.join(a, ["cycle_id", "src", "src_side"]).join(b, ["cycle_id", "dst", "dst_side"])
    return joined.groupBy("cycle_id", F.col("a.name").alias("src"), F.col("a.side").alias("src_side"), F.col("b.name").alias("dst"), F.col("b.side").alias("dst_side")).agg(F.sum("capacity").alias("capacity"))
