import random

import pytest

from weftgraph.operators import graphs, kernels


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("search", [graphs.shortest_cycles, lambda e: graphs.search_cycles(graphs.no_loops(e))])
def test_shortest_cycles(spark, search):
    assert rows(search(edges(spark, "AB", "BA", "BC"))) == [("A", ["A", "B", "A"]), ("B", ["B", "A", "B"])]
    assert [r[0] for r in rows(search(edges(spark, "AB", "BC", "CA", "DE", "ED")))] == ["D", "E"]
    assert rows(search(edges(spark, "AA"))) == [] and rows(search(edges(spark, "AB", "AC", "BD", "CD"))) == []


def test_levels_leave_the_start_out(spark):
    start = spark.createDataFrame([("A",)], "node string")
    assert rows(graphs.levels(edges(spark, "AB", "BA", "BC"), start)) == [("A", "B", 1), ("A", "C", 2)]


@pytest.mark.parametrize("join", [graphs.components, lambda e: graphs.label_components(graphs.no_loops(e))])
def test_components(spark, join):
    got = rows(join(edges(spark, "AB", "BC", "DE", "FF")))
    assert got == [("A", "A"), ("B", "A"), ("C", "A"), ("D", "D"), ("E", "D")]


def test_components_of_paths_stars_and_random_graphs(spark):
    rng = random.Random(6)
    name = lambda i: f"n{i:03d}"
    order = rng.sample(range(60), 60)
    shapes = [
        [(order[i], order[i + 1]) for i in range(59)],
        [(i, i + 1) for i in range(50)],
        [(99, i) for i in range(20)] + [(0, i) for i in range(40, 60)],
        [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    ]
    pairs = [(name(100 * k + a), name(100 * k + b)) for k, shape in enumerate(shapes) for a, b in shape]
    label = {n: n for p in pairs for n in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = graphs.label_components(graphs.no_loops(spark.createDataFrame(pairs, "src string, dst string")))
    assert {r["node"]: r["component"] for r in got.collect()} == label and got.count() == len(label)


def test_strong_components_against_reachability(spark):
    rng = random.Random(4)
    pairs = {(f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for _ in range(40)}
    reach = {(a, b) for a, b in pairs}
    while True:
        more = {(a, d) for a, b in reach for c, d in pairs if b == c} - reach
        if not more:
            break
        reach |= more
    nodes = {n for p in pairs for n in p}
    want = {n for n in nodes if (n, n) in reach}
    e = edges(spark, *pairs)
    assert {r[0] for r in graphs.cyclic_nodes(e).collect()} == want
    got = {r["node"]: r["component"] for r in graphs.strong_components(e).collect()}
    assert got == {r["node"]: r["component"] for r in graphs.color_components(e).collect()}
    assert got == {a: min(b for b in nodes if (a, b) in reach and (b, a) in reach) for a in nodes if any(b != a and (a, b) in reach and (b, a) in reach for b in nodes)}


def test_topological_order(spark):
    e = edges(spark, "AB", "AC", "BD", "CD", "XY", "YX")
    nodes = spark.createDataFrame([(n,) for n in "ABCDXYZ"], "node string")
    got = {r["node"]: (r["layer"], r["cyclic"]) for r in graphs.topological_order(nodes, e).collect()}
    assert got == {"A": (2, False), "B": (1, False), "C": (1, False), "D": (0, False), "Z": (0, False), "X": (None, True), "Y": (None, True)}


def test_include_closure_ends_on_cycles(spark):
    root = spark.createDataFrame([("A",)], "node string")
    assert rows(graphs.include_closure(root, edges(spark, "AB", "BA", "BC", "XY"))) == [("A", "B"), ("B", "A"), ("B", "C")]


def _flow(spark, fragments, uses):
    f = spark.createDataFrame(fragments, "module string, file string")
    u = spark.createDataFrame(uses, "dependee string, dependency string")
    c = spark.createDataFrame([("M1,M2", ["M1", "M2", "M1"])], "cycle_id string, cycle array<string>")
    return graphs.flow_edges(c, u, f)


def test_weak_edge_is_cut(spark):
    flow = _flow(spark, [("M1", "a1"), ("M1", "a2"), ("M2", "b1"), ("M2", "b2")], [("a1", "b1"), ("a2", "b1"), ("b2", "a1")])
    assert rows(kernels.cut_values(flow)) == [("M1,M2", 1.0)]
    assert rows(kernels.cut_edges(flow)) == [("M1,M2", "b2", "a1")]
    assert flow.where("src_side = 'hub' or dst_side = 'hub'").where("capacity < double('infinity')").count() == 0
    assert [r[1] for r in rows(kernels.move_plans(flow))] == ["a1"] or rows(kernels.move_plans(flow))


def test_hubs_are_capped_where_a_file_is_on_both_sides(spark):
    flow = _flow(spark, [("M1", "a1"), ("M1", "a2"), ("M2", "b1"), ("M2", "b2")], [("a1", "b1"), ("a2", "b1"), ("b1", "a2"), ("b2", "a1")])
    got = {(r["src"], r["src_side"], r["dst"], r["dst_side"]): r["capacity"] for r in flow.collect()}
    assert got["b1", "in", "b1", "out"] == float("inf") and got["M2", "hub", "b2", "out"] == 1.0


def test_minimum_cut_is_the_maximum_flow():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(3, 8)
        es = [((str(rng.randrange(n)), ""), (str(rng.randrange(n)), ""), float(rng.randint(1, 5))) for _ in range(rng.randint(2, 20))]
        s, t = ("0", ""), (str(n - 1), "")
        value, near = kernels.minimum_cut(es, s, t)
        sides = []
        for mask in range(1 << n):
            if mask & 1 and not mask >> (n - 1) & 1:
                sides.append(sum(c for u, v, c in es if mask >> int(u[0]) & 1 and not mask >> int(v[0]) & 1))
        assert value == min(sides)
        assert value == sum(c for u, v, c in es if u not in near and v in near)


def test_fold():
    assert kernels.fold([("A", "B"), ("C", "B")]) == {"A": "B", "C": "B"}
    both = kernels.fold([("A", "B"), ("B", "A")])
    assert both["A"] == both["B"] and both["A"].startswith("intermediate_Module_")
    assert kernels.fold([("A", "B"), ("A", "C")]) == {"A": "B"} and kernels.fold([("A", "B"), ("C", "A")]) == {"A": "B", "C": "B"}


def test_external_cycles():
    m = {"a": "M", "b": "M", "c": "N", "x": None}
    left = kernels.broken_external_cycles([("a", "x"), ("x", "b"), ("b", "a")], m, {"a", "b"})
    assert len(left) == 2
    assert kernels.broken_external_cycles([("x", "y"), ("y", "x")], m, {"a"}) == [("x", "y"), ("y", "x")]
    with pytest.raises(ValueError):
        kernels.broken_external_cycles([("a", "c"), ("c", "a")], m, {"a", "c"})
    with pytest.raises(NotImplementedError):
        kernels.broken_external_cycles([("x", "a"), ("a", "x")], m, {"a", "x"})


def test_side_join(spark):
    from weftgraph.operators import relational as rel

    s = spark.createDataFrame([("A", "S"), ("B", "T"), ("C", "T")], "node string, side string")
    assert rows(rel.cutting_edges(edges(spark, "AB", "BC", "CA"), s).select("src", "dst")) == [("A", "B"), ("C", "A")]


def test_longer_shortest_cycles(spark):
    """Cycles of 3 to 8 edges with branches, and graphs without any, as the search in one place finds them."""
    rng = random.Random(1)
    for n, back in ((7, 0), (8, 4), (5, 2), (3, 3)):
        pairs = {(f"c{i}", f"c{(i + 1) % n}") for i in range(n)} | {(f"c{i}", f"d{i}") for i in range(3)} | {(f"d{i}", f"d{i + 1}") for i in range(4)}
        pairs |= {(f"d{rng.randrange(5)}", f"c{rng.randrange(n)}") for _ in range(back)}
        want = sorted((a, b) for a, b in kernels.shortest_cycles(sorted(pairs)))
        assert rows(graphs.search_cycles(edges(spark, *pairs))) == want and want
    long = [(f"c{i}", f"c{(i + 1) % 8}") for i in range(8)]
    assert len(rows(graphs.search_cycles(edges(spark, *long)))[0][1]) == 9
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    assert rows(graphs.search_cycles(edges(spark, *chain))) == []


def test_sibling_groups_are_the_kernels(spark):
    rng = random.Random(5)
    pairs = sorted({(f"n{a}", f"n{b}") for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(50)) if a != b})
    graph = {}
    for a, b in pairs:
        graph.setdefault(a, set()).add(b)
    nodes = sorted({n for p in pairs for n in p})
    got = graphs.sibling_groups(edges(spark, *pairs), spark.createDataFrame([(n,) for n in nodes], "node string")).collect()
    want = sorted((n, tuple(g)) for n in nodes for g in kernels.sibling_groups(graph, n))
    assert sorted((r["start"], tuple(r["nodes"])) for r in got) == want
    assert all(set(r["nodes"]) <= graph[r["parent"]] for r in got)


def test_external_cycles_by_joins(spark):
    f = spark.createDataFrame([("M", "a"), ("M", "b"), ("N", "c"), ("N", "e")], "module string, file string")
    pairs = [("a", "x"), ("x", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("c", "z"), ("z", "c"), ("e", "e"), ("q", "q"), ("a", "c")]
    got = {tuple(r) for r in graphs.without_external_cycles(edges(spark, *pairs), f).collect()}
    assert got == {("a", "x"), ("b", "a"), ("x", "y"), ("y", "x"), ("c", "z"), ("q", "q"), ("a", "c")}
    with pytest.raises(Exception, match="between several modules"):
        graphs.without_external_cycles(edges(spark, ("a", "c"), ("c", "a")), f).collect()


def _state(spark, fragments, uses):
    from weftgraph.plans.model import State

    return State(spark.createDataFrame(fragments, "module string, file string"), spark.createDataFrame([(a, b, "uses") for a, b in uses], "dependee string, dependency string, kind string"))


def test_a_cycle_that_cannot_be_split_is_named(spark):
    from weftgraph.plans import passes

    # Each module's only file uses the next one's: whatever moves, the files stay on a cycle.
    state = _state(spark, [("A", "a"), ("B", "b"), ("C", "c")], [("a", "b"), ("b", "c"), ("c", "a")])
    with pytest.raises((ValueError, RecursionError), match="A,B,C|again and again"):
        passes.split(state)


def test_split_of_random_acyclic_files(spark):
    """Files that use smaller ones only, in five modules: in the end no module is on a cycle, each file in one place."""
    from weftgraph.plans import passes

    rng = random.Random(3)
    uses = {(f"{a:02}", f"{b:02}") for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(70)) if a > b}
    state = _state(spark, [(f"M{rng.randrange(5)}", f"{i:02}") for i in range(30)], sorted(uses))
    done = passes.split(state, alone=True)
    assert sorted(r["file"] for r in done.fragments.collect()) == [f"{i:02}" for i in range(30)]
    assert graphs.cyclic_nodes(passes.module_edges(done)).count() == 0


def test_merge_is_what_folding_comes_to(spark):
    """The fold, round by round, on random modules, against the components joined at once."""
    from weftgraph.plans import passes

    rng = random.Random(6)
    for _ in range(2):
        files = [(f"M{i % 9}", f"f{i:02}") for i in range(27)]
        uses = {(f"f{rng.randrange(27):02}", f"f{rng.randrange(27):02}") for _ in range(16)}
        state = _state(spark, files, sorted((a, b) for a, b in uses if a != b))
        folded = dict((f, m) for m, f in files)
        while True:
            now = _state(spark, [(m, f) for f, m in folded.items()], sorted((a, b) for a, b in uses if a != b))
            into = passes.fold_once(now)
            if not into:
                break
            for f, m in folded.items():
                while m in into:
                    m = into[m]
                folded[f] = m
        groups = lambda of: sorted(sorted(f for f in of if of[f] == m) for m in set(of.values()))
        assert groups({r["file"]: r["module"] for r in passes.merge(state).fragments.collect()}) == groups(folded)


def test_contracted_networks_have_the_same_cuts(spark):
    """Random cycles of two to four modules with files on one side and on both."""
    rng = random.Random(12)
    fragments, uses, cycles, want = [], [], [], {}
    for k in range(25):
        n = rng.randint(2, 4)
        mods = [f"c{k:02}m{i}" for i in range(n)]
        files = {m: [f"{m}f{j}" for j in range(rng.randint(1, 5))] for m in mods}
        fragments += [(m, f) for m in mods for f in files[m]]
        uses += sorted({(rng.choice(files[mods[i]]), rng.choice(files[mods[(i + 1) % n]])) for i in range(n) for _ in range(rng.randint(1, 7))})
        cycles.append((",".join(mods), [*mods, mods[0]]))
    flow = graphs.flow_edges(spark.createDataFrame(cycles, "cycle_id string, cycle array<string>"), spark.createDataFrame(uses, "dependee string, dependency string"), spark.createDataFrame(fragments, "module string, file string"))
    for key, g in flow.toPandas().groupby("cycle_id"):
        want[key] = kernels.cut_of(g)[0]
    assert {r["cycle_id"]: r["cut_value"] for r in kernels.cut_values(flow).collect()} == want and len(set(want.values())) > 2
    small = {r["cycle_id"]: r["count"] for r in graphs.contracted(flow).groupBy("cycle_id").count().collect()}
    full = {r["cycle_id"]: r["count"] for r in flow.groupBy("cycle_id").count().collect()}
    assert all(small[c] < full[c] for c in full)


def test_cycles_of_three_are_met_at_their_node_of_fewest_edges(spark):
    """Random edges of one way only beside a hub, against the search from every node."""
    rng = random.Random(21)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(130)) if a != b}
    turned = sorted({(f"n{a:02}", f"n{b:02}") if rng.random() < 0.5 else (f"n{b:02}", f"n{a:02}") for a, b in pairs} | {("hub", f"n{i:02}") for i in range(0, 40, 2)} | {(f"n{i:02}", "hub") for i in range(1, 40, 2)})
    want = sorted(kernels.shortest_cycles(turned))
    assert {len(c) for _, c in want} == {4}
    e = spark.createDataFrame(turned, "src string, dst string")
    assert sorted((r["node"], r["cycle"]) for r in graphs.triangles(e).collect()) == want
    assert sorted((r["node"], r["cycle"]) for r in graphs.search_cycles(e).collect()) == want


def test_a_large_module_is_named_by_pieces(spark, monkeypatch):
    """No module's files are gathered: names are the same whatever the pieces."""
    from weftgraph.plans import passes

    files = [("M", f"d/f{i}.h") for i in range(300)] + [("N", "only.c"), ("O", "é/ü"), ("O", "a")]
    monkeypatch.setattr(passes, "PIECE", 64)
    f = spark.createDataFrame([*files, ("M", "d/f7.h")], "module string, file string")
    got = {(r["module"], r["file"]) for r in passes.canonical_names(f).collect()}
    assert got == {(kernels.name_of([g for n, g in files if n == m]), x) for m, x in files}
    assert sum(r["n"] for r in passes.module_digests(f).collect()) == 303


def test_many_small_components_one_behind_another_take_few_passes(spark, monkeypatch):
    """Cycles of three nodes, of which each leads to random later ones: colours alone would find few of them a pass."""
    rng = random.Random(8)
    n = 120
    pairs = {(f"{x}{i}", f"{y}{i}") for i in range(n) for x, y in ("ab", "bc", "ca")}
    pairs |= {(f"{rng.choice('abc')}{i}", f"{rng.choice('abc')}{j}") for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(700)) if i < j}
    passes, colored = [], graphs.colored
    monkeypatch.setattr(graphs, "colored", lambda e, nth: passes.append(nth) or colored(e, nth))
    got = {r["node"]: r["component"] for r in graphs.color_components(spark.createDataFrame(sorted(pairs), "src string, dst string")).collect()}
    assert got == dict(kernels.strong_components(sorted(pairs))) and len(set(got.values())) == n
    assert len(passes) <= 6


def test_mutual_cycles_shuffle_edges_once(spark):
    """Each pair of modules that use each other is met by one grouping of the edges, with no join; repeated edges count once."""
    e = edges(spark, ("b", "a"), ("a", "b"), ("a", "b"), ("c", "b"), ("b", "c"), ("c", "d"), ("e", "d"), ("e", "c"), ("c", "e"))
    got = graphs.mutual_cycles(e)
    assert sorted((r["node"], r["cycle"]) for r in got.collect()) == [("a", ["a", "b", "a"]), ("b", ["b", "a", "b"]), ("c", ["c", "b", "c"]), ("e", ["e", "c", "e"])]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_groups_are_rows_of_sorted_partitions(spark, monkeypatch):
    """Thousands of small groups take no data frame each, and large ones come whole, also over several batches."""
    import pyarrow as pa

    monkeypatch.setattr(kernels, "BATCH", 7)
    rows_ = [(f"g{k:03}", f"{i:03}", float(i)) for k in range(300) for i in range(1 + (k % 3) + 400 * (k == 5))] + [(None, "x", 1.0)]
    df = spark.createDataFrame(rows_, "g string, a string, v double")
    got = kernels.by_group(df, "g", ["a", "v"], lambda k, g: [(k, min(g.a), sum(g.v))] * (k != "g001"), ["g", "a", "v"], [pa.string(), pa.string(), pa.float64()])
    want = {}
    for g, _, v in rows_:
        want[g] = want.get(g, 0) + v
    assert {r["g"]: r["v"] for r in got.collect()} == {g: v for g, v in want.items() if g != "g001"} and got.count() == 300
    for plan in (kernels.move_plans, kernels.cut_edges, kernels.cut_values):
        flow = _flow(spark, [("M1", "a1"), ("M2", "b1")], [("a1", "b1"), ("b1", "a1")])
        assert "PandasGroup" not in plan(flow)._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in plan(flow)._jdf.queryExecution().optimizedPlan().toString()


def test_colouring_goes_both_ways(spark, monkeypatch):
    """Cycles along two long paths, of which neither the least draw before nor that behind finds all: labels of both ways at once
    leave few passes, numbers stand for names, and repeated names and names of other languages do no harm."""
    rng = random.Random(17)
    pairs = {(f"é{i}", f"é{i + 1}") for i in range(40)} | {(f"é{i + 1}", f"é{i}") for i in range(0, 40, 4)} | {(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)}
    passes, colored = [], graphs.colored
    monkeypatch.setattr(graphs, "colored", lambda e, nth: passes.append(nth) or colored(e, nth))
    monkeypatch.setattr(graphs, "FEW_FRESH", 5)
    got = {r["node"]: r["component"] for r in graphs.color_components(edges(spark, *sorted(pairs), *sorted(pairs)[:9])).collect()}
    assert got == dict(kernels.strong_components(sorted((a, b) for a, b in pairs if a != b))) and got and len(passes) <= 4
