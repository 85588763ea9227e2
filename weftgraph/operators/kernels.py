"""Sequential algorithms on one small graph each: minimum cuts, what to move, how to fold.

The per-cycle ones run inside mapInArrow, a cycle's network a group of a sorted partition; the network has the files of the
cycle's modules only. A minimum cut is not unique: ours is the one nearest the sink.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import DataFrame

from .loops import on_workers

Node = tuple[str, str]
OUT, IN = "out", "in"


def minimum_cut(edges: Iterable[tuple[Node, Node, float]], source: Node, sink: Node) -> tuple[float, set[Node]]:
    """The cut's value, and the nodes on the sink's side: those from which the sink is reached when no more flows."""
    rest: dict[Node, dict[Node, float]] = defaultdict(lambda: defaultdict(float))
    for u, v, c in edges:
        rest[u][v] += c
        rest[v][u] += 0
    value = 0.0
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for v, c in rest[u].items():
                if c > 0 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            break
        open_ = {u: list(sorted(rest[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                most = min(rest[a][b] for a, b in zip(path, path[1:]))
                value += most
                for a, b in zip(path, path[1:]):
                    rest[a][b] -= most
                    rest[b][a] += most
                cut_at = next(k for k, (a, b) in enumerate(zip(path, path[1:])) if rest[a][b] <= 0)
                del path[cut_at + 1 :]
                continue
            while open_[u] and not (rest[u][open_[u][-1]] > 0 and level.get(open_[u][-1]) == level[u] + 1):
                open_[u].pop()
            if open_[u]:
                path.append(open_[u][-1])
            else:
                path.pop()
                if path:
                    open_[path[-1]].pop()
    near = {sink}
    queue = deque([sink])
    while queue:
        v = queue.popleft()
        for u in rest[v]:
            if u not in near and rest[u][v] > 0:
                near.add(u)
                queue.append(u)
    return value, near


def shortest_cycles(edges: list[tuple]) -> list[tuple]:
    """(node, closed cycle) for each node on a shortest cycle, the smallest of equal paths; edges sorted, without loops."""
    after = defaultdict(list)
    for u, v in edges:
        after[u].append(v)
    most, found = None, []
    for n in sorted(after):
        front, seen = {n: [n]}, {n}
        length = 1
        while front and (most is None or length < most):
            length += 1
            step: dict = {}
            for path in front.values():
                for v in after.get(path[-1], ()):
                    if (v == n or v not in seen) and (v not in step or [*path, v] < step[v]):
                        step[v] = [*path, v]
            if n in step:
                if most is None or length < most:
                    most, found = length, []
                found.append((n, step[n]))
                break
            seen.update(step)
            front = step
    return found


def strong_components(edges: list[tuple]) -> list[tuple]:
    """(node, smallest node of its strong component), components of one node left out: two depth-first searches."""
    after, before = defaultdict(list), defaultdict(list)
    for u, v in edges:
        after[u].append(v)
        before[v].append(u)
    order, met = [], set()
    for root in sorted(after):
        stack = [(root, iter(after[root]))] if root not in met else []
        met.add(root)
        while stack:
            v = next((v for v in stack[-1][1] if v not in met), None)
            if v is None:
                order.append(stack.pop()[0])
            else:
                met.add(v)
                stack.append((v, iter(after.get(v, ()))))
    out, done = [], set()
    for root in reversed(order):
        if root in done:
            continue
        group, queue = [], [root]
        done.add(root)
        while queue:
            group.append(queue.pop())
            for u in before.get(group[-1], ()):
                if u not in done:
                    done.add(u)
                    queue.append(u)
        if len(group) > 1:
            out += [(n, min(group)) for n in group]
    return out


def components(edges: list[tuple]) -> list[tuple]:
    """(node, smallest node of its component)."""
    near = defaultdict(list)
    for u, v in edges:
        near[u].append(v)
        near[v].append(u)
    out: dict = {}
    for root in sorted(near):
        queue = [] if root in out else [root]
        out.setdefault(root, root)
        while queue:
            for v in near[queue.pop()]:
                if v not in out:
                    out[v] = root
                    queue.append(v)
    return list(out.items())


def distances(graph: dict[Node, set[Node]], start: Node) -> dict[Node, int]:
    out, queue = {start: 0}, deque([start])
    while queue:
        u = queue.popleft()
        for v in graph.get(u, ()):
            if v not in out:
                out[v] = out[u] + 1
                queue.append(v)
    return out


def on_shortest_path(graph: dict[Node, set[Node]], back: dict[Node, set[Node]], a: Node, b: Node, x: Node) -> bool:
    """Whether x is on some shortest path from a to b: the distances add up."""
    d, e = distances(graph, a), distances(back, b)
    return b in d and x in d and x in e and d[x] + e[x] == d[b]


def sibling_groups(graph: dict[Node, set[Node]], start: Node) -> Iterable[list[Node]]:
    """Neighbours not met before of each node, nodes in breadth-first order; the start is never generated."""
    met, queue = {start}, deque([start])
    while queue:
        group = sorted(v for v in graph.get(queue.popleft(), ()) if v not in met)
        met.update(group)
        queue.extend(group)
        if group:
            yield group


def name_of(files: Iterable[str]) -> str:
    """As functions.text.module_name."""
    files = sorted(files)
    name = "Module_" + hashlib.md5(",".join(files).encode()).hexdigest()[:7]
    if len(files) == 1:
        base = files[0].rsplit("/", 1)[-1]
        name += "_" + (base[: base.rindex(".")] if "." in base[1:] else base)
    return name


def files_to_move(edges: list[tuple[Node, Node, float]], cutting: list[tuple[str, str]]) -> dict[str, str]:
    """Which files go to which new module, so that a cycle breaks; empty if there is no way."""
    graph, back = defaultdict(set), defaultdict(set)
    for u, v, _ in edges:
        graph[u].add(v)
        back[v].add(u)
    nodes = set(graph) | set(back)
    two_sided = lambda f: (f, IN) in nodes and (f, OUT) in nodes
    tails = defaultdict(set)
    for u, v in cutting:
        tails[v].add(u)
    moving: dict[str, str | None] = dict.fromkeys(sorted(tails))
    for head in sorted(tails):
        if not two_sided(head):
            continue
        moving.pop(head, None)
        queue, met = deque(sorted(tails[head])), set()
        while queue:
            tail = queue.popleft()
            if tail in met:
                continue
            met.add(tail)
            if not two_sided(tail):
                moving[tail] = None
            elif not on_shortest_path(graph, back, (head, OUT), (head, IN), (tail, OUT)) and not on_shortest_path(graph, back, (tail, OUT), (tail, IN), (head, OUT)):
                moving[tail] = name_of([tail])
            else:
                moving.pop(tail, None)
                for way, start in ((graph, (tail, OUT)), (back, (tail, IN))):
                    found = next((g for g in ([f for f, side in group if side in (IN, OUT) and not two_sided(f)] for group in sibling_groups(way, start)) if g), None)
                    if found:
                        queue.extend(found)
                        break
    unnamed = [f for f, m in moving.items() if m is None]
    shared = name_of(unnamed) if unnamed else None
    return {f: m or shared for f, m in moving.items()}


def _network(g: SimpleNamespace) -> tuple[list[tuple[Node, Node, float]], Node | None, Node | None]:
    edges = [((a, s), (b, t), c) for a, s, b, t, c in zip(g.src, g.src_side, g.dst, g.dst_side, g.capacity)]
    ends = {n for u, v, _ in edges for n in (u, v)}
    return edges, next((n for n in ends if n[1] == "source"), None), next((n for n in ends if n[1] == "sink"), None)


def cut_of(g: SimpleNamespace) -> tuple[float, list[tuple[str, str]], list[tuple[Node, Node, float]]]:
    """A network's cut value, the file edges whose ends it parts, and its edges."""
    edges, source, sink = _network(g)
    if source is None or sink is None:
        return 0.0, [], edges
    value, near = minimum_cut(edges, source, sink)
    parted = sorted((u[0], v[0]) for u, v, _ in edges if u[1] == OUT and v[1] == IN and (u in near) != (v in near))
    return value, parted, edges


#: Rows of a batch that goes back, about.
BATCH = 10_000


def by_group(df: DataFrame, key: str, columns: list[str], run: Callable[[object, SimpleNamespace], Iterable[tuple]], names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    """What run makes of each group: its rows' columns are lists. Groups come one after another in sorted partitions, as most are
    of a few rows, for which a data frame each would cost far more than the work."""
    on_workers(df.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in (key, *columns)))

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for k, group in groupby(rows(batches), itemgetter(0)):
            out += run(k, SimpleNamespace(**dict(zip(columns, list(zip(*group))[1:]))))
            if len(out) >= BATCH:
                yield made(out)
                out = []
        if out:
            yield made(out)

    schema = ", ".join(f"{n} {'double' if k == pa.float64() else 'string'}" for n, k in zip(names, kinds))
    return df.select(key, *columns).repartition(key).sortWithinPartitions(key).mapInArrow(runs, schema)


NETWORK = ["src", "src_side", "dst", "dst_side", "capacity"]


def cut_values(flow: DataFrame) -> DataFrame:
    """(cycle_id, cut_value), from contracted networks: a cycle's group has no more edges than pairs of two-sided files
    that use each other, and a few for each such file and module."""
    from .graphs import contracted

    return by_group(contracted(flow), "cycle_id", NETWORK, lambda k, g: [(k, cut_of(g)[0])], ["cycle_id", "cut_value"], [pa.string(), pa.float64()])


def cut_edges(flow: DataFrame) -> DataFrame:
    """(cycle_id, dependee, dependency): the uses that each cycle's cut parts."""
    return by_group(flow, "cycle_id", NETWORK, lambda k, g: [(k, u, v) for u, v in cut_of(g)[1]], ["cycle_id", "dependee", "dependency"], [pa.string()] * 3)


def move_plans(flow: DataFrame) -> DataFrame:
    """(cycle_id, file, new_module)."""

    def run(k: object, g: SimpleNamespace) -> list[tuple]:
        _, parted, edges = cut_of(g)
        return [(k, f, m) for f, m in sorted(files_to_move(edges, parted).items())]

    return by_group(flow, "cycle_id", NETWORK, run, ["cycle_id", "file", "new_module"], [pa.string()] * 3)


def fold(strongest: list[tuple[str, str]]) -> dict[str, str]:
    """Which module merges into which, from the strongest edge of each shortest cycle in order.

    Opposite plans meet in a new module; who moves already is left; who merges into a mover follows it.
    """
    into: dict[str, str] = {}
    for a, b in strongest:
        if into.get(b) == a or into.get(a) == b:
            if into.get(b) == a:
                new = "intermediate_" + name_of([a, b])
                into[a] = into[b] = new
            continue
        if a in into:
            continue
        seen = {a}
        while b in into and b not in seen:
            seen.add(b)
            b = into[b]
        if b != a:
            into[a] = b
    return into


def broken_external_cycles(edges: list[tuple[str, str]], modules: dict[str, str | None], internal: set[str]) -> list[tuple[str, str]]:
    """Edges without those that close a cycle through a module's own files; cycles of external files only stay.

    Nodes are taken in sorted order. A cycle through files of several modules is an error, as is an
    internal file without a module.
    """
    graph = defaultdict(set)
    for u, v in edges:
        graph[u].add(v)
    # No edge that goes makes a cycle, so a file that is on none is done with.
    for f in sorted(internal):
        while cycle := _cycle_from(graph, f):
            inside = [n for n in cycle if n in internal]
            if any(modules.get(n) is None for n in inside):
                raise NotImplementedError(f"a file of the cycle {cycle} is in no module")
            if len({modules[n] for n in inside}) > 1:
                raise ValueError(f"the cycle {cycle} is between several modules")
            k = cycle.index(inside[-1])
            graph[cycle[k - 1]].discard(cycle[k])
    return sorted((u, v) for u, after in graph.items() for v in after)


def _cycle_from(graph: dict[str, set[str]], f: str) -> list[str]:
    """The shortest cycle through f, opened at f; empty if there is none."""
    parent, queue = {}, deque([f])
    while queue:
        u = queue.popleft()
        for v in sorted(graph.get(u, ())):
            if v == f:
                cycle = [u]
                while cycle[-1] != f:
                    cycle.append(parent[cycle[-1]])
                return cycle[::-1]
            if v not in parent:
                parent[v] = u
                queue.append(v)
    return []


def cleaned(edges: DataFrame, group: str) -> DataFrame:
    """(src, dst) of edges(src, dst, src_module, dst_module, group) without those that close cycles, a group on its own;
    a null module is that of a file of none."""

    def run(_: object, g: SimpleNamespace) -> list[tuple[str, str]]:
        modules = {f: m for f, m in [*zip(g.src, g.src_module), *zip(g.dst, g.dst_module)] if m is not None}
        return broken_external_cycles(list(zip(g.src, g.dst)), modules, set(modules))

    return by_group(edges, group, ["src", "dst", "src_module", "dst_module"], run, ["src", "dst"], [pa.string()] * 2)
