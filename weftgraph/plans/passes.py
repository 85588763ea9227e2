"""The passes that lead to modules without cycles, and their order."""

from __future__ import annotations

import dataclasses
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import HEADERS, digest_name, module_name, rotated
from ..operators import graphs, kernels, relational
from ..operators.loops import cut, empty, on_workers, stored
from .model import State, register, run_pass


def module_edges(state: State) -> DataFrame:
    return relational.imports(state.deps, state.fragments).select(F.col("module").alias("src"), F.col("dependency").alias("dst"))


def distinct_cycles(found: DataFrame) -> DataFrame:
    """(cycle_id, cycle): closed cycles, each once, turned to begin with the smallest name; the id is its names in order."""
    opened = rotated(F.slice("cycle", F.lit(1), F.size("cycle") - 1))
    c = found.select(opened.alias("c")).distinct()
    return c.select(F.array_join("c", ",").alias("cycle_id"), F.concat("c", F.slice("c", F.lit(1), F.lit(1))).alias("cycle"))


#: Bytes of names put together before a module's digest is taken.
PIECE = 1 << 20


def name_pieces(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(module, first, n, names) of rows(module, file) in order: names joined by commas, about PIECE bytes a row."""
    module, held, size = None, [], 0
    made = lambda: pa.RecordBatch.from_pydict({"module": [module], "first": [held[0]], "n": [len(held)], "names": [",".join(held)]})
    for b in rows:
        for m, f in zip(b.column("module").to_pylist(), b.column("file").to_pylist()):
            if held and (m != module or size >= PIECE):
                yield made()
                held, size = [], 0
            module = m
            held.append(f)
            size += len(f) + 1
    if held:
        yield made()


def digests(pieces: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(module, first, n, digest) of pieces in order: one row a module, of which no more than a piece is held."""
    row, digest = None, None
    made = lambda: pa.RecordBatch.from_pydict({"module": [row[0]], "first": [row[1]], "n": [row[2]], "digest": [digest.hexdigest()]})
    for b in pieces:
        for m, first, n, names in zip(*(b.column(c).to_pylist() for c in ("module", "first", "n", "names"))):
            if row and row[0] == m:
                digest.update(b"," + names.encode())
                row[2] += n
            else:
                if row:
                    yield made()
                row, digest = [m, first, n], hashlib.md5(names.encode())
    if row:
        yield made()


def module_digests(fragments: DataFrame) -> DataFrame:
    """(module, first, n, digest): of each module's files in order the first, their number, and the digest of all names.

    A module may hold most files, so none is gathered as an array: files are ordered by ranges, and one module's pieces
    go through its digest one after another.
    """
    on_workers(fragments.sparkSession)
    files = stored(fragments.where("module is not null and file is not null").select("module", "file").distinct())
    ordered = files.repartitionByRange("module", "file").sortWithinPartitions("module", "file")
    pieces = ordered.mapInArrow(name_pieces, "module string, first string, n long, names string")
    return pieces.repartition("module").sortWithinPartitions("module", "first").mapInArrow(digests, "module string, first string, n long, digest string")


def canonical_names(fragments: DataFrame) -> DataFrame:
    """Fragments with each module named by its files; where names meet, more of the digest tells them apart."""
    modules = stored(module_digests(fragments))
    digits = 7
    while True:
        named = modules.select("module", digest_name(F.col("digest"), F.col("n"), F.col("first"), digits).alias("name"))
        if digits >= 32 or empty(named.groupBy("name").count().where("count > 1")):
            return fragments.join(named, "module").select(F.col("name").alias("module"), "file")
        digits += 1


@register
def unique_files(state: State) -> State:
    """Files in more than one place leave all of them."""
    return dataclasses.replace(state, fragments=cut(relational.unique_fragments(state.fragments)[0]))


@register
def check_implementations(state: State) -> State:
    """An error if files of several modules implement one file."""
    bad = relational.insanity(state.deps, state.fragments).select("file").distinct().limit(5).collect()
    if bad:
        raise ValueError(f"implemented by several modules: {', '.join(r[0] for r in bad)}")
    return state


def placed_uses(state: State) -> DataFrame:
    """(dependee, dependency, from_module, to_module) of uses, those within a module too."""
    p = relational.placed(state.deps.where("kind = 'uses'").select("dependee", "dependency"), state.fragments)
    return p.where("dependee <> dependency")


def edges_of(uses: DataFrame) -> DataFrame:
    return uses.where("from_module <> to_module").select(F.col("from_module").alias("src"), F.col("to_module").alias("dst")).distinct()


def moved_uses(uses: DataFrame, moves: DataFrame) -> DataFrame:
    """placed_uses after moves(file, new_module)."""
    a, b = moves.toDF("dependee", "new_from"), moves.toDF("dependency", "new_to")
    both = uses.join(a, "dependee", "left").join(b, "dependency", "left")
    return both.select("dependee", "dependency", F.coalesce("new_from", "from_module").alias("from_module"), F.coalesce("new_to", "to_module").alias("to_module"))


def on_cycles(uses: DataFrame) -> DataFrame:
    """placed_uses between or within modules that are on a cycle.

    Files move to new modules only, so a cycle to come runs through modules that are on one now: the others are
    done with for good.
    """
    of = cut(graphs.strong_components(edges_of(uses)))
    a, b = of.select(F.col("node").alias("from_module"), F.col("component").alias("c")), of.select(F.col("node").alias("to_module"), F.col("component").alias("d"))
    return uses.join(a, "from_module").join(b, "to_module").where("c = d").select("dependee", "dependency", "from_module", "to_module")


def plan_moves(cycles: DataFrame, uses: DataFrame, alone: bool = False) -> DataFrame:
    """(rank, file, new_module): what each of cycles(cycle_id, cycle) needs moved, from placed uses.

    A cycle of which no file may move is an error that names it; with `alone` its cut files become modules of their
    own instead.
    """
    place = uses.select(F.col("dependee").alias("file"), F.col("from_module").alias("module")).union(uses.select("dependency", "to_module")).distinct()
    flow = graphs.flow_edges(cycles, uses, place)
    plans = cut(kernels.move_plans(flow))
    stuck = cycles.select("cycle_id").join(plans, "cycle_id", "left_anti")
    if not empty(stuck):
        if not alone:
            raise ValueError(f"no file may move to break the cycles {', '.join(repr(r[0]) for r in stuck.orderBy('cycle_id').limit(5).collect())}")
        heads = kernels.cut_edges(flow.join(stuck, "cycle_id", "left_semi")).select("cycle_id", F.col("dependency").alias("file")).distinct()
        plans = cut(plans.unionByName(heads.withColumn("new_module", module_name(F.array("file")))))
    return plans.withColumnRenamed("cycle_id", "rank")


@register
def split(state: State, threshold: int = 8, most_rounds: int = 1000, alone: bool = False) -> State:
    """Files move to new modules until no import cycle is left.

    The uses with the modules of their ends are kept up to date by each round's moves. When no two modules
    use each other, what lies on no cycle leaves them for good, so later rounds search only what is left.
    Of a round's cycles the driver gets how often the commonest of them came before, not the cycles. The same cycle
    more than `threshold` times among the last threshold ** 3 means that the search runs in circles.
    """
    uses, fragments = stored(placed_uses(state)), stored(state.fragments)
    seen, ordered, modules = None, 0, None
    for n_round in range(most_rounds):
        cycles = stored(distinct_cycles(graphs.mutual_cycles(edges_of(uses))))
        if empty(cycles):
            uses = stored(on_cycles(uses))
            cycles = stored(distinct_cycles(graphs.shortest_cycles(edges_of(uses))))
        if empty(cycles):
            return dataclasses.replace(state, fragments=cut(canonical_names(fragments)))
        now = fragments.select("module").distinct().count()
        ranked = cycles.select("cycle_id", F.lit(n_round).alias("round"))
        seen = stored(ranked if now != modules else last_of(seen.unionByName(ranked), threshold**3))
        modules = now
        top = seen.groupBy("cycle_id").count().orderBy(F.desc("count"), "cycle_id").first()
        if top["count"] > threshold:
            raise RecursionError(f"the cycle {top['cycle_id']} comes again and again")
        moves = stored(relational.merged_moves(plan_moves(cycles, uses, alone)))
        fragments = stored(relational.apply_moves(fragments, moves))
        uses = stored(moved_uses(uses, moves))
    raise RecursionError(f"cycles are left after {most_rounds} rounds")


def last_of(seen: DataFrame, most: int) -> DataFrame:
    """The last `most` of seen(cycle_id, round), in order of round and name."""
    return seen.orderBy(F.desc("round"), F.desc("cycle_id")).limit(most)


@register
def move_implementers(state: State, headers: str = HEADERS) -> State:
    """Files go to the module of the header that they implement."""
    moves = relational.implementation_moves(state.deps, state.fragments, headers)
    return dataclasses.replace(state, fragments=cut(relational.apply_moves(state.fragments, moves)))


def fold_once(state: State) -> dict[str, str]:
    """Module → module merges of one round; what comes to the driver is an edge a shortest cycle."""
    found = cut(graphs.shortest_cycles(module_edges(state)).select(F.col("node").alias("cycle_id"), "cycle"))
    top = relational.strongest_edges(found, relational.coupling(state.deps, state.fragments))
    return kernels.fold([(r["module"], r["dependency"]) for r in top.orderBy("cycle_id").collect()])


def merged(fragments: DataFrame, into: dict[str, str]) -> DataFrame:
    """Fragments after modules merged; a chain of merges is followed to its end."""
    end = {}
    for m in into:
        t = m
        while t in into:
            t = into[t]
        end[m] = t
    plan = fragments.sparkSession.createDataFrame(sorted(end.items()), "module string, target string")
    return fragments.join(plan, "module", "left").select(F.coalesce("target", "module").alias("module"), "file")


@register
def merge(state: State) -> State:
    """Modules of a cycle merge until no import cycle is left.

    A merge along a cycle leaves its strong component strongly connected, and a component of several modules has a
    cycle; so whatever is folded first, in the end each component is one module. It is found and joined at once;
    fold_once gives the plan of a single round.
    """
    of = graphs.strong_components(module_edges(state)).toDF("module", "component")
    joined = state.fragments.join(of, "module", "left").select(F.coalesce("component", "module").alias("module"), "file")
    return dataclasses.replace(state, fragments=stored(canonical_names(stored(joined))))


@register
def join_forward_declared(state: State) -> State:
    """Modules joined by forward declarations become one."""
    if state.forwards is None or state.definitions is None:
        return state
    many = state.fragments.join(state.forwards.select("file"), "file", "left_semi").groupBy("file").agg(F.countDistinct("module").alias("n")).where("n > 1").limit(5).collect()
    if many:
        raise ValueError(f"in several modules: {', '.join(r[0] for r in many)}")
    links = relational.forward_links(state.forwards, state.definitions, state.fragments)
    of = graphs.components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    joined = state.fragments.join(of, state.fragments["module"] == of["node"], "left").select(F.coalesce("component", "module").alias("module"), "file")
    return dataclasses.replace(state, fragments=cut(canonical_names(cut(joined))))


@register
def random_modules(state: State, buckets: int = 8, seed: int = 1) -> State:
    """Modules put together at random, to hold a module structure against; it has no place in the order."""
    return dataclasses.replace(state, fragments=cut(relational.random_modules(state.fragments, buckets, seed)))


#: The order matters: the split sees header dependencies only, the merge sees all.
ORDER = ("unique_files", "check_implementations", "split", "move_implementers", "merge", "join_forward_declared")


def run(state: State, more_deps: DataFrame | None = None, **options: object) -> State:
    """All passes in order; more_deps (of sources) join after the implementers moved."""
    for name in ORDER:
        state = run_pass(name, state, **options)
        if name == "move_implementers" and more_deps is not None:
            state = dataclasses.replace(state, deps=cut(state.deps.unionByName(more_deps).distinct()))
    return state


def timings(state: State, spark: object) -> DataFrame:
    """(pass, seconds, total)."""
    rows = [(n, b - a) for n, a, b in state.timings]
    return spark.createDataFrame([(n, s, sum(x for _, x in rows)) for n, s in rows], "pass string, seconds double, total double")
