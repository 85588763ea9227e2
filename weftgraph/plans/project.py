"""A project's folder as input and output: the passes about files, and the run from one end to the other.

Running the compiler's analyser is not part of it; its fact files lie in the folder, beside sources,
module files and the compilation database.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import commands, text as fn
from ..operators import graphs, relational
from ..operators.loops import cut, empty
from ..sources import readers, writers
from . import passes
from .model import State, register, run_pass


@dataclasses.dataclass(frozen=True)
class Project(State):
    """Besides the facts: lines(file, pos, line) of the sources, renames, removed(file, pos) lines, include edges
    (src, dst) outside of the modules, and what is to be written."""

    folder: str = ""
    lines: DataFrame | None = None
    include_paths: tuple[str, ...] = ()
    renames: DataFrame | None = None
    removed: DataFrame | None = None
    external: DataFrame | None = None
    module_texts: DataFrame | None = None
    cyclic_files: DataFrame | None = None
    directives: DataFrame | None = None


def _session(state: State) -> SparkSession:
    return state.fragments.sparkSession


@register
def parse_include_paths(state: Project, database: str | None = None) -> Project:
    """Include paths of all commands, each once, in the order first seen; they are few and come to the driver."""
    if database is None:
        return state
    entries = readers.compilation_database(_session(state), database).withColumn("entry", F.monotonically_increasing_id())
    words = entries.withColumn("split", commands.shell_words(F.col("command"))).withColumn("words", F.coalesce("arguments", "split"))
    paths = words.select("entry", F.posexplode(commands.search_paths(F.col("words"))).alias("at", "path"))
    first = relational.first_seen(paths, "path", ["entry", "at"]).orderBy("entry", "at")
    return dataclasses.replace(state, include_paths=tuple(r["path"] for r in first.collect()))


@register
def load_modules(state: Project) -> Project:
    """The module files' fragments; files of several modules leave all of them."""
    parts, _ = readers.module_files(_session(state), state.folder)
    return dataclasses.replace(state, fragments=cut(parts.select("module", "file")))


@register
def load_implements(state: Project) -> Project:
    """Implements edges whose ends are in modules; an error if files of several modules implement one file."""
    rows, _ = readers.implements(_session(state), state.folder)
    known = relational.placed(readers.implements_deps(rows), state.fragments).select("dependee", "dependency", "kind")
    return passes.check_implementations(dataclasses.replace(state, deps=cut(state.deps.unionByName(known).distinct())))


@register
def load_symbols(state: Project) -> Project:
    spark = _session(state)
    symbols = lambda rows: cut(rows[0].select("file", "symbol").distinct())
    return dataclasses.replace(state, definitions=symbols(readers.definitions(spark, state.folder)), forwards=symbols(readers.forward_declarations(spark, state.folder)))


@register
def fetch_includes(state: Project, matching: str = fn.HEADERS) -> Project:
    """Includes of matching files that resolve to files of modules become uses, and their lines go.

    Where a file has other includes too, these begin a descent through the files of the folder; its edges
    order files of a module that depend on each other only through files of none.
    """
    mine = state.fragments.select("file").where(F.col("file").rlike(matching))
    lines = state.lines.join(mine, "file", "left_semi").withColumn("target", fn.include_target(F.col("line"))).where("target is not null")
    found = relational.resolved_includes(lines.select("file", F.col("pos").alias("line"), "target"), state.fragments.select("file"), list(state.include_paths))
    found = cut(found.withColumnRenamed("line", "pos"))
    hit = found.where("resolved is not null")
    deps = hit.select(F.col("file").alias("dependee"), F.col("resolved").alias("dependency"), F.lit("uses").alias("kind")).where("dependee <> dependency")
    others = found.where("resolved is null").join(hit.select("file").distinct(), "file", "left_semi")
    listing = state.lines.select("file").distinct()
    roots = cut(others.select(F.col("file").alias("src"), F.col("target").alias("dst")).join(listing.withColumnRenamed("file", "dst"), "dst", "left_semi").distinct())
    parsed = state.lines.where("startswith(line, '#include ')").select(F.col("file").alias("src"), fn.include_target(F.col("line")).alias("dst"))
    parsed = parsed.join(listing.withColumnRenamed("file", "dst"), "dst", "left_semi").select("src", "dst")
    below = graphs.include_closure(roots.select(F.col("dst").alias("node")), parsed)
    external = cut(state.external.unionByName(roots.select("src", "dst")).unionByName(below).distinct())
    removed = cut(state.removed.unionByName(hit.select("file", "pos")).distinct())
    return dataclasses.replace(state, deps=cut(state.deps.unionByName(deps).distinct()), removed=removed, external=external)


@register
def rename_symbols(state: Project) -> Project:
    """Names that would clash are replaced in the sources, from right to left, each only where it stands."""
    renames, _ = readers.renames(_session(state), state.folder)
    return dataclasses.replace(state, renames=renames, lines=cut(writers.renamed_lines(state.lines, renames)))


def through_external(external: DataFrame, fragments: DataFrame) -> DataFrame:
    """(src, dst): files of modules of which one leads to the other through files of no module only.

    Files of no module that lead to each other are one node. What a node leads to is found once, from the ends
    back, whatever number of files begin at it; these only meet the first node on their way in the last join.
    """
    inside = cut(fragments.select(F.col("file").alias("node")).distinct())
    known = lambda end: inside.select(F.col("node").alias(end), F.lit(True).alias(f"{end}_in"))
    edges = external.select("src", "dst").distinct().join(known("src"), "src", "left").join(known("dst"), "dst", "left")
    edges = cut(edges.select("src", "dst", F.col("src_in").isNotNull().alias("src_in"), F.col("dst_in").isNotNull().alias("dst_in")))
    outer = edges.where("not src_in and not dst_in").select("src", "dst")
    of = cut(graphs.strong_components(outer))

    def joined(df: DataFrame, end: str) -> DataFrame:
        return df.join(of.select(F.col("node").alias(end), F.col("component").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")

    way = cut(joined(joined(outer, "src"), "dst").where("src <> dst").distinct())
    front = cut(joined(edges.where("not src_in and dst_in").select("src", "dst"), "src").select(F.col("src").alias("node"), F.col("dst").alias("file")).distinct())
    seen = front
    while not empty(front):
        step = way.join(front.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "file").distinct()
        front = cut(step.join(seen, ["node", "file"], "left_anti"))
        seen = seen.unionByName(front)
    starts = joined(edges.where("src_in and not dst_in").select("src", "dst"), "dst").distinct()
    far = starts.join(seen.select(F.col("node").alias("dst"), "file"), "dst").select("src", F.col("file").alias("dst"))
    return far.unionByName(edges.where("src_in and dst_in").select("src", "dst")).where("src <> dst").distinct()


@register
def write_modules(state: Project, headers: str = fn.HEADERS) -> Project:
    """Module texts with their headers in an order in which what a file depends on comes first; files on a cycle come
    last and keep their lines, as nothing orders them. Other files follow as they are."""
    place = state.fragments
    uses = relational.inside(state.deps.where("kind = 'uses'"), place).select(F.col("dependee").alias("src"), F.col("dependency").alias("dst"))
    far = through_external(graphs.without_external_cycles(state.external, place), place)
    module = lambda end: place.select(F.col("file").alias(end), F.col("module").alias(f"{end}_module"))
    far = far.join(module("src"), "src").join(module("dst"), "dst").where("src_module = dst_module").select("src", "dst")
    edges = cut(uses.unionByName(far).where(F.col("src").rlike(headers) & F.col("dst").rlike(headers) & (F.col("src") != F.col("dst"))).distinct())
    heads = place.where(F.col("file").rlike(headers)).select(F.col("file").alias("node"))
    order = cut(graphs.topological_order(heads, edges))
    rest = place.where(~F.col("file").rlike(headers)).select(F.col("file").alias("node"), F.lit(None).cast("int").alias("layer"), F.lit(None).cast("boolean").alias("cyclic"))
    ranked = order.unionByName(rest).withColumnRenamed("node", "file").join(place, "file")
    by_rank = F.array_sort(F.collect_list(F.struct(F.col("cyclic").isNull().alias("other"), "cyclic", "layer", "file")))
    parts = ranked.groupBy("module").agg(by_rank.alias("l")).select("module", F.transform("l", lambda x: fn.include_directive(x["file"])).alias("inc"))
    imports = relational.imports(state.deps, place).groupBy("module").agg(F.sort_array(F.collect_set(fn.module_import(F.col("dependency")))).alias("imp"))
    lines = F.concat(F.array(fn.module_declaration(F.col("module"))), F.coalesce("imp", F.array().cast("array<string>")), F.col("inc"))
    texts = parts.join(imports, "module", "left").select("module", F.array_join(lines, "\n").alias("text"))
    return dataclasses.replace(state, module_texts=cut(texts), cyclic_files=cut(order.where("cyclic").select(F.col("node").alias("file"))))


@register
def remove_lines(state: Project) -> Project:
    """Lines that became imports go, but for files that could not be put in order."""
    gone = state.removed.join(state.cyclic_files, "file", "left_anti") if state.cyclic_files is not None else state.removed
    return dataclasses.replace(state, lines=cut(relational.kept_lines(state.lines, gone)))


@register
def emit_directives(state: Project) -> Project:
    return dataclasses.replace(state, directives=relational.module_list(state.fragments, relational.imports(state.deps, state.fragments)))


#: The sources' includes come after the split, which sees the headers' only. What follows `merge` and the joins is output.
ORDER = ("parse_include_paths", "load_modules", "load_implements", "load_symbols", "fetch_includes", "split", "move_implementers", "fetch_source_includes", "merge", "join_forward_declared")
OUTPUT = ("rename_symbols", "write_modules", "remove_lines", "emit_directives")


@register
def fetch_source_includes(state: Project, sources: str = fn.SOURCES) -> Project:
    return fetch_includes(state, sources)


def opened(spark: SparkSession, folder: str, glob: str = "*.[chCH]*") -> Project:
    """A project before its first pass; of the folder's sources those that the glob matches, but no module files."""
    none = lambda schema: spark.createDataFrame([], schema)
    lines = readers.source_texts(spark, folder, glob).where("file not like '%cppm'")
    return Project(none("module string, file string"), none("dependee string, dependency string, kind string"), folder=folder, lines=cut(lines), removed=none("file string, pos int"), external=none("src string, dst string"))


def run(spark: SparkSession, folder: str, out: str | None = None, database: str | None = None, **options: object) -> Project:
    """All passes over a folder; without `out` nothing is written (a dry run)."""
    state = opened(spark, folder)
    for name in ORDER if out is None else ORDER + OUTPUT:
        state = run_pass(name, state, database=database, **options)
    if out is not None:
        writers.update_module_files(state.module_texts, f"{out}/modules")
        writers.texts_of(state.lines).write.mode("overwrite").json(f"{out}/sources")
        writers.write_module_list(state.directives, f"{out}/module-list")
    return state


def cached(spark: SparkSession, path: str, make: object, again: bool = False) -> DataFrame:
    """A table of facts that is made and written once; later runs read it, unless they want it made again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    done = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    if again or not done:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
