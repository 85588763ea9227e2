"""Relational operators on the flat model.

fragments(module, file): which file is in which module.
deps(dependee, dependency, kind): which file uses or implements which; kind is 'uses' or 'implements'.
Modules of a dependency are always derived by joining fragments, never stored.
"""

from __future__ import annotations

from itertools import accumulate
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .loops import cut

KINDS = ("uses", "implements")


def checked_kinds(deps: DataFrame) -> DataFrame:
    """deps; a row of another kind is an error when it is read."""
    bad = ~F.col("kind").isin(*KINDS)
    return deps.withColumn("kind", F.when(bad, F.raise_error(F.concat(F.lit("unknown kind: "), F.col("kind"))).cast("string")).otherwise(F.col("kind")))


def partition(df: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that fail, rows that meet the predicate; null fails."""
    p = F.coalesce(predicate, F.lit(False))
    return df.where(~p), df.where(p)


def modules_of(files: DataFrame, fragments: DataFrame) -> DataFrame:
    return files.join(fragments, "file")


def modules_with(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """(module, files): the given files of each module, sorted."""
    return fragments.join(files, "file", "left_semi").groupBy("module").agg(F.sort_array(F.collect_set("file")).alias("files"))


def placed(deps: DataFrame, fragments: DataFrame) -> DataFrame:
    """deps with the modules of both ends (from_module, to_module); rows with an end in no module go."""
    a = fragments.select(F.col("file").alias("dependee"), F.col("module").alias("from_module"))
    b = fragments.select(F.col("file").alias("dependency"), F.col("module").alias("to_module"))
    return deps.distinct().join(a, "dependee").join(b, "dependency")


def rejected(deps: DataFrame, fragments: DataFrame) -> DataFrame:
    """Distinct dependencies of which an end is in no module, and which ends are missing."""
    files = fragments.select("file").distinct()
    a = files.select(F.col("file").alias("dependee"), F.lit(True).alias("has_dependee"))
    b = files.select(F.col("file").alias("dependency"), F.lit(True).alias("has_dependency"))
    both = deps.distinct().join(a, "dependee", "left").join(b, "dependency", "left")
    both = both.withColumns({"no_dependee": F.col("has_dependee").isNull(), "no_dependency": F.col("has_dependency").isNull()})
    return both.where("no_dependee or no_dependency").select("dependee", "dependency", "kind", "no_dependee", "no_dependency")


def dependees(deps: DataFrame, file: str) -> DataFrame:
    return deps.where(F.col("dependency") == file).select(F.col("dependee").alias("file"), "kind").distinct()


def dependencies(deps: DataFrame, file: str) -> DataFrame:
    return deps.where(F.col("dependee") == file).select(F.col("dependency").alias("file"), "kind").distinct()


def between(deps: DataFrame, fragments: DataFrame, a: str, b: str) -> DataFrame:
    """The dependencies of files in module a on files in module b."""
    return placed(deps, fragments).where((F.col("from_module") == a) & (F.col("to_module") == b)).select("dependee", "dependency", "kind")


def inside(deps: DataFrame, fragments: DataFrame) -> DataFrame:
    """The dependencies within a module."""
    return placed(deps, fragments).where("from_module = to_module").select(F.col("from_module").alias("module"), "dependee", "dependency", "kind")


def imports(deps: DataFrame, fragments: DataFrame) -> DataFrame:
    """(module, dependency): modules of which a file uses a file of another."""
    p = placed(deps.where("kind = 'uses'"), fragments).where("from_module <> to_module")
    return p.select(F.col("from_module").alias("module"), F.col("to_module").alias("dependency")).distinct()


def coupling(deps: DataFrame, fragments: DataFrame) -> DataFrame:
    """(module, dependency, strength): how many (file, file, kind) lead from module to module."""
    p = placed(deps, fragments).where("from_module <> to_module")
    return p.groupBy(F.col("from_module").alias("module"), F.col("to_module").alias("dependency")).agg(F.count("*").alias("strength"))


def relative_couplings(strengths: DataFrame) -> DataFrame:
    """Strengths with their relative strength and drawing width; the extremes are one row, broadcast."""
    from ..functions.text import edge_width, relative_strength

    ends = strengths.agg(F.min("strength").alias("least"), F.max("strength").alias("most"))
    r = relative_strength(F.col("strength"), F.col("least"), F.col("most"))
    return strengths.crossJoin(F.broadcast(ends)).withColumn("relative", r).withColumn("width", edge_width(F.col("relative"))).drop("least", "most")


def module_sizes(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("module").agg(F.count("*").alias("files"))


def unique_fragments(fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fragments of files that are in one place only, and the files that are in more (with how many)."""
    many = fragments.groupBy("file").agg(F.count("*").alias("n")).where("n <> 1")
    return fragments.join(many, "file", "left_anti"), many


def degrees(edges: DataFrame, src: str = "dependee", dst: str = "dependency") -> DataFrame:
    """(file, out_degree, in_degree) over distinct edges: one aggregation of both ends, no outer join."""
    e = edges.select(src, dst).distinct()
    ends = e.select(F.explode(F.array(F.struct(F.col(src).alias("file"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col(dst).alias("file"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.file").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return nodes.join(ends, "node", "left_anti")


def insanity(deps: DataFrame, fragments: DataFrame) -> DataFrame:
    """(file, module, implementers): files that files of several modules implement."""
    impl = deps.where("kind = 'implements'").select("dependee", F.col("dependency").alias("file")).distinct()
    p = impl.join(fragments.withColumnRenamed("file", "dependee"), "dependee")
    many = p.groupBy("file").agg(F.countDistinct("module").alias("n")).where("n > 1").select("file")
    return p.join(many, "file", "left_semi").groupBy("file", "module").agg(F.sort_array(F.collect_set("dependee")).alias("implementers"))


def ambiguous_symbols(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("symbol").agg(F.countDistinct("file").alias("files")).where("files > 1")


def forward_links(forwards: DataFrame, definitions: DataFrame, fragments: DataFrame) -> DataFrame:
    """(a, b): modules to be joined, as a file of one declares what a file of the other defines.

    Symbols defined in several modules are skipped, and files of no module or of several.
    """
    own, _ = unique_fragments(fragments.distinct())
    defs = definitions.select("symbol", "file").distinct().join(own, "file").groupBy("symbol").agg(F.min("module").alias("b"), F.max("module").alias("other")).where("b = other").select("symbol", "b")
    decl = forwards.select("symbol", "file").distinct().join(own, "file").select("symbol", F.col("module").alias("a")).distinct()
    return decl.join(defs, "symbol").where("a <> b").select("a", "b").distinct()


def implementation_moves(deps: DataFrame, fragments: DataFrame, headers: str) -> DataFrame:
    """(file, new_module): implementers that are in another module than the header they implement go to it.

    If a file implements headers of several modules the last module in order is taken.
    """
    p = placed(deps.where("kind = 'implements'"), fragments).where(F.col("dependency").rlike(headers) & (F.col("from_module") != F.col("to_module")))
    return p.groupBy(F.col("dependee").alias("file")).agg(F.max("to_module").alias("new_module"))


def merged_moves(moves: DataFrame) -> DataFrame:
    """(file, new_module) of moves(rank, file, new_module): the plan of the highest rank wins."""
    return moves.groupBy("file").agg(F.max_by("new_module", "rank").alias("new_module"))


def apply_moves(fragments: DataFrame, moves: DataFrame) -> DataFrame:
    """Fragments after files moved; dependencies need no change, as their modules are derived."""
    return fragments.join(moves, "file", "left").select(F.coalesce("new_module", "module").alias("module"), "file")


def rename_rows(replacements: DataFrame, bindings: DataFrame) -> DataFrame:
    """(line, col, from_str, to_str): bound replacements; of several at one place the first counts, of several bindings of one id too."""
    first = bindings.groupBy("binding_id").agg(F.min_by(F.struct("from_str", "to_str"), "seq").alias("b")).select("binding_id", "b.*")
    one = replacements.groupBy("file", "line", "col").agg(F.min_by(F.struct("binding_id", "what"), "seq").alias("r")).select("file", "line", "col", "r.*")
    return one.join(first, "binding_id").select("file", "line", "col", F.col("what").alias("from_str"), "to_str")


def resolved_includes(includes: DataFrame, known: DataFrame, paths: list[str]) -> DataFrame:
    """includes(file, line, target) with `resolved` (null if not found).

    Candidates are the target as it is, beside the file, then under each include path; the first that
    is known counts. known: (file) distinct.
    """
    from ..functions.text import folder, join_path

    tries = [F.col("target"), F.concat(folder(F.col("file")), F.when(folder(F.col("file")) == "", "").otherwise("/"), F.col("target"))]
    tries += [join_path(F.lit(p), F.col("target")) for p in paths]
    keyed = includes.select("file", "line", "target").distinct()
    c = keyed.select("file", "line", "target", F.posexplode(F.array(*tries)).alias("priority", "candidate"))
    hit = c.join(known.select(F.col("file").alias("candidate")).distinct(), "candidate")
    best = hit.groupBy("file", "line", "target").agg(F.min_by("candidate", "priority").alias("resolved"))
    return keyed.join(best, ["file", "line", "target"], "left")


def kept_lines(lines: DataFrame, removed: DataFrame) -> DataFrame:
    """Source text after lines went: lines(file, pos, line) without removed(file, pos)."""
    return lines.join(removed.select("file", "pos").distinct(), ["file", "pos"], "left_anti")


def numbered_lines(texts: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """(key, pos, line), lines numbered from 0."""
    return texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))


def cutting_edges(edges: DataFrame, sides: DataFrame) -> DataFrame:
    """Edges (src, dst) whose ends are on different sides(node, side)."""
    a = sides.select(F.col("node").alias("src"), F.col("side").alias("src_side"))
    b = sides.select(F.col("node").alias("dst"), F.col("side").alias("dst_side"))
    return edges.join(a, "src").join(b, "dst").where("src_side <> dst_side").select("src", "dst", "src_side", "dst_side")


def strongest_edges(cycles: DataFrame, strengths: DataFrame) -> DataFrame:
    """(cycle_id, module, dependency, strength): of each closed cycle(cycle_id, cycle) its strongest edge, the first of equals."""
    pairs = cycles.select("cycle_id", F.posexplode(F.arrays_zip(F.slice("cycle", F.lit(1), F.size("cycle") - 1).alias("a"), F.slice("cycle", F.lit(2), F.size("cycle") - 1).alias("b"))).alias("pos", "e"))
    edges = pairs.select("cycle_id", "pos", F.col("e.a").alias("module"), F.col("e.b").alias("dependency"))
    s = edges.join(strengths, ["module", "dependency"], "left").withColumn("strength", F.coalesce("strength", F.lit(0)))
    top = s.groupBy("cycle_id").agg(F.max_by(F.struct("module", "dependency", "strength"), F.struct("strength", -F.col("pos"))).alias("t"))
    return top.select("cycle_id", "t.*")


def first_seen(rows: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Distinct values with the order of their first row."""
    return rows.groupBy(value).agg(F.min(F.struct(*order)).alias("f")).select(value, "f.*")


def inclusions(entries: DataFrame) -> DataFrame:
    """(header, n): in how many entries a header is. entries(entry, file, header); the file itself does not count."""
    return entries.where("header <> file").select("entry", "header").distinct().groupBy("header").agg(F.count("*").alias("n"))


def includes_of_units(entries: DataFrame) -> DataFrame:
    """(file, n): distinct headers of each of a file's entries, summed; 0 for files without."""
    h = F.when(F.col("header") != F.col("file"), F.col("header"))
    return entries.groupBy("entry", "file").agg(F.countDistinct(h).alias("n")).groupBy("file").agg(F.sum("n").alias("n"))


def compilations(entries: DataFrame) -> DataFrame:
    return entries.select("entry", "file").distinct().groupBy("file").agg(F.count("*").alias("n"))


def status_totals(commands: DataFrame, file: str = "file", ok: str = "ok") -> DataFrame:
    """One row: how many commands there are, and how many succeeded, failed and were skipped as not compiled."""
    from ..functions.text import NOT_COMPILED

    skip = F.col(file).rlike(NOT_COMPILED)
    return commands.agg(F.count("*").alias("total"), F.count_if(~skip & F.col(ok)).alias("success"), F.count_if(~skip & ~F.col(ok)).alias("failed"), F.count_if(skip).alias("skipped"))


def bucket_plan(modules: DataFrame, buckets: int) -> DataFrame:
    """One row: the average of modules in a bucket, the expected deviation, the excess allowed (halves go to even)."""
    avg = F.bround(F.count("*") / F.lit(buckets))
    return modules.agg(avg.alias("average")).withColumn("deviation", F.bround(F.sqrt(F.col("average") * F.col("average") / 12))).withColumn("overflow", F.bround(F.col("deviation") / 2)).select(*[F.col(c).cast("long").alias(c) for c in ("average", "deviation", "overflow")])


#: Parts of a bucket that are ranked on their own.
PARTS = 1024


def random_buckets(modules: DataFrame, buckets: int, seed: int) -> DataFrame:
    """(module, bucket): each module in a bucket at random; what exceeds a bucket's limit, chosen at random, goes to
    buckets that did not exceed it, of which none gets more than one over the limit.

    Numbers are digests of seed and name, so a lost task draws them again alike. If there is too little room for all
    that is over, the rest goes around once more; if every bucket is over, it stays. A module's rank in its bucket is
    its rank in its part of it and the sizes of the parts before, so no bucket is sorted in one place. What comes to
    the driver is a number a bucket.
    """
    draw = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/{salt}/"), F.col("module"))), 1, 12), 16, 10).cast("long")
    drawn = modules.select("module").distinct().select("module", F.pmod(draw("bucket"), F.lit(buckets)).cast("int").alias("bucket"), draw("trim").alias("trim"))
    drawn = cut(drawn.withColumn("part", F.shiftright("trim", 48 - (PARTS - 1).bit_length())))
    parts = cut(drawn.groupBy("bucket", "part").agg(F.count("*").alias("n")))
    sizes = {r["bucket"]: r["n"] for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    plan = bucket_plan(drawn, buckets).first()
    most = (plan["average"] or 0) + (plan["overflow"] or 0)
    room = [(b, most + 1 - sizes.get(b, 0)) for b in range(buckets) if sizes.get(b, 0) <= most]
    if not room:
        return drawn.select("module", "bucket")
    before = F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = drawn.join(parts.select("bucket", "part", before.alias("before")), ["bucket", "part"])
    ranked = ranked.withColumn("r", F.col("before") + F.row_number().over(W.partitionBy("bucket", "part").orderBy("trim", "module")))
    over = list(accumulate((max(0, sizes.get(b, 0) - most) for b in range(buckets)), initial=0))
    ends = list(accumulate(n for _, n in room))
    number = F.element_at(F.array(*map(F.lit, over)), F.col("bucket") + 1) + F.col("r") - most - 1
    slot = F.pmod(F.pmod(number, F.lit(ends[-1])) * F.lit(stride(ends[-1])), F.lit(ends[-1]))
    to = F.element_at(F.array(*[F.lit(b) for b, _ in room]), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= slot)) + 1)
    return ranked.select("module", F.when(F.col("r") > most, to).otherwise(F.col("bucket")).alias("bucket"))


def stride(n: int) -> int:
    """About 0.6 of n, or the next number without a divisor in common with it: its multiples modulo n come to each place once."""
    at = max(1, round(0.618 * n))
    while gcd(at, n) > 1:
        at += 1
    return at


def random_modules(fragments: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Fragments with the modules of a bucket as one, named by its number; see random_buckets."""
    to = random_buckets(fragments, buckets, seed).select("module", F.concat(F.lit("RandomModule_"), F.col("bucket").cast("string")).alias("name"))
    return fragments.join(to, "module").select(F.col("name").alias("module"), "file").distinct()


def module_list(fragments: DataFrame, imported: DataFrame) -> DataFrame:
    """(section, module, line): build directives, modules first, then their dependencies; to be written in this order."""
    mods = fragments.select("module").distinct()
    a = mods.select(F.lit(1).alias("section"), "module", F.concat(F.lit("set_module("), "module", F.lit(")")).alias("line"))
    b = imported.select(F.lit(2).alias("section"), "module", F.concat(F.lit("set_module_dependency("), "module", F.lit(" "), "dependency", F.lit(")")).alias("line"))
    return a.unionByName(b)


def empty_like(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], T.StructType(df.schema.fields))


def has_item(fragments: DataFrame, deps: DataFrame, item: str) -> DataFrame:
    """One row: whether item is a module or a file with a dependency, by equality."""
    names = fragments.select(F.col("module").alias("name")).union(deps.select("dependee"))
    return names.agg(F.coalesce(F.bool_or(F.col("name") == item), F.lit(False)).alias("known"))


def known_files(definitions: DataFrame, forwards: DataFrame) -> DataFrame:
    """Files of which any symbol is known."""
    return definitions.select("file").union(forwards.select("file")).distinct()


def without_rows(all_rows: DataFrame, some: DataFrame, key: str) -> DataFrame:
    """Set difference by a key."""
    return all_rows.join(some.select(key).distinct(), key, "left_anti")
