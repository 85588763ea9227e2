"""Declarations as facts: which are internal to a unit, problematic, implemented, forward or definitions.

decls(kind, linkage, in_main_file, parent_kind, is_inline, is_definition, is_method, is_ctor_dtor,
is_implicit, is_system, name, file, begin_line, begin_col, prev_file, prev_is_system, def_file).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .loops import cut, empty

GLOBAL = "parent_kind IN ('unit', 'namespace')"
LOCAL = "(linkage <> 'external' AND in_main_file)"
EXTERNAL_HERE = "(linkage = 'external' AND in_main_file)"
INTERNAL_TRAITS, VISIBLE_TRAITS = f"({LOCAL} AND {GLOBAL})", f"({EXTERNAL_HERE} AND {GLOBAL})"
NAMED = "coalesce(name, '') <> ''"
#: Not a definition, or one whose definition or body is elsewhere.
FORWARD = "(NOT is_definition OR coalesce(def_file <> file, false))"


def _symbols(df: DataFrame) -> DataFrame:
    return df.select("file", "begin_line", "begin_col", "name", "kind")


def problematic(decls: DataFrame) -> DataFrame:
    """Declarations that would clash when units are put together; a destructor's place is past its tilde."""
    kinds = f"(kind IN ('function', 'variable', 'record', 'typedef') AND {INTERNAL_TRAITS})"
    inline = "(kind = 'function' AND is_inline AND in_main_file AND NOT is_method)"
    out = decls.where(f"({kinds} OR {inline}) AND NOT is_implicit AND (NOT is_method OR is_ctor_dtor) AND {NAMED} AND in_main_file")
    return _symbols(out.withColumn("begin_col", F.expr("begin_col + CAST(startswith(name, '~') AS INT)")))


def implemented(decls: DataFrame) -> DataFrame:
    """(header, symbol): what the unit defines and a header that is not a system's declared before."""
    d = decls.where(f"kind IN ('function', 'variable') AND {VISIBLE_TRAITS} AND prev_file <> file AND NOT coalesce(prev_is_system, false)")
    return d.select(F.col("prev_file").alias("header"), F.col("name").alias("symbol")).distinct()


def forwards(decls: DataFrame) -> DataFrame:
    here = "(kind = 'function' AND in_main_file AND coalesce(def_file = file, false))"
    return _symbols(decls.where(f"kind IN ('function', 'variable', 'record') AND {GLOBAL} AND {FORWARD} AND NOT is_system AND {NAMED} AND NOT {here}"))


def definitions(decls: DataFrame) -> DataFrame:
    return _symbols(decls.where(f"linkage = 'external' AND {GLOBAL} AND NOT {FORWARD} AND kind <> 'field' AND NOT is_method AND NOT is_system AND {NAMED}"))


#: Declarations of one name that one window orders, by seq.
STRETCH = 1 << 16


def with_previous(decls: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """decls(seq, ...) with prev_file and prev_is_system: of the declarations of the same kind and name that come
    earlier (seq, unique within a name) in another file the last one's; null if there is none.

    The last declaration in another file is the last one of the run of rows of one file before this run. A window
    finds it in one pass; rows of a name are cut into stretches of seq, each ordered on its own, and what comes
    before a stretch is known from the last two runs of the earlier ones, so a very common name is no single task.
    """
    d = decls.drop("prev_file", "prev_is_system")
    name = ["kind", "name"]
    rows = d.select(*name, "seq", "file", "is_system", F.floor(F.col("seq") / stretch).alias("stretch"))
    one = F.struct(F.col("file").alias("prev_file"), F.col("is_system").alias("prev_is_system"))
    inner = _runs(rows, [*name, "stretch"], one)
    # The last run of each stretch and what was before it in the stretch, one row each; then the same again over these.
    ends = cut(inner.groupBy(*name, "stretch").agg(F.max_by(F.struct("file", F.col("is_system"), "before"), "seq").alias("e")).select(*name, "stretch", "e.*"))
    pseudo = ends.select(*name, "stretch", F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.col("before.prev_file").alias("file"), F.col("before.prev_is_system").alias("is_system")), F.struct(F.lit(1).alias("nth"), "file", "is_system"))).alias("x"))
    pseudo = pseudo.select(*name, "stretch", "x.*").where("file is not null")
    known = _runs(pseudo.withColumn("seq", F.col("stretch") * 2 + F.col("nth")), name, one).where("nth = 1")
    w = Window.partitionBy(*name).orderBy("stretch")
    last = F.struct(F.col("file").alias("prev_file"), F.col("is_system").alias("prev_is_system"))
    carried = known.select(*name, "stretch", F.lag(last).over(w).alias("last"), F.lag("before").over(w).alias("other"))
    found = inner.join(cut(carried), [*name, "stretch"])
    # A row of a stretch's first run goes on from the run before the stretch, or is part of it.
    early = F.when(F.col("last.prev_file") != F.col("file"), F.col("last")).otherwise(F.col("other"))
    found = found.select(*name, "seq", "file", F.when(F.col("before").isNull(), early).otherwise(F.col("before")).alias("p")).select(*name, "seq", "file", "p.*")
    return d.join(found, [*name, "seq", "file"], "left")


def _runs(rows: DataFrame, by: list[str], one: Column) -> DataFrame:
    """rows with `before`: the last row, as `one`, of the run of another file before; null in the first run."""
    w = Window.partitionBy(*by).orderBy("seq")
    starts = F.lag("file").over(w) != F.col("file")
    marked = rows.withColumn("at_start", F.when(starts, F.lag(one).over(w)))
    return marked.withColumn("before", F.last("at_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("at_start")


def unwrapped(refs: DataFrame, aliases: DataFrame, rounds: int = 64) -> DataFrame:
    """refs with the name of an alias(name, target) replaced by what it stands for, through as many aliases as there are."""
    step = cut(aliases.select("name", "target").dropDuplicates(["name"]))
    for _ in range(rounds):
        if empty(refs.join(step, "name", "left_semi")):
            return refs
        refs = cut(refs.join(step, "name", "left").withColumn("name", F.coalesce("target", "name")).drop("target"))
    raise RecursionError("an alias stands for itself")


def usages(refs: DataFrame, decls: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """References(ref_line, ref_col, name) to declarations that are problematic. If refs has the file of what it
    refers to, a declaration of the same name elsewhere does not count; aliases(name, target) are followed."""
    keys = ["name", "file"] if "file" in refs.columns else ["name"]
    refs = unwrapped(refs, aliases) if aliases is not None else refs
    return refs.join(problematic(decls).select(*keys).distinct(), keys, "left_semi")


#: What a type is wrapped in besides aliases: qualifiers, elaborations, references, pointers, bounds of arrays.
_QUALIFIERS = r"\b(?:const|volatile|typename|struct|class|union|enum)\b"


def bare_type(name: Column) -> Column:
    """The name of the type that a written type is of, without qualifiers, references, pointers and bounds; that of a
    template is the template's, its arguments are references of their own."""
    plain = F.regexp_replace(F.regexp_replace(name, _QUALIFIERS, " "), r"<.*>|\[[^\]]*\]|[&*]", " ")
    return F.regexp_replace(F.trim(plain), r"\s+", " ")


def unwrapped_types(refs: DataFrame, aliases: DataFrame, rounds: int = 64) -> DataFrame:
    """refs(name, ...) with each written type's name taken out of what it is wrapped in, aliases(name, target) and other
    wrappers in turn, until neither changes it."""
    step = cut(aliases.select(bare_type(F.col("name")).alias("name"), bare_type(F.col("target")).alias("target")).where("name <> target").dropDuplicates(["name"]))
    return unwrapped(refs.withColumn("name", bare_type(F.col("name"))), step, rounds)


#: A scope lies in at most two bins of its own width, the least power of two of lines that is no less; widths up to 2 ** WIDEST.
WIDEST = 30


def resolved(refs: DataFrame, decls: DataFrame, scopes: DataFrame) -> DataFrame:
    """refs(file, name, ref_line, ...) each with the declaration that its name means: decl_scope, decl_line (null if none).

    decls(file, name, scope, decl_line) are visible in their scope of scopes(file, scope, first_line, last_line), ends
    included; of several the one of the innermost scope counts (the one that begins last, then ends first; of several
    in it the last line's). Scopes of a file are nested or apart.

    The lines are cut into bins of each width that some scope has; a declaration goes to the bins that its scope
    touches, two at most, a reference to one bin a width, and they meet by file, name, width and bin. So a name
    that is declared in very many scopes of a file meets the references near those scopes only.
    """
    size = F.col("last_line") - F.col("first_line") + 1
    width = F.ceil(F.log2(size.cast("double")) - 1e-9).cast("int")
    seen = decls.join(scopes.select("file", "scope", "first_line", "last_line"), ["file", "scope"]).where("last_line >= first_line").withColumn("width", F.least(width, F.lit(WIDEST)))
    bins = F.sequence(F.expr("shiftright(first_line, width)"), F.expr("shiftright(last_line, width)"))
    seen = seen.select("file", "name", F.col("scope").alias("decl_scope"), "decl_line", "first_line", "last_line", "width", F.explode(bins).alias("bin"))
    # Which widths a name has in a file: a reference looks into these only.
    widths = seen.groupBy("file", "name").agg(F.collect_set("width").alias("widths"))
    keyed = cut(refs.withColumn("ref", F.monotonically_increasing_id()))
    looks = keyed.select("ref", "file", "name", "ref_line").join(widths, ["file", "name"]).select("ref", "file", "name", "ref_line", F.explode("widths").alias("width"))
    met = looks.withColumn("bin", F.expr("shiftright(ref_line, width)")).join(seen, ["file", "name", "width", "bin"]).where("ref_line between first_line and last_line")
    best = met.groupBy("ref").agg(F.max_by(F.struct("decl_scope", "decl_line"), F.struct("first_line", -F.col("last_line"), "decl_line")).alias("d"))
    return keyed.join(best, "ref", "left").select(*refs.columns, F.col("d.decl_scope").alias("decl_scope"), F.col("d.decl_line").alias("decl_line"))


def scoped_usages(refs: DataFrame, decls: DataFrame, scopes: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """References whose name means, where it stands, a declaration that is problematic: a name that an inner scope
    declares anew does not count. decls as above the module's head, with a scope; aliases(name, target) are followed."""
    refs = unwrapped_types(refs, aliases) if aliases is not None else refs
    all_ = decls.select("file", "name", "scope", F.col("begin_line").alias("decl_line"))
    bad = problematic(decls).select("file", "name", F.col("begin_line").alias("decl_line")).distinct()
    meant = resolved(refs, all_.where(NAMED).distinct(), scopes).where("decl_line is not null")
    return meant.join(bad, ["file", "name", "decl_line"], "left_semi").select(*refs.columns, "decl_scope", "decl_line")
