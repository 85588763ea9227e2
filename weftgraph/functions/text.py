"""Column functions: include directives, names, paths, facts. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File kinds, suffixes of inputs that are not compiled, names of compilers.
HEADERS = r"\.(h|hh|hpp|hxx|H|inl)$"
SOURCES = r"\.(c|cc|cpp|cxx|C|c\+\+)$"
NOT_COMPILED = r"\.(o|so|a|lib|exe|dll|sys|out)$"
COMPILERS = "gcc:g++:clang:clang++:cc:c++"
#: What stands before a module's own name in its declaration.
NAME_MARK = "FULL_NAME_"


def include_target(line: Column) -> Column:
    """The file that a line includes; null unless `#include` begins the line."""
    rest = F.trim(F.regexp_replace(F.regexp_replace(line, "#include", ""), r"^\s+|\s+$", ""))
    return F.when(F.startswith(line, F.lit("#include")), F.regexp_replace(rest, '^["<]+|[">]+$', ""))


def include_directive(name: Column) -> Column:
    return F.concat(F.lit('#include "'), name, F.lit('"'))


def included_files(text: Column) -> Column:
    """Targets of the lines that begin with `#include` and a blank, in order."""
    return F.transform(F.filter(F.split(text, "\r?\n"), lambda x: F.startswith(x, F.lit("#include "))), include_target)


def strip_root(path: Column, root: Column | str) -> Column:
    """A path without its project's root, which is removed wherever it stands, and without leading slashes."""
    root = F.lit(root) if isinstance(root, str) else root
    return F.regexp_replace(F.replace(path, root, F.lit("")), "^/+", "")


def make_dependencies(text: Column) -> Column:
    """The paths of a compiler's Makefile rule for target __dummy."""
    flat = F.lit("")
    for old, new in (("__dummy: ", ""), ("\\", ""), ("  ", ""), (" ", "\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.filter(F.split(text, "\n"), lambda x: x != flat)


def is_compiler(command: Column, known: str = COMPILERS) -> Column:
    """Whether a command's program has the name of a known compiler in it."""
    return F.exists(F.array(*map(F.lit, known.split(":"))), lambda x: F.contains(command, x))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def join_path(a: Column, b: Column) -> Column:
    """b under a; b alone if a is empty or b is absolute."""
    return F.when((a == "") | F.startswith(b, F.lit("/")), b).otherwise(F.concat(F.regexp_replace(a, "/$", ""), F.lit("/"), b))


def file_kind(path: Column, headers: str = HEADERS, sources: str = SOURCES) -> Column:
    return F.when(path.rlike(headers), "header").when(path.rlike(sources), "source").otherwise("other")


def rename_prefix(path: Column) -> Column:
    """A file's stem as the beginning of an identifier."""
    s = F.regexp_replace(file_name(path), r"\.[^.]*$", "")
    return F.regexp_replace(F.regexp_replace(s, "^[0-9]", "_"), "[-.]", "_")


def rename_token(prefix: Column, name: Column) -> Column:
    return F.concat_ws("_", prefix, name)


def declared_module(line: Column) -> Column:
    """The module's name in a declaration's last part; null if it declares none."""
    name = F.regexp_extract(line, rf"^(?:export module )?{NAME_MARK}([\w\-]+);\s*$", 1)
    return F.when(name != "", name)


def module_declaration(name: Column) -> Column:
    return F.concat(F.lit(f"export module {NAME_MARK}"), name, F.lit(";"))


def module_import(name: Column) -> Column:
    return F.concat(F.lit("import "), name, F.lit(";"))


def module_name(files: Column, digits: int = 7) -> Column:
    """A name for a set of files: by the digest of the sorted names; of one file also its stem; null for none."""
    ordered = F.sort_array(files)
    return digest_name(F.md5(F.array_join(ordered, ",").cast("binary")), F.size(files), F.get(ordered, F.lit(0)), digits)


def digest_name(digest: Column, n: Column, first: Column, digits: int = 7) -> Column:
    """As module_name, of n files with this digest, the first of them in order."""
    name = F.concat(F.lit("Module_"), F.substring(digest, 1, digits))
    return F.when(n > 1, name).when(n == 1, F.concat(name, F.lit("_"), stem(first)))


def place(text: Column) -> Column:
    """`line:column` as a struct of numbers, null where it is neither."""
    p = F.split(text, ":")
    return F.struct(F.get(p, F.lit(0)).try_cast("int").alias("line"), F.get(p, F.lit(1)).try_cast("int").alias("col"))


def symbol_row(line: Column) -> Column:
    """`file##line:col##line:col##symbol` as a struct; null if malformed."""
    p = F.split(line, "##")
    a, b = place(F.get(p, F.lit(1))), place(F.get(p, F.lit(2)))
    ok = (F.size(p) == 4) & a["line"].isNotNull() & a["col"].isNotNull() & b["line"].isNotNull() & b["col"].isNotNull()
    row = F.struct(F.get(p, F.lit(0)).alias("file"), a["line"].alias("begin_line"), a["col"].alias("begin_col"), b["line"].alias("end_line"), b["col"].alias("end_col"), F.get(p, F.lit(3)).alias("symbol"))
    return F.when(ok, row)


def unnamed(name: Column, line: Column, col: Column) -> Column:
    """A declaration's name, or one made of its place."""
    return F.coalesce(F.nullif(name, F.lit("")), F.format_string("unnameable_decl_at__%d_%d", line, col))


def relative_strength(weight: Column, least: Column, most: Column) -> Column:
    """Where a weight lies between the least and the most; null if all are equal."""
    return (weight - least) / F.nullif(most - least, F.lit(0))


def edge_width(relative: Column) -> Column:
    return 1 + 3 * relative


def hosts(text: Column) -> Column:
    """`host:port/jobs,...` as an array of structs."""
    part = lambda h: F.struct(F.regexp_extract(h, r"^([^:/]*)", 1).alias("host"), F.regexp_extract(h, r":(\d+)", 1).try_cast("int").alias("port"), F.regexp_extract(h, r"/(\d+)", 1).try_cast("int").alias("jobs"))
    return F.transform(F.filter(F.split(text, r"\s*,\s*"), lambda h: h != ""), part)


def module_of_path(path: Column) -> Column:
    """A module name made of a path: no extension, separators and other signs as underscores."""
    return F.regexp_replace(F.regexp_replace(path, r"^\./|\.[^./]*$", ""), r"[^A-Za-z0-9_]", "_")


def percent(done: Column, total: Column) -> Column:
    return 100.0 * done / F.nullif(total, F.lit(0))


def replace_at(line: Column, col: Column, old: Column, new: Column) -> Column:
    """A line with `old` at the 1-based column replaced, only if it stands there."""
    at = F.substr(line, col, F.length(old)) == old
    return F.when(at, F.concat(F.substr(line, F.lit(1), col - 1), new, F.substr(line, col + F.length(old)))).otherwise(line)


def rotated(cycle: Column) -> Column:
    """A cycle turned so that its smallest name is first, its order kept."""
    at = F.array_position(cycle, F.array_min(cycle)).cast("int")
    n = F.size(cycle)
    return F.when(n > 0, F.concat(F.slice(cycle, at, n - at + 1), F.slice(cycle, F.lit(1), at - 1))).otherwise(cycle)
