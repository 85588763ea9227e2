"""Facts from text and JSON files, with what is malformed set aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn

COMMANDS = "directory string, command string, arguments array<string>, file string"


def compilation_database(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(COMMANDS).json(path, multiLine=True)


def files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(file): paths below root, relative to it. Nothing of a file is read but its place and size."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (r.option("pathGlobFilter", glob) if glob else r).load(root).select(_relative(F.col("path"), root).alias("file"), "length").select("file")


def _relative(path: Column, root: str) -> Column:
    bare = root.split(":", 1)[1] if root.startswith("file:") else root
    return fn.strip_root(F.regexp_replace(path, "^file:/*", "/"), "/" + bare.strip("/"))


def _read_from() -> Column:
    """The file that a row was read from; Spark gives its place as a URI, in which blanks and other signs are escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, value): lines of matching files below root; bad UTF-8 becomes replacement characters."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    return t.select(_relative(_read_from(), root).alias("path"), "value")


def source_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(file, pos, line) of source files."""
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return t.select(_relative(_read_from(), root).alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def split_rejects(rows: DataFrame, parsed: Column) -> tuple[DataFrame, DataFrame]:
    """Parsed rows of non-empty lines, and the lines that did not parse."""
    r = rows.where(F.trim("value") != "").withColumn("row", parsed)
    return r.where("row is not null").select("row.*"), r.where("row is null").select("path", "value")


def module_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Fragments (module, file, pos, backing_file) of files that end in cppm, and files that were in several modules.

    A module's files are taken beside its own file.
    """
    rows = source_texts(spark, root, "*cppm").withColumnRenamed("file", "backing_file")
    module = fn.declared_module(F.col("line"))
    names = rows.withColumn("module", module).where("module is not null").groupBy("backing_file").agg(F.min_by("module", "pos").alias("module"))
    inc = rows.withColumn("target", fn.include_target(F.col("line"))).where("target is not null")
    parts = inc.join(names, "backing_file").select("module", fn.join_path(fn.folder(F.col("backing_file")), F.col("target")).alias("file"), "pos", "backing_file")
    many = parts.groupBy("file").agg(F.count("*").alias("n")).where("n <> 1")
    return parts.join(many, "file", "left_anti").select("module", "file", "pos", "backing_file"), many


def implements(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(impl_file, header, symbol) and malformed lines."""
    p = F.split("value", "##")
    ok = F.size(p) >= 2
    row = F.when(ok, F.struct(F.get(p, F.lit(0)).alias("impl_file"), F.get(p, F.lit(1)).alias("header"), F.get(p, F.lit(2)).alias("symbol")))
    good, bad = split_rejects(lines(spark, root, "*-implements.txt"), row)
    return good.distinct(), bad


def implements_deps(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("impl_file").alias("dependee"), F.col("header").alias("dependency"), F.lit("implements").alias("kind")).distinct()


def definitions(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    good, bad = split_rejects(lines(spark, root, "*-definitions.txt"), fn.symbol_row(F.col("value")))
    return good.distinct(), bad


def forward_declarations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    good, bad = split_rejects(lines(spark, root, "*-forwarddeclarations.txt"), fn.symbol_row(F.col("value")))
    return good.distinct(), bad


def renames(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(file, line, col, from_str, to_str) and malformed lines."""
    p = F.split("value", "##")
    at = fn.place(F.get(p, F.lit(1)))
    ok = (F.size(p) == 4) & at["line"].isNotNull() & at["col"].isNotNull()
    row = F.when(ok, F.struct(F.get(p, F.lit(0)).alias("file"), at["line"].alias("line"), at["col"].alias("col"), F.get(p, F.lit(2)).alias("from_str"), F.get(p, F.lit(3)).alias("to_str")))
    return split_rejects(lines(spark, root, "*-badsymbols.txt"), row)


def existing(paths: DataFrame, listing: DataFrame, start: str) -> DataFrame:
    """paths(file) that are listed as they are or under the start folder, with the place they were found at."""
    c = paths.select("file", F.posexplode(F.array(F.col("file"), fn.join_path(F.lit(start), F.col("file")))).alias("n", "found"))
    return c.join(listing.select(F.col("file").alias("found")).distinct(), "found").groupBy("file").agg(F.min_by("found", "n").alias("found"))


def importance_entries(commands: DataFrame, outputs: DataFrame, accept_arguments: bool = False) -> DataFrame:
    """(entry, file, header) from captured dependency listings outputs(entry, output); commands(entry, command, arguments, file)."""
    has = F.col("command").isNotNull()
    if accept_arguments:
        has = has | F.col("arguments").isNotNull()
    keep = commands.where(has & ~F.col("file").rlike(fn.NOT_COMPILED))
    return keep.join(outputs, "entry").select("entry", "file", F.explode_outer(fn.make_dependencies(F.col("output"))).alias("header"))
