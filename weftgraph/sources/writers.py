"""Sinks: fact lines, importance maps, module files, source rewrites, build directives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators.loops import cut, empty


def rename_lines(rows: DataFrame) -> DataFrame:
    """(value) of renames by file and place."""
    return rows.orderBy("file", "line", "col").select(F.concat_ws("##", "file", F.concat_ws(":", "line", "col"), "from_str", "to_str").alias("value"))


def implements_lines(rows: DataFrame) -> DataFrame:
    return rows.orderBy("impl_file", "header", "symbol").select(F.concat_ws("##", "impl_file", "header", "symbol").alias("value"))


def symbol_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("##", "file", F.concat_ws(":", "begin_line", "begin_col"), F.concat_ws(":", "end_line", "end_col"), "symbol").alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    """rows(value) as text; an empty result leaves no file behind."""
    if rows.limit(1).count():
        rows.write.mode("overwrite").text(path)


def write_fact_files(rows: DataFrame, folder: str, kind: str) -> None:
    """rows(value) as files `<n>-<kind>.txt` in folder, as the readers look for them; files without a line are not kept.

    Spark names its files itself; what the driver does is one renaming a file.
    """
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at = fs_path(f"{folder}/_{kind}")
    rows.write.mode("overwrite").text(str(at))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = sorted((str(s.getPath()), s.getLen()) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
    for n, (path, length) in enumerate(files):
        if length:
            fs.rename(fs_path(path), fs_path(f"{folder}/{n}-{kind}.txt"))
    fs.delete(at, True)


def write_named_files(texts: DataFrame, folder: str) -> None:
    """texts(name, text) as a file each: the writers of module files and rewritten sources. Names have no folders."""
    spark = texts.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at = fs_path(f"{folder}/_named")
    # The name stands in the file's folder until it is renamed, escaped as the writer does it.
    texts.select(F.col("text").alias("value"), F.hex(F.col("name").cast("binary")).alias("name")).repartition("name").write.mode("overwrite").partitionBy("name").text(str(at))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for d in fs.listStatus(at):
        if d.isDirectory():
            name = bytes.fromhex(d.getPath().getName().removeprefix("name=")).decode()
            (path,) = [str(s.getPath()) for s in fs.listStatus(d.getPath()) if s.getPath().getName().startswith("part-")]
            fs.rename(fs_path(path), fs_path(f"{folder}/{name}"))
    fs.delete(at, True)


def write_compilation_database(entries: DataFrame, path: str, most: int = 1000) -> None:
    """entries(directory, command, arguments, file) as JSON arrays of about `most` entries, a file each."""
    n = max(1, -(-entries.count() // most))
    line = F.to_json(F.struct("directory", "command", "arguments", "file"))
    parts = entries.groupBy(F.pmod(F.xxhash64("directory", "file", "command"), F.lit(n)).alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(F.collect_list(line), ",\n"), F.lit("\n]")).alias("value"))
    parts.repartition("part").write.mode("overwrite").partitionBy("part").text(path)


def write_importance(name: str, counts: DataFrame, key: str, folder: str) -> None:
    """One map as JSON lines in the key's order, over as many files as there are partitions."""
    counts.select(F.col(key).alias("name"), "n").orderBy("name").write.mode("overwrite").json(f"{folder}/{name}")


def module_texts(fragments: DataFrame, imports: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(module, text): each module's declaration, sorted imports and sorted includes; `only`: the modules that changed."""
    parts = fragments.groupBy("module").agg(F.sort_array(F.collect_set(fn.include_directive(F.col("file")))).alias("inc"))
    imp = imports.groupBy("module").agg(F.sort_array(F.collect_set(fn.module_import(F.col("dependency")))).alias("imp"))
    both = parts.join(imp, "module", "left")
    both = both.join(only.select("module"), "module", "left_semi") if only is not None else both
    none = F.array().cast("array<string>")
    lines = F.concat(F.array(fn.module_declaration(F.col("module"))), F.coalesce("imp", none), F.col("inc"))
    return both.select("module", F.array_join(lines, "\n").alias("text"))


def write_module_files(texts: DataFrame, path: str) -> None:
    texts.select(F.col("text").alias("value"), "module").repartition("module").write.mode("overwrite").partitionBy("module").text(path)


def changes(texts: DataFrame, written: DataFrame) -> DataFrame:
    """(module, text, change) of what differs from written(module, digest): `new`, `changed`, or `gone` (text null)."""
    now = texts.select("module", "text", F.sha2("text", 256).alias("digest"))
    both = now.join(written.select("module", F.col("digest").alias("old")), "module", "full_outer")
    change = F.when(F.col("digest").isNull(), "gone").when(F.col("old").isNull(), "new").when(F.col("digest") != F.col("old"), "changed")
    return both.withColumn("change", change).where("change is not null").select("module", "text", "change")


def update_module_files(texts: DataFrame, path: str) -> DataFrame:
    """Module files under path as texts(module, text) want them; (module, change) of what was written or removed.

    A manifest of digests beside them says what is there: only module files that differ are written, those of modules
    that are no more are removed, and a second run writes nothing. The manifest is replaced last, so a run that is
    cut off is done again by the next one. What comes to the driver are the names of removed modules, one by one.
    """
    spark = texts.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    manifest = f"{path}/_digests"
    there = sorted(int(s.getPath().getName()) for s in fs.listStatus(fs_path(manifest)) if fs.exists(fs_path(f"{s.getPath()}/_SUCCESS"))) if fs.exists(fs_path(manifest)) else []
    schema = "module string, digest string"
    old = spark.read.schema(schema).parquet(f"{manifest}/{there[-1]}") if there else spark.createDataFrame([], schema)
    todo = cut(changes(texts, old))
    fresh = todo.where("change <> 'gone'").select(F.col("text").alias("value"), "module")
    if not empty(fresh):
        fresh.repartition("module").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").text(path)
    # The writer's own names of folders, as it escapes signs.
    for r in todo.where("change = 'gone'").select("module").toLocalIterator():
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("module", r["module"])
        fs.delete(fs_path(f"{path}/{name}"), True)
    if not empty(todo):
        texts.select("module", F.sha2("text", 256).alias("digest")).write.mode("overwrite").parquet(f"{manifest}/{(there or [0])[-1] + 1}")
        for n in there:
            fs.delete(fs_path(f"{manifest}/{n}"), True)
    return todo.select("module", "change")


def ordered_includes(lines: DataFrame, order: DataFrame, matching: str) -> DataFrame:
    """(file, pos, line): module files with their include block in the given order(file, target, rank).

    Lines before the first include stay; ordered includes follow; includes that do not match stay last.
    """
    t = lines.withColumn("target", fn.include_target(F.col("line")))
    first = t.where("target is not null").groupBy("file").agg(F.min("pos").alias("first"))
    t = t.join(first, "file")
    head = t.where("pos < first").select("file", F.lit(0).alias("part"), "pos", "line")
    mid = order.join(first, "file", "left_semi").select("file", F.lit(1).alias("part"), F.col("rank").alias("pos"), fn.include_directive(F.col("target")).alias("line"))
    tail = t.where((F.col("pos") >= F.col("first")) & F.col("target").isNotNull() & ~F.col("target").rlike(matching)).select("file", F.lit(2).alias("part"), "pos", "line")
    rows = head.unionByName(mid).unionByName(tail)
    return rows.withColumn("pos", F.expr("row_number() over (partition by file order by part, pos) - 1")).select("file", "pos", "line")


def texts_of(lines: DataFrame) -> DataFrame:
    """(file, text) from (file, pos, line)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("file").agg(ordered.alias("l")).select("file", F.array_join(F.col("l.line"), "\n").alias("text"))


def renamed_lines(lines: DataFrame, renames: DataFrame) -> DataFrame:
    """lines(file, pos, line) with renames(file, line, col, from_str, to_str; 1-based) done from right to left, each only where its text stands."""
    todo = renames.groupBy("file", (F.col("line") - 1).alias("pos")).agg(F.sort_array(F.collect_list(F.struct("col", "from_str", "to_str")), asc=False).alias("todo"))
    done = F.aggregate("todo", F.col("line"), lambda a, r: fn.replace_at(a, r["col"], r["from_str"], r["to_str"]))
    return lines.join(todo, ["file", "pos"], "left").select("file", "pos", F.when(F.col("todo").isNull(), F.col("line")).otherwise(done).alias("line"))


def write_module_list(directives: DataFrame, path: str) -> None:
    directives.orderBy("section", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def importance_lines(counts: DataFrame, key: str) -> DataFrame:
    """(value): a JSON object of the counts in the key's order, a line a key; commas lead, so no line waits for the next."""
    rows = counts.select(F.col(key).alias("key"), "n")
    first = rows.agg(F.min("key").alias("first"))
    entry = F.concat(F.when(F.col("key") == F.col("first"), "  ").otherwise(", "), F.to_json(F.create_map("key", "n")).substr(F.lit(2), F.length(F.to_json(F.create_map("key", "n"))) - 2))
    spark = counts.sparkSession
    ends = spark.createDataFrame([(0, "", "{"), (2, "", "}")], "part int, key string, value string")
    body = rows.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), "key", entry.alias("value"))  # one row
    return ends.unionByName(body).orderBy("part", "key").select("value")


def write_importance_maps(inclusions: DataFrame, unit_includes: DataFrame, compilations: DataFrame, folder: str) -> None:
    """The three maps, each as text whose files in their order are one JSON object."""
    for name, counts, key in (("times-header-included-to-tu", inclusions, "header"), ("headers-tu-includes", unit_includes, "file"), ("times-source-file-compiled", compilations, "file")):
        importance_lines(counts, key).write.mode("overwrite").text(f"{folder}/{name}")


def dot_lines(edges: DataFrame, label: str | None = None) -> DataFrame:
    """(value): edges (src, dst) as statements of the DOT language, for whoever draws them."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), r'(["\\])', r"\\$1"), F.lit('"'))
    tail = F.concat(F.lit(' [label="'), F.col(label).cast("string"), F.lit('"]')) if label else F.lit("")
    return edges.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), tail, F.lit(";")).alias("value"))


#: Exporters of graphs by name; "none" exports nothing.
EXPORTERS = {"dot": lambda edges, path, label=None: write_lines(dot_lines(edges, label), path), "none": lambda edges, path, label=None: None}


def module_file_list(listing: DataFrame, module: str, matching: str) -> DataFrame:
    """(module, text): a module file of the listed files(file) that match."""
    some = listing.where(F.col("file").rlike(matching)).select(F.lit(module).alias("module"), "file")
    return module_texts(some, some.sparkSession.createDataFrame([], "module string, dependency string"))
