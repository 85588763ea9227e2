"""Registered queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import commands
from .functions import text as fn
from .operators import analysis, graphs, kernels
from .operators import relational as rel
from .operators.loops import cut, shared_folder, stored
from .plans import passes
from .plans.model import State
from .sources import readers, writers
from .tables import deps, facts_sql, fragments, implements, table, uses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


DENSE, FINE = facts_sql(), facts_sql(fine=True)

# ---- imports, couplings, lookups


@query(f"{DENSE} SELECT src AS module, dst AS dependency FROM mods")
def module_imports(spark, sf):
    return rel.imports(uses(spark, sf), fragments(spark, sf))


@query(f"{DENSE} SELECT from_module AS module, to_module AS dependency, count(*) AS strength FROM placed WHERE from_module <> to_module GROUP BY ALL")
def coupling_strength(spark, sf):
    return rel.coupling(deps(spark, sf), fragments(spark, sf))


@query(f"{DENSE}, s AS (SELECT from_module AS module, to_module AS dependency, count(*) AS strength FROM placed WHERE from_module <> to_module GROUP BY ALL), r AS (SELECT *, (strength - min(strength) OVER ()) / nullif(CAST(max(strength) OVER () - min(strength) OVER () AS DOUBLE), 0) AS relative FROM s) SELECT module, dependency, strength, round(relative, 9) AS relative, round(1 + 3 * relative, 9) AS width FROM r")
def relative_strengths(spark, sf):
    r = rel.relative_couplings(rel.coupling(deps(spark, sf), fragments(spark, sf)))
    return r.withColumn("relative", F.round("relative", 9)).withColumn("width", F.round("width", 9))


@query(f"{DENSE} SELECT module, count(*) AS files FROM fragments GROUP BY module")
def module_sizes(spark, sf):
    return rel.module_sizes(fragments(spark, sf))


@query("WITH f AS (SELECT 'B' || (l_suppkey % 25) AS module, CAST(l_partkey AS VARCHAR) AS file FROM lineitem) SELECT file, count(*) AS n FROM f GROUP BY file HAVING count(*) <> 1")
def duplicate_fragments(spark, sf):
    f = table(spark, sf, "lineitem").select(F.concat(F.lit("B"), (F.col("l_suppkey") % 25).cast("string")).alias("module"), F.col("l_partkey").cast("string").alias("file"))
    return rel.unique_fragments(f)[1]


@query("SELECT CAST(l_suppkey AS VARCHAR) AS symbol, count(DISTINCT l_partkey) AS files FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1")
def multi_defined_symbols(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("symbol"), F.col("l_partkey").alias("file"))
    return rel.ambiguous_symbols(d)


@query(f"{DENSE}, p AS (SELECT DISTINCT d.dependee, d.dependency AS file, f.module FROM impl d JOIN fragments f ON f.file = d.dependee), many AS (SELECT file FROM p GROUP BY file HAVING count(DISTINCT module) > 1) SELECT file, module, array_to_string(list_sort(list(DISTINCT dependee)), ',') AS implementers FROM p WHERE file IN (SELECT file FROM many) GROUP BY file, module")
def implementation_insanity(spark, sf):
    return rel.insanity(implements(spark, sf), fragments(spark, sf)).withColumn("implementers", F.array_join("implementers", ","))


@query(f"{DENSE}, x AS (SELECT dependee AS file, 1 AS o, 0 AS i FROM uses UNION ALL SELECT dependency, 0, 1 FROM uses) SELECT file, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM x GROUP BY file")
def file_degrees(spark, sf):
    return rel.degrees(uses(spark, sf))


@query(f"{FINE} SELECT file AS node FROM fragments WHERE file NOT IN (SELECT dependee FROM uses) AND file NOT IN (SELECT dependency FROM uses)")
def isolated_files(spark, sf):
    return rel.isolated(fragments(spark, sf, True).select(F.col("file").alias("node")), _files(spark, sf))


@query("WITH e AS (SELECT l_orderkey AS entry, 'p' || (l_orderkey % 97) AS file, 'p' || (l_partkey % 997) AS header FROM lineitem) SELECT header, count(DISTINCT entry) AS n FROM e WHERE header <> file GROUP BY header")
def header_inclusions(spark, sf):
    return rel.inclusions(_entries(spark, sf))


@query("WITH e AS (SELECT l_orderkey AS entry, 'p' || (l_orderkey % 97) AS file, 'p' || (l_partkey % 997) AS header FROM lineitem), n AS (SELECT entry, file, count(DISTINCT CASE WHEN header <> file THEN header END) AS n FROM e GROUP BY ALL) SELECT file, CAST(sum(n) AS BIGINT) AS n FROM n GROUP BY file")
def tu_include_totals(spark, sf):
    return rel.includes_of_units(_entries(spark, sf))


@query("SELECT 'p' || (l_orderkey % 97) AS file, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL")
def tu_compile_counts(spark, sf):
    return rel.compilations(_entries(spark, sf))


def _entries(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as compilations of one of 97 units, parts as headers."""
    name = lambda c, n: F.concat(F.lit("p"), (F.col(c) % n).cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry"), name("l_orderkey", 97).alias("file"), name("l_partkey", 997).alias("header"))


@query("WITH c AS (SELECT 'f' || o_orderkey || CASE o_orderkey % 4 WHEN 0 THEN '.o' WHEN 1 THEN '.so' ELSE '.cpp' END AS file, o_orderstatus <> 'P' AS ok FROM orders), s AS (SELECT *, regexp_matches(file, '\\.(o|so|a|lib|exe|dll|sys|out)$') AS skip FROM c) SELECT count(*) AS total, count(*) FILTER (NOT skip AND ok) AS success, count(*) FILTER (NOT skip AND NOT ok) AS failed, count(*) FILTER (skip) AS skipped FROM s")
def status_totals(spark, sf):
    o = table(spark, sf, "orders")
    ext = F.when(F.col("o_orderkey") % 4 == 0, ".o").when(F.col("o_orderkey") % 4 == 1, ".so").otherwise(".cpp")
    return rel.status_totals(o.select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), ext).alias("file"), (F.col("o_orderstatus") != "P").alias("ok")))


@query("WITH a AS (SELECT round_even(count(*) / 24, 0) AS average FROM part), d AS (SELECT average, round_even(sqrt(average * average / 12), 0) AS deviation FROM a) SELECT CAST(average AS BIGINT) AS average, CAST(deviation AS BIGINT) AS deviation, CAST(round_even(deviation / 2, 0) AS BIGINT) AS overflow FROM d")
def bucket_stats(spark, sf):
    return rel.bucket_plan(table(spark, sf, "part"), 24)


def _random_sql(modules: str, buckets: int, seed: int) -> str:
    """Common table expressions from modules(module) on: `placed`(module, bucket), as relational.random_buckets gives it."""
    draw = lambda salt: f"CAST('0x' || substr(md5('{seed}/{salt}/' || module), 1, 12) AS BIGINT)"
    return f"""modules AS ({modules}), a AS (SELECT round_even(count(*) / {buckets}, 0) AS average FROM modules),
limits AS (SELECT CAST(average + round_even(round_even(sqrt(average * average / 12), 0) / 2, 0) AS BIGINT) AS most FROM a),
drawn AS (SELECT module, {draw("bucket")} % {buckets} AS bucket, {draw("trim")} AS trim FROM modules),
ranked AS (SELECT module, bucket, row_number() OVER (PARTITION BY bucket ORDER BY trim, module) AS r FROM drawn),
sizes AS (SELECT b AS bucket, count(module) AS n FROM range({buckets}) t(b) LEFT JOIN drawn ON bucket = b GROUP BY b),
room AS (SELECT bucket, most + 1 - n AS slots, sum(most + 1 - n) OVER (ORDER BY bucket) AS last FROM sizes, limits WHERE n <= most),
total AS (SELECT CAST(max(last) AS BIGINT) AS s FROM room),
start AS (SELECT greatest(1, CAST(round_even(0.618 * s, 0) AS BIGINT)) AS first, s FROM total),
stride AS (SELECT min(k) AS k, any_value(s) AS s FROM (SELECT unnest(range(first, first + s + 1)) AS k, s FROM start) WHERE gcd(k, s) = 1),
over AS (SELECT module, bucket, row_number() OVER (ORDER BY bucket, r) - 1 AS number FROM ranked, limits WHERE r > most),
slot AS (SELECT module, CAST((number % s) * k % s AS BIGINT) AS place FROM over, stride),
moved AS (SELECT module, (SELECT min(bucket) FROM room WHERE last > place) AS target FROM slot),
placed AS (SELECT r.module, CAST(coalesce(m.target, r.bucket) AS INTEGER) AS bucket FROM ranked r LEFT JOIN moved m USING (module))"""


@query(f"WITH {_random_sql('SELECT DISTINCT p_name AS module FROM part', 24, 1)} SELECT module, bucket FROM placed")
def random_buckets(spark, sf):
    return rel.random_buckets(table(spark, sf, "part").select(F.col("p_name").alias("module")), 24, 1)


@query("SELECT p_brand AS module, array_to_string(list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))), ',') AS files FROM part WHERE p_size < 5 GROUP BY p_brand")
def modules_for_files(spark, sf):
    some = table(spark, sf, "part").where("p_size < 5").select(F.col("p_partkey").cast("string").alias("file"))
    return rel.modules_with(some, fragments(spark, sf)).withColumn("files", F.array_join("files", ","))


@query(f"{DENSE}, f AS (SELECT CAST(p_partkey AS VARCHAR) AS file FROM part WHERE p_size >= 10) SELECT dependee, dependency, kind, dependee NOT IN (SELECT file FROM f) AS no_dependee, dependency NOT IN (SELECT file FROM f) AS no_dependency FROM deps WHERE dependee NOT IN (SELECT file FROM f) OR dependency NOT IN (SELECT file FROM f)")
def dependency_rejects(spark, sf):
    some = table(spark, sf, "part").where("p_size >= 10").select(F.col("p_brand").alias("module"), F.col("p_partkey").cast("string").alias("file"))
    return rel.rejected(deps(spark, sf), some)


@query(f"{DENSE} SELECT DISTINCT dependee AS file, kind FROM deps WHERE dependency = '7'")
def dependees(spark, sf):
    return rel.dependees(deps(spark, sf), "7")


@query(f"{DENSE} SELECT DISTINCT dependency AS file, kind FROM deps WHERE dependee = '7'")
def dependencies(spark, sf):
    return rel.dependencies(deps(spark, sf), "7")


@query(f"{DENSE} SELECT DISTINCT dependee, dependency, kind FROM placed WHERE from_module = 'Brand#11' AND to_module = 'Brand#22'")
def between_modules(spark, sf):
    return rel.between(deps(spark, sf), fragments(spark, sf), "Brand#11", "Brand#22")


@query(f"{DENSE} SELECT DISTINCT from_module AS module, dependee, dependency, kind FROM placed WHERE from_module = to_module")
def intra_module(spark, sf):
    return rel.inside(deps(spark, sf), fragments(spark, sf))


# ---- includes, lines, symbols

_INCLUDES_SQL = "WITH inc AS (SELECT DISTINCT 'o' || (l_orderkey % 100) || '/main.cpp' AS file, l_partkey % 50 AS line, 'p' || (l_partkey % 50) AS target FROM lineitem), k AS (SELECT DISTINCT p_partkey % 50 AS n FROM part), j AS (SELECT DISTINCT o_orderkey % 100 AS n FROM orders), known AS (SELECT 'p' || n AS file FROM k WHERE n % 3 = 0 UNION SELECT 'o' || j.n || '/p' || k.n FROM j, k WHERE k.n % 3 = 1 AND j.n % 2 = 0 UNION SELECT 'inc1/p' || n FROM k WHERE n % 5 = 2 UNION SELECT 'inc2/p' || n FROM k WHERE n % 2 = 0)"


def _includes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Include lines of a main file for each of 100 folders, and known files of several kinds of places."""
    s = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    k = F.col("l_partkey") % 50
    inc = table(spark, sf, "lineitem").select(s("o", F.col("l_orderkey") % 100, "/main.cpp").alias("file"), k.alias("line"), s("p", k).alias("target")).distinct()
    parts = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("n")).distinct()
    folders = table(spark, sf, "orders").select((F.col("o_orderkey") % 100).alias("j")).distinct()
    n = F.col("n")
    known = parts.where("n % 3 = 0").select(s("p", n).alias("file"))
    known = known.union(parts.where("n % 3 = 1").crossJoin(folders.where("j % 2 = 0")).select(s("o", F.col("j"), "/p", n)))  # 50 by 100 names at most
    known = known.union(parts.where("n % 5 = 2").select(s("inc1/p", n))).union(parts.where("n % 2 = 0").select(s("inc2/p", n)))
    return inc, known


@query(f"{_INCLUDES_SQL}, c AS (SELECT file, line, target, 0 AS p, target AS candidate FROM inc UNION ALL SELECT file, line, target, 1, split_part(file, '/', 1) || '/' || target FROM inc UNION ALL SELECT file, line, target, 2, 'inc1/' || target FROM inc UNION ALL SELECT file, line, target, 3, 'inc2/' || target FROM inc), h AS (SELECT c.*, row_number() OVER (PARTITION BY c.file, line, target ORDER BY p) AS r FROM c JOIN known k ON k.file = c.candidate) SELECT i.file, i.line, i.target, h.candidate AS resolved FROM inc i LEFT JOIN h ON h.file = i.file AND h.line = i.line AND h.target = i.target AND h.r = 1")
def include_resolution(spark, sf):
    inc, known = _includes(spark, sf)
    return rel.resolved_includes(inc, known, ["inc1", "inc2"])


@query("WITH l AS (SELECT doc_id AS file, text FROM documents), n AS (SELECT file, unnest(range(len(string_split(text, chr(10))))) AS pos, text FROM l) SELECT file, CAST(pos AS INTEGER) AS pos, string_split(text, chr(10))[pos + 1] AS line FROM n")
def numbered_lines(spark, sf):
    return rel.numbered_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"))


@query("WITH n AS (SELECT doc_id AS file, unnest(range(len(string_split(text, chr(10))))) AS pos, text FROM documents), l AS (SELECT file, CAST(pos AS INTEGER) AS pos, string_split(text, chr(10))[pos + 1] AS line FROM n) SELECT * FROM l WHERE (file + pos) % 3 <> 0")
def lines_kept(spark, sf):
    lines = rel.numbered_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"))
    return rel.kept_lines(lines, lines.where("(file + pos) % 3 = 0").select("file", "pos"))


@query("SELECT page_id, '#include \"' || substr(h, 7) || '\"' AS line, substr(h, 7) AS target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"[^\"<>]+')) AS h FROM pages)")
def include_targets(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"<>]+)'), F.lit(1))).alias("h"))
    return h.select("page_id", fn.include_directive(F.col("h")).alias("line")).withColumn("target", fn.include_target(F.col("line")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'p' || l_partkey AS file, l_linenumber AS begin_line, CAST(l_partkey % 80 AS INTEGER) AS begin_col, l_linenumber + 1 AS end_line, 3 AS end_col, 's' || l_suppkey AS symbol FROM lineitem WHERE l_suppkey % 5 <> 0")
def symbol_rows(spark, sf):
    s = lambda c: F.col(c).cast("string")
    line = F.concat(F.lit("p"), s("l_partkey"), F.lit("##"), s("l_linenumber"), F.lit(":"), (F.col("l_partkey") % 80).cast("string"), F.lit("##"), (F.col("l_linenumber") + 1).cast("string"), F.when(F.col("l_suppkey") % 5 == 0, ":x##s").otherwise(":3##s"), s("l_suppkey"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.symbol_row(line).alias("r"))
    return rows.where("r is not null").select("l_orderkey", "l_linenumber", "l_partkey", "r.*")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '_' || substr(CAST(doc_id AS VARCHAR), 2) || '_a_b' ELSE source || '_x_y' END AS prefix FROM documents")
def rename_prefix(spark, sf):
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("dir/"), F.col("doc_id").cast("string"), F.lit("-a.b.cpp"))).otherwise(F.concat(F.lit("x/"), F.col("source"), F.lit("-x-y.cc")))
    return table(spark, sf, "documents").select("doc_id", fn.rename_prefix(name).alias("prefix"))


@query("SELECT p_brand AS module, 'Module_' || substr(md5(array_to_string(list_sort(list(DISTINCT CAST(p_partkey AS VARCHAR))), ',')), 1, 7) AS name FROM part GROUP BY p_brand HAVING count(DISTINCT p_partkey) > 1")
def module_names(spark, sf):
    return fragments(spark, sf).groupBy("module").agg(F.collect_set("file").alias("f")).where("size(f) > 1").select("module", fn.module_name(F.col("f")).alias("name"))


@query("WITH f AS (SELECT p_partkey, 'a/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.h' WHEN 1 THEN '.cpp' WHEN 2 THEN '.hpp' ELSE '.txt' END AS file FROM part) SELECT file, CASE WHEN p_partkey % 4 IN (0, 2) THEN 'header' WHEN p_partkey % 4 = 1 THEN 'source' ELSE 'other' END AS kind FROM f")
def file_kinds(spark, sf):
    k = F.col("p_partkey") % 4
    f = F.concat(F.lit("a/"), F.col("p_partkey").cast("string"), F.when(k == 0, ".h").when(k == 1, ".cpp").when(k == 2, ".hpp").otherwise(".txt"))
    return table(spark, sf, "part").select(f.alias("file"), fn.file_kind(f).alias("kind"))


_RENAMES_SQL = "WITH r AS (SELECT 'f' || (l_orderkey % 50) AS file, CAST(l_partkey % 200 AS INTEGER) AS line, l_linenumber AS col, l_suppkey % 30 AS binding_id, 's' || l_suppkey AS what, l_orderkey * 1000000 + l_partkey * 100 + l_suppkey % 100 AS seq FROM lineitem), b AS (SELECT s_suppkey % 40 AS binding_id, 'from' || s_suppkey AS from_str, 'to' || s_suppkey AS to_str, s_suppkey AS seq FROM supplier WHERE s_suppkey % 40 < 25), b1 AS (SELECT binding_id, arg_min(to_str, seq) AS to_str FROM b GROUP BY binding_id), r1 AS (SELECT file, line, col, arg_min(binding_id, seq) AS binding_id, arg_min(what, seq) AS what FROM (SELECT file, line, col, binding_id, what, min(seq) AS seq FROM r GROUP BY ALL) GROUP BY file, line, col)"


@query(f"{_RENAMES_SQL} SELECT file, line, col, what AS from_str, to_str FROM r1 JOIN b1 USING (binding_id)")
def rename_directives(spark, sf):
    line, sup = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    seq = F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 100 + F.col("l_suppkey") % 100
    r = line.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 50).cast("string")).alias("file"), (F.col("l_partkey") % 200).cast("int").alias("line"), F.col("l_linenumber").alias("col"), (F.col("l_suppkey") % 30).alias("binding_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("what"), seq.alias("seq"))
    k = F.col("s_suppkey")
    b = sup.where(k % 40 < 25).select((k % 40).alias("binding_id"), F.concat(F.lit("from"), k.cast("string")).alias("from_str"), F.concat(F.lit("to"), k.cast("string")).alias("to_str"), k.alias("seq"))
    return rel.rename_rows(r, b)


@query("SELECT l_shipmode_path AS path, min(k) AS first FROM (SELECT 'inc/' || (l_suppkey % 40) AS l_shipmode_path, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY ALL")
def first_seen_paths(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("inc/"), (F.col("l_suppkey") % 40).cast("string")).alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return rel.first_seen(rows, "path", ["first"])


# ---- implementers, forward declarations, moves


@query(f"{DENSE}, h AS (SELECT * FROM placed WHERE kind = 'implements' AND CAST(dependency AS BIGINT) % 2 = 0 AND from_module <> to_module) SELECT dependee AS file, max(to_module) AS new_module FROM h GROUP BY dependee")
def implementation_moves(spark, sf):
    return rel.implementation_moves(implements(spark, sf), fragments(spark, sf), "[02468]$")


@query(f"{DENSE}, f AS (SELECT DISTINCT 's' || l_suppkey AS symbol, CAST(l_partkey AS VARCHAR) AS file FROM lineitem), d AS (SELECT DISTINCT 's' || (p_partkey // 2) AS symbol, CAST(p_partkey AS VARCHAR) AS file FROM part), dm AS (SELECT symbol, min(module) AS b FROM d JOIN fragments USING (file) GROUP BY symbol HAVING min(module) = max(module)) SELECT DISTINCT g.module AS a, dm.b FROM f JOIN fragments g USING (file) JOIN dm USING (symbol) WHERE g.module <> dm.b")
def forward_links(spark, sf):
    f = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("symbol"), F.col("l_partkey").cast("string").alias("file"))
    d = table(spark, sf, "part").select(F.concat(F.lit("s"), F.expr("p_partkey div 2").cast("string")).alias("symbol"), F.col("p_partkey").cast("string").alias("file"))
    return rel.forward_links(f, d, fragments(spark, sf))


@query("SELECT CAST(l_partkey AS VARCHAR) AS file, arg_max('m' || l_suppkey, k) AS new_module FROM (SELECT l_partkey, l_suppkey, l_orderkey * 100000 + l_suppkey AS k FROM lineitem) GROUP BY l_partkey")
def merged_moves(spark, sf):
    m = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 100000 + F.col("l_suppkey")).alias("rank"), F.col("l_partkey").cast("string").alias("file"), F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("new_module"))
    return rel.merged_moves(m)


@query(f"{DENSE} SELECT 1 AS section, module, 'set_module(' || module || ')' AS line FROM (SELECT DISTINCT module FROM fragments) UNION ALL SELECT 2, src, 'set_module_dependency(' || src || ' ' || dst || ')' FROM mods")
def module_list_lines(spark, sf):
    f = fragments(spark, sf)
    return rel.module_list(f, rel.imports(uses(spark, sf), f))


@query("SELECT o_orderkey, array_to_string(CASE WHEN m = a THEN [a, b, c] WHEN m = b THEN [b, c, a] ELSE [c, a, b] END, ',') AS cycle FROM (SELECT *, least(a, b, c) AS m FROM (SELECT o_orderkey, 'n' || (o_orderkey * 7 % 101) AS a, 'n' || (o_custkey * 13 % 103 + 200) AS b, 'n' || (o_orderkey * 11 % 107 + 400) AS c FROM orders))")
def rotated_cycles(spark, sf):
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    o, cust = F.col("o_orderkey"), F.col("o_custkey")
    cycle = F.array(n(o * 7 % 101), n(cust * 13 % 103 + 200), n(o * 11 % 107 + 400))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(fn.rotated(cycle), ",").alias("cycle"))


# ---- graphs


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """The fine facts' modules; over 20,000 edges at sf0.01, so searches go by joins."""
    return passes.module_edges(State(fragments(spark, sf, True), uses(spark, sf, True)))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """The fine facts' files."""
    return uses(spark, sf, True).select(F.col("dependee").alias("src"), F.col("dependency").alias("dst"))


#: Files as nodes; the modules' shortest cycles have two edges in all of the driver's tables.
_FILES = f"{FINE}, e AS MATERIALIZED (SELECT dependee AS src, dependency AS dst FROM uses), nodes AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"
_CYCLES = f"{FINE}, w AS (SELECT src AS node, dst AS cur, 1 AS n, [src, dst] AS path FROM mods UNION ALL SELECT w.node, m.dst, n + 1, list_append(path, m.dst) FROM w JOIN mods m ON m.src = w.cur WHERE n < 2 AND w.cur <> w.node), closed AS (SELECT * FROM w WHERE cur = node), best AS (SELECT node, min(path) AS cycle FROM closed WHERE n = (SELECT min(n) FROM closed) GROUP BY node)"


@query(f"{_CYCLES} SELECT node, array_to_string(cycle, ' -> ') AS cycle FROM best")
def shortest_cycles(spark, sf):
    return graphs.shortest_cycles(_edges(spark, sf)).withColumn("cycle", F.array_join("cycle", " -> "))


def _turned(spark: SparkSession, sf: str) -> DataFrame:
    """The fine facts' modules, of two that use each other one way only: no cycle of two edges is left."""
    e = _edges(spark, sf)
    one = ((F.length("src") + F.ascii(F.substring("src", -1, 1)) + F.length("dst") + F.ascii(F.substring("dst", -1, 1))) % 2) == 0
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return e.select(F.when(one, low).otherwise(high).alias("src"), F.when(one, high).otherwise(low).alias("dst")).distinct()


_TURNED = f"{FINE}, o AS MATERIALIZED (SELECT DISTINCT CASE WHEN x THEN least(src, dst) ELSE greatest(src, dst) END AS src, CASE WHEN x THEN greatest(src, dst) ELSE least(src, dst) END AS dst FROM (SELECT src, dst, (length(src) + ascii(right(src, 1)) + length(dst) + ascii(right(dst, 1))) % 2 = 0 AS x FROM mods))"


@query(f"{_TURNED}, w AS (SELECT src AS node, dst AS cur, 1 AS n, [src, dst] AS path FROM o UNION ALL SELECT w.node, o.dst, n + 1, list_append(path, o.dst) FROM w JOIN o ON o.src = w.cur WHERE n < 3 AND w.cur <> w.node), closed AS (SELECT * FROM w WHERE cur = node) SELECT node, array_to_string(min(path), ' -> ') AS cycle FROM closed WHERE n = (SELECT min(n) FROM closed) GROUP BY node")
def longer_cycles(spark, sf):
    return graphs.shortest_cycles(_turned(spark, sf)).withColumn("cycle", F.array_join("cycle", " -> "))


@query(f"{_CYCLES}, e AS (SELECT b.node AS cycle_id, i AS pos, cycle[i] AS module, cycle[i + 1] AS dependency FROM best b, (SELECT unnest(range(1, 10)) AS i) WHERE i < len(cycle)), s AS (SELECT from_module AS module, to_module AS dependency, count(*) AS strength FROM placed WHERE from_module <> to_module GROUP BY ALL), r AS (SELECT e.*, coalesce(strength, 0) AS strength, row_number() OVER (PARTITION BY cycle_id ORDER BY coalesce(strength, 0) DESC, pos) AS r FROM e LEFT JOIN s USING (module, dependency)) SELECT cycle_id, module, dependency, strength FROM r WHERE r = 1")
def strongest_edge(spark, sf):
    f, d = stored(fragments(spark, sf, True)), stored(deps(spark, sf, True))
    cycles = graphs.shortest_cycles(passes.module_edges(State(f, d))).withColumnRenamed("node", "cycle_id")
    return rel.strongest_edges(cycles, rel.coupling(d, f))


_HOPS = "hop(start, node, level) USING KEY (start, node) AS (SELECT node, node, 0 FROM nodes UNION SELECT h.start, w.dst, min(h.level) + 1 FROM hop h JOIN way w ON w.src = h.node WHERE NOT EXISTS (SELECT 1 FROM recurring.hop r WHERE r.start = h.start AND r.node = w.dst) GROUP BY ALL) SELECT start, node, CAST(level AS INTEGER) AS level FROM hop WHERE level > 0"


@query(f"{_FILES}, way AS (SELECT src, dst FROM e), {_HOPS}")
def reachable_levels(spark, sf):
    e = cut(_files(spark, sf))
    return graphs.levels(e, e.select(F.col("src").alias("node")))


@query(f"{_FILES}, hop(start, node, level, path) USING KEY (start, node) AS (SELECT node, node, 0, [node] FROM nodes WHERE node NOT IN (SELECT dst FROM e) UNION SELECT h.start, e.dst, min(h.level) + 1, list_append(min(h.path), e.dst) FROM hop h JOIN e ON e.src = h.node WHERE NOT EXISTS (SELECT 1 FROM recurring.hop r WHERE r.start = h.start AND r.node = e.dst) GROUP BY h.start, e.dst) SELECT start, CAST(level AS INTEGER) AS level, path[-2] AS parent, string_agg(node, ',' ORDER BY node) AS nodes FROM hop WHERE level > 0 GROUP BY start, level, list_slice(path, 1, -2), path[-2]")
def sibling_groups(spark, sf):
    """From all files that no other uses."""
    e = cut(_files(spark, sf))
    return graphs.sibling_groups(e, e.select(F.col("src").alias("node")).join(e.select(F.col("dst").alias("node")), "node", "left_anti")).withColumn("nodes", F.array_join("nodes", ","))


@query(f"{_FILES}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, m.dst FROM reach r JOIN e m ON m.src = r.dst) SELECT src AS node FROM reach WHERE src = dst UNION SELECT 'm' || src FROM (WITH RECURSIVE r2 AS (SELECT src, dst FROM mods UNION SELECT r.src, m.dst FROM r2 r JOIN mods m ON m.src = r.dst) SELECT src FROM r2 WHERE src = dst)")
def cyclic_nodes(spark, sf):
    """Of the files, and of the modules (behind an m)."""
    return graphs.cyclic_nodes(_files(spark, sf)).union(graphs.cyclic_nodes(_edges(spark, sf)).select(F.concat(F.lit("m"), "node")))


@query(f"{FINE}, reach AS (SELECT src, dst FROM mods UNION SELECT r.src, m.dst FROM reach r JOIN mods m ON m.src = r.dst) SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src")
def strong_components(spark, sf):
    return graphs.strong_components(_edges(spark, sf))


@query(f"{_FILES}, sym AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e), cc(node, component) USING KEY (node) AS (SELECT node, node FROM nodes UNION SELECT u.node, min(v.component) FROM cc v JOIN sym ON sym.src = v.node JOIN recurring.cc u ON u.node = sym.dst WHERE v.component < u.component GROUP BY u.node) SELECT node, component FROM cc")
def components(spark, sf):
    return graphs.components(_files(spark, sf))


@query(f"{_FILES}, d AS MATERIALIZED (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM e), l AS (SELECT node, 0 AS layer FROM nodes UNION SELECT d.src, layer + 1 FROM l JOIN d ON d.dst = l.node) SELECT node, CAST(max(layer) AS INTEGER) AS layer FROM l GROUP BY node")
def topo_layers(spark, sf):
    """Each edge from the smaller to the greater name, so that there is no cycle."""
    e = cut(_files(spark, sf))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst"))
    return graphs.layers(nodes, e.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")))


@query(f"{_FILES}, seen AS (SELECT node FROM nodes WHERE node NOT IN (SELECT dst FROM e) UNION SELECT e.dst FROM seen JOIN e ON e.src = seen.node) SELECT src, dst FROM e WHERE src IN (SELECT node FROM seen)")
def include_closure(spark, sf):
    """From all files that no other uses."""
    e = cut(_files(spark, sf))
    return graphs.include_closure(e.select(F.col("src").alias("node")).join(e.select(F.col("dst").alias("node")), "node", "left_anti"), e)


@query(f"{DENSE} SELECT src, dst, CASE WHEN src < 'Brand#33' THEN 'S' ELSE 'T' END AS src_side, CASE WHEN dst < 'Brand#33' THEN 'S' ELSE 'T' END AS dst_side FROM mods WHERE (src < 'Brand#33') <> (dst < 'Brand#33')")
def cutting_edges(spark, sf):
    f = fragments(spark, sf)
    e = rel.imports(uses(spark, sf), f).select(F.col("module").alias("src"), F.col("dependency").alias("dst"))
    sides = f.select(F.col("module").alias("node")).distinct().withColumn("side", F.when(F.col("node") < "Brand#33", "S").otherwise("T"))
    return rel.cutting_edges(e, sides)


def _flow(spark: SparkSession, sf: str) -> DataFrame:
    u, f = stored(uses(spark, sf, True)), stored(fragments(spark, sf, True))
    cycles = passes.distinct_cycles(graphs.shortest_cycles(passes.module_edges(State(f, u))))
    return graphs.flow_edges(cut(cycles), u, f)


_NETWORK = f"""{_CYCLES}, ids AS (SELECT DISTINCT array_to_string(list_sort(cycle[1:2]), ',') AS cycle_id, list_min(cycle[1:2]) AS m0, list_max(cycle[1:2]) AS m1 FROM best WHERE len(cycle) = 3),
e AS (SELECT i.cycle_id, m0, p.dependee, p.dependency, from_module, to_module FROM placed p JOIN ids i ON (from_module = m0 AND to_module = m1) OR (from_module = m1 AND to_module = m0) WHERE kind = 'uses'),
d AS (SELECT cycle_id, m0, module, file, sum(o) AS o, sum(i) AS i FROM (SELECT cycle_id, m0, from_module AS module, dependee AS file, 1 AS o, 0 AS i FROM e UNION ALL SELECT cycle_id, m0, to_module, dependency, 0, 1 FROM e) GROUP BY ALL),
g AS (SELECT *, module = m0 AS first, bool_or(o > 0 AND i > 0) OVER (PARTITION BY cycle_id, module) AS b FROM d)"""
_FLOW = f"""{_NETWORK}
SELECT cycle_id, file AS src, 'in' AS src_side, module AS dst, 'sink' AS dst_side, CAST('inf' AS DOUBLE) AS capacity FROM g WHERE first AND i > 0
UNION ALL SELECT cycle_id, module, 'source', file, 'out', CAST('inf' AS DOUBLE) FROM g WHERE first AND o > 0
UNION ALL SELECT cycle_id, file, 'in', file, 'out', CAST('inf' AS DOUBLE) FROM g WHERE NOT first AND o > 0 AND i > 0
UNION ALL SELECT cycle_id, module, 'hub', file, 'out', CASE WHEN b THEN CAST(o AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END FROM g WHERE NOT first AND o > 0 AND i = 0
UNION ALL SELECT cycle_id, file, 'in', module, 'hub', CASE WHEN b THEN CAST(i AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END FROM g WHERE NOT first AND i > 0 AND o = 0
UNION ALL SELECT cycle_id, dependee, 'out', dependency, 'in', 1.0 FROM e"""


@query(_FLOW)
def flow_edges(spark, sf):
    return _flow(spark, sf)


#: The cycles have two modules: what a two-sided file of the second lets through, and what its hub does for the others.
@query(f"{_NETWORK} SELECT cycle_id, CAST(coalesce(sum(least(o, i)) FILTER (o > 0 AND i > 0), 0) + least(coalesce(sum(i) FILTER (o = 0), 0), coalesce(sum(o) FILTER (i = 0), 0)) AS DOUBLE) AS cut_value FROM g WHERE NOT first GROUP BY cycle_id")
def min_cut_value(spark, sf):
    return kernels.cut_values(_flow(spark, sf))


#: A two-sided file of the second module is parted from the first where fewer uses cross; its other files, which meet in
#: a hub, on their way out if no more uses leave than enter, else on their way in, if that is not cut at the hub itself.
@query(f"""{_NETWORK}, h AS (SELECT cycle_id, coalesce(sum(i) FILTER (o = 0), 0) AS ti, coalesce(sum(o) FILTER (i = 0), 0) AS too FROM g WHERE NOT first GROUP BY cycle_id),
x AS (SELECT g.cycle_id, file, CASE WHEN o > 0 AND i > 0 THEN CASE WHEN i < o THEN 'in' ELSE 'out' END WHEN too <= ti THEN CASE WHEN o > 0 THEN 'out' END WHEN NOT b AND i > 0 THEN 'in' END AS way FROM g JOIN h USING (cycle_id) WHERE NOT first)
SELECT e.cycle_id, e.dependee, e.dependency FROM e JOIN x ON x.cycle_id = e.cycle_id AND ((way = 'out' AND e.dependee = x.file) OR (way = 'in' AND e.dependency = x.file))""")
def cut_edges(spark, sf):
    return kernels.cut_edges(_flow(spark, sf))


@query()
def files_to_move(spark, sf):
    return kernels.move_plans(_flow(spark, sf))


@query()
def module_merges(spark, sf):
    into = passes.fold_once(State(stored(fragments(spark, sf, True)), stored(deps(spark, sf, True))))
    return spark.createDataFrame(sorted(into.items()), "module string, target string")


def _falling(spark: SparkSession, sf: str) -> State:
    """The coarse facts, each use from the greater to the smaller part: no files are on a cycle, and modules can be split."""
    u = uses(spark, sf).select(F.greatest(F.col("dependee").cast("long"), F.col("dependency").cast("long")).cast("string").alias("dependee"), F.least(F.col("dependee").cast("long"), F.col("dependency").cast("long")).cast("string").alias("dependency"), "kind")
    return State(fragments(spark, sf), u.distinct())


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, CAST(1 AS BIGINT) AS places, false AS on_cycle, true AS named FROM part")
def split_modules(spark, sf):
    """Of each file after the split: in how many modules it is, whether that is on a cycle, and whether it is named by its files."""
    state = _falling(spark, sf)
    done = passes.split(state)
    bad = graphs.cyclic_nodes(passes.module_edges(done)).select(F.col("node").alias("module"), F.lit(True).alias("on_cycle"))
    name = done.fragments.groupBy("module").agg(fn.module_name(F.collect_set("file")).alias("name"))
    of = done.fragments.join(bad, "module", "left").join(name, "module")
    return of.groupBy("file").agg(F.count("*").alias("places"), F.bool_or(F.coalesce("on_cycle", F.lit(False))).alias("on_cycle"), F.bool_and(F.startswith("module", F.col("name"))).alias("named"))


@query(f"{FINE}, reach AS (SELECT src, dst FROM mods UNION SELECT r.src, m.dst FROM reach r JOIN mods m ON m.src = r.dst), comp AS (SELECT a.src AS node, min(a.dst) AS component FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src), joined AS (SELECT coalesce(component, module) AS m, file FROM fragments LEFT JOIN comp ON node = module), named AS (SELECT m, list_sort(list(DISTINCT file)) AS fs FROM joined GROUP BY m) SELECT 'Module_' || substr(md5(array_to_string(fs, ',')), 1, 7) || CASE WHEN len(fs) = 1 THEN '_' || split_part(fs[1], '/', 2) ELSE '' END AS module, file FROM joined JOIN named USING (m)")
def merged_modules(spark, sf):
    return passes.merge(State(fragments(spark, sf, True), deps(spark, sf, True))).fragments


@query("WITH f AS (SELECT 'f' || p_partkey AS f, 'a' || p_partkey AS a, 'b' || p_partkey AS b, p_partkey AS k FROM part) SELECT f AS src, a AS dst FROM f UNION ALL SELECT a, b FROM f UNION ALL SELECT b, a FROM f WHERE k % 5 = 0 UNION ALL SELECT DISTINCT 'f' || greatest(a.l_partkey, b.l_partkey), 'f' || least(a.l_partkey, b.l_partkey) FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey")
def unlooped_includes(spark, sf):
    """Parts as files of brands, each with two files of no module behind it, of which every third leads back to it."""
    p = table(spark, sf, "part").select("p_partkey", *[_text(x, F.col("p_partkey")).alias(x) for x in "fab"])
    pair = lambda a, b, where="true": p.where(where).select(F.col(a).alias("src"), F.col(b).alias("dst"))
    u = _falling(spark, sf).deps.select(_text("f", F.col("dependee")).alias("src"), _text("f", F.col("dependency")).alias("dst"))
    e = pair("f", "a").unionByName(pair("a", "b")).unionByName(pair("b", "a", "p_partkey % 5 = 0")).unionByName(pair("b", "f", "p_partkey % 3 = 0")).unionByName(u)
    held = table(spark, sf, "part").select(F.col("p_brand").alias("module"), _text("f", F.col("p_partkey")).alias("file"))
    return graphs.without_external_cycles(e, held)


# ---- more of texts, names and sets


@query(f"{DENSE}, i AS (SELECT module, string_agg(line, chr(10) ORDER BY line) AS t FROM (SELECT DISTINCT src AS module, 'import ' || dst || ';' AS line FROM mods) GROUP BY module), c AS (SELECT module, string_agg(line, chr(10) ORDER BY line) AS t FROM (SELECT module, '#include \"' || file || '\"' AS line FROM fragments) GROUP BY module) SELECT c.module, 'export module FULL_NAME_' || c.module || ';' || chr(10) || coalesce(i.t || chr(10), '') || c.t AS text FROM c LEFT JOIN i ON i.module = c.module")
def module_texts(spark, sf):
    from .sources.writers import module_texts as texts

    f = fragments(spark, sf)
    return texts(f, rel.imports(uses(spark, sf), f))


@query(f"{_RENAMES_SQL} SELECT file || '##' || line || ':' || col || '##' || what || '##' || to_str AS value FROM r1 JOIN b1 USING (binding_id)")
def rename_lines(spark, sf):
    from .sources.writers import rename_lines as lines

    return lines(rename_directives(spark, sf))


@query("WITH n AS (SELECT doc_id AS file, unnest(range(len(string_split(text, chr(10))))) AS pos, text FROM documents), l AS (SELECT file, CAST(pos AS INTEGER) AS pos, string_split(text, chr(10))[pos + 1] AS line FROM n) SELECT file, pos, CASE WHEN starts_with(line, 'The') THEN 'Renamed' || substr(line, 4) ELSE line END AS line FROM l")
def renamed_source(spark, sf):
    from .sources.writers import renamed_lines

    lines = rel.numbered_lines(table(spark, sf, "documents").select(F.col("doc_id").alias("file"), "text"))
    every = lines.select("file", (F.col("pos") + 1).alias("line"), F.lit(1).alias("col"), F.lit("The").alias("from_str"), F.lit("Renamed").alias("to_str"))
    return renamed_lines(lines, every)


@query("SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path, regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '^.*/', '') AS name FROM pages")
def page_paths(spark, sf):
    path = F.regexp_replace(fn.strip_root(F.regexp_replace("url", "^[a-z]+:", ""), "\x00none"), "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", path.alias("path"), fn.file_name(path).alias("name"))


@query("SELECT o_orderkey, 'f' || o_orderkey || '.cpp,h' || (o_custkey % 50) || '.h,h' || (o_custkey % 7) || '.h' AS paths FROM orders")
def listed_dependencies(spark, sf):
    s = lambda c: c.cast("string")
    rule = F.concat(F.lit("__dummy: f"), s(F.col("o_orderkey")), F.lit(".cpp h"), s(F.col("o_custkey") % 50), F.lit(".h \\\n  h"), s(F.col("o_custkey") % 7), F.lit(".h\n"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(fn.make_dependencies(rule), ",").alias("paths"))


@query("SELECT DISTINCT file FROM (SELECT 'p' || p_partkey AS file FROM part UNION ALL SELECT 'p' || l_partkey FROM lineitem)")
def known_files(spark, sf):
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string")).alias("file")
    return rel.known_files(table(spark, sf, "part").select(name("p_partkey")), table(spark, sf, "lineitem").select(name("l_partkey")))


@query("SELECT DISTINCT p_brand AS module FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_retailprice > 1000)")
def allowed_buckets(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("module"), "p_size", "p_retailprice")
    return rel.without_rows(p.select("module").distinct(), p.where("p_size = 50 and p_retailprice > 1000"), "module")


@query(f"{_CYCLES} SELECT CAST(len(cycle) AS INTEGER) AS length, count(*) AS nodes FROM best GROUP BY ALL")
def shortest_cycle_length(spark, sf):
    return graphs.shortest_cycles(_edges(spark, sf)).groupBy(F.size("cycle").alias("length")).agg(F.count("*").alias("nodes"))


@query(f"{DENSE}, h AS (SELECT dependee AS file, max(to_module) AS new_module FROM placed WHERE kind = 'implements' AND CAST(dependency AS BIGINT) % 2 = 0 AND from_module <> to_module GROUP BY dependee) SELECT coalesce(new_module, module) AS module, f.file FROM fragments f LEFT JOIN h ON h.file = f.file")
def moved_fragments(spark, sf):
    return rel.apply_moves(fragments(spark, sf), implementation_moves(spark, sf))


@query(f"{_FILES}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, m.dst FROM reach r JOIN e m ON m.src = r.dst), cyc AS (SELECT src AS node FROM reach WHERE src = dst), good AS (SELECT node FROM nodes WHERE node NOT IN (SELECT node FROM cyc)), d AS MATERIALIZED (SELECT * FROM e WHERE src IN (SELECT node FROM good) AND dst IN (SELECT node FROM good)), l AS (SELECT node, 0 AS layer FROM good UNION SELECT d.src, layer + 1 FROM l JOIN d ON d.dst = l.node) SELECT node, CAST(max(layer) AS INTEGER) AS layer, false AS cyclic FROM l GROUP BY node UNION ALL SELECT node, -1, true FROM cyc")
def topological_order(spark, sf):
    e = cut(_files(spark, sf))
    order = graphs.topological_order(e.select(F.col("src").alias("node")).union(e.select("dst")), e)
    return order.withColumn("layer", F.coalesce("layer", F.lit(-1)))


@query(f"{_FILES}, way AS (SELECT dst AS src, src AS dst FROM e), {_HOPS}")
def dependee_levels(spark, sf):
    e = cut(_files(spark, sf))
    return graphs.levels(graphs.reversed_edges(e), e.select(F.col("dst").alias("node")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, coalesce(nullif(CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 's' || l_partkey END, ''), 'unnameable_decl_at__' || l_linenumber || '_' || (l_suppkey % 80)) AS name, 'm' || (l_suppkey % 9) || '_' || l_partkey AS token FROM lineitem")
def declared_names(spark, sf):
    s = lambda c: c.cast("string")
    name = F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("s"), s(F.col("l_partkey"))))
    token = fn.rename_token(F.concat(F.lit("m"), s(F.col("l_suppkey") % 9)), s(F.col("l_partkey")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fn.unnamed(name, F.col("l_linenumber"), (F.col("l_suppkey") % 80).cast("int")).alias("name"), token.alias("token"))


# ---- commands, paths and hosts


def _text(*parts: object) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("SELECT o_orderkey, 'a' || o_orderkey || '.h,b' || o_custkey AS files FROM orders")
def included_files(spark, sf):
    text = _text('#include "a', F.col("o_orderkey"), '.h"\nint x;\n#include <b', F.col("o_custkey"), ">\n#included\n #include late")
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(fn.included_files(text), ",").alias("files"))


@query("SELECT o_orderkey, 'g++|-DX=a b' || o_orderkey || '|-c|f' || o_custkey || '.cpp' AS words FROM orders")
def command_words(spark, sf):
    words = commands.shell_words(_text('g++ -DX="a b', F.col("o_orderkey"), "\" -c 'f", F.col("o_custkey"), ".cpp'"))
    return table(spark, sf, "orders").withColumn("split", words).select("o_orderkey", F.array_join("split", "|").alias("words"))


@query("SELECT o_orderkey, 'g++ -E -M -MT __dummy -O' || (o_orderkey % 4) || ' -c f' || o_custkey || '.cpp' AS command FROM orders")
def dependency_commands(spark, sf):
    words = F.array(F.lit("g++"), _text("-O", F.col("o_orderkey") % 4), F.lit("-o"), _text("f", F.col("o_custkey"), ".o"), F.lit("-MD"), F.lit("-MFx.d"), F.lit(""), F.lit("-c"), _text("f", F.col("o_custkey"), ".cpp"), F.lit("--gcc-toolchain=/opt"))
    return table(spark, sf, "orders").select("o_orderkey", words.alias("w")).withColumn("l", commands.dependency_command(F.col("w"))).select("o_orderkey", F.array_join("l", " ").alias("command"))


@query("SELECT o_orderkey, 'inc' || o_orderkey || ',sys' || o_custkey || ',q' AS paths FROM orders")
def search_paths(spark, sf):
    words = F.array(F.lit("g++"), _text("-Iinc", F.col("o_orderkey")), F.lit("-isystem"), _text("sys", F.col("o_custkey")), F.lit("-O2"), F.lit("-iquoteq"), F.lit("x.cpp"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(commands.search_paths(words), ",").alias("paths"))


@query("SELECT o_orderkey, o_orderkey % 3 <> 1 AS compiles, CASE WHEN o_orderkey % 2 = 0 THEN 'm-' || o_orderkey END AS module, 'src_a_' || o_orderkey AS named, round(100.0 * o_orderkey / (o_orderkey + o_custkey), 6) AS percent FROM orders")
def command_names(spark, sf):
    program = F.when(F.col("o_orderkey") % 3 == 0, "/usr/bin/g++-12 x").when(F.col("o_orderkey") % 3 == 1, "ld x").otherwise("my-clang y")
    line = F.when(F.col("o_orderkey") % 2 == 0, _text("export module FULL_NAME_m-", F.col("o_orderkey"), ";  ")).otherwise("export module other;")
    return table(spark, sf, "orders").select("o_orderkey", fn.is_compiler(program).alias("compiles"), fn.declared_module(line).alias("module"), fn.module_of_path(_text("./src/a-", F.col("o_orderkey"), ".cpp")).alias("named"), F.round(fn.percent(F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_custkey")), 6).alias("percent"))


@query("SELECT o_orderkey, 'h' || o_orderkey AS host, CAST(o_custkey % 9000 + 1 AS INTEGER) AS port, CAST(o_orderkey % 8 AS INTEGER) AS jobs FROM orders UNION ALL SELECT o_orderkey, 'local', 0, 4 FROM orders")
def build_hosts(spark, sf):
    text = _text("h", F.col("o_orderkey"), ":", F.col("o_custkey") % 9000 + 1, "/", F.col("o_orderkey") % 8, ", local/4,")
    return table(spark, sf, "orders").select("o_orderkey", F.explode(fn.hosts(text)).alias("h")).select("o_orderkey", "h.host", F.coalesce("h.port", F.lit(0)).alias("port"), "h.jobs")


@query("SELECT o_orderkey, o_totalprice > 100000 AS dear FROM orders")
def partitioned_orders(spark, sf):
    rest, dear = rel.partition(table(spark, sf, "orders"), F.col("o_totalprice") > 100000)
    return rest.select("o_orderkey", F.lit(False).alias("dear")).unionByName(dear.select("o_orderkey", F.lit(True).alias("dear")))


@query(f"{DENSE} SELECT DISTINCT d.dependee AS file, f.module FROM uses d JOIN fragments f ON f.file = d.dependee")
def modules_of_users(spark, sf):
    return rel.modules_of(uses(spark, sf).select(F.col("dependee").alias("file")).distinct(), fragments(spark, sf))


@query(f"{DENSE} SELECT dependee AS src, dependency AS dst FROM uses UNION SELECT dependee, dependency FROM impl")
def united_graph(spark, sf):
    e = lambda d: d.select(F.col("dependee").alias("src"), F.col("dependency").alias("dst"))
    return graphs.union_graphs(e(uses(spark, sf)), e(implements(spark, sf)))


@query(f"{DENSE} SELECT (SELECT count(*) FROM fragments WHERE module = 'Brand#11') + (SELECT count(*) FROM deps WHERE dependee = 'Brand#11') > 0 AS known")
def known_item(spark, sf):
    return rel.has_item(fragments(spark, sf), deps(spark, sf), "Brand#11")


@query(f"WITH {_random_sql('SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS module FROM lineitem', 24, 2)}, held AS (SELECT DISTINCT 'RandomModule_' || bucket AS module, l_partkey, l_suppkey FROM lineitem JOIN placed ON module = CAST(l_partkey AS VARCHAR)) SELECT module, 'export module {fn.NAME_MARK}' || module || ';' AS head, count(*) AS files FROM held GROUP BY ALL")
def random_modules(spark, sf):
    """How many of the fine facts' files each random module includes by its text."""
    from .sources.writers import module_texts as texts

    state = passes.random_modules(State(fragments(spark, sf, True), uses(spark, sf, True)), 24, 2)
    lines = texts(state.fragments, spark.createDataFrame([], "module string, dependency string")).withColumn("lines", F.split("text", "\n"))
    return lines.select("module", F.col("lines")[0].alias("head"), F.size(F.filter("lines", lambda x: x.startswith("#include"))).cast("long").alias("files"))


@query("SELECT count(DISTINCT p_name) AS modules, count(DISTINCT p_name) AS placed, true AS in_range FROM part")
def random_bucket_totals(spark, sf):
    got = random_buckets(spark, sf)
    return got.agg(F.countDistinct("module").alias("modules"), F.count("*").alias("placed"), F.bool_and(F.col("bucket").between(0, 23)).alias("in_range"))


@query("WITH e AS (SELECT DISTINCT l_orderkey AS entry, 'p' || (l_orderkey % 97) AS file, 'p' || (l_partkey % 997) AS header FROM lineitem), n AS (SELECT header, count(*) AS n FROM e WHERE header <> file GROUP BY header) SELECT CASE WHEN header = (SELECT min(header) FROM n) THEN '  ' ELSE ', ' END || '\"' || header || '\":' || n AS value FROM n UNION ALL SELECT '{' UNION ALL SELECT '}'")
def importance_map(spark, sf):
    from .sources.writers import importance_lines

    return importance_lines(header_inclusions(spark, sf), "header")


@query(f"{DENSE} SELECT '\"' || src || '\" -> \"' || dst || '\";' AS value FROM mods")
def drawn_imports(spark, sf):
    from .sources.writers import dot_lines

    return dot_lines(module_imports(spark, sf).toDF("src", "dst"))


# ---- declarations

_DECLS = """WITH decls AS (SELECT ['field', 'function', 'variable', 'record', 'typedef'][l_partkey % 5 + 1] AS kind, CASE WHEN l_returnflag = 'R' THEN 'internal' ELSE 'external' END AS linkage, l_linestatus = 'O' AS in_main_file, ['unit', 'namespace', 'record'][l_suppkey % 3 + 1] AS parent_kind, l_partkey % 7 = 0 AS is_inline, l_linenumber % 2 = 0 AS is_definition, l_suppkey % 3 = 2 AND l_partkey % 5 = 1 AS is_method, l_suppkey % 3 = 2 AND l_partkey % 10 = 1 AS is_ctor_dtor, l_partkey % 11 = 0 AS is_implicit, l_suppkey % 10 = 0 AS is_system, CASE WHEN l_partkey % 13 = 0 THEN '' ELSE 's' || l_partkey END AS name, 'f' || (l_orderkey % 100) AS file, l_linenumber AS begin_line, CAST(l_partkey % 80 AS INTEGER) AS begin_col, CASE WHEN l_suppkey % 4 <> 0 THEN 'h' || (l_suppkey % 20) END AS prev_file, l_suppkey % 6 = 0 AS prev_is_system, CASE l_partkey % 3 WHEN 0 THEN 'f' || (l_orderkey % 100) WHEN 1 THEN 'other' END AS def_file FROM lineitem),
d AS (SELECT *, linkage <> 'external' AND in_main_file AND parent_kind IN ('unit', 'namespace') AS internal, linkage = 'external' AND in_main_file AND parent_kind IN ('unit', 'namespace') AS visible, NOT is_definition OR coalesce(def_file <> file, false) AS forward FROM decls),
bad AS (SELECT * FROM d WHERE ((kind IN ('function', 'variable', 'record', 'typedef') AND internal) OR (kind = 'function' AND is_inline AND in_main_file AND NOT is_method)) AND NOT is_implicit AND (NOT is_method OR is_ctor_dtor) AND name <> '' AND in_main_file)"""


def _decls(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as declarations."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda c, *names: F.element_at(F.array(*map(F.lit, names)), (c % len(names) + 1).cast("int"))
    file = _text("f", F.col("l_orderkey") % 100)
    method = s % 3 == 2
    return table(spark, sf, "lineitem").select(
        pick(p, "field", "function", "variable", "record", "typedef").alias("kind"), F.when(F.col("l_returnflag") == "R", "internal").otherwise("external").alias("linkage"), (F.col("l_linestatus") == "O").alias("in_main_file"),
        pick(s, "unit", "namespace", "record").alias("parent_kind"), (p % 7 == 0).alias("is_inline"), (F.col("l_linenumber") % 2 == 0).alias("is_definition"), (method & (p % 5 == 1)).alias("is_method"), (method & (p % 10 == 1)).alias("is_ctor_dtor"),
        (p % 11 == 0).alias("is_implicit"), (s % 10 == 0).alias("is_system"), F.when(p % 13 == 0, "").otherwise(_text("s", p)).alias("name"), file.alias("file"), F.col("l_linenumber").alias("begin_line"), (p % 80).cast("int").alias("begin_col"),
        F.when(s % 4 != 0, _text("h", s % 20)).alias("prev_file"), (s % 6 == 0).alias("prev_is_system"), F.when(p % 3 == 0, file).when(p % 3 == 1, "other").alias("def_file"),
    )


@query(f"{_DECLS} SELECT file, begin_line, begin_col, name, kind FROM bad")
def problem_declarations(spark, sf):
    return analysis.problematic(_decls(spark, sf))


@query(f"{_DECLS} SELECT DISTINCT prev_file AS header, name AS symbol FROM d WHERE kind IN ('function', 'variable') AND visible AND prev_file <> file AND NOT prev_is_system")
def implemented_symbols(spark, sf):
    return analysis.implemented(_decls(spark, sf))


@query(f"{_DECLS} SELECT file, begin_line, begin_col, name, kind FROM d WHERE kind IN ('function', 'variable', 'record') AND parent_kind IN ('unit', 'namespace') AND forward AND NOT is_system AND name <> '' AND NOT (kind = 'function' AND in_main_file AND coalesce(def_file = file, false))")
def forward_declarations(spark, sf):
    return analysis.forwards(_decls(spark, sf))


@query(f"{_DECLS} SELECT file, begin_line, begin_col, name, kind FROM d WHERE linkage = 'external' AND parent_kind IN ('unit', 'namespace') AND NOT forward AND kind <> 'field' AND NOT is_method AND NOT is_system AND name <> ''")
def symbol_definitions(spark, sf):
    return analysis.definitions(_decls(spark, sf))


@query(f"{_DECLS}, refs AS (SELECT l_orderkey AS ref_line, l_linenumber AS ref_col, CASE WHEN l_suppkey % 2 = 0 THEN 's' || l_partkey ELSE 's' || (l_partkey + 1) END AS name, 'f' || (l_suppkey % 100) AS file FROM lineitem) SELECT r.* FROM refs r WHERE EXISTS (SELECT 1 FROM bad b WHERE b.name = r.name AND b.file = r.file)")
def problem_usages(spark, sf):
    """References by the name itself, or by an alias of the next part's."""
    line = table(spark, sf, "lineitem")
    name = F.when(F.col("l_suppkey") % 2 == 0, _text("s", F.col("l_partkey"))).otherwise(_text("alias", F.col("l_partkey")))
    refs = line.select(F.col("l_orderkey").alias("ref_line"), F.col("l_linenumber").alias("ref_col"), name.alias("name"), _text("f", F.col("l_suppkey") % 100).alias("file"))
    aliases = line.select(_text("alias", F.col("l_partkey")).alias("name"), _text("s", F.col("l_partkey") + 1).alias("target"))
    return analysis.usages(refs, _decls(spark, sf), aliases)


# ---- names by scope, earlier declarations

_SCOPES = "sd AS (SELECT DISTINCT file, 's' || (begin_col % 40) AS name, begin_line * 1000 + begin_col * 10 AS decl_line, [8192, 512, 32][begin_col % 3 + 1] AS w FROM d WHERE name <> ''), st AS (SELECT *, decl_line // w * w AS first_line, decl_line // w * w + w - 1 AS last_line FROM sd), sb AS (SELECT DISTINCT file, 's' || (begin_col % 40) AS name, begin_line * 1000 + begin_col * 10 AS decl_line FROM bad), sr AS (SELECT row_number() OVER () AS ref, l_orderkey, l_linenumber, l_partkey * 7 % 8000 AS ref_line, 's' || (l_suppkey % 40) AS name, 'f' || (l_orderkey % 100) AS file FROM lineitem), met AS (SELECT sr.*, decl_line, w, row_number() OVER (PARTITION BY ref ORDER BY first_line DESC, last_line, decl_line DESC) AS r FROM sr JOIN st ON st.file = sr.file AND st.name = sr.name AND ref_line BETWEEN first_line AND last_line)"


def _scoped(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """References in written types, declarations with a scope, scopes nested three deep, aliases."""
    col = F.col("begin_col")
    d = _decls(spark, sf).withColumns({"name": F.when(F.col("name") == "", "").otherwise(_text("s", col % 40)), "begin_line": (F.col("begin_line") * 1000 + col * 10).cast("int")})
    width = F.element_at(F.array(*map(F.lit, (8192, 512, 32))), (col % 3 + 1).cast("int"))
    first = F.floor(F.col("begin_line") / width).cast("int") * width
    d = d.withColumns({"width": width, "first_line": first}).withColumns({"scope": _text("w", F.col("width"), "_", F.col("first_line")), "last_line": F.col("first_line") + F.col("width") - 1})
    scopes = d.select("file", "scope", "first_line", "last_line").distinct()
    bare = _text("s", F.col("l_suppkey") % 40)
    written = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("const "), bare, F.lit(" &"))).when(F.col("l_linenumber") % 3 == 1, _text("Alias", F.col("l_suppkey") % 40, "<int>")).otherwise(bare)
    line = table(spark, sf, "lineitem")
    refs = line.select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 7 % 8000).cast("int").alias("ref_line"), written.alias("name"), _text("f", F.col("l_orderkey") % 100).alias("file"))
    aliases = line.select(_text("Alias", F.col("l_suppkey") % 40).alias("name"), F.concat(F.lit("struct "), bare, F.lit(" *[4]")).alias("target")).distinct()
    return refs, d.drop("width", "first_line", "last_line"), scopes, aliases


@query(f"{_DECLS}, {_SCOPES} SELECT l_orderkey, l_linenumber, m.ref_line, m.name, m.file, m.decl_line FROM met m JOIN sb ON sb.file = m.file AND sb.name = m.name AND sb.decl_line = m.decl_line WHERE r = 1")
def scoped_usages(spark, sf):
    refs, d, scopes, aliases = _scoped(spark, sf)
    return analysis.scoped_usages(refs, d, scopes, aliases).drop("decl_scope")


@query(f"{_DECLS}, {_SCOPES} SELECT sr.l_orderkey, sr.l_linenumber, sr.ref_line, sr.name, sr.file, coalesce(m.decl_line, -1) AS decl_line, coalesce('w' || w || '_' || (m.decl_line // w * w), '') AS decl_scope FROM sr LEFT JOIN (SELECT * FROM met WHERE r = 1) m USING (ref)")
def resolved_names(spark, sf):
    refs, d, scopes, aliases = _scoped(spark, sf)
    decls = d.where("name <> ''").select("file", "name", "scope", F.col("begin_line").alias("decl_line")).distinct()
    return analysis.resolved(analysis.unwrapped_types(refs, aliases), decls, scopes).withColumns({"decl_line": F.coalesce("decl_line", F.lit(-1)), "decl_scope": F.coalesce("decl_scope", F.lit(""))})


@query("WITH d AS (SELECT DISTINCT ['function', 'variable', 'record'][l_partkey % 3 + 1] AS kind, 's' || (l_partkey % 50) AS name, l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, 'f' || (l_suppkey % 20) AS file, l_suppkey % 20 = 3 AS is_system FROM lineitem) SELECT d.seq, d.file, arg_max(o.file, o.seq) AS prev_file, arg_max(o.is_system, o.seq) AS prev_is_system FROM d LEFT JOIN d o ON o.kind = d.kind AND o.name = d.name AND o.seq < d.seq AND o.file <> d.file GROUP BY d.kind, d.name, d.seq, d.file")
def previous_declarations(spark, sf):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kind = F.element_at(F.array(*map(F.lit, ("function", "variable", "record"))), (p % 3 + 1).cast("int"))
    d = table(spark, sf, "lineitem").select(kind.alias("kind"), _text("s", p % 50).alias("name"), (F.col("l_orderkey") * 1000000000 + p * 10000 + s).alias("seq"), _text("f", s % 20).alias("file"), (s % 20 == 3).alias("is_system")).distinct()
    return analysis.with_previous(d, stretch=10**12).select("seq", "file", "prev_file", "prev_is_system")


# ---- files written and read again


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4()}"


def _symbol_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of symbols; those of every fifth supplier are malformed."""
    k = F.col("l_partkey")
    ok = _text("p", k, "##", F.col("l_linenumber"), ":", k % 80, "##", F.col("l_linenumber") + 1, ":3##s", F.col("l_suppkey"))
    return table(spark, sf, "lineitem").select(F.when(F.col("l_suppkey") % 5 == 0, _text("p", k, "##x:1##s", F.col("l_suppkey"))).otherwise(ok).alias("value"))


_SYMBOLS = "SELECT DISTINCT 'p' || l_partkey AS file, l_linenumber AS begin_line, CAST(l_partkey % 80 AS INTEGER) AS begin_col, l_linenumber + 1 AS end_line, 3 AS end_col, 's' || l_suppkey AS symbol FROM lineitem WHERE l_suppkey % 5 <> 0"


@query(_SYMBOLS)
def read_definitions(spark, sf):
    at = _folder(spark)
    writers.write_fact_files(_symbol_lines(spark, sf), at, "definitions")
    return readers.definitions(spark, at)[0]


@query(_SYMBOLS)
def read_forward_declarations(spark, sf):
    """Read, written by the sink of symbols, and read again."""
    first, second = _folder(spark), _folder(spark)
    writers.write_fact_files(_symbol_lines(spark, sf), first, "forwarddeclarations")
    writers.write_fact_files(writers.symbol_lines(readers.forward_declarations(spark, first)[0]), second, "forwarddeclarations")
    return readers.forward_declarations(spark, second)[0]


@query("SELECT 'p' || l_partkey || '##x:1##s' || l_suppkey AS value FROM lineitem WHERE l_suppkey % 5 = 0")
def rejected_lines(spark, sf):
    at = _folder(spark)
    writers.write_fact_files(_symbol_lines(spark, sf), at, "definitions")
    return readers.definitions(spark, at)[1].select("value")


@query("SELECT DISTINCT 'p' || l_partkey || '.cpp' AS dependee, 'h' || (l_suppkey % 50) || '.h' AS dependency, 'implements' AS kind FROM lineitem")
def read_implements(spark, sf):
    at = _folder(spark)
    rows = table(spark, sf, "lineitem").select(_text("p", F.col("l_partkey"), ".cpp").alias("impl_file"), _text("h", F.col("l_suppkey") % 50, ".h").alias("header"), _text("s", F.col("l_linenumber")).alias("symbol"))
    writers.write_fact_files(writers.implements_lines(rows).unionByName(rows.limit(1).select(F.lit("malformed").alias("value"))), at, "implements")
    return readers.implements_deps(readers.implements(spark, at)[0])


@query(f"{_RENAMES_SQL} SELECT file, line, CAST(col AS INTEGER) AS col, what AS from_str, to_str FROM r1 JOIN b1 USING (binding_id)")
def read_renames(spark, sf):
    at = _folder(spark)
    writers.write_fact_files(rename_lines(spark, sf), at, "badsymbols")
    return readers.renames(spark, at)[0]


def _module_folder(spark: SparkSession, sf: str) -> str:
    """A module file for each brand; parts with a brand's number of their own are listed in another's too."""
    at = _folder(spark)
    f = fragments(spark, sf)
    twice = f.where(F.col("file").cast("long") % 7 == 0).select(F.lit("Brand#11").alias("module"), "file")
    held = f.unionByName(twice.join(f.where("module = 'Brand#11'").select("file"), "file", "left_anti").select("module", "file"))
    texts = writers.module_texts(held, rel.imports(uses(spark, sf), f)).withColumn("text", F.replace("text", F.lit("Brand#"), F.lit("Brand")))
    writers.write_named_files(texts.select(_text(F.regexp_replace("module", "[^A-Za-z0-9]", ""), ".cppm").alias("name"), "text"), at)
    return at


@query("SELECT replace(p_brand, '#', '') AS module, CAST(p_partkey AS VARCHAR) AS file, replace(p_brand, '#', '') || '.cppm' AS backing_file FROM part WHERE p_partkey % 7 <> 0 OR p_brand = 'Brand#11'")
def read_module_files(spark, sf):
    return readers.module_files(spark, _module_folder(spark, sf))[0].select("module", "file", "backing_file")


@query("SELECT DISTINCT replace(p_brand, '#', '') || '.cppm' AS file FROM part")
def listed_files(spark, sf):
    return readers.files(spark, _module_folder(spark, sf), "*.cppm")


@query("SELECT 'x' || (p_partkey % 10) || '/' || p_partkey AS file, CASE WHEN p_partkey % 3 = 0 THEN 'x' || (p_partkey % 10) || '/' || p_partkey ELSE 'src/x' || (p_partkey % 10) || '/' || p_partkey END AS found FROM part WHERE p_partkey % 3 < 2")
def existing_files(spark, sf):
    p = table(spark, sf, "part").select(_text("x", F.col("p_partkey") % 10, "/", F.col("p_partkey")).alias("file"), (F.col("p_partkey") % 3).alias("k"))
    listing = p.where("k = 0").select("file").unionByName(p.where("k < 2").select(F.concat(F.lit("src/"), "file").alias("file")))
    return readers.existing(p.select("file"), listing, "src")


@query("SELECT 'd' || (o_orderkey % 10) AS directory, 'f' || o_orderkey || '.cpp' AS file, CASE WHEN o_orderkey % 4 <> 0 THEN 'cc -DX=\"a b\" -c f' || o_orderkey || '.cpp' END AS command, CASE WHEN o_orderkey % 4 = 0 THEN 'cc|-c|f' || o_orderkey || '.cpp' END AS arguments FROM orders")
def read_commands(spark, sf):
    at, k = _folder(spark), F.col("o_orderkey")
    name = _text("f", k, ".cpp")
    entries = table(spark, sf, "orders").select(_text("d", k % 10).alias("directory"), F.when(k % 4 != 0, F.concat(F.lit('cc -DX="a b" -c '), name)).alias("command"), F.when(k % 4 == 0, F.array(F.lit("cc"), F.lit("-c"), name)).alias("arguments"), name.alias("file"))
    writers.write_compilation_database(entries, at)
    return readers.compilation_database(spark, at).select("directory", "file", "command", F.array_join("arguments", "|").alias("arguments"))


@query("WITH t AS (SELECT DISTINCT replace(p_brand, '#', '') AS b FROM part) SELECT b || '.cpp' AS file, i AS pos, CASE i WHEN 0 THEN '#include \"' || b || '.h\"' WHEN 1 THEN 'int ' || b || ';' WHEN 2 THEN '' ELSE 'é ' || b END AS line FROM t, (SELECT CAST(unnest(range(4)) AS INTEGER) AS i)")
def read_sources(spark, sf):
    at = _folder(spark)
    b = table(spark, sf, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("b")).distinct()
    writers.write_named_files(b.select(_text(F.col("b"), ".cpp").alias("name"), F.concat(F.lit('#include "'), "b", F.lit('.h"\r\nint '), "b", F.lit(";\n\né "), "b").alias("text")), at)
    got = readers.source_texts(spark, at, "*.cpp")
    # The writer ends each file's text with a new line, which begins one more.
    return got.where("pos < 4")


@query("SELECT DISTINCT p_brand AS module, CASE WHEN p_brand = 'Brand#11' THEN 'new' ELSE 'changed' END AS change FROM part WHERE p_brand = 'Brand#11' OR p_brand LIKE '%2' UNION ALL SELECT 'Gone', 'gone'")
def changed_modules(spark, sf):
    """What a second run writes, if before one module was not there, some had other files, and one more was there."""
    f = fragments(spark, sf)
    imported = rel.imports(uses(spark, sf), f)
    texts = cut(writers.module_texts(f, imported))
    before = texts.where("module <> 'Brand#11'").withColumn("text", F.when(F.col("module").like("%2"), F.concat("text", F.lit("\n// old"))).otherwise(F.col("text")))
    before = before.unionByName(spark.createDataFrame([("Gone", "text")], "module string, text string"))
    at = _folder(spark)
    writers.update_module_files(before, at)
    return writers.update_module_files(texts, at)
