import json

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import analysis, relational as rel
from weftgraph.plans import passes
from weftgraph.plans.model import State, run_pass
from weftgraph.sources import readers, writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_renames_first_wins_and_unbound_go(spark):
    r = spark.createDataFrame([("/main.cpp", 1, 1, 1, "Foo", 0), ("/main.cpp", 2, 1, 1, "Foo", 1), ("/main.cpp", 4, 1, 2, "Bar", 2), ("/main.cpp", 8, 20, 2, "Foo", 3), ("/main.cpp", 1, 1, 2, "Late", 4), ("/main.cpp", 9, 9, 7, "Free", 5)], "file string, line int, col int, binding_id int, what string, seq int")
    b = spark.createDataFrame([(1, "Foo", "main_Foo", 0), (2, "Bar", "main_Bar", 1), (2, "Bar", "other", 2)], "binding_id int, from_str string, to_str string, seq int")
    got = [x[0] for x in writers.rename_lines(rel.rename_rows(r, b)).collect()]
    assert got == ["/main.cpp##1:1##Foo##main_Foo", "/main.cpp##2:1##Foo##main_Foo", "/main.cpp##4:1##Bar##main_Bar", "/main.cpp##8:20##Foo##main_Bar"]


def test_text_facts_round_trip(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a-implements.txt").write_text("/main.cpp##/header.h##X\n/main.cpp##/usr/include/foo.h##foo::bar\nbroken\n\n")
    (tmp_path / "sub" / "b-definitions.txt").write_text("f.h##1:2##3:4##s\nf.h##x##3:4##s\n")
    (tmp_path / "c-badsymbols.txt").write_text("f.cpp##3:5##Foo##m_Foo\nf.cpp##3##Foo##m_Foo\n")
    (tmp_path / "c-forwarddeclarations.txt").write_text("f.h##1:2##3:4##s\nf.h##1:2##3:4##s\n")
    good, bad = readers.implements(spark, str(tmp_path))
    assert rows(good.select("impl_file", "header", "symbol")) == [("/main.cpp", "/header.h", "X"), ("/main.cpp", "/usr/include/foo.h", "foo::bar")] and bad.count() == 1
    good, bad = readers.definitions(spark, str(tmp_path))
    assert rows(good) == [("f.h", 1, 2, 3, 4, "s")] and rows(bad) == [("sub/b-definitions.txt", "f.h##x##3:4##s")]
    assert readers.forward_declarations(spark, str(tmp_path))[0].count() == 1
    good, bad = readers.renames(spark, str(tmp_path))
    lines = spark.createDataFrame([("f.cpp", 2, "int Foo; Foo"), ("f.cpp", 3, "x")], "file string, pos int, line string")
    assert rows(writers.renamed_lines(lines, good)) == [("f.cpp", 2, "int m_Foo; Foo"), ("f.cpp", 3, "x")] and bad.count() == 1
    assert "sub/b-definitions.txt" in {r[0] for r in readers.files(spark, str(tmp_path)).collect()}


def test_module_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.cppm").write_text('export module FULL_NAME_A;\n#include "x.h"\n#include "dup.h"\n')
    (tmp_path / "m" / "b.cppm").write_text('export module FULL_NAME_B;\n#include "dup.h"\n#include "y.h"\n')
    parts, many = readers.module_files(spark, str(tmp_path))
    assert rows(parts.select("module", "file")) == [("A", "m/x.h"), ("B", "m/y.h")] and rows(many) == [("m/dup.h", 2)]
    texts = writers.module_texts(parts, spark.createDataFrame([("A", "B")], "module string, dependency string"))
    assert rows(texts)[0] == ("A", 'export module FULL_NAME_A;\nimport B;\n#include "m/x.h"')
    writers.write_module_files(texts, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 5


def test_compilation_database_and_importance(spark, tmp_path):
    p = tmp_path / "compile_commands.json"
    p.write_text(json.dumps([{"directory": "/d", "command": "cc a.c", "file": "a.c"}, {"directory": "/d", "arguments": ["cc", "b.c"], "file": "b.c"}, {"directory": "/d", "command": "ld x.o", "file": "x.o"}]))
    c = readers.compilation_database(spark, str(p)).withColumn("entry", F.monotonically_increasing_id())
    out = c.select("entry", F.concat(F.lit("__dummy: "), "file", F.lit(" h.h g.h \\\n  h.h")).alias("output"))
    e = readers.importance_entries(c, out)
    assert rows(rel.inclusions(e)) == [("g.h", 1), ("h.h", 1)]
    assert rows(rel.includes_of_units(readers.importance_entries(c, out, accept_arguments=True))) == [("a.c", 2), ("b.c", 2)]
    writers.write_importance("headers", rel.inclusions(e), "header", str(tmp_path))
    assert spark.read.json(str(tmp_path / "headers")).count() == 2


def test_includes_resolve_in_order(spark):
    inc = spark.createDataFrame([("d/f.cpp", 0, "a.h"), ("d/f.cpp", 1, "b.h"), ("d/f.cpp", 2, "c.h"), ("f.cpp", 0, "a.h")], "file string, line int, target string")
    known = spark.createDataFrame([("a.h",), ("d/a.h",), ("d/b.h",), ("i/b.h",)], "file string")
    got = {(r["file"], r["target"]): r["resolved"] for r in rel.resolved_includes(inc, known, ["i"]).collect()}
    assert got == {("d/f.cpp", "a.h"): "a.h", ("d/f.cpp", "b.h"): "d/b.h", ("d/f.cpp", "c.h"): None, ("f.cpp", "a.h"): "a.h"}


def test_ordered_includes_and_removed_lines(spark):
    lines = spark.createDataFrame([("m", 0, '#include "b.h"'), ("m", 1, '#include "a.h"'), ("m", 2, "#include <v>")], "file string, pos int, line string")
    order = spark.createDataFrame([("m", "a.h", 0), ("m", "b.h", 1)], "file string, target string, rank int")
    assert [r[2] for r in rows(writers.ordered_includes(lines, order, r"\.h$"))] == ['#include "a.h"', '#include "b.h"', "#include <v>"]
    assert [r[1] for r in rows(rel.kept_lines(lines, lines.where("pos = 1")))] == [0, 2]
    assert rows(writers.texts_of(lines))[0][1].count("\n") == 2


def test_unknown_kind_is_an_error(spark):
    with pytest.raises(Exception, match="unknown kind"):
        rel.checked_kinds(spark.createDataFrame([("a", "b", "eats")], "dependee string, dependency string, kind string")).collect()


def test_insane_implementations_stop_the_run(spark):
    f = spark.createDataFrame([("M1", "a"), ("M2", "b"), ("M1", "h")], "module string, file string")
    d = spark.createDataFrame([("a", "h", "implements"), ("b", "h", "implements")], "dependee string, dependency string, kind string")
    assert rows(rel.insanity(d, f)) == [("h", "M1", ["a"]), ("h", "M2", ["b"])]
    with pytest.raises(ValueError):
        run_pass("check_implementations", State(f, d))


def test_split_and_merge_leave_no_cycle(spark):
    f = spark.createDataFrame([("M1", "a1"), ("M1", "a2"), ("M2", "b1"), ("M2", "b2"), ("M3", "c")], "module string, file string")
    d = spark.createDataFrame([("a1", "b1", "uses"), ("a2", "b1", "uses"), ("b2", "a1", "uses"), ("c", "a1", "uses")], "dependee string, dependency string, kind string")
    for name in ("split", "merge"):
        after = run_pass(name, State(f, d), threshold=8)
        assert after.timings[0][0] == name
        assert not passes.graphs.shortest_cycles(passes.module_edges(after)).count()
        assert rows(after.fragments.select("file")) == [("a1",), ("a2",), ("b1",), ("b2",), ("c",)]
    forwards = spark.createDataFrame([("c", "s")], "file string, symbol string")
    defs = spark.createDataFrame([("b1", "s")], "file string, symbol string")
    joined = run_pass("join_forward_declared", State(f, d, defs, forwards))
    of = {r["file"]: r["module"] for r in joined.fragments.collect()}
    assert of["c"] == of["b1"] != of["a1"]
    assert len(passes.timings(after, spark).collect()) == 1


def test_random_buckets_keep_every_module(spark):
    m = spark.createDataFrame([(f"m{i}",) for i in range(200)], "module string")
    got = rel.random_buckets(m, 8, 3)
    assert got.count() == 200 and got.select("module").distinct().count() == 200
    assert rows(got) == rows(rel.random_buckets(m, 8, 3)) and {r[1] for r in got.collect()} <= set(range(8))


def test_random_buckets_take_no_more_than_one_over_the_limit(spark):
    m = spark.createDataFrame([(f"m{i}",) for i in range(500)], "module string")
    plan = rel.bucket_plan(m, 40).first()
    most = plan["average"] + plan["overflow"]
    for seed in range(3):
        sizes = [r["count"] for r in rel.random_buckets(m, 40, seed).groupBy("bucket").count().collect()]
        assert sum(sizes) == 500 and max(sizes) <= most + 1
    assert rel.random_buckets(m, 1, 0).select("bucket").distinct().count() == 1
    assert rel.random_buckets(m.limit(0), 4, 0).count() == 0
    assert rel.random_buckets(m.limit(2), 4, 0).count() == 2
    assert [sorted(k * rel.stride(n) % n for k in range(n)) == list(range(n)) for n in (1, 2, 3, 10, 36)] == [True] * 5


def test_random_modules_keep_files(spark):
    f = spark.createDataFrame([(f"m{i % 30}", f"f{i}") for i in range(90)], "module string, file string")
    after = run_pass("random_modules", State(f, spark.createDataFrame([], "dependee string, dependency string, kind string")), buckets=4, seed=7)
    of = {r["file"]: r["module"] for r in after.fragments.collect()}
    assert len(of) == after.fragments.count() == 90 and set(of.values()) <= {f"RandomModule_{b}" for b in range(4)}
    assert all(of[f"f{i}"] == of[f"f{i + 30}"] for i in range(60))


DECLS = "kind string, linkage string, in_main_file boolean, parent_kind string, is_inline boolean, is_definition boolean, is_method boolean, is_ctor_dtor boolean, is_implicit boolean, is_system boolean, name string, file string, begin_line int, begin_col int, prev_file string, prev_is_system boolean, def_file string"


def decl(name, kind="function", linkage="external", main=True, parent="unit", definition=True, method=False, ctor=False, prev=None, def_file="/main.cpp", inline=False, file="/main.cpp"):
    return (kind, linkage, main, parent, inline, definition, method, ctor, False, False, name, file, 1, 10, prev, False, def_file)


def test_declaration_predicates(spark):
    d = spark.createDataFrame([
        decl("f", prev="/header.h"), decl("g", main=False, definition=False, file="/header2.h", def_file=None), decl("T", "typedef", "internal"), decl("s", linkage="internal"),
        decl("i2", "variable"), decl("~X", linkage="internal", method=True, ctor=True), decl("m", linkage="internal", method=True), decl("", linkage="internal"), decl("in", inline=True),
    ], DECLS)
    assert rows(analysis.implemented(d)) == [("/header.h", "f")]
    assert {(r["name"], r["begin_col"]) for r in analysis.problematic(d).collect()} == {("T", 10), ("s", 10), ("~X", 11), ("in", 10)}
    assert {r["name"] for r in analysis.forwards(d).collect()} == {"g"}
    assert {r["name"] for r in analysis.definitions(d).collect()} == {"f", "i2", "in"}
    refs = spark.createDataFrame([(1, 2, "s"), (3, 4, "f")], "ref_line int, ref_col int, name string")
    assert rows(analysis.usages(refs, d)) == [("s", 1, 2)]


def test_stream_of_facts(spark, tmp_path):
    from weftgraph.streaming.facts import append_facts, deps_stream

    (tmp_path / "in").mkdir()
    row = {"seen": "2024-01-01T00:00:00", "dependee": "a", "dependency": "b", "kind": "uses"}
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(row | {"dependency": x}) for x in "bcb"))
    append_facts(deps_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "t")).select("dependee", "dependency")) == [("a", "b"), ("a", "c")]
