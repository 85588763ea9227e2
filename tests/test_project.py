"""A folder of sources and facts from one end to the other."""

import json

import pytest

from weftgraph.operators import analysis, graphs
from weftgraph.plans import project
from weftgraph.plans.model import PASSES
from weftgraph.sources import writers


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def folder(tmp_path):
    files = {
        "a.h": '#include "b.h"\n#include <ext.h>\nint Foo;\n',
        "b.h": "int b;\n",
        "c.h": '#include "a.h"\nint c;\n',
        "d.h": "int d;\n",
        "ext.h": '#include "d.h"\n',
        "a.cpp": '#include "a.h"\n#include "sub.h"\nint a() { return Foo + Foo; }\n',
        "inc/sub.h": "int sub;\n",
        "x.cppm": 'export module FULL_NAME_X;\n#include "a.h"\n#include "b.h"\n#include "d.h"\n#include "inc/sub.h"\n',
        "y.cppm": 'export module FULL_NAME_Y;\n#include "c.h"\n#include "a.cpp"\n',
        "a-implements.txt": "a.cpp##a.h##a\n",
        "a-definitions.txt": "a.h##1:1##1:4##s\n",
        "a-forwarddeclarations.txt": "d.h##1:1##1:4##s\n",
        "a-badsymbols.txt": "a.cpp##3:18##Foo##a_Foo\na.cpp##3:24##Foo##a_Foo\na.cpp##1:1##Bar##a_Bar\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "compile_commands.json").write_text(json.dumps([{"directory": str(tmp_path), "command": "cc -Iinc -I other -c a.cpp", "file": "a.cpp"}]))
    return tmp_path


def test_a_run_from_a_folder(spark, folder, tmp_path):
    out = tmp_path / "out"
    done = project.run(spark, str(folder), str(out), str(folder / "compile_commands.json"))
    assert done.include_paths == ("inc", "other")
    deps = {(r[0], r[1], r[2]) for r in done.deps.collect()}
    assert deps == {("a.h", "b.h", "uses"), ("c.h", "a.h", "uses"), ("a.cpp", "a.h", "uses"), ("a.cpp", "inc/sub.h", "uses"), ("a.cpp", "a.h", "implements")}
    assert rows(done.external) == [("a.h", "ext.h"), ("ext.h", "d.h")]
    of = {r["file"]: r["module"] for r in done.fragments.collect()}
    assert of["a.cpp"] == of["a.h"] == of["inc/sub.h"] != of["c.h"]
    assert not graphs.shortest_cycles(project.passes.module_edges(done)).count()
    texts = dict(rows(done.module_texts))
    lines = texts[of["a.h"]].split("\n")
    assert lines[0].startswith("export module FULL_NAME_") and lines[-1] == '#include "a.cpp"'
    # b.h by an include, d.h through a file of no module.
    assert max(lines.index('#include "b.h"'), lines.index('#include "d.h"')) < lines.index('#include "a.h"')
    kept = {r["file"]: r["text"] for r in spark.read.json(str(out / "sources")).collect()}
    assert kept["a.h"].startswith("#include <ext.h>\nint Foo;") and kept["a.cpp"].startswith("int a() { return a_Foo + a_Foo; }")
    listed = [r[0] for r in spark.read.text(str(out / "module-list")).collect()]
    assert len([x for x in listed if x.startswith("set_module(")]) == len(set(of.values()))
    assert [t[0] for t in done.timings] == [*project.ORDER, *project.OUTPUT] and set(project.ORDER) <= set(PASSES)


def test_a_dry_run_writes_nothing(spark, folder):
    before = sorted(p.name for p in folder.rglob("*"))
    done = project.run(spark, str(folder))
    assert done.module_texts is None and sorted(p.name for p in folder.rglob("*")) == before


def test_files_on_a_cycle_come_last_and_keep_their_lines(spark, tmp_path):
    for name, text in {"p.h": '#include "q.h"\n', "q.h": '#include "p.h"\n', "r.h": '#include "p.h"\nint r;\n', "m.cppm": 'export module FULL_NAME_M;\n#include "p.h"\n#include "q.h"\n#include "r.h"\n#include "z.h"\n', "z.h": "int z;\n"}.items():
        (tmp_path / name).write_text(text)
    done = project.run(spark, str(tmp_path), str(tmp_path / "out"))
    assert rows(done.cyclic_files) == [("p.h",), ("q.h",)]
    text = done.module_texts.first()["text"].split("\n")
    assert text[1:] == ['#include "r.h"', '#include "z.h"', '#include "p.h"', '#include "q.h"']
    kept = {r["file"]: r["text"] for r in spark.read.json(str(tmp_path / "out" / "sources")).collect()}
    assert "#include" in kept["p.h"] and "#include" not in kept["r.h"]


def test_importance_maps_are_json(spark, tmp_path):
    counts = spark.createDataFrame([("b", 2), ('a"x', 1), ("c", 3)], "header string, n long")
    text = "\n".join(r[0] for r in writers.importance_lines(counts, "header").collect())
    assert json.loads(text) == {'a"x': 1, "b": 2, "c": 3} and text.index("a") < text.index('"b"')
    assert json.loads("\n".join(r[0] for r in writers.importance_lines(counts.limit(0), "header").collect())) == {}
    assert rows(writers.dot_lines(spark.createDataFrame([("a", 'b"')], "src string, dst string"))) == [('"a" -> "b\\"";',)]
    made = []
    make = lambda: made.append(1) or counts
    for again in (False, False, True):
        assert project.cached(spark, str(tmp_path / "facts"), make, again).count() == 3
    assert len(made) == 2


def test_layers_of_a_cycle_are_an_error(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "src string, dst string")
    with pytest.raises(ValueError, match="cycle"):
        graphs.layers(e.selectExpr("src AS node"), e)


def test_previous_declarations_and_aliases(spark):
    d = spark.createDataFrame([(1, "function", "f", "h.h", False), (2, "function", "f", "g.h", True), (3, "function", "f", "m.cpp", False), (4, "function", "f", "m.cpp", False)], "seq int, kind string, name string, file string, is_system boolean")
    assert rows(analysis.with_previous(d).select("seq", "prev_file", "prev_is_system")) == [(1, None, None), (2, "h.h", False), (3, "g.h", True), (4, "g.h", True)]
    refs = spark.createDataFrame([(1, "A"), (2, "T")], "ref_line int, name string")
    alias = spark.createDataFrame([("A", "B"), ("B", "T")], "name string, target string")
    assert rows(analysis.unwrapped(refs, alias).select("ref_line", "name")) == [(1, "T"), (2, "T")]
    with pytest.raises(RecursionError):
        analysis.unwrapped(refs, spark.createDataFrame([("A", "A")], "name string, target string"))


def test_previous_declarations_of_a_hot_name(spark):
    """Random runs of files, one name for nearly all, in stretches of 16: as brute force; and no join by name alone."""
    import random

    rng = random.Random(4)
    d, file = [], "a"
    for seq in range(400):
        file = rng.choice("abc") if rng.random() < 0.2 else file
        d.append((seq * 3 - 200, "function", "f" if rng.random() < 0.9 else "g", file, file == "b"))
    want = []
    for seq, kind, name, file, _ in d:
        before = [x for x in d if x[:1] < (seq,) and x[1:3] == (kind, name) and x[3] != file]
        want.append((seq, *(max(before)[3:] if before else (None, None))))
    df = spark.createDataFrame(d, "seq long, kind string, name string, file string, is_system boolean")
    got = analysis.with_previous(df, stretch=16)
    assert rows(got.select("seq", "prev_file", "prev_is_system")) == sorted(want)
    big = analysis.with_previous(df).select("seq", "prev_file", "prev_is_system")
    assert rows(big) == sorted(want)
    # A window a stretch of a name; joins have one row for each on a side.
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert analysis.with_previous(df.limit(0)).count() == 0


def test_names_mean_the_innermost_declaration(spark):
    scopes = spark.createDataFrame([("m.cpp", "unit", 0, 99), ("m.cpp", "fn", 10, 20), ("m.cpp", "block", 12, 14), ("n.cpp", "unit", 0, 9)], "file string, scope string, first_line int, last_line int")
    decls = spark.createDataFrame([("m.cpp", "x", "unit", 1), ("m.cpp", "x", "block", 12), ("m.cpp", "y", "fn", 11), ("n.cpp", "x", "unit", 3)], "file string, name string, scope string, decl_line int")
    refs = spark.createDataFrame([("m.cpp", n, r) for n, r in (("x", 5), ("x", 10), ("x", 13), ("x", 14), ("x", 15), ("y", 9), ("y", 20), ("y", 21), ("z", 13))] + [("n.cpp", "x", 9), ("n.cpp", "x", 10), (None, "x", 1), ("m.cpp", None, 3)], "file string, name string, ref_line int")
    got = {(r["file"], r["name"], r["ref_line"]): r["decl_line"] for r in analysis.resolved(refs, decls, scopes).collect()}
    assert got == {("m.cpp", "x", 5): 1, ("m.cpp", "x", 10): 1, ("m.cpp", "x", 13): 12, ("m.cpp", "x", 14): 12, ("m.cpp", "x", 15): 1, ("m.cpp", "y", 9): None, ("m.cpp", "y", 20): 11, ("m.cpp", "y", 21): None, ("m.cpp", "z", 13): None, ("n.cpp", "x", 9): 3, ("n.cpp", "x", 10): None, (None, "x", 1): None, ("m.cpp", None, 3): None}


def test_types_in_wrappers(spark):
    from pyspark.sql import functions as F

    cases = {"const Foo &": "Foo", "Foo": "Foo", "struct a::Foo *const": "a::Foo", "volatile Foo[3][4]": "Foo", "std::vector<Foo *>": "std::vector", "unsigned  int&&": "unsigned int", "structure": "structure"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", analysis.bare_type(F.col("t"))).collect()} == cases
    refs = spark.createDataFrame([(1, "const A &"), (2, "B *"), (3, "A *const")], "ref_line int, name string")
    alias = spark.createDataFrame([("A", "const B *"), ("B", "struct T[2]")], "name string, target string")
    assert rows(analysis.unwrapped_types(refs, alias).select("ref_line", "name")) == [(1, "T"), (2, "T"), (3, "T")]


def test_only_what_changed_is_written(spark, tmp_path):
    at = str(tmp_path / "modules")
    texts = lambda **t: spark.createDataFrame(sorted(t.items()), "module string, text string")
    stamp = lambda: {str(p.relative_to(at)): p.stat().st_mtime_ns for p in sorted((tmp_path / "modules").rglob("part-*.txt"))}
    read = lambda: {p.parent.name: p.read_text() for p in (tmp_path / "modules").rglob("part-*.txt")}
    assert rows(writers.update_module_files(texts(A="a", B="b", **{"x/y #1": "c"}), at)) == [("A", "new"), ("B", "new"), ("x/y #1", "new")]
    first = stamp()
    assert rows(writers.update_module_files(texts(A="a", B="b", **{"x/y #1": "c"}), at)) == [] and stamp() == first
    assert rows(writers.update_module_files(texts(A="a", B="b2"), at)) == [("B", "changed"), ("x/y #1", "gone")]
    assert read() == {"module=A": "a\n", "module=B": "b2\n"} and {k: v for k, v in stamp().items() if "module=A" in k} == {k: v for k, v in first.items() if "module=A" in k}
    assert rows(writers.update_module_files(texts(A="a", B="b2").limit(0), at)) == [("A", "gone"), ("B", "gone")] and read() == {}


def test_fact_files_are_found_again(spark, tmp_path):
    from weftgraph.sources import readers

    writers.write_fact_files(spark.createDataFrame([("a.cpp##h.h##s",), ("bad",)], "value string"), str(tmp_path), "implements")
    assert all(p.name.endswith("-implements.txt") for p in tmp_path.iterdir() if not p.name.startswith("."))
    good, bad = readers.implements(spark, str(tmp_path))
    assert rows(good) == [("a.cpp", "h.h", "s")] and [r["value"] for r in bad.collect()] == ["bad"]
    writers.write_named_files(spark.createDataFrame([("é ü.cppm", "export module FULL_NAME_M;\n#include \"a\"")], "name string, text string"), str(tmp_path / "m"))
    assert rows(readers.module_files(spark, str(tmp_path / "m"))[0].select("module", "file", "backing_file")) == [("M", "a", "é ü.cppm")]


def test_descent_through_files_of_no_module(spark):
    """Random includes with cycles among files of no module, against a walk from each file."""
    import random

    rng = random.Random(11)
    names = [f"m{i}" for i in range(8)] + [f"x{i:02}" for i in range(20)]
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(60)}
    after = {n: {b for a, b in edges if a == n} for n in names}
    want = set()
    for start in names[:8]:
        todo, seen = set(after[start]), set()
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo |= after[n] if n.startswith("x") else set()
        want |= {(start, n) for n in seen if n.startswith("m") and n != start}
    f = spark.createDataFrame([("M", n) for n in names[:8]], "module string, file string")
    got = project.through_external(spark.createDataFrame(sorted(edges), "src string, dst string"), f)
    assert rows(got) == sorted(want) and len(want) > 20
    assert project.through_external(spark.createDataFrame([], "src string, dst string"), f).count() == 0
