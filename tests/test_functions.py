import pytest
from pyspark.sql import functions as F

from weftgraph.functions import commands, text as fn


def value(spark, column, **cols):
    names = list(cols)
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for n, v in cols.items()))
    assert names
    return df.select(column.alias("v")).first()[0]


@pytest.mark.parametrize("cycle,want", [
    (["SystemPath", "SystemFail"], ["SystemFail", "SystemPath"]), (["Foo", "Baz", "Bar"], ["Bar", "Foo", "Baz"]), (["Foo", "Asd"], ["Asd", "Foo"]),
    (["BOne", "BTwo", "AOne"], ["AOne", "BOne", "BTwo"]), (["ZLast", "XSystem", "NFoobar"], ["NFoobar", "ZLast", "XSystem"]), (["D", "C", "B", "A"], ["A", "D", "C", "B"]), ([], []),
])
def test_rotation(spark, cycle, want):
    assert value(spark, fn.rotated(F.col("c")), c=cycle) == want


def test_include_lines(spark):
    rows = spark.createDataFrame([('#include "a/b.h"',), ("#include <vector>",), ('#include"x.h"',), (' #include "no.h"',), ("int x;",)], "l string").select(fn.include_target(F.col("l"))).collect()
    assert [r[0] for r in rows] == ["a/b.h", "vector", "x.h", None, None]
    assert value(spark, fn.included_files(F.col("t")), t='#include "a.h"\n#include"b.h"\nx\n#include <c>') == ["a.h", "c"]
    assert value(spark, fn.include_target(fn.include_directive(F.col("f"))), f="q/r.h") == "q/r.h"


def test_paths_and_names(spark):
    assert value(spark, fn.strip_root(F.col("p"), "/r/s"), p="/r/s/a/r/s/b.h") == "a/b.h"
    assert value(spark, fn.rename_prefix(F.col("p")), p="x/1-a.b.cpp") == "_-a_b".replace("-", "_")
    assert value(spark, fn.rename_prefix(F.col("p")), p="/main.cpp") == "main"
    assert value(spark, fn.stem(F.col("p")), p="a/.hidden") == ".hidden"
    assert value(spark, fn.declared_module(F.col("l")), l="export module FULL_NAME_a-b_1;  ") == "a-b_1"
    assert value(spark, fn.declared_module(F.col("l")), l="int FULL_NAME_x;") is None
    assert value(spark, fn.make_dependencies(F.col("t")), t="__dummy: a.cpp \\\n  b.h c.h\n") == ["a.cpp", "b.h", "c.h"]
    one = value(spark, fn.module_name(F.col("f")), f=["d/a.h"])
    assert one.startswith("Module_") and one.endswith("_a") and value(spark, fn.module_name(F.col("f")), f=[]) is None
    assert value(spark, fn.module_name(F.col("f")), f=["b", "a"]) == value(spark, fn.module_name(F.col("f")), f=["a", "b"])
    assert value(spark, fn.unnamed(F.col("n"), F.lit(3), F.lit(4)), n="") == "unnameable_decl_at__3_4"


def test_symbol_rows_reject_what_is_malformed(spark):
    ok = value(spark, fn.symbol_row(F.col("l")), l="f.h##1:2##3:4##ns::s")
    assert tuple(ok) == ("f.h", 1, 2, 3, 4, "ns::s")
    for bad in ("f.h##1:2##3:4", "f.h##1:x##3:4##s", "f.h##12##3:4##s", ""):
        assert value(spark, fn.symbol_row(F.col("l")), l=bad) is None


def test_replace_only_where_it_stands(spark):
    f = lambda line, col, a, b: value(spark, fn.replace_at(F.col("l"), F.col("c"), F.col("a"), F.col("b")), l=line, c=col, a=a, b=b)
    assert f("int Foo = Foo;", 5, "Foo", "m_Foo") == "int m_Foo = Foo;" and f("int Foo;", 4, "Foo", "x") == "int Foo;"


def test_commands(spark):
    without = lambda w: value(spark, commands.without_option(F.col("w"), "-o", True), w=w)
    assert without(["cc", "-o", "x", "-c", "-oy"]) == ["cc", "-c"]
    assert without(["-ox", "-oy"]) == ["-ox", "-oy"]
    assert without(["cc", "-openmp"]) == ["cc"]
    # A second option is the first one's value, not an option with a value of its own.
    assert without(["cc", "-o", "-o", "x"]) == ["cc", "x"]
    assert value(spark, commands.dependency_command(F.col("w")), w=["g++", "-c", "a.cpp", "-o", "a.o", "-MF", "d", ""]) == ["g++", "-E", "-M", "-MT", "__dummy", "-c", "a.cpp"]
    assert value(spark, commands.dependency_command(F.filter(F.col("w"), lambda x: x == "none")), w=["g++"]) is None


def test_shell_words_are_the_librarys(spark):
    """Random strings of quotes, escapes and blanks, and words of many thousand pieces, against shlex."""
    import random
    import shlex

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", '"', "'", "\\", "\n", "\t", "-o", "é", "$"]) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["'" + "a" * 200_000 + "' " + '"b\\"' * 40_000 + 'c"', "", "x" * 500_000 + "'"]

    def words(t):
        try:
            return shlex.split(t)
        except ValueError:
            return None

    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string").select("i", commands.shell_words(F.col("c")).alias("w"))
    got = {r["i"]: r["w"] for r in df.collect()}
    assert [got[i] for i in range(len(texts))] == list(map(words, texts))
    assert "Python" not in df._jdf.queryExecution().toString() and "ArrowEval" not in df._jdf.queryExecution().toString()


def test_search_paths_and_words(spark):
    df = spark.createDataFrame([("cc -Iinc -I sub '-isystem' \"a b\" x-Iy",), ("cc 'open",), (None,)], "c string")
    got = df.select(commands.shell_words("c").alias("w")).select(commands.search_paths(F.col("w")).alias("p")).collect()
    assert [r[0] for r in got] == [["inc", "sub", "a b"], None, None]
