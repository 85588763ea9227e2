"""The driver's tables as dependency facts, each over whole tables.

Coarse: parts are files, brands are modules. Fine: a part from one supplier is a file, parts are modules.
In both a file uses the one on the next line of its order, and implements it if the line was returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(fine: bool) -> Column:
    return F.concat_ws("/", "l_partkey", "l_suppkey") if fine else F.col("l_partkey").cast("string")


def fragments(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    if fine:
        return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("module"), _file(True).alias("file")).distinct()
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.col("p_partkey").cast("string").alias("file"))


def _next(spark: SparkSession, sf_dir: str, fine: bool, condition: str = "true") -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    a = line.where(condition).select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), _file(fine).alias("dependee"))
    b = line.select("l_orderkey", "l_linenumber", _file(fine).alias("dependency"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("dependee <> dependency").select("dependee", "dependency").distinct()


def uses(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    return _next(spark, sf_dir, fine).withColumn("kind", F.lit("uses"))


def implements(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    return _next(spark, sf_dir, fine, "l_returnflag = 'R'").withColumn("kind", F.lit("implements"))


def deps(spark: SparkSession, sf_dir: str, fine: bool = False) -> DataFrame:
    return uses(spark, sf_dir, fine).unionByName(implements(spark, sf_dir, fine))


def _file_sql(line: str, fine: bool) -> str:
    return f"{line}.l_partkey || '/' || {line}.l_suppkey" if fine else f"CAST({line}.l_partkey AS VARCHAR)"


def _next_sql(kind: str, fine: bool, condition: str = "true") -> str:
    a, b = _file_sql("a", fine), _file_sql("b", fine)
    return f"SELECT DISTINCT {a} AS dependee, {b} AS dependency, '{kind}' AS kind FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE {a} <> {b} AND {condition}"


def facts_sql(fine: bool = False) -> str:
    """The same facts as common table expressions: uses, impl, deps, fragments."""
    held = "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS module, l_partkey || '/' || l_suppkey AS file FROM lineitem" if fine else "SELECT p_brand AS module, CAST(p_partkey AS VARCHAR) AS file FROM part"
    returned = "a.l_returnflag = 'R'"
    return (
        f"WITH RECURSIVE uses AS MATERIALIZED ({_next_sql('uses', fine)}), impl AS ({_next_sql('implements', fine, returned)}), "
        f"deps AS (SELECT * FROM uses UNION ALL SELECT * FROM impl), fragments AS MATERIALIZED ({held}), "
        "placed AS (SELECT d.*, a.module AS from_module, b.module AS to_module FROM deps d JOIN fragments a ON a.file = d.dependee JOIN fragments b ON b.file = d.dependency), "
        "mods AS MATERIALIZED (SELECT DISTINCT from_module AS src, to_module AS dst FROM placed WHERE kind = 'uses' AND from_module <> to_module)"
    )
