"""What the corpus operators share: worker set-up, lineage cuts, flat text batches, components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.loops import cut, for_now, shared_folder, tidy  # noqa: F401

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Rows in one Arrow batch. Documents are long, so the default of 10,000 rows would be too many bytes.
BATCH_ROWS = 256


def on_workers(spark: SparkSession) -> None:
    """Python workers find this package (on a cluster it comes by --py-files or an image) and get small batches."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows of a few numbers that are broadcast, at most.
BROADCAST = 500_000


def bounded(df: DataFrame, most: int = BROADCAST) -> DataFrame:
    """df, to be broadcast if it has few rows (they are counted as far as the limit); else joined by a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as it takes not to be a column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def fold(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out. A null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 4, F.lit(2))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column, one after another, and where each begins (and the last ends)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_binary())
    _, offsets, data = col.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that their texts have about `most` bytes; one longer text stays whole."""
    for b in batches:
        at, held = 0, 0
        for i, n in enumerate(np.diff(flat(b.column(text))[1])):
            if held and held + n > most:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += int(n)
        if b.num_rows > at:
            yield b.slice(at)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node that can be reached, for each node of an edge.

    Min-label propagation with pointer jumping. Each round is two joins and a map-side combined
    min per node, so a node with very many links is split by AQE's skew join and never gathered.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    # First labels straight from the links.
    labels = cut(e.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = e.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = cut(step.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels
