"""Quality: a document classifier's evidence, shrunk through host and path posteriors (empirical Bayes).

Each document's evidence is a logistic regression on square roots of byte-gram shares. Hosts and paths
(a path belongs to a host) get posterior means of quality: a path's mean is shrunk toward its host's,
a host's toward the corpus mean, with prior strengths estimated from the spread between groups; so a
sparse site stays near its prior. A document's score joins its own log-odds with its path's.

Null text counts as empty; null hosts and paths are groups of their own. With no labelled row, or one
class only, evidence is 0.5 for all. A score of exactly REJECT is kept. Repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, flat, fresh, on_workers, slices

BUCKETS = 1 << 11
#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 1500
ROUNDS, RATE, DECAY = 150, 0.1, 1e-4
#: Documents scoring less are rejected.
REJECT = 0.5
#: Rows of posteriors (five values each) that are broadcast, at most; more are joined by a shuffle.
BROADCAST = 200_000
#: Bounds of a prior's strength, in documents.
WEAKEST, STRONGEST = 1.0, 1e6


def features(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text: square roots of its byte grams' shares, and shares of kinds of bytes."""
    n = len(starts) - 1
    size = np.diff(starts)
    doc = np.repeat(np.arange(n), size)
    kind = _KIND[data]
    x = kind.astype(np.uint32)
    v = np.concatenate([x, np.zeros(2, np.uint32)])
    gram = ((v[:-2] | v[1:-1] << np.uint32(8) | v[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(21)
    counts = np.bincount(doc * BUCKETS + gram[: len(doc)], minlength=n * BUCKETS).reshape(n, BUCKETS)
    kinds = np.stack([np.bincount(doc, weights=_KINDS[k][data], minlength=n) for k in range(len(_KINDS))], axis=1)
    held = np.maximum(size, 1)[:, None]
    return np.concatenate([np.sqrt(counts / held), np.sqrt(kinds / held), np.log1p(size)[:, None] / 10, np.ones((n, 1))], axis=1).astype(np.float32)


_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("A") : ord("Z") + 1] += 32
_KIND[ord("0") : ord("9") + 1] = ord("0")
_ALL = np.arange(256)
_LETTER = (_ALL >= 0x80) | ((_ALL | 32 >= ord("a")) & (_ALL | 32 <= ord("z")))
_BLANK = np.isin(_ALL, [0x20, *range(9, 14)])
_DIGIT = (_ALL >= 0x30) & (_ALL <= 0x39)
_KINDS = np.stack([_LETTER, _BLANK, _DIGIT, ~(_LETTER | _BLANK | _DIGIT)]).astype(np.float64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        f = features(*flat(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([r.tobytes() for r in f], pa.binary())], ["doc_id", "quality", "f"])


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """The classifier's weights, fitted on at most SAMPLE rows of each class; its last weight is the bias."""
    on_workers(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct()
    some = [rows.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    both = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * SAMPLE rows of two numbers
    got = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(both, "doc_id").mapInArrow(_featured, "doc_id long, quality int, f binary").toPandas().sort_values(["doc_id", "f"])
    weights = np.zeros(BUCKETS + len(_KINDS) + 2, np.float32)
    sizes = {r[0]: r[1] for r in rows.groupBy("quality").count().collect()}
    if got.quality.nunique() < 2:
        return weights
    x = np.frombuffer(b"".join(got.f), np.float32).reshape(len(got), -1)
    y = got.quality.to_numpy().astype(np.float32)
    m, s = np.zeros_like(weights), np.zeros_like(weights)
    rate = sizes[1] / (sizes[0] + sizes[1])  # the sample is even, the labelled rows need not be
    balance = np.where(y > 0, rate / y.mean(), (1 - rate) / (1 - y.mean())).astype(np.float32)
    for step in range(1, ROUNDS + 1):
        p = 1 / (1 + np.exp(-(x @ weights)))
        g = x.T @ ((p - y) * balance) / len(y) + DECAY * weights
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        weights -= np.float32(RATE) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-8))
    return weights


def with_evidence(docs: DataFrame, weights: np.ndarray, text: str = "text", evidence: str = "evidence") -> DataFrame:
    """docs with the classifier's probability of good quality, within (0.001, 0.999)."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(weights)
    out = T.StructType([*docs.drop(evidence).schema.fields, T.StructField(evidence, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            z = (features(*flat(b.column(text))) @ shared.value).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((1 / (1 + np.exp(-z))).clip(0.001, 0.999))], out.names)

    return docs.drop(evidence).mapInArrow(run, out)


def posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, host_mean, path_mean, base): from columns host, path and evidence.

    Evidence is summed for each path where it lies (map-side) and only sums are shuffled, so a host
    with a third of all documents is one row of each task. Hosts are then sums of paths.
    """
    p = F.col("evidence")
    # Kept first, as all that follows reads these sums; the evidence is computed once.
    paths = cut(evidence.groupBy("host", "path").agg(F.sum(p).alias("s"), F.count(p).alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))

    def strength(groups: DataFrame, s: str, n: str, m: Column) -> DataFrame:
        """Documents that the prior weighs: the variance within over that between groups' means."""
        within = m * (1 - m)
        spread = F.avg(F.pow(F.col(s) / F.col(n) - m, 2)) - F.avg(within / F.col(n))
        return groups.agg(F.coalesce(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.avg(within) / F.greatest(spread, F.lit(1e-9)))), F.lit(STRONGEST)).alias("k"))

    base = hosts.agg(F.coalesce(F.sum("hs") / F.sum("hn"), F.lit(0.5)).alias("base"))
    based = hosts.crossJoin(F.broadcast(base))  # one row
    host_k = strength(based, "hs", "hn", F.col("base")).withColumnRenamed("k", "hk")
    host_mean = (F.col("hs") + F.col("hk") * F.col("base")) / (F.col("hn") + F.col("hk"))
    h = based.crossJoin(F.broadcast(host_k)).select("host", "base", host_mean.alias("host_mean"))  # one row
    both = paths.join(h.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).drop("of")
    path_k = strength(both, "s", "n", F.col("host_mean")).withColumnRenamed("k", "pk")
    path_mean = (F.col("s") + F.col("pk") * F.col("host_mean")) / (F.col("n") + F.col("pk"))
    return both.crossJoin(F.broadcast(path_k)).select("host", "path", "base", "host_mean", path_mean.alias("path_mean"))  # one row


def host_of(url: Column) -> Column:
    """A URL's host in lower case; what has no scheme is a host already."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """A URL's host and first directory."""
    return F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*(?:/[^/?#]*)?)", 1))


#: Columns that classify adds; those of docs with these names are left out.
ADDED = ["host", "path", "evidence", "base", "host_mean", "path_mean", "quality_score", "keep", "of_host", "of_path"]


def kept(docs: DataFrame, weights: np.ndarray, host: Column, path: Column) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs whatever their names."""
    clash = {c: new for c in docs.columns if c.lower() in ADDED for new in fresh(docs, c + "_own")}
    held = docs.withColumns({new: F.col(c) for c, new in clash.items()}) if clash else docs
    scored = classify(held, weights, host, path)
    return scored.where("keep").select(*[F.col(clash[c]).alias(c) if c in clash else F.col(c) for c in docs.columns])


def classify(docs: DataFrame, weights: np.ndarray, host: Column, path: Column) -> DataFrame:
    """docs with evidence, host_mean, path_mean, quality_score and keep.

    The evidence is computed once for the posteriors, from the text alone, and once more for the
    rows themselves: that reads the input twice, but no text is shuffled as long as there are at most
    BROADCAST paths; beyond that a sort-merge join takes over, whose hot paths Spark can split.
    """
    held = docs.drop(*ADDED).withColumn("host", host).withColumn("path", path)
    post = posteriors(with_evidence(held.select("text", "host", "path"), weights).drop("text"))
    post = cut(post.withColumnRenamed("host", "of_host").withColumnRenamed("path", "of_path"))
    post = F.broadcast(post) if post.count() <= BROADCAST else post
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-6)) / F.greatest(1 - p, F.lit(1e-6)))
    scored = with_evidence(held, weights).join(post, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path"))).drop("of_host", "of_path")
    z = odds(F.col("evidence")) + odds(F.col("path_mean")) - odds(F.col("base"))
    scored = scored.withColumn("quality_score", 1 / (1 + F.exp(-z)))
    return scored.withColumn("keep", F.col("quality_score") >= REJECT)
