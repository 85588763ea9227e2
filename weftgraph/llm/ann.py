"""Approximate nearest neighbours: inverted lists scanned with adaptive dimension tests.

Vectors are turned by one random rotation, so any leading columns are a fair sample of a distance. In
each probed list a query reads candidates' columns in blocks; a candidate is abandoned as soon as its
partial distance, extended to all columns, would by a hypothesis test exceed the query's current k-th
distance. What survives is measured exactly on the original vectors. A query scans its nearest list
first; the k-th distance found there is its bound in all other lists from their first candidate on.

Null and zero vectors, vectors with null or non-finite components, and null ids take no part, nor do
vectors of another length than the most common one. A row repeated with its id counts once; of several
vectors with one id the nearest counts, and as queries they are one. A query with fewer candidates than
k gets all that its lists hold. Ties go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, on_workers

#: Rows that the lists' centres are fitted on, at most; lists at most; rounds of k-means.
SAMPLE, MOST_LISTS, ROUNDS = 20_000, 4096, 8
#: Share of the sample's own nearest neighbours that the probed lists must hold, and sample rows that are asked.
TARGET, ASKED = 0.97, 400
#: Columns in a block, and the tests' slack in standard deviations.
COLUMNS, SLACK = 16, 2.6
#: Candidates and queries packed into one row.
BLOCK, QUERIES = 2048, 128
#: Candidates before a query's bound is updated: at first, and at most (the number doubles, and is this where a bound is known).
CHUNK, MOST_CHUNK = 32, 2048


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres(x: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """k-means of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(ROUNDS):
        near = nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = []
    for i in range(0, len(x), 1024):
        d = (c * c).sum(1) - 2 * (x[i : i + 1024] @ c.T)
        part = np.argpartition(d, k - 1, axis=1)[:, :k] if k < len(c) else np.tile(np.arange(len(c)), (len(d), 1))
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def probes_for(x: np.ndarray, c: np.ndarray, k: int) -> int:
    """The fewest lists to probe for TARGET of the k nearest of some sample rows among the sample.

    A sample is sparser than the whole, so its neighbours lie farther apart and over more lists: this errs to more.
    """
    some = np.random.default_rng(7).permutation(len(x))[:ASKED]
    home, order = nearest(x, c, 1)[:, 0], nearest(x[some], c, len(c))
    place = np.argsort(order, axis=1)
    norm, seen = (x * x).sum(1), []
    for j, i in enumerate(some):
        d = norm - 2 * (x @ x[i])
        d[i] = np.inf
        near = np.argpartition(d, min(k, len(d) - 1) - 1)[:k]
        seen.append(place[j, home[near]])
    return 1 + int(np.quantile(np.concatenate(seen), TARGET, method="higher")) if len(x) > 1 else len(c)


def scan(q: np.ndarray, q_id: int, turned: np.ndarray, vectors: np.ndarray, turned_q: np.ndarray, ids: np.ndarray, k: int, bound: float = np.inf, stats: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest candidates of one query in one block, and maybe none farther than bound: ids and exact distances.

    stats: columns of candidates that were read, and that there are.
    """
    d = turned.shape[1]
    best_i, best_d = np.zeros(0, np.int64), np.zeros(0)
    lo, size = 0, CHUNK if bound == np.inf else MOST_CHUNK
    while lo < len(ids):
        live = np.arange(lo, min(lo + size, len(ids)))
        lo, size = lo + size, min(2 * size, MOST_CHUNK)
        live = live[ids[live] != q_id]
        if stats is not None:
            stats[1] += len(live) * d
        most = min(bound, best_d[-1]) if len(best_d) == k else bound
        part = np.zeros(len(live))
        for c in range(0, d, COLUMNS) if most < np.inf else ():
            e = min(c + COLUMNS, d)
            part += ((turned[live, c:e] - turned_q[c:e]) ** 2).sum(axis=1)
            if stats is not None:
                stats[0] += len(live) * (e - c)
            # The test: as the rotation is random, the share of e columns in a square distance has a beta distribution of
            # mean e / d; within the bound, more than SLACK deviations above that is not to be expected.
            limit = most * most * min(1.0, e / d + SLACK * np.sqrt(e / d * (1 - e / d) / (d / 2 + 1)))
            on = part <= limit * (1 + 1e-9) + 1e-300
            live, part = live[on], part[on]
            if not len(live):
                break
        if not len(live):
            continue
        if stats is not None and most == np.inf:
            stats[0] += len(live) * d
        exact = np.sqrt(((vectors[live] - q) ** 2).sum(axis=1))
        all_i, all_d = np.concatenate([best_i, ids[live]]), np.concatenate([best_d, exact])
        order = np.lexsort((all_i, all_d))
        first = np.sort(np.unique(all_i[order], return_index=True)[1])  # of one id the nearest
        keep = order[first[:k]]
        best_i, best_d = all_i[keep], all_d[keep]
    return best_i, best_d


def search(vectors: DataFrame, is_query: str, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which the SQL condition is_query holds."""
    spark = vectors.sparkSession
    on_workers(spark)
    e = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.expr(is_query).alias("query"))
    rows = rows.withColumn("embedding", e).where(usable)
    out = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], out)
    d, n = sizes[0]
    rows = rows.where(F.size("embedding") == d)
    some = rows.select("embedding", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample = np.asarray(some.column(0).combine_chunks().flatten(), np.float64).reshape(-1, d)
    lists = int(max(1, min(MOST_LISTS, len(sample) // 8, round(n**0.5 / 4))))
    turn = rotation(d)
    mid = centres(sample, lists)
    probes = probes_for(sample, mid, k)
    shared = spark.sparkContext.broadcast((mid, turn))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for b in batches:
            x = np.asarray(b.column("embedding").flatten(), np.float64).reshape(-1, d)
            near = nearest(x, c, 1)[:, 0] if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("query"), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "query", "list", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, _ = shared.value
        for b in batches:
            x = np.array([np.frombuffer(v, np.float64) for v in b.column("v").to_pylist()]).reshape(-1, d)
            near = nearest(x, c, probes).astype(np.int32)
            order = np.tile(np.arange(probes, dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("vec_id").to_numpy(), probes)), pa.array(order), pa.array(near.ravel()), pa.array(np.repeat(np.array(b.column("v").to_pylist(), object), probes), pa.binary())], ["vec_id", "order", "list", "v"])

    placed = cut(rows.mapInArrow(place, "vec_id long, query boolean, list int, v binary"))
    # A list with very many rows is dealt over as many blocks as it needs; its size is known first (one number a list).
    held = {r[0]: r[1] for r in placed.groupBy("list").count().collect()}
    # Any lists that a query probes hold k others at least, if there are so many.
    fewest = np.cumsum(sorted(held.get(i, 0) for i in range(lists)))
    probes = max(probes, min(lists, 1 + int(np.searchsorted(fewest, k + 1))))
    per_list = lambda n, most: F.element_at(F.array(*[F.lit(-(-n.get(i, 0) // most) or 1) for i in range(lists)]), F.col("list") + 1)
    blocks = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), per_list(held, BLOCK)))
    # A set, so that a row repeated any number of times travels once from each task.
    blocks = blocks.groupBy("list", "block").agg(F.collect_set(F.struct("vec_id", "v")).alias("rows"))
    blocks = cut(blocks.select("list", "block", F.col("rows.vec_id").alias("ids"), F.col("rows.v").alias("vs")))
    asked = cut(placed.where("query").select("vec_id", "v").distinct().mapInArrow(probe, "vec_id long, order int, list int, v binary").withColumn("bound", F.lit(float("inf"))))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, turn = shared.value
        for b in batches:
            for r in b.to_pylist():
                v = np.frombuffer(b"".join(r["vs"]), np.float64).reshape(-1, d)
                ids = np.array(r["ids"], np.int64)
                q = np.frombuffer(b"".join(r["qs"]), np.float64).reshape(-1, d)
                tv, tq = v @ turn, q @ turn
                got = [(i, *scan(q[j], i, tv, v, tq[j], ids, k, bound)) for j, (i, bound) in enumerate(zip(r["q_ids"], r["bounds"]))]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]).astype(np.int64)), pa.array(np.concatenate([g[1] for g in got])), pa.array(np.concatenate([g[2] for g in got]))], ["query_id", "vec_id", "score"])

    def found(some: DataFrame) -> DataFrame:
        """What some queries find: each group of a list's queries meets each block of the list."""
        n = {r[0]: r[1] for r in some.groupBy("list").count().collect()}  # one number a list
        groups = some.groupBy("list", F.pmod(F.xxhash64("vec_id"), per_list(n, QUERIES)).alias("q")).agg(F.collect_set(F.struct("vec_id", "bound", "v")).alias("rows"))
        groups = groups.select("list", F.explode(F.sequence(F.lit(0).cast("long"), per_list(held, BLOCK).cast("long") - 1)).alias("block"), F.col("rows.vec_id").alias("q_ids"), F.col("rows.bound").alias("bounds"), F.col("rows.v").alias("qs"))
        return groups.join(blocks, ["list", "block"]).mapInArrow(scanned, "query_id long, vec_id long, score double")

    def best(some: DataFrame) -> DataFrame:
        least = some.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return least.withColumn("rank", F.expr("row_number() over (partition by query_id order by score, vec_id)")).where(F.col("rank") <= k)

    near = cut(best(found(asked.where("order = 0"))).select("query_id", "vec_id", "score", "rank"))
    bounds = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("known"))
    rest = asked.where("order > 0").join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("known", "bound"))
    far = found(rest.select("vec_id", "list", "v", "bound"))
    return best(near.select("query_id", "vec_id", "score").unionByName(far)).select("query_id", "rank", "vec_id", "score")
