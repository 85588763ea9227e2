"""The pipeline against a plain version of each stage on what the stage before it kept."""

import os
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from weftgraph.llm import pii, simhash
from weftgraph.llm.common import table
from weftgraph.operators.loops import CLEANUP

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(docs)
        if k < len(cp.STAGES) - 1:
            assert docs.columns == columns
    before = table(spark, SF, "documents").toPandas().set_index("doc_id").text
    good, one, clean, named = (d.toPandas().set_index("doc_id").text for d in kept[:4])
    junk = before.str.contains(r"###|\$\$\$|&&&|%%%| \| ")
    assert not junk[good.index].any()
    assert set(one.index) <= set(good.index) and one.is_unique
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    leaks = {i for i, t in one.items() if any(x.lower() in t.lower() for x in items)}
    assert set(clean.index) <= set(one.index) - leaks and len(one) - len(clean) <= len(leaks) + 2
    assert set(named.index) == set(clean.index)
    for i, t in named.items():
        assert not set(re.findall(r"[\w.+-]+@[\w.-]+", clean[i])) & set(re.findall(r"[\w.+-]+@[\w.-]+", t))
        assert re.sub(r"[\w.+-]+@[\w.-]+|[\d.]+", "", t) == re.sub(r"[\w.+-]+@[\w.-]+|[\d.]+", "", clean[i])
    assert pii.found is not None and sorted(r["doc_id"] for r in kept[4].collect()) == sorted(named.index)
    assert cp.run(spark, SF).count() == len(named)


def test_clashing_columns_stay(spark):
    docs = table(spark, SF, "documents").limit(40).select("*", *[F.col("doc_id").alias(c) for c in ("host", "keep", "id", "found", "map", "text_hash", "Evidence")])
    for _, stage in cp.STAGES[:4]:
        docs = stage(spark, docs, SF)
    rows = docs.collect()
    assert rows and all(r[c] == r["doc_id"] for r in rows for c in ("host", "keep", "id", "found", "map", "text_hash", "Evidence"))


def test_empty_documents(spark, tmp_path):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_copies(spark):
    def copy(text, at):
        w = text.split()
        return " ".join([*w[:at], "changed", *w[at + 1 :]])

    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    long = [(i, t) for i, t in rows if len(t.split()) >= 100]
    rows += [(10**6 + i, copy(t, len(t.split()) // 2)) for i, t in long] + [(10**7 + i, copy(copy(t, 30), 60)) for i, t in long]
    rows += [(None, None), (1, ""), (2 * 10**7, " \t"), (2 * 10**7, " \t"), (3 * 10**7, "two words"), (4 * 10**7, "Two  words"), (5 * 10**7, "other words")]

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            both = len(x & y)
            if label[i] != label[j] and both >= 0.8 * (len(x) + len(y) - both):
                old, new = label[i], label[j]
                label = [new if z == old else z for z in label]
    least = {}
    for (i, _), z in zip(rows, label):
        if i is not None:
            least[z] = min(least.get(z, i), i)
    got = sorted(r["doc_id"] for r in cp.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect())
    assert long and got == sorted(least.values())


def test_no_pair_at_the_threshold_is_missed(spark):
    """Texts of 60 to 400 words against copies with changed words all over, of similarity 0.8 or just under: the pairs that
    meet it, and no others, are one group."""
    rng = random.Random(5)
    rows, alike = [], []
    for k in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 120, 200, 400]))]
        n = len(words) - 4
        other = list(words)
        places = rng.sample(range(len(words)), len(words))
        similarity = lambda o: (b := len({tuple(words[i : i + 5]) for i in range(n)} & {tuple(o[i : i + 5]) for i in range(n)})) / (2 * n - b)
        while similarity(other) >= 0.84:
            other[places.pop()] = f"x{rng.randrange(10**6)}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        alike.append(similarity(other) >= 0.8)
    label = {r["doc_id"]: r["label"] for r in simhash.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 200 < sum(alike) < 600 and [label[2 * k] == label[2 * k + 1] for k in range(600)] == alike


def test_near_copies_leave_no_shuffle_files(spark):
    """Shuffle files of one step are gone before the next, or all steps' lie on disk at once."""
    docs = table(spark, SF, "documents").limit(60).localCheckpoint()
    before, setting = _shuffled(spark), spark.conf.get(CLEANUP, None)
    simhash.deduplicate_similar(docs)
    assert not _shuffled(spark) - before
    assert spark.conf.get(CLEANUP, None) == setting


def test_near_copies_leave_no_sets(spark):
    """Prefixes and sets are gone from the shared folder when their step ends, or all steps' lie on disk at once."""
    from weftgraph.llm.common import shared_folder

    at = shared_folder(spark).removeprefix("file:")
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(at) for f in files)
    rows = [(2 * k + j, " ".join(f"w{k}x{i if i != 50 else i + j}" for i in range(20_000))) for k in range(8) for j in (0, 1)]
    docs, before = spark.createDataFrame(rows, "doc_id long, text string"), held()
    assert len({r["label"] for r in simhash.grouped(docs).collect()}) == 8
    assert held() - before < 1_600_000  # the sets of these texts alone have as many bytes, the prefixes half as many


def test_briefs_tell_large_sets_apart():
    """No pair that is similar enough is lost, and long texts with half of their shingles in common do not send their sets."""
    rng = np.random.default_rng(1)
    for n in (1, 7, 300, 3000):
        for m in range(n // 5 + 1) if n < 300 else (0, n // 12, n // 10, n // 9, n // 3, n):
            h = rng.choice(1 << 40, n + m, replace=False).astype(np.uint64)
            for x, y in ((h[:n], h[m:]), (h, h[m:])):
                both = len(np.intersect1d(x, y))
                alike = simhash.briefly_alike(simhash.brief(x), simhash.brief(y), len(x) + len(y))
                similarity = both / (len(x) + len(y) - both)
                assert alike or similarity < simhash.SIMILAR
                if n == 3000 and similarity < 0.7:
                    assert not alike


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}
