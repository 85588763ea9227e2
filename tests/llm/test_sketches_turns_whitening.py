"""Operators 11 to 13 against brute force, and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import oneperm, turns, whitening
from weftgraph.llm.common import table

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


# ---- one-permutation fingerprints


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_fingerprints_of_all_documents(spark):
    rows = sorted(table(spark, MORE, "documents").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in oneperm.half_edited(table(spark, MORE, "documents")).collect()}
    assert len(got) == len(rows)
    texts, off = [r["text"] or "" for r in rows], []
    for i, (r, t) in enumerate(zip(rows, texts)):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        g = got[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), sha(edited))
        off += [g["near_edited"] - jaccard(shingle_set(t), shingle_set(edited)), g["near_next"] - jaccard(shingle_set(t), shingle_set(after))]
    # 256 bins: a standard deviation of at most 0.031.
    assert abs(np.mean(off)) < 0.004 and np.std(off) < 0.031 and np.abs(off).max() < 0.16


def test_estimates_have_no_bias_at_few_bits():
    rng = np.random.default_rng(4)
    word = lambda: "w%08d" % rng.integers(10**8)
    for bits in (1, 2, 8):
        got, want = [], []
        for _ in range(60):
            a = [word() for _ in range(300)]
            b = a[:200] + [word() for _ in range(100)]
            p = oneperm.fingerprints(*oneperm.flat(oneperm.pa.array([" ".join(a), " ".join(b)])), bits=bits)
            assert p.shape[1] == 32 * bits
            got.append(oneperm.likeness(p[:1], p[1:], bits)[0])
            want.append(jaccard(shingle_set(" ".join(a)), shingle_set(" ".join(b))))
        assert abs(np.mean(got) - np.mean(want)) < 0.03


def test_empty_bins_take_full_ones_values():
    least = np.full((3, 64), oneperm._EMPTY)
    least[0, 5], least[1, 7], least[1, 9] = 11, 12, 13
    out = oneperm.densified(least)
    assert (out[0] == 11).all() and set(out[1]) == {12, 13} and (out[2] == oneperm._EMPTY).all()
    assert 16 < (out[1] == 12).sum() < 48


def test_fingerprints_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(oneperm, "RANGE_ROWS", 2)
    rows = [(5, "x y"), (1, None), (3, "a b c d e f"), (3, "a b c d e f"), (2, ""), (None, "null id"), (9, "zé\U0001f600" * 2000), (4, " \t\n"), (8, "X  Y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "range": F.lit("r"), "fingerprint": F.lit(0)})
    got = oneperm.half_edited(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    order = [(None, "null id"), (1, ""), (2, ""), (3, rows[2][1]), (3, rows[2][1]), (4, " \t\n"), (5, "x y"), (8, "X  Y"), rows[6]]
    of = {r["doc_id"]: r for r in got if r["doc_id"] != 3}
    for (d, t), (_, after) in zip(order, order[1:] + order[:1]):
        if d != 3:
            assert of[d]["edited_sha256"] == sha(t[: len(t) - len(t) // 2] + after[: len(t) // 2]) and of[d]["n_chars"] == len(t)
    assert of[1]["fingerprint"] == of[2]["fingerprint"] == of[4]["fingerprint"] == "0" * 512 and of[1]["near_next"] == 1
    assert of[5]["fingerprint"] == of[8]["fingerprint"] and of[5]["near_next"] == 1 and of[4]["near_next"] == 0
    assert sorted(r["near_next"] for r in got if r["doc_id"] == 3) == [0, 1]
    assert dict(map(tuple, oneperm.fingerprinted(df.where("doc_id <> 3")).collect())) == {d: r["fingerprint"] for d, r in of.items() if d is not None}
    assert oneperm.half_edited(df.limit(0)).count() == 0
    lone = oneperm.half_edited(df.where("doc_id = 9")).collect()
    assert len(lone) == 1 and lone[0]["near_next"] == 1


# ---- conversations


def brute(rows, batches=12):
    """The rules, one batch after another, in plain Python."""
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows if t is not None]
    first, came = {}, [{} for _ in range(batches)]
    for c, t, r, x in rows:
        first[c] = min(first.get(c, t), t)
        h = int(sha(f"{'' if c is None else c}:{t}")[:8], 16)
        for b, role in [(h % batches, r)] + [((h + 5) % batches, "user")] * (h % 7 < 2):
            p = (f"{role}|{x}".encode(), role)
            came[b][c, t] = min(came[b].get((c, t), p), p)
    out, kept, at, last, closed = [], {}, {}, {}, set()

    def close(c, b):
        k = kept[c]
        left = ",".join(str(t) for t in sorted(k) if t >= at[c])
        out.append(("close", sha(left), c, -1, b, max(k) - first[c] + 1 - len(k), sum(t - 1 in k and k[t - 1][1] == k[t][1] for t in k)))
        closed.add(c)

    for b in range(batches):
        for (c, t), p in came[b].items():
            if c in closed:
                out.append(("reject", sha(p[0]), c, t, b, None, None))
            else:
                kept.setdefault(c, {}).setdefault(t, p)
                at.setdefault(c, first[c])
                last[c] = b
        for c in set(kept) - closed:
            while at[c] in kept[c]:
                out.append(("release", sha(kept[c][at[c]][0]), c, at[c], b, None, None))
                at[c] += 1
            if b - last[c] == 2:
                close(c, b)
    for c in set(kept) - closed:
        close(c, batches)
    return Counter(out)


def test_conversations_brute_force(spark):
    """The table, one of 400 turns, and odd rows: nulls, repeats, several texts of a turn, negative and far turns."""
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    long_ = [(10**6, t, "user" if t % 3 else "system", f"t{t}") for t in range(400) if t % 97 != 5]
    odd = [(None, 0, "user", "x"), (None, 2, "user", None), (10**6 + 1, None, "user", "gone"), (10**6 + 1, -3, None, None), (10**6 + 1, -2, None, "a|b"), (10**6 + 1, 10**12, "", "far")]
    odd += [(10**6 + 2, t, r, x) for t in range(40) for r, x in (("a|b", "c"), ("a", "b|c"), ("a", "b|c"), ("z", "é"))]
    rows += long_ + odd
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"batch": F.lit(7), "conv": F.lit("c"), "bucket": F.lit(1)})
    got = turns.digests(turns.reassembled(df)).select("event", "sha256", "conv_id", "turn", "batch", "n_missing", "n_breaks").collect()
    assert Counter(map(tuple, got)) == brute(rows)


def test_conversations_of_an_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.digests(turns.Reassembly(spark, none, batches=2, buckets=2).run().events()).count() == 0


def test_a_wheel_visits_what_is_due():
    w = turns.Wheel()
    assert [w.arrive(c, 0) for c in "abc"] == ["accept"] * 3 and w.tick(0) == [] == w.tick(1)
    assert w.arrive("a", 2) == "accept"
    assert w.tick(2) == ["b", "c"] and w.arrive("b", 3) == "reject"
    # What was filed for batch 2 is gone, a is filed for 4 under its second generation.
    assert w.slots == {4: [("a", 2)]} and w.tick(3) == [] and w.tick(4) == ["a"]
    assert w.arrive("d", 5) == "accept" and w.arrive("d", 6) == "accept" and w.tick(12, last=True) == ["d"] and not w.slots


# ---- whitening


def plainly(vectors, most=16):
    x = np.floor(64 * np.asarray(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ v / np.sqrt(e), e, (c**2).sum() / n


def test_whitening_of_all_embeddings(spark):
    rows = [r for r in table(spark, MORE, "embeddings").select("vec_id", "embedding").collect() if r["embedding"] and None not in r["embedding"] and np.isfinite(r["embedding"]).all()]
    n, deviation, white, e, trace = plainly([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in whitening.by_component(table(spark, MORE, "embeddings")).collect()}
    assert len(got) == 16 * len(rows)
    mine = np.array([[got[r["vec_id"], k]["whitened"] for k in range(1, 17)] for r in rows])
    signs = np.sign((mine * white).sum(0))
    assert np.abs(mine - white * signs).max() < 1e-8
    for i, r in enumerate(rows):
        g = got[r["vec_id"], 3]
        assert (g["n"], g["deviation"]) == (n, deviation[i]) and abs(g["explained"] - e[2] / trace) < 1e-12 and 0 <= g["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [[float(x) for x in v] for v in rng.normal(size=(40, 3))]
    rows = [(i, v) for i, v in enumerate(good)] + [(0, good[0]), (90, good[5]), (91, None), (92, []), (93, [1.0, None, 2.0]), (94, [float("nan")] * 3), (95, [1.0, float("-inf"), 0.0]), (96, [1.0, 2.0]), (None, good[7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"x": F.lit(1), "deviation": F.lit("d"), "n": F.lit(0)})
    got = whitening.by_component(df).collect()
    n, deviation, white, _, _ = plainly(good)
    assert n == 40 and Counter(r["vec_id"] for r in got) == Counter({i: 3 for i in range(1, 40)} | {0: 6, 90: 3, None: 3})
    assert {(r["vec_id"], r["deviation"]) for r in got if r["vec_id"] in range(40)} == set(enumerate(deviation.tolist()))
    assert len({round(r["whitened"], 12) for r in got if r["vec_id"] in (5, 90) and r["component"] == 1}) == 1
    assert whitening.by_component(df.limit(0)).count() == 0 == whitening.by_component(df.where("vec_id = 91")).count()
    assert whitening.by_component(df.where("vec_id in (5, 90)")).count() == 0  # one distinct vector has no variance


def test_factors_merge_in_a_tree(spark):
    """Over 100 partitions, a column of no variance, and entries whose squares pass 64 bits."""
    rng = np.random.default_rng(8)
    v = rng.normal(size=(600, 4)) * [1, 5, 0, 0.2]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    good, d = whitening.vectors(df)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 101)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        of = whitening.fit(good, d)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n, _, _, e, trace = plainly(v, 3)
    assert of.n == n and np.allclose(of.eigenvalues, e, rtol=1e-10) and abs(of.trace - trace) < 1e-9 * trace
    wide = [(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [3.0, -2e300])]
    rows = whitening.whiten(*(g := whitening.vectors(spark.createDataFrame(wide, "vec_id long, embedding array<double>"))), whitening.fit(*g)).collect()
    x = [[int(c) for c in r] for r in whitening.whole(np.array([r[1] for r in wide]))]
    s = [sum(c) for c in zip(*x)]
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == {i: sum((3 * c - t) ** 2 for c, t in zip(r, s)) for i, r in enumerate(x)}


def test_a_deviation_past_64_bits_is_an_error(spark):
    wide = spark.createDataFrame([(0, [1e15, 0.0]), (1, [-1e15, 1.0]), (2, [3.0, 5.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="CAST|OVERFLOW|overflow"):
        whitening.by_component(wide).collect()
