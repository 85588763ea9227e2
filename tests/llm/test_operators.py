"""Each operator against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import ann, bpe, decontam, langid, pii, quality, secrets, simhash, suffix, toxicity
from weftgraph.llm import queries as llm
from weftgraph.llm.common import components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, ids binary, key long, fp long, cover string"
LONG = "word " * 60_000 + "x" * 100_000
ODD = [
    (None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, 0), (3, " \t\n ", "en", "s", 3), (4, LONG, "en", "s", len(LONG)),
    (5, "the same text as another one here", "en", "s", 9), (6, "the same text as another one here", "en", "s", 9), (6, "the same text as another one here", "en", "s", 9),
    (7, "\x00   \U0001f600 ## 123", "de", "t", 9), (8, "a", "fr", "t", 1), (None, "no id but text", "en", "s", 3),
]


def frame(spark, rows, repeat=1):
    full = [(i, t, lang, s, n, "clash", b"clash", 1, 2, "clash") for i, t, lang, s, n in rows * repeat]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def weights(spark, docs):
    return quality.train(docs, table(spark, SF, "labels"))


def runs(spark, weights):
    langs = langid.train(table(spark, SF, "documents"))
    net = toxicity.Network(np.array([5, 9], np.uint64))
    forest = secrets.Forest(*secrets.findings(300), trees=5)
    bench = table(spark, SF, "benchmark")
    return {
        "simhash": lambda d: simhash.near_duplicates(d), "deduplicate": simhash.deduplicate, "suffix": suffix.remove_repeats, "toxicity": lambda d: toxicity.classify(d, net),
        "quality": lambda d: quality.classify(d, weights, F.col("source"), F.concat_ws("/", "source", "lang")), "matches": lambda d: decontam.matches(d, bench), "clean": lambda d: decontam.clean(d, bench),
        "langid": lambda d: langid.identify(d, *langs), "pii": lambda d: pii.pseudonymise(d, "k"), "secrets": lambda d: secrets.secrets(d, forest), "bpe": lambda d: bpe.encode(d, llm.tokenizer_path()),
    }


KEEPS_ROWS = {"simhash", "suffix", "toxicity", "quality", "langid", "pii", "bpe"}
NAMES = ["simhash", "deduplicate", "suffix", "toxicity", "quality", "matches", "clean", "langid", "pii", "secrets", "bpe"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_empty_tables(spark, weights, name):
    run = runs(spark, weights)[name]
    odd = frame(spark, ODD)
    got = run(odd).collect()
    if name in KEEPS_ROWS:
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD)
    assert run(odd.limit(0)).count() == 0


def test_simhash_brute_force(spark, docs, texts):
    def fingerprint(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [*texts, *[(r[0], r[1]) for r in ODD if r[0] and r[1] != LONG]]
    f = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 2 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(least.get(x, d), d)
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter((d, f"{x:016x}", least[c]) for (d, _), x, c in zip(rows, f, label))
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values())


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_repeats(texts, n):
    count = Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                gone[p : p + n] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        yield len(t), int(gone.sum()), len(edge) // 2, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()


def test_suffix_kernel_merges_shards(monkeypatch):
    rng = random.Random(3)
    for _ in range(12):
        base = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(400, 800))) for _ in range(3)]
        segs = list({rng.choice(base)[rng.randrange(0, 1) :] + (rng.choice(base)[:90] if rng.random() < 0.5 else b"") for _ in range(6)} | {b"ab" * 300})
        monkeypatch.setattr(suffix, "SHARD", rng.choice([300, 900, 10**6]))
        count = Counter(s[p : p + 400] for s in segs for p in range(len(s) - 399))
        for s, got in zip(segs, suffix.repeats(segs, np.ones(len(segs), int))):
            assert got.tolist() == [count[s[p : p + 400]] > 1 for p in range(len(s) - 399)]


def test_suffix_brute_force(spark, texts):
    rows = [*texts[:60], (900, "ab" * 700), (901, "z" * 401), (902, "z" * 400), (903, "q" * 399), (904, "q" * 399), (905, None)]
    got = suffix.digests(suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    want = brute_repeats([(t or "").encode() for _, t in rows], 400)
    assert Counter(map(tuple, got)) == Counter((d, *w) for (d, _), w in zip(rows, want))


def test_bpe_is_the_librarys(spark, texts):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(llm.tokenizer_path()), bpe.Codec(open(llm.tokenizer_path(), "rb").read())
    rng = random.Random(1)
    pool = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000]
    made = ["".join(rng.choice(pool) if rng.random() < 0.4 else rng.choice(" \n\tab'1s<|endoftext|>\xa0\x85\x1c") for _ in range(40)) for _ in range(300)]
    for t in [t for _, t in texts] + made + ["", "a<|endoftext|>b", "'s 're x  y   "]:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == ids
        assert mine.decode(mine.encode(t)) == lib.decode(ids, skip_special_tokens=False)


def test_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 10)
    c = bpe.Codec(open(llm.tokenizer_path(), "rb").read())
    once = [c.encode(f"word{i} other{i} third{i}") for i in range(20)]
    assert once == [c.encode(f"word{i} other{i} third{i}") for i in range(20)] and len(c.words) <= 20


def test_language_held_out(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    got = llm.op6_langid(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    lang = langid.identify(spark.createDataFrame([(1, "123 !!"), (2, None), (3, "the and of that")], "doc_id long, text string"), *langid.train(d))
    assert [r["lang_pred"] for r in lang.orderBy("doc_id").collect()] == ["und", "und", "en"]
    assert langid.identify(d.limit(2), *langid.train(d.limit(0))).first()["lang_pred"] == "und"


def test_language_mixtures(spark):
    d = table(spark, "/root/testdata/sf0.01", "documents")
    langs, table_ = langid.train(d)
    pick = {r["lang"]: r["text"] for r in d.where("n_chars between 2000 and 6000 and text not like '%|%' and text not like '%###%'").collect()}
    both = (pick["en"][:1500] + " " + pick["de"][:1500]).encode()
    p = langid.proportions(np.frombuffer(both, np.uint8), np.array([0, len(both)]), table_)[0]
    assert min(p[langs.index("en")], p[langs.index("de")]) > 0.2


def test_toxicity_held_out(spark):
    d, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    got = llm.op3_toxicity(spark, "/root/testdata/sf0.1").where("held_out").join(d.select("doc_id", "text"), "doc_id").join(labels, "doc_id").collect()
    sure = [r for r in got if r["toxic"] == 1 and re.search("idiot|trash|stupid|moron", r["text"], re.I)]
    assert np.mean([r["predicted"] for r in sure]) > 0.95 and np.mean([r["predicted"] for r in got if r["toxic"] == 0]) < 0.05


def test_toxicity_reads_whole_sampled_texts(spark, monkeypatch):
    spelt = lambda k: "".join(chr(97 + int(c)) for c in str(k))  # noqa: E731  (digits are no letters of words)
    texts = [(i, " ".join(f"z{spelt(i)}y{spelt(k)}" for k in range(3000))) for i in range(8)] + [(8, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    read = []
    monkeypatch.setattr(toxicity, "fit", lambda net, word, *rest: read.extend(word.tolist()))
    toxicity.train(d, labels)
    from weftgraph.llm.common import fold

    trained = {r["doc_id"] for r in d.where(fold() != 2).collect()}
    raw = [t.encode() for i, t in texts if i in trained]
    want = toxicity.words_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))[0]
    assert len(set(want.tolist())) >= 3000 and set(want.tolist()) <= set(read)


def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.array([5, 9, 11], np.uint64))
    x, real, y = rng.normal(size=(5, 3, 12)).astype(np.float64), np.ones((5, 3, 1)), np.array([1.0, 0.0, 1.0])
    real[3:, 1] = 0
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, dx = net.gradient(x, real, y, 0.0)
    loss = lambda: float(np.mean(np.logaddexp(0, -(2 * y - 1) * net.forward(x, real))))
    for k in ("w", "u", "xf", "hb", "cf", "hf"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        assert abs((up - loss()) / 2e-3 - g[k][at]) < 2e-3
        net.p[k][at] += 1e-3
    x[1, 0, 2] += 1e-3
    up = loss()
    x[1, 0, 2] -= 2e-3
    assert abs((up - loss()) / 2e-3 - dx[1, 0, 2]) < 2e-3


def test_one_class_gives_a_rate(spark, docs):
    labels = table(spark, SF, "labels")
    assert toxicity.train(docs, labels.where("toxic = 0")) == 0.0
    assert not quality.train(docs, labels.where("quality = 1")).any()


def test_quality_shrinks_sparse_paths(spark):
    rows = [("big", "big/a", 0.9)] * 200 + [("big", "big/b", 0.1)] * 100 + [("big", "big/c", 0.1)] + [("small", "small/a", 0.05)] + [("mid", "mid/a", 0.6)] * 50
    got = {r["path"]: r for r in quality.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    base = got["big/a"]["base"]
    assert 0.1 < got["big/c"]["path_mean"] < got["big/c"]["host_mean"] and 0.05 < got["small/a"]["host_mean"] <= base + 1e-9
    assert abs(got["big/b"]["path_mean"] - 0.1) < 0.1
    u = spark.createDataFrame([("HTTP://A.org/b/c?x",), ("a.org",), (None,)], "u string").select(quality.host_of(F.col("u")), quality.path_of(F.col("u"))).collect()
    assert [tuple(r) for r in u] == [("a.org", "a.org/b"), ("a.org", "a.org"), (None, None)]


def test_quality_keeps_clean_documents(spark, weights):
    sf = "/root/testdata/sf0.01"
    got = llm.op4_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").collect()
    assert np.mean([r["keep"] for r in got if r["quality"] == 1]) > 0.97 and np.mean([r["keep"] for r in got if r["quality"] == 0]) < 0.1


def test_edit_distance_brute_force():
    rng = random.Random(0)
    for _ in range(200):
        p = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 90)))
        t = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 120)))
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            cur = [i]
            for j, d in enumerate(t, 1):
                cur.append(min(prev[j - 1] + (c != d), prev[j] + 1, cur[j - 1] + 1))
            prev = cur
        assert decontam.edits(p, t)[0] == min(prev)


def test_edited_passages_are_found(spark):
    items = table(spark, SF, "benchmark").collect()
    rng, made = random.Random(5), []
    for r in items:
        y = list(r["text"])
        for _ in range(int(0.08 * len(r["text"].encode()))):
            k = rng.randrange(len(y))
            y[k] = rng.choice(["", y[k] + "e", "t"])
        made.append((r["item_id"], "Some words before. " + "".join(y) + " and some after."))
    made.append((10**6, "Nothing of a benchmark stands here, only words that anyone may write."))
    d = spark.createDataFrame(made, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.matches(d, table(spark, SF, "benchmark")).collect()}
    assert len([1 for r in items if (r["item_id"], r["item_id"]) in got]) >= 0.95 * len(items) and not any(a == 10**6 for a, _ in got)
    assert 10**6 in {r["doc_id"] for r in decontam.clean(d, table(spark, SF, "benchmark")).collect()}


def test_large_benchmarks_go_in_blocks(spark, monkeypatch):
    items = table(spark, SF, "benchmark")
    d = items.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(decontam, "BLOCK", 2000)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(d, items.union(spark.createDataFrame([(None, "x"), (77, None), (78, ""), (79, "abc")], items.schema))).collect()} >= {(r["item_id"],) * 2 for r in items.collect()}
    short = decontam.matches(spark.createDataFrame([(1, "xx ABC yy"), (2, "ab"), (3, "c")], "doc_id long, text string"), spark.createDataFrame([(79, "abc")], items.schema)).collect()
    assert [(r["doc_id"], r["item_id"]) for r in short] == [(1, 79)]


def test_surrogates(spark):
    said = "Mr. John Smith and Mrs. Anna Smith, bob.jones@mail.example.com BOB.JONES@MAIL.EXAMPLE.COM, 4111 1111 1111 1111 or 4111111111111111, not 4111111111111112; +49 (030) 123-4567, 10.2.33.144, DE89370400440532013000, 123-45-6789."
    d = spark.createDataFrame([(1, said), (2, said), (3, "Clean text of 2024, v1.2.3."), (4, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(d, "k").collect()}
    new = got[1]["text"]
    assert got[2]["text"] == new and got[3]["text"] == "Clean text of 2024, v1.2.3." and got[4]["text"] is None and got[3]["n_surrogates"] == 0
    for old in ("John", "Smith", "jones", "4111111111111111", "4111 1111 1111 1111", "123-4567", "10.2.33.144", "DE89370400440532013000", "123-45-6789"):
        assert old not in new
    m = re.match(r"Mr\. (\w+) ([\w-]+) and Mrs\. (\w+) ([\w-]+), (\S+@\S+) (\S+@\S+), ([\d ]+) or (\d+), not 4111111111111112; \+\d\d \(\d{3}\) \d{3}-\d{4}, [\d.]+, DE\d+, \d{3}-\d\d-\d{4}\.$", new)
    assert m and m[1] in pii.MEN_GIVEN and m[3] in pii.WOMEN_GIVEN and m[2] == m[4] and m[5].upper() == m[6] and m[7].replace(" ", "") == m[8]
    digits = [int(c) for c in reversed(m[8])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert {r["text"] for r in pii.pseudonymise(d.where("doc_id = 1"), "other").collect()} != {new}


def test_surrogates_stay_distinct(spark):
    names = spark.createDataFrame([("name", n) for n in pii.SURNAMES] + [("name", f"Other{i}") for i in range(200)] + [("address", f"1.2.3.{i}") for i in range(10)], "kind string, norm string")
    got = pii.assign(names, "k").collect()
    assert len(got) == len({(r["kind"], r["surrogate"]) for r in got}) == names.count()
    assert not {(r["kind"], r["surrogate"]) for r in got} & {(r["kind"], r["norm"]) for r in got}


def test_people_of_one_surname_stay_distinct(spark):
    men = ["John", "Michael", "Brian", "Henry", "Steven", "Alan", *[f"Given{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(100)], "Louis", "Борис", "Алексей"]
    said = [f"{title} {m} Smith" for title in ("Mr", "Dr", "Herr") for m in men] + ["Mrs Anna Smith", "Ms Joan Smith", "Mr Иван Петров", "Mrs Ольга Петров"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(said)] + [(1000, "Dear Mr John Smith")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymise(d, "weftgraph").collect()}
    new = [got[i] for i in range(len(said))]
    assert len(set(new)) == len(said) and got[1000] == "Dear " + new[0]
    assert len({x.split()[2] for x, old in zip(new, said) if old.endswith("Smith")}) == 1
    assert [x.split()[1] for x in new[: len(men)]] == [x.split()[1] for x in new[2 * len(men) : 3 * len(men)]]  # Mr and Herr are of one gender
    assert not {x.split()[1] for x in new} & {old.split()[1] for old in said}
    for x, old in zip(new, said):
        assert [re.sub("[а-яё-]", "", p.lower()) == "" for p in x.split()] == [re.sub("[а-яё-]", "", p.lower()) == "" for p in old.split()]


def test_pii_plan_has_no_python(spark, docs):
    plan = pii.pseudonymise(docs, "k")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets(spark):
    forest = secrets.train()
    x, y = secrets.findings(600, seed=99)
    assert np.mean((forest.predict(x) >= 0.5) == y) > 0.95
    d = spark.createDataFrame([(1, 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"', "src/a"), (2, "commit 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "src/a"), (3, "Donaudampfschifffahrtsgesellschaft und mehr", "src/a")], "doc_id long, text string, source string")
    assert [(r["doc_id"], r["start"]) for r in secrets.secrets(d, forest).collect()] == [(1, 9)]


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[10] = v[11] = v[12] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [float("inf")] * 16), (1100, [None] * 16), (1200, [1.0] * 3), (None, [1.0] * 16), (0, v[0].tolist())]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query", F.lit("clash"))
    got = ann.search(e, "vec_id % 100 = 0").collect()
    x = v.astype(float)
    hit = 0
    for q in range(0, 600, 100):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        hit += len({r["vec_id"] for r in mine} & set(want.tolist()))
        assert [r["rank"] for r in mine] == list(range(1, 11)) and all(abs(r["score"] - d[r["vec_id"]]) < 1e-12 for r in mine)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        if q == 0:
            assert [r["vec_id"] for r in mine[:3]] == [10, 11, 12]
    assert hit >= 54 and {r["query_id"] for r in got} == set(range(0, 600, 100))
    assert ann.search(e.limit(0), "vec_id % 100 = 0").count() == 0
    assert len(ann.search(e.where("vec_id < 4"), "vec_id % 100 = 0").collect()) == 3
