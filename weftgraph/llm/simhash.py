"""SimHash near-duplicates: fingerprints, meet-in-the-middle ball hashing, components.

near_duplicates: one 64-bit fingerprint of three-word shingles a text; two within RADIUS bits are linked.
Null and empty texts, and texts of white space only, have fingerprint zero and are linked like any
other. Repeated rows and equal texts share a fingerprint, hence a component. A component's id is its
smallest doc_id; null ids are kept and never become an id unless a component has no other.

deduplicate_similar: texts whose sets of five-word shingles are similar by SIMILAR or more (Jaccard) are
near copies, copies of copies are one group, and one document of each group stays. Candidates are found by
prefix filtering, which misses none: two sets that are similar enough share one of the first shingles of
each in any one order of all shingles, a fifth of a set and one more (else too few would be left to share). The order
has rare shingles first, as far as a sample knows them, so few sets share one; it is the same for all texts, so what the sample
holds never decides what is found. The sizes of two sets and the parities of their shingles by 512 places bound their
similarity from above; what these leave is decided by the sets. Texts under five words have one shingle, all
their words; texts without a word have none and are copies of each other. Case and the kind of white space do not
count. Equal sets are one node before anything travels, named by a 64-bit hash of the set.

Columns other than doc_id and text are not read; deduplicate and deduplicate_similar pass them through,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, components, cut, flat, for_now, fresh, on_workers, slices, tidy

#: Bits by which linked fingerprints may differ, and what each side of a meeting flips.
RADIUS, HALF = 2, 1
SHINGLE, SEED = 3, 42
#: Near copies: words in a shingle, and similarity.
LONG_SHINGLE, SIMILAR = 5, 0.8
#: Approximate keys: words in a shingle; fingerprints of a text, and bits of each; 64-bit fingerprints of a set.
PAIR, WORDS, BITS, LONG = 2, 12, 40, 8
#: Cuts of a text, and the least share of its words (one in so many) that a piece has; keys of pieces come after those of fingerprints.
CUTS, SHARE, PIECES = 4, 8, 16
#: Documents, about, in which shingles are counted, and how many of the most frequent are told from the others.
SAMPLE, COMMON = 4_000, 100_000
#: Places by which a set's shingles are counted modulo 2, a power of 2.
PLACES = 512
LANES = np.uint64(0x0101010101010101)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingles(data: np.ndarray, starts: np.ndarray, k: int = SHINGLE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with single spaces between lower-cased words; begin and end in it of each shingle; shingles of each text."""
    n = len(starts) - 1
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    begin = starts[:-1][starts[:-1] < len(data)]
    first[begin] = ~space[begin]  # a text's first byte begins a word whatever stands before it
    word_at = np.flatnonzero(first)
    doc = np.searchsorted(starts, word_at, side="right") - 1
    gap = np.zeros(len(data) + 1, np.int64)  # a space goes before each word
    gap[word_at] = 1
    keep = ~space
    places = np.cumsum(keep) + np.cumsum(gap[:-1])  # one past the byte's own place
    out = np.full(int(places[-1]) if len(data) else 0, 0x20, np.uint8)
    out[places[keep] - 1] = _LOWER[data[keep]]
    begins = places[word_at] - 1
    ends = np.append(begins[1:] - 1, len(out)) if len(begins) else begins
    words = np.bincount(doc, minlength=n)
    count = np.where(words >= k, words - k + 1, np.minimum(words, 1))
    last_of = np.cumsum(words)[doc]  # one past the last word of the word's text
    i = np.arange(len(word_at))
    lead = (i + k <= last_of) | (i == last_of - words[doc])
    lead_i = i[lead]
    return out.tobytes(), begins[lead_i], ends[np.minimum(lead_i + k, last_of[lead_i]) - 1], count


def hashed(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of k words, repeats included, and how many each text has."""
    text, begin, end, count = shingles(data, starts, k)
    h64 = xxhash.xxh64_intdigest
    return np.fromiter((h64(text[s:e], SEED) for s, e in zip(begin.tolist(), end.tolist())), np.uint64, len(begin)), count


def fingerprints(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return majority(*hashed(data, starts, SHINGLE))


def majority(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each text with so many hashes: the bits that are set in over half of them; zero without any."""
    fp = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if not len(full):
        return fp
    size = count[full]
    # Sums of up to 255 hashes fit the eight byte lanes of a word; so texts are summed in such pieces.
    pieces = -(-size // 255)
    of = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = (np.cumsum(size) - size)[of] + 255 * nth
    head = np.cumsum(pieces) - pieces
    for bit in range(8):
        sums = np.add.reduceat((h >> np.uint64(bit)) & LANES, at)
        lanes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), head, axis=0)
        for lane in range(8):
            fp[full] |= (2 * lanes[:, lane] > size).astype(np.uint64) << np.uint64(8 * lane + bit)
    return fp


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        fp = fingerprints(*flat(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(fp.view(np.int64))], ["doc_id", "hash", "fp"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, fp): hash is one of the text, fp the fingerprint's 64 bits as a long."""
    on_workers(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash")).mapInArrow(_fingerprint_batches, "doc_id long, hash long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): linked fingerprints, enough to join every pair within RADIUS through others within it.

    Each distinct fingerprint emits itself and its 64 one-bit variants. Two that share a variant
    differ in at most two bits, and any two that do so share one; at most 65 distinct fingerprints
    can share a variant, so no group is large. Neighbours in a group are linked, verified and
    de-duplicated; a group's members are all within RADIUS, so this joins all of them.
    """
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    variants = fps.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    before = F.expr("lag(fp) over (partition by variant order by fp)")
    pairs = variants.select("fp", before.alias("before")).where("before is not null")
    return pairs.where(f"bit_count(fp ^ before) <= {RADIUS}").select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, fp, label, component_id), a row for each row of docs; label is a component's smallest fingerprint."""
    fps = cut(with_fingerprint(docs))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    label = components(links(distinct.select("fp")))
    least = distinct.join(label, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("label", "fp").alias("label"))
    least = cut(least)
    ids = least.groupBy("label").agg(F.min("rep").alias("component_id"))
    return fps.join(least.join(ids, "label").select("fp", "label", "component_id"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs."""
    return labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies by five-word similarity


def sets(word: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles of k words in order, and where each text's begin (and the last ends);
    word: the hash of each word of all texts, count: how many each text has."""
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(of)) + np.repeat(np.cumsum(count) - count - np.cumsum(n) + n, n)
    end = np.cumsum(count)[of]
    h = np.zeros(len(of), np.uint64)
    for j in range(k):
        here = at + j < end
        h[here] += word[at[here] + j] * _ODD[0, j]
    h = (h ^ (h >> np.uint64(32))) * _ODD[1, 0]
    # One sort of 24 bits of the text's number (a batch has far fewer texts) and 40 bits of hash.
    h = np.sort(of.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    h = h[new]
    held = np.bincount((h >> np.uint64(40)).astype(np.int64), minlength=len(count))
    return h & np.uint64((1 << 40) - 1), np.concatenate([[0], np.cumsum(held)]).astype(np.int64)


_ODD = np.random.default_rng(SEED).integers(1 << 63, size=(2, max(WORDS, LONG, LONG_SHINGLE)), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefixes(h: np.ndarray, at: np.ndarray, common: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set, of which a similar set shares one, and where each set's begin; the order is that of
    `often` (0 for those not in `common`, which is sorted), then of the hashes."""
    size = np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    rank = np.zeros(len(h), np.int64)
    if len(common):
        found = np.minimum(np.searchsorted(common, h), len(common) - 1)
        rank = np.where(common[found] == h, often[found], 0)
    h = h[np.argsort(of << 32 | rank, kind="stable")]
    most = np.where(size > 0, size - np.ceil(SIMILAR * size - 1e-9).astype(np.int64) + 1, 0)
    return h[np.arange(len(h)) - at[:-1][of] < most[of]], np.concatenate([[0], np.cumsum(most)])


def parities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether an odd number of a set's shingles falls to each of PLACES, as 64-bit numbers; two sets differ in no more of
    these than in shingles."""
    n = len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    place = ((h ^ (h >> np.uint64(31))) * _ODD[0, 0] >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(of * PLACES + place, minlength=n * PLACES).reshape(n, PLACES) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def _packed(h: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Each set's hashes as five bytes each."""
    raw = h.view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
    return [raw[5 * s : 5 * e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def _unpacked(raw: pa.Scalar) -> np.ndarray:
    held = np.frombuffer(raw.as_buffer(), np.uint8).reshape(-1, 5)
    out = np.zeros((len(held), 8), np.uint8)
    out[:, :5] = held
    return out.view(np.uint64)[:, 0]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        h, n = np.unique(sets(*hashed(*flat(b.column("text")), 1), LONG_SHINGLE)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["shingle", "n"])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles of a sample of texts(text, hash), sorted, and how often each is there."""
    parts = -(-texts.count() // SAMPLE)
    sample = texts.where(F.pmod("hash", F.lit(parts)) == 0) if parts > 1 else texts
    held = sample.select("text").mapInArrow(_count_batches, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = sorted(map(tuple, held.where("n > 1").orderBy(F.desc("n"), "shingle").limit(COMMON).collect()))
    return np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows], np.int64)


def sketches(texts: DataFrame) -> DataFrame:
    """(doc_id, hash, node, size, prefix, odd): the set's name, size, first shingles and parities of each of texts(doc_id, text, hash)."""
    shared = texts.sparkSession.sparkContext.broadcast(common_shingles(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            h, at = sets(*hashed(*flat(b.column("text")), 1), LONG_SHINGLE)
            node = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in _packed(h, at)), np.uint64, b.num_rows)
            first, first_at = prefixes(h, at, *shared.value)
            odd = parities(h, at)
            lists = [_lists(first.view(np.int64), first_at), _lists(odd.ravel(), np.arange(b.num_rows + 1) * odd.shape[1])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("hash"), pa.array(node.view(np.int64)), pa.array(np.diff(at)), *lists], ["doc_id", "hash", "node", "size", "prefix", "odd"])

    return texts.mapInArrow(run, "doc_id long, hash long, node long, size long, prefix array<long>, odd array<long>")


def brief(h: np.ndarray) -> bytes:
    """Parities as in parities(), by at least two places a shingle, so that they tell large sets apart too. The number of
    places is a power of 2: halves laid on each other are the parities by half as many."""
    places = max(PLACES, 1 << (2 * len(h) - 1).bit_length())
    at = ((h ^ (h >> np.uint64(31))) * _ODD[0, 0] >> np.uint64(20)) & np.uint64(places - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes()


def briefly_alike(x: bytes, y: bytes, size: int) -> bool:
    """Whether sets of `size` shingles together may be similar enough by their briefs; true for all that are."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum()) <= size * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        h, at = sets(*hashed(*flat(b.column("text")), 1), LONG_SHINGLE)
        short = [brief(h[i:j]) for i, j in zip(at[:-1], at[1:])]
        columns = [b.column("node"), pa.array(np.diff(at)), pa.array(short, pa.binary()), pa.array(_packed(h, at), pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["node", "size", "brief", "held"])


def _brief_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.add(b.column("size_a"), b.column("size_b")).tolist()
        good = [briefly_alike(x.as_buffer(), y.as_buffer(), n) for x, y, n in zip(b.column("brief_a"), b.column("brief_b"), size)]
        yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good, pa.bool_())) for c in ("a", "b")], ["a", "b"])


def _similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        good = np.zeros(b.num_rows, bool)
        for i, (x, y) in enumerate(zip(b.column("held_a"), b.column("held_b"))):
            x, y = _unpacked(x), _unpacked(y)
            both = len(np.intersect1d(x, y, True))
            good[i] = both >= SIMILAR * (len(x) + len(y) - both) - 1e-9
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(good)), b.column("b").filter(pa.array(good))], ["a", "b"])


def _similar(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough; held(node, size, brief, held) has each node's. Sets travel for
    the pairs that their briefs leave, as a set of a long text is many times its brief; they are gone when the pairs are known."""
    with for_now(held) as held:
        for n in ("a", "b"):
            pairs = pairs.join(held.select(F.col("node").alias(n), F.col("size").alias(f"size_{n}"), F.col("brief").alias(f"brief_{n}")), n)
        pairs = cut(pairs.mapInArrow(_brief_batches, "a long, b long"))
        for n in ("a", "b"):
            pairs = pairs.join(held.select(F.col("node").alias(n), F.col("held").alias(f"held_{n}")), n)
        return cut(pairs.select("a", "b", "held_a", "held_b").mapInArrow(_similar_batches, "a long, b long"))


def _may_be_alike(size: Column, odd: Column, size_b: Column, odd_b: Column) -> Column:
    """No similarity exceeds that of the sizes; and sets that are similar enough differ in few shingles, so in few parities."""
    bits = F.aggregate(F.zip_with(odd, odd_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return (F.least(size, size_b) >= SIMILAR * F.greatest(size, size_b) - 1e-9) & (bits <= (size + size_b) * ((1 - SIMILAR) / (1 + SIMILAR)) + 1e-6)


def _band(size: Column) -> Column:
    """Sets that are similar enough have sizes in one band or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / SIMILAR)) + 1e-9).cast("int")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, node, label), a row for each row of docs; hash is one of the text, label stands for a group.

    Of the nodes that share a key (a shingle of their prefixes), in an order drawn for each key, all are first compared
    with the first and with the one before. Most of a group of copies are then in one component, even if not all are
    similar to each other, and only nodes outside their key's largest component are compared with all of the others; no
    pair that could join two components is left out.
    """
    on_workers(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("hash"))
    # Prefixes, most of what is written, go once the keys are told.
    with for_now(sketches(plain)) as rows:
        held_by_node = rows.where("size > 0").groupBy("node")
        keys = held_by_node.agg(F.first("prefix").alias("prefix")).select("node", F.explode("prefix").alias("key"))
        nodes = held_by_node.agg(F.min("size").alias("size"), F.first("odd").alias("odd"), F.min(F.struct("doc_id", "hash")).alias("one"))
        # The first of its key and the one before tell a node their numbers; it is alone if nobody else has the key.
        drawn = "over (partition by key order by xxhash64(node, key), node)"
        ruled = keys.selectExpr("node", "key", f"first(node) {drawn} as first", f"lag(node) {drawn} as before", f"lead(node) {drawn} as next")
        shared = ruled.where("before is not null or next is not null")
        # Of a node at most a fifth of its shingles, and one.
        keyed = shared.groupBy("node").agg(F.collect_list("key").alias("keys"), F.array_except(F.array_union(F.collect_set("first"), F.collect_set("before")), F.array("node")).alias("firsts"))
        keyed, rows = cut(keyed.join(nodes, "node")), cut(rows.select("doc_id", "hash", "node"))
    other = lambda names: keyed.select(*[F.col(c).alias(f"{c}_b") for c in names])
    first = keyed.select("node", "size", "odd", F.explode("firsts").alias("node_b")).join(other(["node", "size", "odd"]), "node_b")
    first = cut(first.where(_may_be_alike(F.col("size"), F.col("odd"), F.col("size_b"), F.col("odd_b"))).select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct())
    one = cut(keyed.select("node", F.col("one.doc_id").alias("one_id"), F.col("one.hash").alias("one_hash")))

    def held(pairs: DataFrame) -> DataFrame:
        """(node, size, brief, held): the sets of the pairs' nodes, each from one of its texts."""
        asked = cut(one.join(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "node", "left_semi"))
        texts = plain.join(bounded(asked), F.col("hash").eqNullSafe(F.col("one_hash")) & F.col("doc_id").eqNullSafe(F.col("one_id")))
        return texts.select("node", "text").mapInArrow(_set_batches, "node long, size long, brief binary, held binary").groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "brief", "held")])

    label = components(_similar(first, held(first)))
    known = cut(keyed.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")))
    # Keys whose nodes are of several components, by counts alone; the rest of what a node has joins only those. Of up to
    # three nodes all pairs were compared.
    member = known.select("node", "label", F.explode("keys").alias("key"))
    held_by = member.groupBy("key", "label").agg(F.count("*").alias("n"))
    several = cut(held_by.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n")).where("labels > 1 and n > 3").select("key", "main"))
    mixed = cut(member.join(several, "key"))
    about = known.select("node", "size", "odd")
    outside = mixed.where("label <> main").join(about, "node").withColumn("band", _band(F.col("size")))
    others = mixed.join(about, "node").withColumn("band", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: _band(F.col("size")) + d)))
    others = others.select("key", "band", *[F.col(c).alias(f"{c}_b") for c in ("node", "size", "odd", "label")])
    once = (F.col("label_b") == F.col("main")) | (F.col("node") < F.col("node_b"))
    alike = _may_be_alike(F.col("size"), F.col("odd"), F.col("size_b"), F.col("odd_b"))
    rest = outside.join(others, ["key", "band"]).where((F.col("label") != F.col("label_b")) & once & alike)
    rest = rest.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    rest = cut(rest.join(first, ["a", "b"], "left_anti"))
    more = _similar(rest, held(rest))
    # What these pairs join are the groups found so far.
    of = known.select("node", "label")
    more = more.join(of.toDF("a", "label_a"), "a").join(of.toDF("b", "label_b"), "b").select("label_a", "label_b").distinct()
    joined = components(more, "label_a", "label_b").toDF("label", "far")
    label = label.join(joined, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    alone = joined.join(label.select(F.col("node").alias("label")), "label", "left_anti").toDF("node", "label")
    label = cut(label.unionByName(alone))
    return rows.join(label, "node", "left").select("doc_id", "hash", "node", F.coalesce("label", "node").alias("label"))


# ---- keys that most near copies share; deduplicate_similar, which may miss none, goes by prefixes


def long_fingerprints(h: np.ndarray, at: np.ndarray, n: int = LONG) -> np.ndarray:
    """n fingerprints of 64 bits of each set, each of hashes mixed anew."""
    out = np.zeros((len(at) - 1, n), np.uint64)
    for k in range(n):
        x = (h ^ (h >> np.uint64(31))) * _ODD[0, k]
        x = (x ^ (x >> np.uint64(29))) * _ODD[1, k]
        out[:, k] = majority(x ^ (x >> np.uint64(32)), np.diff(at))
    return out.view(np.int64)


def word_fingerprints(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each set's WORDS fingerprints of BITS bits, cut from as many 64-bit ones as it takes."""
    n, size = len(at) - 1, BITS // 8
    bits = long_fingerprints(h, at, -(-WORDS * size // 8))
    out = np.zeros((n, WORDS, 8), np.uint8)
    out[:, :, :size] = bits.view(np.uint8)[:, : WORDS * size].reshape(n, WORDS, size)
    return out.view(np.int64)[:, :, 0]


def piece_keys(word: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Each text's 2 * CUTS keys, -1 for a piece that is too small; word: the hash of each word, count: words of each text."""
    n, ends = len(count), np.cumsum(count)
    of = np.repeat(np.arange(n), count)
    pair = np.zeros(len(word), np.uint64)
    pair[:-1] = word[:-1] * _ODD[0, 0] + word[1:] * _ODD[0, 1]
    # 40 bits of a pair's hash above the place in the text; a text's last word begins no pair.
    place = np.arange(len(word)) - (ends - count)[of]
    last = place == count[of] - 1
    full = np.flatnonzero(count > 1)
    out = np.full((n, 2 * CUTS), -1, np.int64)
    for k in range(CUTS):
        x = (pair ^ (pair >> np.uint64(29))) * _ODD[1, k]
        x = np.where(last, np.uint64(0xFFFFFFFFFFFFFFFF), x >> np.uint64(1))
        left = np.zeros(n, np.int64)
        if len(full):
            least = np.minimum.reduceat(x, (ends - count)[full])
            best = np.zeros(n, np.uint64)
            best[full] = least
            at = np.flatnonzero((x == best[of]) & ~last)
            left[of[at[::-1]]] = place[at[::-1]] + 1  # of equal ones the first
        sizes = np.stack([left, count - left], 1)
        prints = long_fingerprints(*sets(word, sizes.ravel(), PAIR), 1).reshape(n, 2).view(np.uint64) >> np.uint64(64 - BITS)
        big = (sizes * SHARE >= count[:, None]) & (left > 0)[:, None]
        keys = (np.arange(2) + PIECES + 2 * k << BITS) + prints.astype(np.int64)
        out[:, 2 * k : 2 * k + 2] = np.where(big, keys, -1)
    return out


# ---- one document of each group


def one_of_each(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with one document of each label of labels(doc_id, hash, label): that of the smallest doc_id (null ids
    last), and of these of the smallest text hash; of repeated rows one stays. The columns are those of docs.

    What goes, not what stays, is joined to docs, as it is less; if it is few, no text is shuffled.
    """
    rows = cut(labels.groupBy("doc_id", "hash", "label").agg(F.count("*").alias("n")))
    first = rows.groupBy("label").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "hash")).alias("m"))
    is_first = F.col("doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("hash") == F.col("m.hash"))
    go_id, go_hash, text_hash = fresh(docs, "go_id", "go_hash", "text_hash")
    go = rows.join(first, "label").where(~is_first | (F.col("n") > 1))
    go = cut(go.select(F.col("doc_id").alias(go_id), F.col("hash").alias(go_hash), is_first.alias("stays")))
    held = docs.withColumn(text_hash, F.xxhash64("text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(go_id)) & (F.col(text_hash) == F.col(go_hash))
    others = held.join(bounded(go.drop("stays")), same, "left_anti")
    repeated = held.join(bounded(go.where("stays").drop("stays")), same, "left_semi").dropDuplicates(["doc_id", text_hash])
    return others.unionByName(repeated).select(*docs.columns)


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component of near_duplicates."""
    return one_of_each(docs, labelled(docs))


def deduplicate_similar(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies by five-word similarity."""
    with tidy(docs.sparkSession):
        return one_of_each(docs, grouped(docs))
