"""Suffix-array dedup: bytes covered by strings of LENGTH bytes that also start anywhere else.

The text is cut into stretches that can hold such strings, and the suffixes of these are ordered by
merging the Burrows-Wheeler transforms of shards: the interleave of the shards' sorted suffixes is
refined round by round (each round one symbol deeper) from the transforms alone, as in Holt and
McMillan's method; the round in which two neighbours part is their common prefix, and the intervals
that have not parted after LENGTH bytes are the repeats. Suffixes are sorted within shards only.

A symbol is the name of HOP bytes, and a suffix's next symbol begins HOP bytes on; so a stretch is HOP
interleaved strings, LENGTH bytes are LENGTH / HOP symbols, and rounds are few.

Stretches. Each string of SPAN bytes selects the least hash of its GRAM-byte grams. Equal strings of
LENGTH bytes select equal hashes throughout, so a hash selected at one place only in the corpus ends
every string about it. What is left is dealt out by the least hash within each string of LENGTH bytes:
equal strings meet in one bucket, and equal stretches are collapsed before they travel, so a group of
copies with any number of rows is one stretch there. Where very many places select one hash (a line that
stands in many surroundings), its stretches are split further where the second-least hash changes, on
which equal strings agree too. None of this drops a repeat. Texts are told apart by two 64-bit hashes,
stretches by their least hash, 128 more bits and their size.

Null texts count as empty. Texts under LENGTH bytes keep everything. Repeated rows are copies of each
other and lose what is long enough. Texts are read whole, as UTF-8 bytes; matches never cross rows.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, flat, on_workers, slices

LENGTH, HOP = 400, 100
GRAM, SPAN = 64, 300
#: Bytes of stretches in a bucket, about, and in a shard; places that select a hash, beyond which its stretches are split further.
BUCKET, SHARD, HOT = 1_000_000, 250_000, 1000

_TABLE = np.random.default_rng(23).integers(0, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done, step = done * 2, step * step % (1 << 64)
    return out


def hashes(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place on."""
    n = len(x) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * _powers(_BASE, len(x)), out=sums[1:])
    h = (sums[k:] - sums[:n]) * _powers(_INVERSE, n)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding(a: np.ndarray, w: int, least: Callable = np.minimum) -> np.ndarray:
    """The least (or greatest) of each w values in a row."""
    if len(a) < w:
        return a[:0]
    span = 1
    while span * 2 <= w:
        a = least(a[:-span], a[span:])
        span *= 2
    rest = w - span
    return least(a[: len(a) - rest], a[rest:]) if rest else a


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, check, h): the selected hash of each place that some string of SPAN bytes selects."""
    w = SPAN - GRAM + 1
    for b in slices(batches, "text", 2_000_000):
        data, starts = flat(b.column("text"))
        h = hashes(data, GRAM)
        low = sliding(h, w)
        ends = np.repeat(starts[1:], np.diff(starts))
        low[np.arange(SPAN, SPAN + len(low)) > ends[: len(low)]] = 0  # a string over the end of a text selects nothing
        pad = np.zeros(w - 1, np.uint64)
        at = np.flatnonzero((sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h) & (h > 0)) if len(low) else np.zeros(0, int)
        doc = np.searchsorted(starts, at, side="right") - 1
        yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(doc)), b.column("check").take(pa.array(doc)), pa.array(h[at].view(np.int64))], ["key", "check", "h"])


def second(h: np.ndarray, w: int, least: np.ndarray) -> np.ndarray:
    """The least but one of the different values of each w in a row, whose least are given; the greatest number if there is none."""
    # Runs of one least: in each, that value is masked out and the rest looked at again.
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(least), none, np.uint64)
    edge = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1], [True]])) if len(least) else np.zeros(0, int)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        part = h[a : b + w - 1]
        out[a:b] = sliding(np.where(part == least[a], none, part), w)
    return out


def stretches(x: np.ndarray, repeated: np.ndarray, hot: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(first, last + 1, least hash, second-least or 0) of runs of places where a repeated string may start, split where
    the least hash changes, and where that is among the hot ones where the second-least does."""
    if len(x) < LENGTH:
        return []
    h = hashes(x, GRAM)
    bad = ~np.isin(sliding(h, SPAN - GRAM + 1), repeated)
    sums = np.concatenate([[0], np.cumsum(bad)])
    n = len(x) - LENGTH + 1
    ok = sums[LENGTH - SPAN + 1 : LENGTH - SPAN + 1 + n] == sums[:n]
    if not ok.any():
        return []
    w = LENGTH - GRAM + 1
    least = sliding(h, w)
    then = np.zeros(n, np.uint64)
    if len(hot):
        some = np.isin(least, hot) & ok
        edge = _runs(some)
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            then[a:b] = second(h[a : b + w - 1], w, least[a:b])
    edge = np.ones(n + 1, bool)
    edge[1:-1] = (least[1:] != least[:-1]) | (then[1:] != then[:-1]) | (ok[1:] != ok[:-1])
    at = np.flatnonzero(edge)
    return [(a, b, int(least[a]), int(then[a])) for a, b in zip(at[:-1].tolist(), at[1:].tolist()) if ok[a]]


#: What tells stretches apart: least hash, second-least (0 where it doesn't split), two hashes of the bytes, size.
NAMED = ["m", "then", "sh", "sh2", "size"]
NAMED_TYPE = "m long, then long, sh long, sh2 long, size int"


def _cut_out(with_bytes: bool) -> Callable:
    """The stretches of each text: their names, with their bytes or with the text's key and their first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in slices(batches, "text"):
            data, starts = flat(b.column("text"))
            raw = data.tobytes()
            row, first, name, size, seg = [], [], [], [], []
            for i, (hs, hot) in enumerate(zip(b.column("hs"), b.column("hot"))):
                lo, hi = int(starts[i]), int(starts[i + 1])
                hs, hot = (v.values.to_numpy() if v.is_valid else none for v in (hs, hot))
                for p, q, m, then in stretches(data[lo:hi], hs.view(np.uint64), hot.view(np.uint64)):
                    s = raw[lo + p : lo + q + LENGTH - 1]
                    sh = xxhash.xxh3_128_intdigest(s)
                    row.append(i), first.append(p), size.append(len(s))
                    name.append((m, then, sh >> 64, sh & 0xFFFFFFFFFFFFFFFF))
                    if with_bytes:
                        seg.append(s)
            names = np.array(name, np.uint64).reshape(-1, 4).view(np.int64)
            cols = [*[pa.array(names[:, j]) for j in range(4)], pa.array(size, pa.int32())]
            if with_bytes:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(seg, pa.binary())], [*NAMED, "seg"])
            else:
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*cols, b.column("key").take(at), b.column("check").take(at), pa.array(first, pa.int32())], [*NAMED, "key", "check", "first"])

    return run


class Shard:
    """The sorted suffixes of some stretches, as their Burrows-Wheeler transform over symbols of HOP bytes.

    Rows are all places of the stretches and the HOP places past each one's last symbol, where its
    interleaved strings end; ends sort before all symbols, in their own order.
    """

    def __init__(self, name: np.ndarray, is_end: np.ndarray, has_before: np.ndarray) -> None:
        n = len(name)
        ends = np.flatnonzero(is_end)
        self.ends = len(ends)
        rank = name + len(ends)
        rank[ends] = np.arange(len(ends))
        step = HOP
        place = np.arange(n)
        while True:
            ahead = np.where(is_end, 0, np.minimum(place + step, n - 1))
            # A suffix that ends within `step` has a rank of its own by then; what follows it doesn't matter.
            pair = rank.astype(np.uint64) << np.uint64(32) | rank[ahead].astype(np.uint64)
            order = np.argsort(pair)
            srt = pair[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(srt[1:] != srt[:-1])]) if n else 0
            rank = new
            if not n or rank[order[-1]] == n - 1 or step > n:
                break
            step *= 2
        self.rows = order
        before = np.where(has_before, np.maximum(place - HOP, 0), 0)
        #: The symbol before each suffix in sorted order; -1 at a string's start.
        self.bwt = np.where(has_before, name[before], -1)[order]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes to `depth` symbols: of each merged row, its shard, its row in the
    shard, and its common prefix in symbols with the row before (depth, if they have not parted)."""
    n = sum(len(s.rows) for s in shards)
    z = np.repeat(np.arange(len(shards)), [len(s.rows) for s in shards])
    fixed = np.repeat(np.arange(len(shards)), [s.ends for s in shards])  # the ends: first, shard by shard
    prefix = np.full(n, depth)
    block = np.zeros(n, np.int64)
    for level in range(depth):
        symbol = np.empty(n, np.int64)
        for j, s in enumerate(shards):
            symbol[z == j] = s.bwt
        inner = np.flatnonzero(symbol >= 0)
        key = np.sort(symbol[inner].astype(np.uint64) << np.uint64(32) | inner.astype(np.uint64))
        source = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = symbol[source]
        z = np.concatenate([fixed, z[source]])
        part = np.ones(n, bool)
        at = len(fixed)
        part[at + 1 :] = (first[1:] != first[:-1]) | (block[source[1:]] != block[source[:-1]])
        prefix[part & (prefix == depth)] = level
        block = np.cumsum(part)
    row = np.empty(n, np.int64)
    for j, s in enumerate(shards):
        row[z == j] = np.arange(len(s.rows))
    return z, row, prefix


def repeats(segs: list[bytes], copies: np.ndarray) -> list[np.ndarray]:
    """Of each stretch: which of its strings of LENGTH bytes start at another place of these stretches too.
    copies: how many rows hold a stretch; with two or more all its strings do."""
    data = np.frombuffer(b"".join(segs), np.uint8)
    size = np.array([len(s) for s in segs], np.int64)
    start = np.cumsum(size) - size
    names = hashes(data, HOP)
    shard_of = start // SHARD
    places, local = [], []
    for j in np.unique(shard_of):
        mine = np.flatnonzero(shard_of == j)
        n = size[mine] + 1  # places 0 .. size, of which the last HOP are ends
        seg = np.repeat(mine, n)
        at = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        places.append((seg, at))
        local.append((at > size[seg] - HOP, at >= HOP))
    # Names as dense ranks, alike in all shards.
    order = np.argsort(names)
    ranks = np.empty(len(names), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(names[order[1:]] != names[order[:-1]])])
    shards = []
    for (seg, at), (is_end, has_before) in zip(places, local):
        name = np.where(is_end, 0, ranks[np.where(is_end, 0, start[seg] + at)])
        shards.append(Shard(name, is_end, has_before))
    depth = LENGTH // HOP
    z, row, prefix = merge(shards, depth)
    same = prefix >= depth
    twin = same.copy()
    twin[:-1] |= same[1:]
    out = [np.full(s - LENGTH + 1, c > 1) for s, c in zip(size.tolist(), copies.tolist())]
    hit = np.zeros(len(data) + len(segs), bool)
    base = start + np.arange(len(segs))
    for j, s in enumerate(shards):
        seg, at = places[j]
        mine = s.rows[row[(z == j) & twin]]
        hit[base[seg[mine]] + at[mine]] = True
    for i, o in enumerate(out):
        o |= hit[base[i] : base[i] + len(o)]
    return out


def _runs(mask: np.ndarray) -> np.ndarray:
    """First and last + 1 of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.astype(np.int32)


def _merged(t: pa.Table) -> pa.Table:
    segs = [s.as_py() for s in t.column("seg")]
    runs = [_runs(m).tobytes() for m in repeats(segs, t.column("n").to_numpy())]
    out = pa.table([*[t.column(c) for c in NAMED], pa.array(runs, pa.binary())], [*NAMED, "runs"])
    return out.filter(pa.array([len(r) > 0 for r in runs], pa.bool_()))


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        data, starts = flat(b.column("text"))
        raw = data.tobytes()
        rows = []
        for i, (d, cover) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("cover").to_pylist())):
            text = raw[starts[i] : starts[i + 1]]
            gone = np.zeros(len(text) + 1, np.int32)
            for c in cover or ():
                r = np.frombuffer(c["runs"], np.int32).reshape(-1, 2) + c["first"]
                np.add.at(gone, r[:, 0], 1)
                np.add.at(gone, r[:, 1] + LENGTH - 1, -1)
            spans = _runs(np.cumsum(gone[:-1]) > 0).reshape(-1, 2)
            kept, at = [], 0
            for s, e in spans.tolist():
                kept.append(text[at:s])
                at = e
            kept.append(text[at:])
            rows.append((d, len(text), spans.astype("<i4").tobytes(), b"".join(kept)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), a row for each row of docs; spans: packed pairs of 32-bit integers, first
    and last + 1 of each maximal removed run; kept: the remaining bytes."""
    on_workers(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(LENGTH), F.octet_length(text), text).alias("check"))
    of = lambda df: df.withColumnsRenamed({"key": "of_key", "check": "of_check"})
    same = (F.col("key") == F.col("of_key")) & (F.col("check") == F.col("of_check"))
    anchors = rows.select("key", "check", "text").mapInArrow(_anchors, "key long, check long, h long")
    # Kept first, so that both sides of the join are exchanges of their own: Spark can then split a hash of very many rows.
    twice = cut(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
    sets = [F.collect_set("h").alias("hs"), F.collect_set(F.when(F.col("n") > HOT, F.col("h"))).alias("hot")]
    of_text = cut(of(anchors.join(twice, "h").groupBy("key", "check").agg(*sets)))
    n = of_text.agg(F.coalesce(F.sum(F.size("hs")), F.lit(0))).first()[0]
    # A selected hash stands for about (SPAN - GRAM) / 2 bytes of text, a stretch has some four times that.
    buckets = max(1, n * 2 * (SPAN - GRAM) // BUCKET)
    some = rows.join(of_text, same).select("key", "check", "text", "hs", "hot")
    at = some.mapInArrow(_cut_out(False), NAMED_TYPE + ", key long, check long, first int").distinct()
    held = some.mapInArrow(_cut_out(True), NAMED_TYPE + ", seg binary").groupBy(*NAMED).agg(F.count("seg").alias("n"), F.first("seg").alias("seg"))
    merged = held.groupBy(F.pmod(F.xxhash64("m", "then"), F.lit(buckets)).alias("bucket")).applyInArrow(_merged, NAMED_TYPE + ", runs binary")
    cover = at.join(merged, NAMED).groupBy("key", "check").agg(F.collect_list(F.struct("first", "runs")).alias("cover"))
    # Kept first, as above: copies of one text are then dealt over several tasks.
    cover = cut(of(cover))
    return rows.join(cover, same, "left").select("doc_id", "text", "cover").mapInArrow(_removed, "doc_id long, n_bytes long, spans binary, kept binary")


def digests(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what remove_repeats gives."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), (F.octet_length("spans") / 8).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
