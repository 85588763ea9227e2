"""Document fingerprints by one-permutation MinHash, densified, in packed low-order bits.

A text's shingles of five lower-cased words are hashed once; a hash's first bits name its bin, and each bin
keeps its least hash. An empty bin takes the value of the bin that a fixed sequence of probes finds first
among those that are full (optimal densification). Of each value the low-order BITS bits are stored. The
likeness of two fingerprints is the share of equal values less what chance makes equal:
(share - 2 ** -BITS) / (1 - 2 ** -BITS), at least 0, an estimate of the similarity of the shingle sets.

Texts of under five words have one shingle, all their words; those without a word (null and empty ones too)
have the fingerprint of zeros, are like each other by 1 and unlike all others. Texts are read whole.

with_successors puts each document beside the next, in the order of ids (null ids first, equal ids by
their text, repeated rows beside each other; after the last comes the first), with one shuffle of the texts:
ids are cut into ranges, a range is one sorted run of a task, and its last document meets a copy of the
first one of the next range. A lone document follows itself. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, on_workers
from .simhash import SEED, hashed

SHINGLE, BINS, BITS = 5, 256, 8
#: Bytes of texts and rows of a range, about; ranges at most (their borders are held on the driver).
RANGE_BYTES, RANGE_ROWS, RANGES = 1_000_000, 256, 50_000
#: Characters of texts that are hashed at a time, about.
CHUNK = 2_000_000
#: Probes made at a time for empty bins.
PROBES = 16
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ODD = np.random.default_rng(SEED).integers(1 << 63, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Numbers whose every bit depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(data: np.ndarray, starts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle of k words, repeats included, and the number of the text that it is of."""
    word, count = hashed(data, starts, 1)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    of = np.repeat(np.arange(len(count)), n)
    at = np.arange(len(of)) + np.repeat(np.cumsum(count) - count - np.cumsum(n) + n, n)
    end = np.cumsum(count)[of]
    h = np.zeros(len(of), np.uint64)
    for j in range(k):
        here = at + j < end
        h[here] += word[at[here] + j] * _ODD[j]
    return _mixed(h), of


def densified(least: np.ndarray) -> np.ndarray:
    """Rows of bins in which each empty bin (_EMPTY) has the value of a full one; rows without a full one stay."""
    bins = least.shape[1]
    row, bin_ = np.nonzero((least == _EMPTY) & (least != _EMPTY).any(axis=1, keepdims=True))
    out, at = least.copy(), 0
    while len(row):
        tries = np.arange(at, at + PROBES, dtype=np.uint64)
        probe = (_mixed(bin_.astype(np.uint64)[:, None] * np.uint64(1 << 32) + tries + np.uint64(1)) % np.uint64(bins)).astype(np.int64)
        got = least[row[:, None], probe]
        first = (got != _EMPTY).argmax(axis=1)
        value = got[np.arange(len(row)), first]
        done = value != _EMPTY
        out[row[done], bin_[done]] = value[done]
        row, bin_, at = row[~done], bin_[~done], at + PROBES
    return out


def packed(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The low-order bits of each row's values, one after another, as bytes."""
    low = (values[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(low.astype(np.uint8).reshape(len(values), values.shape[1] * bits), axis=1)


def fingerprints(data: np.ndarray, starts: np.ndarray, bins: int = BINS, bits: int = BITS) -> np.ndarray:
    """Each text's packed fingerprint, a row of bytes; bins is a power of two."""
    h, of = shingle_hashes(data, starts)
    n = len(starts) - 1
    least = np.full(n * bins, _EMPTY)
    np.minimum.at(least, of * bins + (h >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64), h)
    out = packed(densified(least.reshape(n, bins)), bits)
    out[np.bincount(of, minlength=n) == 0] = 0
    return out


def unpacked(prints: np.ndarray, bits: int = BITS) -> np.ndarray:
    each = np.unpackbits(prints, axis=1).reshape(len(prints), -1, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1))


def likeness(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The estimated similarity of the texts of two packed fingerprints, row by row."""
    chance = 0.5**bits
    share = (unpacked(a, bits) == unpacked(b, bits)).mean(axis=1) if len(a) else np.zeros(0)
    none_a, none_b = ~a.any(axis=1), ~b.any(axis=1)
    return np.where(none_a | none_b, (none_a & none_b).astype(float), np.clip((share - chance) / (1 - chance), 0, 1))


def _of_texts(texts: list[str]) -> np.ndarray:
    return fingerprints(*flat(pa.array(texts, pa.large_string())))


def edited(text: str, after: str) -> str:
    """The text whose last half (rounded down) is replaced by the first as many characters of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint), a row for each row of docs, without a shuffle."""
    on_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = fingerprints(*flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([p.tobytes().hex() for p in prints], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def with_successors(docs: DataFrame, run: Callable[[Iterator[list[tuple[int, str, str]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `run` makes of lists of (doc_id, text, the next document's text); null texts are empty."""
    spark = docs.sparkSession
    on_workers(spark)
    least = -(2**63)
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(least)))
    n, size = plain.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    ranges = max(1, min(RANGES, size // RANGE_BYTES, n) if size // RANGE_BYTES > n // RANGE_ROWS else min(RANGES, n // RANGE_ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    borders = (plain.agg(F.percentile_approx("key", shares, max(10_000, 10 * ranges))).first()[0] if shares and n else None) or []
    borders = np.unique(np.array(borders, np.int64))

    @F.pandas_udf("long")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(borders, key.to_numpy(), side="left"))

    # The first id of each range: as many rows as there are ranges.
    firsts = sorted((r[0], r[1]) for r in plain.select(range_of("key").alias("range"), "key").groupBy("range").agg(F.min("key")).collect())
    target = {key: firsts[k - 1][0] for k, (_, key) in enumerate(firsts)}
    keys = np.array(sorted(target), np.int64)
    targets = np.array([target[k] for k in keys.tolist()], np.int64)

    @F.pandas_udf("long")
    def copied_to(key):
        import pandas as pd

        at = np.searchsorted(keys, key.to_numpy()).clip(0, max(len(keys) - 1, 0))
        return pd.Series(np.where(keys[at] == key.to_numpy(), targets[at], -1) if len(keys) else np.full(len(key), -1))

    placed = plain.withColumns({"range": range_of("key"), "copy": copied_to("key")})
    each = F.array(F.struct(F.col("range"), F.lit(False).alias("copied")), F.struct(F.col("copy").alias("range"), F.lit(True).alias("copied")))
    each = F.when(F.col("copy") >= 0, each).otherwise(F.slice(each, 1, 1))
    rows = placed.select("doc_id", "key", "text", F.explode(each).alias("p")).select("p.range", "p.copied", "key", "doc_id", "text")
    rows = rows.repartition("range").sortWithinPartitions("range", "copied", "key", "text")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, str, str]]]:
        out, held, before = [], 0, None
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("range", "copied", "doc_id", "text"))):
                if before is not None and before[0] == row[0] and not before[1]:
                    out.append((before[2], before[3], row[3]))
                    held += len(before[3]) + len(row[3])
                    if held > CHUNK:
                        yield out
                        out, held = [], 0
                before = row
        if out:
            yield out

    return rows.select("range", "copied", "doc_id", "text").mapInArrow(lambda b: run(pairs(b)), schema)


def half_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs:
    fingerprints of each text and of its edited text, and how alike the text is to that and to the next document."""

    def run(lists: Iterator[list[tuple[int, str, str]]]) -> Iterator[pa.RecordBatch]:
        for rows in lists:
            ids, texts, after = zip(*rows)
            new = [edited(t, a) for t, a in zip(texts, after)]
            # Each distinct text once: a text is often its neighbour's next one.
            distinct = list(dict.fromkeys([*texts, *new, *after]))
            place, prints = {t: i for i, t in enumerate(distinct)}, _of_texts(distinct)
            mine, its, next_ = (prints[[place[t] for t in x]] for x in (texts, new, after))
            hexes = lambda p: pa.array([r.tobytes().hex() for r in p], pa.string())
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in new]
            cols = [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests, pa.string()), hexes(mine), hexes(its), pa.array(likeness(mine, its)), pa.array(likeness(mine, next_))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_successors(docs, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
