"""Language identification by mixture inference.

Each language has a distribution over hashed 4-byte grams, counted over all training rows. A document
is a mixture: every word comes from one language. Expectation-maximisation estimates the proportions,
and the set of languages is the one of least penalised likelihood among nested sets, in the order of the
proportions under all languages. The penalty of a further language is PENALTY * log(words), twice that of
BIC: the words of a text are not independent.

Null texts and texts without a letter are `und` with score 0. Rows with a null lang teach nothing.
Without any training row every text is `und`. Ties go to the first language in sorted order. Texts are
read whole; repeated rows count as often as they occur in training and give equal predictions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fold, on_workers, slices

GRAM, BUCKETS = 4, 1 << 16
#: Added to each count; EM rounds of the ranking fit and of each fit of a set.
SMOOTH, RANK_ROUNDS, FIT_ROUNDS = 0.25, 4, 8
PENALTY = 2

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 256)


def grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The folded bytes with blanks after each text, where each text begins in them (and the last ends), and at
    each byte the bucket of the gram that begins there. The blanks are so many that no gram has bytes of two texts."""
    n = len(starts) - 1
    gap = GRAM - 1
    x = np.full(len(data) + gap * n, 0x20, np.uint8)
    doc = np.repeat(np.arange(n), np.diff(starts))
    x[np.arange(len(data)) + gap * doc] = _FOLD[data]
    v = np.concatenate([x, np.full(GRAM, 0x20, np.uint8)]).astype(np.uint32)
    m = len(x)
    h = v[:m] | v[1 : m + 1] << np.uint32(8) | v[2 : m + 2] << np.uint32(16) | v[3 : m + 3] << np.uint32(24)
    return x, starts + gap * np.arange(n + 1), ((h * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for b in slices(batches, "text"):
        data, starts = flat(b.column("text"))
        x, starts, h = grams(data, starts)
        langs = np.array(b.column("lang").to_pylist(), object)
        spaced = x == 0x20
        for lang in set(langs):
            mask = np.repeat(langs == lang, np.diff(starts))
            mask[:-1] &= ~(spaced[:-1] & spaced[1:])
            mask[-1:] = False
            got = np.bincount(h[mask], minlength=BUCKETS)
            sums[lang] = sums[lang] + got if lang in sums else got
    for lang, s in sums.items():
        at = np.flatnonzero(s)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(s[at])], ["lang", "bucket", "n"])


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and log P(gram | language) as an array of buckets by languages.

    What reaches the driver is one number for each of the 65,536 buckets and each language.
    """
    on_workers(docs.sparkSession)
    rows = docs.where((fold() != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string"), F.col("lang").cast("string"))
    sums = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sums.column("lang").to_pylist()
    langs = sorted(set(names))
    n = np.full((BUCKETS, len(langs)), SMOOTH)
    np.add.at(n, (sums.column("bucket").to_numpy(), np.array([langs.index(x) for x in names], int)), sums.column("n").to_numpy())
    return langs, np.log(n / n.sum(axis=0)).astype(np.float32)


def _mix(lik: np.ndarray, of: np.ndarray, begin: np.ndarray, weights: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM on words' likelihoods (words by languages), words of a document together; a weight of 0 stays 0.
    The weights of each document, and the logarithm of its likelihood at them."""
    count = np.diff(np.append(begin, len(lik)))[:, None]
    for _ in range(rounds):
        r = lik * weights[of]
        r /= r.sum(axis=1, keepdims=True) + 1e-30
        weights = np.add.reduceat(r, begin, axis=0) / count
    return weights, np.add.reduceat(np.log((lik * weights[of]).sum(axis=1) + 1e-30), begin)


def proportions(data: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each text's language proportions, zero for languages outside its chosen set; all zero without a word."""
    n_docs, n_lang = len(starts) - 1, table.shape[1]
    out = np.zeros((n_docs, n_lang), np.float32)
    if not len(data) or not n_lang:
        return out
    x, starts, h = grams(data, starts)
    inside = x != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < len(x)]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    if not len(at):
        return out
    ll = np.zeros((len(x), n_lang), np.float32)
    ll[inside] = table[h[inside]]
    words = np.add.reduceat(ll, at, axis=0)
    top = words.max(axis=1, keepdims=True)
    lik = np.exp(words - top)
    doc = np.searchsorted(starts, at, side="right") - 1
    here, begin = np.unique(doc, return_index=True)
    of = np.searchsorted(here, doc)
    count = np.diff(np.append(begin, len(at)))
    weights, _ = _mix(lik, of, begin, np.full((len(here), n_lang), 1 / n_lang, np.float32), RANK_ROUNDS)
    alone = np.log(lik + 1e-30)
    single = np.add.reduceat(alone, begin, axis=0)
    order = np.argsort(-weights, axis=1, kind="stable")
    best = np.zeros_like(weights)
    one = np.argmax(single, axis=1)
    best[np.arange(len(here)), one] = 1
    least = -2 * single.max(axis=1)
    live = np.arange(len(here))
    for k in range(2, n_lang + 1):  # one more language as long as that pays
        mine = np.zeros(len(here), bool)
        mine[live] = True
        rows = mine[of]
        start = np.zeros((len(live), n_lang), np.float32)
        np.put_along_axis(start, order[live, :k], 1 / k, axis=1)
        b = np.cumsum(count[live]) - count[live]
        got, fit = _mix(lik[rows], np.repeat(np.arange(len(live)), count[live]), b, start, FIT_ROUNDS)
        cost = -2 * fit + PENALTY * (k - 1) * np.log(np.maximum(count[live], 2))
        won = cost < least[live]
        best[live[won]], least[live[won]] = got[won], cost[won]
        live = live[won]
        if not len(live):
            break
    out[here] = best
    return out


def identify(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score, languages): the likeliest language, its share, and the chosen set's shares."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            data, starts = flat(b.column("text"))
            p = proportions(data, starts, shared.value)
            ascii_letter = ((data | 0x20) >= ord("a")) & ((data | 0x20) <= ord("z"))
            has = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[starts]) > 0
            for i in np.flatnonzero(~has & (np.diff(starts) > 0)):
                has[i] = any(c.isalpha() for c in b.column("text")[int(i)].as_py())
            known = has & (p.sum(axis=1) > 0) if p.shape[1] else np.zeros(len(has), bool)
            top = p.argmax(axis=1) if p.shape[1] else np.zeros(len(has), int)
            pred = [langs[t] if k else "und" for t, k in zip(top, known)]
            score = np.where(known, p.max(axis=1) if p.shape[1] else 0.0, 0.0).astype(np.float64).clip(0, 1)
            share = [[(langs[j], float(w)) for j, w in enumerate(row) if w > 0] if k else [] for row, k in zip(p, known)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(share, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "languages"])

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return held.mapInArrow(run, "doc_id long, lang_pred string, score double, languages map<string,double>")
