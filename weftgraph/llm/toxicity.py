"""Toxicity: a bidirectional gated recurrent network with attention pooling, over words and characters.

A word is a run of letters, lower-cased (A-Z). Its input is an embedding of the word, if training saw it
in enough documents, beside the mean of embeddings of its hashed character grams. The network reads
windows of WINDOW words that begin every STRIDE words, so that they overlap; attention pools each
window's states, and a text's score is that of its most toxic window. Training is in numpy, on a
bounded sample of labelled rows: of each document's windows the worst by the network so far teaches.

Null texts, empty texts and texts without a letter have one window without words; its score is what
the network gives no evidence. Texts are scored whole, whatever their length. Only the text is an
input. Without labelled rows, or with one class only, the score is that class's rate (0 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, fold, on_workers, slices
from .langid import _FOLD

WINDOW, STRIDE = 32, 16
#: Labelled rows of each class that training reads, at most; of each it reads all windows.
SAMPLE = 1500
#: Hidden units of each direction, dimensions of a word's and of a gram's embedding, hashed grams.
HIDDEN, WORD_DIM, CHAR_DIM, GRAMS = 6, 6, 6, 1 << 12
#: Documents of the sample in which a word is seen to be known: so many, and such a share; known words at most.
SEEN, SEEN_SHARE, KNOWN = 6, 0.01, 4096
#: Steps in all, steps with the usual loss, windows of a step, rate of learning.
STEPS, PLAIN_STEPS, BATCH, RATE, SEED = 320, 180, 64, 0.01, 11
#: Exponent of the loss after the plain steps, and decay of the parameters at each step.
TRUST, DECAY = 0.8, 1e-3
THRESHOLD = 0.3
SLOTS = 1 << 18


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's hash; grams' buckets and where each word's begin in them; words of each text; word's first byte."""
    n = len(starts) - 1
    x = _FOLD[data]
    inside = x != 0x20
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = starts[:-1][starts[:-1] < len(x)]
    first[heads] = inside[heads]
    at = np.flatnonzero(first)
    doc = np.searchsorted(starts, at, side="right") - 1
    count = np.bincount(doc, minlength=n)
    letters = np.flatnonzero(inside)
    begin = np.searchsorted(letters, at)
    v = x[letters].astype(np.uint64)
    place = np.arange(len(letters)) - np.repeat(begin, np.diff(np.append(begin, len(letters))))
    key = _POWERS[np.minimum(place, 255)]
    mixed = (v + np.uint64(1)) * key
    word = np.add.reduceat(mixed, begin) if len(begin) else np.zeros(0, np.uint64)
    word ^= word >> np.uint64(29)
    # Grams of three letters, the first two padded by what stands before the word.
    last = np.where(place > 0, np.concatenate([[0], v[:-1]]).astype(np.uint64), np.uint64(1)) if len(v) else v
    last2 = np.where(place > 1, np.concatenate([[0, 0], v[:-2]]).astype(np.uint64)[: len(v)], np.uint64(2)) if len(v) > 1 else last
    gram = (v | last << np.uint64(8) | last2 << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(52)
    return word, gram.astype(np.int64), begin, count, at


_POWERS = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with so many words: each window's text, and its first word within it."""
    n = np.maximum(1, -(-(count - WINDOW) // STRIDE) + 1)
    of = np.repeat(np.arange(len(count)), n)
    return of, (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The parameters, a forward pass over windows of word vectors, and the gradient of its loss."""

    def __init__(self, known: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.known = np.sort(known)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": rng.normal(0, 0.3, (len(known) + 1, WORD_DIM)), "char": rng.normal(0, 0.3, (GRAMS, CHAR_DIM)), "u": rng.normal(0, 0.5, 2 * h), "w": rng.normal(0, 0.5, 2 * h), "b": np.zeros(1)}
        for way in "fb":
            self.p |= {f"x{way}": rng.normal(0, d**-0.5, (d, 3 * h)), f"h{way}": rng.normal(0, h**-0.5, (h, 3 * h)), f"c{way}": np.zeros(3 * h)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shift = 0.0
        self._slots = None

    def index(self, word: np.ndarray) -> np.ndarray:
        """Rows of the word embeddings, the last for unknown words: one probe of a table without collisions among the known."""
        if self._slots is None:
            slot = np.full(SLOTS, -1, np.int32)
            at = (self.known >> np.uint64(20)).astype(np.int64) % SLOTS
            slot[at] = np.arange(len(self.known))
            self._slots, self._lost = slot, np.flatnonzero(slot[at] != np.arange(len(self.known)))
        got = self._slots[(word >> np.uint64(20)).astype(np.int64) % SLOTS]
        hit = got >= 0
        hit[hit] = self.known[got[hit]] == word[hit]
        out = np.where(hit, got, len(self.known))
        for i in self._lost:  # the few that share a slot
            out[word == self.known[i]] = i
        return out

    def vectors(self, word: np.ndarray, gram: np.ndarray, begin: np.ndarray) -> np.ndarray:
        n = np.diff(np.append(begin, len(gram)))[:, None]
        chars = np.add.reduceat(self.p["char"][gram], begin, axis=0) / n if len(begin) else np.zeros((0, CHAR_DIM), np.float32)
        return np.concatenate([self.p["word"][self.index(word)], chars], axis=1)

    def _run(self, x: np.ndarray, way: str, real: np.ndarray, keep: list | None) -> np.ndarray:
        """States over time (time, windows, hidden); x holds time, windows, inputs projected to the three gates."""
        h, wh = np.zeros((x.shape[1], HIDDEN), np.float32), self.p[f"h{way}"]
        out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
        n = HIDDEN
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            g = h @ wh
            zr = _sigmoid(x[t, :, : 2 * n] + g[:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(x[t, :, 2 * n :] + r * g[:, 2 * n :])
            m = real[t]
            new = h + (z * m) * (c - h)
            if keep is not None:
                keep.append((t, h, z, r, c, g[:, 2 * n :], m))
            h = out[t] = new
        return out

    def forward(self, x: np.ndarray, real: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window. x: time, windows, word vector; real: time, windows, 1 where there is a word."""
        states = []
        for way in "fb":
            if keep is not None:
                keep[way] = []
            states.append(self._run(x @ self.p[f"x{way}"] + self.p[f"c{way}"], way, real, keep[way] if keep is not None else None))
        s = np.concatenate(states, axis=2)
        a = s @ self.p["u"] + np.where(real[:, :, 0] > 0, 0, -30).astype(np.float32)
        a = np.exp(a - a.max(axis=0))
        a /= a.sum(axis=0)
        pooled = (a[:, :, None] * s).sum(axis=0)
        if keep is not None:
            keep |= {"s": s, "a": a, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradient(self, x: np.ndarray, real: np.ndarray, y: np.ndarray, trust: float) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the mean loss, by every parameter but the embeddings, and by x.

        The loss is the generalised cross-entropy with exponent trust: at 0 the usual one, above
        that labels count less the less the network believes them, so that wrong labels fade.
        """
        keep: dict = {}
        prob = _sigmoid(self.forward(x, real, keep))
        d = ((prob - y) * np.where(y > 0, prob, 1 - prob) ** trust / len(y)).astype(np.float32)
        s, a, n = keep["s"], keep["a"], HIDDEN
        g = {"w": keep["pooled"].T @ d, "b": d.sum(keepdims=True)}
        dp = d[:, None] * self.p["w"]
        da = (s * dp).sum(axis=2)
        da = a * (da - (a * da).sum(axis=0))
        g["u"] = np.einsum("tb,tbh->h", da, s)
        ds = a[:, :, None] * dp + da[:, :, None] * self.p["u"]
        dx = np.zeros_like(x)
        for way, part in (("f", ds[:, :, :n]), ("b", ds[:, :, n:])):
            wx, wh = self.p[f"x{way}"], self.p[f"h{way}"]
            gx, gh, gc = np.zeros_like(wx), np.zeros_like(wh), np.zeros(3 * n, np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t, h, z, r, c, gn, m in reversed(keep[way]):
                dh = dh + part[t]
                dc = dh * z * m * (1 - c * c)
                dz = dh * (c - h) * m * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                gate = np.concatenate([dz, dr, dc], axis=1)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                gx += x[t].T @ gate
                gh += h.T @ inner
                gc += gate.sum(axis=0)
                dx[t] += gate @ wx.T
                dh = dh * (1 - z * m) + inner @ wh.T
            g |= {f"x{way}": gx, f"h{way}": gh, f"c{way}": gc}
        return g, dx


def _layout(of_word: np.ndarray, count: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word rows of windows as time, windows, and which of them are real."""
    begin = (np.cumsum(count) - count)[of] + at
    row = begin[None, :] + np.arange(WINDOW)[:, None]
    real = np.arange(WINDOW)[:, None] < (count[of] - at)[None, :]
    return np.where(real, row, 0), real[:, :, None].astype(np.float32)


def score(net: Network, data: np.ndarray, starts: np.ndarray, block: int = 2048) -> np.ndarray:
    """Each text's score: that of its worst window."""
    word, gram, begin, count, _ = words_of(data, starts)
    vec = net.vectors(word, gram, begin)
    if not len(vec):
        vec = np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)
    of, at = windows(count)
    logit = np.empty(len(of), np.float32)
    for i in range(0, len(of), block):
        row, real = _layout(word, count, of[i : i + block], at[i : i + block])
        logit[i : i + block] = net.forward(vec[row], real)
    top = np.full(len(count), -np.inf, np.float32)
    np.maximum.at(top, of, logit)
    return _sigmoid(top.astype(np.float64) + net.shift)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts: the hashes of each one's distinct words, their grams and numbers of grams, and the places of the words."""
    for b in slices(batches, "text"):
        word, gram, begin, count, _ = words_of(*flat(b.column("text")))
        size = np.diff(np.append(begin, len(gram)))
        base, out = np.concatenate([[0], np.cumsum(count)]), []
        for lo, hi in zip(base[:-1], base[1:]):
            own, at, place = np.unique(word[lo:hi], return_index=True, return_inverse=True)
            at += lo
            grams = [gram[begin[k] : begin[k] + size[k]] for k in at]
            out.append((own.tobytes(), place.astype(np.int32).tobytes(), np.concatenate([*grams, []]).astype(np.uint16).tobytes(), size[at].astype(np.int32).tobytes()))
        packed = [pa.array(c, pa.binary()) for c in zip(*out)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *packed], ["doc_id", "toxic", "words", "places", "grams", "sizes"])


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A network fitted on at most SAMPLE rows of each class; a rate if there are not two classes."""
    on_workers(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 2)).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    some = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    both = F.broadcast(some[0].unionByName(some[1]))  # at most 2 * SAMPLE rows of two numbers
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(both, "doc_id")
    packed = texts.mapInArrow(_packed, "doc_id long, toxic int, words binary, places binary, grams binary, sizes binary")
    got = packed.toPandas().sort_values(["doc_id", "words", "places"])
    y_doc = got.groupby("doc_id").toxic.first()
    if y_doc.nunique() < 2:
        return float(y_doc.mean()) if len(y_doc) else 0.0
    docs_at = y_doc.index.get_indexer(got.doc_id)
    y = y_doc.to_numpy().astype(np.float32)
    joined = lambda c, kind: np.frombuffer(b"".join(got[c]), kind)
    own = got.words.map(len).to_numpy() // 8
    count = got.places.map(len).to_numpy() // 4
    # Each word once for all texts, with its grams; place has its row for each word of the texts.
    word, first, same = np.unique(joined("words", np.uint64), return_index=True, return_inverse=True)
    size = joined("sizes", np.int32).astype(np.int64)
    begin_of, size = (np.cumsum(size) - size)[first], size[first]
    begin = np.cumsum(size) - size
    gram = joined("grams", np.uint16)[np.repeat(begin_of - begin, size) + np.arange(size.sum())].astype(np.int64)
    place = same[joined("places", np.int32) + np.repeat(np.cumsum(own) - own, count)].astype(np.int32)
    if not len(word):
        word, gram, begin, place = np.zeros(1, np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int32)
    pairs = np.unique(np.stack([joined("words", np.uint64), np.repeat(docs_at, own).astype(np.uint64)]), axis=1)[0]
    seen, times = np.unique(pairs, return_counts=True)
    seen = seen[np.argsort(-times, kind="stable")][: min(KNOWN, int((times >= max(SEEN, SEEN_SHARE * len(y))).sum()))]
    return fit(Network(seen), word, gram, begin, place, count, docs_at, y)


def fit(net: Network, word: np.ndarray, gram: np.ndarray, begin: np.ndarray, place: np.ndarray, count: np.ndarray, doc: np.ndarray, y: np.ndarray) -> Network:
    """Adam on windows: of each document the worst so far, and of clean ones another at random."""
    rng = np.random.default_rng(SEED)
    idx = net.index(word)
    n_gram = np.diff(np.append(begin, len(gram)))
    of, first = windows(count)
    doc = doc[of]
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def logits() -> np.ndarray:
        vec = net.vectors(word, gram, begin)
        out = np.empty(len(of), np.float32)
        for i in range(0, len(of), 2048):
            row, real = _layout(word, count, of[i : i + 2048], first[i : i + 2048])
            out[i : i + 2048] = net.forward(vec[place[row]], real)
        return out

    while step < STEPS:
        luck = logits() if step else rng.random(len(of))
        order = np.lexsort((-luck, doc))
        worst = order[np.unique(doc[order], return_index=True)[1]]
        other = rng.permutation(len(of))
        other = other[y[doc[other]] == 0][: len(worst)]
        todo = rng.permutation(np.concatenate([worst, other]))
        for i in range(0, min(len(todo), BATCH * (STEPS - step)), BATCH):
            w = todo[i : i + BATCH]
            row, real = _layout(word, count, of[w], first[w])
            used, inv = np.unique(place[row], return_inverse=True)
            inv = inv.reshape(row.shape)
            sizes = n_gram[used]
            at = np.repeat(begin[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            chars = gram[at]
            vec = np.concatenate([net.p["word"][idx[used]], np.add.reduceat(net.p["char"][chars], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]], axis=1)
            g, dx = net.gradient(vec[inv], real, y[doc[w]], TRUST if step >= PLAIN_STEPS else 0.0)
            dv = np.zeros_like(vec)
            np.add.at(dv, inv.ravel(), dx.reshape(-1, dx.shape[2]))
            g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
            np.add.at(g["word"], idx[used], dv[:, :WORD_DIM])
            np.add.at(g["char"], chars, np.repeat(dv[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
            step += 1
            for k, v in g.items():
                m, s = state[k]
                m += 0.1 * (v - m)
                s += 0.01 * (v * v - s)
                net.p[k] *= 1 - DECAY
                net.p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    # The sample's classes are not as frequent as the labelled rows'; the caller may shift the scores.
    return net


def classify(docs: DataFrame, net: Network | float) -> DataFrame:
    """(doc_id, score, predicted), a row for each row of docs."""
    spark = docs.sparkSession
    on_workers(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2_000_000):
            m = shared.value
            got = np.full(b.num_rows, m) if isinstance(m, float) else score(m, *flat(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got.astype(np.float64))], ["doc_id", "score"])

    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = held.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
