"""Benchmark decontamination: pieces, random-walk (CGK) embedding, bit-sampling LSH, exact edit verification.

An item is in a document if some stretch of the document is within (1 - SIMILAR) of the item's length
in edits. Texts are compared with A-Z lower-cased and white space as single blanks of the same number.

No such stretch is missed. An item is cut into disjoint pieces, some more than the edits that it may have. An edit harms one
piece at most, so so many pieces stand unharmed in the stretch, and as the edits move what follows by no more than their
number, on diagonals that lie no further apart. Where an item has so many hits so near each other is a place; all others are
ruled out. How an item is cut follows a sample of the documents, so that its pieces are rare: this bears on the cost only.

At a place, window and item are embedded by the same random walks, which turn edits into differing places; LSH compares
sampled places. What collides in any of the tables is verified first, as it is most often a match. The other places are
then verified too, but for those whose hits tell that they cannot be better than what is known of the document and item
(`clean`: those of documents that hold an item already). To verify is to count the edits themselves.

The items are broadcast in blocks of bounded size: a large benchmark takes several passes over the
documents instead of a larger broadcast. Null and empty items match nothing; items under 5 bytes, which no edit leaves alike,
are sought as they are. Null and empty texts match only nothing. Repeated rows are treated alike; of several
texts with one item id the one most similar to a stretch of the document counts. Documents are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, on_workers, slices

SIMILAR = 0.8
#: Bytes of a piece; and of a part of a long item, which is sought by its own pieces.
LEAST_PIECE, MOST_PIECE, PART = 2, 8, 512
#: Documents from which the rarity of pieces is known, and how much of each.
SAMPLE, SAMPLED = 300, 10_000
#: What a place costs, in hits: cuts are chosen by it.
DEAR = 200_000
#: Bytes in which hits are looked for at a time.
STEP = 1 << 18
#: Random walks, tables of each, places that a table samples.
WALKS, TABLES, PLACES = 5, 128, 4
#: Bytes of items in a broadcast block, about.
BLOCK = 2_000_000
#: Bytes of strings that are embedded at a time, about.
LAID_OUT = 1 << 25
SEED = 17

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 0x20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def most_edits(size: int) -> int:
    """The edits that an item of this size may have."""
    return int((1 - SIMILAR) * size + 1e-9)


def words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, zeros past the end."""
    buf = np.concatenate([x, np.zeros(16, np.uint8)]).tobytes()
    v = np.empty(len(x) + -len(x) % 8, np.uint64)
    for k in range(8):
        part = v[k::8]
        part[:] = np.frombuffer(buf, "<u8", count=len(part), offset=k)
    return v[: len(x)]


def first_bytes(word: np.ndarray, n: int) -> np.ndarray:
    return word & np.uint64((1 << 8 * n) - 1)


class Rarity:
    """How often strings of LEAST_PIECE to MOST_PIECE bytes are in a sample."""

    def __init__(self, x: np.ndarray) -> None:
        word = words(x)
        self.total = max(1, len(x))
        self.counts = {n: np.unique(first_bytes(word, n), return_counts=True) for n in range(LEAST_PIECE, MOST_PIECE + 1)}

    def shares(self, x: np.ndarray) -> np.ndarray:
        """At [n, i] the share of places at which the n bytes of x from i on begin; infinite past the end."""
        word, out = words(x), np.full((MOST_PIECE + 1, len(x)), np.inf)
        for n, (known, times) in self.counts.items():
            c = first_bytes(word[: max(0, len(x) - n + 1)], n)
            at = np.minimum(np.searchsorted(known, c), max(0, len(known) - 1))
            found = known[at] == c if len(known) else np.zeros(len(c), bool)
            out[n, : len(c)] = (np.where(found, times[at] if len(known) else 0, 0) + 0.5) / self.total
        return out


def cut_up(x: np.ndarray, edits: int, rarity: Rarity) -> list[tuple[int, int]]:
    """(place, bytes) of disjoint pieces of x, more than `edits`: rare ones, and so many that few places have enough of them by chance."""
    share, most = rarity.shares(x), min(len(x) // LEAST_PIECE, edits + 1 + len(x) // 12)
    best, how = np.full((len(x) + 1, most + 1), np.inf), np.zeros((len(x) + 1, most + 1), np.int8)
    best[0, 0] = 0
    for end in range(1, len(x) + 1):
        best[end], how[end] = best[end - 1], 1  # the byte is in no piece
        for n in range(LEAST_PIECE, min(MOST_PIECE, end) + 1):
            with_piece = best[end - n, :-1] + share[n, end - n]
            less = np.flatnonzero(with_piece < best[end, 1:])
            best[end, less + 1], how[end, less + 1] = with_piece[less], n
    spare = np.arange(1, most - edits + 1)
    hits = best[len(x), edits + 1 :]
    near = np.minimum(hits * (edits + 1) * 1.5, spare)
    chance = np.exp(spare * np.log(np.maximum(near, 1e-300)) - near - np.cumsum(np.log(spare)))
    pieces = edits + 1 + int(np.argmin(hits * (1 + DEAR * np.minimum(chance, 1))))
    out, end = [], len(x)
    while pieces:
        n = int(how[end, pieces])
        end -= n
        if n > 1:
            out.append((end, n))
            pieces -= 1
    return out[::-1]


def embed(buf: np.ndarray, start: np.ndarray, size: np.ndarray, steps: int, walk: int) -> np.ndarray:
    """CGK: at each step a string's current byte is written; a bit drawn for the step and byte says whether to go on.

    Past its end a string reads as zeros, on which no walk goes on.
    """
    go = np.random.default_rng([SEED, walk]).integers(0, 2, (steps, 256), dtype=np.int32)
    go[:, 0] = 0
    width = int(size.max(initial=0)) + 1
    column = np.arange(width)
    rows = buf[np.minimum(start[:, None] + column, max(0, len(buf) - 1))]
    rows[column >= size[:, None]] = 0
    rows = rows.ravel()
    at = np.arange(len(start), dtype=np.int32) * np.int32(width)
    out = np.empty((steps, len(start)), np.uint8)
    for j in range(steps):
        np.take(rows, at, out=out[j], mode="clip")
        at += go[j].take(out[j])
    return out


def alike(size: np.ndarray) -> Iterator[np.ndarray]:
    """The places of strings of these sizes, those of like size together, so many that LAID_OUT bytes hold them at
    the size of the longest; one longer string is alone."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        widths = size[order[at:]].astype(np.int64) + 1
        most = int(np.searchsorted(widths * np.arange(1, len(widths) + 1), LAID_OUT, side="right"))
        # Beyond twice the shortest's size most steps would be of ended strings.
        some = max(1, min(most, int(np.searchsorted(widths, 2 * widths[0] + 64, side="right"))))
        yield order[at : at + some]
        at += some


def edits(pattern: bytes, text: bytes) -> tuple[int, int]:
    """The fewest edits that turn some stretch of text into pattern, and where that stretch ends (bit-parallel, of any length)."""
    m = len(pattern)
    at: dict[int, int] = {}
    for i, c in enumerate(pattern):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


#: Regions of like size that are verified together, at least and at most, and 64-bit words of the items that are.
TOGETHER, AT_ONCE, MOST_WORDS = 256, 4096, 16


def edits_of_many(patterns: list[bytes], of: np.ndarray, texts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As edits(), of patterns[of[i]] in the first size[i] bytes of column i of texts, for all i at once, in words of 64 bits."""
    many = np.array([len(p) for p in patterns], np.int64)[of]
    n = -(-int(many.max()) // 64)
    table = np.zeros((n, len(patterns), 256), np.uint64)
    for k, p in enumerate(patterns):
        at = np.arange(len(p))
        np.bitwise_or.at(table, (at // 64, k, np.frombuffer(p, np.uint8)), np.uint64(1) << (at % 64).astype(np.uint64))
    table = table.reshape(n, -1)
    one, top, ends_in = np.uint64(1), np.uint64(63), (many - 1) // 64
    ending = [(np.flatnonzero(ends_in == k), ((many[ends_in == k] - 1) % 64).astype(np.uint64)) for k in range(n)]
    pv, mv = [np.full(len(of), ~np.uint64(0)) for _ in range(n)], [np.zeros(len(of), np.uint64) for _ in range(n)]
    score, best, end, row = many.copy(), many.copy(), np.zeros(len(of), np.int64), of * 256
    for j in range(len(texts)):
        at, plus = row + texts[j], None
        for k in range(n):
            eq = table[k].take(at)
            xv = eq | mv[k]
            if plus is not None:
                eq |= minus
            xh = ((eq & pv[k]) + pv[k] ^ pv[k]) | eq
            ph, mh = mv[k] | ~(xh | pv[k]), pv[k] & xh
            some, bit = ending[k]
            if len(some):
                score[some] += (ph[some] >> bit & one).astype(np.int64) - (mh[some] >> bit & one).astype(np.int64)
            up, down = ph >> top, mh >> top
            ph <<= one
            mh <<= one
            if plus is not None:
                ph |= plus
                mh |= minus
            pv[k], mv[k], plus, minus = mh | ~(xv | ph), ph & xv, up, down
        less = (score < best) & (j < size)
        best[less], end[less] = score[less], j + 1
    return best, end


class Index:
    """The pieces and embedded samples of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], sample: list[str]) -> None:
        folded = [_FOLD[np.frombuffer(t.encode(), np.uint8)] for t in texts]
        self.short = [(i, x.tobytes()) for i, x in zip(ids, folded) if not most_edits(len(x))]
        long = [(i, x) for i, x in zip(ids, folded) if most_edits(len(x))]
        self.ids = np.array([i for i, _ in long], np.int64)
        self.size = np.array([len(x) for _, x in long], np.int64)
        self.text = np.concatenate([x for _, x in long]) if long else np.zeros(0, np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.most = np.array([most_edits(len(x)) for _, x in long], np.int64)
        # Parts: of several, one has no more than its share of the edits.
        rarity = Rarity(_FOLD[np.frombuffer("\n".join([*sample, *texts]).encode(), np.uint8)])
        part, rows = [], []
        for i, (_, x) in enumerate(long):
            n = -(-len(x) // PART)
            for begin, after in ((len(x) * k // n, len(x) * (k + 1) // n) for k in range(n)):
                most = int(self.most[i]) // n
                cuts, word = cut_up(x[begin:after], most, rarity), words(x[begin:after])
                rows += [(n_bytes, int(word[at]) & (1 << 8 * n_bytes) - 1, len(part) << 40 | nth, begin + at) for nth, (at, n_bytes) in enumerate(cuts)]
                part.append((i, most, len(cuts)))
        self.part_item, self.part_most, self.part_pieces = (np.array(c, np.int64) for c in (zip(*part) if part else [[]] * 3))
        #: Of each number of bytes: the pieces, where the rows of each begin, these rows' parts (and numbers) and places in the items, and a first look.
        self.pieces = {}
        for n in sorted({r[0] for r in rows}):
            got = sorted(r[1:] for r in rows if r[0] == n)
            known, first = np.unique(np.array([r[0] for r in got], np.uint64), return_index=True)
            bits = max(16, int(np.ceil(np.log2(len(known) + 1))) + 6)
            maybe, shift = np.zeros(1 << bits, bool), np.uint64(64 - bits)
            maybe[known * _MIX >> shift] = True
            self.pieces[n] = (known, np.append(first, len(got)), np.array([r[1] for r in got]), np.array([r[2] for r in got]), maybe, shift)
        u = np.random.default_rng(SEED).random((WALKS, TABLES * PLACES))
        #: Sampled steps of each walk for each item: those of its first 2 * size steps; and the bytes there.
        self.sampled = [(u[w][:, None] * 2 * self.size[None, :]).astype(np.int64) for w in range(WALKS)]
        self.keys = [np.empty(x.shape, np.uint8) for x in self.sampled]
        for some in alike(self.size):
            for w in range(WALKS):
                walked = embed(self.text, self.start[some], self.size[some], int(2 * self.size[some].max()), w)
                self.keys[w][:, some] = np.take_along_axis(walked, self.sampled[w][:, some], 0)

        self.names = [*self.ids.tolist(), *[i for i, _ in self.short]]
        self.lengths = [*self.size.tolist(), *[len(t) for _, t in self.short]]

    def hits(self, x: np.ndarray) -> np.ndarray:
        """A number for each place of a piece in x, sorted: its part, 32 bits of where the item would begin, past the longest
        item's size, and 8 bits of the piece's number in its part."""
        got, past = [np.zeros(0, np.int64)], int(self.size.max(initial=0))
        for begin in range(0, len(x), STEP):
            word = words(x[begin : begin + STEP + MOST_PIECE])[:STEP]
            for n, (known, first, piece, place, maybe, shift) in self.pieces.items():
                c = first_bytes(word[: max(0, len(x) - begin - n + 1)], n)
                at = np.flatnonzero(maybe[c * _MIX >> shift])
                c = c[at]
                g = np.minimum(np.searchsorted(known, c), len(known) - 1)
                hit = known[g] == c
                at, g = at[hit], g[hit]
                times = first[g + 1] - first[g]
                row = np.repeat(first[g] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                got.append(piece[row] + (np.repeat(at + begin, times) - place[row] + past << 8))
        return np.sort(np.concatenate(got))

    def regions(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(document, item, begin, end, window, least): the stretches of x in which an item may be, where in each the window
        for the walks begins, and how many edits its hits tell at least."""
        hit, past = self.hits(x), int(self.size.max(initial=0))
        if not len(hit):
            return (np.zeros(0, np.int64),) * 6
        part, needed = hit >> 40, self.part_pieces - self.part_most
        last = np.arange(len(hit)) + needed[part] - 1
        first = np.flatnonzero(last < len(hit))
        first = first[(hit[last[first]] >> 8) - (hit[first] >> 8) <= self.part_most[part[first]]]
        last = last[first]
        # Runs of one part that share hits are one stretch.
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] > last[:-1]) | (part[first[1:]] != part[first[:-1]])
        head = np.flatnonzero(new)
        n = last[np.append(head[1:], len(first))[: len(head)] - 1] - first[head] + 1
        of = np.repeat(np.arange(len(head)), n)
        held = hit[np.repeat(first[head] - (np.cumsum(n) - n), n) + np.arange(len(of))]
        # Enough different pieces must be in some stretch of as many diagonals as edits and one, so in two neighbouring bins of these.
        place, wide = (held >> 8 & 0xFFFFFFFF) - past, self.part_most[held >> 40] + 1
        at_bin = (place - (hit[first[head]] >> 8 & 0xFFFFFFFF)[of] + past) // wide + 1
        both = np.unique(np.concatenate([(of << 32 | at_bin - k) << 8 | held & 0xFF for k in (0, 1)]))
        bins, different = np.unique(both >> 8, return_counts=True)
        of_bin = bins >> 32
        enough = different >= needed[part[first[head[of_bin]]]]
        bins, different, of_bin = bins[enough], different[enough], of_bin[enough]
        new = np.ones(len(bins), bool)
        new[1:] = bins[1:] - bins[:-1] > 1
        head_bin = np.flatnonzero(new)
        tail_bin = np.append(head_bin[1:], len(bins))[: len(head_bin)] - 1
        of, top = of_bin[head_bin], np.maximum.reduceat(different, head_bin) if len(bins) else different
        part = part[first[head[of]]]
        item, wide, low = self.part_item[part], self.part_most[part] + 1, (hit[first[head[of]]] >> 8 & 0xFFFFFFFF) - past
        low, high = low + ((bins[head_bin] & 0xFFFFFFFF) - 1) * wide, low + ((bins[tail_bin] & 0xFFFFFFFF) + 1) * wide - 1
        least, window = np.maximum(0, self.part_pieces[part] - top), (low + high) // 2
        begin, end = low - self.most[item], high + self.size[item] + self.most[item]
        # A region over the border of documents is one in each.
        begin, end = np.clip(begin, 0, len(x)), np.clip(end, 0, len(x))
        doc = np.searchsorted(starts, begin, side="right") - 1
        n = np.maximum(np.searchsorted(starts, end, side="left") - doc, 1)
        row = np.repeat(np.arange(len(doc)), n)
        doc = doc[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
        begin, end, item = np.maximum(begin[row], starts[doc]), np.minimum(end[row], starts[doc + 1]), item[row]
        keep = end - begin >= self.size[item] - self.most[item]
        return doc[keep], item[keep], begin[keep], end[keep], window[row][keep], least[row][keep]

    def collide(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Which windows agree with their item in all places of some table."""
        out = np.zeros(len(item), bool)
        for some in alike(self.size[item]):
            steps = int(2 * self.size[item[some]].max())
            for w in range(WALKS):
                got = np.take_along_axis(embed(x, begin[some], end[some] - begin[some], steps, w), self.sampled[w][:, item[some]], 0)
                same = (got == self.keys[w][:, item[some]]).reshape(TABLES, PLACES, -1)
                out[some] |= same.all(axis=1).any(axis=0)
        return out

    def item_bytes(self, i: int) -> bytes:
        return self.text[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def verified(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The fewest edits of each item in its region of x, and where in x that stretch ends."""
        edited, ends = np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        n_words = -(-self.size[item] // 64)
        up_to = 1 << np.ceil(np.log2(n_words)).astype(np.int64)
        for w in np.unique(up_to):
            of_words = np.flatnonzero(up_to == w)
            for some in alike((end - begin)[of_words]):
                some = of_words[some]
                for at in range(0, len(some), AT_ONCE):
                    now = some[at : at + AT_ONCE]
                    if len(now) < TOGETHER or w > MOST_WORDS:
                        got = [edits(self.item_bytes(i), x[b:e].tobytes()) for i, b, e in zip(item[now].tolist(), begin[now].tolist(), end[now].tolist())]
                        edited[now], ends[now] = np.array(got, np.int64).reshape(-1, 2).T
                    else:
                        size = end[now] - begin[now]
                        texts = x[np.minimum(begin[now] + np.arange(size.max())[:, None], len(x) - 1)]
                        ones, of = np.unique(item[now], return_inverse=True)
                        edited[now], ends[now] = edits_of_many([self.item_bytes(i) for i in ones], of, texts, size)
        return edited, begin + ends

    def matches(self, data: np.ndarray, starts: np.ndarray, every: bool = True) -> list[tuple[int, int, int, int]]:
        """(document, item, edits, end in the document) of the items in each document, the best place of each, the first of
        equal ones; items are numbered as in names and lengths. Not `every`: of each document that holds an item one or more."""
        x = _FOLD[data]
        doc, item, begin, end, window, least = self.regions(x, starts)
        on = np.zeros(len(doc), bool)
        if len(doc):
            lo, hi = starts[doc], starts[doc + 1]
            on = self.collide(x, np.clip(window, lo, hi), np.clip(window + self.size[item], lo, hi), item)
        best: dict[tuple[int, int], tuple[int, int]] = {}

        def verify(some: np.ndarray) -> None:
            edited, ends = self.verified(x, begin[some], end[some], item[some])
            good = edited <= self.most[item[some]]
            some = some[good]
            for d, i, n, e in zip(doc[some].tolist(), item[some].tolist(), edited[good].tolist(), (ends[good] - starts[doc[some]]).tolist()):
                best[d, i] = min((n, e), best.get((d, i), (n, e)))

        verify(np.flatnonzero(on))
        rest = np.flatnonzero(~on)
        if every:
            known = [best.get(at, (1 << 62,))[0] for at in zip(doc[rest].tolist(), item[rest].tolist())]
            verify(rest[least[rest] <= np.array(known, np.int64)])
        else:
            verify(rest[~np.isin(doc[rest], [d for d, _ in best])])
        out = [(d, i, n, end) for (d, i), (n, end) in best.items()]
        raw = x.tobytes() if self.short else b""
        for i, (_, t) in enumerate(self.short, len(self.ids)):
            at = raw.find(t) if t else -1
            seen = -1
            while at >= 0:
                d = int(np.searchsorted(starts, at, side="right")) - 1
                if at + len(t) <= starts[d + 1] and d != seen:
                    out.append((d, i, 0, at + len(t) - int(starts[d])))
                    seen = d
                at = raw.find(t, at + 1)
        return out


def blocks(benchmark: DataFrame, docs: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of about BLOCK bytes of items."""
    sample = None
    items = benchmark.where("item_id is not null and text is not null and text <> ''").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-size // BLOCK)
    for k in range(n):
        got = sorted(map(tuple, (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).collect()))
        if got:
            if sample is None:
                sample = [r[0] for r in docs.where("text is not null").select(F.substring(F.col("text").cast("string"), 1, SAMPLED)).limit(SAMPLE).collect()]
            yield Index([r[0] for r in got], [r[1] for r in got], sample)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, similarity, end): a row for each item in each document; end in bytes."""
    spark = docs.sparkSession
    on_workers(spark)
    held = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    names, out = ["doc_id", "item_id", "edits", "similarity", "end"], None
    for index in blocks(benchmark, docs):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                m = shared.value
                ids = b.column("doc_id").to_pylist()
                top: dict[tuple[int, int], tuple] = {}
                for d, i, n, end in m.matches(*flat(b.column("text"))):
                    at, row = (d, m.names[i]), (1 - n / m.lengths[i], -n, -end)
                    top[at] = max(row, top.get(at, row))
                rows = [(ids[d], i, -n, similarity, -end) for (d, i), (similarity, n, end) in top.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32()))], names)

        found = held.mapInArrow(run, "doc_id long, item_id long, edits int, similarity double, end int")
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "doc_id long, item_id long, edits int, similarity double, end int") if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item, with the same columns; no shuffle."""
    spark = docs.sparkSession
    on_workers(spark)
    for index in blocks(benchmark, docs):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in shared.value.matches(*flat(b.column("text")), every=False)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
