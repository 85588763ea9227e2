"""Byte-level BPE: a priority queue of merge ranks over a linked list of symbols, and back.

Null texts are encoded as empty ones: no ids, empty text. Texts are encoded whole, of any length.
Repeated rows give equal rows. Every column is kept by `encode`, whose own two columns replace
columns of the same names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import on_workers, slices

#: Words kept in each of a worker's two generations of encoded words.
KEPT = 300_000

# The split pattern of byte-level BPE files, and the same for texts of Latin-1 letters only.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN_L, LATIN_N, LATIN_S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_L}]+| ?[{LATIN_N}]+| ?[^{LATIN_S}{LATIN_L}{LATIN_N}]+|[{LATIN_S}]+(?![^{LATIN_S}])|[{LATIN_S}]+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable Latin-1, else from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, file: bytes) -> None:
        spec = json.loads(file)
        model, letters = spec["model"], byte_letters()
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.text |= {i: s.encode() for s, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        stand_in = {b: c for c, b in letters.items()}
        self.byte_id = [vocab[stand_in[b]] for b in range(256)]
        self.step = 1 + max(vocab.values())
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: left * step + right -> (rank, merged id)
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.merges.setdefault(vocab[a] * self.step + vocab[b], (rank, vocab[a + b]))
        self.any, self.latin = regex.compile(SPLIT), re.compile(LATIN)
        self.words = Words(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: lowest rank first, leftmost among equals; entries made stale by a merge are skipped."""
        ids = [self.byte_id[b] for b in word]
        n, merges, step = len(ids), self.merges, self.step
        if n < 2:
            return ids
        queue = [(m[0], i) for i in range(n - 1) if (m := merges.get(ids[i] * step + ids[i + 1]))]
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            rank, i = heappop(queue)
            j = after[i]
            if j >= n or ids[i] < 0:
                continue
            m = merges.get(ids[i] * step + ids[j])
            if m is None or m[0] != rank:
                continue
            ids[i], ids[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := merges.get(ids[i] * step + ids[k]):
                    heappush(queue, (m[0], i))
            p = before[i]
            if p >= 0 and (m := merges.get(ids[p] * step + ids[i])):
                heappush(queue, (m[0], p))
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.at_special.split(text) if self.at_special else [text]
        out = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                try:
                    part.encode("latin-1")
                    words = self.latin.findall(part)
                except UnicodeEncodeError:
                    words = self.any.findall(part)
                out.append(b"".join(map(self.words.__getitem__, words)))
        self.words.age()
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class Words(dict):
    """Encoded words of a worker in two generations, so that their number stays bounded."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.codec.merge(word.encode()), "<u4").tobytes()
        if len(word) < 100:
            self[word] = ids
        return ids

    def age(self) -> None:
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()


_codecs: dict[int, Codec] = {}


def codec(file: bytes) -> Codec:
    """This worker's codec of a file; words it has encoded are remembered over tasks."""
    key = hash(file)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(file)
    return _codecs[key]


def encode(docs: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with `ids` (packed little-endian unsigned 32-bit) and `decoded` (the text that they give).

    tokenizer: path of a byte-level BPE file; it is read here and sent to the workers (its size is fixed).
    """
    spark = docs.sparkSession
    on_workers(spark)
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    held = docs.drop(ids, decoded) if text not in (ids, decoded) else docs
    out = T.StructType([*held.schema.fields, T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in slices(batches, text):
            packed = [c.encode(t) if t else b"" for t in b.column(text).to_pylist()]
            back = [c.decode(x) for x in packed]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(packed, pa.binary()), pa.array(back, pa.string())], out.names)

    return held.mapInArrow(run, out)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what `encode` gives."""
    return encoded.select(F.col("doc_id").cast("long"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
