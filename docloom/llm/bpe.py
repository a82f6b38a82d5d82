"""Byte-level BPE: encoding with a priority queue of merge ranks, decoding from vocabulary strings.

A piece of text becomes a doubly linked list of byte symbols. All neighbouring pairs that can merge
stand in a heap by rank, then by position; the best is taken, checked against the list (it is stale
if either symbol has changed since) and merged, and the pairs with its new neighbours go in. Pieces
recur, so each worker keeps the ids of a bounded number of them.

Texts never leave their row's task: no shuffle, memory bounded by a slice of texts and the cache.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.wordhash import held, text_slices

#: Pieces and their parts whose ids a worker remembers at most.
CACHE_PIECES, CACHE_PARTS = 1 << 18, 1 << 19
_ID_BITS, _AT_BITS = 20, 40
_AT_MASK = (1 << _AT_BITS) - 1
# fixed values: the white space of the split pattern, as Unicode's White_Space property has it
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed value: the split pattern of the vocabulary
_PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same cuts as far as ASCII white space makes them; what it leaves whole is cut by _PIECE.
_COARSE = regex.compile(rb" ?[^ \t-\r]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+")
_OTHER_SPACE = regex.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next free from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)]


class ByteBpe:
    """A vocabulary file of a byte-level BPE model, as text."""

    def __init__(self, content: str):
        spec = json.loads(content)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[left] << _ID_BITS | vocab[right], rank)
        self.made = [vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in spec["model"]["merges"]]
        back = {s: b for b, s in enumerate(symbols)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k.encode(): np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.strings = [b""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, number in vocab.items():
            self.strings[number] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        for token, number in special.items():
            self.strings[number] = token.encode()
        self.cut = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + b")") if special else None
        self.cache, self.parts = _Pieces(self), _Parts(self)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.first[b] for b in piece]
        n, rank_of = len(ids), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # an entry is rank and place in one number; it is stale if the pair there has another rank by now
        heap = [rank << _AT_BITS | i for i in range(n - 1) if (rank := rank_of(ids[i] << _ID_BITS | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i, rank = entry & _AT_MASK, entry >> _AT_BITS
            j = after[i]
            if j >= n or ids[i] < 0 or rank_of(ids[i] << _ID_BITS | ids[j]) != rank:
                continue
            ids[i], ids[j] = made, _ = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(made << _ID_BITS | ids[k])) is not None:
                    heappush(heap, rank << _AT_BITS | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(ids[h] << _ID_BITS | made)) is not None:
                heappush(heap, rank << _AT_BITS | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole UTF-8 text, as little-endian 32-bit numbers."""
        if self.cut and self.cut.search(text):
            return b"".join(self.special.get(part) or self._plain(part) for part in self.cut.split(text))
        return self._plain(text)

    def _plain(self, text: bytes) -> bytes:
        if _OTHER_SPACE.search(text):
            pieces = [p.encode() for p in _PIECE.findall(text.decode())]
        else:
            pieces = _COARSE.findall(text)
        return b"".join(map(self.cache.__getitem__, pieces))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace").encode()


class Bounded(dict):
    """A cache of two generations: when the young one is full it becomes the old one, and what is
    asked for again moves back, so that common keys stay and memory is bounded."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
            if len(key) > 256:
                return found
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class _Pieces(Bounded):
    def __init__(self, model: ByteBpe):
        super().__init__(CACHE_PIECES // 2)
        self.model = model

    def make(self, piece: bytes) -> bytes:
        text = piece.decode()
        parts = [text] if text.lstrip(" ").isalpha() and text.rfind(" ") < 1 else _PIECE.findall(text)
        return b"".join(map(self.model.parts.__getitem__, parts))


class _Parts(Bounded):
    def __init__(self, model: ByteBpe):
        super().__init__(CACHE_PARTS // 2)
        self.model = model

    def make(self, part: str) -> bytes:
        return array("I", self.model.merge(part.encode())).tobytes()


def _model(content) -> ByteBpe:
    return held(("byte-bpe", hash(content.value)), lambda: ByteBpe(content.value))


def _shipped(docs: DataFrame, path: str):
    """The vocabulary file, of a fixed size, read once on the driver."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as the vocabulary at path has them.

    A null or empty text has no ids. Strings of special tokens in a text are those tokens. Ids of
    rows may repeat or be null; other columns play no part. An empty table gives an empty result.
    """
    content = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content)
        for batch in batches:
            for row, offsets, data in text_slices(batch.column(1)):
                whole, at = data.tobytes(), offsets.tolist()
                found = [model.encode(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(found)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded and decoded again in one
    pass, of which only digests leave the worker: of the ids in decimal, joined by commas, and of the
    decoded text in UTF-8. Nulls, empty texts and empty tables as in encode."""
    content = _shipped(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            for row, offsets, data in text_slices(batch.column(1)):
                whole, at, n, ids, texts = data.tobytes(), offsets.tolist(), [], [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    found = np.frombuffer(model.encode(whole[a:b]), "<u4").tolist()
                    n.append(len(found))
                    ids.append(digest(",".join(map(str, found)).encode()))
                    texts.append(digest(model.decode(found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(n)), pa.array(n, pa.int64()), pa.array(ids), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """rows with the text of their ids; a null list gives an empty text, bytes that are no UTF-8 become U+FFFD."""
    content = _shipped(rows, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(content)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = pa.array([model.decode(x.as_py() if x.is_valid and x.values.null_count else x.values.to_numpy().tolist()) if x.is_valid else b"" for x in column], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], names=[*batch.schema.names, to])

    fields = T.StructType([*rows.schema.fields, T.StructField(to, T.StringType())])
    return rows.mapInArrow(run, fields)
