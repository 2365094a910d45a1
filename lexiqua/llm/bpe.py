"""Byte-level BPE with a segment tree over byte positions.

The leaf of a live byte position holds the rank of the pair that starts there, an inner node the
leftmost minimum below it.  A merge takes the root's pair, drops one leaf and updates the leaves of
the merged token and of its live left neighbour, each in a logarithmic number of steps.  Pieces of
up to ``SHORT`` bytes are merged many at a time, one numpy row per piece; longer ones alone.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

SHORT = 64
#: Pieces per numpy block, and pieces that a task remembers before it starts anew.
BLOCK = 16_384
REMEMBERED = 300_000
NONE = np.int64(1) << 60

COLUMNS = T.StructType(
    [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
)


class Merger:
    """Merges of one vocabulary: ``ranks`` maps the bytes of a token to its id, which is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (ranks[t[:i]], ranks[t[i:]]): rank
            for t, rank in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        }
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.pair_ranks = np.r_[np.fromiter(self.pairs.values(), np.int64, len(keys))[order], NONE]
        ids = self.byte_ids
        self.byte_pairs = self.pair_rank(np.repeat(ids, 256), np.tile(ids, 256)).reshape(256, 256)
        self.cache: dict[str, bytes] = {}

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that joins ``left`` and ``right``, ``NONE`` without one."""
        wanted = left << 32 | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.pair_ranks[at], NONE)

    def merge_long(self, piece: bytes) -> bytes:
        """Ids of one piece, merged with a segment tree in plain lists."""
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        none = (1 << 60, 0)
        ids = [int(self.byte_ids[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        pairs = self.pairs

        def leaf(i: int) -> tuple[int, int]:
            j = after[i]
            rank = pairs.get((ids[i], ids[j])) if j < n else None
            return none if rank is None else (rank, i)

        for i in range(n):
            tree[size + i] = leaf(i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(i: int, value: tuple[int, int]) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        while tree[1] is not none and tree[1] != none:
            rank, i = tree[1]
            gone = after[i]
            ids[i] = rank
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            ids[gone] = -1
            update(gone, none)
            update(i, leaf(i))
            if before[i] >= 0:
                update(before[i], leaf(before[i]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merge_block(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of 2 to ``width`` bytes (a power of two), all trees side by side."""
        n, rows = len(pieces), np.arange(len(pieces))
        length = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        live = np.arange(width) < length[:, None]
        # column ``width`` stands for "no neighbour"
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width] = np.where(live, self.byte_ids[data], -1)
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        after[rows, length - 1] = width
        after[:, width] = width
        before = np.broadcast_to(np.r_[width, np.arange(width)], (n, width + 1)).copy()
        before[:, width] = width
        tree = np.full((n, 2 * width), NONE, np.int64)
        ranks = self.byte_pairs[data[:, :-1], data[:, 1:]]
        tree[:, width:-1] = np.where(live[:, 1:] & (ranks < NONE), ranks * width + np.arange(width - 1), NONE)
        level = width
        while level > 1:
            level >>= 1
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        ids_, after_, before_, tree_ = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        steps = width.bit_length() - 1
        open_ = np.flatnonzero(tree[:, 1] < NONE)
        while open_.size:
            rank, at = np.divmod(tree[open_, 1], width)
            row, trow = open_ * (width + 1), open_ * (2 * width)
            gone = after_[row + at]
            beyond = after_[row + gone]
            ids_[row + at] = rank
            ids_[row + gone] = -1
            after_[row + at] = beyond
            before_[row + beyond] = at  # column ``width`` takes what no one reads
            left = before_[row + at]
            before_[row + width] = width
            with_right = self.pair_rank(rank, np.where(beyond < width, ids_[row + beyond], NONE >> 32))
            tree_[trow + width + gone] = NONE
            tree_[trow + width + at] = np.where(with_right < NONE, with_right * width + at, NONE)
            has = left < width
            with_left = self.pair_rank(np.where(has, ids_[row + left], NONE >> 32), rank)
            tree_[(trow + width + left)[has]] = np.where(with_left < NONE, with_left * width + left, NONE)[has]
            node = np.concatenate([width + gone, width + at, (width + left)[has]])
            base = np.concatenate([trow, trow, trow[has]])
            for _ in range(steps):
                node >>= 1
                tree_[base + node] = np.minimum(tree_[base + 2 * node], tree_[base + 2 * node + 1])
            open_ = open_[tree[open_, 1] < NONE]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def merge(self, pieces: list[str]) -> None:
        """Add pieces to the cache."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            data = piece.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            if whole is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(data) > SHORT:
                self.cache[piece] = self.merge_long(data)
            else:
                classes.setdefault(1 << (len(data) - 1).bit_length(), []).append((piece, data))
        for width, found in classes.items():
            for i in range(0, len(found), BLOCK):
                part = found[i : i + BLOCK]
                self.cache.update(zip([p for p, _ in part], self.merge_block([d for _, d in part], width)))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        if len(self.cache) > REMEMBERED:
            self.cache.clear()
        self.merge([p for p in set().union(*split) if p not in self.cache])
        of = self.cache.__getitem__
        return [b"".join(map(of, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def merger(vocabulary: bytes, pattern: str) -> Merger:
    """One merger per worker process; ``vocabulary`` is the content of the rank file."""
    return Merger({base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every row's text.

    ``vocabulary`` is the path of a rank file on the driver (a fixed, small file, sent to the
    executors).  A null text is empty and has no ids; special tokens are ordinary text.
    """
    return _mapped(docs, vocabulary, pattern, doc_id, text, T.StructType([T.StructField("ids", T.ArrayType(T.LongType(), False), False)]), _ids)


def digests(docs: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, one row per row."""
    return _mapped(docs, vocabulary, pattern, doc_id, text, COLUMNS, _digests)


def decode(df: DataFrame, vocabulary: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, data): the bytes of id arrays (null: none)."""
    sent = df.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def run(batches):
        for batch in batches:
            made = merger(sent.value, pattern)
            data = [b"".join(made.tokens[i] for i in row or ()) for row in batch.column(1).to_pylist()]
            yield _batch(batch.column(0), data)

    return df.select(doc_id, ids).mapInArrow(run, T.StructType([df.schema[doc_id], T.StructField("data", T.BinaryType(), False)]))


def _batch(ids, data):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([ids, pa.array(data, pa.binary())], names=["doc_id", "data"])


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _ids(made: Merger, texts: list[str]) -> dict:
    return {"ids": [np.frombuffer(x, "<u4").astype(np.int64) for x in made.encode_all(texts)]}


def _digests(made: Merger, texts: list[str]) -> dict:
    ids = made.encode_all(texts)
    return {
        "n_tokens": [len(x) // 4 for x in ids],
        "ids_sha256": [sha256(x).hexdigest() for x in ids],
        "decoded_sha256": [sha256(made.decode(x)).hexdigest() for x in ids],
    }


def _mapped(docs, vocabulary, pattern, doc_id, text, schema, columns) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(_read(vocabulary))

    def make():
        made = merger(sent.value, pattern)
        return lambda texts: columns(made, texts)

    return map_texts(docs, [doc_id], text, schema, make)
