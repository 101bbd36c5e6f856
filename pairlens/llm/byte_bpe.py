"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf of the tree stands for a live token's start byte and holds the rank of
the pair it forms with its right neighbour; each inner node holds the leftmost
minimum below it.  A merge reads the root, drops one leaf and renews two, each a
logarithmic point update.  Short pieces, which are nearly all of a text, go
through the same tree many at a time, one numpy row a piece; long ones go
through it one by one.  A piece therefore costs O(n log n), however long.

Defined results: a null text is empty and gives no ids; ids outside the
vocabulary make ``decode`` raise; null ids decode to null.  Rows are
independent, so ties, repeated rows, other columns and empty tables need no care.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pairlens.llm.common import by_value, give_back, text_bytes, worker_cache

by_value(__name__)

#: Pieces kept in a worker's memory; beyond that it starts anew. Affects time only.
CACHED_PIECES = 200_000
#: Characters of text encoded at once; one longer text is still encoded whole.
BATCH_CHARS = 1_000_000
#: Widest piece, in bytes, that goes through the batched tree.
WIDE = 128
NONE = np.int64(2**62)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: bytes per id, and the rank of each pair of ids that has one."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.tokens = {b: a for a, b in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.span = max(self.tokens) + 1
        pairs = {
            left * self.span + right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        }
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.key_ranks = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.cache: dict[str, bytes] = {}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair has none."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        key = left * self.span + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece by its own segment tree."""
        n = len(piece)
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        width, none, get, span = 1 << max(0, (n - 1).bit_length()), int(NONE), self.pairs.get, self.span
        tree = [none] * (2 * width)  # a node: rank * width + position, so the minimum is the leftmost of the lowest rank
        for i in range(n - 1):
            rank = get(ids[i] * span + ids[i + 1])
            if rank is not None:
                tree[width + i] = rank * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] != none:
            rank, i = divmod(tree[1], width)
            gone = after[i]
            ids[i], after[i] = rank, after[gone]
            if after[gone] < n:
                before[after[gone]] = i
            ids[gone] = -1
            for at in (gone, i, before[i]):
                if at < 0:
                    continue
                rank = get(ids[at] * span + ids[after[at]]) if at != gone and after[at] < n else None
                node = width + at
                tree[node] = none if rank is None else rank * width + at
                while node > 1:
                    node >>= 1
                    tree[node] = min(tree[2 * node], tree[2 * node + 1])
        return [x for x in ids if x >= 0]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Little-endian ids of pieces of at most ``width`` bytes, a row of trees at once."""
        count = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, count)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(count, width)
        ids = self.byte_ids[raw]
        places = np.arange(width)
        after = np.minimum(places + 1, lengths[:, None])
        before = np.broadcast_to(places - 1, (count, width)).copy()
        tree = np.full((count, 2 * width), NONE)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, width - 1)
        ranks[(places[:-1] + 1) >= lengths[:, None]] = NONE
        tree[:, width : 2 * width - 1] = np.where(ranks < NONE, ranks * width + places[:-1], NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        ids[places >= lengths[:, None]] = -1
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            root = tree[live, 1]
            rank, i = root // width, root % width
            gone = after[live, i]
            behind = after[live, gone]
            ids[live, i], ids[live, gone], after[live, i] = rank, -1, behind
            inside = behind < lengths[live]
            before[live[inside], behind[inside]] = i[inside]
            left = before[live, i]
            right_ids = ids[live, np.minimum(behind, width - 1)]
            fresh = np.where(inside, self.pair_ranks(rank, right_ids), NONE)
            self._put(tree, width, live, gone, np.full(len(live), NONE))
            self._put(tree, width, live, i, fresh)
            has = left >= 0
            rows, at = live[has], left[has]
            self._put(tree, width, rows, at, self.pair_ranks(ids[rows, at], rank[has]))
            live = live[tree[live, 1] < NONE]
        kept = ids >= 0
        sizes = kept.sum(1)
        flat = ids[kept].astype("<u4").tobytes()
        ends = (np.cumsum(sizes) * 4).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _put(tree: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray, ranks: np.ndarray) -> None:
        """A point update in each row: set a leaf, renew its ancestors."""
        node = width + at
        tree[rows, node] = np.where(ranks < NONE, ranks * width + at, NONE)
        while width > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width >>= 1

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces into the cache."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (rank := self.ranks.get(raw)) is not None:
                self.cache[piece] = rank.to_bytes(4, "little")
            elif len(raw) > WIDE:
                self.cache[piece] = np.array(self.merge_one(raw), "<u4").tobytes()
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, items in by_width.items():
            for start in range(0, len(items), step := max(1, 400_000 // width)):
                part = items[start : start + step]
                self.cache.update(zip((x for x, _ in part), self.merge_many([x for _, x in part], width)))

    def encode_batch(self, texts: Iterable[bytes]) -> list[bytes]:
        found, size, out = [], 0, []
        for raw in texts:
            text = raw.decode("utf-8", "replace")
            found.append(self.find(text))
            size += len(text)
            if size >= BATCH_CHARS:
                out += self._flush(found)
                found, size = [], 0
        return out + self._flush(found)

    def _flush(self, found: list[list[str]]) -> list[bytes]:
        if len(self.cache) > CACHED_PIECES:
            self.cache.clear()
        self.learn(set(chain.from_iterable(found)).difference(self.cache))
        return [b"".join(map(self.cache.__getitem__, x)) for x in found]


def vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    return worker_cache(f"bpe:{hash((lines, pattern))}", lambda: Vocabulary(lines, pattern))


def encode(text: Column, vocabulary_path: str, pattern: str) -> Column:
    """Ids of whole texts as binary, little-endian unsigned 32-bit; ``ids_array`` makes an array of them.

    ``vocabulary_path`` is read on the driver and travels with the function (it
    is a file of fixed size), so executors need no copy of it.
    """
    with open(vocabulary_path, "rb") as file:
        lines = file.read()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary(lines, pattern)
        for batch in batches:
            yield pd.Series(words.encode_batch(batch), dtype=object)

    return run(text_bytes(text))


def decode_ids(ids: bytes, words: Vocabulary) -> bytes:
    return b"".join(map(words.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(ids: Column, vocabulary_path: str, pattern: str) -> Column:
    """Bytes of packed ids, as binary."""
    with open(vocabulary_path, "rb") as file:
        lines = file.read()

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = vocabulary(lines, pattern)
        for batch in batches:
            yield pd.Series([None if x is None else decode_ids(x, words) for x in batch], dtype=object)

    return run(ids)


def encode_and_decode(text: Column, vocabulary_path: str, pattern: str) -> Column:
    """A struct of packed ids and the bytes decoded from them, in one visit to Python."""
    with open(vocabulary_path, "rb") as file:
        lines = file.read()

    @F.pandas_udf("ids binary, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(lines, pattern)
        for batch in batches:
            ids = words.encode_batch(batch)
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([decode_ids(x, words) for x in ids], dtype=object)})
        give_back()

    return run(text_bytes(text))


def ids_array(ids: Column) -> Column:
    """Packed ids as array<bigint>, without Python: eight hex digits an id, lowest byte first."""
    turned = lambda x: F.concat(*(F.substring(x, k, 2) for k in (7, 5, 3, 1)))
    return F.transform(F.regexp_extract_all(F.hex(ids), F.lit(".{8}"), F.lit(0)), lambda x: F.conv(turned(x), 16, 10).cast("bigint"))


def id_count(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
