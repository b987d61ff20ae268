"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes.

The vocabulary is read once on the driver from the path given and broadcast; its size is that of the file
(tens of thousands of entries), never that of the corpus. A worker remembers at most ``MEMO`` pieces, then
starts afresh, so memory is bounded and results do not depend on what it remembers.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from tablecheck.session import ship_by_value

ship_by_value(__name__)

#: Pieces remembered by one worker, and the longest piece worth remembering.
MEMO, MEMO_CHARS = 500_000, 64
#: Bytes of text whose ids a worker holds at once.
SLICE = 1 << 20
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: n keys, n slots, one displacement per bucket.

    A bucket's displacement is tried upwards until all its keys fall on free slots; buckets of one key
    store their slot directly (as a negative number).
    """

    def __init__(self, keys: list[bytes], shift: list[int] | None = None, slots: list[bytes] | None = None):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 2)
        if shift is not None:
            self.shift, self.keys = shift, slots
            return
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for key in keys:
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, key))
        order = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
        singles = 0
        for singles, (bucket, group) in enumerate(order):
            if len(group) == 1:
                break
            d = 1
            while len(taken := {self._slot(h, d) for h, _ in group}) < len(group) or any(self.keys[s] is not None for s in taken):
                d += 1
            self.shift[bucket] = d
            for h, key in group:
                self.keys[self._slot(h, d)] = key
        else:
            singles = len(order)
        free = (s for s in range(n) if self.keys[s] is None)
        for bucket, group in order[singles:]:
            slot = next(free)
            self.shift[bucket], self.keys[slot] = -slot - 1, group[0][1]

    def _slot(self, h: int, d: int) -> int:
        x = ((h ^ (d * 0x9E3779B97F4A7C15)) * 0xD6E8FEB86659FD93) & _MASK
        return (x >> 32) % self.n

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 where it is none of the keys."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return slot if self.keys[slot] == key else -1


class Vocabulary:
    """Ranks of a vocabulary file, looked up whole by perfect hash and pairwise while merging."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, shift: list[int] | None = None, keys: list[bytes] | None = None):
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(list(ranks), shift, keys)
        self.rank_at = [ranks[k] for k in self.hash.keys]

    def parts(self) -> tuple[dict[bytes, int], str, list[int], list[bytes]]:
        """Plain values to broadcast; ``Vocabulary(*parts)`` is the same vocabulary without building it again."""
        return self.ranks, self.pattern, self.hash.shift, self.hash.keys

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        slot = self.hash.find(piece)
        return [self.rank_at[slot]] if slot >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals. An entry packs rank and start; an entry counts while it is its start's latest."""
        rank, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        best = [rank(piece[i : i + 2], -1) for i in range(n - 1)]
        best.append(-1)
        heap = [r * n + i for i, r in enumerate(best) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            start = entry % n
            if best[start] * n + start != entry:
                continue
            middle = after[start]
            after[start] = end = after[middle]
            best[middle] = -1
            if end < n:
                before[end] = start
                best[start] = r = rank(piece[start : after[end]], -1)
                if r >= 0:
                    heappush(heap, r * n + start)
            else:
                best[start] = -1
            left = before[start]
            if left >= 0:
                best[left] = r = rank(piece[left:end], -1)
                if r >= 0:
                    heappush(heap, r * n + left)
        ids, at = [], 0
        while at < n:
            ids.append(self.ranks[piece[at : after[at]]])
            at = after[at]
        return ids


def encoder(vocabulary: Vocabulary, memo_size: int = MEMO) -> Callable[[str], bytes]:
    """A function from text to its ids as packed 32-bit integers.

    A single space between two other characters always begins a pre-token, so such texts are cut there; what
    follows a space is remembered without it, once for a word alone and once for each word with marks, whose pre-tokens
    are sought first. Texts with a space beside other white space are matched as a whole.
    """
    find = regex.compile(vocabulary.pattern).findall
    mixed = regex.compile(r"[\s\x1c-\x1f] | [\s\x1c-\x1f]").search
    spaced: dict[str, bytes] = {}
    others: dict[str, bytes] = {}
    known_after_space = spaced.get

    def keep(held: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(key) <= MEMO_CHARS:
            if len(held) >= memo_size:
                held.clear()
            held[key] = ids
        return ids

    def token_ids(token: str) -> bytes:
        held, key = (spaced, token[1:]) if token[0] == " " and len(token) > 1 else (others, token)
        known = held.get(key)
        return keep(held, key, array("i", vocabulary.encode_piece(token.encode())).tobytes()) if known is None else known

    def after_space(rest: str) -> bytes:
        if rest.isalpha():  # one pre-token
            return token_ids(" " + rest)
        ids = b"".join(map(token_ids, find(" " + rest)))
        return keep(spaced, rest, ids) if rest else ids

    def encode(text: str) -> bytes:
        if mixed(text):
            return b"".join(map(token_ids, find(text)))
        first, *rest = text.split(" ")
        return b"".join([*map(token_ids, find(first)), *[known_after_space(x) or after_space(x) for x in rest]])

    return encode


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``SLICE`` bytes (one longer text is a part), so a worker never holds the ids of a whole batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        after = max(first + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(first, after - first)
        first = after


def id_lists(to_ids: Callable[[str], bytes], texts: pa.Array) -> pa.ListArray:
    """The ids of each text; null and empty texts have none."""
    packed = [to_ids(x or "") for x in texts.to_pylist()]
    ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def by_id(ranks: dict[bytes, int]) -> list[bytes | None]:
    """Pieces in the order of their ids."""
    pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return pieces


def joined_pieces(pieces: pa.Array, lists: pa.ListArray) -> pa.Array:
    """The bytes that each list of ids stands for; null lists stand for none, an unknown id is an error."""
    lists = pc.fill_null(lists, pa.scalar([], lists.type)) if lists.null_count else lists
    flat = pc.take(pieces, lists.flatten())
    if flat.null_count:
        raise ValueError("an id is not in the vocabulary")
    ends = np.cumsum([0, *pc.list_value_length(lists).to_numpy(zero_copy_only=False)], dtype=np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat), pa.scalar(b"", pa.large_binary())).cast(pa.binary())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with the ids of each text, as the rank file at ``path`` and ``pattern`` give them.

    Null and empty texts have no ids (an empty array). All other columns pass through; ``ids`` must be a new
    name. No shuffle: each row is encoded where it is read.
    """
    if ids in df.columns:
        raise ValueError(f"column {ids} exists already")
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path, pattern).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(Vocabulary(*shared.value))
        for whole in batches:
            for batch in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, id_lists(to_ids, batch.column(text))], [*batch.schema.names, ids])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(ids, ArrayType(IntegerType(), False))]))


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for; null ids decode to no bytes, an unknown id is an error."""
    if decoded in df.columns:
        raise ValueError(f"column {decoded} exists already")
    shared = df.sparkSession.sparkContext.broadcast(by_id(Vocabulary.load(path, "").ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, joined_pieces(pieces, batch.column(ids))], [*batch.schema.names, decoded])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(decoded, BinaryType())]))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` in one Python worker, with the ids and the bytes they decode to in place of the text.

    The ids go from one to the other inside the worker, so a core has one worker instead of two.
    """
    others = [c for c in df.columns if c != text]
    if {ids, decoded} & set(others):
        raise ValueError(f"column {ids} or {decoded} exists already")
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.load(path, pattern).parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*shared.value)
        to_ids, pieces = encoder(vocabulary), pa.array(by_id(vocabulary.ranks), pa.large_binary())
        for whole in batches:
            for batch in slices(whole, text):
                lists = id_lists(to_ids, batch.column(text))
                kept = [batch.column(c) for c in others]
                yield pa.RecordBatch.from_arrays([*kept, lists, joined_pieces(pieces, lists)], [*others, ids, decoded])

    made = [StructField(ids, ArrayType(IntegerType(), False)), StructField(decoded, BinaryType())]
    return df.mapInArrow(run, StructType([*[f for f in df.schema.fields if f.name != text], *made]))


def digests(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, number of ids, digest of the ids, digest of what they decode to.

    Null and empty texts have no ids and the digests of nothing; ids of any kind, null ones and repeated rows pass through; texts of any length are
    encoded whole; other columns are ignored, whatever their names.
    """
    texts = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = round_trip(texts, path, pattern)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
