"""SimHash near-duplicates with bit-sliced comparison.

Equal fingerprints are one node. All pairs within ``RADIUS`` bits are found by multi-index keys: the 64 bits are cut
into five parts, and two fingerprints that differ in at most three bits agree in at least two of them, so each
goes to the ten keys made of two parts (about 26 bits). A key shared by more than ``CROWD`` fingerprints is
cut further by the same argument: its three other parts hold at most three differing bits, so of four equal pieces of
them one agrees. Inside a key, fingerprints are stored as bit planes: word b holds bit b of 64 fingerprints.
One query updates 64 distances at a time with carry-save counters, a block is left as soon as all its
distances exceed the radius, and what is within it joins one tree per key, so a crowd of n makes at most n - 1 links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.components import components
from tablecheck.session import cut_lineage, ship_by_value

ship_by_value(__name__)

RADIUS, CROWD = 3, 2048
#: Start bits and widths of the five parts.
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
KEYS = tuple(combinations(range(5), 2))
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """Signed 64-bit SimHash of word shingles, repeats included; a bit is set in over half of the hashes."""
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, n, 1 << 16):  # bounded scratch for very long texts
        stop = min(n, start + (1 << 16))
        hashes = np.array([digest(b" ".join(words[i : i + shingle]), seed) for i in range(start, stop)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, fingerprint (long) per row; a null text has no words, no words give zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([fingerprint(words_of(cell.as_py()), shingle) for cell in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), marks], ["doc_id", "text_hash", "fingerprint"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id bigint, text_hash bigint, fingerprint bigint")


def part(k: int) -> Column:
    start, width = PARTS[k]
    return F.shiftrightunsigned("fingerprint", start).bitwiseAND(F.lit((1 << width) - 1))


def keys() -> Column:
    """The ten keys of a fingerprint: number of the pair of parts above the values of both."""
    made = [
        F.lit(n << 26).cast("long") + F.shiftleft(part(a).cast("long"), 13) + part(b).cast("long") for n, (a, b) in enumerate(KEYS)
    ]
    return F.array(*made)


def finer_keys() -> Column:
    """For a crowded key: the other three parts cut into four pieces, of which pairs within the radius share one."""
    number = F.shiftrightunsigned("key", 26)
    rest = F.lit(None).cast("long")
    for n, pair in reversed(list(enumerate(KEYS))):
        value = F.lit(0).cast("long")
        for k in (k for k in range(5) if k not in pair):
            value = F.shiftleft(value, PARTS[k][1]) + part(k).cast("long")
        rest = F.when(number == n, value).otherwise(rest)
    # at most 39 bits: pieces of 10, the last one shorter
    piece = lambda j: F.shiftrightunsigned(rest, 10 * j).bitwiseAND(F.lit(1023)) + (1024 * j)
    return F.array(*[F.shiftleft(F.col("key"), 13) + piece(j) for j in range(4)])


def transpose(block: np.ndarray) -> np.ndarray:
    """Bit planes of up to 64 fingerprints per row: (rows, 64) values to (64, rows) words, lane i in bit i."""
    rows = block.shape[0]
    bits = np.unpackbits(block.view(np.uint8).reshape(rows, 64, 8), axis=2, bitorder="little")  # row, lane, plane
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view("<u8").reshape(64, rows)


def near(planes: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Per column of ``planes`` (64 words each, one query per column): word with a bit for every lane within the radius.

    ``radius`` + 1 is a power of two: a distance exceeds it when the counter of that many bits overflows.
    """
    digits = (radius + 1).bit_length() - 1
    if radius + 1 != 1 << digits:
        raise ValueError("radius + 1 must be a power of two")
    live = np.arange(planes.shape[1])
    over = np.zeros(len(live), np.uint64)
    counter = [np.zeros(len(live), np.uint64) for _ in range(digits)]
    result = np.zeros(len(live), np.uint64)
    for plane in range(64):
        carry = planes[plane, live] ^ (np.uint64(0) - ((queries[live] >> np.uint64(plane)) & np.uint64(1)))
        for digit in counter:
            digit ^= carry  # sum and carry of one more differing bit, 64 lanes at a time
            carry &= ~digit
        over |= carry
        if plane % 8 == 7 and plane > radius:
            open_blocks = ~over != 0
            if not open_blocks.all():  # blocks whose distances all exceed the radius are abandoned
                live, over, counter = live[open_blocks], over[open_blocks], [d[open_blocks] for d in counter]
                if not len(live):
                    return result
    result[live] = ~over
    return result


def links(key: np.ndarray, value: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links inside each run of equal ``key`` (sorted): a forest per key that connects all within the radius."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    found: list[tuple[int, int]] = []
    many = sizes > 1
    starts, sizes = starts[many], sizes[many]
    order = np.argsort(sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    at = 0
    while at < len(starts):
        # neighbours in size go together: their blocks form the columns of one set of planes
        stop = at + int(np.searchsorted(np.cumsum((sizes[at:] + 63) // 64 * 64), 1 << 17)) + 1
        found += _compare(value, starts[at:stop], sizes[at:stop], radius)
        at = stop
    return found


def _compare(value: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    blocks = (sizes + 63) // 64
    owner = np.repeat(np.arange(len(starts)), blocks)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = starts[owner] + 64 * number
    held = np.minimum(64, sizes[owner] - 64 * number)
    place = first[:, None] + np.minimum(np.arange(64)[None, :], (held - 1)[:, None])
    planes = transpose(value[place])
    filled = np.where(held == 64, ~np.uint64(0), (np.uint64(1) << held.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    found = []
    for k in range(int(sizes.max()) - 1):
        columns = np.flatnonzero((sizes[owner] > k + 1) & (64 * number + 63 > k))
        hits = near(planes[:, columns], value[starts[owner[columns]] + k].view(np.uint64), radius) & filled[columns]
        # only lanes behind the query
        ahead = k - 64 * number[columns]
        hits &= np.where(ahead < 0, ~np.uint64(0), ~((np.uint64(2) << np.clip(ahead, 0, 63).astype(np.uint64)) - np.uint64(1)))
        for c in np.flatnonzero(hits):
            column, word = columns[c], int(hits[c])
            query = int(starts[owner[column]] + k)
            while word:
                lane = (word & -word).bit_length() - 1
                word &= word - 1
                a, b = root(query), root(int(first[column]) + lane)
                if a != b:
                    parent[a] = b
                    found.append((int(value[query]), int(value[first[column] + lane])))
    return found


def compare(placed: DataFrame, radius: int) -> DataFrame:
    """a, b: links inside every key of ``placed`` (key, fingerprint)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_value = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def emit(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            pairs = np.array(links(key, value, radius), np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            held_key = np.r_[held_key, batch.column("key").to_numpy()]
            held_value = np.r_[held_value, batch.column("fingerprint").to_numpy()]
            if len(held_key) >= 1 << 18:
                done = int(np.searchsorted(held_key, held_key[-1]))  # the last key may go on
                if done:
                    yield emit(held_key[:done], held_value[:done])
                    held_key, held_value = held_key[done:], held_value[done:]
        if len(held_key):
            yield emit(held_key, held_value)

    return placed.repartition("key").sortWithinPartitions("key").select("key", "fingerprint").mapInArrow(run, "a bigint, b bigint")


def near_links(distinct: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """a, b: links that connect all of ``distinct`` (fingerprint) within ``radius`` (3 at most) bits.

    Keys of more than ``crowd`` fingerprints are cut further, so what one task compares at once stays small
    unless that many different fingerprints agree in 36 bits.
    """
    keyed = distinct.select("fingerprint", F.explode(keys()).alias("key"))
    count = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    crowded = count.filter(F.col("n") > crowd).select("key", F.lit(True).alias("crowded"))
    split = keyed.join(crowded, "key", "left")
    placed = split.select(
        "fingerprint", F.explode(F.when(F.col("crowded"), F.transform(finer_keys(), lambda k: -k - 1)).otherwise(F.array("key"))).alias("key")
    )
    return compare(placed, radius)


def classes(docs: DataFrame, shingle: int, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, text_hash, fingerprint (long), root (one per class), component_id per row of ``docs`` (doc_id, text; others are ignored).

    Links are all within ``radius`` bits, 3 at most.
    """
    marked = cut_lineage(fingerprints(docs, shingle), "fingerprints")
    nodes = cut_lineage(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("least_doc")), "nodes")
    linked = components(near_links(nodes.select("fingerprint"), radius, crowd)).withColumnRenamed("node", "fingerprint")
    rooted = nodes.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least_doc").alias("component_id"))
    # a fingerprint that many documents share is split by AQE: the other side has one row for it
    return marked.join(rooted.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of ``radius`` or fewer bits. Documents without words
    have fingerprint zero and link like any others. A null doc_id takes part but is never a component_id unless
    its component has no other; repeated rows give repeated rows.
    """
    joined = classes(docs, shingle, radius, crowd)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, any others), all columns, that are the first of their class.

    First is the smallest doc_id (null last), then the smallest text hash, so ties are settled and repeated rows stay
    once. Texts without words (null, empty, blank) are one class. Classes are those of ``near_duplicates``.
    """
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    firsts = classes(docs, shingle, radius, crowd).groupBy("root").agg(F.min(order).alias("head"))
    known = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    heads = cut_lineage(firsts.select(F.col("head.last").alias("key_last"), known(F.col("head.doc_id")).alias("key_id"), F.col("head.text_hash").alias("key_hash")), "firsts")
    number = F.col("doc_id").cast("long")
    rows = docs.select(F.struct("*").alias("row"), number.isNull().alias("key_last"), known(number).alias("key_id"), F.xxhash64("text").alias("key_hash"))
    key = ["key_last", "key_id", "key_hash"]
    return rows.join(heads, key, "left_semi").dropDuplicates(key).select("row.*")
