"""Importance resampling towards a target distribution, with words found by an Aho-Corasick dictionary.

A worker's dictionary holds distinct words between delimiters, each with the CRC-32 and the length of its bytes as payload.
One scan of a text emits the payloads of all its known words; what lies between two matches is read word by word, and
those words enter the dictionary when it is built anew (each time it can double, up to ``WORDS``). So no word is
left out, memory is bounded, and what a dictionary knows steers only the time. Features are runs of 1 to ``order``
neighbouring words: the CRC of a longer run is composed of the payloads of its parts, no string is joined.

Features are counted by bucket (CRC modulo ``buckets``) over all documents and over the target texts; a bucket's gain is the
scaled log ratio of both shares, a document's weight the floored mean gain of its features. Documents are drawn without
replacement by adding Gumbel noise that a hash of the id gives (the highest sums are a weighted sample). Counts are
combined per task before the shuffle, ``buckets`` sums reach the driver; ranks come from counts of equal scores, so no
task sorts all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.session import cut_lineage, ship_by_value

ship_by_value(__name__)

BUCKETS, ORDER, SEED, PERCENT, MIN_WORDS = 10_000, 1, 2024, 10, 20
#: Words a dictionary holds at most; words before it is first built; characters scanned at once (one text at least).
WORDS, FIRST, CHUNK = 1 << 17, 1 << 10, 1 << 21
#: Scores that share a slice of the rank's prefix sums.
SLICE = 4096
#: Letters A-Z become small, other ASCII but digits and small letters becomes a space; bytes of other characters stay.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def _appended(value: int, zeros: int) -> int:
    """CRC register after ``zeros`` zero bytes, bit by bit."""
    for _ in range(8 * zeros):
        value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
    return value


def _shift_tables(levels: int = 31) -> list[np.ndarray]:
    """For each power of two of bytes, what every value of every byte of a CRC becomes when so many bytes follow."""
    powers = [np.array([_appended(1 << b, 1) for b in range(32)], np.uint32)]  # images of the single bits
    for _ in range(levels - 1):
        powers.append(_through(_table(powers[-1]), powers[-1]))
    return [_table(p) for p in powers]


def _table(images: np.ndarray) -> np.ndarray:
    table = np.zeros((4, 256), np.uint32)
    for b in range(32):
        table[b // 8, (np.arange(256) >> b % 8 & 1).astype(bool)] ^= images[b]
    return table


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0, crc & 255] ^ table[1, crc >> 8 & 255] ^ table[2, crc >> 16 & 255] ^ table[3, crc >> 24]


_SHIFTS: list[np.ndarray] = []


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of the joined bytes, from the CRCs of both parts and the number of bytes of the right ones."""
    if not _SHIFTS:
        _SHIFTS.extend(_shift_tables())
    crc, level = left.astype(np.uint32), 0
    length = np.broadcast_to(length, crc.shape)
    while (length >> level).any():
        moved = (length >> level & 1).astype(bool)
        crc[moved] = _through(_SHIFTS[level], crc[moved])
        level += 1
    return crc ^ right.astype(np.uint32)


class Dictionary:
    """Words seen so far, with payloads; ``scan`` finds the words of a text in which single spaces or runs of them part words."""

    def __init__(self, most: int = WORDS, first: int | None = None):
        self.most, self.next = most, FIRST if first is None else first
        self.known: dict[str, tuple[int, int]] = {}
        self.automaton: ahocorasick.Automaton | None = None
        self.payload = np.zeros((0, 3), np.int64)

    def _build(self) -> None:
        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, word in enumerate(self.known):
            made.add_word(f" {word} ", n)
        made.make_automaton()
        self.automaton, self.next = made, 2 * len(self.known)
        self.payload = np.array([(crc, size, len(word)) for word, (crc, size) in self.known.items()], np.int64).reshape(-1, 3)

    def scan(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, CRC and number of bytes of every word of ``text`` (with a space at both ends), in order."""
        found = np.zeros(0, np.int64)
        if self.automaton is not None:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        end, payload = found[0::2], self.payload[found[1::2]]
        start = end - payload[:, 2]
        # between two matches, or a match and an end of the text, there may be words that the dictionary lacks
        low, high = np.r_[0, end], np.r_[start - 1, len(text) - 1]
        rest, words = [], re.compile("[^ ]+").finditer
        for k in np.flatnonzero(high - low > 1):
            for m in words(text, low[k], high[k] + 1):
                word = m[0]
                pair = self.known.get(word)
                if pair is None:
                    raw = word.encode()
                    pair = zlib.crc32(raw), len(raw)
                    if len(self.known) < self.most:
                        self.known[word] = pair
                rest.append((m.start(), *pair))
        if rest:
            more = np.array(rest, np.int64)
            start, payload = np.r_[start, more[:, 0]], np.r_[payload[:, :2], more[:, 1:]]
            order = np.argsort(start, kind="stable")
            start, payload = start[order], payload[order]
        if len(self.known) >= self.next or (len(self.known) == self.most and len(self.payload) < self.most):
            self._build()
        return start, payload[:, 0], payload[:, 1]


def features(dictionary: Dictionary, column: pa.Array, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers of some of the texts, number of words of each, and (row, bucket) of every feature as two rows of an array."""
    texts = pc.fill_null(column, "")
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chunk = np.cumsum(sizes + 1) // CHUNK
    for rows in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(chunk)) + 1):
        if not len(rows):
            continue
        joined = " ".join(texts.slice(rows[0], len(rows)).to_pylist()).encode().translate(PLAIN).decode()
        start, crc, size = dictionary.scan(f" {joined} ")
        row = np.searchsorted(np.cumsum(sizes[rows] + 1), start - 1, side="right")
        held, run = [(row, crc.astype(np.uint32))], crc.astype(np.uint32)
        for k in range(1, min(order, len(row))):
            n = len(row) - k
            same = row[:n] == row[k:]
            spaced = composed(run[:n], np.full(n, zlib.crc32(b" "), np.uint32), np.int64(1))
            run = composed(spaced, crc[k:], size[k:])
            held.append((row[:n][same], run[same]))
        pairs = np.stack([np.concatenate([r for r, _ in held]), np.concatenate([c for _, c in held]) % buckets])
        yield rows, np.bincount(row, minlength=len(rows)), pairs


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, order: int = ORDER, words: int = WORDS) -> DataFrame:
    """bucket, n: features of all whole texts (column text) by bucket; buckets without any are left out. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, total = Dictionary(words), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, pairs in features(dictionary, batch.column(0), order, buckets):
                total += np.bincount(pairs[1].astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln) of the ratio of smoothed shares by bucket (target over raw); empty tables count as zeros. 2 x ``buckets`` sums reach the driver."""
    s, t = ({r.bucket: r.n for r in df.collect()} for df in (raw, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    ratio = lambda b: (t.get(b, 0) + 1.0) * (all_s + float(buckets)) / ((s.get(b, 0) + 1.0) * (all_t + float(buckets)))
    return [math.floor(1000 * math.log(ratio(b))) for b in range(buckets)]


def weigh(docs: DataFrame, gain: list[int], order: int = ORDER, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_words, n_features, weight (floored mean gain; 0 without features)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, table = Dictionary(words), np.array(shared.value, np.int64)
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for rows, counted, (row, bucket) in features(dictionary, batch.column(1), order, len(table)):
                n_words[rows] = counted
                n = np.bincount(row, minlength=len(rows))
                total = np.bincount(row, table[bucket], minlength=len(rows)).astype(np.int64)  # whole numbers below 2**53
                n_features[rows], weight[rows] = n, total // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> F.Column:
    """Scaled Gumbel noise of a document: floor(-1000 ln(-ln u)), u from the first 32 bits of a digest of seed and id (a null id: no digits)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def draw(weighed: DataFrame, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``weighed`` (doc_id, n_words, weight, others) with score (weight + noise) and rank.

    Of the N rows with at least ``min_words`` words, floor(percent * N / 100) with the highest scores are drawn and ranked from 1; ties go to the
    smaller doc_id (null last). Other rows have a null rank. Repeated rows are rows like any other. ``weighed`` is read several times: pass a written table.
    """
    scored = weighed.withColumn("score", F.col("weight") + noise(seed))
    able = F.col("n_words") >= min_words
    counted = cut_lineage(scored.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n")).withColumn("slice", F.floor(F.col("score") / SLICE)), "scores")
    total = counted.agg(F.sum("n")).first()[0] or 0
    wanted = percent * total // 100
    slices = counted.groupBy("slice").agg(F.sum("n").alias("n"))  # one row for SLICE scores
    above = slices.select("slice", (F.sum("n").over(Window.orderBy(F.desc("slice"))) - F.col("n")).alias("above"))
    inside = F.sum("n").over(Window.partitionBy("slice").orderBy(F.desc("score"))) - F.col("n")
    before = counted.withColumn("inside", inside).join(above, "slice").select(F.col("score").alias("of_score"), (F.col("above") + F.col("inside")).alias("before")).filter(F.col("before") < wanted)
    before = cut_lineage(before, "score-ranks")
    same = able & (F.col("score") == F.col("of_score"))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    near = scored.join(before, same).withColumn("rank", F.col("before") + place).drop("of_score", "before")
    near = near.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return near.unionByName(scored.join(before, same, "left_anti").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, order: int = ORDER, words: int = WORDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_features, weight, score, rank; ``target`` (text) is the distribution wanted.

    Null texts have no words: weight 0, never drawn unless ``min_words`` is 0. An empty target or no documents leave all shares to the smoothing.
    """
    gain = gains(bucket_counts(docs, buckets, order, words), bucket_counts(target, buckets, order, words), buckets)
    return draw(cut_lineage(weigh(docs, gain, order, words), "weights"), seed, percent, min_words)
