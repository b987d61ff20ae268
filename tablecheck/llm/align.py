"""Alignment of two tokenizers' tokens over a corpus, each distinct text worked on once.

Documents are shuffled by their full text, so copies meet (and are counted before they travel); each distinct text is encoded by
both tokenizers and aligned at the byte offsets where tokens of both end. The tokens between two such offsets are a group, and
all pairs of an A and a B token of a group are links. A pair of ids counts the documents that hold it linked: every
distinct text adds its number of copies. Measures that need these counts are joined back to the texts, and texts to doc_ids.

Texts are worked on in batches of about ``CHUNK`` characters. A batch is one row: its texts' measures, its distinct pairs
of ids, and for every text the places of its pairs among them with their uses. So counting and answering cost one row per batch and
distinct pair, not one per text and pair, and what meets in one task is bounded by a batch. No vocabulary-sized table of pairs
is broadcast or sent to the driver.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecheck.session import scratch_path, ship_by_value

ship_by_value(__name__)

#: Characters of a batch (one text at least) and links spread out at once.
CHUNK, LINKS = 4_000_000, 1 << 20
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: How byte-level vocabularies write bytes that are not printable (the others stand for themselves).
PRINTABLE = (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))
#: Separators of the digested text: inside a side, between the sides, between groups, after the last group.
SEPARATORS = (",", "|", ";", "")


def byte_level() -> dict[str, int]:
    """Character to byte of byte-level vocabularies."""
    others = [b for b in range(256) if b not in PRINTABLE]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + k): b for k, b in enumerate(others)}


def load_a(path: str, pattern: str) -> dict[bytes, int]:
    """Ranks of a byte-level BPE file (JSON) whose ids follow its merges, so that the lowest id merges first.

    Special tokens are left out: their strings inside texts are plain text.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["content"] for t in told["added_tokens"]}
    to_byte = byte_level()
    ranks = {bytes(to_byte[c] for c in entry): n for entry, n in told["model"]["vocab"].items() if entry not in special}
    merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
    order = [told["model"]["vocab"]["".join(m)] for m in merges]
    if order != sorted(order) or len(order) + 256 != len(ranks):
        raise ValueError("the ids of this vocabulary do not follow its merges")
    return ranks


def pieces_of(model: bytes) -> list[bytes]:
    """Bytes of every piece of a SentencePiece model by id; control and unknown pieces stand for none."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    found = []
    for n in range(sp.get_piece_size()):
        piece = sp.id_to_piece(n)
        if sp.is_byte(n):
            found.append(bytes([int(piece[3:5], 16)]))
        else:
            found.append(b"" if sp.is_control(n) or sp.is_unknown(n) else piece.replace("▁", " ").encode())
    return found


class Aligner:
    """Both tokenizers and the tables of their tokens' bytes and digits."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        by_id = [b""] * (max(ranks.values()) + 1)
        for piece, n in ranks.items():
            by_id[n] = piece
        sides = by_id, pieces_of(model)
        self.size_b = len(sides[1])
        self.bytes = [pa.array(side, pa.large_binary()) for side in sides]
        self.lengths = [np.array([len(p) for p in side], np.int64) for side in sides]
        self.digits = pa.array([f"{n}{s}".encode() for n in range(max(map(len, sides))) for s in SEPARATORS], pa.large_binary())

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per side the ids of all texts in a row, and the number of each text's ids."""
        both = [self.a.encode_ordinary(" " + t) for t in texts], self.b.encode(texts, num_threads=1)
        return [(np.fromiter(chain.from_iterable(side), np.int64), np.fromiter(map(len, side), np.int64, len(side))) for side in both]

    def joined(self, side: int, ids: np.ndarray) -> bytes:
        return _data(pc.take(self.bytes[side], pa.array(ids)))

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """Per text n_a, n_b, n_groups, n_links, groups_sha256; pairs (sorted codes of distinct pairs of ids), and per text the places of
        its pairs in that list with their uses, between ``ends``."""
        wanted = [b" " + t.encode() for t in texts]
        sides = self.encode(texts)
        size = np.array([len(w) for w in wanted], np.int64)
        good = np.ones(len(texts), bool)
        for side, (ids, counts) in enumerate(sides):
            owner = np.repeat(np.arange(len(texts)), counts)
            good &= np.bincount(owner, self.lengths[side][ids], len(texts)).astype(np.int64) == size
        for side, (ids, counts) in enumerate(sides):
            starts = np.r_[0, np.cumsum(counts)]
            if not good.all() or self.joined(side, ids) != b"".join(wanted):
                good &= [bool(g) and self.joined(side, ids[starts[k] : starts[k + 1]]) == wanted[k] for k, g in enumerate(good)]
        sides = [(ids[np.repeat(good, counts)], np.where(good, counts, 0)) for ids, counts in sides]
        total = int(size[good].sum())
        ends = [np.cumsum(self.lengths[side][ids]) for side, (ids, _) in enumerate(sides)]
        marks = np.zeros((2, total + 1), bool)
        for side in (0, 1):
            marks[side, ends[side]] = True
        common = np.flatnonzero(marks[0] & marks[1])
        group = [np.searchsorted(common, e) for e in ends]
        held = [np.bincount(g, minlength=len(common)) for g in group]
        text_end = np.cumsum(np.where(good, size, 0))
        owner = np.searchsorted(text_end, common)  # the text of each group: the first that ends there or later
        links = held[0] * held[1]
        out = {"n_a": sides[0][1], "n_b": sides[1][1], "n_groups": np.bincount(owner, minlength=len(texts))}
        out["n_links"] = np.bincount(owner, links, len(texts)).astype(np.int64)
        out["groups_sha256"] = self.digests(sides, group, held, owner, good)
        return out | self.pairs([ids for ids, _ in sides], held, owner, links, len(texts))

    def digests(self, sides: list, group: list, held: list, owner: np.ndarray, good: np.ndarray) -> list[str]:
        (ids_a, counts_a), (ids_b, counts_b) = sides
        upto = [np.cumsum(h) for h in held]  # tokens of a side up to each group
        at_a = np.arange(len(ids_a)) + (upto[1] - held[1])[group[0]]
        at_b = np.arange(len(ids_b)) + upto[0][group[1]]
        code = np.zeros(len(ids_a) + len(ids_b), np.int64)
        code[at_a], code[at_b] = 4 * ids_a, 4 * ids_b
        if len(owner):
            final = np.r_[owner[1:] != owner[:-1], True]  # a text's last group
            code[at_a[upto[0] - 1]] += 1
            code[at_b[upto[1] - 1]] += np.where(final, 3, 2)
        written = pc.take(self.digits, pa.array(code))
        data, offsets = _data(written), _offsets(written)
        ends = np.cumsum(counts_a + counts_b)
        starts = offsets[ends - counts_a - counts_b]
        ends = offsets[ends]
        return [hashlib.sha256(data[s:e]).hexdigest() if g else "" for s, e, g in zip(starts, ends, good, strict=True)]

    def pairs(self, ids: list, held: list, owner: np.ndarray, links: np.ndarray, texts: int) -> dict[str, np.ndarray]:
        first = [np.cumsum(h) - h for h in held]
        keys, uses = [], []
        span = len(self.lengths[0]) * self.size_b

        def add(key: np.ndarray, use: np.ndarray | None = None) -> None:
            found, place, counted = np.unique(key, return_inverse=True, return_counts=True)
            keys.append(found)
            uses.append(counted if use is None else np.bincount(place, use).astype(np.int64))

        upto, at = np.cumsum(links), 0
        while at < len(links):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + LINKS, side="right")))
            some = links[at:stop]
            if stop == at + 1 and some[0] > LINKS:  # a group without common ends: by its distinct ids, never pair by pair
                (a, n_a), (b, n_b) = (np.unique(ids[s][first[s][at] : first[s][at] + held[s][at]], return_counts=True) for s in (0, 1))
                for x, n in zip(a, n_a, strict=True):
                    add(owner[at] * span + x * self.size_b + b, n * n_b)
            else:
                group = np.repeat(np.arange(at, stop), some)
                number = np.arange(len(group)) - np.repeat(np.cumsum(some) - some, some)
                a = ids[0][first[0][group] + number // held[1][group]]
                b = ids[1][first[1][group] + number % held[1][group]]
                add(owner[group] * span + a * self.size_b + b)
            at = stop
        key, use = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, uses))
        if len(keys) > 1:
            key, place = np.unique(key, return_inverse=True)
            use = np.bincount(place, use).astype(np.int64)
        distinct, place = np.unique(key % span, return_inverse=True)
        return {"pairs": distinct, "place": place, "uses": use, "ends": np.searchsorted(key, np.arange(1, texts + 1) * span)}


def _offsets(taken: pa.Array | pa.ChunkedArray) -> np.ndarray:
    taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
    return np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1, 8 * taken.offset) if len(taken) else np.zeros(1, np.int64)


def _data(taken: pa.Array | pa.ChunkedArray) -> bytes:
    taken = taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken
    if not len(taken):
        return b""
    offsets = _offsets(taken)
    return taken.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]


BATCH = (
    "batch bigint, k1 array<bigint>, k2 array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, "
    "groups_sha256 array<string>, steps array<int>, uses array<int>, ends array<int>, pairs array<bigint>, documents array<bigint>"
)


def batches(texts: DataFrame, ranks: dict[bytes, int], pattern: str, model: bytes, chunk: int = CHUNK) -> DataFrame:
    """``texts`` (k1, k2, text, copies; distinct texts) encoded and aligned, a row for each batch."""
    shared = texts.sparkSession.sparkContext.broadcast((ranks, pattern, model))

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = None, TaskContext.get().partitionId() << 32

        def row(held: pa.Table) -> pa.RecordBatch:
            nonlocal number
            made = aligner.align(held.column("text").to_pylist())
            copies = held.column("copies").to_numpy()
            owner = np.repeat(np.arange(len(copies)), np.diff(made["ends"], prepend=0))
            documents = np.bincount(made["place"], copies[owner], len(made["pairs"])).astype(np.int64)
            made |= {"batch": number, "k1": held.column("k1").to_numpy(), "k2": held.column("k2").to_numpy(), "documents": documents}
            made["steps"] = np.diff(made.pop("place"), prepend=0)  # small numbers for the compression
            number += 1
            kinds = {"groups_sha256": pa.string(), "steps": pa.int32(), "uses": pa.int32(), "ends": pa.int32()}
            names = [c.split()[0] for c in BATCH.split(", ")]
            columns = [pa.array([made[n]]) if n == "batch" else pa.array([made[n]], pa.list_(kinds.get(n, pa.int64()))) for n in names]
            return pa.RecordBatch.from_arrays(columns, names)

        waiting, size = [], 0
        for batch in arrow:
            aligner = aligner or Aligner(*shared.value)
            sizes = pc.utf8_length(batch.column("text")).to_numpy().astype(np.int64)
            start = 0
            for k, n in enumerate(sizes.tolist()):
                size += n
                if size >= chunk:
                    yield row(pa.Table.from_batches([*waiting, batch.slice(start, k + 1 - start)]))
                    waiting, size, start = [], 0, k + 1
            if start < batch.num_rows:
                waiting.append(batch.slice(start))
        if waiting:
            yield row(pa.Table.from_batches(waiting))

    return texts.select("k1", "k2", "text", "copies").mapInArrow(run, BATCH)


def pair_counts(stored: DataFrame, size_b: int) -> tuple[DataFrame, DataFrame]:
    """Every (batch, at, pair) of the batches, and per pair its number of documents, negative where it is the highest of its A id."""
    every = stored.select("batch", F.posexplode(F.arrays_zip("pairs", "documents")).alias("at", "p")).select("batch", "at", "p.pairs", "p.documents")
    counted = every.groupBy("pairs").agg(F.sum("documents").alias("n")).withColumn("a", F.floor(F.col("pairs") / size_b))
    highest = counted.groupBy("a").agg(F.max("n").alias("most"))
    signed = counted.join(highest, "a").select("pairs", F.when(F.col("n") == F.col("most"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    return every.select("batch", "at", "pairs"), signed


def _answered(batch: pa.Table, answers: pa.Table) -> pa.Table:
    """k1, k2 and measures of a batch's texts; answers: at, n."""
    values = np.zeros(answers.num_rows, np.int64)
    values[answers.column("at").to_numpy()] = answers.column("n").to_numpy()
    made: dict[str, list] = {n: [] for n in ("k1", "k2", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")}
    for k in range(batch.num_rows):
        flat = lambda name, k=k: batch.column(name)[k].values
        uses = flat("uses").to_numpy().astype(np.int64)
        n = values[np.cumsum(flat("steps").to_numpy().astype(np.int64))]
        ends = flat("ends").to_numpy()
        for name, each in (("n_best", uses * (n < 0)), ("count_sum", uses * np.abs(n))):
            upto = np.r_[0, np.cumsum(each)]
            made[name].append(pa.array(upto[ends] - upto[np.r_[0, ends[:-1]]]))
        for name in ("k1", "k2", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"):
            made[name].append(flat(name))
    return pa.table({n: pa.chunked_array(parts) for n, parts in made.items()})


def measures(docs: DataFrame, path_a: str, pattern: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a space and the text, B the text. Null and empty texts, and texts that either side's tokens do not spell (with the
    space), have no tokens: zeros and an empty digest. A pair's count is over all rows, repeated ones included; ties for an A id's highest all count. Null ids are
    ids like any other.
    """
    spark = docs.sparkSession
    ranks = load_a(path_a, pattern)
    with open(path_b, "rb") as f:
        model = f.read()
    size_b = sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
    texts = docs.select("text").filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    key = [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]
    path = scratch_path(spark, "aligned")
    batches(texts.select(*key, "text", "copies"), ranks, pattern, model, chunk).write.option("compression", "zstd").parquet(path)
    stored = lambda: spark.read.schema(BATCH).parquet(path)  # two readers, as both sides of the grouping below come from it
    every, signed = pair_counts(stored(), size_b)
    answers = every.join(signed, "pairs").select("batch", "at", "n")
    schema = "k1 bigint, k2 bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint"
    found = stored().drop("pairs", "documents").groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(_answered, schema)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *key)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", *[zero(m) for m in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
