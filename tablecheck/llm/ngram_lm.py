"""Word bigram scoring by deleted interpolation.

P(w | h) = l2 * c(h, w) / c(h) + l1 * c(w) / N + l0 / (V + 1), with weights by how often the context h was seen. h is the previous word, whatever
it is, or the start of a text. The weights are learned by expectation-maximisation on the bigrams of a deleted fold of training
documents, with the counts of all others; the final counts are those of all training documents.

Counts grow with the corpus, so no task and no driver holds them. Texts are packed into batches of about ``BATCH_CHARS``
characters (a written table); the deleted fold has batches of its own, with odd numbers. A batch asks for each of its distinct words and
bigrams once, as sorted 64-bit keys with its own counts, cut into blocks by the keys' leading bits. All blocks of one stretch of keys
meet in one task, which adds them up and returns to every block the sums of its keys in their order. There are as many stretches as the
corpus has ``PART_BYTES``, so what meets stays the same size at any scale, and a word that stands everywhere is one key per batch. Blocks
are packed (differences of sorted keys, byte by byte), and sums travel without their keys. Within a batch numpy does the rest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.session import cut_lineage, ship_by_value

ship_by_value(__name__)

BATCH_CHARS, PART_BYTES, ROUNDS, BUCKETS = 6_000_000, 8_000_000, 30, 40
#: The end of a text, as a token that no word can be, and the context of a text's first token.
END, START = b"\x0b", np.uint64(0x9AE16A3B2F90404F)
#: Steps per doubling when ratios are tabulated for expectation-maximisation.
STEPS = 4


def pack(docs: DataFrame, train: Column, deleted: Column, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """Batches of documents: batch, doc_ids, kinds (0 held out, 1 training, 2 deleted fold), texts (packed: tokens by
    spaces, documents by line feeds), n_bytes (unpacked), taught (tokens of training documents). A longer text is a batch of its own; a null
    text has only the end token."""
    kind = F.when(F.coalesce(train & deleted, F.lit(False)), 2).when(F.coalesce(train, F.lit(False)), 1).otherwise(0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), kind.cast("int").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    schema = pa.schema([("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("texts", pa.binary()), ("n_bytes", pa.int64()), ("taught", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        open_batches: list[tuple[list, list, list]] = [([], [], []), ([], [], [])]
        sizes = [0, 0]

        def close(odd: int) -> pa.RecordBatch:
            nonlocal number
            ids, kinds, lines = open_batches[odd]
            taught = sum(line.count(b" ") + 1 for line, kind in zip(lines, kinds, strict=True) if kind)
            texts = b"\n".join(lines)
            row = {"batch": 2 * ((part << 24) + number) + odd, "doc_ids": ids, "kinds": kinds, "texts": zstandard.ZstdCompressor(level=3).compress(texts), "n_bytes": len(texts), "taught": taught}
            open_batches[odd], sizes[odd] = ([], [], []), 0
            number += 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for values in zip(*(batch.column(c) for c in ("doc_id", "kind", "text")), strict=True):
                doc_id, kind, text = (v.as_py() for v in values)
                line = b" ".join([*text.encode("utf-8", "surrogatepass").lower().split(), END])
                odd = int(kind == 2)
                for held, value in zip(open_batches[odd], (doc_id, kind, line), strict=True):
                    held.append(value)
                sizes[odd] += len(line)
                if sizes[odd] >= batch_chars:
                    yield close(odd)
        for odd in (0, 1):
            if open_batches[odd][0]:
                yield close(odd)

    return rows.mapInArrow(run, "batch bigint, doc_ids array<bigint>, kinds array<int>, texts binary, n_bytes bigint, taught bigint")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all first bytes before all second ones, compressed."""
    planes = np.ascontiguousarray(np.asarray(values, "<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


class Batch:
    """Tokens of a batch: ``doc`` of each, and the places of its word, its bigram and its context among the batch's sorted distinct ``keys``.

    Keys of words are even, keys of bigrams odd. The context of a text's first token is the place of the end token: both
    stand once in every text.
    """

    def __init__(self, texts: bytes):
        lines = pa.array(zstandard.ZstdDecompressor().decompress(texts).split(b"\n"), pa.binary())
        lists = pc.split_pattern(lines.cast(pa.string()), " ")
        coded = lists.values.dictionary_encode()
        token = coded.indices.to_numpy().astype(np.int64)
        starts = lists.offsets.to_numpy().astype(np.int64)
        self.size = np.diff(starts)
        self.doc = np.repeat(np.arange(len(lines)), self.size)
        words = np.array([xxhash.xxh64_intdigest(w.encode()) for w in coded.dictionary.to_pylist()], np.uint64) & ~np.uint64(1)
        before = np.concatenate([[START], words[token[:-1]]])
        before[starts[:-1]] = START
        pairs = (before * np.uint64(0x9E3779B97F4A7C15)) ^ words[token]
        pairs = (pairs ^ (pairs >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        distinct, of_token = np.unique((pairs ^ (pairs >> np.uint64(32))) | np.uint64(1), return_inverse=True)
        self.keys = np.sort(np.concatenate([words, distinct]))
        at_word = np.searchsorted(self.keys, words)
        self.word, self.pair = at_word[token], np.searchsorted(self.keys, distinct)[of_token]
        self.context = np.concatenate([[0], self.word[:-1]])
        self.context[starts[:-1]] = self.word[starts[1:] - 1]

    def own(self, kinds: np.ndarray) -> np.ndarray:
        """The batch's own training uses of every key."""
        taught = kinds[self.doc] > 0
        return np.bincount(np.concatenate([self.word[taught], self.pair[taught]]), minlength=len(self.keys))


def blocks(batches: DataFrame, bits: int) -> DataFrame:
    """part, batch, keys, counts: the distinct keys of every batch, cut by their first ``bits`` bits."""
    parts = 1 << bits

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows:
            for number, texts, kinds in zip(row.column("batch"), row.column("texts"), row.column("kinds"), strict=True):
                batch = Batch(texts.as_py())
                own = batch.own(np.array(kinds.as_py()))
                low = (np.arange(parts, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
                cuts = [*np.searchsorted(batch.keys, low).tolist(), len(batch.keys)]
                made = [(p, np.diff(batch.keys[a:b], prepend=low[p]), own[a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
                columns = [pa.array([p for p, _, _ in made], pa.int32()), pa.array([number.as_py()] * len(made), pa.int64())]
                columns += [pa.array([packed(m[k]) for m in made], pa.binary()) for k in (1, 2)]
                yield pa.RecordBatch.from_arrays(columns, ["part", "batch", "keys", "counts"])

    return batches.select("batch", "kinds", "texts").mapInArrow(run, "part int, batch bigint, keys binary, counts binary")


def sums(asked: DataFrame) -> DataFrame:
    """batch, part, total, deleted (null for even batches): per block the corpus counts of its keys in their order; known, with the first
    block of a part: how many different training words lie in it."""

    def added(part: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        keys = [np.cumsum(unpacked(k)) for _, k, _ in held]  # from the part's lowest key on
        ends = np.cumsum([len(k) for k in keys])
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        counts = np.concatenate([unpacked(c) for _, _, c in held]).astype(np.int64)
        total = np.bincount(place, counts, len(distinct)).astype(np.int64)
        odd = np.repeat([number % 2 == 1 for number, _, _ in held], np.diff(ends, prepend=0))
        deleted = np.bincount(place[odd], counts[odd], len(distinct)).astype(np.int64)
        known = int(((total > 0) & (distinct % np.uint64(2) == 0)).sum())
        cut = [place[e - len(k) : e] for e, k in zip(ends, keys, strict=True)]
        columns = [
            pa.array([number for number, _, _ in held], pa.int64()),
            pa.array([part] * len(held), pa.int32()),
            pa.array([packed(total[c]) for c in cut], pa.binary()),
            pa.array([packed(deleted[c]) if number % 2 else None for (number, _, _), c in zip(held, cut, strict=True)], pa.binary()),
            pa.array([known, *[0] * (len(held) - 1)], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["batch", "part", "total", "deleted", "known"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for row in rows:
            for part, *block in zip(*(row.column(c).to_pylist() for c in ("part", "batch", "keys", "counts")), strict=True):
                if part != now and held:
                    yield added(now, held)
                    held = []
                now = part
                held.append(tuple(block))
        if held:
            yield added(now, held)

    return asked.repartition("part").sortWithinPartitions("part", "batch").mapInArrow(run, "batch bigint, part int, total binary, deleted binary, known bigint")


def in_order(answers: pa.Table, name: str) -> np.ndarray:
    """The counts of a batch's keys from its blocks."""
    blocks_ = sorted(zip(answers.column("part").to_pylist(), answers.column(name).to_pylist(), strict=True))
    return np.concatenate([unpacked(b) for _, b in blocks_]).astype(np.int64)


def bucket(count: np.ndarray) -> np.ndarray:
    """Bucket of a context by its count: 0 for none, then by doublings."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0), BUCKETS - 1)


def estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    return pair / np.maximum(context, 1), word / max(total, 1)


def held_out_table(batches: DataFrame, answers: DataFrame, main_total: int) -> DataFrame:
    """bucket, two, one, n: how many tokens of the deleted fold have which estimates (logarithms in steps; -9999 for zero), from the counts outside it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        step = lambda f: np.where(f > 0, np.rint(STEPS * np.log2(np.maximum(f, 1e-300))), -9999).astype(np.int64)
        counts = in_order(right, "total") - in_order(right, "deleted")
        found = []
        for texts in left.column("texts").to_pylist():
            batch = Batch(texts)
            context = counts[batch.context]
            f2, f1 = estimates(counts[batch.pair], context, counts[batch.word], main_total)
            kinds, n = np.unique(np.stack([bucket(context), step(f2), step(f1)], axis=1), axis=0, return_counts=True)
            found.append(np.column_stack([kinds, n]))
        rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
        return pa.table({name: pa.array(np.ascontiguousarray(rows[:, i]).astype(np.int64)) for i, name in enumerate(("bucket", "two", "one", "n"))})

    odd = batches.filter("batch % 2 = 1").select("batch", "texts").groupBy("batch")
    found = odd.cogroup(answers.filter("batch % 2 = 1").select("batch", "part", "total", "deleted").groupBy("batch"))
    return found.applyInArrow(run, "bucket bigint, two bigint, one bigint, n bigint").groupBy("bucket", "two", "one").agg(F.sum("n").alias("n"))


def learn_weights(table: list[tuple[int, int, int, int]], uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, word and uniform estimate by expectation-maximisation. Buckets without held-out
    tokens take those of the next filled bucket below, else above; the bigram has no weight where its context is unseen."""
    weights = np.full((BUCKETS, 3), np.nan)
    rows = np.array(table, np.int64).reshape(-1, 4)
    value = lambda step: np.where(step == -9999, 0.0, 2.0 ** (step / STEPS))
    for b in np.unique(rows[:, 0]):
        own = rows[rows[:, 0] == b]
        f = np.stack([value(own[:, 1]), value(own[:, 2]), np.full(len(own), uniform)], axis=1)
        w = np.array([0.0, 0.5, 0.5]) if b == 0 else np.full(3, 1 / 3)
        for _ in range(rounds):
            share = f * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * own[:, 3:]).sum(axis=0) / own[:, 3].sum()
        w = np.maximum(w, 1e-6) * ([0, 1, 1] if b == 0 else 1)  # every word keeps a probability
        weights[b] = w / w.sum()
    filled = [b for b in range(1, BUCKETS) if not np.isnan(weights[b, 0])]
    for b in range(1, BUCKETS):
        if np.isnan(weights[b, 0]):
            near = max((x for x in filled if x < b), default=min(filled, default=None))
            weights[b] = weights[near] if near is not None else (0.3, 0.6, 0.1)
    if np.isnan(weights[0, 0]):
        weights[0] = np.array([0, *weights[1, 1:]]) / weights[1, 1:].sum()
    return weights


def score(docs: DataFrame, train: Column, deleted: Column, batch_chars: int = BATCH_CHARS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, kind, n_tokens, n_known, train_tokens, base_score, score (log10) per row of ``docs`` (doc_id, text; others are ignored).

    ``train`` and ``deleted`` say which rows teach and which of them are the fold for the weights (null: not). Null and
    blank texts have one token, the end. Without training rows every token has probability 1 / (V + 1) = 1.
    Repeated rows give repeated rows, and teach repeatedly. Words and bigrams are told apart by 63 bits of a hash.
    """
    batches = cut_lineage(pack(docs, train, deleted, batch_chars), "lm-batches")
    fold = F.sum(F.when(F.col("batch") % 2 == 1, F.col("taught")))
    told = batches.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n_bytes"), F.sum("taught"), fold)]).first()
    size, tokens, fold_tokens = (int(x) for x in told)
    bits = max(0, math.ceil(math.log2(max(1, size / part_bytes))))
    answers = cut_lineage(sums(blocks(batches, bits)), "lm-answers")
    distinct = int(answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0])
    uniform = 1.0 / (distinct + 1)
    again = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both sides below come from written tables
    table = held_out_table(again(batches), again(answers), tokens - fold_tokens).collect()  # bounded by buckets and steps
    weights = learn_weights([tuple(r) for r in table], uniform)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        counts = in_order(right, "total")
        made: dict[str, list] = {n: [] for n in ("doc_id", "kind", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
        for ids, kinds, texts in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "kinds", "texts")), strict=True):
            batch = Batch(texts)
            word, context = counts[batch.word], counts[batch.context]
            f2, f1 = estimates(counts[batch.pair], context, word, tokens)
            w = weights[bucket(context)]
            model = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * uniform) if tokens else np.zeros(len(f2))
            base = np.log10((word + 1) / (tokens + distinct + 1))
            over = lambda x, batch=batch: np.bincount(batch.doc, x, minlength=len(batch.size))
            for name, values in (
                ("doc_id", ids), ("kind", kinds), ("n_tokens", batch.size), ("n_known", over((word > 0).astype(float)).astype(np.int64)),
                ("train_tokens", np.full(len(batch.size), tokens)), ("base_score", over(base)), ("score", over(model)),
            ):
                made[name].append(pa.array(values, {"kind": pa.int32(), "base_score": pa.float64(), "score": pa.float64()}.get(name, pa.int64())))
        return pa.table({n: pa.chunked_array(parts) for n, parts in made.items()})

    schema = "doc_id bigint, kind int, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    left = again(batches).select("batch", "doc_ids", "kinds", "texts").groupBy("batch")
    return left.cogroup(again(answers).select("batch", "part", "total").groupBy("batch")).applyInArrow(run, schema)
