"""Language of a text by segmentation-marginalised unigram pieces.

The pieces are those of a fixed public vocabulary (lower case, letters only). Each language has a probability for
every piece; a word's probability is the sum over all its segmentations (a forward algorithm), and the
probabilities are learned by expectation-maximisation with the same sums (forward-backward). Words are runs of letters
with a word-start mark; a run longer than ``STRETCH`` letters is taken in stretches of that length. Letters that the
vocabulary lacks share one piece.

The model is fitted on a bounded sample: at most ``SAMPLE`` different texts of each language, by hash order.
All texts are scored whole. Words are scored together in arrays, and each worker remembers at most ``MEMO``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecheck.session import cut_lineage, ship_by_value

ship_by_value(__name__)

#: Texts per language in the fit, all texts in the fit, EM rounds, added count per piece.
SAMPLE, SAMPLE_ROWS, ROUNDS, ADDED = 1500, 200_000, 4, 0.1
STRETCH, MEMO, CHUNK_CHARS = 64, 600_000, 1 << 22
START = "▁"
WORD = r"\p{L}[\p{L}\p{M}]*"


def load_pieces(path: str) -> list[str]:
    """Pieces of a SentencePiece vocabulary that are letters after an optional word start, in lower case, each once."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usable = regex.compile(rf"{START}?[\p{{L}}\p{{M}}]*").fullmatch
    names = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    return sorted({name for name in names if name and usable(name)})


def words_of(text: str | None) -> list[str]:
    """Words of a text in lower case, with the start mark, in stretches."""
    found = regex.findall(WORD, (text or "").lower())
    out = []
    for word in found:
        if len(word) < STRETCH:
            out.append(START + word)
        else:
            marked = START + word
            out.extend(marked[i : i + STRETCH] for i in range(0, len(marked), STRETCH))
    return out


class Lattice:
    """All pieces of all ``words`` as edges (word, from, to, piece), with the sums over paths."""

    def __init__(self, words: list[str], pieces: dict[str, int], longest: int):
        unknown, get = len(pieces), pieces.get
        where, begin, end, piece = [], [], [], []
        for w, word in enumerate(words):
            size = len(word)
            for i in range(size):
                for j in range(i + 1, min(size, i + longest) + 1):
                    p = get(word[i:j])
                    if p is None:
                        if j > i + 1:
                            continue
                        p = unknown
                    where.append(w)
                    begin.append(i)
                    end.append(j)
                    piece.append(p)
        self.length = np.array([len(w) for w in words], np.int64)
        self.word, self.begin, self.end, self.piece = (np.array(x, np.int64) for x in (where, begin, end, piece))
        self.width = int(self.length.max(initial=0)) + 1

    def _sums(self, probability: np.ndarray, source: np.ndarray, target: np.ndarray, start: np.ndarray, steps: range) -> np.ndarray:
        """Sums over paths by node: (words, width, models)."""
        total = np.zeros((len(self.length), self.width, probability.shape[1]))
        total[np.arange(len(self.length)), start] = 1.0
        order = np.lexsort((self.word, target))
        bounds = np.searchsorted(target[order], np.arange(self.width + 1))
        for step in steps:
            edges = order[bounds[step] : bounds[step + 1]]
            if not len(edges):
                continue
            word = self.word[edges]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sums = np.add.reduceat(total[word, source[edges]] * probability[self.piece[edges]], first, axis=0)
            total[word[first], step] = sums
        return total

    def forward(self, probability: np.ndarray) -> np.ndarray:
        return self._sums(probability, self.begin, self.end, np.zeros_like(self.length), range(1, self.width))

    def log_probability(self, probability: np.ndarray) -> np.ndarray:
        """Per word and model: log of the sum over all segmentations."""
        return np.log(self.forward(probability)[np.arange(len(self.length)), self.length])

    def expected(self, probability: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in ``count`` copies of each word, for one model."""
        before = self.forward(probability)[..., 0]
        after = self._sums(probability, self.end, self.begin, self.length, range(self.width - 1, -1, -1))[..., 0]
        whole = before[np.arange(len(self.length)), self.length]
        share = before[self.word, self.begin] * probability[self.piece, 0] * after[self.word, self.end] / whole[self.word]
        return np.bincount(self.piece, share * count[self.word], minlength=len(probability))


def labelled_words(train: DataFrame, sample: int) -> DataFrame:
    """lang, word, n over the sample of ``train`` (text, lang)."""
    rows = train.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", F.xxhash64("text").alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = rows.select("lang", "h").distinct().withColumn("rank", rank).filter(F.col("rank") <= sample).drop("rank").limit(SAMPLE_ROWS)
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(text))
            rows = [{"lang": lang, "word": word, "n": n} for (lang, word), n in seen.items()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    return texts.select("lang", "text").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(train: DataFrame, pieces: list[str], sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the piece probabilities (pieces + 1 for unknown letters, languages).

    Only sums per piece and language come to the driver, in each round.
    """
    counted = cut_lineage(labelled_words(train, sample), "language-words")
    langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
    ids = {p: i for i, p in enumerate(pieces)}
    longest, n = max(map(len, pieces), default=1), len(pieces) + 1
    probability = np.full((n, len(langs)), 1.0 / n)
    context = train.sparkSession.sparkContext
    vocabulary = context.broadcast(ids)
    for _ in range(rounds if langs else 0):
        current = context.broadcast((langs, probability))

        def expect(frames: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            names, table = current.value
            for frame in frames:
                for lang, group in frame.groupby("lang"):
                    uses = Lattice(list(group["word"]), vocabulary.value, longest).expected(table[:, [names.index(lang)]], group["n"].to_numpy(float))
                    at = np.flatnonzero(uses)
                    yield pd.DataFrame({"lang": lang, "piece": at, "uses": uses[at]})

        sums = counted.mapInPandas(expect, "lang string, piece bigint, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).collect()
        uses = np.zeros((n, len(langs)))
        for row in sums:
            uses[row.piece, langs.index(row.lang)] = row.uses
        probability = (uses + ADDED) / (uses + ADDED).sum(axis=0)
    return langs, probability


def predict(docs: DataFrame, langs: list[str], probability: np.ndarray, pieces: list[str], memo_size: int = MEMO, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score``, from ``text`` alone.

    ``und`` with score 0 for a null text, a text without a letter, or a model without languages. Otherwise the
    language of the largest likelihood (the first in order among equals) and its posterior under equal priors.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, probability, {p: i for i, p in enumerate(pieces)}))
    longest = max(map(len, pieces), default=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, ids = shared.value
        memo: dict[str, int] = {}
        known = np.zeros((0, len(names)))

        def learn(new: list[str]) -> None:
            nonlocal known
            parts = [Lattice(new[i : i + 8192], ids, longest).log_probability(table) for i in range(0, len(new), 8192)]
            memo.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            known = np.concatenate([known, *parts])

        def judge(texts: list[list[str]]) -> Iterator[tuple[str, float]]:
            nonlocal known
            if len(memo) > memo_size:
                memo.clear()
                known = known[:0]
            if new := list(dict.fromkeys(w for words in texts for w in words if w not in memo)):
                learn(new)
            for words in texts:
                if not words or not names:
                    yield "und", 0.0
                    continue
                total = known[[memo[w] for w in words]].sum(axis=0)
                best = int(total.argmax())
                yield names[best], float(1.0 / np.exp(total - total[best]).sum())

        for batch in batches:
            found: list[tuple[str, float]] = []
            waiting: list[list[str]] = []
            size = 0
            for cell in batch.column(text):
                said = cell.as_py() or ""
                waiting.append(words_of(said))
                size += len(said)
                if size > CHUNK_CHARS:
                    found.extend(judge(waiting))
                    waiting, size = [], 0
            found.extend(judge(waiting))
            columns = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, pred, score])

    kinds = docs.select("*", F.lit("").alias(pred), F.lit(0.0).alias(score)).schema
    return docs.mapInArrow(run, kinds)


def identify(docs: DataFrame, path: str, training: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, lang_pred, score of every row of ``docs``; ``training`` says which rows may teach (null: no)."""
    pieces = load_pieces(path)
    langs, probability = fit(docs.filter(training).select("lang", "text"), pieces, sample)
    return predict(docs.select("doc_id", "text"), langs, probability, pieces)
